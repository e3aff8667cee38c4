"""Source divergence against a plain count of everything."""

import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vectext.llm import divergence

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def plain_terms(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    return TERM.findall(lower)


def plain(rows, least_docs=3, top=200):
    rows = [(lang or "", source or "", text or "") for lang, source, text in rows]
    docs, counts = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        words = plain_terms(text)
        docs[lang].update(set(words))
        counts[lang, source].update(words)
    out = []
    f = lambda p, q: (p - q) ** 2 // q
    for lang in docs.keys() | {r[0] for r in rows}:
        kept = [t for t, n in docs[lang].items() if n >= least_docs]
        sources = sorted({r[1] for r in rows if r[0] == lang})
        whole = Counter({t: sum(counts[lang, s][t] for s in sources) for t in kept})

        def share(count_of, term):
            return 1 + 10**9 * (count_of[term] + 1) // (sum(count_of[t] for t in kept) + len(kept))

        p = {s: {t: share(counts[lang, s], t) for t in kept} for s in sources}
        q = {t: share(whole, t) for t in kept}
        for s in sources:
            pairs = sorted(((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in sources if o != s))
            out += [(lang, s, "pair", o, -v, k) for k, (v, _, o) in enumerate(pairs, 1)]
            terms = sorted((-f(p[s][t], q[t]), t.encode(), t) for t in kept if counts[lang, s][t] > 0 and p[s][t] > q[t])
            out += [(lang, s, "term", t, -v, k) for k, (v, _, t) in enumerate(terms[:top], 1)]
    return sorted(out)


def some_rows(seed, n=400):
    rnd = random.Random(seed)
    words = ["Zug", "zug", "été", "Été", "a", "the", "x9y", "don't", "中文", "中", "\U0001f600", "word_word", "Ärger", "IİI"] + [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60)]
    rows = []
    for _ in range(n):
        lang = rnd.choice(["en", "en", "en", "de", None, ""])
        source = "hot" if rnd.random() < 0.4 else rnd.choice(["s1", "s2", "é", None, "", "s10"])
        text = rnd.choice(["", None, " \n"]) if rnd.random() < 0.05 else rnd.choice([" ", ", ", "\t", "\x00", "7"]).join(rnd.choices(words, k=rnd.randint(1, 40)))
        rows.append((lang, source, text))
    rows += [("rare", "a", "once only"), ("rare", "b", "twice"), ("lone", "a", "one source " * 3)] + [("lone", "a", "one source")] * 3
    rows += [("tie", s, "same words here") for s in ("b", "a", "é", "Z") for _ in range(3)]
    return rows


@pytest.mark.parametrize("memory_terms, block_postings, shards", [(400_000, 2048, 8), (50, 3, 5)])
def test_against_plain(spark, memory_terms, block_postings, shards):
    rows = some_rows(shards)
    df = spark.createDataFrame(rows, "lang string, source string, text string").repartition(4)
    df = df.withColumn("term", F.lit(1)).withColumn("item", F.lit(1)).withColumn("p", F.lit(1))
    got = divergence.source_divergence(df, top=10, memory_terms=memory_terms, block_postings=block_postings, shards=shards)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == plain(rows, top=10)


@pytest.mark.parametrize("slice_postings", [1, 50, 10_000])
def test_merge_opens_blocks_when_reached(slice_postings):
    """Slices follow each other in term order, no term lies in two, and blocks are not opened early."""
    rnd = random.Random(4)
    want, blocks = Counter(), []
    for run in range(30):
        postings = sorted((b"%03d" % rnd.randrange(300), rnd.choice("abc"), rnd.randint(1, 9), 1) for _ in range(rnd.randint(1, 80)))
        for t, s, n, _ in postings:
            want[t, s] += n
        for at in range(0, len(postings), 7):
            columns = [pa.array(c, f.type) for c, f in zip(zip(*postings[at:at + 7]), divergence.POSTINGS)]
            blocks.append(pa.RecordBatch.from_arrays(columns, schema=divergence.POSTINGS))
    blocks.sort(key=lambda b: b.column(0)[0].as_py())
    read, got, last = [], Counter(), b""

    def stream():
        for block in blocks:
            read.append(block.num_rows)
            yield block

    done = 0
    for part in divergence.merged(stream(), slice_postings):
        terms = part.column(0).to_pylist()
        assert min(terms) > last
        last, done = max(terms), done + len(terms)
        assert sum(read) - done <= slice_postings + 30 * 7 + 200
        for t, s, n in zip(terms, part.column(1).to_pylist(), part.column(2).to_pylist()):
            got[t, s] += n
        rows = divergence.added_up("x", part, 1).to_pylist()
        assert len({(r["term"], r["source"]) for r in rows}) == len(rows)
    assert got == want


@pytest.mark.parametrize("size", [1, 5, 1 << 20])
def test_terms_of_long_texts(size):
    text = "Ab é中 x1y 'Z' " * 50 + "long" * 20
    got = [w for words in divergence.terms_of(text.encode(), size) for w in words]
    assert [w.decode() for w in got] == plain_terms(text)


def test_very_long_text_and_terms(spark):
    rows = [("en", "a", "word Other " * 400_000)] * 1 + [("en", "a", "word"), ("en", "b", "word other"), ("en", "b", "x" * 3_000_000 + " other")]
    df = spark.createDataFrame(rows, "lang string, source string, text string")
    assert sorted(map(tuple, divergence.source_divergence(df).collect())) == plain(rows)


def test_large_counts_are_exact(spark):
    """Shares of counts beyond what doubles hold."""
    df = spark.createDataFrame([(9_007_199_254_740_993, 9_007_199_254_740_995, 3), (0, 0, 7)], "c bigint, n bigint, v bigint")
    got = [r[0] for r in df.select(divergence.share("c", "n", "v")).collect()]
    assert got == [1 + 10**9 * (c + 1) // (n + v) for c, n, v in ((9_007_199_254_740_993, 9_007_199_254_740_995, 3), (0, 0, 7))]


def test_pairs_come_once_per_task(spark):
    """Corrections are added up in the task: rows out do not grow with the terms."""
    priced = spark.range(3000).selectExpr("'en' lang", "cast(id div 3 as string) term", "cast(id % 3 as string) source", "id + 5 p", "2L p0")
    assert divergence.corrections(priced.coalesce(1)).count() <= 6 * 8


def test_empty_table(spark):
    none = spark.createDataFrame([], "lang string, source string, text string")
    assert divergence.source_divergence(none).count() == 0
