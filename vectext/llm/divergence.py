"""How far the sources of a language are apart, by exact term frequencies.

Index. Each task counts terms in memory, one map per (lang, source); when the
maps hold ``memory_terms`` entries they are sorted by term and passed on as a
run, in blocks of ``block_postings``, and counting begins anew. A shard, named
by a hash of (lang, term), gets its blocks of all runs in the order of their
first terms and merges them with a heap: a block is opened when the merge
reaches its first term, so a task holds the blocks that overlap there, and the
slice that it adds up. What comes out is every term's frequency per source, for terms in
enough documents of their language.

Shares. A term's share in a group is 1 + floor(10^9 * (count + 1) / (N + V)),
with N the group's counts of all V kept terms; exact in integers.

Pairs. Summed over all kept terms, f(p, q) = floor((p - q)^2 / q) needs no row
per pair and term: a term that a source lacks has the source's least share, so
sums against it follow from how many terms have which share. Only where both
sources have the term is the sum off; those corrections are computed term by
term as the terms stream by, added up per pair in the task, and passed on as one
row per pair. Sources of one language are all paired, as the result asks for.

Null texts, languages and sources are empty ones. Texts of any length are counted
in pieces that end between terms. Repeated rows are documents of their own. An
empty table gives no rows; a language without kept terms gives pairs of value 0
and no terms. Ties of value go by the item's UTF-8 bytes. Other columns are not
looked at, whatever their names.
"""

from __future__ import annotations

import heapq
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import groupby, islice

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from vectext.llm.streams import group_starts, text_of, whole_groups
from vectext.session import cut_lineage

#: Terms that a task counts before it passes a run on.
MEMORY_TERMS = 800_000
#: Postings in a block of a run.
BLOCK_POSTINGS = 2048
#: Postings that a merge takes at a time.
SLICE_POSTINGS = 200_000
#: Pairs whose corrections a task adds up before it passes them on.
MEMORY_PAIRS = 500_000
#: Bytes of a text that are cut into terms at a time.
PIECE_BYTES = 1 << 20
#: Parts into which the shares of one language are dealt.
SPREAD = 16
SCALE = 1_000_000_000
#: Every byte as a term has it: A-Z lower-cased, other ASCII but letters a space.
TERM_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


# --------------------------------------------------------------------- index


def terms_of(text: bytes, size: int = PIECE_BYTES) -> Iterator[list[bytes]]:
    """The terms of a UTF-8 text, piece by piece."""
    at = 0
    while at < len(text):
        end = at + size
        piece = text[at:end].translate(TERM_BYTES)
        if end < len(text):
            # What follows the last gap goes to the next piece, unless one term is longer than a piece.
            gap = piece.rfind(b" ")
            if gap < 0:
                size *= 2
                continue
            piece = piece[:gap + 1]
        at += len(piece)
        yield piece.split()


class Postings:
    """Counts and document counts of terms per (lang, source), as far as memory goes."""

    def __init__(self, shards: int, memory_terms: int, block_postings: int) -> None:
        self.shards, self.memory_terms, self.block_postings = shards, memory_terms, block_postings
        self.counts: dict[tuple[str, str], Counter] = {}
        self.docs: dict[tuple[str, str], Counter] = {}
        self.held = 0

    def add(self, lang: str, source: str, text: bytes) -> None:
        group = lang, source
        if group not in self.counts:
            self.counts[group], self.docs[group] = Counter(), Counter()
        counts, docs, seen = self.counts[group], self.docs[group], set()
        before = len(counts)
        for words in terms_of(text):
            counts.update(words)
            seen.update(words)
        docs.update(seen)
        self.held += len(counts) - before

    @property
    def full(self) -> bool:
        return self.held >= self.memory_terms

    def run(self) -> Iterator[dict]:
        """All postings so far as term-sorted blocks of one shard and language each; memory is empty again."""
        terms, counts, docs, shards, names = [], [], [], [], []
        for (lang, source), counted in self.counts.items():
            seed = zlib.crc32(lang.encode("utf-8", "surrogatepass"))
            names.append((lang, source, len(counted)))
            terms.extend(counted)
            counts.extend(counted.values())
            docs.extend(map(self.docs[lang, source].__getitem__, counted))
            shards.extend([zlib.crc32(term, seed) % self.shards for term in counted])
        self.counts, self.docs, self.held = {}, {}, 0
        sizes = [n for _, _, n in names]
        langs, lang_names = pd.factorize(np.repeat(np.array([g for g, _, _ in names], dtype=object), sizes))
        part = np.array(shards, dtype=np.int64) * max(1, len(lang_names)) + langs
        order = pc.array_sort_indices(pa.array(terms, pa.binary())).to_numpy()
        order = order[np.argsort(part[order], kind="stable")]
        postings = pa.RecordBatch.from_arrays([
            pa.array(terms, pa.binary()), pa.array(np.repeat(np.array([x for _, x, _ in names], dtype=object), sizes), pa.string()),
            pa.array(counts, pa.int64()), pa.array(docs, pa.int64()),
        ], schema=POSTINGS).take(pa.array(order))
        part = part[order]
        edges = np.flatnonzero(np.diff(part, prepend=-1, append=-1))
        for start, stop in zip(edges.tolist(), edges[1:].tolist()):
            for at in range(start, stop, self.block_postings):
                block = postings.slice(at, min(self.block_postings, stop - at))
                yield {
                    "shard": int(part[at]) // len(lang_names), "lang": lang_names[int(part[at]) % len(lang_names)],
                    "first": block.column(0)[0].as_py(), "block": block.serialize().to_pybytes(),
                }


#: What a block holds, serialised.
POSTINGS = pa.schema([("term", pa.binary()), ("source", pa.string()), ("count", pa.int64()), ("docs", pa.int64())])
BLOCK_TYPES = pa.schema([("shard", pa.int32()), ("lang", pa.string()), ("first", pa.binary()), ("block", pa.binary())])
BLOCK = "shard int, lang string, first binary, block binary"


def index_runs(
    rows: DataFrame, shards: int, memory_terms: int = MEMORY_TERMS, block_postings: int = BLOCK_POSTINGS
) -> DataFrame:
    """Blocks of term-sorted runs of ``lang, source, body``, one pass over the texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        postings = Postings(shards, memory_terms, block_postings)

        def spill() -> Iterator[pa.RecordBatch]:
            blocks = postings.run()
            while held := list(islice(blocks, 64)):
                yield pa.RecordBatch.from_pylist(held, schema=BLOCK_TYPES)

        for batch in batches:
            langs, sources, bodies = (batch.column(k) for k in range(3))
            for lang, source, body in zip(langs, sources, bodies):
                postings.add(lang.as_py(), source.as_py(), body.as_py())
                if postings.full:
                    yield from spill()
        if postings.held:
            yield from spill()

    return rows.select("lang", "source", "body").mapInArrow(count, BLOCK)


def below(terms: pa.Array, bound: bytes | None) -> int:
    """How many of the sorted terms come before ``bound``; all without one."""
    if bound is None or terms[len(terms) - 1].as_py() < bound:
        return len(terms)
    return bisect_left(range(len(terms)), bound, key=lambda k: terms[k].as_py())


def merged(blocks: Iterable[pa.RecordBatch], slice_postings: int = SLICE_POSTINGS) -> Iterator[pa.RecordBatch]:
    """Slices of the merge of sorted blocks that come in the order of their first terms.

    A heap holds the open blocks by the first term they have left. A step takes
    the least blocks off it, up to ``slice_postings``, and of these all terms
    before the first term of the block that is then least; what is left of them
    goes back. So a term lies in one slice whole, and slices follow each other
    in term order.
    """
    blocks = iter(blocks)
    coming, opened, heap = next(blocks, None), 0, []
    while heap or coming is not None:
        taken, postings, last = [], 0, None
        while True:
            while coming is not None and (not heap or coming.column(0)[0].as_py() <= heap[0][0]):
                # The number tells blocks with the same term apart, so that blocks are never compared.
                heapq.heappush(heap, (coming.column(0)[0].as_py(), opened, coming))
                coming, opened = next(blocks, None), opened + 1
            if not heap or (postings >= slice_postings and heap[0][0] != last):
                break
            last, _, block = heapq.heappop(heap)
            taken.append(block)
            postings += block.num_rows
        bound = heap[0][0] if heap else None
        parts = []
        for block in taken:
            n = below(block.column(0), bound)
            parts.append(block.slice(0, n))
            if n < block.num_rows:
                heapq.heappush(heap, (block.column(0)[n].as_py(), opened, block.slice(n)))
                opened += 1
        yield pa.concat_batches(parts)


FREQUENCY_TYPES = pa.schema([
    ("lang", pa.string()), ("term", pa.binary()), ("source", pa.string()), ("count", pa.int64()),
    ("total", pa.int64()), ("head", pa.bool_()),
])


def added_up(lang: str, postings: pa.RecordBatch, least_docs: int) -> pa.RecordBatch:
    """Frequencies of the terms of a slice, for those in enough documents."""
    terms, sources = postings.column(0).dictionary_encode(), postings.column(1).dictionary_encode()
    width = len(sources.dictionary)
    term = terms.indices.to_numpy().astype(np.int64)
    key = term * width + sources.indices.to_numpy()
    order = np.argsort(key, kind="stable")
    key = key[order]
    starts = np.flatnonzero(np.diff(key, prepend=-1))
    count, docs = (np.add.reduceat(postings.column(k).to_numpy()[order], starts) for k in (2, 3))
    term, source = key[starts] // width, key[starts] % width
    heads = np.flatnonzero(np.diff(term, prepend=-1))
    rows = np.diff(heads, append=len(term))
    total, documents = (np.repeat(np.add.reduceat(x, heads), rows) for x in (count, docs))
    head = np.zeros(len(term), dtype=bool)
    head[heads] = True
    kept = documents >= least_docs
    return pa.RecordBatch.from_arrays([
        pa.array(np.full(int(kept.sum()), lang, dtype=object), pa.string()), terms.dictionary.take(pa.array(term[kept])),
        sources.dictionary.take(pa.array(source[kept])), pa.array(count[kept]), pa.array(total[kept]), pa.array(head[kept]),
    ], schema=FREQUENCY_TYPES)


def frequencies(runs: DataFrame, shards: int, least_docs: int) -> DataFrame:
    """``lang, term, source, count, total, head`` of terms in at least ``least_docs`` documents of their language.

    ``total`` is the term's count in the language; ``head`` marks one row a term.
    """

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def blocks() -> Iterator[tuple[int, str, pa.Buffer]]:
            for batch in batches:
                for shard, lang, block in zip(batch.column(0), batch.column(1), batch.column(3)):
                    yield shard.as_py(), lang.as_py(), block.as_buffer()

        for (_, lang), of_lang in groupby(blocks(), lambda b: b[:2]):
            opened = (pa.ipc.read_record_batch(pa.py_buffer(block), POSTINGS) for _, _, block in of_lang)
            for postings in merged(opened):
                yield added_up(lang, postings, least_docs)

    dealt = runs.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "lang", "first")
    schema = "lang string, term binary, source string, count bigint, total bigint, head boolean"
    return dealt.mapInArrow(merge, schema)


# ---------------------------------------------------------------- divergence


def share(count: str, total: str, terms: str) -> Column:
    """1 + floor(10^9 * (count + 1) / (total + terms)), exact; null without terms."""
    return F.when(F.col(terms) > 0, F.expr(
        f"1 + (cast({SCALE} as decimal(10)) * cast({count} + 1 as decimal(20))) div cast({total} + {terms} as decimal(20))"
    ))


def divergence(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div {q}")


def gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


PAIR = "lang string, source string, item string, value bigint"


def corrections(priced: DataFrame, memory_pairs: int = MEMORY_PAIRS) -> DataFrame:
    """What pairs of sources gain over the sums that take no term for common, added up per task.

    ``priced`` has ``lang, term, source, p, p0``: a share, and that of a term
    the source lacks. Terms meet whole in a task; a term has a row per source.
    """

    def add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: Counter = Counter()
        for frame in whole_groups(batches, ["lang", "term"]):
            starts = group_starts(frame, ["lang", "term"])
            end = np.repeat(np.append(starts[1:], len(frame)), np.diff(np.append(starts, len(frame))))
            groups, names = pd.factorize(pd.MultiIndex.from_arrays([frame["lang"], frame["source"]]))
            p, p0 = frame["p"].to_numpy(), frame["p0"].to_numpy()
            left, lag = np.arange(len(frame)), 0
            while True:
                lag += 1
                left = left[left + lag < end[left]]
                if not len(left):
                    break
                right = left + lag
                for a, b in ((left, right), (right, left)):
                    more = gap(p[a], p[b]) - gap(p[a], p0[b]) - gap(p0[a], p[b]) + gap(p0[a], p0[b])
                    pairs, at = np.unique(groups[a].astype(np.int64) * len(names) + groups[b], return_inverse=True)
                    totals = np.zeros(len(pairs), dtype=np.int64)
                    np.add.at(totals, at, more)
                    for pair, total in zip(pairs.tolist(), totals.tolist()):
                        (lang, source), (_, item) = names[pair // len(names)], names[pair % len(names)]
                        sums[lang, source, item] += total
                if len(sums) >= memory_pairs:
                    yield rows_of(sums)
                    sums.clear()
        if sums:
            yield rows_of(sums)

    def rows_of(sums: Counter) -> pd.DataFrame:
        return pd.DataFrame([(*pair, value) for pair, value in sums.items()], columns=["lang", "source", "item", "value"])

    met = priced.select("lang", "term", "source", "p", "p0").repartition("lang", "term")
    return met.sortWithinPartitions("lang", "term").mapInPandas(add_up, PAIR)


def pair_values(priced: DataFrame, groups: DataFrame) -> DataFrame:
    """``lang, source, item, value`` of every ordered pair of sources of a language."""
    others = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"), F.col("terms").alias("item_terms"))
    # Neither has the term, for as many terms as are left when the terms of both are taken off.
    absent = F.expr("v - terms - item_terms") * divergence("p0", "q0")
    neither = groups.join(others, "lang").where("source <> item").select(
        "lang", "source", "item", F.when(F.col("v") > 0, absent).otherwise(F.lit(0)).cast("bigint").alias("value")
    )
    # One has the term: its terms by share, against what the other has of a term that it lacks, both ways.
    shares = priced.groupBy("lang", "source", "p").agg(F.count("*").alias("m"))
    dealt = shares.withColumn("part", F.pmod(F.xxhash64("source", "p"), F.lit(SPREAD)).cast("int"))
    copies = others.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    either = dealt.join(copies, ["lang", "part"]).where("source <> item").select("lang", F.inline(F.array(
        F.struct(F.col("source").alias("source"), F.col("item").alias("item"), (F.col("m") * divergence("p", "q0")).alias("value")),
        F.struct(F.col("item").alias("source"), F.col("source").alias("item"), (F.col("m") * divergence("q0", "p")).alias("value")),
    )))
    both = corrections(priced)
    parts = neither.unionByName(either).unionByName(both)
    return parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def source_divergence(
    df: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", least_docs: int = 3, top: int = 200,
    shards: int | None = None, memory_terms: int = MEMORY_TERMS, block_postings: int = BLOCK_POSTINGS,
) -> DataFrame:
    """``lang, source, part, item, value, rank`` of every group (lang, source).

    Part ``pair``: each other source of the language, with f summed over all
    kept terms. Part ``term``: the ``top`` terms that the source has more of
    than its language, with their f.
    """
    if shards is None:
        shards = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(text_of(lang).alias("lang"), text_of(source).alias("source"), text_of(text).cast("binary").alias("body"))
    counted = cut_lineage(frequencies(index_runs(rows, shards, memory_terms, block_postings), shards, least_docs))

    of_lang = counted.groupBy("lang").agg(F.sum("count").alias("lang_n"), F.count_if("head").alias("v"))
    of_group = counted.groupBy("lang", "source").agg(F.sum("count").alias("n"), F.count("*").alias("terms"))
    groups = rows.select("lang", "source").distinct().join(of_group, ["lang", "source"], "left").join(of_lang, "lang", "left")
    groups = groups.na.fill(0, ["n", "terms", "lang_n", "v"]).withColumn("none", F.lit(0).cast("bigint"))
    groups = cut_lineage(groups.withColumn("p0", share("none", "n", "v")).drop("none"))

    priced = counted.join(groups.drop("terms"), ["lang", "source"]).select(
        "lang", "term", "source", share("count", "n", "v").alias("p"), "p0", share("total", "lang_n", "v").alias("q")
    )
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    rank = F.row_number().over(order).alias("rank")
    terms = priced.where("p > q").select("lang", "source", F.col("term").cast("string").alias("item"), divergence("p", "q").alias("value"))
    terms = terms.select("lang", "source", F.lit("term").alias("part"), "item", "value", rank).where(F.col("rank") <= top)
    pairs = pair_values(priced, groups).select("lang", "source", F.lit("pair").alias("part"), "item", "value", rank)
    return pairs.unionByName(terms)
