"""SimHash groups against all pairs."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from vectext.llm import components, simhash


def plain_fingerprint(text, width=3):
    words, word = [], b""
    for byte in (text or "").encode() + b" ":
        if byte == 0x20 or 0x09 <= byte <= 0x0D:
            words, word = words + [word] if word else words, b""
        else:
            word += bytes([byte + 32 if 65 <= byte <= 90 else byte])
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(items, linked):
    """Least member of each item's set, by all pairs."""
    root = {i: i for i in items}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in items:
        for b in items:
            if a < b and linked(a, b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in items}


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def test_fingerprints(spark):
    texts = [None, "", " \t\n", "one", "one two", "ONE  two", "É é x", "a\x0bb\x1fc d", "the cat sat on the mat " * 3, "w " * 70_000]
    texts += [" ".join(random.Random(k).choices("abcde", k=k)) for k in range(1, 40)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = df.select("text", simhash.hex_digits(simhash.fingerprint("text")).alias("f")).collect()
    assert [r["f"] for r in got] == [f"{plain_fingerprint(r['text']):016x}" for r in got]


@pytest.mark.parametrize("distance", [0, 1, 2, 3, 5])
@pytest.mark.parametrize("block", [4, 1024])
def test_links_against_all_pairs(spark, distance, block):
    rnd = random.Random(distance)
    prints = {0, 2**64 - 1}
    for _ in range(25):  # chains of near fingerprints, so groups are wider than the limit
        x = rnd.getrandbits(64)
        for _ in range(rnd.choice((1, 2, 6))):
            prints.add(x)
            for bit in rnd.sample(range(64), rnd.randint(1, distance + 2)):
                x ^= 1 << bit
    near = rnd.getrandbits(64)
    prints |= {near ^ (1 << a) ^ (1 << b) for a in range(0, 64, 5) for b in range(0, 64, 7)}
    df = spark.createDataFrame([(signed(p),) for p in prints], "fingerprint bigint")
    found = simhash.links(df, distance, block).collect()
    for r in found:
        assert (r["u"] ^ r["v"]).bit_count() <= distance or bin((r["u"] ^ r["v"]) & (2**64 - 1)).count("1") <= distance
    items = sorted(signed(p) for p in prints)
    want = roots(items, lambda a, b: bin((a ^ b) & (2**64 - 1)).count("1") <= distance)
    got = {r["node"]: r["root"] for r in components.connected(simhash.links(df, distance, block)).collect()}
    assert {i: got.get(i, i) for i in items} == want


def test_no_pair_is_emitted_twice_over(spark):
    """A dense group gives a forest per key, not all pairs."""
    base = 0x0123456789ABCDEF
    prints = {signed(base ^ (1 << a) ^ (1 << b)) for a in range(64) for b in range(64)}
    df = spark.createDataFrame([(p,) for p in prints], "fingerprint bigint")
    assert simhash.links(df, 3).count() < 9 * len(prints) < len(prints) ** 2 / 50


def test_chain_budgets():
    x = np.array([0b1, 0x1_0000_0001, 0x3_0000, 0x1_0001_0000], dtype=np.uint64)
    # The start segment must be equal, the next may differ in one bit, the next two in two.
    assert simhash.chain_holds(x, np.array([1, 1, 0, 0]), 3).tolist() == [True, True, False, True]
    assert simhash.chain_holds(x, np.array([0, 0, 2, 1]), 3).tolist() == [False, False, True, False]


def test_near_duplicates(spark):
    rnd = random.Random(5)
    words = [f"w{k}" for k in range(400)]
    rows = []
    for doc in range(40):
        text = rnd.choices(words, k=rnd.randint(200, 400))
        for copy in range(rnd.choice((1, 1, 3))):
            changed = list(text)
            for _ in range(copy):
                changed[rnd.randrange(len(changed))] = "changed"
            rows.append((len(rows), " ".join(changed)))
    rows += [(900, None), (901, ""), (902, "  "), (None, "same words here"), (903, "same words here"), (None, "nobody else"), (903, "same words here")]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("fingerprint", F.lit("x"))
    got = simhash.near_duplicates(df).collect()
    assert len(got) == len(rows)
    prints = sorted({plain_fingerprint(t) for _, t in rows})
    root = roots(prints, lambda a, b: (a ^ b).bit_count() <= 3)
    least = {}
    for doc_id, text in rows:
        group = root[plain_fingerprint(text)]
        least[group] = min([i for i in (doc_id, least.get(group)) if i is not None], default=None)
    want = sorted((repr(i), f"{plain_fingerprint(t):016x}", repr(least[root[plain_fingerprint(t)]])) for i, t in rows)
    assert sorted((repr(r["doc_id"]), r["fingerprint"], repr(r["component_id"])) for r in got) == want
    kept = simhash.drop_near_duplicates(df)
    assert kept.columns == df.columns
    ids = [r["doc_id"] for r in kept.collect()]
    # A row repeated in id and text stays together, hence 903 twice.
    assert sorted(map(repr, ids)) == sorted(map(repr, [*least.values(), 903]))


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert simhash.near_duplicates(none).count() == 0 and simhash.drop_near_duplicates(none).count() == 0


@pytest.mark.parametrize("share", [200_000, 20])
def test_long_chain(spark, monkeypatch, share):
    """All links in one task, and in many, of which each sees a part of the chain."""
    monkeypatch.setattr(components, "SHARE_LINKS", share)
    edges = spark.range(0, 300, 1, 12).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    got = components.connected(edges.repartition(12, F.rand(1)))
    assert got.count() == 301 and got.agg(F.max("root")).first()[0] == 0


@pytest.mark.parametrize("pairs", [[(1, 3), (2, 3)], [(1, 2), (2, 3)], [(1, 2), (4, 6), (5, 6), (7, 8)]])
def test_links_of_one_set_in_different_shares(spark, monkeypatch, pairs):
    """No share changes anything by itself, so only star steps can join the set."""
    monkeypatch.setattr(components, "SHARE_LINKS", 1)
    edges = spark.createDataFrame(spark.sparkContext.parallelize(pairs, len(pairs)), "u bigint, v bigint")
    items = sorted({node for pair in pairs for node in pair})
    want = roots(items, lambda a, b: (a, b) in pairs)
    assert sorted(components.connected(edges).collect()) == sorted(want.items())


def test_stars_of_no_links(spark):
    assert components.connected(spark.range(0).select(F.col("id").alias("u"), F.col("id").alias("v"))).count() == 0
