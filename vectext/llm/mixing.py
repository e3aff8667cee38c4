"""Mixing sources to target weights by temperature.

A source's share of tokens, raised to an exponent and normalised, is its
weight: exponent 1 keeps the shares, 0 gives every source the same. The
exponent is found by bisection, as the largest that reaches a target entropy,
or the smallest whose most repeated source stays within a repetition limit.
The weights times a token budget give each source its tokens; a source walks
permutations of its documents, whole passes first, and each step of the budget
(a block) takes the same share from every source, in a permuted order.

Tokens are runs of characters that are not white space, and every document
counts one more for its end, so that empty and null texts have a size too. A
null source is a source of its own. Repeated rows are separate documents with
the same place in the order; ties in the order go by the other columns' hash.
All counts are over all documents. Sources stay a table, however many there
are: the driver sees sums over them, ``AHEAD`` steps of the bisection at once,
and a source's weight or tokens only if asked for them.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window, functions as F

from vectext.llm.streams import free_name, text_of
from vectext.operators.index import group_rank
from vectext.session import cut_lineage

SLICE_ROWS = 4096
#: Reads of one row that are made at once.
TIMES = 65536
STEPS = 80
#: Steps of a bisection whose sums are taken together, 2 ** AHEAD - 1 of them.
AHEAD = 5


@dataclass(frozen=True)
class Mix:
    """Weights of a mixture and the tokens each source gives to a budget."""

    exponent: float
    budget: float
    weights: Mapping[str | None, float]
    tokens: Mapping[str | None, int]

    def allowed(self, source: str | None) -> int:
        return round(self.weights[source] * self.budget)


def tempered(tokens: Mapping, exponent: float) -> dict:
    """Normalised ``share ** exponent``."""
    total = sum(tokens.values())
    raised = {s: (n / total) ** exponent for s, n in tokens.items()}
    norm = sum(raised.values())
    return {s: r / norm for s, r in raised.items()}


def entropy(weights: Mapping) -> float:
    return -sum(w * math.log(w) for w in weights.values() if w > 0)


def middles(low: float, high: float, steps: int) -> list[float]:
    """All points that so many steps of a bisection may look at."""
    if not steps:
        return []
    middle = (low + high) / 2
    return [middle, *middles(low, middle, steps - 1), *middles(middle, high, steps - 1)]


def bisect(
    reached: Callable[[float], bool], low: float = 0.0, high: float = 1.0, prepare: Callable[[list[float]], None] | None = None
) -> float:
    """The border of a condition that holds at ``low`` and may fail at ``high``; ``prepare`` is told the points to come."""
    if reached(high):
        return high
    for step in range(STEPS):
        if prepare is not None and step % AHEAD == 0:
            prepare(middles(low, high, AHEAD))
        middle = (low + high) / 2
        low, high = (middle, high) if reached(middle) else (low, middle)
    return low


class Sizes:
    """What the weights need to know of the tokens of all sources."""

    def __init__(self, sources: int, total: int, least: int, most: int, sums: Callable[[list[float]], dict]) -> None:
        self.sources, self.total, self.least, self.most = sources, total, least, most
        self.sums, self.known = sums, {}

    def prepare(self, exponents: list[float]) -> None:
        """Take the sums of ``share ** exponent``, alone and times the logarithm of the share."""
        self.known = self.sums(exponents)

    def at(self, exponent: float) -> tuple[float, float]:
        if exponent not in self.known:
            self.prepare([exponent])
        return self.known[exponent]

    def entropy(self, exponent: float) -> float:
        norm, logs = self.at(exponent)
        return math.log(norm) - exponent * logs / norm

    def raised(self, tokens: int, exponent: float) -> float:
        return (tokens / self.total) ** exponent

    def whole_pass_budget(self, exponent: float) -> float:
        """The least budget that reads every source at least once: that of the largest one."""
        return self.most / (self.raised(self.most, exponent) / self.at(exponent)[0])

    def passes(self, exponent: float, budget: int | None) -> float:
        """How often the most repeated source is read, which is the smallest one."""
        if budget is None:
            return self.raised(self.least, exponent) / self.least * (self.most / self.raised(self.most, exponent))
        return self.raised(self.least, exponent) / self.at(exponent)[0] * budget / self.least


def sizes_of(tokens: Mapping) -> Sizes:
    counts, total = tokens.values(), sum(tokens.values())

    def sums(exponents: list[float]) -> dict:
        shares = [n / total for n in counts]
        return {a: (sum(s ** a for s in shares), sum(s ** a * math.log(s) for s in shares)) for a in exponents}

    return Sizes(len(tokens), total, min(counts), max(counts), sums)


def sizes_of_table(sources: DataFrame) -> Sizes | None:
    """The sizes of a table of (source, tokens), by aggregates; None if it is empty."""
    whole = sources.agg(
        F.count("*").alias("n"), F.sum(F.col("tokens").cast("decimal(38,0)")).alias("total"),
        F.min("tokens").alias("least"), F.max("tokens").alias("most"),
    ).first()
    if not whole["n"]:
        return None
    total = int(whole["total"])
    # Sources of one size are one row. Decimals add up alike in any order, so weights do not depend on the layout.
    alike: list[DataFrame] = []

    def sums(exponents: list[float]) -> dict:
        if not alike:
            alike.append(cut_lineage(sources.groupBy("tokens").agg(F.count("*").alias("n"))))
        share = F.col("tokens") / F.lit(float(total))
        each = alike[0].select("n", share.alias("share"), F.posexplode(F.array(*map(F.lit, exponents))).alias("k", "a"))
        raised = F.col("n") * F.pow("share", "a")
        found = each.groupBy("k").agg(
            F.sum(raised.cast("decimal(38,22)")).alias("norm"),
            F.sum((raised * F.log("share")).cast("decimal(38,22)")).alias("logs"),
        ).collect()
        return {exponents[r["k"]]: (float(r["norm"]), float(r["logs"])) for r in found}

    return Sizes(whole["n"], total, whole["least"], whole["most"], sums)


class OfSources(Mapping):
    """A column of a table of sources, by source; read to the driver when first asked for."""

    def __init__(self, table: DataFrame, column: str) -> None:
        self.table, self.column = table, column

    @cached_property
    def values_read(self) -> dict:
        return {r["source"]: r[self.column] for r in self.table.select("source", self.column).collect()}

    def __getitem__(self, source: str | None):
        return self.values_read[source]

    def __iter__(self) -> Iterator:
        return iter(self.values_read)

    def __len__(self) -> int:
        return len(self.values_read)


def solve_sizes(
    sizes: Sizes, budget: int | None = None, target_entropy: float | None = None, max_passes: float | None = None
) -> tuple[float, float]:
    """Exponent and budget, as told at :func:`solve`."""
    if target_entropy is not None:
        goal = target_entropy * math.log(sizes.sources)
        exponent = bisect(lambda a: sizes.entropy(a) >= goal - 1e-12, prepare=sizes.prepare)
    else:
        if sizes.passes(1.0, budget) > max_passes + 1e-9:
            raise ValueError(f"no weights keep within {max_passes} passes at this budget")
        ahead = None if budget is None else lambda cuts: sizes.prepare([1.0 - cut for cut in cuts])
        exponent = 1.0 - bisect(lambda cut: sizes.passes(1.0 - cut, budget) <= max_passes + 1e-9, prepare=ahead)
    return exponent, float(sizes.whole_pass_budget(exponent) if budget is None else budget)


def one_target(target_entropy: float | None, max_passes: float | None) -> None:
    if (target_entropy is None) == (max_passes is None):
        raise ValueError("give either target_entropy or max_passes")


def solve(
    tokens: Mapping,
    budget: int | None = None,
    target_entropy: float | None = None,
    max_passes: float | None = None,
) -> Mix:
    """Exponent, weights and budget for one of the two targets.

    ``target_entropy`` is a share of the largest entropy, log(sources). With
    ``budget`` None the budget is the least that reads every document once. A
    limit that no exponent meets (a budget of more passes than allowed) is an
    error, since it could not be kept.
    """
    one_target(target_entropy, max_passes)
    if not tokens:
        return Mix(1.0, 0.0, {}, {})
    exponent, spent = solve_sizes(sizes_of(tokens), budget, target_entropy, max_passes)
    return Mix(exponent, spent, tempered(tokens, exponent), dict(tokens))


def token_count(text: Column) -> Column:
    return (F.regexp_count(text, F.lit(r"\S+")) + 1).cast("bigint")


def solve_table(
    sources: DataFrame, budget: int | None = None, target_entropy: float | None = None, max_passes: float | None = None
) -> tuple[DataFrame, Mix]:
    """As :func:`solve`, of a table of (source, tokens), which gets its ``weight`` and what it is ``allowed``."""
    one_target(target_entropy, max_passes)
    sizes = sizes_of_table(sources)
    exponent, spent, weight = 1.0, 0.0, F.lit(0.0)
    if sizes is not None:
        exponent, spent = solve_sizes(sizes, budget, target_entropy, max_passes)
        weight = F.pow(F.col("tokens") / F.lit(float(sizes.total)), F.lit(exponent)) / F.lit(sizes.at(exponent)[0])
    weighed = sources.withColumn("weight", weight)
    # Rounded as ``Mix.allowed`` rounds, halves to even.
    weighed = weighed.withColumn("allowed", F.rint(F.col("weight") * F.lit(spent)).cast("bigint"))
    return weighed, Mix(exponent, spent, OfSources(weighed, "weight"), OfSources(weighed, "tokens"))


def running_tokens(rows: DataFrame, hash_name: str) -> DataFrame:
    """Tokens before each row in the order of a hash of 63 bits, per (source, pass).

    The hash space is cut into slices of about ``SLICE_ROWS`` rows for the
    largest source, so a source with a third of all rows is summed by many
    tasks; only slice totals are summed along the order.
    """
    largest = rows.groupBy("source", "pass").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 1
    slices = max(1, math.ceil(largest / SLICE_ROWS))
    sliced = rows.withColumn("slice", F.floor(F.col(hash_name) / F.lit(2.0**63) * slices).cast("int"))
    totals = sliced.groupBy("source", "pass", "slice").agg(F.sum("tokens").alias("slice_tokens"))
    ahead = Window.partitionBy("source", "pass").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("ahead", F.coalesce(F.sum("slice_tokens").over(ahead), F.lit(0))).drop("slice_tokens")
    # Joined null-safe: a null source is a source.
    totals = totals.select(*[F.col(c).alias(f"t_{c}") for c in totals.columns])
    same = F.col("source").eqNullSafe(F.col("t_source")) & (F.col("pass") == F.col("t_pass")) & (F.col("slice") == F.col("t_slice"))
    inside = (
        Window.partitionBy("source", "pass", "slice").orderBy(hash_name, "tie")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        sliced.withColumn("inside", F.coalesce(F.sum("tokens").over(inside), F.lit(0)))
        .join(totals, same)
        .withColumn("before", (F.col("t_ahead") + F.col("inside")).cast("bigint"))
        .drop("slice", "inside", "t_source", "t_pass", "t_slice", "t_ahead")
    )


def mix_sources(
    df: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    budget: int | None = None,
    target_entropy: float | None = None,
    max_passes: float | None = None,
    block_tokens: int = 1_000_000,
    seed: int = 0,
) -> tuple[DataFrame, Mix]:
    """The mixture as ``id, source, tokens, pass, block, place`` and its weights.

    A source that is allowed ``m`` tokens gives ``m // size`` whole passes over
    its documents and the documents of one more pass that begin before the rest
    is used up, each pass in a new permutation. A document whose first token is
    token t of its source's walk falls into block ``t // (weight * block)``,
    and ``place`` is its rank in the permuted block.
    """
    body = text_of(text)
    sized = cut_lineage(df.select(
        F.col(id).alias("id"), F.col(source).cast("string").alias("source"),
        token_count(body).alias("tokens"), F.xxhash64(body).alias("tie"),
    ))
    sources = cut_lineage(sized.groupBy("source").agg(F.sum("tokens").cast("bigint").alias("tokens")))
    weighed, mix = solve_table(sources, budget, target_entropy, max_passes)
    plan = weighed.select(
        F.col("source").alias("plan_source"), "allowed", F.col("tokens").alias("size"),
        F.greatest(F.col("weight") * F.lit(float(block_tokens)), F.lit(1.0)).alias("block_share"),
    )
    # As many rows as sources: Spark broadcasts them if they are few, and splits a hot source's rows if not.
    matched = sized.join(plan, F.col("source").eqNullSafe(F.col("plan_source"))).drop("plan_source")
    passes = F.floor((F.col("allowed") - 1) / F.col("size")) + 1
    most = plan.where("allowed > 0").agg(F.max(passes)).first()[0] or 0
    walks = repeated(matched.where("allowed > 0"), passes, "pass", most)
    walks = walks.withColumn("order", F.shiftrightunsigned(F.xxhash64(F.lit(seed), "pass", "id", "tie"), 1))
    walks = running_tokens(walks, "order")
    walks = walks.withColumn("first", F.col("pass") * F.col("size") + F.col("before")).where("first < allowed")
    walks = walks.withColumn("block", F.floor(F.col("first") / F.col("block_share")).cast("bigint"))
    inside = Window.partitionBy("block").orderBy("shuffle", "id", "tie", "pass")
    placed = walks.withColumn("shuffle", F.xxhash64(F.lit(seed + 1), "block", "id", "tie", "pass"))
    placed = placed.withColumn("place", (F.row_number().over(inside) - 1).cast("bigint"))
    return placed.select(
        F.col("id").alias(id), F.col("source").alias(source), "tokens", "pass", "block", "place", F.col("tie").alias("text_hash")
    ), mix


def repeated(df: DataFrame, times: Column, out: str, most: int) -> DataFrame:
    """Every row ``times`` over, numbered from 0 in ``out``; ``most`` is the largest number.

    Rows that repeat often are made in two steps, blocks of ``TIMES`` first, which
    are spread over the tasks: neither an array nor a task holds all of them.
    """
    if most <= TIMES:
        return df.withColumn(out, F.explode(F.sequence(F.lit(0).cast("bigint"), times - 1)))
    n, block = free_name(df, "_times"), free_name(df, "_block")
    blocks = df.withColumn(n, times).withColumn(block, F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col(n) - 1) / TIMES))))
    first = F.col(block) * TIMES
    numbers = F.sequence(first, F.least(first + TIMES, F.col(n)) - 1)
    return blocks.repartition(n, block, *df.columns[:1]).withColumn(out, F.explode(numbers)).drop(n, block)


def mixed_rows(df: DataFrame, places: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df`` as often as the mixture reads them, all columns kept.

    Rows repeated in id and text share their reads, one more to the first of them
    where the number does not divide.
    """
    names = ("_row_hash", "_mix_id", "_mix_hash", "_mix_n", "_copies", "_at", "_of_at", "_rank")
    row_hash, mix_id, mix_hash, n, copies, at, of_at, place = (free_name(df, c) for c in names)
    same = F.col(id).eqNullSafe(F.col(mix_id)) & (F.col(row_hash) == F.col(mix_hash))
    keyed = df.withColumn(row_hash, F.xxhash64(text_of(text)))
    reads = places.groupBy(F.col(id).alias(mix_id), F.col("text_hash").alias(mix_hash)).agg(F.count("*").alias(n))
    rows = keyed.groupBy(F.col(id).alias("_of_id"), F.col(row_hash).alias("_of_hash")).agg(F.count("*").alias(copies))
    of = F.col(mix_id).eqNullSafe(F.col("_of_id")) & (F.col(mix_hash) == F.col("_of_hash"))
    each = cut_lineage(reads.join(rows, of).select(mix_id, mix_hash, n, copies))
    single = keyed.join(each.where(F.col(copies) == 1), same)
    if not each.where(F.col(copies) > 1).isEmpty():
        alike = keyed.join(each.where(F.col(copies) > 1), same)
        alike = cut_lineage(alike.withColumn(at, F.monotonically_increasing_id()))
        rank = group_rank(alike.select(mix_id, mix_hash, at), at, [mix_id, mix_hash], out=place)
        rank = rank.select(F.col(at).alias(of_at), place)
        share = F.floor(F.col(n) / F.col(copies)) + (F.col(place) < F.col(n) % F.col(copies)).cast("bigint")
        alike = alike.join(rank, F.col(at) == F.col(of_at)).withColumn(n, share).where(F.col(n) > 0)
        single = single.unionByName(alike.select(*single.columns))
    most = each.agg(F.max(n)).first()[0] or 0
    return repeated(single, F.col(n), at, most).select(*df.columns)
