"""Exact top-k by inner product, over buckets of vectors of like length.

Vectors are ordered by length, longest first, and cut into buckets. The first
bucket is scored in full and gives each query a lower bound of its k-th best
score. Every other bucket turns the bound into a local cosine threshold,
``bound / (|query| * longest)``: over 1, the bucket holds nothing for the query
and neither do those behind it; if it is high, candidates must have the query's
strongest coordinates within the range that such a cosine allows; if it is low,
only candidates long enough to reach the bound are kept. What is left is
verified by exact products. Best lists of all buckets meet in one ranking.

Queries and buckets meet in blocks, of at most ``QUERY_ROWS`` queries and one
bucket, so memory does not grow with the tables.

Components are floor(scale * x), whole numbers held as doubles. Products are
exact: where |query| * |candidate| could pass 2**53 they are taken in Python's
integers (and saturate at the limits of a bigint). Vectors that are null, or
hold a null or non-finite component, take no part; shorter vectors count as
filled up with zeros. Rows are told apart by their place, so repeated ids are
candidates for each other, and a query only misses its own row. Ties go to the
smaller id, null ids last. Extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.functions import pandas_udf

from vectext.operators.index import global_index
from vectext.session import cut_lineage

BUCKET_ROWS = 4096
#: Bucket lengths are known to the driver: buckets grow rather than exceed this number.
MAX_BUCKETS = 100_000
QUERY_ROWS = 2048
#: From this local threshold on, coordinates prune better than lengths.
COORDINATE_COSINE = 0.35
FOCUS = 4
EXACT = 2.0**53
#: Room for rounding in lengths and cosines: pruning must never be too sharp.
SLACK = 1e-9


def usable(vector: Column) -> Column:
    broken = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(broken, F.lit(True))


def whole_components(vector: Column, scale: int) -> Column:
    """floor(scale * x) of every component, as a double."""
    # Beyond 2**53 a double has no fraction to cut.
    def whole(x: Column) -> Column:
        y = x.cast("double") * F.lit(float(scale))
        return F.when(F.abs(y) < EXACT, F.floor(y).cast("double")).otherwise(y)

    return F.transform(vector, whole)


def length_of(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda done, x: done + x * x))


def by_length(df: DataFrame, id: str, vector: str, scale: int) -> DataFrame:
    """``id, v, norm, place``: all usable vectors with their place in order of length, longest first."""
    kept = df.select(F.col(id).alias("id"), F.col(vector).alias("raw")).where(usable(F.col("raw")))
    kept = kept.select("id", whole_components(F.col("raw"), scale).alias("v")).withColumn("norm", length_of(F.col("v")))
    return cut_lineage(global_index(kept, F.col("norm").desc(), F.col("id"), F.xxhash64("v"), out="place"))


def matrix(vectors: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width))
    for k, v in enumerate(vectors):
        out[k, :len(v)] = v
    return out


def products(left: np.ndarray, right: np.ndarray, bound: float) -> np.ndarray:
    """Exact inner products of the rows of ``left`` with those of ``right``."""
    if bound < EXACT:
        return (left @ right.T).astype(np.int64)
    big = np.array([[int(x) for x in row] for row in left], dtype=object) @ np.array(
        [[int(x) for x in row] for row in right], dtype=object
    ).T
    return np.clip(big, -(2**63), 2**63 - 1).astype(np.int64)


def candidates(query: np.ndarray, norm: float, bound: float, units: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """Rows of a bucket, longest first, that may reach ``bound`` with the query."""
    if norm == 0 or bound <= 0 or norms[0] == 0:
        return np.arange(len(norms))
    cosine = bound / (norm * norms[0]) - SLACK
    if cosine > 1:
        return np.empty(0, dtype=np.int64)
    long_enough = int(np.searchsorted(-norms, -(bound / norm) * (1 - SLACK), side="right"))
    if cosine < COORDINATE_COSINE:
        return np.arange(long_enough)
    unit = query / norm
    focus = np.argsort(-np.abs(unit))[:FOCUS]
    left = np.arange(long_enough)
    for f in focus:
        # A unit vector at this cosine or closer has coordinate f in this range.
        spread = math.sqrt(max(0.0, (1 - cosine * cosine) * (1 - unit[f] ** 2))) + SLACK
        low, high = unit[f] * cosine - spread, unit[f] * cosine + spread
        # Closer than the threshold, the range may reach on to the pole of the coordinate.
        if unit[f] >= cosine:
            high = 1 + SLACK
        if -unit[f] >= cosine:
            low = -1 - SLACK
        at = units[left, f]
        left = left[(at >= low) & (at <= high)]
    return left


def best_in_bucket(queries: pd.DataFrame, bucket: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best rows of a bucket for each query, of those that reach the query's bound."""
    bucket = bucket.sort_values("place")
    width = max(max(map(len, queries["v"])), max(map(len, bucket["v"])))
    left, right = matrix(queries["v"], width), matrix(bucket["v"], width)
    norms, places = bucket["norm"].to_numpy(), bucket["place"].to_numpy()
    ids = bucket["id"].to_numpy()
    units = np.divide(right, norms[:, None], out=np.zeros_like(right), where=norms[:, None] > 0)
    order = np.argsort(pd.Series(ids).rank(method="first", na_option="bottom").to_numpy(), kind="stable")
    rank = np.empty(len(ids), dtype=np.int64)
    rank[order] = np.arange(len(ids))
    out = []
    for q, (place, norm, bound) in enumerate(zip(queries["place"], queries["norm"], queries["bound"])):
        rows = np.arange(len(ids)) if bound != bound else candidates(left[q], norm, bound, units, norms)
        if not len(rows):
            continue
        scores = products(left[q:q + 1], right[rows], norm * norms[0])[0]
        keep = places[rows] != place
        if bound == bound:
            keep &= scores >= bound
        rows, scores = rows[keep], scores[keep]
        if len(rows) > k:
            # All that reach the k-th score, so that ties are settled by id.
            least = np.partition(scores, len(scores) - k)[len(scores) - k]
            rows, scores = rows[scores >= least], scores[scores >= least]
        top = np.lexsort((rank[rows], -scores))[:k]
        out.append(pd.DataFrame({"query_place": place, "id": ids[rows[top]], "score": scores[top]}))
    return pd.concat(out) if out else pd.DataFrame(NOTHING)


NOTHING = {"query_place": [], "id": [], "score": []}


def ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_place").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(
    df: DataFrame, is_query: Column, id: str = "vec_id", vector: str = "embedding", k: int = 20, scale: int = 64,
    bucket_rows: int = BUCKET_ROWS, query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """``query_id, rank, id, score`` of the k best rows for every row that ``is_query``."""
    marked = by_length(df, id, vector, scale)
    n = marked.count()
    bucket_rows = max(bucket_rows, math.ceil(n / MAX_BUCKETS))
    vectors = marked.withColumn("bucket", F.floor(F.col("place") / F.lit(bucket_rows)).cast("int"))
    queries = vectors.where(is_query)
    blocks = max(1, math.ceil(queries.count() / query_rows))
    queries = queries.withColumn("block", F.pmod(F.xxhash64("place"), F.lit(blocks)).cast("int"))
    longest = vectors.groupBy("bucket").agg(F.max("norm").alias("norm")).orderBy("bucket").collect()
    lengths = np.array([r["norm"] for r in longest])
    id_type = marked.schema["id"].dataType.simpleString()
    schema = f"query_place bigint, id {id_type}, score bigint"

    def meet(part: DataFrame, rows: DataFrame) -> DataFrame:
        """Blocks of queries with the buckets they name, one task group for each pair."""
        needed = part.groupBy("block", "bucket").agg(F.count("*").alias("queries")).select("block", "bucket")
        sent = rows.join(needed, "bucket").select(*[F.col(c).alias(f"c_{c}") for c in names])
        return part.groupBy("block", "bucket").cogroup(sent.groupBy("c_block", "c_bucket")).applyInPandas(
            lambda a, b: best_in_bucket(a, b.set_axis(names, axis=1), k) if len(a) and len(b) else pd.DataFrame(NOTHING), schema
        )

    columns = ["place", "v", "norm", "bound", "block", "bucket"]
    names = ["id", "v", "norm", "place", "bucket", "block"]
    # The first bucket's number is not a literal here, lest the planner turn the join by it into a cross join.
    opened = F.least("bucket", F.lit(0))
    first = queries.withColumn("bound", F.lit(float("nan"))).withColumn("bucket", opened).select(*columns)
    opening = cut_lineage(meet(first, vectors.where("bucket = 0")))
    bounds = ranked(opening, k).groupBy("query_place").agg(F.count("*").alias("n"), F.min("score").alias("least"))
    bounds = bounds.where(F.col("n") == k).select(F.col("query_place").alias("place"), F.col("least").cast("double").alias("bound"))

    @pandas_udf("int")
    def last_bucket(norm: pd.Series, bound: pd.Series) -> pd.Series:
        # Buckets get shorter: the last one that may hold a vector as long as the bound asks for.
        with np.errstate(divide="ignore", invalid="ignore"):
            need = np.where((bound > 0) & (norm > 0), bound / norm * (1 - SLACK), 0.0)
        need = np.where(np.isnan(need), 0.0, need)
        return pd.Series(np.searchsorted(-lengths, -need, side="right") - 1, dtype="int32")

    later = queries.drop("bucket").join(bounds, "place", "left").withColumn("bound", F.coalesce("bound", F.lit(float("nan"))))
    later = later.withColumn("last", last_bucket("norm", "bound")).where("last >= 1")
    later = later.withColumn("bucket", F.explode(F.sequence(F.lit(1), F.col("last")))).select(*columns)
    found = opening
    if len(lengths) > 1:
        found = opening.unionByName(meet(later, vectors.where("bucket > 0")))
    named = queries.select(F.col("place").alias("query_place"), F.col("id").alias("query_id"))
    best = ranked(found, k).withColumnRenamed("id", "found_id").join(named, "query_place")
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("found_id").alias(id), "score")
