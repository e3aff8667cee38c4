"""Text quality by the votes of nearest labelled neighbours in a latent space.

Terms are the shapes of a text: runs of three letters of an alphabet of 16
character classes, a class at most twice in a row, and words that repeat the
word, or the two words, before. A text's term vector is ``log(1 + count) * idf``, with document
frequencies of all documents. The latent space is the leading right singular
vectors of the labelled sample's term vectors; labelled rows and documents are
projected into it and scaled to length 1.

Every document's cosine with every labelled row is computed, block by block,
and the nearest ``NEIGHBOURS`` vote with weight cosine ** ``SHARPNESS``; the
score is the weighted share of votes for label 1.

Learned from: a sample of at most ``sample_rows`` labelled rows, those of the
least hash of their id, in the same proportion as the labels have. It and the
projection are the broadcast model, at most ``4 * (TERMS + sample_rows) * DIMS``
bytes. Labels, language, source and id are no inputs of a score.

Null texts count as empty. Texts without any term, and those with no neighbour
on their side, get the sample's share of label 1. Without labels nothing can be
rejected and every score is 1. Ids labelled twice are learned once per label
row; a null id or label is not learned from. Ties among equally near neighbours
at the border go to the row of lower hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import and_, eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from vectext.llm.streams import text_of

SAMPLE_ROWS = 3000
DIMS = 64
NEIGHBOURS = 25
SHARPNESS = 8
DOCS = 256
CLASSES = 16
REPEATED = CLASSES**3
TERMS = REPEATED + 2


def byte_classes() -> np.ndarray:
    """Class of each byte: letters, digits, blanks, and the marks that tell texts apart; 15 is anything else."""
    table = np.full(256, 15, dtype=np.int64)
    for k, members in enumerate((
        b"abcdefghijklmnopqrstuvwxyz" + bytes(range(128, 256)), b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r",
        b".", b",", b"!?", b"|", b"*", b"%", b"&", b"$", b"#@", b";:'\"()-",
    )):
        table[list(members)] = k
    return table


BYTE_CLASS = byte_classes()


def term_counts(text: str) -> np.ndarray:
    """Count of every term in the whole text."""
    data = text.encode("utf-8", "surrogatepass")
    classes = BYTE_CLASS[np.frombuffer(data, dtype=np.uint8)]
    if len(classes) > 2:
        third = (classes[2:] == classes[1:-1]) & (classes[1:-1] == classes[:-2])
        classes = classes[np.concatenate(([True, True], ~third))]
    grams = (classes[:-2] * CLASSES + classes[1:-1]) * CLASSES + classes[2:]
    counts = np.bincount(grams, minlength=TERMS)
    words = data.split()
    again = list(map(eq, words, words[1:]))
    counts[REPEATED] = sum(again)
    counts[REPEATED + 1] = sum(map(and_, again, again[1:]))
    return counts


def document_frequencies(df: DataFrame, text: str = "text") -> tuple[np.ndarray, int]:
    """In how many of all documents each term occurs, and how many documents there are."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found, rows = np.zeros(TERMS, dtype=np.int64), 0
        for batch in batches:
            for body in batch["body"]:
                found += term_counts(body) > 0
            rows += len(batch)
        terms = np.flatnonzero(found)
        yield pd.DataFrame({"term": np.append(terms, -1), "n": np.append(found[terms], rows)})

    counted = df.select(text_of(text).alias("body")).mapInPandas(count, "term int, n bigint")
    totals = counted.groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    known = totals[totals["term"] >= 0]
    frequencies = np.zeros(TERMS, dtype=np.int64)
    frequencies[known["term"].to_numpy()] = known["n"].to_numpy()
    return frequencies, int(totals.loc[totals["term"] == -1, "n"].sum())


@dataclass
class Votes:
    """The frozen classifier: term weights, projection, labelled vectors and labels."""

    idf: np.ndarray
    projection: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    def weighted(self, counts: np.ndarray) -> np.ndarray:
        x = np.log1p(counts).astype(np.float32) * self.idf
        return unit(x)

    def scores(self, counts: np.ndarray) -> np.ndarray:
        """Scores of a block of term counts."""
        if not len(self.labels):
            return np.ones(len(counts))
        near = unit(self.weighted(counts) @ self.projection) @ self.vectors.T
        k = min(NEIGHBOURS, len(self.labels))
        best = nearest(near, k)
        cosines = np.clip(np.take_along_axis(near, best, axis=1).astype(np.float64), 0, 1)
        weights = cosines**SHARPNESS
        total = weights.sum(axis=1)
        share = self.labels.mean()
        with np.errstate(invalid="ignore", divide="ignore"):
            votes = (weights * self.labels[best]).sum(axis=1) / total
        return np.where(total > 0, votes, share)


def nearest(cosines: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest cosines of each row; of equal ones at the border, the first."""
    least = np.partition(cosines, -k, axis=1)[:, -k][:, None]
    above, level = cosines > least, cosines == least
    level &= np.cumsum(level, axis=1) <= k - above.sum(axis=1, keepdims=True)
    return np.nonzero(above | level)[1].reshape(len(cosines), k)


def unit(x: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, length, out=np.zeros_like(x), where=length > 0)


def latent_axes(x: np.ndarray, dims: int) -> np.ndarray:
    """Leading right singular vectors, by subspace iteration from a fixed start."""
    basis = np.random.default_rng(0).standard_normal((x.shape[1], min(2 * dims, *x.shape))).astype(np.float32)
    for _ in range(6):
        basis, _ = np.linalg.qr(x.T @ (x @ basis))
    _, _, turn = np.linalg.svd(x @ basis, full_matrices=False)
    return np.ascontiguousarray((basis @ turn.T)[:, :dims])


def learn(
    docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "quality",
    sample_rows: int = SAMPLE_ROWS,
) -> Votes:
    """The classifier from labelled rows (``labels`` holds those to learn from) and all documents."""
    known = labels.select(F.col(id).alias("id"), F.col(label).cast("int").alias("label")).where("id IS NOT NULL AND label IS NOT NULL")
    chosen = known.orderBy(F.xxhash64("id"), "id", "label").limit(sample_rows)

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [term_counts(body) for body in batch["body"]]
            terms = [np.flatnonzero(r) for r in rows]
            yield pd.DataFrame({
                "order": batch["order"], "label": batch["label"],
                "terms": [t.astype(np.int32) for t in terms], "counts": [r[t].astype(np.int32) for r, t in zip(rows, terms)],
            })

    texts = docs.select(F.col(id).alias("id"), text_of(text).alias("body"))
    # At most sample_rows rows, so they may be broadcast.
    found = texts.join(F.broadcast(chosen), "id").select("body", "label", F.xxhash64("id").alias("order"))
    # Ids may repeat in the documents: the bound holds for what is learned as well.
    found = found.orderBy("order", F.xxhash64("body"), "label").limit(sample_rows)
    rows = found.mapInPandas(counted, "order bigint, label int, terms array<int>, counts array<int>").toPandas()
    frequencies, documents = document_frequencies(docs, text)
    idf = np.log((1 + documents) / (1 + frequencies)).astype(np.float32)
    rows = rows.sort_values("order", kind="stable")
    counts = np.zeros((len(rows), TERMS), dtype=np.int32)
    for k, (terms, n) in enumerate(zip(rows["terms"], rows["counts"])):
        counts[k, np.asarray(terms, dtype=np.int64)] = n
    votes = Votes(idf, np.zeros((TERMS, 0), np.float32), np.zeros((0, 0), np.float32), rows["label"].to_numpy().astype(np.float64))
    if not len(rows):
        return votes
    x = votes.weighted(counts)
    votes.projection = latent_axes(x, DIMS)
    votes.vectors = unit(x @ votes.projection)
    return votes


def with_quality(df: DataFrame, votes: Votes, text: str = "text", out: str = "score") -> DataFrame:
    """Adds every document's score; other columns stay where they are."""
    shared = df.sparkSession.sparkContext.broadcast(votes)

    @pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        model = shared.value
        parts = []
        for at in range(0, len(texts), DOCS):
            counts = np.stack([term_counts(t) for t in texts.iloc[at:at + DOCS]])
            parts.append(model.scores(counts))
        return pd.Series(np.concatenate(parts) if parts else np.empty(0))

    return df.withColumn(out, score(text_of(text)))
