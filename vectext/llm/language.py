"""Language identification by prediction by partial matching.

Each language has a tree of byte contexts up to ``order`` bytes deep, counted
on a bounded sample of labelled texts and then frozen. The code length of a byte
is taken from the longest context the language has seen there: a byte seen in
that context ``c`` times out of ``n``, with ``q`` different bytes, costs
``-log2(c / (n + q))`` bits; another one costs the escape, ``-log2(q / (n + q))``,
and its code length in the next shorter context, down to eight bits where
nothing is known. A text's language is the one that codes all its bytes, in
lower case, in the fewest bits; the score is that language's share of
``2 ** -bits`` over all languages.

As the statistics are frozen, a run of ``order`` + 1 bytes has one code length per
language. Texts are scored in windows of at most ``WINDOW`` bytes: the distinct runs
of a window are looked up in each language's sorted contexts, from the deepest
down, and the code lengths are added up per text. A text of any length is scored
whole, in as many windows as it needs.

The model is the counts, bounded by ``languages * sample_docs`` texts: 8 bytes for
each distinct run of a language at the driver, and 8 for each distinct run of each
depth in a worker. There may be any number of languages; the model is broadcast, so
a label column must hold languages, not a value per row.

Null texts and texts without a letter are ``und`` with score 0, as is every
text if there is nothing to learn from. Ties go to the first name in order.
Repeated rows are predicted alike; rows without id or label are predicted too,
the latter are just not learned from. An empty table gives an empty result. A
column of the name of ``out`` is an error; all other columns stay as they are.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.functions import pandas_udf

from vectext.session import cut_lineage

UNKNOWN = "und"
ORDER = 3
#: Labelled texts learned from, per language.
SAMPLE_DOCS = 300
WINDOW = 1 << 20
LETTER = regex.compile(r"\p{L}")
START = b"\n" * ORDER


def text_bytes(text: str) -> np.ndarray:
    return np.frombuffer(START + text.lower().encode("utf-8", "surrogatepass"), dtype=np.uint8)


@dataclass
class Counts:
    """How often each run of ``ORDER`` + 1 bytes was seen, per language."""

    grams: dict[str, np.ndarray]
    counts: dict[str, np.ndarray]
    key: str = field(default_factory=lambda: uuid.uuid4().hex)


def sample(labelled: DataFrame, docs: int) -> DataFrame:
    """At most ``docs`` rows per language, those of the least hash: the same in any layout.

    A first cut by hash keeps a few times as many, so that ranking never
    gathers a frequent language in one task.
    """
    totals = labelled.groupBy(F.col("lang").alias("of_lang")).agg(F.count("*").alias("n"))
    # Written, so that its size is known: a small table is sent to the texts, which then stay where they are.
    shares = cut_lineage(totals.select("of_lang", F.least(F.lit(1.0), F.lit(4.0 * docs) / F.col("n")).alias("share")))
    hashed = labelled.withColumn("order", F.xxhash64("id")).join(shares, F.col("lang") == F.col("of_lang"))
    near = hashed.where(F.shiftrightunsigned("order", 1) / F.lit(2.0**63) <= F.col("share"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("order", F.xxhash64("text")))
    return near.withColumn("rank", rank).where(F.col("rank") <= docs).select("lang", "text")


def count_grams(texts: DataFrame) -> Counts:
    """Counts of the sample, made in tasks; what the driver gets is bounded by the sample."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"]):
                grams, n = np.unique(windows(text_bytes(text)), return_counts=True)
                yield pd.DataFrame({"lang": lang, "gram": grams.view(np.int32), "n": n})

    rows = texts.mapInPandas(count, "lang string, gram int, n bigint").groupBy("lang", "gram").agg(F.sum("n").cast("int").alias("n"))
    # One row per language; its runs are bounded by the sample.
    runs = F.collect_list(F.struct("gram", "n")).alias("runs")
    frame = rows.groupBy("lang").agg(runs).select("lang", "runs.gram", "runs.n").toPandas()
    grams = {lang: np.asarray(gram, dtype=np.int32).view(np.uint32) for lang, gram in zip(frame["lang"], frame["gram"])}
    counts = {lang: np.asarray(n, dtype=np.int64) for lang, n in zip(frame["lang"], frame["n"])}
    return Counts(grams, counts)


def windows(letters: np.ndarray) -> np.ndarray:
    """Each byte with the ``ORDER`` bytes before it, as one number; the byte itself is lowest."""
    n = max(len(letters) - ORDER, 0)
    out = np.zeros(n, dtype=np.uint32)
    for k in range(ORDER + 1):
        out = out << np.uint32(8) | letters[k:k + n]
    return out


def last_bytes(grams: np.ndarray, count: int) -> np.ndarray:
    return grams & np.uint32(256**count - 1)


def found_in(known: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``asked`` in the sorted ``known``, and which of them are there."""
    at = np.minimum(np.searchsorted(known, asked), max(len(known) - 1, 0))
    return at, known[at] == asked if len(known) else np.zeros(len(asked), dtype=bool)


class Tree:
    """One language's contexts: per depth the known runs with their code lengths, and the contexts with their escapes."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray) -> None:
        self.depths = []
        for depth in range(ORDER + 1):
            runs, place = np.unique(last_bytes(grams, depth + 1), return_inverse=True)
            seen = np.bincount(place, weights=counts, minlength=len(runs))
            contexts, of = np.unique(runs >> np.uint32(8), return_inverse=True)
            total = np.bincount(of, weights=seen, minlength=len(contexts))
            kinds = np.bincount(of, minlength=len(contexts))
            bits = np.log2((total + kinds)[of] / seen)
            escapes = np.log2((total + kinds) / kinds)
            self.depths.append((runs, bits.astype(np.float32), contexts, escapes.astype(np.float32)))

    def bits(self, grams: np.ndarray) -> np.ndarray:
        """Code length of the last byte of each run, from its longest known context down."""
        cost = np.zeros(len(grams))
        left = np.arange(len(grams))
        for depth in range(ORDER, -1, -1):
            runs, bits, contexts, escapes = self.depths[depth]
            asked = last_bytes(grams[left], depth + 1)
            at, known = found_in(runs, asked)
            cost[left[known]] += bits[at[known]]
            left, asked = left[~known], asked[~known]
            at, known = found_in(contexts, asked >> np.uint32(8))
            cost[left[known]] += escapes[at[known]]
        cost[left] += 8.0
        return cost


class Model:
    """The languages of some counts, ready to score."""

    def __init__(self, counts: Counts) -> None:
        self.names = sorted(counts.grams)
        self.trees = [Tree(counts.grams[n], counts.counts[n]) for n in self.names]

    def bits(self, texts: Sequence[str]) -> np.ndarray:
        """Code length of each whole text in each language."""
        total = np.zeros((len(texts), len(self.trees)))
        held: list[np.ndarray] = []
        owners: list[int] = []
        size = 0
        for k, text in enumerate(texts):
            letters = text_bytes(text)
            for at in range(0, len(letters) - ORDER, WINDOW):
                held.append(windows(letters[at:at + WINDOW + ORDER]))
                owners.append(k)
                size += len(held[-1])
                if size >= WINDOW:
                    self.add(held, owners, total)
                    held, owners, size = [], [], 0
        if held:
            self.add(held, owners, total)
        return total

    def add(self, held: list[np.ndarray], owners: list[int], total: np.ndarray) -> None:
        runs, place = np.unique(np.concatenate(held), return_inverse=True)
        piece = np.repeat(np.arange(len(held)), [len(h) for h in held])
        for k, tree in enumerate(self.trees):
            bits = np.bincount(piece, weights=tree.bits(runs)[place], minlength=len(held))
            np.add.at(total[:, k], owners, bits)

    def predict(self, texts: Sequence[str | None]) -> list[tuple[str, float]]:
        out = [(UNKNOWN, 0.0)] * len(texts)
        known = [k for k, t in enumerate(texts) if self.trees and t is not None and LETTER.search(t)]
        for k, bits in zip(known, self.bits([texts[k] for k in known])):
            best = int(np.argmin(bits))
            out[k] = (self.names[best], float(1 / np.exp2(np.maximum(bits[best] - bits, -1000)).sum()))
        return out


MODELS: dict[str, Model] = {}


def model_of(counts: Counts) -> Model:
    """The worker's model of these counts, built once."""
    if counts.key not in MODELS:
        MODELS.clear()
        MODELS[counts.key] = Model(counts)
    return MODELS[counts.key]


def learn(labelled: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", sample_docs: int = SAMPLE_DOCS) -> Counts:
    """Frozen counts from rows with a text and a label."""
    rows = labelled.select(F.col(id).alias("id"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    return count_grams(sample(rows.where("text IS NOT NULL AND lang IS NOT NULL"), sample_docs))


def predict_language(df: DataFrame, counts: Counts, text: str = "text", out: str = "predicted") -> DataFrame:
    """Adds a struct (lang_pred, score); all other columns stay where they are."""
    if out.lower() in {c.lower() for c in df.columns}:
        raise ValueError(f"there is a column {out!r}; name another with out=")
    shared = df.sparkSession.sparkContext.broadcast(counts)

    @pandas_udf("lang_pred string, score double")
    def predicted(texts: pd.Series) -> pd.DataFrame:
        model = model_of(shared.value)
        return pd.DataFrame(model.predict(list(texts)), columns=["lang_pred", "score"])

    return df.withColumn(out, predicted(F.col(text)))
