"""Spelling variants of words: pairs one edit apart, by asymmetric chunks.

Words. Each task counts words in memory and passes its counts on when the map is
full; counts are then added up by word, so a word that fills a third of the text
is one row per task.

Pairs. Of two words one edit apart, the longer one (of equally long ones the
lesser) gives two disjoint chunks, its first and its last q code points, with q
half its length; the other one gives all its positional q-grams that begin
within one place of where a chunk begins in a word of that length. One edit
leaves a chunk whole, so the two meet at a gram equal to a chunk; pairs that meet
are verified code point by code point, and a pair that meets more than once is
passed on at one meeting only: where the first chunk stands in its place, or
else where the last one stands as far from the end.

Sizes. A chunk that many words share is cut into blocks of words on either side,
whose pairs of blocks go to different tasks, so no group is gathered; a block of
pairs passes on, for every word, how many words are near it and the best of
them, never the pairs. Roots are found by joins that double the distance.

Nulls and ties. Null texts have no words. A null id counts as an empty one. Texts
of any length are read in pieces that end between words. Repeated rows count each.
Near words of equal count go by code-point order. An empty table has no words.
Other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from vectext.llm.streams import group_starts, text_of, whole_groups
from vectext.operators.lookups import lookup_join
from vectext.session import cut_lineage

#: Words that a task counts before it passes them on.
MEMORY_WORDS = 500_000
#: Words of one side of a block of pairs.
BLOCK = 1024
#: Pairs that are verified at a time.
PAIRS = 1 << 17
#: Characters of a text that are cut into words at a time.
PIECE = 1 << 20
RUN = re.compile("[a-zÀ-ÿ]+")
#: One in so many runs of a document has a code point deleted.
SLIP = 199
MAX_STEPS = 64


# --------------------------------------------------------------------- words


def runs_of(text: str, size: int = PIECE) -> Iterator[list[str]]:
    """Runs of letters with A-Z lower-cased, piece by piece."""
    # bytes.lower acts on A-Z alone.
    text, at = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"), 0
    while at < len(text):
        end = at + size
        if end < len(text):
            # The piece ends where its last run ends, or with a run that goes on beyond it.
            goes_on = RUN.match(text, end)
            end = goes_on.end() if goes_on else end
        yield RUN.findall(text[at:end])
        at = end


def slipped(doc_id: str, counts: Counter, slip: int | None = SLIP) -> Iterator[tuple[str, int]]:
    """The runs of a document; of those whose hash ``slip`` divides, without one code point."""
    seed = zlib.crc32(f"{doc_id}:".encode())
    for run, n in counts.items():
        if slip is not None:
            h = zlib.crc32(run.encode("utf-8", "surrogatepass"), seed)
            if h % slip == 0:
                cut = h % len(run)
                run = run[:cut] + run[cut + 1:]
        yield run, n


def count_words(
    df: DataFrame, id: str = "doc_id", text: str = "text", least_length: int = 6, least_count: int = 5,
    slip: int | None = SLIP, memory_words: int = MEMORY_WORDS,
) -> DataFrame:
    """``word, n`` of words of at least ``least_length`` code points and ``least_count`` occurrences."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words: Counter = Counter()

        def rows() -> pd.DataFrame:
            out = pd.DataFrame({"word": list(words), "n": np.fromiter(words.values(), dtype=np.int64, count=len(words))})
            words.clear()
            return out

        for batch in batches:
            for doc_id, body in zip(batch["id"], batch["text"]):
                in_doc: Counter = Counter()
                for runs in runs_of(body):
                    in_doc.update(runs)
                for word, n in slipped(doc_id, in_doc, slip):
                    if len(word) >= least_length:
                        words[word] += n
                if len(words) >= memory_words:
                    yield rows()
        if words:
            yield rows()

    docs = df.select(text_of(id).alias("id"), text_of(text).alias("text"))
    counted = docs.mapInPandas(count, "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


# --------------------------------------------------------------------- pairs


def gram(word: Column, at: Column, q: Column) -> Column:
    """``q`` code points from place ``at``, counted from 0."""
    return F.substring(word, at + 1, q)


def meetings(words: DataFrame) -> DataFrame:
    """``length, chunk, gram, side, place, word, n``: where words may meet.

    Side 0 has a word's own two chunks; side 1 its grams at the places that a
    chunk of an equally long word, or of one longer by one, may have moved to.
    """
    size = F.char_length("word")
    sized = words.select("word", "n", size.alias("size"))
    q = F.floor(F.col("size") / 2).cast("int")
    last = F.col("size") - q
    own = F.array(*[
        F.struct(F.col("size").alias("length"), F.lit(c).alias("chunk"), gram(F.col("word"), at, q).alias("gram"),
                 F.lit(0).alias("side"), at.alias("place"))
        for c, at in ((0, F.lit(0)), (1, last))
    ])
    grams = []
    for more in (0, 1):
        length = F.col("size") + more
        of_length = F.floor(length / 2).cast("int")
        for c, at in ((0, F.lit(0)), (1, length - of_length)):
            for shift in (-1, 0, 1):
                place = at + shift
                fits = (place >= 0) & (place + of_length <= F.col("size"))
                grams.append(F.when(fits, F.struct(
                    length.alias("length"), F.lit(c).alias("chunk"), gram(F.col("word"), place, of_length).alias("gram"),
                    F.lit(1).alias("side"), place.alias("place"),
                )))
    every = F.concat(own, F.filter(F.array(*grams), lambda g: g.isNotNull()))
    return sized.select("word", "n", F.inline(every))


def letters(words: np.ndarray) -> np.ndarray:
    """Code points of words, a row a word, filled up with 0."""
    fixed = np.asarray(words, dtype=str)
    return fixed.view(np.uint32).reshape(len(fixed), -1)


def one_edit(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Which rows are one edit apart, with ``a`` as long as ``b`` or longer by one."""
    differ = a != b
    replaced = (size_a == size_b) & (differ.sum(axis=1) == 1)
    # One letter more: equal up to a place, and behind it equal but for the one letter.
    moved = np.zeros_like(differ)
    moved[:, :-1] = a[:, 1:] != b[:, :-1]
    first = np.where(differ.any(axis=1), differ.argmax(axis=1), differ.shape[1])
    tail = np.where(moved.any(axis=1), moved.shape[1] - 1 - moved[:, ::-1].argmax(axis=1), -1)
    return replaced | ((size_a == size_b + 1) & (tail < first))


GROUP = ["length", "chunk", "gram", "a", "b"]
NEAR = "word string, n_near bigint, form string, form_n bigint"


def group_pairs(frame: pd.DataFrame, pairs: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of side 0 with rows of side 1 of the same group, so many pairs at a time. Sides are sorted in groups."""
    starts = group_starts(frame, GROUP)
    group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(frame))))
    side = frame["side"].to_numpy()
    firsts = np.flatnonzero(side == 0)
    seconds = np.flatnonzero(side == 1)
    others = np.bincount(group[seconds], minlength=len(starts))
    begin = np.concatenate(([0], np.cumsum(others)))[:-1]
    each = others[group[firsts]]
    ends = np.cumsum(each)
    total = int(ends[-1]) if len(ends) else 0
    for at in range(0, total, pairs):
        pair = np.arange(at, min(at + pairs, total))
        row = np.searchsorted(ends, pair, side="right")
        left = firsts[row]
        yield left, seconds[begin[group[left]] + pair - (ends[row] - each[row])]


def near_in(frame: pd.DataFrame, pairs: int = PAIRS) -> pd.DataFrame:
    """Per word of a frame of whole groups: how many words are near it there, and the best of them."""
    word, n = frame["word"].to_numpy(dtype=object), frame["n"].to_numpy()
    points = letters(word)
    size = np.array([len(w) for w in word.tolist()])
    length, chunk, place = (frame[c].to_numpy() for c in ("length", "chunk", "place"))
    own, other = [], []
    for left, right in group_pairs(frame, pairs):
        # Of equally long words the lesser has the chunks, so that a pair meets in these roles only.
        roles = (size[left] > size[right]) | (word[left] < word[right])
        # The first chunk in its place; or the last one as far from the end, if the first one is not in its place.
        in_place = place[right] == np.where(chunk[left] == 0, 0, size[right] - length[left] // 2)
        left, right = left[roles & in_place], right[roles & in_place]
        near = one_edit(points[left], points[right], size[left], size[right])
        left, right = left[near], right[near]
        q = length[left] // 2
        same = points[left] == points[right]
        first_whole = (same | (np.arange(points.shape[1]) >= q[:, None])).all(axis=1)
        passed = (chunk[left] == 0) | ~first_whole
        own += [left[passed], right[passed]]
        other += [right[passed], left[passed]]
    if not own:
        return pd.DataFrame({"word": [], "n_near": [], "form": [], "form_n": []})
    own, other = np.concatenate(own), np.concatenate(other)
    # Rows of one word may be many; number the words, then take each one's best: most frequent, then least.
    codes, words = pd.factorize(word)
    counts = np.zeros(len(words), dtype=np.int64)
    counts[codes] = n
    rank = np.empty(len(words), dtype=np.int64)
    rank[np.lexsort((words, -counts))] = np.arange(len(words))
    mine, best = codes[own], rank[codes[other]]
    order = np.lexsort((best, mine))
    heads = np.flatnonzero(np.diff(mine[order], prepend=-1))
    by_rank = np.argsort(rank)
    form = by_rank[best[order][heads]]
    return pd.DataFrame({
        "word": words[mine[order][heads]], "n_near": np.diff(heads, append=len(order)),
        "form": words[form], "form_n": counts[form],
    })


def near_words(words: DataFrame, block: int = BLOCK, pairs: int = PAIRS) -> DataFrame:
    """``word, n_near, form, form_n`` of words with a near word: how many, and the most frequent of them.

    ``words`` has distinct ``word`` of at least two code points, and ``n``.
    """
    key = ["length", "chunk", "gram"]
    met = meetings(words)
    sides = met.groupBy(*key).agg(F.count_if(F.col("side") == 0).alias("n0"), F.count_if(F.col("side") == 1).alias("n1"))
    # A word meets itself; a chunk that meets nothing else is left out here.
    sides = sides.where("n0 > 0 and n1 > 0 and n0 + n1 > 2")
    parts = [F.ceil(F.col(c) / block).cast("int") for c in ("n0", "n1")]
    met = met.join(sides, key).withColumn("parts0", parts[0]).withColumn("parts1", parts[1])

    def own(count: str) -> Column:
        return F.pmod(F.xxhash64("word"), F.col(count)).cast("int")

    def every(count: str) -> Column:
        return F.sequence(F.lit(0), F.col(count) - 1)

    first = F.col("side") == 0
    met = met.withColumn("a", F.explode(F.when(first, F.array(own("parts0"))).otherwise(every("parts0"))))
    met = met.withColumn("b", F.explode(F.when(first, every("parts1")).otherwise(F.array(own("parts1")))))
    met = met.select(*GROUP, "side", "place", "word", "n")
    dealt = met.repartition(*GROUP).sortWithinPartitions(*GROUP, "side")

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in whole_groups(batches, GROUP):
            found = near_in(frame, pairs)
            if len(found):
                yield found

    best = F.struct((-F.col("form_n")).alias("least"), F.col("form"))
    found = dealt.mapInPandas(find, NEAR).groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(best).alias("best"))
    return found.select("word", "n_near", "best.form", (-F.col("best.least")).alias("form_n"))


# ------------------------------------------------------------------ variants


def follow(forms: DataFrame) -> DataFrame:
    """``word, root`` of every word that has a form: where its forms end.

    A step takes every word's target to that one's target, so the distance
    doubles; a form has a larger count than its word, so there are no rings.
    """
    state = cut_lineage(forms.select("word", F.col("form").alias("root")))
    for _ in range(MAX_STEPS):
        onward = state.select(F.col("word").alias("root"), F.col("root").alias("next"))
        stepped = cut_lineage(lookup_join(state, onward, "root", ["word"]))
        if stepped.where(F.col("next").isNotNull()).isEmpty():
            return state
        state = stepped.select("word", F.coalesce("next", "root").alias("root"))
    raise RuntimeError("the forms did not settle")


def spelling_variants(
    df: DataFrame, id: str = "doc_id", text: str = "text", least_length: int = 6, least_count: int = 5,
    times: int = 5, slip: int | None = SLIP, block: int = BLOCK,
) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word.

    A word's form is its most frequent near word if that has at least ``times``
    its count; the root is where forms end, the word itself if it has none.
    """
    if least_length < 2:
        raise ValueError("words have at least two code points")
    if times < 2:
        raise ValueError("a form is at least twice as frequent as its word")
    words = cut_lineage(count_words(df, id, text, least_length, least_count, slip))
    near = words.join(near_words(words, block), "word", "left")
    formed = F.col("form_n") >= F.col("n") * times
    named = cut_lineage(near.select(
        "word", F.when(formed, F.col("form")).alias("form"), "n",
        F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), F.when(formed, F.col("form_n")).alias("form_n"),
    ))
    roots = follow(named.where("form is not null"))
    return named.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
