"""Token expressions. A token is a run of characters that are not white space."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from vectext import fixed_values as fx
from vectext.functions.keys import hash_number, keyed_hash
from vectext.functions.lets import let


def tokens(text: Column, max_length: int | None = None) -> Column:
    found = F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0))
    return found if max_length is None else F.slice(found, 1, max_length)


def token_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\S+"))


def candidate_positions(
    toks: Column, specials: Sequence[str] = (), min_position: int = fx.MIN_POSITION
) -> Column:
    """Positions from ``min_position`` on whose token is not special."""

    def scan(t: Column) -> Column:
        n = F.size(t)
        span = F.when(n > min_position, F.sequence(F.lit(min_position), n - 1))
        span = F.coalesce(span, F.array().cast("array<int>"))
        if not specials:
            return span
        return F.filter(span, lambda i: ~F.get(t, i).isin(list(specials)))

    return let(toks, scan)


def keyed_picks(n: Column, k: int, seed: int, key: Column) -> Column:
    """``min(k, n)`` distinct numbers below ``n``, drawn by hashes of (seed, key).

    Draws without replacement in k steps, so cost does not grow with ``n`` and
    the picks depend on nothing but (seed, key, n, k).
    """
    size = F.least(F.lit(k).cast("bigint"), n.cast("bigint"))

    def draw(picked: Column, step: Column) -> Column:
        top = n.cast("bigint") - size + step
        pick = F.pmod(hash_number(keyed_hash(seed, key, step)), top + 1)
        return F.array_append(picked, F.when(F.array_contains(picked, pick), top).otherwise(pick))

    none = F.array().cast("array<bigint>")
    steps = F.when(size > 0, F.sequence(F.lit(0).cast("bigint"), size - 1)).otherwise(none)
    return F.aggregate(steps, none, draw)


def sampled_positions(
    toks: Column,
    key: Column,
    k: int = fx.POSITIONS_PER_DOC,
    seed: int = 42,
    specials: Sequence[str] = (),
    min_position: int = fx.MIN_POSITION,
) -> Column:
    """Up to ``k`` candidate positions of a document, without a shuffle."""
    if not specials:
        n = F.greatest(F.size(toks) - min_position, F.lit(0))
        picks = let(n, lambda m: keyed_picks(m, k, seed, key))
        return F.transform(picks, lambda i: (i + min_position).cast("bigint"))
    return let(
        candidate_positions(toks, specials, min_position),
        lambda c: F.transform(
            keyed_picks(F.size(c), k, seed, key), lambda i: F.get(c, i.cast("int")).cast("bigint")
        ),
    )


def prefix_text(toks: Column, n_tokens: Column, specials: Sequence[str] = ()) -> Column:
    """Text of the first ``n_tokens`` tokens, special ones left out."""
    kept = F.slice(toks, F.lit(1), n_tokens.cast("int"))
    if specials:
        kept = F.filter(kept, lambda t: ~t.isin(list(specials)))
    return F.array_join(kept, " ")


def marker_sites(toks: Column, marker: str, left: str, right: str) -> Column:
    """Positions of the marker between exactly these neighbours, never at an edge."""

    def scan(t: Column) -> Column:
        inner = F.when(F.size(t) > 2, F.sequence(F.lit(1), F.size(t) - 2))
        return F.filter(
            F.coalesce(inner, F.array().cast("array<int>")),
            lambda i: (F.get(t, i) == marker) & (F.get(t, i - 1) == left) & (F.get(t, i + 1) == right),
        )

    return let(toks, scan)


def marker_neighbors(toks: Column, marker: str) -> Column:
    """Tokens left and right of the only marker; several or an edge are errors."""

    def scan(t: Column) -> Column:
        at = F.array_position(t, marker).cast("int")
        once = F.size(F.filter(t, lambda x: x == marker)) == 1
        inside = (at > 1) & (at < F.size(t))
        return F.when(
            once & inside,
            F.struct(F.get(t, at - 2).alias("left"), F.get(t, at).alias("right")),
        ).otherwise(F.raise_error(F.lit("marker must occur once and not at an edge")).cast("struct<left:string,right:string>"))

    return let(toks, scan)


def stable_suffix(template: str, slot: str = "{explanation}") -> list[str]:
    """Tokens after the slot without the first, which can merge with the filling."""
    if slot not in template:
        raise ValueError(f"template must hold {slot}")
    tail = template.split(slot)[-1].split()
    if len(tail) < 2:
        raise ValueError("the template needs at least two tokens after its slot")
    return tail[1:]


def ends_with(toks: Column, suffix: Sequence[str]) -> Column:
    n = len(suffix)
    tail = F.when(F.size(toks) >= n, F.slice(toks, -n, n))
    return F.coalesce(tail == F.array(*[F.lit(s) for s in suffix]), F.lit(False))


def loss_mask(messages: Column, role: str = "assistant") -> Column:
    """One 0/1 per token of a message list, 1 where ``role`` speaks."""
    return F.flatten(
        F.transform(
            messages,
            lambda m: F.array_repeat((m["role"] == role).cast("int"), token_count(m["content"])),
        )
    )


def response_length(mask: Column) -> Column:
    """Tokens from the first 1 of a mask to its end."""
    first = F.array_position(mask, 1)
    return F.when(first > 0, F.size(mask) - first + 1).otherwise(F.lit(0))


def last_real_index(attention: Column) -> Column:
    """Index of the last 1 in a padding mask, wherever the padding sits."""
    back = F.array_position(F.reverse(attention), 1)
    return F.when(back > 0, F.size(attention) - back)
