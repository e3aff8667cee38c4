"""Text expressions: quality rules, tags, templates and explanation cleaning."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, functions as F

from vectext import fixed_values as fx
from vectext.functions.lets import let

# White space as Unicode defines it plus the separator controls, for (?U) patterns.
SPACE = r"[\s\x1C-\x1F]"
# The same as plain classes, for patterns that count lines.
BLANKS = r"\t-\r\x1C-\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
LINE_ENDS = r"\n-\r\x1C-\x1E\x85\u2028\u2029"

# Characters outside ASCII that equal an ASCII letter when case is ignored.
FOLDING_CHARS = "\u017F\u0131\u0130\u212A"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?U)\A{SPACE}+|{SPACE}+\z", "")


# ---------------------------------------------------------------- quality rules


@dataclass(frozen=True)
class QualityRules:
    """Thresholds of the corpus filter; ``score_min=None`` switches the floor off."""

    score_min: float | None = fx.SCORE_MIN
    min_chars: int = fx.MIN_CHARS
    max_chars: int = fx.MAX_CHARS
    min_words: int = fx.MIN_WORDS
    max_bullet_line_frac: float = fx.MAX_BULLET_LINE_FRAC
    extra_patterns: Sequence[str] = field(default_factory=tuple)


def score_ok(score: Column, floor: float | None) -> Column:
    """Floor on a score held as text; a missing or unreadable score fails."""
    if floor is None:
        return F.lit(True)
    return F.coalesce(score.try_cast("double") >= F.lit(floor), F.lit(False))


def score_text(score: Column) -> Column:
    number = score.try_cast("double")
    return F.when(number.isNotNull(), F.format_string("%.4f", number))


def has_bad_pattern(text: Column, extra: Sequence[str] = ()) -> Column:
    """True where any reject pattern occurs, ignoring case.

    The built-in patterns run as one regex that looks at a place only when its
    letter opens a pattern. It folds ASCII case; texts with one of the four
    other characters that fold to an ASCII letter also go through the slower
    fully Unicode form, as do patterns of the caller.
    """
    opening = "".join(sorted({p.removeprefix(r"\b")[0] for p in fx.BAD_PATTERNS}))
    fast = "|".join(p.replace(r"\b", r"(?U:\b)") for p in fx.BAD_PATTERNS)
    hit = text.rlike(f"(?i)(?=[{opening}])(?:{fast})")
    for char in FOLDING_CHARS:
        hit = hit | (text.contains(char) & text.rlike("(?iU)" + "|".join(fx.BAD_PATTERNS)))
    return hit | text.rlike("(?iU)" + "|".join(extra)) if extra else hit


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit("[A-Za-z]+"))


def line_count(text: Column) -> Column:
    """Number of lines that hold something besides white space."""
    return F.regexp_count(text, F.lit(rf"(?:\A|[{LINE_ENDS}])[{BLANKS}]*[^{BLANKS}]"))


def bullet_count(text: Column) -> Column:
    """Number of lines that open with a bullet sign or a number and a mark."""
    gap = f"[{BLANKS}&&[^{LINE_ENDS}]]+[^{BLANKS}]"
    opening = rf"(?:\A|[{LINE_ENDS}])[{BLANKS}]*(?:[-*•]|\p{{Nd}}+[.)](?={gap}))"
    return F.regexp_count(text, F.lit(opening))


def bullet_share(text: Column) -> Column:
    """Share of bullet lines; null for texts with few lines."""
    return let(line_count(text), lambda lines: F.when(lines >= fx.BULLET_MIN_LINES, bullet_count(text) / lines))


def reject_reason(text: Column, score: Column, rules: QualityRules = QualityRules()) -> Column:
    """First rule a row fails, cheapest rules first; null where it passes all."""
    chars = F.length(text)
    return (
        F.when(text.isNull(), "not_text")
        .when(~score_ok(score, rules.score_min), "low_score")
        .when((chars < rules.min_chars) | (chars > rules.max_chars), "length")
        .when(has_bad_pattern(text, rules.extra_patterns), "bad_pattern")
        .when(word_count(text) < rules.min_words, "few_words")
        .when(bullet_share(text) > rules.max_bullet_line_frac, "bullets")
    )


def prefix_key(text: Column, chars: int | None = fx.PREFIX_CHARS) -> Column:
    """Opening characters, all of them if ``chars`` is None, with white space runs as one space, in lower case."""
    opening = text if chars is None else F.substring(text, 1, chars)
    return F.lower(F.regexp_replace(opening, f"(?U){SPACE}+", " "))


# ---------------------------------------------------------- tags and templates


def extract_explanation(response: Column) -> Column:
    """Stripped text between the first tag pair; null where there is none."""
    pattern = rf"(?s){re.escape(fx.EXPLANATION_OPEN)}(.*?){re.escape(fx.EXPLANATION_CLOSE)}"
    return F.when(response.rlike(pattern), strip(F.regexp_extract(response, pattern, 1)))


def extract_or_all(response: Column) -> Column:
    """Text from the first open tag to the first close tag, else all of it."""
    opened = F.instr(response, fx.EXPLANATION_OPEN)
    closed = F.instr(response, fx.EXPLANATION_CLOSE)
    start = opened + F.lit(len(fx.EXPLANATION_OPEN))
    inner = F.substring(response, start, F.greatest(closed - start, F.lit(0)))
    return strip(F.when((opened > 0) & (closed > 0), inner).otherwise(response))


def wrap_explanation(text: Column) -> Column:
    return F.concat(F.lit(fx.EXPLANATION_OPEN + "\n"), text, F.lit("\n" + fx.EXPLANATION_CLOSE))


def split_template(template: str, slot: str) -> tuple[str, str]:
    if template.count(slot) != 1:
        raise ValueError(f"template must hold {slot} exactly once")
    head, tail = template.split(slot)
    return head, tail


def fill_template(template: str, value: Column, slot: str = "{explanation}") -> Column:
    head, tail = split_template(template, slot)
    return F.concat(F.lit(head), value, F.lit(tail))


def unwrap_template(prompt: Column, template: str, slot: str = "{explanation}") -> Column:
    """Inverse of :func:`fill_template`; a prompt of another template is an error."""
    head, tail = split_template(template, slot)
    size = F.length(prompt) - F.lit(len(head) + len(tail))
    fits = prompt.startswith(head) & prompt.endswith(tail) & (size >= 0)
    return F.when(fits, F.substring(prompt, F.lit(len(head) + 1), size)).otherwise(
        F.raise_error(F.concat(F.lit("prompt does not fit the template: "), F.substring(prompt, 1, 80)))
    )


def truncate_note(text: Column, limit: int = fx.REPORT_MAX_CHARS) -> Column:
    rest = F.length(text) - F.lit(limit)
    note = F.concat(F.lit("\n\n[... TRUNCATED: "), rest.cast("string"), F.lit(" more chars ...]"))
    return F.when(rest > 0, F.concat(F.substring(text, 1, limit), note)).otherwise(text)


# ------------------------------------------------------- explanation cleaning


def clean_explanation(raw: Column, pattern: str = fx.RESPONSE_PATTERN) -> Column:
    """Features of a tagged response as plain paragraphs; null without the tags.

    Inline headers, ordinals and closing phrases start a new line; every line
    loses its list mark, bold frame and emphasis signs; blank lines go. A
    response left with one line is cut into sentences when it has several.
    """
    headers = "|".join(fx.HEADER_PHRASES)
    body = F.regexp_extract(raw, f"(?sU){pattern}", 1)
    body = F.regexp_replace(body, rf"(?iU){SPACE}+(?=(?:{headers})\s*:)", "\n")
    body = F.regexp_replace(body, rf"(?iU){SPACE}+(?=(?:{fx.ORDINAL_WORDS}),)", "\n")
    body = F.regexp_replace(body, rf"(?iU){SPACE}+(?=(?:{fx.FINAL_PHRASES})\b)", "\n")

    def clean_line(line: Column) -> Column:
        line = F.regexp_replace(line, f"(?U){fx.LIST_PREFIX}", "")
        line = F.regexp_replace(line, f"(?Ud){fx.BOLD_WRAP}", "$1 ")
        return F.regexp_replace(strip(line), r"\A[*_]+|[*_]+\z", "")

    def kept(parts: Column) -> Column:
        return F.filter(parts, lambda part: part != "")

    def sentences(line: Column) -> Column:
        cut = rf"(?U)(?<={fx.SENTENCE_END}){SPACE}+(?={fx.SENTENCE_START})"
        return kept(F.transform(F.split(line, cut), strip))

    def joined(lines: Column) -> Column:
        one = F.size(lines) == 1
        return let(
            F.when(one, sentences(F.get(lines, F.lit(0)))),
            lambda cut: F.array_join(
                F.when(one & (F.size(cut) >= fx.MIN_FEATURES), cut).otherwise(lines), "\n\n"
            ),
        )

    lines = kept(F.transform(F.split(body, "\n"), clean_line))
    return F.when(raw.rlike(f"(?sU){pattern}"), let(lines, joined))


def feature_count(cleaned: Column) -> Column:
    """Paragraph separators plus one, and 0 where nothing was extracted."""
    return F.coalesce(F.size(F.split(cleaned, "\n\n")), F.lit(0))
