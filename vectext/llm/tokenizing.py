"""Public tokenizers inside tasks, with ids per word remembered.

The tokenizers here never merge across a space, so a text whose white space
comes in single characters is the ids of its words put together, and a word's
ids need be found once per worker. Texts are cut together, half a MB at a time:
Arrow finds the distinct words, the tokenizer is given those not yet known in one
go, and Arrow puts the ids in place. Other texts, and texts that hold the string
of an added token, go to the tokenizer whole. The ids are the tokenizer's own, as
it comes from its file, in either case.
"""

from __future__ import annotations

import codecs
import os
import re
from collections.abc import Iterable, Iterator
from operator import attrgetter

import numpy as np
import pyarrow as pa

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Words remembered per worker and generation.
MAX_WORDS = 150_000
#: Characters of texts that are cut into words together (or one text), and words that are made together.
TOGETHER = 1 << 19
MADE = 1 << 13
#: Texts of other characters are not cut into words here (capital I with dot changes length in lower case).
OTHER = re.compile("[^\t\n\r -~¡-įı-ſ]")
BLANKS = re.compile("[\t\n\r ][\t\n\r ]")
#: Marks that may be cut from a letter or digit before them; an apostrophe may belong to what follows.
MARKS = ".,;:!?*%&$#|)"
IS_MARK = np.isin(np.arange(256), list(MARKS.encode()))
IS_PLAIN = np.array([chr(b).isalnum() and b < 128 for b in range(256)])
ID_TYPE = np.dtype("<u4")
TOKEN_ID = attrgetter("id")


def byte_table() -> str:
    """The letter that stands for each byte in byte-level vocabularies: itself if it prints, else the next one from 256."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in prints]
    # Line ends stay, as they part the words that are spelled together.
    return "".join(chr(b if b in prints or b == 10 else 256 + rest.index(b)) for b in range(256))


BYTE_TABLE = byte_table()


def byte_letters(words: list[str]) -> list[str]:
    """Words without line ends in the letters of their bytes."""
    return codecs.charmap_decode("\n".join(words).encode(), "strict", BYTE_TABLE)[0].split("\n")


def word_starts(raw: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
    """Places in the UTF-8 of texts where a word begins, its space in front included.

    A word ends before white space, behind a line's end, and between a letter or
    digit and a mark, since no merge crosses from one to the other.
    """
    blank = raw <= 32
    starts = blank.copy()
    starts[1:] |= blank[:-1] & (raw[:-1] != 32)
    marks = np.flatnonzero(IS_MARK[raw])
    last, lead = raw[marks - 1], raw[np.maximum(marks - 2, 0)]
    # Two bytes from À on are a letter but for the signs of times and division.
    letter = IS_PLAIN[last] | ((last >= 0x80) & (lead >= 0xC3) & (last != 0x97) & (last != 0xB7))
    starts[marks[letter]] = True
    starts[text_starts[text_starts < len(raw)]] = True
    return np.flatnonzero(starts)


class Words(dict):
    """Ids of words as little-endian bytes, made when first asked for.

    Words of the last generation are remembered as well, so frequent words
    outlive a full memory.
    """

    def __init__(self, tokenizer, lead: str = "") -> None:
        self.tokenizer, self.lead, self.older = tokenizer, lead, {}

    def ids_of(self, words: list[str]) -> list[bytes]:
        """Ids of distinct words."""
        found = list(map(self.get, words))
        missing = [n for n, ids in enumerate(found) if ids is None]
        for at in range(0, len(missing), MADE):
            part = missing[at:at + MADE]
            older = [self.older.get(words[n]) for n in part]
            made = iter(self.make([words[n] for n, ids in zip(part, older) if ids is None]))
            for n, ids in zip(part, older):
                found[n] = self[words[n]] = next(made) if ids is None else ids
            if len(self) >= MAX_WORDS:
                self.older = dict(self)
                self.clear()
        return found

    def make(self, words: list[str]) -> list[bytes]:
        ids, counts = [], []
        # Letters alone are one piece, which the vocabulary's merges can be given as it is.
        spelled = iter(byte_letters([self.lead + word for word in words if word.isalpha()]))
        tokenize = self.tokenizer.model.tokenize
        for word in words:
            if word.isalpha():
                made = list(map(TOKEN_ID, tokenize(next(spelled))))
            else:
                made = self.tokenizer.encode(self.lead + word, add_special_tokens=False).ids
            ids += made
            counts.append(len(made))
        raw, ends = np.array(ids, dtype=ID_TYPE).tobytes(), (4 * np.cumsum(counts)).tolist()
        return [raw[start:end] for start, end in zip([0, *ends], ends)]


class TextEncoder:
    """Texts to ids, as little-endian unsigned 32-bit bytes.

    ``kind`` says how the tokenizer treats white space: ``bytes`` keeps it, a
    space belonging to the word behind it; ``words`` drops it and lower-cases;
    ``whole`` makes no assumption and never cuts.
    """

    def __init__(self, path: str, kind: str) -> None:
        from tokenizers import Tokenizer

        if kind not in ("bytes", "words", "whole"):
            raise ValueError(f"unknown kind {kind}")
        self.tokenizer, self.kind = Tokenizer.from_file(path), kind
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        #: Added tokens are found in the text before it is cut, some in its normal form, so in any case of letters.
        self.added = re.compile("|".join(map(re.escape, added)) or "(?!)", re.IGNORECASE)
        self.added_first = {c for t in added for c in (t[:1], t[:1].upper(), t[:1].lower())}
        self.first, self.spaced = Words(self.tokenizer), Words(self.tokenizer, " ")

    def encode(self, text: str) -> bytes:
        return next(self.encode_all([text]))

    def encode_all(self, texts: Iterable[str]) -> Iterator[bytes]:
        """Ids of each text in turn."""
        held, size = [], 0
        for text in texts:
            held.append(text)
            size += len(text)
            if size >= TOGETHER:
                yield from self.encode_held(held)
                held, size = [], 0
        yield from self.encode_held(held)

    def encode_held(self, texts: list[str]) -> Iterator[bytes]:
        cut = [self.may_cut(text) for text in texts]
        joined = iter(self.joined([text for text, may in zip(texts, cut) if may]))
        for text, may in zip(texts, cut):
            yield next(joined) if may else self.whole(text)

    def may_cut(self, text: str) -> bool:
        if self.kind == "whole" or OTHER.search(text) or self.holds_added(text):
            return False
        return self.kind == "words" or not BLANKS.search(text)

    def holds_added(self, text: str) -> bool:
        return any(c in text for c in self.added_first) and self.added.search(text) is not None

    def joined(self, texts: list[str]) -> list[bytes]:
        """Ids of texts that may be cut, put together from those of their words."""
        bodies = [(text.lower() if self.kind == "words" else text).encode() for text in texts]
        bounds = np.cumsum([0, *map(len, bodies)])
        raw = np.frombuffer(b"".join(bodies), dtype=np.uint8)
        if not len(raw):
            return [b""] * len(texts)
        starts = word_starts(raw, bounds[:-1])
        # Words go without the space in front, and without any white space where the tokenizer drops it.
        dropped = raw <= 32 if self.kind == "words" else raw == 32
        led, letters = dropped[starts], raw[~dropped]
        begins = starts - np.cumsum(led) + led
        buffers = [pa.py_buffer(np.append(begins, len(letters)).astype(np.int64)), pa.py_buffer(letters)]
        words = pa.LargeStringArray.from_buffers(len(starts), *buffers)
        if self.kind == "words":
            led = np.zeros(len(led), dtype=bool)
        found, codes = [], np.empty(len(starts), dtype=np.int64)
        for memory, mine in ((self.first, ~led), (self.spaced, led)):
            distinct = words.filter(pa.array(mine)).dictionary_encode()
            codes[mine] = distinct.indices.to_numpy() + len(found)
            found += memory.ids_of(distinct.dictionary.to_numpy(zero_copy_only=False).tolist())
        ids = pa.array(found, pa.large_binary()).take(pa.array(codes))
        _, offsets, data = ids.buffers()
        places = np.frombuffer(offsets, dtype=np.int64)[np.searchsorted(starts, bounds)].tolist()
        return [data[start:end].to_pybytes() for start, end in zip(places, places[1:])]

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=ID_TYPE).tobytes()


ENCODERS: dict[tuple[str, str], TextEncoder] = {}


def encoder(path: str, kind: str) -> TextEncoder:
    """The worker's encoder; its remembered words serve all tasks of the worker."""
    if (path, kind) not in ENCODERS:
        ENCODERS[path, kind] = TextEncoder(path, kind)
    return ENCODERS[path, kind]
