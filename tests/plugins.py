"""Extractors and providers for tests. Workers import this file."""


import re
import zlib


def piece_ids(text):
    """A tokenizer: ids of tags, words and single signs."""
    return [zlib.crc32(t.encode()) for t in re.findall(r"<[^>]*>|\w+|[^\s\w]", text)]


class LengthExtractor:
    def __init__(self, width=3, **options):
        self.width = width

    def __call__(self, texts, layer):
        return [[float(len(t)), float(layer), 1.0][: self.width] for t in texts]


class EchoProvider:
    """Two features for most prompts, nothing usable for the rest."""

    def __call__(self, prompts):
        out = []
        for p in prompts:
            text = p.rsplit("\n\n", 1)[-1]
            out.append(None if len(text) % 5 == 0 else f"<analysis>- {text.split()[-1]}\n- {len(text)} signs</analysis>")
        return out


class SilentProvider:
    def __call__(self, prompts):
        return [None] * len(prompts)


GOOD = "<analysis>\nfirst thing\n\nsecond thing\n</analysis>"
OTHER = {"none": None, "open": "<analysis> cut", "one": "<analysis>lonely</analysis>"}


def provider(prompts):
    """A good response, unless the text asks for another."""
    return [OTHER.get(p.rsplit("\n\n", 1)[1], GOOD) for p in prompts]
