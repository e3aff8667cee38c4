"""Small plug-ins that the registered queries name by import path."""

from __future__ import annotations

import re
import zlib
from collections.abc import Sequence


class ShapeExtractor:
    """Vectors of text length, layer and one, in place of a model's."""

    def __init__(self, width: int = 3, **options: object) -> None:
        self.width = width

    def __call__(self, texts: Sequence[str], layer: int) -> list[list[float]]:
        return [[float(len(t)), float(layer), 1.0][: self.width] for t in texts]


class LengthProvider:
    """Two features per prompt; no response, or one feature, for lengths of some remainders."""

    def __call__(self, prompts: Sequence[str]) -> list[str | None]:
        return [self.respond(p.rsplit("\n\n", 1)[-1]) for p in prompts]

    def respond(self, text: str) -> str | None:
        if len(text) % 7 == 0:
            return None
        first = f"{len(text)} signs"
        return f"<analysis>{first}</analysis>" if len(text) % 7 == 1 else f"<analysis>\n{first}\n\nends\n</analysis>"


def piece_ids(text: str) -> list[int]:
    """A tokenizer of tags, words and single signs."""
    return [zlib.crc32(t.encode()) for t in re.findall(r"<[^>]*>|\w+|[^\s\w]", text)]
