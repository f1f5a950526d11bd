"""Cutting text at spaces for byte-level tokenizers, and a bounded table of known parts."""

from __future__ import annotations

import re
from collections.abc import Callable

#: Parts kept by each of the two generations of a task's table.
TABLE_PARTS = 150_000
#: Longer parts are encoded each time, so the table stays small.
PART_LENGTH = 64
LOOSE_SPACE = re.compile(r" (?:\s|\Z)|\0")


def cut_at_spaces(text: str) -> list[str] | None:
    """Parts of ``text``, each after the first with its leading space; None if white space runs forbid it.

    A space between two characters that are no white space always starts a piece of the
    tokenizer, and no piece sees beyond it, so parts can be encoded one by one.
    """
    if LOOSE_SPACE.search(text):
        return None
    parts = text.replace(" ", "\0 ").split("\0")
    return parts if parts[0] else parts[1:]


class PartTable:
    """Ids of parts seen lately: a full young generation becomes the old one, which is dropped."""

    def __init__(self, size: int = TABLE_PARTS):
        self.size, self.young, self.old = size, {}, {}

    def look_up(self, parts: list[str], encode: Callable[[list[str]], list[bytes]]) -> list[bytes]:
        """Ids of each part; ``encode`` gets the distinct unknown ones."""
        found = list(map(self.young.get, parts))
        if all(found):
            return found
        missing = {part: self.old.get(part) for part, ids in zip(parts, found) if ids is None}
        unknown = [p for p, ids in missing.items() if ids is None]
        if unknown:
            missing.update(zip(unknown, encode(unknown)))
        self.remember(missing)
        return [missing[part] if ids is None else ids for part, ids in zip(parts, found)]

    def remember(self, known: dict[str, bytes]) -> None:
        young = self.young
        for part, ids in known.items():
            if len(part) <= PART_LENGTH:
                young[part] = ids
        if len(young) >= self.size:
            self.old, self.young = young, {}
