"""Cutting texts where the usual byte-level split pattern never matches across, and remembering what the cuts gave."""

from __future__ import annotations

from collections.abc import Callable

import regex

#: The split pattern of byte-level tokenisers. None of its matches runs from other characters into white space.
SPACE_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_SPACED = regex.compile(r"\s ").search
_CUT = regex.compile(r"\s*\S+|\s+").findall


def cuts(text: str) -> list[str]:
    """``text`` in parts that the pattern splits as it splits the whole: each begins with white space that follows another character."""
    if _SPACED(text):
        return _CUT(text)
    first, *rest = text.split(" ")  # every space stands behind another character
    return [first, *[" " + x for x in rest]]


class Memory(dict):
    """``memory[key]`` is ``of(key)``, remembered for keys of up to ``longest`` characters.

    When ``most`` keys are held they become the old ones; an old key that is asked
    for is held again, the others go when the next ``most`` are full. So
    memory is bounded and the common keys stay.
    """

    def __init__(self, of: Callable, most: int, longest: int):
        super().__init__()
        self.of, self.most, self.longest, self.old = of, most, longest, {}

    def __missing__(self, key):
        found = self.old.get(key)
        if found is None:
            found = self.of(key)
        if len(key) <= self.longest:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[key] = found
        return found
