"""Cutting a text where no token can cross, so that pieces are tokenised once and looked up afterwards."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

# One space with something other than white space on both sides. The tokenisers' pattern starts a new match at such a
# space whatever stands around it, and none of their special strings holds one. Python's \s holds all of Unicode's
# White_Space and a little more, which only makes fewer cuts.
_SAFE = re.compile(r"(?<=\S) (?=\S)")
_UNSAFE = re.compile(r"\s | \s")


def cut(text: str) -> list[str]:
    """The pieces of a text; all but the first have lost the space that they start with."""
    if text.startswith(" ") or text.endswith(" ") or _UNSAFE.search(text):
        return _SAFE.split(text)
    return text.split(" ")


class _Generations:
    """Values by piece in two generations: when the younger one is full the older one goes, so what is used often stays."""

    def __init__(self) -> None:
        self.young: dict[str, object] = {}
        self.old: dict[str, object] = {}

    def missing(self, pieces: set[str]) -> list[str]:
        """The pieces that neither generation has; those of the older one move to the younger."""
        new = pieces - self.young.keys()
        kept = new & self.old.keys()
        for piece in kept:
            self.young[piece] = self.old[piece]
        return list(new - kept)

    def turn(self) -> None:
        self.young, self.old = {}, self.young


class Remembered:
    """Values of pieces, computed for many new ones at a time and kept up to a bound.

    ``limit`` bounds the number of entries and ``long`` the length of a piece that is kept, so a worker's memory
    doesn't grow with the data.
    """

    def __init__(self, compute: Callable[[list[str]], Sequence], limit: int = 300_000, long: int = 64):
        self.compute, self.limit, self.long = compute, limit, long
        self.first, self.later = _Generations(), _Generations()

    def values(self, texts: Sequence[str]) -> Iterator[list]:
        """For each text the values of its pieces, in order."""
        cuts = [cut(text) for text in texts]
        if len(self.first.young) + len(self.later.young) > self.limit // 2:
            self.first.turn()
            self.later.turn()
        new_first = self.first.missing({pieces[0] for pieces in cuts})
        new_later = self.later.missing({piece for pieces in cuts for piece in pieces[1:]})
        found = self.compute(new_first + [" " + piece for piece in new_later])
        self.first.young.update(zip(new_first, found))
        self.later.young.update(zip(new_later, found[len(new_first) :]))
        first, later = self.first.young, self.later.young
        for pieces in cuts:
            out = [first[pieces[0]]]
            out.extend(map(later.__getitem__, pieces[1:]))
            yield out
        for known, new in ((first, new_first), (later, new_later)):
            for piece in new:
                if len(piece) > self.long:
                    del known[piece]


def balanced(sizes: Sequence[int], limit: int) -> Iterator[tuple[int, int]]:
    """Runs of rows of at most ``limit`` bytes together; a larger row makes a run of its own."""
    first, total = 0, 0
    for i, size in enumerate(sizes):
        if i > first and total + size > limit:
            yield first, i
            first, total = i, 0
        total += size
    if first < len(sizes):
        yield first, len(sizes)
