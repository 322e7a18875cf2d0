"""A lazy sequence of the morphemes of one text."""

from __future__ import annotations

from collections.abc import Sequence

from tessera.operators.batches import morphemes_of
from tessera.operators.kernel import Token


class Morphemes(Sequence):
    """Morphemes as dictionaries of the result schema, made when they are asked for; a slice is a view, too."""

    def __init__(self, of, tokens: list[Token], starts: list[int]):
        self._of, self._tokens, self._starts = of, tokens, starts

    @classmethod
    def whole(cls, of, tokens: list[Token]) -> Morphemes:
        starts, at = [], 0
        for t in tokens:
            starts.append(at)
            at += len(t.surface.encode("utf-8", "surrogateescape"))
        return cls(of, tokens, starts)

    def __len__(self) -> int:
        return len(self._tokens)

    def __getitem__(self, i):
        if isinstance(i, slice):
            return Morphemes(self._of, self._tokens[i], self._starts[i])
        (m,) = morphemes_of(self._of, [self._tokens[i]])
        start = self._starts[i]
        return m | {"start": start, "end": start + m["end"]}

    def __eq__(self, other) -> bool:
        return isinstance(other, Sequence) and list(self) == list(other)
