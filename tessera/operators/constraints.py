"""Constraints on an analysis: their validation, and which candidates they allow. All offsets are bytes."""

from __future__ import annotations

from tessera.types import ConstraintError, ConstraintReason, Constraints


def pos_pattern_valid(pattern: str) -> bool:
    """Empty, or columns none of which is empty."""
    return not pattern or all(pattern.split(","))


def pos_prefix_matches(pattern: str, pos: str) -> bool:
    """Whether the columns of ``pattern`` are the first columns of ``pos``."""
    return not pattern or f"{pos},".startswith(f"{pattern},")


def validate(cons: Constraints, bounds: set[int], size: int) -> None:
    """Raise the first fault: tokens one by one, their overlaps, boundaries one by one, then their conflicts.

    ``bounds`` are the byte offsets at which a character starts or the text ends.
    """

    def fault(reason: ConstraintReason, index: int, start: int, end: int = -1) -> ConstraintError:
        return ConstraintError(reason, index, start, end)

    why = ConstraintReason
    for i, t in enumerate(cons.tokens):
        for broken, reason in (
            (t.start < 0 or t.end > size, why.OUT_OF_BOUNDS),
            (t.start >= t.end, why.EMPTY_SPAN),
            (t.start not in bounds or t.end not in bounds, why.NOT_RUNE_BOUNDARY),
            (not pos_pattern_valid(t.pos or ""), why.BAD_POS_PATTERN),
        ):
            if broken:
                raise fault(reason, i, t.start, t.end)
    for j, t in enumerate(cons.tokens):
        if any(o.start < t.end and t.start < o.end for o in cons.tokens[:j]):
            raise fault(why.TOKEN_OVERLAP, j, t.start, t.end)
    for i, b in enumerate(cons.boundaries):
        if not 0 < b.at < size:
            raise fault(why.OUT_OF_BOUNDS, i, b.at)
        if b.at not in bounds:
            raise fault(why.NOT_RUNE_BOUNDARY, i, b.at)
        for t in cons.tokens:
            if t.start < b.at < t.end:
                raise fault(why.BOUNDARY_INSIDE_TOKEN, i, b.at)
            if not b.must_exist and b.at in (t.start, t.end):
                raise fault(why.BOUNDARY_AT_TOKEN_EDGE, i, b.at)
    said: dict[int, bool] = {}
    for b in cons.boundaries:
        if said.setdefault(b.at, b.must_exist) != b.must_exist:
            raise fault(why.CONFLICTING_BOUNDARIES, -1, b.at)


def allowed(cons: Constraints, start: int, end: int, pos: str) -> bool:
    """Whether a candidate may stay."""
    for b in cons.boundaries:
        if (start < b.at < end) if b.must_exist else end == b.at:
            return False
    for t in cons.tokens:
        if start < t.end and t.start < end and not (start == t.start and end == t.end and pos_prefix_matches(t.pos or "", pos)):
            return False
    return True
