"""Messages with a place in the script, and suggestions for misspelt names."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass


@dataclass(frozen=True)
class Span:
    """Where a construct stands: offsets, and the line and column (from 1) of its start."""

    start: int = 0
    end: int = 0
    line: int = 1
    column: int = 1


@dataclass(frozen=True)
class Diagnostic:
    message: str
    span: Span = Span()
    severity: str = "error"
    suggestion: str | None = None

    def __str__(self) -> str:
        return f"{self.severity} at line {self.span.line}, column {self.span.column}: {self.message}" + (f" Did you mean '{self.suggestion}'?" if self.suggestion else "")


class ScriptError(Exception):
    """A script that can't be read, typed or evaluated."""

    def __init__(self, message: str, span: Span = Span(), suggestion: str | None = None) -> None:
        self.diagnostic = Diagnostic(message, span, "error", suggestion)
        super().__init__(str(self.diagnostic))


def distance(a: str, b: str) -> int:
    """Levenshtein's, by rows."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def nearest(name: str, known: Iterable[str], most: int = 3) -> str | None:
    """The known name closest to this one, if within so many edits."""
    found = min(((distance(name.lower(), k.lower()), k) for k in known), default=None)
    return found[1] if found and found[0] <= most else None
