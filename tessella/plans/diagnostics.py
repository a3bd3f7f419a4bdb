"""Errors that show where in a statement they stand."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from difflib import get_close_matches


@dataclass(frozen=True)
class Span:
    start: int
    end: int

    def to(self, other: Span) -> Span:
        return Span(min(self.start, other.start), max(self.end, other.end))


class SqlError(ValueError):
    """A statement that cannot be run; str() shows the place once the text is known."""

    def __init__(self, message: str, span: Span, hint: str | None = None):
        super().__init__(message)
        self.message, self.span, self.hint, self.source = message, span, hint, None

    def within(self, source: str) -> SqlError:
        if self.source is None:
            self.source = source
        return self

    def place(self) -> tuple[int, int]:
        """Line and column, both from 1."""
        lines = (self.source or "")[: self.span.start].split("\n")
        return len(lines), len(lines[-1]) + 1

    def __str__(self) -> str:
        """The message and hint, then the line of the place with what is meant between brackets."""
        told = self.message + (f" ({self.hint})" if self.hint else "")
        if self.source is None:
            return told
        line, column = self.place()
        text = self.source.split("\n")[line - 1]
        start, end = column - 1, min(max(column - 1 + self.span.end - self.span.start, column - 1), len(text))
        return f"{line}:{column}: {told}\n{text[:start]}⟦{text[start:end]}⟧{text[end:]}"


def suggestion(name: str, known: Iterable[str]) -> str | None:
    """The most alike of the known names, if any is alike enough; ASCII case aside."""
    of = {k.lower(): k for k in known}
    found = get_close_matches(name.lower(), of, n=1, cutoff=0.65)
    return of[found[0]] if found else None


def nearest(name: str | None) -> str | None:
    """A hint that names what may have been meant."""
    return f"closest: {name}" if name else None
