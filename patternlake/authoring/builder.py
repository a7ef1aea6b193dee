"""Fluent construction of patterns."""

from __future__ import annotations

from dataclasses import dataclass

from patternlake.dialect import CompiledPattern, Flags, PatternError, compile_pattern

_SPECIAL = set(".^$*+?()[]{|\\")


def escape(literal: str) -> str:
    """``literal`` as a pattern that matches it."""
    return "".join("\\" + c if c in _SPECIAL else c for c in literal)


@dataclass(frozen=True)
class Builder:
    """Each call returns a longer builder; quantifiers apply to what stands last."""

    text: str = ""

    def _add(self, more: str) -> Builder:
        return Builder(self.text + more)

    def literal(self, text: str) -> Builder:
        return self._add(escape(text))

    def any(self) -> Builder:
        return self._add(".")

    def digit(self) -> Builder:
        return self._add(r"\d")

    def word(self) -> Builder:
        return self._add(r"\w")

    def whitespace(self) -> Builder:
        return self._add(r"\s")

    def start_of_line(self) -> Builder:
        return self._add("^")

    def end_of_line(self) -> Builder:
        return self._add("$")

    def word_boundary(self) -> Builder:
        return self._add(r"\b")

    def one_or_more(self) -> Builder:
        return self._add("+")

    def zero_or_more(self) -> Builder:
        return self._add("*")

    def optional(self) -> Builder:
        return self._add("?")

    def repeat_exact(self, n: int) -> Builder:
        return self._add(f"{{{n}}}")

    def repeat_at_least(self, n: int) -> Builder:
        return self._add(f"{{{n},}}")

    def repeat_range(self, least: int, most: int) -> Builder:
        return self._add(f"{{{least},{most}}}")

    def start_group(self) -> Builder:
        return self._add("(")

    def start_non_capturing_group(self) -> Builder:
        return self._add("(?:")

    def end_group(self) -> Builder:
        return self._add(")")

    def or_(self) -> Builder:
        return self._add("|")

    def char_class(self, chars: str) -> Builder:
        return self._add(f"[{chars}]")

    def not_char_class(self, chars: str) -> Builder:
        return self._add(f"[^{chars}]")

    def char_range(self, first: str, last: str) -> Builder:
        return self._add(f"[{first}-{last}]")

    def build(self) -> str:
        return self.text

    def compile(self, flags: str | Flags | None = None) -> CompiledPattern:
        return compile_pattern(self.text, flags)


@dataclass(frozen=True)
class Composer:
    """A list of patterns, to be joined; nothing is put in parentheses unasked."""

    parts: tuple[str, ...] = ()

    def add(self, pattern: str) -> Composer:
        return Composer((*self.parts, pattern))

    def _joined(self, by: str) -> str:
        if not self.parts:
            raise PatternError("EmptyPattern")
        return by.join(self.parts)

    def alternatives(self) -> str:
        return self._joined("|")

    def sequence(self) -> str:
        return self._joined("")

    def group(self) -> str:
        return f"({self._joined('')})"
