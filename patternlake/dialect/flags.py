"""Pattern flags; all off by default."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Flags:
    ignore_case: bool = False
    multiline: bool = False
    dot_all: bool = False
    extended: bool = False
    unicode: bool = False
    unicode_sets: bool = False
    ecmascript: bool = False

    @classmethod
    def of(cls, letters: str | Flags | None) -> Flags:
        """From letters of ``imsxuv``; flags and None pass through."""
        if letters is None:
            return cls()
        if isinstance(letters, Flags):
            return letters
        names = {"i": "ignore_case", "m": "multiline", "s": "dot_all", "x": "extended", "u": "unicode", "v": "unicode_sets"}
        if set(letters) - set(names):
            raise ValueError(f"unknown flags in {letters!r}")
        return cls(**{names[c]: True for c in letters})

    @property
    def full_unicode(self) -> bool:
        return self.unicode or self.unicode_sets
