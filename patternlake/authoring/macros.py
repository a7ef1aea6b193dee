"""Macros: ``${name}`` in a pattern stands for another pattern."""

from __future__ import annotations

from patternlake.dialect import PatternError

#: Fixed values.
COMMON = {
    "digit": "[0-9]",
    "word": "[a-zA-Z]",
    "word_char": "[a-zA-Z0-9_]",
    "whitespace": r"[ \t\r\n]",
    "alpha": "[a-zA-Z]",
    "alnum": "[a-zA-Z0-9]",
    "hex": "[0-9a-fA-F]",
    "lower": "[a-z]",
    "upper": "[A-Z]",
    "email_local": "[a-zA-Z0-9._%+-]+",
    "email_domain": r"[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}",
    "ipv4_octet": "(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)",
    "url_scheme": "https?",
}


class Macros:
    """Definitions by name; a later definition replaces an earlier one."""

    def __init__(self, known: dict[str, str] | None = None) -> None:
        self._known = dict(known or {})

    def define(self, name: str, pattern: str) -> Macros:
        self._known[name] = pattern
        return self

    def is_defined(self, name: str) -> bool:
        return name in self._known

    def get(self, name: str) -> str | None:
        return self._known.get(name)

    def expand(self, pattern: str) -> str:
        """One pass, not recursive; an unfinished ``${`` stays as it is."""
        out, at = [], 0
        while (start := pattern.find("${", at)) >= 0:
            end = pattern.find("}", start)
            if end < 0:
                break
            name = pattern[start + 2 : end]
            if name not in self._known:
                raise PatternError("UndefinedMacro", pattern, start, name)
            out += [pattern[at:start], self._known[name]]
            at = end + 1
        return "".join([*out, pattern[at:]])
