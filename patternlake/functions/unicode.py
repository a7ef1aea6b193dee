"""Unicode questions about single characters, as columns; the JVM's character tables answer."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from patternlake.dialect.properties import CATEGORIES
from patternlake.functions.verbs import is_match

#: Scripts that ``script`` tells apart, frequent ones first.
SCRIPTS = (
    "Latin", "Common", "Inherited", "Cyrillic", "Greek", "Han", "Arabic", "Hebrew", "Hiragana", "Katakana", "Hangul", "Thai", "Devanagari", "Bengali", "Gurmukhi", "Gujarati", "Oriya", "Tamil",
    "Telugu", "Kannada", "Malayalam", "Sinhala", "Lao", "Tibetan", "Myanmar", "Georgian", "Armenian", "Ethiopic", "Cherokee", "Mongolian", "Khmer", "Bopomofo", "Syriac", "Thaana", "Coptic", "Braille",
)
SHORT = sorted({c for c in CATEGORIES.values() if len(c) == 2 and c not in ("LC", "Cs")})


def _whole(char: Column | str, spec: str) -> Column:
    return is_match(char, f"^{spec}$", "u")


def matches_property(char: Column | str, spec: str) -> Column:
    """Whether a character has a property, such as ``Script=Greek`` or ``Lu``."""
    return _whole(char, f"\\p{{{spec}}}")


def is_letter(char: Column | str) -> Column:
    return _whole(char, r"\p{L}")


def is_digit(char: Column | str) -> Column:
    return _whole(char, r"\p{Nd}")


def is_alphanumeric(char: Column | str) -> Column:
    return _whole(char, r"[\p{L}\p{Nd}]")


def is_whitespace(char: Column | str) -> Column:
    return _whole(char, r"\p{White_Space}")


def script(char: Column | str) -> Column:
    """The script of a one-character text, by its Unicode name, among ``SCRIPTS``; null for others."""
    found = F.lit(None).cast("string")
    for name in reversed(SCRIPTS):
        found = F.when(_whole(char, f"\\p{{sc={name}}}"), F.lit(name)).otherwise(found)
    return found


def general_category(char: Column | str) -> Column:
    """The two-letter general category of a one-character text, null for other texts."""
    found = F.lit(None).cast("string")
    for name in reversed(SHORT):
        found = F.when(_whole(char, f"\\p{{{name}}}"), F.lit(name)).otherwise(found)
    return found
