"""Named patterns, and columns that validate or extract by them."""

from __future__ import annotations

from pyspark.sql import Column

from patternlake.functions import find_all_text, find_text, is_match

#: Fixed values; they search, so anchors are the user's own.
PATTERNS = {
    "email": r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}",
    "url": r"https?://[a-zA-Z0-9.-]+(?:/[a-zA-Z0-9._~:/?#\[\]@!$&'()*+,;=-]*)?",
    "ipv4": r"(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)",
    "phoneUS": r"\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}",
    "dateISO": r"\d{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])",
    "time24": r"(?:[01][0-9]|2[0-3]):[0-5][0-9](?::[0-5][0-9])?",
    "hexColor": r"#(?:[0-9a-fA-F]{3}){1,2}",
    "creditCard": r"\d{4}[-.\s]?\d{4}[-.\s]?\d{4}[-.\s]?\d{4}",
    "uuid": r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}",
    "integer": r"[0-9]+",
    "decimal": r"[0-9]+(?:\.[0-9]+)?",
    "identifier": r"[a-zA-Z_][a-zA-Z0-9_]*",
}


def holds(name: str, text: Column | str) -> Column:
    """Whether the named pattern occurs in a text."""
    return is_match(text, PATTERNS[name])


def validates(name: str, text: Column | str) -> Column:
    """Whether the whole text is one match of the named pattern."""
    return is_match(text, f"^(?:{PATTERNS[name]})$")


def extract(name: str, text: Column | str) -> Column:
    return find_text(text, PATTERNS[name])


def extract_all(name: str, text: Column | str) -> Column:
    return find_all_text(text, PATTERNS[name])
