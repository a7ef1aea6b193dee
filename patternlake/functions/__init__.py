"""Search verbs as columns.

Every verb takes a text column and a pattern (text, with optional flag letters, or a
compiled one) and returns a column of built-in expressions: nothing leaves the JVM, but for
``find`` of patterns whose groups those can't place (see there).  Null texts give null.
"""

from patternlake.functions.lines import count_matching_lines, is_matching_line, lines, matching_lines
from patternlake.functions.verbs import capture, captures, count, find, find_all, find_all_text, find_from, find_text, is_match, named_captures, replace, replace_all, split

__all__ = [
    "capture", "captures", "count", "count_matching_lines", "find", "find_all", "find_all_text", "find_from", "find_text", "is_match", "is_matching_line",
    "lines", "matching_lines", "named_captures", "replace", "replace_all", "split",
]
