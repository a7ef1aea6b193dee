"""Relational operators built on the verbs."""

from patternlake.operators.matches import explode_matches, match_counts, pattern_anti_join, pattern_join, pattern_semi_join, top_matches
from patternlake.operators.tables import pattern_table_join

__all__ = ["explode_matches", "match_counts", "pattern_anti_join", "pattern_join", "pattern_semi_join", "pattern_table_join", "top_matches"]
