"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from patternlake.llm import classifier, flac, licenses, linededup, mixing, packing, quality, simhash, suffixdedup, urlfilter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": mixing.op1_mixing,
    "op2_quality": quality.op2_quality,
    "op3_flac": flac.op3_flac,
    "op4_urlfilter": urlfilter.op4_urlfilter,
    "op5_suffixdedup": suffixdedup.op5_suffixdedup,
    "op6_simhash": simhash.op6_simhash,
    "op7_linededup": linededup.op7_linededup,
    "op8_packing": packing.op8_packing,
    "op9_licenses": licenses.op9_licenses,
    "op10_quality": classifier.op10_quality,
}

ORACLE_SQL: dict[str, str] = {
    "op1_mixing": mixing.ORACLE,
    "op2_quality": quality.ORACLE,
    "op4_urlfilter": urlfilter.ORACLE,
    "op7_linededup": linededup.ORACLE,
    "op9_licenses": licenses.ORACLE,
}
