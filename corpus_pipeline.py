"""The corpus pipeline: from raw documents to packed sequences.

``STAGES`` lists (name, function) pairs; each function takes (spark, docs, sf_dir) and
returns a DataFrame, and all but the last return the columns of ``documents``.  Duplicate
lines and near copies go before mixing, so that budgets count what is left; packing comes
last and never looks back.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from patternlake.llm import linededup, mixing, packing, quality, simhash
from patternlake.llm.common import table
from patternlake.plans.lineage import cut

#: Half as many tokens again as there are: short domains are read up to four times, so that
#: the target weights are met where a domain, language or source holds a quarter of its target.
MIXTURE = mixing.Mixture(domains=mixing.PRODUCTION.domains, weights=mixing.PRODUCTION.weights, share=(3, 2), max_epochs=4, seed=7)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule and the certified cutoffs keep."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that repeat an earlier one, long ones up to one word."""
    return linededup.dedup(docs, chars_col="n_chars")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (Jaccard of five-word shingles from 0.8)."""
    return simhash.representatives(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents up to the budgets of their sources, once for each epoch that takes them."""
    return mixing.mix(docs, MIXTURE, chars_col="n_chars")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens, with their ids."""
    return packing.pack(docs, tokenizer_path=public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("mix_sources", mix_sources),
    ("pack", pack),
]

#: SQL can express neither the fingerprints nor the tokens.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
