"""Mixing sources to target weights by hierarchical budgeting, in built-in expressions only.

The tree has three levels: domain, language, source.  A node's budget goes to its children
in proportion to their weights, but no child gets more than its subtree can supply in
``max_epochs`` passes; what a child can't take goes to its siblings by weight, and only
what all of them can't take stays with the parent's siblings, as the parent's own supply
bounds its budget.  All budgets are whole numbers of tokens (words), rounded down.

A leaf then takes whole epochs while its budget lasts and a token prefix of the next one, in
the order of a seeded hash of epoch and document id.  To find where the prefix ends, a
leaf's hash range is cut into as many buckets as a bucket holds documents: token sums tell
which bucket holds the end, and only that bucket is put in order.  So no task ever
sorts a whole leaf, and the text columns are never shuffled.

Defined results: null domains, languages and sources are named ''; texts without words are
never taken; rows with equal ids stand or fall together, and share what is left of the
budget where the prefix ends; an empty table gives no rows; other columns, whatever their
names, are ignored by ``select`` and kept by ``mix``.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from patternlake.llm.common import SPACE, WORD, nested, table, unnested, word_count
from patternlake.plans.lineage import broadcast_if_small, cut

LEVELS = ("domain", "lang", "source")
#: A leaf of n documents has n to this power buckets, so neither their number nor their size
#: grows with n itself.
_BUCKET_POWER = 0.5
_HASH_BITS = 60


@dataclass(frozen=True)
class Mixture:
    """Weights by level and name (1 where not named), and how much to take.

    ``domains`` maps domains to patterns of their sources, tried in order; sources that fit
    none are in domain ``other``.  The budget is ``share`` = (a, b): a / b of all tokens.
    """

    domains: Mapping[str, str] = field(default_factory=dict)
    weights: Mapping[str, Mapping[str, int]] = field(default_factory=dict)
    share: tuple[int, int] = (1, 1)
    max_epochs: int = 4
    seed: int = 1

    def domain(self, source: Column) -> Column:
        found = F.lit("other")
        for name, pattern in reversed(self.domains.items()):
            found = F.when(F.regexp_like(source, F.lit(pattern)), F.lit(name)).otherwise(found)
        return found

    def weight(self, level: str, name: Column) -> Column:
        found = F.lit(1)
        for key, weight in self.weights.get(level, {}).items():
            found = F.when(name == key, F.lit(weight)).otherwise(found)
        return found.cast("long")

    def key(self, epoch: Column, doc_id: Column) -> Column:
        """The place of a document in an epoch, below 2 ** 60."""
        text = F.concat_ws("|", F.lit(str(self.seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("")))
        return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


PRODUCTION = Mixture(
    domains={"web": r"^src[0-9]$", "books": r"^src1[0-3]$", "news": r"^src1[4-6]$"},
    weights={"domain": {"web": 4, "books": 3, "news": 2}, "lang": {"en": 6, "de": 2, "fr": 2}, "source": {"src0": 2}},
    share=(6, 10),
    max_epochs=4,
    seed=2024,
)


def _filled(nodes: DataFrame, parent: list[str], level: str, mixture: Mixture) -> DataFrame:
    """Budgets of the children of each parent: ``nodes`` has budget (the parent's) and cap.

    Children in the order of cap over weight: those up to some place get all they can
    supply, the others share the rest by weight.
    """
    n = nodes.withColumn("w", mixture.weight(level, F.col(level)))
    every = Window.partitionBy(*parent)
    order = every.orderBy(F.col("cap") / F.col("w"), level)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    n = n.withColumn("cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0).cast("long")))
    n = n.withColumn("w_left", F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0).cast("long")))
    full = F.col("cap") * F.col("w_left") <= (F.col("budget") - F.col("cap_before")) * F.col("w")
    n = n.withColumn("full", F.min(F.when(full, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    cap_full = F.sum(F.when(F.col("full") == 1, F.col("cap")).otherwise(0)).over(every)
    w_rest = F.sum(F.when(F.col("full") == 1, 0).otherwise(F.col("w"))).over(every)
    n = n.withColumn("cap_full", cap_full).withColumn("w_rest", w_rest)
    share = F.expr("((budget - cap_full) * w) div nullif(w_rest, 0)")
    return n.withColumn("budget", F.when(F.col("full") == 1, F.col("cap")).otherwise(share)).drop("w", "cap_before", "w_left", "full", "cap_full", "w_rest")


def budgets(leaves: DataFrame, mixture: Mixture) -> DataFrame:
    """(domain, lang, source, tokens, docs, budget) from (domain, lang, source, tokens, docs)."""
    leaves = leaves.withColumn("cap", F.col("tokens") * mixture.max_epochs)
    a, b = mixture.share
    total = leaves.agg(F.expr(f"(sum(tokens) * {a}) div {b}")).first()[0] or 0
    above = leaves.groupBy("domain").agg(F.sum("cap").alias("cap")).withColumns({"budget": F.lit(total).cast("long"), "root": F.lit(0)})
    domain = _filled(above, ["root"], "domain", mixture).select("domain", "budget")
    lang = _filled(leaves.groupBy("domain", "lang").agg(F.sum("cap").alias("cap")).join(domain, "domain"), ["domain"], "lang", mixture).select("domain", "lang", "budget")
    return _filled(leaves.join(lang, ["domain", "lang"]), ["domain", "lang"], "source", mixture).select(*LEVELS, "tokens", "docs", "budget")


def _named(df: DataFrame, mixture: Mixture, id_col: str, text_col: str, lang_col: str, source_col: str) -> dict[str, Column]:
    source = F.coalesce(F.col(source_col), F.lit(""))
    return {"id": F.col(id_col), "domain": mixture.domain(source), "lang": F.coalesce(F.col(lang_col), F.lit("")), "source": source, "n_tokens": word_count(F.col(text_col))}


def plan(rows: DataFrame, mixture: Mixture) -> DataFrame:
    """What each leaf takes: (domain, lang, source, epochs, cut_key, cut_share).

    ``epochs`` whole epochs; of the next, rows below ``cut_key`` whole and rows at it up to
    ``cut_share`` tokens (null: none of it).
    """
    leaves = rows.filter("n_tokens > 0").groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("docs"))
    taken = budgets(cut(leaves), mixture).select(*LEVELS, F.expr("budget div tokens").alias("epochs"), F.expr("budget % tokens").alias("rest"), F.ceil(F.pow("docs", F.lit(_BUCKET_POWER))).alias("buckets"))
    taken = cut(taken)
    keyed = rows.filter("n_tokens > 0").join(broadcast_if_small(taken.filter("rest > 0")), list(LEVELS))
    keyed = keyed.withColumn("key", mixture.key(F.col("epochs"), F.col("id")))
    keyed = cut(keyed.select(*LEVELS, "rest", "key", "n_tokens", F.expr(f"cast(shiftright(key, {_HASH_BITS - 30}) * buckets / {1 << 30} as long)").alias("bucket")))
    order = Window.partitionBy(*LEVELS).orderBy("bucket")
    sums = keyed.groupBy(*LEVELS, "rest", "bucket").agg(F.sum("n_tokens").alias("held"))
    sums = sums.withColumn("before", F.sum("held").over(order) - F.col("held")).filter("before < rest AND rest <= before + held")
    ends = cut(sums.select(*LEVELS, "bucket", "before"))
    units = keyed.join(broadcast_if_small(ends), [*LEVELS, "bucket"]).groupBy(*LEVELS, "rest", "before", "key").agg(F.sum("n_tokens").alias("held"), F.count(F.lit(1)).alias("rows"))
    order = Window.partitionBy(*LEVELS).orderBy("key")
    units = units.withColumn("before", F.col("before") + F.sum("held").over(order) - F.col("held")).filter("before < rest AND rest <= before + held")
    ends = units.select(*LEVELS, F.col("key").alias("cut_key"), F.expr("(rest - before) div rows").alias("cut_share"))
    return cut(taken.drop("rest", "buckets").join(ends, list(LEVELS), "left"))


def _epochs(rows: DataFrame, taken: DataFrame, mixture: Mixture) -> DataFrame:
    """Rows once per epoch that takes them, with ``epoch`` and ``take_tokens``."""
    found = rows.join(broadcast_if_small(taken), list(LEVELS)).filter("n_tokens > 0")
    found = found.withColumn("key", F.when(F.col("cut_key").isNotNull(), mixture.key(F.col("epochs"), F.col("id"))))
    part = F.when(F.col("key") < F.col("cut_key"), F.col("n_tokens")).when(F.col("key") == F.col("cut_key"), F.least("n_tokens", "cut_share")).otherwise(0)
    found = found.withColumn("part", part)
    last = F.col("epochs") - F.when(F.col("part") > 0, 0).otherwise(1)
    found = found.filter(last >= 0).withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    return found.withColumn("take_tokens", F.when(F.col("epoch") == F.col("epochs"), F.col("part")).otherwise(F.col("n_tokens")))


def select(df: DataFrame, mixture: Mixture, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``id_col``, domain, lang, source, epoch, n_tokens, take_tokens of each row taken."""
    rows = cut(df.select(*[c.alias(n) for n, c in _named(df, mixture, id_col, text_col, lang_col, source_col).items()]))
    found = _epochs(rows, plan(rows, mixture), mixture)
    return found.select(F.col("id").alias(id_col), *LEVELS, "epoch", "n_tokens", "take_tokens")


def mix(df: DataFrame, mixture: Mixture, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", chars_col: str | None = None) -> DataFrame:
    """The rows taken, with all columns of ``df``; a row is repeated for each epoch that takes it.

    The last row of a leaf's prefix is cut after its last token, white space before that as it
    was; ``chars_col`` is then set to the length of the text.
    """
    named = _named(df, mixture, id_col, text_col, lang_col, source_col)
    rows = cut(df.select(*[c.alias(n) for n, c in named.items()]))
    found = _epochs(nested(df, **named), plan(rows, mixture), mixture)
    text = F.col("row").getField(text_col)
    tokens = F.regexp_extract_all(text, F.lit(f"{SPACE}*{WORD}"), F.lit(0))
    partly = F.col("take_tokens") < F.col("n_tokens")
    found = found.withColumn("new", F.when(partly, F.array_join(F.slice(tokens, 1, F.col("take_tokens").cast("int")), "")))
    replaced = {text_col: F.coalesce("new", text)}
    if chars_col is not None:
        replaced[chars_col] = F.when(partly, F.length("new").cast(df.schema[chars_col].dataType)).otherwise(F.col("row").getField(chars_col))
    return unnested(found, df.columns, **replaced)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select(table(spark, sf_dir, "documents"), PRODUCTION)


def _level_sql(name: str, source: str, parent: str, level: str, keys: str, mixture: Mixture) -> str:
    weights = mixture.weights.get(level, {})
    w = f"CASE {' '.join(f"WHEN {level} = '{k}' THEN {v}" for k, v in weights.items())} ELSE 1 END" if weights else "1"
    return f"""
{name}_a AS (SELECT *, {w} AS w FROM ({source})),
{name}_b AS (SELECT *, coalesce(sum(cap) OVER (PARTITION BY {parent} ORDER BY cap / w, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cap_before,
  sum(w) OVER (PARTITION BY {parent}) - coalesce(sum(w) OVER (PARTITION BY {parent} ORDER BY cap / w, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS w_left FROM {name}_a),
{name}_c AS (SELECT *, min(CASE WHEN cap * w_left <= (parent_budget - cap_before) * w THEN 1 ELSE 0 END) OVER (PARTITION BY {parent} ORDER BY cap / w, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS is_full FROM {name}_b),
{name}_d AS (SELECT *, sum(CASE WHEN is_full = 1 THEN cap ELSE 0 END) OVER (PARTITION BY {parent}) AS cap_full, sum(CASE WHEN is_full = 1 THEN 0 ELSE w END) OVER (PARTITION BY {parent}) AS w_rest FROM {name}_c),
{name} AS (SELECT {keys}, CASE WHEN is_full = 1 THEN cap ELSE ((parent_budget - cap_full) * w) // nullif(w_rest, 0) END AS budget FROM {name}_d)"""


def _oracle(m: Mixture) -> str:
    domain = f"CASE {' '.join(f"WHEN regexp_matches(s, '{r}') THEN '{d}'" for d, r in m.domains.items())} ELSE 'other' END"
    a, b = m.share
    key = f"('0x' || substr(md5(concat_ws('|', '{m.seed}', epochs::VARCHAR, coalesce(doc_id::VARCHAR, ''))), 1, 15))::BIGINT"
    return f"""
WITH named AS (SELECT doc_id, {domain} AS domain, coalesce(lang, '') AS lang, s AS source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS n_tokens FROM (SELECT *, coalesce(source, '') AS s FROM documents)),
leaves AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS tokens, sum(n_tokens)::BIGINT * {m.max_epochs} AS cap FROM named WHERE n_tokens > 0 GROUP BY ALL),
{_level_sql("d", f"SELECT domain, sum(cap)::BIGINT AS cap, (SELECT (sum(tokens)::BIGINT * {a}) // {b} FROM leaves) AS parent_budget FROM leaves GROUP BY domain", "1", "domain", "domain", m)},
{_level_sql("l", "SELECT x.domain, lang, sum(cap)::BIGINT AS cap, any_value(d.budget) AS parent_budget FROM leaves x JOIN d ON x.domain = d.domain GROUP BY x.domain, lang", "domain", "lang", "domain, lang", m)},
{_level_sql("s", "SELECT x.*, l.budget AS parent_budget FROM leaves x JOIN l ON x.domain = l.domain AND x.lang = l.lang", "domain, lang", "source", "domain, lang, source, tokens", m)},
taken AS (SELECT n.*, s.budget // s.tokens AS epochs, s.budget % s.tokens AS rest FROM named n JOIN s ON n.domain = s.domain AND n.lang = s.lang AND n.source = s.source WHERE n_tokens > 0),
keyed AS (SELECT *, {key} AS k FROM taken),
placed AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY k RANGE UNBOUNDED PRECEDING) - sum(n_tokens) OVER (PARTITION BY domain, lang, source, k) AS before, count(*) OVER (PARTITION BY domain, lang, source, k) AS ties, sum(n_tokens) OVER (PARTITION BY domain, lang, source, k) AS held FROM keyed),
parted AS (SELECT *, CASE WHEN before + held < rest THEN n_tokens WHEN before < rest THEN least(n_tokens, (rest - before) // ties) ELSE 0 END AS part FROM placed)
SELECT doc_id, domain, lang, source, epoch::BIGINT AS epoch, n_tokens::BIGINT AS n_tokens, CASE WHEN epoch = epochs THEN part ELSE n_tokens END::BIGINT AS take_tokens
FROM (SELECT *, unnest(range(0, (epochs + CASE WHEN part > 0 THEN 1 ELSE 0 END)::BIGINT)) AS epoch FROM parted)
"""


ORACLE = _oracle(PRODUCTION)
