"""Quality rules with risk-controlled thresholds, in built-in expressions only.

A rule rejects a text if a per-mille ratio of two of its counts is above a cutoff.  The
cutoffs of each stratum (language) come from labelled texts of good quality:

* Only texts that pass the base rule are calibrated on, and the promise is about them.
* A labelled id votes once, however often it is repeated (with the text of the smallest
  MD5), and ids with equal texts of one stratum vote once together, as good if any is: ``n``
  counts texts that were drawn independently, or the bound would hold for copies only.
* A cutoff's false rejections among ``n`` good texts are binomial.  It is certified if
  P(Bin(n, alpha / rules) <= k) is at most delta / (strata * rules), the exact
  (Clopper-Pearson) bound with Bonferroni's correction; alpha is split over the rules, so
  the rules together reject a share of alpha at most of a stratum's good texts that pass the
  base rule.
* Within a rule and stratum, cutoffs are tested from the loosest on and testing stops at
  the first that fails, which needs no further correction (fixed-sequence testing).
* Of the certified cutoffs the one is taken that rejects most bad texts, less
  ``GOOD_WEIGHT`` for each good one, the loosest on ties; a rule without a gain is not used.

With probability 1 - delta all chosen cutoffs hold their bound.  The calibration table has
strata * rules * cutoffs rows; texts are read by column expressions, and only counts are
shuffled.

Defined results: a null text has no words and fails the base rule; texts of strata without
certified cutoffs pass the method; a null stratum is a stratum of its own; labels that
conflict for an id count as good, labels without a text are ignored; repeated rows are
kept and change no cutoff; an empty table gives no rows; other columns, whatever their
names, are ignored by ``judge`` and kept by ``keep_good``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from patternlake.llm.common import SPACE, blank_trimmed, nested, table, unnested
from patternlake.plans.lineage import broadcast_if_small, cut

#: Cutoffs in thousandths, from the loosest to the strictest.
CUTOFFS = (5000, 3000, 2000, 1500, 1000, 900, 800, 700, 600, 500, 400, 300, 250, 200, 150, 120, 100, 80, 60, 50, 40, 30, 20)


@dataclass(frozen=True)
class Rule:
    name: str
    above: str
    below: str


RULES = (
    Rule("symbols", "n_symbols", "n_words"),
    Rule("capitals", "n_capitals", "word_chars"),
    Rule("lines", "n_dup_lines", "n_lines"),
    Rule("repeats", "n_repeat_words", "n_words"),
)
ALPHA, DELTA = 0.1, 0.1
#: A good text lost weighs as much as so many bad ones kept, among certified cutoffs.
GOOD_WEIGHT = 20
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals")


def with_counts(df: DataFrame, text: Column) -> DataFrame:
    """``df`` with the counts of each whole text, in columns of ``COUNTS``.

    No column of ``df`` may have the name of a count or begin with an underscore.  Repeated three-word windows come from the sorted array of (window hash, place): equal
    neighbours are repeats, and the union of their words is a running sum over places.
    """
    trimmed, text = blank_trimmed(text), F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: F.regexp_like(line, F.lit(r"[^\x20\x09-\x0D]")))
    out = df.withColumn("_w", F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"{SPACE}+")))
    out = out.withColumn("_l", lines)
    w = F.col("_w")
    windows = F.when(F.size(w) >= 3, F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i"))))
    out = out.withColumn("_g", F.sort_array(F.coalesce(windows, F.array().cast("array<struct<h:bigint,i:int>>"))))
    g = F.col("_g")
    same = lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False))
    twice = F.transform(F.filter(g, lambda x, k: same(x, F.get(g, k - 1)) | same(x, F.get(g, k + 1))), lambda x: x["i"])
    out = out.withColumn("_r", F.sort_array(twice))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
    repeat = F.aggregate("_r", start, lambda a, i: F.struct((a["n"] + i + 3 - F.greatest(i, a["end"])).cast("long").alias("n"), (i + 3).alias("end")), lambda a: a["n"])
    counts = {
        "n_words": F.size(w),
        "word_chars": F.length(F.array_join(w, "")),
        "n_symbols": F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")),
        "n_dup_lines": F.size("_l") - F.size(F.array_distinct("_l")),
        "n_repeat_words": repeat,
        "n_lines": F.size("_l"),
        "n_capitals": F.length(F.regexp_replace(text, r"[^A-Z]+", "")),
    }
    # A generator of one row: filters on the counts stay above it, so that the optimizer
    # doesn't put the arrays' expressions into one another.
    one = F.explode(F.array(F.struct(*[v.cast("long").alias(k) for k, v in counts.items()]))).alias("_q")
    return out.select(*df.columns, one).select(*df.columns, "_q.*")


def base_failed() -> Column:
    words = F.col("n_words")
    return (words < 50) | (100 * F.col("n_repeat_words") > 50 * words)


def _log_gamma(x: Column) -> Column:
    """Stirling's series, shifted by eight."""
    z = x + 8.0
    shift = F.log(x)
    for k in range(1, 8):
        shift = shift + F.log(x + float(k))
    series = 1 / (12 * z) - 1 / (360 * F.pow(z, F.lit(3.0))) + 1 / (1260 * F.pow(z, F.lit(5.0))) - 1 / (1680 * F.pow(z, F.lit(7.0)))
    return (z - 0.5) * F.log(z) - z + F.lit(0.9189385332046727) + series - shift


def binomial_cdf(k: Column, n: Column, p: float) -> Column:
    """P(Bin(n, p) <= k) by exact terms, from the k-th downward.

    Below the mean, terms fall off within some twelve deviations; those beyond are left out.
    """
    kd, nd = k.cast("double"), n.cast("double")
    log_term = _log_gamma(nd + 1) - _log_gamma(kd + 1) - _log_gamma(nd - kd + 1) + kd * F.log(F.lit(p)) + (nd - kd) * F.log(F.lit(1 - p))
    steps = F.least(k, F.ceil(12 * F.sqrt(nd * p)) + 50).cast("int")
    zero = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))

    def step(a: Column, j: Column) -> Column:
        i = kd - j.cast("double") + 1  # from term i to term i - 1
        term = a["term"] * i / (nd - i + 1) * ((1 - p) / p)
        return F.struct(term.alias("term"), (a["total"] + term).alias("total"))

    total = F.aggregate(F.when(steps > 0, F.sequence(F.lit(1), steps)).otherwise(F.array().cast("array<int>")), zero, step, lambda a: a["total"])
    return F.when(kd >= nd * p, F.lit(1.0)).otherwise(F.exp(log_term) * total)


def cutoffs(labelled: DataFrame, *, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """(stratum, one column per rule): the chosen cutoff in thousandths, null for none.

    ``labelled``: stratum, good (boolean) and the columns of ``COUNTS`` of labelled texts.
    """
    levels = F.array(*[F.lit(c) for c in CUTOFFS])
    last = len(CUTOFFS) - 1

    def over(rule: Rule) -> Column:
        return F.size(F.filter(levels, lambda c: 1000 * F.col(rule.above) > c * F.col(rule.below)))

    per_rule = F.array(*[F.struct(F.lit(r.name).alias("rule"), over(r).alias("over")) for r in RULES])
    cells = labelled.select("stratum", "good", F.explode(per_rule).alias("x")).groupBy("stratum", "x.rule", "x.over")
    cells = cells.agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad"))
    # A text above m cutoffs is above the m strictest.
    grid = cells.select("stratum", "rule", "over", "good", "bad", F.explode(F.sequence(F.lit(0), F.lit(last))).alias("level"))
    above = F.col("level") > last - F.col("over")
    grid = grid.groupBy("stratum", "rule", "level").agg(F.sum("good").alias("n"), F.sum(F.when(above, F.col("good")).otherwise(0)).alias("k"), F.sum(F.when(above, F.col("bad")).otherwise(0)).alias("bad"))
    families = labelled.select("stratum").distinct().count() * len(RULES)
    certified = binomial_cdf(F.col("k"), F.col("n"), alpha / len(RULES)) * families <= delta
    order = Window.partitionBy("stratum", "rule").orderBy("level")
    tested = grid.select("stratum", "rule", "level", (F.col("bad") - GOOD_WEIGHT * F.col("k")).alias("gain"), F.min(F.when(certified, 1).otherwise(0)).over(order).alias("ok"))
    best = Window.partitionBy("stratum", "rule").orderBy(F.desc("gain"), "level")
    chosen = tested.filter("ok = 1 AND gain > 0").withColumn("place", F.row_number().over(best)).filter("place = 1")
    return chosen.groupBy("stratum").agg(*[F.max(F.when(F.col("rule") == r.name, F.get(levels, F.col("level")))).alias(r.name) for r in RULES])


def passes() -> Column:
    """The method's verdict, with the chosen cutoffs in columns of the rules' names."""
    verdict = F.lit(True)
    for r in RULES:
        verdict = verdict & ~F.coalesce(1000 * F.col(r.above) > F.col(r.name) * F.col(r.below), F.lit(False))
    return verdict


def _rows(df: DataFrame, stratum_col: str, id_col: str, text_col: str) -> DataFrame:
    stratum = F.coalesce(F.col(stratum_col).cast("string"), F.lit(""))
    return df.select(F.col(id_col).alias("id"), stratum.alias("stratum"), F.col(text_col).alias("text"))


def _good(labels: DataFrame, label_col: str, id_col: str) -> DataFrame:
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    return known.groupBy(F.col(id_col).alias("label_id")).agg((F.max(label_col) == 1).alias("good"))


def _votes(counted: DataFrame) -> DataFrame:
    """(stratum, good, counts): one row for each labelled text; ``counted`` has digest and good."""
    one = counted.groupBy("id").agg(F.min(F.struct("digest", "stratum", "good", *COUNTS)).alias("x")).select("x.*").filter(~base_failed())
    return one.groupBy("stratum", "digest").agg(F.max("good").alias("good"), *[F.max(c).alias(c) for c in COUNTS]).drop("digest")


def judge(df: DataFrame, labels: DataFrame, *, label_col: str = "quality", stratum_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, the counts, base_failed and kept of each row."""
    rows = _rows(df, stratum_col, id_col, text_col).withColumn("digest", F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    counted = cut(with_counts(rows, F.col("text")).drop("text"))
    labelled = counted.join(_good(labels, label_col, id_col), F.col("id") == F.col("label_id"))
    chosen = broadcast_if_small(cut(cutoffs(cut(_votes(labelled)))))
    judged = counted.join(chosen, "stratum", "left").select(F.col("id").alias(id_col), *COUNTS, base_failed().alias("base_failed"), passes().alias("passed"))
    return judged.select(id_col, *COUNTS, "base_failed", (~F.col("base_failed") & F.col("passed")).alias("kept"))


def keep_good(df: DataFrame, labels: DataFrame, *, label_col: str = "quality", stratum_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df``, all columns, that the rules keep.

    Labelled texts are counted for the cutoffs, and all texts for the filter, which is a map.
    """
    rows = _rows(df, stratum_col, id_col, text_col)
    good = broadcast_if_small(cut(_good(labels, label_col, id_col)))
    labelled = rows.join(good, F.col("id") == F.col("label_id")).withColumn("digest", F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    chosen = cut(cutoffs(cut(_votes(with_counts(labelled, F.col("text"))))))
    stratum = F.coalesce(F.col("row").getField(stratum_col).cast("string"), F.lit(""))
    counted = with_counts(nested(df), F.col("row").getField(text_col)).withColumn("stratum", stratum)
    kept = counted.join(broadcast_if_small(chosen), "stratum", "left").filter(~base_failed() & passes())
    return unnested(kept, df.columns)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", *COUNTS[:5], "base_failed", "kept", *COUNTS[5:])


def _oracle() -> str:
    space = r"[\x20\x09-\x0D]"
    rules = len(RULES)
    p = ALPHA / rules
    rule_rows = " UNION ALL ".join(f"SELECT stratum, good, '{r.name}' AS rule, {r.above} AS a, {r.below} AS b FROM labelled" for r in RULES)
    picked = ", ".join(f"max(cutoff) FILTER (rule = '{r.name}') AS c_{r.name}" for r in RULES)
    verdict = " AND ".join(f"NOT coalesce(1000 * {r.above} > c_{r.name} * {r.below}, FALSE)" for r in RULES)
    return f"""
WITH texts AS (SELECT row_number() OVER () AS rn, doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS t FROM documents),
parts AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM texts),
grams AS (SELECT rn, i, concat_ws(' ', w[i], w[i + 1], w[i + 2]) AS g FROM (SELECT rn, w, unnest(range(1, len(w) - 1)) AS i FROM parts WHERE len(w) >= 3)),
twice AS (SELECT rn, i, count(*) OVER (PARTITION BY rn, g) AS n FROM grams),
repeats AS (SELECT rn, count(DISTINCT i + d) AS n_repeat_words FROM twice, (VALUES (0), (1), (2)) v(d) WHERE n > 1 GROUP BY rn),
counted AS (SELECT p.rn, doc_id, stratum, t, len(w) AS n_words, length(regexp_replace(t, '{space}+', '', 'g')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
  len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, len(l) AS n_lines, length(regexp_replace(t, '[^A-Z]+', '', 'g')) AS n_capitals FROM parts p LEFT JOIN repeats r ON p.rn = r.rn),
based AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted),
good AS (SELECT doc_id, max(quality) = 1 AS good FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
voting AS (SELECT b.*, good FROM based b JOIN good l ON b.doc_id = l.doc_id QUALIFY row_number() OVER (PARTITION BY b.doc_id ORDER BY md5(t), b.stratum) = 1),
labelled AS (SELECT stratum, t, bool_or(good) AS good, {", ".join(f"max({c}) AS {c}" for c in COUNTS)} FROM voting WHERE NOT base_failed GROUP BY stratum, t),
cutoffs(cutoff, level) AS (VALUES {", ".join(f"({c}, {i})" for i, c in enumerate(CUTOFFS))}),
per_rule AS ({rule_rows}),
grid AS (SELECT stratum, rule, cutoff, level, count(*) FILTER (good) AS n, count(*) FILTER (good AND 1000 * a > cutoff * b) AS k, count(*) FILTER (NOT good AND 1000 * a > cutoff * b) AS bad FROM per_rule, cutoffs GROUP BY ALL),
tested AS (SELECT *, bad - {GOOD_WEIGHT} * k AS gain, CASE WHEN k >= n * {p} THEN 1.0 ELSE list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({p}) + (n - i) * ln(1 - {p})))) END AS tail FROM grid),
sequence AS (SELECT *, bool_and(tail * (SELECT count(DISTINCT stratum) FROM labelled) * {rules} <= {DELTA}) OVER (PARTITION BY stratum, rule ORDER BY level) AS ok FROM tested),
chosen AS (SELECT stratum, rule, cutoff FROM sequence WHERE ok AND gain > 0 QUALIFY row_number() OVER (PARTITION BY stratum, rule ORDER BY gain DESC, level) = 1),
picked AS (SELECT stratum, {picked} FROM chosen GROUP BY stratum)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_capitals, base_failed, NOT base_failed AND {verdict} AS kept FROM based b LEFT JOIN picked p ON b.stratum = p.stratum
"""


ORACLE = _oracle()
