import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from patternlake.llm import quality
from patternlake.llm.quality import COUNTS, CUTOFFS, RULES, base_failed, binomial_cdf, cutoffs, judge, keep_good, with_counts


def plain_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    places = {i + d for i, w in enumerate(windows) for d in range(3) if times[w] > 1}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(places), len(lines), len(re.findall("[A-Z]", text))


def test_counts(spark):
    rnd = random.Random(4)
    texts = [None, "", " \n\t", "a", "a b c", "a b c a b c", "a a a a a", "x\n\nx\nx \n y#$", "é|É É\x0bé\x0cÀ Z<>*", "a b c"]
    texts += [" ".join(rnd.choice("abc") for _ in range(rnd.randint(0, 60))) for _ in range(40)] + ["w " * 300 + "\n" + "long" * 3000]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {r.id: tuple(r[c] for c in COUNTS) for r in with_counts(df, F.col("text")).collect()}
    assert got == {i: plain_counts(t) for i, t in enumerate(texts)}


def test_binomial_tail(spark):
    cases = [(0, 10), (0, 400), (3, 200), (5, 1000), (60, 3000), (20, 90_000), (2300, 100_000), (0, 1), (9, 300)]
    df = spark.createDataFrame(cases, "k long, n long").withColumn("p", binomial_cdf(F.col("k"), F.col("n"), 0.025))
    for r in df.collect():
        terms = [math.exp(math.lgamma(r.n + 1) - math.lgamma(i + 1) - math.lgamma(r.n - i + 1) + i * math.log(0.025) + (r.n - i) * math.log(0.975)) for i in range(r.k + 1)]
        assert r.p == (1.0 if r.k >= r.n * 0.025 else pytest.approx(sum(terms), rel=1e-6))


def test_chosen_cutoffs_are_certified(spark):
    rnd = random.Random(8)
    rows = []
    for i in range(4000):
        good, lang = rnd.random() < 0.85, "en" if i % 4 else "de"
        symbols = rnd.randint(0, 12) if good and rnd.random() < 0.997 else rnd.randint(0, 150)
        rows.append((lang, good, 100, 500, symbols, 0, 0, 10, 20))
    df = spark.createDataFrame(rows, "stratum string, good boolean, " + ", ".join(f"{c} long" for c in COUNTS))
    got = {r.stratum: r for r in cutoffs(df).collect()}
    level = quality.ALPHA / len(RULES)
    log = lambda j, n: math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * math.log(level) + (n - j) * math.log(1 - level)
    cdf = lambda k, n: sum(math.exp(log(j, n)) for j in range(k + 1))
    for lang in ("en", "de"):
        own = [(g, 1000 * s / w) for la, g, w, _, s, *_ in rows if la == lang]
        n, best, gain = sum(g for g, _ in own), None, 0
        for c in CUTOFFS:
            k, bad = sum(g and x > c for g, x in own), sum(not g and x > c for g, x in own)
            if cdf(k, n) * 2 * len(RULES) > quality.DELTA:
                break
            if bad - quality.GOOD_WEIGHT * k > gain:
                best, gain = c, bad - quality.GOOD_WEIGHT * k
        assert (got[lang].symbols if lang in got else None) == best
        assert lang not in got or got[lang].lines is None


def test_edges(spark):
    text = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(1, text, "en"), (1, text, "en"), (2, None, None), (None, text, "de"), (3, "w " * 100_000, "en")], "doc_id long, text string, lang string")
    df = df.selectExpr("*", *[f"'{k}' AS `{c}`" for k, c in enumerate(["n_words", "stratum", "good", "row", "id", "digest", "label_id", "symbols", "_w", "_quality_symbols", "a.b"])])
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (9, 1, 0), (None, 0, 0), (2, None, 0)], "doc_id long, quality int, toxic int")
    rows = judge(df, labels).collect()
    assert sorted((str(r.doc_id), r.base_failed, r.kept) for r in rows) == [("1", False, True), ("1", False, True), ("2", True, False), ("3", True, False), ("None", False, True)]
    kept = keep_good(df, labels)
    assert kept.columns == df.columns and kept.count() == 3
    assert all(list(r)[3:] == [str(k) for k in range(11)] for r in kept.collect())
    assert judge(df.filter("false"), labels).collect() == [] and keep_good(df.filter("false"), labels.filter("false")).collect() == []


def test_both_forms_agree(spark):
    from patternlake.llm.common import table

    docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    kept = {r.doc_id for r in judge(docs, labels).filter("kept").collect()}
    assert {r.doc_id for r in keep_good(docs, labels).collect()} == kept
    assert with_counts(docs, F.col("text")).filter(~base_failed()).count() >= len(kept) > 0


def test_repeated_rows_and_copies_vote_once(spark):
    """A few labelled texts certify nothing, however often they are repeated."""
    words = lambda i: " ".join(f"w{i}x{k}" for k in range(60))
    docs = [(i, words(i) + (" #" * 60 if i >= 50 else ""), "en") for i in range(60)]
    labels = spark.createDataFrame([(i, int(i < 50)) for i in range(60)] + [(i, 1) for i in range(100, 160)] + [(i, 0) for i in range(200, 260)], "doc_id long, quality int")
    copies = [(100 + i, docs[i % 50][1], "en") for i in range(60)] + [(200 + i, docs[50 + i % 10][1], "en") for i in range(60)]
    kinds = "doc_id long, text string, lang string"
    for rows in (docs, docs * 5, docs + copies, (docs + copies)[::-1] * 2):
        df = spark.createDataFrame(rows, kinds)
        assert {r.doc_id for r in judge(df, labels).filter("kept").collect()} == {r[0] for r in rows}
        assert keep_good(df, labels).count() == len(rows)
    many = [(i, words(i) + (" #" * 60 if i % 10 == 0 else ""), "en") for i in range(3000)]
    df, many_labels = spark.createDataFrame(many, kinds), spark.createDataFrame([(i, int(i % 10 > 0)) for i in range(3000)], "doc_id long, quality int")
    kept = {r.doc_id for r in judge(df, many_labels).filter("kept").collect()}
    assert kept == {i for i in range(3000) if i % 10}
    again = df.unionByName(df.filter("doc_id % 3 = 0")).orderBy(F.rand(3))
    assert {r.doc_id for r in judge(again, many_labels).filter("kept").collect()} == kept
