from patternlake.llm import mixing
from patternlake.llm.mixing import Mixture, budgets, mix, select


def test_shortages_go_to_siblings_first(spark):
    leaves = [("a", "en", "s1", 10, 1), ("a", "en", "s2", 1000, 5), ("a", "de", "s3", 1000, 5), ("b", "en", "s4", 1000, 5)]
    df = spark.createDataFrame(leaves, "domain string, lang string, source string, tokens long, docs long")
    got = {r.source: r.budget for r in budgets(df, Mixture(share=(400, 3010), max_epochs=1)).collect()}
    # 200 for each domain, 100 for each language; s1 can't take its 50, s2 takes them.
    assert got == {"s1": 10, "s2": 90, "s3": 100, "s4": 200}
    got = {r.source: r.budget for r in budgets(df, Mixture(share=(400, 3010), max_epochs=1, weights={"source": {"s2": 3}, "domain": {"b": 3}})).collect()}
    assert got == {"s1": 10, "s2": 40, "s3": 50, "s4": 300}
    got = {r.source: r.budget for r in budgets(df.filter("source <> 's2'"), Mixture(share=(1000, 2010), max_epochs=1)).collect()}
    assert got == {"s1": 10, "s3": 490, "s4": 500}
    got = {r.source: r.budget for r in budgets(df, Mixture(share=(10, 1), max_epochs=2)).collect()}
    assert got == {"s1": 20, "s2": 2000, "s3": 2000, "s4": 2000}


def docs(spark):
    rows = [(i, "w " * (i % 7), "en" if i % 2 else None, f"src{i % 3}", 2 * (i % 7)) for i in range(300)]
    rows += [(5, "w " * 5, "en", "src2", 10)] * 2 + [(None, "w w", "de", None, 3), (None, None, "de", None, None), (900, "tok " * 300, "fr", "src1", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "1 AS key", "2 AS budget", "3 AS domain")


def test_prefixes_fill_the_budgets(spark, monkeypatch):
    df = docs(spark)
    mixture = Mixture(domains={"x": "^src[01]$"}, weights={"lang": {"en": 5}}, share=(13, 10), max_epochs=3, seed=5)
    rows = select(df, mixture).collect()
    named = [(r.doc_id, "x" if r.source in ("src0", "src1") else "other", r.lang or "", r.source or "", len((r.text or "").split())) for r in df.collect()]
    leaves = {}
    for d, *leaf, n in named:
        if n:
            held = leaves.setdefault(tuple(leaf), [0, 0])
            held[0] += n
            held[1] += 1
    table = spark.createDataFrame([(*k, *v) for k, v in leaves.items()], "domain string, lang string, source string, tokens long, docs long")
    for b in budgets(table, mixture).collect():
        own = [r for r in rows if (r.domain, r.lang, r.source) == (b.domain, b.lang, b.source)]
        ties = 3
        assert b.budget - ties <= sum(r.take_tokens for r in own) <= b.budget
        assert max((r.epoch for r in own), default=0) <= 2
        last = b.budget // b.tokens
        assert sum(r.take_tokens for r in own if r.epoch < last) == last * b.tokens
        assert sum(r.take_tokens < r.n_tokens for r in own) <= ties
    monkeypatch.setattr(mixing, "_BUCKET_POWER", 0.9)
    assert sorted(select(df, mixture).collect(), key=str) == sorted(rows, key=str)
    other = select(df, Mixture(domains=mixture.domains, weights=mixture.weights, share=(13, 10), max_epochs=3, seed=6)).collect()
    assert sorted(other, key=str) != sorted(rows, key=str)


def test_mix_keeps_columns_and_cuts_texts(spark):
    df = docs(spark).selectExpr("*", *[f"'{k}' AS `{c}`" for k, c in enumerate(["_mix_key", "row", "id", "epoch", "part", "new", "take_tokens", "a.b"])])
    mixture = Mixture(share=(7, 10), max_epochs=2, seed=5)
    out = mix(df, mixture, chars_col="n_chars")
    assert out.columns == df.columns and all(list(r)[-8:] == [str(k) for k in range(8)] for r in out.collect())
    got = sorted((str(r.doc_id), len(r.text.split())) for r in out.collect())
    assert got == sorted((str(r.doc_id), r.take_tokens) for r in select(df, mixture).collect())
    assert mix(df.filter("false"), mixture).collect() == [] and select(df.filter("text IS NULL"), mixture).collect() == []


def test_cut_texts_keep_their_white_space(spark):
    text = " a b\nc  d\te\n\nf " * 20
    df = spark.createDataFrame([(1, text, "en", "s", len(text))], "doc_id long, text string, lang string, source string, n_chars long")
    for share in (1, 6, 11):
        (row,) = mix(df, Mixture(share=(share, 12)), chars_col="n_chars").collect()
        assert text.startswith(row.text) and len(row.text.split()) == 120 * share // 12 and not row.text[-1].isspace() and row.n_chars == len(row.text)
