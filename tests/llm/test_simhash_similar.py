import random

import numpy as np
import pytest

from patternlake.llm import simhash


def plain_shingles(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_representatives(docs):
    """Smallest ids of the components by brute-force Jaccard, and how many pairs link."""
    sets, label, linked = {i: plain_shingles(t) for i, t in docs}, {i: i for i, _ in docs}, []
    for a in sets:
        for b in sets:
            common, every = len(sets[a] & sets[b]), len(sets[a] | sets[b])
            if a < b and 5 * common >= 4 * every:
                linked.append((a, b, common / every if every else 1.0))
    changed = True
    while changed:
        changed = False
        for a, b, _ in linked:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return set(label.values()), linked


def corpus():
    rnd = random.Random(4)
    word = lambda: rnd.choice("abcdefgh") + str(rnd.randrange(400))
    passage = [word() for _ in range(60)]
    docs = []
    for _ in range(14):
        base = [word() for _ in range(rnd.choice([60, 120, 300]))] + passage * rnd.randrange(2)
        docs.append(base)
        for share in (0.01, 0.015, 0.02, 0.025, 0.03, 0.05):
            docs.append([word() if rnd.random() < share else w for w in base])
    rnd.shuffle(docs)
    docs = list(enumerate(" ".join(d) for d in docs))
    return docs + [(900, None), (901, " \n"), (902, "few words"), (903, "Few\twords"), (904, "few other words"), (905, docs[0][1].upper())]


@pytest.mark.parametrize("frequent,bucket,large", [(4, 2048, 1 << 17), (1, 3, 1 << 17), (1, 2048, 3), (4, 3, 1)])
def test_against_brute_force_jaccard(spark, monkeypatch, frequent, bucket, large):
    monkeypatch.setattr(simhash, "_LARGE", large)
    monkeypatch.setattr(simhash, "_SAMPLE", 4)
    monkeypatch.setattr(simhash, "_FREQUENT", frequent)
    monkeypatch.setattr(simhash, "_BUCKET", bucket)
    docs = corpus()
    want, linked = plain_representatives(docs)
    assert sum(0.8 <= s < 0.9 for _, _, s in linked) > 20
    df = spark.createDataFrame(docs, "doc_id long, text string")
    df = df.selectExpr("*", *[f"'{k}' AS `{c}`" for k, c in enumerate(["fp", "id", "node", "row", "kept_id", "_kept_id", "first", "a.b"])])
    out = simhash.representatives(df)
    got = out.collect()
    assert out.columns == df.columns and {r.doc_id for r in got} == want
    assert all(list(r)[2:] == [str(k) for k in range(8)] for r in got)


def test_repeated_rows_nulls_and_empty(spark):
    rows = simhash.near_copies(spark.createDataFrame([(5, "a b"), (5, "a b"), (None, "a b"), (None, "c d")], "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), str(r.component_id)) for r in rows) == [("5", "5"), ("5", "5"), ("None", "5"), ("None", "None")]
    assert simhash.near_copies(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_wide_fingerprints_reach_the_similarity():
    """Sets at the least similarity stay far within the radius, whatever their size."""
    rng = np.random.default_rng(3)
    for n in (4, 5, 8, 9, 18, 45, 180, 900):
        for _ in range(60):
            common = rng.integers(0, 2**63, max(n - n // 9 if n > 5 else 4, 4), dtype=np.uint64)
            extra = [rng.integers(0, 2**63, len(common) // 8 if len(common) >= 8 else k, dtype=np.uint64) for k in (0, 1)]
            a, b = (simhash.wide_fingerprint(np.concatenate([common, e])) for e in extra)
            assert sum(int(x).bit_count() for x in (a ^ b).view(np.uint64)) <= simhash._WIDE_RADIUS - 5
