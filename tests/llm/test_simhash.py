import random

import numpy as np
import pytest
import xxhash

from patternlake.llm import simhash
from patternlake.llm.common import table
from patternlake.llm.components import components
from patternlake.llm.simhash import close_pairs, fingerprint, near_duplicates


def plain_fingerprint(text, shingle=4):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    grams = [" ".join(words[i : i + shingle]) for i in range(len(words) - shingle + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(docs):
    prints = {i: plain_fingerprint(t) for i, t in docs}
    label = {i: i for i in prints}
    changed = True
    while changed:
        changed = False
        for a in prints:
            for b in prints:
                if (prints[a] ^ prints[b]).bit_count() <= 4 and label[a] > label[b]:
                    label[a], changed = label[b], True
    return {i: (f"{prints[i]:016x}", label[i]) for i in prints}


def test_fingerprint_matches_plain_form():
    for text in ["", " \n", "One", "one two\tthree", "ÀB cd EF gh ij", "a b c d " * 40, "ab " * 20_000]:
        assert fingerprint(text.encode(), 4) == plain_fingerprint(text)


def test_close_pairs_match_brute_force():
    rnd = np.random.default_rng(0)
    base = rnd.integers(0, 2**63, 40, dtype=np.int64)
    fps = np.concatenate([base] + [base ^ (np.int64(1) << rnd.integers(0, 62, 40)) ^ (np.int64(1) << rnd.integers(0, 62, 40)) ^ np.int64(x) for x in (0, 3, 7, 15)])
    keys = np.sort(rnd.integers(0, 3, len(fps)))
    for radius in (1, 3, 4, 6):
        i, j = map(np.concatenate, zip(*close_pairs(keys, fps, radius), strict=True))
        want = {(a, b) for a in range(len(fps)) for b in range(a + 1, len(fps)) if keys[a] == keys[b] and (int(fps[a]) ^ int(fps[b])).bit_count() <= radius}
        got = list(zip(i.tolist(), j.tolist(), strict=True))
        assert set(got) == want and len(got) == len(want)


def test_choices_are_lossless():
    rnd = random.Random(3)
    for n in (10, 10**7, 10**10, 10**14):
        masks = simhash._choices(n, 4)
        finer = [simhash._finer(m, 4) for m in masks]
        for _ in range(200):
            d = sum(1 << b for b in rnd.sample(range(64), 4))
            assert any(not d & m for m in masks)
            assert all(any(not d & f for f in fs) for m, fs in zip(masks, finer, strict=True) if not d & m)


def test_components(spark):
    links = [(i, i + 1) for i in range(50)] + [(100, 101), (103, 101), (7, 7), (100, 101)] + [(200, x) for x in range(201, 260)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "u long, v long")).collect()))
    assert got == {**{i: 0 for i in range(1, 51)}, 101: 100, 103: 100, **{x: 200 for x in range(201, 260)}}
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []


@pytest.mark.parametrize("bucket", [2048, 3])
def test_against_brute_force(spark, sf_dir, monkeypatch, bucket):
    monkeypatch.setattr(simhash, "_BUCKET", bucket)
    docs = [tuple(r) for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    docs += [(1000, None), (1001, ""), (1002, "few words"), (1003, "few  Words\n"), (1004, "w " * 50_000), (1005, docs[0][1] + " tail")]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS fp", "'a' AS id")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in near_duplicates(df).collect()}
    assert got == plain_components(docs)


def test_repeated_rows_nulls_and_empty(spark):
    rows = near_duplicates(spark.createDataFrame([(5, "a b"), (5, "a b"), (None, "a b"), (None, "c d")], "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), str(r.component_id)) for r in rows) == [("5", "5"), ("5", "5"), ("None", "5"), ("None", "None")]
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_hot_bucket_is_split(spark, monkeypatch):
    """Fingerprints one bit apart share all buckets, however fine: chunks keep every link."""
    monkeypatch.setattr(simhash, "_BUCKET", 3)
    base = 0x0123456789ABCDEF
    fps = [base] + [base ^ 1 << b for b in range(40)] + [base ^ 7 << 50, base ^ 0x3F << 44]
    nodes = spark.createDataFrame([(f,) for f in fps], "fp long")
    found = dict(map(tuple, components(simhash.links(nodes, radius=1)).collect()))
    assert found == {f: min(fps[:41]) for f in fps[:41] if f != min(fps[:41])}
    rows = simhash._blocks(spark.createDataFrame([(1, f) for f in fps], "key long, fp long"), "fp")
    assert max(r["count"] for r in rows.groupBy("block").count().collect()) < len(fps) // 2


def test_wide_close_pairs_match_brute_force():
    rnd = np.random.default_rng(5)
    base = rnd.integers(0, 2**63, (30, 4), dtype=np.int64)
    fps = np.concatenate([base, base ^ (rnd.integers(0, 2**63, (30, 4), dtype=np.int64) & rnd.integers(0, 2**63, (30, 4), dtype=np.int64) & rnd.integers(0, 2**63, (30, 4), dtype=np.int64))])
    keys, groups = np.sort(rnd.integers(0, 3, 60)), rnd.integers(0, 4, 60)
    far = lambda a, b: sum((int(x) ^ int(y)).bit_count() for x, y in zip(fps[a], fps[b], strict=True))
    for radius in (25, 32, 80, 120):
        i, j = map(np.concatenate, zip((np.zeros(0, int),) * 2, *close_pairs(keys, fps, radius, groups), strict=True))
        want = {(a, b) for a in range(60) for b in range(a + 1, 60) if keys[a] == keys[b] and groups[a] != groups[b] and far(a, b) <= radius}
        assert set(zip(i.tolist(), j.tolist(), strict=True)) == want


def test_linked_joins_what_close_pairs_link():
    rnd = np.random.default_rng(7)
    base = rnd.integers(0, 2**63, 12, dtype=np.int64)
    fps = np.repeat(base, 20) ^ np.int64(1) << rnd.integers(0, 62, 240) ^ np.int64(1) << rnd.integers(0, 62, 240)
    keys = np.sort(rnd.integers(0, 4, 240))
    label = simhash.linked(keys, fps, 4)
    want = np.arange(240)
    for i, j in close_pairs(keys, fps, 4):
        simhash.join(want, i, j)
    plain = np.arange(240)
    for _ in range(240):
        for i, j in close_pairs(keys, fps, 4):
            for a, b in zip(i.tolist(), j.tolist(), strict=True):
                plain[a] = plain[b] = min(plain[a], plain[b])
    assert label.tolist() == want.tolist() == plain.tolist() and len(set(label.tolist())) < 100
