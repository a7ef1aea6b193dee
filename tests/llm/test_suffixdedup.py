import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from patternlake.llm import suffixdedup
from patternlake.llm.common import table
from patternlake.llm.suffixdedup import marked_windows, merge_sorted, remove_repeats, suffix_order


def plain(docs, length):
    raws = [(i, (t or "").encode()) for i, t in docs]
    seen = Counter(hash(b[p : p + length]) for _, b in raws for p in range(len(b) - length + 1))
    out = []
    for i, b in raws:
        gone = np.zeros(len(b) + 1, np.int8)
        for p in range(len(b) - length + 1):
            if seen[hash(b[p : p + length])] > 1:
                gone[p : p + length] = 1
        spans = int((np.diff(np.concatenate([[0], gone])) == 1).sum())
        kept = bytes(np.frombuffer(b, np.uint8)[gone[:-1] == 0])
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), len(kept.decode("utf-8", "ignore"))))
    return sorted(out, key=str)


def test_suffix_order_and_marks():
    rnd = random.Random(5)
    text = bytes(rnd.choice(b"ab") for _ in range(700)) + b"abcabcabc" * 30
    for sample in (text, bytes(50), b"ab\0" * 20 + bytes(9), b"x"):
        data = np.frombuffer(sample, np.uint8)
        order = suffix_order(suffixdedup.big_endian_words(data, 40), len(data))
        assert order.tolist() == sorted(range(len(sample)), key=lambda i: sample[i:])
    segments = [text[:120], text[50:200], b"z" * 60, text[50:90]]
    counts = np.array([len(s) - 40 + 1 for s in segments])
    _, group, mark = marked_windows(segments, counts, 40)
    windows = [s[i : i + 40] for s in segments for i in range(len(s) - 39)]
    times = Counter(windows)
    assert mark.tolist() == [times[w] > 1 for w in windows]
    assert len(set(group.tolist())) == len(times) and all((group[a] == group[b]) == (windows[a] == windows[b]) for a in range(0, len(windows), 3) for b in range(0, len(windows), 5))


def test_merge_sorted_runs():
    rnd = np.random.default_rng(2)
    runs = []
    for r in range(5):
        keys = np.unique(rnd.integers(0, 60, (40, 2)).astype(np.uint64) // np.array([4, 1], np.uint64), axis=0)
        runs.append((keys, np.stack([np.full(len(keys), r), np.arange(len(keys))], axis=1), np.zeros(len(keys), bool)))
    times = Counter(tuple(k) for keys, _, _ in runs for k in keys.tolist())
    keys, refs, marks = merge_sorted(runs)
    assert len(keys) == sum(times.values())
    assert all(m == (times[tuple(runs[r][0][i].tolist())] > 1) for (r, i), m in zip(refs.tolist(), marks.tolist(), strict=True))


def corpus():
    rnd = random.Random(9)
    text = lambda n: "".join(rnd.choice("abcdefghij é\n") for _ in range(n))
    passage, page = text(450), text(3000)
    docs = [(i, text(300) + passage + text(rnd.randint(0, 400))) for i in range(12)]
    docs += [(20, page), (21, page), (22, page[:1500] + "X" + page[1500:]), (23, page[100:2000]), (24, text(399)), (25, None), (26, "")]
    docs += [(30, "ab" * 500), (31, "q" * 1500), (32, passage[:401]), (33, text(2500)), (None, page), (20, page), (34, text(100) + page[5:405] + text(100))]
    one = text(399)
    return docs + [(40, one + "k"), (41, one + "k"), (42, one + "m"), (43, text(500) * 3)]


@pytest.mark.parametrize("split,fan_bits", [(4 << 20, 6), (3000, 6), (1500, 1)])
def test_against_brute_force(spark, monkeypatch, split, fan_bits):
    monkeypatch.setattr(suffixdedup, "_FAN_BITS", fan_bits)
    monkeypatch.setattr(suffixdedup, "_FAN", 1 << fan_bits)
    monkeypatch.setattr(suffixdedup, "_SPLIT_BYTES", split)
    monkeypatch.setattr(suffixdedup, "_SHARD_BYTES", 2 * split)
    monkeypatch.setattr(suffixdedup, "_CHUNK", 1 << 11 if split < 4 << 20 else 1 << 19)
    docs = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS h", "2 AS id", "3 AS raw")
    got = sorted((tuple(r) for r in remove_repeats(df).collect()), key=str)
    assert got == plain(docs, 400)


def test_on_documents(spark, sf_dir):
    df = table(spark, sf_dir, "documents")
    docs = [tuple(r) for r in df.select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in remove_repeats(df).collect()), key=str) == plain(docs, 400)


def test_text_and_empty(spark):
    df = spark.createDataFrame([(1, "a" * 100 + "b" * 450), (2, "c" * 20 + "b" * 399), (3, "b" * 400 + "tail")], "doc_id long, text string")
    kept = {r.doc_id: bytes(r.kept) for r in remove_repeats(df, with_text=True).collect()}
    assert kept == {1: b"a" * 100, 2: b"c" * 20 + b"b" * 399, 3: b"tail"}
    assert remove_repeats(df.filter("false")).collect() == []
    with pytest.raises(ValueError):
        remove_repeats(df, length=20)


def test_hot_anchor_meets_in_a_tree(spark, monkeypatch):
    """One passage in ever other contexts: many shards of one hash, merged over several levels."""
    rows = []
    whole = suffixdedup._merge

    def counted(level, last):
        rows.append((level, last))
        return whole(level, last)

    monkeypatch.setattr(suffixdedup, "_merge", counted)
    for name, value in {"_FAN_BITS": 1, "_FAN": 2, "_SPLIT_BYTES": 4000, "_SHARD_BYTES": 4000}.items():
        monkeypatch.setattr(suffixdedup, name, value)
    rnd = random.Random(4)
    text = lambda n: "".join(rnd.choice("abcdefghij ") for _ in range(n))
    passage = text(390)
    docs = [(i, text(60) + passage + text(60)) for i in range(60)]
    docs += [(100 + i, docs[i][1][30:500] + "!" + text(20)) for i in range(0, 60, 7)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted((tuple(r) for r in remove_repeats(df).collect()), key=str) == plain(docs, 400)
    assert len(rows) > 2 and rows[-1][1] and [k for k, _ in rows] == list(range(1, len(rows) + 1))
