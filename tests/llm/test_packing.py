import zlib

import public_tokenizers
import pytest
from pyspark.sql import Row
from tokenizers import Tokenizer

from patternlake.llm.common import table
from patternlake.llm.packing import ByteLevelEncoder, op8_packing, pack, piece_lengths, write_buckets

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_piece_lengths():
    assert piece_lengths(1, 2048) == [1]
    assert piece_lengths(5000, 2048) == [2048, 2048, 512, 256, 128, 8]
    for n in range(1, 300):
        got = piece_lengths(n, 64)
        assert sum(got) == n and all(x & (x - 1) == 0 for x in got)


@pytest.fixture(scope="module")
def cases():
    long = "word and  more\n\n text " * 3000
    return [(1, "hello world"), (2, None), (3, ""), (4, long), (5, "a <|endoftext|> b"), (5, "a <|endoftext|> b"), (None, " x  y ")]


def test_pieces_hold_every_id_once(spark, cases):
    df = spark.createDataFrame(cases, "doc_id long, text string").selectExpr("*", "'x' AS start", "0 AS ids")
    rows = pack(df, tokenizer_path=PATH).collect()
    tok = Tokenizer.from_file(PATH)
    assert len({r.sequence_id for r in rows}) == len(rows)
    want = {}
    for doc_id, text in cases:
        ids = tok.encode(text or "", add_special_tokens=False).ids + [1]
        want.setdefault(doc_id, []).append(b"".join(i.to_bytes(4, "little") for i in ids))
    got = {}
    for r in rows:
        assert len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32 and r.offset == 0
        assert r.length & (r.length - 1) == 0 and r.length <= 2048
        got.setdefault(r.doc_id, []).append(r)
    for doc_id, raws in want.items():
        pieces = sorted(got[doc_id], key=lambda r: r.start)
        assert sum(r.length for r in pieces) == sum(len(x) // 4 for x in raws)
        first = [r for i, r in enumerate(pieces) if i == 0 or r.start != pieces[i - 1].start]
        assert b"".join(bytes(r.ids) for r in first) == raws[0] and first[0].doc_tokens == len(raws[0]) // 4


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert pack(df, tokenizer_path=PATH).collect() == []
    assert pack(df, tokenizer_path=PATH, with_ids=False).columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def test_rejects_other_lengths(spark):
    with pytest.raises(ValueError):
        pack(spark.createDataFrame([Row(doc_id=1, text="a")]), tokenizer_path=PATH, max_len=1000)


def test_all_documents_against_the_tokenizer(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text or "" for r in table(spark, sf, "documents").select("doc_id", "text").collect()}
    tok = Tokenizer.from_file(PATH)
    ids = {i: e.ids + [1] for i, e in zip(texts, tok.encode_batch(list(texts.values()), add_special_tokens=False), strict=True)}
    pieces = {}
    for r in op8_packing(spark, sf).collect():
        raw = b"".join(x.to_bytes(4, "little") for x in ids[r.doc_id][r.start : r.start + r.length])
        assert len(raw) == 4 * r.length and zlib.crc32(raw) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
        assert r.sequence_id >> 58 == r.length.bit_length() - 1 and r.offset == 0
        pieces.setdefault(r.doc_id, []).append((r.start, r.length))
    assert pieces.keys() == ids.keys()
    assert all([n for _, n in sorted(p)] == piece_lengths(len(ids[i]), 2048) for i, p in pieces.items())


def test_buckets_are_folders(spark, cases, tmp_path):
    df = pack(spark.createDataFrame(cases, "doc_id long, text string"), tokenizer_path=PATH)
    write_buckets(df, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.filter("bucket <> length").isEmpty() and back.count() == df.count()
    assert {p.name for p in (tmp_path / "out").glob("bucket=*")} == {f"bucket={r.length}" for r in df.select("length").distinct().collect()}


def test_other_tokenizers_are_refused():
    import json

    with open(PATH, encoding="utf-8") as file:
        spec = json.load(file)
    ByteLevelEncoder._check(spec)
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace", "add_prefix_space": False}}, {"pre_tokenizer": spec["pre_tokenizer"] | {"use_regex": False}}, {"model": spec["model"] | {"dropout": 0.1}}, {"model": spec["model"] | {"merges": spec["model"]["merges"][::-1]}}):
        with pytest.raises(ValueError):
            ByteLevelEncoder._check(spec | change)
