"""Packing by power-of-two decomposition.

Every document is tokenised, closed with an end id and cut into pieces whose lengths
are powers of two: as many pieces of ``max_len`` as fit, then the binary digits of the
rest from the largest down.  Each piece is a sequence of its own, so no sequence
crosses documents, none is padded, and the sequences of one length form a bucket that
a trainer can batch without attention masks.  Ids of one bucket's sequences lie together:
they are made of the bucket (the length's logarithm), the task and the position among the
task's pieces of that bucket.  ``write_buckets`` writes a folder for each bucket.

The operator is a single map over the scan: no shuffle, and memory follows one slice of
texts.

Defined results: a null text counts as empty (its only id is the end id); repeated rows
and repeated or null document ids give their own sequences; an empty table gives no
rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
import sys
import zlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patternlake.llm.common import slices, table

_SLICE_BYTES = 4 << 20


def piece_lengths(n: int, max_len: int) -> list[int]:
    """Lengths of the pieces of ``n`` tokens; ``max_len`` is a power of two."""
    rest = n % max_len
    return [max_len] * (n // max_len) + [1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1]


def sequence_id(bucket: int, task: int, place: int) -> int:
    """5 bits of bucket, 24 of task, 34 of the place among the task's sequences of that bucket."""
    return bucket << 58 | task << 34 | place


class ByteLevelEncoder:
    """Ids of whole texts as little-endian 32-bit bytes, for a byte-level BPE file.

    The vocabulary of the tokenizer file is handed to the faster of the two installed BPE
    engines, which gives the same ids (the tests compare both); texts that hold the string
    of a special token go through the tokenizer itself.
    """

    def __init__(self, path: str) -> None:
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self._check(spec)
        self._special = [t["content"] for t in spec["added_tokens"]]
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        code = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in plain)}
        ranks = {bytes(code[c] for c in word): i for word, i in spec["model"]["vocab"].items() if word not in self._special}
        self._slow = Tokenizer.from_file(path)
        self._fast = tiktoken.Encoding("from-file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    @staticmethod
    def _check(spec: dict) -> None:
        """That both engines split and merge alike: refuse whatever the faster one has no word for."""
        before, model = spec["pre_tokenizer"], spec["model"]
        if before is None or before["type"] != "ByteLevel" or before["add_prefix_space"] or not before.get("use_regex", True):
            raise ValueError("a byte-level tokenizer with its own pattern and without prefix space is needed")
        if spec.get("normalizer") is not None or spec.get("truncation") is not None or spec.get("padding") is not None:
            raise ValueError("a tokenizer without normalizer, truncation and padding is needed")
        if model["type"] != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
            raise ValueError("a plain BPE model is needed")
        # Ranks are ids: merges must make words in the order of their ids.
        merged = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        if any(a >= b for a, b in zip(merged, merged[1:], strict=False)):
            raise ValueError("the merges are not in the order of the words' ids")

    def encode(self, text: str) -> bytes:
        if any(s in text for s in self._special):
            ids = self._slow.encode(text, add_special_tokens=False).ids
        else:
            ids = self._fast.encode_ordinary(text)
        return array("I", ids).tobytes() if sys.byteorder == "little" else b"".join(i.to_bytes(4, "little") for i in ids)


def pack(
    df: DataFrame,
    *,
    tokenizer_path: str,
    max_len: int = 2048,
    end_id: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = True,
) -> DataFrame:
    """One row per piece.

    Columns: ``id_col``, start, length, ids_crc32, doc_tokens, sequence_id, offset and,
    unless ``with_ids`` is false, ids (little-endian unsigned 32-bit).  ``length`` is the
    bucket of the piece's sequence.
    """
    if max_len < 1 or max_len & (max_len - 1):
        raise ValueError("max_len must be a power of two")
    id_type = df.select(F.col(id_col).alias("id")).schema["id"].dataType.simpleString()
    schema = f"id {id_type}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    schema += ", ids binary" if with_ids else ""
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ByteLevelEncoder(tokenizer_path)
        task, made = TaskContext.get().partitionId(), [0] * max_len.bit_length()
        crc = zlib.crc32
        for batch in batches:
            for part in slices(batch, "text", _SLICE_BYTES):
                row, start, length, crcs, total, numbers, raw = [], [], [], [], [], [], []
                for i, text in enumerate(part.column("text").to_pylist()):
                    ids = encoder.encode(text or "") + end
                    n, at = len(ids) // 4, 0
                    view = memoryview(ids)
                    for size in piece_lengths(n, max_len):
                        row.append(i)
                        start.append(at)
                        length.append(size)
                        total.append(n)
                        piece = view[4 * at : 4 * (at + size)]
                        crcs.append(crc(piece))
                        bucket = size.bit_length() - 1
                        numbers.append(sequence_id(bucket, task, made[bucket]))
                        made[bucket] += 1
                        if with_ids:
                            raw.append(bytes(piece))
                        at += size
                ids_of = part.column("id").take(pa.array(row, pa.int64()))
                columns = [ids_of, *(pa.array(c, pa.int64()) for c in (start, length, crcs, total, numbers, [0] * len(row)))]
                names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
                if with_ids:
                    columns.append(pa.array(raw, pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def write_buckets(pieces: DataFrame, path: str) -> None:
    """One folder of Parquet files for each length; sequences within are in the order of their ids."""
    pieces.withColumn("bucket", F.col("length")).sortWithinPartitions("bucket", "sequence_id").write.partitionBy("bucket").parquet(path)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), tokenizer_path=public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)
