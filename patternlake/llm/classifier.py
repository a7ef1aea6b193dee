"""Quality classifier: Naive Bayes support vectors on n-gram indicators.

Features are the distinct byte n-grams of the whole text (lengths 2, 3 and 4), hashed to
``dims`` indicators.  Each indicator is scaled by the log ratio of its smoothed frequency
in the two classes; a linear hinge-loss model is fitted on the scaled, unit-length rows by
dual coordinate descent (Wang & Manning 2012; Hsieh et al. 2008).

Training takes the ``max_train`` labelled ids with the smallest hash; ids beyond that bound
don't enter the fit.  An id counts once, with the text of the smallest SHA-256, so neither
repeated rows nor the order of rows change the model.  Executors turn texts into indicators,
and each comes to the driver as a list of places or a bit map, whichever is shorter: at most
``max_train * dims / 8`` bytes (197 MB as registered), which is also what the fit keeps.
Scoring is one map over the scan with the weights (``dims`` numbers) in the task.

Defined results: null and empty texts score the intercept; without labelled rows, or with
one class only, every text scores the smoothed share of label 1; conflicting labels of one
id count as the smaller; repeated rows are kept; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from patternlake.llm.common import slices, table, utf8
from patternlake.plans.lineage import cut

_SLICE_BYTES = 4 << 20
_PIECE = 1 << 20


class Indicators:
    """Distinct hashed byte n-grams of one text at a time."""

    def __init__(self, dims: int) -> None:
        if dims & (dims - 1) or not 2 <= dims <= 1 << 24:
            raise ValueError("dims must be a power of two up to 2 ** 24")
        self._shift = np.uint32(33 - dims.bit_length())
        self._seen = np.zeros(dims, bool)

    def of(self, text: bytes) -> np.ndarray:
        data = np.frombuffer(text, np.uint8)
        for at in range(0, len(data), _PIECE):  # pieces overlap, so no n-gram is lost
            part = data[at : at + _PIECE + 3].astype(np.uint32)
            gram = part
            for n in (2, 3, 4):
                if len(gram) < 2:
                    break
                gram = gram[:-1] << np.uint32(8) | part[n - 1 :]
                self._seen[((gram + np.uint32(n)) * np.uint32(2654435761)) >> self._shift] = True
        found = np.flatnonzero(self._seen)
        self._seen[found] = False
        return found


def packed(found: np.ndarray, dims: int) -> bytes:
    """Sorted places below ``dims`` as a bit map of ``dims / 8`` bytes, or as a shorter list."""
    if 4 * len(found) < dims // 8:
        return found.astype("<i4").tobytes()
    bits = np.zeros(dims, np.uint8)
    bits[found] = 1
    return np.packbits(bits).tobytes()


def unpacked(data: bytes, dims: int) -> np.ndarray:
    if len(data) < dims // 8:
        return np.frombuffer(data, "<i4")
    return np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8), count=dims))


@dataclass(frozen=True)
class Model:
    """Weights of scaled indicators (already multiplied by the log-count ratios)."""

    ratio: np.ndarray
    weight: np.ndarray
    bias: float
    steepness: float

    def score(self, found: np.ndarray) -> float:
        size = float(np.sqrt((self.ratio[found] ** 2).sum()))
        margin = self.bias + (float(self.weight[found].sum()) / size if size else 0.0)
        return float(1 / (1 + np.exp(-self.steepness * margin)))


def fit(rows: list[bytes], labels: list[int], dims: int, *, c: float = 1.0, epochs: int = 30, smoothing: float = 1.0, seed: int = 7) -> Model:
    """Log-count ratios, then dual coordinate descent for the L1 hinge loss; ``rows`` are packed."""
    y = np.where(np.array(labels, np.int64) == 1, 1.0, -1.0)
    if not len(y) or (y == y[0]).all():
        share = ((y > 0).sum() + 1) / (len(y) + 2)
        return Model(np.zeros(dims), np.zeros(dims), float(np.log(share / (1 - share))), 1.0)
    counts = np.full((2, dims), smoothing)
    for row, label in zip(rows, y, strict=True):
        counts[int(label > 0), unpacked(row, dims)] += 1
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    scale = [1 / max(float(np.sqrt((ratio[unpacked(r, dims)] ** 2).sum())), 1e-12) for r in rows]
    w, bias, alpha = np.zeros(dims), 0.0, np.zeros(len(y))
    square: list[float | None] = [None] * len(y)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        most = 0.0
        for i in rng.permutation(len(y)).tolist():
            found = unpacked(rows[i], dims)
            v = (ratio[found] * scale[i]).astype(np.float32)
            if square[i] is None:
                square[i] = float(v @ v) + 1.0
            gradient = y[i] * (float(w[found] @ v) + bias) - 1
            new = min(max(alpha[i] - gradient / square[i], 0.0), c)
            step = (new - alpha[i]) * y[i]
            if step:
                most = max(most, abs(step))
                alpha[i] = new
                w[found] += step * v
                bias += step
        if most < 1e-4:
            break
    return Model(ratio, w * ratio, bias, 2.0)


def held_out(doc_id: Column) -> Column:
    """Rows that are never learnt from: CRC-32 of the id's text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1, F.lit(False))


def _indicator_rows(df: DataFrame, dims: int) -> DataFrame:
    """(key, label, found) with packed indicators; ``df``: key, label, text, of which a task takes the first of a key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        indicators, seen = Indicators(dims), set()
        for batch in batches:
            for part in slices(batch, "text", _SLICE_BYTES):
                keys = part.column("key").to_pylist()
                fresh = [k for k, key in enumerate(keys) if not (key in seen or seen.add(key))]
                part = part.take(pa.array(fresh, pa.int64()))
                found = [packed(indicators.of(t), dims) for t in utf8(part.column("text"))]
                yield pa.RecordBatch.from_arrays([part.column("key"), part.column("label"), pa.array(found, pa.binary())], names=["key", "label", "found"])

    return df.select("key", "label", "text").mapInArrow(run, "key string, label int, found binary")


def train(df: DataFrame, labels: DataFrame, *, label_col: str, max_train: int = 6000, dims: int = 1 << 18, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on labelled ids that are not held out, ``max_train`` of them at most."""
    usable = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    known = usable.groupBy(F.col(id_col).cast("string").alias("key")).agg(F.min(label_col).cast("int").alias("label"))
    docs = df.select(F.col(id_col).cast("string").alias("key"), F.col(text_col).alias("text"))
    known = known.join(docs.select("key").distinct(), "key", "left_semi")
    # At most max_train short rows: small enough to go to every executor.
    chosen = cut(known.orderBy(F.xxhash64("key"), "key").limit(max_train))
    digest = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    texts = docs.join(F.broadcast(chosen), "key").withColumn("digest", digest)
    least = cut(texts.groupBy("key").agg(F.min("digest").alias("digest")))
    # Rows of one key are equal from here on: one for each task and key, then one for each key.
    found = _indicator_rows(texts.join(F.broadcast(least), ["key", "digest"]), dims)
    rows = found.groupBy("key").agg(F.min("label").alias("label"), F.min("found").alias("found")).orderBy(F.xxhash64("key"), "key").collect()
    return fit([bytes(r["found"]) for r in rows], [r["label"] for r in rows], dims)


def score(df: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, held_out, score and predicted of every row."""
    kind = df.select(F.col(id_col).alias("id")).schema["id"].dataType.simpleString()
    dims = len(model.weight)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        indicators = Indicators(dims)
        for batch in batches:
            for part in slices(batch, "text", _SLICE_BYTES):
                scores = [model.score(indicators.of(t)) for t in utf8(part.column("text"))]
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("held_out"), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())], names=["id", "held_out", "score", "predicted"])

    rows = df.select(F.col(id_col).alias("id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, held_out boolean, score double, predicted int").withColumnRenamed("id", id_col)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return score(documents, train(documents, table(spark, sf_dir, "labels"), label_col="quality"))
