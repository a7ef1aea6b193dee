"""Repeated byte strings by sharded suffix arrays.

A byte goes if a ``length``-byte window over it also starts anywhere else in the corpus.

1. *Anchors.*  Every window of ``length`` bytes is assigned to the smallest hash among its
   ``_GRAM``-byte substrings (leftmost on ties).  The choice depends on the window's bytes
   alone, so equal windows share an anchor hash and their offset from it.  Consecutive
   windows with one anchor form a run.  Only anchor hashes that occur twice can hold a
   repeat; the rest of the corpus, usually most of it, is done here.
2. *Variants.*  Runs with equal hash and equal bytes collapse to one variant.  A variant
   seen twice is a repeat as it stands, so copies of whole documents, however many, end
   here.
3. *Shards.*  The remaining variants go to shards by anchor hash.  A shard sorts its
   suffixes by Larsson-Sadakane refinement (ranks double in depth, only groups that are
   still tied are sorted again), takes the common prefixes of neighbouring windows by
   Kasai's rule, run along all variants at once, and marks windows whose common prefix
   with a neighbour reaches ``length``.
4. *Merging.*  An anchor hash with more bytes than a shard holds is split over several.
   Each then emits its distinct windows of that hash as sorted 128-bit keys, cut into
   ``_FAN`` key ranges.  A task merges one range of up to ``_FAN`` shards pairwise by binary
   search, keeps one of equal windows and cuts what is left into ``_FAN`` finer ranges, and
   so on up a tree until all shards of the hash have met.  Each level has ``_FAN`` rows per
   shard and tasks of one shard's size, so work and rows are linear in the bytes, up to the
   tree's height.
5. *Texts.*  Marked windows return to their texts, merge into maximal runs and are cut out.

Texts are keyed by 128 bits of their SHA-256, variants by the 64-bit anchor hash together
with 64 bits over the run.  All passes are linear in the input; texts move at most twice,
and one copy of each.

Defined results: a null text is empty; texts below ``length`` bytes are left alone; equal
texts of ``length`` bytes or more are removed whole, all of them; repeated rows and null
ids count like any other rows; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patternlake.llm.common import slices, table, utf8
from patternlake.plans.lineage import cut, release

_GRAM = 32
_SHARD_BYTES = 1 << 20
_SPLIT_BYTES = 2 << 20
_FAN_BITS = 6
_FAN = 1 << _FAN_BITS
_SLICE_BYTES = 512 << 10
_CHUNK = 1 << 19
_EMPTY = hashlib.sha256(b"").hexdigest()
_BYTE = np.random.default_rng(20).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """64-bit hash of the ``_GRAM`` bytes from each position on."""
    h, size, factor = _BYTE[data], 1, 0x9E3779B97F4A7C15
    while size < _GRAM:
        h = h[:-size] * np.uint64(factor) + h[size:]
        factor, size = factor * factor % (1 << 64), 2 * size
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def runs(data: np.ndarray, bounds: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Runs of windows with one anchor: (text, first window, last window, anchor, hash).

    ``data`` holds texts end to end, ``bounds`` their ends; places are relative to ``data``.
    """
    if len(data) < length:
        return
    ends = bounds
    for first in range(0, len(data) - length + 1, _CHUNK):
        part = data[first : first + _CHUNK + length - 1]
        grams = gram_hashes(part)
        span = length - _GRAM + 1
        low = grams & ~np.uint64((1 << 20) - 1) | np.arange(len(grams), dtype=np.uint64)
        size = 1
        while 2 * size <= span:
            low = np.minimum(low[:-size], low[size:])
            size *= 2
        if span > size:
            low = np.minimum(low[: size - span], low[span - size :])
        anchor = (low & np.uint64((1 << 20) - 1)).astype(np.int64)
        window = np.arange(first, first + len(anchor))
        text = np.searchsorted(ends, window, side="right")
        valid = window + length <= ends[text]
        change = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (valid[1:] != valid[:-1]) | (text[1:] != text[:-1])])
        begin = np.flatnonzero(change)
        stop = np.append(begin[1:], len(anchor)) - 1
        keep = valid[begin]
        begin, stop = begin[keep], stop[keep]
        yield text[begin], window[begin], window[stop], anchor[begin] + first, grams[anchor[begin]]


def _pack(pos: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    return pos << 20 | (pos - lo) << 10 | (hi - lo)


def anchors(df: DataFrame, length: int) -> DataFrame:
    """(h, s, k1, k2, packed, copies) of each run of each text in column ``raw``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["h", "s", "k1", "k2", "packed", "copies"]
        for batch in batches:
            copies: dict[bytes, int] = {}
            for part in slices(batch, "raw", _SLICE_BYTES):
                for value in utf8(part.column("raw")):
                    if len(value) >= length:
                        key = hashlib.sha256(value).digest()[:16]
                        copies[key] = copies.get(key, 0) + 1
            done: set[bytes] = set()
            for part in slices(batch, "raw", _SLICE_BYTES):
                values, keys = [], []
                for value in utf8(part.column("raw")):
                    if len(value) >= length and (key := hashlib.sha256(value).digest()[:16]) not in done:
                        done.add(key)
                        values.append(value)
                        keys.append(key)
                if not values:
                    continue
                whole = b"".join(values)
                view, digest = memoryview(whole), xxhash.xxh64_intdigest
                bounds = np.cumsum([len(v) for v in values])
                key_pairs = np.frombuffer(b"".join(keys), ">i8").astype(np.int64).reshape(-1, 2)
                count = np.array([copies[k] for k in keys], np.int64)
                for text, lo, hi, pos, h in runs(np.frombuffer(whole, np.uint8), bounds, length):
                    s = [digest(view[a : b + length], (c - a) << 10 | (b - a)) for a, b, c in zip(lo.tolist(), hi.tolist(), pos.tolist(), strict=True)]
                    base = np.concatenate([[0], bounds])[text]
                    columns = [h.view(np.int64), np.array(s, np.uint64).view(np.int64), key_pairs[text, 0], key_pairs[text, 1], _pack(pos - base, lo - base, hi - base), count[text]]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    return df.select("raw").mapInArrow(run, "h long, s long, k1 long, k2 long, packed long, copies long")


# ---------------------------------------------------------------- suffix arrays


def big_endian_words(data: np.ndarray, room: int) -> np.ndarray:
    """The eight bytes from each position on, zeros beyond the end."""
    padded = np.concatenate([data, np.zeros(room + 8, np.uint8)])
    words = np.zeros(len(data) + room, np.uint64)
    for j in range(8):
        words = words << np.uint64(8) | padded[j : j + len(words)]
    return words


def suffix_order(words: np.ndarray, n: int) -> np.ndarray:
    """The suffix array of ``n`` bytes (Larsson-Sadakane refinement).

    A suffix's rank is the place of the first member of its group of ties; the depth to
    which ranks hold doubles in each round, and groups of one are final.
    """
    order = np.argsort(words[:n])
    key = words[order]
    place = np.arange(n)
    fresh = np.concatenate([[True], key[1:] != key[:-1]])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(fresh, place, 0))
    depth = 8
    tied = place[~(fresh & np.append(fresh[1:], True))]
    while len(tied):
        suffix = order[tied]
        after = suffix + depth
        # Suffixes that end before the depth stand first, the shorter the earlier.
        second = np.where(after < n, rank[np.minimum(after, n - 1)] + n + 1, n - suffix)
        key = rank[suffix] * (2 * n + 2) + second
        by = np.argsort(key)
        suffix, key = suffix[by], key[by]
        order[tied] = suffix
        fresh = np.concatenate([[True], key[1:] != key[:-1]])
        rank[suffix] = np.maximum.accumulate(np.where(fresh, tied, 0))
        tied = tied[~(fresh & np.append(fresh[1:], True))]
        depth *= 2
    return order


def common_prefixes(words: np.ndarray, before: np.ndarray, starts: np.ndarray, counts: np.ndarray, limit: int) -> np.ndarray:
    """Kasai: the common prefix, up to ``limit``, of each window with the one before it in order.

    ``before`` maps a window's place to that of its predecessor (-1: none; -2: no window).
    Step ``j`` takes window ``j`` of every run; a window keeps its predecessor's length less
    one where that predecessor's successor is a window too.
    """
    found = np.zeros(len(before), np.int64)
    by = np.argsort(-counts)
    starts, counts = starts[by], counts[by]
    h, last = np.zeros(len(starts), np.int64), np.full(len(starts), -1)
    for j in range(int(counts.max(initial=0))):
        live = int(np.searchsorted(-counts, -j, side="left"))
        i = starts[:live] + j
        p = before[i]
        chained = (last[:live] >= 0) & (before[last[:live] + 1] != -2)
        h = np.where(chained, np.maximum(h[:live] - 1, 0), 0)
        open_ = np.flatnonzero((p >= 0) & (h < limit))
        while len(open_):
            at = h[open_]
            differ = words[i[open_] + at] ^ words[p[open_] + at]
            same = sum(((differ >> np.uint64(56 - 8 * b)) == 0).astype(np.int64) for b in range(8))
            h[open_] = np.minimum(at + same, limit)
            open_ = open_[(same == 8) & (h[open_] < limit)]
        h[p < 0] = 0
        found[i] = h
        last = p
    return found


def marked_windows(segments: list[bytes], counts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places, class numbers and repeat marks of all windows of the segments of one shard.

    Segment ``i`` holds ``counts[i]`` windows; windows of equal bytes share a class.
    """
    data = np.frombuffer(b"".join(segments), np.uint8)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in segments])[:-1]]).astype(np.int64)
    words = big_endian_words(data, length)
    order = suffix_order(words, len(data))
    before = np.full(len(data) + 1, -2, np.int64)
    windows = np.repeat(starts - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(int(counts.sum()))
    before[windows] = -1
    order = order[before[order] == -1]
    before[order[1:]] = order[:-1]
    prefix = common_prefixes(words, before, starts, counts, length)
    equal = np.concatenate([[False], prefix[order[1:]] >= length])
    mark, group = np.zeros(len(data), bool), np.zeros(len(data), np.int64)
    mark[order] = equal | np.append(equal[1:], False)
    group[order] = np.cumsum(~equal)
    return windows, group[windows], mark[windows]


#: Marked windows (s, a, b), or a run of sorted windows of a split hash (family, piece, keys, refs).
_FOUND = "h long, s long, a int, b int, family int, piece long, keys binary, refs binary"
_ARROW_FOUND = pa.schema([("h", pa.int64()), ("s", pa.int64()), ("a", pa.int32()), ("b", pa.int32()), ("family", pa.int32()), ("piece", pa.int64()), ("keys", pa.binary()), ("refs", pa.binary())])


def _found(columns: list[list]) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW_FOUND, strict=True)], schema=_ARROW_FOUND)


def _ranges(out: list[list], h: int, member: int, piece: int, level: int, keys: np.ndarray, refs: np.ndarray) -> None:
    """Add the ``_FAN`` ranges of a sorted run to ``out``: those of the level's bits of the keys' first halves."""
    part = keys[:, 0] >> np.uint64(64 - _FAN_BITS * level) & np.uint64(_FAN - 1)
    edges = np.searchsorted(part, np.arange(_FAN + 1).astype(np.uint64))
    for p in range(_FAN):
        a, b = int(edges[p]), int(edges[p + 1])
        if b > a:
            for column, value in zip(out, (h, None, None, None, member >> _FAN_BITS, piece << _FAN_BITS | p, keys[a:b].tobytes(), refs[a:b].tobytes()), strict=True):
                column.append(value)


def _intervals(mark: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], mark.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1


def _shard(length: int):
    """The work of one shard: marked intervals of its variants, and sorted runs of split hashes."""

    def work(rows: pa.Table) -> pa.Table:
        rows = rows.select(["h", "s", "parts", "part", "windows", "segment"])
        seen: set[tuple[int, int]] = set()
        h, s, parts, part, counts, segments = [], [], [], [], [], []
        for r in rows.to_pylist():
            if (r["h"], r["s"]) not in seen:
                seen.add((r["h"], r["s"]))
                h.append(r["h"])
                s.append(r["s"])
                parts.append(r["parts"])
                part.append(r["part"])
                counts.append(r["windows"])
                segments.append(r["segment"])
        counts_a = np.array(counts, np.int64)
        windows, group, mark = marked_windows(segments, counts_a, length)
        ends = np.cumsum(counts_a)
        out: list[list] = [[] for _ in _ARROW_FOUND]
        split: dict[int, list[int]] = {}
        for i, end in enumerate(ends.tolist()):
            for a, b in zip(*(x.tolist() for x in _intervals(mark[end - counts[i] : end])), strict=True):
                for column, value in zip(out, (h[i], s[i], a, b, None, None, None, None), strict=True):
                    column.append(value)
            if parts[i] > 1:
                split.setdefault(h[i], []).append(i)
        for hot, members in split.items():
            where = np.concatenate([np.arange(ends[i] - counts[i], ends[i]) for i in members])
            owner = np.repeat([s[i] for i in members], counts_a[members])
            number = np.concatenate([np.arange(counts[i]) for i in members])
            _, first = np.unique(group[where], return_index=True)  # one window of each class
            whole, at = [segments[i] for i in members], np.repeat(np.arange(len(members)), counts_a[members])
            keys = np.frombuffer(b"".join(xxhash.xxh3_128_digest(whole[at[k]][number[k] : number[k] + length]) for k in first.tolist()), ">u8").astype(np.uint64).reshape(-1, 2)
            by = np.lexsort((keys[:, 1], keys[:, 0]))
            keys, first = keys[by], first[by]
            refs = np.stack([owner[first], number[first], np.zeros(len(first), np.int64)], axis=1).astype(np.int64)
            _ranges(out, hot, min(part[i] for i in members), 0, 1, keys, refs)
        return _found(out)

    return work


def merge_sorted(runs_: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merge sorted runs (keys, refs, marks) pairwise; equal keys of two runs get marked.

    The shorter run is placed in the longer by binary search over the keys' first halves;
    candidates with an equal first half are confirmed on the second.
    """
    while len(runs_) > 1:
        merged = []
        for left, right in zip(runs_[::2], runs_[1::2], strict=False):
            if len(left[0]) < len(right[0]):
                left, right = right, left
            (lk, lr, lm), (rk, rr, rm) = left, right
            lm, rm = lm.copy(), rm.copy()
            at = np.searchsorted(lk[:, 0], rk[:, 0])
            stop = np.searchsorted(lk[:, 0], rk[:, 0], side="right")
            for k in range(int((stop - at).max(initial=0))):
                near = np.minimum(at + k, len(lk) - 1)
                hit = (at + k < stop) & (lk[near, 1] == rk[:, 1])
                lm[near[hit]] = True
                rm[hit] = True
            merged.append((np.insert(lk, at, rk, axis=0), np.insert(lr, at, rr, axis=0), np.insert(lm, at, rm)))
        if len(runs_) % 2:
            merged.append(runs_[-1])
        runs_ = merged
    return runs_[0]


def _merge(level: int, last: bool):
    """The work of one range of the shards of a family: windows that two of them hold, and the run for the next level.

    The third number of a reference tells windows that are marked already.
    """

    def work(rows: pa.Table) -> pa.Table:
        runs_ = [(np.frombuffer(k, np.uint64).reshape(-1, 2), np.frombuffer(r, np.int64).reshape(-1, 3)) for k, r in zip(rows.column("keys").to_pylist(), rows.column("refs").to_pylist(), strict=True)]
        keys, refs, marks = merge_sorted([(k, r, np.zeros(len(k), bool)) for k, r in runs_])
        h, family, piece = (rows.column(c)[0].as_py() for c in ("h", "family", "piece"))
        new = refs[marks & (refs[:, 2] == 0)]
        out = [[h] * len(new), new[:, 0].tolist(), new[:, 1].tolist(), new[:, 1].tolist(), *([None] * len(new) for _ in range(4))]
        if not last:
            by = np.lexsort((keys[:, 1], keys[:, 0]))
            keys, refs, marks = keys[by], refs[by].copy(), marks[by]
            refs[:, 2] |= marks
            first = np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)])
            _ranges(out, h, family, piece, level + 1, keys[first], refs[first])
        return _found(out)

    return work


# ---------------------------------------------------------------- plan


def _segments(df: DataFrame, length: int) -> DataFrame:
    """The bytes of each wanted run, from texts with lists of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["shard", "h", "s", "parts", "part", "windows", "segment"]
        for batch in batches:
            for part in slices(batch, "raw", _SLICE_BYTES):
                columns: list[list] = [[] for _ in names]
                for value, wanted in zip(part.column("raw").to_pylist(), part.column("wanted").to_pylist(), strict=True):
                    for w in wanted:
                        packed = w["packed"]
                        lo, windows = (packed >> 20) - (packed >> 10 & 1023), (packed & 1023) + 1
                        for column, x in zip(columns, (w["shard"], w["h"], w["s"], w["parts"], w["part"], windows, value[lo : lo + windows - 1 + length]), strict=True):
                            column.append(x)
                types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return df.mapInArrow(run, "shard long, h long, s long, parts int, part int, windows int, segment binary")


def _spans(df: DataFrame, length: int) -> DataFrame:
    """Maximal removed runs of each text, from its marked window intervals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, spans = [], []
            for marked in batch.column("marked").to_pylist():
                merged: list[list[int]] = []
                for a, b in sorted((m["a"], m["b"] + length) for m in marked):
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], b)
                    else:
                        merged.append([a, b])
                removed.append(sum(b - a for a, b in merged))
                spans.append(merged)
            yield pa.RecordBatch.from_arrays([batch.column("k1"), batch.column("k2"), pa.array(removed, pa.int64()), pa.array(spans, pa.list_(pa.list_(pa.int64())))], names=["k1", "k2", "n_removed", "spans"])

    return df.mapInArrow(run, "k1 long, k2 long, n_removed long, spans array<array<long>>")


def _without(df: DataFrame, with_text: bool) -> DataFrame:
    """Texts without their spans: digest, and the bytes themselves if asked for."""
    kind = df.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "raw", _SLICE_BYTES):
                digests, chars, kept = [], [], []
                for value, spans in zip(part.column("raw").to_pylist(), part.column("spans").to_pylist(), strict=True):
                    at, pieces = 0, []
                    for a, b in spans or ():
                        pieces.append(value[at:a])
                        at = b
                    rest = b"".join([*pieces, value[at:]])
                    digests.append(hashlib.sha256(rest).hexdigest())
                    chars.append(len(rest.decode("utf-8", "ignore")))
                    kept.append(rest)
                columns = [*(part.column(c) for c in ("id", "n_bytes", "n_removed", "n_spans")), pa.array(digests, pa.string()), pa.array(chars, pa.int64())]
                names = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_chars"]
                if with_text:
                    columns.append(pa.array(kept, pa.binary()))
                    names.append("kept")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return df.select("id", "n_bytes", "n_removed", "n_spans", "raw", "spans").mapInArrow(run, f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_chars long" + (", kept binary" if with_text else ""))


def repeats(rows: DataFrame, texts: DataFrame, length: int) -> DataFrame:
    """(k1, k2, n_removed, spans) of the texts that lose bytes."""
    every = cut(anchors(texts, length))
    twice = cut(every.groupBy("h").agg(F.sum("copies").alias("n")).filter("n > 1").select("h"))
    live = cut(every.join(twice, "h", "left_semi"))
    release(every, twice)
    variants = cut(live.groupBy("h", "s").agg(F.sum("copies").alias("n"), F.min(F.struct("k1", "k2", "packed")).alias("rep")))
    windows = F.col("rep.packed").bitwiseAND(1023) + 1
    groups = variants.groupBy("h").agg(F.count(F.lit(1)).alias("variants"), F.count_if(F.col("n") == 1).alias("single"), F.sum(windows - 1 + length).alias("bytes"))
    groups = cut(groups.filter("variants > 1 AND single > 0"))
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    shards = total // _SHARD_BYTES + 1
    parts = F.ceil(F.col("bytes") / _SPLIT_BYTES).cast("int")
    needed = variants.join(groups.select("h", parts.alias("parts")), "h")
    needed = needed.withColumn("part", F.pmod(F.xxhash64("s"), F.col("parts")).cast("int"))
    shard = F.pmod(F.xxhash64("h", F.when(F.col("parts") > 1, F.col("part"))), F.lit(shards))
    wanted = needed.select("rep.k1", "rep.k2", F.struct("h", "s", "parts", "part", "rep.packed", shard.alias("shard")).alias("w")).groupBy("k1", "k2").agg(F.collect_list("w").alias("wanted"))
    owners = rows.groupBy("k1", "k2").agg(F.min("id").alias("id"))
    wanted = cut(wanted.join(owners, ["k1", "k2"]))
    w = wanted.select(F.col("k1").alias("w1"), F.col("k2").alias("w2"), F.col("id").alias("w_id"), "wanted")
    segments = _segments(texts.join(w, (F.col("k1") == F.col("w1")) & (F.col("k2") == F.col("w2")) & F.col("id").eqNullSafe(F.col("w_id"))).select("raw", "wanted"), length)
    found = cut(segments.groupBy("shard").applyInArrow(_shard(length), _FOUND))
    release(wanted)
    pairs = found.filter("keys IS NULL").select("h", "s", "a", "b")
    most, level = groups.agg(F.max(parts)).first()[0] or 1, 1
    while most > 1:  # all shards of a hash have met when one family is left
        most = -(-most // _FAN)
        found = cut(found.filter("keys IS NOT NULL").groupBy("h", "family", "piece").applyInArrow(_merge(level, most == 1), _FOUND))
        pairs = pairs.unionByName(found.filter("keys IS NULL").select("h", "s", "a", "b"))
        level += 1
    repeated = variants.filter("n > 1").select("h", "s", F.lit(0).alias("a"), (windows - 1).cast("int").alias("b"))
    marked = cut(repeated.unionByName(pairs))
    release(found, variants, groups)
    first = F.shiftright("packed", 20) - F.shiftright("packed", 10).bitwiseAND(1023)
    back = live.join(marked, ["h", "s"]).select("k1", "k2", F.struct((first + F.col("a")).alias("a"), (first + F.col("b")).alias("b")).alias("m"))
    return cut(_spans(back.groupBy("k1", "k2").agg(F.collect_set("m").alias("marked")), length))


def remove_repeats(df: DataFrame, *, length: int = 400, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """``id_col``, n_bytes, n_removed, n_spans, kept_sha256, kept_chars and, on request, kept (the bytes left).

    ``kept_chars`` counts the whole characters among the bytes left.
    """
    if not _GRAM < length <= 1023:
        raise ValueError(f"length must be above {_GRAM} and below 1024")
    raw = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    sha = F.sha2(raw, 256)
    half = [F.conv(F.substring("sha", at, 16), 16, -10).cast("long").alias(k) for at, k in ((1, "k1"), (17, "k2"))]
    chars = F.coalesce(F.length(F.col(text_col)), F.lit(0)).cast("long")
    texts = df.select(F.col(id_col).alias("id"), raw.alias("raw"), sha.alias("sha"), chars.alias("kept_chars")).select("id", "raw", "sha", "kept_chars", *half)
    rows = cut(texts.select("id", F.octet_length("raw").cast("long").alias("n_bytes"), "kept_chars", "sha", "k1", "k2"))
    spans = repeats(rows, texts, length)
    judged = cut(rows.join(spans, ["k1", "k2"], "left"))
    judged = judged.withColumn("n_removed", F.coalesce("n_removed", F.lit(0).cast("long"))).withColumn("n_spans", F.coalesce(F.size("spans"), F.lit(0)).cast("long"))
    judged = judged.withColumn("n_spans", F.greatest("n_spans", F.lit(0).cast("long")))
    partly = judged.filter("n_removed > 0 AND n_removed < n_bytes") if not with_text else judged
    p = partly.select(F.col("id").alias("p_id"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), "n_bytes", "n_removed", "n_spans", "spans")
    if with_text:
        p = p.dropDuplicates(["p_id", "p1", "p2"])
    cut_out = _without(texts.join(p, (F.col("k1") == F.col("p1")) & (F.col("k2") == F.col("p2")) & F.col("id").eqNullSafe(F.col("p_id"))), with_text)
    if with_text:
        return cut_out.withColumnRenamed("id", id_col)
    rest = judged.filter("n_removed = 0 OR n_removed = n_bytes")
    rest = rest.select("id", "n_bytes", "n_removed", "n_spans", F.when(F.col("n_removed") > 0, F.lit(_EMPTY)).otherwise(F.col("sha")).alias("kept_sha256"), F.when(F.col("n_removed") > 0, 0).otherwise(F.col("kept_chars")).cast("long").alias("kept_chars"))
    return rest.unionByName(cut_out).withColumnRenamed("id", id_col)


def op5_suffixdedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
