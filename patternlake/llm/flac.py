"""FLAC media columns: a vectorised encoder and decoder for 8-bit mono streams.

A value's bytes become signed 8-bit samples (byte minus 128) in frames of 576 samples.
Each frame is a constant, verbatim, fixed-predictor or quantised linear-predictor
subframe with Rice-coded residuals, whichever is shortest.  Frames carry CRC-8 headers
and CRC-16 footers, the stream its MD5, and a seek table with a point for every frame.

Work runs over all frames of a slice of values at once: step ``i`` decodes residual ``i``
of every frame with one set of array operations, so cost per sample does not depend on
Python loops.  Values never meet each other: the operator is one map over the scan, with
memory bounded by one slice (or the longest value).

Decoding checks the header CRC, the frame CRC, the end of every frame and the stream's
MD5, and raises ``FlacError`` on the first mismatch.  It reads all subframe types, escaped
Rice partitions and wasted bits; streams must be 8-bit mono in blocks of 576 samples.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from patternlake.llm.common import slices, table, utf8

BLOCK = 576
LPC_ORDER = 4
_PRECISION = 12
_HEADER = 42  # marker, block header and stream information
_SLICE_BYTES = 768 << 10


class FlacError(ValueError):
    """A stream that is damaged or outside the supported profile."""


def _crc_table(poly: int, bits: int) -> np.ndarray:
    crc = np.arange(256, dtype=np.uint32) << (bits - 8)
    for _ in range(8):
        crc = np.where(crc >> (bits - 1) & 1, crc << 1 ^ poly, crc << 1) & ((1 << bits) - 1)
    return crc


_CRC8 = _crc_table(0x07, 8).astype(np.uint8)
_CRC16 = _crc_table(0x8005, 16).astype(np.uint16)

def _pair_table() -> np.ndarray:
    """CRC-16 of two bytes at once, by their big-endian value."""
    word = np.arange(65536)
    first = _CRC16[word >> 8].astype(np.uint32)
    second = first ^ ((word & 255) << 8)
    return ((second << 8 & 0xFFFF) ^ _CRC16[second >> 8]).astype(np.uint16)


_CRC16_PAIR = _pair_table()


def crc8(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-8 of each span of ``data``; spans are a few bytes long."""
    crc = np.zeros(len(starts), np.uint8)
    for i in range(int(lengths.max(initial=0))):
        live = lengths > i
        crc[live] = _CRC8[crc[live] ^ data[starts[live] + i]]
    return crc


def crc16(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-16 of each span: spans are right-aligned, as leading zeros change nothing."""
    width = int(lengths.max(initial=0))
    width += width & 1
    columns = np.arange(width)[None, :] - (width - lengths)[:, None]
    aligned = np.where(columns >= 0, data[np.maximum(starts[:, None] + columns, 0)], 0).astype(np.uint8)
    words = np.ascontiguousarray(aligned.view(">u2").astype(np.uint16).T)
    crc = np.zeros(len(starts), np.uint16)
    for row in words:
        crc = _CRC16_PAIR[crc ^ row]
    return crc


# ---------------------------------------------------------------- encoding


def _fold(residual: np.ndarray) -> np.ndarray:
    return (residual << 1) ^ (residual >> 31)


def _rice(folded: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The best Rice parameter of each row, and the bits that it takes."""
    n = folded.shape[1]
    guess = np.log2(np.maximum(folded.mean(axis=1), 1)).astype(np.int64)
    best_k, best = np.zeros(len(folded), np.int64), np.full(len(folded), np.iinfo(np.int64).max)
    for shift in (-1, 0, 1):
        k = np.clip(guess + shift, 0, 14)
        bits = (folded >> k[:, None].astype(folded.dtype)).sum(axis=1, dtype=np.int64) + n * (k + 1)
        better = bits < best
        best_k, best = np.where(better, k, best_k), np.where(better, bits, best)
    return best_k, best


def _linear_predictor(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Quantised coefficients, shift and residuals of order ``LPC_ORDER`` for each row."""
    windowed = x * np.hanning(BLOCK + 2)[1:-1].astype(np.float32)
    auto = np.stack([(windowed[:, lag:] * windowed[:, : BLOCK - lag]).sum(axis=1, dtype=np.float64) for lag in range(LPC_ORDER + 1)], axis=1)
    auto[:, 0] = auto[:, 0] * (1 + 1e-6) + 1e-3
    coef, error = np.zeros((len(x), LPC_ORDER)), auto[:, 0].copy()
    for i in range(LPC_ORDER):  # Levinson-Durbin, all rows at once
        reflect = (auto[:, i + 1] - sum((coef[:, j] * auto[:, i - j] for j in range(i)), np.zeros(len(x)))) / error
        before = coef.copy()
        coef[:, i] = reflect
        for j in range(i):
            coef[:, j] = before[:, j] - reflect * before[:, i - 1 - j]
        error *= 1 - reflect**2
    most = np.maximum(np.abs(coef).max(axis=1), 1e-9)
    shift = np.clip(_PRECISION - 2 - np.floor(np.log2(most)).astype(np.int64), 0, 15)
    limit = (1 << (_PRECISION - 1)) - 1
    q = np.clip(np.rint(coef * (1 << shift)[:, None]), -limit - 1, limit).astype(np.int32)
    predicted = np.zeros((len(x), BLOCK - LPC_ORDER), np.int32)
    for j in range(LPC_ORDER):
        predicted += q[:, j : j + 1] * x[:, LPC_ORDER - 1 - j : BLOCK - 1 - j]
    return q, shift, x[:, LPC_ORDER:] - (predicted >> shift[:, None].astype(np.int32))


def _numbers(index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frame numbers in the format's UTF-8-like code: bytes (7 columns) and their count."""
    index = index.astype(np.int64)
    size = 1 + np.searchsorted(np.array([1 << 7, 1 << 11, 1 << 16, 1 << 21, 1 << 26, 1 << 31]), index, side="right")
    out = np.zeros((len(index), 7), np.int64)
    for n in np.unique(size):
        rows = size == n
        value = index[rows]
        if n == 1:
            out[rows, 0] = value
            continue
        for j in range(n - 1, 0, -1):
            out[rows, j] = 0x80 | (value & 63)
            value = value >> 6
        out[rows, 0] = (0xFF << (8 - n) & 0xFF) | value
    return out, size


def _frames(x: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Frame bytes of sample rows ``x``: all of them, and each frame's start and length."""
    n = len(x)
    kinds, bits, ks, folds = [], [], [], []
    residual = x
    for order in range(3):  # fixed predictors
        folded = _fold(residual)
        k, cost = _rice(folded)
        kinds.append(8 + order)
        bits.append(cost + 8 * order + 10)
        ks.append(k)
        folds.append(folded)
        residual = residual[:, 1:] - residual[:, :-1]
    q, shift, residual = _linear_predictor(x)
    folded = _fold(residual)
    k, cost = _rice(folded)
    kinds.append(32 + LPC_ORDER - 1)
    bits.append(cost + 8 * LPC_ORDER + 9 + LPC_ORDER * _PRECISION + 10)
    ks.append(k)
    folds.append(folded)
    choice = np.argmin(np.stack([*bits, np.full(n, 8 * BLOCK)]), axis=0)
    kind = np.array([*kinds, 1])[choice]
    kind[(x == x[:, :1]).all(axis=1)] = 0
    choice[kind == 0] = len(kinds)

    # One row of fields per frame: header bytes, subframe header, predictor, residual or samples.
    width = 12 + 1 + 4 + 1 + LPC_ORDER + 1 + BLOCK
    value, size, signif = (np.zeros((n, width), t) for t in (np.int32, np.int32, np.int8))

    def put(rows: np.ndarray, column: int, what: np.ndarray, n_bits: int) -> None:
        value[rows, column], size[rows, column], signif[rows, column] = np.asarray(what) & ((1 << n_bits) - 1), n_bits, n_bits

    everything = np.ones(n, bool)
    code, code_size = _numbers(index)
    for j, byte in enumerate((0xFF, 0xF8, 0x24, 0x02)):
        put(everything, j, np.full(n, byte), 8)
    for j in range(int(code_size.max())):
        rows = code_size > j
        put(rows, 4 + j, code[rows, j], 8)
    head = np.concatenate([np.tile(np.array([0xFF, 0xF8, 0x24, 0x02], np.uint8), (n, 1)), code.astype(np.uint8)], axis=1)
    put(everything, 11, crc8(head.ravel(), np.arange(n) * head.shape[1], 4 + code_size), 8)
    put(everything, 12, kind << 1, 8)
    put(kind == 0, 13, x[kind == 0, 0], 8)
    body = 12 + 1 + 4 + 1 + LPC_ORDER + 1
    for c, what in enumerate(kinds):
        rows = np.flatnonzero(kind == what)
        if not len(rows):
            continue
        order = what - 8 if what < 32 else what - 31
        for j in range(order):
            put(rows, 13 + j, x[rows, j], 8)
        if what >= 32:
            put(rows, 17, (_PRECISION - 1) << 5 | shift[rows], 9)
            for j in range(order):
                put(rows, 18 + j, q[rows, j], _PRECISION)
        k = ks[c][rows].astype(np.int32)[:, None]
        put(rows, body - 1, k[:, 0], 10)  # method 0, partition order 0, parameter
        folded = folds[c][rows]
        value[rows, body + order :] = folded & ((1 << k) - 1) | 1 << k
        size[rows, body + order :] = (folded >> k) + 1 + k
        signif[rows, body + order :] = k + 1
    rows = kind == 1
    value[rows, body:], size[rows, body:], signif[rows, body:] = x[rows] & 255, 8, 8

    total = size.sum(axis=1, dtype=np.int64)
    length = (total + 7) // 8 + 2
    start = np.concatenate([[0], np.cumsum(length)[:-1]])
    ends = np.cumsum(size, axis=1, dtype=np.int64) + 8 * start[:, None]
    used = signif.ravel() > 0
    value, ends, signif = value.ravel()[used], ends.ravel()[used], signif.ravel()[used]
    stream = np.zeros(8 * int(length.sum()), np.uint8)
    for j in range(int(signif.max())):
        if j:
            keep = signif > j
            if not keep.all():
                value, ends, signif = value[keep], ends[keep], signif[keep]
        stream[ends - 1 - j] = value >> j & 1
    data = np.packbits(stream)
    crc = crc16(data, start, length - 2)
    data[start + length - 2], data[start + length - 1] = crc >> 8, crc & 255
    return data, start, length


def padded(value: bytes) -> bytes:
    """``value`` with bytes 255 up to a positive multiple of the block size."""
    return value + b"\xff" * (-len(value) % BLOCK if value else BLOCK)


def encode(payloads: list[bytes]) -> list[bytes]:
    """FLAC streams of payloads whose lengths are positive multiples of ``BLOCK``."""
    if any(not p or len(p) % BLOCK for p in payloads):
        raise FlacError("payloads must be positive multiples of the block size")
    counts = [len(p) // BLOCK for p in payloads]
    raw = (np.frombuffer(b"".join(payloads), np.uint8) ^ 128).view(np.int8)
    index = np.concatenate([np.arange(c) for c in counts]) if counts else np.zeros(0, np.int64)
    out: list[bytes] = []
    if not payloads:
        return out
    data, start, length = _frames(raw.reshape(-1, BLOCK).astype(np.int32), index)
    packed, first = data.tobytes(), 0
    for count in counts:
        a, b = int(start[first]), int(start[first + count - 1] + length[first + count - 1])
        sizes = length[first : first + count]
        samples = raw[first * BLOCK : (first + count) * BLOCK].tobytes()
        info = struct.pack(">HH", BLOCK, BLOCK) + int(sizes.min()).to_bytes(3, "big") + int(sizes.max()).to_bytes(3, "big")
        info += (8000 << 44 | 0 << 41 | 7 << 36 | count * BLOCK).to_bytes(8, "big") + hashlib.md5(samples).digest()
        points = np.zeros(count, [("sample", ">u8"), ("offset", ">u8"), ("size", ">u2")])
        points["sample"], points["offset"], points["size"] = np.arange(count) * BLOCK, start[first : first + count] - a, BLOCK
        seek = points.tobytes()
        # Seek points fill as many blocks as their 24-bit length needs.
        most = (1 << 24) // 18 * 18 - 18
        blocks = [seek[i : i + most] for i in range(0, len(seek), most)]
        table_bytes = b"".join(bytes([3 | (0x80 if i == len(blocks) - 1 else 0)]) + len(b).to_bytes(3, "big") + b for i, b in enumerate(blocks))
        out.append(b"fLaC" + bytes([0]) + (34).to_bytes(3, "big") + info + table_bytes + packed[a:b])
        first += count
    return out


# ---------------------------------------------------------------- decoding


def _metadata(stream: bytes) -> tuple[int, bytes, np.ndarray, int]:
    """Samples, MD5, sample offsets and byte offsets by the seek table, first frame's place."""
    if stream[:4] != b"fLaC":
        raise FlacError("no stream marker")
    at, last, points, samples, md5 = 4, False, [], None, b""
    while not last:
        if at + 4 > len(stream):
            raise FlacError("truncated metadata")
        last, kind, size = bool(stream[at] & 0x80), stream[at] & 0x7F, int.from_bytes(stream[at + 1 : at + 4], "big")
        body = stream[at + 4 : at + 4 + size]
        if kind == 0:
            packed = int.from_bytes(body[10:18], "big")
            if struct.unpack(">HH", body[:4]) != (BLOCK, BLOCK) or packed >> 36 & 0xFF != 7:
                raise FlacError("only 8-bit mono streams with blocks of 576 samples are supported")
            samples, md5 = packed & ((1 << 36) - 1), body[18:34]
        elif kind == 3:
            points.append(np.frombuffer(body, [("sample", ">u8"), ("offset", ">u8"), ("size", ">u2")]))
        at += 4 + size
    if samples is None or samples % BLOCK:
        raise FlacError("no usable stream information")
    found = np.concatenate(points)["offset"].astype(np.int64) if points else np.zeros(0, np.int64)
    if len(found) != samples // BLOCK:
        found = _scan(stream, at, samples // BLOCK)
    return samples, md5, found, at


def _scan(stream: bytes, at: int, count: int) -> np.ndarray:
    """Frame offsets of a stream without a full seek table: sync codes whose header CRC
    and frame number fit, and whose predecessor ends there with a valid frame CRC."""
    data = np.frombuffer(stream, np.uint8)
    where = np.flatnonzero((data[at:-1] == 0xFF) & (data[at + 1 :] == 0xF8)) + at
    starts, begin = [at], at
    for number in range(1, count):
        code, size = _numbers(np.array([number]))
        head = bytes([0xFF, 0xF8, 0x24, 0x02, *code[0, : size[0]].tolist()])
        for place in where[np.searchsorted(where, begin + 1) :]:
            place = int(place)
            if stream[place : place + len(head)] == head and not int(crc16(data, np.array([begin]), np.array([place - begin]))[0]):
                break
        else:
            raise FlacError(f"frame {number} not found")
        starts.append(place)
        begin = place
    return np.array(starts) - at


def _bits(window: np.ndarray, at: np.ndarray, n: np.ndarray | int) -> np.ndarray:
    """``n`` (at most 32) bits from bit position ``at``; window: 40-bit words at each byte."""
    return window[at >> 3] >> (40 - (at & 7) - n) & ((1 << np.asarray(n, np.int64)) - 1)


def _signed(window: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    value = _bits(window, at, n)
    return np.where(value >> (n - 1), value - (1 << n), value)


def _residuals(window: np.ndarray, at: np.ndarray, order: int, partition_order: int, wide: bool) -> tuple[np.ndarray, np.ndarray]:
    """Residuals (one row per sample) of frames that share a layout, and the bit after them."""
    out = np.empty((BLOCK - order, len(at)), np.int32)
    per, param = BLOCK >> partition_order, 5 if wide else 4
    if per << partition_order != BLOCK or per < order:
        raise FlacError("partitions don't fit the block")
    k = mask = escaped = plain = width = None
    for i in range(order, BLOCK):
        if i == order or i % per == 0:
            k = _bits(window, at, param)
            at = at + param
            raw = k == (1 << param) - 1
            escaped = plain = None
            if raw.any():  # residuals of a fixed width, which stands where the parameter's bits end
                escaped, plain = np.flatnonzero(raw), np.flatnonzero(~raw)
                width = _bits(window, at[escaped], 5)
                at[escaped] += 5
                k = np.where(raw, 0, k)
            mask = (np.int64(1) << k) - 1
        if escaped is not None:
            value = _bits(window, at[escaped], width)
            out[i - order, escaped] = np.where((width > 0) & (value >> np.maximum(width - 1, 0) & 1 == 1), value - (np.int64(1) << width), value)
            at[escaped] += width
            if len(plain):
                out[i - order, plain], at[plain] = _rice_codes(window, at[plain], k[plain], mask[plain])
            continue
        out[i - order], at = _rice_codes(window, at, k, mask)
    return out, at


def _rice_codes(window: np.ndarray, at: np.ndarray, k: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One Rice-coded residual of each frame, and the bit after it."""
    word = window[at >> 3] >> (8 - (at & 7)) & 0xFFFFFFFF
    quotient = 0
    empty = word == 0
    if empty.any():
        quotient = np.zeros(len(at), np.int64)
        while empty.any():  # runs of over 31 zeros
            quotient[empty] += 32
            at = at + 32 * empty
            if int(at.max()) >> 3 >= len(window) - 8:
                raise FlacError("residual runs beyond its stream")
            word = np.where(empty, window[at >> 3] >> (8 - (at & 7)) & 0xFFFFFFFF, word)
            empty = word == 0
    zeros = 1054 - (word.astype(np.float64).view(np.int64) >> 52)
    at = at + zeros + 1
    folded = (quotient + zeros) << k | (window[at >> 3] >> (40 - (at & 7) - k) & mask)
    at = at + k
    return folded >> 1 ^ -(folded & 1), at


def decode(streams: list[bytes]) -> list[tuple[bytes, np.ndarray]]:
    """Payload and byte offset of each frame (``sample offset = 576 * index``) of each stream."""
    if not streams:
        return []
    begins, counts, metas, base = [], [], [], 0
    for stream in streams:
        meta = _metadata(stream)
        metas.append(meta)
        begins.append(meta[2] + meta[3] + base)
        counts.append(len(meta[2]))
        base += len(stream)
    data = np.frombuffer(b"".join(streams) + bytes(64), np.uint8)
    start = np.concatenate(begins)
    stop = np.concatenate([np.append(b[1:], e) for b, e in zip(begins, np.cumsum([len(s) for s in streams]), strict=True)])
    if (stop <= start).any() or int(stop.max(initial=0)) > base:
        raise FlacError("seek table out of order")
    index = np.concatenate([np.arange(c) for c in counts])
    code, size = _numbers(index)
    heads = np.array([0xFF, 0xF8, 0x24, 0x02], np.uint8)
    if (data[start[:, None] + np.arange(4)] != heads).any():
        raise FlacError("no frame header where one is due")
    for j in range(int(size.max())):
        if (data[start + 4 + j] != code[:, j])[size > j].any():
            raise FlacError("wrong frame number")
    if (crc8(data, start, 4 + size) != data[start + 4 + size]).any():
        raise FlacError("header checksum mismatch")
    if crc16(data, start, stop - start).any():  # over data and footer it comes to zero
        raise FlacError("frame checksum mismatch")

    window = np.zeros(len(data), np.int64)
    for j in range(5):
        window[: len(data) - 5] = window[: len(data) - 5] << 8 | data[j : len(data) - 5 + j]
    x = np.empty((len(start), BLOCK), np.int8)
    at = 8 * (start + 5 + size)
    kind, at = _bits(window, at, 8), at + 8
    if (kind & 0x80).any():
        raise FlacError("no subframe header where one is due")
    wasted = np.zeros(len(start), np.int64)
    for row in np.flatnonzero(kind & 1):  # low bits that are zero in all samples: a unary number of them
        word = int(_bits(window, at[row : row + 1], 32)[0])
        wasted[row] = 33 - word.bit_length()
        at[row] += wasted[row]
    if (wasted > 7).any():
        raise FlacError("more wasted bits than a sample has")
    kind = kind >> 1
    ended = np.empty(len(start), np.int64)
    for what, spare in np.unique(np.stack([kind, wasted]), axis=1).T.tolist():
        rows = np.flatnonzero((kind == what) & (wasted == spare))
        p, depth = at[rows], 8 - spare
        if what == 0:
            x[rows] = (_signed(window, p, depth) << spare).astype(np.int8)[:, None]
            ended[rows] = p + depth
        elif what == 1 and not spare and not (p & 7).any():
            x[rows] = data[(p >> 3)[:, None] + np.arange(BLOCK)].view(np.int8)
            ended[rows] = p + 8 * BLOCK
        elif what == 1:
            x[rows] = np.stack([_signed(window, p + depth * j, depth) << spare for j in range(BLOCK)], axis=1).astype(np.int8)
            ended[rows] = p + depth * BLOCK
        elif 8 <= what <= 12 or what >= 32:
            order = int(what) - 8 if what < 32 else int(what) - 31
            warm = np.stack([_signed(window, p + depth * j, depth) for j in range(order)], axis=0).astype(np.int32) if order else np.zeros((0, len(rows)), np.int32)
            p = p + depth * order
            coef = shift = None
            if what >= 32:
                precision = _bits(window, p, 4) + 1
                shift = _bits(window, p + 4, 5)
                p = p + 9
                coef = []
                for _ in range(order):
                    c = _bits(window, p, precision)
                    coef.append(np.where(c >> (precision - 1) & 1, c - (np.int64(1) << precision), c))
                    p = p + precision
            layout = _bits(window, p, 6)
            p = p + 6
            for how in np.unique(layout):
                own = layout == how
                if how >> 4 > 1:
                    raise FlacError("unknown residual coding")
                residual, ended[rows[own]] = _residuals(window, p[own], order, int(how & 15), bool(how >> 4))
                if what < 32:
                    differences, steps = warm[:, own], []
                    for _ in range(order):
                        steps.append(differences[-1])
                        differences = np.diff(differences, axis=0)
                    for s in reversed(steps):
                        residual = np.cumsum(residual, axis=0, dtype=np.int32) + s
                    samples = np.concatenate([warm[:, own], residual])
                else:
                    samples = np.empty((BLOCK, residual.shape[1]), np.int64)
                    samples[:order] = warm[:, own]
                    c, by = [k[own] for k in coef], shift[own]
                    for i in range(order, BLOCK):
                        predicted = c[0] * samples[i - 1]
                        for j in range(1, order):
                            predicted += c[j] * samples[i - 1 - j]
                        samples[i] = residual[i - order] + (predicted >> by)
                x[rows[own]] = (samples << spare).T
        else:
            raise FlacError(f"reserved subframe type {what}")
    if ((ended + 7 >> 3) + 2 != stop).any():
        raise FlacError("a frame does not end where the next begins")
    out, first = [], 0
    for (samples, md5, offsets, _), count in zip(metas, counts, strict=True):
        own = x[first : first + count]
        if hashlib.md5(own.tobytes()).digest() != md5:
            raise FlacError("stream checksum mismatch")
        out.append(((own.view(np.uint8) ^ 128).tobytes(), offsets))
        first += count
    return out


# ---------------------------------------------------------------- columns


def _features(payload: bytes) -> str:
    """Integer loudness figures of the samples: mean and power in thousandths, peak, zero crossings."""
    x = (np.frombuffer(payload, np.uint8) ^ 128).view(np.int8).astype(np.int32)
    n, power = len(x), int((x * x).sum(dtype=np.int64))
    crossings = int(((x[1:] < 0) != (x[:-1] < 0)).sum())
    return f"mean={1000 * int(x.sum(dtype=np.int64)) // n};power={1000 * power // n};peak={int(np.abs(x).max())};crossings={crossings};frames={n // BLOCK}"


def _binary(text: Column) -> Column:
    return F.coalesce(text.cast("binary"), F.lit(b""))


def store(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each value as a FLAC stream: ``id_col``, n_bytes long, media binary.

    Null values are stored as empty ones; an empty value is one block of padding.
    """
    kind = df.select(F.col(id_col).alias("id")).schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "raw", _SLICE_BYTES):
                values = utf8(part.column("raw"))
                media = encode([padded(v) for v in values])
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(map(len, values), pa.int64()), pa.array(media, pa.binary())], names=["id", "n_bytes", "media"])

    return df.select(F.col(id_col).alias("id"), _binary(F.col(text_col)).alias("raw")).mapInArrow(run, f"id {kind}, n_bytes long, media binary").withColumnRenamed("id", id_col)


def pcm_blocks(df: DataFrame, *, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """Decoded PCM blocks: ``id_col``, block, sample_offset, media_offset, pcm (unsigned bytes).

    ``media_offset`` is the byte of the frame within the stream, so that a reader can seek
    to any sample offset.  Null streams give no block; damaged ones raise.
    """
    kind = df.select(F.col(id_col).alias("id")).schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "media", _SLICE_BYTES):
                media = utf8(part.column("media"))
                row, block, place, pcm = [], [], [], []
                for i, ((payload, offsets), stream) in enumerate(zip(decode(media), media, strict=True)):
                    first = _metadata(stream)[3]
                    for j in range(len(offsets)):
                        row.append(i)
                        block.append(j)
                        place.append(first + int(offsets[j]))
                        pcm.append(payload[j * BLOCK : (j + 1) * BLOCK])
                yield pa.RecordBatch.from_arrays(
                    [part.column("id").take(pa.array(row, pa.int64())), pa.array(block, pa.int64()), pa.array([BLOCK * j for j in block], pa.int64()), pa.array(place, pa.int64()), pa.array(pcm, pa.binary())],
                    names=["id", "block", "sample_offset", "media_offset", "pcm"],
                )

    found = df.select(F.col(id_col).alias("id"), F.col(media_col).alias("media")).filter("media IS NOT NULL")
    return found.mapInArrow(run, f"id {kind}, block long, sample_offset long, media_offset long, pcm binary").withColumnRenamed("id", id_col)


def digests(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store each value, read the stored bytes back, and describe what was read.

    Columns: ``id_col``, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes,
    media_sha256, feature, block_offsets.  ``block_offsets`` has the byte of the stream at which
    each PCM block begins, as read back from the seek table: block ``j`` holds the samples from
    ``576 * j`` on.  Storing and reading share one task, so that no media column
    crosses a process; each depends on its own value alone, so equal values give equal
    rows, and repeated rows are kept.  An empty table gives no rows.
    """
    kind = df.select(F.col(id_col).alias("id")).schema["id"].dataType.simpleString()
    schema = f"id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, block_offsets array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "raw", _SLICE_BYTES):
                values = utf8(part.column("raw"))
                media = encode([padded(v) for v in values])
                read = decode(media)
                payloads = [p for p, _ in read]
                places = [offsets + _metadata(m)[3] for (_, offsets), m in zip(read, media, strict=True)]
                ends = np.cumsum([0, *map(len, places)])
                columns = [
                    pa.array(map(len, values), pa.int64()),
                    pa.array(map(len, payloads), pa.int64()),
                    pa.array([hashlib.sha256(p).hexdigest() for p in payloads]),
                    pa.array([zlib.crc32(p[-32:]) for p in payloads], pa.int64()),
                    pa.array(map(len, media), pa.int64()),
                    pa.array([hashlib.sha256(m).hexdigest() for m in media]),
                    pa.array(map(_features, payloads)),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(places))),
                ]
                yield pa.RecordBatch.from_arrays([part.column("id"), *columns], names=[f.split()[0] for f in schema.split(", ")])

    return df.select(F.col(id_col).alias("id"), _binary(F.col(text_col)).alias("raw")).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def op3_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
