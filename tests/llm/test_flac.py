import hashlib
import random
import zlib

import numpy as np
import pytest

from patternlake.llm import flac
from patternlake.llm.flac import BLOCK, FlacError, decode, digests, encode, padded, pcm_blocks, store


def cases():
    rnd = random.Random(1)
    wave = bytes(int(128 + 100 * np.sin(i / 9)) for i in range(4000))
    return [b"", b"a" * BLOCK, b"a" * (BLOCK + 1), rnd.randbytes(5000), bytes([0] * 600 + [255] + [0] * 575), b"ab" * 600, bytes(range(256)) * 40, wave, "é的 text\n".encode() * 500]


def bitwise_crc(data, poly, bits):
    crc = 0
    for byte in data:
        crc ^= byte << (bits - 8)
        for _ in range(8):
            crc = (crc << 1 ^ poly if crc >> (bits - 1) & 1 else crc << 1) & ((1 << bits) - 1)
    return crc


def serial_decode(stream):
    """A plain bit-by-bit reader of the same format."""
    samples, _, offsets, first = flac._metadata(stream)
    bits, out = "".join(f"{b:08b}" for b in stream), []
    for number, offset in enumerate(offsets):
        at = begin = 8 * (first + int(offset))
        assert int(bits[at : at + 16], 2) == 0xFFF8
        length = int(flac._numbers(np.array([number]))[1][0])
        at += 32 + 8 * length
        assert int(bits[at : at + 8], 2) == bitwise_crc(stream[begin // 8 : at // 8], 0x07, 8)
        at += 8

        def take(n):
            nonlocal at
            at += n
            return int(bits[at - n : at], 2) if n else 0

        def signed(n):
            v = take(n)
            return v - (1 << n) if v >> (n - 1) else v

        kind = take(8) >> 1
        if kind == 0:
            x = [signed(8)] * BLOCK
        elif kind == 1:
            x = [signed(8) for _ in range(BLOCK)]
        else:
            order = kind - 8 if kind < 32 else kind - 31
            x = [signed(8) for _ in range(order)]
            if kind < 32:
                coef, shift = [[], [1], [2, -1]][order], 0
            else:
                precision = take(4) + 1
                shift = take(5)
                coef = [signed(precision) for _ in range(order)]
            assert take(6) == 0
            k = take(4)
            for _ in range(BLOCK - order):
                q = 0
                while not take(1):
                    q += 1
                u = q << k | take(k)
                x.append((u >> 1 ^ -(u & 1)) + (sum(c * x[-1 - j] for j, c in enumerate(coef)) >> shift))
        at += -at % 8
        assert take(16) == bitwise_crc(stream[begin // 8 : at // 8 - 2], 0x8005, 16)
        out += x
    assert len(out) == samples
    return bytes(v + 128 for v in out)


def test_round_trip_and_serial_reader():
    payloads = [padded(v) for v in cases()]
    media = encode(payloads)
    assert [p for p, _ in decode(media)] == payloads
    assert [serial_decode(m) for m in media] == payloads
    kinds = set()
    for m in media:
        _, _, offsets, first = flac._metadata(m)
        kinds |= {m[first + int(o) + 6] >> 1 for o in offsets[:100]}
    assert {0, 1} <= kinds and any(8 <= k <= 10 for k in kinds) and any(k >= 32 for k in kinds)


def test_frames_found_without_seek_table():
    payload = padded(b"some text that repeats " * 200)
    stream = encode([payload])[0]
    first = flac._metadata(stream)[3]
    bare = stream[:4] + bytes([0x80]) + stream[5:42] + stream[first:]
    assert decode([bare])[0][0] == payload


def written(subframes, samples):
    """A stream of given subframe bits, one frame each, without a seek table."""
    md5 = hashlib.md5(bytes(v & 255 for v in samples)).digest()
    info = BLOCK.to_bytes(2, "big") * 2 + bytes(6) + (8000 << 44 | 7 << 36 | len(samples)).to_bytes(8, "big") + md5
    out = b"fLaC" + bytes([0x80]) + (34).to_bytes(3, "big") + info
    for number, bits in enumerate(subframes):
        head = bytes([0xFF, 0xF8, 0x24, 0x02, number])
        bits += "0" * (-len(bits) % 8)
        frame = head + bytes([bitwise_crc(head, 0x07, 8)]) + int(bits, 2).to_bytes(len(bits) // 8, "big")
        out += frame + bitwise_crc(frame, 0x8005, 16).to_bytes(2, "big")
    return out


def test_escaped_partitions_and_wasted_bits():
    rnd = random.Random(5)
    field = lambda v, n: format(v & ((1 << n) - 1), f"0{n}b") if n else ""

    def rice(v, k):
        u = v << 1 if v >= 0 else (-v << 1) - 1
        return "0" * (u >> k) + "1" + field(u, k)

    loud = [rnd.randint(-60, 60) for _ in range(BLOCK)]
    steps = [b - a for a, b in zip(loud, loud[1:], strict=False)]
    escaped = "0" + field(9, 6) + "0" + field(loud[0], 8) + "00" + field(1, 4)  # fixed, order 1, two partitions
    escaped += "1111" + field(9, 5) + "".join(field(v, 9) for v in steps[: BLOCK // 2 - 1]) + field(5, 4) + "".join(rice(v, 5) for v in steps[BLOCK // 2 - 1 :])
    coarse = [4 * rnd.randint(-30, 30) for _ in range(BLOCK)]
    verbatim = "0" + field(1, 6) + "1" + "01" + "".join(field(v >> 2, 6) for v in coarse)  # two wasted bits
    constant = "0" + field(0, 6) + "1" + "001" + field(-5, 5)
    evens = [2 * rnd.randint(-8, 8) for _ in range(BLOCK)]
    fixed = "0" + field(8, 6) + "1" + "1" + "00" + field(0, 4) + field(2, 4) + "".join(rice(v >> 1, 2) for v in evens)
    silent = "0" + field(9, 6) + "0" + field(7, 8) + "01" + field(0, 4) + "11111" + field(0, 5)  # wide parameters, nothing left
    samples = loud + coarse + [-40] * BLOCK + evens + [7] * BLOCK
    frames = [escaped, verbatim, constant, fixed, silent]
    ((payload, offsets),) = decode([written(frames, samples)])
    assert payload == bytes(v + 128 for v in samples) and len(offsets) == 5
    # Beside frames of the same layout without an escape.
    plain = "0" + field(9, 6) + "0" + field(loud[0], 8) + "00" + field(1, 4) + field(6, 4) + "".join(rice(v, 6) for v in steps[: BLOCK // 2 - 1]) + field(5, 4) + "".join(rice(v, 5) for v in steps[BLOCK // 2 - 1 :])
    assert decode([written([escaped, plain, escaped], loud * 3)])[0][0] == bytes(v + 128 for v in loud * 3)


@pytest.mark.parametrize("place", [-3, -40, 60])
def test_damage_is_reported(place):
    stream = bytearray(encode([padded(b"the quick brown fox " * 100)])[0])
    stream[place] ^= 4
    with pytest.raises(FlacError):
        decode([bytes(stream)])


def test_columns(spark):
    texts = [(1, "héllo"), (2, None), (3, ""), (4, "x" * 200_000), (1, "héllo"), (None, "n")]
    df = spark.createDataFrame(texts, "doc_id long, text string").selectExpr("*", "1 AS n_bytes", "2 AS raw")
    rows = digests(df).collect()
    assert len(rows) == len(texts)
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, set()).add(str(tuple(r)))
    for doc_id, text in texts:
        payload = padded((text or "").encode())
        (row,) = [r for r in rows if r.doc_id == doc_id][:1]
        assert (row.n_bytes, row.payload_bytes) == (len((text or "").encode()), len(payload))
        assert row.payload_sha256 == hashlib.sha256(payload).hexdigest() and row.tail_crc32 == zlib.crc32(payload[-32:])
        assert row.media_sha256 == hashlib.sha256(encode([payload])[0]).hexdigest()
    assert len(by[1]) == 1 and len({r.feature for r in rows if r.doc_id in (2, 3)}) == 1
    media = store(df)
    blocks = pcm_blocks(media).collect()
    joined = b"".join(bytes(b.pcm) for b in sorted(blocks, key=lambda b: (b.doc_id or 0, b.sample_offset)) if b.doc_id == 4)
    assert joined == padded(b"x" * 200_000)
    assert all(b.sample_offset == BLOCK * b.block for b in blocks)
    offsets = {r.doc_id: r.block_offsets for r in rows}
    assert all(offsets[b.doc_id][b.block] == b.media_offset for b in blocks) and {i: len(o) for i, o in offsets.items()} == {r.doc_id: r.payload_bytes // BLOCK for r in rows}
    assert digests(df.filter("false")).collect() == [] and pcm_blocks(media.filter("false")).collect() == []
