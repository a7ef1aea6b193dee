"""SimHash near-duplicates with a bit-sliced comparison.

Fingerprints: a bit is set if it is set in over half of the document's shingle hashes
(XXH64, seed 42).  Equal fingerprints collapse first, so a group of copies of any size is
one node.  Two different fingerprints within ``radius`` bits agree on at least one choice
of bands (pigeonhole), so they meet in a bucket of that choice; the number of bands
follows the number of fingerprints, and buckets above ``_BUCKET`` are split by further
bands of the remaining bits, which loses no link either.

Within a bucket, fingerprints lie as bit planes: word ``w`` of plane ``b`` holds bit ``b``
of 64 neighbours.  Comparing everyone with the neighbour ``k`` places on is one exclusive
or of each plane with itself shifted by ``k``; carry-save counters add the planes up for
64 pairs at a time, and words in which every pair is beyond the radius are abandoned.
Links leave a bucket as stars around the smallest fingerprint of each linked set, never
as all pairs; components come from star rounds on the cluster.  A bucket that two rounds of
further bands leave above ``_BUCKET`` is cut into chunks, and each pair of chunks is a block
of its own, so a task holds two chunks at most.

``near_copies`` finds all texts whose sets of shingles have a Jaccard similarity of
``similarity`` or more.  Some ten bits of 64 differ there, which bands can't find, so blocks
are the shingles themselves: two such sets share one of the first n - ceil(similarity * n) + 1
shingles of either, under any fixed order of all shingles (frequent ones come last; a sample
says which, and decides how much work there is, never what is found).  Within the blocks
fingerprints of 256 bits are compared bit-sliced as above.  At the similarity they differ in
39 bits on average; ``_WIDE_RADIUS`` is seven deviations above, so that fingerprints lose a link with
a chance below 1e-11.  Blocks give stars, and components of stars hold all links.  The set of each
text goes once to its component (to each pair of chunks of a hot one, and of components above
``_LARGE`` nodes to each shingle that it shares there, so that chains of likeness can't make the
work grow with the square of the corpus), where pairs within the radius are compared exactly,
on the sets, unless links found before join them; stars of the exact links leave it.  So no
pair is ever a row.

Defined results: null and blank texts have fingerprint zero and link like any other, and to
``near_copies`` they are copies of one another; texts of fewer words than a shingle are one
shingle; repeated rows are kept; null ids take the smallest id of their component, if it has one;
an empty table gives no rows; other columns, whatever their names, are ignored, and kept by
``representatives``.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patternlake.llm.common import nested, slices, table, unnested, utf8
from patternlake.llm.components import components
from patternlake.plans.lineage import broadcast_if_small, cut

BITS = 64
_BUCKET = 2048
#: Words of the fingerprints of ``near_copies``, and how many of their bits may differ.
_WIDE, _WIDE_RADIUS = 4, 80
_SAMPLE, _FREQUENT, _MOST_FREQUENT = 64, 4, 100_000
#: Components above so many nodes are compared by shingle, not whole.
_LARGE = 64 * _BUCKET
_CHUNK = 200_000
_SLICE_BYTES = 4 << 20


def shingle_hashes(text: bytes, shingle: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each run of ``shingle`` words, repeats included."""
    words = text.lower().split()  # bytes: lower-cases A-Z only, splits at ASCII white space
    if not words:
        return np.zeros(0, "<u8")
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([digest(joined, seed)], "<u8")
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    return np.array([digest(joined[a:b], seed) for a, b in zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)], "<u8")


def majority(hashes: np.ndarray) -> int:
    """The bits that over half of the hashes have."""
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = hashes[at : at + (1 << 14)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: bytes, shingle: int, seed: int = 42) -> int:
    return majority(shingle_hashes(text, shingle, seed))


def fingerprints(df: DataFrame, *, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): the fingerprint of each text as a signed long."""
    kind = df.select(F.col(id_col).alias("id")).schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", _SLICE_BYTES):
                fps = np.array([fingerprint(t, shingle) for t in utf8(part.column("text"))], dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(fps)], names=["id", "fp"])

    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, fp long")


def _beyond(counter: list[np.ndarray], over: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose bit-sliced count is above ``radius``."""
    above, equal = over.copy(), ~over
    for bit in reversed(range(len(counter))):
        if radius >> bit & 1:
            equal = equal & counter[bit]
        else:
            above |= equal & counter[bit]
            equal = equal & ~counter[bit]
    return above


def close_pairs(keys: np.ndarray, fps: np.ndarray, radius: int, groups: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (i, j), i < j, of fingerprints within ``radius`` bits among rows of equal key.

    ``keys`` must be sorted; ``fps`` has a row of one or more words for each.  Pairs come by the
    distance between their places.  Rows of one of ``groups`` aren't compared, and the groups
    may change between pairs, so whoever joins what is found is spared most of the others.
    Rows of short runs drop out as the distance grows.
    """
    fps = fps.reshape(len(keys), -1)
    n_bits = BITS * fps.shape[1]
    rows = np.arange(len(keys))
    step, width = 1, max(1, int(radius).bit_length())
    while len(rows):
        edge = np.flatnonzero(np.concatenate([[True], keys[rows][1:] != keys[rows][:-1]]))
        sizes = np.diff(np.append(edge, len(rows)))
        rows = rows[np.repeat(sizes > step, sizes)]
        if not len(rows):
            break
        n, words = len(rows), -(-len(rows) // 64)
        key = keys[rows]
        bits = np.unpackbits(np.ascontiguousarray(fps[rows]).view(np.uint8).reshape(n, -1), axis=1, bitorder="little").T
        # Room for a shift by up to twice the step.
        planes = np.zeros((n_bits, 8 * (words + 2 * step // 64 + 2)), np.uint8)
        planes[:, : -(-n // 8)] = np.packbits(bits, axis=1, bitorder="little")
        planes = planes.view("<u8")
        for k in range(step, 2 * step):
            if k >= n:
                break
            same = np.zeros(8 * words, np.uint8)
            wanted = key[k:] == key[:-k]
            if groups is not None:
                group = groups[rows]
                wanted &= group[k:] != group[:-k]
            packed = np.packbits(wanted, bitorder="little")
            same[: len(packed)] = packed
            alive = same.view("<u8")
            active = np.flatnonzero(alive)
            alive = alive[active]
            if not len(active):
                continue
            q, r = divmod(k, 64)
            counter, over = [np.zeros(len(active), np.uint64) for _ in range(width)], np.zeros(len(active), np.uint64)
            for at in range(0, n_bits, 8):
                own = planes[at : at + 8, active]
                other = planes[at : at + 8, active + q]
                if r:
                    other = other >> np.uint64(r) | planes[at : at + 8, active + q + 1] << np.uint64(64 - r)
                differ = own ^ other
                for a, b in zip(differ[::2], differ[1::2], strict=True):
                    half = counter[0] ^ a  # full adder: two planes at a time
                    carry = counter[0] & a | half & b
                    counter[0] = half ^ b
                    for bit in range(1, width):
                        carry, counter[bit] = counter[bit] & carry, counter[bit] ^ carry
                    over |= carry
                alive = alive & ~_beyond(counter, over, radius)
                live = alive != 0
                if not live.all():
                    active, alive, over = active[live], alive[live], over[live]
                    counter = [c[live] for c in counter]
                    if not len(active):
                        break
            if len(active):
                lane = np.unpackbits(alive.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                word, bit = np.nonzero(lane)
                i = active[word] * 64 + bit
                yield rows[i], rows[i + k]
        step *= 2


def join(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Link positions ``i`` and ``j``: ``label`` keeps the smallest linked position of each."""
    while len(i):
        a, b = label[i], label[j]
        if (a == b).all():
            return
        least = np.arange(len(label))
        np.minimum.at(least, np.maximum(a, b), np.minimum(a, b))
        while (least != (jumped := least[least])).any():
            least = jumped
        label[:] = least[label]


def linked(keys: np.ndarray, fps: np.ndarray, radius: int) -> np.ndarray:
    """The smallest position that each row is linked with, within rows of equal key."""
    label = np.arange(len(keys))
    for i, j in close_pairs(keys, fps, radius, label):
        join(label, i, j)
    return label


def _stars(label: np.ndarray, node: np.ndarray) -> pa.RecordBatch:
    """(u, v) from each linked row to the smallest position of its links."""
    rows = np.flatnonzero(label != np.arange(len(label)))
    pairs = np.unique(np.stack([node[rows], node[label[rows]]], axis=1), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["u", "v"])


def _choices(n: int, radius: int) -> list[int]:
    """Masks of the band choices of which two close fingerprints agree on one at least."""
    for bands in range(radius + 1, radius + 5):
        edges = [BITS * b // bands for b in range(bands + 1)]
        single = [sum(1 << x for x in range(a, b)) for a, b in itertools.pairwise(edges)]
        masks = [sum(c) for c in itertools.combinations(single, bands - radius)]
        if n <= 64 << min(m.bit_count() for m in masks):
            break
    return masks


def _finer(mask: int, radius: int) -> list[int]:
    """The mask with each of ``radius + 1`` parts of its open bits added."""
    rest = [b for b in range(BITS) if not mask >> b & 1]
    edges = [len(rest) * p // (radius + 1) for p in range(radius + 2)]
    return [mask | sum(1 << b for b in rest[a:b]) for a, b in itertools.pairwise(edges)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _buckets(nodes: DataFrame, masks: list[int], radius: int) -> DataFrame:
    """(key, fp): every bucket of every fingerprint; keys hash the band choice and its bits."""

    def keyed(df: DataFrame, paths: F.Column, mask_list: list[int]) -> DataFrame:
        table_of = F.array(*[F.lit(_signed(m)).cast("long") for m in mask_list])
        df = df.select("fp", F.explode(paths).alias("path"))
        return df.select("fp", "path", F.xxhash64("path", F.col("fp").bitwiseAND(F.get(table_of, F.col("path")))).alias("key"))

    rows = keyed(nodes, F.sequence(F.lit(0), F.lit(len(masks) - 1)), masks)
    done = None
    for _ in range(2):
        rows = cut(rows)
        hot = cut(rows.groupBy("key").count().filter(F.col("count") > _BUCKET).select("key"))
        if hot.isEmpty():
            break
        cold = rows.join(hot, "key", "left_anti").select("key", "fp")
        done = cold if done is None else done.unionByName(cold)
        parts = radius + 1
        masks = [m for mask in masks for m in _finer(mask, radius)]
        first = F.col("path") * parts
        rows = keyed(rows.join(hot, "key", "left_semi"), F.sequence(first, first + parts - 1), masks)
    rows = rows.select("key", "fp")
    return _blocks(rows if done is None else done.unionByName(rows), "fp")


def _blocks(rows: DataFrame, node: str, most: int | None = None) -> DataFrame:
    """``rows`` with their blocks: a key's rows together, or those of each pair of its chunks of ``most``."""
    rows, most = cut(rows), most or _BUCKET
    hot = rows.groupBy("key").count().filter(F.col("count") > 2 * most)
    hot = cut(hot.select("key", F.ceil(F.col("count") / most).alias("chunks")))
    if hot.isEmpty():
        return rows.withColumn("block", F.col("key"))
    chunk = F.pmod(F.xxhash64(node), F.col("chunks"))
    split = rows.join(broadcast_if_small(hot), "key").withColumn("chunk", chunk)
    split = split.select(*rows.columns, "chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("other"))
    split = split.withColumn("block", F.xxhash64("key", F.least("chunk", "other"), F.greatest("chunk", "other")))
    return rows.join(hot, "key", "left_anti").withColumn("block", F.col("key")).unionByName(split.drop("chunk", "other"))


def _whole_blocks(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[list[np.ndarray]]:
    """Columns of some ``limit`` rows at a time; the first is the sorted block, which is never torn."""
    held: list[np.ndarray] = []
    for batch in batches:
        new = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        held = [np.concatenate(p) for p in zip(held, new, strict=True)] if held else new
        if len(held[0]) >= limit and held[0][0] != held[0][-1]:
            at = int(np.searchsorted(held[0], held[0][-1]))  # the last block may go on
            yield [c[:at] for c in held]
            held = [c[at:] for c in held]
    if held and len(held[0]):
        yield held


def links(nodes: DataFrame, *, radius: int = 4) -> DataFrame:
    """(u, v): links that join all fingerprints (``fp``, distinct) within ``radius`` bits of one another."""
    nodes = cut(nodes.select("fp"))
    masks = _choices(nodes.count(), radius)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for blocks, fps in _whole_blocks(batches, _CHUNK):
            yield _stars(linked(blocks, fps, radius), fps)

    rows = _buckets(nodes, masks, radius).select("block", "fp")
    return rows.repartition("block").sortWithinPartitions("block").mapInArrow(run, "u long, v long")


def near_duplicates(df: DataFrame, *, shingle: int = 4, radius: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, fingerprint (16 hexadecimal digits) and component_id of every row."""
    prints = cut(fingerprints(df, shingle=shingle, id_col=id_col, text_col=text_col))
    nodes = cut(prints.groupBy("fp").agg(F.min("id").alias("first")))
    roots = components(links(nodes, radius=radius))
    member = nodes.join(roots.withColumnRenamed("u", "fp"), "fp", "left").select("fp", "first", F.coalesce("v", "fp").alias("root"))
    member = cut(member)
    least = cut(member.groupBy("root").agg(F.min("first").alias("component_id")))
    label = cut(member.join(least, "root").select("fp", "component_id"))
    return prints.join(label, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# ---------------------------------------------------------------- texts by similarity


def wide_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """``_WIDE`` words of majority bits, each of another mixture of the hashes."""
    words = []
    for _ in range(_WIDE):
        words.append(majority(hashes))
        hashes = (hashes ^ hashes >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x7F4A7C15)
        hashes ^= hashes >> np.uint64(29)
    return np.array(words, np.uint64).view(np.int64)


def _set(text: bytes, shingle: int) -> np.ndarray:
    """The sorted distinct shingles of a text."""
    return np.unique(shingle_hashes(text, shingle).view(np.int64))


def _node(found: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(found.tobytes())).astype(np.int64))


def _lists(values: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, values)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(values) if values else np.zeros(0, np.int64)))


def _frequent(df: DataFrame, shingle: int) -> np.ndarray:
    """Shingles that many sampled texts hold, rarest first: ``_MOST_FREQUENT`` at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", _SLICE_BYTES):
                yield pa.RecordBatch.from_arrays([_lists([_set(t, shingle) for t in utf8(part.column("text"))])], names=["keys"])

    sample = df.filter(F.pmod(F.xxhash64("id", "doc"), F.lit(_SAMPLE)) == 0).select("text").mapInArrow(run, "keys array<long>")
    counts = sample.select(F.explode("keys").alias("key")).groupBy("key").count().filter(F.col("count") >= _FREQUENT)
    top = counts.orderBy(F.desc("count"), "key").limit(_MOST_FREQUENT).collect()
    return np.array([r.key for r in reversed(top)], np.int64)


_WORDS = [f"s{w}" for w in range(_WIDE)]


def _profiles(df: DataFrame, shingle: int, similarity: tuple[int, int]) -> DataFrame:
    """(id, doc, node, n, fingerprint words, keys): a text's set by its hash and size, and the first shingles."""
    frequent = _frequent(df, shingle)
    by_value = np.argsort(frequent)
    known = frequent[by_value]
    a, b = similarity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", _SLICE_BYTES):
                nodes, sizes, wide, keys = [], [], [], []
                for text in utf8(part.column("text")):
                    found = _set(text, shingle)
                    n = len(found)
                    nodes.append(_node(found))
                    sizes.append(n)
                    wide.append(wide_fingerprint(found.view(np.uint64)))
                    if len(known) and n:
                        at = np.minimum(np.searchsorted(known, found), len(known) - 1)
                        rank = np.where(known[at] == found, by_value[at] + 1, 0)
                        found = found[np.argsort(rank, kind="stable")]
                    keys.append(found[: n + (-a * n // b) + 1 if n else 0])
                words = np.array(wide, np.int64).reshape(-1, _WIDE)
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("doc"), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), *[pa.array(words[:, w].copy()) for w in range(_WIDE)], _lists(keys)], names=["id", "doc", "node", "n", *_WORDS, "keys"])

    return df.mapInArrow(run, f"id {df.schema['id'].dataType.simpleString()}, doc long, node long, n long, {', '.join(f'{w} long' for w in _WORDS)}, keys array<long>")


def _similar(a: np.ndarray, b: np.ndarray, similarity: tuple[int, int]) -> bool:
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    return sum(similarity) * int((both[1:] == both[:-1]).sum()) >= similarity[0] * len(both)


def _confirmed(blocks: np.ndarray, sizes: np.ndarray, fps: np.ndarray, sets: list[np.ndarray], similarity: tuple[int, int]) -> np.ndarray:
    """Like ``linked``, by the exact similarity of the sets."""
    a, b = similarity
    label = np.arange(len(blocks))
    for i, j in close_pairs(blocks, fps, _WIDE_RADIUS, label):
        fits = b * np.minimum(sizes[i], sizes[j]) >= a * np.maximum(sizes[i], sizes[j])
        fits[fits] = [_similar(sets[x], sets[y], similarity) for x, y in zip(i[fits].tolist(), j[fits].tolist(), strict=True)]
        join(label, i[fits], j[fits])
    return label


def _candidates(met: DataFrame, nodes: DataFrame) -> DataFrame:
    """(u, v): stars of nodes that meet in a block within ``_WIDE_RADIUS``."""
    rows = _blocks(met.join(nodes.select("node", *_WORDS), "node"), "node").select("block", "node", *_WORDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for blocks, node, *words in _whole_blocks(batches, _CHUNK // _WIDE):
            yield _stars(linked(blocks, np.stack(words, axis=1), _WIDE_RADIUS), node)

    return cut(rows.repartition("block").sortWithinPartitions("block", "node").mapInArrow(run, "u long, v long").distinct())


def _places(members: DataFrame, met: DataFrame) -> DataFrame:
    """(key, node): where the sets of a component's nodes meet; all in one place, or, in large components, by shingle."""
    large = cut(members.groupBy("root").count().filter(F.col("count") > _LARGE).select("root"))
    if large.isEmpty():
        return members.select(F.col("root").alias("key"), "node")
    whole = members.join(large, "root", "left_anti").select(F.col("root").alias("key"), "node")
    parted = cut(met.join(members.join(broadcast_if_small(large), "root"), "node").select(F.xxhash64("root", "key").alias("key"), "node"))
    shared = parted.groupBy("key").count().filter("count > 1").select("key")
    return whole.unionByName(parted.join(shared, "key"))


def _exact_links(roots: DataFrame, met: DataFrame, df: DataFrame, nodes: DataFrame, shingle: int, similarity: tuple[int, int]) -> DataFrame:
    """(u, v): stars of the nodes of each component (node, root) whose sets are similar enough."""
    members = cut(roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct()))
    blocks = _blocks(_places(members, met), "node", most=_BUCKET // 2)
    wanted = blocks.groupBy("node").agg(F.collect_list("block").alias("blocks"))
    wanted = cut(wanted.join(nodes.select("node", F.col("doc").alias("w_doc")), "node"))
    texts = df.join(broadcast_if_small(wanted), F.col("doc") == F.col("w_doc")).select("text", "node", "blocks")
    schema = f"block long, node long, {', '.join(f'{w} long' for w in _WORDS)}, shingles binary"

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()  # repeated texts: once per task
        for batch in batches:
            for part in slices(batch, "text", _SLICE_BYTES):
                columns: list[list] = [[] for _ in range(3 + _WIDE)]
                for text, node, own in zip(utf8(part.column("text")), part.column("node").to_pylist(), part.column("blocks").to_pylist(), strict=True):
                    if node in seen:
                        continue
                    found = _set(text, shingle)
                    if _node(found) != node:
                        continue  # another text of equal hash
                    seen.add(node)
                    values = [node, *wide_fingerprint(found.view(np.uint64)).tolist(), found.tobytes()]
                    for block in own:
                        for column, value in zip(columns, [block, *values], strict=True):
                            column.append(value)
                types = [pa.int64()] * (2 + _WIDE) + [pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["block", "node", *_WORDS, "shingles"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, node, *words, data in _whole_blocks(batches, 4 * _BUCKET):
            found = [np.frombuffer(d, np.int64) for d in data]
            yield _stars(_confirmed(block, np.array([len(f) for f in found]), np.stack(words, axis=1), found, similarity), node)

    rows = texts.mapInArrow(sets, schema)
    return cut(rows.repartition("block").sortWithinPartitions("block", "node").mapInArrow(verify, "u long, v long").distinct())


def near_copies(df: DataFrame, *, shingle: int = 5, similarity: tuple[int, int] = (4, 5), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and component_id of every row, for links between texts of ``similarity`` (a fraction) or more."""
    df = df.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("doc"), F.col(text_col).alias("text"))
    profiles = cut(_profiles(df, shingle, similarity))
    nodes = cut(profiles.groupBy("node").agg(F.min("id").alias("first"), *[F.min(c).alias(c) for c in ("doc", *_WORDS)]))
    places = profiles.select("node", F.explode("keys").alias("key"))
    shared = cut(places.groupBy("key").count().filter("count > 1").select("key"))
    met = places.join(shared, "key", "left_semi").distinct()
    roots = components(_candidates(met, nodes)).select(F.col("u").alias("node"), F.col("v").alias("root"))
    links = _exact_links(roots, met, df, nodes, shingle, similarity)
    roots = components(links).withColumnRenamed("u", "node")
    member = cut(nodes.join(roots, "node", "left").select("node", "first", F.coalesce("v", "node").alias("root")))
    least = cut(member.groupBy("root").agg(F.min("first").alias("component_id")))
    label = cut(member.join(least, "root").select("node", "component_id"))
    return profiles.select("id", "node").join(label, "node").select(F.col("id").alias(id_col), "component_id")


def representatives(df: DataFrame, *, shingle: int = 5, similarity: tuple[int, int] = (4, 5), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df``, all columns, whose id is the smallest of their component of near copies.

    Rows that repeat that id are one document and stay together; rows without an id stay if
    no row of their component has one.
    """
    found = near_copies(df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), shingle=shingle, similarity=similarity)
    kept = cut(found.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("kept_id")).distinct())
    rows = nested(df, id=F.col(id_col))
    return unnested(rows.join(kept, F.col("id").eqNullSafe(F.col("kept_id")), "left_semi"), df.columns)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
