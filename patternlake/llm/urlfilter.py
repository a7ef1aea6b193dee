"""URL filters over a memory-mapped sorted digest array.

A filter is a list of strings: rules (``host/path-prefix`` with a verdict) and blocked
hosts or whole URLs.  Their 64-bit xxhash keys lie sorted in one file, followed by the
strings themselves.  The driver writes the file to the shared checkpoint folder and Spark
fetches it to each executor, which maps it into memory: all workers of a machine share
its pages.  Probing hashes the candidate strings of a batch of URLs, finds all of them
with one vectorised binary search, and confirms each hit on the stored string.

The candidates of a URL are its host and parent domains, each with the path prefixes whose
lengths occur among the rules, so a probe's cost follows the lengths of hosts and not the
size of the list.  A list above ``max_bytes`` is refused: it must not grow with the pages.

Defined results: a null URL or one without ``://`` has an empty host and path, fits no rule
and is allowed unless listed; repeated rows are kept; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import mmap
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patternlake.llm.common import table
from patternlake.plans.lineage import shared_file

_MAGIC = b"PLDIGST1"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOLD = str.maketrans(_UPPER, _LOWER)

#: Rules of the registered query, and the hosts that it blocks where no rule fits.
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
BLOCKED_NAMES = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")
BLOCKED_HOSTS = tuple(f"{name}.example.{top}" for name in BLOCKED_NAMES for top in ("com", "net", "org"))


def digest_file(entries: Iterable[tuple[bytes, int]]) -> bytes:
    """Sorted digest array of distinct (string, value below 256) entries.

    Layout: magic, count, keys, string offsets, values, strings.
    """
    rows = sorted((xxhash.xxh64_intdigest(s), s, v) for s, v in dict(entries).items())
    offsets = np.concatenate([[0], np.cumsum([len(s) for _, s, _ in rows])]).astype("<u8") if rows else np.zeros(1, "<u8")
    return b"".join([_MAGIC, struct.pack("<Q", len(rows)), np.array([k for k, _, _ in rows], "<u8").tobytes(), offsets.tobytes(), bytes(v for _, _, v in rows), *(s for _, s, _ in rows)])


class DigestArray:
    """A digest file mapped into memory."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as file:
            self._map = mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)
        if self._map[:8] != _MAGIC:
            raise ValueError("not a digest file")
        (n,) = struct.unpack("<Q", self._map[8:16])
        self._keys = np.frombuffer(self._map, "<u8", n, 16)
        self._offsets = np.frombuffer(self._map, "<u8", n + 1, 16 + 8 * n)
        self._values = np.frombuffer(self._map, np.uint8, n, 24 + 16 * n)
        self._strings = 24 + 17 * n

    def probe(self, strings: list[bytes], digest=xxhash.xxh64_intdigest) -> list[int]:
        """The value of each string, -1 where it isn't listed."""
        found = [-1] * len(strings)
        if not len(self._keys) or not strings:
            return found
        keys = np.fromiter(map(digest, strings), np.uint64, len(strings))
        left = np.searchsorted(self._keys, keys)
        right = np.searchsorted(self._keys, keys, side="right")
        for i in np.flatnonzero(right > left).tolist():
            for at in range(int(left[i]), int(right[i])):  # more than one: colliding keys
                a, b = (self._strings + int(o) for o in self._offsets[at : at + 2])
                if self._map[a:b] == strings[i]:
                    found[i] = int(self._values[at])
        return found


def publish(spark: SparkSession, data: bytes, *, max_bytes: int = 1 << 30) -> str:
    """Write ``data`` to the shared folder and have every executor fetch it; the file's name."""
    if len(data) > max_bytes:
        raise ValueError(f"the list takes {len(data)} bytes, more than max_bytes={max_bytes}")
    name = f"digests-{xxhash.xxh3_128_hexdigest(data)}.bin"
    spark.sparkContext.addFile(shared_file(spark, name, data))
    return name


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://``."""
    at = -1 if url is None else url.find("://")
    if at < 0:
        return "", ""
    rest = url[at + 3 :]
    for stop in "?#":
        rest = rest.partition(stop)[0]
    host, slash, path = rest.partition("/")
    return host.translate(_FOLD), slash + path


def judge(df: DataFrame, *, rules: Iterable[tuple[str, str]], blocked_hosts: Iterable[str] = (), blocked_urls: Iterable[str] = (), id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``id_col``, host, path, rule, verdict of each row.

    A rule fits its host and all subdomains if the path starts with the rule's path; the
    longest rule wins, then the one with the longer host.  Without a rule, URLs that are
    listed, or whose host or parent domain is, are blocked and all others allowed.
    """
    rules = list(rules)
    lengths = sorted({len(r) - len(r.partition("/")[0]) for r, _ in rules}, reverse=True)
    entries = [(b"R" + r.encode(), 1 if v == "block" else 0) for r, v in rules]
    entries += [(b"H" + h.translate(_FOLD).encode(), 1) for h in blocked_hosts] + [(b"U" + u.encode(), 1) for u in blocked_urls]
    name = publish(df.sparkSession, digest_file(entries))
    kind = df.select(F.col(id_col).alias("id")).schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digests = DigestArray(SparkFiles.get(name))
        for batch in batches:
            parsed, strings, spans = [], [], []
            for url in batch.column("url").to_pylist():
                host, path = split_url(url)
                parents = [host, *(host[i + 1 :] for i, c in enumerate(host) if c == ".")]
                own = sorted(((p, path[:n]) for p in parents for n in lengths if n <= len(path)), key=lambda x: (-len(x[0]) - len(x[1]), -len(x[0])))
                parsed.append((host, path, own))
                spans.append(len(strings))
                strings += [b"R" + (p + q).encode() for p, q in own]
                strings += [b"H" + p.encode() for p in parents] + [b"U" + (url or "").encode()]
            values = digests.probe(strings)
            spans.append(len(strings))
            rule, verdict = [], []
            for (_, _, own), a, b in zip(parsed, spans, spans[1:], strict=False):
                hit = next((k for k in range(len(own)) if values[a + k] >= 0), None)
                rule.append(None if hit is None else "".join(own[hit]))
                blocked = values[a + hit] == 1 if hit is not None else max(values[a + len(own) : b]) == 1
                verdict.append("block" if blocked else "allow")
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array([h for h, _, _ in parsed], pa.string()), pa.array([p for _, p, _ in parsed], pa.string()), pa.array(rule, pa.string()), pa.array(verdict, pa.string())],
                names=["id", "host", "path", "rule", "verdict"],
            )

    return df.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")).mapInArrow(run, f"id {kind}, host string, path string, rule string, verdict string").withColumnRenamed("id", id_col)


def op4_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), rules=RULES, blocked_hosts=BLOCKED_HOSTS)


def _fits(host: str, path: str) -> str:
    return f"((host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}'))"


_BY_LENGTH = sorted(RULES, key=lambda r: -len(r[0]))
ORACLE = f"""
WITH rest AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rest
), ruled AS (
  SELECT *, CASE {" ".join(f"WHEN {_fits(r.partition('/')[0], '/' + r.partition('/')[2])} THEN '{r}'" for r, _ in _BY_LENGTH)} END AS rule FROM parts
)
SELECT page_id, host, path, rule, CASE {" ".join(f"WHEN rule = '{r}' THEN '{v}'" for r, v in RULES)}
  WHEN {" OR ".join(f"host = '{h}' OR ends_with(host, '.{h}')" for h in BLOCKED_HOSTS)} THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
"""
