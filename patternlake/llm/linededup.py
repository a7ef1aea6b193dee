"""Line dedup by a deletion-neighbourhood join, in built-in expressions only.

Lines are compared as sequences of words.  A line with a word goes if an earlier one (by
document id, text, then line) equals it; lines of ``min_words`` words or more also go if an
earlier one differs by one word inserted, deleted or replaced, as in shorter ones a word is
too much of the line.  Blank lines stay.

1. Equal lines collapse to one content with its earliest place.
2. Of the contents of ``min_words`` words or more, two that are one edit apart share their first or last ``m`` words, where ``m`` is a power
   of two that follows the length (an edit touches one half at most).  Only contents that
   share such a key with another go on; lengths that differ by one share an ``m``, as both
   neighbours' values are emitted where it changes.
3. Each of those emits its deletion neighbourhood as hashed keys: per word the key of the
   line without it, from sums of word hashes, so a variant costs the same for any length.
   Replacements meet on (place, rest); insertions meet the shorter line's own key.
4. Equal keys join to the earliest content of the key, never to all pairs, and the edit is
   verified on the words.  Contents of which a hash said wrongly that they are near the
   earliest of the key are grouped again by the words that are left of them, not by hashes.

Only keys and places are shuffled in steps 1 to 4, and once the texts that hold lines of
step 3.  Before each of these joins a filter of a checked size, one bit for a slot of hashes,
leaves out most rows that have no partner.  Hot lines and keys are aggregated before the
shuffle or joined to one row.

Defined results: null and empty texts have one empty line; null ids come last; rows with
equal (or null) ids are documents of their own, in the order of a 64-bit hash of their
texts, and rows that repeat both id and text are one document, all of whose rows lose the same lines; an empty table gives
no rows; other columns, whatever their names, are ignored by ``removals`` and kept by ``dedup``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from patternlake.llm.common import nested, table, unnested
from patternlake.plans.lineage import cut, release

MIN_WORDS = 8
#: Rows, of 64 slots, that a filter before a shuffle has at most.
_FILTER_ROWS = 1 << 21


def _spaced(text: Column) -> Column:
    """Text whose white space is single spaces, line feeds apart; most texts are so already."""
    text = F.coalesce(text, F.lit(""))
    odd = reduce(lambda a, b: a | b, (F.contains(text, F.lit(c)) for c in ("  ", "\t", "\r", "\x0b", "\x0c")))
    return F.when(odd, F.regexp_replace(text, r"[\x09\x0B-\x0D]|\x20[\x09\x0B-\x0D\x20]+", " ")).otherwise(text)


def _normal(line: Column) -> Column:
    """A line of a spaced text as its words with single spaces."""
    return F.regexp_replace(F.btrim(line), "  +", " ")


def _count(normal: Column) -> Column:
    return F.when(normal == "", 0).otherwise(F.length(normal) - F.length(F.replace(normal, F.lit(" "), F.lit(""))) + 1)


def _half(n: Column) -> Column:
    """The largest power of two that is at most half of ``n``."""
    return F.call_function("shiftleft", F.lit(1), F.length(F.bin(F.floor(n / 2))) - 1)


def _first_words(normal: Column, m: Column) -> Column:
    """The first ``m`` words of a normal line; the last ``-m`` for a negative number."""
    return F.call_function("substring_index", normal, F.lit(" "), m)


def _identity(normal: Column) -> list[Column]:
    return [F.xxhash64(normal).alias("h1"), F.xxhash64(F.lit(1), normal).alias("h2")]


def _keyed(id_: Column, text: Column) -> dict[str, Column]:
    """What tells documents apart: the id and a hash of the text."""
    return {"id": id_, "doc": F.xxhash64(text), "text": text}


def _lines(df: DataFrame) -> DataFrame:
    """(id, doc, line, normal, n) of the lines with a word; ``df``: id, doc, text."""
    found = df.select("id", "doc", F.posexplode(F.transform(F.split(_spaced(F.col("text")), "\n"), lambda line: F.btrim(line))).alias("line", "normal"))
    return found.filter("normal <> ''").select("id", "doc", "line", "normal", _count(F.col("normal")).alias("n"))


def _place() -> Column:
    """Places in their order; null ids last."""
    return F.struct(F.col("id").isNull().alias("none"), "id", "doc", "line")


def _contents(df: DataFrame, min_words: int) -> DataFrame:
    """(h1, h2, times, place, n, k1..k4): distinct lines, and the keys of step 2 of those that have any.

    Short lines that occur once have no part in anything that follows and are left out.
    """
    normal, n, long = F.col("normal"), F.col("n"), F.col("n") >= min_words
    small, large = _half(n - 1), _half(n)
    other = long & (small != large)
    keys = [
        F.when(long, F.xxhash64(F.lit(0), _first_words(normal, large))),
        F.when(long, F.xxhash64(F.lit(1), _first_words(normal, -large))),
        F.when(other, F.xxhash64(F.lit(0), _first_words(normal, small))),
        F.when(other, F.xxhash64(F.lit(1), _first_words(normal, -small))),
    ]
    keyed = _lines(df).select(*_identity(normal), _place().alias("place"), "n", *[k.alias(f"k{i}") for i, k in enumerate(keys)])
    found = keyed.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("times"), F.min("place").alias("place"), F.min("n").alias("n"), *[F.min(f"k{i}").alias(f"k{i}") for i in range(4)])
    return found.filter((F.col("times") > 1) | (F.col("n") >= min_words))


def _probably(df: DataFrame, by: list[str], wanted: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of ``df`` whose columns ``by`` may be among the ``keys`` of ``wanted``, which must be cut.

    All that are, and of the others those that share a slot with one: one in sixteen while the
    slots suffice for that, up to one in four.  Beyond that, ``df`` is left as it is; the join
    that follows is exact anyway.
    """
    n = wanted.count()
    if n > 16 * _FILTER_ROWS:
        return df
    slots = min(16 * n + 64, 64 * _FILTER_ROWS)
    slot = lambda columns: F.pmod(F.xxhash64(*columns), F.lit(slots))
    word, bit = F.floor(F.col("slot") / 64), (F.col("slot") % 64).cast("int")
    taken = wanted.select(slot(keys).alias("slot")).groupBy(word.alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("mask"))
    # Two numbers for each of _FILTER_ROWS words at most.
    marked = df.withColumn("slot", slot(by)).join(F.broadcast(taken), word == F.col("word"))
    return marked.filter(F.getbit("mask", bit) == 1).select(*df.columns)


def _without(words: Column, i: Column) -> Column:
    return F.concat_ws(" ", F.slice(words, 1, i), F.slice(words, i + 2, F.size(words)))


def _dominated(df: DataFrame, contents: DataFrame, min_words: int) -> DataFrame:
    """(h1, h2) of the contents that are one edit from an earlier one."""
    contents = contents.filter(F.col("n") >= min_words)
    keys = contents.select("h1", "n", F.explode(F.array_compact(F.array(*[f"k{i}" for i in range(4)]))).alias("key"))
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.min("n").alias("least"), F.max("n").alias("most")).filter("c > 1")
    shared = cut(shared.select("key", (F.col("least") < F.col("most")).alias("varied")))
    # Contents whose keys are shared by lines of one length only can't be one insertion apart.
    alike = cut(_probably(keys, ["key"], shared, ["key"]).join(shared, "key").groupBy("h1").agg(F.max("varied").alias("varied")))
    near = _probably(contents, ["h1"], alike, ["h1"]).join(alike, "h1").select("h1", "h2", "place", "varied")
    # A document's own lines, so no more of them than its text has.
    wanted = near.groupBy(F.col("place.id").alias("w_id"), F.col("place.doc").alias("w_doc")).agg(F.collect_list(F.struct("place.line", "h1", "h2", "place", "varied")).alias("wanted"))
    wanted = cut(wanted)
    found = _probably(df, ["id", "doc"], wanted, ["w_id", "w_doc"]).join(wanted, (F.col("doc") == F.col("w_doc")) & F.col("id").eqNullSafe(F.col("w_id"))).select(F.split(_spaced(F.col("text")), "\n").alias("lines"), "wanted")
    found = found.select("lines", F.explode("wanted").alias("w")).select("w.h1", "w.h2", "w.place", "w.varied", _normal(F.get("lines", F.col("w.line"))).alias("normal"))
    # Repeated rows count once.
    same = (F.xxhash64("normal") == F.col("h1")) & (F.xxhash64(F.lit(1), "normal") == F.col("h2"))
    found = cut(found.filter(same).dropDuplicates(["h1", "h2"]).select("h1", "h2", "place", "varied", F.split("normal", " ").alias("words")))
    release(shared, alike, wanted)

    # 40-bit hashes: sums of some eight million words fit a long.  Sums over (place, word) tell
    # replacements, sums over words and over neighbouring pairs tell insertions.
    hashed = lambda *c: F.shiftrightunsigned(F.xxhash64(*c), 24)
    pair = lambda a, b: hashed(F.coalesce(a, F.lit("")), F.lit(2), F.coalesce(b, F.lit("")))
    total = lambda f: F.aggregate(F.transform("words", f), F.lit(0).cast("long"), lambda a, x: a + x)
    at = lambda i: F.get("words", i)
    sums = found.select(
        "h1", "h2", "place", "varied", "words", F.size("words").alias("n"),
        total(lambda w, i: hashed(i, w)).alias("s1"), total(lambda w, i: hashed(w, i)).alias("s2"), total(lambda w: hashed(w)).alias("t1"),
        (total(lambda w, i: pair(at(i - 1), w)) + pair(F.element_at("words", -1), F.lit(None))).alias("t2"),
    )

    def variant(w: Column, i: Column) -> Column:
        before, after = at(i - 1), at(i + 1)
        replaced = F.xxhash64(i, "n", F.col("s1") - hashed(i, w), F.col("s2") - hashed(w, i))
        shorter = F.xxhash64(F.col("n") - 1, F.col("t1") - hashed(w), F.col("t2") - pair(before, w) - pair(w, after) + pair(before, after))
        # Any word of a run of equal ones gives the same shorter line.
        return F.struct(replaced.alias("replaced"), F.when(F.col("varied") & ~F.coalesce(before == w, F.lit(False)), shorter).alias("shorter"))

    variants = sums.select("h1", F.posexplode(F.transform("words", variant)).alias("i", "keys"))
    replaced = variants.select("h1", "i", F.col("keys.replaced").alias("key"))
    # Slim rows find the keys that two contents share; only those take places along.
    met = replaced.groupBy("key").agg(F.min("h1").alias("a"), F.max("h1").alias("b")).filter("a <> b")
    twice = cut(met.select("key"))
    # An inner join, as the optimizer would move a semi-join below the filter.
    met = cut(_probably(replaced, ["key"], twice, ["key"]).join(twice, "key"))
    release(twice)
    met = met.join(found.select("h1", "h2", "place"), "h1")
    first = met.groupBy("key").agg(F.min(F.struct("place", "h1", "h2")).alias("e"))
    # The earliest content of a key is one edit from all others of it.
    pairs = met.join(cut(first), "key").filter((F.col("h1") != F.col("e.h1")) | (F.col("h2") != F.col("e.h2")))
    pairs = pairs.filter(F.col("place") > F.col("e.place")).select("key", "h1", "h2", "place", F.col("e.h1").alias("e1"), F.col("e.h2").alias("e2"), "i")
    words = found.select("h1", "h2", "words")
    earlier = words.select(F.col("h1").alias("e1"), F.col("h2").alias("e2"), F.col("words").alias("e_words"))
    rest = _without(F.col("words"), F.col("i"))
    checked = pairs.join(words, ["h1", "h2"]).join(earlier, ["e1", "e2"]).withColumn("same", rest == _without(F.col("e_words"), F.col("i")))
    checked = cut(checked.select("key", "h1", "h2", "place", "i", F.size("words").alias("n"), "same", F.when(~F.col("same"), rest).alias("rest")))
    odd = checked.filter("NOT same")
    again = odd.groupBy("key", "n", "i", "rest").agg(F.min(F.struct("place", "h1", "h2")).alias("e"))
    again = odd.join(again, ["key", "n", "i", "rest"]).filter(F.col("place") > F.col("e.place")).select("h1", "h2")
    checked = checked.filter("same").select("h1", "h2").unionByName(again)

    longer = variants.select("h1", "i", F.col("keys.shorter").alias("key")).filter("key IS NOT NULL")
    own = sums.filter("varied").select(F.xxhash64("n", "t1", "t2").alias("key"), F.col("h1").alias("e1"), F.col("h2").alias("e2"), F.col("place").alias("e_place"))
    matched = longer.join(own, "key").join(found.select("h1", "h2", "place", "words"), "h1").join(earlier, ["e1", "e2"])
    matched = matched.filter(_without(F.col("words"), F.col("i")) == F.concat_ws(" ", "e_words"))
    later = F.col("place") > F.col("e_place")
    matched = matched.select(F.when(later, F.col("h1")).otherwise(F.col("e1")).alias("h1"), F.when(later, F.col("h2")).otherwise(F.col("e2")).alias("h2"))
    near = cut(checked.unionByName(matched).distinct())
    release(found)
    return near


def _removed(df: DataFrame, min_words: int) -> DataFrame:
    """(r_id, r_doc, removed): sorted numbers of the lines that go, for documents that lose any."""
    contents = cut(_contents(df, min_words))
    gone = _dominated(df, contents, min_words).select("h1", "h2", F.lit(None).cast(contents.schema["place"].dataType).alias("place"), F.lit(True).alias("gone"))
    repeated = contents.filter("times > 1").select("h1", "h2", "place", F.lit(False).alias("gone"))
    judged = repeated.unionByName(gone).groupBy("h1", "h2").agg(F.max("gone").alias("gone"), F.min("place").alias("place"))
    judged = cut(judged.select("h1", "h2", F.when(~F.col("gone"), F.col("place")).alias("keep")))
    release(contents)
    lines = _lines(df).select("id", "doc", "line", *_identity(F.col("normal")))
    lost = _probably(lines, ["h1", "h2"], judged, ["h1", "h2"]).join(judged, ["h1", "h2"]).filter(F.col("keep").isNull() | (_place() != F.col("keep")))
    return cut(lost.groupBy(F.col("id").alias("r_id"), F.col("doc").alias("r_doc")).agg(F.sort_array(F.collect_set("line")).alias("removed")))


def _with_removed(df: DataFrame, removed: DataFrame) -> DataFrame:
    return df.join(removed, (F.col("doc") == F.col("r_doc")) & F.col("id").eqNullSafe(F.col("r_id")), "left")


def removals(df: DataFrame, *, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, n_lines, n_removed and removed (numbers of the lines that go, from 0)."""
    if min_words < 4:
        raise ValueError("min_words must be 4 at least")
    rows = df.select(*[c.alias(n) for n, c in _keyed(F.col(id_col), F.col(text_col)).items()])
    lines = F.size(F.split(F.coalesce("text", F.lit("")), "\n")).cast("long")
    found = _with_removed(rows.select("id", "doc", lines.alias("n_lines")), _removed(rows, min_words))
    found = found.withColumn("removed", F.coalesce("removed", F.array().cast("array<int>")))
    return found.select(F.col("id").alias(id_col), "n_lines", F.size("removed").cast("long").alias("n_removed"), F.array_join("removed", ",").alias("removed"))


def dedup(df: DataFrame, *, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = None) -> DataFrame:
    """``df`` with the lines taken out of its texts; texts that lose their last line go.

    ``chars_col`` is set to the new length where lines went.
    """
    keyed = _keyed(F.col(id_col), F.col(text_col))
    rows = df.select(*[c.alias(n) for n, c in keyed.items()])
    found = _with_removed(nested(df, id=keyed["id"], doc=keyed["doc"]), _removed(rows, min_words))
    text = F.col("row").getField(text_col)
    found = found.select("row", "removed", F.when(F.col("removed").isNotNull(), F.split(text, "\n")).alias("every"))
    places = F.array_except(F.sequence(F.lit(0), F.size("every") - 1), "removed")
    # A generator of one row keeps the arrays out of the filter's and the columns' expressions.
    kept = F.when(F.col("every").isNotNull(), F.transform(places, lambda i: F.get("every", i)))
    found = found.select("row", F.explode(F.array(F.struct(kept.alias("kept")))).alias("one")).select("row", "one.kept")
    found = found.filter("kept IS NULL OR size(kept) > 0").withColumn("new", F.array_join("kept", "\n"))
    replaced = {text_col: F.coalesce("new", text)}
    if chars_col is not None:
        replaced[chars_col] = F.when(F.col("new").isNotNull(), F.length("new").cast(df.schema[chars_col].dataType)).otherwise(F.col("row").getField(chars_col))
    return unnested(found, df.columns, **replaced)


def op7_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removals(table(spark, sf_dir, "documents"))


ORACLE = f"""
WITH raw AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
lines AS (SELECT doc_id, unnest(range(len(l))) AS line, regexp_extract_all(unnest(l), '[^\\x20\\x09-\\x0D]+') AS w FROM raw),
used AS (SELECT doc_id, line, w, array_to_string(w, ' ') AS t FROM lines WHERE len(w) > 0),
first AS (SELECT t, any_value(w) AS w, min(struct_pack(d := doc_id, l := line)) AS place FROM used GROUP BY t),
cuts AS (SELECT t, place, i, len(w) AS n, array_to_string(list_concat(w[1:i - 1], w[i + 1:len(w)]), ' ') AS rest FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM first WHERE len(w) >= {MIN_WORDS})),
near AS (
  SELECT a.t FROM cuts a JOIN cuts b ON a.i = b.i AND a.n = b.n AND a.rest = b.rest WHERE a.t <> b.t AND a.place > b.place
  UNION SELECT CASE WHEN a.place > b.place THEN a.t ELSE b.t END FROM cuts a JOIN first b ON a.rest = b.t WHERE len(b.w) >= {MIN_WORDS}
),
gone AS (SELECT u.doc_id, u.line FROM used u JOIN first f ON u.t = f.t WHERE u.t IN (SELECT t FROM near) OR struct_pack(d := u.doc_id, l := u.line) <> f.place),
per AS (SELECT doc_id, count(*) AS n, string_agg(line::VARCHAR, ',' ORDER BY line) AS removed FROM gone GROUP BY doc_id)
SELECT r.doc_id, len(l)::BIGINT AS n_lines, coalesce(n, 0)::BIGINT AS n_removed, coalesce(removed, '') AS removed FROM raw r LEFT JOIN per ON r.doc_id = per.doc_id
"""
