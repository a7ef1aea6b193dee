"""Searching files.

``read_tree`` finds files below a path as Spark does: recursively, without names that begin
with a dot or underscore.  Binary files (a zero byte in the first KiB) are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patternlake.dialect import CompiledPattern, Flags
from patternlake.functions import count_matching_lines, is_match, matching_lines


def read_tree(spark: SparkSession, path: str, *, glob: str | None = None, binary: bool = False) -> DataFrame:
    """(path, text) of each file below ``path``."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if glob is not None:
        reader = reader.option("pathGlobFilter", glob)
    files = reader.load(path).select("path", "content")
    if not binary:
        # Hexadecimal text: a zero byte stands at an even place.
        head = F.hex(F.substring("content", 1, 1024))
        files = files.filter(~F.regexp_like(head, F.lit("^(?:..)*?00")))
    texts = files.select("path", F.decode("content", "UTF-8").alias("text"))
    return texts.unionByName(_empty_files(spark, path, glob))


def _empty_files(spark: SparkSession, path: str, glob: str | None) -> DataFrame:
    """(path, text) of the empty files below ``path``, which Spark's readers leave out.

    Folders are listed as the readers' own file index does it, through Hadoop on the driver.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(conf)
    fits = jvm.org.apache.hadoop.fs.GlobFilter(glob).accept if glob is not None else lambda _: True
    hidden = lambda p: p.getName().startswith((".", "_"))
    found, todo = [], list(files.globStatus(root) or [])
    while todo:
        status = todo.pop()
        if status.isDirectory():
            todo += [s for s in files.listStatus(status.getPath()) if not hidden(s.getPath())]
        elif status.getLen() == 0 and fits(status.getPath()):
            found.append((status.getPath().toString(), ""))
    return spark.createDataFrame(found, "path string, text string")


def grep(df: DataFrame, pattern: str | CompiledPattern, flags: str | Flags | None = None) -> DataFrame:
    """(path, line_no from 1, line) of each matching line of (path, text) rows.

    A final line feed ends the last line here, and empty files have none, as in other line tools.
    """
    found = matching_lines(df.select("path", F.col("text"), F.octet_length("text").alias("_size")), "text", pattern, flags)
    found = found.filter(~((F.col("line") == "") & (F.col("start") == F.col("_size"))))
    return found.select("path", (F.col("line_no") + 1).alias("line_no"), "line")


def grep_counts(df: DataFrame, pattern: str | CompiledPattern, flags: str | Flags | None = None) -> DataFrame:
    """(path, n) of each file: the number of matching lines."""
    ended = F.when(F.endswith("text", F.lit("\n")), F.expr("substring(text, 1, length(text) - 1)")).otherwise(F.col("text"))
    n = F.when(F.col("text") == "", F.lit(0).cast("long")).otherwise(count_matching_lines(ended, pattern, flags))
    return df.select("path", n.alias("n"))


def files_with_match(df: DataFrame, pattern: str | CompiledPattern, flags: str | Flags | None = None) -> DataFrame:
    return df.filter(is_match("text", pattern, flags)).select("path")
