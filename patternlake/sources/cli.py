"""Command line: ``python -m patternlake.sources.cli [-g|-L|-c] [-i] [-m] [-r TEMPLATE] PATTERN [PATH]``.

Without a path the standard input is read.  The exit code is 1 if nothing matches.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from patternlake import functions as R
from patternlake.dialect import PatternError, compile_pattern
from patternlake.sources.files import grep, grep_counts, read_tree


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="patternlake")
    p.add_argument("pattern")
    p.add_argument("path", nargs="?")
    p.add_argument("-g", "--global", dest="every", action="store_true", help="all matches")
    p.add_argument("-r", "--replace", metavar="TEMPLATE", help="print the text with matches replaced")
    p.add_argument("-i", "--ignore-case", action="store_true")
    p.add_argument("-m", "--multiline", action="store_true")
    p.add_argument("-L", "--lines", action="store_true", help="print matching lines")
    p.add_argument("-c", "--count", action="store_true", help="print the number of matching lines")
    return p


def run(spark: SparkSession, argv: list[str], stdin=sys.stdin, out=sys.stdout) -> int:
    args = parser().parse_args(argv)
    try:
        p = compile_pattern(args.pattern, "i" * args.ignore_case + "m" * args.multiline)
    except PatternError as error:
        print(error, file=sys.stderr)
        return 2
    files = read_tree(spark, args.path) if args.path else spark.createDataFrame([("-", stdin.read())], "path string, text string")
    if args.count:
        found = grep_counts(files, p)
        total = 0
        for row in found.orderBy("path").toLocalIterator():
            print(f"{row.path}:{row.n}" if args.path else row.n, file=out)
            total += row.n
        return int(not total)
    if args.lines:
        n = 0
        for row in grep(files, p).orderBy("path", "line_no").toLocalIterator():
            print(f"{row.path}:{row.line}" if args.path else row.line, file=out)
            n += 1
        return int(not n)
    if args.replace is not None:
        verb = R.replace_all if args.every else R.replace
        for row in files.select(verb("text", p, args.replace).alias("t"), R.is_match("text", p).alias("hit")).toLocalIterator():
            out.write(row.t)
        return int(files.filter(R.is_match("text", p)).isEmpty())
    n = 0
    for row in files.select(R.find_all_text("text", p).alias("found")).toLocalIterator():
        for text in (row.found if args.every else row.found[:1]) or ():
            print(text, file=out)
            n += 1
    return int(not n)


if __name__ == "__main__":
    sys.exit(run(SparkSession.builder.appName("patternlake").getOrCreate(), sys.argv[1:]))
