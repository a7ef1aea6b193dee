"""Invariants of the verbs on generated patterns and texts."""

import random

import pytest

from patternlake import functions as R
from patternlake.dialect import PatternError, compile_pattern

ALPHABET = "abc123 \n."


def pattern(rnd, depth=0):
    kind = rnd.randrange(9 if depth < 3 else 4)
    if kind < 3:
        return rnd.choice(["a", "b", "1", ".", r"\d", r"\w", r"\s", "[a-c]", "[^1]", r"\b"])
    if kind == 3:
        return rnd.choice(["^", "$"])
    if kind == 4:
        return f"({pattern(rnd, depth + 1)})"
    if kind == 5:
        return f"(?:{pattern(rnd, depth + 1)}|{pattern(rnd, depth + 1)})"
    if kind == 6:
        return pattern(rnd, depth + 1) + rnd.choice(["*", "+", "?", "{1,2}", "*?", "+?"])
    return pattern(rnd, depth + 1) + pattern(rnd, depth + 1)


@pytest.mark.parametrize("seed", [1, 2])
def test_verbs_agree(spark, seed):
    rnd = random.Random(seed)
    texts = [("".join(rnd.choice(ALPHABET) for _ in range(rnd.randrange(25))),) for _ in range(25)] + [("",), ("abcé1\n",)]
    df = spark.createDataFrame(texts, "t string").coalesce(1)
    patterns = []
    while len(patterns) < 12:
        try:
            patterns.append(compile_pattern(pattern(rnd), rnd.choice(["", "m"])))
        except PatternError as error:
            assert error.code in ("InvalidQuantifier", "PatternTooComplex")
    for p in patterns:
        columns = [R.is_match("t", p), R.find("t", p), R.find_all("t", p), R.count("t", p), R.find_all_text("t", p), R.split("t", p), R.replace_all("t", p, "$0"), R.find_text("t", p)]
        for r in df.select("t", *[c.alias(f"v{i}") for i, c in enumerate(columns)]).collect():
            hit, one, every, n, found, parts, same, text = r[1:]
            assert hit == (one is not None) == (n > 0) and n == len(every) == len(found) == len(parts) - 1, (p.pattern, r.t)
            assert same == r.t and text == (one.match if one else None)
            assert [m.match for m in every] == found and all(r.t[m.start : m.end] == m.match for m in every)
            assert all(a.end <= b.start for a, b in zip(every, every[1:], strict=False))
            if one is not None:
                assert (one.match, one.start, one.end) == (every[0].match, every[0].start, every[0].end), (p.pattern, r.t)
                assert "".join(x + y for x, y in zip(parts, [*found, ""], strict=True)) == r.t
