import numpy as np
import xxhash

from patternlake.llm import urlfilter
from patternlake.llm.urlfilter import DigestArray, digest_file, judge, split_url


def test_split_url():
    assert split_url("HTTP://User.Example.ORG:80/A/b?x#y") == ("user.example.org:80", "/A/b")
    assert split_url("http://a#b/c") == ("a", "") and split_url("http://a?b://c/d") == ("a", "")
    assert split_url(None) == split_url("") == split_url("no scheme/x") == ("", "")
    assert split_url("x://É.COM/") == ("É.com", "/")


def test_probe_confirms_strings(tmp_path):
    entries = [(f"s{i}".encode(), i % 250) for i in range(5000)]
    path = tmp_path / "d.bin"
    path.write_bytes(digest_file(entries))
    array = DigestArray(str(path))
    asked = [s for s, _ in entries[::7]] + [b"", b"s5001", b"other"]
    assert array.probe(asked) == [v for _, v in entries[::7]] + [-1, -1, -1]
    path.write_bytes(digest_file([]))
    assert DigestArray(str(path)).probe([b"a"]) == [-1]


def test_colliding_keys(tmp_path, monkeypatch):
    weak = lambda s: xxhash.xxh32_intdigest(s) % 3
    monkeypatch.setattr(urlfilter.xxhash, "xxh64_intdigest", weak)
    entries = [(f"s{i}".encode(), i) for i in range(40)]
    path = tmp_path / "d.bin"
    path.write_bytes(digest_file(entries))
    array = DigestArray(str(path))
    assert len(np.unique(array._keys)) <= 3
    assert array.probe([s for s, _ in entries] + [b"x1", b"x2"], weak) == [v for _, v in entries] + [-1, -1]


def plain(url):
    host, path = split_url(url)
    fit = [(r, v) for r, v in urlfilter.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
    rule, verdict = max(fit, key=lambda x: len(x[0]), default=(None, None))
    listed = any(host == h or host.endswith("." + h) for h in urlfilter.BLOCKED_HOSTS)
    return host, path, rule, verdict or ("block" if listed else "allow")


def test_against_plain_rules(spark):
    tops = ["org", "com", "net", "ORG", "example.org", "a.example.org", "spam-farm.example.net", "www.Spam-Farm.example.com", "xexample.org", "org.evil"]
    urls = [f"http://{t}{p}" for t in tops for p in ("", "/", "/es/", "/es", "/en/1", "/en/15?q", "/en/2#t", "/fr/x", "/de/", "?/fr/", "/ES/")]
    urls += [None, "", "no", "://", "http://", "http:///es/", "x" * 100_000, "http://" + "a." * 2000 + "org/y", urls[0]]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").selectExpr("*", "1 AS host", "2 AS id")
    got = {r.page_id: tuple(r)[1:] for r in judge(df, rules=urlfilter.RULES, blocked_hosts=urlfilter.BLOCKED_HOSTS).collect()}
    assert got == {i: plain(u) for i, u in enumerate(urls)}
    assert judge(df.filter("false"), rules=urlfilter.RULES).collect() == []


def test_lists(spark):
    df = spark.createDataFrame([(1, "http://a.b/x"), (1, "http://a.b/y"), (None, "http://c/")], "page_id long, url string")
    got = sorted((r.host, r.path, r.verdict) for r in judge(df, rules=[], blocked_urls=["http://a.b/x"], blocked_hosts=["C"]).collect())
    assert got == [("a.b", "/x", "block"), ("a.b", "/y", "allow"), ("c", "/", "block")]
