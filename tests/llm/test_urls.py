"""Url filter: the trie and the joins against all entries tried one by one."""

import random

import pytest
from wavelake.llm import urls

UPPER_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    path = rest[end:]
    return rest[:end].translate(UPPER_LOWER), path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]


def brute(url, entries, default):
    host, path = parts(url)
    fits = [e for e in entries if (host == e[0] or host.endswith("." + e[0])) and path.startswith(e[1])]
    if not fits:
        return host, path, None, default
    best = max(fits, key=lambda e: (e[0].count("."), len(e[1]), e[2] == "block"))
    return host, path, best[0] + best[1], best[2]


def random_cases(n=600, m=120):
    rng = random.Random(5)
    labels, segments = ["a", "b", "ab", "org", "com", "", "ü"], ["", "en", "e", "en1", "1", "1570", "é", "x y"]
    host = lambda: ".".join(rng.choices(labels, k=rng.randint(1, 4)))
    path = lambda: "".join("/" + x for x in rng.choices(segments, k=rng.randint(0, 4)))
    entries = list({(host(), path() + rng.choice(["", "/", "e"]), rng.choice(["allow", "block"])) for _ in range(m)})
    made = [f"http{rng.choice(['', 's', '://a'])}://{rng.choice([host(), host().upper()])}{path()}{rng.choice(['', '?a://b.org/en', '#x', '/?q', 'zz'])}" for _ in range(n)]
    return made, entries


EDGES = [None, "", "no scheme", "://", "://org", "://org/", "x://ORG/", "http://a.org?x", "http://a.org#/es/", "http://example.org/es", "http://example.org/es/", "http://EXAMPLE.org/en/1", "http://www.example.org/en/12/3", "http://notexample.org/en/1",
         "http://example.org./en/1", "http://x.com/fr", "http://x.com/fr/", "http://x.com/de/a?b", "http://com/de/", "http://user@com:80/de/", "http://" + "a." * 20_000 + "org/" + "s/" * 20_000, "http://org/\nx", "ftp://é.org/", "http://example.org/en/1/../es/"]


@pytest.mark.parametrize("few", [True, False])
def test_against_all_entries(spark, monkeypatch, few):
    made, entries = random_cases()
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate([*made, *EDGES])], "page_id long, url string, host string")
    if not few:
        monkeypatch.setattr(urls, "TRIE_ENTRIES", 3)
    for chosen in (entries, list(urls.ENTRIES)):
        got = {r.page_id: tuple(r)[1:] for r in urls.judge(pages, spark.createDataFrame(chosen, "host string, path string, verdict string"), "block").collect()}
        assert len(got) == len(made) + len(EDGES)
        for i, u in enumerate([*made, *EDGES]):
            assert got[i] == brute(u, chosen, "block"), u


def test_precedence(spark):
    trie = urls.Trie([("a.org", "/", "allow"), ("org", "/long/path", "block"), ("a.org", "/x", "allow"), ("a.org", "/x", "block"), ("a.org", "/x/", "allow"), ("b", "", "block")])
    assert trie.match("a.org", "/long/path") == ("a.org/", "allow")  # more host labels first
    assert trie.match("a.org", "/xy") == ("a.org/x", "block")
    assert trie.match("s.a.org", "/x/y") == ("a.org/x/", "allow")
    assert trie.match("b", "") == ("b", "block") and trie.match("a.org", "") is None


def test_entries_and_pages_of_odd_kinds(spark, monkeypatch):
    pages = spark.createDataFrame([(1, "x://A.org/1", "r", "v"), (1, "x://A.org/1", "r", "v"), (None, None, None, None)], "page_id long, url string, rule string, verdict string")
    odd = spark.createDataFrame([("A.org", "/", "block"), (None, "/", "allow"), ("org", None, "allow"), ("org", "/", None)], "host string, path string, verdict string")
    for bound in (10, 0):
        monkeypatch.setattr(urls, "TRIE_ENTRIES", bound)
        assert sorted(map(tuple, urls.judge(pages, odd).collect()), key=repr) == [(1, "a.org", "/1", "a.org/", "block")] * 2 + [(None, "", "", None, "allow")]
        kept = urls.allowed(pages, odd)
        assert kept.columns == pages.columns and [tuple(r) for r in kept.collect()] == [(None, None, None, None)]
        assert urls.judge(pages.where("false"), odd).count() == 0 and urls.judge(pages, odd.where("false")).where("verdict = 'allow' and rule is null").count() == 3
        with pytest.raises(ValueError):
            urls.judge(pages, spark.createDataFrame([("a", "/", "maybe")], "host string, path string, verdict string"))
    with pytest.raises(ValueError):
        urls.judge(pages, [("a", "/", "maybe")])
