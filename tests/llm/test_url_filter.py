import pytest

from sievemill.llm import url_filter as uf

RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
URLS = [
    "http://A.Example.com/en/71?x#y", "https://example.com/en/8", "x.com/en/8", "ftp://net/de/8", "http://example.net/de/81", "http://notexample.net/de/8", "http://x.org?/es/", "http://x.org/es/", None, "", "http://",
    "http://a#b://c/en/", "http://x.com/EN/", "http://ÄX.com/en/\n1", "weird",
]


def plain(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    return host, path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]


def plain_rule(host, path):
    fits = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else None


@pytest.mark.parametrize("inline", [256, 0])
def test_rules(spark, inline):
    urls = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS)] + [(0, URLS[0], "x")], "page_id long, url string, url_host string")
    got = uf.with_rules(urls, RULES, inline=inline).collect()
    assert len(got) == len(URLS) + 1
    for r in got:
        host, path = plain(r.url)
        assert (r.url_host, r.url_path) == (host, path)
        assert (r.url_rule and tuple(r.url_rule)) == plain_rule(host, path)


def test_trees_learn_from_labels(spark):
    rows = [(f"http://good{i}.example.org/a/{i}", 0) for i in range(120)] + [(f"http://spam{i * 977}{i * 977}.example.biz/x?a={i}&b=1&c=2&d=3", 1) for i in range(120)]
    urls = spark.createDataFrame([(u,) for u, _ in rows] + [(None,), ("",)], "url string")
    got = {r.url: r.url_verdict for r in uf.judge(urls, [], spark.createDataFrame(rows, "url string, blocked int")).collect()}
    assert sum((got[u] == "block") == bool(y) for u, y in rows) >= 0.95 * len(rows)
    assert set(got.values()) <= {"allow", "block"} and None in got


def test_without_labels(spark):
    urls = spark.createDataFrame([("http://a.b/c", "x")], "url string, url_verdict string")
    assert [r.url_verdict for r in uf.judge(urls, RULES).collect()] == ["allow"]
    assert uf.judge(urls.limit(0), RULES).count() == 0


@pytest.mark.parametrize("broadcast", [10**6, 0])
def test_suffix_rates_of_all_rows_and_sample_of_different_urls(spark, monkeypatch, broadcast):
    monkeypatch.setattr(uf, "BROADCAST_SUFFIXES", broadcast, raising=False)
    rows = [(f"http://h{i}.site{i % 40}.t{i % 40 % 7}/p", int(i % 40 < 15)) for i in range(400)] * 60  # each URL 60 times: more than the sample
    labelled = spark.createDataFrame(rows, "url string, blocked int")
    found = uf.Filter(labelled, fit_rows=60)
    assert found.constant is None
    want = {}
    for url, y in rows:
        host = url.split("/")[2].split(".")
        for key in (".".join(host[-2:]), host[-1]):
            n, total = want.get(key, (0, 0))
            want[key] = n + 1, total + y
    mean = sum(y for _, y in rows) / len(rows)
    got = {r[0]: r[1] for _, _, rates in found.rates for r in rates.collect()}
    assert got == {k: pytest.approx((t + uf.SMOOTHING * mean) / (n + uf.SMOOTHING)) for k, (n, t) in want.items()}
    urls = labelled.distinct()
    judged = uf.judge(urls, [], labelled, fit_rows=60).collect()
    assert sum((r.url_verdict == "block") == bool(r.blocked) for r in judged) >= 0.95 * len(judged) and len(judged) == 400


def test_unseen_urls(spark):
    import random

    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(3, 9)))

    def made(y):
        host = f"{word()}{rng.randrange(10**6) if y else ''}.{word()}.{rng.choice(['biz', 'org'] if y else ['com', 'org'])}"
        return f"http://{host}/{'/'.join(word() for _ in range(rng.randrange(1, 4)))}{'?' + '&'.join(f'{word()}={rng.randrange(10**5)}' for _ in range(4)) if y and rng.random() < 0.8 else ''}"

    rows = [(made(i % 2), i % 2) for i in range(1200)]
    labelled, rest = (spark.createDataFrame(r, "url string, blocked int") for r in (rows[:900], rows[900:]))
    judged = uf.judge(rest, [], labelled).collect()
    assert sum((r.url_verdict == "block") == bool(r.blocked) for r in judged) >= 0.9 * len(judged)


def test_random_labels_of_rare_suffixes_are_not_learned(spark):
    rows = [(f"http://a.site{i}.t{i}/p", int(i * 7919 % 3 == 0)) for i in range(600)]  # each suffix once: its own rate would tell its label
    labelled = spark.createDataFrame(rows, "url string, blocked int")
    judged = uf.judge(labelled, [], labelled).collect()
    assert sum((r.url_verdict == "block") == bool(r.blocked) for r in judged) < 0.8 * len(judged)


def test_ties_of_rules_and_long_urls(spark):
    rules = [("block", "com", "/a"), ("allow", "com", "/a"), ("block", "b.com", "/"), ("allow", "com", "/aa")]
    long = "http://x.com/a" + "b/" * 50_000 + "?" + "k=v&" * 50_000
    urls = spark.createDataFrame([("http://x.com/a1",), ("http://b.com/aa",), (long,)], "url string")
    for inline in (256, 0):
        assert {r.url[:15]: tuple(r.url_rule) for r in uf.with_rules(urls, rules, inline=inline).collect()} == {"http://x.com/a1": ("com/a", "allow"), "http://b.com/aa": ("b.com/", "block"), "http://x.com/ab": ("com/a", "allow")}
    assert {r.url_verdict for r in uf.judge(urls, rules).collect()} == {"allow", "block"}
