"""Rules and parsing against a plain version, and a planted bad host among good ones."""

import pytest

from trailmark.llm import hosts

URLS = [
    "http://Blog.Example.ORG/es/1?x=/a", "https://example.org/en/17#top", "https://example.org/en/27", "http://a.com/fr/1", "http://a.com/de/1", "http://xcom/fr/1",
    "http://a.net", "http://a.org", "no scheme", "", None, "ftp://u@h.co.uk:80/p?q#r", "x://y://z/1", "http://10.0.0.1/a", "http://a.org/é\n/b?c", "http:///only/path", "http://badexample.org/es/",
]


def plain(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        at = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, tail = rest[:at], rest[at:]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
        path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    fit = [r for r in hosts.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fit, key=lambda r: len(r.host + r.path), default=None)
    return host, path, best and best.host + best.path, best and best.verdict


def tables(spark, extra=()):
    pages = [(i, u, "h", 1.0) for i, u in enumerate(URLS)] + [(None, "http://a.com/x", None, None)] * 2 + list(extra)
    return spark.createDataFrame(pages, "page_id long, url string, host string, rate double")


def test_rules_and_parsing(spark, no_labels):
    found = {r.page_id: r for r in hosts.judge(tables(spark), no_labels).collect() if r.page_id is not None}
    for i, url in enumerate(URLS):
        host, path, rule, verdict = plain(url)
        assert (found[i].host, found[i].path, found[i].rule) == (host, path, rule)
        assert found[i].verdict == (verdict or "allow")
    assert hosts.judge(tables(spark), no_labels).count() == len(URLS) + 2
    assert hosts.judge(tables(spark).limit(0), no_labels).count() == 0


def test_places(spark):
    names = ["a.b.co.uk", "co.uk", "x.example.org", "example.org", "org", "10.0.0.1", "", "u@s.t.net:8080", "t.net."]
    found = {r.host: (r.suffix, r.domain) for r in hosts.places(spark.createDataFrame([(n,) for n in names], "host string")).collect()}
    assert found == {
        "a.b.co.uk": ("co.uk", "b.co.uk"), "co.uk": ("co.uk", "co.uk"), "x.example.org": ("org", "example.org"), "example.org": ("org", "example.org"), "org": ("org", "org"),
        "10.0.0.1": ("", "10.0.0.1"), "": ("", ""), "u@s.t.net:8080": ("net", "t.net"), "t.net.": ("net", "t.net"),
    }


def planted(spark):
    pages, labels = [], []
    for h in range(40):
        for k in range(30):
            i = h * 100 + k
            pages.append((i, f"http://s{h % 4}.site{h // 4}.net/p{k}", None, None))
            labels.append((i, int(h // 4 != 3 and k % 10 > 0), int(h // 4 == 3 and k % 10 > 0)))
    pages += [(9000, "http://new.site3.net/", None, None), (9001, "http://new.site5.net/", None, None), (9002, "http://unseen.net/", None, None), (9003, "http://once.net/", None, None)]
    labels += [(9003, 0, 1), (9003, None, None), (None, 0, 1)]
    return tables(spark, pages), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("send", [1_000_000, 0])
def test_planted_bad_domain(spark, monkeypatch, send):
    monkeypatch.setattr(hosts, "SEND_ROWS", send)
    monkeypatch.setattr(hosts, "HOT_SHARE", 0.02)
    pages, labels = planted(spark)
    rows = hosts.judge(pages, labels).collect()
    assert len(rows) == pages.count()
    found = {r.host: r for r in rows}
    bad = {h for h, r in found.items() if r.verdict == "block" and r.rule is None}
    assert {"s0.site3.net", "s1.site3.net", "s2.site3.net", "s3.site3.net"} <= bad <= {"s0.site3.net", "s1.site3.net", "s2.site3.net", "s3.site3.net", "new.site3.net"}
    assert found["new.site3.net"].rate > 0.7 > 0.3 > found["new.site5.net"].rate  # an unseen host inherits its domain
    assert found["once.net"].bound < 0.5 and found["s0.site3.net"].bound < found["s0.site3.net"].rate


def test_shrinkage_by_hand(spark):
    """With a prior of size m around p, k of n outcomes give (k + m p) / (n + m)."""
    pages, labels = planted(spark)
    counted = hosts.outcomes(pages, labels)
    one = {r.host: r for r in counted.collect()}["s1.site2.net"]
    rate = {r.host: r.rate for r in hosts.reputation(counted).collect()}
    assert 0 <= one.bad <= one.n <= one.pages == 30
    assert min(one.bad / one.n, 0.05) <= rate["s1.site2.net"] <= 0.5
