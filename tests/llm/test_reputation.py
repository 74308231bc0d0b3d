import random
import re
from collections import defaultdict

import pytest

from scriptorium.llm import reputation
from scriptorium.llm.queries import URL_RULES


def registered(host):
    """(registered domain, suffix) by trying every rule on the labels."""
    name = re.sub(r":\d*$", "", host.split("@")[-1]).rstrip(".")
    if re.fullmatch(r"\d{1,3}(\.\d{1,3}){3}|\[.*\]", name):
        return name, "[address]"
    labels = name.split(".")
    fitting = []
    for rule in reputation.SUFFIX_RULES:
        wanted = rule.lstrip("!").split(".")
        if len(wanted) <= len(labels) and all(w in ("*", x) for w, x in zip(wanted, labels[-len(wanted) :], strict=True)):
            fitting.append((rule.startswith("!"), len(wanted)))
    exception, n = max(fitting, default=(False, 1))
    n -= exception
    return ".".join(labels[-n - 1 :]), ".".join(labels[-n:])


def brute(rows):
    """Posterior mean per host, level by level."""
    n, bad = defaultdict(float), defaultdict(float)
    hosts = set()
    for host, b in rows:
        hosts.add(host)
        if b is not None:
            n[host] += 1
            bad[host] += b

    def parents(h):
        return registered(h)

    def shrunk(level):
        """From (n, bad, prior mean, pages behind it) to (posterior mean, its size)."""
        known = [x for x in level.values() if x[0] > 1 and 0 < x[2] < 1]
        spread = sum((b - k * m) ** 2 for k, b, m, _ in known)
        expected = sum(k * m * (1 - m) for k, b, m, _ in known)
        weight = sum(k * m * (1 - m) * (k - 1) for k, b, m, _ in known)
        s = 2.0 if len(known) < 2 else 200.0 if not weight or spread <= expected else min(200.0, max(2.0, weight / (spread - expected) - 1))
        k = {c: max(2.0, min(s, x[3])) for c, x in level.items()}
        return {c: ((m * k[c] + b) / (k[c] + a), k[c] + a) for c, (a, b, m, _) in level.items()}

    def sums(key):
        out = defaultdict(lambda: [0.0, 0.0])
        for h in hosts:
            out[key(h)][0] += n[h]
            out[key(h)][1] += bad[h]
        return out

    total = sum(n.values())
    overall = (sum(bad.values()) + 0.5) / (total + 1)
    top = shrunk({s: (a, b, overall, total) for s, (a, b) in sums(lambda h: registered(h)[1]).items()})
    middle = shrunk({d: (a, b, *top[registered(d)[1]]) for d, (a, b) in sums(lambda h: registered(h)[0]).items()})
    low = shrunk({h: (n[h], bad[h], *middle[registered(h)[0]]) for h in hosts})
    return {h: m for h, (m, _) in low.items()}


@pytest.fixture(scope="module")
def outcomes():
    rng = random.Random(5)
    rows = []
    for h in range(40):
        host = f"{rng.choice(['www', 'm', 'blog'])}.site{h % 15}.{rng.choice(['com', 'net', 'co.uk'])}"
        rate = 0.9 if h % 15 == 3 else rng.choice([0.02, 0.1])
        rows += [(host, None if rng.random() < 0.5 else int(rng.random() < rate)) for _ in range(rng.randrange(1, 60))]
    return rows


def test_against_brute_force(spark, outcomes):
    got = {r.host: r for r in reputation.reputation(spark.createDataFrame(outcomes, "host string, bad int")).collect()}
    want = brute(outcomes)
    assert set(got) == set(want)
    for h, m in want.items():
        assert got[h].bad_rate == pytest.approx(m)
        assert 0 <= got[h].lower_bound <= m
    assert {h for h in got if got[h].lower_bound > reputation.LIMIT} <= {h for h in got if ".site3." in h}
    assert any(got[h].lower_bound > reputation.LIMIT for h in got)


def test_registered_domains(spark):
    hosts = ["www.bbc.co.uk", "shop.evil.co.uk", "co.uk", "a.b.com", "com", "", "localhost", "a.b.com:8080", "x.y.z.ck", "www.ck", "a.www.ck", "a.city.kawasaki.jp", "a.b.c.kawasaki.jp", "me.github.io", "you.github.io", "a.example.com", "10.0.0.1", "..", "a..com"]
    frame = spark.createDataFrame([(h,) for h in hosts], "host string")
    for r in frame.select("host", *(c.alias(n) for n, c in zip(("domain", "suffix"), reputation.levels(frame.host), strict=True))).collect():
        assert (r.domain, r.suffix) == registered(r.host), r.host
    assert registered("www.bbc.co.uk") == ("bbc.co.uk", "co.uk")
    assert registered("a.city.kawasaki.jp") == ("city.kawasaki.jp", "kawasaki.jp")


def test_the_bound_decides_for_hosts_without_labels(spark):
    """All that is known of a suffix is bad, so a new domain there is blocked, and elsewhere it is not."""
    rows = [(i, f"http://s{i}.xx/1") for i in range(300)] + [(1000 + i, f"http://s{i}.yy/1") for i in range(300)]
    frame = spark.createDataFrame([*rows, (5000, "http://new.xx/"), (5001, "http://new.yy/")], "page_id long, url string")
    labels = spark.createDataFrame([(i, int(i < 1000)) for i, _ in rows], "page_id long, bad int")
    got = {r.page_id: r.verdict for r in reputation.judge(frame, labels, []).collect()}
    assert (got[5000], got[5001]) == ("block", "allow")


def rule_of(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    fits = [(len(r), r, v) for v, r in URL_RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
    return host, path, *(max(fits)[1:] if fits else (None, None))


def test_rules(spark):
    urls = ["http://a.com/x", "http://a.com", "http://com/", "http://EXAMPLE.com/en/1?q", "http://www.example.com/en/", "http://w.www.example.com/en/z", "http://xexample.com/en/", "http://example.com/en", "http://b.net/es/#x", "http://b.net/fr/1", "http://b.net/de/1", "http://b.org?x=/en/", None, "", "no scheme", "://", "a://b://c.com/x", "http://a.com:80/x", "http://b.net#/es/"]
    pages = spark.createDataFrame([(i, u, 1) for i, u in enumerate(urls)], "page_id long, url string, verdict int")
    got = {r.page_id: r for r in reputation.judge(pages, spark.createDataFrame([], "page_id long, bad int"), URL_RULES).collect()}
    for i, u in enumerate(urls):
        host, path, rule, verdict = rule_of(u)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule), u
        assert got[i].verdict == (verdict or "allow")


def test_bad_hosts_are_blocked(spark):
    pages = [(i, f"http://spam.spammers.org/{i}") for i in range(50)] + [(100 + i, f"http://good{i % 9}.org/{i}") for i in range(90)]
    frame = spark.createDataFrame([*pages, (None, None), (None, None), (500, "http://spam.spammers.org/unlabelled")], "page_id long, url string")
    labels = spark.createDataFrame([(i, int(i < 50)) for i, _ in pages] + [(None, 1), (3, 1)], "page_id long, bad int")
    rows = reputation.judge(frame, labels, []).collect()
    assert len(rows) == 143
    assert {r.host for r in rows if r.verdict == "block"} == {"spam.spammers.org"}
    assert sum(r.verdict == "block" for r in rows) == 51


def test_empty(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    assert reputation.judge(pages, spark.createDataFrame([], "page_id long, bad int"), URL_RULES).count() == 0


def test_addresses_dots_and_users(spark):
    hosts = {
        "192.168.1.5": ("192.168.1.5", "[address]"), "10.0.1.5:8080": ("10.0.1.5", "[address]"), "[2001:db8::1]:443": ("[2001:db8::1]", "[address]"), "[::1]": ("[::1]", "[address]"),
        "a.example.com.": ("example.com", "com"), "b.example.com.:80": ("example.com", "com"), "user@evil.com": ("evil.com", "com"), "u:p@www.evil.co.uk:81": ("evil.co.uk", "co.uk"), "1.2.3": ("2.3", "3"), "": ("", ""),
    }
    frame = spark.createDataFrame([(h,) for h in hosts], "host string")
    got = {r.host: (r.domain, r.suffix) for r in frame.select("host", *(c.alias(n) for n, c in zip(("domain", "suffix"), reputation.levels(frame.host), strict=True))).collect()}
    assert got == hosts


def test_very_long_urls(spark):
    long = "http://" + "a." * 3000 + "example.com/en/" + "x" * 100_000 + "?q=1"
    pages = spark.createDataFrame([(1, long), (2, "http://" + "b" * 50_000)], "page_id long, url string")
    got = {r.page_id: r for r in reputation.judge(pages, spark.createDataFrame([], "page_id long, bad int"), URL_RULES).collect()}
    assert got[1].host == "a." * 3000 + "example.com" and len(got[1].path) == 100_004 and got[1].rule == "example.com/en/"
    assert got[2].host == "b" * 50_000 and got[2].verdict == "allow"
