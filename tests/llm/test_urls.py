import random
import re

import pytest

from chainlake.llm import urls


def plain_address(url):
    if url is None or "://" not in url:
        return None
    host, path = plain_parts(url)
    m = re.match(r"(?s)[^?#]*\?([^#]*)", url.split("://", 1)[1])
    kept = sorted(p for p in (m[1].split("&") if m else []) if p and not re.match(urls.TRACKING, p))
    return re.sub(r"^www\.", "", host) + path.rstrip("/") + ("?" + "&".join(kept) if kept else "")


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return host.translate(str.maketrans(urls.UPPER, urls.LOWER)), re.match(r"[^?#]*", rest[len(host) :])[0]


def plain(rows, rules, listed):
    known = {plain_address(u) for u in listed} - {None}
    out = []
    for i, u in rows:
        host, path = plain_parts(u)
        fits = [(len(h + p), h + p, v) for h, p, v in rules if u and "://" in u and (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(0, None, None))
        out.append((str(i), host, path, best[1], best[2] or ("block" if plain_address(u) in known else "allow")))
    return sorted(out, key=str)


def got(spark, rows, rules, listed, **options):
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, key string, block int").repartition(3)
    rules = spark.createDataFrame(list(rules), "host string, path string, verdict string")
    listed = spark.createDataFrame([(u,) for u in listed], "url string")
    found = urls.filter_urls(pages, rules, listed, **options)
    return sorted(((str(r.page_id), r.host, r.path, r.rule, r.verdict) for r in found.collect()), key=str)


EDGES = [None, "", "no scheme", "http://", "http://NET", "http://a.net/", "http://a.net", "http://a.net?x=/", "http://a.net#/", "http://planet/", "http://EXAMPLE.net/en/x", "http://xexample.net/en/x", "https://w.example.com/de/1?b=2&a=1&utm_x=3#f", "x://org/fr/", "a://b://c/d", "http://org/FR/", "http://www.é.org/a//", "http://h/a?#x", "http://h/a#x?y", "http://h\n/p\nq", "http://a.b.c.d.e.net:80/en/?"]


def test_edges(spark):
    rows = list(enumerate(EDGES)) + [(None, EDGES[5]), (3, EDGES[5]), (3, EDGES[5])]
    listed = ["http://h/a", "http://w.example.com/de/1?a=1&b=2", None, "nothing", "https://WWW.é.org/a?utm_source=z", "http://h/a/"]
    assert got(spark, rows, urls.RULES, listed) == plain(rows, urls.RULES, listed)
    assert got(spark, [], urls.RULES, listed) == []
    assert got(spark, rows, [], []) == plain(rows, [], [])


@pytest.mark.parametrize("max_blocks", [64, 1 << 20])
def test_against_brute_force(spark, max_blocks):
    rng = random.Random(max_blocks)
    host = lambda: ".".join(rng.choices(["a", "b", "net", "www", "Org"], k=rng.randrange(1, 5)))
    url = lambda: f"{rng.choice(['http', 'https'])}://{host()}/{'/'.join(rng.choices(['en', 'x', 'de', ''], k=rng.randrange(0, 4)))}{rng.choice(['', '?ref=1', '?q=1&p=2', '#t', '?p=2&q=1&utm_source=1'])}"
    rows = [(i, url()) for i in range(1500)]
    rules = [("net", "/", "block"), ("a.net", "/en", "allow"), ("b", "", "block"), ("org", "/x/de", "allow"), ("a.b.net", "/en/x", "block")]
    listed = [url() for _ in range(900)]
    want = plain(rows, rules, listed)
    assert got(spark, rows, rules, listed, max_blocks=max_blocks) == want
    assert {r[4] for r in want if r[3] is None} == {"allow", "block"}


def test_rules_of_many_shapes(spark):
    """More hosts, labels and lengths of paths than a plan could hold as expressions."""
    rng = random.Random(6)
    hosts = [".".join(rng.choices("abc", k=rng.randrange(1, 9))) for _ in range(150)]
    path = lambda n: "/" + "".join(rng.choices("xy/", k=rng.randrange(0, n)))
    rules = [(rng.choice(hosts), path(60), rng.choice(["allow", "block"])) for _ in range(400)] + [("", "/x", "block")]
    rules = list({(h, p): (h, p, v) for h, p, v in rules}.values())
    rows = [(i, f"http://{rng.choice(['', 'q.', 'a.'])}{h}{p}{rng.choice(['', 'x', '/y', '?x'])}") for i, (h, p, _) in enumerate(rng.choices(rules, k=800))]
    rows += [(9000, "http://" + "a." * 3000 + "c/x"), (9001, "http:///x"), (9002, "http://a/" + "x" * 5000)]
    assert got(spark, rows, rules, []) == plain(rows, rules, [])
    assert got(spark, rows, rules, [], max_blocks=64) == plain(rows, rules, [])


def test_filter_has_no_false_negative_and_few_false_positives(spark):
    keys = spark.range(4000).selectExpr("concat('page ', id) key")
    words, blocks = urls.blocked_bloom(keys, 4000)
    probe = spark.range(8000).selectExpr("id", "concat('page ', id) key")
    need = urls._mask(probe["key"])
    hit = probe.withColumn("block", urls._block(probe["key"], blocks)).join(words, "block").where(words["word"].bitwiseAND(need) == need)
    ids = {r.id for r in hit.collect()}
    assert set(range(4000)) <= ids and len(ids) < 4000 + 400
