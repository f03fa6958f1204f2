"""URL filters against every rule."""

import random

from pyspark.sql import functions as F

from cadenza.llm.queries import URL_RULES
from cadenza.llm.url_filter import filter_urls, parsed_rules, rule_table


def plain(url, rules, default="allow"):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = [(len(h) + len(p), len(h), a == "block", r, a) for h, p, r, a in parsed_rules(rules) if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[4] if best else default


def test_against_all_rules(spark):
    rng = random.Random(4)
    labels, tlds = ["a", "b", "www", "example", "x-y", "A"], ["org", "com", "net", "co.uk"]
    rules = list(URL_RULES) + [(rng.choice(["allow", "block"]), ".".join(rng.choices(labels[:5], k=rng.randint(0, 2)) + [rng.choice(tlds)]) + rng.choice(["/", "/es/", "/en/1", "/e", ""])) for _ in range(60)]
    urls = [f"http{rng.choice(['', 's'])}://{'.'.join(rng.choices(labels, k=rng.randint(0, 3)) + [rng.choice(tlds)])}{rng.choice(['', '/', '/es/1', '/en/12?x=1', '/e#f', '?q=/es/', '/fr/'])}" for _ in range(800)]
    urls += [None, "", "nothing", "ftp://", "http://ORG", "http://org/", "x://y://z/", "http://user@example.org:80/es/", "http://" + "a" * 5000 + ".org/es/", "http://é.org/é"] + ["http://www.example.org/es/1"] * 300
    pages = spark.createDataFrame([(i if i % 50 else 7, u, "h") for i, u in enumerate(urls)], "page_id long, url string, html string")
    got = filter_urls(pages, rule_table(spark, rules)).collect()
    key = lambda t: tuple(map(str, t))
    ids = dict(enumerate(urls))
    want = sorted(((i if i % 50 else 7, *plain(u, rules)) for i, u in ids.items()), key=key)
    assert sorted(map(tuple, got), key=key) == want


def test_no_rules_and_no_pages(spark):
    pages = spark.createDataFrame([(None, "http://a.org/")], "page_id long, url string")
    none = rule_table(spark, URL_RULES).limit(0)
    assert [tuple(r) for r in filter_urls(pages, none, "block").collect()] == [(None, "a.org", "/", None, "block")]
    assert filter_urls(pages.limit(0), rule_table(spark, URL_RULES)).collect() == []


def test_null_ids_and_clashing_columns(spark):
    rows = [(None, f"http://hot.example.org/es/{i % 7}") for i in range(600)] + [(3, "http://hot.example.org/x")] * 5 + [(None, None)] * 4
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumns({c: F.lit("clash") for c in ("key", "part", "salt", "host", "path", "rule", "verdict", "is_url")})
    got = sorted(map(str, map(tuple, filter_urls(pages, rule_table(spark, URL_RULES)).collect())))
    assert got == sorted(str((i, *plain(u, URL_RULES))) for i, u in rows)
