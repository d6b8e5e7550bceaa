import pytest

from strandloom.llm import queries, url_filter
from tests.harness import compare, connect

DIR = "/root/testdata/sf0.001"
RULE = "host string, path string, verdict string"


def verdict(url, rules):
    """The contract's rule, by trying every rule."""
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if c.isascii() else c for c in rest[:cut])
        rest = rest[cut:]
        path = rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[2], best[3] if best else "allow"


def test_query_equals_sql(spark):
    name = "op1_url_filters"
    assert compare(spark, connect(DIR), queries.queries()[name], queries.oracle_sql()[name], DIR) == 50


@pytest.mark.parametrize("limit", [32 << 20, 0])
def test_rules_and_odd_urls(spark, limit):
    rules = [*queries.RULES, ("b.example.net", "/en/x", "block"), ("t", "", "block"), ("Dup.org", "/", "allow"), ("dup.org", "/", "block"), *((f"h{i}.com", f"/{'p' * (i % 7)}", "block") for i in range(300))]
    urls = ["http://a.NET/x", "http://a.net", "https://b.example.net/en/xyz?q", "https://c.b.example.net/en/y", "x://notnet/", "//no.scheme.net/", None, "", "http://", "ftp://u@h7.com:80/", "http://H7.com/", "http://w.h8.com/p#f", "http://a.t", "http://dup.org/", "http://x.org/fr/q", "http://a://b.net/", "http://é.net/ü", "http://net/", "http://.net/", "http://a..net/"] * 2
    pages = spark.createDataFrame([(i, u, "r") for i, u in enumerate(urls)], "page_id bigint, url string, rule string")
    got = {r.page_id: tuple(r)[1:] for r in url_filter.filter_urls(pages, spark.createDataFrame(rules, RULE), broadcast_bytes=limit).collect()}
    known = {}
    for h, p, v in rules:
        known[h.lower(), p] = max(v, known.get((h.lower(), p), ""))
    assert got == {i: verdict(u, [(h, p, v) for (h, p), v in known.items()]) for i, u in enumerate(urls)}


def test_empty_tables(spark):
    pages = spark.createDataFrame([(1, "http://a.net/")], "page_id bigint, url string")
    none = spark.createDataFrame([], RULE)
    assert [tuple(r) for r in url_filter.filter_urls(pages, none).collect()] == [(1, "a.net", "/", None, "allow")]
    assert url_filter.filter_urls(pages.limit(0), spark.createDataFrame(queries.RULES, RULE)).count() == 0


def test_main_path_is_native(spark):
    plan = queries.op1_url_filters(spark, DIR)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
