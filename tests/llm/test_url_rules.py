import random

from vendorscope.llm.url_rules import RULES, judge_urls


def brute(url, rules):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(c.lower() if c.isascii() else c for c in rest[:cut])
        tail = rest[cut:]
        end = min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])
        path = tail[:end]
    fit = [(len(h + p), h, p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None)
    return host, path, best and best[1] + best[2], best[3] if best else "allow"


def check(spark, urls, rules=RULES):
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judge_urls(pages.repartition(3), rules).collect()}
    assert got == {i: brute(u, rules) for i, u in enumerate(urls)}


def test_fixed_rules_and_odd_urls(spark):
    check(spark, [None, "", "no scheme", "http://", "http://net", "http://net/", "HTTP://A.NET/x?y#z", "x://example.net/en/",
                  "http://example.net/en", "http://www.EXAMPLE.net/en/a", "http://notexample.net/en/", "http://example.com/de/",
                  "http://a.example.com/de/x", "http://org/fr/", "http://x.org/fr/a", "http://x.org/FR/", "http://a?b/c",
                  "http://a#/de/", "http://example.com.", "http://.net/", "http://ÄÖ.net/", "http://a\nb.net/c\nd?e",
                  "http://u:p@example.net:80/en/", "http://a://b.net/"] * 2)


def test_nested_rules_random(spark):
    rng = random.Random(4)
    labels = ["a", "b", "net", "ab", "-"]
    hosts = [".".join(rng.choice(labels) for _ in range(rng.randint(1, 4))) for _ in range(40)]
    rules = [(rng.choice(["allow", "block"]), h, p) for h, p in
             {(h, rng.choice(["/", "/x", "/x/y", ""])) for h in hosts[:25]}]
    urls = [f"http://{rng.choice(hosts + ['q.' + h for h in hosts])}{rng.choice(['', '/', '/x', '/x/yz', '/z'])}"
            for _ in range(300)]
    check(spark, urls, rules)


def test_hot_host_repeated_rows_and_no_rules(spark):
    check(spark, ["http://hot.net/p"] * 300 + ["http://b.org/fr/"])
    check(spark, ["http://hot.net/p", None], [])


def test_empty_and_clashing_columns(spark):
    pages = spark.createDataFrame([(1, "http://a.net/", "h", "v")], "page_id long, url string, host string, verdict string")
    assert [tuple(r) for r in judge_urls(pages).collect()] == [(1, "a.net", "/", "net/", "block")]
    assert judge_urls(pages.filter("false")).count() == 0


def test_no_python_in_the_plan(spark):
    pages = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string")
    plan = judge_urls(pages)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
