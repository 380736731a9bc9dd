import random

from pyspark.sql import functions as F

from spanlens.llm.url_filter import Rule, bloom_blocks, judge, may_be_listed, n_blocks, rules_frame

RULES = [Rule("net", "/", "block"), Rule("example.net", "/en/", "allow"), Rule("example.com", "/de/", "block"), Rule("org", "/fr/", "allow")]


def slow(url, rules, default="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([i for i in (rest.find(c) for c in "/?#") if i >= 0], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        path = path[: min([i for i in (path.find(c) for c in "?#") if i >= 0], default=len(path))]
    fits = [r for r in rules if host and (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: (len(r.host + r.path), len(r.host), r.host + r.path, r.action), default=None)
    return host, path, best and best.host + best.path, best.action if best else default


URLS = [
    None, "", "no scheme", "://", "http://", "HTTP://A.Example.NET/en/x?y#z", "http://example.net/en/", "http://example.net/en",
    "http://net", "http://net/", "http://net?/", "http://x.net#/", "http://notnet/", "http://myexample.net/en/", "ftp://deep.er.org/fr/a://b/",
    "http://ÄÖ.org/fr/", "http://example.com/de/\n?x", "a\nb://x.example.com/de/y", "http://.net/", "http://net./", "http://" + "a." * 4000 + "net/" + "p" * 9000,
]


def test_equals_brute_force(spark):
    rng = random.Random(4)
    hosts = ["net", "example.net", "www.example.net", "example.com", "b.example.com", "x.org", "org", "ORG", "example.org"]
    urls = URLS + [f"http://{rng.choice(hosts)}{rng.choice(['', '/', '/en/', '/en/a', '/de/', '/fr/', '/fr'])}{rng.choice(['', '?q', '#f'])}" for _ in range(200)]
    rows = [(i if i % 7 else None, u, "c", "d") for i, u in enumerate(urls)] + [(5, urls[5], "c", "d")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, rule string")
    got = sorted((tuple(r) for r in judge(pages, rules_frame(spark, RULES)).collect()), key=str)
    assert got == sorted(((p, *slow(u, RULES)) for p, u, _, _ in rows), key=str)


def test_many_rules_and_conflicts(spark):
    rng = random.Random(9)
    rules = [Rule(f"h{rng.randrange(300)}.{rng.choice(['net', 'org'])}", rng.choice(["/", "/a", "/a/b"]), rng.choice(["allow", "block"])) for _ in range(2000)]
    urls = [f"https://s{i % 3}.h{rng.randrange(400)}.{rng.choice(['net', 'org'])}{rng.choice(['/', '/a', '/a/b/c', ''])}" for i in range(500)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = sorted(tuple(r) for r in judge(pages, rules_frame(spark, rules)).collect())
    assert got == sorted((i, *slow(u, rules)) for i, u in enumerate(urls))


def test_a_hundred_thousand_rules_of_two_thousand_shapes(spark):
    rng = random.Random(2)
    shape = lambda k: (".".join(["a"] * (k % 20)), "/" + "p" * (k // 20))
    rules = []
    for k in range(100_000):
        host, path = shape(k % 2000)
        rules.append((f"{host}.h{k}.net".lstrip("."), path, "block" if k % 3 else "allow"))
    urls = []
    for _ in range(300):
        host, path, _ = rng.choice(rules)
        urls.append(f"http://{rng.choice(['', 'www.', 'x.y.'])}{host}{path}{rng.choice(['', '/q', 'p'])}")
    frame = spark.createDataFrame(rules, "host string, path string, action string")
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    found = judge(pages, frame)
    assert len(found._jdf.queryExecution().optimizedPlan().toString()) < 60_000
    by_host = {}
    for r in rules:
        by_host.setdefault(r[0], []).append(Rule(*r))
    for r in found.collect():
        labels = r.host.split(".")
        near = [rule for k in range(len(labels)) for rule in by_host.get(".".join(labels[k:]), [])]
        assert tuple(r)[1:] == slow(urls[r.page_id], near)


def test_only_survivors_of_the_filter_pass(spark):
    rules = rules_frame(spark, RULES).withColumnRenamed("host", "rule_host")
    keys = spark.range(20_000).select(F.concat(F.lit("h"), "id", F.lit(".com")).alias("rule_host")).union(rules.select("rule_host"))
    filled = bloom_blocks(rules, ["rule_host"], n_blocks(len(RULES)))
    passed = [r.rule_host for r in may_be_listed(keys, ["rule_host"], filled, n_blocks(len(RULES))).collect()]
    assert {r.host for r in RULES} <= set(passed) and len(passed) < 40


def test_odd_rules(spark):
    rules = spark.createDataFrame([("", "/", "block"), (None, "/", "block"), ("a.net", None, "block"), ("B.net", "", "block"), ("c.net", "/", None)], "host string, path string, action string")
    pages = spark.createDataFrame([(i, f"http://{h}.net/x") for i, h in enumerate("abc")], "page_id long, url string")
    assert sorted((r.page_id, r.rule, r.verdict) for r in judge(pages, rules).collect()) == [(0, None, "allow"), (1, "b.net", "block"), (2, None, "allow")]


def test_no_rules_and_no_rows(spark):
    pages = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string")
    assert [tuple(r) for r in judge(pages, rules_frame(spark, [])).collect()] == [(1, "a.net", "/", None, "allow")]
    assert judge(pages.limit(0), rules_frame(spark, RULES)).collect() == []


def test_runs_no_python(spark):
    pages = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string")
    plan = judge(pages, rules_frame(spark, RULES))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
