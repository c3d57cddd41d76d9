"""URL filters against a plain loop over all rules."""

import random

import pytest

from kwhrecon.llm import urls

SCHEMA = "page_id long, url string, host int, path int, rule string, token string, weight long, _row long, pattern string"


def lowered(s):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in s)


def brute(rows, rules, default="allow"):
    known = {}
    for h, p, v in rules:
        if h is not None and p is not None and v in ("allow", "block"):
            key = (lowered(h), p)
            known[key] = max(v, known.get(key, ""))
    out = []
    for i, url in rows:
        host = path = ""
        if url is not None and "://" in url:
            whole = url.split("://", 1)[1].split("#")[0].split("?")[0]
            host, slash, rest = whole.partition("/")
            host, path = lowered(host), slash + rest
        fits = [(len(h) + len(p), len(h), v, h + p) for (h, p), v in known.items()
                if (h == "" or host == h or host.endswith("." + h)) and path.startswith(p) and (p == "" or p[0] == "/")]
        best = max(fits, default=None)
        out.append((i, host, path, best and best[3], best[2] if best else default))
    return sorted(out, key=repr)


def judged(spark, rows, rules, default="allow"):
    table = spark.createDataFrame([(i, u, 1, 2, "r", "t", 3, 4, "p") for i, u in rows], SCHEMA)
    return sorted(map(tuple, urls.judge(table, urls.rule_table(spark, rules), default).collect()), key=repr)


ROWS = [(0, None), (1, ""), (2, "example.com/en/"), (3, "http://"), (4, "HTTP://WWW.Example.COM/en/X"), (5, "https://example.com"),
        (6, "https://example.com?x=/en/"), (7, "https://a.example.com/en"), (8, "https://notexample.com/en/1"), (9, "x://b.net/es/a/../fr/"),
        (10, "x://net/fr/"), (11, "x://user@example.com:80/en/"), (12, "x://example.com#/en/"), (13, "x://a.com/b?c://d.net/es/"),
        (14, "x://www.example.com/EN/"), (15, "x://ä.com/é/\n/z"), (16, "x://" + "a." * 2000 + "com/" + "s/" * 20000), (17, "x://a..com//en/"),
        (18, "x://exampleXcom/en/"), (19, "x:///en/"), (10, "x://net/fr/"), (None, "x://net/fr/"), (None, None)]


def test_the_rules_of_the_query(spark):
    assert judged(spark, ROWS, urls.RULES) == brute(ROWS, urls.RULES)
    got = {r[0]: r[3:] for r in judged(spark, ROWS[:15], urls.RULES)}
    assert got[4] == ("www.example.com/en/", "allow") and got[9] == ("net/es/", "block") and got[5] == (None, "allow")


@pytest.mark.parametrize("threshold", ["10m", "-1"])
def test_many_rules(spark, threshold):
    rng = random.Random(4)
    label = lambda: rng.choice(["a", "b", "c", "x.y", "com", "net", "é", "(", "$", "*", "[a"])
    segment = lambda: rng.choice(["", "en", "fr", "a+b", ".*", "en2", "é", "|"])
    rules = [(".".join(label() for _ in range(rng.randrange(4))), "".join("/" + segment() for _ in range(rng.randrange(4))),
              rng.choice(["allow", "block"])) for _ in range(400)]
    rules += [(None, "/", "allow"), ("a", None, "block"), ("a", "/", "maybe"), ("A.B", "en", "block"), ("", "", "block"), ("", "/en/", "allow")]
    rows = [(i, "s://" + ".".join(label() for _ in range(rng.randrange(5))) + "".join("/" + segment() for _ in range(rng.randrange(5)))
             + rng.choice(["", "?q=/en/", "#x"])) for i in range(600)] + [(1000 + i, "s://a.com/en/1") for i in range(300)]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        assert judged(spark, rows, rules, "block") == brute(rows, rules, "block")
        assert judged(spark, rows, rules[:3]) == brute(rows, rules[:3])
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_rules_lie_under_their_rarest_token(spark):
    rows = [(i, f"s://w.com/{p}/1") for i, p in enumerate(["en"] * 9 + ["fr"])]
    parts = spark.createDataFrame(rows, "page_id long, url string").select(*[c.alias(n) for c, n in zip(urls.host_and_path("url"), ("host", "path"))])
    rules = urls.rule_table(spark, [("com", "/en/", "block"), ("com", "/fr/", "block"), ("com", "/", "allow"), ("org", "/", "block"), ("", "/e", "block")])
    tokens = sorted(r["token"] for r in urls.indexed(rules, parts).collect())
    assert tokens == sorted([f"*{k}" for k in range(urls.SALTS)] + ["h:com", "h:org", "p:en", "p:fr"])


def test_empty_tables(spark):
    assert judged(spark, [], urls.RULES) == []
    assert judged(spark, ROWS, []) == brute(ROWS, [])
