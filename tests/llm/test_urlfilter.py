import random

from lodestone.llm import urlfilter


def brute(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if c in urlfilter.UPPER else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fit = [r for r in rules if None not in r and (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
    fit.sort(key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r[1], r[2], r[0] == "allow"))
    return host, path, fit[0][1] + fit[0][2] if fit else None, fit[0][0] if fit else default


def test_verdicts_by_brute_force(spark):
    rng = random.Random(9)
    urls = [None, "", "http://", "no scheme", "http://ORG", "http://org/", "HTTP://A.Example.ORG/en/1?x=/es/", "x://a.com#/de/", "https://com/fr/", "http://example.org.:80/es/", "http://xexample.org/es/", "http://a..org/", "a://b://org/c", "http://É.Org/", "http://org\x01x/", "http://x\x00org/", "http://org?://com/de/"]
    urls += [f"http://{'.'.join(rng.choice(['a', 'com', 'org', 'example', 'b', '']) for _ in range(rng.randint(1, 4)))}/{rng.choice(['', 'de/', 'fr/', 'es/', 'en/1', 'x'])}{rng.choice(['', '?q', '#f', 'y/'])}" for _ in range(600)]
    pages = spark.createDataFrame([(i if i % 50 else None, u, "h") for i, u in enumerate(urls)] + [(1, urls[1], "h")], "page_id long, url string, host string")
    more = [*urlfilter.RULES, ("block", "a.example.org", "/"), ("allow", "a.example.org", "/"), ("allow", "b.com", ""), ("block", "", "/x"), (None, "com", "/"), ("block", "a..org", "/")]
    for rules in (list(urlfilter.RULES), more):
        got = sorted(map(str, urlfilter.judge(pages, spark.createDataFrame(rules, "verdict string, host string, path string"), parts=3).collect()))
        kinds = urlfilter.judge(pages.limit(0), spark.createDataFrame(rules, "verdict string, host string, path string"))
        assert kinds.count() == 0
        from pyspark.sql import Row

        want = sorted(str(Row(page_id=p.page_id, host=h, path=a, rule=r, verdict=v)) for p in pages.collect() for h, a, r, v in [brute(p.url, rules)])
        assert got == want
    none = urlfilter.judge(pages, spark.createDataFrame([], "verdict string, host string, path string"))
    assert {r.verdict for r in none.collect()} == {"allow"}
