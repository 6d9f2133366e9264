import datetime
import random

from pyspark.sql import functions as F

from sensorframe.llm import url_lists as u

DAY = datetime.datetime(2024, 1, 1)


def test_patterns(spark):
    urls = ["https://user:pw@WWW.A.b.Example.com:8080/x//y/z.html?q=1#f", "http://b.com", "http://b.com./", "ftp://c.d/e?f/g", "no url", "", None, "http://", "mailto:x@y.z"]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(urls)], "k int, url string")
    found = {x.k: x.p for x in df.select("k", u.patterns_of(F.col("url")).alias("p")).collect()}
    assert set(found[0]) == {"a.b.example.com", "b.example.com", "example.com", "com", "a.b.example.com/x", "a.b.example.com/x/y", "a.b.example.com/x/y/z.html"}
    assert found[1] == found[2] == ["b.com", "com"] and set(found[3]) == {"c.d", "d", "c.d/e"}
    assert all(found[k] == [] for k in (4, 5, 6, 7, 8))


def brute(captures, changes):
    log = {}
    for name, pattern, time, added in changes:
        if None not in (name, pattern, time, added):
            log.setdefault((name, pattern), []).append((time, not added))
    out = []
    for i, patterns, day in captures:
        active = set()
        for (name, pattern), turns in log.items():
            past = [x for x in turns if day is not None and (x[0] - DAY).days <= day]
            # the last change of a day counts, a removal where times are equal
            if past and not max(past)[1] and pattern in patterns:
                active.add((name, pattern))
        out.append((i, tuple(sorted(active))))
    return sorted(out)


def test_as_of(spark):
    rng = random.Random(4)
    hosts = ["a.x.com", "b.x.com", "x.com", "y.org", "hot.net"]
    changes = [(rng.choice(["l1", "l2"]), rng.choice([*hosts, "y.org/p", "com"]), DAY + datetime.timedelta(days=rng.randrange(300), hours=rng.randrange(3)), rng.random() < 0.6)
               for _ in range(400)]
    changes += changes[:30] + [(None, "x.com", DAY, True), ("l1", None, DAY, True), ("l1", "x.com", None, True), ("l1", "x.com", DAY, None)]
    captures = [(i, f"http://{'hot.net' if i % 3 else rng.choice(hosts)}/{rng.choice(['', 'p', 'p/q'])}", DAY + datetime.timedelta(days=rng.randrange(-5, 400), hours=5)) for i in range(500)]
    captures += [(500, None, DAY), (501, "http://x.com", None), (502, "junk", DAY), (0, "http://x.com", DAY + datetime.timedelta(days=90))]
    docs = spark.createDataFrame(captures, "page_id long, url string, fetched timestamp").withColumn("pattern", F.lit("clash")).withColumn("day", F.lit(3)).withColumn("entries", F.lit(None))
    log = spark.createDataFrame(changes, "list string, pattern string, time timestamp, added boolean")
    found = u.evaluate(docs, log).collect()
    patterns = {x.url: x.p for x in docs.select("url", u.patterns_of(F.col("url")).alias("p")).collect()}
    wanted = brute([(i, patterns[x], None if t is None else (t - DAY).days) for i, x, t in captures], changes)
    assert sorted((x.page_id, tuple((e["list"], e["pattern"]) for e in x.entries)) for x in found) == wanted
    assert sum(bool(e) for _, e in wanted) > 100
    assert u.evaluate(docs.limit(0), log).count() == 0
    assert u.evaluate(docs, log.limit(0)).filter(F.size("entries") > 0).count() == 0


def test_intervals_merge(spark):
    day = lambda n: DAY + datetime.timedelta(days=n)
    log = spark.createDataFrame([("l", "p", day(n), a) for n, a in [(1, True), (3, True), (9, False), (10, False), (20, True)]], "list string, pattern string, time timestamp, added boolean")
    base = (DAY - datetime.datetime(1970, 1, 1)).days
    assert sorted((x.valid_from - base, x.valid_until - base if x.valid_until < u.EVER else None) for x in u.intervals(log).collect()) == [(1, 9), (20, None)]
