"""Dated lists against a scan of all entries for each capture."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidewatch.llm import urls as U

DAY0 = datetime(2024, 1, 1)


def names(url):
    """(host, path segments) in plain Python."""
    if url is None or "://" not in url:
        return None, []
    rest = url.split("://", 1)[1]
    for mark in "?#":
        rest = rest.split(mark)[0]
    host, _, path = rest.partition("/")
    host = host.rsplit("@")[-1].split(":")[0].lower().rstrip(".")
    return host or None, [p for p in path.split("/") if p]


def brute(url, at, entries):
    host, path = names(url)
    best = ("none", None, None)
    rank = -1
    for pattern in {e[0] for e in entries if e[0] and e[1]}:
        name, _, deep = pattern.partition("/")
        name, want = name.lower(), [p for p in deep.split("/") if p]
        if host is None or at is None:
            continue
        if want:
            if host != name or path[:len(want)] != want:
                continue
            mine = 100 + len(want)
        elif host == name or host.endswith("." + name):
            mine = len(name.split("."))
        else:
            continue
        dated = [e for e in entries if e[0] and e[1] and e[0].partition("/")[0].lower() + e[0].partition("/")[1] + deep == name + e[0].partition("/")[1] + deep
                 and e[0].partition("/")[2] == deep and e[1] <= at]
        if not dated:
            continue
        last = max(e[1] for e in dated)
        verdicts = [e[2] for e in dated if e[1] == last and e[2] is not None]
        if verdicts and mine > rank:
            rank, best = mine, (max(verdicts), name + ("/" + deep if want else ""), last)
    return best


def test_as_of_join(spark):
    rng = random.Random(9)
    hosts = ["a.example.com", "b.a.example.com", "example.com", "other.org", "hot.net"]
    entries = [(rng.choice(["example.com", "A.example.com", "other.org", "hot.net", "com", "hot.net/x", "hot.net/x/Y", "a.example.com/q"]),
                DAY0 + timedelta(days=rng.randrange(0, 700)), rng.choice(["block", "allow", None])) for _ in range(120)]
    entries += [(None, DAY0, "block"), ("x.org", None, "block"), entries[0], (entries[1][0], entries[1][1], "block")]
    captures = [(k, f"http://{rng.choice(hosts)}{rng.choice(['', '/', '/x', '/x/Y/z?q#f', '/q', ':80/x', '/X'])}", DAY0 + timedelta(days=rng.randrange(-20, 800), hours=5))
                for k in range(400)]
    captures += [(1, None, DAY0), (None, "no url", DAY0), (3, "http://hot.net/x", None), (4, "HTTP://user@HOT.net.:8080/x", entries[0][1]), (4, "http:///x", DAY0)]
    made = U.list_verdicts(spark.createDataFrame([(*c, "z") for c in captures], "page_id long, url string, fetched_at timestamp_ntz, verdict string"),
                           spark.createDataFrame(entries, "pattern string, listed_at timestamp_ntz, verdict string"))
    got = sorted(((r.page_id, r.url, r.fetched_at, r.verdict, r.pattern, r.since) for r in made.collect()), key=str)
    assert got == sorted(((i, u, t, *brute(u, t, entries)) for i, u, t in captures), key=str)


def test_no_python(spark):
    df = spark.createDataFrame([(1, "http://a/", DAY0)], "page_id long, url string, fetched_at timestamp_ntz")
    plan = U.list_verdicts(df, spark.createDataFrame([], "pattern string, listed_at timestamp_ntz, verdict string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_empty_tables(spark):
    none = spark.createDataFrame([], "page_id long, url string, fetched_at timestamp_ntz")
    entries = spark.createDataFrame([("a", DAY0, "block")], "pattern string, listed_at timestamp_ntz, verdict string")
    assert U.list_verdicts(none, entries).count() == 0
    one = spark.createDataFrame([(1, "http://a/", DAY0)], none.schema)
    assert U.list_verdicts(one, entries.limit(0)).select("verdict").collect()[0][0] == "none"
    assert U.list_verdicts(one.select("page_id", "url", F.lit(None).cast("timestamp_ntz").alias("fetched_at")), entries).count() == 1


def test_very_long_url(spark):
    long = "http://" + ".".join(["l"] * 3000) + "/" + "/".join(["p"] * 3000)
    df = spark.createDataFrame([(1, long, DAY0)], "page_id long, url string, fetched_at timestamp_ntz")
    entries = spark.createDataFrame([(".".join(["l"] * 3000), DAY0, "block")], "pattern string, listed_at timestamp_ntz, verdict string")
    assert U.list_verdicts(df, entries).collect()[0].verdict == "block"


def test_entries_of_any_depth(spark):
    deep, wide, many = "/".join(f"p{k}" for k in range(12)), ".".join(f"l{k}" for k in range(12)), ".".join(["m"] * 120)
    entries = [(p, DAY0, "block") for p in (f"Hot.net/{deep}", wide.split(".", 2)[2], "a.org/x//y/", "b.org/", many, f"{many}/q", "hot.net/p0")]
    wanted = {f"http://hot.net/{deep}/more": f"hot.net/{deep}", f"http://hot.net/{deep[:-2]}": "hot.net/p0", f"http://{wide}/": wide.split(".", 2)[2],
              "http://a.org/x/y": "a.org/x/y", "http://a.org//x/y/z": "a.org/x/y", "http://www.b.org/z": "b.org", f"http://{many}/q": f"{many}/q",
              f"http://{many}/r": many, "http://a.org/x": None}
    captures = spark.createDataFrame([(k, u, DAY0) for k, u in enumerate(wanted)], "page_id long, url string, fetched_at timestamp_ntz")
    made = U.list_verdicts(captures, spark.createDataFrame(entries, "pattern string, listed_at timestamp_ntz, verdict string"))
    assert {r.url: r.pattern for r in made.collect()} == wanted
