"""Targets against the repeated sharing of the excess, and what the mix takes."""

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidewatch.llm import mixing as M


def shared_out(sizes, weights, most):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, target, free = sum(sizes.values()), {}, set(names)
    while free:
        left = total - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > most * sizes[s]}
        if not over:
            return target | share
        target |= {s: most * sizes[s] for s in over}
        free -= over
    return target


def rows_of(sizes):
    return [(f"{s}-{k}", s, n) for s, list_ in sizes.items() for k, n in enumerate(list_)]


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 10, "c": 1000, None: 50}, {"x": 5}, {"a": 100, "é": 100, "Z": 100, "b": 100}, {"a": 0, "b": 7}])
def test_targets(spark, sizes):
    df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    expected = shared_out(sizes, M.WEIGHTS, M.MOST)
    for r in M.source_targets(df).collect():
        assert r.target == pytest.approx(expected[r.source]) and r.source_size == sizes[r.source]


def test_sources_come_near_their_targets_and_reruns_agree(spark):
    import random

    rng = random.Random(8)
    sizes = {f"s{k}": [rng.choice([0, 3, 50, 60, 400, 5000]) for _ in range(600)] for k in range(4)} | {None: [20] * 3000}
    df = spark.createDataFrame(rows_of(sizes), "doc_id string, source string, size long").withColumn("target", F.lit("x"))
    out = M.mix(df, fold=8).collect()
    taken, target = defaultdict(int), {}
    for r in out:
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 3
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert sorted(r.doc_id for r in out) == sorted(i for i, _, _ in rows_of(sizes))
    for s, t in target.items():
        assert taken[s] == pytest.approx(t, rel=0.02)
    again = M.mix(df.repartition(5), fold=8).collect()
    assert {(r.doc_id, r.copies) for r in again} == {(r.doc_id, r.copies) for r in out}


def test_each_document_has_its_expected_copies(spark):
    df = spark.createDataFrame([(k, "a" if k % 2 else "b", 10) for k in range(40)], "doc_id long, source string, size long")
    total = defaultdict(int)
    for seed in range(4):
        for r in M.mix(df, seed=seed * 1000).collect():
            total[r.doc_id] += r.copies
    mean = {s: sum(v for k, v in total.items() if k % 2 == s) / 80 for s in (0, 1)}
    assert mean[1] == pytest.approx(10 / 7, abs=0.03) and mean[0] == pytest.approx(4 / 7, abs=0.03)


def test_odd_rows(spark):
    rows = [(None, None, None), (None, None, 5), (1, "a", 0), (1, "a", 0), (2, "", 7)]
    out = M.mix(spark.createDataFrame(rows, "doc_id long, source string, size long")).collect()
    assert len(out) == 5 and sum(r.size for r in out) == 12
    assert M.mix(spark.createDataFrame([], "doc_id long, source string, size long")).count() == 0


def test_word_count(spark):
    texts = [None, "", " \t\n", "a", " a  b\x0bc\r\n", "é　x y", "a " * 100_000]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert [r[0] for r in df.select(M.word_count(F.col("text"))).collect()] == [0, 0, 0, 1, 3, 2, 100_000]


def test_documents_are_repeated(spark):
    rows = [(k, f"word {k}", "a" if k < 30 else "b", 3, "x") for k in range(60)] + [(None, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, copies int, s string")
    out = M.repeat_documents(df)
    assert out.columns == df.columns
    counts = defaultdict(int)
    for r in out.collect():
        counts[r.source] += 1
    assert 41 <= counts["a"] <= 45 and 15 <= counts["b"] <= 19
