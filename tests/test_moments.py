"""Moments of large numbers and of list cells, over every way windows are made."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators.canonical import canonical_events
from tidewatch.operators.regrid import regrid_features
from tidewatch.operators.windows import sliding_features, tumbling_features
from tidewatch.schema import BATCH, ONLINE

MOMENTS = {"iat": "iat", "ttl": "ttl", "window_size": "tcp_window", "payload_size": "payload"}


def made(spark, base, lists, n=400, seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for t in np.sort(rng.integers(0, 300, n)).tolist():
        def cell(name):  # a payload cell without numbers counts as 0 by its own rule
            x = [float(base + base * 1e-6 * rng.normal()) for _ in range(rng.integers(name == "payload_size", 4) if lists else 1)]
            return x if lists else x[0] if rng.random() > 0.05 or not base else None
        rows.append((float(t), int(rng.integers(0, 2)), *[cell(name) for name in MOMENTS]))
    kind = "array<double>" if lists else "double"
    return rows, spark.createDataFrame(rows, "timestamp double, k int, " + ", ".join(f"{c} {kind}" for c in MOMENTS))


def expected(rows, key, start, end, at, lists):
    cells = [r[2 + at] for r in rows if r[1] == key and start <= r[0] < end]
    x = np.array([v for c in cells for v in (c if lists else [0.0 if c is None else c])])
    return (x.mean(), x.var(), x.max()) if len(x) else (0, 0, 0)


@pytest.mark.parametrize("base", [1e9, 1e12])
@pytest.mark.parametrize("lists", [False, True])
@pytest.mark.parametrize("how", ["tumbling", "sliding", "regrid"])
def test_variances_of_large_numbers(spark, base, lists, how):
    rows, df = made(spark, base, lists)
    if not lists:
        rows, df = [r for r in rows if None not in r], df.dropna()
    e = canonical_events(df, keys=["k"], options=BATCH if lists else ONLINE)
    options = BATCH if lists else ONLINE
    windows = {"tumbling": lambda: tumbling_features(e, 20, ["k"], anchor=0, options=options),
               "sliding": lambda: sliding_features(e, 30, 4, ["k"], anchor=0, options=options),
               "regrid": lambda: regrid_features(e, 7, 10, ["k"], options=options)}[how]()
    found = windows.withColumns({"a": F.unix_micros("win_start") / 1e6, "b": F.unix_micros("win_end") / 1e6}).collect()
    assert len(found) > 20
    for row in found:
        assert row.event_count == sum(r[1] == row.k and row.a <= r[0] < row.b for r in rows)
        for at, name in enumerate(MOMENTS.values()):
            mean, var, most = expected(rows, row.k, row.a, row.b, at, lists)
            assert row[f"{name}_mean"] == pytest.approx(mean, rel=1e-12)
            assert row[f"{name}_variance"] == pytest.approx(var, rel=1e-7)
            if name == "iat":
                assert row.iat_max == most


def test_equal_large_numbers_have_no_variance(spark):
    df = spark.createDataFrame([(float(t), 1e15 / 3) for t in range(50)], "timestamp double, iat double")
    e = canonical_events(df)
    for table in (tumbling_features(e, 10), sliding_features(e, 10, 2), regrid_features(e, 10, 12)):
        assert {(r.iat_variance, r.iat_mean) for r in table.collect()} == {(0.0, 1e15 / 3)}


def test_empty_and_missing_lists(spark):
    df = spark.createDataFrame([(0.0, [], 5.0), (1.0, None, 6.0), (2.0, [3.0, None, 5.0], 7.0)], "timestamp double, iat array<double>, bytes double")
    for options in (BATCH, ONLINE):
        for windows in (tumbling_features(canonical_events(df, options=options), 10, options=options),
                        sliding_features(canonical_events(df, options=options), 10, 5, options=options)):
            row = windows.orderBy("win_start").first()
            assert row.event_count == 3 and row.flow_bytes == 18
            if options is BATCH:
                assert (row.iat_mean, row.iat_variance, row.iat_max) == (4, 1, 5)
