"""Cases the verdict of the first round named."""

import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from tidewatch.operators.metrics import calibrate, horizon_metrics
from tidewatch.operators.runs import lead_times
from tidewatch.operators.scaling import Scaler
from tidewatch.operators.series import histories_at, latest_context, sequences
from tidewatch.plans.prepare import model_input, row_groups
from tidewatch.plans.train import train
from tidewatch.schema import FEATURES, ForecastOptions
from tidewatch.sources.flows import read_flows, with_file_row

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_quoted_cells_hold_quotes_and_line_breaks(spark, tmp_path):
    file = tmp_path / "flows.csv"
    file.write_text('timestamp,bytes,note\n1,10,"a ""quoted"", cell"\n2,20,"two\nlines"\n3,30,plain\n')
    rows = read_flows(spark, str(file)).orderBy("timestamp").collect()
    assert [r["note"] for r in rows] == ['a "quoted", cell', "two\nlines", "plain"]
    assert [r["bytes"] for r in rows] == ["10", "20", "30"]


def test_row_groups_of_several_files_keep_their_order(spark, tmp_path):
    for name, first in (("a", 0), ("b", 200)):
        rows = "".join(f"{first + k},1\n" for k in range(6))
        (tmp_path / f"{name}.csv").write_text("bytes,packets\n" + rows)
    windows = row_groups(with_file_row(read_flows(spark, str(tmp_path), position=True), "_row"), 2)
    ordered = model_input(windows).orderBy("idx").collect()
    assert [r["features"][0] for r in ordered] == [1, 5, 9, 401, 405, 409]


@pytest.mark.parametrize("row", [(1, 2, 0.5), (1, 1, float("nan")), (1, 0, None), (1, 1, 1.5)])
def test_metrics_refuse_bad_labels_and_scores(spark, row):
    df = spark.createDataFrame([(1, 0, 0.1), (1, 1, 0.9), row], "horizon int, y int, score double")
    with pytest.raises(Exception, match="labels must be"):
        horizon_metrics(df).collect()
    with pytest.raises(Exception, match="labels must be"):
        lead_times(df.withColumn("idx", F.monotonically_increasing_id())).collect()
    if row[2] != 1.5:
        with pytest.raises(Exception, match="labels must be"):
            calibrate(df).collect()


def test_latest_context_beyond_a_thousand_rows(spark):
    rows = spark.range(4000).select((F.col("id") % 2).alias("k"), F.floor(F.col("id") / 2).alias("idx"))
    got = latest_context(rows, 1500, ["k"]).groupBy("k").agg(F.count("*"), F.min("idx")).orderBy("k").collect()
    assert [tuple(r) for r in got] == [(0, 1500, 500), (1, 1500, 500)]
    assert latest_context(rows.where("k = 0"), 1500).count() == 1500


def test_histories_of_picked_origins_alone(spark):
    rows = [(k, i, [float(i)]) for k in (1, None) for i in range(9)]
    df = spark.createDataFrame(rows, "k int, idx long, features array<double>")
    origins = spark.createDataFrame([(1, 3), (1, 8), (None, 2), (1, 1)], "k int, origin_idx long")
    every = {(r.k, r.origin_idx): r.history for r in sequences(df, 3, ["k"]).collect()}
    got = {(r.k, r.origin_idx): r.history for r in histories_at(df, origins, 3, ["k"]).collect()}
    assert got == {at: every[at] for at in ((1, 3), (1, 8), (None, 2))}


def test_missing_labels_train_nothing(spark):
    def windows(stage_of_gaps):
        rows = [(i, *[float((i * 7 + j) % 5) for j in range(len(FEATURES))], stage_of_gaps if i % 4 == 3 else i % 3) for i in range(40)]
        return spark.createDataFrame(rows, "win_idx long, " + ", ".join(f"{f} double" for f in FEATURES) + ", stage int")

    same = Scaler((0.0,) * len(FEATURES), (1.0,) * len(FEATURES))
    options = ForecastOptions(sequence_length=3, horizon=1)
    models = [train(windows(gap), options, scaler=same, max_iter=5) for gap in (-1, None)]
    assert models[0] == models[1]
    binary = train(windows(None), options, semantics="binary_attack", scaler=same, max_iter=5)
    assert set(binary.stage[0].intercept) == {0.0} and binary.risk[0].coef


def test_workers_get_the_package_from_a_foreign_folder(tmp_path):
    code = f"""
import sys
sys.path.insert(0, {ROOT!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config(
    "spark.sql.session.timeZone", "UTC").getOrCreate()
import __spark_entry__
print("rows", __spark_entry__.queries()["C3_regrid"](spark, "/root/testdata/sf0.001").count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "rows " in done.stdout, done.stderr[-2000:]
