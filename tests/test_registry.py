"""A few registered queries next to their SQL; `python -m checks.compare` runs all of them."""

import pytest

from checks.compare import differences, open_tables
from checks.registry import oracle_sql, queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["flagship_abnormal_days", "A6_packets", "C1_tumbling", "C2_sliding", "C5_window_sample",
                                  "E6_lead_time", "G4_calibrate", "H2_rollout"])
def test_query_equals_its_sql(spark, name):
    got = queries()[name](spark, SF).toPandas()
    assert differences(got, open_tables(SF).execute(oracle_sql()[name]).df()) is None


def test_every_sql_belongs_to_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    import __spark_entry__

    found = __spark_entry__.entry(spark)
    assert found.count() > 0 and len(set(found.columns)) == len(found.columns)


def test_replay_measures_every_origin(spark):
    from checks.adapters import user_days
    from checks.q_models import OPTIONS

    sizes = [r["count"] for r in user_days(spark, SF).groupBy("user_id").count().collect()]
    every = [max(n - OPTIONS.sequence_length - OPTIONS.horizon + 1, 0) for n in sizes]
    row = queries()["G8_replay_report"](spark, SF).first()
    assert row["origins_evaluated"] == sum(every) > sum(min(n, 6) for n in every) and row["origin_selection"] == "all"
