"""The pipeline's stages as Spark runs them."""

import numpy as np
import pyarrow as pa

import corpus_pipeline
from tidewatch import session


def _batches(spark):
    def work(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])

    rows = spark.range(0, 3000, 1, 1).selectExpr("repeat('x', 5000) AS text")
    return [r.n for r in rows.mapInArrow(work, "n long").collect()]


def test_stages_pass_long_texts_in_small_batches(spark):
    before = spark.conf.get(session._BATCH, None)
    spark.conf.unset(session._BATCH)
    try:
        assert _batches(spark) == [3000]
        docs = spark.createDataFrame([(1, "a b c", "en", "s")], "doc_id long, text string, lang string, source string")
        corpus_pipeline.keep_known_languages(spark, docs, "")
        found = _batches(spark)
        assert sum(found) == 3000 and np.max(found) * 5000 < 6 << 20
        spark.conf.set(session._BATCH, "64m")
        session.small_batches(spark)
        assert spark.conf.get(session._BATCH) == "64m"
    finally:
        spark.conf.unset(session._BATCH)
        if before is not None:
            spark.conf.set(session._BATCH, before)
