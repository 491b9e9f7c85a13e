"""Traffic files arriving in a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def stream_flows(spark: SparkSession, folder: str, schema: StructType | str, kind: str = "parquet",
                 files_per_trigger: int | None = None, pattern: str | None = None) -> DataFrame:
    """Records of the files that appear in `folder` (those matching `pattern`), with a declared schema."""
    reader = spark.readStream.schema(schema)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if kind == "parquet":
        return reader.parquet(folder)
    if kind in ("csv", "tsv"):
        return reader.option("header", True).option("sep", "\t" if kind == "tsv" else ",").csv(folder)
    raise ValueError(f"unsupported stream format: {kind}")
