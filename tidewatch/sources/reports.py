"""JSON reports and file digests."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK_BYTES = 4 << 20


def _checked(value: Column, dtype: T.DataType, path: str) -> Column:
    """The value with struct fields in name order; NaN or an infinity anywhere is an error."""
    if isinstance(dtype, T.StructType):
        fields = [_checked(value[f.name], f.dataType, f"{path}.{f.name}").alias(f.name)
                  for f in sorted(dtype.fields, key=lambda f: f.name)]
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(dtype, T.ArrayType):
        return F.transform(value, lambda item: _checked(item, dtype.elementType, f"{path}[]"))
    if isinstance(dtype, T.MapType):
        entries = F.array_sort(F.map_entries(value))
        return F.map_from_entries(F.transform(entries, lambda e: F.struct(
            e["key"], _checked(e["value"], dtype.valueType, f"{path}{{}}"))))
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        bad = F.isnan(value) | (F.abs(value) == float("inf"))
        return F.when(bad, F.raise_error(F.lit(f"{path} is not a finite number")).cast(dtype)).otherwise(value)
    return value


def report_json(df: DataFrame, column: str = "report") -> DataFrame:
    """Each row as one JSON text with sorted keys and explicit nulls."""
    fields = [_checked(F.col(f.name), f.dataType, f.name).alias(f.name)
              for f in sorted(df.schema.fields, key=lambda f: f.name)]
    return df.select(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias(column))


def write_report(df: DataFrame, path: str) -> None:
    report_json(df, "value").write.mode("overwrite").text(path)


def file_digests(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(path, bytes, sha256) of files or of everything below folders.

    Spark lists the files and deals them out; its listing leaves out empty files and names that begin with `.` or `_`. A task reads the files of a mounted file system (`file:`) in blocks of 4 MiB
    through one digest each, whatever their sizes, as SHA-256 is sequential; a file that changes or goes meanwhile is an error.
    Files of other file systems come through Spark's binaryFile source, one record each, which ends at 2 GB per file.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    files = {True: [], False: []}
    for path in paths:
        files[_mounted(spark, path)].append(path)
    tables = []
    if files[True]:
        tables.append(_files(spark, files[True]).select("path", F.col("length").alias("bytes")).repartition("path").mapInArrow(
            _streamed, "path string, bytes long, sha256 string"))
    if files[False]:
        tables.append(_files(spark, files[False]).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256")))
    return reduce(DataFrame.unionByName, tables)


def _files(spark: SparkSession, paths: list[str]) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths)


def _mounted(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).getUri().getScheme() == "file"


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, length in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            digest, seen = hashlib.sha256(), 0
            with open("/" + path.removeprefix("file:").lstrip("/"), "rb") as file:  # the path is not quoted
                while block := file.read(BLOCK_BYTES):
                    digest.update(block)
                    seen += len(block)
            if seen != length:
                raise ValueError(f"{path} had {length} bytes when it was listed and {seen} when it was read")
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([length]), pa.array([digest.hexdigest()])], names=["path", "bytes", "sha256"])
