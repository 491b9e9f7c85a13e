"""Reading traffic records: CSV, TSV, Parquet, single files and mixed folders."""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.functions.numbers import column_names, plain_name, quoted
from tidewatch.operators.scan import chunk_of, running
from tidewatch.schema import (
    CATEGORY_COLUMNS, COLUMN_ALIASES, LABEL_COLUMNS, PORT_COLUMNS, RISK_COLUMNS, STAGE_COLUMNS, TIME_COLUMNS,
    VALUE_ALIASES,
)
from tidewatch.session import join_small, staged
from tidewatch.sources.quoted import parsed_records, quoted_records, text_lines

# File extension -> format.
FORMATS = {".csv": "csv", ".tsv": "tsv", ".parquet": "parquet", ".pq": "parquet"}
SEPARATORS = {"csv": ",", "tsv": "\t"}

RECOGNIZED = frozenset(
    name
    for group in (*VALUE_ALIASES.values(), *COLUMN_ALIASES.values(), PORT_COLUMNS, TIME_COLUMNS, LABEL_COLUMNS,
                  CATEGORY_COLUMNS, STAGE_COLUMNS, RISK_COLUMNS, ("src_ip", "dst_ip", "src", "dst"))
    for name in group
)

POSITION = ("_file", "_split", "_row")


def file_format(path: str) -> str:
    extension = os.path.splitext(path.rstrip("/"))[1].lower()
    if extension not in FORMATS:
        raise ValueError(f"unsupported traffic file extension: {extension or '<none>'}")
    return FORMATS[extension]


def project_recognized(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Only the columns some feature, label, key or time can come from; the scan reads nothing else."""
    wanted = RECOGNIZED | {plain_name(k) for k in keep} | set(POSITION)
    return df.select(*[quoted(actual) for plain, actual in column_names(df).items() if plain in wanted])


def _read_text(spark: SparkSession, paths: str | list[str], separator: str, strict: bool, options: dict[str, str]) -> DataFrame:
    reader = spark.read.options(**options).option("header", True).option("sep", separator).option("inferSchema", False) \
        .option("encoding", "UTF-8").option("mode", "FAILFAST" if strict else "PERMISSIVE") \
        .option("enforceSchema", False).option("escape", '"')
    return reader.csv(paths)


def _drop_blank(df: DataFrame, data: Sequence[str]) -> DataFrame:
    filled = F.lit(False)
    for name in data:
        filled = filled | (quoted(name).isNotNull() & (quoted(name) != ""))
    return df.where(filled)


def _read(spark: SparkSession, paths: str | list[str], kind: str, position: bool, strict: bool,
          line_breaks: bool = True, merge: bool = False, options: dict[str, str] | None = None) -> DataFrame:
    options = options or {}
    if kind == "parquet":
        df = spark.read.options(**options).option("mergeSchema", merge).parquet(*(paths if isinstance(paths, list) else [paths]))
        if position:
            df = df.select("*", F.col("_metadata.file_path").alias("_file"), F.lit(0).cast("long").alias("_split"),
                           F.col("_metadata.row_index").alias("_row"))
        return df
    separator = SEPARATORS[kind]
    records = quoted_records(spark, paths, separator, options) if line_breaks else None
    if records is not None:
        names = header(spark, paths, separator, options)
        return _drop_blank(parsed_records(records, names, separator, strict, position), names)
    df = _read_text(spark, paths, separator, strict, options)
    if not df.columns:
        raise ValueError(f"flow file has no header: {paths}")
    data = df.columns
    # The byte order mark of a UTF-8 file is not part of the first column's name.
    renamed = [c.lstrip("\ufeff") for c in data]
    if position:
        df = df.select("*", F.col("_metadata.file_path").alias("_file"),
                       F.col("_metadata.file_block_start").alias("_split"),
                       F.monotonically_increasing_id().alias("_row"))
    return _drop_blank(df.toDF(*renamed, *df.columns[len(data):]), renamed)


def header(spark: SparkSession, paths: str | list[str], separator: str, options: dict[str, str] | None = None) -> list[str]:
    """Column names of text files whose first record may hold line breaks."""
    reader = spark.read.options(**(options or {})).option("header", True).option("sep", separator).option("escape", '"').option("multiLine", True)
    return [c.lstrip("\ufeff") for c in reader.csv(paths).columns]


def _glob(kind: str) -> str:
    """A file name pattern for a format's extensions, in either case."""
    endings = ["".join(f"[{c.lower()}{c.upper()}]" for c in e[1:]) for e, k in FORMATS.items() if k == kind]
    return "*.{" + ",".join(endings) + "}"


def folder_formats(spark: SparkSession, folder: str) -> list[str]:
    """The formats of the recognised files below a folder, told by one job."""
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path")
    suffix = F.lower(F.regexp_extract("path", r"(\.[A-Za-z0-9]+)$", 1))
    kinds = listing.select(F.try_element_at(F.create_map(*[F.lit(x) for pair in FORMATS.items() for x in pair]), suffix).alias("kind"))
    return sorted(row["kind"] for row in kinds.where("kind is not null").distinct().collect())


def folder_headers(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    """(_file, head, open) of every text file: its first line that isn't blank, and whether a cell goes on in the next line.

    One pass over the files, reduced to a row per file where they are read.
    """
    lines = text_lines(spark, folder, SEPARATORS[kind], {"recursiveFileLookup": "true", "pathGlobFilter": _glob(kind)})
    first = lines.where("_split = 0").where(F.btrim("value", F.lit("\r")) != "").withColumn("_at", F.monotonically_increasing_id())
    heads = first.groupBy("_file").agg(F.min_by(F.struct("value", "out"), "_at").alias("first"))
    return heads.select("_file", F.col("first.value").alias("head"), F.col("first.out").alias("open"))


def read_folder(spark: SparkSession, folder: str, kind: str, position: bool, strict: bool, line_breaks: bool = True) -> DataFrame:
    """All text files of one format below a folder, whatever their headers.

    Files with the same header line share a signature. The driver sees one file of each signature; cells are read by place, all files
    together, and get their names from the signature of their file. Jobs grow with signatures, not with files. With `strict`,
    or where a header holds a line break, each signature's files are read on their own, and their names reach the driver.
    """
    heads = staged(folder_headers(spark, folder, kind))
    found = heads.groupBy("head").agg(F.min("_file").alias("example"), F.max("open").alias("open")).orderBy("head").collect()
    names = [header(spark, row["example"], SEPARATORS[kind]) for row in found]
    plain = [[plain_name(n) for n in group] for group in names]
    if strict or any(row["open"] for row in found):
        groups: dict[tuple[str, ...], list[str]] = {}
        for row in heads.orderBy("_file").toLocalIterator():
            own = header(spark, row["_file"], SEPARATORS[kind]) if row["open"] else names[[f["head"] for f in found].index(row["head"])]
            groups.setdefault(tuple(own), []).append(row["_file"])
        return union_sources([_read(spark, group, kind, position, strict, line_breaks) for group in groups.values()])
    for group, own in zip(names, plain):
        if len(set(own)) < len(own):
            raise ValueError(f"columns {group} don't have different plain names")
    most = max(map(len, names), default=0)
    if not most:
        raise ValueError(f"no header in the text files of {folder}")
    options = {"recursiveFileLookup": "true", "pathGlobFilter": _glob(kind)}
    cells = [f"_c{k}" for k in range(most)]
    records = quoted_records(spark, folder, SEPARATORS[kind], options) if line_breaks else None
    if records is not None:
        rows = parsed_records(records, cells, SEPARATORS[kind], False, True)
    else:
        text = spark.read.options(**options).schema(", ".join(f"{c} string" for c in cells)).option("header", True).option("sep", SEPARATORS[kind]) \
            .option("encoding", "UTF-8").option("enforceSchema", True).option("escape", '"').csv(folder)
        rows = text.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_split"),
                           F.monotonically_increasing_id().alias("_row"))
    if len(found) == 1:
        named = rows.select(*[F.col(c).alias(n) for c, n in zip(cells, plain[0])], *POSITION)
    else:
        number = F.create_map(*[x for k, row in enumerate(found) for x in (F.lit(row["head"]), F.lit(k))])[F.col("head")]
        rows = join_small(rows, heads.select("_file", number.alias("_signature")), ["_file"])
        every = list(dict.fromkeys(n for group in plain for n in group))
        named = rows.select(*[F.coalesce(*[F.when(F.col("_signature") == k, F.col(cells[group.index(n)])) for k, group in enumerate(plain) if n in group])
                              .alias(n) for n in every], *POSITION)
    return _drop_blank(named if position else named.drop(*POSITION), [c for c in named.columns if c not in POSITION])


def read_flows(spark: SparkSession, path: str, kind: str | None = None, *, project: bool = False,
               keep: Sequence[str] = (), position: bool = False, strict: bool = False,
               same_header: bool = False, line_breaks: bool = True) -> DataFrame:
    """Records of a file or, recursively, of all recognised files of a folder.

    CSV and TSV cells stay text; numbers are taken from them when events are made. `project`
    keeps only recognised columns. `position` adds where a record stands: file, split, row.
    `strict` fails on a malformed text row instead of leaving its cells empty. `same_header`
    promises that all text files of a folder share one header, so it is read only once. Quoted text
    cells may hold doubled quotes and line breaks; large files are split all the same, after a first pass that looks for such
    cells. `line_breaks=False` promises that there are none and saves that pass.
    """
    extension = os.path.splitext(path.rstrip("/"))[1].lower()
    if kind is None and extension:
        kind = file_format(path)
    if kind is None:
        found = folder_formats(spark, path)
        if not found:
            raise ValueError(f"no supported traffic files found in {path}")
        df = union_sources([_folder_part(spark, path, form, position, strict, same_header, line_breaks) for form in found])
    else:
        df = _read(spark, path, kind, position, strict, line_breaks)
    return project_recognized(df, keep) if project else df


def _folder_part(spark: SparkSession, folder: str, kind: str, position: bool, strict: bool, same_header: bool, line_breaks: bool) -> DataFrame:
    """All files of one format below a folder."""
    if kind == "parquet" or same_header:
        return normalized(_read(spark, folder, kind, position, strict, line_breaks, merge=True,
                                options={"recursiveFileLookup": "true", "pathGlobFilter": _glob(kind)}))
    return read_folder(spark, folder, kind, position, strict, line_breaks)


def normalized(df: DataFrame) -> DataFrame:
    return df.toDF(*column_names(df))


def union_sources(tables: Sequence[DataFrame]) -> DataFrame:
    """All records of several tables; a column missing in one of them is NULL there.

    Columns are matched by plain name. Where one table holds numbers and another text, the
    column becomes text, which events are made from just the same.
    """
    tables = [normalized(t) for t in tables]
    types: dict[str, set[str]] = {}
    for table in tables:
        for name, dtype in table.dtypes:
            types.setdefault(name, set()).add(dtype)
    mixed = {name for name, found in types.items() if len(found) > 1}
    result = None
    for table in tables:
        table = table.select(*[quoted(c).cast("string").alias(c) if c in mixed else quoted(c) for c in table.columns])
        result = table if result is None else result.unionByName(table, allowMissingColumns=True)
    return result


def with_file_row(df: DataFrame, name: str = "file_row") -> DataFrame:
    """Number the records of each file 0, 1, … as they are stored.

    Works on records read with `position`. Splits of a file are numbered on their own; only their
    sizes are added up.
    """
    one = F.lit(1).cast("long")
    counted = running(df, ["_file"], F.col("_row"), [F.col("_split"), chunk_of("_row")], {"_n": ("sum", one)})
    return counted.withColumn(name, F.col("_n") - 1).drop("_n")


def with_row_number(df: DataFrame, name: str = "row_number") -> DataFrame:
    """Number the records over all files in path order."""
    counted = with_file_row(df, "_in_file")
    sizes = df.groupBy("_file").agg(F.count("*").alias("_rows"))
    # One row per file: small enough to be ordered in one place.
    before = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(F.col("_file").alias("_f"), F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    joined = counted.join(offsets, F.col("_file") == F.col("_f"))
    return joined.withColumn(name, F.col("_before") + F.col("_in_file")).drop("_f", "_before", "_in_file")


def with_row_time(df: DataFrame, name: str = "timestamp", position: str | None = None) -> DataFrame:
    """Row position as time in seconds, for sources without a time column."""
    if position:
        return df.withColumn(name, F.col(position).cast("double"))
    numbered = with_row_number(df, "_n")
    return numbered.withColumn(name, F.col("_n").cast("double")).drop("_n")
