"""Quoted text files read by many tasks, whose cells may hold line breaks.

A line break ends a record only outside quotes, and whether a byte range begins inside quotes depends on all before it. So
every range is read twice. First each range is turned into a table "outside on entry -> …, inside on entry -> …", made of the
few lines that open or close a cell without the other; the tables are composed along each file. Then each range is cut into
records from its true state, and the pieces of records that cross a border are put together.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WHOLE, TAIL, HEAD = 0, 1, 2
PLACE = ("_file", "_split", "_row")
_PIECES = "_file string, _split long, _row long, kind int, owner long, value string"
_SCHEMA = pa.schema([("_file", pa.string()), ("_split", pa.int64()), ("_row", pa.int64()), ("kind", pa.int32()),
                     ("owner", pa.int64()), ("value", pa.string())])


def _after(start: int, separator: str) -> Column:
    """Is a line's end inside quotes, if its start is outside (0) or inside (1)?

    A quote opens a cell where the cell begins; in a cell, two quotes are one, and any other ends it. Elsewhere a quote
    is a plain character. States: 0 a line's start, 1 inside, 2 after a closing quote, 3 within an unquoted cell.
    """
    step = f"""CASE WHEN state = 1 THEN 2 WHEN endswith(piece, '{separator}') OR (piece = '' AND state IN (0, 2)) THEN 1 ELSE 3 END"""
    return F.expr(f"""aggregate(slice(split(value, '"', -1), 1, size(split(value, '"', -1)) - 1), {start}, (state, piece) -> {step}) = 1""")


def text_lines(spark: SparkSession, paths: str | list[str], separator: str, options: dict[str, str] | None = None) -> DataFrame:
    """Physical lines with their place; `out` and `in` tell whether a line ends inside quotes, entered outside or inside."""
    text = spark.read.options(**(options or {})).option("lineSep", "\n").text(paths)
    quotes = F.contains("value", F.lit('"'))
    return text.select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_split"),
                       F.when(quotes, _after(0, separator)).otherwise(F.lit(False)).alias("out"),
                       F.when(quotes, _after(1, separator)).otherwise(F.lit(True)).alias("in"))


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines that change something -> one composed table per range, and whether any line of it may open a cell."""
    at, table, opens, done = None, (False, True), False, []
    for batch in batches:
        for file, split, out, inside in zip(*[c.to_pylist() for c in batch.columns]):
            if (file, split) != at:
                if at is not None:
                    done.append((*at, *table, opens))
                at, table, opens = (file, split), (False, True), False
            step, opens = (out, inside), opens or out
            table = (step[table[0]], step[table[1]])
    if at is not None:
        done.append((*at, *table, opens))
    if done:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), (pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.bool_()))],
                                         names=["_file", "_split", "out", "in", "opens"])


class Borders:
    """Where ranges change the state of a file, in order: (first byte of the range, inside after it, range of the open record)."""

    def __init__(self, tables) -> None:
        self.files: dict[str, tuple[list[int], list[bool], list[int]]] = {}
        for file, split, *table, _ in sorted(tables):
            splits, states, owners = self.files.setdefault(file, ([], [], []))
            inside, owner = (states[-1], owners[-1]) if states else (False, -1)
            splits.append(split)
            # A range that ends inside either goes on with the record it began in, or ends it and opens another.
            states.append(table[inside])
            owners.append(owner if inside and table[0] != table[1] else split)

    def entry(self, file: str, split: int) -> tuple[bool, int]:
        """Does a range begin inside quotes, and in which range did that record begin?"""
        splits, states, owners = self.files.get(file, ([], [], []))
        k = bisect_left(splits, split) - 1
        return (states[k], owners[k]) if k >= 0 else (False, -1)

    def crossed(self) -> bool:
        return any(any(states) for _, states, _ in self.files.values())


def _pieces(borders: Borders, wanted: tuple[int, ...]):
    """Lines -> whole records, and the pieces of those that cross a range's border, without each file's first record."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state, open_lines, row, began, owner, header = None, False, [], 0, 0, -1, False
        out: list[tuple] = []

        def close(kind: int) -> None:
            nonlocal open_lines, header
            if open_lines:
                value = "\n".join(open_lines)
                if header and kind == WHOLE:
                    header = not value.strip()
                elif kind in wanted:
                    out.append((*at, began, kind, owner if kind == HEAD else at[1], value))
            open_lines = []

        for batch in batches:
            values, files, splits, outs, ins = (c.to_pylist() for c in batch.columns)
            for value, file, split, after_out, after_in in zip(values, files, splits, outs, ins):
                if (file, split) != at:
                    if at is not None:
                        close(HEAD if owner >= 0 else TAIL)
                    at, row, began = (file, split), 0, 0
                    state, owner = borders.entry(file, split)
                    owner, header = owner if state else -1, split == 0
                if not open_lines:
                    began = row
                open_lines.append(value)
                state = after_in if state else after_out
                row += 1
                if not state:
                    close(HEAD if owner >= 0 else WHOLE)
                    owner = -1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _SCHEMA)], schema=_SCHEMA)
                out = []
        if at is not None:
            close(HEAD if owner >= 0 else TAIL)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _SCHEMA)], schema=_SCHEMA)

    return cut


def quoted_records(spark: SparkSession, paths: str | list[str], separator: str, options: dict[str, str] | None = None) -> DataFrame | None:
    """(_file, _split, _row, value): the records of text files as they stand, quotes and line breaks included, without headers.

    None where no cell of these files holds a line break, so that any line reader will do. What reaches the driver is one
    row per range (of spark.sql.files.maxPartitionBytes) that holds an opening or closing quote of such a cell, no more than it planned
    tasks for. A record that crosses ranges belongs to the one it began in.
    """
    lines = text_lines(spark, paths, separator, options)
    changing = lines.where("out OR NOT in").select("_file", "_split", "out", "in")
    tables = changing.mapInArrow(_tables, "_file string, _split long, out boolean, in boolean, opens boolean").toArrow().to_pydict()
    if not any(tables["opens"]):
        return None
    borders = Borders(zip(*tables.values()))
    whole = lines.mapInArrow(_pieces(borders, (WHOLE,)), _PIECES).select("_file", "_split", "_row", "value")
    if not borders.crossed():
        return whole
    parts = lines.mapInArrow(_pieces(borders, (TAIL, HEAD)), _PIECES)
    ordered = F.sort_array(F.collect_list(F.struct("_split", "value")))
    joined = parts.groupBy("_file", "owner").agg(ordered.alias("parts"), F.max(F.when(F.col("kind") == TAIL, F.col("_row"))).alias("_row"))
    crossing = joined.where("NOT (owner = 0 AND _row = 0)").select(
        "_file", F.col("owner").alias("_split"), "_row", F.array_join(F.transform("parts", lambda p: p["value"]), "\n").alias("value"))
    return whole.unionByName(crossing)


def parsed_records(records: DataFrame, columns: list[str], separator: str, strict: bool, position: bool) -> DataFrame:
    """Records as text columns; cells as the CSV reader gives them."""
    options = {"sep": separator, "escape": '"', "mode": "FAILFAST" if strict else "PERMISSIVE"}
    schema = ", ".join(f"`c{k}` string" for k in range(len(columns)))
    value = F.regexp_replace("value", "\r$", "")
    rows = records.where(F.length(F.btrim("value", F.lit("\r"))) > 0).withColumn("_cells", F.from_csv(value, schema, options))
    place = list(PLACE) if position else []
    return rows.select(*[F.col("_cells")[f"c{k}"].alias(name) for k, name in enumerate(columns)], *place)
