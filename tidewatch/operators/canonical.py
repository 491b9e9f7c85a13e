"""Records of any source -> the canonical event columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.labels import binary_label, parse_stage, stage_from_label
from tidewatch.functions.numbers import (
    cell_numbers, column_names, first_cell, first_column, first_number, micros, plain_name, port_list, quoted,
    to_number,
)
from tidewatch.schema import (
    CATEGORY_COLUMNS, COLUMN_ALIASES, LABEL_COLUMNS, MOMENTS, ONLINE, PORT_COLUMNS, RISK_COLUMNS, STAGE_COLUMNS,
    TIME_COLUMNS, VALUE_ALIASES, FeatureOptions,
)

LABEL_MODES = ("columns", "text", "binary", "none")


def _first_present(names: dict[str, str], wanted: Sequence[str]) -> str | None:
    return next((names[plain_name(w)] for w in wanted if plain_name(w) in names), None)


def event_time(df: DataFrame, ts: str | None = None) -> Column:
    """Event time in microseconds from the named column or the first known time column holding one."""
    names = column_names(df)
    wanted = (ts,) if ts else TIME_COLUMNS
    found = [names[plain_name(w)] for w in wanted if plain_name(w) in names]
    if not found:
        raise ValueError("no time column; add one with with_row_time()")
    return F.coalesce(*[micros(quoted(c), df.schema[c].dataType) for c in found])


def measures(df: DataFrame, options: FeatureOptions = ONLINE) -> dict[str, Column]:
    """One number per measure; iat, ttl, tcp_window and payload are lists when all numbers of a cell count."""
    if options.resolve == "column":
        return {name: first_column(df, *aliases) for name, aliases in COLUMN_ALIASES.items()}
    result = {}
    for name, aliases in VALUE_ALIASES.items():
        if name not in MOMENTS:
            result[name] = first_number(df, *aliases)
        elif options.cells == "all":
            result[name] = cell_numbers(df, *aliases)
        else:
            result[name] = first_cell(df, *aliases)
    return result


def label_columns(df: DataFrame, mode: str) -> dict[str, Column]:
    """Stage and risk from number columns, from label texts, or from one benign/attack text."""
    names = column_names(df)
    if mode not in LABEL_MODES:
        raise ValueError(f"labels must be one of {', '.join(LABEL_MODES)}")
    stage: Column = F.lit(0)
    risk: Column = F.lit(0.0)
    if mode == "columns":
        column = _first_present(names, STAGE_COLUMNS)
        if column:
            stage = parse_stage(quoted(column), df.schema[column].dataType)
        column = _first_present(names, RISK_COLUMNS)
        if column:
            risk = to_number(quoted(column), df.schema[column].dataType)
    elif mode == "text":
        label = _first_present(names, LABEL_COLUMNS)
        category = _first_present(names, CATEGORY_COLUMNS)
        stage = stage_from_label(quoted(label) if label else F.lit("0"),
                                 quoted(category) if category else F.lit(""))
        risk = (stage > 0).cast("double")
    elif mode == "binary":
        column = _first_present(names, LABEL_COLUMNS + CATEGORY_COLUMNS)
        if column:
            stage = binary_label(quoted(column))
            risk = stage.cast("double")
    return {"stage": stage.cast("int"), "risk": risk.cast("double")}


def canonical_events(df: DataFrame, *, ts: str | None = None, keys: Sequence[str] = (), keep: Sequence[str] = (),
                     labels: str = "columns", options: FeatureOptions = ONLINE, timed: bool = True) -> DataFrame:
    """Series keys, event time, measures, ports, stage and risk of every record.

    Aliases are resolved against the schema while the plan is built, so the scan reads only
    the columns that feed a measure, a key or a kept column.
    """
    columns: list[Column] = [F.col(c) for c in (*keys, *keep)]
    if timed:
        columns.append(event_time(df, ts).alias("ts_us"))
    columns += [value.alias(name) for name, value in measures(df, options).items()]
    if options.resolve == "value":
        ports = port_list(df, *PORT_COLUMNS)
        if ports is not None:
            columns.append(ports.alias("ports"))
    columns += [value.alias(name) for name, value in label_columns(df, labels).items()]
    return df.select(*columns)


def unreadable_times(events: DataFrame) -> DataFrame:
    """How many events carry no readable time (these belong to no time window)."""
    return events.agg(F.count_if(F.col("ts_us").isNull()).alias("unreadable_times"), F.count("*").alias("events"))
