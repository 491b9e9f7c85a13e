"""Labels, stages and alert predicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.functions.numbers import to_number
from tidewatch.schema import BENIGN_LABELS, CATEGORY_STAGE, STAGES

UNKNOWN_STAGE = "Unmapped forecast stage"
SEMANTICS = ("stage_id", "binary_attack", "unknown")


def _lookup(pairs: dict) -> Column:
    return F.create_map(*[F.lit(part) for pair in pairs.items() for part in pair])


def label_text(value: Column) -> Column:
    return F.lower(F.trim(value.cast("string")))


def binary_label(value: Column) -> Column:
    """0 for a benign label text, else 1; a missing label counts as an attack."""
    return F.when(F.coalesce(label_text(value), F.lit("")).isin(*BENIGN_LABELS), 0).otherwise(1)


def category_stage(category: Column) -> Column:
    return F.try_element_at(_lookup(CATEGORY_STAGE), F.coalesce(label_text(category), F.lit("")))


def stage_from_label(label: Column, category: Column) -> Column:
    """Stage of a labelled row: 0 when label or category is benign, else the category's stage, else 1."""
    stage = category_stage(category)
    benign = (binary_label(label) == 0) | F.coalesce(stage == 0, F.lit(False))
    return F.when(benign, 0).otherwise(F.coalesce(stage, F.lit(1)))


def stage_name(stage: Column, fallback: str = UNKNOWN_STAGE) -> Column:
    return F.coalesce(F.try_element_at(_lookup(STAGES), stage.cast("int")), F.lit(fallback))


def parse_stage(value: Column, dtype: T.DataType) -> Column:
    """Stage number cut to an integer; NULL when the cell holds no number."""
    return to_number(value, dtype).try_cast("int")


def clean_stage(value: Column, dtype: T.DataType | None = None) -> Column:
    """NULL for missing labels (NULL, NaN, -1); anything but a stage id 0-5 is an error."""
    text = isinstance(dtype, T.StringType)
    number = value.try_cast("double")
    missing = value.isNull() | F.isnan(number) | (number == -1)
    known = number.isin(*[float(s) for s in STAGES])
    bad = F.raise_error(F.concat(F.lit("stages must be integers 0-5, -1 or missing; got "), value.cast("string")))
    if text:
        missing = value.isNull() | F.coalesce(F.isnan(number) | (number == -1), F.lit(False))
    return F.when(missing, F.lit(None).cast("int")).when(F.coalesce(known, F.lit(False)), number.cast("int")) \
        .otherwise(bad.cast("int"))


def with_clean_stage(df: DataFrame, stage: str = "stage") -> DataFrame:
    """The table with its stage column cleaned."""
    return df.withColumn(stage, clean_stage(F.col(stage), df.schema[stage].dataType))


def risk_target(stage: Column, semantics: str) -> Column:
    """1 when the stage is an attack stage; NULL when the labels' meaning is unknown."""
    _check(semantics)
    return F.when(F.lit(semantics != "unknown"), (stage > 0).cast("int"))


def stage_target(stage: Column, semantics: str) -> Column:
    """The stage itself, only when labels are known to be stage ids."""
    _check(semantics)
    return F.when(F.lit(semantics == "stage_id"), stage.cast("int"))


def targets(df: DataFrame, semantics: str, stage: str = "stage") -> DataFrame:
    return df.withColumns({"actual_risk": risk_target(F.col(stage), semantics),
                           "actual_stage": stage_target(F.col(stage), semantics)})


def _check(semantics: str) -> None:
    if semantics not in SEMANTICS:
        raise ValueError(f"label semantics must be one of {', '.join(SEMANTICS)}")


def clip01(score: Column) -> Column:
    return F.greatest(F.least(score, F.lit(1.0)), F.lit(0.0))


def alerts(df: DataFrame, threshold: float, score: str = "score") -> DataFrame:
    """Rows at or over the threshold, with the score clipped for display."""
    return df.where(F.col(score) >= F.lit(threshold)).withColumn("shown_score", clip01(F.col(score)))
