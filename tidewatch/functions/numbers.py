"""Turning loosely typed cells into numbers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def plain_name(name: str) -> str:
    return name.strip().lower().replace(" ", "_").replace("-", "_")


def column_names(df: DataFrame) -> dict[str, str]:
    """Plain name -> actual column name; two columns with one plain name are an error."""
    names: dict[str, str] = {}
    for actual in df.columns:
        plain = plain_name(actual)
        if plain in names:
            raise ValueError(f"columns {names[plain]!r} and {actual!r} both read as {plain!r}")
        names[plain] = actual
    return names


def normalize_columns(df: DataFrame) -> DataFrame:
    """Rename every column to its plain name."""
    return df.toDF(*column_names(df))


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def finite(value: Column) -> Column:
    """NULL in place of NaN and infinities."""
    return F.when(~F.isnan(value) & (F.abs(value) < F.lit(float("inf"))), value)


def int_div(value: Column, by: int) -> Column:
    """Integer division rounding down, exact for 64-bit integers."""
    step = F.lit(by).cast("long")
    return F.call_function("div", value - F.pmod(value, step), step)


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.NumericType, T.BooleanType))


def number_sql(cell: str, dtype: T.DataType) -> str:
    """SQL text of a finite DOUBLE, or NULL where the cell holds none."""
    if isinstance(dtype, (T.IntegralType, T.BooleanType, T.DecimalType)):
        return f"cast({cell} AS DOUBLE)"
    if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType, T.BinaryType)):
        return "cast(NULL AS DOUBLE)"
    number = f"try_cast({cell} AS DOUBLE)"
    kept = f"if(isnan({number}) OR abs({number}) = double('Infinity'), NULL, {number})"
    if isinstance(dtype, T.StringType):
        # A trailing d or f is a number suffix to the cast but not part of a number in text data.
        return f"if(lower(right(trim({cell}), 1)) IN ('d', 'f'), NULL, {kept})"
    return kept


def to_number(value: Column, dtype: T.DataType) -> Column:
    """A finite DOUBLE, or NULL where the cell holds none."""
    if isinstance(dtype, (T.IntegralType, T.BooleanType, T.DecimalType)):
        return value.cast("double")
    if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType, T.BinaryType)):
        return F.lit(None).cast("double")
    number = finite(value.try_cast("double"))
    if isinstance(dtype, T.StringType):
        return F.when(~F.lower(F.right(F.trim(value), F.lit(1))).isin("d", "f"), number)
    return number


def number_list(value: Column, dtype: T.DataType) -> Column:
    """Every finite number of a list cell or of a text separated by , or ;"""
    if isinstance(dtype, T.ArrayType):
        items = F.transform(value, lambda item: to_number(item, dtype.elementType))
    elif isinstance(dtype, T.StringType):
        items = F.transform(F.split(value, "[,;]"), lambda item: to_number(item, dtype))
    else:
        items = F.array(to_number(value, dtype))
    return F.filter(items, lambda item: item.isNotNull())


def _present(df: DataFrame, aliases: Sequence[str]) -> list[tuple[str, T.DataType]]:
    """Quoted name and type of every alias the table has."""
    names = column_names(df)
    types = {field.name: field.dataType for field in df.schema.fields}
    found = [names[plain_name(a)] for a in aliases if plain_name(a) in names]
    return [("`" + name.replace("`", "``") + "`", types[name]) for name in found]


def first_number(df: DataFrame, *aliases: str, default: float | None = 0.0) -> Column:
    """Per row, the first alias that holds a finite number."""
    parsed = [number_sql(cell, dtype) for cell, dtype in _present(df, aliases)]
    last = "cast(NULL AS DOUBLE)" if default is None else f"double({default!r})"
    return F.expr(f"coalesce({', '.join([*parsed, last])})")


def first_column(df: DataFrame, *aliases: str) -> Column:
    """The first alias that exists as a column; cells without a finite number are 0."""
    parsed = [number_sql(cell, dtype) for cell, dtype in _present(df, aliases)[:1]]
    return F.expr(f"coalesce({', '.join([*parsed, 'double(0)'])})")


def cell_numbers(df: DataFrame, *aliases: str) -> Column:
    """All numbers of the first alias that is not NULL, else the first single number, else 0."""
    single = F.array(first_number(df, *aliases))
    chosen = F.lit(None).cast("array<double>")
    for cell, dtype in reversed(_present(df, aliases)):
        value = F.expr(cell)
        chosen = F.when(value.isNotNull(), number_list(value, dtype)).otherwise(chosen)
    return F.when(F.coalesce(F.size(chosen), F.lit(0)) > 0, chosen).otherwise(single)


def first_cell(df: DataFrame, *aliases: str) -> Column:
    """First number of a possibly list-valued cell."""
    if all(is_numeric(dtype) for _, dtype in _present(df, aliases)):
        return first_number(df, *aliases)
    return cell_numbers(df, *aliases)[0]


def port_list(df: DataFrame, *aliases: str) -> Column | None:
    """Positive ports of all the given columns together; None when the table has none of them.

    A single-number column adds NULL where it holds no port.
    """
    single, lists = [], []
    for cell, dtype in _present(df, aliases):
        if is_numeric(dtype):
            number = number_sql(cell, dtype)
            single.append(f"if({number} > 0, bigint({number}), NULL)")
        else:
            numbers = F.coalesce(number_list(F.expr(cell), dtype), F.array().cast("array<double>"))
            lists.append(F.transform(F.filter(numbers, lambda port: port > 0), lambda port: port.cast("long")))
    parts = ([F.expr(f"array({', '.join(single)})")] if single else []) + lists
    if not parts:
        return None
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def micros(value: Column, dtype: T.DataType) -> Column:
    """Microseconds since the epoch; numbers are taken as seconds, unreadable cells give NULL."""
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.unix_micros(value.cast("timestamp"))
    seconds = F.round(to_number(value, dtype) * F.lit(1e6)).try_cast("long")
    if isinstance(dtype, T.StringType):
        return F.coalesce(seconds, F.unix_micros(value.try_cast("timestamp")))
    return seconds


def double_path(value: Column) -> list[Column]:
    """Two bucket columns, coarse to fine, that grow with a DOUBLE.

    The first holds the sign, the binary exponent and 8 fraction bits, the second the next 22
    bits. Any two levels hold at most about 4 million different values under one parent, however
    tightly the values are clustered, so ordered work on distinct values never needs a larger group.
    """
    size = F.abs(value)
    exponent = F.when(size > 0, F.greatest(F.floor(F.log2(size)), F.lit(-1000))).otherwise(F.lit(-1001))
    scaled = F.when(size > 0, size * F.pow(F.lit(2.0), -exponent.cast("double")) * 256).otherwise(F.lit(0.0))
    sign = F.when(value < 0, F.lit(-1)).otherwise(F.lit(1)).cast("long")
    coarse = (exponent + 1100) * 512 + F.floor(scaled)
    fine = F.floor((scaled - F.floor(scaled)) * F.lit(float(1 << 22)))
    return [sign * coarse, sign * fine]
