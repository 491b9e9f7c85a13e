"""Ordered work on series of any length.

A window function over a whole series would put a busy series into one task. Here a series is
cut into chunks of its order column; each chunk is ordered on its own and what it needs from
outside arrives as extra rows: one row with the totals of all chunks before it (`running`), or
copies of the few neighbouring rows (`with_halo`).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.numbers import int_div

CHUNK = 65_536
KINDS = {"sum": F.sum, "max": F.max, "min": F.min, "total": F.sum}


def chunk_of(order: str, size: int = CHUNK) -> Column:
    return int_div(F.col(order), size)


def running(df: DataFrame, keys: Sequence[str], order: Column, path: Sequence[Column],
            values: Mapping[str, tuple[str, Column]], inclusive: bool = True) -> DataFrame:
    """Add running sums, maxima or minima along `order` within each series.

    `values` maps a new column to ("sum" | "max" | "min" | "total", input), where "total" is the
    sum over the whole series. `path` holds bucket columns,
    coarse to fine, that never fall as `order` rises; rows of one series and one full path are
    ordered together, so the path bounds how many rows that can be. With `inclusive=False` a
    row's own value is left out.
    """
    levels = [f"_b{i}" for i in range(len(path))]
    inputs = {f"_in_{name}": value for name, (_, value) in values.items()}
    rows = df.withColumns({**dict(zip(levels, path)), "_order": order, **inputs})
    out = _running(rows, list(keys), levels, {name: kind for name, (kind, _) in values.items()}, inclusive)
    return out.drop("_order", *levels, *inputs)


def _running(rows: DataFrame, keys: list[str], levels: list[str], kinds: dict[str, str], inclusive: bool) -> DataFrame:
    frame_end = 0 if inclusive else -1
    if not levels:
        spec = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy("_order")
        spec = spec.rowsBetween(Window.unboundedPreceding, frame_end)
        whole = spec.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        return rows.withColumns({name: KINDS[kind](f"_in_{name}").over(whole if kind == "total" else spec)
                                 for name, kind in kinds.items()})
    group = keys + levels
    totals = rows.groupBy(*group).agg(*[KINDS[kind](f"_in_{name}").alias(f"_in_{name}")
                                        for name, kind in kinds.items()])
    totals = totals.withColumn("_order", F.col(levels[-1]))
    before = _running(totals, keys, levels[:-1], kinds, inclusive=False)
    carried = before.select(*group, F.lit(0).alias("_real"), F.lit(None).cast(rows.schema["_order"].dataType).alias("_order"),
                            *[F.col(name).alias(_slot(name, kind)) for name, kind in kinds.items()])
    both = rows.withColumn("_real", F.lit(1)).unionByName(carried, allowMissingColumns=True)
    spec = Window.partitionBy(*group).orderBy("_real", "_order").rowsBetween(Window.unboundedPreceding, frame_end)
    out = both.withColumns({name: (F.max if kind == "total" else KINDS[kind])(_slot(name, kind)).over(spec)
                            for name, kind in kinds.items()})
    return out.where("_real = 1").drop("_real", *[_slot(n, k) for n, k in kinds.items() if k == "total"])


def _slot(name: str, kind: str) -> str:
    """Column in which the carried row brings its value: totals must not mix with the rows' own inputs."""
    return f"_grand_{name}" if kind == "total" else f"_in_{name}"


def running_by_index(df: DataFrame, keys: Sequence[str], order: str, values: Mapping[str, tuple[str, Column]],
                     inclusive: bool = True, size: int = CHUNK) -> DataFrame:
    """`running` along an integer column that is unique within a series: at most `size` rows per group."""
    return running(df, keys, F.col(order), [chunk_of(order, size)], values, inclusive)


def with_halo(df: DataFrame, keys: Sequence[str], index: str, before: int = 0, after: int = 0,
              size: int = 8_192) -> tuple[DataFrame, Window]:
    """Copy rows near chunk borders into the neighbouring chunk.

    Returns the rows with `_home` (false for copies) and the window specification in which every
    home row sees its `before` predecessors and `after` followers. `index` must count 0, 1, 2, …
    within a series.
    """
    size = max(size, 4 * (before + after))
    position = F.pmod(F.col(index), F.lit(size))
    home = chunk_of(index, size)
    chunks = [home]
    if before:
        chunks.append(F.when(position >= size - before, home + 1))
    if after:
        chunks.append(F.when((position < after) & (home > 0), home - 1))
    rows = df.withColumn("_home_chunk", home)
    if len(chunks) > 1:
        rows = rows.withColumn("_chunk", F.explode(F.array_compact(F.array(*chunks))))
    else:
        rows = rows.withColumn("_chunk", home)
    rows = rows.withColumn("_home", F.col("_chunk") == F.col("_home_chunk")).drop("_home_chunk")
    return rows, Window.partitionBy(*keys, "_chunk").orderBy(index)


def drop_halo(df: DataFrame) -> DataFrame:
    return df.where("_home").drop("_home", "_chunk")
