"""The 24 window features as grouped aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.schema import FEATURES, MOMENTS, ONLINE, FeatureOptions

FLAGS = ("syn", "ack", "fin", "rst", "psh", "urg")
SUMS = ("bytes", "packets", "src_bytes", "dst_bytes", "src_packets", "dst_packets", *FLAGS, "fragments",
        "retransmissions")

# A block of ports is one BIGINT: 63 ports plus, in the top bit, whether the next block's first port occurs.
BLOCK = 63


def port_masks(events: DataFrame, by: Sequence[str]) -> DataFrame:
    """One BIGINT of port bits per group and block of 63 ports.

    A port that opens a block also sets the top bit of the block before.
    """
    ports = events.select(*by, F.explode("ports").alias("_port")).where("_port IS NOT NULL")
    marks = ports.select(*by, "_port", F.expr(
        f"explode(if(_port % {BLOCK} = 0 AND _port > 0, array(0, 1), array(0))) AS _before"))
    bits = marks.select(*by, F.expr(f"_port div {BLOCK} - _before AS block"),
                        F.expr(f"if(_before = 1, {BLOCK}, int(_port % {BLOCK})) AS bit"))
    return bits.groupBy(*by, "block").agg(F.expr("bit_or(shiftleft(1L, bit)) AS mask"))


def mask_counts(masks: DataFrame, by: Sequence[str]) -> DataFrame:
    """Distinct ports and directly following port pairs of each block."""
    return masks.select(*by, F.expr(f"bigint(bit_count(mask & {(1 << BLOCK) - 1}L)) AS _ports"),
                        F.expr("bigint(bit_count(mask & shiftrightunsigned(mask, 1))) AS _pairs"))


def guarded_ratio(numerator: str, denominator: str, guard: str) -> str:
    if guard == "floor1":
        return f"{numerator} / greatest({denominator}, double(1))"
    return f"if({denominator} > 0, {numerator} / {denominator}, double(0))"


def _numbers(events: DataFrame, options: FeatureOptions) -> DataFrame:
    """Blank out the numbers that do not count under `missing="skip"`."""
    if options.missing == "zero":
        return events
    lists = {name for name, dtype in events.dtypes if dtype.startswith("array")}
    change = {}
    for name in MOMENTS[:-1]:
        value = F.col(name)
        change[name] = F.filter(value, lambda x: x > 0) if name in lists else F.when(value > 0, value)
    return events.withColumns(change)


def _list_moments(events: DataFrame) -> list[str]:
    return [name for name, dtype in events.dtypes if name in MOMENTS and dtype.startswith("array")]


def _spread_lists(events: DataFrame, lists: Sequence[str]) -> DataFrame:
    """A row per list item: the k-th row of a record has the k-th item of each list, the first one all its other numbers.

    Nothing is shuffled for it, and all moments are then taken over plain numbers.
    """
    first = events.withColumn("_n", F.lit(1).cast("long"))
    if not lists:
        return first
    full = [F.coalesce(F.col(name), F.array().cast(events.schema[name].dataType)).alias(name) for name in lists]
    rest = [c for c in first.columns if c not in lists]
    rows = first.select(*rest, F.posexplode_outer(F.arrays_zip(*full)).alias("_at", "_items"))
    once = F.coalesce(F.col("_at"), F.lit(0)) == 0
    single = [c for c in (*SUMS, *MOMENTS, "_n") if c in rest]
    return rows.select(*[c for c in rest if c not in single], *[F.when(once, F.col(c)).alias(c) for c in single],
                       *[F.col("_items")[name].alias(name) for name in lists])


def moment_inputs(events: DataFrame, options: FeatureOptions) -> DataFrame:
    """Records with plain numbers for the moments, and `_n`: how many records a row stands for."""
    events = _numbers(events, options)
    return _spread_lists(events, _list_moments(events))


MERGED = [f"{name}_{part}" for name in MOMENTS for part in "nadx"]
PORT_SUMS = ("_ports", "_pairs")


def _aggregates(calls: dict[str, str]) -> list[Column]:
    return [F.expr(f"{call}({name}) AS {name}") for name, call in calls.items()]


def _plain_aggregates(ports: bool) -> list[Column]:
    calls = dict.fromkeys(SUMS, "sum") | {"duration": "max", "_n": "sum", "stage": "max", "risk": "max"}
    return _aggregates(calls | (dict.fromkeys(PORT_SUMS, "sum") if ports else {}))


def pane_aggregates() -> list[Column]:
    """Aggregates of a pane: of each moment its count, mean, sum of squared deviations from that mean, and maximum."""
    return _plain_aggregates(False) + [F.expr(f"{call} AS {name}_{part}") for name in MOMENTS for part, call in (
        ("n", f"count({name})"), ("a", f"avg({name})"), ("d", f"var_pop({name}) * count({name})"), ("x", f"max({name})"))]


def merged_panes(rows: DataFrame, by: Sequence[str], ports: bool) -> DataFrame:
    """Panes (and rows with port counts) -> one row per group, with `_a`, `_v` and `_x` of each moment.

    Squares are taken of what the pane means are beyond the group's least one, never of the means themselves, so however large the
    numbers are, only their spread counts. The least means come from a window over the group, which is dealt as the aggregate needs it:
    one shuffle for both.
    """
    group = Window.partitionBy(*by)
    shifted = rows.withColumns({f"{name}_c": F.min(f"{name}_a").over(group) for name in MOMENTS})
    parts = []
    for name in MOMENTS:
        beyond = f"({name}_a - {name}_c)"
        parts += [F.expr(f"{e} AS {name}_{part}") for part, e in (
            ("n", f"sum({name}_n)"), ("s", f"sum({name}_n * {beyond})"), ("q", f"sum({name}_d + {name}_n * {beyond} * {beyond})"),
            ("c", f"min({name}_c)"), ("x", f"max({name}_x)"))]
    table = shifted.groupBy(*by).agg(*_plain_aggregates(ports), *parts)
    return table.withColumns({f"{name}_{part}": F.expr(e) for name in MOMENTS for part, e in (
        ("a", f"{name}_c + try_divide({name}_s, {name}_n)"),
        ("v", f"try_divide({name}_q - try_divide({name}_s, {name}_n) * {name}_s, {name}_n)"))})


def _floor0(value: str) -> str:
    return f"greatest(coalesce({value}, double(0)), double(0))"


def _moments(name: str) -> tuple[str, str, str]:
    return f"coalesce({name}_a, double(0))", _floor0(f"{name}_v"), _floor0(f"{name}_x")


def finish(table: DataFrame, by: Sequence[str], options: FeatureOptions) -> DataFrame:
    """Aggregated sums -> the feature columns in their fixed order."""
    moment = {name: _moments(name) for name in MOMENTS}
    ported = "_ports" in table.columns
    ports, pairs = ("coalesce(_ports, 0)", "coalesce(_pairs, 0)") if ported else ("0", "0")
    values = {
        "flow_bytes": "bytes", "flow_packets": "packets", "flow_duration": _floor0("duration"),
        "iat_mean": moment["iat"][0], "iat_variance": moment["iat"][1], "iat_max": moment["iat"][2],
        "bidirectional_byte_ratio": guarded_ratio("src_bytes", "dst_bytes", options.ratio_guard),
        "bidirectional_packet_ratio": guarded_ratio("src_packets", "dst_packets", options.ratio_guard),
        **{f"{flag}_count": flag for flag in FLAGS},
        "ttl_mean": moment["ttl"][0], "ttl_variance": moment["ttl"][1],
        "tcp_window_mean": moment["tcp_window"][0], "tcp_window_variance": moment["tcp_window"][1],
        "fragment_count": "fragments",
        "payload_mean": moment["payload"][0], "payload_variance": moment["payload"][1],
        "port_diversity": ports,
        "sequential_port_score": f"if({ports} > 1, {pairs} / ({ports} - 1), double(0))",
        "retransmission_count": "retransmissions",
    }
    return table.select(*by, *[F.expr(f"cast({values[name]} AS DOUBLE) AS {name}") for name in FEATURES],
                        F.expr("_n AS event_count"), F.expr("greatest(coalesce(stage, 0), 0) AS stage"),
                        F.expr(f"{_floor0('risk')} AS risk"))


def with_port_rows(rows: DataFrame, masks: DataFrame | None, by: Sequence[str]) -> DataFrame:
    """Append rows that carry only port counts: one per group, in a stream one per group and port block.

    Blocks are added up by narrow rows first: a block's row would else open a group of all the sums in its task.
    """
    if masks is None:
        return rows
    counts = mask_counts(masks, by)
    if not counts.isStreaming:
        counts = counts.groupBy(*by).agg(*_aggregates(dict.fromkeys(PORT_SUMS, "sum")))
    return rows.unionByName(counts, allowMissingColumns=True)


PARTS = 200  # up to this many parts Spark writes a shuffle's files without holding rows


def gathered(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """The rows dealt out by group, in parts of the session's advisory size, so that a task's partial sums are those of few groups.

    A group's partial sums are many times as wide as a record in its file: where a scan task meets about as many groups as records,
    they would fill its memory. Parts are cut by size, so a busy group has many. A stream's rows stay where they are.
    """
    if rows.isStreaming:
        return rows
    return rows.withColumn("_group", F.xxhash64(*by)).hint("rebalance", PARTS, "_group").drop("_group")


def window_features(events: DataFrame, by: Sequence[str], options: FeatureOptions = ONLINE, many: bool = False) -> DataFrame:
    """24 features, event count, highest stage and highest risk of every group.

    Port bits are reduced on their own and appended to the records as extra rows that carry
    nothing else, so one grouped aggregate finishes both without a join. With `many` groups their records are gathered first.
    """
    rows = moment_inputs(events, options).select(*by, *SUMS, "duration", *MOMENTS, "stage", "risk", "_n")
    ported = "ports" in events.columns
    members = events.select(*by, "ports") if ported else None
    if many:
        rows, members = gathered(rows, by), gathered(members, by) if ported else None
    rows = with_port_rows(rows, port_masks(members, by) if ported else None, by)
    moments = [F.expr(f"{call}({name}) AS {name}_{part}") for name in MOMENTS
               for call, part in (("avg", "a"), ("var_pop", "v"), ("max", "x"))]
    return finish(rows.groupBy(*by).agg(*_plain_aggregates(ported), *moments), by, options)


def features_array(table: DataFrame, name: str = "features") -> DataFrame:
    """Pack the 24 feature columns into one ARRAY<DOUBLE>."""
    return table.withColumn(name, F.array(*FEATURES)).drop(*FEATURES)


def features_columns(table: DataFrame, name: str = "features") -> DataFrame:
    """Unpack an ARRAY<DOUBLE> of features into named columns."""
    return table.withColumns({f: F.col(name)[i] for i, f in enumerate(FEATURES)}).drop(name)
