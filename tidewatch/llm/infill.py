"""Fill-in-the-middle: texts are cut at two unit ranks, found by descending an indexable skip list."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm.text import SPACE, mix, per_row, utf8_slices

MARKS = ("<P>", "<S>", "<M>")
_FAR = np.iinfo(np.int64).max // 2


@dataclass(frozen=True)
class Lane:
    """One lane: how many units and code points each node spans to the next one, and where it stands one lane lower.

    The last node ends the lane: it spans more units than any rank.
    """

    units: np.ndarray
    chars: np.ndarray
    down: np.ndarray


def unit_starts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, first byte) of every unit: a word with the white space before it, or white space that ends a text."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none
    space = SPACE[data]
    begins = np.zeros(len(data), bool)
    begins[1:] = space[1:] & ~space[:-1]
    begins[offsets[:-1][np.diff(offsets) > 0]] = True
    starts = np.flatnonzero(begins)
    return np.searchsorted(offsets, starts, "right") - 1, starts


def code_points(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Code points of each unit, which reaches to the next one."""
    return np.add.reduceat((data & 0xC0) != 0x80, starts, dtype=np.int64) if len(starts) else np.zeros(0, np.int64)


def skip_list(chars: np.ndarray) -> list[Lane]:
    """Lanes, lowest first, over units of the given code points; a node rises a lane with chance 1/4, the first always.

    Heights come from the units' places, so the list is the same whenever it is built.
    """
    n = len(chars)
    if not n:
        return []
    draws = mix(np.arange(n, dtype=np.uint64))
    draws[0] = 0
    lanes = [_lane(np.ones(n, np.int64), chars, np.arange(n))]
    at = np.arange(n)
    while len(at) > 4:
        rises = np.flatnonzero(draws[at] & np.uint64(3) == 0)
        draws >>= np.uint64(2)
        below, at = lanes[-1], at[rises]
        lanes.append(_lane(np.add.reduceat(below.units[:-1], rises), np.add.reduceat(below.chars[:-1], rises), rises))
    return lanes


def _lane(units: np.ndarray, chars: np.ndarray, down: np.ndarray) -> Lane:
    last = down[-1] + 1 if len(down) else 0
    return Lane(np.append(units, _FAR), np.append(chars, 0), np.append(down, last))


def descend(lanes: Sequence[Lane], ranks: np.ndarray) -> np.ndarray:
    """Code points before each rank: along a lane while the units passed don't exceed the rank, then down."""
    node, passed, chars = (np.zeros(len(ranks), np.int64) for _ in range(3))
    for k in range(len(lanes) - 1, -1, -1):
        lane, going = lanes[k], np.arange(len(ranks))
        while len(going):
            going = going[passed[going] + lane.units[node[going]] <= ranks[going]]
            passed[going] += lane.units[node[going]]
            chars[going] += lane.chars[node[going]]
            node[going] += 1
        if k:
            ends = node == len(lane.units) - 1
            node = np.where(ends, len(lanes[k - 1].units) - 1, lane.down[node])
    return chars


def cuts(texts: pa.Array, draw1: np.ndarray, draw2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(units, code points before the first cut, and between the cuts) of whole texts.

    The units of a slice's texts stand in one skip list, one text after another; a cut after r units of a text is the
    rank r beyond the text's first unit. A cut is its draw modulo units + 1.
    """
    n, prefix, middle = (np.zeros(len(texts), np.int64) for _ in range(3))
    for row, end, data, offsets in utf8_slices(texts):
        rows, starts = unit_starts(data, offsets)
        units = per_row(rows, end - row)
        lanes = skip_list(code_points(data, starts))
        first = np.cumsum(units) - units
        one, two = (first + draw[row:end] % (units + 1) for draw in (draw1, draw2))
        at, one, two = (descend(lanes, rank) for rank in (first, np.minimum(one, two), np.maximum(one, two)))
        n[row:end], prefix[row:end], middle[row:end] = units, one - at, two - one
    return n, prefix, middle


@F.arrow_udf(T.StructType([T.StructField(name, T.LongType()) for name in ("n", "prefix", "middle")]))
def _cuts(text: pa.Array, draw1: pa.Array, draw2: pa.Array) -> pa.Array:
    found = cuts(text, *(d.to_numpy(zero_copy_only=False) for d in (draw1, draw2)))
    return pa.StructArray.from_arrays([pa.array(x) for x in found], names=["n", "prefix", "middle"])


def _draw(digest: Column, k: int) -> Column:
    """The k-th 8-digit group of a hex digest as an unsigned integer."""
    return F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")


def fill_in_middle(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", seed: int = 42, rate: int = 50,
                   spm: int = 80, marks: Sequence[str] = MARKS) -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output) of every row: its text with the middle moved to the end.

    A text is cut into units (words with the white space before them; white space at the end is one more), and two
    draws from the SHA-256 of `seed:id` choose the ranks of both cuts, 0 to n units. `rate` of 100 texts are
    transformed, `spm` of 100 of those with the suffix first. `form` is psm, spm or plain; plain texts stay as they are and
    have no prefix_chars and middle_chars. Lengths are code points. A text that contains a mark stays plain, so `restored` gives
    every text back.

    Null texts are empty, and empty texts are plain with n = 0. A null id draws as an empty one. Rows with the same id and
    text give the same output, repeated rows stay repeated. Other columns aren't read, so their names can't clash.
    Texts go to Python once; whatever their length, only three numbers come back and the JVM cuts them.
    """
    check_marks(marks)
    text = F.coalesce(F.col("text"), F.lit(""))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    drawn = docs.select(F.col(_name(id_column)).alias("id"), F.col(_name(text_column)).alias("text")) \
        .select("id", text.alias("text"), *[_draw(digest, k).alias(f"h{k + 1}") for k in range(4)])
    cut = drawn.select("id", "text", "h3", "h4", _cuts("text", "h1", "h2").alias("cut"))
    marked = F.lit(False)
    for mark in marks:
        marked = marked | F.contains("text", F.lit(mark))
    form = F.when((F.col("text") == "") | marked | (F.col("h3") % 100 >= rate), "plain") \
        .when(F.col("h4") % 100 < spm, "spm").otherwise("psm")
    formed = cut.select("id", "text", F.col("cut.n").alias("n"), form.alias("form"), F.col("cut.prefix").alias("p"),
                        F.col("cut.middle").alias("m"))
    p, s, m = (F.lit(mark) for mark in marks)
    one, two = F.col("p").cast("int"), F.col("m").cast("int")
    prefix, middle = F.substring("text", F.lit(1), one), F.substring("text", one + 1, two)
    suffix = F.substring("text", one + two + 1, F.lit(2**31 - 1))
    plain = F.col("form") == "plain"
    output = F.when(plain, F.col("text")).when(F.col("form") == "psm", F.concat(p, prefix, s, suffix, m, middle)) \
        .otherwise(F.concat(s, suffix, p, prefix, m, middle))
    return formed.select(F.col("id").alias(id_column), "n", "form", F.when(~plain, F.col("p")).alias("prefix_chars"),
                         F.when(~plain, F.col("m")).alias("middle_chars"), output.alias("output"))


def restored(output: str, form: str, marks: Sequence[str] = MARKS) -> Column:
    """The exact text from an `output` column and its `form`; null where either is null."""
    p, s, m = marks
    text = _name(output)
    at = f"instr({text}, {_literal(m)})"
    first, second = (f"if(form_ = 'psm', {_literal(x)}, {_literal(y)})" for x, y in ((p, s), (s, p)))
    head = f"substring({text}, length({first}) + 1, {at} - 1 - length({first}))"
    left = f"substring({head}, 1, instr({head}, {second}) - 1)"
    right = f"substring({head}, instr({head}, {second}) + length({second}))"
    middle = f"substring({text}, {at} + {len(m)})"
    whole = f"if(form_ = 'psm', concat({left}, {middle}, {right}), concat({right}, {middle}, {left}))"
    return F.expr(f"if(form_ = 'plain', {text}, {whole})".replace("form_", _name(form)))


def check_marks(marks: Sequence[str]) -> None:
    """Marks can be told apart in any text that contains none: their first character occurs nowhere else in them."""
    p, s, m = marks
    if not all(marks) or len({p, s, m}) < 3 or any(x[0] in y[1:] for x in marks for y in marks) \
            or any(x != y and x.startswith(y) for x in marks for y in marks):
        raise ValueError("marks must be three different texts, none the beginning of another, whose first characters stand first only")


def _name(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"
