"""Conversation repair: the cheapest edits that make turns alternate, by weighted CYK parsing of spans.

A repaired conversation's role initials match `(s?(ua)+)?`. The pattern has four places: at its start (0), after the s (1),
after a u (2), after an a (3). The grammar is in Chomsky normal form: a nonterminal is a pair of places, N(p,r) -> N(p,q) N(q,r)
joins spans, N(p,q) -> edit repairs one row, and inserted turns join places over an empty span. A cell holds the least
(cost, audit) of each nonterminal; cells grow bottom-up by span length. Nonterminals name both places where they border, so every
split of a span gives the same cell, and one split of each span is enough. Least audits of equal cost are never
beginnings of one another (each further letter without a row is an insertion, which costs), so least parts make least wholes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.numbers import int_div
from tidewatch.session import discard, staged

# The places of the pattern and which initial leads from one to another.
STEPS = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("a", 2): 3, ("u", 3): 2}
ENDS = (0, 3)
RIGHT_PAIRS = {"su", "ua", "au"}
ROLES = {"u": "user", "a": "assistant"}
INSERT, REROLE, DELETE = 2, 2, 3
TURNS = 1_024  # turns of a segment
SHORT = 8  # rows of the spans whose cells are remembered
SPACES = " \t\n\v\f\r"

Cell = dict[tuple[int, int], tuple[int, str]]


def joined(left: Cell, right: Cell) -> Cell:
    """The cell of two neighbouring spans."""
    out: Cell = {}
    for (p, q), (cost, audit) in left.items():
        for (at, r), (more, rest) in right.items():
            if at == q:
                total = cost + more
                known = out.get((p, r))
                if known is None or total < known[0] or total == known[0] and audit + rest < known[1]:
                    out[p, r] = (total, audit + rest)
    return out


@lru_cache(1)
def insertions() -> Cell:
    """The cell of an empty span: nothing, or inserted turns."""
    once: Cell = {(p, p): (0, "") for p in range(4)}
    once |= {(p, q): (INSERT, "I") for (initial, p), q in STEPS.items() if initial in ROLES}
    cell = once
    while (wider := joined(cell, once)) != cell:
        cell = wider
    return cell


def row_code(initial: str, faulty: bool, cut: bool) -> str:
    """One letter for what a row's cell depends on: x goes; else its initial (? for others), upper case where it is cut."""
    if faulty:
        return "x"
    code = initial if initial in ("s", "u", "a") else "?"
    return {"?": "!"}.get(code, code.upper()) if cut else code


@lru_cache(16)
def row_cell(code: str) -> Cell:
    """The cell of one row with the insertions around it; a faulty row goes, one that is cut costs 1 unless it goes."""
    edits: Cell = {(p, p): (DELETE, "D") for p in range(4)}
    if code != "x":
        cut = code in "SUA!"
        edits |= {(p, q): (REROLE + cut, "R") for (to, p), q in STEPS.items() if to in ROLES}
        edits |= {(p, q): (int(cut), "K") for (to, p), q in STEPS.items() if to == code.lower()}
    return joined(joined(insertions(), edits), insertions())


@lru_cache(1 << 16)
def span_cell(codes: str) -> Cell:
    """The cell of a short span of rows; the same few spans come again and again."""
    half = len(codes) // 2
    return joined(span_cell(codes[:half]), span_cell(codes[half:])) if half else row_cell(codes)


def repeated(cell: Cell, times: int) -> Cell:
    """The cell of `times` equal rows."""
    out = insertions()
    while times:
        out = joined(out, cell) if times & 1 else out
        times >>= 1
        cell = joined(cell, cell) if times else cell
    return out


class Spans:
    """Cells of spans that lie side by side, each longer than the next; equal lengths are joined as they come.

    What is held at once is a cell for each power of two, and one letter per row in its audits.
    """

    def __init__(self) -> None:
        self.open: list[tuple[int, Cell]] = []
        self.codes = ""

    def add_row(self, code: str) -> None:
        self.codes += code
        if len(self.codes) == SHORT:
            self.flush()

    def flush(self) -> None:
        codes, self.codes = self.codes, ""
        if codes:
            self.add(span_cell(codes), len(codes))

    def add(self, cell: Cell, length: int) -> None:
        self.flush()
        while self.open and self.open[-1][0] <= length:
            size, left = self.open.pop()
            cell, length = joined(left, cell), size + length
        self.open.append((length, cell))

    def cell(self) -> Cell:
        self.flush()
        out = None
        for _, left in reversed(self.open):
            out = joined(left, out) if out else left
        return out or insertions()


def cheapest(cell: Cell) -> tuple[int, str]:
    return min(cell[0, q] for q in ENDS if (0, q) in cell)


def repairs(audit: str, roles: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of the repaired turns; `roles` are the (role, text) of the rows in order."""
    place = 0
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(roles)
        if edit == "D":
            continue
        if edit != "K":
            role = ROLES["a" if place == 2 else "u"]
        place = STEPS[role[:1], place]
        yield edit, role, text


# --- on Spark -------------------------------------------------------------------------------

def _keyed(conversations: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv, turn, role, text), nulls of role and text as one space."""
    def one(name, alias):
        return F.col("`" + name.replace("`", "``") + "`").alias(alias)

    rows = conversations.select(one(conv, "conv"), one(turn, "turn"), one(role, "role"), one(text, "text"))
    return rows.withColumns({"turn": F.col("turn").cast("long"), "role": F.coalesce("role", F.lit(" ")), "text": F.coalesce("text", F.lit(" "))})


def damaged(conversations: DataFrame, every: int = 20, conv: str = "conv_id", turn: str = "turn", role: str = "role",
            text: str = "text") -> DataFrame:
    """(conv, turn, role, text) with faults put in by the CRC-32 of `conv:turn` modulo `every`.

    0 drops the row, 1 empties its text, 2 removes `.`, `!` and `?` from it, 3 repeats the row, 4 sets role user. Null cells are one space
    in texts, roles and the checksum; a null turn stays null. Other columns aren't read.
    """
    rows = _keyed(conversations, conv, turn, role, text)
    key = F.concat(*[F.coalesce(F.col(c).cast("string"), F.lit(" ")) if c else F.lit(":") for c in ("conv", "", "turn")])
    hit = rows.withColumn("hit", F.pmod(F.crc32(key), F.lit(every))).where("hit <> 0")
    changed = hit.select("conv", "turn", F.when(F.col("hit") == 4, "user").otherwise(F.col("role")).alias("role"),
                         F.when(F.col("hit") == 1, "").when(F.col("hit") == 2, F.translate("text", ".!?", ""))
                         .otherwise(F.col("text")).alias("text"),
                         F.explode(F.when(F.col("hit") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))
    return changed.drop("copy")


def _block() -> Column:
    return int_div(F.col("turn"), TURNS)


def flagged_rows(rows: DataFrame) -> DataFrame:
    """Narrow rows, equal ones counted: (conv, block, turn, role, mark, n, blank, duplicate, cut).

    `mark` stands for role and text (MD5). Text is read here and not carried on. `duplicate` says that an earlier turn had the same
    role and text. All but one of `n` equal rows are duplicates in any case.
    """
    last = F.substring(F.rtrim(F.col("text"), F.lit(SPACES)), -1, 1)
    seen = rows.select("conv", "turn", "role", F.md5(F.concat_ws(":", F.length("role").cast("string"), "role", "text")).alias("mark"),
                       (last == "").alias("blank"), (~last.isin(".", "!", "?")).alias("cut"))
    equal = staged(seen.groupBy("conv", "turn", "mark").agg(
        F.count("*").alias("n"), F.first("role").alias("role"), F.first("blank").alias("blank"), F.first("cut").alias("cut")))
    place = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    again = equal.where("not blank").groupBy("conv", "mark").agg(F.min(place).alias("first"), F.count("*").alias("turns")).where("turns > 1") \
        .select(F.col("conv").alias("c"), F.col("mark").alias("k"), "first")
    found = equal.join(again, F.col("conv").eqNullSafe(F.col("c")) & (F.col("mark") == F.col("k")), "left")
    out = found.select("conv", _block().alias("block"), "turn", F.substring("role", 1, 1).alias("initial"), "role", "mark", "n", "blank",
                       (F.col("first").isNotNull() & (F.col("first") < place)).alias("duplicate"), "cut")
    out._staged = equal
    return out


_COUNTS = ("rows", "turns", "blank", "duplicate", "truncated", "illegal")
_CELL = "cell array<struct<p:int,q:int,cost:long,audit:string>>"
_PART = "low long, high long, first string, last string, " + ", ".join(f"{c} long" for c in _COUNTS)


def _groups(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """Runs of rows with equal first `width` cells, streamed; each run must be read to its end."""
    def rows():
        for batch in batches:
            yield from zip(*[column.to_pylist() for column in batch.columns])

    stream = rows()
    row = next(stream, None)
    while row is not None:
        key = row[:width]

        def run():
            nonlocal row
            while row is not None and row[:width] == key:
                yield row[width:]
                row = next(stream, None)

        yield key, run()


def _written(rows: Iterator[tuple], schema: pa.Schema, at_once: int = 2_048, letters: int = 1 << 24) -> Iterator[pa.RecordBatch]:
    """Rows as batches, cut by number and by the length of their texts."""
    held, size = [], 0

    def batch():
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)

    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, str))
        if len(held) >= at_once or size > letters:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def _cells(cell: Cell) -> list[dict]:
    return [{"p": p, "q": q, "cost": cost, "audit": audit} for (p, q), (cost, audit) in cell.items()]


def _arrow(fields: str, key: pa.DataType) -> pa.Schema:
    """The Arrow schema of "name type, ..." after the key column."""
    kinds = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "int": pa.int32()}
    cell = pa.list_(pa.struct([("p", pa.int32()), ("q", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
    out = [pa.field("conv", key)]
    for field in fields.replace(_CELL, "cell cells").split(", "):
        name, kind = field.split(" ")
        out.append(pa.field(name, cell if kind == "cells" else kinds[kind]))
    return pa.schema(out)


def _segment(rows: Iterator[tuple]) -> tuple:
    """Counts and cell of one segment's ordered rows (turn, mark, initial, n, blank, duplicate, cut)."""
    spans, low, high, first, last = Spans(), None, None, None, None
    count = dict.fromkeys(_COUNTS, 0)
    for turn, _, initial, n, blank, duplicate, cut in rows:
        if turn is not None and turn != high:
            low, high, count["turns"] = turn if low is None else low, turn, count["turns"] + 1
        count["illegal"] += n - 1 + (last is not None and last + initial not in RIGHT_PAIRS)
        first, last = initial if first is None else first, initial
        count["rows"] += n
        if blank:
            count["blank"] += n
        else:
            count["duplicate"] += n - (not duplicate)
            count["truncated"] += cut and not duplicate
        spans.add_row(row_code(initial, blank or duplicate, cut))
        if n > 1:
            spans.add(repeated(row_cell("x"), n - 1), n - 1)
    return low, high, first, last, *count.values(), spans.cell()


def parsed(flagged: DataFrame) -> DataFrame:
    """One row per conversation: counts, cost and audit of its cheapest repair.

    Rows are parsed in segments of 1,024 turns each, then segments are joined in order. A long conversation is spread over many tasks; of it
    only one letter per row and nonterminal meets in one.
    """
    kind = flagged.schema["conv"].dataType.simpleString()
    order = ["conv", "block", "turn", "mark"]
    rows = flagged.select("conv", "block", "turn", "mark", "initial", "n", "blank", "duplicate", "cut")

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = iter(batches)
        first = next(batches, None)
        if first is None:
            return
        schema = _arrow(f"block long, {_PART}, {_CELL}", first.schema.field(0).type)

        def out():
            for (conv, block), run in _groups(_again(first, batches), 2):
                *part, cell = _segment(run)
                yield conv, block, *part, _cells(cell)

        yield from _written(out(), schema)

    def conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = iter(batches)
        first = next(batches, None)
        if first is None:
            return
        schema = _arrow(_SUMMARY, first.schema.field(0).type)
        yield from _written(((conv, *_whole(run)) for (conv,), run in _groups(_again(first, batches), 1)), schema)

    parts = rows.repartition("conv", "block").sortWithinPartitions(*order).mapInArrow(segments, f"conv {kind}, block long, {_PART}, {_CELL}")
    return parts.repartition("conv").sortWithinPartitions("conv", "block").mapInArrow(conversations, f"conv {kind}, {_SUMMARY}")


_SUMMARY = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _again(first: pa.RecordBatch, rest: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield first
    yield from rest


def _whole(segments: Iterator[tuple]) -> tuple:
    """The summary of a conversation from its segments in order."""
    spans, low, high, last = Spans(), None, None, None
    total = dict.fromkeys(_COUNTS, 0)
    for _, bottom, top, first, end, *rest in segments:
        *counts, cell = rest
        if last is not None:
            total["illegal"] += last + first not in RIGHT_PAIRS
        last = end
        if bottom is not None:
            low, high = bottom if low is None else low, top
        for name, value in zip(_COUNTS, counts):
            total[name] += value
        spans.add({(c["p"], c["q"]): (c["cost"], c["audit"]) for c in cell}, counts[0])
    cost, audit = cheapest(spans.cell())
    gaps = min(high - low + 1 - total["turns"], 2**63 - 1) if low is not None else 0
    return gaps, *(total[c] for c in ("blank", "duplicate", "truncated", "illegal")), cost, audit


def repaired_turns(rows: DataFrame, summary: DataFrame) -> DataFrame:
    """(conv, place, edit, role, text) of the repaired conversations, from the damaged rows and `parsed`'s audits.

    Each conversation's audit comes before its rows, which stream by in order: a task holds one batch and one audit. Rows of a
    conversation leave in order of `place`, from 0, in one partition.
    """
    kind = rows.schema["conv"].dataType.simpleString()
    mark = F.md5(F.concat_ws(":", F.length("role").cast("string"), "role", "text"))
    null = F.lit(None)
    both = rows.select("conv", F.lit(1).alias("line"), "turn", mark.alias("mark"), "role", "text").unionByName(
        summary.select("conv", F.lit(0).alias("line"), null.cast("long").alias("turn"), null.cast("string").alias("mark"),
                       null.cast("string").alias("role"), F.col("audit").alias("text")))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = iter(batches)
        first = next(batches, None)
        if first is None:
            return
        schema = _arrow("place long, edit string, role string, text string", first.schema.field(0).type)

        def out():
            for (conv,), run in _groups(_again(first, batches), 1):
                audit = next(run)[-1]
                turns = (r[-2:] for r in run)
                for place, turn in enumerate(repairs(audit, turns)):
                    yield conv, place, *turn
                for _ in run:
                    pass

        yield from _written(out(), schema)

    return both.repartition("conv").sortWithinPartitions("conv", "line", "turn", "mark") \
        .mapInArrow(apply, f"conv {kind}, place long, edit string, role string, text string")


def _digests(turns: DataFrame) -> DataFrame:
    """(conv, repaired_sha256) of conversations whose turns stand in order within a partition."""
    kind = turns.schema["conv"].dataType.simpleString()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = iter(batches)
        first = next(batches, None)
        if first is None:
            return
        schema = _arrow("repaired_sha256 string", first.schema.field(0).type)

        def out():
            for (conv,), run in _groups(_again(first, batches), 1):
                state = hashlib.sha256()
                for place, _, role, text in run:
                    state.update(f"{chr(10) if place else ''}{role}:{text}".encode())
                yield conv, state.hexdigest()

        yield from _written(out(), schema)

    return turns.mapInArrow(digest, f"conv {kind}, repaired_sha256 string")


def repair_summary(rows: DataFrame, every: DataFrame | None = None) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conversation.

    `rows` have conv, turn, role and text, as `damaged` returns them; `every` may name further conversations (conv) that have no rows: zeros,
    an empty audit, the hash of nothing. Rows go by turn, null turns first; within a turn by the MD5 of role and text, so equal rows stand
    side by side. A null conv is a conversation of its own. A row's first fault counts: blank (white space only), duplicate (role and text
    stood earlier), truncated (no `.`, `!` or `?` at its end). Roles are told by their first letter; an empty role has none and is
    kept nowhere. Other columns aren't read.

    Equal rows are counted before anything is shuffled by conversation, and texts are shuffled once, to be hashed: SHA-256 of a conversation is
    sequential, so one task streams it, holding a batch. The audit of a conversation, a letter per row, must fit in memory eleven times over.
    """
    flagged = flagged_rows(rows)
    summary = staged(parsed(flagged))
    digests = _digests(repaired_turns(rows, summary))
    known = summary.join(digests.withColumnRenamed("conv", "c"), F.col("conv").eqNullSafe(F.col("c")), "left").drop("c")
    names = every.select("conv").distinct() if every is not None else summary.select("conv")
    whole = names.select(F.col("conv").alias("name")).join(known, F.col("name").eqNullSafe(F.col("conv")), "left")
    zero, none = F.lit(0).cast("long"), F.sha2(F.lit("").cast("binary"), 256)
    out = whole.select(F.col("name").alias("conv"), *[F.coalesce(c, zero).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
                       F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", none).alias("repaired_sha256"))
    discard(flagged._staged)
    return out
