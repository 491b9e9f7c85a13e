"""Conversation repair against all edits of small conversations and a chart with every span and split."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from tidewatch.llm import dialogue as D

SPACES = " \t\n\v\f\r"


def damage(rows, every=20):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        hit = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % every
        if hit == 0:
            continue
        role, text = "user" if hit == 4 else role, "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
        out += [(conv, turn, role, text)] * (2 if hit == 3 else 1)
    return out


def ordered(rows):
    return sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, hashlib.md5(f"{len(r[2])}:{r[2]}:{r[3]}".encode()).hexdigest()))


def faults(rows):
    """(initial, fault) of one conversation's ordered rows."""
    seen, out = set(), []
    for _, _, role, text in rows:
        end = text.rstrip(SPACES)[-1:]
        out.append((role[:1], "blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end not in ".!?" else ""))
        seen.add((role, text))
    return out


def every_edit(found):
    """The least (cost, audit) of all edit sequences with at most three insertions in one place."""
    legal = re.compile(r"(s?(ua)+)?$")
    layer = {"": (0, "")}  # role initials so far -> least

    def insert(layer):
        for _ in range(3):
            wider = dict(layer)
            for initials, (cost, audit) in layer.items():
                for role in "ua":
                    new = (cost + 2, audit + "I")
                    if re.match(r"s?(ua)*u?$", initials + role) and new < wider.get(initials + role, (10**9, "")):
                        wider[initials + role] = new
            layer = wider
        return layer

    for initial, fault in found:
        layer, after = insert(layer), {}
        for initials, (cost, audit) in layer.items():
            options = [("", 3, "D")]
            if fault not in ("blank", "duplicate"):
                extra = fault == "truncated"
                options += [(initial, extra, "K"), ("u", 2 + extra, "R"), ("a", 2 + extra, "R")]
            for role, more, edit in options:
                new, key = (cost + more, audit + edit), initials + role
                if (not role and edit == "D" or role and re.match(r"s?(ua)*u?$|s$", key)) and new < after.get(key, (10**9, "")):
                    after[key] = new
        layer = after
    return min(v for k, v in insert(layer).items() if legal.match(k))


def full_chart(codes):
    """CYK over every span and every split, spans by length."""
    n = len(codes)
    chart = {(i, i): D.insertions() for i in range(n + 1)}
    for i in range(n):
        chart[i, i + 1] = D.row_cell(codes[i])
    for length in range(2, n + 1):
        for i in range(n - length + 1):
            cells = [D.joined(chart[i, k], chart[k, i + length]) for k in range(i, i + length + 1) if 0 < k - i < length]
            chart[i, i + length] = {key: min(c[key] for c in cells if key in c) for key in set().union(*cells)}
    return chart[0, n]


def summary(rows):
    rows = ordered(rows)
    found = faults(rows)
    turns = [r[1] for r in rows if r[1] is not None]
    cost, audit = every_edit(found)
    lines = [f"{role}:{text}" for _, role, text in D.repairs(audit, iter((r[2], r[3]) for r in rows))]
    pairs = [a[0] + b[0] for a, b in itertools.pairwise(found)]
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(sum(f == k for _, f in found) for k in ("blank", "duplicate", "truncated")),
            sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def test_spans_equal_the_full_chart_and_all_edits():
    rng = random.Random(4)
    for trial in range(300):
        found = [(rng.choice("suat"), rng.choice(["", "", "", "blank", "duplicate", "truncated"])) for _ in range(rng.randint(0, 13))]
        codes = "".join(D.row_code(i, f in ("blank", "duplicate"), f == "truncated") for i, f in found)
        spans = D.Spans()
        for code in codes:
            spans.add_row(code)
        assert spans.cell() == full_chart(codes) if trial < 100 and codes else True
        cost, audit = D.cheapest(spans.cell())
        assert (cost, audit) == every_edit(found)
        kept = [i for i, _ in found]
        turns = list(D.repairs(audit, iter(({"s": "system", "u": "user", "a": "assistant", "t": "tool"}[i], "x") for i in kept)))
        assert re.fullmatch("(s?(ua)+)?", "".join(role[0] for _, role, _ in turns))


def test_repeated_cells():
    for code in "xuS":
        one = D.row_cell(code)
        whole = D.insertions()
        for times in range(1, 9):
            whole = D.joined(whole, one)
            assert D.repeated(one, times) == whole


def test_summary_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(D, "TURNS", 3)  # conversations of many segments
    rng = random.Random(6)
    rows = []
    for conv in [None, *range(60)]:
        for _ in range(rng.randint(1, 14)):
            turn = rng.choice([None, *range(-3, 12)]) if rng.random() < 0.3 else rng.randint(0, 12)
            role = rng.choice(["user", "assistant", "system", "tool", "", None, "user", "assistant", "usher"])
            text = rng.choice(["A word.", "cut", "", " \n", None, "Ends! ", "Odd. ", "Yes?", "é" * 50 + ".", "a:b.", f"{rng.random()}."])
            rows.append((conv, turn, role, text))
    rows += [(7, 5, "user", "again.")] * 40 + [(61, 0, "user", None)] + [(k, None, None, None) for k in range(90, 95)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id int, turn int, role string, text string, conv string, n int")
    hurt = D.damaged(df)
    out = D.repair_summary(hurt, df.selectExpr("conv_id AS conv")).collect()
    by = {}
    for row in damage(rows):
        by.setdefault(row[0], []).append(row)
    expected = {conv: summary(by.get(conv, [])) for conv in {r[0] for r in rows}}
    assert {r[0]: tuple(r[1:]) for r in out} == expected and len(out) == len(expected)


def test_one_long_conversation(spark):
    turns = [(k, f"{'user' if k % 2 == 0 else 'assistant'}", f"turn {k}.") for k in range(7_000) if k % 700 != 3]
    df = spark.createDataFrame(turns, "turn long, role string, text string").selectExpr("'one' AS conv", "*")
    row = D.repair_summary(df).first()
    assert (row.gaps, row.blank, row.duplicate, row.truncated, row.illegal) == (10, 0, 0, 0, 10)
    assert len(row.audit.replace("I", "")) == len(turns) and row.cost == 2 * row.audit.count("I") + 2 * row.audit.count("R") + 3 * row.audit.count("D")
    rows = list(D.repairs(row.audit, iter(t[1:] for t in turns)))
    assert re.fullmatch("(ua)+", "".join(r[1][0] for r in rows))


def test_no_rows(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert D.repair_summary(D.damaged(df), df.selectExpr("conv_id AS conv")).count() == 0
    named = spark.createDataFrame([(1,), (None,)], "conv long")
    out = D.repair_summary(D.damaged(df), named).collect()
    assert sorted((str(r[0]), *r[1:]) for r in out) == [(k, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for k in ("1", "None")]


@pytest.mark.parametrize("column", ["turn", "role", "text"])
def test_columns_of_nulls(spark, column):
    df = spark.createDataFrame([(1, k, "user", "A.") for k in range(4)], "conv long, turn long, role string, text string")
    df = df.selectExpr("conv", *[f"nullif({c}, {c}) AS {c}" if c == column else c for c in ("turn", "role", "text")])
    out = D.repair_summary(D.damaged(df, every=1_000_000_007, conv="conv")).first()
    rows = [(1, None if column == "turn" else k, " " if column == "role" else "user", " " if column == "text" else "A.") for k in range(4)]
    assert tuple(out[1:]) == summary(rows)
