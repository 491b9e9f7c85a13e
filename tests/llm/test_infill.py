"""Fill-in-the-middle against plain cutting, and the skip list against running totals."""

import hashlib
import random
import re

import numpy as np
import pytest

from tidewatch.llm import infill

UNITS = re.compile("[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
ODD = ["", None, " ", " \n\t ", "a", "  a", "a  ", "é日𠮷 x y z ", "a <P> b", "x<S>", "<M>", "<P <S <M", "< P><", "end <", "a\x0bb\x0cc\rd", "x" * 200_000,
       "w\n" * 60_000, " " * 5_000, "日本 " * 3_000]


def plain(row_id, text, seed=42, rate=50, spm=80, marks=infill.MARKS):
    text = text or ""
    units = UNITS.findall(text)
    digest = hashlib.sha256(f"{seed}:{'' if row_id is None else row_id}".encode()).hexdigest()
    h = [int(digest[8 * k:8 * k + 8], 16) for k in range(4)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    prefix, middle, suffix = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    p, s, m = marks
    if not text or any(x in text for x in marks) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, text
    if h[3] % 100 < spm:
        return len(units), "spm", len(prefix), len(middle), s + suffix + p + prefix + m + middle
    return len(units), "psm", len(prefix), len(middle), p + prefix + s + suffix + m + middle


@pytest.mark.parametrize("options", [{}, {"seed": 7, "rate": 100, "spm": 50}, {"rate": 100, "spm": 0, "marks": ("«p", "¤", "#'\\")}, {"rate": 0}])
def test_equals_plain_cutting_and_comes_back(spark, options):
    rng = random.Random(3)
    texts = ODD + ["".join(rng.choice("ab é日\n\t <PSM>") for _ in range(rng.randint(0, 60))) for _ in range(300)]
    rows = [(k if k % 11 else None, t, "psm", 5) for k, t in enumerate(texts)] + [(1, "twice over", "x", 0)] * 2
    df = spark.createDataFrame(rows, "`doc.id` long, `a text` string, form string, n int")
    out = infill.fill_in_middle(df, "doc.id", "a text", **options)
    out = out.withColumn("again", infill.restored("output", "form", options.get("marks", infill.MARKS)))
    got = sorted((str(r[0]), *map(str, r[1:])) for r in out.collect())
    assert got == sorted((str(i), *map(str, plain(i, t, **options)), str(t or "")) for i, t, _, _ in rows)
    assert infill.fill_in_middle(df.limit(0), "doc.id", "a text").count() == 0


def test_every_rank_of_a_skip_list():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 5, 17, 300, 5_000):
        chars = rng.integers(1, 9, n)
        lanes = infill.skip_list(chars)
        assert infill.descend(lanes, np.arange(n + 1)).tolist() == [0, *np.cumsum(chars).tolist()]
        for lane in lanes:  # every lane spans the whole list
            assert lane.units[:-1].sum() == n and lane.chars.sum() == chars.sum()
        if n == 5_000:
            assert len(lanes) > 4


def test_marks_that_could_be_mistaken_are_refused(spark):
    for marks in (("<P>", "<P>", "<M>"), ("aa", "b", "c"), ("", "b", "c"), ("ab", "ba", "c"), ("x", "xy", "z")):
        with pytest.raises(ValueError):
            infill.check_marks(marks)
