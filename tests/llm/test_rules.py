"""Text statistics against plain Python, and rules learned by sequential covering."""

import re
from collections import Counter

import numpy as np
import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewatch.llm import rules as R
from tidewatch.llm.text import utf8_slices

W = re.compile("[^\x20\x09-\x0D]+")


def plain(text):
    words = W.findall(text or "")
    grams = [tuple(words[k:k + 8]) for k in range(len(words) - 7)]
    often = Counter(grams)
    covered = {k + j for k, g in enumerate(grams) if often[g] > 1 for j in range(8)}
    lines = [line for line in (text or "").split("\n") if W.search(line)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered))


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab é#\n\r\t日|", max_size=80)), max_size=6))
def test_base_statistics(texts):
    import pyarrow as pa

    got = []
    for _, _, data, offsets in utf8_slices(pa.array(texts, pa.string()), 50):
        found = R.slice_statistics(data, offsets)
        got += list(zip(*(found[c].tolist() for c in R.BASE)))
    assert got == [plain(t) for t in texts]


def test_table(spark):
    repeated = " ".join(f"w{k}" for k in range(12))
    texts = [None, "", "one", f"{repeated} x {repeated}", "line\nline\n \nline", "w " * 200_000]
    df = spark.createDataFrame([(None if k == 1 else k, t, 5) for k, t in enumerate(texts)], "doc_id long, text string, n_words int")
    rows = R.text_statistics(df).collect()
    assert sorted(tuple(r[c] for c in R.BASE) for r in rows) == sorted(plain(t) for t in texts)
    assert R.text_statistics(df.limit(0)).count() == 0
    out = R.apply(R.text_statistics(df), R.DecisionList((), 1)).where(F.col("base_failed")).count()
    assert out == 6


def sample(n=600):
    rng = np.random.default_rng(4)
    frame = pd.DataFrame({c: rng.integers(50, 200, n) for c in (*R.BASE, *R.MORE)})
    frame["n_words"] = 200
    symbols = frame["n_symbols"] / frame["n_words"]
    ends = frame["n_ends"] / frame["n_words"]
    frame["label"] = (~((symbols > 0.8) & (ends <= 0.5))).astype(int)
    return frame


def test_a_planted_rule_is_found():
    frame = sample()
    found = R.learn(frame)
    assert found.default == 1 and found.rules and all(r.verdict == 0 for r in found.rules)
    assert {c[0] for r in found.rules for c in r.conditions} == {"symbols_per_word", "ends_per_word"}
    assert R.learn(frame) == found


def test_rules_become_one_ordered_expression(spark):
    frame = sample()
    found = R.learn(frame)
    got = spark.createDataFrame(frame).withColumn("v", found.verdict()).toPandas()
    assert (got["v"] == got["label"]).mean() > 0.98


def test_samples_without_two_labels_give_no_rules():
    frame = sample()
    assert R.learn(frame.iloc[:0]) == R.DecisionList((), 1)
    assert R.learn(frame.assign(label=0)) == R.DecisionList((), 0)


def test_labels_that_repeat_or_miss(spark):
    statistics = R.text_statistics(spark.createDataFrame([(k, "good words here " * 9) for k in range(40)], "doc_id long, text string"))
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, None), (None, 0), (99, 0), (3, 7)], "doc_id long, label int")
    assert R.learn_from(statistics, labels) == R.DecisionList((), 1)
