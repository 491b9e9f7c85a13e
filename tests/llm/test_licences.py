"""Licence scans against plain search, and expressions against a recursive parser."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tidewatch.llm import licences as L
from tidewatch.llm.queries import op13_licences

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))


def places(text, phrases):
    found = words(text)
    return sorted((k, k + len(p.split()), p) for p in phrases for k in range(len(found)) if found[k:k + len(p.split())] == p.split())


def random_texts(n):
    rng = random.Random(8)
    parts = ["cc", "by", "CC-BY", "nc", "GENERAL", "public", "License", "licence", "all", "rights", "reserved", "All Rights\nReserved", "é", "version 2.0", "mit license",
             "general public license", "\x00", "ßcc", "by", "spdx-license-identifier:", "MIT", "OR", "(", ")", "and", "\n", "apache-2.0", "with", "zzz", "İcc by", "Kcc"]
    return [rng.choice(["", " ", ". "]).join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(n)]


ODD = [None, "", " ", "cc", "cc by", "cc by cc by", "CC\x00BY", "all rights reserved." * 3_000, "x" * 100_000 + " cc by", "all rights", "日本cc by", "cc by", "a " * 50_000 + "cc by"]


def test_places_equal_plain_search(spark):
    texts = ODD + random_texts(400)
    df = spark.createDataFrame([(k if k % 9 else None, t, "x") for k, t in enumerate(texts)], "doc_id int, text string, labels string")
    out = L.licence_places(df.coalesce(1)).collect()
    assert len(out) == len(texts)
    for row, text in zip(out, texts):
        assert row.n_words == len(words(text))
        got = sorted((p.first_word, p.end_word, p.label) for p in row.places if p.kind == "base")
        assert got == sorted((a, b, L.BASE[p]) for a, b, p in places(text, L.BASE))
        got = sorted((p.first_word, p.end_word, p.label) for p in row.places if p.kind == "notice")
        assert got == sorted((a, b, L.NOTICES[p][0]) for a, b, p in places(text, L.NOTICES))
    assert L.licence_places(df.limit(0)).count() == 0


def test_the_query_s_rows(spark, tmp_path):
    texts = ODD + random_texts(60)
    spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    for row in op13_licences(spark, str(tmp_path)).collect():
        base = places(texts[row.doc_id], L.BASE)
        labels = sorted({L.BASE[p] for _, _, p in base})
        assert (row.n_words, row.n_base, row.base_labels) == (len(words(texts[row.doc_id])), len(base), ",".join(labels))
        assert (row.first_word, row.last_word) == ((base[0][0], base[-1][0]) if base else (None, None))
        assert set(labels) <= set(row.labels.split(",")) and row.labels.split(",") == sorted(set(row.labels.split(",")))
        assert 0 <= row.score <= 1 and (row.score > 0) == (row.labels != "")


def nested(rng, depth=0):
    """A random expression and its (freedom, labels) by recursion."""
    if depth > 3 or rng.random() < 0.3:
        name = rng.choice(["MIT", "Apache-2.0", "GPL-3.0-only", "LGPL-2.1", "Strange-1.0", "CC-BY-NC-4.0"])
        known = L.family(name)
        return name, L.KNOWN[known] if known else L.UNKNOWN, [name.lower()], 4
    kind = rng.choice(["OR", "AND", "WITH"])
    text, left, labels, binds = nested(rng, depth + 1)
    if kind == "WITH":
        text = text if binds == 4 else f"( {text} )"
        return f"{text} {rng.choice(['with', 'WITH'])} Some-exception", (1 + left) / 2, labels, 3
    level = {"OR": 1, "AND": 2}[kind]
    more, right, rest, tight = nested(rng, depth + 1)
    text = text if binds >= level else f"({text})"
    more = more if tight > level else f"({more})"
    return f"{text} {kind.lower()} {more}", (max if kind == "OR" else min)(left, right), labels + rest, level


def test_expressions_equal_a_recursive_parser():
    rng = random.Random(1)
    for _ in range(500):
        text, freedom, labels, _ = nested(rng)
        assert L.evaluate(L.postfix(L.tokens(text.encode()))) == (freedom, labels)
        for after in (" OR", " ) and", " plain words", ", and so on", " ("):
            assert L.evaluate(L.postfix(L.tokens((text + after).encode()), open_end=True)) == (freedom, labels), text + after


@pytest.mark.parametrize("line", ["", "OR MIT", "(MIT", "MIT OR", "MIT)", "MIT ISC", "()", "MIT AND (", "(MIT) (ISC)"])
def test_no_expressions(line):
    assert L.postfix(L.tokens(line.encode())) == []


def test_tags_and_evidence(spark):
    rows = [(1, "# SPDX-License-Identifier: (MIT OR GPL-2.0-only WITH Classpath-exception-2.0) AND LicenseRef-X\nOR ISC"),
            (2, "This is licensed under the terms of it. Licensed under the Apache License, Version 2.0."), (3, "SPDX-License-Identifier:"), (4, "nothing"),
            (5, "SPDX-License-Identifier: " + "(" * 5_000 + "MIT" + ")" * 5_000), (6, "SPDX-License-Identifier: " * 3_000)]
    found = L.licence_places(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r.doc_id: r for r in found.select("doc_id", L.label_list(F.col("places")).alias("labels"), L.freedom(F.col("places")).alias("freedom"),
                                             L.certainty(F.col("places")).alias("score")).collect()}
    assert got[1].labels == "gpl-2.0-only,licenseref-x,mit" and got[1].freedom == 0.1
    assert got[2].labels == "apache,apache-2.0" and got[2].freedom == 1.0
    assert got[3].labels == "" and got[3].score == 0 and got[4].labels == "" and got[5].labels == "mit" and got[5].freedom == 1.0
    assert 0 < got[2].score < 1
