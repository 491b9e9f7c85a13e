"""Language ID and the factorisation machine: odd rows, identities, held-out accuracy on the given tables."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewatch.llm import langid, quality

SF = "/root/testdata/sf0.01"
ODD = [(None, None, None), (1, "", "en"), (2, "1234 !!", None), (2, "1234 !!", None), (3, "the and of", "en"), (4, "é" * 5000, "fr"), (5, "日本語", None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def model(docs):
    return langid.learn(docs.where(~langid.is_held_out(F.col("doc_id"))))


def test_languages_of_held_out_documents(docs, model):
    told = langid.identify(docs.where(langid.is_held_out(F.col("doc_id"))), model, "doc_id", "lang").toPandas()
    assert (told["lang"] == told["lang_pred"]).mean() > 0.97 and told["score"].between(0, 1).all()


def test_unknown_words_back_off_to_n_grams(docs, model, spark):
    texts = [(1, "enlichkeitschungen gebeverberheiten"), (2, "ouèrequementelleaux réentelle"), (3, "thereingtionbleingand")]
    told = {r.doc_id: r.lang_pred for r in langid.identify(spark.createDataFrame(texts, "doc_id long, text string"), model, "doc_id").collect()}
    assert told == {1: "de", 2: "fr", 3: "en"}
    data = np.frombuffer("thereingtionbleingand".encode(), np.uint8)
    hashes = langid.span_hashes(data, np.array([0]), np.array([len(data)]))
    assert not model.look_up(0, hashes)[0].any()


def test_odd_texts(spark, model):
    df = spark.createDataFrame(ODD, "doc_id long, text string, score string")
    rows = langid.identify(df, model, "doc_id", "text").collect()
    assert len(rows) == len(ODD)
    for r in rows:
        und = not r.text or r.text[0] == "1"
        assert (r.lang_pred == "und") == und and (r.score == 0) == und and (und or r.lang_pred in model.languages)
    assert langid.identify(df.limit(0), model, "doc_id").count() == 0


def test_nothing_to_learn_from(spark):
    empty = langid.learn(spark.createDataFrame([(1, None, "en"), (2, "text", None)], "doc_id long, text string, lang string"))
    assert empty.languages == ()
    df = spark.createDataFrame([(1, "text")], "doc_id long, text string")
    assert [(r.lang_pred, r.score) for r in langid.identify(df, empty, "doc_id").collect()] == [("und", 0.0)]


def test_stage_keeps_columns_of_any_name(spark, docs):
    some = docs.withColumn("score", F.lit("x")).withColumn("lang_pred", F.lit(1))
    kept = langid.with_known_language(some)
    assert kept.columns == some.columns and kept.count() > 0.97 * docs.count()


def test_n_grams_of_words():
    data = np.frombuffer("añb c".encode(), np.uint8)
    points, bounds = langid._points(data, np.array([0, 5]), np.array([4, 6]))
    assert "".join(map(chr, points)) == "\x01añb\x01\x01c\x01" and bounds.tolist() == [0, 5, 8]
    assert [np.bincount(langid._grams(points, bounds, n)[0], minlength=2).tolist() for n in (1, 2, 3, 5)] == [[3, 1], [4, 2], [3, 1], [1, 0]]


def test_sum_of_squares_identity():
    rng = np.random.default_rng(1)
    m = quality.FactorisationMachine(0.3, rng.normal(size=20), rng.normal(size=(20, 3)), np.zeros(1), np.ones(1))
    index, value = rng.choice(20, 7, replace=False), rng.normal(size=7)
    pairs = sum(m.factors[index[i]] @ m.factors[index[j]] * value[i] * value[j] for i in range(7) for j in range(i))
    assert m.raw(np.zeros(7, int), index, value, 1)[0] == pytest.approx(0.3 + m.weights[index] @ value + pairs)


def test_interactions_are_learned():
    rng = np.random.default_rng(2)
    a, b = rng.random(1500) < 0.5, rng.random(1500) < 0.5
    documents = [np.array([1 + x, 3 + y]) for x, y in zip(a, b)]
    statistics = np.zeros((1500, len(quality.STATISTICS)))
    y = (a ^ b).astype(float)
    m = quality.fit(documents, statistics, y, epochs=40)
    rows, index, value = quality._joined((np.repeat(np.arange(1500), 2), np.concatenate(documents)), statistics)
    assert (((m.raw(rows, index, value, 1500)) > 0) == (y > 0)).mean() > 0.95


def test_quality_of_held_out_documents(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    machine = quality.learn(docs, labels)
    told = quality.scores(docs, machine, "doc_id").join(labels, "doc_id").where(langid.is_held_out(F.col("doc_id"))).toPandas()
    good, bad = told[told["label"] == 1], told[told["label"] == 0]
    assert (good["predicted"] == 1).mean() > 0.97 and (bad["predicted"] == 0).mean() > 0.6
    kept = quality.good_documents(docs.withColumn("score", F.lit(1)).withColumn("label", F.lit("z")), labels)
    assert kept.columns == [*docs.columns, "score", "label"]


def test_odd_documents_are_scored(spark):
    df = spark.createDataFrame([(i, t, None if k % 2 else 5) for k, (i, t, _) in enumerate(ODD)], "doc_id long, text string, n_chars long")
    labels = spark.createDataFrame([(1, 1), (3, 0), (None, 1), (4, None)], "doc_id long, label int")
    rows = quality.scores(df, quality.learn(df, labels), "doc_id").collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    none = quality.learn(df, labels.limit(0))
    assert {r.score for r in quality.scores(df, none, "doc_id").collect()} == {0.5}
    assert quality.scores(df.limit(0), none, "doc_id").count() == 0


def test_slices_of_features_agree():
    texts = pa.array(["the word the word", None, "x # y"])
    rows = [f for f in quality.features(texts, pa.array([1, 2, None]))]
    assert sum(end - row for row, end, *_ in rows) == 3 and len(rows[0][2]) == 5


def test_model_is_cut_by_occurrences(spark):
    rows = [(k, "aa bb cc dd ee"[: 3 * (1 + k % 5) - 1], "x" if k % 2 else "y") for k in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    whole, small = langid.learn(df), langid.learn(df, entries=12)
    assert whole.languages == small.languages == ("x", "y")
    assert 0 < sum(map(len, small.hashes)) <= 12 < sum(map(len, whole.hashes))
    for order, hashes in enumerate(small.hashes):
        assert set(hashes.tolist()) <= set(whole.hashes[order].tolist())


def brute_language(text, counts, languages):
    """Word-first back-off by plain dictionaries: counts[rank][entry] is a list by language."""
    import math

    sums = {r: [sum(c[k] for c in counts[r].values()) + langid._SMOOTH * len(counts[r]) for k in range(len(languages))] for r in counts}

    def weights(rank, entry):
        logs = [math.log((counts[rank][entry][k] + langid._SMOOTH) / sums[rank][k]) for k in range(len(languages))]
        return [v - sum(logs) / len(logs) for v in logs]

    words = text.split()
    total = [0.0] * len(languages)
    for word in words:
        found = [weights(0, word)] if word in counts[0] else []
        padded = f" {word} "
        for n in range(langid.LONGEST, 0, -1):
            if not found:
                grams = [padded[i:i + n] for i in range(len(padded) - n + 1)]
                found = [weights(n, g) for g in grams if g in counts[n] and (n > 1 or g != " ")]
        for v in found:
            total = [t + x / len(found) for t, x in zip(total, v)]
    scaled = [math.exp((t - max(total)) / math.sqrt(max(len(words), 1))) for t in total]
    return languages[scaled.index(max(scaled))], max(scaled) / sum(scaled)


def test_scores_equal_a_plain_back_off(spark):
    import random

    rng = random.Random(2)
    alphabet = {"x": "abcd", "y": "cdef", "z": "fgha"}
    rows = [(k, " ".join("".join(rng.choice(alphabet[lang]) for _ in range(rng.randint(1, 4))) for _ in range(8)), lang)
            for k, lang in enumerate(rng.choice("xyz") for _ in range(120))]
    counts = {r: {} for r in range(langid.LONGEST + 1)}
    languages = ["x", "y", "z"]
    for _, text, lang in rows:
        for word in text.split():
            padded = f" {word} "
            entries = [(0, word)] + [(n, padded[i:i + n]) for n in range(1, langid.LONGEST + 1) for i in range(len(padded) - n + 1)]
            for rank, entry in entries:
                if rank != 1 or entry != " ":
                    counts[rank].setdefault(entry, [0, 0, 0])[languages.index(lang)] += 1
    counts = {r: {e: c for e, c in found.items() if sum(c) >= langid.LEAST_COUNT} for r, found in counts.items()}
    asked = [(k, t) for k, (_, t, _) in enumerate(rows)] + [(500, "abgh ccdd zzz aaaaaaa"), (501, "qqq fgh"), (502, "a"), (503, "ghghgh efef")]
    model = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    out = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(spark.createDataFrame(asked, "doc_id long, text string"), model, "doc_id").collect()}
    for key, text in asked:
        lang, score = brute_language(text, counts, languages)
        assert out[key][1] == pytest.approx(score, rel=1e-4) and (out[key][0] == lang or score < 0.5), text


def test_filters_keep_all_columns_whatever_their_names(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    odd = docs.withColumns({"_told_lang": F.lit(1), "_told_score": F.lit("s"), "_told_good": F.lit(2), "_text": F.lit(3), "_chars": F.lit(4), "a.b": F.lit(5)})
    odd = odd.unionByName(odd.limit(3)).unionByName(odd.limit(1).withColumn("doc_id", F.lit(None).cast("long")).withColumn("text", F.lit(None).cast("string")))
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    told, good = langid.with_known_language(odd), quality.good_documents(odd, labels)
    assert told.columns == good.columns == odd.columns
    plain = langid.with_known_language(docs)
    assert set(r[0] for r in told.select("doc_id").collect()) == set(r[0] for r in plain.select("doc_id").collect())
    assert 0 < good.count() <= odd.count() and told.where("text IS NULL").count() == 0
