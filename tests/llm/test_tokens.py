"""Token counts, encoding and decoding against the library and a plain Viterbi."""

import random

import pyarrow as pa
import pytest
import sentencepiece

from tidewatch.llm import lattice as L
from tidewatch.llm import tokens
from tidewatch.llm.pieces import MARK, bundled_model, piece_table

ODD = ["", None, " ", "  a  b ", "▁", "x▁y", "▁▁ a", "a\tb\nc\r\n", "<s> hello </s> <0x41> <unk>", "日本語𠮷 text", "é" * 40, "　 ½ﬁ Å", "the" * 900,
       " " * 700, "ab cd " * 2000, "x" * 2100, "\x00\x01"]


def random_texts(n=400):
    rng = random.Random(2)
    letters = [chr(i) for i in range(1, 0x250)] + list("日本語𠮷▁  \t\n")
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, 50))) for _ in range(n)]


def test_counts_are_the_library_s(spark):
    texts = ODD + random_texts()
    df = spark.createDataFrame([(k if k % 7 else None, t, 1) for k, t in enumerate(texts)], "doc_id long, text string, n_tokens int")
    library = sentencepiece.SentencePieceProcessor(model_file=bundled_model())
    expected = sorted((str(k if k % 7 else None), len((t or "").encode()), len(library.encode(t or ""))) for k, t in enumerate(texts))
    rows = tokens.token_counts(df, limit=100).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in rows) == expected
    assert all(r.over_limit == (r.n_tokens > 100) for r in rows)
    assert tokens.token_counts(df.limit(0)).count() == 0


def test_long_and_short_parts_merge_alike(monkeypatch):
    parts = [t.replace(" ", "x") for t in random_texts(150) if t] + ["representation" * 9]
    short = tokens.count_parts(parts, bundled_model()).tolist()
    monkeypatch.setattr(tokens, "SYNCHRONOUS", 0)
    assert tokens.count_parts(parts, bundled_model()).tolist() == short


def viterbi(text, table, score):
    text = MARK + text.replace(" ", MARK) if text else ""
    best, back = [0] + [None] * len(text), [None] * (len(text) + 1)
    ids = dict(zip(table.pieces, table.ids))
    for end in range(1, len(text) + 1):
        for start in range(max(0, end - 16), end):
            piece = text[start:end]
            if piece in ids:
                edge = (score[piece], [ids[piece]])
            elif end == start + 1:
                edge = (L.BYTE_SCORE * len(piece.encode()), [table.bytes[b] for b in piece.encode()])
            else:
                continue
            if best[end] is None or best[start] + edge[0] > best[end]:
                best[end], back[end] = best[start] + edge[0], (start, edge[1])
    out, end = [], len(text)
    while end:
        start, found = back[end]
        out, end = found + out, start
    return out


@pytest.mark.parametrize("frequent", [1_000_000, 20])
def test_lattice_finds_the_best_path_and_texts_come_back(spark, frequent):
    texts = ODD + random_texts(80)
    df = spark.createDataFrame([(k // 2, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, ids string")
    table = piece_table(bundled_model())
    scores = L.piece_scores(table)
    score = dict(zip(scores["piece"], scores["piece_score"].astype(int)))
    rows = L.decode(L.encode(df, "doc_id", "text", frequent=frequent), "text", "ids").collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert list(r.ids) == viterbi(r.text or "", table, score), r.text
        assert r.decoded == (r.text or "").replace(MARK, " ")


def test_the_library_decodes_it(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=bundled_model())
    df = spark.createDataFrame([(1, "Ein Satz, der 日本 kennt."), (None, None)], "doc_id long, text string")
    for r in L.round_trip(df).collect():
        assert r.same and library.decode(list(r.ids)) == ("" if r.doc_id is None else "Ein Satz, der 日本 kennt.")
    assert L.round_trip(df.limit(0)).count() == 0


LONG = ["".join(random.Random(n).choice("etaoin日é𠮷") for _ in range(n)) for n in (15, 16, 17, 19, 20, 21, 36, 40_000)] + ["inter" * 9, "the cat", "the cat", None, ""]


def best_paths(texts):
    table = piece_table(bundled_model())
    scores = L.piece_scores(table)
    score = dict(zip(scores["piece"], scores["piece_score"].astype(int)))
    return [viterbi(t or "", table, score) for t in texts]


def test_texts_are_encoded_and_decoded_without_a_shuffle(spark):
    df = spark.createDataFrame([(None if k == 3 else 1, t) for k, t in enumerate(LONG)], "doc_id int, text string")
    found = L.round_trip(df)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    rows = found.collect()
    assert all(r.same and r.n_tokens == len(r.ids) for r in rows)
    assert sorted(list(r.ids) for r in rows) == sorted(best_paths(LONG))


@pytest.mark.parametrize("chars", [16, 20, 1 << 15])
def test_stretches_of_long_words_lead_to_the_same_path(monkeypatch, chars):
    monkeypatch.setattr(L, "CHARS", chars)
    monkeypatch.setattr(L, "IDS", 3)
    batch = pa.RecordBatch.from_pydict({"text": pa.array(LONG, pa.string())})
    coded = list(L._encoder(("text",), bundled_model(), 5)(iter([batch.slice(0, 4), batch.slice(4)])))
    assert [i for c in coded for i in c.column(1).to_pylist()] == best_paths(LONG)
    assert [t for c in L._decoder((), bundled_model())(iter([c.select(["ids"]) for c in coded])) for t in c.column(0).to_pylist()] == [t or "" for t in LONG]


def test_decode_takes_null_lists_and_ids_outside_the_vocabulary(spark):
    rows = [(1, None), (2, []), (3, [5, -3, 10 ** 9, None]), (4, sentencepiece.SentencePieceProcessor(model_file=bundled_model()).encode("a é日"))]
    df = spark.createDataFrame(rows, "doc_id int, ids array<int>")
    byte = {b: i for i, b in enumerate(piece_table(bundled_model()).bytes)}.get(5)
    assert {r.doc_id: r.decoded for r in L.decode(df, "doc_id").collect()} == {1: "", 2: "", 3: bytes([byte]).decode() if byte is not None else "", 4: "a é日"}
