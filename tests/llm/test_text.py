"""Words, lines and hashes against plain Python."""

import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewatch.llm import text as T

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aB é\t\n\x0b日𠮷.x", max_size=30)), max_size=12)


@settings(max_examples=60, deadline=None)
@given(TEXTS, st.integers(1, 40))
def test_words_are_those_of_the_pattern(texts, limit):
    found = [[] for _ in texts]
    for row, end, data, offsets in T.utf8_slices(pa.array(texts, pa.string()), limit):
        rows, starts, ends = T.spans(data, offsets, T.SPACE)
        for r, s, e in zip(rows, starts, ends):
            found[row + r].append(data[s:e].tobytes().decode())
    assert found == [re.findall("[^\x20\x09-\x0D]+", t or "") for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="abAé", min_size=1, max_size=6), min_size=1, max_size=40))
def test_hashes_are_equal_exactly_for_equal_words(words):
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    _, s, e = T.spans(data, np.array([0, len(data)]), T.SPACE)
    hashes = T.span_hashes(data, s, e).tolist()
    assert [[a == b for b in words] for a in words] == [[a == b for b in hashes] for a in hashes]


def test_hashes_do_not_depend_on_place_or_piece(monkeypatch):
    data = np.frombuffer(("wort " * 500).encode(), np.uint8)
    _, s, e = T.spans(data, np.array([0, len(data)]), T.SPACE)
    whole = T.span_hashes(data, s, e)
    monkeypatch.setattr(T, "SLICE_BYTES", 7)
    assert len(set(whole.tolist())) == 1 and (T.span_hashes(data, s, e) == whole).all()


def test_lower_case_is_ascii_only():
    def one(text):
        data = np.frombuffer(text.encode(), np.uint8)
        return T.span_hashes(data, np.array([0]), np.array([len(data)]), lower=True)[0]

    assert one("ABC") == one("abc") and one("É") != one("é")
