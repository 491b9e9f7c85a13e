"""Licence scans: an Aho-Corasick automaton over words finds notices and tags, a shunting-yard parser reads expressions."""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.text import byte_set, row_bounds, span_hashes, spans, utf8_slices

# Phrases and labels that every scan looks for.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Notices, how sure each is to be about a licence, and its label.
NOTICES = {
    "mit license": ("mit", 0.8),
    "permission is hereby granted free of charge": ("mit", 0.9),
    "apache license": ("apache", 0.8),
    "apache license version 2 0": ("apache-2.0", 0.9),
    "bsd license": ("bsd", 0.8),
    "redistribution and use in source and binary forms": ("bsd", 0.9),
    "mozilla public license": ("mpl", 0.9),
    "eclipse public license": ("epl", 0.9),
    "lesser general public license": ("lgpl", 0.9),
    "affero general public license": ("agpl", 0.9),
    "general public license version 2": ("gpl-2.0", 0.9),
    "general public license version 3": ("gpl-3.0", 0.9),
    "cc by sa": ("cc-by-sa", 0.8),
    "cc by nc": ("cc-by-nc", 0.8),
    "cc by nd": ("cc-by-nd", 0.8),
    "cc by nc sa": ("cc-by-nc-sa", 0.9),
    "cc by nc nd": ("cc-by-nc-nd", 0.9),
    "creative commons attribution": ("cc-by", 0.8),
    "public domain": ("public-domain", 0.4),
    "cc0 1 0": ("cc0", 0.9),
}
BASE_CERTAINTY = {"cc-by": 0.7, "gpl": 0.8, "reserved": 0.5}

# After these words an expression may stand; True where any identifier counts, else one of KNOWN must be first.
TAGS = {"spdx license identifier": True, "license expression": True, "licensed under": False, "licensed under the": False,
        "released under": False, "released under the": False}
TAG_CERTAINTY = 0.95

# How freely work under a licence may be used, 0 to 1, by its family: the longest beginning of an identifier counts.
KNOWN = {"mit": 1.0, "apache": 1.0, "bsd": 1.0, "isc": 1.0, "zlib": 1.0, "unlicense": 1.0, "cc0": 1.0, "0bsd": 1.0, "cc-by": 0.9, "python": 0.9,
         "mpl": 0.7, "epl": 0.7, "lgpl": 0.6, "cc-by-sa": 0.5, "gpl": 0.4, "agpl": 0.3, "cc-by-nc": 0.2, "cc-by-nd": 0.2}
UNKNOWN = 0.1

WORD_GAP = byte_set([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])


# --- phrases --------------------------------------------------------------------------------

@dataclass
class Automaton:
    """Aho-Corasick over word numbers: goto and failure links per node, and the phrases that end there."""

    numbers: dict[str, int] = field(default_factory=dict)
    follow: list[dict[int, int]] = field(default_factory=lambda: [{}])
    fail: list[int] = field(default_factory=lambda: [0])
    ends: list[tuple[str, ...]] = field(default_factory=lambda: [()])

    @classmethod
    def of(cls, phrases) -> Automaton:
        made = cls()
        for phrase in phrases:
            node = 0
            for word in phrase.split():
                number = made.numbers.setdefault(word, len(made.numbers))
                if number not in made.follow[node]:
                    made.follow[node][number] = len(made.follow)
                    made.follow.append({})
                    made.fail.append(0)
                    made.ends.append(())
                node = made.follow[node][number]
            made.ends[node] += (phrase,)
        queue = deque(made.follow[0].values())
        while queue:
            node = queue.popleft()
            for number, child in made.follow[node].items():
                made.fail[child] = made.step(made.fail[node], number)
                made.ends[child] += made.ends[made.fail[child]]
                queue.append(child)
        words = np.array(sorted(made.numbers), dtype=object)
        raw = [w.encode() for w in words]
        stops = np.cumsum([len(w) for w in raw]) if raw else np.zeros(0, np.int64)
        hashes = span_hashes(np.frombuffer(b"".join(raw), np.uint8), stops - [len(w) for w in raw], stops) if raw else np.zeros(0, np.uint64)
        order = np.argsort(hashes)
        made.hashes, made.at = hashes[order], np.array([made.numbers[w] for w in words[order]], np.int64)
        return made

    def step(self, node: int, number: int) -> int:
        while number not in self.follow[node]:
            if not node:
                return 0
            node = self.fail[node]
        return self.follow[node][number]

    def find(self, hashes: np.ndarray, rows: np.ndarray) -> Iterator[tuple[int, int, str]]:
        """(first word, end word, phrase) of every place, also overlapping ones; words that no phrase has reset the automaton."""
        slot = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        known = np.flatnonzero(self.hashes[slot] == hashes)
        node, last, row = 0, -2, -1
        for place, number, at in zip(known.tolist(), self.at[slot[known]].tolist(), rows[known].tolist()):
            node = self.step(node if place == last + 1 and at == row else 0, number)
            last, row = place, at
            for phrase in self.ends[node]:
                yield place + 1 - phrase.count(" ") - 1, place + 1, phrase


# --- expressions ----------------------------------------------------------------------------

_TOKEN = re.compile(r"[ \t]*([()]|[A-Za-z0-9][A-Za-z0-9.+-]*(?::[A-Za-z0-9.+-]+)?)")
_BEFORE = re.compile(rb"[\t\r :=\"']*")
WINDOW = 4_096  # bytes decoded at first
_BINDS = {"OR": 1, "AND": 2, "WITH": 3}


def tokens(line: bytes) -> Iterator[str]:
    """Parentheses, operators (upper case) and identifiers from the start of a line, up to what is none of them.

    The line is decoded as far as tokens are asked for.
    """
    size, at = WINDOW, 0
    text = bytes(line[:size]).decode("latin-1")
    while True:
        found = _TOKEN.match(text, at)
        if (found is None or found.end() == len(text)) and len(text) < len(line):
            size *= 2
            text = bytes(line[:size]).decode("latin-1")
            continue
        if found is None:
            return
        token, at = found.group(1), found.end()
        yield token.upper() if token.upper() in _BINDS else token.rstrip(".") if token not in "()" else token


def postfix(words: Iterable[str], open_end: bool = False) -> list[str]:
    """Operands and operators in postfix order, by the shunting-yard method: WITH binds before AND, AND before OR.

    Nothing where the words make no expression. With `open_end` the longest beginning that is an expression counts, and words
    are taken only as far as it may go on.
    """
    out, stack, wants, depth, good, whole = [], [], True, 0, [], True
    for word in words:
        if wants and word == "(":
            stack.append(word)
            depth += 1
        elif wants and word not in _BINDS and word != ")":
            out.append(word)
            wants = False
        elif not wants and word in _BINDS:
            while stack and stack[-1] != "(" and _BINDS[stack[-1]] >= _BINDS[word]:
                out.append(stack.pop())
            stack.append(word)
            wants = True
        elif not wants and word == ")" and depth:
            while stack[-1] != "(":
                out.append(stack.pop())
            stack.pop()
            depth -= 1
        else:
            whole = False
            break
        if not wants and not depth:
            good = (len(out), stack[::-1])
    if good and (open_end or whole and not wants and not depth):
        return out[:good[0]] + good[1]
    return []


def family(identifier: str) -> str | None:
    """The known family of an identifier: the longest of KNOWN that it is or begins with before a `-`, `.` or `+`."""
    low = identifier.lower()
    fits = [k for k in KNOWN if low == k or low.startswith(k) and low[len(k)] in "-.+"]
    return max(fits, key=len, default=None)


def evaluate(parts: list[str]) -> tuple[float, list[str]]:
    """(freedom, labels) of a postfix expression: AND takes the less free side, OR the freer one, WITH halves what is missing to 1.

    All identifiers but exceptions are labels, in lower case, whichever side of an OR is freer.
    """
    stack: list[tuple[float, list[str]]] = []
    for part in parts:
        if part in _BINDS:
            right, left = stack.pop(), stack.pop()
            if part == "WITH":
                stack.append(((1 + left[0]) / 2, left[1]))
            else:
                stack.append(((min if part == "AND" else max)(left[0], right[0]), left[1] + right[1]))
        else:
            known = family(part)
            stack.append((KNOWN[known] if known else UNKNOWN, [part.lower()]))
    return stack[-1] if stack else (0.0, [])


def expression_after(line: bytes, any_identifier: bool) -> list[str]:
    """The postfix expression at the start of a line, white space, colons and quotes before it skipped."""
    parts = postfix(tokens(line[len(_BEFORE.match(line).group()):]), open_end=True)
    return parts if parts and (any_identifier or family(parts[0])) else []


# --- documents ------------------------------------------------------------------------------

PLACE = "struct<label:string,kind:string,first_word:long,end_word:long,certainty:double,freedom:double>"
_PLACE = pa.list_(pa.struct([("label", pa.string()), ("kind", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64()),
                             ("certainty", pa.float64()), ("freedom", pa.float64())]))


@dataclass(frozen=True)
class Phrases:
    base: Mapping[str, str]
    notices: Mapping[str, tuple[str, float]]
    tags: Mapping[str, bool]


def _places(data: np.ndarray, offsets: np.ndarray, automaton: Automaton, known: Phrases) -> tuple[np.ndarray, dict[int, list[dict]]]:
    """Words of each text of a slice, and the places found in some of them."""
    rows, starts, ends = spans(data, offsets, WORD_GAP)
    bounds = row_bounds(rows, len(offsets) - 1)
    found: dict[int, list[dict]] = {}
    breaks = None
    for first, end, phrase in automaton.find(span_hashes(data, starts, ends, lower=True), rows):
        row = int(rows[first])
        at = {"first_word": first - int(bounds[row]), "end_word": end - int(bounds[row])}
        out = found.setdefault(row, [])
        if phrase in known.base:
            label = known.base[phrase]
            out.append(at | {"label": label, "kind": "base", "certainty": BASE_CERTAINTY.get(label, 0.5), "freedom": None})
        if phrase in known.notices:
            label, certainty = known.notices[phrase]
            out.append(at | {"label": label, "kind": "notice", "certainty": certainty, "freedom": None})
        if phrase in known.tags:
            breaks = np.flatnonzero(data == 0x0A) if breaks is None else breaks
            after = np.searchsorted(breaks, ends[end - 1])
            stop = min(int(breaks[after]) if after < len(breaks) else len(data), int(offsets[row + 1]))
            parts = expression_after(memoryview(data[ends[end - 1]:stop]), known.tags[phrase])
            if parts:
                freedom, labels = evaluate(parts)
                out += [at | {"label": label, "kind": "expression", "certainty": TAG_CERTAINTY, "freedom": freedom} for label in dict.fromkeys(labels)]
    return np.diff(bounds), found


def licence_places(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", base: Mapping[str, str] = BASE,
                   notices: Mapping[str, tuple[str, float]] = NOTICES, tags: Mapping[str, bool] = TAGS) -> DataFrame:
    """(id, n_words, places) of every whole text: where licence phrases and expressions stand.

    Words are runs of letters, digits and characters beyond ASCII, A-Z in lower case. A place has its label, kind (base, notice or
    expression), first and end word, certainty and, for expressions, freedom (how freely the work may be used, 0 to 1). Phrases are found
    wherever their words follow one another, whatever stands between the words, also inside longer phrases. After a tag the line is
    read as an SPDX expression with and, or, with and parentheses; its longest correct beginning counts, every identifier is a
    label, and an expression stands at its tag.

    Null and empty texts have 0 words and no places. Ids may be null or repeat; a row in gives a row out. Other columns aren't read. Texts of
    any length are one slice at most; a phrase never reaches from one text into the next.
    """
    known, automaton = Phrases(dict(base), dict(notices), dict(tags)), Automaton.of(dict.fromkeys([*base, *notices, *tags]))
    name = "`" + id_column.replace("`", "``") + "`"
    chosen = docs.select(F.col(name), F.col("`" + text_column.replace("`", "``") + "`").alias("_text"))
    kind = chosen.schema[0].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, places = np.zeros(batch.num_rows, np.int64), [[]] * batch.num_rows
            for row, end, data, offsets in utf8_slices(batch.column(1)):
                counts[row:end], found = _places(data, offsets, automaton, known)
                for k, out in found.items():
                    places[row + k] = out
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts), pa.array(places, _PLACE)], names=[id_column, "n_words", "places"])

    return chosen.mapInArrow(scan, f"{name} {kind}, n_words long, places array<{PLACE}>")


def label_list(places: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda p: p["label"]))), ",")


def certainty(places: Column) -> Column:
    """The chance that a text speaks of a licence: its labels' certainties (the best place of each) as independent signs; 0 without any.

    Labels are taken in order of their names, so the rounding of the product is the same in every run.
    """
    best = F.transform(F.array_sort(F.array_distinct(F.transform(places, lambda p: p["label"]))),
                       lambda name: F.array_max(F.transform(F.filter(places, lambda p: p["label"] == name), lambda p: p["certainty"])))
    return F.lit(1.0) - F.aggregate(best, F.lit(1.0), lambda left, c: left * (F.lit(1.0) - c))


def freedom(places: Column) -> Column:
    """The least freedom that an expression of the text leaves; null without expressions."""
    return F.array_min(F.transform(places, lambda p: p["freedom"]))
