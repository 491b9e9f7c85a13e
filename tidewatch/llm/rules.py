"""Text statistics of whole documents and ordered rules learned from labelled ones."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.text import NEWLINE, SPACE, byte_set, gram_hashes, per_row, row_bounds, span_hashes, spans, utf8_slices

SYMBOLS = byte_set(b"#*$%&|<>")  # fixed values: characters counted as symbols
WINDOW = 8
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE = ("n_lines", "n_upper", "n_digits", "n_ends", "n_echoes")
_UPPER, _DIGITS, _ENDS = byte_set(range(65, 91)), byte_set(range(48, 58)), byte_set(b".!?")
SAMPLE = 20_000  # labelled documents to learn from, about


def slice_statistics(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """All statistics of the documents of a slice."""
    n = len(offsets) - 1
    rows, starts, ends = spans(data, offsets, SPACE)
    lead = (data & 0xC0) != 0x80  # bytes that begin a code point

    def count(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return total[offsets[1:]] - total[offsets[:-1]]

    hashes = span_hashes(data, starts, ends)
    line_rows, line_starts, line_ends = spans(data, offsets, NEWLINE)
    line_hashes = span_hashes(data, line_starts, line_ends)
    words = row_bounds(rows, n)
    worded = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    lines = row_bounds(line_rows[worded], n)
    line_hashes = line_hashes[worded]
    echo = (hashes[1:] == hashes[:-1]) & (rows[1:] == rows[:-1])  # a word like the one before it
    dup, repeat = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for k in range(n):
        mine = line_hashes[lines[k]:lines[k + 1]]
        dup[k] = len(mine) - len(np.unique(mine)) if len(mine) > 1 else 0
        repeat[k] = repeated_words(hashes[words[k]:words[k + 1]])
    return {"n_words": per_row(rows, n), "word_chars": count(lead & ~SPACE[data]), "n_symbols": count(SYMBOLS[data]),
            "n_dup_lines": dup, "n_repeat_words": repeat, "n_lines": np.diff(lines), "n_upper": count(_UPPER[data]),
            "n_digits": count(_DIGITS[data]), "n_ends": count(_ENDS[data]), "n_echoes": per_row(rows[1:][echo], n)}


def repeated_words(words: np.ndarray, window: int = WINDOW) -> int:
    """How many words lie in runs of `window` words that occur twice or more."""
    grams = gram_hashes(words, window)
    if len(grams) < 2:
        return 0
    order = np.argsort(grams)
    same = grams[order][1:] == grams[order][:-1]
    if not same.any():
        return 0
    again = np.zeros(len(grams), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    change = np.zeros(len(words) + 1, np.int64)
    change[:len(grams)] += again
    change[window:window + len(grams)] -= again
    return int((np.cumsum(change)[:-1] > 0).sum())


def text_statistics(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, BASE..., MORE...) as longs for every whole text; a null text has only zeros. A row in gives a row out."""
    kind = docs.select(id_column).schema[0].dataType.simpleString()
    names = (*BASE, *MORE)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [slice_statistics(data, offsets) for _, _, data, offsets in utf8_slices(batch.column(1))]
            columns = [pa.array(np.concatenate([f[c] for f in found]) if found else np.zeros(0, np.int64)) for c in names]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[id_column, *names])

    return docs.select(id_column, text_column).mapInArrow(measure, f"`{id_column}` {kind}, " + ", ".join(f"{c} long" for c in names))


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


#: Name -> (above, below): shares that thresholds are put on.
SHARES = {
    "chars_per_word": ("word_chars", "n_words"), "symbols_per_word": ("n_symbols", "n_words"),
    "dup_line_share": ("n_dup_lines", "n_lines"), "repeat_share": ("n_repeat_words", "n_words"),
    "words_per_line": ("n_words", "n_lines"), "upper_share": ("n_upper", "word_chars"),
    "digit_share": ("n_digits", "word_chars"), "ends_per_word": ("n_ends", "n_words"), "echo_share": ("n_echoes", "n_words"),
}


def share(name: str) -> Column:
    above, below = SHARES[name]
    return F.col(above) / F.greatest(F.col(below), F.lit(1))


@dataclass(frozen=True)
class Rule:
    """All conditions (share, ">" or "<=", threshold) together give `verdict`."""
    conditions: tuple[tuple[str, str, float], ...]
    verdict: int
    right: int
    covered: int

    def holds(self) -> Column:
        out = F.lit(True)
        for name, sign, at in self.conditions:
            out = out & (share(name) > at if sign == ">" else share(name) <= at)
        return out

    def __str__(self) -> str:
        return " and ".join(f"{n} {s} {at:.4g}" for n, s, at in self.conditions) + f" -> {self.verdict} ({self.right}/{self.covered})"


@dataclass(frozen=True)
class DecisionList:
    """Rules in order; the first that holds decides, else `default`."""
    rules: tuple[Rule, ...]
    default: int

    def verdict(self) -> Column:
        if not self.rules:
            return F.lit(self.default)
        out = F.when(self.rules[0].holds(), self.rules[0].verdict)
        for rule in self.rules[1:]:
            out = out.when(rule.holds(), rule.verdict)
        return out.otherwise(self.default)


def _mask(x: dict[str, np.ndarray], conditions) -> np.ndarray:
    out = np.ones(len(next(iter(x.values()))), bool)
    for name, sign, at in conditions:
        out &= x[name] > at if sign == ">" else x[name] <= at
    return out


def _grow(x: dict[str, np.ndarray], y: np.ndarray, most: int) -> list[tuple[str, str, float]]:
    """Add the threshold that gains most, until only right rows are covered or nothing gains."""
    conditions: list[tuple[str, str, float]] = []
    inside = np.ones(len(y), bool)
    while len(conditions) < most:
        p0, n0 = float(y[inside].sum()), float((~y[inside]).sum())
        if n0 == 0 or p0 == 0:
            break
        best = (1e-9, None)
        for name, values in x.items():
            v, t = values[inside], y[inside]
            order = np.argsort(v, kind="stable")
            v, t = v[order], t[order]
            cut = np.flatnonzero(v[1:] > v[:-1])
            if not len(cut):
                continue
            p_low, all_low = np.cumsum(t)[cut].astype(float), (cut + 1).astype(float)
            middle = (v[cut] + v[cut + 1]) / 2
            for sign, p, every in (("<=", p_low, all_low), (">", p0 - p_low, p0 + n0 - all_low)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(p > 0, p * (np.log2(p / every) - np.log2(p0 / (p0 + n0))), -1.0)
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (float(gain[k]), (name, sign, float(middle[k])))
        if best[1] is None:
            break
        conditions.append(best[1])
        inside &= _mask(x, conditions[-1:])
    return conditions


def _prune(conditions, x: dict[str, np.ndarray], y: np.ndarray):
    """Drop last conditions while that doesn't worsen (right - wrong) / covered on rows not grown from."""
    def worth(c) -> float:
        m = _mask(x, c)
        return (2.0 * y[m].sum() - m.sum()) / m.sum() if m.any() else -1.0

    kept = list(conditions)
    while len(kept) > 1 and worth(kept[:-1]) >= worth(kept):
        kept.pop()
    return kept, worth(kept)


def learn(sample: pd.DataFrame, label: str = "label", max_rules: int = 8, max_conditions: int = 3, precision: float = 0.95,
          seed: int = 11) -> DecisionList:
    """Sequential covering: rules for the rarer verdict, one after another, each on what earlier ones left.

    Two thirds of the rows grow a rule, the rest prune it; a rule is kept if at least `precision` of what it covers in
    both parts is right and it covers 5 rows or more. Empty samples and samples of one label give no rules.
    """
    y = sample[label].to_numpy() == 1
    if not len(y) or y.all() or not y.any():
        return DecisionList((), int(bool(len(y) == 0 or y.all())))
    verdict = 0 if y.mean() >= 0.5 else 1
    y = y == bool(verdict)
    x = {n: sample[a].to_numpy(float) / np.maximum(sample[b].to_numpy(float), 1.0) for n, (a, b) in SHARES.items()}
    left, rules = np.ones(len(y), bool), []
    grow_part = np.random.default_rng(seed).random(len(y)) < 2 / 3
    while len(rules) < max_rules:
        part = {True: left & grow_part, False: left & ~grow_part}
        if not y[part[True]].any():
            break
        conditions = _grow({n: v[part[True]] for n, v in x.items()}, y[part[True]], max_conditions)
        if not conditions:
            break
        conditions, _ = _prune(conditions, {n: v[part[False]] for n, v in x.items()}, y[part[False]])
        hit = _mask(x, conditions) & left
        right, covered = int(y[hit].sum()), int(hit.sum())
        if covered < 5 or right < precision * covered:
            break
        rules.append(Rule(tuple(conditions), verdict, right, covered))
        left &= ~hit
    return DecisionList(tuple(rules), 1 - verdict)


def hashed_sample(rows: DataFrame, id_column: str, most: int, seed: int = 3) -> DataFrame:
    """About `most` rows at most, chosen by a hash of the id; all where there are fewer."""
    n = rows.count()
    if n <= most:
        return rows
    return rows.where(F.pmod(F.xxhash64(F.lit(seed), F.col(id_column)), F.lit(1 << 40)) < int(most / n * (1 << 40)))


def learn_from(statistics: DataFrame, labels: DataFrame, sample: int = SAMPLE, **options) -> DecisionList:
    """A decision list from statistics (doc_id, ...) and labels (doc_id, label 0 or 1, others left out).

    About `sample` labelled documents at most, chosen by a hash of the id, are brought to the driver: numbers only.
    """
    known = labels.where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", "label")
    rows = hashed_sample(known, "doc_id", sample).join(statistics, "doc_id").select("label", *BASE, *MORE)
    frame = rows.toPandas()
    return learn(frame.sort_values(list(frame.columns), kind="stable").reset_index(drop=True), **options)


def apply(statistics: DataFrame, rules: DecisionList) -> DataFrame:
    """(doc_id, BASE..., base_failed, kept): false where the base rules fail, else what the list says."""
    return statistics.select("doc_id", *BASE, base_failed().alias("base_failed"),
                             (~base_failed() & (rules.verdict() == 1)).alias("kept"))
