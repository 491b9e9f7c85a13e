"""A factorisation machine that scores the quality of texts."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.numbers import quoted
from tidewatch.llm.langid import is_held_out
from tidewatch.llm.rules import SHARES, hashed_sample, slice_statistics
from tidewatch.llm.text import SPACE, free_names, mix, quoted_name, span_hashes, spans, utf8_slices

SAMPLE = 8_000  # labelled documents to learn from, about
BUCKETS = 1 << 13  # for hashed words
FACTORS = 8
STATISTICS = (*SHARES, "log_words", "log_lines", "log_chars")
ACCEPTED = 0.7
_SIZE = BUCKETS + len(STATISTICS)


@dataclass(frozen=True)
class FactorisationMachine:
    """score = sigmoid(bias + w.x + 1/2 sum_f((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)); x: words, then statistics."""
    bias: float
    weights: np.ndarray
    factors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def raw(self, rows: np.ndarray, index: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
        """Scores before the sigmoid, in time linear in the number of (row, index, value)."""
        out = self.bias + np.bincount(rows, self.weights[index] * value, n)
        for v in self.factors.T:
            term = v[index] * value
            out += 0.5 * (np.bincount(rows, term, n) ** 2 - np.bincount(rows, term ** 2, n))
        return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def features(texts: pa.Array, n_chars: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end row, word rows, word buckets, statistics) of slices; buckets are distinct per row.

    Statistics are shares of `rules`, logarithms of the numbers of words and lines, and the n_chars column (null: the
    statistic of an empty text).
    """
    chars = n_chars.cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False)
    for row, end, data, offsets in utf8_slices(texts):
        counts = slice_statistics(data, offsets)
        rows, starts, ends = spans(data, offsets, SPACE)
        hashes = span_hashes(data, starts, ends, lower=True)
        packed = np.unique(rows * BUCKETS + (mix(hashes) % np.uint64(BUCKETS)).astype(np.int64))
        shares = [counts[a] / np.maximum(counts[b], 1) for a, b in SHARES.values()]
        logs = [np.log1p(counts["n_words"]), np.log1p(counts["n_lines"]), np.log1p(np.maximum(np.nan_to_num(chars[row:end]), 0.0))]
        yield row, end, packed // BUCKETS, packed % BUCKETS, np.stack([*shares, *logs], 1)


def _joined(words: tuple[np.ndarray, np.ndarray], statistics: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, index, value) of all inputs: words weigh one over the root of their number, statistics as they are."""
    rows, buckets = words
    n, m = statistics.shape
    weight = 1.0 / np.sqrt(np.maximum(np.bincount(rows, minlength=n), 1.0))
    return (np.concatenate([rows, np.repeat(np.arange(n), m)]), np.concatenate([buckets, BUCKETS + np.tile(np.arange(m), n)]),
            np.concatenate([weight[rows], statistics.reshape(-1)]))


def _scaled(statistics: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return np.clip((statistics - mean) / scale, -4.0, 4.0)


def fit(documents: list[np.ndarray], statistics: np.ndarray, y: np.ndarray, epochs: int = 12, steps: int = 800, batch: int = 64,
        rate: float = 0.08, penalty: float = 1e-4, seed: int = 17) -> FactorisationMachine:
    """Logistic loss, adaptive steps over shuffled batches: `epochs` rounds and `steps` batches at least.

    Fewer than two labels give a constant score.
    """
    share = float(np.clip(y.mean(), 0.01, 0.99)) if len(y) else 0.5
    mean = statistics.mean(0) if len(y) else np.zeros(len(STATISTICS))
    scale = np.maximum(statistics.std(0), 1e-6) if len(y) else np.ones(len(STATISTICS))
    rng = np.random.default_rng(seed)
    bias, w, v = float(np.log(share / (1 - share))), np.zeros(_SIZE), rng.normal(0, 0.02, (_SIZE, FACTORS))
    if not len(y) or y.min() == y.max():
        return FactorisationMachine(bias, w, v * 0, mean, scale)
    x = _scaled(statistics, mean, scale)
    gb, gw, gv = 1.0, np.full(_SIZE, 1e-2), np.full((_SIZE, FACTORS), 1e-2)
    for _ in range(max(epochs, -(-steps * batch // len(y)))):
        order = rng.permutation(len(y))
        for k in range(0, len(order), batch):
            some = order[k:k + batch]
            lengths = [len(documents[i]) for i in some]
            rows, index, value = _joined((np.repeat(np.arange(len(some)), lengths), np.concatenate([documents[i] for i in some])), x[some])
            model = FactorisationMachine(bias, w, v, mean, scale)
            error = (_sigmoid(model.raw(rows, index, value, len(some))) - y[some]) / len(some)
            used, at = np.unique(index, return_inverse=True)
            pull = error[rows] * value
            step = np.bincount(at, pull) + penalty * w[used]
            gw[used] += step ** 2
            for f in range(FACTORS):
                term = v[index, f] * value
                inner = np.bincount(rows, term, len(some))[rows] - term
                d = np.bincount(at, pull * inner) + penalty * v[used, f]
                gv[used, f] += d ** 2
                v[used, f] -= rate * d / np.sqrt(gv[used, f])
            w[used] -= rate * step / np.sqrt(gw[used])
            gb += error.sum() ** 2
            bias -= rate * error.sum() / np.sqrt(gb)
    return FactorisationMachine(bias, w, v, mean, scale)


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> FactorisationMachine:
    """A machine from `docs` (doc_id, text, n_chars) and `labels` (doc_id, label 0 or 1; others are left out).

    About `sample` labelled documents at most, chosen by a hash of the id and not held out, send the driver their distinct
    word buckets (of 8,192) and statistics; texts stay with the tasks.
    """
    known = labels.where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id"))).select("doc_id", F.col("label").cast("int").alias("label"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    chosen = hashed_sample(known, "doc_id", sample)  # at most about `sample` pairs of numbers

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, rows, buckets, statistics in features(batch.column(2), batch.column(3)):
                cuts = np.searchsorted(rows, np.arange(end - row + 1)).astype(np.int32)
                words = pa.ListArray.from_arrays(pa.array(cuts), pa.array(buckets.astype(np.int32)))
                flat = pa.ListArray.from_arrays(pa.array(np.arange(end - row + 1, dtype=np.int32) * len(STATISTICS)), pa.array(statistics.reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, end - row), batch.column(1).slice(row, end - row), words, flat],
                                                 names=["doc_id", "label", "words", "statistics"])

    rows = docs.select("doc_id", "text", F.col("n_chars").cast("double").alias("n_chars")).join(F.broadcast(chosen), "doc_id").select(
        "doc_id", "label", "text", "n_chars").mapInArrow(work, f"doc_id {kind}, label int, words array<int>, statistics array<double>")
    table = rows.toArrow().sort_by([("doc_id", "ascending"), ("label", "ascending")])
    if not table.num_rows:
        return fit([], np.zeros((0, len(STATISTICS))), np.zeros(0))
    words = table["words"].combine_chunks()
    cuts, flat = words.offsets.to_numpy(), words.values.to_numpy(zero_copy_only=False)
    documents = [flat[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
    statistics = table["statistics"].combine_chunks().flatten().to_numpy().reshape(-1, len(STATISTICS))
    return fit(documents, statistics, table["label"].to_numpy().astype(float))


def scores(docs: DataFrame, machine: FactorisationMachine, *keep: str, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """(keep..., score, predicted) per row of `docs` (text, n_chars): the chance of label 1, and 1 from 0.7 on.

    Null and empty texts are scored by their statistics, all zero. Rows are kept as they are, repeated and with null ids; only the
    text and n_chars are inputs.
    """
    # Plain names on the way in: columns with a dot in theirs don't pass mapInArrow.
    names_in = [*keep] if "text" in keep else [*keep, "text"]
    inputs = docs.select(*[quoted(c).alias(f"c{k}") for k, c in enumerate(names_in)], F.col("n_chars").cast("double").alias("chars"))
    place = names_in.index("text")
    kinds = [f"{quoted_name(c)} {f.dataType.simpleString()}" for c, f in zip(keep, inputs.schema)]
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = shared.value
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for row, end, rows, buckets, statistics in features(batch.column(place), batch.column(batch.num_columns - 1)):
                inputs = _joined((rows, buckets), _scaled(statistics, machine.mean, machine.scale))
                out[row:end] = _sigmoid(machine.raw(*inputs, end - row))
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(keep)], pa.array(out), pa.array((out >= ACCEPTED).astype(np.int32))],
                                             names=[*keep, *names])

    return inputs.mapInArrow(work, ", ".join([*kinds, f"{quoted_name(names[0])} double", f"{quoted_name(names[1])} int"]))


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs` that the machine, learned from `labels` (doc_id, label), predicts to be good.

    Null and empty texts are judged by their statistics, all zero. Rows stay as they are, repeated and with null ids, with all their
    columns, whatever their names.
    """
    score, good = free_names(docs, "_told_score", "_told_good")
    return scores(docs, learn(docs, labels), *docs.columns, names=(score, good)).where(F.col(good) == 1).drop(score, good)
