"""Language identification, word first, with back-off to ever shorter character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.numbers import quoted
from tidewatch.llm.rules import hashed_sample
from tidewatch.llm.text import free_names, mix, quoted_name, row_bounds, span_hashes, spans, utf8_slices
from tidewatch.session import discard, staged

UNDECIDED = "und"
SAMPLE = 12_000  # labelled documents to learn from, about
ENTRIES = 400_000  # words and n-grams of a model at most, the most frequent
LEAST_COUNT = 3
OFTEN = 1_000  # occurrences from which entries aren't told apart by their number
LONGEST = 5
_SMOOTH = 0.5
_GAP = np.ones(256, bool)  # bytes that end a word: all but ASCII letters and bytes of other characters
_GAP[65:91] = _GAP[97:123] = _GAP[128:] = False
_BOUNDARY = 1  # code point that stands before and after a word


@dataclass(frozen=True)
class LanguageModel:
    """Per order (0: words, n: n-grams) ordered hashes and their log frequency by language, less the mean over languages."""
    languages: tuple[str, ...]
    hashes: tuple[np.ndarray, ...] = field(default=())
    weights: tuple[np.ndarray, ...] = field(default=())

    def look_up(self, order: int, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(known, row): which hashes the model has, and where."""
        table = self.hashes[order]
        if not len(table):
            return np.zeros(len(hashes), bool), np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(table, hashes), len(table) - 1)
        return table[at] == hashes, at


def is_held_out(doc_id: Column) -> Column:
    """Rows that nothing is learned from: crc32 of the id as text leaves 2 by 4; rows without id are learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def _lowered(texts: pa.Array) -> pa.Array:
    return pc.utf8_lower(texts)


def _points(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of words with a boundary before and after each, and where each begins."""
    raw = data.tobytes()
    words = [raw[s:e].decode("utf-8", "replace") for s, e in zip(starts.tolist(), ends.tolist())]
    mark = chr(_BOUNDARY)
    text = mark + (mark * 2).join(words) + mark if words else ""
    bounds = np.concatenate([[0], np.cumsum([len(w) + 2 for w in words])]).astype(np.int64)
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64), bounds


def _grams(points: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(word, hash) of all n-grams of `_points`; single characters leave boundaries out."""
    count = len(points) - n + 1
    if count <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    word = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    coded, total = mix(points + np.uint64(0x632BE5AB)), np.zeros(count, np.uint64)
    for k in range(n):
        total = total * np.uint64(0x9E3779B97F4A7C15) + coded[k:k + count]
    inside = word[:count] == word[n - 1:]
    if n == 1:
        inside &= points != _BOUNDARY
    return word[:count][inside], mix(total[inside])


def _slices(texts: pa.Array) -> Iterator[tuple]:
    for row, end, data, offsets in utf8_slices(_lowered(texts)):
        rows, starts, ends = spans(data, offsets, _GAP)
        yield row, end, data, rows, starts, ends, span_hashes(data, starts, ends)


def _counted(sample: DataFrame) -> DataFrame:
    """(lang, rank, hash, n): occurrences of words (rank 0) and n-grams in labelled texts, summed per batch."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, code = np.unique(np.array(batch.column(0).to_pylist(), object).astype(str), return_inverse=True)
            for row, end, data, rows, starts, ends, hashes in _slices(batch.column(1)):
                lang = code[row:end][rows]
                for which in np.unique(lang):
                    mine = lang == which
                    word, first, n = np.unique(hashes[mine], return_index=True, return_counts=True)
                    found = [(0, word, n)]
                    points, bounds = _points(data, starts[mine][first], ends[mine][first])
                    for order in range(1, LONGEST + 1):
                        owner, gram = _grams(points, bounds, order)
                        unique, back = np.unique(gram, return_inverse=True)
                        found.append((order, unique, np.bincount(back.reshape(-1), n[owner], len(unique)).astype(np.int64)))
                    size = sum(len(h) for _, h, _ in found)
                    yield pa.RecordBatch.from_arrays([
                        pa.array([str(langs[which])] * size), pa.array(np.concatenate([np.full(len(h), o, np.int32) for o, h, _ in found])),
                        pa.array(np.concatenate([h for _, h, _ in found]).astype(np.int64)),
                        pa.array(np.concatenate([c for _, _, c in found]).astype(np.int64))], names=["lang", "rank", "hash", "n"])

    return sample.select("lang", "text").mapInArrow(work, "lang string, rank int, hash long, n long")


def learn(labelled: DataFrame, sample: int = SAMPLE, entries: int = ENTRIES, least: int = LEAST_COUNT) -> LanguageModel:
    """A model from rows with doc_id, text and lang; rows without text or lang are left out.

    About `sample` documents at most, chosen by a hash of the id, are counted as a Spark job. Words and n-grams that occur
    `least` times or more enter the model; where that makes more than `entries`, the smallest larger number of
    occurrences that doesn't. The driver gets one row of 12 + 8 * languages bytes for each.
    """
    known = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    chosen = hashed_sample(known.select("doc_id", "text", "lang"), "doc_id", sample)
    counts = _counted(chosen)
    languages = sorted(row[0] for row in known.select("lang").distinct().collect())
    by = [F.coalesce(F.sum(F.when(F.col("lang") == lang, F.col("n"))), F.lit(0)).cast("long") for lang in languages]
    table = staged(counts.groupBy("rank", "hash").agg(F.sum("n").alias("total"), F.array(*by).cast("array<long>").alias("by")))
    often = F.least(F.col("total"), F.lit(OFTEN))
    frequent = table.where(F.col("total") >= least)
    sizes = sorted(frequent.groupBy(often.alias("times")).count().collect(), reverse=True)  # OFTEN rows at most
    kept = np.cumsum([row["count"] for row in sizes])
    cut = min((row["times"] for row, n in zip(sizes, kept) if n <= entries), default=OFTEN + 1)
    found = frequent.where(often >= cut).select("rank", "hash", "by").toArrow().combine_chunks()
    discard(table)
    if not found.num_rows:
        return LanguageModel(())
    rank, hashed = found["rank"].to_numpy(), found["hash"].to_numpy().astype(np.uint64)
    counted = pc.list_flatten(found["by"]).to_numpy().reshape(len(rank), -1).astype(float)
    seen = counted.sum(0) > 0
    languages, counted = [lang for lang, some in zip(languages, seen) if some], counted[:, seen]
    hashes, weights = [], []
    for order in range(LONGEST + 1):
        mine = np.flatnonzero(rank == order)
        mine = mine[np.argsort(hashed[mine])]
        smooth = counted[mine] + _SMOOTH
        logs = np.log(smooth / smooth.sum(0))
        hashes.append(hashed[mine])
        weights.append((logs - logs.mean(1, keepdims=True)).astype(np.float32))
    return LanguageModel(tuple(languages), tuple(hashes), tuple(weights))


def word_scores(model: LanguageModel, hashes: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A row of weights by language for each distinct word: its own, or the mean of its longest known n-grams."""
    out = np.zeros((len(hashes), len(model.languages)), np.float64)
    known, at = model.look_up(0, hashes)
    out[known] = model.weights[0][at[known]]
    left = np.flatnonzero(~known)
    if not len(left):
        return out
    points, bounds = _points(data, starts[left], ends[left])
    for n in range(LONGEST, 0, -1):
        owner, gram = _grams(points, bounds, n)
        known, at = model.look_up(n, gram)
        owner, found = owner[known], model.weights[n][at[known]]
        times = np.bincount(owner, minlength=len(left))
        new = (times > 0) & ~out[left].any(1)
        for k in range(len(model.languages)):
            total = np.bincount(owner, found[:, k], len(left))
            out[left[new], k] = total[new] / times[new]
    return out


def identify(docs: DataFrame, model: LanguageModel, *keep: str, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """(keep..., lang_pred, score) per row of `docs`: the likeliest language of the whole text and its share.

    Known words count their log frequency by language; an unknown word counts the mean over its known n-grams of the
    largest n (5 to 1) that has any. Sums go through a softmax, divided by the root of the number of words, which
    words of one text aren't independent of. A null text and one without letters is `und` with score 0; a
    text with letters of which nothing is known gets the first language and an even share. Without
    languages in the model all are `und`. Rows are kept as they are, repeated and with null ids.
    """
    # Plain names on the way in: columns with a dot in theirs don't pass mapInArrow.
    inputs = [*keep] if "text" in keep else [*keep, "text"]
    chosen = docs.select(*[quoted(c).alias(f"c{k}") for k, c in enumerate(inputs)])
    place = inputs.index("text")
    kinds = ", ".join(f"{quoted_name(c)} {f.dataType.simpleString()}" for c, f in zip(keep, chosen.schema))
    languages = model.languages
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = batch.column(place)
            total = np.zeros((batch.num_rows, max(len(languages), 1)))
            words = np.zeros(batch.num_rows)
            lettered = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            for row, end, data, rows, starts, ends, hashes in _slices(texts) if languages else ():
                unique, first, back = np.unique(hashes, return_index=True, return_inverse=True)
                scores = word_scores(model, unique, data, starts[first], ends[first])
                at = scores[back.reshape(-1)]
                running = np.concatenate([np.zeros((1, at.shape[1])), np.cumsum(at, 0)])
                bounds = row_bounds(rows, end - row)
                total[row:end] = running[bounds[1:]] - running[bounds[:-1]]
                words[row:end] = np.diff(bounds)
            scaled = total / np.sqrt(np.maximum(words, 1.0))[:, None]
            scaled = np.exp(scaled - scaled.max(1, keepdims=True))
            best = scaled.argmax(1)
            share = np.where(lettered, 1.0 / scaled.sum(1), 0.0) if languages else np.zeros(batch.num_rows)
            told = [languages[b] if ok and languages else UNDECIDED for b, ok in zip(best.tolist(), lettered.tolist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(keep)], pa.array(told, pa.string()), pa.array(share)], names=[*keep, *names])

    return chosen.mapInArrow(work, ", ".join(k for k in (kinds, f"{quoted_name(names[0])} string", f"{quoted_name(names[1])} double") if k))


def with_known_language(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of `docs` whose language is told with a score of at least `least`, learned from their own `lang`.

    Texts that are null or have no letter go, and so do all where no row tells a language. Rows stay as they are, repeated
    and with null ids, with all their columns, whatever their names.
    """
    model = learn(docs.where(~is_held_out(F.col("doc_id"))))
    told, score = free_names(docs, "_told_lang", "_told_score")
    found = identify(docs, model, *docs.columns, names=(told, score))
    return found.where((F.col(told) != UNDECIDED) & (F.col(score) >= least)).drop(told, score)
