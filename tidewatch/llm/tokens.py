"""Token counts by rank-synchronous merging of ragged arrays."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidewatch.llm.pieces import MARK, bundled_model, piece_table, pre_tokens, spaced
from tidewatch.llm.text import span_hashes, utf8_slices

REMEMBERED = 1 << 19  # counts of parts that a worker keeps
SYNCHRONOUS = 256  # symbols; longer parts are merged one by one, in n log n steps
_NONE = np.int64(1) << 36
_PLACE = np.int64(1) << 23  # more than the symbols of a batch


class _Merges:
    """Symbols as numbers, and for neighbours the rank and symbol they merge to."""

    def __init__(self, model: str):
        table = piece_table(model)
        self.symbol = {p: k for k, p in enumerate(table.pieces)}
        for ch in sorted(set("".join(table.pieces)) - set(self.symbol)):
            self.symbol[ch] = len(self.symbol)
        pairs = {}
        for piece in table.pieces:
            for cut in range(1, len(piece)):
                left, right = self.symbol.get(piece[:cut]), self.symbol.get(piece[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = (table.rank[piece], self.symbol[piece])
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), np.int64)
        self.ranks = np.array([pairs[k][0] for k in self.keys.tolist()], np.int64)
        self.merged = np.array([pairs[k][1] for k in self.keys.tolist()], np.int64)
        codes = np.full(0x110000, -1, np.int64)  # by code point; -1: in no piece
        for text, k in self.symbol.items():
            if len(text) == 1:
                codes[ord(text)] = k
        codes[0x20] = codes[ord(MARK)]
        self.codes = codes
        # What a lone character counts: 1 if it is a piece, else its bytes.
        self.lone = np.where(codes >= 0, 1, 0)
        for ch in set("".join(table.pieces)) - set(table.pieces):
            self.lone[ord(ch)] = 0
        points = np.arange(0x110000)
        size = 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)
        self.lone = np.where(self.lone > 0, 1, size)

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = left << np.int64(32) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = (self.keys[at] == key) & (left >= 0) & (right >= 0)
        return np.where(hit, self.ranks[at], _NONE), np.where(hit, self.merged[at], -1)


@lru_cache(2)
def _merges(model: str) -> _Merges:
    return _Merges(model)


def count_parts(parts: list[str], model: str) -> np.ndarray:
    """Tokens of each part (see `pre_tokens`; spaces stand for marks)."""
    m = _merges(model)
    lengths = np.array([len(p) for p in parts], np.int64)
    out = np.zeros(len(parts), np.int64)
    for k in np.flatnonzero(lengths > SYNCHRONOUS).tolist():
        out[k] = _count_long(parts[k], m)
    short = np.flatnonzero(lengths <= SYNCHRONOUS)
    for begin in range(0, len(short), 20_000):
        some = short[begin:begin + 20_000]
        text = "".join(parts[k] for k in some.tolist())
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        out[some] = _count_short(points.astype(np.int64), lengths[some], m)
    return out


def _count_short(points: np.ndarray, lengths: np.ndarray, m: _Merges) -> np.ndarray:
    """All sequences side by side; each step merges the leftmost lowest-rank pair of every sequence."""
    n = len(lengths)
    owner = np.repeat(np.arange(n), lengths)
    symbols, cost = m.codes[points], m.lone[points]
    total = np.bincount(owner, cost, n).astype(np.int64)
    while len(symbols) > 1:
        rank, merged = m.look_up(symbols[:-1], symbols[1:])
        rank[owner[:-1] != owner[1:]] = _NONE
        # A sequence's first lowest-rank pair: order by (rank, position), least per sequence.
        order = rank * _PLACE + np.arange(len(rank))
        first = np.flatnonzero(np.append(True, owner[1:-1] != owner[:-2]))
        least = np.minimum.reduceat(order, first)
        found = least < _NONE * _PLACE
        if not found.any():
            break
        at = least[found] % _PLACE
        symbols[at] = merged[at]
        total[owner[at]] += 1 - cost[at] - cost[at + 1]
        cost[at] = 1
        keep = np.ones(len(symbols), bool)
        keep[at + 1] = False
        # Sequences without a pair left are settled.
        open_ = np.zeros(n, bool)
        open_[owner[at]] = True
        keep &= open_[owner]
        symbols, cost, owner = symbols[keep], cost[keep], owner[keep]
    return total


def _count_long(part: str, m: _Merges) -> int:
    """The same merges by a heap, for one very long part."""
    points = [ord(c) for c in part]
    symbols, cost = [int(m.codes[p]) for p in points], [int(m.lone[p]) for p in points]
    n = len(points)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap: list[tuple[int, int, int, int]] = []

    def offer(i: int) -> None:
        j = after[i] if i >= 0 else n
        if i >= 0 and j < n and symbols[i] >= 0 and symbols[j] >= 0 and (found := m.pairs.get(symbols[i] << 32 | symbols[j])):
            heapq.heappush(heap, (found[0], i, symbols[i], symbols[j]))

    for i in range(n):
        offer(i)
    while heap:
        _, i, left, right = heapq.heappop(heap)
        j = after[i]
        if symbols[i] != left or j >= n or symbols[j] != right:
            continue
        symbols[i], cost[i] = m.pairs[left << 32 | right][1], 1
        symbols[j], cost[j] = -1, 0
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
        offer(before[i])
        offer(i)
    return sum(cost)


class _Memory:
    """Counts of parts seen so far, by hash; emptied when it holds too many."""

    def __init__(self, model: str, most: int = REMEMBERED):
        self.model, self.most = model, most
        self.hashes, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def counts_of(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        hashes, first, back = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        if len(self.hashes) > self.most:
            self.hashes, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        at = np.searchsorted(self.hashes, hashes)
        known = np.zeros(len(hashes), bool)
        inside = at < len(self.hashes)
        known[inside] = self.hashes[at[inside]] == hashes[inside]
        counts = np.zeros(len(hashes), np.int64)
        counts[known] = self.counts[at[known]]
        new = np.flatnonzero(~known)
        if len(new):
            raw, s, e = data.tobytes(), starts[first[new]].tolist(), ends[first[new]].tolist()
            counts[new] = count_parts([raw[a:b].decode("utf-8", "replace") for a, b in zip(s, e)], self.model)
            self.counts = np.insert(self.counts, at[new], counts[new])
            self.hashes = np.insert(self.hashes, at[new], hashes[new])
        return counts[back.reshape(-1)]


def token_counts(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", model: str | None = None,
                 limit: int = 4096) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every whole text, as the SentencePiece library counts a BPE model.

    Texts are cut where no piece can reach across, each distinct part is merged once: batches of parts are ragged
    arrays of symbols, and every step merges the leftmost lowest-rank pair of each of them at once; what
    survives is counted, characters outside the vocabulary by their bytes. Parts of over 256 symbols take
    the same merges from a heap. A worker remembers the counts of half a million parts at most.

    A null text is empty (0 bytes, 0 tokens). Ids may be null or repeat: a row in gives a row out. Other columns are
    not read. `model` is the file's path, the public 32,000-piece model by default; it must be the
    same place on all executors.
    """
    path = model or bundled_model()
    schema = docs.select(id_column).schema
    kind = schema[0].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory, alone = _Memory(path), piece_table(path).alone
        for batch in batches:
            sizes, tokens = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for row, end, data, offsets in utf8_slices(batch.column(1)):
                sizes[row:end] = np.diff(offsets)
                data, offsets = spaced(data, offsets)
                rows, starts, ends = pre_tokens(data, offsets, alone)
                if len(rows):
                    tokens[row:end] = np.bincount(rows, memory.counts_of(data, starts, ends), end - row).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), pa.array(tokens), pa.array(tokens > limit)],
                                             names=[id_column, "n_bytes", "n_tokens", "over_limit"])

    return docs.select(id_column, text_column).mapInArrow(
        count, f"`{id_column}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
