"""SentencePiece encoding by lattices of words, and decoding."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.pieces import MARK, PieceTable, bundled_model, piece_table, pre_tokens, spaced
from tidewatch.llm.text import row_bounds, span_hashes, utf8_slices

FREQUENT = 200_000  # solved words that a task keeps for its later texts at most (about 30 bytes each)
CHARS = 1 << 15  # characters whose edges are held at a time (200 bytes or so each)
IDS = 1 << 18  # ids that are decoded at a time
BYTE_SCORE = -12_000_000
_NONE = -(1 << 61)  # no edge; two of them still fit


def piece_scores(table: PieceTable) -> pd.DataFrame:
    """(piece, id, piece_score). Ranks of a BPE model's pieces become log probabilities by Zipf's law, in whole millionths."""
    return pd.DataFrame({"piece": table.pieces, "id": table.ids,
                         "piece_score": [-round(float(np.log(table.rank[p] + 2.0)) * 1e6) for p in table.pieces]})


# --- the lattice ---------------------------------------------------------------------------------------

@dataclass(frozen=True)
class _Begun:
    """All beginnings of pieces, numbered so that `steps`, node * len(chars) + place of the next character, are ordered: step k leads to node k + 1."""
    chars: np.ndarray
    steps: np.ndarray
    ids: np.ndarray  # of the piece that a node spells, or -1
    scores: np.ndarray
    longest: int

    @staticmethod
    def of(table: PieceTable) -> _Begun:
        scores = piece_scores(table)
        known = dict(zip(scores["piece"], zip(scores["id"], scores["piece_score"])))
        chars = sorted(set("".join(table.pieces)))
        place = {c: k for k, c in enumerate(chars)}
        longest = max(map(len, table.pieces))
        nodes, level, steps = [""], {"": 0}, []
        for n in range(1, longest + 1):
            found = sorted((level[b[:-1]] * len(chars) + place[b[-1]], b) for b in {p[:n] for p in table.pieces if len(p) >= n})
            level = {b: len(nodes) + k for k, (_, b) in enumerate(found)}
            nodes += [b for _, b in found]
            steps += [s for s, _ in found]
        spelled = [known.get(b, (-1, _NONE)) for b in nodes]
        return _Begun(np.array([ord(c) for c in chars]), np.array([*steps, np.iinfo(np.int64).max]), np.array([i for i, _ in spelled], np.int32),
                      np.array([s for _, s in spelled], np.int64), longest)

    def edges(self, chars: np.ndarray, limit: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """(score, id) of the edges of up to `most` characters that end with each one, longest first; a character in no piece is an edge of its
        bytes, id -1 - character.

        `limit` is the end of each character's word.
        """
        scores, ids = np.full((len(chars), most), _NONE), np.zeros((len(chars), most), np.int32)
        place = np.minimum(np.searchsorted(self.chars, chars), len(self.chars) - 1)
        place = np.where(self.chars[place] == chars, place, -1)
        start, node = np.arange(len(chars)), np.zeros(len(chars), np.int64)
        for length in range(1, most + 1):
            inside = start + length <= limit[start]
            start, node = start[inside], node[inside]
            nxt = place[start + length - 1]
            step = node * len(self.chars) + nxt
            at = np.searchsorted(self.steps, step)
            found = (self.steps[at] == step) & (nxt >= 0)
            start, node = start[found], at[found] + 1
            piece = self.ids[node] >= 0
            last = start[piece] + length - 1
            scores[last, most - length], ids[last, most - length] = self.scores[node[piece]], self.ids[node[piece]]
        odd = np.flatnonzero(scores[:, -1] == _NONE)
        size = 1 + (chars[odd] > 0x7F).astype(np.int64) + (chars[odd] > 0x7FF) + (chars[odd] > 0xFFFF)
        scores[odd, -1], ids[odd, -1] = size * BYTE_SCORE, -1 - chars[odd]
        return scores, ids

    def forward(self, chars: np.ndarray, starts: np.ndarray, ends: np.ndarray, entry: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(length, id) of the best edge that ends with each character, and the last best scores of each word, as the next `entry`.

        Words [starts, ends) of `chars`, longest first, take one step together at each place. `entry` has the scores of the last places
        before each. Of equal scores the edge with the earlier start stays.
        """
        most = entry.shape[1]
        scores, ids = self.edges(chars, limit, most)
        lengths = ends - starts
        first = starts + np.arange(len(starts)) * most
        best = np.full(len(chars) + len(starts) * most, _NONE)
        best[first[:, None] + np.arange(most)] = entry
        windows = np.lib.stride_tricks.sliding_window_view(best, most)  # sees what is put into `best`
        back, chosen = np.ones(len(chars), np.int64), np.zeros(len(chars), np.int32)
        going = np.searchsorted(-lengths, -np.arange(lengths[0] + 1), "right")
        for p in range(int(lengths[0])):
            n = going[p + 1]
            at, row = first[:n] + p, starts[:n] + p
            reached = windows[at]
            reached += scores[row]
            k = reached.argmax(1)
            best[at + most] = reached[np.arange(n), k]
            back[row], chosen[row] = most - k, ids[row, k]
        return back, chosen, windows[first + lengths]

    def paths(self, chars: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many of each word) of the best paths through words, one after another in `chars`, longest first.

        A word beyond CHARS goes through in stretches of so many, each entered with the scores that the last one left.
        """
        out, counts, ends = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], np.cumsum(lengths)
        word = 0
        while word < len(lengths):
            begin = int(ends[word] - lengths[word])
            last = max(word + 1, int(np.searchsorted(ends, begin + CHARS, "right")))
            end = int(ends[last - 1])
            stops = ends[word:last] - begin
            starts = stops - lengths[word:last]
            if end - begin <= CHARS:
                most = min(self.longest, int(lengths[word]))
                back, ids, _ = self.forward(chars[begin:end], starts, stops, _origin(last - word, most), np.repeat(stops, lengths[word:last]))
            else:
                entry, stretches = _origin(1, self.longest), []
                for a in range(begin, end, CHARS):
                    b, before = min(a + CHARS, end), min(self.longest - 1, a - begin)
                    part = chars[a - before:b]
                    *found, entry = self.forward(part, np.array([before]), np.array([len(part)]), entry, np.full(len(part), len(part)))
                    stretches.append([f[before:] for f in found])
                back, ids = map(np.concatenate, zip(*stretches))
            on_path = np.zeros(end - begin, bool)
            at, origin = stops - 1, starts
            while len(at):
                on_path[at] = True
                at = at - back[at]
                inside = at >= origin
                at, origin = at[inside], origin[inside]
            out.append(ids[on_path])
            counts.append(np.add.reduceat(on_path, starts, dtype=np.int64))
            word = last
        return np.concatenate(out), np.concatenate(counts)


def _origin(words: int, most: int) -> np.ndarray:
    entry = np.full((words, most), _NONE)
    entry[:, -1] = 0
    return entry


@lru_cache(2)
def _begun(model: str) -> _Begun:
    return _Begun.of(piece_table(model))


def _with_bytes(ids: np.ndarray, counts: np.ndarray, byte_ids: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Ids and counts with characters in no piece as their bytes' pieces."""
    odd = ids < 0
    if not odd.any():
        return ids, counts
    chars = -1 - ids[odd].astype(np.int64)
    size = np.ones(len(ids), np.int64)
    size[odd] += (chars > 0x7F).astype(np.int64) + (chars > 0x7FF) + (chars > 0xFFFF)
    out, place = np.repeat(ids, size), np.repeat(odd, size)
    raw = "".join(map(chr, chars.tolist())).encode()
    out[place] = np.array(byte_ids, np.int32)[np.frombuffer(raw, np.uint8)]
    total = np.concatenate([[0], np.cumsum(size)])
    ends = np.cumsum(counts)
    return out, total[ends] - total[ends - counts]


def _gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places [start, start + length) one after another."""
    total = np.cumsum(lengths)
    return np.repeat(starts - total + lengths, lengths) + np.arange(total[-1] if len(total) else 0)


def encode_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, model: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, start, count of each word in them): best paths of the words [starts, ends) of UTF-8 `data`, spaces standing for marks."""
    seen = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    lengths = seen[ends] - seen[starts]
    order = np.argsort(-lengths, kind="stable")
    raw = data[_gather(starts[order], (ends - starts)[order])].tobytes().decode().replace(" ", MARK)
    chars = np.frombuffer(raw.encode("utf-32-le"), np.uint32).astype(np.int64)
    ids, counts = _with_bytes(*_begun(model).paths(chars, lengths[order]), piece_table(model).bytes)
    first, n = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
    first[order], n[order] = np.cumsum(counts) - counts, counts
    return ids, first, n


# --- documents -----------------------------------------------------------------------------------------

@dataclass(frozen=True)
class _Words:
    """Ordered hashes of solved words, and where their ids stand."""
    hashes: np.ndarray
    starts: np.ndarray
    counts: np.ndarray
    ids: np.ndarray

    @staticmethod
    def none() -> _Words:
        return _Words(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32))

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Where each hash is, or -1."""
        if not len(self.hashes):
            return np.full(len(hashes), -1, np.int64)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at, -1)

    def joined(self, hashes: np.ndarray, starts: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> _Words:
        """With further words, whose starts are places in `ids`."""
        own = ids[_gather(starts, counts)]
        every = np.concatenate([self.hashes, hashes])
        order = np.argsort(every)
        starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(counts) - counts])
        return _Words(every[order], starts[order], np.concatenate([self.counts, counts])[order], np.concatenate([self.ids, own]))


Batches = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def _encoder(keep: tuple[str, ...], path: str, frequent: int) -> Batches:
    """Batches of (keep..., and last the text) to such of (keep..., ids), a megabyte or one text at a time."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone, known = piece_table(path).alone, _Words.none()
        for batch in batches:
            for row, end, data, offsets in utf8_slices(batch.column(batch.num_columns - 1)):
                data, offsets = spaced(data, offsets)
                rows, starts, ends = pre_tokens(data, offsets, alone)
                hashes, first, word = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
                at = known.find(hashes)
                new, old = np.flatnonzero(at < 0), at >= 0
                ids, begins, counts = encode_words(data, starts[first[new]], ends[first[new]], path)
                begin, count = np.empty(len(hashes), np.int64), np.empty(len(hashes), np.int64)
                begin[old], count[old] = known.starts[at[old]], known.counts[at[old]]
                begin[new], count[new] = len(known.ids) + begins, counts
                lists = np.concatenate([known.ids, ids])[_gather(begin[word], count[word])]
                total = np.concatenate([[0], np.cumsum(count[word])])
                cuts = pa.array(total[row_bounds(rows, end - row)].astype(np.int32))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(row, end - row) for c in range(len(keep))),
                                                  pa.ListArray.from_arrays(cuts, pa.array(lists))], names=[*keep, "ids"])
                some = new[:max(0, frequent - len(known.hashes))]
                if len(some):
                    known = known.joined(hashes[some], begins[:len(some)], counts[:len(some)], ids)

    return work


def _decoder(keep: tuple[str, ...], path: str) -> Batches:
    """Batches of (keep..., and last the ids) to such of (keep..., decoded), about IDS ids at a time."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = piece_table(path)
        spelled = [b""] * (max(*table.ids, *table.bytes) + 2)  # the last one is for ids of no piece
        for i, piece in zip(table.ids, table.pieces):
            spelled[i] = piece.replace(MARK, " ").encode()
        for b, i in enumerate(table.bytes):
            spelled[i] = bytes([b])
        sizes, letters = np.array([len(s) for s in spelled]), np.frombuffer(b"".join(spelled), np.uint8)
        begins = np.cumsum(sizes) - sizes
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            ids = lists.flatten().fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            ids = np.where((ids >= 0) & (ids < len(sizes)), ids, len(sizes) - 1)
            bounds = np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)
            row = 0
            while row < batch.num_rows:
                end = max(row + 1, int(np.searchsorted(bounds, bounds[row] + IDS, "right")) - 1)
                own = ids[bounds[row]:bounds[end]]
                raw = letters[_gather(begins[own], sizes[own])].tobytes()
                cuts = np.concatenate([[0], np.cumsum(sizes[own])])[bounds[row:end + 1] - bounds[row]].tolist()
                texts = [raw[a + (raw[a:min(a + 1, b)] == b" "):b].decode("utf-8", "replace") for a, b in zip(cuts[:-1], cuts[1:])]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(row, end - row) for c in range(len(keep))), pa.array(texts, pa.string())],
                                                 names=[*keep, "decoded"])
                row = end

    return work


def _kinds(df: DataFrame, keep: tuple[str, ...]) -> str:
    return "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.select(*keep).schema)


def _with_text(docs: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """(keep..., text), the text once if `keep` ends with it."""
    return docs.select(*keep, *([] if keep[-1:] == ("text",) else [F.col("text").alias("_text")]))


def encode(docs: DataFrame, *keep: str, model: str | None = None, frequent: int = FREQUENT) -> DataFrame:
    """(keep..., ids): every whole text of `docs` (text) as piece ids of the best-scoring path, byte pieces where no piece fits.

    The library's texts: a space before, spaces as marks. Texts are cut where no piece can reach across. The different words of a
    megabyte of texts are solved together: all their substrings that are pieces are edges of lattices, found along the pieces'
    beginnings, and one step takes all words on by a character. A task keeps up to `frequent` solved words for its later
    texts, told by their 64-bit hashes. Neither texts nor words leave their task, so neither null nor repeated ids,
    copies or hot words matter. A null or empty text has an empty list. `model` is the
    vocabulary's path, the public 32,000 pieces by default, at the same place on all executors.
    """
    return _with_text(docs, keep).mapInArrow(_encoder(keep, model or bundled_model(), frequent), f"{_kinds(docs, keep)}ids array<int>")


def decode(rows: DataFrame, *keep: str, model: str | None = None) -> DataFrame:
    """(keep..., decoded): the texts of `ids`; a null list and an empty one are an empty text.

    Marks become spaces, byte pieces their bytes, and the space before the text goes. Ids of control pieces and ids outside the
    vocabulary decode to nothing; bytes that aren't UTF-8 become U+FFFD.
    """
    ids = [] if keep[-1:] == ("ids",) else [F.col("ids").alias("_ids")]
    return rows.select(*keep, *ids).mapInArrow(_decoder(keep, model or bundled_model()), f"{_kinds(rows, keep)}decoded string")


def round_trip(docs: DataFrame, *keep: str, model: str | None = None) -> DataFrame:
    """(doc_id, keep..., n_tokens, ids, same): each text's ids, and whether they decode to it (a mark comes back as a space).

    Encoded batches are decoded by the same Python process, so texts and ids cross to Python and back once.
    """
    path, kept = model or bundled_model(), ("doc_id", *keep, "text")
    encoder, decoder = _encoder(kept, path, FREQUENT), _decoder((*kept, "ids"), path)
    decoded = _with_text(docs, kept).mapInArrow(lambda batches: decoder(encoder(batches)), f"{_kinds(docs, kept)}ids array<int>, decoded string")
    plain = F.regexp_replace(F.coalesce("text", F.lit("")), MARK, " ")
    return decoded.select("doc_id", *keep, F.size("ids").cast("long").alias("n_tokens"), "ids", (F.col("decoded") == plain).alias("same"))
