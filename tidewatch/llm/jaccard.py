"""N-gram Jaccard self-join by forests of signature trees.

A pair of sets of sizes a >= b with overlap of at least num/den of their union differs in at most
2a(den-num)/(den+num) elements. Cut the space of shingle hashes into one range more than that: some range then
holds the same elements in both; with a few ranges more, one that isn't empty. So the upper nodes of the forest are
(size range, hash range, its content): two documents that share no such node can't overlap enough and never meet. Below, each node's
documents form a signature tree of OR-combined bitmaps and size ranges, and pairs of tree nodes are walked
down together as long as their largest possible overlap suffices.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.graph import components
from tidewatch.llm.text import SPACE, free_names, gram_hashes, mix, row_bounds, span_hashes, spans, utf8_slices
from tidewatch.session import discard, staged

BLOCK = 512  # documents of a block of one tree, about; larger trees are many blocks, compared pairwise
BLOCK_SHINGLES = 1 << 19  # 8 bytes each; so many more make another block
TWIG = 16  # documents under a lowest inner node
BROADCAST_IDS = 500_000  # so many ids (8 bytes each) are sent to all tasks at most
CUT_KEYS = 1 << 18  # keys of upper nodes that a task deals out at a time; about 100 bytes each while it does
BUCKET_KEYS = 1 << 19  # keys that meet in one task, about
SET_BYTES = 1 << 20  # of texts whose sets a task holds at a time, about; a longer text is held alone
_MIN_BITS = 512
FINE, ROUGH = 4, 2  # bits per shingle of the bitmaps that decide and of those that only rank


# --- one document ---------------------------------------------------------------------------

def shingle_set(words: np.ndarray, n: int) -> np.ndarray:
    """Ordered distinct hashes of n-word shingles; fewer words are one shingle, none give none."""
    if not len(words):
        return words
    return np.unique(gram_hashes(words, min(n, len(words))))


def size_bands(num: int, den: int, most: int) -> np.ndarray:
    """First sizes of the size ranges; each is wide enough that partners lie in neighbouring ones."""
    edges, step = [1], max(1.4, den / num)
    while edges[-1] <= most:
        edges.append(max(edges[-1] + 1, int(np.ceil(edges[-1] * step))))
    return np.array(edges, np.int64)


@lru_cache(1024)
def hash_ranges(low: int, high: int, num: int, den: int) -> tuple[int, int]:
    """(ranges, spare) of the size range from `low` up to `high`: `spare` more ranges than needed, so partners agree on one more than that.

    So many that few documents, the smaller partners included, have more empty ones.
    """
    needed, least = 2 * (high - 1) * (den - num) // (den + num) + 1, low * num / den
    for spare in range(needed):
        empty = (needed + spare) * np.exp(-least / (needed + spare))
        if empty + 2.5 * np.sqrt(empty) <= spare + 0.5:
            return needed + spare, spare
    return needed, 0


def routes(shingles: np.ndarray, num: int, den: int, bands: np.ndarray) -> np.ndarray:
    """The upper nodes a document hangs under: in its own size range, and in the next as a smaller partner.

    Partners agree on more hash ranges than `spare`, so if one of them has no more empty ones they agree on one that isn't. Only documents
    with more hang under empty ranges, which hold whatever has nothing there.
    """
    size = len(shingles)
    own = int(np.searchsorted(bands, size, "right")) - 1
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(shingles))])
    out = []
    for band in (own, own + 1):
        if band > own and size * den // num < bands[band]:
            break
        ranges, spare = hash_ranges(int(bands[band]), int(bands[band + 1]), num, den)
        starts = (np.arange(1, ranges, dtype=np.float64) * (2.0 ** 64 / ranges)).astype(np.uint64)
        cut = np.concatenate([[0], np.searchsorted(shingles, starts), [size]])
        content = total[cut[1:]] - total[cut[:-1]]
        place = np.arange(ranges, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((band + 1) * 0x51ED27)
        nodes = mix(content + mix(place + np.diff(cut).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
        full = np.diff(cut) > 0
        out.append(nodes[full] if ranges - full.sum() <= spare else nodes)
    return np.concatenate(out)


def bitmap(shingles: np.ndarray, share: int = FINE) -> bytes:
    """One bit per shingle in a power-of-two number of bits, `share` per shingle or more."""
    bits = max(_MIN_BITS * share // FINE, 1 << int(share * len(shingles) - 1).bit_length())
    out = np.zeros(bits, np.uint8)
    out[(mix(shingles) & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(out, bitorder="little").tobytes()


def parity(shingles: np.ndarray) -> bytes:
    """One bit per cell of the shingles' hashes, set if their number is odd; a power of two of cells, about one per shingle.

    Cells that differ between two sets hold a shingle that only one of them has, so they bound how far the sets differ from below.
    """
    cells = max(64, 1 << (3 * len(shingles) // 4).bit_length())
    odd = np.bincount((mix(shingles) & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def class_number(shingles: np.ndarray) -> int:
    """A 64-bit number of the set: equal for equal sets, else different but for chance (2^-64 a pair)."""
    both = np.array([np.sum(mix(shingles)), np.bitwise_xor.reduce(mix(shingles ^ np.uint64(0xA5A5A5A5A5A5A5A5)))], np.uint64)
    return int(mix(both[:1] * np.uint64(3) + mix(both[1:]) + np.uint64(len(shingles)))[0].astype(np.int64))


def _document_sets(texts: pa.Array, n: int) -> Iterator[np.ndarray]:
    for row, end, data, offsets in utf8_slices(texts):
        rows, starts, ends = spans(data, offsets, SPACE)
        hashes, bounds = span_hashes(data, starts, ends, lower=True), row_bounds(rows, end - row)
        for k in range(end - row):
            yield shingle_set(hashes[bounds[k]:bounds[k + 1]], n)


def _parts(texts: pa.Array, most: int) -> Iterator[pa.Array]:
    """The texts in order, in runs of about `most` bytes."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    cuts = np.append(np.flatnonzero(np.diff(ends // most)) + 1, len(texts))
    for start, end in zip(np.append(0, cuts[:-1]), cuts):
        yield texts.slice(start, end - start)


def _signatures(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """(row, doc_id, n_shingles, set_no, keys): `row` numbers the rows; it holds once the table is written."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            sizes, numbers, keys = [], [], []
            for s in _document_sets(batch.column(1), n):
                sizes.append(len(s))
                numbers.append(class_number(s) if len(s) else None)
                keys.append(routes(s, num, den, size_bands(num, den, 2 * len(s) + 2)).astype(np.int64) if len(s) else None)
            rows = np.arange(row, row + batch.num_rows)
            row += batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows), batch.column(0), pa.array(sizes, pa.int64()), pa.array(numbers, pa.int64()), pa.array(keys, pa.list_(pa.int64()))],
                names=["row", "doc_id", "n_shingles", "set_no", "keys"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(work, f"row long, doc_id {kind}, n_shingles long, set_no long, keys array<long>")


def deal(keys: np.ndarray, rows: np.ndarray, buckets: int) -> Iterator[tuple[int, int, bool, bytes, bytes]]:
    """(bucket, upper part of the row numbers, known, keys, lower 16 bits of the row numbers), ten bytes per key.

    Keys that occur twice here are known to be shared and only pass through; one of each still meets those of other tasks, so that no
    key fills its bucket.
    """
    order = np.argsort(keys, kind="stable")
    keys, rows = keys[order], rows[order]
    new = np.append(True, keys[1:] != keys[:-1])
    twice = ~new | np.append(~new[1:], False)
    chunk = rows >> 16
    for known, chosen in ((False, new), (True, twice)):
        k, r, c = keys[chosen], rows[chosen], chunk[chosen]
        # Known ones need no meeting and are dealt by their rows.
        bucket = ((mix((c if known else k).astype(np.int64).view(np.uint64)) >> np.uint64(8)) % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((c, bucket))
        k, r, c, bucket = k[order], r[order], c[order], bucket[order]
        starts = np.flatnonzero(np.append(True, (bucket[1:] != bucket[:-1]) | (c[1:] != c[:-1]))) if len(k) else []
        for a, b in zip(starts, np.append(starts[1:], len(k))):
            yield int(bucket[a]), int(c[a]), known, k[a:b].tobytes(), (r[a:b] & 0xFFFF).astype(np.uint16).tobytes()


def dealt(batches: Iterator[pa.RecordBatch], buckets: int, most: int) -> Iterator[pa.RecordBatch]:
    """What `deal` makes of batches of (row, keys), about `most` keys at a time, however many a row has."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.binary())

    def out() -> Iterator[pa.RecordBatch]:
        pieces = deal(*map(np.concatenate, zip(*held)), buckets) if held else iter(())
        held.clear()
        while some := list(islice(pieces, 4096)):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some), kinds)],
                                             names=["bucket", "chunk", "known", "keys", "places"])

    for batch in batches:
        lists = batch.column(1)
        n = lists.value_lengths().to_numpy(zero_copy_only=False)
        keys, rows = lists.flatten().to_numpy(zero_copy_only=False), np.repeat(batch.column(0).to_numpy(), n)
        for k in range(0, len(keys), most):
            held.append((keys[k:k + most], rows[k:k + most]))
            if sum(len(some) for some, _ in held) >= most:
                yield from out()
    yield from out()


def _shared_keys(signatures: DataFrame) -> DataFrame:
    """(key, row) of the keys that several rows of `signatures` (row, keys) have; repeated at most by what one task found twice."""
    entries = signatures.agg(F.sum(F.size("keys"))).first()[0] or 0
    buckets = entries // BUCKET_KEYS + 1
    schema = "bucket long, chunk long, known boolean, keys binary, places binary"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return dealt(batches, buckets, CUT_KEYS)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, rows = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for batch in batches:
            for chunk, known, found, places in zip(*(c.to_pylist() for c in batch.columns[1:])):
                k, r = np.frombuffer(found, np.int64), (chunk << 16) + np.frombuffer(places, np.uint16).astype(np.int64)
                if known:
                    yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(r)], names=["key", "row"])
                else:
                    keys.append(k)
                    rows.append(r)
        key, row = np.concatenate(keys), np.concatenate(rows)
        order = np.argsort(key, kind="stable")
        key, row = key[order], row[order]
        same = key[1:] == key[:-1]
        shared = np.append(same, False) | np.append(False, same) if len(key) else np.zeros(0, bool)
        yield pa.RecordBatch.from_arrays([pa.array(key[shared]), pa.array(row[shared])], names=["key", "row"])

    pieces = signatures.select("row", "keys").mapInArrow(cut, schema).repartition(buckets, "bucket")
    return pieces.mapInArrow(meet, "key long, row long")


def _sets(docs: DataFrame, n: int) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts in (part for batch in batches for part in _parts(batch.column(1), SET_BYTES)):
            found = list(_document_sets(texts, n))
            yield pa.RecordBatch.from_arrays(
                [pa.array([class_number(s) if len(s) else None for s in found], pa.int64()),
                 pa.array([s.astype(np.int64) for s in found], pa.list_(pa.int64())),
                 *(pa.array([bitmap(s, share) if len(s) else None for s in found], pa.binary()) for share in (FINE, ROUGH)),
                 pa.array([parity(s) if len(s) else None for s in found], pa.binary())],
                names=["set_no", "shingles", "fine", "rough", "parity"])

    return docs.select("doc_id", "text").mapInArrow(work, "set_no long, shingles array<long>, fine binary, rough binary, parity binary")


# --- walking two trees ------------------------------------------------------------------------

class _Tree:
    """Documents of a block by component and size; `twigs` are inner nodes over TWIG of them.

    So a large component fills whole twigs, and pairs of those have nothing left to find.
    """

    def __init__(self, members: list[dict], bits: int):
        members = sorted(members, key=lambda m: (m["component"], m["n_shingles"], m["set_no"]))
        self.ids = np.array([m["set_no"] for m in members], np.int64)
        self.group = np.array([m["component"] for m in members], np.int64)
        self.size = np.array([m["n_shingles"] for m in members], np.int64)
        self.sets = [m["shingles"] for m in members] if "shingles" in members[0] else None
        self.map = np.stack([fold(m["bits"], bits) for m in members])
        # Shingles beyond one per bit: what a bitmap may hide at most.
        self.hidden = self.size - np.bitwise_count(self.map).sum(1).astype(np.int64)
        first = np.arange(0, len(members), TWIG)
        self.first = np.append(first, len(members))
        self.twig_map = np.bitwise_or.reduceat(self.map, first)
        self.twig_hidden = np.maximum.reduceat(self.hidden, first)
        low, high = np.minimum.reduceat(self.group, first), np.maximum.reduceat(self.group, first)
        self.twig_group, self.twig_mixed = low, low != high
        self.twig_least, self.twig_most = np.minimum.reduceat(self.size, first), np.maximum.reduceat(self.size, first)


def fold(bits: bytes, wanted: int) -> np.ndarray:
    """A bitmap brought to `wanted` bits by OR of its halves."""
    words = np.frombuffer(bits, np.uint64)
    while len(words) * 64 > wanted:
        half = len(words) // 2
        words = words[:half] | words[half:]
    return words


def walk(left: list[dict], right: list[dict] | None, num: int, den: int) -> Iterator[tuple[_Tree, _Tree, np.ndarray, np.ndarray, np.ndarray]]:
    """(tree, tree, places, places, spare): members of different components that may overlap enough, and by how much more than needed.

    From two trees, or one with itself; a pair of twigs at a time, so the pairs held are few.
    """
    bits = min(len(m["bits"]) for m in (*left, *(right or ()))) * 8
    a = _Tree(left, bits)
    b = _Tree(right, bits) if right is not None else a
    for i in range(len(a.twig_map)):
        js = np.arange(i if right is None else 0, len(b.twig_map))
        # Largest possible overlap of anything under the two nodes, against the least that is needed.
        most = np.bitwise_count(a.twig_map[i] & b.twig_map[js]).sum(1).astype(np.int64) + np.minimum(a.twig_hidden[i], b.twig_hidden[js])
        need = np.maximum(a.twig_least[i], b.twig_least[js]) * num
        near = (a.twig_least[i] * num <= b.twig_most[js] * den) & (b.twig_least[js] * num <= a.twig_most[i] * den)
        open_ = a.twig_mixed[i] | b.twig_mixed[js] | (b.twig_group[js] != a.twig_group[i])
        for j in js[open_ & near & (most * den >= need)]:
            x, y = slice(a.first[i], a.first[i + 1]), slice(b.first[j], b.first[j + 1])
            shared = np.bitwise_count(a.map[x][:, None, :] & b.map[y][None, :, :]).sum(2).astype(np.int64)
            bound = shared + np.minimum(a.hidden[x][:, None], b.hidden[y][None, :])
            spare = (den + num) * bound - num * (a.size[x][:, None] + b.size[y][None, :])
            good = spare >= 0
            good &= a.group[x][:, None] != b.group[y][None, :]
            p, q = np.nonzero(good)
            if right is None and j == i:
                p, q = p[p < q], q[p < q]
            if len(p):
                yield a, b, p + a.first[i], q + b.first[j], spare[p, q]


def partnered(left: list[dict], right: list[dict] | None, num: int, den: int) -> set[int]:
    """The members whose parities (`bits`) leave it open that they link to one of another component; of two blocks, or one with itself."""
    def by_width(members: list[dict]) -> dict[int, tuple[np.ndarray, ...]]:
        out: dict[int, list[dict]] = {}
        for m in members:
            out.setdefault(len(m["bits"]), []).append(m)
        return {width: (*(np.array([m[c] for m in some], np.int64) for c in ("set_no", "component", "n_shingles")),
                        np.stack([np.frombuffer(m["bits"], np.uint64) for m in some])) for width, some in out.items()}

    def narrowed(cells: np.ndarray, words: int) -> np.ndarray:
        while cells.shape[1] > words:
            half = cells.shape[1] // 2
            cells = cells[:, :half] ^ cells[:, half:]
        return cells

    out: set[int] = set()
    ours = by_width(left)
    theirs = by_width(right) if right is not None else ours
    for wide, (ids, group, size, cells) in ours.items():
        for other, (other_ids, other_group, other_size, other_cells) in theirs.items():
            if right is None and other < wide:
                continue
            words = min(wide, other) // 8
            a, b = narrowed(cells, words), narrowed(other_cells, words)
            for k in range(0, len(ids), TWIG):
                x = slice(k, k + TWIG)
                differ = np.bitwise_count(a[x][:, None, :] ^ b[None, :, :]).sum(2, dtype=np.int64)
                open_ = (differ * (den + num) <= (size[x][:, None] + other_size) * (den - num)) & (group[x][:, None] != other_group)
                out.update(ids[x][open_.any(1)].tolist(), other_ids[open_.any(0)].tolist())
    return out


def promising(left: list[dict], right: list[dict] | None, num: int, den: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each member's pair with most to spare, as (set, other, spare)."""
    kept = (np.zeros(0, np.int64),) * 3
    for a, b, p, q, spare in walk(left, right, num, den):
        kept = tuple(map(np.concatenate, zip(kept, (a.ids[p], b.ids[q], spare), (b.ids[q], a.ids[p], spare))))
        if len(kept[0]) > 8 * BLOCK:
            kept = _best(*kept)
    return _best(*kept)


def forest(left: list[dict], right: list[dict] | None, num: int, den: int) -> list[tuple[int, int]]:
    """Links that join the components of the members as far as any links do: one fewer than the components at most.

    Pairs are checked on their whole sets, those of two twigs at once, unless links found before have joined their components already.
    """
    above: dict[int, int] = {}

    def root(x: int) -> int:
        while above.get(x, x) != x:
            above[x] = x = above.get(above[x], above[x])
        return x

    out = []
    for a, b, ps, qs, _ in walk(left, right, num, den):
        tops = {g: root(g) for g in {*a.group[ps].tolist(), *b.group[qs].tolist()}}
        apart = np.array([tops[x] != tops[y] for x, y in zip(a.group[ps].tolist(), b.group[qs].tolist())])
        ps, qs = ps[apart], qs[apart]
        if not len(ps):
            continue
        linked = overlaps(a.sets, b.sets, ps, qs) * (den + num) >= (a.size[ps] + b.size[qs]) * num
        for p, q in zip(ps[linked].tolist(), qs[linked].tolist()):
            x, y = root(int(a.group[p])), root(int(b.group[q]))
            if x != y:
                above[x] = y
                out.append((int(a.ids[p]), int(b.ids[q])))
    return out


def overlaps(left: list[np.ndarray], right: list[np.ndarray], ps: np.ndarray, qs: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of left[p] and right[q], few sets in many pairs: one product of tables of what holds what."""
    rows, at_p = np.unique(ps, return_inverse=True)
    columns, at_q = np.unique(qs, return_inverse=True)
    sets = [left[p] for p in rows] + [right[q] for q in columns]
    _, place = np.unique(np.concatenate(sets), return_inverse=True)
    holds = np.zeros((len(sets), int(place.max()) + 1), np.float32)
    holds[np.repeat(np.arange(len(sets)), [len(s) for s in sets]), place] = 1.0
    shared = holds[:len(rows)] @ holds[len(rows):].T
    return shared[at_p, at_q].astype(np.int64)


def _best(a: np.ndarray, b: np.ndarray, spare: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((b, -spare, a))
    first = order[np.append(True, a[order][1:] != a[order][:-1])] if len(order) else order
    return a[first], b[first], spare[first]


def _members(block: pa.Scalar) -> list[dict] | None:
    """The members of a block; sets stay numpy arrays, and bitmaps are made of them where there are none."""
    if not block.is_valid:
        return None
    rows = block.values
    out = [dict(zip(("set_no", "component", "n_shingles"), row)) for row in zip(*[rows.field(c).to_pylist() for c in ("set_no", "component", "n_shingles")])]
    if "bits" in {f.name for f in rows.type}:
        for row, bits in zip(out, rows.field("bits").to_pylist()):
            row["bits"] = bits
    else:
        lists = rows.field("shingles")
        flat, cuts = lists.values.to_numpy(zero_copy_only=False).view(np.uint64), lists.offsets.to_numpy()
        for row, a, b in zip(out, cuts[:-1], cuts[1:]):
            row["shingles"] = flat[a:b]
            row["bits"] = bitmap(row["shingles"])
    return out


def _promising(blocks: DataFrame, num: int, den: int) -> DataFrame:
    """Each class's most promising pair (a, b) over all blocks."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                a, b, spare = promising(_members(batch.column(0)[k]), _members(batch.column(1)[k]), num, den)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(spare)], names=["a", "b", "spare"])

    pairs = blocks.select("left", "right").mapInArrow(work, "a long, b long, spare long")
    pairs = pairs.groupBy("a").agg(F.max_by("b", F.struct("spare", "b")).alias("b"))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _forests(blocks: DataFrame, sets: DataFrame, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) that join what is linked within each pair of blocks; and what was written for it.

    Trees of bitmaps tell which members may be linked to any other at all, a row for each; only their whole sets are brought to the pair
    of blocks and checked there.
    """
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                left, right = _members(batch.column(3)[k]), _members(batch.column(4)[k])
                hopeful: tuple[dict, dict] = ({}, {})
                for a, b, p, q, _ in walk(left, right, num, den):
                    for tree, places, side in ((a, p, 0), (b, q, int(right is not None))):
                        for i in np.unique(places).tolist():
                            hopeful[side][int(tree.ids[i])] = int(tree.group[i])
                found = [(side, number, group) for side in (0, 1) for number, group in hopeful[side].items()]
                if found:
                    at = [pa.array([batch.column(c)[k].as_py()] * len(found), pa.int64()) for c in range(3)]
                    yield pa.RecordBatch.from_arrays([*at, *(pa.array(c, pa.int64()) for c in zip(*found))], names=[*PAIR, "side", "set_no", "component"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                left, right = _members(batch.column(0)[k]), _members(batch.column(1)[k])
                found = forest(left, right, num, den) if left else []
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=["a", "b"])

    schema = ", ".join(f"{c} long" for c in (*PAIR, "side", "set_no", "component"))
    asked = staged(blocks.select(*PAIR, "left", "right").mapInArrow(ask, schema))
    known = sets.join(_numbers(asked, "set_no"), "set_no", "left_semi").select("set_no", "shingles")
    member = F.struct("set_no", "component", F.size("shingles").cast("long").alias("n_shingles"), "shingles")
    sides = [F.collect_list(F.when(F.col("side") == k, member)).alias(name) for k, name in enumerate(("left", "right"))]
    pairs = asked.join(known, "set_no").groupBy(*PAIR).agg(*sides)
    both = pairs.select("left", F.when(F.size("right") > 0, F.col("right")).alias("right"))
    return both.mapInArrow(check, "a long, b long"), asked


PAIR = ("key", "block", "other")


# --- the join -----------------------------------------------------------------------------------

def _linked(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose sets overlap enough: the exact check.

    Pairs are numbers and go to the sets of their `a`; only those sets move, once, to the sets of `b`.
    """
    pairs = staged(pairs)
    left = sets.select(F.col("set_no").alias("a"), F.col("shingles").alias("_a")).join(_small(pairs), "a")
    right = sets.join(_numbers(pairs, "b"), "set_no", "left_semi").select(F.col("set_no").alias("b"), F.col("shingles").alias("_b"))
    shared = F.size(F.array_intersect("_a", "_b"))
    found = staged(left.join(right, "b").where(shared * (den + num) >= (F.size("_a") + F.size("_b")) * num).select("a", "b"))
    discard(pairs)
    return found


def _small(written: DataFrame) -> DataFrame:
    """A written table of one or two numbers a row, to be broadcast if it has at most BROADCAST_IDS rows."""
    return F.broadcast(written) if written.count() <= BROADCAST_IDS else written


def _numbers(written: DataFrame, column: str) -> DataFrame:
    """(set_no) of a column of a written table, to be broadcast if there are at most BROADCAST_IDS; repeated if the table is as short."""
    numbers = written.select(F.col(column).alias("set_no"))
    return F.broadcast(numbers) if written.count() <= BROADCAST_IDS else _small(staged(numbers.distinct()))


def _mixed(placed: DataFrame) -> DataFrame:
    """(key, blocks) of the upper nodes in `placed` that hold several components, written; of nodes that hold the same classes one is enough."""
    held = [F.sum(F.xxhash64(F.lit(k), "set_no").cast("decimal(20,0)")).alias(f"h{k}") for k in (1, 2)]  # two sums of hashes tell
    weight = F.count("*") / float(BLOCK) + F.sum("n_shingles") / float(BLOCK_SHINGLES)
    mixed = placed.groupBy("key").agg(F.min("component").alias("p"), F.max("component").alias("q"), F.count("*").alias("rows"),
                                      F.ceil(weight).cast("long").alias("blocks"), *held).where("p < q")
    return staged(mixed.groupBy("rows", "h1", "h2").agg(F.min("key").alias("key"), F.max("blocks").alias("blocks")).select("key", "blocks"))


def _paired(placed: DataFrame, mixed: DataFrame, sets: DataFrame, bits: str) -> tuple[DataFrame, list[DataFrame]]:
    """(key, block, other, left, right): the members of `mixed` nodes with their `bits`, as blocks to be compared; and what was written for it.

    A block holds about BLOCK members and BLOCK_SHINGLES shingles at most. Nodes of one block go straight to their comparison. Of others,
    pairs of blocks are a table of numbers, to which each block is joined on its own, so no key stands for more than one block.
    """
    few = mixed.count() <= BROADCAST_IDS

    def trees(chosen: DataFrame) -> DataFrame:
        members = placed.join(F.broadcast(chosen) if few else chosen, "key").join(sets.select("set_no", F.col(bits).alias("bits")), "set_no").select(
            "key", "blocks", F.pmod(F.xxhash64("set_no"), F.col("blocks")).alias("block"), F.struct("set_no", "component", "n_shingles", "bits").alias("m"))
        return members.groupBy("key", "blocks", "block").agg(F.collect_list("m").alias("left"), F.min("m.component").alias("p"), F.max("m.component").alias("q"))

    def alone(some: DataFrame) -> DataFrame:
        return some.where("p < q").select("key", "block", F.col("block").alias("other"), "left", F.lit(None).cast(some.schema["left"].dataType).alias("right"))

    single = alone(trees(mixed.where("blocks = 1")))
    if mixed.where("blocks > 1").isEmpty():
        return single, []
    many = staged(trees(mixed.where("blocks > 1")))
    met = many.select("key", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")).where("block < other")
    other = many.select("key", F.col("block").alias("other"), F.col("left").alias("right"), F.col("p").alias("op"), F.col("q").alias("oq"))
    across = met.join(many, ["key", "block"]).join(other, ["key", "other"]).where("NOT (p = q AND op = oq AND p = op)").select(*PAIR, "left", "right")
    return single.unionByName(alone(many)).unionByName(across), [many]


def _partnered(blocks: DataFrame, num: int, den: int) -> DataFrame:
    """(key, set_no) of the members that parities don't tell from all members of other components; once for each pair of blocks."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, numbers = [], []
            for k in range(batch.num_rows):
                found = partnered(_members(batch.column(1)[k]), _members(batch.column(2)[k]), num, den)
                keys += [batch.column(0)[k].as_py()] * len(found)
                numbers += found
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(numbers, pa.int64())], names=["key", "set_no"])

    return blocks.select("key", "left", "right").mapInArrow(work, "key long, set_no long")


def _blocks(nodes: DataFrame, grouped: DataFrame, sets: DataFrame, bits: str, num: int, den: int) -> tuple[DataFrame, list[DataFrame]]:
    """(key, block, other, left, right): the trees of all upper nodes that hold several components, as blocks to be walked together; and
    what was written for it.

    Each member is in many nodes, so its bitmap goes only to those where parities, a quarter of its size, leave it a partner.
    """
    placed = staged(nodes.select("key", "set_no", "n_shingles").join(_small(grouped).withColumnRenamed("node", "set_no"), "set_no", "left").select(
        "key", "set_no", "n_shingles", F.coalesce("component", "set_no").alias("component")))
    mixed = _mixed(placed)
    slim, written = _paired(placed, mixed, sets, "parity")
    thin = staged(placed.join(_partnered(slim, num, den), ["key", "set_no"], "left_semi"))
    discard(placed, mixed, *written)
    mixed = _mixed(thin)
    blocks, written = _paired(thin, mixed, sets, bits)
    return blocks, [thin, mixed, *written]


def _joined(grouped: DataFrame, links: DataFrame) -> DataFrame:
    """Links (a, b) that join the nodes of `grouped` (node, component) and whatever `links` (a, b) join further: few steps from any node to its least."""
    groups = _small(grouped)
    for end in ("a", "b"):
        links = links.join(groups.select(F.col("node").alias(end), "component"), end, "left").withColumn(end, F.coalesce("component", end)).drop("component")
    return links.select("a", "b").unionByName(grouped.select(F.col("node").alias("a"), F.col("component").alias("b")))


def _row_groups(docs: DataFrame, n: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """Signatures per row (doc_id, n_shingles, set_no), and per class (set_no, first_id, rows, component)."""
    full = staged(_signatures(docs, n, num, den))
    signatures = staged(full.drop("keys"))
    keyed = signatures.where(F.col("set_no").isNotNull())
    # One row stands for its class.
    first = keyed.groupBy("set_no").agg(F.min("row").alias("first"), F.count("*").alias("n")).where("n > 1").select("set_no", "first")
    copies = staged(keyed.join(first, "set_no").where("row <> first").select("row"))
    shared = staged(_shared_keys(full.where(F.col("set_no").isNotNull()).join(_small(copies), "row", "left_anti")))
    discard(full, copies)
    nodes = staged(shared.join(keyed.select("row", "set_no", "n_shingles"), "row").select("key", "set_no", "n_shingles").distinct())
    discard(shared)
    classes = keyed.groupBy("set_no").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("rows"))
    needed = staged(nodes.select("set_no").distinct().join(classes, "set_no").select("set_no", "first_id"))
    ids = staged(needed.where(F.col("first_id").isNotNull()).select(F.col("first_id").alias("doc_id")))
    sets = _sets(docs.select("doc_id", "text").join(_small(ids), "doc_id", "left_semi"), n).where(F.col("set_no").isNotNull())
    nameless = needed.where(F.col("first_id").isNull()).select("set_no")
    if not nameless.isEmpty():  # classes of rows without doc_id only: they may link others
        found = _sets(docs.where(F.col("doc_id").isNull()), n)
        sets = sets.unionByName(found.join(nameless, "set_no", "left_semi").dropDuplicates(["set_no"]))
    sets = staged(sets)
    discard(needed, ids)

    leaders = nodes.groupBy("key").agg(F.min("set_no").alias("leader"))
    often = nodes.join(leaders, "key").where(F.col("set_no") != F.col("leader")).groupBy("set_no", "leader").count()
    tried = often.groupBy("set_no").agg(F.max_by("leader", F.struct("count", "leader")).alias("leader"))
    links = _linked(tried.select(F.col("set_no").alias("a"), F.col("leader").alias("b")), sets, num, den)
    grouped = staged(components(links))
    discard(links)
    for whole in (False, True):
        blocks, written = _blocks(nodes, grouped, sets, "fine" if whole else "rough", num, den)
        if whole:
            forests, asked = _forests(blocks, sets, num, den)
            found = staged(forests)
            discard(asked)
        else:
            found = _linked(_promising(blocks, num, den), sets, num, den)
        former, grouped = grouped, staged(components(_joined(grouped, found)))
        discard(former, found, *written)
    discard(nodes, sets)
    linked = _small(grouped).withColumnRenamed("node", "set_no")
    return signatures, classes.join(linked, "set_no", "left").select("set_no", "first_id", "rows", "component")


def jaccard_components(docs: DataFrame, n: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id) per row of `docs` (doc_id, text): components of the n-gram Jaccard join.

    Words are runs of characters other than space and U+0009 to U+000D, A-Z lower-cased. A set holds the distinct
    n-word shingles; with fewer words the whole sequence is one. Documents link when den * intersection >= num *
    union. component_id is the smallest doc_id reachable by links. Without words or text a set is empty (size
    0), links with nothing and is its own component. A row without doc_id keeps its size, names no component but may
    join one; rows repeating an id are documents of their own. Other columns are not read.

    Equal sets are one class from the start, and one row of each brings its keys of upper nodes. Keys are dealt out by their hash, ten
    bytes each, and those that only one class has, nearly all, end where they meet. Each remaining class is
    tried against the class that leads most of its nodes; from then on only nodes that still hold several
    components matter, so large groups of near copies don't meet pairwise. Those nodes' trees are walked twice: first
    each class's most promising pair is checked, then, in nodes that still hold several components, each pair of
    blocks names the members that may be linked, and their whole sets give a forest of checked links, fewer than its members. No link between
    different components is lost; links within a component aren't all tried.
    """
    signatures, classes = _row_groups(docs, n, num, den)
    merged = staged(classes)
    smallest = merged.where(F.col("component").isNotNull()).groupBy("component").agg(F.min("first_id").alias("component_id"))
    in_group = merged.join(smallest, "component").select("set_no", "component_id").unionByName(
        merged.where(F.col("component").isNull() & (F.col("rows") > 1)).select("set_no", F.col("first_id").alias("component_id")))
    return signatures.select("doc_id", "n_shingles", "set_no").join(in_group, "set_no", "left").select(
        "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def distinct_documents(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of `docs` with one row of each component left: the smallest doc_id, rows without one last, then the smallest hash of the text.

    Rows without words or text link with nothing and all stay. Of equal rows one stays. Rows that repeat an id are told
    apart by their texts. All columns are kept, whatever their names.
    """
    signatures, classes = _row_groups(docs.select("doc_id", "text"), n, num, den)
    group = classes.select("set_no", F.coalesce("component", "set_no").alias("group"))
    rows = signatures.where(F.col("set_no").isNotNull()).select("doc_id", "set_no").join(group, "set_no")
    # The class of the component's least row, then that class's rows among the documents.
    place = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "set_no")
    best = rows.groupBy("group").agg(F.min(place).alias("best")).select("best.doc_id", "best.set_no")
    kept, number = free_names(docs, "_kept", "_class")

    @F.arrow_udf("long")
    def class_of(texts: pa.Array) -> pa.Array:
        return pa.array([class_number(s) if len(s) else None for s in _document_sets(texts, n)], pa.int64())

    # Called nondeterministic so that Spark asks it once a text: it would move a condition on its result to a call of its own.
    named = docs.withColumn(number, class_of.asNondeterministic()("text"))
    chosen = staged(best.select(F.col("doc_id").alias(kept), F.col("set_no").alias(number)))
    same = (F.col("doc_id").eqNullSafe(F.col(kept))) & (named[number] == chosen[number])
    found = named.join(chosen, same, "left_semi").dropDuplicates(["doc_id", number])
    return found.unionByName(named.where(F.col(number).isNull())).drop(number)


