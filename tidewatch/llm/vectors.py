"""Near-duplicate vectors by counting collisions of one-dimensional projections."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.graph import components
from tidewatch.session import staged

LEAST = 0.98
TABLES, DEPTH = 64, 10  # tables of sorted strips, projections that make up a strip's number
PROJECTIONS = 48  # projections whose windows are counted
SIGMAS = 2.0  # half a window, in deviations of a projected difference at the least similarity
STRIP = 5.0  # width of a strip, in the same unit
BLOCK = 512
STRIP_KEY = ("label", "table", "strip")
_SLACK = 1e-9


@lru_cache(4)
def _directions(width: int, seed: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit directions of the tables, offsets of their strips, and the directions that are counted."""
    rng = np.random.default_rng((seed, width))
    strips = rng.standard_normal((TABLES * DEPTH, width))
    counted = rng.standard_normal((PROJECTIONS, width))
    strips /= np.linalg.norm(strips, axis=1, keepdims=True)
    counted /= np.linalg.norm(counted, axis=1, keepdims=True)
    return strips, rng.random(TABLES * DEPTH), counted


def deviation(width: int, least: float) -> float:
    """Standard deviation of the projected difference of two unit vectors with cosine `least`."""
    return float(np.sqrt(2.0 * (1.0 - least) / width))


@lru_cache(8)
def wanted_count(projections: int = PROJECTIONS, sigmas: float = SIGMAS, recall: float = 1 - 1e-6) -> int:
    """How many window collisions a pair must reach: what a pair at the least similarity does with chance `recall`.

    Its collisions are binomial with p = P(|N(0, 1)| <= sigmas); closer pairs collide more often.
    """
    from math import comb, erf, sqrt

    p, missed = erf(sigmas / sqrt(2.0)), 0.0
    for k in range(projections + 1):
        missed += comb(projections, k) * p ** k * (1 - p) ** (projections - k)
        if missed > 1 - recall:
            return k
    return projections


def _strip_numbers(x: np.ndarray, least: float) -> np.ndarray:
    """One number per vector and table: which strip it lies in on each of the table's projections."""
    strips, offset, _ = _directions(x.shape[1])
    at = np.floor(x @ strips.T / (STRIP * deviation(x.shape[1], least)) + offset).astype(np.int64)
    at = at.reshape(len(x), TABLES, DEPTH)
    out = np.zeros((len(x), TABLES), np.uint64)
    for d in range(DEPTH):
        out = (out ^ at[:, :, d].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out.astype(np.int64)


def _unit(vectors: list) -> np.ndarray:
    x = np.asarray(vectors, np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _numbered(classes: DataFrame, least: float) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(1).to_pylist()
            by_width: dict[int, list[int]] = {}
            for k, v in enumerate(vectors):
                by_width.setdefault(len(v), []).append(k)
            out = np.zeros((len(vectors), TABLES), np.int64)
            for width, rows in by_width.items():
                out[rows] = _strip_numbers(_unit([vectors[k] for k in rows]), least)
            flat = pa.array(out.reshape(-1))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1, dtype=np.int32) * TABLES), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["class_id", "strips"])

    return classes.select("class_id", "vector").mapInArrow(work, "class_id long, strips array<long>")


def collisions(a: np.ndarray, b: np.ndarray, window: float) -> np.ndarray:
    """How many projections put each b into the window around each a: one sorted list per projection.

    a and b hold a row per vector and a column per projection. In each sorted list of b the window around
    an a is one run of ranks, so its collisions are marked by runs and summed over projections.
    """
    out = np.zeros((len(a), len(b)), np.int16)
    for k in range(a.shape[1]):
        order = np.argsort(b[:, k], kind="stable")
        ranked = b[order, k]
        low = np.searchsorted(ranked, a[:, k] - window, "left")
        high = np.searchsorted(ranked, a[:, k] + window, "right")
        rank = np.empty(len(b), np.int64)
        rank[order] = np.arange(len(b))
        out += (rank[None, :] >= low[:, None]) & (rank[None, :] < high[:, None])
    return out


def compare(table: int, left: list[dict], right: list[dict] | None, least: float) -> tuple[np.ndarray, ...]:
    """(class, linked rows) twice over and (class, class) edges for the linked pairs whose first common strip is `table`'s.

    A pair in common strips of several tables belongs to the first of them only, so it counts once.
    """
    a = sorted(left, key=lambda m: m["class_id"])
    b = a if right is None else sorted(right, key=lambda m: m["class_id"])
    x, y = _unit([m["vector"] for m in a]), _unit([m["vector"] for m in b])
    width = x.shape[1]
    counted = _directions(width)[2]
    close = collisions(x @ counted.T, y @ counted.T, SIGMAS * deviation(width, least)) >= wanted_count()
    if right is None:
        close &= np.triu(np.ones_like(close, bool), 1)
    p, q = np.nonzero(close)
    cosine = np.einsum("ij,ij->i", x[p], y[q])
    p, q = p[cosine >= least - _SLACK], q[cosine >= least - _SLACK]
    if len(p):
        sx, sy = _strip_numbers(x, least), _strip_numbers(y, least)
        earlier = np.zeros(len(p), bool)
        for k in range(0, len(p), 1 << 16):
            s = slice(k, k + (1 << 16))
            earlier[s] = (sx[p[s], :table] == sy[q[s], :table]).any(1)
        p, q = p[~earlier], q[~earlier]
    if len(p):
        exact = exact_cosine([a[i]["vector"] for i in p], [b[j]["vector"] for j in q]) >= least
        p, q = p[exact], q[exact]
    ida, idb = np.array([m["class_id"] for m in a], np.int64), np.array([m["class_id"] for m in b], np.int64)
    na, nb = np.array([m["rows"] for m in a], np.int64), np.array([m["rows"] for m in b], np.int64)
    links_a, links_b = np.bincount(p, nb[q], len(a)), np.bincount(q, na[p], len(b))
    ids = np.concatenate([ida[links_a > 0], idb[links_b > 0]])
    links = np.concatenate([links_a[links_a > 0], links_b[links_b > 0]]).astype(np.int64)
    tree = _forest(p, q, len(a), len(b), right is None)
    return ids, links, ida[p[tree]], idb[q[tree]]


def exact_cosine(a: list, b: list) -> np.ndarray:
    """Cosines in double precision, from the vectors as given."""
    a, b = np.asarray(a, np.float64), np.asarray(b, np.float64)
    return (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))


def _forest(p: np.ndarray, q: np.ndarray, na: int, nb: int, same: bool) -> np.ndarray:
    """Positions of pairs enough to connect what all pairs connect."""
    shift = 0 if same else na
    parent = list(range(na if same else na + nb))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    kept = []
    for k, (i, j) in enumerate(zip(p.tolist(), (q + shift).tolist())):
        i, j = find(i), find(j)
        if i != j:
            parent[j] = i
            kept.append(k)
    return np.array(kept, np.int64)


def _compared(pairs: DataFrame, least: float) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            none = [np.zeros(0, np.int64)] * 4
            found = [none] + [compare(batch.column(0)[k].as_py(), batch.column(1)[k].as_py(), batch.column(2)[k].as_py(), least)
                              for k in range(batch.num_rows)]
            ids, links, a, b = (np.concatenate(c) for c in zip(*found))
            empty = pa.nulls(len(a), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(links), pa.nulls(len(ids), pa.int64())], names=["a", "links", "b"])
            yield pa.RecordBatch.from_arrays([pa.array(a), empty, pa.array(b)], names=["a", "links", "b"])

    return pairs.select("table", "left", "right").mapInArrow(work, "a long, links long, b long")


def near_vectors(vectors: DataFrame, least: float = LEAST) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row of `vectors` (vec_id, embedding, label).

    Rows are compared where labels are equal and not null and embeddings equally long; they link when their
    cosine in double precision is at least `least` and the search finds them. Null or empty vectors, zero vectors and those
    with a null, NaN or infinite component link with nothing. n_links counts other rows linked directly, repeated
    rows each; component_id is the smallest vec_id reachable. A row without vec_id counts as a link of others
    and names no component itself (null, not kept); rows that repeat an id are rows of their own.

    Equal vectors of a label are one class with a row count. Each of 64 tables cuts the unit sphere into strips on 10
    projections with random offsets; vectors that share the strips of some table meet there (a pair at cosine 0.98
    does so with a chance of 1 - 5e-6 about, closer pairs more surely; unrelated ones in one of 300,000 per table, for
    64 components). Where they meet, 48 further projections are sorted and the windows around each
    vector counted; a pair with enough collisions (99.9999 % of pairs at the least similarity have them) is
    verified. Groups are blocks of about 512 rows, compared two by two, so no group sits in one task; results are
    link counts and the edges of a spanning forest, never all pairs.
    """
    wide = F.transform("embedding", lambda v: v.cast("double"))
    good = F.col("label").isNotNull() & (F.size("v") > 0) & F.forall(
        "v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("v", lambda c: c != 0.0)
    rows = staged(vectors.select("vec_id", "label", wide.alias("v")).select(
        "vec_id", F.when(F.coalesce(good, F.lit(False)), F.struct("label", F.col("v").alias("vector"))).alias("at")))
    valid = rows.where(F.col("at").isNotNull())
    # -0.0 and 0.0 are one number in a grouping.
    grouped = valid.groupBy("at").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("rows"))
    # Equal vectors share a class; its number must be unique and the same in every attempt.
    classes = staged(grouped.select(F.xxhash64("at").alias("class_id"), "at.label", "at.vector", "first_id", "rows"))
    # Only vectors of one label and one width meet.
    kind = F.struct("label", F.size("vector").alias("width")).alias("label")
    numbers = staged(_numbered(classes, least).join(classes.select("class_id", kind), "class_id"))
    strips = numbers.select("class_id", "label", F.posexplode("strips").alias("table", "strip"))
    busy = staged(strips.groupBy(*STRIP_KEY).agg(F.count("*").alias("n")).where("n > 1").select(
        *STRIP_KEY, F.ceil(F.col("n") / float(BLOCK)).cast("long").alias("blocks")))
    met = strips.join(busy, [*STRIP_KEY]).join(classes.select("class_id", "vector", "rows"), "class_id")
    trees = staged(met.groupBy(*STRIP_KEY, "blocks", F.pmod(F.xxhash64("class_id"), F.col("blocks")).alias("block")).agg(
        F.collect_list(F.struct("class_id", "rows", "vector")).alias("left")))
    alone = trees.select("table", "left", F.lit(None).cast(trees.schema["left"].dataType).alias("right"))
    many = trees.where("blocks > 1")
    # Pairs of blocks are a table of numbers, to which each block is joined on its own.
    pairs = many.select(*STRIP_KEY, "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")).where("block < other")
    right = many.select(*STRIP_KEY, F.col("block").alias("other"), F.col("left").alias("right"))
    across = pairs.join(many.drop("blocks"), [*STRIP_KEY, "block"]).join(right, [*STRIP_KEY, "other"]).select("table", "left", "right")
    found = staged(_compared(alone.unionByName(across), least))

    links = found.where(F.col("links").isNotNull()).groupBy(F.col("a").alias("class_id")).agg(F.sum("links").alias("links"))
    parts = components(found.where(F.col("b").isNotNull()).select("a", "b")).withColumnRenamed("node", "class_id")
    known = staged(classes.select("class_id", "first_id", "rows").join(links, "class_id", "left").join(parts, "class_id", "left").select(
        "class_id", "first_id", "rows", (F.coalesce("links", F.lit(0)) + F.col("rows") - 1).alias("n_links"),
        F.coalesce("component", "class_id").alias("component")))
    smallest = known.groupBy("component").agg(F.min("first_id").alias("component_id"))
    known = known.join(smallest, "component").where("n_links > 0").select("class_id", "n_links", "component_id")
    out = rows.select("vec_id", F.when(F.col("at").isNotNull(), F.xxhash64("at")).alias("class_id")).join(known, "class_id", "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component_id", "vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                      F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
