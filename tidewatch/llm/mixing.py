"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.session import staged

WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3.0  # a source's target, as a multiple of its size; so no document is taken more often
FOLD = 64  # documents or residuals that one fold takes on average
_BINS_PER_OCTAVE = 16
_SPAN = 4096  # ids of size bins below one source


def word_count(text: Column) -> Column:
    """Number of runs of characters other than space and U+0009 to U+000D; null counts 0."""
    flat = F.translate(text, "\t\n\x0b\x0c\r", " " * 5)
    return F.coalesce(F.size(F.array_remove(F.split(flat, " ", -1), "")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, most: float = MOST) -> DataFrame:
    """(source, source_size, target, rate): all sizes shared among sources by weight, at most `most` sizes each.

    Input has one row per document with `source` and `size`. Sources in code-point order, null last, take
    `weights` in turn. A target above its cap stops there and the excess is shared anew by weight until none
    is above; that fixed point is min(cap, level * weight) for one level, found here in closed form by running
    totals over sources ordered by cap / weight. Only the table of sources, one row each, is ordered. `rate` is
    target / source_size, the expected number of copies of each document (0 for a source without words).
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    k = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (k + 1).cast("int"))
    caps = sources.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * F.lit(most)).alias("cap"))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(0))
    run = caps.select("*", F.sum("source_size").over(whole).alias("total"), F.sum("weight").over(whole).alias("all_weight"),
                      F.coalesce(F.sum("cap").over(before), F.lit(0.0)).alias("cap_before"),
                      F.coalesce(F.sum("weight").over(before), F.lit(0.0)).alias("weight_before"))
    # What one unit of weight gets when all sources of smaller ratio stop at their caps.
    level = (F.col("total") - F.col("cap_before")) / (F.col("all_weight") - F.col("weight_before"))
    run = run.withColumn("level", level)
    free = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct("cap_before", "level"))).over(whole)
    run = run.withColumn("at", free["level"])
    target = F.when(F.col("at").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("at") * F.col("weight")))
    return run.select("source", "source_size", target.alias("target"),
                      F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(0.0).alias("rate"))


def _draw(*of) -> Column:
    """A number in [0, 1) that depends on nothing but `of`."""
    return F.shiftrightunsigned(F.xxhash64(*of), 11).cast("double") / F.lit(float(1 << 53))


def _fold(items: Column, seed: Column) -> Column:
    """Pair a list's fractional documents one after another: struct(done: rounded ones, left: the one that stays).

    With p of the carried and q of the next document, p + q < 1 moves all mass to one of them (chosen in
    proportion to its share), else one becomes 1 and the other p + q - 1. Either way one is settled.
    """
    def settle(state, item):
        p, q = state["left"]["p"], item["p"]
        u = _draw(seed, item["tie"], state["left"]["tie"])
        small = p + q < 1.0
        # The carried document keeps the residual: with p/(p+q) below 1, with (1-q)/(2-p-q) above.
        stays = F.when(small, u * (p + q) < p).otherwise(u * (2.0 - p - q) < 1.0 - q)
        rest = F.when(small, p + q).otherwise(p + q - 1.0)
        settled = F.when(small, F.lit(0.0)).otherwise(F.lit(1.0))
        kept = F.when(stays, state["left"]).otherwise(item)
        gone = F.when(stays, item).otherwise(state["left"])
        return F.struct(F.concat(state["done"], F.array(gone.withField("p", settled))).alias("done"),
                        kept.withField("p", rest).alias("left"))

    empty = F.slice(items, 1, 0)
    return F.aggregate(F.slice(items, 2, F.size(items)), F.struct(empty.alias("done"), items[0].alias("left")), settle)


_CARRIED = ("doc_id", "size", "source_size", "target", "copies")


def _rounded(rows: DataFrame, seed: int, fold: int) -> DataFrame:
    """Whole copies of documents with an expected `rate`, by pivotal rounding up a tree of groups."""
    rows = rows.select("doc_id", "source", "size", "source_size", "target",
                       F.floor("rate").cast("long").alias("copies"), (F.col("rate") - F.floor("rate")).alias("p"),
                       F.floor(F.log2(F.col("size") + 1.0) * _BINS_PER_OCTAVE).cast("int").alias("bin"),
                       F.xxhash64(F.lit(seed), "doc_id", "size").alias("tie"))
    open_ = rows.where(F.col("p") > 0)
    deal = staged(open_.groupBy(F.col("source").alias("s"), F.col("bin").alias("b")).agg(
        F.ceil(F.count("*") / float(fold)).cast("long").alias("parts")))
    parts = deal.agg(F.max("parts")).first()[0] or 0
    item = F.struct("size", "tie", *[c for c in _CARRIED if c != "size"], "p").alias("item")
    level = open_.join(deal, F.col("source").eqNullSafe(F.col("s")) & (F.col("bin") == F.col("b"))).select(
        "source", "bin", F.pmod(F.xxhash64(F.lit(seed + 1), "tie", "doc_id"), F.col("parts")).alias("part"), item)
    done = [rows.where(F.col("p") == 0).select("source", *_CARRIED)]
    width, depth = _SPAN, 0
    while True:
        groups = level.groupBy("source", "bin", "part").agg(F.array_sort(F.collect_list("item")).alias("items"))
        folded = groups.select("source", "bin", "part", _fold(F.col("items"), F.lit(seed * 1000 + depth)).alias("f"))
        folded = staged(folded.select("source", "bin", "part", F.col("f.done").alias("done"), F.col("f.left").alias("left")))
        settled = (F.col("d.copies") + F.col("d.p")).cast("long").alias("copies")
        done.append(folded.select("source", F.explode("done").alias("d")).select("source", *[f"d.{c}" for c in _CARRIED[:-1]], settled))
        if parts <= 1 and width <= 1:
            break
        if parts > 1:
            parts, part, bin_ = -(-parts // fold), F.floor(F.col("part") / fold).cast("long"), F.col("bin")
        else:
            width, part, bin_ = -(-width // fold), F.col("part"), F.floor(F.col("bin") / fold).cast("int")
        level = folded.select("source", bin_.alias("bin"), part.alias("part"), F.col("left").alias("item"))
        depth += 1
    last = (_draw(F.lit(seed + 2), F.col("left.tie"), F.col("source")) < F.col("left.p")).cast("long")
    done.append(folded.select("source", *[f"left.{c}" for c in _CARRIED[:-1]], (F.col("left.copies") + last).alias("copies")))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def mix(sized: DataFrame, weights=WEIGHTS, most: float = MOST, seed: int = 7, fold: int = FOLD) -> DataFrame:
    """How often each document is taken so that every source comes near its target.

    `sized` needs doc_id, source and size (see `word_count`). Returns source, doc_id, size, source_size, target,
    copies and taken (= copies * size). A document of a source with expected copies r gets floor(r) copies and
    one more with probability r - floor(r). Those fractions are rounded by pivotal dependent rounding as a
    reduction tree: documents of one source and nearly one size (steps of 2^(1/16)), dealt by a hash of the id
    into groups of about `fold`, are folded pairwise until each group has one fractional document left; these go
    up the tree, first within their size, then within their source, `fold` to one, until a source has one
    left, which is drawn alone. So the copies of each source, and of each size within it, are as expected to
    within one document. A source of any size is many small groups at the first level; each level is one
    shuffle of narrow rows and is written to the shared folder, so a lost executor costs one level.

    Long documents (over twice their source's mean) are rounded first. What they took too much or too little,
    zero in expectation, is spread over the expected copies of their source's other documents before those are
    rounded, so that a few very long documents don't move a source off its target.

    All draws are hashes of ids and `seed`: reruns agree. Null ids, sources and sizes (taken as 0) are kept; rows that
    repeat an id are documents of their own, told apart by size alone, equal ones being interchangeable.
    Documents without words are taken like others, which takes 0 words. Other columns are not looked at.
    """
    rows = staged(sized.select("doc_id", "source", F.coalesce(F.col("size"), F.lit(0)).cast("long").alias("size")))
    targets = source_targets(rows, weights, most)
    long_ = F.col("size") * F.col("source_docs") > 2 * F.col("source_size")
    counts = rows.groupBy(F.col("source").alias("n_source")).agg(F.count("*").alias("source_docs"))
    targets = staged(targets.join(counts, F.col("source").eqNullSafe(F.col("n_source")))
                     .drop("n_source").withColumnRenamed("source", "s"))
    at = F.col("source").eqNullSafe(F.col("s"))
    start = rows.join(targets, at)
    first = staged(_rounded(start.where(long_), seed, fold))
    rest = start.where(~long_).groupBy("s").agg(F.sum("size").alias("rest_size"))
    over = first.groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("long_taken"), F.sum("size").alias("long_size"))
    # The copies a shorter document is expected to get, given what the long ones took.
    due = F.col("target") - F.coalesce(F.col("long_taken"), F.lit(0))
    fixed = F.least(F.greatest(due / F.col("rest_size"), F.lit(0.0)), F.lit(float(most)))
    again = targets.alias("t").join(rest.withColumnRenamed("s", "rs"), F.col("s").eqNullSafe(F.col("rs"))).join(
        over.withColumnRenamed("source", "os"), F.col("s").eqNullSafe(F.col("os")), "left").select(
        "s", "source_size", "target", "source_docs",
        F.when(F.col("rest_size") > 0, fixed).otherwise(F.col("rate")).alias("rate"))
    second = _rounded(rows.join(staged(again), at).where(~long_), seed + 100, fold)
    return first.unionByName(second).withColumn("taken", F.col("copies") * F.col("size"))


def repeat_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents themselves, each as often as `mix` takes it.

    Rows that share a doc_id (nulls too) are decided as one document of their total size.
    """
    sized = docs.groupBy("doc_id", "source").agg(F.sum(word_count(F.col("text"))).alias("size"))
    taken = mix(sized, **options).where(F.col("copies") > 0).select(
        F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_copy"))
    same = docs["doc_id"].eqNullSafe(F.col("_id")) & docs["source"].eqNullSafe(F.col("_source"))
    return docs.join(taken, same).select(*[docs[c] for c in docs.columns])
