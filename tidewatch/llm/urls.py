"""Dated URL lists and their as-of join with captures, in DataFrame operations only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLOT_DAYS = 64  # intervals and captures meet by pattern and slot of days


def host(url: Column) -> Column:
    """Lower-case host without user, port and final dot; null where the text is no URL with a host."""
    # A scheme, two slashes, the authority up to a slash, question or number sign.
    authority = F.regexp_extract(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#\\]*)", 1)
    bare = F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":[0-9]*$", "")
    return F.nullif(F.regexp_replace(F.lower(bare), r"\.+$", ""), F.lit(""))


def path(url: Column) -> Column:
    """The path without query and fragment, beginning with a slash."""
    rest = F.regexp_extract(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#\\]*([^?#]*)", 1)
    return F.when(rest.startswith("/"), rest).otherwise("/")


def url_patterns(url: Column, labels: Sequence[int], segments: Sequence[int]) -> Column:
    """Every list pattern that can cover a URL, as array<struct<pattern, rank>>; a larger rank is more specific.

    Domains cover their subdomains: `example.com`, `www.example.com` (rank: labels). With a path the whole host is needed:
    `www.example.com/news` covers `/news` and what lies below (rank: labels + segments). Null or other texts: none.
    `labels` and `segments` are the depths that the list has, see `list_depths`; patterns of other depths can't meet an entry.
    """
    name = host(url)
    names = F.split(name, r"\.")
    n = F.size(names)
    suffix = F.transform(F.filter(_numbers(labels), lambda k: k <= n), lambda k: F.struct(
        F.array_join(F.slice(names, n - k + 1, k), ".").alias("pattern"), k.alias("rank")))
    parts = F.array_remove(F.split(path(url), "/"), "")
    deep = F.transform(F.filter(_numbers(segments), lambda k: k <= F.size(parts)), lambda k: F.struct(
        F.concat(name, F.lit("/"), F.array_join(F.slice(parts, 1, k), "/")).alias("pattern"), (k + n).alias("rank")))
    return F.when(name.isNotNull(), F.concat(suffix, deep))


def _numbers(values: Sequence[int]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<int>")


def tidy_pattern(pattern: Column) -> Column:
    """A list pattern as `url_patterns` writes it: host name in lower case, path without empty segments or final slash."""
    parts = F.split(pattern, "/")
    inner = F.array_remove(F.slice(parts, 2, F.size(parts)), "")
    return F.array_join(F.concat(F.array(F.lower(F.get(parts, F.lit(0)))), inner), "/")


def list_depths(entries: DataFrame) -> tuple[list[int], list[int]]:
    """The different numbers of labels of a list's domains and of segments of its paths; one row comes to the driver."""
    at = tidy_pattern(F.col("pattern"))
    deep = F.size(F.split(at, "/")) - 1
    row = entries.where(F.col("pattern").isNotNull() & F.col("listed_at").isNotNull()).agg(
        F.collect_set(F.when(deep == 0, F.size(F.split(at, r"\.")))), F.collect_set(F.when(deep > 0, deep))).first()
    return sorted(row[0]), sorted(row[1])


def intervals(entries: DataFrame) -> DataFrame:
    """(pattern, verdict, since, until) from dated list entries (pattern, listed_at, verdict).

    An entry holds from its date until the same pattern's next entry, the last one without end (until null). Of
    entries of one pattern and date the verdict that sorts last counts, so `block` over `allow`; a null verdict ends the
    one before and starts none. Host names are lower-cased, paths are not but lose empty segments and a final slash; rows without
    pattern or date are left out. One group's window is a pattern's entries, one row per date.
    """
    known = entries.where(F.col("pattern").isNotNull() & F.col("listed_at").isNotNull())
    daily = known.groupBy(tidy_pattern(F.col("pattern")).alias("pattern"), F.col("listed_at").cast("timestamp_ntz").alias("since")).agg(
        F.max("verdict").alias("verdict"))
    until = F.lead("since").over(Window.partitionBy("pattern").orderBy("since"))
    return daily.select("pattern", "verdict", "since", until.alias("until")).where(F.col("verdict").isNotNull())


def _slot(at: Column) -> Column:
    return F.floor(F.datediff(at.cast("date"), F.lit("1970-01-01").cast("date")) / SLOT_DAYS).cast("int")


def list_verdicts(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """Captures (page_id, url, fetched_at) with what a dated list said of them when they were fetched.

    Adds host, verdict, pattern and since of the most specific entry active at fetch time (`none` and nulls
    where there is none, the URL has no host or the capture has no time). An entry is active from its own date, until
    before the next entry of its pattern. Every input row gives one row; null and repeated page_ids too.

    Entries become validity intervals, spread over slots of 64 days between the first and last capture; captures
    carry one pattern for each depth that the list has and their URL reaches. The join is by pattern and slot, so a host with a third of all captures is
    spread over its days, and adaptive execution can split what remains. Matches are reduced per
    distinct (url, fetched_at) before captures get them back.
    """
    timed = captures.select("page_id", "url", F.col("fetched_at").cast("timestamp_ntz").alias("fetched_at"))
    seen = timed.where(F.col("fetched_at").isNotNull()).select("url", "fetched_at")
    patterns = url_patterns(F.col("url"), *list_depths(entries))
    asked = seen.select("url", "fetched_at", _slot(F.col("fetched_at")).alias("slot"), F.explode(patterns).alias("p")).select(
        "url", "fetched_at", "slot", "p.pattern", "p.rank")
    span = captures.agg(F.min(_slot(F.col("fetched_at"))).alias("first"), F.max(_slot(F.col("fetched_at"))).alias("last"))
    first, last = span.first()
    first, last = (first, last) if first is not None else (0, 0)
    low, high = F.greatest(_slot(F.col("since")), F.lit(first)), F.least(F.coalesce(_slot(F.col("until")), F.lit(last)), F.lit(last))
    spread = intervals(entries).where(low <= high).select(
        F.col("pattern").alias("l_pattern"), "verdict", "since", "until", F.explode(F.sequence(low, high)).alias("l_slot"))
    active = asked.join(spread, (F.col("pattern") == F.col("l_pattern")) & (F.col("slot") == F.col("l_slot"))).where(
        (F.col("since") <= F.col("fetched_at")) & (F.col("until").isNull() | (F.col("fetched_at") < F.col("until"))))
    best = active.groupBy(F.col("url").alias("m_url"), F.col("fetched_at").alias("m_at")).agg(
        F.max(F.struct("rank", "verdict", "pattern", "since")).alias("m"))
    out = timed.join(best, (F.col("url") == F.col("m_url")) & (F.col("fetched_at") == F.col("m_at")), "left")
    return out.select("page_id", "url", host(F.col("url")).alias("host"), "fetched_at", F.coalesce("m.verdict", F.lit("none")).alias("verdict"),
                      F.col("m.pattern").alias("pattern"), F.col("m.since").alias("since"))
