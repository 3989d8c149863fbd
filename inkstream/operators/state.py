"""State of jobs: roll-ups, recovery, patches and replacement of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .folds import Throttle, folded
from .numbering import preceding

ACTIVE = ["queued", "rendering"]


def progress(segments: DataFrame, key: str = "book_id") -> DataFrame:
    """Counts of states per book, percentage and overall state; a state that is not known counts in the total alone."""
    n = lambda s: F.count_if(F.col("state") == s)
    got = segments.groupBy(key).agg(
        F.count("*").alias("total"), n("pending").alias("pending"), n("queued").alias("queued"), n("rendering").alias("rendering"), n("complete").alias("complete"), n("failed").alias("failed")
    )
    share = F.when(F.col("total") > 0, F.floor(F.lit(100.0) * F.col("complete") / F.col("total") + 0.5)).otherwise(0).cast("long")
    state = (
        F.when(F.col("total") == 0, "ready")
        .when(F.col("queued") + F.col("rendering") > 0, "rendering")
        .when(F.col("complete") == F.col("total"), "complete")
        .when(F.col("failed") == F.col("total"), "failed")
        .otherwise("ready")
    )
    return got.withColumns({"progress": share, "state": state})


def orphaned(segments: DataFrame, tasks: DataFrame, live: DataFrame) -> DataFrame:
    """Segments in work whose task is missing, not processing, or owned by nobody alive."""
    work = segments.filter(F.col("state").isin(ACTIVE))
    t = tasks.select("task_id", F.col("state").alias("task_state"), "owner_id").join(live.select("owner_id", F.lit(True).alias("alive")), "owner_id", "left")
    joined = work.join(t, "task_id", "left")
    lost = F.col("task_state").isNull() | (F.col("task_state") != "processing") | F.col("alive").isNull()
    why = F.when(F.col("task_state").isNull(), "missing").when(F.col("task_state") != "processing", "not processing").otherwise("owner gone")
    return joined.filter(lost).select("book_id", "idx", "task_id", why.alias("reason"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows replace old ones of the same key."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def whole_percent(value: Column) -> Column:
    """Progress as it is stored: a whole number from 0 to 100, halves up."""
    return F.when(value.isNotNull(), F.least(F.lit(100), F.greatest(F.lit(0), F.floor(value + F.lit(0.5))))).cast("int")


def patch(old: DataFrame, changes: DataFrame, keys: list[str], cleared: str = "cleared", percent: str = "progress") -> DataFrame:
    """Sets what a change holds; null leaves a column as it is unless its name is in ``cleared``; never adds rows.

    A column named ``percent`` is stored as a whole number from 0 to 100.
    """
    if percent in changes.columns:
        changes = changes.withColumn(percent, whole_percent(F.col(percent)))
    cols = [c for c in old.columns if c not in keys and c in changes.columns]
    c = changes.select(*keys, *[F.col(x).alias(f"_{x}") for x in cols], F.col(cleared).alias("_cleared"))
    joined = old.join(c, keys, "left")
    null = lambda x: F.coalesce(F.array_contains("_cleared", x), F.lit(False))
    return joined.select(*[F.when(null(x), F.lit(None)).otherwise(F.coalesce(f"_{x}", x)).alias(x) if x in cols else F.col(x) for x in old.columns])


def replace_group(old: DataFrame, new: DataFrame, group: str) -> DataFrame:
    """All rows of the groups that have new rows give way to them."""
    return old.join(new.select(group).distinct(), group, "left_anti").unionByName(new)


def cascade_delete(tables: dict[str, DataFrame], keys: DataFrame, key: str) -> dict[str, DataFrame]:
    return {name: t.join(keys.select(key).distinct(), key, "left_anti") for name, t in tables.items()}


def tail(events: DataFrame, key: str, order: list[str], most: int = 500) -> DataFrame:
    """The last rows of each key, numbered from 1 in order."""
    last = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    kept = events.withColumn("_rn", F.row_number().over(last)).filter(F.col("_rn") <= most)
    return kept.withColumn("line", F.row_number().over(Window.partitionBy(key).orderBy(*order))).drop("_rn")


def tail_of(items: Column, most: int) -> Column:
    """The last elements of an array."""
    return F.slice(items, F.greatest(F.lit(1), F.size(items) - F.lit(most - 1)), most)


def page(rows: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """One page of an ordered list."""
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def publish_slots(items: DataFrame, key: str, order: list[str], cursor: Column, now: Column, lead: int = 60, stagger: int = 3600) -> DataFrame:
    """Slots from the cursor on, none earlier than ``lead`` seconds from now, ``stagger`` seconds apart; the first of ``order`` is a number or a time."""
    first = F.greatest(cursor, now + F.lit(lead))
    return preceding(items, [key], F.col(order[0]), order, name="_nth").withColumn("slot", first + F.col("_nth") * F.lit(stagger)).drop("_nth")


def cache_hits(requests: DataFrame, cache: DataFrame, key: str, now: Column) -> DataFrame:
    """Requests with ``hit``: an entry that has not expired and holds something.

    Where requests have an ``aspect`` and entries' items ``width`` and
    ``height``, every item must fit it: one that does not makes the whole
    entry stale, for else its few fitting items would be used again and again.
    """
    shaped = "aspect" in requests.columns
    c = cache.select(key, "expires_at", F.col("items").alias("_i"))
    joined = requests.join(c, key, "left")
    fresh = (F.col("expires_at") > now) & (F.size("_i") > 0)
    if shaped:
        fits = lambda x: F.when(F.col("aspect") == "portrait", x["height"] > x["width"]).when(F.col("aspect") == "landscape", x["width"] > x["height"]).otherwise(F.lit(True))
        fresh = fresh & F.forall("_i", lambda x: F.coalesce(fits(x), F.lit(False)))
    return joined.withColumn("hit", F.coalesce(fresh, F.lit(False))).drop("_i", "expires_at")


def cached_items(requests: DataFrame, cache: DataFrame, key: str, now: Column) -> DataFrame:
    """The items of the entries that are hits, under the term as the request spells it."""
    hits = cache_hits(requests, cache, key, now).filter("hit").drop("hit")
    return hits.join(cache.select(key, F.explode("items").alias("item")), key).withColumn("item", F.col("item").withField("term", F.col("term")))


def searches(requests: DataFrame, cache: DataFrame, key: str, now: Column) -> DataFrame:
    """The keys to search for once each, however many requests wait for them."""
    return cache_hits(requests, cache, key, now).filter("not hit").groupBy(key).agg(F.count("*").alias("waiting"))


def synced(books: DataFrame, progress_rows: DataFrame, key: str = "book_id") -> DataFrame:
    """Books with the state of their segments, but for states that speak of the book itself; without segments a book is ready."""
    p = progress_rows.select(key, F.col("state").alias("_derived"))
    own = F.col("state").isin("extracting", "ocr_pending", "ocr", "failed")
    return books.join(p, key, "left").withColumn("state", F.when(own, F.col("state")).otherwise(F.coalesce("_derived", F.lit("ready")))).drop("_derived")


def with_progress(books: DataFrame, segments: DataFrame, key: str = "book_id") -> DataFrame:
    """Books with counts and percentage of their segments, zero where there are none."""
    p = progress(segments, key).withColumnRenamed("state", "derived_state")
    counts = [c for c in p.columns if c not in (key, "derived_state")]
    return books.join(p, key, "left").fillna(0, counts).fillna("ready", ["derived_state"])


def throttled(events: DataFrame, key: str, at: str, value: str, interval: float = 1.0, jump: float = 0.02) -> DataFrame:
    """Progress events that are passed on: greater than the last one passed on, and late enough after it, far enough above it, or complete.

    Which event was the last depends on all before, so a key's events are folded in order; ``at`` is in seconds.
    """
    timed = events.select(key, F.col(at).cast("double").alias("at"), F.col(value).cast("double").alias("value"))
    return folded(timed, key, ["at", "value"], ["at", "value"], lambda: Throttle(interval, jump), lambda gate, e: [e] if gate.step(*e) else [], "at double, value double")


def debounced(events: DataFrame, key: str, ts: str, gap: str = "10 minutes") -> DataFrame:
    """The last event of every burst: a session ends after ``gap`` without events.  Works on batches and streams."""
    return events.groupBy(key, F.session_window(ts, gap)).agg(F.max(ts).alias("last_ts"), F.count("*").alias("n")).select(key, F.col("session_window.start").alias("first_ts"), "last_ts", "n")


def monotone(events: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Events that exceed every earlier value of their key."""
    before = F.max(value).over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return events.withColumn("_b", before).filter(F.col("_b").isNull() | (F.col(value) > F.col("_b"))).drop("_b")


def cache_ages(entries: DataFrame, group: str, now: Column, keep: Column) -> DataFrame:
    """``n, bytes, expired, freed, oldest, newest`` per group of entries with ``bytes, made_at``.

    Entries as old as ``keep`` (an interval) are expired; those made after now are not trusted, and count as expired.
    """
    old = (F.col("made_at") <= now - keep) | (F.col("made_at") > now)
    size = F.coalesce("bytes", F.lit(0))
    return entries.groupBy(group).agg(F.count("*").alias("n"), F.sum(size).alias("bytes"), F.count_if(old).alias("expired"), F.coalesce(F.sum(F.when(old, size)), F.lit(0)).alias("freed"), F.min("made_at").alias("oldest"), F.max("made_at").alias("newest"))


def cleaned(entries: DataFrame, group: str, now: Column, keep: Column) -> DataFrame:
    """``candidates, deleted, freed, failed`` of a clean-up: expired files that may be removed, and those that may not.

    Entries have ``name, bytes, made_at, linked``; only plain cache files are removed, links and strange names fail one by one.
    """
    old = (F.col("made_at") <= now - keep) | (F.col("made_at") > now)
    ok = F.coalesce(F.col("name").rlike(r"^[A-Za-z0-9._-]+\.mp4$") & ~F.col("linked"), F.lit(False))
    size = F.coalesce("bytes", F.lit(0))
    return entries.filter(old).groupBy(group).agg(F.count("*").alias("candidates"), F.count_if(ok).alias("deleted"), F.coalesce(F.sum(F.when(ok, size)), F.lit(0)).alias("freed"), F.count_if(~ok).alias("failed"))
