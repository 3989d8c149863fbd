"""Tables of jobs joined with each other: ownership, grounding, backlogs and resumable work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import trim
from .numbering import numbered

RESUMABLE = ["pending"]


def blocks_of(segments: DataFrame, blocks: DataFrame, keys: list[str]) -> DataFrame:
    """Blocks of segments with ``block_ids``, with the segment's keys and the place in it."""
    ids = segments.select(*keys, F.posexplode("block_ids").alias("place", "block_id"))
    return ids.join(blocks, [keys[0], "block_id"])


def grounded(proposals: DataFrame, blocks: DataFrame, chunks: DataFrame) -> DataFrame:
    """Proposals whose block exists in their book; a blank block means the chunk's first, an unknown one drops the row."""
    p = proposals.join(chunks.select("book_id", "chunk", "first_block"), ["book_id", "chunk"], "left")
    p = p.withColumn("block_id", F.when(trim(F.coalesce("block_id", F.lit(""))) == "", F.col("first_block")).otherwise(trim(F.col("block_id")))).drop("first_block")
    return p.join(blocks.select("book_id", "block_id"), ["book_id", "block_id"], "left_semi")


def distinct_titles(shorts: DataFrame, group: str, title: str, order: str) -> DataFrame:
    """Drops rows without a title and later ones of the same title; ``idx`` numbers what is left."""
    key = F.lower(trim(F.regexp_replace(F.col(title), r"\s+", " ")))
    w = Window.partitionBy(group, "_key").orderBy(order)
    rows = shorts.withColumn("_key", key).filter("_key != ''").withColumn("_rn", F.row_number().over(w)).filter("_rn = 1")
    return rows.withColumn("idx", F.row_number().over(Window.partitionBy(group).orderBy(order)) - 1).drop("_key", "_rn")


def merged_sections(heuristic: DataFrame, proposed: DataFrame, title_of) -> DataFrame:
    """Section starts of both; ``title_of(heuristic, proposed)`` decides where both have one."""
    h = heuristic.select("book_id", "start_block", F.col("title").alias("h"))
    p = proposed.select("book_id", trim(F.col("start_block")).alias("start_block"), F.col("title").alias("p")).filter("start_block != ''")
    return h.join(p, ["book_id", "start_block"], "full_outer").select("book_id", "start_block", title_of(F.col("h"), F.col("p")).alias("title"))


def longer_title(h: Column, p: Column) -> Column:
    from .outline import BARE_NUMBER, section_title

    none = lambda c: F.coalesce(c, F.lit("")) == ""
    return F.when(none(p), h).when(none(h), p).when(h.rlike(BARE_NUMBER) & ~p.rlike(BARE_NUMBER), section_title(h, p)).when(F.length(p) >= F.length(h), p).otherwise(h)


def honoured_skips(heuristic: DataFrame, proposed: DataFrame, protected: DataFrame) -> DataFrame:
    """Heuristic skips and those proposed ones that touch no protected block."""
    keys = ["book_id", "block_id"]
    return heuristic.select(*keys).union(proposed.select(*keys).join(protected.select(*keys), keys, "left_anti")).distinct()


def finished_chunks(wanted: DataFrame, manifest: DataFrame) -> DataFrame:
    """Wanted chunks that the manifest holds with the same place and hash, once each."""
    return wanted.join(manifest.select("doc_id", "idx", "hash").distinct(), ["doc_id", "idx", "hash"], "left_semi")


def at_revision(changes: DataFrame, books: DataFrame) -> DataFrame:
    """Changes that were made against the book's present revision."""
    return changes.join(books.select("book_id", "revision"), ["book_id", "revision"], "left_semi")


def next_revision(books: DataFrame, touched: DataFrame) -> DataFrame:
    t = touched.select("book_id").distinct().withColumn("_up", F.lit(1))
    return books.join(t, "book_id", "left").withColumn("revision", F.col("revision") + F.coalesce("_up", F.lit(0))).drop("_up")


def consumed(states: DataFrame, wanted: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """What one-time entries give now, and the table without the wanted ones."""
    w = wanted.select("state").distinct()
    return states.join(w, "state", "left_semi").filter(F.col("expires_at") > now), states.join(w, "state", "left_anti")


def connected_channels(old: DataFrame, new: DataFrame) -> DataFrame:
    """Channels after connecting: new titles, new tokens and scopes unless empty, errors cleared, other settings kept."""
    n = new.select("channel_id", F.col("title").alias("_title"), F.col("refresh_token").alias("_token"), F.col("scopes").alias("_scopes"))
    kept = lambda a, b: F.coalesce(F.nullif(F.col(a), F.lit("")), F.col(b))
    both = old.join(n, "channel_id", "full_outer")
    fresh = F.col("_token").isNotNull() | F.col("_title").isNotNull()
    return both.select("channel_id", F.coalesce("_title", "title").alias("title"), kept("_token", "refresh_token").alias("refresh_token"), kept("_scopes", "scopes").alias("scopes"), F.coalesce("auto_upload", F.lit(False)).alias("auto_upload"), F.when(~fresh, F.col("error")).alias("error"))


def resumable(segments: DataFrame, interrupted: str = "interrupted") -> DataFrame:
    """``book_id, items``: per book in order, what waits and what failed by interruption."""
    ok = F.col("state").isin(RESUMABLE) | ((F.col("state") == "failed") & F.coalesce(F.col("error").startswith(interrupted), F.lit(False)))
    return segments.filter(ok).groupBy("book_id").agg(F.array_sort(F.collect_list("idx")).alias("items"))


def to_render(segments: DataFrame, requested: DataFrame | None = None) -> DataFrame:
    """Segments that are not in work, of the requested ones if some are named."""
    idle = segments.filter(~F.col("state").isin("queued", "rendering"))
    return idle if requested is None else idle.join(requested.select("book_id", "idx").distinct(), ["book_id", "idx"], "left_semi")


def not_uploaded(results: Column) -> Column:
    """No upload result that succeeded and names a video."""
    return ~F.coalesce(F.exists(results, lambda r: r["success"] & (F.coalesce(r["video_id"], F.lit("")) != "")), F.lit(False))


#: How the requests of a book's own tasks begin, and the error of an upload that was interrupted.
BOOK_TASKS = ["book-short:", "book-shorts-plan:", "book-ocr:", "book:"]
INTERRUPTED_UPLOAD = "YouTube upload was interrupted before the process completed"


def standalone(request: Column) -> Column:
    """A task of its own, and not one of a book's."""
    asked = F.coalesce(request.cast("string"), F.lit(""))
    return ~F.exists(F.array(*map(F.lit, BOOK_TASKS)), lambda p: F.startswith(asked, p))


def in_flight(state: Column) -> Column:
    return F.coalesce(state.isin("pending", "processing"), F.lit(False))


def busy(state: Column, cross_post: Column, upload: Column) -> Column:
    """A task that makes, posts or uploads something."""
    return F.coalesce(state == "processing", F.lit(False)) | in_flight(cross_post) | in_flight(upload)


def skips_upload(state: Column, results: Column) -> Column:
    """An upload that is under way or done is not started again."""
    return in_flight(state) | ~not_uploaded(results)


def resumes_upload(state: Column, error: Column, owner_alive: Column, interrupted: str = INTERRUPTED_UPLOAD) -> Column:
    """An upload whose owner is gone, or that failed by interruption."""
    return F.when(in_flight(state), ~owner_alive).otherwise(F.coalesce((state == "failed") & (error == interrupted), F.lit(False)))


def _order_number(rows: DataFrame, column: str) -> Column:
    """A number that never falls along a column: times as seconds, texts as their first six bytes."""
    kind = rows.schema[column].dataType.typeName()
    if kind in ("date", "timestamp", "timestamp_ntz"):
        return F.unix_timestamp(column)
    if kind == "string":
        return F.conv(F.rpad(F.hex(F.substring(F.encode(F.col(column), "UTF-8"), 1, 6)), 12, "0"), 16, 10).cast("double")
    return F.col(column)


def backlog(sources: dict[str, DataFrame], orders: dict[str, list[str]] | None = None) -> DataFrame:
    """Complete rows with a file and no upload, of all sources in their order: ``source, key, place``.

    A source is ordered by ``orders``, or else by ``made_at`` and ``key``.
    """
    out = None
    for n, (name, rows) in enumerate(sources.items()):
        by = (orders or {}).get(name, ["made_at", "key"])
        state = F.col("upload_state") if "upload_state" in rows.columns else F.lit(None).cast("string")
        ok = rows.filter((F.col("state") == "complete") & (F.coalesce("file", F.lit("")) != "") & ~skips_upload(state, F.col("uploads")))
        own = numbered(ok.withColumns({"_n": F.lit(n), "source": F.lit(name)}), ["source"], _order_number(ok, by[0]), by).select("_n", "source", "key", "place")
        out = own if out is None else out.unionByName(own)
    return out.orderBy("_n", "place").drop("_n")


def shorts_of_tasks(tasks: DataFrame, shorts: DataFrame) -> DataFrame:
    """Tasks with the stored listing of the short that their request id names; the index stands behind the last colon."""
    request = F.col("request_id")
    book = F.substring(request, F.lit(1), F.length(request) - F.length(F.substring_index(request, ":", -1)) - 1)
    keyed = tasks.withColumns({"book_id": book, "idx": F.substring_index(request, ":", -1).try_cast("int")})
    s = shorts.select("book_id", "idx", F.col("title").alias("stored_title"), F.col("description").alias("stored_description"))
    useful = (trim(F.coalesce("stored_title", F.lit(""))) != "") | (trim(F.coalesce("stored_description", F.lit(""))) != "")
    return keyed.join(s, ["book_id", "idx"], "left").withColumn("has_listing", useful)


def same_format(chunks: DataFrame, key: str) -> DataFrame:
    """``uniform, rate, channels``: whether all parts share one format, and the format to convert to if not."""
    fmt = F.struct(F.coalesce("codec", F.lit("")), F.coalesce("rate", F.lit(44100)), F.coalesce("channels", F.lit(1)))
    return chunks.groupBy(key).agg((F.count_distinct(fmt) == 1).alias("uniform"), F.coalesce(F.max("rate"), F.lit(44100)).alias("rate"), F.coalesce(F.max("channels"), F.lit(1)).alias("channels"))


def drift(chunks: DataFrame, joined: DataFrame, key: str, most: float = 0.25) -> DataFrame:
    """``drift, flagged``: a joined recording's length against the sum of its parts."""
    total = chunks.groupBy(key).agg(F.sum("duration").alias("_t"))
    return joined.join(total, key).withColumn("drift", F.col("duration") - F.col("_t")).withColumn("flagged", F.abs("drift") > most).drop("_t")


def admitted(queue: DataFrame, running: int = 5, waiting: int = 100) -> DataFrame:
    """``status`` of tasks by their place in the order of arrival: the first of a queue run, the next wait, the rest are refused."""
    seconds = F.unix_timestamp("arrived") if queue.schema["arrived"].dataType.typeName() in ("date", "timestamp", "timestamp_ntz") else F.col("arrived")
    placed = numbered(queue, ["queue"], seconds, ["arrived", "task_id"])
    return placed.withColumn("status", F.when(F.col("place") <= running, "running").when(F.col("place") <= running + waiting, "queued").otherwise("rejected")).drop("place")


def all_present(wanted: DataFrame, known: DataFrame, key: str, item: str) -> DataFrame:
    """``key, items, whole`` of the known ones among each key's wanted items, and whether none is missing."""
    w = wanted.filter(F.coalesce(F.col(item).cast("string"), F.lit("")) != "").select(key, item).distinct()
    k = known.select(item).distinct().withColumn("_known", F.lit(True))
    found = w.join(k, item, "left")
    return found.groupBy(key).agg(F.count_if(F.col("_known").isNotNull()).alias("items"), F.bool_and(F.col("_known").isNotNull()).alias("whole"))


def uploadable(tasks: DataFrame) -> DataFrame:
    """``task_id, files, refusal`` for an upload by hand: complete, none in flight or done, a file there, and the chosen one if one is named."""
    files = F.filter("videos", lambda v: F.coalesce(v, F.lit("")) != "")
    chosen = F.when(F.col("video_index").isNull(), files).when(F.get(files, F.col("video_index")).isNotNull(), F.array(F.get(files, F.col("video_index")))).otherwise(F.array().cast("array<string>"))
    why = (
        F.when(F.col("state") != "complete", "not finished")
        .when(F.coalesce("upload_state", F.lit("")).isin("pending", "processing"), "in progress")
        .when(~not_uploaded(F.col("uploads")), "already uploaded")
        .when(F.size(files) == 0, "no file")
        .when(F.size(chosen) == 0, "no such file")
    )
    return tasks.select("task_id", F.when(why.isNull(), chosen).alias("files"), why.alias("refusal"))


def admitted_materials(materials: DataFrame, probes: DataFrame, root: str, images: tuple[str, ...] = ("jpg", "jpeg", "png")) -> DataFrame:
    """Local materials that may be used, with their path: inside ``root``, probed, large enough; an image is replaced by its clip."""
    from ..functions.replies import large_enough

    path = F.when(F.startswith("url", F.lit("/")), F.col("url")).otherwise(F.concat(F.lit(f"{root}/"), "url"))
    inside = F.startswith(path, F.lit(f"{root}/")) & ~path.rlike(r"(^|/)\.\.(/|$)")
    rows = materials.filter(F.coalesce("url", F.lit("")) != "").withColumn("path", path).filter(inside)
    rows = rows.join(probes.select("path", "width", "height"), "path").filter(large_enough(F.col("width"), F.col("height")))
    image = F.lower(F.regexp_extract("path", r"\.([^.]+)$", 1)).isin(*images)
    return rows.withColumn("path", F.when(image, F.concat("path", F.lit(".mp4"))).otherwise(F.col("path"))).drop("width", "height")


def recent_lines(jobs: DataFrame, logs: DataFrame, key: str, recognition: DataFrame | None = None, most_jobs: int = 4, most_lines: int = 12, most: int = 25) -> DataFrame:
    """``key, idx, seq, line``: the last lines of a key's first jobs in work that have a task, and of these the last in all.

    ``recognition`` holds ``key, task_id`` of books whose pages are being
    recognised; their lines come last, as job -1.
    """
    work = jobs.filter(F.col("state").isin("queued", "rendering") & (F.coalesce(F.col("task_id").cast("string"), F.lit("")) != ""))
    first = work.withColumn("_j", F.row_number().over(Window.partitionBy(key).orderBy("idx"))).filter(F.col("_j") <= most_jobs).select(key, "idx", "task_id", "_j")
    if recognition is not None:
        first = first.unionByName(recognition.filter("task_id is not null").select(key, F.lit(-1).cast(first.schema["idx"].dataType).alias("idx"), "task_id", F.lit(most_jobs + 1).alias("_j")))
    last = logs.withColumn("_l", F.row_number().over(Window.partitionBy("task_id").orderBy(F.desc("seq")))).filter(F.col("_l") <= most_lines)
    rows = first.join(last, "task_id")
    back = Window.partitionBy(key).orderBy(F.desc("_j"), F.desc("seq"))
    return rows.withColumn("_b", F.row_number().over(back)).filter(F.col("_b") <= most).select(key, "idx", "seq", "line")
