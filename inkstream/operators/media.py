"""Clips for a narration: search results, first-wins dedup, ordering, budgets and edit lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import counted
from .numbering import numbered, preceding


def fits_aspect(width: Column, height: Column, aspect: str) -> Column:
    """Portrait, landscape or square; unknown sizes fit nothing but square, which keeps all."""
    if aspect == "portrait":
        return F.coalesce(height > width, F.lit(False))
    if aspect == "landscape":
        return F.coalesce(width > height, F.lit(False))
    return F.lit(True)


def matches_aspect(width: Column, height: Column, aspect: Column, upright: Column | None = None) -> Column:
    """Whether a size is of an aspect (``portrait``, ``landscape``, else square); without a size, what is said about it decides, and nothing about squares."""
    w, h = (F.coalesce(x.try_cast("long"), F.lit(0)) for x in (width, height))
    sized = F.when(aspect == "portrait", h > w).when(aspect == "landscape", w > h).otherwise(w == h)
    said = F.lit(False) if upright is None else F.when(aspect.isin("portrait", "landscape"), upright == (aspect == "portrait"))
    return F.when((w > 0) & (h > 0), sized).otherwise(F.coalesce(said, F.lit(False)))


def first_of_each(items: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key in the given order."""
    w = Window.partitionBy(key).orderBy(*order)
    return items.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def round_robin(items: DataFrame, group: str, term: str, rank: str) -> DataFrame:
    """A group's items with ``turn``: the first of every term, then the second of every term, and so on."""
    nth = F.row_number().over(Window.partitionBy(group, term).orderBy(rank))
    return numbered(items.withColumn("_nth", nth), [group], F.col("_nth"), ["_nth", term], "turn").drop("_nth")


def within_budget(items: DataFrame, group: str, order: str, seconds: str, most: float, budget: Column) -> DataFrame:
    """Items in order while the seconds before them are within the budget; the one that crosses it is included."""
    used = F.least(F.col(seconds), F.lit(most)).cast("double")
    rows = preceding(items.withColumn("used", used), [group], F.col(order), [order], F.col("used"))
    return rows.withColumn("before", F.col("before").cast("double")).filter(F.col("before") <= budget)


def slices(items: DataFrame, seconds: str, longest: float, first_only: bool = False) -> DataFrame:
    """Cuts every item into parts of at most ``longest`` seconds: ``part, start, end``."""
    n = F.greatest(F.ceil(F.col(seconds) / longest), F.lit(1))
    parts = F.sequence(F.lit(0).cast("long"), (F.lit(1) if first_only else n).cast("long") - 1)
    rows = items.withColumn("part", F.explode(parts))
    start = F.col("part") * F.lit(float(longest))
    return rows.withColumns({"start": start, "end": F.least(start + F.lit(float(longest)), F.col(seconds).cast("double"))})


def longest_first(clips: DataFrame, source: str, seed: int = 0) -> DataFrame:
    """``place``: the longest clip of every source first, the rest behind, each in a fixed shuffled order."""
    w = Window.partitionBy("job", source).orderBy(F.desc("duration"), "start")
    rows = clips.withColumn("overflow", F.row_number().over(w) > 1)
    mixed = F.md5(F.concat_ws("|", F.lit(seed), F.col(source), F.col("start").cast("string")))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("job").orderBy("overflow", mixed)))


def loop_to_fill(clips: DataFrame, job: str, order: str, seconds: str, budget: float) -> DataFrame:
    """Clips again and again in order until a job's budget is filled: ``loop, at`` of every use."""
    rows = clips.withColumn("_total", F.sum(seconds).over(Window.partitionBy(job)))
    before = F.coalesce(F.sum(seconds).over(Window.partitionBy(job).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rows = rows.filter("_total > 0").withColumn("_before", before)
    rows = rows.withColumn("loop", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.lit(budget) / F.col("_total")))))
    return rows.withColumn("at", F.col("_before") + F.col("loop") * F.col("_total")).filter(F.col("at") < budget).drop("_total", "_before")


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is 0; over the shorter length."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce(x.cast("double") * y.cast("double"), F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    n = norm(a) * norm(b)
    return F.when(n == 0, F.lit(0.0)).otherwise(dot / n)


def rerank(vectors: DataFrame, subject: DataFrame) -> DataFrame:
    """``vec_id, score``: every row against the subject vector, the one row of ``subject``; more than one is an error."""
    return vectors.withColumn("subject", subject.select("subject").scalar()).withColumn("score", cosine(F.col("embedding"), F.col("subject")))


def search_results(replies: DataFrame, provider: str, width: int, height: int, least: float) -> DataFrame:
    """``provider, term, asset, url, duration, width, height`` from a provider's JSON reply.

    Of an asset's files the first that fits is taken: the exact size for
    pexels, the first as wide as asked in the right orientation for pixabay;
    coverr has one file.  Assets that are too short are left out.
    """
    body = F.col("body")
    if provider == "pexels":
        kind = "struct<videos:array<struct<id:bigint,duration:double,video_files:array<struct<link:string,width:int,height:int>>>>>"
        v = replies.select("provider", "term", F.posexplode(F.from_json(body, kind)["videos"]).alias("pos", "v"))
        ok = F.filter("v.video_files", lambda f: (f["width"] == width) & (f["height"] == height) & (f["link"] != ""))
        file = F.try_element_at(ok, F.lit(1))
        rows = v.filter(F.col("v.duration") >= least).withColumn("f", file).filter("f is not null")
        return rows.select("provider", "term", F.col("v.id").cast("string").alias("asset"), F.col("f.link").alias("url"), F.col("v.duration").alias("duration"), F.col("f.width").alias("width"), F.col("f.height").alias("height"))
    if provider == "pixabay":
        size = "struct<url:string,width:int,height:int>"
        kind = f"struct<hits:array<struct<id:bigint,duration:double,videos:struct<large:{size},medium:{size},small:{size},tiny:{size}>>>>"
        v = replies.select("provider", "term", F.posexplode(F.from_json(body, kind)["hits"]).alias("pos", "v"))
        files = F.array(*[F.col(f"v.videos.{k}") for k in ("large", "medium", "small", "tiny")])
        square = width == height
        ok = F.filter(files, lambda f: (f["url"] != "") & (f["width"] >= width) & (F.lit(square) | ((f["height"] > f["width"]) == F.lit(height > width))))
        rows = v.filter(F.col("v.duration") >= least).withColumn("f", F.try_element_at(ok, F.lit(1))).filter("f is not null")
        return rows.select("provider", "term", F.col("v.id").cast("string").alias("asset"), F.col("f.url").alias("url"), F.col("v.duration").alias("duration"), F.col("f.width").alias("width"), F.col("f.height").alias("height"))
    kind = "struct<hits:array<struct<id:string,duration:double,is_vertical:boolean,max_width:int,max_height:int,urls:struct<mp4_download:string>>>>"
    v = replies.select("provider", "term", F.posexplode(F.from_json(body, kind)["hits"]).alias("pos", "v"))
    upright = F.coalesce(F.col("v.max_height") > F.col("v.max_width"), F.col("v.is_vertical"))
    fits = F.lit(True) if width == height else F.coalesce(upright == F.lit(height > width), F.lit(False))
    rows = v.filter((F.floor("v.duration") >= least) & (F.col("v.id") != "") & (F.col("v.urls.mp4_download") != "") & fits)
    return rows.select("provider", "term", F.col("v.id").alias("asset"), F.col("v.urls.mp4_download").alias("url"), F.col("v.duration").alias("duration"), F.col("v.max_width").alias("width"), F.col("v.max_height").alias("height"))


def routed_results(replies: DataFrame, width: int, height: int, least: float) -> DataFrame:
    """Search results of replies of all providers; one that is not known is read as the default one's."""
    named = F.when(F.col("provider").isin("pixabay", "coverr"), F.col("provider")).otherwise("pexels")
    rows = replies.withColumn("provider", named)
    pexels, pixabay, coverr = (search_results(rows.filter(F.col("provider") == p), p, width, height, least) for p in ("pexels", "pixabay", "coverr"))
    return pexels.unionByName(pixabay).unionByName(coverr)


def term_counts(texts: DataFrame, key: str, text: str, stop: list[str], least: int = 4, most: int | None = None) -> DataFrame:
    """``key, word, n, rank``: a text's words by count, then alphabet, the first ``most`` of them; counted within the row."""
    parts = F.transform(F.split(F.lower(F.col(text)), r"[^\p{L}']+"), lambda w: F.regexp_replace(w, r"^'+|'+$", ""))
    ranked = counted(F.filter(parts, lambda w: (F.length(w) >= least) & ~w.isin(stop)))
    rows = texts.select(key, F.posexplode(ranked if most is None else F.slice(ranked, 1, most)).alias("pos", "r"))
    return rows.select(key, "r.word", "r.n", (F.col("pos") + 1).alias("rank"))
