"""Registered queries over predicates of tasks, sizes, short scripts and social texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import publish as P
from ..functions import replies as R
from ..functions import text as T
from ..operators import links as K
from ..operators import media as M
from . import domain as D
from .queries import query

_REQUESTS = ["book-short:", "book-shorts-plan:", "book-ocr:", "book:", "bookish:", ""]
_STATES = ["pending", "processing", "failed", "complete"]


@query(rf"""WITH t AS (SELECT o_orderkey, {_REQUESTS!r}[o_custkey % 6 + 1] || o_orderkey AS request, {_STATES!r}[o_orderkey % 4 + 1] AS state, {_STATES!r}[o_custkey % 4 + 1] AS upload, o_orderstatus = 'F' AS done, o_custkey % 3 = 0 AS alive, o_custkey % 5 < 2 AS interrupted FROM orders)
SELECT o_orderkey, NOT (request LIKE 'book-short:%' OR request LIKE 'book-shorts-plan:%' OR request LIKE 'book-ocr:%' OR request LIKE 'book:%') AS standalone, state = 'processing' OR upload IN ('pending', 'processing') AS busy,
  upload IN ('pending', 'processing') OR done AS skips, CASE WHEN upload IN ('pending', 'processing') THEN NOT alive ELSE upload = 'failed' AND interrupted END AS resumes FROM t""")
def task_predicates(spark, d):
    pick = lambda names, c: F.get(F.array(*map(F.lit, names)), c.cast("int"))
    upload = pick(_STATES, F.col("o_custkey") % 4)
    results = F.array(F.struct((F.col("o_orderstatus") == "F").alias("success"), F.lit("v").alias("video_id")))
    error = F.when(F.col("o_custkey") % 5 < 2, K.INTERRUPTED_UPLOAD).otherwise("quota")
    return D.table(spark, d, "orders").select(
        "o_orderkey",
        K.standalone(F.concat(pick(_REQUESTS, F.col("o_custkey") % 6), "o_orderkey")).alias("standalone"),
        K.busy(pick(_STATES, F.col("o_orderkey") % 4), F.lit(None).cast("string"), upload).alias("busy"),
        K.skips_upload(upload, results).alias("skips"),
        K.resumes_upload(upload, error, F.col("o_custkey") % 3 == 0).alias("resumes"),
    )


@query("""WITH p AS (SELECT p_partkey, (p_size % 5) * 100 AS w, (p_partkey % 4) * 150 AS h, ['portrait', 'landscape', 'square'][p_partkey % 3 + 1] AS aspect, CASE p_size % 3 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END AS upright FROM part)
SELECT p_partkey, CASE WHEN w > 0 AND h > 0 THEN CASE aspect WHEN 'portrait' THEN h > w WHEN 'landscape' THEN w > h ELSE w = h END ELSE coalesce(aspect <> 'square' AND upright = (aspect = 'portrait'), FALSE) END AS fits FROM p""")
def aspect_matches(spark, d):
    aspect = F.get(F.array(F.lit("portrait"), F.lit("landscape"), F.lit("square")), (F.col("p_partkey") % 3).cast("int"))
    upright = F.when(F.col("p_size") % 3 == 0, True).when(F.col("p_size") % 3 == 1, False)
    return D.table(spark, d, "part").select("p_partkey", M.matches_aspect(F.col("p_size") % 5 * 100, F.col("p_partkey") % 4 * 150, aspect, upright).alias("fits"))


_PLAIN = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\*', '', 'g'), '(?m)^#+\s+', '', 'g'), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g')"


@query(rf"""WITH p AS (SELECT conv_id, turn, {_PLAIN} AS t, regexp_extract(trim(text), '^[^.!?。！？\n]+[.!?。！？]?') AS f FROM conversations WHERE text IS NOT NULL),
s AS (SELECT conv_id, turn, unnest(range(len(q))) AS i, unnest(q) AS x FROM (SELECT *, list_filter(string_split(regexp_replace(t, '([.!?。！？])\s+', '\1' || chr(10), 'g'), chr(10)), lambda x: x <> '') AS q FROM p)),
c AS (SELECT *, sum(len(string_split(x, ' '))) OVER (PARTITION BY conv_id, turn ORDER BY i) AS upto, len(string_split(x, ' ')) AS n FROM s),
k AS (SELECT conv_id, turn, string_agg(x, ' ' ORDER BY i) AS cut FROM c WHERE i = 0 OR (upto <= 12 AND upto - n < 12) GROUP BY ALL)
SELECT p.conv_id, p.turn, CASE WHEN len(string_split(t, ' ')) <= 12 THEN t ELSE cut END AS script, rtrim(left(f, 220)) AS hook, greatest(80, CAST(floor(greatest(30, least(90, p.turn * 20)) * 150 / 60 + 0.5) AS BIGINT)) AS words FROM p LEFT JOIN k USING (conv_id, turn)""")
def short_scripts(spark, d):
    c = D.table(spark, d, "conversations").filter("text is not null")
    return c.select("conv_id", "turn", T.clamp_script(F.col("text"), 12).alias("script"), T.first_sentence(F.col("text")).alias("hook"), T.target_words(F.col("turn") * 20, F.lit(150)).alias("words"))


_NAMES = ["tiktok", " YouTube_Shorts ", "instagram_reels", "facebook_reels", "other"]


@query(rf"""WITH p AS (SELECT p_partkey, p_size % 5 AS k, CASE p_size % 5 WHEN 0 THEN 100 WHEN 1 THEN 100 WHEN 2 THEN 125 WHEN 3 THEN 125 ELSE 100 END AS most, [5, 6, 8, 5, 5][p_size % 5 + 1] AS tags, repeat(p_name || ' ', p_size % 9 + 1) AS name, p_brand AS brand, p_type AS type, p_partkey % 4 AS how FROM part)
SELECT p_partkey, CASE how WHEN 3 THEN rtrim(left(trim(name), most)) WHEN 2 THEN '' ELSE rtrim(left(trim(name), most)) END AS title, CASE how WHEN 3 THEN trim(name) || ' — watch to the end and follow for more.' WHEN 1 THEN '' ELSE type END AS caption,
  array_to_string(CASE how WHEN 3 THEN ['#shorts', '#viral', '#trending', '#fyp', '#video', '#reels', '#creator', '#content'][1:tags] WHEN 1 THEN list_transform(list_filter(string_split(lower(brand) || ' a_1', ' '), lambda x: x <> ''), lambda x: '#' || replace(x, '#', '')) ELSE ['#' || replace(replace(brand, '#', ''), ' ', ''), '#tag2', '#c3', '#d', '#e', '#f', '#g'][1:tags] END, ' ') AS hashtags FROM p""")
def social_texts(spark, d):
    """Replies with a list or one text of hashtags, without a title, or with nothing to say, for which the fallback stands."""
    name, how = F.repeat(F.concat("p_name", F.lit(" ")), F.col("p_size") % 9 + 1), F.col("p_partkey") % 4
    tags = F.array(F.concat(F.lit("#"), "p_brand"), F.concat(F.lower("p_brand"), F.lit("!")), F.lit("tag-2"), F.lit("#c3"), F.lit(""), F.lit("d"), F.lit("e"), F.lit("f"), F.lit("g"))
    full = F.to_json(F.struct(name.alias("title"), F.col("p_type").alias("caption"), tags.alias("hashtags")))
    bare = F.to_json(F.struct(name.alias("title"), F.concat(F.lower("p_brand"), F.lit(" a_1")).alias("hashtags")))
    untitled = F.to_json(F.struct(F.col("p_type").alias("caption"), tags.alias("hashtags")))
    reply = F.when(how == 0, full).when(how == 1, bare).when(how == 2, untitled).otherwise('{"hashtags":["x"]}')
    platform = F.get(F.array(*map(F.lit, _NAMES)), (F.col("p_size") % 5).cast("int"))
    got = D.table(spark, d, "part").select("p_partkey", F.coalesce(P.social_metadata(reply, platform), P.social_fallback(name, F.lit(""), platform)).alias("m"))
    return got.select("p_partkey", "m.title", "m.caption", F.array_join("m.hashtags", " ").alias("hashtags"))


@query("""SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN 'ger' WHEN 1 THEN 'fra' WHEN 2 THEN 'chi' ELSE 'und' END AS track, 'clips/' || replace(p_name, ' ', '.') || '.srt' AS sidecar FROM part""")
def soft_tracks(spark, d):
    tag = F.get(F.array(*map(F.lit, [" DE_at", "fra", "zh-Hant", "xx-YY", "", "q"])), (F.col("p_size") % 6).cast("int"))
    video = F.concat(F.lit("clips/"), F.replace(F.col("p_name"), F.lit(" "), F.lit(".")), F.lit(".mp4"))
    return D.table(spark, d, "part").select("p_partkey", R.track_code(tag).alias("track"), R.sidecar(video).alias("sidecar"))
