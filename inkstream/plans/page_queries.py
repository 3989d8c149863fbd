"""Registered queries over lists and their pages, listings, captions, stored settings and the states of books."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import publish as P
from ..functions import text as T
from ..operators import cues as Q
from ..operators import links as K
from ..operators import review as V
from ..operators import state as S
from ..sources import plain
from . import domain as D
from .queries import _BLOCKS, _DECISIONS, _PARTS, _SECONDS, _SEGMENTS, _TIME, _TRIM, _decisions, query

_ONE = r"trim(regexp_replace({0}, '[\s\x{{00A0}}]+', ' ', 'g'))"


@query("SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders) AS total FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 50")
def page_with_total(spark, d):
    rows = D.table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return V.page_with_total(rows, [F.desc("o_totalprice"), F.col("o_orderkey")], 3, 25)


@query("SELECT c_custkey, (SELECT count(*) FROM customer WHERE c_acctbal < 0) AS total FROM customer WHERE c_acctbal < 0 ORDER BY c_custkey LIMIT 10")
def first_page_of_filtered(spark, d):
    rows = D.table(spark, d, "customer").filter("c_acctbal < 0").select("c_custkey")
    return V.page_with_total(rows, [F.col("c_custkey")], 0, 10)


_STORED = """books AS (SELECT o_orderkey AS book_id, CASE o_orderkey % 7 WHEN 0 THEN 'extracting' WHEN 1 THEN 'ocr_pending' WHEN 2 THEN 'ocr' WHEN 3 THEN 'failed' WHEN 4 THEN 'complete' WHEN 5 THEN 'ready' ELSE 'rendering' END AS state FROM orders)"""
_PROGRESS = """p AS (SELECT book_id, count(*) AS total, count(*) FILTER (state = 'pending') AS pending, count(*) FILTER (state = 'queued') AS queued, count(*) FILTER (state = 'rendering') AS rendering, count(*) FILTER (state = 'complete') AS complete, count(*) FILTER (state = 'failed') AS failed FROM segments GROUP BY 1),
q AS (SELECT *, CASE WHEN queued + rendering > 0 THEN 'rendering' WHEN complete = total THEN 'complete' WHEN failed = total THEN 'failed' ELSE 'ready' END AS derived_state, CAST(floor(100.0::DOUBLE * complete / total + 0.5) AS BIGINT) AS progress FROM p)"""


def _books(spark, d):
    states = F.array(*map(F.lit, ["extracting", "ocr_pending", "ocr", "failed", "complete", "ready", "rendering"]))
    return D.table(spark, d, "orders").select(F.col("o_orderkey").alias("book_id"), F.get(states, (F.col("o_orderkey") % 7).cast("int")).alias("state"))


@query(f"WITH {_SEGMENTS}, {_STORED}, {_PROGRESS} SELECT b.book_id, CASE WHEN b.state IN ('extracting', 'ocr_pending', 'ocr', 'failed') THEN b.state ELSE coalesce(q.derived_state, 'ready') END AS state FROM books b LEFT JOIN q USING (book_id)")
def synced_books(spark, d):
    return S.synced(_books(spark, d), S.progress(D.segments(spark, d)))


@query(f"WITH {_SEGMENTS}, {_STORED}, {_PROGRESS} SELECT b.book_id, b.state, coalesce(total, 0) AS total, coalesce(pending, 0) AS pending, coalesce(queued, 0) AS queued, coalesce(rendering, 0) AS rendering, coalesce(complete, 0) AS complete, coalesce(failed, 0) AS failed, coalesce(progress, 0) AS progress, coalesce(derived_state, 'ready') AS derived_state FROM books b LEFT JOIN q USING (book_id)")
def books_with_progress(spark, d):
    return S.with_progress(_books(spark, d), D.segments(spark, d))


_CACHE = """requests AS (SELECT o_orderkey, o_custkey AS k, CASE o_orderkey % 3 WHEN 0 THEN 'portrait' WHEN 1 THEN 'landscape' ELSE 'square' END AS aspect, upper(o_orderpriority) AS term FROM orders),
stored AS (SELECT p_partkey AS k, p_size AS expires_at, p_size % 3 AS n, p_partkey % 5 AS w FROM part WHERE p_brand <> 'Brand#1'),
looked AS (SELECT r.*, coalesce(expires_at > 24 AND n > 0 AND (aspect = 'square' OR (aspect = 'portrait' AND w < 3 AND (n < 2 OR w < 2)) OR (aspect = 'landscape' AND w > 3)), FALSE) AS hit, n FROM requests r LEFT JOIN stored USING (k))"""


def _cache(spark, d):
    # an entry's items grow wider one by one: widths w and w + 1 against a height of 3
    item = lambda i: F.struct(F.lit(i).alias("i"), (F.col("p_partkey") % 5 + i).alias("width"), F.lit(3).cast("long").alias("height"), F.lit("as stored").alias("term"))
    items = F.slice(F.array(item(0), item(1)), 1, F.col("p_size") % 3)
    stored = D.table(spark, d, "part").filter("p_brand <> 'Brand#1'").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("expires_at"), items.alias("items"))
    aspect = F.get(F.array(F.lit("portrait"), F.lit("landscape"), F.lit("square")), (F.col("o_orderkey") % 3).cast("int"))
    return D.table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("k"), aspect.alias("aspect"), F.upper("o_orderpriority").alias("term")), stored


@query(f"WITH {_CACHE} SELECT o_orderkey, hit FROM looked")
def cache_hits_by_aspect(spark, d):
    return S.cache_hits(*_cache(spark, d), "k", F.lit(24)).select("o_orderkey", "hit")


@query(f"WITH {_CACHE} SELECT o_orderkey, CAST(i AS INT) AS i, term FROM looked, range(2) r(i) WHERE hit AND i < n")
def cached_items_of_requests(spark, d):
    return S.cached_items(*_cache(spark, d), "k", F.lit(24)).select("o_orderkey", "item.i", "item.term")


@query(f"WITH {_CACHE} SELECT k, count(*) AS waiting FROM looked WHERE NOT hit GROUP BY 1")
def coalesced_searches(spark, d):
    return S.searches(*_cache(spark, d), "k", F.lit(24))


@query(
    f"""WITH {_DECISIONS}, r AS (SELECT *, rule || ' at ' || block_id || ' of ' || book_id AS reason FROM decided)
SELECT rule, count(CASE WHEN keep THEN 1 END) AS kept, count(CASE WHEN NOT keep THEN 1 END) AS dropped, arg_min(reason, book_id * 1000000000 + ord) AS reason FROM r GROUP BY 1"""
)
def decision_reasons(spark, d):
    from ..operators import classify as C

    told = _decisions(spark, d).withColumn("reason", F.concat("rule", F.lit(" at "), "block_id", F.lit(" of "), "book_id"))
    return C.summary(told)


_REVIEW = f"WITH {_DECISIONS}, rows_ AS (SELECT d.*, b.chapter_id, CASE WHEN d.ord % 11 = 0 THEN 'user' ELSE 'structural' END AS source FROM decided d JOIN blocks b USING (book_id, block_id))"


def _review(spark, d):
    rows = _decisions(spark, d).drop("source").join(D.blocks(spark, d).select("book_id", "block_id", "chapter_id"), ["book_id", "block_id"])
    return rows.withColumn("source", F.when(F.col("ord") % 11 == 0, "user").otherwise("structural"))


@query(f"{_REVIEW} SELECT 'dropped' AS shown, book_id, block_id FROM rows_ WHERE chapter_id = 'ch-3' AND NOT keep UNION ALL SELECT 'overridden', book_id, block_id FROM rows_ WHERE source = 'user' UNION ALL SELECT 'kept', book_id, block_id FROM rows_ WHERE keep AND rule = 'default_keep' AND chapter_id = 'ch-7' UNION ALL SELECT 'all', book_id, block_id FROM rows_ WHERE rule = 'copyright_notice'")
def review_filters(spark, d):
    rows = _review(spark, d)
    pick = lambda shown, **kw: V.visible(rows, show=shown, **kw).select(F.lit(shown).alias("shown"), "book_id", "block_id")
    return pick("dropped", chapter="ch-3").unionByName(pick("overridden")).unionByName(pick("kept", chapter="ch-7", rule="default_keep")).unionByName(pick("all", rule="copyright_notice"))


@query(f"{_REVIEW} SELECT book_id, block_id, CAST(row_number() OVER (PARTITION BY book_id ORDER BY confidence, ord) AS INT) AS place FROM rows_")
def review_order(spark, d):
    return V.unsure_first(_review(spark, d), "book_id").select("book_id", "block_id", "place")


@query("""WITH t AS (SELECT conv_id, CASE WHEN role = 'user' THEN 'ch-u' WHEN turn % 4 = 1 THEN 'ch-a' ELSE '' END AS chapter_id, CASE WHEN turn % 3 = 0 THEN '' ELSE 'T' || turn END AS title, turn FROM conversations)
SELECT conv_id, chapter_id, arg_min(CASE WHEN title = '' THEN chapter_id ELSE title END, turn) AS title FROM t WHERE chapter_id <> '' GROUP BY 1, 2""")
def chapters_so_far(spark, d):
    chapter = F.when(F.col("role") == "user", "ch-u").when(F.col("turn") % 4 == 1, "ch-a").otherwise("")
    title = F.when(F.col("turn") % 3 == 0, "").otherwise(F.concat(F.lit("T"), "turn"))
    rows = D.table(spark, d, "conversations").select("conv_id", chapter.alias("chapter_id"), title.alias("title"), F.col("turn").alias("ord"))
    return V.chapters_seen(rows, "conv_id")


@query(f"""WITH s AS (SELECT doc_id // 50 AS book_id, n_chars AS e, CASE WHEN doc_id % 9 = 0 THEN 'failed' ELSE 'complete' END AS state, {_TRIM.format("text")} AS t FROM documents)
SELECT book_id, CAST(sum(e) AS BIGINT) AS seconds, count(*) FILTER (state = 'failed') AS failed, count(*) FILTER (length(t) <= 160) AS stubs FROM s GROUP BY 1""")
def panel_totals(spark, d):
    t = D.table(spark, d, "documents").select(F.floor(F.col("doc_id") / 50).alias("book_id"), F.col("n_chars").alias("estimated_duration"), F.when(F.col("doc_id") % 9 == 0, "failed").otherwise("complete").alias("state"), F.col("text").alias("description"))
    return V.panel_totals(t, "book_id")


@query("""SELECT page_id, CASE WHEN page_id % 4 = 0 THEN NULL ELSE '/files/' || regexp_replace(url, '^.*/', '') END AS video_url, page_id % 6 AS block_count FROM pages""")
def public_rows(spark, d):
    path = F.when(F.col("page_id") % 4 != 0, F.col("url"))
    ids = F.slice(F.sequence(F.lit(1), F.lit(6)), F.lit(1), (F.col("page_id") % 6).cast("int"))
    rows = D.table(spark, d, "pages").select("page_id", path.alias("video_path"), F.lit("s").alias("secret"), ids.alias("block_ids"))
    return V.public(rows, ["secret"], {"video_path": "video_url"}, "/files/", "block_ids").withColumn("block_count", F.col("block_count").cast("long"))


@query("""WITH b AS (SELECT l_orderkey AS k, CASE l_linenumber % 3 WHEN 0 THEN 'center' WHEN 1 THEN 'top' ELSE 'bottom' END AS kind, l_linenumber AS seq, l_quantity AS y, l_extendedprice / 1000 AS height FROM lineitem),
m AS (SELECT k, kind, min(seq) AS s, min(y) AS y, max(y + height) - min(y) AS height FROM b GROUP BY 1, 2) SELECT k, kind, y, round(height, 6) AS height, CAST(row_number() OVER (PARTITION BY k ORDER BY s) AS INT) AS place FROM m""")
def cover_bands(spark, d):
    kind = F.get(F.array(F.lit("center"), F.lit("top"), F.lit("bottom")), (F.col("l_linenumber") % 3).cast("int"))
    b = D.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), kind.alias("kind"), F.col("l_linenumber").alias("seq"), F.col("l_quantity").alias("y"), (F.col("l_extendedprice") / 1000).alias("height"))
    return V.merged_bands(b, "k").withColumn("height", F.round("height", 6))


@query("SELECT user_id, event_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // 64 AS batch FROM events")
def overlay_batches(spark, d):
    return V.batches(D.table(spark, d, "events"), "user_id", ["ts", "event_id"]).select("user_id", "event_id", "batch")


@query("""WITH w AS (SELECT DISTINCT o_custkey AS k FROM orders), a AS (SELECT o_custkey AS k, o_orderkey AS item, 0 AS source FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT o_custkey, o_orderkey, 1 FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_custkey, o_orderkey, 2 FROM orders)
SELECT k, item, CAST(source AS INT) AS source FROM (SELECT *, min(source) OVER (PARTITION BY k) AS f FROM a) WHERE source = f""")
def first_channels(spark, d):
    o = D.table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("item"), "o_orderstatus")
    return V.first_source(o, [o.filter("o_orderstatus = 'P'"), o.filter("o_orderstatus = 'F'"), o], "k", "item")


_TALK = "texts AS (SELECT conv_id, list(text ORDER BY turn) AS texts FROM conversations GROUP BY 1)"


def _talk(spark, d):
    c = D.table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    return c.select("conv_id", F.transform("t", lambda x: x["text"]).alias("texts"))


def _clipped(most: int, extra: int, least: int) -> str:
    return rf"""WITH l AS (SELECT conv_id, turn, {_ONE.format("text")} AS t FROM conversations),
u AS (SELECT *, coalesce(sum(length(t) + {extra}) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used, coalesce(max(CASE WHEN over THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM (SELECT *, length(t) > {most} - coalesce(sum(length(t) + {extra}) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS over FROM l WHERE t <> '')),
c AS (SELECT conv_id, turn, CASE WHEN over THEN regexp_replace(left(t, CAST({most} - used AS BIGINT)), '\s+$', '') || '…' ELSE t END AS t FROM u WHERE before = 0 AND {most} - used > {least})"""


@query(_clipped(300, 2, 0) + " SELECT k.conv_id, coalesce(string_agg(t, chr(10) || chr(10) ORDER BY turn), '') AS excerpt FROM (SELECT DISTINCT conv_id FROM conversations) k LEFT JOIN c USING (conv_id) GROUP BY 1")
def segment_excerpts(spark, d):
    return _talk(spark, d).select("conv_id", P.excerpt(F.col("texts"), 300).alias("excerpt"))


@query(_clipped(400, 16, 80) + " SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INT) AS line, t AS text FROM c")
def passage_lines(spark, d):
    return _talk(spark, d).select("conv_id", F.posexplode(P.passage_lines(F.col("texts"), 400)).alias("line", "text"))


@query(rf"WITH {_TALK} SELECT conv_id, md5(array_to_string(list_filter(list_transform(texts, lambda x: {_TRIM.format('x')}), lambda x: x <> ''), chr(10) || chr(10))) AS text_md5 FROM texts")
def narration_texts(spark, d):
    return _talk(spark, d).select("conv_id", F.md5(P.joined(F.col("texts"))).alias("text_md5"))


@query("""WITH p AS (SELECT p_partkey, p_name AS book, CASE WHEN p_size % 3 = 0 THEN '' ELSE p_brand END AS author, CASE WHEN p_size % 5 = 0 THEN p_name ELSE p_type END AS chapter, CASE WHEN p_size % 4 = 0 THEN 0 ELSE p_size END AS n FROM part)
SELECT p_partkey, (CASE WHEN book = chapter THEN book ELSE book || ' - ' || chapter END) || CASE WHEN n > 0 THEN ' | Episode ' || n ELSE '' END AS title,
  chapter || chr(10) || chr(10) || 'From "' || book || '"' || CASE WHEN author <> '' THEN ' by ' || author ELSE '' END || '.' || chr(10) || chr(10) || '#audiobook #books' AS description,
  array_to_string(list_filter([book, author, CASE WHEN chapter = book THEN '' ELSE chapter END, 'audiobook', 'books'], lambda x: x <> ''), '|') AS tags FROM p""")
def segment_listings(spark, d):
    author = F.when(F.col("p_size") % 3 == 0, "").otherwise(F.col("p_brand"))
    chapter = F.when(F.col("p_size") % 5 == 0, F.col("p_name")).otherwise(F.col("p_type"))
    got = P.segment_listing(F.col("p_name"), author, chapter, F.when(F.col("p_size") % 4 == 0, 0).otherwise(F.col("p_size")))
    return D.table(spark, d, "part").select("p_partkey", got.alias("l")).select("p_partkey", "l.title", "l.description", F.array_join("l.tags", "|").alias("tags"))


@query("""WITH p AS (SELECT p_partkey, p_name AS book, p_brand AS author, CASE WHEN p_size % 3 = 0 THEN '' ELSE p_type END AS name, CASE WHEN p_size % 2 = 0 THEN '' ELSE 'Why ' || p_type || '?' END AS hook FROM part)
SELECT p_partkey, CASE WHEN name <> '' THEN name WHEN hook <> '' THEN hook ELSE 'All ' || book END AS title,
  (CASE WHEN hook <> '' THEN hook ELSE 'All ' || book || '. And more' END) || chr(10) || chr(10) || 'A teaser from "' || book || '" by ' || author || '. Watch the full book video.' || chr(10) || chr(10) || '#shorts #books #audiobook' AS description FROM p""")
def short_listings(spark, d):
    name = F.when(F.col("p_size") % 3 == 0, "").otherwise(F.col("p_type"))
    hook = F.when(F.col("p_size") % 2 == 0, "").otherwise(F.concat(F.lit("Why "), "p_type", F.lit("?")))
    got = P.short_listing(F.col("p_name"), F.col("p_brand"), name, hook, F.concat(F.lit("All "), "p_name", F.lit(". And more")))
    return D.table(spark, d, "part").select("p_partkey", got.alias("l")).select("p_partkey", "l.title", "l.description")


@query("""SELECT p_partkey, p_size % 4 <> 3 AS told, CASE WHEN p_size % 4 = 3 THEN NULL WHEN p_size % 4 = 0 THEN 'given ' || p_partkey ELSE 'fallback' END AS title, CASE p_size % 4 WHEN 3 THEN NULL WHEN 2 THEN 'caption ' || p_partkey ELSE CASE WHEN p_size % 4 = 1 THEN 'text' ELSE 'none' END END AS description,
CASE p_size % 4 WHEN 3 THEN NULL WHEN 0 THEN 'a|b' WHEN 1 THEN 'x y|z' ELSE 'f' END AS tags FROM part""")
def finished_listings(spark, d):
    q = lambda k, v: F.concat(F.lit(f'"{k}":"'), v, F.lit('"'))
    reply = (
        F.when(F.col("p_size") % 4 == 0, F.concat(F.lit("{"), q("youtube_title", F.concat(F.lit("given "), "p_partkey")), F.lit(',"tags":["#a","b","A"]}')))
        .when(F.col("p_size") % 4 == 1, F.lit('{"description":" text ","hashtags":"x  y; z"}'))
        .when(F.col("p_size") % 4 == 2, F.concat(F.lit("{"), q("caption", F.concat(F.lit("caption "), "p_partkey")), F.lit("}")))
        .otherwise(F.lit('{"tags":["only"]}'))
    )
    back = F.struct(F.lit("fallback").alias("title"), F.lit("none").alias("description"), F.array(F.lit("f")).alias("tags"))
    got = D.table(spark, d, "part").select("p_partkey", P.finished_listing(reply, back).alias("l"))
    return got.select("p_partkey", F.col("l").isNotNull().alias("told"), "l.title", "l.description", F.when(F.col("l").isNotNull(), F.array_join("l.tags", "|")).alias("tags"))


@query("""WITH e AS (SELECT l_orderkey, l_linenumber - CASE WHEN l_partkey % 11 = 0 THEN 0.5 WHEN l_partkey % 13 = 0 THEN 9 ELSE 1 END AS i, l_partkey % 7 = 0 AS outside, greatest(l_quantity - 5, 0) AS duration, l_suppkey % 9 = 0 AS silent, l_suppkey % 8 = 0 AS endless, l_orderkey % 10 = 0 AS later FROM lineitem)
SELECT l_orderkey, CASE WHEN any_value(later) THEN -1 ELSE CAST(count(*) FILTER (i >= 0 AND i = floor(i) AND NOT outside AND duration > 0 AND NOT silent AND NOT endless) AS INT) END AS sound, round(coalesce(sum(duration) FILTER (NOT later AND i >= 0 AND i = floor(i) AND NOT outside AND duration > 0 AND NOT silent AND NOT endless), 0), 6)::DOUBLE AS seconds FROM e GROUP BY 1""")
def manifest_entries(spark, d):
    """Every order's lines as the chunks of a manifest: some with a place that is none, a path, no length, no codec or a cue without an end; every tenth is of another version."""
    place = F.col("l_linenumber") - F.when(F.col("l_partkey") % 11 == 0, 0.5).when(F.col("l_partkey") % 13 == 0, 9).otherwise(1)
    file = F.concat(F.when(F.col("l_partkey") % 7 == 0, "../").otherwise(""), F.lit("part-"), "l_partkey", F.lit(".mp3"))
    cue = F.struct(F.lit(1.0).alias("index"), F.lit(0.0).alias("start"), F.when(F.col("l_suppkey") % 8 > 0, F.col("l_quantity").cast("double")).alias("end"), F.lit("x").alias("text"))
    chunk = F.struct(
        place.cast("double").alias("index"), F.md5(F.col("l_partkey").cast("string")).alias("hash"), file.alias("file"), F.greatest(F.col("l_quantity") - 5, F.lit(0)).cast("double").alias("duration"),
        F.when(F.col("l_suppkey") % 9 > 0, "mp3").alias("codec"), F.lit(24000).alias("sampleRate"), F.lit(1).alias("channels"), F.array(cue).alias("cues"),
    )
    books = D.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.to_json(F.struct(F.when(F.col("l_orderkey") % 10 == 0, 2).otherwise(1).alias("version"), F.collect_list(chunk).alias("chunks"))).alias("body"))
    found = books.select("l_orderkey", P.manifest_chunks(F.col("body")).alias("c"))
    seconds = F.aggregate(F.coalesce("c", F.expr("cast(array() as " + P.CHUNKS + ")")), F.lit(0.0), lambda s, x: s + x["duration"])
    return found.select("l_orderkey", F.when(F.col("c").isNotNull(), F.size("c")).otherwise(-1).alias("sound"), F.round(seconds, 6).alias("seconds"))


@query("""SELECT p_partkey, p_size % 4 NOT IN (0, 1) AND p_size > 10 AS music, CASE WHEN p_size > 40 THEN 'accept' WHEN p_size % 3 = 0 THEN 'reject' WHEN p_size % 2 = 0 THEN 'reject: recogniser off' ELSE 'recognise' END AS outcome,
CASE WHEN p_size <= 40 AND p_size % 3 <> 0 AND p_size % 2 <> 0 THEN '2,7,' || (p_size + 10) END AS pages FROM part""")
def gates(spark, d):
    kind = F.when(F.col("p_size") % 4 == 0, None).when(F.col("p_size") % 4 == 1, " ").otherwise("random")
    music = P.music_wanted(kind, F.col("p_size") - 10)
    pages = F.when(F.col("p_size") % 3 == 0, F.array().cast("array<int>")).otherwise(F.array((F.col("p_size") + 10).cast("int"), F.lit(7), F.lit(2)))
    outcome = P.extraction_outcome(F.col("p_size") - 40, pages, F.col("p_size") % 2 != 0)
    got = D.table(spark, d, "part").select("p_partkey", music.alias("music"), outcome.alias("o"))
    return got.select("p_partkey", "music", F.col("o.action").alias("outcome"), F.array_join("o.pages", ",").alias("pages"))


_NAMES = ["en-US-AvaNeural", "bn-BD-NabanitaNeural", "de-DE-KatjaNeural-V2", "en-GB-RyanNeural-V2", "kokoro:af_heart", "no-voice"]


@query("""WITH v AS (SELECT s_suppkey, ['en-US-AvaNeural', 'bn-BD-NabanitaNeural', 'de-DE-KatjaNeural-V2', 'en-GB-RyanNeural-V2', 'kokoro:af_heart', 'no-voice'][s_suppkey % 6 + 1] AS v, CASE WHEN s_suppkey % 2 = 0 THEN 'Female' ELSE 'Male' END AS g FROM supplier)
SELECT s_suppkey, v AS plain, CASE WHEN v LIKE '%-V2' THEN replace(v, '-V2', '') ELSE '' END AS base, CASE WHEN v LIKE 'kokoro:%' THEN 'kokoro' WHEN v LIKE '%-V2' THEN 'azure-tts-v2' ELSE 'azure-tts-v1' END AS service, v = 'no-voice' AS silent,
CASE WHEN (v LIKE 'en-%' OR v LIKE 'bn-%') AND NOT v LIKE '%V2%' THEN v || '-' || g END AS listed FROM v""")
def voices(spark, d):
    name = F.get(F.array(*map(F.lit, _NAMES)), (F.col("s_suppkey") % 6).cast("int"))
    gender = F.when(F.col("s_suppkey") % 2 == 0, "Female").otherwise("Male")
    shown = F.concat(name, F.lit("-"), gender)
    return D.table(spark, d, "supplier").select("s_suppkey", P.plain_voice(shown).alias("plain"), P.second_version(shown).alias("base"), P.voice_service(shown).alias("service"), P.no_voice(name).alias("silent"), P.listed_voices(name, gender, ["bn-", "en-"], False).alias("listed"))


@query("""WITH e AS (SELECT l_orderkey AS k, CAST(l_linenumber AS DOUBLE) AS n, count(*) OVER (PARTITION BY l_orderkey) AS total FROM lineitem)
SELECT k, CAST(n AS INT) AS done, round(5 + n / total * 95 * 0.7, 6) AS percent, CAST(n AS INT) % 7 BETWEEN 1 AND 3 AS runs FROM e""")
def staged_progress(spark, d):
    total = F.count("*").over(Window.partitionBy("l_orderkey"))
    stages = F.array(F.lit("upload"), *map(F.lit, P.STAGES))
    l = D.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("done"), total.alias("total"))
    return l.select("k", F.col("done").cast("int").alias("done"), F.round(P.staged_progress(F.col("done"), F.col("total")), 6).alias("percent"), P.runs_stage(F.get(stages, (F.col("done") % 7).cast("int")), F.lit("audio")).alias("runs"))


@query("""WITH RECURSIVE e AS (SELECT l_suppkey AS k, CAST(l_orderkey AS DOUBLE) / 100 AS sec, l_quantity / 50 AS value FROM lineitem),
o AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY sec, value) AS n FROM e),
f AS (SELECT k, n, CASE WHEN value > -1 AND (sec >= 1 OR value + 1 >= 0.02 OR value >= 1) THEN sec ELSE 0 END AS t, CASE WHEN value > -1 AND (sec >= 1 OR value + 1 >= 0.02 OR value >= 1) THEN value ELSE -1 END AS v, value > -1 AND (sec >= 1 OR value + 1 >= 0.02 OR value >= 1) AS emitted FROM o WHERE n = 1
  UNION ALL SELECT k, n, CASE WHEN due THEN sec ELSE t END, CASE WHEN due THEN value ELSE v END, due FROM (SELECT o.k, o.n, o.sec, o.value, f.t, f.v, o.value > f.v AND (o.sec - f.t >= 1 OR o.value - f.v >= 0.02 OR o.value >= 1) AS due FROM f JOIN o ON o.k = f.k AND o.n = f.n + 1))
SELECT k, t AS "at", v AS value FROM f WHERE emitted""")
def throttled_progress(spark, d):
    e = D.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("k"), (F.col("l_orderkey") / 100).alias("at"), (F.col("l_quantity") / 50).alias("value"))
    return S.throttled(e, "k", "at", "value")


@query("""WITH e AS (SELECT event_type, 'clip-' || event_id || CASE WHEN event_id % 11 = 0 THEN '.tmp' ELSE '.mp4' END AS name, CAST(value * 100 AS BIGINT) AS bytes, ts, event_id % 13 = 0 AS linked FROM events),
o AS (SELECT *, name LIKE '%.mp4' AND NOT linked AS ok FROM e WHERE ts <= TIMESTAMP '2024-01-15 00:00:00' OR ts > TIMESTAMP '2024-01-25 00:00:00')
SELECT event_type, count(*) AS candidates, count(*) FILTER (ok) AS deleted, CAST(coalesce(sum(bytes) FILTER (ok), 0) AS BIGINT) AS freed, count(*) FILTER (NOT ok) AS failed FROM o GROUP BY 1""")
def cleaned_cache(spark, d):
    name = F.concat(F.lit("clip-"), "event_id", F.when(F.col("event_id") % 11 == 0, ".tmp").otherwise(".mp4"))
    e = D.table(spark, d, "events").select("event_type", name.alias("name"), F.round(F.col("value") * 100).cast("long").alias("bytes"), F.col("ts").alias("made_at"), (F.col("event_id") % 13 == 0).alias("linked"))
    return S.cleaned(e, "event_type", F.expr("timestamp'2024-01-25 00:00:00'"), F.expr("interval 10 days"))


@query(f"""WITH {_TALK}, s AS (SELECT conv_id, [texts[1], 'The  end', 'the end', texts[2], 'by someone', ''] AS lines FROM texts), first AS (SELECT conv_id, lower({_ONE.format("text")}) AS t FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations WHERE turn > 0) WHERE n <= 6),
u AS (SELECT conv_id, i, {_ONE.format("lines[i]")} AS l FROM (SELECT conv_id, lines, unnest(range(1, 7)) AS i FROM s)), k AS (SELECT *, lower(l) AS kk, row_number() OVER (PARTITION BY conv_id, lower(l) ORDER BY i) AS rn FROM u WHERE coalesce(l, '') <> ''),
o AS (SELECT conv_id, i, l FROM k WHERE rn = 1 AND NOT EXISTS (SELECT 1 FROM first f WHERE f.conv_id = k.conv_id AND f.t <> '' AND starts_with(f.t, k.kk)))
SELECT t.conv_id, coalesce(string_agg(l, '|' ORDER BY i), '') AS lines FROM texts t LEFT JOIN o USING (conv_id) GROUP BY 1""")
def opening_lines(spark, d):
    t = _talk(spark, d)
    lines = F.array(F.get("texts", 0), F.lit("The  end"), F.lit("the end"), F.get("texts", 1), F.lit("by someone"), F.lit(""))
    blocks = D.table(spark, d, "conversations").filter("turn > 0").select("conv_id", F.col("turn").alias("ord"), "text")
    return V.openings(t.select("conv_id", F.filter(lines, lambda x: x.isNotNull()).alias("lines")), blocks, "conv_id").select("conv_id", F.array_join("lines", "|").alias("lines"))


@query(rf"""WITH c AS (SELECT conv_id, turn, length(text) / 15.0::DOUBLE AS duration, {_PARTS.format("text")} AS p FROM conversations WHERE {_TRIM.format("text")} <> ''),
s AS (SELECT *, coalesce(sum(duration) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS shift FROM c),
r AS (SELECT conv_id, turn, duration, shift, unnest(p) AS content, unnest(range(len(p))) AS pos FROM s),
e AS (SELECT *, CASE WHEN lead(pos) OVER w IS NULL THEN duration ELSE duration * sum(length(content)) OVER w / sum(length(content)) OVER (PARTITION BY conv_id, turn) END AS fin FROM r WINDOW w AS (PARTITION BY conv_id, turn ORDER BY pos))
SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, pos) AS INT) AS idx, round(shift + coalesce(lag(fin) OVER (PARTITION BY conv_id, turn ORDER BY pos), 0), 6) AS start, round(shift + fin, 6) AS "end", content FROM e""")
def chunked_narration(spark, d):
    c = D.table(spark, d, "conversations").filter(T.trim(F.col("text")) != "").select("conv_id", F.col("turn").alias("chunk"), "text", (F.length("text") / F.lit(15.0)).alias("duration"))
    cues = Q.proportional(c.withColumn("k", F.struct("conv_id", "chunk")), "k", "text", "duration").select("k.conv_id", "k.chunk", "idx", "start", "end", "content")
    got = Q.offset(c.select("conv_id", "chunk", "duration"), cues, "conv_id")
    return got.select("conv_id", F.col("idx").cast("int").alias("idx"), F.round("start", 6).alias("start"), F.round("end", 6).alias("end"), "content")


@query(rf"""WITH e AS (SELECT event_id // 50 AS k, row_number() OVER (PARTITION BY event_id // 50 ORDER BY event_id) AS idx, event_id, greatest(floor(value), 0) AS s FROM events)
SELECT k, md5(string_agg(idx || chr(10) || {_TIME.format("s")} || ' --> ' || {_TIME.format("(s + 1)")} || chr(10) || 'line ' || event_id || chr(10), chr(10) ORDER BY s, idx)) AS srt_md5 FROM (SELECT k, s, event_id, row_number() OVER (PARTITION BY k ORDER BY s, event_id) AS idx FROM e) GROUP BY 1""")
def srt_documents(spark, d):
    e = D.table(spark, d, "events").select(F.floor(F.col("event_id") / 50).alias("k"), F.col("event_id").alias("idx"), F.greatest(F.floor("value").cast("double"), F.lit(0.0)).alias("start"), F.concat(F.lit("line "), "event_id").alias("content"))
    return Q.to_srt(e.withColumn("end", F.col("start") + 1), "k").select("k", F.md5("srt").alias("srt_md5"))


@query(r"""WITH e AS (SELECT event_id // 50 AS k, event_id, CAST(round(greatest(value, 0) * 100) AS BIGINT) AS a FROM events), l AS (SELECT k, event_id, 'Dialogue: 0,' || (a // 360000) || ':' || lpad(CAST(a // 6000 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(a // 100 % 60 AS VARCHAR), 2, '0') || '.' || lpad(CAST(a % 100 AS VARCHAR), 2, '0') || ',' || ((a + 100) // 360000) || ':' || lpad(CAST((a + 100) // 6000 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST((a + 100) // 100 % 60 AS VARCHAR), 2, '0') || '.' || lpad(CAST((a + 100) % 100 AS VARCHAR), 2, '0') || ',Default,,0,0,0,,\{' || event_id || '\}' AS x FROM e)
SELECT k, count(*) AS n, md5(string_agg(x, chr(10) ORDER BY event_id)) AS events_md5, '&H00332211|&H73CCBBAA|&H00FFFFFF' AS colours FROM l GROUP BY 1""")
def ass_documents(spark, d):
    e = D.table(spark, d, "events").select(F.floor(F.col("event_id") / 50).alias("k"), F.col("event_id").alias("idx"), F.greatest("value", F.lit(0.0)).alias("start"), F.concat(F.lit("{"), "event_id", F.lit("}")).alias("content"))
    colours = F.concat_ws("|", P.ass_colour(F.lit("#112233")), P.ass_colour(F.lit("abc"), 115), P.ass_colour(F.lit("no")))
    doc = Q.to_ass(e.withColumn("end", F.col("start") + 1), "k", 1920, 1080)
    body = F.regexp_replace(F.substring_index("ass", "Effect, Text\n", -1), "\n$", "")
    return doc.select("k", F.size(F.split(body, "\n")).cast("long").alias("n"), F.md5(body).alias("events_md5"), colours.alias("colours"))


@query(rf"""WITH {_BLOCKS}, o AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY ord) - 1 AS pos FROM blocks), s AS (SELECT *, sum(CASE WHEN kind = 'heading' THEN 1 ELSE 0 END) OVER (PARTITION BY book_id ORDER BY pos) AS n, first(kind) OVER (PARTITION BY book_id ORDER BY pos) = 'heading' AS early FROM o),
c AS (SELECT book_id, pos, kind, text, n - CASE WHEN early THEN 1 ELSE 0 END AS ch, n, early FROM s)
SELECT book_id, CAST(pos AS INT) AS ord, 'ch-' || ch AS chapter_id, CAST(ch AS VARCHAR) || ':' || (row_number() OVER (PARTITION BY book_id, ch ORDER BY pos) - 1) AS block_id, CASE WHEN n = 0 THEN 'book ' || book_id ELSE first(text) OVER (PARTITION BY book_id, ch ORDER BY pos) END AS title FROM c""")
def text_chapters(spark, d):
    w = Window.partitionBy("book_id").orderBy("ord")
    blocks = D.blocks(spark, d).select("book_id", (F.row_number().over(w) - 1).alias("pos"), "kind", "level", "text")
    got = plain.text_chapters(blocks, "book_id", F.concat(F.lit("book "), "book_id"))
    return got.select("book_id", F.col("ord").cast("int").alias("ord"), "chapter_id", "block_id", "title")


# blocks of every declared kind, chapters with every landmark, and chapters about the author
_KIND = "CASE WHEN doc_id % 50 IN (4, 6) AND (pos = 0 OR pos = 5) THEN 'heading' " + " ".join(f"WHEN kind <> 'heading' AND ord % {m} = {r} THEN '{k}'" for m, r, k in D.DECLARED) + " ELSE kind END"
_DECLARED = _BLOCKS.replace("blocks AS (", "raw AS (").replace("'paragraph' END AS kind, text FROM", "'paragraph' END AS kind, text, pos, doc_id FROM") + rf""",
shaped AS (SELECT * REPLACE ({_KIND} AS kind, CASE WHEN doc_id % 50 IN (4, 6) AND pos = 0 THEN 'About the Author' ELSE text END AS text) FROM raw),
about AS (SELECT book_id, block_id FROM (SELECT *, doc_id % 50 AS c, min(CASE WHEN pos = 0 THEN 0 END) OVER w AS has, min(CASE WHEN pos = 5 THEN 5 END) OVER w AS shut FROM shaped WINDOW w AS (PARTITION BY book_id, chapter_id)) WHERE c = 3 OR (c = 6 AND has = 0) OR (c = 4 AND has = 0 AND pos < coalesce(shut, 1000000000))),
blocks AS (SELECT s.*, a.book_id IS NOT NULL AS about FROM shaped s LEFT JOIN about a ON s.book_id = a.book_id AND s.block_id = a.block_id)""" + _DECISIONS[len(_BLOCKS):]
_DECLARED = _DECLARED.replace("count(CASE WHEN kind <> 'heading' AND (", "count(CASE WHEN kind = 'page_number' OR kind <> 'heading' AND (").replace("AS pages, count(CASE WHEN ", "AS pages, count(CASE WHEN kind = 'toc_entry' OR ")
_DECLARED = _DECLARED.replace("WHEN k.chapter_id = 'ch-0' THEN", "WHEN k.chapter_id = 'ch-1' THEN 'landmark_toc' WHEN k.chapter_id = 'ch-0' THEN").replace(
    "THEN 'landmark_back_matter'\n",
    "THEN 'landmark_back_matter'\n  WHEN k.chapter_id = 'ch-2' THEN 'landmark_weak' WHEN kind = 'front_matter' THEN 'landmark_declared' WHEN kind = 'back_matter' THEN 'back_declared' WHEN kind = 'footnote' THEN 'footnote_block' WHEN kind = 'page_number' THEN 'page_declared' WHEN kind = 'running_head' THEN 'head_declared' WHEN kind = 'toc_entry' THEN 'toc_declared' WHEN about THEN 'about_the_author'\n",
)


@query(
    f"""WITH {_DECLARED} SELECT book_id, block_id, r = 'default_keep' AS keep, CASE r WHEN 'landmark_weak' THEN 'landmark_front_matter' WHEN 'landmark_declared' THEN 'landmark_front_matter' WHEN 'back_declared' THEN 'landmark_back_matter' WHEN 'page_declared' THEN 'page_number' WHEN 'head_declared' THEN 'repeated_running_head'
 WHEN 'toc_declared' THEN 'toc_entry_shape' ELSE replace(r, '_roman', '') END AS rule, CAST(CASE WHEN r = 'landmark_weak' THEN 0.6 WHEN r LIKE '%declared' OR r = 'footnote_block' THEN 0.95 WHEN r = 'about_the_author' THEN 0.85 WHEN r = 'landmark_toc' THEN 0.98 WHEN r = 'landmark_front_matter' THEN 0.98 WHEN r = 'landmark_back_matter' THEN 0.95
 WHEN r IN ('toc_chapter_shape', 'repeated_running_head') THEN 0.8 WHEN r IN ('copyright_notice', 'page_number') THEN 0.85 WHEN r = 'toc_entry_shape' THEN 0.75 WHEN r = 'page_number_roman' THEN 0.65 WHEN r = 'boilerplate_repeat' THEN 0.7 ELSE 1 END AS DOUBLE) AS confidence FROM decisions"""
)
def classify_declared(spark, d):
    from ..operators import classify as C

    return C.classify(*D.declared(spark, d)).select("book_id", "block_id", "keep", "rule", "confidence")


@query("""SELECT conv_id, turn, list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(text, ''), lambda x: ord(x)::BIGINT)), lambda h, x: (xor(h, x) * 16777619) % 4294967296) AS hash FROM conversations WHERE length(text) > 0""")
def text_hashes(spark, d):
    return D.table(spark, d, "conversations").filter("length(text) > 0").select("conv_id", "turn", T.fnv1a(F.col("text")).alias("hash"))


@query("""WITH k AS (SELECT p_partkey, '{"terms":["' || least(p_name, p_type) || '","' || greatest(p_name, p_type) || '"],"source":"' || p_brand || '","aspect":"9:16"}' AS k FROM part)
SELECT p_partkey, CAST(list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(k, ''), lambda x: ord(x)::BIGINT)), lambda h, x: (xor(h, x) * 16777619) % 4294967296) AS VARCHAR) AS pool FROM k""")
def clip_pools(spark, d):
    return D.table(spark, d, "part").select("p_partkey", P.pool_key(F.array("p_type", "p_name"), F.col("p_brand"), F.lit("9:16")).alias("pool"))


@query(r"""WITH n AS (SELECT page_id, ['con', 'LPT1.tar.gz', ' ..a/b\c: "d"?. ', '   ', 'Chapter <1> | part*'][page_id % 6 + 1] AS fixed, url FROM pages)
SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'untitled con' WHEN 1 THEN 'untitled LPT1.tar.gz' WHEN 2 THEN 'a b c d' WHEN 3 THEN 'untitled' WHEN 4 THEN 'Chapter 1  part' ELSE trim(regexp_replace(regexp_replace(regexp_replace(url, '[/\\]+', ' ', 'g'), '\s+', ' ', 'g'), '[<>:"|?*]', '', 'g'), ' .') END AS folder,
CASE page_id % 6 WHEN 5 THEN 'song.MP3' END AS music FROM n""")
def safe_names(spark, d):
    fixed = F.get(F.array(*map(F.lit, ["con", "LPT1.tar.gz", ' ..a/b\\c: "d"?. ', "   ", "Chapter <1> | part*"])), (F.col("page_id") % 6).cast("int"))
    music = F.get(F.array(*map(F.lit, ["", "con.mp3", "a?.mp3", "x.txt", ".bgm-upload-1.mp3", "C:\\dir\\song.MP3"])), (F.col("page_id") % 6).cast("int"))
    return D.table(spark, d, "pages").select("page_id", T.output_name(F.coalesce(fixed, "url")).alias("folder"), T.music_name(music).alias("music"))


@query(rf"SELECT conv_id, turn, round(greatest(3.0::DOUBLE, {_SECONDS.format(_TRIM.format("coalesce(text, '')"))}), 6) AS seconds FROM conversations")
def silent_durations(spark, d):
    return D.table(spark, d, "conversations").select("conv_id", "turn", F.round(T.silent_seconds(F.col("text")), 6).alias("seconds"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_discount = 0 THEN 1.0 ELSE least(greatest(l_discount * 40, 0.5), 2.0) END::DOUBLE AS speed, round(l_quantity + 0.1, 6) AS seconds,
round(CASE l_linenumber % 4 WHEN 0 THEN 1080 * 0.95 - l_quantity WHEN 1 THEN 1080 * 0.05 WHEN 2 THEN greatest(10, least((1080 - l_quantity) * (l_linenumber * 20 / 100.0), 1080 - l_quantity - 10)) ELSE (1080 - l_quantity) / 2 END, 6)::DOUBLE AS top,
['a', 'b', 'c'][l_linenumber % 3 + 1] AS key FROM lineitem""")
def render_numbers(spark, d):
    place = F.get(F.array(*map(F.lit, ["bottom", "top", "custom", "center"])), (F.col("l_linenumber") % 4).cast("int"))
    top = P.subtitle_top(place, F.col("l_linenumber") * 20.0, F.lit(1080.0), F.col("l_quantity"))
    keys = F.array(F.lit("a"), F.lit("b"), F.lit("c"))
    return D.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", P.clip_speed(F.col("l_discount") * 40).alias("speed"), F.round(P.needed_seconds(F.col("l_quantity")), 6).alias("seconds"), F.round(top, 6).alias("top"), P.rotated(keys, F.col("l_linenumber")).alias("key"))


@query("""SELECT o_custkey AS k, count(DISTINCT o_orderkey) FILTER (o_orderkey % 5 <> 0) AS items, bool_and(o_orderkey % 5 <> 0) AS whole FROM orders GROUP BY 1""")
def channels_present(spark, d):
    o = D.table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("item"))
    return K.all_present(o, o.filter("item % 5 <> 0"), "k", "item")


@query("""WITH t AS (SELECT p_partkey AS id, p_size % 5 AS s, p_partkey % 4 AS n, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_partkey % 3 END AS i FROM part),
r AS (SELECT *, CASE WHEN s = 0 THEN 'not finished' WHEN s = 1 THEN 'in progress' WHEN s = 2 THEN 'already uploaded' WHEN n = 0 THEN 'no file' WHEN i IS NOT NULL AND i >= n THEN 'no such file' END AS refusal FROM t)
SELECT id AS task_id, CASE WHEN refusal IS NULL THEN CASE WHEN i IS NULL THEN array_to_string([('v' || k) for k in range(n)], ',') ELSE 'v' || i END END AS files, refusal FROM r""")
def uploads_by_hand(spark, d):
    n = (F.col("p_partkey") % 4).cast("int")
    videos = F.slice(F.array(F.lit("v0"), F.lit("v1"), F.lit("v2")), F.lit(1), n)
    done = F.array(F.struct(F.lit(True).alias("success"), F.when(F.col("p_size") % 5 == 2, "x").otherwise("").alias("video_id")))
    state = F.when(F.col("p_size") % 5 == 0, "processing").otherwise("complete")
    flight = F.when(F.col("p_size") % 5 == 1, "pending")
    index = F.when(F.col("p_partkey") % 3 != 0, (F.col("p_partkey") % 3).cast("int"))
    t = D.table(spark, d, "part").select(F.col("p_partkey").alias("task_id"), state.alias("state"), flight.alias("upload_state"), done.alias("uploads"), videos.alias("videos"), index.alias("video_index"))
    return K.uploadable(t).withColumn("files", F.array_join("files", ","))


@query("""WITH m AS (SELECT p_partkey, ['a.mp4', '/store/b.jpg', '../c.mp4', '/etc/d.mp4', '', 'sub/e.PNG'][p_size % 6 + 1] AS url FROM part), q AS (SELECT *, CASE WHEN url LIKE '/%' THEN url ELSE '/store/' || url END AS path FROM m WHERE url <> ''),
s AS (SELECT '/store/a.mp4' AS path UNION ALL SELECT '/store/b.jpg' UNION ALL SELECT '/store/sub/e.PNG')
SELECT p_partkey, CASE WHEN path LIKE '%.mp4' THEN path ELSE path || '.mp4' END AS path FROM q JOIN s USING (path)""")
def local_materials(spark, d):
    url = F.get(F.array(*map(F.lit, ["a.mp4", "/store/b.jpg", "../c.mp4", "/etc/d.mp4", "", "sub/e.PNG"])), (F.col("p_size") % 6).cast("int"))
    sizes = [("/store/a.mp4", 1920, 1080), ("/store/b.jpg", 480, 471), ("/store/../c.mp4", 900, 900), ("/etc/d.mp4", 900, 900), ("/store/sub/e.PNG", 470, 480), ("/store/small.mp4", 100, 100)]
    probes = spark.createDataFrame(sizes, "path string, width int, height int")
    return K.admitted_materials(D.table(spark, d, "part").select("p_partkey", url.alias("url")), probes, "/store").select("p_partkey", "path")


@query("""WITH w AS (SELECT DISTINCT l_orderkey AS k, l_linenumber AS idx FROM lineitem WHERE l_quantity > 20), g AS (SELECT s AS seq, s % 3 AS m FROM range(20) r(s)),
j AS (SELECT k, idx, k * 10 + idx AS task_id, row_number() OVER (PARTITION BY k ORDER BY idx) AS j FROM w WHERE (k + idx) % 4 > 0 UNION ALL SELECT DISTINCT k, -1, k * 10, 5 FROM w WHERE k % 5 = 0),
l AS (SELECT k, idx, j, seq, task_id || ':' || seq AS line, row_number() OVER (PARTITION BY task_id ORDER BY seq DESC) AS b FROM j, g WHERE j <= 5 AND (j <= 4 OR idx < 0) AND m <> idx % 3),
f AS (SELECT k, idx, seq, line, row_number() OVER (PARTITION BY k ORDER BY j DESC, seq DESC) AS r FROM l WHERE b <= 12) SELECT k, CAST(idx AS INT) AS idx, seq, line FROM f WHERE r <= 25""")
def recent_log_lines(spark, d):
    """Every fourth job has no task yet, and every fifth book's pages are being recognised."""
    jobs = D.table(spark, d, "lineitem").filter("l_quantity > 20").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("idx")).distinct()
    jobs = jobs.withColumns({"task_id": F.when((F.col("k") + F.col("idx")) % 4 > 0, F.col("k") * 10 + F.col("idx")), "state": F.lit("rendering")})
    recognition = jobs.filter("k % 5 = 0").select("k", (F.col("k") * 10).alias("task_id")).distinct()
    said = jobs.select("task_id", "idx").filter("task_id is not null").unionByName(recognition.select("task_id", F.lit(-1).alias("idx")))
    logs = said.select("task_id", "idx", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(19).cast("long"))).alias("seq")).filter("seq % 3 <> idx % 3")
    logs = logs.select("task_id", "seq", F.concat("task_id", F.lit(":"), "seq").alias("line"))
    return K.recent_lines(jobs, logs, "k", recognition).withColumn("idx", F.col("idx").cast("int"))


@query("""WITH p AS (SELECT DISTINCT l_suppkey % 50 AS book_id, l_orderkey AS page FROM lineitem), r AS (SELECT *, page % 3 <> 0 AS tried, page % 7 = 0 AS bad, (page % 10) / 10.0::DOUBLE AS c FROM p),
g AS (SELECT book_id, count(*) AS total, count(*) FILTER (tried AND NOT bad) AS done, count(*) FILTER (tried AND bad) AS failed, coalesce(avg(c) FILTER (tried AND NOT bad), 0) AS confidence FROM r GROUP BY 1)
SELECT book_id, total, done, failed, done + failed AS attempted, round(confidence, 9) AS confidence FROM g""")
def recognition_runs(spark, d):
    from ..operators import layout as L

    pages = D.table(spark, d, "lineitem").select((F.col("l_suppkey") % 50).alias("book_id"), F.col("l_orderkey").alias("page")).distinct()
    results = pages.filter("page % 3 <> 0").withColumns({"error": F.when(F.col("page") % 7 == 0, "timeout"), "confidence": F.col("page") % 10 / 10})
    return L.run_summary(pages, results, "book_id").withColumn("confidence", F.round("confidence", 9))
