"""Registered queries over scripts, subtitle files, recogniser words, settings, provider replies and links between rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import replies as R
from ..functions import text as T
from ..operators import cues as Q
from ..operators import links as K
from ..operators import media as M
from ..operators import outline as O
from ..sources import plain as P
from . import domain as D
from .more_queries import _UNITS, _kept
from .queries import _CUES, _DECISIONS, _TRIM, _cues, query


@query(rf"""WITH {_CUES}, t AS (SELECT doc_id, idx, floor(start * 1000) / 1000 AS start, floor(fin * 1000) / 1000 AS fin, array_to_string(list_filter(list_transform(string_split(content, chr(10)), lambda x: {_TRIM.format("x")}), lambda x: x <> ''), chr(10)) AS text FROM cues)
SELECT doc_id, idx, round(start, 3) AS start, round(fin, 3) AS "end", text FROM t WHERE text <> ''""")
def parsed_subtitles(spark, d):
    """Subtitle documents of the cues, read again."""
    got = P.parse_srt(Q.to_srt(_cues(spark, d), "doc_id"), "doc_id")
    return got.select("doc_id", F.col("idx").cast("int").alias("idx"), F.round("start", 3).alias("start"), F.round("end", 3).alias("end"), "text")


_WORDS = """words AS (SELECT l_orderkey AS page_num, l_suppkey % 3 AS block_num, l_partkey % 2 AS par_num, l_linenumber // 3 AS line_num, l_linenumber AS word_num, CASE WHEN l_quantity < 5 THEN '  ' ELSE ' w' || l_partkey END AS text, CASE WHEN l_discount = 0.1 THEN -1 ELSE l_quantity * 2.5 END AS conf FROM lineitem),
good AS (SELECT *, least(greatest(conf / 100.0, 0), 1)::DOUBLE AS c, trim(text) AS t FROM words WHERE trim(text) <> '' AND conf >= 0),
lagged AS (SELECT *, lag(block_num) OVER w AS b, lag(par_num) OVER w AS p, lag(line_num) OVER w AS l FROM good WINDOW w AS (PARTITION BY page_num ORDER BY block_num, par_num, line_num, word_num, t))"""


@query(f"""WITH {_WORDS} SELECT page_num, string_agg(CASE WHEN b IS NULL THEN '' WHEN b <> block_num OR p <> par_num THEN chr(10) || chr(10) WHEN l <> line_num THEN chr(10) ELSE ' ' END || t, '' ORDER BY block_num, par_num, line_num, word_num, t) AS text, round(avg(c), 6) AS confidence FROM lagged GROUP BY 1""")
def recognised_pages(spark, d):
    """Words of a recogniser's table as pages: blocks, paragraphs and lines."""
    c = F.col
    rows = D.table(spark, d, "lineitem")
    words = rows.select(
        c("l_orderkey").alias("page_num"), (c("l_suppkey") % 3).alias("block_num"), (c("l_partkey") % 2).alias("par_num"), F.floor(c("l_linenumber") / 3).alias("line_num"), c("l_linenumber").alias("word_num"),
        F.when(c("l_quantity") < 5, "  ").otherwise(F.concat(F.lit(" w"), "l_partkey")).alias("text"), F.when(c("l_discount") == 0.1, -1.0).otherwise(c("l_quantity") * 2.5).alias("conf"),
    )
    return P.recognised_text(P.recognised_words(words)).withColumn("confidence", F.round("confidence", 6))


@query(r"""WITH t AS (SELECT doc_id, regexp_replace(list_filter(string_split(replace(text, '_', ''), chr(10)), lambda x: NOT regexp_matches(regexp_replace(x, '^\s+|\s+$', '', 'g'), '^[-*_]{3,}$'))[1], '^\s+|\s+$', '', 'g') AS a, regexp_replace(lower(string_split(text, chr(10))[1]), '[aeiou]', '', 'g') AS b FROM (SELECT doc_id, regexp_replace(text, '[^ -~\n]', '', 'g') AS text FROM documents) WHERE text IS NOT NULL)
SELECT doc_id, left(a, 80) AS line, round(CASE WHEN length(left(a, 80)) + length(left(b, 80)) = 0 THEN 1 ELSE 1 - levenshtein(lower(left(a, 80)), left(b, 80)) / greatest(length(left(a, 80)), length(left(b, 80)))::DOUBLE END, 9) AS alike FROM t WHERE a <> ''""")
def script_similarity(spark, d):
    """The first 80 plain letters of a script's first line against the same without vowels: a line is what is compared."""
    t = D.table(spark, d, "documents").filter("text is not null").withColumn("text", F.regexp_replace("text", r"[^ -~\n]", ""))
    first = F.substring(F.element_at(F.split(T.script_lines(F.col("text")), "\n"), 1), 1, 80)
    bare = F.substring(F.regexp_replace(F.lower(F.element_at(F.split("text", "\n"), 1)), "[aeiou]", ""), 1, 80)
    return t.select("doc_id", first.alias("line"), F.round(T.similarity(first, bare), 9).alias("alike")).filter("line != ''")


@query(r"""SELECT conv_id, turn, CASE WHEN length(t) > 50 THEN regexp_replace(left(t, 50), '\s+$', '') ELSE t END AS short, array_to_string(list_transform(list_filter(string_split_regex(t, '[\s,]+'), lambda x: regexp_replace(x, '[^\p{L}\p{N}_]', '', 'g') <> '')[1:1], lambda x: '#' || regexp_replace(x, '[^\p{L}\p{N}_]', '', 'g')), ' ') AS tag,
  array_to_string(list_filter(list_transform(string_split(t, ','), lambda x: regexp_replace(x, '^[\s\x{00A0}]+|[\s\x{00A0}]+$', '', 'g')), lambda x: x <> ''), '|') AS terms, 'https://***@h/' || conv_id || ' ***' AS told FROM (SELECT conv_id, turn, regexp_replace(coalesce(text, ''), '^[\s\x{00A0}]+|[\s\x{00A0}]+$', '', 'g') AS t FROM conversations)""")
def short_texts(spark, d):
    c = D.table(spark, d, "conversations").withColumn("text", F.coalesce("text", F.lit("")))
    secret = F.concat(F.lit("https://user:pass@h/"), "conv_id", F.lit(" key-1"))
    return c.select("conv_id", "turn", T.clamp(F.col("text"), 50).alias("short"), F.array_join(T.hashtags(F.col("text"), 1), " ").alias("tag"), F.array_join(R.terms(F.col("text")), "|").alias("terms"), T.redact(secret, "key-1", "").alias("told"))


@query("""SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN '********' ELSE '' END AS shown, CASE WHEN c_custkey % 3 = 0 THEN 'old' WHEN c_custkey % 3 = 1 THEN 'k' || c_custkey ELSE NULL END AS api_key, CASE WHEN c_custkey % 2 = 0 THEN 'new' ELSE 'kept' END AS model FROM customer""")
def merged_sections_of_settings(spark, d):
    """Settings with changes over them: a masked value changes nothing, and a secret is shown as a mask."""
    k = F.col("c_custkey")
    old = F.when(k % 3 == 2, F.create_map(F.lit("model"), F.lit("kept"))).otherwise(F.create_map(F.lit("api_key"), F.lit("old"), F.lit("model"), F.lit("kept")))
    new = F.when(k % 3 == 1, F.create_map(F.lit("api_key"), F.concat(F.lit("k"), k))).otherwise(F.create_map(F.lit("api_key"), F.lit("********")))
    new = F.when(k % 2 == 0, F.map_concat(new, F.create_map(F.lit("model"), F.lit("new")))).otherwise(new)
    c = D.table(spark, d, "customer").select("c_custkey", R.masked(F.when(F.col("c_acctbal") > 0, "secret").otherwise("")).alias("shown"), R.merged_settings(old, new).alias("m"))
    return c.select("c_custkey", "shown", F.try_element_at("m", F.lit("api_key")).alias("api_key"), F.try_element_at("m", F.lit("model")).alias("model"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST(o_orderdate + INTERVAL 1 HOUR * (o_orderkey % 4) AS TIMESTAMP) END AS due, CASE o_orderkey % 3 WHEN 0 THEN 1920 WHEN 1 THEN 1080 ELSE 1080 END AS width, CASE WHEN o_custkey % 4 = 0 THEN 'none' WHEN o_custkey % 4 = 1 THEN 'soft' WHEN o_custkey % 2 = 0 THEN 'burned' WHEN o_orderkey % 100 <= 64 THEN 'overlay' ELSE 'soft' END AS subtitles,
  CASE WHEN o_orderkey % 5 = 0 THEN '/new' WHEN o_orderkey % 5 = 1 THEN '/new/x/' || o_orderkey WHEN o_orderkey % 5 = 2 THEN '/older/x' ELSE 'old/x' END AS path, CASE WHEN o_orderkey % 3 = 0 THEN 'asked' WHEN o_orderkey % 3 = 1 THEN 'stored' ELSE 'made' END AS title FROM orders""")
def publishing(spark, d):
    """When, how large, with which subtitles, from where and under which title an order is published."""
    c, day = F.col, F.col("o_orderdate").cast("timestamp")
    asked = F.date_format(day + F.make_dt_interval(hours=(c("o_orderkey") % 4).cast("int")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    aspect = F.get(F.array(F.lit("16:9"), F.lit("1:1"), F.lit("9:16")), (c("o_orderkey") % 3).cast("int"))
    wanted = F.when(c("o_custkey") % 4 == 0, "none").when(c("o_custkey") % 4 == 1, "soft").otherwise("burn")
    path = F.when(c("o_orderkey") % 5 == 0, "/old").when(c("o_orderkey") % 5 == 1, F.concat(F.lit("/old/x/"), "o_orderkey")).when(c("o_orderkey") % 5 == 2, "/older/x").otherwise("old/x")
    requested, stored = F.when(c("o_orderkey") % 3 == 0, "asked").otherwise("  "), F.when(c("o_orderkey") % 3 == 1, "stored")
    return D.table(spark, d, "orders").select(
        "o_orderkey", R.publish_time(asked, day).alias("due"), R.resolution(aspect)["width"].alias("width"), R.subtitle_strategy(wanted, c("o_custkey") % 2 == 0, c("o_orderkey") % 100).alias("subtitles"),
        R.renamed(path, "/old", "/new").alias("path"), R.listing(requested, stored, F.lit("made"), True).alias("title"),
    )


@query("""SELECT p_type AS term, provider, CAST(p_partkey AS VARCHAR) AS asset, CAST(p_size AS DOUBLE) AS duration FROM (SELECT *, CASE p_partkey % 3 WHEN 0 THEN 'pexels' WHEN 1 THEN 'pixabay' ELSE 'coverr' END AS provider FROM part)
WHERE p_size >= 5 AND CASE provider WHEN 'pexels' THEN p_size % 2 = 0 WHEN 'pixabay' THEN p_size % 3 <> 0 ELSE p_size % 4 <> 0 AND p_size % 2 = 0 END""")
def searches_of_providers(spark, d):
    """Replies of three providers, each in its own shape, as one table of clips."""
    c, size = F.col, F.col("p_size")
    p = D.table(spark, d, "part").withColumn("link", F.concat(F.lit("https://v.example/"), "p_partkey"))
    sized = lambda w, h, name="url": F.struct(c("link").alias(name), w.cast("int").alias("width"), h.cast("int").alias("height"))
    width = lambda ok: F.when(ok, 1080).otherwise(720)
    pexels = F.to_json(F.struct(F.array(F.struct(c("p_partkey").alias("id"), size.alias("duration"), F.array(sized(width(size % 2 == 0), F.lit(1920), "link")).alias("video_files"))).alias("videos")))
    videos = F.struct(sized(width(size % 3 != 0), F.lit(1920)).alias("large"), sized(F.lit(640), F.lit(360)).alias("small"))
    pixabay = F.to_json(F.struct(F.array(F.struct(c("p_partkey").alias("id"), size.alias("duration"), videos.alias("videos"))).alias("hits")))
    hit = F.struct(c("p_partkey").cast("string").alias("id"), size.cast("double").alias("duration"), (size % 2 == 0).alias("is_vertical"), F.struct(F.when(size % 4 != 0, c("link")).otherwise("").alias("mp4_download")).alias("urls"))
    coverr = F.to_json(F.struct(F.array(hit).alias("hits")))
    name = F.get(F.array(F.lit("unheard of"), F.lit("pixabay"), F.lit("coverr")), (c("p_partkey") % 3).cast("int"))
    replies = p.select(name.alias("provider"), c("p_type").alias("term"), F.when(c("p_partkey") % 3 == 0, pexels).when(c("p_partkey") % 3 == 1, pixabay).otherwise(coverr).alias("body"))
    return M.routed_results(replies, 1080, 1920, 5).select("term", "provider", "asset", F.col("duration").cast("double").alias("duration"))


@query(f"""WITH {_DECISIONS}, s AS (SELECT book_id, chapter_id, list(block_id ORDER BY ord DESC) AS ids FROM kept GROUP BY 1, 2)
SELECT book_id, chapter_id, CAST(place AS INT) AS place, ids[place + 1] AS block_id FROM (SELECT *, unnest(range(len(ids))) AS place FROM s)""")
def blocks_of_chapters(spark, d):
    """Segments that name their blocks, last first, with these blocks."""
    kept, _ = _kept(spark, d)
    ids = F.transform(F.reverse(F.array_sort(F.collect_list(F.struct("ord", "block_id")))), lambda x: x["block_id"])
    segments = kept.groupBy("book_id", "chapter_id").agg(ids.alias("block_ids"))
    return K.blocks_of(segments.withColumnRenamed("chapter_id", "part"), kept, ["book_id", "part"]).select("book_id", "chapter_id", "place", "block_id")


@query("""SELECT l_orderkey AS doc_id, l_linenumber AS idx FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey FROM lineitem) WHERE l_partkey % 4 <> 1""")
def chunks_done(spark, d):
    """Chunks whose place and text a manifest has: every fourth text has changed since."""
    wanted = D.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("idx"), F.md5(F.col("l_partkey").cast("string")).alias("hash")).distinct()
    manifest = D.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("idx"), F.md5(F.when(F.col("l_partkey") % 4 == 1, "changed").otherwise(F.col("l_partkey").cast("string"))).alias("hash"))
    return K.finished_chunks(wanted, manifest.unionAll(manifest)).select("doc_id", "idx")


@query("""SELECT o_orderkey, CASE WHEN o_custkey % 3 > 0 THEN 'short ' || o_custkey END AS title, o_custkey % 3 = 1 AS has_listing FROM orders WHERE o_orderkey % 2 = 0
UNION ALL SELECT o_orderkey, NULL, FALSE FROM orders WHERE o_orderkey % 2 = 1""")
def listings_of_tasks(spark, d):
    """Tasks that were asked for a book's short piece, with what is stored for it."""
    tasks = D.table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("book-short:b:"), F.col("o_custkey"))).otherwise("video").alias("request_id"))
    shorts = D.table(spark, d, "orders").select("o_custkey").distinct().filter("o_custkey % 3 > 0")
    title = F.when(F.col("o_custkey") % 3 == 1, F.concat(F.lit("short "), "o_custkey")).otherwise(" ")
    shorts = shorts.select(F.lit("book-short:b").alias("book_id"), F.col("o_custkey").cast("int").alias("idx"), title.alias("title"), F.lit(None).cast("string").alias("description"))
    got = K.shorts_of_tasks(tasks, shorts)
    return got.select("o_orderkey", F.when(F.col("stored_title").isNotNull(), F.concat(F.lit("short "), F.col("idx"))).alias("title"), F.coalesce("has_listing", F.lit(False)).alias("has_listing"))


@query(f"""WITH {_UNITS}, k AS (SELECT kept.*, row_number() OVER (PARTITION BY book_id ORDER BY ord) % 4 = 0 AS skip FROM kept), u AS (SELECT *, NOT skip OR NOT (regexp_replace(regexp_replace(text, '[\\s\\x{{00A0}}]+', ' ', 'g'), '^ | $', '', 'g') = '' OR t_) AS stays
  FROM (SELECT k.*, l.titled OR regexp_matches(l.t, '(?i)^(table\\s+of\\s+contents|contents(?:\\s+page)?|list\\s+of\\s+(?:chapters|contents)|toc)\\.?$') OR (length(l.t) <= 80 AND m.s < 25) AS t_ FROM k JOIN marked m USING (book_id, block_id) JOIN marked l USING (book_id, block_id)))
SELECT book_id, block_id FROM (SELECT *, bool_or(stays) OVER (PARTITION BY book_id) AS some_stay FROM u) WHERE stays OR NOT some_stay""")
def blocks_without_skipped(spark, d):
    """Every fourth block is to be skipped; what looks like body text stays all the same."""
    from pyspark.sql import Window

    kept, _ = _kept(spark, d)
    nth = F.row_number().over(Window.partitionBy("book_id").orderBy("ord"))
    skip = kept.withColumn("_n", nth).filter("_n % 4 = 0").select("book_id", F.col("block_id").alias("start_block"))
    return O.without_skipped(kept, skip).select("book_id", "block_id")
