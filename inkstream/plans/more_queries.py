"""Further registered queries: outlines, narration, layout, sources and links between tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import classify as C
from ..operators import layout as L
from ..operators import media as M
from ..operators import narration as N
from ..operators import outline as O
from ..operators import segment as G
from ..session import spread, written
from ..sources import plain as P
from . import domain as D
from .queries import _CHAPTERS, _CUES, _DECISIONS, _PARTS, _SECONDS, _TRIM, _cues, _decisions, _kept, query

_LINE = r"trim(regexp_replace({0}, '[\s\x{{00A0}}]+', ' ', 'g'))"
_TITLE = rf"""(t <> '' AND length(t) <= 80 AND len(string_split(t, ' ')) <= 14 AND (regexp_matches(t, '{O.NAMED}') OR regexp_matches(t, '{O.BOOK_PART}') OR ((regexp_matches(t, '{O.ROMAN}') OR regexp_matches(t, '{O.NUMBERED}')) AND len(string_split(t, ' ')) <= 12)
  OR (length(regexp_replace(t, '[^A-Za-z\x{{00C0}}-\x{{024F}}]', '', 'g')) >= 3 AND len(string_split(t, ' ')) <= 8 AND t = upper(t) AND regexp_matches(t, '[A-Z]'))))"""
_UNITS = rf"""{_DECISIONS}, lined AS (SELECT *, {_LINE.format("text")} AS t, row_number() OVER (PARTITION BY book_id, chapter_id ORDER BY ord) = 1 AS one FROM kept),
marked AS (SELECT *, kind = 'heading' OR one OR {_TITLE} AS marker, {_TITLE} AS titled, {_SECONDS.format(_TRIM.format("text"))} AS s FROM lined),
run AS (SELECT *, sum(CASE WHEN marker OR coalesce(prev, TRUE) THEN 1 ELSE 0 END) OVER (PARTITION BY book_id ORDER BY ord) - 1 AS idx FROM (SELECT *, lag(marker) OVER (PARTITION BY book_id ORDER BY ord) AS prev FROM marked)),
units AS (SELECT book_id, CAST(idx AS INT) AS idx, first(block_id ORDER BY ord) AS start_block, CASE WHEN NOT first(marker ORDER BY ord) THEN 'prose' WHEN first(kind ORDER BY ord) = 'heading' THEN 'heading' ELSE 'marker' END AS kind, left(first(t ORDER BY ord), 80) AS title, round(sum(s ORDER BY ord), 6) AS seconds FROM run GROUP BY 1, 2)"""


def _worded(spark, d):
    b, c = D.blocks(spark, d), D.chapters(spark, d)
    return C.kept_blocks(O.worded(G.measured(b)), c).drop("text"), c


@query(f"WITH {_UNITS} SELECT * FROM units")
def outline_units(spark, d):
    return O.outline(*_worded(spark, d)).withColumn("seconds", F.round("seconds", 6))


@query(f"WITH {_UNITS} SELECT book_id, idx, start_block, title FROM (SELECT *, {_LINE.format('title')} AS t FROM units) WHERE kind = 'heading' OR (kind = 'marker' AND {_TITLE})")
def heuristic_sections(spark, d):
    return O.sections(O.outline(*_worded(spark, d)))


@query(
    rf"""WITH {_UNITS}, k AS (SELECT *, {_LINE.format("title")} AS t FROM units),
f AS (SELECT *, regexp_matches(t, '(?i)^(table\s+of\s+contents|contents(?:\s+page)?|list\s+of\s+(?:chapters|contents)|toc)\.?$') AS toc, seconds < 25 AS thin FROM k),
g AS (SELECT *, toc OR (kind <> 'prose' AND {_TITLE}) AS titled, sum(CASE WHEN thin THEN 0 ELSE 1 END) OVER (PARTITION BY book_id ORDER BY idx) AS run FROM f),
h AS (SELECT *, min(CASE WHEN toc THEN idx END) OVER c AS toc_at, count(CASE WHEN titled THEN 1 END) OVER c AS titles, max(CASE WHEN titled THEN idx END) OVER c AS last, max(idx) OVER (PARTITION BY book_id, lower(t)) > idx AS again FROM g WINDOW c AS (PARTITION BY book_id, run, thin))
SELECT book_id, start_block FROM h WHERE toc OR (thin AND (toc_at IS NOT NULL OR titles >= 4) AND idx <> coalesce(last, -1) AND (coalesce(idx > toc_at, FALSE) OR again))"""
)
def skipped_blocks(spark, d):
    return O.skipped(O.outline(*_worded(spark, d)).withColumn("seconds", F.round("seconds", 6)))


@query(
    f"""WITH {_UNITS}, s AS (SELECT book_id, start_block AS block_id FROM (SELECT *, {_LINE.format("title")} AS t FROM units) WHERE kind = 'heading' OR (kind = 'marker' AND {_TITLE})),
b AS (SELECT k.book_id, k.block_id, k.ord, CASE WHEN s.block_id IS NOT NULL OR row_number() OVER (PARTITION BY k.book_id ORDER BY ord) = 1 THEN k.block_id END AS start FROM kept k LEFT JOIN s USING (book_id, block_id))
SELECT book_id, block_id, last_value(start IGNORE NULLS) OVER (PARTITION BY book_id ORDER BY ord) AS section_block FROM b"""
)
def section_of_block(spark, d):
    kept, chapters = _worded(spark, d)
    kept = written(kept.drop("seconds", "words").withColumn("seconds", F.lit(0.0)))  # classified once; sections ask for no times
    return O.section_of_block(kept, O.sections(O.outline(kept, chapters))).select("book_id", "block_id", "section_block")


@query(
    f"""WITH RECURSIVE {_DECISIONS}, {_CHAPTERS},
m AS (SELECT book_id, row_number() OVER (PARTITION BY book_id ORDER BY ord) - 1 AS i, block_id, title, len(regexp_split_to_array({_TRIM.format("text")}, '[\\s\\x{{00A0}}]+')) AS words FROM kept JOIN chapters USING (book_id, chapter_id)),
f AS (SELECT book_id, i, 0::BIGINT AS idx, title, words FROM m WHERE i = 0
  UNION ALL SELECT book_id, i, CASE WHEN c THEN idx + 1 ELSE idx END, CASE WHEN c THEN new WHEN new <> title THEN title || ' / ' || new ELSE title END, CASE WHEN c THEN w ELSE words + w END
  FROM (SELECT m.book_id, m.i, f.idx, f.title, f.words, m.title AS new, m.words AS w, (m.title <> f.title AND f.words >= 200) OR f.words + m.words > 1400 OR (f.words >= 900 AND m.title = f.title AND m.words > 0) AS c FROM f JOIN m ON m.book_id = f.book_id AND m.i = f.i + 1)),
n AS (SELECT book_id, max(idx) + 1 AS n FROM f GROUP BY 1), u AS (SELECT book_id, CASE WHEN n >= 8 AND n > 12 THEN n - greatest(1, ceil(n * 0.1::DOUBLE)) ELSE n END AS m FROM n)
SELECT DISTINCT f.book_id, CAST(f.idx AS INT) AS idx FROM f JOIN u USING (book_id) WHERE (m <= 12 AND f.idx < m) OR (m > 12 AND list_contains([CAST(floor(k * (m - 1) / 11.0::DOUBLE + 0.5) AS BIGINT) for k in range(12)], f.idx))"""
)
def short_sample(spark, d):
    return G.spread(G.short_chunks(*_kept(spark, d)), 12).select("book_id", "idx")


@query()
def voice_chunks(spark, d):
    return N.chunks_for_voice(D.table(spark, d, "documents"), "doc_id", "text", 1200)


@query(
    f"""WITH {_CUES}, told AS MATERIALIZED (SELECT *, regexp_replace(content, '[^\\p{{L}}\\p{{N}}]', '', 'g') = '' AS mute FROM cues), whole AS (SELECT *, bool_or(mute) OVER (PARTITION BY doc_id) AS silent FROM told)
SELECT doc_id, idx, round(start, 6) AS start, round(fin, 6) AS "end", regexp_replace(regexp_replace(content, '[\\[\\](){{}}]', ' ', 'g'), '^\\s+|\\s+$', '', 'g') AS text FROM whole WHERE NOT silent""".replace("{{L}}", "{L}").replace("{{N}}", "{N}")
)
def aligned_cues(spark, d):
    cues = _cues(spark, d).withColumnRenamed("idx", "seq")
    scripts = spread(D.table(spark, d, "documents")).select("doc_id", F.col("text").alias("script"))
    return N.aligned(cues, scripts, "doc_id").withColumns({"start": F.round("start", 6), "end": F.round("end", 6)})


_CUE_LINES = f"""l AS (SELECT item_id, CASE WHEN len({_PARTS.format("text")}) > 0 THEN {_PARTS.format("text")} ELSE [{_TRIM.format("text")}] END AS p FROM benchmark WHERE {_TRIM.format("text")} <> '')"""


@query(f"""WITH {_CUE_LINES} SELECT item_id, CAST(i + 1 AS INT) AS idx, CAST(i AS DOUBLE) AS start, CAST(i + 1 AS DOUBLE) AS "end", p[i + 1] AS text FROM (SELECT item_id, p, unnest(range(len(p))) AS i FROM l)""")
def corrected_cues(spark, d):
    """Cues that a recogniser heard in small letters get the script's spelling back, line for line."""
    b = D.table(spark, d, "benchmark")
    words = b.select("item_id", F.posexplode(T.caption_lines(F.col("text"))).alias("seq", "content"))
    cues = words.select("item_id", "seq", F.col("seq").cast("double").alias("start"), (F.col("seq") + 1).cast("double").alias("end"), F.lower("content").alias("content"))
    return N.correct_cues(cues, b.select("item_id", F.col("text").alias("script")), "item_id")


def _items(spark, d):
    y = F.floor(F.col("l_linenumber") / 3) * 12.0 + (F.col("l_linenumber") % 3) * 3.0
    return D.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("page"), y.alias("y"), (F.col("l_quantity") * 4.0).alias("x"), F.lit(20.0).alias("width"), (10.0 + F.col("l_discount") * 100).alias("font_size"), F.concat(F.lit("w"), "l_partkey").alias("text"))


@query("""WITH RECURSIVE i AS (SELECT l_orderkey AS page, -((l_linenumber // 3) * 12.0 + (l_linenumber % 3) * 3.0)::DOUBLE AS down, (l_quantity * 4.0)::DOUBLE AS x, 20.0::DOUBLE AS width, (10.0 + l_discount * 100)::DOUBLE AS font, 'w' || l_partkey AS text FROM lineitem),
o AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY down, x, width, font, text) AS n FROM i),
f AS (SELECT page, n, x, width, font, text, down, down AS first, greatest(1.0::DOUBLE, font * 0.4::DOUBLE) AS tol, 0 AS line FROM o WHERE n = 1
  UNION ALL SELECT page, n, x, width, font, text, down, CASE WHEN same THEN first ELSE down END, CASE WHEN same THEN greatest(tol, font * 0.4::DOUBLE) ELSE greatest(1.0::DOUBLE, font * 0.4::DOUBLE) END, CASE WHEN same THEN line ELSE line + 1 END
  FROM (SELECT o.*, f.first, f.tol, f.line, abs(o.down - f.first) <= f.tol AS same FROM f JOIN o ON o.page = f.page AND o.n = f.n + 1)),
p AS (SELECT *, row_number() OVER w AS nth, CASE WHEN x - max(x + width) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > font * 0.2::DOUBLE THEN ' ' ELSE '' END || text AS piece FROM f WINDOW w AS (PARTITION BY page, line ORDER BY x, down, font, text)),
s AS (SELECT page, line, round(font, 1) AS size, sum(length(text)) AS w, min(nth) AS seen FROM p GROUP BY ALL),
z AS (SELECT page, line, arg_max(size, w * 1000 - seen) AS font_size FROM s GROUP BY ALL)
SELECT page, CAST(line AS INT) AS line, string_agg(piece, '' ORDER BY nth) AS text, min(x) AS "left", max(x + width) AS "right", arg_min(-down, nth) AS y, any_value(font_size) AS font_size FROM p JOIN z USING (page, line) GROUP BY page, line""")
def positioned_lines(spark, d):
    return L.lines(_items(spark, d))


@query("""WITH r AS (SELECT l_orderkey AS page, l_linenumber AS seq, l_discount * 10 AS confidence FROM lineitem), b AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY confidence DESC, seq) AS rn FROM r) SELECT page, seq FROM b WHERE rn = 1""")
def best_recognition(spark, d):
    r = D.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("seq"), (F.col("l_discount") * 10).alias("confidence"))
    return L.best_result(r).select("page", "seq")


@query(r"SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'no_vision_provider' WHEN regexp_replace(text, '^\s+|\s+$', '', 'g') = '' THEN 'no_text_recognised' WHEN (doc_id % 100) / 100.0::DOUBLE < 0.7 THEN 'low_confidence' WHEN length(regexp_replace(text, '^\s+|\s+$', '', 'g')) < 60 THEN 'implausibly_short' ELSE 'confident' END AS reason FROM documents")
def escalation_reasons(spark, d):
    t = D.table(spark, d, "documents")
    return t.select("doc_id", L.escalation(F.col("text"), (F.col("doc_id") % 100) / 100.0, F.col("doc_id") % 10 != 0).alias("reason"))


@query("""SELECT p_type AS term, CAST(p_partkey AS VARCHAR) AS asset, CAST(p_size AS DOUBLE) AS duration, 'https://v.example/' || p_partkey AS url FROM part WHERE p_size % 3 = 2 AND p_size >= 5""")
def search_selection(spark, d):
    files = F.array(F.struct(F.concat(F.lit("https://v.example/"), F.col("p_partkey").cast("string"), F.lit("?k=1")).alias("link"), (F.col("p_size") % 3 * 540).alias("width"), F.lit(1920).alias("height")))
    p = D.table(spark, d, "part").select(F.lit("pexels").alias("provider"), F.col("p_type").alias("term"), F.struct(F.col("p_partkey").alias("id"), F.col("p_size").alias("duration"), files.alias("video_files")).alias("v"))
    replies = p.groupBy("provider", "term").agg(F.to_json(F.struct(F.array_sort(F.collect_list("v"), lambda a, b: (a["id"] - b["id"]).cast("int")).alias("videos"))).alias("body"))
    found = M.search_results(replies, "pexels", 1080, 1920, 5)
    return found.select("term", "asset", "duration", T.public_url(F.col("url")).alias("url"))


@query("""SELECT o_orderkey, 'order ' || o_orderkey || ': ' || lower(o_orderpriority) AS line, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS nth FROM orders""")
def state_feed(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return D.table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("order "), "o_orderkey", F.lit(": "), F.lower("o_orderpriority")).alias("line"), F.row_number().over(w).cast("long").alias("nth"))


@query("SELECT conv_id, turn, '{\"turn\":' || turn || '}' AS found FROM conversations")
def json_replies(spark, d):
    c = D.table(spark, d, "conversations")
    reply = F.concat(F.lit("Sure: ```json\n{\"turn\":"), F.col("turn"), F.lit("}\n``` as asked"))
    return c.select("conv_id", "turn", P.json_in(reply).alias("found"))


@query(f"WITH {_DECISIONS} SELECT book_id, chapter_id, count(*) AS blocks, count(CASE WHEN keep THEN 1 END) AS kept, round(avg(confidence), 9) AS confidence FROM blocks JOIN decided USING (book_id, block_id) GROUP BY 1, 2")
def chapter_review(spark, d):
    b = D.blocks(spark, d).select("book_id", "block_id", "chapter_id")
    return b.join(_decisions(spark, d), ["book_id", "block_id"]).groupBy("book_id", "chapter_id").agg(F.count("*").alias("blocks"), F.count_if("keep").alias("kept"), F.round(F.avg("confidence"), 9).alias("confidence"))


@query()
def smart_segments(spark, d):
    kept, chapters = _kept(spark, d)
    kept = written(G.measured(kept))  # blocks are classified and measured once
    units = written(O.outline(kept, chapters))
    return O.smart_segments(O.without_skipped(kept, O.skipped(units)), chapters, O.sections(units))
