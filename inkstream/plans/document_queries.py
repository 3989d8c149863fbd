"""Registered queries over stored documents and parsers as table functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import documents as X
from ..functions import tables as T
from ..operators import cues as Q
from . import domain as D
from .queries import _CUES, _TRIM, _cues_in, query


def _from_table(spark, rows, call: str):
    """A table function over a table, called from SQL."""
    T.register(spark)
    return spark.sql(f"SELECT * FROM {call.format('TABLE({rows})')}", rows=rows)


@query(rf"""WITH {_CUES}, t AS (SELECT doc_id, idx, floor(start * 1000) / 1000 AS start, floor(fin * 1000) / 1000 AS fin, array_to_string(list_filter(list_transform(string_split(content, chr(10)), lambda x: {_TRIM.format("x")}), lambda x: x <> ''), chr(10)) AS text FROM cues)
SELECT doc_id, idx, round(start, 3) AS start, round(fin, 3) AS "end", text FROM t WHERE text <> ''""")
def srt_round_trip(spark, d):
    """Cues written as subtitle documents and read again, each within its row."""
    got = _from_table(spark, _cues_in(spark, d).select("doc_id", Q.srt_in(F.col("cues")).alias("srt")), "srt_files({})")
    return got.select("doc_id", "idx", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"), "text")


@query()
def voice_chunk_table(spark, d):
    return _from_table(spark, D.table(spark, d, "documents").select("doc_id", "text"), "voice_chunks({}, 1200)")


@query()
def html_block_table(spark, d):
    return _from_table(spark, D.table(spark, d, "pages").select("page_id", "html"), "html_blocks({})")


@query(r"""WITH b AS (SELECT doc_id, doc_id % 6 AS k, source, lang, text FROM documents)
SELECT doc_id, k NOT IN (3, 4) AS readable, CASE k WHEN 0 THEN source WHEN 1 THEN CAST(doc_id AS VARCHAR) WHEN 2 THEN source WHEN 5 THEN source END AS title, CASE WHEN k IN (0, 2) THEN lang END AS language,
  CAST(CASE k WHEN 0 THEN 1 WHEN 2 THEN 2 ELSE 0 END AS INT) AS chapters, CASE WHEN k IN (0, 2) THEN md5(coalesce(text, '')) END AS text_md5, CAST(CASE WHEN k = 2 THEN 7 ELSE -1 END AS INT) AS level FROM b""")
def structures(spark, d):
    """Books as stored structures: whole, with fields of other kinds, no object, no JSON, and without blocks."""
    k = F.col("doc_id") % 6
    text = F.coalesce("text", F.lit(""))
    chapter = lambda n, **more: F.struct(F.concat(F.lit("ch-"), F.lit(n)).alias("id"), F.col("source").alias("title"), *[v.alias(c) for c, v in more.items()])
    block = F.struct(F.lit("0:0").alias("id"), F.lit("ch-0").alias("chapterId"), F.lit("paragraph").alias("kind"), text.alias("text"))
    named = F.struct(F.lit("0:0").alias("id"), F.lit("ch-0").alias("chapter_id"), F.lit("heading").alias("kind"), F.lit(7).alias("level"), text.alias("text"))
    whole = F.to_json(F.struct(F.col("source").alias("title"), F.col("lang").alias("language"), F.array(chapter(0)).alias("chapters"), F.array(block).alias("blocks")))
    other = F.to_json(F.struct(F.col("doc_id").alias("title"), F.lit("none").alias("chapters"), F.struct(F.lit(1).alias("a")).alias("blocks")))
    more = F.to_json(F.struct(F.col("source").alias("title"), F.col("lang").alias("language"), F.array(chapter(0, level=F.lit(1)), chapter(1, level=F.lit(2))).alias("chapters"), F.array(named).alias("blocks"), F.lit("x").alias("further")))
    body = F.when(k == 0, whole).when(k == 1, other).when(k == 2, more).when(k == 3, "[1, 2]").when(k == 4, F.concat(F.lit("{"), text)).otherwise(F.to_json(F.struct(F.col("source").alias("title"))))
    s = D.table(spark, d, "documents").select("doc_id", X.structure(body).alias("s"))
    first = F.try_element_at("s.blocks", F.lit(1))
    return s.select("doc_id", F.col("s").isNotNull().alias("readable"), "s.title", "s.language", F.when(F.col("s").isNotNull(), F.size("s.chapters")).otherwise(0).alias("chapters"), F.md5(first["text"]).alias("text_md5"), F.coalesce(first["level"], F.lit(-1)).alias("level"))


@query("""SELECT p_partkey, CASE WHEN p_size % 4 = 3 THEN p_type WHEN p_size % 4 = 1 THEN NULL ELSE p_name END AS script, CASE WHEN p_size % 4 = 1 THEN '' ELSE p_brand || '|' || p_size END AS terms, CASE WHEN p_size % 2 = 0 THEN p_size ELSE p_partkey END AS own FROM part""")
def script_patches(spark, d):
    """Script data with a change over it; every fourth cannot be read and counts as empty."""
    size = F.col("p_size")
    data = F.to_json(F.struct(F.col("p_name").alias("script"), F.array(F.col("p_brand"), size.cast("string")).alias("search_terms"), size.alias("own")))
    body = F.when(size % 4 == 1, F.concat(F.lit("broken "), data)).otherwise(data)
    change = F.when(size % 4 == 3, F.to_json(F.struct(F.col("p_type").alias("script"), F.col("p_partkey").alias("own")))).when(size % 2 == 1, F.to_json(F.struct(F.col("p_partkey").alias("own")))).otherwise("{}")
    s = D.table(spark, d, "part").select("p_partkey", X.script_data(X.patched_script(body, change)).alias("s"))
    return s.select("p_partkey", "s.script", F.array_join("s.search_terms", "|").alias("terms"), F.try_variant_get(F.element_at("s.more", "own"), "$", "long").alias("own"))
