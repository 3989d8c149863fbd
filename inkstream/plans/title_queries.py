"""Registered queries over titles, listings, search terms, stored values and proposed sections."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import publish as P
from ..functions import titles as T
from ..operators import footage as G
from ..operators import proposals as R
from ..session import spread
from . import domain as D
from .more_queries import _kept
from .queries import query

_STOP = ", ".join("'" + w.replace("'", "''") + "'" for w in dict.fromkeys(G.STOPWORDS))


@query(rf"""WITH d AS (SELECT doc_id, array_to_string(string_split(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'), ' ')[1:2], ' ') AS title, text FROM documents),
n AS (SELECT doc_id, regexp_replace(title, '^\s+|\s+$', '', 'g') AS title, CASE doc_id % 3 WHEN 0 THEN '  ' || title || ' ' WHEN 1 THEN 'Chapter ' || doc_id ELSE '' END AS chapter, text FROM d),
w AS (SELECT doc_id, regexp_replace(unnest(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{{L}}'']+')), '^''+|''+$', '', 'g') AS word FROM documents),
c AS (SELECT doc_id, word, count(*) AS n FROM w WHERE length(word) >= 4 AND word NOT IN ({_STOP}) GROUP BY 1, 2),
r AS (SELECT doc_id, list(word ORDER BY n DESC, word) AS words FROM c GROUP BY 1),
s AS (SELECT n.doc_id, coalesce(words, []) AS words, list_filter([nullif(title, ''), CASE WHEN lower(regexp_replace(chapter, '^\s+|\s+$', '', 'g')) <> lower(title) THEN nullif(regexp_replace(chapter, '^\s+|\s+$', '', 'g'), '') END], lambda x: x IS NOT NULL) AS named FROM n LEFT JOIN r USING (doc_id)),
t AS (SELECT doc_id, list_reduce(list_transform(words, lambda w: [w]), lambda got, w: CASE WHEN len(got) >= 8 OR len(list_filter(got, lambda t: contains(lower(t), w[1]))) > 0 THEN got ELSE list_concat(got, w) END,
  list_concat(named, CASE WHEN len(words) >= 2 THEN [words[1] || ' ' || words[2]] ELSE [] END)) AS terms FROM s)
SELECT doc_id, array_to_string(terms[1:8], '|') AS terms FROM t""")
def footage_terms(spark, d):
    t = spread(D.table(spark, d, "documents").select("doc_id", "text"))
    title = F.array_join(F.slice(F.split(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " "), " "), 1, 2), " ")
    chapter = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("  "), "title", F.lit(" "))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("Chapter "), "doc_id")).otherwise("")
    named = t.withColumn("title", title).withColumn("chapter", chapter)
    return named.select("doc_id", F.array_join(G.terms(F.col("title"), F.col("chapter"), F.col("text")), "|").alias("terms"))


_PARTS = """p AS (SELECT p_partkey, p_size AS n, CASE WHEN p_size % 7 = 0 THEN '  ' ELSE repeat(p_name || ' ', p_size % 6 + 1) END AS book_, CASE WHEN p_size % 3 = 0 THEN '' ELSE p_brand END AS author, CASE WHEN p_size % 11 = 0 THEN p_type || ' | Episode ' || p_partkey ELSE p_type END AS chapter_ FROM part),
l AS (SELECT *, CASE WHEN trim(book_) = '' THEN 'Untitled' ELSE trim(book_) END AS book, trim(chapter_) AS chapter FROM p)"""


@query(rf"""WITH {_PARTS}, b AS (SELECT *, CASE WHEN book = chapter THEN book ELSE book || ' - ' || chapter END AS base, ' | Episode ' || n AS suffix FROM l)
SELECT p_partkey, CASE WHEN regexp_matches(base, '(?i)\|\s*episode\s+\d+$') THEN CASE WHEN length(base) <= 100 THEN base ELSE rtrim(base[:99]) || '…' END
  ELSE CASE WHEN length(base) <= 100 - length(suffix) THEN base ELSE rtrim(left(base, CAST(99 - length(suffix) AS BIGINT))) || '…' END || suffix END AS title,
  chapter || chr(10) || chr(10) || 'From "' || book || '"' || CASE WHEN author <> '' THEN ' by ' || author ELSE '' END || '.' || chr(10) || chr(10) || '#audiobook #books' AS description,
  array_to_string(list_filter([book, author, chapter, 'audiobook', 'books'], lambda x: x <> ''), '|') AS tags FROM b""")
def upload_listings(spark, d):
    book = F.when(F.col("p_size") % 7 == 0, "  ").otherwise(F.repeat(F.concat("p_name", F.lit(" ")), F.col("p_size") % 6 + 1))
    chapter = F.when(F.col("p_size") % 11 == 0, F.concat("p_type", F.lit(" | Episode "), "p_partkey")).otherwise(F.col("p_type"))
    got = P.upload_listing(book, F.when(F.col("p_size") % 3 == 0, "").otherwise(F.col("p_brand")), chapter, F.col("p_size"))
    return D.table(spark, d, "part").select("p_partkey", got.alias("l")).select("p_partkey", "l.title", "l.description", F.array_join("l.tags", "|").alias("tags"))


@query(r"""WITH p AS (SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN p_name || '.epub' WHEN 1 THEN 'books/' || p_name WHEN 2 THEN replace(p_name, ' ', '_') ELSE '  ' || p_name || ' ' END AS book_, CASE WHEN p_size % 4 = 0 THEN '' ELSE p_brand END AS author,
  CASE p_size % 6 WHEN 0 THEN p_name || ' — ' || p_brand || ' — ' || p_type WHEN 1 THEN p_brand || ' - ' || p_type WHEN 2 THEN p_name ELSE p_type END AS title FROM part),
b AS (SELECT *, CASE WHEN regexp_matches(book_, '[\\/]|\.epub$') OR (contains(trim(book_), '_') AND NOT regexp_matches(trim(book_), '\s')) THEN '' ELSE trim(book_) END AS book FROM p),
x AS (SELECT *, CASE WHEN book = '' THEN title WHEN title = book THEN '' WHEN starts_with(title, book || ' — ') THEN substr(title, length(book) + 4) WHEN starts_with(title, book || ' - ') THEN substr(title, length(book) + 4) ELSE title END AS r FROM b),
y AS (SELECT *, CASE WHEN r = '' OR author = '' THEN r WHEN r = author THEN '' WHEN starts_with(r, author || ' — ') OR starts_with(r, author || ' - ') THEN substr(r, length(author) + 4) ELSE r END AS r2 FROM x),
z AS (SELECT *, CASE WHEN r2 = '' THEN title ELSE r2 END AS section FROM y),
o AS (SELECT *, left(concat_ws(' — ', CASE WHEN book <> '' AND lower(book) <> lower(section) THEN book END, CASE WHEN author <> '' AND lower(author) <> lower(section) THEN author END, section), 120) AS opening,
  left(concat_ws(' — ', 'New Name', CASE WHEN author <> '' AND lower(author) <> lower(section) THEN author END, section), 120) AS renamed FROM z)
SELECT p_partkey, section, opening, CASE WHEN title = opening AND renamed <> title THEN renamed END AS rewritten FROM o""")
def opening_titles(spark, d):
    size = F.col("p_size")
    book = F.when(size % 5 == 0, F.concat("p_name", F.lit(".epub"))).when(size % 5 == 1, F.concat(F.lit("books/"), "p_name")).when(size % 5 == 2, F.replace(F.col("p_name"), F.lit(" "), F.lit("_"))).otherwise(F.concat(F.lit("  "), "p_name", F.lit(" ")))
    title = F.when(size % 6 == 0, F.concat_ws(" — ", "p_name", "p_brand", "p_type")).when(size % 6 == 1, F.concat_ws(" - ", "p_brand", "p_type")).when(size % 6 == 2, F.col("p_name")).otherwise(F.col("p_type"))
    p = D.table(spark, d, "part").select("p_partkey", book.alias("book"), F.when(size % 4 == 0, "").otherwise(F.col("p_brand")).alias("author"), title.alias("title"))
    section = T.section_name(F.col("title"), F.col("book"), F.col("author"))
    return p.select("p_partkey", section.alias("section"), T.opening_title(F.col("book"), F.col("author"), section).alias("opening"), T.rewritten_title(F.col("title"), F.col("book"), F.col("author"), F.lit("New Name"), F.col("author")).alias("rewritten"))


@query("""SELECT p_partkey, ['integer', 'integer', 'float', 'boolean', 'none', 'list', 'list', 'map', 'integer', 'string', 'text', 'text'][p_partkey % 12 + 1] AS kind,
  CASE p_partkey % 12 WHEN 0 THEN CAST(p_partkey AS VARCHAR) WHEN 1 THEN CAST(-p_size AS VARCHAR) WHEN 2 THEN p_size || '.5' WHEN 3 THEN CAST(CAST(p_size % 2 = 0 AS BOOLEAN) AS VARCHAR) WHEN 4 THEN 'null' WHEN 5 THEN CAST(to_json([p_brand, p_type]) AS VARCHAR)
  WHEN 6 THEN CAST(to_json([[p_size, p_size + 1], [p_size * 2]]) AS VARCHAR) WHEN 7 THEN '{"brand":' || to_json(p_brand) || ',"sizes":[' || p_size || ']}' WHEN 8 THEN CAST(p_size AS VARCHAR) WHEN 9 THEN CAST(to_json(p_name) AS VARCHAR) WHEN 10 THEN CAST(to_json(p_type) AS VARCHAR) ELSE CAST(to_json('[' || p_brand) AS VARCHAR) END AS json FROM part""")
def typed_values(spark, d):
    """Literals of every kind as a state store holds them, made of the row's own values."""
    size, quoted = F.col("p_size").cast("string"), lambda c: F.concat(F.lit("'"), c, F.lit("'"))
    forms = [
        F.col("p_partkey").cast("string"), F.concat(F.lit("-"), size), F.concat(size, F.lit(".5")), F.when(F.col("p_size") % 2 == 0, "True").otherwise("False"), F.lit("None"),
        F.concat(F.lit("["), quoted(F.col("p_brand")), F.lit(", "), quoted(F.col("p_type")), F.lit(",]")),
        F.concat(F.lit("(["), size, F.lit(", "), (F.col("p_size") + 1).cast("string"), F.lit("], ("), (F.col("p_size") * 2).cast("string"), F.lit(",))")),
        F.concat(F.lit("{'brand': "), quoted(F.col("p_brand")), F.lit(", 'sizes': ["), size, F.lit("]}")),
        F.concat(F.lit("00"), size), quoted(F.col("p_name")), F.col("p_type"), F.concat(F.lit("["), "p_brand"),
    ]
    value = F.get(F.array(*forms), (F.col("p_partkey") % 12).cast("int"))
    return D.table(spark, d, "part").select("p_partkey", P.typed(value).alias("t")).select("p_partkey", "t.kind", "t.json")


def say(view: dict) -> object:
    """A proposer that answers in every shape that is met: lists, objects, both spellings, doubles and unknown starts; some books it refuses."""
    if view["book_id"] % 5 == 3:
        raise TimeoutError("no answer")
    units = view["units"]
    named = [{"start_block_id": u["start_block"], "title": f"Part {u['idx']}"} for u in units if u["idx"] % 7 == 2]
    if view["book_id"] % 2:
        return named + [{"title": "nowhere"}, "text"]
    spelled = [{"startBlockId": f" {s['start_block_id']} ", "title": s["title"]} for s in named]
    return {"sections": spelled + spelled[:1] + [{"startBlockId": "unknown", "title": "x"}], "skipBlockIds": [u["start_block"] for u in units if u["idx"] % 9 == 5]}


@query()
def proposed_sections(spark, d):
    kept, chapters = _kept(spark, d)
    return R.detect_sections(kept, chapters, say)[0]


@query()
def proposed_skips(spark, d):
    kept, chapters = _kept(spark, d)
    return R.detect_sections(kept, chapters, say)[1]
