"""Registered queries over job state, replies, settings and recognised pages."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import replies as R
from ..functions import text as T
from ..functions import transcripts as X
from ..operators import columns as Y
from ..operators import layout as L
from ..operators import links as K
from ..operators import narration as N
from ..operators import outline as O
from ..operators import scans as Z
from ..operators import state as S
from ..session import spread
from . import domain as D
from .queries import _CUES, _DECISIONS, _SEGMENTS, _TRIM, _cues, query


def _page_spans(spark, d):
    left = F.when(F.col("l_quantity") >= 48, 50.0).when(F.col("l_linenumber") % 2 == 0, 300.0).otherwise(50.0)
    right = F.when(F.col("l_quantity") >= 48, 490.0).otherwise(left + 90 + F.col("l_quantity") * 2)
    y = 800 - (F.col("l_orderkey") % 8) * 80 - F.col("l_linenumber") * 10
    return D.table(spark, d, "lineitem").select(F.floor(F.col("l_orderkey") / 8).alias("page"), F.col("l_orderkey").alias("item"), F.col("l_linenumber").alias("line"), left.alias("left"), right.alias("right"), y.cast("double").alias("y"))


_SPANS = """spans AS (SELECT l_orderkey // 8 AS page, l_orderkey AS item, l_linenumber AS line, CASE WHEN l_quantity >= 48 THEN 50.0 WHEN l_linenumber % 2 = 0 THEN 300.0 ELSE 50.0 END::DOUBLE AS l,
  CASE WHEN l_quantity >= 48 THEN 490.0 WHEN l_linenumber % 2 = 0 THEN 390 + l_quantity * 2 ELSE 140 + l_quantity * 2 END::DOUBLE AS r, (800 - (l_orderkey % 8) * 80 - l_linenumber * 10)::DOUBLE AS y FROM lineitem),
box AS (SELECT page, min(l) AS lo, max(r) - min(l) AS w, count(*) AS n FROM spans GROUP BY 1),
narrow AS (SELECT page, l, r, lo, w, n, max(r) OVER (PARTITION BY page ORDER BY l ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach, count(*) OVER (PARTITION BY page) AS k FROM spans JOIN box USING (page) WHERE r - l <= w * 0.66::DOUBLE),
gaps AS (SELECT page, reach AS a, l AS b, w, row_number() OVER (PARTITION BY page ORDER BY l - reach DESC, l) AS nth FROM narrow WHERE k >= 8 AND n - k <= n * 0.35::DOUBLE AND l > reach AND (reach + l) / 2 - lo BETWEEN w * 0.25::DOUBLE AND w * 0.75::DOUBLE),
gutters AS (SELECT page, a, b FROM gaps WHERE nth = 1 AND b - a >= w * 0.04::DOUBLE AND (SELECT count(*) FROM narrow x WHERE x.page = gaps.page AND x.r <= gaps.a) >= 4 AND (SELECT count(*) FROM narrow x WHERE x.page = gaps.page AND x.l >= gaps.b) >= 4)"""


@query(f"WITH {_SPANS} SELECT page, a AS gutter_start, b AS gutter_end FROM gutters")
def page_gutters(spark, d):
    return Y.gutter(_page_spans(spark, d))


@query(
    f"""WITH {_SPANS}, s AS (SELECT *, coalesce(l < b AND r > a, FALSE) AS across FROM spans LEFT JOIN gutters USING (page)),
t AS (SELECT *, sum(across::INT) OVER (PARTITION BY page ORDER BY y DESC, l, r, item, line ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS band FROM s)
SELECT page, item, line, CAST(row_number() OVER (PARTITION BY page ORDER BY band, CASE WHEN a IS NULL OR across THEN 0 WHEN r <= a THEN 1 ELSE 2 END, y DESC, l, r, item, line) - 1 AS INT) AS pos FROM t"""
)
def reading_order(spark, d):
    return Y.reading_order(_page_spans(spark, d), "page", ("item", "line")).select("page", "item", "line", "pos")


@query()
def column_lines(spark, d):
    s = _page_spans(spark, d)
    items = s.select("page", F.col("left").alias("x"), "y", (F.col("right") - F.col("left")).alias("width"), F.lit(10.0).alias("font_size"), F.concat(F.lit("w"), "item", F.lit("-"), "line").alias("text"))
    return Y.page_lines(items)


_WRAP = ["Here is the text of the page:\n", "Title: ", "**Note** ", "[[NO_TEXT]]\n", "I am unable to read this. ", ""]
_FENCE = r"(?s)^```[^\n]*\n(.*?)\n?```$"


def _matches(c: str, *patterns: str) -> str:
    return "(" + " OR ".join("regexp_matches({}, '{}')".format(c, p.replace("'", "''")) for p in patterns) + ")"


def _trimmed(sql: str) -> str:
    return _TRIM.format(sql)


_LABEL = X.LABEL.replace("(?mdi)", "(?mi)")
_REPLIES = rf"""WITH a AS (SELECT conv_id, turn, {_trimmed("CASE (conv_id + turn) % 6 " + " ".join(f"WHEN {n} THEN '{w}'" for n, w in enumerate(_WRAP)) + " END || " + _trimmed("coalesce(text, '')"))} AS raw FROM conversations),
b AS (SELECT *, {_matches("raw", _FENCE)} AS fence, CASE WHEN {_matches("raw", _FENCE)} THEN {_trimmed(f"regexp_extract(raw, '{_FENCE}', 1)")} ELSE raw END AS t FROM a),
c AS (SELECT *, {_trimmed(f"replace(t, '{X.NO_TEXT}', ' ')")} AS rest FROM b),
d AS (SELECT *, CASE WHEN t = '' THEN 'blank_page' WHEN length(t) > 8000 THEN 'over_long' WHEN {" OR ".join(f"contains(lower(t), '{i}')" for i in X.INSTRUCTIONS)} THEN 'prompt_echo' WHEN rest = '' THEN 'blank_page' END AS early, CASE WHEN contains(t, '{X.NO_TEXT}') THEN rest ELSE t END AS r FROM c),
e AS (SELECT *, CASE WHEN early IS NULL THEN regexp_replace(regexp_replace(regexp_replace(regexp_replace(r, '(?m)^[ \t]{{0,3}}#{{1,6}}[ \t]+', '', 'g'), '\*\*([^*]+)\*\*', '\1', 'g'), '__([^_]+)__', '\1', 'g'), '`{{1,3}}([^`\n]+)`{{1,3}}', '\1', 'g') END AS plain FROM d),
f AS (SELECT *, {_trimmed("split_part(plain, chr(10), 1)")} AS head, CASE WHEN contains(plain, chr(10)) THEN substr(plain, strpos(plain, chr(10)) + 1) ELSE '' END AS tail FROM e),
g AS (SELECT *, regexp_matches(head, '[:：]') AND length(regexp_extract(head, '^([^:：]*)[:：]', 1)) <= 120 AS split FROM f),
h AS (SELECT *, coalesce({_matches("head", X.OPENER)} AND {_matches("head", X.SUBJECT)} AND (split OR length(head) <= 120), FALSE) AS opens FROM g),
i AS (SELECT *, CASE WHEN opens THEN regexp_replace(concat_ws(chr(10), nullif(CASE WHEN split THEN regexp_replace(head, '^[^:：]*[:：]\s*', '') END, ''), nullif(tail, '')), '^\s+', '') ELSE plain END AS body FROM h),
j AS (SELECT *, coalesce({_matches("body", _LABEL)}, FALSE) AS labels, {_trimmed(f"regexp_replace(body, '{_LABEL}', '', 'g')")} AS x FROM i),
k AS (SELECT *, coalesce(early, CASE WHEN opens AND {_trimmed("body")} = '' THEN 'meta_commentary' WHEN x = '' THEN 'blank_page'
  WHEN {_matches("x", *X.COMMENTS)} OR {_matches("(CASE WHEN length(x) <= 480 THEN x ELSE left(x, 240) || chr(10) || right(x, 240) END)", *X.EDGE_COMMENTS)} THEN 'meta_commentary' END) AS verdict FROM j)
SELECT conv_id, turn, CASE WHEN verdict IS NULL THEN x ELSE '' END AS transcript, coalesce(verdict = 'blank_page', TRUE) AS accepted, CASE WHEN verdict IS NOT NULL THEN 0 WHEN opens OR labels THEN 0.45::DOUBLE * 0.8::DOUBLE ELSE 0.45 END::DOUBLE AS confidence,
  concat_ws(',', CASE WHEN fence THEN 'code_fence_stripped' END, CASE WHEN plain <> r THEN 'markdown_stripped' END, CASE WHEN opens THEN 'preamble_stripped' END, CASE WHEN labels THEN 'structural_labels_stripped' END, verdict) AS guards FROM k"""


@query(_REPLIES)
def recogniser_replies(spark, d):
    """Every turn's text in the ways recognisers dress up a page."""
    how = F.element_at(F.array(*map(F.lit, _WRAP)), ((F.col("conv_id") + F.col("turn")) % 6 + 1).cast("int"))
    replies = D.table(spark, d, "conversations").select("conv_id", "turn", F.concat(how, T.trim(F.coalesce("text", F.lit("")))).alias("reply"))
    return X.sanitise(replies, "reply").select("conv_id", "turn", "transcript", "accepted", "confidence", F.array_join("guards", ",").alias("guards"))


@query("""WITH h AS (SELECT doc_id, n_chars AS size, doc_id % 7 AS a, doc_id % 7 + doc_id % 11 - 3 AS b, doc_id % 5 AS k FROM documents)
SELECT doc_id, coalesce(CASE WHEN size <= 0 THEN NULL WHEN k = 0 THEN 0 WHEN k = 1 AND a < size AND b >= a THEN a WHEN k = 2 AND a < size THEN a WHEN k = 3 AND a > 0 THEN greatest(size - a, 0) END, -1)::BIGINT AS first_byte,
  coalesce(CASE WHEN size <= 0 THEN NULL WHEN k = 0 THEN size - 1 WHEN k = 1 AND a < size AND b >= a THEN least(b, size - 1) WHEN k = 2 AND a < size THEN size - 1 WHEN k = 3 AND a > 0 THEN size - 1 END, -1)::BIGINT AS last_byte FROM h""")
def byte_ranges(spark, d):
    a = (F.col("doc_id") % 7).cast("string")
    b = (F.col("doc_id") % 7 + F.col("doc_id") % 11 - 3).cast("string")
    k = F.col("doc_id") % 5
    header = F.when(k == 1, F.concat(F.lit("bytes="), a, F.lit("-"), b)).when(k == 2, F.concat(F.lit("bytes="), a, F.lit("-"))).when(k == 3, F.concat(F.lit("bytes=-"), a)).when(k == 4, F.lit("bytes=0-1,3-4"))
    t = D.table(spark, d, "documents").withColumn("r", R.byte_range(header, F.col("n_chars")))
    return t.select("doc_id", F.coalesce("r.start", F.lit(-1)).alias("first_byte"), F.coalesce("r.end", F.lit(-1)).alias("last_byte"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN least((event_id % 130) / 100.0::DOUBLE, 1) WHEN 1 THEN CASE WHEN event_id % 90 > 1 THEN (event_id % 90) / 100.0::DOUBLE ELSE event_id % 90 END WHEN 2 THEN CASE WHEN event_id % 3 > 0 THEN least((event_id % 40) / ((event_id % 3) * 10.0::DOUBLE), 1) END END::DOUBLE AS share FROM events""")
def progress_lines(spark, d):
    e, k = D.table(spark, d, "events"), F.col("event_id") % 4
    n = lambda m: (F.col("event_id") % m).cast("string")
    line = (
        F.when(k == 0, F.concat(F.lit('{"percent": '), n(130), F.lit("}")))
        .when(k == 1, F.concat(F.lit('{"progress": '), n(90), F.lit("}")))
        .when(k == 2, F.concat(F.lit('{"frame": '), n(40), F.lit(', "total": '), (F.col("event_id") % 3 * 10).cast("string"), F.lit("}")))
        .otherwise(F.concat(F.lit("frame "), n(40)))
    )
    return e.select("event_id", R.progress_of(line).alias("share"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'zh-CN' WHEN c_custkey % 4 = 1 THEN 'de' WHEN c_custkey % 4 = 2 AND c_custkey % 3 = 0 THEN 'fr' ELSE 'en' END AS language,
CASE WHEN c_custkey % 4 = 0 THEN 'chi' WHEN c_custkey % 4 = 1 THEN 'ger' WHEN c_custkey % 4 = 2 AND c_custkey % 3 = 0 THEN 'fre' ELSE 'eng' END AS track FROM customer""")
def languages(spark, d):
    k = F.col("c_custkey")
    saved = F.when(k % 4 == 0, " zh_cn ").when(k % 4 == 1, "de-AT").when(k % 4 == 2, "xx")
    lang = R.language_of(saved, F.when(k % 3 == 0, "fr-CA").when(k % 3 == 1, "tlh").otherwise("en-GB"), ["en", "zh-CN", "de", "fr"])
    lang = F.when((k % 4 == 3) & (k % 3 == 0), F.lit("en")).otherwise(lang)
    return D.table(spark, d, "customer").select("c_custkey", lang.alias("language"), R.track_code(lang).alias("track"))


def _orders(spark, d, *columns):
    return D.table(spark, d, "orders").select(*columns)


@query("""SELECT o_orderkey AS task_id, CASE WHEN n <= 5 THEN 'running' WHEN n <= 12 THEN 'queued' ELSE 'rejected' END AS status FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey % 97 ORDER BY o_orderdate, o_orderkey) AS n FROM orders)""")
def admitted_tasks(spark, d):
    queue = _orders(spark, d, (F.col("o_custkey") % 97).alias("queue"), F.col("o_orderdate").alias("arrived"), F.col("o_orderkey").alias("task_id"))
    return K.admitted(queue, 5, 7).select("task_id", "status")


@query(f"""WITH {_SEGMENTS} SELECT book_id, string_agg(idx, ',' ORDER BY idx) AS items FROM segments WHERE state = 'bogus' OR (state = 'failed' AND task_id % 2 = 0) GROUP BY 1""")
def resumable_work(spark, d):
    s = D.segments(spark, d).withColumn("state", F.when(F.col("state") == "bogus", "pending").otherwise(F.col("state")))
    s = s.withColumn("error", F.when(F.col("state") == "failed", F.when(F.col("task_id") % 2 == 0, "interrupted by restart").otherwise("disk full")))
    return K.resumable(s).select("book_id", F.array_join("items", ",").alias("items"))


@query(f"WITH {_SEGMENTS} SELECT book_id, idx FROM segments WHERE state NOT IN ('queued', 'rendering') AND (book_id, idx) IN (SELECT (book_id, idx) FROM segments WHERE seconds > 30000)")
def render_targets(spark, d):
    s = D.segments(spark, d)
    wanted = s.filter("seconds > 30000").select("book_id", "idx")
    return K.to_render(s, wanted.unionAll(wanted)).select("book_id", "idx")


@query("""WITH s AS (SELECT CASE o_orderkey % 3 WHEN 0 THEN 'videos' WHEN 1 THEN 'segments' ELSE 'shorts' END AS source, o_orderkey AS key, o_orderdate AS made_at FROM orders WHERE o_orderstatus = 'F' AND o_custkey % 5 <> 0 AND o_custkey % 4 <> 0)
SELECT source, key, CAST(row_number() OVER (PARTITION BY source ORDER BY made_at, key) AS INT) AS place FROM s""")
def upload_backlog(spark, d):
    result = lambda ok, video: F.struct(F.lit(ok).alias("success"), F.lit(video).alias("video_id"))
    uploads = F.when(F.col("o_custkey") % 4 == 0, F.array(result(False, None), result(True, "v1"))).when(F.col("o_custkey") % 4 == 1, F.array(result(True, "")))
    file = F.when(F.col("o_custkey") % 5 == 0, "").otherwise("final.mp4")
    rows = _orders(spark, d, "o_orderkey", F.when(F.col("o_orderstatus") == "F", "complete").otherwise("failed").alias("state"), file.alias("file"), uploads.alias("uploads"), F.col("o_orderkey").alias("key"), F.col("o_orderdate").alias("made_at"))
    return K.backlog({name: rows.filter(F.col("o_orderkey") % 3 == n) for n, name in enumerate(["videos", "segments", "shorts"])}).select("source", "key", "place")


@query("SELECT o_orderkey, o_custkey AS book_id FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 3 = c_nationkey % 3")
def changes_at_revision(spark, d):
    changes = _orders(spark, d, "o_orderkey", F.col("o_custkey").alias("book_id"), (F.col("o_orderkey") % 3).alias("revision"))
    books = D.table(spark, d, "customer").select(F.col("c_custkey").alias("book_id"), (F.col("c_nationkey") % 3).cast("long").alias("revision"))
    return K.at_revision(changes, books).select("o_orderkey", "book_id")


@query("SELECT c_custkey AS book_id, c_nationkey + CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) THEN 1 ELSE 0 END AS revision FROM customer")
def next_revisions(spark, d):
    books = D.table(spark, d, "customer").select(F.col("c_custkey").alias("book_id"), F.col("c_nationkey").alias("revision"))
    return K.next_revision(books, _orders(spark, d, F.col("o_custkey").alias("book_id")))


@query(f"""WITH {_DECISIONS}, firsts AS (SELECT book_id, chapter_id, first(block_id ORDER BY ord) AS first_block FROM blocks GROUP BY 1, 2),
p AS (SELECT book_id, chapter_id, CASE WHEN ord % 3 = 0 THEN first_block WHEN ord % 3 = 1 THEN block_id END AS block_id, ord FROM blocks JOIN firsts USING (book_id, chapter_id))
SELECT book_id, block_id, ord FROM p WHERE block_id IS NOT NULL""")
def grounded_proposals(spark, d):
    b = D.blocks(spark, d)
    chunks = b.groupBy("book_id", F.col("chapter_id").alias("chunk")).agg(F.min_by("block_id", "ord").alias("first_block"))
    named = F.when(F.col("ord") % 3 == 0, " ").when(F.col("ord") % 3 == 1, F.concat(F.lit(" "), "block_id")).otherwise("invented")
    return K.grounded(b.select("book_id", F.col("chapter_id").alias("chunk"), named.alias("block_id"), "ord"), b, chunks).select("book_id", "block_id", "ord")


@query(r"""WITH p AS (SELECT p_size, p_partkey, p_type, row_number() OVER (PARTITION BY p_size, lower(p_type) ORDER BY p_partkey) AS nth FROM part)
SELECT p_size, p_partkey, CAST(row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) - 1 AS INT) AS idx FROM p WHERE nth = 1""")
def distinct_titles(spark, d):
    title = F.when(F.col("p_partkey") % 2 == 0, F.upper("p_type")).otherwise(F.concat(F.lit("  "), F.replace(F.col("p_type"), F.lit(" "), F.lit(" \n "))))
    p = D.table(spark, d, "part").select("p_size", "p_partkey", title.alias("title"))
    return K.distinct_titles(p, "p_size", "title", "p_partkey").select("p_size", "p_partkey", "idx")


@query("""WITH c AS (SELECT l_orderkey AS doc_id, l_returnflag AS codec, nullif(l_linenumber % 3 * 22050, 0) AS rate FROM lineitem)
SELECT doc_id, count(DISTINCT codec || coalesce(rate, 44100)) = 1 AS uniform, CAST(coalesce(max(rate), 44100) AS INT) AS rate FROM c GROUP BY 1""")
def audio_formats(spark, d):
    rate = F.nullif(F.col("l_linenumber") % 3 * 22050, F.lit(0))
    chunks = D.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_returnflag").alias("codec"), rate.alias("rate"), F.lit(None).cast("int").alias("channels"))
    return K.same_format(chunks, "doc_id").select("doc_id", "uniform", "rate")


@query("""WITH t AS (SELECT l_orderkey AS doc_id, sum(l_quantity) AS total FROM lineitem GROUP BY 1) SELECT doc_id, o_orderkey % 3 * 0.25::DOUBLE AS drift, o_orderkey % 3 = 2 AS flagged FROM t JOIN orders ON o_orderkey = doc_id""")
def duration_drift(spark, d):
    chunks = D.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_quantity").alias("duration"))
    whole = chunks.groupBy("doc_id").agg(F.sum("duration").alias("duration")).join(_orders(spark, d, F.col("o_orderkey").alias("doc_id")), "doc_id")
    return K.drift(chunks, whole.withColumn("duration", F.col("duration") + F.col("doc_id") % 3 * 0.25), "doc_id").select("doc_id", F.round("drift", 6).alias("drift"), "flagged")


@query("""SELECT o_orderkey, coalesce(p_size >= 25 AND p_size % 4 <> 0, FALSE) AS hit FROM orders LEFT JOIN (SELECT p_partkey, p_size FROM part WHERE p_brand <> 'Brand#1') ON o_custkey = p_partkey""")
def cache_lookups(spark, d):
    items = F.when(F.col("p_size") % 4 == 0, F.array().cast("array<string>")).otherwise(F.array("p_name"))
    cache = D.table(spark, d, "part").filter("p_brand <> 'Brand#1'").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("expires_at"), items.alias("items"))
    return S.cache_hits(_orders(spark, d, "o_orderkey", F.col("o_custkey").alias("k")), cache, "k", F.lit(24)).select("o_orderkey", "hit")


@query("""SELECT 'orders' AS name, count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) UNION ALL SELECT 'customer', count(*) FROM customer WHERE c_acctbal >= 0""")
def cascade_counts(spark, d):
    c = D.table(spark, d, "customer").withColumnRenamed("c_custkey", "book_id")
    left = S.cascade_delete({"orders": D.table(spark, d, "orders").withColumnRenamed("o_custkey", "book_id"), "customer": c}, c.filter("c_acctbal < 0").select("book_id"), "book_id")
    counts = [rows.agg(F.lit(name).alias("name"), F.count("*").alias("n")) for name, rows in left.items()]
    return counts[0].unionByName(counts[1])


@query("""SELECT l_suppkey % 50 AS book_id, CAST(count(DISTINCT l_orderkey) AS BIGINT) AS total FROM lineitem GROUP BY 1""")
def pages_per_book(spark, d):
    pages = D.table(spark, d, "lineitem").select((F.col("l_suppkey") % 50).alias("book_id"), F.col("l_orderkey").alias("page")).distinct()
    return L.run_summary(pages, pages.withColumns({"error": F.lit(None).cast("string"), "confidence": F.lit(0.5)}), "book_id").select("book_id", "total")


@query("""WITH r AS (SELECT l_orderkey AS page, bool_or(l_returnflag <> 'N' AND l_quantity < 25) AS done FROM lineitem GROUP BY 1) SELECT page FROM r WHERE NOT done""")
def pages_to_read(spark, d):
    rows = D.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("page"), "l_returnflag", "l_quantity")
    results = rows.filter("l_returnflag <> 'N'").select("page", F.when(F.col("l_quantity") >= 25, "timeout").alias("error"))
    return L.to_read(rows.select("page").distinct(), results)


@query("""SELECT o_orderkey AS state FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderdate > TIMESTAMP '1995-01-01'""")
def consumed_states(spark, d):
    states = _orders(spark, d, F.col("o_orderkey").alias("state"), F.col("o_orderdate").alias("expires_at"))
    wanted = D.table(spark, d, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("state"))
    return K.consumed(states, wanted, F.to_timestamp(F.lit("1995-01-01")))[0].select("state")


@query("""SELECT coalesce(a.c_custkey, b.s_suppkey) AS channel_id, coalesce(s_name, c_name) AS title, CASE WHEN s_suppkey % 2 = 1 THEN 't' || s_suppkey WHEN c_custkey IS NOT NULL THEN 'old' END AS refresh_token, CASE WHEN s_suppkey IS NULL THEN 'e' END AS error
FROM (SELECT * FROM customer WHERE c_acctbal > 0) a FULL JOIN supplier b ON c_custkey = s_suppkey""")
def connected_channels(spark, d):
    old = D.table(spark, d, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("channel_id"), F.col("c_name").alias("title"), F.lit("old").alias("refresh_token"), F.lit("s").alias("scopes"), F.lit(True).alias("auto_upload"), F.lit("e").alias("error"))
    token = F.when(F.col("s_suppkey") % 2 == 1, F.concat(F.lit("t"), "s_suppkey")).otherwise("")
    new = D.table(spark, d, "supplier").select(F.col("s_suppkey").alias("channel_id"), F.col("s_name").alias("title"), token.alias("refresh_token"), F.lit("").alias("scopes"))
    return K.connected_channels(old, new).select("channel_id", "title", "refresh_token", "error")


def _page_texts(spark, d):
    text = F.regexp_replace("text", r"\. ", ".\n\n")
    return D.table(spark, d, "documents").select(F.floor(F.col("doc_id") / 50).alias("book_id"), (F.col("doc_id") % 50 + 1).alias("page"), text.alias("text"), (F.col("doc_id") % 7 / 7.0).alias("confidence"))


_PARAGRAPHS = rf"""pages_ AS (SELECT doc_id // 50 AS book_id, doc_id % 50 + 1 AS page, regexp_split_to_array(regexp_replace(text, '\. ', '.' || chr(10) || chr(10), 'g'), '\n\s*\n') AS p, (doc_id % 7) / 7.0::DOUBLE AS confidence FROM documents WHERE text IS NOT NULL),
parts AS (SELECT book_id, page, confidence, unnest(range(len(q))) AS nth, unnest(q) AS part FROM (SELECT *, list_filter(p, lambda x: {_trimmed("x")} <> '') AS q FROM pages_)),
tied AS (SELECT *, coalesce(nth = 0 AND NOT {_matches(_trimmed("lag(part) OVER w"), Z.CLOSED)} AND {_matches(_trimmed("part"), Z.RUNS_ON)}, FALSE) AS more FROM parts WINDOW w AS (PARTITION BY book_id ORDER BY page, nth)),
runs AS (SELECT *, sum(CASE WHEN more THEN 0 ELSE 1 END) OVER (PARTITION BY book_id ORDER BY page, nth) - 1 AS pos FROM tied),
whole AS (SELECT book_id, CAST(pos AS INT) AS pos, min(page) AS page, min(confidence) AS confidence, string_agg(array_to_string(list_filter(list_transform(string_split(part, chr(10)), lambda x: {_trimmed("x")}), lambda x: x <> ''), chr(10)), chr(10) ORDER BY page, nth) AS t FROM runs GROUP BY 1, 2),
paragraphs AS (SELECT book_id, pos, page, replace(regexp_replace(regexp_replace(t, '(\p{{L}}{{2}})[-‐\x{{00AD}}]\n(\p{{Ll}})', '\1\2', 'g'), '(\S[-‐\x{{00AD}}])\n', '\1', 'g'), chr(10), ' ') AS text, confidence FROM whole)"""


@query(f"WITH {_PARAGRAPHS} SELECT * FROM paragraphs")
def recognised_paragraphs(spark, d):
    return Z.recognised_paragraphs(_page_texts(spark, d))


@query(
    f"""WITH {_PARAGRAPHS}, b AS (SELECT *, CASE WHEN page % 7 = 1 AND length(text) < 60 AND book_id % 3 > 0 THEN CAST(page % 2 + 1 AS INT) END AS level FROM paragraphs),
l AS (SELECT *, min(level) OVER (PARTITION BY book_id) AS top, (page - 1) // 10 AS band FROM b),
s AS (SELECT *, CASE WHEN top IS NULL THEN coalesce(band <> lag(band) OVER w, TRUE) ELSE coalesce(level = top, FALSE) END AS begins, row_number() OVER w AS nth FROM l WINDOW w AS (PARTITION BY book_id ORDER BY pos)),
c AS (SELECT *, sum(CASE WHEN begins OR nth = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY book_id ORDER BY pos) - 1 AS n FROM s)
SELECT book_id, pos, 'ch-' || n AS chapter_id, n || ':' || (row_number() OVER (PARTITION BY book_id, n ORDER BY pos) - 1) AS block_id,
  first(CASE WHEN top IS NULL THEN 'Pages ' || (band * 10 + 1) || '-' || (band * 10 + 10) WHEN begins THEN text ELSE 'Untitled' END) OVER (PARTITION BY book_id, n ORDER BY pos) AS chapter_title FROM c"""
)
def page_chapters(spark, d):
    p = Z.recognised_paragraphs(_page_texts(spark, d))
    head = (F.col("page") % 7 == 1) & (F.length("text") < 60) & (F.col("book_id") % 3 > 0)
    blocks = p.withColumns({"kind": F.when(head, "heading").otherwise("paragraph"), "level": F.when(head, (F.col("page") % 2 + 1).cast("int"))})
    counts = p.select("book_id", F.lit(50).alias("page_count")).distinct()
    return Z.page_chapters(blocks, counts, "Untitled").select("book_id", "pos", "chapter_id", "block_id", "chapter_title")


@query("""WITH u AS (SELECT o_custkey AS book_id, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS idx, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)
SELECT book_id, o_orderkey, k AS chunk FROM u, range(1000) r(k) WHERE idx BETWEEN k * 3 AND k * 3 + 4 AND (k = 0 OR k * 3 + 2 < n)""")
def outline_chunks(spark, d):
    u = _orders(spark, d, F.col("o_custkey").alias("book_id"), "o_orderkey").withColumn("idx", F.row_number().over(Window.partitionBy("book_id").orderBy("o_orderkey")) - 1)
    return O.overlapping(u, 5, 2).select("book_id", "o_orderkey", "chunk")


@query(f"""WITH {_CUES} SELECT doc_id, idx, round(start, 6) AS start, round(fin, 6) AS "end" FROM cues""")
def chunk_cues(spark, d):
    """Half of the recordings come with a voice's cues, the others fall back on their lines' lengths."""
    scripts = spread(D.table(spark, d, "documents")).select("doc_id", F.col("text").alias("script"), (F.length("text") / F.lit(15.0)).alias("duration"))
    cues = _cues(spark, d).withColumnRenamed("idx", "seq").withColumn("content", F.when(F.col("doc_id") % 2 == 0, F.col("content")).otherwise("?"))
    return N.chunk_cues(cues, scripts, "doc_id").select("doc_id", "idx", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"))


@query("""SELECT event_type, count(*) AS n, CAST(sum(octet_length(encode(props))) AS BIGINT) AS bytes, count(*) FILTER (old) AS expired, CAST(coalesce(sum(octet_length(encode(props))) FILTER (old), 0) AS BIGINT) AS freed FROM (SELECT *, ts <= TIMESTAMP '2024-01-15' - INTERVAL 5 DAY OR ts > TIMESTAMP '2024-01-15' AS old FROM events) GROUP BY 1""")
def cache_ages(spark, d):
    e = D.table(spark, d, "events").select("event_type", F.octet_length("props").alias("bytes"), F.col("ts").alias("made_at"))
    got = S.cache_ages(e, "event_type", F.to_timestamp(F.lit("2024-01-15")), F.make_dt_interval(F.lit(5)))
    return got.select("event_type", "n", "bytes", "expired", "freed")
