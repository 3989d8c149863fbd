"""The registered queries of this folder: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import attach, spread


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(attach(spark).read.parquet(f"{sf_dir}/{name}.parquet"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import fit, score

    docs = _table(spark, sf_dir, "documents")
    return score(docs, fit(docs, _table(spark, sf_dir, "labels")))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import fit, predict

    docs = _table(spark, sf_dir, "documents")
    return predict(docs, fit(docs))


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sentence_spans import remove_repeats

    return remove_repeats(_table(spark, sf_dir, "documents"))


def op5_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .warc import derive, responses

    made = derive(responses(_table(spark, sf_dir, "pages")))
    page = F.col("headers")["WARC-Page-Id"].cast("long").alias("page_id")
    return made.select(page, "warc_type", "record_id", "refers_to", "target_uri", "date", "content_type", "block_digest", F.col("block").cast("string").alias("content"))


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontam import contamination, report

    return report(contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")))


def op7_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licences import fit, report, scan

    docs = _table(spark, sf_dir, "documents")
    return report(scan(docs, fit(docs)))


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import remove_repeated_strings, report

    return report(remove_repeated_strings(_table(spark, sf_dir, "documents")))


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vptree import nearest

    return nearest(_table(spark, sf_dir, "embeddings"), lambda i: i % 20 == 0)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import path

    from .packing import pack, token_pieces

    return pack(token_pieces(_table(spark, sf_dir, "documents"), path("byte_bpe_50k.json")))


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import path

    from .alignment import align

    return align(_table(spark, sf_dir, "documents"), path("byte_bpe_50k.json"), path("piece_bpe_32k.model"))


def op12_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pivots import near_vectors

    return near_vectors(_table(spark, sf_dir, "embeddings"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .manifest import manifest

    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    tampered = F.when(hit, F.translate("text", capitals, capitals.lower())).otherwise(F.col("text"))
    return manifest(_table(spark, sf_dir, "documents"), altered={"text": tampered})


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_language_id, op3_minhash_near_dedup, op4_substring_dedup, op5_warc_derivatives, op6_benchmark_decontamination, op7_licence_scan, op8_suffix_array_dedup, op9_nearest_neighbours, op10_best_fit_packing, op11_tokenizer_alignment, op12_embedding_near_dedup, op13_merkle_manifest)}
SQL: dict[str, str] = {}

SQL["op6_benchmark_decontamination"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
p AS (SELECT DISTINCT item, m, array_to_string(w[i:i + m - 1], ' ') AS k
      FROM (SELECT item, w, least(13, len(w)) AS m, unnest(generate_series(1, len(w) - least(13, len(w)) + 1)) AS i FROM b WHERE len(w) > 0)),
x AS (SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS k
      FROM (SELECT doc_id, w, m, unnest(generate_series(1, len(w) - m + 1)) AS i FROM d, (SELECT DISTINCT m FROM p) WHERE len(w) >= m)),
f AS (SELECT x.doc_id, x.m, x.i, p.item FROM x JOIN p ON x.m = p.m AND x.k = p.k),
h AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + m - 1)) AS j FROM f) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item FROM f) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL["op3_minhash_near_dedup"] = rf"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array({_LOW}, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN [array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)] WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS id, doc_id AS m FROM documents UNION SELECT r.id, e.b FROM r JOIN e ON r.m = e.a)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT id, min(m) AS component_id FROM r GROUP BY 1) c ON c.id = d.doc_id
"""

SQL["op8_suffix_array_dedup"] = r"""
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 400)) AS k FROM (SELECT doc_id, h, unnest(range(n - 199)) AS i FROM h WHERE n >= 200)),
t AS (SELECT k FROM w GROUP BY k HAVING count(*) > 1),
g AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 200 THEN 0 ELSE 1 END AS fresh FROM w JOIN t USING (k)),
s AS (SELECT doc_id, run, min(i) AS a, max(i) + 200 AS b FROM (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM g) GROUP BY 1, 2),
c AS (SELECT doc_id, sum(b - a) AS removed, count(*) AS spans FROM s GROUP BY 1),
q AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS x, a AS y FROM s UNION ALL SELECT s.doc_id, max(b), max(n) FROM s JOIN h USING (doc_id) GROUP BY 1),
k AS (SELECT q.doc_id, string_agg(substr(h, 2 * x + 1, 2 * (y - x)), '' ORDER BY x) AS kept FROM q JOIN h USING (doc_id) GROUP BY 1)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM h LEFT JOIN c USING (doc_id) LEFT JOIN k USING (doc_id)
"""

_TREE = """
{n}(level, grp, idx, h, n) AS ({base}
  UNION ALL SELECT level + 1, grp, idx // 16, sha256(string_agg(h, '' ORDER BY idx)), (any_value(n) + 15) // 16 FROM {n} WHERE n > 1 GROUP BY level, grp, idx // 16),
{n}_side AS (SELECT level, grp, idx, coalesce(string_agg(h, '') OVER (PARTITION BY level, grp, idx // 16 ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
  coalesce(string_agg(h, '') OVER (PARTITION BY level, grp, idx // 16 ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {n} WHERE n > 1)"""
_LEAF = "sha256(" + " || ".join(f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || {c}, '-')" for c in ("doc_id", "source", "lang", "n_chars", "{text}")) + ")"
_CAPS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

#: crc32 has no DuckDB function: ``k`` runs over the id's characters, the inner list over the bits of each.
SQL["op13_merkle_manifest"] = f"""
WITH RECURSIVE c(doc_id, s, k, c) AS (SELECT DISTINCT doc_id, CAST(doc_id AS VARCHAR), 0, 4294967295::BIGINT FROM documents WHERE doc_id IS NOT NULL
  UNION ALL SELECT doc_id, s, k + 1, list_reduce(range(8), lambda a, i: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384::BIGINT) ELSE a // 2 END, xor(c, ascii(substr(s, k + 1, 1))::BIGINT)) FROM c WHERE k < length(s)),
hit AS (SELECT doc_id, xor(c, 4294967295) % 5 = 0 AS hit FROM c WHERE k = length(s)),
d AS (SELECT doc_id, coalesce('1' || source, '0') AS grp, {_LEAF.format(text="text")} AS leaf, CASE WHEN hit THEN {_LEAF.format(text=f"translate(text, {_CAPS})")} END AS changed FROM documents LEFT JOIN hit USING (doc_id)),
p AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY grp) AS n FROM d),
{_TREE.format(n="t", base="SELECT 0, grp, idx, leaf, n FROM p")},
g AS (SELECT grp, h, level, row_number() OVER (ORDER BY grp) - 1 AS idx, count(*) OVER () AS n FROM t WHERE n = 1),
{_TREE.format(n="u", base="SELECT 0, 0, idx, h, n FROM g")},
f(doc_id, leaf, grp, idx, level, acc, proof) AS (SELECT doc_id, leaf, grp, idx, 0, coalesce(changed, leaf), '' FROM p
  UNION ALL SELECT f.doc_id, leaf, f.grp, f.idx // 16, f.level + 1, sha256(l || acc || r), proof || l || r FROM f JOIN t_side s ON s.grp = f.grp AND s.level = f.level AND s.idx = f.idx),
v(doc_id, leaf, grp, subroot, idx, level, acc, proof) AS (SELECT f.doc_id, leaf, f.grp, g.h, g.idx, 0, acc, proof FROM f JOIN g ON g.grp = f.grp AND g.level = f.level
  UNION ALL SELECT v.doc_id, leaf, v.grp, subroot, v.idx // 16, v.level + 1, sha256(l || acc || r), proof || l || r FROM v JOIN u_side s ON s.level = v.level AND s.idx = v.idx),
top AS (SELECT level, h FROM u WHERE n = 1)
SELECT doc_id, leaf, subroot, top.h AS root, sha256(proof) AS proof_sha256, acc AS folded_root, acc = top.h AS verified FROM v JOIN top ON v.level = top.level
"""

#: Components by their least member, as in op3; the vectors of the tables are all of one length.
SQL["op12_embedding_near_dedup"] = """
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.95),
r AS (SELECT vec_id AS id, vec_id AS m FROM embeddings UNION SELECT r.id, l.b FROM r JOIN l ON r.m = l.a),
c AS (SELECT id, min(m) AS component_id FROM r GROUP BY 1),
n AS (SELECT a, count(*) AS n FROM l GROUP BY 1)
SELECT e.vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN c ON c.id = e.vec_id LEFT JOIN n ON n.a = e.vec_id
"""
