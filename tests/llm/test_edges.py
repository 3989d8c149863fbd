"""Every operator on tables that are empty, rows with clashing columns, and one very long text; the pipeline against brute force."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from inkstream.llm import alignment, decontam, langid, licences, manifest, near_dup, packing, pivots, sentence_spans, suffix_dedup, toxicity, vptree, warc

from . import corpus as K
from .test_duplicates import brute_components, brute_cuts
from .test_search import brute_hits

public_tokenizers = pytest.importorskip("public_tokenizers")
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
#: Names that operators use inside.
CLASH = ["id", "words", "h", "row", "spans", "items", "shard", "v", "dim", "cuts", "span", "doc", "node", "leaf", "chunk", "held_out", "score", "one", "bucket", "language", "kept", "text_"]


def on_texts(spark):
    """Each operator as a function of documents whose result has a row for each row."""
    labels = spark.createDataFrame([(k, k % 2) for k in range(1, 20)], "doc_id long, toxic int")
    items = spark.createDataFrame([(1, K.prose(50, 3))], "item_id long, text string")
    return {
        "op1": lambda d: toxicity.score(d, toxicity.fit(d, labels)),
        "op2": lambda d: langid.predict(d, langid.fit(d)),
        "op3": near_dup.near_duplicates,
        "op4": sentence_spans.remove_repeats,
        "op6": lambda d: decontam.report(decontam.contamination(d, items)),
        "op7": lambda d: licences.scan(d, licences.fit(d)),
        "op8": lambda d: suffix_dedup.report(suffix_dedup.remove_repeated_strings(d)),
        "op11": lambda d: alignment.align(d, A, B),
        "op13": manifest.manifest,
    }


OPS = ["op1", "op2", "op3", "op4", "op6", "op7", "op8", "op11", "op13"]


def clashing(docs):
    return docs.withColumns({c: F.lit(f"clash {c}") for c in CLASH if c not in docs.columns})


def rows_of(frame):
    return sorted(map(str, frame.collect()))


@pytest.mark.parametrize("op", OPS)
def test_empty_tables_and_clashing_columns(spark, op):
    run = on_texts(spark)[op]
    docs = spark.createDataFrame([(i, t, "xx", "s", len(t or "")) for i, t in K.corpus()[:18]], "doc_id long, text string, lang string, source string, n_chars long")
    assert rows_of(run(docs.filter("false"))) == []
    plain, more = run(docs), run(clashing(docs))
    assert more.columns == plain.columns and rows_of(more) == rows_of(plain) and len(rows_of(plain)) == docs.count()


@pytest.mark.parametrize("op", OPS)
def test_one_very_long_text(spark, op):
    rng = random.Random(1)
    long = " ".join(rng.choice(K.WORDS) + str(rng.randrange(5000)) for _ in range(300_000)) + "."
    docs = spark.createDataFrame([(1, long, "xx", "s", len(long)), (2, "A short one.", "xx", "s", 12), (3, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r for r in on_texts(spark)[op](docs).collect()}
    assert len(long) > 2_900_000 and set(got) == {1, 2, 3}
    if op == "op13":
        head = "".join(f"{len(str(v).encode())}:{v}" for v in (1, "s", "xx", len(long), long))
        assert got[1].leaf == hashlib.sha256(head.encode()).hexdigest()
    if op == "op6":
        assert got[1].n_words == 300_000
    if op == "op8":
        assert got[1].n_bytes == len(long)


def test_packing_and_archives(spark):
    long = "word " * 400_000
    docs = clashing(spark.createDataFrame([(1, long), (2, None)], "doc_id long, text string"))
    got = packing.pack(packing.token_pieces(docs, A)).collect()
    assert sum(r.length for r in got if r.doc_id == 1) > 400_000 and [r.length for r in got if r.doc_id == 2] == [1]
    pages = spark.createDataFrame([(1, "http://a/", "<p>" + long)], "page_id long, url string, html string")
    made = warc.derive(warc.responses(clashing(pages))).collect()
    assert len(made) == 2 and max(len(r.block) for r in made) > 1_900_000
    assert warc.responses(pages.filter("false")).count() == 0


def test_vectors(spark):
    rng = random.Random(2)
    rows = [(k, [rng.gauss(0, 1) for _ in range(8)]) for k in range(60)]
    plain = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for run in (lambda d: vptree.nearest(d, lambda i: i % 20 == 0), pivots.near_vectors):
        assert rows_of(run(clashing(plain))) == rows_of(run(plain)) and rows_of(run(plain.filter("false"))) == []
    assert vptree.nearest(plain.filter("vec_id % 20 != 0"), lambda i: i % 20 == 0).count() == 0


def test_pipeline_equals_brute_force(spark, tmp_path):
    """Stage by stage, what the stage before has kept goes into a plain version of the next one."""
    passage, item = K.prose(70, 9), K.prose(71, 3)
    rows = [r for r in K.corpus() if r[0] is not None and r[0] != 3] + [(60 + k, K.prose(800 + k, 8)) for k in range(8)]
    rows += [(80, K.prose(820, 4) + " " + passage), (81, passage + " " + K.prose(821, 4)), (82, item + " few words"), (83, K.prose(822, 90) + " " + item), (84, "1 2 3 !?"), (85, K.prose(800, 8) + " more")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stages, texts = dict(corpus_pipeline.STAGES), dict(rows)
    left = spark.read.parquet(f"{tmp_path}/documents.parquet")

    def after(name):
        kept = spark.createDataFrame(stages[name](spark, left, str(tmp_path)).toPandas(), docs.schema)
        return kept, {r.doc_id: r.text for r in kept.collect()}

    left, got = after("language_id")
    texts = {i: t for i, t in texts.items() if any(c.isalpha() for c in t or "")}
    assert got == texts
    left, got = after("near_dedup")
    texts = {i: texts[i] for i, _, c in brute_components(sorted(texts.items())) if i == c}
    assert got == texts
    cuts = brute_cuts(sorted(texts.items()))
    left, got = after("substring_dedup")
    assert set(got) == {i for i, (n, gone) in cuts.items() if gone == 0 or gone < n}
    assert all((got[i] == texts[i]) == (cuts[i][1] == 0) for i in got) and any(cuts[i][1] for i in got)
    texts = got
    left, got = after("decontamination")
    assert got == {r[0]: texts[r[0]] for r in brute_hits(sorted(texts.items()), [(1, item)]) if not r[5]} and 82 not in got and 83 in got
    pieces = stages["packing"](spark, left, str(tmp_path)).collect()
    alone = packing.token_pieces(left, A).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in pieces) == sorted(map(tuple, alone))
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in whole) == sorted(map(tuple, alone))
    places = {}
    for r in whole:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(sum(n for _, n in p) <= 1024 and sorted(p)[0][0] == 0 for p in places.values())
    assert len(places) <= -(-sum(r.length for r in whole) // 1024) + 2
