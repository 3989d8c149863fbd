import gzip
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from inkstream.llm import decontam, packing, vptree, warc

from . import corpus as K


def words_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute_hits(docs, items):
    windows = []
    for i, t in items:
        w = words_of(t)
        m = min(13, len(w))
        windows += [(str(i), tuple(w[k : k + m])) for k in range(len(w) - m + 1) if m and i is not None]
    out = []
    for i, t in docs:
        w, hit, found = words_of(t), set(), set()
        for item, p in windows:
            for k in range(len(w) - len(p) + 1):
                if tuple(w[k : k + len(p)]) == p:
                    hit.update(range(k, k + len(p)))
                    found.add(item)
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


ITEMS = [(1, K.prose(50, 3)), (2, K.prose(51, 2)), (10, "Cedar, delta-fjord!"), (3, None), (4, ""), (None, "amber basil"), (5, K.prose(50, 3)), (6, "ÉTÉ à Noël 42")]


def contaminated_docs():
    rows = K.corpus()
    rows += [(40, K.prose(9, 8) + " " + K.prose(50, 3).upper() + " " + K.prose(10, 60)), (41, "x cedar delta fjord y"), (42, K.prose(51, 2)), (43, " ".join(K.prose(50, 3).split()[:12])), (44, "été à noël 42 Été à noël 42"), (45, "cedar\x00delta\tfjord cedar delta")]
    return rows


@pytest.mark.parametrize("block", [1 << 20, 150])
def test_contamination_equals_brute_force(spark, block):
    rows = [r for r in contaminated_docs() if r[0] != 3] + [(3, "cedar delta fjord")]
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = [tuple(r) for r in decontam.report(decontam.contamination(K.docs(spark, rows), items, block_bytes=block)).collect()]
    assert sorted(got, key=str) == sorted(brute_hits(rows, ITEMS), key=str)


def test_contaminated_rows_go(spark):
    rows = contaminated_docs()
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    want = sorted((str(r[0]) for r in brute_hits(rows, ITEMS) if not r[5]))
    for block in (1 << 20,):
        kept = decontam.drop_contaminated(K.docs(spark, rows), items, block_bytes=block)
        assert sorted(str(r.doc_id) for r in kept.collect()) == want and kept.columns == K.docs(spark, []).columns
    assert decontam.drop_contaminated(K.docs(spark, rows), items.filter("false")).count() == len(rows)
    assert decontam.contamination(K.docs(spark, []), items).count() == 0


def test_repeated_and_null_ids_in_several_blocks(spark):
    rows = contaminated_docs() + [(3, "cedar delta fjord"), (40, K.prose(77, 5)), (None, "x cedar delta fjord y"), (None, K.prose(51, 2)), (None, None), (41, "x cedar delta fjord y")]
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    want = sorted(brute_hits(rows, ITEMS), key=str)
    for block in (1 << 20, 150):
        got = [tuple(r) for r in decontam.report(decontam.contamination(K.docs(spark, rows), items, block_bytes=block)).collect()]
        assert sorted(got, key=str) == want
        kept = decontam.drop_contaminated(K.docs(spark, rows), items, block_bytes=block)
        assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r[0]) for r in want if not r[5]) and kept.columns == K.docs(spark, []).columns


def test_search_finds_every_occurrence():
    rng = random.Random(2)
    for m in (1, 2, 3, 5, 13):
        items = [(f"i{k:02d}", " ".join(rng.choice("abcd") for _ in range(m + k % 3))) for k in range(20)]
        block = decontam.Block.build(items, m)
        texts = [" ".join(rng.choice("abcd") for _ in range(n)) for n in (700, 0, 5, 2295)]
        words = decontam.Words.of_column(decontam.pa.array(texts, type=decontam.pa.large_string()))
        inside, found = block.find(words)
        for r, text in enumerate(texts):
            w, hit, ids = text.split(), set(), set()
            for name, t in items:
                for p in {tuple(t.split()[k : k + m]) for k in range(len(t.split()) - m + 1)}:
                    at = [s for s in range(len(w) - m + 1) if tuple(w[s : s + m]) == p]
                    hit.update(x for s in at for x in range(s, s + m))
                    ids |= {name} if at else set()
            assert set(np.flatnonzero(inside[words.first[r] : words.first[r + 1]]).tolist()) == hit and found[r] == ids


def test_words_of_one_hash_are_compared():
    text = decontam.Words.of_column(decontam.pa.array(["one two three"], type=decontam.pa.large_string()))
    block = decontam.Block.build([("x", "one two four")], 3)
    block.tables = [decontam.Tables.build(text.hashes, np.array([0]), np.array([0]), 3)]
    assert len(block.tables[0].search(text.hashes, text.first)[0]) == 1
    inside, found = block.find(text)
    assert not inside.any() and found == [set()]


def test_one_very_long_text_is_searched_whole(spark):
    long = "Cedar delta. " + "lorem ipsum " * 300_000 + K.prose(51, 2)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    row = decontam.report(decontam.contamination(K.docs(spark, [(1, long)]), items)).first()
    assert row.n_words == 600_002 + len(words_of(K.prose(51, 2))) and row.n_items == 1 and not row.contaminated


def test_cut_covers_a_document():
    for n in (1, 5, 7, 8, 9, 16, 17, 100):
        parts = packing.cut(n, 8)
        assert sum(x for _, x in parts) == n and all(x == 8 for _, x in parts[1:]) and [s for s, _ in parts] == list(np.cumsum([0] + [x for _, x in parts])[:-1])
        assert len(parts) == -(-n // 8)


def test_best_fit_respects_every_capacity():
    rng = np.random.default_rng(0)
    lengths = rng.integers(1, 1025, 3000)
    bins, offsets = packing.best_fit(lengths, (1024.0, 6.0, 500_000.0 + 1024**2 * 0.6))
    for b in np.unique(bins):
        own = np.flatnonzero(bins == b)
        order = own[np.argsort(offsets[own])]
        assert lengths[own].sum() <= 1024 and len(own) <= 6 and (lengths[own].astype(float) ** 2).sum() <= 500_000 + 1024**2 * 0.6
        assert offsets[order].tolist() == [0, *np.cumsum(lengths[order])[:-1].tolist()]
    free, _ = packing.best_fit(lengths, (1024.0, 1024.0, 1024.0**2))
    assert free.max() + 1 <= 1.03 * -(-lengths.sum() // 1024)


def test_packing_covers_all_ids(spark):
    tokenizers = pytest.importorskip("tokenizers")
    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    rows = K.corpus() + [(60, K.prose(60, 400)), (61, "  tabs\tand\n\nlines  <|endoftext|> 12345 it's naïve 東京 😀"), (62, "a<|endoftext|>b<|endoftext|><|endoftext|>  <|endoftext"), (63, "<|endoftext|>")]
    got = packing.pack(packing.token_pieces(K.docs(spark, rows), path, keep_ids=True), shard_pieces=20).collect()
    t = tokenizers.Tokenizer.from_file(path)
    want = sorted((str(i), [*t.encode(x or "", add_special_tokens=False).ids, 2]) for i, x in rows)
    by = {}
    for r in sorted(got, key=lambda r: (str(r.doc_id), r.piece)):
        assert len(r.ids) == r.length <= 1024 and r.ids_crc32 == zlib.crc32(np.array(r.ids, dtype="<u4").tobytes())
        by.setdefault(str(r.doc_id), []).extend(r.ids)
    # repeated rows come piece by piece, so they are compared as multisets of ids
    assert sorted((k, sorted(v)) for k, v in by.items()) == sorted((k, sorted(sum((v for j, v in want if j == k), []))) for k in {j for j, _ in want})
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for p in places.values():
        p.sort()
        assert sum(n for _, n in p) <= 1024 and [s for s, _ in p] == list(np.cumsum([0] + [n for _, n in p])[:-1])
    assert packing.pack(packing.token_pieces(K.docs(spark, []), path)).count() == 0


def test_packing_under_document_and_attention_bounds(spark):
    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    rows = K.corpus() + [(None, None)] * 200 + [(70 + k, K.prose(70 + k, 20 + 9 * k)) for k in range(12)]
    pieces = packing.token_pieces(K.docs(spark, rows), path)
    got = packing.pack(pieces, documents=5, attention=1_100_000.0, shard_pieces=64).collect()
    assert len(got) == pieces.count()
    places, shards = {}, set()
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
        if r.doc_id is None and r.length == 1:
            shards.add(r.sequence_id >> 32)
    for p in places.values():
        p.sort()
        assert len(p) <= 5 and sum(n for _, n in p) <= 1024 and sum(n * n for _, n in p) <= 1_100_000
        assert [s for s, _ in p] == list(np.cumsum([0] + [n for _, n in p])[:-1])
    assert max(map(len, places.values())) == 5 and len(shards) > 1
    # plain best fit: no piece fits a sequence that was open before its own
    lengths = np.array(sorted((r.length for r in got), reverse=True))
    bins, _ = packing.best_fit(lengths, (1024.0, 5.0, 1_100_000.0))
    left = {}
    for n, b in zip(lengths.tolist(), bins.tolist()):
        if b not in left:
            assert not any(t >= n and d >= 1 and a >= n * n for t, d, a in left.values())
        t, d, a = left.get(b, (1024, 5, 1_100_000))
        left[b] = (t - n, d - 1, a - n * n)


def test_other_tokenizer_files_use_their_own_library():
    path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    assert packing._fast(__import__("json").load(open(path, encoding="utf-8"))) is None
    assert packing.encoder(path)(["Hello there"])[0]


def vectors(n, seed=0, dim=12):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(6, dim))
    return (middle[rng.integers(0, 6, n)] + 0.4 * rng.normal(size=(n, dim))).astype(np.float32)


def brute_nearest(ids, x, k=20):
    out = {}
    for i, v in zip(ids, x.astype(float)):
        if i % 20 == 0:
            score = [(-float((v * w).sum()), j) for j, w in zip(ids, x.astype(float)) if j != i]
            out[i] = sorted(score)[:k]
    return out


def test_nearest_neighbours_are_exact_with_factor_one(spark):
    x = vectors(700)
    x[300:420] = x[300]
    rows = [(i, [float(c) for c in v], i) for i, v in enumerate(x)]
    odd = [(1000, None, 0), (1020, [0.0] * 12, 0), (1040, [float("nan")] + [1.0] * 11, 0), (1060, [float("inf")] * 12, 0), (None, [1.0] * 12, 0), (1080, [1.0] * 3, 0)]
    odd += [(1100, [None] + [1.0] * 11, 0)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, id int")
    want = brute_nearest(list(range(700)), x)
    got = {}
    for r in vptree.nearest(df, lambda i: i % 20 == 0, factor=1.0, shard_rows=150).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == set(want)
    for q, found in got.items():
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, 21))
        assert [v for _, v, _ in found] == [v for _, v in want[q]]
        assert np.allclose([s for _, _, s in found], [-s for s, _ in want[q]], atol=1e-9)


def test_relaxed_pruning_keeps_its_recall(spark):
    x = vectors(3000, seed=2)
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    want = brute_nearest(list(range(3000)), x)
    got = {}
    for r in vptree.nearest(df, lambda i: i % 20 == 0, shard_rows=1000).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert np.mean([len(got[q] & {v for _, v in want[q]}) / 20 for q in want]) >= 0.9
    few = vptree.nearest(df.filter("vec_id < 5"), lambda i: i % 20 == 0).collect()
    assert sorted(r.rank for r in few) == [1, 2, 3, 4]
    assert vptree.nearest(df.filter("false"), lambda i: i % 20 == 0).count() == 0


def test_warc_derivatives_round_trip(spark, tmp_path):
    pages = [
        (1, "http://a.example/x?y=1", '<html lang="de"><head><title>A &amp; B</title><script>var x = "</p>";</script></head><body><p>One<br>two</p><div>three &lt;four&gt; <b>fi</b>ve</div><a href="/z?a=1&amp;b=2">six</a><!-- no --></body></html>'),
        (2, None, None),
        (3, "http://b.example/", ""),
        (3, "http://b.example/", ""),
        (4, "http://c.example/", "<p>unclosed <b>bold" + " long" * 20000 + "<script>never closed"),
    ]
    df = spark.createDataFrame([(*p, "clash") for p in pages], "page_id long, url string, html string, block string")
    source = warc.responses(df)
    rows = [r.asDict() for r in warc.derive(source).collect()]
    assert len(rows) == 2 * len(pages)
    responses = {r.record_id: r for r in source.collect()}
    for r in rows:
        origin = responses[r["refers_to"]]
        assert r["target_uri"] == r["refers_to_target_uri"] == origin.target_uri and r["date"] == origin.date and r["block_digest"] == warc.digest(bytes(r["block"]))
        assert origin.payload_digest in (bytes(r["block"]).decode() if r["warc_type"] == "metadata" else r["headers"]["WARC-Source-Payload-Digest"])
    one = {r["warc_type"]: bytes(r["block"]).decode() for r in rows if r["headers"]["WARC-Page-Id"] == "1"}
    assert one["conversion"] == "One two\nthree <four> five\nsix".replace("One two", "One\ntwo")
    assert "title: A & B" in one["metadata"] and "outlink: /z?a=1&b=2" in one["metadata"] and "language: de" in one["metadata"] and "http-content-type: text/html; charset=utf-8" in one["metadata"]
    members = [bytes(r.member) for r in warc.encode(warc.derive(source)).collect()]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(members))
    (tmp_path / "b.warc").write_bytes(b"".join(gzip.decompress(m) for m in members))
    again = [r.asDict() for r in warc.read_warc(spark, str(tmp_path)).collect()]
    key = lambda r: (r["record_id"], bytes(r["block"]))
    assert sorted(again, key=key) == sorted(rows * 2, key=key)
    assert warc.derive(source.filter("false")).count() == 0


def crawled(body, *fields, head=b"HTTP/1.1 200 OK"):
    block = head + b"".join(b"\r\n" + f for f in fields) + b"\r\n\r\n" + body
    record = dict.fromkeys(warc._COLUMNS) | {"warc_type": "response", "record_id": warc.name_of("r", body, *fields), "headers": {}, "block": block, "block_digest": warc.digest(block), "payload_digest": warc.digest(body)}
    made = {r["warc_type"]: bytes(r["block"]).decode() for r in warc.derivatives(record)}
    return made["metadata"], made["conversion"]


@pytest.mark.parametrize("charset", ["undefined", "idna", "punycode", "rot13", "hex", "base64", "unicode_escape", "no-such", "utf-7", "mbcs", "raw_unicode_escape"])
def test_charsets_that_are_none_do_not_end_the_job(charset):
    meta, text = crawled("<p>été \\ud800 x</p>".encode(), b"Content-Type: text/html; charset=" + charset.encode())
    assert "t" in text and f"charset={charset}" in meta


def test_codings_and_repeated_headers_of_real_responses():
    page = "<p>Grüße aus Köln</p>" * 50
    deflated = __import__("zlib").compress(page.encode())
    chunks = lambda b: b"".join(b"%x;ext=1\r\n" % len(b[i : i + 300]) + b[i : i + 300] + b"\r\n" for i in range(0, len(b), 300)) + b"0\r\n\r\n"
    plain = crawled(page.encode())[1]
    assert plain.count("Grüße aus Köln") == 50
    for body, fields in [
        (gzip.compress(page.encode()), [b"Content-Encoding: gzip"]),
        (chunks(page.encode()), [b"Transfer-Encoding: chunked"]),
        (chunks(gzip.compress(page.encode())), [b"Transfer-Encoding: chunked", b"Content-Encoding: gzip"]),
        (deflated, [b"content-encoding: DEFLATE"]),
        (deflated[2:-4], [b"content-encoding: deflate"]),
        (page.encode(), [b"Transfer-Encoding: chunked", b"Content-Encoding: gzip"]),
        (page.encode("latin-1"), [b"Content-Type: text/html; charset=ISO-8859-1"]),
    ]:
        assert crawled(body, *fields)[1] == plain
    assert plain.startswith(crawled(gzip.compress(page.encode())[:40], b"Content-Encoding: gzip")[1])
    meta, _ = crawled(b"x", b"Set-Cookie: a=1", b"Set-Cookie: b=2", b"X-Odd: \xff\xfe", b"X-Long: one", b"  two")
    assert [x for x in meta.split("\r\n") if x.startswith("http-")] == ["http-set-cookie: a=1", "http-set-cookie: b=2", "http-x-odd: ÿþ", "http-x-long: one two"]
    assert crawled(b"no headers at all", head=b"")[1].endswith("no headers at all")


def test_captures_of_one_address_have_ids_of_their_own(spark):
    df = spark.createDataFrame([(1, "http://a/", "x"), (1, "http://a/", "y"), (1, "http://a/", "x")], "page_id long, url string, html string")
    assert len({r.record_id for r in warc.responses(df).collect()}) == 2


def test_files_are_read_record_by_record(spark, tmp_path):
    inner = b"WARC/1.0\r\nWARC-Type: resource\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.0\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
    records = [
        b"WARC/1.1\r\nWARC-Type: warcinfo\r\nContent-Length: 0\r\n\r\n\r\n\r\n",
        b"WARC/1.0\r\nWARC-Type: response\r\nX-Odd: \xff\r\nWARC-Concurrent-To: <a>\r\nWARC-Concurrent-To: <b>\r\nContent-Length: 4\r\n\r\n\xff\xfe\r\n\r\n\r\n",
        b"WARC/1.0\r\nWARC-Type: resource\r\nContent-Length: %d\r\n\r\n" % len(inner) + inner + b"\r\n\r\n",
        b"WARC/1.0\r\nWARC-Type: metadata\r\nContent-Length: 9\r\n\r\nshort",
    ]
    (tmp_path / "a.warc").write_bytes(b"".join(records))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in records))
    (tmp_path / "c.warc").write_bytes(b"")
    got = sorted(warc.read_warc(spark, str(tmp_path)).collect(), key=lambda r: r.warc_type)
    assert [r.warc_type for r in got] == ["metadata", "metadata", "resource", "resource", "response", "response", "warcinfo", "warcinfo"]
    assert [bytes(r.block) for r in got] == [b"short"] * 2 + [inner] * 2 + [b"\xff\xfe\r\n"] * 2 + [b""] * 2
    assert got[0].headers == {"WARC-Truncated": "length"} and got[4].headers == {"X-Odd": "ÿ", "WARC-Concurrent-To": "<a>, <b>"}
    assert [bytes(r["block"]) for r in warc.parse(b"".join(records))] == [b"", b"\xff\xfe\r\n", inner, b"short"]


def test_pipeline_keeps_clean_documents(spark, tmp_path):
    clean = [(100 + k, K.prose(700 + k, 12)) for k in range(15)]
    shared = K.prose(90, 9)
    rows = clean + [(1, clean[0][1]), (200, clean[1][1] + " extra"), (201, "12 34 !!"), (202, K.prose(50, 3) + " more"), (203, shared + " " + K.prose(91, 6)), (204, K.prose(92, 6) + " " + shared)]
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, K.prose(50, 3))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    left = docs
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = spark.createDataFrame(stage(spark, left, str(tmp_path)).toPandas(), docs.schema)
        seen[name] = {r.doc_id for r in left.collect()}
        assert left.columns == docs.columns
    everything = {i for i, _ in rows}
    assert seen["language_id"] == everything - {201}
    assert seen["near_dedup"] == everything - {201, 100, 200}
    assert seen["decontamination"] == everything - {201, 100, 200, 202}
    texts = {r.doc_id: r.text for r in left.collect()}
    assert shared in texts[203] and shared[40:-40] not in texts[204]
    assert all(texts[i] == t for i, t in clean if i != 100)
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} == seen["decontamination"]
