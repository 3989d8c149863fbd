"""Rows that repeat an id, and archives however they are split."""

import gzip

import numpy as np
import pytest

from inkstream.llm import sentence_spans, vptree, warc

from . import corpus as K


def test_equal_vectors_under_one_repeated_id(spark):
    rng = np.random.default_rng(1)
    same, rest = [1.0, 2.0, 3.0], rng.normal(size=(200, 3)).tolist()
    rows = [(20, same)] * 30 + [(41, same), (43, same)] + [(100 + k, v) for k, v in enumerate(rest) if (100 + k) % 20]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r["rank"], r.vec_id) for r in vptree.nearest(df, lambda i: i % 20 == 0, factor=1.0).filter("query_id = 20").collect())
    score = {i: float(np.dot(same, v)) for i, v in rows if i != 20}
    assert [i for _, i in got] == sorted(score, key=lambda i: (-score[i], i))[:20]
    # of rows that repeat a candidate's id, each is a candidate
    rows = [(20, same)] + [(5, same)] * 30 + [(7, [0.5, 1.0, 1.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert [r.vec_id for r in vptree.nearest(df, lambda i: i % 20 == 0).collect()] == [5] * 20


def embedded(n):
    inner = b"".join(b"WARC/1.0\r\nWARC-Type: resource\r\nContent-Length: %d\r\n\r\n" % len(x) + x + b"\r\n\r\n" for x in (b"part %d of a block" % k * 9 for k in range(45)))
    for k in range(n):
        block = b"%d\r\n\r\n" % k + inner
        yield b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <r%d>\r\nContent-Length: %d\r\n\r\n" % (k, len(block)) + block + b"\r\n\r\n"


@pytest.mark.parametrize("split", ["128m", "40k", "3k"])
def test_records_do_not_depend_on_splits(spark, tmp_path, split):
    records = list(embedded(20))
    (tmp_path / "a.warc").write_bytes(b"".join(records))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in records))
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        got = warc.read_warc(spark, str(tmp_path)).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted((r.record_id, bytes(r.block)) for r in got) == sorted((r["record_id"], r["block"]) for r in list(warc.parse(b"".join(records))) * 2)
    assert {r.warc_type for r in got} == {"response"} and len(got) == 40 and not any(r.headers for r in got)


def test_other_line_ends_and_junk_are_told(spark, tmp_path):
    two = b"WARC/1.0\nWARC-Type: response\nContent-Length: 5\n\nhello\n\nWARC/1.0\nWARC-Type: metadata\nContent-Length: 2\n\nok\n\n"
    (tmp_path / "lf.warc").write_bytes(two)
    (tmp_path / "mixed.warc").write_bytes(b"\x00garbage\r\nmore\r\n" + two + b"WARC/1.1\r\nWARC-Type: resource\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" + b"not a record\n")
    got = sorted(((r.warc_type, bytes(r.block)) for r in warc.read_warc(spark, str(tmp_path)).collect()))
    assert got == [("metadata", b"ok")] * 2 + [("resource", b"abc")] + [("response", b"hello")] * 2 + [("unreadable", b"\x00garbage\r\nmore\r\n"), ("unreadable", b"not a record\n")]
    assert [r["warc_type"] for r in warc.parse(two)] == ["response", "metadata"]


def test_cuts_of_a_repeated_id_are_held_once(spark):
    passage, own = K.prose(31, 25), K.prose(32, 25)
    rows = [(1, passage)] + [(2, own + " " + passage)] * 400
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    cuts = {r.doc: r.cuts for r in sentence_spans.repeated(docs).collect()}
    assert set(cuts) == {2} and len(cuts[2]) == len(set(cuts[2])) < 60
    out = sentence_spans.remove_repeats(docs).collect()
    assert len(out) == 401 and {r.text.strip() for r in out if r.doc_id == 2} == {own} and {r.text for r in out if r.doc_id == 1} == {passage}
