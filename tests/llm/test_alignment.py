"""Tokens of two tokenizers against a plain walk over their bytes."""

import hashlib
import random
from collections import Counter

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from inkstream.llm import alignment  # noqa: E402
from inkstream.llm.packing import byte_alphabet  # noqa: E402

from .corpus import prose  # noqa: E402

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", " ", "a<|endoftext|>b<s> </s><0x41>", "▁x", "日本語のテキスト🙂🙂 naïve", "a\x00b", "  two  spaces\n\n\ttabs ", "x" * 5000, "日本" * 3000, "éé", "﻿bom"]


def side(ids, spelled):
    ends, n = [], 0
    for i in ids:
        n += len(spelled(i))
        ends.append(n)
    return ids, ends, b"".join(map(spelled, ids))


def plain(texts):
    """Rows as the contract words them: every group, every pair of places."""
    import sentencepiece
    from tokenizers import Tokenizer

    t, s, letters = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B), byte_alphabet()
    t.encode_special_tokens = True
    rows, held = [], Counter()
    for text in texts:
        groups, links, n = [], Counter(), (0, 0)
        if text:
            a, a_ends, a_bytes = side(t.encode(" " + text, add_special_tokens=False).ids, lambda i: bytes(letters[c] for c in t.id_to_token(i)))
            b, b_ends, b_bytes = side(s.encode(text), lambda i: bytes([int(s.id_to_piece(i)[3:5], 16)]) if s.is_byte(i) else s.id_to_piece(i).replace("▁", " ").encode())
            if a_bytes == b_bytes == (" " + text).encode():
                n, low = (len(a), len(b)), 0
                for cut in sorted(set(a_ends) & set(b_ends)):
                    groups.append(([i for i, e in zip(a, a_ends) if low < e <= cut], [i for i, e in zip(b, b_ends) if low < e <= cut]))
                    low = cut
        for x, y in groups:
            cx, cy = Counter(x), Counter(y)
            links.update({(i, j): p * q for i, p in cx.items() for j, q in cy.items()})
        held.update(links.keys())
        rows.append((n, groups, links))
    most = Counter()
    for (i, _), c in held.items():
        most[i] = max(most[i], c)
    for n, groups, links in rows:
        written = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        best = sum(c for (i, j), c in links.items() if held[i, j] == most[i])
        yield (*n, len(groups), sum(links.values()), best, sum(c * held[p] for p, c in links.items()), hashlib.sha256(written.encode()).hexdigest() if written else "")


def values(r):
    return (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256)


def test_every_row_equals_a_plain_walk(spark):
    rng = random.Random(4)
    texts = ODD + [prose(k, 6) for k in range(20)] + [prose(3, 6)] * 5 + ["".join(rng.choice("aé日 \n'.0Z🙂") for _ in range(rng.randint(1, 80))) for _ in range(120)]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], "doc_id long, text string, chunk int, pair string").repartition(3)
    want = list(plain(texts))
    for chunk in (alignment.CHUNK_BYTES, 2000):
        got = {r.doc_id: values(r) for r in alignment.align(docs, A, B, chunk_bytes=chunk).collect()}
        assert [got[i] for i in range(len(texts))] == want


def test_rows_that_repeat_or_have_no_id(spark):
    rows = [(1, "One text."), (1, "One text."), (1, "Another."), (None, "One text.")]
    got = sorted((r.doc_id is None, r.doc_id, values(r)) for r in alignment.align(spark.createDataFrame(rows, "doc_id long, text string"), A, B).collect())
    assert sorted(v for _, _, v in got) == sorted(plain([t for _, t in rows]))
    assert len(got) == 4 and sum(x for x, _, _ in got) == 1


def test_empty_table_and_very_long_text(spark):
    assert alignment.align(spark.createDataFrame([], "doc_id long, text string"), A, B).count() == 0
    long = prose(9, 12) * 4000
    r = alignment.align(spark.createDataFrame([(1, long), (2, "short")], "doc_id long, text string"), A, B).filter("doc_id = 1").first()
    assert len(long) > 2 * alignment.SLICE_BYTES and r.n_a > 100_000 and r.n_groups > 100_000 and r.n_links >= r.n_groups


def test_groups_as_text(spark):
    docs = spark.createDataFrame([(1, "Hello there, naïve world"), (2, "")], "doc_id long, text string")
    groups = {r.doc_id: r.groups for r in alignment.aligned(docs, A, B).collect()}
    sha = {r.doc_id: r.groups_sha256 for r in alignment.align(docs, A, B).collect()}
    assert groups[2] is None and sha[2] == "" and hashlib.sha256(groups[1].encode()).hexdigest() == sha[1]
