import hashlib
import random
import re

import numpy as np
import pytest

from inkstream.llm import components, lyndon, near_dup, sentence_spans, store, suffix_dedup

from . import corpus as K


def shingles(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)])


def brute_components(rows):
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if s and t and 100 * len(s & t) >= 75 * len(s | t):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return {(i, len(s), find(i)) for i, s in sets}


def test_near_duplicates_equal_brute_force(spark):
    rows = K.corpus()
    got = near_dup.near_duplicates(K.docs(spark, rows)).collect()
    assert len(got) == len(rows)
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == brute_components(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got if r.doc_id is not None)
    assert [r.kept for r in got if r.doc_id is None] == [True]


@pytest.mark.parametrize("block", [2, 5])
def test_near_duplicates_do_not_depend_on_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(near_dup, "KEY_BLOCK", block)
    monkeypatch.setattr(near_dup, "CLUSTER_BLOCK", block)
    rows = [r for r in K.corpus() if r[0] is not None]
    got = near_dup.near_duplicates(K.docs(spark, rows)).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == brute_components(rows)


def test_near_duplicates_of_nothing(spark):
    assert near_dup.near_duplicates(K.docs(spark, [])).count() == 0
    kept = near_dup.drop_near_duplicates(K.docs(spark, [(1, "a b c d e f"), (2, "A b c d e f"), (3, None)]))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3]
    assert kept.columns == K.docs(spark, []).columns


def test_texts_under_one_id_are_told_apart(spark):
    a, b, c = K.prose(31, 6), K.prose(32, 6), K.prose(33, 6)
    rows = [(1, a), (5, a), (5, b), (5, b), (7, b), (2, c), (5, None), (None, a), (9, c + " tail")]
    got = sorted(((r.doc_id, r.n_shingles > 0, r.component_id, r.kept) for r in near_dup.near_duplicates(K.docs(spark, rows)).collect()), key=str)
    assert got == sorted([(1, True, 1, True), (5, True, 1, False), (5, True, 5, True), (5, True, 5, True), (7, True, 5, False), (2, True, 2, True), (5, False, 5, True), (None, True, None, True), (9, True, 2, False)], key=str)
    docs = K.docs(spark, rows).withColumnsRenamed({"lang": "gone_id", "source": "gone_text", "span": "own_text", "node": "_gone"})
    kept = near_dup.drop_near_duplicates(docs)
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(1, a), (5, b), (5, b), (2, c), (5, None), (None, a)], key=str) and kept.columns == docs.columns


def test_signature_keys_meet_within_the_distance():
    rng = np.random.default_rng(3)
    import pyarrow as pa

    a = rng.integers(0, 1 << 16, near_dup.SYMBOLS).astype(np.uint16)
    for _ in range(50):
        b = a.copy()
        b[rng.choice(near_dup.SYMBOLS, near_dup.MAX_DISTANCE, replace=False)] += 1
        batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([a.tobytes(), b.tobytes()])], names=["node", "sig"])
        keys = next(near_dup._index_keys(iter([batch]))).column(0).to_numpy().reshape(2, -1)
        assert set(keys[0]) & set(keys[1])


def test_components_of_paths_and_stars(spark):
    rng = random.Random(5)
    edges = [(k, k + 1) for k in range(30)] + [(100, 100 + k) for k in range(1, 40)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(40)]
    got = components.components(spark.createDataFrame(edges, "a long, b long"), store.Scratch(spark)).collect()
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    touched = {x for a, b in edges if a != b for x in (a, b)}
    assert sorted((r.node, r.component) for r in got) == sorted((x, find(x)) for x in touched)


def brute_cuts(rows):
    """Non-first spans by (doc_id, place), with the module's own sentences."""
    import pyarrow as pa

    from inkstream.llm import buffers as B

    spans, total = {}, {}
    for i, t in rows:
        if i is None:
            continue
        buf, offs = B.text_arrays(pa.array([t or ""], type=pa.large_string()))
        _, starts, bounds, _ = sentence_spans.sentences(buf, offs)
        words = (t or "").encode().lower().split()
        n = len(bounds) - 1
        total[i] = n
        for a in range(n):
            b = a + 2
            while b <= n and bounds[b] - bounds[a] < sentence_spans.SPAN_WORDS:
                b += 1
            if b <= n:
                spans.setdefault(tuple(words[bounds[a] : bounds[b]]), set()).add((i, a, b))
    gone = {i: set() for i in total}
    for places in spans.values():
        for i, a, b in sorted(places)[1:]:
            gone[i].update(range(a, b))
    return {i: (total[i], len(gone[i])) for i in total}


def test_sentence_spans_equal_brute_force(spark):
    rows = K.corpus()
    got = sentence_spans.remove_repeats(K.docs(spark, rows)).collect()
    assert len(got) == len(rows)
    want = brute_cuts(rows)
    assert {r.doc_id: (r.n_sentences, r.n_removed) for r in got if r.doc_id is not None} == want
    by = {r.doc_id: r for r in got}
    assert by[5].text is None and by[6].text == "" and by[1].text == rows[0][1]
    # the passage stays where it stands first and goes elsewhere, but for its edges
    passage = K.prose(2, 9)
    assert passage in by[11].text
    assert all(part not in by[12].text for part in [passage[30:-30]])


def test_cut_repeats_keeps_columns_and_sets_lengths(spark):
    rows = K.corpus()
    got = sentence_spans.cut_repeats(K.docs(spark, rows)).collect()
    assert all(r.n_chars == len(r.text or "") for r in got)
    assert sentence_spans.cut_repeats(K.docs(spark, [])).count() == 0
    clash = K.docs(spark, rows).withColumnsRenamed({"lang": "cut_doc", "source": "cuts", "node": "_doc", "span": "_cuts"})
    again = sentence_spans.cut_repeats(clash)
    assert again.columns == clash.columns and sorted(str(r.text) for r in again.collect()) == sorted(str(r.text) for r in got)


def plain_sentences(text):
    """Ends of sentences by reading word by word: stops, line breaks, and in eight words with neither the least hash, the last of equals."""
    import pyarrow as pa

    from inkstream.llm import buffers as B

    parts = [(m.group().lower(), "\n" in text[m.end() : (text.find(n, m.end()) if (n := next(iter(text[m.end() :].split()), "")) else len(text))]) for m in re.finditer(r"\S+", text)]
    last = [w[-1] in ".!?;:" or newline or k == len(parts) - 1 for k, (w, newline) in enumerate(parts)]
    buf, offs = B.text_arrays(pa.array([w for w, _ in parts], type=pa.large_string()))
    h = B.RunHash(buf)(offs[:-1], offs[1:]).tolist()
    extra = {min(range(k, k + 8), key=lambda j: (h[j], -j)) for k in range(len(parts) - 7) if not any(last[k : k + 8])}
    return [k + 1 for k in range(len(parts)) if last[k] or k in extra]


def test_sentences_end_as_a_reader_finds_them():
    import pyarrow as pa

    from inkstream.llm import buffers as B

    rng = random.Random(12)
    for seed in range(60):
        text = " ".join(K.sentence(rng, rng.randint(2, 30)) if rng.random() < 0.7 else " ".join(rng.choice(K.WORDS) for _ in range(rng.randint(5, 40))) + rng.choice(["\n", "; ", "\n\n", "! "]) for _ in range(6)).strip()
        buf, offs = B.text_arrays(pa.array([text], type=pa.large_string()))
        _, _, bounds, _ = sentence_spans.sentences(buf, offs)
        assert bounds[1:].tolist() == plain_sentences(text)


def test_spans_of_one_hash_are_told_apart(spark):
    """A cut whose second hash is another span's removes nothing."""
    import pyarrow as pa

    text = K.prose(2, 9)
    cuts = pa.array([[{"at": 0, "check": 1}], None], type=pa.list_(pa.struct([("at", pa.int32()), ("check", pa.int64())])))
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([text, text]), cuts], names=["doc_id", "text", "cuts"])
    out = next(sentence_spans._cutter(0, 1, ["doc_id", "text"], True)(iter([batch])))
    assert out.column("n_removed").to_pylist() == [0, 0] and out.column("text").to_pylist() == [text, text]


def brute_bytes(rows, length=suffix_dedup.LENGTH):
    from collections import Counter

    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[k : k + length] for _, b in texts for k in range(len(b) - length + 1))
    out = []
    for i, b in texts:
        mask = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                mask[k : k + length] = b"\x01" * length
        runs = sum(1 for k in range(len(b)) if mask[k] and (k == 0 or not mask[k - 1]))
        out.append((i, len(b), sum(mask), runs, hashlib.sha256(bytes(x for x, m in zip(b, mask) if not m)).hexdigest()))
    return out


def test_suffix_dedup_equals_brute_force(spark):
    rows = K.corpus()
    got = [tuple(r) for r in suffix_dedup.report(suffix_dedup.remove_repeated_strings(K.docs(spark, rows))).collect()]
    assert sorted(got, key=str) == sorted(brute_bytes(rows), key=str)
    assert suffix_dedup.remove_repeated_strings(K.docs(spark, [])).count() == 0


@pytest.mark.parametrize("most", [0, 3])
def test_hot_anchors_are_counted_window_by_window(spark, monkeypatch, most):
    monkeypatch.setattr(suffix_dedup, "HOT_SEGMENTS", most)
    passage = K.prose(77, 8)
    rows = [(k, K.prose(100 + k, 2) + passage + K.prose(200 + k, 2)) for k in range(9)] + [(20, passage), (21, passage[50:400]), (22, K.prose(5, 9)), (23, K.prose(5, 9)), (24, "a" * 450), (25, "b" + "a" * 230), (None, passage[:260] + "z")]
    got = [tuple(r) for r in suffix_dedup.report(suffix_dedup.remove_repeated_strings(K.docs(spark, rows))).collect()]
    assert sorted(got, key=str) == sorted(brute_bytes(rows), key=str)


def test_suffix_dedup_of_runs_and_periods(spark):
    rows = [(1, "a" * 450), (2, "b" + "a" * 230 + "c"), (3, "ab" * 150), (4, "x" * 199), (5, "x" * 200), (6, "abc" * 66 + "abd" * 70), (7, "y" * 199 + "z")]
    got = [tuple(r) for r in suffix_dedup.report(suffix_dedup.remove_repeated_strings(K.docs(spark, rows))).collect()]
    assert sorted(got) == sorted(brute_bytes(rows))


def test_anchors_in_parts_of_a_long_text(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "_PART", 500)
    rows = [(1, K.prose(1, 60)), (2, K.prose(2, 5) + K.prose(1, 60)[700:1900]), (3, K.prose(9, 30))]
    import pyarrow as pa

    column = pa.array([rows[0][1]], type=pa.binary())
    windows = 0
    for a, buf, offs, shift in suffix_dedup._parts(column):
        place, first, last, _ = suffix_dedup.anchors(buf, offs)
        windows += int((last - first + 1).sum())
    assert windows == len(rows[0][1]) - suffix_dedup.LENGTH + 1


@pytest.mark.parametrize("letters", [1, 2, 3, 20])
def test_suffix_array_equals_sorting(letters):
    rng = random.Random(letters)
    for _ in range(200):
        t = [rng.randint(1, letters) for _ in range(rng.randint(0, 60))] + [0]
        assert lyndon.suffix_array(np.array(t)).tolist() == sorted(range(len(t)), key=lambda i: t[i:])
    for t in ([1] * 40 + [0], [1, 2] * 20 + [0], [2, 1] * 20 + [0], [1] * 30 + [2, 0]):
        assert lyndon.suffix_array(np.array(t)).tolist() == sorted(range(len(t)), key=lambda i: t[i:])


def span_words(texts):
    """The words of each text's spans, and its sentences."""
    import pyarrow as pa

    from inkstream.llm import buffers as B

    buf, offs = B.text_arrays(pa.array(texts, type=pa.large_string()))
    words, _, bounds, rows = sentence_spans.sentences(buf, offs)
    row, at, to, h, _ = sentence_spans.spans_of(words, bounds, rows)
    return [set(h[row == r].tolist()) for r in range(len(texts))], [np.diff(bounds[rows[r] : rows[r + 1] + 1]) for r in range(len(texts))]


@pytest.mark.parametrize("distinct", [1, 2, 3, 10, 40, 5000])
def test_every_passage_of_51_stop_free_words_has_a_span_in_common(distinct):
    rng = random.Random(distinct)
    word = lambda: f"w{rng.randrange(distinct)}x"
    texts = []
    for _ in range(2000):
        passage = [word() for _ in range(51)]
        for _ in range(2):
            texts.append(" ".join([f"u{rng.random()}" for _ in range(rng.randrange(20))] + passage + rng.choice(["", "\n"]).split(" ") + [f"v{rng.random()}" for _ in range(rng.randrange(20))]))
    spans, sizes = span_words(texts)
    assert all(a & b for a, b in zip(spans[::2], spans[1::2]))
    assert max(int(s.max()) for s in sizes) <= sentence_spans.WINDOW


def test_text_without_spaces_repeats(spark):
    rng = random.Random(7)
    for first, size in ((0x4E00, 2000), (0x0E01, 40), (0x3041, 80)):
        letters = lambda n: "".join(chr(first + rng.randrange(size)) for _ in range(n))
        passages = [letters(60) for _ in range(200)]
        spans, _ = span_words([t for p in passages for t in (letters(30) + p + letters(9), "abc " + letters(5) + p + letters(40))])
        assert all(a & b for a, b in zip(spans[::2], spans[1::2]))
    passage = "".join(chr(0x4E00 + rng.randrange(2000)) for _ in range(60))
    rows = [(1, "前文" + passage + "後文。"), (2, "別" + passage + "了")]
    got = {r.doc_id: r for r in sentence_spans.remove_repeats(K.docs(spark, rows)).collect()}
    assert got[1].text == rows[0][1] and len(got[2].text) < 40
    _, sizes = span_words(["山。水！火"])
    assert sizes[0].tolist() == [2, 2, 1]
