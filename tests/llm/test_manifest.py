"""Merkle manifests against plain trees."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from inkstream.llm import manifest as M

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, rank int, kids string"
CAPS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def h(*x):
    return hashlib.sha256("".join(x).encode()).hexdigest()


def leaf(r):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + 16]) for i in range(0, len(out[-1]), 16)])
    return out


def around(tree, i):
    for level in tree[:-1]:
        a = i // 16 * 16
        yield level[a:i], level[i + 1 : a + 16]
        i //= 16


def plain(rows):
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in order:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = {s: levels([leaf(r) for r in by[s]]) for s in order}
    top = levels([trees[s][-1][0] for s in order])
    for k, s in enumerate(order):
        for i, r in enumerate(by[s]):
            path, own = [*around(trees[s], i), *around(top, k)], r
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None:
                own = (*r[:4], r[4].translate(str.maketrans(CAPS, CAPS.lower())))
            folded = leaf(own)
            for a, b in path:
                folded = h(*a, folded, *b)
            yield (r[0], leaf(r), trees[s][-1][0], top[-1][0], h(*("".join(a + b) for a, b in path)), folded, folded == top[-1][0])


def made(spark, rows, **how):
    docs = spark.createDataFrame([(*r, 3, "clash") for r in rows], SCHEMA)
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    text = F.when(hit, F.translate("text", CAPS, CAPS.lower())).otherwise(F.col("text"))
    return M.manifest(docs, altered={"text": text}, **how)


ODD = [(None, None, None, None, None), (5, None, "A", 3, "Abc"), (5, None, "A", 3, "Abc"), (-7, "é", "x", None, "Ab"), (2**62, "é", "x", None, "Ab"), (-(2**62), "é", "x", 1, ""), (None, "é", "x", 1, "Q")]
ODD += [(9, "dup", "e", 1, "Same Text")] * 70 + [(9, "dup", "e", 1, f"Other {i}") for i in range(50)] + [(i * 1000003, "far", "e", 1, "T") for i in range(300)]
WIDE = [(i, f"s{i}", "l", 0, "") for i in range(300)] + [(i * 7, "hot", "en", 4, f"Text {i}") for i in range(700)]


@pytest.mark.parametrize("rows, bucket, copies", [([], 4096, 4096), (ODD[-1:], 4096, 4096), (ODD, 4096, 16), (ODD + WIDE, 8, 16), (ODD[:3] + [(1, "big", "e", 9, "Long " * 400_000)], 4096, 4096)])
def test_rows_equal_plain_trees(spark, monkeypatch, rows, bucket, copies):
    monkeypatch.setattr(M, "COPIES", copies)
    assert sorted(map(str, map(tuple, made(spark, rows, bucket=bucket).collect()))) == sorted(map(str, plain(rows)))


def test_ranks_of_clumped_and_tied_keys(spark):
    from inkstream.llm.store import Scratch

    ids = [*range(500), *(10**15 + 3 * k for k in range(500)), -5, 2**62] + [k << 40 for k in range(1, 300)]
    rows = spark.createDataFrame([("a" if i % 3 else "b", i, 1 + i % 4) for i in ids], "g string, i long, w long")
    got = M.ranked(rows, ["g"], M.id_digits(F.col("i")), Scratch(spark), F.col("w"), bucket=4).collect()
    for g in "ab":
        own, n = sorted((r.i, r.w, r["rank"]) for r in got if r.g == g), 0
        for _, w, rank in own:
            assert rank == n
            n += w
        assert {r.total for r in got if r.g == g} == {n}
    assert len(got) == len(ids)
