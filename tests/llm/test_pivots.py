"""Linked vectors against all pairs."""

import math

import numpy as np
import pytest

from inkstream.llm import pivots

INF = float("inf")


def usable(v):
    return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v)


def plain(ids, vectors):
    n = len(ids)
    ok = [i for i in range(n) if ids[i] is not None and usable(vectors[i])]
    links, near = [0] * n, {i: {i} for i in ok}
    for size in {len(vectors[i]) for i in ok}:
        at = [i for i in ok if len(vectors[i]) == size]
        u = pivots.unit(np.array([vectors[i] for i in at], dtype=float))
        for x, y in zip(*np.nonzero(u @ u.T >= 0.95)):
            if x != y:
                links[at[x]] += 1
                near[at[x]].add(at[y])
    group = {}
    for i in ok:
        if i not in group:
            seen, todo = {i}, [i]
            while todo:
                for j in near[todo.pop()] - seen:
                    seen.add(j)
                    todo.append(j)
            group |= dict.fromkeys(seen, min(ids[j] for j in seen))
    return sorted(((i, links[k], group.get(k, i), i is None or group.get(k, i) == i) for k, i in enumerate(ids)), key=str)


def found(spark, ids, vectors):
    rows = spark.createDataFrame([(i, v, 4, "clash") for i, v in zip(ids, vectors)], "vec_id long, embedding array<double>, core int, node string")
    return sorted(map(tuple, pivots.near_vectors(rows).collect()), key=str)


def test_odd_rows_and_lengths(spark):
    ids = [1, 2, 3, 4, 5, 5, 6, 7, 8, None, 9, 10, 11, 12, 13]
    vectors = [[1.0, 0.0], [2.0, 0.0], None, [0.0, 0.0], [0.0, 1.0], [0.0, 1.0], [float("nan"), 1.0], [None, 1.0], [1.0, 0.0, 0.0], [1.0, 0.0], [], [1.0, 0.1], [1e200, 1e199], [INF, 1.0], [-0.0, 3.0]]
    assert found(spark, ids, vectors) == plain(ids, vectors)
    assert found(spark, [], []) == []


@pytest.mark.parametrize("seed", [1, 2])
def test_groups_of_every_width(spark, seed):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(5, 24))
    near = [middles[k] + rng.normal(size=(n, 24)) * s for k, (n, s) in enumerate([(500, 0.02), (300, 0.1), (300, 0.2), (300, 0.3), (40, 0.15)])]
    vectors = np.concatenate([*near, rng.normal(size=(400, 24))])
    vectors[-20:] = vectors[:20] * 3.5
    ids = rng.permutation(len(vectors)).tolist()
    got, want = found(spark, ids, vectors.tolist()), plain(ids, vectors.tolist())
    links = sum(r[1] for r in want)
    assert sum(r[1] for r in got) >= 0.99 * links
    assert all(a[1] <= b[1] for a, b in zip(got, want))


def test_lists_and_cores_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(7)
    vectors = np.concatenate([rng.normal(size=16) + rng.normal(size=(220, 16)) * s for s in (0.05, 0.25, 0.35)])
    vectors = np.concatenate([vectors, vectors[:90]])
    whole = found(spark, list(range(len(vectors))), vectors.tolist())
    monkeypatch.setattr(pivots, "BLOCK", 16)
    assert found(spark, list(range(len(vectors))), vectors.tolist()) == whole == plain(list(range(len(vectors))), vectors.tolist())
