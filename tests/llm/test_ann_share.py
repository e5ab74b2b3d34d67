"""Neighbours at the shipped block size, in several blocks: recall, and what share of the vectors the stopping test leaves to verify."""

import numpy as np
import pytest

from tramline.llm import ann

ROWS, SIZE, K = 20_000, 64, 20


def vectors(kind):
    r = np.random.default_rng(5)
    x = r.standard_normal((ROWS, SIZE))
    if kind == "clustered":
        x = r.standard_normal((200, SIZE))[r.integers(0, 200, ROWS)] + 0.1 * x
    return x / np.linalg.norm(x, axis=1)[:, None]


def nearest_of(x, i):
    s = x @ x[i]
    s[i] = -np.inf
    return set(np.argsort(-s, kind="stable")[:K].tolist())


@pytest.mark.parametrize("kind", ["clustered", "random"])
def test_recall(spark, kind):
    x = vectors(kind)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(8)
    got = {}
    for r in ann.nearest(df, every=400, k=K).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert len(got) == ROWS // 400
    assert sum(len(got[i] & nearest_of(x, i)) for i in got) >= 0.9 * K * len(got)


@pytest.mark.parametrize("kind,most", [("clustered", 0.3), ("random", 1.0)])
def test_share_verified(kind, most):
    """Vectors that gather in places are mostly left out. Random directions are all about as far, so all are verified there."""
    x = vectors(kind)
    top = ann.Top(SIZE, float((x**2).sum(axis=1).max()))
    points = top.points(x)
    top.split(points, -(-ROWS // ann.BLOCK_ROWS))
    block = top.block_of(points)
    own = {b: np.flatnonzero(block == b) for b in np.unique(block)}
    assert len(own) == 3
    index = {b: ann.Index(top, rows, rows, x[rows]) for b, rows in own.items()}
    top.boxes([(b, points[rows].min(axis=0), points[rows].max(axis=0)) for b, rows in own.items()])
    queries = np.arange(0, ROWS, 200)
    home = top.block_of(x[queries] @ top.rule[:-1])
    kth = np.full(len(queries), -np.inf)
    for b in own:
        mine = np.flatnonzero(home == b)
        for j, (_, _, score) in zip(mine, index[b].search(x[queries[mine]], K + 1, 0.97) if len(mine) else (), strict=True):
            kth[j] = score[-1]
    opened = top.open_blocks(x[queries], kth, 0.97)
    for b in own:
        rest = [j for j in range(len(queries)) if home[j] != b and b in opened[j]]
        if rest:
            list(index[b].search(x[queries[rest]], K + 1, 0.97))
    share = sum(i.read for i in index.values()) / (len(queries) * ROWS)
    assert 0 < share <= most
