"""The route cache against one that goes step by step."""

import random
from collections import OrderedDict

import pytest

from tramline.operators import cache


def stepwise(keys, capacity):
    held, hits, gone = OrderedDict(), [], 0
    for k in keys:
        hits.append(k in held)
        if k not in held:
            held[k] = True
            if len(held) > capacity:
                held.popitem(last=False)
                gone += 1
    return hits, gone, len(held)


@pytest.mark.parametrize("n,kinds,capacity", [(600, 200, 40), (600, 60, 20), (300, 30, 50), (200, 9, 1)])
def test_outcomes(spark, n, kinds, capacity):
    r = random.Random(n + kinds)
    keys = [(r.randrange(kinds) if r.random() < 0.7 else 3, r.choice(["car", None])) for _ in range(n)]  # a hot key, null parts
    rows = [(1000 - i, o, m) for i, (o, m) in enumerate(keys)]
    r.shuffle(rows)
    df = spark.createDataFrame([(-s, o, m) for s, o, m in rows], "seq long, origin long, mode string")
    found = cache.outcomes(df, ["seq"], ["origin", "mode"], capacity, block=64)
    got = [x["hit"] for x in sorted(found.collect(), key=lambda x: x["seq"])]
    hits, gone, left = stepwise(keys, capacity)
    assert got == hits
    s = cache.statistics(found, capacity).first()
    assert tuple(s) == (n, sum(hits), n - sum(hits), gone, left)


def test_cache_of_nothing(spark):
    df = spark.createDataFrame([], "seq long, origin long")
    assert tuple(cache.statistics(cache.outcomes(df, ["seq"], ["origin"], 3), 3).first()) == (0, 0, 0, 0, 0)
    with pytest.raises(ValueError, match="one route"):
        cache.outcomes(df, ["seq"], ["origin"], 0)


def test_changed_edges_take_their_routes_along(spark):
    routes = spark.createDataFrame([(1, [1, 2, 3]), (2, [4]), (3, []), (4, [9, 2, 2])], "id long, edges array<long>")
    stay, go = cache.invalidated(routes, spark.createDataFrame([(2,), (2,), (7,)], "edge_id long"))
    assert sorted(r["id"] for r in stay.collect()) == [2, 3] and sorted(r["id"] for r in go.collect()) == [1, 4]
