import math

import pytest
from pyspark.sql import functions as F

from tramline.functions import network as fn
from tramline.functions import traffic as ft
from tramline.functions.geometry import haversine_m, point_in_polygon
from tramline.functions.random import hash_uniform, noise_multiplier


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


L = F.lit


def test_haversine(spark):
    assert one(spark, haversine_m(L(0.0), L(0.0), L(1.0), L(0.0)))[0] == pytest.approx(6_371_000 * math.pi / 180)
    assert one(spark, haversine_m(L(2.0), L(41.0), L(2.0), L(41.0)))[0] == 0


def test_point_in_polygon(spark):
    ring = F.array(*(F.struct(L(x).alias("lon"), L(y).alias("lat")) for x, y in [(0.0, 0.0), (4.0, 0.0), (4.0, 2.0), (2.0, 2.0), (2.0, 4.0), (0.0, 4.0)]))
    assert tuple(one(spark, *(point_in_polygon(L(x), L(y), ring) for x, y in [(1.0, 1.0), (3.0, 3.0), (1.0, 3.0), (5.0, 1.0)]))) == (True, False, True, False)


def test_storage_and_bpr(spark):
    r = one(spark, ft.storage_veh(L(50.0), L(100.0)), ft.bpr_time_s(L(5), L(50.0), L(100.0), L(5.0)), ft.bpr_time_s(L(6), L(50.0), L(100.0), L(5.0)), ft.bpr_time_s(L(100), L(50.0), L(100.0), L(5.0)))
    assert r[0] == pytest.approx(50 / 7.5)
    assert r[1] == 5.0
    assert r[2] == pytest.approx(5 * (1 + 0.15 * (6 / (50 / 7.5)) ** 4))
    assert r[3] == pytest.approx(5 * (1 + 0.15 * 16))


def test_mode_times(spark):
    t = lambda v, m: fn.mode_free_flow_s(L(1000.0), L(v), L(m))
    r = one(spark, t(10.0, "walk"), t(10.0, "bike"), t(0.8, "walk"), t(10.0, "car"), t(0.0, "car"))
    assert list(r) == pytest.approx([1000 / 1.39, 1000 / 4.17, 1250, 100, 1e9])


def test_derating(spark):
    c = lambda k, g, y, b=1600.0: fn.effective_capacity(L(b), L(k), L(g).cast("double"), L(y).cast("double"))
    r = one(spark, c(3, 40.0, 90.0), c(3, None, None), c(3, 40.0, 0.0), c(1, None, None, 600.0), c(4, None, None, 1000.0), c(2, None, None))
    assert list(r) == pytest.approx([1600 * 40 / 90 * 0.9, 1600 * 0.45 * 0.9, 1600 * 0.45 * 0.9, 360, 750, 1600])


def test_geh_and_los(spark):
    r = one(spark, ft.geh(L(0.0), L(0.0)), ft.geh(L(120.0), L(100.0)), ft.los(L(0.29)), ft.los(L(0.9)), ft.los(L(1.0)))
    assert r[0] == 0 and r[1] == pytest.approx(math.sqrt(400 / 110)) and list(r)[2:] == ["A", "E", "F"]


def test_tags(spark):
    r = one(spark, fn.maxspeed_kmh(L("50"), L(30)), fn.maxspeed_kmh(L("30 mph"), L(30)), fn.maxspeed_kmh(L("walk"), L(30)), fn.maxspeed_kmh(L("0"), L(30)), fn.lane_count(L("3;2"), L(1)), fn.lane_count(L(None).cast("string"), L(2)), fn.oneway(L("-1")), fn.oneway(L("true")), fn.restriction_kind(L("no_left_turn")))
    assert list(r) == [50, pytest.approx(48.2802), 30, 30, 3, 2, -1, 1, "no"]


def test_clock(spark):
    r = one(spark, ft.clock_seconds(L("2024-01-01 08:30:05")), ft.clock_seconds(L("120")), ft.clock_label(L(30605.0)), ft.tod_bucket(L(28801)), ft.slug(L("São Paulo / Área 1")))
    assert list(r) == [30605.0, 120.0, "08:30", 32, "sao_paulo_area_1"]


def test_ema(spark):
    assert one(spark, ft.ema(F.array(L(2.0), L(2.0))))[0] == pytest.approx(1.36)


def test_noise_follows_the_formula(spark):
    def model(seed, edge):
        h = ((seed ^ (edge * 2654435761 & 0xFFFFFFFF)) * 0x9E3779B9) & 0xFFFFFFFF
        return 1 + 0.08 * (h - (1 << 32) if h >= 1 << 31 else h) / 2**31

    pairs = [(0, 0), (1, 5), (0xCA7F00D, 4_000_000_000), (0xFFFFFFFF, 77)]
    r = one(spark, *(noise_multiplier(L(s), L(e), 0.08) for s, e in pairs))
    assert list(r) == pytest.approx([model(s, e) for s, e in pairs])


def test_uniform_is_even(spark):
    n = spark.range(20_000).select(F.floor(hash_uniform(7, "id") * 10 / 2_147_483_647).alias("b")).groupBy("b").count().collect()
    assert len(n) == 10 and all(1700 < r["count"] < 2300 for r in n)
