import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tramline.operators import analytics, cleaning, demand, engine, network, routing
from tramline.operators.components import connected_components
from tramline.operators.numbering import dense_ids

EDGE = "edge_id long, from_node long, to_node long, length_m double, speed_ms double, capacity double, road_class int"


def edges(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], EDGE)


def nodes(spark, n):
    return spark.range(n).select(F.col("id").alias("node_id"), F.lit(0).alias("intersection_type"))


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_components(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (8, 7), (7, 9), (5, 5)] + [(100 + i, 101 + i) for i in range(60)], "a long, b long")
    got = dict(rows(connected_components(e, "a", "b"), "node", "component"))
    assert {got[i] for i in (1, 2, 3)} == {1} and {got[i] for i in (7, 8, 9)} == {7} and {got[100 + i] for i in range(61)} == {100} and 5 not in got


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_dense_ids(spark):
    x = dense_ids(spark.range(1000).select((F.col("id") * 7919 % 1009).alias("k")), "n", "k").orderBy("n").collect()
    assert [r["n"] for r in x] == list(range(1000)) and [r["k"] for r in x] == sorted(r["k"] for r in x)


def test_contraction(spark):
    one = network.contracted(edges(spark, [(0, 1, 100.0, 10.0, 1600.0, 0), (1, 2, 150.0, 8.0, 900.0, 0)]), nodes(spark, 3))
    assert rows(one, "from_node", "to_node", "length_m", "speed_ms", "capacity") == [(0, 2, 250.0, 8.0, 900.0)]
    two = network.contracted(edges(spark, [(0, 1, 100.0, 10.0, 1600.0, 0), (1, 0, 100.0, 10.0, 1600.0, 0), (1, 2, 150.0, 10.0, 1600.0, 0), (2, 1, 150.0, 10.0, 1600.0, 0)]), nodes(spark, 3))
    assert rows(two, "from_node", "to_node", "length_m") == [(0, 2, 250.0), (2, 0, 250.0)]
    star = edges(spark, [(0, 1, 100.0, 10.0, 1.0, 0), (1, 2, 100.0, 10.0, 1.0, 0), (1, 3, 100.0, 10.0, 1.0, 0)])
    assert network.contracted(star, nodes(spark, 4)).count() == 3


def test_dedup_keeps_most_capacity(spark):
    e = edges(spark, [(0, 1, 1.0, 1.0, 5.0, 0), (0, 1, 2.0, 1.0, 9.0, 0), (0, 1, 3.0, 1.0, 9.0, 0), (1, 1, 1.0, 1.0, 1.0, 0)])
    assert rows(network.deduplicated(network.without_loops(e)), "edge_id") == [(1,)]


def test_small_components_go(spark):
    e = edges(spark, [(i, i + 1, 1.0, 1.0, 1.0, 0) for i in range(6)] + [(20, 21, 1.0, 1.0, 1.0, 0)])
    assert rows(network.large_components(e), "from_node") == [(i,) for i in range(6)]


def test_largest_scc(spark):
    e = edges(spark, [(a, b, 1.0, 1.0, 1.0, 0) for a, b in [(0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (4, 3), (5, 0)]])
    assert rows(network.largest_scc(e), "node") == [(0,), (1,), (2,)]


def test_largest_scc_of_equals_and_of_too_few_rounds(spark):
    ring = [(a, b, 1.0, 1.0, 1.0, 0) for a, b in [(5, 6), (6, 7), (7, 5), (5, 7), (7, 6), (1, 2), (2, 3), (3, 1)]]
    assert rows(network.largest_scc(edges(spark, ring)), "node") == [(1,), (2,), (3,)]
    with pytest.raises(RuntimeError):
        network.strong_components(edges(spark, ring), rounds=1)


def test_strong_components_of_several_networks(spark):
    """Against what is reachable both ways; with loops, repeats, chains and a network of its own for each key."""
    r = random.Random(31)
    pairs = [(k, r.randrange(25), r.randrange(25)) for k, n in ((1, 30), (2, 45), (3, 12)) for _ in range(n)] + [(3, 7, 7), (2, 3, 4), (2, 3, 4), (4, 9, 9)]
    got = rows(network.strong_components(spark.createDataFrame(pairs, "k long, from_node long, to_node long"), ("k",), hops=2), "k", "node", "component")
    want = []
    for k in {k for k, *_ in pairs}:
        out = {}
        for j, a, b in pairs:
            if j == k:
                out.setdefault(a, set()).add(b)
                out.setdefault(b, set())

        def reach(v, out=out):
            seen, todo = {v}, [v]
            while todo:
                new = out[todo.pop()] - seen
                seen |= new
                todo += new
            return seen

        far = {v: reach(v) for v in out}
        want += [(k, v, min(w for w in far[v] if v in far[w])) for v in out]
    assert sorted(got) == sorted(want)
    assert network.strong_components(spark.createDataFrame([], "from_node long, to_node long")).count() == 0


NET4 = [(0, 1, 300.0, 10.0, 600.0, 10), (0, 2, 500.0, 25.0, 2000.0, 0), (1, 2, 300.0, 10.0, 600.0, 10), (2, 3, 300.0, 10.0, 600.0, 10), (3, 0, 900.0, 10.0, 600.0, 10)]


def test_routes_by_mode(spark):
    from tramline.functions.network import accessible, mode_free_flow_s

    ask = spark.createDataFrame([(1, 0, 3), (2, 3, 3), (3, 0, 99)], "agent_id long, origin long, dest long")
    want = {"car": [1, 3], "walk": [0, 2, 3], "bike": [0, 2, 3]}
    for mode, path in want.items():
        e = edges(spark, NET4).where(accessible(F.col("road_class"), F.lit(mode))).withColumn("cost", mode_free_flow_s(F.col("length_m"), F.col("speed_ms"), F.lit(mode)))
        got = {r["agent_id"]: r["edges"] for r in routing.routes(ask, e).collect()}
        assert got == {1: path, 2: [], 3: None}


def test_relaxation_equals_the_kernel(spark):
    import random

    random.seed(5)
    e = edges(spark, [(random.randrange(40), random.randrange(40), 1.0, 1.0, 1.0, 0) for _ in range(160)]).withColumn("cost", (F.col("edge_id") * 7919 % 97 + 1).cast("double"))
    far = {(r["source"], r["node"]): r["cost"] for r in routing.relaxed(e, spark.createDataFrame([(0,), (7,)], "source long")).collect()}
    ask = spark.createDataFrame([(s * 100 + t, s, t) for s in (0, 7) for t in range(40)], "agent_id long, origin long, dest long")
    got = {(r["origin"], r["dest"]): r["cost"] for r in routing.routes(ask, e).collect()}
    assert all(got[k] == far.get(k) for k in got)
    tables = {(r["origin"], r["dest"]): (r["cost"], r["edges"]) for r in routing.routes(ask, e, kernel_edges=0).collect()}
    cost = dict(enumerate(r["cost"] for r in e.orderBy("edge_id").collect()))
    ends = {r["edge_id"]: (r["from_node"], r["to_node"]) for r in e.collect()}
    assert {k: v[0] for k, v in tables.items()} == got
    for (o, t), (c, path) in tables.items():
        if path:
            assert sum(cost[x] for x in path) == c and ends[path[0]][0] == o and ends[path[-1]][1] == t and all(ends[x][1] == ends[y][0] for x, y in zip(path, path[1:], strict=False))
        assert (path is None) == (c is None) and (path != [] or o == t)
    near = {(r["source"], r["node"]): r["cost"] for r in routing.costs(e, spark.createDataFrame([(0,), (7,), (99,)], "source long"), "cost", 60.0).collect()}
    assert near == {**{k: c for k, c in far.items() if c <= 60}, (99, 99): 0.0}


def test_mode_split_and_occupancy(spark):
    od = spark.createDataFrame([("2-10", 100.0, 400.0)], "band string, trips double, km double")
    x = demand.mode_split(od).withColumn("n", F.rint(demand.vehicles(F.col("trips") * F.col("share") / 100, F.col("mode"), 1.2)))
    assert dict(rows(x, "mode", "n")) == {"car": 42, "walk": 10, "bike": 5, "transit": 35}
    hook = demand.mode_split(od, choice=lambda km: {"car": F.when(km == 4, 0.2).otherwise(0.0), "walk": F.lit(0.7), "bike": F.lit(0.1)})
    assert dict(rows(hook, "mode", F.round("share", 6))) == {"car": 13.0, "walk": 45.5, "bike": 6.5, "transit": 35.0}


def test_mean_of_days(spark):
    t = spark.createDataFrame([("2022-02-07", "a", 10, 40), ("2022-02-14", "a", 20, 100), ("2022-02-14", "b", 5, 5)], "day string, k string, trips long, trip_km long")
    assert rows(demand.mean_day(t, "k"), "k", "trips_sum", "km_sum", "n_days") == [("a", 30, 140, 2), ("b", 5, 5, 1)]
    assert rows(demand.mean_day(t, "k", all_days=True), "k", "n_days") == [("a", 2), ("b", 2)]


def test_node_pairs_split_counts(spark):
    od = spark.createDataFrame([(1, 2, 47)], "origin long, dest long, count long")
    pools = spark.createDataFrame([(1, [1, 2, 3]), (2, [4, 5, 6])], "zone long, nodes array<long>")
    got = demand.node_pairs(od, pools).collect()
    assert len(got) == 20 and sum(r["part"] for r in got) == 47 and all(r["origin_node"] < 4 <= r["dest_node"] for r in got)


def test_windows_and_thinning(spark):
    od = spark.createDataFrame([(1, 100, "car", 3600.0, 7200.0), (2, 50, "car", 28800.0, 25200.0)], "od_id long, count long, mode string, depart_start_s double, depart_end_s double")
    kept = demand.od_window(od, 21600, 86399)
    got = demand.agents(kept).agg(F.count("*"), F.min("depart_s"), F.max("depart_s")).first()
    assert got[0] == 50 and 25200 <= got[1] and got[2] < 28800
    assert demand.thinned(od, 0).count() == 0 and demand.thinned(od, 1).agg(F.sum("count")).first()[0] == 150
    assert 40 < demand.thinned(od, 0.4).agg(F.sum("count")).first()[0] < 80


def sim(edge_rows, agents, **options):
    e = pd.DataFrame([(i, *r[:5]) for i, r in enumerate(edge_rows)], columns=["edge_id", "from_node", "to_node", "length_m", "speed_ms", "capacity"])
    a = pd.DataFrame(agents, columns=["agent_id", "mode", "depart_s", "edges"])
    return engine.simulate(e, a, engine.Options(**({"window_s": 1.0, "until_s": 20_000.0} | options)))


def test_token_bucket():
    link = engine.LimitedLink(1000.0, 10.0, 3600.0, 3.0)
    link.occupancy = 9
    assert [link.may_leave(0.0, None) for _ in range(4)] == [True, True, True, False]
    assert [link.may_leave(3.0, None) for _ in range(4)] == [True, True, True, False]


def test_gate_wait_grows_and_resets():
    full, behind = engine.LimitedLink(50.0, 10.0, 100.0), engine.LimitedLink(500.0, 10.0, 1600.0)
    full.occupancy = 7
    waits = []
    for t in (0.0, 50.0, 500.0):
        assert not behind.may_leave(t, full)
        waits.append(behind.wait)
    full.occupancy = 0
    assert waits == [0.0, 50.0, 500.0] and behind.may_leave(501.0, full) and behind.wait == 0.0


def test_walkers_do_not_slow_a_car():
    got = sim([(0, 1, 1000.0, 10.0, 200.0)], [(0, "car", 0.0, [0])] + [(i, "walk", 0.0, [0]) for i in range(1, 31)])
    a = got["agents"].set_index("agent_id")
    assert a.end_s[0] < 150 and (a.state == "arrived").all()


def test_gates_hold_the_storage():
    burst = sim([(0, 1, 50.0, 10.0, 100.0)], [(i, "car", 2.0 + i, [0]) for i in range(40)], model="ltm")
    star = sim([(i, 10, 100.0, 10.0, 1600.0) for i in range(10)] + [(10, 11, 50.0, 10.0, 100.0)], [(i, "car", 0.0, [i % 10, 10]) for i in range(40)], model="ltm")
    for got, e in ((burst, 0), (star, 10)):
        links = got["links"]
        assert links[links.edge_id == e].occupancy.max() <= 7 and (got["agents"].state == "arrived").all()


#: A ramp from 5 into a narrow bridge 0 -> 1 -> 7 and a long way round 0 -> 2 -> 3 -> 7; the goal is 9 behind 7.
BRIDGE = [(5, 0, 120.0, 12.0, 1500.0), (0, 1, 60.0, 12.0, 30.0), (1, 7, 90.0, 12.0, 900.0), (0, 2, 300.0, 15.0, 4000.0), (2, 3, 250.0, 15.0, 4000.0), (3, 7, 280.0, 15.0, 4000.0), (7, 9, 150.0, 12.0, 2500.0)]


def crowd(n, route):
    return [(i, "car", 3.0 * i, route) for i in range(n)] + [(n, "car", 900.0, route)]


def entered(got, agent):
    ev = got["events"]
    return ev[(ev.agent_id == agent) & (ev.kind == "enter")].edge_id.tolist()


@pytest.mark.parametrize("route", [[1, 2, 6], [0, 1, 2, 6]])
def test_agents_go_round_a_jam(route):
    """Before the trip those that begin at the bridge, under way those that come up the ramp; without rerouting all cross the bridge."""
    options = {"model": "ltm", "burst_s": 2.0}
    plain, round_ = sim(BRIDGE, crowd(70, route), **options), sim(BRIDGE, crowd(70, route), reroute_every_s=60.0, pretrip=len(route) == 3, **options)
    assert all(entered(plain, a) == route for a in range(71)) and plain["agents"].reroutes.sum() == 0
    went = [a for a in range(71) if entered(round_, a) == [*route[:-3], 3, 4, 5, 6]]
    assert len(went) > 20 and round_["agents"].reroutes.sum() >= len(went)
    assert round_["agents"].end_s.mean() < plain["agents"].end_s.mean() / 2


def test_routes_stay_connected_after_reroutes():
    got = sim(BRIDGE, crowd(80, [0, 1, 2, 6]), model="ltm", burst_s=2.0, reroute_every_s=20.0)
    assert got["agents"].reroutes.sum() > 0
    for a in range(81):
        path = entered(got, a)
        assert path[0] == 0 and path[-1] == 6 and all(BRIDGE[x][1] == BRIDGE[y][0] for x, y in zip(path, path[1:], strict=False))


def test_a_run_in_steps_is_the_run_as_a_whole():
    e = pd.DataFrame([(i, *r) for i, r in enumerate(BRIDGE)], columns=["edge_id", "from_node", "to_node", "length_m", "speed_ms", "capacity"])
    a = pd.DataFrame(crowd(30, [0, 1, 2, 6]), columns=["agent_id", "mode", "depart_s", "edges"])
    options = engine.Options(model="ltm", burst_s=2.0, window_s=1.0)
    seen = []
    whole, run = engine.simulate(e, a, options), engine.Run(e, a, options, {"arrive": lambda t, agent, edge: seen.append((t, agent, edge))})
    run.step()
    assert run.now == 1.0
    run.run_until(600.0).run_until(options.until_s)
    for name, table in run.tables().items():
        pd.testing.assert_frame_equal(table, whole[name])
    arrive = whole["events"][whole["events"].kind == "arrive"]
    assert [x[1] for x in seen] == arrive.agent_id.tolist() and len(seen) == 31
    with pytest.raises(ValueError):
        engine.Options(model="none")
    with pytest.raises(ValueError):
        engine.Run(e, pd.concat([a, a]), options)


def test_means_stand_still_or_fade():
    e = [(0, 1, 50.0, 10.0, 100.0), (1, 2, 3000.0, 10.0, 900.0)]
    many = [(i, "car", 0.0, [0, 1]) for i in range(9)]
    means = {}
    for freeze in (False, True):
        net = pd.DataFrame([(i, *r) for i, r in enumerate(e)], columns=["edge_id", "from_node", "to_node", "length_m", "speed_ms", "capacity"])
        run = engine.Run(net, pd.DataFrame(many, columns=["agent_id", "mode", "depart_s", "edges"]), engine.Options(window_s=1.0, freeze=freeze)).run_until(250.0)
        means[freeze] = run.at[0].mean
    assert means[True] > means[False] >= 1


def test_a_vehicle_that_is_taken_off_frees_its_link_at_once():
    link = engine.Link(50.0, 10.0, 100.0)
    for _ in range(7):
        link.enter(0.0)
    slow = link.travel
    link.removed()
    link.removed()
    assert link.occupancy == 5 and link.travel == link.free < slow


def test_stuck_agents_are_taken_out():
    got = sim([(0, 1, 1000.0, 1.0, 100.0)], [(0, "car", 0.0, [0])], stuck_cap_s=100.0)
    assert got["agents"].end_s[0] <= 102 and "teleport" in set(got["events"].kind)


def test_processing_windows(spark):
    x = spark.createDataFrame([(1, k, t) for k, t in enumerate([0.0, 5.0, 10.0, 100.0])], "agent_id long, k long, enter double")
    assert [r["window"] for r in analytics.processing_window(x, 0, 30).orderBy("k").collect()] == [0, 1, 2, 3]


def test_snapping(spark):
    n = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.001, 0.0)], "node_id long, lon double, lat double")
    p = spark.createDataFrame([(9, 0.0008, 0.0), (8, 1.0, 1.0)], "point_id long, lon double, lat double")
    assert rows(network.snapped(n, p, 0.001, 50), "point_id", "node_id") == [(9, 2)]


def test_short_edges_are_contracted_whatever_their_order(spark):
    """0 -> 1 -> 2 with only one edge back: unbalanced at 1, contracted for its short edge; the edge without counterpart stays."""
    e = edges(spark, [(0, 1, 100.0, 10.0, 900.0, 0), (1, 2, 12.0, 8.0, 700.0, 0), (2, 1, 12.0, 8.0, 700.0, 0), (2, 3, 50.0, 5.0, 500.0, 0), (3, 2, 50.0, 5.0, 500.0, 0)])
    got = rows(cleaning.shortened(e, nodes(spark, 4), 20.0), "from_node", "to_node", "length_m", "speed_ms", "capacity")
    assert (0, 1, 100.0, 10.0, 900.0) not in got and any(x[0] == 0 and x[2] >= 112 for x in got)
    assert rows(cleaning.shortened(e, nodes(spark, 4), 0), "edge_id") != [] and cleaning.shortened(edges(spark, []), nodes(spark, 1)).count() == 0


def test_cleaning_in_one_call(spark):
    """A chain of three with geometry, a loop, a weaker parallel edge, and an island."""
    p = [(float(i), 0.0) for i in range(7)]
    net = [(0, 1, 30.0, 10.0, 900.0, 0), (1, 2, 40.0, 9.0, 800.0, 0), (2, 3, 50.0, 8.0, 950.0, 0), (0, 1, 30.0, 10.0, 100.0, 0), (3, 3, 5.0, 1.0, 1.0, 0), (4, 5, 10.0, 1.0, 1.0, 0), (3, 6, 25.0, 7.0, 500.0, 0), (6, 3, 25.0, 7.0, 500.0, 0)]
    e = spark.createDataFrame([(i, *r, [p[r[0]], p[r[1]]]) for i, r in enumerate(net)], EDGE + ", points array<struct<lon:double,lat:double>>")
    n, kept, report = cleaning.cleaned(nodes(spark, 7), e)
    one, *rest = kept.orderBy("edge_id").collect()
    assert (one["edge_id"], one["old_id"], one["from_node"], one["to_node"], one["length_m"], one["speed_ms"], one["capacity"]) == (0, 0, 0, 1, 120.0, 8.0, 800.0)
    assert [x["lon"] for x in one["points"]] == [0.0, 1.0, 2.0, 3.0] and rows(n, "old_id", "node_id") == [(0, 0), (3, 1), (6, 2)] and [(x["from_node"], x["to_node"]) for x in rest] == [(1, 2), (2, 1)]
    r = report.first()
    assert (r["loops"], r["parallel"], r["contracted"], r["components_removed"], r["nodes_after"], r["edges_after"]) == (1, 1, 2, 1, 3, 3)


def test_network_of_osm_tables(spark):
    n = spark.createDataFrame([(i, 0.001 * i, 0.0, {}) for i in range(6)], "id long, lon double, lat double, tags map<string,string>")
    w = spark.createDataFrame([(1, [0, 1, 2, 3], {"highway": "primary"}), (2, [3, 4, 5], {"highway": "residential", "oneway": "yes"})], "id long, nodes array<long>, tags map<string,string>")
    from tramline.sources.osm import class_table

    _, e, report = cleaning.build_network(n, w, class_table(spark), cleaning.Cleaning(least_component=1))
    got = sorted((x["from_node"], x["to_node"], len(x["points"])) for x in e.collect())
    assert report.first()["edges_before"] == 8 and len(got) >= 3 and all(k >= 2 for *_, k in got)


def test_nodes_that_a_mode_may_leave(spark):
    e = edges(spark, [(0, 1, 1.0, 1.0, 1.0, 0), (1, 2, 1.0, 1.0, 1.0, 10)])
    assert rows(network.accessible_nodes(e, "walk"), "node") == [(1,)]
    assert rows(network.accessible_nodes(e.where("road_class = 0"), "walk"), "node") == [(0,)]


def test_detours_fall_back(spark):
    n = spark.createDataFrame([(0, 0.0, 0.0), (1, 0.03, 0.0)], "node_id long, lon double, lat double")
    e = edges(spark, [(0, 1, 3400.0, 10.0, 1.0, 0), (0, 1, 9000.0, 10.0, 1.0, 0)])
    kind = "agent_id long, origin long, dest long, edges array<long>"
    own = spark.createDataFrame([(1, 0, 1, [0]), (2, 0, 1, [1]), (3, 0, 1, None), (4, 1, 0, None)], kind)
    base = spark.createDataFrame([(1, 0, 1, [0]), (2, 0, 1, [0]), (3, 0, 1, [0]), (4, 1, 0, None)], kind)
    got = routing.prerouted(own, base, e, n)
    assert rows(got, "agent_id", "kind") == [(1, "stochastic"), (2, "fallback"), (3, "fallback"), (4, "failed")]
    s = routing.routing_summary(got).first()
    assert (s["n"], s["n_routed"], s["n_stochastic"], s["n_fallback"], s["n_failed"], s["failed_pct"]) == (4, 3, 1, 2, 1, 25.0)


def test_demand_from_files_to_node_pairs(spark):
    trips = spark.createDataFrame([(d, 1, 2, 8, "2-10", t, km) for d, t, km in (("a", 60.0, 300.0), ("b", 140.0, 500.0))], "day string, origin long, dest long, period int, band string, trips double, trip_km double")
    got = {m: c for m, c in rows(demand.od_counts(trips), "mode", "count")}
    assert got == {"car": 42, "walk": 10, "bike": 5, "transit": 35}
    noise = {m: c for m, c in rows(demand.od_counts(trips, sigma=0.3), "mode", "count")}
    assert noise != got and all(0.3 < noise[m] / got[m] < 3 for m in noise)
    pools = spark.createDataFrame([(1, [1, 2, 3], "car"), (2, [4, 5], "car"), (1, [1], "walk")], "zone long, nodes array<long>, mode string")
    pairs = demand.build_od(trips, pools).collect()
    assert sum(r["count"] for r in pairs) == 42 and {r["mode"] for r in pairs} == {"car"} and {r["depart_start_s"] for r in pairs} == {28800.0}
    assert demand.od_counts(trips.withColumn("trips", F.lit(0.2))).count() == 0
    coded = trips.withColumn("mode", F.lit("a_pie "))
    assert rows(demand.od_counts(coded), "mode", "count") == [("walk", 100)]


def test_choice_with_a_period_and_without_kilometres(spark):
    od = spark.createDataFrame([("10-50", 8, 10.0, None)], "band string, period int, trips double, km double")
    seen = demand.mode_split(od, choice=lambda km, period: {"car": km / 100, "walk": period / 100, "bike": F.lit(0.62)})
    got = dict(rows(seen, "mode", "share"))
    assert {m: round(s, 6) for m, s in got.items()} == {"car": 24.6, "walk": 6.56, "bike": 50.84, "transit": 18.0}


def test_gated_snapshots_and_teleports(spark):
    links = spark.createDataFrame([(float(30 * i), 1, 2) for i in range(25)], "window_s double, edge_id long, occupancy long")
    assert [r[0] for r in rows(analytics.gated(links, 300.0), "window_s")] == [0.0, 300.0, 600.0]
    log = spark.createDataFrame([(0, 1, 7, "teleport"), (0, 2, 7, "exit")], "run long, agent_id long, edge_id long, kind string")
    agents = spark.createDataFrame([(0, 1, 40), (0, 2, 1)], "run long, agent_id long, reroutes long")
    e = spark.createDataFrame([(7, 3)], "edge_id long, road_class int")
    assert rows(analytics.teleports(log, agents, e), "road_class", "reroutes", "n") == [(3, 31, 1)]


def test_lines_that_miss_their_nodes(spark):
    place = lambda *p: [{"lon": float(x), "lat": float(y)} for x, y in p]
    n = spark.createDataFrame([(0, 0.0, 0.0), (1, 1.0, 1.0)], "node_id long, lon double, lat double")
    rows_ = [(0, 0, 1, place((0, 0), (1, 1))), (1, 1, 0, place((1, 1), (0.5, 0), (0, 0.1))), (2, 0, 1, place((0, 0))), (3, 0, 1, None), (4, 1, 0, place((1, 1.0000001), (0, 0)))]
    e = spark.createDataFrame(rows_, "edge_id long, from_node long, to_node long, points array<struct<lon:double,lat:double>>")
    got = dict(rows(network.violations(e, n), "check", "n"))
    assert got["short_geometry"] == 2 and got["torn_geometry"] == 1 and got["unknown_to"] == 0


def test_strong_components_draw_streets_together_first(spark):
    """On a grid of two-way streets nothing is left to colour; a ring of three such streets, one way each, is."""
    links = lambda pairs: spark.createDataFrame(pairs, "from_node long, to_node long")
    grid = [(x * 6 + y, x2 * 6 + y2) for x in range(6) for y in range(6) for x2, y2 in ((x + 1, y), (x, y + 1)) if x2 < 6 and y2 < 6]
    of, left = network.drawn_together(links(grid + [(b, a) for a, b in grid]))
    assert left.isEmpty() and {r["part"] for r in of.collect()} == {0}
    street = [(a, b) for k in (0, 10, 20) for x in range(k, k + 4) for a, b in ((x, x + 1), (x + 1, x))]
    ring = [*street, (4, 10), (14, 20), (24, 0), (24, 30), (31, 0)]
    of, left = network.drawn_together(links(ring))
    assert {(r["from_node"], r["to_node"]) for r in left.collect()} == {(0, 10), (10, 20), (20, 0)}
    got = dict(rows(network.strong_components(links(ring)), "node", "component"))
    assert {n for n, c in got.items() if c == 0} == {*range(5), *range(10, 15), *range(20, 25)} and got[30] == 30 and got[31] == 31


def test_repeated_rows_are_made_in_chunks_over_tasks(spark):
    from tramline.operators import numbering

    x = numbering.repeated(spark.createDataFrame([(1, 25_000), (2, 3), (3, 0), (4, 10_000)], "k long, n long"), "n", "i")
    got = x.groupBy("k").agg(F.count("*"), F.countDistinct("i"), F.min("i"), F.max("i"))
    assert sorted(map(tuple, got.collect())) == [(1, 25_000, 25_000, 0, 24_999), (2, 3, 3, 0, 2), (4, 10_000, 10_000, 0, 9_999)]
    assert x.groupBy(F.spark_partition_id()).count().count() > 1 and x.schema["i"].dataType.simpleString() == "int"


def test_cleaning_searches_components_once(spark, monkeypatch):
    e = spark.createDataFrame([(i, i % 7, (i + 1) % 7, 100.0, 10.0, 5) for i in range(14)] + [(20, 8, 9, 100.0, 10.0, 5)], "edge_id long, from_node long, to_node long, length_m double, speed_ms double, capacity long")
    calls = []
    for module in (cleaning, network):
        monkeypatch.setattr(module, "connected_components", lambda *a, **k: calls.append(a) or connected_components(*a, **k))
    _, kept, report = cleaning.cleaned(nodes(spark, 10), e, cleaning.Cleaning(simplify=False))
    assert len(calls) == 1 and kept.count() == 7
    r = report.first()
    assert (r["parallel"], r["contracted"], r["small"], r["components"], r["components_removed"]) == (7, 0, 1, 2, 1)
