import json

import pytest
from pyspark.sql import functions as F

from tramline.scenario import Scenario
from tramline.sources import osm, snapshots, tables


def test_osm_edges(spark):
    n = spark.createDataFrame([(1, 0.0, 0.0, {}), (2, 0.001, 0.0, {"highway": "traffic_signals"}), (3, 0.002, 0.0, {})], "id long, lon double, lat double, tags map<string,string>")
    w = spark.createDataFrame([(10, [1, 2, 3], {"highway": "primary", "name": "A \"road\""}), (11, [3, 1], {"highway": "residential", "oneway": "-1"}), (12, [1, 3], {"highway": "primary", "access": "no"}), (13, [1, 3], {"building": "yes"})], "id long, nodes array<long>, tags map<string,string>")
    e = osm.directed_edges(n, w, osm.class_table(spark)).collect()
    assert sorted((r["way_id"], r["from_node"], r["to_node"]) for r in e) == [(10, 1, 2), (10, 2, 1), (10, 2, 3), (10, 3, 2), (11, 1, 3)]
    assert {r["capacity"] for r in e if r["way_id"] == 10} == {3200.0} and {r["flags"] for r in e if r["way_id"] == 11} == {65}
    assert sorted(r["intersection_type"] for r in osm.junctions(n).collect()) == [0, 0, 3]


def test_turn_restrictions(spark):
    m = [("way", 1, "from"), ("way", 2, "to"), ("node", 5, "via")]
    r = spark.createDataFrame([(1, m, {"restriction": "no_u_turn"}), (2, m[:2], {"restriction": "only_right_turn"})], "id long, members array<struct<type:string,ref:long,role:string>>, tags map<string,string>")
    assert [tuple(x) for x in osm.turn_restrictions(r).collect()] == [(1, 2, 5, "no")]


def test_od_csv_drops_malformed_rows(spark, tmp_path):
    (tmp_path / "od.csv").write_text("origin,dest,count,mode,start,end\n1,2,5,car,0,10\n1,x,5,car,0,10\n")
    assert tables.od_csv(spark, str(tmp_path)).count() == 1


def test_trip_files(spark, tmp_path):
    (tmp_path / "20220207_trips.csv").write_text("Origen|destino|periodo|distancia|viajes\nZ1|Z2|8|2-10|100\nZ1|Z2||2-10|7\nZ1|Z3|9|2-10|?\n")
    got = sorted(tuple(r) for r in tables.daily_trips(spark, str(tmp_path)).select("day", "origin", "dest", "period", "trips", "trip_km").collect())
    assert [(str(g[0]), *g[1:]) for g in got] == [("2022-02-07", "Z1", "Z2", 8, 100.0, None), ("2022-02-07", "Z1", "Z3", 9, 0.0, None)]
    with pytest.raises(ValueError):
        tables.picked(["a", "b"])


def test_cities(spark):
    c = spark.createDataFrame([("Delft",), ("New Delft",)], "name string")
    assert tables.matching_city(c, "delft").first()["name"] == "Delft" and tables.matching_city(c, "new").first()["name"] == "New Delft"
    with pytest.raises(ValueError, match="Delft"):
        tables.matching_city(c, "Dleft")


def test_network_round_trip(spark, tmp_path):
    n, e = spark.range(3).toDF("node_id"), spark.range(2).toDF("edge_id")
    tables.save_network(n, e, str(tmp_path / "net"))
    assert tables.network(spark, str(tmp_path / "net"))[0].count() == 3
    n.limit(1).write.mode("append").parquet(str(tmp_path / "net/nodes.parquet"))
    with pytest.raises(ValueError):
        tables.network(spark, str(tmp_path / "net"))


def test_geojson_escapes(spark):
    x = spark.createDataFrame([("a \"b\"", [(1.0, 2.0), (3.0, 4.0)])], "name string, points array<struct<lon:double,lat:double>>")
    got = json.loads(tables.geojson(x, "name").first()[0])
    assert got["properties"]["name"] == 'a "b"' and got["geometry"]["coordinates"] == [[1, 2], [3, 4]]


def test_snapshots(spark):
    x = spark.createDataFrame([(0, "a"), (300, "b"), (600, "c")], "time_s long, v string")
    assert snapshots.nearest(x, spark.createDataFrame([(450,)], "t long")).first()["v"] == "b"
    lines = spark.createDataFrame([(1, [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0)])], "edge_id long, points array<struct<lon:double,lat:double>>")
    assert snapshots.segments(lines).count() == 2 and snapshots.box(snapshots.segments(lines)).first()["east"] == pytest.approx(1.008)


def test_scenario(tmp_path):
    s = Scenario.from_dict({"name": "x", "simulation": {"start_time": "2024-01-01 06:00:00", "end_time": 36000}, "demand": {"demand_scale": 0.5}})
    assert s.simulation.start_time == 21600 and s.folder("2024-01-01") == "out/2024-01-01_06-00_10-00"
    s.save(str(tmp_path / "s.json"))
    assert Scenario.load(str(tmp_path / "s.json")) == s
    for bad in ({"simulation": {"end_time": 0}}, {"nonsense": {}}, {"demand": {"demand_scale": 2}}, {"traffic": {"model": "x"}}):
        with pytest.raises((ValueError, AttributeError)):
            Scenario.from_dict(bad)


def test_scenario_runs(spark):
    e = spark.createDataFrame([(0, 0, 1, 300.0, 10.0, 600.0), (1, 1, 2, 300.0, 10.0, 600.0)], "edge_id long, from_node long, to_node long, length_m double, speed_ms double, capacity double")
    od = spark.createDataFrame([(1, 0, 2, 3, "car", 0.0, 10.0)], "od_id long, origin_node long, dest_node long, count int, mode string, depart_start_s double, depart_end_s double")
    got = Scenario().run(e, od).groupBy("kind").agg(F.count("*").alias("n")).collect()
    assert {r["kind"]: r["n"] for r in got} == {"depart": 3, "enter": 6, "exit": 6, "arrive": 3}


def _town(spark):
    n = spark.createDataFrame([(0, 0.0, 0.0), (1, 0.01, 0.0), (2, 0.02, 0.0)], "node_id long, lon double, lat double")
    e = spark.createDataFrame([(0, 0, 1, 1100.0, 10.0, 900.0, 4), (1, 1, 2, 1100.0, 10.0, 900.0, 4)], "edge_id long, from_node long, to_node long, length_m double, speed_ms double, capacity double, road_class int")
    od = spark.createDataFrame([(i, 0, 2, 4, "car", 0.0, 1500.0) for i in range(3)], "od_id long, origin_node long, dest_node long, count long, mode string, depart_start_s double, depart_end_s double")
    return n, e, od


def test_scenario_writes_snapshots_as_geojson(spark, tmp_path):
    n, e, od = _town(spark)
    s = Scenario.from_dict({"output": {"directory": str(tmp_path / "out"), "format": "geojson", "snapshot_interval_s": 300}})
    lines = [json.loads(r["value"]) for r in spark.read.text(s.write(n, e, od, "2024-01-01")).collect()]
    times = {x["properties"]["time_s"] for x in lines}
    assert times == {90.0, 300.0, 600.0, 900.0, 1200.0}  # of each 300 s the first window in which a link is in use
    one = lines[0]
    assert len(one["properties"]) == 13 and one["geometry"]["type"] == "LineString" and len(one["geometry"]["coordinates"]) == 2
    path = str(tmp_path / "out" / "2024-01-01_00-00_24-00")
    got = {r["edge_id"]: (r["time_s"], r["congestion"], len(r["points"])) for r in snapshots.congestion_map(spark, path, 500.0).collect()}
    assert got == {x["properties"]["edge_id"]: (600.0, x["properties"]["congestion"], 2) for x in lines if x["properties"]["time_s"] == 600.0}
    for bad in ({"output": {"format": "pdf"}}, {"routing": {"algorithm": "magic"}}, {"traffic": {"model": "magic"}}, {"output": {"snapshot_interval_s": 0}}):
        with pytest.raises(ValueError):
            Scenario.from_dict(bad)


def test_scenario_routes_over_a_saved_hierarchy(spark, tmp_path):
    n, e, od = _town(spark)
    runs = []
    for settings in ({}, {"algorithm": "hierarchy"}, *[{"algorithm": "hierarchy", "index": f"file://{tmp_path}/index"}] * 2):
        done = Scenario.from_dict({"routing": settings}).run(e, od, "agents").select("agent_id", "state", "end_s")
        runs.append(sorted(tuple(r) for r in done.collect()))
    assert runs[0] == runs[1] == runs[2] == runs[3] and runs[0]
    with pytest.raises(ValueError, match="another network"):
        Scenario.from_dict({"routing": settings}).run(e.withColumn("length_m", F.col("length_m") * 2), od, "agents")


def test_agents_of_many_od_rows_stay_apart(spark):
    n, e, od = _town(spark)
    got = Scenario().run(e, od, "agents").collect()
    assert sorted(r["agent_id"] for r in got) == list(range(12)) and {r["state"] for r in got} == {"arrived"}


def test_run_tables(spark, tmp_path):
    stats = spark.createDataFrame([(0.0, 1, 2), (300.0, 1, 3)], "time_bin double, edge_id long, count long")
    tables.save_run({"link_stats": stats}, str(tmp_path))
    back = tables.run_table(spark, str(tmp_path), "link_stats", "edge_id long, count long, time_bin double")
    assert sorted(map(tuple, back.collect())) == [(1, 2, 0.0), (1, 3, 300.0)]
    assert tables.run_table(spark, str(tmp_path), "activities", "agent_id long").count() == 0


def test_snapshot_files_and_settings(spark, tmp_path):
    (tmp_path / "links_300.geojson").write_text("x" * 300)
    (tmp_path / "links_600.geojson").write_text("x")
    assert [r["time_s"] for r in tables.snapshot_files(spark, str(tmp_path)).collect()] == [300.0]
    y = tmp_path / "tags.yaml"
    y.write_text("# tags\nsignals:\n  signal_cycle_s: 80\n  signal_green_frac: 0.4 # share\n  name: none\nother: 3\n")
    assert tables.road_settings(str(y)) == {"signals": {"signal_cycle_s": 80.0, "signal_green_frac": 0.4}, "": {"other": 3.0}}


def test_person_files(spark, tmp_path):
    (tmp_path / "p.csv").write_text("person_id,origin_maz,dest_maz,purpose,depart_period,trip_mode\n1,10,20,work,2,WALK\n2,x,20,work,2,WALK\n3,10,99,home,9,SR2\n")
    (tmp_path / "m.csv").write_text("maz_id,node_id\n10,1\n20,5\n20,4\n")
    from tramline.operators import demand

    trips = demand.activity_trips(tables.person_trips_csv(spark, str(tmp_path / "p.csv")), tables.maz_nodes_csv(spark, str(tmp_path / "m.csv")))
    assert sorted(map(tuple, trips.collect())) == [(1, 1, 5, "walk", 27000), (3, 1, None, "car", 28800)]


def test_centroids(spark):
    from tramline.functions.geometry import centroid

    rings = [(1, [(0.0, 0.0), (4.0, 0.0), (4.0, 1.0), (1.0, 1.0), (1.0, 4.0), (0.0, 4.0)]), (2, [(0.0, 0.0), (2.0, 0.0), (4.0, 0.0)])]
    z = spark.createDataFrame(rings, "zone_id long, polygon array<struct<lon:double,lat:double>>")
    got = {r["zone_id"]: (round(r["x"], 6), round(r["y"], 6)) for r in z.select("zone_id", *(c.alias(n) for c, n in zip(centroid(F.col("polygon")), "xy", strict=True))).collect()}
    assert got == {1: (1.357143, 1.357143), 2: (2.0, 0.0)}


def test_small_functions(spark):
    from tramline.functions import network, traffic
    from tramline.operators import demand, routing

    row = spark.createDataFrame([([1, 2, 3, 4], 1, [9, 8])], "r array<long>, p int, s array<long>").select(
        traffic.slug(F.lit(" Ile-de-France (Paris) ")).alias("slug"), network.mode_of(F.lit("BIKE")).alias("bike"), network.mode_of(F.lit("ship")).alias("ship"), demand.mode_of(F.lit("publico")).alias("file"), demand.mode_of(F.lit(None).cast("string")).alias("none"),
        routing.spliced("r", "p", "s").alias("route"),
    )
    assert tuple(row.first()) == ("ile_de_france_paris", "bike", "car", "transit", "car", [1, 2, 9, 8])
