"""Cleaning and checking of directed road graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import Steps, connected_components, shuffled, written


def without_loops(edges: DataFrame) -> DataFrame:
    return edges.where("from_node <> to_node")


def deduplicated(edges: DataFrame, id_col: str = "edge_id") -> DataFrame:
    """Of parallel edges the one with most capacity, of equals the earliest; by aggregation, so hot pairs combine before the shuffle."""
    best = F.min_by(F.struct(*edges.columns), F.struct(-F.col("capacity"), F.col(id_col)))
    return edges.groupBy("from_node", "to_node").agg(best.alias("e")).select("e.*")


def neighbours(edges: DataFrame) -> DataFrame:
    """(node, near): undirected, each once, without loops."""
    both = edges.select(F.explode(F.array(F.struct(F.col("from_node").alias("node"), F.col("to_node").alias("near")), F.struct(F.col("to_node").alias("node"), F.col("from_node").alias("near")))).alias("x")).select("x.*")
    return both.where("node <> near").distinct()


def degree_two(edges: DataFrame, nodes: DataFrame, min_length: float = 20.0) -> DataFrame:
    """(node_id, a, b, balanced): simple nodes with two neighbours that may be contracted: as many edges in from one side as out to
    the other (balanced), or else an edge under ``min_length`` m at them (0: never)."""
    two = neighbours(edges).groupBy("node").agg(F.count("*").alias("n"), F.min("near").alias("a"), F.max("near").alias("b")).where("n = 2")
    two = two.join(nodes.where("intersection_type = 0").select(F.col("node_id").alias("node")), "node")
    ends = edges.where("from_node <> to_node")
    touching = ends.select(F.explode(F.array(F.struct(F.col("from_node").alias("node"), F.col("to_node").alias("near"), F.lit(1).alias("out")), F.struct(F.col("to_node").alias("node"), F.col("from_node").alias("near"), F.lit(0).alias("out")))).alias("x"), "length_m").select("x.*", "length_m")
    x = touching.join(two, "node").groupBy("node", "a", "b").agg(
        *(F.sum(F.when((F.col("near") == F.col(s)) & (F.col("out") == o), 1).otherwise(0)).alias(f"{n}_{s}") for s in "ab" for o, n in ((0, "in"), (1, "out"))), F.min("length_m").alias("shortest")
    )
    balanced = (F.col("in_a") == F.col("out_b")) & (F.col("in_b") == F.col("out_a"))
    return x.where(balanced | (F.col("shortest") < min_length)).select(F.col("node").alias("node_id"), "a", "b", balanced.alias("balanced"))


def contracted(edges: DataFrame, nodes: DataFrame, min_length: float = 20.0) -> DataFrame:
    """``edges`` without chains of balanced degree-two nodes: each chain becomes one edge a direction.

    Lengths add up; speed and capacity are the least of the chain; geometries (points), if there are any, are joined; other columns
    come from its first edge. Chains are components of
    eligible nodes; in a chain, edges are put in order by pointer doubling (the number of rounds is the logarithm of its length).
    Closed rings of eligible nodes keep the node with the least id.
    """
    eligible = degree_two(edges, nodes, 0).where("balanced").select("node_id")
    pairs = edges.join(eligible, edges.from_node == eligible.node_id, "left_semi").join(eligible, edges.to_node == eligible.node_id, "left_semi").select("from_node", "to_node")
    chain = connected_components(pairs, "from_node", "to_node")
    open_ = neighbours(edges).join(eligible, F.col("near") == F.col("node_id"), "left_anti").select("node").distinct()
    anchored = chain.join(open_, "node", "left_semi").select("component").distinct()
    rings = chain.join(anchored, "component", "left_anti").select("component").distinct().select(F.col("component").alias("node_id"))
    eligible = written(eligible.join(rings, "node_id", "left_anti"), "eligible")

    # Every edge points to the edge that goes on from it through an eligible node, if there is one.
    line = ["points"] if "points" in edges.columns else []
    e = edges.select("edge_id", "from_node", "to_node", "length_m", "speed_ms", "capacity", *line)
    inner = e.join(eligible, e.to_node == eligible.node_id, "left_semi")
    follow = inner.alias("x").join(e.alias("y"), (F.col("x.to_node") == F.col("y.from_node")) & (F.col("x.from_node") != F.col("y.to_node"))).groupBy("x.edge_id").agg(F.min("y.edge_id").alias("next"))
    state = e.join(follow, "edge_id", "left").select("edge_id", F.col("to_node").alias("end"), "length_m", "speed_ms", "capacity", "next", *line)
    steps = Steps(edges.sparkSession)
    state = steps.keep(state, "chain")
    for _ in range(64):
        if state.where("next is not null").limit(1).count() == 0:
            break
        n = state.select(F.col("edge_id").alias("next"), *(F.col(c).alias(f"n_{c}") for c in ("end", "length_m", "speed_ms", "capacity", "next", *line)))
        j = state.join(n, "next", "left")
        on = [F.concat("points", F.coalesce(F.slice("n_points", F.lit(2), F.size("n_points")), F.slice("points", 1, 0))).alias("points")] if line else []
        state = steps.keep(j.select("edge_id", F.coalesce("n_end", "end").alias("end"), (F.col("length_m") + F.coalesce("n_length_m", F.lit(0))).alias("length_m"), F.least("speed_ms", "n_speed_ms").alias("speed_ms"), F.least("capacity", "n_capacity").alias("capacity"), F.col("n_next").alias("next"), *on), "chain")
    heads = edges.join(eligible, edges.from_node == eligible.node_id, "left_anti").drop("to_node", "length_m", "speed_ms", "capacity", *line)
    return heads.join(state.select("edge_id", F.col("end").alias("to_node"), "length_m", "speed_ms", "capacity", *line), "edge_id").where("from_node <> to_node").select(*edges.columns)


def large_components(edges: DataFrame, least: int = 5, of: DataFrame | None = None) -> DataFrame:
    """Edges of weak components that are the largest or have ``least`` nodes or more. of: (node, component), if these are known."""
    of = written(connected_components(edges, "from_node", "to_node"), "components") if of is None else of
    sizes = of.groupBy("component").agg(F.count("*").alias("n"))
    top = sizes.agg(F.max("n").alias("top"))
    keep = sizes.crossJoin(F.broadcast(top)).where((F.col("n") >= least) | (F.col("n") == F.col("top"))).select("component")
    nodes = of.join(keep, "component", "left_semi").select(F.col("node").alias("from_node"))
    return edges.join(nodes, "from_node", "left_semi")


def reached(edges: DataFrame, start: DataFrame, rounds: int = 1000) -> DataFrame:
    """(node): nodes that directed edges reach from ``start`` (node), itself included; a frontier round by round."""
    seen = written(start.select("node").distinct(), "seen")
    front = seen
    for _ in range(rounds):
        front = written(edges.join(front, edges.from_node == front.node).select(F.col("to_node").alias("node")).distinct().join(seen, "node", "left_anti"), "front")
        if front.isEmpty():
            return seen
        seen = seen.unionByName(front)
    raise RuntimeError("no fixed point")


def drawn_together(edges: DataFrame, by: tuple[str, ...] = (), rounds: int = 100_000) -> tuple[DataFrame, DataFrame]:
    """((by, node, part), (by, from_node, to_node)): nodes drawn together as long as edges join two parts both ways, and the edges that are left between parts.

    A part is named by its least node and lies in one strong component. A chain of such pairs is one round, whatever its length;
    parts without an edge in or out lose their edges.
    """
    keys = list(by)
    lefts, ofs = Steps(edges.sparkSession), Steps(edges.sparkSession)
    ends = edges.select(*keys, F.explode(F.array("from_node", "to_node")).alias("node")).distinct()
    of = ofs.keep(ends.withColumn("part", F.col("node")), "parts")
    left = lefts.keep(edges.where("from_node <> to_node").select(*keys, "from_node", "to_node").distinct(), "left")
    for _ in range(rounds):
        back = left.where("from_node > to_node").select(*keys, F.col("to_node").alias("from_node"), F.col("from_node").alias("to_node"))
        pairs = written(left.where("from_node < to_node").join(shuffled(back), [*keys, "from_node", "to_node"], "left_semi"), "pairs")
        if pairs.isEmpty():
            return of, left
        one = written(connected_components(pairs, "from_node", "to_node", by=by), "one")
        at = lambda c: shuffled(one.select(*keys, F.col("node").alias(c), F.col("component").alias(f"_{c}")))
        named = lambda c: F.coalesce(f"_{c}", c).alias(c)
        of = ofs.keep(of.join(at("part"), [*keys, "part"], "left").select(*keys, "node", named("part")), "parts")
        left = left.join(at("from_node"), [*keys, "from_node"], "left").join(at("to_node"), [*keys, "to_node"], "left").select(*keys, named("from_node"), named("to_node"))
        left = lefts.keep(left.where("from_node <> to_node").distinct(), "left")
        into, out = left.select(*keys, F.col("to_node").alias("from_node")).distinct(), left.select(*keys, F.col("from_node").alias("to_node")).distinct()
        left = lefts.keep(left.join(shuffled(into), [*keys, "from_node"], "left_semi").join(shuffled(out), [*keys, "to_node"], "left_semi"), "left")
    raise RuntimeError(f"pairs left after {rounds} rounds")


def strong_components(edges: DataFrame, by: tuple[str, ...] = (), rounds: int = 100_000, hops: int = 6) -> DataFrame:
    """(by, node, component): for each node of an edge the least node of its strong component. With ``by`` several networks are searched side by side.

    First what edges join both ways is drawn together (``drawn_together``), round by round, until no two parts have edges both
    ways; on street networks little is left. The rest is coloured (Orzan 2004): each node gets the greatest node that reaches it.
    A node that kept its own colour is the pivot of that
    colour, and what reaches the pivot within its colour is its component. So every round settles a component for each colour, all
    at once; settled nodes go, and the next round colours the rest. Colours and marks spread by joins, ``hops`` edges between two
    looks at what is known; nodes without an edge in or out are settled before.
    """
    keys = list(by)
    lefts, colours, inners, marks = (Steps(edges.sparkSession, held=n) for n in (2, 2, 1, 2))
    ends = lambda e: e.select(*keys, F.explode(F.array("from_node", "to_node")).alias("node")).distinct()
    of, left = drawn_together(edges, by, rounds)
    left = lefts.keep(left, "left")
    found: list[DataFrame] = []
    for _ in range(rounds):
        into, out = left.select(*keys, F.col("to_node").alias("from_node")).distinct(), left.select(*keys, F.col("from_node").alias("to_node")).distinct()
        left = lefts.keep(left.join(shuffled(into), [*keys, "from_node"], "left_semi").join(shuffled(out), [*keys, "to_node"], "left_semi"), "left")
        if left.isEmpty():
            break
        step = left.withColumnRenamed("from_node", "node")
        colour = front = colours.keep(ends(left).withColumn("colour", F.col("node")), "colour")
        while not front.isEmpty():
            gone, ahead = None, front
            for _ in range(hops):
                ahead = ahead.join(shuffled(step), [*keys, "node"]).groupBy(*keys, "to_node").agg(F.max("colour").alias("colour")).withColumnRenamed("to_node", "node")
                gone = ahead if gone is None else gone.unionByName(ahead)
            new = gone.groupBy(*keys, "node").agg(F.max("colour").alias("new"))
            both = colours.keep(colour.join(shuffled(new), [*keys, "node"], "left").select(*keys, "node", F.greatest("colour", "new").alias("colour"), (F.col("new") > F.col("colour")).alias("better")), "colour")
            colour, front = both.drop("better"), both.where("better").drop("better")
        at = lambda c, n: colour.select(*keys, F.col("node").alias(c), F.col("colour").alias(n))
        inner = left.join(shuffled(at("from_node", "a")), [*keys, "from_node"]).join(shuffled(at("to_node", "b")), [*keys, "to_node"]).where("a = b")
        inner = inners.keep(inner.select(*keys, F.col("to_node").alias("node"), "from_node"), "inner")
        # A mark keeps the colour it spreads: inner edges join nodes of one colour only.
        seen = front = marks.keep(colour.where("node = colour"), "seen")
        while not front.isEmpty():
            gone, ahead = None, front
            for _ in range(hops):
                ahead = ahead.join(shuffled(inner), [*keys, "node"]).select(*keys, F.col("from_node").alias("node"), "colour").distinct()
                gone = ahead if gone is None else gone.unionByName(ahead)
            both = gone.select(*keys, "node", "colour", F.lit(1).alias("n")).unionByName(seen.select(*keys, "node", "colour", F.lit(0).alias("n")))
            both = marks.keep(both.groupBy(*keys, "node", "colour").agg((F.min("n") == 1).alias("new")), "seen")
            seen, front = both.drop("new"), both.where("new").drop("new")
        found.append(written(seen, "strong"))
        gone = found[-1].select(*keys, "node")
        left = lefts.keep(left.join(shuffled(gone.withColumnRenamed("node", "from_node")), [*keys, "from_node"], "left_anti").join(shuffled(gone.withColumnRenamed("node", "to_node")), [*keys, "to_node"], "left_anti"), "left")
    else:
        raise RuntimeError(f"edges left after {rounds} rounds")
    parts = of.select(*keys, F.col("part").alias("node")).distinct().withColumn("colour", F.lit(None).cast("long"))
    for x in found:
        parts = parts.unionByName(x)
    parts = parts.groupBy(*keys, "node").agg(F.coalesce(F.max("colour"), F.col("node")).alias("colour"))
    least = parts.groupBy(*keys, "colour").agg(F.min("node").alias("component"))
    parts = parts.join(shuffled(least), [*keys, "colour"]).select(*keys, F.col("node").alias("part"), "component")
    return of.join(shuffled(parts), [*keys, "part"]).select(*keys, "node", "component")


def largest_scc(edges: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, node): the largest strong component, the one with the least id of equals."""
    keys, parts = list(by), written(strong_components(edges, by), "parts")
    sizes = parts.groupBy(*keys, "component").agg(F.count("*").alias("n"))
    best = sizes.groupBy(*keys).agg(F.min_by("component", F.struct(-F.col("n"), "component")).alias("component"))
    return parts.join(shuffled(best.where("component IS NOT NULL")), [*keys, "component"], "left_semi").select(*keys, "node")


def accessible_nodes(edges: DataFrame, mode: str) -> DataFrame:
    """(node): nodes with an edge out that the mode may use; if there are none, all nodes with an edge out."""
    from ..functions.network import accessible

    out = edges.select(F.col("from_node").alias("node"), accessible(F.col("road_class"), F.lit(mode)).alias("ok")).groupBy("node").agg(F.max("ok").alias("ok"))
    return out.where("ok") if not out.where("ok").isEmpty() else out.select("node")


def mode_pools(pools: DataFrame, edges: DataFrame, modes: tuple[str, ...]) -> DataFrame:
    """``pools`` (zone, node) for each mode (zone, node, mode): nodes in the largest strong component of what the mode may use."""
    from ..functions.network import accessible

    each = edges.withColumn("mode", F.explode(F.array(*map(F.lit, modes)))).where(accessible(F.col("road_class"), F.col("mode")))
    own = largest_scc(each, ("mode",))
    return pools.join(shuffled(own), "node").select("zone", "node", "mode")


def scc_coverage(edges: DataFrame, modes: tuple[str, ...]) -> DataFrame:
    """(mode, n_scc, n_nodes): how many of all nodes the largest strong component of each mode holds."""
    all_ = edges.select(F.explode(F.array("from_node", "to_node")).alias("node")).distinct()
    own = mode_pools(all_.withColumn("zone", F.lit(0)), edges, modes)
    return own.groupBy("mode").agg(F.count("*").alias("n_scc")).crossJoin(F.broadcast(all_.agg(F.count("*").alias("n_nodes"))))


def turn_edges(steps: DataFrame, edges: DataFrame, cost: str) -> DataFrame:
    """(id, pos, edge_id) of node sequences (id, pos, node): of edges between two neighbours the cheapest, of equals the least id."""
    x = steps.withColumn("to_node", F.lead("node").over(Window.partitionBy("id").orderBy("pos", "node"))).where("to_node IS NOT NULL")
    best = edges.groupBy(F.col("from_node").alias("node"), "to_node").agg(F.min_by("edge_id", F.struct(cost, "edge_id")).alias("edge_id"))
    return x.join(best, ["node", "to_node"], "left").select("id", "pos", "edge_id")


def near_points(nodes: DataFrame, points: DataFrame, cell_deg: float, within_m: float) -> DataFrame:
    """(point_id, node_id, distance_m): all nodes within a distance of each point, by cells and their eight neighbours."""
    from ..functions.geometry import haversine_m

    cell = lambda c: F.floor(F.col(c) / cell_deg)
    n = nodes.select("node_id", F.col("lon").alias("n_lon"), F.col("lat").alias("n_lat"), cell("lon").alias("cx"), cell("lat").alias("cy"))
    around = F.explode(F.array(*(F.struct((cell("lon") + x).alias("cx"), (cell("lat") + y).alias("cy")) for x in (-1, 0, 1) for y in (-1, 0, 1))))
    p = points.withColumn("c", around).select("point_id", "lon", "lat", "c.*")
    d = haversine_m(F.col("lon"), F.col("lat"), F.col("n_lon"), F.col("n_lat"))
    return p.join(n, ["cx", "cy"]).withColumn("distance_m", d).where(F.col("distance_m") <= within_m).select("point_id", "node_id", "distance_m")


def violations(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(check, n): how many rows break each rule of a valid graph."""
    known = nodes.select(F.col("node_id"))
    parts = [
        ("self_loop", edges.where("from_node = to_node")),
        ("unknown_from", edges.join(known, edges.from_node == known.node_id, "left_anti")),
        ("unknown_to", edges.join(known, edges.to_node == known.node_id, "left_anti")),
        ("parallel", edges.groupBy("from_node", "to_node").count().where("count > 1")),
    ]
    if "points" in edges.columns:
        parts.append(("short_geometry", edges.where("points IS NULL OR size(points) < 2")))
        if "lon" in nodes.columns:  # a line begins and ends where its edge's nodes are
            at = lambda c: nodes.select(F.col("node_id").alias(f"{c}_node"), F.col("lon").alias(f"_{c}_lon"), F.col("lat").alias(f"_{c}_lat"))
            off = lambda i, c: (F.abs(F.element_at("points", i)["lon"] - F.col(f"_{c}_lon")) > 1e-6) | (F.abs(F.element_at("points", i)["lat"] - F.col(f"_{c}_lat")) > 1e-6)
            placed = edges.where("size(points) >= 2").join(at("from"), "from_node").join(at("to"), "to_node")
            parts.append(("torn_geometry", placed.where(off(1, "from") | off(-1, "to"))))
    out = None
    for name, bad in parts:
        row = bad.agg(F.count("*").alias("n")).select(F.lit(name).alias("check"), "n")
        out = row if out is None else out.unionByName(row)
    return out


def snapped(nodes: DataFrame, points: DataFrame, cell_deg: float, within_m: float) -> DataFrame:
    """(point_id, node_id, distance_m): the nearest node of each point within a distance."""
    return near_points(nodes, points, cell_deg, within_m).groupBy("point_id").agg(F.min(F.struct("distance_m", "node_id")).alias("x")).select("point_id", "x.node_id", "x.distance_m")


def within_zones(points: DataFrame, zones: DataFrame, cell_deg: float) -> DataFrame:
    """(point columns, zone_id): spatial join, by the cells that a zone's box covers, then point in polygon.

    zones: (zone_id, polygon array<struct<lon, lat>>). Many cells of a large zone spread its points over tasks.
    """
    from ..functions.geometry import point_in_polygon

    low, high = (lambda c: F.floor(F.array_min(F.transform("polygon", lambda p: p[c])) / cell_deg)), (lambda c: F.floor(F.array_max(F.transform("polygon", lambda p: p[c])) / cell_deg))
    z = zones.select("zone_id", "polygon", F.explode(F.sequence(low("lon"), high("lon"))).alias("cx"), low("lat").alias("l"), high("lat").alias("h")).select("zone_id", "polygon", "cx", F.explode(F.sequence("l", "h")).alias("cy"))
    p = points.withColumns({"cx": F.floor(F.col("lon") / cell_deg), "cy": F.floor(F.col("lat") / cell_deg)})
    return p.join(z, ["cx", "cy"]).where(point_in_polygon(F.col("lon"), F.col("lat"), F.col("polygon"))).select(*points.columns, "zone_id")


def ranked_first(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """The first row of each key in an order."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")
