"""Origin-destination demand: from daily trip files to agents."""

from __future__ import annotations

import inspect
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import is_holiday
from ..functions.random import PRIME, hash_uniform
from .numbering import repeated

#: Modes of trip files.
MODE_NAMES = {
    "1": "car", "2": "transit", "3": "walk", "4": "bike",
    "PRIVADO_REGULAR": "car", "PRIVADO_OCASIONAL": "car", "PUBLICO": "transit", "A_PIE": "walk", "BICI": "bike", "OTRO": "car",
}
#: Shares of car, walk, bike, transit in per cent, and kilometres to assume, by distance band.
BANDS = {"0.5-2": (5, 70, 5, 20, 1.25), "2-10": (50, 10, 5, 35, 6.0), "10-50": (80, 1, 1, 18, 30.0), ">50": (90, 0, 0, 10, 70.0)}
#: The same for other bands.
OTHER_BAND = (50, 30, 10, 10, None)
MODES = ("car", "walk", "bike", "transit")


def mode_of(code: Column) -> Column:
    """Mode of a trip file's code; car for others."""
    names = F.create_map(*(F.lit(x) for pair in MODE_NAMES.items() for x in pair))
    return F.coalesce(F.try_element_at(names, F.upper(F.btrim(code))), F.lit("car"))


def daily_sums(trips: DataFrame, *keys: str) -> DataFrame:
    """Trips and kilometres of each day and key."""
    return trips.groupBy("day", *keys).agg(F.sum("trips").alias("trips"), F.sum("trip_km").alias("trip_km"))


def mean_day(trips: DataFrame, *keys: str, all_days: bool = False) -> DataFrame:
    """(keys, trips_sum, km_sum, n_days): means are sums over n_days, the days on which the key occurs; with all_days, all days of the table."""
    sums = daily_sums(trips, *keys).groupBy(*keys).agg(F.sum("trips").alias("trips_sum"), F.sum("trip_km").alias("km_sum"), F.count("*").alias("n_days"))
    if not all_days:
        return sums
    days = trips.agg(F.countDistinct("day").alias("_days"))
    return sums.crossJoin(F.broadcast(days)).withColumn("n_days", F.col("_days")).drop("_days")


def weekend_split(trips: DataFrame, holidays: list[str] = (), country: str | None = None) -> DataFrame:
    """``trips`` with day_type: Saturdays, Sundays and holidays are weekend; holidays are days of a list and those of a country."""
    free = F.weekday("day") >= 5
    if holidays:
        free = free | F.col("day").isin([F.to_date(F.lit(h)) for h in holidays])
    if country:
        free = free | is_holiday(F.col("day"), country)
    return trips.withColumn("day_type", F.when(free, "weekend").otherwise("weekday"))


def band_shares(band: Column) -> Column:
    """array of (mode, per cent, transit's per cent) of a distance band."""
    of = lambda row: F.array(*(F.struct(F.lit(m).alias("mode"), F.lit(s).alias("share"), F.lit(row[3]).alias("_t")) for m, s in zip(MODES, row, strict=False)))
    out = None
    for name, row in BANDS.items():
        out = F.when(band == name, of(row)) if out is None else out.when(band == name, of(row))
    return out.otherwise(of(OTHER_BAND))


def trip_km(od: DataFrame) -> Column:
    """Kilometres a trip: of the row, or those to assume for its band."""
    fallback = F.coalesce(*(F.when(F.col("band") == b, F.lit(r[4])) for b, r in BANDS.items()))
    return F.coalesce(F.when(F.col("trips") > 0, F.col("km") / F.col("trips")), fallback)


def mode_split(od: DataFrame, choice: Callable[..., dict[str, Column]] | None = None, transit: Column | None = None) -> DataFrame:
    """A row for each mode: ``od`` (band, trips, km) with mode and share in per cent.

    choice: of kilometres a trip (and, if it takes two arguments, of the period), shares of car, walk and bike; they are scaled to
    what the band leaves beside transit. transit: a share in per cent that replaces the band's; the others are scaled to the rest,
    unless the band is all transit.
    """
    x = od.withColumn("_s", F.explode(band_shares(F.col("band")))).select(*od.columns, "_s.*")
    if choice is not None:
        wants_period = len(inspect.signature(choice).parameters) > 1
        share = F.col("share").cast("double")
        for m, c in choice(*((trip_km(od), F.col("period")) if wants_period else (trip_km(od),))).items():
            share = F.when(F.col("mode") == m, c * (100 - F.col("_t"))).otherwise(share)
        x = x.withColumn("share", share)
    if transit is not None:
        scaled = F.col("share") * (100 - transit) / (100 - F.col("_t"))
        x = x.withColumn("share", F.when(F.col("mode") == "transit", transit.cast("double")).when(F.col("_t") < 100, scaled).otherwise(F.col("share")))
    return x.drop("_t")


def noisy(trips: Column, sigma: float, seed: int, *keys: str) -> Column:
    """Whole trips: ``trips`` times a log-normal factor of deviation sigma (none for 0), rounded half to even."""
    if sigma <= 0:
        return F.rint(trips).cast("long")
    u1, u2 = hash_uniform(seed + 11, *keys), hash_uniform(seed + 12, *keys)
    z = F.sqrt(-2 * F.log((u1 + 1) / (PRIME + 1))) * F.cos(2 * math.pi * u2 / PRIME)
    return F.rint(trips * F.exp(sigma * z)).cast("long")


def od_counts(trips: DataFrame, *, scale: float = 1.0, occupancy: float = 1.2, sigma: float = 0.0, seed: int = 42, choice: Callable[..., dict[str, Column]] | None = None, transit: Column | None = None, all_days: bool = False) -> DataFrame:
    """(origin, dest, period, band, mode, count): vehicles of a mean day from daily trips (day, origin, dest, period, band, trips, trip_km, and mode or not).

    A mode column decides the mode, else the distance band or ``choice`` splits the trips. Pairs with under half a trip go, and so do
    parts of a mode with under half a trip or, rounded, none.
    """
    keys = ["origin", "dest", "period", "band", *(["mode"] if "mode" in trips.columns else [])]
    if "mode" in keys:
        trips = trips.withColumn("mode", mode_of(F.col("mode")))
    mean = mean_day(trips, *keys, all_days=all_days)
    mean = mean.select(*keys, (F.col("trips_sum") / F.col("n_days") * scale).alias("trips"), (F.col("km_sum") / F.col("n_days") * scale).alias("km")).where("trips >= 0.5")
    parts = mean.withColumn("share", F.lit(100)) if "mode" in keys else mode_split(mean, choice, transit)
    parts = parts.withColumn("part", vehicles(F.col("trips") * F.col("share") / 100.0, F.col("mode"), occupancy)).where("part >= 0.5")
    parts = parts.withColumn("count", noisy(F.col("part"), sigma, seed, "origin", "dest", "period"))
    return parts.where("count >= 1").select("origin", "dest", "period", "band", "mode", "count")


def build_od(trips: DataFrame, pools: DataFrame, seed: int = 0, **options) -> DataFrame:
    """OD rows (origin_node, dest_node, count, mode, depart_start_s, depart_end_s) from daily trips and node pools (zone, nodes, and mode or not)."""
    counts = od_counts(trips, **options).groupBy("origin", "dest", "period", "mode").agg(F.sum("count").alias("count"))
    x = node_pairs(counts, pools, seed)
    x = x.groupBy("origin_node", "dest_node", "mode", "period").agg(F.sum("part").alias("count"))
    return x.select("origin_node", "dest_node", "count", "mode", (F.col("period") * 3600.0).alias("depart_start_s"), ((F.col("period") + 1) * 3600.0).alias("depart_end_s"))


def person_vehicle_split(parts: DataFrame, occupancy: float = 1.2) -> DataFrame:
    """(intra, person_trips, vehicle_trips) of (origin, dest, mode, trips)."""
    own = vehicles(F.col("trips"), F.col("mode"), occupancy)
    return parts.groupBy((F.col("origin") == F.col("dest")).alias("intra")).agg(F.sum("trips").alias("person_trips"), F.sum(own).alias("vehicle_trips"))


def drawn_mode(od: DataFrame, shares: dict[str, float], seed: int = 42) -> DataFrame:
    """``od`` (od_id, i) with a mode for each agent, drawn by these shares."""
    u, total, below = hash_uniform(seed + 21, "od_id", "i") / F.lit(PRIME), sum(shares.values()), 0.0
    mode = None
    for m, share in shares.items():
        below += share / total
        mode = F.when(u < below, m) if mode is None else mode.when(u < below, m)
    return od.withColumn("mode", mode.otherwise(list(shares)[-1]))


def activity_trips(persons: DataFrame, zones: DataFrame) -> DataFrame:
    """Trips of an activity plan: (person_id, origin_node, dest_node, mode, depart_s). persons: person_id, origin_maz, dest_maz,
    depart_period, trip_mode; zones: maz_id, node_id. Of a trip with a zone that has no node the node is null."""
    from ..functions.traffic import period_midpoint_s, tour_mode

    at = lambda end: zones.select(F.col("maz_id").alias(f"{end}_maz"), F.col("node_id").alias(f"{end}_node"))
    x = persons.join(at("origin"), "origin_maz", "left").join(at("dest"), "dest_maz", "left")
    return x.select("person_id", "origin_node", "dest_node", tour_mode(F.col("trip_mode")).alias("mode"), period_midpoint_s(F.col("depart_period")).alias("depart_s"))


def departure_order(agents: DataFrame) -> DataFrame:
    """``agents`` (agent_id, depart_s) with their place in the order of departure."""
    from .numbering import dense_ids

    return dense_ids(agents, "place", "depart_s", "agent_id")


def vehicles(person_trips: Column, mode: Column, occupancy: float) -> Column:
    return F.when((mode == "car") & F.lit(occupancy > 1), person_trips / occupancy).otherwise(person_trips)


def node_pairs(od: DataFrame, pools: DataFrame, seed: int = 0, most: int = 20) -> DataFrame:
    """(od columns, i, count, origin_node, dest_node): a count is split over min(count, most) pairs of nodes of the zones' pools,
    drawn with replacement; the first count % n get one more; pairs of one node go. pools: (zone, nodes array, and mode or not)."""
    by = ["mode"] if "mode" in pools.columns else []
    n = F.least(F.col("count"), F.lit(most))
    x = repeated(od.where("count >= 1").withColumn("_n", n), "_n", "i")
    x = x.withColumn("part", F.expr("count div _n") + F.when(F.col("i") < F.col("count") % F.col("_n"), 1).otherwise(0))
    o, t = (pools.select(F.col("zone").alias(z), F.col("nodes").alias(f"_{z}_nodes"), *by) for z in ("origin", "dest"))
    x = x.join(o, ["origin", *by]).join(t, ["dest", *by])
    draw = lambda z, s: F.col(f"_{z}_nodes")[(hash_uniform(s, "origin", "dest", "i") % F.size(f"_{z}_nodes")).cast("int")]
    x = x.withColumns({"origin_node": draw("origin", seed + 1), "dest_node": draw("dest", seed + 2)}).where("origin_node <> dest_node")
    return x.select(*od.columns, "i", "part", "origin_node", "dest_node")


def od_window(od: DataFrame, t_min: float, t_max: float, modes: list[str] = ()) -> DataFrame:
    """Rows whose departure window meets [t_min, t_max]; of these modes, or of all."""
    kept = od.where((F.col("depart_end_s") >= t_min) & (F.col("depart_start_s") <= t_max))
    return kept.where(F.col("mode").isin(list(modes))) if modes else kept


def uniform_departure(start: Column, end: Column, u: Column) -> Column:
    """Whole seconds from the earlier to before the later bound, cut to the day. u: 0 to PRIME - 1."""
    low, high = F.least(start, end), F.greatest(start, end)
    return F.least(F.lit(86399), F.greatest(F.lit(0), low + u * (high - low) / F.lit(PRIME)))


def agents(od: DataFrame, seed: int = 42, t_min: float = 0) -> DataFrame:
    """An agent for each trip of ``od`` (od_id, count, depart_start_s, depart_end_s): (od columns, i, depart_s)."""
    x = repeated(od, "count", "i")
    return x.withColumn("depart_s", uniform_departure(F.greatest(F.col("depart_start_s"), F.lit(t_min)), F.col("depart_end_s"), hash_uniform(seed, "od_id", "i")))


def thinned(od: DataFrame, scale: float, seed: int = 42) -> DataFrame:
    """Each trip stays with probability ``scale``; rows without a trip left go. A scale of 1 or more keeps all, of 0 or less none."""
    if scale >= 1:
        return od
    kept = repeated(od, "count", "_i").where(hash_uniform(seed, "od_id", "_i") < int(max(0.0, scale) * PRIME))
    return kept.groupBy(*[c for c in od.columns if c != "count"]).agg(F.count("*").alias("count"))


def lognormal_s(mean: float, std: float, u1: Column, u2: Column) -> Column:
    """Log-normal with this mean and deviation, by Box-Muller on two uniforms, cut to the day."""
    v = std * std
    mu, sigma = math.log(mean * mean / math.sqrt(v + mean * mean)), math.sqrt(math.log(1 + v / (mean * mean)))
    z = F.sqrt(-2 * F.log((u1 + 1) / (PRIME + 1))) * F.cos(2 * math.pi * u2 / PRIME)
    return F.least(F.lit(86399.0), F.greatest(F.lit(0.0), F.exp(mu + sigma * z)))


def empirical(draws: DataFrame, cdf: DataFrame) -> DataFrame:
    """``draws`` (u in [0, 1)) with time_s from a cumulative table (t, p) by linear interpolation; above its last p: 0."""
    w = Window.orderBy("p")  # a row a knot of the table
    knots = cdf.select("t", "p", F.lag("t").over(w).alias("t0"), F.lag("p").over(w).alias("p0"))
    knots = knots.groupBy().agg(F.array_sort(F.collect_list(F.struct("p", "t", "p0", "t0"))).alias("k"))
    x = draws.crossJoin(F.broadcast(knots)).withColumn("_k", F.try_element_at(F.filter("k", lambda k: k["p"] >= F.col("u")), F.lit(1)))
    k = F.col("_k")
    t = F.when(k.isNull(), F.lit(0.0)).when(k["p0"].isNull() | (k["p"] == k["p0"]), k["t"]).otherwise(k["t0"] + (k["t"] - k["t0"]) * (F.col("u") - k["p0"]) / (k["p"] - k["p0"]))
    return x.withColumn("time_s", t).drop("k", "_k")


def gravity_agents(nodes: DataFrame, n: int, beta: float, seed: int = 42, mean_s: float = 28800, std_s: float = 5400) -> DataFrame:
    """n agents between indexed nodes (idx, node_id, x, y): ends uniform; a far destination is redrawn once, with probability 1 - exp(-beta d)."""
    spark = nodes.sparkSession
    size = nodes.agg(F.count("*").alias("n"))
    u = lambda k: hash_uniform(seed + k, "agent_id")
    x = spark.range(n).withColumnRenamed("id", "agent_id").crossJoin(F.broadcast(size)).select("agent_id", (u(1) % F.col("n")).alias("o"), (u(2) % F.col("n")).alias("d1"), (u(3) % F.col("n")).alias("d2"), u(4).alias("u"))
    at = lambda c, p: nodes.select(F.col("idx").alias(c), F.col("node_id").alias(f"{c}_node"), F.col("x").alias(f"{c}_x"), F.col("y").alias(f"{c}_y"))
    x = x.join(at("o", ""), "o").join(at("d1", ""), "d1").join(at("d2", ""), "d2")
    d = F.sqrt(F.pow(F.col("o_x") - F.col("d1_x"), 2) + F.pow(F.col("o_y") - F.col("d1_y"), 2))
    keep = F.col("u") / PRIME < F.exp(-beta * d)
    return x.select("agent_id", F.col("o_node").alias("origin"), F.when(keep, F.col("d1_node")).otherwise(F.col("d2_node")).alias("dest"), lognormal_s(mean_s, std_s, u(5), u(6)).alias("depart_s"))


def gravity_flows(zones: DataFrame, beta: float) -> DataFrame:
    """(origin, dest, flow): production times attraction times exp(-beta d), scaled to the production. Pairs of zones are the result itself."""
    o, d = (zones.select(*(F.col(c).alias(f"{p}{c}") for c in ("zone", "x", "y", "mass"))) for p in "od")
    dist = F.sqrt(F.pow(F.col("ox") - F.col("dx"), 2) + F.pow(F.col("oy") - F.col("dy"), 2))
    x = o.join(d, F.col("ozone") != F.col("dzone")).withColumn("w", F.col("dmass") * F.exp(-beta * dist))
    return x.select(F.col("ozone").alias("origin"), F.col("dzone").alias("dest"), (F.col("omass") * F.col("w") / F.sum("w").over(Window.partitionBy("ozone"))).alias("flow"))


def radiation_flows(zones: DataFrame) -> DataFrame:
    """(origin, dest, s, flow): P_i P_j P_i / ((P_i + s)(P_i + P_j + s)), s: the mass nearer to i than j, ends left out."""
    o, d = (zones.select(*(F.col(c).alias(f"{p}{c}") for c in ("zone", "x", "y", "mass"))) for p in "od")
    dist = F.pow(F.col("ox") - F.col("dx"), 2) + F.pow(F.col("oy") - F.col("dy"), 2)
    x = o.join(d, F.col("ozone") != F.col("dzone")).withColumn("dist", dist)
    near = Window.partitionBy("ozone").orderBy("dist", "dzone").rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumn("s", F.coalesce(F.sum("dmass").over(near), F.lit(0)))
    m, n, s = F.col("omass"), F.col("dmass"), F.col("s")
    return x.select(F.col("ozone").alias("origin"), F.col("dzone").alias("dest"), "s", (m * m * n / ((m + s) * (m + n + s))).alias("flow"))


def choice_shares(options: DataFrame, trip: str = "trip") -> DataFrame:
    """Multinomial logit: ``options`` (trip, mode, utility, available) with share; the exponent is taken from the trip's best."""
    w = Window.partitionBy(trip)
    e = F.when(F.col("available"), F.exp(F.col("utility") - F.max(F.when(F.col("available"), F.col("utility"))).over(w))).otherwise(F.lit(0.0))
    x = options.withColumn("_e", e)
    return x.withColumn("share", F.col("_e") / F.sum("_e").over(w)).drop("_e")


#: Constants by mode, then factors of time, money, waiting, walking and transfers.
MNL_CONSTANTS = {"car": 0.0, "bike": -0.5, "walk": -0.8, "transit": -0.3}
MNL_FACTORS = {"time": -0.015, "cost": -0.20, "wait": -0.025, "walk": -0.030, "transfer": -300.0}


def utility(mode: Column, time_s: Column, money: Column, wait_s: Column, walk_s: Column, transfers: Column) -> Column:
    base = F.coalesce(*(F.when(mode == m, F.lit(c)) for m, c in MNL_CONSTANTS.items()))
    f = MNL_FACTORS
    return base + f["time"] * time_s + f["cost"] * money + f["wait"] * wait_s + f["walk"] * walk_s + f["transfer"] * transfers
