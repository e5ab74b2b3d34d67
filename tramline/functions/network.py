"""Road network expressions: access, free-flow times, capacities, OSM tags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = ["ROAD_CLASSES", "CLASS_DEFAULTS", "accessible", "free_flow_s", "mode_free_flow_s", "effective_capacity", "maxspeed_kmh", "lane_count", "oneway", "edge_flags", "restriction_kind", "node_type", "has_access", "mode_of"]

#: Road classes from the fastest to the slowest, by code; (km/h, lanes, vehicles an hour and lane) where tags are silent.
CLASS_DEFAULTS = {
    "motorway": (120, 2, 2000),
    "motorway_link": (80, 1, 1500),
    "trunk": (100, 2, 1800),
    "trunk_link": (60, 1, 1400),
    "primary": (80, 2, 1600),
    "primary_link": (50, 1, 1200),
    "secondary": (60, 1, 1000),
    "secondary_link": (40, 1, 900),
    "tertiary": (50, 1, 800),
    "tertiary_link": (30, 1, 700),
    "residential": (30, 1, 600),
    "living_street": (10, 1, 200),
    "service": (30, 1, 600),
    "unclassified": (30, 1, 500),
    "track": (20, 1, 400),
    "cycleway": (15, 1, 300),
    "footway": (5, 1, 600),
    "path": (5, 1, 400),
    "steps": (2, 1, 200),
}
ROAD_CLASSES = list(CLASS_DEFAULTS)
#: Free-flow seconds where there is no speed.
NEVER = 1e9


def accessible(road_class: Column, mode: Column) -> Column:
    """Cars: classes up to 13; bikes: all but 0, 1 and 18; walkers: all but 0 and 1; other modes: all."""
    return F.when(mode == "car", road_class <= 13).when(mode == "bike", ~road_class.isin(0, 1, 18)).when(mode == "walk", ~road_class.isin(0, 1)).otherwise(F.lit(True))


def free_flow_s(length_m: Column, speed_ms: Column) -> Column:
    return F.when(speed_ms > 0, length_m / speed_ms).otherwise(F.lit(NEVER))


def mode_free_flow_s(length_m: Column, speed_ms: Column, mode: Column, walk: float = 1.39, bike: float = 4.17) -> Column:
    """Walkers and bikes go at their own speed at most, and at it where the edge has none."""
    own = F.when(mode == "walk", F.lit(walk)).when(mode == "bike", F.lit(bike))
    speed = F.when(own.isNull(), speed_ms).otherwise(F.least(F.when(speed_ms > 0, speed_ms).otherwise(own), own))
    return free_flow_s(length_m, speed)


def effective_capacity(base: Column, kind: Column, green_s: Column, cycle_s: Column) -> Column:
    """Capacity behind a junction. kind: 1 stop, 3 signal, 4 roundabout, 5 mini roundabout; others keep the base."""
    share = F.when(green_s.isNull() | cycle_s.isNull() | (cycle_s <= 0), F.lit(0.45)).otherwise(green_s / cycle_s)
    return F.when(kind == 3, base * share * 0.90).when(kind == 1, base * 0.60).when(kind.isin(4, 5), base * 0.75).otherwise(base)


def maxspeed_kmh(tag: Column, default: Column) -> Column:
    """Leading number of the tag, miles turned to km; the default where there is none or it is not positive."""
    number = F.regexp_extract(tag, r"^\s*([0-9]*\.?[0-9]+)", 1).try_cast("double")
    speed = F.when(F.contains(tag, F.lit("mph")), number * 1.60934).otherwise(number)
    return F.when(speed > 0, speed).otherwise(default.cast("double"))


def lane_count(tag: Column, default: Column) -> Column:
    n = F.regexp_extract(tag, r"^\s*([0-9]+)", 1).try_cast("int")
    return F.when(n > 0, n).otherwise(default.cast("int"))


def oneway(tag: Column) -> Column:
    """1: with the way, -1: against it, 0: both."""
    return F.when(tag == "-1", -1).when(tag.isin("yes", "1", "true"), 1).otherwise(0)


def edge_flags(one_way: Column, bridge: Column, tunnel: Column, roundabout: Column, backward: Column) -> Column:
    """Bits: one-way 1, bridge 8, tunnel 16, roundabout 32, reversed 64."""
    bit = lambda c, v: F.when(c, F.lit(v)).otherwise(F.lit(0))
    return bit(one_way, 1).bitwiseOR(bit(bridge, 8)).bitwiseOR(bit(tunnel, 16)).bitwiseOR(bit(roundabout, 32)).bitwiseOR(bit(backward, 64))


def restriction_kind(tag: Column) -> Column:
    return F.when(tag.startswith("no_"), "no").when(tag.startswith("only_"), "only")


def node_type(tags: Column) -> Column:
    """0 simple, 1 stop or give way, 3 signal, 5 mini roundabout."""
    h = tags["highway"]
    return F.when(h == "traffic_signals", 3).when(h.isin("stop", "give_way"), 1).when(h == "mini_roundabout", 5).otherwise(0)


def has_access(tags: Column) -> Column:
    """The most particular of the access tags must not exclude cars; silence lets them in."""
    said = F.coalesce(tags["motor_vehicle"], tags["motorcar"], tags["access"])
    return F.coalesce(~said.isin("no", "emergency", "military"), F.lit(True))


def mode_of(name: Column) -> Column:
    """Mode of a name in any case; car where it is unknown."""
    low = F.lower(name)
    return F.when(low.isin("car", "transit", "bike", "walk"), low).otherwise("car")
