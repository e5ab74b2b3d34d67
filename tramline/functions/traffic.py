"""Congestion, calibration and mode choice expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = ["storage_veh", "bpr_time_s", "gated_time_s", "geh", "los", "tt_ratio", "congestion_index", "flow_veh_h", "density_veh_km", "tod_bucket", "clock_label", "clock_seconds", "generalized_cost", "slug", "ema", "period_midpoint_s", "tour_mode"]


def storage_veh(length_m: Column, capacity: Column) -> Column:
    """Vehicles that an edge holds: 7.5 m each, a lane for each 1600 an hour, 50 m at least."""
    return F.greatest(F.lit(50.0), length_m) * F.greatest(F.lit(1.0), capacity / 1600.0) / 7.5


def bpr_time_s(occupancy: Column, length_m: Column, capacity: Column, free_flow: Column) -> Column:
    """Free flow under four fifths of the storage; from there on 1 + 0.15 r^4, with r up to 2."""
    store = storage_veh(length_m, capacity)
    r = occupancy / store
    return F.when((store <= 0) | (r < 0.8), free_flow).otherwise(free_flow * (1 + 0.15 * F.pow(F.least(r, F.lit(2.0)), 4)))


def gated_time_s(occupancy: Column, length_m: Column, capacity: Column, free_flow: Column, gate_wait_s: Column) -> Column:
    return bpr_time_s(occupancy, length_m, capacity, free_flow) + gate_wait_s


def geh(simulated: Column, observed: Column) -> Column:
    both_none = (simulated < 1e-6) & (observed < 1e-6)
    return F.when(both_none, F.lit(0.0)).otherwise(F.sqrt(F.pow(simulated - observed, 2) / ((simulated + observed) / 2)))


def los(ratio: Column) -> Column:
    """Level of service of a volume-capacity ratio."""
    return F.when(ratio < 0.30, "A").when(ratio < 0.55, "B").when(ratio < 0.75, "C").when(ratio < 0.90, "D").when(ratio < 1.0, "E").otherwise("F")


def tt_ratio(travel_s: Column, free_flow: Column) -> Column:
    return F.when(free_flow > 0, travel_s / free_flow).otherwise(F.lit(1.0))


def congestion_index(travel_s: Column, free_flow: Column) -> Column:
    return F.when(free_flow > 0, F.greatest(F.lit(0.0), F.least((travel_s / free_flow - 1) / 2.4, F.lit(1.0)))).otherwise(F.lit(0.0))


def flow_veh_h(occupancy: Column, travel_s: Column, capacity: Column) -> Column:
    return F.least(F.when(travel_s > 0, occupancy * 3600.0 / travel_s).otherwise(F.lit(0.0)), capacity)


def density_veh_km(occupancy: Column, length_m: Column) -> Column:
    return F.when(length_m > 0, occupancy / (length_m / 1000.0)).otherwise(F.lit(0.0))


def tod_bucket(time_s: Column) -> Column:
    """Quarter hour of the day."""
    return (F.floor(time_s / 900) % 96).cast("int")


def clock_label(time_s: Column) -> Column:
    t = F.floor(time_s).cast("long")
    return F.concat(F.lpad(F.floor(t / 3600).cast("string"), 2, "0"), F.lit(":"), F.lpad((F.floor(t / 60) % 60).cast("string"), 2, "0"))


def clock_seconds(text: Column) -> Column:
    """Seconds since midnight of "YYYY-MM-DD HH:MM:SS", or the number that the text is."""
    t = F.try_to_timestamp(text)
    return F.coalesce(text.try_cast("double"), (F.hour(t) * 3600 + F.minute(t) * 60 + F.second(t)).cast("double"))


def generalized_cost(travel_s: Column, comfort: Column, wait_s: Column, walk_s: Column, transfer_s: Column, money: Column, value_of_time: float) -> Column:
    """Seconds: waiting counts 1.5, walking 2 times, money by its value of an hour."""
    return travel_s * comfort + 1.5 * wait_s + 2.0 * walk_s + transfer_s + money * 3600.0 / value_of_time


def slug(name: Column) -> Column:
    plain = F.translate(F.lower(name), "áàäâãåéèëêíìïîóòöôõúùüûñç", "aaaaaaeeeeiiiiooooouuuunc")
    return F.btrim(F.regexp_replace(plain, "[^a-z0-9]+", "_"), F.lit("_"))


def ema(ratios: Column, weight: float = 0.2) -> Column:
    """Exponential mean of an array in order, from 1.0 on."""
    return F.aggregate(ratios, F.lit(1.0), lambda a, x: a + F.lit(weight) * (x - a))


def period_midpoint_s(period: Column) -> Column:
    """Midpoints of the five departure periods; 8 h where the period is unknown."""
    return F.when(period == 1, 16200).when(period == 2, 27000).when(period == 3, 43200).when(period == 4, 61200).when(period == 5, 82800).otherwise(28800)


def tour_mode(name: Column) -> Column:
    """Modes of person trip files."""
    return F.when(name.isin("DRIVEALONE", "SR2", "SR3PLUS"), "car").when(name.isin("WALK_LOC", "WALK_EXP"), "transit").when(name == "BIKE", "bike").when(name == "WALK", "walk").otherwise("car")
