"""Public holidays as columns: Easter by arithmetic, and what each country keeps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Holidays of whole countries, as (month, day) and as days after Easter Sunday.
HOLIDAYS: dict[str, tuple[list[tuple[int, int]], list[int]]] = {
    "DE": ([(1, 1), (5, 1), (10, 3), (12, 25), (12, 26)], [-2, 1, 39, 50]),
    "ES": ([(1, 1), (1, 6), (5, 1), (8, 15), (10, 12), (11, 1), (12, 6), (12, 8), (12, 25)], [-2]),
    "FR": ([(1, 1), (5, 1), (5, 8), (7, 14), (8, 15), (11, 1), (11, 11), (12, 25)], [1, 39, 50]),
    "IT": ([(1, 1), (1, 6), (4, 25), (5, 1), (6, 2), (8, 15), (11, 1), (12, 8), (12, 25), (12, 26)], [0, 1]),
    "PT": ([(1, 1), (4, 25), (5, 1), (6, 10), (8, 15), (10, 5), (11, 1), (12, 1), (12, 8), (12, 25)], [-2, 0, 60]),
}


def easter(year: Column) -> Column:
    """Easter Sunday of a year of the Gregorian calendar: the golden number, the moon's age by century, and the Sunday after."""
    div = lambda a, b: F.floor(a / b)
    century, golden = div(year, F.lit(100)), year % 19
    epact = (19 * golden + century - div(century, F.lit(4)) - div(century - div(century + 8, F.lit(25)) + 1, F.lit(3)) + 15) % 30
    sunday = (32 + 2 * (century % 4) + 2 * div(year % 100, F.lit(4)) - epact - year % 100 % 4) % 7
    late = epact + sunday - 7 * div(golden + 11 * epact + 22 * sunday, F.lit(451)) + 114
    return F.make_date(year.cast("int"), div(late, F.lit(31)).cast("int"), (late % 31 + 1).cast("int"))


def is_holiday(day: Column, country: str) -> Column:
    """Whether a date is a public holiday of the whole country (its two letters)."""
    if country not in HOLIDAYS:
        raise ValueError(f"no holidays of {country!r}; there are {', '.join(sorted(HOLIDAYS))}")
    fixed, moving = HOLIDAYS[country]
    return (100 * F.month(day) + F.day(day)).isin([100 * m + d for m, d in fixed]) | F.datediff(day, easter(F.year(day))).isin(moving)
