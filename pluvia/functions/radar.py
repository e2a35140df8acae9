"""Reflectivity, rain rate, trend and probability expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NO_ECHO = -32.0
RAIN, LIKELY, HEAVY = 20.0, 30.0, 40.0


def rain_rate(dbz: Column) -> Column:
    """mm/h from dBZ by Z = 200 R^1.6; nothing under 15, capped at 55."""
    return F.when(dbz < 15, 0.0).otherwise(F.pow(F.pow(F.lit(10.0), F.least(dbz, F.lit(55.0)) / 10) / 200, F.lit(1 / 1.6)))


def dbz_of(rate: Column) -> Column:
    return 10 * F.log10(200 * F.pow(rate, F.lit(1.6)))


def intensity(dbz: Column) -> Column:
    """The matching signal."""
    return F.when(dbz < 10, 0.0).otherwise(F.least(dbz, F.lit(65.0)) - 10)


def trended(dbz: Column, rate: Column, minute: Column, tau: float = 20.0, cap: float = 60.0) -> Column:
    """Echo after some minutes of a trend that saturates with time constant tau."""
    delta = rate * tau * (1 - F.exp(-minute / tau))
    return F.when((minute > 0) & (dbz >= 10), F.least(dbz + delta, F.lit(cap))).otherwise(dbz)


def probability_radius(minute: Column) -> Column:
    return (F.lit(2) + F.floor(minute * 8 / 60)).cast("int")


def probability_bin(p: Column, bins: int = 20) -> Column:
    return F.least((p * bins).cast("int"), F.lit(bins - 1))


def subpixel(left: Column, centre: Column, right: Column) -> Column:
    """Offset of a parabola's top from the centre, within half a pixel; 0 if it has no top."""
    d = left - 2 * centre + right
    return F.when(d >= 0, 0.0).otherwise(F.greatest(F.lit(-0.5), F.least(F.lit(0.5), (left - right) / (2 * d))))
