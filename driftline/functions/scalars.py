"""Scalar expressions of the engine, as Columns; register() also makes them SQL functions."""

from __future__ import annotations

import math

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

EARTH_KM = 6371.0
#: Microseconds of a year of 365.25 days.
YEAR_US = 31_557_600_000_000
#: The shortest closure of months with storms.
STORM_MONTHS = (10, 11, 12, 1, 2, 3)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def circular_difference(a: Column, b: Column) -> Column:
    """Degrees between two directions, 0 to 180."""
    d = F.pmod(F.abs(a - b), F.lit(360.0))
    return F.least(d, 360.0 - d)


def wind_speed(u: Column, v: Column) -> Column:
    return F.sqrt(u * u + v * v)


def wind_from(u: Column, v: Column) -> Column:
    """The direction that a wind with eastward part u and northward part v comes from, in degrees."""
    return F.pmod(F.degrees(F.atan2(u, v)) + 180.0, F.lit(360.0))


def direction_parts(angle: Column) -> tuple[Column, Column]:
    """Sine and cosine of an angle in degrees."""
    return F.sin(F.radians(angle)), F.cos(F.radians(angle))


def is_storm_month(ts: Column) -> Column:
    return F.month(ts).isin(*STORM_MONTHS)


def gpd_return_level(u: Column, sigma: Column, xi: Column, per_year: Column, years: Column) -> Column:
    """The level that excesses over u, at this rate a year, reach once in so many years."""
    m = per_year * years
    return F.when(F.abs(xi) < 1e-8, u + sigma * F.log(m)).otherwise(u + sigma / xi * (F.pow(m, xi) - 1))


def weibull_cdf(x: Column, shape: Column, scale: Column) -> Column:
    return F.when(x <= 0, 0.0).otherwise(1.0 - F.exp(-F.pow(x / scale, shape)))


def shift_to_positive(value: Column, least: Column, always: bool = False) -> Column:
    """value made positive for a power transform: by max(0, -least) + 1e-6 always, or only if least <= 0 by -least + 1e-6."""
    if always:
        return value + F.greatest(F.lit(0.0), -least) + 1e-6
    return F.when(least <= 0, value - least + 1e-6).otherwise(value)


def replicates(n: Column) -> Column:
    """How many resamples an interval of n values takes: fewer for long records."""
    return F.when(n >= 500_000, 200).when(n >= 50_000, 500).otherwise(1000).cast("long")


def normal_two_sided(z: Column) -> Column:
    """Two-sided tail of the standard normal distribution, from a rational form of erfc (error below 1.2e-7)."""
    x = F.abs(z) / math.sqrt(2.0)
    t = 1.0 / (1.0 + 0.5 * x)
    # Coefficients of the rational Chebyshev form of erfc.
    coefficients = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)
    poly: Column = F.lit(0.0)
    for c in reversed(coefficients):
        poly = poly * t + c
    return t * F.exp(-x * x + poly)


def floats(text: Column) -> Column:
    """A list of numbers written with commas, as array<double>."""
    return F.transform(F.split(text, ","), lambda x: F.trim(x).cast("double"))


def register(spark: SparkSession) -> None:
    """SQL functions haversine_km, circ_diff, snap_us and gpd_return_level, as SQL expressions that Catalyst inlines."""
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION haversine_km(a DOUBLE, b DOUBLE, c DOUBLE, d DOUBLE) RETURNS DOUBLE RETURN 2 * {EARTH_KM} * asin(least(1D, sqrt(pow(sin(radians(c - a) / 2), 2) + cos(radians(a)) * cos(radians(c)) * pow(sin(radians(d - b) / 2), 2))))")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION circ_diff(a DOUBLE, b DOUBLE) RETURNS DOUBLE RETURN least(pmod(abs(a - b), 360D), 360D - pmod(abs(a - b), 360D))")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION snap_us(us BIGINT, f BIGINT) RETURNS BIGINT RETURN (us div f + if(2 * (us % f) > f or (2 * (us % f) = f and (us div f) % 2 = 1), 1, 0)) * f")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION gpd_return_level(u DOUBLE, s DOUBLE, x DOUBLE, r DOUBLE, y DOUBLE) RETURNS DOUBLE RETURN if(abs(x) < 1e-8, u + s * ln(r * y), u + s / x * (pow(r * y, x) - 1))")
