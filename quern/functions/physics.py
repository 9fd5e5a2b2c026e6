"""Hydrology formulas as columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

WATER, GRAVITY = 1000.0, 9.81


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))


def bankfull(area: Column) -> Column:
    return 0.5 * F.pow(area, F.lit(0.8))


def manning_velocity(area: Column, roughness: Column, slope: Column) -> Column:
    radius = 0.3 * F.pow(bankfull(area), F.lit(0.4))
    return (1 / roughness) * F.pow(radius, F.lit(2.0 / 3.0)) * F.sqrt(slope)


def travel_hours(meters: Column, velocity: Column) -> Column:
    return F.when(velocity > 0, meters / velocity / 3600).otherwise(float("inf"))


def stream_power(area: Column, slope: Column) -> Column:
    return WATER * GRAVITY * bankfull(area) * slope


def conductivity(karst: Column) -> Column:
    return 1e-5 * (1 + 100 * karst * karst)


def porosity(karst: Column) -> Column:
    return 0.01 + 0.2 * karst


def conduit(karst1: Column, karst2: Column) -> Column:
    half = 0.5 * F.least(karst1, karst2)
    return math.pi * half * half


def wetness(area: Column, slope: Column) -> Column:
    return F.ln(area / (F.tan(slope) + 1e-6))


def stream_order(area: Column) -> Column:
    return F.greatest(F.lit(1.0), F.least(F.lit(7.0), F.ceil(F.log2(area / 10)).cast("double")))


def rating(flow: Column) -> Column:
    return 0.3 + 0.08 * F.pow(flow, F.lit(0.6))


def seasonal(day: Column) -> Column:
    return F.sin(2 * math.pi * day / 365.25)
