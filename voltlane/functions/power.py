"""Power, energy and efficiency as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the data model.
METERS_PER_MILE = 1609.344
MPS_TO_MPH = 2.23694


def power_kw(current: Column, voltage: Column) -> Column:
    """Drawn power, never negative; null if either reading is missing."""
    return F.when(current.isNotNull() & voltage.isNotNull(), F.greatest(F.lit(0.0), current * voltage / 1000))


def trapezoid_kwh(p0: Column, p1: Column, t0: Column, t1: Column) -> Column:
    return (p0 + p1) / 2 * (t1 - t0) / 3600


def step_kwh(p0: Column, p1: Column, t0: Column, t1: Column, max_gap_s: float) -> Column:
    """Energy between two successive readings; 0 over a gap, without progress or without a first reading."""
    dt = t1 - t0
    return F.when((dt > 0) & (dt <= max_gap_s), trapezoid_kwh(p0, p1, t0, t1)).otherwise(0.0)


def clipped_step_kwh(p0: Column, p1: Column, t0: Column, t1: Column, low: Column, high: Column, max_gap_s: float) -> Column:
    """The same for the part of the step inside [low, high], power read off the straight line between the readings."""
    a, b, dt = F.greatest(t0, low), F.least(t1, high), t1 - t0
    at = lambda x: p0 + (p1 - p0) * (x - t0) / dt
    return F.when((dt > 0) & (dt <= max_gap_s) & (b > a), trapezoid_kwh(at(a), at(b), a, b)).otherwise(0.0)


def step_m(d: Column, dt: Column, max_gap_s: float, max_jump_m: float, max_mps: float) -> Column:
    """Metres of a step between fixes; 0 if it is a dropout, a jump or faster than possible."""
    ok = (dt <= max_gap_s) & (d <= max_jump_m) & ((d <= 1.0) | ((dt > 0) & (d / dt <= max_mps)))
    return F.when(ok, d).otherwise(0.0)


def efficiency_mi_per_kwh(distance_m: Column, energy_wh: Column) -> Column:
    """A ratio of sums; null without energy."""
    return F.when(energy_wh > 0, (distance_m / METERS_PER_MILE) / (energy_wh / 1000))


def instant_efficiency(speed_mps: Column, kw: Column) -> Column:
    return F.when(kw > 0, speed_mps * MPS_TO_MPH / kw)
