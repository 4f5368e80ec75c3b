"""Distances and gate crossings as column expressions; they stay inside whole-stage code."""

from __future__ import annotations

import math
from math import radians

from pyspark.sql import Column
from pyspark.sql import functions as F

# Mean earth radius, and the WGS84 ellipsoid.
EARTH_RADIUS_M = 6371000.0
WGS84_A = 6378137.0
WGS84_F = 1 / 298.257223563
WGS84_E2 = WGS84_F * (2 - WGS84_F)


def haversine_m(lat0: Column, lon0: Column, lat1: Column, lon1: Column) -> Column:
    """Great-circle metres between two points."""
    half_lat, half_lon = F.radians(lat1 - lat0) / 2, F.radians(lon1 - lon0) / 2
    a = F.pow(F.sin(half_lat), 2) + F.cos(F.radians(lat0)) * F.cos(F.radians(lat1)) * F.pow(F.sin(half_lon), 2)
    return 2 * EARTH_RADIUS_M * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def _earth_fixed(lat, lon, m):
    la, lo = m.radians(lat), m.radians(lon)
    n = WGS84_A / m.sqrt(1 - WGS84_E2 * m.sin(la) * m.sin(la))
    return n * m.cos(la) * m.cos(lo), n * m.cos(la) * m.sin(lo), n * (1 - WGS84_E2) * m.sin(la)


def tangent_distance_m(lat0, lon0, lat1, lon1, m=F):
    """Horizontal metres in the plane that touches the ellipsoid at the first point (not symmetric); floats with m=math."""
    x0, y0, z0 = _earth_fixed(lat0, lon0, m)
    x1, y1, z1 = _earth_fixed(lat1, lon1, m)
    dx, dy, dz = x1 - x0, y1 - y0, z1 - z0
    la, lo = m.radians(lat0), m.radians(lon0)
    east = m.cos(lo) * dy - m.sin(lo) * dx
    north = m.cos(la) * dz - m.sin(la) * (m.cos(lo) * dx + m.sin(lo) * dy)
    return m.sqrt(east * east + north * north)


def _meeting(p_lat, p_lon, q_lat, q_lon, g_lat1, g_lon1, g_lat2, g_lon2, m):
    """Cross product of way and gate, and the two places along them, each times the cross product."""
    scale = m.cos(m.radians(g_lat1)) * EARTH_RADIUS_M * radians(1)
    up = EARTH_RADIUS_M * radians(1)
    way_x, way_y = (q_lon - p_lon) * scale, (q_lat - p_lat) * up
    gate_x, gate_y = (g_lon2 - g_lon1) * scale, (g_lat2 - g_lat1) * up
    off_x, off_y = (g_lon1 - p_lon) * scale, (g_lat1 - p_lat) * up
    return way_x * gate_y - way_y * gate_x, off_x * gate_y - off_y * gate_x, off_x * way_y - off_y * way_x


def crossing_fraction(p_lat: Column, p_lon: Column, q_lat: Column, q_lon: Column, g_lat1: Column, g_lon1: Column, g_lat2: Column, g_lon2: Column) -> Column:
    """Where the straight way from p to q meets a gate, as a share of the way; null if it does not.

    Everything is projected at the latitude of the gate's first end. Along a parallel gate
    (cross product under 1e-9) there is no crossing; both ends of way and gate count."""
    cross, way, gate = _meeting(p_lat, p_lon, q_lat, q_lon, g_lat1, g_lon1, g_lat2, g_lon2, F)
    # a way of no length has no cross product to divide by
    at = F.try_divide(way, cross)
    return F.when((F.abs(cross) >= 1e-9) & at.between(0.0, 1.0) & F.try_divide(gate, cross).between(0.0, 1.0), at)


def crossing_share(p: tuple[float, float], q: tuple[float, float], gate: tuple[float, float, float, float]) -> float | None:
    """The same for one way between two points and one gate, as floats."""
    cross, way, along = _meeting(*p, *q, *gate, math)
    return way / cross if abs(cross) >= 1e-9 and 0 <= way / cross <= 1 and 0 <= along / cross <= 1 else None


def valid_fix(lat: Column, lon: Column) -> Column:
    """A usable reading: present, finite, and neither coordinate zero."""
    fine = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")) & (c != 0)
    return F.coalesce(fine(lat) & fine(lon), F.lit(False))
