"""Small scalar helpers, as plain Python for state machines and as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from voltlane.functions.geo import EARTH_RADIUS_M

LOCAL_ZONE = "America/New_York"


def haversine(lat0: float, lon0: float, lat1: float, lon1: float) -> float:
    a0, a1, dl = math.radians(lat0), math.radians(lat1), math.radians(lon1 - lon0)
    return 2 * EARTH_RADIUS_M * math.asin(math.sqrt(math.sin((a1 - a0) / 2) ** 2 + math.cos(a0) * math.cos(a1) * math.sin(dl / 2) ** 2))


def epoch_s(ts: Column | str) -> Column:
    """Seconds since the epoch of a zone-less timestamp taken as UTC, whatever the session's zone."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), c) / 1e6


def _local(seconds: Column) -> Column:
    return F.convert_timezone(F.lit("UTC"), F.lit(LOCAL_ZONE), F.timestamp_add("MICROSECOND", F.round(seconds * 1e6).cast("long"), F.expr("timestamp_ntz'1970-01-01 00:00:00'")))


def local_time(seconds: Column) -> Column:
    """'yyyy-MM-dd HH:mm:ss' on the team's wall clock."""
    return F.date_format(_local(seconds), "yyyy-MM-dd HH:mm:ss")


def local_date(seconds: Column) -> Column:
    return F.date_format(_local(seconds), "yyyy-MM-dd")


def day_start(day: Column) -> Column:
    """Epoch seconds at which a local calendar day begins; the day after bounds it above, also when clocks change."""
    return epoch_s(F.convert_timezone(F.lit(LOCAL_ZONE), F.lit("UTC"), day.cast("timestamp_ntz")))


def normalized(text: Column) -> Column:
    """Lower case, letters and digits only."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]", "")


def natural_key(name: Column) -> Column:
    """Sorts digits by value: text parts, and digit runs padded to 20 places."""
    padded = F.transform(F.regexp_extract_all(name, F.lit(r"(\d+|\D+)"), F.lit(1)), lambda p: F.when(p.rlike(r"^\d+$"), F.lpad(F.ltrim(p, F.lit("0")), 20, "0")).otherwise(F.lower(p)))
    return F.array_join(padded, "")


def base_name(name: Column) -> Column:
    """A file's name without 'Copy of', '(1)' and document endings, lower case: copies share it."""
    n = F.regexp_replace(F.trim(name), r"(?i)^(copy of\s+)+", "")
    return F.lower(F.regexp_replace(n, r"(?i)((\s*\(\d+\))+|\.(pdf|docx?|pptx?|xlsx?|txt|md))+$", ""))


def trust(start_s: Column, end_s: Column, now_s: Column) -> Column:
    """'suspect' without times, before 2020 or more than a day ahead; else 'ok'."""
    odd = start_s.isNull() | end_s.isNull() | (start_s < 1577836800) | (end_s > now_s + 86400)
    return F.when(odd, "suspect").otherwise("ok")
