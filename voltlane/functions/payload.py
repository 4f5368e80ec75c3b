"""Strict telemetry payloads: three disjoint shapes, reasons for rejects, and the flat sample.

Exact key sets and int-or-number strictness cannot be told from a parsed struct (a bare NaN
and the string "NaN" look alike there), so validation reads the JSON text in an Arrow UDF.
Everything after it is columns.
"""

from __future__ import annotations

import json
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The payload's groups and their fields.
GROUPS = {
    "power": ("current", "voltage"),
    "steering": ("brake_pressure", "turn_angle"),
    "rpm_front": ("rpm_left", "rpm_right"),
    "rpm_back": ("rpm_left", "rpm_right"),
    "gps": ("lat", "long", "heading", "speed"),
}
SCHEMAS = {"telemetry.v1": ("throttle", False), "telemetry.v2": ("duty_cycle", True), "telemetry.v1-dutycycle": ("duty_cycle", False)}
MAX_REASONS = 5


@cache
def shape(schema: str) -> dict:
    """Key -> int or float at the top, or a dict of the same for a group."""
    control, errors = SCHEMAS[schema]
    out: dict = {"seq": int, "global_ts": int, "_t_publish_ns": int}
    out |= {g: {"ts": int, **dict.fromkeys(names, float)} for g, names in GROUPS.items()}
    out |= {"motor": {"ts": int, "rpm": float, control: float}, "filtered": {"speed": float}}
    return out | ({"errcount": int} if errors else {})


def fits(value, kind) -> bool:
    return not isinstance(value, bool) and isinstance(value, int if kind is int else (int, float))


def flat_columns(schema: str) -> set[str]:
    """The columns of a schema's flat CSV: dotted leaves and the timestamp."""
    top = shape(schema)
    return {"timestamp"} | {k for k, v in top.items() if not isinstance(v, dict)} | {f"{g}.{k}" for g, v in top.items() if isinstance(v, dict) for k in v}


@cache
def by_keys() -> dict[frozenset, str]:
    """The only schema that a payload with these top keys and motor fields can have."""
    return {frozenset(shape(s)) | frozenset(("motor", k) for k in shape(s)["motor"]): s for s in SCHEMAS}


def conforms(value, want) -> bool:
    if type(want) is not dict:
        kind = type(value)
        return kind is int or (kind is float and want is float)
    return type(value) is dict and value.keys() == want.keys() and all(conforms(value[k], w) for k, w in want.items())


def compare(value, want, path: str = "") -> list[str]:
    """What is wrong with a value, in order: unexpected keys, missing keys, then key by key."""
    if not isinstance(want, dict):
        return [] if fits(value, want) else [f"{path}: expected {'integer' if want is int else 'number'}, got {type(value).__name__}"]
    if not isinstance(value, dict):
        return [f"{path or 'payload'}: expected an object, got {type(value).__name__}"]
    at = f"{path}." if path else ""
    out = [f"unexpected key {at + k!r}" for k in sorted(value.keys() - want.keys())] + [f"missing key {at + k!r}" for k in sorted(want.keys() - value.keys())]
    return out + [r for k in want if k in value for r in compare(value[k], want[k], at + k)]


def examine(raw: str | None) -> dict:
    """schema (null if none fits), repeat key, publish stamp, and reasons against the closest shape."""
    try:
        payload = json.loads(raw)
    except (TypeError, ValueError):
        return {"schema": None, "repeat_key": None, "publish_ns": None, "reasons": ["not JSON"]}
    stamp = payload.get("_t_publish_ns") if isinstance(payload, dict) else None
    motor = payload.get("motor") if isinstance(payload, dict) else None
    likely = by_keys().get(frozenset(payload) | frozenset(("motor", k) for k in motor)) if isinstance(motor, dict) else None
    if likely and conforms(payload, shape(likely)):
        body = json.dumps({k: v for k, v in payload.items() if k != "_t_publish_ns"}, sort_keys=True)
        return {"schema": likely, "repeat_key": body, "publish_ns": stamp, "reasons": []}
    tried = {s: compare(payload, shape(s)) for s in SCHEMAS}
    best = min(tried, key=lambda s: (len(tried[s]), s))
    return {"schema": None, "repeat_key": None, "publish_ns": stamp if fits(stamp, int) else None, "reasons": tried[best][:MAX_REASONS]}


EXAMINED = T.StructType([T.StructField("schema", T.StringType()), T.StructField("repeat_key", T.StringType()), T.StructField("publish_ns", T.LongType()), T.StructField("reasons", T.ArrayType(T.StringType()))])
_EXAMINED = pa.struct([("schema", pa.string()), ("repeat_key", pa.string()), ("publish_ns", pa.int64()), ("reasons", pa.list_(pa.string()))])


@F.arrow_udf(EXAMINED)
def examined(raw: pa.Array) -> pa.Array:
    return pa.array([examine(r) for r in raw.to_pylist()], _EXAMINED)


def payload_struct() -> str:
    """The union of all shapes for from_json."""
    group = lambda names: "struct<ts:bigint," + ",".join(f"{n}:double" for n in names) + ">"
    parts = [f"{g}:{group(n)}" for g, n in GROUPS.items()] + [f"motor:{group(('rpm', 'throttle', 'duty_cycle'))}", "filtered:struct<speed:double>"]
    return "struct<seq:bigint,global_ts:bigint,_t_publish_ns:bigint,errcount:bigint," + ",".join(parts) + ">"


def finite(c: Column) -> Column:
    """NaN and infinities become null."""
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def samples(messages: DataFrame, raw: str = "raw", ts: str = "ts") -> DataFrame:
    """Wide snapshots of conforming messages: a struct per group, null where all its data are null."""
    p = messages.withColumn("__p", F.from_json(raw, payload_struct()))
    renamed = {"long": "lon"}

    def group(name: str, fields: tuple[str, ...]) -> Column:
        values = [finite(F.col(f"__p.{name}.{f}")).alias(renamed.get(f, f)) for f in fields]
        body = F.struct(F.col(ts).alias("ts"), F.col(f"__p.{name}.ts").alias("device_ts_us"), *values)
        return F.when(F.coalesce(*[finite(F.col(f"__p.{name}.{f}")) for f in fields]).isNotNull(), body)

    groups = [group(g, n).alias({"power": "joulemeter"}.get(g, g)) for g, n in GROUPS.items()] + [group("motor", ("rpm", "throttle", "duty_cycle")).alias("motor")]
    keep = [c for c in messages.columns if c != raw]
    return p.select(*keep, F.col("__p.seq").alias("device_seq"), F.col("__p.global_ts").alias("device_global_ts_us"), F.col("__p._t_publish_ns").alias("publish_ns"), finite(F.col("__p.filtered.speed")).alias("filtered_speed"), F.col("__p.errcount").alias("errcount"), *groups)
