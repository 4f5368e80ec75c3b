"""JSON documents as rows of their nodes, merged by patches, and built from groups of rows.

Nodes come from VARIANT values, exploded level by level, so documents are parsed once and stay
in the JVM; the number of levels is the depth of the deepest document, one number.
"""

from __future__ import annotations

import json
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

STRINGS = r'"(?:\\.|[^"\\])*+"'
PLAIN_KEY = r"^[A-Za-z_][A-Za-z0-9_]*$"


def depth(doc: Column) -> Column:
    """How deep the brackets of a JSON text are nested."""
    marks = F.regexp_replace(F.regexp_replace(doc, STRINGS, ""), r"[^\[\]{}]", "")
    zero = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))
    step = lambda acc, c: F.struct((acc["now"] + F.when(c.isin("[", "{"), 1).otherwise(-1)).alias("now"), F.greatest(acc["most"], acc["now"] + F.when(c.isin("[", "{"), 1).otherwise(-1)).alias("most"))
    return F.aggregate(F.filter(F.split(marks, ""), lambda c: c != ""), zero, step, lambda acc: acc["most"])


def kind(value: Column) -> Column:
    """object, array, text, integer, real, true, false or null."""
    name = F.schema_of_variant(value)
    return (
        F.when(name.startswith("OBJECT"), "object").when(name.startswith("ARRAY"), "array").when(name == "STRING", "text").when(name == "VOID", "null")
        .when(name == "BOOLEAN", F.when(F.try_variant_get(value, "$", "boolean"), "true").otherwise("false")).when(name == "BIGINT", "integer")
        .when(name.startswith("DECIMAL"), F.when(F.to_json(value).rlike(r"^-?\d+$"), "integer").otherwise("real")).otherwise("real")
    )


def json_tree(rows: DataFrame, column: str, levels: int | None = None) -> DataFrame:
    """The other columns of `rows` with key, type, atom (text of a scalar), fullkey and path of every node of the JSON text.

    The root has key null and fullkey $. `levels`: nodes down to that depth only (1: the root's members, as `each`).
    Null and malformed texts have no nodes; a name that a document has twice gives its last value."""
    kept = [c for c in rows.columns if c != column]
    held = rows.where(F.try_parse_json(F.col(column)).isNotNull())
    if levels is None:
        levels = held.agg(F.max(depth(F.col(column)))).first()[0] or 0
    at = held.select(*kept, F.lit(None).cast("string").alias("key"), F.lit("$").alias("fullkey"), F.lit("$").alias("path"), F.try_parse_json(F.col(column)).alias("__v"))
    found = [at]
    for _ in range(levels):
        inside = at.where(kind(F.col("__v")).isin("object", "array")).select(*kept, F.col("fullkey").alias("__up"), "__v")
        tvf = rows.sparkSession.tvf.variant_explode(F.col("__v").outer()).toDF("__pos", "__key", "__value")
        member = F.when(F.col("__key").isNull(), F.concat(F.lit("["), F.col("__pos").cast("string"), F.lit("]"))).when(F.col("__key").rlike(PLAIN_KEY), F.concat(F.lit("."), F.col("__key"))).otherwise(F.concat(F.lit('."'), F.col("__key"), F.lit('"')))
        at = inside.lateralJoin(tvf).select(*kept, F.coalesce("__key", F.col("__pos").cast("string")).alias("key"), F.concat("__up", member).alias("fullkey"), F.col("__up").alias("path"), F.col("__value").alias("__v"))
        found.append(at)
    named = reduce(DataFrame.unionByName, found).withColumn("type", kind(F.col("__v")))
    atom = F.when(F.col("type") == "text", F.try_variant_get(F.col("__v"), "$", "string")).when(~F.col("type").isin("object", "array", "null"), F.to_json("__v"))
    return named.select(*kept, "key", "type", atom.alias("atom"), "fullkey", "path")


def json_each(rows: DataFrame, column: str) -> DataFrame:
    """The members of each document's root, or the root itself if it is a scalar."""
    return json_tree(rows, column, 1).where((F.col("fullkey") != "$") | ~F.col("type").isin("object", "array"))


def merged(target, patch):
    """The target with a merge patch (RFC 7396) put over it."""
    if not isinstance(patch, dict):
        return patch
    out = dict(target) if isinstance(target, dict) else {}
    for k, v in patch.items():
        if v is None:
            out.pop(k, None)
        else:
            out[k] = merged(out.get(k), v)
    return out


@F.arrow_udf(T.StringType())
def json_patch(targets: pa.Array, patches: pa.Array) -> pa.Array:
    """The merge patch of two JSON texts; null if either is null or malformed."""

    def one(a, b):
        try:
            return None if a is None or b is None else json.dumps(merged(json.loads(a), json.loads(b)), ensure_ascii=False, separators=(",", ":"))
        except ValueError:
            return None

    return pa.array(map(one, targets.to_pylist(), patches.to_pylist()), pa.string())


def quoted(value: Column) -> Column:
    """A value as JSON text; null is null."""
    text = F.to_json(F.array(value))
    return F.substring(text, F.lit(2), F.length(text) - 2)


def group_array(value: str, order: str) -> Column:
    """An aggregate: the group's values as a JSON array, in order of `order`."""
    return F.concat(F.lit("["), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), quoted(F.col(value)).alias("v")))), lambda x: x["v"]), ","), F.lit("]"))


def group_object(name: str, value: str, order: str) -> Column:
    """An aggregate: the group's names and values as a JSON object, in order of `order`; names may repeat, null names go."""
    pair = F.when(F.col(name).isNotNull(), F.struct(F.col(order).alias("o"), F.concat(quoted(F.col(name).cast("string")), F.lit(":"), quoted(F.col(value))).alias("v")))
    return F.concat(F.lit("{"), F.array_join(F.transform(F.sort_array(F.collect_list(pair)), lambda x: x["v"]), ","), F.lit("}"))
