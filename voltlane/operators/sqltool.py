"""Guarded read-only SQL over registered views, and the ready-made `samples` view."""

from __future__ import annotations

import json
import threading
import uuid

from py4j.protocol import Py4JJavaError
from pyspark import InheritableThread
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voltlane.functions.scalar import local_time
from voltlane.operators.intervals import interval_of
from voltlane.sources.recordings import bag_messages, bag_streams, cdr_string, sql_csv

ROW_LIMIT, CELL_LIMIT, BYTE_LIMIT, TIMEOUT_S = 200, 2000, 1_000_000, 20.0
#: Bytes of a binary cell that are shown.
BLOB_PREFIX = 16
# What a query may be made of, as Spark's own parser and analyser name it. Everything else is refused:
# commands, writes, tables and files other than the views, scripts, hints.
PARSED = {"UnresolvedWith", "UnresolvedRelation", "UnresolvedHaving", "UnresolvedInlineTable", "UnresolvedTableValuedFunction", "UnresolvedSubqueryColumnAliases", "WithWindowDefinition"}
PLANS = {
    "Project", "Filter", "Aggregate", "Join", "LateralJoin", "Sort", "GlobalLimit", "LocalLimit", "Offset", "Distinct", "Union", "Intersect", "Except", "Window", "Expand", "Generate",
    "Pivot", "Unpivot", "UnionLoop", "UnionLoopRef", "SubqueryAlias", "WithCTE", "CTERelationDef", "CTERelationRef", "OneRowRelation", "LocalRelation", "View", "Range",
}
#: Code from outside Spark, however it came into the session.
FOREIGN = {"ScalaUDF", "PythonUDF", "PythonUDAF", "PythonUDTF", "ScalaAggregator", "HiveSimpleUDF", "HiveGenericUDF", "CallMethodViaReflection", "TransformExpression"}
#: Functions that `register_functions` made, in SQL.
OWN = {"SQLScalarFunction"}
EXPRESSIONS = "org.apache.spark.sql.catalyst.expressions."
#: Groups of Spark's functions that compute from their arguments alone; `misc_funcs` reflects, reads files' names and the session.
GROUPS = {
    "agg_funcs", "array_funcs", "bitwise_funcs", "collection_funcs", "conditional_funcs", "conversion_funcs", "datetime_funcs", "generator_funcs", "hash_funcs", "json_funcs", "lambda_funcs",
    "map_funcs", "math_funcs", "predicate_funcs", "string_funcs", "struct_funcs", "url_funcs", "window_funcs",
}
#: Of the others these compute from their arguments too.
HARMLESS = {"TypeOf"}
_functions: dict[int, set[str]] = {}


class Refused(ValueError):
    """The text is not one read-only query over the views."""


def items(seq) -> list:
    return [seq.apply(k) for k in range(seq.size())]


def kind(node) -> str:
    return node.getClass().getName().rsplit(".", 1)[-1]


def barred(spark: SparkSession) -> set[str]:
    """Classes of all registered functions that are in none of GROUPS; what else the analyser makes has no name that a query can use."""
    if id(spark) not in _functions:
        registry = spark._jsparkSession.sessionState().functionRegistry()
        infos = [i.get() for i in (registry.lookupFunction(name) for name in items(registry.listFunction())) if i.isDefined()]
        named = lambda i: {(n := i.getClassName().rsplit(".", 1)[-1]), n.removesuffix("Builder").removesuffix("Expression")}
        fine = {n for i in infos if i.getGroup() in GROUPS for n in named(i)} | HARMLESS
        _functions[id(spark)] = FOREIGN | ({n for i in infos for n in named(i)} - fine)
    return _functions[id(spark)]


def check_expression(spark: SparkSession, node, views: set[str]) -> None:
    name = kind(node)
    if name in barred(spark) or not (name in OWN or node.getClass().getName().startswith(EXPRESSIONS)):
        raise Refused(f"{node.prettyName()} is not allowed")
    if name in ("ListQuery", "ScalarSubquery", "Exists", "LateralSubquery"):
        check_plan(spark, node.plan(), views)
    for child in items(node.children()):
        check_expression(spark, child, views)


def check_plan(spark: SparkSession, node, views: set[str]) -> None:
    """Refuses an analysed plan that holds more than queries over the views; what a view itself reads is its own affair."""
    name = kind(node)
    if name == "View":
        if node.desc().identifier().table().lower() not in views:
            raise Refused(f"{node.desc().identifier().table()} is not one of the views")
        return
    if name not in PLANS:
        raise Refused(f"{name} is not allowed")
    for e in items(node.expressions()):
        check_expression(spark, e, views)
    for child in items(node.children()):
        check_plan(spark, child, views)


def check_parsed(node) -> None:
    if kind(node) not in PARSED | PLANS:
        raise Refused(f"{kind(node)} is not allowed")
    if kind(node) == "UnresolvedRelation" and node.multipartIdentifier().size() != 1:
        raise Refused("only the views can be read")
    for child in items(node.children()):
        check_parsed(child)


def guard(spark: SparkSession, sql: str, views: list[str]) -> DataFrame:
    """The query as a data frame if it is one SELECT over `views`, else `Refused`.

    The parser's tree shows whether it is a query at all, before Spark would run a command;
    the analysed plan shows what it reads and which functions it calls."""
    text = sql.strip().rstrip(";").strip()
    if not text:
        raise Refused("no query")
    try:
        check_parsed(spark._jsparkSession.sessionState().sqlParser().parsePlan(text))
    except PySparkException as e:
        raise Refused(first_line(e)) from e
    df = spark.sql(text)
    check_plan(spark, df._jdf.queryExecution().analyzed(), {v.lower() for v in views})
    return df


def first_line(error: BaseException) -> str:
    """The first line of an error that says something; of a Java error, the last cause's."""
    if isinstance(error, Py4JJavaError):
        cause = error.java_exception
        while cause.getCause() is not None:
            cause = cause.getCause()
        return next((x.strip() for x in str(cause.toString()).splitlines() if x.strip()), "Java error")
    return next((x.strip() for x in str(error).splitlines() if x.strip()), type(error).__name__)


def explain(spark: SparkSession, error: BaseException, views: list[str]) -> str:
    """The reason of a failed query and the views' real columns."""
    known = "; ".join(f"{v}({', '.join(spark.table(v).columns)})" for v in views if spark.catalog.tableExists(v))
    return f"{first_line(error)} -- views: {known}"


def shown(name: str, kind: T.DataType) -> Column:
    """A cell as it is answered: long texts cut, nested values as JSON text, binaries as length and first bytes, no NaN or infinity.

    So a row is bounded by its number of columns."""
    c = F.col(f"`{name}`")
    if isinstance(kind, T.StringType):
        return F.substring(c, 1, CELL_LIMIT).alias(name)
    if isinstance(kind, T.BinaryType):
        more = F.when(F.octet_length(c) > BLOB_PREFIX, "...").otherwise("")
        return F.when(c.isNotNull(), F.concat(F.lit("<blob "), F.octet_length(c).cast("string"), F.lit(" bytes: "), F.lower(F.hex(F.substring(c, 1, BLOB_PREFIX))), more, F.lit(">"))).alias(name)
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
        return F.substring(F.to_json(c), 1, CELL_LIMIT).alias(name)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c).alias(name)
    return c


def run(spark: SparkSession, sql: str, views: list[str], rows: int = ROW_LIMIT, seconds: float = TIMEOUT_S, most_bytes: int = BYTE_LIMIT) -> dict:
    """{"columns", "rows", "truncated"} of a guarded query, or {"error"}; never raises for what the query does.

    Rows are answered until `rows` are there or their JSON passes `most_bytes`. After `seconds` the answer is an error,
    whatever the query is doing, and its jobs are cancelled."""
    tag, out = f"sql-{uuid.uuid4().hex}", {}

    def work() -> None:
        # a tag of the context, for a session's own tags are known to the thread alone that set them
        spark.sparkContext.addJobTag(tag)
        spark.sparkContext.setInterruptOnCancel(True)
        try:
            df = guard(spark, sql, views)
            found, size, truncated = [], 0, False
            # duplicate names would be ambiguous in a selection: positions are not
            plain = df.toDF(*[f"c{k}" for k in range(len(df.columns))])
            for r in plain.select(*[shown(f.name, f.dataType) for f in plain.schema.fields]).limit(rows + 1).collect():
                row = dict(zip(df.columns, r.asDict(True).values(), strict=True)) if len(set(df.columns)) == len(df.columns) else list(r)
                size += len(json.dumps(row, default=str))
                if len(found) == rows or size > most_bytes:
                    truncated = True
                    break
                found.append(row)
            out.update(columns=df.columns, rows=found, truncated=truncated)
        except Exception as e:  # noqa: BLE001 - a query may fail in any way; its reason is the answer
            out.setdefault("failed", e)
        finally:
            spark.sparkContext.removeJobTag(tag)

    thread = InheritableThread(target=work, daemon=True)
    thread.start()
    thread.join(seconds)
    if thread.is_alive():
        InheritableThread(target=cancel, args=(spark, tag, thread), daemon=True).start()
        return {"error": f"stopped after {seconds:g} s"}
    return {"error": explain(spark, out["failed"], views)} if "failed" in out else out


def cancel(spark: SparkSession, tag: str, thread: threading.Thread) -> None:
    """Cancels a query's jobs, those too that it begins later, until it has ended."""
    while thread.is_alive():
        spark.sparkContext.cancelJobsWithTag(tag)
        thread.join(0.5)


CATALOG_TABLES = ("recordings", "recording_files", "recording_streams", "named_locations", "jobs", "cache_entries")


def catalog_sql(spark: SparkSession, tables: dict[str, DataFrame], sql: str, rows: int = ROW_LIMIT) -> dict:
    """A guarded query over the catalog's tables, those of CATALOG_TABLES that `tables` has."""
    views = [name for name in CATALOG_TABLES if name in tables]
    for name in views:
        tables[name].createOrReplaceTempView(name)
    return run(spark, sql, views, min(max(rows, 1), ROW_LIMIT))


def register_recording(spark: SparkSession, path: str) -> list[str]:
    """The views of a recording's files: `topics` and `messages` (with the decoded `text`) of bags, `csv` of a CSV file."""
    if path.lower().endswith(".csv"):
        sql_csv(spark, path, "csv")
        return ["csv"]
    messages = decoded(bag_messages(spark, path))
    messages.createOrReplaceTempView("messages")
    bag_streams(messages).createOrReplaceTempView("topics")
    return ["topics", "messages"]


def query_recording(spark: SparkSession, path: str, sql: str, rows: int = ROW_LIMIT) -> dict:
    """A guarded query over a recording's own views."""
    return run(spark, sql, register_recording(spark, path), rows)


def recording_schema(spark: SparkSession, path: str) -> dict[str, list[tuple[str, str]]]:
    """Names and types of the columns of a recording's views."""
    return {v: spark.table(v).dtypes for v in register_recording(spark, path)}


def register_samples(spark: SparkSession, snapshots: DataFrame, laps: DataFrame, segments: DataFrame, name: str = "samples") -> DataFrame:
    """The view of all snapshots with lap, segment, time since the run's start and wall-clock time."""
    start = snapshots.groupBy("run_id").agg(F.min("t").alias("__start"))
    s = interval_of(interval_of(snapshots, laps, "lap_number"), segments, "segment").join(start, "run_id")
    s = s.withColumns({"run_t": F.col("t") - F.col("__start"), "local_time": local_time(F.col("t"))}).drop("__start")
    s.createOrReplaceTempView(name)
    return s


def register_functions(spark: SparkSession) -> None:
    """cdr_string, local_time and local_date for SQL, as expressions rather than Python."""
    zone = "convert_timezone('UTC', 'America/New_York', timestampadd(MICROSECOND, bigint(round(s * 1e6)), timestamp_ntz'1970-01-01'))"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION local_time(s DOUBLE) RETURNS STRING RETURN date_format({zone}, 'yyyy-MM-dd HH:mm:ss')")
    # the same as `recordings.cdr_string`: endian flag in byte 2, length at 5, text at 9, one NUL off
    four = "hex(substring(data, 5, 4))"
    turned = f"concat(substring({four}, 7, 2), substring({four}, 5, 2), substring({four}, 3, 2), substring({four}, 1, 2))"
    size = f"bigint(conv(CASE WHEN conv(hex(substring(data, 2, 1)), 16, 10) % 2 = 1 THEN {turned} ELSE {four} END, 16, 10))"
    text = f"regexp_replace(make_valid_utf8(string(substring(data, 9, int({size})))), '\\\\x00$', '')"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION cdr_string(data BINARY) RETURNS STRING RETURN CASE WHEN octet_length(data) >= 9 AND {size} >= 1 AND octet_length(data) >= {size} + 8 THEN {text} END")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION local_date(s DOUBLE) RETURNS STRING RETURN date_format({zone}, 'yyyy-MM-dd')")


def decoded(messages: DataFrame) -> DataFrame:
    return messages.withColumn("text", cdr_string(F.col("data")))
