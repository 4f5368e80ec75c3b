"""Chat formatting with DataFrame functions alone: render, reparse, compare, escape.

Grammar of a formatted conversation, turn after turn:

    ### role:\\n body \\n</turn>\\n

Control strings are `###` and `</turn>`. In an escaped text every control string and the
backslashes right before it get one more backslash, and the parser takes one away, so any
text comes back. The parser is deterministic and strict: it cuts at every control string,
wherever it stands, that has no backslash (or further `#`) before it, takes a turn from
between a header and an end, cuts it at its first `:\\n`, and unescapes. Anything else
between them is no conversation, so a text cannot forge a turn. Roles are written with `%`,
`:`, newline, `#` and `<` as %25, %3A, %0A, %23 and %3C.

A conversation is first rendered as it is and reparsed. Turns that do not come back are
escaped, and if the conversation still differs from its source all its turns are, which
always comes back; `round_trip` reports the last comparison.

Null roles and texts are empty; turns with equal numbers go by role and text, null turn
numbers first; a null conv_id is a conversation of its own; an empty table gives no rows;
repeated rows are repeated turns; very long texts are escaped and compared whole; other
columns are not returned. Work is in proportion to a conversation's text, whatever its number of turns (spans are summed
up in runs of RUN turns). A conversation is one text with one digest, so its rows
meet in one task; conversations are independent of each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, COLON, CLOSE = "### ", ":\n", "\n</turn>\n"
CONTROL = r"(?<![\\#])###|(?<!\\)</turn>"
CODES = {"%": "%25", ":": "%3A", "\n": "%0A", "#": "%23", "<": "%3C"}
TO_ESCAPE = r"(?<!\\)(\\*+(?:###|</turn>))"
TO_UNESCAPE = r"(?<!\\)\\(\\*+(?:###|</turn>))"
ASSISTANT = "assistant"
SPANS = "array<struct<start:bigint,end:bigint>>"
#: Turns whose spans are put together at once; then such runs are.
RUN = 128


def escape(text: Column) -> Column:
    return F.regexp_replace(text, TO_ESCAPE, r"\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, TO_UNESCAPE, "$1")


def role_code(role: Column) -> Column:
    for char, code in CODES.items():
        role = F.replace(role, F.lit(char), F.lit(code))
    return role


def role_name(code: Column) -> Column:
    for char, written in reversed(CODES.items()):
        code = F.replace(code, F.lit(written), F.lit(char))
    return code


def render_turn(role: Column, body: Column) -> Column:
    return F.concat(F.lit(OPEN), role_code(role), F.lit(COLON), body, F.lit(CLOSE))


def parse(formatted: Column) -> Column:
    """array<struct<role,text>>, read back from one formatted conversation; null if it is none."""
    parts = F.split(formatted, CONTROL, -1)
    outside = F.filter(parts, lambda p, i: i % 2 == 0)
    sound = (F.size(parts) % 2 == 1) & (F.element_at(parts, 1) == "") & F.forall(F.slice(outside, 2, F.size(outside)), lambda p: p == "\n")

    def turn(part: Column) -> Column:
        at = F.locate(COLON, part)
        role = role_name(F.substring(part, F.lit(2), F.greatest(at - F.lit(2), F.lit(0))))
        body = F.substring(part, at + F.lit(len(COLON)), F.greatest(F.length(part) - at - F.lit(len(COLON)), F.lit(0)))
        return F.struct(role.alias("role"), unescape(body).alias("text"))

    return F.when(sound, F.transform(F.filter(parts, lambda p, i: i % 2 == 1), turn))


def spans_of(parts: Column, spans) -> Column:
    """struct<at, spans>: the parts' sizes summed up, and spans(what was before, part) of each part, one after the other."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(SPANS).alias("spans"))
    return F.aggregate(parts, start, lambda acc, p: F.struct((acc["at"] + p["size"]).alias("at"), F.concat(acc["spans"], spans(acc, p).cast(SPANS)).alias("spans")))


def format_chats(rows: DataFrame) -> DataFrame:
    """conv_id, formatted, loss (array of start and end, code points from 0), round_trip; one row per conversation.

    rows: conv_id, turn, role, text."""
    own = F.struct(F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    # first rendering: as it is; a turn that does not come back from the grammar is escaped
    turns = rows.select("conv_id", "turn", own.alias("src")).withColumn("back", parse(render_turn(F.col("src.role"), F.col("src.text"))))
    same = (F.size("back") == 1) & (F.element_at("back", 1) == F.col("src"))
    body = F.when(F.coalesce(same, F.lit(False)), F.col("src.text")).otherwise(escape(F.col("src.text")))
    ordered = turns.select("conv_id", F.struct("turn", "src.role", "src.text", body.alias("body")).alias("t"))
    convs = ordered.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    whole = F.array_join(F.transform("turns", lambda t: render_turn(t["role"], t["body"])), "")
    source = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    once = convs.withColumn("formatted", whole).withColumn("fine", F.coalesce(parse(F.col("formatted")) == source, F.lit(False)))
    all_escaped = F.transform("turns", lambda t: F.struct(t["turn"].alias("turn"), t["role"].alias("role"), t["text"].alias("text"), escape(t["text"]).alias("body")))
    again = once.withColumn("turns", F.when(F.col("fine"), F.col("turns")).otherwise(all_escaped)).withColumn("formatted", whole)
    size = lambda t: F.length(render_turn(t["role"], t["body"]))
    head = lambda t: F.length(F.concat(F.lit(OPEN), role_code(t["role"]), F.lit(COLON)))
    sizes = F.transform("turns", lambda t: F.struct(size(t).cast("long").alias("size"), head(t).cast("long").alias("head"), F.length(t["body"]).cast("long").alias("body"), (t["role"] == ASSISTANT).alias("loss")))
    runs = F.transform(F.sequence(F.lit(0), F.greatest((F.size("turns") - 1) / RUN, F.lit(0)).cast("int")), lambda k: F.slice(F.col("sizes"), k * RUN + 1, RUN))
    # the spans of each run of turns from its own start, then all of them moved to where their run stands
    own = F.transform(runs, lambda r: spans_of(r, lambda acc, t: F.when(t["loss"], F.array(F.struct((acc["at"] + t["head"]).alias("start"), (acc["at"] + t["head"] + t["body"]).alias("end")))).otherwise(F.array())))
    moved = lambda acc, r: F.transform(r["spans"], lambda s: F.struct((s["start"] + acc["at"]).alias("start"), (s["end"] + acc["at"]).alias("end")))
    walk = spans_of(F.transform(own, lambda r: F.struct(r["at"].alias("size"), r["spans"].alias("spans"))), moved)["spans"]
    again = again.withColumn("sizes", sizes)
    return again.select("conv_id", "formatted", walk.alias("loss"), F.coalesce(parse(F.col("formatted")) == source, F.lit(False)).alias("round_trip"))


def digests(chats: DataFrame) -> DataFrame:
    """Counts and digests of each conversation, read back from its formatted text and loss spans alone."""
    back = chats.withColumn("turns", parse(F.col("formatted")))
    # the mask's spans are the bodies of the assistant's turns, which the parser has cut out already
    said = F.filter("turns", lambda t: t["role"] == ASSISTANT)
    back = back.withColumn("loss_text", F.array_join(F.transform(said, lambda t: t["text"]), ""))
    joined = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(joined, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "round_trip",
    )
