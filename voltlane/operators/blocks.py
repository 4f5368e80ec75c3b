"""Documents as blocks: HTML and files to blocks, scrubbing, and chunks for search.

A block is a heading, paragraph, table or code with its links. Reading HTML is a small Arrow
UDF: it lists a page's stretches of text and folds them to blocks. What follows is columns:
blocks are rows (page_id, at, kind, text, level, rows, header, links), scrubbing marks them
and their lines by windows over a page, and chunks are cut and merged by running word sums.
"""

from __future__ import annotations

import csv
import io
import json
import re
from functools import reduce
from html.parser import HTMLParser
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voltlane.functions.text import URL, mentions_credential, redact_keys

LINK = T.StructType([T.StructField("url", T.StringType()), T.StructField("text", T.StringType())])
BLOCK = T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("text", T.StringType()), T.StructField("level", T.IntegerType()),
    T.StructField("rows", T.ArrayType(T.ArrayType(T.StringType()))), T.StructField("header", T.BooleanType()), T.StructField("links", T.ArrayType(LINK)),
])
_LINK = pa.struct([("url", pa.string()), ("text", pa.string())])
_BLOCKS = pa.list_(pa.struct([("kind", pa.string()), ("text", pa.string()), ("level", pa.int32()), ("rows", pa.list_(pa.list_(pa.string()))), ("header", pa.bool_()), ("links", pa.list_(_LINK))]))

# Fixed limits of the chunker.
MAX_LEVEL, MIN_WORDS, MAX_WORDS, TARGET_WORDS = 4, 40, 600, 400
# Fixed names: tags that end a paragraph, tags whose text is not shown, macros that hold code.
BREAKING = {"p", "div", "li", "ul", "ol", "blockquote", "section", "article", "pre", "hr", "dl", "dt", "dd"}
SILENT = {"script", "style", "ac:parameter", "ac:image", "ri:attachment", "ac:task-id", "ac:task-uuid", "ac:task-status"}
CODE = {"code", "noformat"}


def block(kind: str, text: str = "", level: int = 0, rows=None, header: bool = False, links=()) -> dict:
    return {"kind": kind, "text": text, "level": level, "rows": rows, "header": header, "links": [{"url": u, "text": t} for u, t in links]}


def squeeze(text: str) -> str:
    return " ".join(text.split())


class Events(HTMLParser):
    """The page as a flat list of (tag or None, opens, attributes or text)."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.found: list[tuple] = []
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.found.append((tag, True, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag):
        self.found.append((tag, False, {}))

    def handle_data(self, data):
        self.found.append((None, False, data))

    def unknown_decl(self, data):
        if data.startswith("CDATA["):
            self.handle_data(data[6:])


#: What an element is to the reader; elements of one family close each other.
FAMILY = {"ac:structured-macro": "macro", "ac:macro": "macro", "table": "table", "tr": "row", "td": "cell", "th": "cell", "a": "anchor", "ac:link": "named", **{f"h{k}": "heading" for k in range(1, 7)}, **dict.fromkeys(SILENT, "silent")}


def strips(html: str) -> list[tuple]:
    """(block, kind, place, text, url) of every stretch of text (url null) and every link, in the page's order.

    Stretches of one block have one number. place is the level of a heading, or row, column and
    whether it is a header cell for a table. Where a stretch belongs follows from the elements
    that are open there: silent before code before table before paragraph."""
    out: list[tuple] = []
    opened: list[tuple[str, str, dict, int]] = []  # family, tag, attributes, stretches before it
    number, row, column, title = 0, -1, -1, None

    def within(family: str) -> list[tuple]:
        return [o for o in opened if o[0] == family]

    def in_code() -> bool:
        return any(o[0] == "macro" and o[2].get("code") for o in opened)

    def put(text: str, url: str | None = None) -> None:
        tables, cells, heads = within("table"), within("cell"), within("heading")
        if in_code() and url is None:
            out.append((number, "code", 0, text, None))
        elif tables and (cells or url is not None):
            out.append((number, "table", (row, column, cells[:1] and cells[0][1] == "th"), text, url))
        else:  # between cells: part of what follows the table
            out.append((number + bool(tables), "para", int(heads[-1][1][1]) if heads else 0, text, url))

    for tag, opens, more in Events(html).found:
        family, tables = FAMILY.get(tag), within("table")
        if tag is None:
            hushed = within("silent")
            if not hushed:
                put(more)
            elif hushed[-1][2].get("ac:name", "").lower() == "url" and re.match(URL, more.strip()):
                put(more.strip(), more.strip())
            continue
        fresh = not tables and not in_code()  # here a block may end
        if opens:
            if tag == "br":
                put("\n" if in_code() else " ")
            elif tag == "ri:url" and more.get("ri:value"):
                put(more["ri:value"], more["ri:value"])
            elif tag in ("ri:page", "ac:link"):
                title = more.get("ri:content-title")
            elif tables and tag in ("li", "p", "div"):
                put(" ")
            if family == "macro":
                more["code"] = more.get("ac:name", "").lower() in CODE and not tables
            if fresh and (tag in BREAKING or family in ("heading", "table") or (family == "macro" and more["code"])):
                number += 1
            if fresh and tag == "li":
                put("- ")
            if family == "table" and fresh:
                row, column = -1, -1
            elif family == "row" and len(tables) == 1:
                row, column = row + 1, -1
            elif family == "cell" and len(tables) == 1 and row >= 0:
                column += 1
            if family in ("row", "cell") and len(tables) != 1:
                put(" ")  # what is inside a cell's own table is that cell's text
                continue
            if family and not (family == "anchor" and not more.get("href")):
                opened.append((family, tag, more, len(out)))
            if family == "cell":
                put("")
            continue
        mine, attrs = [k for k, o in enumerate(opened) if o[0] == family] if family else [], {}
        if mine and not (family in ("row", "cell") and len(tables) != 1):
            _, _, attrs, since = opened[mine[-1]]
            if family == "anchor":
                put("".join(s[3] for s in out[since:] if s[4] is None), attrs["href"])
            if family == "named" and title and not within("anchor"):
                put(title)
            # cells and rows end with their table, other elements alone
            del opened[mine[-1] : None if family in ("table", "row", "cell") else mine[-1] + 1]
        if family == "named":
            title = None
        if not within("table") and not in_code() and (tag in BREAKING or (mine and (family in ("heading", "table") or attrs.get("code")))):
            number += 1
    return out


def blocks_of(html: str | None) -> list[dict]:
    """A page's blocks, in order; links are those of the page, and URLs that are written in the text."""
    out = []
    for _, group in groupby(sorted(strips(html or ""), key=lambda s: s[0]), key=lambda s: s[0]):
        part = list(group)
        said = [s for s in part if s[4] is None]
        links = [(s[4], squeeze(s[3]) or s[4]) for s in part if s[4] is not None]
        kind, text, level, rows, header = part[0][1], squeeze("".join(s[3] for s in said)), 0, None, False
        if kind == "code":
            text = "".join(s[3] for s in said).strip("\n")
        elif kind == "table":
            cells = {place: squeeze("".join(s[3] for s in of)) for place, of in groupby(said, key=lambda s: s[2])}
            header = any(p[0] == 0 and p[2] for p in cells)
            rows = [[t for _, t in of] for _, of in groupby(cells.items(), key=lambda c: c[0][0])]
            rows, text = [r for r in rows if any(r)], ""
        else:
            level = max(s[2] for s in part) if text else 0
            kind = "heading" if level else "para"
        if not (text.strip() or rows or (links and kind == "para")):
            continue
        known = {u for u, _ in links}
        written = [u for t in ([text] if rows is None else [c for r in rows for c in r]) for u in re.findall(URL, t)]
        links += [(u, u) for u in dict.fromkeys(written) if u not in known]
        out.append(block(kind, text, level, rows, header, links))
    return out


#: Texts and characters that a worker holds as Python objects at a time; what was read of them goes to Arrow before the next.
TEXTS_AT_A_TIME, CHARS_AT_A_TIME = 256, 1 << 20


def in_parts(make, kind: pa.DataType, *columns: pa.Array) -> pa.Array:
    """The array of `make(*values)` of each row, built a part of the rows at a time."""
    parts, row, chars = [], [], 0
    for values in zip(*columns, strict=True):
        texts = [v.as_py() for v in values]
        row.append(make(*texts))
        chars += sum(len(t or "") for t in texts)
        if len(row) == TEXTS_AT_A_TIME or chars >= CHARS_AT_A_TIME:
            parts.append(pa.array(row, kind))
            row, chars = [], 0
    parts.append(pa.array(row, kind))
    return pa.concat_arrays(parts)


@F.arrow_udf(T.ArrayType(BLOCK))
def textify(html: pa.Array) -> pa.Array:
    return in_parts(blocks_of, _BLOCKS, html)


def block_rows(pages: DataFrame, blocks: Column | str) -> DataFrame:
    """page_id, at and the fields of each block; blocks: an array column."""
    return pages.select("page_id", F.posexplode(blocks).alias("at", "b")).select("page_id", "at", "b.*")


def either(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def last_heading(upto: int, value: Column, where: Column) -> Column:
    """The value at the page's last heading of level `upto` or above, this row's own included."""
    order = Window.partitionBy("page_id").orderBy("at")
    return F.last(F.when(where & (F.col("level") <= upto), value), ignorenulls=True).over(order)


def scrub(rows: DataFrame) -> DataFrame:
    """Block rows without credentials: whole sections under a heading that names one, tables whose header does,
    table rows, and lines (with the next line, where the naming line is short and the value may follow)."""
    heading, table = F.col("kind") == "heading", F.col("kind") == "table"
    naming = F.struct("level", mentions_credential(F.col("text")).alias("names"))
    # a section is closed if the last heading of its level or above is of that level and names a credential
    for level in range(1, 7):
        rows = rows.withColumn(f"__l{level}", last_heading(level, naming, heading))
    closed = either([(F.col(f"__l{k}.level") == k) & F.col(f"__l{k}.names") for k in range(1, 7)])
    rows = rows.where(~F.coalesce(closed, F.lit(False))).drop(*[f"__l{k}" for k in range(1, 7)])
    filled = table & (F.size("rows") > 0)
    secret = filled & F.col("header") & F.exists(F.element_at("rows", 1), lambda c: mentions_credential(c, True))
    clean = F.transform(F.filter("rows", lambda r: ~F.exists(r, lambda c: mentions_credential(c))), lambda r: F.transform(r, lambda c: redact_keys(c)))
    # lines as rows; a heading or table is one line and ends what a line before it may take along
    lines = F.when(heading | filled, F.array(F.lit(""))).otherwise(F.split(F.coalesce("text", F.lit("")), "\n"))
    order = Window.partitionBy("page_id").orderBy("at")
    rows = rows.withColumns({"__secret": F.coalesce(secret, F.lit(False)), "__part": F.sum((heading | filled).cast("int")).over(order)})
    lined = rows.select("*", F.posexplode(lines).alias("__n", "__line"))
    w = Window.partitionBy("page_id", "__part").orderBy("at", "__n")
    full, names = F.col("__line").rlike(r"\S"), mentions_credential(F.col("__line"))
    lined = lined.withColumns({"__full": full, "__names": names}).withColumn("__i", F.sum(F.col("__full").cast("int")).over(w))
    short = F.col("__names") & (F.length("__line") < 80)
    other = F.max(F.when(F.col("__full") & ~short, F.col("__i"))).over(w.rowsBetween(Window.unboundedPreceding, -1))
    # of short naming lines in a row the second is taken by the first, the fourth by the third
    before = F.col("__i") - F.col("__full").cast("int") - F.coalesce(other, F.lit(0))
    lined = lined.withColumn("__kept", ~(F.col("__names") | (F.col("__full") & (before % 2 == 1))))
    whole = F.first(F.when(F.col("__n") == 0, F.struct("kind", "text", "level", "rows", "header", "links", "__secret")), ignorenulls=True)
    kept = F.sort_array(F.collect_list(F.when(F.col("__kept"), F.struct("__n", redact_keys(F.col("__line")).alias("line")))))
    back = lined.groupBy("page_id", "at").agg(whole.alias("b"), F.array_join(F.transform(kept, lambda x: x["line"]), "\n").alias("said")).select("page_id", "at", "b.*", "said")
    removed = F.lit("[table removed: credentials]")
    text = F.when(F.col("__secret"), removed).when(heading, redact_keys(F.col("text"))).when(filled, F.col("text")).otherwise(F.regexp_replace("said", r"^\s+|\s+$", ""))
    links = F.when(F.col("__secret"), F.array().cast(T.ArrayType(LINK))).otherwise(F.col("links"))
    done = back.select("page_id", "at", F.when(F.col("__secret"), "para").otherwise(F.col("kind")).alias("kind"), text.alias("text"), "level", F.when(filled & ~F.col("__secret"), clean).alias("rows"), F.col("header") & ~F.col("__secret"), links.alias("links"), filled.alias("__filled"))
    done = done.toDF("page_id", "at", "kind", "text", "level", "rows", "header", "links", "__filled")
    empty = F.when(F.col("kind") == "table", F.col("__filled") & (F.size("rows") == 0)).when(heading, F.lit(False)).otherwise((F.col("text") == "") & (F.coalesce(F.size("links"), F.lit(0)) <= 0))
    return done.where(~empty).drop("__filled")


def shown(kind: str = "kind", text: str = "text", rows: str = "rows", header: str = "header") -> Column:
    """A block as text."""
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(r, lambda c: F.replace(c, F.lit("|"), F.lit("/"))), " | "), F.lit(" |"))
    lines = F.transform(rows, line)
    rule = F.concat(F.lit("|"), F.repeat(F.lit("---|"), F.size(F.element_at(rows, 1))))
    lines = F.when(F.col(header), F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, F.lit(2), F.size(lines)))).otherwise(lines)
    plain = F.coalesce(text, F.lit(""))
    return F.when(F.col(kind) == "code", F.concat(F.lit("```\n"), plain, F.lit("\n```"))).when((F.col(kind) == "table") & (F.size(rows) > 0), F.array_join(lines, "\n")).otherwise(plain)


def numbered(items: Column, words, opens) -> Column:
    """Group numbers of an array's items from 0, in order: `opens(sum of the group so far, its items, words)` begins a new one."""
    start = F.struct(F.lit(0).alias("group"), F.lit(0).cast("long").alias("sum"), F.lit(0).alias("n"), F.array().cast("array<int>").alias("ids"))

    def step(acc: Column, item: Column) -> Column:
        new = (acc["n"] > 0) & opens(acc["sum"], acc["n"], words(item))
        group = acc["group"] + new.cast("int")
        return F.struct(group.alias("group"), (F.when(new, 0).otherwise(acc["sum"]) + words(item)).cast("long").alias("sum"), (F.when(new, 0).otherwise(acc["n"]) + 1).cast("int").alias("n"), F.concat(acc["ids"], F.array(group)).alias("ids"))

    return F.aggregate(items, start, step)


def chunk(rows: DataFrame) -> DataFrame:
    """page_id, ordinal, heading, text, links of the chunks of block rows: sections under headings down to MAX_LEVEL,
    split at block borders where they are long and merged forward where they are short."""
    cut = (F.col("kind") == "heading") & (F.col("level") <= MAX_LEVEL)
    order = Window.partitionBy("page_id").orderBy("at")
    for level in range(1, MAX_LEVEL + 1):
        rows = rows.withColumn(f"__l{level}", last_heading(level, F.struct("level", "text"), cut))
    path = F.filter(F.array(*[F.when(F.col(f"__l{k}.level") == k, F.col(f"__l{k}.text")) for k in range(1, MAX_LEVEL + 1)]), lambda t: t.isNotNull())
    text = shown()
    body = F.when(~cut, F.struct("at", text.alias("text"), F.size(F.filter(F.split(text, r"\s+"), lambda x: x != "")).alias("n"), "links"))
    placed = rows.select("page_id", "at", F.sum(cut.cast("int")).over(order).alias("section"), path.alias("path"), body.alias("body"))
    sections = placed.groupBy("page_id", "section").agg(F.max("path").alias("path"), F.sort_array(F.collect_list("body")).alias("body"))
    # a last heading with nothing below it is no section
    sections = sections.withColumn("__last", F.max("section").over(Window.partitionBy("page_id"))).where((F.size("body") > 0) | (F.col("section") < F.col("__last")))
    total = F.aggregate("body", F.lit(0), lambda a, b: a + b["n"])
    parts = F.when(total > MAX_WORDS, numbered(F.col("body"), lambda b: b["n"], lambda size, n, more: size + more > TARGET_WORDS)["ids"]).otherwise(F.transform("body", lambda b: F.lit(0)))
    split = sections.select("page_id", "section", "path", F.explode_outer(F.arrays_zip(F.col("body").alias("body"), parts.alias("part"))).alias("x"))
    pieces = split.groupBy("page_id", "section", "path", F.coalesce("x.part", F.lit(0)).alias("part")).agg(F.sort_array(F.collect_list("x.body")).alias("body"))
    words = F.aggregate("body", F.lit(0), lambda a, b: a + b["n"])
    pages = pieces.groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("section", "part", "path", "body", words.alias("n")))).alias("pieces"))
    pages = pages.withColumn("g", numbered(F.col("pieces"), lambda p: p["n"], lambda size, n, more: size >= MIN_WORDS))
    # what is left over at the end goes to the group before it
    most = F.when(F.col("g.sum") < MIN_WORDS, F.greatest(F.col("g.group") - 1, F.lit(0))).otherwise(F.col("g.group"))
    marked = pages.select("page_id", most.alias("most"), F.explode(F.arrays_zip(F.col("pieces").alias("piece"), F.col("g.ids").alias("group"))).alias("x"))
    groups = marked.groupBy("page_id", F.least("x.group", "most").alias("group")).agg(F.sort_array(F.collect_list("x.piece")).alias("g"))
    # how many headings all paths of a group begin with
    agree = lambda k: F.size(F.array_distinct(F.transform("g", lambda p: F.get(p["path"], F.lit(k))))) == 1
    reach = lambda k: F.forall("g", lambda p: F.size(p["path"]) > k)
    shared, common = F.lit(0), F.lit(True)
    for k in range(MAX_LEVEL):
        common = common & agree(k) & reach(k)
        shared = F.when(common, k + 1).otherwise(shared)
    first, alone = F.element_at("g", 1), F.size("g") == 1
    groups = groups.withColumn("shared", shared)
    tops = F.array_distinct(F.transform(F.filter("g", lambda p: F.size(p["path"]) > 0), lambda p: F.element_at(p["path"], 1)))
    name = F.when(alone, F.array_join(first["path"], " > ")).when(F.col("shared") > 0, F.array_join(F.slice(first["path"], F.lit(1), F.col("shared")), " > ")).otherwise(F.array_join(tops, " · "))
    own = lambda p: F.when(F.size("g") > 1, F.array_join(F.slice(p["path"], F.col("shared") + 1, F.lit(MAX_LEVEL)), " > ")).otherwise(F.lit(""))
    said = F.flatten(F.transform("g", lambda p: F.concat(F.array(own(p)), F.transform(p["body"], lambda b: b["text"]))))
    links = F.flatten(F.transform("g", lambda p: F.flatten(F.transform(p["body"], lambda b: F.coalesce(b["links"], F.array().cast(T.ArrayType(LINK)))))))
    made = groups.select("page_id", "group", name.alias("heading"), F.array_join(F.filter(said, lambda t: t.rlike(r"\S")), "\n\n").alias("text"), links.alias("links"))
    once = F.transform(F.array_distinct(F.transform("links", lambda x: x["url"])), lambda u: F.element_at(F.filter("links", lambda x: x["url"] == u), 1))
    made = made.where((F.col("text") != "") | (F.size("links") > 0)).withColumn("links", once)
    return made.select("page_id", (F.row_number().over(Window.partitionBy("page_id").orderBy("group")) - 1).alias("ordinal"), "heading", "text", "links")


def page_chunks(pages: DataFrame, html: str = "html") -> DataFrame:
    """page_id and its chunks as rows: textify, scrub, chunk."""
    return chunk(scrub(block_rows(pages, textify(html))))


def file_blocks(name: str, body: str) -> list[dict]:
    """A repository file: tables of csv and tsv (300 rows), code of data files, and Markdown with fenced code."""
    ending = name.rsplit(".", 1)[-1].lower()
    if ending in ("csv", "tsv"):
        rows = [r for r in csv.reader(io.StringIO(body), delimiter="\t" if ending == "tsv" else ",") if any(r)][:300]
        return [block("table", rows=rows, header=True)] if rows else []
    if ending in ("json", "yaml", "yml", "toml"):
        return [block("code", body)] if body.strip() else []
    out, fence, lines = [], None, []

    def flush():
        text = "\n".join(lines).strip("\n") if fence is not None else "\n".join(lines).strip()
        if text.strip():
            out.append(block("code" if fence is not None else "para", text))
        lines.clear()

    for line in body.split("\n"):
        head = re.match(r"(#{1,6})\s+(.*)", line) if fence is None else None
        if line.startswith("```"):
            flush()
            fence = None if fence is not None else line
        elif head:
            flush()
            out.append(block("heading", head.group(2).strip(), len(head.group(1))))
        elif not line.strip() and fence is None:
            flush()
        else:
            lines.append(line)
    flush()
    return out


def leaf_paths(value, path: str = "$") -> dict[str, object]:
    """JSON paths of all leaves; of a list the first element stands for all; NaN is null."""
    if isinstance(value, dict):
        return {k: v for name, x in value.items() for k, v in leaf_paths(x, f"{path}.{name}").items()}
    if isinstance(value, list):
        return leaf_paths(value[0], f"{path}[0]") if value else {}
    return {path: None if value != value else value}


@F.arrow_udf(T.ArrayType(BLOCK))
def from_file(names: pa.Array, bodies: pa.Array) -> pa.Array:
    return in_parts(lambda n, b: file_blocks(n or "", b or ""), _BLOCKS, names, bodies)


def json_pairs(text: str | None) -> list[tuple] | None:
    try:
        return [(k, None if v is None else json.dumps(v)) for k, v in leaf_paths(json.loads(text)).items()]
    except (TypeError, ValueError):
        return None


@F.arrow_udf(T.MapType(T.StringType(), T.StringType()))
def json_leaves(texts: pa.Array) -> pa.Array:
    return in_parts(json_pairs, pa.map_(pa.string(), pa.string()), texts)
