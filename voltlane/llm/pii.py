"""Personal data: fixed patterns, and terms that disclose what the patterns found.

Everything here is DataFrame functions. The patterns are possessive and start only where
a run can start, so they are linear in the text; they match what their plain forms match.
Positions are summed in chunks of CHUNK matches, so a text with very many matches stays
near-linear too.

Beyond the patterns, corpus co-occurrence says which terms reveal a protected entity. The
entities of a match are its value and what the value belongs to: an address's person and
domain, a network, a card's issuer, a phone's area. Over the corpus's distinct texts, a
term's pointwise mutual information with an entity is set against the entity's own
information. A term that gives away at least `disclosure` of it, and stands near it
(CONTEXT code points to either side) in at least `support` distinct contexts, is sanitised
too, in all texts that hold the entity. Contexts and texts that are equal count once, so
exact copies prove nothing.

Null texts count as empty and have no spans. Spans depend on the text alone, so rows with
null doc_id and repeated rows are treated alike. Terms stand apart from base spans, and
base spans all stay. An empty table gives no rows. Other columns are kept; `sanitise`
changes text and n_chars only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltlane.llm.common import small, written

KINDS = ("email", "ip", "card", "phone", "term")
PATTERNS = {
    # leftmost local parts start where their run starts, or where the last match ended
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # a whole run of digits with single separators; shorter ones cannot be cards
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?+[0-9]){11,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
CONTEXT, DISCLOSURE, SUPPORT = 60, 0.8, 2
#: The least information of a protected entity, in bits: what more than an eighth of the texts hold is no secret.
OWN_BITS = 3.0
TERM = r"(?<![\p{L}\p{N}\p{M}])\p{L}[\p{L}\p{M}]{2,}+(?!\p{N})"
#: Matches whose positions are summed at a time.
CHUNK = 256
#: Rows about disclosing terms that are broadcast, at most; more are joined by a shuffle.
BROADCAST_ROWS = 50_000
SPANS = "array<struct<start:bigint,rank:int,end:bigint,kind:string,value:string>>"


def valid(kind: str, value: Column) -> Column:
    """The checks that a match must pass."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        small = lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 2) | ((F.length(F.ltrim(p, F.lit("0"))) == 3) & (F.ltrim(p, F.lit("0")) <= "255"))
        return F.forall(F.split(value, r"\."), small)
    if kind == "card":
        return F.length(digits).between(12, 19) & F.call_function("luhn_check", digits)
    return F.length(digits).between(9, 15)


def let(value: Column, use) -> Column:
    """`use(value)`, with the value computed once however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def chunks(items: Column) -> Column:
    """An array cut into arrays of CHUNK items."""

    def cut(a: Column) -> Column:
        starts = F.when(F.size(a) > 0, F.sequence(F.lit(0), ((F.size(a) - 1) / CHUNK).cast("int"))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda k: F.slice(a, k * CHUNK + 1, F.lit(CHUNK)))

    return let(items, cut)


def placed(text: Column, pattern: str, matches: Column, kind: str) -> Column:
    """array<struct<start,rank,end,kind,value>>: where the matches of a pattern stand, in code points."""
    gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(matches))
    rank = F.lit(KINDS.index(kind))
    empty = F.array().cast(SPANS)
    moved = lambda s, by: F.struct((s["start"] + by).alias("start"), s["rank"].alias("rank"), (s["end"] + by).alias("end"), s["kind"].alias("kind"), s["value"].alias("value"))
    span = lambda at, m: F.struct(at.alias("start"), rank.alias("rank"), (at + F.length(m)).alias("end"), F.lit(kind).alias("kind"), m.alias("value"))
    step = lambda acc, p: F.struct(
        (acc["at"] + F.length(p["gap"]) + F.length(p["m"])).alias("at"),
        F.concat(acc["spans"], F.array(span(acc["at"] + F.length(p["gap"]), p["m"]))).alias("spans"),
    )
    pairs = F.zip_with(gaps, matches, lambda g, m: F.struct(g.alias("gap"), m.alias("m")))
    start = F.lit(0).cast("long").alias("at")
    inner = F.transform(chunks(pairs), lambda part: F.aggregate(part, F.struct(start, empty.alias("spans")), step))
    outer = lambda acc, part: F.struct(
        (acc["at"] + part["at"]).alias("at"), F.concat(acc["parts"], F.array(F.transform(part["spans"], lambda s: moved(s, acc["at"])))).alias("parts")
    )
    return F.aggregate(inner, F.struct(start, F.array().cast(f"array<{SPANS}>").alias("parts")), outer, lambda acc: F.flatten(acc["parts"]))


HINTS = {"email": "@", "phone": "+"}


def base_spans(docs: DataFrame, out: str = "spans") -> DataFrame:
    """`docs` with an array column `out` of all valid base spans, by start and kind."""
    text = F.coalesce(F.col("text"), F.lit(""))
    kinds = list(PATTERNS)
    none = F.array().cast("array<string>")
    found = {}
    for k in kinds:
        may = text.contains(HINTS[k]) if k in HINTS else text.rlike(r"[0-9]++\.[0-9]++\.[0-9]++\." if k == "ip" else r"[0-9](?:[\x20-]?+[0-9]){11}")
        found[f"__{k}"] = F.when(may, F.regexp_extract_all(text, F.lit(PATTERNS[k]), F.lit(0))).otherwise(none)
    seen = docs.withColumns(found)
    empty = F.array().cast(SPANS)

    def checked(kind: str) -> Column:
        spans = placed(text, PATTERNS[kind], F.col(f"__{kind}"), kind)
        return F.when(F.size(f"__{kind}") > 0, F.filter(spans, lambda s: valid(kind, s["value"]))).otherwise(empty)

    spans = [checked(k) for k in kinds]
    return seen.withColumn(out, F.array_sort(F.concat(*spans))).drop(*found)


def contexts(text: Column, spans: Column) -> Column:
    """The spans' entities, and the text around each without the words that the window cuts."""

    def around(s: Column, low: Column, stretch: Column) -> Column:
        start, end = s["start"], s["end"]
        first = F.greatest(start - CONTEXT, F.lit(0))
        cut = lambda a, b: F.substring(stretch, (a - low + 1).cast("int"), (b - a).cast("int"))
        left = F.when(first > 0, F.regexp_replace(cut(first, start), r"^\S+", "")).otherwise(cut(first, start))
        right = F.regexp_replace(cut(end, end + CONTEXT), r"\S+$", "")
        return F.struct(entities(s).alias("entities"), F.concat_ws("\n", left, right).alias("context"))

    # a chunk's own stretch of the text, so that no window is looked up from the text's beginning
    low = lambda some: F.greatest(F.element_at(some, 1)["start"] - CONTEXT, F.lit(0))
    high = lambda some: F.array_max(F.transform(some, lambda s: s["end"])) + CONTEXT
    stretches = F.transform(chunks(spans), lambda some: F.struct(some.alias("spans"), low(some).alias("low"), F.substring(text, (low(some) + 1).cast("int"), (high(some) - low(some)).cast("int")).alias("text")))
    return F.flatten(F.transform(stretches, lambda c: F.transform(c["spans"], lambda s: around(s, c["low"], c["text"]))))


def entities(span: Column) -> Column:
    """Names of the protected value, however it is written, and of what it belongs to."""
    kind, digits, value = span["kind"], F.regexp_replace(span["value"], "[^0-9]", ""), F.lower(span["value"])
    person, domain = F.regexp_replace(F.substring_index(value, "@", 1), "[^a-z]", ""), F.substring_index(value, "@", -1)
    whole = F.concat(kind, F.lit(":"), F.when(kind.isin("card", "phone"), digits).otherwise(value))
    email = F.array(whole, F.concat(F.lit("person:"), person), F.concat(F.lit("domain:"), domain))
    part = lambda name, of: F.array(whole, F.concat(F.lit(f"{name}:"), of))
    return F.when(kind == "email", email).when(kind == "ip", part("network", F.substring_index(value, ".", 2))).when(kind == "card", part("issuer", F.substring(digits, 1, 6))).otherwise(part("area", F.substring(digits, 1, 4)))


def text_keys() -> list[Column]:
    """Two hashes that name a text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return [F.xxhash64(text).alias("key"), F.xxhash64(F.lit(1), text).alias("key2")]


KEYS = ["key", "key2"]


def found_in(docs: DataFrame) -> DataFrame:
    """doc_id, keys of the text, spans, around: a light row for every document, written for several uses."""
    text = F.coalesce(F.col("text"), F.lit(""))
    seen = base_spans(docs.select("doc_id", "text"))
    return written(seen.select("doc_id", *text_keys(), "spans", contexts(text, F.col("spans")).alias("around")), "pii")


def terms_of(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0)))


def disclosing(docs: DataFrame, found: DataFrame, disclosure: float = DISCLOSURE, support: int = SUPPORT) -> DataFrame:
    """entity, term: the terms that reveal a protected entity, by counts over the whole corpus."""
    near = found.where(F.size("around") > 0).select("key", F.explode("around").alias("a")).select("key", "a.entities", F.xxhash64("a.context").alias("at"), "a.context")
    distinct = near.select(F.explode("entities").alias("entity"), "at", "context").groupBy("entity", "at").agg(F.min("context").alias("context"))
    both = distinct.select("entity", F.explode(terms_of(F.col("context"))).alias("term")).groupBy("entity", "term").agg(F.count("*").alias("n_both")).where(F.col("n_both") >= support)
    of_entity = distinct.groupBy("entity").agg(F.count("*").alias("n_entity"))
    n = F.lit(float(found.select(*KEYS).distinct().count()))
    own = F.log2(n / F.col("n_entity"))
    reveals = lambda n_term: (own >= OWN_BITS) & (F.log2(n * F.col("n_both") / (F.col("n_entity") * F.greatest(n_term, F.col("n_both")))) >= F.lit(disclosure) * own)
    # a term is in at least as many texts as have it near some value; that alone rules most terms out
    least = near.select("key", F.explode(terms_of(F.col("context"))).alias("term")).groupBy("term").agg(F.count_distinct("key").alias("n_near"))
    likely = both.join(of_entity, "entity").join(least, "term").where(reveals(F.col("n_near"))).select("entity", "term", "n_both", "n_entity")
    likely = small(likely, "pii-likely", BROADCAST_ROWS)
    words = docs.select(text_keys()[0], F.explode(terms_of(F.coalesce("text", F.lit("")))).alias("term"))
    texts = words.join(small(likely.select("term").distinct(), "pii-words", BROADCAST_ROWS), "term", "left_semi").groupBy("term").agg(F.count_distinct("key").alias("n_term"))
    return likely.join(texts, "term").where(reveals(F.col("n_term"))).select("entity", "term")


def term_spans(docs: DataFrame, found: DataFrame, **options) -> DataFrame:
    """key, key2, terms (array of spans) for the texts that hold an entity with disclosing terms."""
    flagged = small(disclosing(docs, found, **options), "pii-flagged", BROADCAST_ROWS)
    holds = found.where(F.size("around") > 0).select(*KEYS, F.explode(F.array_distinct(F.flatten(F.transform("around", lambda a: a["entities"])))).alias("entity"))
    wanted = written(holds.join(flagged, "entity").select(*KEYS, "term").distinct(), "pii-wanted")
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"), *text_keys()).join(small(wanted.select(*KEYS).distinct(), "pii-texts", BROADCAST_ROWS), KEYS, "left_semi")
    texts = base_spans(texts.dropDuplicates(KEYS))
    # base spans become digits, which no term holds or touches
    texts = texts.withColumn("open", masked(F.col("text"), F.col("spans"), lambda s, at: F.repeat(F.lit("0"), F.greatest(s["end"] - F.greatest(s["start"], at), F.lit(0)).cast("int"))))
    texts = texts.withColumn("matches", F.regexp_extract_all("open", F.lit(TERM), F.lit(0)))
    words = texts.select(*KEYS, F.explode(placed(F.col("open"), TERM, F.col("matches"), "term")).alias("span")).withColumn("term", F.lower("span.value"))
    return words.join(wanted, [*KEYS, "term"]).groupBy(*KEYS).agg(F.array_sort(F.collect_list("span")).alias("terms"))


def all_spans(found: DataFrame, terms: DataFrame) -> DataFrame:
    """`found` with all_spans: its base spans and its terms."""
    return found.join(terms, KEYS, "left").withColumn("all_spans", F.when(F.size("terms") > 0, F.array_sort(F.concat("spans", "terms"))).otherwise(F.col("spans")))


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digests(docs: DataFrame) -> DataFrame:
    """Counts, digest and list of the spans of every document."""
    found = found_in(docs)
    spans = all_spans(found, small(term_spans(docs, found), "pii-terms", BROADCAST_ROWS))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [count(k) for k in PATTERNS]
    return spans.select("doc_id", *counts, F.sha2(listed(F.col("spans")), 256).alias("base_sha256"), listed(F.col("all_spans")).alias("spans"))


def label(s: Column, at: Column) -> Column:
    """A span generalised to its kind in brackets; spans that overlap become one."""
    return F.when(s["start"] >= at, F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise(F.lit(""))


def masked(text: Column, spans: Column, filled=label) -> Column:
    """The text with each span replaced by `filled(span, end of the spans before it)`; spans are sorted."""
    none = F.array().cast("array<string>")

    def part(acc: Column, some: Column) -> Column:
        # a chunk's own stretch of the text, so that no span is looked up from the text's beginning
        stretch = F.substring(text, (acc["at"] + 1).cast("int"), F.greatest(F.element_at(some, -1)["start"] - acc["at"], F.lit(0)).cast("int"))
        start = F.struct(acc["at"].alias("at"), acc["at"].alias("base"), stretch.alias("stretch"), acc["done"].alias("done"), none.alias("parts"))
        return F.aggregate(some, start, step, lambda s: F.struct(s["at"].alias("at"), F.concat(s["done"], F.array(F.array_join(s["parts"], ""))).alias("done")))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(acc["stretch"], (acc["at"] - acc["base"] + 1).cast("int"), F.greatest(s["start"] - acc["at"], F.lit(0)).cast("int"))
        parts = F.concat(acc["parts"], F.array(gap, filled(s, acc["at"])))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["base"].alias("base"), acc["stretch"].alias("stretch"), acc["done"].alias("done"), parts.alias("parts"))

    rest = lambda acc: F.concat(F.array_join(acc["done"], ""), F.substring(text, (acc["at"] + 1).cast("int"), F.length(text)))
    return F.aggregate(chunks(spans), F.struct(F.lit(0).cast("long").alias("at"), none.alias("done")), part, rest)


def sanitise(docs: DataFrame) -> DataFrame:
    """`docs` with spans in `text` replaced, and n_chars, where it exists, brought up to date."""
    terms = small(term_spans(docs, found_in(docs)), "pii-terms", BROADCAST_ROWS)
    own, other = text_keys()
    keyed = terms.select(F.col("key").alias("__key"), F.col("key2").alias("__key2"), F.col("terms").alias("__terms"))
    joined = base_spans(docs, "__spans").join(keyed, (own == F.col("__key")) & (other == F.col("__key2")), "left")
    both = F.when(F.size("__terms") > 0, F.array_sort(F.concat("__spans", "__terms"))).otherwise(F.col("__spans"))
    done = joined.withColumn("__spans", both).withColumn("text", F.when(F.size("__spans") > 0, masked(F.col("text"), F.col("__spans"))).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.when(F.size("__spans") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return done.select(*docs.columns)
