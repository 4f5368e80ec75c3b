"""The document library and the recordings' bookkeeping, as joins and rule chains."""

from __future__ import annotations

import io
import re
import zipfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voltlane.functions.scalar import local_date, local_time
from voltlane.operators.blocks import _BLOCKS, BLOCK, block, squeeze

# Fixed rules: what pages, files and folders are.
WORK_LOG = r"(?i)\bwork\s*-?\s*logs?\b|\bworklogs?\b|\bdaily\s+logs?\b"
MEETING = r"(?i)\bmeeting\s+(notes|minutes)\b|\bminutes\b|\bstandup\b|\bstand-up\b"
CREDENTIAL_TITLE = r"(?i)\b(passwords?|credentials?|logins?|secrets?)\b"
HIDDEN_LABELS = ("no-tern", "no_tern", "notern")


def page_kind(title: Column, labels: Column) -> Column:
    joined, low = F.concat_ws(" ", title, F.array_join(labels, " ")), F.transform(labels, F.lower)
    has = lambda *names: F.arrays_overlap(low, F.array(*map(F.lit, names)))
    return F.when(joined.rlike(WORK_LOG) | has("work-log", "worklog", "work_log"), "work_log").when(joined.rlike(MEETING) | has("meeting-notes", "meeting_notes"), "meeting_notes").otherwise("page")


def skip_reason(pages: DataFrame, restricted: DataFrame, space: str) -> DataFrame:
    """Pages with why they are not indexed (null: they are). A restriction reaches all pages below.

    pages: page_id, space, restricted, ancestor_ids, labels, title; restricted: page_id."""
    ids = restricted.select("page_id").distinct()
    own = ids.withColumn("__own", F.lit(True))
    above = pages.select("page_id", F.explode("ancestor_ids").alias("a")).join(ids.withColumnRenamed("page_id", "a"), "a", "left_semi").select("page_id").distinct().withColumn("__above", F.lit(True))
    j = pages.join(own, "page_id", "left").join(above, "page_id", "left")
    hidden = F.arrays_overlap(F.transform("labels", F.lower), F.array(*map(F.lit, HIDDEN_LABELS)))
    reason = (
        F.when((F.coalesce("space", F.lit("")) != "") & (F.col("space") != F.lit(space.lower())), "other space")
        .when(F.col("restricted") | F.col("__own"), "restricted")
        .when(F.col("__above"), "restricted ancestor")
        .when(hidden, "no-tern label")
        .when(F.col("title").rlike(CREDENTIAL_TITLE), "credentials title")
    )
    return j.withColumn("reason", reason).drop("__own", "__above")


def changed(listed: DataFrame, indexed: DataFrame, key: list[str], version: list[str]) -> DataFrame:
    """key and action: `add`, `update` where a version column differs, `delete` where it is listed no more."""
    a = listed.select(*key, F.struct(*version).alias("__new"))
    b = indexed.select(*key, F.struct(*version).alias("__old"))
    both = a.join(b, key, "full_outer")
    action = F.when(F.col("__old").isNull(), "add").when(F.col("__new").isNull(), "delete").when(~F.col("__new").eqNullSafe(F.col("__old")), "update")
    return both.select(*key, action.alias("action")).where("action is not null")


def next_jobs(jobs: DataFrame) -> DataFrame:
    """The oldest queued job of each lane whose recording has no scan waiting or running (unless it is that scan).

    jobs: job_id, lane, kind, recording_id, status, created_at, attempts (at most two)."""
    scans = jobs.where("kind = 'scan' and status in ('queued', 'running')").select("recording_id").distinct()
    free = jobs.where("status = 'queued' and attempts < 2")
    ready = free.where("kind = 'scan'").unionByName(free.where("kind <> 'scan'").join(scans, "recording_id", "left_anti").select(*free.columns))
    return ready.groupBy("lane").agg(F.min(F.struct("created_at", "job_id")).alias("j")).select("lane", "j.job_id")


def reconcile(folders: DataFrame, catalog: DataFrame) -> DataFrame:
    """Folders whose recording the catalog lacks and whose files are whole (their size is the manifest's)."""
    return folders.where("size = manifest_size").join(catalog.select("recording_id"), "recording_id", "left_anti")


def keep_newest(copies: DataFrame, group: list[str], order: str, most: int = 7) -> DataFrame:
    w = Window.partitionBy(*group).orderBy(F.desc(order))
    return copies.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= most).drop("__n")


def run_ids(recordings: DataFrame) -> DataFrame:
    """recording_id and its run_id: local day, last six characters of the id, and a number from the second on."""
    stem = F.concat_ws("-", local_date(F.col("start_s")), F.right(F.col("recording_id"), F.lit(6)))
    n = F.row_number().over(Window.partitionBy("__stem").orderBy("start_s", "recording_id"))
    named = recordings.withColumn("__stem", stem).withColumn("__n", n)
    return named.select("recording_id", F.when(F.col("__n") == 1, F.col("__stem")).otherwise(F.concat_ws("-", "__stem", F.col("__n").cast("string"))).alias("run_id"))


def contributions(changes: DataFrame) -> DataFrame:
    """Per author the commits and lines over all repositories and weeks, and the repositories."""
    return changes.groupBy("author").agg(F.sum("commits").alias("commits"), F.sum("added").alias("added"), F.sum("deleted").alias("deleted"), F.sort_array(F.collect_set("repo")).alias("repos"))


def documents_view(pages: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row per document: kind, path as text, local times and its number of sections."""
    n = chunks.groupBy("page_id").agg(F.count("*").alias("sections"))
    seconds = lambda c: F.unix_timestamp(F.try_to_timestamp(c)).cast("double")
    return pages.join(n, "page_id", "left").select("page_id", "title", "kind", F.array_join("breadcrumb", " > ").alias("path"), local_time(seconds(F.col("updated"))).alias("updated"), F.coalesce("sections", F.lit(0).cast("long")).alias("sections"))


def get_document(pages: DataFrame, chunks: DataFrame, name: str, section: str | None = None, most: int = 12_000) -> DataFrame:
    """A document by id, else by exact title, else by the only title that holds the name; its text, or one section by number or heading."""
    rank = F.when(F.col("page_id").cast("string") == name, 0).when(F.lower("title") == name.lower(), 1).when(F.contains(F.lower(F.col("title")), F.lit(name.lower())), 2)
    ranked = pages.withColumn("__rank", rank).where("__rank is not null")
    best = ranked.agg(F.min("__rank").alias("__best"))
    hit = ranked.join(F.broadcast(best), F.col("__rank") == F.col("__best"))
    alone = hit.agg(F.count("*").alias("__n"))
    hit = hit.join(F.broadcast(alone)).where("__rank < 2 or __n = 1").select("page_id", "title")
    parts = chunks
    if section is not None:
        parts = chunks.where(F.col("ordinal") == int(section)) if section.isdigit() else chunks.where(F.contains(F.lower(F.col("heading")), F.lit(section.lower())))
    texts = hit.join(parts, "page_id").groupBy("page_id", "title").agg(F.sort_array(F.collect_list(F.struct("ordinal", "text"))).alias("t"))
    return texts.select("page_id", "title", F.substring(F.array_join(F.transform("t", lambda x: x["text"]), "\n\n"), 1, most).alias("text"))


def office_blocks(name: str, body: bytes) -> list[dict]:
    """Paragraphs of docx and pptx files (their XML is in a zip), lines of plain text; other files give nothing."""
    ending = name.rsplit(".", 1)[-1].lower()
    if ending in ("txt", "md"):
        return [block("para", t) for t in map(squeeze, re.split(r"\n\s*\n", body.decode("utf-8", "replace"))) if t]
    if ending not in ("docx", "pptx"):
        return []
    try:
        with zipfile.ZipFile(io.BytesIO(body)) as z:
            inside = r"word/document\.xml" if ending == "docx" else r"ppt/slides/slide\d+\.xml"
            number = lambda n: [int(x) for x in re.findall(r"\d+", n)]
            parts = [z.read(n).decode("utf-8", "replace") for n in sorted((n for n in z.namelist() if re.fullmatch(inside, n)), key=number)]
    except (zipfile.BadZipFile, KeyError):
        return []
    tag = "w" if ending == "docx" else "a"
    paragraphs = [p for x in parts for p in re.findall(rf"<{tag}:p[ >].*?</{tag}:p>", x, re.S)]
    clean = lambda t: t.replace("&lt;", "<").replace("&gt;", ">").replace("&quot;", '"').replace("&amp;", "&")
    return [block("para", t) for t in (squeeze(clean("".join(re.findall(rf"<{tag}:t[^>]*>([^<]*)</{tag}:t>", p)))) for p in paragraphs) if t]


@F.arrow_udf(T.ArrayType(BLOCK))
def from_office(names: pa.Array, bodies: pa.Array) -> pa.Array:
    return pa.array([office_blocks(n or "", b or b"") for n, b in zip(names.to_pylist(), bodies.to_pylist(), strict=True)], _BLOCKS)


def grep(files: DataFrame, question: str, most: int = 10) -> DataFrame:
    """Lines, one around each included, of the files that hold all words of the question (path, text): path, line, excerpt."""
    terms = [w for w in question.lower().split() if w]
    hit = files
    for w in terms:
        hit = hit.where(F.contains(F.lower(F.col("text")), F.lit(w)))
    lines = hit.select("path", F.split("text", "\n").alias("lines")).select("path", "lines", F.posexplode("lines").alias("at", "line"))
    if terms:
        lines = lines.where(F.contains(F.lower(F.col("line")), F.lit(terms[0])))
    around = F.array_join(F.slice("lines", F.greatest(F.col("at"), F.lit(1)), F.when(F.col("at") == 0, 2).otherwise(3)), "\n")
    return lines.select("path", (F.col("at") + 1).alias("line"), around.alias("excerpt")).orderBy("path", "line").limit(most)


# Fixed rules: which files of a repository are read.
README = r"(?i)^readme(\.[a-z0-9]+)?$"
TEXT_ENDINGS = (".md", ".markdown", ".rst", ".txt", ".csv", ".tsv", ".json", ".yaml", ".yml", ".toml")
CONFIG_ENDINGS = (".json", ".yaml", ".yml", ".toml")
DOC_FOLDERS = ("docs", "doc", "documentation", "wiki", "guides", "manual")
SKIPPED_FOLDERS = (
    "node_modules", "vendor", "vendors", "third_party", "third-party", "thirdparty", "external", "build", "dist", "out", "target", ".venv", "venv", "env", "__pycache__", "site-packages", ".next", ".nuxt",
    "coverage", ".tox", ".mypy_cache", ".pytest_cache", "bower_components", ".git", ".idea", ".vscode",
)
LOCK_FILES = ("package-lock.json", "yarn.lock", "pnpm-lock.yaml", "poetry.lock", "cargo.lock", "uv.lock", "pipfile.lock", "composer.lock", "gemfile.lock", "go.sum", "flake.lock", "npm-shrinkwrap.json")
NOISE = r"(?i)(\.min\.\w+$|^(license|licence|copying|notice)(\.\w+)?$|^\.)"
MANIFESTS = (
    r"(?i)^(cmakelists\.txt|requirements([-_.].*)?\.txt|constraints\.txt|.*\.cmake|(cargo|pyproject|poetry|setup|tsconfig|jsconfig|package|composer|deno|bunfig|"
    r"\.?eslintrc|\.?prettierrc|renovate|dependabot|codecov|mkdocs|netlify|vercel|docker-compose|compose|pnpm-workspace|turbo|nx|lerna|angular|firebase)([-_.].*)?\.(json|toml|ya?ml|cfg|txt))$"
)
MOST_BYTES = 200 * 1024
# Fixed texts of two embedding models, and how many characters of a section they get.
DOC_CHARS = 6000
QWEN_TASK = "Given a question from a team member, retrieve the team documentation sections that answer it"


def readable(path: Column, size: Column, most: int = MOST_BYTES) -> Column:
    """Whether a repository file is read: a readme anywhere, or a text or data file outside vendored, built and hidden
    folders; files of settings only below a folder of documents."""
    parts = F.split(path, "/")
    folders, name = F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), F.lower), F.lower(F.element_at(parts, -1))
    among = lambda names: F.array(*map(F.lit, names))
    shut = F.arrays_overlap(folders, among(SKIPPED_FOLDERS)) | F.exists(folders, lambda f: F.startswith(f, F.lit(".")))
    ending = F.regexp_extract(name, r"[^.](\.[^.]*)$", 1)
    plain = F.when(ending.isin(*CONFIG_ENDINGS), F.arrays_overlap(folders, among(DOC_FOLDERS))).otherwise(ending.isin(*TEXT_ENDINGS))
    fine = F.when(name.rlike(README), True).when(name.rlike(NOISE) | name.rlike(MANIFESTS), False).otherwise(plain)
    return F.coalesce(~shut & ~name.isin(*LOCK_FILES) & (size > 0) & (size <= most) & fine, F.lit(False))


def embedding_text(model: str, title: Column, path: Column, heading: Column, text: Column) -> Column:
    """What a model embeds of a section: its place (two folders, title, heading) and text, in the model's form."""
    two = F.slice(path, F.greatest(F.size(path) - 1, F.lit(1)), F.lit(2))
    place = F.array_join(F.concat(two, F.array(title), F.when(heading != "", F.array(heading)).otherwise(F.array().cast("array<string>"))), " > ")
    body = F.substring(F.regexp_replace(F.concat(place, F.lit("\n"), text), r"^\s+|\s+$", ""), 1, DOC_CHARS)
    return F.substring(F.concat(F.lit("title: "), title, F.lit(" | text: "), body), 1, DOC_CHARS) if model.startswith("embeddinggemma") else body


def embedding_question(model: str, question: Column) -> Column:
    if model.startswith("embeddinggemma"):
        return F.concat(F.lit("task: search result | query: "), question)
    return F.concat(F.lit(f"Instruct: {QWEN_TASK}\nQuery: "), question) if model.startswith("qwen3-embedding") else question


def message_rate(messages: DataFrame, time: str = "t", every_s: float = 1.0) -> DataFrame:
    """run_id, at and per_s: messages a second since the run's mark before, a mark being the last message of a stretch of `every_s`."""
    marks = messages.groupBy("run_id", F.floor(F.col(time) / every_s).alias("slot")).agg(F.max(time).alias("at"), F.count("*").alias("n"))
    w = Window.partitionBy("run_id").orderBy("slot")
    marks = marks.withColumn("since", F.col("at") - F.lag("at").over(w))
    return marks.select("run_id", "at", F.when(F.col("since") >= every_s, F.col("n") / F.col("since")).alias("per_s"))
