"""Ranked search: BM25 over postings, vectors by blocks of queries, page-level factors and fusion."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltlane.functions import text as words_of
from voltlane.functions.porter import stemmed, stems_of
from voltlane.functions.scalar import base_name

# Fixed values of the ranking.
K1, B = 1.2, 0.75
WEIGHTS = {"title": 8.0, "heading": 3.0, "text": 1.0}
KIND_FACTOR = {"page": 1.0, "work_log": 0.5, "meeting_notes": 0.6, "credentials_link_only": 1.0, "attachment": 0.9, "attachment_link_only": 0.9, "drive_doc": 0.95, "drive_link_only": 0.7, "drive_folder": 0.7, "repo": 1.0, "repo_doc": 0.95}
TITLE_BOOST, TITLE_EXACT_BOOST, PATH_BOOST, RECENCY_BOOST, HALF_LIFE_DAYS = 0.5, 0.25, 0.4, 0.3, 365
EMPTY_FACTOR, ADMIN_FACTOR, OTHER_SUBTEAM_FACTOR = 0.3, 0.4, 0.6
WEIGHT_FLOOR, COVERAGE_POWER = 0.2, 2.0
SOURCES, PER_FOLDER, MOST_HITS = ("confluence", "drive", "github"), 2, 10
ADMIN = r"(?i)\b(resumes?|cv|roster|procurement|professional development|finances?|alumni)\b"
SUBTEAMS = {"electrical": "electrical", "elec": "electrical", "mechanical": "mechanical", "mech": "mechanical", "telemetry": "telemetry", "telem": "telemetry", "software": "software", "autonomy": "autonomy", "operations": "operations", "ops": "operations", "business": "business"}

#: Distinct query words that one pass broadcasts, at most; beyond, words are joined by a shuffle.
BROADCAST_TERMS = 200_000
#: Query vectors that one pass broadcasts, at most.
QUERY_BLOCK = 4096
#: Vectors that are multiplied with a block of queries at a time: 8 MB of similarities.
ROWS = 256


def bm25(docs: DataFrame, queries: DataFrame, k: int = 200, weights: dict[str, float] | None = None, porter: bool = False) -> DataFrame:
    """The k best documents of each query: query_id, doc_id, score, place.

    docs: doc_id and the weighted text columns; queries: query_id, q. Word frequencies are
    weighted sums over the columns. Only words that some query has become postings, so the
    shuffle holds those alone. Ties go to the smaller doc_id.

    `porter`: words of all scripts meet by Porter's stem, without accents; stems are made once per distinct word of the corpus."""
    weights = weights or {"text": 1.0}
    pattern = words_of.ANY_WORD if porter else words_of.WORD
    asked = queries.select("query_id", F.explode(F.array_distinct(words_of.words(F.col("q"), pattern))).alias("term"))
    if porter:
        asked = stemmed(asked).distinct()
    # one row of each text has the term '' and counts the text itself; no word is empty
    terms = asked.select("term").union(docs.sparkSession.range(1).select(F.lit("").alias("term"))).distinct()
    few = terms.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS
    sent = F.broadcast if few else lambda df: df
    # exploded from an array of one, a list of words is made once however often it is used
    tokens = docs.select("doc_id", F.explode(F.array(F.struct(*[words_of.words(F.col(c), pattern).alias(c) for c in weights]))).alias("x")).select("doc_id", "x.*")
    length = sum((F.size(c) * w for c, w in weights.items()), F.lit(0.0))
    itself = F.array(F.struct(F.lit("").alias("term"), F.lit(1.0).alias("w")))
    said = tokens.select("doc_id", length.alias("dl"), F.explode(F.concat(itself, *[_weighted(c, w) for c, w in weights.items()])).alias("x"))
    said = said.select("doc_id", "dl", F.col("x.term").alias("term"), F.col("x.w").alias("w"))
    if porter:  # only words whose stem is asked go on
        kept = stems_of(said).join(sent(terms), "term")
        said = said.withColumnRenamed("term", "__word").join(sent(kept), "__word").drop("__word")
    else:
        said = said.join(sent(terms), "term")
    # dealt by text alone, so that scores of a text are added up where its postings are
    postings = said.repartition("doc_id").groupBy("doc_id", "term").agg(F.sum("w").alias("tf"), F.first("dl").alias("dl"), F.sum("dl").alias("__dl"))
    # the row of '' tells all others, one for each asked word, how many texts there are; so the texts are read once
    whole = Window.partitionBy(F.lit(0))
    of_texts = lambda c: F.max(F.when(F.col("term") == "", F.col(c))).over(whole)
    known = postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("__n"), F.sum("__dl").alias("__dl"))
    known = known.select("term", "df", of_texts("__n").alias("n"), (of_texts("__dl") / of_texts("__n")).alias("avgdl"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighed = asked.join(known, "term").select("query_id", "term", "avgdl", idf.alias("idf"))
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    score = postings.join(sent(weighed), "term").groupBy("query_id", "doc_id").agg(F.round(F.sum(part), 6).alias("score"))
    return top(score, k)


def _weighted(column: str, w: float) -> Column:
    return F.transform(column, lambda t: F.struct(t.alias("term"), F.lit(float(w)).alias("w")))


def top(scores: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return scores.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def vector_top(vectors: DataFrame, queries: DataFrame, k: int, block: int = QUERY_BLOCK) -> DataFrame:
    """The k most similar vectors of each query by cosine: query_id, doc_id, score, place.

    vectors: doc_id, v; queries: query_id, v. Queries go out in blocks of at most `block`
    rows; every task multiplies its vectors with the block and hands on k candidates for
    each query, so what is shuffled does not hold all pairs. A zero vector has
    cosine 0. Ties go to the smaller doc_id."""
    spark, found = vectors.sparkSession, None
    held: list[tuple[int, list[float]]] = []
    rows = queries.orderBy("query_id").toLocalIterator()

    def scan(ids: np.ndarray, matrix: np.ndarray) -> DataFrame:
        sent = spark.sparkContext.broadcast((ids, matrix))

        def multiply(batches):
            q_ids, q = sent.value
            sims, ids = np.zeros((0, len(q_ids))), np.zeros((0, len(q_ids)), np.int64)
            for batch in batches:
                for at in range(0, len(batch), ROWS):  # the task's best so far and some more rows
                    part = batch.slice(at, ROWS)
                    doc, column = part.column("doc_id").to_numpy(zero_copy_only=False), part.column("v")
                    if len(set(pc.list_value_length(column).to_pylist())) != 1:
                        raise ValueError("vectors differ in length")
                    matrix = unit(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(doc), -1))
                    order = np.argsort(doc, kind="stable")
                    near = np.round(matrix[order] @ q.T, 6)
                    rows = np.argsort(-near, axis=0, kind="stable")[:k]
                    sims, ids = np.concatenate([sims, np.take_along_axis(near, rows, 0)]), np.concatenate([ids, doc[order][rows]])
                    best = np.lexsort((ids, -sims), axis=0)[:k]
                    sims, ids = np.take_along_axis(sims, best, 0), np.take_along_axis(ids, best, 0)
            if len(sims):
                yield pa.RecordBatch.from_arrays([pa.array(np.tile(q_ids, len(sims))), pa.array(ids.ravel()), pa.array(sims.ravel())], names=["query_id", "doc_id", "score"])

        return vectors.select("doc_id", "v").mapInArrow(multiply, "query_id long, doc_id long, score double")

    def flush():
        nonlocal found
        part = scan(np.array([i for i, _ in held], np.int64), unit(np.array([v for _, v in held], np.float64)))
        found = part if found is None else found.unionByName(part)
        held.clear()

    for r in rows:
        held.append((r["query_id"], r["v"]))
        if len(held) == block:
            flush()
    if held:
        flush()
    if found is None:
        return spark.createDataFrame([], "query_id long, doc_id long, score double, place int")
    return top(found, k)


def unit(m: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(norm == 0, 1, norm)


def share(query_stems: Column, text: Column) -> Column:
    """Which part of the query's stems the text has; 0 without any."""
    distinct = F.array_distinct(query_stems)
    return F.when(F.size(distinct) > 0, F.size(F.array_intersect(distinct, words_of.stems(text))) / F.size(distinct)).otherwise(0.0)


def title_factor(query_stems: Column, title: Column) -> Column:
    of_title = F.array_distinct(words_of.stems(title))
    s = share(query_stems, title)
    exact = (F.size(of_title) > 0) & (F.size(F.array_except(of_title, query_stems)) == 0) & (s == 1)
    return 1 + TITLE_BOOST * s + F.when(exact, TITLE_EXACT_BOOST).otherwise(0.0)


def path_factor(query_stems: Column, path: Column) -> Column:
    return 1 + PATH_BOOST * share(query_stems, F.array_join(path, " "))


def recency_factor(updated: Column, now: Column) -> Column:
    """Up to 30 % more for what changed lately; 1 for dates that cannot be read."""
    age = F.timestamp_diff("SECOND", F.try_to_timestamp(updated), now) / 86400
    days = F.when(age > 0, age).when(age.isNotNull(), 0.0)  # greatest() would make an unreadable date new
    return F.coalesce(1 + RECENCY_BOOST * F.pow(F.lit(0.5), days / HALF_LIFE_DAYS), F.lit(1.0))


def admin_factor(query: Column, title: Column, path: Column) -> Column:
    return F.when(F.concat_ws(" ", title, F.array_join(path, " ")).rlike(ADMIN) & ~query.rlike(ADMIN), ADMIN_FACTOR).otherwise(1.0)


def subteam_factor(query: Column, title: Column, path: Column) -> Column:
    """Less for pages that live under another subteam than the one asked for."""
    known = F.create_map(*[x for k, v in SUBTEAMS.items() for x in (F.lit(k), F.lit(v))])
    teams = lambda c: F.array_compact(F.transform(F.regexp_extract_all(F.lower(c), F.lit(words_of.WORD), F.lit(0)), lambda w: F.element_at(known, w)))
    asked, have = teams(query), teams(F.concat_ws(" ", F.array_join(F.slice(path, 1, 3), " "), title))
    return F.when((F.size(asked) > 0) & (F.size(have) > 0) & ~F.arrays_overlap(asked, have), OTHER_SUBTEAM_FACTOR).otherwise(1.0)


def kind_factor(kind: Column) -> Column:
    known = F.create_map(*[x for k, v in KIND_FACTOR.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.element_at(known, kind), F.lit(1.0))


def best_per_page(scores: DataFrame) -> DataFrame:
    """One row per query and page: its best section (query_id, page_id, doc_id, score)."""
    return scores.groupBy("query_id", "page_id").agg(F.max(F.struct("score", (-F.col("doc_id")).alias("n"))).alias("m")).select("query_id", "page_id", (-F.col("m.n")).alias("doc_id"), "m.score")


def empty_factor(query_stems: Column, title: Column, empty: Column, kind: Column) -> Column:
    """Less for pages without text of their own, the less of the question their title has."""
    return F.when(empty & (kind != "credentials_link_only"), EMPTY_FACTOR + (1 - EMPTY_FACTOR) * share(query_stems, title)).otherwise(1.0)


def keyword_ranked(pages: DataFrame, sections: DataFrame, queries: DataFrame, now: Column, k: int = 200) -> DataFrame:
    """query_id, doc_id, page_id, score, place: the best section of each page, with all factors.

    pages: page_id, kind, title, breadcrumb (array), updated, empty; sections: doc_id, page_id, heading, text; queries: query_id, q."""
    texts = sections.join(pages.select("page_id", "title"), "page_id").select("doc_id", "page_id", "title", "heading", "text")
    found = bm25(texts, queries.select("query_id", "q"), k, WEIGHTS).drop("place")
    j = found.join(sections.select("doc_id", "page_id"), "doc_id").join(pages, "page_id").join(queries, "query_id")
    stems = words_of.stems(F.col("q"))
    score = F.col("score") * kind_factor(F.col("kind")) * empty_factor(stems, F.col("title"), F.col("empty"), F.col("kind"))
    best = best_per_page(j.select("query_id", "page_id", "doc_id", score.alias("score")))
    j = best.join(pages, "page_id").join(queries, "query_id")
    factors = title_factor(stems, F.col("title")) * path_factor(stems, F.col("breadcrumb")) * recency_factor(F.col("updated"), now) * admin_factor(F.col("q"), F.col("title"), F.col("breadcrumb")) * subteam_factor(F.col("q"), F.col("title"), F.col("breadcrumb"))
    return top(j.select("query_id", "doc_id", "page_id", F.round(F.col("score") * factors, 6).alias("score")), k)


def search(pages: DataFrame, sections: DataFrame, queries: DataFrame, now: Column, limit: int = 5, sources: list[str] | None = None, vectors: DataFrame | None = None, query_vectors: DataFrame | None = None) -> DataFrame:
    """The hits of each question, as a user gets them: query_id, place, page_id, doc_id, source, title, url, updated, heading, text, score.

    Keyword ranking with all factors, fused with the nearest sections where vectors are given (doc_id, v; query_id, v).
    Of copies of one file (`drive`, by base name) the best stays, of a repository's folder (`github`) the best PER_FOLDER."""
    ranked = keyword_ranked(pages, sections, queries, now)
    if vectors is not None and query_vectors is not None:
        best = coverage(ranked.where("place = 1").select("query_id", "doc_id"), queries, sections)
        near = vector_top(vectors, query_vectors, 50).join(sections.select("doc_id", "page_id"), "doc_id")
        near = best_per_page(near).select("query_id", "doc_id", "score")
        fused = fuse(ranked.select("query_id", "doc_id", "score"), near, best)
        ranked = best_per_page(fused.join(sections.select("doc_id", "page_id"), "doc_id"))
    ranked = top(ranked.select("query_id", "doc_id", "page_id", "score").join(pages.where(F.col("source").isin(*(sources or SOURCES))), "page_id"), 1000)
    same = F.when(F.col("source") == "drive", base_name(F.col("title"))).when(F.col("source") == "github", F.array_join(F.slice("breadcrumb", 1, 3), " > ")).otherwise(F.col("page_id").cast("string"))
    nth = F.row_number().over(Window.partitionBy("query_id", "source", same).orderBy("place"))
    kept = ranked.withColumn("__n", nth).where(F.col("__n") <= F.when(F.col("source") == "github", PER_FOLDER).otherwise(1))
    hits = top(kept.drop("place"), max(1, min(limit, MOST_HITS)))
    return hits.join(sections.select("doc_id", "heading", "text"), "doc_id").select("query_id", "place", "page_id", "doc_id", "source", "title", "url", "updated", "heading", "text", F.round("score", 3).alias("score"))


def linked_files(hits: DataFrame, links: DataFrame, pages: DataFrame, most: int = 3) -> DataFrame:
    """Files that the hits' sections link to and that are no hits themselves, at most `most` a question: query_id, file_id, title, url, via.

    hits: query_id, place, page_id, doc_id; links: doc_id, at, file_id, url, text."""
    known = pages.where("source = 'drive'").select(F.col("page_id").alias("file_id"), F.col("title").alias("__title"), F.col("url").alias("__url"))
    j = hits.select("query_id", "place", F.col("page_id").alias("via"), "doc_id").join(links, "doc_id")
    j = j.join(hits.select("query_id", F.col("page_id").alias("file_id")), ["query_id", "file_id"], "left_anti")
    once = j.groupBy("query_id", "file_id").agg(F.min(F.struct("place", "at", "via", "url", "text")).alias("m")).select("query_id", "file_id", "m.*")
    w = Window.partitionBy("query_id").orderBy("place", "at", "file_id")
    own = F.when((F.col("text") != "") & (F.col("text") != F.col("url")), F.col("text")).otherwise("linked file")
    first = once.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= most).join(known, "file_id", "left")
    return first.select("query_id", "file_id", F.coalesce("__title", own).alias("title"), F.coalesce("__url", "url").alias("url"), "via")


def fuse(keyword: DataFrame, vector: DataFrame, coverage: DataFrame) -> DataFrame:
    """Both rankings as one: query_id, doc_id, score.

    Keyword scores count against the query's best, similarities between the candidates'
    least and greatest (1 if all are equal). The keyword side weighs more the more of the
    query's words its best hit has (coverage: query_id, coverage)."""
    q = Window.partitionBy("query_id")
    kw = keyword.select("query_id", "doc_id", (F.col("score") / F.when(F.max("score").over(q) > 0, F.max("score").over(q)).otherwise(1.0)).alias("k"))
    span = F.max("score").over(q) - F.min("score").over(q)
    vec = vector.select("query_id", "doc_id", F.when(span > 0, (F.col("score") - F.min("score").over(q)) / span).otherwise(1.0).alias("s"))
    w = WEIGHT_FLOOR + (1 - WEIGHT_FLOOR) * F.pow(F.coalesce("coverage", F.lit(0.0)), COVERAGE_POWER)
    both = kw.join(vec, ["query_id", "doc_id"], "full_outer").join(coverage, "query_id", "left")
    return both.select("query_id", "doc_id", F.round(w * F.coalesce("k", F.lit(0.0)) + (1 - w) * F.coalesce("s", F.lit(0.0)), 6).alias("score"))


def coverage(best: DataFrame, queries: DataFrame, docs: DataFrame) -> DataFrame:
    """query_id and the share of its stems in the text of its best keyword hit (best: query_id, doc_id)."""
    met = best.join(docs.select("doc_id", "text"), "doc_id").join(queries, "query_id")
    return met.select("query_id", share(words_of.stems(F.col("q")), F.col("text")).alias("coverage"))


def per_group(ranked: DataFrame, group: str, most: int) -> DataFrame:
    """At most `most` hits of each group and query, in rank order."""
    w = Window.partitionBy("query_id", group).orderBy("place")
    return ranked.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= most).drop("__n")
