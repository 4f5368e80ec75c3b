"""Work that follows the input: no task with a whole group, no pairs of equal rows, no step done twice."""

import math
import random

import pyarrow as pa
from pyspark.sql import functions as F

from voltlane.operators import blocks, catalog, intervals, search, sequence


def test_files_of_an_ask_with_several_stretches_are_not_dealt_again(spark):
    rng = random.Random(5)
    rec = [(k, k if k % 3 else None, float(s := rng.randrange(0, 5000)), float(s + rng.randrange(0, 400) - 20)) for k in range(60)]
    asks = [(a, rng.choice([None, 1, 2, 500]), *(float(x) if x is not None else None for x in rng.choice([(None, None), (100, 900), (4000, 300), (850, 2600)]))) for a in [1, 1, 1, 2, 2, 3, 4]]
    files = [(k % 55, f"f{k}") for k in range(110)]
    found = catalog.find_files(spark.createDataFrame(asks, "ask_id long, run_id long, start_ts double, end_ts double"), spark.createDataFrame(rec, "recording_id long, run_id long, recorded_start double, recorded_end double"), spark.createDataFrame(files, "recording_id long, rel_path string"), cell_s=100.0)
    want = set()
    for ask, run, lo, hi in asks:
        own = [r for r in rec if r[1] == run and run is not None]
        lo, hi = lo if lo is not None else (own[0][2] if own else None), hi if hi is not None else (own[0][3] if own else None)
        for r in rec:
            near = lo is not None and hi is not None and lo <= hi and r[2] <= r[3] and r[2] <= hi and r[3] >= lo
            if near or r in own:
                want |= {(ask, r[0], f) for k, f in files if k == r[0]}
    got = [(r.ask_id, r.recording_id, r.rel_path) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    # the pairs are the result itself: nothing above them deals them by key
    assert found._jdf.queryExecution().optimizedPlan().toString().startswith("Union")


def test_equal_spans_meet_once(spark, monkeypatch):
    a = spark.range(600).select(F.col("id").alias("a_id"), F.lit(0.0).alias("a_start"), F.lit(10.0).alias("a_end"))
    b = spark.range(600).select((1000 - F.col("id")).alias("b_id"), F.lit(2.0).alias("b_start"), F.lit(12.0).alias("b_end"))
    met, pairs = [], intervals.overlap_pairs

    def counted(*of):
        met.append(pairs(*of).count())
        return pairs(*of)

    monkeypatch.setattr(intervals, "overlap_pairs", counted)
    assert {tuple(r) for r in intervals.best_overlap(a, b, 7.0).collect()} == {(k, 401, 0.8) for k in range(600)}
    assert {tuple(r) for r in intervals.overlap_counts(a, b, 7.0).collect()} == {(k, 600) for k in range(600)}
    assert met == [1, 1]


def test_a_running_total_of_one_group_is_dealt_over_ranges(spark):
    rng = random.Random(3)
    rows = [(k, rng.choice(["a", "a", "a", None]), rng.randrange(40), None if k % 9 == 0 else rng.randrange(100)) for k in range(3000)]
    done = catalog.running_total(spark.createDataFrame(rows, "k long, g string, t long, x long"), "x", [F.desc("t"), F.asc("k")], ["g"], "run", range_rows=400)
    got = {r.k: r.run for r in done.collect()}
    tasks = done.select(F.spark_partition_id().alias("p"), "g").where("g = 'a'").groupBy("p").count().collect()
    want, sums = {}, {}
    for k, g, _, x in sorted(rows, key=lambda r: (-r[2], r[0])):
        if x is not None:
            sums[g] = sums.get(g, 0) + x
        want[k] = sums.get(g)
    assert got == want and len(tasks) > 1


def test_workers_hold_a_part_of_the_texts_as_objects():
    held = []

    def make(html):
        held.append(html)
        return blocks.blocks_of(html)

    pages = [f"<h1>t{k}</h1><p>{'x' * 300}</p>" if k % 7 else None for k in range(700)]
    parts, built = [], pa.array

    class Watched:
        def __getattr__(self, name):
            return getattr(pa, name)

        @staticmethod
        def array(row, kind):
            parts.append(len(row))
            return built(row, kind)

    before, blocks.pa = blocks.pa, Watched()
    try:
        done = blocks.in_parts(make, blocks._BLOCKS, built(pages))
    finally:
        blocks.pa = before
    assert done.to_pylist() == [blocks.blocks_of(p) for p in pages] and held == pages
    assert max(parts) <= blocks.TEXTS_AT_A_TIME and sum(parts) == 700
    assert blocks.in_parts(make, blocks._BLOCKS, built([], pa.string())).to_pylist() == []


def test_a_task_hands_on_its_best_vectors_once(spark):
    rows = [(k, [float(k % 7), 1.0]) for k in range(2000)]
    v = spark.createDataFrame(rows, "doc_id long, v array<double>").coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    handed, best = [], search.top

    def counted(scores, k):
        handed.append(scores.count())
        return best(scores, k)

    search.top = counted
    try:
        got = [r.doc_id for r in search.vector_top(v, spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, v array<double>"), 3).orderBy("place").collect()]
    finally:
        search.top = best
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == [6, 13, 20] and handed == [3]


def test_texts_are_cut_to_words_once_and_pairs_stay_where_they_are(spark):
    docs = spark.createDataFrame([(1, "red cars race"), (2, "blue cars"), (3, None), (3, "red red wine")], "doc_id long, text string")
    asked = spark.createDataFrame([(7, "red car"), (8, "cars wine"), (9, "of the")], "query_id long, q string")
    plan = search.bm25(docs, asked, 5)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(query_id" in text and not any("hashpartitioning(query_id" in line and "doc_id" in line for line in text.splitlines())
    n, avg, df = 4, (3 + 2 + 0 + 3) / 4, {"red": 2, "cars": 2, "wine": 1}
    part = lambda w, tf, dl: math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avg))
    got = {(r.query_id, r.doc_id): r.score for r in plan.collect()}
    assert got.keys() == {(7, 1), (7, 3), (8, 1), (8, 2), (8, 3)}
    assert abs(got[7, 1] - part("red", 1, 3)) < 1e-6 and abs(got[8, 2] - part("cars", 1, 2)) < 1e-6


def test_an_encoder_that_forgets_gives_the_same_ids():
    from voltlane.llm import pieces, sp_codec

    vocab = pieces.vocabulary(pieces.default_model())
    small, large = sp_codec.Encoder(vocab, memo=2), sp_codec.Encoder(vocab)
    texts = ["red cars race", "blue cars race again and again", "wine", "red cars"]
    assert [small.encode(t) for t in texts] == [large.encode(t) for t in texts]
    assert len(large.seen) > len(small.seen)
    # the pipeline's workers remember fewer than the operator's own
    assert sp_codec.coders(pieces.default_model())[0].memo > sp_codec.coders(pieces.default_model(), sp_codec.PIPELINE_MEMO)[0].memo


def test_an_encoder_remembers_no_more_than_its_memo_within_one_text():
    from voltlane.llm import pieces, sp_codec

    vocab = pieces.vocabulary(pieces.default_model())
    small, large = sp_codec.Encoder(vocab, memo=100, pair_memo=50), sp_codec.Encoder(vocab)
    text = " ".join(f"again w{i}x{i * i}" for i in range(1000))
    streamed = []
    stream = small.stream
    small.stream = lambda chars: streamed.append(chars) or stream(chars)
    assert small.encode(text) == large.encode(text)
    assert len(small.seen) + len(small.older) <= 100 and len(small.apart) <= 50
    assert streamed.count(sp_codec.MARK + "again") == 1  # what is met again is not forgotten
    # what a worker of the pipeline remembers
    encoder = sp_codec.coders(pieces.default_model(), sp_codec.PIPELINE_MEMO, sp_codec.PIPELINE_PAIR_MEMO)[0]
    assert encoder.memo + encoder.pair_memo <= 200_000


def test_a_worker_of_the_pipeline_gets_two_megabytes_of_text_at_a_time(spark, tmp_path):
    import corpus_pipeline
    from voltlane.llm.common import BATCH, table

    spark.range(40).select(F.col("id").alias("doc_id"), F.expr("repeat('0123456789', 20000)").alias("text")).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    for key in BATCH:
        spark.conf.unset(key)
    docs = table(spark, str(tmp_path), "documents").withColumns({"lang": F.lit("en"), "source": F.lit("web")})
    corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])

    rows = [r.n for r in docs.mapInArrow(sizes, "n long").collect()]
    for key in BATCH:
        spark.conf.unset(key)
    assert sum(rows) == 40 and max(rows) <= 12


def test_files_that_one_ask_time_finds_are_dealt_over_tasks(spark):
    rec = spark.range(40).select(F.col("id").alias("recording_id"), F.col("id").alias("run_id"), F.lit(10.0).alias("recorded_start"), F.lit(20.0).alias("recorded_end"))
    files = spark.range(4000).coalesce(1).select((F.col("id") % 40).alias("recording_id"), F.col("id").alias("rel_path"))
    asks = spark.range(5).select(F.col("id").alias("ask_id"), F.col("id").alias("run_id"), F.lit(None).cast("double").alias("start_ts"), F.lit(None).cast("double").alias("end_ts"))
    found = catalog.find_files(asks, rec, files)
    tasks = [r["count"] for r in found.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert sum(tasks) == 20_000 and len(tasks) > 4 and max(tasks) < 4000
    # compiled as a whole: no function that Spark interprets row by row is in the pairs' join
    assert "exists(" not in found._jdf.queryExecution().optimizedPlan().children().head().toString()

def test_forward_as_of_meets_a_hundred_rows_a_target(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(1, k, float(rng.randrange(-20, 21)) + k) for k in range(5000)]
    rows += [(2, 7 * k - 900, rng.choice([None, 5.0, 60.0])) for k in range(1500) for _ in range(rng.choice([1, 1, 2]))]
    rows += [(3, k, 1.0) for k in range(400)] + [(3, 5000, 1.0)]
    asked = [(1, f"a{k}", (at := rng.randrange(0, 5000)) - rng.choice([0.0, 10.0, 70.0, 500.0, 4000.0]), at) for k in range(60)]
    asked += [(2, f"b{k}", rng.choice([4.0, 5.5, 61.0]), rng.randrange(-1000, 9700)) for k in range(60)]
    asked += [(3, "c", 0.0, 5000), (3, "d", 2.0, 5000), (3, "e", 0.0, 399), (4, "f", 0.0, 10), (1, "g", None, 30), (1, "h", 5.0, 9000), (3, "i", 0.0, 5100)]
    met, pairs = [], intervals.rows_within

    def counted(*of, **more):
        met.append(pairs(*of, **more).count())
        return pairs(*of, **more)

    monkeypatch.setattr(sequence, "rows_within", counted)
    for within in (3000, 100, 1):
        want = {}
        for run, name, t, around in asked:
            reach = [(q, u) for r, q, u in rows if r == run and around - within < q <= around]
            early = max((q for q, u in reach if u is not None and t is not None and u < t), default=None)
            after = [q for q, _ in reach if early is None or q > early]
            want[name] = min(after, default=around) if t is not None else around
        done = sequence.first_at_or_after(spark.createDataFrame(rows, "run_id long, seq long, t double"), spark.createDataFrame(asked, "run_id long, target_id string, target_t double, around_seq long"), within)
        assert {r.target_id: r.found_seq for r in done.collect()} == want
    assert sum(met) < 100 * len(asked)


def test_pairs_of_asks_and_files_are_written_in_a_fraction_of_a_byte(spark, tmp_path):
    # a file meets more asks than a page of a column has rows (20,000), so a page of one file's asks holds none twice
    rng = random.Random(81)
    rec = [(k, k, float(s := rng.randrange(0, 20_000)), float(s + 60_000)) for k in range(64)]
    asks = [(a * 7919, None, float(s := rng.randrange(0, 70_000)), float(s + rng.randrange(0, 10_000))) for a in range(30_000)]
    recordings = spark.createDataFrame(rec, "recording_id long, run_id long, recorded_start double, recorded_end double")
    files = recordings.select("recording_id", F.explode(F.array(F.col("recording_id"), F.col("recording_id") + 5000)).alias("rel_path"))
    catalog.find_files(spark.createDataFrame(asks, "ask_id long, run_id long, start_ts double, end_ts double"), recordings, files).select("ask_id", "recording_id", "rel_path").write.parquet(str(tmp_path / "out"))
    want = sum(2 for _, _, lo, hi in asks for r in rec if r[2] <= hi and r[3] >= lo)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == got.distinct().count() == want
    assert sum(f.stat().st_size for f in (tmp_path / "out").glob("part-*")) < 0.5 * want


def test_bundles_of_files_and_asks_find_each_pair_once(spark, monkeypatch):
    rng = random.Random(9)
    rec = [(k, k if k % 3 else None, *((None, None) if k % 17 == 0 else (float(s := rng.randrange(0, 900)), float(s + rng.randrange(-20, 250))))) for k in range(50)]
    asks = [(a, rng.choice([None, a, 2, 500]), *rng.choice([(None, None), (float(s := rng.randrange(0, 900)), float(s + rng.randrange(-20, 300)))])) for a in [1, 1, 1, *range(2, 30)]]
    files = [(rng.randrange(55), k, {"k": str(k)}) for k in range(150)]
    run = lambda: catalog.find_files(spark.createDataFrame(asks, "ask_id long, run_id long, start_ts double, end_ts double"), spark.createDataFrame(rec, "recording_id long, run_id long, recorded_start double, recorded_end double"), spark.createDataFrame(files, "recording_id long, rel_path long, more map<string, string>"), cell_s=100.0)
    want = set()
    for ask, of, lo, hi in asks:
        own = [r for r in rec if r[1] == of and of is not None]
        lo, hi = lo if lo is not None else (own[0][2] if own else None), hi if hi is not None else (own[0][3] if own else None)
        found = {r[0] for r in rec if r in own or None not in (lo, hi, r[2]) and lo <= hi and r[2] <= r[3] and r[2] <= hi and r[3] >= lo}
        want |= {(ask, r, f) for r, f, _ in files if r in found}
    for few, bundle in ((1000, 2), (1000, 64), (0, 4)):
        monkeypatch.setattr(catalog, "BROADCAST_ASKS", few)
        monkeypatch.setattr(catalog, "FILE_BUNDLE", bundle)
        monkeypatch.setattr(catalog, "ASK_BUNDLE", bundle)
        rows = run().collect()
        got = [(r.ask_id, r.recording_id, r.rel_path) for r in rows]
        assert len(got) == len(set(got)) and set(got) == want and all(r.more == {"k": str(r.rel_path)} for r in rows)
