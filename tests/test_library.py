import io
import zipfile

from pyspark.sql import functions as F

from voltlane.operators import catalog, library


def test_page_rules(spark):
    pages = spark.createDataFrame(
        [(1, "ev", False, [9], ["x"], "Brake notes"), (2, "other", False, [], [], "t"), (3, "", True, [], [], "t"), (9, "ev", False, [], [], "t"), (5, "ev", False, [], ["No-Tern"], "t"), (6, "ev", False, [], [], "Team Logins"), (7, None, False, [], [], "Weekly meeting minutes")],
        "page_id long, space string, restricted boolean, ancestor_ids array<long>, labels array<string>, title string",
    )
    restricted = spark.createDataFrame([(9,)], "page_id long")
    got = {r["page_id"]: r["reason"] for r in library.skip_reason(pages, restricted, "EV").collect()}
    assert got == {1: "restricted ancestor", 2: "other space", 3: "restricted", 9: "restricted", 5: "no-tern label", 6: "credentials title", 7: None}
    kinds = [r[0] for r in pages.select(library.page_kind(F.col("title"), F.col("labels"))).where("true").collect()]
    assert kinds[-1] == "meeting_notes" and kinds[0] == "page"


def test_changes_jobs_and_copies(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "k long, v string")
    b = spark.createDataFrame([(2, "z"), (3, None), (4, "q")], "k long, v string")
    assert {r["k"]: r["action"] for r in library.changed(a, b, ["k"], ["v"]).collect()} == {1: "add", 2: "update", 4: "delete"}
    jobs = spark.createDataFrame([(1, "fast", "parse", "r", "queued", 1, 0), (2, "fast", "scan", "r", "queued", 2, 0), (3, "fast", "parse", "s", "queued", 3, 2), (4, "deep", "parse", "s", "queued", 9, 1)], "job_id long, lane string, kind string, recording_id string, status string, created_at long, attempts int")
    assert {r["lane"]: r["job_id"] for r in library.next_jobs(jobs).collect()} == {"fast": 2, "deep": 4}
    copies = spark.createDataFrame([("db", i) for i in range(10)], "name string, day long")
    assert sorted(r["day"] for r in library.keep_newest(copies, ["name"], "day").collect()) == list(range(3, 10))
    folders = spark.createDataFrame([("a", 5, 5), ("b", 5, 6), ("c", 1, 1)], "recording_id string, size long, manifest_size long")
    assert [r["recording_id"] for r in library.reconcile(folders, spark.createDataFrame([("c",)], "recording_id string")).collect()] == ["a"]
    recs = spark.createDataFrame([("xx123456", 0.0), ("yy123456", 60.0)], "recording_id string, start_s double")
    assert {r["run_id"] for r in library.run_ids(recs).collect()} == {"1969-12-31-123456", "1969-12-31-123456-2"}


def test_documents_and_grep(spark):
    pages = spark.createDataFrame([(1, "Brakes", "page", ["A", "B"], "2026-01-01T12:00:00"), (2, "Brake guide", "page", [], None)], "page_id long, title string, kind string, breadcrumb array<string>, updated string")
    chunks = spark.createDataFrame([(1, 0, "", "zero"), (1, 1, "Pads", "one"), (2, 0, "x", "two")], "page_id long, ordinal int, heading string, text string")
    view = {r["page_id"]: r for r in library.documents_view(pages, chunks).collect()}
    assert view[1]["path"] == "A > B" and view[1]["sections"] == 2 and view[1]["updated"] == "2026-01-01 07:00:00"
    get = lambda *a: [r["text"] for r in library.get_document(pages, chunks, *a).collect()]
    assert (get("2"), get("brakes"), get("guide"), get("bra"), get("1", "pad"), get("1", "0")) == (["two"], ["zero\n\none"], ["two"], [], ["one"], ["zero"])
    files = spark.createDataFrame([("a.py", "x\nmotor speed\ny"), ("b.py", "motor")], "path string, text string")
    assert [tuple(r) for r in library.grep(files, "Motor speed").collect()] == [("a.py", 2, "x\nmotor speed\ny")]


def test_office_files(spark):
    def zipped(name, xml):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr(name, xml)
        return out.getvalue()

    docx = zipped("word/document.xml", "<w:p><w:r><w:t>Hello</w:t><w:t xml:space='preserve'> &amp; bye</w:t></w:r></w:p><w:p></w:p>")
    pptx = zipped("ppt/slides/slide1.xml", "<a:p><a:r><a:t>Slide</a:t></a:r></a:p>")
    rows = spark.createDataFrame([("a.docx", docx), ("b.pptx", pptx), ("c.docx", b"junk"), ("d.txt", b"p1\n\np2"), (None, None)], "name string, body binary")
    got = [[b["text"] for b in r[0]] for r in rows.select(library.from_office("name", "body")).collect()]
    assert got == [["Hello & bye"], ["Slide"], [], ["p1", "p2"], []]


def test_listing_and_eviction(spark):
    rows = spark.createDataFrame([(i, f"Run {i}", float(i), "x" if i % 2 else None) for i in range(6)], "id long, name string, t double, kind string")
    ids = lambda **k: [r["id"] for r in catalog.listing(rows, order=["id"], **k).collect()]
    assert ids(name="RUN 3", name_columns=("name", "kind")) == [3] and ids(since=2, until=4, time=F.col("t")) == [2, 3] and ids(equal={"kind": "x", "name": ""}) == [1, 3, 5]
    assert ids(limit=0) == [0] and ids(limit=2, offset=3) == [3, 4]
    e = spark.createDataFrame([(1, "a", 10, 100.0), (2, "a", 10, 99.0), (3, "a", 10, 98.0), (4, "a", 10, 1.0)], "entry_id long, lane string, size long, last_access double")
    assert {r["entry_id"]: r["reason"] for r in catalog.evictions(e, 101.0, 50.0, 20, ["lane"]).collect()} == {3: "over cap", 4: "idle"}
    old = spark.createDataFrame([("a", 1, "p"), ("b", 2, "q")], "k string, v long, w string")
    new = spark.createDataFrame([("b", 9, None), ("c", 3, None)], "k string, v long, w string")
    assert {r["k"]: (r["v"], r["w"]) for r in catalog.upsert(old, new, ["k"], ("w",)).collect()} == {"a": (1, "p"), "b": (9, "q"), "c": (3, None)}
