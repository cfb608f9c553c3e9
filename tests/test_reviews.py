"""Reviews, lectures, chapters, input checks, sound."""

import pytest
from pyspark.sql import functions as F

from millrace.operators import reviews as V
from millrace.sources import pdf


def frame(spark, schema, *rows):
    return spark.createDataFrame([tuple(r) for r in rows], schema)


def found(df):
    return {(r.object_id, r.rule) for r in df.collect()}


def test_matrix_and_evidence_list(spark):
    notes = frame(spark, "key string, tier string, body string", ("a", "brief", "# T\n## 一句话结论\n\nShort.\n\n## 作者声称\nMore\n"), ("b", "stub", "## 一句话定位\nHere"))
    rows = {r.key: r for r in V.evidence_matrix(notes).collect()}
    assert (rows["a"].takeaway, rows["a"].results, rows["a"].question) == ("Short.", "More", "") and rows["b"].takeaway == "Here"
    claims = frame(spark, "claim_id string, refs array<string>", ("R1", ["k:C1", "k:C2"]))
    cards = frame(spark, "key string, card string, title string", ("k", "C1", "T"), ("k", "C2", "T"))
    locators = frame(spark, "key string, card string, source string, page int", ("k", "C1", "ABCD1234", 3), ("k", "C2", "web", None))
    externals = frame(spark, "key string, source string, attachment string, url string", ("k", "web", None, "https://x.org"))
    assert {(r.card, r.locator_url) for r in V.evidence_list(claims, cards, locators, externals, "app://pdf/").collect()} == {("C1", "app://pdf/ABCD1234?page=3"), ("C2", "https://x.org")}


def test_reuse_of_notes(spark):
    fields = "key string, title string, abstract string, doi string, creators array<string>, date string, pdf_hashes array<string>, human_notes map<string,string>, annotations array<string>"
    row = ("k", "T", None, "d", ["A"], "2020", ["1", "2"], None, ["x"])
    frames = frame(spark, fields, row).drop("human_notes"), frame(spark, fields + ", version int", (*row, 1), ("k", "T", None, "d", ["A"], "2020", ["2", "1"], None, ["x"], 2), ("k", "T", None, "d", ["A"], "2021", ["1", "2"], None, ["x"], 3)).drop("human_notes")
    current, archived = (f.withColumn("human_notes", F.lit("h")) for f in frames)
    assert [(r.key, r.version) for r in V.reusable_notes(archived, current).collect()] == [("k", 2)]


def test_chapters(spark):
    blocks = frame(spark, "book string, pos int, kind string, text string", *[("b", i, k, t) for i, (k, t) in enumerate([("para", "before"), ("page", ""), ("heading", "One"), ("img", "a.png"), ("para", "x"), ("fragment", "f"), ("img", "b.png"), ("heading", "Sub"), ("para", "y")])])
    rows = V.book_chapters(blocks, frame(spark, "book string, pos int, title string", ("b", 2, "one!"))).orderBy("chapter").collect()
    assert [(r.title, r.paras, r.heads, r.frags) for r in rows] == [("Front matter", ["before"], [], []), ("one!", ["x", "f", "Sub", "y"], [2], [1])]
    assert [(i.after, i.src) for i in rows[1].images] == [(-1, "a.png"), (1, "b.png")]
    assert frame(spark, "c binary", (bytearray(b"x"),)).select(V.image_name(F.lit(7), F.col("c"), F.lit(".png"))).first()[0] == "i0007-11f6ad8e.png"
    ranked = frame(spark, "rank int, score double, title string, year string, providers array<string>, id string, abstract string", (2, 1.0, "B", None, ["q"], "y", ""), (1, 2.5, "A", "2020", ["p", "q"], "x", "long  text"))
    assert V.ranked_report(ranked).first().report == "1. [2.50] **A** — 2020 · p+q — id `x`\n   > long text\n2. [1.00] **B** — ? · q — id `y`"


def test_lectures(spark):
    pages = frame(spark, "ord int, id string, title string, options map<string,string>, body string",
                  (1, "P01", "a", {"mode": "theater", "objects": "o,u"}, '```scene\n<svg><g data-obj="o"/></svg>\n```\n```sources\nS1\n``` [C001] 约'), (2, "P03", "b", {"inherits": "P01", "objects": "z"}, "trivially " + "字" * 3 + " [C002]"))
    assert found(V.lecture_violations(pages)) == {("P03", "page_number"), ("P03", "banned_phrase"), ("P03", "no_sources"), ("P03", "nothing_to_see"), ("P01", "object_not_drawn"), ("P03", "object_not_drawn"), ("P03", "continuity")}
    claims = frame(spark, "claim string, sources array<string>, confidence string, used array<string>", ("C001", ["S1"], "low", ["P01"]), ("C002", ["S9"], "medium", []), ("C003", [], "high", []))
    got = found(V.claim_violations(claims, frame(spark, "id string", ("S1",)), pages, frame(spark, "id string", ("S1",), ("S2",))))
    assert got == {("C002", "unknown_source"), ("C003", "orphan_claim"), ("S2", "orphan_source"), ("C002", "not_hedged")}


def test_inputs(spark):
    status = frame(spark, "provider string, query string, status string, note string", ("p", "q", "completed", "n"), ("p", "x", "done", ""))
    links = frame(spark, "item_key string, url string, source string, version string", ("k", "u", "s", "v"), ("z", "", "s", "v"))
    got = found(V.input_violations(status, frame(spark, "provider string, query string", ("p", "q")), links, frame(spark, "item_key string", ("k",)), frame(spark, "name string, value int", ("a", 1), ("b", 0))))
    assert got == {("p:x", "unknown_search"), ("p:x", "status"), ("p:x", "no_note"), ("z", "incomplete_link"), ("z", "unknown_item"), ("b", "limit_not_positive")}


def test_sound(spark):
    row = frame(spark, "s array<int>, r int", ([0, 10, 20, 30], 2)).select(V.resampled(F.col("s"), F.col("r"), 4).alias("up"), V.trimmed(F.transform("s", lambda x: x * 20), rate=25).alias("cut"), V.resampled(F.array().cast("array<int>"), F.col("r")).alias("none")).first()
    assert row.up == [0, 5, 10, 15, 20, 25, 30, 30] and row.cut == [200, 400, 600] and row.none == []
    clips = frame(spark, "t int, ord int, start_s double, samples array<int>", (1, 0, 0.0, [1, 1, 1]), (1, 1, 0.5, [5, 5, 5, 5]))
    assert V.mixed(clips, "t", F.lit(1.0), rate=4).first().samples == [1, 1, 5, 5]


def test_pdf_needs_its_library(spark):
    try:
        import pymupdf  # noqa: F401
    except ImportError:
        with pytest.raises(ImportError, match="pymupdf"):
            pdf.read_lines(frame(spark, "path string, content binary", ("x", bytearray(b""))))
