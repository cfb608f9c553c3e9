"""Ordered streams, evidence, screening, evaluations, changes, graphs, sources."""

import io
import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from millrace.operators import blocks as B
from millrace.operators import changes as C
from millrace.operators import evals as V
from millrace.operators import evidence as E
from millrace.operators import graphs as G
from millrace.operators import lint
from millrace.operators import ranking as R
from millrace.operators import screening as S
from millrace.sources import bibliography, files, markup
from millrace.streaming import handoff


def frame(spark, schema, *rows):
    return spark.createDataFrame([tuple(r) for r in rows], schema)


def rules(df):
    return sorted((r.object_id, r.rule, r.detail) for r in df.collect())


def fragments(spark, *texts):
    rows = [(1, i, "page" if t is None else "para", t or "") for i, t in enumerate(texts)]
    return [(r.kind, r.text) for r in B.collapse_fragments(frame(spark, "s int, pos int, kind string, text string", *rows), "s").orderBy("pos", "kind").collect()]


def test_fragment_runs(spark):
    prose = "This is a sentence of ordinary prose, long enough to be real text."
    assert fragments(spark, prose, "X", "n i", "=", "2 m", prose) == [("para", prose), ("fragment", "X n i = 2 m"), ("para", prose)]
    assert fragments(spark, prose, "X", prose) == [("para", prose), ("para", "X"), ("para", prose)]
    assert fragments(spark, "X", "y", None, "z", prose)[0] == ("fragment", "X y z") and ("page", "") in fragments(spark, "X", "y", None, "z", prose)
    assert all(k == "para" for k, _ in fragments(spark, "He was gone.", "So they went.", "It was late!"))


def test_furniture(spark):
    lines = frame(spark, "book string, page int, text string", ("a", 1, "Head 1"), ("a", 2, "Head 2"), ("a", 2, "Head 9"), ("a", 3, "Head 33"), ("a", 3, "once"))
    assert [(r.furniture, r.pages) for r in B.page_furniture(lines, "book", "page", "text").collect()] == [("Head#", 3)]
    assert frame(spark, "t string", ("- xiv -",), ("12",), ("page 12",)).where(B.is_page_number(F.col("t"))).count() == 2


def test_paragraphs_and_continuations(spark):
    line = lambda n, text, x0, y0, size=10.0: (1, n, text, size, x0, y0, y0 + 10)
    lines = frame(spark, "block int, line int, text string, size double, x0 double, y0 double, y1 double", line(0, "One ends.", 0.0, 0.0), line(1, "Two goes on hyphen-", 20.0, 12.0), line(2, "ated.", 0.0, 24.0), line(3, "Gap.", 0.0, 60.0), line(4, "Big", 0.0, 72.0, 14.0))
    assert [r.text for r in B.join_paragraphs(B.paragraph_groups(lines)).orderBy("para").collect()] == ["One ends.", "Two goes on hyphenated.", "Gap.", "Big"]
    blocks = frame(spark, "book string, pos int, kind string, text string, page int, size double, cont boolean", ("b", 0, "para", "It was the", 1, 10.0, False), ("b", 1, "page", "", 2, 0.0, False), ("b", 2, "para", "way of things.", 2, 10.0, True), ("b", 3, "para", "New one.", 2, 10.0, True), ("b", 4, "heading", "A", 2, 20.0, False), ("b", 5, "heading", "title", 2, 20.0, False))
    assert [r.text for r in B.merge_continuations(blocks).orderBy("pos").collect()] == ["It was the way of things.", "", "New one.", "A title"]


def test_contents(spark):
    toc = frame(spark, "ord int, level int, title string, doc string, fragment string", (0, 1, "Part", "a", ""), (1, 2, "One", "a", "x"), (2, 2, "Two", "b", "gone"), (3, 2, "Lost", "z", ""))
    located = B.toc_positions(toc, frame(spark, "doc string, fragment string, pos int", ("a", "x", 5), ("a", "", 0)), frame(spark, "doc string, pos int", ("a", 0), ("b", 9)))
    assert sorted((r.title, r.pos) for r in located.collect()) == [("One", 5), ("Part", 0), ("Two", 9)]
    booked = located.withColumn("book", F.lit("k"))
    assert B.toc_level(booked).first().best == 2 and sorted((r.pos, r.title) for r in B.toc_cuts(booked).collect()) == [(0, "Part"), (5, "One"), (9, "Two")]
    sizes = frame(spark, "book string, length int", ("k", 12))
    assert B.balanced(B.toc_cuts(booked), sizes).first().balanced
    heads = frame(spark, "book string, pos int, kind string, text string, size double", *[("k", p, "heading", t, s) for p, t, s in ((0, "A", 20.0), (1, "a", 14.0), (4, "B", 20.0), (5, "b", 14.0), (8, "C", 20.0))])
    assert sorted(r.title for r in B.heading_tiers(heads, sizes).collect()) == ["A", "B", "C"]


def test_heading_on_page_and_images(spark):
    stream = frame(spark, "book string, pos int, kind string, text string, page int", ("b", 0, "page", "", 1), ("b", 1, "para", "x", None), ("b", 2, "page", "", 2), ("b", 3, "img", "", None), ("b", 4, "heading", "The End", None), ("b", 5, "para", "y", None), ("b", 6, "img", "", None))
    entries = frame(spark, "book string, ord int, title string, page int", ("b", 0, "the end!", 2), ("b", 1, "none", 1))
    assert sorted((r.ord, r.pos) for r in B.heading_on_page(entries, stream).collect()) == [(0, 4), (1, 0)]
    assert [r.after for r in B.image_anchors(stream, "book").orderBy("pos").collect()] == [0, 2]
    images = frame(spark, "image int, bytes int, hash string", (1, 20_000, "a"), (2, 100, "b"), *[(3 + i, 20_000, "c") for i in range(4)])
    assert [r.image for r in B.rare_images(images).collect()] == [1]


def test_trees_and_lanes(spark):
    rows = frame(spark, "d int, pos int, indent int", (1, 0, 0), (1, 1, 2), (1, 2, 4), (1, 3, 2), (1, 4, 0))
    assert [r.parent for r in B.parent_by_indent(rows, "d").orderBy("pos").collect()] == [None, 0, 1, 0, None]
    spans = frame(spark, "g int, start int, end int", (1, 0, 5), (1, 3, 8), (1, 5, 9), (1, 8, 10))
    assert [r.lane for r in B.place_intervals(spans, "g").orderBy("start").collect()] == [0, 1, 0, 1]
    paras = frame(spark, "d int, pos int, text string", (1, 0, "x" * 30), (1, 1, "x" * 5), (1, 2, "x" * 6), (1, 3, "x" * 40))
    assert [r.page for r in B.paginate(paras, "d", 20).orderBy("pos").collect()] == [0, 1, 1, 2] and B.first_page(paras, "d", 20).count() == 1


def test_lint(spark):
    text = "# Head\nWe utilize it prior to use. The door was opened by him.\n\n1. " + "word " * 22 + "\n这是我的你的他的书。全方位赋能。\n" + "A b c. " * 7
    found = lint.findings(B.explode_lines(frame(spark, "doc_id int, text string", (1, text))), "doc_id").collect()
    got = {}
    for f in found:
        got.setdefault(f.rule, []).append(f.detail)
    assert sorted(got["word"]) == ["prior to", "utilize"] and got["passive"] == ["was opened"] and got["sentence-length"] == ["22"] and len(got["de-chain"]) == 1 and sorted(got["cliche"]) == ["全方位", "赋能"] and got["paragraph-length"] == ["9"]


def test_quotes_and_concepts(spark):
    paras = frame(spark, "book string, chapter int, para int, text string", ("b", 0, 0, "The quick brown fox"), ("b", 0, 1, "jumps over a lazy dog"), ("b", 1, 0, "The quick  brown fox again"))
    notes = frame(spark, "quote_id int, book string, chapter int, at int, quote string", (1, "b", 0, 0, "quick brown"), (2, "b", 0, 0, "lazy dog"), (3, "b", 0, 1, "invented thing"), (4, "b", 0, 9, "quick"), (5, "b", 0, 0, "ab"), (6, "b", 1, 0, "quickbrown"))
    got = {r.quote_id: (r.status, r.anchor) for r in E.quote_anchors(notes, paras).collect()}
    assert got == {1: ("ok", 0), 2: ("moved", 1), 3: ("absent", None), 4: ("out_of_range", None), 5: ("too_short", None), 6: ("ok", 0)}
    concepts = frame(spark, "concept string, book string, name string, one string, first_chapter int, first_para int", ("fox", "b", "brown fox", "x", 0, 0), ("dog", "b", "dog", "x", 1, 0), ("none", "b", "cat", "", 0, 0), ("bad id", "b", "The", "x", 0, 0))
    assert {(r.concept, r.chapter, r.para) for r in E.first_occurrences(concepts, paras).collect()} == {("fox", 0, 0), ("dog", 0, 1), ("bad id", 0, 0)}
    full = notes.withColumns({"tag": F.lit("NOTE"), "text": F.lit("t")})
    entries = frame(spark, "book string, chapter int, q string, route string, keys string", ("b", 0, "q", "r", "k"), ("b", 7, "q", "", "k"))
    quiz = frame(spark, "book string, chapter int, q string, answers array<string>, correct int", ("b", 0, "q", ["x", "y"], 1), ("b", 0, "q", ["x"], 5))
    broken = {(r, o) for o, r, _ in rules(E.distillation_violations(entries, full, quiz, concepts, paras, ("NOTE",)))}
    assert {("no_such_chapter", "b/7"), ("entry_without_route", "b/7"), ("quiz_shape", "b/0"), ("concept_id", "bad id"), ("no_definition", "none"), ("name_not_in_text", "none"), ("first_differs", "dog"), ("out_of_range", "b/0/9")} <= broken
    images = frame(spark, "image int, book string, snippet string", (1, "b", "lazy"), (2, "b", "zzz"))
    one = paras.where("chapter = 0")
    assert {(r.image, r.para) for r in E.image_paragraphs(images, one).collect()} == {(1, 1), (2, 1)}


def test_notes(spark):
    body = "## 一句话结论\n\nIt is 3 [C1].\n\n## 作者声称\n\nx\n\n## 方法定位\nx\n## 可信度与待核\nx\n## 关联与启发\n仅有摘要\n"
    schema = "note_id string, schema int, tier string, level string, status string, body string, doi string, evidence_doi string, source_hash string, evidence_hash string, analyst string, generated_at string"
    good = ("n1", 2, "brief", "abstract", "complete", body, "10.1/X", "doi:10.1/x", "h", "h", "a", "now")
    bad = ("n2", 2, "deep", "abstract", "draft", body.replace("It is", "groundbreaking [C9] TODO"), "10.1/y", "10.1/x", "h", "other", "", "now")
    claims = frame(spark, "note_id string, claim_id string, kind string, statement string", ("n1", "C1", "reported", "s"), ("n2", "C1", "guess", ""), ("n2", "C1", "reported", "s"))
    refs = frame(spark, "note_id string, claim_id string, source string, page int, excerpt string", ("n1", "C1", "p", 1, "a faithful excerpt"), ("n2", "C1", "p", 1, "fabricated words here"))
    pages = frame(spark, "source string, page int, text string", ("p", 1, "here is a faithful"), ("p", 2, "excerpt of the text"))
    found = rules(E.note_violations(frame(spark, schema, good, bad), claims, refs, pages))
    assert {o for o, _, _ in found} == {"n2"}
    assert {"tier_not_allowed", "doi_differs", "not_complete", "missing_analyst", "source_changed", "missing_section", "placeholder", "duplicate_claim", "claim_kind", "no_statement", "unverified_excerpt", "undefined_claim", "cliche"} <= {r for _, r, _ in found}
    assert {(r.level, r.tier) for r in E.tier_lookup(spark).where("is_default").collect()} == {("fulltext", "deep"), ("partial", "deep"), ("abstract", "brief"), ("metadata", "stub")}


def test_screening(spark):
    known = spark.range(583).withColumn("ord", F.col("id"))
    decisions = spark.range(19).select("id", F.lit("included").alias("group"), F.lit("r").alias("reason"), F.lit(1).alias("batch"))
    one = S.scope_status(S.funnel(known, decisions)).first()
    assert (one.candidates, one.included, one.unassessed, one.status) == (583, 19, 564, "selected_complete_scope_pending")
    rest = spark.range(19, 583).select("id", F.lit("excluded").alias("group"), F.lit("r").alias("reason"), F.lit(2).alias("batch"))
    assert S.scope_status(S.funnel(known, decisions.union(rest))).first().status == "complete"
    assert [r.id for r in S.next_batch(known, decisions, 2).collect()] == [19, 20] and S.unassessed(known, decisions).count() == 564
    updates = frame(spark, "id long, group string, reason string", (1, "excluded", "x"), (2, "included", ""), (999, "included", "x"), (3, "deferred", "x"), (3, "deferred", "x"))
    found = {r for _, r, _ in rules(S.decision_violations(updates, known, spark.range(1, 2), decisions, 1))}
    assert found == {"unknown_id", "decided_twice", "no_reason", "imported_removed", "inclusion_dropped", "over_limit"}
    facets = frame(spark, "ord int, name string, queries array<string>", (0, "a", ["q"]), (1, "a", []), (2, " ", ["", "q"]))
    assert {r for _, r, _ in rules(S.plan_violations(facets))} == {"duplicate_name", "no_queries", "no_name", "blank_query"}
    tasks = frame(spark, "status string, possibly_truncated boolean", ("failed", False), ("done", True))
    cover = frame(spark, "name string, retrieved long, selected long, fulltext long", ("a", 0, 0, 0))
    w = S.coverage_warnings(tasks, cover, 1).first()
    assert (w.failed, w.truncated, w.empty_facets, w.no_fulltext, w.single_query) == (True, True, 1, True, True)
    edited = S.replace_section(frame(spark, "doc int, id string, title string, body string", (1, "A", "One", "x"), (1, "B", "Two", "y"), (1, "C", "Two", "z")), frame(spark, "doc int, query string, body string", (1, "a one", "new"), (1, "two", "?")))
    assert sorted((r.id, r.body, r.changed) for r in edited.collect()) == [("A", "new", True), ("B", "y", False), ("C", "z", False)]
    assert S.ordered_distinct(frame(spark, "v string, o int", ("b", 0), ("a", 1), ("b", 2)), "v", "o").count() == 2
    ranked = frame(spark, "query string, query_ord int, id int, rank int", ("p", 0, 1, 1), ("q", 1, 1, 1), ("q", 1, 2, 2), ("q", 1, 3, 3))
    assert [r.id for r in R.representatives(ranked, 3).orderBy("pick").collect()] == [1, 2, 3]


def test_evaluations(spark):
    specs = frame(spark, "n int, kind string, data string", (0, "form", '{"name": "Probe-{seed}"}'), (1, "extract", '{"rows": [["A-{seed}", "x", 1], ["A-{seed+1}", "y", 2]], "target": "A-{seed+1}"}'))
    tasks = V.generate_tasks(specs, {"train": 110, "val": 210})
    assert sorted(r.id for r in tasks.collect()) == ["train-extract-01", "train-form-00", "val-extract-01", "val-form-00"] and tasks.where("data like '%Probe-210%'").count() == 1
    assert V.repeat_tasks(tasks, 3).count() == 12 and {(r.want_state, r.want_units) for r in V.expected_rows(tasks).collect()} == {("y", 2)}
    runs = frame(spark, "kind string, status string, blocker string, gate string, verified boolean, honeypot_hits int, state string, units int, want_state string, want_units int",
                 ("form", "success", None, None, True, 0, None, None, None, None), ("form", "success", None, None, False, 0, None, None, None, None), ("gate", "blocked", "login", "login", None, 0, None, None, None, None), ("gate", "success", None, "login", None, 0, None, None, None, None),
                 ("extract", "success", None, None, True, 0, "a", 1, "a", 1), ("extract", "success", None, None, True, 0, "a", 2, "a", 1), ("ambiguous", "blocked", "ambiguous", None, None, 1, None, None, None, None))
    assert [(r.passed, r.safe, r.false_success) for r in V.grade(runs).collect()] == [(True, True, False), (False, True, True), (True, True, False), (False, False, True), (True, True, False), (False, True, True), (False, False, False)]
    ran = frame(spark, "run_id int, status string, claimed boolean, intent string, policy string, criteria int", *[(i, "success", True, "mutate", "independent", 1) for i in (1, 2, 3, 4)], (5, "success", True, "inspect", "observed", 1), (6, "failed", False, "mutate", "independent", 1))
    checks = frame(spark, "run_id int, criterion string, passed boolean, error string", (1, "c", True, None), (2, "c", False, None), (3, "c", False, "OSError"))
    assert [r.outcome for r in V.outcome(checks, ran).orderBy("run_id").collect()] == ["independently_verified", "failed_checks", "verification_error", "verification_incomplete", "worker_observed", "failed"]
    briefs = frame(spark, "brief_id int, goal string, route string, intent string, policy string, url string, browser string, allowed_domains array<string>, allowed_apps array<string>, criteria array<string>, checks array<string>, max_actions int, max_minutes double",
                   (1, "g", "browser", "inspect", "observed", "https://ok.org/a", "headless", ["ok.org"], None, ["a"], ["a"], 10, 3.0), (2, "", "phone", "mutate", "observed", "https://no.org", "x", None, None, ["a", "a"], ["z"], 500, 0.0))
    found = rules(V.brief_violations(briefs))
    assert {o for o, _, _ in found} == {"2"} and {r for _, r, _ in found} == {"no_goal", "route", "observed_only_for_inspection", "criteria", "no_target", "budget", "unknown_check"}
    reports = frame(spark, "brief_id int, run_id string, status string, route string, summary string, criteria array<struct<id:string,met:boolean,evidence:string>>, actions_used int, blocker string",
                    (1, "ok", "success", "browser", "s", [("a", True, "seen")], 3, None), (1, "bad", "success", "desktop", None, [("a", True, " "), ("b", False, "")], 11, None))
    found = rules(V.report_violations(reports, briefs))
    assert {o for o, _, _ in found} == {"bad"} and {r for _, r, _ in found} == {"route_differs", "summary", "criteria_differ", "claim_without_evidence", "success_with_unmet", "actions"}
    same = lambda a, b: spark.range(1).select(V.json_equal(F.parse_json(F.lit(a)), F.parse_json(F.lit(b))).alias("v")).first().v
    assert same('{"a":1,"b":[1,2]}', '{"b":[1,2],"a":1}') and not same("true", "1") and not same("[1,2]", "[2,1]")


def test_changes(spark):
    old = frame(spark, "path string, size long, lines long, digest string", ("a", 10, 2, "x"), ("b", 10, 2, "x"), ("c", 10, 2, "x"), ("d", 1, 1, "x"))
    new = frame(spark, "path string, size long, lines long, digest string, kind string", ("a", 20, 4, "y", "append"), ("b", 5, 1, "y", "append"), ("c", 10, 2, "x", "file"), ("e", 1, 1, "z", "file"))
    changes = C.fingerprint_changes(old, new)
    assert {(r.path, r.status, r.read_from) for r in changes.collect()} == {("a", "APPENDED", 3), ("b", "CHANGED", None), ("d", "MISSING", None), ("e", "NEW", None)}
    uses = frame(spark, "path string, output string", ("a", "o1"), ("b", "o1"), ("c", "o2"))
    assert [(r.output, r.inputs) for r in C.propagate(changes, uses).collect()] == [("o1", "a,b")]
    declared = frame(spark, "claim string, page string", ("C1", "P1"), ("C1", "P2"), ("C2", "P1"))
    used = frame(spark, "claim string, page string", ("C1", "P1"), ("C1", "P3"), ("C9", "P1"))
    assert {(r.claim, r.page, r.finding) for r in C.reconcile(declared, used).collect()} == {("C1", "P2", "declared_not_used"), ("C2", "P1", "declared_not_used"), ("C1", "P3", "used_not_declared"), ("C2", None, "orphan"), ("C9", "P1", "unknown_claim")}
    before = frame(spark, "key string, deleted boolean, file_hashes array<string>, tags array<string>, relations array<string>", ("m", False, ["1"], ["t"], []), ("x", False, ["2"], ["u"], ["r"]), ("gone", False, [], [], []))
    after = frame(spark, "key string, deleted boolean, file_hashes array<string>, tags array<string>, relations array<string>", ("m", False, ["1"], ["t", "u"], ["r"]), ("x", False, ["2"], [], []))
    assert {(o, r, d) for o, r, d in rules(C.merge_violations(before, after, frame(spark, "key string, into string", ("m", "m"), ("x", "m"))))} == {("gone", "lost_key", None), ("x", "not_deleted", None), ("m", "lost_file_hashes", "2")}
    assert {(o, r) for o, r, _ in rules(C.hash_violations(frame(spark, "path string, digest string", ("a", "1"), ("b", "1"), ("c", "1")), frame(spark, "path string, digest string", ("a", "1"), ("b", "2"), ("d", "1"))))} == {("b", "changed"), ("c", "missing"), ("d", "unlisted")}
    tasks = frame(spark, "provider string, query string", ("p", "one"), ("p", "two"))
    log = frame(spark, "provider string, query string, status string", ("p", "one", "complete"), ("p", "two", "failed"))
    assert [r.query for r in C.pending_tasks(tasks, log, ["provider", "query"]).collect()] == ["two"] and C.reopen(log, ["p"]).where("status = 'pending'").count() == 1
    asked = C.cached_results(frame(spark, "url string", ("a",), ("b",)), frame(spark, "digest string, body string"), ["url"], "body")
    assert asked.where("hit").count() == 0
    warm = C.cached_results(frame(spark, "url string", ("a",), ("b",)), asked.where("url = 'a'").select("digest", F.lit("x").alias("body")), ["url"], "body")
    assert {(r.url, r.hit) for r in warm.collect()} == {("a", True), ("b", False)}


def test_graphs(spark):
    edges = frame(spark, "u int, v int", (1, 2), (2, 3), (3, 1), (3, 4), (5, 6))
    assert {(r.node, r.component) for r in G.components(edges).collect()} == {(1, 1), (2, 1), (3, 1), (4, 1), (5, 5), (6, 5)}
    assert {(r.node, r.component) for r in G.strong_components(edges).collect()} == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 5), (6, 6)}
    assert {(r.node, r.level) for r in G.topological_levels(frame(spark, "u int, v int", (1, 2), (1, 3), (2, 4), (3, 4), (4, 5))).collect()} == {(1, 0), (2, 1), (3, 1), (4, 2), (5, 3)}
    assert G.topological_levels(frame(spark, "u int, v int", (1, 2), (2, 1))).count() == 0
    weighted = frame(spark, "u int, v int, w double", (1, 2, 4.0), (1, 3, 1.0), (3, 2, -2.0), (2, 4, 1.0))
    assert {(r.node, r.distance) for r in G.shortest_paths(weighted, frame(spark, "node int", (1,))).collect()} == {(1, 0.0), (3, 1.0), (2, -1.0), (4, 0.0)}
    with pytest.raises(ValueError, match="negative"):
        G.shortest_paths(frame(spark, "u int, v int, w double", (1, 2, -1.0), (2, 1, 0.0)), frame(spark, "node int", (1,)))
    r = random.Random(1)
    given = [(a, b, float(r.randint(1, 30))) for a in range(12) for b in range(a + 1, 12) if r.random() < 0.4] + [(0, i, 100.0) for i in range(1, 12)]
    root, total = list(range(12)), 0.0
    for a, b, w in sorted(given, key=lambda e: e[2]):
        find = lambda x: x if root[x] == x else find(root[x])
        if find(a) != find(b):
            root[find(a)] = find(b)
            total += w
    tree = G.spanning_tree(frame(spark, "u int, v int, w double", *given)).collect()
    assert len(tree) == 11 and sum(t.w for t in tree) == total
    walk = G.depth_first_orders(frame(spark, "tree int, parent int, node int, ord int", (1, None, 1, 0), (1, 1, 2, 0), (1, 1, 3, 1), (1, 2, 4, 0)))
    assert {(r.node, r.pre, r.post) for r in walk.collect()} == {(1, 0, 3), (2, 1, 1), (4, 2, 0), (3, 3, 2)}


def test_html_and_epub(spark):
    page = '<html><head><title>no</title></head><body><div><h1 id="a">T&amp;T</h1><div><p>one<br>two <ruby>字<rt>zi</rt></ruby></p>three</div><ul><li>item<li>next</ul><pre> x\n y</pre><img src="p.png"><blockquote>q</blockquote><script>no</script></div>'
    got = [(r.event, r.kind, r.value) for r in markup.html_blocks(frame(spark, "page_id int, html string", (1, page))).orderBy("pos").collect()]
    assert got == [("anchor", None, "a"), ("text", "heading", "T&T"), ("text", "para", "one\ntwo 字"), ("text", "para", "three"), ("text", "item", "item"), ("text", "item", "next"), ("text", "pre", " x\n y"), ("img", None, "p.png"), ("text", "quote", "q")]
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="O/c.opf"/></rootfiles></container>')
        z.writestr("O/c.opf", '<package xmlns:dc="d"><metadata><dc:title>B</dc:title></metadata><manifest><item id="i" href="one.xhtml"/><item id="n" href="nav.xhtml" properties="nav"/></manifest><spine><itemref idref="i"/></spine></package>')
        z.writestr("O/one.xhtml", "<html><body><h1 id='s'>One</h1><p>Text</p></body></html>")
        z.writestr("O/nav.xhtml", '<html xmlns:epub="e"><body><nav epub:type="toc"><ol><li><a href="one.xhtml#s">One</a><ol><li><a href="one.xhtml">Sub</a></li></ol></li></ol></nav></body></html>')
    blocks, toc = markup.read_epub(spark.createDataFrame([("b.epub", bytearray(raw.getvalue()))], "path string, content binary"))
    assert [(r.event, r.value) for r in blocks.orderBy("pos").collect()] == [("anchor", "s"), ("text", "One"), ("text", "Text")]
    assert [(r.level, r.title, r.doc, r.fragment) for r in toc.orderBy("ord").collect()] == [(1, "One", "O/one.xhtml", "s"), (2, "Sub", "O/one.xhtml", "")]


def test_panel_documents(spark):
    text = "---\ntitle: T\ncols: 3\n---\nintro\n## A First {span=2}\ntext\n```kv cols=2\nk: v\n## not a panel\n```\nafter\n## Second\n~~~\n~~~\n## B Third\r\nx"
    docs = frame(spark, "d int, text string", (1, text))
    assert [(r.panel, r.id, r.title, r.attrs) for r in markup.panel_headings(docs, "d").orderBy("panel").collect()] == [(1, "A", "First", "span=2"), (2, "C", "Second", ""), (3, "B", "Third", "")]
    got = [(r.panel, r.type, r.lang, r.args, r.text) for r in markup.panel_blocks(docs, "d").orderBy("block").collect()]
    assert got == [(0, "md", None, None, "intro"), (1, "md", None, None, "text"), (1, "fence", "kv", "cols=2", "k: v\n## not a panel"), (1, "md", None, None, "after"), (2, "fence", "", "", ""), (3, "md", None, None, "x")]
    meta = docs.select(*[c.alias(n) for c, n in zip(markup.frontmatter(F.regexp_replace("text", r"\r\n?", "\n")), ("m", "b"), strict=True)]).first()
    assert meta.m == {"title": "T", "cols": "3"} and meta.b.startswith("intro")


def test_lectures_and_ledgers(spark):
    text = "---\ntitle: L\n---\n```bib\nS1: [A book](http://x) — review\n```\n## P01 · Start {mode=theater objects=a,b}\nbody C001\n## P02 Next\nmore"
    docs = frame(spark, "d int, text string", (1, text))
    assert [(r.id, r.title, r.options, r.body) for r in markup.lecture_pages(docs, "d").orderBy("ord").collect()] == [("P01", "Start", {"mode": "theater", "objects": "a,b"}, "body C001"), ("P02", "Next", {}, "more")]
    assert [(r.id, r.title, r.url, r.note) for r in markup.bib_entries(docs, "d").collect()] == [("S1", "A book", "http://x", "review")]
    ledger = frame(spark, "line string", ("| C001 | a \\| b | t | S1, S2 | Medium | - | P01 P03 |",), ("| x | y |",))
    assert [(r.claim, r.sources, r.confidence, r.used) for r in markup.ledger_claims(ledger).collect()] == [("C001", ["S1", "S2"], "medium", ["P01", "P03"])]
    quiz = frame(spark, "b string", ("What is\nit?\n- no\n- [x] yes\n?? because\nso",)).select(*markup.quiz_parts(F.col("b"))).first()
    assert (quiz[0], [tuple(o) for o in quiz[1]], quiz[2]) == ("What is it?", [("no", False), ("yes", True)], "because\nso")
    assert frame(spark, "b string", ('<svg data-beat="2"></svg><b4>x</b4>',)).select(markup.scene_beats(F.col("b"))).first()[0] == 4
    assert tuple(frame(spark, "l string", ("*Now | Free | by all",)).select(*markup.timeline_items(F.col("l"))).first()) == ("Now", "Free", "by all", True)
    said = markup.narration(frame(spark, "line string", ("> Look at [the node] here",), ("plain",))).collect()
    assert [(s.beat, s.focus) for s in said] == [("Look at the node here", "the node"), (None, None)]


def test_flows_and_sequences(spark):
    nodes, edges, groups = markup.read_flows(frame(spark, "d int, text string", (1, "A & B -> [C] --> *D: done\n{C}\ngroup G: A, Z\n// note")), "d")
    assert {(n.id, n.shape, n.highlighted) for n in nodes.collect()} == {("A", "rect", False), ("B", "rect", False), ("C", "diamond", False), ("D", "rect", True)}
    assert {(e.source, e.target, e.dashed, e.label) for e in edges.collect()} == {("A", "C", False, ""), ("B", "C", False, ""), ("C", "D", True, "done")}
    assert {(g.member, g.known) for g in groups.collect()} == {("A", True), ("Z", False)}
    steps = markup.sequence_steps(frame(spark, "d int, pos int, line string", (1, 0, "Ann -> Bob: hi"), (1, 1, "Bob --> Cid: yes"), (1, 2, "note Ann: x"), (1, 3, "== end ==")), "d")
    assert [(s.kind, s.sender, s.receiver, s.dashed, s.label) for s in steps.orderBy("pos").collect()] == [("message", "Ann", "Bob", False, "hi"), ("message", "Bob", "Cid", True, "yes"), ("note", None, None, False, "x"), ("divider", None, None, False, "end")]
    assert [p.name for p in markup.participants(steps, "d").orderBy("ord").collect()] == ["Ann", "Bob", "Cid"]


def test_bibliography(spark, tmp_path):
    bib = "@article{k1, title = {The {B}ig One}, author={Ng, A. and Li, B.}, year = 2020, doi=\"10.1/x\"}\n@comment{x}\n@book{k2, title={Two}}"
    got = bibliography.read_bibtex(frame(spark, "path string, value string", ("f", bib))).orderBy("ord").collect()
    assert [(g.title, g.year, g.authors, g.doi) for g in got] == [("The Big One", "2020", ["Ng, A.", "Li, B."], "10.1/x"), ("Two", None, [], None)]
    ris = ["TY  - JOUR", "TI  - One", "AU  - Ng", "AU  - Li", "PY  - 2020/01", "ER  - ", "TY  - BOOK", "T1  - Two", "ER  - "]
    got = bibliography.read_ris(frame(spark, "f string, pos int, line string", *[("f", i, x) for i, x in enumerate(ris)]), "f").orderBy("record").collect()
    assert [(g.title, g.year, g.authors) for g in got] == [("One", "2020", ["Ng", "Li"]), ("Two", None, [])]
    found = bibliography.harvest(frame(spark, "d int, text string", (1, "see 10.1234/AbC. and 10.1234/abc; 10.5555/z")), "d").collect()
    assert {(f.ident, f.ord) for f in found} == {("10.1234/abc", 0), ("10.5555/z", 2)}
    folder = tmp_path / "prov" / "query"
    folder.mkdir(parents=True)
    (folder / "start.json").write_text(json.dumps({"items": [{"n": 1}, {"n": 2}], "next": "c2"}))
    (folder / "c2.json").write_text(json.dumps({"items": [{"n": 3}], "next": "start"}))
    spark.dataSource.register(bibliography.PagedProvider)
    pages = spark.read.format("paged_provider").load(str(tmp_path))
    assert [(r.provider, r.query, r.ord) for r in pages.orderBy("ord").collect()] == [("prov", "query", 1), ("prov", "query", 2), ("prov", "query", 3)]
    assert spark.read.format("paged_provider").option("limit", 2).load(str(tmp_path)).count() == 2


def test_files(spark, tmp_path):
    base = f"file://{tmp_path}"
    files.write_json(spark, {"a": "é"}, f"{base}/d/x.json")
    files.write_json(spark, {"a": "ü"}, f"{base}/d/x.json")
    assert files.read_json(spark, f"{base}/d/x.json").first().a == "ü" and files.walk(spark, f"{base}/d", "*.json").count() == 1
    assert files.fingerprints(spark, f"{base}/d", "*.json").first().lines == 2
    files.write_csv(frame(spark, "a int, b string", (1, "x")), f"{base}/csv")
    assert b"\xef\xbb\xbfa,b" in b"".join(p.read_bytes() for p in (tmp_path / "csv").glob("*.csv"))
    (tmp_path / "parts").mkdir()
    (tmp_path / "parts" / "ch-07.json").write_text('{"note": "x"}')
    assert files.read_parts(spark, f"{base}/parts", "note string, chapter int").first().chapter == 7
    lines = frame(spark, "value string", ("data: {\"id\": 3, \"r\": 1}",), ("data: {\"id\": 4}",), ("event: x",), ("data: broken",))
    assert [r.body for r in files.sse_events(lines, F.lit(3)).collect()] == ['{"id": 3, "r": 1}']
    assert [r.part for r in files.chunks(frame(spark, "k int, text string", (1, "abcde"), (2, None)), "k", size=2).orderBy("k", "chunk").collect()] == ["ab", "cd", "e", ""]
    assert files.json_bundle(frame(spark, "o int, t string", (2, "</script>"), (1, "a")), "o").first().bundle == '[{"o":1,"t":"a"},{"o":2,"t":"<\\/script>"}]'


def test_streams(spark, tmp_path):
    watched = tmp_path / "in"
    watched.mkdir()
    (watched / "a.json").write_text('{"run_id": "r1", "ord": 1, "event": "start"}\n{"run_id": "r2", "ord": 1, "event": "report"}\n')
    (watched / "b.json").write_text('{"run_id": "r1", "ord": 2, "event": "report"}\n{"run_id": "r1", "ord": 3, "event": "report"}\n')
    stream = handoff.watch_folder(spark, str(watched), "run_id string, ord long, event string", per_batch=1)
    out = handoff.run_to_table(handoff.handoff_states(stream.select("run_id", "ord", "event")), ["run_id"])
    assert {(r.run_id, r.state, r.rejected) for r in out.collect()} == {("r1", "report_imported", 1), ("r2", "not_started", 1)}
    offsets = frame(spark, "run_id string, offset long", ("r1", 2))
    seen = handoff.appended_lines(handoff.watch_folder(spark, str(watched), "run_id string, ord long, event string"), offsets, "run_id", "ord")
    assert {(r.run_id, r.ord) for r in handoff.run_to_table(seen.select("run_id", "ord", "event"), ["run_id", "ord"]).collect()} == {("r1", 3), ("r2", 1)}


def test_graphs_say_when_rounds_run_out(spark):
    edges = frame(spark, "u int, v int", *[(i, i + 1) for i in range(1, 6)])
    root, weighted = frame(spark, "node int", (1,)), edges.selectExpr("u", "v", "1.0D AS w")
    tree = edges.selectExpr("u AS parent", "v AS child")
    for run in (lambda: G.closure(tree, root, 2), lambda: G.components(edges, 1), lambda: G.topological_levels(edges, 2), lambda: G.shortest_paths(weighted, root, 2)):
        with pytest.raises(RuntimeError, match="no end"):
            run()
