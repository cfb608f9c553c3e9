"""Queries without SQL and the operators behind them, against plain versions."""

import difflib
import random
import re

import pytest
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.functions.udfs import subsequence_length
from millrace.operators import ranking as R
from millrace.plans import library, registry
from millrace.sources import table_functions
from millrace.streaming import keeping as K


def test_subsequence_length_bounds_the_ratio():
    r = random.Random(1)
    for _ in range(300):
        a, b = ("".join(r.choice("abcd") for _ in range(r.randint(0, 40))) for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert subsequence_length(a, b) == table[-1][-1] >= sum(m.size for m in difflib.SequenceMatcher(None, a, b).get_matching_blocks())


def test_opening_ratios_against_all_pairs(spark, sf):
    first = {}
    for row in library.openings(spark, sf).collect():
        first[row.s] = min(row.doc_id, first.get(row.s, row.doc_id))
    strings = sorted((i, s) for s, i in first.items())
    ratio = lambda a, b: difflib.SequenceMatcher(None, a, b).ratio()
    near = [(i, a, j, b) for n, (i, a) in enumerate(strings) for j, b in strings[n + 1 :] if 2 * min(len(a), len(b)) >= 0.9 * (len(a) + len(b)) > 0]
    want = {(i, j) for i, a, j, b in near if subsequence_length(a, b) * 2 >= 0.9 * (len(a) + len(b)) and max(ratio(a, b), ratio(b, a)) >= 0.9}
    assert {(r.a, r.b) for r in registry.QUERIES["opening_ratios"](spark, sf).collect()} == want


def plain_merge(rows, norm):
    """Candidates one after the other: what each joins, by the names that were left behind."""
    owners, clusters = {}, []
    for row in rows:
        doi = re.sub(r"^https?://doi\.org/", "", row["doi"] or "").lower()
        preprint, arxiv = "", ""
        if doi.startswith("10.48550/"):
            preprint, doi, arxiv = doi, "", doi.split("arxiv.")[1]
        if not row["title"]:
            continue
        title = "title:" + norm[row["title"]]
        main = "doi:" + (doi or preprint) if doi or preprint else f"{title}:{row['year']}"
        names = [main, *(["doi:" + preprint] if preprint else []), *(["arxiv:" + arxiv] if arxiv else []), title]
        home = None
        for name in names:
            if name in owners and not (name == title and abs(int(owners[name]["year"]) - int(row["year"])) > 2):
                home = owners[name]
                break
        if home and home["doi"] and doi and home["doi"] != doi:
            home = None
        if home is None:
            home = {"ord": row["ord"], "doi": doi, "year": row["year"], "members": []}
            clusters.append(home)
        home["doi"] = home["doi"] or doi
        home["members"].append(row["ord"])
        for name in names:
            if name != title or name not in owners or not owners[name]["doi"]:
                owners[name] = home
    return {c["ord"]: (c["doi"] or None, len(c["members"])) for c in clusters}


def test_merged_documents_against_a_walk_in_order(spark, sf):
    docs = library.docs(spark, sf).select("doc_id", "n_chars", F.split(F.coalesce("text", F.lit("")), r"\s")[0].alias("word")).withColumn("norm", T.normalized(F.col("word"))).orderBy("doc_id").collect()
    doi = lambda i: f"https://doi.org/10.1000/{i % 211}" if i % 3 == 0 else f"10.48550/arXiv.2201.{i % 97}" if i % 10 == 1 else None
    rows = [{"ord": r.doc_id, "doi": doi(r.doc_id), "title": r.word if r.doc_id % 29 else None, "year": str(2015 + r.n_chars % 9)} for r in docs]
    want = plain_merge(rows, {r.word: r.norm for r in docs})
    got = {r.ord: (r.doi, r.n) for r in registry.QUERIES["merged_documents"](spark, sf).select("ord", "doi", F.col("merged").alias("n")).collect()}
    assert got == want and any(n > 2 for _, n in want.values())


def test_representatives_against_picks_in_turn(spark):
    r = random.Random(2)
    rows = sorted({(f"q{q}", q, i): (f"q{q}", q, r.randint(0, 30), i) for q in range(12) for i in r.sample(range(25), 6)}.values())
    taken, want = [], []
    for q in range(12):
        left = sorted((rank, i) for _, n, rank, i in rows if n == q and i not in taken)
        if left:
            taken.append(left[0][1])
            want.append((left[0][1], f"q{q}"))
    best = {}
    for _, _, rank, i in rows:
        best[i] = min(rank, best.get(i, rank))
    want += [(i, None) for _, i in sorted((rank, i) for i, rank in best.items() if i not in taken)]
    table = spark.createDataFrame(rows, "query string, query_ord int, rank int, id int")
    for n in (3, 18):
        assert [(x.id, x.query) for x in R.representatives(table, n).orderBy("pick").collect()] == want[:n]


EVENTS = [(k, n, o, o * 40) for o in range(120) for k, n in [(o * 7 % 5, "ab"[o * 11 % 2])]]


def lookups(spark, rows):
    table = spark.createDataFrame(rows, "key long, name string, ord long, s long")
    return table.select("key", "name", "ord", F.timestamp_seconds(F.col("s") + 1_700_000_000).alias("ts"))


@pytest.mark.parametrize("batches", [1, 12])
def test_cache_is_the_same_in_any_number_of_batches(spark, batches):
    size = len(EVENTS) // batches
    turns = [lookups(spark, EVENTS[i : i + size]).coalesce(1) for i in range(0, len(EVENTS), size)]
    got = K.run_in_turns(spark, turns, lambda s: K.cached_results(s, 1000)).collect()
    held, want, last = {}, [], EVENTS[-1][3]
    for k, n, o, s in EVENTS:
        hit = (k, n) in held and s < held[k, n] + 1000
        want += [(k, n, None, "evicted")] if not hit and (k, n) in held else []
        want.append((k, n, o, "hit" if hit else "miss"))
        held[k, n] = held[k, n] if hit else s
    want += [(k, n, None, "evicted") for (k, n), s in held.items() if s + 1000 <= last]
    assert sorted(map(str, (tuple(x) for x in got))) == sorted(map(str, want))


def test_sources_and_merges_go_on_after_a_restart(spark):
    line = lambda source, run, texts: [(source, run, i, t) for i, t in enumerate(texts)]
    frame = lambda rows: spark.createDataFrame(rows, "source string, run long, line long, text string")
    turns = [line("a", 1, "xy") + line("b", 1, "xy") + line("c", 1, "xyz"), line("a", 2, "xyz") + line("b", 2, "xq") + line("c", 2, "xy") + line("d", 2, "x"), line("a", 3, "xyz")]
    want = {("a", 1, "NEW", 0, 2), ("b", 1, "NEW", 0, 2), ("c", 1, "NEW", 0, 3), ("a", 2, "APPENDED", 2, 3), ("b", 2, "CHANGED", 0, 2), ("c", 2, "CHANGED", 0, 2), ("d", 2, "NEW", 0, 1), ("a", 3, "SAME", 3, 3)}
    replayed = [turns[0], turns[1], turns[1], turns[0], turns[2]]
    for order in (replayed, [sum(turns, [])]):
        assert {tuple(r) for r in K.run_in_turns(spark, [frame(t) for t in order], K.tracked_sources).collect()} == want
    steps = spark.createDataFrame([("m", 0, "prepared"), ("m", 1, "attempted"), ("n", 0, "other")], "run_id string, ord long, event string")
    more = spark.createDataFrame([("m", 2, "commit_seen")], "run_id string, ord long, event string")
    rows = K.run_in_turns(spark, [steps, steps, more], K.tracked_merges).collect()
    assert {tuple(r) for r in rows} == {("m", 1, "native_uncertain"), ("n", 0, "preflight"), ("m", 2, "native_committed")}


def test_table_functions(spark):
    text = ["## One", "```py x", "## not a heading", "```", "", "## ", "## Two", "- a", "  - b", "- c", "```"]
    spark.createDataFrame([("k", i, t) for i, t in enumerate(text)] + [("n", 0, None), ("l", 0, "```")], "key string, pos int, line string").createOrReplaceTempView("told")
    table_functions.register(spark)
    got = {tuple(r) for r in spark.sql("SELECT * FROM document_blocks(TABLE(told))").collect()}
    assert got == {("k", 0, "heading", 1, 0, "One"), ("k", 1, "fence", 1, 1, "py x"), ("k", 6, "heading", 2, 0, "Two"), ("k", 10, "open", 2, 0, ""), ("l", 0, "open", 0, 0, "")}
    assert {tuple(r) for r in spark.sql("SELECT * FROM list_parents(TABLE(told))").collect()} == {("k", 7, None, 0), ("k", 8, 7, 1), ("k", 9, None, 0)}
    assert spark.sql("SELECT * FROM list_parents(TABLE(SELECT * FROM told WHERE key = 'z'))").count() == 0
    with pytest.raises(Exception, match="key, pos and line"):
        spark.sql("SELECT * FROM document_blocks(TABLE(SELECT key FROM told))").collect()
    with pytest.raises(KeyError):
        table_functions.register(spark, ("none",))


def test_files_by_ranges(spark, tmp_path):
    import hashlib

    from millrace.sources import ranges

    r = random.Random(9)
    files = {"a.bin": r.randbytes(1000), "sub/b.bin": b"\n" * 640, "sub/empty.bin": b"", "c.bin": r.randbytes(64), "left.txt": b"x"}
    for name, held in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(held)

    def digest(held: bytes, leaf: int, fan: int) -> str:
        level = [hashlib.sha256(held[i : i + leaf]).hexdigest() for i in range(0, max(len(held), 1), leaf)]
        while True:
            level = [hashlib.sha256("".join(level[i : i + fan]).encode()).hexdigest() for i in range(0, len(level), fan)]
            if len(level) == 1:
                return level[0]

    want = {(str(tmp_path / n), len(h), h.count(b"\n"), max(1, -(-len(h) // 64)), digest(h, 64, 1024)) for n, h in files.items() if n.endswith(".bin")}
    for range_leaves in (1, 3, 100):
        assert {tuple(x) for x in ranges.fingerprints(spark, str(tmp_path), ".bin", 64, range_leaves).select("path", "size", "newlines", "leaves", "digest").collect()} == want
    leaves = spark.read.format("byte_ranges").option("path", f"file://{tmp_path}").option("suffix", "a.bin").option("leaf", "64").load()
    assert ranges.tree_digests(leaves, 3).first().digest == digest(files["a.bin"], 64, 3)


def test_walks_and_lanes(spark):
    from millrace.operators import blocks as B
    from millrace.operators.numbering import FirstFree

    r = random.Random(10)
    rows = [(g, a, a + r.randint(0, 9)) for g in range(5) for a in (r.randint(0, 60) for _ in range(80))]
    want = []
    for g in range(5):
        lanes = []
        for _, a, b in sorted(x for x in rows if x[0] == g):
            lane = next((i for i, taken in enumerate(lanes) if all(b <= x or a >= y for x, y in taken)), len(lanes))
            lanes += [[]] if lane == len(lanes) else []
            lanes[lane].append((a, b))
            want.append((g, a, b, lane))
    got = B.place_intervals(spark.createDataFrame(rows, "g int, start int, end int").repartition(3), "g")
    assert sorted(tuple(x) for x in got.collect()) == sorted(want)
    lanes = FirstFree()
    assert [lanes.take(0, 10) for _ in range(5)] == [0, 1, 2, 3, 4] and lanes.take(10, 11) == 0
    values = [(g, float(r.randint(0, 9))) for g in range(7) for _ in range(r.randint(1, 30))] + [(0, None)]
    quartiles = {x.g: (x.lower_quartile, x.middle) for x in B.quartile_and_median(spark.createDataFrame(values, "g int, v double"), "g", "v").collect()}
    for g in range(7):
        xs = sorted(v for h, v in values if h == g and v is not None)
        assert quartiles[g] == (xs[len(xs) // 4], (xs[(len(xs) - 1) // 2] + xs[len(xs) // 2]) / 2)
