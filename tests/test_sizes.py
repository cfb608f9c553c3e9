"""What larger tables and longer chains showed: queries against their SQL on small tables of that kind."""

import difflib
import random
import re
from collections import Counter

import duckdb
import pyarrow as pa
from pyspark.sql import functions as F

import __spark_entry__ as entry
from millrace.functions import text as T
from millrace.functions import udfs as U
from millrace.operators import graphs as G
from millrace.operators import layout as Y
from millrace.operators import linkage as L
from millrace.operators import similarity as J
from millrace.sources import markup
from millrace.streaming import keeping as K


def held_against_sql(spark, folder, name, **tables):
    """Rows of a query and of its SQL over the given tables (schema, rows)."""
    base = duckdb.connect()
    base.execute("SET TimeZone = 'UTC'")
    for table, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{table}.parquet")
        base.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet/*.parquet')")
    got = entry.queries()[name](spark, str(folder))
    return Counter(map(tuple, got.collect())), Counter(base.execute(f"SELECT {', '.join(got.columns)} FROM ({entry.oracle_sql()[name]})").fetchall())


def test_customers_beyond_four_digits(spark, tmp_path):
    customers = [(k, f"c{k}", k % 7) for k in (0, 4, 1200, 9996, 10000, 10001, 10002, 10003, 123456)]
    orders = [(3 * i, k) for i, (k, _, _) in enumerate(customers)] + [(30 + 1500 * 3, 4)]
    got, want = held_against_sql(spark, tmp_path, "order_evidence", customer=("c_custkey long, c_name string, c_nationkey int", customers), orders=("o_orderkey long, o_custkey long", orders))
    assert got == want and any("ABCD10000" in (row[2] or "") for row in got)


def test_references_without_semicolon(spark, tmp_path):
    pages = [(1, "<p>a &amp b &amp; c &amp;amp d</p>"), (2, "x&copy y&middot z&nbsp w&nbsp;v"), (3, "&lt&lt;&gt &quot &quot;e"), (4, "cut &am"), (5, "ends in &amp")]
    got, want = held_against_sql(spark, tmp_path, "page_texts", pages=("page_id long, html string", pages))
    assert got == want


def test_long_chains(spark):
    at = random.Random(1).sample(range(500), 500)  # a path in this order; labels that spread a step a round need more than a hundred rounds
    edges = [(at[i], at[i + 1], float(i)) for i in range(499)]
    found = G.components(spark.createDataFrame([*edges, (-1, -2, 0.0)], "u long, v long, w double")).collect()
    assert len(found) == 502 and {x.component for x in found if x.node >= 0} == {0} and {x.component for x in found if x.node < 0} == {-2}
    closing = [(at[0], at[499], 1e9), (at[3], at[400], 399.5)]  # the second one is lighter than those from place 400 on only
    tree = G.spanning_tree(spark.createDataFrame([*edges, *closing], "u long, v long, w double")).collect()
    assert {(x.u, x.v, x.w) for x in tree} == {(min(u, v), max(u, v), w) for u, v, w in edges}
    assert G.components(spark.createDataFrame([(5, 5)], "u long, v long")).count() == 0


def test_overlaps_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(J, "BLOCK_STRINGS", 16)  # several blocks to a band
    r = random.Random(3)
    strings = ["".join(r.choice("abcde") for _ in range(r.randint(8, 30))) for _ in range(60)]
    strings += [s[:k] + r.choice("abé𝄞") + s[k + 1 :] for s in strings for k in [r.randrange(len(s))]]
    strings = list(dict.fromkeys(strings))
    grams = [Counter(s[i : i + 3] for i in range(len(s) - 2)) for s in strings]
    want = {}
    for j, b in enumerate(strings):
        for i, a in enumerate(strings[:j]):
            m, n = sorted((len(a), len(b)))
            h = (90 * (m + n) + 199) // 200
            bound = h - 2 * (m + n - 2 * h + 1)
            if h <= m and 0 < bound <= (overlap := (grams[i] & grams[j]).total()):
                want[i, j] = (m, n, h, bound, overlap)
    distinct = J.distinct_strings(spark.createDataFrame(list(enumerate(strings)), "id long, s string"))
    found = J.overlap_pairs(distinct)
    assert {(x.a, x.b): (x.m, x.n, x.h, x.bound, x.overlap) for x in found.where("bound > 0").collect()} == want and want
    # what moves is strings, once for each block that theirs meets, never a pair with its tokens
    dealt = J.blocked_overlaps(distinct)
    assert dealt.schema.names == ["a", "b", "m", "n", "overlap"] and dealt.count() == dealt.distinct().count() == len(want)
    chars = {(x.a, x.b): x.shared_chars for x in J.character_pairs(found, distinct).where("bound > 0").collect()}
    assert chars == {k: c for k, v in want.items() if (c := (Counter(strings[k[0]]) & Counter(strings[k[1]])).total()) >= v[2]}


def test_many_keys_on_a_shelf(spark, monkeypatch):
    monkeypatch.setattr(K, "SHELVES", 2)  # a state for each key would be called for as many times as there are keys
    keys = [*range(40), None]
    assert len({r.shelf for r in spark.createDataFrame([(k,) for k in keys], "key long").select(K.shelf("key")).collect()}) == 3
    frame = lambda *rows: spark.createDataFrame(list(rows), "run_id long, ord long, event string")
    turns = [frame(*((k, 0, "prepared") for k in keys)), frame(*((k, 1, "attempted") for k in keys[::2]), *((k, 0, "complete") for k in keys))]
    rows = K.run_in_turns(spark, turns, K.tracked_merges).collect()
    want = [(k, 0, "prepared") for k in keys] + [(k, 1, "native_uncertain") if i % 2 == 0 else (k, 0, "prepared") for i, k in enumerate(keys)]
    assert Counter(map(tuple, rows)) == Counter(want)


def test_leaves_are_no_matter_of_labels(spark, monkeypatch):
    sizes, settled = [], G._settled
    monkeypatch.setattr(G, "_settled", lambda labels, *rest: (sizes.append(labels.count()), settled(labels, *rest))[1])
    ring = [(1, 2), (2, 3), (3, 1), (0, 1), (3, 4), (4, 5)]
    leaves = [(k % 3 + 1, 1000 + k) for k in range(300)] + [(2000 + k, 2) for k in range(300)]
    found = G.strong_components(spark.createDataFrame([*ring, *leaves, (7, 7)], "u long, v long"))
    assert {(x.node, x.component) for x in found.collect()} == {(k, 1) for k in (1, 2, 3)} | {(k, k) for k in (0, 4, 5, 7, *range(1000, 1300), *range(2000, 2300))}
    assert sizes == [3]


def test_pages_are_cut_into_events_some_at_a_time():
    pages = pa.RecordBatch.from_pydict({"page_id": list(range(60)), "html": ["<p>" + "word " * 40_000] * 58 + [None, "<h1>t</h1><img src='a'>"]})
    out = list(markup._event_rows("page_id", "html")(iter([pages])))
    assert len(out) > 2 and max(b.num_rows for b in out) < 30  # one batch of events for each of pages before
    assert [r for b in out for r in b.to_pylist()][58:] == [{"page_id": 59, "pos": 0, "event": "text", "kind": "heading", "value": "t"}, {"page_id": 59, "pos": 1, "event": "img", "kind": None, "value": "a"}]


def executions(spark, run, word):
    """How many of the executions that run() starts have a word in their plan."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    run()
    spark._jsc.sc().listenerBus().waitUntilEmpty()
    return sum(word in store.executionsList(n, 1).head().physicalPlanDescription() for n in range(before, store.executionsCount()))


def test_rounds_of_candidates_send_no_tables(spark):
    rows = [(i, None, None, None, f"t{i // 7}", "2020", None, None, ["a"], ["p"]) for i in range(70)]
    out = []
    sent = executions(spark, lambda: out.extend(L.merge_candidates(spark.createDataFrame(rows, L.CANDIDATE)).select("ord", "merged").collect()), "BroadcastExchange")
    assert sorted(map(tuple, out)) == [(7 * i, 7) for i in range(10)] and sent == 0


def test_rounds_of_paths_do_not_make_the_edges_again(spark, tmp_path):
    rows = [(k, k + 1, 1.0) for k in range(9)] + [(0, 5, 7.0), (20, 21, 1.0)]
    spark.createDataFrame(rows, "u long, v long, w double").write.parquet(f"{tmp_path}/given_edges")
    edges, start = spark.read.parquet(f"{tmp_path}/given_edges"), spark.createDataFrame([(0,)], "node long")
    out = []
    read = executions(spark, lambda: out.extend(G.shortest_paths(edges, start).collect()), "given_edges")
    assert {(r.node, r.distance) for r in out} == {(k, float(k)) for k in range(10)} and read == 1


def test_cheaper_sentences_are_the_plain_ones(spark):
    plain = re.compile(r"[^。！？；!?;][^。！？；!?;.]*+(?:\.(?!\s|\Z)[^。！？；!?;.]*+)*+(?:[。！？；!?;]+|\.(?=\s|\Z)|\Z)", re.ASCII)
    texts = ["a b. C d!  e ", " \t x.\n y ", "v1.2 is out.  See", "Größe. Ende ", "好。坏！ no", "a. b. c  ", "", "...", "It’s 3 o'clock. 的的", "No. 5 is ETC. here. So", "a. b  "]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    found = rows.select("id", "t", T.sentences(F.col("t")).alias("s"), T.word_count(F.col("t")).alias("n"), T.holds_any(F.col("t"), ("etc.", "x.")).alias("some")).orderBy("id").collect()
    for r in found:
        assert r.n == len(re.findall(r"[A-Za-z0-9][A-Za-z0-9_'’-]*", r.t)) and r.some == (r.id in (1, 9))
    assert [r.s for r in found[:9]] == [[s for s in (x.strip(" \t\n\x0b\f\r") for x in plain.findall(t)) if s] for t in texts[:9]]
    assert [r.s for r in found[9:]] == [["No. 5 is ETC. here.", "So"], ["a.", "b "]]


def test_flows_make_only_the_rows_asked_for(spark):
    texts = spark.createDataFrame([(1, "A & B -> C: x\n// no\ngroup G: A, Z"), (2, None)], "doc_id long, t string")
    nodes, edges, groups = markup.read_flows(texts, "doc_id", "t")
    assert "Filter" not in edges._jdf.queryExecution().executedPlan().toString()  # before, rows of all kinds were made and edges picked from them
    assert {tuple(r) for r in edges.collect()} == {(1, 0, "A", "C", False, "x"), (1, 0, "B", "C", False, "x")}
    assert {r.id for r in nodes.collect()} == {"A", "B", "C"} and {(r.member, r.known) for r in groups.collect()} == {("A", True), ("Z", False)}


def test_only_close_pairs_leave_their_cells(spark, monkeypatch):
    monkeypatch.setattr(J, "BLOCK_STRINGS", 40)
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("the and ing tion er on a of was his her that with ed ly ble thou re st un pre con".split()) for _ in range(n))
    strings = ["", "a", "b", "ab", "ba", "abc", "xyz"] + [word(n) for n in (2, 4, 8, 40, 160, 200) for _ in range(15)]
    for s in strings[-60::7]:
        strings += [s[:9] + s[11:], s[3:] + "qed", s[: len(s) // 2] + "x" + s[len(s) // 2 :]]
    strings = sorted(set(strings))
    h = lambda x, y: (90 * (len(x) + len(y)) + 199) // 200
    want = {(a, b) for b, y in enumerate(strings) for a, x in enumerate(strings[:b]) if U.subsequence_length(x, y) >= h(x, y)}
    given = spark.createDataFrame([(i, s, len(s), 1) for i, s in enumerate(strings)], "sid long, s string, n int, members long")
    got = {(r.a, r.b) for r in J.close_pairs(given).collect()}
    shared = J.overlap_pairs(given).where("bound > 0").count()
    assert want <= got and len(got) < shared / 2
    ratio = lambda x, y: difflib.SequenceMatcher(None, x, y).ratio()
    rated = {(a, b): (ratio(strings[a], strings[b]), ratio(strings[b], strings[a])) for a, b in want}
    found = J.ratio_classes(spark.createDataFrame(list(enumerate(strings)), "id long, s string")).collect()
    assert {(r.a, r.b): (r.ratio_ab, r.ratio_ba) for r in found} == {k: v for k, v in rated.items() if max(v) >= 0.9}


def test_distances_are_stored_and_move_as_lines(spark, monkeypatch):
    inner, lengths = G._written, []

    def kept(df):
        out = inner(df)
        if "d" in out.columns:
            lengths.append(out.agg(F.max(F.length("d"))).first()[0])
        return out

    monkeypatch.setattr(G, "_written", kept)
    rows = [(f"n{k:03}", f"n{k + 1:03}", -1.0 if k % 2 else 2.0) for k in range(300) if k != 280]
    got = {(r.source, r.node): r.distance for r in G.all_pairs(spark.createDataFrame(rows, "u string, v string, w double")).collect()}
    at = [0.0]
    for k in range(300):
        at.append(at[-1] + (-1.0 if k % 2 else 2.0))
    assert got == {(f"n{a:03}", f"n{b:03}"): at[b] - at[a] for a in range(301) for b in range(a, 301) if b <= 280 or a > 280}
    assert lengths and max(lengths) <= 8 * G.BLOCK


def test_overlaps_of_common_grams_are_counted_by_bits(monkeypatch):
    rng = random.Random(7)
    rows = [(k, "".join(rng.choice(("the", "and", "ing", "tion", "er")) for _ in range(rng.choice((3, 6, 40))))) for k in range(80)]
    tokens = lambda s: Counter(s[i : i + 3] for i in range(len(s) - 2))

    def want(pairs):
        out = {}
        for (a, x), (b, y) in pairs:
            h = (90 * (len(x) + len(y)) + 199) // 200
            bound, overlap = h - 2 * (len(x) + len(y) - 2 * h + 1), (tokens(x) & tokens(y)).total()
            if h <= min(len(x), len(y)) and 0 < bound <= overlap:
                out[min(a, b), max(a, b)] = overlap
        return out

    def got(left, right):
        listed.clear()
        return {(r["a"], r["b"]): r["overlap"] for batch in J._cell_pairs(left, right, 3, 90) for r in batch.to_pylist()}

    inner, listed = J._of_all, []
    monkeypatch.setattr(J, "_of_all", lambda *c: listed.append(len(out := inner(*c))) or out)
    for common in (0, J.COMMON, 1000):
        monkeypatch.setattr(J, "COMMON", common)
        assert got(rows, None) == want([(x, y) for i, x in enumerate(rows) for y in rows[:i]]) != {}
        alone = sum(listed)
        assert got(rows[:40], rows[40:]) == want([(x, y) for x in rows[:40] for y in rows[40:]]) != {}
        assert alone < 20_000 or not common
        assert alone or common == 1000


def test_cells_of_crossings_are_not_joined_with_one_another(spark):
    rng = random.Random(3)
    pieces = [(0, rng.randrange(60), rng.randrange(80)) for _ in range(300)]
    joined = spark.createDataFrame(pieces, "rank int, a int, b int")
    order = spark.createDataFrame([(0, k, k + 1) for k in range(60)] + [(1, k, k + 1) for k in range(80)], "rank int, place int, at int")
    found = Y.crossings(joined, order, 7)
    assert [tuple(r) for r in found.collect()] == [(0, sum(a < c and b > d for _, a, b in pieces for _, c, d in pieces))]
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
