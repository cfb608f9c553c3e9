"""Queries of operators on books, graphs, sets and files over the driver's tables, with SQL that works them out another way."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import blocks as B
from ..operators import changes as C
from ..operators import evidence as E
from ..operators import graphs as G
from ..operators import layout as Y
from ..operators import screening as S
from ..session import scratch_path, stored, table
from ..sources import files

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with the SQL that gives the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# --- books ---


@query("""
    WITH s AS (SELECT l_suppkey AS book, l_quantity AS size, sum(l_linenumber)::BIGINT AS chars, min(l_orderkey * 10 + l_linenumber) AS first FROM lineitem GROUP BY 1, 2)
    SELECT book, size AS body_size FROM s QUALIFY row_number() OVER (PARTITION BY book ORDER BY chars DESC, first) = 1""")
def body_sizes(spark, sf):
    """[A-17] The quantity that most characters of a supplier's lines have, a line being as long as its number."""
    l = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("book"), F.col("l_quantity").alias("size"), F.repeat(F.lit("x"), F.col("l_linenumber").cast("int")).alias("text"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"))
    return B.body_size(l)


@query("SELECT l_orderkey, list_sort(list(l_extendedprice))[(count(*) // 4 + 1)::INT] AS lower_quartile, median(l_extendedprice) AS middle FROM lineitem GROUP BY 1")
def order_quartiles(spark, sf):
    """[A-18] The element a quarter up and the median of each order's prices."""
    return B.quartile_and_median(table(spark, sf, "lineitem"), "l_orderkey", "l_extendedprice")


@query("""
    SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag = 'A' AND l_linenumber <= 2 AND (l_discount < 0.12 * 0.5 OR l_tax > 0.88 * 0.08) AS margin,
        regexp_full_match(CASE WHEN l_returnflag = 'N' THEN 'page ' ELSE '- ' END || l_partkey || ' -', '[-–— ]*[0-9ivxlcIVXLC]{1,6}[-–— ]*') AS number FROM lineitem""")
def margin_lines(spark, sf):
    """[P-08, P-09] Lines in the margin of a page, and those that are a page's number."""
    text = F.concat(F.when(F.col("l_returnflag") == "N", "page ").otherwise("- "), F.col("l_partkey").cast("string"), F.lit(" -"))
    kind = F.when(F.col("l_returnflag") == "A", "text").otherwise("image")
    # the compared bounds are scaled, so that both sides multiply the same numbers
    bottom, top = F.when(F.col("l_discount") < 0.12 * 0.5, F.lit(0.0)).otherwise(1.0), F.when(F.col("l_tax") > 0.88 * 0.08, F.lit(1.0)).otherwise(0.0)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", B.in_margin(kind, F.col("l_linenumber"), top, bottom).alias("margin"), B.is_page_number(text).alias("number"))


@query("""
    WITH e AS (SELECT user_id, event_id, (event_id * 7 % 5)::BIGINT AS indent FROM events)
    SELECT user_id, event_id, indent, (SELECT max(f.event_id) FROM e f WHERE f.user_id = e.user_id AND f.event_id < e.event_id AND f.indent < e.indent) AS parent FROM e""")
def indent_parents(spark, sf):
    """[W-07] Events as an outline: the nearest one before with a smaller indent is the parent."""
    e = table(spark, sf, "events").select("user_id", "event_id", (F.col("event_id") * 7 % 5).alias("indent"))
    return B.parent_by_indent(e, "user_id", "event_id")


@query("""
    SELECT n.book, n.chapter FROM (SELECT l_suppkey AS book, l_linenumber AS chapter, max(l_partkey % 25) AS last FROM lineitem GROUP BY 1, 2) n
    JOIN (SELECT l_suppkey AS book, l_linenumber AS chapter, count(*) + 25 AS n_paras FROM lineitem GROUP BY 1, 2) s USING (book, chapter) WHERE n_paras >= 30 AND last < 0.4 * n_paras""")
def clustered_chapters(spark, sf):
    """[W-18] Chapters whose notes all stand in their first part."""
    l = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("book"), F.col("l_linenumber").alias("chapter"), (F.col("l_partkey") % 25).alias("at"))
    return E.clustered_notes(l, l.groupBy("book", "chapter").agg((F.count("*") + 25).alias("n_paras")))


# --- graphs: all events or all lines as arcs ---

#: States of a user: from each event's state to the next one's.
_STEPS = "SELECT * FROM (SELECT user_id * 1000 + floor(value / 10)::BIGINT AS u, lead(user_id * 1000 + floor(value / 10)::BIGINT) OVER (PARTITION BY user_id ORDER BY event_id) AS v FROM events) WHERE v IS NOT NULL AND u <> v"
#: From the user of each event to that of the next event.
_HANDS = "SELECT a.user_id AS u, b.user_id AS v, a.event_id, floor(a.value * 100)::BIGINT AS cents FROM events a JOIN events b ON a.event_id + 1 = b.event_id WHERE a.user_id <> b.user_id"
#: Between suppliers of lines that follow each other in an order: least days, raised by heights that differ between the ends, so that some are negative.
_LINES = """SELECT a.l_suppkey AS u, b.l_suppkey AS v, min(datediff('day', DATE '1990-01-01', a.l_shipdate::DATE) % 90 + a.l_suppkey * 37 % 50 - b.l_suppkey * 37 % 50)::DOUBLE AS w
    FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber + 1 = b.l_linenumber WHERE a.l_suppkey <> b.l_suppkey GROUP BY 1, 2"""


def _steps(spark, sf) -> DataFrame:
    state = F.col("user_id") * 1000 + F.floor(F.col("value") / 10).cast("long")
    e = table(spark, sf, "events").select(state.alias("u"), F.lead(state).over(Window.partitionBy("user_id").orderBy("event_id")).alias("v"))
    return e.where("u <> v").distinct()


def _hands(spark, sf) -> DataFrame:
    e = table(spark, sf, "events")
    after = e.select((F.col("event_id") - 1).alias("event_id"), F.col("user_id").alias("v"))
    return e.join(after, "event_id").select(F.col("user_id").alias("u"), "v", "event_id", F.floor(F.col("value") * 100).cast("long").alias("cents")).where("u <> v")


@query(f"""
    WITH RECURSIVE e AS (SELECT DISTINCT u, v FROM ({_STEPS})), n AS (SELECT u AS node FROM e UNION SELECT v FROM e), r AS (SELECT node AS a, node AS b FROM n UNION SELECT a, v FROM r JOIN e ON u = b)
    SELECT x.a AS node, min(x.b) AS component FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY 1""")
def strong_groups(spark, sf):
    """[G-06] States of users that lead to one another."""
    return G.strong_components(_steps(spark, sf))


@query(f"""
    WITH RECURSIVE e AS (SELECT DISTINCT least(u, v) AS u, greatest(u, v) AS v FROM ({_STEPS})), n AS (SELECT u AS node FROM e UNION SELECT v FROM e),
    t AS (SELECT node, 0 AS level FROM n WHERE node NOT IN (SELECT v FROM e) UNION SELECT v, level + 1 FROM t JOIN e ON u = node)
    SELECT node, max(level)::INT AS level FROM t GROUP BY 1""")
def longest_levels(spark, sf):
    """[G-07] Levels of the states of users, arcs from lower to higher ones."""
    return G.topological_levels(_steps(spark, sf).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())


@query(f"""
    WITH RECURSIVE e AS (SELECT u, v, min(cents)::DOUBLE AS w FROM ({_HANDS}) GROUP BY 1, 2), s AS (SELECT min(u) AS node FROM e),
    t AS (SELECT 0 AS hops, node, 0.0::DOUBLE AS d FROM s UNION ALL SELECT hops + 1, e.v, min(d + e.w) FROM t JOIN e ON e.u = t.node WHERE hops < 60 GROUP BY hops, e.v)
    SELECT s.node AS source, t.node, min(d) AS distance FROM t, s GROUP BY 1, 2""")
def shortest_routes(spark, sf):
    """[G-08] Distances from the smallest user along all hand-overs, no weight negative."""
    e = stored(_hands(spark, sf).groupBy("u", "v").agg(F.min("cents").cast("double").alias("w")), "hands")
    return G.shortest_paths(e, e.agg(F.min("u").alias("node")))


@query(f"""
    WITH RECURSIVE e AS ({_LINES}), t AS (SELECT 0 AS hops, node AS source, node, 0.0::DOUBLE AS d FROM (SELECT u AS node FROM e UNION SELECT v FROM e)
        UNION ALL SELECT hops + 1, source, e.v, min(d + e.w) FROM t JOIN e ON e.u = t.node WHERE hops < 24 GROUP BY hops, source, e.v)
    SELECT source, node, min(d) AS distance FROM t GROUP BY 1, 2""")
def supplier_distances(spark, sf):
    """[G-08] All pairs of suppliers, over arcs of which some are negative."""
    l = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", (F.datediff("l_shipdate", F.lit("1990-01-01")) % 90).alias("days"))
    after = l.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_suppkey").alias("v"))
    height = lambda c: F.col(c) * 37 % 50
    e = l.join(after, ["l_orderkey", "l_linenumber"]).where("l_suppkey <> v").groupBy(F.col("l_suppkey").alias("u"), "v")
    return G.all_pairs(e.agg(F.min(F.col("days") + height("l_suppkey") - height("v")).cast("double").alias("w")))


@query(f"""
    WITH RECURSIVE e AS (SELECT least(u, v) AS u, greatest(u, v) AS v, min(event_id)::DOUBLE AS w FROM ({_HANDS}) GROUP BY 1, 2), b AS (SELECT u, v, w FROM e UNION ALL SELECT v, u, w FROM e),
    r AS (SELECT u, v, w, u AS node FROM e UNION SELECT r.u, r.v, r.w, b.v FROM r JOIN b ON b.u = r.node AND b.w < r.w)
    SELECT u, v, w FROM e WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.u = e.u AND r.v = e.v AND r.node = e.v)""")
def spanning_edges(spark, sf):
    """[G-09] The lightest forest of all hand-overs: in SQL, the edges whose ends no lighter edges join."""
    e = _hands(spark, sf).groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    return G.spanning_tree(e.agg(F.min("event_id").cast("double").alias("w")))


# Regions over nations over suppliers over parts, regions over suppliers as well, and suppliers with a debt back to their nation.
_FLOWS = """SELECT n_regionkey AS u, 100 + n_nationkey AS v FROM nation UNION SELECT 100 + s_nationkey, 1000 + s_suppkey FROM supplier UNION SELECT 1000 + l_suppkey, 100000000 + l_partkey FROM lineitem
    UNION SELECT n_regionkey, 1000 + s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION SELECT 1000 + s_suppkey, 100 + s_nationkey FROM supplier WHERE s_acctbal < 0"""
_FREE = f"""f AS ({_FLOWS}), inner_arcs AS (SELECT * FROM f WHERE v < 100000000), reach AS (SELECT u AS a, v AS b FROM inner_arcs UNION SELECT a, v FROM reach JOIN inner_arcs ON u = b),
    free AS (SELECT DISTINCT CASE WHEN back THEN v ELSE u END AS u, CASE WHEN back THEN u ELSE v END AS v FROM (SELECT f.u, f.v, f.u > f.v AND r.a IS NOT NULL AS back FROM f LEFT JOIN reach r ON r.a = f.v AND r.b = f.u)),
    longest AS (SELECT DISTINCT u AS node, 0 AS level FROM free WHERE u NOT IN (SELECT v FROM free) UNION SELECT v, level + 1 FROM longest JOIN free ON u = node), levels AS (SELECT node, max(level) AS level FROM longest GROUP BY 1),
    ranked AS (SELECT l.node, CASE WHEN l.level = 0 THEN coalesce(n.level, 0) ELSE l.level END AS rank FROM levels l LEFT JOIN (SELECT u, min(level) - 1 AS level FROM free JOIN levels ON v = node GROUP BY u) n ON n.u = l.node)"""


def _flows(spark, sf) -> DataFrame:
    t = lambda name: table(spark, sf, name)
    nation, supplier = t("nation").select("n_regionkey", F.col("n_nationkey").alias("s_nationkey")), t("supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    parts = [
        nation.selectExpr("n_regionkey as u", "100 + s_nationkey as v"), supplier.selectExpr("100 + s_nationkey", "1000 + s_suppkey"), t("lineitem").selectExpr("1000 + l_suppkey", "100000000 + l_partkey"),
        supplier.join(nation, "s_nationkey").selectExpr("n_regionkey", "1000 + s_suppkey"), supplier.where("s_acctbal < 0").selectExpr("1000 + s_suppkey", "100 + s_nationkey"),
    ]
    return reduce(DataFrame.union, parts).select(F.col("u").cast("long"), F.col("v").cast("long")).distinct()


@query(f"WITH RECURSIVE {_FREE} SELECT node, rank::INT AS rank FROM ranked")
def layer_ranks(spark, sf):
    """[G-11] Ranks of regions, nations, suppliers and parts, arcs that close a cycle turned round."""
    return Y.ranks(stored(Y.acyclic(_flows(spark, sf)), "acyclic"))


@query(f"""
    WITH RECURSIVE {_FREE}, spans AS (SELECT u, v, a.rank AS ru, b.rank AS rv FROM free JOIN ranked a ON u = a.node JOIN ranked b ON v = b.node),
    steps AS (SELECT *, unnest(range(ru, rv)) AS rank FROM spans),
    pieces AS (SELECT rank, u AS an, CASE WHEN rank > ru THEN v END AS av, rank - ru AS asn, CASE WHEN rank + 1 = rv THEN v ELSE u END AS bn, CASE WHEN rank + 1 < rv THEN v END AS bv, CASE WHEN rank + 1 < rv THEN rank + 1 - ru ELSE 0 END AS bs FROM steps),
    places AS (SELECT rank, node AS n, NULL::BIGINT AS v, 0 AS s FROM ranked UNION SELECT rank, an, av, asn FROM pieces UNION SELECT rank + 1, bn, bv, bs FROM pieces),
    numbered AS (SELECT *, row_number() OVER (PARTITION BY rank ORDER BY n, v NULLS FIRST, s) AS at FROM places),
    c AS (SELECT p.rank, a.at AS x, b.at AS y, count(*) AS w FROM pieces p JOIN numbered a ON a.rank = p.rank AND a.n = an AND a.v IS NOT DISTINCT FROM av AND a.s = asn JOIN numbered b ON b.rank = p.rank + 1 AND b.n = bn AND b.v IS NOT DISTINCT FROM bv AND b.s = bs GROUP BY ALL),
    grid AS (SELECT xs.rank, x, y, coalesce(w, 0) AS w FROM (SELECT DISTINCT rank, x FROM c) xs JOIN (SELECT DISTINCT rank, y FROM c) ys USING (rank) LEFT JOIN c USING (rank, x, y)),
    beyond AS (SELECT *, coalesce(sum(w) OVER (PARTITION BY rank, x ORDER BY y DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS more FROM grid),
    before AS (SELECT *, coalesce(sum(more) OVER (PARTITION BY rank, y ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS crossed FROM beyond)
    SELECT rank::BIGINT AS rank, sum(w * crossed)::BIGINT AS crossings FROM before GROUP BY 1""")
def layer_crossings(spark, sf):
    """[G-11] Crossings of all arcs between neighbouring ranks, places in the order of their nodes."""
    free = stored(Y.acyclic(_flows(spark, sf)), "acyclic")
    ranked = stored(Y.ranks(free), "ranks")
    joined = stored(Y.pieces(free, ranked), "pieces")
    return Y.crossings(joined, Y.first_order(joined, ranked))


_TREE = "SELECT r_regionkey AS tree, NULL AS parent, 'r' || r_regionkey AS node, 0 AS ord FROM region UNION ALL SELECT n_regionkey, 'r' || n_regionkey, 'n' || n_nationkey, n_nationkey FROM nation UNION ALL SELECT n_regionkey, 'n' || n_nationkey, 'c' || c_custkey, c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey"


@query(f"""
    WITH RECURSIVE e AS ({_TREE}), t AS (SELECT tree, node, [ord::BIGINT] AS path FROM e WHERE parent IS NULL UNION ALL SELECT e.tree, e.node, list_append(t.path, e.ord::BIGINT) FROM t JOIN e ON e.parent = t.node AND e.tree = t.tree)
    SELECT tree, node, row_number() OVER (PARTITION BY tree ORDER BY path) - 1 AS pre, row_number() OVER (PARTITION BY tree ORDER BY list_append(path, 1000000000000)) - 1 AS post FROM t""")
def tree_walks(spark, sf):
    """[G-10, G-02] Regions, their nations and customers in the order of a walk, before and after their children."""
    nation, customer = table(spark, sf, "nation"), table(spark, sf, "customer")
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    rows = table(spark, sf, "region").select(F.col("r_regionkey").alias("tree"), F.lit(None).cast("string").alias("parent"), name("r", "r_regionkey").alias("node"), F.lit(0).cast("long").alias("ord"))
    rows = rows.union(nation.select("n_regionkey", name("r", "n_regionkey"), name("n", "n_nationkey"), F.col("n_nationkey").cast("long")))
    rows = rows.union(customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("n_regionkey", name("n", "n_nationkey"), name("c", "c_custkey"), F.col("c_custkey").cast("long")))
    return G.depth_first_orders(rows)


# --- changes and sets ---


@query("""
    WITH m AS (SELECT o_orderkey AS path, o_orderstatus AS want FROM orders WHERE o_orderkey % 7 <> 0), f AS (SELECT o_orderkey AS path, CASE WHEN o_orderpriority = '1-URGENT' THEN 'U' ELSE o_orderstatus END AS digest FROM orders WHERE o_orderkey % 5 <> 0)
    SELECT coalesce(m.path, f.path)::VARCHAR AS object_id, CASE WHEN f.path IS NULL THEN 'missing' WHEN m.path IS NULL THEN 'unlisted' ELSE 'changed' END AS rule, NULL::VARCHAR AS detail
    FROM m FULL JOIN f ON m.path = f.path WHERE m.path IS NULL OR f.path IS NULL OR want <> digest""")
def manifest_check(spark, sf):
    """[V-17] Files against a manifest of their digests."""
    o = table(spark, sf, "orders")
    files_now = o.where("o_orderkey % 5 <> 0").select(F.col("o_orderkey").alias("path"), F.when(F.col("o_orderpriority") == "1-URGENT", "U").otherwise(F.col("o_orderstatus")).alias("digest"))
    return C.hash_violations(o.where("o_orderkey % 7 <> 0").select(F.col("o_orderkey").alias("path"), F.col("o_orderstatus").alias("digest")), files_now)


@query("""
    WITH a AS (SELECT DISTINCT l_partkey AS value FROM lineitem WHERE l_returnflag = 'A' AND l_quantity > 40), b AS (SELECT DISTINCT l_partkey AS value FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 40)
    SELECT value, 'left' AS side FROM (SELECT value FROM a EXCEPT SELECT value FROM b) UNION ALL SELECT value, 'right' FROM (SELECT value FROM b EXCEPT SELECT value FROM a)""")
def part_sides(spark, sf):
    """[U-08, U-05] Parts that large lines of one flag have and those of another lack."""
    l = table(spark, sf, "lineitem").where("l_quantity > 40")
    of = lambda flag: l.where(F.col("l_returnflag") == flag).select("l_partkey")
    return S.set_difference(of("A"), of("R"))


@query("""
    WITH d AS (SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1)
    SELECT * FROM d WHERE user_id NOT IN (SELECT user_id FROM events WHERE value > 180)""")
def unpublished_rows(spark, sf):
    """[U-09] The last row of each key and title, without the keys that are published."""
    e = table(spark, sf, "events")
    keyed = e.withColumn("pair", F.struct("user_id", "event_type"))
    last = C.latest_per_key(keyed, "pair", ["event_id"]).select("user_id", "event_type", "event_id", "value")
    return last.join(e.where("value > 180").select("user_id").distinct(), "user_id", "left_anti")


@query("""
    WITH s AS (SELECT user_id, max(ts) FILTER (event_type = 'view') AS last_hint, max(ts) FILTER (event_type = 'purchase' AND value > 60) AS last_clean, min(ts) AS first_seen, sum(trunc(value)::BIGINT) AS bytes FROM events GROUP BY 1)
    SELECT user_id, bytes::BIGINT AS bytes FROM s WHERE (last_hint IS NULL OR last_hint <= TIMESTAMP '2024-02-01' - INTERVAL 2 DAY)
        AND (bytes >= 3000 OR (coalesce(last_clean, first_seen) <= TIMESTAMP '2024-02-01' - INTERVAL 3 DAY AND bytes >= 500))""")
def throttled_hints(spark, sf):
    """[P-19] Users to whom a hint is due: large ones or those not cleaned for days, unless one was given lately."""
    e, kind = table(spark, sf, "events"), F.col("event_type")
    clean = F.when((kind == "purchase") & (F.col("value") > 60), F.col("ts"))
    states = e.groupBy("user_id").agg(F.max(F.when(kind == "view", F.col("ts"))).alias("last_hint"), F.max(clean).alias("last_clean"), F.min("ts").alias("first_seen"), F.sum(F.col("value").cast("long")).alias("bytes"))
    return C.due_hints(states, "2024-02-01 00:00:00", 2, 3000, 3, 500).select("user_id", "bytes")


@query("SELECT event_type AS component, count(DISTINCT user_id) AS pages, count(*) AS uses FROM events GROUP BY 1")
def component_uses(spark, sf):
    """[A-22] How often each component is used, and on how many pages."""
    return table(spark, sf, "events").groupBy(F.col("event_type").alias("component")).agg(F.countDistinct("user_id").alias("pages"), F.count("*").alias("uses"))


# --- files, written to the shared folder and read again ---


@query("SELECT n_nationkey::VARCHAR AS n_nationkey, n_name FROM nation")
def csv_round_trip(spark, sf):
    """[S-28] Nations through a CSV file with a byte-order mark."""
    path = scratch_path(spark, "csv")
    files.write_csv(table(spark, sf, "nation").select("n_nationkey", "n_name").coalesce(1), path)
    return spark.read.option("header", "true").csv(path).toDF("n_nationkey", "n_name")


@query("SELECT r_regionkey, r_name FROM region")
def json_round_trip(spark, sf):
    """[S-01, S-02] Regions through one JSON document, replaced as a whole."""
    path = scratch_path(spark, "regions.json")
    rows = [r.asDict() for r in table(spark, sf, "region").select("r_regionkey", "r_name").collect()]
    for value in ([], rows):
        files.write_json(spark, value, path)
    return files.read_json(spark, path, "r_regionkey int, r_name string")


@query("SELECT n_regionkey AS chapter, n_name AS note FROM nation")
def parts_round_trip(spark, sf):
    """[S-31] Notes in one JSON part for each chapter; the chapter is told by the file's name."""
    path = scratch_path(spark, "parts")
    for region in table(spark, sf, "region").select("r_regionkey").collect():
        names = [r.n_name for r in table(spark, sf, "nation").where(F.col("n_regionkey") == region[0]).select("n_name").collect()]
        files.write_json(spark, [{"note": n} for n in names], f"{path}/ch-{region[0]:02}.json")
    return files.read_parts(spark, path, "note string, chapter int").select("chapter", "note")


@query("SELECT 'ch-' || lpad(r_regionkey::VARCHAR, 2, '0') || '.json' AS name, 4 + length(r_name) AS size FROM region")
def folder_walk(spark, sf):
    """[S-27] Files of a folder with their sizes: each a JSON string and the name's quotes and brackets' worth of characters."""
    path = scratch_path(spark, "walk")
    for r in table(spark, sf, "region").collect():
        files.write_json(spark, r.r_name + "..", f"{path}/{r.r_regionkey}/ch-{r.r_regionkey:02}.json")
    return files.walk(spark, path, "*.json").select(F.element_at(F.split("path", "/"), -1).alias("name"), "size")
