"""Queries over the relational tables and events, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import blocks as B
from ..operators import changes as C
from ..operators import evals as V
from ..operators import graphs as G
from ..operators import ranking as R
from ..operators import screening as S
from ..session import table
from ..sources import bibliography, files
from ..streaming import handoff

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


# The events table as runs of delegated tasks.
RUNS = "SELECT event_id, user_id AS task_id, event_type AS kind, value > 20 AS passed, event_type <> 'error' OR value > 5 AS safe, event_type = 'purchase' AND value <= 20 AS false_success, CASE WHEN event_type = 'signup' AND value < 1 THEN NULL ELSE (props->>'k')::BIGINT END AS tokens, value FROM events"


def runs(spark, sf) -> DataFrame:
    v, kind = F.col("value"), F.col("event_type")
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "long")
    return table(spark, sf, "events").select(
        "event_id", F.col("user_id").alias("task_id"), kind.alias("kind"), (v > 20).alias("passed"), ((kind != "error") | (v > 5)).alias("safe"), ((kind == "purchase") & (v <= 20)).alias("false_success"),
        F.when(~((kind == "signup") & (v < 1)), k).alias("tokens"), "value",
    )


@query(f"""
    SELECT kind, count(*) AS runs, count(*) FILTER (passed) AS passed, count(*) FILTER (passed) / count(*) AS rate, count(*) FILTER (NOT safe) AS safety_violations, count(*) FILTER (false_success) AS false_successes,
        coalesce(sum(tokens), 0)::BIGINT AS tokens, CASE WHEN count(tokens) = count(*) AND count(*) FILTER (passed) > 0 THEN sum(tokens) / count(*) FILTER (passed) END AS tokens_per_pass FROM ({RUNS}) GROUP BY ROLLUP (kind)""")
def scorecard(spark, sf):
    """[A-09, A-11] Runs in all and by kind."""
    return V.scorecard(runs(spark, sf))


@query(f"WITH t AS (SELECT task_id, value % 7 AS g, count(*) = 3 AND bool_and(passed) AS ok FROM ({RUNS}) GROUP BY task_id, floor(event_id / 50), g) SELECT count(*) FILTER (ok) / count(*) AS pass3, count(*) AS tasks FROM t")
def pass3(spark, sf):
    """[A-10] The share of tasks that ran exactly three times and passed each time."""
    r = runs(spark, sf).withColumn("task", F.struct("task_id", (F.col("value") % 7).alias("g"), F.floor(F.col("event_id") / 50).alias("part")))
    return V.pass_cubed(r, "task")


@query("SELECT event_type, median(value) AS median_s, sum(value) AS total_s, count(*) AS runs FROM events GROUP BY 1")
def held_out_summary(spark, sf):
    """[A-19] Median and sum by category."""
    return V.elapsed_summary(table(spark, sf, "events"), "event_type", "value")


@query("SELECT event_id, (props->>'k')::BIGINT AS k, (props->>'k') = '69' AS is_69, false AS equals_text, (props->'missing') IS NULL AS missing FROM events")
def json_dig_equal(spark, sf):
    """[P-16, F-42] Values inside JSON, and strict equality: a number is not the text of it."""
    value = V.dig(F.try_parse_json("props"), "$.k")
    return table(spark, sf, "events").select(
        "event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "long").alias("k"), V.json_equal(value, F.parse_json(F.lit("69"))).alias("is_69"), V.json_equal(value, F.parse_json(F.lit('"69"'))).alias("equals_text"),
        V.dig(F.try_parse_json("props"), "$.missing").isNull().alias("missing"),
    )


@query("""
    WITH old AS (SELECT o_orderkey, o_orderstatus AS s, o_totalprice AS p FROM orders WHERE o_orderdate < TIMESTAMP '2000-01-01'), new AS (SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 'U' ELSE o_orderstatus END AS s, o_totalprice AS p FROM orders WHERE o_orderstatus <> 'P')
    SELECT coalesce(old.o_orderkey, new.o_orderkey) AS o_orderkey, CASE WHEN old.o_orderkey IS NULL THEN 'added' WHEN new.o_orderkey IS NULL THEN 'removed' ELSE 'changed' END AS change
    FROM old FULL JOIN new ON old.o_orderkey = new.o_orderkey WHERE old.o_orderkey IS NULL OR new.o_orderkey IS NULL OR old.s <> new.s OR old.p <> new.p""")
def snapshot_diff(spark, sf):
    """[J-20, U-05, U-07] Orders as of a day against those not pending, urgent ones marked."""
    o = table(spark, sf, "orders")
    old = o.where("o_orderdate < timestamp'2000-01-01'").select("o_orderkey", F.col("o_orderstatus").alias("s"), F.col("o_totalprice").alias("p"))
    new = o.where("o_orderstatus <> 'P'").select("o_orderkey", F.when(F.col("o_orderpriority") == "1-URGENT", "U").otherwise(F.col("o_orderstatus")).alias("s"), F.col("o_totalprice").alias("p"))
    return C.keyed_diff(old, new, ["o_orderkey"], ["s", "p"])


@query("""
    WITH o AS (SELECT user_id, max(event_id) AS mark FROM events WHERE value < 10 GROUP BY 1) SELECT e.event_id, e.user_id FROM events e LEFT JOIN o USING (user_id) WHERE e.event_id > coalesce(mark, -1)""")
def appended_rows(spark, sf):
    """[T-02, W-13] Events behind the last one read of each user."""
    e = table(spark, sf, "events")
    offsets = e.where("value < 10").groupBy("user_id").agg(F.max("event_id").alias("offset"))
    return C.appended_rows(e, offsets, "user_id", "event_id").select("event_id", "user_id")


@query("""SELECT DISTINCT event_type, user_id FROM events e WHERE NOT EXISTS (SELECT 1 FROM events d WHERE d.event_type = e.event_type AND d.user_id = e.user_id AND d.value > 50)""")
def retry_pending(spark, sf):
    """[T-01, J-11] Tasks of a provider and a query that never completed."""
    e = table(spark, sf, "events")
    log = e.select("event_type", "user_id", F.when(F.col("value") > 50, "complete").otherwise("failed").alias("status"))
    return C.pending_tasks(e.select("event_type", "user_id").distinct(), log, ["event_type", "user_id"])


@query("SELECT event_id, ts FROM events WHERE ts > TIMESTAMP '2024-01-15 00:00:00' - INTERVAL 86400 SECOND")
def fresh_events(spark, sf):
    """[T-05, P-18, S-17] Entries of the last day before a given time, and those after it."""
    return C.fresh_entries(table(spark, sf, "events"), "2024-01-15 00:00:00", 86_400, "ts").select("event_id", "ts")


@query("SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_per_key(spark, sf):
    """[O-05, T-08] The last event of each user."""
    return C.latest_per_key(table(spark, sf, "events"), "user_id", ["ts", "event_id"]).select("user_id", "event_id", "event_type", "value")


@query("SELECT event_type, count(*) AS n, min(event_id) AS first_event FROM events GROUP BY 1")
def value_histogram(spark, sf):
    """[A-02, U-02] How often each type occurs, and where it stood first."""
    return table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"))


@query("SELECT event_type, count(*) AS entries, sum(value) AS bytes FROM events GROUP BY ROLLUP (event_type)")
def storage_usage(spark, sf):
    """[A-08] Entries and size by folder and in all."""
    return table(spark, sf, "events").rollup("event_type").agg(F.count("*").alias("entries"), F.sum("value").alias("bytes"))


@query("SELECT bool_or(event_type = 'error') AS failed, bool_or(value > 99) AS truncated, count(*) FILTER (event_type = 'signup') AS pending FROM events")
def coverage_flags(spark, sf):
    """[A-05] Whether anything failed or was cut short."""
    e = table(spark, sf, "events")
    return e.agg(F.bool_or(F.col("event_type") == "error").alias("failed"), F.bool_or(F.col("value") > 99).alias("truncated"), F.count_if(F.col("event_type") == "signup").alias("pending"))


@query("SELECT o_custkey, CASE WHEN bool_and(o_orderstatus = 'F') THEN 'complete' WHEN bool_or(o_orderstatus = 'P') THEN 'partial_failure' ELSE 'awaiting' END AS state, count(*) AS parts FROM orders GROUP BY 1")
def status_roll_up(spark, sf):
    """[A-25] The state of each customer's orders as one."""
    return S.status_roll_up(table(spark, sf, "orders"), "o_custkey", "o_orderstatus", "F", "P")


@query("SELECT l_returnflag, list_sort(list(l_extendedprice))[(count(*) // 4 + 1)::INT] AS lower_quartile, median(l_extendedprice) AS middle FROM lineitem GROUP BY 1")
def quartiles(spark, sf):
    """The element a quarter up and the median of prices. By windows: a flag's rows are too many for one list."""
    l = table(spark, sf, "lineitem").select("l_returnflag", F.col("l_extendedprice").alias("p"))
    sizes = l.groupBy("l_returnflag").agg(F.floor(F.count("*") / 4).cast("long").alias("q"), F.median("p").alias("middle"))
    counts = l.groupBy("l_returnflag", "p").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("l_returnflag").orderBy("p"))
    found = counts.withColumn("upto", upto).join(F.broadcast(sizes), "l_returnflag").where("upto > q").groupBy("l_returnflag").agg(F.min("p").alias("lower_quartile"))
    return found.join(sizes, "l_returnflag").select("l_returnflag", "lower_quartile", "middle")


@query("SELECT o_custkey, array_to_string(list_sort(list_distinct(list(o_orderpriority))), ',') AS tags, len(list_distinct(list(o_orderpriority))) = 5 AS has_all FROM orders GROUP BY 1")
def tag_unions(spark, sf):
    """The union of the tags of each customer's orders, and whether it holds all."""
    o = table(spark, sf, "orders")
    tags = F.array_distinct(F.flatten(F.collect_list(F.array("o_orderpriority"))))
    out = o.groupBy("o_custkey").agg(tags.alias("t"))
    every = F.array(*[F.lit(x) for x in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")])
    return out.select("o_custkey", F.array_join(F.sort_array("t"), ",").alias("tags"), (F.size(F.array_except(every, "t")) == 0).alias("has_all"))


@query("""
    WITH RECURSIVE e(parent, child) AS (SELECT 'r' || n_regionkey, 'n' || n_nationkey FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer),
    t(root, node, depth) AS (SELECT 'r' || r_regionkey, 'r' || r_regionkey, 0 FROM region WHERE r_name IN ('ASIA', 'EUROPE') UNION ALL SELECT root, child, depth + 1 FROM t JOIN e ON node = parent)
    SELECT root, node, depth::INT AS depth FROM t""")
def subtree_members(spark, sf):
    """[G-01, P-02] Everything below two regions: nations and customers."""
    edge = lambda t, p, pk, c, ck: table(spark, sf, t).select(F.concat(F.lit(p), F.col(pk).cast("string")).alias("parent"), F.concat(F.lit(c), F.col(ck).cast("string")).alias("child"))
    edges = edge("nation", "r", "n_regionkey", "n", "n_nationkey").union(edge("customer", "n", "c_nationkey", "c", "c_custkey"))
    roots = table(spark, sf, "region").where("r_name in ('ASIA', 'EUROPE')").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("node"))
    return G.closure(edges, roots)


@query("SELECT 'n' || n_nationkey AS node, coalesce(sum(c_acctbal), 0) AS total, max(CASE WHEN c_custkey IS NULL THEN 0 ELSE 1 END)::INT AS height FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1")
def subtree_weights(spark, sf):
    """[A-21] The balance below each nation and the height of its tree."""
    c = table(spark, sf, "customer").select(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("parent"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("child"), F.col("c_acctbal").alias("weight"))
    n = table(spark, sf, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("node"), F.lit(0.0).alias("weight"))
    out = G.subtree_sums(c.select("parent", "child"), n.union(c.select(F.col("child").alias("node"), "weight")))
    return out.where("node like 'n%'")


@query("SELECT l_suppkey, sum(CASE WHEN l_returnflag = 'A' THEN l_quantity END) AS qty_a, sum(CASE WHEN l_returnflag = 'N' THEN l_quantity END) AS qty_n, sum(CASE WHEN l_returnflag = 'R' THEN l_quantity END) AS qty_r FROM lineitem GROUP BY 1")
def eav_pivot(spark, sf):
    """[J-10] Flags as columns."""
    out = table(spark, sf, "lineitem").groupBy("l_suppkey").pivot("l_returnflag", ["A", "N", "R"]).agg(F.sum("l_quantity"))
    return out.select("l_suppkey", F.col("A").alias("qty_a"), F.col("N").alias("qty_n"), F.col("R").alias("qty_r"))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def anti_join_customers(spark, sf):
    """[J-11] Customers without a pending order."""
    return table(spark, sf, "customer").join(table(spark, sf, "orders").where("o_orderstatus = 'P'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT c_custkey, o_custkey IS NOT NULL AS has_urgent FROM customer LEFT JOIN (SELECT DISTINCT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') ON o_custkey = c_custkey")
def left_flag(spark, sf):
    """[J-12] Whether a customer has an urgent order."""
    urgent = table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select("o_custkey").distinct()
    return table(spark, sf, "customer").join(urgent, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.col("o_custkey").isNotNull().alias("has_urgent"))


@query("SELECT o_custkey, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) AS order_list, count(*) AS n FROM orders GROUP BY 1")
def ordered_agg(spark, sf):
    """[A-15, A-01] Orders of each customer in order."""
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.expr("listagg(cast(o_orderkey as string), ',') WITHIN GROUP (ORDER BY o_orderkey)").alias("order_list"), F.count("*").alias("n"))


@query("""SELECT r_name, n_name, count(*) AS n, sum(l_quantity) AS qty FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE l_shipdate >= TIMESTAMP '1999-01-01' GROUP BY 1, 2""")
def four_way_join(spark, sf):
    """[J-09] Four tables joined by keys."""
    l = table(spark, sf, "lineitem").where("l_shipdate >= timestamp'1999-01-01'")
    j = l.join(table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("r_name", "n_name").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("qty"))


@query("SELECT o_orderkey, year(o_orderdate)::INT AS year, year(o_orderdate) BETWEEN 1998 AND 1999 AS inside, abs(year(o_orderdate) - 1999) <= 2 AS near FROM orders")
def year_filter(spark, sf):
    """[P-03, F-21] Years by the first four characters of a date."""
    y = T.year_of(F.col("o_orderdate").cast("string"))
    low, high = T.year_range(F.lit("1998:1999"))
    return table(spark, sf, "orders").select("o_orderkey", y.alias("year"), y.between(low.cast("int"), high.cast("int")).alias("inside"), F.coalesce(F.abs(y - 1999) <= 2, F.lit(True)).alias("near"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def top_orders(spark, sf):
    """[O-02, O-01] The 25 largest orders."""
    return R.top(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.col("o_orderkey")], 25)


@query("SELECT c_custkey, c_mktsegment FROM customer ORDER BY c_mktsegment, c_custkey LIMIT 17 OFFSET 34")
def customer_page(spark, sf):
    """[O-03, O-04] The third page of customers, 17 to a page."""
    return R.top(table(spark, sf, "customer").select("c_custkey", "c_mktsegment"), [F.col("c_mktsegment"), F.col("c_custkey")], 17, 34)


@query("SELECT count(*) AS rows_read, count(DISTINCT c_custkey) AS distinct_keys, count(*) = count(DISTINCT c_custkey) AS complete FROM customer")
def enumeration(spark, sf):
    """[V-16] Whether customers were read once each."""
    return S.complete_enumeration(table(spark, sf, "customer"), "c_custkey")


@query("SELECT o_custkey, o_orderkey, o_orderpriority FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 ELSE 2 END, o_orderkey) = 1")
def preferred_order(spark, sf):
    """[O-06, O-07] Each customer's order of the preferred priority."""
    return R.preferred(table(spark, sf, "orders"), "o_custkey", "o_orderpriority", ["1-URGENT", "2-HIGH"], "o_orderkey").select("o_custkey", "o_orderkey", "o_orderpriority")


@query("SELECT event_type, user_id, event_id FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY event_id) = 1) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id, event_type) = 1")
def one_per_query(spark, sf):
    """[W-03] The first event of each type, a user once."""
    return R.one_per_query(table(spark, sf, "events"), "event_type", "event_id", "user_id").select("event_type", "user_id", "event_id")


@query("SELECT l_orderkey, l_linenumber, l_quantity, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber, l_partkey, l_suppkey) AS occurrence, dense_rank() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS step, floor((l_linenumber - 1) / 3)::BIGINT AS part FROM lineitem")
def line_numbers(spark, sf):
    """[W-02, W-14, W-20] Occurrences, steps and fixed windows within orders."""
    own = F.row_number().over(Window.partitionBy("l_orderkey", "l_returnflag").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", own.alias("occurrence"), F.dense_rank().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber")).alias("step"), B.page_windows(F.col("l_linenumber"), 3).alias("part"))


@query("SELECT l_orderkey, max(l_linenumber) < 0.4 * count(*) AS clustered, count(*) AS n, (max(gap) <= 0.5 * 8) AS balanced FROM (SELECT *, coalesce(lead(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber), 8) - l_linenumber AS gap FROM lineitem) GROUP BY 1")
def cut_balance(spark, sf):
    """[W-11] Whether an order's numbers spread over the range."""
    l = table(spark, sf, "lineitem")
    cuts = l.select("l_orderkey", F.col("l_linenumber").alias("pos"))
    even = B.balanced(cuts, l.select("l_orderkey").distinct().withColumn("length", F.lit(8)), "l_orderkey")
    return l.groupBy("l_orderkey").agg((F.max("l_linenumber") < 0.4 * F.count("*")).alias("clustered"), F.count("*").alias("n")).join(even, "l_orderkey")


@query("""SELECT l_suppkey AS seed, l_partkey AS node, 'references' AS direction FROM lineitem GROUP BY ALL UNION ALL SELECT l_partkey, l_suppkey, 'citations' FROM lineitem GROUP BY ALL""")
def citation_expansion(spark, sf):
    """[S-16, G-03] One step from every supplier and part, along and against the lines between them."""
    l = table(spark, sf, "lineitem")
    edges = l.select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("citing"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("cited")).distinct()
    seeds = edges.select(F.col("citing").alias("seed")).union(edges.select("cited")).distinct()
    out = bibliography.citation_edges(seeds, edges)
    number = lambda c: F.substring(c, 2, 20).cast("long")
    return out.select(number("seed").alias("seed"), number("node").alias("node"), "direction")


@query("SELECT DISTINCT 'p' || user_id % 3 AS provider, event_type AS model FROM events WHERE event_type <> 'error' AND event_id % 10 <> 3 ORDER BY 1, 2")
def trace_models(spark, sf):
    """[S-20] Models in lines of a trace, some of them broken."""
    e = table(spark, sf, "events")
    record = F.to_json(F.struct(F.when(F.col("event_type") == "error", "started").otherwise("completed").alias("event"), F.concat(F.lit("p"), (F.col("user_id") % 3).cast("string")).alias("provider"), F.col("event_type").alias("modelId")))
    line = F.when(F.col("event_id") % 10 == 3, F.concat(F.lit("{"), record)).otherwise(record)
    return files.trace_models(e.select(line.alias("value")))


@query("""
    WITH e AS (SELECT user_id AS run_id, bool_or(event_type = 'view') AS prepared, bool_or(event_type = 'click') AS attempted, bool_or(event_type = 'purchase') AS seen, bool_or(event_type = 'signup' AND value > 90) AS complete, bool_or(event_type = 'error' AND value > 95) AS restored FROM events GROUP BY 1)
    SELECT run_id, CASE WHEN restored THEN 'restored' WHEN complete THEN 'complete' WHEN seen THEN 'native_committed' WHEN attempted THEN 'native_uncertain' WHEN prepared THEN 'prepared' ELSE 'preflight' END AS state FROM e""")
def merge_states(spark, sf):
    """[T-06] Where each run's merge stands after its events."""
    t, v = F.col("event_type"), F.col("value")
    name = F.when(t == "view", "prepared").when(t == "click", "attempted").when(t == "purchase", "commit_seen").when((t == "signup") & (v > 90), "complete").when((t == "error") & (v > 95), "restored").otherwise("other")
    return C.merge_state(table(spark, sf, "events").select(F.col("user_id").alias("run_id"), name.alias("event")))


@query("""
    WITH e AS (SELECT user_id AS run_id, event_id, CASE WHEN event_type = 'view' THEN 'start' WHEN event_type = 'click' THEN 'report' END AS ev FROM events WHERE event_type IN ('view', 'click')),
    s AS (SELECT *, coalesce(bool_or(ev = 'start') OVER w, false) AS started FROM e WINDOW w AS (PARTITION BY run_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    r AS (SELECT *, ev = 'report' AND (NOT started OR coalesce(count(*) FILTER (ev = 'report' AND started) OVER w, 0) > 0) AS rejected FROM s WINDOW w AS (PARTITION BY run_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT run_id, CASE WHEN bool_or(ev = 'report' AND NOT rejected) THEN 'report_imported' WHEN bool_or(ev = 'start') THEN 'awaiting_report' ELSE 'not_started' END AS state, count(*) FILTER (rejected) AS rejected FROM r GROUP BY run_id""")
def handoff_states(spark, sf):
    """[T-07] Hand-offs replayed in batch: the first report after a start counts."""
    name = F.when(F.col("event_type") == "view", "start").when(F.col("event_type") == "click", "report")
    return C.handoff_state(table(spark, sf, "events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("ord"), name.alias("event")).where("event is not null"))


@query(ORACLE_SQL["handoff_states"])
def handoff_stream(spark, sf):
    """[T-07, T-03] The same hand-offs as a stream with state."""
    path = f"{sf.rstrip('/')}/events.parquet"
    # the stream watches a folder and picks the table's file, or the folder of its parts, by name
    stream = handoff.watch_folder(spark, f"{sf.rstrip('/')}/events.parque[t]", spark.read.parquet(path).schema, "parquet")
    name = F.when(F.col("event_type") == "view", "start").when(F.col("event_type") == "click", "report")
    events = stream.select(F.col("user_id").alias("run_id"), F.col("event_id").alias("ord"), name.alias("event")).where("event is not null")
    return handoff.run_to_table(handoff.handoff_states(events), ["run_id"])


@query("""
    WITH s AS (SELECT user_id, event_id, event_type, CASE WHEN event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) THEN 0 ELSE 1 END AS new FROM events)
    SELECT user_id, event_id, sum(new) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS version, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1 AS is_latest FROM s""")
def versions(spark, sf):
    """[T-09] Version numbers: equal content keeps its number."""
    return C.version_numbers(table(spark, sf, "events"), "user_id", "event_type", "event_id").select("user_id", "event_id", "version", "is_latest")


@query("""
    WITH a AS (SELECT user_id AS paper, event_id AS ord, event_type AS resolver, event_id % 7 AS url, value > 80 AS ok FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_id % 7 ORDER BY event_id) = 1),
    b AS (SELECT paper, min(ord) AS o FROM a WHERE ok GROUP BY 1)
    SELECT a.paper, max(CASE WHEN a.ord = b.o THEN resolver END) AS resolver, count(*) FILTER (b.o IS NULL OR a.ord <= b.o) AS attempts FROM a LEFT JOIN b USING (paper) GROUP BY a.paper""")
def first_successes(spark, sf):
    """[T-12, X-03] The resolver that served each paper first."""
    e = table(spark, sf, "events").select(F.col("user_id").alias("paper"), F.col("event_id").alias("ord"), F.col("event_type").alias("resolver"), (F.col("event_id") % 7).alias("url"), (F.col("value") > 80).alias("ok"))
    return C.first_success(e, "paper")


@query("SELECT CASE WHEN event_type IN ('view', 'click') AND value > 50 THEN 'pending' WHEN value > 50 THEN 'complete' ELSE 'failed' END AS status, count(*) AS n FROM events GROUP BY 1")
def reopened_tasks(spark, sf):
    """[T-11] The log after a change of budget."""
    log = table(spark, sf, "events").select(F.col("event_type").alias("provider"), F.when(F.col("value") > 50, "complete").otherwise("failed").alias("status"))
    return C.reopen(log, ["view", "click"]).groupBy("status").agg(F.count("*").alias("n"))


@query("""
    SELECT split || '-' || p_type || '-' || printf('%02d', p_partkey) AS id, split, p_type AS kind, r::INT AS repeat, p_size + seed AS target
    FROM part, (VALUES ('train', 110), ('val', 210), ('test', 310)) s(split, seed), range(1, 4) c(r)""")
def repeated_tasks(spark, sf):
    """[S-32, J-25] Evaluation tasks from a table of specs in three splits, three runs each."""
    specs = table(spark, sf, "part").select(F.col("p_partkey").alias("n"), F.col("p_type").alias("kind"), F.concat(F.lit('{"seed": "{seed}", "size": '), F.col("p_size").cast("string"), F.lit("}")).alias("data"))
    tasks = V.repeat_tasks(V.generate_tasks(specs, {"train": 110, "val": 210, "test": 310}), 3)
    return tasks.select("id", "split", "kind", "repeat", (F.get_json_object("data", "$.size").cast("long") + F.get_json_object("data", "$.seed").cast("long")).alias("target"))


@query("SELECT p_partkey, floor(p_retailprice / 2000 * 1e4 + 0.5) / 100 AS share, CASE WHEN p_retailprice * p_size < 1048576 THEN ceil(p_retailprice * p_size / 1024)::BIGINT || ' KB' ELSE printf('%.1f', p_retailprice * p_size / 1048576) || ' MB' END AS amount FROM part")
def part_figures(spark, sf):
    """[F-27, F-35] Shares to two decimals and sizes for reading."""
    price = F.col("p_retailprice")
    return table(spark, sf, "part").select("p_partkey", T.percent(price, F.lit(2000)).alias("share"), T.human_bytes(price * F.col("p_size")).alias("amount"))


@query("""
    WITH t AS (SELECT p_partkey, p_retailprice AS peak, p_retailprice * 1.4 AS target FROM part), u AS (SELECT *, pow(10, floor(log10(target))) AS pw FROM t),
    m AS (SELECT *, coalesce(list_filter(list_transform([1, 1.5, 2, 2.5, 3, 4, 5, 6, 8, 10], lambda x: x::DOUBLE * pw), lambda x: x >= target - 1e-9)[1], 10 * pw) AS nice FROM u)
    SELECT p_partkey, round(CASE WHEN peak = floor(peak) THEN ceil(nice) ELSE nice END, 3) AS top FROM m""")
def axis_scales(spark, sf):
    """[F-26] The top of an axis for each price."""
    return table(spark, sf, "part").select("p_partkey", T.nice_scale(F.col("p_retailprice"))[0].alias("top"))


@query("SELECT doc_id, n_chars + length(coalesce(source, '')) AS total, ((9 * total + 19) // 20)::BIGINT AS h, greatest(0, h - 2 * (total - 2 * h + 1))::BIGINT AS bound FROM documents")
def match_bounds(spark, sf):
    """[F-15, F-16] Least matches and shared 3-grams of each document's text and its source's name, were they to be alike."""
    rows = table(spark, sf, "documents").select("doc_id", F.col("n_chars").alias("m"), F.length(F.coalesce("source", F.lit(""))).cast("long").alias("k"))
    return rows.select("doc_id", (F.col("m") + F.col("k")).alias("total"), T.minimum_matches(F.col("m") + F.col("k")).cast("long").alias("h"), T.overlap_bound(F.col("m"), F.col("k")).cast("long").alias("bound"))


@query("SELECT o_orderdate::DATE AS day, count(*) AS n, sum(o_totalprice) AS total FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') GROUP BY 1")
def unreturned_days(spark, sf):
    """[U-01, U-03, J-11] Orders without a returned line, by day; the two halves of the year appended."""
    o = table(spark, sf, "orders")
    both = o.where(F.month("o_orderdate") <= 6).unionByName(o.where(F.month("o_orderdate") > 6), allowMissingColumns=True)
    kept = both.join(table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti")
    return kept.groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total"))


@query("""
    WITH RECURSIVE r AS (SELECT user_id, event_id AS a, event_id + trunc(value)::BIGINT AS b, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
    t AS (SELECT user_id, n, a, b, 0::BIGINT AS lane, [b] AS ends FROM r WHERE n = 1
        UNION ALL SELECT user_id, n, a, b, lane, CASE WHEN lane < len(ends) THEN list_concat(list_concat(ends[:lane], [b]), ends[lane + 2:]) ELSE list_append(ends, b) END
        FROM (SELECT r.*, t.ends, coalesce(nullif(list_position(list_transform(t.ends, lambda e: e <= r.a), true), 0), len(t.ends) + 1) - 1 AS lane FROM t JOIN r ON r.user_id = t.user_id AND r.n = t.n + 1))
    SELECT user_id, a AS start, b AS end, lane FROM t""")
def event_lanes(spark, sf):
    """[W-15] Events of each user as intervals, in lanes without overlap."""
    e = table(spark, sf, "events").select("user_id", F.col("event_id").alias("start"), (F.col("event_id") + F.col("value").cast("long")).alias("end"))
    return B.place_intervals(e, "user_id")
