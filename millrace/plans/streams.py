"""Queries that run as streams over the driver's tables, in turns with one checkpoint, with SQL over the whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import table
from ..streaming import keeping as K

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    """Registers a query under its function's name, with the SQL that gives the same rows."""

    def add(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add


def in_turns(rows: DataFrame, by: str, turns: int) -> list[DataFrame]:
    """rows in stretches of a number."""
    low, high = rows.agg(F.min(by), F.max(by)).first()
    width = ((high or 0) - (low or 0)) // turns + 1
    return [rows.where(F.col(by).between((low or 0) + i * width, (low or 0) + (i + 1) * width - 1)) for i in range(turns)]


@query("""
    WITH RECURSIVE e AS (SELECT user_id, event_type, event_id, date_trunc('millisecond', ts) AS ts FROM events),
    m AS (SELECT user_id, event_type, min(ts) AS t FROM e GROUP BY ALL UNION ALL
        SELECT m.user_id, m.event_type, min(e.ts) FROM m JOIN e ON m.user_id = e.user_id AND m.event_type = e.event_type AND e.ts >= m.t + INTERVAL 1 DAY GROUP BY m.user_id, m.event_type, m.t),
    last AS (SELECT max(ts) AS at FROM e), misses AS (SELECT user_id, event_type, count(*) AS misses, count(*) FILTER (t + INTERVAL 1 DAY <= last.at) AS evictions FROM m, last GROUP BY ALL)
    SELECT user_id, event_type, count(*) - misses AS hits, misses, evictions FROM e JOIN misses USING (user_id, event_type) GROUP BY user_id, event_type, misses, evictions""")
def result_cache(spark, sf):
    """[T-04, T-05, S-17] Events as lookups of a cache that keeps a result for a day: hits, misses and evictions of each user's types."""
    e = table(spark, sf, "events").select(F.col("user_id").alias("key"), F.col("event_type").alias("name"), F.col("event_id").alias("ord"), "ts")
    out = K.run_in_turns(spark, in_turns(e, "ord", 3), lambda stream: K.cached_results(stream, 86_400))
    told = lambda o: F.count_if(F.col("outcome") == o)
    return out.groupBy(F.col("key").alias("user_id"), F.col("name").alias("event_type")).agg(told("hit").alias("hits"), told("miss").alias("misses"), told("evicted").alias("evictions"))


@query("""
    WITH l AS (SELECT user_id, list(event_type || value::DECIMAL(18, 2)::VARCHAR ORDER BY event_id) AS a FROM events GROUP BY 1),
    runs AS (SELECT user_id, a[:len(a) // 3] AS r1, CASE WHEN user_id % 5 = 0 THEN a[:len(a) // 6] WHEN user_id % 7 = 0 THEN list_concat(['edited'], a[2:2 * len(a) // 3]) ELSE a[:2 * len(a) // 3] END AS r2,
        CASE WHEN user_id % 5 <> 0 AND user_id % 11 = 0 THEN CASE WHEN user_id % 7 = 0 THEN list_concat(['edited'], a[2:2 * len(a) // 3]) ELSE a[:2 * len(a) // 3] END ELSE a END AS r3 FROM l),
    pairs AS (SELECT user_id, 1 AS run, NULL AS old, r1 AS new FROM runs UNION ALL SELECT user_id, 2, r1, r2 FROM runs UNION ALL SELECT user_id, 3, r2, r3 FROM runs)
    SELECT user_id, run::BIGINT AS run, CASE WHEN old IS NULL THEN 'NEW' WHEN new[:len(old)] <> old THEN 'CHANGED' WHEN len(new) > len(old) THEN 'APPENDED' ELSE 'SAME' END AS status,
        CASE WHEN old IS NULL OR new[:len(old)] <> old THEN 0 ELSE len(old) END::BIGINT AS start, len(new)::BIGINT AS lines FROM pairs""")
def tracked_events(spark, sf):
    """[T-02, J-21] Each user's events as a source that three runs read, some shrunk and some edited between; the second run's rows come twice."""
    text = F.concat("event_type", F.col("value").cast("decimal(18,2)").cast("string"))
    w = Window.partitionBy("user_id")
    e = table(spark, sf, "events").select(F.col("user_id").alias("source"), (F.row_number().over(w.orderBy("event_id")) - 1).alias("line"), F.count("*").over(w).alias("n"), text.alias("text"))
    user, edited = F.col("source"), F.when((F.col("source") % 7 == 0) & (F.col("source") % 5 != 0) & (F.col("line") == 0), "edited").otherwise(F.col("text")).alias("text")
    upto = lambda n: F.col("line") < n
    third, most = F.floor(F.col("n") / 3), F.floor(2 * F.col("n") / 3)
    run = lambda n, rows, *columns: rows.select("source", F.lit(n).cast("long").alias("run"), "line", *columns)
    second = e.where(upto(F.when(user % 5 == 0, F.floor(F.col("n") / 6)).otherwise(most)))
    still = (user % 5 != 0) & (user % 11 == 0)
    third_run = run(3, e.where(~still), "text").union(run(3, e.where(still & upto(most)), edited))
    turns = [run(1, e.where(upto(third)), "text"), run(2, second, edited), run(2, second, edited), third_run]
    return K.run_in_turns(spark, turns, K.tracked_sources).withColumnRenamed("source", "user_id")


@query("""
    WITH e AS (SELECT user_id AS run_id, bool_or(event_type = 'view') AS prepared, bool_or(event_type = 'click') AS attempted, bool_or(event_type = 'purchase') AS seen, bool_or(event_type = 'signup' AND value > 90) AS complete, bool_or(event_type = 'error' AND value > 95) AS restored, max(event_id) AS ord FROM events GROUP BY 1)
    SELECT run_id, ord, CASE WHEN restored THEN 'restored' WHEN complete THEN 'complete' WHEN seen THEN 'native_committed' WHEN attempted THEN 'native_uncertain' WHEN prepared THEN 'prepared' ELSE 'preflight' END AS state FROM e""")
def merge_turns(spark, sf):
    """[T-06] Merges of users carried from run to run; the second run's events come twice."""
    t, v = F.col("event_type"), F.col("value")
    name = F.when(t == "view", "prepared").when(t == "click", "attempted").when(t == "purchase", "commit_seen").when((t == "signup") & (v > 90), "complete").when((t == "error") & (v > 95), "restored").otherwise("other")
    turns = in_turns(table(spark, sf, "events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("ord"), name.alias("event")), "ord", 3)
    out = K.run_in_turns(spark, [turns[0], turns[1], turns[1], turns[2]], K.tracked_merges)
    return out.groupBy("run_id").agg(F.max(F.struct("ord", "state")).alias("last")).select("run_id", "last.ord", "last.state")
