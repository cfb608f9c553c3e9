"""Screening: decisions, funnels, coverage, batches and set rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .evidence import rule, violations


def latest_decisions(decisions: DataFrame, key: str = "id", order: str = "batch") -> DataFrame:
    """[U-06] The last decision on each id."""
    last = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    return decisions.withColumn("n", last).where("n = 1").drop("n")


def funnel(known: DataFrame, decisions: DataFrame, imported: DataFrame | None = None) -> DataFrame:
    """[A-03] One row: candidates, and how many are included, excluded, deferred and not assessed. Imported ids count as included;
    decisions on unknown ids do not count."""
    groups = decisions.select("id", F.col("group").alias("g"))
    if imported is not None:
        groups = groups.unionByName(imported.select("id", F.lit("included").alias("g")))
    flags = groups.groupBy("id").agg(*[F.bool_or(F.col("g") == g).alias(g) for g in ("included", "excluded", "deferred")])
    joined = known.select("id").distinct().join(flags, "id", "left")
    return joined.agg(F.count("*").alias("candidates"), *[F.count_if(g).alias(g) for g in ("included", "excluded", "deferred")], F.count_if(F.col("included").isNull()).alias("unassessed"))


def unassessed(known: DataFrame, decisions: DataFrame) -> DataFrame:
    """[U-03] Known rows without a decision."""
    return known.join(decisions.select("id").distinct(), "id", "left_anti")


def next_batch(known: DataFrame, decisions: DataFrame, size: int = 40, order: str = "ord") -> DataFrame:
    """[T-10] The first rows in order that have no decision."""
    return unassessed(known, decisions).orderBy(order).limit(size)


def scope_status(summary: DataFrame) -> DataFrame:
    """[A-25] complete, or pending while something is deferred or not assessed."""
    return summary.withColumn("status", F.when((F.col("unassessed") > 0) | (F.col("deferred") > 0), "selected_complete_scope_pending").otherwise("complete"))


def facet_hits(sources: DataFrame, facets: DataFrame) -> DataFrame:
    """[J-13] (name, id): ids that one of a facet's queries has found. sources (id, query), facets (name, query)."""
    return sources.join(facets.select("name", "query").distinct(), "query").select("name", "id").distinct()


def facet_coverage(facets: DataFrame, sources: DataFrame, papers: DataFrame) -> DataFrame:
    """[A-04] (name, retrieved, selected, fulltext) of each facet; papers (id, level) are those selected."""
    hits = facet_hits(sources, facets).join(papers.select("id", "level"), "id", "left")
    counts = hits.groupBy("name").agg(F.countDistinct("id").alias("retrieved"), F.countDistinct(F.when(F.col("level").isNotNull(), F.col("id"))).alias("selected"), F.countDistinct(F.when(F.col("level") == "fulltext", F.col("id"))).alias("fulltext"))
    out = facets.select("name").distinct().join(counts, "name", "left")
    return out.select("name", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("retrieved", "selected", "fulltext")])


def coverage_warnings(tasks: DataFrame, coverage: DataFrame, queries: int) -> DataFrame:
    """[A-05] One row of flags. tasks (status, possibly_truncated)."""
    flags = tasks.agg(F.coalesce(F.bool_or(F.col("status") == "failed"), F.lit(False)).alias("failed"), F.coalesce(F.bool_or("possibly_truncated"), F.lit(False)).alias("truncated"), F.count_if(F.col("status") == "pending").alias("pending"))
    gaps = coverage.agg(F.count_if(F.col("retrieved") == 0).alias("empty_facets"), F.coalesce(F.sum("fulltext") == 0, F.lit(False)).alias("no_fulltext"))
    return flags.crossJoin(F.broadcast(gaps)).withColumn("single_query", F.lit(queries < 2))  # one row with one row


def plan_violations(facets: DataFrame) -> DataFrame:
    """[P-17] facets (ord, name, queries): names filled and unique, queries there and not blank."""
    names = facets.groupBy("name").agg(F.count("*").alias("n"), F.min("ord").alias("ord"))
    blank = F.exists("queries", lambda q: F.coalesce(F.trim(q), F.lit("")) == "")
    return violations(
        rule(facets, "ord", "no_name", F.coalesce(F.trim("name"), F.lit("")) == ""), rule(names, "ord", "duplicate_name", F.col("n") > 1, F.col("name")),
        rule(facets, "ord", "no_queries", F.coalesce(F.size("queries"), F.lit(0)) <= 0), rule(facets, "ord", "blank_query", blank),
    )


def decision_violations(updates: DataFrame, known: DataFrame, imported: DataFrame, prior: DataFrame, limit: int | None = None) -> DataFrame:
    """[V-14, U-04] updates (id, group, reason): known ids, once each, with a reason; imported and earlier inclusions stay included."""
    times = updates.groupBy("id").agg(F.count("*").alias("n"))
    moved = updates.where("group <> 'included'").join(imported.select("id").distinct(), "id", "left_semi")
    kept = prior.where("group = 'included'").join(updates.where("group = 'included'").select("id"), "id", "left_anti").join(updates.select("id").distinct(), "id", "left_semi")
    parts = [
        rule(updates.join(known.select("id").distinct(), "id", "left_anti"), "id", "unknown_id", F.lit(True)), rule(times, "id", "decided_twice", F.col("n") > 1),
        rule(updates, "id", "no_reason", F.coalesce(F.trim("reason"), F.lit("")) == ""), rule(moved, "id", "imported_removed", F.lit(True)), rule(kept, "id", "inclusion_dropped", F.lit(True)),
    ]
    if limit is not None:
        total = updates.where("group = 'included'").agg(F.count("*").alias("n"))
        parts.append(rule(total.withColumn("id", F.lit("all")), "id", "over_limit", F.col("n") > limit, F.col("n")))
    return violations(*parts)


def status_roll_up(parts: DataFrame, group: str, status: str, done: str = "published", failed: str = "error") -> DataFrame:
    """[A-25] complete if all are done, partial_failure if any failed, else awaiting."""
    roll = F.when(F.bool_and(F.col(status) == done), "complete").when(F.bool_or(F.col(status) == failed), "partial_failure").otherwise("awaiting")
    return parts.groupBy(group).agg(roll.alias("state"), F.count("*").alias("parts"))


def complete_enumeration(rows: DataFrame, key: str, expected: Column | None = None) -> DataFrame:
    """[V-16, O-03] One row: rows read, distinct keys, and whether they agree, with what was expected too."""
    out = rows.agg(F.count("*").alias("rows_read"), F.countDistinct(key).alias("distinct_keys"))
    same = F.col("rows_read") == F.col("distinct_keys")
    return out.withColumn("complete", same if expected is None else same & (F.col("rows_read") == expected))


def ordered_distinct(rows: DataFrame, value: str, order: str, by: str | None = None) -> DataFrame:
    """[U-02] Each value once, with the place where it stood first."""
    return rows.groupBy(*([by] if by else []), value).agg(F.min(order).alias(order))


def set_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """[U-05, U-08] (value, side): values that only one side has; empty if the sets are equal."""
    left, right = a.distinct().toDF("value"), b.distinct().toDF("value")
    return left.join(right, "value", "left_anti").withColumn("side", F.lit("left")).union(right.join(left, "value", "left_anti").withColumn("side", F.lit("right")))


def replace_section(sections: DataFrame, edits: DataFrame) -> DataFrame:
    """[U-10] sections (doc, id, title, body) with edits (doc, query, body) applied: a query names a section by its id, its title or both;
    status tells for each edit whether it named none, one or several, and only one changes a body."""
    names = sections.select("doc", "id", F.explode(F.array_distinct(F.array(F.lower("id"), F.lower("title"), F.lower(F.concat_ws(" ", "id", "title"))))).alias("name"))
    hits = edits.withColumn("name", F.lower(F.trim("query"))).join(names, ["doc", "name"])
    counted = hits.groupBy("doc", "query").agg(F.countDistinct("id").alias("n"), F.min("id").alias("id"), F.first("body").alias("new"))
    single = counted.where("n = 1").select("doc", "id", "new")
    return sections.join(single, ["doc", "id"], "left").select("doc", "id", "title", F.coalesce("new", "body").alias("body"), F.col("new").isNotNull().alias("changed"))
