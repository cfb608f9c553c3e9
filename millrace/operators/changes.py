"""What changed between two states, what has to run again, and tables that remember what was done."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .evidence import rule, violations


def keyed_diff(old: DataFrame, new: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """[J-20, U-05, U-07] (key, change): added, removed or changed."""
    digest = lambda df, n: df.select(*key, F.xxhash64(F.to_json(F.struct(*values))).alias(n), F.lit(True).alias(f"has_{n}"))
    both = digest(old, "old").join(digest(new, "new"), key, "full_outer")
    change = F.when(F.col("has_old").isNull(), "added").when(F.col("has_new").isNull(), "removed").when(~F.col("old").eqNullSafe(F.col("new")), "changed")
    return both.select(*key, change.alias("change")).where("change is not null")


def fingerprint_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """[J-21, T-02, W-13] (path, status, read_from): MISSING, NEW, APPENDED with the first line not read yet, or CHANGED; both
    (path, size, lines, digest), new with kind too."""
    both = new.alias("n").join(old.alias("o"), "path", "full_outer")
    status = (
        F.when(F.col("n.digest").isNull(), "MISSING").when(F.col("o.digest").isNull(), "NEW").when(F.col("o.digest") == F.col("n.digest"), None)
        .when((F.col("n.kind") == "append") & (F.col("n.size") > F.col("o.size")), "APPENDED").otherwise("CHANGED")
    )
    rows = both.select("path", status.alias("status"), (F.col("o.lines") + 1).alias("next_line")).where("status is not null")
    return rows.select("path", "status", F.when(F.col("status") == "APPENDED", F.col("next_line")).alias("read_from"))


def appended_rows(rows: DataFrame, offsets: DataFrame, source: str, position: str) -> DataFrame:
    """[T-02] Rows past the last offset read of each source; of a new source all."""
    return rows.join(offsets.select(source, "offset"), source, "left").where(F.col(position) > F.coalesce("offset", F.lit(-1))).drop("offset")


def propagate(changed: DataFrame, uses: DataFrame) -> DataFrame:
    """[J-22] (output, inputs): outputs that use a changed path, with the paths. uses (path, output)."""
    hit = uses.join(changed.select("path").distinct(), "path", "left_semi")
    return hit.groupBy("output").agg(F.array_join(F.sort_array(F.collect_set("path")), ",").alias("inputs"))


def reconcile(declared: DataFrame, used: DataFrame) -> DataFrame:
    """[J-23, V-12] (claim, page, finding): declared for a page that doesn't cite it, cited without being declared, and claims that no page
    cites; both (claim, page)."""
    d, u = declared.select("claim", "page").distinct(), used.select("claim", "page").distinct()
    known = d.select("claim").distinct()
    return (
        d.where("page is not null").join(u, ["claim", "page"], "left_anti").withColumn("finding", F.lit("declared_not_used"))
        .unionByName(u.join(known, "claim", "left_semi").join(d, ["claim", "page"], "left_anti").withColumn("finding", F.lit("used_not_declared")))
        .unionByName(known.join(u, "claim", "left_anti").withColumns({"page": F.lit(None).cast(d.schema["page"].dataType), "finding": F.lit("orphan")}))
        .unionByName(u.join(known, "claim", "left_anti").withColumn("finding", F.lit("unknown_claim")))
    )


def pending_tasks(tasks: DataFrame, log: DataFrame, key: list[str]) -> DataFrame:
    """[T-01] Tasks that never completed; failures stay open."""
    return tasks.join(log.where("status = 'complete'").select(*key).distinct(), key, "left_anti")


def reopen(log: DataFrame, providers: list[str]) -> DataFrame:
    """[T-11] The log after a change of budget: what these providers had completed is pending again."""
    again = (F.col("status") == "complete") & F.col("provider").isin(*providers)
    return log.withColumn("status", F.when(again, "pending").otherwise(F.col("status")))


def fresh_entries(cache: DataFrame, now, seconds: int, at: str = "at") -> DataFrame:
    """[T-05, S-17, P-18] Entries that are not older than that at the time `now`."""
    return cache.where(F.col(at) > F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {int(seconds)} SECONDS"))


def due_hints(states: DataFrame, now, every_days: int, big_bytes: int, stale_days: int, stale_bytes: int) -> DataFrame:
    """[P-19] states (last_hint, last_clean, first_seen, bytes, and others) of which a hint is due at the time `now`: none was given within so
    many days, and they are big, or of some size and not cleaned for long; never cleaned counts from when they were first seen."""
    at = F.lit(now).cast("timestamp")
    quiet = F.col("last_hint").isNull() | (F.col("last_hint") <= at - F.expr(f"INTERVAL {int(every_days)} DAYS"))
    since = F.coalesce("last_clean", "first_seen", at)
    stale = (since <= at - F.expr(f"INTERVAL {int(stale_days)} DAYS")) & (F.col("bytes") >= stale_bytes)
    return states.where(quiet & ((F.col("bytes") >= big_bytes) | stale))


def cached_results(requests: DataFrame, cache: DataFrame, key: list[str], value: str) -> DataFrame:
    """[T-04, S-17] requests with digest, value and hit; the cache is (digest, value)."""
    keyed = requests.withColumn("digest", F.sha2(F.to_json(F.struct(*key)), 256))
    return keyed.join(cache.select("digest", value).dropDuplicates(["digest"]), "digest", "left").withColumn("hit", F.col(value).isNotNull())


def first_success(attempts: DataFrame, key: str, order: str = "ord") -> DataFrame:
    """[T-12] (key, resolver, attempts): the first attempt in order that succeeded, and how many were needed; attempts behind it and repeated
    addresses do not count."""
    once = F.row_number().over(Window.partitionBy(key, "url").orderBy(order))
    tried = attempts.withColumn("n", once).where("n = 1").drop("n")
    best = tried.where("ok").groupBy(key).agg(F.min(F.struct(F.col(order).alias("o"), "resolver")).alias("b"))
    joined = tried.join(best, key, "left")
    return joined.groupBy(key).agg(F.first("b.resolver").alias("resolver"), F.count_if(F.col("b").isNull() | (F.col(order) <= F.col("b.o"))).alias("attempts"))


MERGE_STEPS = ("preflight", "prepared", "native_uncertain", "native_committed", "complete")


def merge_state(events: DataFrame, run: str = "run_id") -> DataFrame:
    """[T-06] (run, state): replayed events of a merge. A restoration ends it; a commit that was seen counts even if the run broke off
    before it was told; without one, an attempt is uncertain."""
    seen = lambda s: F.bool_or(F.col("event") == s)
    flags = events.groupBy(run).agg(*[seen(s).alias(s) for s in ("prepared", "attempted", "commit_seen", "complete", "restored")])
    state = F.when(F.col("restored"), "restored").when(F.col("complete"), "complete").when(F.col("commit_seen"), "native_committed").when(F.col("attempted"), "native_uncertain").when(F.col("prepared"), "prepared").otherwise("preflight")
    return flags.select(run, state.alias("state"))


def handoff_state(events: DataFrame, run: str = "run_id") -> DataFrame:
    """[T-07] (run, state, rejected): batch replay of a hand-off: the first report after a start is imported, further ones are rejected."""
    w = Window.partitionBy(run).orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    started = F.coalesce(F.bool_or(F.col("event") == "start").over(w), F.lit(False))
    before = F.count_if((F.col("event") == "report") & F.col("started")).over(w)
    rows = events.withColumn("started", started)
    rows = rows.withColumn("rejected", (F.col("event") == "report") & (~F.col("started") | (before > 0)))
    state = F.when(F.bool_or((F.col("event") == "report") & ~F.col("rejected")), "report_imported").when(F.bool_or(F.col("event") == "start"), "awaiting_report").otherwise("not_started")
    return rows.groupBy(run).agg(state.alias("state"), F.count_if("rejected").alias("rejected"))


def version_numbers(snapshots: DataFrame, key: str, digest: str, order: str) -> DataFrame:
    """[T-09] snapshots with version: a content equal to the one before keeps its number; is_latest marks the last."""
    w = Window.partitionBy(key).orderBy(order)
    new = F.when(F.col(digest).eqNullSafe(F.lag(digest).over(w)), 0).otherwise(1)
    out = snapshots.withColumn("new", new).withColumn("version", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("new")
    return out.withColumn("is_latest", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order))) == 1)


def latest_per_key(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """[O-05, T-08] The last row of each key."""
    last = F.row_number().over(Window.partitionBy(key).orderBy(*[F.desc(c) for c in order]))
    return rows.withColumn("n", last).where("n = 1").drop("n")


def merge_violations(before: DataFrame, after: DataFrame, mapping: DataFrame) -> DataFrame:
    """[V-05, A-20] What a merge lost. before and after (key, deleted, file_hashes, tags, relations), mapping (key, into)."""
    empty = F.array().cast("array<string>")
    into = mapping.join(before, "key").groupBy(F.col("into").alias("key")).agg(*[F.array_distinct(F.flatten(F.collect_list(F.coalesce(c, empty)))).alias(f"want_{c}") for c in ("file_hashes", "tags", "relations")])
    result = into.join(after, "key", "left")
    gone = before.join(after.select("key"), "key", "left_anti")
    lost = {c: F.array_except(f"want_{c}", F.coalesce(c, empty)) for c in ("file_hashes", "tags", "relations")}
    loose = mapping.where("key <> into").join(after, "key").where("not deleted")
    return violations(rule(gone, "key", "lost_key", F.lit(True)), rule(loose, "key", "not_deleted", F.lit(True)), *[rule(result, "key", f"lost_{c}", F.size(x) > 0, F.array_join(F.sort_array(x), ",")) for c, x in lost.items()])


def hash_violations(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """[V-17] Files that are missing, changed or not in the manifest; both (path, digest)."""
    both = manifest.withColumnRenamed("digest", "want").join(files, "path", "full_outer")
    return violations(rule(both, "path", "missing", F.col("digest").isNull()), rule(both, "path", "unlisted", F.col("want").isNull()), rule(both, "path", "changed", F.col("want") != F.col("digest")))
