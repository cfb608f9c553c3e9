"""Queries of scalar forms, comparisons of snapshots and rules on the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import changes as C
from ..operators import evals as V
from ..operators import linkage as L
from ..operators import screening as S
from ..session import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    """Registers a query under its function's name, with the SQL that gives the same rows."""

    def add(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add


def text(c):
    return F.col(c).cast("string")


# --- forms ---


@query("""
    SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN '10.48550/arxiv.22' ELSE '10.1000/ab' END || (o_custkey % 1000) AS doi, CASE WHEN o_orderkey % 4 < 3 THEN '2201.' || printf('%05d', o_orderkey % 100000) || CASE WHEN o_orderkey % 2 = 0 THEN 'v' || (o_custkey % 9) ELSE '' END END AS arxiv,
        CASE WHEN o_orderkey % 4 < 3 THEN '2201.' || printf('%05d', o_orderkey % 100000) END AS base, o_orderkey % 3 = 0 AS preprint FROM orders""")
def identifier_forms(spark, sf):
    """[F-02, F-03, P-05] DOIs behind resolvers, schemes and punctuation, and ids in addresses."""
    k = F.col("o_orderkey")
    front = F.when(k % 5 == 0, "https://doi.org/").when(k % 5 == 1, " http://dx.doi.org/").when(k % 5 == 2, "DOI: ").otherwise("")
    raw = F.concat(front, F.when(k % 3 == 0, "10.48550/arXiv.22").otherwise("10.1000/AB"), (F.col("o_custkey") % 1000).cast("string"), F.when(k % 7 == 0, ".,").otherwise(""))
    url = F.concat(F.when(k % 4 == 0, "https://arxiv.org/abs/").when(k % 4 == 1, "http://export.ArXiv.org/pdf/").when(k % 4 == 2, "see arxiv.org/abs/").otherwise("https://example.org/abs/"), F.format_string("2201.%05d", k % 100000), F.when(k % 2 == 0, F.concat(F.lit("v"), (F.col("o_custkey") % 9).cast("string"))).otherwise(""))
    rows = table(spark, sf, "orders").select("o_orderkey", T.doi(raw).alias("doi"), T.arxiv_id(url).alias("arxiv"))
    return rows.withColumns({"base": T.arxiv_base(F.col("arxiv")), "preprint": T.is_preprint_doi(F.col("doi"))})


_TITLED = "SELECT page_id, lower(regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '[^\\p{L}\\p{N}_]', '', 'g')) AS x, lower(regexp_replace(regexp_extract(html, '<h1>([^<]*)</h1>', 1), '[^\\p{L}\\p{N}_]', '', 'g')) AS y FROM pages"


@query(f"SELECT page_id, x <> '' AND (x = y OR (length(x) <= 60 AND (contains(y, x) OR contains(x, y)))) AS same FROM ({_TITLED})")
def title_and_heading(spark, sf):
    """[F-11] Pages whose title and first heading are the same title."""
    part = lambda tag: F.regexp_extract("html", f"<{tag}>([^<]*)</{tag}>", 1)
    return table(spark, sf, "pages").select("page_id", T.same_title(part("title"), part("h1")).alias("same"))


@query("""
    SELECT c_custkey, 'https://s.org/?x=1' || CASE c_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN '&as_ylo=' || y || '&as_yhi=' || y ELSE '&as_ylo=' || y || '&as_yhi=' || (y + 3) END || '&q=' || replace(c_name, '#', '%23') || '%26' AS url,
        CASE WHEN c_custkey % 4 = 0 THEN '王' || c_custkey WHEN c_custkey % 4 = 1 THEN 'N' ELSE 'N F' || c_custkey END AS name FROM (SELECT *, 1990 + c_custkey % 30 AS y FROM customer)""")
def customer_searches(spark, sf):
    """[F-20, F-21, F-22] Search addresses with years, and names in either order."""
    k = F.col("c_custkey")
    low, high = (1990 + k % 30).cast("string"), (1993 + k % 30).cast("string")
    years = F.when(k % 3 == 0, "").when(k % 3 == 1, low).otherwise(F.concat(low, F.when(k % 2 == 0, "~").otherwise("至"), high))
    given, family = F.when(k % 4 == 0, text("c_custkey")).otherwise("N"), F.when(k % 4 == 0, "王").when(k % 4 == 1, F.lit(None)).otherwise(F.concat(F.lit("F"), text("c_custkey")))
    return table(spark, sf, "customer").select("c_custkey", T.search_url("https://s.org/?x=1", F.concat("c_name", F.lit("&")), years).alias("url"), T.person_name(given, family).alias("name"))


@query("""
    SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_size::DOUBLE END AS value, (p_partkey % 1000)::DOUBLE AS most, (p_partkey % 4, p_size % 5, p_partkey % 7) > (p_size % 4, p_partkey % 5, p_size % 7) AS newer,
        CASE WHEN p_size % 6 = 5 THEN 'other' ELSE substr('ABCDE', (p_size % 6)::INT + 1, 1) END AS tier, p_partkey % 3 = 0 AS allowed FROM part""")
def part_specs(spark, sf):
    """[F-25, F-34, F-44, P-15] Limits, versions, tiers of sources and paths of parts."""
    k, size = F.col("p_partkey"), F.col("p_size")
    limit = F.concat(F.lit("max "), (k % 1000).cast("string"))
    value, most = T.limit_spec(F.when(k % 2 == 0, F.concat(text("p_size"), F.lit(" / "), limit)).otherwise(limit))
    version = lambda *parts: F.concat_ws(".", *[p.cast("string") for p in parts])
    tier = F.concat(F.lit("Tier "), F.substring(F.lit("ABCDEF"), (size % 6).cast("int") + 1, F.lit(1)))
    path = F.concat(F.when(k % 3 == 0, "/data/in/").when(k % 3 == 1, "/data/in/../").otherwise("/data/inner/"), text("p_partkey"))
    return table(spark, sf, "part").select(
        "p_partkey", value.alias("value"), most.alias("most"), T.newer(F.concat(F.lit("v"), version(k % 4, size % 5, k % 7)), version(size % 4, k % 5, size % 7)).alias("newer"), T.source_tier(tier).alias("tier"), T.path_allowed(path, ["/data/in"]).alias("allowed")
    )


# --- snapshots ---


@query("""
    WITH o AS (SELECT user_id AS path, count(*) AS size, md5(string_agg(event_type, ',' ORDER BY event_id)) AS digest FROM events WHERE event_id % 2 = 0 AND user_id % 9 <> 0 GROUP BY 1),
    n AS (SELECT user_id AS path, count(*) AS size, md5(string_agg(event_type, ',' ORDER BY event_id)) AS digest FROM events WHERE (event_id % 2 = 0 OR user_id % 3 = 1) AND user_id % 10 <> 0 GROUP BY 1),
    c AS (SELECT coalesce(o.path, n.path) AS path, CASE WHEN n.path IS NULL THEN 'MISSING' WHEN o.path IS NULL THEN 'NEW' WHEN coalesce(o.path, n.path) % 2 = 0 AND n.size > o.size THEN 'APPENDED' ELSE 'CHANGED' END AS status, o.size AS old_size FROM o FULL JOIN n ON o.path = n.path WHERE o.digest IS DISTINCT FROM n.digest)
    SELECT path, status, CASE WHEN status = 'APPENDED' THEN old_size + 1 END AS read_from FROM c""")
def user_fingerprints(spark, sf):
    """[J-21, W-13] Users' events as files of two snapshots, even users' files being append-only."""
    e, kind = table(spark, sf, "events"), F.when(F.col("path") % 2 == 0, "append").otherwise("file").alias("kind")

    def shot(rows):
        told = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("event_id", "event_type"))), lambda x: x["event_type"]), ",")
        return rows.groupBy(F.col("user_id").alias("path")).agg(F.count("*").alias("size"), F.count("*").alias("lines"), F.md5(told).alias("digest"))

    even, user = F.col("event_id") % 2 == 0, F.col("user_id")
    return C.fingerprint_changes(shot(e.where(even & (user % 9 != 0))), shot(e.where((even | (user % 3 == 1)) & (user % 10 != 0))).select("*", kind))


@query("SELECT l_partkey AS output, string_agg(s, ',' ORDER BY s) AS inputs FROM (SELECT DISTINCT l_partkey, l_suppkey::VARCHAR AS s FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE s_acctbal < 0) GROUP BY 1")
def parts_to_redo(spark, sf):
    """[J-22] Parts that come from a supplier in debt, with these suppliers."""
    changed = table(spark, sf, "supplier").where("s_acctbal < 0").select(F.col("s_suppkey").cast("string").alias("path"))
    return C.propagate(changed, table(spark, sf, "lineitem").select(text("l_suppkey").alias("path"), F.col("l_partkey").alias("output")))


@query("""
    WITH d AS (SELECT DISTINCT l_partkey AS claim, l_linenumber AS page FROM lineitem WHERE l_returnflag = 'A' AND l_partkey % 5 <> 0), u AS (SELECT DISTINCT l_partkey AS claim, l_linenumber AS page FROM lineitem WHERE l_returnflag = 'R' AND l_partkey % 7 <> 0)
    SELECT claim, page, 'declared_not_used' AS finding FROM d WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.claim = d.claim AND u.page = d.page) UNION ALL
    SELECT claim, page, CASE WHEN claim IN (SELECT claim FROM d) THEN 'used_not_declared' ELSE 'unknown_claim' END FROM u WHERE NOT EXISTS (SELECT 1 FROM d WHERE u.claim = d.claim AND u.page = d.page) UNION ALL
    SELECT DISTINCT claim, NULL, 'orphan' FROM d WHERE claim NOT IN (SELECT claim FROM u)""")
def reconciled_parts(spark, sf):
    """[J-23, V-12] Parts as claims: line numbers that one flag declares against those that another uses."""
    l = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("claim"), F.col("l_linenumber").alias("page"), "l_returnflag")
    return C.reconcile(l.where("l_returnflag = 'A' and claim % 5 <> 0"), l.where("l_returnflag = 'R' and claim % 7 <> 0")).select("claim", "page", "finding")


@query("""
    WITH b AS (SELECT s_suppkey AS k, s_nationkey AS n, 'h' || s_suppkey % 7 AS h, 't' || s_suppkey % 5 AS t, min(s_suppkey) OVER (PARTITION BY s_nationkey) AS head FROM supplier),
    kept AS (SELECT *, k <> head AND k % 4 <> 0 AS deleted FROM b WHERE k % 10 <> 0 OR k = head),
    have AS (SELECT k AS head, CASE WHEN n % 2 = 0 THEN (SELECT list(DISTINCT x.t) FROM b x WHERE x.head = kept.k) ELSE [t] END AS tags, h FROM kept WHERE k = head),
    r AS (SELECT k::VARCHAR AS object_id, 'lost_key' AS rule, NULL AS detail FROM b WHERE k NOT IN (SELECT k FROM kept) UNION ALL SELECT k::VARCHAR, 'not_deleted', NULL FROM kept WHERE k <> head AND NOT deleted
        UNION ALL SELECT head::VARCHAR, 'lost_tags', string_agg(DISTINCT b.t, ',' ORDER BY b.t) FROM b JOIN have USING (head) WHERE NOT list_contains(tags, b.t) GROUP BY head
        UNION ALL SELECT head::VARCHAR, 'lost_file_hashes', string_agg(DISTINCT b.h, ',' ORDER BY b.h) FROM b JOIN have USING (head) WHERE b.h <> have.h GROUP BY head)
    SELECT object_id, rule, detail FROM r""")
def supplier_merges(spark, sf):
    """[V-05, A-20] Suppliers of a nation merged into the first one: what was lost on the way."""
    from pyspark.sql import Window

    none = F.array().cast("array<string>").alias("relations")
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_nationkey").alias("n"), F.min("s_suppkey").over(Window.partitionBy("s_nationkey")).alias("into"))
    tag, digest = F.concat(F.lit("t"), (F.col("key") % 5).cast("string")), F.concat(F.lit("h"), (F.col("key") % 7).cast("string"))
    before = s.select("key", F.lit(False).alias("deleted"), F.array(digest).alias("file_hashes"), F.array(tag).alias("tags"), none)
    union = s.groupBy("into").agg(F.collect_set(tag).alias("all_tags"))
    tags = F.when((F.col("key") == F.col("into")) & (F.col("n") % 2 == 0), F.col("all_tags")).otherwise(F.array(tag))
    after = s.join(union, "into").where("key % 10 <> 0 or key = into").select("key", ((F.col("key") != F.col("into")) & (F.col("key") % 4 != 0)).alias("deleted"), F.array(digest).alias("file_hashes"), tags.alias("tags"), none)
    return C.merge_violations(before, after, s.select("key", "into"))


@query("""
    SELECT s_nationkey AS doc, 'P' || s_suppkey AS id, CASE WHEN s_suppkey % 4 IN (0, 1) THEN 'new ' || s_suppkey ELSE s_name END AS body, s_suppkey % 4 IN (0, 1) AS changed FROM supplier""")
def supplier_sections(spark, sf):
    """[U-10] Sections that edits name by id or by title, and edits that name none."""
    s = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("doc"), F.concat(F.lit("P"), text("s_suppkey")).alias("id"), F.col("s_name").alias("title"), F.col("s_name").alias("body"), "s_suppkey")
    kind = F.col("s_suppkey") % 4
    named = F.when(kind == 0, F.upper("title")).when(kind == 1, F.concat(F.lit(" "), F.lower("id"), F.lit(" "))).otherwise(F.concat("title", F.lit("?")))
    edits = s.select("doc", named.alias("query"), F.concat(F.lit("new "), text("s_suppkey")).alias("body"))
    return S.replace_section(s.drop("s_suppkey"), edits).select("doc", "id", "body", "changed")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_suppkey % 2 = 0 THEN 'v' || l_suppkey || '/' || l_linenumber END AS value, l_suppkey % 2 = 0 AS hit FROM lineitem")
def cached_lines(spark, sf):
    """[T-04, S-17, F-19] Lines as requests, by the digests of supplier and line number, against a table of results."""
    l = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("s"), F.col("l_linenumber").alias("n"))
    cache = l.where("s % 2 = 0").select("s", "n").distinct().select(F.sha2(F.to_json(F.struct("s", "n")), 256).alias("digest"), F.concat(F.lit("v"), text("s"), F.lit("/"), text("n")).alias("value"))
    return C.cached_results(l, cache, ["s", "n"], "value").select("l_orderkey", "l_linenumber", "value", "hit")


# --- merging and grading ---


@query("""
    SELECT source AS concept, min(doc_id) AS survivor, arg_min(substr(text, 1, 20), doc_id) FILTER (coalesce(substr(text, 1, 20), '') <> '' AND doc_id % 3 <> 0) AS definition, count(*) AS merged,
        (SELECT string_agg(r, ',' ORDER BY o, place) FROM (SELECT r, min(o * 2 + p) AS o, 0 AS place FROM (SELECT doc_id AS o, 0 AS p, 'l' || lang AS r, source AS s FROM documents UNION ALL SELECT doc_id, 1, 'n' || n_chars % 5, source FROM documents) x WHERE x.s = d.source GROUP BY r)) AS relations
    FROM documents d GROUP BY source""")
def merged_concepts(spark, sf):
    """[A-24, A-13] Documents of a source as one concept: the first definition, and all relations in order of appearance."""
    d = table(spark, sf, "documents")
    rows = d.select("source", "doc_id", F.when(F.col("doc_id") % 3 != 0, F.substring("text", 1, 20)).alias("definition"), F.array(F.concat(F.lit("l"), "lang"), F.concat(F.lit("n"), (F.col("n_chars") % 5).cast("string"))).alias("relations"))
    out = L.merge_first(rows, "source", "doc_id", ("definition",), ("relations",))
    return out.select(F.col("source").alias("concept"), "survivor", "definition", "merged", F.array_join("relations", ",").alias("relations"))


@query("""
    WITH d AS (SELECT doc_id, n_chars AS mark, lower(substr(text, 1, 3)) AS title, lang FROM documents), lib AS (SELECT * FROM d WHERE doc_id % 2 = 0), imp AS (SELECT * FROM d WHERE doc_id % 2 = 1),
    a AS (SELECT i.doc_id, min(l.doc_id) AS m FROM imp i JOIN lib l ON i.mark = l.mark GROUP BY 1), b AS (SELECT i.doc_id, min(l.doc_id) AS m FROM imp i JOIN lib l ON i.title = l.title AND i.lang = l.lang GROUP BY 1)
    SELECT i.doc_id AS import_id, coalesce(a.m, b.m) AS matched, CASE WHEN a.m IS NOT NULL THEN 'mark' ELSE 'fallback' END AS by FROM imp i LEFT JOIN a USING (doc_id) LEFT JOIN b USING (doc_id) WHERE coalesce(a.m, b.m) IS NOT NULL""")
def imports_by_priority(spark, sf):
    """[J-28] Odd documents matched with even ones: by their length, else by language and first letters together."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("n_chars").alias("mark"), F.lower(F.substring("text", 1, 3)).alias("title"), "lang")
    return L.match_imports(d.where("id % 2 = 1"), d.where("id % 2 = 0"), ("mark",), ("title", "lang"))


@query("""
    WITH r AS (SELECT event_id, event_type AS t, user_id % 3 AS s, floor(value)::INT AS v FROM events),
    g AS (SELECT event_id, CASE WHEN t = 'view' THEN 'form' WHEN t = 'click' THEN 'extract' WHEN t = 'purchase' THEN 'infeasible' WHEN t = 'signup' THEN 'ambiguous' ELSE 'gate' END AS kind, CASE s WHEN 0 THEN 'success' WHEN 1 THEN 'blocked' ELSE 'infeasible' END AS status,
        CASE WHEN v % 2 = 0 THEN 'ambiguous' ELSE 'login' END AS blocker, v % 4 <> 1 AS verified, CASE WHEN v % 11 = 0 THEN 1 ELSE 0 END AS hits, CASE WHEN v % 5 = 0 THEN 'y' ELSE 'x' END AS state FROM r),
    m AS (SELECT *, CASE kind WHEN 'form' THEN verified WHEN 'extract' THEN verified AND state = 'x' WHEN 'infeasible' THEN status = 'infeasible' WHEN 'ambiguous' THEN status = 'blocked' AND blocker = 'ambiguous' ELSE status = 'blocked' AND blocker = 'login' END AS met, hits = 0 AND NOT (kind = 'gate' AND status = 'success') AS safe FROM g)
    SELECT event_id, met AND safe AS passed, safe, status = 'success' AND NOT met AS false_success FROM m""")
def graded_events(spark, sf):
    """[V-09] Events as runs of tasks, graded by their kind."""
    t, v, s = F.col("event_type"), F.floor("value").cast("int"), F.col("user_id") % 3
    kind = F.when(t == "view", "form").when(t == "click", "extract").when(t == "purchase", "infeasible").when(t == "signup", "ambiguous").otherwise("gate")
    runs = table(spark, sf, "events").select(
        "event_id", kind.alias("kind"), F.when(s == 0, "success").when(s == 1, "blocked").otherwise("infeasible").alias("status"), F.when(v % 2 == 0, "ambiguous").otherwise("login").alias("blocker"), F.lit("login").alias("gate"), (v % 4 != 1).alias("verified"),
        F.when(v % 11 == 0, 1).otherwise(0).alias("honeypot_hits"), F.when(v % 5 == 0, "y").otherwise("x").alias("state"), F.lit(1).alias("units"), F.lit("x").alias("want_state"), F.lit(1).alias("want_units"),
    )
    return V.grade(runs).select("event_id", "passed", "safe", "false_success")


@query("""
    WITH t AS (SELECT l_orderkey, min(l_partkey) AS target FROM lineitem GROUP BY 1)
    SELECT 'o' || l_orderkey AS id, arg_min(l_returnflag, struct_pack(n := l_linenumber, f := l_returnflag, q := l_quantity::INT::VARCHAR)) AS want_state, arg_min(l_quantity, struct_pack(n := l_linenumber, f := l_returnflag, q := l_quantity::INT::VARCHAR))::INT AS want_units FROM lineitem JOIN t USING (l_orderkey) WHERE l_partkey = target GROUP BY l_orderkey""")
def expected_lines(spark, sf):
    """[J-26] Orders as extraction tasks: the first line with the smallest part is what must be found."""
    row = F.struct(F.col("l_linenumber").alias("n"), F.array(text("l_partkey"), F.col("l_returnflag"), F.col("l_quantity").cast("int").cast("string")).alias("cells"))
    tasks = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.transform(F.sort_array(F.collect_list(row)), lambda x: x["cells"]).alias("rows"), F.min("l_partkey").cast("string").alias("target"))
    return V.expected_rows(tasks.select(F.concat(F.lit("o"), text("l_orderkey")).alias("id"), F.lit("extract").alias("kind"), F.to_json(F.struct("rows", "target")).alias("data")))
