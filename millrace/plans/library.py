"""Queries over documents as a library of books: passages, excerpts, chapters and their rules, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.udfs import comparable
from ..operators import blocks as B
from ..operators import evals as V
from ..operators import evidence as E
from ..operators import linkage as L
from ..operators import passages as P
from ..operators import ranking as R
from ..operators import screening as S
from ..operators import similarity as J
from ..sources import markup, ranges, table_functions
from .documents import CJK, LINES, NORM, docs, lines, table

#: The same class in SQL.
SENTENCE_ENDS = B._ENDS.replace("'", "''")
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


# --- passages ---

# Comparable forms, as the given texts need them: no compatibility characters stand in them, and of the others only ß folds to two letters.
_FOLD = "regexp_replace(replace(lower({0}), 'ß', 'ss'), '\\s+', '', 'g')"
_JOINED = "regexp_replace({0}, '([\\p{{L}}])-[ \\t]*\\r?\\n\\s*([\\p{{L}}])', '\\1\\2', 'g')"
_PAGES = f"SELECT doc_id, pos, line, coalesce(lead(line) OVER (PARTITION BY doc_id ORDER BY pos), '') AS following FROM ({LINES})"
_HAYS = f"""SELECT doc_id, pos, unnest([{_FOLD.format(_JOINED.format("line || CASE WHEN following <> '' THEN chr(10) || following ELSE '' END"))}, {_FOLD.format("line || CASE WHEN following <> '' THEN chr(10) || following ELSE '' END")}]) AS hay,
    greatest(length({_FOLD.format('line')}), length({_FOLD.format(_JOINED.format('line'))})) AS ends FROM ({_PAGES})"""


def pages(spark, sf):
    """Each line of a document as a page, with the next one."""
    parts = F.split(F.coalesce("text", F.lit("")), "\n")
    page = lambda line, at: F.struct(at.alias("page"), line.alias("text"), F.get("_lines", at + 1).alias("following"))
    return docs(spark, sf).select(F.col("doc_id").alias("source"), parts.alias("_lines")).select("source", F.inline(F.transform("_lines", page)))


@query(f"""
    WITH l AS (SELECT item_id, pos, parts[pos] AS a, parts[pos + 1] AS b FROM (SELECT item_id, string_split(text, chr(10)) AS parts, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS pos FROM benchmark)),
    e AS (SELECT item_id, pos - 1 AS pos, [x for x in [{_FOLD.format("coalesce(a, '')")}, {_FOLD.format("coalesce(b, '')")}] if x <> ''] AS pieces FROM l),
    ok AS (SELECT * FROM e WHERE len(pieces) > 0 AND list_min(list_transform(pieces, lambda x: length(x))) >= 8)
    SELECT DISTINCT item_id, e.pos::INT AS pos, doc_id AS source, h.pos::INT AS page FROM ok e JOIN ({_HAYS}) h ON strpos(hay, pieces[1]) BETWEEN 1 AND ends
        AND (len(pieces) = 1 OR strpos(substr(hay, strpos(hay, pieces[1]) + length(pieces[1])), pieces[2]) > 0)""")
def located_passages(spark, sf):
    """[F-09, J-14, F-08] Every page on which two lines of the benchmark that follow each other, parted by an ellipsis, stand in their order."""
    split = table(spark, sf, "benchmark").select("item_id", F.split("text", "\n").alias("parts"))
    wanted = split.select("item_id", F.posexplode("parts").alias("pos", "a"), "parts").select("item_id", "pos", F.concat_ws(" … ", "a", F.get("parts", F.col("pos") + 1)).alias("excerpt"))
    return P.located_excerpts(wanted, pages(spark, sf)).join(wanted, "excerpt").select("item_id", "pos", "source", "page")


@query(f"""
    WITH p AS ({_PAGES}), refs AS (
        SELECT doc_id, pos, 'own' AS kind, pos AS page, substr(line, 1, 20) AS a, substr(line, 31, 20) AS b FROM p UNION ALL
        SELECT doc_id, pos, 'over', pos, right(line, 20), substr(following, 1, 20) FROM p UNION ALL
        SELECT doc_id, pos, 'before', pos - 1, substr(line, 1, 20), substr(line, 31, 20) FROM p UNION ALL
        SELECT doc_id, pos, 'turned', pos, substr(line, 31, 20), substr(line, 1, 20) FROM p),
    folded AS (SELECT doc_id, pos, kind, page, [x for x in [{_FOLD.format('a')}, {_FOLD.format('b')}] if x <> ''] AS pieces FROM refs),
    found AS (SELECT r.doc_id, r.pos, r.kind, bool_or(len(pieces) > 0 AND list_min(list_transform(pieces, lambda x: length(x))) >= 8 AND strpos(hay, pieces[1]) BETWEEN 1 AND ends
            AND (len(pieces) = 1 OR strpos(substr(hay, strpos(hay, pieces[1]) + length(pieces[1])), pieces[2]) > 0)) AS verified
        FROM folded r LEFT JOIN ({_HAYS}) h ON h.doc_id = r.doc_id AND h.pos = r.page GROUP BY ALL)
    SELECT doc_id, kind, count(*) AS n, count(*) FILTER (verified) AS n_verified FROM found GROUP BY ALL""")
def cited_excerpts(spark, sf):
    """[F-09, J-14] Excerpts of every line that cite it, run on into the next one, cite the one before or turn the order round: how many are verified."""
    p = pages(spark, sf)

    def ref(kind: str, page, a, b):
        return F.struct(page.alias("page"), F.concat_ws("…", a, b).alias("excerpt"), F.lit(kind).alias("kind"))

    own, first, later = F.col("page"), F.substring("text", 1, 20), F.substring("text", 31, 20)
    following = F.substring(F.coalesce("following", F.lit("")), 1, 20)
    refs = F.array(ref("own", own, first, later), ref("over", own, F.right("text", F.lit(20)), following), ref("before", own - 1, first, later), ref("turned", own, later, first))
    cited = p.select("source", F.inline(refs))
    out = E.verified_excerpts(cited, p.drop("following"))
    return out.groupBy(F.col("source").alias("doc_id"), "kind").agg(F.count("*").alias("n"), F.count_if("verified").alias("n_verified"))


# --- picks ---

_HITS = """SELECT 's' || coalesce(source, '') AS query, doc_id, n_chars FROM documents UNION ALL SELECT 'l' || coalesce(lang, ''), doc_id, n_chars FROM documents UNION ALL
    SELECT 'w' || lower(substr(text, 1, 2)), doc_id, n_chars FROM documents WHERE text <> ''"""


@query(f"""
    WITH RECURSIVE ranked AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM documents), hits AS (SELECT query, doc_id, rank FROM ({_HITS}) JOIN ranked USING (doc_id)),
    lists AS (SELECT query, dense_rank() OVER (ORDER BY query) AS turn, list(doc_id ORDER BY rank) AS ids FROM hits GROUP BY query),
    picked AS (SELECT 0::BIGINT AS turn, []::BIGINT[] AS taken, NULL::VARCHAR AS query, NULL::BIGINT AS id
        UNION ALL SELECT l.turn, CASE WHEN c IS NULL THEN taken ELSE list_append(taken, c) END, l.query, c FROM (SELECT p.taken, l.turn, l.query, list_filter(l.ids, lambda x: NOT list_contains(p.taken, x))[1] AS c FROM picked p JOIN lists l ON l.turn = p.turn + 1) l),
    first AS (SELECT 0 AS fill, turn AS place, id, query FROM picked WHERE id IS NOT NULL), every AS (SELECT * FROM first UNION ALL SELECT 1, rank, doc_id, NULL FROM ranked WHERE doc_id NOT IN (SELECT id FROM first))
    SELECT row_number() OVER (ORDER BY fill, place, id) AS pick, id, query FROM every QUALIFY pick <= 500""")
def representative_documents(spark, sf):
    """[W-03] For each source, language and pair of first letters the longest document that none before it has, then the longest of all: a
    report of 500."""
    d = docs(spark, sf)
    ranked = R.global_rank(d.select("doc_id", "n_chars"), "n_chars", "doc_id").select("doc_id", "rank")
    named = lambda letter, c: d.select(F.concat(F.lit(letter), F.coalesce(c, F.lit(""))).alias("query"), "doc_id")
    hits = named("s", F.col("source")).union(named("l", F.col("lang"))).union(d.where("text <> ''").select(F.concat(F.lit("w"), F.lower(F.substring("text", 1, 2))).alias("query"), "doc_id"))
    return R.representatives(hits.join(ranked, "doc_id"), 500, order="query", key="doc_id")


# --- parsers as table functions ---

# Lines of documents as a notation: by their length fences, headings and list items.
_NOTES = f"""SELECT doc_id, pos, CASE WHEN length(line) % 7 = 3 THEN '```' || substr(line, 1, 4) WHEN length(line) % 5 = 1 THEN '## ' || substr(line, 1, 20)
    WHEN length(line) % 3 = 0 THEN repeat(' ', (length(line) % 11)::INT) || '- ' || line ELSE line END AS line FROM ({LINES})"""


def notes(spark, sf):
    n, c = F.length("line"), F.col("line")
    item = F.concat(F.repeat(F.lit(" "), (n % 11).cast("int")), F.lit("- "), c)
    line = F.when(n % 7 == 3, F.concat(F.lit("```"), F.substring(c, 1, 4))).when(n % 5 == 1, F.concat(F.lit("## "), F.substring(c, 1, 20))).when(n % 3 == 0, item).otherwise(c)
    return lines(spark, sf).select(F.col("doc_id").alias("key"), "pos", line.alias("line"))


@query(f"""
    WITH l AS ({_NOTES}), f AS (SELECT *, starts_with(line, '```') AS tick, sum(starts_with(line, '```')::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS n FROM l),
    h AS (SELECT *, NOT tick AND n % 2 = 0 AND starts_with(line, '## ') AND trim(substr(line, 4)) <> '' AS head FROM f), p AS (SELECT *, sum(head::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS panel FROM h),
    sizes AS (SELECT doc_id, n, count(*) FILTER (NOT tick) AS held, max(n) OVER (PARTITION BY doc_id) AS last FROM p GROUP BY doc_id, n)
    SELECT doc_id AS key, pos::INT AS pos, 'heading' AS kind, panel::INT AS panel, 0 AS n_lines, trim(substr(line, 4)) AS detail FROM p WHERE head UNION ALL
    SELECT p.doc_id, pos, CASE WHEN p.n = s.last THEN 'open' ELSE 'fence' END, panel::INT, held::INT, trim(substr(line, 4)) FROM p JOIN sizes s ON s.doc_id = p.doc_id AND s.n = p.n WHERE tick AND p.n % 2 = 1""")
def document_blocks(spark, sf):
    """[S-22, X-04] Headings and fences of all documents by a parser that SQL calls as a table function."""
    table_functions.register(spark)
    notes(spark, sf).createOrReplaceTempView("millrace_notes")
    return spark.sql("SELECT * FROM document_blocks(TABLE(millrace_notes))")


@query(f"""
    WITH i AS (SELECT doc_id, pos, length(line) - length(ltrim(line, ' ')) AS indent FROM ({_NOTES}) WHERE starts_with(ltrim(line, ' '), '- ') OR starts_with(ltrim(line, ' '), '* ')),
    p AS (SELECT a.doc_id, a.pos, max(b.pos) AS parent FROM i a LEFT JOIN i b ON b.doc_id = a.doc_id AND b.pos < a.pos AND b.indent < a.indent
        AND NOT EXISTS (SELECT 1 FROM i c WHERE c.doc_id = a.doc_id AND c.pos > b.pos AND c.pos < a.pos AND c.indent <= b.indent) GROUP BY ALL),
    d AS (SELECT a.doc_id, a.pos, count(b.pos) AS depth FROM i a LEFT JOIN i b ON b.doc_id = a.doc_id AND b.pos < a.pos AND b.indent < a.indent
        AND NOT EXISTS (SELECT 1 FROM i c WHERE c.doc_id = a.doc_id AND c.pos > b.pos AND c.pos < a.pos AND c.indent <= b.indent) GROUP BY ALL)
    SELECT doc_id AS key, pos::INT AS pos, parent::INT AS parent, depth::INT AS depth FROM p JOIN d USING (doc_id, pos)""")
def list_parents(spark, sf):
    """[W-07, X-04] List items of all documents and what they belong to, by a table function that holds the open items only."""
    table_functions.register(spark)
    notes(spark, sf).createOrReplaceTempView("millrace_notes")
    return spark.sql("SELECT * FROM list_parents(TABLE(millrace_notes))")


@query(f"""
    SELECT doc_id, pos::INT AS pos, 'C' || pos AS claim, 'S' || (doc_id % 9) || ',S' || pos AS sources, CASE WHEN pos % 3 = 0 THEN 'high' ELSE lower(coalesce(nullif(trim(substr(line, 1, 5), ' '), ''), 'high')) END AS confidence, 'P' || (pos % 4) AS used
    FROM (SELECT doc_id, pos, replace(line, '|', '/') AS line FROM ({LINES}))""")
def ledger_of_lines(spark, sf):
    """[S-25] A ledger of claims, one for each line of a document, with escaped bars in its cells."""
    line, pos = F.translate("line", "|", "/"), F.col("pos").cast("string")
    told = F.when(F.col("pos") % 3 == 0, "").otherwise(F.substring(line, 1, 5))
    row = F.concat(F.lit("| C"), pos, F.lit(" | a \\| b | "), F.substring(line, 6, 9), F.lit(" | S"), (F.col("doc_id") % 9).cast("string"), F.lit(", S"), pos, F.lit(" | "), told, F.lit(" | x | P"), (F.col("pos") % 4).cast("string"), F.lit(" |"))
    rows = markup.ledger_claims(lines(spark, sf).select("doc_id", "pos", row.alias("line")), keep=("doc_id", "pos"))
    return rows.select("doc_id", "pos", "claim", F.array_join("sources", ",").alias("sources"), "confidence", F.array_join("used", ",").alias("used"))


# --- openings: the first lines of all documents ---

_OPENINGS = f"""strings AS (SELECT min(doc_id) AS sid, s, length(s) AS n, count(*) AS members FROM (SELECT doc_id, {NORM.format("string_split(coalesce(text, ''), chr(10))[1]")} AS s FROM documents) GROUP BY s),
    grams AS (SELECT sid, n, substr(s, i, 3) AS g, row_number() OVER (PARTITION BY sid, substr(s, i, 3) ORDER BY i) AS occ FROM (SELECT sid, n, s, unnest(range(1, n - 1)) AS i FROM strings WHERE n >= 3)),
    near AS (SELECT x.sid AS a, y.sid AS b, least(x.n, y.n) AS m, greatest(x.n, y.n) AS n, (90 * (x.n + y.n) + 199) // 200 AS h FROM strings x JOIN strings y ON x.sid < y.sid WHERE (90 * (x.n + y.n) + 199) // 200 <= least(x.n, y.n)),
    shared AS (SELECT x.sid AS a, y.sid AS b, count(*) AS overlap FROM grams x JOIN grams y ON x.g = y.g AND x.occ = y.occ AND x.sid < y.sid AND (90 * (x.n + y.n) + 199) // 200 <= least(x.n, y.n) GROUP BY 1, 2),
    passed AS (SELECT a, b, m, n, h, greatest(0, h - 2 * (m + n - 2 * h + 1)) AS bound, coalesce(overlap, 0) AS overlap FROM near LEFT JOIN shared USING (a, b))"""


def openings(spark, sf):
    return docs(spark, sf).select("doc_id", T.normalized(F.get(F.split(F.coalesce("text", F.lit("")), "\n"), F.lit(0))).alias("s"))


@query(f"WITH {_OPENINGS} SELECT a, b, m::INT AS m, n::INT AS n, h::INT AS h, bound::INT AS bound, overlap::INT AS overlap FROM passed WHERE overlap >= bound AND bound > 0")
def opening_overlaps(spark, sf):
    """[J-02, J-03, J-04, F-15, F-16, F-17, W-02] Pairs of first lines that pass the bound on shared 3-grams."""
    return J.overlap_pairs(J.distinct_strings(openings(spark, sf), "doc_id")).where("bound > 0")


@query(f"""
    WITH strings AS (SELECT min(doc_id * 1000000 + pos) AS sid, s, length(s) AS n FROM (SELECT doc_id, pos, substr({NORM.format('line')}, 1, 2) AS s FROM ({LINES})) GROUP BY s),
    chars AS (SELECT sid, substr(s, i, 1) AS c, row_number() OVER (PARTITION BY sid, substr(s, i, 1) ORDER BY i) AS occ FROM (SELECT sid, s, unnest(range(1, n + 1)) AS i FROM strings)),
    near AS (SELECT x.sid AS a, y.sid AS b, (90 * (x.n + y.n) + 199) // 200 AS h FROM strings x JOIN strings y ON x.sid < y.sid WHERE (90 * (x.n + y.n) + 199) // 200 BETWEEN 1 AND least(x.n, y.n)),
    common AS (SELECT a, b, h, count(*) AS shared_chars FROM near JOIN chars x ON x.sid = a JOIN chars y ON y.sid = b AND x.c = y.c AND x.occ = y.occ GROUP BY ALL)
    SELECT a, b, h::INT AS h, shared_chars::INT AS shared_chars FROM common WHERE shared_chars >= h""")
def short_pairs(spark, sf):
    """[J-05, J-06] Pairs of the first two letters of all lines, too short for a bound on grams: they meet over their characters."""
    items = lines(spark, sf).select((F.col("doc_id") * 1000000 + F.col("pos")).alias("id"), F.substring(T.normalized(F.col("line")), 1, 2).alias("s"))
    strings = J.distinct_strings(items)
    return J.character_pairs(J.overlap_pairs(strings).where("bound = 0"), strings).select("a", "b", "h", "shared_chars")


@query()
def opening_ratios(spark, sf):
    """[J-01, F-18] Pairs of first lines as similar as 0.9 in either order."""
    out = J.ratio_classes(openings(spark, sf), key="doc_id")
    scaled = lambda c: F.floor(F.col(c) * 1_000_000).alias(c + "_ppm")
    return out.select("a", "b", scaled("ratio_ab"), scaled("ratio_ba"), "members_a", "members_b")


# --- books: documents as streams of lines with a geometry that follows from place and length ---

_BOX = f"""SELECT doc_id, pos, line AS text, 10 + CASE WHEN length(line) % 6 = 0 THEN 4 ELSE 0 END AS size, CASE WHEN length(line) % 3 = 0 THEN 20 ELSE 0 END AS x0, pos * 12 + pos // 5 * 10 AS y0 FROM ({LINES})"""


def boxes(spark, sf):
    n = F.length("line")
    y0 = (F.col("pos") * 12 + F.floor(F.col("pos") / 5) * 10).cast("double")
    return lines(spark, sf).select(
        F.col("doc_id").alias("block"), F.col("pos").alias("line"), F.col("line").alias("text"), F.when(n % 6 == 0, 14.0).otherwise(10.0).alias("size"), F.when(n % 3 == 0, 20.0).otherwise(0.0).alias("x0"), y0.alias("y0"), (y0 + 10).alias("y1")
    )


@query(f"""
    WITH b AS ({_BOX}), e AS (SELECT doc_id, list_sort(list(x0))[count(*) // 4 + 1] AS edge FROM b GROUP BY 1),
    p AS (SELECT b.*, edge, lag(text) OVER w AS before, lag(y0) OVER w + 10 AS above, lag(size) OVER w AS was FROM b JOIN e USING (doc_id) WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
    n AS (SELECT *, coalesce(before IS NULL OR y0 - above > 8 OR abs(size - was) > 1 OR (x0 - edge > 9 AND (regexp_matches(before, '[{SENTENCE_ENDS}]$') OR regexp_matches(text, '^{CJK}'))), false) AS new FROM p)
    SELECT doc_id, pos::INT AS pos, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY pos)::BIGINT AS para FROM n""")
def line_paragraphs(spark, sf):
    """[W-04] Lines of all documents as paragraphs, by gaps, sizes and indents."""
    return B.paragraph_groups(boxes(spark, sf)).select(F.col("block").alias("doc_id"), F.col("line").alias("pos"), "para")


_CONTENTS = """toc AS (SELECT doc_id AS ord, coalesce(lang, '') AS book, 1 + doc_id % 3 AS level, substr(coalesce(text, ''), 1, 12) AS title, doc_id // 2 AS doc, 'f' || (doc_id % 4) AS fragment FROM documents),
    anchors AS (SELECT doc_id AS doc, 'f' || (n_chars % 4) AS fragment, doc_id // 3 * 10 + 3 AS pos FROM documents UNION ALL SELECT doc_id, '', doc_id // 3 * 10 + 1 FROM documents WHERE doc_id % 3 = 0),
    starts AS (SELECT doc_id AS doc, doc_id // 3 * 10 AS pos FROM documents WHERE doc_id % 5 <> 0),
    located AS (SELECT t.*, coalesce(a.pos, b.pos, s.pos) AS pos FROM toc t LEFT JOIN anchors a ON a.doc = t.doc AND a.fragment = t.fragment LEFT JOIN anchors b ON b.doc = t.doc AND b.fragment = '' LEFT JOIN starts s ON s.doc = t.doc WHERE coalesce(a.pos, b.pos, s.pos) IS NOT NULL),
    tops AS (SELECT book, pos, min(level) AS level FROM located GROUP BY ALL), upto AS (SELECT book, level, (SELECT count(*) FROM tops u WHERE u.book = t.book AND u.level <= t.level) AS n FROM (SELECT DISTINCT book, level FROM tops) t),
    best AS (SELECT l.book, coalesce(min(u.level), max(l.level)) AS best FROM located l LEFT JOIN upto u ON u.book = l.book AND u.n >= 2 GROUP BY l.book)"""


def contents(spark, sf):
    """Entries of a table of contents for each language, with the places where they stand."""
    d = docs(spark, sf)
    pos, name = F.floor(F.col("doc_id") / 3) * 10, lambda n: F.concat(F.lit("f"), (n % 4).cast("string"))
    toc = d.select(F.col("doc_id").alias("ord"), F.coalesce("lang", F.lit("")).alias("book"), (F.col("doc_id") % 3 + 1).alias("level"), F.substring(F.coalesce("text", F.lit("")), 1, 12).alias("title"), F.floor(F.col("doc_id") / 2).alias("doc"), name(F.col("doc_id")).alias("fragment"))
    anchors = d.select(F.col("doc_id").alias("doc"), name(F.col("n_chars")).alias("fragment"), (pos + 3).alias("pos")).union(d.where("doc_id % 3 = 0").select("doc_id", F.lit(""), pos + 1))
    located = B.toc_positions(toc.drop("book"), anchors, d.where("doc_id % 5 <> 0").select(F.col("doc_id").alias("doc"), pos.alias("pos")))
    return located.join(toc.select("ord", "book"), "ord")


@query(f"WITH {_CONTENTS} SELECT ord, book, level, doc, fragment, pos FROM located")
def contents_positions(spark, sf):
    """[J-18] Where entries stand: at their fragment, else at their document's anchor, else at its start."""
    return contents(spark, sf).select("ord", "book", "level", "doc", "fragment", "pos")


@query(f"WITH {_CONTENTS} SELECT book, best FROM best")
def contents_best_levels(spark, sf):
    """[A-27] The shallowest level that cuts each book in two places."""
    return B.toc_level(contents(spark, sf))


@query(f"WITH {_CONTENTS} SELECT l.book, pos, arg_min(title, struct_pack(level := level, ord := ord)) AS title FROM located l JOIN best b ON b.book = l.book WHERE level <= best GROUP BY l.book, pos")
def contents_chapters(spark, sf):
    """[W-12] The places where chapters begin; of several entries in one place the outermost counts."""
    return B.toc_cuts(contents(spark, sf))


@query(f"""
    WITH l AS (SELECT doc_id, pos, CASE WHEN length(line) % 4 = 0 AND doc_id % 3 = 0 THEN 'Chapter ' || (pos + 1) ELSE line END AS title, 10 + length(line) % 4 * 2 AS size, length(line) % 4 < 3 AS head, count(*) OVER (PARTITION BY doc_id) AS length FROM ({LINES})),
    h AS (SELECT *, dense_rank() OVER (PARTITION BY doc_id ORDER BY size DESC) AS tier FROM l WHERE head),
    every AS (SELECT doc_id, 0 AS depth, pos, title, length FROM h WHERE regexp_matches(title, '(?i)^((chapter|part)\\s+[0-9ivxlc]+([^a-z]|$)|第[一二三四五六七八九十百零0-9]+[章部篇])')
        UNION ALL SELECT h.doc_id, d.tier, h.pos, h.title, h.length FROM h JOIN (SELECT DISTINCT doc_id, tier FROM h) d ON d.doc_id = h.doc_id AND h.tier <= d.tier),
    gaps AS (SELECT *, coalesce(lead(pos) OVER (PARTITION BY doc_id, depth ORDER BY pos), length) - pos AS gap FROM every),
    judged AS (SELECT doc_id, depth, max(gap) <= 0.5 * max(length) AS even FROM gaps GROUP BY ALL HAVING count(*) >= 3 AND (depth = 0 OR count(*) <= 80)),
    chosen AS (SELECT doc_id, coalesce(min(depth) FILTER (even), min(depth) FILTER (depth > 0)) AS depth FROM judged GROUP BY 1)
    SELECT e.doc_id, e.pos::INT AS pos, e.title FROM every e JOIN chosen c ON c.doc_id = e.doc_id AND c.depth = e.depth""")
def chapters_by_size(spark, sf):
    """[W-19, W-11] Chapters of documents without a table of contents: by their names, else by the largest headings that are enough."""
    n = F.length("line")
    title = F.when((n % 4 == 0) & (F.col("doc_id") % 3 == 0), F.concat(F.lit("Chapter "), (F.col("pos") + 1).cast("string"))).otherwise(F.col("line"))
    rows = lines(spark, sf).select(F.col("doc_id").alias("book"), "pos", F.when(n % 4 < 3, "heading").otherwise("para").alias("kind"), title.alias("text"), (10 + n % 4 * 2).cast("double").alias("size"))
    out = B.heading_tiers(rows, rows.groupBy("book").agg(F.count("*").alias("length")))
    return out.select(F.col("book").alias("doc_id"), "pos", "title")


# --- quotes, decisions, briefs ---


@query(f"""
    WITH l AS (SELECT doc_id, pos, regexp_replace(line, '\\s+', '', 'g') AS squashed, line, count(*) OVER (PARTITION BY doc_id) AS n FROM ({LINES})),
    notes AS (SELECT doc_id, pos, CASE pos % 5 WHEN 0 THEN pos WHEN 1 THEN pos - 1 WHEN 2 THEN n + pos WHEN 3 THEN pos + 1 ELSE pos END AS told, CASE WHEN pos % 5 = 4 THEN reverse(substr(line, 1, 25)) WHEN pos % 7 = 6 THEN substr(line, 1, 3) ELSE substr(line, 4, 22) END AS quote, n FROM l),
    q AS (SELECT *, regexp_replace(quote, '\\s+', '', 'g') AS wanted FROM notes),
    hits AS (SELECT q.doc_id, q.pos, min(l.pos) AS first, bool_or(l.pos = q.told) AS here FROM q JOIN l ON l.doc_id = q.doc_id AND contains(l.squashed, q.wanted) WHERE q.wanted <> '' GROUP BY 1, 2),
    s AS (SELECT q.doc_id, q.pos, q.told, first, CASE WHEN q.told < 0 OR q.told >= n THEN 'out_of_range' WHEN length(wanted) < 4 THEN 'too_short' WHEN here THEN 'ok' WHEN first IS NOT NULL THEN 'moved' ELSE 'absent' END AS status FROM q LEFT JOIN hits h ON h.doc_id = q.doc_id AND h.pos = q.pos)
    SELECT doc_id, pos::INT AS pos, status, CASE status WHEN 'ok' THEN told WHEN 'moved' THEN first END::BIGINT AS anchor FROM s""")
def quote_statuses(spark, sf):
    """[J-15, V-06] Quotes from all lines of all documents, at their line, beside it, beyond the end, too short or made up: their status and anchor."""
    w = Window.partitionBy("doc_id")
    l = lines(spark, sf).withColumn("n", F.count("*").over(w))
    pos, kind = F.col("pos"), F.col("pos") % 5
    at = F.when(kind == 1, pos - 1).when(kind == 2, F.col("n") + pos).when(kind == 3, pos + 1).otherwise(pos).cast("long")
    quote = F.when(kind == 4, F.reverse(F.substring("line", 1, 25))).when(pos % 7 == 6, F.substring("line", 1, 3)).otherwise(F.substring("line", 4, 22))
    notes = l.select((F.col("doc_id") * 1000000 + pos).alias("quote_id"), F.lit("all").alias("book"), F.col("doc_id").alias("chapter"), at.alias("at"), quote.alias("quote"), "pos")
    paras = l.select(F.lit("all").alias("book"), F.col("doc_id").alias("chapter"), F.col("pos").cast("long").alias("para"), F.col("line").alias("text"))
    return E.quote_anchors(notes, paras).select(F.col("chapter").alias("doc_id"), "pos", "status", "anchor")


@query("""
    WITH u AS (SELECT doc_id + CASE WHEN doc_id % 13 = 0 THEN 1000000000 ELSE 0 END AS id, CASE WHEN quality = 1 THEN 'included' ELSE 'excluded' END AS grp, CASE WHEN doc_id % 17 = 0 THEN ' ' ELSE 'r' END AS reason FROM labels
        UNION ALL SELECT doc_id, 'excluded', 'again' FROM labels WHERE toxic = 1),
    known AS (SELECT DISTINCT doc_id AS id FROM documents), imported AS (SELECT DISTINCT doc_id AS id FROM documents WHERE source = 'src3'), prior AS (SELECT doc_id AS id, CASE WHEN doc_id % 4 = 0 THEN 'included' ELSE 'excluded' END AS grp FROM documents),
    found AS (SELECT id, 'unknown_id' AS rule FROM u WHERE id NOT IN (SELECT id FROM known) UNION ALL SELECT id, 'decided_twice' FROM u GROUP BY id HAVING count(*) > 1 UNION ALL SELECT id, 'no_reason' FROM u WHERE trim(reason) = ''
        UNION ALL SELECT id, 'imported_removed' FROM u WHERE grp <> 'included' AND id IN (SELECT id FROM imported)
        UNION ALL SELECT id, 'inclusion_dropped' FROM prior WHERE grp = 'included' AND id IN (SELECT id FROM u) AND id NOT IN (SELECT id FROM u WHERE grp = 'included'))
    SELECT id::VARCHAR AS object_id, rule FROM found""")
def decision_checks(spark, sf):
    """[V-14, U-04] Labels as decisions on documents, some of them unknown, twice or without a reason."""
    labels, d = table(spark, sf, "labels"), docs(spark, sf)
    i = F.col("doc_id")
    updates = labels.select(F.when(i % 13 == 0, i + 1_000_000_000).otherwise(i).alias("id"), F.when(F.col("quality") == 1, "included").otherwise("excluded").alias("group"), F.when(i % 17 == 0, " ").otherwise("r").alias("reason"))
    updates = updates.union(labels.where("toxic = 1").select("doc_id", F.lit("excluded"), F.lit("again")))
    prior = d.select(i.alias("id"), F.when(i % 4 == 0, "included").otherwise("excluded").alias("group"))
    return S.decision_violations(updates, d.select(i.alias("id")), d.where("source = 'src3'").select(i.alias("id")), prior).select("object_id", "rule")


@query("""
    WITH p AS (SELECT page_id, url, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host FROM pages)
    SELECT page_id, coalesce(scheme IN ('http', 'https') AND NOT contains(host, '@') AND ends_with(host, '.example.org') AND substr(host, 1, length(host) - 12) IN (SELECT DISTINCT substr(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1), 1, length(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) - 12) FROM pages WHERE page_id % 2 = 0 AND contains(url, '.example.org')), false) AS allowed FROM p""")
def page_hosts_allowed(spark, sf):
    """[P-14] Pages whose host is on a list: the hosts in one domain of every other page, as a table that is joined."""
    p = table(spark, sf, "pages").select("page_id", "url")
    part = lambda name: F.try_parse_url("url", F.lit(name))
    listed = p.where("page_id % 2 = 0").select(F.lower(part("HOST")).alias("host")).where("host like '%.example.org'").distinct().withColumn("listed", F.lit(True))
    rows = p.withColumns({"host": F.lower(part("HOST")), "plain": T.url_plain(F.col("url"))}).join(listed, "host", "left")
    return rows.select("page_id", F.coalesce(F.col("plain") & F.col("listed"), F.lit(False)).alias("allowed"))


@query(f"SELECT doc_id, pos::INT AS pos, sha256({_FOLD.format('line')}) AS comparable FROM ({LINES})")
def comparable_lines(spark, sf):
    """[F-08] The comparable form of every line."""
    return lines(spark, sf).select("doc_id", "pos", F.sha2(comparable("line"), 256).alias("comparable"))


@query("""
    WITH b AS (SELECT event_id, event_type, user_id, floor(value)::INT AS actions, (json_extract(props, '$.k'))::INT AS k FROM events),
    r AS (SELECT event_id, 'no_goal' AS rule FROM b WHERE k % 11 = 0 UNION ALL SELECT event_id, 'route' FROM b WHERE event_type IN ('error', 'signup') UNION ALL SELECT event_id, 'observed_only_for_inspection' FROM b WHERE k % 3 = 0 AND k % 4 <> 0
        UNION ALL SELECT event_id, 'criteria' FROM b WHERE k % 7 = 0 OR k % 10 = 1 UNION ALL SELECT event_id, 'url' FROM b WHERE event_type IN ('view', 'click') AND k % 2 = 1 UNION ALL SELECT event_id, 'browser' FROM b WHERE event_type IN ('view', 'click') AND user_id % 5 = 0
        UNION ALL SELECT event_id, 'budget' FROM b WHERE NOT (actions BETWEEN 1 AND 100 AND k <= 60 AND k > 0) UNION ALL SELECT event_id, 'unknown_check' FROM b WHERE k % 7 = 0)
    SELECT event_id::VARCHAR AS object_id, rule FROM r""")
def brief_checks(spark, sf):
    """[V-07] Briefs whose fields follow from the events' properties, and the rules that they break."""
    k, kind = F.get_json_object("props", "$.k").cast("int"), F.col("event_type")
    a = lambda *xs: F.array(*map(F.lit, xs))
    none = F.array().cast("array<string>")
    briefs = table(spark, sf, "events").select(
        F.col("event_id").alias("brief_id"), F.when(k % 11 == 0, "").otherwise("g").alias("goal"), F.when(kind.isin("view", "click"), "browser").when(kind == "purchase", "desktop").otherwise("phone").alias("route"),
        F.when(k % 4 == 0, "inspect").otherwise("mutate").alias("intent"), F.when(k % 3 == 0, "observed").otherwise("independent").alias("policy"), F.when(k % 2 == 1, "https://no.org/a").otherwise("https://ok.org/a").alias("url"),
        F.when(F.col("user_id") % 5 == 0, "window").otherwise("headless").alias("browser"), a("ok.org").alias("allowed_domains"), none.alias("allowed_apps"), F.when(k % 7 == 0, none).when(k % 10 == 1, a("a", "a")).otherwise(a("a")).alias("criteria"),
        a("a").alias("checks"), F.floor("value").cast("int").alias("max_actions"), (k / 2).alias("max_minutes"),
    )
    return V.brief_violations(briefs).select("object_id", "rule")


@query()
def merged_documents(spark, sf):
    """[J-08, P-05, P-06, P-07, A-13] Documents as candidates: identifiers of some, titles that many share, years that follow from their lengths."""
    i = F.col("doc_id")
    doi = F.when(i % 3 == 0, F.concat(F.lit("https://doi.org/10.1000/"), (i % 211).cast("string"))).when(i % 10 == 1, F.concat(F.lit("10.48550/arXiv.2201."), (i % 97).cast("string")))
    title = F.when(i % 29 != 0, F.get(F.split(F.coalesce("text", F.lit("")), r"\s"), F.lit(0)))
    rows = docs(spark, sf).select(
        i.alias("ord"), doi.alias("doi"), F.lit(None).cast("string").alias("preprint_doi"), F.lit(None).cast("string").alias("arxiv"), title.alias("title"), (2015 + F.col("n_chars") % 9).cast("string").alias("year"),
        F.when(i % 4 == 0, i).alias("citation_count"), F.when(i % 5 == 0, F.col("lang")).alias("abstract"), F.array("source").alias("sources"), F.array(F.lit("p")).alias("pdf_urls"),
    )
    out = L.merge_candidates(rows)
    return out.select("ord", "doi", "preprint_doi", "arxiv", "title", "year", "citation_count", "abstract", F.array_join("sources", ",").alias("sources"), "merged")


# --- files ---


@query()
def table_files(spark, sf):
    """[S-27, F-19, J-21] The files of the given tables: sizes, newlines and digests, by byte ranges."""
    found = ranges.fingerprints(spark, sf, ".parquet")
    return found.select(F.element_at(F.split("path", "/"), -1).alias("name"), "size", "newlines", "leaves", "digest")


# --- pages ---

_SEGMENTS = r"""SELECT page_id, unnest(string_split(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<head>.*?</head>', ''), '(?s)<!--.*?-->', '', 'g'),
    '<(/?(?:p|li|ul|nav|body|html|div|article|h1|footer))(?:\s[^>]*)?>', chr(1) || '\1' || chr(2), 'g'), chr(1))) AS seg FROM pages"""


@query(f"""
    WITH s AS (SELECT page_id, string_split(seg, chr(2))[1] AS tag, trim(regexp_replace(coalesce(string_split(seg, chr(2))[2], ''), '<[^>]*>', '', 'g')) AS text FROM ({_SEGMENTS}))
    SELECT page_id, count(*) FILTER (tag = 'h1' AND text <> '') AS headings, count(*) FILTER (tag = 'li' AND text <> '') AS items, count(*) FILTER (tag NOT IN ('h1', 'li') AND text <> '') AS paras FROM s GROUP BY 1""")
def html_kinds(spark, sf):
    """[S-05] Texts of each kind on each page."""
    out = markup.html_blocks(table(spark, sf, "pages")).groupBy("page_id")
    told = lambda k: F.count_if((F.col("event") == "text") & (F.col("kind") == k))
    return out.agg(told("heading").alias("headings"), told("item").alias("items"), told("para").alias("paras"))


@query(f"""
    WITH RECURSIVE r AS (SELECT doc_id, pos, rtrim(substr(line, 1, 30), ' ') AS text, 10 + pos % 3 * 0.8 AS size, pos % 4 <> 0 AS cont, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS n FROM ({LINES}) WHERE trim(line, ' ') <> ''),
    t AS (SELECT doc_id, n, pos AS head, text AS told, size FROM r WHERE n = 1 UNION ALL
        SELECT doc_id, n, CASE WHEN j THEN head ELSE pos END, CASE WHEN NOT j THEN text WHEN regexp_matches(told, '[A-Za-z]-$') AND regexp_matches(text, '^[a-z]') THEN substr(told, 1, length(told) - 1) || text ELSE told || ' ' || text END, CASE WHEN j THEN old ELSE size END
        FROM (SELECT r.doc_id, r.n, r.pos, r.text, r.size, t.head, t.told, t.size AS old, cont AND abs(t.size - r.size) <= 1 AND NOT regexp_matches(t.told, '[{SENTENCE_ENDS}]$') AND (regexp_matches(r.text, '^[a-z(“"''‘,，、]') OR regexp_matches(t.told, '(^|\\s)[a-z]+$')) AS j
            FROM t JOIN r ON r.doc_id = t.doc_id AND r.n = t.n + 1))
    SELECT doc_id, head::INT AS pos, md5(arg_max(told, n)) AS told FROM t GROUP BY doc_id, head""")
def line_continuations(spark, sf):
    """[W-05] Beginnings of lines as paragraphs of a book: those that go on what stands before them are joined to it."""
    rows = lines(spark, sf).where("trim(line) <> ''").select(
        F.col("doc_id").alias("book"), "pos", F.lit("para").alias("kind"), F.rtrim(F.substring("line", 1, 30)).alias("text"), F.floor(F.col("pos") / 3).cast("int").alias("page"), (10 + F.col("pos") % 3 * 0.8).alias("size"), (F.col("pos") % 4 != 0).alias("cont")
    )
    return B.merge_continuations(rows).select(F.col("book").alias("doc_id"), "pos", F.md5("text").alias("told"))
