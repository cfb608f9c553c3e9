"""Queries over documents, pages, conversations and benchmark, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import blocks as B
from ..operators import evidence as E
from ..operators import graphs as G
from ..operators import linkage as L
from ..operators import ranking as R
from ..operators import screening as S
from ..operators import similarity as J
from ..session import spread
from ..session import table as stored
from ..sources import bibliography, files, markup

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


# The same classes and functions in SQL.
CJK = r"[\x{2E80}-\x{9FFF}\x{AC00}-\x{D7AF}\x{F900}-\x{FAFF}\x{FE30}-\x{FE4F}\x{FF00}-\x{FFEF}]"
NORM = r"regexp_replace(replace(lower(coalesce({0}, '')), 'ß', 'ss'), '[^\p{{L}}\p{{N}}_]', '', 'g')"
LINES = "SELECT doc_id, lang, source, pos - 1 AS pos, parts[pos] AS line FROM (SELECT doc_id, lang, source, string_split(coalesce(text, ''), chr(10)) AS parts, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS pos FROM documents)"
TITLES = "SELECT page_id AS id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS s FROM pages"


def count(pattern: str, of: str) -> str:
    return f"len(regexp_extract_all({of}, '{pattern}'))"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    found = stored(spark, sf, name)
    return spread(found) if name in ("documents", "pages") else found


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents")


def lines(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf).select("doc_id", "lang", "source", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "line"))


def titles(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages")
    return pages.select(F.col("page_id").alias("id"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("s"))


@query(f"""
    WITH keyed AS (SELECT doc_id, lang, source, sha256({NORM.format('text')}) AS ident FROM documents),
    heads AS (SELECT ident, min(doc_id) AS head, count(*) AS n FROM keyed GROUP BY ident HAVING count(*) > 1)
    SELECT k.ident, min(k.doc_id)::VARCHAR AS master, count(*)::BIGINT AS size, string_agg(k.doc_id::VARCHAR, ',' ORDER BY k.doc_id) AS members,
        bool_and(k.lang = f.lang AND k.source = f.source) AS automatic
    FROM keyed k JOIN heads h ON k.ident = h.ident JOIN documents f ON f.doc_id = h.head GROUP BY k.ident""")
def ident_groups(spark, sf):
    """[J-07, A-01, F-01, F-19, P-04] Documents that share an identifier, the digest of the normalised text."""
    keyed = docs(spark, sf).select("doc_id", "lang", "source", F.sha2(T.normalized(F.col("text")), 256).alias("ident"))
    return L.identifier_groups(keyed, order=("doc_id",), same=("lang", "source"))


@query()
def title_ratio_pairs(spark, sf):
    """[J-01] Pairs of page titles as similar as 0.9 in either order; each distinct title under its first page."""
    items = titles(spark, sf).select("id", T.normalized(F.col("s")).alias("s"))
    out = J.ratio_classes(items)
    scaled = lambda c: F.floor(F.col(c) * 1_000_000).alias(c + "_ppm")
    return out.select("a", "b", scaled("ratio_ab"), scaled("ratio_ba"), "members_a", "members_b")


_STRINGS = f"""strings AS (SELECT min(id) AS sid, s, length(s) AS n FROM (SELECT id, {NORM.format('s')} AS s FROM ({TITLES})) GROUP BY s),
    grams AS (SELECT sid, n, substr(s, i, 3) AS g, row_number() OVER (PARTITION BY sid, substr(s, i, 3) ORDER BY i) AS occ FROM (SELECT sid, n, s, unnest(range(1, n - 1)) AS i FROM strings WHERE n >= 3)),
    shared AS (SELECT x.sid AS a, y.sid AS b, count(*) AS overlap FROM grams x JOIN grams y ON x.g = y.g AND x.occ = y.occ AND x.sid < y.sid GROUP BY 1, 2),
    bounded AS (SELECT x.sid AS a, y.sid AS b, least(x.n, y.n) AS m, greatest(x.n, y.n) AS n, (90 * (x.n + y.n) + 199) // 200 AS h FROM strings x JOIN strings y ON x.sid < y.sid),
    passed AS (SELECT a, b, m, n, h, greatest(0, h - 2 * (m + n - 2 * h + 1)) AS bound, coalesce(overlap, 0) AS overlap FROM bounded LEFT JOIN shared USING (a, b) WHERE h <= m)"""


@query(f"WITH {_STRINGS} SELECT a, b, m::INT AS m, n::INT AS n, h::INT AS h, bound::INT AS bound, overlap::INT AS overlap FROM passed WHERE overlap >= bound AND bound > 0")
def qgram_overlap_pairs(spark, sf):
    """[J-02, J-03, J-04, F-15, F-16, F-17, W-02] Pairs of page titles that pass the bound on shared 3-grams."""
    items = titles(spark, sf).select("id", T.normalized(F.col("s")).alias("s"))
    return J.overlap_pairs(J.distinct_strings(items)).where("bound > 0")


@query(f"""WITH {_STRINGS}, chars AS (SELECT sid, substr(s, i, 1) AS c, row_number() OVER (PARTITION BY sid, substr(s, i, 1) ORDER BY i) AS occ FROM (SELECT sid, s, unnest(range(1, n + 1)) AS i FROM strings)),
    common AS (SELECT x.sid AS a, y.sid AS b, count(*) AS shared_chars FROM chars x JOIN chars y ON x.c = y.c AND x.occ = y.occ AND x.sid < y.sid GROUP BY 1, 2)
    SELECT a, b, h::INT AS h, shared_chars::INT AS shared_chars FROM passed JOIN common USING (a, b) WHERE overlap >= bound AND bound > 0 AND shared_chars >= h""")
def char_overlap_pairs(spark, sf):
    """[J-06] The pairs of qgram_overlap_pairs that share enough characters."""
    strings = J.distinct_strings(titles(spark, sf).select("id", T.normalized(F.col("s")).alias("s")))
    return J.character_pairs(J.overlap_pairs(strings).where("bound > 0"), strings).select("a", "b", "h", "shared_chars")


@query("""
    WITH c AS (SELECT doc_id, lower(string_split(coalesce(text, ''), chr(10))[1]) AS title, lower(coalesce(text, '')) AS abstract, n_chars, source FROM documents),
    s AS (SELECT doc_id, floor(1e6 * (
        3 * greatest((contains(title, 'shth')::INT + contains(title, 'nd')::INT) / 2, contains(title, 'of the')::INT / 1)
        + 1.5 * greatest((contains(abstract, 'shth')::INT + contains(abstract, 'nd')::INT) / 2, contains(abstract, 'of the')::INT / 1)
        + 0.4 * least(greatest(n_chars % 5 - 1, 0), 3) + 0.3 * log10(1 + n_chars) + CASE WHEN abstract <> '' THEN 0.3 ELSE 0 END + CASE WHEN source = 'src0' THEN 0.2 ELSE 0 END
        + CASE WHEN source = 'src1' THEN 0.5 ELSE 0 END) + 1e-3)::BIGINT AS score_ppm FROM c)
    SELECT doc_id, score_ppm, row_number() OVER (ORDER BY score_ppm DESC, doc_id) AS rank FROM s""")
def relevance_rank(spark, sf):
    """[F-13, F-14, A-07, W-01, O-01] Documents by relevance to two queries; the title is the first line."""
    c = docs(spark, sf).select("doc_id", "source", "n_chars", F.get(F.split(F.coalesce("text", F.lit("")), "\n"), F.lit(0)).alias("title"), F.coalesce("text", F.lit("")).alias("abstract"))
    out = R.scored(c, ["ti:shth AND nd", '"of the"'], F.col("n_chars") % 5, F.col("n_chars"), F.col("source") == "src0", F.col("source") == "src1")
    return R.global_rank(out.select("doc_id", F.floor(1e6 * F.col("score") + 1e-3).alias("score_ppm")), "score_ppm", "doc_id")


@query("""
    SELECT source, min(doc_id) AS survivor, count(*) AS merged, arg_min(lang, doc_id) FILTER (lang <> '') AS lang, md5(arg_min(text, doc_id) FILTER (text <> '')) AS text_md5,
        array_to_string(list_sort(list_distinct(list(lang))), ',') AS langs FROM documents GROUP BY source""")
def merge_first_nonempty(spark, sf):
    """[A-13, A-24] One record for each source: first values, and languages in order of appearance (sorted here)."""
    rows = docs(spark, sf).withColumn("langs", F.array("lang"))
    out = L.merge_first(rows, "source", "doc_id", ("lang", "text"), ())
    langs = rows.groupBy("source").agg(F.array_join(F.sort_array(F.collect_set("lang")), ",").alias("langs"))
    return out.join(langs, "source").select("source", "survivor", "merged", "lang", F.md5("text").alias("text_md5"), "langs")


@query(f"""
    WITH k AS (SELECT sha256({NORM.format('text')}) AS ident, unnest(['lang', 'source']) AS field, unnest([lang, source]) AS v FROM documents)
    SELECT ident, field, count(DISTINCT v)::BIGINT AS n_values, string_agg(DISTINCT v, '|' ORDER BY v) AS field_values FROM k WHERE v <> '' GROUP BY 1, 2 HAVING count(DISTINCT v) > 1""")
def field_conflicts(spark, sf):
    """[A-14] Fields in which documents of the same text differ."""
    return L.field_conflicts(docs(spark, sf).select("lang", "source", F.sha2(T.normalized(F.col("text")), 256).alias("ident")), "ident", ("lang", "source"))


def _decisions(spark, sf) -> DataFrame:
    group = F.when(F.col("toxic") == 1, "excluded").when(F.col("quality") == 1, "included").otherwise("deferred")
    return table(spark, sf, "labels").select(F.col("doc_id").alias("id"), group.alias("group"), F.lit("label").alias("reason"), F.col("doc_id").alias("batch"))


@query("""
    SELECT count(*) AS candidates, count(*) FILTER (toxic = 0 AND quality = 1) AS included, count(*) FILTER (toxic = 1) AS excluded, count(*) FILTER (toxic = 0 AND quality = 0) AS deferred,
        count(*) FILTER (l.doc_id IS NULL) AS unassessed, CASE WHEN count(*) FILTER (l.doc_id IS NULL OR (toxic = 0 AND quality = 0)) > 0 THEN 'selected_complete_scope_pending' ELSE 'complete' END AS status
    FROM documents d LEFT JOIN labels l USING (doc_id)""")
def screening_funnel(spark, sf):
    """[A-03, A-25] How documents have been screened, labels being the decisions."""
    return S.scope_status(S.funnel(docs(spark, sf).select(F.col("doc_id").alias("id")), _decisions(spark, sf)))


@query("SELECT doc_id AS id, lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) ORDER BY doc_id LIMIT 40")
def screening_batch(spark, sf):
    """[T-10, U-03] The next forty documents to assess."""
    return S.next_batch(docs(spark, sf).select(F.col("doc_id").alias("id"), "lang"), _decisions(spark, sf), 40, "id")


_FACETS = [("bulk", "src0"), ("even", "src2"), ("even", "src4"), ("none", "srcX"), ("early", "src1"), ("early", "src2")]


@query("""
    WITH f(name, query) AS (VALUES ('bulk', 'src0'), ('even', 'src2'), ('even', 'src4'), ('none', 'srcX'), ('early', 'src1'), ('early', 'src2'))
    SELECT name, count(DISTINCT d.doc_id) AS retrieved, count(DISTINCT l.doc_id) AS selected, count(DISTINCT l.doc_id) FILTER (quality = 1) AS fulltext
    FROM f LEFT JOIN documents d ON d.source = f.query LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY name""")
def facet_coverage(spark, sf):
    """[A-04, J-13] Documents that each facet's sources bring, labelled ones being selected."""
    papers = table(spark, sf, "labels").select(F.col("doc_id").alias("id"), F.when(F.col("quality") == 1, "fulltext").otherwise("abstract").alias("level"))
    return S.facet_coverage(spark.createDataFrame(_FACETS, "name string, query string"), docs(spark, sf).select(F.col("doc_id").alias("id"), F.col("source").alias("query")), papers)


@query(f"""
    WITH p AS (SELECT doc_id, sum(length(trim(line, ' '))) AS chars, count(*) FILTER (length(trim(line, ' ')) >= 200) AS readable_pages FROM ({LINES}) GROUP BY doc_id)
    SELECT doc_id, chars::BIGINT AS chars, readable_pages, CASE WHEN chars >= 8000 AND readable_pages >= 3 THEN 'fulltext' WHEN chars >= 1000 THEN 'partial' WHEN chars > 0 THEN 'abstract' ELSE 'metadata' END AS level FROM p""")
def evidence_levels(spark, sf):
    """[A-06, P-13] What each document has to offer, its lines being pages."""
    out = E.evidence_size(lines(spark, sf), "doc_id", "line")
    return out.withColumn("level", E.evidence_level(F.col("chars"), F.col("readable_pages"), F.col("chars") > 0))


@query(f"""
    WITH p AS (SELECT doc_id, line, length(line) AS n FROM ({LINES}) WHERE line <> ''),
    q AS (SELECT doc_id, count(*) AS paras, sum(n)::BIGINT AS chars, trunc(median(n))::BIGINT AS median_para_chars, max(n)::BIGINT AS max_para_chars, count(*) FILTER (n > 4000) AS giant_paras, 0::BIGINT AS fragment_paras, 1::BIGINT AS chapters,
        count(*) FILTER (n < 8) / count(*) AS tiny_ratio, coalesce(sum({count(CJK, 'line')}) / nullif(sum({count('[^ \t\r\f\v]', 'line')}), 0), 0)::DOUBLE AS cjk_ratio,
        coalesce(sum({count('[\\x{FFFD}\\x{E000}-\\x{F8FF}]', 'line')}) / nullif(sum(n), 0), 0)::DOUBLE AS mojibake_ratio FROM p GROUP BY doc_id)
    SELECT *, concat_ws(',', CASE WHEN paras < 20 THEN 'little_text' END, CASE WHEN giant_paras > 0 THEN 'giant_paragraphs' END, CASE WHEN mojibake_ratio > 0.01 THEN 'encoding' END, CASE WHEN paras > 200 THEN 'single_chapter' END) AS warnings,
        paras >= 20 AND mojibake_ratio <= 0.05 AS ok FROM q""")
def quality_profile(spark, sf):
    """[A-12, F-07] Profile of each document as a book of its lines."""
    return B.quality_profile(lines(spark, sf).where("line <> ''"), "doc_id", "line")


@query(f"""
    SELECT book, furniture, count(DISTINCT page) AS pages FROM (SELECT source AS book, doc_id AS page, substr(regexp_replace(regexp_replace(line, '\\s+', '', 'g'), '[0-9]+', '#', 'g'), 1, 60) AS furniture FROM ({LINES}))
    WHERE furniture <> '' GROUP BY 1, 2 HAVING count(DISTINCT page) >= 3""")
def page_furniture(spark, sf):
    """[A-16, F-12] Lines that return in three documents of a source."""
    return B.page_furniture(lines(spark, sf), "source", "doc_id", "line")


@query(f"""
    WITH b AS (SELECT doc_id, pos, line AS t, length(line) AS n, regexp_extract_all(line, '[A-Za-z]{{4,}}|[一-鿿]{{3,}}') AS w, len(list_filter(string_split_regex(line, '\\s+'), lambda x: x <> '')) + {count('[一-鿿]', 'line')} AS words FROM ({LINES}) WHERE line <> ''),
    f AS (SELECT *, n <= 40 AND NOT (regexp_matches(t, '[。！？.!?]$') AND words >= 3) AND (n <= 3 OR len(w) <= 1 OR list_sum(list_transform(w, lambda x: length(x))) < 0.5 * n) AS frag FROM b),
    g AS (SELECT *, sum(CASE WHEN frag AND coalesce(prev, false) THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM (SELECT *, lag(frag) OVER (PARTITION BY doc_id ORDER BY pos) AS prev FROM f)),
    r AS (SELECT doc_id, run, bool_and(frag) AS frag, count(*) AS n, string_agg(t, ' ' ORDER BY pos) AS joined, sum(n) AS chars FROM g GROUP BY 1, 2)
    SELECT doc_id, sum(CASE WHEN frag AND n >= 3 THEN 1 ELSE n END)::BIGINT AS blocks, count(*) FILTER (frag AND n >= 3) AS fragments, coalesce(sum(length(joined)) FILTER (frag AND n >= 3), 0)::BIGINT AS fragment_chars FROM r GROUP BY doc_id""")
def fragment_runs(spark, sf):
    """[P-10, W-08] Blocks of each document after runs of fragments have been merged."""
    blocks = lines(spark, sf).where("line <> ''").select("doc_id", "pos", F.lit("para").alias("kind"), F.col("line").alias("text"))
    out = B.collapse_fragments(blocks, "doc_id")
    frag = F.col("kind") == "fragment"
    return out.groupBy("doc_id").agg(F.count("*").alias("blocks"), F.count_if(frag).alias("fragments"), F.coalesce(F.sum(F.when(frag, F.length("text"))), F.lit(0)).alias("fragment_chars"))


@query("""
    SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section,
        count(*) FILTER (role = 'user') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS step FROM conversations""")
def section_assign(spark, sf):
    """[W-06, J-17, W-14] Every turn under the question before it."""
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "role")
    out = B.carry_forward(rows, "conv_id", F.when(F.col("role") == "user", F.col("turn")), "section", "turn")
    return out.withColumn("step", F.count_if(F.col("role") == "user").over(B.so_far("conv_id", "turn"))).drop("role")


_SECONDS = f"greatest(1.6, {count(CJK, 'text')} / 4.2 + {count('[A-Za-z0-9][A-Za-z0-9_’' + chr(39) * 2 + '-]*', f'regexp_replace(text, {chr(39)}{CJK}{chr(39)}, {chr(39)} {chr(39)}, {chr(39)}g{chr(39)})')} / 2.6 + 0.3)"


@query(f"""
    WITH b AS (SELECT conv_id, turn, coalesce(text, '') AS text, count(*) FILTER (role = 'user') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS scene FROM conversations),
    s AS (SELECT conv_id, turn, scene, {_SECONDS} AS seconds, row_number() OVER (PARTITION BY conv_id, scene ORDER BY turn) AS k, min(scene) OVER (PARTITION BY conv_id) AS opening FROM b),
    e AS (SELECT conv_id, turn, scene, seconds, CASE WHEN opening > 0 THEN 2.4 ELSE 0 END - 0.35
        + sum(seconds + 0.35 + CASE WHEN k = 1 AND scene > 0 THEN 0.9 ELSE 0 END + CASE WHEN k = 1 AND scene > 1 THEN 0.45 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY scene, turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS end_s FROM s)
    SELECT conv_id, turn, scene, round(1000 * (end_s - seconds))::BIGINT AS start_ms, round(1000 * end_s)::BIGINT AS end_ms FROM e""")
def timeline(spark, sf):
    """[F-32, W-09] When each turn would be spoken, questions beginning scenes."""
    rows = table(spark, sf, "conversations").withColumn("scene", F.count_if(F.col("role") == "user").over(B.so_far("conv_id", "turn")))
    rows = rows.withColumn("seconds", T.speech_seconds(F.coalesce("text", F.lit(""))))
    out = B.timeline(rows, "conv_id", "scene", "turn")
    return out.select("conv_id", "turn", "scene", F.round(1000 * F.col("start_s")).cast("long").alias("start_ms"), F.round(1000 * F.col("end_s")).cast("long").alias("end_ms"))


@query()
def html_blocks(spark, sf):
    """[S-05] Pages as ordered events."""
    return markup.html_blocks(table(spark, sf, "pages"))


@query("""
    SELECT page_id, length(regexp_replace(html, '<[^>]+>', ' ', 'g'))::BIGINT AS stripped_chars, len(regexp_extract_all(html, '<p[ >]'))::BIGINT AS paragraphs, contains(html, 'NaN') AS has_nan, contains(html, '&nbsp;') AS has_nbsp,
        regexp_matches(html, '<h1>\\s*</h1>') AS empty_heading, NOT contains(html, '<title>') AS no_title FROM pages""")
def page_audit(spark, sf):
    """[V-13] What a page's markup must not hold."""
    h = F.col("html")
    return table(spark, sf, "pages").select(
        "page_id", F.length(F.regexp_replace(h, "<[^>]+>", " ")).cast("long").alias("stripped_chars"), F.regexp_count(h, F.lit("<p[ >]")).cast("long").alias("paragraphs"), F.contains(h, F.lit("NaN")).alias("has_nan"),
        F.contains(h, F.lit("&nbsp;")).alias("has_nbsp"), h.rlike(r"<h1>\s*</h1>").alias("empty_heading"), (~F.contains(h, F.lit("<title>"))).alias("no_title"),
    )


_QUOTES = "SELECT item_id * 1000 + pos AS quote_id, parts[pos] AS quote FROM (SELECT item_id, string_split(text, chr(10)) AS parts, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS pos FROM benchmark)"


@query(f"""
    SELECT quote_id, d.doc_id AS chapter, d.pos::INT AS para FROM ({_QUOTES}) q JOIN ({LINES}) d ON contains(regexp_replace(d.line, '\\s+', '', 'g'), regexp_replace(q.quote, '\\s+', '', 'g'))
    WHERE regexp_replace(q.quote, '\\s+', '', 'g') <> ''""")
def quote_anchor(spark, sf):
    """[F-10] Where the lines of the benchmark stand in documents."""
    quotes = table(spark, sf, "benchmark").select("item_id", F.posexplode(F.split("text", "\n")).alias("pos", "quote")).select((F.col("item_id") * 1000 + F.col("pos") + 1).alias("string_id"), F.col("quote").alias("string"))
    paras = lines(spark, sf).select(F.lit("all").alias("book"), F.col("doc_id").alias("chapter"), F.col("pos").alias("para"), F.col("line").alias("text"))
    return E.holders(paras, quotes).select(F.col("string_id").alias("quote_id"), "chapter", "para")


@query(f"""
    SELECT item_id AS concept, min(struct_pack(c := doc_id, p := pos)).c AS chapter, min(struct_pack(c := doc_id, p := pos)).p::INT AS para
    FROM (SELECT item_id, string_split(text, chr(10))[1] AS name FROM benchmark) JOIN ({LINES}) ON contains(line, name) WHERE name <> '' GROUP BY item_id""")
def first_occurrence(spark, sf):
    """[J-16] The first line of documents that holds each benchmark item's first line."""
    concepts = table(spark, sf, "benchmark").select(F.col("item_id").alias("concept"), F.lit("all").alias("book"), F.get(F.split("text", "\n"), F.lit(0)).alias("name"))
    return E.first_occurrences(concepts, lines(spark, sf).select(F.lit("all").alias("book"), F.col("doc_id").alias("chapter"), F.col("pos").alias("para"), F.col("line").alias("text")))


@query(f"""
    SELECT doc_id, sha256({NORM.format('t')}) AS norm_sha, length(regexp_replace(t, '\\s+', '', 'g'))::BIGINT AS squashed, substr(regexp_replace(t, '\\s+', ' ', 'g'), 1, 280) AS snippet,
        {count(CJK, 't')}::BIGINT AS cjk, CASE WHEN {count(CJK, 't')} * 3 < {count('[a-zA-Z]', 't')} THEN 'en' ELSE 'zh' END AS language, greatest(1, round_even(length(t) / 400, 0))::INT AS minutes,
        md5(replace(replace(replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;')) AS escaped_md5,
        md5(regexp_replace(t, '(api_key|token|key)=([^\\s&''"]+)', '\\1=[REDACTED]', 'gi')) AS redacted_md5, substr(regexp_replace(regexp_replace(lower(t), '[^\\p{{L}}\\p{{N}}]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 60) AS slug,
        {count("[A-Za-z0-9][A-Za-z0-9_''’-]*", 't')}::BIGINT AS words
    FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)""")
def text_scalars(spark, sf):
    """[F-01, F-10, F-19, F-23, F-29, F-31, F-33, F-36, F-37, F-43] Scalars of each text."""
    t = F.coalesce("text", F.lit(""))
    return docs(spark, sf).select(
        "doc_id", F.sha2(T.normalized(t), 256).alias("norm_sha"), F.length(T.squash(t)).cast("long").alias("squashed"), T.snippet(t).alias("snippet"), F.regexp_count(t, F.lit(f"[{T.CJK}]")).cast("long").alias("cjk"),
        T.language(t).alias("language"), T.reading_minutes(F.length(t)).alias("minutes"), F.md5(T.html_escape(t)).alias("escaped_md5"), F.md5(T.redact(t)).alias("redacted_md5"), T.slug(t).alias("slug"), T.word_count(t).cast("long").alias("words"),
    )


@query(f"""
    WITH l AS (SELECT doc_id, pos, line AS t FROM ({LINES})),
    c AS (SELECT *, {count(CJK, 't')} AS cjk, {count(' ', 't')} AS blank, {count("[iljtfrI.,:;|!''`(){{}}]", 't')} + {count('[[]', 't')} + {count('[]]', 't')} AS narrow, {count('[mwMWOQGD@%&]', 't')} AS wide, {count('[A-CEFHJ-LNPR-VX-Z]', 't')} AS upper FROM l)
    SELECT doc_id, pos::INT AS pos, floor((cjk + 0.3 * blank + 0.32 * narrow + 0.86 * wide + 0.68 * upper + 0.56 * (length(t) - cjk - blank - narrow - wide - upper)) * 1300 + 0.5)::BIGINT AS width FROM c""")
def line_widths(spark, sf):
    """[F-28] Estimated width of every line, in hundredths."""
    return lines(spark, sf).select("doc_id", "pos", F.floor(T.text_width(F.col("line")) * 100 + 0.5).alias("width"))


@query("""
    WITH s AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(coalesce(text, ''), '[^。！？；!?;.]+'), lambda x: trim(x, ' ' || chr(10))), lambda x: x <> '') AS parts FROM documents)
    SELECT doc_id, len(parts)::BIGINT AS parts FROM s""")
def sentence_parts(spark, sf):
    """Stretches between sentence ends; abbreviations are the tests' matter, as SQL has no look-ahead."""
    parts = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[^。！？；!?;.]+"), F.lit(0))
    return docs(spark, sf).select("doc_id", F.size(F.filter(parts, lambda x: F.regexp_replace(x, "[ \n]", "") != "")).cast("long").alias("parts"))


@query()
def lint_counts(spark, sf):
    """[V-10, F-30, F-31, W-17] Sentences of each document, how many are too long, and paragraphs of too many."""
    from ..operators import lint

    return lint.document_counts(docs(spark, sf))


@query("""
    SELECT doc_id, lower(mail) AS ident, min(pos)::BIGINT AS ord FROM (SELECT doc_id, unnest(m) AS mail, unnest(range(len(m))) AS pos FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9._-]+@[A-Za-z0-9.-]+[A-Za-z]') AS m FROM documents)) GROUP BY 1, 2""")
def identifier_harvest(spark, sf):
    """[S-13, U-02] Addresses in documents, each once, in order of appearance."""
    return bibliography.harvest(docs(spark, sf), "doc_id", r"[A-Za-z0-9._-]+@[A-Za-z0-9.-]+[A-Za-z]", normalise=F.lower)


@query("SELECT item_id, array_to_string(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> ''), ' ') AS abstract FROM benchmark")
def inverted_abstracts(spark, sf):
    """[S-15] Benchmark texts through an inverted index and back."""
    words = table(spark, sf, "benchmark").select("item_id", F.posexplode(F.filter(F.split("text", r"\s+"), lambda w: w != "")).alias("pos", "word"))
    index = words.groupBy("item_id", "word").agg(F.sort_array(F.collect_list("pos")).alias("at")).groupBy("item_id").agg(F.map_from_entries(F.collect_list(F.struct("word", "at"))).alias("positions"))
    return bibliography.rebuild_abstract(index, "item_id")


@query("""
    SELECT doc_id, chunk::INT AS chunk, md5(substr(t, chunk * 1000 + 1, 1000)) AS part_md5 FROM (SELECT doc_id, t, unnest(range(greatest(1, ceil(length(t) / 1000)::INT))) AS chunk FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents))""")
def text_chunks(spark, sf):
    """[S-18] Texts in pieces of a thousand characters."""
    return files.chunks(docs(spark, sf), "doc_id", size=1000).select("doc_id", "chunk", F.md5("part").alias("part_md5"))


@query("""
    WITH f AS (SELECT source AS folder, source || '-' || doc_id || CASE lang WHEN 'en' THEN '.pdf' WHEN 'de' THEN '.epub' WHEN 'fr' THEN '.mobi' ELSE '.txt' END AS name, CASE lang WHEN 'de' THEN 4 WHEN 'en' THEN 3 WHEN 'fr' THEN 1 ELSE 0 END AS rank FROM documents)
    SELECT folder, name, rank, CASE WHEN rank >= 3 THEN 'extract' ELSE 'skip' END AS status FROM f QUALIFY row_number() OVER (PARTITION BY folder ORDER BY rank DESC, length(name) DESC, name DESC) = 1""")
def best_formats(spark, sf):
    """[S-09, O-06] The file to read of each folder, languages standing for formats."""
    ext = F.when(F.col("lang") == "en", ".pdf").when(F.col("lang") == "de", ".epub").when(F.col("lang") == "fr", ".mobi").otherwise(".txt")
    return files.best_format(docs(spark, sf).select(F.col("source").alias("folder"), F.concat("source", F.lit("-"), F.col("doc_id").cast("string"), ext).alias("name")))


@query("SELECT doc_id FROM documents WHERE contains(lower(coalesce(text, '') || ' ' || coalesce(source, '')), 'of the')")
def topic_filter(spark, sf):
    """[P-01] Documents whose text or source names a phrase."""
    return docs(spark, sf).where(F.contains(F.lower(F.concat_ws(" ", F.coalesce("text", F.lit("")), F.coalesce("source", F.lit("")))), F.lit("of the"))).select("doc_id")


@query("""
    SELECT doc_id, strpos(lower(text), 'stupid')::INT AS position, substr(text, greatest(strpos(lower(text), 'stupid') - 40, 1), strpos(lower(text), 'stupid') + 46 - greatest(strpos(lower(text), 'stupid') - 40, 1)) AS snippet
    FROM documents WHERE contains(lower(text), 'stupid') ORDER BY doc_id LIMIT 20""")
def search_hits(spark, sf):
    """[O-08, O-09] The first twenty documents that hold a word, and what stands around it."""
    return R.search(docs(spark, sf), "stupid", "doc_id")


@query("""
    SELECT page_id, regexp_extract(url, '^(https?)://', 1) AS scheme, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, regexp_matches(url, '^https?://([a-z0-9.-]+\\.)?example\\.org(/|$)') AS allowed,
        length(url)::INT AS n, replace(replace(replace(url, ':', '%3A'), '/', '%2F'), '?', '%3F') AS part_encoded FROM pages""")
def url_rules(spark, sf):
    """Schemes and hosts of pages, and which are allowed."""
    u = F.col("url")
    host = F.try_parse_url(u, F.lit("HOST"))
    inside = F.coalesce(F.try_parse_url(u, F.lit("PROTOCOL")).isin("http", "https") & F.try_parse_url(u, F.lit("USERINFO")).isNull() & (host.endswith(".example.org") | (host == "example.org")), F.lit(False))
    part = F.replace(F.replace(F.replace(u, F.lit(":"), F.lit("%3A")), F.lit("/"), F.lit("%2F")), F.lit("?"), F.lit("%3F"))
    return table(spark, sf, "pages").select("page_id", F.try_parse_url(u, F.lit("PROTOCOL")).alias("scheme"), host.alias("host"), inside.alias("allowed"), F.length(u).alias("n"), part.alias("part_encoded"))


@query(f"""
    WITH k AS (SELECT doc_id, sha256({NORM.format('text')}) AS ident FROM documents) SELECT doc_id AS node, min(doc_id) OVER (PARTITION BY ident) AS component FROM k QUALIFY count(*) OVER (PARTITION BY ident) > 1""")
def copy_components(spark, sf):
    """[G-05] Components of the graph that links each document with the first of the same text."""
    keyed = docs(spark, sf).select("doc_id", F.sha2(T.normalized(F.col("text")), 256).alias("ident"))
    heads = keyed.groupBy("ident").agg(F.min("doc_id").alias("u"))
    return G.components(keyed.join(heads, "ident").where("doc_id <> u").select("u", F.col("doc_id").alias("v")))


@query(f"WITH k AS (SELECT doc_id, sha256({NORM.format('text')}) AS ident FROM documents) SELECT doc_id AS key, count(*) OVER (PARTITION BY ident) - 1 AS others FROM k QUALIFY count(*) OVER (PARTITION BY ident) > 1")
def same_content(spark, sf):
    """[J-29] How many other documents have the same content."""
    return L.others_with_same(docs(spark, sf).select(F.col("doc_id").alias("key"), F.sha2(T.normalized(F.col("text")), 256).alias("h")), "h")


@query(f"""
    WITH d AS (SELECT doc_id, {NORM.format('text')} AS title, lang FROM documents), lib AS (SELECT * FROM d WHERE lang = 'en'), imp AS (SELECT * FROM d WHERE lang <> 'en' OR lang IS NULL),
    p AS (SELECT i.doc_id AS import_id, min(l.doc_id) AS matched FROM imp i JOIN lib l ON i.title = l.title GROUP BY 1)
    SELECT import_id, matched, 'title' AS by FROM p""")
def import_matches(spark, sf):
    """[J-28] Documents of other languages that match an English one by title."""
    d = docs(spark, sf).select(F.col("doc_id").alias("id"), T.normalized(F.col("text")).alias("title"), F.coalesce("lang", F.lit("")).alias("lang"))
    return L.match_imports(d.where("lang <> 'en'"), d.where("lang = 'en'"), ("title",), ("title", "lang"))


@query(f"""
    SELECT doc_id, count(*) FILTER (regexp_matches(line, '^#{{1,6}}\\s')) AS headings, count(*) FILTER (regexp_matches(line, '\\|')) AS bars, count(*) FILTER (regexp_matches(line, '^[^:：]+[:：]')) AS pairs,
        coalesce(sum(len(string_split(line, '|'))), 0)::BIGINT AS fields FROM ({LINES}) GROUP BY doc_id""")
def line_notations(spark, sf):
    """[F-24, S-22, S-25, S-35] Headings, table rows and key-value lines of each document."""
    rows, c = lines(spark, sf), F.col("line")
    return rows.groupBy("doc_id").agg(F.count_if(c.rlike(r"^#{1,6}\s")).alias("headings"), F.count_if(c.rlike(r"\|")).alias("bars"), F.count_if(T.key_value(c)[0].isNotNull()).alias("pairs"), F.sum(F.size(T.pipe_fields(c))).alias("fields"))


@query(f"""
    WITH p AS (SELECT doc_id, pos, line, sum(length(line)) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM ({LINES}))
    SELECT doc_id, count(*) AS paras, sum(length(line))::BIGINT AS chars FROM p WHERE upto <= 2000 OR upto = length(line) GROUP BY doc_id""")
def first_pages(spark, sf):
    """[W-10] The first page of each document, at 2,000 characters."""
    page = B.first_page(lines(spark, sf), "doc_id", 2000, text="line")
    return page.groupBy("doc_id").agg(F.count("*").alias("paras"), F.sum(F.length("line")).alias("chars"))


@query(f"""
    WITH RECURSIVE r AS (SELECT doc_id, pos::INT AS pos, length(line) AS n FROM ({LINES})), t AS (SELECT doc_id, pos, 0::BIGINT AS page, n AS used FROM r WHERE pos = 0
        UNION ALL SELECT r.doc_id, r.pos, CASE WHEN used > 0 AND used + r.n > 2000 THEN page + 1 ELSE page END, CASE WHEN used > 0 AND used + r.n > 2000 THEN 0 ELSE used END + r.n FROM t JOIN r ON r.doc_id = t.doc_id AND r.pos = t.pos + 1)
    SELECT doc_id, pos, page FROM t""")
def pages_of_paragraphs(spark, sf):
    """[W-10] All pages of each document, at 2,000 characters."""
    return B.paginate(lines(spark, sf), "doc_id", 2000, text="line")


@query(f"""
    SELECT doc_id, pos::INT AS pos, CASE WHEN coalesce(line, '') = '' THEN nxt WHEN coalesce(nxt, '') = '' THEN line WHEN regexp_matches(line, '[A-Za-z]-$') AND regexp_matches(nxt, '^[a-z]') THEN substr(line, 1, length(line) - 1) || nxt
        WHEN regexp_matches(line, '{CJK}$') OR regexp_matches(nxt, '^{CJK}') THEN line || nxt ELSE line || ' ' || nxt END AS joined
    FROM (SELECT *, lead(line) OVER (PARTITION BY doc_id ORDER BY pos) AS nxt FROM ({LINES})) WHERE nxt IS NOT NULL""")
def joined_lines(spark, sf):
    """[F-05] Every two neighbouring lines as one."""
    rows = lines(spark, sf).withColumn("next", F.lead("line").over(B.within("doc_id"))).where("next is not null")
    return rows.select("doc_id", "pos", T.join_lines(F.col("line"), F.col("next")).alias("joined"))


@query("""
    SELECT conv_id, count(*) AS turns, string_agg(role, '>' ORDER BY turn) AS roles, md5(string_agg(coalesce(text, ''), chr(10) ORDER BY turn)) AS text_md5, bool_and(ok) AS contiguous
    FROM (SELECT *, turn = row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS ok FROM conversations) GROUP BY conv_id""")
def conversation_texts(spark, sf):
    """[A-15, W-16] Ordered strings of each conversation, and whether its turns are numbered without gaps."""
    rows = table(spark, sf, "conversations").withColumn("ok", F.col("turn") == F.row_number().over(B.within("conv_id", "turn")) - 1)
    return rows.groupBy("conv_id").agg(
        F.count("*").alias("turns"), F.expr("listagg(role, '>') WITHIN GROUP (ORDER BY turn)").alias("roles"), F.md5(F.expr("listagg(coalesce(text, ''), '\n') WITHIN GROUP (ORDER BY turn)")).alias("text_md5"), F.bool_and("ok").alias("contiguous")
    )


@query("SELECT sha256(role || chr(10) || coalesce(text, '')) AS digest, count(*) AS requests, min(conv_id) AS first_conv FROM conversations GROUP BY 1")
def cached_turns(spark, sf):
    """[S-17] Requests by the digest of their content: one computation serves all."""
    rows = table(spark, sf, "conversations").withColumn("digest", F.sha2(F.concat("role", F.lit("\n"), F.coalesce("text", F.lit(""))), 256))
    return rows.groupBy("digest").agg(F.count("*").alias("requests"), F.min("conv_id").alias("first_conv"))


@query("""
    SELECT l.doc_id AS id, CASE WHEN toxic = 1 THEN 'excluded' WHEN quality = 1 THEN 'included' ELSE 'deferred' END AS "group" FROM labels l""")
def decisions_upsert(spark, sf):
    """[U-06] Decisions in two batches, the later one winning."""
    d = _decisions(spark, sf)
    early = d.withColumns({"group": F.lit("deferred"), "batch": F.lit(0)})
    return S.latest_decisions(early.unionByName(d.withColumn("batch", F.lit(1)))).select("id", "group")


@query("""
    SELECT count(*) FILTER (l.doc_id IS NULL) AS without_label, count(*) FILTER (d.doc_id IS NULL) AS without_document, count(*) FILTER (l.doc_id IS NOT NULL AND d.doc_id IS NOT NULL) AS both FROM documents d FULL JOIN labels l USING (doc_id)""")
def label_sets(spark, sf):
    """[U-05, U-07] What documents and labels have in common and what not."""
    d, l = docs(spark, sf).select("doc_id"), table(spark, sf, "labels").select("doc_id")
    sides = S.set_difference(d, l).groupBy().agg(F.count_if(F.col("side") == "left").alias("without_label"), F.count_if(F.col("side") == "right").alias("without_document"))
    both = d.distinct().join(l.distinct(), "doc_id").agg(F.count("*").alias("both"))
    return sides.crossJoin(F.broadcast(both))  # one row with one row
