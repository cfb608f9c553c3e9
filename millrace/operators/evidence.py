"""Evidence: quotes and excerpts against pages, notes and concepts against paragraphs, and the rules a note must meet.

Validators return (object_id, rule, detail), one row for each violation; none means valid.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.udfs import excerpt_pieces
from .passages import found_strings, page_forms, pieces_stand

# What each tier of note must hold and may not exceed.
TIER_SECTIONS = {
    "deep": ("一句话结论", "问题与动机", "核心思路", "方法要点", "关键结果", "边界与疑点", "代码、数据与复现", "关联与启发", "证据索引"),
    "brief": ("一句话结论", "作者声称", "方法定位", "可信度与待核", "关联与启发"),
    "stub": ("一句话定位", "纳入理由", "补全途径"),
}
ALLOWED_TIERS = {"fulltext": ("deep", "brief"), "partial": ("deep", "brief"), "abstract": ("brief",), "metadata": ("stub",)}
DEFAULT_TIER = {"fulltext": "deep", "partial": "deep", "abstract": "brief", "metadata": "stub"}
BODY_LIMIT = {"brief": 1800, "stub": 600}
TAKEAWAY_LIMIT = 160
CLICHES = ("新颖", "具有重要意义", "提供了新思路", "开辟了", "填补了空白", "里程碑", "novel", "paves the way", "sheds light", "groundbreaking")
CLAIM_KINDS = ("reported", "inference", "limitation", "metadata")


def violations(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def rule(rows: DataFrame, key: str, name: str, when: Column, detail: Column | None = None) -> DataFrame:
    """(object_id, rule, detail) of the rows that break a rule."""
    shown = F.lit(None).cast("string") if detail is None else detail.cast("string")
    return rows.where(F.coalesce(when, F.lit(False))).select(F.col(key).cast("string").alias("object_id"), F.lit(name).alias("rule"), shown.alias("detail"))


def evidence_size(pages: DataFrame, item: str, text: str = "text", readable: int = 200) -> DataFrame:
    """[A-06] (item, chars, readable_pages): trimmed characters, and pages with at least so many."""
    n = F.length(T.strip(F.coalesce(F.col(text), F.lit(""))))
    return pages.groupBy(item).agg(F.sum(n).alias("chars"), F.count_if(n >= readable).alias("readable_pages"))


def evidence_level(chars: Column, readable_pages: Column, has_abstract: Column) -> Column:
    """[P-13]"""
    return F.when((chars >= 8000) & (readable_pages >= 3), "fulltext").when(chars >= 1000, "partial").when(has_abstract, "abstract").otherwise("metadata")


def with_following(pages: DataFrame) -> DataFrame:
    """pages (source, page, text, ...) with following, the next page's text."""
    w = Window.partitionBy("source").orderBy("page")
    return pages.withColumn("following", F.when(F.lead("page").over(w) == F.col("page") + 1, F.lead("text").over(w)))


def cited_pages(refs: DataFrame, pages: DataFrame) -> DataFrame:
    """[J-14] refs (source, page, ...) with text and following, the cited page's text and the next one's."""
    return refs.join(with_following(pages), ["source", "page"], "left")


def verified_excerpts(refs: DataFrame, pages: DataFrame) -> DataFrame:
    """[F-09] refs (source, page, excerpt, ...) with verified: whether the excerpt stands on its page or runs on into the next. An excerpt meets the
    page that it cites and no other, so what many pages share costs nothing more."""
    forms = page_forms(with_following(pages)).groupBy("source", "page").agg(F.collect_list(F.struct("text", "ends")).alias("_forms"))
    sought = refs.withColumn("_pieces", excerpt_pieces("excerpt")).join(forms, ["source", "page"], "left")
    stands = (F.size("_pieces") > 0) & F.exists("_forms", lambda f: pieces_stand(F.col("_pieces"), f["text"], f["ends"]))
    return sought.select(*refs.columns, F.coalesce(stands, F.lit(False)).alias("verified"))


def holders(paras: DataFrame, strings: DataFrame, squashed: bool = True) -> DataFrame:
    """(string_id, book, chapter, para): every paragraph in which a string stands; white space is left out of both if `squashed`.
    Empty strings stand nowhere."""
    form = (lambda c: T.squash(c)) if squashed else F.col
    texts = paras.select(F.struct("book", "chapter", "para").alias("place"), form("text").alias("text"))
    named = strings.select("string_id", form("string").alias("string"))
    found = found_strings(texts, named).select("string", "place").distinct()
    return named.join(found, "string").select("string_id", "place.book", "place.chapter", "place.para")


def quote_anchors(notes: DataFrame, paras: DataFrame) -> DataFrame:
    """[J-15, V-06] notes (quote_id, book, chapter, at, quote) with status and anchor: ok in the paragraph it names; moved to the first of
    its chapter that holds it; absent; too_short under four characters; out_of_range."""
    sizes = paras.groupBy("book", "chapter").agg(F.count("*").alias("n_paras"))
    # a quote meets the paragraphs of its own chapter only
    wanted = notes.select("quote_id", "book", "chapter", "at", T.squash("quote").alias("wanted")).where("wanted <> ''")
    chapters = wanted.join(paras.select("book", "chapter", "para", T.squash("text").alias("squashed")), ["book", "chapter"]).where(F.contains("squashed", "wanted"))
    hits = chapters.groupBy("quote_id").agg(F.min("para").alias("first"), F.bool_or(F.col("para") == F.col("at")).alias("here"))
    out = notes.join(sizes, ["book", "chapter"], "left").join(hits, "quote_id", "left")
    status = (
        F.when(F.col("n_paras").isNull() | (F.col("at") < 0) | (F.col("at") >= F.col("n_paras")), "out_of_range")
        .when(F.length(T.squash("quote")) < 4, "too_short").when(F.col("here"), "ok").when(F.col("first").isNotNull(), "moved").otherwise("absent")
    )
    return out.withColumn("status", status).withColumn("anchor", F.when(F.col("status") == "ok", F.col("at")).when(F.col("status") == "moved", F.col("first"))).drop("n_paras", "first", "here")


def first_occurrences(concepts: DataFrame, paras: DataFrame) -> DataFrame:
    """[J-16] (concept, chapter, para): the earliest paragraph that holds each concept's name; concepts (concept, book, name)."""
    found = holders(paras, concepts.select(F.col("concept").alias("string_id"), F.col("name").alias("string")), squashed=False).withColumnRenamed("string_id", "concept")
    named = found.join(concepts.select("concept", "book").distinct(), ["concept", "book"], "left_semi")
    return named.groupBy("concept").agg(F.min(F.struct("chapter", "para")).alias("f")).select("concept", "f.chapter", "f.para")


def clustered_notes(notes: DataFrame, sizes: DataFrame, least: int = 30, share: float = 0.4) -> DataFrame:
    """[W-18] (book, chapter): chapters of some length whose notes all stand in the first part."""
    last = notes.groupBy("book", "chapter").agg(F.max("at").alias("last")).join(sizes, ["book", "chapter"])
    return last.where((F.col("n_paras") >= least) & (F.col("last") < share * F.col("n_paras"))).select("book", "chapter")


def image_paragraphs(images: DataFrame, paras: DataFrame) -> DataFrame:
    """[J-27] images (image, book, snippet) with para: the last paragraph that holds the snippet; else the book's last."""
    hit = images.join(paras, "book").where((F.col("snippet") != "") & F.contains(T.squash("text"), T.squash("snippet"))).groupBy("image").agg(F.max("para").alias("hit"))
    last = paras.groupBy("book").agg(F.max("para").alias("last"))
    return images.join(hit, "image", "left").join(last, "book", "left").withColumn("para", F.coalesce("hit", "last")).drop("hit", "last")


def section_text(body: Column, heading: str) -> Column:
    """The text below a second-level heading, trimmed; empty if there is none."""
    pattern = r"(?ms)^##[^\S\n]+" + heading + r"[^\S\n]*\n(.*?)(?=^##\s|\z)"
    return T.strip(F.regexp_extract(F.concat(body, F.lit("\n")), pattern, 1))


def style_violations(notes: DataFrame) -> DataFrame:
    """[V-02] notes (note_id, tier, body): length of the takeaway and of the body, stock phrases, numbers in deep results."""
    body = F.col("body")
    lead = F.when(F.col("tier") == "stub", section_text(body, "一句话定位")).otherwise(section_text(body, "一句话结论"))
    rows = notes.withColumns({"lead": lead, "results": F.regexp_replace(section_text(body, "关键结果"), r"\[[A-Z]\d+\]", ""), "size": F.length(T.squash("body"))})
    limit = F.coalesce(*[F.when(F.col("tier") == t, n) for t, n in BODY_LIMIT.items()])
    stock = F.filter(F.array(*[F.lit(c) for c in CLICHES]), lambda c: F.contains(F.lower("lead"), F.lower(c)))
    return violations(
        rule(rows, "note_id", "takeaway_length", F.length(F.regexp_replace("lead", r"\[[A-Z]\d+\]|\s", "")) > TAKEAWAY_LIMIT),
        rule(rows.withColumn("phrase", F.explode(stock)), "note_id", "cliche", F.lit(True), F.col("phrase")),
        rule(rows, "note_id", "body_length", F.col("size") > limit, F.col("size")),
        rule(rows, "note_id", "results_without_numbers", (F.col("tier") == "deep") & (F.col("results") != "") & ~F.col("results").rlike(r"\d") & ~F.contains("results", F.lit("无定量结果"))),
    )


def tier_lookup(spark) -> DataFrame:
    """[V-03] (level, tier, is_default): what tier of note each level of evidence allows."""
    return spark.createDataFrame([(level, t, t == DEFAULT_TIER[level]) for level, tiers in ALLOWED_TIERS.items() for t in tiers], "level string, tier string, is_default boolean")


def note_violations(notes: DataFrame, claims: DataFrame, refs: DataFrame, pages: DataFrame) -> DataFrame:
    """[V-01] notes (note_id, schema, tier, level, status, body, doi, evidence_doi, source_hash, evidence_hash, analyst, generated_at),
    claims (note_id, claim_id, kind, statement), refs (note_id, claim_id, source, page, excerpt), pages (source, page, text)."""
    n = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    allowed = tier_lookup(notes.sparkSession)
    bad_tier = notes.where("schema = 2").join(F.broadcast(allowed.select("level", "tier")), ["level", "tier"], "left_anti")
    sections = notes.withColumn("section", F.explode(F.coalesce(*[F.when(F.col("tier") == t, F.array(*map(F.lit, s))) for t, s in TIER_SECTIONS.items()])))
    present = F.contains(F.concat(F.lit("\n"), "body", F.lit("\n")), F.concat(F.lit("\n## "), "section", F.lit("\n")))
    counts = claims.groupBy("note_id", "claim_id").agg(F.count("*").alias("times"))
    cited = claims.join(notes.select("note_id", "body"), "note_id")
    used = notes.select("note_id", F.explode(F.array_distinct(F.regexp_extract_all("body", F.lit(r"\[(C\d+)\]"), F.lit(1)))).alias("claim_id"))
    checked = verified_excerpts(refs, pages)
    without = claims.join(refs.select("note_id", "claim_id").distinct(), ["note_id", "claim_id"], "left_anti")
    deep = notes.where("schema = 2 and tier = 'deep'").join(refs.join(pages.select("source", "page"), ["source", "page"], "left_semi").select("note_id").distinct(), "note_id", "left_anti")
    same_doi = T.doi(F.col("doi"), False) == T.doi(F.col("evidence_doi"), False)
    disclosed = F.col("body").rlike("全文.*(?:不可得|缺失|未取得|无法|不完整)|部分全文|仅.*(?:摘要|元数据|页)")
    return violations(
        rule(notes, "note_id", "schema", ~F.coalesce(F.col("schema").isin(1, 2), F.lit(False))),
        rule(bad_tier, "note_id", "tier_not_allowed", F.lit(True), F.col("tier")),
        rule(notes, "note_id", "doi_differs", ~same_doi),
        rule(notes, "note_id", "not_complete", n("status") != "complete"),
        *[rule(notes, "note_id", "missing_" + c, n(c) == "") for c in ("generated_at", "source_hash", "analyst")],
        rule(notes, "note_id", "source_changed", n("source_hash") != n("evidence_hash")),
        rule(sections, "note_id", "missing_section", ~present, F.col("section")),
        rule(notes, "note_id", "placeholder", F.col("body").rlike(r"(?i)\b(TODO|TBD|PLACEHOLDER)\b|待填写|在此填写")),
        rule(notes.join(claims.select("note_id").distinct(), "note_id", "left_anti"), "note_id", "no_claims", F.lit(True)),
        rule(counts, "note_id", "duplicate_claim", F.col("times") > 1, F.col("claim_id")),
        rule(cited, "note_id", "unreferenced_claim", ~F.contains("body", F.concat(F.lit("["), "claim_id", F.lit("]"))), F.col("claim_id")),
        rule(claims, "note_id", "claim_kind", ~F.coalesce(F.col("kind").isin(*CLAIM_KINDS), F.lit(False)), F.col("claim_id")),
        rule(claims, "note_id", "no_statement", n("statement") == "", F.col("claim_id")),
        rule(without, "note_id", "no_evidence", F.lit(True), F.col("claim_id")),
        rule(checked, "note_id", "unverified_excerpt", ~F.col("verified"), F.col("claim_id")),
        rule(used.join(claims, ["note_id", "claim_id"], "left_anti"), "note_id", "undefined_claim", F.lit(True), F.col("claim_id")),
        rule(deep, "note_id", "no_page_cited", F.lit(True)),
        rule(notes, "note_id", "limits_not_told", (F.col("level") != "fulltext") & ~disclosed),
        style_violations(notes.where("schema = 2").select("note_id", "tier", "body")),
    )


def distillation_violations(entries: DataFrame, notes: DataFrame, quiz: DataFrame, concepts: DataFrame, paras: DataFrame, tags: tuple[str, ...]) -> DataFrame:
    """[V-06] The rules of a distilled book: entries (book, chapter, q, route, keys), notes of quote_anchors with tag and text, quiz (book,
    chapter, q, answers, correct), concepts (concept, book, name, one, first_chapter, first_para)."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) == ""
    where = F.concat_ws("/", "book", "chapter")
    anchored = quote_anchors(notes, paras).withColumn("where", F.concat_ws("/", "book", "chapter", "at"))
    chapters = paras.groupBy("book", "chapter").agg(F.count("*").alias("n_paras"), F.sum(F.length("text")).alias("chars"))
    lost = lambda df: df.join(chapters, ["book", "chapter"], "left_anti").withColumn("where", where)
    firsts = first_occurrences(concepts, paras)
    named = concepts.join(firsts, "concept", "left")
    repeated = concepts.groupBy("concept").agg(F.count("*").alias("n"))
    return violations(
        *[rule(entries.withColumn("where", where), "where", "entry_without_" + c, empty(c)) for c in ("q", "route", "keys")],
        rule(lost(entries), "where", "no_such_chapter", F.lit(True)), rule(lost(quiz), "where", "no_such_chapter", F.lit(True)),
        rule(anchored, "where", "note_without_text", empty("text")), rule(anchored, "where", "unusual_tag", ~F.coalesce(F.upper("tag").isin(*tags), F.lit(False)), F.col("tag")),
        rule(anchored, "where", "missing_quote", empty("quote") & (F.col("status") != "out_of_range")), rule(anchored, "where", "quote", ~empty("quote") & F.col("status").isin("too_short", "absent", "moved"), F.col("status")),
        rule(anchored, "where", "out_of_range", F.col("status") == "out_of_range"),
        rule(quiz.withColumn("where", where), "where", "quiz_shape", empty("q") | (F.coalesce(F.size("answers"), F.lit(0)) <= 0) | ~F.coalesce(F.col("correct").between(0, F.size("answers") - 1), F.lit(False))),
        rule(concepts, "concept", "concept_id", ~F.coalesce(F.col("concept").rlike("^[A-Za-z0-9_-]+$"), F.lit(False))), rule(repeated, "concept", "concept_repeated", F.col("n") > 1),
        rule(concepts, "concept", "no_definition", empty("one")), rule(named, "concept", "name_not_in_text", F.col("chapter").isNull(), F.col("name")),
        rule(named, "concept", "first_differs", (F.col("chapter") != F.col("first_chapter")) | (F.col("para") != F.col("first_para")), F.concat_ws("/", "chapter", "para")),
        rule(clustered_notes(notes, chapters).withColumn("where", where), "where", "notes_at_the_start", F.lit(True)),
        rule(chapters.where("chars >= 1500").join(entries, ["book", "chapter"], "left_anti").withColumn("where", where), "where", "no_entry", F.lit(True)),
    )
