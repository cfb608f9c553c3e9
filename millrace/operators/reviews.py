"""Reviews and lectures: evidence lists and matrices, reuse of notes, chapters of books, lint of lectures, checks of input."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .evidence import rule, section_text, violations

# Which section of a note fills which column of the matrix, by the note's tier.
MATRIX = {
    "legacy": {"takeaway": "核心贡献", "question": "背景与研究问题", "method": "关键方法与过程", "results": "结果与对照", "conflicts": "局限与矛盾"},
    "deep": {"takeaway": "一句话结论", "question": "问题与动机", "method": "方法要点", "results": "关键结果", "conflicts": "边界与疑点"},
    "brief": {"takeaway": "一句话结论", "method": "方法定位", "results": "作者声称", "conflicts": "可信度与待核"},
    "stub": {"takeaway": "一句话定位"},
}
MATRIX_COLUMNS = ("takeaway", "question", "method", "results", "conflicts")
BANNED = r"(?i)显然可得|显然有|易得|经过简单计算|不难看出|它是显然|it\s+is\s+obvious|after\s+some\s+algebra|it\s+can\s+be\s+shown|trivially"
HEDGES = r"(?i)约|近似|据报道|一种说法|预印本|大致|可能|区间|据.*记载|medium"


def evidence_matrix(notes: DataFrame) -> DataFrame:
    """[A-26] notes (key, tier, body) with a column for each entry of the matrix; empty where the tier has no such section."""

    def column(name: str) -> Column:
        out = F.lit("")
        for tier, fields in MATRIX.items():
            if name in fields:
                out = F.when(F.col("tier") == tier, section_text(F.col("body"), fields[name])).otherwise(out)
        return out

    return notes.select("key", "tier", *[column(c).alias(c) for c in MATRIX_COLUMNS])


def evidence_list(claims: DataFrame, cards: DataFrame, locators: DataFrame, externals: DataFrame, attachments: str) -> DataFrame:
    """[J-30] (claim_id, key, card, source, page, locator_url): where each review claim's references lead. claims (claim_id, refs
    array<key:card>), cards (key, card, title), locators (key, card, source, page), externals (key, source, attachment, url). An attachment and a
    page make an address into the attachment, by the prefix `attachments`; else a web address counts."""
    refs = claims.select("claim_id", F.explode("refs").alias("ref")).select("claim_id", F.split_part("ref", F.lit(":"), F.lit(1)).alias("key"), F.split_part("ref", F.lit(":"), F.lit(2)).alias("card"))
    rows = refs.join(cards, ["key", "card"]).join(locators, ["key", "card"], "left").join(externals, ["key", "source"], "left")
    attachment = F.coalesce("attachment", F.when(F.col("source").rlike("^[A-Z0-9]{8}$"), F.col("source")))
    inside = F.concat(F.lit(attachments), attachment, F.lit("?page="), F.col("page").cast("string"))
    web = F.when(F.col("url").rlike("^https?://"), F.col("url"))
    return rows.select("claim_id", "key", "card", "title", "source", "page", F.coalesce(F.when(F.coalesce("page", F.lit(0)) > 0, inside), web).alias("locator_url"))


def reusable_notes(archived: DataFrame, current: DataFrame, fields: tuple[str, ...] = ("title", "abstract", "doi", "creators", "date")) -> DataFrame:
    """[P-12] (key, version): the newest archived note of each item that still fits it: the same fields, the same PDF digests in any order, the
    same human notes and annotations. Both tables (key, *fields, pdf_hashes, human_notes, annotations); archived has version too."""
    rest = ("human_notes", "annotations")
    old, new = archived.alias("o"), current.alias("n")
    same = reduce(lambda a, b: a & b, [F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}")) for c in (*fields, *rest)])
    same = same & F.sort_array(F.col("o.pdf_hashes")).eqNullSafe(F.sort_array(F.col("n.pdf_hashes")))
    return old.join(new, F.col("o.key") == F.col("n.key")).where(same).groupBy(F.col("o.key").alias("key")).agg(F.max("o.version").alias("version"))


def book_chapters(blocks: DataFrame, cuts: DataFrame, book: str = "book") -> DataFrame:
    """[S-29, J-17, W-21] (book, chapter, title, paras, heads, frags, images): the stream cut into chapters; a leading heading that repeats the
    title goes, indices of headings and fragments count from 0, and an image stands after the paragraph before it. A chapter is one row."""
    w = Window.partitionBy(book).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    marked = blocks.join(cuts.select(book, "pos", F.col("title").alias("cut")), [book, "pos"], "left")
    marked = marked.withColumns({"start": F.coalesce(F.last(F.when(F.col("cut").isNotNull(), F.col("pos")), True).over(w), F.lit(-1)), "title": F.last("cut", True).over(w)})
    marked = marked.where("kind not in ('warn', 'page')")
    inner = Window.partitionBy(book, "start").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    first = (F.row_number().over(Window.partitionBy(book, "start").orderBy(F.col("kind") == "img", "pos")) == 1) & (F.col("kind") == "heading") & F.coalesce(T.same_title(F.col("text"), F.col("title")), F.lit(False))
    marked = marked.withColumn("repeats", first).where("not repeats")
    marked = marked.withColumn("i", F.count_if(F.col("kind") != "img").over(inner) - 1)
    ordered = lambda c, v: F.transform(F.sort_array(F.collect_list(F.when(c, F.struct(F.col("pos"), v.alias("v"))))), lambda x: x["v"])
    kind = F.col("kind")
    out = marked.groupBy(book, "start").agg(
        F.coalesce(F.first("title"), F.lit("Front matter")).alias("title"), ordered(kind != "img", F.col("text")).alias("paras"), ordered(kind == "heading", F.col("i")).alias("heads"),
        ordered(kind == "fragment", F.col("i")).alias("frags"), ordered(kind == "img", F.struct(F.col("i").alias("after"), F.col("text").alias("src"))).alias("images"),
    )
    number = F.row_number().over(Window.partitionBy(book).orderBy("start")) - 1
    return out.withColumn("chapter", number).select(book, "chapter", "title", "paras", "heads", "frags", "images")


def image_name(ordinal: Column, content: Column, extension: Column) -> Column:
    """[S-29] The file name of an image: its number and the start of its digest."""
    return F.concat(F.lit("i"), F.lpad(ordinal.cast("string"), 4, "0"), F.lit("-"), F.substring(F.sha1(content), 1, 8), extension)


def ranked_report(ranked: DataFrame, key: str = "rank") -> DataFrame:
    """[S-30] One row, report: a line of Markdown for each candidate in order of rank, with a snippet of the abstract. ranked (rank, score,
    title, year, providers, id, abstract); for reading lists of a page's size."""
    head = F.concat(F.col(key).cast("string"), F.lit(". ["), F.format_string("%.2f", "score"), F.lit("] **"), "title", F.lit("** — "), F.concat_ws(" · ", F.coalesce("year", F.lit("?")), F.array_join("providers", "+")), F.lit(" — id `"), "id", F.lit("`"))
    line = F.when(F.coalesce("abstract", F.lit("")) != "", F.concat(head, F.lit("\n   > "), T.snippet(F.col("abstract")))).otherwise(head)
    lines = F.transform(F.sort_array(F.collect_list(F.struct(key, line.alias("line")))), lambda x: x["line"])
    return ranked.agg(F.array_join(lines, "\n").alias("report"))


def lecture_violations(pages: DataFrame) -> DataFrame:
    """[V-11, W-16] pages of markup.lecture_pages for one lecture: ids without gaps, no banned phrase, sources on each page, little prose on
    staged pages, something to look at in the first eleven, and declared objects drawn and carried on."""
    body, option = F.col("body"), lambda n: F.try_element_at("options", F.lit(n))
    objects = F.filter(F.transform(F.split(F.coalesce(option("objects"), F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    rows = pages.withColumns({"want": F.concat(F.lit("P"), F.lpad(F.col("ord").cast("string"), 2, "0")), "objects": objects, "inherits": option("inherits")})
    prose = F.regexp_count(F.substring_index("body", "```", 1), F.lit("[一-鿿]"))
    drawn = F.array_join(F.regexp_extract_all("body", F.lit(r"(?s)<svg.*?</svg>"), F.lit(0)), "")
    hidden = rows.withColumn("drawn", drawn).withColumn("object", F.explode("objects"))
    before = rows.where(F.size("objects") > 0).select(F.col("id").alias("inherits"), F.col("objects").alias("had"))
    broken = rows.join(before, "inherits").withColumn("kept", F.size(F.array_intersect("objects", "had")))
    return violations(
        rule(rows, "id", "page_number", F.col("id") != F.col("want"), F.col("want")), rule(rows, "id", "banned_phrase", body.rlike(BANNED), F.regexp_extract("body", BANNED, 0)),
        rule(rows, "id", "no_sources", ~F.contains("body", F.lit("```sources"))), rule(rows, "id", "too_much_prose", option("mode").isin("theater", "derive") & (prose > 120), prose),
        rule(rows, "id", "nothing_to_see", (F.col("ord") <= 11) & ~body.rlike("```(scene|visual|svg|lab)")),
        rule(hidden, "id", "object_not_drawn", ~F.contains("drawn", F.concat(F.lit('data-obj="'), "object", F.lit('"'))), F.col("object")), rule(broken, "id", "continuity", F.col("kept") == 0, F.col("inherits")),
    )


def claim_violations(claims: DataFrame, sources: DataFrame, pages: DataFrame, bib: DataFrame) -> DataFrame:
    """[V-12] claims of markup.ledger_claims, sources (id) of the dossier, pages (id, body), bib (id): claims and sources that are cited must be
    registered, registered ones cited, and pages that cite uncertain claims must hedge."""
    cited = pages.select(F.col("id").alias("page"), "body", F.explode(F.array_distinct(F.regexp_extract_all("body", F.lit(r"\bC\d{3}\b"), F.lit(0)))).alias("claim"))
    used_sources = pages.select(F.explode(F.regexp_extract_all(F.array_join(F.regexp_extract_all("body", F.lit(r"(?s)```sources\n(.*?)```"), F.lit(1)), " "), F.lit(r"S\d+"), F.lit(0))).alias("id")).distinct()
    named = claims.select("claim", F.explode("sources").alias("id"))
    unsure = cited.join(claims.where("confidence in ('medium', 'low')").select("claim", "confidence"), "claim").where(F.contains("body", F.concat(F.lit("["), "claim", F.lit("]"))))
    return violations(
        rule(cited.join(claims.select("claim"), "claim", "left_anti"), "claim", "unknown_claim", F.lit(True), F.col("page")), rule(named.join(sources.select("id"), "id", "left_anti"), "claim", "unknown_source", F.lit(True), F.col("id")),
        rule(claims.join(cited.select("claim").distinct(), "claim", "left_anti"), "claim", "orphan_claim", F.lit(True)), rule(bib.join(used_sources, "id", "left_anti"), "id", "orphan_source", F.lit(True)),
        rule(unsure, "claim", "not_hedged", ~F.col("body").rlike(HEDGES), F.col("page")),
    )


REVIEW_KINDS = ("reported", "synthesis", "limitation")


def review_violations(reviews: DataFrame, claims: DataFrame, cards: DataFrame, frozen: DataFrame, current: DataFrame) -> DataFrame:
    """[V-04] reviews (review_id, text), claims (review_id, claim_id, kind, statement, refs array<key:card>), cards (key, card) of the notes they
    stand on, and digests of these inputs when the review began and now, both (name, digest). Inputs must be unchanged; claims numbered once
    each, told, of a known kind, cited, and lead to cards; what is cited must be claimed; chapters there, finished, each with a citation."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) == ""
    marks = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit(r"\[(R\d+)\]"), F.lit(1)))
    cited = reviews.select("review_id", F.explode(marks(F.col("text"))).alias("claim_id"))
    own = claims.select("review_id", "claim_id").distinct()
    times = claims.groupBy("review_id", "claim_id").agg(F.count("*").alias("times"))
    refs = claims.select("review_id", "claim_id", F.explode("refs").alias("ref")).distinct()
    told = cards.select(F.concat_ws(":", "key", "card").alias("ref")).distinct()
    lines = reviews.select("review_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    heading = F.col("line").rlike(r"^##\s+\S")
    lines = lines.withColumn("chapter", F.count_if(heading).over(Window.partitionBy("review_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)))
    chapters = lines.where("chapter > 0").groupBy("review_id", "chapter").agg(F.min_by("line", "pos").alias("head"), F.bool_or(F.col("line").rlike(r"\[R\d+\]") & ~heading).alias("cites"))
    both = frozen.withColumnRenamed("digest", "was").join(current, "name", "left")
    without = lambda part: reviews.join(part.select("review_id").distinct(), "review_id", "left_anti")
    return violations(
        rule(both, "name", "input_changed", ~F.col("was").eqNullSafe(F.col("digest"))),
        rule(claims, "review_id", "claim_id", ~F.coalesce(F.col("claim_id").rlike("^R[0-9]+$"), F.lit(False)), F.col("claim_id")), rule(times, "review_id", "claim_repeated", F.col("times") > 1, F.col("claim_id")),
        rule(own.join(cited, ["review_id", "claim_id"], "left_anti"), "review_id", "claim_not_cited", F.lit(True), F.col("claim_id")), rule(cited.join(own, ["review_id", "claim_id"], "left_anti"), "review_id", "undefined_claim", F.lit(True), F.col("claim_id")),
        rule(claims, "review_id", "no_statement", empty("statement"), F.col("claim_id")), rule(claims, "review_id", "claim_kind", ~F.coalesce(F.col("kind").isin(*REVIEW_KINDS), F.lit(False)), F.col("claim_id")),
        rule(claims, "review_id", "no_reference", F.coalesce(F.size("refs"), F.lit(0)) <= 0, F.col("claim_id")), rule(refs.join(told, "ref", "left_anti"), "review_id", "unknown_reference", F.lit(True), F.concat_ws(" ", "claim_id", "ref")),
        rule(reviews, "review_id", "placeholder", F.col("text").rlike(r"(?i)\b(TODO|TBD|PLACEHOLDER)\b|待填写")), rule(without(cited), "review_id", "no_citations", F.lit(True)), rule(without(chapters), "review_id", "no_chapters", F.lit(True)),
        rule(chapters, "review_id", "chapter_without_citation", ~F.col("cites"), T.strip(F.regexp_replace("head", r"^##\s+", ""))),
    )


def input_violations(host_status: DataFrame, host_searches: DataFrame, links: DataFrame, known_items: DataFrame, limits: DataFrame) -> DataFrame:
    """[V-15] host_status (provider, query, status, note) against host_searches; links (item_key, url, source, version) against known_items
    (item_key); limits (name, value)."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) == ""
    status = host_status.withColumn("task", F.concat_ws(":", "provider", "query"))
    missing = reduce(lambda a, b: a | b, map(empty, ("item_key", "url", "source", "version")))
    return violations(
        rule(status.join(host_searches.select("provider", "query"), ["provider", "query"], "left_anti"), "task", "unknown_search", F.lit(True)), rule(status, "task", "status", ~F.coalesce(F.col("status").isin("completed", "blocked", "empty"), F.lit(False))),
        rule(status, "task", "no_note", empty("note")), rule(links, "item_key", "incomplete_link", missing), rule(links.join(known_items.select("item_key"), "item_key", "left_anti"), "item_key", "unknown_item", F.lit(True)),
        rule(limits, "name", "limit_not_positive", F.coalesce(F.col("value") <= 0, F.lit(True)), F.col("value")),
    )


RATE = 24_000  # fixed value: samples in a second


def resampled(samples: Column, rate: Column, to: int = RATE) -> Column:
    """[F-40] Samples at another rate, by linear interpolation."""
    n = F.floor(F.size(samples) * to / rate).cast("int")

    def at(i: Column) -> Column:
        x = i * rate / to
        a = F.floor(x).cast("int")
        left, right = F.get(samples, a), F.get(samples, F.least(a + 1, F.size(samples) - 1))
        return F.floor(left + (right - left) * (x - a) + 0.5).cast("int")

    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), at)).otherwise(F.array().cast("array<int>"))


def trimmed(samples: Column, threshold: int = 300, rate: int = RATE) -> Column:
    """[F-40] Samples without silence at both ends, but for a twenty-fifth of a second."""
    loud = F.filter(F.transform(samples, lambda s, i: F.when(F.abs(s) >= threshold, i)), lambda i: i.isNotNull())
    pad = int(rate * 0.04)
    first, last = F.coalesce(F.array_min(loud), F.size(samples)), F.coalesce(F.array_max(loud), F.size(samples) - 1)
    start = F.greatest(first - pad, F.lit(0))
    return F.slice(samples, start + 1, F.least(F.size(samples), last + 1 + pad) - start)


def mixed(clips: DataFrame, track: str, seconds: Column, rate: int = RATE) -> DataFrame:
    """[F-40] (track, samples): clips (track, ord, start_s, samples) laid over silence; a later clip covers an earlier one. A track is a row."""
    placed = clips.select(track, "ord", F.posexplode("samples").alias("i", "v"), F.floor(F.col("start_s") * rate + 0.5).cast("int").alias("at"), F.ceil(seconds * rate).cast("int").alias("total"))
    heard = placed.select(track, "total", "ord", (F.col("i") + F.col("at")).alias("x"), "v").where("x < total").groupBy(track, "total", "x").agg(F.max_by("v", "ord").alias("v"))
    lengths = clips.groupBy(track).agg(F.max(F.ceil(seconds * rate)).cast("int").alias("total"))
    full = lengths.select(track, F.explode(F.sequence(F.lit(0), F.col("total") - 1)).alias("x")).join(heard.drop("total"), [track, "x"], "left")
    return full.groupBy(track).agg(F.transform(F.sort_array(F.collect_list(F.struct("x", F.coalesce("v", F.lit(0)).alias("v")))), lambda s: s["v"]).alias("samples"))
