"""Parsers, validators and functions on small literal inputs whose results were worked out by hand.

The SQL of such a query is the table of rows that it must return.
"""

from __future__ import annotations

import io
import re
import sqlite3
import zipfile
from contextlib import closing
from functools import wraps

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.functions import udfs as U
from millrace.operators import blocks as B
from millrace.operators import changes as C
from millrace.operators import evals as V
from millrace.operators import evidence as E
from millrace.operators import lint
from millrace.operators import linkage as L
from millrace.operators import ranking as R
from millrace.operators import reviews as W
from millrace.operators import screening as S
from millrace.operators import similarity as J
from millrace.sources import bibliography, markup, sqlite
from millrace.sources import files as X

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
SPARK_TYPES = {"BIGINT": "long", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double", "BOOLEAN": "boolean"}


def literal(value: object) -> str:
    if value is None:
        return "NULL"
    return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else str(value).lower()


def expect(columns: str, *rows: tuple):
    """Registers a function of a session; its rows must be these, in any order."""
    named = [c.split() for c in columns.split(", ")]
    names = ", ".join(n for n, _ in named)
    casts = ", ".join(f"CAST({n} AS {t}) AS {n}" for n, t in named)
    sql = f"SELECT {casts} FROM (VALUES {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in rows)}) AS t({names})"

    def add(f):
        @wraps(f)
        def run(spark, sf):
            return f(spark).select(*[F.col(n).cast(SPARK_TYPES[t]).alias(n) for n, t in named])

        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = run, sql
        return f

    return add


def frame(spark, schema: str, *rows: tuple) -> DataFrame:
    return spark.createDataFrame([tuple(r) for r in rows], schema)


def listed(name: str, sep: str = ","):
    return F.array_join(F.col(name), sep).alias(name)


RULES = "object_id VARCHAR, rule VARCHAR, detail VARCHAR"


# --- functions on text ---


@expect(
    "raw VARCHAR, doi VARCHAR, preprint BOOLEAN",
    (" https://doi.org/10.1/AbC.; ", "10.1/abc", False), ("doi: 10.1/X", "10.1/x", False), ("http://dx.doi.org/10.48550/arXiv.2001.00001", "10.48550/arxiv.2001.00001", True),
    ("10.1101/2020.01.02.123456", "10.1101/2020.01.02.123456", True), ("10.1101/gr.1", "10.1101/gr.1", False), ("10.26434/chemrxiv-1", "10.26434/chemrxiv-1", True), (None, "", False),
)
def doi_forms(spark):
    """[F-02, P-05] DOIs in their bare form, and whether they name a preprint."""
    rows = frame(spark, "raw string", *[(x,) for x in (" https://doi.org/10.1/AbC.; ", "doi: 10.1/X", "http://dx.doi.org/10.48550/arXiv.2001.00001", "10.1101/2020.01.02.123456", "10.1101/gr.1", "10.26434/chemrxiv-1", None)])
    return rows.withColumn("doi", T.doi(F.col("raw"))).withColumn("preprint", T.is_preprint_doi(F.col("doi")))


@expect(
    "url VARCHAR, versioned VARCHAR, base VARCHAR",
    ("http://arxiv.org/pdf/math.GT/0309136v2", "math.GT/0309136v2", "math.GT/0309136"), ("https://arxiv.org/abs/2001.00001v11", "2001.00001v11", "2001.00001"), ("https://arxiv.org/abs/2001.00001", "2001.00001", "2001.00001"), ("https://x.org/abs/2001.00001", None, None),
)
def arxiv_forms(spark):
    """[F-03] arXiv ids with their version, and without it."""
    rows = frame(spark, "url string", ("http://arxiv.org/pdf/math.GT/0309136v2",), ("https://arxiv.org/abs/2001.00001v11",), ("https://arxiv.org/abs/2001.00001",), ("https://x.org/abs/2001.00001",))
    return rows.withColumn("versioned", T.arxiv_id(F.col("url"))).withColumn("base", T.arxiv_base(F.col("versioned")))


@expect("id INTEGER, value VARCHAR", (1, "a b c\n字字"), (2, "one two"), (3, ""))
def inline_forms(spark):
    """[F-06] Blocks' texts without source line breaks, zero-width marks and empty lines."""
    rows = frame(spark, "id int, raw string", (1, " a­ b \u0001 c \n\n 字\u0001 字 "), (2, "one​ \u0001\u0001 two"), (3, " \u0001 "))
    return rows.select("id", T.clean_inline(F.col("raw")).alias("value"))


@expect("a VARCHAR, b VARCHAR, same BOOLEAN", ("Chapter One", "chapter one!", True), ("One", "Chapter One", True), ("", "x", False), ("Two", "Chapter One", False), ("x" * 61, "y" + "x" * 61, False))
def title_matches(spark):
    """[F-11] Titles that are the same but for case, punctuation and a numbering around them."""
    rows = frame(spark, "a string, b string", ("Chapter One", "chapter one!"), ("One", "Chapter One"), ("", "x"), ("Two", "Chapter One"), ("x" * 61, "y" + "x" * 61))
    return rows.withColumn("same", T.same_title(F.col("a"), F.col("b")))


@expect("given VARCHAR, family VARCHAR, name VARCHAR", ("小明", "王", "王小明"), ("Ada", "Ng", "Ada Ng"), (None, "Ng", "Ng"), ("Ada", None, "Ada"))
def person_names(spark):
    """[F-22] Names as one string; CJK names begin with the family's."""
    return frame(spark, "given string, family string", ("小明", "王"), ("Ada", "Ng"), (None, "Ng"), ("Ada", None)).withColumn("name", T.person_name(F.col("given"), F.col("family")))


@expect("spec VARCHAR, value DOUBLE, most DOUBLE", ("13 / max 20", 13.0, 20.0), ("max 25", None, 25.0), ("2.5/3", 2.5, 3.0), ("x / 4", None, 4.0))
def limit_specs(spark):
    """[F-25] A value and its limit."""
    value, most = T.limit_spec(F.col("spec"))
    return frame(spark, "spec string", ("13 / max 20",), ("max 25",), ("2.5/3",), ("x / 4",)).select("spec", value.alias("value"), most.alias("most"))


@expect("a VARCHAR, b VARCHAR, parts VARCHAR, newer BOOLEAN", ("1.10.0", "v1.9.9", "1.10.0", True), ("v2.0.0", "2.0.0", "2.0.0", False), ("x", "1.0.0", None, False), ("0.9.9", "0.9.10", "0.9.9", False))
def version_order(spark):
    """[F-34] Versions by their three numbers."""
    rows = frame(spark, "a string, b string", ("1.10.0", "v1.9.9"), ("v2.0.0", "2.0.0"), ("x", "1.0.0"), ("0.9.9", "0.9.10"))
    return rows.withColumns({"parts": F.array_join(T.semver(F.col("a")), "."), "newer": T.newer(F.col("a"), F.col("b"))})


@expect("source VARCHAR, tier VARCHAR", ("原始论文", "A"), ("Tier B notes", "B"), ("直觉", "C"), ("ANSYS manual", "D"), ("Reddit thread", "E"), ("blog", "other"))
def source_tiers(spark):
    """[F-44] Tiers of sources by ordered rules."""
    return frame(spark, "source string", ("原始论文",), ("Tier B notes",), ("直觉",), ("ANSYS manual",), ("Reddit thread",), ("blog",)).withColumn("tier", T.source_tier(F.col("source")))


@expect(
    "url VARCHAR, allowed BOOLEAN", ("https://ok.org/x", True), ("HTTPS://OK.org/x", False), ("ftp://ok.org", False), ("http://a@ok.org/", False), ("http://no.org", False), ("nonsense", False), (None, False)
)
def url_list(spark):
    """[P-14] Addresses on a list of hosts; schemes are compared as written."""
    rows = frame(spark, "url string", *[(u,) for u in ("https://ok.org/x", "HTTPS://OK.org/x", "ftp://ok.org", "http://a@ok.org/", "http://no.org", "nonsense", None)])
    return rows.withColumn("allowed", T.url_allowed(F.col("url"), ["ok.org"]))


@expect("path VARCHAR, allowed BOOLEAN", ("/r/a/b", True), ("/r/a", True), ("/r/a/../b", False), ("/r/ab", False), ("r/a/b", False), (None, False))
def path_list(spark):
    """[P-15] Paths below a root."""
    return frame(spark, "path string", ("/r/a/b",), ("/r/a",), ("/r/a/../b",), ("/r/ab",), ("r/a/b",), (None,)).withColumn("allowed", T.path_allowed(F.col("path"), ["/r/a"]))


@expect("query VARCHAR, years VARCHAR, url VARCHAR", ("a b", "2018:2020", "http://h?&as_ylo=2018&as_yhi=2020&q=a+b"), ("c&d", "", "http://h?&q=c%26d"), ("x", "2020", "http://h?&as_ylo=2020&as_yhi=2020&q=x"))
def search_urls(spark):
    """[F-20] Search addresses with bounds of years."""
    return frame(spark, "query string, years string", ("a b", "2018:2020"), ("c&d", ""), ("x", "2020")).withColumn("url", T.search_url("http://h?", F.col("query"), F.col("years")))


@expect("id INTEGER, sentence VARCHAR", (1, "See e.g. this one."), (1, "And that!"), (1, "好。"), (2, "Version 1.2 runs."), (2, "Cf. Fig. 3 here"))
def sentence_cases(spark):
    """[F-30] Sentences; abbreviations and decimals do not end one."""
    return frame(spark, "id int, raw string", (1, "See e.g. this one. And that! 好。"), (2, "Version 1.2 runs. Cf. Fig. 3 here")).select("id", F.explode(T.sentences(F.col("raw"))).alias("sentence"))


@expect("id INTEGER, plain VARCHAR", (1, "a  é<"), (2, "x & y"), (3, ""))
def html_texts(spark):
    """[F-04] Text without tags, with all entities read."""
    return frame(spark, "id int, raw string", (1, "<p>a <b>&eacute;&lt;</b></p>"), (2, "x &amp; y"), (3, None)).select("id", U.unescape_html(T.strip_tags(F.col("raw"))).alias("plain"))


@expect("a VARCHAR, b VARCHAR, ratio DOUBLE", ("tide", "diet", 0.25), ("diet", "tide", 0.5), ("abcd", "bcde", 0.75), ("", "", 1.0), ("abc", "xyz", 0.0))
def matcher_ratios(spark):
    """[F-18] The ratio of the standard library's matcher, which depends on the order of its arguments."""
    return frame(spark, "a string, b string", ("tide", "diet"), ("diet", "tide"), ("abcd", "bcde"), ("", ""), ("abc", "xyz")).withColumn("ratio", U.matcher_ratio("a", "b"))


@expect("id INTEGER, form VARCHAR", (1, "methodfi"), (2, "\"it's\"-x"), (3, "twowords"))
def comparable_texts(spark):
    """[F-08] Texts in the form in which excerpts are compared."""
    return frame(spark, "id int, raw string", (1, "Meth-\nOd ﬁ"), (2, "“It’s”–x"), (3, "two­ wo​rds")).select("id", U.comparable("raw").alias("form"))


@expect("n INTEGER, page INTEGER, verified BOOLEAN", (1, 1, True), (2, 1, True), (3, 1, True), (4, 1, False), (5, 1, True), (6, 2, False), (7, 1, False))
def excerpt_checks(spark):
    """[F-09, J-14] Excerpts against the page they cite, and the page after it."""
    pages = frame(spark, "source string, page int, text string", ("p", 1, "a meth-\nod that: the meth-\nod works. First part is long, then second part runs onto"), ("p", 2, "the next page here"))
    refs = frame(spark, "n int, source string, page int, excerpt string", (1, "p", 1, "the method works"), (2, "p", 1, "first part is … second part"), (3, "p", 1, "second part runs onto the next page"), (4, "p", 1, "second part … first part is"), (5, "p", 1, "that: the method"), (6, "p", 2, "second part runs onto the next"), (7, "p", 1, "a … b"))
    return E.verified_excerpts(refs, pages)


@expect("id INTEGER, report VARCHAR", (1, '{"a": {"b": 1}, "run_id": "r"}'), (2, '{"run_id": "r"}'), (3, None), (4, None), (5, None))
def salvaged_reports(spark):
    """[S-21] The one report that ends an answer."""
    rows = frame(spark, "id int, raw string", (1, 'Done.\n```json\n{"run_id": "r", "a": {"b": 1}}\n```'), (2, 'text {"x": 1} then {"run_id": "r"}'), (3, '{"run_id": "r"} and more'), (4, '{"run_id": 1} {"run_id": 2}'), (5, "none"))
    return rows.select("id", U.salvaged_report("raw").alias("report"))


@expect("id INTEGER, format VARCHAR, width INTEGER, height INTEGER", (1, "png", 640, 480), (2, "gif", 3, 4), (3, "jpeg", 9, 7), (4, None, None, None))
def image_headers(spark):
    """[F-39] Sizes from the headers of images."""
    raw = frame(spark, "id int, h string", (1, "89504E470D0A1A0A0000000D4948445200000280000001E0"), (2, "47494638396103000400"), (3, "FFD8FFE000046162FFC0001108000700090300000000000000000000"), (4, "6E6F"))
    return raw.select("id", U.image_size(F.unhex("h")).alias("s")).select("id", "s.*")


@expect("id INTEGER, decoded VARCHAR, uri VARCHAR", (1, "字", "data:x/y;base64,19Y="), (2, "é", "data:x/y;base64,6Q=="), (3, "é", "data:x/y;base64,w6k="))
def byte_texts(spark):
    """[F-38, S-26] Bytes as text by their charset or the next that fits, and as addresses of data."""
    raw = frame(spark, "id int, h string, charset string", (1, "D7D6", None), (2, "E9", "latin-1"), (3, "C3A9", "bad"))
    return raw.select("id", U.decode_bytes(F.unhex("h"), "charset").alias("decoded"), U.data_uri(F.unhex("h"), F.lit("x/y")).alias("uri"))


@expect("id INTEGER, places VARCHAR", (1, "0,8"), (2, "0,3"), (3, ""))
def leftmost_places(spark):
    """[O-09] Matches of names from the left, the longest at a place, without overlap."""
    rows = frame(spark, "id int, t string, n array<string>", (1, "one two one", ["on", "one", "e t"]), (2, "abcabc", ["abc", "bca"]), (3, "x", []))
    return rows.select("id", F.array_join(U.leftmost_matches("t", "n").cast("array<string>"), ",").alias("places"))


@expect("id INTEGER, resampled VARCHAR, trimmed VARCHAR", (1, "0,5,10,15,20,25,30,30", "200,400,600"), (2, "", ""))
def sound_forms(spark):
    """[F-40] Samples at twice the rate, and without silence at both ends."""
    rows = frame(spark, "id int, s array<int>, r int", (1, [0, 10, 20, 30], 2), (2, [], 2))
    text = lambda c: F.array_join(c.cast("array<string>"), ",")
    return rows.select("id", text(W.resampled(F.col("s"), F.col("r"), 4)).alias("resampled"), text(W.trimmed(F.transform("s", lambda x: x * 20), rate=25)).alias("trimmed"))


@expect("t INTEGER, samples VARCHAR", (1, "1,1,5,5"), (2, "0,0,0,7"))
def sound_mixes(spark):
    """[F-40] Clips laid over silence."""
    clips = frame(spark, "t int, ord int, start_s double, samples array<int>", (1, 0, 0.0, [1, 1, 1]), (1, 1, 0.5, [5, 5, 5, 5]), (2, 0, 0.75, [7, 7]))
    return W.mixed(clips, "t", F.lit(1.0), rate=4).select("t", F.array_join(F.col("samples").cast("array<string>"), ",").alias("samples"))


# --- marked-up sources ---

PAGE = '<html><head><title>no</title></head><body><div><h1 id="a">T&amp;T</h1><div><p>one<br>two <ruby>字<rt>zi</rt></ruby></p>three</div><ul><li>item<li>next</ul><pre> x\n y</pre><img src="p.png"><blockquote>q</blockquote><script>no</script></div>'


@expect(
    "pos BIGINT, event VARCHAR, kind VARCHAR, value VARCHAR",
    (0, "anchor", None, "a"), (1, "text", "heading", "T&T"), (2, "text", "para", "one\ntwo 字"), (3, "text", "para", "three"), (4, "text", "item", "item"), (5, "text", "item", "next"), (6, "text", "pre", " x\n y"), (7, "img", None, "p.png"), (8, "text", "quote", "q"),
)
def html_cases(spark):
    """[S-05] A page as events: anchors, texts of blocks, images."""
    return markup.html_blocks(frame(spark, "page_id int, html string", (1, PAGE)))


def _epub() -> bytearray:
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="O/c.opf"/></rootfiles></container>')
        z.writestr("O/c.opf", '<package xmlns:dc="d"><metadata><dc:title>B</dc:title></metadata><manifest><item id="i" href="one.xhtml"/><item id="n" href="nav.xhtml" properties="nav"/></manifest><spine><itemref idref="i"/></spine></package>')
        z.writestr("O/one.xhtml", "<html><body><h1 id='s'>One</h1><p>Text</p></body></html>")
        z.writestr("O/nav.xhtml", '<html xmlns:epub="e"><body><nav epub:type="toc"><ol><li><a href="one.xhtml#s">One</a><ol><li><a href="one.xhtml">Sub</a></li></ol></li></ol></nav></body></html>')
    return bytearray(raw.getvalue())


@expect("book VARCHAR, pos BIGINT, doc VARCHAR, event VARCHAR, value VARCHAR", ("b.epub", 0, "O/one.xhtml", "anchor", "s"), ("b.epub", 1, "O/one.xhtml", "text", "One"), ("b.epub", 2, "O/one.xhtml", "text", "Text"))
def epub_blocks(spark):
    """[S-03, S-05] The blocks of a book in reading order."""
    return markup.read_epub(frame(spark, "path string, content binary", ("b.epub", _epub())))[0]


@expect("ord BIGINT, level INTEGER, title VARCHAR, doc VARCHAR, fragment VARCHAR", (0, 1, "One", "O/one.xhtml", "s"), (1, 2, "Sub", "O/one.xhtml", ""))
def epub_contents(spark):
    """[S-04] Its nested table of contents."""
    return markup.read_epub(frame(spark, "path string, content binary", ("b.epub", _epub())))[1]


PANELS = "---\ntitle: T\ncols: 3\n---\nintro\n## A First {span=2}\ntext\n```kv cols=2\nk: v\n## not a panel\n```\nafter\n## Second\n~~~\n~~~\n## B Third\r\nx"


@expect(
    "panel BIGINT, type VARCHAR, lang VARCHAR, args VARCHAR, text VARCHAR",
    (0, "md", None, None, "intro"), (1, "md", None, None, "text"), (1, "fence", "kv", "cols=2", "k: v\n## not a panel"), (1, "md", None, None, "after"), (2, "fence", "", "", ""), (3, "md", None, None, "x"),
)
def panel_cases(spark):
    """[S-22] The blocks of a panel document."""
    return markup.panel_blocks(frame(spark, "d int, text string", (1, PANELS)), "d")


@expect("panel INTEGER, id VARCHAR, title VARCHAR, attrs VARCHAR", (1, "A", "First", "span=2"), (2, "C", "Second", ""), (3, "B", "Third", ""))
def panel_titles(spark):
    """[S-22] Its headings with their letters."""
    return markup.panel_headings(frame(spark, "d int, text string", (1, PANELS)), "d")


@expect("d INTEGER, key VARCHAR, value VARCHAR, body VARCHAR", (1, "title", "T", "x"), (1, "cols", "3", "x"), (3, "a", "2", ""))
def frontmatter_cases(spark):
    """[S-23] Metadata in front of a document; the last of equal keys counts."""
    docs = frame(spark, "d int, text string", (1, "---\ntitle: T\ncols: 3\n---\nx"), (2, "no head\n---\n"), (3, "---\na: 1\n# note\na: 2\n---\n"))
    meta, body = markup.frontmatter(F.col("text"))
    return docs.select("d", F.explode(meta).alias("key", "value"), body.alias("body"))


LECTURE = "---\ntitle: L\n---\n```bib\nS1: [A book](http://x) — review\n```\n## P01 · Start {mode=theater objects=a,b}\nbody C001\n## P02 Next\nmore"


@expect("ord BIGINT, id VARCHAR, title VARCHAR, options VARCHAR, body VARCHAR", (1, "P01", "Start", '{"mode":"theater","objects":"a,b"}', "body C001"), (2, "P02", "Next", "{}", "more"))
def lecture_cases(spark):
    """[S-24] The pages of a lecture."""
    return markup.lecture_pages(frame(spark, "d int, text string", (1, LECTURE)), "d").withColumn("options", F.to_json("options"))


@expect("id VARCHAR, title VARCHAR, url VARCHAR, note VARCHAR", ("S1", "A book", "http://x", "review"))
def lecture_sources(spark):
    """[S-24] Its registered sources."""
    return markup.bib_entries(frame(spark, "d int, text string", (1, LECTURE)), "d")


@expect("claim VARCHAR, sources VARCHAR, confidence VARCHAR, used VARCHAR", ("C001", "S1,S2", "medium", "P01,P03"), ("C002", "", "high", ""))
def ledger_cases(spark):
    """[S-25] A ledger of claims; an escaped bar is part of its cell."""
    lines = frame(spark, "line string", ("| C001 | a \\| b | t | S1, S2 | Medium | - | P01 P03 |",), ("| x | y |",), ("| C002 | a | t |  |  | - | |",))
    return markup.ledger_claims(lines).select("claim", listed("sources"), "confidence", listed("used"))


@expect("question VARCHAR, options VARCHAR, feedback VARCHAR", ("What is it?", "no/false,yes/true", "because\nso"), ("Q", "a/true", ""))
def quiz_cases(spark):
    """[S-34] Questions, options and feedback."""
    question, options, feedback = markup.quiz_parts(F.col("b"))
    rows = frame(spark, "b string", ("What is\nit?\n- no\n- [x] yes\n?? because\nso",), ("Q\n- [x] a",))
    return rows.select(question.alias("question"), F.array_join(F.transform(options, lambda o: F.concat_ws("/", o["text"], o["right"].cast("string"))), ",").alias("options"), feedback.alias("feedback"))


@expect("id INTEGER, beats INTEGER", (1, 4), (2, 0), (3, 12))
def scene_cases(spark):
    """[A-23, S-34] The last beat that a scene names."""
    return frame(spark, "id int, b string", (1, '<svg data-beat="2"></svg><b4>x</b4>'), (2, "none"), (3, '<g data-beat="12"/><g data-beat="3"/>')).select("id", markup.scene_beats(F.col("b")).alias("beats"))


@expect("line VARCHAR, moment VARCHAR, title VARCHAR, detail VARCHAR, star BOOLEAN", ("*Now | Free | by all", "Now", "Free", "by all", True), ("1990 | Start", "1990", "Start", "", False))
def timeline_cases(spark):
    """[S-35] Lines of a timeline."""
    at, title, detail, star = markup.timeline_items(F.col("line"))
    return frame(spark, "line string", ("*Now | Free | by all",), ("1990 | Start",)).select("line", at.alias("moment"), title.alias("title"), detail.alias("detail"), star.alias("star"))


def _steps(spark) -> DataFrame:
    return markup.sequence_steps(frame(spark, "d int, pos int, line string", (1, 0, "Ann -> Bob: hi"), (1, 1, "Bob --> Cid: yes"), (1, 2, "note Ann: x"), (1, 3, "== end =="), (1, 4, "// no")), "d")


@expect(
    "pos INTEGER, kind VARCHAR, sender VARCHAR, receiver VARCHAR, dashed BOOLEAN, label VARCHAR",
    (0, "message", "Ann", "Bob", False, "hi"), (1, "message", "Bob", "Cid", True, "yes"), (2, "note", None, None, False, "x"), (3, "divider", None, None, False, "end"),
)
def sequence_cases(spark):
    """[S-35] Messages, notes and dividers of a sequence."""
    return _steps(spark)


@expect("name VARCHAR, ord INTEGER", ("Ann", 1), ("Bob", 2), ("Cid", 3))
def sequence_names(spark):
    """[S-35] Who takes part, by first appearance."""
    return markup.participants(_steps(spark), "d")


@expect("line VARCHAR, beat VARCHAR, focus VARCHAR", ("> Look at [the node] here", "Look at the node here", "the node"), ("plain", None, None), ("> No mark", "No mark", None), (">", None, None))
def narration_cases(spark):
    """[S-36] Spoken lines and what they point at."""
    return markup.narration(frame(spark, "line string", ("> Look at [the node] here",), ("plain",), ("> No mark",), (">",)))


FLOW = "A & B -> [C] --> *D: done\n{C}\ngroup G: A, Z\n// note"


@expect("id VARCHAR, shape VARCHAR, highlighted BOOLEAN", ("A", "rect", False), ("B", "rect", False), ("C", "diamond", False), ("D", "rect", True))
def flow_nodes(spark):
    """[G-04] The nodes of a flow; the last explicit shape counts."""
    return markup.read_flows(frame(spark, "d int, text string", (1, FLOW)), "d")[0]


@expect("source VARCHAR, target VARCHAR, dashed BOOLEAN, label VARCHAR", ("A", "C", False, ""), ("B", "C", False, ""), ("C", "D", True, "done"))
def flow_edges(spark):
    """[G-04, J-24] Its edges: every node of a step with every node of the next."""
    return markup.read_flows(frame(spark, "d int, text string", (1, FLOW)), "d")[1]


@expect("name VARCHAR, member VARCHAR, known BOOLEAN", ("G", "A", True), ("G", "Z", False))
def flow_groups(spark):
    """[G-04] Its groups, and whether their members are nodes."""
    return markup.read_flows(frame(spark, "d int, text string", (1, FLOW)), "d")[2]


@expect("ord BIGINT, title VARCHAR, year VARCHAR, authors VARCHAR, doi VARCHAR", (0, "The Big One", "2020", "Ng, A.;Li, B.", "10.1/x"), (1, "Two", None, "", None))
def bibtex_cases(spark):
    """[S-11] Records of a BibTeX export."""
    text = '@article{k1, title = {The {B}ig One}, author={Ng, A. and Li, B.}, year = 2020, doi="10.1/x"}\n@comment{x}\n@book{k2, title={Two}}'
    return bibliography.read_bibtex(frame(spark, "path string, value string", ("f", text))).withColumn("authors", F.array_join("authors", ";"))


@expect("record BIGINT, title VARCHAR, year VARCHAR, authors VARCHAR", (1, "One", "2020", "Ng;Li"), (2, "Two", None, ""))
def ris_cases(spark):
    """[S-12] Records of a RIS export; a year is the first four characters."""
    lines = ("TY  - JOUR", "TI  - One", "AU  - Ng", "AU  - Li", "PY  - 2020/01", "ER  - ", "TY  - BOOK", "T1  - Two", "ER  - ")
    return bibliography.read_ris(frame(spark, "f string, pos int, line string", *[("f", i, x) for i, x in enumerate(lines)]), "f").withColumn("authors", F.array_join("authors", ";"))


@expect("body VARCHAR", ('{"id": 3, "r": 1}',))
def sse_cases(spark):
    """[S-19] The event with the wanted id."""
    return X.sse_events(frame(spark, "value string", ('data: {"id": 3, "r": 1}',), ('data: {"id": 4}',), ("event: x",), ("data: broken",)), F.lit(3))


@expect("bundle VARCHAR", ('[{"o":1,"t":"a"},{"o":2,"t":"<\\/script>"}]',))
def bundle_cases(spark):
    """[S-33] Rows as JSON that may stand in a page."""
    return X.json_bundle(frame(spark, "o int, t string", (2, "</script>"), (1, "a")), "o")


# --- books ---


@expect("para BIGINT, text VARCHAR", (1, "One ends."), (2, "Two goes on hyphenated."), (3, "Gap."), (4, "Big"))
def paragraph_cases(spark):
    """[W-04, F-05] Lines of a page as paragraphs: by indents, gaps and sizes."""
    line = lambda n, text, x0, y0, size=10.0: (1, n, text, size, x0, y0, y0 + 10)
    lines = frame(spark, "block int, line int, text string, size double, x0 double, y0 double, y1 double", line(0, "One ends.", 0.0, 0.0), line(1, "Two goes on hyphen-", 20.0, 12.0), line(2, "ated.", 0.0, 24.0), line(3, "Gap.", 0.0, 60.0), line(4, "Big", 0.0, 72.0, 14.0))
    return B.join_paragraphs(B.paragraph_groups(lines))


@expect("book VARCHAR, pos INTEGER, kind VARCHAR, text VARCHAR", ("b", 0, "para", "It was the way of things."), ("b", 1, "page", ""), ("b", 3, "para", "New one."), ("b", 4, "heading", "A title"), ("c", 0, "para", "Big"), ("c", 1, "para", "small size"))
def continuation_cases(spark):
    """[W-05] Paragraphs over a page break and headings of two lines joined."""
    rows = [("b", 0, "para", "It was the", 1, 10.0, False), ("b", 1, "page", "", 2, 0.0, False), ("b", 2, "para", "way of things.", 2, 10.0, True), ("b", 3, "para", "New one.", 2, 10.0, True), ("b", 4, "heading", "A", 2, 20.0, False), ("b", 5, "heading", "title", 2, 20.0, False)]
    rows += [("c", 0, "para", "Big", 1, 14.0, False), ("c", 1, "para", "small size", 1, 10.0, True)]
    return B.merge_continuations(frame(spark, "book string, pos int, kind string, text string, page int, size double, cont boolean", *rows))


def _located(spark) -> DataFrame:
    toc = frame(spark, "ord int, level int, title string, doc string, fragment string", (0, 1, "Part", "a", ""), (1, 2, "One", "a", "x"), (2, 2, "Two", "b", "gone"), (3, 2, "Lost", "z", ""), (4, 3, "Inner", "a", "x"))
    return B.toc_positions(toc, frame(spark, "doc string, fragment string, pos int", ("a", "x", 5), ("a", "", 0)), frame(spark, "doc string, pos int", ("a", 0), ("b", 9))).withColumn("book", F.lit("k"))


@expect("ord INTEGER, title VARCHAR, pos INTEGER", (0, "Part", 0), (1, "One", 5), (2, "Two", 9), (4, "Inner", 5))
def contents_places(spark):
    """[J-18] Where entries of a table of contents stand."""
    return _located(spark)


@expect("book VARCHAR, best INTEGER", ("k", 2))
def contents_levels(spark):
    """[A-27] The level at which a book is cut."""
    return B.toc_level(_located(spark))


@expect("book VARCHAR, pos INTEGER, title VARCHAR", ("k", 0, "Part"), ("k", 5, "One"), ("k", 9, "Two"))
def contents_cuts(spark):
    """[W-12] Where its chapters begin; of several entries in one place the outermost counts."""
    return B.toc_cuts(_located(spark))


@expect("book VARCHAR, pos INTEGER, title VARCHAR", ("k", 0, "A"), ("k", 4, "B"), ("k", 8, "C"), ("n", 0, "Chapter 1"), ("n", 3, "chapter 2"), ("n", 6, "Chapter 3"))
def heading_tier_cases(spark):
    """[W-19] Cuts at headings without a table of contents: by the largest sizes, or by names of chapters."""
    rows = [("k", p, "heading", t, s) for p, t, s in ((0, "A", 20.0), (1, "a", 14.0), (4, "B", 20.0), (5, "b", 14.0), (8, "C", 20.0))]
    rows += [("n", p, "heading", t, s) for p, t, s in ((0, "Chapter 1", 12.0), (1, "Huge", 30.0), (3, "chapter 2", 12.0), (6, "Chapter 3", 12.0))]
    return B.heading_tiers(frame(spark, "book string, pos int, kind string, text string, size double", *rows), frame(spark, "book string, length int", ("k", 12), ("n", 8)))


def _stream(spark) -> DataFrame:
    return frame(spark, "book string, pos int, kind string, text string, page int", ("b", 0, "page", "", 1), ("b", 1, "para", "x", None), ("b", 2, "page", "", 2), ("b", 3, "img", "", None), ("b", 4, "heading", "The End", None), ("b", 5, "para", "y", None), ("b", 6, "img", "", None))


@expect("ord INTEGER, pos INTEGER", (0, 4), (1, 0))
def heading_places(spark):
    """[J-19] Entries at their heading on the page, else at the page's top."""
    return B.heading_on_page(frame(spark, "book string, ord int, title string, page int", ("b", 0, "the end!", 2), ("b", 1, "none", 1)), _stream(spark))


@expect("pos INTEGER, after BIGINT", (3, 0), (6, 2))
def image_places(spark):
    """[W-21] Images behind the paragraph before them."""
    return B.image_anchors(_stream(spark), "book")


@expect("image INTEGER", (1,), (7,))
def image_filter(spark):
    """[P-11] Images of some size that are used three times at most."""
    return B.rare_images(frame(spark, "image int, bytes int, hash string", (1, 20_000, "a"), (2, 100, "b"), *[(3 + i, 20_000, "c") for i in range(4)], (7, 10_240, "d"), (8, 10_239, "d")))


@expect(
    "chapter INTEGER, title VARCHAR, paras VARCHAR, heads VARCHAR, frags VARCHAR, images VARCHAR",
    (0, "Front matter", "before", "", "", ""), (1, "one!", "x|f|Sub|y", "2", "1", "-1:a.png,1:b.png"),
)
def chapter_cases(spark):
    """[S-29, J-17] A stream cut into chapters, with indices of headings, fragments and images."""
    kinds = [("para", "before"), ("page", ""), ("heading", "One"), ("img", "a.png"), ("para", "x"), ("fragment", "f"), ("img", "b.png"), ("heading", "Sub"), ("para", "y")]
    out = W.book_chapters(frame(spark, "book string, pos int, kind string, text string", *[("b", i, k, t) for i, (k, t) in enumerate(kinds)]), frame(spark, "book string, pos int, title string", ("b", 2, "one!")))
    number = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    images = F.array_join(F.transform("images", lambda i: F.concat_ws(":", i["after"].cast("string"), i["src"])), ",").alias("images")
    return out.select("chapter", "title", listed("paras", "|"), number("heads"), number("frags"), images)


@expect("name VARCHAR", ("i0007-11f6ad8e.png",))
def image_names(spark):
    """[S-29] The file name of an image."""
    return frame(spark, "h string", ("78",)).select(W.image_name(F.lit(7), F.unhex("h"), F.lit(".png")).alias("name"))


@expect("report VARCHAR", ("1. [2.50] **A** — 2020 · p+q — id `x`\n   > long text\n2. [1.00] **B** — ? · q — id `y`",))
def report_cases(spark):
    """[S-30, F-37] A reading list in Markdown."""
    return W.ranked_report(frame(spark, "rank int, score double, title string, year string, providers array<string>, id string, abstract string", (2, 1.0, "B", None, ["q"], "y", ""), (1, 2.5, "A", "2020", ["p", "q"], "x", "long  text")))


@expect("rule VARCHAR, detail VARCHAR", ("word", "prior to"), ("word", "utilize"), ("passive", "was opened"), ("sentence-length", "22"), ("cliche", "全方位"), ("cliche", "赋能"), ("paragraph-length", "9"))
def lint_cases(spark):
    """[V-10, W-17] Findings in a text that breaks several rules of style; chains of particles are left to a count of their own."""
    text = "# Head\nWe utilize it prior to use. The door was opened by him.\n\n1. " + "word " * 22 + "\n这是我的你的他的书。全方位赋能。\n" + "A b c. " * 7
    return lint.findings(B.explode_lines(frame(spark, "doc_id int, text string", (1, text))), "doc_id").where("rule <> 'de-chain'")


# --- notes, quotes, concepts, reviews ---


def _paras(spark) -> DataFrame:
    return frame(spark, "book string, chapter int, para int, text string", ("b", 0, 0, "The quick brown fox"), ("b", 0, 1, "jumps over a lazy dog"), ("b", 1, 0, "The quick  brown fox again"))


def _notes(spark) -> DataFrame:
    return frame(spark, "quote_id int, book string, chapter int, at int, quote string", (1, "b", 0, 0, "quick brown"), (2, "b", 0, 0, "lazy dog"), (3, "b", 0, 1, "invented thing"), (4, "b", 0, 9, "quick"), (5, "b", 0, 0, "ab"), (6, "b", 1, 0, "quickbrown"))


def _concepts(spark) -> DataFrame:
    return frame(spark, "concept string, book string, name string, one string, first_chapter int, first_para int", ("fox", "b", "brown fox", "x", 0, 0), ("dog", "b", "dog", "x", 1, 0), ("none", "b", "cat", "", 0, 0), ("bad id", "b", "The", "x", 0, 0))


@expect("quote_id INTEGER, status VARCHAR, anchor INTEGER", (1, "ok", 0), (2, "moved", 1), (3, "absent", None), (4, "out_of_range", None), (5, "too_short", None), (6, "ok", 0))
def quote_cases(spark):
    """[J-15] Quotes in the paragraph they name, or in the first of the chapter that holds them."""
    return E.quote_anchors(_notes(spark), _paras(spark))


@expect("concept VARCHAR, chapter INTEGER, para INTEGER", ("fox", 0, 0), ("dog", 0, 1), ("bad id", 0, 0))
def concept_places(spark):
    """[J-16] The first paragraph that holds each concept's name."""
    return E.first_occurrences(_concepts(spark), _paras(spark))


@expect("image INTEGER, para INTEGER", (1, 1), (2, 1), (3, 0))
def image_paragraph_cases(spark):
    """[J-27] Images at the last paragraph with their snippet, else at the end."""
    return E.image_paragraphs(frame(spark, "image int, book string, snippet string", (1, "b", "lazy"), (2, "b", "zzz"), (3, "b", "quickbrown")), _paras(spark).where("chapter = 0"))


@expect(
    RULES,
    ("b/7", "entry_without_route", None), ("b/7", "no_such_chapter", None), ("b/0/0", "quote", "moved"), ("b/0/1", "quote", "absent"), ("b/0/0", "quote", "too_short"), ("b/0/9", "out_of_range", None), ("b/0", "quiz_shape", None),
    ("bad id", "concept_id", None), ("none", "no_definition", None), ("none", "name_not_in_text", "cat"), ("dog", "first_differs", "0/1"),
)
def distillation_cases(spark):
    """[V-06] The rules of a distilled book, broken."""
    full = _notes(spark).withColumns({"tag": F.lit("NOTE"), "text": F.lit("t")})
    entries = frame(spark, "book string, chapter int, q string, route string, keys string", ("b", 0, "q", "r", "k"), ("b", 7, "q", "", "k"))
    quiz = frame(spark, "book string, chapter int, q string, answers array<string>, correct int", ("b", 0, "q", ["x", "y"], 1), ("b", 0, "q", ["x"], 5))
    return E.distillation_violations(entries, full, quiz, _concepts(spark), _paras(spark), ("NOTE",))


@expect("concept VARCHAR, survivor INTEGER, merged BIGINT, one VARCHAR, rel VARCHAR", ("a", 0, 2, "first", "x,y,z"), ("b", 1, 1, "only", ""))
def concept_merges(spark):
    """[A-24] Concepts that several parts define: the first definition and all relations."""
    rows = frame(spark, "concept string, ord int, one string, rel array<string>", ("a", 0, "first", ["x", "y"]), ("b", 1, "only", []), ("a", 2, "second", ["y", "z"]))
    return L.merge_first(rows, "concept", "ord", ("one",), ("rel",)).withColumn("rel", F.array_join("rel", ","))


BODY = "## 一句话结论\n\nIt is 3 [C1].\n\n## 作者声称\n\nx\n\n## 方法定位\nx\n## 可信度与待核\nx\n## 关联与启发\n仅有摘要\n"
NOTE = "note_id string, schema int, tier string, level string, status string, body string, doi string, evidence_doi string, source_hash string, evidence_hash string, analyst string, generated_at string"


@expect(
    RULES,
    ("n2", "tier_not_allowed", "deep"), ("n2", "doi_differs", None), ("n2", "not_complete", None), ("n2", "missing_analyst", None), ("n2", "source_changed", None), ("n2", "placeholder", None), ("n2", "duplicate_claim", "C1"),
    ("n2", "unreferenced_claim", "C1"), ("n2", "unreferenced_claim", "C1"), ("n2", "claim_kind", "C1"), ("n2", "no_statement", "C1"), ("n2", "unverified_excerpt", "C1"), ("n2", "undefined_claim", "C9"), ("n2", "cliche", "groundbreaking"),
    *[("n2", "missing_section", s) for s in ("问题与动机", "核心思路", "方法要点", "关键结果", "边界与疑点", "代码、数据与复现", "证据索引")],
)
def note_cases(spark):
    """[V-01, V-02] A note that holds and one that breaks the rules."""
    good = ("n1", 2, "brief", "abstract", "complete", BODY, "10.1/X", "doi:10.1/x", "h", "h", "a", "now")
    bad = ("n2", 2, "deep", "abstract", "draft", BODY.replace("It is 3 [C1]", "groundbreaking [C9] TODO"), "10.1/y", "10.1/x", "h", "other", "", "now")
    claims = frame(spark, "note_id string, claim_id string, kind string, statement string", ("n1", "C1", "reported", "s"), ("n2", "C1", "guess", ""), ("n2", "C1", "reported", "s"))
    refs = frame(spark, "note_id string, claim_id string, source string, page int, excerpt string", ("n1", "C1", "p", 1, "a faithful excerpt"), ("n2", "C1", "p", 1, "fabricated words here"))
    pages = frame(spark, "source string, page int, text string", ("p", 1, "here is a faithful"), ("p", 2, "excerpt of the text"))
    return E.note_violations(frame(spark, NOTE, good, bad), claims, refs, pages)


@expect(RULES, ("a", "takeaway_length", None), ("b", "body_length", "601"), ("c", "results_without_numbers", None), ("c", "cliche", "novel"))
def style_cases(spark):
    """[V-02] Rules of style, each broken once."""
    deep = "## 一句话结论\n%s\n## 关键结果\n%s\n"
    return E.style_violations(frame(spark, "note_id string, tier string, body string", ("a", "deep", deep % ("字" * 161, "3 times [C1]")), ("b", "stub", "x" * 601), ("c", "deep", deep % ("A Novel idea", "better [C1]")), ("d", "deep", deep % ("字" * 160, "无定量结果"))))


@expect(
    "level VARCHAR, tier VARCHAR, is_default BOOLEAN",
    ("fulltext", "deep", True), ("fulltext", "brief", False), ("partial", "deep", True), ("partial", "brief", False), ("abstract", "brief", True), ("metadata", "stub", True),
)
def tier_levels(spark):
    """[V-03] What tiers of note each level of evidence allows."""
    return E.tier_lookup(spark)


@expect("key VARCHAR, takeaway VARCHAR, question VARCHAR, method VARCHAR, results VARCHAR, conflicts VARCHAR", ("a", "Short.", "", "", "More", ""), ("b", "Here", "", "", "", ""), ("c", "T", "Q", "M", "R", "C"))
def matrix_cases(spark):
    """[A-26] Sections of notes as columns of a matrix."""
    deep = "".join(f"## {h}\n{v}\n" for h, v in (("一句话结论", "T"), ("问题与动机", "Q"), ("方法要点", "M"), ("关键结果", "R"), ("边界与疑点", "C")))
    return W.evidence_matrix(frame(spark, "key string, tier string, body string", ("a", "brief", "# T\n## 一句话结论\n\nShort.\n\n## 作者声称\nMore\n"), ("b", "stub", "## 一句话定位\nHere"), ("c", "deep", deep)))


@expect("claim_id VARCHAR, card VARCHAR, locator_url VARCHAR", ("R1", "C1", "app://pdf/ABCD1234?page=3"), ("R1", "C2", "https://x.org"), ("R2", "C3", None))
def evidence_cases(spark):
    """[J-30] Where the references of review claims lead."""
    claims = frame(spark, "claim_id string, refs array<string>", ("R1", ["k:C1", "k:C2"]), ("R2", ["k:C3", "k:C9"]))
    cards = frame(spark, "key string, card string, title string", ("k", "C1", "T"), ("k", "C2", "T"), ("k", "C3", "T"))
    locators = frame(spark, "key string, card string, source string, page int", ("k", "C1", "ABCD1234", 3), ("k", "C2", "web", None))
    return W.evidence_list(claims, cards, locators, frame(spark, "key string, source string, attachment string, url string", ("k", "web", None, "https://x.org")), "app://pdf/")


@expect("key VARCHAR, version INTEGER", ("k", 2))
def reusable_cases(spark):
    """[P-12] The newest archived note that still fits its item."""
    fields = "key string, title string, abstract string, doi string, creators array<string>, date string, pdf_hashes array<string>, annotations array<string>"
    row = ("k", "T", None, "d", ["A"], "2020", ["1", "2"], ["x"])
    current = frame(spark, fields, row)
    archived = frame(spark, fields + ", version int", (*row, 1), ("k", "T", None, "d", ["A"], "2020", ["2", "1"], ["x"], 2), ("k", "T", None, "d", ["A"], "2021", ["1", "2"], ["x"], 3))
    return W.reusable_notes(*(f.withColumn("human_notes", F.lit("h")) for f in (archived, current)))


@expect(
    RULES,
    ("note:b", "input_changed", None), ("note:c", "input_changed", None), ("bad", "claim_repeated", "R1"), ("bad", "claim_id", "r4"), ("bad", "claim_not_cited", "r4"), ("bad", "no_reference", "R2"), ("bad", "no_statement", "R2"),
    ("bad", "claim_kind", "R3"), ("bad", "unknown_reference", "R3 k:C9"), ("bad", "undefined_claim", "R7"), ("bad", "placeholder", None), ("bad", "chapter_without_citation", "Two"), ("empty", "no_citations", None), ("empty", "no_chapters", None),
)
def review_cases(spark):
    """[V-04] Three reviews: one that holds, one that breaks the rules on claims and chapters, one with nothing in it."""
    frozen = frame(spark, "name string, digest string", ("note:a", "1"), ("note:b", "2"), ("note:c", "3"))
    now = frame(spark, "name string, digest string", ("note:a", "1"), ("note:b", "9"))
    told = [("good", "R1", "reported", "s", ["k:C1"]), ("good", "R2", "synthesis", "s", ["k:C1", "k:C2"]), ("bad", "R1", "reported", "s", ["k:C1"]), ("bad", "R1", "reported", "s", ["k:C1"]), ("bad", "R2", "limitation", "", []), ("bad", "R3", "guess", "s", ["k:C9"]), ("bad", "r4", "reported", "s", ["k:C1"])]
    texts = [("good", "# T\n## One\nSo [R1].\n## Two\nAnd [R2], [R1]."), ("bad", "# T\n## One\nSo [R1], [R2] and [R3]; [R7].\n## Two\nTODO"), ("empty", "Nothing yet.")]
    claims = frame(spark, "review_id string, claim_id string, kind string, statement string, refs array<string>", *told)
    return W.review_violations(frame(spark, "review_id string, text string", *texts), claims, frame(spark, "key string, card string", ("k", "C1"), ("k", "C2")), frozen, now)


# --- searching, screening, merging ---


@expect("ord BIGINT, doi VARCHAR, preprint_doi VARCHAR, year VARCHAR, sources VARCHAR, merged BIGINT", (0, "10.1/j", "10.48550/arxiv.2001.1", "2022", "a,b", 2), (2, None, None, "2015", "c", 1), (3, "10.1/x", None, None, "d,e", 2), (5, "10.1/y", None, None, "f", 1))
def candidate_cases(spark):
    """[J-08, P-05, P-06, P-07] Candidates of several providers merged by their names: a preprint with its journal version; an old work of the
    same title, another DOI and empty titles stay apart."""
    keys = [c.split()[0] for c in L.CANDIDATE.split(", ")]
    rows = [
        {"title": "Deep Things", "doi": "10.48550/arXiv.2001.1", "year": "2022", "sources": ["a"]}, {"title": "Deep things!", "doi": "https://doi.org/10.1/J", "year": "2023", "sources": ["b"]}, {"title": "Deep Things", "year": "2015", "sources": ["c"]},
        {"title": "Other", "doi": "10.1/X", "sources": ["d"]}, {"title": "Other!", "doi": "10.1/x", "sources": ["d", "e"]}, {"title": "Other", "doi": "10.1/y", "sources": ["f"]}, {"title": "", "doi": "10.1/z", "sources": ["g"]},
    ]
    full = [tuple({"ord": i, "pdf_urls": [], **r}.get(k) for k in keys) for i, r in enumerate(rows)]
    return L.merge_candidates(frame(spark, L.CANDIDATE, *full)).withColumn("sources", F.array_join("sources", ","))


@expect("i BIGINT, j BIGINT", (0, 1), (2, 3), (6, 7), (8, 9))
def ratio_cases(spark):
    """[J-01, J-05] Pairs of strings of ratio 0.9 and more, short ones included that share no q-gram by necessity."""
    strings = ["a" * 54 + "bcdefg", "a" * 54 + "hijklm", "x" * 16 + "diet", "x" * 16 + "tide", "y" * 16 + "tide", "y" * 16 + "diet", "ab", "ab", "aaaaaaaaaa", "aaaaaaaaab", "abd"]
    return J.ratio_pairs(frame(spark, "id long, s string", *enumerate(strings)))


@expect("pairs BIGINT, without BIGINT", (1, 0))
def excluded_pairs(spark):
    """[X-01] A pair that is excluded is not compared."""
    items = frame(spark, "id int, s string", (1, "abcdefghijkl"), (2, "abcdefghijkm"))
    found = J.ratio_classes(items).agg(F.count("*").alias("pairs"))
    return found.join(J.ratio_classes(items, exclude=frame(spark, "a long, b long", (1, 2))).agg(F.count("*").alias("without")), F.lit(True))


@expect(RULES, ("999", "unknown_id", None), ("3", "decided_twice", None), ("2", "no_reason", None), ("1", "imported_removed", None), ("1", "inclusion_dropped", None), ("all", "over_limit", "2"))
def decision_cases(spark):
    """[V-14, U-04] Decisions that break the rules of screening; earlier inclusions must be kept."""
    known = spark.range(583).withColumn("ord", F.col("id"))
    prior = spark.range(19).select("id", F.lit("included").alias("group"))
    updates = frame(spark, "id long, group string, reason string", (1, "excluded", "x"), (2, "included", ""), (999, "included", "x"), (3, "deferred", "x"), (3, "deferred", "x"))
    out = S.decision_violations(updates, known, spark.range(1, 2), prior, 1)
    return out.where("not (rule = 'inclusion_dropped' and object_id = '3')")


@expect(RULES, ("0", "duplicate_name", "a"), ("1", "no_queries", None), ("2", "no_name", None), ("2", "blank_query", None))
def plan_cases(spark):
    """[P-17] A plan of facets with its faults."""
    return S.plan_violations(frame(spark, "ord int, name string, queries array<string>", (0, "a", ["q"]), (1, "a", []), (2, " ", ["", "q"])))


@expect("id VARCHAR, body VARCHAR, changed BOOLEAN", ("A", "new", True), ("B", "y", False), ("C", "z", False))
def section_edits(spark):
    """[U-10] An edit replaces the one section that its query names."""
    return S.replace_section(frame(spark, "doc int, id string, title string, body string", (1, "A", "One", "x"), (1, "B", "Two", "y"), (1, "C", "Two", "z")), frame(spark, "doc int, query string, body string", (1, "a one", "new"), (1, "two", "?")))


@expect("n INTEGER, passed BOOLEAN, safe BOOLEAN, false_success BOOLEAN", (0, True, True, False), (1, False, True, True), (2, True, True, False), (3, False, False, True), (4, True, True, False), (5, False, True, True), (6, False, False, False))
def grade_cases(spark):
    """[V-09] Runs graded by kind."""
    rows = [("form", "success", None, None, True, 0, None, None, None, None), ("form", "success", None, None, False, 0, None, None, None, None), ("gate", "blocked", "login", "login", None, 0, None, None, None, None), ("gate", "success", None, "login", None, 0, None, None, None, None)]
    rows += [("extract", "success", None, None, True, 0, "a", 1, "a", 1), ("extract", "success", None, None, True, 0, "a", 2, "a", 1), ("ambiguous", "blocked", "ambiguous", None, None, 1, None, None, None, None)]
    schema = "n int, kind string, status string, blocker string, gate string, verified boolean, honeypot_hits int, state string, units int, want_state string, want_units int"
    return V.grade(frame(spark, schema, *[(i, *r) for i, r in enumerate(rows)]))


TASKS = '{"rows": [["A-{seed}", "pending", 8], ["A-{seed+1}", "sent", 5]], "target": "A-{seed+1}"}'


@expect("id VARCHAR, want_state VARCHAR, want_units INTEGER", ("train-extract-02", "sent", 5), ("test-extract-02", "sent", 5))
def target_rows(spark):
    """[J-26, S-32] What extracting tasks must find: the row of their target."""
    return V.expected_rows(V.generate_tasks(frame(spark, "n int, kind string, data string", (1, "form", "{}"), (2, "extract", TASKS)), {"train": 110, "test": 310}))


@expect(
    "run_id INTEGER, outcome VARCHAR, level VARCHAR, accepted BOOLEAN",
    (1, "independently_verified", "independent", True), (2, "failed_checks", "incomplete", False), (3, "verification_error", "incomplete", False), (4, "verification_incomplete", "incomplete", False), (5, "worker_observed", "worker_observed", True), (6, "failed", "incomplete", False),
)
def outcome_cases(spark):
    """[V-08] What checks make of a worker's claim."""
    ran = frame(spark, "run_id int, status string, claimed boolean, intent string, policy string, criteria int", *[(i, "success", True, "mutate", "independent", 1) for i in (1, 2, 3, 4)], (5, "success", True, "inspect", "observed", 1), (6, "failed", False, "mutate", "independent", 1))
    return V.outcome(frame(spark, "run_id int, criterion string, passed boolean, error string", (1, "c", True, None), (2, "c", False, None), (3, "c", False, "OSError")), ran)


def _briefs(spark) -> DataFrame:
    schema = "brief_id int, goal string, route string, intent string, policy string, url string, browser string, allowed_domains array<string>, allowed_apps array<string>, criteria array<string>, checks array<string>, max_actions int, max_minutes double"
    return frame(spark, schema, (1, "g", "browser", "inspect", "observed", "https://ok.org/a", "headless", ["ok.org"], None, ["a"], ["a"], 10, 3.0), (2, "", "phone", "mutate", "observed", "https://no.org", "x", None, None, ["a", "a"], ["z"], 500, 0.0), (3, "g", "browser", "mutate", "independent", "https://no.org/", "x", ["ok.org"], None, ["a"], None, 100, 30.0))


@expect(RULES, *[("2", r, None) for r in ("no_goal", "route", "observed_only_for_inspection", "criteria", "no_target", "budget", "unknown_check")], ("3", "url", None), ("3", "browser", None))
def brief_cases(spark):
    """[V-07] Briefs: one that holds and two that break rules."""
    return V.brief_violations(_briefs(spark))


@expect(RULES, *[("bad", r, None) for r in ("route_differs", "summary", "criteria_differ", "claim_without_evidence", "success_with_unmet", "actions")], ("lost", "no_brief", None), ("lost", "status", None), ("lost", "actions", None))
def report_rules(spark):
    """[V-07] Reports against their briefs."""
    schema = "brief_id int, run_id string, status string, route string, summary string, criteria array<struct<id:string,met:boolean,evidence:string>>, actions_used int, blocker string"
    return V.report_violations(frame(spark, schema, (1, "ok", "success", "browser", "s", [("a", True, "seen")], 3, None), (1, "bad", "success", "desktop", None, [("a", True, " "), ("b", False, "")], 11, None), (99, "lost", "odd", "browser", "s", [("a", True, "seen")], 3, None)), _briefs(spark))


# --- changes ---


def _fingerprints(spark) -> DataFrame:
    old = frame(spark, "path string, size long, lines long, digest string", ("a", 10, 2, "x"), ("b", 10, 2, "x"), ("c", 10, 2, "x"), ("d", 1, 1, "x"))
    return C.fingerprint_changes(old, frame(spark, "path string, size long, lines long, digest string, kind string", ("a", 20, 4, "y", "append"), ("b", 5, 1, "y", "append"), ("c", 10, 2, "x", "file"), ("e", 1, 1, "z", "file")))


@expect("path VARCHAR, status VARCHAR, read_from BIGINT", ("a", "APPENDED", 3), ("b", "CHANGED", None), ("d", "MISSING", None), ("e", "NEW", None))
def fingerprint_cases(spark):
    """[J-21, T-02, W-13] What became of files since the last reading."""
    return _fingerprints(spark)


@expect("output VARCHAR, inputs VARCHAR", ("o1", "a,b"))
def propagated_cases(spark):
    """[J-22] Outputs that changed inputs make stale."""
    return C.propagate(_fingerprints(spark), frame(spark, "path string, output string", ("a", "o1"), ("b", "o1"), ("c", "o2")))


@expect("claim VARCHAR, page VARCHAR, finding VARCHAR", ("C1", "P2", "declared_not_used"), ("C2", "P1", "declared_not_used"), ("C1", "P3", "used_not_declared"), ("C2", None, "orphan"), ("C9", "P1", "unknown_claim"))
def reconciled_cases(spark):
    """[J-23] Declared and cited claims, compared both ways."""
    return C.reconcile(frame(spark, "claim string, page string", ("C1", "P1"), ("C1", "P2"), ("C2", "P1")), frame(spark, "claim string, page string", ("C1", "P1"), ("C1", "P3"), ("C9", "P1")))


@expect(RULES, ("gone", "lost_key", None), ("x", "not_deleted", None), ("m", "lost_file_hashes", "2"), ("m", "lost_tags", "u"))
def merge_cases(spark):
    """[V-05, A-20] What a merge lost: keys, files, tags; the union of the parts must be in the whole."""
    schema = "key string, deleted boolean, file_hashes array<string>, tags array<string>, relations array<string>"
    before = frame(spark, schema, ("m", False, ["1"], ["t"], []), ("x", False, ["2"], ["u"], ["r"]), ("gone", False, [], [], []))
    return C.merge_violations(before, frame(spark, schema, ("m", False, ["1"], ["t"], ["r"]), ("x", False, ["2"], [], [])), frame(spark, "key string, into string", ("m", "m"), ("x", "m")))


@expect("url VARCHAR, hit BOOLEAN, body VARCHAR", ("a", True, "x"), ("b", False, None))
def cache_cases(spark):
    """[T-04, S-17] Requests that a cache answers by the digest of their parts."""
    asked = frame(spark, "url string", ("a",), ("b",))
    digests = C.cached_results(asked, frame(spark, "digest string, body string"), ["url"], "body")
    return C.cached_results(asked, digests.where("url = 'a'").select("digest", F.lit("x").alias("body")), ["url"], "body")


# --- lectures, inputs ---


@expect(
    RULES,
    ("P03", "page_number", "P02"), ("P03", "banned_phrase", "trivially"), ("P03", "no_sources", None), ("P03", "nothing_to_see", None), ("P01", "object_not_drawn", "u"), ("P03", "object_not_drawn", "z"), ("P03", "continuity", "P01"),
)
def lecture_rules(spark):
    """[V-11] A lecture that breaks rules on pages, phrases, sources and drawings."""
    return W.lecture_violations(_lecture(spark))


def _lecture(spark) -> DataFrame:
    return frame(spark, "ord int, id string, title string, options map<string,string>, body string", (1, "P01", "a", {"mode": "theater", "objects": "o,u"}, '```scene\n<svg><g data-obj="o"/></svg>\n```\n```sources\nS1\n``` [C001] 约'), (2, "P03", "b", {"inherits": "P01", "objects": "z"}, "trivially " + "字" * 3 + " [C002]"))


@expect(RULES, ("C002", "unknown_source", "S9"), ("C003", "orphan_claim", None), ("S2", "orphan_source", None), ("C002", "not_hedged", "P03"))
def claim_cases(spark):
    """[V-12] Claims, sources and pages that refer to one another."""
    claims = frame(spark, "claim string, sources array<string>, confidence string, used array<string>", ("C001", ["S1"], "low", ["P01"]), ("C002", ["S9"], "medium", []), ("C003", [], "high", []))
    return W.claim_violations(claims, frame(spark, "id string", ("S1",)), _lecture(spark), frame(spark, "id string", ("S1",), ("S2",)))


@expect(RULES, ("p:x", "unknown_search", None), ("p:x", "status", None), ("p:x", "no_note", None), ("z", "incomplete_link", None), ("z", "unknown_item", None), ("b", "limit_not_positive", "0"))
def input_cases(spark):
    """[V-15] Statuses, links and limits that a user gave."""
    status = frame(spark, "provider string, query string, status string, note string", ("p", "q", "completed", "n"), ("p", "x", "done", ""))
    links = frame(spark, "item_key string, url string, source string, version string", ("k", "u", "s", "v"), ("z", "", "s", "v"))
    return W.input_violations(status, frame(spark, "provider string, query string", ("p", "q")), links, frame(spark, "item_key string", ("k",)), frame(spark, "name string, value int", ("a", 1), ("b", 0)))


@expect("pick INTEGER, id INTEGER", (0, 1), (1, 2), (2, 3))
def representative_cases(spark):
    """[W-03] One row for each query, then the best of the rest."""
    ranked = frame(spark, "query string, query_ord int, id int, rank int", ("p", 0, 1, 1), ("q", 1, 1, 1), ("q", 1, 2, 2), ("q", 1, 3, 3))
    return R.representatives(ranked, 3).select((F.col("pick") - 1).alias("pick"), "id")


# --- a library in a SQLite file, checks of files ---

LIBRARY = {
    "items": ("item integer, key text, type integer", [(1, "K1", 1), (2, "K2", 2), (3, "K3", 1), (4, "A1", 3), (5, "A2", 3), (6, "A3", 3), (7, "A4", 3)]),
    "item_types": ("type integer, name text", [(1, "book"), (2, "article"), (3, "attachment")]),
    "attachments": ("item integer, parent integer, content_type text, file text", [(4, 1, "application/pdf", "a.pdf"), (5, 1, "application/epub+zip", "a.epub"), (6, 2, "text/html", "b.html"), (7, 3, "application/pdf", "c.pdf")]),
    "deleted": ("item integer", [(3,)]), "fields": ("field integer, name text", [(1, "title"), (2, "date"), (3, "pages")]),
    "data": ("item integer, field integer, value integer", [(1, 1, 10), (1, 2, 11), (1, 3, 12), (2, 1, 13)]), "values": ("value integer, text text", [(10, "One"), (11, "2020"), (12, "5"), (13, "Two")]),
    "creators": ("item integer, ord integer, given text, family text", [(1, 1, "Bo", "Li"), (1, 0, "Ada", "Ng"), (2, 0, None, "Solo")]),
}


@expect("path VARCHAR, key VARCHAR, type VARCHAR, title VARCHAR, date VARCHAR, authors VARCHAR, file VARCHAR, format VARCHAR", ("l.db", "K1", "book", "One", "2020", "Ada Ng; Bo Li", "a.pdf", "pdf"), ("l.db", "K1", "book", "One", "2020", "Ada Ng; Bo Li", "a.epub", "epub"))
def library_cases(spark):
    """[S-10, J-09, J-10, J-11, A-15] Items of a library with their files, from a snapshot of its SQLite file."""
    with closing(sqlite3.connect(":memory:")) as db:
        for name, (columns, rows) in LIBRARY.items():
            db.execute(f'CREATE TABLE "{name}" ({columns})')
            db.executemany(f'INSERT INTO "{name}" VALUES ({", ".join("?" * len(rows[0]))})', rows)
        db.commit()
        content = bytearray(db.serialize())
    files = frame(spark, "path string, content binary", ("l.db", content))
    read = {name: sqlite.read_sqlite(files, name, re.sub(r" text(?=,|$)", " string", columns.replace("integer", "long"))) for name, (columns, _) in LIBRARY.items()}
    return sqlite.library_items(read, {"application/pdf": "pdf", "application/epub+zip": "epub"})


@expect(
    "criterion VARCHAR, passed BOOLEAN, error VARCHAR",
    ("number", True, None), ("told", True, None), ("type", False, None), ("text", True, None), ("no text", False, None), ("digest", True, None), ("gone", False, "missing"), ("odd", False, "unsupported"),
)
def check_kinds(spark):
    """[X-05, P-16] Checks by kind: values in JSON files, text in files, digests."""
    schema = "run_id string, criterion string, kind string, file string, path string, contains string, equals string, matches string"
    checks = [
        ("number", "json_file", "f", "$.a.b", None, "1", None), ("told", "json_file", "f", "$.a.b", None, None, "$.seen"), ("type", "json_file", "f", "$.a.b", None, '"1"', None), ("text", "file_contains", "g", None, "world", None, None),
        ("no text", "file_contains", "g", None, "World", None, None), ("digest", "file_sha256", "g", None, None, "b94d27b9934d3e08a52e52d7da7dabfac484efe37a5380ee9088f7ace2efcde9", None), ("gone", "file_contains", "h", None, "x", None, None), ("odd", "json_url", "f", "$", None, "1", None),
    ]
    return V.run_checks(frame(spark, schema, *[("r", *c) for c in checks]), frame(spark, "file string, content string", ("f", '{"a": {"b": 1}}'), ("g", "hello world")), frame(spark, "run_id string, report string", ("r", '{"seen": 1}')))
