"""Scalar functions and UDFs on literal cases."""

import struct

import pytest
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.functions import udfs as U


def value(spark, column, **inputs):
    row = spark.createDataFrame([tuple(inputs.values())], ", ".join(f"{k} string" for k in inputs)) if inputs else spark.range(1)
    return row.select(column.alias("v")).first().v


@pytest.mark.parametrize(("function", "given", "want"), [
    (T.normalized, "Straße, 12_b — Ünï!", "strasse12_bünï"), (T.doi, " https://doi.org/10.1/AbC.; ", "10.1/abc"), (T.doi, "doi: 10.1/X", "10.1/x"), (T.doi, None, ""),
    (T.arxiv_id, "http://arxiv.org/pdf/math.GT/0309136v2", "math.GT/0309136v2"), (T.arxiv_id, "x", None), (T.is_preprint_doi, "10.48550/arxiv.1", True), (T.is_preprint_doi, None, False),
    (T.clean_inline, " a­ b \u0001 c \n\n 字\u0001 字 ", "a b c\n字字"), (T.cjk_ratio, "字a 字b", 0.5), (T.cjk_ratio, "", 0.0), (T.mojibake_ratio, "a�", 0.5), (T.squash, " a\t b\n", "ab"),
    (T.furniture_key, " Page 12 of 300", "Page#of#"), (T.query_terms, 'ti:graph AND neural', ["graph", "neural"]), (T.query_terms, '"deep nets" of a x all:Learning)', ["deep nets", "learning"]),
    (T.qgrams, "ab", []), (T.qgrams, "abcd", ["abc", "bcd"]), (T.slug, " Héllo, Wörld! ", "héllo-wörld"), (T.pipe_fields, "a | b||c", ["a", "b", "", "c"]), (T.language, "abc 字", "zh"), (T.language, "abcd 字", "en"),
    (T.language, "ひらがな", "ja"), (T.sentences, "See e.g. this one. And that! 好。", ["See e.g. this one.", "And that!", "好。"]), (T.semver, "v1.2.3", [1, 2, 3]), (T.semver, "1.2", None),
    (T.redact, "x api_key=abc&token=1 y", "x api_key=[REDACTED]&token=[REDACTED] y"), (T.source_tier, "原始论文", "A"), (T.source_tier, "Reddit thread", "E"), (T.source_tier, "blog", "other"),
    (T.html_escape, "<a href='x'>&\"", "&lt;a href=&#39;x&#39;&gt;&amp;&quot;"), (T.year_of, "2020-01", 2020), (T.year_of, "in 2020", None), (T.snippet, "a  b\nc", "a b c"), (T.strip_tags, "<p>a<b>b</b></p>", "a b"),
])
def test_functions(spark, function, given, want):
    assert value(spark, function(F.col("x")), x=given) == want


@pytest.mark.parametrize(("a", "b", "want"), [("meth-", "od", "method"), ("state-", "Of", "state- Of"), ("字", "字", "字字"), ("a", "b", "a b"), ("", "b", "b"), ("a", "", "a"), ("字", "a", "字a")])
def test_join_lines(spark, a, b, want):
    assert value(spark, T.join_lines(F.col("a"), F.col("b")), a=a, b=b) == want


@pytest.mark.parametrize(("a", "b", "want"), [("Chapter One", "chapter one!", True), ("One", "Chapter One", True), ("", "x", False), ("x" * 61, "y" + "x" * 61, False)])
def test_same_title(spark, a, b, want):
    assert value(spark, T.same_title(F.col("a"), F.col("b")), a=a, b=b) is want


def test_relevance_puts_topic_before_citations(spark):
    from millrace.operators import ranking as R

    rows = spark.createDataFrame([(1, "cooking at home", "soup", 90_000), (2, "graph neural networks", "neural nets on a graph", 12)], "id long, title string, abstract string, cites long")
    out = R.scored(rows, ["ti:graph AND neural"], F.lit(1), F.col("cites"), F.lit(False), F.lit(False)).orderBy(F.desc("score")).collect()
    assert [o.id for o in out] == [2, 1] and abs(out[0].score - (3 + 1.5 + 0.3 * __import__("math").log10(13) + 0.3)) < 1e-9


def test_small_notations(spark):
    assert value(spark, F.struct(*T.key_value(F.col("x"))), x="Key：a: b") == ("Key", "a: b")
    assert value(spark, F.struct(*T.limit_spec(F.col("x"))), x="13 / max 20") == (13.0, 20.0) and value(spark, F.struct(*T.limit_spec(F.col("x"))), x="max 25") == (None, 25.0)
    assert value(spark, F.struct(*T.nice_scale(F.lit(20.0)))) == (30.0, 5.0) and value(spark, F.struct(*T.nice_scale(F.lit(0.0)))) == (1.0, 1.0)
    assert value(spark, F.struct(*T.year_range(F.col("x"))), x="2018~2026") == ("2018", "2026") and value(spark, F.struct(*T.year_range(F.col("x"))), x="2020") == ("2020", "2020")
    assert value(spark, T.search_url("http://h?", F.col("x"), F.col("y")), x="a b", y="2018:2020") == "http://h?&as_ylo=2018&as_yhi=2020&q=a+b"
    assert value(spark, T.person_name(F.col("g"), F.col("f")), g="小明", f="王") == "王小明" and value(spark, T.person_name(F.col("g"), F.col("f")), g="Ada", f="Ng") == "Ada Ng"
    assert value(spark, T.newer(F.lit("1.10.0"), F.lit("v1.9.9"))) and not value(spark, T.newer(F.lit("x"), F.lit("1.0.0")))
    assert value(spark, T.human_bytes(F.lit(1500))) == "2 KB" and value(spark, T.human_bytes(F.lit(3 << 20))) == "3.0 MB" and value(spark, T.human_bytes(F.lit(50 << 20))) == "50 MB"
    assert value(spark, T.percent(F.lit(1.0), F.lit(3.0))) == 33.33 and value(spark, T.reading_minutes(F.lit(100))) == 1 and value(spark, T.speech_seconds(F.lit("one two"))) == 1.6
    assert value(spark, T.text_width(F.lit("aW 字"))) == round((0.56 + 0.86 + 0.3 + 1) * 13, 2) and value(spark, T.html_unescape_basic(T.html_escape(F.lit("a<'&\"")))) == "a<'&\""
    assert value(spark, T.path_allowed(F.lit("/r/a/b"), ["/r/a"])) and not value(spark, T.path_allowed(F.lit("/r/a/../b"), ["/r/a"])) and not value(spark, T.path_allowed(F.lit("/r/ab"), ["/r/a"]))
    allowed = lambda u: value(spark, T.url_allowed(F.col("u"), ["ok.org"]), u=u)
    assert [allowed(u) for u in ("https://ok.org/x", "ftp://ok.org", "http://a@ok.org/", "http://no.org", "nonsense")] == [True, False, False, False, False]


@pytest.mark.parametrize(("given", "want"), [
    ('Done.\n```json\n{"run_id": "r", "a": {"b": 1}}\n```', '{"a": {"b": 1}, "run_id": "r"}'), ('text {"x": 1} then {"run_id": "r"}', '{"run_id": "r"}'), ('{"run_id": "r"} and more', None), ('{"run_id": 1} {"run_id": 2}', None), ("none", None), (None, None),
])
def test_salvage(spark, given, want):
    assert value(spark, U.salvaged_report(F.col("x")), x=given) == want


def test_binary_functions(spark):
    png = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + struct.pack(">II", 640, 480)
    gif = b"GIF89a" + struct.pack("<HH", 3, 4)
    jpeg = b"\xff\xd8\xff\xe0\0\x04ab\xff\xc0\0\x11\x08" + struct.pack(">HH", 7, 9) + b"\3" + b"\0" * 10
    rows = spark.createDataFrame([(bytearray(x),) for x in (png, gif, jpeg, b"no")], "c binary")
    assert [tuple(r.s) for r in rows.select(U.image_size("c").alias("s")).collect()] == [("png", 640, 480), ("gif", 3, 4), ("jpeg", 9, 7), (None, None, None)]
    texts = spark.createDataFrame([(bytearray("字".encode("gb18030")), None), (bytearray("é".encode("latin-1")), "latin-1"), (bytearray("é".encode()), "bad")], "c binary, d string")
    assert [r.t for r in texts.select(U.decode_bytes("c", "d").alias("t")).collect()] == ["字", "é", "é"]
    assert spark.createDataFrame([(bytearray(b"a"), "x/y")], "c binary, k string").select(U.data_uri("c", "k").alias("u")).first().u == "data:x/y;base64,YQ=="


def test_wrapping_and_matches(spark):
    row = spark.createDataFrame([("one two three 字字字", 45.0, ["on", "one", "e t"])], "t string, w double, n array<string>")
    got = row.select(U.wrap_lines("t", "w").alias("l"), U.leftmost_matches("t", "n").alias("m"), U.unescape_html(F.lit(" &eacute;&lt; ")).alias("h"), U.comparable(F.lit("Meth-\nOd ﬁ")).alias("c")).first()
    assert "".join(got.l).replace(" ", "") == "onetwothree字字字" and len(got.l) >= 3 and got.m == [0] and got.h == "é<" and got.c == "methodfi"
