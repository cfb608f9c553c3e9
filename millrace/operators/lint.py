"""[V-10] Writing rules for Markdown: length of sentences and paragraphs, passive voice, words and phrases to avoid."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import blocks as B

# Limits by language and kind of text, and the word lists of the rules.
LIMITS = {("zh", "procedural"): 35, ("zh", "descriptive"): 45, ("en", "procedural"): 20, ("en", "descriptive"): 25}
PASSIVE = r"(?i)\b(?:am|is|are|was|were|be|been|being)\s+(?:\w+ly\s+)?(\w+ed|known|done|made|given|taken|seen|written|built|shown|sent|kept|held|found|set|put|run|begun|chosen|driven|broken)\b"
WORDS = {
    "utilize": "use", "utilise": "use", "utilization": "use", "commence": "start", "commenced": "started", "prior to": "before", "in order to": "to", "approximately": "about", "ensure": "make sure",
    "replenish": "fill", "terminate": "stop", "facilitate": "help", "leverage": "use", "numerous": "many", "subsequently": "then", "endeavor": "try", "ascertain": "find", "sufficient": "enough",
    "demonstrate": "show", "assist": "help", "obtain": "get", "initiate": "start", "modify": "change", "possess": "have", "purchase": "buy", "in the event that": "if", "due to the fact that": "because",
    "at this point in time": "now", "a number of": "some", "with regard to": "about", "in addition": "also",
}
LIGHT_VERBS = (r"进行(?![中时])了?[一-龥]{2}", r"(?:加以|予以)[一-龥]{2}", r"[做作]出了?[一-龥]{2}")
STOCK_PHRASES = (
    "赋能", "抓手", "闭环", "打通", "全方位", "多维度", "深度融合", "显著提升", "至关重要", "不可或缺", "与此同时", "综上所述", "值得注意的是", "总而言之", "众所周知", "毋庸置疑", "一站式", "底层逻辑", "颗粒度", "方法论",
)


def plain(line):
    """A line without its inline markup."""
    for pattern, into in ((r"~~[^~]*~~", ""), (r"`[^`]*`", ""), (r"!\[[^\]]*\]\([^)]*\)", ""), (r"\[([^\]]*)\]\([^)]*\)", "$1"), (r"<[^>]+>", ""), (r"[*_]{1,3}", "")):
        line = F.regexp_replace(line, pattern, into)
    return line


def units(lines: DataFrame, stream: str, pos: str = "pos", line: str = "line") -> DataFrame:
    """(stream, pos, kind, unit): the texts that rules look at: prose lines, list items and table cells."""
    t = F.trim(F.col(line))
    item = r"^(?:[-*+]|\d+[.)])\s+(.*)$"
    kind = (
        F.when((t == "") | t.rlike(r"^#{1,6}\s") | t.rlike(r"^[-*_]{3,}$") | t.rlike(r"^\|?[\s:|-]+\|?$"), None).when(t.rlike(r"^\d+[.)]\s+"), "procedural").otherwise("descriptive")
    )
    body = F.when(t.rlike(r"^\|"), F.split(F.regexp_replace(t, r"^\||\|$", ""), "\\|")).when(t.rlike(item), F.array(F.regexp_extract(t, item, 1))).otherwise(F.array(F.regexp_replace(t, r"^>\s*", "")))
    return lines.select(stream, pos, kind.alias("kind"), F.explode(body).alias("raw")).where("kind is not null").select(stream, pos, "kind", plain(F.trim("raw")).alias("unit"))


def findings(lines: DataFrame, stream: str, pos: str = "pos", line: str = "line") -> DataFrame:
    """(stream, pos, rule, detail), one row for each finding: rules on sentences, on whole units, and on paragraphs, a pass for each."""
    rows = units(lines, stream, pos, line)
    entry = lambda name, when, detail: F.when(when, F.struct(F.lit(name).alias("rule"), detail.cast("string").alias("detail")))
    language, length = T.counted_length(F.col("cjk"), F.col("n_words"))
    said = rows.select(stream, pos, "kind", F.explode(T.sentences(F.col("unit"))).alias("s")).withColumns({"cjk": T.cjk_count(F.col("s")), "n_words": T.word_count(F.col("s"))}).withColumns({"language": language, "n": length})
    limit = F.coalesce(*[F.when((F.col("language") == lang) & (F.col("kind") == kind), n) for (lang, kind), n in LIMITS.items()])
    told = F.array(
        entry("sentence-length", F.col("n") > limit, F.col("n")), entry("passive", (F.col("language") == "en") & F.col("s").rlike(PASSIVE), F.regexp_extract("s", PASSIVE, 0)),
        entry("de-chain", F.contains("s", F.lit("的")) & (F.regexp_count("s", F.lit("的")) >= 3) & ~T.is_japanese(F.col("s")), F.col("s")),
    )
    none = F.array().cast("array<string>")
    some = sorted({max(w.split(), key=len) for w in WORDS})  # cheaper to look for than the pattern
    listed = F.when(T.holds_any(F.col("unit"), some), F.regexp_extract_all(F.lower("unit"), F.lit(r"\b(" + "|".join(sorted((w.replace(" ", r"\s+") for w in WORDS), key=lambda w: -len(w))) + r")\b"), F.lit(1))).otherwise(none)
    han = F.col("unit").rlike("[一-龥]") & ~T.is_japanese(F.col("unit"))
    light = F.when(han, F.regexp_extract_all("unit", F.lit("(" + "|".join(LIGHT_VERBS) + ")"), F.lit(1))).otherwise(none)
    stock = F.when(han, F.filter(F.array(*map(F.lit, STOCK_PHRASES)), lambda p: F.contains("unit", p))).otherwise(none)
    named = lambda name, items: F.transform(items, lambda x: F.struct(F.lit(name).alias("rule"), x.alias("detail")))
    long_runs = B.sentence_runs(lines, stream, pos=pos, line=line)
    return (
        said.select(stream, pos, F.inline(F.array_compact(told)))
        .unionByName(rows.select(stream, pos, F.inline(F.concat(named("word", listed), named("word", light), named("cliche", stock)))))
        .unionByName(long_runs.select(stream, F.col("start").alias(pos), F.lit("paragraph-length").alias("rule"), F.col("sentences").cast("string").alias("detail")))
    )


def document_counts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, long_sentences, passives, words, paragraphs, other): findings of each document that has any."""
    out = findings(B.explode_lines(docs, key, text), key).groupBy(key)
    n = lambda *rules: F.count_if(F.col("rule").isin(*rules))
    return out.agg(n("sentence-length").alias("long_sentences"), n("passive").alias("passives"), n("word").alias("words"), n("paragraph-length").alias("paragraphs"), n("de-chain", "cliche").alias("other"))
