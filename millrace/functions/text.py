"""Scalar functions on text as Column expressions. Names in brackets are the inventory's ids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The character classes of the formats that these functions read.
CJK = r"\u2E80-\u9FFF\uAC00-\uD7AF\uF900-\uFAFF\uFE30-\uFE4F\uFF00-\uFFEF"
HIRAGANA = r"\u3040-\u309F"
STOPWORDS = "a an and are as at by for from in into is of on or the to with via using based toward towards".split()
PREPRINT_DOI = r"^10\.(48550/arxiv\.|26434/|21203/rs\.|20944/preprints|2139/ssrn\.|31219/osf\.|1101/[0-9]{4}\.[0-9]{2}\.[0-9]{2}\.)"
SENTENCE_END = "。！？!?…」』”’）)】.:：;；\"'"
NARROW, WIDE = "iljtfrI.,:;|!'`()[]{}", "mwMWOQGD@%&"


def strip(c: Column) -> Column:
    """Without white space at both ends; F.trim takes blanks only."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def fold_case(c: Column) -> Column:
    return F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))


def normalized(c: Column) -> Column:
    """[F-01] Case-folded, letters, digits and underscores only."""
    return F.regexp_replace(fold_case(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}_]", "")


def doi(c: Column, trim: bool = True) -> Column:
    """[F-02] A DOI without its resolver or scheme, in lower case; trailing punctuation goes unless trim is False."""
    bare = F.lower(F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), r"(?i)^(https?://(dx\.)?doi\.org/|doi:\s*)", ""))
    return F.regexp_replace(bare, r"[.,;]+$", "") if trim else bare


def arxiv_id(url: Column) -> Column:
    """[F-03] The versioned arXiv id in a URL; null if there is none."""
    return F.nullif(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?i)arxiv\.org/(?:abs|pdf)/((?:\d{4}\.\d{4,5}|[a-z.-]+/\d{7})(?:v\d+)?)", 1), F.lit(""))


def arxiv_base(c: Column) -> Column:
    return F.regexp_replace(c, r"v\d+$", "")


def is_preprint_doi(c: Column) -> Column:
    """[P-05]"""
    return F.coalesce(c.rlike(PREPRINT_DOI), F.lit(False))


def strip_tags(c: Column) -> Column:
    """[F-04] Tags become blanks; entities are left (see udfs.unescape_html)."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), "<[^>]+>", " "))


def join_lines(a: Column, b: Column) -> Column:
    """[F-05] Two lines of running text as one."""
    cjk = f"[{CJK}]"
    return (
        F.when(F.coalesce(a, F.lit("")) == "", b)
        .when(F.coalesce(b, F.lit("")) == "", a)
        .when(a.rlike("[A-Za-z]-$") & b.rlike("^[a-z]"), F.concat(F.substr(a, F.lit(1), F.length(a) - 1), b))
        .when(a.rlike(f"{cjk}$") | b.rlike(f"^{cjk}"), F.concat(a, b))
        .otherwise(F.concat(a, F.lit(" "), b))
    )


def clean_inline(c: Column) -> Column:
    """[F-06] One block's text: soft hyphens and zero-width marks go, blanks collapse within lines, empty lines go. The mark
    U+0001 stands for a line break of the source file: between CJK characters it vanishes, elsewhere it is a blank."""
    text = F.translate(c, "\u00ad\u200b\ufeff", "")
    text = F.regexp_replace(text, f"(?<=[{CJK}])[ \\t]*\u0001[ \\t\u0001]*(?=[{CJK}])", "")
    text = F.regexp_replace(text, "[ \\t]*\u0001[ \\t]*", " ")
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, "[ \\t\\r\\f\\x0B\u00a0\u3000]+", " ")))
    return F.trim(F.array_join(F.filter(lines, lambda x: x != ""), "\n"))


def ratio_of(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def cjk_ratio(c: Column) -> Column:
    """[F-07] CJK characters among those that aren't white space."""
    return ratio_of(F.regexp_count(c, F.lit(f"[{CJK}]")), F.regexp_count(c, F.lit(r"[^\s]")))


def mojibake_ratio(c: Column) -> Column:
    """[F-07] Replacement and private-use characters among all."""
    return ratio_of(F.regexp_count(c, F.lit(r"[\uFFFD\uE000-\uF8FF]")), F.length(c))


def squash(c: Column) -> Column:
    """[F-10]"""
    return F.regexp_replace(c, r"\s+", "")


def same_title(a: Column, b: Column) -> Column:
    """[F-11] Equal by letters and digits, or the first, if not over 60 of them, within the other or around it."""
    x, y = (F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}_]", "")) for c in (a, b))
    return (x != "") & ((x == y) | ((F.length(x) <= 60) & (F.contains(y, x) | F.contains(x, y))))


def furniture_key(c: Column) -> Column:
    """[F-12] What running heads have in common: no blanks, numbers masked, 60 characters."""
    return F.substring(F.regexp_replace(squash(c), "[0-9]+", "#"), 1, 60)


def query_terms(c: Column) -> Column:
    """[F-13] Quoted phrases and words of a query, without field prefixes, operators, stop words and single characters."""
    tokens = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r'"[^"]+"|\S+'), F.lit(0))
    bare = F.transform(tokens, lambda t: fold_case(F.regexp_replace(F.regexp_replace(t, "^(all|ti|abs|au|cat):", ""), r'^["()]+|["()]+$', "")))
    stop = F.array(*[F.lit(w) for w in [*STOPWORDS, "andnot"]])
    return F.filter(bare, lambda t: (F.length(t) > 1) & ~F.array_contains(stop, t))


def coverage(text: Column, term_sets: Column) -> Column:
    """[A-07] The best share of terms that a text holds, over several sets of terms."""
    share = F.transform(term_sets, lambda ts: ratio_of(F.size(F.filter(ts, lambda t: F.contains(text, t))), F.size(ts)))
    return F.coalesce(F.array_max(share), F.lit(0.0))


def relevance(title_cover: Column, abstract_cover: Column, providers: Column, citations: Column, has_abstract: Column, has_pdf: Column, expanded: Column) -> Column:
    """[F-14] Unrounded."""
    extra = F.least(F.greatest(providers - 1, F.lit(0)), F.lit(3))
    flag = lambda c, w: F.when(c, F.lit(w)).otherwise(F.lit(0.0))
    return 3 * title_cover + 1.5 * abstract_cover + 0.4 * extra + 0.3 * F.log10(1 + F.coalesce(citations, F.lit(0))) + flag(has_abstract, 0.3) + flag(has_pdf, 0.2) + flag(expanded, 0.5)


def minimum_matches(total: Column, percent: int = 90) -> Column:
    """[F-15] Least number of matches with 2 * matches / total >= percent / 100."""
    return F.floor((F.lit(percent) * total + 199) / 200).cast("int")


def overlap_bound(m: Column, n: Column, q: int = 3, percent: int = 90) -> Column:
    """[F-16] Shared q-grams that two strings of these lengths must have to be as similar as that."""
    h = minimum_matches(m + n, percent)
    return F.greatest(F.lit(0), h - (q - 1) * (m + n - 2 * h + 1))


def qgrams(c: Column, q: int = 3) -> Column:
    """[F-17] All contiguous q-grams in order."""
    n = F.length(c) - q + 1
    return F.when(n >= 1, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substr(c, i, F.lit(q)))).otherwise(F.array().cast("array<string>"))


def canonical_digest(*columns: str) -> Column:
    """[F-19] SHA-256 of a row as JSON with its keys in order."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def search_url(base: str, query: Column, years: Column | None = None) -> Column:
    """[F-20] A search address, with the bounds of a range of years if there is one."""
    tail = F.concat(F.lit("&q="), F.url_encode(query))
    if years is None:
        return F.concat(F.lit(base), tail)
    low, high = year_range(years)
    bounds = F.when(F.coalesce(years, F.lit("")) != "", F.concat(F.lit("&as_ylo="), low, F.lit("&as_yhi="), high)).otherwise("")
    return F.concat(F.lit(base), bounds, tail)


def year_range(c: Column) -> tuple[Column, Column]:
    """[F-21] Both ends of a range; a single year is both."""
    folded = F.regexp_replace(c, "[;:~至]", "-")
    parts = F.split(folded, "-")
    return F.get(parts, F.lit(0)), F.element_at(parts, -1)


def year_of(c: Column) -> Column:
    """[P-03] The leading four digits; null if there are none."""
    return F.when(c.rlike("^[0-9]{4}"), F.substring(c, 1, 4).cast("int"))


def person_name(given: Column, family: Column) -> Column:
    """[F-22] CJK names without a blank between."""
    g, f = F.coalesce(given, F.lit("")), F.coalesce(family, F.lit(""))
    cjk = F.concat(g, f).rlike(f"[{CJK}]")
    return F.when(cjk, F.concat(f, g)).otherwise(F.trim(F.concat_ws(" ", g, f)))


def slug(c: Column, length: int = 60) -> Column:
    """[F-23] Safe for a file name."""
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "-"), "^-+|-+$", ""), 1, length)


def pipe_fields(c: Column) -> Column:
    """[F-24] Fields between bars, trimmed."""
    return F.transform(F.split(c, "\\|"), lambda x: F.trim(x))


def key_value(c: Column) -> tuple[Column, Column]:
    """[F-24] Both sides of the first colon; null without one."""
    pattern = r"^([^:：]+)[:：]\s*(.*)$"
    return F.trim(F.nullif(F.regexp_extract(c, pattern, 1), F.lit(""))), F.when(c.rlike(pattern), F.regexp_extract(c, pattern, 2))


def limit_spec(c: Column) -> tuple[Column, Column]:
    """[F-25] (value, limit) of `value / limit`, or of a limit alone; numbers may follow `max`."""
    number = lambda x: F.regexp_extract(F.trim(x), r"(?i)^(?:max\s+)?(-?\d+(?:\.\d+)?)$", 1).try_cast("double")
    parts = F.split(c, "/")
    two = F.size(parts) > 1
    return F.when(two, number(F.get(parts, F.lit(0)))), F.when(two, number(F.get(parts, F.lit(1)))).otherwise(number(F.get(parts, F.lit(0))))


def nice_scale(peak: Column) -> tuple[Column, Column]:
    """[F-26] (max, step) of an axis whose top is at least 1.4 times the peak, in steps that divide it into seven at most."""
    bad = F.coalesce(peak <= 0, F.lit(True)) | F.isnan(peak)
    peak = F.when(bad, F.lit(1.0)).otherwise(peak)
    target = peak * 1.4
    power = F.pow(F.lit(10.0), F.floor(F.log10(target)))
    tops = F.transform(F.array(*[F.lit(float(x)) for x in (1, 1.5, 2, 2.5, 3, 4, 5, 6, 8, 10)]), lambda m: m * power)
    nice = F.coalesce(F.get(F.filter(tops, lambda m: m >= target - 1e-9), F.lit(0)), 10 * power)
    whole = peak == F.floor(peak)
    top = F.when(whole, F.ceil(nice).cast("double")).otherwise(nice)
    step_power = F.pow(F.lit(10.0), F.floor(F.log10(top)))
    steps = F.transform(F.array(*[F.lit(x / by) for by in (10.0, 1.0) for x in (1, 2, 2.5, 5, 10)]), lambda s: s * step_power)
    fits = lambda s: (top / s <= 7) & (F.abs(F.round(top / s, 3) - F.round(top / s)) < 1e-9) & (~whole | (s >= 1))
    step = F.coalesce(F.get(F.filter(steps, fits), F.lit(0)), top)
    return F.when(bad, 1.0).otherwise(F.round(top, 3)), F.when(bad, 1.0).otherwise(F.round(step, 3))


def percent(value: Column, whole: Column) -> Column:
    """[F-27] To two decimals, halves up."""
    return F.floor(value / whole * 1e4 + 0.5) / 100


def text_width(c: Column, size: float = 13, mono: bool = False) -> Column:
    """[F-28] Estimated width by classes of characters."""
    cjk = F.regexp_count(c, F.lit(f"[{CJK}]"))
    if mono:
        units = cjk + 0.6 * (F.length(c) - cjk)
    else:
        count = lambda pattern: F.regexp_count(c, F.lit(pattern))
        blank, narrow = count(" "), count(r"[iljtfrI.,:;|!'`()\[\]{}]")
        wide, upper = count("[mwMWOQGD@%&]"), count("[A-HJ-LNPR-VX-Z]") - count("[DG]")
        units = cjk + 0.3 * blank + 0.32 * narrow + 0.86 * wide + 0.68 * upper + 0.56 * (F.length(c) - cjk - blank - narrow - wide - upper)
    return F.floor(units * size * 100 + 0.5) / 100


def is_japanese(c: Column) -> Column:
    hiragana, cjk = F.regexp_count(c, F.lit(f"[{HIRAGANA}]")), F.regexp_count(c, F.lit(f"[{CJK}]"))
    return (hiragana > 0) & (ratio_of(hiragana, cjk) >= 0.05)


def language(c: Column) -> Column:
    """[F-29] en, ja or zh by the characters alone."""
    cjk, latin = F.regexp_count(c, F.lit(f"[{CJK}]")), F.regexp_count(c, F.lit("[a-zA-Z]"))
    return F.when(cjk * 3 < latin, "en").when(is_japanese(c), "ja").otherwise("zh")


ABBREVIATION = r"(?i)\b(e\.g|i\.e|etc|vs|cf|approx|Fig|No)\."


#: What a text with such an abbreviation holds in lower case; cheaper to look for than the pattern.
ABBREVIATED = ("e.g.", "i.e.", "etc.", "vs.", "cf.", "approx.", "fig.", "no.")


def _ascii(c: Column) -> Column:
    return F.octet_length(c) == F.length(c)


def holds_any(c: Column, strings) -> Column:
    """Whether a text in lower case holds one of the strings; null for null."""
    return F.exists(F.array(F.lower(c)), lambda low: reduce(lambda a, b: a | b, [F.contains(low, F.lit(x)) for x in strings]))


def sentences(c: Column) -> Column:
    """[F-30] Sentences; full stops of abbreviations do not end one. What most texts need not be searched for is asked first by plain comparisons."""
    masked = F.when(holds_any(c, ABBREVIATED) & c.rlike(ABBREVIATION), F.regexp_replace(F.regexp_replace(c, r"(?i)\b(e\.g|i\.e)\.", "$1\u0000"), ABBREVIATION, "$1\u0000")).otherwise(c)
    pattern = r"[^。！？；!?;][^。！？；!?;.]*+(?:\.(?!\s|$)[^。！？；!?;.]*+)*+(?:[。！？；!?;]+|\.(?=\s|$)|$)"
    found = lambda p: F.regexp_extract_all(masked, F.lit(p), F.lit(0))
    parts = F.when(_ascii(c), found(pattern.replace("。！？；", ""))).otherwise(found(pattern))

    def stripped(s: Column) -> Column:
        """strip(s): white space that it takes from the end is one of the last two characters."""
        begun = F.ltrim(F.replace(s, F.lit("\u0000"), F.lit(".")), F.lit(" \t\n\x0b\f\r"))
        return F.when(F.right(begun, F.lit(2)).rlike(r"\s"), strip(begun)).otherwise(begun)

    return F.filter(F.transform(parts, stripped), lambda s: s != "")


def word_count(c: Column) -> Column:
    pattern = r"[A-Za-z0-9][A-Za-z0-9_'’-]*"
    return F.when(_ascii(c), F.regexp_count(c, F.lit(pattern.replace("’", "")))).otherwise(F.regexp_count(c, F.lit(pattern)))


def cjk_count(c: Column) -> Column:
    """CJK characters without punctuation marks."""
    return F.when(_ascii(c), 0).otherwise(F.regexp_count(c, F.lit(f"[{CJK}]")) - F.regexp_count(c, F.lit("[，。！？；：、（）「」『』《》]")))


def counted_length(cjk: Column, words: Column) -> tuple[Column, Column]:
    """[F-31] (language, length) of a sentence of so many CJK characters and words: both, or words alone."""
    zh = (cjk >= 4) | (cjk > words)
    return F.when(zh, "zh").otherwise("en"), F.when(zh, cjk + words).otherwise(words)


def speech_seconds(c: Column) -> Column:
    """[F-32]"""
    cjk = F.regexp_count(c, F.lit(f"[{CJK}]"))
    return F.greatest(F.lit(1.6), cjk / 4.2 + word_count(F.regexp_replace(c, f"[{CJK}]", " ")) / 2.6 + 0.3)


def html_escape(c: Column) -> Column:
    """[F-33]"""
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(raw), F.lit(entity))
    return c


def html_unescape_basic(c: Column) -> Column:
    """[F-33] The inverse of html_escape."""
    for raw, entity in (("'", "&#39;"), ('"', "&quot;"), (">", "&gt;"), ("<", "&lt;"), ("&", "&amp;")):
        c = F.replace(c, F.lit(entity), F.lit(raw))
    return c


def semver(c: Column) -> Column:
    """[F-34] Three numbers, or null."""
    pattern = r"^v?(\d+)\.(\d+)\.(\d+)$"
    text = F.trim(c)
    return F.when(text.rlike(pattern), F.array(*[F.regexp_extract(text, pattern, i).cast("int") for i in (1, 2, 3)]))


def newer(a: Column, b: Column) -> Column:
    return F.coalesce(semver(a) > semver(b), F.lit(False))


def human_bytes(c: Column) -> Column:
    """[F-35]"""
    mib = 2**20
    return (
        F.when(c < mib, F.concat(F.ceil(c / 1024).cast("string"), F.lit(" KB")))
        .when(c < 10 * mib, F.concat(F.format_string("%.1f", c / mib), F.lit(" MB")))
        .otherwise(F.concat(F.format_string("%.0f", c / mib), F.lit(" MB")))
    )


def reading_minutes(chars: Column) -> Column:
    """[F-36]"""
    return F.greatest(F.lit(1), F.bround(chars / 400).cast("int"))


def snippet(c: Column, length: int = 280) -> Column:
    """[F-37]"""
    return F.substring(F.regexp_replace(c, r"\s+", " "), 1, length)


def redact(c: Column) -> Column:
    """[F-43] Values of keys and tokens in a message."""
    return F.regexp_replace(c, "(?i)(api_key|token|key)=([^\\s&'\"]+)", "$1=[REDACTED]")


#: [F-44] Ordered rules of source tiers; fixed values.
SOURCE_TIERS = (
    ("A", r"(?i)tier\s*A|权威|原始|教材|review|论文|官方"),
    ("B", r"(?i)tier\s*B|OCW|lecture notes|大学"),
    ("C", r"(?i)tier\s*C|直觉|3Blue|教学网站"),
    ("D", r"(?i)tier\s*D|COMSOL|ANSYS|QuantumATK|MathWorks|Intel|TSMC|Synopsys|产业|软件"),
    ("E", r"(?i)tier\s*E|SE\b|Reddit|社区|stack"),
)


def source_tier(c: Column) -> Column:
    """[F-44] The first tier whose pattern a description matches; other if none does."""
    out = None
    for name, pattern in SOURCE_TIERS:
        held = c.rlike(pattern)
        out = F.when(held, name) if out is None else out.when(held, name)
    return out.otherwise("other")


def url_plain(url: Column) -> Column:
    """[P-14] http or https, with a host and no user info."""
    part = lambda name: F.try_parse_url(url, F.lit(name))
    return F.coalesce(part("PROTOCOL").isin("http", "https") & part("USERINFO").isNull() & part("HOST").isNotNull(), F.lit(False))


def url_allowed(url: Column, hosts: list[str]) -> Column:
    """[P-14] A plain address whose host is on the list; where the list is a table, join it to url_plain addresses."""
    return url_plain(url) & F.coalesce(F.lower(F.try_parse_url(url, F.lit("HOST"))).isin(*[h.lower() for h in hosts]), F.lit(False))


def path_allowed(path: Column, roots: list[str]) -> Column:
    """[P-15] Absolute, without steps upwards, at or below a root. Links are not resolved."""
    below = F.lit(False)
    for root in roots:
        bare = root.rstrip("/")
        below = below | (path == bare) | F.startswith(path, F.lit(bare + "/"))
    return F.coalesce(F.startswith(path, F.lit("/")) & ~path.rlike(r"(^|/)\.\.(/|$)") & below, F.lit(False))
