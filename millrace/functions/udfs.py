"""Functions that Spark has no expressions for, as pandas UDFs over the standard library."""

from __future__ import annotations

import base64
import difflib
import html
import json
import re
import struct
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as Y

from .text import CJK, NARROW, WIDE

_cjk = re.compile(f"[{CJK}]")


@F.pandas_udf(Y.DoubleType())
def matcher_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """[F-18] The ratio of difflib, popular characters and the order of arguments included. Statistics of equal second
    arguments are computed once, so callers sort by them."""
    matcher, last, out = difflib.SequenceMatcher(None), None, []
    for x, y in zip(a, b, strict=True):
        if y != last:
            matcher.set_seq2(y)
            last = y
        matcher.set_seq1(x)
        out.append(matcher.ratio())
    return pd.Series(out, dtype="float64")


def subsequence_length(a: str, b: str) -> int:
    """The length of the longest common subsequence: a column of the table of lengths as the bits of a number, a step for each character of a."""
    places: dict[str, int] = {}
    for i, c in enumerate(b):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(b)) - 1
    row = full
    for c in a:
        step = row & places.get(c, 0)
        row = (row + step | row - step) & full
    return len(b) - row.bit_count()


@F.pandas_udf(Y.IntegerType())
def common_subsequence(a: pd.Series, b: pd.Series) -> pd.Series:
    """[F-18] What matching blocks can have at most: they stand in both strings in the same order."""
    return pd.Series([subsequence_length(x, y) for x, y in zip(a, b, strict=True)], dtype="int32")


@F.pandas_udf(Y.IntegerType())
def shared_characters(a: pd.Series, b: pd.Series) -> pd.Series:
    """[J-06] The characters that both strings have, counted with repetition."""
    counts = {s: Counter(s) for s in pd.concat([a, b]).unique()}
    return pd.Series([(counts[x] & counts[y]).total() for x, y in zip(a, b, strict=True)], dtype="int32")


@F.pandas_udf(Y.StringType())
def unescape_html(c: pd.Series) -> pd.Series:
    """[F-04] All character references of HTML."""
    return c.map(lambda x: None if x is None else html.unescape(x).strip())


# What quoting folds.
_folded = [(c, into) for given, into in (("‘’‚′", "'"), ("“”„″", '"'), ("–—−‐‑", "-"), ("\u00ad\u200b\ufeff", "")) for c in given]
_broken_word = re.compile(r"-(?<=[^\W\d_]-)[ \t]*\r?\n\s*(?=[^\W\d_])")


def _plain(text: str | None) -> str:
    plain = unicodedata.normalize("NFKC", text or "")
    if not plain.isascii():
        for c, into in _folded:
            plain = plain.replace(c, into)
    return plain


def _folded_form(plain: str) -> str:
    return "".join(plain.split()).casefold()


def _joined_words(plain: str) -> str:
    return _broken_word.sub("", plain) if "-" in plain and "\n" in plain else plain


def comparable_forms(text: str) -> tuple[str, str]:
    """[F-08] A text for comparison, with words broken at line ends joined and as they stand."""
    plain = _plain(text)
    joined = _joined_words(plain)
    stands = _folded_form(plain)
    return stands if joined == plain else _folded_form(joined), stands


def forms_of_pages(texts: list[str | None], following: list[str | None]) -> Iterator[tuple[str, str, int]]:
    """For each page the comparable forms of its text, a line end and what follows, and where the page itself ends in the longer one. A line end
    parts what is composed and folded, so a page that follows another one is folded once for both."""
    last, known = None, None
    for text, after in zip(texts, following, strict=True):
        plain, stands = known if known and text == last else (p := _plain(text), _folded_form(p))
        ends = len(stands)
        if after:
            last, known = after, (p := _plain(after), _folded_form(p))
            plain, stands = f"{plain}\n{p}", stands + known[1]
        joined = _joined_words(plain)
        yield stands if joined == plain else _folded_form(joined), stands, ends


@F.pandas_udf(Y.ArrayType(Y.StringType()))
def excerpt_pieces(excerpt: pd.Series) -> pd.Series:
    """[F-09] The comparable pieces of an excerpt that ellipses part, the shorter form of each; none if one has under eight characters."""

    def pieces(text: str | None) -> list[str]:
        found = [min(comparable_forms(p), key=len) for p in re.split(r"…|\[\.\.\.\]|\.\.\.", text or "") if p.strip()]
        return found if min(map(len, found), default=0) >= 8 else []

    return excerpt.map(pieces)


@F.pandas_udf(Y.StringType())
def comparable(c: pd.Series) -> pd.Series:
    """[F-08] The form with broken words joined."""
    return c.map(lambda x: None if x is None else comparable_forms(x)[0])


@F.pandas_udf(Y.StringType())
def salvaged_report(text: pd.Series) -> pd.Series:
    """[S-21] The one JSON object with a run_id that ends a text, fenced or bare; null if there is none, or more follows."""
    return text.map(salvage)


def salvage(text: str | None) -> str | None:
    body = (text or "").strip()
    fenced = re.search(r"```(?:json)?\s*\n(.*?)\n?```$", body, re.S)
    if fenced:
        body = fenced[1].strip()
    decoder, found = json.JSONDecoder(), []
    at = body.find("{")
    while at >= 0:
        try:
            value, end = decoder.raw_decode(body, at)
        except ValueError:
            at = body.find("{", at + 1)
            continue
        if isinstance(value, dict) and "run_id" in value:
            found.append((value, end))
        at = body.find("{", end)
    if len(found) != 1 or body[found[0][1] :].strip():
        return None
    return json.dumps(found[0][0], ensure_ascii=False, sort_keys=True)


@F.pandas_udf(Y.StringType())
def decode_bytes(content: pd.Series, declared: pd.Series) -> pd.Series:
    """[F-38] By the declared charset, then UTF-8, GB 18030, Big5 and UTF-16; else with replacements."""

    def decode(raw: bytes | None, charset: str | None) -> str | None:
        if raw is None:
            return None
        for name in (charset, "utf-8", "gb18030", "big5", "utf-16"):
            try:
                if name:
                    return bytes(raw).decode(name)
            except (LookupError, UnicodeDecodeError):
                pass
        return bytes(raw).decode("utf-8", "replace")

    return pd.Series([decode(r, c) for r, c in zip(content, declared, strict=True)])


@F.pandas_udf(Y.StructType([Y.StructField("format", Y.StringType()), Y.StructField("width", Y.IntegerType()), Y.StructField("height", Y.IntegerType())]))
def image_size(content: pd.Series) -> pd.DataFrame:
    """[F-39] From the header of PNG, GIF or JPEG."""

    def size(raw: bytes | None) -> tuple:
        raw = bytes(raw or b"")
        if raw[:8] == b"\x89PNG\r\n\x1a\n":
            return "png", *struct.unpack(">II", raw[16:24])
        if raw[:6] in (b"GIF87a", b"GIF89a"):
            return "gif", *struct.unpack("<HH", raw[6:10])
        at = 2
        while raw[:2] == b"\xff\xd8" and at + 9 < len(raw) and raw[at] == 0xFF:
            if 0xC0 <= raw[at + 1] <= 0xCF and raw[at + 1] not in (0xC4, 0xC8, 0xCC):
                height, width = struct.unpack(">HH", raw[at + 5 : at + 9])
                return "jpeg", width, height
            at += 2 + int.from_bytes(raw[at + 2 : at + 4], "big")
        return None, None, None

    return pd.DataFrame([size(r) for r in content], columns=["format", "width", "height"]).astype({"width": "Int32", "height": "Int32"})


def char_width(ch: str) -> float:
    if _cjk.match(ch):
        return 1
    return 0.3 if ch == " " else 0.32 if ch in NARROW else 0.86 if ch in WIDE else 0.68 if "A" <= ch <= "Z" else 0.56


@F.pandas_udf(Y.ArrayType(Y.StringType()))
def wrap_lines(text: pd.Series, width: pd.Series) -> pd.Series:
    """[F-28] Greedy lines of at most that width at size 13; CJK text breaks anywhere, other text at blanks."""

    def wrap(value: str | None, most: float) -> list[str]:
        lines, line = [], ""
        for token in re.findall(rf"[{CJK}]|[^\s{CJK}]+|\s+", value or ""):
            if token.isspace():
                line += " " if line else ""
            elif line.strip() and sum(map(char_width, line + token)) * 13 > most:
                lines.append(line.rstrip())
                line = token
            else:
                line += token
        return [*lines, line.rstrip()]

    return pd.Series([wrap(t, w) for t, w in zip(text, width, strict=True)])


@F.pandas_udf(Y.ArrayType(Y.IntegerType()))
def leftmost_matches(text: pd.Series, names: pd.Series) -> pd.Series:
    """[O-09] Start of each match of any of the names, longest first at a place, taken from the left without overlap."""

    def places(value: str | None, wanted) -> list[int]:
        wanted = sorted({w for w in (wanted if wanted is not None else []) if w}, key=lambda w: (-len(w), w))
        if not wanted:
            return []
        return [m.start() for m in re.finditer("|".join(map(re.escape, wanted)), value or "")]

    return pd.Series([places(t, n) for t, n in zip(text, names, strict=True)])


@F.pandas_udf(Y.StringType())
def data_uri(content: pd.Series, kind: pd.Series) -> pd.Series:
    """[S-26]"""
    return pd.Series([f"data:{k};base64,{base64.b64encode(bytes(c)).decode()}" for c, k in zip(content, kind, strict=True)])


