"""Importance resampling, licence scans and source divergence."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import common, divergence, importance, licenses, queries
from millrace.llm.common import table

LOWER = {c: c + 32 for c in range(65, 91)}
ALNUM, ALPHA = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"


def words(text, pattern=ALNUM):
    return re.findall(pattern, (text or "").translate(LOWER))


def frame(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for clash in ("score", "rank", "run", "n", "term", "eligible", "part", "matches"):
        docs = docs.withColumn(clash, F.lit("clash"))
    return docs


ODD = [None, "", " \t\n", "one", "Two words", "three Words here", "été À Ünder 中文 a1 1a", "x" * 5000, "a\x00b\x7fc MIT\nLicense", "  MIT   LICENSE.apache license--mit license  "]


def odd_rows(n=240, seed=3):
    r = random.Random(seed)
    pool = ["alpha", "Beta", "gamma", "été", "MIT", "License", "apache", "general", "public", "version", "3", "2", "0", "the", "gnu", "licensed", "under"]
    texts = [" ".join(r.choice(pool) for _ in range(r.randint(0, 60))) for _ in range(n)] + ODD
    rows = [(i, t, r.choice(["en", "de", None, "Zz"]), r.choice(["a", "b", "B", "é", None, "ab"])) for i, t in enumerate(texts)]
    rows += [(5, texts[5], "en", "a"), (5, texts[5], "en", "a"), (None, texts[7], "en", "b"), (None, None, None, None), (9000, " ".join(filter(None, texts)), "de", "b"), (-3, texts[9], "en", "a")]
    return rows


# importance


def features(text):
    w = words(text)
    return [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def plain_resample(rows, target, percent=5, least=20, buckets=10_000):
    def counted(texts):
        c = [0] * buckets
        for t in texts:
            for f in features(t):
                c[zlib.crc32(f.encode()) % buckets] += 1
        return c

    s, t = counted(r[1] for r in rows), counted(target)
    S, T = sum(s), sum(t)
    gain = [math.floor(1000 * math.log((y + 1) * (S + buckets) / ((x + 1) * (T + buckets)))) for x, y in zip(s, t, strict=True)]
    out = []
    for doc, text, *_ in rows:
        f = features(text)
        weight = sum(gain[zlib.crc32(x.encode()) % buckets] for x in f)
        h = int(hashlib.sha256(f"42:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        out.append([doc, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(text))])
    fit = sorted((o for o in out if o[5] >= least), key=lambda o: (-o[3], o[0] is None, o[0] or 0))
    for rank, o in enumerate(fit[: len(fit) * percent // 100], 1):
        o[4] = rank
    return Counter(tuple(o[:5]) for o in out)


@pytest.mark.parametrize("percent", [0, 5, 50, 100])
def test_resampling_against_a_plain_version(spark, monkeypatch, percent):
    monkeypatch.setattr(importance, "RANGE_ROWS", 7)
    monkeypatch.setattr(importance, "BINS", 5)
    monkeypatch.setattr(importance, "FAN_IN", 2)
    rows, target = odd_rows(), ["alpha beta gamma", None, "", "Mit license under version 3"]
    got = importance.resample(frame(spark, rows).repartition(5), spark.createDataFrame([(t,) for t in target], "text string"), percent).collect()
    assert Counter(tuple(r) for r in got) == plain_resample(rows, target, percent)


def test_resampling_of_empty_tables(spark):
    docs, target = frame(spark, odd_rows()), spark.createDataFrame([("a b",)], "text string")
    assert importance.resample(docs.limit(0), target).count() == 0
    rows = odd_rows()
    assert Counter(tuple(r) for r in importance.resample(docs, target.limit(0)).collect()) == plain_resample(rows, [])


def test_resampling_of_ties_by_id(spark):
    rows = [(i % 50, -1, 4, 100 - i % 3, True) for i in range(300)] + [(None, 1, 1, 100, True), (7, 1, 1, 500, False)]
    got = importance.draw(spark.createDataFrame(rows, "doc_id long, n_features long, weight long, score long, eligible boolean").repartition(6), 20).collect()
    fit = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))[: 301 * 20 // 100]
    assert [(r.doc_id, r.score) for r in sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])] == [(r[0], r[3]) for r in fit]
    assert Counter((r.doc_id, r.score) for r in got) == Counter((r[0], r[3]) for r in rows)


def test_resampling_query(spark, sf):
    rows = [tuple(r) for r in table(spark, sf, "documents").select("doc_id", "text").collect()]
    target = [r.text for r in table(spark, sf, "benchmark").collect()]
    assert Counter(tuple(r) for r in queries.op11_importance(spark, sf).select("doc_id", "n_features", "weight", "score", "rank").collect()) == plain_resample(rows, target)


def test_checksums_of_runs():
    r = random.Random(4)
    some = [bytes(r.choice(b"abcxyz019") for _ in range(r.choice([1, 2, 3, 7, 40, 3000]))) for _ in range(50)]
    for n, found in enumerate(importance.run_checksums(some)):
        assert found[n:].tolist() == [zlib.crc32(b" ".join(some[i - n : i + 1])) for i in range(n, len(some))]
    assert [len(x) for x in importance.run_checksums([])] == [0, 0, 0]


def test_features_of_long_texts_in_pieces():
    r = random.Random(5)
    texts = [" ".join(r.choice("abcdefgh") * r.randint(1, 9) for _ in range(n)) for n in (260_000, 3, 210_000, 1, 0, 2)]
    found, pieces = defaultdict(Counter), list(importance._features([t.encode() for t in texts], 97))
    assert len(pieces) > 2
    for who, bucket, _ in pieces:
        for w, b in zip(who.tolist(), bucket.tolist(), strict=True):
            found[w][b] += 1
    assert {i: Counter(zlib.crc32(f.encode()) % 97 for f in features(t)) for i, t in enumerate(texts) if t} == dict(found)


@pytest.mark.parametrize("k", [0, 1, 2, 3, 7, 200])
def test_trees_of_losers(k):
    r = random.Random(k)
    runs = [sorted((r.randint(0, 30), r.randint(0, 3)) for _ in range(r.randint(0, 20))) for _ in range(k)]
    assert list(importance.merge_runs([iter(x) for x in runs])) == sorted(x for run in runs for x in run)


# licences


def plain_matches(text, templates):
    w, out = words(text), []
    for number, t in enumerate(templates):
        pattern, need = words(t.text), math.ceil(t.need * len(words(t.text)) - 1e-9)
        best = []
        for start in range(-len(pattern) - t.slack, len(w) + t.slack + 1):
            near = [any(0 <= start + j + d < len(w) and w[start + j + d] == p for d in range(-t.slack, t.slack + 1)) for j, p in enumerate(pattern)]
            stretch = w[max(0, start - t.slack) : max(0, start + len(pattern) + t.slack)]
            keyed = all(any(stretch[i : i + len(words(k))] == words(k) for i in range(len(stretch) - len(words(k)) + 1)) for k in t.keys)
            if sum(near) >= need and keyed:
                best.append((number, start, sum(near)))
        if best and not (t.need == 1 and not t.slack):
            best = [min(best, key=lambda m: (-m[2], m[1]))]
        out += best
    return out


def damaged(r, text):
    w = text.split()
    for _ in range(r.randint(0, 4)):
        at = r.randrange(len(w))
        r.choice([lambda at=at: w.insert(at, "extra"), lambda at=at: w.pop(at), lambda at=at: w.__setitem__(at, "other")])()
    return " ".join(["before"] * r.randint(0, 5) + w + ["after"] * r.randint(0, 5))


def license_rows():
    r, rows = random.Random(8), odd_rows(60)
    rows += [(20_000 + i, damaged(r, r.choice(licenses.NOTICES).text) + ". " + r.choice(["", "MIT License", damaged(r, r.choice(licenses.NOTICES).text)]), "en", "a") for i in range(150)]
    return rows


def test_notices_against_all_starts(spark):
    templates, rows = licenses.PHRASES + licenses.NOTICES, license_rows()
    got = licenses.find_notices(frame(spark, rows)).collect()
    assert Counter((r.doc_id, r.n_words, tuple((m.template, m.start, m.n_fit) for m in r.matches)) for r in got) == Counter((d, len(words(t)), tuple(plain_matches(t, templates))) for d, t, *_ in rows)
    assert len({m.template for r in got for m in r.matches}) == len(templates)
    assert licenses.scan_licenses(frame(spark, rows).limit(0)).count() == 0


def plain_base(text):
    w, phrases = words(text), {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
    found = [(i, label) for phrase, label in phrases.items() for i in range(len(w)) if " ".join(w[i : i + len(phrase.split())]) == phrase]
    starts = [i for i, _ in found]
    return len(w), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in found}))


def test_license_query(spark, sf):
    templates = licenses.PHRASES + licenses.NOTICES
    texts = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    want = []
    for d, t in texts:
        found = plain_matches(t, templates) if re.search("licen|permi|redistr|reserved|software", t or "", re.I) else []
        want.append((d, *plain_base(t), ",".join(sorted({templates[n].label for n, *_ in found})), max([k / len(words(templates[n].text)) for n, _, k in found], default=0.0)))
    got = queries.op12_licenses(spark, sf).collect()
    assert Counter(tuple(r) for r in got) == Counter(want)
    assert sum(r.n_base > 0 for r in got) and any(r.labels != r.base_labels for r in got)


def test_scan_counts_all_places_of_phrases(spark):
    rows = [*license_rows(), (1, "mit license " * 1000 + "general public license", "en", "a")]
    got = licenses.scan_licenses(frame(spark, rows)).collect()
    assert Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got) == Counter((d, *plain_base(t)) for d, t, *_ in rows)
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in got)


def test_index_has_the_rarest_places_only():
    vocabulary = licenses.Vocabulary(licenses.PHRASES)
    index = licenses.RareIndex(licenses.PHRASES, vocabulary, 100, {vocabulary.numbers[b"license"]: 90, vocabulary.numbers[b"public"]: 3, vocabulary.numbers[b"general"]: 5})
    assert sorted(vocabulary.words[w] for w in index.postings) == [b"apache", b"mit", b"public"]


# divergence


def plain_divergence(rows, least=30, top=50):
    docs = [("" if x is None else x, "" if s is None else s, words(t, ALPHA)) for _, t, x, s in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        held = Counter(t for d in own for t in set(d[2]))
        kept = {t for t, n in held.items() if n >= least}
        counts = {s: Counter() for s in {d[1] for d in own}}
        for _, s, ts in own:
            counts[s].update(t for t in ts if t in kept)
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept)) for t in kept}  # noqa: B023, E731
        q, p = share(sum(counts.values(), Counter())), {s: share(c) for s, c in counts.items()}
        for s in counts:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in counts if o != s]
            more = [(p[s][t] - q[t], t) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, found, limit in (("pair", pairs, None), ("term", more, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, i) for i, (value, item) in enumerate(found[:limit], 1)]
    return sorted(out)


@pytest.mark.parametrize("small", [False, True])
def test_divergence_against_a_plain_version(spark, monkeypatch, small):
    if small:
        for name, value in (("BLOCK_BYTES", 300), ("HELD", 20), ("TILE", 2), ("PART_TERMS", 3)):
            monkeypatch.setattr(divergence, name, value)
    rows = odd_rows() + [(1, "lonely", "only", "x"), (2, None, "only", "y"), (3, "x", "en", "empty"), (4, "", "en", "")]
    got = divergence.divergence(frame(spark, rows).repartition(3), 20, 4)
    assert sorted(tuple(r) for r in got.collect()) == plain_divergence(rows, 20, 4)


def test_divergence_query_and_empty_table(spark, sf):
    docs = table(spark, sf, "documents")
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang", "source").collect()]
    assert sorted(tuple(r) for r in queries.op13_divergence(spark, sf).collect()) == plain_divergence(rows)
    assert divergence.divergence(docs.limit(0)).count() == 0


def test_shares_of_counts_beyond_64_bits(spark):
    row = spark.range(1).select(divergence._share(F.lit(9 * 10**17), F.lit(9 * 10**18), F.lit(10**6)).alias("p")).first()
    assert row.p == 1 + 10**9 * (9 * 10**17 + 5) // (9 * 10**18 + 5 * 10**6)


def test_lists_and_slices_keep_all():
    import pyarrow as pa

    text = ("a b-c " * 1000 + "D" * 5000 + " e" * 100).encode()
    letters = common.word_table(b"abcde")
    parts = list(common.word_lists(text, letters, 64))
    assert [w for p in parts for w in p] == text.translate(letters).split() and max(map(len, parts)) <= 64
    batch = pa.record_batch({"text": ["x" * n for n in (10, 10, 50, 0, 5, 5)] + [None, "y"]})
    cut = list(common.slices_of_bytes(iter([batch]), limit=20))
    assert [b.num_rows for b in cut] == [2, 1, 5] and pa.Table.from_batches(cut).to_pylist() == batch.to_pylist()
    assert not list(common.slices_of_bytes(iter([batch.slice(0, 0)])))
    assert np.array(list(common.word_lists(b"", letters))).size == 0
