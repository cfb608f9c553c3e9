"""Line dedup, language model, mixing, near duplicates and the pipeline."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.llm import bpe, line_dedup, lm_score, mil_quality, mixing, near_dup, queries
from millrace.llm.common import table
from millrace.llm.graph import components


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("repeats", F.lit("clash"))


def plain_dedup(rows, least=10):
    holders = defaultdict(set)
    key = lambda line: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\v\f\r"))
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if doc is not None:
                holders[key(line)].add(doc)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        stay = [x for x in lines if doc is None or len(key(x)) < least or len(holders[key(x)]) < 2 or doc == min(holders[key(x)])]
        out.append((doc, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return out


def test_line_dedup_against_a_plain_version(spark):
    r = random.Random(1)
    lines = ["", "short", "a common line here", "A Common Line HERE ", "\tééééééééé", "ééééééééééé", "éÉÉÉÉÉÉÉÉÉÉ", *(f"line number {i} of many" for i in range(60))]
    rows = [(i, "\n".join(r.choice(lines) for _ in range(r.randint(0, 8)))) for i in range(300)]
    rows += [(None, "a common line here"), (5000, None), (5001, ""), (5002, "twice in one doc\ntwice in one doc"), (5002, "twice in one doc"), (5003, "\n".join(lines) * 40)]
    docs = frame(spark, [(d, t, None, None, None) for d, t in rows])
    got = [(o.doc_id, o.n_lines, o.n_dropped, o.text) for o in line_dedup.dedup_lines(docs).collect()]
    assert Counter(got) == Counter(plain_dedup(rows))
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


def test_line_dedup_in_many_shards_and_batches(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 5)
    monkeypatch.setattr(line_dedup, "COPY_DOCS", 20)
    rows = [(i, f"the same line for all\nline {i // 2} for two of them\nline {i} alone") for i in range(200)]
    got = [(o.doc_id, o.n_lines, o.n_dropped, o.text) for o in line_dedup.dedup_lines(frame(spark, [(d, t, None, None, None) for d, t in rows])).collect()]
    assert Counter(got) == Counter(plain_dedup(rows))


def test_only_shards_with_a_hot_line_are_copied(spark):
    rows = [(i, "the same line for all\n" + f"line {i // 2} for two of them") for i in range(400)]
    docs = frame(spark, [(d, t, None, None, None) for d, t in rows]).select("doc_id", "text")
    repeated = line_dedup.repeated_keys(docs)
    hot = line_dedup.hot_shards(repeated, 20, 50)
    assert [r.copies for r in hot.collect()] == [8] and line_dedup.build_index(repeated, 20).count() == 20
    dropped = line_dedup.probe_index(docs, line_dedup.build_index(repeated, 20), 20, hot)
    assert dropped.count() == 399 + 200
    assert line_dedup.hot_shards(repeated, 20, 400).count() == 0


def test_line_index_keeps_keys_that_share_half_a_hash():
    import pandas as pd

    rows = pd.DataFrame({"h1": [5, 5, 5, 9], "h2": [1, 2, 3, 4], "first_doc": [10, 20, 30, 40], "doc_count": [2, 2, 1, 3]})
    arrays = line_dedup._build_shard((0,), rows)
    assert len(arrays) == 3
    pack = lambda *x: np.array(x, np.int64).tobytes()
    probes = pd.DataFrame({"shard": [0], "h1": [pack(5, 5, 5, 9, 7)], "h2": [pack(1, 2, 3, 4, 4)], "counts": [pack(2, 1, 1, 1, 1)], "docs": [pack(10, 11, 21, 31, 41, 50)]})
    batches = [pa.RecordBatch.from_pandas(pd.concat([arrays.assign(h1=None, h2=None, counts=None, docs=None), probes.assign(sizes=None, bits=None, fingerprints=None, first_docs=None, doc_counts=None)]).astype({"shard": "int32"}), preserve_index=False)]
    (found,) = line_dedup._look_up(iter(batches))
    # 31 stays: a count of one is no repeat
    assert sorted(zip(found["doc_id"].to_pylist(), found["h1"].to_pylist(), found["h2"].to_pylist(), strict=True)) == [(11, 5, 1), (21, 5, 2), (41, 9, 4)]


def test_perfect_hash():
    r = np.random.default_rng(1)
    for n in (0, 1, 2, 1000, 20_000):
        keys = np.unique(r.integers(0, 2**63, n, dtype=np.uint64))
        hashed = line_dedup.PerfectHash.unpack(*line_dedup.PerfectHash.build(keys).pack())
        assert sorted(hashed.index(keys)) == list(range(len(keys)))
        assert hashed.index(r.integers(0, 2**63, 100, dtype=np.uint64)).max(initial=-1) < max(n, 1)


def test_model_is_normalised_and_beats_counts(spark, sf):
    docs = table(spark, sf, "documents")
    counts = lm_score.count_words(docs)
    vocabulary, at_place = lm_score.build_vocabulary(counts)
    texts = lm_score.read_documents(docs.select("doc_id", "text", F.lit(False).alias("held_out")), vocabulary).where("n_tokens is not null")
    model = lm_score.train(texts.select("key", "units"), at_place)
    before = np.array([3, 700, 12, 900])
    logs = [model.log10_probability(np.append(before, u), np.array([5]))[-1] for u in range(lm_score.UNITS)]
    assert math.isclose(sum(10**x for x in logs), 1, rel_tol=1e-4)
    # words within a class, with its unseen type, sum to one as well
    rows = counts.where(F.col("hash") != lm_score.END).toPandas()
    outside = ~rows["hash"].isin(vocabulary.unit_hashes)
    for kind, part in list(rows[outside].groupby("kind"))[:20]:
        assert math.isclose(sum((part["times"] + 0.1) / 10 ** vocabulary.class_logs[kind]) + 0.1 / 10 ** vocabulary.class_logs[kind], 1, rel_tol=1e-9)


def test_lm_scores_against_plain_counts(spark, sf, monkeypatch):
    monkeypatch.setattr(lm_score, "FREQUENT", 50)  # most words go by the join
    rows = [(d.doc_id, d.text) for d in table(spark, sf, "documents").collect()] + [(None, None), (7001, ""), (7002, "unseenword unseenword"), (7002, "unseenword unseenword")]
    docs = frame(spark, [(d, t, None, None, None) for d, t in rows])
    tokens = lambda text: [*"".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\n", " ").split(" "), "\n"]
    split = [(d, [t for t in tokens(x) if t]) for d, x in rows]
    bucket = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 10
    counts = Counter(t for d, ts in split if bucket(d) for t in ts)
    n, v = sum(counts.values()), len(counts)
    want = sorted((-1 if d is None else d, bucket(d) == 0, len(ts), sum(counts[t] > 0 for t in ts), n, round(sum(math.log10((counts[t] + 0.1) / (n + 0.1 * (v + 1))) for t in ts), 5)) for d, ts in split)
    out = lm_score.lm_scores(docs).collect()
    got = sorted((-1 if o.doc_id is None else o.doc_id, o.held_out, o.n_tokens, o.n_known, o.train_tokens, round(o.base_score, 5)) for o in out)
    for g, w in zip(got, want, strict=True):
        assert g[:5] == w[:5] and math.isclose(g[5], w[5], abs_tol=1e-4)
    held = [o for o in out if o.held_out]
    assert sum(o.score for o in held) > sum(o.base_score for o in held)
    assert lm_score.lm_scores(docs.limit(0)).count() == 0


def test_lm_fits_all_training_texts(spark, monkeypatch):
    """The tokens behind the fitted weights are those of every training text, whatever the parts."""
    docs = spark.createDataFrame([(i, f"a b c{i % 7}") for i in range(300)], "doc_id long, text string")
    vocabulary, at_place = lm_score.build_vocabulary(lm_score.count_words(docs))
    texts = lm_score.read_documents(docs.withColumn("held_out", F.lit(False)), vocabulary).where("n_tokens is not null").select("key", "units")
    for size in (5000, 100, 10):  # one part; two levels of averages over 12 parts; 120 parts
        monkeypatch.setattr(lm_score, "PART_TOKENS", size)
        monkeypatch.setattr(lm_score, "AVERAGED", 4)
        parts = texts.withColumn("part", F.pmod("key", F.lit(7)).cast("int")).repartition(3, "part").sortWithinPartitions("part", "key", "units").select("part", "units")
        fitted = parts.mapInArrow(lm_score._fitter(lm_score.LogBilinear(at_place)), lm_score.FITTED).collect()
        assert sum(r.tokens for r in fitted) == 1200 and len({r.part for r in fitted}) == len(fitted)
        lm_score.train(texts, at_place)


def test_lm_scores_do_not_depend_on_partitions(spark, sf, monkeypatch):
    monkeypatch.setattr(lm_score, "PART_TOKENS", 20_000)
    docs = table(spark, sf, "documents").select("doc_id", "text").union(spark.createDataFrame([(1, "word other " * 40_000), (77_777, None), (None, "a b")], "doc_id long, text string"))
    docs = docs.union(docs.where("doc_id < 3"))
    outs = []
    for n in (1, 8, 31):
        rows = lm_score.lm_scores(docs.repartition(n, "doc_id")).collect()
        outs.append(sorted(((r.doc_id if r.doc_id is not None else -1, r.n_tokens, r.score, r.base_score) for r in rows)))
    for other in outs[1:]:
        assert len(other) == len(outs[0])
        for a, b in zip(outs[0], other, strict=True):
            assert a[:2] == b[:2] and abs(a[2] - b[2]) <= 1e-6 * a[1] and math.isclose(a[3], b[3], rel_tol=1e-9)


def test_lm_probabilities_against_a_plain_version():
    """One softmax after another, a token at a time."""
    r = np.random.default_rng(4)
    model = lm_score.LogBilinear(r.random(lm_score.UNITS))
    lengths = np.array([1, 7, 60, 3])
    units = r.integers(0, lm_score.UNITS, lengths.sum())
    model.fit(units, lengths)
    for scale in (1, 200):  # the second one overflows without care
        w = {k: v.astype(float) for k, v in model.weights.items()}
        w["Q"] *= scale
        model.weights["Q"] = w["Q"].astype(np.float32)
        want, at = [], 0
        softmax = lambda x: np.log(np.exp(x - x.max()) / np.exp(x - x.max()).sum())
        for n in lengths:
            for i in range(n):
                context = [int(units[at + i - j]) if i >= j else lm_score.UNITS for j in (1, 2, 3, 4)]
                v = sum(w["R"][u] * w["C"][j] for j, u in enumerate(context))
                g, p = divmod(int(units[at + i]), lm_score.PLACES)
                own = slice(g * lm_score.PLACES, (g + 1) * lm_score.PLACES)
                with np.errstate(divide="ignore"):
                    want.append((softmax(w["A"] @ v + w["a"])[g] + softmax(w["Q"][own] @ v + w["b"][own])[p]) / math.log(10))
            at += n
        assert np.allclose(model.log10_probability(units, lengths), want, rtol=1e-4, atol=1e-4)


def test_lm_slopes_are_those_of_the_noise_contrastive_loss():
    r = np.random.default_rng(5)
    noise, true = r.random(6) + 0.1, np.array([2, 0])
    logits = r.normal(size=(2, 6))

    def loss(x):
        chance = 1 / (1 + np.exp(np.log(noise) - x))
        rows = np.arange(2)
        return -np.log(chance[rows, true]).sum() - (noise * np.log(1 - chance)).sum()

    slope = lm_score._noise_errors(np.log(noise) - logits, noise, true)
    for at in np.ndindex(2, 6):
        step = np.zeros((2, 6))
        step[at] = 1e-5
        assert math.isclose((loss(logits + step) - loss(logits - step)) / 2e-5, slope[at], rel_tol=1e-5, abs_tol=1e-8)


def plain_shares(budget, children):
    """children: (name, weight, capacity). Water level by bisection."""
    if sum(c for _, _, c in children) <= budget:
        return {n: c for n, _, c in children}
    low, high = 0.0, max(c / w for _, w, c in children)
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(c, w * mid) for _, w, c in children) < budget else (low, mid)
    return {n: min(c, w * low) for n, w, c in children}


@pytest.mark.parametrize(("share", "epochs"), [(0.5, 2), (1.0, 3), (1.4, 2), (5.0, 2), (0.0, 1)])
def test_mixing_against_a_plain_version(spark, share, epochs):
    r = random.Random(3)
    rows = [(i, " ".join("w" for _ in range(r.randint(0, 40))), r.choice(["en", "de", None]), r.choice(["src0"] * 6 + ["src1", "src2", "src15", None]), 1) for i in range(400)]
    rows += [(950, "w " * 20_000, "de", "src2", 5)] if share == 1.0 else []
    rows += [rows[3], rows[3], (None, "a b", "en", "src1", None), (900, None, "xx", "src9", 0), (901, "", "xx", "src9", 0)]
    docs = frame(spark, rows).withColumn("mix", F.lit(1)).withColumn("tokens", F.lit(2))
    words = lambda t: len((t or "").split())
    domain = lambda s: "bulk" if s == "src0" else "sites" if s in ("src1", "src2", "src9") else "tail"
    leaves = Counter()
    for _, t, lang, s, _ in rows:
        leaves[domain(s or ""), lang or "", s or ""] += words(t)
    total = math.floor(sum(leaves.values()) * share)
    cap = lambda *p: epochs * sum(n for k, n in leaves.items() if k[: len(p)] == p)
    names = lambda depth, *p: sorted({k[depth] for k in leaves if k[:depth] == p})
    budgets = {}
    top = plain_shares(total, [(d, {"sites": 4}.get(d, 3), cap(d)) for d in names(0)])
    for d, bd in top.items():
        for lang, bl in plain_shares(bd, [(x, 4 if x == "en" else 2, cap(d, x)) for x in names(1, d)]).items():
            for s, b in plain_shares(bl, [(x, 1, cap(d, lang, x)) for x in names(2, d, lang)]).items():
                budgets[d, lang, s] = math.floor(b + 1e-6)
    out = mixing.mix_sources(docs, share, epochs).collect()
    taken = Counter()
    for o in out:
        taken[o.mix.domain, o.mix.lang, o.mix.source] += words(o.mix_row.text)
        assert abs(o.mix.budget - budgets[o.mix.domain, o.mix.lang, o.mix.source]) <= 1
    longest = max(words(t) for _, t, *_ in rows) * 3
    for leaf, budget in budgets.items():
        assert budget - longest <= taken[leaf] <= budget + 1
    times = Counter((o.mix_row.doc_id, o.mix.epoch) for o in out)
    assert all(n == (3 if d == 3 else 1) for (d, _), n in times.items() if d is not None) and all(e < epochs for _, e in times)
    assert mixing.mix_sources(docs.limit(0), share, epochs).count() == 0


def plain_components(rows, k):
    sets = {}
    for d, t in rows:
        w = (t or "").lower().split()
        n = min(k, len(w))
        sets[d] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d), find(d) == d) for d in sets}


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates_against_brute_force(spark, k):
    r = random.Random(k)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, passage = [], [r.choice(vocabulary) for _ in range(60)]
    for i in range(60):
        words = [r.choice(vocabulary) for _ in range(r.choice([1, 2, 3, 6, 12, 60, 200]))]
        if r.random() < 0.3:
            words += passage
        for c in range(r.choice([1, 1, 2, 8])):
            copy = list(words)
            for _ in range(r.choice([0, 0, 1, 1, 2, 5])):
                copy[r.randrange(len(copy))] = r.choice(vocabulary)
            rows.append((10 * i + c, " ".join(copy)))
    chain = [r.choice(vocabulary) for _ in range(100)]  # each like its neighbours only
    for c in range(8):
        rows.append((5000 - c, " ".join(chain)))
        for j in range(4):
            chain[(c * 12 + j * 3) % 100] = f"n{c}{j}"
    rows += [(9000, None), (9001, ""), (9002, " \n"), (9003, "One"), (9004, "one"), (9005, "x " * 20_000)]
    docs = frame(spark, [(d, t, None, None, None) for d, t in rows])
    got = {o.doc_id: (o.n_shingles, o.component_id, o.kept) for o in near_dup.near_duplicates(docs, k).collect()}
    assert got == plain_components(rows, k)


@pytest.mark.parametrize("block", [None, 3000])
def test_near_duplicates_finds_links_that_every_centre_misses(spark, monkeypatch, block):
    """Many texts of one bucket, most of them unlike one another: linked pairs must meet whatever the centres are."""
    if block:
        monkeypatch.setattr(near_dup, "BLOCK_SHINGLES", block)
    r = random.Random(1)
    word = lambda: f"w{r.randrange(10**6)}"
    passage, rows = [word() for _ in range(176)], []
    for i in range(150):
        words = passage + [word() for _ in range(24)]
        for c in range(2):
            rows.append((2 * i + c, " ".join(words[: 200 - 20 * c] + [word() for _ in range(20 * c)])))
    r.shuffle(rows)
    docs = frame(spark, [(d, t, None, None, None) for d, t in rows])
    got = {o.doc_id: (o.n_shingles, o.component_id, o.kept) for o in near_dup.near_duplicates(docs, 2).collect()}
    assert got == plain_components(rows, 2)
    assert len({c for _, c, _ in got.values()}) == 150


def test_near_duplicates_odd_rows(spark):
    rows = [(None, "a b c d e f"), (None, "only here once"), (4, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f"), (8, None), (None, None)]
    docs = frame(spark, [(d, t, None, None, None) for d, t in rows])
    got = Counter((o.doc_id, o.component_id, o.kept) for o in near_dup.near_duplicates(docs).collect())
    assert got == Counter([(None, 2, False), (None, None, True), (4, 2, False), (2, 2, True), (2, 2, True), (8, 8, True), (None, None, True)])
    assert near_dup.near_duplicates(docs.limit(0)).count() == 0


def test_small_sets_are_signed_as_one_another():
    """At similarity 0.8 and above, sets of any size share a band nearly always."""
    r = np.random.default_rng(0)
    for size in (4, 8, 20, 100, 1000):
        missed = 0
        for _ in range(100):
            a = np.unique(r.integers(0, 2**64, size, dtype=np.uint64))
            b = np.append(a[: max(1, len(a) - len(a) // 9)], r.integers(0, 2**64, len(a) // 9, dtype=np.uint64))
            missed += not (near_dup.band_values(a) == near_dup.band_values(np.unique(b))).any()
        assert missed == 0


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(120)] + [(5, 5)]
    root = {x: x for e in edges for x in e}
    for _ in range(len(root)):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {o.node: o.component for o in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: c for x, c in root.items() if any(x in e and e[0] != e[1] for e in edges)}


def test_pipeline_stages(spark, sf):
    import corpus_pipeline

    docs = table(spark, sf, "documents").withColumn("text_", F.lit(1)).withColumn("rest", F.lit("clash"))
    docs = docs.union(docs.limit(1)).union(spark.createDataFrame([(None, None, None, None, None, 1, "x"), (90_000, None, None, None, None, 1, "x")], docs.schema))
    kept = {name: None for name, _ in corpus_pipeline.STAGES}
    assert list(kept) == ["quality", "line_dedup", "near_dup", "mixing", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf).count() == 0
        before, docs = docs, stage(spark, docs, sf).cache()
        kept[name] = docs.count()
        if name != "packing":
            assert docs.columns == before.columns
            assert docs.select("doc_id").exceptAll(before.select("doc_id")).count() == 0
        rows, old = docs.collect(), before.collect()
        if name == "quality":
            model = mil_quality.train(before, table(spark, sf, "labels"))
            scores = model.score(*mil_quality.encode_passages([(o.text or "").encode() for o in old]))
            assert Counter(map(tuple, rows)) == Counter(tuple(o) for o, score in zip(old, scores, strict=True) if score >= 0.3)
        if name == "mixing":
            # each row at most once, and of each leaf a run of whole documents in seeded order within its budget
            assert not Counter(map(tuple, rows)) - Counter(map(tuple, old))
            budgets = {(o.mix.domain, o.mix.lang, o.mix.source): o.mix.budget for o in mixing.mix_sources(before, share=0.8, epochs=1).collect()}
            words = Counter()
            for o in rows:
                words[o.lang or "", o.source or ""] += len((o.text or "").split())
            assert all(words[lang, source] <= budget + 1 for (_, lang, source), budget in budgets.items()) and sum(words.values()) >= 0.6 * sum(len((o.text or "").split()) for o in old)
        if name == "packing":
            exact = bpe.load(bpe.default_path()).exact
            want = Counter((o.doc_id, len(exact.encode(o.text or "", add_special_tokens=False).ids) + 1) for o in old)
            assert Counter((o.doc_id, o.doc_tokens) for o in rows if o.start == 0) == want and sum(o.length for o in rows) == sum(n * k for (_, n), k in want.items())
        if name == "line_dedup":
            want = {(d, t) for d, n, gone, t in plain_dedup([(o.doc_id, o.text) for o in old]) if not gone or t.split()}
            assert {(o.doc_id, o.text) for o in rows} == want
            assert all(o.n_chars == len(o.text) for o in rows if o.n_chars is not None)
        if name == "near_dup":
            alive = {d for d, (_, _, keep) in plain_components([(o.doc_id, o.text) for o in old if o.doc_id is not None], 5).items() if keep}
            assert {o.doc_id for o in rows if o.doc_id is not None} == alive
    labels = table(spark, sf, "labels")
    assert kept["quality"] > 100 and kept["packing"] > 0 and labels.count()


def test_queries_are_registered():
    import __spark_entry__

    found = __spark_entry__.queries()
    assert set(range(1, 14)) == {int(q[2:].split("_")[0]) for q in queries.QUERIES} and set(queries.QUERIES) | {"pipeline"} <= set(found)
    assert set(__spark_entry__.oracle_sql()) <= set(found)
