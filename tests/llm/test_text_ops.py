"""Token counts, packing, quality rules, chat formatting and media columns."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import bpe, chat_format, media, mil_quality, packing, quality_rules, token_counts
from millrace.llm.common import scratch_path, table

ODD = [None, "", " ", "\n\n", "a", "a a a a a a a a a a a a", "é　日本 🙂", "<|endoftext|> x <|endoftext|>", "word " * 3000, "x" * 5000]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, ties, repeated rows and a clashing extra column."""
    rows = [(i, t, None, 7.0) for i, t in enumerate(ODD)] + [(None, "a b c", "en", None), (1, "", None, 7.0), (0, "a", "en", 1.0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, n_tokens double").withColumn("digest", F.lit("x"))


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


def test_bpe_equals_the_library():
    pairs = bpe.load(bpe.default_path())
    assert pairs.fast is not None
    r = random.Random(1)
    letters = [*"abAB12 \n\t\r'’.,!?éß　\x85\xa0日本🙂́​\x1c", "<|endoftext|>", "'ll", " 's"]
    for _ in range(3000):
        text = "".join(r.choice(letters) for _ in range(r.randint(0, 25)))
        assert pairs.encode(text).tolist() == pairs.exact.encode(text, add_special_tokens=False).ids
    for start in range(0x100, 0x30000, 0x500):
        text = "".join(f"a{chr(c)}1 {chr(c)}{chr(c)}" for c in range(start, start + 0x30) if not 0xD800 <= c <= 0xDFFF)
        assert pairs.encode(text).tolist() == pairs.exact.encode(text, add_special_tokens=False).ids


def test_token_counts(spark, odd, none, sf):
    exact = bpe.load(bpe.default_path()).exact
    want = sorted((r.doc_id if r.doc_id is not None else -1, len((r.text or "").encode()), len(exact.encode(r.text or "", add_special_tokens=False).ids)) for r in odd.collect())
    cache = scratch_path(spark, "cache")
    for _ in range(2):  # from an empty cache, then from a full one
        got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_tokens) for r in token_counts.token_counts(odd, cache).collect())
        assert got == want
    distinct = odd.select(F.coalesce("text", F.lit(""))).distinct().count()
    assert token_counts.read_cache(spark, cache).count() == distinct  # the second run appended nothing
    assert token_counts.token_counts(none).count() == 0
    docs = table(spark, sf, "documents")
    for r in token_counts.token_counts(docs, cache).join(docs, "doc_id").limit(40).collect():
        assert r.n_tokens == len(exact.encode(r.text, add_special_tokens=False).ids) and r.over_limit == (r.n_tokens > 1024)


def test_best_fit_against_a_plain_version():
    r = np.random.default_rng(3)
    for _ in range(20):
        size = int(r.integers(4, 70))
        lengths = r.integers(1, size + 1, int(r.integers(0, 200)))
        sequence, offset = packing.best_fit_decreasing(lengths, size)
        rooms = []
        for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
            fits = [room for room in rooms if room >= lengths[k]]
            if fits:
                rooms.remove(min(fits))
                rooms.append(min(fits) - lengths[k])
            else:
                rooms.append(size - lengths[k])
        used = Counter()
        for s, n in zip(sequence, lengths, strict=True):
            used[s] += n
        assert sorted(size - u for u in used.values()) == sorted(rooms)
        for s in used:
            at = 0
            for o, n in sorted((o, n) for q, o, n in zip(sequence, offset, lengths, strict=True) if q == s):
                assert o == at
                at += n


def test_packing(spark, odd, none, sf):
    exact = bpe.load(bpe.default_path()).exact
    assert packing.pack_documents(none).count() == 0
    for docs in (odd, table(spark, sf, "documents")):
        rows = packing.pack_documents(docs).collect()
        whole = Counter((d.doc_id, len(exact.encode(d.text or "", add_special_tokens=False).ids) + 1) for d in docs.collect())
        assert Counter((r.doc_id, r.doc_tokens) for r in rows if r.start == 0) == whole
        assert sum(r.length for r in rows) == sum(n * k for (_, n), k in whole.items())
        by = {}
        for r in rows:
            by.setdefault(r.sequence_id, []).append(r)
        for pieces in by.values():
            at = 0
            for p in sorted(pieces, key=lambda p: p.offset):
                assert p.offset == at
                at += p.length
            assert at <= 2048
        assert sum(2048 - sum(p.length for p in ps) for ps in by.values()) <= 2 * 2048
    ids = {d.doc_id: np.array([*exact.encode(d.text or "", add_special_tokens=False).ids, 1], "<u4") for d in table(spark, sf, "documents").collect()}
    for r in rows:
        assert zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32


def plain_counts(text):
    words, line, seen, dups = [], "", set(), 0
    for part in (text or "").split("\n"):
        found = [w for w in part.replace("\t", " ").replace("\v", " ").replace("\f", " ").replace("\r", " ").split(" ") if w]
        words += found
        dups += bool(found) and part in seen
        seen.add(part)
    covered = set()
    spans = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    counts = Counter(spans)
    for i, s in enumerate(spans):
        if counts[s] > 1:
            covered |= set(range(i, i + 5))
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), dups, len(covered)


def test_rule_counts_and_learning(spark, odd, none, sf):
    r = random.Random(4)
    texts = ["".join(r.choice(["a ", "b ", "é ", "\n", "\t", "# ", "<x>", "\v"]) for _ in range(r.randint(0, 60))) for _ in range(300)]
    for text in texts:
        assert quality_rules.count_text(text.encode())[:5] == plain_counts(text)
    labels = table(spark, sf, "labels")
    for docs in (odd, table(spark, sf, "documents")):
        rules = quality_rules.learn_from(docs, labels)
        out = quality_rules.apply_rules(quality_rules.text_statistics(docs), rules).collect()
        want = Counter((d.doc_id, *plain_counts(d.text)) for d in docs.collect())
        assert Counter((o.doc_id, o.n_words, o.word_chars, o.n_symbols, o.n_dup_lines, o.n_repeat_words) for o in out) == want
        for o in out:
            assert o.base_failed == (o.n_words < 10 or 100 * o.n_repeat_words > 20 * o.n_words) and o.kept == (not o.base_failed and o.rule == 0)
    assert quality_rules.learn_from(none, labels) == [] and quality_rules.apply_rules(quality_rules.text_statistics(none), []).count() == 0


def test_rules_against_a_plain_evaluation(spark, sf):
    """The chain of conditions, worked out rule by rule in Python on features that DuckDB computes."""
    duckdb = pytest.importorskip("duckdb")
    counted = quality_rules.text_statistics(table(spark, sf, "documents"))
    rules = [
        (quality_rules.Condition("mean_word_chars", True, 5.0), quality_rules.Condition("n_words", False, 150.0)), (quality_rules.Condition("repeat_word_share", True, 0.01),),
        (quality_rules.Condition("upper_share", True, 0.02), quality_rules.Condition("symbols_per_word", True, 0.001)), (quality_rules.Condition("n_words", True, 300.0),),
    ]
    out = quality_rules.apply_rules(counted, rules).toPandas()
    con = duckdb.connect()
    con.register("counted", out)
    features = con.sql("SELECT doc_id, " + ", ".join(f"{e} AS {n}" for n, e in quality_rules.FEATURES.items()) + " FROM counted").fetchdf().set_index("doc_id").to_dict("index")
    for row in out.itertuples():
        f = features[row.doc_id]
        want = next((k for k, rule in enumerate(rules, 1) if all(f[c.feature] >= c.threshold if c.at_least else f[c.feature] <= c.threshold for c in rule)), 0)
        assert row.rule == want and row.kept == (want == 0 and not row.base_failed)
    assert out["rule"].nunique() >= 3


def test_rules_find_planted_thresholds():
    r = np.random.default_rng(0)
    x = {"a": r.random(3000), "b": r.random(3000), "c": r.random(3000)}
    rejected = ((x["a"] > 0.8) & (x["b"] > 0.5)) | (x["c"] < 0.1)
    rules = quality_rules.learn_rules(x, rejected)
    hit = np.zeros(3000, bool)
    for rule in rules:
        hit |= quality_rules._covers(rule, x)
    assert (hit == rejected).mean() > 0.98 and 2 <= len(rules) <= 6


def test_rules_on_held_out_labels(spark):
    docs, labels = (table(spark, "/root/testdata/sf0.01", t) for t in ("documents", "labels"))
    out = quality_rules.apply_rules(quality_rules.text_statistics(docs), quality_rules.learn_from(docs, labels))
    tested = out.join(labels.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0), "doc_id")
    good = tested.where("quality = 1 and not base_failed")
    assert good.where("kept").count() >= 0.98 * good.count()
    bad = tested.where("quality = 0")
    assert bad.where("not kept").count() >= 0.9 * bad.count()


def test_chat_round_trip(spark):
    r = random.Random(5)
    letters = ["<|", "im_end", "|>", "\\", "\n", "<", "|", "N", "a", "é", "<|im_sep|>", "<\\|", "<\\N|"]
    rows = [(c, t, r.choice(["user", "assistant", "a\nb<|x\\", None, "<\\N|"]), None if r.random() < 0.1 else "".join(r.choice(letters) for _ in range(r.randint(0, 8)))) for c in range(50) for t in range(r.randint(1, 6))]
    rows += [(None, None, None, None), (70, 1, "user", "a"), (70, 1, "user", "a")] + [(71, t, "assistant", f"{t}") for t in range(500)]
    rows += [(72, 0, "user", "<|im_end|> long " * 30_000), (72, 1, "assistant", "é\\ " * 60_000)]
    given = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit(1)).withColumn("messages", F.lit(1))
    out = chat_format.read_back(chat_format.format_conversations(given)).collect()
    assert {o.conv_id for o in out} == {x[0] for x in rows}
    for o in out:
        turns = [(x[2] or "", x[3] or "") for x in rows if x[0] == o.conv_id]
        assert [tuple(t) for t in o.turns] == turns
        assert o.loss_text == "".join(text for role, text in turns if role == "assistant")
        assert o.n_messages == sum(i == 0 or turns[i - 1][0] != t[0] for i, t in enumerate(turns))
        assert sum(run.length for run in o.loss_runs) == len(o.formatted)
    assert chat_format.format_conversations(given.limit(0)).count() == 0


def test_media_round_trip(spark, odd, none):
    r = random.Random(2)
    texts = [b"", b"a", "é".encode() * 100, bytes(r.randrange(256) for _ in range(5000)), bytes([255, 0] * 400), b"\xff" * 1000, b" " * 191, b"x" * 192, b"x" * 193, b"q" * 192 * 9000]
    stored = media.encode_jpegs(texts)
    for text, jpeg, planes in zip(texts, stored, media.decode_thumbnails(stored), strict=True):
        assert b"".join(p.tobytes() for p in planes) == media.pad(text) and media.encode_jpegs([text]) == [jpeg]
        if len(text) < 10_000:
            for image, plane in zip(media.parse(jpeg), planes, strict=True):
                dc = media._decode_plain(image)
                assert (np.clip(dc + 128, 0, 255) == plane).all()
    rows = media.media_columns(odd).collect()
    assert len(rows) == odd.count() and media.media_columns(none).count() == 0
    by_id = {}
    for row in rows:
        by_id.setdefault(row.n_bytes, set()).add((row.payload_sha256, row.media_sha256, row.feature))
    assert len(by_id[0]) == 1  # null and empty alike
    text = "word " * 3000
    row = next(x for x in rows if x.doc_id == 8)
    payload = media.pad(text.encode())
    assert (row.n_bytes, row.payload_bytes, row.payload_sha256, row.tail_crc32) == (len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
    assert media.store_media(odd).where("doc_id = 8").first().media == media.encode_jpegs([text.encode()])[0]


def _jpeg(planes, sampling, restart):
    """A colour image with AC coefficients, written bit by bit: planes of DC values for each component."""
    bits = []
    put = lambda value, n: bits.append(format(value, f"0{n}b")[-n:] if n else "")
    table, codes = media._canonical({**{c: 5 for c in range(12)}, 0x00 + 0x21: 5, 0x32: 5})
    ac_table, ac_codes = media._canonical({0: 3, 0x21: 3, 0x32: 3, 0xF0: 3})

    def coefficient(value):
        n = abs(value).bit_length()
        return value if value >= 0 else value + (1 << n) - 1, n

    wide, tall = planes[0].shape[1] // sampling[0][0], planes[0].shape[0] // sampling[0][1]
    scan, last = b"", [0] * len(planes)

    def flush():
        text = "".join(bits)
        text += "1" * (-len(text) % 8)
        bits.clear()
        return bytes(int(text[i : i + 8], 2) for i in range(0, len(text), 8)).replace(b"\xff", b"\xff\0")

    for mcu in range(wide * tall):
        if mcu and mcu % restart == 0:
            scan += flush() + bytes([255, 0xD0 + (mcu // restart - 1) % 8])
            last = [0] * len(planes)
        for k, (h, v) in enumerate(sampling):
            for block in range(h * v):
                value = int(planes[k][mcu // wide * v + block // h, mcu % wide * h + block % h])
                raw, n = coefficient(value - last[k])
                last[k] = value
                put(*codes[n])
                put(raw, n)
                for symbol, size in ((0xF0, 0), (0x21, 1), (0x32, 2)):
                    put(*ac_codes[symbol])
                    put(block & 1 | 1, size)
                put(*ac_codes[0])
    scan += flush()
    frame = b"\x08" + (8 * planes[0].shape[0]).to_bytes(2, "big") + (8 * planes[0].shape[1]).to_bytes(2, "big") + bytes([len(planes)])
    frame += b"".join(bytes([k + 1, h << 4 | v, 0]) for k, (h, v) in enumerate(sampling))
    head = bytes([len(planes)]) + b"".join(bytes([k + 1, 0]) for k in range(len(planes))) + b"\0\x3f\0"
    s = media._segment
    return b"\xff\xd8" + s(0xDB, b"\0" + bytes([4] * 64)) + s(0xC0, frame) + s(0xC4, b"\0" + table) + s(0xC4, b"\x10" + ac_table) + s(0xDD, restart.to_bytes(2, "big")) + s(0xDA, head) + scan + b"\xff\xd9"


def test_damaged_images_raise():
    texts = [("some words of text " * 50).encode()]
    (stored,) = media.encode_jpegs(texts)
    image = media.parse(stored)[0]
    assert image.flat
    image.scan = b"\xff\x00" * len(image.scan)
    with pytest.raises(ValueError, match="Huffman|restart"):
        media._decode_flat([image])
    # a scan of one of three components
    whole = _jpeg([np.zeros((8, 8), int)] * 3, [(1, 1)] * 3, 8)
    three = media._segment(0xDA, b"\x03\x01\0\x02\0\x03\0\0\x3f\0")
    assert three in whole and media.parse(whole)
    with pytest.raises(ValueError, match="several scans"):
        media.parse(whole.replace(three, media._segment(0xDA, b"\x01\x01\0\0\x3f\0")))


def test_other_baseline_images():
    r = np.random.default_rng(1)
    for sampling in ([(2, 2), (1, 1), (1, 1)], [(2, 1), (1, 1), (1, 1)], [(1, 1)]):
        h, v = sampling[0]
        planes = [r.integers(-200, 200, (3 * y, 4 * x)) for x, y in sampling]
        jpeg = _jpeg(planes, sampling, 3)
        image = media.parse(jpeg)[0]
        assert (image.width, image.height, len(image.components)) == (32 * h, 24 * v, len(sampling))
        assert (media._decode_plain(image) == planes[0]).all()
        (plane,) = media.decode_thumbnails([jpeg])[0]
        assert (plane == np.clip((planes[0] * 4 + 4) // 8 + 128, 0, 255)).all()
    with pytest.raises(ValueError, match="image"):
        media.parse(b"not an image")


def test_passages_against_a_plain_version():
    r = random.Random(6)
    texts = [b"", b" ", *("".join(r.choice(["Ab ", "c", "!!", "| ", "é ", "9 ", "\n", "ab ab "]) for _ in range(r.randint(0, 300))).encode() for _ in range(60))]
    x, sizes = mil_quality.encode_passages(texts)
    at = 0
    for text, n in zip(texts, sizes, strict=True):
        words = text.split()
        assert n == max(1, -(-len(words) // 64))
        for k in range(n):
            part, row = words[64 * k : 64 * k + 64], x[at]
            at += 1
            if not part:
                assert not row.any()
                continue
            joined = b"".join(part)
            assert np.isclose(row[0], len(joined) / len(part) / 10) and np.isclose(row[1], sum(65 <= c <= 90 for c in joined) / len(joined))
            assert np.isclose(row[9], sum(a == b for a, b in zip(part, part[1:], strict=False)) / len(part)) and np.isclose(row[10], len(set(part)) / len(part))
        alone, one = mil_quality.encode_passages([text])
        assert one[0] == n and np.allclose(alone, x[at - n : at], atol=1e-5)


def test_attention_against_a_plain_forward_pass():
    """One passage after another, without arrays of bags."""
    r = random.Random(8)
    texts = [b"", *(" ".join(r.choice(["Word", "x!", "9", "é", "| "]) for _ in range(r.randint(1, 400))).encode() for _ in range(12))]
    x, sizes = mil_quality.encode_passages(texts)
    model = mil_quality.AttentionModel().fit(x, sizes, np.array([i % 2 for i in range(len(sizes))], np.float32), epochs=2)
    p, at, want = {k: w.astype(float) for k, w in model.weights.items()}, 0, []
    squash = lambda v: 1 / (1 + math.exp(-v))
    for n in sizes:
        hidden, marks = [], []
        for row in x[at : at + n]:
            v = (row - model.mean) / model.scale
            h = [math.tanh(sum(v[i] * p["E"][i, j] for i in range(len(v))) + p["e"][j]) for j in range(len(p["e"]))]
            gate = [math.tanh(sum(h[i] * p["V"][i, j] for i in range(len(h)))) * squash(sum(h[i] * p["U"][i, j] for i in range(len(h)))) for j in range(len(p["w"]))]
            hidden.append(h)
            marks.append(math.exp(sum(g * w for g, w in zip(gate, p["w"], strict=True))))
        share = [m / sum(marks) for m in marks]
        bag = [sum(a * h[j] for a, h in zip(share, hidden, strict=True)) for j in range(len(hidden[0]))]
        want.append(squash(sum(b * c for b, c in zip(bag, p["c"], strict=True)) + p["c0"][0]))
        at += n
    assert np.allclose(model.score(x, sizes), want, atol=1e-4)


def test_attention_gradients():
    r = np.random.default_rng(0)
    sizes, y = np.array([1, 3, 2, 5]), np.array([0, 1, 1, 0.0])
    x = r.standard_normal((11, mil_quality.WIDTH))
    model = mil_quality.AttentionModel().fit(x.astype(np.float32), sizes, y, epochs=1)
    model.weights = {k: w.astype(np.float64) for k, w in model.weights.items()}

    def loss():
        p = model._forward(x, sizes)["y"]
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    for k, grad in model._gradients(x, sizes, y).items():
        w = model.weights[k]
        for i in list(np.ndindex(w.shape))[:: max(1, w.size // 5)]:
            keep = w[i]
            w[i] = keep + 1e-5
            up = loss()
            w[i] = keep - 1e-5
            down = loss()
            w[i] = keep
            assert np.isclose((up - down) / 2e-5, grad[i], atol=1e-6)


def test_classifier_on_held_out_labels(spark, odd, none):
    docs, labels = (table(spark, "/root/testdata/sf0.01", t) for t in ("documents", "labels"))
    model = mil_quality.train(docs, labels)
    tested = mil_quality.score_documents(docs, model).where("held_out").join(labels, "doc_id").collect()
    right = [t.predicted == t.quality for t in tested]
    assert len(right) > 50 and np.mean(right) >= 0.95
    scored = mil_quality.score_documents(odd, model).collect()
    assert len(scored) == odd.count() and all(0 <= s.score <= 1 and s.predicted == (s.score >= 0.3) for s in scored)
    assert mil_quality.score_documents(none, model).count() == 0
    assert {r.score for r in mil_quality.score_documents(odd, mil_quality.train(none, labels)).collect()} == {0.5}


def test_many_long_texts_in_one_batch_are_scored_in_bounded_memory():
    import pyarrow as pa

    from millrace.llm import mil_quality

    texts = [("word%d " % i) * 30_000 for i in range(24)]
    seen, encode = [], mil_quality.encode_passages
    r = np.random.default_rng(1)
    model = mil_quality.AttentionModel().fit(r.standard_normal((8, mil_quality.WIDTH)), np.full(4, 2), np.array([0, 1, 0, 1], np.float32), epochs=1)
    batch = pa.record_batch({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts)})
    mil_quality.encode_passages = lambda t: (seen.append(sum(map(len, t))), encode(t))[1]
    try:
        rows = pa.Table.from_batches(mil_quality._scorer(model)(iter([batch])))
    finally:
        mil_quality.encode_passages = encode
    assert rows["doc_id"].to_pylist() == list(range(len(texts))) and max(seen) <= 4 << 20 and len(seen) > 1
    assert np.allclose(rows["score"].to_numpy(), model.score(*encode([t.encode() for t in texts])), atol=1e-6)
