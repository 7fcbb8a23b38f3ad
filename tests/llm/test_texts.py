"""Operators that look at one text at a time, against plain Python."""

import hashlib
import io
import unicodedata
import wave
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from docgrid.llm import language, media, quality, token_count
from docgrid.llm.common import hash_limit, held_out

from .conftest import ROWS

MODEL = public_tokenizers.path("piece_bpe_32k.model")
PROTO = open(MODEL, "rb").read()
SP = sentencepiece.SentencePieceProcessor(model_proto=PROTO)
COUNTING = token_count.Counting(PROTO, token_count.prove(PROTO))


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_tokens(docs, none):
    got = rows_of(token_count.count_tokens(docs, MODEL, 20))
    want = [(i, len((t or "").encode()), n := len(SP.encode(t or "")), n > 20) for i, t, _, _ in ROWS]
    assert got == sorted(want, key=repr)
    assert token_count.count_tokens(none, MODEL).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(" \n\t\r▁abcdeThe.,é日🙂<0xA>/s 　\x00"), max_size=60))
def test_tokens_of_any_text(text):
    assert COUNTING.count(text) == len(SP.encode(text))


def test_tokens_in_blocks(monkeypatch):
    text = "Some words  and\nlines here " * 500
    monkeypatch.setattr(token_count.blocks, "__defaults__", (64,))
    assert COUNTING.count(text) == len(SP.encode(text))


def test_tokens_when_the_cache_is_full(monkeypatch):
    monkeypatch.setattr(token_count, "CACHE", 3)
    counting = token_count.Counting(PROTO, COUNTING.whole)
    for k in range(50):
        text = f"zqx{k} zqx{k + 1} the zqx{k - 3}kk"
        assert counting.count(text) == len(SP.encode(text))


def test_proof_refuses_a_model_that_normalises():
    assert "▁" in token_count.prove(PROTO)
    assert all(len(SP.encode(p[1:])) == 1 for p in list(COUNTING.whole)[:500] if p != "▁")
    for change in ({"remove_extra_whitespaces": True}, {"add_dummy_prefix": False}, {"precompiled_charsmap": b"x"}):
        model = sentencepiece_model_pb2.ModelProto.FromString(PROTO)
        for name, value in change.items():
            setattr(model.normalizer_spec, name, value)
        with pytest.raises((ValueError, RuntimeError)):
            token_count.prove(model.SerializeToString())


def test_media_round_trip(docs, none):
    stored = media.media_columns(docs)
    digest = {(r["doc_id"], r["n_bytes"]): r for r in media.media_digest(stored).collect()}
    for i, t, _, _ in ROWS:
        data = (t or "").encode()
        r = digest[(i, len(data))]
        payload = data + b" " * (-len(data) % 192 if data else 192)
        assert r["payload_bytes"] == len(payload) and r["payload_sha256"] == hashlib.sha256(payload).hexdigest()
        assert r["tail_crc32"] == zlib.crc32(payload[-16:])
        assert r["media_bytes"] == len(payload) + 44
    for m in stored.select("media").limit(3).collect():
        with wave.open(io.BytesIO(bytes(m["media"]))) as w:
            assert w.getsampwidth() == 1 and w.getnframes() % 192 == 0
    assert len({r["feature"] for r in digest.values() if r["doc_id"] in (1, 2)}) == 1
    assert media.media_digest(media.media_columns(none)).count() == 0


def test_media_fingerprint_by_definition():
    """Transforms as sums, the strongest lines by comparison, pairs by loops."""
    text = "".join(chr(int(c)) for c in np.random.default_rng(6).integers(32, 122, 192 * 9))
    n = np.arange(192)
    hann, lines = 0.5 - 0.5 * np.cos(2 * np.pi * n / 191), np.exp(-2j * np.pi * np.outer(np.arange(1, 97), n) / 192)
    top = []
    for f in np.frombuffer(text.encode(), np.uint8).astype(float).reshape(-1, 192):
        power = np.abs(lines @ ((f - f.mean()) * hann))
        assert np.abs(power % 1 - 0.5).min() > 1e-4  # no line's rounding is in doubt
        top.append(sorted(sorted(range(1, 97), key=lambda k: (-round(power[k - 1]), k))[:2]))
    want = sorted((t, a << 16 | b << 8 | gap) for t in range(len(top)) for gap in (1, 2, 3) if t + gap < len(top) for a in top[t] for b in top[t + gap])
    times, pairs = media.fingerprint(media.padded(text.encode()))
    assert list(zip(times.tolist(), pairs.tolist())) == want


def test_media_frames_in_blocks_are_the_same():
    samples = media.padded(np.random.default_rng(1).integers(32, 122, 20_000, np.uint8).tobytes())
    assert (media.peaks(samples, 7) == media.peaks(samples)).all()
    t, p = media.fingerprint(samples)
    assert (np.diff(t) >= 0).all() and len(t) == len(p) > 0


def test_language(spark, docs, none):
    words = {"en": "the of and to in is that for", "de": "der die und das nicht ein ist mit", "fr": "le la les des et une est que"}
    rng = np.random.default_rng(0)
    rows = [(i, " ".join(rng.choice(w.split(), 12)), v) for i, (v, w) in enumerate(list(words.items()) * 40)]
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(train, ~held_out(F.col("doc_id")))
    out = language.identify(train, model).filter(held_out(F.col("doc_id"))).collect()
    assert len(out) > 20 and sum(r["lang"] == r["lang_pred"] for r in out) >= 0.95 * len(out)
    got = language.identify(docs, model).collect()
    assert len(got) == len(ROWS) and all(0 <= r["score"] <= 1 for r in got)
    assert {r["doc_id"] for r in got if r["lang_pred"] == "und"} == {3, 4, 5, 7}
    assert language.identify(none, model).count() == 0
    assert {r["lang_pred"] for r in language.identify(docs, language.fit(none, F.lit(True))).collect()} == {"und"}


def test_kernel_is_the_presence_kernel():
    texts = ["aba", "abc", "xyz"]
    column = language.alphabet(sorted({int(x) for t in texts for s in language.slots(t) for x in s}))
    x = language.presence(["aba", "abab", "xyz"], column, int(column.max()))
    grams = lambda t: {f" {t} "[i : i + n] for n in range(1, 5) for i in range(len(t) + 3 - n)}
    known = grams("aba") | grams("abc") | grams("xyz")
    assert (x @ x.T)[0, 1] == len(grams("aba") & grams("abab") & known)
    assert (x @ x.T)[0, 2] == len(grams("aba") & grams("xyz"))


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=8))
def test_letters_are_letters(text):
    assert language.has_letter(text) == any(unicodedata.category(c)[0] == "L" for c in text)


def test_signs_are_no_language(spark):
    rows = [(i, t, "en") for i, t in enumerate(["½ ² ٣ _ 12", "Ⅷ ①", "a½", "ª", "日"])]
    model = language.fit(spark.createDataFrame([(k, "the cat and the dog", "en") for k in range(9)], "doc_id long, text string, lang string"), F.lit(True))
    got = language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), model).collect()
    assert [r["lang_pred"] for r in sorted(got)] == ["und", "und", "en", "en", "en"]


def test_samples_are_bounded(spark):
    """However many rows there are, the least hashes are taken, and never more than asked for."""
    for n in (10, 10**6, 10**11, 10**15):
        share = (hash_limit(1.2 * 500 + 50, n) + (1 << 63)) / (1 << 64)
        assert min(1, 640 / n) <= share <= min(1, 660 / n)
    docs = spark.range(3000).selectExpr("id AS doc_id", "concat('text number ', id) AS text", "concat('l', id % 5) AS lang").unionAll(spark.range(2000).selectExpr("CAST(NULL AS long)", "'the same text'", "'l0'"))
    sample = language.training_sample(docs, F.lit(True), 40, 3)
    counts = {r["lang"]: r["count"] for r in sample.groupBy("lang").count().collect()}
    assert len(counts) == 3 and "l0" in counts and set(counts.values()) == {40}
    least = sorted(r["k"] for r in docs.filter("lang = 'l0'").select(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text").alias("k")).distinct().collect())[:40]
    assert sorted(r["k"] for r in sample.filter("lang = 'l0'").collect()) == least
    labels = spark.range(3000).selectExpr("id AS doc_id", "CAST(id % 2 AS int) AS quality").unionAll(spark.range(500).selectExpr("7 AS doc_id", "1 AS quality"))
    copies = docs.unionAll(spark.range(500).selectExpr("7 AS doc_id", "'seven' AS text", "'x'"))
    seen = []
    grow = quality.grow
    try:
        quality.grow = lambda x, y: seen.append(len(y)) or grow(x, y)
        quality.fit(copies, labels, F.lit(True), sample=100)
    finally:
        quality.grow = grow
    assert seen and 95 <= seen[0] <= 100


def test_quality(spark, docs, none):
    rows = [(i, ("clean prose of words. " if i % 2 else "J@@NK $$$ ### ") * (3 + i % 7), i % 2) for i in range(400)]
    train = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    labels = train.select("doc_id", "quality")
    forest = quality.fit(train, labels, ~held_out(F.col("doc_id")))
    got = quality.score(train, forest).collect()
    assert all(r["predicted"] == r["doc_id"] % 2 == (r["score"] >= 0.5) for r in got)
    out = quality.score(docs, forest).collect()
    assert len(out) == len(ROWS) and all(0 <= r["score"] <= 1 for r in out)
    assert len({r["score"] for r in out if r["doc_id"] in (1, 2)}) == 1
    assert quality.score(none, forest).count() == 0
    assert quality.score(docs, quality.fit(train, labels.limit(0), F.lit(True))).first()["score"] == 0.5


def test_forest_walks_as_nodes_do():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 5))
    y = (x[:, 0] + x[:, 1] ** 2 > 0.5).astype(float)
    f = quality.grow(x, y)
    want = []
    for row in x[:50]:
        total = f.base
        for feature, limit, leaf in zip(f.feature, f.limit, f.leaf, strict=True):
            node = 0
            while node < len(feature):
                node = 2 * node + (2 if row[feature[node]] > limit[node] else 1)
            total += leaf[node - len(feature)]
        want.append(1 / (1 + np.exp(-total)))
    assert np.allclose(f.score(x[:50]), want)
    assert ((f.score(x) >= 0.5) == y).mean() > 0.95


@pytest.mark.parametrize("text", ["", "a", " ", "\n\n", "x" * 100_000])
def test_statistics_of_odd_texts(text):
    assert len(quality.statistics(text)) == len(quality.NAMES) and np.isfinite(quality.statistics(text)).all()


def test_predictions_by_plain_ridge_regression(spark):
    """Against the kernel matrix of the sample itself: the same landmarks, map and equations, solved in one piece."""
    words = {"aa": "the cat and dog of house", "bb": "le chat et chien de maison", "cc": "der hund und katze im haus"}
    of = np.random.default_rng(7)
    rows = [(k, " ".join(of.choice(words[lang].split(), 5)) + f" {'xyz'[k % 3]}", lang) for k in range(90) for lang in [["aa", "aa", "bb", "cc"][k % 4]]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    model = language.fit(docs, F.lit(True))
    sample = sorted((r["lang"], r["k"], r["text"]) for r in language.training_sample(docs, F.lit(True)).collect())
    n = model.landmarks.shape[0]
    x = language.presence([t for _, _, t in sample], model.column, n).astype(np.float64)
    y = np.array([sorted(words).index(v) for v, _, _ in sample])
    unit = x / np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1))
    marks = np.concatenate([unit[y == k][: language.LANDMARKS_PER_LANG] for k in range(3)])
    value, vector = np.linalg.eigh(marks @ marks.T)
    keep = value > 1e-6 * value.max()
    z = unit @ marks.T @ (vector[:, keep] / np.sqrt(value[keep]))
    weight = (len(y) / 3 / np.bincount(y))[y]
    told = np.linalg.solve(z.T @ (weight[:, None] * z) + language.RIDGE * len(y) / 100 * np.eye(z.shape[1]), z.T @ (weight[:, None] * np.eye(3)[y]))
    want = np.clip(z @ told, 0, 1)
    lang, score = model.score([t for _, _, t in sample])
    assert lang == [sorted(words)[k] for k in want.argmax(axis=1)] and np.allclose(score, want.max(axis=1), atol=2e-3)
    assert [language.landmarks_each(k) for k in (0, 4, 64, 256, 5000)] == [24, 24, 24, 6, 1]
