"""Language identification by a string kernel.

The kernel of two texts counts the n-grams of one to four characters (a blended spectrum) that are present in both,
divided by the geometric mean of what each has.  A bounded sample of labelled texts gives the landmarks of a Nyström
map, in which one-versus-rest kernel ridge regression is solved; a batch of texts is scored by three matrix products
(texts by n-grams, by landmarks, by languages).

The n-grams are those most frequent in the sample, found in a text through a hash of 2^20 slots.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import hash_limit, map_rows, packed, scratch, staged, unpacked

ORDERS = 4
SLOT_BITS = 20
SAMPLE_PER_LANG = 500
NGRAMS = 12_000
LANDMARKS_PER_LANG = 24
RIDGE = 0.05
BATCH = 128
MOST_LANGS = 256
MOST_LANDMARKS = 1_536  # of all languages together
PARTS = 4  # tasks that add up the ridge's equations
WORDLIKE = re.compile(r"[^\W\d_]")
WHITE = re.compile(r"\s+")


def has_letter(text: str) -> bool:
    """Whether a character of a letter category stands in the text; signs like ``½`` are word characters, not letters."""
    return any(m.group().isalpha() for m in WORDLIKE.finditer(text))


def slots(text: str) -> list[np.ndarray]:
    """Hash slots of all n-grams of the whole text, one array for each order."""
    code = np.frombuffer(f" {WHITE.sub(' ', text.lower()).strip()} ".encode("utf-32-le"), np.uint32).astype(np.uint64)
    out, h = [], np.zeros(len(code) + 1, np.uint64)
    for n in range(1, ORDERS + 1):
        if len(code) < n:
            break
        h = (h[: len(code) - n + 1] + code[n - 1 :] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        out.append((h * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - SLOT_BITS)).astype(np.int32))
    return out


class KernelModel:
    """Landmarks and ridge weights; ``score`` gives languages and scores of a list of texts."""

    def __init__(self, langs: list[str], column: np.ndarray, landmarks: np.ndarray, project: np.ndarray, weights: np.ndarray):
        self.langs, self.column, self.landmarks, self.project, self.weights = langs, column, landmarks, project, weights

    def presence(self, texts: list[str]) -> np.ndarray:
        return presence(texts, self.column, self.landmarks.shape[0])

    def features(self, x: np.ndarray) -> np.ndarray:
        norm = np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1))
        return (x @ self.landmarks / norm) @ self.project

    def score(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """``und`` and 0 where a text is null or has no letter."""
        lang, score = ["und"] * len(texts), [0.0] * len(texts)
        some = [i for i, t in enumerate(texts) if t and has_letter(t)]
        if not self.langs:
            return lang, score
        for s in range(0, len(some), BATCH):
            rows = some[s : s + BATCH]
            z = self.features(self.presence([texts[i] for i in rows])) @ self.weights
            z = np.round(z.astype(np.float64), 4)  # the products' last digits depend on the batch
            for i, k, v in zip(rows, z.argmax(axis=1), z.max(axis=1), strict=True):
                lang[i], score[i] = self.langs[k], float(min(1.0, max(0.0, v)))
        return lang, score


def presence(texts: list[str], column: np.ndarray, n: int) -> np.ndarray:
    """A row of zeros and ones for each text: which of ``n`` n-grams it has, by the ``column`` of each slot."""
    x = np.zeros((len(texts), n + 1), np.float32)  # the last column gathers n-grams outside the alphabet
    for row, text in zip(x, texts, strict=True):
        for s in slots(text):
            row[column[s]] = 1
    return x[:, :-1]


def alphabet(best: list[int]) -> np.ndarray:
    """Column of each slot, len(best) for those that aren't among the ``best``."""
    column = np.full(1 << SLOT_BITS, len(best), np.int32)
    column[np.sort(np.array(best, np.int64))] = np.arange(len(best))
    return column


def mapped(marks: np.ndarray, langs: list[str], column: np.ndarray) -> KernelModel:
    """The Nyström map of landmarks (rows of n-gram presence), without weights."""
    if not langs:
        return KernelModel([], column, np.zeros((0, 0), np.float32), np.zeros((0, 0)), np.zeros((0, 0)))
    marks = marks / np.sqrt(np.maximum(marks.sum(axis=1, keepdims=True), 1))
    value, vector = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    keep = value > 1e-6 * max(value.max(), 1e-9)
    project = vector[:, keep] / np.sqrt(value[keep])
    return KernelModel(langs, column, np.ascontiguousarray(marks.T, np.float32), project.astype(np.float32), np.zeros((0, 0)))


def products(model: KernelModel, x: np.ndarray, y: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """What rows of presence and their languages add to the ridge's equations: z'Wz beside z'Wt.

    Every language weighs alike, however many of its rows the sample has.
    """
    z = model.features(x).astype(np.float64)
    weight = counts.sum() / len(counts) / counts[y][:, None]
    return z.T @ (weight * np.concatenate((z, (y[:, None] == np.arange(len(counts))) * 1.0), axis=1))


def solved(model: KernelModel, sums: np.ndarray, rows: int) -> KernelModel:
    d = model.project.shape[1]
    model.weights = np.linalg.solve(sums[:, :d] + RIDGE * rows / 100 * np.eye(d), sums[:, d:]).astype(np.float32)
    return model


def landmarks_each(langs: int) -> int:
    """Landmarks of a language: fewer where many languages share what the driver may hold."""
    return max(1, min(LANDMARKS_PER_LANG, MOST_LANDMARKS // max(langs, 1)))


def training_sample(docs: DataFrame, usable: Column, per_lang: int = SAMPLE_PER_LANG, most_langs: int = MOST_LANGS) -> DataFrame:
    """Staged (k, lang, text): the ``per_lang`` labelled texts of each language with the least hash k of id and text,
    of the ``most_langs`` languages that have most rows; equal texts of an id count once.

    This bounds the sample whatever the table: ``per_lang`` x ``most_langs`` rows at most.
    """
    known = F.col("lang").isNotNull() & F.regexp_like(F.col("text"), F.lit(r"\p{L}"))
    rows = docs.filter(usable & known).select("lang", "text", F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text").alias("k"))
    counts = rows.groupBy("lang").agg(F.count("*").alias("n"), F.approx_count_distinct("k").alias("texts")).orderBy(F.desc("n"), "lang").limit(most_langs).collect()
    # a share of the hashes that a fifth more than ``per_lang`` texts are expected to have; the window takes those wanted
    wanted = F.lit(False)
    for lang, n in sorted((r["lang"], r["texts"]) for r in counts):
        wanted = wanted | ((F.col("lang") == lang) & (F.col("k") <= hash_limit(1.2 * per_lang + 50, n)))
    some = rows.filter(wanted).groupBy("lang", "k").agg(F.any_value("text").alias("text"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("k"))
    return staged(some.withColumn("place", place).filter(F.col("place") <= per_lang).select("k", "lang", "text"), "sample")


def fit(docs: DataFrame, usable: Column) -> KernelModel:
    """Learn from text and non-null lang of the ``usable`` rows of ``docs`` (columns doc_id, text, lang).

    The sample stays on the executors.  The driver gets the numbers of ``NGRAMS`` slots at most (those most frequent in a
    language), the landmarks (48 kB each, ``MOST_LANDMARKS`` at most), and of each of ``PARTS`` tasks the sums of the
    ridge's equations, as many rows as there are landmarks.
    """
    with scratch(docs.sparkSession):
        sample = training_sample(docs, usable)
        had = map_rows(sample, lambda: lambda c: {"lang": c["lang"], "slots": [np.unique(np.concatenate(slots(t))).tolist() for t in c["text"]]}, "lang string, slots array<int>")
        total = sample.groupBy("lang").agg(F.count("*").alias("of"))
        share = had.select("lang", F.explode("slots").alias("slot")).groupBy("lang", "slot").agg(F.count("*").alias("n")).join(F.broadcast(total), "lang")
        top = share.groupBy("slot").agg(F.max((F.col("n") / F.col("of")).cast("float")).alias("share")).orderBy(F.desc("share"), "slot").limit(NGRAMS)
        column = alphabet([r["slot"] for r in top.collect()])
        n = int(column.max()) if len(column) else 0

        def bits(c):
            return {"k": c["k"], "lang": c["lang"], "bits": [np.packbits(row > 0).tobytes() for row in presence(c["text"], column, n)]}

        found = staged(map_rows(sample, lambda: bits, "k long, lang string, bits binary"), "bits")
        counts = {r["lang"]: r["of"] for r in total.collect()}
        langs = sorted(counts)
        place = F.row_number().over(Window.partitionBy("lang").orderBy("k"))
        marks = found.withColumn("place", place).filter(F.col("place") <= landmarks_each(len(langs))).collect()
        unpack = lambda rows: np.array([np.unpackbits(np.frombuffer(b, np.uint8), count=n) for b in rows], np.float32).reshape(len(rows), n)
        model = mapped(unpack([r["bits"] for r in sorted(marks, key=lambda r: (r["lang"], r["k"]))]), langs, column)
        if not langs:
            return model
        given = docs.sparkSession.sparkContext.broadcast((langs, column, model.landmarks, model.project, np.array([counts[v] for v in langs])))

        def add(batches):
            *parts, of = given.value
            here, sums = KernelModel(*parts, np.zeros((0, 0))), 0
            for batch in batches:
                for s in range(0, batch.num_rows, BATCH):
                    rows = batch.slice(s, BATCH)
                    y = np.array([here.langs.index(v) for v in rows.column(0).to_pylist()])
                    sums = sums + products(here, unpack(rows.column(1).to_pylist()), y, of)
            if not isinstance(sums, int):
                pid = TaskContext.get().partitionId()
                yield pa.RecordBatch.from_arrays([pa.array([pid] * len(sums)), pa.array(range(len(sums))), pa.array(list(sums), pa.list_(pa.float64()))], names=["pid", "i", "row"])

        sums = found.select("lang", "bits").coalesce(PARTS).mapInArrow(add, "pid long, i long, row array<double>").collect()
        whole = np.zeros((model.project.shape[1], model.project.shape[1] + len(langs)))
        for r in sorted(sums, key=lambda r: r["pid"]):
            whole[r["i"]] += r["row"]
        return solved(model, whole, sum(counts.values()))


def identify(docs: DataFrame, model: KernelModel, keep: list[str] | None = None, named: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """Rows of ``docs`` (the columns ``keep``, by default all) with lang_pred and score of their whole ``text``
    (``named`` gives these columns other names).

    Null texts and texts without a letter (the empty one too) give ``und`` and 0; so does every row when no labelled
    row was there to learn from.  Ties go to the first language by code point; rows stay as they are, repeated ones
    too; an empty table gives an empty result.  Columns of ``docs`` named like the new ones, in whatever case, are
    replaced.
    """
    columns = keep or docs.columns
    return predicted(docs, model, columns).select(*unpacked("rec", columns, named), F.col("lang").alias(named[0]), F.col("score").alias(named[1]))


def predicted(docs: DataFrame, model: KernelModel, columns: list[str]) -> DataFrame:
    """rec (``columns`` packed), lang and score of every row."""
    # arrays and strings, bounded by NGRAMS x landmarks; the class itself travels with the function
    given = docs.sparkSession.sparkContext.broadcast((model.langs, model.column, model.landmarks, model.project, model.weights))

    def make():
        here = KernelModel(*given.value)

        def apply(c):
            lang, score = here.score(c["text"])
            return {"rec": c["rec"], "lang": lang, "score": score}

        return apply

    rows = docs.select(packed(columns).alias("rec"), "text")
    return map_rows(rows, make, f"rec {rows.schema['rec'].dataType.simpleString()}, lang string, score double", raw=("rec",))


def keep_known(docs: DataFrame, model: KernelModel) -> DataFrame:
    """The rows of ``docs`` in which a language was found, with the predicted one as lang; no other column is touched."""
    columns = [F.col("lang").alias(c) if c.lower() == "lang" else F.col("rec").getField(c).alias(c) for c in docs.columns]
    return predicted(docs, model, docs.columns).filter("lang <> 'und'").select(*columns)
