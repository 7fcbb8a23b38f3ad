"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of whole texts are counted from byte and word arrays.  Trees of equal depth are grown level by level from
gradient histograms and kept as flat arrays (feature, bin limit, leaf value), which numpy walks for a whole batch.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hash_limit, map_rows

SAMPLE = 12_000
BINS = 64
TREES = 60
DEPTH = 4
RATE = 0.15
LAMBDA = 1.0
LEAST_HESSIAN = 2.0
WORD_BLOCK = 4 << 20

NAMES = (
    "bytes words lines mean_word sd_word long_word short_word upper_share lower_share digit_share space_share punct_share symbol_share "
    "high_byte_share control_share pipe_share bang_share line_mean line_sd short_lines repeated_lines repeated_line_bytes unique_words "
    "top_word byte_entropy end_stop_lines symbol_words upper_words words_per_sentence url_share"
).split()


def _classes() -> np.ndarray:
    """For each statistic of single bytes a row of 256 flags."""
    b = np.arange(256)
    punct = np.isin(b, np.frombuffer(b".,;:'\"-()?", np.uint8))
    symbol = np.isin(b, np.frombuffer(b"#$%&*+/<=>@[\\]^_`{|}~!", np.uint8))
    return np.array([(b > 64) & (b < 91), (b > 96) & (b < 123), (b > 47) & (b < 58), b == 32, punct, symbol, b > 127, (b < 32) & (b != 10), b == 124, b == 33], np.float64)


CLASSES = _classes()
SYMBOL_WORD = re.compile(rb"[#$%&*+/<=>@\\^_`{|}~!]{1,}")


def statistics(text: str | None) -> list[float]:
    """The statistics of a whole text, in the order of ``NAMES``; all zero for a null or empty one."""
    data = (text or "").encode()
    if not data:
        return [0.0] * len(NAMES)
    raw = np.frombuffer(data, np.uint8)
    hist = np.bincount(raw, minlength=256).astype(np.float64)
    n = float(len(data))
    share = CLASSES @ hist / n
    p = hist[hist > 0] / n
    entropy = float(-(p * np.log2(p)).sum())
    white = np.concatenate(([True], (raw == 32) | ((raw > 8) & (raw < 14)), [True]))
    ends = np.flatnonzero(white)
    lens = np.diff(ends) - 1
    lens = lens[lens > 0].astype(np.float64)
    n_words = max(1, len(lens))
    words: Counter = Counter()
    symbol_words = upper_words = 0
    start = 0
    while start < len(data):
        # blocks end at white space, so that a very long text never becomes one list of words
        k = int(np.searchsorted(ends, start + WORD_BLOCK))
        stop = min(len(data), max(start + 1, int(ends[min(k, len(ends) - 1)])))
        part = Counter(data[start:stop].split())
        words.update(part)
        start = stop
    for w, k in words.items():
        if SYMBOL_WORD.search(w):
            symbol_words += k
        if w.isupper():
            upper_words += k
    lines = data.split(b"\n")
    line_len = np.array([len(x) for x in lines], np.float64)
    seen = Counter(x for x in lines if x)
    again = [(x, k) for x, k in seen.items() if k > 1]
    sentences = max(1, data.count(b". ") + data.count(b".\n") + data.count(b"? ") + data.count(b"! "))
    return [
        np.log1p(n), np.log1p(len(lens)), np.log1p(len(lines)),
        lens.mean() if len(lens) else 0.0, lens.std() if len(lens) else 0.0, (lens > 15).sum() / n_words, (lens < 3).sum() / n_words,
        *share,
        np.log1p(line_len.mean()), np.log1p(line_len.std()), (line_len < 20).mean(),
        sum(k - 1 for _, k in again) / len(lines), sum(len(x) * (k - 1) for x, k in again) / n,
        len(words) / n_words, max(words.values(), default=0) / n_words, entropy,
        sum(x.rstrip().endswith((b".", b"?", b"!")) for x in lines) / len(lines),
        symbol_words / n_words, upper_words / n_words, len(lens) / sentences, (data.count(b"http") + data.count(b"www.")) / n_words,
    ]


class Forest:
    """Trees of equal depth in flat arrays; node ``i`` of a tree has the children ``2 i + 1`` and ``2 i + 2``."""

    def __init__(self, base: float, feature: np.ndarray, limit: np.ndarray, leaf: np.ndarray):
        self.base, self.feature, self.limit, self.leaf = base, feature, limit, leaf

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1 for rows of statistics."""
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, limit, leaf in zip(self.feature, self.limit, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, feature[node]] > limit[node])
            total += leaf[node - (2**DEPTH - 1)]
        return 1 / (1 + np.exp(-total))


def grow(x: np.ndarray, y: np.ndarray) -> Forest:
    """Boost ``TREES`` trees on logistic loss; deterministic for rows in a given order."""
    inner, leaves = 2**DEPTH - 1, 2**DEPTH
    if not len(y) or y.min() == y.max():
        mean = float(y.mean()) if len(y) else 0.5
        return Forest(float(np.log((mean * len(y) + 1) / ((1 - mean) * len(y) + 1))), np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)))
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)])
    base = float(np.log(y.mean() / (1 - y.mean())))
    total, trees = np.full(len(y), base), ([], [], [])
    n_feat = x.shape[1]
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-total))
        g, h = p - y, p * (1 - p)
        feature, limit = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(len(y), np.int64)
        for depth in range(DEPTH):
            first, width = 2**depth - 1, 2**depth
            at = node - first
            gs = np.stack([np.bincount(at * BINS + b, g, width * BINS) for b in binned]).reshape(n_feat, width, BINS)
            hs = np.stack([np.bincount(at * BINS + b, h, width * BINS) for b in binned]).reshape(n_feat, width, BINS)
            gl, hl = gs.cumsum(axis=2), hs.cumsum(axis=2)
            ga, ha = gl[:, :, -1:], hl[:, :, -1:]
            gain = gl**2 / (hl + LAMBDA) + (ga - gl) ** 2 / (ha - hl + LAMBDA) - ga**2 / (ha + LAMBDA)
            gain[(hl < LEAST_HESSIAN) | (ha - hl < LEAST_HESSIAN)] = 0
            for k in range(width):
                f, b = np.unravel_index(np.argmax(gain[:, k]), (n_feat, BINS))
                if gain[f, k, b] > 1e-9 and b < len(edges[f]):
                    feature[first + k], limit[first + k] = f, edges[f][b]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > limit[node])
        leaf_of = node - inner
        leaf = -RATE * np.bincount(leaf_of, g, leaves) / (np.bincount(leaf_of, h, leaves) + LAMBDA)
        total += leaf[leaf_of]
        for kept, new in zip(trees, (feature, limit, leaf), strict=True):
            kept.append(new)
    return Forest(base, *(np.array(t) for t in trees))


def with_statistics(rows: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` and ``stats``, an array of the statistics of ``text``."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def make():
        return lambda c: {n: c[n] for n in keep} | {"stats": [statistics(t) for t in c["__text"]]}

    return map_rows(rows.select(*keep, F.col("text").alias("__text")), make, ", ".join(f"`{n}` {kinds[n]}" for n in keep) + ", stats array<double>", raw=tuple(keep))


def fit(docs: DataFrame, labels: DataFrame, usable: Column, label: str = "quality", sample: int = SAMPLE) -> Forest:
    """Learn ``label`` (0 or 1) of the labelled documents that are ``usable`` (a condition on doc_id).

    At most ``sample`` labelled ids are used, those of the least hash, and as many rows: the bound of what reaches the
    driver, as statistics and not as texts.  Equal labels of an id count once, and so do equal texts of an id.
    """
    usual = labels.filter(usable & F.col(label).isin(0, 1) & F.col("doc_id").isNotNull())
    usual = usual.select(F.col("doc_id").alias("id"), F.col(label).cast("int").alias("label"), F.xxhash64(F.col("doc_id").cast("string"), F.col(label).cast("int")).alias("k"))
    # a share of the hashes that a fifth more than ``sample`` rows are expected to have, then exactly the wanted ones
    n = usual.agg(F.approx_count_distinct("k")).first()[0]
    few = usual.filter(F.col("k") <= hash_limit(1.2 * sample + 50, n)).distinct().orderBy("k", "id").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(few), F.col("doc_id") == F.col("id"))
    texts = rows.groupBy("id", "label", F.xxhash64("text").alias("t")).agg(F.any_value("text").alias("text"))
    told = with_statistics(texts, ["id", "label", "t"])
    got = sorted((r["id"], r["label"], r["t"], r["stats"]) for r in told.orderBy(F.xxhash64("id", "t"), "label").limit(sample).collect())
    return grow(np.array([s for *_, s in got]).reshape(len(got), len(NAMES)), np.array([float(r[1]) for r in got]))


def score(docs: DataFrame, forest: Forest) -> DataFrame:
    """One row per row of ``docs``: doc_id, score of label 1 (0 to 1) and predicted (1 from 0.5 on).

    Null and empty texts are scored from all-zero statistics.  Without labels to learn from every score is 0.5, with
    one label only it is that label's smoothed share.  Repeated rows stay, an empty table gives an empty result, other
    columns are ignored.
    """
    # TREES x 2^DEPTH numbers; the class itself travels with the function
    given = docs.sparkSession.sparkContext.broadcast((forest.base, forest.feature, forest.limit, forest.leaf))

    def make():
        here = Forest(*given.value)

        def apply(c):
            x = np.array([statistics(t) for t in c["text"]]).reshape(-1, len(NAMES))
            s = here.score(x)
            return {"doc_id": c["doc_id"], "score": s.tolist(), "predicted": (s >= 0.5).astype(np.int32).tolist()}

        return apply

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_rows(docs.select("doc_id", "text"), make, f"doc_id {kind}, score double, predicted int", raw=("doc_id",))
