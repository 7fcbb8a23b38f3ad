"""Removal of repeated windows against plain Python, with sketches so small that most windows are estimated repeated."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from docgrid.llm import substring

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(texts, window):
    words = [WORD.findall(t or "") for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = {i + k for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for k in range(window)}
        out.append((" ".join(x for i, x in enumerate(w) if i not in gone), len(w), len(gone)))
    return out


def removed(spark, texts, window=35, gram=24, cells=1 << 16, parts=3):
    df = spark.createDataFrame([(i, t, "x", 7) for i, t in enumerate(texts)], "doc_id long, text string, kept string, n_words int").repartition(parts)
    got = substring.remove_repeats(df, cells=cells, window=window, gram=gram)
    assert got.columns == ["doc_id", "kept", "n_words", "n_removed"]
    rows = sorted(tuple(r) for r in got.collect())
    assert [r[0] for r in rows] == list(range(len(texts)))
    return [r[1:] for r in rows]


def prose(n, seed, vocabulary=5000):
    of = random.Random(seed)
    return " ".join(f"w{of.randrange(vocabulary)}" for _ in range(n))


def texts():
    passage, short, mine = prose(60, 1), prose(34, 2), prose(300, 3)
    near = mine.split()
    near[150] = "else"
    return [
        prose(200, 4) + "\n\t" + passage + "\x0b" + prose(100, 5), prose(90, 6) + " " + passage.replace(" ", "  \r\n"), mine, mine, mine + " more", " ".join(near), short + " a", short + " b",
        None, "", " \t\n", "one", prose(34, 7), prose(34, 7), prose(35, 8), prose(35, 8), "é ﬁ x \x85 日本 " * 20, prose(40, 9) + " between " + prose(40, 9),
        "word " * 500, prose(400, 10, 2), passage, "x" * 100_000 + " y",
    ]


@pytest.mark.parametrize("cells", [8, 1 << 10, 1 << 22])
def test_against_plain_windows(spark, cells):
    assert removed(spark, texts(), cells=cells) == brute(texts(), 35)


def test_no_documents(spark):
    assert removed(spark, []) == []


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(of=st.lists(st.one_of(st.none(), st.lists(st.sampled_from("abc"), max_size=40).map(" ".join)), min_size=1, max_size=12))
def test_any_texts(spark, of):
    assert removed(spark, of, window=5, gram=3, cells=64) == brute(of, 5)


def test_long_texts_come_in_pieces(monkeypatch):
    """Windows are the same whatever the length of a piece."""
    import pyarrow as pa

    words = substring.Words(pa.array([prose(5000, 1), "a b", prose(900, 2)]))

    def all_of():
        return [(int(s) + low, int(grams[f])) for starts, filed, grams, _, low in substring.Windows(35, 24).pieces(words) for s, f in zip(starts, filed, strict=True)]

    whole = all_of()
    monkeypatch.setattr(substring, "PIECE", 64)
    assert all_of() == whole and len(whole) == 4966 + 866


def test_least_of_a_row():
    x = np.array([5, 3, 3, 9, 1, 1, 8, 7, 2], np.uint64)
    for width in range(1, 9):
        assert substring.least(x, width).tolist() == [i + int(np.argmin(x[i : i + width])) for i in range(len(x) - width + 1)]
