import random

import pytest

from docgrid.llm import jaccard, simhash

from .test_corpus import WORD, words


def brute_set(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def brute_keep(rows):
    """Least doc_id of each component of five-word Jaccard similarity 0.8."""
    sets, root = [brute_set(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] == sets[j] or (sets[i] & sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    return sorted(least.values())


def edited(rng, text, n):
    w = text.split()
    for i in rng.sample(range(len(w)), n):
        w[i] = f"edit{rng.randrange(10**6)}"
    return " ".join(w)


@pytest.mark.parametrize(("few", "block"), [(16, 512), (2, 8)])
def test_near_copies_are_found(spark, monkeypatch, few, block):
    """Copies with edits on both sides of the threshold, chains of them and a large group around one text; small limits
    send buckets through tiles of several blocks."""
    monkeypatch.setattr(jaccard, "FEW", few)
    monkeypatch.setattr(jaccard, "BLOCK_SETS", block)
    rng = random.Random(3)
    texts = [words(rng, rng.randint(1, 200)) for _ in range(60)]
    rows = list(enumerate(texts))
    for t in texts:
        n = len(t.split())
        for _ in range(3):
            rows.append((len(rows), t := edited(rng, t, rng.randint(0, max(1, n // 30)))))
    rows += [(1000 + i, edited(rng, texts[0] + " " + texts[1] + " " + texts[2], rng.randint(0, 5))) for i in range(60)]
    rows += [(2000, None), (2001, ""), (2002, " \n")]
    want = brute_keep(rows)
    old = simhash.near_duplicates(df := spark.createDataFrame(rows, "doc_id long, text string"))
    assert old.select("component_id").distinct().count() > len(want)
    assert sorted(r["doc_id"] for r in simhash.keep_one(df).collect()) == want


def test_shingles_and_bands():
    assert len(jaccard.shingles(None)) == len(jaccard.shingles(" \n")) == 0
    assert len(jaccard.shingles("a b")) == len(jaccard.shingles("a b c d e")) == 1 and len(jaccard.shingles("a b c d e f")) == 2
    assert not jaccard.bands(jaccard.shingles("a b c d e f g")) and len(jaccard.bands(jaccard.shingles("a b c d e f g h"))) == jaccard.BANDS


def test_one_row_of_each_component_whatever_its_id(spark):
    """An id with two texts keeps both; copies without an id go."""
    a, b, c = (f"{w} one two three four five six seven eight nine" for w in ("alpha beta", "gamma delta zero", "none of these"))
    b, c = b[::-1], c.replace("e", "o")
    rows = [(1, a), (1, b), (2, a.upper()), (None, b), (None, c), (None, c), (3, None)]
    got = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=repr) == sorted([(1, a), (1, b), (None, c), (3, None)], key=repr)
