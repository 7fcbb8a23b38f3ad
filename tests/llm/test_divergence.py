"""The audit against plain Python with whole numbers, and tries that are cut into small fragments."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from docgrid.llm import divergence
from docgrid.llm.divergence import Counts, fragments

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def brute(rows, min_docs):
    n, having, langs = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in ((a or "", b or "", c or "") for a, b, c in rows):
        found = TERM.findall(text.translate(LOWER))
        n[lang, source].update(found)
        having[lang].update(set(found))
        langs[lang].add(source)
    out = set()
    for lang, sources in langs.items():
        kept = [t for t, d in having[lang].items() if d >= min_docs]
        rate = lambda c, total: 1 + 1_000_000_000 * (c + 5) // (total + 5 * len(kept))  # noqa: B023, E731
        p = {s: {t: rate(n[lang, s][t], sum(n[lang, s][u] for u in kept)) for t in kept} for s in sources}
        whole = {t: sum(n[lang, s][t] for s in sources) for t in kept}
        q = {t: rate(whole[t], sum(whole.values())) for t in kept}
        for s in sources:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(p[s][t] - q[t], t) for t in kept if n[lang, s][t] > 0 and p[s][t] > q[t]]
            for part, items, most in (("pair", pairs, None), ("term", terms, 50)):
                for rank, (value, item) in enumerate(sorted(items, key=lambda x: (-x[0], x[1].encode()))[:most], 1):
                    out.add((lang, s, part, item, value, rank))
    return out


def audit(spark, rows, min_docs):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "lang string, source string, text string, item string, value int").repartition(5)
    got = divergence.diverge(df, min_docs)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    return {tuple(r) for r in got.collect()}


def rows():
    of = random.Random(5)
    vocabulary = ["".join(of.choice("abcé日🙂") for _ in range(of.randrange(1, 6))) for _ in range(150)]
    out = [(of.choice(["en", "de"]), of.choice("abcd"), " ".join(of.choice(vocabulary) for _ in range(of.randrange(60)))) for _ in range(120)]
    return out + [
        ("en", "z", None), ("en", None, "A\x00a-A_a`a{A"), (None, None, "x"), (None, "q", ""), ("fr", "alone", "Été  été"), ("en", "a", "ÉaZ " + "long" * 300_000), ("en", "a", "word " * 400_000),
        ("de", "a", "same same"), ("de", "a", "same same"), ("", "", "b"),
    ]


def test_against_whole_numbers(spark):
    assert audit(spark, rows(), 3) == brute(rows(), 3)


def test_small_fragments(spark, monkeypatch):
    """Tries are given away and closed after a few leaves, so terms come together from many places."""
    for name, value in (("FRAGMENT", 2), ("LEAVES", 5), ("CUT", 1), ("COUNTERS", 3)):
        monkeypatch.setattr(divergence, name, value)
    assert audit(spark, rows(), 1) == brute(rows(), 1)


def test_no_documents(spark):
    assert audit(spark, [], 1) == set()


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=st.lists(st.tuples(st.sampled_from([None, "en"]), st.sampled_from(["a", "b", None]), st.one_of(st.none(), st.text("aAbB é\n-", max_size=30))), min_size=1, max_size=25))
def test_any_documents(spark, rows):
    assert audit(spark, rows, 2) == brute(rows, 2)


some = st.lists(st.tuples(st.binary(min_size=1, max_size=6), st.sampled_from("xyz")), min_size=1)


@given(some, some)
def test_tries_merge(one, two):
    merged, plain = Counts(), defaultdict(Counter)
    for terms in (one, two):
        counts = Counts()
        for t, s in terms:
            counts.add([t], np.array([1]), [s], np.array([0]), np.array([1]), np.array([2]))
            plain[t][s] += 1
        for f in fragments("en", counts).to_pylist():
            found, term = [], b""
            for same, tail in zip(f["shared"], f["tails"], strict=True):
                term = term[:same] + tail
                found.append(term)
            assert found[0] == f["first"] and {t[:3] for t in found} == {f["prefix"]} and found == sorted(found)
            merged.add(found, np.array(f["sizes"]), f["names"], np.array(f["who"]), np.array(f["docs"]), np.array(f["counts"]))
    terms, bounds, source, docs, n = merged.ordered()
    names = list(merged.sources)
    assert terms == sorted(plain) and merged.leaves == len(plain)
    got = {t: {names[source[k]]: (docs[k], n[k]) for k in range(bounds[i], bounds[i + 1])} for i, t in enumerate(terms)}
    assert got == {t: {s: (k, 2 * k) for s, k in c.items()} for t, c in plain.items()}


@pytest.mark.parametrize("count", [7, 9 * 10**9, 10**17])
def test_counts_of_any_size_are_exact(count):
    got = divergence.rated(np.array([[0, count]]), np.array([count, 3 * count]), 11)
    assert got.tolist() == [[1 + 10**9 * 5 // (count + 55), 1 + 10**9 * (count + 5) // (3 * count + 55)]]
