"""Operators over whole tables, against brute force."""

import itertools
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from docgrid.llm import common, decontaminate, jaccard, mixing, sharding, simhash

from .conftest import ROWS

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_fingerprint(text):
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(t)
    if not w:
        return 0
    sh = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows):
    """rows: (doc_id, fingerprint); the component of each row."""
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= 2:
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [least.get(find(i)) for i in range(len(rows))]


def words(rng, n):
    return " ".join(rng.choice(["the", "of", "tion", "er", "Ana", "st", "É", "io"]) + rng.choice("abcdefgh") for _ in range(n))


def test_simhash(spark, docs, none):
    rng = random.Random(5)
    texts = [words(rng, 60) for _ in range(40)]
    rows = [(r[0], r[1]) for r in ROWS if r[0] != 8] + [(100 + i, t) for i, t in enumerate(texts)]
    rows += [(200 + i, t.replace("a ", "b ", 1) if i % 2 else t + " end") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    fp = [brute_fingerprint(t) for _, t in rows]
    comp = brute_components([(d, f) for (d, _), f in zip(rows, fp)])
    got = Counter(tuple(r) for r in simhash.near_duplicates(df).collect())
    assert got == Counter((d, f"{f:016x}", c) for (d, _), f, c in zip(rows, fp, comp))
    assert simhash.near_duplicates(none).count() == 0
    assert simhash.near_duplicates(docs).count() == len(ROWS)


@pytest.mark.parametrize("bucket", [2048, 8])
def test_links_lose_no_component(spark, monkeypatch, bucket):
    """Dense clusters, chains and far pairs; small buckets exercise the exact way for crowded keys."""
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    rng = random.Random(9)
    values = {0, 3, 2**64 - 1}
    for _ in range(12):
        v = rng.getrandbits(64)
        for _ in range(25):
            values.add(v)
            for b in rng.sample(range(64), rng.randint(0, 3)):
                v ^= 1 << b
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    df = spark.createDataFrame([(s,) for s in signed], "fp long")
    roots = {r["fp"]: r["root"] for r in simhash.components(simhash.links(df)).collect()}
    want = brute_components(list(zip(range(len(values)), values)))
    groups = defaultdict(set)
    for s, w in zip(signed, want):
        groups[w].add(roots.get(s, s))
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_pigeonring_keeps_every_close_pair():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 3000, np.uint64)
    b = a ^ (np.uint64(1) << rng.integers(0, 64, 3000).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 3000).astype(np.uint64))
    passed = set()
    for i in range(simhash.SEGMENTS):
        passed |= set(simhash.within(a, b, np.full(3000, i)).tolist())
    assert len(passed) == 3000
    assert not len(simhash.within(a, ~a, np.zeros(3000, np.int64)))


def test_keep_one(docs, none):
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = Counter(r["doc_id"] for r in kept.collect())
    assert ids[1] == 1 and ids[2] == 0 and ids[None] == 1 and ids[3] == 1 and ids[5] == 0 and ids[8] == 1
    assert simhash.keep_one(none).count() == 0


def test_wide_filter_keeps_what_is_near():
    """Chains of words within their budgets never lose a pair that the Hamming check keeps."""
    rng = np.random.default_rng(2)
    a = rng.integers(0, 1 << 63, (4000, jaccard.WIDE), np.uint64)
    b = a.copy()
    for row, n in zip(b, rng.integers(0, 120, 4000), strict=True):
        for bit in rng.choice(64 * jaccard.WIDE, n, replace=False):
            row[bit // 64] ^= np.uint64(1 << int(bit % 64))
    apart = np.bitwise_count(a ^ b).sum(axis=1)
    assert (jaccard.within(a, b) == (apart <= jaccard.BUDGET)).all()


def test_similar_pairs_are_exact():
    rng = np.random.default_rng(5)
    base = rng.choice(10**6, 300, replace=False).astype(np.uint64)
    sets = [np.unique(np.concatenate((rng.choice(base, rng.integers(200, 300), replace=False), rng.integers(0, 10**6, rng.integers(0, 40)).astype(np.uint64)))) for _ in range(60)] + [np.empty(0, np.uint64)]
    got = jaccard.similar_pairs(sets[:30], sets[30:])
    assert (got == [[bool(len(x)) and bool(len(y)) and jaccard.similarity(x, y) >= 0.8 for y in sets[30:]] for x in sets[:30]])[:, :-1].all()


def brute_leaks(docs, items):
    out = set()
    for d, text in docs:
        dw = WORD.findall((text or "").lower())
        for i, item in items:
            iw = WORD.findall((item or "").lower())
            width = min(len(iw), 20)
            if len(iw) < 5:
                continue
            need = width if width < 10 else -(-width * 8 // 10)
            for diag in range(-len(iw), len(dw)):
                same = [k for k in range(len(iw)) if 0 <= k + diag < len(dw) and iw[k] == dw[k + diag]]
                low, high = max(0, -diag), min(len(iw), len(dw) - diag)
                if any(sum(s <= k < s + width for k in same) >= need for s in range(low, high - width + 1)):
                    out.add((d, i))
    return out


def test_leaks(spark, docs, none):
    rng = random.Random(2)
    items = [(k, words(rng, n)) for k, n in enumerate((4, 5, 9, 10, 15, 20, 30, 59))] + [(90, None), (91, ""), (92, "a a a a a a a a a a a a")]
    texts = []
    for k, (_, t) in enumerate(items[:8]):
        w = t.split()
        for subs in (0, 1, 2, 3, 4, 6, 9):
            x = list(w)
            for p in rng.sample(range(len(w)), min(subs, len(w))):
                x[p] = "zzz"
            texts.append((k * 100 + subs, words(rng, 30) + "\n" + " ".join(x) + "  " + words(rng, 5)))
        texts.append((k * 100 + 50, " ".join(w[len(w) // 2 :])))
    texts += [(5000, None), (5001, ""), (None, items[5][1]), (5002, items[4][1].upper()), (5003, "a " * 40)]
    bench = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, doc_id string")
    got = decontaminate.find_leaks(spark.createDataFrame(texts, "doc_id long, text string"), bench)
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == brute_leaks(texts, items)
    assert decontaminate.find_leaks(none, bench).count() == 0 and decontaminate.find_leaks(docs, bench.limit(0)).count() == 0
    kept = decontaminate.drop_leaks(docs, spark.createDataFrame([(1, ROWS[0][1])], "item_id long, text string"))
    assert kept.columns == docs.columns and kept.count() == len(ROWS) - 3


def test_repeated_words_against_a_repeated_item(spark):
    """As many hits as words times words, and as many alignments as words."""
    docs = spark.createDataFrame([(1, "a " * 20_000), (2, "b c a"), (3, "b " * 9 + "a " * 18)], "doc_id long, text string")
    began = time.time()
    got = decontaminate.find_leaks(docs, spark.createDataFrame([(7, "a " * 60), (8, "a " * 20)], "item_id long, text string")).collect()
    assert time.time() - began < 30
    assert sorted(tuple(r) for r in got) == [(1, 7, 60, 60, 0), (1, 8, 20, 20, 0), (3, 7, 18, 60, -33), (3, 8, 18, 20, 7)]


def test_long_repeated_text_against_a_long_item(spark):
    """62,000 alignments of up to 2,000 words, nearly all of which pass: bounds settle all but a few."""
    texts = ["a " * 60_000, "a b " * 30_000, "b " + "a " * 1999, "c " * 60_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    began = time.time()
    got = decontaminate.find_leaks(docs, spark.createDataFrame([(7, "a " * 2000), (8, "a b " * 1000)], "item_id long, text string")).collect()
    assert time.time() - began < 40
    assert sorted(tuple(r) for r in got if r["item_id"] == 7) == [(0, 7, 2000, 2000, 0), (2, 7, 1999, 2000, 0)]
    assert sorted(tuple(r) for r in got if r["item_id"] == 8) == [(1, 8, 2000, 2000, 0)]


def test_best_alignments_of_noise(spark):
    """Texts of few words, where alignments without number have hits and some pass: whole rows against brute force."""
    rng = random.Random(12)
    noise = lambda n, k: [rng.choice("abcd"[:k]) for _ in range(n)]
    items = {i: noise(n, 2 + i % 3) for i, n in enumerate((5, 8, 10, 13, 20, 33, 70))}
    docs = {}
    for d in range(60):
        x, part = noise(rng.randint(0, 90), 2 + d % 3), list(items[d % 7])
        for p in rng.sample(range(len(part)), len(part) * (d % 4) // 12):
            part[p] = "z"
        docs[d] = x + part[rng.randint(0, len(part) // 3) :] + noise(rng.randint(0, 20), 3)
    want = set()
    for d, dw in docs.items():
        for i, iw in items.items():
            n, width = len(iw), min(len(iw), 20)
            need = width if width < 10 else -(-width * 8 // 10)
            best = []
            for diag in range(-n, len(dw)):
                low, high = max(0, -diag), min(n, len(dw) - diag)
                same = [iw[k] == dw[k + diag] for k in range(low, high)]
                if any(sum(same[s : s + width]) >= need for s in range(high - low - width + 1)):
                    best.append((-sum(same), diag))
            if best:
                want.add((d, i, -min(best)[0], n, min(best)[1]))
    table = lambda rows, key: spark.createDataFrame([(k, " ".join(w)) for k, w in rows.items()], f"{key} long, text string")
    got = decontaminate.find_leaks(table(docs, "doc_id"), table(items, "item_id")).collect()
    assert len(want) > 50 and {tuple(r) for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("blocks", [8, 0])
def test_leaks_in_blocks(spark, monkeypatch, blocks):
    monkeypatch.setattr(decontaminate, "BROADCAST_SEEDS", 20)
    monkeypatch.setattr(decontaminate, "BLOCKS", blocks)
    monkeypatch.setattr(common, "BROADCAST_KEYS", 2 if blocks else 1_000_000)
    monkeypatch.setattr(decontaminate, "PIECE", 4)
    rng = random.Random(3)
    items = [(k, words(rng, 12)) for k in range(6)]
    df = spark.createDataFrame([(k, f"before {t} after") for k, t in items], "doc_id long, text string")
    got = decontaminate.find_leaks(df, spark.createDataFrame(items, "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == {(k, k) for k in range(6)}


def test_mixing(spark, docs, none):
    rng = random.Random(4)
    rows = [(i, "w " * rng.randint(0, 60), rng.choice(["a", "b", "c", None]) if i % 3 else "a") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.with_copies(df).collect()
    size = Counter()
    for _, t, s in rows:
        size[s] += len(WORD.findall(t))
    cap, weight = {s: 2 * n for s, n in size.items()}, dict(zip(["a", "b", "c", None], (3, 1, 2, 3)))
    target, budget, live = {}, 1.5 * sum(size.values()), set(size)
    while live:
        level = budget / sum(weight[s] for s in live)
        full = {s for s in live if level * weight[s] > cap[s]}
        for s in full or live:
            target[s] = cap[s] if full else level * weight[s]
        budget -= sum(cap[s] for s in full)
        live -= full or live
    taken = Counter()
    for r in got:
        assert r["source_size"] == size[r["source"]] and r["target"] == pytest.approx(target[r["source"]]) and 0 <= r["copies"] <= 2
        taken[r["source"]] += r["copies"] * r["size"]
    assert all(abs(taken[s] - target[s]) <= 20 for s in size)
    assert len(got) == 600 and sorted(map(str, got)) == sorted(map(str, mixing.with_copies(df).collect()))
    assert mixing.mix(df).count() == sum(r["copies"] for r in got) and mixing.mix(df).columns == df.columns
    assert all(r["size"] == r["copies"] == "x" for r in mixing.mix(docs).collect())
    assert mixing.with_copies(docs).count() == len(ROWS) and mixing.mix(none).count() == 0 and mixing.with_copies(none).count() == 0


def brute_tree(rows, shards, spread=None, first=0):
    """Rows of (size, tie, length, lang, source, id); the shard of each, by a k-d tree over sorted rows."""
    if shards == 1 or not rows:
        return {r[-1]: first for r in rows}
    wide = {d: max(r[d] for r in rows) - min(r[d] for r in rows) for d in (2, 3, 4)}
    spread = spread or {d: max(1, w) for d, w in wide.items()}
    d = max((2, 3, 4), key=lambda k: wide[k] / spread[k])
    rows, goal, run = sorted(rows, key=lambda r: (r[d], r[1])), sum(r[0] for r in rows) * (shards // 2) / shards, 0
    cells = [list(g) for _, g in itertools.groupby(rows, key=lambda r: (r[d], r[1]))]
    for k, cell in enumerate(cells):
        weight = sum(r[0] for r in cell)
        if run + weight >= goal:
            k += run + weight - goal <= goal - run
            break
        run += weight
    left, right = ([r for c in part for r in c] for part in (cells[:k], cells[k:]))
    return brute_tree(left, shards // 2, spread, first) | brute_tree(right, shards - shards // 2, spread, first + shards // 2)


def test_tree_is_the_sorted_one(spark):
    rng = random.Random(11)
    rows = [(i, "x" * int(rng.expovariate(1 / 90)), rng.choice(["en", "de", None]), f"s{int(rng.random() ** 3 * 9)}") for i in range(700)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    meta = df.select("doc_id", *[c.alias(n) for n, c in sharding.metadata().items()], F.lit(1).cast("long").alias("occ")).withColumn("tie", sharding.tie())
    want = brute_tree([(r["size"], r["tie"], r["length"], r["lang"], r["source"], r["doc_id"]) for r in meta.collect()], 24)
    assert {r["doc_id"]: r["shard"] for r in sharding.shard_documents(df).collect()} == want


def test_equal_rows_are_dealt_out(spark):
    """Half of the rows are one row, ids are null or texts, and columns are named like results and helpers."""
    rows = [("same", "y" * 200, "en", "a")] * 3000 + [(None, None, None, None)] * 200 + [(f"d{i}", "z" * (i % 400), "de", "b") for i in range(2800)]
    df = spark.createDataFrame(rows, "doc_id string, text string, lang string, source string").selectExpr("*", "'x' AS Size", "'x' AS SHARD", "'x' AS rid", "'x' AS rec", "'x' AS occ", "'x' AS tie", "'x' AS id")
    out = sharding.shard_documents(df)
    assert out.columns == ["doc_id", "text", "lang", "source", "rid", "rec", "occ", "tie", "id", "size", "text_crc32", "shard", "slot"]
    got = out.collect()
    assert Counter(tuple(r)[:4] for r in got) == Counter(rows) and {r["rid"] for r in got} == {"x"}
    weight, slots = Counter(), defaultdict(list)
    for r in got:
        weight[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    mean = sum(weight.values()) / 24
    assert len(weight) == 24 and max(abs(w - mean) for w in weight.values()) <= 2 * 408
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_occurrences_count_equal_rows(spark):
    df = spark.range(500).selectExpr("id AS rid", "CASE WHEN id < 300 THEN 'hot' ELSE concat('c', id % 50) END AS id")
    got = defaultdict(list)
    for r in common.occurrences(df, "id", "test").collect():
        got[r["id"]].append(r["occ"])
    assert all(sorted(v) == list(range(1, len(v) + 1)) for v in got.values()) and len(got["hot"]) == 300


def test_mixing_whatever_the_names_and_ids(spark):
    rows = [(f"d{i}" if i % 3 else None, "w " * (1 + i % 7), ["a", "b", None][i % 3]) for i in range(300)] + [("same", "w w w", "a")] * 300
    df = spark.createDataFrame(rows, "doc_id string, text string, source string").selectExpr("*", "'x' AS Size", "'x' AS COPIES", "'x' AS rank", "'x' AS skey", "'x' AS rid", "'x' AS __size")
    out = mixing.with_copies(df)
    assert out.columns == ["doc_id", "text", "source", "rank", "skey", "rid", "__size", "size", "source_size", "target", "copies"]
    got = out.collect()
    assert len(got) == 600 and all(r["size"] == len(r["text"].split()) and 0 <= r["copies"] <= 2 for r in got)
    taken, target = Counter(), {r["source"]: r["target"] for r in got}
    for r in got:
        taken[r["source"]] += r["copies"] * r["size"]
    assert all(abs(taken[s] - target[s]) <= 7 for s in target)
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns and mixed.filter("Size <> 'x' OR __size <> 'x'").count() == 0 and mixed.count() == sum(r["copies"] for r in got)


def test_crossings_are_exact_far_out(spark):
    """Whole numbers: no place is taken more than twice, however many documents come before it."""
    places = [1, 2**32, 2**32 + 1, 2**36, 2**37 - 1]
    df = spark.createDataFrame([(p,) for p in places], "p long")
    got = df.select(mixing.crossed(F.col("p") - 1, F.col("p"), F.lit(2 * mixing.ONE).cast("long"), F.lit(mixing.ONE - 1).cast("long")).alias("n")).collect()
    assert [r["n"] for r in got] == [2] * 5


def test_sharding(spark, docs, none):
    rng = random.Random(6)
    rows = [(i, "x" * int(rng.expovariate(1 / 200)), rng.choice(["en", "de"]), f"s{int(rng.random() ** 3 * 9)}") for i in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = sharding.shard_documents(df).collect()
    text = {r[0]: r[1] for r in rows}
    weight, slots = Counter(), defaultdict(list)
    for r in got:
        assert r["size"] == len(text[r["doc_id"]]) + 8 and r["text_crc32"] == zlib.crc32(text[r["doc_id"]].encode())
        weight[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert sorted(weight) == list(range(24)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    mean = sum(weight.values()) / 24
    assert max(abs(w - mean) for w in weight.values()) < 0.05 * mean
    few = sharding.shard_documents(docs)
    assert few.count() == len(ROWS) and few.filter("shard is null or slot is null").count() == 0
    assert sharding.shard_documents(none).count() == 0
