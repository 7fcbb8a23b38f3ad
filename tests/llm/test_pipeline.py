"""The pipeline, stage by stage, against brute force on a small fixture."""

import random
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from docgrid.llm import queries

from .test_corpus import brute_leaks
from .test_jaccard import brute_keep, edited

SYLLABLES = {"en": "th er on an re he in ed nd ha at en".split(), "de": "sch ung keit ver der ich ein und auf".split()}


def prose(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(8)
    items = [(k, prose(rng, "en", 20)) for k in range(4)]
    rows = [(i, prose(rng, "de" if i % 4 == 0 else "en", rng.randint(5, 80)), "de" if i % 4 == 0 else "en", f"s{i % 3}") for i in range(150)]
    rows += [(200 + i, rows[i][1].upper() if i % 2 else rows[i][1], rows[i][2], "s9") for i in range(0, 30)]
    long = [k for k in range(150) if len(rows[k][1].split()) >= 45]
    rows += [(600 + k, edited(rng, rows[k][1], k % 2 + 1), rows[k][2], "s9") for k in long[:40]]
    rows += [(300 + k, f"{prose(rng, 'en', 9)} {t} {prose(rng, 'en', 9)}", "en", None) for k, t in items]
    rows += [(400, None, "en", "s1"), (401, "123 456", "en", "s1"), (402, "", None, "s1"), (403, prose(rng, "de", 40), None, "s1"), (5, rows[5][1], "en", "s2"), (None, prose(rng, "en", 30), "en", "s0")]
    out = tmp_path_factory.mktemp("sf")
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return str(out), rows, items


def test_stages(spark, folder):
    path, rows, items = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "decontamination", "mixing", "sharding"]

    kept = stages["language"](spark, docs, path).cache()
    assert kept.columns == columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(r[0] for r in rows if r[0] not in (400, 401, 402))
    assert {r["doc_id"]: r["lang"] for r in kept.collect()}[403] == "de"

    had = [(r["doc_id"], r["text"]) for r in kept.collect()]
    known = [r for r in had if r[0] is not None]
    want = set(brute_keep(known))
    # near copies are on both sides of the threshold
    near = {d for d, _ in known if d >= 600}
    assert near & want and near - want
    one = stages["near_duplicates"](spark, kept, path).cache()
    assert one.columns == columns
    assert Counter(r["doc_id"] for r in one.collect()) == Counter({**dict.fromkeys(want, 1), None: 1})

    clean = stages["decontamination"](spark, one, path).cache()
    leaks = {d for d, _ in brute_leaks([(r["doc_id"], r["text"]) for r in one.collect()], items)}
    assert leaks and {r["doc_id"] for r in clean.collect()} == {r["doc_id"] for r in one.collect()} - leaks and clean.columns == columns

    mixed = stages["mixing"](spark, clean, path).cache()
    size = lambda r: len((r["text"] or "").split())
    total = defaultdict(int)
    for r in clean.collect():
        total[r["source"]] += size(r)
    taken = Counter(r["doc_id"] for r in mixed.collect())
    assert mixed.columns == columns and max(taken.values()) <= 2
    assert sum(size(r) for r in mixed.collect()) == pytest.approx(1.5 * sum(total.values()), rel=0.05)

    sharded = stages["sharding"](spark, mixed, path).collect()
    assert Counter(r["doc_id"] for r in sharded) == taken
    slots = defaultdict(list)
    for r in sharded:
        slots[r["shard"]].append(r["slot"])
    assert set(slots) <= set(range(24)) and all(sorted(s) == list(range(len(s))) for s in slots.values())


NAMES = "score lang_pred Size copies fingerprint item_id SHARD __text __n __size __lang __score rec rid hash root tkey Slot n key".split()


def test_columns_with_clashing_names_stay(spark, folder, tmp_path):
    path, _, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet").selectExpr("*", *[f"'x' AS `{n}`" for n in NAMES])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, path)
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.count() > 50 and docs.filter(" OR ".join(f"`{n}` <> 'x' OR `{n}` IS NULL" for n in NAMES)).count() == 0, name
    out = corpus_pipeline.STAGES[-1][1](spark, docs, path)
    out.write.parquet(f"{tmp_path}/last")
    assert {"size", "shard", "slot", "text_crc32"} <= set(out.columns) and not {"Size", "SHARD", "Slot"} & set(out.columns)


def test_run_and_queries(spark, folder):
    path, rows, _ = folder
    out = corpus_pipeline.run(spark, path)
    assert {"doc_id", "text", "shard", "slot"} <= set(out.columns) and out.count() > 100
    assert queries.op6_simhash(spark, path).count() == len(rows)
    got = queries.op7_decontaminate(spark, path).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(300 + k, k) for k in range(4)}


def test_empty_tables(spark, folder, tmp_path):
    path, _, _ = folder
    for t in ("documents", "benchmark"):
        spark.read.parquet(f"{path}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
