"""The trie against one built in plain Python, with fingerprints so narrow that most candidates are split."""

import hashlib
import zlib
from collections import defaultdict

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from docgrid.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth string, fp string, k string, size string"


def brute(rows):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            turns[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, x) for _, _, r, x in sorted(t)] for c, t in turns.items()}
    made = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        made[c] = own.get(c - c % 5, [])[:h] + mine[h:]
    members = defaultdict(list)
    for c, t in made.items():
        for d in range(len(t) + 1):
            members[tuple(t[:d])].append(c)
    out = set()
    for node, convs in members.items():
        below = [n for n in members if n[: len(node)] == node]
        kids = lambda n: [m for m in members if len(m) == len(n) + 1 and m[: len(n)] == n]
        ends = ",".join(map(str, sorted(c for c in convs if len(made[c]) == len(node))))
        saved = sum((len(members[n]) - 1) * len(n[-1][1].encode()) for n in below if n)
        out.add((min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), len(kids(node)), sum(not kids(n) for n in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def trie(spark, rows, **narrow):
    df = spark.createDataFrame([(*r, *["x"] * 4) for r in rows], SCHEMA)
    got = prefix_trie.prefix_trie(df, **narrow).collect()
    found = {(r["conv_id"], r["depth"], r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends_sha256"]) for r in got}
    assert len(found) == len(got)
    return found


#: Shared beginnings, copies, ties, repeated rows, nulls, a conversation without turns of its own, absent families.
ROWS = (
    [(c, t, "user" if t % 2 == 0 else "assistant", f"turn {t} of {c % 3 if t > 2 else 0}") for c in range(40) for t in range(c % 11 + 1)]
    + [(c, t, None, None if t == 1 else "é" * (t or 0)) for c in (101, 103, 104, 107) for t in (None, 1, 2, 2)]
    + [(200, 0, "user", "a\n"), (200, 0, "user", "a\n"), (201, 0, "user\na", ""), (202, None, "", ""), (None, 0, "user", "nobody's")]
    + [(c, t, "user", "same") for c in range(300, 330) for t in range(12)]
)


@pytest.mark.parametrize("narrow", [{}, {"bits": 2}, {"turn_bits": 1}, {"bits": 1, "turn_bits": 2}], ids=str)
def test_against_a_plain_trie(spark, narrow):
    assert trie(spark, ROWS, **narrow) == brute(ROWS)


def test_one_conversation_in_many_tasks(spark):
    """A conversation with nearly all turns, over more partitions than the session usually has."""
    rows = [(5, t, "user", f"{t % 7}") for t in range(400)] + [(6, t, "user", f"{t % 7}") for t in range(30)]
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        got = trie(spark, rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == brute(rows)


def test_no_conversations(spark):
    assert trie(spark, []) == set() and trie(spark, [(None, 1, "user", "x")]) == set()


turn = st.tuples(st.integers(0, 12), st.sampled_from([None, 0, 1, 2]), st.sampled_from(["user", None, "assistant"]), st.sampled_from(["", "a", None, "bé", "a" * 70]))


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=st.lists(turn, min_size=1, max_size=60))
def test_any_conversations(spark, rows):
    assert trie(spark, rows, bits=3) == brute(rows)
