"""The conversation trie against a plain dictionary of prefixes."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from propensa.llm import trie

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(rows):
    """Nodes of the rebuilt conversations; ties of ``turn`` must be equal turns here."""
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [t[2:] for t in sorted(v)] for c, v in convs.items()}
    made = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        made[c] = turns.get(base, [])[:h] + turns[c][h:]
    members = defaultdict(list)
    for c, seq in made.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
    children = defaultdict(list)
    for path in members:
        if path:
            children[path[:-1]].append(path)
    totals = {}
    for path in sorted(members, key=len, reverse=True):
        leaves = sum(totals[k][0] for k in children[path]) or 1
        saved = (len(members[path]) - 1) * len(path[-1][1].encode()) if path else 0
        totals[path] = leaves, saved + sum(totals[k][1] for k in children[path])
    out = []
    for path, ids in members.items():
        ends = ",".join(str(c) for c in sorted(ids) if len(made[c]) == len(path))
        out.append((
            min(ids), len(path), min(members[path[:-1]]) if path else None, len(ids), len(children[path]),
            *totals[path], hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out, key=repr)


def nodes(spark, rows, schema="conv_id bigint, turn bigint, role string, text string"):
    found = trie.conversation_trie(spark.createDataFrame(rows, schema))
    assert found.columns == COLUMNS
    return sorted((tuple(r) for r in found.collect()), key=repr)


def test_random_conversations(spark):
    rng = random.Random(5)
    rows = []
    for c in range(-12, 90):
        for t in range(rng.choice([1, 2, 3, 5, 9, 17])):
            rows.append((c, t, rng.choice(["user", "bot", None]), rng.choice(["a", "bé", "", None])))
    # Copies of one conversation, one far longer than all others, a missing base.
    rows += [(c, t, "user", f"same {t}") for c in range(200, 330) for t in range(12)]
    rows += [(1001, t, "user", f"turn {t % 7}") for t in range(300)]
    rows += [(1003, t, "user", f"turn {t % 7}") for t in range(258)]
    rng.shuffle(rows)
    assert nodes(spark, rows) == plain(rows)


def test_nulls_ties_and_repeated_rows(spark):
    rows = [(5, None, "a", "first"), (5, 0, "a", "x"), (5, 0, "a", "x"), (5, 3, None, None), (None, 1, "a", "lost"),
            (6, 0, "", ""), (6, 0, "", ""), (7, None, "long", "w" * 300_000)]
    assert nodes(spark, rows) == plain(rows)


def test_role_and_text_are_told_apart(spark):
    rows = [(5 * i, t, *pair) for i, pair in enumerate([("ab", "c"), ("a", "bc"), ("", "abc")]) for t in range(1)]
    found = nodes(spark, rows)
    assert found == plain(rows) and len(found) == 4


def test_ties_have_one_result_whatever_the_order_of_rows(spark):
    rows = [(10, 0, "a", str(i)) for i in range(6)]
    assert nodes(spark, rows) == nodes(spark, rows[::-1])


def test_empty_table_and_turnless_conversations(spark):
    assert nodes(spark, []) == []
    alone = [c for c in range(1, 60) if c % 5 and zlib.crc32(str(c).encode()) % 9 >= 2]
    rows = [(c, 0, "a", "x") for c in alone]
    found = nodes(spark, rows)
    assert found == plain(rows)
    assert found == [(alone[0], 0, None, len(alone), 0, 1, 0, hashlib.sha256(",".join(map(str, alone)).encode()).hexdigest())]


def test_other_columns_play_no_part(spark):
    rows = [(c, t, "a", str(t * (c % 2))) for c in range(10) for t in range(10)]
    wide = [(*r, 1, 2, 3, "z") for r in rows]
    schema = "conv_id bigint, turn bigint, role string, text string, seq int, depth int, n_convs int, pos string"
    assert nodes(spark, wide, schema) == nodes(spark, rows)


def test_many_members_at_one_node(spark, monkeypatch):
    monkeypatch.setattr(trie, "IDS_PER_TEXT", 7)
    ends = [(1, 2, 3, s) for s in range(100)] + [(1, 2, 4, 5)]
    found = trie.member_digests(spark.createDataFrame(ends, "depth bigint, a bigint, b bigint, seq bigint")).collect()
    sha = lambda ids: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert {r["b"]: r["sha"] for r in found} == {3: sha(range(100)), 4: sha([5])}


@pytest.mark.parametrize("n", [1, 10, 1000])
def test_positions(spark, n):
    items = spark.createDataFrame([(i % 3, i) for i in range(n)] + [(7, i) for i in range(5 * n)], "seq bigint, t bigint")
    got = trie.numbered(items.repartition(7), ["t"]).collect()
    want = sorted([(i % 3, i, i // 3) for i in range(n)] + [(7, i, i) for i in range(5 * n)])
    assert sorted((r["seq"], r["t"], r["pos"]) for r in got) == want
