import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np

from latewise.llm import prefix_trie as T


def brute(rows, graft=True):
    """All nodes from (conv_id, turn, role, text) rows, by dictionaries of whole paths."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {conv: [(r, t) for _, _, r, t in sorted(turns)] for conv, turns in own.items()}
    paths = {}
    for conv, turns in own.items():
        h = zlib.crc32(str(conv).encode()) % 6 if graft else 0
        base = own.get(conv - int(np.fmod(conv, 100)), [])
        paths[conv] = tuple(base[:h] + turns[h:])
    members, ends = defaultdict(list), defaultdict(list)
    for conv in sorted(paths):
        for d in range(len(paths[conv]) + 1):
            members[paths[conv][:d]].append(conv)
        ends[paths[conv]].append(conv)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for path in members:
        if path:
            children[path[:-1]] += 1
    for path, convs in members.items():
        for d in range(len(path) + 1):
            leaves[path[:d]] += children[path] == 0
            saved[path[:d]] += (len(convs) - 1) * len(path[-1][1]) if path else 0
    return sorted((
        convs[0], len(path), members[path[:-1]][0] if path else None, len(convs), children[path], leaves[path], saved[path],
        hashlib.sha256(",".join(map(str, ends[path])).encode()).hexdigest(),
    ) for path, convs in members.items())


def found(spark, rows, **sizes):
    df = spark.createDataFrame([(*r, "x", 5) for r in rows], "conv_id long, turn long, role string, text string, place string, part int")
    turns = T.numbered(df, rows_per_part=sizes.pop("rows_per_part", 50_000))
    return sorted(tuple(r) for r in T.prefix_trie(*T.grafted(turns), **sizes).collect())


def talk(n_convs, seed):
    random.seed(seed)
    rows = []
    for conv in random.sample(range(700), n_convs):
        for turn in range(random.choice([1, 1, 3, 5, 8])):
            rows.append((conv, turn, random.choice(["user", "assistant"]), random.choice(["a", "bb", "çç c", "hello there"])))
    return rows


def test_trie_equals_brute_force(spark):
    rows = talk(300, 1) + [(0, t, "user", "first") for t in range(3)]
    want = brute(rows)
    assert found(spark, rows) == want
    # Crowded nodes, several shards, parts that begin inside a conversation.
    assert found(spark, rows, crowd=3, rows_per_shard=50, rows_per_part=40) == want


def test_hot_conversation_and_hot_node(spark, monkeypatch):
    for name, value in (("STRETCH", 16), ("SALTS", 4)):
        monkeypatch.setattr(T, name, value)
    rows = talk(60, 2) + [(205, t, "user", f"turn {t}") for t in range(400)] + [(206, t, "user", f"turn {t}") for t in range(380)]
    rows += [(conv, t, "user", "same") for conv in range(1000, 1100) for t in range(2)]
    want = brute(rows)
    assert found(spark, rows, crowd=20, rows_per_shard=100, rows_per_part=64) == want
    assert found(spark, rows) == want


def test_odd_rows(spark):
    rows = [
        (1, None, None, None), (1, 0, "user", "x"), (1, 0, "user", "x"), (1, 0, "a", "y"), (None, 0, "user", "lost"), (2, 0, None, ""),
        (2, 5, "user", "z" * 300_000), (-3, 1, "user", "minus"), (7, 0, "ab", "c"), (8, 0, "a", "bc"), (305, 0, "user", "alone"),
    ]
    assert found(spark, rows) == brute(rows)
    assert found(spark, []) == []
    assert found(spark, [(None, 1, "user", "no id")]) == []
    turnless = [(c, 0, "user", "gone") for c in range(701, 712)]
    assert found(spark, turnless) == brute(turnless)


def test_node_table_is_minimal_and_checked():
    draw = np.random.default_rng(3)
    keys = draw.integers(-(2**63), 2**63 - 1, size=(2, 20_000))
    table = T.NodeTable(*keys)
    slots = table.slots(*keys)
    assert sorted(slots.tolist()) == list(range(20_000))
    assert (table.slots(*draw.integers(-(2**63), 2**63 - 1, size=(2, 5_000))) == -1).all()
    assert len(T.NodeTable(keys[0][:0], keys[1][:0]).slots(*keys)) == 20_000
