"""The trie of conversations against brute force, with steps over tables and inside tasks."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from strandline.llm import prefix_trie
from strandline.llm.prefix_trie import ordered_turns, split_off, trie
from strandline.llm.q_prefix_trie import rebuilt

SCHEMA = "conv_id long, turn int, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute_trie(convs):
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    own = {p: ((len(m) - 1) * len(p[-1][1].encode().split()) if p else 0, int(not children[p])) for p, m in members.items()}
    sums = defaultdict(lambda: [0, 0])
    for p, (saved, leaf) in own.items():
        for d in range(len(p) + 1):
            sums[p[:d]][0] += saved
            sums[p[:d]][1] += leaf
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(convs[c]) == len(p))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), sums[p][1], sums[p][0], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def in_order(rows):
    out = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            out[c].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [(r, t) for _, _, r, t in sorted(turns)] for c, turns in out.items()}


def brute_rebuilt(convs):
    out = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = convs.get(c - c % 20, [])[:h] + turns[h:]
    return out


def talks(n=70, seed=4):
    draw, rows = random.Random(seed), []
    for c in range(n):
        if c in (20, 33):
            continue  # no lender for 21 to 39
        for i in range(draw.randrange(1, 7)):
            rows.append((c, i, ("user", "assistant", None)[i % 3], draw.choice(["hi there", "a b c", "", "x\ty", None]) if i else draw.choice(["one", "two words"])))
    rows += [(40, i, "user", f"long {i}") for i in range(10, 60)] + [(41, i, "user", f"long {i}") for i in range(10, 40)]  # chains
    rows += [(200 + k, i, "user", f"copy {i}") for k in range(25) for i in range(5)]  # a group of copies
    rows += [(300, None, "user", "z"), (300, None, "user", "a"), (300, 0, None, None), (300, 0, None, None), (None, 1, "user", "lost"), (301, 1, "u", "1"), (301, 1, "u1", "")]
    return rows


@pytest.mark.parametrize("limit, run", [(4096, 4096), (3, 2), (40, 8)])
def test_trie(spark, monkeypatch, limit, run):
    monkeypatch.setattr(prefix_trie, "RUN", run)
    monkeypatch.setattr(prefix_trie, "ID_BITS", 3)
    rows = talks()
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'clash' AS x", "'clash' AS depth", "1 AS n", "2 AS i").repartition(5)
    turns, convs = ordered_turns(df)
    got = trie(turns, convs, limit)
    assert got.columns == COLUMNS
    assert sorted(map(tuple, got.collect()), key=str) == brute_trie(in_order(rows))


def test_rebuilt_conversations_without_turns(spark):
    rows = talks()
    got = trie(*rebuilt(*ordered_turns(spark.createDataFrame(rows, SCHEMA))), task_nodes=20)
    want = brute_rebuilt(in_order(rows))
    assert any(not turns for turns in want.values())
    assert sorted(map(tuple, got.collect()), key=str) == brute_trie(want)


def test_no_rows(spark):
    assert trie(*ordered_turns(spark.createDataFrame([], SCHEMA))).count() == 0
    assert trie(*ordered_turns(spark.createDataFrame([(None, 1, "a", "b")], SCHEMA))).count() == 0


@pytest.mark.parametrize("shape", ["random", "chain", "star", "forest"])
def test_steps_inside_a_task(shape):
    draw, n = np.random.default_rng(7), 400
    parent = {"random": [-1, *(int(draw.integers(0, i)) for i in range(1, n))], "chain": [*range(-1, n - 1)], "star": [-1] + [0] * (n - 1), "forest": [-1 if i < 9 else int(draw.integers(0, i)) for i in range(n)]}[shape]
    depth, own, values = np.zeros(n, np.int64), draw.integers(1, 9, n), draw.integers(-5, 50, (n, 2))
    weight, want = own.copy(), values.copy()
    for i in range(n):
        depth[i] = depth[parent[i]] + 1 if parent[i] >= 0 else 3
    for i in range(n - 1, -1, -1):
        if parent[i] >= 0:
            weight[parent[i]] += weight[i]
            want[parent[i]] += want[i]
    assert (split_off(np.array(parent), depth, weight, values) == want).all()
