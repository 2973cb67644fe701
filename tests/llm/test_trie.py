"""The conversation trie beside plain Python."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from sentinela.llm import conversation_trie as trie

SCHEMA = "conv_id long, turn long, role string, text string, node long, depth string"


def cut(c):
    return c - c % 100 if c >= 0 else c + -c % 100


def plain(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(turns)] for c, turns in own.items()}
    members, ends = defaultdict(set), defaultdict(list)
    for c, turns in own.items():
        head = zlib.crc32(str(c).encode()) % 6
        path = tuple(own.get(cut(c), [])[:head] + turns[head:])
        ends[path].append(c)
        for d in range(len(path) + 1):
            members[path[:d]].add(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for path in members:
        if path:
            children[path[:-1]] += 1
    for path, own_members in members.items():
        for d in range(len(path) + 1):
            leaves[path[:d]] += not children[path]
            saved[path[:d]] += (len(own_members) - 1) * len(path[-1][1]) if path else 0
    return sorted((
        min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p],
        hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest())
        for p, m in members.items())


def found(spark, rows, local_nodes=trie.LOCAL_NODES):
    turns = spark.createDataFrame([(*r, 1, "d") for r in rows], SCHEMA).repartition(5)
    got = trie.conversation_trie(turns, local_nodes=local_nodes)[0]
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
                           "saved_tokens", "ends_sha256"]
    return sorted(map(tuple, got.collect()))


def awkward():
    pick = random.Random(4)
    rows = []
    for c in [*range(0, 40), *range(200, 260), 305, 410, -5, -100, -101, 5_000_000_000]:
        rows += [(c, t, pick.choice(["user", "bot", None]), pick.choice(["a", "b", "", None, "日本"]))
                 for t in range(pick.randrange(1, 9))]
    rows += [(200, None, "user", "first"), (200, None, "user", "again"), (201, 1, "user", "x")]
    rows += [(202, 2, "user", "tie"), (202, 2, "bot", "tie")] * 3
    rows += [(None, 1, "user", "nobody's"), (None, None, None, None)]
    rows += [(700, t, "user", f"turn {t % 3}") for t in range(150)]         # a long conversation
    rows += [(c, t, "user", f"hot {t}") for c in range(1000, 1090) for t in range(7)]
    return rows


@pytest.mark.parametrize("local_nodes", [trie.LOCAL_NODES, 300])
def test_trie_of_awkward_rows(spark, local_nodes, monkeypatch):
    rows = awkward()
    if local_nodes == 300:
        monkeypatch.setattr(trie, "SEGMENT", 16)
    assert found(spark, rows, local_nodes) == plain(rows)


def test_trie_of_few_and_no_rows(spark):
    assert found(spark, []) == []
    assert found(spark, [(None, 1, "user", "x")]) == []
    for rows in ([(1, 1, "user", "x")], [(101, 1, "user", "x")], [(100, 1, None, "x"), (101, None, "u", None)]):
        assert found(spark, rows) == plain(rows)


def test_totals_of_components():
    """Deep chains, stars and random trees, several components at once."""
    pick = np.random.default_rng(2)
    for shape in ("chain", "star", "random", "random", "random"):
        rows = []
        for c in range(4):
            n = int(pick.integers(1, 400))
            up = [0] + [{"chain": k - 1, "star": 0}.get(shape, int(pick.integers(0, k))) for k in range(1, n)]
            depth = [0] * n
            for k in range(1, n):
                depth[k] = depth[up[k]] + 1
            rows += sorted(((c, 0), depth[k] + 3, 1000 * c + k, 1000 * c + up[k]) for k in range(n))
        top = np.array([[1000 * r[0][0], 3] for r in rows])
        depth, node, parent = (np.array([r[k] for r in rows]) for k in (1, 2, 3))
        values = pick.integers(0, 10 ** 12, (len(rows), 2))
        place = {(d, x): k for k, (d, x) in enumerate(zip(depth.tolist(), node.tolist()))}
        size, want = np.ones(len(rows), np.int64), values.copy()
        for k in reversed(np.argsort(depth, kind="stable").tolist()):
            if depth[k] > 3:
                above = place[depth[k] - 1, parent[k]]
                size[above] += size[k]
                want[above] += want[k]
        assert (trie.component_totals(node, depth, parent, size, top, values) == want).all()


def test_hot_beginnings_stay_spread(spark):
    """Ids that end at one node are joined in pieces of neighbours."""
    rows = [(c, 0, "user", "same") for c in range(3, 30_000, 100)]
    assert found(spark, rows) == plain(rows)
