"""Mixing: targets, budgets and blocks beside plain Python."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sentinela.llm import mixing
from sentinela.llm.common import stored, table

SCHEMA = "doc_id long, text string, source string, size int, bucket string, block long"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def targets(sizes):
    """Share, stop, share what is left, until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weights = {s: mixing.WEIGHTS[k % 3] for k, s in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        rest = [s for s in order if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: left * weights[s] / sum(weights[t] for t in rest) for s in rest}
        over = [s for s in rest if share[s] > 3 * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: 3 * sizes[s] for s in over}


def mixed(spark, rows, partitions=3):
    docs = spark.createDataFrame([(*r, 1, "b", 2) for r in rows], SCHEMA).repartition(partitions)
    copies, mix = mixing.mix_sources(docs)
    mix = stored(mix, "test-mix")
    return docs, mix, mixing.words_taken(copies, mix).collect()


def check(rows, taken):
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += len(words(text))
    want = targets(sizes)
    assert Counter((r.doc_id, r.size) for r in taken) == Counter((d, len(words(t))) for d, t, _ in rows)
    by_size = {}
    for r in taken:
        assert 0 <= r.taken <= 3 * r.size
        by_size.setdefault((r.source_size, r.target), []).append(r.taken)
    wanted = Counter()
    for source in sizes:
        wanted[sizes[source]] += int(want[source] + 0.5)
    got = Counter()
    for (size, target), own in by_size.items():
        assert any(size == sizes[s] and target == pytest.approx(want[s]) for s in sizes)
        got[size] += sum(own)
    assert +got == +wanted


AWKWARD = (
    [(k, f"w{k} " * (37 * k % 400), "abcdé"[k % 5]) for k in range(120)]
    + [(None, "null id here", None), (None, None, None), (7, "", "a"), (8, " \n\t ", "empty"),
       (9, "one", "small"), (10, "x " * 30_000, "long")]
    + [(11, "the same row again", "copies")] * 1500 + [(3, "w3 again", "b")] * 2)


def test_mix_of_awkward_rows(spark):
    docs, mix, taken = mixed(spark, AWKWARD)
    check(AWKWARD, taken)
    again = mixed(spark, AWKWARD[::-1], 11)[2]
    assert sorted(map(str, again)) == sorted(map(str, taken))

    # The blocks as texts: each slot holds consecutive words of its source, full but for tails.
    texts = mixing.mixed_texts(mix, docs).collect()
    assert len(texts) == mix.count()
    held = Counter()
    for r in texts:
        own = r.text.split(" ")
        assert len(own) == r.n_words
        held[r.shard, r.place] += r.n_words
        if r.source == "long":
            assert set(own) == {"x"}
    assert max(held.values()) == mixing.BLOCK_WORDS
    assert sum(n < mixing.BLOCK_WORDS for n in held.values()) <= 3 * 2 * len({r.source for r in texts})
    places = {}
    for shard, place in held:
        places.setdefault(shard, set()).add(place)
    assert all(p == set(range(len(p))) for p in places.values())
    used = Counter((r.source, r["pass"], r.block, r.at) for r in texts)
    assert max(used.values()) == 1          # a block once in each pass


def test_mix_of_few_and_no_rows(spark):
    assert mixed(spark, [])[2] == []
    only = mixed(spark, [(1, None, "a"), (2, "", None)])[2]
    assert sorted((r.doc_id, r.size, r.target, r.taken) for r in only) == [(1, 0, 0.0, 0), (2, 0, 0.0, 0)]
    rows = [(1, "one two three", "a"), (2, "x", "b")]
    check(rows, mixed(spark, rows)[2])


def test_mix_of_the_table(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    copies, mix = mixing.mix_sources(docs)
    check([tuple(r) for r in docs.select("doc_id", "text", "source").collect()],
          mixing.words_taken(copies, mix).collect())


def test_permutation(spark):
    for count in (1, 2, 7, 1000):
        key = F.xxhash64(F.lit(count))
        got = [r[0] for r in spark.range(count).select(
            mixing.permuted(F.col("id"), F.lit(count), key)).collect()]
        assert sorted(got) == list(range(count))
    assert np.corrcoef(got, range(1000))[0, 1] < 0.2


def test_draws_are_multinomial_and_hold_the_budgets(spark):
    """Shards differ as draws do; the sum over all shards is the budget."""
    budgets = spark.createDataFrame(
        [("a", 0, 60_000, 60_000), (None, 60_000, 90_000, 30_000), ("c", 90_000, 100_000, 10_000)],
        "source string, low long, high long, slots long")
    rows = mixing.drawn_counts(budgets, 100_000).collect()
    total, by_shard = Counter(), Counter()
    for r in rows:
        total[r.source] += r["count"]
        by_shard[r.shard] += r["count"]
    assert total == {"a": 60_000, None: 30_000, "c": 10_000}
    assert set(by_shard.values()) == {mixing.SHARD_SLOTS, 100_000 % mixing.SHARD_SLOTS}
    own = [r["count"] for r in rows if r.source == "c" and by_shard[r.shard] == mixing.SHARD_SLOTS]
    assert 10 < np.std(own[:-4]) < 35       # sqrt(4096 * 0.1 * 0.9) = 19


def test_no_python_in_the_plan(spark):
    copies, mix = mixing.mix_sources(table(spark, "/root/testdata/sf0.001", "documents"))
    plan = mixing.words_taken(copies, mix)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
