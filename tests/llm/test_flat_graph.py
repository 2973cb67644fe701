"""Links of awkward vectors, and of isolated pairs among many diffuse ones."""

from __future__ import annotations

import numpy as np
import pytest

from sentinela.llm import embedding_graph

SCHEMA = "vec_id long, embedding array<double>, rep int, shard string, links long"


def near(spark, rows):
    vectors = spark.createDataFrame([(*r, 1, "s", 2) for r in rows], SCHEMA).repartition(4)
    got = embedding_graph.near_vectors(vectors)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept", "audited_recall"]
    return got.collect()


def test_rows_that_share_an_id_have_links_of_their_own(spark):
    rows = [(3, [1.0, 0.0, 0.0]), (3, [0.0, 1.0, 0.0]), (4, [0.99, 0.05, 0.0]), (9, [0.0, 0.0, 1.0]),
            (None, [1.0, 0.0, 0.0]), (5, None), (6, []), (7, [0.0, 0.0, 0.0]), (8, [float("nan"), 1.0, 0.0]),
            (2, [0.0, 0.0, 2.0]), (2, [0.0, 0.0, 3.0])]
    got = sorted((r.vec_id if r.vec_id is not None else -1, r.n_links, r.component_id, r.kept) for r in near(spark, rows))
    assert got == [(-1, 0, None, True), (2, 2, 2, True), (2, 2, 2, True), (3, 0, 3, True), (3, 1, 3, True),
                   (4, 1, 3, False), (5, 0, 5, True), (6, 0, 6, True), (7, 0, 7, True), (8, 0, 8, True),
                   (9, 2, 2, False)]
    assert {r.audited_recall for r in near(spark, rows)} == {1.0}
    assert {r.audited_recall for r in near(spark, rows[1:2])} == {None}
    assert near(spark, []) == []


def test_an_audit_below_the_least_recall_fails(spark):
    nodes = spark.createDataFrame(
        [(k, 1, np.array([1.0, 0.001 * k]).tobytes()) for k in range(10)], "rep long, weight long, vector binary")
    lost = spark.createDataFrame([(0, 1)], "rep long, links long")
    with pytest.raises(RuntimeError, match="audited links"):
        embedding_graph.audit_recall(nodes, lost)


def test_isolated_pairs_among_diffuse_vectors(spark):
    """Pairs at cosine 0.951, far from everything else."""
    pick = np.random.default_rng(5)
    units = pick.normal(size=(20_000, 64))
    units /= np.linalg.norm(units, axis=1)[:, None]
    side = pick.normal(size=(400, 64))
    side -= (side * units[:400]).sum(1)[:, None] * units[:400]
    side /= np.linalg.norm(side, axis=1)[:, None]
    units[400:800] = 0.951 * units[:400] + np.sqrt(1 - 0.951 ** 2) * side
    got = {r.vec_id: r.n_links for r in near(spark, [(k, u.tolist()) for k, u in enumerate(units)])}
    lost = [k for k in range(800) if got[k] == 0]
    assert len(lost) <= 4 and sum(got.values()) == 800 - len(lost)
