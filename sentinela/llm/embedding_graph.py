"""Embedding near-dedup with a robust-pruned flat graph (operator 3).

Vectors are dealt to overlapping cluster shards, a flat graph is built in each (nearest
candidates and some far ones, pruned so that no kept neighbour hides another), and a vector's
adjacency lists of all its shards are united. Every vector is then searched for: a greedy
search from the shard's medoids and the vector's own place that, once within range, goes on until
all neighbours of everything in range are seen. What it finds is verified in double precision. An audit
compares a sample of queries with brute force over all rows.

Equal vectors are one class throughout. Cluster centres are fitted on ``SAMPLE`` classes
chosen by hash; everything else covers all rows. Centres of cosine ``DENSE_COSINE`` form one
shard, and a class goes to its ``OVERLAP`` nearest shards and to all centres whose angle is within
that of the nearest one, or of ``DENSE_COSINE`` if that is less, plus that of a link. So any two
linked classes share a shard if one of them is that near to a centre. Others may miss each other
in one clustering; classes are therefore dealt by ``CLUSTERINGS`` independent ones. A shard of more than ``MOST`` classes is
worked off in pairs of blocks, so no task holds more than two blocks. A pair is counted in one
group only: its smallest common shard, in the group of its two blocks.

Edge cases: a vector that is null, empty, zero or has null or non-finite components links
with nothing, and vectors of different lengths don't link; a row without id links with nothing and has no
component;
rows that share an id count as separate vectors of one id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentinela.llm.common import components, in_blocks, key_runs, stored

LEAST_COSINE = 0.95
SAMPLE = 20_000             # classes that the centres are fitted on
SHARD = 400                 # classes per centre aimed at; each class goes to several
MOST_CENTRES = 2048
OVERLAP = 3
CLUSTERINGS = 2             # fitted independently; each deals every class
DENSE_COSINE = 0.9          # centres this near form one shard; classes this near are dealt by angle
MOST = 1500                 # classes of a block
CANDIDATES, FAR, DEGREE, ALPHA = 40, 16, 24, 1.2
MEDOIDS, BEAM, QUERIES = 24, 12, 128
STEP_ARCS, STEP_VALUES = 1 << 19, 1 << 20       # arcs and components that a step of a search holds
AUDIT = 64                  # queries of the audit, half of them among classes with links
LEAST_RECALL = 0.9          # of the audit; less is an error

_FAR_SEED = 7


def unit_vectors(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(vec_id, hash, vector): unit vectors as bytes of doubles; nulls where there is none."""

    def prepared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, units = [], []
            for values in batch.column("vector").to_pylist():
                unit = digest = None
                if values and None not in values:
                    raw = np.array(values, np.float64) + 0.0        # -0.0 becomes 0.0
                    top = np.abs(raw).max()
                    if np.isfinite(top) and top > 0:
                        # Scaled first, as squares may overflow or vanish.
                        scaled = raw / top
                        unit = (scaled / np.sqrt((scaled * scaled).sum())).tobytes()
                        digest = xxhash.xxh3_128_digest(raw.tobytes())
                hashes.append(digest)
                units.append(unit)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array(hashes, pa.binary()), pa.array(units, pa.binary())],
                ["vec_id", "hash", "vector"])

    return vectors.select(
        F.col(id_column).cast("long").alias("vec_id"),
        F.col(vector_column).cast("array<double>").alias("vector")).mapInArrow(
        prepared, "vec_id long, hash binary, vector binary")


def matrix(column) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), np.float64).reshape(len(rows), -1)


def fit_centres(sample: np.ndarray, count: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means from rows spread over the sample."""
    centres = sample[np.linspace(0, len(sample) - 1, min(count, len(sample))).astype(int)]
    for _ in range(rounds):
        nearest = (sample @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, sample)
        norms = np.linalg.norm(sums, axis=1)
        full = norms > 0
        centres = centres.copy()
        centres[full] = sums[full] / norms[full, None]
    return centres


def joined_centres(centres: np.ndarray) -> np.ndarray:
    """For each centre, the first of all that steps between centres of ``DENSE_COSINE`` lead to."""
    near = centres @ centres.T >= DENSE_COSINE
    first = np.arange(len(centres))
    while True:
        least = np.minimum(first, np.where(near, first, len(first)).min(1))
        if (least == first).all():
            return first
        first = least


def shards_near(vector: np.ndarray, centres: np.ndarray, first: np.ndarray) -> list[int]:
    """The ``OVERLAP`` nearest shards and those of all centres within the class's angle."""
    likeness = centres @ vector
    ordered = first[np.argsort(-likeness, kind="stable")]
    places = np.sort(np.unique(ordered, return_index=True)[1])[:OVERLAP]
    # Of two linked classes, the one nearer to its centre has the other within the link's angle more.
    angle = np.arccos(np.clip(likeness.max(), DENSE_COSINE, 1)) + np.arccos(LEAST_COSINE)
    return sorted({*ordered[places].tolist(), *first[likeness >= np.cos(angle) - 1e-9].tolist()})


def shards_of(classes: DataFrame, count: int) -> DataFrame:
    """(rep, weight, vector, shards): each class in the shards of its nearest centres."""
    width = F.octet_length("vector").alias("width")
    sample = classes.select("vector", width).orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).collect()
    by_width: dict[int, list[bytes]] = {}
    for row in sample:
        by_width.setdefault(row.width, []).append(bytes(row.vector))
    wanted = min(MOST_CENTRES, max(1, count // SHARD))
    centres, first = {}, 0
    for size in sorted(by_width):
        rows = np.frombuffer(b"".join(by_width[size])).reshape(-1, size // 8)
        for clustering in range(CLUSTERINGS):
            # Another order begins with other centres.
            order = np.random.default_rng(clustering).permutation(len(rows))
            own = fit_centres(rows[order], max(1, round(wanted * len(rows) / len(sample))))
            centres.setdefault(size, []).append((first, own, joined_centres(own)))
            first += len(own)
            if len(own) == 1:
                break               # one shard has all classes already

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shards = []
            for vector in batch.column("vector").to_pylist():
                # Lengths that the sample lacks have a shard of their own, below zero.
                unit = np.frombuffer(vector)
                shards.append([begin + c for begin, own, joined in centres.get(len(vector), ())
                               for c in shards_near(unit, own, joined)] or [-len(vector)])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(shards, pa.list_(pa.int32()))],
                [*batch.schema.names, "shards"])

    return classes.mapInArrow(dealt, "rep long, weight long, vector binary, shards array<int>")


def robust_prune(vectors: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Neighbours of every row, -1 where there are fewer than ``DEGREE``.

    The nearest candidate is kept; it removes those to which it is closer, by the factor ``ALPHA``,
    than the row is; and so on.
    """
    rows = np.arange(len(vectors))
    distance = 1 - np.einsum("nd,ncd->nc", vectors, vectors[candidates])
    order = np.argsort(distance, axis=1, kind="stable")
    candidates = np.take_along_axis(candidates, order, 1)
    distance = np.take_along_axis(distance, order, 1)
    alive = candidates != rows[:, None]
    kept = np.full((len(vectors), DEGREE), -1)
    for k in range(DEGREE):
        some = alive.any(1)
        if not some.any():
            break
        pick = alive.argmax(1)
        chosen = candidates[rows, pick]
        kept[some, k] = chosen[some]
        near = 1 - np.einsum("nd,ncd->nc", vectors[chosen], vectors[candidates])
        # Rows of one direction are at no distance, give or take rounding, and hide none.
        alive &= ALPHA * near + 1e-12 > distance
        alive[rows, pick] = False
        alive &= candidates != chosen[:, None]
    return kept


def build_graph(vectors: np.ndarray) -> np.ndarray:
    """Adjacency of a shard: nearest and far candidates, pruned."""
    n = len(vectors)
    nearest = min(CANDIDATES, n - 1)
    if n < 2:
        return np.full((n, DEGREE), -1)
    likeness = vectors @ vectors.T
    np.fill_diagonal(likeness, -2)
    close = np.argpartition(-likeness, nearest - 1, axis=1)[:, :nearest]
    far = np.random.default_rng(_FAR_SEED).integers(0, n, (n, FAR))
    return robust_prune(vectors, np.concatenate([close, far], 1))


def medoids(vectors: np.ndarray) -> np.ndarray:
    """Rows nearest to the mean of the groups around some spread rows; the first is the shard's."""
    seeds = vectors[np.linspace(0, len(vectors) - 1, min(MEDOIDS, len(vectors))).astype(int)]
    nearest = (vectors @ seeds.T).argmax(1)
    found = [(vectors @ vectors.sum(0)).argmax()]
    for group in range(len(seeds)):
        own = np.flatnonzero(nearest == group)
        if len(own):
            found.append(own[(vectors[own] @ vectors[own].sum(0)).argmax()])
    return np.unique(found)


def both_ways(reps: np.ndarray, near: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Neighbours of every row, row after row, and where each row's begin.

    From lists of neighbours' ``reps``, which ascend. Every arc goes both ways, so that a row that is
    nobody's nearest is still found.
    """
    n = len(reps)
    others = near.flatten().to_numpy()
    rows = np.repeat(np.arange(n), pc.fill_null(pc.list_value_length(near), 0).to_numpy())
    places = np.minimum(np.searchsorted(reps, others), n - 1)
    here = reps[places] == others
    rows, places = rows[here], places[here]
    arcs = np.unique(np.concatenate([rows * n + places, places * n + rows]))
    return arcs % n, np.searchsorted(arcs, np.arange(n + 1) * n)


def range_search(vectors: np.ndarray, arcs: tuple[np.ndarray, np.ndarray], starts: np.ndarray,
                 queries: np.ndarray) -> list[np.ndarray]:
    """For each query row, the rows found within range.

    Each step looks at the neighbours of all rows in range that were not yet looked at, or, where
    there are none, of a query's best row. A query ends when that row is neither in range nor
    among the ``BEAM`` best seen.
    """
    slack = LEAST_COSINE - 1e-9
    others, begins = arcs
    degrees = np.diff(begins)
    n, wide = len(vectors), max(1, STEP_VALUES // vectors.shape[1])
    found = []
    for at in range(0, len(queries), QUERIES):
        own = queries[at:at + QUERIES]
        asked = vectors[own]
        seen = np.full((len(own), n), -2.0)                 # likeness of the rows seen
        seen[:, starts] = asked @ vectors[starts].T
        # A query is a row itself: a group that no path from the medoids enters is seen from inside.
        seen[np.arange(len(own)), own] = 1.0
        ahead = seen.copy()                                 # of those not looked at yet

        def look(rows: np.ndarray, places: np.ndarray) -> None:
            """See the neighbours of some rows, a bounded number at once."""
            ahead[rows, places] = -2.0
            ends = np.cumsum(degrees[places])
            cuts = np.unique(np.searchsorted(ends, np.arange(0, ends[-1], STEP_ARCS), "right"))
            for a, b in zip(cuts, [*cuts[1:], len(rows)]):
                amount = degrees[places[a:b]]
                first = np.repeat(begins[places[a:b]] - (np.cumsum(amount) - amount), amount)
                to = others[first + np.arange(len(first))]
                new = np.repeat(rows[a:b], amount) * n + to
                new = new[seen.ravel()[new] <= -2]
                if len(new) < seen.size >> 5:
                    new = np.unique(new)
                else:                                       # marks are faster than a sort
                    marks = np.zeros(seen.size, bool)
                    marks[new] = True
                    new = np.flatnonzero(marks)
                for k in range(0, len(new), wide):
                    of, to = np.divmod(new[k:k + wide], n)
                    seen[of, to] = ahead[of, to] = np.einsum("nd,nd->n", asked[of], vectors[to])

        going = np.arange(len(own))
        while len(going):
            rows, places = np.nonzero(ahead[going] >= slack)
            if len(rows):
                look(going[rows], places)
                continue
            best = ahead[going].argmax(1)
            value = ahead[going, best]
            beam = -np.partition(-seen[going], min(BEAM, n) - 1, axis=1)[:, min(BEAM, n) - 1]
            more = (value > -2) & (value >= beam)
            going, best = going[more], best[more]
            if len(going):
                look(going, best)
        found += [np.flatnonzero(row >= slack) for row in seen]
    return found


GROUP = ["shard", "i", "j"]


def _grouped(df: DataFrame, work, schema: str) -> DataFrame:
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in key_runs(batches, GROUP):
            yield work(group)

    return df.repartition(*GROUP).sortWithinPartitions(*GROUP, "rep").mapInArrow(each, schema)


def build_shards(members: DataFrame) -> DataFrame:
    """(rep, near): every class's adjacency, united over the groups it is in."""

    def built(group: pa.Table) -> pa.RecordBatch:
        reps = group.column("rep").to_numpy()
        graph = build_graph(matrix(group.column("vector")))
        near = [reps[row[row >= 0]] for row in graph]
        return pa.RecordBatch.from_arrays(
            [pa.array(reps), pa.array(near, pa.list_(pa.int64()))], ["rep", "near"])

    lists = _grouped(members, built, "rep long, near array<long>")
    return lists.groupBy("rep").agg(
        F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))


def search_shards(members: DataFrame) -> DataFrame:
    """(rep, links, root): weight of the classes linked in a group, and a spanning forest."""

    def searched(group: pa.Table) -> pa.RecordBatch:
        reps, weights = group.column("rep").to_numpy(), group.column("weight").to_numpy()
        vectors, blocks = matrix(group.column("vector")), group.column("block").to_numpy()
        arcs = both_ways(reps, group.column("near").combine_chunks())
        shard, ends = group.column("shard")[0].as_py(), {group.column(c)[0].as_py() for c in "ij"}
        # A pair counts in its first common shard: marks of the shards before this one.
        own = group.column("shards").to_pylist()
        before = {s: k for k, s in enumerate(sorted({s for row in own for s in row if s < shard}))}
        marks = np.zeros((len(reps), len(before)), np.float32)
        for row, shards in enumerate(own):
            marks[row, [before[s] for s in shards if s < shard]] = 1
        hit = np.zeros((len(reps), len(reps)), bool)
        for row, near in enumerate(range_search(vectors, arcs, medoids(vectors), np.arange(len(reps)))):
            hit[row, near] = hit[near, row] = True
        links, root = np.zeros(len(reps), np.int64), np.arange(len(reps))
        for a in range(len(reps)):
            near = a + 1 + np.flatnonzero(hit[a, a + 1:])
            if len(ends) > 1:
                near = near[blocks[near] != blocks[a]]
            elif blocks[a] not in ends:
                continue
            near = near[~(marks[near] @ marks[a]).astype(bool)]
            near = near[vectors[near] @ vectors[a] >= LEAST_COSINE]
            if len(near):
                links[a] += weights[near].sum()
                links[near] += weights[a]
                joined = np.unique(root[np.append(near, a)])
                if len(joined) > 1:
                    root[np.isin(root, joined)] = joined[0]
        linked = np.flatnonzero(links)
        return pa.RecordBatch.from_arrays(
            [pa.array(reps[linked]), pa.array(links[linked]), pa.array(reps[root[linked]])],
            ["rep", "links", "root"])

    return _grouped(members, searched, "rep long, links long, root long")


def audit_recall(classes: DataFrame, links: DataFrame) -> float | None:
    """Share of the links of ``AUDIT`` classes that the search has found; None if none is due.

    Half of the classes are chosen by hash among all, half among those with links. Brute force: all
    rows pass the queries, which are at most ``AUDIT`` vectors.
    """
    half, by_hash = AUDIT // 2, (F.xxhash64("rep", F.lit(1)), "rep")
    linked = classes.join(links.select("rep"), "rep").orderBy(*by_hash).limit(half).collect()
    chosen = {r.rep: r for r in [*classes.orderBy(*by_hash).limit(half).collect(), *linked]}
    queries = [(r.rep, np.frombuffer(bytes(r.vector))) for r in chosen.values()]

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = dict.fromkeys((rep for rep, _ in queries), 0)
        for batch in batches:
            reps, weights = batch.column("rep").to_numpy(), batch.column("weight").to_numpy()
            rows = batch.column("vector").to_pylist()
            for size in {len(r) for r in rows}:
                own = [k for k, r in enumerate(rows) if len(r) == size]
                vectors = np.frombuffer(b"".join(rows[k] for k in own)).reshape(len(own), -1)
                for rep, query in queries:
                    if query.nbytes == size:
                        near = (vectors @ query >= LEAST_COSINE) & (reps[own] != rep)
                        totals[rep] += int(weights[own][near].sum())
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(totals), pa.int64()), pa.array(list(totals.values()), pa.int64())],
            ["rep", "due"])

    due = classes.mapInArrow(counted, "rep long, due long").groupBy("rep").agg(F.sum("due").alias("due"))
    both = due.join(links, "rep", "left").agg(
        F.sum("due"), F.sum(F.least("due", F.coalesce("links", F.lit(0))))).first()
    recall = both[1] / both[0] if both[0] else None
    if recall is not None and recall < LEAST_RECALL:
        raise RuntimeError(f"the search has found only {recall:.3f} of the audited links")
    return recall


def near_vectors(vectors: DataFrame, *, id_column: str = "vec_id",
                 vector_column: str = "embedding") -> DataFrame:
    """One row per vector: ``vec_id, n_links, component_id, kept, audited_recall``."""
    units = stored(unit_vectors(vectors, id_column, vector_column), "graph-units")
    # Rows that share an id may be of several classes: a class is a node under a number of its own.
    classes = stored(units.where("hash is not null and vec_id is not null").groupBy("hash").agg(
        F.min("vec_id").alias("least"), F.count("*").alias("weight"), F.first("vector").alias("vector"))
        .withColumn("rep", F.monotonically_increasing_id()), "graph-classes")
    nodes = classes.select("rep", "weight", "vector")
    dealt = stored(shards_of(nodes, nodes.count()), "graph-shards")
    members = dealt.withColumn("shard", F.explode("shards"))
    sizes = members.groupBy("shard").agg(F.count("*").alias("size"))
    members = stored(in_blocks(members.join(sizes, "shard"), "shard", "rep", MOST), "graph-members")
    near = stored(build_shards(members.select(*GROUP, "rep", "vector")), "graph-lists")
    found = stored(search_shards(members.join(near, "rep")), "graph-found")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    groups = stored(components(found.select(F.col("rep").alias("a"), F.col("root").alias("b"))), "graph-groups")
    recall = audit_recall(nodes, links)
    joined = groups.select(F.col("id").alias("rep"), F.col("component_id").alias("group")).join(
        classes.select("rep", "least"), "rep")
    smallest = joined.groupBy("group").agg(F.min("least").alias("component_id"))
    named = classes.select("hash", "rep", "least", "weight").join(links, "rep", "left").join(
        joined.select("rep", "group").join(smallest, "group"), "rep", "left")
    own = F.coalesce("component_id", "least", "vec_id")
    return units.join(named, "hash", "left").select(
        "vec_id",
        F.when(F.col("vec_id").isNull(), 0).otherwise(
            F.coalesce("links", F.lit(0)) + F.coalesce(F.col("weight") - 1, F.lit(0))).cast("long")
        .alias("n_links"),
        F.when(F.col("vec_id").isNotNull(), own).alias("component_id"),
        F.coalesce(F.col("vec_id") == own, F.lit(True)).alias("kept"),
        F.lit(recall).cast("double").alias("audited_recall"))
