"""Hard-negative mining by residue-number-system products (operator 13).

Components become integers, and every score is an exact integer inner product. It is taken modulo
several small primes: the components' balanced residues are multiplied as float32 matrices, whose
sums stay below 2**24 and are therefore exact, and the signed score is put together from the
residues by Chinese remaindering (balanced mixed-radix digits). As many primes are used as the
largest norm of the table asks for, because no score exceeds the product of two norms.

Anchors meet all rows in tiles: rows and anchors fall into blocks of bounded size, and each pair of
blocks is one group of a shuffle. A tile gives out the best few of each anchor; a window over
these few per tile selects the best of all. The first pass finds the positives, whose scores bound
those of the negatives that the second pass looks for.

Edge cases: rows without id, label or vector, or with a null or non-finite component take no
part; vectors of different lengths are never compared, an empty one scores 0 with another empty
one. Rows that share an id are separate rows, also as anchors: each gives rows of its own, and the
others count as candidates. Scores of 64 bits or more are an error. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sentinela.llm.common import key_runs, stored

SCALE = 256
POSITIVES, NEGATIVES = 5, 5
LEAST_PERCENT, MOST_PERCENT = 80, 100      # of the positive's score
LABELS = 10
ROW_BLOCK, ANCHOR_BLOCK = 8192, 2048
SLICE = 256                                 # anchors of a tile multiplied at once
LARGEST_PRIME = 251
EXACT = 1 << 24                             # float32 holds all integers up to here

TILE = ["i", "j", "width"]


def primes_for(bound: int) -> list[int]:
    """The largest small primes whose product tells all scores from -bound to bound apart."""
    if bound >= 1 << 63:
        raise OverflowError(f"scores up to {bound} do not fit into 64 bits")
    found, product = [], 1
    candidate = LARGEST_PRIME
    while product <= 2 * bound:
        if all(candidate % k for k in range(2, math.isqrt(candidate) + 1)):
            found.append(candidate)
            product *= candidate
        candidate -= 2
    return found


def balanced(values: np.ndarray, prime: int) -> np.ndarray:
    """Residues from -(prime - 1) / 2 to (prime - 1) / 2 of an odd prime."""
    half = prime // 2
    return (values + half) % prime - half


def residue_product(a: np.ndarray, b: np.ndarray, prime: int) -> np.ndarray:
    """``a @ b.T`` modulo the prime, from float32 products short enough to be exact."""
    left = balanced(a, prime).astype(np.float32)
    right = balanced(b, prime).astype(np.float32)
    step = EXACT // (prime // 2) ** 2
    total = np.zeros((len(a), len(b)), np.int64)
    for k in range(0, a.shape[1], step):
        total += (left[:, k:k + step] @ right[:, k:k + step].T).astype(np.int64)
    return balanced(total, prime)


def scores(a: np.ndarray, b: np.ndarray, primes: list[int]) -> np.ndarray:
    """Exact signed inner products of integer rows, reconstructed from their residues.

    The score is d1 + p1 * (d2 + p2 * (d3 + ...)) with balanced digits, found one after
    another. Its value fits into 64 bits even where a partial product wraps.
    """
    total = np.zeros((len(a), len(b)), np.int64)
    weight = 1
    for prime in primes:
        digit = residue_product(a, b, prime)
        # What the earlier digits leave, divided by their primes.
        digit = balanced((digit - total % prime) * pow(weight % prime, -1, prime), prime)
        with np.errstate(over="ignore"):
            total = total + digit * np.int64((weight + (1 << 63)) % (1 << 64) - (1 << 63))
        weight *= prime
    return total


def first_few(own: np.ndarray, allowed: np.ndarray, count: int) -> np.ndarray:
    """The first places allowed, higher values first and of equal ones the smaller place."""
    if len(allowed) > count:
        least = np.partition(own[allowed], len(allowed) - count)[len(allowed) - count]
        allowed = allowed[own[allowed] >= least]
    return allowed[np.argsort(-own[allowed], kind="stable")][:count]


def integer_vectors(rows: DataFrame) -> DataFrame:
    """(id, label, vector) -> (row, id, label, width, vector, norm): components floor(256 * x).

    Vectors are bytes of 64-bit integers, ``norm`` the squared length as text, ``row`` tells rows apart.
    """

    def converted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for id_, label, values in zip(*(batch.column(c).to_pylist() for c in ("id", "label", "vector"))):
                if None in values:
                    continue
                exact = np.array(values, np.float64)
                if not np.isfinite(exact).all():
                    continue
                whole = np.floor(SCALE * exact)
                if len(whole) and np.abs(whole).max() >= 2.0 ** 62:
                    raise OverflowError(f"a component of row {id_} does not fit into 64 bits")
                whole = whole.astype("<i8")
                norm = sum(int(v) * int(v) for v in whole)
                out.append((id_, label, len(whole), whole.tobytes(), str(norm)))
            columns = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (
                    pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.string()))],
                ["id", "label", "width", "vector", "norm"])

    return rows.where("id is not null and label is not null and vector is not null").select(
        "id", "label", "vector").mapInArrow(
        converted, "id long, label long, width int, vector binary, norm string").withColumn(
        "row", F.monotonically_increasing_id())


def _numbers(count: int) -> Column:
    return F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long"))


def tiles(rows: DataFrame, anchors: DataFrame, row_blocks: int, anchor_blocks: int) -> DataFrame:
    """Rows and anchors of each pair of blocks; ``anchor`` is null for rows."""
    names = [f.name for f in anchors.schema if f.name not in rows.columns]
    empty = [F.lit(None).cast(anchors.schema[n].dataType).alias(n) for n in names]
    candidates = rows.select(
        F.pmod(F.xxhash64("row"), F.lit(row_blocks)).alias("i"),
        F.explode(_numbers(anchor_blocks)).alias("j"),
        *rows.columns, *empty)
    asked = anchors.select(
        F.explode(_numbers(row_blocks)).alias("i"),
        F.pmod(F.xxhash64("row", F.lit(1)), F.lit(anchor_blocks)).alias("j"),
        *anchors.columns)
    return candidates.unionByName(asked.select(*candidates.columns)).withColumn(
        "width", F.col("width").cast("long"))


def _vectors(table: pa.Table) -> np.ndarray:
    width = table.column("width")[0].as_py()
    return np.frombuffer(b"".join(table.column("vector").to_pylist()), "<i8").reshape(
        table.num_rows, width).astype(np.int64)


def _each_tile(grouped: DataFrame, select, schema: str) -> DataFrame:
    """``select(rows, anchors)`` for each tile with both, rows by id; it yields record batches."""

    def worked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile in key_runs(batches, TILE):
            asked = tile.column("wanted").is_valid()
            rows, anchors = tile.filter(pc.invert(asked)), tile.filter(asked)
            if rows.num_rows and anchors.num_rows:
                yield from select(rows, anchors)

    return grouped.repartition(*TILE).sortWithinPartitions(*TILE, "id", "row").mapInArrow(worked, schema)


def best_positives(rows: DataFrame, anchors: DataFrame, blocks: tuple[int, int],
                   primes: list[int]) -> DataFrame:
    """(anchor, anchor_id, positive, positive_score): other rows of the anchor's label, best first."""

    def select(rows: pa.Table, anchors: pa.Table) -> Iterator[pa.RecordBatch]:
        a, b = _vectors(anchors), _vectors(rows)
        labels, own = rows.column("label").to_numpy(), anchors.column("label").to_numpy()
        places, ids = rows.column("row").to_numpy(), rows.column("id").to_numpy()
        names, anchor_ids = anchors.column("row").to_numpy(), anchors.column("id").to_numpy()
        out = []
        for label in np.unique(own):
            same, group = np.flatnonzero(labels == label), np.flatnonzero(own == label)
            for at in range(0, len(group) if len(same) else 0, SLICE):
                part = group[at:at + SLICE]
                for k, line in zip(part, scores(a[part], b[same], primes)):
                    best = first_few(line, np.flatnonzero(places[same] != names[k]), POSITIVES)
                    out += [(names[k], anchor_ids[k], ids[same[x]], line[x]) for x in best]
        columns = np.array(out, np.int64).reshape(-1, 4).T
        yield pa.RecordBatch.from_arrays(
            [pa.array(c) for c in columns], ["anchor", "anchor_id", "positive_id", "positive_score"])

    grouped = tiles(rows, anchors.withColumn("wanted", F.array().cast("array<long>")), *blocks)
    found = _each_tile(grouped, select,
                       "anchor long, anchor_id long, positive_id long, positive_score long")
    order = Window.partitionBy("anchor").orderBy(F.desc("positive_score"), "positive_id")
    return found.withColumn("place", F.row_number().over(order)).where(f"place <= {POSITIVES}")


def best_negatives(rows: DataFrame, anchors: DataFrame, blocks: tuple[int, int],
                   primes: list[int]) -> DataFrame:
    """For each of an anchor's ``wanted`` positive scores, the best rows of other labels in range."""

    def select(rows: pa.Table, anchors: pa.Table) -> Iterator[pa.RecordBatch]:
        a, b = _vectors(anchors), _vectors(rows)
        labels, own = rows.column("label").to_numpy(), anchors.column("label").to_numpy()
        ids, names = rows.column("id").to_numpy(), anchors.column("row").to_numpy()
        wanted = anchors.column("wanted").to_pylist()
        out = []
        for at in range(0, len(a), SLICE):
            for k, line in enumerate(scores(a[at:at + SLICE], b, primes), at):
                other = labels != own[k]
                for score in set(wanted[k]):
                    # Whole numbers between the two shares of the positive's score.
                    low = -(-LEAST_PERCENT * score // 100)
                    high = MOST_PERCENT * score // 100
                    best = first_few(line, np.flatnonzero(other & (line >= low) & (line <= high)), NEGATIVES)
                    out += [(names[k], score, ids[x], line[x]) for x in best]
        columns = np.array(out, np.int64).reshape(-1, 4).T
        yield pa.RecordBatch.from_arrays(
            [pa.array(c) for c in columns], ["anchor", "positive_score", "negative_id", "negative_score"])

    grouped = tiles(rows, anchors, *blocks)
    found = _each_tile(grouped, select,
                       "anchor long, positive_score long, negative_id long, negative_score long")
    order = Window.partitionBy("anchor", "positive_score").orderBy(
        F.desc("negative_score"), "negative_id")
    return found.withColumn("rank", F.row_number().over(order)).where(f"rank <= {NEGATIVES}")


def mine_negatives(vectors: DataFrame, *, id_column: str = "vec_id", vector_column: str = "embedding",
                   label_column: str = "label", anchor_every: int = 100,
                   relabel_every: int = 7) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Rows whose id is divisible by ``anchor_every`` are anchors; the label of those whose id is
    divisible by ``relabel_every`` moves on by one first.
    """
    id_, label = F.col(id_column).cast("long"), F.col(label_column).cast("long")
    moved = F.when(id_ % relabel_every == 0, (label + 1) % LABELS).otherwise(label)
    rows = stored(integer_vectors(vectors.select(
        id_.alias("id"), moved.alias("label"),
        F.col(vector_column).cast("array<double>").alias("vector"))), "negative-rows")
    anchors = rows.where(f"id % {anchor_every} = 0")
    seen = rows.agg(F.count("*"), F.count_if(F.col("id") % anchor_every == 0),
                    F.max(F.col("norm").cast("decimal(38,0)"))).first()
    blocks = tuple(max(1, math.ceil(n / most)) for n, most in zip(seen, (ROW_BLOCK, ANCHOR_BLOCK)))
    primes = primes_for(int(seen[2] or 0))
    rows, anchors = rows.drop("norm"), anchors.drop("norm")

    positives = stored(best_positives(rows, anchors, blocks, primes), "negative-positives")
    wanted = positives.groupBy(F.col("anchor").alias("row")).agg(
        F.collect_set("positive_score").alias("wanted"))        # at most POSITIVES of each
    negatives = best_negatives(rows, anchors.join(wanted, "row"), blocks, primes)
    return positives.join(negatives, ["anchor", "positive_score"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
