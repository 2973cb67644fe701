"""What the operators share: table access, stored steps, text slices and components."""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sentinela.sources.snapshots import new_folder

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

# Text that a Python task works on at once. Arrow batches hold a number of rows, and rows
# may be long, so tasks cut them into slices of about this size.
SLICE_BYTES = 1 << 20
# Workers reuse the memory of arrays up to the size of a batch, and give what is larger, or more than
# a few batches in all, back to the system. Taking every array anew costs as much as the work on it.
WORKER_MEMORY = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_MMAP_THRESHOLD_": str(8 << 20),
                 "MALLOC_TRIM_THRESHOLD_": str(32 << 20), "MALLOC_ARENA_MAX": "2"}
# Bytes of an Arrow batch, of which a Python worker holds one or two.
BATCH_BYTES = 8 << 20


def ship(spark: SparkSession) -> None:
    """Let Python workers import this library from where the driver has it, and bound their batches.

    For a cluster that has the library installed or given by ``--py-files`` the first changes
    nothing. Batches are kept small because texts may be long and two workers share an
    executor's memory with its JVM; a smaller setting of the session stays.
    """
    batch = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(batch)) > BATCH_BYTES:
        spark.conf.set(batch, str(BATCH_BYTES))
    environment = spark.sparkContext.environment
    for name, value in WORKER_MEMORY.items():
        environment.setdefault(name, value)
    paths = environment.get("PYTHONPATH", "")
    if ROOT not in paths.split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(p for p in (ROOT, paths) if p)


def free_name(name: str, taken: Sequence[str]) -> str:
    """The name, lengthened until none of those taken is the same."""
    while name.lower() in {t.lower() for t in taken}:
        name = f"_{name}"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Folders written inside the ``temporary_steps`` blocks that are open.
_open_blocks: list[list[str]] = []


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a step into a new folder below the shared one and read it back.

    Cuts the lineage: a lost executor costs the tasks after this point only. The folder stays unless
    ``drop_stored`` or a ``temporary_steps`` block removes it.
    """
    path = new_folder(df.sparkSession, name)
    for block in _open_blocks:
        block.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop_stored(df: DataFrame) -> None:
    """Remove a table written by ``stored`` that no later step reads."""
    for folder in {os.path.dirname(f) for f in df.inputFiles()}:
        _delete(df.sparkSession, folder)


@contextmanager
def temporary_steps(spark: SparkSession) -> Iterator[None]:
    """Remove at its end, also after an error, what ``stored`` wrote inside the block.

    For jobs that write their result elsewhere before the block ends; a DataFrame that is
    still to be computed from such steps would miss them.
    """
    made: list[str] = []
    _open_blocks.append(made)
    try:
        yield
    finally:
        _open_blocks[:] = [block for block in _open_blocks if block is not made]
        for folder in made:
            _delete(spark, folder)


def slices(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut so that a column of text holds about ``SLICE_BYTES`` in each."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start = size = 0
        for row, own in enumerate(sizes):
            if size and size + own > SLICE_BYTES:
                yield batch.slice(start, row - start)
                start, size = row, 0
            size += own
        if start < len(sizes):
            yield batch.slice(start)


def with_texts(batch: pa.RecordBatch, text_column: str, length_column: str,
               texts: list[str | None]) -> pa.RecordBatch:
    """The batch with other texts and, if it has such a column of integers, their lengths."""
    names = batch.schema.names
    batch = batch.set_column(names.index(text_column), text_column,
                             pa.array(texts, batch.column(text_column).type))
    if length_column in names and pa.types.is_integer(batch.column(length_column).type):
        lengths = [None if t is None else len(t) for t in texts]
        batch = batch.set_column(names.index(length_column), length_column,
                                 pa.array(lengths, batch.column(length_column).type))
    return batch


def key_runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Rows of each key, from batches in which the rows of a key follow each other.

    Keys are integers without nulls. One run is held at a time.
    """
    held: list[pa.Table] = []
    now = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        marks = np.stack([rows.column(c).to_numpy() for c in keys], 1)
        cuts = [0, *(np.flatnonzero((marks[1:] != marks[:-1]).any(1)) + 1), len(marks)]
        for start, end in zip(cuts, cuts[1:]):
            if held and tuple(marks[start]) != now:
                yield pa.concat_tables(held).combine_chunks()
                held = []
            now = tuple(marks[start])
            held.append(rows.slice(start, end - start))
    if held:
        yield pa.concat_tables(held).combine_chunks()


def in_blocks(members: DataFrame, key: str, item: str, most: int) -> DataFrame:
    """Split keys of ``size`` over ``most`` items: columns ``block, i, j`` added.

    A key's items fall into blocks, and every pair of blocks (and each block with itself) forms
    a group, so that any two items of a key meet in the group of their two blocks.
    """
    blocks = F.ceil(F.col("size") / most).cast("int")
    return (members.withColumn("_blocks", blocks)
            .withColumn("block", F.pmod(F.xxhash64(item, key), F.col("_blocks")).cast("int"))
            .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
            .withColumn("i", F.least("block", "_other"))
            .withColumn("j", F.greatest("block", "_other")).drop("_blocks", "_other"))


# Positions of the filter below: bitmaps of 2 MB in all, whatever the number of ids.
FILTER_BITS = 1 << 24


def maybe_among(rows: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """Rows whose id may be among the ids: all that are, and few others.

    A bitmap of a fixed number of hash positions is broadcast, so that long rows that the exact
    join would drop are not shuffled for it. ``ids`` has one column. With far more ids than
    positions nothing is filtered, which is slower but as right.
    """
    def place(name: str) -> Column:
        return F.pmod(F.xxhash64(F.col(name).cast("long")), F.lit(FILTER_BITS))

    own = place(ids.columns[0])
    bitmaps = ids.groupBy(F.bitmap_bucket_number(own).alias("_bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(own)).alias("_bits"))
    names = rows.columns
    marked = rows.withColumns({"_bucket": F.bitmap_bucket_number(place(column)),
                               "_bit": F.bitmap_bit_position(place(column))})
    is_set = "(shiftright(cast(conv(hex(substring(_bits, int(_bit div 8) + 1, 1)), 16, 10) as int), " \
             "int(_bit % 8)) & 1) = 1"
    return marked.join(F.broadcast(bitmaps), "_bucket").where(is_set).select(*names)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected edges ``(a, b)`` of ids.

    Large-star and small-star rounds (Kiveris et al. 2014). Returns ``(id, component_id)``
    for every id in an edge, ``component_id`` being the smallest id reachable. Loops and
    repeated edges do no harm; edges with a null end are ignored. Both steps group
    by a node only to take a minimum, so a hub is reduced in every task before the shuffle.
    """
    pairs = (edges.select(F.col("a").cast("long"), F.col("b").cast("long"))
             .where("a is not null and b is not null and a != b"))
    now = stored(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                 .distinct(), "components")
    state = _state(now)
    while state[0]:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # Every larger neighbour is tied to the smallest one around u.
        large = (both.join(least, "u").where("v > u and v != m")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        # Now v < u in every row: smaller neighbours and u itself are tied to the smallest.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least, "u").where("v != m")
                 .select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(least.select("u", F.col("m").alias("v"))).distinct())
        after = stored(small, "components")
        drop_stored(now)
        now, before, state = after, state, _state(after)
        if state == before:
            break
    # A star: every node has one edge to its centre, the smallest id.
    return (now.select(F.col("u").alias("id"), F.col("v").alias("component_id"))
            .union(now.select("v", "v").distinct()))


def _state(edges: DataFrame) -> tuple[int, int]:
    """Number of edges and a checksum, to see whether a round changed anything."""
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], int(row[1] or 0)
