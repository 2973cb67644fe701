"""MinHash near-dedup through a multi-index Hamming join (operator 6).

A document's set is that of its word shingles; its signature has ``SYMBOLS`` min-hashes of
``BITS`` bits. Signatures are compared by the number of symbols that differ. They are
split into chunks; if two differ in at most ``REACH`` symbols, then by the pigeonhole
principle some chunk differs in at most ``ERRORS`` of them. The keys of a chunk list
all ways to leave out that many symbols, so every pair within reach shares a key. With 64
symbols and a reach of 31 a pair of similarity 0.75 is out of reach once in some 69,000
cases, one of 0.8 once in some 12 million. Pairs within reach are confirmed on whole shingle sets.

Documents with equal sets are one class before anything is compared. Classes that share a key
are not paired all with all:

1. Each key's smallest class is its pivot. Members within reach of a pivot are confirmed
   against it, first with the pivot met most often, then with the rest unless already
   connected. Keys, pivots and links are joins and counts, which no hot key unbalances.
2. The distance being a metric, a member connected to its pivot can be left out if no
   unconnected member of the key can be within its reach. Keys of near copies end here.
3. What is left, where a key still has classes of several components, is compared in blocks:
   signatures first, ``SIGNATURE_BLOCK`` at once; then, for classes with an unconnected partner
   within reach, the shingle sets of ``BLOCK`` texts. Only a key larger than that is worked off in
   pairs of blocks. Signature and text are joined once per class and key, before any such copy.
   A pair is compared under its first common key only, and a block gives out a spanning
   forest of its links, so nothing grows with the pairs.

Edge cases: a null text or one without words has an empty set and is linked with nothing; a
null id is linked with nothing and kept; rows that share an id are one document with all
its rows' links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentinela.llm.common import components, free_name, in_blocks, key_runs, maybe_among, slices, stored
from sentinela.llm.words import mix, shingle_hashes, shingle_sets, word_hashes, words

SYMBOLS, BITS, CHUNKS, ERRORS = 64, 16, 16, 1
CHUNK = SYMBOLS // CHUNKS
REACH = CHUNKS * (ERRORS + 1) - 1
SHINGLE = 5
LEAST_PERCENT = 75
SIGNATURE_BLOCK = 4096
BLOCK = 1000
PAIRS_PER_HUB = 500

_RANDOM = np.random.default_rng(20)
_FACTORS = _RANDOM.integers(1, 1 << 63, SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _RANDOM.integers(0, 1 << 63, SYMBOLS, dtype=np.uint64)


def signatures(runs: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A row of symbols for each text; of zeros for a text without shingles."""
    full = np.flatnonzero(np.diff(starts))
    out = np.zeros((len(starts) - 1, SYMBOLS), np.uint16)
    if len(full):
        with np.errstate(over="ignore"):
            for s in range(SYMBOLS):
                least = np.minimum.reduceat(runs * _FACTORS[s] + _SHIFTS[s], starts[full])
                out[full, s] = (mix(least) >> np.uint64(64 - BITS)).astype(np.uint16)
    return out


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> number of shingles, hash of the whole set and signature."""

    def fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            flat, offsets = words(part.column("text"))
            runs, starts = shingle_hashes(word_hashes(flat), offsets, SHINGLE)
            sets = [np.unique(runs[a:b]) for a, b in zip(starts[:-1], starts[1:])]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                 pa.array([s.tobytes() for s in signatures(runs, starts)], pa.binary())],
                ["doc_id", "n_shingles", "set_hash", "signature"])

    return docs.mapInArrow(
        fingerprint, "doc_id long, n_shingles long, set_hash binary, signature binary")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, SYMBOLS)


def signature_keys(classes: DataFrame) -> DataFrame:
    """(rep, signature) -> (key, rep): every chunk with every choice of symbols left out."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            symbols = _matrix(batch.column("signature")).astype(np.int64)
            reps = batch.column("rep").to_numpy()
            for chunk in range(CHUNKS):
                own = symbols[:, chunk * CHUNK:(chunk + 1) * CHUNK]
                for out in range(CHUNK):
                    key = np.full(len(reps), chunk * CHUNK + out, np.int64)
                    for place in range(CHUNK):
                        if place != out:
                            key = key << BITS | own[:, place]
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(reps)],
                                                     ["key", "rep"])

    assert ERRORS == 1 and BITS * (CHUNK - ERRORS) + 6 <= 63
    return classes.select("rep", "signature").mapInArrow(keyed, "key long, rep long")


def distances(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Add ``distance``, the number of differing symbols, to pairs ``(a, b)`` of classes."""

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            differ = _matrix(batch.column("sa")) != _matrix(batch.column("sb"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("a"), batch.column("b"), batch.column("shared"),
                 pa.array(differ.sum(1, dtype=np.int32))], ["a", "b", "shared", "distance"])

    left = classes.select(F.col("rep").alias("a"), F.col("signature").alias("sa"))
    right = classes.select(F.col("rep").alias("b"), F.col("signature").alias("sb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "shared", "sa", "sb").mapInArrow(
        measured, "a long, b long, shared long, distance int")


def confirm(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Those of the distinct pairs ``(a, b)`` whose whole shingle sets are similar enough.

    The text of ``b`` travels to ``a``, whose many partners are spread over several groups with
    a copy of ``a`` each. A task holds one text of ``a`` at a time.
    """
    groups = pairs.groupBy("a").agg(F.ceil(F.count("*") / PAIRS_PER_HUB).cast("int").alias("n"))
    hubs = docs.join(groups, docs.doc_id == groups.a).select(
        "a", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("part"),
        F.lit(None).cast("long").alias("b"), "text")
    others = pairs.join(groups, "a").join(docs, F.col("b") == docs.doc_id).select(
        "a", F.pmod(F.xxhash64("b"), F.col("n")).cast("int").alias("part"), "b", "text")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, sets, done = None, [], False   # rows that share the id a may have several texts
        for part in slices(batches, "text"):
            found = []
            for a, b, own in zip(part.column("a").to_pylist(), part.column("b").to_pylist(),
                                 shingle_sets(part.column("text"), SHINGLE)):
                if b is None:
                    hub, sets = a, [*(sets if hub == a and not done else []), own]
                    done = False
                    continue
                done = True
                for other in sets:
                    both = len(np.intersect1d(other, own, assume_unique=True))
                    if 100 * both >= LEAST_PERCENT * (len(other) + len(own) - both) > 0:
                        found.append((a, b))
                        break
            yield pa.RecordBatch.from_arrays(
                [pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], ["a", "b"])

    rows = hubs.unionByName(others).repartition("a", "part")
    return rows.sortWithinPartitions("a", "part", F.col("b").asc_nulls_first()).select(
        "a", "b", "text").mapInArrow(compared, "a long, b long")


def _connected(df: DataFrame, groups: DataFrame, a: str, b: str) -> DataFrame:
    """Add ``ca`` and ``cb``, the components so far of two columns of classes."""
    for column, name in ((a, "ca"), (b, "cb")):
        own = groups.select(F.col("id").alias(column), F.col("component_id").alias(name))
        df = df.join(own, column, "left").withColumn(name, F.coalesce(name, column))
    return df


def _grown(groups: DataFrame | None, links: DataFrame) -> DataFrame:
    """Components after further links."""
    if groups is not None:
        links = links.union(groups.select("id", "component_id"))
    return stored(components(links), "near-groups")


def _within_reach(symbols: np.ndarray, x: int, others: np.ndarray, key: int) -> np.ndarray:
    """Those of the rows ``others`` within reach of row x whose first common key is this one."""
    differ = symbols[others] != symbols[x]
    close = differ.sum(1) <= REACH
    differ, others = differ[close], others[close]
    # Chunks with few enough errors; of the first one, the symbol to leave out.
    chunks = differ.reshape(-1, CHUNKS, CHUNK)
    first = (chunks.sum(2) <= ERRORS).argmax(1)
    out = chunks[np.arange(len(others)), first].argmax(1)
    return others[first * CHUNK + out == key >> (BITS * (CHUNK - ERRORS))]


def _block_rows(group: pa.Table) -> Iterator[tuple[int, np.ndarray]]:
    """Each unconnected pair of rows within reach once: a row and its later partners."""
    symbols, comps = _matrix(group.column("signature")), group.column("component").to_numpy()
    key, i, j = (group.column(c)[0].as_py() for c in ("key", "i", "j"))
    blocks = group.column("block").to_numpy()
    rows = np.arange(len(blocks))
    right = rows[blocks == j]
    for x in rows[blocks == i]:
        others = right[right > x] if i == j else right
        found = _within_reach(symbols, x, others[comps[others] != comps[x]], key)
        if len(found):
            yield x, found


BLOCK_KEYS = ["key", "i", "j"]


def with_partners(members: DataFrame) -> DataFrame:
    """Rows of blocks that have an unconnected partner within reach, without the signature."""

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in key_runs(batches, BLOCK_KEYS):
            has = np.zeros(group.num_rows, bool)
            for x, found in _block_rows(group):
                has[x] = True
                has[found] = True
            if has.any():
                yield from group.filter(pa.array(has)).to_batches()

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in members.schema)
    return members.repartition(*BLOCK_KEYS).sortWithinPartitions(*BLOCK_KEYS, "rep").mapInArrow(
        chosen, schema)


def confirm_in_blocks(members: DataFrame) -> DataFrame:
    """Links ``(a, b)`` that connect what the blocks' confirmed pairs connect.

    All unconnected pairs within reach are confirmed on the sets of the block's texts; pairs that
    an earlier one has connected need no look. A spanning forest goes out, not the pairs.
    """

    def confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in key_runs(batches, BLOCK_KEYS):
            reps = group.column("rep").to_numpy()
            sets = shingle_sets(group.column("text"), SHINGLE)
            sizes = np.array([len(s) for s in sets])
            root, links = list(range(len(reps))), []

            def top(x: int) -> int:
                while root[x] != x:
                    root[x] = x = root[root[x]]
                return x

            for x, found in _block_rows(group):
                found = found[np.array([top(y) != top(x) for y in found.tolist()], bool)]
                # Similar sets are of similar size.
                small, large = np.minimum(sizes[found], sizes[x]), np.maximum(sizes[found], sizes[x])
                found = found[100 * small >= LEAST_PERCENT * large]
                if not len(found) or not sizes[x]:
                    continue
                flat = np.concatenate([sets[y] for y in found])
                at = np.minimum(np.searchsorted(sets[x], flat), sizes[x] - 1)
                ends = np.cumsum(sizes[found])
                both = np.diff(np.concatenate([[0], np.cumsum(sets[x][at] == flat)[ends - 1]]))
                for y in found[100 * both >= LEAST_PERCENT * (sizes[x] + sizes[found] - both)].tolist():
                    if top(x) != top(y):
                        links.append((reps[x], reps[y]))
                        root[top(y)] = top(x)
            yield pa.RecordBatch.from_arrays(
                [pa.array([link[k] for link in links], pa.int64()) for k in (0, 1)], ["a", "b"])

    return members.repartition(*BLOCK_KEYS).sortWithinPartitions(*BLOCK_KEYS, "rep").mapInArrow(
        confirmed, "a long, b long")


def near_groups(docs: DataFrame, *, id_column: str = "doc_id",
                text_column: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id, kept``.

    ``component_id`` is the smallest id reachable by links, ``kept`` marks that document.
    """
    docs = docs.select(F.col(id_column).cast("long").alias("doc_id"),
                       F.col(text_column).cast("string").alias("text"))
    prints = stored(fingerprints(docs), "near-prints")
    classes = stored(
        prints.where("n_shingles > 0 and doc_id is not null").groupBy("set_hash")
        .agg(F.min("doc_id").alias("rep"), F.first("signature").alias("signature")), "near-classes")

    keys = signature_keys(classes)
    pivots = keys.groupBy("key").agg(F.min("rep").alias("pivot"), F.count("*").alias("size"))
    members = stored(keys.join(pivots.where("size > 1"), "key")
                     .where("rep != pivot").select("key", "pivot", "rep"), "near-members")
    stars = members.groupBy(F.col("pivot").alias("a"), F.col("rep").alias("b")).agg(
        F.count("*").alias("shared"))
    stars = stored(distances(stars, classes), "near-stars")

    # Each class with the pivot it meets most often, then the other pivots within reach.
    close = stars.where(f"distance <= {REACH}")
    ids = close.select(F.col("a").alias("doc_id")).union(close.select("b")).distinct()
    # Not a semi join: Spark would do that before the filter.
    texts = stored(maybe_among(docs, ids, "doc_id").join(ids, "doc_id"), "near-texts")
    first = close.groupBy("b").agg(F.max_by("a", F.struct("shared", -F.col("a"))).alias("a"))
    linked = stored(confirm(stored(first.select("a", "b"), "near-pairs"), texts), "near-links")
    groups = _grown(None, linked)
    rest = _connected(close.select("a", "b"), groups, "a", "b").where("ca != cb").select("a", "b")
    rest = stored(rest.join(first, ["a", "b"], "left_anti"), "near-pairs")
    groups = _grown(groups, confirm(rest, texts))

    # Keys with classes not connected to their pivot, and whom those may still link with.
    apart = _connected(members.join(
        stars.select(F.col("a").alias("pivot"), F.col("b").alias("rep"), "distance"),
        ["pivot", "rep"]), groups, "pivot", "rep")
    apart = stored(apart.select("key", "rep", "distance", F.col("cb").alias("component"),
                                (F.col("ca") == F.col("cb")).alias("tied")), "near-apart")
    nearest = apart.where("not tied").groupBy("key").agg(F.min("distance").alias("least"))
    left = apart.join(nearest, "key").where(f"not tied or distance >= least - {REACH}").select(
        "key", "rep", "component")
    # Classes that are connected already have nothing to find out.
    several = left.groupBy("key").agg(
        F.count("*").alias("size"), F.min("component").alias("low"), F.max("component").alias("high"))
    left = stored(left.join(several.where("low != high").select("key", "size"), "key"), "near-left")
    known = classes.groupBy("rep").agg(F.first("signature").alias("signature"))
    chosen = stored(with_partners(in_blocks(left.join(known, "rep"), "key", "rep", SIGNATURE_BLOCK).select(
        *BLOCK_KEYS, "block", "rep", "component", "signature")), "near-partners")
    # A class of several pairs of blocks may have been chosen in some of them.
    chosen = chosen.select("key", "rep", "component", "signature").dropDuplicates(["key", "rep"])
    ids = chosen.select(F.col("rep").alias("doc_id")).distinct()
    # Not a semi join: Spark would do that before the filter.
    texts = stored(maybe_among(docs, ids, "doc_id").join(ids, "doc_id"), "near-texts")
    sizes = chosen.groupBy("key").agg(F.count("*").alias("size"))
    named = chosen.join(sizes, "key").join(texts.withColumnRenamed("doc_id", "rep"), "rep")
    groups = _grown(groups, confirm_in_blocks(in_blocks(named, "key", "rep", BLOCK).select(
        *BLOCK_KEYS, "block", "rep", "component", "signature", "text")))

    reps = classes.select("set_hash", "rep")
    named = groups.select(F.col("id").alias("rep"), "component_id")
    return (prints.join(reps, "set_hash", "left").join(named, "rep", "left")
            .withColumn("component_id", F.when(
                F.col("n_shingles") > 0, F.coalesce("component_id", "rep")).otherwise(F.col("doc_id")))
            .select("doc_id", "n_shingles",
                    F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"),
                    F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept")))


def drop_near_copies(docs: DataFrame, *, id_column: str = "doc_id",
                     text_column: str = "text") -> DataFrame:
    """The documents with all their columns, of each group the one of smallest id."""
    groups = near_groups(docs, id_column=id_column, text_column=text_column)
    # Only ids of copies go through the join's other side, under a name that the documents don't have.
    name = free_name("copy", docs.columns)
    copies = groups.where("not kept").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(copies, F.col(id_column).cast("long") == F.col(name), "left_anti")
