"""Best-fit packing: hierarchical residual packing (operator 4).

Partitions pack their pieces by themselves, longest first and each into the fullest
sequence that has room. Nearly full sequences are done. Underfull ones go on as single items
to a tree of fewer and fewer tasks, where best fit is repeated, up to one root.

A node keeps two integers per item. The number of nodes of a level follows the items left, so
that a node holds about ``NODE_ITEMS`` at most; where sizes do not fit together (all just over
half a sequence) the tree ends early, as further rounds could not join them either.

Edge cases: a null or empty text is the closing id alone; equal ids give pieces of their own;
an empty table gives none; lengths of 1 to the capacity are packed, others are an error.
"""

from __future__ import annotations

import base64
import math
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sentinela.llm.common import slices, stored

CAPACITY = 1024
CLOSING_ID = 2
# A sequence with less room than this share is done.
NEARLY_FULL = 0.01
FAN_IN = 8
NODE_ITEMS = 500_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_WIDE = regex.compile(r"[԰-\U0010ffff]")


@lru_cache(maxsize=1)
def _library(path: str) -> Tokenizer:
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


@lru_cache(maxsize=1)
def _ranks(path: str, pattern: str) -> tiktoken.Encoding:
    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_ids(text: str | None, tokenizer: str, ranks: tuple[str, str] | None) -> list[int]:
    """Ids as the tokenizers library gives them.

    ``ranks`` may name a file with the same vocabulary as ranks and its pattern; ordinary texts
    then take that faster way. Texts with special tokens, other scripts or of great length don't.
    """
    if not text:
        return []
    if ranks and len(text) < 200_000 and "<|" not in text and not _WIDE.search(text):
        return _ranks(*ranks).encode_ordinary(text)
    return _library(tokenizer).encode(text, add_special_tokens=False).ids


def cut_documents(docs: DataFrame, tokenizer: str, *, ranks: tuple[str, str] | None = None,
                  capacity: int = CAPACITY, closing: int = CLOSING_ID, with_ids: bool = False,
                  id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Pieces of at most ``capacity`` tokens; a document's first piece takes the remainder."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            rows = []
            for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                ids = np.array([*token_ids(text, tokenizer, ranks), closing], "<u4")
                first = len(ids) % capacity or capacity
                starts = [0, *range(first, len(ids), capacity)]
                for piece, (start, end) in enumerate(zip(starts, [*starts[1:], len(ids)])):
                    own = ids[start:end]
                    rows.append((key, piece, start, end - start, zlib.crc32(own.tobytes()))
                                + ((own.astype(np.int32),) if with_ids else ()))
            columns = list(zip(*rows)) or [()] * len(schema)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()),
                        ("length", pa.int64()), ("ids_crc32", pa.int64())]
                       + [("ids", pa.list_(pa.int32()))] * with_ids)
    return docs.select(F.col(id_column).cast("long").alias("doc_id"),
                       F.col(text_column).cast("string").alias("text")
                       ).mapInArrow(cut, PIECES + ", ids array<int>" * with_ids)


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each item and the fill of each bin; longest items first.

    Bins are kept by the room they have left, and a bit per room says whether there are any,
    so that the fullest bin with enough room is found at once.
    """
    bins = np.empty(len(lengths), np.int64)
    offsets = np.empty(len(lengths), np.int64)
    fill: list[int] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0
    for item in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[item])
        if not 0 < length <= capacity:
            raise ValueError(f"a length of {length} does not fit into {capacity}")
        fitting = rooms >> length
        if fitting:
            room = length + (fitting & -fitting).bit_length() - 1
            own = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, own = capacity, len(fill)
            fill.append(0)
        bins[item], offsets[item] = own, fill[own]
        fill[own] += length
        if left := room - length:
            by_room[left].append(own)
            rooms |= 1 << left
    return bins, offsets, np.array(fill, np.int64)


def _pack_partitions(items: DataFrame, level: int, capacity: int) -> DataFrame:
    """Add ``bin``, ``at`` and ``fill``: the item's bin in its partition, its place, the bin's fill."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        lengths = np.concatenate([b.column("length").to_numpy() for b in held])
        bins, offsets, fill = best_fit(lengths, capacity)
        first = level << 56 | TaskContext.get().partitionId() << 32
        at = 0
        for batch in held:
            own = slice(at, at := at + batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(bins[own] + first), pa.array(offsets[own]),
                 pa.array(fill[bins[own]])], [*batch.schema.names, "bin", "at", "fill"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema)
    return items.mapInArrow(packed, f"{kinds}, bin long, at long, fill long")


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows with a ``length``.

    The rows must be narrow: a task holds those of its partition. Columns of the rows that have
    the names of the two that are added give way to them.
    """
    kept = [c for c in pieces.columns if c.lower() not in ("sequence_id", "offset")]
    # Whatever further columns are called, only the length goes under its own name.
    others = F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row")
    items = pieces.select(others, F.col("length").cast("long").alias("length"))
    local = stored(_pack_partitions(items, 0, capacity), "packing")
    names = [F.col(f"row.`{c}`") for c in kept]
    done = math.ceil(capacity * (1 - NEARLY_FULL))
    left = local.where(f"at = 0 and fill < {done}").select("bin", F.col("fill").alias("length"))
    nodes = local.rdd.getNumPartitions()
    moved = None                        # bin of level 0 -> the sequence it is now part of
    for level in range(1, 100):
        count = left.count()
        before, nodes = nodes, max(1, math.ceil(nodes / FAN_IN), math.ceil(count / NODE_ITEMS))
        if not count or (level > 1 and nodes >= before):
            break
        items = left.select(F.col("bin").alias("item"), "length").repartition(nodes, "item")
        # In order, so that a repeated task gives the same bins.
        round_ = stored(_pack_partitions(items.sortWithinPartitions("item"), level, capacity),
                        "packing")
        step = round_.select("item", "bin", "at")
        if moved is None:
            moved = step.withColumnRenamed("item", "base")
        else:
            old, new = moved.alias("old"), step.alias("new")
            moved = old.join(new, F.col("old.bin") == F.col("new.item"), "left").select(
                "old.base", F.coalesce("new.bin", "old.bin").alias("bin"),
                (F.col("old.at") + F.coalesce("new.at", F.lit(0))).alias("at"))
        left = round_.where(f"at = 0 and fill < {done}").select("bin", F.col("fill").alias("length"))
        if nodes == 1:
            break
    if moved is None:
        return local.select(*names, F.col("bin").alias("sequence_id"), F.col("at").alias("offset"))
    moved = moved.select(F.col("base").alias("bin"), F.col("bin").alias("_top"),
                         F.col("at").alias("_base"))
    return local.join(moved, "bin", "left").select(
        *names, F.coalesce("_top", "bin").alias("sequence_id"),
        (F.col("at") + F.coalesce("_base", F.lit(0))).alias("offset"))
