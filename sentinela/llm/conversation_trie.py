"""Conversation prefix trie with balanced rollup by centroid decomposition (operator 12).

Every conversation is a path of turns from a textless root; equal beginnings share their nodes. A
node is named by its smallest member and its depth. Beginnings are told apart by 128 bits, an
exclusive or of two hashes of each turn's place and SHA-256, which is a running sum like any other
and so does not need a conversation's turns in one task.

Totals of all subtrees come from a centroid decomposition of the forest of parent edges:

1. In each component (the whole trie at first) the nodes whose subtree holds more than half of it
   form the path from the component's top to its centroid, the deepest of them.
2. The total of the centroid's subtree within the component is added to every node of that path.
3. The component falls into what is above the centroid and a component for each of its children.

A pair of node and descendant is so counted once, at the centroid that first lies between
them, and a component halves each round, however deep the trie is. Components of more than
``LOCAL_NODES`` nodes are split by joins; a node's ancestor at a depth is looked up through its
member's path. Smaller ones are finished in the tasks, by the same rounds over arrays.

The number of nodes below each node, which tells the centroids, is one grouped count: a
conversation adds to each node of its path those nodes that it is the smallest member of.

Edge cases: rows without a conversation id belong to no conversation; turns that tie come by role and
text, repeated rows are repeated turns; a null role or text is empty; a conversation may end up
without turns and then is a member of the root alone; an empty table has no nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sentinela.llm.common import key_runs, stored

GROUP = 100                 # conversations that may share the head of the first of them
MOST_HEAD = 6               # a head has fewer turns than this
LOCAL_NODES = 20_000        # nodes of a component that one task finishes
SEGMENT = 1024              # turns of a conversation summed in one task
ID_BITS = 12                # ids of 2 ** ID_BITS neighbours are joined to text at once


def ordered_turns(turns: DataFrame, *, conv_column: str, turn_column: str, role_column: str,
                  text_column: str) -> DataFrame:
    """(conv, rank, digest, chars): the turns of each conversation, ranked from 1.

    Sorted by range, so that one conversation may lie in several partitions; a turn's rank is its
    place in its partition after the conversation's turns in the partitions before.
    """
    role = F.coalesce(F.col(role_column).cast("string"), F.lit(""))
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    # The role's length keeps role and text apart.
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    rows = turns.where(F.col(conv_column).isNotNull()).select(
        F.col(conv_column).cast("long").alias("conv"), F.col(turn_column).cast("long").alias("turn"),
        role.alias("role"), text.alias("text"), F.unhex(F.sha2(whole, 256)).alias("digest"),
        F.length(text).cast("long").alias("chars"))
    place = F.monotonically_increasing_id()
    sorted_ = stored(rows.orderBy("conv", F.col("turn").asc_nulls_first(), "role", "text").select(
        "conv", "digest", "chars", place.alias("place"), F.shiftright(place, 33).alias("part")), "trie-turns")
    parts = sorted_.groupBy("conv", "part").agg(F.count("*").alias("n"))
    before = parts.select("conv", "part", (
        F.sum("n").over(Window.partitionBy("conv").orderBy("part")) - F.col("n")).alias("before"))
    within = Window.partitionBy("conv", "part").orderBy("place")
    return sorted_.withColumn("within", F.row_number().over(within)).join(before, ["conv", "part"]).select(
        "conv", (F.col("before") + F.col("within")).alias("rank"), "digest", "chars")


def rebuilt_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations (conv, length) and their turns (conv, depth, digest, chars) after rebuilding.

    A conversation begins with the first turns of the first one of its group of ``GROUP``, as
    many as a checksum of its id says, and goes on with its own after as many.
    """
    head = F.crc32(F.col("conv").cast("string")) % MOST_HEAD
    own = turns.groupBy("conv").agg(F.count("*").alias("own")).select(
        "conv", "own", head.alias("head"), (F.col("conv") - F.col("conv") % GROUP).alias("base"))
    first = own.select(F.col("conv").alias("base"), F.col("own").alias("base_turns"))
    convs = stored(own.join(first, "base", "left").select(
        "conv", "base", "head", F.least("head", F.coalesce("base_turns", F.lit(0))).alias("shared"),
        F.greatest(F.lit(0), F.col("own") - F.col("head")).alias("rest")), "trie-convs")
    heads = turns.where(f"rank < {MOST_HEAD} and conv % {GROUP} = 0").withColumnRenamed("conv", "base")
    begins = convs.join(heads, "base").where("rank <= head").select(
        "conv", F.col("rank").alias("depth"), "digest", "chars")
    ends = turns.join(convs, "conv").where("rank > head").select(
        "conv", (F.col("rank") - F.col("head") + F.col("shared")).alias("depth"), "digest", "chars")
    return convs.select("conv", (F.col("shared") + F.col("rest")).alias("length")), begins.unionByName(ends)


def prefixes(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """(conv, depth, x, y, chars): every beginning of every conversation, from depth 0, with its hashes."""
    rows = turns.withColumns({
        "x": F.xxhash64(F.lit(1), "depth", "digest"), "y": F.xxhash64(F.lit(2), "depth", "digest"),
        "segment": F.floor(F.col("depth") / SEGMENT)})
    totals = rows.groupBy("conv", "segment").agg(F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"))
    up_to = Window.partitionBy("conv").orderBy("segment")
    # Taking a segment's own value out again leaves what the segments before have.
    before = totals.select("conv", "segment", *[
        F.bit_xor(c).over(up_to).bitwiseXOR(F.col(c)).alias(f"{c}_before") for c in ("x", "y")])
    within = Window.partitionBy("conv", "segment").orderBy("depth")
    run = rows.withColumns({c: F.bit_xor(c).over(within) for c in ("x", "y")}).join(
        before, ["conv", "segment"])
    zero = F.lit(0).cast("long")
    roots = convs.select("conv", zero.alias("depth"), zero.alias("x"), zero.alias("y"), zero.alias("chars"))
    return roots.unionByName(run.select(
        "conv", F.col("depth").cast("long"), F.col("x").bitwiseXOR(F.col("x_before")).alias("x"),
        F.col("y").bitwiseXOR(F.col("y_before")).alias("y"), "chars"))


def paths_and_nodes(convs: DataFrame, turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Paths (conv, depth, node, parent): the smallest member of each beginning and of the one before.

    Nodes (node, depth, parent, n_convs, n_children, chars, size): ``size`` counts the subtree's nodes.
    """
    found = stored(prefixes(convs, turns), "trie-prefixes")
    # Stored, so that the join may split a beginning that very many conversations have.
    nodes = stored(found.groupBy("depth", "x", "y").agg(
        F.min("conv").alias("node"), F.count("*").alias("n_convs"), F.first("chars").alias("chars")),
        "trie-named")
    # The root has all conversations and needs no join.
    root = nodes.where("depth = 0").first()
    first = F.lit(root.node if root else None).cast("long")
    every = F.lit(root.n_convs if root else None).cast("long")
    roots = found.where("depth = 0").select("conv", "depth", first.alias("node"), every.alias("n_convs"), "chars")
    steps = stored(roots.unionByName(
        found.where("depth > 0").select("conv", "depth", "x", "y").join(nodes, ["depth", "x", "y"]).select(
            "conv", "depth", "node", "n_convs", "chars")), "trie-steps")
    above = steps.select("conv", (F.col("depth") + 1).alias("depth"), F.col("node").alias("parent"))
    paths = stored(steps.join(above, ["conv", "depth"], "left"), "trie-paths")

    # The nodes that a conversation is the smallest member of are the last ones of its path.
    own = paths.where("node = conv").groupBy("conv").agg(F.min("depth").alias("first"))
    ends = stored(convs.join(own, "conv"), "trie-ends")
    adds = F.greatest(F.lit(0), F.col("length") - F.greatest("first", "depth") + 1)
    sizes = paths.join(ends, "conv").groupBy("node", "depth").agg(F.sum(adds).alias("size"))
    children = paths.where("node = conv and depth > 0").groupBy(
        F.col("parent").alias("node"), (F.col("depth") - 1).alias("depth")).agg(
        F.count("*").alias("n_children"))
    nodes = paths.where("node = conv").drop("conv").join(sizes, ["node", "depth"]).join(
        children, ["node", "depth"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    return paths.select("conv", "depth", "node", "parent"), stored(nodes, "trie-nodes")


def ends_digests(convs: DataFrame, paths: DataFrame) -> DataFrame:
    """(node, depth, ends_sha256): SHA-256 of the ids that end at each node, ascending.

    Neighbouring ids are joined to texts first, so that a task that digests a node of very many
    members streams a few texts and holds one.
    """
    last = convs.select("conv", F.col("length").alias("depth")).join(paths, ["conv", "depth"])
    texts = last.groupBy("node", "depth", F.shiftright("conv", ID_BITS).alias("part")).agg(F.array_join(
        F.array_sort(F.collect_list("conv")).cast("array<string>"), ",").alias("ids"))

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, out = None, None, []
        for batch in batches:
            for node, depth, ids in zip(*(batch.column(c).to_pylist() for c in ("node", "depth", "ids"))):
                if (node, depth) != now:
                    if now:
                        out.append((*now, state.hexdigest()))
                    now, state = (node, depth), hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield rows(out)
            out = []
        if now:
            yield rows([(*now, state.hexdigest())])

    def rows(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out)) or [()] * 3
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string()))],
            ["node", "depth", "ends_sha256"])

    return texts.repartition("node", "depth").sortWithinPartitions("node", "depth", "part").select(
        "node", "depth", "ids").mapInArrow(digested, "node long, depth long, ends_sha256 string")


VALUES = ["n_leaves", "saved_tokens"]
STATE = ["node", "depth", "parent", "top", "top_depth", "size", *VALUES, *(f"all_{v}" for v in VALUES)]


def subtree_totals(nodes: DataFrame, paths: DataFrame, local_nodes: int = LOCAL_NODES) -> DataFrame:
    """(node, depth, all_*): each of ``VALUES`` summed over the node's subtree.

    ``nodes`` has node, depth, parent, size and the values, ``paths`` the node of each conversation at
    each depth. A component is named by its top.
    """
    root = nodes.where("depth = 0").first()
    zero = F.lit(0).cast("long")
    state = nodes.withColumns({"top": F.lit(root.node if root else 0).cast("long"), "top_depth": zero}).select(
        *STATE[:-len(VALUES)], *[zero.alias(f"all_{v}") for v in VALUES])
    live, done, small = stored(state, "trie-live"), [], []
    while True:
        big = live.groupBy("top", "top_depth").agg(F.count("*").alias("total")).where(
            f"total > {local_nodes}")
        if big.isEmpty():
            small.append(live)
            break
        marked = stored(live.join(big, ["top", "top_depth"], "left"), "trie-marked")
        small.append(marked.where("total is null").select(*STATE))
        split, removed = _split(marked.where("total is not null"), paths)
        done.append(removed)
        live = split
    finished = _finished(_union(small))
    names = ["node", "depth", *(f"all_{v}" for v in VALUES)]
    return _union([finished.select(*names), *(d.select(*names) for d in done)])


def _union(parts: list[DataFrame]) -> DataFrame:
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def _split(rows: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One round over large components: what remains of them, and their centroids, now finished."""
    key = ["top", "top_depth"]
    # Nodes with more than half of their component below them are one path; its end is the centroid.
    centres = rows.where("2 * size > total").groupBy(*key).agg(
        F.max_by(F.struct("node", "depth", "size"), "depth").alias("c")).select(
        *key, F.col("c.node").alias("c_node"), F.col("c.depth").alias("c_depth"), F.col("c.size").alias("c_size"))
    known = rows.join(centres, key)
    # Of nodes deep enough, the ancestor just below the centroid's depth.
    at = paths.select(F.col("conv").alias("node"), F.col("depth").alias("child_depth"),
                      F.col("node").alias("child"), F.col("parent").alias("child_parent"))
    deep = known.where("depth > c_depth").withColumn("child_depth", F.col("c_depth") + 1).join(
        at, ["node", "child_depth"]).withColumn("inside", F.col("child_parent") == F.col("c_node"))
    rest = known.where("depth <= c_depth").withColumn("inside", F.lit(False))
    below = stored(deep.unionByName(rest, allowMissingColumns=True).withColumn(
        "is_centre", (F.col("depth") == F.col("c_depth")) & (F.col("node") == F.col("c_node"))), "trie-split")
    totals = below.where("inside or is_centre").groupBy(*key).agg(
        *[F.sum(v).alias(f"sum_{v}") for v in VALUES])
    on_path = F.expr("2 * size > total")
    after = below.join(totals, key).withColumns({
        **{f"all_{v}": F.col(f"all_{v}") + F.when(on_path, F.col(f"sum_{v}")).otherwise(0) for v in VALUES},
        "size": F.col("size") - F.when(on_path & ~F.col("is_centre"), F.col("c_size")).otherwise(0),
        "top": F.when(F.col("inside"), F.col("child")).otherwise(F.col("top")),
        "top_depth": F.when(F.col("inside"), F.col("child_depth")).otherwise(F.col("top_depth"))})
    after = stored(after.select(*STATE, "is_centre"), "trie-after")
    return after.where("not is_centre").select(*STATE), after.where("is_centre").select(*STATE)


def _finished(rows: DataFrame) -> DataFrame:
    """All further rounds of components that fit into a task."""
    key = ["top", "top_depth"]

    def worked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows_held = [], 0
        for component in key_runs(batches, key):
            held.append(component)
            rows_held += component.num_rows
            if rows_held >= LOCAL_NODES:
                yield totals(pa.concat_tables(held))
                held, rows_held = [], 0
        if held:
            yield totals(pa.concat_tables(held))

    def totals(table: pa.Table) -> pa.RecordBatch:
        column = {c: table.column(c).to_numpy() for c in STATE if c != "parent"}
        column["parent"] = table.column("parent").fill_null(0).to_numpy()
        values = np.stack([column[v] for v in VALUES], 1)
        more = component_totals(*(column[c] for c in ("node", "depth", "parent", "size")),
                                np.stack([column[c] for c in key], 1), values)
        return pa.RecordBatch.from_arrays(
            [pa.array(column["node"]), pa.array(column["depth"]),
             *[pa.array(column[f"all_{v}"] + more[:, k]) for k, v in enumerate(VALUES)]],
            ["node", "depth", *(f"all_{v}" for v in VALUES)])

    schema = ", ".join(["node long", "depth long", *(f"all_{v} long" for v in VALUES)])
    return rows.repartition(*key).sortWithinPartitions(*key, "depth", "node").select(*STATE).mapInArrow(
        worked, schema)


def component_totals(node: np.ndarray, depth: np.ndarray, parent: np.ndarray, size: np.ndarray,
                     top: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of the values over every node's subtree within its component, by centroid rounds.

    Rows of a component are in order of depth, its top (node, depth) first; ``size`` counts a
    node's subtree within it. All components are worked off together.
    """
    n = len(node)
    begins = np.concatenate([[True], (top[1:] != top[:-1]).any(1)])
    comp = np.flatnonzero(begins)[np.cumsum(begins) - 1]        # the row of each row's top
    is_top = comp == np.arange(n)
    # Rows of the parents: nodes of a component and depth are in order of their names.
    place = np.lexsort((node, depth, comp))
    names = {k: int(r) for k, r in zip(zip(comp[place].tolist(), depth[place].tolist(), node[place].tolist()),
                                       place.tolist())}
    up = np.array([-1 if t else names[c, d - 1, p] for t, c, d, p in zip(
        is_top.tolist(), comp.tolist(), depth.tolist(), parent.tolist())], np.int64)
    enter = _preorder(comp, depth, up, size)
    leave = enter + size
    size, comp, out = size.copy(), comp.copy(), np.zeros_like(values)
    live, finished = np.arange(n), np.zeros(n, bool)
    while len(live):
        path = live[2 * size[live] > size[comp[live]]]
        path = path[np.argsort(depth[path], kind="stable")]
        centre = np.full(n, -1)
        centre[comp[path]] = path                               # the deepest of a path is written last
        of = centre[comp[live]]
        inside = (enter[of] <= enter[live]) & (enter[live] < leave[of])
        below = live[inside]
        total = np.zeros_like(values)
        np.add.at(total, comp[below], values[below])
        out[path] += total[comp[path]]
        centres = centre[comp[path]]
        shrunk = path != centres
        taken = size[centres]
        size[path[shrunk]] -= taken[shrunk]
        # The centroid's children are tops; of a component, each row's top is the last one before it.
        own = centre[comp[below]]
        below, own = below[below != own], own[below != own]
        heads = below[up[below] == own]
        heads = heads[np.lexsort((enter[heads], comp[heads]))]
        if len(heads):
            code = comp.astype(np.int64) * (n + 1)
            last = np.searchsorted(code[heads] + enter[heads], code[below] + enter[below], "right") - 1
            comp[below] = heads[last]
        finished[centres] = True
        live = live[~finished[live]]
    return out


def _preorder(comp: np.ndarray, depth: np.ndarray, up: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Numbers of the rows such that a subtree of k nodes has k numbers from its top's on."""
    enter = np.zeros(len(comp), np.int64)
    tops = np.flatnonzero(up < 0)
    enter[tops] = np.concatenate([[0], np.cumsum(size[tops])[:-1]])
    rest = np.flatnonzero(up >= 0)
    rest = rest[np.lexsort((rest, up[rest], depth[rest]))]
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(depth[rest])) + 1, [len(rest)]])
    for start, end in zip(cuts[:-1], cuts[1:]):
        level = rest[start:end]
        if not len(level):
            continue
        before = np.cumsum(size[level]) - size[level]
        first = np.concatenate([[True], up[level][1:] != up[level][:-1]])
        own = before[first][np.cumsum(first) - 1]
        enter[level] = enter[up[level]] + 1 + before - own
    return enter


def conversation_trie(turns: DataFrame, *, conv_column: str = "conv_id", turn_column: str = "turn",
                      role_column: str = "role", text_column: str = "text",
                      local_nodes: int = LOCAL_NODES) -> tuple[DataFrame, DataFrame]:
    """The nodes of the trie, and the node of every rebuilt conversation at every depth.

    Nodes: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.
    Paths: ``conv, depth, node, parent``, node and parent by their smallest members.
    """
    ranked = stored(ordered_turns(turns, conv_column=conv_column, turn_column=turn_column,
                                  role_column=role_column, text_column=text_column), "trie-ranked")
    convs, rebuilt = rebuilt_turns(ranked)
    convs = stored(convs, "trie-lengths")
    paths, nodes = paths_and_nodes(convs, rebuilt)
    valued = nodes.select(
        "node", "depth", "parent", "size", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("n_leaves"),
        ((F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens"))
    totals = subtree_totals(valued, paths, local_nodes)
    key = ["node", "depth"]
    empty = hashlib.sha256(b"").hexdigest()
    return nodes.join(totals, key).join(ends_digests(convs, paths), key, "left").select(
        F.col("node").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs",
        "n_children", F.col("all_n_leaves").alias("n_leaves"), F.col("all_saved_tokens").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256")), paths
