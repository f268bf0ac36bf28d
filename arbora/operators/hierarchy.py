"""Parent-child rows to full hierarchies: paths, depths, roots, descendants and cycles."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from arbora.storage import materialize

#: Ids of one tree that meet in one row. A tree with more is spread over several, so none has to fit into one task.
BLOCK_NODES = 65_536
#: Elements of paths in one output batch.
BATCH_PATH = 1 << 20


@dataclass
class Hierarchy:
    """``reached``: tree, node, depth (root 0), root, path (own row first, root last), up (of a root with a parent that is not stored).
    ``endless``: tree, node, place (``on`` a circle or ``below`` one)."""

    reached: DataFrame
    endless: DataFrame


def block_of(node: Column) -> Column:
    return F.floor(node / F.lit(BLOCK_NODES)).cast("bigint")


def frontier_levels(parent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Depth and root of every node, by joining each level's frontier to its children until no child is left; depth -1 where no root leads to it.

    ``parent`` is the place of the parent, -1 for a root.
    """
    n = len(parent)
    children = np.argsort(parent, kind="stable")
    bounds = np.searchsorted(parent[children], np.arange(n + 1))
    depth, root = np.full(n, -1), np.full(n, -1)
    frontier = np.flatnonzero(parent < 0)
    depth[frontier], root[frontier] = 0, frontier
    while len(frontier):
        first, count = bounds[frontier], bounds[frontier + 1] - bounds[frontier]
        above = np.repeat(frontier, count)
        nth = np.arange(len(above)) - np.repeat(np.cumsum(count) - count, count)
        below = children[np.repeat(first, count) + nth]
        depth[below], root[below] = depth[above] + 1, root[above]
        frontier = below
    return depth, root


def on_circles(parent: np.ndarray, unreached: np.ndarray) -> np.ndarray:
    """Which of the unreached nodes lie on a circle: nodes without unreached children are peeled off, level by level."""
    on = unreached.copy()
    waiting = np.bincount(parent[unreached], minlength=len(parent))
    leaves = np.flatnonzero(on & (waiting == 0))
    while len(leaves):
        on[leaves] = False
        np.subtract.at(waiting, parent[leaves], 1)
        up = np.unique(parent[leaves])
        leaves = up[on[up] & (waiting[up] == 0)]
    return on


def path_places(parent: np.ndarray, depth: np.ndarray, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
    """Offsets, and the places of the path from each of the nodes a .. b - 1 to its root, itself first."""
    length = depth[a:b] + 1
    offsets = np.concatenate([[0], np.cumsum(length)])
    places = np.empty(offsets[-1], np.int64)
    at, step = np.flatnonzero(length), 0
    spot = at + a
    while len(at):
        places[offsets[at] + step] = spot
        step += 1
        longer = length[at] > step
        at, spot = at[longer], parent[spot[longer]]
    return offsets, places


def _stored(rows: DataFrame, tree: str, node: str, parent: Column, payload: Column) -> DataFrame:
    placed = rows.select(F.col(tree).alias("tree"), F.col(node).alias("node"), parent.alias("up"), payload.alias("own"))
    return placed.filter("tree is not null and node is not null").withColumn("block", block_of(F.col("node")))


def _in_blocks(stored: DataFrame, with_paths: bool) -> DataFrame:
    """Resolves each block of a tree by itself: (tree, node, kind, depth, root, up, path).

    ``kind`` is ``reached``, ``on``, ``below``, or ``port`` where the way leaves the block: depth,
    root and path then end at the node whose parent lies in another block.
    """
    fields = {f.name: f.dataType for f in stored.schema}
    out = T.StructType(
        [T.StructField("tree", fields["tree"]), T.StructField("node", fields["node"]), T.StructField("kind", T.StringType()), T.StructField("depth", T.IntegerType()),
         T.StructField("root", fields["node"]), T.StructField("up", fields["up"]), T.StructField("path", T.ArrayType(fields["own"]))]
    )
    blocks = stored.groupBy("tree", "block").agg(F.sort_array(F.collect_set(F.struct("node", "up", "own"))).alias("nodes"))
    schema = to_arrow_schema(out)
    size = BLOCK_NODES

    def resolve_batch(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        lists = batch.column("nodes")
        own_rows = lists.flatten()
        row = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
        node, up = own_rows.field("node"), own_rows.field("up")
        ids = node.to_numpy(zero_copy_only=False).astype(np.int64)
        once = np.flatnonzero((np.diff(row, prepend=-1) != 0) | (np.diff(ids, prepend=-1) != 0))  # rows of one node stand together, the smallest first
        row, ids, node, up, own = row[once], ids[once], node.take(pa.array(once)), up.take(pa.array(once)), own_rows.field("own").take(pa.array(once))
        has_up = np.asarray(up.is_valid())
        up_ids = up.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        block = batch.column("block").to_numpy()[row]
        key, wanted = row * size + ids % size, row * size + up_ids % size
        inside = has_up & (up_ids // size == block)
        at = np.minimum(np.searchsorted(key, wanted), max(0, len(key) - 1))
        parent = np.where(inside & (key[at] == wanted), at, -1) if len(key) else np.zeros(0, np.int64)
        depth, root = frontier_levels(parent)
        unreached = depth < 0
        kind = np.where(has_up[root] & ~inside[root], "port", "reached")
        kind[unreached] = "below"
        kind[on_circles(parent, unreached)] = "on"
        # a parent that is not stored is told for the root that misses it
        told = pa.array(~((root == np.arange(len(root))) & has_up))
        steps = np.cumsum(np.maximum(depth, 0) + 1)
        cuts = [0, *np.flatnonzero(np.diff(steps // BATCH_PATH)) + 1, len(row)]
        for a, b in zip(cuts, cuts[1:]):
            if with_paths:
                offsets, places = path_places(parent, depth, a, b)
                path = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), own.take(pa.array(places)))
            else:
                path = pa.nulls(b - a, schema.field("path").type)
            nothing = pa.array(unreached[a:b])
            yield pa.RecordBatch.from_arrays(
                [batch.column("tree").take(pa.array(row[a:b])), node.slice(a, b - a), pa.array(kind[a:b], pa.string()), pa.array(depth[a:b], pa.int32(), mask=unreached[a:b]),
                 pc.if_else(nothing, pa.scalar(None, node.type), node.take(pa.array(np.maximum(root[a:b], 0)))),
                 pc.if_else(told.slice(a, b - a), pa.scalar(None, up.type), up.slice(a, b - a)), path.cast(schema.field("path").type)],
                schema=schema,
            )

    def resolve_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from resolve_batch(batch)

    return blocks.mapInArrow(resolve_all, out)


def resolve(rows: DataFrame, tree: str, node: str, parent: Column, payload: Column | None = None) -> Hierarchy:
    """Follow parents from every node of a forest of unknown depth.

    Rows meet once, by tree and by block of BLOCK_NODES ids (``node`` is an integer), repeated rows
    pre-aggregated before. There frontier joins go from the roots (no parent, or one that is not
    stored) level by level, extending depth, root and path, until a frontier is empty, however
    deep that is. What no frontier reaches is endless; peeling off nodes without unreached
    children, level by level, parts ``below`` from ``on``.

    A tree that spans several blocks goes on with the nodes whose parent lies in another block:
    they are joined to what their parent found, and again level by level until a frontier is empty, so the
    number of joins is that of the blocks that a way crosses.

    Repeated rows count once (of rows that differ the smallest (parent, payload) is kept). Rows
    with a null tree or node cannot be placed and are left out. Without ``payload`` paths are
    null. An empty table gives empty results.
    """
    stored = _stored(rows, tree, node, parent, F.lit(None).cast("int") if payload is None else payload)
    local = _in_blocks(stored, payload is not None)
    reached = lambda df: df.filter("kind = 'reached'").select("tree", "node", "depth", "root", "path", "up")
    endless = lambda df: df.filter("kind in ('on', 'below')").select("tree", "node", F.col("kind").alias("place"))
    if stored.filter(block_of(F.col("up")) != F.col("block")).isEmpty():
        return Hierarchy(reached(local), endless(local))

    local = materialize(local, "blocks")
    again = lambda: _in_blocks(_stored(rows, tree, node, parent, F.struct(F.col(node).alias("node"))), True)
    ports, circle = _across_blocks(local, again)
    joined = local.filter("kind = 'port'").withColumnRenamed("root", "port").join(ports, ["tree", "port"])
    through = joined.filter("above is not null").select(
        "tree", "node", (F.col("depth") + F.col("above.depth")).alias("depth"), F.col("above.root").alias("root"),
        F.concat("path", "above.path").alias("path"), F.when((F.col("node") == F.col("port")) & (F.col("above.depth") == 0), F.col("up")).alias("up"),
    )
    lost = joined.filter("above is null").select("tree", "node").join(circle, ["tree", "node"], "left")
    lost = lost.select("tree", "node", F.coalesce("place", F.lit("below")).alias("place"))
    return Hierarchy(reached(local).unionByName(through), endless(local).unionByName(lost))


def _across_blocks(local: DataFrame, again) -> tuple[DataFrame, DataFrame]:
    """(tree, port, above) with what lies above each port as (depth, root, path), null where its way never ends; and the nodes on circles through several blocks."""
    ports = local.filter("kind = 'port' and node = root").select("tree", F.col("node").alias("port"), "up")
    seen = local.select("tree", F.col("node").alias("up"), F.struct("kind", "depth", "root", "path").alias("u"))
    linked = materialize(ports.join(seen, ["tree", "up"], "left"), "ports")
    above = lambda depth, root, path: F.struct(depth.cast("int").alias("depth"), root.alias("root"), path.alias("path"))
    no_path = F.array().cast(local.schema["path"].dataType)
    # a parent that is not stored anywhere makes the port a root
    own_root = linked.filter("u is null").select("tree", "port", above(F.lit(0), F.col("port"), no_path).alias("above"))
    known = linked.filter("u.kind = 'reached'").select("tree", "port", above(F.col("u.depth") + 1, F.col("u.root"), F.col("u.path")).alias("above"))
    waiting = linked.filter("u.kind = 'port'").select("tree", "port", F.col("u.root").alias("next"), (F.col("u.depth") + 1).alias("steps"), F.col("u.path").alias("way"))
    frontier = materialize(own_root.unionByName(known), "frontier")
    found = [frontier]
    while not frontier.isEmpty():
        level = materialize(waiting.join(frontier.select("tree", F.col("port").alias("next"), "above"), ["tree", "next"], "left"), "level")
        frontier = level.filter("above is not null").select("tree", "port", above(F.col("steps") + F.col("above.depth"), F.col("above.root"), F.concat("way", "above.path")).alias("above"))
        waiting = level.filter("above is null").select("tree", "port", "next", "steps", "way")
        found.append(frontier)
    rest = materialize(waiting.select("tree", "port", "next"), "unreached")
    lost = rest.select("tree", "port").unionByName(linked.filter("u.kind in ('on', 'below')").select("tree", "port"))
    # peel off ports that no other unreached port runs into
    n = -1
    while n != (n := rest.count()):
        rest = materialize(rest.join(rest.select("tree", F.col("next").alias("port")).distinct(), ["tree", "port"], "left_semi").select("tree", "port", "next"), "circle")
    entries = rest.join(linked.select("tree", "port", "up"), ["tree", "port"]).select("tree", F.col("up").alias("node")).distinct()
    circle = local.select("tree", "node").limit(0).withColumn("place", F.lit("on"))
    if n:
        ways = again().join(entries, ["tree", "node"], "left_semi")
        circle = materialize(ways.select("tree", F.explode("path.node").alias("node")).distinct().withColumn("place", F.lit("on")), "on")
    results = reduce(DataFrame.unionByName, found)
    return results.unionByName(lost.withColumn("above", F.lit(None).cast(results.schema["above"].dataType))), circle


def ancestor_pairs(reached: DataFrame) -> DataFrame:
    """(tree, ancestor, node, distance) for every node and every row of its path above it.

    The path's elements must have the field ``node``. Descendants of a node are its rows
    here: they stay rows, so that no large tree has to fit into one value.
    """
    return reached.select("tree", "node", F.posexplode("path").alias("distance", "p")).filter("distance > 0").select(
        "tree", F.col("p.node").alias("ancestor"), "node", "distance"
    )
