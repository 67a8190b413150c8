"""Connected components of edge tables: union-find on the edges that a task has, then alternating stars (Kiveris et al., 2014)."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from strandloom.llm.rows import released
from strandloom.llm.scratch import Scratch

#: Edges that a task contracts at once; a node of text may take 100 bytes.
BATCH = 1 << 18
#: Nodes with over 1 / HOT of all ends of edges, and HOT_LEAST ends at least, are hot: there are under HOT of them.
HOT, HOT_LEAST = 4096, 1024


def contract(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, root) of a forest of stars with the components of edges (a, b): root is the least node of each."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while len(i):
        least = np.minimum(root[i], root[j])
        np.minimum.at(root, root[i], least)
        np.minimum.at(root, root[j], least)
        while (root != (up := root[root])).any():
            root = up
        open_ = root[i] != root[j]
        i, j = i[open_], j[open_]
    some = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[some], nodes[root[some]]


def _contracted(edges: DataFrame) -> DataFrame:
    """Edges (a, b) with the same components as edges: each task's, some at a time, as stars. So a node has an edge a task, about."""
    kind = edges.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        into = to_arrow_schema(kind)
        held: list[pa.RecordBatch] = []

        def out() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            found = contract(*(c.to_numpy(zero_copy_only=False) for c in t.columns))
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(found, into, strict=True)], schema=into)

        for b in batches:
            if held and sum(x.num_rows for x in held) + b.num_rows > BATCH:
                yield out()
            held.append(b)
        if held:
            yield out()

    return edges.mapInArrow(released(run), kind)


def _met(edges: DataFrame, least: DataFrame, bound: int) -> DataFrame:
    """edges with their a's row of least, one a node, in which n is how many ends it has here.

    Rows of nodes with more than bound ends stay where they are and meet a broadcast of under 2 * HOT rows; the others are
    dealt by node.
    """
    hot = F.broadcast(least.where(F.col("n") > bound).select("node", "m"))
    on = F.col("a") == F.col("node")
    cold = edges.join(hot, on, "left_anti").join(least.where(F.col("n") <= bound).select("node", "m"), on)
    return edges.join(hot, on).unionByName(cold)


def _star(edges: DataFrame, large: bool, bound: int) -> DataFrame:
    """One step over edges (a, b) with a > b.

    large: each node's larger neighbours get its least neighbour. small: its smaller neighbours, and itself, do.
    """
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select(F.col("a").alias("node"), F.least("a", "m").alias("m"), "n")
        out = _met(both.where("b > a"), least, bound).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select(F.col("a").alias("node"), "m", "n")
        out = _met(edges, least, bound).select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("node").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b")


def components(edges: DataFrame, scratch: Scratch, name: str, most_rounds: int = 60) -> DataFrame:
    """(node, component) for each node of edges (a, b): component is the least node it is linked with.

    Only nodes that have an edge to another come out; edges with a null end are none. First each task contracts the edges
    it has, so a node with very many keeps about one a task. Up to BATCH edges that are left are one task's, which contracts
    them to the result. Of more, each round writes its edges to the shared folder, which ends their lineage, and counts the
    nodes at which they aren't stars yet; nothing else comes to the driver. Rounds grow with the logarithm of the nodes
    squared at worst and are a handful for the star-like groups that duplicates form.
    """
    now = scratch.keep(_contracted(edges.where("a <> b").select("a", "b")), f"{name}-0")
    for k in range(1, most_rounds + 1):
        count = now.count()
        if count <= BATCH:
            now = scratch.keep(_contracted(now.coalesce(1)), f"{name}-{k}")
            scratch.drop(f"{name}-{k - 1}")
        if count <= BATCH or not _unsettled(now):
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        bound = max(HOT_LEAST, 2 * count // HOT)
        step = scratch.keep(_star(now, large=True, bound=bound), f"{name}-large-{k}")
        now = scratch.keep(_contracted(_star(step, large=False, bound=bound)).distinct(), f"{name}-{k}")
        scratch.drop(f"{name}-{k - 1}")
        scratch.drop(f"{name}-large-{k}")
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def _unsettled(edges: DataFrame) -> int:
    """Nodes at which edges aren't stars: in stars each node has one edge to its root, and roots have none."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    ends = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return ends.where("up > 1 OR up = 1 AND down = 1").count()
