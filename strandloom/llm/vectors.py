"""Embedding near-duplicates: tiles of vectors in the order of principal axes, compared leading axes first."""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from strandloom.llm.graph import components
from strandloom.llm.rows import map_rows
from strandloom.llm.scratch import Scratch

#: Vectors of a tile, about; a task compares a tile with another. A vector moves once for each tile that it meets.
TILE = 1024
#: Pairs whose products are gathered at once.
PAIRS = 1 << 15
#: Axes after which products are bounded and pairs given up.
STAGES = (8, 24)
#: Lengths of vectors that get principal axes: the most frequent ones, of so many components at most. Others keep their own
#: axes, which is right but slower.
LENGTHS, LONGEST = 4, 512
#: Slack of bounds against rounding; pairs that pass are measured on the vectors themselves.
SLACK = 1e-9


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows at length 1, in double precision, scaled first so that squares don't run over."""
    v = vectors.astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _measure() -> Callable[..., Iterator[tuple]]:
    import xxhash

    def f(row_id: int, vec_id: int | None, label: object, vector: list | None) -> Iterator[tuple]:
        digest, length = None, 0
        if label is not None and vector and None not in vector:
            v = np.array(vector, np.float64) + 0.0  # -0.0 becomes 0.0
            if np.isfinite(v).all() and v.any():
                digest, length = xxhash.xxh3_128_digest(v.tobytes()), len(v)
        yield row_id, vec_id, label, digest, length, vector if digest else None

    return f


def _axes(nodes: DataFrame) -> dict[int, np.ndarray]:
    """Principal axes, by falling variance, for the most frequent lengths of vectors.

    Sums of products are made for each batch, and added up by Spark for each entry of the matrix: what comes to the
    driver is length * length numbers a length, 2^20 in all at most, whatever the number of vectors.
    """
    lengths = [r["length"] for r in nodes.where(F.col("length") <= LONGEST).groupBy("length").count().orderBy(F.desc("count"), "length").limit(LENGTHS).collect()]
    shape = _parse_datatype_string("length int, entry int, value double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            size = b.column(0).to_numpy()
            for n in np.unique(size).tolist():
                rows = np.flatnonzero(size == n)
                u = unit(b.column(1).take(pa.array(rows)).flatten().to_numpy().reshape(len(rows), n))
                sums[n] = sums.get(n, 0) + u.T @ u
        for n, m in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n * n, n, np.int32)), pa.array(np.arange(n * n, dtype=np.int32)), pa.array(m.ravel())], schema=to_arrow_schema(shape))

    found = nodes.where(F.col("length").isin(lengths)).select("length", "vector").mapInArrow(run, shape) if lengths else None
    out = {n: np.zeros((n, n)) for n in lengths}
    for r in found.groupBy("length", "entry").agg(F.sum("value").alias("value")).collect() if lengths else []:
        out[r["length"]].flat[r["entry"]] = r["value"]
    return {n: np.linalg.eigh((m + m.T) / 2)[1][:, ::-1] for n, m in out.items()}


def linked(a: np.ndarray, b: np.ndarray, axes: np.ndarray | None, threshold: float) -> np.ndarray:
    """Which rows of a and b, at length 1, have a cosine of threshold or more: a matrix of truth values.

    Products add up along the leading axes first. What the remaining axes can add is at most the product of the norms
    that remain; pairs that can't reach the threshold so are given up. The others are measured on the rows themselves, some
    at a time, so that a pair's cosine comes out the same whatever tiles it is in.
    """
    ya, yb = (a, b) if axes is None else (a @ axes, b @ axes)
    out = np.zeros((len(a), len(b)), bool)
    rest = lambda y, k: np.sqrt(np.maximum((y[:, k:] ** 2).sum(axis=1), 0.0))
    first = min(STAGES[0], a.shape[1])
    product = ya[:, :first] @ yb[:, :first].T
    i, j = np.nonzero(product + np.outer(rest(ya, first), rest(yb, first)) >= threshold - SLACK)
    rests = {k: (rest(ya, k), rest(yb, k)) for k in STAGES[1:] if k < a.shape[1]}
    for at in range(0, len(i), PAIRS):
        p, q = i[at : at + PAIRS], j[at : at + PAIRS]
        part = product[p, q]
        for last, k in zip((first, *STAGES[1:]), STAGES[1:], strict=False):
            if k >= a.shape[1]:
                break
            part = part + np.einsum("nd,nd->n", ya[p, last:k], yb[q, last:k])
            near = part + rests[k][0][p] * rests[k][1][q] >= threshold - SLACK
            p, q, part = p[near], q[near], part[near]
        exact = np.einsum("nd,nd->n", a[p], b[q]) >= threshold
        out[p[exact], q[exact]] = True
    return out


def _forest(links: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of the linked group of each row and each column."""
    rows, columns = np.full(len(links), -1), np.full(links.shape[1], -1)
    for k in range(len(links)):
        if rows[k] < 0:
            rows[k] = k
            todo = [k]
            while todo:
                reached = np.flatnonzero(links[todo].any(axis=0) & (columns < 0))
                columns[reached] = k
                todo = np.flatnonzero(links[:, reached].any(axis=1) & (rows < 0)).tolist() if len(reached) else []
                rows[todo] = k
    return rows, columns


def groups(embeddings: DataFrame, threshold: float = 0.98, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label") -> DataFrame:
    """One row a vector: vec_id, n_links, component_id, kept.

    Vectors link if their labels are equal, their lengths too, and their cosine is threshold or more. Null, empty and
    zero vectors, those with null or non-finite components, and those without a label link with nothing. Rows that repeat
    an id are vectors of their own; n_links counts rows. Null ids don't name a component unless it has no other: then its
    component_id is null, and it is kept. Other columns aren't read.

    1. Equal vectors of a label become one node with a count, summed before they move.
    2. Cosines of threshold or more lie within sqrt(2 - 2 * threshold) on any axis. So nodes are dealt by label into slabs
       of that width along the first principal axis, and compared within slabs and with the next one.
    3. Slabs are cut into tiles of about 1024 nodes by hash; a pair of tiles is a task's work. A label or slab with many
       nodes makes many pairs of tiles, none larger.
    4. A pair of tiles returns a row for each of its nodes with links: their number, and a node of the linked group.
    """
    scratch = Scratch(embeddings.sparkSession, "vectors")
    field = lambda c: embeddings.schema[c].dataType.simpleString()
    numbered = embeddings.select(F.col(f"`{id_column}`").alias("vec_id"), F.col(f"`{label_column}`").alias("label"), F.col(f"`{vector_column}`").alias("vector")).withColumn("row_id", F.monotonically_increasing_id())
    measured = map_rows(numbered, ["row_id", "vec_id", "label", "vector"], f"row_id bigint, vec_id {field(id_column)}, label {field(label_column)}, digest binary, length int, vector {field(vector_column)}", _measure)
    rows = scratch.keep(measured, "rows")
    nodes = rows.where("digest IS NOT NULL").groupBy("label", "length", "digest").agg(F.min("row_id").alias("node"), F.count("*").alias("copies"), F.min("vec_id").alias("least"), F.min_by("vector", "row_id").alias("vector"))
    nodes = scratch.keep(nodes, "nodes")
    axes = _axes(nodes)
    found = scratch.keep(_compared(nodes, axes, threshold, scratch), "found")
    linked_to = found.groupBy("node").agg(F.sum("links").alias("links")).withColumnRenamed("node", "linked_node")
    joined = components(found.select(F.col("node").alias("a"), F.col("other").alias("b")), scratch, "links").withColumnRenamed("node", "member")
    of_node = nodes.select("label", "length", "digest", "node", "copies", "least").join(linked_to, F.col("node") == F.col("linked_node"), "left").join(joined, F.col("node") == F.col("member"), "left")
    of_node = scratch.keep(of_node.select("label", "length", "digest", "copies", "least", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "node").alias("component")), "of_node")
    scratch.only("rows", "of_node")
    least = of_node.groupBy("component").agg(F.min("least").alias("component_id")).withColumnRenamed("component", "named")
    of_node = of_node.join(least, F.col("component") == F.col("named")).select(
        F.col("label").alias("l"), F.col("length").alias("n"), F.col("digest").alias("d"), (F.col("links") + F.col("copies") - 1).alias("n_links"), "component_id")
    return rows.join(of_node, (F.col("label") == F.col("l")) & (F.col("length") == F.col("n")) & (F.col("digest") == F.col("d")), "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce(F.coalesce("component_id", "vec_id") == F.col("vec_id"), F.col("vec_id").isNull() & F.col("component_id").isNull()).alias("kept"))


def _compared(nodes: DataFrame, axes: dict[int, np.ndarray], threshold: float, scratch: Scratch) -> DataFrame:
    """(node, links, other): links of a node in a pair of tiles, copies counted, and one node of its linked group there."""
    width = float(np.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-6)
    first = {n: v[:, 0].copy() for n, v in axes.items()}
    kinds = {f.name: f.dataType.simpleString() for f in nodes.schema.fields}
    shape = _parse_datatype_string(f"node bigint, copies bigint, label {kinds['label']}, length int, vector {kinds['vector']}, slab int")

    def slabs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, slab = b.column(3).to_numpy(), np.zeros(b.num_rows, np.int32)
            for n in np.unique(size).tolist():
                rows = np.flatnonzero(size == n)
                u = unit(b.column(4).take(pa.array(rows)).flatten().to_numpy().reshape(len(rows), n))
                slab[rows] = np.floor((u @ first[n] if n in first else u[:, 0]) / width)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(slab)], schema=to_arrow_schema(shape))

    placed = scratch.keep(nodes.select("node", "copies", "label", "length", "vector").mapInArrow(slabs, shape), "slabs")
    tiles = placed.groupBy("label", "length", "slab").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))
    tiles = scratch.keep(tiles, "tiles")
    key = lambda prefix, shift: tiles.select(F.col("label").alias(f"{prefix}_l"), F.col("length").alias(f"{prefix}_n"), (F.col("slab") + shift).alias(f"{prefix}_s"), F.col("tiles").alias(prefix))
    on = lambda p: (F.col("label") == F.col(f"{p}_l")) & (F.col("length") == F.col(f"{p}_n")) & (F.col("slab") == F.col(f"{p}_s"))
    around = scratch.keep(tiles.join(key("below", 1), on("below"), "left").join(key("above", -1), on("above"), "left").select(
        F.col("label").alias("own_l"), F.col("length").alias("own_n"), F.col("slab").alias("own_s"), "tiles", F.coalesce("below", F.lit(0)).alias("below"), F.coalesce("above", F.lit(0)).alias("above")), "around")
    dealt = placed.join(around, on("own")).withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    # side: 1 left, 2 right, 3 both
    pairs = F.expr("""concat(
        transform(sequence(0, tiles - 1), k -> named_struct('s', slab, 'next', 0, 'x', least(tile, k), 'y', greatest(tile, k), 'side', CASE WHEN k = tile THEN 3 WHEN tile < k THEN 1 ELSE 2 END)),
        CASE WHEN above > 0 THEN transform(sequence(0, above - 1), k -> named_struct('s', slab, 'next', 1, 'x', tile, 'y', k, 'side', 1)) ELSE CAST(array() AS array<struct<s: int, next: int, x: int, y: int, side: int>>) END,
        CASE WHEN below > 0 THEN transform(sequence(0, below - 1), k -> named_struct('s', slab - 1, 'next', 1, 'x', k, 'y', tile, 'side', 2)) ELSE CAST(array() AS array<struct<s: int, next: int, x: int, y: int, side: int>>) END)""")
    dealt = dealt.withColumn("p", F.explode(pairs)).select("label", "length", "p.s", "p.next", "p.x", "p.y", "p.side", "node", "copies", "vector")
    result = _parse_datatype_string("node bigint, links bigint, other bigint")

    def compare(table: pa.Table) -> pa.Table:
        n = table.column("length")[0].as_py()
        side, node, copies = (table.column(c).to_numpy() for c in ("side", "node", "copies"))
        u = unit(table.column("vector").combine_chunks().flatten().to_numpy().reshape(len(node), n))
        left, right = np.flatnonzero(side & 1), np.flatnonzero(side & 2)
        links = linked(u[left], u[right], axes.get(n), threshold)
        if len(left) and side[left[0]] == 3:
            links = links | links.T
            np.fill_diagonal(links, False)
            group = _forest(links | np.eye(len(links), dtype=bool))[0]
            total, of, at = links @ copies[right], node[left], node[left[group]]
        else:
            rows, columns = _forest(links)
            total = np.concatenate([links @ copies[right], links.T @ copies[left]])
            of, at = np.concatenate([node[left], node[right]]), node[left[np.concatenate([rows, np.maximum(columns, 0)])]] if len(left) else node[right]
        some = total > 0
        return pa.Table.from_arrays([pa.array(x[some].astype(np.int64)) for x in (of, total, at)], schema=to_arrow_schema(result))

    return dealt.groupBy("label", "length", "s", "next", "x", "y").applyInArrow(compare, result)
