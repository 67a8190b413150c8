"""How filters interact: what each order of them removes at each step, from counts by mask of failed filters.

A document fails a set of filters whatever their order, so counts by (part, mask) say all about every order. The orders
are walked by swaps of neighbours: a swap changes what those two steps remove, and nothing else.
"""

from collections.abc import Iterator, Sequence
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

#: Filters by letter, as conditions that a document fails under, of columns text, words and code points; E is FIRST's.
WORDS = r"filter(split(text, '[\\x20\\x09-\\x0D]+'), w -> w <> '')"
CONDITIONS = {
    "A": "size(words) < 100",
    "B": "100L * size(array_distinct(words)) < 80L * size(words)",
    "C": "100L * regexp_count(text, '[A-Z]') > 10L * length(text)",
    "D": "text rlike '[#$%&*|]'",
}
#: The filter that a document fails if one of a smaller id has the same text.
FIRST = "E"
#: More filters have too many orders: nine would be 362,880.
MOST_FILTERS = 8
#: Parts whose orders are walked at once.
PARTS = 128
COLUMNS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def swaps(n: int) -> Iterator[int]:
    """Places k at which to swap items k and k + 1, one after another, so that all orders of n items come up once each.

    The last item goes through the others, down and up by turns; at each end these make one swap of their own.
    """
    if n < 2:
        return
    down = True
    for own in (*swaps(n - 1), None):
        yield from range(n - 2, -1, -1) if down else range(n - 1)
        if own is not None:
            yield own + down
        down = not down


def walk(cells: np.ndarray, letters: str) -> Iterator[tuple[str, np.ndarray]]:
    """All orders of letters, and for each what its steps remove, as an array (part, measure, step), which the next one changes.

    cells: an array (part, measure, mask) of counts; bit k of a mask is the k-th letter's.
    """

    @cache
    def removed(k: int, before: int) -> np.ndarray:
        return cells[:, :, [m for m in range(cells.shape[2]) if m >> k & 1 and not m & before]].sum(axis=2)

    order = list(range(len(letters)))
    steps = np.zeros((*cells.shape[:2], len(order)), np.int64)
    for at, k in enumerate(order):
        steps[:, :, at] = removed(k, (1 << at) - 1)
    yield letters, steps
    for at in swaps(len(order)):
        before = sum(1 << k for k in order[:at])
        order[at], order[at + 1] = order[at + 1], order[at]
        steps[:, :, at] = removed(order[at], before)
        steps[:, :, at + 1] = removed(order[at + 1], before | 1 << order[at])
        yield "".join(letters[k] for k in order), steps


def masks(docs: DataFrame, conditions: dict[str, str] | None = None, part_column: str = "lang", id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, part, mask (of the conditions, in their order) and the text's SHA-256. Texts themselves go no further."""
    given = docs.select(F.col(f"`{id_column}`").alias("doc_id"), F.coalesce(F.col(f"`{part_column}`").cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(f"`{text_column}`").cast("string"), F.lit("")).alias("text"))
    given = given.withColumn("words", F.expr(WORDS))
    bits = [F.expr(c).cast("int") * (1 << k) for k, c in enumerate((conditions or CONDITIONS).values())]
    mask: Column = F.lit(0)
    for b in bits:
        mask = mask + b
    return given.select("doc_id", "part", mask.alias("mask"), F.unhex(F.sha2("text", 256)).alias("digest"))


def cells(docs: DataFrame, labels: DataFrame, conditions: dict[str, str] | None = None, part_column: str = "lang", id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(part, mask, n, good, toxic): counts of documents, and of those labelled quality=1 and toxic=1. The last bit is FIRST's.

    Labels meet documents by id, those of an id that has several count if one does; ids that are null meet none and are
    dealt out by digest. Equal texts come together by digest, as counts: a task's copies of a text are one row for each
    part, mask and label. So a text that a third of all documents have is a few rows for each task.
    """
    conditions = conditions or CONDITIONS
    marked = masks(docs, conditions, part_column, id_column, text_column).withColumn("deal", F.when(F.col("doc_id").isNull(), F.xxhash64("digest", "part")).otherwise(0))
    one = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)))
    known = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id"), F.lit(0).cast("bigint").alias("deal")).agg(one("quality").alias("good"), one("toxic").alias("toxic"))
    rows = marked.join(known, ["doc_id", "deal"], "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
    keys = ["digest", "part", "mask", "good", "toxic"]
    # rows of an id lie together already
    rows = rows.groupBy("doc_id", "deal", *keys).agg(F.count("*").alias("n"))
    named = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))
    texts = rows.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("unnamed"), F.min(named).alias("least"))
    # a text has a row for each of its parts and labels here
    texts = texts.withColumn("first", F.min("least.doc_id").over(Window.partitionBy("digest")))
    fresh = F.col("unnamed") + F.when(F.col("least.doc_id") == F.col("first"), F.col("least.n")).otherwise(0)
    texts = texts.withColumn("fresh", fresh).select("part", "good", "toxic", F.inline(F.array(
        F.struct("mask", F.col("fresh").alias("n")), F.struct((F.col("mask") + (1 << len(conditions))).alias("mask"), (F.col("n") - F.col("fresh")).alias("n")))))
    return texts.groupBy("part", "mask").agg(F.sum("n").alias("n"), *[F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(c) for c in ("good", "toxic")])


def orders(counts: DataFrame, letters: str) -> DataFrame:
    """A row for each part, order of filters and step, out of counts as cells() gives them.

    kept after the step, removed by it, redundant: failing its filter, but removed before; unique_fails: failing no other
    filter; good_lost, toxic_lost: removed by it of those so labelled; shapley: what its filter removes, summed over all
    orders. Parts without documents have no rows.
    """
    if not 0 < len(set(letters)) == len(letters) <= MOST_FILTERS:
        raise ValueError(f"one to {MOST_FILTERS} different filters")
    width = 1 << len(letters)
    shape = _parse_datatype_string("part string, filter_order string, step int, " + ", ".join(f"{c} bigint" for c in COLUMNS))
    # 2^filters counts a part at most
    found = counts.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("mask", F.array("n", "good", "toxic")))).alias("m"))
    rows = found.select("part", F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda k: F.coalesce(F.col("m")[k], F.array(*[F.lit(0).cast("bigint")] * 3))).alias("cells"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        into = to_arrow_schema(shape)
        for batch in batches:
            for at in range(0, batch.num_rows, PARTS):
                b = batch.slice(at, PARTS)
                table = np.array(b.column(1).to_pylist(), np.int64).reshape(b.num_rows, width, 3).transpose(0, 2, 1)
                yield from _of_parts(b.column(0), table, letters, into)

    return rows.mapInArrow(run, shape)


def _of_parts(parts: pa.Array, table: np.ndarray, letters: str, into: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows of orders() for some parts: a batch an order, once all are walked."""
    n, total = len(letters), table[:, 0].sum(axis=1)
    fails = np.stack([table[:, 0, [m for m in range(1 << n) if m >> k & 1]].sum(axis=1) for k in range(n)], axis=1)
    alone = table[:, 0, [1 << k for k in range(n)]]
    shapley = np.zeros((len(parts), n), np.int64)
    seen: list[tuple[str, np.ndarray]] = []
    for order, steps in walk(table, letters):
        shapley[:, [letters.index(c) for c in order]] += steps[:, 0]
        seen.append((order, steps.copy()))
    names = pa.DictionaryArray.from_arrays(np.repeat(np.arange(len(parts), dtype=np.int32), n), parts).cast(pa.string())
    for order, steps in seen:
        own = [letters.index(c) for c in order]
        values = (total[:, None] - steps[:, 0].cumsum(axis=1), steps[:, 0], fails[:, own] - steps[:, 0], alone[:, own], steps[:, 1], steps[:, 2], shapley[:, own])
        columns = [names, pa.array([order] * len(names)), pa.array(np.tile(np.arange(1, n + 1, dtype=np.int32), len(parts))), *(pa.array(np.ascontiguousarray(v).ravel()) for v in values)]
        yield pa.RecordBatch.from_arrays(columns, schema=into)


def audit(docs: DataFrame, labels: DataFrame, part_column: str = "lang", id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """orders() of the five filters over documents.

    A null text is empty, a null part the empty string. A row without an id neither fails E nor makes others fail it; rows
    that repeat an id fail E if a smaller id has their text. Labels without a row in docs, or null, count nothing. An empty
    table gives no rows. Words of one text are in memory at a time. Other columns aren't read. Texts are the same if their
    SHA-256 is.
    """
    return orders(cells(docs, labels, None, part_column, id_column, text_column), "".join(CONDITIONS) + FIRST)
