"""Mixing sources to target weights: hash-random keys, a range sort within each source, distributed prefix sums, exact cuts."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.llm.rows import WORD
from strandloom.llm.scratch import Scratch

#: Keys have 60 bits; a range is the key's leading bits: 10, or as many as make about as many ranges of a source as rows of one.
KEY_BITS, RANGE_BITS, MOST_RANGE_BITS = 60, 10, 24
#: Sources that one task orders.
ONE_TASK = 1 << 17
#: Parts of a source where its rows meet its cut in a shuffle, so that a source with many rows takes many tasks.
SALTS = 32


def _order(id_column: str, seed: str) -> F.Column:
    """A hash-random key: the first 60 bits of an MD5 of seed and id. Rows without an id share the key of ''."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(F.col(id_column).cast("string"), F.lit("")))), 1, 15), 16, 10).cast("long")


def _sized(docs: DataFrame, id_column: str, text_column: str, source_column: str, seed: str) -> DataFrame:
    return docs.select(
        F.col(f"`{id_column}`").alias("doc_id"), F.col(f"`{source_column}`").cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col(f"`{text_column}`"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
    ).withColumn("key", _order("doc_id", seed))


def _running(table: DataFrame, order: list[F.Column], sums: list[str], scratch: Scratch, name: str) -> DataFrame:
    """table with place, from 0 in an order without ties, and for each of sums <column>_before: the sum over the rows before.

    Up to ONE_TASK rows are one task's. More are dealt by ranges of the order, whose counts and sums, a row a range, add up
    first.
    """
    upto = Window.unboundedPreceding, -1
    before = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0).cast(table.schema[c].dataType if c in table.columns else "long")).alias(f"{c}_before")
    if table.count() <= ONE_TASK:
        w = Window.orderBy(*order)
        return table.select("*", (F.row_number().over(w) - 1).cast("long").alias("place"), *[before(c, w.rowsBetween(*upto)) for c in sums])
    dealt = table.repartitionByRange(max(1, int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *order).withColumn("part", F.spark_partition_id())
    dealt = scratch.keep(dealt, name)
    parts = dealt.groupBy("part").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in sums])
    w = Window.orderBy("part").rowsBetween(*upto)
    base = parts.select(F.col("part").alias("of_part"), F.coalesce(F.sum("n").over(w), F.lit(0)).alias("n_base"), *[F.coalesce(F.sum(c).over(w), F.lit(0)).alias(f"{c}_base") for c in sums])
    w = Window.partitionBy("part").orderBy(*order)
    out = dealt.join(F.broadcast(base), F.col("part") == F.col("of_part"))
    out = out.select("*", (F.row_number().over(w) - 1 + F.col("n_base")).alias("place"), *[before(c, w.rowsBetween(*upto)) for c in sums])
    return out.select(*table.columns, "place", *[(F.col(f"{c}_before") + F.col(f"{c}_base")).alias(f"{c}_before") for c in sums])


def targets(sizes: DataFrame, scratch: Scratch, weights: tuple[float, ...] = (5, 2, 1), most: float = 3.0) -> DataFrame:
    """Of (source, source_size): rank by code point with null last, weight, and target.

    All sources share the sum of sizes by weight; none gets over most times its size, and the excess is shared again by
    weight. That is target = min(most * size, weight * level) at one level, found in one pass over the sources in the
    order of most * size / weight: a source is full when the level that remains for it and those after it reaches it.
    The driver gets two sums and that level.
    """
    sizes = scratch.keep(sizes, "sizes")
    ranked = _running(sizes, [F.col("source").asc_nulls_last()], [], scratch, "by-name").withColumn("rank", F.col("place") + 1).drop("place")
    ranked = ranked.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int")))
    ranked = scratch.keep(ranked.withColumn("full", F.lit(float(most)) * F.col("source_size")).withColumn("ratio", F.col("full") / F.col("weight")), "ranked")
    total, everyone = ranked.agg(F.sum("source_size").cast("double"), F.sum("weight")).first()
    leveled = _running(ranked, [F.col("ratio"), F.col("rank")], ["full", "weight"], scratch, "by-ratio")
    leveled = leveled.withColumn("level", (F.lit(total) - F.col("full_before")) / (F.lit(everyone) - F.col("weight_before")))
    # the lowest of the levels at sources that they don't fill is the one at the first of them
    first = leveled.where("level < ratio").agg(F.min(F.struct("ratio", "rank", "level"))["level"]).first()[0]
    at = F.lit(first).cast("double")
    return ranked.select("source", "source_size", "rank", "weight", F.when(at.isNull() | (F.col("ratio") <= at), F.col("full")).otherwise(F.col("weight") * at).alias("target"))


def _cuts(sized: DataFrame, weights: tuple[float, ...], most: float, scratch: Scratch) -> DataFrame:
    """For each source: whole epochs, the words of the last, part epoch, and the (key, size) group in which that ends.

    Sums go up from rows to (source, range) and from there to a source's ranges, whose prefix sums find the range with the
    cut. Only that range's rows are sorted. There are about as many ranges as a range has rows, so neither is much for a
    task: 2^18 with 2^36 rows.
    """
    bits = min(MOST_RANGE_BITS, max(RANGE_BITS, sized.count().bit_length() // 2))
    at_range = F.shiftright("key", KEY_BITS - bits).cast("int")
    ranges = scratch.keep(sized.withColumn("range", at_range).groupBy("source", "range").agg(F.sum("size").alias("words")), "ranges")
    plan = targets(ranges.groupBy("source").agg(F.sum("words").alias("source_size")), scratch, weights, most)
    plan = plan.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    plan = plan.withColumn("rest", F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long"))
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("before", F.coalesce(F.sum("words").over(before), F.lit(0)))
    plan_of = plan.withColumnRenamed("source", "plan_source")
    cut = ranges.join(plan_of, F.col("source").eqNullSafe(F.col("plan_source"))).where((F.col("before") < F.col("rest")) & (F.col("rest") <= F.col("before") + F.col("words")))
    cut = cut.select(F.col("source").alias("cut_source"), F.col("range").alias("cut_range"), "before", "rest")
    rows = sized.withColumn("range", at_range).join(cut, F.col("source").eqNullSafe(F.col("cut_source")) & (F.col("range") == F.col("cut_range")))
    # rows that share key and size stand and fall together, so the order among them has no say
    groups = rows.groupBy("source", "key", "size", "before", "rest").agg(F.count("*").alias("n"))
    reach = Window.partitionBy("source").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.withColumn("left", F.col("rest") - F.col("before") - F.coalesce(F.sum(F.col("size") * F.col("n")).over(reach), F.lit(0)))
    groups = groups.where((F.col("left") > 0) & (F.col("left") <= F.col("size") * F.col("n")))
    groups = groups.select(F.col("source").alias("cut_source"), F.col("key").alias("cut_key"), F.col("size").alias("cut_size"), F.expr("left div n").alias("part"))
    return plan_of.join(groups, F.col("plan_source").eqNullSafe(F.col("cut_source")), "left").select(
        "plan_source", "source_size", "target", "epochs", "cut_key", "cut_size", F.coalesce("part", F.lit(0)).alias("part"))


def _with_cuts(rows: DataFrame, cuts: DataFrame, scratch: Scratch) -> DataFrame:
    """rows with source and key, and their source's cut.

    The cuts are written first: so Spark knows their size, and broadcasts them if that is small, without which rows are
    dealt by source and a salt.
    """
    cuts = scratch.keep(cuts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), "cuts")
    scratch.only("sized", "cuts")
    return rows.join(cuts, F.col("source").eqNullSafe(F.col("plan_source")) & (F.pmod(F.col("key"), F.lit(SALTS)).cast("int") == F.col("salt")))


def _last_epoch(key: str, size: str) -> F.Column:
    """Words of a row that its source's last, part epoch takes."""
    here = F.struct(F.col(key), F.col(size))
    cut = F.struct(F.col("cut_key").alias(key), F.col("cut_size").alias(size))
    return F.when(F.col("cut_key").isNull(), F.lit(0)).when(here < cut, F.col(size)).when(here == cut, F.col("part")).otherwise(0).cast("long")


def mix(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", weights: tuple[float, ...] = (5, 2, 1), most: float = 3.0, seed: str = "mix") -> DataFrame:
    """One row a document: doc_id, size, source_size, target, taken (words of it in the mix, repeats counted), source, key.

    Null texts and texts without words have size 0 and nothing taken. A null source is a source of its own, last in the
    order. Rows that repeat an id and size share a key; where the cut falls among n such rows each gives the same part,
    and up to n - 1 words stay out. Null ids share one key. An empty table gives no rows. Other columns aren't read.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    sized = scratch.keep(_sized(docs, id_column, text_column, source_column, seed), "sized")
    return _with_cuts(sized, _cuts(sized, weights, most, scratch), scratch).select(
        "doc_id", "size", "source_size", "target", (F.col("epochs") * F.col("size") + _last_epoch("key", "size")).alias("taken"), "source", "key")


def mix_documents(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", weights: tuple[float, ...] = (5, 2, 1), most: float = 3.0, seed: str = "mix") -> DataFrame:
    """The mix itself: rows of docs with all their columns, each as often as the mix takes it, whole.

    As mix() decides, but the document in which a source's budget ends goes in whole if half of it or more was to be
    taken, else not at all. Documents without words count as taken in each whole epoch, once at least where their source
    gets no whole epoch but they come before the cut. Texts never move: rows meet only their source's cut.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    cuts = _cuts(scratch.keep(_sized(docs, id_column, text_column, source_column, seed), "sized"), weights, most, scratch)
    names = docs.columns
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"))
    inner = inner.select(
        "row", F.col("row")[source_column].cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col("row")[text_column], F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.col("row")[id_column].alias("doc_id"),
    ).withColumn("key", _order("doc_id", seed))
    joined = _with_cuts(inner, cuts, scratch)
    part = _last_epoch("key", "size")
    here = F.struct("key", "size") < F.struct(F.col("cut_key").alias("key"), F.col("cut_size").alias("size"))
    more = F.when(F.col("size") == 0, F.coalesce(here, F.lit(False))).otherwise(2 * part >= F.col("size"))
    # a source without words has no epochs; its documents stay as they are
    times = F.when(F.col("source_size") == 0, 1).otherwise(F.col("epochs") + more.cast("long"))
    return joined.select("row", F.explode(F.array_repeat(F.lit(0), times.cast("int"))).alias("copy")).select("row.*")
