"""Misalignment thresholds: how far adapters are from reads of the other strand."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sample(reads: DataFrame, n: int = 100_000, id_column: str = "id") -> DataFrame:
    """About n reads to calibrate on, all if there are no more: those whose ids hash low, the same ones every time.

    Sampling is the feature: distances settle long before. Reads stay in their tasks; a sort or limit would bring them
    together in one.
    """
    total = reads.count()
    if total <= n:
        return reads
    return reads.where(F.pmod(F.xxhash64(id_column), F.lit(1 << 30)) < int((1 << 30) * n / total))


def _all_zero(names: list[str]) -> Column:
    """Whether the rows of the named adapters, of which there is one at least, all have distance 0."""
    return F.coalesce(F.bool_and(F.when(F.col("query_id").isin(names), F.col("best_edit_distance") == 0)), F.lit(False))


def perfect_ids(stats: DataFrame, names: list[str]) -> DataFrame:
    """Ids of reads on which all of the named adapters, as far as they have rows, have distance 0."""
    return stats.groupBy("id").agg(_all_zero(names).alias("perfect")).where("perfect").select("id")


def _others(stats: DataFrame, forward: list[str], reverse: list[str]) -> DataFrame:
    """Rows of reverse adapters on reads with perfect forward ones, and the other way round.

    A read's rows, a few, come together once, so stats, which may be an alignment, is made once.
    """
    named = stats.where(F.col("id").isNotNull() & F.col("query_id").isin(forward + reverse))
    reads = named.groupBy("id").agg(_all_zero(forward).alias("f"), _all_zero(reverse).alias("r"), F.collect_list(F.struct(*[F.col(f"`{c}`") for c in stats.columns])).alias("rows"))
    wanted = lambda x: (F.col("f") & x["query_id"].isin(reverse)) | (F.col("r") & x["query_id"].isin(forward))
    return reads.where("f OR r").select(F.explode(F.filter("rows", wanted)).alias("row")).select("row.*")


def calibrate(stats: DataFrame, forward: list[str], reverse: list[str], mode: str | None = "stats") -> DataFrame:
    """mode stats: query_id, null_distance (mean) and sd_null (sample deviation). graphics: the rows they are made of."""
    if mode not in ("stats", "graphics"):
        raise ValueError("mode is stats or graphics")
    rows = _others(stats, forward, reverse)
    if mode == "graphics":
        return rows
    return rows.groupBy("query_id").agg(F.avg("best_edit_distance").alias("null_distance"), F.stddev_samp("best_edit_distance").alias("sd_null"))


def lower_bounds(null: DataFrame) -> DataFrame:
    """query_id and lower_bound: the mean less the deviation rounded up, rounded down. Null where the deviation is."""
    return null.select("query_id", F.floor(F.col("null_distance") - F.ceil("sd_null")).cast("double").alias("lower_bound"))


def error_bounds(stats: DataFrame, forward: list[str], reverse: list[str]) -> DataFrame:
    """Older bounds: of reads perfect on one strand and without any perfect adapter of the other, mean + sd up and mean - sd down."""
    zero = F.col("best_edit_distance") == 0
    flags = stats.groupBy("id").agg(*[F.bool_and(F.when(F.col("query_id").isin(n), zero)).alias(f"all_{k}") for k, n in (("f", forward), ("r", reverse))], *[F.bool_and(F.when(F.col("query_id").isin(n), ~zero)).alias(f"none_{k}") for k, n in (("f", forward), ("r", reverse))])
    side = lambda own, other, names: stats.where(F.col("query_id").isin(names)).join(flags.where(f"all_{own} AND none_{other}").select("id"), "id", "left_semi")
    rows = side("f", "r", reverse).unionByName(side("r", "f", forward))
    m, s = F.avg("best_edit_distance"), F.stddev_samp("best_edit_distance")
    return rows.groupBy("query_id").agg(F.ceil(m + s).alias("upper"), F.floor(m - s).alias("lower"))


def collected(null: DataFrame) -> dict[str, tuple[float, float | None]]:
    """The means and deviations, one row an adapter, for plans."""
    return {r["query_id"]: (r["null_distance"], r["sd_null"]) for r in null.collect()}


def bounds_of(null: dict[str, tuple[float, float | None]]) -> dict[str, float]:
    import math

    return {k: float(math.floor(m - math.ceil(s))) for k, (m, s) in null.items() if s is not None and s == s}


def wide(stats: DataFrame, names: list[str]) -> DataFrame:
    """One row a read: for each adapter <name>_dist and <name>_pos."""
    return stats.groupBy("id").pivot("query_id", names).agg(F.first("best_edit_distance").alias("dist"), F.first("best_start_pos").alias("pos"))


def wide_locations(found: DataFrame, names: list[str]) -> DataFrame:
    """One row a read of locations(): for each adapter <name>_dist and <name>_pos, its starts and stops, each value once, where it comes last."""
    places = F.concat("starts", "stops")
    rows = found.select("id", "query_id", "distance", F.reverse(F.array_distinct(F.reverse(places))).alias("places"))
    return rows.groupBy("id").pivot("query_id", names).agg(F.first("distance").alias("dist"), F.first("places").alias("pos"))


def batches(wide: DataFrame, bounds: dict[str, float]) -> DataFrame:
    """wide_locations() with batch: the older categories, by primers' distances and lower bounds.

    The reverse strand's distance is held against the forward primer's bound, as it always was. Reads of one strand whose
    primer has several places are parallel concatenates.
    """
    d = {n: F.col(f"{n}_dist") for n in ("forw_primer", "rc_forw_primer", "rev_primer", "rc_rev_primer")}
    b = bounds
    every = (d["forw_primer"] <= b["forw_primer"]) & (d["rc_forw_primer"] <= b["rc_forw_primer"]) & (d["rev_primer"] <= b["rev_primer"]) & (d["rc_rev_primer"] <= b["rc_rev_primer"])
    batch = F.when((d["rc_forw_primer"] >= b["rc_forw_primer"]) & (d["forw_primer"] <= b["forw_primer"]), "forwards")
    batch = batch.when((d["forw_primer"] >= b["forw_primer"]) & (d["rc_forw_primer"] <= b["forw_primer"]), "reverses").when(every, "rescuable_concatenates").otherwise("undecided")
    several = lambda n: F.size(f"{n}_pos") > 2
    out = wide.withColumn("batch", batch)
    return out.withColumn("batch", F.when((F.col("batch") == "forwards") & several("forw_primer"), "parallel_f_concatenates").when((F.col("batch") == "reverses") & several("rc_forw_primer"), "parallel_r_concatenates").otherwise(F.col("batch")))
