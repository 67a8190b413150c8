"""Whitelists, barcode lists and alignment files."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions.sequence import encode

#: The columns of a PAF line before its tags.
PAF = ("id", "ql", "qs", "qe", "qr", "sn", "sl", "ss", "se", "mm", "mt", "mq")
#: Rows that numbers() looks at before all of them.
FIRST = 200


def read_whitelist(spark: SparkSession, path: str, save: str | None = None) -> DataFrame:
    """whitelist_bcs: the distinct barcodes of a headerless file as codes, whether it has them as numbers or as bases.

    save: a folder that gets the codes too, as gzipped text without a header.
    """
    value = F.trim(F.col("value"))
    raw = spark.read.text(path).where(F.length(value) > 0).select(value.alias("b"))
    out = raw.select(F.when(F.col("b").rlike("^[0-9]+$"), F.expr("try_cast(b AS bigint)")).otherwise(encode("b")).alias("whitelist_bcs")).distinct()
    if save:
        write_bitlist(out, save)
    return out


def write_bitlist(whitelist: DataFrame, path: str) -> None:
    whitelist.select("whitelist_bcs").write.mode("overwrite").option("header", False).option("compression", "gzip").csv(path)


def read_barcodes(spark: SparkSession, path: str) -> DataFrame:
    """barcode: one a line."""
    return spark.read.text(path).select(F.col("value").alias("barcode"))


def _cells(lines: DataFrame) -> DataFrame:
    """The twelve columns of PAF lines (value), empty ones null; tokens, its tags from the last to the first, and names, their two letters."""
    # each line is split once, and its tags cut out once: both are columns of their own
    split = lines.select(F.split("value", "\t").alias("parts"))
    cells = [F.nullif(F.get("parts", F.lit(k)), F.lit("")).alias(c) for k, c in enumerate(PAF)]
    found = split.select(*cells, F.reverse(F.array_remove(F.slice("parts", 13, F.greatest(F.size("parts"), F.lit(1))), "")).alias("tokens"))
    return found.withColumn("names", F.transform("tokens", lambda t: F.substring(t, 1, 2)))


def parse_paf(lines: DataFrame) -> DataFrame:
    """The twelve columns of PAF lines (value), empty ones null, and tags, a map from a tag's two letters to its token.

    Tags may come in any order; of tags that a line repeats the last counts.
    """
    found = _cells(lines).withColumn("different", F.array_distinct("names"))
    last = F.transform("different", lambda n: F.get("tokens", F.array_position("names", n).cast("int") - 1))
    tags = F.when(F.size("different") == F.size("names"), F.map_from_arrays("names", "tokens")).otherwise(F.map_from_arrays("different", last))
    return found.select(*PAF, tags.alias("tags"))


def tag_columns(paf: DataFrame, tags: list[str] | None = None) -> DataFrame:
    """paf with a column for each tag; without a list, for all that occur, in order of their letters."""
    if tags is None:
        tags = sorted(r["t"] for r in paf.select(F.explode(F.map_keys("tags")).alias("t")).distinct().collect())
    return paf.select(*[c for c in paf.columns if c != "tags"], *[F.col("tags")[t].alias(t) for t in tags])


def numbers(df: DataFrame) -> DataFrame:
    """df with text columns as numbers where each value that isn't null is one.

    A value that is no number costs as much as many that are. A few rows tell most columns that have such values; only
    columns without one are looked through.
    """
    texts = [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"]
    fit = {c: F.col(f"`{c}`").isNull() | F.expr(f"try_cast(`{c}` AS double)").isNotNull() for c in texts}
    if texts:
        some = df.select(*[f.alias(c) for c, f in fit.items()]).take(FIRST)
        texts = [c for k, c in enumerate(texts) if all(r[k] for r in some)]
    if not texts:
        return df
    fits = df.agg(*[F.bool_and(fit[c]).alias(c) for c in texts]).first()
    return df.withColumns({c: F.expr(f"try_cast(`{c}` AS double)") for k, c in enumerate(texts) if fits[k]})


def read_paf(spark: SparkSession, path: str, tags: list[str] | None = None, as_map: bool = False, coerce: bool = True) -> DataFrame:
    """PAF files' columns, with a column for each tag (without a list, for all that occur) or all of them in a map; see parse_paf()."""
    lines = spark.read.text(path)
    if as_map:
        out = parse_paf(lines)
    else:
        # columns need no map: a tag's first place from the end is its last token
        found = _cells(lines)
        if tags is None:
            # most lines have the tags of another; explode would filter lines by the size of names first, and split them again for that
            some = found.select("names").distinct().select(F.explode_outer("names").alias("t")).distinct()
            tags = sorted(r["t"] for r in some.collect() if r["t"] is not None)
        out = found.select(*PAF, *[F.get("tokens", F.array_position("names", t).cast("int") - 1).alias(t) for t in tags])
    return numbers(out) if coerce else out
