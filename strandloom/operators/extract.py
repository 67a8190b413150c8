"""Cutting barcodes, tags and inserts out of annotated reads."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.functions.sequence import UNDECIDED, revcomp
from strandloom.operators.signature import _get, render

#: Inserts of concatenates under this length are dropped.
LEAST_INSERT = 30
#: Kinds of rows: reads of either strand, and the two inserts of concatenates.
FORWARD, REVERSE, FIRST, SECOND = range(4)


def cut(signature: Column, name: str, text: Column) -> Column:
    """The part of text at a piece: from its start, or from the second base if it starts the read, to its stop.

    UNDECIDED if the piece is missing, ends after the text, starts before it, or has under five bases.
    """
    return _part(_get(signature, name), text)


def _part(e: Column, text: Column) -> Column:
    begin = F.when(e["start"] == 1, 1).otherwise(e["start"] - 1)
    fits = (e["stop"] <= F.length(text)) & (e["stop"] - begin >= 5) & (begin >= 0) & (begin < F.length(text))
    return F.when(F.coalesce(fits, F.lit(False)), F.substring(text, begin + 1, e["stop"] - begin)).otherwise(UNDECIDED)


def _turned(c: Column) -> Column:
    return F.when(c == UNDECIDED, c).otherwise(revcomp(c))


def extract(reads: DataFrame, exact_coords: bool = False, turn_reads: bool = False) -> DataFrame:
    """Rows sig_id, barcode, barcode_qc, umi, filtered_read, filtered_qc of annotated reads (id, seq, qual, signature, category).

    Undecided reads give none, forward and reverse ones one, concatenates up to two: without a first insert of 30 bases
    none. Inserts of single reads start one base after their bounds' start unless exact_coords. Barcodes and tags of
    reverse reads are turned round; inserts and qualities are only with turn_reads. Null sequences give none.
    """
    s, seq, qual, category = F.col("signature"), F.col("seq"), F.col("qual"), F.col("category")
    shift = 0 if exact_coords else 1
    long = lambda name: F.length(cut(s, name, seq)) >= LEAST_INSERT
    both = F.array_compact(F.array(F.when(long("read"), FIRST), F.when(long("read") & long("rc_read"), SECOND)))
    kinds = F.when(category == "forward", F.array(F.lit(FORWARD))).when(category == "reverse", F.array(F.lit(REVERSE))).when(category == "rescuable_concatenates", both)
    rows = reads.where((category != "undecided") & seq.isNotNull()).select("id", "seq", "qual", "signature", "category", F.explode(kinds).alias("_kind"))
    # a row's pieces are looked up once, as columns of their own; what isn't asked for isn't cut
    ahead, whole = F.col("_kind").isin(FORWARD, FIRST), F.col("_kind").isin(FORWARD, REVERSE)
    rows = rows.select("id", "seq", "qual", "signature", "category", "_kind", *[F.when(ahead, _get(s, n)).otherwise(_get(s, f"rc_{n}")).alias(f"_{n}") for n in ("barcode", "umi", "read")])
    e = F.col("_read")
    stop = F.when((F.col("_kind") == FORWARD) & (e["stop"] == 0), F.length(seq)).otherwise(e["stop"])
    # with a start under 1 the first base counts as the start
    begin = F.greatest(e["start"], F.lit(1))
    inside = lambda t: F.when(whole, F.substring(t, begin + shift, F.greatest(stop - begin + (1 - shift), F.lit(0)))).otherwise(_part(e, t))
    flip = lambda c: F.when(ahead, c).otherwise(_turned(c))
    turn = lambda c, how: F.when(F.col("_kind") == REVERSE, how(c)).otherwise(c) if turn_reads else c
    ends = F.when(whole, F.concat(F.lit("<"), category, F.lit(">"))).when(F.col("_kind") == FIRST, "_splitid=<forward>").otherwise("_splitid=<reverse>")
    return rows.where(~whole | (e["start"] <= stop)).select(
        F.concat(F.col("id"), F.lit("*"), render(s, "category"), ends).alias("sig_id"), flip(_part(F.col("_barcode"), seq)).alias("barcode"), _part(F.col("_barcode"), qual).alias("barcode_qc"), flip(_part(F.col("_umi"), seq)).alias("umi"), turn(inside(seq), revcomp).alias("filtered_read"), turn(inside(qual), F.reverse).alias("filtered_qc"))
