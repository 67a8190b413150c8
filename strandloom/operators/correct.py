"""Barcodes against a whitelist: membership, neighbours by bits and bases, and correction with tie-breaks."""

from itertools import combinations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from strandloom.functions.sequence import UNDECIDED, base_distance, best_qgram_matches, bit_distance, decimals, decode, encode, qgram_distance
from strandloom.operators import lookup
from strandloom.scratch import Scratch

#: Whitelist barcodes among the most frequent that the last tie-break looks at.
TOP = 5000
#: How a code finds its correction.
WAYS = ("hamming", "minilist", "jaccard", "extended")


def code_of(barcode: Column | str) -> Column:
    """The code of a cut barcode; null for one that could not be cut, which so matches nothing."""
    b = F.col(barcode) if isinstance(barcode, str) else barcode
    return F.when(b != UNDECIDED, encode(b))


def in_whitelist(barcodes: DataFrame, whitelist: DataFrame, code: str = "code") -> DataFrame:
    """barcodes with listed: whether their code is in the whitelist (whitelist_bcs)."""
    known = whitelist.select(F.col("whitelist_bcs").alias("_known")).distinct()
    return barcodes.join(known, F.col(code) == F.col("_known"), "left").withColumn("listed", F.col("_known").isNotNull()).drop("_known")


def frequencies(barcodes: DataFrame, whitelist: DataFrame, code: str = "code", by: tuple[str, ...] = ()) -> DataFrame:
    """(whitelist_bcs, freq): how often each whitelisted code occurs, also by other columns."""
    known = whitelist.select("whitelist_bcs").distinct()
    counts = barcodes.groupBy(*by, F.col(code).alias("whitelist_bcs")).agg(F.count("*").alias("freq"))
    return counts.join(known, "whitelist_bcs", "left_semi").select(*by, "whitelist_bcs", "freq")


def secondary(freq: DataFrame, n: int = TOP) -> DataFrame:
    """The n most frequent codes, the smaller code first among equals. The limit is the feature."""
    return freq.orderBy(F.desc("freq"), "whitelist_bcs").limit(n)


#: Bits of a half that codes are changed in for look-ups, at most; beyond that, whitelist codes are changed too.
MOST_FLIPS = 2


def _masks(width: int, most: int) -> list[int]:
    """Numbers of so many bits with at most so many set."""
    return sorted(sum(1 << k for k in at) for n in range(most + 1) for at in combinations(range(width), n))


def _by_halves(codes: DataFrame, targets: DataFrame, bits: int, length: int) -> DataFrame:
    """Pairs (code, target) of distinct codes one to bits bits apart.

    One of a pair's halves differs in half of the bits at most. So halves are looked up with each choice of so many bits
    changed, at 4 bits 137 look-ups a half, on keys of 16 bits; what is found is counted exactly. A code meets two hundredths
    or so of one per cent of the whitelist for each look-up, and nothing else.
    """
    width = length
    few = min(bits // 2, MOST_FLIPS)

    def halves(d: DataFrame, c: str, flips: int) -> DataFrame:
        changed = d.select(c, F.explode(F.array(*[F.lit(m).cast("bigint") for m in _masks(width, flips)])).alias("mask"))
        low = (1 << width) - 1
        value = lambda shift: F.shiftright(c, shift).bitwiseAND(F.lit(low).cast("bigint")).bitwiseXOR(F.col("mask"))
        return changed.select(c, F.inline(F.array(*[F.struct(F.lit(k).alias("half"), value(k * width).alias("value")) for k in (0, 1)])))

    pairs = halves(codes, "code", few).join(halves(targets, "target", bits // 2 - few), ["half", "value"])
    return pairs.where((bit_distance("code", "target") >= 1) & (bit_distance("code", "target") <= bits)).select("code", "target").distinct()


def _variants(bases: int, length: int) -> list[int]:
    one = [(m << 2 * k, k) for k in range(length) for m in (1, 2, 3)]
    if bases == 1:
        return [m for m, _ in one]
    return [a | b for a, i in one for b, j in one if j < i]


def targets_of(whitelist: DataFrame) -> DataFrame:
    return whitelist.select(F.col("whitelist_bcs").cast("bigint").alias("target")).where("target IS NOT NULL").distinct()


def neighbours(codes: DataFrame, whitelist: DataFrame, bits: int = 4, bases: int = 4, length: int = 16, nearest: bool = True, scratch: Scratch | None = None) -> DataFrame:
    """(code, target, bases): whitelist codes one to bits bits and at most bases bases from each distinct code.

    nearest: only those at the least distance in bases. A whitelist of up to 2^23 codes goes to the tasks (see lookup), and
    no pair that isn't an answer is made. Larger ones are joined, see _joined().
    """
    codes = codes.select("code").where("code IS NOT NULL").distinct()
    targets = targets_of(whitelist)
    known = lookup.collected(targets)
    if known is None:
        return _joined(codes, targets, bits, bases, length, nearest, scratch or Scratch(codes.sparkSession, "neighbours"))
    return lookup.neighbours(codes, known, bits, bases, length, nearest)


def _joined(codes: DataFrame, targets: DataFrame, bits: int, bases: int, length: int, nearest: bool, scratch: Scratch) -> DataFrame:
    """neighbours() of a whitelist that is too large to send.

    Codes with one base changed are looked up as they are, then with two, for those that found none; what is left is looked
    up by halves, as are all without nearest. Codes, whitelist and each step's finds are written once.
    """
    codes, targets = scratch.keep(codes, "near-codes"), scratch.keep(targets, "near-targets")
    if not nearest:
        found = _by_halves(codes, targets, bits, length).withColumn("bases", base_distance("code", "target", length))
        return found.where(F.col("bases") <= bases)
    parts, left = [], codes
    for k in (1, 2):
        if k > bases:
            break
        masks = F.explode(F.array(*[F.lit(m).cast("bigint") for m in _variants(k, length) if m.bit_count() <= bits]))
        tried = left.select("code", masks.alias("mask")).select("code", F.col("code").bitwiseXOR(F.col("mask")).alias("target"))
        parts.append(scratch.keep(tried.join(targets, "target", "left_semi").select("code", "target", F.lit(k).alias("bases")), f"near-bases-{k}"))
        left = scratch.keep(left.join(parts[-1].select("code").distinct(), "code", "left_anti"), f"near-left-{k}")
    if bases > 2 and bits > 2:
        far = _by_halves(left, targets, bits, length).withColumn("bases", base_distance("code", "target", length)).where(F.col("bases") <= bases)
        parts.append(far.withColumn("least", F.min("bases").over(Window.partitionBy("code"))).where("bases = least").select("code", "target", "bases"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("code", "target", F.col("bases").cast("int"))


def mutate_and_check(codes: DataFrame, whitelist: DataFrame, bits: int = 4, length: int = 16) -> DataFrame:
    """(code, matches): the whitelist codes at most bits bits away, itself included, in order; empty if there are none."""
    codes = codes.select("code").where("code IS NOT NULL").distinct()
    known = lookup.collected(targets_of(whitelist))
    if known is not None:
        return lookup.matches(codes, known, bits, length)
    near = neighbours(codes, whitelist, bits, length, length, nearest=False).select("code", "target")
    own = codes.join(whitelist.select(F.col("whitelist_bcs").alias("target")).distinct(), F.col("code") == F.col("target")).select("code", "target")
    matches = near.unionByName(own).groupBy("code").agg(F.array_sort(F.collect_set("target")).alias("matches"))
    return codes.join(matches, "code", "left").select("code", F.coalesce("matches", F.array().cast("array<bigint>")).alias("matches"))


def decide(codes: DataFrame, whitelist: DataFrame, freq: DataFrame, jaccard: bool = True, bits: int = 4, bases: int = 4, length: int = 16, top: int = TOP, scratch: Scratch | None = None) -> DataFrame:
    """(code, target, how, value) for each distinct code off the whitelist that finds a correction.

    The nearest whitelist codes compete: alone (hamming, value the distance), by the one greatest frequency (minilist),
    else, with jaccard, by the one least distance of base pairs (jaccard, value that distance), else by the frequency of
    the nearest neighbours that those tied have among the top most frequent, the smaller code on ties (extended).
    """
    scratch = scratch or Scratch(codes.sparkSession, "decide")
    near = neighbours(codes, whitelist, bits, bases, length, scratch=scratch)
    scored = near.join(freq.select(F.col("whitelist_bcs").alias("target"), "freq"), "target", "left").withColumn("freq", F.coalesce("freq", F.lit(0)))
    # candidates of a code number 48 at one base and thousands at most, by what lies within the reach in bits
    by_code = scored.groupBy("code").agg(F.count("*").alias("n"), F.min("bases").alias("bases"), F.max("freq").alias("most"), F.collect_list(F.struct("target", "freq")).alias("all"))
    leaders = F.filter("all", lambda x: x["freq"] == F.col("most"))
    first = by_code.select("code", "n", "bases", F.when(F.col("n") > 1, F.transform("all", lambda x: x["target"])).alias("all"), leaders.alias("leaders"))
    if jaccard:
        first = scratch.keep(first, "first")
    done = first.where((F.col("n") == 1) | (F.size("leaders") == 1)).select("code", F.col("leaders")[0]["target"].alias("target"), F.when(F.col("n") == 1, "hamming").otherwise("minilist").alias("how"), F.when(F.col("n") == 1, F.col("bases")).cast("double").alias("value"))
    if not jaccard:
        return done
    tied = first.where((F.col("n") > 1) & (F.size("leaders") > 1)).withColumn("text", decode("code", length))
    tied = tied.withColumn("best", best_qgram_matches("text", F.transform("all", lambda x: decode(x, length))))
    tied = scratch.keep(tied.select("code", "bases", "text", "best"), "tied")
    one = tied.where(F.size("best") == 1).select("code", encode(F.col("best")[0]).alias("target"), F.lit("jaccard").alias("how"), qgram_distance("text", F.col("best")[0]).alias("value"))
    several = tied.where(F.size("best") > 1).select(F.col("code").alias("origin"), "bases", F.explode("best").alias("b")).select("origin", "bases", encode("b").alias("code"))
    few = scratch.keep(secondary(freq, top), "few")
    around = neighbours(several, few, bits, bases, length, nearest=False).select("code", "target", F.col("bases").alias("d"))
    around = several.join(around, "code").where(F.col("d") <= F.col("bases"))
    around = around.join(few.select(F.col("whitelist_bcs").alias("target"), "freq"), "target")
    last = around.groupBy("origin").agg(F.min(F.struct("d", (-F.col("freq")).alias("rarity"), "target"))["target"].alias("target"))
    last = last.select(F.col("origin").alias("code"), "target", F.lit("extended").alias("how"), F.lit(None).cast("double").alias("value"))
    return done.unionByName(one).unionByName(last)


def _decided(counts: DataFrame, known: DataFrame, jaccard: bool, bits: int, bases: int, length: int, top: int, scratch: Scratch, seen: Observation | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of distinct codes and how often they occur: those with whether they are listed, what is decided on the others, and the codes known."""
    # made once: it is read for membership, counted, and sent to the tasks
    known = scratch.keep(known.select(F.col("whitelist_bcs").cast("bigint")), "near-known")
    codes = scratch.keep(in_whitelist(counts, known), "codes")
    freq = codes.where("listed").select(F.col("code").alias("whitelist_bcs"), "freq")
    plan = scratch.keep(decide(codes.where("NOT listed").select("code"), known, freq, jaccard, bits, bases, length, top, scratch), "plan")
    if seen is not None:
        reads_of = plan.select(F.col("code").alias("_off"), F.col("how").alias("_how"))
        ways = codes.join(reads_of, F.col("code") == F.col("_off"), "left").select("code", "freq", F.when(F.col("listed"), "listed").otherwise(F.col("_how")).alias("way"))
        ways.observe(seen, *[F.sum(F.when(F.col("way") == w, F.col("freq")).otherwise(0)).alias(w) for w in ("listed", *WAYS)]).write.format("noop").mode("overwrite").save()
    return codes, plan, known


def _drop_steps(scratch: Scratch) -> None:
    """Drops what decisions are made from."""
    for name in [n for n in scratch.names if n in ("codes", "first", "tied", "few") or n.startswith("near-")]:
        scratch.drop(name)


def fates(counts: DataFrame, whitelist: DataFrame, jaccard: bool = True, bits: int = 4, bases: int = 4, length: int = 16, top: int = TOP, scratch: Scratch | None = None, seen: Observation | None = None) -> DataFrame:
    """(code, target, kept) of distinct codes (code, freq): what a code becomes, null if it stays, and whether that is on the whitelist.

    As correct() decides. Codes that stay and aren't on the whitelist have no row.
    """
    scratch = scratch or Scratch(counts.sparkSession, "fates")
    codes, plan, known = _decided(counts, whitelist.select("whitelist_bcs").where("whitelist_bcs IS NOT NULL").distinct(), jaccard, bits, bases, length, top, scratch, seen)
    off = plan.select("code", "target", encode(decode("target", length)).alias("_becomes"))
    off = in_whitelist(off, known, "_becomes").select("code", "target", F.col("listed").alias("kept"))
    on = codes.where("listed").select("code", F.lit(None).cast("bigint").alias("target"), F.lit(True).alias("kept"))
    out = scratch.keep(on.unionByName(off), "fates")
    _drop_steps(scratch)
    scratch.drop("plan")
    return out


def correct(extracted: DataFrame, whitelist: DataFrame, barcorrect: bool = True, jaccard: bool = True, bits: int = 4, bases: int = 4, length: int = 16, top: int = TOP, scratch: Scratch | None = None, seen: Observation | None = None) -> DataFrame:
    """Extracted reads with barcodes corrected, and a note of it after their sig_id.

    Distinct codes are counted, written, and decided on; a row a code joins back to the reads, once. Reads off the whitelist
    that find no correction stay as they are; so do reads without a cut barcode, which take no part in the join. Without
    barcorrect only reads on the whitelist come out. extracted is read twice; see demux() of plans, which writes it first.
    Of the tables written, that of decisions stays, which the result is read from. seen gets counts of reads on the whitelist
    and of those corrected each way.
    """
    scratch = scratch or Scratch(extracted.sparkSession, "correct")
    coded = extracted.withColumn("_code", code_of("barcode"))
    known = whitelist.select("whitelist_bcs").where("whitelist_bcs IS NOT NULL").distinct()
    if not barcorrect:
        return coded.join(known, F.col("_code") == F.col("whitelist_bcs"), "left_semi").select(*extracted.columns)
    counts = coded.where("_code IS NOT NULL").groupBy(F.col("_code").alias("code")).agg(F.count("*").alias("freq"))
    _, plan, _ = _decided(counts, known, jaccard, bits, bases, length, top, scratch, seen)
    _drop_steps(scratch)
    out = coded.where("_code IS NOT NULL").join(plan.withColumnRenamed("code", "_from"), F.col("_code") == F.col("_from"), "left")
    new = decode("target", length)
    pair = F.concat(F.col("barcode"), F.lit("_"), new)
    note = F.when(F.col("how") == "hamming", F.concat(F.lit("{orig_hamming_"), pair, F.lit(":"), F.col("value").cast("int").cast("string"), F.lit("}")))
    note = note.when(F.col("how") == "minilist", F.concat(F.lit("{orig_hamming_minilist_"), pair, F.lit("}")))
    note = note.when(F.col("how") == "jaccard", F.concat(F.lit("{orig_jaccard_"), pair, F.lit(":"), decimals("value"), F.lit("}")))
    note = note.when(F.col("how") == "extended", F.concat(F.lit("{orig_extended_hamming_"), pair, F.lit("}")))
    out = out.withColumn("sig_id", F.concat("sig_id", F.coalesce(note, F.lit("")))).withColumn("barcode", F.when(F.col("target").isNotNull(), new).otherwise(F.col("barcode")))
    return out.select(*extracted.columns).unionByName(coded.where("_code IS NULL").select(*extracted.columns))


def on_lists(reads: DataFrame, whitelist: DataFrame, external: DataFrame | None = None) -> DataFrame:
    """Reads whose barcode is on the whitelist, or, where external barcodes are given, among those."""
    if external is not None:
        return reads.join(external.select(F.col("barcode").alias("_own")).distinct(), F.col("barcode") == F.col("_own"), "left_semi")
    return reads.join(whitelist.select(F.col("whitelist_bcs").alias("_own")).distinct(), code_of("barcode") == F.col("_own"), "left_semi")
