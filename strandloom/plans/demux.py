"""A whole run: from reads to corrected, renamed reads and counts."""

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from strandloom.functions.sequence import before_star, decode
from strandloom.operators import align, calibrate, correct, extract, lookup, molecules, onepass, signature
from strandloom.plans.layout import DemuxPlan
from strandloom.scratch import Scratch
from strandloom.sources import sinks
from strandloom.sources.records import WHOLE, first_records, header_names, lines, marked, read_records, whole_records

#: Shorter reads are left out.
LEAST_READ = 150
#: Decisions on codes that go to all tasks at most.
MOST_SENT = lookup.MOST_KNOWN


@dataclass(frozen=True)
class Options:
    barcorrect: bool = True
    jaccard: bool = False
    least_read: int = LEAST_READ
    calibration_reads: int = 100_000
    calibration_files: int = 20


def strands(plan: DemuxPlan) -> tuple[list[str], list[str]]:
    """Names of adapters that align, of either strand."""
    names = lambda d: [p.id for p in plan.layout if p.seq and p.direction == d and p.id not in ("poly_a", "poly_t")]
    return names("forward"), names("reverse")


def stats(reads: DataFrame, plan: DemuxPlan) -> DataFrame:
    return align.align_stats(reads, plan.adapters, exact_pairing=plan.exact_pairing)


def null_distances(reads: DataFrame, plan: DemuxPlan, options: Options = Options()) -> DataFrame:
    return calibrate.calibrate(stats(calibrate.sample(reads, options.calibration_reads), plan), *strands(plan))


def null_distances_of_files(spark: SparkSession, path: str | list[str], plan: DemuxPlan, options: Options = Options(), scratch: Scratch | None = None, glob: str | None = None) -> DataFrame:
    """Thresholds by the first reads of the first files; no others are opened."""
    first = first_records(spark, path, options.calibration_reads, options.calibration_files, glob=glob, scratch=scratch)
    # they may come from one file
    return calibrate.calibrate(stats(first.repartition(spark.sparkContext.defaultParallelism), plan), *strands(plan))


def signatures(reads: DataFrame, plan: DemuxPlan, null: dict, options: Options = Options()) -> DataFrame:
    return align.align_signatures(reads.where(F.length("seq") >= options.least_read), plan.adapters, null, plan.exact_pairing)


def annotated(reads: DataFrame, plan: DemuxPlan, null: dict, options: Options = Options()) -> DataFrame:
    return signature.annotate(signatures(reads, plan, null, options), plan, calibrate.bounds_of(null))


def extracted(reads: DataFrame, plan: DemuxPlan, null: dict, options: Options = Options()) -> DataFrame:
    return extract.extract(annotated(reads, plan, null, options), plan.exact_coords)


def corrected(reads: DataFrame, plan: DemuxPlan, null: dict, options: Options = Options()) -> DataFrame:
    """Reads cut, corrected and on the lists; what is annotated is written once."""
    return demux(reads.sparkSession, plan, options, reads, null)


def renamed(found: DataFrame) -> DataFrame:
    """id (read, tag and barcode joined by _), seq, qual."""
    return found.select(F.concat_ws("_", before_star("sig_id"), "umi", "barcode").alias("id"), F.col("filtered_read").alias("seq"), F.col("filtered_qc").alias("qual"))


def cell_counts(found: DataFrame) -> DataFrame:
    """(barcode, reads, umis): of each barcode its reads and distinct tags."""
    return found.groupBy("barcode").agg(F.count("*").alias("reads"), F.countDistinct("umi").alias("umis"))


def split_cell_counts(reads: DataFrame, plan: DemuxPlan, bounds: dict[str, float], null: dict, options: Options = Options()) -> DataFrame:
    """cell_counts() of reads id, seq, qual that are split into molecules within bounds and cut; barcodes on the whitelist as they are.

    A whitelist of up to 2^23 codes goes to the tasks, and what isn't on it doesn't leave them.
    """
    cutter = onepass.Cutter.of(plan, null)
    if cutter is None:
        cut = extract.extract(annotated(molecules.split(reads, plan, bounds), plan, null, options), plan.exact_coords)
        return cell_counts(correct.on_lists(cut, plan.whitelist))
    known = lookup.collected(correct.targets_of(plan.whitelist))
    cut = onepass.split_cells(reads, cutter, plan, bounds, options.least_read, known)
    return cell_counts(cut if known is not None else correct.on_lists(cut, plan.whitelist))


def demux(spark: SparkSession, plan: DemuxPlan, options: Options = Options(), reads: DataFrame | None = None, null: dict | None = None) -> DataFrame:
    """Corrected reads of a plan's files, or of reads. Thresholds come from the first of the files, or the reads, unless given.

    The one thing that the driver gets is a row an adapter. Reads are aligned once, and annotated reads written, since
    correction counts barcodes before it changes them. Those, and the decisions on codes, stay until the driver ends.
    """
    scratch = Scratch(spark, "demux")
    if null is None:
        found = null_distances_of_files(spark, plan.paths["file"], plan, options, scratch) if reads is None else null_distances(reads, plan, options)
        null = calibrate.collected(found)
        scratch.only("annotated")
    reads = reads if reads is not None else read_records(spark, plan.paths["file"])
    cut = extract.extract(scratch.keep(_lean(annotated(reads, plan, null, options)), "annotated"), plan.exact_coords)
    return correct.on_lists(_fixed(cut, plan, options, scratch), plan.whitelist, plan.external)


def _lean(annotated: DataFrame) -> DataFrame:
    return annotated.select("id", "seq", "qual", "signature", "category")


def _fixed(cut: DataFrame, plan: DemuxPlan, options: Options, scratch: Scratch, seen: Observation | None = None) -> DataFrame:
    return correct.correct(cut, plan.whitelist, options.barcorrect, options.jaccard, length=plan.barcode_length, scratch=scratch, seen=seen)


def run(spark: SparkSession, plan: DemuxPlan, options: Options = Options()) -> dict[str, int]:
    """demux() with what a run leaves in its output folder, and counts of its stages.

    misalignment_distances; sigsummary: a signature with its category for each read that is long enough; all_barcodes: of
    each read cut, after correction, on the lists or not; filtered_reads: those on the lists. Each is a folder that a rerun
    writes over. No other table is left.
    """
    out, scratch = plan.paths["output_dir"], Scratch(spark, "run")
    null = scratch.keep(null_distances_of_files(spark, plan.paths["file"], plan, options, scratch), "null")
    sinks.write_thresholds(null, f"{out}/misalignment_distances")
    null = calibrate.collected(null)
    cutter = onepass.Cutter.of(plan, null) if options.barcorrect else None
    if cutter is None:
        found, counts = write_annotated(read_records(spark, plan.paths["file"]), plan, null, options, scratch)
        sinks.write_signatures(found, f"{out}/sigsummary")
        counts |= settle(extract.extract(found, plan.exact_coords), plan, out, options, scratch)
    else:
        found, counts = _write_cut(spark, plan, cutter, options, scratch)
        sinks.write_lines(found.where("line IS NOT NULL"), "line", f"{out}/sigsummary", mode="overwrite")
        counts |= _settle_cut(found.where("barcode IS NOT NULL"), plan, out, options, scratch)
    scratch.close()
    return counts


def _write_cut(spark: SparkSession, plan: DemuxPlan, cutter: onepass.Cutter, options: Options, scratch: Scratch) -> tuple[DataFrame, dict[str, int]]:
    """A plan's reads aligned, annotated and cut in one pass (see onepass), written and read again, and the counts of write_annotated()."""
    source = lines(spark, plan.paths["file"])
    least = options.least_read
    if all(f.endswith(WHOLE) for f in source.inputFiles()):
        # framed where they are cut: reads go to Python once
        names = ["id", "seq", "qual"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            framed = (pa.RecordBatch.from_arrays([header_names(header), seq, qual], names=names) for _, (header, seq, qual) in whole_records(batches))
            for b in onepass.gathered(framed):
                yield cutter.cut(b, least)

        done = marked(source).select("value", "of").mapInArrow(run, onepass.CUT)
    else:
        done = onepass.cut(read_records(spark, plan.paths["file"]), cutter, least)
    seen = Observation()
    first = ~F.col("more")
    done = done.observe(seen, F.count_if(first).alias("reads"), F.count_if(first & F.col("category").isNull()).alias("short"), *[F.count_if(first & (F.col("category") == c)).alias(c) for c in signature.CATEGORIES])
    return scratch.keep(done, "annotated"), _got(seen, "reads", "short", *signature.CATEGORIES)


def _settle_cut(cut: DataFrame, plan: DemuxPlan, out: str, options: Options, scratch: Scratch) -> dict[str, int]:
    """settle() of reads that have their codes. What becomes of a code is decided once a code, and goes to the reads where they are.

    Decisions on over 2^23 codes are joined by a sort instead, which moves the reads.
    """
    all_seen, kept_seen, ways = Observation(), Observation(), Observation()
    counts = cut.where("code IS NOT NULL").groupBy("code").agg(F.count("*").alias("freq"))
    fates = correct.fates(counts, plan.whitelist, options.jaccard, length=plan.barcode_length, scratch=scratch, seen=ways).withColumnRenamed("code", "_code")
    few = fates.count() <= MOST_SENT

    def fixed(reads: DataFrame, fates: DataFrame) -> DataFrame:
        """reads with what becomes of their codes; those without a code take no part in a join that moves them."""
        with_code = reads if few else reads.where("code IS NOT NULL")
        found = with_code.join(F.broadcast(fates) if few else fates, F.col("code") == F.col("_code"), "left")
        if not few:
            found = found.unionByName(reads.where("code IS NULL"), allowMissingColumns=True)
        new = F.when(F.col("target").isNotNull(), decode("target", plan.barcode_length)).otherwise(F.col("barcode"))
        return found.withColumn("barcode", new)

    # of these only the codes that change matter
    sinks.write_lines(fixed(cut.select("barcode", "code"), fates.where("target IS NOT NULL")).observe(all_seen, F.count("*").alias("cut")), "barcode", f"{out}/all_barcodes", mode="overwrite")
    kept = fixed(cut, fates)
    kept = kept.where("kept") if plan.external is None else correct.on_lists(kept, plan.whitelist, plan.external)
    named = kept.observe(kept_seen, F.count("*").alias("kept")).select(F.concat_ws("_", before_star("id"), "umi", "barcode").alias("id"), F.col("filtered_read").alias("seq"), F.col("filtered_qc").alias("qual"))
    sinks.write_reads(named, f"{out}/filtered_reads", mode="overwrite")
    return {**_got(all_seen, "cut"), **_got(kept_seen, "kept"), **_got(ways, "listed", *correct.WAYS)}


def write_annotated(reads: DataFrame, plan: DemuxPlan, null: dict, options: Options, scratch: Scratch) -> tuple[DataFrame, dict[str, int]]:
    """The annotated reads, written and read again, and how many came in, were too short, and are of each category."""
    seen, kinds = Observation(), Observation()
    reads = reads.observe(seen, F.count("*").alias("reads"), F.count_if(~F.coalesce(F.length("seq") >= options.least_read, F.lit(False))).alias("short"))
    done = _lean(annotated(reads, plan, null, options)).observe(kinds, *[F.count_if(F.col("category") == c).alias(c) for c in signature.CATEGORIES])
    return scratch.keep(done, "annotated"), {**_got(seen, "reads", "short"), **_got(kinds, *signature.CATEGORIES)}


def _got(seen: Observation, *names: str) -> dict[str, int]:
    """Observed counts; of empty inputs Spark may observe nothing."""
    return {n: int(seen.get.get(n) or 0) for n in names}


def settle(cut: DataFrame, plan: DemuxPlan, out: str, options: Options = Options(), scratch: Scratch | None = None) -> dict[str, int]:
    """Barcodes and filtered reads of all reads cut, over whatever an earlier run left, and counts of them.

    Frequencies that break ties are those of all reads cut, in however many parts they came.
    """
    own = scratch or Scratch(cut.sparkSession, "settle")
    all_seen, kept_seen, ways = Observation(), Observation(), Observation()
    fixed = _fixed(cut, plan, options, own, ways)
    sinks.write_lines(fixed.observe(all_seen, F.count("*").alias("cut")), "barcode", f"{out}/all_barcodes", mode="overwrite")
    kept = correct.on_lists(fixed, plan.whitelist, plan.external).observe(kept_seen, F.count("*").alias("kept"))
    sinks.write_reads(renamed(kept), f"{out}/filtered_reads", mode="overwrite")
    if scratch is None:
        own.close()
    return {**_got(all_seen, "cut"), **_got(kept_seen, "kept"), **(_got(ways, "listed", *correct.WAYS) if options.barcorrect else {})}


def read_stats(reads: DataFrame) -> DataFrame:
    """Number of reads, bases, and the least, mean and greatest length."""
    n = F.length("seq")
    return reads.agg(F.count("*").alias("num_seqs"), F.sum(n).alias("sum_len"), F.min(n).alias("min_len"), F.avg(n).alias("avg_len"), F.max(n).alias("max_len"))
