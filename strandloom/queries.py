"""The registered queries of the demultiplexing operators, each over its whole table, and their DuckDB SQL."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom import alignment_sql, fixtures
from strandloom.functions import sequence as S
from strandloom.operators import align, calibrate, correct, extract, molecules, signature
from strandloom.plans import demux, layout
from strandloom.sources import tables

Query = Callable[[SparkSession, str], DataFrame]
#: Thresholds of the fixture reads: mean and deviation of misaligned primers, and the bounds that follow.
NULL = {"forw_primer": (8.53, 0.83), "rev_primer": (12.46, 0.91), "rc_forw_primer": (8.54, 0.81), "rc_rev_primer": (12.43, 0.91)}
EQUAL = tuple(("N", b) for b in "ACGT")
#: Bounds under which a primer hardly lies anywhere by chance.
STRICT = {"forw_primer": 4.0, "rev_primer": 7.0, "rc_forw_primer": 4.0, "rc_rev_primer": 7.0}
BOUNDS = {"forw_primer": 7.0, "rev_primer": 11.0, "rc_forw_primer": 7.0, "rc_rev_primer": 11.0}


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.frame(spark, sf_dir, fixtures.READS)


def mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.frame(spark, sf_dir, fixtures.MIXED)


def plan_of(spark: SparkSession, sf_dir: str) -> layout.DemuxPlan:
    return layout.kit("three", whitelist=whitelist(spark, sf_dir))


def whitelist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads(spark, sf_dir).select(S.encode("true_barcode").alias("whitelist_bcs")).distinct()


def barcodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Barcodes cut at the exact forward primer, or its complement on the other strand."""
    r = reads(spark, sf_dir)
    turned = F.when(F.col("rid") % 2 == 1, S.revcomp("seq")).otherwise(F.col("seq"))
    return r.select("rid", "cell", turned.alias("fwd")).withColumn("at", F.locate(fixtures.FORWARD, "fwd")).where("at > 0").select(
        "rid", "cell", F.substring(F.col("fwd"), F.col("at") + len(fixtures.FORWARD), F.lit(16)).alias("barcode"), F.substring(F.col("fwd"), F.col("at") + (len(fixtures.FORWARD) + 16), F.lit(12)).alias("umi")).withColumn("code", S.encode("barcode"))


def revcomp_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(spark, sf_dir).select("rid", S.revcomp("seq").alias("rc"))


def encode_barcodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return barcodes(spark, sf_dir).select("rid", "code", S.bit_string("code").alias("bits"))


def decode_barcodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return barcodes(spark, sf_dir).select("rid", S.decode("code").alias("barcode"), S.decode("code", 8).alias("tail"))


def distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, r = barcodes(spark, sf_dir), reads(spark, sf_dir).select(F.col("rid").alias("r"), "true_barcode")
    d = b.join(r, F.col("rid") == F.col("r"))
    true = S.encode("true_barcode")
    return d.select("rid", S.base_distance("code", true).alias("bases"), S.bit_distance("code", true).alias("bits"), S.mismatch_positions("barcode", "true_barcode").alias("places"), S.qgram_distance("barcode", "true_barcode").alias("qgram"))


def phred_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(spark, sf_dir).select("rid", S.phred(F.translate("seq", "ACGTN", "!+5?I")).alias("scores"), S.header_id(F.concat("id", F.lit(" run=1"))).alias("name"), S.before_star(F.concat("id", F.lit("*x*y"))).alias("origin"), S.decimals(F.col("rid") / 7).alias("text"))


def poly_tail_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.poly_tails(mixed(spark, sf_dir).select("rid", "seq")).select("rid", "t_start", "t_stop", "a_start", "a_stop")


def poly_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(spark, sf_dir).select("rid", S.poly_runs("seq", "T").alias("runs"), S.has_duplicates(F.split("seq", "TT")).alias("repeated"))


def bit_flips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return barcodes(spark, sf_dir).select(F.col("code").alias("code")).distinct().select("code", S.flips("code", 1).alias("flips"))


def bit_flips_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    return barcodes(spark, sf_dir).select("code").distinct().select("code", S.flips("code", 2).alias("flips"))


def align_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The forward primer in reads, in each mode; N matches every base."""
    d = mixed(spark, sf_dir).select("rid", F.lit(fixtures.FORWARD).alias("query"), F.col("seq").alias("text"))
    for mode in ("global", "prefix", "infix"):
        d = align.align_pairs(d, "query", "text", mode, equal=EQUAL, name=mode, starts=False)
    d = align.align_pairs(d, "query", "text", "infix", 4, EQUAL, name="near", starts=False)
    return d.select("rid", F.col("global.distance").alias("whole"), F.col("prefix.distance").alias("prefix"), F.col("prefix.stops")[0].alias("prefix_stop"), F.col("infix.distance").alias("infix"), F.col("infix.stops").alias("infix_stops"), F.col("near.distance").alias("near"))


def align_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Constructs of 100 and 200 bases in reads, N for what varies, with and without a bound of their distance."""
    d = mixed(spark, sf_dir).select("rid", F.col("seq").alias("text"), F.explode(F.create_map(*[F.lit(x) for pair in alignment_sql.LONG.items() for x in pair])).alias("query_id", "query"))
    d = align.align_pairs(d, "query", "text", "infix", equal=EQUAL, name="best", starts=False)
    # a search without a bound has found what one with it would
    best = F.col("best.distance")
    near = F.when(best > alignment_sql.LONG_BOUND, -1).otherwise(best)
    return d.select("rid", "query_id", best.alias("distance"), F.col("best.stops").alias("stops"), near.alias("near"))


def align_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads against the reads that they were made from, whole."""
    made = reads(spark, sf_dir).select(F.col("rid").alias("r"), F.col("seq").alias("origin"))
    d = mixed(spark, sf_dir).select("rid", "seq").join(made, F.col("rid") == F.col("r"))
    return align.align_pairs(d, "seq", "origin", "global").select("rid", F.col("aligned.distance").alias("distance"))


def align_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of the forward primer against reads, whole."""
    d = mixed(spark, sf_dir).select("rid", F.lit(fixtures.FORWARD).alias("query"), F.col("seq").alias("text"))
    return align.align_pairs(d, "query", "text", "global", path=True).select("rid", "aligned.distance", "aligned.path", "aligned.cigar")


def align_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The forward primer against empty, missing and unlike texts, and the empty query against reads, in each mode."""
    none = F.when(F.col("rid") % 4 == 0, "").when(F.col("rid") % 4 == 1, F.repeat(F.lit("N"), F.col("rid") % 7)).when(F.col("rid") % 4 == 2, F.col("seq"))
    d = mixed(spark, sf_dir).select("rid", F.when(F.col("rid") % 4 == 2, "").otherwise(fixtures.FORWARD).alias("query"), none.alias("text"))
    for mode in ("global", "prefix", "infix"):
        d = align.align_pairs(d, "query", "text", mode, name=mode)
    return d.select("rid", *[F.col(f"{m}.{part}").alias(f"{m}_{part}") for m in ("global", "prefix", "infix") for part in ("distance", "stops")])


def align_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.locations(mixed(spark, sf_dir), plan_of(spark, sf_dir).adapters, "rid")


def batch_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The older categories of reads, parallel concatenates among them."""
    names = [n for n, _ in alignment_sql.ADAPTERS]
    found = calibrate.wide_locations(align_locations(spark, sf_dir), names)
    return calibrate.batches(found, BOUNDS).select("id", *[f"{n}_dist" for n in names], "batch")


def align_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.align_stats(mixed(spark, sf_dir), plan_of(spark, sf_dir).adapters, "rid")


def null_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return demux.null_distances(reads(spark, sf_dir), plan_of(spark, sf_dir))


def lower_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thresholds over distances that stand in lineitem rather than come from alignment."""
    n = calibrate.calibrate(_quantities(spark, sf_dir), ["q0", "q1"], ["q2", "q3"])
    return n.join(calibrate.lower_bounds(n), "query_id")


def error_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The older bounds, over the same distances."""
    return calibrate.error_bounds(_quantities(spark, sf_dir), ["q0", "q1"], ["q2", "q3"])


def calibration_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibrate.calibrate(_quantities(spark, sf_dir), ["q0", "q1"], ["q2", "q3"], "graphics").select("id", "query_id", "best_edit_distance")


def _quantities(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    d = o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("c"), F.explode(F.array(*[F.lit(k) for k in range(4)])).alias("k"))
    near = ((F.col("c") % 3 == 0) & (F.col("k") < 2)) | ((F.col("c") % 3 == 1) & (F.col("k") > 1))
    return d.select("id", F.concat(F.lit("q"), "k").alias("query_id"), F.when(near, 0).otherwise(5 + F.pmod(F.col("id") + F.col("c") * F.col("k"), F.lit(7))).cast("int").alias("best_edit_distance"))


def layout_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.as_frame(spark, layout.expand(layout.KITS["three"]))


def align_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return demux.signatures(mixed(spark, sf_dir), plan_of(spark, sf_dir), NULL).select("rid", signature.render("signature").alias("signature"))


def signature_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = fixtures.frame(spark, sf_dir, fixtures.SIGNATURES).withColumn("s", signature.parse(F.concat("sig", F.lit("<forward>"))))
    return d.select("rid", signature.category_of(F.concat("sig", F.lit("<forward>"))).alias("category"), F.explode("s").alias("e")).select("rid", "category", "e.id", "e.ed", "e.start", "e.stop")


def _annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = fixtures.frame(spark, sf_dir, fixtures.SIGNATURES).withColumn("signature", signature.parse("sig"))
    return signature.annotate(d, layout.kit("three"), BOUNDS)


def signature_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _annotated(spark, sf_dir).select("rid", "category")


def signature_annotate(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _annotated(spark, sf_dir)
    part = lambda n, f: signature._get(F.col("signature"), n)[f].alias(f"{n}_{f}")
    return d.select("rid", *[part(n, f) for n in ("barcode", "umi", "rc_barcode", "rc_umi", "read", "rc_read") for f in ("start", "stop")])


def _cut_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extracted rows of signatures that fit the fixture reads, concatenates among them."""
    r = reads(spark, sf_dir)
    both = F.concat("seq", S.revcomp("seq"))
    r = r.withColumn("seq", F.when(F.col("rid") % 6 == 2, both).otherwise(F.col("seq"))).withColumn("qual", F.repeat(F.lit("I"), F.length("seq")))
    forward = "forw_primer:0:11:32|poly_t:0:57:84|rev_primer:0:177:206"
    back = "rc_rev_primer:0:11:40|poly_a:0:133:160|rc_forw_primer:0:185:206"
    twice = "forw_primer:0:11:32|poly_t:0:57:84|rev_primer:0:177:206|rc_rev_primer:0:227:256|poly_a:0:349:376|rc_forw_primer:0:401:422"
    far = "|rc_forw_primer:9:100:121", "|forw_primer:9:60:81"
    text = F.when(F.col("rid") % 6 == 2, twice).when(F.col("rid") % 2 == 1, back + far[1]).otherwise(forward + far[0])
    return extract.extract(signature.annotate(r.withColumn("signature", signature.parse(text)), layout.kit("three"), BOUNDS))


def extract_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cut_up(spark, sf_dir).select(S.before_star("sig_id").alias("id"), F.col("sig_id").contains("_splitid=").alias("split"), F.regexp_extract("sig_id", "<([a-z_]+)>$", 1).alias("part"), "barcode", F.length("barcode_qc").alias("n_qc"), "umi", "filtered_read", F.length("filtered_qc").alias("n_filtered_qc"))


def whitelist_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correct.in_whitelist(barcodes(spark, sf_dir), whitelist(spark, sf_dir)).select("rid", "listed")


def barcode_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correct.frequencies(barcodes(spark, sf_dir), whitelist(spark, sf_dir))


def secondary_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correct.secondary(barcode_freq(spark, sf_dir), 100)


def whitelist_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correct.neighbours(_off(spark, sf_dir), whitelist(spark, sf_dir), 6, 4)


def whitelist_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All whitelisted codes within reach, not the nearest alone."""
    return correct.neighbours(_off(spark, sf_dir), whitelist(spark, sf_dir), 6, 4, nearest=False)


def listed_barcodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads on the whitelist as they are: correction left out."""
    return correct.correct(barcodes(spark, sf_dir).select("rid", F.lit("@r").alias("sig_id"), "barcode"), whitelist(spark, sf_dir), barcorrect=False)


def text_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths of texts in characters and in bytes of UTF-8, and their runs of five equal letters or more."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select("doc_id", F.length("text").cast("bigint").alias("chars"), F.octet_length("text").cast("bigint").alias("bytes"), S.poly_runs("text", "e", 3).alias("runs"))


def mutate_and_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correct.mutate_and_check(barcodes(spark, sf_dir), whitelist(spark, sf_dir), 6).select("code", F.array_join("matches", ",").alias("matches"))


def read_molecules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Molecules of reads joined from one to four."""
    found = molecules.molecules(fixtures.frame(spark, sf_dir, fixtures.CHAINS), layout.kit("three"), STRICT, keep=["rid"])
    return found.select("rid", F.posexplode("molecules").alias("number", "m")).select("rid", (F.col("number") + 1).alias("number"), "m.strand", "m.start", "m.stop", "m.distance")


def molecule_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads and tags of each cell, of reads joined from one to four and split again."""
    known = fixtures.barcodes(spark, sf_dir).select(S.encode("true_barcode").alias("whitelist_bcs"))
    return demux.split_cell_counts(fixtures.chains(spark, sf_dir), layout.kit("three", whitelist=known), STRICT, NULL)


def _off(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correct.in_whitelist(barcodes(spark, sf_dir), whitelist(spark, sf_dir)).where("NOT listed").select("code").distinct()


def correct_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions on codes off a whitelist that is made so that all tie-breaks come up."""
    b = fixtures.frame(spark, sf_dir, fixtures.TIES).withColumn("code", S.encode("barcode"))
    known = fixtures.frame(spark, sf_dir, fixtures.TIE_LIST).select(S.encode("barcode").alias("whitelist_bcs"))
    odd = correct.in_whitelist(b, known).where("NOT listed").select("code").distinct()
    return correct.decide(odd, known, correct.frequencies(b, known))


def correct_barcodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = barcodes(spark, sf_dir).select("rid", F.concat(F.lit("@r"), F.col("rid").cast("string"), F.lit("*")).alias("sig_id"), "barcode")
    return correct.correct(b, whitelist(spark, sf_dir))


def paf_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PAF lines made of line items, tags in two orders, some missing."""
    d = tables.parse_paf(spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(_paf_line().alias("value")))
    return tables.tag_columns(d, ["NM", "ms", "tp"]).select("id", "ql", "qr", "sn", "mq", "NM", "ms", "tp")


def _paf_line() -> F.Column:
    k, n = F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")
    fixed = F.concat_ws("\t", F.concat(k, F.lit("_"), n), F.lit("216"), n, F.lit("200"), F.when(F.col("l_linenumber") % 2 == 0, "+").otherwise(""), F.concat(F.lit("chr"), n), *[F.lit(x) for x in ("1000", "5", "205", "190", "200")], k)
    tags = F.when(F.col("l_orderkey") % 3 == 0, F.concat_ws("\t", F.lit("NM:i:3"), F.concat(F.lit("ms:i:"), n), F.lit("tp:A:P"))).when(F.col("l_orderkey") % 3 == 1, F.concat_ws("\t", F.lit("tp:A:S"), F.lit("NM:i:4"))).otherwise(F.concat(F.lit("ms:i:"), k))
    return F.concat_ws("\t", fixed, tags)


def read_length_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return demux.read_stats(mixed(spark, sf_dir))


def renamed_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return demux.renamed(_cut_up(spark, sf_dir))


def cell_umi_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From exact primers to reads and tags of each whitelisted barcode. The fixture's whitelist is its reads' true barcodes, a second scan."""
    found = correct.in_whitelist(barcodes(spark, sf_dir), whitelist(spark, sf_dir)).where("listed")
    return demux.cell_counts(found.select("barcode", "umi"))


def demultiplex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole run over the mixed reads, thresholds measured on them, and counts of each barcode."""
    plan = plan_of(spark, sf_dir)
    r = mixed(spark, sf_dir).select("id", "seq", "qual")
    return demux.cell_counts(demux.demux(spark, plan, reads=r))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (
        cell_umi_counts, revcomp_reads, encode_barcodes, decode_barcodes, distances, phred_scores, poly_tail_scan, poly_runs, bit_flips, bit_flips_two, align_modes, align_long, align_reads, align_empty, align_paths, align_locations, batch_categories, align_stats, null_distance, lower_bounds, error_bounds, calibration_rows,
        layout_expand, align_signatures, signature_parse, signature_classify, signature_annotate, extract_reads, whitelist_check, barcode_freq, secondary_topk, whitelist_neighbours, whitelist_within, listed_barcodes, text_lengths, mutate_and_check,
        correct_ties, correct_barcodes, read_molecules, molecule_cells, paf_tags, read_length_stats, renamed_reads, demultiplex)}


_READS, _MIXED, _SIGS = fixtures.duck(fixtures.READS), fixtures.duck(fixtures.MIXED), fixtures.duck(fixtures.SIGNATURES)
_F = len(fixtures.FORWARD)
_CODE = "list_reduce(list_prepend(0::BIGINT, list_transform(string_split({0}, ''), lambda x: CASE x WHEN 'C' THEN 1::BIGINT WHEN 'T' THEN 2 WHEN 'G' THEN 3 ELSE 0 END)), lambda a, x: a * 4 + x)"
_TEXT = "list_aggregate(list_transform(range({1} - 1, -1, -1), lambda i: substr('ACTG', CAST(({0} >> CAST(2 * i AS INT)) & 3 AS INT) + 1, 1)), 'string_agg', '')"
_BARCODES = f"""r AS ({_READS}), w AS (SELECT DISTINCT {_CODE.format("true_barcode")} AS whitelist_bcs FROM r),
t AS (SELECT rid, cell, true_barcode, CASE WHEN rid % 2 = 1 THEN reverse(translate(seq, 'ACGT', 'TGCA')) ELSE seq END AS fwd FROM r),
b0 AS (SELECT rid, cell, true_barcode, substr(fwd, instr(fwd, '{fixtures.FORWARD}') + {_F}, 16) AS barcode, substr(fwd, instr(fwd, '{fixtures.FORWARD}') + {_F + 16}, 12) AS umi FROM t WHERE instr(fwd, '{fixtures.FORWARD}') > 0),
b AS (SELECT *, {_CODE.format("barcode")} AS code FROM b0)"""
_TIES = f"b AS (SELECT *, {_CODE.format('barcode')} AS code FROM ({fixtures.duck(fixtures.TIES)})), w AS (SELECT {_CODE.format('barcode')} AS whitelist_bcs FROM ({fixtures.duck(fixtures.TIE_LIST)}))"
_HAM = "CAST(bit_count((xor({0}, {1}) | (xor({0}, {1}) >> 1)) & 1431655765) AS INT)"
_POLY = "CASE WHEN length(seq) >= 16 THEN list_filter(range(1, length(seq) - 14), lambda i: 16 - length(replace(substr(upper(seq), i, 16), '{0}', '')) >= 12) END"
_Q = """q AS (SELECT o_orderkey AS id, o_custkey AS c, k FROM orders, range(0, 4) t(k)),
s AS (SELECT id, 'q' || k AS query_id, CAST(CASE WHEN (c % 3 = 0 AND k < 2) OR (c % 3 = 1 AND k > 1) THEN 0 ELSE 5 + (id + c * k) % 7 END AS INT) AS d FROM q),
f AS (SELECT id FROM s WHERE query_id IN ('q0', 'q1') GROUP BY id HAVING bool_and(d = 0)), v AS (SELECT id FROM s WHERE query_id IN ('q2', 'q3') GROUP BY id HAVING bool_and(d = 0)),
o AS (SELECT * FROM s WHERE query_id IN ('q2', 'q3') AND id IN (FROM f) UNION ALL SELECT * FROM s WHERE query_id IN ('q0', 'q1') AND id IN (FROM v))"""
_PIECE = "coalesce(TRY_CAST(nullif(regexp_extract(sig, '(?:^|\\|){0}:([0-9]+):([0-9]+):([0-9]+)', {1}), '') AS INT), NULL)"


def _piece(name: str, group: int) -> str:
    return _PIECE.format(name, group)


_CLASS = f"""p AS (SELECT rid, {_piece("forw_primer", 1)} AS f, {_piece("rc_forw_primer", 1)} AS rf, {_piece("rev_primer", 1)} AS r, {_piece("rc_rev_primer", 1)} AS rr,
  {_piece("forw_primer", 3)} AS f_stop, {_piece("rc_forw_primer", 2)} AS rf_start, {_piece("poly_t", 3)} AS t_stop, {_piece("poly_a", 2)} AS a_start, {_piece("poly_a", 3)} AS a_stop, {_piece("rev_primer", 2)} AS r_start, {_piece("rc_rev_primer", 3)} AS rr_stop, {_piece("rev_primer", 3)} AS r_stop, {_piece("rc_rev_primer", 2)} AS rr_start FROM ({_SIGS})),
c AS (SELECT *, CASE WHEN coalesce((rf IS NULL OR rf >= 7) AND f <= 7 AND (rf IS NULL OR f < rf), false) OR coalesce(f <= 7 AND rf <= 7 AND (r IS NULL OR r <= 11) AND f < r, false) THEN 'forward'
  WHEN coalesce((f IS NULL OR f >= 7) AND rf <= 7 AND (f IS NULL OR rf < f), false) OR coalesce(f <= 7 AND rf <= 7 AND (rr IS NULL OR rr <= 11) AND rf < rr, false) THEN 'reverse'
  WHEN coalesce(f <= 7 AND rf <= 7 AND t_stop IS NOT NULL AND a_start IS NOT NULL, false) THEN 'rescuable_concatenates' ELSE 'undecided' END AS category FROM p)"""
_NEAR = f"pairs AS (SELECT c.code, w.whitelist_bcs AS target, {_HAM.format('c.code', 'w.whitelist_bcs')} AS bases FROM (SELECT DISTINCT code FROM b WHERE code NOT IN (FROM w)) c, w WHERE bit_count(xor(c.code, w.whitelist_bcs)) BETWEEN 1 AND {{0}} AND {_HAM.format('c.code', 'w.whitelist_bcs')} <= 4)"
_QSET = "list_distinct(list_transform(range(1, length({0})), lambda i: substr({0}, i, 2)))"


def oracle_sql() -> dict[str, str]:
    best = f"best AS (SELECT * FROM pairs QUALIFY bases = min(bases) OVER (PARTITION BY code))"
    jac = lambda a, b: f"1 - len(list_intersect({_QSET.format(a)}, {_QSET.format(b)})) / len(list_distinct(list_concat({_QSET.format(a)}, {_QSET.format(b)})))"
    return {
        "cell_umi_counts": f"WITH {_BARCODES} SELECT barcode, count(*) AS reads, count(DISTINCT umi) AS umis FROM b WHERE code IN (FROM w) GROUP BY barcode",
        "revcomp_reads": f"SELECT rid, reverse(translate(seq, 'ACGTacgt', 'TGCAtgca')) AS rc FROM ({_MIXED})",
        "encode_barcodes": f"WITH {_BARCODES} SELECT rid, code, lpad(bin(code), 32, '0') AS bits FROM b",
        "decode_barcodes": f"WITH {_BARCODES} SELECT rid, {_TEXT.format('code', 16)} AS barcode, {_TEXT.format('code', 8)} AS tail FROM b",
        "distances": f"WITH {_BARCODES}, d AS (SELECT *, {_CODE.format('true_barcode')} AS tc FROM b) SELECT rid, {_HAM.format('code', 'tc')} AS bases, CAST(bit_count(xor(code, tc)) AS INT) AS bits, list_filter(range(1, 17), lambda i: substr(barcode, i, 1) <> substr(true_barcode, i, 1)) AS places, {jac('barcode', 'true_barcode')} AS qgram FROM d",
        "phred_scores": f"SELECT rid, list_transform(string_split(translate(seq, 'ACGTN', '!+5?I'), ''), lambda x: ascii(x) - 33) AS scores, id AS name, id AS origin, printf('%.6f', rid / 7) AS text FROM ({_MIXED})",
        "poly_tail_scan": f"WITH m AS (SELECT rid, {_POLY.format('T')} AS t, {_POLY.format('A')} AS a FROM ({_MIXED})) SELECT rid, list_min(t) AS t_start, list_max(t) + 15 AS t_stop, list_min(a) AS a_start, list_max(a) + 15 AS a_stop FROM m",
        "poly_runs": f"SELECT rid, regexp_extract_all(seq, 'T{{12,}}') AS runs, len(list_distinct(string_split(seq, 'TT'))) < len(string_split(seq, 'TT')) AS repeated FROM ({_MIXED})",
        "bit_flips": f"WITH {_BARCODES} SELECT code, list_sort(list_transform(range(0, 32), lambda k: xor(code, 1::BIGINT << CAST(k AS INT)))) AS flips FROM (SELECT DISTINCT code FROM b)",
        "lower_bounds": f"WITH {_Q} SELECT query_id, avg(d) AS null_distance, stddev_samp(d) AS sd_null, CAST(floor(avg(d) - ceil(stddev_samp(d))) AS DOUBLE) AS lower_bound FROM o GROUP BY query_id",
        "calibration_rows": f"WITH {_Q} SELECT id, query_id, d AS best_edit_distance FROM o",
        "layout_expand": """SELECT * FROM (VALUES
            ('forw_primer', 'CTACACGACGCTCTTCCGATCT', 22, 'flanking_adapter', 1, 'forward'), ('barcode', NULL, 16, 'barcode', 2, 'forward'), ('umi', NULL, 12, 'umi', 3, 'forward'), ('poly_t', 'T{12,}+', 12, 'poly_t', 4, 'forward'),
            ('read', NULL, NULL, 'read', 5, 'forward'), ('rev_primer', 'CCCATGTACTCTGCGTTGATACCACTGCTT', 30, 'adapter', 6, 'forward'), ('rc_forw_primer', 'AGATCGGAAGAGCGTCGTGTAG', 22, 'flanking_adapter', 7, 'reverse'),
            ('rc_barcode', NULL, 16, 'barcode', 8, 'reverse'), ('rc_umi', NULL, 12, 'umi', 9, 'reverse'), ('poly_a', 'A{12,}+', 12, 'poly_a', 10, 'reverse'), ('rc_read', NULL, NULL, 'read', 11, 'reverse'),
            ('rc_rev_primer', 'AAGCAGTGGTATCAACGCAGAGTACATGGG', 30, 'adapter', 12, 'reverse')) t(id, seq, expected_length, type, "order", direction)""",
        "signature_parse": f"WITH e AS (SELECT rid, unnest(string_split(sig, '|')) AS p FROM ({_SIGS})) SELECT rid, 'forward' AS category, string_split(p, ':')[1] AS id, CAST(string_split(p, ':')[2] AS INT) AS ed, CAST(string_split(p, ':')[3] AS INT) AS start, CAST(string_split(p, ':')[4] AS INT) AS stop FROM e",
        "signature_classify": f"WITH {_CLASS} SELECT rid, category FROM c",
        "signature_annotate": f"""WITH {_CLASS} SELECT rid, CASE WHEN f <= 7 THEN f_stop + 1 END AS barcode_start, CASE WHEN f <= 7 THEN f_stop + 16 END AS barcode_stop, CASE WHEN f <= 7 THEN f_stop + 17 END AS umi_start, CASE WHEN f <= 7 THEN f_stop + 28 END AS umi_stop,
            CASE WHEN rf <= 7 THEN rf_start - 16 END AS rc_barcode_start, CASE WHEN rf <= 7 THEN rf_start - 1 END AS rc_barcode_stop, CASE WHEN rf <= 7 THEN rf_start - 28 END AS rc_umi_start, CASE WHEN rf <= 7 THEN rf_start - 17 END AS rc_umi_stop,
            CASE category WHEN 'forward' THEN coalesce(t_stop, f_stop + 28) + 1 WHEN 'rescuable_concatenates' THEN t_stop + 1 ELSE CASE WHEN t_stop IS NOT NULL THEN 0 END END AS read_start,
            CASE category WHEN 'forward' THEN CASE WHEN r <= 11 THEN r_start - 1 ELSE 0 END WHEN 'rescuable_concatenates' THEN r_start - 1 ELSE CASE WHEN t_stop IS NOT NULL THEN 100 END END AS read_stop,
            CASE category WHEN 'reverse' THEN CASE WHEN rr <= 11 THEN rr_stop + 1 ELSE 1 END WHEN 'rescuable_concatenates' THEN r_stop + 1 ELSE CASE WHEN a_start IS NOT NULL THEN 0 END END AS rc_read_start,
            CASE category WHEN 'reverse' THEN a_start - 1 WHEN 'rescuable_concatenates' THEN rr_start - 1 ELSE CASE WHEN a_start IS NOT NULL THEN 100 END END AS rc_read_stop FROM c""",
        "whitelist_check": f"WITH {_BARCODES} SELECT rid, code IN (FROM w) AS listed FROM b",
        "barcode_freq": f"WITH {_BARCODES} SELECT code AS whitelist_bcs, count(*) AS freq FROM b WHERE code IN (FROM w) GROUP BY code",
        "secondary_topk": f"WITH {_BARCODES} SELECT code AS whitelist_bcs, count(*) AS freq FROM b WHERE code IN (FROM w) GROUP BY code ORDER BY freq DESC, code LIMIT 100",
        "whitelist_neighbours": f"WITH {_BARCODES}, {_NEAR.format(6)}, {best} SELECT code, target, bases FROM best",
        "mutate_and_check": f"WITH {_BARCODES}, m AS (SELECT c.code, w.whitelist_bcs AS target FROM (SELECT DISTINCT code FROM b) c LEFT JOIN w ON bit_count(xor(c.code, w.whitelist_bcs)) <= 6) SELECT code, coalesce(string_agg(CAST(target AS VARCHAR), ',' ORDER BY target), '') AS matches FROM m GROUP BY code",
        "correct_barcodes": f"""WITH {_BARCODES}, {_NEAR.format(4)}, {best}, one AS (SELECT code, min(target) AS target, min(bases) AS bases FROM best GROUP BY code HAVING count(*) = 1)
            SELECT rid, '@r' || rid || '*' || CASE WHEN target IS NULL THEN '' ELSE '{{orig_hamming_' || barcode || '_' || {_TEXT.format('target', 16)} || ':' || bases || '}}' END AS sig_id, CASE WHEN target IS NULL THEN barcode ELSE {_TEXT.format('target', 16)} END AS barcode FROM b LEFT JOIN one USING (code)""",
        "bit_flips_two": f"WITH {_BARCODES}, m AS (SELECT list(DISTINCT (1::BIGINT << CAST(i AS INT)) | (1::BIGINT << CAST(j AS INT))) AS m FROM range(0, 32) a(i), range(0, 32) b(j)) SELECT code, list_sort(list_transform(m, lambda x: xor(code, x))) AS flips FROM (SELECT DISTINCT code FROM b), m",
        "align_modes": alignment_sql.modes(_MIXED),
        "align_long": alignment_sql.long(_MIXED),
        "align_reads": f"SELECT rid, CAST(levenshtein(m.seq, r.seq) AS INT) AS distance FROM ({_MIXED}) m JOIN ({_READS}) r USING (rid)",
        "align_paths": alignment_sql.paths(_MIXED),
        "align_empty": f"""WITH e AS (SELECT rid, rid % 4 AS k, CASE rid % 4 WHEN 0 THEN 0 WHEN 1 THEN rid % 7 WHEN 2 THEN length(seq) END AS n FROM ({_MIXED}))
            SELECT rid, CAST(CASE k WHEN 2 THEN n WHEN 3 THEN NULL ELSE {_F} END AS INT) AS global_distance, CASE WHEN k < 3 THEN [CAST(n AS INT)] END AS global_stops, CASE k WHEN 2 THEN 0 WHEN 3 THEN NULL ELSE {_F} END AS prefix_distance,
            CASE k WHEN 2 THEN [0::INT] WHEN 3 THEN NULL ELSE range(0, n + 1)::INT[] END AS prefix_stops, CASE k WHEN 2 THEN 0 WHEN 3 THEN NULL ELSE {_F} END AS infix_distance, CASE k WHEN 2 THEN [0::INT] WHEN 3 THEN NULL ELSE range(0, n + 1)::INT[] END AS infix_stops FROM e""",
        "error_bounds": f"""WITH {_Q}, fl AS (SELECT id, bool_and(d = 0) FILTER (query_id IN ('q0', 'q1')) AS all_f, bool_and(d <> 0) FILTER (query_id IN ('q0', 'q1')) AS none_f, bool_and(d = 0) FILTER (query_id IN ('q2', 'q3')) AS all_r, bool_and(d <> 0) FILTER (query_id IN ('q2', 'q3')) AS none_r FROM s GROUP BY id),
            eb AS (SELECT query_id, d FROM s JOIN fl USING (id) WHERE query_id IN ('q2', 'q3') AND all_f AND none_r OR query_id IN ('q0', 'q1') AND all_r AND none_f)
            SELECT query_id, CAST(ceil(avg(d) + stddev_samp(d)) AS BIGINT) AS upper, CAST(floor(avg(d) - stddev_samp(d)) AS BIGINT) AS lower FROM eb GROUP BY query_id""",
        "whitelist_within": f"WITH {_BARCODES}, {_NEAR.format(6)} SELECT code, target, bases FROM pairs",
        "read_molecules": f"""WITH c AS ({fixtures.duck(fixtures.CHAINS)}), m AS (SELECT rid, unnest(list_filter([rid, r1, r2, r3], lambda x: x IS NOT NULL)) AS r, unnest(range(1, 2 + CAST(r1 IS NOT NULL AS INT) + CAST(r2 IS NOT NULL AS INT) + CAST(r3 IS NOT NULL AS INT)))::INT AS number FROM c)
            SELECT rid, number, CASE r % 2 WHEN 1 THEN 'reverse' ELSE 'forward' END AS strand, CAST(216 * (number - 1) + 11 AS INT) AS start, CAST(216 * (number - 1) + 206 AS INT) AS stop, 0 AS distance FROM m""",
        "molecule_cells": _molecules_sql(),
        "listed_barcodes": f"WITH {_BARCODES} SELECT rid, '@r' AS sig_id, barcode FROM b WHERE code IN (FROM w)",
        "text_lengths": "SELECT doc_id, length(text) AS chars, octet_length(encode(text)) AS bytes, regexp_extract_all(text, 'e{3,}') AS runs FROM documents",
        "align_locations": alignment_sql.locations(_MIXED),
        "batch_categories": alignment_sql.batches(_MIXED, BOUNDS),
        "align_stats": alignment_sql.align_stats(_MIXED),
        "null_distance": alignment_sql.null_distance(_READS),
        "align_signatures": alignment_sql.align_signatures(_MIXED, NULL, _POLY),
        "correct_ties": f"""WITH {_TIES}, {_NEAR.format(4)}, {best}, f AS (SELECT code AS target, count(*) AS freq FROM b WHERE code IN (FROM w) GROUP BY code),
            sc AS (SELECT code, target, bases, coalesce(freq, 0) AS freq, count(*) OVER (PARTITION BY code) AS n, max(coalesce(freq, 0)) OVER (PARTITION BY code) AS most FROM best LEFT JOIN f USING (target)),
            ld AS (SELECT *, count(*) FILTER (freq = most) OVER (PARTITION BY code) AS leaders FROM sc),
            tx AS (SELECT *, {_TEXT.format('code', 16)} AS c, {_TEXT.format('target', 16)} AS t FROM ld WHERE n > 1 AND leaders > 1),
            td AS (SELECT *, {jac('c', 't')} AS d FROM tx), tb AS (SELECT * FROM td QUALIFY d = min(d) OVER (PARTITION BY code)), tn AS (SELECT *, count(*) OVER (PARTITION BY code) AS k FROM tb),
            few AS (SELECT * FROM f ORDER BY freq DESC, target LIMIT 5000),
            ar AS (SELECT tn.code, few.target, few.freq, {_HAM.format('tn.target', 'few.target')} AS h FROM tn, few WHERE k > 1 AND bit_count(xor(tn.target, few.target)) BETWEEN 1 AND 4 AND {_HAM.format('tn.target', 'few.target')} <= tn.bases),
            ex AS (SELECT * FROM ar QUALIFY row_number() OVER (PARTITION BY code ORDER BY h, freq DESC, target) = 1)
            SELECT code, target, CASE WHEN n = 1 THEN 'hamming' ELSE 'minilist' END AS how, CASE WHEN n = 1 THEN CAST(bases AS DOUBLE) END AS value FROM ld WHERE n = 1 OR leaders = 1 AND freq = most
            UNION ALL SELECT code, target, 'jaccard', d FROM tn WHERE k = 1 UNION ALL SELECT code, target, 'extended', NULL FROM ex""",
        "paf_tags": """WITH l AS (SELECT l_orderkey || '_' || l_linenumber AS id, l_orderkey AS k, l_linenumber AS n FROM lineitem)
            SELECT id, '216' AS ql, CASE WHEN n % 2 = 0 THEN '+' END AS qr, 'chr' || n AS sn, CAST(k AS VARCHAR) AS mq, CASE k % 3 WHEN 0 THEN 'NM:i:3' WHEN 1 THEN 'NM:i:4' END AS "NM", CASE k % 3 WHEN 0 THEN 'ms:i:' || n WHEN 2 THEN 'ms:i:' || k END AS ms, CASE k % 3 WHEN 0 THEN 'tp:A:P' WHEN 1 THEN 'tp:A:S' END AS tp FROM l""",
        "demultiplex": demux_sql(_MIXED),
        "read_length_stats": f"SELECT count(*) AS num_seqs, CAST(sum(length(seq)) AS BIGINT) AS sum_len, min(length(seq)) AS min_len, avg(length(seq)) AS avg_len, max(length(seq)) AS max_len FROM ({_MIXED})",
        "extract_reads": _extract_sql(),
        "renamed_reads": f"SELECT id || '_' || umi || '_' || barcode AS id, filtered_read AS seq, repeat('I', n_filtered_qc) AS qual FROM ({_extract_sql()})",
    }


def demux_sql(reads: str) -> str:
    """Counts of each barcode after a run over reads, without distances of base pairs."""
    return f"WITH {_run(reads)} SELECT barcode, count(*) AS reads, count(DISTINCT umi) AS umis FROM fx GROUP BY barcode"


def run_sql(reads: str) -> str:
    """Lines of a run's output: signatures, barcodes after correction, and names of the reads on the list; how often each occurs."""
    return f"""WITH {_run(reads)}, o AS (SELECT 'sigsummary' AS output, line FROM y UNION ALL SELECT 'all_barcodes', barcode FROM al UNION ALL SELECT 'filtered_reads', '@r' || id || '_' || umi || '_' || barcode FROM fx)
SELECT output, line, count(*) AS n FROM o GROUP BY output, line"""


def counters_sql(reads: str) -> str:
    """Counts of a run's stages."""
    kinds = ", ".join(f"(SELECT count(*) FROM y WHERE suffix(line, '<{c}>')) AS {c}" for c in ("forward", "reverse", "rescuable_concatenates", "undecided"))
    return f"""WITH {_run(reads)}, n AS (SELECT code, count(*) AS k FROM best GROUP BY code), w2 AS (SELECT tg.code, n.k FROM tg JOIN n USING (code)),
c AS (SELECT (SELECT count(*) FROM ({reads})) AS reads, (SELECT count(*) FROM ({reads}) WHERE length(seq) < 150) AS short, {kinds}, (SELECT count(*) FROM x) AS cut, (SELECT count(*) FROM b WHERE code IN (FROM w)) AS listed,
  (SELECT count(*) FROM b JOIN w2 USING (code) WHERE k = 1) AS hamming, (SELECT count(*) FROM b JOIN w2 USING (code) WHERE k > 1) AS minilist, 0 AS jaccard, 0 AS extended, (SELECT count(*) FROM fx) AS kept)
SELECT counter, CAST(n AS BIGINT) AS n FROM (UNPIVOT (SELECT COLUMNS(*)::BIGINT FROM c) ON COLUMNS(*) INTO NAME counter VALUE n)"""


def _run(reads: str) -> str:
    return f"""{alignment_sql.signature_lines(reads, _POLY)}, w AS (SELECT DISTINCT {_CODE.format("true_barcode")} AS whitelist_bcs FROM ({_READS})), xb AS (SELECT *, CASE WHEN barcode <> 'undecided' THEN {_CODE.format("barcode")} END AS code FROM x),
b AS (SELECT * FROM xb WHERE code IS NOT NULL), {_NEAR.format(4)}, best AS (SELECT * FROM pairs QUALIFY bases = min(bases) OVER (PARTITION BY code)),
fr AS (SELECT code AS target, count(*) AS freq FROM b WHERE code IN (FROM w) GROUP BY code), sc AS (SELECT best.code, target, coalesce(freq, 0) AS freq, max(coalesce(freq, 0)) OVER (PARTITION BY best.code) AS most FROM best LEFT JOIN fr USING (target)),
tg AS (SELECT code, any_value(target) AS target FROM sc WHERE freq = most GROUP BY code HAVING count(*) = 1),
al AS (SELECT id, umi, b.code, target, coalesce({_TEXT.format("tg.target", 16)}, b.barcode) AS barcode FROM b LEFT JOIN tg ON tg.code = b.code UNION ALL SELECT id, umi, NULL, NULL, barcode FROM xb WHERE code IS NULL),
fx AS (SELECT id, umi, barcode FROM al WHERE code IS NOT NULL AND (target IS NOT NULL OR code IN (FROM w)))"""


def _molecules_sql() -> str:
    """Each part of a chain as a read of its own: whole reads of 216 bases, but for what a part has of its neighbours' ends."""
    parts = f"""SELECT rid * 10 + k AS rid, substr(seq, CASE WHEN k = 0 THEN 1 ELSE 216 * k - 9 END, CASE WHEN n = 1 THEN 216 WHEN k = 0 THEN 206 WHEN k = n - 1 THEN 226 ELSE 216 END) AS seq
      FROM (SELECT *, unnest(range(0, n)) AS k FROM (SELECT rid, seq, length(seq) // 216 AS n FROM ({fixtures.duck(fixtures.CHAINS)})))"""
    known = " UNION ALL ".join(f"SELECT '{n}' AS query_id, {m} AS mean, {s} AS sd" for n, (m, s) in NULL.items())
    return f"""WITH {alignment_sql.extracted(parts, _POLY, known)}, w AS (SELECT DISTINCT {_CODE.format("true_barcode")} AS whitelist_bcs FROM ({_READS})),
fx AS (SELECT barcode, umi FROM x WHERE barcode <> 'undecided' AND {_CODE.format("barcode")} IN (FROM w)) SELECT barcode, count(*) AS reads, count(DISTINCT umi) AS umis FROM fx GROUP BY barcode"""


def _extract_sql() -> str:
    """Barcode 33-48, tag 49-60 and insert up to 176 of the forward strand; the insert of a cut read is one base short."""
    turn = lambda s: f"reverse(translate({s}, 'ACGT', 'TGCA'))"
    r = f"(SELECT id, rid, CASE WHEN rid % 2 = 1 THEN {turn('seq')} ELSE seq END AS fwd, CASE WHEN rid % 6 = 2 THEN seq || {turn('seq')} ELSE seq END AS seq FROM ({_READS}))"
    row = lambda split, part, read: f"SELECT id, {split} AS split, '{part}' AS part, substr(fwd, 33, 16) AS barcode, 16 AS n_qc, substr(fwd, 49, 12) AS umi, {read} AS filtered_read, CAST(length({read}) AS INT) AS n_filtered_qc FROM {r}"
    return " UNION ALL ".join([
        row("false", "forward", "substr(seq, 86, 91)") + " WHERE rid % 2 = 0 AND rid % 6 <> 2",
        row("false", "reverse", "substr(seq, 42, 91)") + " WHERE rid % 2 = 1",
        row("true", "forward", "substr(seq, 85, 92)") + " WHERE rid % 6 = 2",
    ])
