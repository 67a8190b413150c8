import random

from pyspark.sql import functions as F

from strandloom.functions import sequence as S


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_hand_made_cases(spark):
    r = one(
        spark, rc=S.revcomp(F.lit("AACGTN")), null=S.revcomp(F.lit(None).cast("string")), code=S.encode(F.lit("ACTG")), odd=S.encode(F.lit("undecided")), text=S.decode(F.lit(27).cast("bigint")),
        ham=S.base_distance(F.lit(27).cast("bigint"), F.lit(228).cast("bigint")), q=S.qgram_distance(F.lit("ACGTACGTACGTACGA"), F.lit("ACGTACGTACGTACGT")), phred=S.phred(F.lit("I!")), empty=S.phred(F.lit("")),
        places=S.mismatch_positions(F.lit("ACGT"), F.lit("AGGA")), star=S.before_star(F.lit("r1*x*y")), head=S.header_id(F.lit("@a b c")), dec=S.decimals(F.lit(0.2)), bits=S.bit_string(F.lit(27).cast("bigint"), 4),
        best=S.best_qgram_matches(F.lit("ACGT"), F.array(F.lit("ACGA"), F.lit("TTTT"), F.lit("ACGT"))))
    assert (r.rc, r.null, r.code, r.odd, r.text) == ("NACGTT", None, 27, 0, "AAAAAAAAAAAAACTG")
    assert r.ham == 4 and abs(r.q - 0.2) < 1e-12 and r.phred == [40, 0] and r.empty == [] and r.places == [2, 4]
    assert (r.star, r.head, r.dec, r.bits, r.best) == ("r1", "@a", "0.200000", "00011011", ["ACGT"])


def test_round_trips(spark):
    rng = random.Random(1)
    words = ["".join(rng.choice("ACGT") for _ in range(16)) for _ in range(300)]
    rows = spark.createDataFrame([(w,) for w in words], "b string").select("b", S.decode(S.encode("b")).alias("d"), S.revcomp(S.revcomp("b")).alias("r"), S.flips(S.encode("b"), 2).alias("f")).collect()
    assert all(r.b == r.d == r.r and len(set(r.f)) == 32 + 32 * 31 // 2 for r in rows)


def test_poly_tail_equals_scan(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice("TTTTTACG") for _ in range(rng.randint(0, 60))) for _ in range(200)] + ["", "t" * 16]
    rows = spark.createDataFrame([(t,) for t in texts], "s string").select("s", S.poly_tail("s", "T").alias("p")).collect()
    from strandloom.functions.alignment import tails

    for r in rows:
        hits = [i for i in range(len(r.s) - 15) if r.s[i : i + 16].upper().count("T") >= 12]
        want = (hits[0] + 1, hits[-1] + 16) if hits else None
        assert (tuple(r.p) if r.p else None) == want
        assert tuple(tails("T", [r.s.encode()])[0]) == (want or (-1, -1))
