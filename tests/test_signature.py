import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from strandloom.operators import calibrate, correct, extract, onepass, signature
from strandloom.plans import layout
from strandloom.queries import BOUNDS

PLAN = layout.kit("three")


def annotated(spark, texts):
    d = spark.createDataFrame(list(enumerate(texts)), "k int, sig string").select("k", signature.parse("sig").alias("signature"))
    rows = signature.annotate(d, PLAN, BOUNDS).select("k", signature.render("signature", "category").alias("s")).orderBy("k").collect()
    return [r.s for r in rows]


def test_layout():
    pieces = {p.id: p for p in PLAN.layout}
    assert pieces["forw_primer"].type == "flanking_adapter" and pieces["rc_forw_primer"].seq == "AGATCGGAAGAGCGTCGTGTAG"
    assert [p.order for p in PLAN.layout] == list(range(1, 13)) and pieces["poly_a"].direction == "reverse" and PLAN.barcode_length == 16


def test_annotation_by_hand(spark):
    got = annotated(spark, [
        "forw_primer:0:11:32|poly_t:0:57:84|rev_primer:0:177:206|rc_forw_primer:9:100:121",
        "rc_rev_primer:0:11:40|poly_a:0:133:160|rc_forw_primer:0:185:206|forw_primer:9:60:81",
        "forw_primer:9:5:26|rc_forw_primer:9:90:111",
        "",
    ])
    assert got[0] == "forw_primer:0:11:32|barcode:0:33:48|umi:0:49:60|poly_t:0:57:84|read:0:85:176|rev_primer:0:177:206|rc_forw_primer:9:100:121<forward>"
    assert got[1].endswith("<reverse>") and "rc_read:0:41:132" in got[1] and "rc_barcode:0:169:184" in got[1]
    assert got[2].endswith("<undecided>") and got[3] == "<undecided>"


def test_later_duplicate_wins(spark):
    assert "forw_primer:0:20:41" in annotated(spark, ["forw_primer:5:1:22|forw_primer:0:20:41|rc_forw_primer:9:50:71"])[0]


def test_extraction(spark):
    seq = "".join(random.Random(1).choice("ACGT") for _ in range(216))
    d = spark.createDataFrame([("@a", seq, "I" * 216, "forw_primer:0:11:32|poly_t:0:57:84|rev_primer:0:177:206|rc_forw_primer:9:100:121"), ("@b", None, None, "")], "id string, seq string, qual string, sig string")
    d = signature.annotate(d.select("id", "seq", "qual", signature.parse("sig").alias("signature")), PLAN, BOUNDS)
    (r,) = extract.extract(d).collect()
    assert (r.barcode, r.umi, r.filtered_read, len(r.filtered_qc)) == (seq[32:48], seq[48:60], seq[85:176], 91)
    assert extract.extract(d, exact_coords=True).first().filtered_read == seq[84:176]


def test_correction_decisions(spark):
    """Against the rule spelt out over all pairs, on six-base codes, where ties abound."""
    rng = random.Random(5)
    known = sorted(rng.sample(range(4096), 150))
    freq = {k: rng.randint(1, 4) for k in known if rng.random() < 0.8}
    odd = [c for c in range(0, 4096, 13) if c not in known]
    ham = lambda a, b: sum(((a ^ b) >> 2 * k & 3) > 0 for k in range(6))
    bits = lambda a, b: (a ^ b).bit_count()
    text = lambda c: "".join("ACTG"[c >> 2 * k & 3] for k in range(5, -1, -1))
    grams = lambda s: {s[i : i + 2] for i in range(5)}
    jac = lambda a, b: 1 - len(grams(text(a)) & grams(text(b))) / len(grams(text(a)) | grams(text(b)))
    top = sorted(freq, key=lambda k: (-freq[k], k))[:40]
    want = {}
    for b in odd:
        near = [w for w in known if 1 <= bits(w, b) <= 3 and ham(w, b) <= 3]
        if not near:
            continue
        h = min(ham(w, b) for w in near)
        near = [w for w in near if ham(w, b) == h]
        most = max(freq.get(w, 0) for w in near)
        lead = [w for w in near if freq.get(w, 0) == most]
        if len(near) == 1:
            want[b] = (near[0], "hamming")
        elif len(lead) == 1:
            want[b] = (lead[0], "minilist")
        else:
            least = min(jac(b, w) for w in near)
            tied = [w for w in near if jac(b, w) == least]
            if len(tied) == 1:
                want[b] = (tied[0], "jaccard")
                continue
            around = [(ham(w, j), w) for j in tied for w in top if 1 <= bits(w, j) <= 3 and ham(w, j) <= h]
            if around:
                d = min(x for x, _ in around)
                want[b] = (min((w for x, w in around if x == d), key=lambda w: (-freq[w], w)), "extended")
    frame = lambda rows, s: spark.createDataFrame(rows, s)
    got = correct.decide(frame([(c,) for c in odd], "code bigint"), frame([(k,) for k in known], "whitelist_bcs bigint"), frame(list(freq.items()), "whitelist_bcs bigint, freq bigint"), True, 3, 3, 6, 40)
    assert {r.code: (r.target, r.how) for r in got.collect()} == want and {"hamming", "minilist", "jaccard"} <= {h for _, h in want.values()}


def test_calibration(spark):
    rows = [("a", "f", 0), ("a", "r", 8), ("b", "f", 0), ("b", "r", 9), ("c", "f", 3), ("c", "r", 0)]
    stats = spark.createDataFrame(rows, "id string, query_id string, best_edit_distance int")
    null = {r.query_id: (r.null_distance, r.sd_null) for r in calibrate.calibrate(stats, ["f"], ["r"]).collect()}
    assert null["r"] == (8.5, 0.5**0.5) and null["f"] == (3.0, None)
    assert calibrate.bounds_of(null) == {"r": 7.0} and calibrate.calibrate(stats, ["f"], ["r"], "graphics").count() == 3


def test_neighbours_however_they_are_looked_up(spark, monkeypatch):
    """By changes, by comparison and by joins, against all pairs; and changes tried are those there are."""
    import random

    import numpy as np

    from strandloom.operators import correct, lookup

    rng = random.Random(41)
    for bits, bases, length in ((4, 4, 6), (3, 3, 8), (6, 4, 6), (2, 1, 5)):
        known = sorted({rng.randrange(1 << 2 * length) for _ in range(60)})
        codes = sorted({c ^ (1 << rng.randrange(2 * length)) for c in known[::3]} | {rng.randrange(1 << 2 * length) for _ in range(40)})
        low = sum(1 << 2 * k for k in range(length))
        pairs = [(c, k, ((c ^ k | (c ^ k) >> 1) & low).bit_count()) for c in codes for k in known if 1 <= (c ^ k).bit_count() <= bits]
        pairs = [p for p in pairs if p[2] <= bases]
        close = [p for p in pairs if p[2] == min(q[2] for q in pairs if q[0] == p[0])]
        ready = lookup.known_of(np.array(known, np.int64))
        for nearest, want in ((True, close), (False, pairs)):
            for held in (1 << 21, 50):
                monkeypatch.setattr(lookup, "HELD", held)
                for many in (0, 1 << 30):
                    monkeypatch.setattr(lookup, "changes", lambda *a, n=many: n)
                    i, target, far = lookup.near(np.array(codes, np.int64), ready, bits, bases, length, nearest)
                    assert sorted(zip(np.array(codes)[i].tolist(), target.tolist(), far.tolist(), strict=True)) == sorted(want)
            monkeypatch.undo()
        assert lookup.changes(bits, bases, length) == sum(len(lookup._masks(bits, b, length)) for b in range(1, bases + 1))
        table = spark.createDataFrame([(c,) for c in codes], "code bigint"), spark.createDataFrame([(k,) for k in known] + [(None,)], "whitelist_bcs bigint")
        for most in (lookup.MOST_KNOWN, 3):
            monkeypatch.setattr(lookup, "MOST_KNOWN", most)
            got = correct.neighbours(*table, bits, bases, length).collect() if length == 6 else correct.neighbours(*table, bits, bases, length, nearest=False).collect()
            assert sorted(map(tuple, got)) == sorted(close if length == 6 else pairs)
        monkeypatch.undo()


def test_no_pair_is_made_that_is_no_answer(spark):
    """Of a large whitelist, a code meets its true neighbours alone: rows out of the look-up are answers."""
    import numpy as np

    from strandloom.operators import lookup

    rng = np.random.default_rng(5)
    known = lookup.known_of(rng.integers(0, 1 << 32, 300_000))
    codes = rng.integers(0, 1 << 32, 40)
    i, target, _ = lookup.near(codes, known, 4, 4, 16, False)
    x = codes[:, None] ^ known.codes[None, :]
    n = np.bitwise_count(x)
    assert len(i) == int(((n >= 1) & (n <= 4) & (np.bitwise_count((x | x >> 1) & 0x55555555) <= 4)).sum()) and (np.bitwise_count(codes[i] ^ target) <= 4).all()


def test_rules_for_batches_are_the_rules_for_reads():
    """Random signatures, odd ones among them: pieces missing, repeated, placed already, outside the read."""
    import random
    import time

    import numpy as np
    import pyarrow as pa

    from strandloom.operators import signature

    rng = random.Random(51)
    entry = pa.struct([("id", pa.string()), ("ed", pa.int32()), ("start", pa.int32()), ("stop", pa.int32())])
    for kit, bounds in (("three", {"forw_primer": 7.0, "rev_primer": 11.0, "rc_forw_primer": 7.0, "rc_rev_primer": 11.0}), ("five", {"forw_primer": 7.0, "rc_forw_primer": 6.0, "rev_primer": 9.0, "tso": 4.0}), ("three", {"forw_primer": 7.0})):
        t = signature._Table.of(layout.kit(kit), bounds)
        names = [p.id for p in layout.kit(kit).layout if p.id not in ("barcode", "umi", "read", "rc_barcode", "rc_umi", "rc_read")]
        rows = []
        for k in range(4000):
            own = [n for n in names if rng.random() < 0.85] + [rng.choice(names) for _ in range(rng.choice([0, 0, 1]))]
            if k % 40 == 0:
                own += [rng.choice(["barcode", "rc_umi", "read", "other"])]
            places = [(n, rng.choice([0, 1, 3, 7, 8, 12]), start, start + 20) for n in own for start in [rng.choice([-1, 3, 10, 81, 101, 102, rng.randrange(400)])]]
            rows.append(sorted(places, key=lambda e: e[3]))
        rows[7] = []
        want = [signature.annotated(r, t) for r in rows]
        rules, kind = signature._Batch(t), pa.list_(entry)
        flat = pa.array([dict(zip(("id", "ed", "start", "stop"), e, strict=True)) for r in rows for e in r], entry)
        began = time.perf_counter()
        filled, categories = signature._annotated_batch(rules, pa.array(rules.names), flat, np.array([len(r) for r in rows]), kind)
        took = time.perf_counter() - began
        got = [([tuple(e.values()) for e in r], c) for r, c in zip(filled.to_pylist(), categories.to_pylist(), strict=True)]
        assert got == want and len({c for _, c in want}) >= (4 if kit == "three" and len(bounds) > 1 else 2)
        assert took < 0.5


def test_calibration_has_two_modes(spark):
    import pytest

    stats = spark.createDataFrame([("r", "f", 0)], "id string, query_id string, best_edit_distance int")
    for mode in (None, "", "other"):
        with pytest.raises(ValueError, match="stats or graphics"):
            calibrate.calibrate(stats, ["f"], ["r"], mode)


def test_all_within_reach_are_found_by_halves():
    import numpy as np

    from strandloom.operators import lookup

    rng = np.random.default_rng(3)
    for length, n, bits, bases in ((16, 3000, 6, 16), (16, 3000, 6, 4), (8, 500, 6, 8), (6, 300, 5, 3), (4, 60, 1, 4), (4, 60, 0, 4), (4, 60, 8, 4), (10, 0, 4, 4)):
        known = lookup.known_of(rng.integers(0, 1 << 2 * length, n))
        codes = np.unique(np.concatenate([rng.integers(0, 1 << 2 * length, 300), rng.choice(known.codes, 100) ^ 1 if n else known.codes]))
        i, target, far = lookup.near(codes, known, bits, bases, length, False)
        x = codes[:, None] ^ known.codes[None, :]
        apart, wrong = np.bitwise_count(x), np.bitwise_count((x | x >> 1) & sum(1 << 2 * k for k in range(length)))
        a, b = np.nonzero((apart >= 1) & (apart <= bits) & (wrong <= bases))
        assert sorted(zip(i.tolist(), target.tolist(), far.tolist(), strict=True)) == sorted(zip(a.tolist(), known.codes[b].tolist(), wrong[a, b].tolist(), strict=True))
        counts, found = lookup._matches(codes, known, bits, length)
        assert counts.tolist() == (apart <= bits).sum(axis=1).tolist() and found.tolist() == known.codes[np.nonzero(apart <= bits)[1]].tolist()
        if n == 3000:
            one, two = known.by_halves(length)
            assert len(one.places(lookup._flips(length, 3)[0])[0]) + len(two.places(lookup._flips(length, 2)[0])[0]) < n / 40


def test_lists_of_matches_are_made_in_their_tasks(spark):
    codes = spark.createDataFrame([(k,) for k in range(200)] + [(None,)], "code bigint")
    known = spark.createDataFrame([(k * 3,) for k in range(50)] + [(None,)], "whitelist_bcs bigint")
    out = correct.mutate_and_check(codes, known, 2)
    assert {r.code: r.matches for r in out.collect()} == {k: [3 * j for j in range(50) if (k ^ 3 * j).bit_count() <= 2] for k in range(200)}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "collect_set" not in plan


def test_extraction_looks_pieces_up_once_and_cuts_what_is_asked_for(spark):
    rows = [("@a", "ACGT" * 60, "I" * 240, [("barcode", 0, 11, 26), ("umi", 0, 27, 38), ("read", 0, 60, 0)], "forward"), ("@b", "ACGT" * 60, "I" * 240, [("rc_barcode", 0, 101, 116), ("rc_read", 0, 1, 90)], "reverse")]
    rows += [("@c", "ACGT" * 60, "I" * 240, [("barcode", 0, 11, 26), ("read", 0, 40, 100), ("rc_read", 0, 120, 180)], "rescuable_concatenates"), ("@d", None, None, [("read", 0, 1, 5)], "forward"), ("@e", "ACGT", "IIII", [], "undecided")]
    out = extract.extract(spark.createDataFrame(rows, f"id string, seq string, qual string, signature {signature.ENTRY}, category string"))
    assert [(r.sig_id.split("*")[0], r.barcode, r.umi, len(r.filtered_read)) for r in out.orderBy("sig_id").collect()] == [
        ("@a", "GTACGTACGTACGTAC", "GTACGTACGTAC", 180), ("@b", "ACGTACGTACGTACGT", "undecided", 89), ("@c", "GTACGTACGTACGTAC", "undecided", 61), ("@c", "undecided", "undecided", 61)]
    plan = out.select("barcode")._jdf.queryExecution().optimizedPlan().toString()
    assert "concat_ws" not in plan and "qual" not in plan.split("LocalRelation")[0].split("LogicalRDD")[0]


def test_correction_makes_its_whitelist_once(spark):
    """Membership, the count and what is sent to the tasks read one written table."""
    made = spark.sparkContext.accumulator(0)

    def through(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    from strandloom.operators import correct

    known = spark.createDataFrame([(k * 4097,) for k in range(50)], "whitelist_bcs bigint").mapInArrow(through, "whitelist_bcs bigint")
    reads = spark.createDataFrame([("@a", "A" * 16), ("@b", "A" * 15 + "C"), ("@c", "undecided")], "sig_id string, barcode string")
    got = correct.correct(reads, known).collect()
    assert sorted(r.barcode for r in got) == ["A" * 16, "A" * 16, "undecided"] and made.value == 50


def test_parts_cut_in_a_batch_are_those_of_columns(spark):
    """Of any pieces at any places, two inserts too; sequences with letters of several bytes; qualities that are short or missing."""
    r = random.Random(11)
    names, rows = [p.id for p in PLAN.layout], []
    for k in range(1500):
        n = r.choice((0, 40, 90))
        seq = "".join(r.choice("ACGTNacgt" + "é" * (k % 3 == 0)) for _ in range(n))
        place = lambda: sorted((r.randrange(-3, n + 4), r.randrange(-3, n + 4)))  # noqa: B023, E731
        entries = [(name, 0, *place()) for name in names if r.random() < 0.8]
        entries = [(name, 0, a, min(b, a + 30) if "barcode" in name else b) for name, _, a, b in entries]
        if k % 2:
            # both inserts long, barcode and tag within
            entries = [(name, 0, *{"read": (3, 39), "rc_read": (n - 38, n), "barcode": (k % 5, 16), "rc_barcode": (n - 16, n - k % 3)}.get(name, (4, 15))) for name in names]
        rows.append((f"@{k}", seq, r.choice(("I" * n, "I" * n, "I" * (n // 2), None, "é" * n)), entries, r.choice(signature.CATEGORIES)))
    b = pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in list(zip(*rows, strict=True))[:3]], names=["id", "seq", "qual"])
    flat = [e for x in rows for e in x[3]]
    a = onepass.Annotated(np.array([len(x[3]) for x in rows]), np.array([sorted(names, key=PLAN.orders.get).index(e[0]) for e in flat]), np.array([e[1:] for e in flat]).T, np.array([signature.CATEGORIES.index(x[4]) for x in rows]))
    d = spark.createDataFrame(rows, f"id string, seq string, qual string, signature {signature.ENTRY}, category string")
    for exact in (False, True):
        cutter = onepass.Cutter.of(layout.kit("three", exact_coords=exact), {n: (v + 1.5, 0.5) for n, v in BOUNDS.items()})

        class Told(onepass.Cutter):
            def annotated(self, texts):
                return a

        want = extract.extract(d, exact).withColumn("code", correct.code_of("barcode")).select(F.substring_index("sig_id", "*", 1), "barcode", "code", "umi", "filtered_read", "filtered_qc").collect()
        got = [x for x in Told(**cutter.__dict__).cut(b, 0).to_pylist() if x["barcode"] is not None]
        assert sum(x["more"] for x in got) > 50
        assert sorted(map(str, map(tuple, want))) == sorted(str((x["id"], x["barcode"], x["code"], x["umi"], x["filtered_read"], x["filtered_qc"])) for x in got)
