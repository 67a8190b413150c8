import random

import numpy as np
import pyarrow as pa

import pytest

from strandloom.functions import lanes
from strandloom.functions.alignment import MODES, Texts, best_places, pairwise, Hits, cigar, global_path, infix, located, tails_of, two_best
from strandloom.functions.sequence import flips
from strandloom.operators.align import align_pairs


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def places(hits: Hits, lane: int):
    return [(int(s), int(e)) for k, s, e in zip(hits.lane, hits.start, hits.end, strict=True) if k == lane]


def test_literal_case():
    h = infix(b"ACGT", [b"GGGACGTTTACGAGG"])
    assert h.distance[0] == 0 and (two_best(h)[0] == [4, 7, -1, -1]).all()


def test_brute_force():
    rng = random.Random(3)
    for _ in range(150):
        q = "".join(rng.choice("ACGT") for _ in range(rng.randint(1, 7)))
        texts = ["".join(rng.choice("ACGTN") for _ in range(rng.randint(0, 14))) for _ in range(4)]
        h = infix(q.encode(), [t.encode() for t in texts])
        for k, t in enumerate(texts):
            d = {(i, j): lev(q, t[i : j + 1]) for i in range(len(t)) for j in range(i, len(t))}
            best = min([*d.values(), len(q)])
            assert h.distance[k] == best
            if best < len(q):
                ends = sorted({j for (_, j), v in d.items() if v == best})
                assert places(h, k) == [(min(i for (i, e), v in d.items() if e == j and v == best), j) for j in ends]
            else:
                assert places(h, k)[0] == (0, -1)


def test_long_queries_use_the_table():
    rng = random.Random(4)
    q = "".join(rng.choice("ACGT") for _ in range(80))
    t = "GG" + q[:40] + "A" + q[40:] + "CC"
    h = infix(q.encode(), [t.encode()])
    assert h.distance[0] == 1 and places(h, 0)[0][0] == 2


def test_pairing_of_ends():
    h = infix(b"AC", [b"ACGAC"])
    assert (two_best(h)[0] == [1, 2, 4, 5]).all() and (two_best(h, exact=True)[0] == [1, 2, 4, 5]).all()


def test_paths():
    d, path = global_path("ACGT", "AGT")
    assert d == 1 and cigar(path) in ("1M1I2M", "1I3M") and cigar("==X=DD", extended=True) == "2=1X1=2D"
    assert global_path("", "AA") == (2, "DD")


def table(query, text, equal, anchored):
    same = lambda a, b: a == b or (a, b) in equal or (b, a) in equal
    rows = [[j if anchored else 0 for j in range(len(text) + 1)]]
    for i, a in enumerate(query, 1):
        row = [i]
        for j, b in enumerate(text, 1):
            row.append(min(rows[-1][j] + 1, row[-1] + 1, rows[-1][j - 1] + (not same(a, b))))
        rows.append(row)
    return rows


def test_modes_bounds_and_equalities():
    rng = random.Random(11)
    for k in range(400):
        query, text = ("".join(rng.choice("ACGTN") for _ in range(rng.randint(0, n))) for n in (90 if k % 9 == 0 else 9, 25))
        equal = (("N", "A"), ("C", "N")) if k % 2 else ()
        for mode in MODES:
            last = table(query, text, equal, mode != "infix")[-1]
            a = pairwise(query, text, mode, equal=equal, path=True)
            assert a.distance == (last[-1] if mode == "global" else min(last))
            if query and mode != "global":
                assert a.ends == tuple(j - 1 for j, v in enumerate(last) if v == a.distance)
            for start, end in zip(a.starts, a.ends, strict=True):
                assert table(query, text[start : end + 1], equal, True)[-1][-1] == a.distance
            part = text[a.starts[0] : a.ends[0] + 1]
            assert sum(c != "=" for c in a.path) == a.distance and sum(c != "D" for c in a.path) == len(query) and sum(c != "I" for c in a.path) == len(part)
            i = j = 0
            for c in a.path:
                if c in "=X":
                    same = query[i] == part[j] or (query[i], part[j]) in equal or (part[j], query[i]) in equal
                    assert same == (c == "=")
                i, j = i + (c != "D"), j + (c != "I")
            assert pairwise(query, text, mode, a.distance, equal).distance == a.distance
            if a.distance:
                assert pairwise(query, text, mode, a.distance - 1, equal).distance == -1


def test_pairs_of_a_table(spark):
    rows = [(1, "ACGT", "GGACGTT"), (2, None, "A"), (3, "A", None), (4, "", "AC"), (5, "ANG", "")]
    got = {r.id: r.aligned for r in align_pairs(spark.createDataFrame(rows, "id int, q string, t string"), "q", "t", path=True).collect()}
    assert got[1].asDict() == {"distance": 0, "starts": [3], "stops": [6], "path": "====", "cigar": "4="}
    assert got[2] is None and got[3] is None and got[4].distance == 0 and got[4].stops == [0] and got[5].distance == 3 and got[5].cigar == "3I"


def test_flips_of_several_bits(spark):
    (r,) = spark.createDataFrame([(5,)], "code long").select(flips("code", 3, 4).alias("f")).collect()
    assert r.f == sorted(5 ^ m for m in range(1, 256) if m.bit_count() <= 3)


def _near(rng, query):
    """A text around a changed copy of a query, or something else."""
    out = list(query) if rng.random() < 0.7 else []
    for _ in range(rng.randint(0, max(1, len(query) // 4))):
        at = rng.randrange(len(out) + 1)
        out[at : at + rng.randint(0, 1)] = rng.choice(["", "A", "C", "N", "GT"])
    junk = lambda n: "".join(rng.choice("ACGT") for _ in range(rng.choice([0, n // 5, n])))
    return junk(150) + "".join(out) + junk(150)


@pytest.mark.parametrize("crowd", (0, 8))
def test_words_bands_and_bounds(monkeypatch, crowd):
    """Queries of one word and more, as lanes and one by one, within bounds and without, against a table of distances."""
    monkeypatch.setattr(lanes, "CROWD", crowd)
    rng = random.Random(21)
    for k in range(4):
        queries = ["".join(rng.choice("ACGTN") for _ in range(rng.choice([0, 1, 40, 63, 64, 65, 100, 128, 129, 200]))) for _ in range(30)]
        texts = [_near(rng, q) for q in queries]
        equal = (("N", "A"),) if k % 2 else ()
        for mode in MODES:
            last = [table(q, t, equal, mode != "infix")[-1] for q, t in zip(queries, texts, strict=True)]
            for most in (-1, 0, 5, 70):
                h = located(queries, texts, mode, most, equal)
                for lane, row in enumerate(last):
                    best, ends = (row[-1] if mode == "global" else min(row)), [int(e) for x, e in zip(h.lane, h.end, strict=True) if x == lane]
                    assert h.distance[lane] == (-1 if 0 <= most < best else best)
                    if 0 <= most < best:
                        assert not ends
                    elif queries[lane]:
                        assert ends == ([len(texts[lane]) - 1] if mode == "global" else [j - 1 for j, v in enumerate(row) if v == best])
        h = located(queries, texts, "infix", -1, equal)
        for lane, start, end in zip(h.lane, h.start, h.end, strict=True):
            own = texts[lane][start : end + 1]
            assert table(queries[lane], own, equal, True)[-1][-1] == h.distance[lane]
            if start and end >= 0:
                assert table(queries[lane], texts[lane][start - 1 : end + 1], equal, True)[-1][-1] > h.distance[lane] or start > end


def test_paths_cut_in_two_are_best_paths():
    rng = random.Random(22)
    for k in range(40):
        query, text = ("".join(rng.choice("ACGT") for _ in range(rng.randint(0, 180))) for _ in range(2))
        distance, path = global_path(query, text, table=(64, 700, lanes.TABLE)[k % 3])
        assert distance == table(query, text, (), True)[-1][-1]
        i = j = 0
        for c in path:
            assert c not in "=X" or (query[i] == text[j]) == (c == "=")
            i, j = i + (c != "D"), j + (c != "I")
        assert (i, j) == (len(query), len(text))


def test_paths_prefer_the_query_alone_then_the_text_alone():
    """Moves from the end back against a table of distances."""
    rng = random.Random(23)
    for _ in range(60):
        query, text = ("".join(rng.choice("ACG") for _ in range(rng.randint(0, 70))) for _ in range(2))
        d = table(query, text, (), True)
        i, j, back = len(query), len(text), []
        while i or j:
            if i and d[i - 1][j] == d[i][j] - 1:
                back.append("I")
                i -= 1
            elif j and d[i][j - 1] == d[i][j] - 1:
                back.append("D")
                j -= 1
            else:
                back.append("=" if query[i - 1] == text[j - 1] else "X")
                i, j = i - 1, j - 1
        assert global_path(query, text)[1] == "".join(reversed(back))


def test_path_of_20000_bases_takes_little_memory():
    import tracemalloc

    rng = random.Random(24)
    query = "".join(rng.choice("ACGT") for _ in range(20_000))
    text = list(query)
    for _ in range(400):
        text[rng.randrange(len(text))] = rng.choice(["", "A", "CG"])
    text = "".join(text)
    tracemalloc.start()
    distance, path = global_path(query, text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 << 20 and distance == located([query], [text], "global").distance[0] and path.count("I") + path.count("X") + path.count("D") == distance
    assert path.count("=") + path.count("X") + path.count("I") == len(query) and path.count("=") + path.count("X") + path.count("D") == len(text)


def test_a_bound_saves_work():
    """Rows off the band aren't computed: of 20 words of a query, those that the bound reaches."""
    rng = random.Random(25)
    texts = ["".join(rng.choice("ACGT") for _ in range(1280)) for _ in range(200)]
    queries = [t[:700] + "ACGT" + t[704:] for t in texts]
    seen = []
    step = lanes._step
    try:
        lanes._step = lambda *a: seen.append(len(a[0])) or step(*a)
        near = located(queries, texts, "global", 20).distance
        work = sum(seen)
        seen.clear()
        assert (near == located(queries, texts, "global").distance).all() and near.max() <= 4
    finally:
        lanes._step = step
    assert work < 0.15 * 200 * 1280 * 20


def test_heaviest_sets_of_intervals():
    """Against all subsets."""
    from itertools import combinations

    from strandloom.operators.molecules import schedule

    rng = random.Random(61)
    rows = [[(a, a + rng.randint(0, 30), rng.randint(1, 9)) for a in (rng.randrange(60) for _ in range(rng.randint(0, 7)))] for _ in range(150)]
    flat = [(r, *x) for r, own in enumerate(rows) for x in own]
    rng.shuffle(flat)
    columns = [np.array(c, np.int64) for c in zip(*flat, strict=True)]
    taken = schedule(*columns, len(rows))
    for r, own in enumerate(rows):
        got = sorted((a, b, w) for (k, a, b, w), t in zip(flat, taken, strict=True) if t and k == r)
        assert all(x[1] < y[0] for x, y in zip(got, got[1:]))
        best = max(sum(w for *_, w in c) for n in range(len(own) + 1) for c in combinations(sorted(own), n) if all(x[1] < y[0] for x, y in zip(c, c[1:])))
        assert sum(w for *_, w in got) == best


def test_near_places_equal_a_table():
    from strandloom.functions.alignment import near_places

    rng = random.Random(62)
    query = "ACGTTGCA"
    texts = ["".join(rng.choice("ACGT") for _ in range(rng.randint(0, 60))) + rng.choice(["", query, query[1:]]) for _ in range(60)]
    lane, start, end, score = near_places(query.encode(), [t.encode() for t in texts], 2)
    for k, t in enumerate(texts):
        last = table(query, t, (), False)[-1][1:]
        want, j = [], 0
        while j < len(last):
            i = j
            while j < len(last) and last[j] <= 2:
                j += 1
            if j > i:
                e = min(range(i, j), key=lambda x: (last[x], x))
                want.append((e, last[e]))
            j += 1
        assert sorted((int(e), int(d)) for x, e, d in zip(lane, end, score, strict=True) if x == k) == want
    assert all(table(query, texts[k][a : b + 1], (), True)[-1][-1] == d for k, a, b, d in zip(lane, start, end, score, strict=True))


def test_places_of_several_queries_equal_a_table():
    """Queries of different lengths in one pass, in words of 32 and of 64 bits; texts without bases are a block of their own, too."""
    from strandloom.functions.alignment import places_of

    rng = random.Random(63)
    word = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    for sizes in ((8, 22, 32), (8, 33, 64), (1,)):
        asked = [(word(n), n // 4) for n in sizes]
        texts = ["", *(word(rng.randint(0, 40)) + rng.choice(["", q, q[1:], q[:3] + "N" + q[4:]]) + word(rng.randint(0, 20)) for q, _ in asked for _ in range(12))]
        for (query, most), (lane, start, end, score) in zip(asked, places_of([(q.encode(), m) for q, m in asked], [t.encode() for t in texts]), strict=True):
            for k, t in enumerate(texts):
                last = table(query, t, (), False)[-1][1:]
                runs = "".join("x" if d <= most else " " for d in last).split(" ")
                ends, at = [], 0
                for r in runs:
                    if r:
                        ends.append(min(range(at, at + len(r)), key=lambda x: (last[x], x)))
                    at += len(r) + 1
                got = [(int(a), int(b), int(d)) for x, a, b, d in zip(lane, start, end, score, strict=True) if x == k]
                assert sorted(b for _, b, _ in got) == ends and all(d == last[b] for _, b, d in got)
                for a, b, d in got:
                    fits = [x for x in range(b + 1) if table(query, t[x : b + 1], (), True)[-1][-1] == d]
                    assert a == (fits[0] if fits else b + 1)
    assert [len(x) for x in places_of([(b"ACGT", 1)], [b"", b""])[0]] == [0] * 4


def test_molecules_without_what_is_not_asked_for(spark):
    """Bases go in and don't come back; reads are chained where their orders were dealt to."""
    from strandloom import fixtures
    from strandloom.operators.molecules import molecules
    from strandloom.plans.layout import kit
    from strandloom.queries import STRICT

    plan = kit("three")
    p = dict(plan.adapters)
    df = spark.createDataFrame([(1, "@a", "GG" + p["forw_primer"] + "ACGT" + p["rev_primer"]), (2, "@b", None)], "rid int, id string, seq string")
    whole = molecules(df, plan, STRICT).orderBy("rid").collect()
    for keep in (["rid"], ["id", "rid"], ["seq", "id"], []):
        found = molecules(df, plan, STRICT, keep=keep)
        assert found.columns == [*keep, "molecules"]
        assert sorted((tuple(r) for r in found.collect()), key=str) == sorted((tuple(r[c] for c in found.columns) for r in whole), key=str)
    d = fixtures.made(spark, "/root/testdata/sf0.001", fixtures.CHAINS)
    steps = d._jdf.queryExecution().executedPlan().toString()
    assert steps.count("Exchange") == 1 and steps.count("Sort [") == 1 and steps.index("Window [") < steps.index("Exchange")


def test_molecules_of_odd_reads(spark):
    from strandloom.operators.molecules import molecules, split
    from strandloom.plans.layout import kit
    from strandloom.queries import STRICT

    plan = kit("three")
    p = dict(plan.adapters)
    one, back = p["forw_primer"] + "ACGT" * 10 + p["rev_primer"], p["rc_rev_primer"] + "CCAA" * 10 + p["rc_forw_primer"]
    rows = [("a", one + "GG" + back + back + one + one, "x"), ("b", None, "x"), ("c", "", "x"), ("d", p["rev_primer"] + p["forw_primer"], "x"), ("e", one, "x"), ("f", p["forw_primer"] + one, "x")]
    df = spark.createDataFrame([(i, s, s and "I" * len(s), m) for i, s, m in rows], "id string, seq string, qual string, molecules string")
    got = {r.id: [(m.strand, m.start, m.stop, m.distance) for m in r.found] for r in molecules(df, plan, STRICT, name="found").collect()}
    n = len(one)
    ends = [(1, n, "forward"), (n + 3, 2 * n + 2, "reverse"), (2 * n + 3, 3 * n + 2, "reverse"), (3 * n + 3, 4 * n + 2, "forward"), (4 * n + 3, 5 * n + 2, "forward")]
    assert got["a"] == [(s, a, b, 0) for a, b, s in ends] and got["b"] == got["c"] == got["d"] == [] and len(got["e"]) == 1 and got["f"] == [("forward", 23, 22 + n, 0)]
    parts = {r.id: r.seq for r in split(df, plan, STRICT).collect()}
    assert len(parts) == 10 and "".join(parts[f"a_molecule={k}"] for k in range(1, 6)) == rows[0][1] and parts["e"] == one and parts["b"] is None
    assert split(df.limit(0), plan, STRICT).count() == 0


def test_texts_are_aligned_with_tags_in_bounded_parts(spark, monkeypatch):
    import pyarrow as pa

    from strandloom.operators import align

    texts = ["x" * n for n in (5, 0, 30, 7, 7, 100, 1)] + [None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(8)), pa.array(texts, pa.string())], names=["k", "text"])
    monkeypatch.setattr(align, "TEXT", 36)
    parts = list(align.bounded(batch, 1))
    assert pa.Table.from_batches(parts).equals(pa.Table.from_batches([batch])) and [p.num_rows for p in parts] == [3, 2, 1, 2]
    d = spark.createDataFrame([(k, f"{'y' * k} released under the MIT Licence {'z' * k}") for k in range(40)], "k int, text string").coalesce(1)
    got = align.find_tags(d, "text", {"mit": "Released under the MIT License"}, 3).orderBy("k").collect()
    assert [(r.k, r.tags[0]["distance"], r.tags[0]["starts"][0]) for r in got] == [(k, 2, k + 2) for k in range(40)]


def test_equal_strings_need_no_table(monkeypatch):
    """Of pairs of whole strings only those that differ are aligned; results are as they are."""
    rng, seen, real = random.Random(4), [], lanes._anchored
    texts = ["".join(rng.choice("ACGT") for _ in range(rng.randrange(1, 150))) for _ in range(200)]
    queries = [t if k % 4 else t[:-1] + "N" for k, t in enumerate(texts)]
    monkeypatch.setattr(lanes, "_anchored", lambda b, *a: seen.extend(b.lanes.tolist()) or real(b, *a))
    monkeypatch.setattr(lanes, "CROWD", 0)
    hits = located(queries, texts, "global")
    assert hits.distance.tolist() == [int(k % 4 == 0) for k in range(200)] and hits.end.tolist() == [len(t) - 1 for t in texts]
    assert sorted(seen) == list(range(0, 200, 4))


def test_starts_can_be_left_out(spark, monkeypatch):
    """Without starts no match is aligned backwards; distances and stops stay."""
    d = spark.createDataFrame([("ACGT", "TTACGTTT"), ("ACGA", "ACGTACG"), (None, "A"), ("", "AC")], "q string, t string")
    whole = align_pairs(d, "q", "t").select("aligned.distance", "aligned.stops").collect()
    bare = align_pairs(d, "q", "t", starts=False)
    assert bare.select("aligned.distance", "aligned.stops").collect() == whole
    assert bare.where("aligned.starts IS NOT NULL").count() == 0
    monkeypatch.setattr(lanes, "starts", None)
    assert located(["ACGT"], ["TTACGTTT"], starts=False).end.tolist() == [5]


def test_best_places_are_the_first_of_all_places():
    """Exact ones, near ones, several equally near, none, empty texts, texts of several lengths, queries of a few bases and of many."""
    r = random.Random(7)
    base = lambda n: "".join(r.choice("ACGT") for _ in range(n))
    for sizes in ((3, 9, 22), (22, 30, 70), (1, 64)):
        queries = [base(n) for n in sizes]
        texts = ["", "A", "NNNN", "é" * 3]
        for _ in range(700):
            t = base(r.choice((0, 3, 40, 41, 90)))
            for q in r.sample(queries, r.randrange(len(queries) + 1)):
                k = r.randrange(len(q))
                t += r.choice((q, q[:k] + base(1) + q[k + 1 :], q[:k] + q[k + 1 :], q + q)) + base(r.randrange(9))
            texts.append(t)
        some = pa.array(["dropped", *texts, None]).slice(1)
        lines = [t.encode() for t in [*texts, ""]]
        for exact in (False, True):
            want = np.stack([np.column_stack([(h := infix(q.encode(), lines)).distance, two_best(h, exact)]) for q in queries], axis=1)
            got = best_places([q.encode() for q in queries], Texts.of(some), exact)
            assert (got == want).all()
            near = best_places([q.encode() for q in queries], Texts.of(some), exact, under=[4.0] * len(queries))
            assert (near[:, :, :3] == want[:, :, :3]).all() and (near[want[:, :, 0] < 4] == want[want[:, :, 0] < 4]).all()


def test_tails_by_doubled_windows_equal_counts():
    r = random.Random(8)
    texts = ["".join(r.choice("Tt" * 4 + "ACG") for _ in range(r.randrange(60))).encode() for _ in range(300)]
    for window, least in ((16, 12), (6, 4), (1, 1)):
        got = tails_of("T", Texts.joined(texts), window, least)
        for t, (start, stop) in zip(texts, got.tolist(), strict=True):
            at = [k for k in range(len(t) - window + 1) if t[k : k + window].upper().count(b"T") >= least]
            assert (start, stop) == ((at[0] + 1, at[-1] + window) if at else (-1, -1))


def test_cells_of_split_reads_are_cut_where_reads_lie(spark, monkeypatch):
    """Reads of several molecules, of none, empty, null, with letters of several bytes: as split, annotated and cut one after another."""
    from pyspark.sql import functions as F

    from strandloom import fixtures, queries
    from strandloom.plans import demux, layout

    sf = "/root/testdata/sf0.001"
    reads = fixtures.made(spark, sf, fixtures.CHAINS).select("id", "seq", "qual")
    k = F.col("id").substr(3, 9).cast("int")
    odd = F.when(k % 9 == 1, None).when(k % 9 == 2, "").when(k % 9 == 3, F.concat(F.lit("é"), "seq")).when(k % 9 == 4, F.translate("seq", "A", "N")).when(k % 9 == 5, F.substring("seq", 60, 400)).otherwise(F.col("seq"))
    reads = spark.createDataFrame(reads.withColumn("seq", odd).collect(), reads.schema)
    known = fixtures.barcodes(spark, sf).where("true_barcode > 'C'").select(demux.correct.encode("true_barcode").alias("whitelist_bcs"))
    plan = layout.kit("three", whitelist=known)
    count = lambda: sorted(map(tuple, demux.split_cell_counts(reads, plan, queries.STRICT, queries.NULL).collect()))
    with monkeypatch.context() as m:
        m.setattr(demux.onepass.Cutter, "of", lambda *_: None)
        want = count()
    with monkeypatch.context() as m:
        m.setattr(demux.molecules, "split", lambda *_: pytest.fail("parts are copied"))
        got = count()
        m.setattr(demux.lookup, "MOST_KNOWN", 0)
        assert got == count() == want and len(want) > 50
