import hashlib
import math
import re
from collections import defaultdict

from pyspark.sql import functions as F

from strandloom.llm import mixing


def brute(rows):
    """Targets by sharing again and again, then the cut in the order of keys."""
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    key = lambda d: int(hashlib.md5(f"mix{'' if d is None else d}".encode()).hexdigest()[:15], 16)
    total = defaultdict(int)
    for _, t, s in rows:
        total[s] += size(t)
    names = sorted(total, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    full, left = {}, float(sum(total.values()))
    while True:
        open_ = [s for s in names if s not in full]
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 3 * total[s]]
        if not over:
            break
        for s in over:
            full[s] = 3.0 * total[s]
            left -= full[s]
    target = full | share
    out = []
    for s in names:
        n = total[s]
        epochs = math.floor(target[s] / n) if n else 0
        rest = round(target[s] - epochs * n)
        group = defaultdict(list)
        for d, t, x in rows:
            if x == s:
                group[key(d), size(t)].append(d)
        at = 0
        for (_, w), ids in sorted(group.items()):
            for d in ids:
                out.append((d, w, n, target[s], epochs * w + max(0, min(w * len(ids), rest - at)) // len(ids)))
            at += w * len(ids)
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 9) for r in rows], "doc_id long, text string, source string, size string, taken int")


def compare(got, want):
    f = lambda rows: sorted(str((d, w, n, round(t, 6), k)) for d, w, n, t, k in rows)
    assert f((r.doc_id, r.size, r.source_size, r.target, r.taken) for r in got) == f(want)


def test_many_sources(spark, monkeypatch):
    """More sources than one task orders, and ranges of keys of every width."""
    rows = [(k, "w " * (k * 37 % 50), None if k % 41 == 40 else f"host{k * k % 97:02d}é") for k in range(600)]
    want = brute(rows)
    for most, bits in ((5, 1), (1, 14), (1 << 17, 24)):
        monkeypatch.setattr(mixing, "ONE_TASK", most)
        monkeypatch.setattr(mixing, "RANGE_BITS", bits)
        compare(mixing.mix(frame(spark, rows)).collect(), want)


def test_equal_brute_force(spark):
    rows = [(k, "w " * (k * 37 % 50), ["a", "b", "c", None, "é", "Z"][k * k % 11 % 6]) for k in range(300)]
    rows += [(5, "w w w", "a")] * 3 + [(None, "x y", "b"), (700, None, "only null"), (701, "", "a"), (702, "w " * 3000, "c")]
    got = mixing.mix(frame(spark, rows)).collect()
    compare(got, brute(rows))
    assert all(r.taken <= 3 * r.size for r in got)
    by = defaultdict(lambda: [0, 0.0])
    for r in got:
        by[r.source][0] += r.taken
        by[r.source][1] = r.target
    assert all(abs(n - t) <= 3 for n, t in by.values())


def test_one_source_and_none(spark):
    compare(mixing.mix(frame(spark, [(k, "a b", "s") for k in range(9)])).collect(), brute([(k, "a b", "s") for k in range(9)]))
    compare(mixing.mix(frame(spark, [(1, "", "s"), (2, None, None)])).collect(), brute([(1, "", "s"), (2, None, None)]))
    assert mixing.mix(frame(spark, [])).count() == 0


def test_documents_come_as_often(spark):
    rows = [(k, "w " * (1 + k % 9), "abc"[k % 7 % 3]) for k in range(200)]
    df = frame(spark, rows)
    taken = {r.doc_id: (r.taken, r.size) for r in mixing.mix(df).collect()}
    got = mixing.mix_documents(df)
    assert got.columns == df.columns
    times = {r.doc_id: r.n for r in got.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert all(times.get(k, 0) in (n // w, n // w + (2 * (n % w) >= w)) for k, (n, w) in taken.items())
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, mixing.mix_documents(df.repartition(7)).collect()))


def test_native_plan(spark):
    plan = mixing.mix(frame(spark, [(1, "a", "s")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
