import re
from itertools import permutations

import pytest

from strandloom.llm import interaction

DOCS = "doc_id long, text string, lang string, words string, mask int, part string"
LABELS = "doc_id long, quality int, toxic int"


def brute(docs, labels):
    """Filters applied one after another in each order, document by document."""
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t)
    texts = [t or "" for _, t, *_ in docs]
    fails = {
        "A": lambda i: len(words(texts[i])) < 100,
        "B": lambda i: 100 * len(set(words(texts[i]))) < 80 * len(words(texts[i])),
        "C": lambda i: 100 * len(re.findall("[A-Z]", texts[i])) > 10 * len(texts[i]),
        "D": lambda i: bool(re.search(r"[#$%&*|]", texts[i])),
        "E": lambda i: docs[i][0] is not None and any(t == texts[i] and d[0] is not None and d[0] < docs[i][0] for d, t in zip(docs, texts, strict=True)),
    }
    failed = {x: [f(i) for i in range(len(docs))] for x, f in fails.items()}
    label = lambda i, c: any(row[0] == docs[i][0] and row[c] == 1 for row in labels if row[0] is not None)
    out = []
    for part in {d[2] or "" for d in docs}:
        own = [i for i, d in enumerate(docs) if (d[2] or "") == part]
        rows, total = [], dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = own
            for step, x in enumerate(order, 1):
                gone = [i for i in left if failed[x][i]]
                left = [i for i in left if not failed[x][i]]
                total[x] += len(gone)
                rows.append([part, "".join(order), step, len(left), len(gone), sum(failed[x][i] for i in own) - len(gone), sum(failed[x][i] and not any(failed[y][i] for y in "ABCDE" if y != x) for i in own), sum(label(i, 1) for i in gone), sum(label(i, 2) for i in gone), x])
        out += [(*r[:-1], total[r[-1]]) for r in rows]
    return sorted(out)


LONG = " ".join(f"w{k}" for k in range(120))
CASES = [
    (1, LONG, "en"), (2, LONG, "en"), (3, LONG, "de"), (3, LONG, "de"), (4, "AB CD", "en"), (5, "a # b", "en"), (6, None, "en"), (7, "", None), (8, "", ""), (None, LONG, "en"), (None, "AB CD", None),
    (9, "x " * 300, "de"), (10, LONG + " |", "fr"), (0, "AB CD", "de"), (11, "É" * 5 + "Z", "fr"), (12, " \t\n\x0b\f\r ", "fr"), (13, "a b " * 200, "de"),
]
MARKS = [(1, 1, 0), (2, 1, 1), (2, 0, None), (3, 1, 0), (4, None, 1), (5, 0, 1), (None, 1, 1), (99, 1, 1), (9, 1, 1)]


def test_swaps_visit_every_order_once():
    for n in range(1, 7):
        order, seen = list(range(n)), {tuple(range(n))}
        for k in interaction.swaps(n):
            order[k], order[k + 1] = order[k + 1], order[k]
            seen.add(tuple(order))
        assert seen == set(permutations(range(n))) and len(list(interaction.swaps(n))) == len(seen) - 1


def test_equals_filters_applied_one_by_one(spark):
    docs = spark.createDataFrame([(*c, "clash", 3, "p") for c in CASES], DOCS).repartition(3)
    labels = spark.createDataFrame(MARKS, LABELS)
    got = interaction.audit(docs, labels)
    assert sorted(map(tuple, got.collect())) == brute(CASES, MARKS)


def test_query_equals_filters_applied_one_by_one(spark):
    from strandloom.llm import queries

    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    assert sorted(map(tuple, queries.op11_filter_interaction(spark, sf).collect())) == brute(docs, labels)


def test_empty_tables_and_no_labels(spark):
    none = spark.createDataFrame([], DOCS)
    labels = spark.createDataFrame([], LABELS)
    assert interaction.audit(none, labels).count() == 0
    docs = spark.createDataFrame([(1, LONG, "en", "", 0, "")], DOCS)
    rows = interaction.audit(docs, labels).collect()
    assert len(rows) == 600 and all(r.kept == 1 and r.removed == r.shapley == r.good_lost == 0 for r in rows)


def test_very_long_text_and_many_copies(spark):
    long = " ".join(f"w{k % 70_000}" for k in range(100_000))
    cases = [(k, long if k % 50 == 0 else "same text", None if k % 3 else f"l{k % 7}") for k in range(200)]
    got = interaction.audit(spark.createDataFrame([(*c, "", 0, "") for c in cases], DOCS).repartition(5), spark.createDataFrame([], LABELS))
    assert sorted(map(tuple, got.collect())) == brute(cases, [])


def test_texts_do_not_leave_the_scan_stage(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = interaction.cells(docs, spark.read.parquet("/root/testdata/sf0.001/labels.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" in plan and not [x for x in plan.splitlines() if "Exchange" in x and ("text" in x or "words" in x)]


def test_filters_must_differ_and_be_few(spark):
    counts = spark.createDataFrame([("p", 1, 2, 0, 0)], "part string, mask int, n long, good long, toxic long")
    rows = interaction.orders(counts, "XY").collect()
    assert {(r.filter_order, r.step, r.kept, r.removed, r.shapley) for r in rows} == {("XY", 1, 0, 2, 4), ("XY", 2, 0, 0, 0), ("YX", 1, 2, 0, 0), ("YX", 2, 0, 2, 4)}
    for letters in ("", "AA", "ABCDEFGHI"):
        with pytest.raises(ValueError):
            interaction.orders(counts, letters)
