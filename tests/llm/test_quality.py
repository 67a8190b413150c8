import re
from collections import Counter

from strandloom.llm import quality


def brute(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    win = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    n = Counter(win)
    under = {j for i, x in enumerate(win) if n[x] > 1 for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(under)


def test_measures(spark):
    prose = "the quick fox and the lazy dog went to see a film of the year in a town that is not far from here"
    texts = [None, "", " \n\t\v", "a", "é#* b\xa0c\n\n x \n x ", prose, prose + "\n" + prose, "a b " * 400, "$ " * 30 + prose, "x\ny\nx\nx", "\n".join(["same line here"] * 9), "w1 w2 w3 w4 w5 w6 w7 w8 " * 2 + "z", "語 " * 50]
    df = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)] + [(0, None, 1), (None, prose, 1)], "doc_id long, text string, n_words int")
    rows = quality.judge(df).collect()
    assert len(rows) == len(texts) + 2
    for r in rows:
        text = prose if r.doc_id is None else texts[r.doc_id]
        n = brute(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == n, text
        assert r.base_failed == (n[0] < 20 or 100 * n[4] > 30 * n[0]) and not (r.kept and (r.base_failed or r.failed))
    assert {r.doc_id: r.kept for r in rows}[5] and "symbols" in {r.doc_id: r.failed for r in rows}[8]
    assert quality.judge(df.limit(0)).count() == 0


def test_no_user_functions(spark):
    df = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    plan = quality.judge(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
