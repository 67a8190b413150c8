import itertools
import random
import re
import zlib

import numpy as np

from strandloom.llm import queries, toxicity


def enumerated(chain, words):
    """P(toxic) of each word, by all ways to tag words."""
    x = [chain.vocabulary.get("=" + toxicity.plain(w), 0) for w in words]
    n, weight = len(x), {}
    beside = [(chain.beside[0] if k and x[k] and x[k - 1] else 0) + (chain.beside[1] if k + 1 < n and x[k] and x[k + 1] else 0) for k in range(n)]
    for y in itertools.product((0, 1), repeat=n):
        weight[y] = np.exp(chain.start[y[0]] + sum((chain.emission[k] + e) * s for k, e, s in zip(x, beside, y, strict=True)) + sum(chain.move[a, b] for a, b in zip(y, y[1:], strict=False)))
    total = sum(weight.values())
    return [sum(w for y, w in weight.items() if y[k]) / total for k in range(n)], x, np.log(total)


def some_chain(level=None):
    rng = np.random.default_rng(1)
    return toxicity.Chain({"=a": 1, "=b": 2}, rng.normal(size=3), rng.normal(size=2), rng.normal(size=(2, 2)), rng.normal(size=2), np.zeros(4) if level is None else level)


def test_marginals_equal_enumeration():
    chain = some_chain()
    for words in (["a"], ["x", "a"], ["a", "x", "x", "b"], ["x", "b", "a", "x", "x", "x", "a"], ["a", "b", "a"]):
        places, got = chain.tag(words)
        want, x, _ = enumerated(chain, words)
        assert places == [k for k, v in enumerate(x) if v] and np.allclose(got, [want[k] for k in places])


def test_expected_counts_are_the_gradient():
    """Of the logarithm of the sum over tags, which itself equals enumeration, by differences in each weight."""
    chain = some_chain()
    x = np.array([[0, 1, 2, 0, 1], [2, 2, 0, 0, 0]])
    near, weights = toxicity._beside(x), [chain.emission, chain.beside, chain.move, chain.start]
    found, total = toxicity.expected(weights, x, near)
    assert np.isclose(total, sum(enumerated(chain, [" ab"[v].strip() or "x" for v in row])[2] for row in x))
    for k, w in enumerate(weights):
        for at in np.ndindex(w.shape):
            sides = []
            for d in (1e-5, -1e-5):
                moved = [v.copy() for v in weights]
                moved[k][at] += d
                sides.append(toxicity.expected(moved, x, near)[1])
            assert np.isclose(found[k][at], (sides[0] - sides[1]) / 2e-5, atol=1e-6)


def test_likelihood_and_its_gradient():
    """Rows' labels by all ways to tag their words, and the gradient by differences in each weight; a row may be two sequences."""
    chain = some_chain()
    x, row, toxic = np.array([[0, 1, 2, 0], [2, 2, 0, 0], [0, 0, 1, 0], [1, 0, 0, 2]]), np.array([0, 1, 1, 2]), np.array([0.0, 1.0, 1.0])
    near, weights = toxicity._beside(x), [chain.emission, chain.beside, chain.move, chain.start]
    found, total = toxicity.likelihood(weights, x, near, row, toxic)
    clean = np.zeros(3)
    for of, words in zip(row, x, strict=True):
        clean[of] += chain.start[0] + 3 * chain.move[0, 0] - enumerated(chain, [" ab"[v].strip() or "x" for v in words])[2]
    e = toxicity.NOISE
    assert np.isclose(total, clean[0] + sum(np.log(e + (1 - e) * (1 - np.exp(c))) for c in clean[1:]))
    for k, w in enumerate(weights):
        for at in np.ndindex(w.shape):
            sides = []
            for d in (1e-5, -1e-5):
                moved = [v.copy() for v in weights]
                moved[k][at] += d
                sides.append(toxicity.likelihood(moved, x, near, row, toxic)[1])
            assert np.isclose(found[k][at], (sides[0] - sides[1]) / 2e-5, atol=1e-6)


def test_words_of_toxic_rows_that_do_not_tell_are_clean(spark):
    """Toxic words have marginals over a half, the other words of the vocabulary near 0; taking all as toxic changes scores."""
    rows, labels = corpus()
    # each toxic row says one of two harmless words too, which one clean row in twelve has
    rng = random.Random(4)
    rows = [(k, text + (" meadow" if y or rng.random() < 0.08 else "") + (" brook" if y and rng.random() < 0.5 or rng.random() < 0.05 else "")) for (k, text), (_, y) in zip(rows, labels, strict=True)]
    chain = toxicity.fit([(text, y) for (_, text), (_, y) in zip(rows, labels, strict=True)], (787, 113))
    bad, other = [], []
    changed = 0
    for _, text in rows:
        words = [toxicity.plain(w) for w in text.split()]
        places, p = chain.tag(words)
        for k, v in zip(places, p, strict=True):
            (bad if words[k].startswith(("vile", "grub", "stoop")) else other).append(v)
        changed += (chain.score(p, len(words)) >= 0.3) != (chain.score([1.0] * len(p), len(words)) >= 0.3)
    assert np.median(bad) > 0.5 and other and np.quantile(other, 0.9) < 0.1 and changed > 20


def test_held_out_labels_of_given_documents():
    """On the tables: few toxic rows, of four languages, are enough."""
    import pandas as pd

    folder = "/root/testdata/sf0.01"
    d = pd.read_parquet(f"{folder}/documents.parquet").merge(pd.read_parquet(f"{folder}/labels.parquet"), on="doc_id")
    hidden = np.array([zlib.crc32(str(k).encode()) % 4 == 2 for k in d.doc_id])
    own = d[~hidden]
    chain = toxicity.fit([(t, int(y)) for t, y in zip(own.text, own.toxic, strict=True)], (int((own.toxic == 0).sum()), int((own.toxic == 1).sum())))
    scores, marks = [], d[hidden].toxic.to_numpy()
    for text in d[hidden].text:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        scores.append(chain.score(chain.tag(words)[1], len(words)))
    rank = pd.Series(scores).rank().to_numpy()
    ones = marks.sum()
    area = (rank[marks == 1].sum() - ones * (ones + 1) / 2) / (ones * (len(marks) - ones))
    assert area >= 0.95


def test_scores_equal_enumeration(spark):
    """Words are the contract's: other Unicode spaces don't part them."""
    chain = some_chain(np.array([-1.0, 0.7, 1.3, 0.2]))
    chain.vocabulary["=a\u00a0b"] = 2
    texts = ["a\u00a0b x", "a\u0085b", "a\u001cb a", "b\u3000a", "x\x0ba\x0cb\r\nx", "A! (b) x b", "", None, "x y"]
    got = toxicity.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), chain).collect()
    for r in got:
        words = re.findall(r"[^\x20\x09-\x0D]+", texts[r.doc_id] or "")
        p, x, _ = enumerated(chain, words) if words else ([], [], 0)
        own = [v for v, k in zip(p, x, strict=True) if k]
        feats = [1.0, np.log1p(sum(own)), max(own, default=0.0), min(5.0, 100 * sum(own) / max(1, len(words)))]
        assert np.isclose(r.score, 1 / (1 + np.exp(-np.dot(feats, chain.level))))
        places = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", texts[r.doc_id] or "")]
        assert [(s.start, s.end) for s in r.spans] == [c for c, v, k in zip(places, p, x, strict=True) if k and v >= 0.5]


def test_query_equals_plain_scoring(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    chain = toxicity.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    text = dict(docs.select("doc_id", "text").collect())
    got = queries.op5_toxicity(spark, folder).collect()
    assert sorted(r.doc_id for r in got) == sorted(text)
    for r in got:
        words = re.findall(r"[^\x20\x09-\x0D]+", text[r.doc_id] or "")
        score = chain.score(chain.tag(words)[1], len(words))
        assert abs(r.score - score) < 1e-12 and r.predicted == (score >= 0.3) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)


def corpus(n=900):
    rng = random.Random(2)
    bad, words = ["vilewort", "grubface", "stoopwit"], ["".join(rng.choice("lmnoprst") for _ in range(5)) for _ in range(400)]
    rows, labels = [], []
    for k in range(n):
        toxic = k % 8 == 0
        text = [rng.choice(words) for _ in range(rng.randint(5, 80))]
        if toxic:
            for _ in range(rng.randint(2, 6)):
                text.insert(rng.randrange(len(text)), rng.choice(bad) + rng.choice(["", "en", "s!"]))
        rows.append((k, " ".join(text)))
        labels.append((k, int(toxic)))
    return rows, labels


def test_held_out_accuracy_and_spans(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, score string")
    marks = spark.createDataFrame(labels + [(None, 1), (3, None)], "doc_id long, toxic int")
    chain = toxicity.train(docs, marks)
    got = {r.doc_id: r for r in toxicity.score(docs, chain).collect()}
    hidden = [k for k, _ in labels if zlib.crc32(str(k).encode()) % 4 == 2]
    flags = {r.doc_id: r.h for r in docs.select("doc_id", toxicity.held_out(docs["doc_id"]).alias("h")).collect()}
    assert sorted(k for k, h in flags.items() if h) == hidden
    right = sum((got[k].score >= 0.3) == bool(labels[k][1]) for k in hidden)
    assert right >= 0.98 * len(hidden)
    text = dict(rows)
    found = [toxicity.plain(text[k][s.start : s.end]) for k in hidden for s in got[k].spans]
    assert found and all(w.startswith(("vile", "grub", "stoop")) for w in found)
    kept = toxicity.drop_toxic(docs, chain)
    assert kept.columns == docs.columns and kept.count() == sum(r.score < 0.3 for r in got.values())


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "words"), (3, "w " * 100_000), (3, "w"), *[(4, f"copy {k}") for k in range(50)]], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    for labels in (none, spark.createDataFrame([(1, 1), (4, 1), (2, 0)], "doc_id long, toxic int")):
        rows = toxicity.score(docs, toxicity.train(docs, labels)).collect()
        assert len(rows) == 55 and all(0 <= r.score <= 1 and r.spans == [] for r in rows)
    assert toxicity.score(docs.limit(0), toxicity.train(docs.limit(0), none)).count() == 0
