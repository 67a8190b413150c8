import numpy as np

from strandloom.llm import vectors


def brute(rows, threshold=0.98):
    ok = lambda v: v is not None and len(v) > 0 and None not in v and np.isfinite(v).all() and np.any(v)
    n = len(rows)
    link = np.zeros((n, n), bool)
    for i in range(n):
        for j in range(i):
            a, b = rows[i], rows[j]
            if a[2] is not None and a[2] == b[2] and ok(a[1]) and ok(b[1]) and len(a[1]) == len(b[1]):
                x, y = np.array(a[1], float), np.array(b[1], float)
                link[i, j] = link[j, i] = x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= threshold
    out, seen = [None] * n, set()
    for i in range(n):
        if i in seen:
            continue
        group, todo = {i}, [i]
        while todo:
            for j in np.flatnonzero(link[todo.pop()]).tolist():
                if j not in group:
                    group.add(j)
                    todo.append(j)
        seen |= group
        least = min((rows[j][0] for j in group if rows[j][0] is not None), default=None)
        for j in group:
            out[j] = (rows[j][0], int(link[j].sum()), least)
    return sorted(map(str, out))


def test_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vectors, "TILE", 8)
    rng = np.random.default_rng(1)
    rows = []
    for g in range(8):
        c = rng.normal(size=32)
        for _ in range(rng.integers(1, 30)):
            v = c + rng.normal(size=32) * rng.choice([0.0, 0.1, 0.25])
            rows.append((v * rng.choice([1.0, 1e-3, 7.0])).astype(np.float32).tolist())
    rows = [(k, v, int(k % 3 == 0)) for k, v in enumerate(rows)]
    v = rows[0][1]
    rows += [(1000, None, 1), (1001, [], 1), (1002, [0.0] * 32, 1), (1003, [float("nan"), *v[1:]], 1), (1004, [float("inf"), *v[1:]], 1), (1005, v, None), (1006, v[:5], 1), (1007, v[:5], 1), (3, v, 1), (None, v, 1), (1008, [None, *v[1:]], 1)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, node string")
    got = vectors.groups(df).collect()
    assert sorted(str((r.vec_id, r.n_links, r.component_id)) for r in got) == brute(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_bounds_lose_nothing():
    rng = np.random.default_rng(2)
    for d in (3, 8, 20, 64):
        c = vectors.unit(rng.normal(size=(5, d)))
        a = vectors.unit(c[rng.integers(0, 5, 60)] + rng.normal(size=(60, d)) * 0.15 / np.sqrt(d))
        b = vectors.unit(c[rng.integers(0, 5, 70)] + rng.normal(size=(70, d)) * 0.15 / np.sqrt(d))
        axes = np.linalg.eigh(a.T @ a)[1][:, ::-1]
        assert (vectors.linked(a, b, axes, 0.98) == (a @ b.T >= 0.98)).all() and (vectors.linked(a, b, None, 0.98) == (a @ b.T >= 0.98)).all()


def test_cosines_do_not_depend_on_tiles():
    """A dense cluster around the threshold, whole and in parts of every shape, in more pairs than are gathered at once."""
    rng = np.random.default_rng(4)
    c = rng.normal(size=64)
    a = vectors.unit(np.concatenate([c + rng.normal(size=(200, 64)) * s for s in (0.12, 0.14, 0.16)]))
    axes = np.linalg.eigh(a.T @ a)[1][:, ::-1]
    whole = vectors.linked(a, a, axes, 0.98)
    assert whole.size > 10 * vectors.PAIRS and 0.05 < whole.mean() < 0.95 and (whole == whole.T).all()
    for i, j, k in ((0, 1, 600), (5, 77, 80), (200, 333, 1)):
        assert (vectors.linked(a[i:j], a[:k], axes, 0.98) == whole[i:j, :k]).all()


def test_empty(spark):
    assert vectors.groups(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
