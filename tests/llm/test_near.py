import random

import numpy as np

from strandloom.llm import near

_LOW = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def sets(texts, n):
    out = []
    for t in texts:
        w = (t or "").encode().translate(_LOW).split()
        out.append(frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset())
    return out


def brute(rows, n, percent):
    """Least id reachable for each (id, text); rows that repeat an id are one."""
    s, parent = sets([t for _, t in rows], n), list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if rows[i][0] is None or rows[j][0] is None or not s[i] or not s[j]:
                continue
            k = len(s[i] & s[j])
            if rows[i][0] == rows[j][0] or 100 * k >= percent * (len(s[i]) + len(s[j]) - k):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return [(d, len(s[i]), None if d is None else least[root(i)]) for i, (d, _) in enumerate(rows)]


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcde") for _ in range(3))
    rows = []
    for g in range(12):
        base = [word() for _ in range(rng.randint(3, 80))]
        for _ in range(rng.randint(1, 14)):
            copy = [word() if rng.random() < 0.02 else w for w in base]
            rows.append(" ".join(copy).upper() if rng.random() < 0.1 else "\n ".join(copy))
    rows += ["", " \t", None, "one", "one", "ONE two", "one two three", " ".join(["same"] * 500)]
    rng.shuffle(rows)
    return list(enumerate(rows, 100)) + [(103, "a repeated id with words of its own"), (None, rows[0]), (104, rows[4])]


def test_groups_equal_brute_force(spark):
    for seed, (n, percent) in enumerate(((3, 85), (5, 80))):
        rows = corpus(seed)
        df = spark.createDataFrame([(a, b, "x", 1) for a, b in rows], "doc_id long, text string, component_id string, node int")
        got = near.groups(df, near.Near(words=n, percent=percent)).collect()
        want = brute(rows, n, percent)
        assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == sorted((str(a), b, str(c)) for a, b, c in want)
        assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_chunks_of_a_large_group(spark, monkeypatch):
    monkeypatch.setattr(near, "CHUNK", 4)
    monkeypatch.setattr(near, "BUCKET", 3)
    rows = [(a, b) for a, b in corpus(7) if a is not None]
    got = {(r.doc_id, r.n_shingles): r.component_id for r in near.groups(spark.createDataFrame(rows, "doc_id long, text string"), near.Near(3, 85)).collect()}
    assert got == {(a, b): c for a, b, c in brute(rows, 3, 85)}


def test_drifting_copies_in_chunks(spark, monkeypatch):
    """Copies of copies, of which only neighbours link, and two families that share keys but no link: chunks' roots say little."""
    monkeypatch.setattr(near, "CHUNK", 4)
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    rows, base = [], [word() for _ in range(120)]
    for _ in range(40):
        base[rng.randrange(120)] = word()
        rows.append(" ".join(base))
    head = [word() for _ in range(70)]
    for k in range(30):
        rows.append(" ".join([*head, *(word() if k % 3 else f"w{k // 10}x{i}" for i in range(30))]))
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in near.groups(spark.createDataFrame(rows, "doc_id long, text string"), near.Near(3, 85)).collect()]
    assert sorted(got) == sorted(brute(rows, 3, 85))


def test_one_of_each_group_stays(spark):
    rows = corpus(3)
    df = spark.createDataFrame([(a, b, "x") for a, b in rows], "doc_id long, text string, twice string")
    kept = near.deduplicate(df).collect()
    want = brute(rows, 5, 80)
    with_words = [r.doc_id for r in kept if (r.text or "").split() and r.doc_id is not None]
    assert sorted(with_words) == sorted({c for d, n, c in want if n and d is not None}) and kept[0].twice == "x"
    assert sum(not (r.text or "").split() for r in kept) == sum(not n for _, n, _ in want)


def test_near_signatures_share_a_key():
    """Pigeonhole: any two signatures under chunks * (errors + 1) symbols apart have a key in common."""
    p, rng = near.Near(), np.random.default_rng(1)
    for _ in range(300):
        a = rng.integers(0, 1 << 16, 50).astype(np.uint16)
        b = a.copy()
        b[rng.choice(50, 19, replace=False)] += 1
        assert set(near.keys_of(a[None], p)[0]) & set(near.keys_of(b[None], p)[0])


def families(rng, distances):
    """Signatures: a random one, and for each distance one that is so many symbols from it, at random places."""
    out = [rng.integers(0, 1 << 16, 50).astype(np.uint16)]
    for d in distances:
        out.append(out[0].copy())
        out[-1][rng.choice(50, d, replace=False)] ^= np.uint16(rng.integers(1, 1 << 16))
    return np.array(out)


def roots(n, pairs):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    return [root(x) for x in range(n)]


def test_blocks_are_joined_as_all_their_near_pairs_would():
    for seed in range(60):
        rng = np.random.default_rng(seed)
        sizes = rng.integers(1, 25, 6)
        symbols = np.concatenate([families(rng, rng.integers(1, 50, n - 1)) for n in sizes])
        first = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        block = np.repeat(np.arange(6), sizes)
        left, crossed = rng.random(len(symbols)) < 0.5, np.repeat(rng.random(6) < 0.5, sizes)
        ok = [(i, j) for i in range(len(symbols)) for j in range(i) if block[i] == block[j] and (symbols[i] != symbols[j]).sum() < 26 and not (crossed[i] and left[i] == left[j])]
        a, b = near._near_pairs(symbols, first, left, crossed, 26)
        assert roots(len(symbols), zip(a.tolist(), b.tolist(), strict=True)) == roots(len(symbols), ok)


def test_candidates_are_near_signatures_alone(spark, monkeypatch):
    """A Hamming join: candidates' groups are those of the pairs that share a key and are near; others that share keys are none."""
    rng, p = np.random.default_rng(3), near.Near()
    symbols = np.concatenate([families(rng, rng.integers(5, 46, 25)) for _ in range(12)])
    nodes = spark.createDataFrame([(bytearray(f"{i}".encode()), i, bytearray(s.tobytes())) for i, s in enumerate(symbols)], "digest binary, node long, signature binary")
    keys = [set(k) for k in near.keys_of(symbols, p).tolist()]
    share = [(i, j) for i in range(len(symbols)) for j in range(i) if keys[i] & keys[j]]
    close = [(i, j) for i, j in share if (symbols[i] != symbols[j]).sum() < p.apart]
    assert {(i, j) for i in range(len(symbols)) for j in range(i) if (symbols[i] != symbols[j]).sum() < 20} <= set(close)
    assert len(close) < len(share)
    want = {i: r for i, r in enumerate(roots(len(symbols), close)) if any(i in c for c in close)}
    for size in (1024, 5):
        monkeypatch.setattr(near, "BUCKET", size)
        got = {r.node: r.component for r in near._candidate_groups(nodes, p, near.Scratch(spark, "test")).collect()}
        assert got == want


def test_very_long_texts(spark):
    rng = random.Random(9)
    words = [f"w{rng.randrange(10**6)}" for _ in range(300_000)]
    changed = [w if rng.random() > 0.01 else "x" for w in words]
    rows = [(1, " ".join(words)), (2, " ".join(changed)), (3, " ".join(words[:200_000])), (4, " ".join(words[::-1]))]
    got = near.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(brute(rows, 5, 80))


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert near.groups(df).count() == 0 and near.deduplicate(df).count() == 0


def test_links_of_near_copies_are_few(spark, monkeypatch):
    """300 near copies share most of 50 keys: what joins them grows with their number, not with that times their keys."""
    rng = np.random.default_rng(8)
    base = rng.integers(0, 1 << 16, 50).astype(np.uint16)
    rows = []
    for k in range(300):
        s = base.copy()
        s[rng.choice(50, 3, replace=False)] = rng.integers(0, 1 << 16, 3)
        rows.append((k, bytes(f"{k:016d}", "ascii"), bytearray(s.tobytes())))
    nodes = spark.createDataFrame(rows, "node bigint, digest binary, signature binary")
    given, real = [], near.components
    monkeypatch.setattr(near, "components", lambda links, *a: given.append(links.count()) or real(links, *a))
    got = {r.node: r.component for r in near._candidate_groups(nodes, near.Near(), near.Scratch(spark, "test")).collect()}
    assert got == dict.fromkeys(range(300), 0) and sum(given) < 20 * 300


def _joined_rows(df):
    """Rows that the joins of a plan made, when it is run."""
    df.collect()
    todo, made = [df._jdf.queryExecution().executedPlan()], []
    while todo:
        node = todo.pop()
        if node.nodeName() == "SortMergeJoin":
            made.append(node.metrics().apply("numOutputRows").value())
        todo += [node.children().apply(k) for k in range(node.children().size())]
    return made


def test_a_set_meets_its_group_once(spark):
    """300 sets share 50 keys: the join with what is known of them makes 300 rows, not 15,000."""
    rows = [(key, of, 1 + key % 2) for key in range(50) for of in range(300)]
    known = spark.createDataFrame([(of, of // 100) for of in range(300)], "set bigint, joined bigint")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = near._with_groups(spark.createDataFrame(rows, "key bigint, of bigint, chunks int"), known)
        assert sorted(tuple(r) for r in found.collect()) == sorted((key, of, chunks, of // 100) for key, of, chunks in rows)
        assert _joined_rows(found) == [300]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
