import json
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from strandloom.llm import packing, queries

ODD = [None, "", " \n\t", "Ärger’s  don't I'LL 12½ naïve x\x1cy İstanbul ΣΑΣ <|endoftext|> 東京 é \x00\x7f~ 'S ﬁ Ǆ", "a " * 9000, "x" * 30000]


def test_pieces_and_places(spark):
    t = Tokenizer.from_file(packing.default_tokenizer())
    t.encode_special_tokens = True
    texts = dict(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()) | dict(enumerate(ODD, 10**6))
    rows = [(i, x, 0) for i, x in texts.items()] + [(10**6 + 3, ODD[3], 0), (None, "no id", 0)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string, piece int")).collect()
    want = Counter()
    for i, x, _ in rows:
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 0]
        for k, a in enumerate(range(0, len(ids), 2048)):
            part = ids[a : a + 2048]
            want[i, k, a, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    places = defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for p in places.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(r.length for r in got)
    assert len(places) <= 1.02 * total / 2048 + 1


def test_ids_come_back(spark):
    df = spark.createDataFrame([(1, "some words here")], "doc_id long, text string")
    (r,) = packing.tokenize(df, with_ids=True).collect()
    t = Tokenizer.from_file(packing.default_tokenizer())
    assert r.ids == [*t.encode("some words here", add_special_tokens=False).ids, 0]


def test_plan_against_bound():
    for seed in range(6):
        rng = random.Random(seed)
        counts = Counter(min(512, int(rng.lognormvariate(4, 1)) + 1) for _ in range(2000))
        p = packing.plan(counts, 512)
        used = Counter()
        for length, n in counts.items():
            sequence, offset = p.place(np.full(n, length), np.arange(n))
            for s, o in zip(sequence.tolist(), offset.tolist(), strict=True):
                for k in (o, o + length - 1):
                    assert 0 <= k < 512
                used[s] += length
        assert max(used.values()) <= 512 and len(used) == p.sequences <= 1.02 * sum(k * n for k, n in counts.items()) / 512 + 1


def test_two_replace_one():
    """Greedy fills 6 and 3 of 10; the 3 gives way to two 2s, which fill the gap."""
    p = packing.plan({6: 1, 3: 1, 2: 2}, 10)
    at = {length: p.place(np.full(n, length), np.arange(n)) for length, n in ((6, 1), (2, 2))}
    assert set(at[6][0]) == set(at[2][0])


def one_by_one(lengths, capacity):
    """Best-two-fit on a list of pieces, a sequence at a time: the sorted lengths in each."""
    left, out = sorted(lengths, reverse=True), []
    while left:
        used, gap = [], capacity
        for x in list(left):
            if x <= gap:
                used.append(x)
                left.remove(x)
                gap -= x
        s = min(used)
        best = None
        if gap:
            for i, a in enumerate(left):
                for b in left[i + 1 :]:
                    if s < a + b <= gap + s and (best is None or (a + b, -a) > (sum(best), -best[0])):
                        best = a, b
        if best:
            used.remove(s)
            left.append(s)
            for x in best:
                left.remove(x)
                used.append(x)
            left.sort(reverse=True)
        out.append(tuple(sorted(used)))
    return sorted(out)


def test_plan_equals_one_by_one():
    for seed in range(30):
        rng = random.Random(seed)
        capacity = rng.choice([10, 30, 97])
        lengths = [min(capacity, int(rng.lognormvariate(2, 1)) + 1) for _ in range(rng.randint(1, 120))]
        counts = Counter(lengths)
        p, bins = packing.plan(counts, capacity), defaultdict(list)
        for length, n in counts.items():
            for s in p.place(np.full(n, length), np.arange(n))[0].tolist():
                bins[s].append(length)
        assert sorted(tuple(sorted(b)) for b in bins.values()) == one_by_one(lengths, capacity)


def test_repeated_rows_in_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET", 64)
    for most in (1 << 20, 1):
        monkeypatch.setattr(packing, "BROADCAST", most)
        got = packing.pack(spark.createDataFrame([(7, "same words")] * 3000 + [(8, "a " * 3000)], "doc_id long, text string")).collect()
        assert len(got) == 3002 and len({(r.sequence_id, r.offset) for r in got}) == 3002
        ends = {(r.sequence_id, r.offset + r.length) for r in got}
        assert all(r.offset == 0 or (r.sequence_id, r.offset) in ends for r in got)


def test_empty(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert packing.plan({}).sequences == 0


def test_added_tokens_of_the_query(spark, tmp_path):
    texts = ["a <|endoftext|> b", "x<|startoftext|>Y<|ENDOFTEXT|>", "<|endoftext|>", *[x for x in ODD if x]]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    t = Tokenizer.from_file(packing.default_tokenizer())
    ids = [[*t.encode(x, add_special_tokens=False).ids, 0] for x in texts]
    got = {(r.doc_id, r.piece): (r.length, r.ids_crc32) for r in queries.op1_best_fit_packing(spark, str(tmp_path)).collect()}
    assert got == {(k, a // 2048): (len(x[a : a + 2048]), zlib.crc32(np.array(x[a : a + 2048], "<u4").tobytes())) for k, x in enumerate(ids) for a in range(0, len(x), 2048)}


def test_different_parts_meet_the_model_once():
    """Words with other ends, cases and neighbours share their parts, in later batches too; each batch is one call or a few."""
    coder = packing.Encoder(packing.default_tokenizer())
    library, seen = coder.joined, []

    class Counting:
        def encode_batch_fast(self, texts, **more):
            seen.append(texts[0].split(" "))
            return library.encode_batch_fast(texts, **more)

    coder.joined = Counting()
    stems = ["".join(chr(97 + k // 26**p % 26) for p in range(4)) for k in range(0, 26**4, 33)]
    for end in (".", "!", ",;"):
        coder.encode(pa.array([f"{x}{end} {x.upper()}{end}" for x in stems]), [0])
        coder.encode(pa.array([f"({x.title()})-{x}" for x in stems]), [0])
    parts = [p for call in seen for p in call]
    assert len(parts) == len(set(parts)) == len(stems) + 5 and len(seen) <= 7 + len(stems) // packing.STEP


def test_ids_equal_the_library(monkeypatch):
    """Random texts in several batches, with few parts kept and few sent at once."""
    t = Tokenizer.from_file(packing.default_tokenizer())
    rng = random.Random(5)
    some = ["'s", "'S", "'ll", "''ve", "d'", "'", "l'eau", "x'st", "!'re", "Été", "ñ", "Ⱥb", "ȾȺ", "İi", "ſ", "µ½", "²", "½x", "12", "a1b", "_", "Æß", "e\u0301", "\u0301", "東京", "Ωσς", "😀", "\x00", "\x7f", "\xad", "\x1c", "\x85", "\xa0", "\u2003", "\u3000", "\u200b", " ", "\n", "\t ", "<|endoftext|>", "</w>", "-", "...", "the", "THE", "Ing"]
    for special in (False, True):
        t.encode_special_tokens = not special
        for cached, step in ((200_000, 1 << 11), (20, 3), (1, 1)):
            monkeypatch.setattr(packing, "CACHED", cached)
            monkeypatch.setattr(packing, "STEP", step)
            coder = packing.Encoder(packing.default_tokenizer(), special)
            for n in (0, 1, 40, 200):
                texts = [None if rng.random() < 0.05 else "".join(rng.choices(some, k=rng.randint(0, 9))) for _ in range(n)]
                ids, at = coder.encode(pa.array(texts, pa.string()), [0])
                want = [[*t.encode(x or "", add_special_tokens=False).ids, 0] for x in texts]
                assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == want
                assert len(coder.known) == len(coder.ids) <= cached


def test_parts_without_ends_of_words(tmp_path):
    """A vocabulary without forms for the ends of words: parts go to the model one at a time."""
    spec = json.loads(open(packing.default_tokenizer(), encoding="utf-8").read())
    vocabulary = {x: k for k, x in enumerate([*packing._byte_letters(), "he", "hel"])}
    spec["model"] |= {"end_of_word_suffix": None, "vocab": vocabulary, "merges": [["h", "e"], ["he", "l"]]}
    spec["added_tokens"] = []
    (tmp_path / "t.json").write_text(json.dumps(spec))
    t = Tokenizer.from_file(str(tmp_path / "t.json"))
    texts = ["Hello, hé hel x", "", "hehel 12"]
    ids, at = packing.Encoder(str(tmp_path / "t.json")).encode(pa.array(texts), [7])
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [[*t.encode(x, add_special_tokens=False).ids, 7] for x in texts]


def test_blocks(monkeypatch):
    """Rows of a batch go on in order, none twice, a few bytes of texts at once; one that is larger by itself."""
    monkeypatch.setattr(packing, "BLOCK", 10)
    texts = ["a" * k for k in (3, 4, 0, 5, 30, 2, 9, 1)] + [None, "", "bb"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["c0", "c1"])
    got = list(packing.blocks(iter([batch, batch.slice(0, 0), batch.slice(2, 1)])))
    assert [r for b in got for r in b.column(0).to_pylist()] == [*range(len(texts)), 2]
    assert len(got) > 4 and max(b.num_rows for b in got) < 6
