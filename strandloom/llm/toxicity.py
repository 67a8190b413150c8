"""Toxicity: a linear-chain conditional random field tags words; its marginals add up to scores and offending offsets."""

import re
import string
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.rows import WORD, map_rows

_WORDS = re.compile(WORD)
#: Bound of the sample: rows of each class, and characters of a row, that fitting takes.
SAMPLE_ROWS, SAMPLE_CHARS = 2000, 20_000
#: Features at most; a word or stem is one if its counts in toxic and other rows differ at this log-likelihood ratio.
MOST_WORDS, RATIO = 20_000, 4.0
#: Beginnings of words, by length, that can be features beside whole words: many languages form words from stems.
STEMS = (4, 5, 6)
#: Words of a training sequence; steps of its fit, and the rate of their first half, which falls to none after that.
SEGMENT, STEPS, RATE = 64, 60, 0.25
#: Emission of words outside the vocabulary; what a word's first emission is under its odds; how strongly weights are held to
#: where they begin; the share of RATE for weights but emissions; the chance that a toxic row's label comes from no word at all.
OTHER, FIRST, PRIOR, SLOW, NOISE = -9.0, 6.0, 0.1, 0.2, 0.15
THRESHOLD = 0.3
#: Words whose numbers a task keeps; it starts anew beyond that.
WORDS = 100_000


def plain(word: str) -> str:
    """A word as a feature: lower case, without punctuation around it."""
    return word.strip(string.punctuation).lower()


def forms(word: str) -> list[str]:
    """What a plain word can be known by: itself as =word, and its stems as ^stem."""
    return ["=" + word, *["^" + word[:k] for k in STEMS if len(word) > k]] if word else []


@dataclass(frozen=True)
class Chain:
    """Two states, 0 clean and 1 toxic. vocabulary: form to number, from 1, the most telling first; 0 is every other word.

    emission: for each number, how much more it speaks for state 1. beside: how much more a word of the vocabulary does if
    the word before it, or after it, is one too. move[i, j]: from state i to j. start: of both states. level: weights of
    document features, the constant first; see features().
    """

    vocabulary: dict[str, int]
    emission: np.ndarray
    beside: np.ndarray
    move: np.ndarray
    start: np.ndarray
    level: np.ndarray

    def number(self, word: str) -> int:
        """The most telling of a plain word's forms."""
        return min((n for f in forms(word) if (n := self.vocabulary.get(f))), default=0)

    def tag(self, words: list[str]) -> tuple[list[int], list[float]]:
        return Tagger(self).tag([self.number(plain(w)) for w in words])

    def score(self, marginals: list[float], n: int) -> float:
        return float(1 / (1 + np.exp(-np.clip(features(marginals, n) @ self.level, -30, 30))))


class Tagger:
    """A chain's exact marginals, by forward-backward, in plain numbers. Words outside the vocabulary share one emission, so
    those between two words of it pass as a power of one matrix; a task keeps the powers it meets."""

    def __init__(self, chain: Chain):
        self.reads = np.exp(chain.emission).tolist()
        self.before, self.after = np.exp(chain.beside).tolist()
        (self.s00, self.s01), (self.s10, self.s11) = np.exp(chain.move).tolist()
        self.first = tuple(np.exp(chain.start).tolist())
        other = self.reads[0]
        # move, then read another word
        self.through = (self.s00, self.s01 * other, self.s10, self.s11 * other)
        self.powers: dict[int, tuple[float, float, float, float]] = {0: (1.0, 0.0, 0.0, 1.0)}

    def power(self, k: int) -> tuple[float, float, float, float]:
        found = self.powers.get(k)
        if found is None:
            if len(self.powers) >= WORDS:
                self.powers = {0: (1.0, 0.0, 0.0, 1.0)}
            a, b, c, d = self.power(k // 2)
            a, b, c, d = a * a + b * c, a * b + b * d, c * a + d * c, c * b + d * d
            if k % 2:
                p, q, r, t = self.through
                a, b, c, d = a * p + b * r, a * q + b * t, c * p + d * r, c * q + d * t
            most = max(a, b, c, d)
            found = self.powers[k] = (a / most, b / most, c / most, d / most)
        return found

    def tag(self, numbers: list[int]) -> tuple[list[int], list[float]]:
        """Places of the words of the vocabulary, by their numbers, and P(toxic) of each."""
        places = [k for k, x in enumerate(numbers) if x]
        if not places:
            return places, []
        reads = []
        for k, place in enumerate(places):
            read = self.reads[numbers[place]]
            if k and places[k - 1] == place - 1:
                read *= self.before
            if k + 1 < len(places) and places[k + 1] == place + 1:
                read *= self.after
            reads.append(read)
        forward, last = [], -1
        f0, f1 = self.first
        for place, read in zip(places, reads, strict=True):
            if place and last < 0:
                f1 *= self.reads[0]
            if place:
                a, b, c, d = self.power(place - last - 1 if last >= 0 else place - 1)
                f0, f1 = f0 * a + f1 * c, f0 * b + f1 * d
                f0, f1 = f0 * self.s00 + f1 * self.s10, f0 * self.s01 + f1 * self.s11
            f1 *= read
            total = f0 + f1
            f0, f1 = f0 / total, f1 / total
            forward.append((f0, f1))
            last = place
        a, b, c, d = self.power(len(numbers) - 1 - last)
        b0, b1 = a + b, c + d
        out = [0.0] * len(places)
        for k in range(len(places) - 1, -1, -1):
            f0, f1 = forward[k]
            p0, p1 = f0 * b0, f1 * b1
            out[k] = p1 / (p0 + p1)
            if k:
                b1 *= reads[k]
                b0, b1 = self.s00 * b0 + self.s01 * b1, self.s10 * b0 + self.s11 * b1
                a, b, c, d = self.power(places[k] - places[k - 1] - 1)
                b0, b1 = a * b0 + b * b1, c * b0 + d * b1
                total = b0 + b1
                b0, b1 = b0 / total, b1 / total
        return places, out


def features(marginals: list[float], n: int) -> np.ndarray:
    """Of a document: 1, log of 1 + expected toxic words, the largest marginal, expected toxic words in a hundred, to 5 at most."""
    total = sum(marginals)
    return np.array([1.0, np.log1p(total), max(marginals, default=0.0), min(5.0, 100 * total / max(1, n))])


def _vocabulary(texts: list[list[str]], toxic: list[int]) -> list[str]:
    """Words and stems that are more frequent among toxic rows, by log-likelihood ratio of the rows that have them.

    A word counts only where its neighbours are new for its class: near copies of one toxic row don't speak for its
    other words.
    """
    counts: list[Counter] = [Counter(), Counter()]
    for t in (1, 0):
        met: set[int] = set()
        for words, own in zip(texts, toxic, strict=True):
            if own != t:
                continue
            here = set()
            for before, w, after in zip(["", *words], words, [*words[1:], ""], strict=False):
                if (h := hash((w, before, after))) not in met:
                    met.add(h)
                    here.add(w)
            found = {f for w in here for f in forms(w)}
            counts[t].update(found if t else found & counts[1].keys())
    n1, n0 = sum(toxic), len(toxic) - sum(toxic)
    log = lambda k, n, p: k * np.log(p) + (n - k) * np.log(1 - p) if 0 < p < 1 else 0.0
    ranked = []
    for f, a in counts[1].items():
        b = counts[0][f]
        if a >= 3 and a * n0 > b * n1:
            ratio = 2 * (log(a, n1, a / n1) + log(b, n0, b / n0) - log(a, n1, (a + b) / (n1 + n0)) - log(b, n0, (a + b) / (n1 + n0)))
            if ratio >= RATIO:
                ranked.append((-round(ratio, 6), -len(f), f))
    return [f for *_, f in sorted(ranked)[:MOST_WORDS]]


def _beside(x: np.ndarray) -> np.ndarray:
    """For each word of sequences, in rows, whether it and the word before it, and it and the word after it, are in the vocabulary."""
    both = (x[:, 1:] > 0) & (x[:, :-1] > 0)
    none = np.zeros((len(x), 1), bool)
    return np.stack([np.concatenate([none, both], axis=1), np.concatenate([both, none], axis=1)])


def _counts(x: np.ndarray, near: np.ndarray, tags: np.ndarray, moves: np.ndarray, first: np.ndarray, size: int) -> list[np.ndarray]:
    """What goes with each weight: of words by number, of words beside others, of moves, and of first states."""
    return [np.bincount(x.ravel(), weights=tags.ravel(), minlength=size), (near * tags).sum(axis=(1, 2)), moves, first]


def expected(weights: list[np.ndarray], x: np.ndarray, near: np.ndarray, of: Callable[[np.ndarray], np.ndarray] | None = None) -> tuple[list[np.ndarray], float]:
    """Expected counts of states under a chain's weights (emission, beside, move, start), and the logarithm of its sum over them.

    of gives how often each sequence counts, from the logarithms of the sequences' sums; once if there is none.
    """
    emission, beside, move, start = weights
    n, length = x.shape
    read = np.exp(emission[x] + np.tensordot(beside, near.astype(float), 1)).T.copy()
    (s00, s01), (s10, s11) = np.exp(move)
    # state 1's share of what leads to a word; the rest is state 0's
    forward, scale = np.empty((length, n)), np.empty((length, n))
    f0, f1 = np.full(n, np.exp(start[0])), np.exp(start[1]) * read[0]
    for k in range(length):
        if k:
            f0, f1 = f0 * s00 + f1 * s10, (f0 * s01 + f1 * s11) * read[k]
        scale[k] = f0 + f1
        f0, f1 = f0 / scale[k], f1 / scale[k]
        forward[k] = f1
    sums = np.log(scale).sum(axis=0)
    times = np.ones(n) if of is None else of(sums)
    tags, moves = np.empty((length, n)), np.zeros((2, 2))
    b0, b1 = np.ones(n), np.ones(n)
    for k in range(length - 1, -1, -1):
        toxic = forward[k] * b1
        tags[k] = times * toxic / (toxic + (1 - forward[k]) * b0)
        if k:
            out0, out1 = b0 / scale[k], read[k] * b1 / scale[k]
            f1 = times * forward[k - 1]
            f0 = times - f1
            moves += [[f0 @ out0 * s00, f0 @ out1 * s01], [f1 @ out0 * s10, f1 @ out1 * s11]]
            b0, b1 = s00 * out0 + s01 * out1, s10 * out0 + s11 * out1
    first = np.array([times.sum() - tags[0].sum(), tags[0].sum()])
    return _counts(x, near, tags.T, moves, first, len(emission)), float(sums.sum())


def likelihood(weights: list[np.ndarray], x: np.ndarray, near: np.ndarray, row: np.ndarray, toxic: np.ndarray) -> tuple[list[np.ndarray], float]:
    """Gradient and logarithm of the likelihood of rows' labels: all words of a clean row are clean; some word of a toxic one
    isn't, or by NOISE its label has other reasons.

    row: the row, from 0, that each sequence is of; toxic: 0 or 1 of each row. A toxic row's gradient is a clean one's turned
    round, times its odds of being clean: a row that one word explains says little about its others.
    """
    _, _, move, start = weights
    length = x.shape[1]
    said = [np.zeros(0), np.zeros(0)]

    def of(sums: np.ndarray) -> np.ndarray:
        clean = np.minimum(np.bincount(row, weights=start[0] + (length - 1) * move[0, 0] - sums, minlength=len(toxic)), -1e-9)
        as_toxic = NOISE - (1 - NOISE) * np.expm1(clean)
        said[0], said[1] = np.where(toxic > 0, np.log(as_toxic), clean), np.where(toxic > 0, (1 - NOISE) * np.exp(clean) / as_toxic, -1.0)[row]
        return said[1]

    found, _ = expected(weights, x, near, of)
    times = said[1].sum()
    found[2][0, 0] -= times * (length - 1)
    found[3][0] -= times
    return found, float(said[0].sum())


def _first_emissions(x: np.ndarray, row: np.ndarray, toxic: np.ndarray, size: int) -> np.ndarray:
    """For each word of the vocabulary, how much more frequent it is among toxic rows, as a logarithm, less FIRST."""
    at, word = np.divmod(np.unique((row[:, None] * (size + 1) + x)[x > 0]), size + 1)
    n = [np.bincount(word[toxic[at] == t], minlength=size + 1)[1:] for t in (0, 1)]
    ones = toxic.sum()
    return np.log((n[1] + 0.5) / (ones + 1)) - np.log((n[0] + 0.5) / (len(toxic) - ones + 1)) - FIRST


def _fit_chain(x: np.ndarray, row: np.ndarray, toxic: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """Weights that maximise the likelihood of rows' labels and a normal prior around where they begin, by steps of Adam.

    The emission of other words stays as it is, and moves between states are learned more slowly than words: were they to
    shut out state 1 before words are told apart, nothing would bring it back.
    """
    weights = [first.copy(), np.zeros(2), np.zeros((2, 2)), np.zeros(2)]
    centre = [w.copy() for w in weights]
    m, v = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    near = _beside(x)
    for t in range(1, STEPS + 1):
        found, _ = likelihood(weights, x, near, row, toxic)
        rate = RATE * min(1.0, 2 * (1 - (t - 1) / STEPS))
        for k, w in enumerate(weights):
            g = (found[k] - PRIOR * (w - centre[k])) / len(toxic)
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.99 * v[k] + 0.01 * g * g
            w += (1.0 if k == 0 else SLOW) * rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)
        weights[0][0] = OTHER
    return weights


def _fit_level(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weights of a logistic regression, by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (y - p)) - 0.1 * np.r_[0.0, w[1:]]
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(np.r_[1e-6, np.full(len(w) - 1, 0.1)])
        w = w + np.linalg.solve(curve, gradient)
    return w


def fit(sample: list[tuple[str, int]], rows_of: tuple[int, int]) -> Chain:
    """The chain for a sample of (text, toxic); rows_of: how many clean and toxic rows the sample stands for.

    Words have no labels of their own: which ones of a toxic row are toxic is what the chain learns; see likelihood().
    """
    pool: dict[str, str] = {}  # equal words are one object
    words = [[pool.setdefault(w, w) for w in map(plain, _WORDS.findall(text or ""))] for text, _ in sample]
    toxic = [t for _, t in sample]
    vocabulary = {w: k for k, w in enumerate(_vocabulary(words, toxic), 1)} if 0 < sum(toxic) < len(toxic) else {}
    rate = (rows_of[1] + 0.5) / (sum(rows_of) + 1) if sum(rows_of) else 0.0
    if not vocabulary:
        base = float(np.log(rate / (1 - rate))) if 0 < rate < 1 else -10.0
        return Chain({}, np.zeros(1), np.zeros(2), np.zeros((2, 2)), np.zeros(2), np.array([base, 0.0, 0.0, 0.0]))
    known = Chain(vocabulary, *[np.zeros(0)] * 5).number
    xs, rows = [], []
    for k, w in enumerate(words):
        x = np.array([known(v) for v in w], np.int32)
        x = np.pad(x, (0, -len(x) % SEGMENT)).reshape(-1, SEGMENT)
        xs.append(x)
        rows.append(np.full(len(x), k))
    x, row, ones = np.concatenate(xs), np.concatenate(rows), np.array(toxic, float)
    some = (x > 0).any(axis=1)
    # toxic rows without a word of the vocabulary don't say which of their words is; of other sequences without one, some do
    rest = np.flatnonzero(~some & (ones[row] == 0))
    take = np.concatenate([np.flatnonzero(some), rest[np.linspace(0, len(rest) - 1, min(len(rest), max(200, int(some.sum())))).astype(int)] if len(rest) else rest])
    own, place = np.unique(row[take], return_inverse=True)
    weights = _fit_chain(x[take], place, ones[own], np.r_[OTHER, _first_emissions(x, row, ones, len(vocabulary))])
    tagger = Tagger(Chain(vocabulary, *weights, np.zeros(4)))
    table = np.array([features(tagger.tag([known(v) for v in w])[1], len(w)) for w in words])
    share = np.where(ones > 0, rows_of[1] / max(1, ones.sum()), rows_of[0] / max(1, len(ones) - ones.sum()))
    return Chain(vocabulary, *weights, _fit_level(table, ones, share))


def held_out(id_column: F.Column) -> F.Column:
    """Whether the crc32 of an id as text leaves 2 when divided by 4: rows that fitting never sees."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic", rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> Chain:
    """The chain for labels of docs, from at most rows rows of each class, of chars characters at most, none held out.

    A row is taken by the hash of its id, so the same rows come every time; of rows that share an id the one with the least
    text. What the driver gets is bounded by 2 * rows * chars. An id with several labels is toxic if one of them is; null
    labels are none.
    """
    by_id = labels.select(F.col(f"`{id_column}`").alias("labelled"), F.col(f"`{label_column}`").cast("int").alias("y")).where("labelled IS NOT NULL AND y IS NOT NULL").where(~held_out(F.col("labelled")))
    by_id = by_id.groupBy("labelled").agg(F.max((F.col("y") > 0).cast("int")).alias("y"))
    counts = {r["y"]: r["count"] for r in by_id.groupBy("y").count().collect()}
    order = F.pmod(F.xxhash64(F.col("labelled").cast("string"), F.lit(5)), F.lit(1 << 30))
    # somewhat more than needed pass by the hash; of those the first come
    share = lambda y: min(1 << 30, int((1 << 30) * 1.5 * rows / max(1, counts.get(y, 0))) + 1)
    picked = by_id.withColumn("h", order).where(F.col("h") < F.when(F.col("y") == 1, share(1)).otherwise(share(0)))
    texts = docs.select(F.col(f"`{id_column}`").alias("doc_id"), F.col(f"`{text_column}`").alias("text")).where(F.length("text") <= chars)
    ids = []
    for y in (0, 1):
        ids += [(r["labelled"], y) for r in picked.where(F.col("y") == y).orderBy("h", "labelled").limit(rows).collect()]
    if not ids:
        return fit([], (0, 0))
    # 2 * rows ids at most: a size that a parameter bounds
    small = docs.sparkSession.createDataFrame(ids, f"own {docs.schema[id_column].dataType.simpleString()}, y int")
    # an id that documents repeat counts once
    sample = texts.join(F.broadcast(small), F.col("doc_id") == F.col("own")).groupBy("doc_id", "y").agg(F.min("text").alias("text")).collect()
    sample = sorted((r["doc_id"], r["text"], r["y"]) for r in sample)
    return fit([(text, y) for _, text, y in sample], (counts.get(0, 0), counts.get(1, 0)))


def _scorer(chain: Chain) -> Callable[[], Callable[..., Iterator[tuple]]]:
    class Numbers(dict):
        def __missing__(self, word: bytes) -> int:
            if len(self) >= WORDS:
                self.clear()
            self[word] = out = chain.number(plain(word.decode()))
            return out

    def start() -> Callable[..., Iterator[tuple]]:
        numbers, tagger = Numbers(), Tagger(chain)
        clean = chain.score([], 1)

        def f(doc_id: int | None, text: str | None) -> Iterator[tuple]:
            spans, score = [], clean
            if text and chain.vocabulary:
                # bytes.split() parts at the six ASCII white spaces, which are the contract's
                found = list(map(numbers.__getitem__, text.encode().split()))
                places, marginals = tagger.tag(found)
                if places:
                    score = chain.score(marginals, len(found))
                    if max(marginals) >= 0.5:
                        words = list(_WORDS.finditer(text))
                        spans = [{"start": words[k].start(), "end": words[k].end(), "p": p} for k, p in zip(places, marginals, strict=True) if p >= 0.5]
            yield doc_id, score, spans

        return f

    return start


def score(docs: DataFrame, chain: Chain, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, score and spans, an array of (start, end, p) of offending words, of each row.

    Null and empty texts, and those without a word of the vocabulary, get the rate of toxic rows among such. Whole texts
    are read; repeated rows get equal results each; other columns aren't read; no shuffle.
    """
    kind = docs.schema[id_column].dataType.simpleString()
    return map_rows(docs, [id_column, text_column], f"doc_id {kind}, score double, spans array<struct<start: bigint, end: bigint, p: double>>", _scorer(chain))


def drop_toxic(docs: DataFrame, chain: Chain, text_column: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all their columns, whose score is under threshold.

    Null and empty texts stay unless the rate of toxic rows among such reaches threshold; repeated rows fare alike; an empty
    table gives no rows. Columns may have any names.
    """
    names = docs.columns
    at = names.index(text_column)

    def start() -> Callable[..., Iterator[tuple]]:
        scored = _scorer(chain)()

        def f(*row: object) -> Iterator[tuple]:
            if next(scored(None, row[at]))[1] < threshold:
                yield row

        return f

    return map_rows(docs, names, docs.schema, start)
