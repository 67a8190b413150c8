"""Edit-distance alignment of short queries to many sequences at once: bit-parallel columns, one lane a sequence."""

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from strandloom.functions import lanes

#: Cells of a block of lanes, which bounds memory for long reads.
CELLS = 1 << 24


@dataclass(frozen=True)
class Hits:
    """Of each lane: the least distance, and of all places that have it the lane, start and end, from 0, both inclusive.

    Lanes that match best with nothing have one place with start 0 and end -1 first.
    """

    distance: np.ndarray
    lane: np.ndarray
    start: np.ndarray
    end: np.ndarray


def matrix(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Sequences as columns of bytes, padded with 0, and their lengths."""
    lengths = np.array([len(t) for t in texts], np.int64)
    out = np.zeros((len(texts), int(lengths.max(initial=0))), np.uint8)
    for k, t in enumerate(texts):
        out[k, : len(t)] = np.frombuffer(t, np.uint8)
    return np.ascontiguousarray(out.T), lengths


def column_scores(query: bytes, columns: np.ndarray, prefix: bool) -> np.ndarray:
    """Distances of the query, of up to 64 bases, to the substrings that end at each place of each lane: a row a place.

    prefix: substrings start with the lane; else anywhere. One query for all lanes, one word a lane (Myers, 1999).
    """
    m, n = len(query), columns.shape[1]
    out = np.empty((columns.shape[0], n), np.int32)
    letters = np.frombuffer(query, np.uint8)
    # words of 32 bits where they do: half the memory to go through
    word = np.uint32 if m <= 32 else np.uint64
    equal = np.zeros(256, word)
    for i, c in enumerate(letters):
        equal[c] |= word(1 << i)
    one, top = word(1), word(m - 1)
    up, down = np.full(n, ~word(0)), np.zeros(n, word)
    score = np.full(n, m, np.int32)
    eq, vertical, across, more, less = (np.empty(n, word) for _ in range(5))
    for j in range(columns.shape[0]):
        np.take(equal, columns[j], out=eq)
        np.bitwise_or(eq, down, out=vertical)
        np.bitwise_and(eq, up, out=across)
        across += up
        across ^= up
        across |= eq
        np.bitwise_or(across, up, out=more)
        np.invert(more, out=more)
        more |= down
        np.bitwise_and(up, across, out=less)
        score += (more >> top & one).astype(np.int32)
        score -= (less >> top & one).astype(np.int32)
        out[j] = score
        more <<= one
        if prefix:
            more |= one
        less <<= one
        np.bitwise_or(vertical, more, out=up)
        np.invert(up, out=up)
        up |= less
        np.bitwise_and(more, vertical, out=down)
    return out


def _block(query: bytes, columns: np.ndarray, lengths: np.ndarray) -> Hits:
    m, n = len(query), len(lengths)
    scores = column_scores(query, columns, prefix=False)
    scores[np.arange(columns.shape[0])[:, None] >= lengths[None, :]] = m + 1
    best = np.minimum(scores.min(axis=0, initial=m), m)
    end, lane = np.nonzero(scores == best[None, :])
    order = np.lexsort((end, lane))
    end, lane = end[order], lane[order]
    start = _starts(query, columns, lane, end, best[lane])
    nothing = np.flatnonzero(best == m)
    lane, start, end = np.concatenate([nothing, lane]), np.concatenate([np.zeros(len(nothing), np.int64), start]), np.concatenate([np.full(len(nothing), -1), end])
    order = np.lexsort((end, lane))
    return Hits(best.astype(np.int64), lane[order], start[order], end[order])


def query_scores(queries: list[bytes], columns: np.ndarray) -> np.ndarray:
    """column_scores() of several queries, substrings starting anywhere: places, lanes, queries.

    A query ends at its word's top, whose sign tells how its distance changes. The bits under it are rows that match
    everything, and stay 0.
    """
    word, signed = (np.uint32, np.int32) if max(map(len, queries)) <= 32 else (np.uint64, np.int64)
    n, k, bits = columns.shape[1], len(queries), 8 * np.dtype(word).itemsize
    equal, begin = np.zeros((256, k), word), np.zeros(k, word)
    for q, query in enumerate(queries):
        free = bits - len(query)
        equal[:, q] = word((1 << free) - 1)
        begin[q] = word((1 << bits) - (1 << free))
        for i, c in enumerate(query):
            equal[c, q] |= word(1 << (free + i))
    out, one = np.empty((columns.shape[0], n, k), np.int8), word(1)
    up, down = np.tile(begin, (n, 1)), np.zeros((n, k), word)
    score = np.tile(np.array([len(q) for q in queries], np.int8), (n, 1))
    eq, vertical, across, more, less = (np.empty((n, k), word) for _ in range(5))
    sign = np.empty((n, k), bool)
    step, rises, falls = sign.view(np.int8), more.view(signed), less.view(signed)
    for j in range(columns.shape[0]):
        # a byte is always within the table, and clip writes to out at once
        np.take(equal, columns[j], axis=0, out=eq, mode="clip")
        np.bitwise_or(eq, down, out=vertical)
        np.bitwise_and(eq, up, out=across)
        across += up
        across ^= up
        across |= eq
        np.bitwise_or(across, up, out=more)
        np.invert(more, out=more)
        more |= down
        np.bitwise_and(up, across, out=less)
        np.less(rises, 0, out=sign)
        score += step
        np.less(falls, 0, out=sign)
        score -= step
        out[j] = score
        more <<= one
        less <<= one
        np.bitwise_or(vertical, more, out=up)
        np.invert(up, out=up)
        up |= less
        np.bitwise_and(more, vertical, out=down)
    return out


def near_places(query: bytes, texts: list[bytes], most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lanes, starts, ends and distances of all places within a distance, by lane and start; of ends side by side the nearest, the first of equals.

    For queries of up to 64 bases.
    """
    return places_of([(query, most)], texts)[0]


def places_of(queries: list[tuple[bytes, int]], texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """near_places() of each query within its distance, all in one pass over the texts."""
    lengths = np.array([len(t) for t in texts], np.int64)
    size = len(queries)
    most = np.array([min(max(m, -1), 127) for _, m in queries], np.int8)
    parts = [[] for _ in queries]
    for some in _alike(lengths, CELLS // 4 // size):
        columns, own = matrix([texts[k] for k in some])
        scores = query_scores([q for q, _ in queries], columns)
        near = np.ascontiguousarray((scores.reshape(len(columns), len(own) * size) <= np.tile(most, len(own))).T)
        lane, end = np.divmod(np.flatnonzero(near), max(1, len(columns)))
        inside = end < own[lane // size]
        lane, end = lane[inside], end[inside]
        if not len(lane):
            continue
        new = np.concatenate(([True], (lane[1:] != lane[:-1]) | (end[1:] != end[:-1] + 1)))
        run, score = np.cumsum(new) - 1, scores[end, lane // size, lane % size]
        least = np.flatnonzero(score == np.minimum.reduceat(score, np.flatnonzero(new))[run])
        pick = least[np.concatenate(([True], run[least][1:] != run[least][:-1]))]
        lane, end, score = lane[pick], end[pick], score[pick].astype(np.int64)
        for q, (query, _) in enumerate(queries):
            here = np.flatnonzero(lane % size == q)
            of, e, d = lane[here] // size, end[here], score[here]
            parts[q].append((some[of], _starts(query, columns, of, e, d), e, d))
    out = []
    for own in parts:
        lane, start, end, score = (np.concatenate(p) for p in zip(*own, strict=True)) if own else (np.zeros(0, np.int64),) * 4
        by = np.lexsort((start, lane))
        out.append((lane[by], start[by], end[by], score[by]))
    return out


def _alike(lengths: np.ndarray, cells: int = CELLS // 8) -> Iterator[np.ndarray]:
    """Lanes in blocks of similar length and bounded cells."""
    order, at = np.argsort(lengths, kind="stable"), 0
    widths = np.maximum(1, lengths[order])
    while at < len(order):
        left = widths[at : at + max(1, cells // int(widths[at]))]
        size = max(1, int(np.searchsorted(left * np.arange(1, len(left) + 1), cells, side="right")))
        yield order[at : at + size]
        at += size


def _starts(query: bytes, columns: np.ndarray, lane: np.ndarray, end: np.ndarray, best: np.ndarray) -> np.ndarray:
    """The least start for each end: the reversed query against the reversed text, whose last best place it is.

    What is no distance away is as long as the query, and what is some is longer by that at most.
    """
    start, apart = end - len(query) + 1, np.flatnonzero(best)
    width = min(columns.shape[0], len(query) + int(best.max(initial=0)))
    step = max(1, CELLS // max(1, width * 8))
    for a in range(0, len(apart), step):
        some = apart[a : a + step]
        e, k = end[some], lane[some]
        at = e[None, :] - np.arange(width)[:, None]
        window = np.where(at >= 0, columns[np.maximum(at, 0), k[None, :]], 0).astype(np.uint8)
        back = column_scores(query[::-1], window, prefix=True)
        fits = (back == best[some][None, :]) & (at >= 0)
        steps = width - 1 - fits[::-1].argmax(axis=0)
        start[some] = np.where(fits.any(axis=0), e - steps, e + 1)
    return start


def infix(query: bytes, texts: list[bytes]) -> Hits:
    """All places in each text at which a substring is nearest to the query. Longer queries than a word are lanes' (see lanes)."""
    if len(query) > lanes.WORD:
        return located([query.decode("latin-1")] * len(texts), [t.decode("latin-1") for t in texts], "infix")
    lengths = np.array([len(t) for t in texts], np.int64)
    parts = []
    for some in _alike(lengths):
        columns, own = matrix([texts[k] for k in some])
        parts.append((some, _block(query, columns, own)))
    distance = np.zeros(len(texts), np.int64)
    for some, h in parts:
        distance[some] = h.distance
    lane = np.concatenate([some[h.lane] for some, h in parts]) if parts else np.zeros(0, np.int64)
    start = np.concatenate([h.start for _, h in parts]) if parts else np.zeros(0, np.int64)
    end = np.concatenate([h.end for _, h in parts]) if parts else np.zeros(0, np.int64)
    by = np.lexsort((end, lane))
    return Hits(distance, lane[by], start[by], end[by])


def two_best(hits: Hits, exact: bool = False) -> np.ndarray:
    """For each lane (start, end, second start, second end), from 1; -1 where there is no second.

    The distinct starts and the ends, both in order, are paired by their place in the order. exact: each start keeps its
    own ends instead.
    """
    n = len(hits.distance)
    out = np.full((n, 4), -1, np.int64)
    start, end = hits.start + 1, hits.end + 1
    if exact:
        order = np.lexsort((end, start, hits.lane))
        lane, s, e = hits.lane[order], start[order], end[order]
        rank = np.arange(len(lane)) - np.searchsorted(lane, lane)
        for k in (0, 1):
            some = rank == k
            out[lane[some], 2 * k], out[lane[some], 2 * k + 1] = s[some], e[some]
        return out
    order = np.lexsort((start, hits.lane))
    lane, s = hits.lane[order], start[order]
    new = np.concatenate(([True], (lane[1:] != lane[:-1]) | (s[1:] != s[:-1]))) if len(lane) else np.zeros(0, bool)
    lane, s = lane[new], s[new]
    rank = np.arange(len(lane)) - np.searchsorted(lane, lane)
    ends_rank = np.arange(len(hits.lane)) - np.searchsorted(hits.lane, hits.lane)
    for k in (0, 1):
        some = rank == k
        out[lane[some], 2 * k] = s[some]
        ends = ends_rank == k
        place = np.full(n, -1, np.int64)
        place[hits.lane[ends]] = end[ends]
        out[lane[some], 2 * k + 1] = place[lane[some]]
    return out


@dataclass(frozen=True)
class Texts:
    """Texts in one run of bytes, in order and apart, with where each begins and its length."""

    flat: np.ndarray
    begin: np.ndarray
    lengths: np.ndarray

    @classmethod
    def of(cls, column: pa.Array) -> "Texts":
        """Those of a column of strings, where they lie; nulls are empty."""
        kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
        if not len(column):
            return cls(np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64))
        _, ends, data = column.buffers()
        ends = np.frombuffer(ends, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        flat = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
        lengths = np.diff(ends)
        if column.null_count:
            lengths[column.is_null().to_numpy(zero_copy_only=False)] = 0
        return cls(flat, ends[:-1] - ends[0], lengths)

    @classmethod
    def joined(cls, texts: list[bytes]) -> "Texts":
        lengths = np.array([len(t) for t in texts], np.int64)
        return cls(np.frombuffer(b"".join(texts), np.uint8), np.cumsum(lengths) - lengths, lengths)

    def within(self, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Places in flat from which so many bytes lie in one text, and the texts."""
        if not len(self.begin):
            return at[:0], at[:0]
        lane = np.searchsorted(self.begin, at, side="right") - 1
        inside = (lane >= 0) & (at + size <= self.begin[lane] + self.lengths[lane])
        return at[inside], lane[inside]

    def columns(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """matrix() of some of the texts."""
        own = self.lengths[some]
        width = int(own.max(initial=0))
        if not width:
            return np.zeros((0, len(some)), np.uint8), own
        # the last ones have nothing after them
        ahead = np.minimum(self.begin[some], len(self.flat) - width)
        rows = np.lib.stride_tricks.sliding_window_view(self.flat, width)[ahead] if len(self.flat) >= width else np.zeros((len(some), width), np.uint8)
        late = np.flatnonzero(ahead < self.begin[some])
        for k in late:
            a = self.begin[some[k]]
            rows[k, : own[k]] = self.flat[a : a + own[k]]
        if (own < width).any():
            rows[np.arange(width)[None, :] >= own[:, None]] = 0
        return np.ascontiguousarray(rows.T), own


def _eights(flat: np.ndarray) -> np.ndarray:
    """Of each place two bits of each of its eight bytes, by which bases differ."""
    if len(flat) < 8:
        return np.zeros(0, np.uint16)
    one = flat >> 1 & 3
    two = one[:-1] << 2 | one[1:]
    four = two[:-2] << 4 | two[2:]
    return four[:-4].astype(np.uint16) << 8 | four[4:]


def _occurrences(query: bytes, texts: Texts, eights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lanes and places, from 0, of all exact occurrences of a query, in order."""
    letters = np.frombuffer(query, np.uint8)
    at = np.flatnonzero(eights == _eights(letters)[0]) if len(query) >= 8 else np.arange(len(texts.flat))
    at, lane = texts.within(at, len(query))
    same = np.flatnonzero((texts.flat[at[:, None] + np.arange(len(query))] == letters).all(axis=1))
    return lane[same], at[same] - texts.begin[lane[same]]


def best_places(queries: list[bytes], texts: Texts, exact: bool = False, under: list[float] | None = None) -> np.ndarray:
    """For each text and query the least distance and what two_best() has of infix(): texts, queries, five numbers.

    Queries that lie in a text as they are need no alignment; the others are aligned in one pass, with those of other texts
    that lack the same queries. Of places that are equally near, later ends have later starts (least ones: two best paths
    that crossed could be swapped at the crossing), so the first ends have the first starts, and no others are aligned
    backwards. under: distances from which on a query's second place isn't wanted, and so may be missing.
    """
    n, size = len(texts.lengths), len(queries)
    out = np.full((n, size, 5), -1, np.int64)
    under = under or [np.inf] * size
    eights = _eights(texts.flat)
    for q, query in enumerate(queries):
        if not 0 < len(query) <= lanes.WORD:
            _general(out, q, query, texts, np.arange(n), exact)
            continue
        lane, at = _occurrences(query, texts, eights)
        rank = np.arange(len(lane)) - np.searchsorted(lane, lane)
        for k in (0, 1):
            of, a = lane[rank == k], at[rank == k]
            out[of, q, 0], out[of, q, 1 + 2 * k], out[of, q, 2 + 2 * k] = 0, a + 1, a + len(query)
    mask = (out[:, :, 0] < 0) @ (1 << np.arange(size))
    kinds, count = np.unique(mask, return_counts=True)
    # few texts are worth no pass of their own
    rare = kinds[(count < FEW) & (kinds > 0)]
    if len(rare):
        mask[np.isin(mask, rare)] = np.bitwise_or.reduce(rare)
    for kind in np.unique(mask[mask > 0]):
        some, which = np.flatnonzero(mask == kind), [q for q in range(size) if kind >> q & 1]
        for block in _alike(texts.lengths[some], CELLS // 4 // len(which)):
            _nearest_places(out, queries, which, texts, some[block], exact, under)
    return out


#: Texts that lack the same queries are aligned by themselves if there are so many.
FEW = 512


def _general(out: np.ndarray, q: int, query: bytes, texts: Texts, some: np.ndarray, exact: bool) -> None:
    """A query's numbers of some texts, by all of its places."""
    hits = infix(query, [texts.flat[a : a + m].tobytes() for a, m in zip(texts.begin[some], texts.lengths[some], strict=True)])
    out[some, q, 0], out[some, q, 1:] = hits.distance, two_best(hits, exact)


def _nearest_places(out: np.ndarray, queries: list[bytes], which: list[int], texts: Texts, some: np.ndarray, exact: bool, under: list[float]) -> None:
    """Numbers of some texts of similar length and some queries."""
    columns, own = texts.columns(some)
    size, width = len(which), len(columns)
    longest = np.array([len(queries[q]) for q in which])
    if not width:
        best = np.tile(longest, (len(some), 1))
    else:
        scores = query_scores([queries[q] for q in which], columns)
        best = np.minimum(scores.min(axis=0), longest.astype(np.int8))
    for k, q in enumerate(which):
        # what matches best with nothing has a place before the text
        none = some[best[:, k] == longest[k]]
        if len(none):
            _general(out, q, queries[q], texts, none, exact)
    if not width:
        return
    end, pair = np.divmod(np.flatnonzero(scores == best[None]), len(some) * size)
    inside = (end < own[pair // size]) & (best.ravel() < np.tile(longest, len(some)))[pair]
    # pairs of texts and queries in order, and their ends
    pair, end = np.divmod(np.sort(pair[inside] * width + end[inside]), width)
    first = np.flatnonzero(np.diff(pair, prepend=-1))
    count = np.diff(np.append(first, len(pair)))
    for k, q in enumerate(which):
        own_first, own_count = first[pair[first] % size == k], count[pair[first] % size == k]
        lane, e = pair[own_first] // size, end[own_first]
        d = best[lane, k].astype(np.int64)
        several = np.flatnonzero((own_count > 1) & (d < under[q]))
        second = own_first[several] + 1
        starts = _starts(queries[q], columns, np.concatenate([lane, lane[several]]), np.concatenate([e, end[second]]), np.concatenate([d, d[several]]))
        s, next_s = starts[: len(lane)], starts[len(lane) :]
        out[some[lane], q] = -1
        out[some[lane], q, 0], out[some[lane], q, 1], out[some[lane], q, 2] = d, s + 1, e + 1
        good = np.full(len(several), True)
        if not exact:
            good = next_s > s[several]
            left = np.flatnonzero(~good & (own_count[several] > 2))
            if len(left):
                # the first of the later ends that has another start
                n = own_count[several[left]] - 2
                row = np.repeat(np.arange(len(left)), n)
                at = np.repeat(second[left] + 1 - (np.cumsum(n) - n), n) + np.arange(len(row))
                more = _starts(queries[q], columns, pair[at] // size, end[at], best[pair[at] // size, k].astype(np.int64))
                later = np.flatnonzero(more > s[several[left]][row])
                row, at = np.unique(row[later], return_index=True)
                next_s[left[row]], good[left[row]] = more[later[at]], True
        of = some[lane[several[good]]]
        out[of, q, 3], out[of, q, 4] = next_s[good] + 1, end[second[good]] + 1


def tails(base: str, texts: list[bytes], window: int = 16, least: int = 12) -> np.ndarray:
    """For each text start and stop, from 1, of its poly tail as poly_tail() of sequence has it; -1 where there is none."""
    return tails_of(base, Texts.joined(texts), window, least)


def tails_of(base: str, texts: Texts, window: int = 16, least: int = 12) -> np.ndarray:
    """tails() of texts in one run of bytes."""
    out = np.full((len(texts.lengths), 2), -1, np.int64)
    if len(texts.flat) < window:
        return out
    # sums of windows over all texts, by parts that double; windows that reach over a text's end don't count
    sums = ((texts.flat | 32) == ord(base.lower())).view(np.uint8)
    total, size, at = None, 1, 0
    while True:
        if window & size:
            part = sums[at : at + len(texts.flat) - window + 1]
            total, at = part if total is None else total + part, at + size
        size *= 2
        if size > window:
            break
        sums = sums[: -(size // 2)] + sums[size // 2 :]
    at, of = texts.within(np.flatnonzero(total >= least), window)
    first, last = np.flatnonzero(np.diff(of, prepend=-1)), np.flatnonzero(np.diff(of, append=-1))
    out[of[first], 0], out[of[last], 1] = at[first] - texts.begin[of[first]] + 1, at[last] - texts.begin[of[last]] + window
    return out


#: How a query lies in a text: all of both; all of the query and the text's beginning; all of the query and a part of the text.
MODES = ("global", "prefix", "infix")


@dataclass(frozen=True)
class Alignment:
    """The least distance, -1 if it is over the bound; all places that have it, from 0, both ends inclusive, and with an end of -1
    where nothing of the text is used; and a best path of the first place, if asked for."""

    distance: int
    starts: tuple[int, ...] = ()
    ends: tuple[int, ...] = ()
    path: str | None = None


def located(queries: list[str], texts: list[str], mode: str = "infix", most: int = -1, equal: Iterable[tuple[str, str]] = (), starts: bool = True) -> Hits:
    """Of each pair the least distance, -1 if it is over the bound most (none if negative), and all places that have it.

    An empty query lies at the text's beginning. equal: pairs of different letters that match. Without starts, places of
    infix have ends alone, which saves an alignment of each backwards; their starts are 0.
    """
    if mode not in MODES:
        raise ValueError(f"mode is one of {', '.join(MODES)}")
    pairs = lanes.Pairs(queries, texts, equal)
    distance, lane, end = lanes.distances(pairs, mode, most)
    start = lanes.starts(pairs, distance, lane, end) if starts and mode == "infix" else np.zeros(len(lane), np.int64)
    return Hits(distance, lane, start, end)


def global_path(query: str, text: str, equal: Iterable[tuple[str, str]] = (), table: int = lanes.TABLE) -> tuple[int, str]:
    """Distance of two whole strings, and a best path as = X I D: from the end, insertions before deletions before pairs.

    Strings whose table of moves has over so many bytes are cut in two, so memory doesn't grow with their product.
    """
    path = lanes.paths([query], [text], equal, table)[0].tobytes().decode()
    return path.count("X") + path.count("I") + path.count("D"), path


def pairwise(query: str, text: str, mode: str = "infix", most: int = -1, equal: Iterable[tuple[str, str]] = (), path: bool = False) -> Alignment:
    """One query in one text; see located()."""
    equal = tuple(equal)
    hits = located([query], [text], mode, most, equal)
    if hits.distance[0] < 0:
        return Alignment(-1)
    places = tuple(map(int, hits.start)), tuple(map(int, hits.end))
    return Alignment(int(hits.distance[0]), *places, global_path(query, text[places[0][0] : places[1][0] + 1], equal)[1] if path else None)


def cigar(path: str, extended: bool = False) -> str:
    """Run lengths of a path; pairs are M unless extended."""
    if not extended:
        path = path.replace("=", "M").replace("X", "M")
    out, k = [], 0
    while k < len(path):
        j = k
        while j < len(path) and path[j] == path[k]:
            j += 1
        out.append(f"{j - k}{path[k]}")
        k = j
    return "".join(out)
