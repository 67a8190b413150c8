"""Edit distances of many pairs of strings at once: a lane a pair, queries of any length in words of 64 bits.

Columns of a table of distances are kept as bits that say where a row is one more, or one less, than the row above
(Myers, 1999; words with carries: Hyyro, 2003). All lanes of a block go through a column together. Where a query has
several words, only those are computed in which distances up to a bound can stand (Ukkonen, 1985); the bound doubles for
the lanes that find nothing within it. So time grows with a pair's distance rather than its query.
"""

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np

WORD = 64
#: Words of a column that a block of lanes has at most.
WORDS = 1 << 18
#: Lanes for each word of a query from which on words of many lanes are faster than one lane's long integers.
CROWD = 8
#: The bound that queries of several words start with.
BOUND = 64
#: Bytes of a block's table of moves, and of a pair's, which is cut in two where a best path goes through if it is larger.
BLOCK_TABLE, TABLE = 1 << 25, 1 << 18
_ALL, _ONE = ~np.uint64(0), np.uint64(1)


@dataclass(frozen=True)
class Block:
    """Lanes whose queries have the same number of words, by length of text; their texts' letters are codes, 0 for those that
    match nothing, in one array for all, from a place on, forwards or back."""

    lanes: np.ndarray
    flat: np.ndarray
    first: np.ndarray
    way: int
    lengths: np.ndarray
    rows: np.ndarray
    words: int
    #: For each different query, letter and word the places that match, and where in it each lane's query starts.
    match: np.ndarray
    own: np.ndarray

    @property
    def width(self) -> int:
        return int(self.lengths[-1]) if len(self.lengths) else 0

    def letters(self, j: int | np.ndarray, some: slice | np.ndarray) -> np.ndarray:
        """Where the match of each lane's j-th letter, of lanes that have one, begins."""
        return self.own[some] + self.flat.take(self.first[some] + self.way * j).astype(np.int64) * self.words

    def size(self, word: int) -> np.ndarray:
        """Rows of a word, by lane."""
        return np.minimum(self.rows - word * WORD, WORD)


class Pairs:
    """Pairs of a query and a text, by lane, and which different letters match."""

    def __init__(self, queries: list[str], texts: list[str], equal: Iterable[tuple[str, str]] = ()):
        self.queries, self.texts, self.equal = queries, texts, tuple(equal)
        letters = sorted({c for q in set(queries) for c in q} | {c for pair in self.equal for c in pair})
        self.code = {c: k for k, c in enumerate(letters, 1)}
        self.rows, self.lengths = (np.fromiter(map(len, x), np.int64, len(x)) for x in (queries, texts))
        self.begin = np.cumsum(self.lengths) - self.lengths
        self.flat = self._coded("".join(texts))

    def _coded(self, text: str) -> np.ndarray:
        kind = np.uint8 if len(self.code) < 256 else np.uint32
        if text.isascii():
            table = np.zeros(128, kind)
            for c, k in self.code.items():
                if ord(c) < 128:
                    table[ord(c)] = k
            return table[np.frombuffer(text.encode(), np.uint8)]
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        known = np.array([ord(c) for c in self.code] or [0], np.uint32)
        at = np.minimum(np.searchsorted(known, points), len(known) - 1)
        return np.where(known[at] == points, at + bool(self.code), 0).astype(kind)

    def blocks(self, lanes: np.ndarray, start: np.ndarray, length: np.ndarray, back: bool = False, table: int = 0) -> Iterator[Block]:
        """Blocks of lanes, each with the part of its text that begins at a place; back: queries and parts read backwards.

        table: bytes that a block's moves take at most, if it isn't one pair.
        """
        words = -(-self.rows[lanes] // WORD)
        order = np.lexsort((length, words))
        at = 0
        while at < len(order):
            w = int(words[order[at]])
            # lengths go up within a number of words, so the last one's counts
            most = max(1, min(len(order) - at, WORDS // max(1, w)))
            sizes = length[order[at : at + most]] * np.arange(1, most + 1) * (16 * w)
            fits = (words[order[at : at + most]] == w) & ((sizes <= table) | (table == 0))
            n = max(1, int(fits.argmin()) if not fits.all() else most)
            take = order[at : at + n]
            at += n
            yield self._block(lanes[take], start[take], length[take], w, back)

    def _block(self, lanes: np.ndarray, start: np.ndarray, length: np.ndarray, words: int, back: bool) -> Block:
        first = self.begin[lanes] + start + (length - 1 if back else 0)
        different: dict[str, int] = {}
        own = np.fromiter((different.setdefault(self.queries[k], len(different)) for k in lanes), np.int64, len(lanes))
        match = np.zeros((len(different), len(self.code) + 1, words), np.uint64)
        for k, q in enumerate(different):
            codes, place = self._coded(q[::-1] if back else q), np.arange(len(q))
            np.bitwise_or.at(match[k], (codes, place // WORD), _ONE << (place % WORD).astype(np.uint64))
        if self.equal:
            plain = match.copy()
            for a, b in self.equal:
                match[:, self.code[a]] |= plain[:, self.code[b]]
                match[:, self.code[b]] |= plain[:, self.code[a]]
        return Block(lanes, self.flat, first, -1 if back else 1, length, self.rows[lanes], words, match.ravel(), own * (match.shape[1] * words))

    def part(self, lane: int, start: int, length: int) -> str:
        return self.texts[lane][start : start + length]


def _step(up: np.ndarray, down: np.ndarray, match: np.ndarray, more: np.ndarray, less: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One word's next column: its up and down, and which rows are one more and one less than in the column before.

    more, less: whether the row above the word is one more or one less than before.
    """
    vertical = match | down
    match = match | less
    across = (((match & up) + up) ^ up) | match
    rise, fall = down | ~(across | up), up & across
    shifted, sunk = rise << _ONE | more, fall << _ONE | less
    return sunk | ~(vertical | shifted), shifted & vertical, rise, fall


class _Places:
    """Places with the best score so far, of each lane."""

    def __init__(self, bound: np.ndarray):
        self.best = bound.copy()
        self.kept: list[tuple[np.ndarray, int, np.ndarray]] = []

    def see(self, end: int, first: int, scores: np.ndarray, some: np.ndarray | None = None) -> None:
        """Scores of the lanes from first on, or of some of those, at an end."""
        own = self.best[first:] if some is None else self.best[first + some]
        near = np.flatnonzero(scores <= own)
        if len(near):
            lanes = first + (near if some is None else some[near])
            self.best[lanes] = scores[near]
            self.kept.append((lanes, end, scores[near]))

    def ends(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.kept:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        lanes = np.concatenate([k[0] for k in self.kept])
        ends = np.repeat(np.array([k[1] for k in self.kept]), [len(k[0]) for k in self.kept])
        good = np.concatenate([k[2] for k in self.kept]) == self.best[lanes]
        return lanes[good], ends[good]


def _anchored(b: Block, bound: int, whole: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of lanes whose text begins with the match: whether they are within the bound, as a distance, else one over it; lanes and ends.

    whole: the match is the whole text. Distances within the bound stand at most so many rows off the diagonal.
    """
    n, w = len(b.lanes), b.words
    up, down = np.full((w, n), _ALL), np.zeros((w, n), np.uint64)
    score = np.stack([k * WORD + b.size(k) for k in range(w)]).astype(np.int64)
    top = ((b.rows - 1) % WORD).astype(np.uint64)
    found = _Places(np.full(n, bound))
    if not whole:
        found.see(-1, 0, b.rows)
    elif len(zero := np.flatnonzero(b.lengths == 0)):
        found.see(-1, 0, b.rows[zero], zero)
    active = -1
    for j in range(b.width):
        a = int(np.searchsorted(b.lengths, j, side="right"))
        low, high = max(0, (j - bound) // WORD), min(w - 1, (j + bound) // WORD)
        more, less, change, place = np.full(n - a, _ONE), np.zeros(n - a, np.uint64), 0, b.letters(j, slice(a, None))
        for k in range(low, high + 1):
            here = score[k, a:]
            if k > active >= 0:
                # as of the column before
                here[:] = score[k - 1, a:] - change + b.size(k)[a:]
            up[k, a:], down[k, a:], rise, fall = _step(up[k, a:], down[k, a:], b.match.take(place + k), more, less)
            at = top[a:] if k == w - 1 else np.uint64(WORD - 1)
            more, less = rise >> at & _ONE, fall >> at & _ONE
            change = more.astype(np.int64) - less.astype(np.int64)
            here += change
        active = high
        if low <= high == w - 1:
            if whole:
                e = int(np.searchsorted(b.lengths, j + 1, side="right"))
                if e > a:
                    found.see(j, a, score[-1, a:e], np.arange(e - a))
            else:
                found.see(j, a, score[-1, a:])
    lanes, ends = found.ends()
    distance = np.full(n, bound + 1)
    distance[lanes] = found.best[lanes]
    return distance, lanes, ends


def _anywhere(b: Block, bound: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As _anchored(), of lanes whose match lies anywhere: each has words down to the last that may have distances within its best."""
    n, w = len(b.lanes), b.words
    up, down = np.full((w, n), _ALL), np.zeros((w, n), np.uint64)
    score = np.stack([k * WORD + b.size(k) for k in range(w)]).astype(np.int64)
    top = ((b.rows - 1) % WORD).astype(np.uint64)
    found = _Places(np.full(n, bound))
    found.see(-1, 0, b.rows)
    last = np.minimum(w - 1, found.best // WORD)
    none = np.zeros(n, np.uint64)
    for j in range(b.width):
        a = int(np.searchsorted(b.lengths, j, side="right"))
        # the lanes that have a word; all of them have the first
        some, more, less, place = slice(a, None), none[a:], none[a:], b.letters(j, slice(a, None))
        for k in range(w):
            before = score[k, some]
            up[k, some], down[k, some], rise, fall = _step(up[k, some], down[k, some], b.match.take(place + k), more, less)
            at = top[some] if k == w - 1 else np.uint64(WORD - 1)
            more, less = rise >> at & _ONE, fall >> at & _ONE
            after = before + more.astype(np.int64) - less.astype(np.int64)
            if k == w - 1:
                score[k, some] = after
                break
            new = (last[some] == k) & (np.minimum(before, after + 1) <= found.best[some])
            keep = np.flatnonzero((last[some] > k) | new)
            lanes = (np.arange(a, n) if isinstance(some, slice) else some)[keep]
            fresh = new[keep]
            f = lanes[fresh]
            # a word that joins is as of the column before
            up[k + 1, f], down[k + 1, f], score[k + 1, f], last[f] = _ALL, 0, before[keep][fresh] + b.size(k + 1)[f], k + 1
            score[k, some] = after
            if not len(keep):
                break
            some, more, less, place = lanes, more[keep], less[keep], place[keep]
        if w == 1:
            found.see(j, a, score[0, a:])
            continue
        full = np.flatnonzero(last[a:] == w - 1)
        if len(full):
            found.see(j, a, score[-1, a + full], full)
        for k in range(w - 1, 0, -1):
            last[a:] -= (last[a:] == k) & (score[k, a:] >= found.best[a:] + WORD)
    lanes, ends = found.ends()
    distance = np.full(n, bound + 1)
    distance[lanes] = found.best[lanes]
    return distance, lanes, ends


def distances(pairs: Pairs, mode: str, most: int = -1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each lane the least distance, -1 if over the bound most; lanes and ends, in order, of all places that have it.

    Ends count from 0 and are inclusive; -1 uses nothing of the text. An empty query lies at the text's beginning.
    """
    m, n = pairs.rows, pairs.lengths
    distance = np.full(len(m), -1)
    lanes, ends = [], []
    limit = np.maximum(m, n) if most < 0 else np.minimum(np.maximum(m, n), most)
    bare = np.flatnonzero(m == 0)
    distance[bare] = np.where((n[bare] <= limit[bare]) | (mode != "global"), n[bare] if mode == "global" else 0, -1)
    lanes.append(bare[distance[bare] >= 0])
    ends.append(n[lanes[0]] - 1 if mode == "global" else np.full(len(lanes[0]), -1))
    alike = np.zeros(len(m), bool)
    if mode == "global":
        # equal strings are 0 apart, without a table
        alike[m == n] = [pairs.queries[k] == pairs.texts[k] for k in np.flatnonzero(m == n)]
        alike &= m > 0
        distance[alike] = 0
        lanes.append(np.flatnonzero(alike))
        ends.append(n[alike] - 1)
    todo = np.flatnonzero((m > 0) & ~alike & ((abs(m - n) <= limit) | (mode != "global")))
    bound = BOUND
    while len(todo):
        # one word costs the same whatever the bound
        left = []
        for single in (True, False):
            part = todo[(m[todo] <= WORD) == single]
            if not len(part):
                continue
            most_here = int(limit[part].max()) if single else min(bound, int(limit[part].max()))
            if mode == "global":
                # a distance is no less than the lengths'
                near = abs(m[part] - n[part]) <= most_here
                left.append(part[~near])
                part = part[near]
            reach = n[part] if mode != "prefix" else np.minimum(n[part], m[part] + np.minimum(limit[part], most_here))
            for b in pairs.blocks(part, np.zeros(len(part), np.int64), reach):
                if len(b.lanes) < CROWD * b.words and not single:
                    got, k, e = _alone(pairs, b, mode)
                    limit_here = int(max(most_here, got.max()))
                else:
                    got, k, e = _anywhere(b, most_here) if mode == "infix" else _anchored(b, most_here, mode == "global")
                    limit_here = most_here
                fine = got <= np.minimum(limit[b.lanes], limit_here)
                distance[b.lanes[fine]] = got[fine]
                good = fine[k]
                lanes.append(b.lanes[k[good]])
                ends.append(e[good])
                left.append(b.lanes[~fine & (limit[b.lanes] > limit_here)])
        todo, bound = np.concatenate(left) if left else todo[:0], bound * 2
    lanes, ends = np.concatenate(lanes), np.concatenate(ends)
    order = np.lexsort((ends, lanes))
    return distance, lanes[order], ends[order]


def starts(pairs: Pairs, distance: np.ndarray, lanes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The least start of a match of each lane's distance that has the end given, for matches that lie anywhere; 0 at the end -1."""
    out = np.zeros(len(lanes), np.int64)
    some = np.flatnonzero((ends >= 0) & (pairs.rows[lanes] > 0))
    # a match is longer than the query by its distance at most
    width = np.minimum(ends[some] + 1, pairs.rows[lanes[some]] + distance[lanes[some]])
    for cut in np.split(some, np.flatnonzero(np.diff(np.arange(len(some)) // WORDS)) + 1) if len(some) else []:
        place = np.searchsorted(some, cut)
        numbered = _Part(pairs, lanes[cut])
        for b in numbered.blocks(np.arange(len(cut)), ends[cut] + 1 - width[place], width[place], back=True):
            k, e = _last_ends(numbered, b, distance[lanes[cut[b.lanes]]])
            out[cut[b.lanes[k]]] = ends[cut[b.lanes[k]]] - e
    return out


class _Part(Pairs):
    """Lanes of other pairs, some of them many times."""

    def __init__(self, pairs: Pairs, of: np.ndarray):
        self.code, self.equal, self.flat = pairs.code, pairs.equal, pairs.flat
        self.rows, self.lengths, self.begin = pairs.rows[of], pairs.lengths[of], pairs.begin[of]
        self.queries, self.texts = [pairs.queries[k] for k in of], [pairs.texts[k] for k in of]


def _last_ends(pairs: Pairs, b: Block, distance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The last end of each lane's match, of those that begin with the text."""
    few = 1 < b.words and len(b.lanes) < CROWD * b.words
    found, lanes, ends = _alone(pairs, b, "prefix") if few else _anchored(b, int(distance.max(initial=0)), False)
    good = found[lanes] == distance[lanes]
    lanes, ends = lanes[good], ends[good]
    last = np.full(len(b.lanes), -1)
    np.maximum.at(last, lanes, ends)
    some = np.flatnonzero(last >= 0)
    return some, last[some]


def _integers(query: str, text: str, equal: tuple[tuple[str, str], ...], anchored: bool) -> Iterator[tuple[int, int, int]]:
    """For each beginning of the text, from the first letter on, the column's ups and downs, and its last row. The words are Python's integers."""
    m, own = len(query), {}
    for c in set(query):
        own[c] = int("".join("1" if x == c else "0" for x in reversed(query)), 2)
    match = dict(own)
    for a, b in equal:
        for c, d in ((a, b), (b, a)):
            if d in own:
                match[c] = match.get(c, 0) | own[d]
    full, top = (1 << m) - 1, m - 1
    up, down, score = full, 0, m
    for c in text:
        eq = match.get(c, 0)
        vertical = eq | down
        across = ((((eq & up) + up) ^ up) | eq) & full
        more, less = down | full ^ (across | up) & full, up & across
        score += (more >> top) - (less >> top)
        more, less = more << 1 | anchored, less << 1
        up, down = (less | ~(vertical | more)) & full, more & vertical & full
        yield up, down, score


def _alone(pairs: Pairs, b: Block, mode: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As _anchored() and _anywhere(), a lane at a time and without a bound: for few lanes whose queries have many words."""
    distance, lanes, ends = np.zeros(len(b.lanes), np.int64), [], []
    for at, lane in enumerate(b.lanes):
        n, first = int(b.lengths[at]), int(b.first[at] - pairs.begin[lane])
        text = pairs.part(lane, first, n) if b.way > 0 else pairs.part(lane, first - n + 1, n)[::-1]
        query = pairs.queries[lane][:: b.way]
        scores = np.fromiter((s for *_, s in _integers(query, text, pairs.equal, mode != "infix")), np.int64, n)
        scores = np.concatenate(([len(query)], scores))
        places = np.array([n]) if mode == "global" else np.flatnonzero(scores == scores.min())
        distance[at] = scores[places[0]]
        lanes.append(np.full(len(places), at))
        ends.append(places - 1)
    return distance, np.concatenate(lanes), np.concatenate(ends)


def _last_column(query: str, text: str, equal: tuple[tuple[str, str], ...]) -> np.ndarray:
    """Distances of all beginnings of the query to the text."""
    m, (up, down) = len(query), ((1 << len(query)) - 1, 0)
    for up, down, _ in _integers(query, text, equal, True):  # noqa: B007
        pass
    bits = lambda x: np.unpackbits(np.frombuffer(x.to_bytes(m // 8 + 1, "little"), np.uint8), bitorder="little")[:m].astype(np.int64)
    return np.concatenate(([0], np.cumsum(bits(up) - bits(down)))) + len(text)


def _parts(query: str, text: str, equal: tuple[tuple[str, str], ...], table: int) -> Iterator[tuple[str, str]]:
    """Pairs of parts, in order, whose best paths make one of the whole pair, each with a table within so many bytes (Hirschberg, 1975).

    Among the rows that a best path may cross a cut in, the least is taken.
    """
    if len(text) < 2 or not query or len(text) * -(-len(query) // WORD) * 16 <= table:
        yield query, text
        return
    half = len(text) // 2
    total = _last_column(query, text[:half], equal) + _last_column(query[::-1], text[half:][::-1], equal)[::-1]
    cut = int(total.argmin())
    yield from _parts(query[:cut], text[:half], equal, table)
    yield from _parts(query[cut:], text[half:], equal, table)


#: Moves of a path: a pair of letters that match or don't, a letter of the query alone, a letter of the text alone.
SAME, OTHER, QUERY, TEXT = (ord(c) for c in "=XID")


def _traced(b: Block) -> tuple[np.ndarray, np.ndarray]:
    """For each lane, in a column, moves of a best path from the end back, and how many: the query's alone before the text's before pairs."""
    n, w, width = len(b.lanes), b.words, b.width
    ups, rises = np.empty((width + 1, w, n), np.uint64), np.empty((width + 1, w, n), np.uint64)
    up, down = np.full((w, n), _ALL), np.zeros((w, n), np.uint64)
    ups[0], rises[0] = _ALL, 0
    for j in range(width):
        a = int(np.searchsorted(b.lengths, j, side="right"))
        more, less, place = np.full(n - a, _ONE), np.zeros(n - a, np.uint64), b.letters(j, slice(a, None))
        for k in range(w):
            up[k, a:], down[k, a:], rise, fall = _step(up[k, a:], down[k, a:], b.match.take(place + k), more, less)
            rises[j + 1, k, a:] = rise
            more, less = rise >> np.uint64(WORD - 1), fall >> np.uint64(WORD - 1)
        ups[j + 1] = up
    i, j, lane = b.rows.copy(), b.lengths.copy(), np.arange(n)
    out, count = [], np.zeros(n, np.int64)
    going = np.flatnonzero((i > 0) | (j > 0))
    while len(going):
        r, c = i[going], j[going]
        word, bit = np.maximum(r - 1, 0) // WORD, (np.maximum(r - 1, 0) % WORD).astype(np.uint64)
        of = lambda table: (table[c, word, going] >> bit & _ONE).astype(bool)  # noqa: E731, B023
        query = (r > 0) & ((c == 0) | of(ups))
        text = ~query & ((r == 0) | of(rises))
        pair = ~query & ~text
        same = np.zeros(len(going), bool)
        same[pair] = b.match.take(b.letters(c[pair] - 1, going[pair]) + word[pair]) >> bit[pair] & _ONE
        move = np.zeros(n, np.uint8)
        move[going] = np.where(query, QUERY, np.where(text, TEXT, np.where(same, SAME, OTHER)))
        out.append(move)
        i[going] -= ~text
        j[going] -= ~query
        count[going] += 1
        going = going[(i[going] > 0) | (j[going] > 0)]
    return np.array(out, np.uint8).reshape(len(out), n), count


def paths(queries: list[str], texts: list[str], equal: Iterable[tuple[str, str]] = (), table: int = TABLE) -> tuple[np.ndarray, np.ndarray]:
    """Best paths of whole pairs, as letters = X I D one after another, and how long each is.

    Memory is bounded by the table and the paths, whatever the strings' lengths: pairs with a larger table are cut in two,
    one at a time.
    """
    equal = tuple(equal)
    parts = [list(_parts(q, t, equal, table)) for q, t in zip(queries, texts, strict=True)]
    pairs = Pairs([q for p in parts for q, _ in p], [t for p in parts for _, t in p], equal)
    total = len(pairs.queries)
    pieces: list[np.ndarray | None] = [None] * total
    sizes = np.zeros(total, np.int64)
    # without a query there are only moves along the text
    lone = np.flatnonzero(pairs.rows == 0)
    sizes[lone] = pairs.lengths[lone]
    for k in lone:
        pieces[k] = np.full(sizes[k], TEXT, np.uint8)
    some = np.flatnonzero(pairs.rows > 0)
    for b in pairs.blocks(some, np.zeros(len(some), np.int64), pairs.lengths[some], table=BLOCK_TABLE):
        moves, count = _traced(b)
        back = moves.T[:, ::-1]
        flat = back[back > 0]
        for k, own in zip(b.lanes, np.split(flat, np.cumsum(count)[:-1]), strict=True):
            pieces[k] = own
        sizes[b.lanes] = count
    of = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    return (np.concatenate(pieces) if pieces else np.zeros(0, np.uint8)), np.bincount(of, sizes, len(parts)).astype(np.int64)


def runs(path: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of equal moves in paths one after another: their moves, lengths, and how many each path has."""
    of = np.repeat(np.arange(len(lengths)), lengths)
    new = np.concatenate(([True], (path[1:] != path[:-1]) | (of[1:] != of[:-1]))) if len(path) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    return path[at], np.diff(np.append(at, len(path))), np.bincount(of[at], minlength=len(lengths))
