"""Signatures: where a read's pieces lie, which strand it is, and where its insert begins and ends."""

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructField, StructType

from strandloom.plans.layout import DemuxPlan

ENTRY = "array<struct<id: string, ed: int, start: int, stop: int>>"
CATEGORIES = ("forward", "reverse", "rescuable_concatenates", "undecided")
#: The place that an insert has before its bounds are found.
PLACEHOLDER = (0, 0, 100)


def _entry(name: Column | str, ed: Column | int, start: Column | int, stop: Column | int) -> Column:
    c = lambda x, t: (F.lit(x) if not isinstance(x, Column) else x).cast(t)
    return F.struct(c(name, "string").alias("id"), c(ed, "int").alias("ed"), c(start, "int").alias("start"), c(stop, "int").alias("stop"))


def parse(text: Column | str) -> Column:
    """id:ed:start:stop parts, joined by |, with or without <category>, as an array of structs."""
    t = F.regexp_replace(F.col(text) if isinstance(text, str) else text, "<[^>]*>$", "")
    parts = F.transform(F.filter(F.split(t, r"\|"), lambda p: p != ""), lambda p: F.split(p, ":"))
    return F.transform(parts, lambda p: _entry(p[0], p[1], p[2], p[3]))


def category_of(text: Column | str) -> Column:
    """The text from the last < on, without the brackets."""
    return F.nullif(F.regexp_extract(F.col(text) if isinstance(text, str) else text, "<([^<]*)>$", 1), F.lit(""))


def render(signature: Column | str, category: Column | str | None = None) -> Column:
    s = F.col(signature) if isinstance(signature, str) else signature
    out = F.array_join(F.transform(s, lambda x: F.concat_ws(":", x["id"], x["ed"], x["start"], x["stop"])), "|")
    if category is None:
        return out
    return F.concat(out, F.lit("<"), F.col(category) if isinstance(category, str) else category, F.lit(">"))


def _get(signature: Column, name: str) -> Column:
    """The last entry of a name, or null."""
    return F.try_element_at(F.filter(signature, lambda x: x["id"] == name), F.lit(-1))


@dataclass(frozen=True)
class _Table:
    """What annotating needs of a plan and the bounds, as plain values that go to the executors."""

    orders: dict[str, int]
    directions: dict[str, str]
    lengths: dict[str, int]
    flanks: frozenset[str]
    bounds: dict[str, float]

    @classmethod
    def of(cls, plan: DemuxPlan, bounds: dict[str, float]) -> "_Table":
        pieces = plan.layout
        return cls({p.id: p.order for p in pieces}, {p.id: p.direction for p in pieces}, {p.id: p.expected_length or 0 for p in pieces}, frozenset(p.id for p in pieces if p.type == "flanking_adapter"), dict(bounds))


#: An entry in Python: id, distance, start, stop.
Entry = tuple[str, int, int, int]


def _text(e: Entry) -> str:
    return f"{e[0]}:{e[1]}:{e[2]}:{e[3]}"


def _tags(e: Entry, t: _Table) -> list[Entry]:
    """Barcode and tag beside a flanking adapter within its bound, by the layout's lengths."""
    name, ed, start, stop = e
    if name not in t.flanks or ed > t.bounds.get(name, ed):
        return []
    forward = t.directions[name] == "forward"
    barcode, tag = ("barcode", "umi") if forward else ("rc_barcode", "rc_umi")
    if barcode not in t.orders:
        return []
    n, m = t.lengths[barcode], t.lengths.get(tag, 0)
    out = [(barcode, 0, stop + 1, stop + n) if forward else (barcode, 0, start - n, start - 1)]
    if tag in t.orders:
        out.append((tag, 0, stop + n + 1, stop + n + m) if forward else (tag, 0, start - n - m, start - n - 1))
    return out


def _ordered(entries: list[Entry], t: _Table) -> list[Entry]:
    return sorted((e for e in entries if e[0] in t.orders), key=lambda e: (t.orders[e[0]], _text(e)))


def _completed(entries: list[Entry], t: _Table) -> list[Entry]:
    """Entries of the layout in its order, with tags, and a placeholder of an insert after the piece before it."""
    last = {e[0]: e for e in entries}
    out, before = [], {t.orders[name] - 1: name for name in ("read", "rc_read") if name in t.orders}
    for e in _ordered([x for e in last.values() for x in (*_tags(e, t), e)], t):
        out.append(e)
        if (name := before.get(t.orders[e[0]])) is not None:
            out.append((name, *PLACEHOLDER))
    return out


def _strand(found: dict[str, Entry], t: _Table) -> str:
    """The category of a completed signature. A test on a piece or bound that is missing fails."""
    f, rf, r, rr = (found[n][1] if n in found else None for n in ("forw_primer", "rc_forw_primer", "rev_primer", "rc_rev_primer"))
    within = lambda ed, name: ed is not None and name in t.bounds and ed <= t.bounds[name]
    beyond = lambda ed, name: ed is None or name in t.bounds and ed >= t.bounds[name]
    less = lambda a, b: a is not None and b is not None and a < b
    near, back = within(f, "forw_primer"), within(rf, "rc_forw_primer")
    if beyond(rf, "rc_forw_primer") and near and (rf is None or f < rf) or near and back and (r is None or within(r, "rev_primer")) and less(f, r):
        return "forward"
    if beyond(f, "forw_primer") and back and (f is None or rf < f) or near and back and (rr is None or within(rr, "rc_rev_primer")) and less(rf, rr):
        return "reverse"
    return "rescuable_concatenates" if near and back and "read" in found and "rc_read" in found else "undecided"


def _insert(found: dict[str, Entry], t: _Table, forward: bool) -> Entry | None:
    """The insert between its nearest neighbours, by order, on its strand; None without one before it."""
    direction, name = ("forward", "read") if forward else ("reverse", "rc_read")
    middle = t.orders.get(name)
    if middle is None:
        return None
    near = [e for e in found.values() if e[0] != name and t.directions.get(e[0]) == direction and (e[0] in ("poly_a", "poly_t", "barcode", "umi") or e[0] in t.bounds and e[1] <= t.bounds[e[0]])]
    distance = lambda e: abs(t.orders[e[0]] - middle)
    left = min((e for e in near if t.orders[e[0]] < middle), key=distance, default=None)
    right = min((e for e in near if t.orders[e[0]] > middle), key=distance, default=None)
    if left is None:
        return None
    closed = right is not None and distance(right) <= distance(left)
    if forward:
        return name, 0, left[3] + 1, right[2] - 1 if closed else 0
    return name, 0, right[3] + 1 if closed else 1, left[2] - 1


def _concatenates(found: dict[str, Entry]) -> list[Entry] | None:
    """Entries of a read of two strands by start, at distance 0, both inserts between their neighbours; None if one has none.

    The first insert begins after its placeholder's stop. It ends before the first other entry that starts later than
    that; so entries, the two inserts and their neighbours come in the order that the placeholder gives them.
    """
    others = sorted((e for e in found.values() if e[0] not in ("read", "rc_read")), key=lambda e: e[2])
    start, stop = found["read"][3] + 1, found["rc_read"][2] - 1
    for e in others:
        if e[2] > start:
            stop = e[2] - 1
            break
        if e[3] < stop:
            start = e[3] + 1
    placed = sorted([*others, ("read", 0, start, stop), ("rc_read", 0, stop + 1, found["rc_read"][3])], key=lambda e: e[2])
    out = []
    for k, e in enumerate(placed):
        if e[0] in ("read", "rc_read"):
            if k in (0, len(placed) - 1):
                return None
            e = (e[0], 0, placed[k - 1][3] + 1, placed[k + 1][2] - 1)
        out.append((e[0], 0, e[2], e[3]))
    return out


def annotated(entries: list[Entry], t: _Table) -> tuple[list[Entry], str]:
    """The completed signature and category of one read."""
    done = _completed(entries, t)
    found = {e[0]: e for e in done}
    category = _strand(found, t)
    if category in ("forward", "reverse"):
        insert = _insert(found, t, category == "forward")
        return (_ordered([*(e for e in done if e[0] != insert[0]), insert], t), category) if insert else (done, "undecided")
    if category == "rescuable_concatenates":
        both = _concatenates(found)
        return (both, category) if both else (done, "undecided")
    return done, category


#: Stands for no place, when places are put in order.
_LATE = np.iinfo(np.int64).max


class _Batch:
    """The rules of annotated() for many reads at once: a column for each piece of the layout, in its order.

    Signatures that have a barcode, tag or insert already, or more than one piece of an order, are left to annotated(), and so
    are concatenates with a piece that ends before the read.
    """

    def __init__(self, t: _Table):
        self.t, self.names = t, sorted(t.orders, key=t.orders.get)
        self.at = {n: k for k, n in enumerate(self.names)}
        self.order = np.array([t.orders[n] for n in self.names], np.int64)
        self.placed = {n for n in ("barcode", "umi", "rc_barcode", "rc_umi", "read", "rc_read") if n in t.orders}
        self.plain = len(set(t.orders.values())) == len(t.orders) and {"forw_primer", "rc_forw_primer", "rev_primer", "rc_rev_primer", "read", "rc_read"} <= set(t.orders)

    def columns(self, row: np.ndarray, name: np.ndarray, values: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Whether each read has each piece, and its distance, start and stop: the last of a name counts. Tags and placeholders are there."""
        has, table = np.zeros((n, len(self.names)), bool), np.zeros((3, n, len(self.names)), np.int64)
        known = name >= 0
        # of repeated places numpy keeps the last
        has[row[known], name[known]] = True
        table[:, row[known], name[known]] = values[:, known]
        self.tag(has, table)
        return has, table

    def tag(self, has: np.ndarray, table: np.ndarray) -> None:
        """Places tags and placeholders beside the pieces that are there."""
        t = self.t
        for flank in t.flanks & set(self.names):
            k, forward = self.at[flank], t.directions[flank] == "forward"
            barcode, tag = ("barcode", "umi") if forward else ("rc_barcode", "rc_umi")
            if barcode not in self.at:
                continue
            near = has[:, k] & (table[0, :, k] <= t.bounds.get(flank, _LATE))
            size, more = t.lengths[barcode], t.lengths.get(tag, 0)
            start, stop = table[1, :, k], table[2, :, k]
            places = [(barcode, stop + 1, stop + size) if forward else (barcode, start - size, start - 1)]
            if tag in self.at:
                places.append((tag, stop + size + 1, stop + size + more) if forward else (tag, start - size - more, start - size - 1))
            for piece, a, b in places:
                p = self.at[piece]
                has[:, p] |= near
                table[1, near, p], table[2, near, p] = a[near], b[near]
        for insert in ("read", "rc_read"):
            before = [k for k, o in enumerate(self.order) if o == t.orders[insert] - 1]
            for k in before:
                p = self.at[insert]
                has[:, p] |= has[:, k]
                for c, value in enumerate(PLACEHOLDER):
                    table[c, has[:, k], p] = value

    def strands(self, has: np.ndarray, table: np.ndarray) -> np.ndarray:
        """Of each read the place of its category in CATEGORIES."""
        k = {n: self.at[n] for n in ("forw_primer", "rc_forw_primer", "rev_primer", "rc_rev_primer")}
        there, ed = {n: has[:, c] for n, c in k.items()}, {n: table[0, :, c] for n, c in k.items()}
        none = np.zeros(len(has), bool)
        within = {n: there[n] & (ed[n] <= self.t.bounds[n]) if n in self.t.bounds else none for n in k}
        beyond = {n: ~there[n] | (ed[n] >= self.t.bounds[n] if n in self.t.bounds else none) for n in k}
        less = lambda a, b: there[a] & there[b] & (ed[a] < ed[b])
        f, rf, r, rr = k
        both = within[f] & within[rf]
        forward = beyond[rf] & within[f] & (~there[rf] | (ed[f] < ed[rf])) | both & (~there[r] | within[r]) & less(f, r)
        reverse = beyond[f] & within[rf] & (~there[f] | (ed[rf] < ed[f])) | both & (~there[rr] | within[rr]) & less(rf, rr)
        twice = both & has[:, self.at["read"]] & has[:, self.at["rc_read"]]
        return np.select([forward, reverse, twice], [0, 1, 2], 3)

    def insert(self, some: np.ndarray, has: np.ndarray, table: np.ndarray, forward: bool) -> np.ndarray:
        """Places the inserts of some reads between their nearest neighbours; which of the reads have one before it."""
        direction, name = ("forward", "read") if forward else ("reverse", "rc_read")
        middle, n = self.t.orders[name], len(some)
        left, right = np.full(n, -1), np.full(n, -1)
        for k in sorted(range(len(self.names)), key=lambda k: -abs(self.order[k] - middle)):
            piece = self.names[k]
            if piece == name or self.t.directions.get(piece) != direction:
                continue
            near = has[some, k] & (piece in ("poly_a", "poly_t", "barcode", "umi") or (table[0, some, k] <= self.t.bounds[piece] if piece in self.t.bounds else False))
            # the nearest come last
            (left if self.order[k] < middle else right)[near] = k
        good = left >= 0
        far = lambda k: np.where(k >= 0, abs(self.order[np.maximum(k, 0)] - middle), _LATE)
        closed = far(right) <= far(left)
        rows, at = some[good], self.at[name]
        a, b = left[good], np.maximum(right[good], 0)
        if forward:
            start, stop = table[2, rows, a] + 1, np.where(closed[good], table[1, rows, b] - 1, 0)
        else:
            start, stop = np.where(closed[good], table[2, rows, b] + 1, 1), table[1, rows, a] - 1
        has[rows, at] = True
        table[0, rows, at], table[1, rows, at], table[2, rows, at] = 0, start, stop
        return good

    def concatenates(self, some: np.ndarray, has: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places both inserts of some reads: which have both within others, and the order of their pieces by start."""
        reads = [self.at["read"], self.at["rc_read"]]
        own = has[some].copy()
        own[:, reads] = False
        starts, stops = np.where(own, table[1, some], _LATE), table[2, some]
        first = PLACEHOLDER[2] + 1
        after = np.where(starts > first, starts, _LATE).min(axis=1)
        later = np.where(starts > after[:, None], starts, _LATE).min(axis=1)
        # the last of those up to a start, the layout's last of equal ones
        columns = np.arange(own.shape[1])

        def last(fits: np.ndarray) -> np.ndarray:
            top = np.where(fits, starts, -_LATE).max(axis=1)
            return np.where(fits & (starts == top[:, None]), columns, -1).max(axis=1)

        before, at = last(own & (starts <= first)), last(own & (starts == after[:, None]))
        good = (after < _LATE) & (later < _LATE) & (before >= 0)
        rows, lane = some[good], np.flatnonzero(good)
        places = ((reads[0], stops[lane, before[good]] + 1, after[good] - 1), (reads[1], stops[lane, at[good]] + 1, later[good] - 1))
        keys = starts.astype(np.float64)
        keys[~own] = np.inf
        for (p, a, b), key in zip(places, (np.full(len(lane), first), after[good]), strict=True):
            table[1, rows, p], table[2, rows, p] = a, b
            keys[lane, p] = key + 0.5  # after the others that start there
        table[:1, rows] = 0
        return good, np.argsort(keys, axis=1, kind="stable")

    def run(self, row: np.ndarray, name: np.ndarray, values: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of reads: sizes of their signatures, names, distances with starts and stops, categories, and which are left over."""
        odd = np.zeros(n, bool)
        placed = [self.at[p] for p in self.placed]
        odd[row[np.isin(name, placed)]] = True
        has, table = self.columns(row, name, values, n)
        return *self.told(has, table, odd), odd

    def told(self, has: np.ndarray, table: np.ndarray, odd: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of reads with their tags: sizes of their signatures, names, distances with starts and stops, categories. More reads may be left over."""
        n, kind = len(odd), self.strands(has, table)
        shown = np.tile(np.arange(len(self.names)), (n, 1))
        for category, forward in ((0, True), (1, False)):
            some = np.flatnonzero((kind == category) & ~odd)
            kind[some[~self.insert(some, has, table, forward)]] = 3
        some = np.flatnonzero((kind == 2) & ~odd)
        short = (np.where(has[some], table[2, some], 0) < -1).any(axis=1)
        odd[some[short]] = True
        some = some[~short]
        good, order = self.concatenates(some, has, table)
        kind[some[~good]] = 3
        shown[some[good]] = order[good]
        seen = np.take_along_axis(has, shown, axis=1)
        lanes = np.nonzero(seen)[0]
        pieces = shown[seen]
        return seen.sum(axis=1), pieces, table[:, lanes, pieces], kind


def annotate(reads: DataFrame, plan: DemuxPlan, bounds: dict[str, float], signature: str = "signature") -> DataFrame:
    """reads with signature completed and category: one of CATEGORIES.

    Barcodes and tags are placed beside flanking adapters, entries ordered, the strand told, the insert's bounds found.
    Forward and reverse reads whose insert has no piece before it, and concatenates whose inserts lie at an end, are
    undecided. Entries come in the layout's order, those of concatenates by start.

    The rules hang on each other so much that as one expression they would grow with every step; here they are masks over
    the reads of an Arrow batch. Few reads are left to one at a time, see _Batch.
    """
    t, at = _Table.of(plan, bounds), reads.columns.index(signature)
    shape = StructType([*reads.schema.fields, StructField("category", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        into = to_arrow_schema(shape)
        kind, rules = into.field(at).type, _Batch(t)
        names = pa.array(rules.names)
        for b in batches:
            lists = b.column(at)
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            filled, categories = _annotated_batch(rules, names, lists.flatten(), sizes, kind)
            yield pa.RecordBatch.from_arrays([(filled if k == at else c).cast(f.type) for k, (c, f) in enumerate(zip([*b.columns, categories], into, strict=True))], schema=into)

    return reads.mapInArrow(run, shape)


def _annotated_batch(rules: _Batch, names: pa.Array, flat: pa.StructArray, sizes: np.ndarray, kind: pa.DataType) -> tuple[pa.ListArray, pa.Array]:
    """Completed signatures and categories of signatures one after another."""
    n, row = len(sizes), np.repeat(np.arange(len(sizes)), sizes)
    values = np.stack([pc.fill_null(flat.field(k), 0).to_numpy(zero_copy_only=False).astype(np.int64) for k in (1, 2, 3)]) if len(flat) else np.zeros((3, 0), np.int64)
    name = pc.fill_null(pc.index_in(flat.field(0), names), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    if rules.plain:
        count, piece, numbers, category, odd = rules.run(row, name, values, n)
    else:
        count, piece, numbers, category, odd = np.zeros(n, np.int64), np.zeros(0, np.int64), np.zeros((3, 0), np.int64), np.full(n, 3), np.ones(n, bool)
    if odd.any():
        ends = np.cumsum(sizes)
        part = lambda k: slice(ends[k] - sizes[k], ends[k])
        piece, numbers = singly(rules, odd, count, piece, numbers, category, lambda k: list(zip(flat.field(0)[part(k)].to_pylist(), *values[:, part(k)].tolist(), strict=True)))
    text = names.take(pa.array(piece))
    columns = [c.cast(f.type) for c, f in zip([text, *(pa.array(x) for x in numbers)], kind.value_type, strict=True)]
    offsets = pa.array(np.concatenate(([0], np.cumsum(count))).astype(np.int32))
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(columns, fields=list(kind.value_type))), pa.array(CATEGORIES).take(pa.array(category))


def singly(rules: _Batch, odd: np.ndarray, count: np.ndarray, piece: np.ndarray, numbers: np.ndarray, category: np.ndarray, entries_of: Callable[[int], list[Entry]]) -> tuple[np.ndarray, np.ndarray]:
    """Pieces and numbers with those of the reads left over, one at a time, in place of what the rules for many gave."""
    lane = np.repeat(np.arange(len(odd)), count)
    keep = ~odd[lane]
    more = []
    for k in np.flatnonzero(odd):
        entries, found = annotated(entries_of(k), rules.t)
        category[k], count[k] = CATEGORIES.index(found), len(entries)
        more += [(k, rules.at[e[0]], *e[1:]) for e in entries]
    added = np.array(more, np.int64).reshape(-1, 5).T
    lane = np.concatenate([lane[keep], added[0]])
    order = np.argsort(lane, kind="stable")
    return np.concatenate([piece[keep], added[1]])[order], np.concatenate([numbers[:, keep], added[2:]], axis=1)[:, order]
