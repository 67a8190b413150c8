"""Codes near a known set of codes, found inside tasks: the set is one sorted array that they all have."""

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, cached_property
from itertools import combinations, product
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

#: Codes that a set to send to tasks has at most: 64 MB, and a table as large. Larger sets are joined.
MOST_KNOWN = 1 << 23
#: Numbers held at once, by a task that tries changes or compares.
HELD = 1 << 21
#: Codes whose answers a task holds at once.
CODES = 1024
#: Numbers of so many bits are keys of a table with a place for each, at most.
WIDEST = 20
_ODD = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Known:
    """Distinct codes in order, and whether some code has a hash: eight places a code or more."""

    codes: np.ndarray
    table: np.ndarray

    @property
    def shift(self) -> np.uint64:
        return np.uint64(64 - (len(self.table).bit_length() - 1))

    def has(self, codes: np.ndarray) -> np.ndarray:
        """Places of the codes that are known. Few others pass the table, and those are looked up exactly."""
        maybe = np.flatnonzero(self.table[codes.view(np.uint64) * _ODD >> self.shift])
        some = codes[maybe]
        at = np.minimum(np.searchsorted(self.codes, some), max(0, len(self.codes) - 1))
        return maybe[self.codes[at] == some] if len(self.codes) else maybe[:0]

    @cached_property
    def halves(self) -> dict[int, tuple["_Half", "_Half"]]:
        """By the width of a half: the codes by their high half and by their low one, made when a task first asks."""
        return {}

    def by_halves(self, width: int) -> tuple["_Half", "_Half"]:
        if width not in self.halves:
            high, low = self.codes >> width, self.codes & ((1 << width) - 1)
            order = np.argsort(low, kind="stable")
            self.halves[width] = _half_of(high, low, width), _half_of(low[order], high[order], width)
        return self.halves[width]


@dataclass(frozen=True)
class _Half:
    """Codes in order of one half: where each value of it begins, and the codes' other halves."""

    starts: np.ndarray
    others: np.ndarray

    def places(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of all codes with some values of the half, and how many each value has."""
        begin = self.starts[values]
        n = self.starts[values + 1] - begin
        ends = np.cumsum(n)
        return np.repeat(begin - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0), n


def _half_of(values: np.ndarray, others: np.ndarray, width: int) -> _Half:
    starts = np.concatenate(([0], np.cumsum(np.bincount(values, minlength=1 << width))))
    return _Half(starts, others.astype(np.uint16 if width <= 16 else np.uint32))


def known_of(codes: np.ndarray) -> Known:
    codes = np.unique(codes)
    table = np.zeros(max(1 << 16, 1 << (8 * len(codes)).bit_length()), bool)
    out = Known(codes, table)
    table[codes.view(np.uint64) * _ODD >> out.shift] = True
    return out


def changes(bits: int, bases: int, length: int) -> int:
    """How many ways there are to change so many bits and bases at most, at least one."""
    return sum(comb(length, b) * comb(b, two) * 2 ** (b - two) for b in range(1, min(bases, length) + 1) for two in range(b + 1) if b + two <= bits)


@cache
def _masks(bits: int, bases: int, length: int) -> np.ndarray:
    """Changes of exactly so many bases, with so many bits at most: of a base one bit or the other, or both."""
    ways = np.array([w for w in product((1, 2, 3), repeat=bases) if sum(x.bit_count() for x in w) <= bits], np.int64).reshape(-1, bases)
    places = np.array(list(combinations(range(length), bases)), np.int64).reshape(-1, bases)
    return (ways[None, :, :] << 2 * places[:, None, :]).sum(axis=2).ravel()


def near(codes: np.ndarray, known: Known, bits: int, bases: int, length: int, nearest: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in codes, known codes one to bits bits and at most bases bases from those, and the bases.

    nearest: only those at the least distance in bases. Changes are tried in order of bases, unless the known codes are
    fewer than all changes: then each is compared. Where all within reach are asked for, halves of codes leave one known
    code in 79 to be compared at 6 bits of 32.
    """
    low, parts = sum(1 << 2 * k for k in range(length)), []
    left = np.arange(len(codes))
    if not nearest and length <= WIDEST and _within(codes, length) and _within(known.codes, length):
        i, target = _near_by_halves(codes, known, bits, length)
        x = codes[i] ^ target
        far = np.bitwise_count((x | x >> 1) & low).astype(np.int64)
        fits = (x != 0) & (far <= bases)
        return i[fits], target[fits], far[fits]
    if len(known.codes) <= changes(bits, bases, length):
        step = max(1, HELD // max(1, len(known.codes)))
        for at in range(0, len(codes), step):
            x = codes[at : at + step, None] ^ known.codes[None, :]
            n = np.bitwise_count(x).astype(np.int64)
            far = np.bitwise_count((x | x >> 1) & low).astype(np.int64)
            fits = (n >= 1) & (n <= bits) & (far <= bases)
            if nearest:
                fits &= far == np.where(fits, far, length + 1).min(axis=1, initial=length + 1)[:, None]
            i, j = np.nonzero(fits)
            parts.append((i + at, known.codes[j], far[i, j]))
    else:
        for b in range(1, min(bases, length) + 1):
            masks, found = _masks(bits, b, length), []
            if not len(masks) or not len(left):
                break
            step = max(1, HELD // len(masks))
            for at in range(0, len(left), step):
                own = left[at : at + step]
                for m in range(0, len(masks), HELD):
                    some = masks[m : m + HELD]
                    tried = (codes[own, None] ^ some[None, :]).ravel()
                    hit = known.has(tried)
                    found.append(own[hit // len(some)])
                    parts.append((found[-1], tried[hit], np.full(len(hit), b)))
            if nearest and found:
                left = np.setdiff1d(left, np.concatenate(found))
    if not parts:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(p) for p in zip(*parts, strict=True))


def _within(codes: np.ndarray, length: int) -> bool:
    return not len(codes) or int(codes.min()) >= 0 and int(codes.max()) >> 2 * length == 0


@cache
def _flips(width: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of so many bits with at most so many set, and how many each has set."""
    masks = np.array([sum(1 << k for k in at) for n in range(min(most, width) + 1) for at in combinations(range(width), n)], np.int64)
    return masks, np.bitwise_count(masks).astype(np.uint8)


def _near_by_halves(codes: np.ndarray, known: Known, bits: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in codes, and the known codes at most bits bits from those, the same code too.

    Of two such codes the high halves differ in half of the bits at most, or else the low halves in less than what is left.
    Codes that share a high half meet what is near it together; then each meets what is near its low half and far from its
    high one. So each pair comes once.
    """
    width, few = length, bits // 2
    one, two = known.by_halves(width)
    high, low = codes >> width, codes & ((1 << width) - 1)
    kind = one.others.dtype
    masks, count = _flips(width, few)
    less, less_count = _flips(width, bits - few - 1) if bits > few else (np.zeros(0, np.int64), np.zeros(0, np.uint8))
    order = np.argsort(high, kind="stable")
    first = np.flatnonzero(np.diff(high[order], prepend=-1))
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for at, stop in zip(first, np.append(first[1:], len(order)), strict=True):
        group, own = order[at:stop], int(high[order[at]])
        place, n = one.places(own ^ masks)
        others, room = one.others[place], np.repeat((bits - count).astype(np.uint8), n)
        step = max(1, HELD // max(1, len(place)))
        for k in range(0, len(group), step):
            some = group[k : k + step]
            hit = np.flatnonzero(np.bitwise_count(low[some].astype(kind)[:, None] ^ others[None, :]) <= room[None, :])
            row, column = np.divmod(hit, max(1, len(place)))
            found.append((some[row], known.codes[place[column]]))
        if not len(less):
            continue
        step = max(1, HELD // max(1, len(less) * (len(known.codes) >> width)))
        for k in range(0, len(group), step):
            some = group[k : k + step]
            values = (low[some][:, None] ^ less[None, :]).ravel()
            place, n = two.places(values)
            others = two.others[place]
            apart = np.bitwise_count(others ^ kind.type(own))
            hit = np.flatnonzero((apart > few) & (apart <= bits))
            # of these few the changes of the low half are counted too
            which = np.searchsorted(np.cumsum(n), hit, side="right")
            fits = apart[hit] + less_count[which % len(less)] <= bits
            hit, which = hit[fits], which[fits]
            found.append((some[which // len(less)], others[hit].astype(np.int64) << width | values[which]))
    return tuple(np.concatenate(p) for p in zip(*found, strict=True))


def _matches(codes: np.ndarray, known: Known, bits: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """How many known codes are at most bits bits from each code, itself included, and those, in order."""
    i, target, _ = near(codes, known, bits, length, length, nearest=False)
    own = known.has(codes)
    i, target = np.concatenate([i, own]), np.concatenate([target, codes[own]])
    order = np.lexsort((target, i))
    return np.bincount(i, minlength=len(codes)), target[order]


def collected(known: DataFrame) -> Known | None:
    """The codes (target), which are distinct, or None if they are too many to send."""
    if known.limit(MOST_KNOWN + 1).count() > MOST_KNOWN:
        return None
    return known_of(known.select("target").toArrow().column(0).to_numpy().astype(np.int64))


def _dealt(codes: DataFrame, length: int) -> DataFrame:
    """Codes as bigint, dealt out by their high half and in order, so that codes that share one are together."""
    spark = codes.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return codes.select(F.col("code").cast("bigint")).repartition(tasks, F.shiftright("code", length)).sortWithinPartitions("code")


def neighbours(codes: DataFrame, known: Known, bits: int, bases: int, length: int, nearest: bool) -> DataFrame:
    """(code, target, bases) of distinct codes, as near() has them. Codes are dealt out; known ones go to all tasks once."""
    shared = codes.sparkSession.sparkContext.broadcast(known)
    shape = _parse_datatype_string("code bigint, target bigint, bases int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        into = to_arrow_schema(shape)
        for b in batches:
            whole = b.column(0).to_numpy()
            for at in range(0, len(whole), CODES):
                own = whole[at : at + CODES]
                i, target, far = near(own, shared.value, bits, bases, length, nearest)
                yield pa.RecordBatch.from_arrays([pa.array(own[i]), pa.array(target), pa.array(far.astype(np.int32))], schema=into)

    return _dealt(codes, length).mapInArrow(run, shape)


def matches(codes: DataFrame, known: Known, bits: int, length: int) -> DataFrame:
    """(code, matches) of distinct codes: the known codes at most bits bits away, itself included, in order. A code's list is made in its task."""
    shared = codes.sparkSession.sparkContext.broadcast(known)
    shape = _parse_datatype_string("code bigint, matches array<bigint>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        into = to_arrow_schema(shape)
        for b in batches:
            whole = b.column(0).to_numpy()
            for at in range(0, len(whole), CODES):
                own = whole[at : at + CODES]
                n, found = _matches(own, shared.value, bits, length)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32)), pa.array(found))
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip([pa.array(own), lists], into, strict=True)], schema=into)

    return _dealt(codes, length).mapInArrow(run, shape)
