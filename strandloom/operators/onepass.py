"""Reads aligned, annotated and cut in one pass over an Arrow batch, for runs that keep text and not signatures."""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from strandloom.functions.alignment import Texts, best_places, tails_of
from strandloom.functions.sequence import UNDECIDED
from strandloom.operators import calibrate, lookup, molecules
from strandloom.operators.align import _spaced
from strandloom.operators.extract import FIRST, FORWARD, LEAST_INSERT, REVERSE, SECOND
from strandloom.operators.signature import CATEGORIES, Entry, _Batch, _Table, singly
from strandloom.plans.layout import DemuxPlan

#: Reads and bytes that are worked on at once; smaller batches come together.
READS, BYTES = 1 << 15, 1 << 24
#: Bases of a barcode that make a code, at most.
LONGEST = 31
#: What cut() gives: each read's line and category, and what was cut, a row of its own for a second insert (more).
CUT = StructType([StructField(n, {"more": BooleanType(), "code": LongType()}.get(n, StringType())) for n in ("id", "line", "category", "more", "barcode", "code", "umi", "filtered_read", "filtered_qc")])

_COMPLEMENT = np.arange(256, dtype=np.uint8)
_COMPLEMENT[np.frombuffer(b"ACGTacgt", np.uint8)] = np.frombuffer(b"TGCAtgca", np.uint8)
_DIGIT = np.zeros(256, np.int64)
_DIGIT[np.frombuffer(b"CTG", np.uint8)] = 1, 2, 3
_TURN = str.maketrans("ACGTacgt", "TGCAtgca")


@dataclass(frozen=True)
class Annotated:
    """Of reads: sizes of their signatures, names as places in the layout, distances, starts and stops, and categories."""

    count: np.ndarray
    piece: np.ndarray
    numbers: np.ndarray
    category: np.ndarray


@dataclass(frozen=True)
class Cutter:
    """What the tasks need of a plan and its thresholds, as plain values; the rules are those of align, signature and extract."""

    adapters: tuple[tuple[str, str], ...]
    poly: tuple[tuple[str, str], ...]
    threshold: dict[str, float]
    table: _Table
    exact_pairing: bool
    exact_coords: bool

    @classmethod
    def of(cls, plan: DemuxPlan, null: dict[str, tuple[float, float | None]]) -> "Cutter | None":
        """None for layouts that the rules for many reads don't cover: those need the operators one after another."""
        table = _Table.of(plan, calibrate.bounds_of(null))
        names = [p.id for p in plan.layout]
        if not _Batch(table).plain or len(set(names)) < len(names) or plan.barcode_length > LONGEST:
            return None
        align, poly = _spaced(plan.adapters)
        threshold = {k: mean - sd for k, (mean, sd) in null.items() if sd is not None and sd == sd}
        return cls(tuple(align), tuple(poly), threshold, table, plan.exact_pairing, plan.exact_coords)

    def annotated(self, texts: Texts) -> Annotated:
        """align_signatures() and annotate(). The last of an adapter's places counts there, so that alone is kept."""
        rules, n = _Batch(self.table), len(texts.lengths)
        has, table = np.zeros((n, len(rules.names)), bool), np.zeros((3, n, len(rules.names)), np.int64)
        under = [self.threshold.get(name, np.inf) for name, _ in self.adapters]
        hits = best_places([query.encode() for _, query in self.adapters], texts, self.exact_pairing, under)
        for k, (name, _) in enumerate(self.adapters):
            distance, at = hits[:, k, 0], rules.at[name]
            second = (hits[:, k, 3] >= 0) & (distance < under[k])
            has[:, at], table[0, :, at] = True, distance
            for part in (1, 2):
                table[part, :, at] = np.where(second, hits[:, k, part + 2], hits[:, k, part])
        for name, base in self.poly:
            place, at = tails_of(base, texts), rules.at[name]
            has[:, at] = there = place[:, 0] > 0
            table[1:, there, at] = place[there].T
        found, places, odd = has.copy(), table.copy(), np.zeros(n, bool)
        rules.tag(has, table)
        count, piece, numbers, category = rules.told(has, table, odd)
        if odd.any():
            entries = lambda k: [(rules.names[p], *map(int, places[:, k, p])) for p in np.flatnonzero(found[k])]
            piece, numbers = singly(rules, odd, count, piece, numbers, category, entries)
        return Annotated(count, piece, numbers, category)

    def lines(self, a: Annotated) -> pa.Array:
        """render() of signatures with their categories."""
        names = pa.array(_Batch(self.table).names)
        entries = pc.binary_join_element_wise(names.take(pa.array(a.piece)), *(pa.array(x).cast(pa.string()) for x in a.numbers), ":")
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(a.count))).astype(np.int32)), entries)
        return pc.binary_join_element_wise(pc.binary_join(lists, "|"), pa.array([f"<{c}>" for c in CATEGORIES]).take(pa.array(a.category)), "")

    def rows(self, a: Annotated, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, dict[str, tuple[np.ndarray, ...]]]:
        """extract(): the reads of the rows, their kinds, and where barcode, tag and insert lie: whether they do, start from 0, size.

        Second inserts come last. lengths are reads' sizes in letters.
        """
        rules, n = _Batch(self.table), len(lengths)
        lane = np.repeat(np.arange(n), a.count)
        has, place = np.zeros((n, len(rules.names)), bool), np.zeros((2, n, len(rules.names)), np.int64)
        has[lane, a.piece] = True
        place[:, lane, a.piece] = a.numbers[1:]

        def part(names: tuple[str, str], row: np.ndarray, ahead: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            there, start, stop = (np.where(ahead, x[row, rules.at[names[0]]], x[row, rules.at[names[1]]]) if all(m in rules.at for m in names) else np.zeros(len(row), np.int64) for x in (has, *place))
            begin = np.where(start == 1, 1, start - 1)
            fits = there.astype(bool) & (stop <= lengths[row]) & (stop - begin >= 5) & (begin >= 0) & (begin < lengths[row])
            return fits, np.where(fits, begin, 0), np.where(fits, stop - begin, 0)

        every = np.arange(n)
        first, second = (part((name, name), every, np.full(n, True)) for name in ("read", "rc_read"))
        both = (a.category == 2) & first[0] & (first[2] >= LEAST_INSERT)
        ones = (a.category < 2) | both
        kind = np.select([a.category == 0, a.category == 1], [FORWARD, REVERSE], FIRST)
        twos = np.flatnonzero(both & second[0] & (second[2] >= LEAST_INSERT))
        row = np.concatenate([np.flatnonzero(ones), twos])
        kind = np.concatenate([kind[ones], np.full(len(twos), SECOND)])
        ahead, whole = (kind == FORWARD) | (kind == FIRST), kind < FIRST
        at = np.where(ahead, rules.at["read"], rules.at["rc_read"])
        start, stop = place[0, row, at], place[1, row, at]
        stop = np.where((kind == FORWARD) & (stop == 0), lengths[row], stop)
        good = ~whole | has[row, at] & (start <= stop)
        row, kind, ahead, whole, start, stop = (x[good] for x in (row, kind, ahead, whole, start, stop))
        places = {"barcode": part(("barcode", "rc_barcode"), row, ahead), "umi": part(("umi", "rc_umi"), row, ahead)}
        fits, begin, size = part(("read", "rc_read"), row, ahead)
        shift = 0 if self.exact_coords else 1
        own = np.maximum(start, 1)
        places["read"] = np.where(whole, True, fits), np.where(whole, own + shift - 1, begin), np.where(whole, np.maximum(stop - own + 1 - shift, 0), size)
        return row, kind, places

    def cut(self, b: pa.RecordBatch, least: int) -> pa.RecordBatch:
        """CUT of reads id, seq, qual. Reads under a length, and null ones, have neither a line nor a category."""
        seq = b.column(1)
        size = pc.fill_null(pc.utf8_length(seq), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        long = size >= least
        kept = np.flatnonzero(long)
        texts = Texts.of(seq)
        a = self.annotated(Texts(texts.flat, texts.begin[kept], texts.lengths[kept]))
        own, kind, places = self.rows(a, size[kept])
        row, back = kept[own], (kind == REVERSE) | (kind == SECOND)
        barcode, code = _barcodes(seq, row, places["barcode"], back)
        umi = _decided(pieces(seq, row, *places["umi"][1:], back), places["umi"][0])
        inserts = []
        for column in (seq, b.column(2)):
            fits, begin, length = places["read"]
            if column is not seq:
                fits, begin, length = _again(column, row, kind, places["read"])
            inserts.append(_decided(pieces(column, row, begin, length), fits))
        # a row for each read, then those of second inserts
        seconds = np.flatnonzero(kind == SECOND)
        to_kept, to_cut = np.full(len(size), -1), np.full(len(size), -1)
        to_kept[kept] = np.arange(len(kept))
        firsts = np.flatnonzero(kind != SECOND)
        to_cut[row[firsts]] = firsts
        to_kept, to_cut = np.concatenate([to_kept, np.full(len(seconds), -1)]), np.concatenate([to_cut, seconds])
        of_reads, of_cut = pa.array(to_kept, mask=to_kept < 0), pa.array(to_cut, mask=to_cut < 0)
        ids = b.column(0) if not len(seconds) else b.column(0).take(pa.array(np.concatenate([np.arange(len(size)), row[seconds]])))
        more = np.arange(len(to_cut)) >= len(size)
        columns = [ids, self.lines(a).take(of_reads), pa.array(CATEGORIES).take(pa.array(a.category)).take(of_reads), pa.array(more), *(x.take(of_cut) for x in (barcode, code, umi, *inserts))]
        into = to_arrow_schema(CUT)
        return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, into, strict=True)], schema=into)

    def cells(self, seq: pa.Array, texts: Texts, lengths: np.ndarray) -> tuple[pa.Array, pa.Array, pa.Array]:
        """Barcodes, their codes and tags of texts that lie in seq, whose sizes in letters are given: no inserts, no lines."""
        own, kind, places = self.rows(self.annotated(texts), lengths)
        back = (kind == REVERSE) | (kind == SECOND)
        barcode, code = _barcodes(seq, own, places["barcode"], back, texts)
        return barcode, code, _decided(pieces(seq, own, *places["umi"][1:], back, texts), places["umi"][0])


def _again(column: pa.Array, row: np.ndarray, kind: np.ndarray, place: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    """Places of inserts in qualities, which may be shorter than their sequences: parts of concatenates must lie in them."""
    fits, begin, length = place
    size = pc.fill_null(pc.utf8_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)[row]
    inside = fits & ((kind < FIRST) | (begin + length <= size))
    return inside, begin, np.where(inside, length, 0)


def _barcodes(seq: pa.Array, row: np.ndarray, place: tuple[np.ndarray, ...], back: np.ndarray, texts: Texts | None = None) -> tuple[pa.Array, pa.Array]:
    """Barcodes of rows and their codes, null for those that couldn't be cut."""
    fits, begin, size = place
    found = pieces(seq, row, begin, size, back, texts)
    own = Texts.of(found)
    code = np.zeros(len(row), np.int64)
    if len(own.flat) == size.sum():
        for n in np.unique(size[fits]):
            some = np.flatnonzero(fits & (size == n))
            digits = _DIGIT[own.flat[own.begin[some][:, None] + np.arange(n)]]
            code[some] = digits @ (1 << 2 * np.arange(n - 1, -1, -1))
    else:
        # letters of several bytes
        for k in np.flatnonzero(fits):
            for c in found[k].as_py():
                code[k] = code[k] << 2 | "ACTG".find(c) if c in "CTG" else code[k] << 2
    return _decided(found, fits), pa.array(code, mask=~fits)


def _decided(found: pa.Array, fits: np.ndarray) -> pa.Array:
    """Null stays null; what doesn't fit is undecided."""
    return found if fits.all() else pc.if_else(pa.array(fits), found, UNDECIDED)


def pieces(column: pa.Array, row: np.ndarray, begin: np.ndarray, size: np.ndarray, back: np.ndarray | None = None, texts: Texts | None = None) -> pa.Array:
    """Parts of rows of a column, or of texts in it, as far as they lie in them; those on the way back as reverse complements.

    Null rows of the column give null.
    """
    within = texts or Texts.of(column)
    null = None
    if texts is None and column.null_count:
        null = column.is_null().to_numpy(zero_copy_only=False)[row]
    if len(within.flat) and int(within.flat.max()) > 127:
        whole = [within.flat[within.begin[k] : within.begin[k] + within.lengths[k]].tobytes().decode() for k in row]
        out = [t[a : a + n] for t, a, n in zip(whole, begin.tolist(), size.tolist(), strict=True)]
        if back is not None:
            out = [t.translate(_TURN)[::-1] if r else t for t, r in zip(out, back.tolist(), strict=True)]
        return pa.array(out, pa.string(), mask=null)
    size = np.clip(size, 0, np.maximum(within.lengths[row] - begin, 0))
    start, ends = within.begin[row] + begin, np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    if back is None:
        flat = within.flat[np.repeat(start - (ends - size), size) + np.arange(total)]
    else:
        step = np.arange(total) - np.repeat(ends - size, size)
        turned = np.repeat(back, size)
        flat = within.flat[np.repeat(np.where(back, start + size - 1, start), size) + np.where(turned, -step, step)]
        flat = np.where(turned, _COMPLEMENT[flat], flat)
    offsets = np.concatenate(([0], ends)).astype(np.int32)
    mask = pa.array(~null).buffers()[1] if null is not None else None
    return pa.StringArray.from_buffers(len(row), pa.py_buffer(offsets), pa.py_buffer(flat), mask)


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of READS or BYTES, where those given are smaller."""
    held, rows, size = [], 0, 0
    for b in batches:
        held.append(b)
        rows, size = rows + b.num_rows, size + b.nbytes
        if rows >= READS or size >= BYTES:
            yield pa.concat_batches(held) if len(held) > 1 else held[0]
            held, rows, size = [], 0, 0
    if held:
        yield pa.concat_batches(held) if len(held) > 1 else held[0]


def cut(reads: DataFrame, cutter: Cutter, least: int) -> DataFrame:
    """CUT of reads id, seq, qual."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in gathered(batches):
            yield cutter.cut(b, least)

    return reads.select("id", "seq", "qual").mapInArrow(run, CUT)


def split_cells(reads: DataFrame, cutter: Cutter, plan: DemuxPlan, bounds: dict[str, float], least: int, known: lookup.Known | None = None) -> DataFrame:
    """(barcode, umi, code) of what is cut out of reads (seq) that are split into their molecules; with known codes, of those alone.

    As split(), the operators on signatures, and extract(), one after another, have them; parts aren't copied.
    """
    primers, asked = dict(plan.adapters), molecules.asked_of(bounds)
    shape = StructType([StructField("barcode", StringType()), StructField("umi", StringType()), StructField("code", LongType())])
    shared = None if known is None else reads.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        into = to_arrow_schema(shape)
        for b in gathered(batches):
            seq, texts = b.column(0), Texts.of(b.column(0))
            data = texts.flat.tobytes()
            row, _, stop, _, _ = molecules.placed([data[a : a + n] for a, n in zip(texts.begin.tolist(), texts.lengths.tolist(), strict=True)], primers, bounds, asked)
            sizes = texts.lengths
            if not data.isascii():
                # letters of several bytes: parts are of letters
                sizes = pc.fill_null(pc.utf8_length(seq), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            lane, begin, size = molecules.parts_of(row, stop, sizes)
            long = size >= least
            lane, begin, size = lane[long], begin[long], size[long]
            if data.isascii():
                texts = Texts(texts.flat, texts.begin[lane] + begin, size)
            else:
                seq = pieces(seq, lane, begin, size)
                texts, size = Texts.of(seq), pc.utf8_length(seq).to_numpy(zero_copy_only=False).astype(np.int64)
            barcode, code, umi = cutter.cells(seq, texts, size)
            found = pa.RecordBatch.from_arrays([barcode.cast(pa.string()), umi.cast(pa.string()), code], schema=into)
            if shared is not None:
                has = np.flatnonzero(code.is_valid().to_numpy(zero_copy_only=False))
                found = found.take(pa.array(has[shared.value.has(pc.fill_null(code, 0).to_numpy(zero_copy_only=False)[has])]))
            yield found

    return reads.select("seq").mapInArrow(run, shape)
