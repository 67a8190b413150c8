"""Reads of several molecules: where each lies, from all places of all primers."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from strandloom.functions.alignment import places_of
from strandloom.plans.layout import DemuxPlan

#: The primers that a molecule begins and ends with, on either strand.
ENDS = (("forward", "forw_primer", "rev_primer"), ("reverse", "rc_rev_primer", "rc_forw_primer"))


def schedule(row: np.ndarray, start: np.ndarray, stop: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """Which of the intervals of n rows make the heaviest set that doesn't overlap in its row; of equal sets one that ends early, of those with one end the short.

    All rows at once, an interval of each at a time, by stop: the best up to it, with it and what ends before it or without.
    """
    order = np.lexsort((-start, stop, row))
    place = np.arange(len(order)) - np.searchsorted(row[order], row[order])
    width = int(place.max(initial=-1)) + 1
    begin, end, heavy = (np.zeros((n, width), np.int64) for _ in range(3))
    end[:] = np.iinfo(np.int64).max
    at = row[order], place
    begin[at], end[at], heavy[at] = start[order], stop[order], weight[order]
    best, before = np.zeros((n, width + 1), np.int64), np.zeros((n, width), np.int64)
    for k in range(width):
        before[:, k] = (end < begin[:, k, None]).sum(axis=1)
        best[:, k + 1] = np.maximum(best[:, k], heavy[:, k] + np.take_along_axis(best, before[:, k, None], 1)[:, 0])
    taken, left = np.zeros((n, width), bool), np.full(n, width)
    for k in range(width - 1, -1, -1):
        here = (left == k + 1) & (best[:, k + 1] > best[:, k])
        taken[:, k] = here
        left = np.where(here, before[:, k], np.where(left == k + 1, k, left))
    out = np.zeros(len(order), bool)
    out[order] = taken[at]
    return out


def _intervals(first: tuple[np.ndarray, ...], last: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    """Rows, starts, stops and distances of what may be molecules: a first primer and the next last one, and the other way round."""
    lane, _, end, _ = first
    to_lane, to_start, _, _ = last
    size = 1 + max(int(end.max(initial=0)), int(to_start.max(initial=0)))
    after = np.searchsorted(to_lane * size + to_start, lane * size + end, side="right")
    fits = after < len(to_lane)
    fits[fits] = to_lane[after[fits]] == lane[fits]
    pairs = [(np.flatnonzero(fits), after[fits])]
    by_end = np.lexsort((end, lane))
    ahead = np.searchsorted((lane * size + end)[by_end], to_lane * size + to_start, side="left") - 1
    fits = ahead >= 0
    ahead = by_end[np.maximum(ahead, 0)] if len(by_end) else ahead
    fits[fits] = lane[ahead[fits]] == to_lane[fits]
    pairs.append((ahead[fits], np.flatnonzero(fits)))
    a, b = (np.concatenate(x) for x in zip(*pairs, strict=True))
    # each pair as one number
    a, b = np.divmod(np.unique(a * len(to_lane) + b), max(1, len(to_lane)))
    return lane[a], first[1][a], last[2][b], first[3][a] + last[3][b]


def asked_of(bounds: dict[str, float]) -> list[str]:
    """The primers that are looked for: those of a strand of which both have bounds."""
    return [p for _, *both in ENDS if all(p in bounds for p in both) for p in both]


def placed(texts: list[bytes], primers: dict[str, str], bounds: dict[str, float], asked: list[str]) -> tuple[np.ndarray, ...]:
    """Rows, starts, stops (from 0), distances and strands (as places in ENDS) of texts' molecules, by row and start; see molecules()."""
    places, parts = dict(zip(asked, places_of([(primers[p].encode(), int(bounds[p])) for p in asked], texts), strict=True)) if asked else {}, []
    for k, (_, first, last) in enumerate(ENDS):
        if first in places:
            most = int(bounds[first] + bounds[last])
            row, start, stop, distance = _intervals(places[first], places[last])
            parts.append((row, start, stop, distance, most + 1 - distance, np.full(len(row), k)))
    row, start, stop, distance, weight, strand = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 6
    good = schedule(row, start, stop, weight, len(texts))
    good = np.flatnonzero(good)[np.lexsort((start[good], row[good]))]
    return row[good], start[good], stop[good], distance[good], strand[good]


def parts_of(row: np.ndarray, stop: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of molecules by row and start the rows, begins (from 0) and sizes of what split() makes of texts of some lengths, in order."""
    count = np.bincount(row, minlength=len(lengths))
    several = np.flatnonzero(count[row] > 1)
    lane, end = row[several], stop[several] + 1
    last = np.append(lane[1:] != lane[:-1], True) if len(lane) else np.zeros(0, bool)
    first = np.append(True, lane[1:] != lane[:-1]) if len(lane) else np.zeros(0, bool)
    begin = np.where(first, 0, np.roll(end, 1))
    size = np.where(last, lengths[lane], end) - begin
    whole = np.flatnonzero(count < 2)
    lane, begin, size = np.concatenate([whole, lane]), np.concatenate([np.zeros(len(whole), np.int64), begin]), np.concatenate([lengths[whole], size])
    by = np.argsort(lane, kind="stable")
    return lane[by], begin[by], size[by]


def molecules(reads: DataFrame, plan: DemuxPlan, bounds: dict[str, float], seq: str = "seq", name: str = "molecules", keep: list[str] | None = None) -> DataFrame:
    """reads, or their columns keep, with an array of (strand, start, stop, distance): their molecules by start, as many as there are.

    A molecule goes from a forward primer to the next reverse one, or on the other strand from that one's complement to the
    forward one's, both within their bounds (those of calibration let some chance places through; stricter ones don't).
    Of places next to each other the nearest counts. Molecules don't overlap: those are taken that together stay furthest
    within their bounds. Places count from 1. Null and empty reads, and those without molecules, have an empty array.
    """
    primers = dict(plan.adapters)
    if keep is not None:
        # the sequence last, where it goes in but doesn't come out
        reads = reads.select(*keep, *([] if seq in keep else [seq]))
    width = len(reads.columns if keep is None else keep)
    at = reads.columns.index(seq)
    asked = asked_of(bounds)
    kind = "array<struct<strand: string, start: int, stop: int, distance: int>>"
    shape = StructType([*reads.schema.fields[:width], *_parse_datatype_string(f"`{name}` {kind}").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        into = to_arrow_schema(shape)
        entry = into.field(len(into) - 1).type.value_type
        for b in batches:
            row, start, stop, distance, strand = placed([t or b"" for t in b.column(at).cast(pa.binary()).to_pylist()], primers, bounds, asked)
            columns = [pa.array([e[0] for e in ENDS]).take(pa.array(strand)), *(pa.array((x + shift).astype(np.int32)) for x, shift in ((start, 1), (stop, 1), (distance, 0)))]
            filled = pa.StructArray.from_arrays([c.cast(f.type) for c, f in zip(columns, entry, strict=True)], fields=list(entry))
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(b.num_rows + 1)).astype(np.int32)), filled)
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip([*b.columns[:width], lists], into, strict=True)], schema=into)

    return reads.mapInArrow(run, shape)


def split(reads: DataFrame, plan: DemuxPlan, bounds: dict[str, float]) -> DataFrame:
    """Reads id, seq, qual with each molecule a read of its own, its number after the id; reads of one molecule, or none, as they are.

    A part goes from the end of the molecule before it to its own, the last one's to the read's end.
    """
    found = molecules(reads.select("id", "seq", "qual"), plan, bounds)
    several = F.size("molecules") > 1
    whole = F.array(F.struct(F.lit(0).alias("number"), F.lit(1).alias("start"), F.length("seq").alias("stop")))
    begin = lambda k: F.when(k == 0, 1).otherwise(F.get("molecules", k - 1)["stop"] + 1)
    parts = F.transform("molecules", lambda m, k: F.struct((k + 1).alias("number"), begin(k).alias("start"), F.when(k == F.size("molecules") - 1, F.length("seq")).otherwise(m["stop"]).alias("stop")))
    rows = found.select("id", "seq", "qual", F.explode(F.when(several, parts).otherwise(whole)).alias("part"))
    cut = lambda c: F.when(F.col("part.number") == 0, F.col(c)).otherwise(F.substring(c, F.col("part.start"), F.col("part.stop") - F.col("part.start") + 1))
    return rows.select(F.when(F.col("part.number") == 0, F.col("id")).otherwise(F.concat("id", F.lit("_molecule="), "part.number")).alias("id"), cut("seq").alias("seq"), cut("qual").alias("qual"))
