"""Adapters in reads: distances and places, as rows or as signatures."""

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from strandloom.functions import lanes
from strandloom.functions.alignment import Hits, Texts, best_places, infix, located, tails, tails_of

_HIT = "array<struct<query_id: string, ed: int, start: int, stop: int, second_ed: int, second_start: int, second_stop: int>>"
#: Bytes of texts that are aligned at once with tags.
TEXT = 1 << 23
_ENTRY = "array<struct<id: string, ed: int, start: int, stop: int>>"


def _with_hits(reads: DataFrame, adapters: list[tuple[str, str]], exact_pairing: bool, seq: str = "seq", poly: tuple[str, ...] = ()) -> DataFrame:
    """reads with hits: for each adapter the least distance and its first two places. All adapters in one pass over reads.

    Then for each base in poly the place of its tail, as a hit at distance 0 or, without one, at -1.
    """
    at = reads.columns.index(seq)
    shape = StructType([*reads.schema.fields, *_parse_datatype_string(f"hits {_HIT}").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        into = to_arrow_schema(shape)
        kind = into.field("hits").type
        for b in batches:
            texts = Texts.of(b.column(at))
            n, m = b.num_rows, len(adapters) + len(poly)
            table = np.full((n, m, 6), -1, np.int32)
            best = best_places([query.encode() for _, query in adapters], texts, exact_pairing)
            table[:, : len(adapters), :3], table[:, : len(adapters), 4:] = best[:, :, :3], best[:, :, 3:]
            table[:, : len(adapters), 3] = np.where(best[:, :, 3] >= 0, best[:, :, 0], -1)
            for k, base in enumerate(poly, len(adapters)):
                place = tails_of(base, texts)
                table[:, k, 0], table[:, k, 1:3] = np.where(place[:, 0] > 0, 0, -1), place
            names = pa.DictionaryArray.from_arrays(np.tile(np.arange(m, dtype=np.int32), n), [*(a for a, _ in adapters), *poly]).cast(pa.string())
            values = pa.StructArray.from_arrays([names, *(pa.array(table[:, :, c].ravel()) for c in range(6))], fields=list(kind.value_type))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * m), values)
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip([*b.columns, lists], into, strict=True)], schema=into)

    return reads.mapInArrow(run, shape)


def _spaced(adapters: list[tuple[str, str]]) -> tuple[list[tuple[str, str]], list[tuple[str, str]]]:
    """Adapters that align, and poly tails, which are scanned for."""
    poly = [(n, s[0]) for n, s in adapters if n in ("poly_a", "poly_t")]
    return [(n, s) for n, s in adapters if n not in ("poly_a", "poly_t")], poly


def align_stats(reads: DataFrame, adapters: list[tuple[str, str]], id_column: str = "id", exact_pairing: bool = False) -> DataFrame:
    """One row a read and adapter: id, query_id, best_edit_distance, best_start_pos, best_stop_pos, second_edit_distance.

    Places count from 1. The second distance is the first's where there is a second place as good, else -1. Poly tails
    are left out. A null sequence aligns as an empty one: the query's length, start 1 and stop 0.
    """
    hits = _with_hits(reads.select(F.col(id_column).alias("id"), "seq"), _spaced(adapters)[0], exact_pairing)
    return hits.select("id", F.explode("hits").alias("h")).select(
        "id", "h.query_id", F.col("h.ed").alias("best_edit_distance"), F.col("h.start").alias("best_start_pos"), F.col("h.stop").alias("best_stop_pos"), F.col("h.second_ed").alias("second_edit_distance"))


def align_signatures(reads: DataFrame, adapters: list[tuple[str, str]], null_distance: dict[str, tuple[float, float | None]], exact_pairing: bool = False) -> DataFrame:
    """reads with signature: an array of (id, ed, start, stop) of adapters found, by stop, then the order of adapters.

    Each adapter has its best place, and a second one if that is as good and under the adapter's mean less its deviation
    among misalignments; without such numbers it stays, even if there is none, as -1, -1, -1. A poly tail has distance 0.
    """
    align, poly = _spaced(adapters)
    threshold = {k: mean - sd for k, (mean, sd) in null_distance.items() if sd is not None and sd == sd}
    known = set(null_distance)
    out = _with_hits(reads, align, exact_pairing, poly=tuple(base for _, base in poly))
    rank = {n: k for k, (n, _) in enumerate(adapters)}
    pieces = []
    for k, (name, _) in enumerate(align):
        h = F.col("hits")[k]
        entry = lambda a, b, c: F.struct(F.lit(name).alias("id"), h[a].alias("ed"), h[b].alias("start"), h[c].alias("stop"), F.lit(rank[name]).alias("rank"))  # noqa: E731, B023
        drop = F.lit(False) if name not in known else (h["second_ed"] == -1) if name not in threshold else (h["second_ed"] >= threshold[name]) | (h["second_ed"] == -1)
        pieces += [entry("ed", "start", "stop"), F.when(~drop, entry("second_ed", "second_start", "second_stop"))]
    for k, (name, _) in enumerate(poly, len(align)):
        h = F.col("hits")[k]
        pieces.append(F.when(h["ed"] == 0, F.struct(F.lit(name).alias("id"), F.lit(0).alias("ed"), h["start"].alias("start"), h["stop"].alias("stop"), F.lit(rank[name]).alias("rank"))))
    sort = F.array_sort(F.transform(F.array_compact(F.array(*pieces)), lambda x: F.struct(x["stop"].alias("stop"), x["rank"].alias("rank"), x["start"].alias("start"), x["id"].alias("id"), x["ed"].alias("ed"))))
    return out.withColumn("signature", F.transform(sort, lambda x: F.struct(x["id"].alias("id"), x["ed"].alias("ed"), x["start"].alias("start"), x["stop"].alias("stop"))).cast(_ENTRY)).drop("hits")


def poly_tails(reads: DataFrame, bases: tuple[str, ...] = ("T", "A"), seq: str = "seq") -> DataFrame:
    """reads with <base>_start and <base>_stop, from 1, of each base's poly tail; null without one. As poly_tail() of sequence, in Arrow batches."""
    at = reads.columns.index(seq)
    names = [f"{b.lower()}_{part}" for b in bases for part in ("start", "stop")]
    shape = StructType([*reads.schema.fields, *_parse_datatype_string(", ".join(f"{n} int" for n in names)).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        into = to_arrow_schema(shape)
        for b in batches:
            texts = [(t or "").encode() for t in b.column(at).to_pylist()]
            found = np.concatenate([tails(base, texts) for base in bases], axis=1)
            added = [pa.array(c.astype(np.int32), mask=c < 0) for c in found.T]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip([*b.columns, *added], into, strict=True)], schema=into)

    return reads.mapInArrow(run, shape)


def align_pairs(df: DataFrame, query: str, text: str, mode: str = "infix", most: int = -1, equal: tuple[tuple[str, str], ...] = (), path: bool = False, name: str = "aligned", starts: bool = True) -> DataFrame:
    """df with a struct of how each row's query lies in its text: distance, starts, stops, path and cigar.

    mode: global, prefix or infix, as in MODES of alignment. Places count from 1; a stop of 0 uses nothing of the text. Over
    the bound most, the distance is -1 and there are no places. equal: pairs of letters that match, such as N and A. path is
    that of the first place, with = X I D, and cigar its run lengths; both are null unless asked for. A null query or text
    gives a null struct. A batch's pairs are aligned together, a lane each. Without starts, which take an alignment of each
    place backwards, those are null; a path needs them.
    """
    if path and not starts:
        raise ValueError("a path needs starts")
    at = df.columns.index(query), df.columns.index(text)
    shape = StructType([*df.schema.fields, *_parse_datatype_string(f"`{name}` struct<distance: int, starts: array<int>, stops: array<int>, path: string, cigar: string>").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        into = to_arrow_schema(shape)
        for b in batches:
            q, t = (b.column(k).fill_null("").to_pylist() for k in at)
            missing = pc.or_(b.column(at[0]).is_null(), b.column(at[1]).is_null())
            hits = located(q, t, mode, most, equal, starts)
            places = pa.array(np.searchsorted(hits.lane, np.arange(b.num_rows + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(places, pa.array((x + 1).astype(np.int32))) for x in (hits.start, hits.end)]
            lists[0] = lists[0] if starts else pa.nulls(b.num_rows, lists[0].type)
            parts = [pa.array(hits.distance.astype(np.int32)), *lists, *_paths(q, t, hits, equal, path)]
            found = pa.StructArray.from_arrays([x.cast(f.type) for x, f in zip(parts, into.field(len(into) - 1).type, strict=True)], fields=list(into.field(len(into) - 1).type), mask=missing)
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip([*b.columns, found], into, strict=True)], schema=into)

    return df.mapInArrow(run, shape)


def _paths(queries: list[str], texts: list[str], hits: Hits, equal: tuple[tuple[str, str], ...], wanted: bool) -> list[pa.Array]:
    """Paths of the first places, and their run lengths, as columns; null where there is no place."""
    n = len(queries)
    if not wanted:
        return [pa.nulls(n, pa.string())] * 2
    lane, first = np.unique(hits.lane, return_index=True)
    flat, sizes = lanes.paths([queries[k] for k in lane], [texts[k][s : e + 1] for k, s, e in zip(lane, hits.start[first], hits.end[first], strict=True)], equal)
    ends = np.concatenate(([0], np.cumsum(sizes)))
    path = pa.LargeStringArray.from_buffers(len(lane), pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(flat))
    move, length, count = lanes.runs(flat, sizes)
    pieces = pc.binary_join_element_wise(pa.array(length).cast(pa.string()), pa.DictionaryArray.from_arrays(pa.array(np.searchsorted([*b"=DIX"], move).astype(np.int32)), ["=", "D", "I", "X"]).cast(pa.string()), "")
    runs = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(count))).astype(np.int32)), pieces), "")
    at = np.full(n, -1)
    at[lane] = np.arange(len(lane))
    at = pa.array(at, mask=at < 0)
    return [path.take(at), runs.take(at)]


def pieces_of(phrase: str, most: int) -> list[tuple[int, str]]:
    """A phrase in most + 1 parts, with where each begins: what has most edits at most leaves one of them as it is."""
    if len(phrase) <= most:
        raise ValueError("a tag is longer than the edits that it may have")
    cuts = [len(phrase) * k // (most + 1) for k in range(most + 2)]
    return [(a, phrase[a:b]) for a, b in zip(cuts, cuts[1:])]


def bounded(batch: pa.RecordBatch, at: int) -> Iterator[pa.RecordBatch]:
    """A batch in slices of up to TEXT bytes of text in a column, one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, k = np.cumsum(sizes), 0
    while k < len(sizes):
        stop = max(k + 1, int(np.searchsorted(ends, ends[k] - sizes[k] + TEXT, side="right")))
        yield batch.slice(k, stop - k)
        k = stop


def find_tags(df: DataFrame, text: str, tags: dict[str, str], most: int, name: str = "tags") -> DataFrame:
    """df with an array of (tag, distance, starts, stops): the known phrases that lie in each text with up to most edits.

    In the order of tags; starts and stops of all places at a tag's least distance there, from 1, by stop. Texts that hold no
    part of a phrase as it is can't hold the phrase: they, and null ones, get an empty array without Python. The others are
    aligned, each with the tags that it may hold. Whole texts count; nothing shuffles.
    """
    names = list(tags)
    held = [F.coalesce(_any(F.col(f"`{text}`").contains(F.lit(p)) for _, p in pieces_of(t, most)), F.lit(False)) for t in tags.values()]
    maybe = df.withColumn(name, F.array_compact(F.array(*[F.when(h, k) for k, h in enumerate(held)])))
    kind = "array<struct<tag: string, distance: int, starts: array<int>, stops: array<int>>>"
    shape = StructType([*df.drop(name).schema.fields, *_parse_datatype_string(f"`{name}` {kind}").fields])
    maybe = maybe.select(*[F.col(f"`{c}`") for c in df.drop(name).columns], F.col(f"`{name}`"))
    at = maybe.columns.index(text), maybe.columns.index(name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        into = to_arrow_schema(shape)
        entry = into.field(at[1]).type.value_type
        for b in (part for b in batches for part in bounded(b, at[0])):
            texts, lists = b.column(at[0]).to_pylist(), b.column(at[1])
            row, tag = pc.list_parent_indices(lists).to_numpy(), lists.flatten().to_numpy()
            hits = located([tags[names[k]] for k in tag], [texts[k] for k in row], "infix", most)
            good = np.flatnonzero(hits.distance >= 0)
            places = pa.array(np.append(np.searchsorted(hits.lane, good), len(hits.lane)).astype(np.int32))
            columns = [pa.array([names[k] for k in tag[good]], pa.string()), pa.array(hits.distance[good].astype(np.int32)), *(pa.ListArray.from_arrays(places, pa.array((x + 1).astype(np.int32))) for x in (hits.start, hits.end))]
            found = pa.StructArray.from_arrays([c.cast(f.type) for c, f in zip(columns, entry, strict=True)], fields=list(entry))
            found = pa.ListArray.from_arrays(pa.array(np.searchsorted(row[good], np.arange(b.num_rows + 1)).astype(np.int32)), found)
            yield pa.RecordBatch.from_arrays([(found if k == at[1] else c).cast(f.type) for k, (c, f) in enumerate(zip(b.columns, into, strict=True))], schema=into)

    some = F.size(f"`{name}`") > 0
    none = maybe.where(~some).withColumn(name, F.array().cast(kind))
    return maybe.where(some).mapInArrow(run, shape).unionByName(none)


def _any(conditions: Iterable[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def locations(reads: DataFrame, adapters: list[tuple[str, str]], id_column: str = "id") -> DataFrame:
    """One row a read and adapter: id, query_id, distance, and starts and stops of all places that have it, by stop, from 1."""
    kind = reads.schema[id_column].dataType.simpleString()
    shape = _parse_datatype_string(f"id {kind}, query_id string, distance int, starts array<int>, stops array<int>")
    align = _spaced(adapters)[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        into = to_arrow_schema(shape)
        for b in batches:
            texts = [(t or "").encode() for t in b.column(1).to_pylist()]
            for name, query in align:
                hits = infix(query.encode(), texts)
                offsets = pa.array(np.concatenate(([0], np.cumsum(np.bincount(hits.lane, minlength=len(texts))))).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array((x + 1).astype(np.int32))) for x in (hits.start, hits.end)]
                columns = [b.column(0), pa.array([name] * len(texts)), pa.array(hits.distance.astype(np.int32)), *lists]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, into, strict=True)], schema=into)

    return reads.select(F.col(f"`{id_column}`").alias("id"), "seq").mapInArrow(run, shape)
