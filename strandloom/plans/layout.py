"""Read layouts: which pieces a read has, in which order, on either strand. Small, kept on the driver."""

import csv
import io
from collections.abc import Iterable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession

_COMPLEMENT = str.maketrans("ACGTacgt", "TGCAtgca")
POLY = {"poly_a": "A{12,}+", "poly_t": "T{12,}+"}
SWAP = {"poly_a": "poly_t", "poly_t": "poly_a"}


@dataclass(frozen=True)
class Piece:
    id: str
    seq: str | None
    expected_length: int | None
    type: str
    order: int = 0
    direction: str = "forward"


def _revcomp(seq: str) -> str:
    return seq.translate(_COMPLEMENT)[::-1]


def expand(rows: Iterable[tuple[str, str | None, int | None, str]]) -> list[Piece]:
    """The layout of both strands from that of one: (id, seq, expected_length, type) in the order of the read.

    Sequences give the length. Poly tails get their pattern. The longest adapter, the first of equals, at most one place
    after the barcode is the flanking adapter. Reverse pieces follow, in the forward order, with rc_ before their ids,
    but for poly tails, which swap.
    """
    forward = []
    for k, (name, seq, length, kind) in enumerate(rows, 1):
        seq = seq or None
        forward.append(Piece(name, seq or POLY.get(kind), len(seq) if seq else length, kind, k))
    barcode = min((p.order for p in forward if p.type == "barcode"), default=None)
    near = [p for p in forward if p.type == "adapter" and barcode is not None and p.order - barcode <= 1]
    if near:
        flank = max(near, key=lambda p: (p.expected_length or 0, -p.order))
        forward = [replace(p, type="flanking_adapter") if p is flank else p for p in forward]
    back = []
    for p in forward:
        kind = SWAP.get(p.type, p.type)
        seq = POLY[kind] if p.type in SWAP else _revcomp(p.seq) if p.seq else None
        back.append(Piece(SWAP.get(p.id, f"rc_{p.id}"), seq, p.expected_length, kind, 0, "reverse"))
    return [replace(p, order=k) for k, p in enumerate([*forward, *back], 1)]


def parse_table(text: str) -> list[dict[str, str | None]]:
    """Rows of a CSV text whose first line is a title and whose second has names; empty cells are None."""
    return [{k: v or None for k, v in row.items() if k} for row in csv.DictReader(io.StringIO(text.partition("\n")[2])) if any(row.values())]


def _read_text(spark: SparkSession, path: str) -> str:
    """A small file, by whatever file system Spark reads it from."""
    return "\n".join(r["value"] for r in spark.read.option("wholetext", True).text(path).collect())


def read_layout(spark: SparkSession, path: str) -> list[Piece]:
    rows = parse_table(_read_text(spark, path))
    return expand((r["id"], r.get("seq"), int(r["expected_length"]) if r.get("expected_length") else None, r["type"]) for r in rows)


def read_paths(spark: SparkSession, path: str) -> dict[str, str | None]:
    """path_type to actual_path: file, output_dir, whitelist, external_sr_bc."""
    return {r["path_type"]: r.get("actual_path") for r in parse_table(_read_text(spark, path))}


#: Primers of two common kits.
KITS = {
    "three": [("forw_primer", "CTACACGACGCTCTTCCGATCT", 22, "adapter"), ("barcode", None, 16, "barcode"), ("umi", None, 12, "umi"), ("poly_t", None, 12, "poly_t"), ("read", None, None, "read"), ("rev_primer", "CCCATGTACTCTGCGTTGATACCACTGCTT", 30, "adapter")],
    "five": [("forw_primer", "CTACACGACGCTCTTCCGATCT", 22, "adapter"), ("barcode", None, 16, "barcode"), ("umi", None, 10, "umi"), ("tso", "TTTCTTATATGGG", 13, "adapter"), ("read", None, None, "read"), ("rev_primer", "GTACTCTGCGTTGATACCACTGCTT", 25, "adapter")],
}


@dataclass(frozen=True)
class DemuxPlan:
    """What a run needs to know: layout of both strands, whitelist table if any, paths, and how to treat odd cases.

    exact_coords: cut reads at their first base; else one after it. exact_pairing: see two_best() of alignment.
    barcode_length is taken from the layout.
    """

    layout: tuple[Piece, ...]
    whitelist: DataFrame | None = None
    paths: dict[str, str | None] = field(default_factory=dict)
    external: DataFrame | None = None
    exact_coords: bool = False
    exact_pairing: bool = False

    @property
    def adapters(self) -> list[tuple[str, str]]:
        return [(p.id, p.seq) for p in self.layout if p.seq]

    @property
    def orders(self) -> dict[str, int]:
        return {p.id: p.order for p in self.layout}

    def piece(self, name: str) -> Piece | None:
        return next((p for p in self.layout if p.id == name), None)

    @property
    def barcode_length(self) -> int:
        p = self.piece("barcode")
        return p.expected_length or 16 if p else 16


def kit(name: str, **options: object) -> DemuxPlan:
    return DemuxPlan(tuple(expand(KITS[name])), **options)


def build_plan(spark: SparkSession, layout_csv: str, paths_csv: str | None = None, **options: object) -> DemuxPlan:
    """A plan from a layout file and a path file; the whitelist and external barcodes that it names are read lazily."""
    from strandloom.sources.tables import read_barcodes, read_whitelist

    paths = read_paths(spark, paths_csv) if paths_csv else {}
    whitelist = read_whitelist(spark, paths["whitelist"]) if paths.get("whitelist") else None
    external = read_barcodes(spark, paths["external_sr_bc"]) if paths.get("external_sr_bc") else None
    return DemuxPlan(tuple(read_layout(spark, layout_csv)), whitelist, paths, external, **options)


def as_frame(spark: SparkSession, layout: Iterable[Piece]) -> DataFrame:
    return spark.createDataFrame([(p.id, p.seq, p.expected_length, p.type, p.order, p.direction) for p in layout], "id string, seq string, expected_length int, type string, `order` int, direction string")
