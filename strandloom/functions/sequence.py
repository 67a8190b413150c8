"""Scalar functions of sequences, barcodes and qualities: Column expressions, no Python in the rows."""

from itertools import combinations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Barcodes as numbers have two bits a base, the first base highest: A 0, C 1, T 2, G 3; any other letter counts as A.
BASES = "ACTG"
#: What cutting a barcode, tag or read gives when there is nothing to cut.
UNDECIDED = "undecided"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def revcomp(seq: Column | str) -> Column:
    """Reverse complement; case is kept, letters other than ACGT stay. Null gives null."""
    return F.reverse(F.translate(_col(seq), "ACGTacgt", "TGCAtgca"))


def encode(barcode: Column | str) -> Column:
    """A barcode of up to 31 bases as a number. Every letter but C, T and G has code 0."""
    digits = F.translate(F.regexp_replace(_col(barcode), "[^CTG]", "A"), BASES, "0123")
    return F.coalesce(F.conv(digits, 4, 10).cast("bigint"), F.when(_col(barcode).isNotNull(), F.lit(0)).cast("bigint"))


def decode(code: Column | str, length: int = 16) -> Column:
    """The lowest length bases of a number."""
    digits = F.lpad(F.conv(_col(code).cast("string"), 10, 4), 32, "0")
    return F.translate(F.substring(digits, 33 - length, length), "0123", BASES)


def bit_distance(a: Column | str, b: Column | str) -> Column:
    """Bits in which two codes differ."""
    return F.bit_count(_col(a).bitwiseXOR(_col(b)))


def base_distance(a: Column | str, b: Column | str, length: int = 16) -> Column:
    """Bases of the lowest length in which two codes differ."""
    x = _col(a).bitwiseXOR(_col(b))
    low = sum(1 << 2 * k for k in range(length))
    return F.bit_count(x.bitwiseOR(F.shiftright(x, 1)).bitwiseAND(F.lit(low).cast("bigint")))


def mismatch_positions(a: Column | str, b: Column | str) -> Column:
    """Places, from 1, at which two strings differ, within the shorter one."""
    a, b = _col(a), _col(b)
    n = F.least(F.length(a), F.length(b))
    return F.when(n > 0, F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1)))).otherwise(F.array().cast("array<int>"))


def qgrams(seq: Column | str, q: int = 2) -> Column:
    """The set of a string's substrings of length q."""
    s = _col(seq)
    return F.when(F.length(s) >= q, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(s) - (q - 1), F.lit(1))), lambda i: F.substring(s, i, F.lit(q))))).otherwise(F.array().cast("array<string>"))


def qgram_distance(a: Column | str, b: Column | str, q: int = 2) -> Column:
    """Jaccard distance of two strings' q-gram sets; 1 if neither has any."""
    x, y = qgrams(a, q), qgrams(b, q)
    union = F.size(F.array_union(x, y))
    return F.when(union > 0, 1 - F.size(F.array_intersect(x, y)) / F.greatest(union, F.lit(1))).otherwise(F.lit(1.0))


def best_qgram_matches(seq: Column | str, candidates: Column | str, q: int = 2) -> Column:
    """Of an array of candidates all those at the least q-gram distance from a string, if that is under 1 or all are at 1."""
    scored = F.transform(_col(candidates), lambda c: F.struct(qgram_distance(seq, c, q).alias("d"), c.alias("c")))
    least = F.array_min(F.transform(scored, lambda x: x["d"]))
    return F.transform(F.filter(scored, lambda x: x["d"] == least), lambda x: x["c"])


def phred(quality: Column | str) -> Column:
    """Scores of a quality string: each character's ASCII code less 33."""
    q = _col(quality)
    return F.when(F.length(q) > 0, F.transform(F.split(q, ""), lambda c: F.ascii(c) - 33)).when(q.isNotNull(), F.array().cast("array<int>"))


def header_id(header: Column | str) -> Column:
    """A header up to its first space."""
    return F.substring_index(_col(header), " ", 1)


def before_star(sig_id: Column | str) -> Column:
    """A signature id up to its first asterisk."""
    return F.substring_index(_col(sig_id), "*", 1)


def decimals(x: Column | str) -> Column:
    """A number with six decimals, as text."""
    return F.format_string("%.6f", _col(x).cast("double"))


def poly_tail(seq: Column | str, base: str, window: int = 16, least: int = 12) -> Column:
    """Struct of start and stop, from 1: the first start and last end of windows with at least so many of a base; else null.

    Case doesn't count; windows need not touch. Shorter strings have no window. Sequences are ASCII: windows are cut from
    bytes, whose places need no counting.
    """
    s = F.upper(_col(seq))
    data = s.cast("binary")
    part = lambda i: F.substring(data, i, F.lit(window)).cast("string")
    starts = F.filter(F.sequence(F.lit(1), F.greatest(F.length(s) - (window - 1), F.lit(1))), lambda i: window - F.octet_length(F.replace(part(i), F.lit(base.upper()), F.lit(""))) >= least)
    found = F.when(F.length(s) >= window, starts)
    return F.when(F.size(found) > 0, F.struct(F.array_min(found).alias("start"), (F.array_max(found) + (window - 1)).alias("stop")))


def poly_runs(seq: Column | str, base: str, least: int = 12) -> Column:
    """All runs of at least so many of a base."""
    return F.regexp_extract_all(_col(seq), F.lit(f"{base}{{{least},}}"), F.lit(0))


def bit_string(code: Column | str, length: int = 16) -> Column:
    """A code's bits, two a base, as text."""
    return F.lpad(F.bin(_col(code)), 2 * length, "0")


def has_duplicates(values: Column | str) -> Column:
    return F.size(F.array_distinct(_col(values))) < F.size(_col(values))


def flips(code: Column | str, bits: int, length: int = 16) -> Column:
    """All codes that differ in one bit up to so many of the lowest 2 * length, in order; beyond a few bits, join instead."""
    if bits < 1:
        raise ValueError("flips needs one bit at least")
    masks = [sum(1 << k for k in at) for n in range(1, bits + 1) for at in combinations(range(2 * length), n)]
    # one literal text, which Spark splits once
    every = F.split(F.lit(",".join(map(str, masks))), ",").cast("array<bigint>")
    return F.array_sort(F.transform(every, lambda m: _col(code).bitwiseXOR(m)))
