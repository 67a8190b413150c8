"""Personal data: patterns propose spans, checksums and ranges confirm them, words nearby adjust the score."""

import re
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.rows import map_rows

#: In the order of digests: four base kinds, then those added.
KINDS = ("email", "ip", "card", "phone", "iban")

#: Fixed values. Possessive repeats and look-behinds keep the leftmost matches of the plain patterns, in linear time.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_DIGIT = re.compile(r"[0-9]")

#: What a kind scores once confirmed, and words within REACH characters that raise or lower that by STEP.
BASE_SCORE = {"email": 0.8, "ip": 0.5, "card": 0.8, "phone": 0.6, "iban": 0.9}
RAISES = {"email": ("mail", "contact", "write"), "ip": ("address", "host", "server", "login"), "card": ("card", "visa", "payment", "credit"), "phone": ("phone", "tel", "call", "mobile"), "iban": ("iban", "account", "bank")}
LOWERS = {"email": ("example",), "ip": ("version", "release", "build"), "card": ("order", "tracking", "isbn"), "phone": ("fax", "part"), "iban": ("sample",)}
REACH, STEP = 40, 0.15


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    end = 0
    at = text.find("@")
    while at >= 0:
        after = at + 1
        if m := _DOMAIN.match(text, at):
            start = at
            while start > end and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                yield start, m.end()
                end = after = m.end()
        at = text.find("@", after)


def _ips(text: str) -> Iterator[tuple[int, int]]:
    for m in _IP.finditer(text):
        if all(len(p := part.lstrip("0")) <= 3 and int(p or "0") <= 255 for part in m[0].split(".")):
            yield m.span()


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            yield m.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
            yield m.span()


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    for m in _IBAN.finditer(text):
        found = m[0]
        while len(found.replace(" ", "")) >= 15:  # a word in capitals may follow: drop groups from the end
            if mod97(found.replace(" ", "")):
                yield m.start(), m.start() + len(found)
                break
            found = found.rpartition(" ")[0]


def _score(text: str, kind: str, start: int, end: int) -> float:
    near = text[max(0, start - REACH) : start].lower() + " " + text[end : end + REACH].lower()
    score = BASE_SCORE[kind] + STEP * any(w in near for w in RAISES[kind]) - STEP * any(w in near for w in LOWERS[kind])
    return min(1.0, max(0.0, score))


def find(text: str) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) of the spans of a text, by kind and start; code points, end exclusive."""
    spans = [("email", *s) for s in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for kind, proposed in (("ip", _ips), ("card", _cards), ("phone", _phones), ("iban", _ibans)):
            spans += [(kind, *s) for s in proposed(text)]
    return [(*s, _score(text, *s)) for s in spans]


def _start() -> Callable[..., Iterator[tuple]]:
    def f(doc_id: int | None, text: str | None) -> Iterator[tuple]:
        yield doc_id, [{"kind": k, "start": s, "end": e, "score": x} for k, s, e, x in find(text or "")]

    return f


def find_spans(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id and spans, an array of (kind, start, end, score), of each row.

    Null and empty texts have none. Spans of different kinds may overlap; a confirmed span stays whatever its score.
    Repeated rows get equal results each. Time is linear in a text's length. Other columns aren't read; no shuffle.
    """
    kind = docs.schema[id_column].dataType.simpleString()
    return map_rows(docs, [id_column, text_column], f"doc_id {kind}, spans array<struct<kind: string, start: bigint, end: bigint, score: double>>", _start)


def digest(found: DataFrame) -> DataFrame:
    """Counts, the hash of the base spans and all spans as text, of what find_spans() returns."""
    joined = lambda kinds: F.expr(f"array_join(transform(filter(spans, s -> s.kind IN ({', '.join(map(repr, kinds))})), s -> concat_ws(':', s.kind, s.start, s.end)), ',')")
    count = lambda k: F.expr(f"CAST(size(filter(spans, s -> s.kind = '{k}')) AS bigint)")
    return found.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in KINDS[:4]], F.sha2(joined(KINDS[:4]), 256).alias("base_sha256"), joined(KINDS).alias("spans"),
        count("iban").alias("n_iban"), F.expr("array_max(transform(spans, s -> s.score))").alias("max_score"))
