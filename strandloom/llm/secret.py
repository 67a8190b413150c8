"""Secret scans: all rules in one minimal automaton, each text read once, byte by byte."""

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.automaton import Automaton, build, parse, reverse
from strandloom.llm.rows import map_rows


@dataclass(frozen=True)
class Rule:
    """pattern: what the automaton reads. least: characters of a match, or of the group of value if that is given."""

    kind: str
    pattern: str
    least: int = 0
    fold: bool = False
    value: str = ""


_KEYWORD = r"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
_ASSIGN = r"""["']?\x20*[:=]\x20*["']?"""
#: Three base kinds, then those added, in the order of digests. Matches take what they can and are measured
#: after that; hex runs count to 8 in the automaton, so that words of hex letters don't all look like ends.
RULES = (
    Rule("assign", _KEYWORD + _ASSIGN + r"[A-Za-z0-9+/_.=-]+", least=6, value=_KEYWORD + _ASSIGN + r"([A-Za-z0-9+/_.=-]+)"),
    Rule("access", r"AKIA[A-Z0-9]+", least=20),
    Rule("hex", r"[0-9a-f]{8,}", least=24),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", least=40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", least=15),
    Rule("google", r"AIza[A-Za-z0-9_-]+", least=39),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
KINDS = tuple(r.kind for r in RULES)


@lru_cache(maxsize=4)
def compiled(rules: tuple[Rule, ...] = RULES) -> tuple[Automaton, list[Automaton]]:
    """The automaton that finds where matches of any rule end, and for each rule the one that goes back to where they start."""
    trees = [parse(r.pattern, fold="letters" if r.fold else "") for r in rules]
    return build(trees, anywhere=True), [build([reverse(t)], anywhere=False) for t in trees]


def scan(data: bytes, rules: tuple[Rule, ...] = RULES) -> list[tuple[int, int, int]]:
    """(start, rule number, end) of the leftmost longest non-overlapping matches of each rule, by start.

    One forward pass notes each byte after which some rule's match may end; where such bytes follow each other, the last
    counts. From there the reversed rule goes back, not beyond the rule's last match, to the leftmost start.
    """
    forward, back = compiled(rules)
    table, state, accepting = forward.table, forward.start, forward.first_accepting
    ends: list[tuple[int, int]] = []
    place = 0
    for byte in data:
        state = table[state + byte]
        place += 1
        if state >= accepting:
            ends.append((place, state))
    if not ends:
        return []
    found = []
    for k, rule in enumerate(rules):
        own = [p for p, s in ends if k in forward.rules[s >> 8]]
        last = 0
        if not own:
            continue
        for p, following in zip(own, [*own[1:], -1], strict=True):
            if following == p + 1:
                continue
            a, start = back[k], -1
            t, at = a.table, p
            s = a.start
            while at > last and s != a.dead:
                at -= 1
                s = t[s + data[at]]
                if s >= a.first_accepting:
                    start = at
            if start < 0:
                continue
            last = p
            size = p - start
            if rule.value:
                size = len(re.fullmatch(rule.value.encode(), data[start:p])[1])
            if size >= rule.least:
                found.append((start, k, p))
    return sorted(found)


def find(text: str, rules: tuple[Rule, ...] = RULES) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, end exclusive, by start and then the order of rules."""
    data = text.encode()
    found = scan(data, rules)
    if found and len(data) != len(text):
        found = [(len(data[:s].decode()), k, len(data[:e].decode())) for s, k, e in found]
    return [(rules[k].kind, s, e) for s, k, e in found]


def redact(text: str, rules: tuple[Rule, ...] = RULES) -> str:
    """The text with each secret, and what overlaps it, replaced by [SECRET]."""
    out, last = [], 0
    spans = sorted((s, e) for _, s, e in find(text, rules))
    for s, e in spans:
        if s >= last or not out:
            out += [text[last:s], "[SECRET]"]
        last = max(last, e)
    return "".join([*out, text[last:]])


def _start_spans(rules: tuple[Rule, ...]) -> Callable[[], Callable[..., Iterator[tuple]]]:
    def start() -> Callable[..., Iterator[tuple]]:
        compiled(rules)

        def f(doc_id: int | None, text: str | None) -> Iterator[tuple]:
            yield doc_id, [{"kind": k, "start": s, "end": e} for k, s, e in find(text or "", rules)]

        return f

    return start


def find_spans(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id and spans, an array of (kind, start, end), of each row.

    Null and empty texts have none; matches of different rules may overlap. Repeated rows get equal results each. Time
    is linear in a text's length but for the way back over matches. Other columns aren't read; no shuffle.
    """
    kind = docs.schema[id_column].dataType.simpleString()
    return map_rows(docs, [id_column, text_column], f"doc_id {kind}, spans array<struct<kind: string, start: bigint, end: bigint>>", _start_spans(rules))


def redact_documents(docs: DataFrame, text_column: str = "text", length_column: str | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with [SECRET] in place of secrets; all rows and columns stay. length_column, if given, gets the new length in code
    points where a text changes.

    Null and empty texts stay; repeated rows change alike; an empty table gives no rows.
    """
    names = docs.columns
    at, chars = names.index(text_column), names.index(length_column) if length_column else None

    def start() -> Callable[..., Iterator[tuple]]:
        compiled(rules)

        def f(*row: object) -> Iterator[tuple]:
            values = list(row)
            if values[at]:
                clean = redact(values[at], rules)
                if clean != values[at]:
                    values[at] = clean
                    if chars is not None:
                        values[chars] = len(clean)
            yield tuple(values)

        return f

    return map_rows(docs, names, docs.schema, start)


def digest(found: DataFrame) -> DataFrame:
    """Counts, the hash of the base spans and all spans as text, of what find_spans() returns."""
    joined = lambda kinds: F.expr(f"array_join(transform(filter(spans, s -> s.kind IN ({', '.join(map(repr, kinds))})), s -> concat_ws(':', s.kind, s.start, s.end)), ',')")
    count = lambda k: F.expr(f"CAST(size(filter(spans, s -> s.kind = '{k}')) AS bigint)")
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in KINDS[:3]], F.sha2(joined(KINDS[:3]), 256).alias("base_sha256"), joined(KINDS).alias("spans"), F.size("spans").alias("n_spans"))
