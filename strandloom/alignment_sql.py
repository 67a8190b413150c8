"""DuckDB SQL of alignment: bit-parallel columns as a recursion over places, all reads and adapters at once."""

from strandloom.fixtures import FORWARD, REVERSE
from strandloom.plans.layout import kit

POLY = ("poly_a", "poly_t")
ADAPTERS = [(n, s) for n, s in kit("three").adapters if n not in POLY]
#: Names of adapters and poly tails in the layout's order.
RANK = {n: k for k, (n, _) in enumerate(kit("three").adapters)}
_HEAD = "GGTGTAACGA" + FORWARD + "N" * 28 + "T" * 20
#: Constructs as long as half a read and nearly a whole one, and the bound of their distance.
LONG = {"half": _HEAD + "ACGT" * 5, "whole": _HEAD + "ACGT" * 24 + REVERSE[:24]}
LONG_BOUND = 40


def _masks(query: str) -> str:
    """For each of ACGT a number whose bits are its places in the query."""
    return ", ".join(str(sum(1 << k for k, c in enumerate(query) if c == x)) for x in "ACGT")


_QUERIES = ", ".join(f"('{n}', {len(s)}, {(1 << len(s)) - 1}, {_masks(s)}, {_masks(s[::-1])})" for n, s in ADAPTERS)


def _column(name: str, keys: str, letter: str, masks: tuple[str, str, str, str], prefix: bool, begin: str, more: str, other: str = "0") -> str:
    """A recursion of (keys, j, up, down, score): the distance of the query to what ends with the j-th letter, or, with prefix, to the first j letters."""
    own = ", ".join(f"{name}.{k}" for k in keys.split(", "))
    carry = " | 1" if prefix else ""
    case = " ".join(f"WHEN '{x}' THEN {m}" for x, m in zip("ACGT", masks, strict=True))
    return f"""{name}({keys}, j, up, down, score) AS ({begin} UNION ALL
  SELECT {keys}, j, l | (most & ~(v | h)), h & v, score FROM (
    SELECT {keys}, j, most, v, (less << 1) & most AS l, ((more << 1){carry}) & most AS h, score + CAST((more >> (m - 1)) & 1 AS INT) - CAST((less >> (m - 1)) & 1 AS INT) AS score FROM (
      SELECT *, (down | (most & ~(x | up))) AS more, up & x AS less FROM (
        SELECT *, eq | down AS v, (xor((eq & up) + up, up) | eq) & most AS x FROM (
          SELECT {own}, {name}.j + 1 AS j, {name}.up, {name}.down, {name}.score, a.m, a.most, CAST(CASE {letter} {case} ELSE {other} END AS BIGINT) AS eq
          FROM {name} JOIN t ON t.id = {name}.id JOIN a ON a.query_id = {name}.query_id WHERE {more})))))"""


def hits(reads: str, least: int = 0) -> str:
    """CTEs over the rows (rid, seq) of reads that have so many bases: stats, of each read and adapter its distance and first two places."""
    forward = _column("f", "id, query_id", "substr(t.seq, f.j + 1, 1)", ("ma", "mc", "mg", "mt"), False, "SELECT id, query_id, 0, most, 0::BIGINT, m FROM t, a", "f.j < t.n")
    back = _column("g", "id, query_id, e, best", "substr(t.seq, g.e - g.j, 1)", ("ra", "rc", "rg", "rt"), True, "SELECT e.id, e.query_id, e.e, e.best, 0, a.most, 0::BIGINT, a.m FROM e JOIN a USING (query_id) WHERE e.e > 0", "g.j < g.e AND g.j < 2 * a.m")
    return f"""RECURSIVE a0(query_id, m, most0, ma, mc, mg, mt, ra, rc, rg, rt) AS (VALUES {_QUERIES}), a AS (SELECT *, most0::BIGINT AS most FROM a0),
t AS (SELECT rid AS id, seq, CAST(length(seq) AS INT) AS n FROM ({reads}) WHERE length(seq) >= {least}),
{forward},
d AS (SELECT id, query_id, least(min(score), any_value(m)) AS best FROM f JOIN a USING (query_id) GROUP BY id, query_id),
e AS (SELECT f.id, f.query_id, d.best, f.j AS e FROM f JOIN d USING (id, query_id) WHERE f.score = d.best AND f.j > 0 UNION ALL SELECT id, query_id, best, 0 FROM d JOIN a USING (query_id) WHERE best = m),
{back},
s AS (SELECT e.id, e.query_id, e.e, CASE WHEN e.e = 0 THEN 1 ELSE e.e + 1 - coalesce(max(g.j) FILTER (g.score = g.best AND g.j > 0), 0) END AS s FROM e LEFT JOIN g ON g.id = e.id AND g.query_id = e.query_id AND g.e = e.e GROUP BY e.id, e.query_id, e.e),
ends AS (SELECT id, query_id, list(e ORDER BY e) AS ends, list_sort(list_distinct(list(s))) AS starts FROM s GROUP BY id, query_id),
stats AS (SELECT id, query_id, best, starts[1] AS start, ends[1] AS stop, CASE WHEN len(starts) > 1 THEN best ELSE -1 END AS second, coalesce(starts[2], -1) AS second_start, CASE WHEN len(starts) > 1 THEN ends[2] ELSE -1 END AS second_stop FROM ends JOIN d USING (id, query_id))"""


def align_stats(reads: str) -> str:
    return f"WITH {hits(reads)} SELECT id, query_id, best AS best_edit_distance, CAST(start AS INT) AS best_start_pos, CAST(stop AS INT) AS best_stop_pos, second AS second_edit_distance FROM stats"


def null_distance(reads: str) -> str:
    """Mean and deviation of the other strand's adapters on reads on which one strand's adapters are perfect."""
    forward, reverse = (", ".join(f"'{n}'" for n, _ in ADAPTERS if n.startswith("rc_") == back) for back in (False, True))
    perfect = lambda names: f"SELECT id FROM stats WHERE query_id IN ({names}) GROUP BY id HAVING bool_and(best = 0)"
    return f"""WITH {hits(reads)}, o AS (SELECT query_id, best FROM stats WHERE query_id IN ({reverse}) AND id IN ({perfect(forward)}) UNION ALL SELECT query_id, best FROM stats WHERE query_id IN ({forward}) AND id IN ({perfect(reverse)}))
SELECT query_id, avg(best) AS null_distance, stddev_samp(best) AS sd_null FROM o GROUP BY query_id"""


def align_signatures(reads: str, null: dict[str, tuple[float, float]], windows: str) -> str:
    """Signatures of reads of 150 bases and more. windows: of a base, where it has windows of a poly tail."""
    bound = " ".join(f"WHEN '{n}' THEN CAST({mean} AS DOUBLE) - CAST({sd} AS DOUBLE)" for n, (mean, sd) in null.items())
    rank = " ".join(f"WHEN '{n}' THEN {k}" for n, k in RANK.items())
    tail = lambda name, base: f"SELECT id, '{name}' AS query_id, 0 AS ed, list_min(w) AS start, list_max(w) + 15 AS stop FROM (SELECT id, {windows.format(base)} AS w FROM t) WHERE len(w) > 0"
    return f"""WITH {hits(reads, 150)}, p AS (SELECT id, query_id, best AS ed, start, stop FROM stats
  UNION ALL SELECT id, query_id, second, second_start, second_stop FROM stats WHERE second >= 0 AND second < CASE query_id {bound} END
  UNION ALL {tail("poly_t", "T")} UNION ALL {tail("poly_a", "A")})
SELECT id AS rid, string_agg(query_id || ':' || ed || ':' || start || ':' || stop, '|' ORDER BY stop, CASE query_id {rank} END, start, query_id, ed) AS signature FROM p GROUP BY id"""


def _one(reads: str, query: str, text: str, n_matches: bool) -> str:
    """CTEs: i and w, distances of one query to parts, and to beginnings, of a text of each read."""
    column = lambda name, prefix: _column(name, "id, query_id", f"substr(t.seq, {name}.j + 1, 1)", ("ma", "mc", "mg", "mt"), prefix, "SELECT id, query_id, 0, most, 0::BIGINT, m FROM t, a", f"{name}.j < t.n", "a.most" if n_matches else "0")
    return f"""RECURSIVE a AS (SELECT 'q' AS query_id, {len(query)} AS m, {(1 << len(query)) - 1}::BIGINT AS most, {", ".join(f"{k} AS m{x}" for x, k in zip("acgt", _masks(query).split(", "), strict=True))}),
t AS (SELECT rid AS id, {text} AS seq, CAST(length({text}) AS INT) AS n FROM ({reads})), {column("i", False)}, {column("w", True)}"""


def modes(reads: str) -> str:
    return f"""WITH {_one(reads, FORWARD, "seq", True)},
p AS (SELECT id, min(score) AS prefix, CAST(arg_min(j, score * 100000 + j) AS INT) AS prefix_stop, CAST(arg_max(score, j) AS INT) AS whole FROM w GROUP BY id),
x AS (SELECT id, min(score) AS infix FROM i GROUP BY id), e AS (SELECT id, list(j ORDER BY j) AS infix_stops FROM i JOIN x USING (id) WHERE score = infix GROUP BY id)
SELECT id AS rid, whole, prefix, prefix_stop, infix, infix_stops, CASE WHEN infix > 4 THEN -1 ELSE infix END AS near FROM p JOIN x USING (id) JOIN e USING (id)"""


def long(reads: str) -> str:
    """Distances of long constructs, N matching all: columns in two words of half the rows each."""
    words = []
    for name, q in LONG.items():
        half = len(q) // 2
        masks = [sum(1 << k for k, c in enumerate(part) if c in (x, "N")) for part in (q[:half], q[half:]) for x in "ACGT"]
        words.append(f"('{name}', {len(q)}, {half}, {(1 << half) - 1}::HUGEINT, {(1 << len(q) - half) - 1}::HUGEINT, {', '.join(f'{m}::HUGEINT' for m in masks)})")
    pick = lambda p: " ".join(f"WHEN '{x}' THEN {p}{x.lower()}" for x in "ACGT")
    return f"""WITH RECURSIVE a(query_id, m, b, f0, f1, la, lc, lg, lt, ha, hc, hg, ht) AS (VALUES {", ".join(words)}), t AS (SELECT rid AS id, seq, CAST(length(seq) AS INT) AS n FROM ({reads})),
c(id, query_id, j, u0, d0, u1, d1, score) AS (SELECT id, query_id, 0, f0, 0::HUGEINT, f1, 0::HUGEINT, m FROM t, a UNION ALL
  SELECT id, query_id, j, l0 | (f0 & ~(v0 | h0)), h0 & v0, l1 | (f1 & ~(v1 | h1)), h1 & v1, score FROM (
    SELECT id, query_id, j, f0, f1, v0, v1, (r0 << 1) & f0 AS h0, (s0 << 1) & f0 AS l0, ((r1 << 1) | up) & f1 AS h1, ((s1 << 1) | low) & f1 AS l1, score + CAST((r1 >> (m - b - 1)) & 1 AS INT) - CAST((s1 >> (m - b - 1)) & 1 AS INT) AS score FROM (
      SELECT *, d1 | (f1 & ~(x1 | u1)) AS r1, u1 & x1 AS s1 FROM (
        SELECT *, (xor((e1 & u1) + u1, u1) | e1) & f1 AS x1 FROM (
          SELECT *, e | low AS e1 FROM (
            SELECT *, (r0 >> (b - 1)) & 1 AS up, (s0 >> (b - 1)) & 1 AS low FROM (
              SELECT *, d0 | (f0 & ~(x0 | u0)) AS r0, u0 & x0 AS s0 FROM (
                SELECT *, e0 | d0 AS v0, e | d1 AS v1, (xor((e0 & u0) + u0, u0) | e0) & f0 AS x0 FROM (
                  SELECT c.*  EXCLUDE (j), c.j + 1 AS j, a.m, a.b, a.f0, a.f1, CASE substr(t.seq, c.j + 1, 1) {pick("l")} ELSE f0 END AS e0, CASE substr(t.seq, c.j + 1, 1) {pick("h")} ELSE f1 END AS e
                  FROM c JOIN t ON t.id = c.id JOIN a ON a.query_id = c.query_id WHERE c.j < t.n))))))))),
x AS (SELECT id, query_id, min(score) AS distance FROM c GROUP BY id, query_id)
SELECT id AS rid, query_id, any_value(distance) AS distance, list(j ORDER BY j) AS stops, CASE WHEN any_value(distance) > {LONG_BOUND} THEN -1 ELSE any_value(distance) END AS near FROM c JOIN x USING (id, query_id) WHERE score = distance GROUP BY id, query_id"""


def paths(reads: str) -> str:
    """Paths from the end back: what the query has alone before what the text has alone before pairs."""
    low = "((1::BIGINT << s.i) - 1)"
    return f"""WITH {_one(reads, FORWARD, "seq", False)},
l AS (SELECT w.id, any_value(seq) AS seq, any_value(n) AS n, list(up ORDER BY j) AS ups, list(down ORDER BY j) AS downs, CAST(arg_max(score, j) AS INT) AS distance FROM w JOIN t ON t.id = w.id GROUP BY w.id),
s(id, i, j, here, path) AS (SELECT id, {len(FORWARD)}, n, distance, '' FROM l UNION ALL
  SELECT id, CASE WHEN move = 'D' THEN i ELSE i - 1 END, CASE WHEN move = 'I' THEN j ELSE j - 1 END, CASE WHEN move = '=' THEN here ELSE here - 1 END, move || path FROM (
    SELECT s.*, CASE WHEN s.i > 0 AND (l.ups[s.j + 1] >> greatest(s.i - 1, 0)) & 1 = 1 THEN 'I' WHEN s.i = 0 OR s.j - 1 + bit_count(l.ups[s.j] & {low}) - bit_count(l.downs[s.j] & {low}) = s.here - 1 THEN 'D'
      WHEN substr('{FORWARD}', s.i, 1) = substr(l.seq, s.j, 1) THEN '=' ELSE 'X' END AS move FROM s JOIN l ON l.id = s.id WHERE s.i > 0 OR s.j > 0))
SELECT s.id AS rid, l.distance, path, array_to_string(list_transform(regexp_extract_all(path, '=+|X+|I+|D+'), lambda x: length(x) || x[1]), '') AS cigar FROM s JOIN l ON l.id = s.id WHERE s.i = 0 AND s.j = 0"""


def locations(reads: str) -> str:
    return f"WITH {hits(reads)} SELECT id, query_id, any_value(best) AS distance, list(s ORDER BY e) AS starts, list(e ORDER BY e) AS stops FROM s JOIN d USING (id, query_id) GROUP BY id, query_id"


def batches(reads: str, bounds: dict[str, float]) -> str:
    dist = ", ".join(f"max(best) FILTER (query_id = '{n}') AS {n}_dist, max(k) FILTER (query_id = '{n}') AS {n}_k" for n, _ in ADAPTERS)
    f, r, v, rv = (f"{n}_dist {{}} {bounds[n]}" for n in ("forw_primer", "rc_forw_primer", "rev_primer", "rc_rev_primer"))
    return f"""WITH {hits(reads)}, c AS (SELECT id, query_id, best, len(list_distinct(list_concat(starts, ends))) AS k FROM ends JOIN d USING (id, query_id)), x AS (SELECT id, {dist} FROM c GROUP BY id)
SELECT id, {", ".join(f"{n}_dist" for n, _ in ADAPTERS)}, CASE WHEN {r.format(">=")} AND {f.format("<=")} THEN CASE WHEN forw_primer_k > 2 THEN 'parallel_f_concatenates' ELSE 'forwards' END
  WHEN {f.format(">=")} AND rc_forw_primer_dist <= {bounds["forw_primer"]} THEN CASE WHEN rc_forw_primer_k > 2 THEN 'parallel_r_concatenates' ELSE 'reverses' END
  WHEN {f.format("<=")} AND {r.format("<=")} AND {v.format("<=")} AND {rv.format("<=")} THEN 'rescuable_concatenates' ELSE 'undecided' END AS batch FROM x"""


def extracted(reads: str, windows: str, thresholds: str = "") -> str:
    """CTEs: x, rows (id, barcode, umi) that a run with measured thresholds, or those given, cuts out of reads, undecided ones left out."""
    forward, reverse = (", ".join(f"'{n}'" for n, _ in ADAPTERS if n.startswith("rc_") == back) for back in (False, True))
    perfect = lambda names: f"SELECT id FROM stats WHERE query_id IN ({names}) GROUP BY id HAVING bool_and(best = 0)"
    tail = lambda base, end: f"list_{end}({windows.format(base)})"
    short = {"forw_primer": "f", "rev_primer": "r", "rc_forw_primer": "rf", "rc_rev_primer": "rr"}
    last = ", ".join(f"arg_max({c}, stop * 100000 + start) FILTER (query_id = '{n}') AS {k}{'_' + c if c != 'ed' else ''}" for n, k in short.items() for c in ("ed", "start", "stop"))
    bound = ", ".join(f"max(bound) FILTER (query_id = '{n}') AS b{k}" for n, k in short.items())
    # pieces of a read of two strands, in the layout's order
    pieces = ", ".join(f"{{'o': {k}, 'start': {a}, 'stop': {b}}}" for k, (a, b) in enumerate((("f_start", "f_stop"), ("f_stop + 1", "f_stop + 16"), ("f_stop + 17", "f_stop + 28"), ("t_start", "t_stop"), ("r_start", "r_stop"),
        ("rf_start", "rf_stop"), ("rf_start - 16", "rf_start - 1"), ("rf_start - 28", "rf_start - 17"), ("a_start", "a_stop"), ("rr_start", "rr_stop"))))
    cut = lambda a, b: f"CASE WHEN {b} <= n AND {b} - (CASE WHEN {a} = 1 THEN 1 ELSE {a} - 1 END) >= 5 AND (CASE WHEN {a} = 1 THEN 1 ELSE {a} - 1 END) BETWEEN 0 AND n - 1 THEN substr(seq, (CASE WHEN {a} = 1 THEN 1 ELSE {a} - 1 END) + 1, {b} - (CASE WHEN {a} = 1 THEN 1 ELSE {a} - 1 END)) ELSE 'undecided' END"
    turn = lambda c: f"CASE WHEN {c} = 'undecided' THEN 'undecided' ELSE reverse(translate({c}, 'ACGTacgt', 'TGCAtgca')) END"
    one = f"{cut('(f_stop + 1)', '(f_stop + 16)')} AS barcode, {cut('(f_stop + 17)', '(f_stop + 28)')} AS umi"
    two = f"{turn('(' + cut('(rf_start - 16)', '(rf_start - 1)') + ')')} AS barcode, {turn('(' + cut('(rf_start - 28)', '(rf_start - 17)') + ')')} AS umi"
    measured = f"SELECT query_id, avg(best) AS mean, stddev_samp(best) AS sd FROM (SELECT query_id, best FROM stats WHERE query_id IN ({reverse}) AND id IN ({perfect(forward)}) UNION ALL SELECT query_id, best FROM stats WHERE query_id IN ({forward}) AND id IN ({perfect(reverse)})) GROUP BY query_id"
    return f"""{hits(reads)},
nd AS ({thresholds or measured}),
nb AS (SELECT {bound} FROM (SELECT query_id, floor(mean - ceil(sd)) AS bound FROM nd)),
pl AS (SELECT id, query_id, best AS ed, start, stop FROM stats UNION ALL SELECT id, query_id, second, second_start, second_stop FROM stats JOIN nd USING (query_id) WHERE second >= 0 AND second < mean - sd),
pv AS (SELECT id, {last} FROM pl GROUP BY id),
rd AS (SELECT t.*, pv.* EXCLUDE (id), nb.*, {tail("T", "min")} AS t_start, {tail("T", "max")} + 15 AS t_stop, {tail("A", "min")} AS a_start, {tail("A", "max")} + 15 AS a_stop FROM t JOIN pv USING (id), nb WHERE n >= 150),
ca AS (SELECT *, CASE WHEN rf >= brf AND f <= bf AND f < rf OR f <= bf AND rf <= brf AND r <= br AND f < r THEN 'forward' WHEN f >= bf AND rf <= brf AND rf < f OR f <= bf AND rf <= brf AND rr <= brr AND rf < rr THEN 'reverse'
  WHEN f <= bf AND rf <= brf AND t_start IS NOT NULL AND a_start IS NOT NULL THEN 'both' END AS category FROM rd),
o1 AS (SELECT *, [{pieces}] AS q FROM ca WHERE category = 'both'),
o2 AS (SELECT *, list_min(list_transform(list_filter(q, lambda e: e.start > 101), lambda e: e.start)) AS x1 FROM o1),
o3 AS (SELECT *, list_max(list_transform(list_filter(q, lambda e: e.start <= 101), lambda e: e.start * 100 + e.o)) AS before, list_max(list_transform(list_filter(q, lambda e: e.start = x1), lambda e: e.o)) AS at_x1,
  list_min(list_transform(list_filter(q, lambda e: e.start > x1), lambda e: e.start)) AS x2 FROM o2 WHERE x1 IS NOT NULL),
o4 AS (SELECT *, list_filter(q, lambda e: e.start * 100 + e.o = before)[1].stop + 1 AS i_start, x1 - 1 AS i_stop, q[at_x1 + 1].stop + 1 AS j_start, x2 - 1 AS j_stop FROM o3 WHERE before IS NOT NULL AND x2 IS NOT NULL),
x AS (SELECT id, {one} FROM ca WHERE category = 'forward' AND coalesce(t_stop, f_stop + 28) + 1 <= CASE WHEN r <= br AND r_start - 1 <> 0 THEN r_start - 1 ELSE n END
  UNION ALL SELECT id, {two} FROM ca WHERE category = 'reverse' AND CASE WHEN rr <= brr THEN rr_stop + 1 ELSE 1 END <= coalesce(a_start, rf_start) - 1
  UNION ALL SELECT id, {one} FROM o4 WHERE length({cut('i_start', 'i_stop')}) >= 30
  UNION ALL SELECT id, {two} FROM o4 WHERE length({cut('i_start', 'i_stop')}) >= 30 AND length({cut('j_start', 'j_stop')}) >= 30)"""


def signature_lines(reads: str, windows: str) -> str:
    """CTEs of extracted(), and y: a line for each read of 150 bases and more, its signature with all pieces and its category."""
    piece = lambda name, ed, start, stop, when="true": f"CASE WHEN {when} THEN '{name}:' || {ed} || ':' || ({start}) || ':' || ({stop}) END"
    done = ", ".join((
        piece("forw_primer", "f", "f_start", "f_stop"), piece("barcode", 0, "f_stop + 1", "f_stop + 16", "f <= bf"), piece("umi", 0, "f_stop + 17", "f_stop + 28", "f <= bf"), piece("poly_t", 0, "t_start", "t_stop", "t_start IS NOT NULL"),
        f"CASE WHEN category = 'forward' THEN 'read:0:' || (coalesce(t_stop, f_stop + 28) + 1) || ':' || (CASE WHEN r <= br THEN r_start - 1 ELSE 0 END) WHEN t_start IS NOT NULL THEN 'read:0:0:100' END",
        piece("rev_primer", "r", "r_start", "r_stop"), piece("rc_forw_primer", "rf", "rf_start", "rf_stop"), piece("rc_barcode", 0, "rf_start - 16", "rf_start - 1", "rf <= brf"), piece("rc_umi", 0, "rf_start - 28", "rf_start - 17", "rf <= brf"), piece("poly_a", 0, "a_start", "a_stop", "a_start IS NOT NULL"),
        f"CASE WHEN category = 'reverse' THEN 'rc_read:0:' || (CASE WHEN rr <= brr THEN rr_stop + 1 ELSE 1 END) || ':' || (coalesce(a_start, rf_start) - 1) WHEN a_start IS NOT NULL THEN 'rc_read:0:0:100' END",
        piece("rc_rev_primer", "rr", "rr_start", "rr_stop")))
    names = "['forw_primer', 'barcode', 'umi', 'poly_t', 'rev_primer', 'rc_forw_primer', 'rc_barcode', 'rc_umi', 'poly_a', 'rc_rev_primer']"
    line = lambda name, start, stop: f"{name} || ':0:' || {start} || ':' || {stop}"
    both = f"""list_concat(list_transform(q, lambda e: {{'k': e.start * 100 + e.o, 's': {line(f"({names})[e.o + 1]", "e.start", "e.stop")}}}), [{{'k': 10199, 's': {line("'read'", "i_start", "i_stop")}}}, {{'k': x1 * 100 + 99, 's': {line("'rc_read'", "j_start", "j_stop")}}}])"""
    return f"""{extracted(reads, windows)},
y AS (SELECT id, array_to_string(list_transform(list_sort({both}), lambda e: e.s), '|') || '<rescuable_concatenates>' AS line FROM o4
  UNION ALL SELECT id, array_to_string([{done}], '|') || '<' || CASE WHEN category IN ('forward', 'reverse') THEN category ELSE 'undecided' END || '>' FROM ca WHERE id NOT IN (SELECT id FROM o4))"""
