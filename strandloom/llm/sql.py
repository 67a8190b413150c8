"""DuckDB SQL for the queries that SQL can express."""

from strandloom.llm.pii import BASE_SCORE, LOWERS, RAISES, REACH, STEP
from strandloom.llm.quality import STOP_WORDS

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP2 = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, {WORDS} AS words FROM documents),
places AS (SELECT rid, words, unnest(range(1, len(words) - 6)) AS i FROM d WHERE len(words) >= 8),
windows AS (SELECT rid, i, array_to_string(words[i:i + 7], ' ') AS win FROM places),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS n FROM windows) WHERE n > 1),
gaps AS (SELECT rid, least(8, coalesce(lead(i) OVER (PARTITION BY rid ORDER BY i) - i, 8)) AS g FROM twice),
covered AS (SELECT rid, CAST(sum(g) AS BIGINT) AS n_repeat_words FROM gaps GROUP BY rid),
m AS (SELECT d.rid, doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, len(regexp_extract_all(text, '!')) AS bangs,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
    len(list_filter(words, lambda w: lower(rtrim(w, '.,;:!?#*$%&|')) IN ({", ".join(f"'{w}'" for w in STOP_WORDS)}))) AS stops,
    coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM d LEFT JOIN covered USING (rid)),
r AS (SELECT *, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND word_chars / greatest(n_words, 1) BETWEEN 2.5 AND 12.0 AND n_symbols / greatest(n_words, 1) <= 0.3 AND stops / greatest(n_words, 1) >= 0.02
  AND bangs / greatest(n_words, 1) <= 0.5 AND n_dup_lines / greatest(len(lines), 1) <= 0.5 AND n_repeat_words / greatest(n_words, 1) <= 0.3 AS kept
FROM r
"""

OP10 = rf"""
WITH d AS (SELECT doc_id, source, CAST(len({WORDS}) AS BIGINT) AS size, CAST('0x' || substr(md5('mix' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
k AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM s),
w AS (SELECT *, CASE (rank - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, 3.0::DOUBLE * source_size AS full_at FROM k),
l AS (SELECT *, full_at / weight AS ratio,
    ((SELECT CAST(sum(source_size) AS DOUBLE) FROM s) - coalesce(sum(full_at) OVER (ORDER BY full_at / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
    / ((SELECT sum(weight) FROM w) - coalesce(sum(weight) OVER (ORDER BY full_at / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)) AS level FROM w),
t AS (SELECT *, (SELECT level FROM l WHERE level < ratio ORDER BY ratio, rank LIMIT 1) AS lvl FROM l),
p AS (SELECT source, source_size, CASE WHEN lvl IS NULL OR ratio <= lvl THEN full_at ELSE weight * lvl END AS target FROM t),
e AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM p),
b AS (SELECT *, CAST(round(target - epochs * source_size) AS BIGINT) AS rest FROM e),
g AS (SELECT source, key, size, count(*) AS n FROM d GROUP BY source, key, size),
c AS (SELECT *, coalesce(sum(size * n) OVER (PARTITION BY source ORDER BY key, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM g)
SELECT d.doc_id, d.size, b.source_size, b.target, CAST(b.epochs * d.size + greatest(0, least(d.size * c.n, b.rest - c.before)) // c.n AS BIGINT) AS taken
FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source JOIN c ON d.source IS NOT DISTINCT FROM c.source AND d.key = c.key AND d.size = c.size
"""


_RANGE = "CAST(min(start) AS VARCHAR) || ':' || CAST(max(stop) AS VARCHAR) || ':' || string_agg(hash, ':' ORDER BY idx)"
OP7 = rf"""
WITH p AS (SELECT page_id, url, coalesce(CAST(page_id AS VARCHAR), '') AS i, coalesce(url, '') AS u, coalesce(html, '') AS h FROM pages),
m AS (SELECT *, md5(i || chr(10) || u) AS x, md5(i) AS y, chr(13) || chr(10) AS nl FROM p),
r AS (SELECT page_id, url, y, h, 'WARC/1.1' || nl || 'WARC-Type: resource' || nl || 'WARC-Record-ID: <urn:uuid:' || x[1:8] || '-' || x[9:12] || '-' || x[13:16] || '-' || x[17:20] || '-' || x[21:32] || '>' || nl
  || 'WARC-Date: 1970-01-01T00:00:00Z' || nl || 'WARC-Target-URI: ' || regexp_replace(u, '[\r\n]', '%0A', 'g') || nl || 'Content-Type: text/html' || nl || 'Content-Length: ' || octet_length(encode(h)) || nl || nl || h || nl || nl AS record FROM m),
l AS (SELECT page_id, url, y, sha256(record) AS sha256, octet_length(encode(record)) AS bytes, y[1:2] = '0a' AND regexp_matches(h, '^[\x00-\x7F]') AS corrupt, count(*) AS copies FROM r GROUP BY ALL),
n AS (SELECT greatest(1, CAST(ceil(count(*) / 512) AS BIGINT)) AS archives FROM l),
a AS (SELECT *, CAST('0x' || y[1:8] AS BIGINT) % (SELECT archives FROM n) AS archive FROM l),
o AS (SELECT *, row_number() OVER w - 1 AS ordinal, CAST(sum(bytes) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS stop FROM a WINDOW w AS (PARTITION BY archive ORDER BY page_id NULLS FIRST, url NULLS FIRST, sha256)),
l0 AS (SELECT archive, ordinal AS idx, stop - bytes AS start, stop, sha256 AS hash FROM o),
l1 AS (SELECT archive, idx // 16 AS up, min(start) AS start, max(stop) AS stop, sha256({_RANGE}) AS hash FROM l0 GROUP BY archive, idx // 16),
l2 AS (SELECT archive, idx // 16 AS up, min(start) AS start, max(stop) AS stop, sha256({_RANGE}) AS hash FROM (SELECT archive, up AS idx, start, stop, hash FROM l1) GROUP BY archive, idx // 16),
l3 AS (SELECT archive, idx // 16 AS up, min(start) AS start, max(stop) AS stop, sha256({_RANGE}) AS hash FROM (SELECT archive, up AS idx, start, stop, hash FROM l2) GROUP BY archive, idx // 16),
l4 AS (SELECT archive, sha256({_RANGE}) AS root FROM (SELECT archive, up AS idx, start, stop, hash FROM l3) GROUP BY archive)
SELECT page_id, url, archive, ordinal, CAST(stop - bytes AS BIGINT) AS start, stop, sha256, copies, root, corrupt FROM o JOIN l4 USING (archive)
"""


#: Kinds of secrets in their order, as patterns for leftmost non-overlapping matches; and what is measured of a match.
_KEY = r"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"\x27]?\x20*[:=]\x20*[\"\x27]?"
_SECRETS = (
    ("assign", _KEY + "[A-Za-z0-9+/_.=-]+", f"length(regexp_extract(m, '{_KEY}([A-Za-z0-9+/_.=-]+)', 1)) >= 6"),
    ("access", "AKIA[A-Z0-9]+", "length(m) >= 20"),
    ("hex", "[0-9a-f]+", "length(m) >= 24"),
    ("github", "gh[pousr]_[A-Za-z0-9]+", "length(m) >= 40"),
    ("slack", "xox[abprs]-[A-Za-z0-9-]+", "length(m) >= 15"),
    ("google", "AIza[A-Za-z0-9_-]+", "length(m) >= 39"),
    ("private_key", "-----BEGIN [A-Z ]*PRIVATE KEY-----", "true"),
)


def _matches(kind: str, order: int, pattern: str, test: str) -> str:
    """Rows (rid, kind, ord, start, stop) of a pattern's matches: parts of the text between marks, every second a match."""
    return rf"""SELECT rid, '{kind}' AS kind, {order} AS ord, start, start + length(m) AS stop FROM (
  SELECT rid, p[i] AS m, CAST(coalesce(list_sum(list_transform(p[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS start FROM (
    SELECT rid, p, unnest(range(2, len(p) + 1, 2)) AS i FROM (SELECT rid, string_split(regexp_replace(t, '({pattern})', chr(57344) || '\1' || chr(57344), 'g'), chr(57344)) AS p FROM d))) WHERE {test}"""


OP3 = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
s AS ({" UNION ALL ".join(_matches(kind, k, pattern, test) for k, (kind, pattern, test) in enumerate(_SECRETS))}),
g AS (SELECT rid, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex, count(*) AS n_spans,
  string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, ord) FILTER (ord < 3) AS base, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, ord) AS spans FROM s GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, CAST(coalesce(n_spans, 0) AS INT) AS n_spans
FROM d LEFT JOIN g USING (rid)
"""

_DIGITS = "string_split(reverse(regexp_replace(m, '[ -]', '', 'g')), '')"
_LUHN = f"CAST(list_sum(list_transform(range(1, len({_DIGITS}) + 1), lambda i: list_sum(list_transform(string_split(CAST(CAST({_DIGITS}[i] AS INT) * (2 - i % 2) AS VARCHAR), ''), lambda x: CAST(x AS INT))))) AS INT) % 10 = 0"
#: Of personal data, the kinds with a plain test, as above.
_PRIVATE = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
    ("ip", r"[0-9]+(?:\.[0-9]+){3}", "len(list_filter(string_split(m, '.'), lambda x: CAST('0' || substr(ltrim(x, '0'), 1, 4) AS INT) > 255)) = 0"),
    ("card", r"[0-9](?:[\x20-]?[0-9])+", f"CASE WHEN len({_DIGITS}) BETWEEN 16 AND 19 THEN {_LUHN} ELSE false END"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "length(regexp_replace(m, '[^0-9]', '', 'g')) BETWEEN 8 AND 15"),
)
_ANY = lambda words: " OR ".join(f"contains(near, '{w}')" for w in words)
_SCORES = " ".join(f"WHEN '{k}' THEN CAST({v} AS DOUBLE) + CASE WHEN {_ANY(RAISES[k])} THEN {STEP} ELSE 0.0 END - CASE WHEN {_ANY(LOWERS[k])} THEN {STEP} ELSE 0.0 END" for k, v in BASE_SCORE.items())
#: Of an IBAN's candidate the first part, by whole groups, of 15 characters or more that passes modulo 97.
_NUMBERS = "string_split(array_to_string(list_transform(string_split(substr(replace(x, ' ', ''), 5) || substr(replace(x, ' ', ''), 1, 4), ''), lambda c: CASE WHEN c <= '9' THEN c ELSE CAST(ascii(c) - 55 AS VARCHAR) END), ''), '')"
_IBAN = rf"""SELECT rid, 'iban' AS kind, 4 AS ord, start, start + length(m) AS stop FROM (
  SELECT rid, start, list_filter(list_transform(range(len(string_split(c, ' ')), 0, -1), lambda k: array_to_string(string_split(c, ' ')[1:k], ' ')),
    lambda x: length(replace(x, ' ', '')) >= 15 AND list_reduce(list_transform({_NUMBERS}, lambda y: CAST(y AS INT)), lambda a, b: (10 * a + b) % 97) = 1)[1] AS m
  FROM (SELECT rid, substr(q, 1 + lead) AS c, start + lead AS start, FROM (SELECT rid, q, start, CASE WHEN regexp_matches(q, '^[A-Z]{{2}}[0-9]{{2}}') THEN 0 ELSE 1 END AS lead FROM (
    SELECT rid, regexp_replace(p[i], '[^A-Za-z0-9]$', '') AS q, CAST(coalesce(list_sum(list_transform(p[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS start FROM (
      SELECT rid, p, unnest(range(2, len(p) + 1, 2)) AS i FROM (SELECT rid, string_split(regexp_replace(t, '((?:^|[^A-Za-z0-9])[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]){{11,30}}(?:$|[^A-Za-z0-9]))', chr(57344) || '\1' || chr(57344), 'g'), chr(57344)) AS p FROM d)))))) WHERE m IS NOT NULL"""

OP8 = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
s AS ({" UNION ALL ".join(_matches(kind, k, pattern, test) for k, (kind, pattern, test) in enumerate(_PRIVATE))} UNION ALL {_IBAN}),
c AS (SELECT s.*, lower(substr(t, greatest(1, start - {REACH - 1}), least(start, {REACH}))) || ' ' || lower(substr(t, stop + 1, {REACH})) AS near FROM s JOIN d USING (rid)),
g AS (SELECT rid, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip, count(*) FILTER (kind = 'card') AS n_card, count(*) FILTER (kind = 'phone') AS n_phone, count(*) FILTER (kind = 'iban') AS n_iban,
  string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY ord, start) FILTER (ord < 4) AS base, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY ord, start) AS spans,
  max(least(1.0, greatest(0.0, CASE kind {_SCORES} END))) AS max_score FROM c GROUP BY rid)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_iban, 0) AS n_iban, max_score
FROM d LEFT JOIN g USING (rid)
"""

OP4 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(list_distinct(list_transform(range(1, greatest(2, len(w) - 1)), lambda i: array_to_string(w[i:i + 2], ' ')))) AS shingle FROM d WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
r(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
g AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM d JOIN g ON d.doc_id = g.a LEFT JOIN n ON n.doc_id = d.doc_id
"""

OP9 = """
WITH RECURSIVE e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
u AS (SELECT vec_id, label, v, sqrt(list_dot_product(v, v)) AS n FROM e
  WHERE label IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id WHERE list_dot_product(a.v, b.v) / a.n / b.n >= 0.98),
r(a, b) AS (SELECT vec_id, vec_id FROM e UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
g AS (SELECT a, min(b) AS component_id FROM r GROUP BY a),
c AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM e JOIN g ON vec_id = g.a LEFT JOIN c ON vec_id = c.a
"""


OP11 = rf"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, {WORDS} AS words, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first FROM documents),
l AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, CAST(len(words) < 100 AS INT) + 2 * CAST(100 * len(list_distinct(words)) < 80 * len(words) AS INT)
    + 4 * CAST(100 * len(regexp_extract_all(text, '[A-Z]')) > 10 * length(text) AS INT) + 8 * CAST(regexp_matches(text, '[#$%&*|]') AS INT) + 16 * CAST(coalesce(d.doc_id > first, false) AS INT) AS mask FROM d LEFT JOIN l USING (doc_id)),
c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m GROUP BY part, mask),
f(x, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o AS (SELECT [a, b, c, d, e] AS xs FROM (SELECT a.x AS a, b.x AS b, c.x AS c, d.x AS d, e.x AS e FROM f a, f b, f c, f d, f e) WHERE len(list_distinct([a, b, c, d, e])) = 5),
s AS (SELECT array_to_string(xs, '') AS filter_order, step, xs[step] AS x, coalesce(list_sum(list_transform(xs[1:step - 1], lambda y: 1 << (ascii(y) - 65))), 0)::INT AS before FROM o, (SELECT unnest(range(1, 6))::INT AS step)),
r AS (SELECT part, filter_order, step, x, CAST(sum(n) FILTER (mask & (before | bit) = 0) AS BIGINT) AS kept, CAST(sum(n) FILTER (mask & before = 0 AND mask & bit > 0) AS BIGINT) AS removed, CAST(sum(n) FILTER (mask & before > 0 AND mask & bit > 0) AS BIGINT) AS redundant,
    CAST(sum(n) FILTER (mask = bit) AS BIGINT) AS unique_fails, CAST(sum(good) FILTER (mask & before = 0 AND mask & bit > 0) AS BIGINT) AS good_lost, CAST(sum(toxic) FILTER (mask & before = 0 AND mask & bit > 0) AS BIGINT) AS toxic_lost
  FROM s JOIN f USING (x), c GROUP BY part, filter_order, step, x)
SELECT part, filter_order, step, coalesce(kept, 0) AS kept, coalesce(removed, 0) AS removed, coalesce(redundant, 0) AS redundant, coalesce(unique_fails, 0) AS unique_fails, coalesce(good_lost, 0) AS good_lost, coalesce(toxic_lost, 0) AS toxic_lost,
  CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, x) AS BIGINT) AS shapley FROM r
"""

_MARK = r"s>|/s>|INST\]|/INST\]|SYS\]|/SYS\]|OUT\]|ROLE\]|/ROLE\]|AS\]|NEXT\]"
_ESCAPED = r"length(regexp_replace({0}, '([<\[])(\\*)(" + _MARK + r")', '\1\2\\\3', 'g'))"
OP12 = rf"""
WITH c AS (SELECT conv_id, turn, role, text FROM conversations UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
t AS (SELECT conv_id, CASE WHEN conv_id IS NULL THEN row_number() OVER () ELSE 0 END AS alone, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM c),
b AS (SELECT *, lag(role) OVER (PARTITION BY conv_id, alone ORDER BY turn NULLS FIRST, role, text) AS before FROM t),
n AS (SELECT *, {_ESCAPED.format("text")} + CASE WHEN role = before THEN 6 WHEN role = 'system' THEN 11 WHEN role = 'user' THEN 13 WHEN role = 'assistant' THEN 9 ELSE 17 + {_ESCAPED.format("role")} END AS chars FROM b)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256, CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '')) AS loss_sha256, CAST(3 + sum(chars) AS BIGINT) AS formatted_chars FROM n GROUP BY conv_id, alone
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_quality_rules": OP2, "op3_secret_scan": OP3, "op4_minhash_near_dedup": OP4, "op7_warc_fixity": OP7, "op8_personal_data": OP8, "op9_embedding_near_dedup": OP9, "op10_mix_sources": OP10, "op11_filter_interaction": OP11, "op12_chat_format": OP12}
