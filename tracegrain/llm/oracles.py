"""SQL twins of the numbered operators' queries, for DuckDB over the same tables."""

from __future__ import annotations

from . import sharding

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_STEP = "CASE WHEN {0} & 1 = 1 THEN xor({0} >> 1, 3988292384) ELSE {0} >> 1 END"


def _crc_table() -> str:
    """Entries 0 to 255 of the CRC-32 table, by its rule: eight steps of shift and division."""
    steps = "SELECT c AS k, c::BIGINT AS v0 FROM range(256) AS r(c)"
    for i in range(8):
        steps = f"SELECT k, {_STEP.format('v0')} AS v0 FROM ({steps})"
    return f"SELECT list(v0 ORDER BY k) AS t FROM ({steps})"


def _feistel(x: str, a: str, b: str, seed: int) -> str:
    """One encipherment of ``x`` among a * b points, as a scalar over lists [l, r, round]."""
    p = sharding.PRIME
    mixed = f"(((({{h}} % {p}) * 48271 + i * 69621 + {seed % p}) % {p}) * ((((({{h}} % {p}) * 48271 + i * 69621 + {seed % p}) % {p}) + {{h}} + i * 16807) % {p})) % {p}"
    even = f"[(s[1] + {mixed.format(h='s[2]')}) % {a}, s[2]]"
    odd = f"[s[1], (s[2] + {mixed.format(h='s[1]')}) % {b}]"
    return f"list_reduce([[{x} // {b}, {x} % {b}]] || list_transform(range(1, {sharding.ROUNDS + 1}), lambda i: [i, 0]), lambda s, t: CASE WHEN t[1] % 2 = 1 THEN {even.replace('i * ', 't[1] * ')} ELSE {odd.replace('i * ', 't[1] * ')} END)"


def op3_sql(shards: int = 24, seed: int = 17) -> str:
    """The law ``rows``: rows in the order of (doc_id, checksum, size), their numbers enciphered until they fall inside."""
    once = _feistel("p", "a", "b", seed)
    return f"""WITH RECURSIVE tab AS ({_crc_table()}),
d AS (SELECT doc_id, coalesce(text, '') AS x FROM documents),
h AS (SELECT doc_id, strlen(x) + 8 AS size, list_transform(regexp_extract_all(hex(encode(x)), '..'), lambda c: (instr('0123456789ABCDEF', c[1]) - 1) * 16 + instr('0123456789ABCDEF', c[2]) - 1) AS bytes FROM d),
k AS (SELECT doc_id, size, xor(CASE WHEN len(bytes) = 0 THEN 4294967295 ELSE list_reduce([4294967295::BIGINT] || bytes, lambda c, y: xor(c >> 8, t[(xor(c, y) & 255) + 1])) END, 4294967295) AS text_crc32 FROM h, tab),
n AS (SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS r, CAST(floor(sqrt(greatest(count(*) OVER () - 1, 0))) AS BIGINT) + 1 AS a, count(*) OVER () AS total FROM k),
g AS (SELECT *, greatest(1, CAST(ceil(total / a) AS BIGINT)) AS b FROM n),
w AS (SELECT r, a, b, total, e[1] * b + e[2] AS p FROM (SELECT r, a, b, total, {once.replace("p //", "r //").replace("p %", "r %")} AS e FROM g)
  UNION ALL SELECT r, a, b, total, e[1] * b + e[2] FROM (SELECT r, a, b, total, {once} AS e FROM w WHERE p >= total))
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'rows' AS law, CAST(w.p % {shards} AS INTEGER) AS shard, CAST(w.p // {shards} AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard, CAST(g.r AS BIGINT) AS row_number
FROM g JOIN w ON g.r = w.r AND w.p < w.total"""


OP5 = f"""WITH tx AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
it AS (SELECT DISTINCT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
iw AS (SELECT DISTINCT item, m, array_to_string(w[s + 1 : s + m], ' ') AS g FROM (SELECT item, w, least(10, len(w)) AS m FROM it WHERE len(w) > 0), LATERAL (SELECT unnest(range(len(w) - m + 1)) AS s)),
ms AS (SELECT DISTINCT m FROM iw),
dw AS (SELECT r, s, m, array_to_string(w[s + 1 : s + m], ' ') AS g FROM (SELECT r, w, m FROM tx, ms WHERE len(w) >= m), LATERAL (SELECT unnest(range(len(w) - m + 1)) AS s)),
hit AS (SELECT DISTINCT r, s, dw.m, item FROM dw JOIN iw ON dw.m = iw.m AND dw.g = iw.g),
pos AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(s, s + m)) AS p FROM (SELECT DISTINCT r, s, m FROM hit)) GROUP BY r),
its AS (SELECT r, list_sort(list(DISTINCT item)) AS items FROM hit GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(pos.n, 0) AS n_hit, CAST(coalesce(len(items), 0) AS BIGINT) AS n_items, sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(pos.n, 0) > 0 AS contaminated
FROM tx LEFT JOIN pos ON tx.r = pos.r LEFT JOIN its ON tx.r = its.r"""

OP10 = """WITH tx AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
ws AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^ \\t\\n\\x0B\\f\\r]+') AS w FROM tx),
ls AS (SELECT r, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \\t\\n\\x0B\\f\\r]')) AS l FROM tx),
g AS (SELECT r, s, array_to_string(w[s + 1 : s + 3], ' ') AS x FROM ws, LATERAL (SELECT unnest(range(len(w) - 2)) AS s) WHERE len(w) >= 3),
twice AS (SELECT r, x FROM g GROUP BY r, x HAVING count(*) > 1),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT g.r, unnest(range(s, s + 3)) AS p FROM g JOIN twice ON g.r = twice.r AND g.x = twice.x) GROUP BY r),
m AS (SELECT ws.r, doc_id, t, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, len(l) AS n_lines, len(regexp_extract_all(t, '[A-Z]')) AS n_capitals
  FROM ws JOIN ls ON ws.r = ls.r LEFT JOIN rep ON ws.r = rep.r),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT (base_failed OR 2 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR (n_lines >= 4 AND 2 * n_dup_lines > n_lines) OR 2 * n_capitals > word_chars) AS kept FROM f"""

OP12 = r"""WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, 'und') AS lang, regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n\x0B\f\r]') AS p FROM documents),
s AS (SELECT lang, regexp_extract_all(unnest(p), '[^ \t]+') AS w FROM d),
g AS (SELECT lang, m, w[i : i + m - 1] AS g FROM s, LATERAL (SELECT unnest(range(1, 5)) AS m), LATERAL (SELECT unnest(range(1, len(w) - m + 2)) AS i)),
f AS (SELECT lang, m, g, count(*) AS n FROM g GROUP BY ALL HAVING count(*) >= 30),
t AS (SELECT lang, count(*) AS n FROM g WHERE m = 1 GROUP BY lang),
c AS (SELECT lang, m, g, n AS a, unnest(range(1, m)) AS k FROM f WHERE m > 1),
x AS (SELECT c.lang, c.m, c.g, a, k, f1.n AS l, f2.n AS r, 2000000::HUGEINT * a // (f1.n + f2.n) AS score FROM c JOIN f f1 ON f1.lang = c.lang AND f1.g = c.g[1:k] JOIN f f2 ON f2.lang = c.lang AND f2.g = c.g[k + 1 :]),
b AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
u AS (SELECT lang, g[i : i + q - 1] AS g, max(n) AS around FROM f, LATERAL (SELECT unnest(range(2, m)) AS q), LATERAL (SELECT unnest(range(1, m - q + 2)) AS i) WHERE m > 2 GROUP BY ALL),
o AS (SELECT b.*, array_to_string(b.g, ' ') AS phrase FROM b LEFT JOIN u ON u.lang = b.lang AND u.g = b.g WHERE around IS NULL OR 100::HUGEINT * around < 80::HUGEINT * a),
e AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM o)
SELECT e.lang, rank, phrase, a, l, r, t.n, CAST(score AS BIGINT) AS score FROM e JOIN t ON t.lang = e.lang WHERE rank <= 2000"""

OP13 = r"""WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
o AS (SELECT r, lang, source, unnest(w) AS term FROM d),
t AS (SELECT lang, term, count(*) AS ln FROM o GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
c AS (SELECT o.lang, source, o.term, count(*) AS n, any_value(ln) AS ln FROM o JOIN t ON o.lang = t.lang AND o.term = t.term GROUP BY ALL),
v AS (SELECT lang, count(*)::HUGEINT AS v, sum(ln)::HUGEINT AS lt FROM t GROUP BY lang),
s AS (SELECT g.lang, g.source, coalesce(sum(n), 0)::HUGEINT AS total FROM g LEFT JOIN c ON g.lang = c.lang AND g.source = c.source GROUP BY ALL),
p AS (SELECT s.lang, s.source, t.term, coalesce(n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(n, 0) + 1) // (total + v) AS p, 1 + 1000000000::HUGEINT * (t.ln + 1) // (lt + v) AS q
  FROM s JOIN v ON s.lang = v.lang JOIN t ON t.lang = s.lang LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = t.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p)::HUGEINT AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
every AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM every QUALIFY part = 'pair' OR rank <= 200"""
