"""DuckDB SQL for the rows of queries that SQL can express. Words, windows and sets are spelled out, without any hashing of ours."""

from __future__ import annotations

SPACE = r"[^\x20\x09-\x0D]+"
ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def words(text: str, pattern: str) -> str:
    return f"coalesce(regexp_extract_all({text}, '{pattern}'), [])"


OP1_SQL = f"""
WITH d AS (SELECT doc_id, {words("text", SPACE)} AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 19], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d)),
again AS (SELECT doc_id, i FROM win QUALIFY row_number() OVER (PARTITION BY h ORDER BY doc_id, i) > 1),
word AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
marked AS (SELECT word.*, coalesce(max(CASE WHEN again.i IS NOT NULL THEN 1 END) OVER (PARTITION BY word.doc_id ORDER BY word.i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 0) AS gone
  FROM word LEFT JOIN again USING (doc_id, i)),
agg AS (SELECT doc_id, sum(gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (gone = 0), '') AS kept FROM marked GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN agg USING (doc_id)
"""


def jaccard_sql(k: int, percent: int) -> str:
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, {words(LOWER, SPACE)} AS w FROM documents),
s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {k} THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - {k - 2}), lambda i: array_to_string(w[i:i + {k - 1}], ' ')) END)) AS shingles FROM d),
c AS (SELECT doc_id, len(shingles) AS n, shingles, min(doc_id) OVER (PARTITION BY shingles) AS one FROM s),
t AS (SELECT doc_id, n, unnest(shingles) AS x FROM c WHERE n > 0 AND doc_id = one),
link AS (SELECT a.doc_id AS a, b.doc_id AS b FROM t a JOIN t b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= {percent} * (a.n + b.n - count(*))),
reach(a, b) AS (SELECT doc_id, doc_id FROM c WHERE doc_id = one UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
least AS (SELECT a AS one, min(b) AS component_id FROM reach GROUP BY a),
degree AS (SELECT a AS one, count(*) AS n_links FROM link GROUP BY a)
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, CASE WHEN n = 0 THEN doc_id ELSE component_id END AS component_id, CASE WHEN n = 0 THEN 0 ELSE coalesce(n_links, 0) END AS n_links
FROM c JOIN least USING (one) LEFT JOIN degree USING (one)
"""


OP6_SQL = jaccard_sql(4, 85)

OP10_SQL = f"""
WITH d AS (SELECT doc_id, {words(LOWER, ALNUM)} AS w FROM documents),
item AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {words(LOWER, ALNUM)} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS x FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM item WHERE len(w) > 0)),
here AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS x FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM win))),
hit AS (SELECT doc_id, i, n, item_id FROM here JOIN win USING (n, x)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hit)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""

# CRC-32 of bytes, from the table that its polynomial gives; bytes come from the hexadecimal form
OP7_SQL = """
WITH RECURSIVE step(i, k, v) AS (SELECT range, 0, CAST(range AS BIGINT) FROM range(256) UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM step WHERE k < 8),
crc AS (SELECT list(v ORDER BY i) AS t FROM step WHERE k = 8),
d AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 8 AS size, xor(list_reduce(list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda b: CAST('0x' || b AS BIGINT)),
  lambda a, b: xor(a >> 8, t[1 + CAST(xor(a, b) & 255 AS INTEGER)]), CAST(4294967295 AS BIGINT)), 4294967295) AS text_crc32 FROM documents, crc),
p AS (SELECT *, sum(size) OVER (ORDER BY doc_id, text_crc32, size ROWS UNBOUNDED PRECEDING) AS upto, sum(size) OVER () AS total FROM d),
s AS (SELECT *, CAST(least(23, ((2 * (upto - size) + size) * 24) // (2 * total)) AS INTEGER) AS shard FROM p)
SELECT doc_id, CAST(size AS BIGINT) AS size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id, text_crc32, size) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM s
"""


def either_case(text: str) -> str:
    """Letters outside of escapes and classes, each in either case."""
    out, i, inside = "", 0, False
    while i < len(text):
        c = text[i]
        if c == "\\":
            step = 4 if text[i + 1] == "x" else 2
            out += text[i : i + step]
            i += step
            continue
        inside = c == "[" or (inside and c != "]")
        out += f"[{c.upper()}{c.lower()}]" if c.isalpha() and c.isascii() and not inside else c
        i += 1
    return out


QUOTE, VALUE = r"""["'']?""", r"[A-Za-z0-9+/_.=-]+"
ASSIGN = either_case("(?:password|passwd|secret|token|api_?key)") + QUOTE + r"\x20*[:=]\x20*" + QUOTE
IDENTIFIER = r"\b" + either_case("(?:user_?(?:name|id)?|login|account|client_?id|access_?key(?:_?id)?)") + QUOTE + r"\x20*[:=]\x20*" + QUOTE + "[A-Za-z0-9@._+-]{3,}"
SCHEMES = "(?:" + either_case("https?|ftps?|s3") + "|" + either_case("jdbc") + r":\w+|" + either_case("postgres(?:ql)?|mysql|mongodb|redis|amqp") + ")"
ENDPOINT = r"\b" + SCHEMES + r"""://[^\x20\x09-\x0D"''<>]{3,}|\b""" + either_case("(?:host|endpoint|server)") + QUOTE + r"\x20*[:=]\x20*" + QUOTE + r"[A-Za-z0-9.-]+\.[A-Za-z]{2,}(?::[0-9]+)?"
# what a match must be; of [0-9a-f]+ only runs of 32 matter, and of runs of the opaque class those of 20
KINDS = (
    ("assign", ASSIGN + VALUE, f"length(regexp_replace(x, '^{ASSIGN}', '')) >= 8"), ("access", "AKIA[A-Z0-9]+", "length(x) >= 16"), ("hex", "[0-9a-f]{32,}", "true"),
    ("id", IDENTIFIER, "true"), ("opaque", "[A-Za-z0-9+/_=-]{20,}", "regexp_full_match(x, '[A-Za-z0-9+/_-]{20,}={0,2}') AND regexp_matches(x, '[0-9]') AND regexp_matches(x, '[A-Z]') AND regexp_matches(x, '[a-z]')"),
    ("endpoint", ENDPOINT, "true"), ("break", r"\n[\x20\t\r]*\n", "true"),
)


def _found(kind: str, pattern: str, test: str) -> str:
    cut = f"SELECT doc_id, regexp_extract_all(t, '{pattern}') AS m, string_split_regex(t, '{pattern}') AS p FROM d"
    each = f"SELECT doc_id, unnest(m) AS x, unnest(p[1:len(m)]) AS gap, unnest(range(1, len(m) + 1)) AS j FROM ({cut}) WHERE len(m) > 0"
    placed = f"SELECT doc_id, x, sum(length(gap) + length(x)) OVER (PARTITION BY doc_id ORDER BY j) AS e FROM ({each})"
    return f"SELECT doc_id, '{kind}' AS kind, CAST(e - length(x) AS BIGINT) AS s, CAST(e AS BIGINT) AS e FROM ({placed}) WHERE {test}"


_ID, _SECRET = "('id', 'access')", "('opaque', 'assign', 'hex')"


def _near(kinds: str) -> str:
    return f"EXISTS (SELECT 1 FROM r o WHERE o.doc_id = r.doc_id AND o.kind IN {kinds} AND o.par = r.par AND o.s <= r.e + 200 AND o.e >= r.s - 200)"


OP3_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS ({" UNION ALL ".join(_found(*k) for k in KINDS)}),
q AS (SELECT * FROM f WHERE kind <> 'opaque' UNION ALL SELECT * FROM f WHERE kind = 'opaque' AND NOT EXISTS (SELECT 1 FROM f o WHERE o.doc_id = f.doc_id AND o.kind NOT IN ('opaque', 'break') AND o.s < f.e AND f.s < o.e)),
r AS (SELECT q.*, (SELECT count(*) FROM f b WHERE b.doc_id = q.doc_id AND b.kind = 'break' AND b.e <= q.s) AS par FROM q WHERE kind <> 'break'),
k AS (SELECT doc_id, s, e, CASE kind WHEN 'assign' THEN 0 WHEN 'access' THEN 1 WHEN 'hex' THEN 2 WHEN 'id' THEN 3 WHEN 'opaque' THEN 4 ELSE 5 END AS n FROM r
  WHERE kind IN ('assign', 'access', 'hex') OR (kind = 'id' AND {_near(_SECRET)}) OR (kind = 'opaque' AND {_near(_ID)}) OR (kind = 'endpoint' AND {_near(_ID)} AND {_near(_SECRET)})),
l AS (SELECT doc_id, n, s, e, ['assign', 'access', 'hex', 'id', 'key', 'endpoint'][n + 1] || ':' || s || ':' || e AS span FROM k),
agg AS (SELECT doc_id, count(*) FILTER (n = 0) AS a, count(*) FILTER (n = 1) AS b, count(*) FILTER (n = 2) AS h, string_agg(span, ',' ORDER BY s, n, e) FILTER (n < 3) AS base, string_agg(span, ',' ORDER BY s, n, e) AS spans FROM l GROUP BY doc_id)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(h, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN agg USING (doc_id)
"""
