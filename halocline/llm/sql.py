"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from halocline.llm import licenses


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _spans(name: str, kind: int, pattern: str, source: str = "t") -> str:
    """Rows (rid, kind, a, e, m): positions are sums of the lengths of the pieces between the matches and of the matches."""
    return f"""{name} AS (
  SELECT rid, {kind} AS kind, i,
         list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS a,
         m[i] AS m
  FROM (SELECT rid, regexp_extract_all(text, {_q(pattern)}) AS m, string_split_regex(text, {_q(pattern)}) AS p FROM {source}) s,
       LATERAL (SELECT unnest(range(1, len(m) + 1)) AS i) u
)"""


URLS_SQL = """
WITH p AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
r AS (
  SELECT *, '.' || host AS h,
         CASE WHEN h LIKE '%.www.example.com' AND starts_with(path, '/en/') THEN 'www.example.com/en/'
              WHEN h LIKE '%.example.com' AND starts_with(path, '/en/') THEN 'example.com/en/'
              WHEN h LIKE '%.net' AND starts_with(path, '/es/') THEN 'net/es/'
              WHEN h LIKE '%.net' AND starts_with(path, '/fr/') THEN 'net/fr/'
              WHEN h LIKE '%.com' AND starts_with(path, '/') THEN 'com/' END AS rule
  FROM p)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block'
            WHEN rule IS NOT NULL THEN 'allow'
            WHEN regexp_matches(h, '\\.(ads-track|adult-x|casino-win|cheap-pills|free-bets|spam-farm)\\.example\\.(com|net|org)$') THEN 'block'
            ELSE 'allow' END AS verdict
FROM r
"""


# As the operator should have them, written once more.
_COPYRIGHT_LINE = r"(^|\n)[\t *#/;-]*(?:copyright\b[^\n]*(?:\(c\)|©|\b[12][0-9]{3}\b|\[yyyy\]|<year>)|\(c\) *(?:copyright|[12][0-9]{3}|<year>)|©|all rights reserved[^a-z\n]*(?:\n|$))[^\n]*"
_SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F“”‘’–—•]+"
_SPELLINGS = """licence=license licences=licenses licenced=licensed sub_license=sublicense sub_licence=sublicense sublicence=sublicense acknowledgement=acknowledgment
analogue=analog authorisation=authorization authorised=authorized favour=favor favourite=favorite fulfil=fulfill non_infringement=noninfringement organisation=organization
recognised=recognized while=whilst copyright_holder=copyright_owner copyright_holders=copyright_owners https=http v2_0=version_2_0 v3=version_3"""


def _canonical(text: str, notices: bool = False) -> str:
    out = f"lower({text})" if notices else f"regexp_replace(lower({text}), {_q(_COPYRIGHT_LINE)}, '\\1', 'g')"
    out = f"' ' || regexp_replace({out}, {_q(_SEPARATORS)}, '  ', 'g') || ' '"
    for pair in _SPELLINGS.split():
        there, instead = (x.replace("_", "  ") for x in pair.split("="))
        out = f"replace({out}, ' {there} ', ' {instead} ')"
    return f"trim(replace({out}, '  ', ' '))"


LICENSE_SQL = f"""
WITH texts AS (FROM (VALUES {", ".join(f"({_q(k)}, {_q(v)})" for k, v in [*licenses.LICENSES.items(), *licenses.published()])}) v(license_id, text)),
known AS (SELECT sha256(form) AS d, min(license_id) AS license_id FROM (SELECT license_id, {_canonical("text")} AS form FROM texts UNION ALL SELECT license_id, {_canonical("text", True)} FROM texts) WHERE form <> '' GROUP BY 1),
rows AS (SELECT row_number() OVER () AS rid, doc_id, text FROM documents),
whole AS (SELECT rid, doc_id, sha256({_canonical("coalesce(text, '')")}) AS license_digest, sha256({_canonical("coalesce(text, '')", True)}) AS full_digest FROM rows),
lines AS (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM rows),
hits AS (SELECT DISTINCT rid, license_id FROM lines JOIN known ON sha256({_canonical("line")}) = d),
notices AS (SELECT rid, string_agg(license_id, ',' ORDER BY license_id) AS notices FROM hits GROUP BY 1)
SELECT doc_id, license_digest, coalesce(a.license_id, b.license_id) AS license_id, coalesce(notices, '') AS notices
FROM whole w LEFT JOIN known a ON license_digest = a.d LEFT JOIN known b ON full_digest = b.d LEFT JOIN notices USING (rid)
"""

# The patterns and bounds of the SQL are its own, so that a change of the operator's shows.
_ASSIGN = """([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\\x20*[:=]\\x20*["']?([A-Za-z0-9+/_.=-]+)"""
_ALLOWED = [
    "^[A-Za-z_=+/-]*$", "^[0-9_=+/-]*$", "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    "^[A-Za-z]+([/_=-]+[A-Za-z0-9]{1,4})+$", "^([A-Za-z]+|[0-9]+)([/_=-]+([A-Za-z]+|[0-9]+))*$",
]
_suspect = " AND ".join(f"NOT regexp_matches(m, {_q(p)})" for p in _ALLOWED)

SECRETS_SQL = f"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
{_spans("s0", 0, _ASSIGN)},
{_spans("s1", 1, "AKIA[A-Z0-9]{12,}")},
{_spans("s2", 2, "[0-9a-f]{32,}")},
{_spans("s4", 4, "[A-Za-z0-9]*(?:EXAMPLE|example|0123456789|abcdefghij)[A-Za-z0-9]*")},
base AS (
  SELECT rid, kind, a, a + length(m) AS e FROM s0 WHERE length(regexp_extract(m, {_q(_ASSIGN)}, 2)) >= 8
  UNION ALL SELECT rid, kind, a, a + length(m) FROM s1 UNION ALL SELECT rid, kind, a, a + length(m) FROM s2),
ends AS (SELECT rid, kind, a, e, coalesce(max(e) OVER (PARTITION BY rid ORDER BY a, kind, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS upto FROM (SELECT * FROM base UNION ALL SELECT rid, kind, a, a + length(m) FROM s4)),
gone AS (
  SELECT rid, string_agg(substr(text, CAST(upto + 1 AS BIGINT), CAST(greatest(a - upto, 0) AS BIGINT)) || repeat(' ', CAST(greatest(e - greatest(a, upto), 0) AS BIGINT)), '' ORDER BY a, kind, e) AS front, max(e) AS upto
  FROM ends JOIN t USING (rid) GROUP BY rid),
rest AS (SELECT rid, CASE WHEN front IS NULL THEN text ELSE front || substr(text, CAST(upto + 1 AS BIGINT)) END AS text FROM t LEFT JOIN gone USING (rid)),
{_spans("s3", 3, "[A-Za-z0-9+/_=-]{20,}", "rest")},
runs AS (
  SELECT rid, i, a, m, r, least FROM (
    SELECT rid, i, a, m, unnest(regexp_extract_all(m, '[0-9a-fA-F]{{20,}}')) AS r, 3.0 AS least FROM s3 WHERE {_suspect}
    UNION ALL SELECT rid, i, a, m, m, 3.8 FROM s3 WHERE {_suspect})
  WHERE regexp_matches(r, '[0-9]') AND regexp_matches(r, '[^0-9]')),
windows AS (SELECT *, unnest(range(1, length(r) - 18)) AS w FROM runs),
chars AS (
  SELECT rid, i, a, m, r, least, w, c, count(*) AS n
  FROM (SELECT DISTINCT rid, i, a, m, r, least, w FROM windows) x, LATERAL (SELECT unnest(string_split(substr(x.r, CAST(x.w AS BIGINT), 20), '')) AS c) u GROUP BY ALL),
entropies AS (SELECT rid, i, a, m, least, r, w, -sum(n / 20.0 * log2(n / 20.0)) AS h FROM chars GROUP BY ALL),
high AS (SELECT rid, 3 AS kind, a, a + length(m) AS e FROM entropies GROUP BY rid, i, a, m HAVING max(h - least) >= -1e-12),
found AS (
  SELECT rid, kind, a, ['assign', 'access', 'hex', 'entropy'][kind + 1] || ':' || CAST(a AS BIGINT) || ':' || CAST(e AS BIGINT) AS s
  FROM (SELECT * FROM base UNION ALL SELECT * FROM high)),
per_doc AS (
  SELECT rid, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex, count(*) FILTER (kind = 3) AS n_entropy,
         string_agg(s, ',' ORDER BY a, kind) FILTER (kind < 3) AS base, string_agg(s, ',' ORDER BY a, kind) AS spans
  FROM found GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, coalesce(n_entropy, 0) AS n_entropy,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM t LEFT JOIN per_doc USING (rid)
"""

_digits = "regexp_replace(m, '[^0-9]', '', 'g')"
_luhn = """(list_sum(list_transform(range(1, length(d) + 1), lambda j: CASE WHEN j % 2 = 1 THEN CAST(d[length(d) + 1 - j] AS INT)
  ELSE CAST(d[length(d) + 1 - j] AS INT) * 2 - CASE WHEN CAST(d[length(d) + 1 - j] AS INT) > 4 THEN 9 ELSE 0 END END)) % 10 = 0)"""


def _any(words: str) -> str:
    return f"regexp_matches(near, '\\b(?:{words.replace(' ', '|')})\\b')"


_KINDS = "email ip card phone iban".split()
_RAISE = ["mail email contact", "ip address server host", "card visa credit payment", "phone telephone tel call mobile fax", "iban account bank transfer"]
_raise = "CASE kind " + " ".join(f"WHEN {i} THEN {_any(words)}" for i, words in enumerate(_RAISE)) + " END"
# Characters of an IBAN by country.
_IBAN_LENGTH = """15 NO 16 BE 18 DK FI FK FO GL NL SD 19 MK SI 20 AT BA EE KZ LT LU MN XK 21 CH HR LI LV 22 BG BH CR DE GB GE IE ME RS VA 23 AE GI IL IQ OM SO TL
24 AD CZ ES MD PK RO SA SE SK TN VG 25 LY PT ST 26 IS TR 27 BI DJ FR GR IT MC MR SM 28 AL AZ BY CY DO GT HN HU LB NI PL SV 29 BR EG PS QA UA 30 JO KW MU YE 31 MT SC 32 LC 33 RU"""


def _lengths() -> str:
    out, n = [], 0
    for word in _IBAN_LENGTH.split():
        if word.isdigit():
            n = int(word)
        else:
            out.append(f"WHEN '{word}' THEN {n}")
    return f"CASE substr(s, 1, 2) {' '.join(out)} ELSE length(s) END"


PII_SQL = f"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
{_spans("s0", 0, "[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:[.][A-Za-z0-9-]+)+")},
{_spans("s1", 1, "[0-9]+(?:[.][0-9]+)(?:[.][0-9]+)(?:[.][0-9]+)")},
{_spans("s2", 2, "[0-9](?:[ -]?[0-9])+")},
{_spans("s3", 3, "[+][0-9][ ().0-9-]+[0-9]")},
{_spans("s4", 4, "[A-Z]{2}[0-9]{2}", "t")},
starts AS (
  SELECT rid, CAST(a AS BIGINT) AS a, regexp_extract(substr(text, CAST(a AS BIGINT) + 1, 70), '^[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]){{11,30}}', 0) AS run
  FROM s4 JOIN t USING (rid) WHERE a = 0 OR NOT regexp_matches(substr(text, CAST(a AS BIGINT), 1), '[A-Z0-9]')),
tries AS (
  SELECT rid, a, n, substr(run, 1, n) AS m, replace(substr(run, 1, n), ' ', '') AS s
  FROM starts JOIN t USING (rid), LATERAL (SELECT unnest(range(15, length(run) + 1)) AS n) u WHERE NOT regexp_matches(substr(text, a + n + 1, 1), '[A-Z0-9]')),
sums AS (
  SELECT *, list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(substr(s, 5) || substr(s, 1, 4), ''),
         lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN CAST(ascii(c) - 48 AS BIGINT) ELSE CAST(ascii(c) - 55 AS BIGINT) END)),
         lambda x, y: (x * CASE WHEN y < 10 THEN 10 ELSE 100 END + y) % 97) AS rest
  FROM tries WHERE m NOT LIKE '% ' AND length(s) >= 15 AND length(s) = {_lengths()}),
iban AS (SELECT rid, 4 AS kind, a, arg_max(m, n) AS m FROM sums WHERE rest = 1 GROUP BY rid, a),
ok AS (
  SELECT rid, kind, a, m FROM s0
  UNION ALL SELECT rid, kind, a, m FROM s1 WHERE len(list_filter(string_split(m, '.'), lambda p: length(ltrim(p, '0')) > 3 OR coalesce(TRY_CAST(p AS HUGEINT), 999) > 255)) = 0
  UNION ALL SELECT rid, kind, a, m FROM (SELECT *, {_digits} AS d FROM s2) WHERE length(d) BETWEEN 13 AND 19 AND {_luhn}
  UNION ALL SELECT rid, kind, a, m FROM s3 WHERE length({_digits}) BETWEEN 9 AND 15
  UNION ALL SELECT rid, kind, a, m FROM iban),
near AS (
  SELECT rid, kind, CAST(a AS BIGINT) AS a, m,
         lower(substr(text, CAST(greatest(a - 40, 0) AS BIGINT) + 1, CAST(least(a, 40) AS BIGINT)) || chr(10) || substr(text, CAST(a AS BIGINT) + length(m) + 1, 40)) AS near
  FROM ok JOIN t USING (rid)),
found AS (
  SELECT rid, kind, a, ['email', 'ip', 'card', 'phone', 'iban'][kind + 1] || ':' || a || ':' || (a + length(m)) AS s,
         least(100, greatest(0, CASE kind WHEN 0 THEN 80 WHEN 1 THEN 50 WHEN 2 THEN 60 WHEN 3 THEN 50 ELSE 80 END
                                + CASE WHEN {_raise} THEN 20 ELSE 0 END - CASE WHEN {_any("example version isbn order serial")} THEN 20 ELSE 0 END)) AS score
  FROM near),
per_doc AS (
  SELECT rid, {", ".join(f"count(*) FILTER (kind = {i}) AS n_{k}" for i, k in enumerate(_KINDS))},
         string_agg(s, ',' ORDER BY kind, a) FILTER (kind < 4) AS base, string_agg(s, ',' ORDER BY kind, a) AS spans,
         string_agg(CAST(score AS VARCHAR), ',' ORDER BY kind, a) AS scores
  FROM found GROUP BY rid)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in _KINDS)},
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(scores, '') AS scores_percent
FROM t LEFT JOIN per_doc USING (rid)
"""

EMBEDDINGS_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
r(vec_id, root) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.vec_id),
c AS (SELECT vec_id, min(root) AS component_id FROM r GROUP BY 1), n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY 1)
SELECT e.vec_id, coalesce(n, 0) AS n_links, component_id, e.vec_id = component_id AS kept FROM embeddings e JOIN c USING (vec_id) LEFT JOIN n USING (vec_id)
"""

JACCARD_SQL = """
WITH RECURSIVE d AS (
  SELECT doc_id, text, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t-\\r]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM g x JOIN g y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE common >= 0.8 * (x.n + y.n - common) - 1e-9),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.doc_id),
c AS (SELECT doc_id, min(root) AS class_id FROM r GROUP BY 1), m AS (SELECT a AS doc_id, count(*) AS n FROM l GROUP BY 1),
t AS (SELECT text, min(doc_id) AS copy_of FROM d WHERE len(w) > 0 GROUP BY 1)
SELECT d.doc_id, class_id, coalesce(m.n, 0) AS n_links, coalesce(copy_of, d.doc_id) AS copy_of, d.doc_id = class_id AS kept
FROM d JOIN c USING (doc_id) LEFT JOIN m USING (doc_id) LEFT JOIN t ON t.text = d.text
"""


# Strings of 100 bytes as hex digits, from overlapping pieces of 1000, so that long texts are not searched for each.
REPEATS_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, strlen(coalesce(text, '')) AS n FROM documents),
parts AS (SELECT doc_id, n, off, substr(x, 2 * off + 1, 2 * 1099) AS part FROM (SELECT doc_id, n, x, unnest(range(0, n, 1000)) AS off FROM d WHERE n >= 100)),
strings AS (
  SELECT doc_id, off + i AS p, md5(substr(part, CAST(2 * i + 1 AS BIGINT), 200)) AS s
  FROM (SELECT doc_id, n, off, part, unnest(range(0, least(1000, n - 99 - off))) AS i FROM parts WHERE n - 99 > off)),
later AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) AS place FROM strings) WHERE place > 1),
runs AS (SELECT doc_id, p, sum(opens) OVER (PARTITION BY doc_id ORDER BY p) AS run
         FROM (SELECT doc_id, p, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= 100 THEN 0 ELSE 1 END AS opens FROM later)),
spans AS (SELECT doc_id, min(p) AS a, max(p) + 100 AS z FROM runs GROUP BY doc_id, run),
kept AS (
  SELECT doc_id, string_agg(substr(x, CAST(2 * before + 1 AS BIGINT), CAST(2 * (a - before) AS BIGINT)), '' ORDER BY a) || substr(any_value(x), CAST(2 * max(z) + 1 AS BIGINT)) AS x,
         count(*) AS n_spans, sum(z - a) AS n_removed
  FROM (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM spans) JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept.x, d.x))) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""


def _round(i: int) -> str:
    """Assignments to the centroids of round i, and the centroids that follow."""
    return f"""
a{i} AS MATERIALIZED (
  SELECT rid, any_value(v.v) AS v, min(CAST(list_sum(list_transform(range(1, 65), lambda j: (v.v[j] - c.v[j]) * (v.v[j] - c.v[j]))) AS BIGINT) * 8 + k) AS best
  FROM v, c{i} c GROUP BY rid),
m{i} AS MATERIALIZED (
  SELECT k, list(CAST((s - (((s % n) + n) % n)) // n AS BIGINT) ORDER BY j) AS v
  FROM (SELECT best % 8 AS k, j, sum(v[j]) AS s, count(*) AS n FROM (SELECT best, v, unnest(range(1, 65)) AS j FROM a{i}) GROUP BY ALL) GROUP BY k),
c{i + 1} AS MATERIALIZED (SELECT k, coalesce(m.v, c.v) AS v FROM c{i} c LEFT JOIN m{i} m USING (k))"""


CLUSTERS_SQL = f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS k, v FROM (SELECT v, sha256('3:' || vec_id) AS h FROM v ORDER BY h, v LIMIT 8)),
{",".join(_round(i) for i in range(11))},
found AS (SELECT rid, best % 8 AS k, best // 8 AS d FROM a10),
sums AS (SELECT k, sum(d) AS s FROM found GROUP BY k)
SELECT vec_id, CAST(k AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(s AS BIGINT) AS cluster_inertia, CAST((SELECT sum(s) FROM sums) AS BIGINT) AS inertia,
       sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM found JOIN v USING (rid) JOIN sums USING (k) JOIN c10 c USING (k)
"""

# crc32 bit by bit; a path is the digests of its turns one after another.
TRIES_SQL = """
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS i
  FROM conversations WHERE conv_id IS NOT NULL),
bytes AS (SELECT conv_id, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)) AS b FROM (SELECT DISTINCT conv_id FROM t)),
c AS (
  SELECT conv_id, conv_id - conv_id % 5 AS base,
         xor(4294967295, list_reduce(list_prepend(4294967295, b), lambda crc, x:
             list_reduce(list_prepend(xor(crc, x), range(8)), lambda y, z: xor(y >> 1, CASE WHEN y % 2 = 1 THEN 3988292384 ELSE 0 END)))) % 9 AS h
  FROM bytes),
r AS (
  SELECT c.conv_id, 0 AS own, i, role, text FROM c JOIN t ON t.conv_id = c.base WHERE i <= h
  UNION ALL SELECT c.conv_id, 1, i, role, text FROM c JOIN t ON t.conv_id = c.conv_id WHERE i > h),
q AS (SELECT conv_id, text, row_number() OVER w AS d, count(*) OVER (PARTITION BY conv_id) AS total, string_agg(md5(length(role) || ':' || role || text), '') OVER w AS path
      FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY own, i ROWS UNBOUNDED PRECEDING)),
n AS (
  SELECT path, d AS depth, count(*) AS n_convs, min(conv_id) AS conv_id, any_value(strlen(text)) AS bytes FROM q GROUP BY path, d
  UNION ALL SELECT '', 0, count(*), min(conv_id), 0 FROM c HAVING count(*) > 0),
kids AS (SELECT left(path, 32 * (depth - 1)) AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
nodes AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN kids USING (path)),
below AS (
  SELECT left(path, 32 * up) AS path, count(*) FILTER (n_children = 0) AS n_leaves, CAST(sum((n_convs - 1) * bytes) AS BIGINT) AS saved_tokens
  FROM (SELECT *, unnest(range(depth + 1)) AS up FROM nodes) GROUP BY 1),
ends AS (
  SELECT path, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS ends_sha256
  FROM (SELECT path, conv_id FROM q WHERE d = total UNION ALL SELECT '', conv_id FROM c WHERE conv_id NOT IN (SELECT conv_id FROM q)) GROUP BY path)
SELECT x.conv_id, x.depth, p.conv_id AS parent_conv_id, x.n_convs, x.n_children, n_leaves, saved_tokens, coalesce(ends_sha256, sha256('')) AS ends_sha256
FROM nodes x JOIN below USING (path) LEFT JOIN ends USING (path) LEFT JOIN nodes p ON x.depth > 0 AND p.path = left(x.path, 32 * (x.depth - 1))
"""
