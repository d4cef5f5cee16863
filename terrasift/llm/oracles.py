"""DuckDB SQL for the queries that SQL can express."""

WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP1 = "SELECT doc_id, lang, source, n_chars, CAST(octet_length(encode(text)) AS BIGINT) AS n_bytes, sha256(text) AS text_sha256 FROM documents"

OP2 = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS uid, {WORDS} AS ws FROM documents),
b AS (SELECT item_id, {WORDS} AS ws FROM benchmark),
w AS (SELECT DISTINCT item_id, array_to_string(ws[p : p + 9], ' ') AS win, least(10, len(ws)) AS n
      FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS p FROM b WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT n FROM w),
g AS (SELECT uid, p, n, array_to_string(ws[p : p + n - 1], ' ') AS win
      FROM (SELECT uid, ws, n, unnest(range(1, len(ws) - n + 2)) AS p FROM d, sizes WHERE len(ws) >= n)),
m AS (SELECT DISTINCT g.uid, g.p, g.n, w.item_id FROM g JOIN w ON g.win = w.win AND g.n = w.n),
hit AS (SELECT uid, count(DISTINCT q) AS n_hit FROM (SELECT uid, unnest(range(p, p + n)) AS q FROM m) GROUP BY uid),
named AS (SELECT uid, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS names
          FROM (SELECT DISTINCT uid, CAST(item_id AS VARCHAR) AS i FROM m) GROUP BY uid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (uid) LEFT JOIN named USING (uid)
"""

OP3 = r"""
WITH l AS (
    SELECT doc_id, p, lines[p] AS raw, list_sort(list_distinct(regexp_extract_all(lower(lines[p]), '[^\x20\x09-\x0D]+'))) AS ws
    FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS p FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents))),
u AS (SELECT *, row_number() OVER (ORDER BY doc_id, p) AS k, len(ws) AS n FROM l),
c AS (SELECT ws, n, min(k) AS k FROM u WHERE n > 0 GROUP BY ws, n),
t AS (SELECT k, n, unnest(ws) AS w FROM c),
f AS (SELECT w, count(*) AS df FROM t GROUP BY w),
r AS (SELECT k, n, w, row_number() OVER (PARTITION BY k ORDER BY df, w) AS pos FROM t JOIN f USING (w)),
q AS (SELECT * FROM r WHERE pos <= n - CAST(ceil(n * 80 / 100) AS BIGINT) + 1),
m AS (SELECT DISTINCT a.k AS i, b.k AS j FROM q a JOIN q b ON a.w = b.w AND a.k < b.k AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
v AS (SELECT DISTINCT j FROM m JOIN c x ON x.k = i JOIN c y ON y.k = j WHERE 180 * len(list_intersect(x.ws, y.ws)) >= 80 * (x.n + y.n)),
gone AS (SELECT u.k FROM u JOIN c ON u.ws = c.ws WHERE u.k <> c.k OR c.k IN (SELECT j FROM v))
SELECT doc_id, count(*) AS n_lines, count(gone.k) AS n_removed,
       sha256(coalesce(string_agg(raw, chr(10) ORDER BY p) FILTER (WHERE gone.k IS NULL), '')) AS text_sha256
FROM u LEFT JOIN gone USING (k) GROUP BY doc_id
"""

OP6 = r"""
WITH RECURSIVE d AS (
    SELECT doc_id, list_distinct(CASE WHEN len(ws) >= 4 THEN list_transform(range(1, len(ws) - 2), lambda p: array_to_string(ws[p : p + 3], ' '))
                                      WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS s
    FROM (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents)),
g AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM d),
o AS (SELECT a.doc_id AS i, b.doc_id AS j, count(*) AS c, any_value(a.n) + any_value(b.n) AS m FROM g a JOIN g b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT i, j FROM o WHERE 100 * c >= 85 * (m - c)),
e AS (SELECT i, j FROM l UNION ALL SELECT j, i FROM l),
r AS (SELECT doc_id AS i, doc_id AS j FROM d UNION SELECT r.i, e.j FROM r JOIN e ON r.j = e.i)
SELECT d.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, min(r.j) AS component_id FROM d JOIN r ON r.i = d.doc_id GROUP BY d.doc_id, s
"""

OP9 = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC) = 1 AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_sharding": OP1, "op2_decontaminate": OP2, "op3_line_dedup": OP3, "op6_ngram_jaccard_join": OP6, "op9_exact_dedup": OP9}
