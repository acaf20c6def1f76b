"""The queries as SQL for DuckDB, as far as SQL can express them."""

from coinbrook.llm.license_rules import CONFIDENCE, RULES

#: Lower-cases A-Z alone, then takes words.
_WORDS = """regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"""

#: Every run of as many words as a window has is compared with the windows.
OP1 = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
win AS (
    SELECT DISTINCT item_id, least(10, len(w)) AS k,
           array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS s
    FROM (SELECT *, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
spots AS (
    SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS s
    FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i
          FROM d, (SELECT DISTINCT k FROM win) WHERE len(w) >= k)),
hit AS (SELECT DISTINCT doc_id, i, k, item_id FROM spots JOIN win USING (k, s)),
places AS (
    SELECT doc_id, count(DISTINCT p) AS n
    FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY doc_id),
items AS (
    SELECT doc_id, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids
    FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(places.n, 0) AS n_hit, coalesce(items.n, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(places.n, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN items USING (doc_id)
"""

#: Equal texts are found by comparing the texts themselves.
OP2 = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
SELECT doc_id,
       max(doc_id) OVER g AS keep_id,
       count(*) OVER g AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept,
       sha256(text) AS text_sha256
FROM d
WINDOW g AS (PARTITION BY text)
"""

#: All pairs that share a run of four words are compared, and links are followed to their ends.
OP6 = r"""
WITH RECURSIVE d AS (
    SELECT doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x20\x09-\x0D]+') AS w
    FROM documents),
s AS MATERIALIZED (
    SELECT DISTINCT doc_id, array_to_string(w[i:i + least(4, len(w)) - 1], ' ') AS g
    FROM (SELECT *, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (
    SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared
    FROM s AS a JOIN s AS b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS MATERIALIZED (
    SELECT x, y FROM pairs JOIN n AS nx ON nx.doc_id = x JOIN n AS ny ON ny.doc_id = y
    WHERE 100 * shared >= 80 * (nx.n + ny.n - shared)),
edges AS MATERIALIZED (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT x, y FROM edges UNION SELECT r.x, e.y FROM reach AS r JOIN edges AS e ON r.y = e.x),
least_of AS (SELECT x, least(x, min(y)) AS component_id FROM reach GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(component_id, d.doc_id) AS component_id,
       coalesce(component_id, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN least_of ON x = d.doc_id
"""

#: Of equal payloads of at least 100 bytes, the smallest page_id is the response.
OP9 = """
WITH p AS (
    SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes,
           sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (
    SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest)
              ELSE page_id END AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first = page_id THEN NULL ELSE first END AS refers_to
FROM f
"""

_OP11_START = """
WITH v AS MATERIALIZED (
    SELECT row_number() OVER () AS r, vec_id, label,
           list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
    FROM embeddings
    WHERE embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (
    SELECT r, vec_id, k AS part, e[k * len(e) // 8 + 1:(k + 1) * len(e) // 8] AS x
    FROM v, (SELECT unnest(range(8)) AS k)),
c0 AS MATERIALIZED (
    SELECT part, place - 1 AS j, x
    FROM (SELECT part, x, row_number() OVER (PARTITION BY part ORDER BY vec_id, x) AS place FROM p)
    WHERE place <= 16)"""

#: One assignment of all parts, and the entries that follow from it.
_OP11_ASSIGN = """,
a{k} AS MATERIALIZED (
    SELECT r, part, any_value(p.x) AS x, min({{'d': CAST(list_sum(list_transform(list_zip(p.x, c.x),
           lambda t: (t[1] - t[2]) * (t[1] - t[2]))) AS BIGINT), 'j': c.j}}) AS best
    FROM p JOIN c{k} AS c USING (part) GROUP BY r, part)"""
_OP11_MOVE = """,
c{next} AS MATERIALIZED (
    SELECT part, j, coalesce(m.x, c.x) AS x
    FROM c{k} AS c LEFT JOIN (
        SELECT part, j, list(CAST(floor(total / n) AS BIGINT) ORDER BY i) AS x
        FROM (SELECT part, best.j AS j, i, sum(x[i]) AS total, count(*) AS n
              FROM (SELECT *, unnest(range(1, len(x) + 1)) AS i FROM a{k}) GROUP BY ALL)
        GROUP BY part, j) AS m USING (part, j))"""

#: Six rounds over all parts and entries, written out one after the other.
OP11 = (
    _OP11_START
    + "".join(_OP11_ASSIGN.format(k=k) + _OP11_MOVE.format(k=k, next=k + 1) for k in range(6))
    + _OP11_ASSIGN.format(k=6)
    + """,
codes AS (
    SELECT r, string_agg(lpad(to_hex(best.j), 2, '0'), '' ORDER BY part) AS code,
           CAST(sum(best.d) AS BIGINT) AS error FROM a6 GROUP BY r),
books AS (
    SELECT sha256(string_agg(CAST(value AS VARCHAR), ',' ORDER BY part, j, i)) AS codebooks_sha256
    FROM (SELECT part, j, unnest(x) AS value, unnest(range(len(x))) AS i FROM c6))
SELECT vec_id, lower(code) AS code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       codebooks_sha256
FROM v JOIN codes USING (r), books
"""
)

_RULES = ",\n".join(
    f"({r.no}, '{r.label}', {r.level}, '{r.keyword}', '{r.pattern}', {r.base}, {CONFIDENCE[r.level]})" for r in RULES
)

#: Every match is compared with every other one of its text.
OP12 = f"""
WITH rules(no, label, level, keyword, pattern, base, sure) AS (VALUES {_RULES}),
d AS MATERIALIZED (
    SELECT row_number() OVER () AS r, doc_id, len(w) AS n_words, ' ' || array_to_string(w, '  ') || ' ' AS s
    FROM (SELECT doc_id, {_WORDS} AS w FROM documents)),
m AS MATERIALIZED (
    SELECT r, rules.*, regexp_extract_all(s, pattern) AS found, string_split_regex(s, pattern) AS gaps
    FROM d JOIN rules ON contains(s, keyword)),
places AS (
    SELECT r, no, label, level, base, sure,
           list_sum(list_transform(gaps[1:k], lambda x: (len(x) - len(replace(x, ' ', ''))) // 2))
             + coalesce(list_sum(list_transform(found[1:k - 1], lambda x: (len(x) - len(replace(x, ' ', ''))) // 2)), 0)
             AS a,
           a + (len(found[k]) - len(replace(found[k], ' ', ''))) // 2 AS b
    FROM (SELECT *, unnest(range(1, len(found) + 1)) AS k FROM m WHERE len(found) > 0)),
kept AS (
    SELECT *, NOT EXISTS (
        SELECT 1 FROM places AS o
        WHERE o.r = p.r AND o.no <> p.no AND o.a <= p.a AND o.b >= p.b
          AND (o.level > p.level OR o.level = p.level AND (o.b - o.a > p.b - p.a OR o.no < p.no))) AS kept
    FROM places AS p),
by_text AS (
    SELECT r, count(*) FILTER (base) AS n_base, min(a) FILTER (base) AS first_word, max(a) FILTER (base) AS last_word,
           string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels,
           string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base OR kept) AS labels,
           max(sure) FILTER (kept) AS score
    FROM kept GROUP BY r)
SELECT doc_id, n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word,
       CAST(last_word AS BIGINT) AS last_word, coalesce(base_labels, '') AS base_labels,
       coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM d LEFT JOIN by_text USING (r)
"""

ORACLE_SQL = {
    "op1_decontamination": OP1,
    "op2_exact_dedup": OP2,
    "op6_near_dedup": OP6,
    "op9_warc": OP9,
    "op11_vector_codes": OP11,
    "op12_licenses": OP12,
}
