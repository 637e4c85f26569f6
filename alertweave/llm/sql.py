"""DuckDB statements of the queries whose results SQL can express."""

SQL: dict[str, str] = {}

#: Words of the contract's class, and of lower-cased letters, digits and code points above 127.
_WORDS = "[^\\x20\\x09-\\x0D]+"
_LETTERS = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"

SQL["op9_decontamination"] = rf"""
WITH lower_docs AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_LETTERS}') AS w
    FROM documents),
lower_items AS (
    SELECT CAST(item_id AS VARCHAR) AS item_id,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_LETTERS}') AS w
    FROM benchmark),
item_windows AS (
    SELECT item_id, least(10, len(w)) AS k, unnest([w[i:i + least(10, len(w)) - 1] FOR i IN range(1, len(w) - least(10, len(w)) + 2)]) AS g
    FROM lower_items WHERE len(w) > 0),
lengths AS (SELECT DISTINCT k FROM item_windows),
doc_windows AS (
    SELECT doc_id, k, unnest(range(1, len(w) - k + 2)) AS place, unnest([w[i:i + k - 1] FOR i IN range(1, len(w) - k + 2)]) AS g
    FROM lower_docs, lengths WHERE len(w) >= k),
met AS (SELECT DISTINCT doc_id, place, k, item_id FROM doc_windows JOIN item_windows USING (k, g)),
hit AS (SELECT doc_id, count(DISTINCT spot) AS n_hit FROM (SELECT doc_id, unnest(range(place, place + k)) AS spot FROM met) GROUP BY doc_id),
listed AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM met) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM lower_docs LEFT JOIN hit USING (doc_id) LEFT JOIN listed USING (doc_id)
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL["op3_minhash_neardup"] = rf"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all({_LOWER}, '{_WORDS}') AS w FROM documents),
shingles AS (
    SELECT doc_id, list_distinct([w[i:i + least(5, len(w)) - 1] FOR i IN range(1, len(w) - least(5, len(w)) + 2)]) AS s
    FROM words WHERE len(w) > 0),
flat AS (SELECT doc_id, unnest(s) AS g FROM shingles),
sizes AS (SELECT doc_id, len(s) AS n FROM shingles),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM flat a JOIN flat b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
    SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT a, b FROM both_ways UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON reach.b = both_ways.a)
SELECT d.doc_id, coalesce(any_value(n), 0) AS n_shingles, least(d.doc_id, coalesce(min(reach.b), d.doc_id)) AS component_id,
       d.doc_id <= coalesce(min(reach.b), d.doc_id) AS kept
FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN reach ON reach.a = d.doc_id
GROUP BY d.doc_id
"""

_TRIM = "trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"

SQL["op4_line_dedup"] = rf"""
WITH lines AS (
    SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS place FROM documents),
named AS (SELECT *, {_TRIM} AS bare FROM lines),
spread AS (
    SELECT bare, min(row(doc_id, place)) AS earliest FROM named WHERE bare <> '' GROUP BY bare HAVING count(DISTINCT coalesce(source, chr(0))) >= 10),
judged AS (SELECT n.*, spread.bare IS NOT NULL AND row(doc_id, place) <> earliest AS gone FROM named n LEFT JOIN spread USING (bare)),
joined AS (
    SELECT doc_id, count(*) FILTER (WHERE bare <> '') AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
           coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT gone), '') AS text
    FROM judged GROUP BY doc_id)
SELECT doc_id, n_lines, n_removed, CAST(length(text) AS BIGINT) AS n_chars, sha256(text) AS text_sha256 FROM joined
"""

SQL["op8_warc"] = """
WITH payloads AS (
    SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
placed AS (
    SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS earliest FROM payloads)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = earliest THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> earliest THEN earliest END AS refers_to
FROM placed
"""

SQL["op11_source_divergence"] = rf"""
WITH docs AS (
    SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
           regexp_extract_all({_LOWER}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
    FROM documents),
groups AS (SELECT DISTINCT lang, source FROM docs),
words AS (SELECT doc, lang, source, unnest(w) AS term FROM docs),
kept AS (SELECT lang, term FROM words GROUP BY lang, term HAVING count(DISTINCT doc) >= 3),
sizes AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
counted AS (SELECT lang, source, term, count(*) AS c FROM words SEMI JOIN kept USING (lang, term) GROUP BY ALL),
totals AS (SELECT lang, source, coalesce(sum(c), 0) AS n FROM groups LEFT JOIN counted USING (lang, source) GROUP BY ALL),
shares AS (
    SELECT lang, source, term, coalesce(c, 0) AS c, 1 + (1000000000::HUGEINT * (coalesce(c, 0) + 1)) // (n + v) AS p
    FROM totals JOIN sizes USING (lang) JOIN kept USING (lang) LEFT JOIN counted USING (lang, source, term)),
whole AS (
    SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(c) + 1)) // ((SELECT sum(n) FROM totals t WHERE t.lang = shares.lang) + (SELECT v FROM sizes s WHERE s.lang = shares.lang)) AS q
    FROM shares GROUP BY lang, term),
summed AS (
    SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
    FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
    FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN summed s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (
    SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // q AS value FROM shares JOIN whole USING (lang, term) WHERE c > 0 AND p > q),
ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
    FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""


def _clustering_rounds(rounds: int) -> str:
    """Statements of the centroids after each round, one after the other."""
    steps = []
    for r in range(rounds):
        steps.append(f"""
a{r} AS MATERIALIZED (
    SELECT vec_id, v, c.cluster FROM kept, c{r} c
    QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY list_sum(list_transform(list_zip(v, w), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), c.cluster) = 1),
m{r} AS (SELECT cluster, unnest(v) AS x, unnest(range(64)) AS place FROM a{r}),
s{r} AS (SELECT cluster, place, sum(x) AS total, count(*) AS n FROM m{r} GROUP BY ALL),
w{r} AS (
    SELECT cluster, list(CAST((total - ((total % n) + n) % n) // n AS BIGINT) ORDER BY place) AS w FROM s{r} GROUP BY cluster),
c{r + 1} AS MATERIALIZED (SELECT cluster, coalesce(w{r}.w, c{r}.w) AS w FROM c{r} LEFT JOIN w{r} USING (cluster))""")
    return ",".join(steps)


SQL["op13_centroid_clustering"] = f"""
WITH kept AS MATERIALIZED (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64),
c0 AS MATERIALIZED (
    SELECT CAST(row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS INTEGER) AS cluster, v AS w FROM kept ORDER BY sha256('3:' || vec_id) LIMIT 8),
{_clustering_rounds(10).strip()},
final AS MATERIALIZED (
    SELECT vec_id, cluster, list_sum(list_transform(list_zip(v, w), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS distance, w FROM kept, c10
    QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY distance, cluster) = 1)
SELECT vec_id, cluster, CAST(distance AS BIGINT) AS distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
       CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(w, ',')) AS centroid_sha256
FROM final
"""
