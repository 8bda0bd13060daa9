"""The registered queries in SQL, for the check against DuckDB."""

from __future__ import annotations

from ..functions import wire

SPACE = r"[ \t\n\r\f\x0B]"
TOKEN = rf"{SPACE}*[^ \t\n\r\f\x0B]+(?:{SPACE}+\z)?"

FILES = """files AS (
  SELECT CAST(d.doc_id AS VARCHAR) AS file_id, d.doc_id, 'doc_' || d.doc_id || '.txt' AS file_name,
    '/vol/' || d.source || '/doc_' || d.doc_id || '.txt' AS path, d.n_chars AS size, sha256(d.text) AS content_sha256,
    CASE d.doc_id % 5 WHEN 0 THEN 'Records' WHEN 1 THEN 'Performance Review' WHEN 2 THEN 'Code of Conduct'
      WHEN 3 THEN 'Leave and Time-Off Policy' ELSE 'Other' END AS category,
    DATE '2014-01-01' + CAST((d.doc_id * 37) % 4000 AS INTEGER) AS last_modified,
    CASE WHEN l.doc_id IS NOT NULL THEN list_filter([CASE l.quality WHEN 1 THEN 'GATED' ELSE 'ROT' END,
      CASE l.toxic WHEN 1 THEN 'CONFIDENTIAL' END], lambda x: x IS NOT NULL) END AS labels,
    d.source, d.lang, d.text
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""

DOCS = """docs AS (
  SELECT d.doc_id AS document_id, 'doc_' || d.doc_id || '.txt' AS title, d.text AS content,
    CASE d.doc_id % 5 WHEN 0 THEN 'Records' WHEN 1 THEN 'Performance Review' WHEN 2 THEN 'Code of Conduct'
      WHEN 3 THEN 'Leave and Time-Off Policy' ELSE 'Other' END AS category,
    ['user' || (d.doc_id % 150) || '@example.com'] AS entitled_emails, 'E' || (d.doc_id % 150) AS extracted_employee_id,
    CAST(DATE '2014-01-01' + CAST((d.doc_id * 37) % 4000 AS INTEGER) AS VARCHAR) AS created_at, d.source
  FROM documents d)"""

PRINCIPALS = """principals AS (
  SELECT 'user' || c_custkey || '@example.com' AS email, 'E' || c_custkey AS employee_id, c_custkey,
    CASE WHEN c_custkey % 10 = 0 THEN [lower(c_mktsegment), 'can_see_all_reviews'] ELSE [lower(c_mktsegment)] END AS groups
  FROM customer)"""

CHUNKS = f"""tok AS (
  SELECT doc_id AS document_id, text, regexp_extract_all(text, '{TOKEN}') AS w FROM documents),
starts AS (
  SELECT document_id, text, w, unnest(CASE WHEN len(w) <= 500 THEN [0] ELSE range(0, len(w), 450) END) AS s FROM tok),
chunks AS (
  SELECT document_id, CAST(s / 450 AS BIGINT) AS chunk_index,
    CASE WHEN len(w) <= 500 THEN text ELSE array_to_string(w[s + 1 : s + 500], '') END AS chunk FROM starts)"""

SUBMITTED = """submitted AS (
  SELECT CAST(doc_id // 100 AS VARCHAR) AS batch, doc_id, n_chars AS size_bytes, 1700000000 + doc_id AS modification_time,
    'job-' || (doc_id // 100) AS job_id,
    CASE WHEN doc_id % 2 = 0 THEN 'a/' ELSE 'b/' END || lang || '/doc_' || (doc_id // 2 * 2) || '.txt' AS relative_path
  FROM documents)"""

HITS = """hits AS (
  SELECT CAST(d.doc_id // 100 AS VARCHAR) AS batch, CAST(d.doc_id AS VARCHAR) AS hit_id, d.doc_id,
    CASE d.doc_id % 3
      WHEN 0 THEN CASE WHEN d.doc_id % 2 = 0 THEN 'a/' ELSE 'b/' END || lang || '/doc_' || (d.doc_id // 2 * 2) || '.txt'
      WHEN 1 THEN 'elsewhere/doc_' || (d.doc_id // 2 * 2) || '.txt'
      ELSE 'unknown/none_' || d.doc_id || '.txt' END AS file_key,
    'doc_' || (d.doc_id // 2 * 2) || '.txt' AS name, d.lang, d.source, d.n_chars, sha256(d.text) AS sha, l.toxic, l.quality
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
matched AS (
  SELECT h.*, f.relative_path, f.size_bytes, f.modification_time, f.job_id FROM hits h
  JOIN submitted f ON f.batch = h.batch AND f.relative_path = coalesce(
    (SELECT min(e.relative_path) FROM submitted e WHERE e.batch = h.batch AND e.relative_path = h.file_key),
    (SELECT min(n.relative_path) FROM submitted n
     WHERE n.batch = h.batch AND split_part(n.relative_path, '/', -1) = split_part(h.file_key, '/', -1))))"""

JOBS = """jobs AS (
  SELECT b AS batch, 'job-' || b AS job_id, CASE WHEN b % 3 = 2 THEN 'FAILED' ELSE 'FINISHED' END AS state,
    CASE WHEN b % 4 <> 1 THEN CAST(b AS VARCHAR) END AS scan_id
  FROM (SELECT DISTINCT doc_id // 100 AS b FROM documents))"""

CATALOG = """classes AS (
  SELECT CAST('0x' || left(md5(name), 8) AS BIGINT) AS pos,
    CASE WHEN name = 'ROT' THEN 'old-' ELSE 'L-' END || name AS id, name,
    CASE WHEN name LIKE 'A%' THEN 'annotator' ELSE 'label' END AS type,
    CASE WHEN name = 'GATED' THEN 'smart' END AS subtype,
    CASE WHEN name = 'CONFIDENTIAL' THEN 'Not for everyone' END AS description,
    CASE WHEN name <> 'ROT' THEN '2024-01-01' END AS created_at,
    CASE WHEN name = 'ROT' THEN '2024-02-01' END AS updated_at,
    CASE WHEN name <> 'GATED' THEN 'https://console.example.com/search?label=' || name END AS link
  FROM (SELECT DISTINCT unnest(labels) AS name FROM files UNION ALL SELECT r_name FROM region)),
tags AS (SELECT * FROM classes WHERE type = 'label'),
tagged AS (SELECT doc_id, source, source || ' v' || (doc_id % 7) AS ds_name, lang, unnest(labels) AS name FROM files),
pairs AS (
  SELECT t.pos AS label_pos, t.id AS label_id, t.name, f.source AS ds_id, arg_min(f.ds_name, f.doc_id) AS ds_name,
    arg_min(f.lang, f.doc_id) AS lang
  FROM tags t JOIN tagged f ON f.name = t.name GROUP BY ALL),
sources AS (
  SELECT ds_id AS id, arg_max(ds_name, label_pos) AS name, arg_max(lang, label_pos) AS connector_type,
    CAST(NULL AS VARCHAR) AS connector_name, 'c-' || ds_id AS connector_id
  FROM pairs GROUP BY ds_id)"""

VECTORS = """topics AS (
  SELECT label AS topic, list(x ORDER BY dim) AS embedding FROM (
    SELECT label, dim, avg(x) AS x FROM (
      SELECT label, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) AS dim FROM embeddings)
    GROUP BY label, dim) GROUP BY label)"""

ASKED = """asked AS (
  SELECT p.c_custkey AS request_id, p.c_custkey * 3 + q.pos AS query_id, q.pos AS query_pos, 'topic ' || t.topic AS query,
    t.embedding, p.email, p.employee_id, p.groups
  FROM principals p, (SELECT unnest([0, 1, 2]) AS pos) q, topics t
  WHERE t.topic = (p.c_custkey + q.pos) % (SELECT count(DISTINCT label) FROM embeddings))"""

VEC_CHUNKS = """vec_chunks AS (
  SELECT e.vec_id AS chunk_id, e.embedding, e.vec_id AS chunk_index, d.source AS title, d.category, d.entitled_emails, d.extracted_employee_id
  FROM embeddings e JOIN docs d ON d.document_id = e.vec_id % (SELECT count(*) FROM documents))"""

# Chunks of the texts; titles and places in the text are shared by several of them.
TEXT_CHUNKS = """vec_chunks AS (
  SELECT c.document_id * 100000 + c.chunk_index AS chunk_id, e.embedding, c.chunk_index, d.source || ' ' || (d.document_id % 20) AS title, d.category,
    d.entitled_emails, d.extracted_employee_id, c.chunk AS content
  FROM chunks c JOIN docs d ON d.document_id = c.document_id
  JOIN embeddings e ON e.vec_id = (c.document_id * 31 + c.chunk_index) % (SELECT count(*) FROM embeddings))"""

FUSED = """found AS (
  SELECT * FROM (
    SELECT query_id, request_id, query_pos, query, chunk_id, chunk_index, title, category, similarity,
      row_number() OVER (PARTITION BY query_id ORDER BY round(similarity, 9) DESC, chunk_id) AS rank
    FROM (
      SELECT a.query_id, a.request_id, a.query_pos, a.query, c.chunk_id, c.chunk_index, c.title, c.category,
        list_cosine_similarity(CAST(c.embedding AS DOUBLE[]), a.embedding) AS similarity
      FROM asked a, vec_chunks c
      WHERE list_contains(c.entitled_emails, a.email)
        OR (c.category = 'Performance Review'
            AND (c.extracted_employee_id = a.employee_id OR list_contains(a.groups, 'can_see_all_reviews')))
        OR c.category IN ('Code of Conduct', 'Leave and Time-Off Policy'))
    WHERE round(similarity, 9) > 0.2)
  WHERE rank <= 10),
fused AS (
  SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY round(score, 9) DESC, first_seen) AS position FROM (
    SELECT request_id, title, arg_min(chunk_id, query_pos * 1000 + rank) AS chunk_id, arg_min(category, query_pos * 1000 + rank) AS category,
      sum(1.0 / rank) AS score, min(query_pos * 1000 + rank) AS first_seen, string_agg(query, ',' ORDER BY query_pos, rank) AS queries
    FROM found GROUP BY request_id, title, chunk_index)
  QUALIFY position <= 15)"""

REQUESTS = f"{ASKED},\n{VEC_CHUNKS},\n{FUSED}"

MAIL = """sound AS (
  SELECT l_orderkey AS message_id, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
    'line_' || l_linenumber || '_' || l_partkey || '.txt' AS filename, l_returnflag AS name, l_linestatus
  FROM lineitem),
first_bad AS (
  SELECT message_id, arg_min(filename, (l_linenumber, l_partkey, l_suppkey, l_extendedprice)) AS filename
  FROM {rows} WHERE name = 'R' GROUP BY message_id)"""

MEMBER = """(list_contains(entitled_emails, 'user7@example.com')
  OR (category = 'Performance Review' AND extracted_employee_id = 'E7')
  OR category IN ('Code of Conduct', 'Leave and Time-Off Policy'))"""

GRANTS = """grants AS (
  SELECT 'email' AS "grant", unnest(list_distinct(entitled_emails)) AS grantee, document_id FROM docs
  UNION ALL SELECT 'employee', extracted_employee_id, document_id FROM docs
    WHERE category = 'Performance Review' AND extracted_employee_id <> ''
  UNION ALL SELECT 'group', 'can_see_all_reviews', document_id FROM docs WHERE category = 'Performance Review'
  UNION ALL SELECT 'public', '*', document_id FROM docs WHERE category IN ('Code of Conduct', 'Leave and Time-Off Policy'))"""


def slug(x: str) -> str:
    return f"left(coalesce(nullif(trim(regexp_replace(lower({x}), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'unnamed'), 90)"


def pad(x: str) -> str:
    return f"rpad({x}, CAST(greatest(3, length({x})) AS INTEGER), 'x')"


def ref(name: str, ident: str) -> str:
    suffix = f"('-' || CASE WHEN length({ident}) > 33 THEN left(sha1({ident}), 8) ELSE {ident} END)"
    base = f"coalesce(nullif(trim(left({slug(name)}, 36 - length({suffix})), '-'), ''), 'c')"
    return pad(f"({base} || {suffix})")


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


STATE = """events_last AS (
  SELECT user_id AS doc_id, arg_max(event_type, (ts, event_id)) AS state, arg_max(value, (ts, event_id)) AS value
  FROM events GROUP BY user_id),
label_states AS (SELECT doc_id, 'q' || quality AS state, CAST(toxic AS DOUBLE) AS value FROM labels)"""
MERGED = with_(STATE) + """SELECT doc_id, state, value FROM label_states WHERE doc_id NOT IN (SELECT doc_id FROM events_last)
UNION ALL SELECT doc_id, state, value FROM events_last"""

METADATA = with_(SUBMITTED, HITS, JOBS) + """SELECT '/vol/' || relative_path AS file_path, relative_path, size_bytes AS file_size, modification_time,
  'ds-1' AS datasource_id, CAST(m.batch AS BIGINT) AS datasource_scan_id, m.job_id, name AS file_name, hit_id AS object_id,
  sha AS sha256, lang AS doc_language, CAST(NULL AS VARCHAR) AS folder_id,
  toxic AS is_processed, CAST(NULL AS INTEGER) AS ocr_used,
  CASE WHEN quality IS NULL THEN '' ELSE 'checked,' || lang END AS tags, source AS categories, CAST(0 AS BIGINT) AS n_removed,
  n_chars AS stats_size, '2024-01-01 00:00:00' AS collected_at
FROM matched m JOIN jobs j ON j.scan_id = m.batch
QUALIFY row_number() OVER (PARTITION BY relative_path, m.batch ORDER BY hit_id DESC) = 1"""

ROUTED = with_(FILES) + """SELECT file_id, target, CASE WHEN target IS NULL THEN 'stay' ELSE 'copy' END AS action, category AS written_category
FROM (SELECT *, CASE WHEN list_contains(labels, 'CONFIDENTIAL') THEN 'quarantine'
  WHEN list_contains(labels, 'GATED') THEN 'allowed' END AS target FROM files WHERE labels IS NOT NULL)"""

SEARCH = """SELECT query_id, chunk_id, round(similarity, 6) AS similarity, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(similarity, 9) DESC, chunk_id) AS rank FROM (
    SELECT q.vec_id AS query_id, e.vec_id AS chunk_id,
      list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS similarity
    FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0)
  WHERE round(similarity, 9) > 0.2) WHERE rank <= 10"""

LINEAGE = """lineage AS (
  SELECT 'dxr_process' AS type_name, 'dxrproc://acme/' || s.id || '->' || t.id AS qualified_name,
    'DXR processing: ' || s.name || ' -> ' || t.name AS name,
    concat_ws(chr(10), coalesce(t.description, 'DXR processing that derived label ''' || t.name || ''' from datasource '''
      || s.name || ''' (id ' || s.id || ').'), 'Label type: ' || t.type, 'Label subtype: ' || t.subtype,
      'Created at: ' || t.created_at, 'Updated at: ' || t.updated_at, 'DXR Search: ' || t.link) AS description,
    t.type AS label_type, t.subtype AS label_subtype, t.created_at, t.updated_at, t.link AS search_link,
    s.id AS datasource_id, s.name AS datasource_name, s.connector_type, s.connector_id, s.connector_name,
    'dxrds://acme/' || s.id AS input_qn, 'dxrtag://acme/' || t.id AS output_qn
  FROM pairs p JOIN tags t ON t.id = p.label_id JOIN sources s ON s.id = p.ds_id)"""

EXISTING = """existing AS (
  SELECT 'unstructured_dataset' AS type_name, 'dxrtag://acme/' || id AS qualified_name, 'old ' || id AS name, 'acme' AS tenant
  FROM (SELECT id FROM classes UNION ALL SELECT n_name FROM nation))"""

INGEST = CHUNKS + """,
titled AS (
  SELECT doc_id AS document_id, split_part(text, chr(10), 1) AS title FROM documents WHERE trim(text) <> ''),
counted AS (SELECT document_id, count(*) AS n_chunks FROM chunks GROUP BY document_id)"""

GAP = "list_contains(labels, 'CONFIDENTIAL') AND NOT list_contains(labels, 'GATED')"

ORACLE: dict[str, str] = {
    "ndjson_round_trip": with_(FILES)
    + "SELECT file_id, size, coalesce(array_to_string(labels, ','), '') AS labels FROM files",
    "typed_ndjson": with_(FILES) + "SELECT file_id, CASE WHEN doc_id % 7 <> 0 THEN size END AS size FROM files",
    "listed_files": with_(FILES) + "SELECT source, CAST(sum(length(file_id) + 1) AS BIGINT) AS bytes FROM files GROUP BY source",
    "schema_contract": """SELECT n_rows, "column", expected, found FROM (SELECT count(*) AS n_rows FROM documents),
(VALUES ('file_size', 'bigint', 'int'), ('relative_path', 'string', NULL), ('categories', 'array<string>', NULL)) t("column", expected, found)""",
    "snapshot_job": with_(FILES) + "SELECT file_id, file_name, path, size, '2024-03-01' AS ingestion_date FROM files",
    "streamed_sync": "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY user_id",
    "inferred_table_sql": with_(FILES)
    + "SELECT source, count(*) AS n_files, CAST(sum(size) AS BIGINT) AS bytes FROM files GROUP BY source",
    "adhoc_listing": with_(FILES) + "SELECT file_id, path, size FROM files ORDER BY file_id LIMIT 100",
    "file_record_projection": with_(FILES)
    + """SELECT file_id, file_name, path, size, lang AS mime_type, CAST(NULL AS VARCHAR) AS created_at,
  CAST(last_modified AS VARCHAR) AS last_modified_at, content_sha256, CAST(NULL AS BIGINT) AS scan_depth,
  source AS datasource_id, coalesce(len(labels), -1) AS n_labels, lang AS owner FROM files""",
    "snapshot_days": with_(FILES)
    + """SELECT file_id, size, '2024-03-01' AS ingestion_date FROM files
UNION ALL SELECT file_id, size + 1, '2024-03-02' FROM files""",
    "keyed_merge": MERGED,
    "keyed_table_upsert": MERGED,
    "full_refresh_tables": with_(DOCS, CHUNKS)
    + """SELECT d.document_id, d.category, count(*) AS n_chunks FROM docs d JOIN chunks c ON c.document_id = d.document_id
GROUP BY d.document_id, d.category""",
    "exported_policy": with_(FILES) + "SELECT file_id, path, size FROM files WHERE list_contains(labels, 'ROT')",
    "label_mirror": with_(FILES) + "SELECT unnest(labels) AS label, file_id, size, true AS few_files FROM files",
    "scan_hits": "SELECT CAST(doc_id AS VARCHAR) AS hit_id, n_chars AS score FROM documents WHERE doc_id // 100 = 1",
    "datasource_documents": """SELECT doc_id, source AS datasource_id, n_chars FROM documents WHERE source IN ('src1', 'src3')""",
    "typed_values": """SELECT p_partkey, try_cast(split_part(p_brand, '#', 2) AS BIGINT) AS brand_number,
  try_cast(p_name AS BIGINT) AS name_number, CASE WHEN p_size % 3 <> 0 THEN p_type END AS type_text,
  CASE p_size % 5 WHEN 0 THEN 1 WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 3 THEN 0 END AS flag, p_name AS first_name,
  replace(p_name, ' ', '|') AS words, CAST(2 AS BIGINT) AS n_ints FROM part""",
    "object_keys": """SELECT 'intake' AS bucket, 'in box/' || url AS object_key, split_part(url, '/', -1) AS file_name,
  length(html) AS size FROM pages""",
    "slugs_and_refs": f"""SELECT page_id, {slug("url")} AS slug, {pad(f"left({slug('url')}, 36)")} AS normalized,
  {ref("url", "CAST(page_id AS VARCHAR)")} AS short_ref, {ref("url", "url")} AS long_ref,
  {ref("'  '", "CAST(page_id AS VARCHAR)")} AS blank_ref, 'unstructured-datasets-' || page_id AS group_ref,
  CASE WHEN length(url || url) + 1 < 36 THEN left('unstructured-datasets', 35 - length(url || url))
    ELSE 'unstructured-datasets' END || '-' || url || url AS long_group_ref FROM pages""",
    "qualified_names": with_(FILES)
    + """SELECT doc_id, 'dxrtag://' || lang || '/' || doc_id AS tag, 'dxrds://' || lang || '/' || source AS datasource,
  'dxrproc://' || lang || '/' || source || '->' || doc_id AS process,
  CASE WHEN doc_id % 3 > 0 THEN 'https://console.example.com/f/' || doc_id END AS link,
  lang AS parsed_tenant, source AS parsed_id FROM files""",
    "entitled_emails": "SELECT event_id, 'user' || user_id || '@example.com' AS emails FROM events",
    "extracted_attributes": "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events",
    "document_titles": """SELECT doc_id,
  CASE lang WHEN 'en' THEN 'doc_' || doc_id WHEN 'de' THEN 'Untitled Document' ELSE 'on ' || source END AS title,
  md5(left(text, 300)) AS preview_md5 FROM documents WHERE lang <> 'es'""",
    "token_counts": f"""SELECT doc_id, len(w) AS n_tokens,
  md5(CASE WHEN len(w) <= 100 THEN text ELSE array_to_string(w[1:100], '') END) AS cut_md5
FROM (SELECT doc_id, text, regexp_extract_all(text, '{TOKEN}') AS w FROM documents)""",
    "principal_groups": with_(PRINCIPALS)
    + "SELECT email, employee_id, array_to_string(groups, ',') AS groups FROM principals",
    "visible_documents": with_(DOCS)
    + f"SELECT document_id, title, category, extracted_employee_id, created_at FROM docs WHERE {MEMBER}",
    "visible_documents_reader": with_(DOCS)
    + """SELECT document_id, category FROM docs WHERE list_contains(entitled_emails, 'user20@example.com')
  OR category IN ('Performance Review', 'Code of Conduct', 'Leave and Time-Off Policy')""",
    "newest_documents": with_(DOCS)
    + f"""SELECT document_id, title, created_at, md5(left(content, 300)) AS preview_md5 FROM docs WHERE {MEMBER}
ORDER BY created_at DESC, document_id LIMIT 20""",
    "visible_chunks": with_(DOCS, CHUNKS)
    + f"""SELECT document_id, CAST(chunk_index AS INTEGER) AS chunk_index FROM chunks
WHERE document_id IN (SELECT document_id FROM docs WHERE {MEMBER})""",
    "access_grants": with_(DOCS, GRANTS) + """SELECT "grant", grantee, document_id FROM grants""",
    "entitlement_pairs": with_(DOCS, PRINCIPALS)
    + """SELECT DISTINCT p.email, d.document_id FROM docs d JOIN principals p ON list_contains(d.entitled_emails, p.email)
  OR (d.category = 'Performance Review' AND d.extracted_employee_id = p.employee_id)""",
    "visible_counts": with_(DOCS, PRINCIPALS)
    + """SELECT p.email, count(*) AS n_visible FROM principals p JOIN docs d ON list_contains(d.entitled_emails, p.email)
  OR (d.category = 'Performance Review'
      AND (d.extracted_employee_id = p.employee_id OR list_contains(p.groups, 'can_see_all_reviews')))
  OR d.category IN ('Code of Conduct', 'Leave and Time-Off Policy') GROUP BY p.email""",
    "document_totals": with_(DOCS, CHUNKS)
    + f"""SELECT 'all' AS scope, (SELECT count(*) FROM docs) AS documents, (SELECT count(*) FROM chunks) AS chunks
UNION ALL SELECT 'member', (SELECT count(*) FROM docs WHERE {MEMBER}),
  (SELECT count(*) FROM chunks WHERE document_id IN (SELECT document_id FROM docs WHERE {MEMBER}))""",
    "category_counts": with_(DOCS) + "SELECT category, count(*) AS n_documents FROM docs GROUP BY category",
    "known_requests": with_(PRINCIPALS)
    + """SELECT p_partkey, email, employee_id FROM part JOIN principals ON email = 'user' || p_partkey || '@example.com'""",
    "unknown_requests": with_(PRINCIPALS)
    + """SELECT p_partkey, 'user' || p_partkey || '@example.com' AS email FROM part
WHERE 'user' || p_partkey || '@example.com' NOT IN (SELECT email FROM principals)""",
    "label_tests": with_(FILES)
    + f"""SELECT file_id, CAST(coalesce(list_has_any(labels, ['ROT', 'CONFIDENTIAL']), false) AS INTEGER) AS any_label,
  CAST({GAP} AS INTEGER) AS gap FROM files""",
    "duplicate_groups": with_(FILES)
    + """SELECT content_sha256, count(*) AS n_files, CAST(sum(size) AS BIGINT) AS total_bytes, min(file_id) AS keep_id
FROM files GROUP BY content_sha256 HAVING count(*) > 1""",
    "duplicates_to_archive": with_(FILES)
    + """SELECT * FROM (SELECT file_id, path, content_sha256, min(file_id) OVER (PARTITION BY content_sha256) AS keep_id FROM files)
WHERE file_id <> keep_id""",
    "remediation_plan": with_(FILES)
    + f"""SELECT path AS source_path, '/archive/' || content_sha256 || '/' || file_name AS archive_path,
  '{wire.STUB_TEXT}' AS stub_text
FROM (SELECT *, min(file_id) OVER (PARTITION BY content_sha256) AS keep_id FROM files) WHERE file_id <> keep_id""",
    "retention_gaps": with_(FILES)
    + """SELECT file_id, CAST(last_modified AS VARCHAR) AS last_modified FROM files
WHERE category = 'Records' AND last_modified < DATE '2024-01-01' - INTERVAL 7 YEAR""",
    "rot_files": with_(FILES) + "SELECT file_id, size FROM files WHERE list_contains(labels, 'ROT')",
    "routed_files": ROUTED,
    "streamed_routing": ROUTED,
    "rule_count": with_(FILES)
    + f"SELECT count(*) AS value, CAST(count(*) = 0 AS INTEGER) AS passed FROM files WHERE {GAP}",
    "quality_scorecard": with_(FILES)
    + f"""SELECT 'labels are there' AS rule, 'Passed' AS outcome, CAST(NULL AS BIGINT) AS value
UNION ALL SELECT 'owners are there', 'Failed', NULL
UNION ALL SELECT 'confidential is gated', CASE WHEN count(*) = 0 THEN 'Passed' ELSE 'Failed' END, count(*) FROM files WHERE {GAP}
UNION ALL SELECT 'no empty file', CASE WHEN count(*) = 0 THEN 'Passed' ELSE 'Failed' END, count(*) FROM files WHERE size = 0
UNION ALL SELECT 'owner known', 'Failed', NULL
UNION ALL SELECT 'some labelled', CASE WHEN count(*) > 10 THEN 'Passed' ELSE 'Failed' END, count(*) FROM files
  WHERE labels IS NOT NULL""",
    "dictionary_hits": """SELECT d.doc_id, 'annotator-' || (b.item_id % 5) AS annotator, b.text AS keyword
FROM documents d JOIN benchmark b ON contains(lower(d.text), lower(b.text))""",
    "small_dictionary_hits": """SELECT d.doc_id, 'codes' AS annotator, upper(c.lang) AS keyword
FROM documents d JOIN (SELECT DISTINCT lang FROM documents) c ON contains(lower(d.text), c.lang)""",
    "labels_from_rules": """SELECT doc_id, string_agg(label, ',' ORDER BY label) AS labels FROM (
  SELECT DISTINCT d.doc_id, unnest(['Found by annotator-' || (b.item_id % 5), 'Leaked']) AS label
  FROM documents d JOIN benchmark b ON contains(lower(d.text), lower(b.text))) GROUP BY doc_id""",
    "matched_hits": with_(SUBMITTED, HITS) + "SELECT hit_id, batch, relative_path, size_bytes FROM matched",
    "collected_results": with_(JOBS)
    + """SELECT j.job_id, j.state, j.scan_id, CAST(d.doc_id AS VARCHAR) AS hit_id
FROM documents d JOIN jobs j ON j.scan_id = CAST(d.doc_id // 100 AS VARCHAR)""",
    "rejected_jobs": with_(JOBS)
    + """SELECT job_id, CASE WHEN scan_id IS NULL THEN 'no scan id' ELSE 'not finished, hits collected anyway' END AS reason
FROM jobs WHERE scan_id IS NULL OR state <> 'FINISHED'""",
    "volume_metadata": METADATA,
    "volume_table": METADATA,
    "batch_plan": with_(FILES).replace("WITH ", "WITH RECURSIVE ", 1).rstrip()
    + """,
ordered AS (SELECT path, size, row_number() OVER (ORDER BY path) AS rn FROM files),
packed AS (
  SELECT rn, path, size, size AS used, 1 AS n, CAST(0 AS BIGINT) AS batch FROM ordered WHERE rn = 1
  UNION ALL
  SELECT o.rn, o.path, o.size,
    CASE WHEN p.used + o.size > 200000 OR p.n >= 25 THEN o.size ELSE p.used + o.size END,
    CASE WHEN p.used + o.size > 200000 OR p.n >= 25 THEN 1 ELSE p.n + 1 END,
    CASE WHEN p.used + o.size > 200000 OR p.n >= 25 THEN p.batch + 1 ELSE p.batch END
  FROM packed p JOIN ordered o ON o.rn = p.rn + 1)
SELECT path, size, batch FROM packed""",
    "large_batch_plan": with_(FILES).replace("WITH ", "WITH RECURSIVE ", 1).rstrip()
    + """,
ordered AS (SELECT path, size, row_number() OVER (ORDER BY path) AS rn FROM files),
packed AS (
  SELECT rn, path, size, size AS used, 1 AS n, CAST(0 AS BIGINT) AS batch FROM ordered WHERE rn = 1
  UNION ALL
  SELECT o.rn, o.path, o.size,
    CASE WHEN p.used + o.size > 500000 OR p.n >= 1000000 THEN o.size ELSE p.used + o.size END,
    CASE WHEN p.used + o.size > 500000 OR p.n >= 1000000 THEN 1 ELSE p.n + 1 END,
    CASE WHEN p.used + o.size > 500000 OR p.n >= 1000000 THEN p.batch + 1 ELSE p.batch END
  FROM packed p JOIN ordered o ON o.rn = p.rn + 1)
SELECT path, size, batch FROM packed""",
    "selected_labels": with_(FILES, CATALOG) + "SELECT id, name, type FROM tags",
    "label_datasources": with_(FILES, CATALOG)
    + "SELECT label_id, ds_id, ds_name, 'c-' || ds_id AS connector_id FROM pairs",
    "unique_datasources": with_(FILES, CATALOG) + "SELECT * FROM sources",
    "hit_counts": with_(FILES)
    + """SELECT source AS datasource_id, label, count(*) AS document_count
FROM (SELECT source, unnest(labels) AS label FROM files) GROUP BY source, label""",
    "collection_members": with_(FILES, CATALOG)
    + f"""SELECT collection_ref, id, count(*) OVER (PARTITION BY collection_ref) AS collection_size
FROM (SELECT {ref("name", "id")} AS collection_ref, id FROM sources)""",
    "label_entities": with_(FILES, CATALOG)
    + """SELECT 'unstructured_dataset' AS type_name, 'dxrtag://acme/' || id AS qualified_name, name, description, id AS label_id,
  type AS label_type, coalesce(subtype, '') AS label_subtype, created_at, updated_at, link AS search_link, 'acme' AS tenant
FROM tags""",
    "datasource_entities": with_(FILES, CATALOG)
    + """SELECT 'unstructured_datasource' AS type_name, 'dxrds://acme/' || id AS qualified_name, name, id AS datasource_id,
  connector_type, 'acme' AS tenant FROM sources""",
    "has_edges": with_(FILES, CATALOG)
    + """SELECT 'unstructured_datasource_has_unstructured_dataset' AS relation, 'dxrds://acme/' || ds_id AS datasource_qn,
  'dxrtag://acme/' || label_id AS label_qn, (SELECT count(*) FROM tagged t WHERE t.name = pairs.name AND t.source = pairs.ds_id) AS document_count,
  '2024-06-01' AS stats_updated_at FROM pairs""",
    "lineage_rows": with_(FILES, CATALOG, LINEAGE) + "SELECT * FROM lineage",
    "entity_lookup": with_(FILES, CATALOG, EXISTING)
    + "SELECT qualified_name, name FROM existing WHERE qualified_name IN (SELECT 'dxrtag://acme/' || id FROM tags)",
    "entity_search": with_(FILES, CATALOG, EXISTING) + "SELECT qualified_name FROM existing",
    "stale_entities": with_(FILES, CATALOG, EXISTING)
    + "SELECT qualified_name FROM existing WHERE qualified_name NOT IN (SELECT 'dxrtag://acme/' || id FROM tags)",
    "catalog_cycle": with_(FILES, CATALOG, LINEAGE)
    + """SELECT 'dxrtag://acme/' || id AS qualified_name, 'unstructured_dataset' AS type_name, name, 'updated' AS change FROM tags
UNION ALL SELECT 'dxrds://acme/' || id, 'unstructured_datasource', name, 'created' FROM sources
UNION ALL SELECT qualified_name, type_name, name, 'created' FROM lineage
UNION ALL SELECT 'dxrds://acme/' || ds_id || ' dxrtag://acme/' || label_id,
  'unstructured_datasource_has_unstructured_dataset', NULL, 'created' FROM pairs""",
    "incremental_cycle": """SELECT 2 AS cycle, CAST(doc_id AS VARCHAR) AS qualified_name,
  CASE WHEN doc_id % 11 = 0 THEN 'deleted' WHEN doc_id % 13 = 0 THEN 'updated' ELSE 'untouched' END AS change FROM documents
UNION ALL SELECT 2, 'new ' || doc_id, 'created' FROM documents WHERE doc_id % 17 = 0""",
    "embedded_loads": with_(CHUNKS, CHUNKS.replace("tok AS", "tok2 AS").replace("starts AS", "starts2 AS").replace("chunks AS", "chunks2 AS").replace("FROM tok)", "FROM tok2)").replace("FROM starts)", "FROM starts2)")
                            .replace("FROM documents", "FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN text || ' edited' ELSE text END AS text FROM documents)"))
    + """SELECT 1 AS load, count(*) AS n_chunks, count(DISTINCT chunk) AS embedded, CAST(0 AS BIGINT) AS dropped FROM chunks
UNION ALL SELECT 2, (SELECT count(*) FROM chunks2), (SELECT count(*) FROM (SELECT chunk FROM chunks2 EXCEPT SELECT chunk FROM chunks)),
  (SELECT count(*) FROM (SELECT chunk FROM chunks EXCEPT SELECT chunk FROM chunks2))""",
    "entity_upsert": """SELECT coalesce(doc_id, vec_id) AS qualified_name,
  CASE WHEN vec_id IS NULL THEN quality ELSE label END AS quality, toxic,
  CASE WHEN vec_id IS NULL THEN 'kept' WHEN doc_id IS NULL THEN 'created' ELSE 'updated' END AS change
FROM labels FULL JOIN embeddings ON doc_id = vec_id""",
    "merged_schema": """SELECT doc_id, quality, CAST(NULL AS INTEGER) AS toxic FROM labels
UNION ALL SELECT doc_id, NULL, toxic FROM labels""",
    "edge_upsert": """SELECT CAST(coalesce(doc_id, vec_id) AS VARCHAR) AS qualified_name,
  CAST(CASE WHEN vec_id IS NULL THEN quality ELSE label END AS VARCHAR) AS n, CAST(toxic AS VARCHAR) AS toxic,
  CASE WHEN vec_id IS NULL THEN 'a' ELSE 'a,b' END AS inputs, CAST(coalesce(doc_id, vec_id) AS VARCHAR) AS outputs
FROM labels FULL JOIN embeddings ON doc_id = vec_id""",
    "united_label_files": with_(FILES) + "SELECT file_id, unnest(labels) AS label FROM files",
    "text_chunks": with_(CHUNKS) + "SELECT document_id, chunk_index, md5(chunk) AS chunk_md5 FROM chunks",
    "character_chunks": """SELECT document_id, CAST(s // 900 AS BIGINT) AS chunk_index, md5(CASE WHEN length(text) <= 1000 THEN text ELSE substring(text, s + 1, 1000) END) AS chunk_md5
FROM (SELECT doc_id AS document_id, text, unnest(CASE WHEN length(text) <= 1000 THEN [0] ELSE range(0, length(text), 900) END) AS s FROM documents)""",
    "mail_attachments": """SELECT CAST(doc_id AS VARCHAR) AS message_id, CAST(0 AS BIGINT) AS pos, source || '.txt' AS filename, md5(source) AS content_md5 FROM documents
UNION ALL SELECT CAST(doc_id AS VARCHAR), 1, 'doc_' || doc_id || '.txt', md5(text) FROM documents WHERE text <> ''""",
    "embedded_chunks": with_(CHUNKS)
    + rf"""SELECT document_id, chunk_index, md5(array_to_string(list_transform(n, lambda x: CAST(round(CAST(CAST(CASE WHEN size > 0 THEN x / size ELSE 0 END AS FLOAT) AS DOUBLE) * 1000000) AS BIGINT)), ',')) AS vector_md5
FROM (SELECT *, sqrt(list_sum(list_transform(n, lambda x: x * x))) AS size FROM (
  SELECT document_id, chunk_index, list_transform(range(0, 64), lambda i: CAST(len(list_filter(p, lambda x: x = i)) AS DOUBLE)) AS n FROM (
    SELECT document_id, chunk_index, list_transform(list_filter(regexp_split_to_array(lower(chunk), '{SPACE}+'), lambda w: w <> ''),
      lambda w: CAST('0x' || md5(w)[1:2] AS INTEGER) % 64) AS p FROM chunks)))""",
    "chunk_documents": with_(DOCS, CHUNKS)
    + """SELECT c.document_id, c.chunk_index, length(c.chunk) AS n_chars, d.title, d.category
FROM chunks c JOIN docs d ON d.document_id = c.document_id""",
    "ingest_counts": with_(INGEST)
    + """SELECT t.document_id, CASE WHEN length(title) > 255 THEN -1 ELSE length(title) END AS title_length,
  CASE WHEN length(title) > 255 THEN 0 ELSE n_chunks END AS n_chunks
FROM titled t JOIN counted c ON c.document_id = t.document_id""",
    "ingest_metrics": with_(INGEST)
    + """SELECT count(*) FILTER (length(title) <= 255) AS documents_processed,
  CAST(sum(n_chunks) FILTER (length(title) <= 255) AS BIGINT) AS chunks_created,
  count(*) FILTER (length(title) > 255) AS n_errors,
  (SELECT md5(coalesce(string_agg('Failed to process document ' || title || ': title longer than 255', chr(10)
     ORDER BY document_id), '')) FROM (SELECT * FROM titled WHERE length(title) > 255 ORDER BY document_id LIMIT 5)) AS first_errors
FROM titled t JOIN counted c ON c.document_id = t.document_id""",
    "vector_search": SEARCH,
    "probed_vector_search": f"SELECT count(DISTINCT query_id) AS n_queries, count(*) AS n_true, true AS similarities_right, true AS recalled, true AS few_scored FROM ({SEARCH})",
    "secured_indexed_search": with_(DOCS, PRINCIPALS, VECTORS, REQUESTS)
    + "SELECT query_id, chunk_id, round(similarity, 6) AS similarity, rank FROM found",
    "indexed_vector_search": SEARCH,
    "vector_search_secured": with_(DOCS, PRINCIPALS, VECTORS, REQUESTS)
    + "SELECT query_id, chunk_id, round(similarity, 6) AS similarity, rank FROM found",
    "rank_fusion": with_(DOCS, PRINCIPALS, VECTORS, REQUESTS)
    + "SELECT request_id, chunk_id, position, round(score, 6) AS score, queries FROM fused",
    "secured_retrieval": with_(DOCS, PRINCIPALS, VECTORS, REQUESTS)
    + """SELECT request_id, row_number() OVER (PARTITION BY request_id ORDER BY position) AS number, title, chunk_id,
  round(score, 6) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY request_id, title ORDER BY position) AS of_title FROM fused)
WHERE of_title <= 3""",
    "indexed_retrieval": with_(DOCS, PRINCIPALS, VECTORS, REQUESTS)
    + """SELECT request_id, row_number() OVER (PARTITION BY request_id ORDER BY position) AS number, title, chunk_id,
  round(score, 6) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY request_id, title ORDER BY position) AS of_title FROM fused)
WHERE of_title <= 3""",
    "context_texts": with_(DOCS, PRINCIPALS, VECTORS, CHUNKS, ASKED, TEXT_CHUNKS, FUSED)
    + """, numbered AS (
  SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY position) AS number
  FROM (SELECT *, row_number() OVER (PARTITION BY request_id, title ORDER BY position) AS of_title FROM fused)
  WHERE of_title <= 3),
texts AS (
  SELECT n.request_id, string_agg('Document ' || n.number || ' (from ' || n.title || ', category: ' || n.category
      || ') (relevance: ' || printf('%.3f', n.score) || '):' || chr(10) || '   Matched queries: '
      || replace(n.queries, ',', ', ') || chr(10) || c.content || chr(10),
    chr(10) || '---' || chr(10) ORDER BY n.number) AS context
  FROM numbered n JOIN vec_chunks c ON c.chunk_id = n.chunk_id GROUP BY n.request_id)
SELECT r.request_id, md5(coalesce(t.context, 'No relevant documents found for this query.')) AS context_md5
FROM (SELECT DISTINCT request_id FROM asked) r LEFT JOIN texts t ON t.request_id = r.request_id""",
    "recent_turns": """SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS turn_number
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations) WHERE back <= 3""",
    "first_blocked_labels": with_(MAIL.format(rows="sound"))
    + "SELECT message_id, filename, 'R' AS name, 'Returned goods found' AS message FROM first_bad",
    "mail_verdicts": with_(MAIL.format(rows="(SELECT * FROM sound WHERE l_linestatus <> 'F')"))
    + f""", parts AS (
  SELECT message_id, count(*) AS n, max(CAST(l_linestatus = 'F' AS INTEGER)) AS failed FROM sound GROUP BY message_id)
SELECT o_orderkey AS message_id, CAST(left(reply, 3) AS INTEGER) AS code, reply, n_attachments, classification_error FROM (
  SELECT o_orderkey, coalesce(p.n, 0) AS n_attachments, coalesce(p.failed, 0) AS classification_error,
    CASE WHEN o_orderpriority = '5-LOW' THEN '{wire.MAIL_ERROR}' WHEN o_orderstatus = 'P' THEN '{wire.MAIL_SYNTAX}'
      WHEN b.filename IS NOT NULL THEN '550 Blocked - Returned goods found in ' || b.filename
      ELSE '{wire.MAIL_ACCEPTED}' END AS reply
  FROM orders LEFT JOIN parts p ON p.message_id = o_orderkey LEFT JOIN first_bad b ON b.message_id = o_orderkey)""",
    "late_mail_verdicts": with_(MAIL.format(rows="(SELECT * FROM sound WHERE l_linestatus <> 'F')"))
    + f""", parts AS (
  SELECT message_id, count(*) AS n, max(CAST(l_linestatus = 'F' AS INTEGER)) AS failed FROM sound GROUP BY message_id)
SELECT o_orderkey AS message_id, CAST(left(reply, 3) AS INTEGER) AS code, reply, n_attachments, classification_error FROM (
  SELECT o_orderkey, coalesce(p.n, 0) AS n_attachments, coalesce(p.failed, 0) AS classification_error,
    CASE WHEN o_orderpriority = '5-LOW' THEN '{wire.MAIL_ERROR}' WHEN o_orderstatus = 'P' THEN '{wire.MAIL_SYNTAX}'
      WHEN b.filename IS NOT NULL THEN '550 Blocked - Returned goods found in ' || b.filename
      ELSE '{wire.MAIL_ACCEPTED}' END AS reply
  FROM orders LEFT JOIN parts p ON p.message_id = o_orderkey LEFT JOIN first_bad b ON b.message_id = o_orderkey)""",
}
