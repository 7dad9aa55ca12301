"""DuckDB counterparts of the core queries."""

from __future__ import annotations

from foliant.functions.freshness import DAY, HALF_LIFE, REVIEW
from foliant.functions.segment import STOPWORDS
from foliant.functions.shingle import FNV_OFFSET, FNV_PRIME
from foliant.functions.text import MIME
from foliant.operators.contradiction import SIGNALS

NOW = 1_767_225_600_000

VERSIONS = "(SELECT DISTINCT ON (version_id) * FROM document_versions)"
CHUNKS = "(SELECT DISTINCT ON (chunk_id) * FROM chunks)"
RELATIONS = "(SELECT DISTINCT ON (relation_id) * FROM document_relations)"
_STOP = ", ".join(f"'{w}'" for w in STOPWORDS)


def _words(text: str) -> str:
    return rf"list_filter(regexp_extract_all(lower({text}), '[\p{{L}}\p{{N}}]+'), lambda w: w NOT IN ({_STOP}))"


def _shingles(words: str) -> str:
    return f"CASE WHEN len({words}) = 0 THEN [] WHEN len({words}) < 3 THEN [array_to_string({words}, ' ')] ELSE list_transform(range(1, len({words}) - 1), lambda i: array_to_string(list_slice({words}, i, i + 2), ' ')) END"


_SUPERSEDED = f"""SELECT DISTINCT CASE WHEN va.created_at < vb.created_at THEN va.document_id ELSE vb.document_id END AS document_id
FROM (SELECT DISTINCT a_version_id, b_version_id FROM document_relations WHERE status = 'open' AND kind IN ('near_dup', 'contained_in')) r
JOIN {VERSIONS} va ON va.version_id = r.a_version_id JOIN {VERSIONS} vb ON vb.version_id = r.b_version_id
WHERE va.document_id <> vb.document_id AND va.created_at <> vb.created_at"""

_half = " ".join(f"WHEN '{k}' THEN {'NULL' if v is None else v}" for k, v in HALF_LIFE.items())
_review = " ".join(f"WHEN '{k}' THEN {v}" for k, v in REVIEW.items())
_FRESH = f"""WITH s AS ({_SUPERSEDED}), x AS (
 SELECT d.document_id, d.doc_type, p.display_name AS owner_name, d.owner_person_id, v.conversion_confidence, s.document_id IS NOT NULL AS superseded,
  v.created_at + CASE d.doc_type {_review} END::BIGINT * {DAY} AS review_due_at, greatest(0, ({NOW} - v.created_at) // {DAY}) AS age_days
 FROM managed_documents d JOIN {VERSIONS} v ON v.version_id = d.current_version_id LEFT JOIN s ON s.document_id = d.document_id
 LEFT JOIN people p ON p.person_id = d.owner_person_id WHERE d.status <> 'archived'),
y AS (SELECT *, CASE WHEN {NOW} > review_due_at THEN greatest(0, ({NOW} - review_due_at) // {DAY}) END AS od FROM x),
z AS (SELECT *, CASE WHEN doc_type = 'minutes' THEN 100.0::DOUBLE ELSE 100.0::DOUBLE * pow(0.5::DOUBLE, age_days / (CASE coalesce(doc_type, 'other') {_half} ELSE {HALF_LIFE["other"]} END)::DOUBLE) END
  - CASE WHEN od IS NOT NULL THEN 30.0::DOUBLE * least(1.0::DOUBLE, od / 180.0::DOUBLE) ELSE 0 END - CASE WHEN owner_person_id IS NULL THEN 15 ELSE 0 END
  - CASE WHEN superseded THEN 20 ELSE 0 END - CASE WHEN conversion_confidence < 0.6 THEN 5 ELSE 0 END AS raw FROM y),
f AS (SELECT document_id, doc_type, owner_name, review_due_at, coalesce(od, 0)::BIGINT AS overdue_days, greatest(0.0::DOUBLE, least(100.0::DOUBLE, raw)) AS s FROM z),
fresh AS (SELECT document_id, doc_type, owner_name, review_due_at, overdue_days, round(s, 6) AS score, CASE WHEN s >= 80 THEN 'healthy' WHEN s >= 50 THEN 'review' ELSE 'action' END AS band FROM f)
"""

_mime = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in MIME.items())
_WS = r"[\s\x{3000}\x{00A0}\x{FEFF}]"


def _bm25(terms: list[str]) -> str:
    """Scores of all chunks that hold all terms."""
    f = lambda c, t: f"len(list_filter({c}, lambda w: w = '{t}'))"
    tf = [f"(5.0 * {f('t', t)} + 3.0 * {f('h', t)} + {f('b', t)})::DOUBLE AS f{i}" for i, t in enumerate(terms)]
    n = [f"(SELECT count(*) FROM w WHERE f{i} > 0) AS n{i}" for i in range(len(terms))]
    score = " + ".join(f"(CASE WHEN ln((N - n{i} + 0.5) / (n{i} + 0.5)) <= 0 THEN 1e-6 ELSE ln((N - n{i} + 0.5) / (n{i} + 0.5)) END) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * dl / avgdl))" for i in range(len(terms)))
    return f"""c AS (SELECT chunk_id, document_id, {_words("coalesce(title, '')")} AS t, {_words("coalesce(heading_path, '')")} AS h, {_words("coalesce(text, '')")} AS b FROM {CHUNKS}),
w AS (SELECT chunk_id, document_id, len(t) + len(h) + len(b) AS dl, {", ".join(tf)} FROM c),
s AS (SELECT (SELECT count(*) FROM w) AS N, (SELECT avg(dl) FROM w) AS avgdl, {", ".join(n)}),
hits AS (SELECT chunk_id, w.document_id, -({score}) AS score FROM w CROSS JOIN s JOIN managed_documents d ON d.document_id = w.document_id AND d.status <> 'archived' WHERE {" AND ".join(f"f{i} > 0" for i in range(len(terms)))}),
top AS (SELECT * FROM hits ORDER BY score, chunk_id LIMIT 30)"""


_HITS = _bm25(["supply", "review"])
_USABLE = "embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0"
_COSINE = f"""e AS (SELECT DISTINCT ON (chunk_id) chunk_id, document_id, embedding::DOUBLE[] AS v FROM chunk_embeddings WHERE {_USABLE}),
q AS (SELECT v AS qv FROM e WHERE len(list_filter(v, lambda x: x <> 0)) > 0 ORDER BY chunk_id LIMIT 1),
cs AS (SELECT chunk_id, CASE WHEN len(list_filter(v, lambda x: x <> 0)) = 0 THEN 0.0 ELSE list_cosine_similarity(v, qv) END AS score FROM e CROSS JOIN q JOIN managed_documents d ON d.document_id = e.document_id AND d.status <> 'archived')"""

_CURRENT = f"""cur AS (SELECT v.version_id, v.document_id, v.markdown FROM {VERSIONS} v JOIN managed_documents d ON d.document_id = v.document_id AND d.current_version_id = v.version_id
WHERE d.status <> 'archived' AND v.markdown IS NOT NULL AND v.markdown <> '')"""

_w = "OVER (PARTITION BY key ORDER BY line_no ROWS UNBOUNDED PRECEDING)"
_INK = r"[^\n\r\x{2028}\x{2029}]"
_HEADING, _NUMBERED, _SHEET = rf"^(#{{1,6}}){_WS}+({_INK}*)\z", rf"^<!--{_WS}*(?:page|slide):(\d+){_WS}*-->\z", rf"^<!--{_WS}*sheet:({_INK}+?){_WS}*-->\z"
_TRIM = rf"'^{_WS}+|{_WS}+\z', '', 'g'"
_LINES = rf"""v AS (SELECT version_id AS key, string_split(markdown, chr(10)) AS ls FROM {VERSIONS} WHERE markdown IS NOT NULL),
l AS (SELECT key, unnest(ls) AS text, unnest(range(0, len(ls)))::INTEGER AS line_no FROM v),
m AS (SELECT *, length(regexp_extract(text, '{_HEADING}', 1)) AS lv, regexp_replace(regexp_extract(text, '{_HEADING}', 2), {_TRIM}) AS nm, regexp_extract(text, '{_NUMBERED}', 1) AS pg, regexp_extract(text, '{_SHEET}', 1) AS sh FROM l),
h AS (SELECT *, {", ".join(f"last_value(CASE WHEN lv = {k} THEN nm END IGNORE NULLS) {_w} AS n{k}, coalesce(last_value(CASE WHEN lv = {k} THEN line_no END IGNORE NULLS) {_w}, -1) AS a{k}" for k in range(1, 7))},
 last_value(CASE WHEN pg <> '' THEN try_cast(pg AS INTEGER) END IGNORE NULLS) {_w} AS page, last_value(CASE WHEN sh <> '' THEN sh END IGNORE NULLS) {_w} AS sheet,
 count(*) FILTER (lv > 0) {_w} AS ta, last_value(CASE WHEN lv > 0 THEN nm END IGNORE NULLS) {_w} AS tn FROM m),
p AS (SELECT *, list_filter([{", ".join(f"CASE WHEN a{k} >= 0 AND a{k} >= greatest(-1, {', '.join(f'a{j}' for j in range(1, k)) or '-1'}) THEN n{k} END" for k in range(1, 7))}], lambda x: x IS NOT NULL) AS path,
 left(regexp_replace(regexp_replace(lower(tn), '[^\p{{L}}\p{{N}}]+', '-', 'g'), '^-+|-+$', '', 'g'), 40) AS slug FROM h),
lines AS (SELECT key, line_no, text, CASE WHEN len(path) > 0 THEN array_to_string(path, ' > ') END AS heading_path, CASE WHEN ta > 0 THEN 'h-' || ta || '-' || CASE WHEN slug = '' THEN 'section' ELSE slug END END AS heading_anchor, page, sheet FROM p WHERE pg = '' AND sh = '')"""

# one step for each sentence of a long line, each line of a document and each chunk
_CHUNKED = rf"""WITH RECURSIVE {_LINES},
sen AS (SELECT key, line_no, unnest(regexp_extract_all(text, '[^。]*。|[^。]+')) AS s, unnest(range(1, len(regexp_extract_all(text, '[^。]*。|[^。]+')) + 1)) AS k FROM lines WHERE length(text) > 700),
cut AS (SELECT key, line_no, k, unnest(list_transform(range(0, (length(s) - 1) // 700 + 1), lambda i: substring(s, i * 700 + 1, 700))) AS s, unnest(range(0, (length(s) - 1) // 700 + 1)) AS j, length(s) > 700 AS hard FROM sen),
un AS (SELECT *, row_number() OVER (PARTITION BY key, line_no ORDER BY k, j) AS n FROM cut),
pk AS (SELECT key, line_no, n, s, 1 AS part, CASE WHEN hard THEN 9999 ELSE length(s) END AS held FROM un WHERE n = 1 UNION ALL
 SELECT u.key, u.line_no, u.n, u.s, part + CASE WHEN u.hard OR held + length(u.s) > 700 THEN 1 ELSE 0 END, CASE WHEN u.hard THEN 9999 WHEN held + length(u.s) > 700 THEN length(u.s) ELSE held + length(u.s) END FROM pk JOIN un u ON u.key = pk.key AND u.line_no = pk.line_no AND u.n = pk.n + 1),
parts AS (SELECT key, line_no, 1 AS part, text AS t FROM lines WHERE length(text) <= 700 UNION ALL SELECT key, line_no, part, string_agg(s, '' ORDER BY n) FROM pk GROUP BY ALL),
num AS (SELECT x.key, t, heading_path, heading_anchor, page, sheet, row_number() OVER (PARTITION BY x.key ORDER BY x.line_no, part) AS i FROM parts x JOIN lines USING (key, line_no)),
wk AS (SELECT key, i, 1 AS c, length(t) + 1 AS size, heading_path AS hp FROM num WHERE i = 1 UNION ALL
 SELECT q.key, q.i, c + CASE WHEN size >= 700 OR q.heading_path IS DISTINCT FROM hp THEN 1 ELSE 0 END, length(q.t) + 1 + CASE WHEN size >= 700 OR q.heading_path IS DISTINCT FROM hp THEN 0 ELSE size END, q.heading_path FROM wk JOIN num q ON q.key = wk.key AND q.i = wk.i + 1),
bo AS (SELECT num.key, c, string_agg(t, chr(10) ORDER BY num.i) AS body, max(size) >= 700 AS is_full, first(heading_path ORDER BY num.i) FILTER (heading_path IS NOT NULL) AS heading_path, first(heading_anchor ORDER BY num.i) FILTER (heading_anchor IS NOT NULL) AS heading_anchor,
 min(page) AS page_from, max(page) AS page_to, first(sheet ORDER BY num.i) FILTER (sheet IS NOT NULL) AS sheet_name FROM wk JOIN num ON num.key = wk.key AND num.i = wk.i GROUP BY num.key, c),
tx AS (SELECT key, c, regexp_replace(body, {_TRIM}) AS text, is_full FROM bo WHERE c = 1 UNION ALL
 SELECT b.key, b.c, regexp_replace(CASE WHEN tx.is_full AND tx.text <> '' THEN right(tx.text, 100) || chr(10) || b.body ELSE b.body END, {_TRIM}), b.is_full FROM tx JOIN bo b ON b.key = tx.key AND b.c = tx.c + 1)
SELECT key AS version_id, (row_number() OVER (PARTITION BY key ORDER BY c) - 1)::INTEGER AS ordinal, heading_path, heading_anchor, page_from::VARCHAR AS page_from, page_to::VARCHAR AS page_to, sheet_name, length(text)::INTEGER AS chars FROM tx JOIN bo USING (key, c) WHERE text <> ''"""

_SIGNAL = " OR ".join(f"regexp_matches(text, '{s}')" for s in SIGNALS)
_CANDIDATES = f"""WITH c AS (SELECT chunk_id AS id, document_id, {_words("text")} AS w FROM {CHUNKS} JOIN managed_documents d USING (document_id) WHERE d.status <> 'archived' AND ({_SIGNAL})),
s AS (SELECT id, document_id, list_sort(list_distinct({_shingles("w")})) AS s FROM c WHERE len(w) > 0), o AS (SELECT min(id) AS id, s, list(DISTINCT document_id) AS owners FROM s GROUP BY s),
u AS (SELECT id, owners, len(s) AS n, unnest(s) AS g FROM o),
p AS (SELECT a.id AS a, b.id AS b, a.n + b.n AS t, count(*) AS k FROM u a JOIN u b ON a.g = b.g AND a.id < b.id AND NOT (len(a.owners) = 1 AND a.owners = b.owners) GROUP BY ALL)
SELECT a, b, round(k::DOUBLE / (t - k), 6) AS jaccard FROM p WHERE k::DOUBLE / (t - k) >= 0.12 ORDER BY k::DOUBLE / (t - k) DESC, a, b LIMIT 60"""

_CODES = "list_transform(flatten(list_transform(string_split(g, ''), lambda c: CASE WHEN unicode(c) < 65536 THEN [unicode(c)] ELSE [55296 + (unicode(c) - 65536) // 1024, 56320 + (unicode(c) - 65536) % 1024] END)), lambda u: u::HUGEINT)"
_FNV48 = f"list_reduce({_CODES}, lambda h, u: xor(h, u) * {FNV_PRIME} % {1 << 64}, {FNV_OFFSET}::HUGEINT) % {1 << 48}"
_HASHES = f"""{_CURRENT}, ww AS (SELECT version_id, document_id, markdown, {_words("markdown")} AS w FROM cur), sl AS (SELECT version_id, document_id, markdown, {_shingles("w")} AS l FROM ww),
ds AS (SELECT DISTINCT unnest(l) AS g FROM sl), fv AS (SELECT g, {_FNV48} AS h FROM ds), xs AS (SELECT version_id, unnest(l) AS g FROM sl),
bs AS (SELECT version_id, count(*) AS n, {", ".join(f"sum((h // {1 << i}) % 2) AS b{i}" for i in range(48))} FROM xs JOIN fv USING (g) GROUP BY version_id),
sh AS (SELECT sl.version_id, document_id, markdown, l, coalesce({" + ".join(f"CASE WHEN b{i} * 2 > n THEN {1 << i} ELSE 0 END" for i in range(48))}, 0)::BIGINT AS simhash FROM sl LEFT JOIN bs USING (version_id))"""
_NEAR = f"""WITH {_HASHES}, rp AS (SELECT min(version_id) AS v, CASE WHEN count(DISTINCT document_id) = 1 THEN min(document_id) END AS d, any_value(simhash) AS s, list_distinct(any_value(l)) AS l FROM sh GROUP BY markdown),
pr AS (SELECT a.v AS a, b.v AS b, bit_count(xor(a.s, b.s))::INTEGER AS hamming, len(list_intersect(a.l, b.l))::DOUBLE AS i, len(a.l) AS na, len(b.l) AS nb FROM rp a JOIN rp b ON a.v < b.v AND (a.d IS NULL OR b.d IS NULL OR a.d <> b.d) AND bit_count(xor(a.s, b.s)) <= 8),
sc AS (SELECT *, CASE WHEN least(na, nb) = 0 THEN 0 ELSE i / least(na, nb) END AS c, CASE WHEN na + nb = 0 THEN 0 ELSE i / (na + nb - i) END AS j FROM pr)
SELECT a, b, CASE WHEN c >= 0.85 THEN 'contained_in' ELSE 'near_dup' END AS kind, round(CASE WHEN c >= 0.85 THEN c ELSE j END, 6) AS score, hamming FROM sc"""
# the length of the longest common run of lines, row by row of the table
_COMMON = "list_reduce(x, lambda prev, a: list_reduce(range(1, len(y) + 1), lambda cells, j: list_append(cells, CASE WHEN a = y[j] THEN prev[j] + 1 ELSE greatest(prev[j + 1], cells[j]) END), [0::BIGINT]), list_transform(range(0, len(y) + 1), lambda i: 0::BIGINT))[-1]"
_DIFFS = rf"""WITH s AS (SELECT version_id, document_id, version_no, regexp_replace(regexp_replace(markdown, '(?m)^<!--\s*(page|sheet|slide):[^>]*-->\s*$', '', 'g'), '^{_WS}+|{_WS}+$', '', 'g') AS t FROM {VERSIONS}),
p AS (SELECT version_id, t AS new, lag(t) OVER w AS old, lag(version_id) OVER w AS before FROM s WINDOW w AS (PARTITION BY document_id ORDER BY version_no, version_id)),
l AS (SELECT version_id, CASE WHEN coalesce(old, '') = '' THEN [] ELSE string_split(old, chr(10)) END AS x, CASE WHEN coalesce(new, '') = '' THEN [] ELSE string_split(new, chr(10)) END AS y FROM p WHERE before IS NOT NULL)
SELECT version_id, len(y) - {_COMMON} AS added, len(x) - {_COMMON} AS removed FROM l"""
_FILTERED = f"""{_FRESH}
SELECT h.chunk_id, h.document_id, round(h.score, 6) AS score FROM (WITH {_bm25(["review"])} SELECT * FROM hits) h JOIN managed_documents m ON m.document_id = h.document_id JOIN {VERSIONS} v ON v.version_id = m.current_version_id JOIN people pp ON pp.person_id = m.owner_person_id
LEFT JOIN fresh fr ON fr.document_id = m.document_id WHERE m.doc_type <> 'slide' AND pp.department = 'Human Resources' AND v.conversion_engine = 'local:mammoth+turndown' AND m.updated_at >= 1600000000000 AND coalesce(fr.score, 0) <= 95 ORDER BY h.score, h.chunk_id LIMIT 30"""
_UNEMBEDDED = f"{CHUNKS} c JOIN managed_documents d ON d.document_id = c.document_id AND d.status <> 'archived' WHERE NOT EXISTS (SELECT 1 FROM chunk_embeddings e WHERE e.chunk_id = c.chunk_id AND e.embedding IS NOT NULL)"

ORACLES: dict[str, str] = {
    "annotated_lines": f"WITH {_LINES} SELECT * REPLACE (page::VARCHAR AS page) FROM lines",
    "markdown_chunks": _CHUNKED,
    "contradiction_candidates": _CANDIDATES,
    "list_documents": f"""SELECT d.document_id, d.title, d.doc_type, v.version_no, v.conversion_engine, v.conversion_confidence, coalesce(n.chunk_count, 0) AS chunk_count, d.created_at
FROM managed_documents d LEFT JOIN {VERSIONS} v ON v.version_id = d.current_version_id
LEFT JOIN (SELECT document_id, count(DISTINCT chunk_id) AS chunk_count FROM chunks GROUP BY document_id) n ON n.document_id = d.document_id WHERE d.status <> 'archived'""",
    "document_details": f"""SELECT d.document_id, p.display_name AS owner_name, v.original_filename,
CASE WHEN original_bytes < 1024 THEN original_bytes || ' B' WHEN original_bytes < 1048576 THEN ((original_bytes * 10 + 512) // 1024) // 10 || '.' || ((original_bytes * 10 + 512) // 1024) % 10 || ' KB' WHEN original_bytes IS NOT NULL THEN ((original_bytes * 10 + 524288) // 1048576) // 10 || '.' || ((original_bytes * 10 + 524288) // 1048576) % 10 || ' MB' END AS size,
CASE WHEN conversion_engine IS NULL THEN 'unconverted' WHEN conversion_confidence < 0.6 THEN 'check' WHEN starts_with(conversion_engine, 'local-llm:') THEN 'ai' ELSE 'local' END AS badge
FROM managed_documents d LEFT JOIN {VERSIONS} v ON v.version_id = d.current_version_id LEFT JOIN people p ON p.person_id = d.owner_person_id""",
    "versions_with_previous": f"""SELECT v.document_id, v.version_id, v.version_no, lag(v.version_id) OVER (PARTITION BY v.document_id ORDER BY v.version_no, v.version_id) AS previous_version_id,
coalesce(v.version_id = d.current_version_id, false) AS is_current FROM {VERSIONS} v LEFT JOIN managed_documents d ON d.document_id = v.document_id""",
    "stats_by_type": "SELECT doc_type, count(*) AS n FROM managed_documents WHERE status <> 'archived' GROUP BY doc_type",
    "stats_by_engine": f"SELECT v.conversion_engine, count(*) AS n FROM managed_documents d LEFT JOIN {VERSIONS} v ON v.version_id = d.current_version_id WHERE d.status <> 'archived' GROUP BY ALL",
    "governance_summary": f"""SELECT count(*) AS documents, count(*) FILTER (v.conversion_confidence < 0.6) AS low_confidence, count(*) FILTER (d.owner_person_id IS NULL) AS orphans,
count(*) FILTER (starts_with(v.conversion_engine, 'local-llm:')) AS ai_converted, (SELECT count(DISTINCT relation_id) FROM document_relations WHERE status = 'open') AS open_relations
FROM managed_documents d LEFT JOIN {VERSIONS} v ON v.version_id = d.current_version_id WHERE d.status <> 'archived'""",
    "open_relations": f"""SELECT r.relation_id, r.kind, r.score, da.title AS a_title, db.title AS b_title, r.detected_at FROM {RELATIONS} r
JOIN {VERSIONS} va ON va.version_id = r.a_version_id JOIN {VERSIONS} vb ON vb.version_id = r.b_version_id
JOIN managed_documents da ON da.document_id = va.document_id JOIN managed_documents db ON db.document_id = vb.document_id WHERE r.status = 'open'""",
    "superseded_documents": _SUPERSEDED,
    "freshness_scores": _FRESH + "SELECT * REPLACE (review_due_at::VARCHAR AS review_due_at) FROM fresh",
    "freshness_heatmap": _FRESH + "SELECT doc_type, count(*) FILTER (band = 'healthy') AS healthy, count(*) FILTER (band = 'review') AS review, count(*) FILTER (band = 'action') AS action FROM fresh GROUP BY doc_type",
    "due_soon": _FRESH + "SELECT document_id, review_due_at FROM fresh WHERE review_due_at IS NOT NULL ORDER BY review_due_at, document_id LIMIT 8",
    "overdue": _FRESH + "SELECT document_id, overdue_days FROM fresh WHERE overdue_days > 0",
    "finding_titles": f"""WITH e AS (SELECT relation_id, unnest([a_version_id, b_version_id]) AS version_id FROM {RELATIONS})
SELECT e.relation_id, array_to_string(list_sort(list(coalesce(d.title, e.version_id))), ' / ') AS titles FROM e LEFT JOIN {VERSIONS} v ON v.version_id = e.version_id
LEFT JOIN managed_documents d ON d.document_id = v.document_id WHERE e.version_id IS NOT NULL GROUP BY e.relation_id""",
    "visible_documents": """SELECT d.document_id, d.title, p.department FROM managed_documents d LEFT JOIN people p ON p.person_id = d.owner_person_id
WHERE d.status <> 'archived' AND d.doc_type IN ('manual', 'regulation') AND d.updated_at >= 1600000000000""",
    "category_tree": """WITH n AS (SELECT n.n_nationkey, n.n_name, n.n_regionkey, count(c.c_custkey) AS k FROM nation n LEFT JOIN customer c ON c.c_nationkey = n.n_nationkey GROUP BY ALL)
SELECT r.r_name AS root_name, coalesce(sum(k), 0)::BIGINT AS documents, coalesce(string_agg(n_name || ':' || k, ',' ORDER BY n_nationkey), '') AS children FROM region r LEFT JOIN n ON n.n_regionkey = r.r_regionkey GROUP BY r.r_regionkey, r.r_name""",
    "document_outlines": """SELECT d.document_id, d.title, d.doc_type, coalesce(array_to_string(list_slice(list_sort(h.l), 1, 5), ' | '), '') AS outline, coalesce(len(h.l), 0) AS headings FROM managed_documents d
LEFT JOIN (SELECT document_id, list(DISTINCT heading_path) AS l FROM chunks WHERE heading_path IS NOT NULL GROUP BY document_id) h ON h.document_id = d.document_id WHERE d.status <> 'archived' AND d.current_version_id IS NOT NULL""",
    "job_counts": "SELECT count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'error') AS error, count(*) FILTER (event_type = 'purchase') AS purchase, count(*) FILTER (event_type = 'signup') AS signup FROM events",
    "recent_jobs": "SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id LIMIT 50",
    "by_severity": "SELECT o_orderkey, o_orderpriority FROM orders ORDER BY CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 ELSE 2 END, o_orderdate DESC, o_orderkey LIMIT 100",
    "stream_event_counts": "SELECT event_type, count(*) AS n FROM events GROUP BY event_type",
    "hourly_events": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n FROM events GROUP BY ALL",
    "file_names": rf"""SELECT version_id, lower(regexp_extract(original_filename, '\.([^.]*)$', 1)) AS extension, CASE lower(regexp_extract(original_filename, '\.([^.]*)$', 1)) {_mime} END AS mime,
regexp_replace(original_filename, '\.[^.]+$', '') AS title, coalesce(lower(regexp_extract(original_filename, '\.([^.]*)$', 1)) IN ('docx', 'xlsx', 'pdf'), false) AS accepted FROM {VERSIONS}""",
    "ingest_new": """WITH g AS (SELECT sha256(text) AS h, count(*) AS k FROM documents GROUP BY 1), i AS (SELECT left(sha256('d' || h), 26) AS document_id, k FROM g)
SELECT document_id, 'new' AS outcome, 1::BIGINT AS n FROM i UNION ALL SELECT document_id, 'duplicate', k - 1 FROM i WHERE k > 1""",
    "next_version_numbers": "SELECT document_id, (coalesce(max(version_no), 0) + 1)::INTEGER AS next_version_no FROM document_versions GROUP BY document_id",
    "merged_relations": f"""SELECT relation_id, kind, CASE WHEN kind = 'near_dup' THEN 0.5 ELSE score END::DOUBLE AS score, status, CASE WHEN kind = 'near_dup' THEN {NOW} ELSE detected_at END AS detected_at
FROM {RELATIONS} WHERE a_version_id IS NOT NULL AND b_version_id IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY least(a_version_id, b_version_id), greatest(a_version_id, b_version_id), kind ORDER BY relation_id) = 1""",
    "markdown_bodies": rf"""SELECT version_id, sha256(regexp_replace(regexp_replace(markdown, '(?m)^<!--\s*(page|sheet|slide):[^>]*-->\s*$', '', 'g'), '^{_WS}+|{_WS}+$', '', 'g')) AS body_sha,
length(markdown) + len(regexp_extract_all(markdown, '[\x{{10000}}-\x{{10FFFF}}]')) AS units FROM {VERSIONS} WHERE markdown IS NOT NULL""",
    "quality_gate": rf"""WITH p AS (SELECT version_id, CASE WHEN page_texts IS NULL OR len(page_texts) = 0 THEN [''] ELSE list_transform(page_texts, lambda x: coalesce(x, '')) END AS p FROM conversion_results),
t AS (SELECT version_id, p, array_to_string(p, chr(10)) AS t FROM p),
m AS (SELECT version_id, t, len(p) AS n, length(t) + len(regexp_extract_all(t, '[\x{{10000}}-\x{{10FFFF}}]')) AS l, len(list_filter(p, lambda x: length(regexp_replace(x, '^{_WS}+|{_WS}+$', '', 'g')) < 20)) AS blank,
 len(regexp_extract_all(t, '\x{{FFFD}}|\(cid:\d+\)')) AS g, len(regexp_extract_all(t, '[\x{{3040}}-\x{{30FF}}\x{{3400}}-\x{{9FFF}}]')) AS c,
 list_filter(string_split(t, chr(10)), lambda x: length(regexp_replace(x, '{_WS}+', '', 'g')) > 0) AS ls FROM t),
r AS (SELECT version_id, l, l::DOUBLE / n AS cpp, blank::DOUBLE / n AS br, CASE WHEN l > 0 THEN g::DOUBLE / l ELSE 1.0 END AS gr, CASE WHEN l > 0 THEN c::DOUBLE / l ELSE 0.0 END AS cr,
 CASE WHEN len(ls) > 0 THEN len(list_filter(ls, lambda x: regexp_matches(x, '[^\s\x{{3000}}\x{{00A0}}\x{{FEFF}}]{_WS}{{3,}}[^\s\x{{3000}}\x{{00A0}}\x{{FEFF}}]')))::DOUBLE / len(ls) ELSE 0.0 END AS bt,
 l <= 3000 OR regexp_matches(t, '(?m)^#{{1,6}} ') AS st FROM m),
q AS (SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1.0::DOUBLE - (0.0::DOUBLE + CASE WHEN cpp < 200 THEN 0.3 ELSE 0 END::DOUBLE + CASE WHEN br > 0.3 THEN 0.25 ELSE 0 END::DOUBLE + CASE WHEN gr > 0.005 THEN 0.2 ELSE 0 END::DOUBLE
 + CASE WHEN cr < 0.1 THEN 0.1 ELSE 0 END::DOUBLE + CASE WHEN bt > 0.2 THEN 0.1 ELSE 0 END::DOUBLE + CASE WHEN NOT st THEN 0.05 ELSE 0 END::DOUBLE + CASE WHEN l < 100 THEN 0.3 ELSE 0 END::DOUBLE))) AS cf FROM r)
SELECT version_id, round(cf, 6) AS confidence, round(cpp, 6) AS chars_per_page, round(br, 6) AS blank_page_ratio, round(gr, 6) AS garbled_ratio, round(cr, 6) AS cjk_ratio, l AS text_length, cf < 0.6 AS fallback FROM q""",
    "token_statistics": f"SELECT chunk_id, len(w) AS n_words, len(list_distinct({_shingles('w')})) AS n_shingles FROM (SELECT chunk_id, {_words('text')} AS w FROM {CHUNKS})",
    "frequent_words": f"SELECT word, count(*) AS chunks FROM (SELECT unnest(list_distinct({_words('text')})) AS word FROM {CHUNKS}) GROUP BY word ORDER BY chunks DESC, word LIMIT 100",
    "bm25_search": f"WITH {_HITS} SELECT chunk_id, document_id, round(score, 6) AS score FROM top",
    "grouped_hits": f"""WITH {_HITS}, g AS (SELECT chunk_id, document_id, row_number() OVER (PARTITION BY document_id ORDER BY score, chunk_id)::INTEGER AS hit_no, min(score) OVER (PARTITION BY document_id) AS b, count(*) OVER (PARTITION BY document_id) AS k FROM top)
SELECT chunk_id, document_id, hit_no, round(b, 6) AS best_score, greatest(0, k - 2) AS extra_hits FROM g WHERE hit_no <= 2""",
    "cosine_topk": f"WITH {_COSINE} SELECT chunk_id, round(score, 6) AS score FROM cs ORDER BY cs.score DESC, chunk_id LIMIT 30",
    "rrf_fusion": f"""WITH {_HITS}, {_COSINE}, k AS (SELECT chunk_id, row_number() OVER (ORDER BY score, chunk_id) AS r FROM hits QUALIFY r <= 50), m AS (SELECT chunk_id, row_number() OVER (ORDER BY score DESC, chunk_id) AS r FROM cs QUALIFY r <= 50),
u AS (SELECT chunk_id, 'keyword' AS leg, r FROM k UNION ALL SELECT chunk_id, 'semantic', r FROM m),
f AS (SELECT chunk_id, sum(1.0::DOUBLE / (60 + r)) AS rrf, string_agg(leg, ',' ORDER BY leg) AS matched_by FROM u GROUP BY chunk_id)
SELECT f.chunk_id, round(rrf, 6) AS rrf, matched_by FROM f JOIN {CHUNKS} c ON c.chunk_id = f.chunk_id JOIN managed_documents d ON d.document_id = c.document_id AND d.status <> 'archived' ORDER BY f.rrf DESC, matched_by, f.chunk_id LIMIT 30""",
    "unembedded": f"SELECT c.chunk_id, c.document_id FROM {_UNEMBEDDED}",
    "backfilled": f"SELECT c.chunk_id, 64::BIGINT AS size FROM {_UNEMBEDDED}",
    "filtered_search": _FILTERED,
    "simhash_values": f"WITH {_HASHES} SELECT version_id, simhash FROM sh",
    "near_duplicates": _NEAR,
    "version_diffs": _DIFFS,
    "exact_classes": f"WITH {_CURRENT} SELECT version_id, min(version_id) OVER (PARTITION BY sha256(markdown)) AS first_version_id, count(*) OVER (PARTITION BY sha256(markdown)) AS copies FROM cur",
    "relation_likeness": f"""WITH s AS (SELECT version_id, list_distinct({_shingles("w")}) AS s FROM (SELECT version_id, {_words("markdown")} AS w FROM {VERSIONS} WHERE markdown IS NOT NULL)),
p AS (SELECT r.relation_id, len(list_intersect(a.s, b.s))::DOUBLE AS i, len(a.s) AS na, len(b.s) AS nb FROM {RELATIONS} r JOIN s a ON a.version_id = r.a_version_id JOIN s b ON b.version_id = r.b_version_id)
SELECT relation_id, round(CASE WHEN na + nb = 0 THEN 0 ELSE i / (na + nb - i) END, 6) AS jaccard, round(CASE WHEN least(na, nb) = 0 THEN 0 ELSE i / least(na, nb) END, 6) AS containment FROM p""",
}
