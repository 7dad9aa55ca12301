"""DuckDB counterparts of the pN_ queries that SQL can state exactly."""

from __future__ import annotations

import unicodedata

_COUNTING = """SELECT a_version_id a, b_version_id b FROM document_relations
WHERE a_version_id IS NOT NULL AND b_version_id IS NOT NULL AND a_version_id <> b_version_id AND coalesce(lower(trim(status)), '') <> 'dismissed'
AND replace(lower(trim(kind)), '-', '_') IN ('exact_dup', 'near_dup', 'contained_in', 'revision_of')"""

_GROUPS = f"""WITH RECURSIVE e AS ({_COUNTING}), n AS (SELECT a u, b v FROM e UNION SELECT b, a FROM e),
reach(u, v) AS (SELECT u, u FROM n UNION SELECT r.u, n.v FROM reach r JOIN n ON r.v = n.u)
SELECT u AS version_id, min(v) AS group_id FROM reach GROUP BY u"""

# all pairs by an inverted index of five-character runs
_ALIKE = r"""WITH v AS (SELECT DISTINCT version_id, document_id, regexp_replace(lower(markdown), '[^\p{L}\p{N}]', '', 'g') AS t FROM document_versions WHERE markdown IS NOT NULL),
s AS (SELECT version_id, document_id, unnest(list_distinct(list_transform(range(1, length(t) - 3), lambda i: substring(t, i, 5)))) AS g FROM v WHERE length(t) >= 200),
n AS (SELECT version_id, count(*) AS n FROM s GROUP BY ALL),
c AS (SELECT a.version_id AS x, b.version_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.version_id < b.version_id AND a.document_id <> b.document_id GROUP BY ALL)
SELECT x AS a_version_id, y AS b_version_id FROM c JOIN n p ON p.version_id = x JOIN n q ON q.version_id = y WHERE k >= 0.6 * (p.n + q.n - k)"""

_CLASSES = r"""WITH v AS (SELECT DISTINCT version_id, regexp_replace(lower(markdown), '[^\p{L}\p{N}]', '', 'g') AS t FROM document_versions WHERE markdown IS NOT NULL),
k AS (SELECT t, min(version_id) AS class_id, count(DISTINCT version_id) AS copies FROM v WHERE length(t) >= 200 GROUP BY t),
s AS (SELECT class_id, unnest(list_distinct(list_transform(range(1, length(t) - 3), lambda i: substring(t, i, 5)))) AS g FROM k),
n AS (SELECT class_id, count(*) AS n FROM s GROUP BY ALL),
c AS (SELECT a.class_id AS x, b.class_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.class_id <> b.class_id GROUP BY ALL),
l AS (SELECT x, count(*) AS links FROM c JOIN n p ON p.class_id = x JOIN n q ON q.class_id = y WHERE k >= 0.6 * (p.n + q.n - k) GROUP BY x)
SELECT version_id, k.class_id, copies, coalesce(links, 0) AS links FROM v JOIN k ON k.t = v.t LEFT JOIN l ON l.x = k.class_id"""

_NEAREST = """WITH e AS (SELECT DISTINCT ON (chunk_id) chunk_id, embedding::DOUBLE[] AS v FROM chunk_embeddings
 WHERE embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT a.chunk_id AS a, b.chunk_id AS b, list_cosine_similarity(a.v, b.v) AS s FROM e a JOIN e b ON a.chunk_id <> b.chunk_id),
r AS (SELECT a, b, s FROM p QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5)
SELECT DISTINCT least(a, b) AS a_chunk_id, greatest(a, b) AS b_chunk_id FROM r WHERE s >= 0.85"""

ORACLES: dict[str, str] = {
    "p1_found": _ALIKE,
    "p1_classes": _CLASSES,
    "p5_neighbours": _NEAREST.split("SELECT DISTINCT least")[0].replace("list_cosine_similarity(a.v, b.v) AS s", "round(list_cosine_similarity(a.v, b.v), 10) AS s") + "SELECT a AS chunk_id, b AS neighbour_id, row_number() OVER (PARTITION BY a ORDER BY s DESC, b)::INTEGER AS rank, round(s::FLOAT::DOUBLE, 5) AS cosine FROM r",
    "p5_found": _NEAREST,
    "p3_found": _GROUPS,
    "p3_group_sizes": f"SELECT members, count(*) AS groups FROM (SELECT group_id, count(*) AS members FROM ({_GROUPS}) GROUP BY group_id) GROUP BY members",
    "p6_found": r"""WITH s AS (SELECT section_id, text, coalesce(target_size, 700) t FROM markdown_sections WHERE length(text) > coalesce(target_size, 700)),
c AS (SELECT section_id,
 list_max(list_transform(string_split_regex(text, '(^|\n)[ \t\r\v\f\x{00A0}\x{3000}]*(\n[ \t\r\v\f\x{00A0}\x{3000}]*)*(\n|$)'), lambda x: length(trim(x, E' \t\r\n　 ')))) <= t AS p,
 list_max(list_transform(string_split(text, chr(10)), lambda x: length(trim(x, E' \t\r\n　 ')))) <= t AS l,
 list_max(list_transform(string_split(regexp_replace(regexp_replace(text, '([。！？!?])', '\1' || chr(10), 'g'), '\.([ \t\r\n\x{3000}\x{00A0}])', '.' || chr(10) || '\1', 'g'), chr(10)), lambda x: length(trim(x, E' \t\r\n　 ')))) <= t AS z
 FROM s)
SELECT section_id, CASE WHEN p THEN 'paragraph' WHEN l THEN 'line' WHEN z THEN 'sentence' ELSE 'none' END AS boundary FROM c""",
}


def _lookalike_sql() -> str:
    """(chunk_id, text, v) with the look-alike table spelled out: characters mapped one to one, ligatures replaced, marks composed."""
    from foliant.llm.lookalike import Mapper

    Mapper.load()
    swap = [(chr(o), chr(int(Mapper.one[o]))) for o in range(0x10000) if not Mapper.slow[o] and int(Mapper.one[o]) not in (0, o)]
    swap += [("\uff9e", "\u3099"), ("\uff9f", "\u309a")]
    drop = [chr(o) for o in range(1, 0x10000) if not Mapper.slow[o] and Mapper.one[o] == 0 and not 0xD800 <= o <= 0xDFFF]
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    start, end = quoted("".join(a for a, _ in swap) + "".join(drop)), quoted("".join(b for _, b in swap))
    text = "text"
    for o in (*range(0xFB00, 0xFB07), *range(0x3040, 0x3100), *range(0x3300, 0x3358), 0x337F, 0x2026, 0x2122):
        if Mapper.slow[o] and unicodedata.category(chr(o))[0] != "M":
            text = f"replace({text}, {quoted(chr(o))}, {quoted(Mapper.value(chr(o)))})"
    return f"WITH c AS (SELECT DISTINCT chunk_id, text FROM chunks WHERE text IS NOT NULL), v AS (SELECT chunk_id, text, nfc_normalize(translate({text}, {start}, {end})) AS v FROM c)"


_SAME = """
SELECT a.chunk_id AS a_chunk_id, b.chunk_id AS b_chunk_id FROM v a JOIN v b ON a.v = b.v AND a.text <> b.text AND a.chunk_id < b.chunk_id"""
_CANONICAL = """
SELECT DISTINCT chunk_id, sha256(c) AS canonical_sha, length(c) AS canonical_chars, c <> text AS changed FROM (SELECT chunk_id, text, min(text) OVER (PARTITION BY v) AS c FROM v)"""


def _leak_sql() -> str:
    """p8_found by all windows of a passage's length: case and width folded by table, words by pattern."""
    from foliant.llm.leaks import DROP, Chars

    t = Chars.load()
    swap = [(chr(o), chr(int(t.fold[o]))) for o in range(0x10000) if not t.slow[o] and t.kind[o] != DROP and int(t.fold[o]) != o]
    swap += [("\uff9e", "\u3099"), ("\uff9f", "\u309a")]
    drop = [chr(o) for o in range(1, 0x10000) if t.kind[o] == DROP and not t.slow[o]]
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    start, end = quoted("".join(a for a, _ in swap) + "".join(drop)), quoted("".join(b for _, b in swap))
    text = "text"
    for o in (0xDF, 0x1E9E, *range(0xFB00, 0xFB07)):
        text = f"replace({text}, {quoted(chr(o))}, {quoted(unicodedata.normalize('NFKC', chr(o)).casefold())})"
    fold = f"nfc_normalize(translate({text}, {start}, {end}))"
    wide = r"[\p{Han}\p{Hiragana}\p{Katakana}ー]"
    word = rf"{wide}+|[\p{{Latin}}\p{{Greek}}\p{{Cyrillic}}\p{{Hangul}}\p{{N}}]+"
    return rf"""WITH d AS (SELECT doc_id, {fold} AS f FROM documents), i AS (SELECT item_id, {fold} AS f FROM eval_items),
it AS (SELECT item_id, len(regexp_extract_all(f, '{wide}')) * 2 > len(regexp_extract_all(f, '[\p{{L}}\p{{N}}]')) AS wide, array_to_string(regexp_extract_all(f, '[\p{{L}}\p{{N}}]'), '') AS c, regexp_extract_all(f, '{word}') AS w FROM i),
iw AS (SELECT item_id, wide, CASE WHEN wide THEN length(c) ELSE len(w) END AS n, CASE WHEN wide THEN 20 ELSE 8 END AS k, unnest(range(1, CASE WHEN wide THEN length(c) - 18 ELSE len(w) - 6 END)) AS q, c, w FROM it),
ig AS (SELECT item_id, wide, n, k, q, CASE WHEN wide THEN substring(c, q, 20) ELSE array_to_string(list_slice(w, q, q + 7), ' ') END AS g FROM iw),
ds AS (SELECT doc_id, array_to_string(regexp_extract_all(f, '[\p{{L}}\p{{N}}]'), '') AS c, regexp_extract_all(f, '{word}') AS w FROM d),
dg AS (SELECT doc_id, true AS wide, unnest(list_transform(range(1, length(c) - 18), lambda p: substring(c, p, 20))) AS g FROM ds UNION ALL
 SELECT doc_id, false, unnest(list_transform(range(1, len(w) - 6), lambda p: array_to_string(list_slice(w, p, p + 7), ' '))) FROM ds),
m AS (SELECT DISTINCT doc_id, item_id, n, k, q FROM dg JOIN ig ON dg.wide = ig.wide AND dg.g = ig.g),
v AS (SELECT DISTINCT doc_id, item_id, n, unnest(range(q, q + k)) AS x FROM m)
SELECT doc_id, item_id FROM v GROUP BY doc_id, item_id, n HAVING count(*) * 2 >= n"""


def oracles() -> dict[str, str]:
    """All counterparts; two hold character tables that are built on demand."""
    return {**ORACLES, "p2_found": (values := _lookalike_sql()) + _SAME, "p2_canonical": values + _CANONICAL, "p8_found": _leak_sql()}
