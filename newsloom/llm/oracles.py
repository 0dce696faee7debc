"""SQL (DuckDB) for the operators that SQL can express."""

from __future__ import annotations

from . import snapshots

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SMALL = f"translate({{0}}, '{_UPPER}', '{_LOWER}')"


def _words(text: str) -> str:
    return rf"list_filter(string_split_regex(coalesce({text}, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"


REPEATS = f"""
WITH d AS (SELECT doc_id, {_words("text")} AS w FROM documents),
windows AS (SELECT doc_id, unnest(range(1, len(w) - 18)) AS p, w FROM d WHERE len(w) >= 20),
keyed AS (SELECT doc_id, p, md5(array_to_string(list_slice(w, p, p + 19), ' ')) AS k FROM windows),
again AS (SELECT doc_id, p FROM keyed QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, p) > 1),
gone AS (SELECT doc_id, list(DISTINCT p + i) AS g FROM again, range(0, 20) r(i) GROUP BY doc_id),
kept AS (SELECT d.doc_id, w, CASE WHEN g IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(g, i)) END AS k FROM d LEFT JOIN gone USING (doc_id))
SELECT doc_id, len(w) AS n_words, len(w) - len(k) AS n_removed, sha256(array_to_string(k, ' ')) AS kept_sha256 FROM kept
"""

JACCARD = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_words(_SMALL.format("text"))} AS w FROM documents),
places AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS p FROM d WHERE len(w) > 0),
g AS (SELECT DISTINCT doc_id, md5_number_lower(array_to_string(list_slice(w, p, p + 2), ' ')) AS gram FROM places),
own AS (SELECT doc_id, count(*) AS n, md5(string_agg(gram, ',' ORDER BY gram)) AS whole FROM g GROUP BY doc_id),
n AS (SELECT doc_id, coalesce(n, 0) AS n FROM d LEFT JOIN own USING (doc_id)),
classes AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY whole) AS rep FROM own),
reps AS (SELECT g.* FROM g WHERE doc_id IN (SELECT rep FROM classes)),
both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM reps a JOIN reps b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM both_ JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 90 * (x.n + y.n - shared)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(node, seen) AS (SELECT a, a FROM edges UNION SELECT e.b, r.seen FROM reach r JOIN edges e ON e.a = r.node),
parts AS (SELECT node, min(seen) AS part FROM reach GROUP BY node)
SELECT n.doc_id, n.n AS n_shingles, coalesce(parts.part, rep, n.doc_id) AS component_id FROM n LEFT JOIN classes USING (doc_id) LEFT JOIN parts ON parts.node = rep
"""

ARCHIVE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
m AS (SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS payload_digest, max(page_id) OVER (PARTITION BY h) AS last FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
 CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN last END AS refers_to FROM m
"""

_TERMS = rf"regexp_extract_all({_SMALL.format('coalesce(text, chr(32))')}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATION = f"""
WITH b AS (SELECT item_id, {_TERMS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS size, array_to_string(list_slice(w, p, p + least(10, len(w)) - 1), ' ') AS k
 FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS p FROM b WHERE len(w) > 0)),
d AS (SELECT doc_id, {_TERMS} AS w FROM documents),
dw AS (SELECT doc_id, p, size, array_to_string(list_slice(w, p, p + size - 1), ' ') AS k
 FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS p FROM d, (SELECT DISTINCT size FROM bw) WHERE len(w) >= size)),
hits AS (SELECT DISTINCT doc_id, p, size, item_id FROM dw JOIN bw USING (size, k)),
cover AS (SELECT doc_id, count(DISTINCT p + i) AS n_hit FROM (SELECT doc_id, p, unnest(range(0, size)) AS i FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT CAST(item_id AS VARCHAR))), ',') AS names FROM hits GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cover USING (doc_id) LEFT JOIN items USING (doc_id)
"""

SQL = {
    "op3_seed_extend": REPEATS,
    "op4_parity_sketch": JACCARD,
    "op5_warc_archive": ARCHIVE,
    "op7_snapshot_collapse": snapshots.render_sql(),
    "op10_decontaminate": DECONTAMINATION,
}
