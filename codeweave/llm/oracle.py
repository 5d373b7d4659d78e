"""Independent SQL for the operators whose whole results SQL can state: exact line counts, containment,
cosine, Dice and Jaccard, and components by recursion.

Sharding (a hash that SQL lacks), token files and packing (tokenizers), the classifier and the language
model (training) have none; tests hold them against brute force, round trips and held-out data.
"""

from __future__ import annotations

from codeweave.llm.license_scan import TEMPLATES, _bigrams

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

LINE_DEDUP = f"""
WITH lines AS (
  SELECT doc_id, u.pos, u.line, translate(trim(u.line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{_UPPER}', '{_LOWER}') AS k
  FROM (SELECT doc_id, unnest(list_transform(string_split(coalesce(text, ''), chr(10)), lambda l, i: {{'pos': i, 'line': l}})) AS u FROM documents)
), common AS (
  SELECT k FROM lines WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10
), marked AS (
  SELECT l.doc_id, l.pos, l.line, c.k IS NOT NULL AS gone FROM lines l LEFT JOIN common c ON l.k = c.k
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def _shingles(name: str, table: str, key: str) -> str:
    """CTE ``name`` (id, g): the distinct five-word shingles of a table's texts, or their whole short word sequence."""
    return f"""{name}_w AS (
  SELECT {key} AS id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM {table}
), {name} AS (
  SELECT DISTINCT id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM {name}_w WHERE len(w) > 0)
)"""


DECONTAMINATE = f"""
WITH {_shingles('d', 'documents', 'doc_id')}, {_shingles('b', 'benchmark', 'item_id')},
n AS (SELECT id, count(*) AS n FROM b GROUP BY id)
SELECT d.id AS doc_id, b.id AS item_id, n.n AS item_shingles, count(*) AS shared, count(*) / n.n AS containment
FROM d JOIN b USING (g) JOIN n ON n.id = b.id GROUP BY d.id, b.id, n.n HAVING 10 * count(*) >= 8 * n.n
"""

EMBEDDING_DEDUP = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
    AND list_bool_or(list_transform(embedding, lambda x: x <> 0))
), link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), reach(a, b) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b
)
SELECT vec_id, n_links, component_id, vec_id = component_id AS kept FROM (
  SELECT e.vec_id, (SELECT count(*) FROM link WHERE a = e.vec_id) AS n_links, (SELECT min(b) FROM reach WHERE a = e.vec_id) AS component_id FROM embeddings e)
"""

_GRAMS = ", ".join(f"('{name}', '{gram}', {n})" for name, text in TEMPLATES.items() for gram, n in _bigrams(text).items())

LICENSE_SCAN = f"""
WITH t(license, gram, n) AS (VALUES {_GRAMS}), size AS (SELECT license, sum(n) AS n_template FROM t GROUP BY license),
unit AS (
  SELECT doc_id, CASE WHEN pos < 0 THEN 'document' ELSE 'line' END AS unit, CASE WHEN pos >= 0 THEN pos END AS line,
         row_number() OVER () AS uid, string_split(trim(regexp_replace(lower(u), '[^a-z0-9]+', ' ', 'g')), ' ') AS w
  FROM (SELECT doc_id, unnest(s) AS u, CAST(unnest(range(len(s))) AS INTEGER) AS pos FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents)
        UNION ALL SELECT doc_id, text, -1 FROM documents WHERE contains(text, chr(10)))
), gram AS (
  SELECT uid, gram, count(*) AS n FROM (SELECT uid, w[i] || ' ' || w[i + 1] AS gram FROM (SELECT uid, w, unnest(range(1, len(w))) AS i FROM unit WHERE len(w) > 1)) GROUP BY ALL
), score AS (
  SELECT uid, license, 2.0 * sum(least(gram.n, t.n))::DOUBLE / (any_value(len(unit.w)) - 1 + any_value(n_template))::DOUBLE AS dice
  FROM gram JOIN t USING (gram) JOIN size USING (license) JOIN unit USING (uid) GROUP BY uid, license
)
SELECT doc_id, unit, line, license, dice FROM unit JOIN (
  SELECT *, row_number() OVER (PARTITION BY uid ORDER BY dice DESC, license) AS nth FROM score WHERE dice >= 0.8) USING (uid) WHERE nth = 1
"""

MINHASH_DEDUP = f"""
WITH RECURSIVE {_shingles('s', 'documents', 'doc_id')},
n AS (SELECT id, count(*) AS n FROM s GROUP BY id), sn AS (SELECT s.id, g, n FROM s JOIN n USING (id)),
link AS (
  SELECT a.id AS a, b.id AS b FROM sn a JOIN sn b ON a.g = b.g AND a.id <> b.id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), reach(a, b) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b
), least_id AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM documents d JOIN least_id ON a = doc_id LEFT JOIN n ON n.id = doc_id
"""

SQL = {
    "op3_line_dedup": LINE_DEDUP,
    "op4_decontaminate": DECONTAMINATE,
    "op7_embedding_dedup": EMBEDDING_DEDUP,
    "op8_license_scan": LICENSE_SCAN,
    "op10_minhash_dedup": MINHASH_DEDUP,
}
