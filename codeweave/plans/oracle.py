"""What ``codeweave.plans.queries`` computes, as independent SQL over the same tables."""

from __future__ import annotations

_PAGE = """page AS (
  SELECT page_id, regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '') AS p,
         regexp_replace(html, '<a href="([^"]+)">([^<]+)</a>', '[\\2](\\1)', 'g') AS content FROM pages)"""
_LINKS = _PAGE + """, link AS (
  SELECT p || '.md' AS source_file, u.a AS link_text, u.b AS link_target FROM (
    SELECT p, unnest(list_zip(regexp_extract_all(content, '\\[([^\\]]+)\\]\\(([^)]+)\\)', 1), regexp_extract_all(content, '\\[([^\\]]+)\\]\\(([^)]+)\\)', 2))) AS z FROM page) t,
    LATERAL (SELECT z[1] AS a, z[2] AS b) u
  WHERE NOT (starts_with(u.b, 'http://') OR starts_with(u.b, 'https://') OR starts_with(u.b, '#')))"""
_BROKEN = _LINKS + """, part AS (SELECT DISTINCT string_split(p || '.md', '/') AS s FROM page),
existing AS (SELECT DISTINCT array_to_string(s[1:n], '/') AS path FROM part, LATERAL (SELECT unnest(range(1, len(s) + 1)) AS n) UNION SELECT '.'),
target AS (SELECT *, rtrim(regexp_replace(regexp_replace(source_file, '/[^/]*$', '') || '/' || string_split(link_target, '#')[1], '/+', '/', 'g'), '/') AS t FROM link),
gone AS (SELECT source_file, link_text, link_target, 0::INTEGER AS line FROM target WHERE t NOT IN (SELECT path FROM existing))"""

_EDGES = "e AS (SELECT DISTINCT 'p' || l_partkey AS src, 's' || l_suppkey AS dst FROM lineitem)"
_PLACES = """e AS (
  SELECT 'n' || n_nationkey AS src, 'r' || n_regionkey AS dst FROM nation
  UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer
  UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier)"""
_DEPTH = f"""WITH RECURSIVE {_PLACES}, node AS (SELECT src AS node FROM e UNION SELECT dst FROM e),
walk(node, depth) AS (SELECT node, 0 FROM node UNION SELECT e.src, w.depth + 1 FROM walk w JOIN e ON e.dst = w.node)"""

_SLUG = "regexp_replace(trim(replace(regexp_replace(lower({0}), '[^a-z0-9\\- ]+', '', 'g'), ' ', '-'), '-'), '-{{2,}}', '-', 'g')"
_TRIMMED = "trim({0}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(133) || chr(160))"

_PROSE = """d AS (SELECT doc_id, 'd' || doc_id AS path, lang, n_chars, string_split(text, chr(10)) AS s FROM documents),
f AS (SELECT path, x, i, regexp_matches(x, '^\\p{Lu}') AS shown FROM (SELECT path, unnest(s) AS x, unnest(range(1, len(s) + 1)) AS i FROM d))"""
_IMPORTS = """listing AS (SELECT 'nation' || s_nationkey AS dir, 'nation' || s_nationkey || '/s' || s_suppkey || CASE WHEN s_suppkey % 5 = 0 THEN '.md' ELSE '.go' END AS file FROM supplier),
rep AS (SELECT dir, min(file) AS rep FROM listing WHERE file LIKE '%.go' GROUP BY dir),
used AS (SELECT DISTINCT 'p' || l_partkey AS path, CASE s_suppkey % 4 WHEN 0 THEN 'shop/nation' || s_nationkey || '/s' || s_suppkey WHEN 1 THEN 'shop/nation' || s_nationkey
    WHEN 2 THEN 'shopping/nation' || s_nationkey ELSE 'shop/lost' || s_nationkey END AS import FROM lineitem JOIN supplier ON s_suppkey = l_suppkey),
put AS (SELECT *, CAST(row_number() OVER (PARTITION BY path ORDER BY import) - 1 AS INTEGER) AS pos, starts_with(import, 'shop/') AS internal, regexp_replace(import, '^shop/', '') AS dir FROM used),
found AS (SELECT path, pos, import, internal, CASE WHEN internal THEN coalesce(l.file, r.rep, '') ELSE '' END AS resolved_path
    FROM put p LEFT JOIN listing l ON l.file = p.dir || '.go' LEFT JOIN rep r ON r.dir = p.dir)"""

_PLAN = """m AS (
  SELECT source AS id, CAST(regexp_extract(source, '([0-9]+)$', 1) AS INTEGER) AS pos, false AS shared,
         CASE WHEN source = 'src3' THEN 'human' ELSE 'agent' END AS owner, list_sort(list('d' || doc_id)) AS files
  FROM documents WHERE lang <> 'de' GROUP BY source
  UNION ALL SELECT 'labelled', 1000, true, 'shared_preprocessor', list_sort(list('d' || doc_id)) FROM labels HAVING count(*) > 0
  UNION ALL SELECT '', 1001, false, 'agent', list_sort(list('b' || item_id)) FROM benchmark HAVING count(*) > 0
  UNION ALL SELECT 'labelled', 1002, false, 'agent', ['b0'] FROM benchmark HAVING count(*) > 0),
f AS (SELECT id, pos, unnest(files) AS path, unnest(range(len(files))) AS fp FROM m),
v AS (
  SELECT pos AS module_pos, 0 AS check_pos, 0 AS file_pos, 'empty module id' AS kind, id AS module_id, NULL AS path FROM m WHERE id = ''
  UNION ALL SELECT pos, 1, 0, 'duplicate module id', id, NULL FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pos) AS nth FROM m) WHERE nth > 1
  UNION ALL SELECT pos, 2, 0, 'invalid owner', id, NULL FROM m WHERE owner NOT IN ('agent', 'shared_preprocessor')
  UNION ALL SELECT pos, 3, fp * 2, 'not found in file index', id, path FROM f WHERE path NOT IN (SELECT 'd' || doc_id FROM documents)
  UNION ALL SELECT pos, 3, fp * 2 + 1, 'duplicate file assignment', id, path FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY pos, fp) AS nth FROM f) WHERE nth > 1
  UNION ALL SELECT 2147483647, 5, 0, 'missing file assignment', NULL, 'd' || doc_id FROM documents WHERE 'd' || doc_id NOT IN (SELECT path FROM f)),
violation AS (SELECT CAST(module_pos AS INTEGER) AS module_pos, CAST(check_pos AS INTEGER) AS check_pos, CAST(file_pos AS INTEGER) AS file_pos, kind, module_id, path FROM v)"""

_MOVES = """d AS (SELECT doc_id, text, CAST(doc_id AS VARCHAR) AS i, regexp_matches(source, '^src[1-4]$') AS near FROM documents WHERE regexp_matches(source, '^src[1-9]$')),
o AS (SELECT 'old/' || i AS path, i AS name, 'old' AS dir, text AS t FROM d),
w AS (SELECT CASE WHEN near THEN 'old/r' || i WHEN doc_id % 2 = 0 THEN 'new/' || i ELSE 'new/x' || i END AS path,
      CASE WHEN near THEN 'r' || i WHEN doc_id % 2 = 0 THEN i ELSE 'x' || i END AS name, CASE WHEN near THEN 'old' ELSE 'new' END AS dir, {edit} AS t FROM d)"""
_NTH = "(SELECT *, row_number() OVER (PARTITION BY t, name ORDER BY path) AS nth FROM {side})"
_FRONT = "list_max(list_transform(range({most} + 1), lambda k: CASE WHEN {cut}(x, k) = {cut}(y, k) THEN k ELSE 0 END))"
_GREEDY = """(SELECT list_reduce(list_prepend([]::STRUCT(x VARCHAR, y VARCHAR)[], list_transform(pairs, lambda q: [q])), lambda acc, q:
      CASE WHEN list_contains(list_transform(acc, lambda z: z.x), q[1].x) OR list_contains(list_transform(acc, lambda z: z.y), q[1].y) THEN acc ELSE list_concat(acc, q) END) AS got FROM {lists})"""
_EXACT = f"""named AS (SELECT b.path, a.path AS old_path FROM {_NTH.format(side='o')} a JOIN {_NTH.format(side='w')} b USING (t, name, nth)),
q AS (SELECT o.t, o.path AS x, w.path AS y FROM o JOIN w USING (t) WHERE o.path NOT IN (SELECT old_path FROM named) AND w.path NOT IN (SELECT path FROM named)),
qf AS (SELECT *, {_FRONT.format(most='least(length(x), length(y))', cut='left')} AS f FROM q),
qs AS (SELECT t, x, y, (f + {_FRONT.format(most='(least(length(x), length(y)) - f)', cut='right')})::DOUBLE / greatest(length(x), length(y)) AS s FROM qf),
ql AS (SELECT list({{'x': x, 'y': y}} ORDER BY s DESC, x, y) AS pairs FROM qs GROUP BY t),
same AS (SELECT path, old_path FROM named UNION ALL SELECT u.y, u.x FROM (SELECT unnest(got) AS u FROM {_GREEDY.format(lists='ql')}))"""
_SIMILAR = """lo AS (SELECT path, line, count(*) AS n FROM (SELECT path, unnest(string_split(t, chr(10))) AS line FROM o WHERE path NOT IN (SELECT old_path FROM same)) GROUP BY ALL),
lw AS (SELECT path, line, count(*) AS n FROM (SELECT path, unnest(string_split(t, chr(10))) AS line FROM w WHERE path NOT IN (SELECT path FROM same)) GROUP BY ALL),
zo AS (SELECT path, sum(n * (strlen(line) + 1))::BIGINT AS size FROM lo GROUP BY path), zw AS (SELECT path, sum(n * (strlen(line) + 1))::BIGINT AS size FROM lw GROUP BY path),
m AS (SELECT lo.path AS x, lw.path AS y, sum(least(lo.n, lw.n) * (strlen(line) + 1))::BIGINT AS shared FROM lo JOIN lw USING (line) GROUP BY ALL),
c AS (SELECT x, y, shared::DOUBLE / greatest(zo.size, zw.size)::DOUBLE AS s FROM m JOIN zo ON zo.path = x JOIN zw ON zw.path = y WHERE shared * 100 >= greatest(zo.size, zw.size) * 60),
g AS (SELECT list({'x': x, 'y': y} ORDER BY s DESC, x, y) AS pairs FROM c),
r AS """ + _GREEDY.format(lists="g")
_UNPAIRED = "SELECT path, '', 'added' FROM w WHERE path NOT IN (SELECT path FROM {pairs}) UNION ALL SELECT path, '', 'deleted' FROM o WHERE path NOT IN (SELECT old_path FROM {pairs})"

SQL: dict[str, str] = {
    "broken_links": f"WITH {_BROKEN} SELECT * FROM gone",
    "link_totals": f"""WITH {_BROKEN} SELECT (SELECT count(*) FROM pages) AS total_files, (SELECT count(*) FROM link) AS total_links, (SELECT count(*) FROM gone) AS broken""",
    "link_extract": f"WITH {_LINKS} SELECT * FROM link",
    "exclude_globs": f"""WITH {_PAGE}, x AS (SELECT page_id, p AS path, regexp_replace(p, '^.*/', '') AS b FROM page)
        SELECT page_id, path FROM x WHERE NOT (
          regexp_full_match(path, '[^/]*\\.example\\.net/en/[^/]*') OR regexp_full_match(path, '(.*/)?fr(/.*)?') OR b = 'fr'
          OR regexp_full_match(path, 'm\\.[^/]*(/.*)?') OR regexp_full_match(b, 'm\\.[^/]*')
          OR regexp_full_match(path, '[^/]*[0-3]') OR regexp_full_match(b, '[^/]*[0-3]')
          OR regexp_full_match(path, '(blog|www)\\.tion[^/]*/[^/]*/[^/]'))""",
    "content_hash": "SELECT doc_id, sha256(text) AS content_hash FROM documents",
    "token_estimate": "SELECT doc_id, strlen(text) // 4 AS estimate, (strlen(text) + 3) // 4 AS estimate_up FROM documents",
    "line_index": "SELECT doc_id, CAST(n AS INTEGER) AS line_no, md5(line) AS line_md5 FROM (SELECT doc_id, unnest(s) AS line, unnest(range(1, len(s) + 1)) AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents))",
    "heading_slug": f"SELECT page_id, title, {_SLUG.format('title')} AS slug FROM (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages)",
    "toc_block": f"""WITH l AS (
          SELECT doc_id, i, CASE WHEN i = 2 THEN '# ' || x WHEN i % 5 = 3 THEN '## ' || x WHEN i % 5 = 0 THEN '### ' || x ELSE x END AS x
          FROM (SELECT doc_id, unnest(s) AS x, unnest(range(1, len(s) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents))),
        h AS (SELECT doc_id, i, CASE WHEN starts_with(x, '### ') THEN '  - [' ELSE '- [' END AS pre, {_TRIMMED.format("regexp_replace(x, '^#{2,3} ', '')")} AS t FROM l WHERE starts_with(x, '## ') OR starts_with(x, '### ')),
        toc AS (SELECT doc_id, string_agg(pre || t || '](#' || {_SLUG.format('t')} || ')', chr(10) ORDER BY i) AS entries FROM h GROUP BY doc_id),
        body AS (SELECT doc_id, string_agg(x, chr(10) ORDER BY i) AS body, min(i) FILTER (starts_with(x, '# ')) AS at FROM l GROUP BY doc_id),
        page AS (SELECT b.doc_id, coalesce(t.entries, '') AS entries, CASE WHEN t.entries IS NULL THEN b.body
            WHEN b.at IS NULL THEN '## Contents' || chr(10) || chr(10) || t.entries || chr(10) || chr(10) || b.body
            ELSE array_to_string(string_split(b.body, chr(10))[1:b.at], chr(10)) || chr(10) || chr(10) || '## Contents' || chr(10) || chr(10) || t.entries || chr(10) || chr(10)
                 || coalesce(array_to_string(string_split(b.body, chr(10))[b.at + 1:], chr(10)), '') END AS page FROM body b LEFT JOIN toc t USING (doc_id))
        SELECT doc_id, entries, md5(page) AS page_md5 FROM page""",
    "parse_changed_csv": "SELECT n_name AS path, '' AS old_path, 'modified' AS type FROM nation",
    "strict_replies": "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN CAST(props->>'$.k' AS BIGINT) END AS k, event_id % 2 = 1 AS refused FROM events",
    "props_json": "SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k FROM events",
    "symbol_map": "SELECT md5(text) AS name_md5, arg_min(source || '#L' || doc_id, (source, doc_id)) AS ref FROM documents WHERE regexp_matches(text, '^\\p{Lu}') GROUP BY text",
    "citation_inject": """WITH sym AS (SELECT w AS name, arg_min(source || '#L' || doc_id, (source, doc_id)) AS ref FROM (SELECT source, doc_id, unnest(list_distinct(regexp_extract_all(text, '([A-Z][a-z]+)', 1))) AS w FROM documents WHERE lang = 'en') GROUP BY w),
        b AS (SELECT doc_id, regexp_replace(text, '([A-Z][a-z]+)', '`\\1`', 'g') AS body FROM documents),
        z AS (SELECT doc_id, string_split_regex(body, '`[A-Z][A-Za-z0-9]*`') AS gaps, regexp_extract_all(body, '`([A-Z][A-Za-z0-9]*)`', 1) AS names FROM b),
        u AS (SELECT doc_id, unnest(range(1, len(gaps) + 1)) AS i, unnest(gaps) AS gap, unnest(list_concat(names, [NULL])) AS name FROM z)
        SELECT doc_id, md5(string_agg(gap || CASE WHEN u.name IS NULL THEN '' WHEN ref IS NULL THEN '`' || u.name || '`' ELSE '[' || u.name || '](' || ref || ')' END, '' ORDER BY i)) AS body_md5
        FROM u LEFT JOIN sym USING (name) GROUP BY doc_id""",
    "ground_refs": """WITH d AS (SELECT source, doc_id, n_chars, lang, unnest(list_distinct(regexp_extract_all(text, '([A-Z][a-z]+)', 1))) AS name FROM documents),
        t AS (SELECT conv_id, turn, role, regexp_extract_all(text, '([A-Z][a-z]+)', 1) AS names FROM conversations),
        c AS (SELECT (conv_id * 1000 + turn) * 10000 + pos AS ord, name, CASE WHEN role = 'user' THEN '' ELSE 'en' END AS sig FROM (SELECT *, unnest(names) AS name, unnest(range(len(names))) AS pos FROM t))
        SELECT c.ord, c.name, coalesce(arg_min(source || '#L' || n_chars, (source, doc_id)), 'claimed') AS ref, count(d.doc_id) > 0 AS grounded
        FROM c LEFT JOIN d ON d.name = c.name AND (c.sig = '' OR c.sig = d.lang) GROUP BY c.ord, c.name""",
    "go_symbols": """WITH d AS (SELECT doc_id, replace(text, chr(13), '') AS t FROM documents), n AS (SELECT *, len(string_split(t, chr(10))) - 1 AS n FROM d)
        SELECT 'd' || doc_id || '.go' AS path,
          sha256('package p' || chr(10) || chr(10) || 'import "fmt"' || chr(10) || chr(10) || '// ' || replace(t, chr(10), chr(10) || '// ') || chr(10) || 'type T' || doc_id || ' struct {' || chr(10) || chr(9) || 'x int' || chr(10) || '}' || chr(10) || chr(10)
            || 'func (t *T' || doc_id || ') F' || doc_id || '(a int) error {' || chr(10) || chr(9) || 'return nil' || chr(10) || '}' || chr(10) || chr(10) || 'func g(b string) {}' || chr(10)) AS content_hash,
          'F' || doc_id || '|func (t *T' || doc_id || ') F' || doc_id || '(a int) error|' || (n + 10) || '|' || (n + 12) || '|true;g|func g(b string)|' || (n + 14) || '|' || (n + 14) || '|false' AS functions,
          'T' || doc_id || '|struct|' || (n + 6) || '|' || (n + 8) AS types, 'fmt' AS imports FROM n""",
    "skeleton_lines": f"""WITH {_PROSE} SELECT path, 0 AS part, 0 AS ord, md5('// === ' || path || ' ===') AS line_md5, true AS always FROM d
        UNION ALL SELECT path, 1, CAST(i - 1 AS INTEGER), md5('func ' || x || '  // ' || path || ':' || i), shown FROM f
        UNION ALL SELECT path, 2, 0, md5('type ' || lang || ' struct  // ' || path || ':' || n_chars), doc_id % 2 = 0 FROM d""",
    "declared_symbols": f"""WITH {_PROSE} SELECT md5(x) AS name_md5, path, 0 AS kind_ord, CAST(i AS INTEGER) AS line_start, shown AS exported FROM f
        UNION ALL SELECT md5(lang), path, 1, CAST(n_chars AS INTEGER), doc_id % 2 = 0 FROM d""",
    "import_resolution": f"WITH {_IMPORTS} SELECT path, pos, import, internal, resolved_path FROM found",
    "import_edges": f"WITH {_IMPORTS} SELECT path AS src, resolved_path AS dst, count(*) AS n FROM found WHERE internal AND resolved_path <> '' GROUP BY ALL",
    "dep_edges": f"WITH {_EDGES} SELECT 'p' || p_partkey AS path, CAST(count(dst) AS INTEGER) AS n_deps, md5(coalesce(string_agg(dst, ',' ORDER BY dst), '')) AS deps_md5 FROM part LEFT JOIN e ON src = 'p' || p_partkey GROUP BY 1",
    "reverse_graph": f"WITH {_EDGES}, n AS (SELECT 'p' || p_partkey AS path FROM part UNION SELECT dst FROM e) SELECT path, CAST(count(src) AS INTEGER) AS n_deps, md5(coalesce(string_agg(src, ',' ORDER BY src), '')) AS deps_md5 FROM n LEFT JOIN e ON dst = path GROUP BY 1",
    "affected_closure": f"""WITH RECURSIVE {_PLACES}, mf AS (
          SELECT 'region ' || n_regionkey AS id, 'n' || n_nationkey AS path FROM nation UNION ALL SELECT c_mktsegment || ' ' || c_nationkey, 'c' || c_custkey FROM customer),
        seed AS (SELECT DISTINCT path FROM mf WHERE id IN (SELECT id FROM mf WHERE path IN (SELECT 'n' || n_nationkey FROM nation WHERE n_regionkey = 2))),
        reach(node) AS (SELECT path FROM seed UNION SELECT e.src FROM reach r JOIN e ON e.dst = r.node)
        SELECT id, CAST(count(*) AS INTEGER) AS n_files FROM mf WHERE id IN (SELECT id FROM mf WHERE path IN (SELECT node FROM reach)) GROUP BY id""",
    "module_contract": "SELECT DISTINCT p_brand AS src, 'nation ' || s_nationkey AS dst FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey",
    "topo_order": """WITH RECURSIVE e AS (SELECT DISTINCT p_brand AS src, 'nation ' || s_nationkey AS dst FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey),
        n AS (SELECT p_brand AS id FROM part UNION SELECT 'nation ' || s_nationkey FROM supplier),
        g AS (SELECT list({'id': id, 'd': d}) AS g FROM (SELECT id, coalesce(list(dst) FILTER (dst IS NOT NULL), []) AS d FROM n LEFT JOIN e ON src = id GROUP BY id)),
        t(pos, done) AS (SELECT -1, []::VARCHAR[] UNION ALL
          SELECT pos + 1, list_append(done, list_min(list_transform(list_filter(g, lambda x: NOT list_contains(done, x.id) AND list_has_all(done, x.d)), lambda x: x.id))) FROM t, g WHERE len(done) < len(g))
        SELECT CAST(pos AS INTEGER) AS pos, done[-1] AS id FROM t WHERE pos >= 0""",
    "topo_levels": f"{_DEPTH} SELECT node, CAST(max(depth) AS INTEGER) AS level FROM walk GROUP BY node",
    "dep_depth": f"{_DEPTH} SELECT node, CAST(max(depth) AS INTEGER) AS depth FROM walk GROUP BY node",
    "shared_by_indegree": f"WITH {_EDGES} SELECT dst AS node, count(DISTINCT src) AS users FROM e GROUP BY dst HAVING count(DISTINCT src) >= 3",
    "plan_violations": f"WITH {_PLAN} SELECT * FROM violation",
    "first_violation": f"WITH {_PLAN} SELECT * FROM violation ORDER BY module_pos, check_pos, file_pos, coalesce(path, '') LIMIT 1",
    "skeleton_fill": """WITH l AS (SELECT doc_id, unnest(s) AS line, CAST(unnest(range(len(s))) AS INTEGER) AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents)),
        a AS (SELECT *, regexp_matches(line, '^[A-Z]') AS always FROM l),
        g AS (SELECT doc_id, greatest(coalesce(sum(strlen(line) + 1) FILTER (always), 0) - 1, 0)::BIGINT AS must,
                     coalesce(list({'p': pos, 'n': strlen(line)::BIGINT} ORDER BY pos) FILTER (NOT always), []) AS may FROM a GROUP BY doc_id),
        r AS (SELECT doc_id, list_reduce(list_prepend({'size': must, 'in': []::INTEGER[]}, list_transform(may, lambda x: {'size': x.n, 'in': [x.p]})),
              lambda acc, x: CASE WHEN (CASE WHEN acc['size'] > 0 THEN acc['size'] + 1 + x['size'] ELSE x['size'] END) // 4 <= 60
                THEN {'size': CASE WHEN acc['size'] > 0 THEN acc['size'] + 1 + x['size'] ELSE x['size'] END, 'in': list_concat(acc['in'], x['in'])} ELSE acc END) AS got FROM g)
        SELECT a.doc_id, a.pos, a.always OR list_contains(r.got['in'], a.pos) AS kept FROM a JOIN r USING (doc_id)""",
    "skeleton_cut": "SELECT conv_id, turn, estimate FROM (SELECT conv_id, turn, CAST((sum(strlen(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) - 1) // 4 AS BIGINT) AS estimate FROM conversations) WHERE estimate <= 200",
    "snapshot_diff": """WITH s AS (SELECT ts >= TIMESTAMP '2024-01-16' AS late, user_id || '/' || event_type AS path, count(*) AS n FROM events GROUP BY ALL),
        b AS (SELECT path, n FROM s WHERE NOT late), h AS (SELECT path, n FROM s WHERE late)
        SELECT path, '' AS old_path, CASE WHEN b.n IS NULL THEN 'added' WHEN h.n IS NULL THEN 'deleted' ELSE 'modified' END AS type FROM b FULL JOIN h USING (path) WHERE b.n IS DISTINCT FROM h.n""",
    "rename_detect": f"WITH {_MOVES.format(edit='text')}, {_EXACT} SELECT path, old_path, 'renamed' AS type FROM same UNION ALL {_UNPAIRED.format(pairs='same')}",
    "rename_similar": f"""WITH {_MOVES.format(edit="CASE WHEN doc_id % 3 = 0 THEN text ELSE text || chr(10) || 'moved by ' || doc_id END")}, {_EXACT}, {_SIMILAR},
        pair AS (SELECT path, old_path FROM same UNION ALL SELECT u.y, u.x FROM (SELECT unnest(got) AS u FROM r))
        SELECT path, old_path, 'renamed' AS type FROM pair UNION ALL {_UNPAIRED.format(pairs='pair')}""",
    "index_upsert": """WITH ch AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'deleted' WHEN quality = 1 THEN 'modified' ELSE 'renamed' END AS t FROM labels),
        fresh AS (SELECT d.doc_id, md5(text || '!') AS h FROM documents d WHERE lang <> 'fr')
        SELECT 'd' || doc_id AS path, md5(text) AS content_hash FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM ch WHERE t IN ('deleted', 'renamed'))
          AND doc_id NOT IN (SELECT doc_id FROM ch JOIN fresh USING (doc_id) WHERE t = 'modified')
        UNION ALL SELECT CASE WHEN t = 'renamed' THEN 'xd' ELSE 'd' END || doc_id, h FROM ch JOIN fresh USING (doc_id) WHERE t IN ('modified', 'renamed')""",
    "summary_carryover": """SELECT l.doc_id, CASE WHEN k THEN CAST(length(d.text) AS INTEGER) END AS size, CASE WHEN k THEN 'kept' ELSE 'computed' END AS state
        FROM (SELECT DISTINCT doc_id, NOT (toxic = 1 OR quality = 0) AS calm FROM labels) l LEFT JOIN documents d ON d.doc_id = l.doc_id AND d.lang = 'en',
        LATERAL (SELECT l.calm AND d.doc_id IS NOT NULL AS k)""",
    "used_by_list": """SELECT r_name AS id, '| ' || r_name || ' | ' || CASE WHEN r_name < 'D' THEN 'shared' ELSE 'module' END || ' | ' || CASE WHEN r_name < 'D' THEN coalesce(string_agg(n_name, ', ' ORDER BY n_name), '-') ELSE '-' END || ' |' AS line
        FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name""",
    "shared_pages": f"""WITH p AS (SELECT doc_id, '# d' || doc_id || chr(10) || chr(10) || text || chr(10)
          || CASE WHEN doc_id % 3 <> 0 THEN chr(10) || '## Key Types' || chr(10) || chr(10) || '- `' || lang || '`' || chr(10) || '- `' || source || '`' || chr(10) ELSE '' END
          || CASE WHEN doc_id % 12 <> 0 THEN chr(10) || '## Key Functions' || chr(10) || chr(10) || '- `' || lang || '`' || CASE WHEN doc_id % 2 = 0 THEN ': `func ' || lang || '()`' ELSE '' END
            || CASE WHEN doc_id % 5 <> 0 THEN ' ([source](' || source || '#L' || n_chars || '))' ELSE '' END || chr(10) ELSE '' END
          || CASE WHEN doc_id % 4 <> 0 THEN chr(10) || '## Source References' || chr(10) || chr(10) || '- `' || source || '`' || chr(10) ELSE '' END AS page FROM documents)
        SELECT doc_id, md5({_TRIMMED.format('page')} || chr(10)) AS page_md5 FROM p""",
    "shared_block": """WITH l AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id),
        b AS (SELECT source, doc_id, concat_ws(chr(10), '### d' || doc_id, CASE WHEN quality = 1 AND text <> '' THEN text END, CASE WHEN toxic = 0 THEN 'Key functions: ' || lang || ', ' || source END,
          'Reference: [See full docs](../shared/d' || doc_id || '.md)') AS t FROM documents JOIN l USING (doc_id))
        SELECT source AS id, md5('## Shared modules (do not re-describe — link only)' || chr(10) || chr(10) || string_agg(t, chr(10) || chr(10) ORDER BY doc_id)) AS block_md5 FROM b GROUP BY source""",
    "fanout_tally": """SELECT count(*) AS total, count(*) FILTER (NOT bad) AS succeeded, count(*) FILTER (bad) AS failed, md5(coalesce(string_agg(id, ', ' ORDER BY id) FILTER (bad), '')) AS failed_md5
        FROM (SELECT conv_id || '/' || turn AS id, contains(text, 'nicht') OR contains(text, 'éau') AS bad FROM conversations)""",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
