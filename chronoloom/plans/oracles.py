"""The SQL counterparts of the registered queries, for an engine with recursive CTEs."""

from __future__ import annotations

import re

from . import fixtures as fx


def _sql(text: str) -> str:
    return re.sub(r"\{(\w+)\}", r"\1", text.replace("{{", "\0").replace("}}", "\1")).replace("\0", "{").replace("\1", "}")


_GRAPH = f"""WITH RECURSIVE commits AS MATERIALIZED ({_sql(fx.COMMITS)}),
edges AS MATERIALIZED (SELECT repo_id, sha AS child, parent0 AS parent, 0 AS parent_ord, log_pos AS child_log_pos FROM commits WHERE parent0 IS NOT NULL
  UNION ALL SELECT repo_id, sha, parent1, CASE WHEN parent0 IS NULL THEN 0 ELSE 1 END, log_pos FROM commits WHERE parent1 IS NOT NULL),
refs AS (SELECT repo_id, arg_max(sha, seq) AS sha FROM commits WHERE p NOT IN (3, 4, 8) GROUP BY repo_id),
walk AS (SELECT repo_id, sha, CAST(0 AS BIGINT) AS depth_from_tip FROM refs
  UNION ALL SELECT w.repo_id, e.parent, w.depth_from_tip + 1 FROM walk w JOIN edges e ON e.repo_id = w.repo_id AND e.child = w.sha AND e.parent_ord = 0),
trunk AS MATERIALIZED (SELECT * FROM walk),
following AS MATERIALIZED (SELECT e.repo_id, e.parent, arg_min(e.child, e.child_log_pos) AS child FROM edges e JOIN trunk a ON a.repo_id = e.repo_id AND a.sha = e.child
  JOIN trunk b ON b.repo_id = e.repo_id AND b.sha = e.parent GROUP BY ALL),
forth AS (SELECT c.repo_id, arg_min(c.sha, c.log_pos) AS sha, CAST(0 AS BIGINT) AS trunk_pos FROM commits c JOIN trunk t USING (repo_id, sha) WHERE parent0 IS NULL AND parent1 IS NULL GROUP BY c.repo_id
  UNION ALL SELECT w.repo_id, f.child, w.trunk_pos + 1 FROM forth w JOIN following f ON f.repo_id = w.repo_id AND f.parent = w.sha),
path AS MATERIALIZED (SELECT * FROM forth),
cut AS (SELECT p.repo_id, p.sha, p.trunk_pos, sum(CASE WHEN c.parent1 IS NOT NULL AND p.trunk_pos > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY p.repo_id ORDER BY p.trunk_pos) AS k FROM path p JOIN commits c USING (repo_id, sha)),
on_trunk AS MATERIALIZED (SELECT repo_id, 'trunk-' || CAST(CAST(k AS BIGINT) AS VARCHAR) AS segment_id, row_number() OVER (PARTITION BY repo_id, k ORDER BY trunk_pos) - 1 AS ordinal, sha, trunk_pos FROM cut),
flags AS MATERIALIZED (SELECT e.*, t.sha IS NOT NULL AS is_on FROM edges e LEFT JOIN trunk t ON t.repo_id = e.repo_id AND t.sha = e.child),
hops AS MATERIALIZED (SELECT repo_id, parent AS sha, arg_min(child, child_log_pos) FILTER (is_on) AS merges_into, arg_min(child, child_log_pos) FILTER (NOT is_on) AS following FROM flags GROUP BY ALL),
starts AS MATERIALIZED (SELECT f.repo_id, f.child AS start, f.parent AS fork_from, p.trunk_pos, f.child_log_pos FROM flags f JOIN path p ON p.repo_id = f.repo_id AND p.sha = f.parent WHERE NOT is_on),
trace AS (SELECT DISTINCT repo_id, start, start AS sha, CAST(0 AS BIGINT) AS hop FROM starts
  UNION ALL SELECT t.repo_id, t.start, h.following, t.hop + 1 FROM trace t JOIN hops h ON h.repo_id = t.repo_id AND h.sha = t.sha AND h.merges_into IS NULL AND h.following IS NOT NULL),
traces AS MATERIALIZED (SELECT * FROM trace),
ends AS (SELECT t.repo_id, t.start, max(h.merges_into) AS merges_into, count(*) AS n_commits FROM traces t LEFT JOIN hops h USING (repo_id, sha) GROUP BY ALL),
kinds AS (SELECT s.*, e.merges_into, e.n_commits, CASE WHEN e.merges_into IS NULL THEN 'dead-end' ELSE 'branch' END AS type FROM starts s JOIN ends e USING (repo_id, start)),
offs AS MATERIALIZED (SELECT *, type || '-' || CAST(row_number() OVER (PARTITION BY repo_id, type ORDER BY trunk_pos, child_log_pos) - 1 AS VARCHAR) AS segment_id,
  row_number() OVER (PARTITION BY repo_id ORDER BY trunk_pos, child_log_pos) - 1 AS branch_ord FROM kinds),
heads AS (SELECT repo_id, segment_id, count(*) AS n_commits, min(trunk_pos) AS first_pos FROM on_trunk GROUP BY ALL),
segments AS MATERIALIZED (SELECT repo_id, segment_id, 'trunk' AS type, row_number() OVER (PARTITION BY repo_id ORDER BY first_pos) - 1 AS creation_ord, CAST(NULL AS VARCHAR) AS fork_from, CAST(NULL AS VARCHAR) AS merges_into, n_commits FROM heads
  UNION ALL SELECT o.repo_id, o.segment_id, o.type, o.branch_ord + n.n, o.fork_from, o.merges_into, o.n_commits FROM offs o JOIN (SELECT repo_id, count(*) AS n FROM heads GROUP BY repo_id) n USING (repo_id)),
members AS MATERIALIZED (SELECT repo_id, segment_id, ordinal, sha FROM on_trunk UNION ALL SELECT t.repo_id, o.segment_id, t.hop, t.sha FROM traces t JOIN offs o USING (repo_id, start)),
owner AS MATERIALIZED (SELECT m.repo_id, m.sha, arg_max(m.segment_id, s.creation_ord) AS segment_id FROM members m JOIN segments s USING (repo_id, segment_id) GROUP BY ALL),
wanted AS (SELECT m.repo_id, m.segment_id, e.parent_ord AS o, e.parent FROM members m JOIN segments s USING (repo_id, segment_id) JOIN edges e ON e.repo_id = m.repo_id AND e.child = m.sha WHERE m.ordinal = 0 AND s.type = 'trunk'
  UNION ALL SELECT repo_id, segment_id, 0, fork_from FROM segments WHERE fork_from IS NOT NULL),
dep AS (SELECT w.repo_id, w.segment_id, o.segment_id AS dep_id, min(w.o) AS o FROM wanted w JOIN owner o ON o.repo_id = w.repo_id AND o.sha = w.parent WHERE o.segment_id <> w.segment_id GROUP BY ALL),
deps AS MATERIALIZED (SELECT repo_id, segment_id, row_number() OVER (PARTITION BY repo_id, segment_id ORDER BY o) - 1 AS dep_ord, dep_id FROM dep),
chains AS (SELECT repo_id, segment_id, CAST(0 AS BIGINT) AS level, n_commits AS dist FROM segments s WHERE NOT EXISTS (SELECT 1 FROM deps d WHERE d.repo_id = s.repo_id AND d.segment_id = s.segment_id)
  UNION SELECT d.repo_id, d.segment_id, c.level + 1, c.dist + s.n_commits FROM chains c JOIN deps d ON d.repo_id = c.repo_id AND d.dep_id = c.segment_id JOIN segments s ON s.repo_id = d.repo_id AND s.segment_id = d.segment_id),
merges AS MATERIALIZED (SELECT m.repo_id, m.segment_id, m.sha AS merge_sha, arg_min(d.dep_id, d.dep_ord) FILTER (k.type = 'trunk') AS trunk_dep, arg_min(d.dep_id, d.dep_ord) FILTER (k.type = 'branch') AS branch_dep
  FROM members m JOIN commits c USING (repo_id, sha) JOIN segments s ON s.repo_id = m.repo_id AND s.segment_id = m.segment_id AND s.type = 'trunk' JOIN deps d ON d.repo_id = m.repo_id AND d.segment_id = m.segment_id
  JOIN segments k ON k.repo_id = d.repo_id AND k.segment_id = d.dep_id WHERE m.ordinal = 0 AND c.parent1 IS NOT NULL GROUP BY ALL HAVING trunk_dep IS NOT NULL AND branch_dep IS NOT NULL),
ledger AS MATERIALIZED (SELECT m.repo_id, m.segment_id, m.ordinal AS seq, m.sha AS original_sha, sha1('d' || m.segment_id || m.sha) AS derived_sha, 'spec ' || substr(m.sha, 1, 8) AS spec, 'log ' || substr(m.sha, 1, 8) AS changelog
  FROM members m JOIN segments s USING (repo_id, segment_id) WHERE m.ordinal * 2 < s.n_commits),
tips AS MATERIALIZED (SELECT repo_id, segment_id, max(seq) AS seq, arg_max(original_sha, seq) AS original_sha, arg_max(derived_sha, seq) AS derived_sha, arg_max(spec, seq) AS spec, arg_max(changelog, seq) AS changelog FROM ledger GROUP BY ALL),
mapping AS MATERIALIZED (SELECT repo_id, original_sha, arg_max(derived_sha, seq) AS derived_sha FROM ledger GROUP BY ALL),
progress AS (SELECT *, CASE WHEN creation_ord < 3 THEN 'complete' WHEN creation_ord = 3 THEN 'in-progress' ELSE 'pending' END AS status FROM segments),
seeds AS (SELECT s.repo_id, s.segment_id, -(t.depth_from_tip - a.depth_from_tip) - 1 AS ordinal, t.sha FROM segments s JOIN trunk a ON a.repo_id = s.repo_id AND a.sha = s.fork_from
  JOIN trunk t ON t.repo_id = s.repo_id AND t.depth_from_tip BETWEEN a.depth_from_tip AND a.depth_from_tip + 3),
plain AS (SELECT *, array_agg(sha) OVER (PARTITION BY repo_id, segment_id ORDER BY ordinal ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS w FROM members),
seeded AS (SELECT * FROM (SELECT *, array_agg(sha) OVER (PARTITION BY repo_id, segment_id ORDER BY ordinal ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS w FROM (SELECT * FROM members UNION ALL SELECT * FROM seeds)) WHERE ordinal >= 0),
tagged AS (SELECT repo_id, sha, log_pos, CASE WHEN seq % 5 <> 0 THEN sha1(CAST(seq % 50 AS VARCHAR)) END AS original_sha FROM commits),
middle AS (SELECT c.repo_id, c.sha FROM commits c JOIN (SELECT repo_id, max(seq) // 2 AS seq FROM commits GROUP BY repo_id) m USING (repo_id, seq)),
up AS (SELECT * FROM middle UNION SELECT u.repo_id, e.parent FROM up u JOIN edges e ON e.repo_id = u.repo_id AND e.child = u.sha),
models AS (SELECT m.repo_id, CASE WHEN c.parent0 IS NULL AND c.parent1 IS NULL OR c.parent1 IS NOT NULL AND s.type = 'trunk' THEN 'opus' ELSE 'sonnet' END AS model, count(*) AS steps FROM members m JOIN segments s USING (repo_id, segment_id) JOIN commits c ON c.repo_id = m.repo_id AND c.sha = m.sha GROUP BY ALL),
done AS (SELECT repo_id, count(*) AS done FROM ledger GROUP BY repo_id),
costs AS (SELECT repo_id, CAST(sum(greatest(0, steps - least(steps, coalesce(done, 0))) * CASE model WHEN 'opus' THEN 0.05 ELSE 0.01 END) AS DECIMAL(18,4)) AS low,
  CAST(sum(greatest(0, steps - least(steps, coalesce(done, 0))) * CASE model WHEN 'opus' THEN 0.25 ELSE 0.05 END) AS DECIMAL(18,4)) AS high FROM models LEFT JOIN done USING (repo_id) GROUP BY repo_id)
"""
_FILES = f"WITH files AS ({_sql(fx.FILES)})"
_KEY = "CASE WHEN NOT contains(path, '/') THEN '.' WHEN split_part(path, '/', 1) IN ('packages', 'apps', 'libs', 'tooling', 'config', 'services', 'modules') AND len(string_split(path, '/')) >= 3 THEN split_part(path, '/', 1) || '/' || split_part(path, '/', 2) ELSE split_part(path, '/', 1) END"
_KEPT = "NOT regexp_matches(regexp_extract(path, '[^/]*$'), '^(pnpm-lock\\.yaml|[^/]*\\.test\\.ts)$')"


def _split(source: str, limit: int) -> str:
    """Recursive descent with the sums of a chunk known by its key prefix (paths have few levels)."""
    return f"""r AS (SELECT change_id, path, tokens, {_KEY} AS chunk_key, 0 AS depth FROM {source}
  UNION ALL SELECT change_id, path, tokens, sub_key, depth + 1 FROM (
    SELECT *, sum(tokens) OVER w AS total, min(sub_key) OVER w AS a, max(sub_key) OVER w AS b FROM (
      SELECT *, CASE WHEN chunk_key = '.' THEN split_part(path, '/', 1) WHEN starts_with(path, chunk_key || '/') THEN chunk_key || '/' || split_part(substr(path, length(chunk_key) + 2), '/', 1) ELSE path END AS sub_key FROM r)
    WINDOW w AS (PARTITION BY change_id, chunk_key)) WHERE total > {limit} AND a <> b),
last AS (SELECT change_id, path, any_value(tokens) AS tokens, arg_max(chunk_key, depth) AS chunk_key FROM r GROUP BY change_id, path)"""


_CHANGES = f"WITH e AS ({_sql(fx.CHANGELOGS)}), e2 AS (SELECT *, substr(entry, 5, 8) AS s FROM e), trunk AS (SELECT conv_id, string_agg(entry, '' ORDER BY turn) AS text FROM e WHERE on_trunk GROUP BY conv_id), own AS (SELECT a.conv_id, a.turn, a.s AS sha8, a.entry FROM e2 a WHERE turn % 4 <> 3 AND NOT EXISTS (SELECT 1 FROM e2 b WHERE b.conv_id = a.conv_id AND b.on_trunk AND b.turn % 4 <> 3 AND b.s = a.s))"
_RESPONSES = f"WITH r AS ({_sql(fx.RESPONSES)}), t AS (SELECT conv_id, CAST(turn AS INT) AS attempt, turn % 5 AS k FROM conversations)"
_MODULES = f"""{_FILES}, modules AS (SELECT DISTINCT 'packages/' || split_part(path, '/', 2) || '.md' AS module_path FROM files WHERE path LIKE 'packages/%/src/%' UNION SELECT 'src.md'),
dirs AS (SELECT DISTINCT path, string_split(path, '/') AS parts FROM files),
ups AS (SELECT path, d, array_to_string(parts[1:d], '/') || '.md' AS candidate FROM dirs, unnest(range(1, len(parts))) AS u(d)),
found AS (SELECT dirs.path, coalesce(arg_max(m.module_path, d), '_master.md') AS module_path FROM dirs LEFT JOIN ups ON ups.path = dirs.path LEFT JOIN modules m ON m.module_path = ups.candidate GROUP BY dirs.path),
relevant AS (SELECT DISTINCT change_id, module_path, 'module ' || module_path AS content FROM files JOIN found USING (path) UNION SELECT DISTINCT change_id, '_master.md', 'module _master.md' FROM files)"""
_STEPS = f"WITH steps AS ({_sql(fx.STEPS)})"
_SOURCES = f"WITH src AS ({_sql(fx.SOURCES)})"


_CHUNKS = """WITH d AS (SELECT doc_id, doc_id // 10 AS change_id, lang, text, lang || '/doc' || doc_id || '.md' AS path FROM documents WHERE lang IS NOT NULL),
accepted AS (SELECT change_id FROM (SELECT doc_id // 10 AS change_id, sum(doc_id % 10) + doc_id // 10 % 9 AS n FROM documents GROUP BY doc_id // 10) WHERE ceil(n / 4.0) * 10 <= 120),
parts AS (SELECT *, CAST(ceil(length('diff --git a/' || path || ' b/' || path || chr(10) || coalesce(text, '') || chr(10)) / 4.0) AS BIGINT) AS tokens FROM d),
told AS (SELECT *, CASE WHEN sum(tokens) OVER w > 2000 AND count(*) OVER w > 1 THEN path ELSE lang END AS chunk_key FROM parts WINDOW w AS (PARTITION BY change_id, lang)),
sized AS (SELECT *, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens FROM d WHERE text IS NOT NULL),
tree AS (SELECT *, CASE WHEN sum(tokens) OVER w > 2000 AND count(*) OVER w > 1 THEN path ELSE lang END AS chunk_key FROM sized WINDOW w AS (PARTITION BY change_id, lang))"""
_PARTS = f"""{_SOURCES.replace('WITH', 'WITH RECURSIVE', 1)},
lines AS MATERIALIZED (SELECT repo_id, file_ord, path, CAST(i AS BIGINT) AS i, string_split(content, chr(10))[i] AS line, length(string_split(content, chr(10))[i]) AS n FROM (SELECT *, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS i FROM RUNS WHERE tokens > 200)),
pack AS (SELECT repo_id, file_ord, i, CAST(0 AS BIGINT) AS part_ord, n + 1 AS size FROM lines WHERE i = 1
  UNION ALL SELECT l.repo_id, l.file_ord, l.i, CASE WHEN ceil((p.size + l.n + 1) / 4.0) > 200 THEN p.part_ord + 1 ELSE p.part_ord END, CASE WHEN ceil((p.size + l.n + 1) / 4.0) > 200 THEN l.n + 1 ELSE p.size + l.n + 1 END
  FROM pack p JOIN lines l ON l.repo_id = p.repo_id AND l.file_ord = p.file_ord AND l.i = p.i + 1),
parts AS (SELECT repo_id, file_ord, CAST(part_ord AS INTEGER) AS part_ord, path || ':' || min(i) || '-' || max(i) AS path, string_agg(line, chr(10) ORDER BY i) || chr(10) AS content, CAST(ceil((sum(n) + count(*)) / 4.0) AS BIGINT) AS tokens FROM pack JOIN lines USING (repo_id, file_ord, i) GROUP BY repo_id, file_ord, lines.path, part_ord
  UNION ALL SELECT repo_id, file_ord, 0, path, content, tokens FROM RUNS WHERE tokens <= 200)"""


def _chars(c: str) -> str:
    """The length of a commit's rendered diff."""
    return f"length('### ' || substr({c}.sha, 1, 8) || ' — ' || {c}.message || chr(10) || chr(10) || '```diff' || chr(10) || 'diff --git a/f b/f' || CAST({c}.seq % 7 AS VARCHAR) || chr(10) || '+' || {c}.message || chr(10) || '```')"


def _g(select: str) -> str:
    return _GRAPH + select


ORACLES = {
    "commit_edges": _g("SELECT * FROM edges"),
    "with_children": _g("SELECT c.repo_id, c.sha, coalesce(string_agg(e.child, ',' ORDER BY e.child_log_pos), '') AS children FROM commits c LEFT JOIN edges e ON e.repo_id = c.repo_id AND e.parent = c.sha GROUP BY ALL"),
    "roots_merges_leaves": _g("SELECT repo_id, sha, parent0 IS NULL AND parent1 IS NULL AS is_root, parent1 IS NOT NULL AND parent0 IS NOT NULL AS is_merge, NOT EXISTS (SELECT 1 FROM edges e WHERE e.repo_id = c.repo_id AND e.parent = c.sha) AS is_leaf FROM commits c"),
    "mark_trunk": _g("SELECT * FROM trunk"),
    "trunk_path": _g("SELECT * FROM path"),
    "trunk_segments": _g("SELECT repo_id, segment_id, ordinal, sha FROM on_trunk"),
    "branch_segments": _g("SELECT * FROM segments WHERE type <> 'trunk'"),
    "segment_commits": _g("SELECT * FROM members"),
    "commit_owner": _g("SELECT * FROM owner"),
    "segment_deps": _g("SELECT * FROM deps"),
    "segment_levels": _g("SELECT repo_id, segment_id, max(level) AS level FROM chains GROUP BY ALL"),
    "critical_path": _g("SELECT repo_id, max(dist) AS critical_path FROM chains GROUP BY ALL"),
    "ancestors": _g("SELECT * FROM up"),
    "ready_segments": _g("""SELECT a.repo_id, a.segment_id, a.slot FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY creation_ord) AS slot FROM progress p WHERE status = 'pending'
  AND NOT EXISTS (SELECT 1 FROM deps d JOIN progress q ON q.repo_id = d.repo_id AND q.segment_id = d.dep_id WHERE d.repo_id = p.repo_id AND d.segment_id = p.segment_id AND q.status <> 'complete')) a
  JOIN (SELECT repo_id, count(*) FILTER (status = 'in-progress') AS running FROM progress GROUP BY repo_id) r USING (repo_id) WHERE slot <= 4 - running"""),
    "fork_context": _g("SELECT * FROM seeds"),
    "merge_inputs": _g("SELECT * FROM merges"),
    "segment_start_state": _g("SELECT s.repo_id, s.segment_id, coalesce(t.spec, '') AS spec, coalesce(t.changelog, '') AS changelog, t.derived_sha AS parent_sha FROM segments s LEFT JOIN deps d ON d.repo_id = s.repo_id AND d.segment_id = s.segment_id AND d.dep_ord = 0 LEFT JOIN tips t ON t.repo_id = d.repo_id AND t.segment_id = d.dep_id"),
    "commit_windows": _g("SELECT repo_id, segment_id, ordinal, substr(sha, 1, 8) AS sha8, substr(w[1], 1, 8) || '..' || substr(w[-1], 1, 8) AS label FROM plain WHERE segment_id LIKE 'trunk-%'"),
    "context_split": _g("SELECT repo_id, segment_id, ordinal, array_to_string(w[greatest(1, len(w) - 1):], ',') AS \"full\", CASE WHEN len(w) <= 2 THEN '' ELSE array_to_string(w[1:len(w) - 2], ',') END AS context, substr(w[1], 1, 8) || '..' || substr(w[-1], 1, 8) AS label FROM (SELECT repo_id, segment_id, ordinal, w FROM seeded)"),
    "render_context": _g("SELECT x.repo_id, x.segment_id, x.ordinal, string_agg('### ' || substr(x.s, 1, 8) || ' — ' || coalesce(c.message, 'unknown'), chr(10) ORDER BY x.i) AS context_text FROM (SELECT repo_id, segment_id, ordinal, i, w[i] AS s FROM seeded, unnest(range(1, len(w) - 1)) AS u(i)) x LEFT JOIN commits c ON c.repo_id = x.repo_id AND c.sha = x.s GROUP BY ALL"),
    "render_full_diffs": _g("""SELECT repo_id, segment_id, ordinal, CAST(ceil(length(string_agg(t, chr(10) || chr(10) ORDER BY i)) / 4.0) AS BIGINT) AS diff_tokens, string_agg(f, ',' ORDER BY i) AS paths FROM (
  SELECT x.repo_id, x.segment_id, x.ordinal, x.i, 'f' || CAST(c.seq % 7 AS VARCHAR) AS f, '### ' || substr(x.s, 1, 8) || ' — ' || c.message || chr(10) || chr(10) || '```diff' || chr(10) || 'diff --git a/f b/f' || CAST(c.seq % 7 AS VARCHAR) || chr(10) || '+' || c.message || chr(10) || '```' AS t
  FROM (SELECT repo_id, segment_id, ordinal, i, w[i] AS s FROM plain, unnest(range(greatest(1, len(w) - 1), len(w) + 1)) AS u(i)) x JOIN commits c ON c.repo_id = x.repo_id AND c.sha = x.s) GROUP BY ALL"""),
    "step_plan": _g("""SELECT m.repo_id, m.segment_id, m.ordinal, m.sha, CASE WHEN q.segment_id IS NOT NULL AND m.ordinal = 0 THEN 'merge' WHEN c.parent0 IS NULL AND c.parent1 IS NULL THEN 'initial-commit' ELSE 'evolve' END AS step_type,
  CASE WHEN q.segment_id IS NOT NULL AND m.ordinal = 0 OR c.parent0 IS NULL AND c.parent1 IS NULL THEN 'opus' ELSE 'sonnet' END AS model, CASE WHEN q.segment_id IS NOT NULL AND m.ordinal = 0 THEN substr(m.sha, 1, 8) ELSE substr(m.w[1], 1, 8) END || '..' || substr(m.sha, 1, 8) AS label,
  CAST(ceil((chars(c) + coalesce(2 + chars(b), 0)) / 4.0) AS BIGINT) AS diff_tokens
  FROM (SELECT u.repo_id, u.segment_id, u.ordinal, u.sha, array_agg(u.sha) OVER (PARTITION BY u.repo_id, u.segment_id, v.segment_id IS NOT NULL AND u.ordinal = 0 ORDER BY u.ordinal ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS w
    FROM (SELECT repo_id, segment_id, ordinal, sha FROM members UNION ALL SELECT repo_id, segment_id, ordinal, sha FROM seeds) u LEFT JOIN merges v ON v.repo_id = u.repo_id AND v.segment_id = u.segment_id) m
  JOIN commits c ON c.repo_id = m.repo_id AND c.sha = m.sha LEFT JOIN merges q ON q.repo_id = m.repo_id AND q.segment_id = m.segment_id LEFT JOIN commits b ON b.repo_id = m.repo_id AND b.sha = m.w[-2] WHERE m.ordinal >= 0""").replace("chars(c)", _chars("c")).replace("chars(b)", _chars("b")),
    "estimate_tokens": "SELECT doc_id, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens FROM documents",
    "parse_diff": "SELECT doc_id // 10 AS change_id, lang || '/doc' || doc_id || '.md' AS path, CAST(ceil(length('diff --git a/' || lang || '/doc' || doc_id || '.md b/' || lang || '/doc' || doc_id || '.md' || chr(10) || coalesce(text, '') || chr(10)) / 4.0) AS BIGINT) AS tokens FROM documents WHERE lang IS NOT NULL",
    "changed_paths": "SELECT doc_id // 10 AS change_id, string_agg(lang || '/doc' || doc_id || '.md', ',' ORDER BY doc_id) AS paths FROM documents GROUP BY ALL",
    "filter_ignored": f"{_FILES} SELECT change_id, path, tokens FROM files WHERE {_KEPT}",
    "is_binary_path": f"{_FILES} SELECT lower(path) LIKE '%.png' AS is_binary, regexp_extract(path, '[^/]*$') AS name, count(*) AS n FROM files GROUP BY ALL",
    "group_by_directory": f"{_FILES} SELECT change_id, {_KEY} AS chunk_key, count(*) AS n_files, CAST(sum(tokens) AS BIGINT) AS total_tokens, min(file_ord) AS first_ord FROM files GROUP BY ALL",
    "split_oversized": f"{_FILES.replace('WITH', 'WITH RECURSIVE', 1)}, {_split('files', 2000)} SELECT change_id, chunk_key, count(*) AS n_files, CAST(sum(tokens) AS BIGINT) AS total_tokens FROM last GROUP BY ALL",
    "chunk_diff": f"{_FILES.replace('WITH', 'WITH RECURSIVE', 1)}, kept AS (SELECT * FROM files WHERE {_KEPT} QUALIFY sum(tokens) OVER (PARTITION BY change_id) > 10000), {_split('kept', 10000)} SELECT change_id, chunk_key, count(*) AS n_files, CAST(sum(tokens) AS BIGINT) AS total_tokens FROM last GROUP BY ALL",
    "parse_changelog": f"{_CHANGES} SELECT conv_id, count(*) AS n_entries, count(*) FILTER (turn % 4 <> 3) AS n_shas, min(s) FILTER (turn % 4 <> 3) AS first_sha FROM e2 GROUP BY conv_id",
    "unique_entries": f"{_CHANGES} SELECT conv_id, sha8, sha1(entry) AS digest FROM own",
    "merge_changelogs": f"{_CHANGES}, o AS (SELECT conv_id, string_agg(entry, '' ORDER BY turn) AS own FROM own GROUP BY conv_id), m AS (SELECT conv_id, text || coalesce(own, '') || chr(10) || '## ' || substr(sha1(CAST(conv_id AS VARCHAR)), 1, 8) || ' (merge)' || chr(10) || chr(10) || 'merged' || chr(10) AS text FROM trunk LEFT JOIN o USING (conv_id)) SELECT conv_id, length(text) AS n_chars, sha1(text) AS digest FROM m",
    "running_changelog": _g("SELECT repo_id, segment_id, '# ' || segment_id || string_agg(chr(10) || substr(sha, 1, 8) || chr(10), '' ORDER BY ordinal) AS text FROM members GROUP BY repo_id, segment_id"),
    "resolve_module": f"{_MODULES} SELECT * FROM found",
    "relevant_specs": f"{_MODULES} SELECT * FROM relevant",
    "assemble_module_spec": f"""{_MODULES}, texts AS (SELECT change_id, '## Master Specification' || chr(10) || chr(10) || 'module _master.md' || coalesce(chr(10) || chr(10) || '## Relevant Module Specifications' || chr(10) || chr(10)
  || string_agg('### Module: ' || module_path || chr(10) || chr(10) || content || chr(10), chr(10) ORDER BY module_path) FILTER (module_path <> '_master.md'), '') AS text FROM relevant GROUP BY change_id) SELECT change_id, length(text) AS n_chars, sha1(text) AS digest FROM texts""",
    "spec_total_tokens": f"{_SOURCES} SELECT repo_id, CAST(sum(tokens) AS BIGINT) AS total_tokens FROM src GROUP BY repo_id",
    "upsert_modules": f"{_SOURCES} SELECT repo_id, split_part(path, '/', 1) AS module_path, sha1(arg_max(content, file_ord)) AS content, CAST(max(file_ord) AS BIGINT) AS version FROM src GROUP BY ALL",
    "parse_responses": f"{_RESPONSES} SELECT conv_id, attempt, CASE k WHEN 1 THEN 's' || conv_id WHEN 2 THEN 't' WHEN 4 THEN '' END AS spec, CASE k WHEN 1 THEN 0.25 WHEN 2 THEN 0.5 WHEN 4 THEN 0.0 END::DOUBLE AS cost, CASE k WHEN 1 THEN 'x' END AS session_id, CASE k WHEN 0 THEN 'bad-json' WHEN 3 THEN 'is-error' END AS error FROM t",
    "first_valid_attempt": f"{_RESPONSES}, c AS (SELECT conv_id, attempt, CASE k WHEN 0 THEN 'bad-json' WHEN 3 THEN 'is-error' WHEN 4 THEN 'spec must not be empty' END AS code FROM t WHERE attempt <= 3), a AS (SELECT conv_id, min(attempt) FILTER (code IS NULL) AS first, max(attempt) AS last FROM c GROUP BY conv_id) SELECT a.conv_id, coalesce(first, last) AS attempt, first IS NOT NULL AS ok, CASE WHEN first IS NULL THEN c.code END AS last_error FROM a JOIN c ON c.conv_id = a.conv_id AND c.attempt = a.last",
    "segment_progress": _g("SELECT s.repo_id, s.segment_id, CASE WHEN s.creation_ord < 2 THEN 'complete' WHEN count(l.seq) > 0 THEN 'in-progress' ELSE 'pending' END AS status, count(l.seq) AS steps, arg_max(l.spec, l.seq) AS spec, arg_max(l.changelog, l.seq) AS changelog FROM segments s LEFT JOIN ledger l USING (repo_id, segment_id) GROUP BY s.repo_id, s.segment_id, s.creation_ord"),
    "ledger_totals": f"{_STEPS} SELECT repo_id, count(*) AS total_steps, CAST(sum(CAST(diff_tokens / 1000000 AS DECIMAL(18,6))) + coalesce(sum(CAST(diff_tokens / 1000000 AS DECIMAL(18,6))) FILTER (step_no % 5 = 0), 0) AS DECIMAL(28,6)) AS total_cost FROM steps GROUP BY repo_id",
    "sha_map_from_log": _g("SELECT repo_id, original_sha, arg_min(sha, log_pos) AS derived_sha FROM tagged WHERE original_sha IS NOT NULL GROUP BY ALL"),
    "find_anchor": _g("SELECT repo_id, arg_min(sha, log_pos) FILTER (original_sha IS NOT NULL) AS anchor, arg_min(original_sha, log_pos) FILTER (original_sha IS NOT NULL) AS original_sha, min(log_pos) FILTER (original_sha IS NOT NULL) AS commits_beyond_anchor FROM tagged WHERE log_pos < 100 GROUP BY repo_id"),
    "dangling_steps": _g("SELECT repo_id, sha FROM commits WHERE seq % 9 = 4"),
    "valid_prefix": _g("SELECT repo_id, segment_id, segment_id <> 'trunk-1' AS valid FROM ledger WHERE NOT (segment_id = 'trunk-1' AND seq = 0) GROUP BY ALL"),
    "seed_progress": _g("""SELECT x.repo_id, x.segment_id, x.n_done, x.n_commits, count(*) FILTER ((x.n_done < x.n_commits OR m.ordinal = x.n_commits - 1) AND p.original_sha IS NULL) AS unmapped, CASE WHEN x.n_done = x.n_commits THEN 'complete' ELSE 'in-progress' END AS status
  FROM (SELECT m.repo_id, m.segment_id, count(u.sha) AS n_done, count(*) AS n_commits FROM members m LEFT JOIN up u USING (repo_id, sha) GROUP BY ALL) x JOIN members m ON m.repo_id = x.repo_id AND m.segment_id = x.segment_id AND m.ordinal < x.n_done
  LEFT JOIN mapping p ON p.repo_id = m.repo_id AND p.original_sha = m.sha GROUP BY ALL"""),
    "remaining_work": _g("SELECT m.repo_id, m.segment_id, count(*) AS remaining FROM members m LEFT JOIN ledger l ON l.repo_id = m.repo_id AND l.segment_id = m.segment_id AND l.original_sha = m.sha WHERE l.seq IS NULL GROUP BY ALL"),
    "segment_topo_order": _g("SELECT repo_id, segment_id, row_number() OVER (PARTITION BY repo_id ORDER BY level, creation_ord) - 1 AS topo_pos FROM (SELECT repo_id, segment_id, max(level) AS level FROM chains GROUP BY ALL) JOIN segments USING (repo_id, segment_id)"),
    "overall_head": _g("SELECT t.repo_id, arg_max(t.derived_sha, s.creation_ord) AS derived_sha FROM tips t JOIN segments s ON s.repo_id = t.repo_id AND s.segment_id = t.segment_id WHERE s.type = 'trunk' GROUP BY ALL"),
    "reset_segments": _g("SELECT l.repo_id, l.segment_id, l.seq, l.original_sha FROM ledger l JOIN segments s ON s.repo_id = l.repo_id AND s.segment_id = l.segment_id WHERE s.creation_ord >= 2"),
    "segment_tips": _g("SELECT * FROM tips"),
    "derived_parents": _g("""SELECT m.repo_id, m.segment_id, m.ordinal, CASE WHEN m.ordinal > 0 THEN coalesce(m.before, '') WHEN q.segment_id IS NOT NULL AND a.derived_sha IS NOT NULL AND b.derived_sha IS NOT NULL THEN a.derived_sha || ',' || b.derived_sha ELSE coalesce(t.derived_sha, '') END AS parents
  FROM (SELECT x.*, lag(y.derived_sha) OVER (PARTITION BY x.repo_id, x.segment_id ORDER BY x.ordinal) AS before FROM members x LEFT JOIN mapping y ON y.repo_id = x.repo_id AND y.original_sha = x.sha) m
  LEFT JOIN merges q ON q.repo_id = m.repo_id AND q.segment_id = m.segment_id LEFT JOIN tips a ON a.repo_id = q.repo_id AND a.segment_id = q.trunk_dep LEFT JOIN tips b ON b.repo_id = q.repo_id AND b.segment_id = q.branch_dep
  LEFT JOIN deps d ON d.repo_id = m.repo_id AND d.segment_id = m.segment_id AND d.dep_ord = 0 LEFT JOIN tips t ON t.repo_id = d.repo_id AND t.segment_id = d.dep_id"""),
    "record_merges": _g("SELECT q.repo_id, q.merge_sha, p.derived_sha, q.trunk_dep, q.branch_dep FROM merges q JOIN mapping p ON p.repo_id = q.repo_id AND p.original_sha = q.merge_sha"),
    "resume_mode": _g("""SELECT repo_id, mode, total_commits, n_segments, completed, total_steps - completed AS remaining, CAST(CASE mode WHEN 'state-file' THEN cost WHEN 'derived-branch' THEN 0 END AS DECIMAL(28,6)) AS cost_so_far, CASE WHEN mode = 'derived-branch' THEN beyond END AS commits_beyond_anchor
  FROM (SELECT *, CASE mode WHEN 'state-file' THEN steps WHEN 'derived-branch' THEN coalesce(n_done, 0) END AS completed FROM (
    SELECT c.repo_id, c.total_commits, s.n_segments, s.total_steps, l.steps, l.cost, a.beyond, d.n_done, CASE WHEN c.repo_id % 3 = 0 AND l.steps IS NOT NULL THEN 'state-file' WHEN c.repo_id % 3 <> 2 AND a.beyond IS NOT NULL THEN 'derived-branch' ELSE 'fresh' END AS mode
    FROM (SELECT repo_id, count(*) AS total_commits FROM commits GROUP BY repo_id) c JOIN (SELECT repo_id, count(*) AS n_segments, CAST(sum(n_commits) AS BIGINT) AS total_steps FROM segments GROUP BY repo_id) s ON s.repo_id = c.repo_id
    LEFT JOIN (SELECT repo_id, count(*) AS steps, (count(*) + count(*) FILTER (seq % 5 = 0)) * 0.01 AS cost FROM ledger GROUP BY repo_id) l ON l.repo_id = c.repo_id
    LEFT JOIN (SELECT repo_id, min(log_pos) AS beyond FROM tagged WHERE original_sha IS NOT NULL AND log_pos < 100 GROUP BY repo_id) a ON a.repo_id = c.repo_id
    LEFT JOIN (SELECT m.repo_id, count(*) AS n_done FROM members m JOIN up u ON u.repo_id = m.repo_id AND u.sha = m.sha GROUP BY m.repo_id) d ON d.repo_id = c.repo_id))"""),
    "segment_type_stats": _g("SELECT repo_id, type, count(*) AS n_segments, CAST(sum(n_commits) AS BIGINT) AS n_commits FROM segments GROUP BY GROUPING SETS ((repo_id, type), (repo_id))"),
    "model_distribution": _g("SELECT * FROM models"),
    "cost_estimate": _g("SELECT * FROM costs"),
    "setup_stats": _g("""SELECT *, fmt(wall_low) || ' - ' || fmt(wall_high) AS wall_text FROM (SELECT *, CAST(45 * rounds AS BIGINT) AS wall_low, CAST(90 * rounds AS BIGINT) AS wall_high FROM (
  SELECT x.repo_id, n_segments, total_steps, by_type, by_model, merge_points, coalesce(done, 0) AS done, coalesce(done, 0) > 0 AS is_resume, CAST(coalesce(done, 0) * 0.01 AS DECIMAL(28,6)) AS cost_so_far, greatest(0, total_steps - coalesce(done, 0)) AS remaining, critical_path, low, high, greatest(critical_path, ceil(greatest(0, total_steps - coalesce(done, 0)) / 4.0)) AS rounds
  FROM (SELECT repo_id, count(*) AS n_segments, CAST(sum(n_commits) AS BIGINT) AS total_steps FROM segments GROUP BY repo_id) x LEFT JOIN done USING (repo_id) JOIN (SELECT repo_id, max(dist) AS critical_path FROM chains GROUP BY repo_id) k USING (repo_id) JOIN costs USING (repo_id)
  JOIN (SELECT repo_id, string_agg(type || ':' || n || ':' || c, ',' ORDER BY type) AS by_type FROM (SELECT repo_id, type, count(*) AS n, CAST(sum(n_commits) AS BIGINT) AS c FROM segments GROUP BY ALL) GROUP BY repo_id) USING (repo_id)
  JOIN (SELECT repo_id, string_agg(model || ':' || steps, ',' ORDER BY model) AS by_model FROM models GROUP BY repo_id) USING (repo_id)
  JOIN (SELECT m.repo_id, count(*) FILTER (c.parent1 IS NOT NULL AND c.parent0 IS NOT NULL AND s.type = 'trunk') AS merge_points FROM members m JOIN segments s ON s.repo_id = m.repo_id AND s.segment_id = m.segment_id JOIN commits c ON c.repo_id = m.repo_id AND c.sha = m.sha GROUP BY m.repo_id) USING (repo_id)))""").replace("SELECT *, fmt(wall_low)", "SELECT * EXCLUDE (rounds), fmt(wall_low)"),
    "trigger_every_n": f"{_STEPS} SELECT repo_id, step_no, step_no % 3 = 0 AS fires FROM steps",
    "trigger_every_n_trunk": f"{_STEPS} SELECT repo_id, step_no, segment_type = 'trunk' AND (count(*) FILTER (segment_type = 'trunk') OVER (PARTITION BY repo_id ORDER BY step_no)) % 3 = 0 AS fires FROM steps",
    "trigger_token_count": f"""{_STEPS.replace('WITH', 'WITH RECURSIVE', 1)}, f AS (SELECT repo_id, step_no, diff_tokens >= 800000 AS fires, CASE WHEN diff_tokens >= 800000 THEN 0 ELSE diff_tokens END AS total FROM steps WHERE step_no = 1
  UNION ALL SELECT s.repo_id, s.step_no, f.total + s.diff_tokens >= 800000, CASE WHEN f.total + s.diff_tokens >= 800000 THEN 0 ELSE f.total + s.diff_tokens END FROM f JOIN steps s ON s.repo_id = f.repo_id AND s.step_no = f.step_no + 1) SELECT repo_id, step_no, fires FROM f""",
    "reconciliation_epochs": f"{_STEPS} SELECT s.repo_id, s.step_no, (s.step_no - 1) // 3 AS epoch, p.original_sha AS since_sha FROM steps s LEFT JOIN steps p ON p.repo_id = s.repo_id AND p.step_no = ((s.step_no - 1) // 3) * 3",
    "admit_within_budget": f"""{_SOURCES.replace('WITH', 'WITH RECURSIVE', 1)}, f AS (SELECT repo_id, file_ord, tokens <= 20000 AS admitted, CASE WHEN tokens <= 20000 THEN tokens ELSE 0 END AS total FROM src WHERE file_ord = 1
  UNION ALL SELECT s.repo_id, s.file_ord, f.total + s.tokens <= 20000, CASE WHEN f.total + s.tokens <= 20000 THEN f.total + s.tokens ELSE f.total END FROM f JOIN src s ON s.repo_id = f.repo_id AND s.file_ord = f.file_ord + 1) SELECT repo_id, path, tokens, admitted FROM f JOIN src USING (repo_id, file_ord)""".replace("SELECT repo_id, path, tokens", "SELECT src.repo_id, src.path, src.tokens"),
    "trigger_none": f"{_STEPS} SELECT repo_id, step_no, false AS fires FROM steps",
    "trigger_every_n_trunk_mixed": f"""{_STEPS.replace('WITH', 'WITH RECURSIVE', 1)}, k AS (SELECT *, CAST(segment_type = 'trunk' AS BIGINT) AS one FROM steps),
f AS (SELECT repo_id, step_no, one AS trunk, CAST(0 AS BIGINT) AS last, false AS fires FROM k WHERE step_no = 1
  UNION ALL SELECT k.repo_id, k.step_no, f.trunk + k.one, CASE WHEN k.one = 1 AND f.trunk + k.one - f.last >= 3 THEN k.step_no ELSE f.last END, k.one = 1 AND f.trunk + k.one - f.last >= 3 FROM f JOIN k ON k.repo_id = f.repo_id AND k.step_no = f.step_no + 1) SELECT repo_id, step_no, fires FROM f""",
    "resolve_first": f"{_MODULES} SELECT f.change_id, coalesce(arg_min(r.module_path, f.file_ord) FILTER (r.module_path <> '_master.md'), '_master.md') AS module_path FROM files f JOIN found r USING (path) GROUP BY f.change_id",
    "commit_message": _g("SELECT p.repo_id, p.sha, 'spec: ' || lower(c.message) || chr(10) || chr(10) || 'Original: ' || p.sha || ' \"' || c.message || '\"' || chr(10) || 'Window: ' || substr(p.w[1], 1, 8) || '..' || substr(p.sha, 1, 8) || chr(10) || 'Model: sonnet' AS text FROM plain p JOIN commits c ON c.repo_id = p.repo_id AND c.sha = p.sha WHERE p.segment_id LIKE 'trunk-%'"),
    "read_diff_chunks": f"{_CHUNKS} SELECT change_id, chunk_key, count(*) AS n_files, CAST(sum(tokens) AS BIGINT) AS total_tokens FROM told SEMI JOIN accepted USING (change_id) GROUP BY ALL",
    "reconciliation_source": f"""{_CHUNKS} SELECT change_id, mode, chunk_key, count(*) AS n_files, CAST(sum(tokens) AS BIGINT) AS total_tokens FROM (SELECT change_id, 'diff' AS mode, chunk_key, tokens FROM told SEMI JOIN accepted USING (change_id)
  UNION ALL SELECT change_id, 'tree', chunk_key, tokens FROM tree ANTI JOIN accepted USING (change_id)) GROUP BY ALL""",
    "render_source_chunk": f"{_CHUNKS} SELECT change_id, chunk_key, 'source/' || replace(chunk_key, '/', '--') || '.txt' AS file_name, sha1(string_agg('--- ' || path || ' ---' || chr(10) || text, chr(10) || chr(10) ORDER BY doc_id)) AS digest FROM tree GROUP BY change_id, chunk_key",
    "split_large_file": f"{_PARTS.replace('RUNS', 'src')} SELECT repo_id, file_ord, part_ord, path, sha1(content) AS digest, tokens FROM parts",
    "read_tree_chunks": f"""{_PARTS.replace('RUNS', 'src')}, sums AS MATERIALIZED (SELECT s.repo_id, s.file_ord, s.tokens, p.adds FROM src s JOIN (SELECT repo_id, file_ord, sum(tokens) AS adds FROM parts GROUP BY ALL) p USING (repo_id, file_ord)),
adm AS (SELECT repo_id, file_ord, tokens <= 20000 AS yes, CASE WHEN tokens <= 20000 THEN adds ELSE 0 END AS total FROM sums WHERE file_ord = 1
  UNION ALL SELECT s.repo_id, s.file_ord, adm.total + s.tokens <= 20000, CASE WHEN adm.total + s.tokens <= 20000 THEN adm.total + s.adds ELSE adm.total END FROM adm JOIN sums s ON s.repo_id = adm.repo_id AND s.file_ord = adm.file_ord + 1),
kept AS (SELECT parts.* FROM parts JOIN adm USING (repo_id, file_ord) WHERE adm.yes),
grouped AS (SELECT *, split_part(path, '/', 1) AS top, sum(tokens) OVER w AS total, min(path) OVER w AS a, max(path) OVER w AS b FROM kept WINDOW w AS (PARTITION BY repo_id, split_part(path, '/', 1)))
SELECT repo_id, CASE WHEN total > 2000 AND a <> b THEN path ELSE top END AS chunk_key, count(*) AS n_files, CAST(sum(tokens) AS BIGINT) AS total_tokens FROM grouped GROUP BY ALL""",
    "diffstat": "SELECT doc_id // 10 AS change_id, lang AS path, CAST(sum(1) AS BIGINT) AS added, CAST(sum(length(text) - length(replace(text, chr(10), ''))) AS BIGINT) AS removed FROM documents WHERE text IS NOT NULL GROUP BY ALL",
}


def _duration(s: str) -> str:
    return f"(CASE WHEN {s} < 60 THEN {s} || 's' WHEN {s} < 3600 THEN ({s} // 60) || 'm' WHEN {s} % 3600 < 60 THEN ({s} // 3600) || 'h' ELSE ({s} // 3600) || 'h ' || ({s} % 3600 // 60) || 'm' END)"


ORACLES["setup_stats"] = ORACLES["setup_stats"].replace("fmt(wall_low)", _duration("wall_low")).replace("fmt(wall_high)", _duration("wall_high"))
