"""The registered queries as DuckDB SQL, written from the meaning of each operator."""

from __future__ import annotations

from ..constants import PROTECTED_UNIX, category_by_extension
from .views import duckdb_with

GAP = 12 * 3600 * 1_000_000
ONE_ROOT_GAP = 240 * 1_000_000


def _extension_table() -> str:
    rows = ", ".join(f"('{ext}', '{cat}')" for ext, cat in category_by_extension().items())
    return f"ext_cat(ext, cat) AS (VALUES {rows})"


def _q(views: str, body: str, extra: str = "", recursive: bool = False) -> str:
    head = duckdb_with(*views.split(), recursive=recursive)
    more = [part for part in (extra,) if part]
    if head == "WITH":
        head = f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(more)}" if more else ""
    elif more:
        head = head + ",\n" + ", ".join(more)
    return f"{head}\n{body}".strip()


_EXT = _extension_table()

# the winning rule per file, by joining every rule and ranking the hits
_WINNER = """
hits AS (SELECT f.id AS file_id, f.name, f.extension, r.id AS rule_id, r.name AS rule_name, r.category, r.target_folder, r.priority
         FROM files_v f JOIN rules_v r ON r.enabled AND CASE r.match_type
           WHEN 'extension' THEN lower(f.extension) = lower(r.pattern)
           WHEN 'glob' THEN lower(f.name) GLOB lower(r.pattern)
           ELSE regexp_matches(f.name, r.pattern, 'i') END),
winner AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY priority DESC, rule_id) AS rk FROM hits) WHERE rk = 1)"""
_CLASSIFIED = f"""
{_WINNER}, {_EXT},
classified AS (SELECT f.id, f.path, f.name, f.extension, coalesce(w.category, e.cat, 'Others') AS category,
                      coalesce(w.target_folder, e.cat, 'Others') AS target_folder,
                      CAST(CASE WHEN w.file_id IS NOT NULL THEN 1.0 WHEN e.cat IS NOT NULL THEN 0.95 ELSE 0.5 END AS DOUBLE) AS confidence,
                      w.rule_name
               FROM files_v f LEFT JOIN winner w ON w.file_id = f.id LEFT JOIN ext_cat e ON e.ext = lower(f.extension))"""

# what the patterns of many_rules_v say about numbers and endings of names
_MANY_HITS = """
r AS (SELECT *, regexp_extract_all(pattern, '[0-9]+') AS n, regexp_replace(lower(pattern), '[0-9]+', '', 'g') AS form FROM many_rules_v WHERE enabled),
f AS (SELECT id AS file_id, name AS file_name, regexp_extract(name, '^Cust([0-9]+)-([0-9]+)[.](.*)$', ['c', 'o', 'e']) AS p FROM order_files_v),
hits AS (
  SELECT f.*, r.* FROM f JOIN r ON match_type = 'extension' AND '.' || p.e = lower(pattern)
  UNION ALL SELECT f.*, r.* FROM f JOIN r ON form = '*-.?*' AND p.o = n[1]
  UNION ALL SELECT f.*, r.* FROM f JOIN r ON form = 'cust-*' AND p.c = n[1]
  UNION ALL SELECT f.*, r.* FROM f JOIN r ON match_type = 'regex' AND p.c = n[2] AND p.e IN ('low', 'high')
  UNION ALL SELECT f.*, r.* FROM f JOIN r ON form = '*-.medium' AND p.o = n[1] AND p.e = 'medium'
  UNION ALL SELECT f.*, r.* FROM f JOIN r ON form = '*t-*' AND p.c = n[1] AND starts_with(p.o, n[2]))"""

_URL_PATH = "regexp_replace(url, '^https?://[^/]+', '')"


def _bytes(n: str) -> str:
    return f"""CASE WHEN {n} IS NULL THEN '—' WHEN {n} < 1024 THEN CAST({n} AS VARCHAR) || ' B'
 WHEN {n} < 1048576 THEN CAST(CAST(round({n} / 1024.0::DOUBLE, 1) AS DECIMAL(20,1)) AS VARCHAR) || ' KB'
 WHEN {n} < 1073741824 THEN CAST(CAST(round({n} / 1048576.0::DOUBLE, 1) AS DECIMAL(20,1)) AS VARCHAR) || ' MB'
 ELSE CAST(CAST(round({n} / 1073741824.0::DOUBLE, 2) AS DECIMAL(20,2)) AS VARCHAR) || ' GB' END"""


def _under(path: str, roots: list[str]) -> str:
    return "(" + " OR ".join(f"{path} = '{r}' OR starts_with({path}, '{r}/')" for r in roots) + ")"


_PLACE = "CASE WHEN starts_with(path, '/home/../boot/') THEN substr(path, 9) ELSE path END"

_HASHED = """
hashed AS (SELECT id, path, size, sha256(array_slice(encode(text), 1, 65536)) AS head_hash, sha256(encode(text)) AS hash
           FROM files_text_v)"""
_GROUPS = f"""
{_HASHED},
groups AS (SELECT size, hash, count(*) AS n, min(id) AS keep_id FROM hashed WHERE size >= 1024
           GROUP BY size, hash HAVING count(*) > 1)"""
_MEMBERS = f"""
{_GROUPS},
members AS (SELECT h.hash AS fingerprint, h.size, h.id, h.path, g.n,
                   row_number() OVER (PARTITION BY h.size, h.hash ORDER BY h.id) AS rank
            FROM hashed h JOIN groups g ON g.size = h.size AND g.hash = h.hash)"""

# name parts of a request
_STEM = "CASE WHEN regexp_matches(name, '^.+[.][^.]+$') THEN regexp_replace(name, '[.][^.]+$', '') ELSE name END"
_SUFFIX = "regexp_extract(name, '^.+([.][^.]+)$', 1)"


def _requests(source: str, folder: str, where: str = "TRUE") -> str:
    return f"""
req AS (SELECT id, path AS source, {folder} AS dest_dir, name, {_STEM} AS stem, {_SUFFIX} AS suffix,
               regexp_replace(name, '_\\(\\d+\\)', '', 'g') AS family, {where} AS found FROM {source})"""


_CANDIDATE = "CASE WHEN i = 0 THEN r.name ELSE r.stem || '_(' || CAST(i AS VARCHAR) || ')' || r.suffix END"


def _sequential(requests: str) -> str:
    """The sequential rule itself: in every folder and name family, one file after the other by id."""
    return f"""
{requests},
ordered AS (SELECT *, row_number() OVER (PARTITION BY dest_dir, family ORDER BY id) AS rn FROM req WHERE found),
start AS (SELECT o.dest_dir, o.family, coalesce(any_value(e.names), []) AS held
          FROM (SELECT DISTINCT dest_dir, family FROM ordered) o
          LEFT JOIN (SELECT dest_dir, regexp_replace(name, '_\\(\\d+\\)', '', 'g') AS family, list(name) AS names
                     FROM existing_v GROUP BY ALL) e ON e.dest_dir = o.dest_dir AND e.family = o.family
          GROUP BY ALL),
sim AS (SELECT dest_dir, family, CAST(0 AS BIGINT) AS rn, held, CAST(NULL AS BIGINT) AS id, CAST(NULL AS BIGINT) AS number
        FROM start
        UNION ALL
        SELECT dest_dir, family, rn,
               list_append(held, CASE WHEN number = 0 THEN name ELSE stem || '_(' || CAST(number AS VARCHAR) || ')' || suffix END),
               id, number
        FROM (SELECT s.dest_dir, s.family, r.rn, s.held, r.id, r.name, r.stem, r.suffix,
                     list_filter(range(0, 1000), lambda i: NOT list_contains(s.held, {_CANDIDATE}))[1] AS number
              FROM sim s JOIN ordered r ON r.dest_dir = s.dest_dir AND r.family = s.family AND r.rn = s.rn + 1)),
plan AS (SELECT r.id, r.source,
                CASE WHEN NOT r.found THEN r.dest_dir ELSE r.dest_dir || '/' ||
                     CASE WHEN s.number = 0 THEN r.name ELSE r.stem || '_(' || CAST(s.number AS VARCHAR) || ')' || r.suffix END
                END AS destination,
                r.found AS success, CASE WHEN NOT r.found THEN 'Source file not found' END AS error,
                r.found AND coalesce(s.number > 0, false) AS was_renamed
         FROM req r LEFT JOIN sim s ON s.id = r.id)"""


_ORGANIZED = _sequential(_requests("(SELECT * FROM catalog_v WHERE scan_session_id = 2 AND category IN ('Documents', 'Audio', 'Others'))", "'/org/' || category"))


def _preview(where: str = "scan_session_id <> 3") -> str:
    return f"""
{_requests("catalog_v", "'/org/' || category", where)},
held AS (SELECT dest_dir, list(name) AS names FROM existing_v GROUP BY dest_dir),
numbered AS (SELECT r.*, CASE WHEN h.names IS NULL THEN 0 ELSE
                    list_filter(range(0, 1000), lambda i: NOT list_contains(h.names, {_CANDIDATE}))[1] END AS number
             FROM req r LEFT JOIN held h ON h.dest_dir = r.dest_dir),
plan AS (SELECT id, source, CASE WHEN NOT found THEN dest_dir ELSE dest_dir || '/' ||
                CASE WHEN number = 0 THEN name ELSE stem || '_(' || CAST(number AS VARCHAR) || ')' || suffix END END AS destination,
                found AS success, CASE WHEN NOT found THEN 'Source file not found' END AS error,
                found AND number > 0 AS was_renamed
         FROM numbered)"""


_LOG = """SELECT id, source AS old_path, destination AS new_path, 'move' AS operation,
       CASE WHEN success THEN 'success' ELSE 'failed' END AS status, CAST(1.7e9 AS DOUBLE) AS timestamp,
       CAST(1 AS BIGINT) AS session_id, error AS error_message FROM plan"""

_UNDONE = """
eligible AS (SELECT l.id AS log_id, u.original_path, l.new_path AS current_path FROM logs_v l
             JOIN undo_v u ON u.log_id = l.id AND u.can_undo),
undo_result AS (
  SELECT log_id, original_path,
         CASE WHEN NOT found THEN current_path WHEN NOT occupied THEN original_path
              ELSE regexp_replace(original_path, '[^/]+$', '') || regexp_extract(current_path, '([^/]*)[.]txt$', 1) || '_(1).txt' END
           AS current_path,
         found AS success, CASE WHEN NOT found THEN 'Source file not found' END AS error, current_path AS moved_from
  FROM (SELECT e.*, EXISTS (SELECT 1 FROM listing_v v WHERE v.path = e.current_path) AS found,
               EXISTS (SELECT 1 FROM listing_v v WHERE v.path = e.original_path) AS occupied FROM eligible e))"""


def _replay(events: str) -> str:
    """Events applied one after the other, root by root: the files of a root are a list of (path, where the row comes from)."""
    here = "list_filter(p.files, lambda f: f.path = e.path)"
    return f"""
known AS (SELECT DISTINCT root, path FROM {events} WHERE path NOT LIKE '%/f3.txt'),
numbered AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY ts, event_id) AS k FROM {events}),
play AS (
  SELECT r.root, CAST(0 AS BIGINT) AS k, coalesce(files, []) AS files FROM (SELECT DISTINCT root FROM {events}) r
  LEFT JOIN (SELECT root, list({{'path': path, 'origin': path, 'moved': false}}) AS files FROM known GROUP BY root) USING (root)
  UNION ALL
  SELECT p.root, e.k, CASE
    WHEN kind = 'deleted' OR kind = 'moved' AND dest_path IS NULL THEN list_filter(p.files, lambda f: f.path <> e.path)
    WHEN kind = 'moved' AND dest_path <> e.path THEN list_append(list_filter(p.files, lambda f: f.path <> e.path AND f.path <> e.dest_path),
      {{'path': e.dest_path, 'origin': {here}[1].origin, 'moved': true}})
    WHEN len({here}) > 0 THEN p.files
    ELSE list_append(p.files, {{'path': e.path, 'origin': CAST(NULL AS VARCHAR), 'moved': true}}) END
  FROM play p JOIN numbered e ON e.root = p.root AND e.k = p.k + 1),
files_left AS (SELECT unnest(files) AS f FROM (SELECT files, row_number() OVER (PARTITION BY root ORDER BY k DESC) AS rk FROM play) WHERE rk = 1),
replayed AS (SELECT f.path AS path, regexp_extract(f.path, '([^/]*)$', 1) AS name, lower(regexp_extract(f.path, '([.][^.]+)$', 1)) AS extension,
  CAST(length(f.origin) AS BIGINT) AS size, CASE WHEN f.path LIKE '%.jpg' AND f.moved THEN 'Images' ELSE 'Documents' END AS category,
  f.origin AS came_from FROM files_left)"""


def _debounced(keys: str, gap: int = GAP, root: str = "root") -> str:
    partition = ", ".join(f"{k}" for k in keys.split())
    return f"""
timed AS (SELECT * REPLACE ({root} AS root), epoch_us(ts) AS us FROM fs_events_v),
gaps AS (SELECT *, lag(us) OVER (PARTITION BY {partition} ORDER BY us, event_id) AS prev FROM timed),
numbered AS (SELECT *, sum(CASE WHEN prev IS NULL OR us > prev + {gap} THEN 1 ELSE 0 END)
                       OVER (PARTITION BY {partition} ORDER BY us, event_id) AS burst FROM gaps),
bounds AS (SELECT {partition}, burst, min(us) AS session_start, max(us) AS session_end FROM numbered GROUP BY {partition}, burst),
lasts AS (SELECT *, row_number() OVER (PARTITION BY {partition}, burst, path ORDER BY us DESC, event_id DESC) AS rk,
                 count(*) OVER (PARTITION BY {partition}, burst, path) AS n_events FROM numbered)"""


def _debounce_result(keys: list[str], gap: int = GAP) -> str:
    on = " AND ".join(f"b.{k} = l.{k}" for k in [*keys, "burst"])
    return f"""SELECT l.root, l.path, l.kind, l.dest_path, l.event_id, l.n_events, b.session_start, b.session_end,
       b.session_end + {gap} AS fires_at FROM lasts l JOIN bounds b ON {on} WHERE l.rk = 1"""


def _top(columns: str, where: str, order: str, limit: int, offset: int = 0) -> str:
    return f"SELECT {columns} FROM catalog_v WHERE {where} ORDER BY {order} LIMIT {limit} OFFSET {offset}"


# changes of a rule, in order: the values that stand at the end, and what was there before where they are not acceptable
_MAINTAINED = """
valid AS (SELECT id, name, pattern, match_type, category, target_folder, priority FROM part_rules_v
          WHERE length(name) BETWEEN 1 AND 128 AND length(pattern) > 0 AND match_type IN ('glob', 'regex', 'extension')
            AND length(category) BETWEEN 1 AND 64 AND length(target_folder) > 0 AND priority BETWEEN 0 AND 1000),
steps AS (SELECT user_id AS id, event_id AS seq, event_type FROM events),
cuts AS (SELECT id, max(seq) FILTER (event_type = 'error') AS cut, max(seq) FILTER (event_type = 'signup') AS put FROM steps GROUP BY id),
merged AS (SELECT coalesce(v.id, c.id) AS id, v.id IS NOT NULL AND c.cut IS NULL AS survives, coalesce(c.put > coalesce(c.cut, -1), false) AS made,
                  v.*, coalesce(c.cut, -1) AS cut FROM valid v FULL OUTER JOIN cuts c ON c.id = v.id),
ended AS (SELECT m.id, CASE WHEN survives THEN m.name END AS name,
                 coalesce((SELECT '*.new' FROM steps s WHERE s.id = m.id AND s.event_type = 'signup' AND s.seq > m.cut LIMIT 1),
                          CASE WHEN survives THEN m.pattern END) AS pattern,
                 coalesce((SELECT CAST(arg_max(seq % 2000, seq) AS INTEGER) FROM steps s WHERE s.id = m.id AND s.event_type = 'click' AND s.seq > m.cut),
                          CASE WHEN survives THEN m.priority ELSE 0 END) AS priority,
                 survives FROM merged m WHERE survives OR made),
judged AS (SELECT *, concat_ws('; ', CASE WHEN NOT survives THEN 'name must have 1 to 128 characters' END,
                  CASE WHEN pattern IS NULL THEN 'pattern must not be empty' END,
                  CASE WHEN NOT survives THEN 'category must have 1 to 64 characters' END,
                  CASE WHEN NOT survives THEN 'target_folder must not be empty' END,
                  CASE WHEN priority NOT BETWEEN 0 AND 1000 THEN 'priority must be between 0 and 1000' END) AS reasons FROM ended),
rejected AS (SELECT id, reasons FROM judged WHERE reasons <> ''),
final AS (SELECT id, name, pattern, priority FROM judged WHERE reasons = ''
          UNION ALL SELECT id, name, pattern, priority FROM valid WHERE id IN (SELECT id FROM rejected))"""

_MERGED = "old_catalog_v o FULL OUTER JOIN incoming n ON n.path = o.path"
_INCOMING = f"""{_EXT},
incoming AS (SELECT f.*, coalesce(e.cat, 'Others') AS category FROM files_v f LEFT JOIN ext_cat e ON e.ext = f.extension)"""

ORACLE = {
    "file_records": _q("files_v", """SELECT f.id, f.path, regexp_extract(f.path, '([^/]*)$', 1) AS name, f.extension, f.size, f.last_modified,
 coalesce(e.cat, 'Others') AS category, false AS is_symlink FROM files_v f LEFT JOIN ext_cat e ON e.ext = f.extension""", _EXT),
    "path_parts": f"""WITH p AS (SELECT page_id, {_URL_PATH} AS path, regexp_extract({_URL_PATH}, '([^/]*)$', 1) AS name FROM pages)
SELECT page_id, name, CASE WHEN regexp_matches(path, '^/[^/]*$') THEN '/' ELSE regexp_replace(path, '/?[^/]*$', '') END AS directory,
 {_STEM} AS stem, {_SUFFIX} AS suffix, lower({_SUFFIX}) AS extension,
 CASE WHEN {_STEM} = '' THEN '/web' ELSE '/web/' || {_STEM} END AS joined, {_STEM} || '_(3)' || {_SUFFIX} AS numbered FROM p""",
    "normalize_paths": f"""SELECT page_id, rtrim(regexp_replace('/web' || {_URL_PATH}, '/+', '/', 'g'), '/') AS path FROM pages""",
    "roots_roundtrip": _q("files_v", """SELECT id, ' ' || d || ',' || path AS root_path, true AS valid, d || '|' || path AS roots, false AS with_blank
FROM (SELECT *, regexp_replace(path, '/[^/]*$', '') AS d FROM files_v)"""),
    "epoch_times": "SELECT event_id, epoch_us(ts) AS micros, strftime(ts, '%Y-%m-%d %H:%M:%S') AS shown FROM events",
    "format_bytes": f"SELECT o_orderkey, {_bytes('(o_orderkey * 97003)')} AS big, {_bytes('o_custkey')} AS small, '—' AS none FROM orders",
    "fingerprints": _q("files_text_v", "SELECT id, head_hash, hash FROM hashed", _HASHED),
    "not_protected": _q("places_v", f"SELECT * FROM places_v WHERE NOT {_under('(' + _PLACE + ')', PROTECTED_UNIX)}"),
    "not_below": _q("files_v", """SELECT id, path FROM files_v f WHERE name <> 'doc_03.py' AND NOT EXISTS (SELECT 1 FROM dirs WHERE starts_with(f.path, d || '/'))""",
                    "dirs AS (SELECT DISTINCT regexp_replace(path, '/[^/]*$', '') AS d FROM files_v WHERE extension = '.exe')"),
    "exclude_prefixes": _q("places_v", "SELECT * FROM places_v WHERE NOT starts_with(path, '/etc') AND NOT starts_with(path, '/home/etc/1-URGENT')"),
    "exclude_prefix_table": _q("files_v prefixes_v", "SELECT id, path, name FROM files_v f WHERE NOT EXISTS (SELECT 1 FROM prefixes_v p WHERE starts_with(f.path, p.prefix))"),
    "longest_prefixes": _q("files_v prefixes_v", """SELECT path, max_by(prefix, length(prefix)) AS prefix FROM files_v f
JOIN (SELECT DISTINCT prefix FROM prefixes_v) p ON starts_with(f.path, p.prefix) GROUP BY path"""),
    "exclude_glob_table": _q("files_v prefixes_v", """SELECT id, path, name FROM files_v f WHERE NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT lower(pattern) AS g FROM prefixes_v)
 WHERE lower(f.path) GLOB g OR lower(f.name) GLOB g)"""),
    "exclude_globs": _q("files_v", r"""SELECT id, path, name FROM files_v WHERE NOT regexp_matches(name, '(?i)^(.*\.xyz|doc_0[0-3].*|tax_20.4\..*)$')
 AND NOT regexp_matches(path, '(?i)^(.*\.xyz|.*/src1/.*)$')"""),
    "classify_default": _q("files_v", """SELECT f.id, f.name, coalesce(e.cat, 'Others') AS category FROM files_v f
LEFT JOIN ext_cat e ON e.ext = f.extension""", _EXT),
    "classify_rules": _q("files_v rules_v", "SELECT id, name, extension, category, target_folder, confidence, rule_name FROM classified", _CLASSIFIED),
    "classify_with_fallback": _q("files_v rules_v", """SELECT id, CASE WHEN confidence = 0.5 AND extension = '' THEN 'Guess ' || substr(name, 1, 3) ELSE category END AS category,
confidence FROM classified""", _CLASSIFIED),
    "rule_hits": _q("files_v rules_v", "SELECT CAST(rule_id AS BIGINT) AS rule_id, rule_name, count(*) AS n_files FROM hits GROUP BY ALL", _WINNER),
    "classify_part_rules": _q("files_v name_rules_v", "SELECT id, name, extension, category, target_folder, confidence, rule_name FROM classified",
                              _CLASSIFIED.replace("rules_v", "name_rules_v").replace(
                                  "regexp_matches(f.name, r.pattern, 'i')",
                                  "regexp_matches(f.name, CASE WHEN starts_with(r.pattern, '(') THEN 'a^' ELSE r.pattern END, 'i')")),
    "classify_many_rules": _q("order_files_v many_rules_v", """SELECT f.file_id AS id, f.file_name AS name, '.' || f.p.e AS extension,
 coalesce(w.category, 'Others') AS category, coalesce(w.target_folder, 'Others') AS target_folder,
 CAST(CASE WHEN w.file_id IS NULL THEN 0.5 ELSE 1 END AS DOUBLE) AS confidence, w.name AS rule_name
FROM f LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY priority DESC, id, name, category, target_folder) AS rk FROM hits) w
  ON w.file_id = f.file_id AND w.rk = 1""", _MANY_HITS),
    "many_rule_hits": _q("order_files_v many_rules_v", "SELECT id AS rule_id, name AS rule_name, count(*) AS n_files FROM hits GROUP BY ALL", _MANY_HITS),
    "rule_quarantine": _q("name_rules_v", "SELECT id, pattern FROM name_rules_v WHERE enabled AND match_type = 'regex' AND starts_with(pattern, '(')"),
    "scan_new_ids": _q("files_v old_catalog_v", """SELECT coalesce(o.id, n.new_id) AS id, coalesce(f.path, o.path) AS path, coalesce(f.size, o.size) AS size,
 CASE WHEN f.path IS NULL THEN o.scan_session_id ELSE 9 END AS scan_session_id
 FROM files_v f FULL OUTER JOIN old_catalog_v o ON o.path = f.path
 LEFT JOIN (SELECT path, (SELECT max(id) FROM old_catalog_v) + row_number() OVER (ORDER BY path) AS new_id FROM files_v
            WHERE path NOT IN (SELECT path FROM old_catalog_v)) n ON n.path = f.path"""),
    "undo_shared_path": _q("shared_logs_v", """SELECT id AS log_id, old_path AS original_path,
 CASE WHEN NOT owner THEN new_path WHEN first THEN old_path ELSE regexp_replace(old_path, '[^/]+$', '') || regexp_extract(new_path, '([^/]*)$', 1) END AS current_path,
 owner AS success, CASE WHEN NOT owner THEN 'Source file not found' END AS error, new_path AS moved_from
 FROM (SELECT *, owner AND id = min(id) FILTER (owner) OVER (PARTITION BY old_path) AS first
       FROM (SELECT *, id = min(id) OVER (PARTITION BY new_path) AS owner FROM shared_logs_v))"""),
    "scan_session_row": _q("files_v old_catalog_v", """SELECT CAST(9 AS BIGINT) AS id, '/data,/more' AS root_path, count(*) AS total_files, 'done' AS status, true AS finished
 FROM (SELECT * FROM files_v WHERE path NOT LIKE '%/src3/%') n LEFT JOIN old_catalog_v o ON o.path = n.path
 WHERE o.path IS NULL OR o.size <> n.size OR o.last_modified <> n.last_modified"""),
    "regular_files": "SELECT o_orderkey AS id FROM orders WHERE o_orderstatus <> 'P' AND o_custkey % 5 <> 0 AND o_custkey % 3 <> 1",
    "session_stats_map": _q("old_catalog_v", """SELECT CAST(0 AS BIGINT) AS session_id, CAST(sum(n) AS BIGINT) AS total_files,
 '{' || string_agg('"' || c || '":' || CAST(n AS VARCHAR), ',' ORDER BY c) || '}' AS categories
 FROM (SELECT coalesce(category, 'Others') AS c, count(*) AS n FROM old_catalog_v WHERE scan_session_id = 0 GROUP BY 1)"""),
    "parsed_events": _q("fs_events_v", "SELECT event_id, root, path, kind, dest_path FROM fs_events_v WHERE kind <> 'deleted'"),
    "maintain_rules": _q("part_rules_v", "SELECT id, name, pattern, priority FROM final", _MAINTAINED),
    "rejected_rules": _q("part_rules_v", "SELECT id, reasons FROM rejected", _MAINTAINED),
    "classify_rules_join": _q("files_v rules_v", "SELECT file_id AS id, CAST(rule_id AS BIGINT) AS rule_id, rule_name, category FROM winner", _WINNER),
    "validate_rules": _q("part_rules_v", """SELECT id, reasons = '' AS is_valid, reasons FROM (SELECT id, concat_ws('; ',
 CASE WHEN length(name) < 1 OR length(name) > 128 THEN 'name must have 1 to 128 characters' END,
 CASE WHEN length(pattern) < 1 THEN 'pattern must not be empty' END,
 CASE WHEN match_type NOT IN ('glob', 'regex', 'extension') THEN 'match_type must be glob, regex or extension' END,
 CASE WHEN length(category) < 1 OR length(category) > 64 THEN 'category must have 1 to 64 characters' END,
 CASE WHEN length(target_folder) < 1 THEN 'target_folder must not be empty' END,
 CASE WHEN priority < 0 OR priority > 1000 THEN 'priority must be between 0 and 1000' END) AS reasons FROM part_rules_v)"""),
    "list_rules": _q("part_rules_v", """SELECT id, name, pattern, match_type, category, target_folder, priority, enabled, CAST(1.6e9 AS DOUBLE) AS created_at,
 row_number() OVER (ORDER BY priority DESC, id) AS position FROM part_rules_v"""),
    "apply_changes": _q("catalog_v", """SELECT id, CASE WHEN survives THEN name ELSE 'unnamed' END AS name,
 coalesce(CASE WHEN size_seq > since THEN new_size END, CASE WHEN survives THEN size END) AS size,
 coalesce(CASE WHEN cat_seq > since THEN new_cat END, CASE WHEN survives THEN category ELSE 'Others' END) AS category
FROM (SELECT *, CASE WHEN NOT survives AND put <= cut AND made - 1 > cut THEN made - 1 ELSE cut END AS since
      FROM (SELECT coalesce(t.id, g.id) AS id, t.name, t.size, t.category, g.* EXCLUDE (id, cut, put, made), t.id IS NOT NULL AND g.cut IS NULL AS survives,
                   coalesce(cut, -9) AS cut, coalesce(put, -9) AS put, coalesce(made, -9) AS made
            FROM (SELECT id, name, size, category FROM catalog_v) t FULL OUTER JOIN changed g ON g.id = t.id))
WHERE survives OR put > cut OR made > cut""", """
changed AS (SELECT user_id * 7 AS id, max(CASE WHEN event_type = 'error' THEN event_id END) AS cut,
 max(CASE WHEN event_type = 'signup' THEN event_id END) AS made, max(CASE WHEN event_type = 'click' THEN event_id END) AS put,
 max(event_id) FILTER (event_type NOT IN ('view', 'error')) AS size_seq,
 CAST(floor(arg_max(value, event_id) FILTER (event_type NOT IN ('view', 'error'))) AS BIGINT) AS new_size,
 max(event_id) FILTER (event_type = 'view') AS cat_seq, arg_max(props, event_id) FILTER (event_type = 'view') AS new_cat
 FROM events GROUP BY user_id)"""),
    "union_roots": _q("files_v", "SELECT path, name, size, last_modified FROM files_v"),
    "incremental": _q("files_v cache_v", """SELECT f.path, f.size, f.last_modified FROM files_v f LEFT JOIN cache_v c ON c.path = f.path
WHERE c.path IS NULL OR c.size <> f.size OR c.last_modified <> f.last_modified"""),
    "snapshot_diff": _q("files_v old_catalog_v", """SELECT coalesce(f.path, o.path) AS path,
 CASE WHEN f.path IS NULL THEN 'missing' WHEN o.path IS NULL THEN 'new' WHEN f.size = o.size AND f.last_modified = o.last_modified THEN 'unchanged' ELSE 'changed' END AS status,
 o.size AS old_size, f.size AS new_size FROM files_v f FULL OUTER JOIN old_catalog_v o ON o.path = f.path"""),
    "snapshot_diff_digests": _q("files_v calm_catalog_v", """SELECT * FROM (SELECT coalesce(f.path, o.path) AS path,
 CASE WHEN f.path IS NULL THEN 'missing' WHEN o.path IS NULL THEN 'new' WHEN f.size = o.size AND f.last_modified = o.last_modified THEN 'unchanged' ELSE 'changed' END AS status,
 o.size AS old_size, f.size AS new_size FROM files_v f FULL OUTER JOIN calm_catalog_v o ON o.path = f.path) WHERE status <> 'unchanged'"""),
    "catalog_versions": _q("files_v calm_catalog_v", f"""SELECT coalesce(o.id, (SELECT max(id) FROM calm_catalog_v) + row_number() OVER (PARTITION BY o.path IS NULL ORDER BY n.path)) AS id,
 n.path, CASE WHEN w THEN n.name ELSE o.name END AS name, n.extension, n.size, CASE WHEN w THEN n.category ELSE 'Stale' END AS category, n.last_modified, o.hash,
 CAST(CASE WHEN NOT w THEN 0 WHEN n.path LIKE '%/src3/%' THEN 9 ELSE 8 END AS BIGINT) AS scan_session_id,
 CASE WHEN o.path IS NULL THEN CAST(1700000000 AS DOUBLE) ELSE o.created_at END AS created_at
FROM (SELECT n, o, o.path IS NULL OR o.size <> n.size OR o.last_modified <> n.last_modified AS w FROM incoming n LEFT JOIN calm_catalog_v o ON o.path = n.path)""", _INCOMING),
    "upsert_catalog": _q("files_v old_catalog_v", f"""SELECT coalesce(o.id, n.id) AS id, coalesce(n.path, o.path) AS path, coalesce(n.name, o.name) AS name,
 CASE WHEN n.path IS NULL THEN o.extension ELSE n.extension END AS extension, coalesce(n.size, o.size) AS size, CASE WHEN n.path IS NULL THEN o.category ELSE n.category END AS category,
 coalesce(n.last_modified, o.last_modified) AS last_modified, o.hash, CAST(CASE WHEN n.path IS NULL THEN o.scan_session_id ELSE 9 END AS BIGINT) AS scan_session_id,
 CASE WHEN o.path IS NULL THEN CAST(1700000000 AS DOUBLE) ELSE o.created_at END AS created_at FROM {_MERGED}""", _INCOMING),
    "scan": _q("files_v old_catalog_v", """SELECT coalesce(o.path, n.path) AS path, coalesce(o.id, n.id) AS id, CASE WHEN w THEN n.name ELSE o.name END AS name, CASE WHEN w THEN n.size ELSE o.size END AS size,
 CASE WHEN w THEN n.category ELSE o.category END AS category, CASE WHEN w THEN n.last_modified ELSE o.last_modified END AS last_modified, o.hash,
 CAST(CASE WHEN w THEN 9 ELSE o.scan_session_id END AS BIGINT) AS scan_session_id, w AS written
FROM (SELECT o, n, n.path IS NOT NULL AND (o.path IS NULL OR o.size <> n.size OR o.last_modified <> n.last_modified) AS w
      FROM old_catalog_v o FULL OUTER JOIN (SELECT * FROM incoming WHERE path NOT LIKE '%/src3/%') n ON n.path = o.path)""", _INCOMING),
    "scan_stats": _q("files_v places_v", f"""SELECT count(*) FILTER (NOT bad) AS total_files, count(*) FILTER (bad) AS skipped_protected, CAST(0 AS BIGINT) AS skipped_errors,
 CAST(coalesce(sum(size) FILTER (NOT bad), 0) AS BIGINT) AS total_bytes,
 (SELECT count(DISTINCT a) FROM (SELECT unnest(list_transform(range(2, len(s) + 1), lambda i: array_to_string(s[1:i], '/'))) AS a
    FROM (SELECT DISTINCT string_split(regexp_replace(path, '/[^/]*$', ''), '/') AS s FROM every WHERE NOT bad))) AS total_dirs FROM every""",
        f"""every AS (SELECT *, {_under('path', PROTECTED_UNIX)} AS bad FROM (SELECT path, size FROM files_v UNION ALL SELECT path, size FROM places_v))"""),
    "list_sessions": _q("sessions_v", "SELECT *, row_number() OVER (ORDER BY id DESC) AS position FROM sessions_v"),
    "latest_session": _q("sessions_v", "SELECT * FROM sessions_v WHERE id = (SELECT max(id) FROM sessions_v)"),
    "session_durations": _q("sessions_v", """SELECT id, completed_at - started_at AS duration,
 round(CASE WHEN completed_at > started_at THEN total_files / (completed_at - started_at) ELSE 0 END, 9) AS files_per_second FROM sessions_v"""),
    "session_files": _q("files_v sessions_v", """SELECT f.scan_session_id, f.id, s.status AS session_status, s.root_path
FROM (SELECT id, CASE WHEN extension = '.zip' THEN 9 ELSE scan_session_id END AS scan_session_id FROM files_v) f LEFT JOIN sessions_v s ON s.id = f.scan_session_id"""),
    "drop_session": _q("files_v sessions_v", """SELECT f.id, f.path, CASE WHEN s.started_at > 1704067200 THEN NULL ELSE f.scan_session_id END AS scan_session_id
FROM files_v f JOIN sessions_v s ON s.id = f.scan_session_id"""),
    "browse": _q("catalog_v", _top("id, path, name, extension, size, category, last_modified, CAST(NULL AS VARCHAR) AS hash, scan_session_id",
                                   "scan_session_id = 2", "size DESC NULLS LAST, id", 200)),
    "browse_search": _q("catalog_v", _top("id, name", "scan_session_id = 1 AND (name ILIKE '%INVOICE_0_%' OR path ILIKE '%INVOICE_0_%')",
                                          "name NULLS FIRST, id", 500, 3)),
    "search_index": _q("catalog_v", """SELECT term, id, name FROM catalog_v, (VALUES (' INVOICE_0_ ', '%INVOICE_0_%'), ('src1%.TXT', '%src1%.TXT%'), ('_(1)', '%!_(1)%'), ('f', '%f%')) t(term, p)
WHERE scan_session_id = 1 AND (name ILIKE p ESCAPE '!' OR path ILIKE p ESCAPE '!')"""),
    "browse_deep": _q("order_files_v", """SELECT id, name, CAST(1 AS BIGINT) AS scan_session_id FROM order_files_v WHERE id % 2 = 1
ORDER BY name DESC NULLS LAST, id LIMIT 200 OFFSET 6000"""),
    "browse_category": _q("catalog_v", _top("id, path", "scan_session_id = 3 AND category = 'Documents'", "last_modified NULLS FIRST, id", 200)),
    "browse_page": _q("catalog_v", """SELECT id, path FROM (SELECT id, path, row_number() OVER (ORDER BY path NULLS FIRST, id) - 1 AS pos, count(*) OVER () AS n
FROM catalog_v WHERE scan_session_id = 1) WHERE pos // 50 = (n - 1) // 50"""),
    "browse_after": _q("catalog_v", _top("id, name", "scan_session_id = 2 AND (name > 'doc_03.mp4' OR (name = 'doc_03.mp4' AND id > 40))", "name, id", 1000)),
    "browse_total": _q("catalog_v", "SELECT count(*) AS total FROM catalog_v WHERE scan_session_id = 1 AND (name ILIKE '%tax%' OR path ILIKE '%tax%')"),
    "page_counts": _q("catalog_v", "SELECT category, (count(*) + 49) // 50 AS pages FROM catalog_v GROUP BY category"),
    "by_id": _q("catalog_v", "SELECT id, path, size, category FROM catalog_v WHERE id = 84"),
    "category_list": _q("catalog_v", "SELECT 'All' AS category, 0 AS position UNION ALL SELECT DISTINCT category, 1 FROM catalog_v"),
    "session_stats": _q("old_catalog_v", "SELECT coalesce(category, 'Others') AS category, count(*) AS n_files FROM old_catalog_v WHERE scan_session_id = 0 GROUP BY 1"),
    "category_share": _q("catalog_v", """SELECT category, n AS n_files, CAST(floor(n * 100.0 / sum(n) OVER () + 0.5) AS BIGINT) AS percent,
 row_number() OVER (ORDER BY n DESC, category) AS position FROM (SELECT category, count(*) AS n FROM catalog_v GROUP BY category)"""),
    "dup_stage1": _q("files_v", """SELECT size, id, path FROM files_v WHERE size >= 1024 AND size IN (SELECT size FROM files_v GROUP BY size HAVING count(*) > 1)"""),
    "dup_stage2": _q("files_text_v", """SELECT id, path, size, head_hash FROM (SELECT *, count(*) OVER (PARTITION BY size, head_hash) AS n FROM hashed WHERE size >= 1024) WHERE n > 1""", _HASHED),
    "duplicates": _q("files_text_v", "SELECT hash AS fingerprint, size, n AS n_files, size * (n - 1) AS wasted_bytes, keep_id FROM groups", _GROUPS),
    "dup_members": _q("files_text_v", """SELECT fingerprint, size, id, path, rank, n AS n_files, CASE WHEN rank = 1 THEN 'KEEP' ELSE 'COPY ' || CAST(rank - 1 AS VARCHAR) END AS label FROM members""", _MEMBERS),
    "duplicate_lists": _q("files_text_v", """SELECT fingerprint, size, (rank - 1) // 1000 AS chunk, string_agg(path, '|' ORDER BY rank) AS files, size * (n - 1) AS wasted_bytes
FROM members GROUP BY fingerprint, size, n, (rank - 1) // 1000""", _MEMBERS),
    "dup_summary": _q("files_text_v", """SELECT count(*) AS n_groups, CAST(sum(n - 1) AS BIGINT) AS extra_copies, CAST(sum(size * (n - 1)) AS BIGINT) AS wasted_bytes FROM groups""", _GROUPS),
    "top_wasted": _q("files_text_v", "SELECT hash AS fingerprint, size, n AS n_files, size * (n - 1) AS wasted_bytes FROM groups ORDER BY wasted_bytes DESC, fingerprint LIMIT 10", _GROUPS),
    "size_candidates": _q("files_v", """SELECT 'size:' || CAST(size AS VARCHAR) AS fingerprint, size, count(*) AS n_files, size * (count(*) - 1) AS wasted_bytes
FROM files_v WHERE size > 1024 GROUP BY size HAVING count(*) > 1"""),
    "fill_hash": _q("old_catalog_v", "SELECT o.id, o.path, coalesce(h.hash, o.hash) AS hash FROM old_catalog_v o LEFT JOIN hashed h ON h.path = o.path", _HASHED),
    "plan_preview": _q("catalog_v existing_v", "SELECT * FROM plan", _preview()),
    "plan_moves": _q("catalog_v existing_v", "SELECT * FROM plan", _sequential(_requests("catalog_v", "'/org/' || category")), True),
    "plan_moves_by_rule": _q("files_v rules_v existing_v", "SELECT id, source, destination, success, error FROM plan",
                             _CLASSIFIED + "," + _sequential(_requests("(SELECT c.*, f.scan_session_id FROM classified c JOIN files_v f ON f.id = c.id)",
                                                                       "'/org/' || target_folder", "scan_session_id <> 3")), True),
    "organize_summary": _q("catalog_v existing_v", """SELECT count(*) AS total, count(*) FILTER (success) AS succeeded, count(*) FILTER (NOT success) AS failed,
 count(*) FILTER (was_renamed) AS renamed FROM plan""", _sequential(_requests("catalog_v", "'/org/' || category", "scan_session_id <> 3")), True),
    "move_log": _q("catalog_v existing_v", _LOG, _preview()),
    "move_log_dry_run": _q("catalog_v existing_v", _LOG + " WHERE NOT success", _preview()),
    "organize_logs": _q("catalog_v existing_v", """SELECT source AS old_path, destination AS new_path, 'move' AS operation, 'success' AS status, CAST(1.7e9 AS DOUBLE) AS timestamp,
 CAST(2 AS BIGINT) AS session_id, error AS error_message, source AS original_path, true AS can_undo, CAST(NULL AS DOUBLE) AS undone_at FROM plan""", _ORGANIZED, True),
    "organize_undone": _q("catalog_v existing_v", """SELECT id, path, name, CASE WHEN scan_session_id = 2 AND category IN ('Documents', 'Audio', 'Others') THEN CAST(1.8e9 AS DOUBLE) END AS undone_at
FROM catalog_v"""),
    "organize_session": _q("catalog_v existing_v", """SELECT c.id, coalesce(p.destination, c.path) AS path, coalesce(regexp_extract(p.destination, '([^/]*)$', 1), c.name) AS name, c.scan_session_id
FROM catalog_v c LEFT JOIN plan p ON p.id = c.id""",
                           _ORGANIZED, True),
    "undo_rows": _q("catalog_v existing_v", """SELECT id, id AS log_id, source AS original_path, true AS can_undo, CAST(NULL AS DOUBLE) AS undone_at FROM plan WHERE success""", _preview()),
    "list_logs": _q("logs_v", """SELECT *, old_path AS error_message, row_number() OVER (ORDER BY timestamp DESC, id) AS position
FROM (SELECT * FROM logs_v WHERE status = 'failed' ORDER BY timestamp DESC, id LIMIT 100 OFFSET 20)"""),
    "log_counts": _q("logs_v", "SELECT status, count(*) AS n_logs FROM logs_v GROUP BY status UNION ALL SELECT 'all', count(*) FROM logs_v"),
    "drop_logs": _q("logs_v undo_v", "SELECT u.* FROM undo_v u JOIN logs_v l ON l.id = u.log_id WHERE l.session_id <> 2"),
    "verify_copies": _q("catalog_v existing_v", """SELECT p.id, s.hash AS source_hash, t.hash AS target_hash, coalesce(s.hash = t.hash, false) AS verified
FROM plan p JOIN hashed s ON s.id = p.id
JOIN (SELECT destination, arg_min(CASE WHEN regexp_matches(p2.source, '/src[234]/') THEN 'damaged' ELSE h.hash END, p2.id) AS hash
      FROM plan p2 JOIN hashed h ON h.id = p2.id GROUP BY destination) t ON t.destination = p.destination""", _preview("TRUE") + "," + _HASHED),
    "undo_candidates": _q("logs_v undo_v", """SELECT l.id AS log_id, u.original_path, l.new_path AS current_path, l.session_id FROM logs_v l
JOIN undo_v u ON u.log_id = l.id WHERE u.can_undo AND l.session_id = 1"""),
    "undo_plan": _q("logs_v undo_v listing_v", "SELECT * FROM undo_result", _UNDONE),
    "undo_summary": _q("logs_v undo_v listing_v", "SELECT count(*) AS total, count(*) FILTER (success) AS succeeded, count(*) FILTER (NOT success) AS failed FROM undo_result", _UNDONE),
    "undo_logs": _q("logs_v undo_v listing_v", """SELECT l.id, CASE WHEN r.success THEN 'undone' ELSE l.status END AS status,
 CASE WHEN r.success THEN false ELSE u.can_undo END AS can_undo, CASE WHEN r.success THEN CAST(1.8e9 AS DOUBLE) END AS undone_at
FROM logs_v l LEFT JOIN undo_v u ON u.log_id = l.id LEFT JOIN undo_result r ON r.log_id = l.id""", _UNDONE),
    "debounce": _q("fs_events_v", _debounce_result(["root"]), _debounced("root")),
    "debounce_one_root": _q("fs_events_v", _debounce_result(["root"], ONE_ROOT_GAP), _debounced("root", ONE_ROOT_GAP, "'/watch'")),
    "debounce_by_path": _q("fs_events_v", _debounce_result(["root", "path"]), _debounced("root path")),
    "event_counts": _q("fs_events_v", """SELECT CAST(floor(epoch(ts) / 60) AS BIGINT) * 60 AS window_start, kind, count(*) AS n_events FROM fs_events_v GROUP BY ALL"""),
    "classify_events": _q("fs_events_v", """SELECT event_id, CASE WHEN kind = 'moved' THEN dest_path ELSE path END AS file, 'Documents' AS category, CAST(0.95 AS DOUBLE) AS confidence
FROM fs_events_v WHERE kind <> 'deleted'"""),
    "apply_events": _q("fs_events_v", "SELECT path, name, size, category FROM replayed", _replay("fs_events_v"), True),
    "replay_moves": _q("busy_events_v", "SELECT path, name, extension, size, category, came_from FROM replayed", _replay("busy_events_v"), True),
}
_ARRIVED = f"""{_debounced("root").replace("fs_events_v", "inbox_events_v")},
fired AS (SELECT l.event_id, b.session_end, CASE WHEN kind = 'moved' THEN dest_path ELSE l.path END AS path
          FROM lasts l JOIN bounds b ON b.root = l.root AND b.burst = l.burst WHERE l.rk = 1 AND kind <> 'deleted'),
arrived AS (SELECT row_number() OVER (ORDER BY session_end, event_id, path) - 1 AS id, path, regexp_extract(path, '([^/]*)$', 1) AS name,
                   lower(regexp_extract(path, '([.][^./]+)$', 1)) AS extension FROM fired)"""
ORACLE["auto_organize_stream"] = _q(
    "inbox_events_v rules_v existing_v", "SELECT id, source, destination, success, was_renamed FROM plan",
    _ARRIVED + "," + _CLASSIFIED.replace("files_v f", "arrived f") + "," + _sequential(_requests("classified", "'/org/' || category")), True)
# a stream that has come to its end gives what the table gives
ORACLE["debounce_root_stream"] = ORACLE["debounce"]
ORACLE["debounce_stream"] = ORACLE["debounce_by_path"]
ORACLE["classify_rules_vectorised"] = ORACLE["classify_rules"]
