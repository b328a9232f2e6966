"""File-inventory views over the given tables, as SQL that Spark and DuckDB both read."""

from __future__ import annotations

from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()

# {SIZE}: bytes of a text; {SEC:c}: epoch seconds of a timestamp column, as double
_DIALECT = {
    "spark": {"SIZE": "octet_length(text)", "SEC": "CAST(unix_seconds(CAST({} AS TIMESTAMP)) AS DOUBLE)"},
    "duckdb": {"SIZE": "octet_length(encode(text))", "SEC": "CAST(epoch({}) AS DOUBLE)"},
}

VIEWS = {
    "files_text_v": (["documents"], """
SELECT doc_id AS id,
       concat('/data/', source, '/', lang, '/b', CAST(CAST(floor(doc_id / 84) AS BIGINT) AS STRING), '/', name) AS path,
       name, lower(regexp_extract(name, '^.+([.][^.]+)$', 1)) AS extension, size,
       CAST(1704067200 + doc_id * 37.5 AS DOUBLE) AS last_modified, 1 + doc_id % 3 AS scan_session_id, text
FROM (SELECT doc_id, source, lang, text, CAST({SIZE} AS BIGINT) AS size,
             concat(CASE WHEN doc_id % 10 = 0 THEN 'invoice_' WHEN doc_id % 10 = 5 THEN 'tax_20' ELSE 'doc_' END,
                    lpad(CAST(CAST(floor(doc_id / 12) AS BIGINT) % 7 AS STRING), 2, '0'),
                    CASE WHEN doc_id % 23 = 0 THEN '_(1)' ELSE '' END,
                    CASE doc_id % 12 WHEN 0 THEN '.pdf' WHEN 1 THEN '.txt' WHEN 2 THEN '.JPG' WHEN 3 THEN '.py'
                      WHEN 4 THEN '.mp4' WHEN 5 THEN '.zip' WHEN 6 THEN '.mp3' WHEN 7 THEN '.tar.gz'
                      WHEN 8 THEN '.xyz' WHEN 9 THEN '' WHEN 10 THEN '.exe' ELSE '.docx' END) AS name
      FROM documents)"""),
    "files_v": (["files_text_v"], """
SELECT id, path, name, extension, size, last_modified, scan_session_id FROM files_text_v"""),
    "rules_v": ([], """
SELECT * FROM (VALUES
  (1, 'PDF as Finance', '.pdf', 'extension', 'Finance', 'Finance', 100, true),
  (2, 'Invoice glob', '*invoice*', 'glob', 'Invoices', 'Finance/Invoices', 50, true),
  (3, 'Tax files', 'tax_[0-9]{4}', 'regex', 'Tax', 'Finance/Tax', 50, true),
  (4, 'Disabled', '.txt', 'extension', 'ShouldNotMatch', 'X', 999, false),
  (5, 'Low priority', '.pdf', 'extension', 'LowCat', 'Low', 10, true))
  AS t(id, name, pattern, match_type, category, target_folder, priority, enabled)"""),
    # a rule table that grows with the data, with rows that break every constraint
    "part_rules_v": (["part"], """
SELECT p_partkey AS id, CASE WHEN p_size % 9 = 0 THEN '' ELSE p_name END AS name,
       CASE WHEN p_size % 7 = 0 THEN '' ELSE concat('*', lower(p_type), '*') END AS pattern,
       CASE p_size % 5 WHEN 0 THEN 'regex' WHEN 1 THEN 'extension' WHEN 2 THEN 'fuzzy' ELSE 'glob' END AS match_type,
       CASE WHEN p_size % 11 = 0 THEN repeat(p_brand, 9) ELSE p_brand END AS category,
       concat(p_brand, '/', p_type) AS target_folder, p_size * 25 AS priority, p_size % 2 = 0 AS enabled
FROM part"""),
    # rules that match the files, many of them, some broken, some with sets that engines read differently
    "name_rules_v": (["part"], """
SELECT p_partkey AS id, p_name AS name,
       CASE p_size % 5
         WHEN 0 THEN CASE p_partkey % 4 WHEN 0 THEN '.PDF' WHEN 1 THEN '.py' WHEN 2 THEN '.mp3' ELSE '.gone' END
         WHEN 1 THEN concat('doc_0', CAST(p_partkey % 7 AS STRING), '*.?x?')
         WHEN 2 THEN concat('_0[', CAST(p_partkey % 7 AS STRING), '&&x][.]')
         WHEN 3 THEN concat('^tax_20+', CAST(p_partkey % 7 AS STRING), '(_|[.](docx|zip)$)')
         ELSE concat('(_0', CAST(p_partkey % 7 AS STRING)) END AS pattern,
       CASE p_size % 5 WHEN 0 THEN 'extension' WHEN 1 THEN 'glob' ELSE 'regex' END AS match_type,
       p_brand AS category, concat(p_brand, '/', p_type) AS target_folder, p_size * 20 AS priority, p_size % 10 <> 7 AS enabled
FROM part"""),
    # names with numbers in them, and very many rules about such names: nearly a pattern per row
    "order_files_v": (["orders"], """
SELECT o_orderkey AS id, concat('Cust', CAST(o_custkey AS STRING), '-', CAST(o_orderkey AS STRING), '.', lower(substr(o_orderpriority, 3))) AS name
FROM orders"""),
    "many_rules_v": (["lineitem"], """
SELECT l_orderkey * 8 + l_linenumber AS id, concat('rule ', CAST(l_partkey AS STRING), '/', CAST(l_suppkey AS STRING)) AS name,
       CASE l_linenumber % 6
         WHEN 0 THEN CASE l_suppkey % 50 WHEN 0 THEN '.LOW' WHEN 1 THEN '.high' ELSE concat('.x', CAST(l_suppkey AS STRING)) END
         WHEN 1 THEN concat('*-', CAST(l_orderkey * 3 AS STRING), '.?*')
         WHEN 2 THEN concat('CUST', CAST(l_partkey AS STRING), '-*')
         WHEN 3 THEN concat('^cust0*', CAST(l_partkey AS STRING), '-[0-9]+[.](low|high)$')
         WHEN 4 THEN concat('*-', CAST(l_orderkey AS STRING), '.medium')
         ELSE concat('*t', CAST(l_suppkey AS STRING), '-', CAST(l_orderkey AS STRING), '*') END AS pattern,
       CASE l_linenumber % 6 WHEN 0 THEN 'extension' WHEN 3 THEN 'regex' ELSE 'glob' END AS match_type,
       concat('C', CAST(l_partkey % 100 AS STRING)) AS category, concat('F/', CAST(l_suppkey AS STRING)) AS target_folder,
       CAST(CASE WHEN l_linenumber % 6 = 0 THEN l_suppkey % 5 ELSE l_partkey % 900 END AS INT) AS priority, l_tax < 0.07 AS enabled
FROM lineitem"""),
    # prefixes and globs of paths, as many as parts
    "prefixes_v": (["part"], """
SELECT concat('/data/src', CAST(p_partkey % 20 AS STRING), CASE p_size % 3 WHEN 0 THEN '/d' WHEN 1 THEN concat('/en/b', CAST(p_size % 4 AS STRING))
              ELSE concat('/', lower(p_brand), CAST(p_partkey AS STRING)) END) AS prefix,
       concat('*/src', CAST(p_partkey % 20 AS STRING), CASE p_size % 3 WHEN 0 THEN '/fr/*_0?.*' WHEN 1 THEN concat('/[a-e]?/b', CAST(p_size % 4 AS STRING), '*')
              ELSE concat('/*', lower(p_brand), CAST(p_partkey AS STRING)) END) AS pattern
FROM part WHERE p_partkey % 5 = p_size % 5"""),
    # logs of which several name one file, whose files claim one original path
    "shared_logs_v": (["orders"], """
SELECT o_orderkey AS id, concat('/in/', CAST(CAST(floor(o_custkey / 3) AS BIGINT) AS STRING), '/c.txt') AS old_path,
       concat('/org/Documents/c', CAST(o_custkey AS STRING), '.txt') AS new_path, 'success' AS status, 1 AS session_id
FROM orders"""),
    "cache_v": (["files_v"], """
SELECT path, CASE WHEN id % 7 = 0 THEN last_modified - 1 ELSE last_modified END AS last_modified,
       CASE WHEN id % 11 = 0 THEN size + 1 ELSE size END AS size, 0 AS scan_session_id
FROM files_v WHERE extension <> '.zip'"""),
    "catalog_v": (["files_v"], """
SELECT *, CASE WHEN extension IN ('.pdf', '.txt', '.docx') THEN 'Documents' WHEN extension = '.jpg' THEN 'Images'
         WHEN extension = '.py' THEN 'Code' WHEN extension = '.mp4' THEN 'Videos' WHEN extension IN ('.zip', '.gz') THEN 'Archives'
         WHEN extension = '.mp3' THEN 'Audio' WHEN extension = '.exe' THEN 'Executables' ELSE 'Others' END AS category
FROM files_v"""),
    # the catalog before a scan: stale, partly missing, with one category nobody filled and files that are gone
    "old_catalog_v": (["files_v"], """
SELECT id, path, concat('old ', name) AS name, extension,
       CASE WHEN id % 11 = 0 THEN size + 1 ELSE size END AS size,
       CASE WHEN id % 4 = 0 THEN NULL ELSE 'Stale' END AS category,
       CASE WHEN id % 7 = 0 THEN last_modified - 1 ELSE last_modified END AS last_modified,
       concat('h', CAST(id AS STRING)) AS hash, CAST(0 AS BIGINT) AS scan_session_id,
       CAST(1600000000 AS DOUBLE) AS created_at
FROM files_v WHERE extension <> '.zip'
UNION ALL
SELECT -1 - id AS id, concat('/gone', path) AS path, name, extension, size, 'Stale' AS category, last_modified,
       CAST(NULL AS STRING) AS hash, CAST(0 AS BIGINT) AS scan_session_id, CAST(1600000000 AS DOUBLE) AS created_at
FROM files_v WHERE extension = '.mp3'"""),
    # a catalog that differs from the files in few places: one folder changed, some files new, some gone
    "calm_catalog_v": (["files_v"], """
SELECT id, path, concat('old ', name) AS name, extension, CASE WHEN path LIKE '/data/src5/fr/%' THEN size + 1 ELSE size END AS size, 'Stale' AS category,
       last_modified, concat('h', CAST(id AS STRING)) AS hash, CAST(0 AS BIGINT) AS scan_session_id, CAST(1600000000 AS DOUBLE) AS created_at
FROM files_v WHERE path NOT LIKE '/data/src3/de/%'
UNION ALL
SELECT -1 - id AS id, concat('/gone', path) AS path, name, extension, size, 'Stale' AS category, last_modified,
       CAST(NULL AS STRING) AS hash, CAST(0 AS BIGINT) AS scan_session_id, CAST(1600000000 AS DOUBLE) AS created_at
FROM files_v WHERE path LIKE '/data/src7/es/%'"""),
    "existing_v": (["catalog_v"], """
SELECT DISTINCT concat('/org/', category) AS dest_dir, name FROM catalog_v WHERE path LIKE '/data/src7/%'"""),
    "logs_v": (["orders"], """
SELECT o_orderkey AS id, concat('/in/', CAST(o_custkey AS STRING), '/o', CAST(o_orderkey AS STRING), '.txt') AS old_path,
       concat('/org/Documents/o', CAST(o_orderkey AS STRING), '.txt') AS new_path, 'move' AS operation,
       CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'O' THEN 'failed' ELSE 'undone' END AS status,
       {SEC:o_orderdate} AS timestamp, 1 + o_custkey % 3 AS session_id
FROM orders"""),
    "undo_v": (["logs_v"], """
SELECT id, id AS log_id, old_path AS original_path, status = 'success' AS can_undo FROM logs_v WHERE status <> 'failed'"""),
    # what stands on disk before an undo: most moved files, some of the original places taken again
    "listing_v": (["logs_v"], """
SELECT new_path AS path FROM logs_v WHERE session_id <> 3
UNION ALL
SELECT old_path AS path FROM logs_v WHERE timestamp < 800000000"""),
    "sessions_v": (["files_v"], """
SELECT scan_session_id AS id, '/data' AS root_path, min(last_modified) AS started_at, max(last_modified) AS completed_at,
       count(*) AS total_files, 'done' AS status FROM files_v GROUP BY scan_session_id"""),
    "fs_events_v": (["events"], """
SELECT concat('/watch/u', CAST(user_id AS STRING)) AS root,
       concat('/watch/u', CAST(user_id AS STRING), '/f', CAST(event_id % 4 AS STRING), '.txt') AS path,
       CASE event_type WHEN 'click' THEN 'created' WHEN 'error' THEN 'deleted' WHEN 'purchase' THEN 'moved' ELSE 'modified' END AS kind,
       CASE WHEN event_type = 'purchase' THEN concat('/watch/u', CAST(user_id AS STRING), '/m', CAST(event_id AS STRING), '.txt') END AS dest_path,
       event_id, CAST(ts AS TIMESTAMP) AS ts
FROM events"""),
    # few names that are moved on, moved over, deleted and used again
    "busy_events_v": (["events"], """
SELECT concat('/watch/u', CAST(user_id AS STRING)) AS root,
       concat('/watch/u', CAST(user_id AS STRING), '/f', CAST(event_id % 5 AS STRING), CASE WHEN event_id % 4 = 1 THEN '.jpg' ELSE '.txt' END) AS path,
       CASE event_type WHEN 'click' THEN 'created' WHEN 'error' THEN 'deleted' WHEN 'view' THEN 'modified' ELSE 'moved' END AS kind,
       CASE WHEN event_type NOT IN ('click', 'error', 'view') AND event_id % 11 <> 0
            THEN concat('/watch/u', CAST(user_id AS STRING), '/f', CAST(CAST(floor(event_id / 5) AS BIGINT) % 7 AS STRING),
                        CASE WHEN event_id % 3 = 0 THEN '.jpg' ELSE '.txt' END) END AS dest_path,
       event_id, CAST(ts AS TIMESTAMP) AS ts
FROM events"""),
    # files that come into watched folders, with names that meet in their target folders
    "inbox_events_v": (["events"], """
SELECT concat('/watch/u', CAST(user_id AS STRING)) AS root,
       concat('/watch/u', CAST(user_id AS STRING), '/',
              CASE event_id % 7 WHEN 0 THEN 'invoice' WHEN 1 THEN 'tax_2023' ELSE 'scan' END, CAST(CAST(floor(event_id / 7) AS BIGINT) % 12 AS STRING),
              CASE event_id % 5 WHEN 0 THEN '.pdf' WHEN 1 THEN '.JPG' WHEN 2 THEN '.txt' WHEN 3 THEN '' ELSE '.py' END) AS path,
       CASE event_type WHEN 'click' THEN 'created' WHEN 'error' THEN 'deleted' WHEN 'purchase' THEN 'moved' ELSE 'modified' END AS kind,
       CASE WHEN event_type = 'purchase' THEN concat('/watch/u', CAST(user_id AS STRING), '/scan', CAST(event_id % 12 AS STRING),
                                                     CASE WHEN event_id % 2 = 0 THEN '_(1)' ELSE '' END, '.txt') END AS dest_path,
       event_id, CAST(ts AS TIMESTAMP) AS ts
FROM events"""),
    # paths with protected and look-alike places
    "places_v": (["orders"], """
SELECT o_orderkey AS id,
       concat(CASE o_custkey % 7 WHEN 0 THEN '/etc' WHEN 1 THEN '/etc2' WHEN 2 THEN '/usr/bin/sub' WHEN 3 THEN '/home/etc'
                WHEN 4 THEN '/root' WHEN 5 THEN '/home/../boot' ELSE '/srv' END,
              '/', o_orderpriority, '/o', CAST(o_orderkey AS STRING), '.txt') AS path,
       o_orderkey * 10 AS size
FROM orders"""),
}


def _closure(names: list[str]) -> list[str]:
    order: list[str] = []

    def visit(name: str) -> None:
        if name in VIEWS:
            for needed in VIEWS[name][0]:
                visit(needed)
        if name not in order:
            order.append(name)

    for name in names:
        visit(name)
    return order


def _text(name: str, dialect: str) -> str:
    words = _DIALECT[dialect]
    text = VIEWS[name][1].replace("{SIZE}", words["SIZE"])
    while "{SEC:" in text:
        head, rest = text.split("{SEC:", 1)
        column, tail = rest.split("}", 1)
        text = head + words["SEC"].format(column) + tail
    return text


_PLANNED: WeakKeyDictionary[SparkSession, dict[tuple[str, str], DataFrame]] = WeakKeyDictionary()


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view (or a raw table) as a DataFrame over the parquet files of ``sf_dir``.

    The plan is made once per session; no data is kept.
    """
    planned = _PLANNED.setdefault(spark, {})
    if (sf_dir, name) not in planned:
        planned[sf_dir, name] = _plan(spark, sf_dir, name)
    return planned[sf_dir, name]


def _plan(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    parts = [
        f"{n} AS ({_text(n, 'spark')})" if n in VIEWS else f"{n} AS (SELECT * FROM parquet.`{sf_dir}/{n}.parquet`)"
        for n in _closure([name])
    ]
    return spark.sql(f"WITH {', '.join(parts)} SELECT * FROM {name}")


def duckdb_with(*names: str, recursive: bool = False) -> str:
    """The WITH clause that gives DuckDB the same views (raw tables are registered there)."""
    parts = [f"{n} AS ({_text(n, 'duckdb')})" for n in _closure(list(names)) if n in VIEWS]
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts) if parts else "WITH"
