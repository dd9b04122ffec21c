"""Queries over the supplied tables and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import drift
from ..runtime import table as t


def _source_overview(s, d):
    x = t(s, d, "samples").select(F.coalesce(F.lower(F.trim("source")), F.lit("unknown")).alias("source"), "label")
    return x.groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("label") == 1).alias("vulnerable"))


QUERIES = {
    "source_overview": _source_overview,
    "p2_found": lambda s, d: drift.found_changes(t(s, d, "raw_lines")),
    "p2_table": lambda s, d: drift.unified(t(s, d, "raw_lines")),
}
_DRIFT = """WITH f AS (SELECT feed, file_id, row_number() OVER (PARTITION BY feed ORDER BY min(exported_at), file_id) AS ord FROM raw_lines GROUP BY 1, 2),
    v AS (SELECT file_id, payload AS j FROM raw_lines WHERE CASE WHEN json_valid(payload) THEN json_type(payload) = 'OBJECT' ELSE false END),
    t AS (SELECT v.file_id, json_extract_string(v.j, '$.id') AS rid, substr(x.fullkey, 3) AS path, CASE x.type WHEN 'VARCHAR' THEN 'string' WHEN 'DOUBLE' THEN 'decimal' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'ARRAY' THEN 'array' ELSE 'integer' END AS kind, x.value::VARCHAR AS val
        FROM v, json_tree(v.j) x WHERE x.type NOT IN ('OBJECT', 'NULL') AND x.fullkey NOT LIKE '%[%'),
    k AS (SELECT DISTINCT file_id, path, kind FROM t),
    c AS (SELECT feed, ord, path, CASE WHEN bool_or(kind = 'decimal') THEN string_agg(CASE WHEN kind <> 'integer' THEN kind END, '|' ORDER BY kind) ELSE string_agg(kind, '|' ORDER BY kind) END AS kind FROM k JOIN f USING (file_id) GROUP BY 1, 2, 3),
    later AS (SELECT feed, ord, path, kind FROM c WHERE ord > 1), before AS (SELECT c.feed, c.ord + 1 AS ord, path, kind FROM c JOIN (SELECT feed, max(ord) AS last FROM f GROUP BY 1) USING (feed) WHERE ord < last),
    log AS (SELECT feed, ord, path, before.kind AS old_kind, later.kind AS new_kind FROM before FULL JOIN later USING (feed, ord, path) WHERE before.kind IS DISTINCT FROM later.kind),
    vals AS (SELECT DISTINCT feed, ord, rid, path, val FROM t JOIN f USING (file_id) WHERE rid IS NOT NULL),
    gone AS (SELECT l.feed, l.ord, l.path, rid, val FROM log l JOIN vals x ON x.feed = l.feed AND x.ord + 1 = l.ord AND x.path = l.path WHERE new_kind IS NULL),
    came AS (SELECT l.feed, l.ord, l.path, rid, val FROM log l JOIN vals x ON x.feed = l.feed AND x.ord = l.ord AND x.path = l.path WHERE old_kind IS NULL),
    same AS (SELECT feed, ord, gone.path AS old, came.path AS new, rid, bool_or(gone.val = came.val) AS eq FROM gone JOIN came USING (feed, ord, rid) GROUP BY ALL),
    pairs AS (SELECT feed, ord, old, new, count(*) AS n, string_split(old, '.')[-1] = string_split(new, '.')[-1] AS leaf FROM same GROUP BY 1, 2, 3, 4 HAVING bool_and(eq)),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY feed, ord, old ORDER BY n DESC, leaf DESC, old, new) AS a, row_number() OVER (PARTITION BY feed, ord, new ORDER BY n DESC, leaf DESC, old, new) AS b FROM pairs),
    r AS (SELECT feed, ord, old, new FROM ranked WHERE a = 1 AND b = 1)
    SELECT f.file_id, log.path AS field_path, CASE WHEN r.old IS NOT NULL THEN 'renamed' WHEN old_kind IS NULL THEN 'added' WHEN new_kind IS NULL THEN 'removed' ELSE 'retyped' END AS change_kind
    FROM log JOIN f USING (feed, ord) LEFT JOIN r ON r.feed = log.feed AND r.ord = log.ord AND r.old = log.path
    WHERE NOT EXISTS (SELECT 1 FROM r q WHERE q.feed = log.feed AND q.ord = log.ord AND q.new = log.path)"""
SQL = {
    "p2_found": _DRIFT,
    "source_overview": "SELECT coalesce(lower(trim(source)),'unknown') AS source, count(*) AS n, count(*) FILTER (label = 1) AS vulnerable FROM samples GROUP BY 1",
}


def queries() -> dict:
    return QUERIES


def oracle_sql() -> dict[str, str]:
    return SQL
