"""Registered queries of the general problems 1, 2 and 4."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import hierarchy, orphans, packed_fields
from graphloom.plans.graph_queries import _CTES
from graphloom.session import cut
from graphloom.sources.tables import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return packed_fields.function_parameters(table(spark, folder, "func_defs"))


def _orphans(spark: SparkSession, folder: str) -> DataFrame:
    return orphans.find_orphans(*(table(spark, folder, t) for t in ("graph_edges", "import_decls", "func_defs", "src_files", "ext_modules")))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return _orphans(spark, folder).select(F.col("kind").alias("ref_field"), "ref_id")


def p2_report(spark: SparkSession, folder: str) -> DataFrame:
    return orphans.orphan_report(_orphans(spark, folder))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return hierarchy.class_hierarchy(table(spark, folder, "class_defs")).select("class_uid", "root_uid", "depth", "state")


def _heavy(spark: SparkSession, folder: str) -> DataFrame:
    return cut(hierarchy.heavy_paths(cut(hierarchy.separate_cycles(hierarchy.class_parents(table(spark, folder, "class_defs"))))))


def p4_paths(spark: SparkSession, folder: str) -> DataFrame:
    """Path, preorder position and number of descendants of every class on a tree."""
    heavy = _heavy(spark, folder)
    return heavy.join(hierarchy.node_paths(heavy), "node").select(
        F.col("node").alias("class_uid"), F.array_join("path", "/").alias("path"), "depth", (F.col("size") - 1).alias("descendants"), F.col("pos").alias("preorder")
    )


def p4_tree(spark: SparkSession, folder: str) -> DataFrame:
    """Path from the root, depth and number of descendants of every class on a tree."""
    return p4_paths(spark, folder).drop("preorder")


def p4_descendants(spark: SparkSession, folder: str) -> DataFrame:
    """All descendants of the classes with a row id divisible by 100, among all classes."""
    asked = table(spark, folder, "class_defs").filter("row_id % 100 = 0").select(F.col("class_uid").alias("node"))
    return hierarchy.descendants_of(_heavy(spark, folder), asked).select(F.col("node").alias("class_uid"), "descendant")


_STRIPPED = r"regexp_replace(regexp_replace({0}, '\.py$', ''), '^((src|lib|cli|python)/)+', '')"
_FILE, _IMPORTER = _STRIPPED.format("path"), _STRIPPED.format("i.file")

_REFERENCES = rf"""WITH e AS (SELECT edge_type AS ref_field, edge_id AS ref_id, lower(regexp_replace(dst_uid, '^\s+|\s+$', '', 'g')) AS u, seen_at AS t FROM graph_edges WHERE dst_uid IS NOT NULL AND edge_type IN ('callsFunction', 'containsImport')),
 n AS (SELECT 'callsFunction' AS kind, lower(trim(fn_uid)) AS u, indexed_at AS a, deleted_at AS z FROM func_defs UNION ALL SELECT 'containsImport', lower(trim(import_uid)), indexed_at, deleted_at FROM import_decls),
 i AS (SELECT row_id, repo, file, indexed_at AS t, regexp_replace(module, '^[\s"''`]+|[\s"''`]+$', '', 'g') AS m FROM import_decls WHERE module IS NOT NULL),
 r AS (SELECT *, CASE WHEN m NOT LIKE '.%' THEN m
   WHEN length(regexp_extract(m, '^(\.*)', 1)) - 1 < greatest(len(string_split({_IMPORTER}, '/')) - 1, 1) THEN array_to_string(list_filter(list_concat(
     list_slice(string_split({_IMPORTER}, '/'), 1, greatest(len(string_split({_IMPORTER}, '/')) - length(regexp_extract(m, '^(\.*)', 1)), 0)), [regexp_replace(m, '^\.+', '')]), lambda s: s <> ''), '.') END AS dotted
   FROM i WHERE m <> '' AND regexp_extract(m, '^([^./]*)', 1) NOT IN (SELECT root_name FROM ext_modules)),
 f AS (SELECT repo, path, indexed_at AS a, deleted_at AS z, CASE WHEN path LIKE '%.py' THEN regexp_replace(replace({_FILE}, '/', '.'), '(^|\.)__init__$', '') END AS dotted FROM src_files),
 o AS (SELECT ref_field, ref_id, t, u AS key FROM e WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.kind = e.ref_field AND n.u = e.u AND n.a <= e.t AND (n.z IS NULL OR e.t < n.z))
 UNION ALL SELECT 'module', row_id, t, repo || chr(31) || coalesce('py:' || dotted, 'above') FROM r WHERE file LIKE '%.py' AND NOT EXISTS (SELECT 1 FROM f WHERE f.repo = r.repo AND f.dotted = r.dotted AND f.a <= r.t AND (f.z IS NULL OR r.t < f.z))
 UNION ALL SELECT 'module', row_id, t, repo || chr(31) || 'c:' || m FROM r WHERE file NOT LIKE '%.py' AND row_id NOT IN (SELECT r.row_id FROM r JOIN f ON f.repo = r.repo AND f.a <= r.t AND (f.z IS NULL OR r.t < f.z) AND f.dotted IS NULL AND (f.path = r.m OR suffix(f.path, '/' || r.m))))"""

_ORPHANS = _REFERENCES + " SELECT ref_field, ref_id FROM o"
_ORPHAN_REPORT = _REFERENCES + " SELECT ref_field, strftime(t, '%Y-%m') AS month, count(*) AS orphans, count(DISTINCT key) AS targets FROM o GROUP BY ALL"

_TREES = """WITH RECURSIVE c AS (SELECT * FROM {cls}), b AS (SELECT class_uid, repo, i, {bare} AS base FROM (SELECT class_uid, repo, unnest(base_classes) AS b, generate_subscripts(base_classes, 1) AS i FROM c)),
 p AS (SELECT c.class_uid AS node, x.parent FROM c LEFT JOIN (SELECT b.class_uid, arg_min(k.class_uid, b.i) AS parent FROM b JOIN c k ON k.repo = b.repo AND k.name = b.base GROUP BY b.class_uid) x ON x.class_uid = c.class_uid),
 w(node, cur) AS (SELECT node, parent FROM p WHERE parent IS NOT NULL UNION SELECT w.node, p.parent FROM w JOIN p ON p.node = w.cur WHERE p.parent IS NOT NULL),
 a AS (SELECT w.node, count(*) AS depth, max(CASE WHEN p.parent IS NULL THEN w.cur END) AS root, bool_or(w.cur = w.node) AS self FROM w JOIN p ON p.node = w.cur GROUP BY w.node)
""".format(**_CTES)

_CLASSES = _TREES + """ SELECT p.node AS class_uid, CASE WHEN p.parent IS NULL THEN p.node WHEN a.root IS NULL THEN '' ELSE a.root END AS root_uid,
  CASE WHEN p.parent IS NULL THEN 0 WHEN a.root IS NULL THEN -1 ELSE a.depth END AS depth, CASE WHEN p.parent IS NULL OR a.root IS NOT NULL THEN 'rooted' WHEN a.self THEN 'on_cycle' ELSE 'below_cycle' END AS state
 FROM p LEFT JOIN a ON a.node = p.node"""

_PATHS = _TREES + """, d(node, path, depth) AS (SELECT node, node, CAST(0 AS BIGINT) FROM p WHERE parent IS NULL UNION ALL SELECT p.node, d.path || '/' || p.node, d.depth + 1 FROM d JOIN p ON p.parent = d.node)
 SELECT d.node AS class_uid, path, depth, (SELECT count(*) FROM w WHERE w.cur = d.node) AS descendants FROM d"""

_BELOW = _TREES + """ SELECT w.cur AS class_uid, w.node AS descendant FROM w JOIN p ON p.node = w.cur LEFT JOIN a ON a.node = w.cur
 WHERE w.cur IN (SELECT class_uid FROM class_defs WHERE row_id % 100 = 0) AND (p.parent IS NULL OR a.root IS NOT NULL)"""

QUERIES = {"p1_found": p1_found, "p2_found": p2_found, "p2_report": p2_report, "p4_found": p4_found, "p4_paths": p4_paths, "p4_tree": p4_tree, "p4_descendants": p4_descendants}
SQL: dict[str, str] = {"p2_found": _ORPHANS, "p2_report": _ORPHAN_REPORT, "p4_found": _CLASSES, "p4_tree": _PATHS, "p4_descendants": _BELOW}
