"""Registered queries on the incremental store and the composed look-ups, each with its SQL counterpart.

The stored snapshot ends at ``_CUT``; later rows of the tables are the new run.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.functions import exprs as X
from graphloom.operators import nodes, search, snapshots
from graphloom.operators.hierarchy import bare_name
from graphloom.plans.graph_queries import _CUT, _cls, _deps, _edg, _fil, _fn, _n, query, registry
from graphloom.session import shared_folder
from graphloom.sources.tables import table

QUERIES, SQL = registry(__name__)

_TABLES = {"Function": "func_defs", "Class": "class_defs", "Import": "import_decls", "File": "src_files"}
_IDS = {"Function": "row_id", "Class": "row_id", "Import": "row_id", "File": "file_id"}


def _split(s: SparkSession, d: str, kind: str, new: bool) -> DataFrame:
    rows = table(s, d, _TABLES[kind])
    at = F.lit(_CUT).cast("timestamp_ntz")
    return nodes.latest(rows.filter(F.col("indexed_at") >= at if new else F.col("indexed_at") < at), snapshots.KINDS[kind][0], "indexed_at", _IDS[kind])


def _nodes(s: SparkSession, d: str, new: bool, kinds: tuple[str, ...] = tuple(snapshots.KINDS)) -> DataFrame:
    return reduce(DataFrame.unionByName, (snapshots.nodes_of(k, _split(s, d, k, new)) for k in kinds))


def _edges(s: SparkSession, d: str, new: bool) -> DataFrame:
    rows = table(s, d, "graph_edges")
    at = F.lit(_CUT).cast("timestamp_ntz")
    return nodes.edges(rows.filter(F.col("seen_at") >= at if new else F.col("seen_at") < at))


def _sql_nodes(name: str, test: str) -> str:
    parts = []
    for kind, (uid, file, label, content) in snapshots.KINDS.items():
        h = "sha256(concat_ws(chr(31), " + ", ".join(f"coalesce('=' || {c}, '-')" for c in content) + "))"
        parts.append(
            f"SELECT '{kind}' AS kind, {uid} AS uid, repo, {file} AS file, {label} AS label, {h} AS h FROM (SELECT *, row_number() OVER (PARTITION BY {uid} ORDER BY indexed_at DESC NULLS LAST, {_IDS[kind]} DESC) AS rn_ FROM {_TABLES[kind]} WHERE indexed_at {test} TIMESTAMP '{_CUT}') WHERE rn_ = 1"
        )
    return f"{name} AS (" + " UNION ALL ".join(parts) + ")"


def _sql_edges(name: str, test: str) -> str:
    clean = r"lower(regexp_replace({0}, '^\s+|\s+$', '', 'g'))"
    return f"{name} AS (SELECT DISTINCT edge_type, {clean.format('src_uid')} AS src, {clean.format('dst_uid')} AS dst FROM graph_edges WHERE src_uid IS NOT NULL AND dst_uid IS NOT NULL AND seen_at {test} TIMESTAMP '{_CUT}')"


_STORE = ", ".join((_sql_nodes("old_n", "<"), _sql_nodes("new_n", ">="), _sql_edges("old_e", "<"), _sql_edges("new_e", ">=")))
_STATUS = r"""done AS (SELECT n.*, CASE WHEN NOT regexp_matches(coalesce(n.label, ''), '\S') OR NOT regexp_matches(coalesce(n.file, ''), '\S') THEN 'rejected' WHEN o.h = n.h THEN 'unchanged' WHEN o.h IS NOT NULL THEN 'updated' ELSE 'inserted' END AS status
 FROM new_n n LEFT JOIN old_n o ON o.uid = n.uid)"""
_AFTER = "written AS (SELECT * EXCLUDE (status) FROM done WHERE status IN ('updated', 'inserted')), after AS (SELECT * FROM old_n WHERE uid NOT IN (SELECT uid FROM written) UNION ALL SELECT * FROM written)"


@query(f"WITH {_STORE}, {_STATUS} SELECT kind, uid, status FROM done")
def insert_status(s: SparkSession, d: str) -> DataFrame:
    """What an insert of the new run does to each of its nodes: validation, uid, hash skip, upsert."""
    return snapshots.insert_nodes(_nodes(s, d, False), _nodes(s, d, True)).select("kind", "uid", "status")


@query(f"WITH {_STORE}, {_STATUS}, {_AFTER} SELECT kind, uid, label, h FROM after")
def insert_graph_nodes(s: SparkSession, d: str) -> DataFrame:
    """Nodes after the insert."""
    return snapshots.insert_graph(_nodes(s, d, False), _edges(s, d, False), _nodes(s, d, True), _edges(s, d, True))[0].select("kind", "uid", "label", "h")


@query(f"WITH {_STORE}, {_STATUS}, {_AFTER} SELECT * FROM old_e UNION ALL (SELECT * FROM (SELECT * FROM new_e EXCEPT SELECT * FROM old_e) WHERE src IN (SELECT uid FROM after) AND dst IN (SELECT uid FROM after))")
def insert_graph_edges(s: SparkSession, d: str) -> DataFrame:
    """Edges after the insert: the stored ones, and new ones whose ends are nodes."""
    return snapshots.insert_graph(_nodes(s, d, False), _edges(s, d, False), _nodes(s, d, True), _edges(s, d, True))[1]


_GONE = "gone AS (SELECT DISTINCT repo, path AS file FROM src_files WHERE deleted_at IS NOT NULL), alln AS (SELECT 'Function' AS kind, fn_uid AS uid, repo, file FROM {fn} UNION ALL SELECT 'Class', class_uid, repo, file FROM {cls} UNION ALL SELECT 'Import', import_uid, repo, file FROM {imp} UNION ALL SELECT 'File', file_uid, repo, path FROM {fil})"


def _all_nodes(s: SparkSession, d: str) -> DataFrame:
    rows = {"Function": _fn(s, d), "Class": _cls(s, d), "Import": nodes.imports(table(s, d, "import_decls")), "File": _fil(s, d)}
    return reduce(DataFrame.unionByName, (snapshots.nodes_of(k, r) for k, r in rows.items()))


def _gone(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "src_files").filter("deleted_at is not null").select("repo", F.col("path").alias("file")).distinct()


@query("WITH " + _GONE + " SELECT kind, uid FROM alln n WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.repo = n.repo AND g.file = n.file)")
def cascade_nodes(s: SparkSession, d: str) -> DataFrame:
    """Nodes of all kinds that are left when files are deleted with all they contain."""
    return snapshots.delete_cascade(_all_nodes(s, d), _edg(s, d), _gone(s, d))[0].select("kind", "uid")


@query("WITH " + _GONE + ", dead AS (SELECT DISTINCT uid FROM alln n JOIN gone g ON g.repo = n.repo AND g.file = n.file) SELECT edge_type, src, dst FROM {edg} e WHERE src NOT IN (SELECT uid FROM dead) AND dst NOT IN (SELECT uid FROM dead)")
def cascade_delete(s: SparkSession, d: str) -> DataFrame:
    """Edges that are left: those of the files themselves and of everything in them go."""
    return snapshots.delete_cascade(_all_nodes(s, d), _edg(s, d), _gone(s, d))[1].select("edge_type", "src", "dst")


_REPLACED = f"replaced AS (SELECT DISTINCT repo, path AS file FROM src_files WHERE indexed_at >= TIMESTAMP '{_CUT}'), fresh AS (SELECT n.* FROM new_n n JOIN replaced r ON r.repo = n.repo AND r.file = n.file)"


def _replacement(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Files that were indexed anew, and their new nodes of all kinds."""
    files = table(s, d, "src_files").filter(F.col("indexed_at") >= F.lit(_CUT).cast("timestamp_ntz")).select("repo", F.col("path").alias("file")).distinct()
    return files, snapshots.in_files(_nodes(s, d, True), files)


@query(f"WITH {_STORE}, {_REPLACED} SELECT kind, uid FROM old_n o WHERE NOT EXISTS (SELECT 1 FROM replaced r WHERE r.repo = o.repo AND r.file = o.file) UNION ALL SELECT kind, uid FROM fresh")
def file_replace_nodes(s: SparkSession, d: str) -> DataFrame:
    """Nodes after whole files are replaced by their new rows."""
    files, fresh = _replacement(s, d)
    return snapshots.replace_files(_nodes(s, d, False), _edges(s, d, False), files, fresh, _edges(s, d, True))[0].select("kind", "uid")


@query(
    f"""WITH {_STORE}, {_REPLACED}, lost AS (SELECT o.* FROM old_n o JOIN replaced r ON r.repo = o.repo AND r.file = o.file WHERE o.kind = 'Function' AND o.uid NOT IN (SELECT uid FROM fresh WHERE kind = 'Function')),
 after AS (SELECT repo, file, label, uid FROM old_n o WHERE kind = 'Function' AND NOT EXISTS (SELECT 1 FROM replaced r WHERE r.repo = o.repo AND r.file = o.file) UNION ALL SELECT repo, file, label, uid FROM fresh WHERE kind = 'Function')
 SELECT e.src, e.dst AS old_dst, coalesce((SELECT min(uid) FROM fresh f WHERE f.kind = 'Function' AND f.repo = l.repo AND f.file = l.file AND f.label = l.label), (SELECT min(uid) FROM after a WHERE a.repo = l.repo AND a.label = l.label)) AS dst
 FROM old_e e JOIN lost l ON l.uid = e.dst WHERE e.edge_type = 'callsFunction'"""
)
def file_relink(s: SparkSession, d: str) -> DataFrame:
    """Calls to functions that the replacement takes away, with the function that they mean from then on."""
    files, fresh = _replacement(s, d)
    return snapshots.relinked(_nodes(s, d, False), _edges(s, d, False), files, fresh)


_BATCH = f"""ev AS (SELECT repo, path AS file, false AS deleted, indexed_at AS ts FROM src_files WHERE indexed_at >= TIMESTAMP '{_CUT}' UNION ALL SELECT repo, path, true, deleted_at FROM src_files WHERE deleted_at >= TIMESTAMP '{_CUT}'),
 state AS (SELECT repo, file, deleted FROM (SELECT *, row_number() OVER (PARTITION BY repo, file ORDER BY ts DESC, deleted DESC) AS rn FROM ev) WHERE rn = 1)"""


@query(
    rf"""WITH {_STORE}, {_BATCH}, kept AS (SELECT o.* FROM old_n o WHERE NOT EXISTS (SELECT 1 FROM state x WHERE x.deleted AND x.repo = o.repo AND x.file = o.file)),
 read AS (SELECT n.* FROM new_n n JOIN state x ON NOT x.deleted AND x.repo = n.repo AND x.file = n.file)
 SELECT n.kind, n.uid, CASE WHEN NOT regexp_matches(coalesce(n.label, ''), '\S') OR NOT regexp_matches(coalesce(n.file, ''), '\S') THEN 'rejected' WHEN o.h = n.h THEN 'unchanged' WHEN o.h IS NOT NULL THEN 'updated' ELSE 'inserted' END AS status FROM read n LEFT JOIN kept o ON o.uid = n.uid
 UNION ALL SELECT o.kind, o.uid, 'deleted' FROM old_n o JOIN state x ON x.deleted AND x.repo = o.repo AND x.file = o.file"""
)
def change_batch(s: SparkSession, d: str) -> DataFrame:
    """One batch of file changes: deletions cascade, existing files are read anew, unchanged content is skipped."""
    files, at = table(s, d, "src_files"), F.lit(_CUT).cast("timestamp_ntz")
    events = files.filter(F.col("indexed_at") >= at).select("repo", F.col("path").alias("file"), F.lit(False).alias("deleted"), F.col("indexed_at").alias("ts"))
    events = events.unionByName(files.filter(F.col("deleted_at") >= at).select("repo", F.col("path").alias("file"), F.lit(True).alias("deleted"), F.col("deleted_at").alias("ts")))
    return snapshots.apply_changes(_nodes(s, d, False), _edges(s, d, False), events, _nodes(s, d, True), _edges(s, d, True))[2].select("kind", "uid", "status")


@query(f"WITH {_STORE} SELECT uid, kind, h IN (SELECT h FROM old_n) AS stored FROM new_n")
def stored_hashes(s: SparkSession, d: str) -> DataFrame:
    """Durable hash state: the stored run's hashes are saved as a table, the new run's are looked up in it."""
    known = snapshots.HashTable(s, f"{shared_folder(s)}/graphloom-hashes-{uuid.uuid4().hex}")
    known.add(_nodes(s, d, False))
    return known.marked(_nodes(s, d, True)).select("uid", "kind", "stored")


@query(
    """SELECT f.fn_uid, sha256(concat_ws(chr(31), coalesce('=' || name, '-'), coalesce('=' || file, '-'), coalesce('=' || signature, '-'), coalesce('=' || docstring, '-'), '=' || coalesce(n, 0), '=' || coalesce(x, 0))) AS h FROM {fn} f
 LEFT JOIN (SELECT src, count(*) AS n, bit_xor(CAST('0x' || substr(dst, 1, 12) AS BIGINT)) AS x FROM {edg} WHERE edge_type = 'callsFunction' GROUP BY src) e ON e.src = f.fn_uid"""
)
def node_hashes(s: SparkSession, d: str) -> DataFrame:
    """Content hashes of functions over their stored columns and the uids that they call."""
    calls = snapshots.relation_digest(_edg(s, d).filter("edge_type = 'callsFunction'")).withColumnRenamed("src", "fn_uid")
    f = _fn(s, d).join(calls, "fn_uid", "left")
    return f.select("fn_uid", snapshots.content_hash("name", "file", "signature", "docstring", F.coalesce("relations", F.lit(0)), F.coalesce("digest", F.lit(0))).alias("h"))


@query("SELECT row_id, sha256(json_merge_patch('{{}}', to_json({{'alias': alias, 'file': file, 'line_no': line_no, 'module': module}}))) AS h, to_json(imported_items) AS items, coalesce(len(imported_items), 0) AS n FROM import_decls")
def canonical_rows(s: SparkSession, d: str) -> DataFrame:
    """Hash over canonical JSON (sorted keys, nulls dropped), and a list column as JSON and back."""
    i = table(s, d, "import_decls").withColumn("items", F.to_json("imported_items"))
    return i.select("row_id", snapshots.canonical_hash("module", "file", "line_no", "alias").alias("h"), "items", F.coalesce(F.size(F.from_json("items", "array<string>")), F.lit(0)).cast("bigint").alias("n"))


# --- look-ups that are composed ---------------------------------------------------------


@query("SELECT row_id AS id, fn_uid AS uid, return_type AS \"returnType\", greatest(line_no - 1, 0) AS row, greatest(line_no - 1, 0) + 1 AS line FROM func_defs")
def renamed_positions(s: SparkSession, d: str) -> DataFrame:
    """Stored names to those of the interface; rows counted from 0 and lines from 1."""
    row = F.greatest(F.col("line_no") - 1, F.lit(0))
    return table(s, d, "func_defs").select(F.col("row_id").alias("id"), F.col("fn_uid").alias("uid"), F.col("return_type").alias("returnType"), row.alias("row"), (row + 1).alias("line"))


@query("SELECT row_id, name, file FROM func_defs WHERE name = '__init__' AND return_type = 'None' AND file LIKE 'src/%'")
def scan_conjunction(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "func_defs").filter((F.col("name") == "__init__") & (F.col("return_type") == "None") & F.col("file").startswith("src/")).select("row_id", "name", "file")


@query(
    r"""SELECT 'Function' AS node, row_id, CASE WHEN NOT regexp_matches(coalesce(name, ''), '\S') THEN 'name' ELSE 'file' END AS field FROM func_defs WHERE NOT regexp_matches(coalesce(name, ''), '\S') OR NOT regexp_matches(coalesce(file, ''), '\S')
 UNION ALL SELECT 'Class', row_id, CASE WHEN NOT regexp_matches(coalesce(name, ''), '\S') THEN 'name' ELSE 'file' END FROM class_defs WHERE NOT regexp_matches(coalesce(name, ''), '\S') OR NOT regexp_matches(coalesce(file, ''), '\S')
 UNION ALL SELECT 'Import', row_id, CASE WHEN NOT regexp_matches(coalesce(module, ''), '\S') THEN 'module' ELSE 'file' END FROM import_decls WHERE NOT regexp_matches(coalesce(module, ''), '\S') OR NOT regexp_matches(coalesce(file, ''), '\S')
 UNION ALL SELECT 'File', file_id, 'path' FROM src_files WHERE NOT regexp_matches(coalesce(path, ''), '\S')"""
)
def validate_all(s: SparkSession, d: str) -> DataFrame:
    """Rows of every stored kind that violate a required field, with the first such field."""
    out = None
    for kind, (_, file, label, _) in snapshots.KINDS.items():
        rows = table(s, d, _TABLES[kind])
        bad = F.when(~X.not_blank(F.col(label)), label).when(~X.not_blank(F.col(file)), file)
        part = rows.select(F.lit(kind).alias("node"), F.col(_IDS[kind]).alias("row_id"), bad.alias("field")).filter("field is not null")
        out = part if out is None else out.unionByName(part)
    return out


@query(
    """WITH f AS (SELECT * FROM {fn}), q AS (SELECT DISTINCT CASE WHEN a.name = 'module' THEN '<module>' ELSE a.name END AS caller, a.file, e.dst FROM {edg} e JOIN f a ON a.fn_uid = e.src WHERE e.edge_type = 'callsFunction')
 SELECT q.caller, q.file, f.fn_uid AS src, q.dst FROM q JOIN f ON f.name = q.caller AND f.file = q.file"""
)
def caller_by_name_and_file(s: SparkSession, d: str) -> DataFrame:
    """Calls to their calling function by name and file; calls outside functions belong to ``<module>``."""
    f = _fn(s, d)
    calls = _edg(s, d).filter("edge_type = 'callsFunction'").join(f.select(F.col("fn_uid").alias("src"), "name", "file"), "src")
    named = calls.select(F.when(F.col("name") == "module", "<module>").otherwise(F.col("name")).alias("caller"), "file", "dst").distinct()
    return named.join(f.select(F.col("name").alias("caller"), "file", F.col("fn_uid").alias("src")), ["caller", "file"]).select("caller", "file", "src", "dst")


@query(
    """WITH m AS (SELECT name, fn_uid FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY file, row_id) AS rn FROM func_defs) WHERE rn = 1), c AS (SELECT row_id, module || '.' || item AS callee FROM (SELECT row_id, module, unnest(imported_items) AS item FROM import_decls) WHERE module IS NOT NULL)
 SELECT row_id, callee, coalesce(x.fn_uid, y.fn_uid) AS fn_uid FROM c LEFT JOIN m x ON x.name = callee LEFT JOIN m y ON contains(callee, '.') AND y.name = regexp_extract(callee, '([^.]*)$', 1)"""
)
def callee_dotted_fallback(s: SparkSession, d: str) -> DataFrame:
    """Dotted callees by their full name, else by their last segment; the first function of a name wins."""
    first = nodes.first_by(table(s, d, "func_defs").select("name", "fn_uid", "file", "row_id"), ["name"], F.col("file"), F.col("row_id")).select("name", "fn_uid")
    c = table(s, d, "import_decls").filter("module is not null").select("row_id", F.explode("imported_items").alias("item"), "module").select("row_id", F.concat_ws(".", "module", "item").alias("callee"))
    c = c.withColumn("last", F.when(F.col("callee").contains("."), F.substring_index("callee", ".", -1)))
    x, y = first.select(F.col("name").alias("callee"), F.col("fn_uid").alias("x")), first.select(F.col("name").alias("last"), F.col("fn_uid").alias("y"))
    return c.join(x, "callee", "left").join(y, "last", "left").select("row_id", "callee", F.coalesce("x", "y").alias("fn_uid"))


@query(
    """WITH m AS (SELECT name, class_uid FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY file, row_id) AS rn FROM class_defs) WHERE rn = 1)
 SELECT c.class_uid AS src, m.class_uid AS dst FROM (SELECT class_uid, unnest(base_classes) AS b FROM {cls}) c JOIN m ON m.name = b GROUP BY ALL"""
)
def inherit_first(s: SparkSession, d: str) -> DataFrame:
    """Classes to their bases by exact name; the first class of a name wins."""
    first = nodes.first_by(table(s, d, "class_defs").select("name", F.col("class_uid").alias("dst"), "file", "row_id"), ["name"], F.col("file"), F.col("row_id")).select("name", "dst")
    return _cls(s, d).select(F.col("class_uid").alias("src"), F.explode("base_classes").alias("name")).join(first, "name").select("src", "dst").distinct()


@query(
    """WITH q AS (SELECT DISTINCT repo, file, unnest(imported_items) AS name FROM import_decls), f AS (SELECT * FROM {fn}), d AS (SELECT DISTINCT repo, importer, imported FROM {deps}),
 c AS (SELECT q.*, f.fn_uid, CASE WHEN f.repo = q.repo AND f.file = q.file THEN 0 WHEN d.imported IS NOT NULL THEN 1 WHEN NOT suffix(rtrim(coalesce(f.signature, '')), ';') THEN 2 ELSE 3 END AS p
  FROM q JOIN f ON f.name = q.name LEFT JOIN d ON d.repo = q.repo AND d.importer = q.file AND f.repo = q.repo AND d.imported = f.file)
 SELECT repo, file, name, fn_uid, p FROM (SELECT *, row_number() OVER (PARTITION BY repo, file, name ORDER BY p, fn_uid) AS rn FROM c) WHERE rn = 1"""
)
def resolve_call_target(s: SparkSession, d: str) -> DataFrame:
    """Names to functions: the same file, else an imported file, else any definition before any prototype. Each scope is reduced to one candidate before it is joined."""
    q = table(s, d, "import_decls").select("repo", "file", F.explode("imported_items").alias("name")).distinct()
    f = _fn(s, d).select("repo", F.col("file").alias("owner"), "name", "fn_uid", F.when(F.rtrim(F.coalesce("signature", F.lit(""))).endswith(";"), 3).otherwise(2).alias("p"))
    near = f.groupBy("repo", "owner", "name").agg(F.min("fn_uid").alias("fn_uid"))
    own = q.join(near.withColumnRenamed("owner", "file"), ["repo", "file", "name"]).select("repo", "file", "name", F.struct(F.lit(0).alias("p"), "fn_uid").alias("x"))
    deps = _deps(s, d).select("repo", F.col("importer").alias("file"), F.col("imported").alias("owner")).distinct()
    far = q.join(deps, ["repo", "file"]).join(near, ["repo", "owner", "name"]).select("repo", "file", "name", F.struct(F.lit(1).alias("p"), "fn_uid").alias("x"))
    world = f.groupBy("name").agg(F.min(F.struct("p", "fn_uid")).alias("x"))
    best = own.unionByName(far).unionByName(q.join(world, "name").select("repo", "file", "name", "x")).groupBy("repo", "file", "name").agg(F.min("x").alias("x"))
    return best.select("repo", "file", "name", "x.fn_uid", "x.p")


@query("SELECT DISTINCT f.fn_uid, v.vec_id FROM embeddings v JOIN func_defs r ON r.row_id = v.vec_id JOIN {fn} f ON f.name = r.name AND f.file = r.file")
def vector_upsert(s: SparkSession, d: str) -> DataFrame:
    """Vectors attached to stored functions by name and file."""
    vectors = table(s, d, "embeddings").select(F.col("vec_id").alias("row_id")).join(table(s, d, "func_defs").select("row_id", "name", "file"), "row_id")
    return _fn(s, d).select("fn_uid", "name", "file").join(vectors, ["name", "file"]).select("fn_uid", F.col("row_id").alias("vec_id")).distinct()


@query(
    """SELECT f.repo, f.path AS file, coalesce(f.ast_nodes, 0) AS ast_nodes, count(*) FILTER (k = 'f') AS functions, count(*) FILTER (k = 'c') AS classes, count(*) FILTER (k = 'i') AS imports FROM {fil} f LEFT JOIN (
 SELECT repo, file, 'f' AS k FROM {fn} UNION ALL SELECT repo, file, 'c' FROM {cls} UNION ALL SELECT repo, file, 'i' FROM {imp}) x ON x.repo = f.repo AND x.file = f.path GROUP BY f.file_uid, f.repo, f.path, f.ast_nodes"""
)
def file_fact_counts(s: SparkSession, d: str) -> DataFrame:
    """Facts of every kind and syntax-tree size per file, files without facts too."""
    parts = ((_fn(s, d), "functions"), (_cls(s, d), "classes"), (nodes.imports(table(s, d, "import_decls")), "imports"))
    counts = reduce(DataFrame.unionByName, (df.select("repo", F.col("file").alias("path"), F.lit(k).alias("k")) for df, k in parts))
    counts = counts.groupBy("repo", "path").agg(*(F.count_if(F.col("k") == k).alias(k) for _, k in parts))
    out = _fil(s, d).select("repo", "path", "ast_nodes").join(counts, ["repo", "path"], "left")
    return out.select("repo", F.col("path").alias("file"), F.coalesce("ast_nodes", F.lit(0)).alias("ast_nodes"), *(F.coalesce(k, F.lit(0)).alias(k) for _, k in parts))


@query("SELECT DISTINCT 'module' AS map, module AS key, file AS value FROM import_decls WHERE module IS NOT NULL UNION ALL SELECT DISTINCT 'file name', regexp_extract(module, '([^/]*)$', 1), module FROM import_decls WHERE module IS NOT NULL")
def multimap_rows(s: SparkSession, d: str) -> DataFrame:
    """Module to its files, and file name to its modules: a multimap is a table of distinct pairs."""
    i = table(s, d, "import_decls").filter("module is not null")
    a = i.select(F.lit("module").alias("map"), F.col("module").alias("key"), F.col("file").alias("value")).distinct()
    return a.unionByName(i.select(F.lit("file name").alias("map"), X.basename(F.col("module")).alias("key"), F.col("module").alias("value")).distinct())


@query("SELECT DISTINCT b.name AS callee, a.name AS caller FROM {edg} e JOIN {fn} a ON a.fn_uid = e.src JOIN {fn} b ON b.fn_uid = e.dst WHERE e.edge_type = 'callsFunction'")
def call_graph_rows(s: SparkSession, d: str) -> DataFrame:
    """Callee names with each of their callers' names."""
    f = _fn(s, d).select("fn_uid", "name")
    calls = _edg(s, d).filter("edge_type = 'callsFunction'").join(f.select(F.col("fn_uid").alias("src"), F.col("name").alias("caller")), "src")
    return calls.join(f.select(F.col("fn_uid").alias("dst"), F.col("name").alias("callee")), "dst").select("callee", "caller").distinct()


_METHODS = """(SELECT DISTINCT c.class_uid AS src, f.fn_uid AS dst FROM (SELECT class_uid, repo, file, unnest(methods) AS name FROM {cls}) c JOIN {fn} f ON f.repo = c.repo AND f.file = c.file AND f.name = c.name)"""
_INHERITS = """(SELECT DISTINCT b.class_uid AS src, c.class_uid AS dst FROM (SELECT class_uid, repo, unnest(base_classes) AS b FROM {cls}) b JOIN {cls} c ON c.repo = b.repo AND c.name = {bare})"""


def _methods(s: SparkSession, d: str) -> DataFrame:
    c = _cls(s, d).select(F.col("class_uid").alias("src"), "repo", "file", F.explode("methods").alias("name"))
    return c.join(_fn(s, d).select("repo", "file", "name", F.col("fn_uid").alias("dst")), ["repo", "file", "name"]).select("src", "dst").distinct()


def _inherits(s: SparkSession, d: str) -> DataFrame:
    c = _cls(s, d)
    b = c.select(F.col("class_uid").alias("src"), "repo", F.explode("base_classes").alias("b")).select("src", "repo", bare_name(F.col("b")).alias("name"))
    return b.join(c.select("repo", "name", F.col("class_uid").alias("dst")), ["repo", "name"]).select("src", "dst").distinct()


def _contains(s: SparkSession, d: str) -> DataFrame:
    part = lambda df, uid: df.select("repo", F.col("file").alias("path"), F.col(uid).alias("dst"))
    return part(_fn(s, d), "fn_uid").unionByName(part(_cls(s, d), "class_uid")).join(_fil(s, d).select("repo", "path", F.col("file_uid").alias("src")), ["repo", "path"]).select("src", "dst")


@query(
    f"""SELECT DISTINCT src || '-method-' || dst AS id, src AS source, dst AS target, 'method' AS relation FROM {_METHODS} UNION SELECT src || '-inherits-' || dst, src, dst, 'inherits' FROM {_INHERITS}
 UNION SELECT f.file_uid || '-' || x.uid, f.file_uid, x.uid, 'contains' FROM (SELECT fn_uid AS uid, repo, file FROM {{fn}} UNION ALL SELECT class_uid, repo, file FROM {{cls}}) x JOIN {{fil}} f ON f.repo = x.repo AND f.path = x.file
 UNION SELECT src || '-calls-' || dst, src, dst, 'calls' FROM {{edg}} WHERE edge_type = 'callsFunction'"""
)
def graph_relations(s: SparkSession, d: str) -> DataFrame:
    """All drawn relations as edge elements: methods, bases, contents of files, calls."""
    parts = [(_methods(s, d), "-method-", "method"), (_inherits(s, d), "-inherits-", "inherits"), (_contains(s, d), "-", "contains"), (_edg(s, d).filter("edge_type = 'callsFunction'").select("src", "dst"), "-calls-", "calls")]
    union = reduce(DataFrame.unionByName, (df.select(F.concat("src", F.lit(mark), "dst").alias("id"), F.col("src").alias("source"), F.col("dst").alias("target"), F.lit(name).alias("relation")) for df, mark, name in parts))
    return union.distinct()


_TERMS = "list_has_all(list_filter(string_split_regex(lower({0}), '[^a-z0-9]+'), lambda t: t <> ''), ['{1}'])"


@query(
    f"""WITH m AS (SELECT class_uid AS uid, repo, file FROM {{cls}} WHERE {_TERMS.format("name", "walker")}), fl AS (SELECT file_uid AS uid, repo, path FROM {{fil}} WHERE {_TERMS.format("path", "walker")})
 SELECT m.uid AS match, 'class' AS kind, 'file' AS relation, f.file_uid AS neighbour FROM m JOIN {{fil}} f ON f.repo = m.repo AND f.path = m.file UNION SELECT m.uid, 'class', 'base', i.dst FROM m JOIN {_INHERITS} i ON i.src = m.uid
 UNION SELECT m.uid, 'class', 'method', i.dst FROM m JOIN {_METHODS} i ON i.src = m.uid UNION SELECT fl.uid, 'file', 'function', x.fn_uid FROM fl JOIN {{fn}} x ON x.repo = fl.repo AND x.file = fl.path UNION SELECT fl.uid, 'file', 'class', x.class_uid FROM fl JOIN {{cls}} x ON x.repo = fl.repo AND x.file = fl.path"""
)
def search_classes_and_files(s: SparkSession, d: str) -> DataFrame:
    """Classes and files that match a text query, with their files, bases, methods and contents."""
    c = _cls(s, d).filter(X.all_terms(F.col("name"), "walker")).select(F.col("class_uid").alias("match"), "repo", F.col("file").alias("path"))
    f = _fil(s, d).filter(X.all_terms(F.col("path"), "walker")).select(F.col("file_uid").alias("match"), "repo", "path")
    out = lambda df, kind, relation, uid: df.select("match", F.lit(kind).alias("kind"), F.lit(relation).alias("relation"), F.col(uid).alias("neighbour"))
    own = c.join(_fil(s, d).select("repo", "path", "file_uid"), ["repo", "path"])
    bases, methods = (c.join(e.withColumnRenamed("src", "match"), "match") for e in (_inherits(s, d), _methods(s, d)))
    functions = f.join(_fn(s, d).select("repo", F.col("file").alias("path"), "fn_uid"), ["repo", "path"])
    classes = f.join(_cls(s, d).select("repo", F.col("file").alias("path"), "class_uid"), ["repo", "path"])
    parts = [out(own, "class", "file", "file_uid"), out(bases, "class", "base", "dst"), out(methods, "class", "method", "dst"), out(functions, "file", "function", "fn_uid"), out(classes, "file", "class", "class_uid")]
    return reduce(DataFrame.unionByName, parts).distinct()


_ASKED = "SELECT 'function' AS kind, name FROM func_defs WHERE row_id % 100 = 0 UNION SELECT 'class', name FROM class_defs WHERE row_id % 100 = 0"


@query(
    f"""WITH q AS ({_ASKED}), hits AS (SELECT q.kind, f.fn_uid AS uid, f.name, f.file, coalesce(f.docstring, '') AS detail FROM q JOIN {{fn}} f ON q.kind = 'function' AND f.name = q.name
 UNION ALL SELECT q.kind, c.class_uid, c.name, c.file, coalesce(array_to_string(c.methods, ','), '') FROM q JOIN {{cls}} c ON q.kind = 'class' AND c.name = q.name)
 SELECT * FROM hits UNION ALL SELECT DISTINCT 'file', NULL, NULL, file, '' FROM hits"""
)
def query_context(s: SparkSession, d: str) -> DataFrame:
    """Context of the asked functions and classes: both, and the distinct files that hold them, missing values filled."""
    asked = lambda t: table(s, d, t).filter("row_id % 100 = 0").select("name").distinct()
    f = _fn(s, d).join(asked("func_defs"), "name").select(F.lit("function").alias("kind"), F.col("fn_uid").alias("uid"), "name", "file", F.coalesce("docstring", F.lit("")).alias("detail"))
    c = _cls(s, d).join(asked("class_defs"), "name").select(F.lit("class").alias("kind"), F.col("class_uid").alias("uid"), "name", "file", F.coalesce(F.array_join("methods", ","), F.lit("")).alias("detail"))
    hits = f.unionByName(c)
    none = F.lit(None).cast("string")
    return hits.unionByName(hits.select("file").distinct().select(F.lit("file").alias("kind"), none.alias("uid"), none.alias("name"), "file", F.lit("").alias("detail")))


@query(
    """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), n AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS len FROM v),
 t AS (SELECT 'function' AS type, vec_id, e, len FROM n WHERE vec_id IN (SELECT row_id FROM func_defs) UNION ALL SELECT 'class', vec_id, e, len FROM n WHERE vec_id IN (SELECT row_id FROM class_defs)),
 k AS (SELECT type, q.vec_id AS query_id, t.vec_id, row_number() OVER (PARTITION BY type, q.vec_id ORDER BY round(list_dot_product(q.e, t.e) / (q.len * t.len), 6) DESC, t.vec_id) AS rank FROM n q JOIN t ON q.vec_id % 100 = 0)
 SELECT * FROM k WHERE rank <= 5"""
)
def topk_per_type(s: SparkSession, d: str) -> DataFrame:
    """Five nearest functions and five nearest classes of each vector whose id is divisible by 100."""
    e = table(s, d, "embeddings")
    out = None
    for kind, name in (("function", "func_defs"), ("class", "class_defs")):
        rows = e.join(table(s, d, name).select(F.col("row_id").alias("vec_id")), "vec_id", "left_semi")
        part = search.nearest(e.filter("vec_id % 100 = 0"), rows, 5, 64).select(F.lit(kind).alias("type"), "query_id", "vec_id", "rank")
        out = part if out is None else out.unionByName(part)
    return out


@query()
def knn_indexed(s: SparkSession, d: str) -> DataFrame:
    """Ten nearest vectors of every vector whose id is divisible by 100, by an index of cells that holds all vectors."""
    e = table(s, d, "embeddings")
    return search.CellIndex(e, 64).nearest(e.filter("vec_id % 100 = 0"), 10).select("query_id", "vec_id", "rank")


@query()
def knn_recall(s: SparkSession, d: str) -> DataFrame:
    """Share of the exact ten nearest vectors that the index finds."""
    e = table(s, d, "embeddings")
    asked = e.filter("vec_id % 100 = 0")
    return search.recall(search.CellIndex(e, 64).nearest(asked, 10), search.nearest(asked, e, 10, 64))


@query(
    """WITH h AS (SELECT DISTINCT b.name AS symbol, a.repo, a.file FROM {edg} e JOIN {fn} a ON a.fn_uid = e.src JOIN {fn} b ON b.fn_uid = e.dst WHERE e.edge_type = 'callsFunction')
 SELECT symbol, count(*) AS count, min(file) AS first_file FROM h GROUP BY ALL"""
)
def symbol_usage_counts(s: SparkSession, d: str) -> DataFrame:
    """Number of files that use each function symbol."""
    f = _fn(s, d)
    calls = _edg(s, d).filter("edge_type = 'callsFunction'").join(f.select(F.col("fn_uid").alias("src"), "repo", "file"), "src").join(f.select(F.col("fn_uid").alias("dst"), F.col("name").alias("symbol")), "dst")
    return calls.select("symbol", "repo", "file").distinct().groupBy("symbol").agg(_n().alias("count"), F.min("file").alias("first_file"))


@query("SELECT repo, path, file_id, position FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY path, file_id) AS position FROM src_files)")
def ordered_scan(s: SparkSession, d: str) -> DataFrame:
    """Files of each repository in path order, with their position."""
    order = Window.partitionBy("repo").orderBy("path", "file_id")
    return table(s, d, "src_files").select("repo", "path", "file_id").withColumn("position", F.row_number().over(order))
