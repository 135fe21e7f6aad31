"""Registered queries of the code-graph engine, each with its SQL counterpart.

Nodes are the stored tables (Function = func_defs, Class = class_defs, Import =
import_decls, File = src_files), edges are graph_edges; where a query needs
columns that these lack, another given table takes their place.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.functions import exprs as X
from graphloom.operators import nodes, search, snapshots, traverse
from graphloom.session import small_side
from graphloom.sources.tables import table
from graphloom.streaming import debounce

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


_REGISTRIES = {__name__: (QUERIES, SQL)}


def registry(module: str) -> tuple[dict[str, Callable[[SparkSession, str], DataFrame]], dict[str, str]]:
    """The queries and SQL of a module that uses ``query``."""
    return _REGISTRIES.setdefault(module, ({}, {}))


def query(sql: str | None = None) -> Callable:
    """Register a query under its function's name, with its SQL."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        queries, texts = registry(f.__module__)
        queries[f.__name__] = f
        if sql is not None:
            texts[f.__name__] = sql.format(**_CTES) if "{" in sql else sql
        return f

    return add


def _latest_sql(view: str, key: str, order: str) -> str:
    return f"(SELECT * EXCLUDE (rn_) FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY indexed_at DESC NULLS LAST, {order} DESC) AS rn_ FROM {view}) WHERE rn_ = 1)"


_MODULE = r"array_to_string(list_filter(string_split(regexp_replace(regexp_replace({0}, '\.py$', ''), '^((cli|src|lib|python)/)+', ''), '/'), lambda x: x <> '' AND x <> '__pycache__'), '.')"
_RELATIVE = r"""(SELECT path, CASE
 WHEN list_position(p, 'packages') > 0 THEN array_to_string(p[list_position(p, 'packages'):], '/') WHEN list_position(p, 'src') > 0 THEN array_to_string(p[list_position(p, 'src') + 1:], '/')
 WHEN list_position(p, 'include') > 0 THEN array_to_string(p[list_position(p, 'include'):], '/') WHEN list_position(p, 'lib') > 0 THEN array_to_string(p[list_position(p, 'lib'):], '/')
 WHEN len(h) > 0 THEN array_to_string(p[list_min(h):], '/') ELSE p[-1] END AS relative FROM (
 SELECT path, p, list_filter(list_transform(['comm', 'validation', 'sql', 'encryption', 'transactions', 'initialization', 'keystore', 'signing', 'utils', 'tests'], lambda c: list_position(p, c)), lambda x: x > 0) AS h FROM (SELECT path, string_split(path, '/') AS p FROM {0})))"""
_ALL_PATHS = "(SELECT repo, path FROM src_files WHERE path IS NOT NULL UNION SELECT repo, file FROM import_decls WHERE file IS NOT NULL)"
_DECLARED = r"""(SELECT DISTINCT repo, file AS importer, regexp_replace(module, '^[\s"''`]+|[\s"''`]+$', '', 'g') AS m FROM import_decls WHERE module IS NOT NULL AND file IS NOT NULL)"""
_C_PATHS = rf"(SELECT path FROM {_ALL_PATHS} UNION SELECT regexp_replace(path, '\.c$', '.h') FROM {_ALL_PATHS})"
_C_TARGETS = rf"""(SELECT f.repo, f.path AS imported, r.relative AS target FROM {_ALL_PATHS} f JOIN {_RELATIVE.format(_C_PATHS)} r ON r.path = f.path OR r.path = regexp_replace(f.path, '\.c$', '.h') WHERE regexp_matches(f.path, '\.[ch]$'))"""
_C_ROOTS = rf"""(SELECT * FROM {_C_TARGETS} UNION SELECT repo, path, regexp_extract(regexp_replace(path, '\.c$', '.h'), '([^/]*)$', 1) FROM {_ALL_PATHS} WHERE regexp_matches(path, '\.[ch]$'))"""
_C_MATCH = r"""(SELECT DISTINCT i.repo, importer, imported, m AS module FROM {declared} i JOIN {targets} t ON t.repo = i.repo AND i.m <> '' AND importer NOT LIKE '%.py'
  AND regexp_extract(m, '([^/]*)$', 1) = regexp_extract(target, '([^/]*)$', 1) AND (m = target OR NOT contains(target, '/') OR suffix(m, '/' || target) OR suffix(target, '/' || m)))"""
_PY_MATCH = rf"""(SELECT DISTINCT i.repo, importer, imported, m AS module FROM (SELECT *, regexp_replace(m, '^\.+', '') AS nm FROM {_DECLARED} WHERE importer LIKE '%.py') i
  JOIN (SELECT repo, path AS imported, {_MODULE.format("path")} AS nt FROM {_ALL_PATHS} WHERE path LIKE '%.py') f ON f.repo = i.repo AND nm <> '' AND (
   nm = nt OR (contains(nm, '.') AND starts_with(nt, nm || '.')) OR starts_with(nm, nt || '.') OR (starts_with(m, '.') AND suffix(nt, '.' || nm))))"""

_CTES = {
    "pymatch": _PY_MATCH,
    "cmatch": _C_MATCH.format(declared=_DECLARED, targets=_C_TARGETS),
    "croots": _C_MATCH.format(declared=_DECLARED, targets=_C_ROOTS),
    "fn": _latest_sql("func_defs", "fn_uid", "row_id"),
    "cls": _latest_sql("class_defs", "class_uid", "row_id"),
    "imp": _latest_sql("import_decls", "import_uid", "row_id"),
    "fil": _latest_sql("src_files", "file_uid", "file_id"),
    "edg": r"(SELECT DISTINCT edge_type, lower(regexp_replace(src_uid, '^\s+|\s+$', '', 'g')) AS src, lower(regexp_replace(dst_uid, '^\s+|\s+$', '', 'g')) AS dst FROM graph_edges WHERE dst_uid IS NOT NULL AND src_uid IS NOT NULL)",
    "bare": r"trim(regexp_extract(regexp_replace(regexp_replace(b, '[\[(<].*$', ''), '^\s+|\s+$', '', 'g'), '([^.:]*)$', 1))",
    "deps": r"""(SELECT DISTINCT d.repo, importer, imported, module FROM
 (SELECT DISTINCT repo, file AS importer, regexp_replace(module, '^[\s"''`]+|[\s"''`]+$', '', 'g') AS module FROM import_decls WHERE module IS NOT NULL AND file IS NOT NULL) d
 JOIN (SELECT DISTINCT repo, path AS imported FROM src_files WHERE path IS NOT NULL) f ON d.repo = f.repo AND module <> '' AND (
  (importer LIKE '%.py' AND imported LIKE '%.py'
   AND regexp_replace(replace(regexp_replace(regexp_replace(imported, '\.py$', ''), '^((src|lib|cli|python)/)+', ''), '/', '.'), '(^|\.)__init__$', '')
     = CASE WHEN module NOT LIKE '.%' THEN module ELSE array_to_string(list_filter(list_concat(
        list_slice(string_split(regexp_replace(regexp_replace(importer, '\.py$', ''), '^((src|lib|cli|python)/)+', ''), '/'), 1,
          greatest(len(string_split(regexp_replace(regexp_replace(importer, '\.py$', ''), '^((src|lib|cli|python)/)+', ''), '/')) - length(regexp_extract(module, '^(\.*)', 1)), 0)),
        [regexp_replace(module, '^\.+', '')]), lambda s: s <> ''), '.') END)
  OR (importer NOT LIKE '%.py' AND regexp_matches(imported, '\.[ch]$') AND (imported = module OR suffix(imported, '/' || module)))))""",
}


def _fn(s: SparkSession, d: str) -> DataFrame:
    return nodes.functions(table(s, d, "func_defs"))


def _cls(s: SparkSession, d: str) -> DataFrame:
    return nodes.classes(table(s, d, "class_defs"))


def _imp(s: SparkSession, d: str) -> DataFrame:
    return nodes.imports(table(s, d, "import_decls"))


def _fil(s: SparkSession, d: str) -> DataFrame:
    return nodes.files(table(s, d, "src_files"))


def _edg(s: SparkSession, d: str) -> DataFrame:
    return nodes.edges(table(s, d, "graph_edges"))


def _deps(s: SparkSession, d: str) -> DataFrame:
    return traverse.file_dependencies(table(s, d, "import_decls"), table(s, d, "src_files"))


def _n() -> Column:
    return F.count(F.lit(1))


# --- flagship and closures -----------------------------------------------------


_REACHED = """seeds AS (SELECT DISTINCT repo, path FROM {fil} WHERE file_id % 100 = 0), py AS {pymatch},
 steps AS (SELECT DISTINCT repo, imported AS a, importer AS b FROM (SELECT * FROM py UNION ALL SELECT * FROM {cmatch})), firsts AS (SELECT DISTINCT repo, imported AS a, importer AS b FROM (SELECT * FROM py UNION ALL SELECT * FROM {croots})),
 r(repo, seed, node, depth) AS (SELECT s.repo, path, b, CAST(1 AS BIGINT) FROM seeds s JOIN firsts f ON f.repo = s.repo AND f.a = s.path UNION SELECT r.repo, seed, b, depth + 1 FROM r JOIN steps ON steps.repo = r.repo AND a = node WHERE depth < 21),
 deps AS (SELECT repo, seed, node, min(depth) AS depth FROM r WHERE node <> seed OR seed NOT LIKE '%.py' GROUP BY ALL)"""


@query(
    "WITH RECURSIVE " + _REACHED + """, fn AS (SELECT fn_uid, repo, file, name FROM {fn}),
 callers AS (SELECT s.repo, s.path AS changed, c.file AS affected FROM seeds s JOIN fn f ON f.repo = s.repo AND f.file = s.path AND trim(f.name) <> '' AND f.name <> '<module>' JOIN fn g ON g.repo = f.repo AND g.name = f.name
  JOIN {edg} e ON e.edge_type = 'callsFunction' AND e.dst = g.fn_uid JOIN fn c ON c.fn_uid = e.src AND c.repo = s.repo)
 SELECT DISTINCT repo, seed AS changed, node AS affected, 'import' AS category FROM deps WHERE seed <> node
 UNION SELECT DISTINCT repo, changed, affected, 'caller' FROM callers WHERE affected <> changed"""
)
def flagship_impact_analysis(s: SparkSession, d: str) -> DataFrame:
    """Files affected by each changed file: importers at any distance up to 21 and callers by name (changed: files with an id divisible by 100)."""
    changed = _fil(s, d).filter("file_id % 100 = 0")
    return traverse.impact(changed, table(s, d, "import_decls"), table(s, d, "src_files"), _fn(s, d), _edg(s, d))


@query(
    """WITH RECURSIVE steps AS (SELECT DISTINCT src, dst FROM {edg} WHERE edge_type = 'callsFunction'), seeds AS (SELECT fn_uid FROM {fn} WHERE row_id % 100 = 0),
 r(seed, node, depth) AS (SELECT fn_uid, fn_uid, CAST(0 AS BIGINT) FROM seeds UNION SELECT seed, dst, depth + 1 FROM r JOIN steps ON src = node WHERE depth < 2)
 SELECT seed, node, min(depth) AS depth FROM r GROUP BY ALL"""
)
def calls_within_two(s: SparkSession, d: str) -> DataFrame:
    """Functions that each stated function calls within two steps."""
    seeds = _fn(s, d).filter("row_id % 100 = 0").select(F.col("fn_uid").alias("seed"), F.col("fn_uid").alias("node"))
    steps = _edg(s, d).filter("edge_type = 'callsFunction'").select(F.col("src").alias("a"), F.col("dst").alias("b"))
    return traverse.closure(seeds, steps, max_depth=2)


def _dependents(s: SparkSession, d: str) -> DataFrame:
    return traverse.dependents(_fil(s, d).filter("file_id % 100 = 0"), table(s, d, "import_decls"), table(s, d, "src_files"))


@query("WITH RECURSIVE " + _REACHED + " SELECT repo, seed, node, depth FROM deps")
def deps_transitive(s: SparkSession, d: str) -> DataFrame:
    """Files that import or include each stated file, directly or not, with their least distance (1 to 21)."""
    return _dependents(s, d).select("repo", F.col("changed").alias("seed"), F.col("file").alias("node"), "depth")


@query("WITH RECURSIVE " + _REACHED + " SELECT s.repo, s.path AS file, count(node) AS count, coalesce(max(depth), 0) AS depth FROM seeds s LEFT JOIN deps d ON d.repo = s.repo AND d.seed = s.path GROUP BY ALL")
def deps_summary(s: SparkSession, d: str) -> DataFrame:
    """Number of dependents of each stated file and their greatest distance, 0 without any."""
    per = _dependents(s, d).groupBy("repo", F.col("changed").alias("path")).agg(_n().alias("count"), F.max("depth").alias("depth"))
    seeds = _fil(s, d).filter("file_id % 100 = 0").select("repo", "path").distinct()
    return seeds.join(per, ["repo", "path"], "left").select("repo", F.col("path").alias("file"), F.coalesce("count", F.lit(0)).alias("count"), F.coalesce("depth", F.lit(0)).alias("depth"))


@query("SELECT repo, importer, imported, module FROM {pymatch}")
def python_import_matching(s: SparkSession, d: str) -> DataFrame:
    """Imports against all Python files they may mean: same, parent and child modules, relative suffixes."""
    return traverse.python_matches(table(s, d, "import_decls"), table(s, d, "src_files"))


@query("SELECT repo, importer, imported, module FROM {cmatch}")
def include_matching(s: SparkSession, d: str) -> DataFrame:
    """Includes against all C files they may mean by their relative paths."""
    return traverse.c_matches(table(s, d, "import_decls"), table(s, d, "src_files"))


@query("SELECT repo, importer, imported, module FROM {croots}")
def include_matching_roots(s: SparkSession, d: str) -> DataFrame:
    """The same for files that are asked for first, by their bare names too."""
    return traverse.c_matches(table(s, d, "import_decls"), table(s, d, "src_files"), roots=True)


@query("SELECT max(n) AS most, count(*) AS files FROM (" + "SELECT repo, importer, count(DISTINCT imported) AS n FROM {deps} GROUP BY ALL)")
def max_fan_out(s: SparkSession, d: str) -> DataFrame:
    """Most files that one file imports."""
    per = _deps(s, d).groupBy("repo", "importer").agg(F.countDistinct("imported").alias("n"))
    return per.agg(F.max("n").alias("most"), _n().alias("files"))


@query("SELECT repo, importer, imported, module FROM {deps}")
def import_resolution(s: SparkSession, d: str) -> DataFrame:
    """Imports resolved to files (Python modules and C includes)."""
    return _deps(s, d)


@query("SELECT f.repo, f.path AS file, count(DISTINCT imported) AS dependencies, min(imported) AS first FROM (SELECT DISTINCT repo, path FROM src_files WHERE path IS NOT NULL) f LEFT JOIN {deps} d ON d.repo = f.repo AND d.importer = f.path AND d.imported <> f.path GROUP BY ALL")
def file_deps(s: SparkSession, d: str) -> DataFrame:
    """Files with how many files they depend on, those without any too; the pairs themselves are ``import_resolution``."""
    per = _deps(s, d).filter("imported <> importer").groupBy("repo", F.col("importer").alias("path")).agg(F.countDistinct("imported").alias("n"), F.min("imported").alias("first"))
    files = table(s, d, "src_files").filter("path is not null").select("repo", "path").distinct()
    return files.join(per, ["repo", "path"], "left").select("repo", F.col("path").alias("file"), F.coalesce("n", F.lit(0)).alias("dependencies"), "first")


# --- scans, filters, projections -------------------------------------------------


@query("SELECT row_id, name, file, line_no FROM func_defs WHERE name = '__init__'")
def scan_eq_lookup(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "func_defs").filter("name = '__init__'").select("row_id", "name", "file", "line_no")


@query("SELECT row_id, file, module FROM import_decls WHERE module IS NOT NULL AND alias IS NOT NULL")
def scan_has(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "import_decls").filter("module is not null and alias is not null").select("row_id", "file", "module")


@query("SELECT f.row_id, f.fn_uid FROM func_defs f WHERE EXISTS (SELECT 1 FROM graph_edges e WHERE e.edge_type = 'callsFunction' AND e.dst_uid = f.fn_uid)")
def scan_uid_in(s: SparkSession, d: str) -> DataFrame:
    """Functions whose uid is in a list: a semi-join however long the list is."""
    wanted = table(s, d, "graph_edges").filter("edge_type = 'callsFunction'").select(F.col("dst_uid").alias("fn_uid"))
    return table(s, d, "func_defs").join(wanted, "fn_uid", "left_semi").select("row_id", "fn_uid")


@query(
    """SELECT uid, kind, label FROM (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY p) AS rn FROM (
 SELECT file_uid AS uid, 1 AS p, 'File' AS kind, path AS label FROM {fil} UNION ALL SELECT fn_uid, 2, 'Function', name FROM {fn}
 UNION ALL SELECT class_uid, 3, 'Class', name FROM {cls} UNION ALL SELECT import_uid, 4, 'Import', module FROM {imp})) WHERE rn = 1"""
)
def get_by_id_polymorphic(s: SparkSession, d: str) -> DataFrame:
    """Each uid with its first kind in the order File, Function, Class, Import."""
    parts = [(_fil(s, d), "file_uid", "File", "path"), (_fn(s, d), "fn_uid", "Function", "name"), (_cls(s, d), "class_uid", "Class", "name"), (_imp(s, d), "import_uid", "Import", "module")]
    union = None
    for p, (df, uid, kind, label) in enumerate(parts):
        part = df.select(F.col(uid).alias("uid"), F.struct(F.lit(p).alias("p"), F.lit(kind).alias("kind"), F.col(label).alias("label")).alias("x"))
        union = part if union is None else union.unionByName(part)
    return union.groupBy("uid").agg(F.min_by("x", "x.p").alias("x")).select("uid", "x.kind", "x.label")


@query(
    "SELECT q.name, f.repo, f.file, f.line_no FROM (SELECT DISTINCT name FROM func_defs WHERE row_id % 100 = 0) q JOIN {fn} f ON f.name = q.name"
)
def multi_root_lookup(s: SparkSession, d: str) -> DataFrame:
    """Many look-ups by name in one join."""
    wanted = table(s, d, "func_defs").filter("row_id % 100 = 0").select("name").distinct()
    return _fn(s, d).join(wanted, "name").select("name", "repo", "file", "line_no")


@query("SELECT row_id, coalesce(signature, '') AS signature, coalesce(return_type, '') AS return_type, coalesce(docstring, '') AS docstring, CAST(coalesce(line_no, 0) AS INTEGER) AS line FROM func_defs")
def default_fill_rename(s: SparkSession, d: str) -> DataFrame:
    filled = [F.coalesce(c, F.lit("")).alias(c) for c in ("signature", "return_type", "docstring")]
    return table(s, d, "func_defs").select("row_id", *filled, F.coalesce("line_no", F.lit(0)).cast("int").alias("line"))


@query("SELECT row_id, substr(sha256(concat_ws('@', name, file)), 1, 16) AS uid, substr(sha256(concat_ws('@', name, file)), 1, 16) = fn_uid AS same FROM func_defs")
def node_uid(s: SparkSession, d: str) -> DataFrame:
    u = X.uid("name", "file")
    return table(s, d, "func_defs").select("row_id", u.alias("uid"), (u == F.col("fn_uid")).alias("same"))


@query(r"""SELECT 'Function' AS node, row_id, CASE WHEN NOT regexp_matches(coalesce(name, ''), '\S') THEN 'name' ELSE 'file' END AS field FROM func_defs WHERE NOT regexp_matches(coalesce(name, ''), '\S') OR NOT regexp_matches(coalesce(file, ''), '\S')
 UNION ALL SELECT 'Import', row_id, 'module' FROM import_decls WHERE NOT regexp_matches(coalesce(module, ''), '\S') OR module = '<unknown>'""")
def validate_required(s: SparkSession, d: str) -> DataFrame:
    """Rows that violate a required field."""
    f = table(s, d, "func_defs").filter(~X.not_blank(F.col("name")) | ~X.not_blank(F.col("file")))
    i = table(s, d, "import_decls").filter(~X.not_blank(F.col("module")) | (F.col("module") == "<unknown>"))
    return f.select(F.lit("Function").alias("node"), "row_id", F.when(~X.not_blank(F.col("name")), "name").otherwise("file").alias("field")).unionByName(
        i.select(F.lit("Import").alias("node"), "row_id", F.lit("module").alias("field"))
    )


@query("SELECT row_id, CAST(CASE WHEN line_no = 0 THEN 1 ELSE line_no END AS INTEGER) AS line FROM func_defs")
def line_coerce(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "func_defs").select("row_id", F.when(F.col("line_no") == 0, 1).otherwise(F.col("line_no")).cast("int").alias("line"))


@query("SELECT row_id, name FROM func_defs WHERE list_has_all(list_filter(string_split_regex(lower(name), '[^a-z0-9]+'), lambda t: t <> ''), ['trace', 'callee'])")
def term_match_all(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "func_defs").filter(X.all_terms(F.col("name"), "callee trace")).select("row_id", "name")


@query("SELECT row_id, name FROM func_defs WHERE regexp_matches(name, '^_?(flush|merge)_[a-z]+$')")
def regex_filter(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "func_defs").filter(F.col("name").rlike("^_?(flush|merge)_[a-z]+$")).select("row_id", "name")


@query("SELECT row_id, name FROM class_defs WHERE contains(lower(name), 'walker')")
def substring_ci(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "class_defs").filter(F.lower("name").contains("walker")).select("row_id", "name")


@query("SELECT file_id, path FROM src_files WHERE path GLOB 'src/*_c*.py' OR regexp_extract(path, '([^/]*)$', 1) GLOB 'src/*_c*.py' OR path GLOB '__init__.*' OR regexp_extract(path, '([^/]*)$', 1) GLOB '__init__.*'")
def glob_match(s: SparkSession, d: str) -> DataFrame:
    """Shell patterns on the path or the file name."""
    p = F.col("path")
    return table(s, d, "src_files").filter(X.glob_match(p, "src/*_c*.py") | X.glob_match(p, "__init__.*")).select("file_id", "path")


@query("SELECT row_id, name FROM func_defs WHERE name <> '' AND (contains(coalesce(parameters, ''), '(*') OR contains(lower(coalesce(return_type, '')), 'function') OR contains(name, 'callback'))")
def indirect_heuristic(s: SparkSession, d: str) -> DataFrame:
    """Functions that take or look like function pointers."""
    hit = F.coalesce("parameters", F.lit("")).contains("(*") | F.lower(F.coalesce("return_type", F.lit(""))).contains("function") | F.col("name").contains("callback")
    return table(s, d, "func_defs").filter((F.col("name") != "") & hit).select("row_id", "name")


@query("SELECT vec_id, len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AS valid, len(list_filter(embedding, lambda x: x <> 0)) = 0 AS zero FROM embeddings")
def valid_vector_filter(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "embeddings")
    return e.select("vec_id", X.valid_vector(F.col("embedding"), 64).alias("valid"), X.zero_vector(F.col("embedding")).alias("zero"))


@query(r"""SELECT file_id, CASE WHEN regexp_matches(lower(path), '\.py$') THEN 'python' WHEN regexp_matches(lower(path), '\.(c|h)$') THEN 'c' WHEN regexp_matches(lower(path), '\.(cpp|cc|cxx|hpp|hh|hxx)$') THEN 'cpp' END AS language FROM src_files""")
def language_detection(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "src_files").select("file_id", X.language_of(F.col("path")).alias("language"))


@query(r"""SELECT DISTINCT path, CASE
 WHEN list_position(p, 'packages') > 0 THEN array_to_string(p[list_position(p, 'packages'):], '/') WHEN list_position(p, 'src') > 0 THEN array_to_string(p[list_position(p, 'src') + 1:], '/')
 WHEN list_position(p, 'include') > 0 THEN array_to_string(p[list_position(p, 'include'):], '/') WHEN list_position(p, 'lib') > 0 THEN array_to_string(p[list_position(p, 'lib'):], '/')
 WHEN len(h) > 0 THEN array_to_string(p[list_min(h):], '/') ELSE p[-1] END AS relative FROM (
 SELECT path, p, list_filter(list_transform(['comm', 'validation', 'sql', 'encryption', 'transactions', 'initialization', 'keystore', 'signing', 'utils', 'tests'], lambda c: list_position(p, c)), lambda x: x > 0) AS h FROM (SELECT path, string_split(path, '/') AS p FROM src_files))""")
def path_relative(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "src_files").select("path", X.relative_path(F.col("path")).alias("relative")).distinct()


@query(r"""SELECT DISTINCT path, array_to_string(list_filter(string_split(regexp_replace(regexp_replace(path, '\.py$', ''), '^((cli|src|lib|python)/)+', ''), '/'), lambda x: x <> '' AND x <> '__pycache__'), '.') AS module FROM src_files WHERE path LIKE '%.py'""")
def path_module(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "src_files").filter(F.col("path").endswith(".py")).select("path", X.module_name(F.col("path")).alias("module")).distinct()


@query("SELECT DISTINCT repo, CAST(concat('0x', substr(sha256(repo), 1, 8)) AS BIGINT) % 2147483648 AS namespace FROM src_files")
def namespace_id(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "src_files").select("repo").distinct().select("repo", X.namespace_id(F.col("repo")).alias("namespace"))


# --- joins ------------------------------------------------------------------------


@query("SELECT e.src, e.dst, a.name AS caller, b.name AS callee, a.file AS caller_file FROM {edg} e JOIN {fn} a ON a.fn_uid = e.src JOIN {fn} b ON b.fn_uid = e.dst WHERE e.edge_type = 'callsFunction'")
def caller_two_key_join(s: SparkSession, d: str) -> DataFrame:
    """Calls with both functions."""
    fn = _fn(s, d).select("fn_uid", "name", "file")
    calls = _edg(s, d).filter("edge_type = 'callsFunction'")
    a = fn.select(F.col("fn_uid").alias("src"), F.col("name").alias("caller"), F.col("file").alias("caller_file"))
    b = fn.select(F.col("fn_uid").alias("dst"), F.col("name").alias("callee"))
    return calls.join(a, "src").join(b, "dst").select("src", "dst", "caller", "callee", "caller_file")


@query("SELECT f.row_id, m.fn_uid FROM func_defs f JOIN (SELECT name, fn_uid FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY file, row_id) AS rn FROM func_defs) WHERE rn = 1) m ON m.name = f.name")
def callee_first_match(s: SparkSession, d: str) -> DataFrame:
    """Name to the first function of that name in file order."""
    f = table(s, d, "func_defs")
    first = nodes.first_by(f.select("name", "fn_uid", "file", "row_id"), ["name"], F.col("file"), F.col("row_id")).select("name", "fn_uid")
    return f.select("row_id", "name").join(first, "name").select("row_id", "fn_uid")


@query(
    r"""WITH c AS (SELECT repo, name, min(class_uid) AS class_uid FROM {cls} GROUP BY ALL),
 b AS (SELECT row_id, repo, unnest(base_classes) AS b, generate_subscripts(base_classes, 1) AS i FROM class_defs)
 SELECT row_id, CAST(i - 1 AS INTEGER) AS i, coalesce(x.class_uid, y.class_uid) AS base_uid FROM (SELECT *, regexp_replace(b, '^\s+|\s+$', '', 'g') AS full_name, {bare} AS bare FROM b) q
 LEFT JOIN c x ON x.repo = q.repo AND x.name = full_name LEFT JOIN c y ON y.repo = q.repo AND y.name = bare"""
)
def callee_fallback(s: SparkSession, d: str) -> DataFrame:
    """Bases by full name, else by their last segment."""
    from graphloom.operators.hierarchy import bare_name

    c = _cls(s, d).groupBy("repo", "name").agg(F.min("class_uid").alias("u"))
    b = table(s, d, "class_defs").select("row_id", "repo", F.posexplode("base_classes").alias("i", "b"))
    b = b.select("row_id", "repo", "i", F.regexp_replace("b", r"^\s+|\s+$", "").alias("full_name"), bare_name(F.col("b")).alias("bare"))
    x, y = c.select("repo", F.col("name").alias("full_name"), F.col("u").alias("x")), c.select("repo", F.col("name").alias("bare"), F.col("u").alias("y"))
    return b.join(x, ["repo", "full_name"], "left").join(y, ["repo", "bare"], "left").select("row_id", F.col("i").cast("int").alias("i"), F.coalesce("x", "y").alias("base_uid"))


@query("SELECT e.edge_type, e.src, e.dst FROM {edg} e WHERE EXISTS (SELECT 1 FROM func_defs f WHERE f.fn_uid = e.src) AND EXISTS (SELECT 1 FROM func_defs f WHERE f.fn_uid = e.dst)")
def endpoints_semi(s: SparkSession, d: str) -> DataFrame:
    uids = table(s, d, "func_defs").select("fn_uid").distinct()
    return _edg(s, d).join(uids.withColumnRenamed("fn_uid", "src"), "src", "left_semi").join(uids.withColumnRenamed("fn_uid", "dst"), "dst", "left_semi").select("edge_type", "src", "dst")


@query("""WITH c AS (SELECT repo, name, class_uid FROM {cls}), b AS (SELECT class_uid, repo, unnest(base_classes) AS b FROM {cls})
 SELECT DISTINCT b.class_uid AS src, c.class_uid AS dst FROM b JOIN c ON c.repo = b.repo AND c.name = {bare}""")
def inherit_edges(s: SparkSession, d: str) -> DataFrame:
    from graphloom.operators.hierarchy import bare_name

    c = _cls(s, d)
    b = c.select(F.col("class_uid").alias("src"), "repo", F.explode("base_classes").alias("b")).select("src", "repo", bare_name(F.col("b")).alias("name"))
    return b.join(c.select("repo", "name", F.col("class_uid").alias("dst")), ["repo", "name"]).select("src", "dst").distinct()


@query("""SELECT 'containsFunction' AS edge_type, f.file_uid AS src, x.fn_uid AS dst FROM {fn} x JOIN {fil} f ON f.repo = x.repo AND f.path = x.file
 UNION ALL SELECT 'containsClass', f.file_uid, x.class_uid FROM {cls} x JOIN {fil} f ON f.repo = x.repo AND f.path = x.file
 UNION ALL SELECT 'containsImport', f.file_uid, x.import_uid FROM {imp} x JOIN {fil} f ON f.repo = x.repo AND f.path = x.file""")
def contains_edges(s: SparkSession, d: str) -> DataFrame:
    """Files to their functions, classes and imports: one union, one join with the files."""
    part = lambda df, uid, kind: df.select(F.lit(kind).alias("edge_type"), "repo", F.col("file").alias("path"), F.col(uid).alias("dst"))
    union = part(_fn(s, d), "fn_uid", "containsFunction").unionByName(part(_cls(s, d), "class_uid", "containsClass")).unionByName(part(_imp(s, d), "import_uid", "containsImport"))
    return union.join(_fil(s, d).select("repo", "path", F.col("file_uid").alias("src")), ["repo", "path"]).select("edge_type", "src", "dst")


@query("""WITH c AS (SELECT repo, file, class_uid, line_no, methods, coalesce(lead(line_no) OVER (PARTITION BY repo, file ORDER BY line_no, class_uid), 1000000000) AS next_line FROM {cls})
 SELECT fn_uid, class_uid FROM (SELECT f.fn_uid, c.class_uid, row_number() OVER (PARTITION BY f.fn_uid ORDER BY c.line_no, c.class_uid) AS rn
 FROM {fn} f JOIN c ON c.repo = f.repo AND c.file = f.file AND f.line_no >= c.line_no AND f.line_no < c.next_line AND list_contains(c.methods, f.name)) WHERE rn = 1""")
def method_range_join(s: SparkSession, d: str) -> DataFrame:
    """Methods to the first class whose lines hold them: equi-join on the file, range as residual."""
    w = Window.partitionBy("repo", "file").orderBy("line_no", "class_uid")
    c = _cls(s, d).select("repo", "file", "class_uid", "methods", F.col("line_no").alias("lo"), F.coalesce(F.lead("line_no").over(w), F.lit(1_000_000_000)).alias("hi"))
    f = _fn(s, d).select("repo", "file", "fn_uid", "name", "line_no")
    hits = f.join(c, ["repo", "file"]).filter((F.col("line_no") >= F.col("lo")) & (F.col("line_no") < F.col("hi")) & F.array_contains("methods", F.col("name")))
    return hits.groupBy("fn_uid").agg(F.min_by("class_uid", F.struct("lo", "class_uid")).alias("class_uid"))


@query("SELECT i.row_id, f.file_uid FROM import_decls i JOIN {fil} f ON f.repo = i.repo AND regexp_extract(f.path, '([^/]*)$', 1) = regexp_extract(i.module, '([^/]*)$', 1)")
def usage_fanout(s: SparkSession, d: str) -> DataFrame:
    """Imports to all files of the same name in the repository (one to many)."""
    i = table(s, d, "import_decls").filter("module is not null").select("row_id", "repo", X.basename(F.col("module")).alias("name"))
    f = _fil(s, d).select("repo", "file_uid", X.basename(F.col("path")).alias("name"))
    return i.join(f, ["repo", "name"]).select("row_id", "file_uid")


@query("SELECT i.row_id, m.file_uid FROM import_decls i JOIN (SELECT regexp_extract(path, '([^/]*)$', 1) AS name, min(file_uid) AS file_uid FROM {fil} GROUP BY ALL) m ON m.name = regexp_extract(i.module, '([^/]*)$', 1)")
def usage_first(s: SparkSession, d: str) -> DataFrame:
    i = table(s, d, "import_decls").filter("module is not null").select("row_id", X.basename(F.col("module")).alias("name"))
    f = _fil(s, d).groupBy(X.basename(F.col("path")).alias("name")).agg(F.min("file_uid").alias("file_uid"))
    return i.join(f, "name").select("row_id", "file_uid")


@query("SELECT f.row_id FROM func_defs f WHERE EXISTS (SELECT 1 FROM class_defs c WHERE c.repo = f.repo AND c.file = f.file AND list_contains(c.methods, f.name))")
def usage_same_file_semi(s: SparkSession, d: str) -> DataFrame:
    methods = table(s, d, "class_defs").select("repo", "file", F.explode("methods").alias("name")).distinct()
    return table(s, d, "func_defs").join(methods, ["repo", "file", "name"], "left_semi").select("row_id")


@query("""SELECT row_id, fn_uid FROM (SELECT i.row_id, f.fn_uid, row_number() OVER (PARTITION BY i.row_id ORDER BY CASE WHEN f.repo = i.repo AND f.file = i.file THEN 0 WHEN f.repo = i.repo THEN 1 ELSE 2 END, f.fn_uid) AS rn
 FROM (SELECT row_id, repo, file, unnest(imported_items) AS item FROM import_decls) i JOIN {fn} f ON f.name = i.item) WHERE rn = 1""")
def shadowing_resolution(s: SparkSession, d: str) -> DataFrame:
    """Imported names to a function: same file, else same repository, else any; candidates are reduced per scope before the joins."""
    items = table(s, d, "import_decls").select("row_id", "repo", "file", F.explode("imported_items").alias("name"))
    fn = _fn(s, d).select("repo", "file", "name", "fn_uid")
    a = fn.groupBy("repo", "file", "name").agg(F.min("fn_uid").alias("a"))
    b = fn.groupBy("repo", "name").agg(F.min("fn_uid").alias("b"))
    c = fn.groupBy("name").agg(F.min("fn_uid").alias("c"))
    hits = items.join(a, ["repo", "file", "name"], "left").join(b, ["repo", "name"], "left").join(c, "name", "left")
    best = F.when(F.col("a").isNotNull(), F.struct(F.lit(0).alias("p"), F.col("a").alias("u"))).when(F.col("b").isNotNull(), F.struct(F.lit(1).alias("p"), F.col("b").alias("u"))).when(F.col("c").isNotNull(), F.struct(F.lit(2).alias("p"), F.col("c").alias("u")))
    return hits.select("row_id", best.alias("x")).filter("x is not null").groupBy("row_id").agg(F.min("x").alias("x")).select("row_id", F.col("x.u").alias("fn_uid"))


@query(
    r"""WITH c AS (SELECT repo, file, name, class_uid FROM {cls}), b AS (SELECT row_id, repo, file, {bare} AS bare FROM (SELECT row_id, repo, file, base_classes[1] AS b FROM class_defs WHERE len(base_classes) > 0))
 SELECT b.row_id, coalesce(x.class_uid, y.class_uid, z.class_uid) AS class_uid FROM b LEFT JOIN c x ON x.repo = b.repo AND x.file = b.file AND x.name = bare
 LEFT JOIN (SELECT repo, name, min(class_uid) AS class_uid FROM c GROUP BY ALL) y ON y.repo = b.repo AND y.name = bare LEFT JOIN (SELECT name, min(class_uid) AS class_uid FROM c GROUP BY ALL) z ON z.name = bare"""
)
def struct_cascade_resolution(s: SparkSession, d: str) -> DataFrame:
    """First base to a class: same file, else same repository, else anywhere."""
    from graphloom.operators.hierarchy import bare_name

    c = _cls(s, d).select("repo", "file", "name", "class_uid")
    b = table(s, d, "class_defs").filter(F.size("base_classes") > 0).select("row_id", "repo", "file", bare_name(F.col("base_classes")[0]).alias("name"))
    x = c.withColumnRenamed("class_uid", "x")
    y = c.groupBy("repo", "name").agg(F.min("class_uid").alias("y"))
    z = c.groupBy("name").agg(F.min("class_uid").alias("z"))
    return b.join(x, ["repo", "file", "name"], "left").join(y, ["repo", "name"], "left").join(z, "name", "left").select("row_id", F.coalesce("x", "y", "z").alias("class_uid"))


@query("SELECT e.src AS \"from\", e.dst AS \"to\", f.name, f.file FROM {edg} e JOIN {fn} f ON f.fn_uid = e.dst WHERE e.edge_type = 'callsFunction'")
def hop_forward(s: SparkSession, d: str) -> DataFrame:
    return traverse.hop(_edg(s, d), "callsFunction", _fn(s, d), "fn_uid", {"name": "name", "file": "file"})


@query("SELECT e.dst AS \"from\", e.src AS \"to\", f.name, f.file FROM {edg} e JOIN {fn} f ON f.fn_uid = e.src WHERE e.edge_type = 'callsFunction'")
def hop_inverse(s: SparkSession, d: str) -> DataFrame:
    return traverse.hop(_edg(s, d), "callsFunction", _fn(s, d), "fn_uid", {"name": "name", "file": "file"}, inverse=True)


@query("""WITH q AS (SELECT row_id, repo, file, unnest(imported_items) AS name FROM import_decls), deps AS (SELECT DISTINCT repo, importer, imported FROM {deps}), f AS (SELECT * FROM {fn})
 SELECT row_id, name, fn_uid FROM (SELECT q.row_id, q.name, f.fn_uid, row_number() OVER (PARTITION BY q.row_id, q.name ORDER BY CASE WHEN f.file = q.file THEN 0 ELSE 1 END, f.fn_uid) AS rn
 FROM q JOIN f ON f.repo = q.repo AND f.name = q.name LEFT JOIN deps ON deps.repo = q.repo AND deps.importer = q.file AND deps.imported = f.file WHERE f.file = q.file OR deps.imported IS NOT NULL) WHERE rn = 1""")
def resolve_scoped(s: SparkSession, d: str) -> DataFrame:
    """Imported names to functions of the same file, else of an imported file."""
    q = table(s, d, "import_decls").select("row_id", "repo", "file", F.explode("imported_items").alias("name"))
    f = _fn(s, d).select("repo", F.col("file").alias("owner"), "name", "fn_uid")
    deps = _deps(s, d).select("repo", F.col("importer").alias("file"), F.col("imported").alias("owner")).distinct()
    own = q.join(f, ["repo", "name"]).filter(F.col("owner") == F.col("file")).select("row_id", "name", "fn_uid", F.lit(0).alias("p"))
    far = q.join(deps, ["repo", "file"]).join(f, ["repo", "owner", "name"]).select("row_id", "name", "fn_uid", F.lit(1).alias("p"))
    return own.unionByName(far).groupBy("row_id", "name").agg(F.min_by("fn_uid", F.struct("p", "fn_uid")).alias("fn_uid"))


@query(r"""WITH i AS (SELECT DISTINCT repo, file, regexp_replace(module, '^[\s"''`]+|[\s"''`]+$', '', 'g') AS inc FROM import_decls WHERE module IS NOT NULL AND regexp_matches(file, '\.[ch]$')),
 f AS (SELECT DISTINCT repo, path FROM src_files), n AS (SELECT repo, regexp_extract(path, '([^/]*)$', 1) AS name, min(path) AS path FROM f GROUP BY ALL)
 SELECT i.repo, i.file, i.inc, coalesce(f.path, n.path) AS target FROM i LEFT JOIN f ON f.repo = i.repo AND f.path = CASE WHEN contains(i.file, '/') THEN regexp_replace(i.file, '/[^/]*$', '') || '/' || i.inc ELSE i.inc END
 LEFT JOIN n ON n.repo = i.repo AND n.name = regexp_extract(i.inc, '([^/]*)$', 1)""")
def resolve_include_file(s: SparkSession, d: str) -> DataFrame:
    """Includes to the sibling file, else the first file of that name."""
    i = table(s, d, "import_decls").filter("module is not null").filter(F.col("file").rlike(r"\.[ch]$")).select("repo", "file", F.regexp_replace("module", r"""^[\s"'`]+|[\s"'`]+$""", "").alias("inc")).distinct()
    f = table(s, d, "src_files").select("repo", "path").distinct()
    sibling = F.when(F.col("file").contains("/"), F.concat(X.dirname(F.col("file")), F.lit("/"), "inc")).otherwise(F.col("inc"))
    n = f.groupBy("repo", X.basename(F.col("path")).alias("name")).agg(F.min("path").alias("any"))
    return i.withColumn("path", sibling).withColumn("name", X.basename(F.col("inc"))).join(f.withColumn("there", F.col("path")), ["repo", "path"], "left").join(n, ["repo", "name"], "left").select("repo", "file", "inc", F.coalesce("there", "any").alias("target"))


@query("SELECT v.vec_id, f.row_id, f.name FROM embeddings v JOIN func_defs f ON f.row_id = v.vec_id")
def embed_join(s: SparkSession, d: str) -> DataFrame:
    """Vectors attached to nodes by id."""
    return table(s, d, "embeddings").select("vec_id").join(table(s, d, "func_defs").select("row_id", "name"), F.col("vec_id") == F.col("row_id")).select("vec_id", "row_id", "name")


@query("SELECT e.edge_type, e.src, e.dst FROM {edg} e LEFT JOIN (SELECT fn_uid AS uid FROM func_defs UNION SELECT import_uid FROM import_decls) n ON n.uid = e.dst WHERE n.uid IS NULL")
def orphan_edges(s: SparkSession, d: str) -> DataFrame:
    known = table(s, d, "func_defs").select(F.col("fn_uid").alias("dst")).unionByName(table(s, d, "import_decls").select(F.col("import_uid").alias("dst"))).distinct()
    return _edg(s, d).join(known, "dst", "left_anti").select("edge_type", "src", "dst")


@query("""SELECT coalesce(a.u, b.u) AS import_uid, CASE WHEN b.u IS NULL THEN 'edges' WHEN a.u IS NULL THEN 'nodes' ELSE 'both' END AS found_in
 FROM (SELECT DISTINCT dst AS u FROM {edg} WHERE edge_type = 'containsImport') a FULL JOIN (SELECT DISTINCT import_uid AS u FROM import_decls) b ON a.u = b.u""")
def diff_full_outer(s: SparkSession, d: str) -> DataFrame:
    a = _edg(s, d).filter("edge_type = 'containsImport'").select(F.col("dst").alias("import_uid")).distinct().withColumn("a", F.lit(1))
    b = table(s, d, "import_decls").select("import_uid").distinct().withColumn("b", F.lit(1))
    return a.join(b, "import_uid", "full_outer").select("import_uid", F.when(F.col("b").isNull(), "edges").when(F.col("a").isNull(), "nodes").otherwise("both").alias("found_in"))


# --- aggregation -------------------------------------------------------------------


@query("""SELECT repo, file, count(*) FILTER (kind = 'f') AS functions, count(*) FILTER (kind = 'c') AS classes, count(*) FILTER (kind = 'i') AS imports FROM (
 SELECT repo, file, 'f' AS kind FROM func_defs UNION ALL SELECT repo, file, 'c' FROM class_defs UNION ALL SELECT repo, file, 'i' FROM import_decls) GROUP BY ALL""")
def per_file_counts(s: SparkSession, d: str) -> DataFrame:
    """Facts per file: one shuffle for all kinds."""
    union = None
    for name, kind in (("func_defs", "f"), ("class_defs", "c"), ("import_decls", "i")):
        part = table(s, d, name).select("repo", "file", F.lit(kind).alias("kind"))
        union = part if union is None else union.unionByName(part)
    return union.groupBy("repo", "file").agg(*(F.count_if(F.col("kind") == k).alias(n) for k, n in (("f", "functions"), ("c", "classes"), ("i", "imports"))))


@query("SELECT coalesce(node, 'total') AS node, count(*) AS n FROM (SELECT 'Function' AS node FROM {fn} UNION ALL SELECT 'Class' FROM {cls} UNION ALL SELECT 'Import' FROM {imp} UNION ALL SELECT 'File' FROM {fil}) GROUP BY ROLLUP (node)")
def type_counts(s: SparkSession, d: str) -> DataFrame:
    union = None
    for df, uid, kind in ((_fn(s, d), "fn_uid", "Function"), (_cls(s, d), "class_uid", "Class"), (_imp(s, d), "import_uid", "Import"), (_fil(s, d), "file_uid", "File")):
        part = df.select(uid).select(F.lit(kind).alias("node"))
        union = part if union is None else union.unionByName(part)
    return union.rollup("node").agg(_n().alias("n")).select(F.coalesce("node", F.lit("total")).alias("node"), "n")


@query("SELECT count(*) AS files, CAST(sum(functions_count) AS BIGINT) AS functions, CAST(sum(classes_count) AS BIGINT) AS classes, CAST(sum(imports_count) AS BIGINT) AS imports FROM src_files")
def grand_totals(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "src_files").agg(_n().alias("files"), *(F.sum(f"{c}_count").cast("bigint").alias(c) for c in ("functions", "classes", "imports")))


_REASON = "CASE WHEN module IS NULL THEN 'missing' WHEN trim(module) <> module THEN 'padded' WHEN module LIKE '\"%' THEN 'quoted' WHEN len(imported_items) = 0 THEN 'no items' END"


def _reasons(s: SparkSession, d: str) -> DataFrame:
    m = F.col("module")
    reason = F.when(m.isNull(), "missing").when(F.trim(m) != m, "padded").when(m.startswith('"'), "quoted").when(F.size("imported_items") == 0, "no items")
    return table(s, d, "import_decls").select("row_id", "repo", "file", reason.alias("reason"))


@query(f"SELECT reason, count(*) AS n FROM (SELECT {_REASON} AS reason FROM import_decls) WHERE reason IS NOT NULL GROUP BY ALL")
def reason_counts(s: SparkSession, d: str) -> DataFrame:
    return _reasons(s, d).filter("reason is not null").groupBy("reason").agg(_n().alias("n"))


@query(f"SELECT repo, file, count(*) AS n FROM (SELECT repo, file, {_REASON} AS reason FROM import_decls) WHERE reason IS NOT NULL GROUP BY ALL")
def file_counts(s: SparkSession, d: str) -> DataFrame:
    return _reasons(s, d).filter("reason is not null").groupBy("repo", "file").agg(_n().alias("n"))


@query(f"""SELECT reason, string_agg(CAST(row_id AS VARCHAR), ',' ORDER BY row_id) AS examples FROM (SELECT *, row_number() OVER (PARTITION BY reason ORDER BY row_id) AS rn FROM (SELECT row_id, {_REASON} AS reason FROM import_decls) WHERE reason IS NOT NULL) WHERE rn <= 20 GROUP BY reason""")
def error_samples(s: SparkSession, d: str) -> DataFrame:
    """The first 20 rows of each reason."""
    w = Window.partitionBy("reason").orderBy("row_id")
    top = _reasons(s, d).filter("reason is not null").withColumn("rn", F.row_number().over(w)).filter("rn <= 20")
    return top.groupBy("reason").agg(F.array_join(F.transform(F.array_sort(F.collect_list("row_id")), lambda x: x.cast("string")), ",").alias("examples"))


@query("SELECT round(100.0 * avg(CASE WHEN module IS NULL THEN 1.0 ELSE 0.0 END), 6) AS bad_pct FROM import_decls")
def bad_pct(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "import_decls").agg(F.round(100 * F.avg(F.col("module").isNull().cast("double")), 6).alias("bad_pct"))


@query("SELECT module, count(DISTINCT file) AS files, min(file) AS first_file FROM import_decls WHERE module IS NOT NULL GROUP BY ALL")
def multimap(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "import_decls").filter("module is not null").groupBy("module").agg(F.countDistinct("file").alias("files"), F.min("file").alias("first_file"))


@query("SELECT b.name AS callee, count(DISTINCT a.name) AS callers, min(a.name) AS first_caller FROM {edg} e JOIN {fn} a ON a.fn_uid = e.src JOIN {fn} b ON b.fn_uid = e.dst WHERE e.edge_type = 'callsFunction' GROUP BY ALL")
def call_graph(s: SparkSession, d: str) -> DataFrame:
    return caller_two_key_join(s, d).groupBy("callee").agg(F.countDistinct("caller").alias("callers"), F.min("caller").alias("first_caller"))


@query("""SELECT CASE WHEN a.fn_uid IS NULL THEN 'caller_not_found' WHEN b.fn_uid IS NULL THEN 'callee_not_found' ELSE 'created' END AS outcome, count(*) AS n
 FROM {edg} e LEFT JOIN {fn} a ON a.fn_uid = e.src LEFT JOIN {fn} b ON b.fn_uid = e.dst WHERE e.edge_type = 'callsFunction' GROUP BY ALL""")
def resolution_stats(s: SparkSession, d: str) -> DataFrame:
    known = table(s, d, "func_defs").select("fn_uid").distinct()
    e = _edg(s, d).filter("edge_type = 'callsFunction'")
    e = e.join(known.select(F.col("fn_uid").alias("src"), F.lit(1).alias("a")), "src", "left").join(known.select(F.col("fn_uid").alias("dst"), F.lit(1).alias("b")), "dst", "left")
    outcome = F.when(F.col("a").isNull(), "caller_not_found").when(F.col("b").isNull(), "callee_not_found").otherwise("created")
    return e.groupBy(outcome.alias("outcome")).agg(_n().alias("n"))


@query("SELECT count(*) AS functions, CAST(sum(n) AS BIGINT) AS calls, max(n) AS most FROM (SELECT src, count(*) AS n FROM {edg} WHERE edge_type = 'callsFunction' GROUP BY ALL)")
def degree_stats(s: SparkSession, d: str) -> DataFrame:
    per = _edg(s, d).filter("edge_type = 'callsFunction'").groupBy("src").agg(_n().alias("n"))
    return per.agg(_n().alias("functions"), F.sum("n").cast("bigint").alias("calls"), F.max("n").alias("most"))


@query("SELECT repo, count(DISTINCT imported) AS imported_files, count(DISTINCT importer) AS importing_files FROM {deps} GROUP BY ALL")
def affected_distinct(s: SparkSession, d: str) -> DataFrame:
    return _deps(s, d).groupBy("repo").agg(F.countDistinct("imported").alias("imported_files"), F.countDistinct("importer").alias("importing_files"))


@query(r"""SELECT node, count(*) AS failures FROM (SELECT 'Function' AS node FROM func_defs WHERE NOT regexp_matches(coalesce(name, ''), '\S') OR NOT regexp_matches(coalesce(signature, ''), '\S')
 UNION ALL SELECT 'Import' FROM import_decls WHERE NOT regexp_matches(coalesce(module, ''), '\S') UNION ALL SELECT 'File' FROM src_files WHERE content IS NULL OR lang IS NULL) GROUP BY ALL""")
def failures_by_type(s: SparkSession, d: str) -> DataFrame:
    f = table(s, d, "func_defs").filter(~X.not_blank(F.col("name")) | ~X.not_blank(F.col("signature"))).select(F.lit("Function").alias("node"))
    i = table(s, d, "import_decls").filter(~X.not_blank(F.col("module"))).select(F.lit("Import").alias("node"))
    p = table(s, d, "src_files").filter("content is null or lang is null").select(F.lit("File").alias("node"))
    return f.unionByName(i).unionByName(p).groupBy("node").agg(_n().alias("failures"))


# --- windows, sorts, top-k ------------------------------------------------------------


@query("SELECT file_uid, file_id, repo, path FROM {fil}")
def dedupe_first(s: SparkSession, d: str) -> DataFrame:
    return _fil(s, d).select("file_uid", "file_id", "repo", "path")


@query("SELECT repo, file, name, n FROM (SELECT repo, file, name, n, row_number() OVER (PARTITION BY repo ORDER BY n DESC, file, name) AS rn FROM (SELECT b.repo, b.file, b.name, count(*) AS n FROM {edg} e JOIN {fn} b ON b.fn_uid = e.dst WHERE e.edge_type = 'callsFunction' GROUP BY ALL)) WHERE rn <= 5")
def topk_by_type(s: SparkSession, d: str) -> DataFrame:
    """The five most called functions of each repository."""
    counts = _edg(s, d).filter("edge_type = 'callsFunction'").groupBy(F.col("dst").alias("fn_uid")).agg(_n().alias("n"))
    named = counts.join(_fn(s, d).select("fn_uid", "repo", "file", "name"), "fn_uid").groupBy("repo", "file", "name").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("repo").orderBy(F.desc("n"), "file", "name"))
    return named.withColumn("rn", rank).filter("rn <= 5").select("repo", "file", "name", "n")


_KNN = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), n AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS len FROM v),
 s AS (SELECT q.vec_id AS query_id, r.vec_id, round(list_dot_product(q.e, r.e) / (q.len * r.len), 6) AS similarity FROM n q JOIN n r ON q.vec_id % 100 = 0),
 k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM s) """


@query(_KNN + "SELECT query_id, vec_id, rank FROM k WHERE rank <= 10")
def knn_by_id(s: SparkSession, d: str) -> DataFrame:
    """Ten nearest vectors of every vector whose id is divisible by 100, itself included."""
    e = table(s, d, "embeddings")
    return search.nearest(e.filter("vec_id % 100 = 0"), e, 10, 64).select("query_id", "vec_id", "rank")


@query(_KNN + "SELECT query_id, vec_id FROM (SELECT k.query_id, k.vec_id, row_number() OVER (PARTITION BY k.query_id ORDER BY k.rank) AS r2 FROM k JOIN func_defs f ON f.row_id = k.vec_id WHERE k.rank <= 20 AND (f.file LIKE '%.py')) WHERE r2 <= 10")
def topk_overfetch_glob(s: SparkSession, d: str) -> DataFrame:
    """Semantic search: fetch twice as many as wanted, keep those whose file matches a pattern, cut to the limit."""
    e = table(s, d, "embeddings")
    near = search.nearest(e.filter("vec_id % 100 = 0"), e, 20, 64)
    f = table(s, d, "func_defs").filter(X.glob_match(F.col("file"), "*.py")).select(F.col("row_id").alias("vec_id"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    return near.join(f, "vec_id").withColumn("r2", rank).filter("r2 <= 10").select("query_id", "vec_id")


# --- tools ----------------------------------------------------------------------------


@query("""WITH f AS (SELECT * FROM {fn}) SELECT f.name AS symbol, 'definition' AS type, f.file, CAST(f.line_no AS INTEGER) AS line, coalesce(f.signature, '') AS context FROM f
 UNION ALL SELECT b.name, 'call', a.file, CAST(a.line_no AS INTEGER), 'Called by ' || a.name FROM {edg} e JOIN f a ON a.fn_uid = e.src JOIN f b ON b.fn_uid = e.dst WHERE e.edge_type = 'callsFunction'""")
def usages_function(s: SparkSession, d: str) -> DataFrame:
    """Definitions and calls of every function symbol."""
    f = _fn(s, d).select("fn_uid", "name", "file", F.col("line_no").cast("int").alias("line"), "signature")
    defs = f.select(F.col("name").alias("symbol"), F.lit("definition").alias("type"), "file", "line", F.coalesce("signature", F.lit("")).alias("context"))
    a = f.select(F.col("fn_uid").alias("src"), F.col("name").alias("caller"), "file", "line")
    calls = _edg(s, d).filter("edge_type = 'callsFunction'").join(a, "src").join(f.select(F.col("fn_uid").alias("dst"), F.col("name").alias("symbol")), "dst")
    return defs.unionByName(calls.select("symbol", F.lit("call").alias("type"), "file", "line", F.concat(F.lit("Called by "), "caller").alias("context")))


@query("SELECT b.name AS function_name, a.name AS caller, a.file, CAST(a.line_no AS INTEGER) AS line, coalesce(a.signature, '') AS signature FROM {edg} e JOIN {fn} a ON a.fn_uid = e.src JOIN {fn} b ON b.fn_uid = e.dst WHERE e.edge_type = 'callsFunction' AND b.name LIKE 'flush%'")
def callers_direct(s: SparkSession, d: str) -> DataFrame:
    """Direct callers of the functions of a name pattern."""
    f = _fn(s, d).select("fn_uid", "name", "file", "line_no", "signature")
    b = f.filter(F.col("name").startswith("flush")).select(F.col("fn_uid").alias("dst"), F.col("name").alias("function_name"))
    a = f.select(F.col("fn_uid").alias("src"), F.col("name").alias("caller"), "file", F.col("line_no").cast("int").alias("line"), F.coalesce("signature", F.lit("")).alias("signature"))
    return _edg(s, d).filter("edge_type = 'callsFunction'").join(b, "dst").join(a, "src").select("function_name", "caller", "file", "line", "signature")


@query("""SELECT f.name AS function_name, v.row_id AS variable_id, v.file FROM (SELECT name, repo, file FROM {fn} WHERE name LIKE '%callback%' OR name LIKE 'reload%') f JOIN (SELECT * FROM {fn}) v ON v.repo = f.repo AND v.file = f.file AND contains(coalesce(v.parameters, ''), '(*')""")
def callers_indirect(s: SparkSession, d: str) -> DataFrame:
    """Possible indirect callers: functions of the same file that take function pointers, once per definition of the name."""
    f = _fn(s, d)
    named = f.filter(F.col("name").contains("callback") | F.col("name").startswith("reload")).select(F.col("name").alias("function_name"), "repo", "file")
    return named.join(f.filter(F.coalesce("parameters", F.lit("")).contains("(*")).select("repo", "file", F.col("row_id").alias("variable_id")), ["repo", "file"]).select("function_name", "variable_id", "file")


@query("SELECT id, label, kind FROM (SELECT fn_uid AS id, name AS label, 'function' AS kind FROM {fn} UNION ALL SELECT class_uid, name, 'class' FROM {cls} UNION ALL SELECT file_uid, path, 'file' FROM {fil}) WHERE trim(label) <> '' UNION ALL SELECT src || '-calls-' || dst, '', 'edge' FROM {edg} WHERE edge_type = 'callsFunction' UNION ALL SELECT src || '-' || dst, '', 'edge' FROM {edg} WHERE edge_type = 'containsImport'")
def graph_elements(s: SparkSession, d: str) -> DataFrame:
    """Nodes and edges of the whole graph as elements with ids."""
    n = None
    for df, uid, label, kind in ((_fn(s, d), "fn_uid", "name", "function"), (_cls(s, d), "class_uid", "name", "class"), (_fil(s, d), "file_uid", "path", "file")):
        part = df.select(F.col(uid).alias("id"), F.col(label).alias("label"), F.lit(kind).alias("kind"))
        n = part if n is None else n.unionByName(part)
    mark = F.when(F.col("edge_type") == "callsFunction", "-calls-").otherwise("-")
    e = _edg(s, d).select(F.concat("src", mark, "dst").alias("id"), F.lit("").alias("label"), F.lit("edge").alias("kind"))
    return n.filter(F.trim("label") != "").unionByName(e)


@query("""WITH m AS (SELECT fn_uid, name, file, repo FROM {fn} WHERE list_has_all(list_filter(string_split_regex(lower(name), '[^a-z0-9]+'), lambda t: t <> ''), ['reload']))
 SELECT m.fn_uid AS match, 'file' AS relation, f.file_uid AS neighbour FROM m JOIN {fil} f ON f.repo = m.repo AND f.path = m.file
 UNION SELECT m.fn_uid, 'calls', e.dst FROM m JOIN {edg} e ON e.src = m.fn_uid AND e.edge_type = 'callsFunction'""")
def search_subgraph(s: SparkSession, d: str) -> DataFrame:
    """Functions that match a text query, with their files and callees."""
    m = _fn(s, d).filter(X.all_terms(F.col("name"), "reload")).select(F.col("fn_uid").alias("match"), "repo", F.col("file").alias("path"))
    files = m.join(_fil(s, d).select("repo", "path", "file_uid"), ["repo", "path"]).select("match", F.lit("file").alias("relation"), F.col("file_uid").alias("neighbour"))
    calls = m.join(_edg(s, d).filter("edge_type = 'callsFunction'").select(F.col("src").alias("match"), "dst"), "match").select("match", F.lit("calls").alias("relation"), F.col("dst").alias("neighbour"))
    return files.unionByName(calls).distinct()


@query("SELECT class_uid, name, array_to_string(list_sort(methods), ',') AS methods FROM (SELECT *, row_number() OVER (ORDER BY row_id) AS rn FROM class_defs WHERE len(methods) > 0) WHERE rn <= 5")
def class_sample(s: SparkSession, d: str) -> DataFrame:
    """The first five classes with methods."""
    c = table(s, d, "class_defs").filter(F.size("methods") > 0).orderBy("row_id").limit(5)
    return c.select("class_uid", "name", F.array_join(F.array_sort("methods"), ",").alias("methods"))


# --- incremental store -----------------------------------------------------------------

#: The stored snapshot ends here; later rows are the new run.
_CUT = "2024-01-01 00:00:00"


@query(f"""WITH h AS (SELECT *, sha256(concat_ws(chr(31), coalesce('=' || name, '-'), coalesce('=' || file, '-'), coalesce('=' || signature, '-'), coalesce('=' || docstring, '-'))) AS h FROM func_defs)
 SELECT row_id, fn_uid, h FROM h n WHERE indexed_at >= TIMESTAMP '{_CUT}' AND NOT EXISTS (SELECT 1 FROM h o WHERE o.indexed_at < TIMESTAMP '{_CUT}' AND o.fn_uid = n.fn_uid AND o.h = n.h)""")
def hash_anti_join(s: SparkSession, d: str) -> DataFrame:
    """New function rows whose content isn't stored yet (positions don't count)."""
    f = table(s, d, "func_defs").select("row_id", "fn_uid", "indexed_at", snapshots.content_hash("name", "file", "signature", "docstring").alias("h"))
    at = F.lit(_CUT).cast("timestamp_ntz")
    return snapshots.changed_rows(f.filter(F.col("indexed_at") >= at), f.filter(F.col("indexed_at") < at), "fn_uid", "h").select("row_id", "fn_uid", "h")


@query(f"""WITH h AS (SELECT *, sha256(concat_ws(chr(31), coalesce('=' || name, '-'), coalesce('=' || file, '-'), coalesce('=' || signature, '-'), coalesce('=' || docstring, '-'))) AS h FROM func_defs),
 n AS (SELECT * FROM h WHERE indexed_at >= TIMESTAMP '{_CUT}'), o AS (SELECT DISTINCT fn_uid, h FROM h WHERE indexed_at < TIMESTAMP '{_CUT}')
 SELECT n.repo, count(*) AS rows, round(100.0 * avg(CASE WHEN o.h IS NULL THEN 0.0 ELSE 1.0 END), 6) AS hit_rate FROM n LEFT JOIN o ON o.fn_uid = n.fn_uid AND o.h = n.h GROUP BY ALL""")
def hit_rate(s: SparkSession, d: str) -> DataFrame:
    f = table(s, d, "func_defs").select("repo", "fn_uid", "indexed_at", snapshots.content_hash("name", "file", "signature", "docstring").alias("h"))
    at = F.lit(_CUT).cast("timestamp_ntz")
    o = f.filter(F.col("indexed_at") < at).select("fn_uid", "h").distinct().withColumn("hit", F.lit(1.0))
    n = f.filter(F.col("indexed_at") >= at).join(o, ["fn_uid", "h"], "left")
    return n.groupBy("repo").agg(_n().alias("rows"), F.round(100 * F.avg(F.coalesce("hit", F.lit(0.0))), 6).alias("hit_rate"))


@query(f"SELECT class_uid, row_id, name FROM class_defs WHERE indexed_at < TIMESTAMP '{_CUT}' AND class_uid NOT IN (SELECT class_uid FROM class_defs WHERE indexed_at >= TIMESTAMP '{_CUT}') UNION ALL SELECT class_uid, row_id, name FROM class_defs WHERE indexed_at >= TIMESTAMP '{_CUT}'")
def upsert_snapshot(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "class_defs").select("class_uid", "row_id", "name", "indexed_at")
    at = F.lit(_CUT).cast("timestamp_ntz")
    return snapshots.upsert(c.filter(F.col("indexed_at") < at), c.filter(F.col("indexed_at") >= at), "class_uid").select("class_uid", "row_id", "name")


@query(f"""WITH replaced AS (SELECT DISTINCT repo, file FROM func_defs WHERE indexed_at >= TIMESTAMP '{_CUT}')
 SELECT row_id FROM func_defs f WHERE indexed_at >= TIMESTAMP '{_CUT}' OR NOT EXISTS (SELECT 1 FROM replaced r WHERE r.repo = f.repo AND r.file = f.file)""")
def file_replace(s: SparkSession, d: str) -> DataFrame:
    """Whole files replaced by their new rows."""
    f = table(s, d, "func_defs").select("row_id", "repo", "file", "indexed_at")
    at = F.lit(_CUT).cast("timestamp_ntz")
    new = f.filter(F.col("indexed_at") >= at)
    return snapshots.delete_files(f.filter(F.col("indexed_at") < at), new, ["repo", "file"]).unionByName(new.select("repo", "file", "row_id", "indexed_at")).select("row_id")


# --- change stream -----------------------------------------------------------------------


@query("""SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS started, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last, count(*) AS changes FROM (
 SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS burst FROM (
 SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, burst""")
def debounce_sessions(s: SparkSession, d: str) -> DataFrame:
    """Bursts of change events per key."""
    e = table(s, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    out = debounce.debounced(e, "user_id", "1 hour")
    fmt = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return out.select("user_id", fmt("started"), fmt("last"), "changes")


@query("SELECT user_id, event_type = 'error' AS deleted, count(*) OVER (PARTITION BY event_type = 'error') AS in_group FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def change_split(s: SparkSession, d: str) -> DataFrame:
    """Last state of each key, split into deleted and existing."""
    e = table(s, d, "events").select("user_id", "event_type", "ts", "event_id")
    last = debounce.last_state(e, "user_id", "event_type").select("user_id", (F.col("event_type") == "error").alias("deleted"))
    sizes = last.groupBy("deleted").agg(_n().alias("in_group"))
    return last.join(small_side(sizes), "deleted").select("user_id", "deleted", "in_group")
