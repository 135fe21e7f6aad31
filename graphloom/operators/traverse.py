"""One-hop traversal, file dependencies, import matching and transitive closure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.exprs import basename, module_name, relative_path
from graphloom.session import cut, small_side

_QUOTED = r"""^[\s"'`]+|[\s"'`]+$"""
#: Recorded depth at which a closure ends.
MAX_DEPTH = 21


def hop(edges: DataFrame, edge_type: str, nodes: DataFrame, uid: str, names: dict[str, str], inverse: bool = False) -> DataFrame:
    """Neighbours of all sources along an edge type: (from, to, named columns of the neighbour)."""
    a, b = ("dst", "src") if inverse else ("src", "dst")
    steps = edges.filter(F.col("edge_type") == edge_type).select(F.col(a).alias("from"), F.col(b).alias("to"))
    return steps.join(nodes.select(F.col(uid).alias("to"), *(F.col(c).alias(n) for c, n in names.items())), "to").select("from", "to", *names.values())


def _stripped(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, r"\.py$", ""), r"^(?:(?:src|lib|cli|python)/)+", "")


def file_dependencies(import_decls: DataFrame, src_files: DataFrame) -> DataFrame:
    """(repo, importer, imported, module), distinct: imports resolved to files of the same repository.

    Python: the dotted name of the file equals the (absolute) module. C: the path
    equals the module or ends with ``/`` and it; paths are joined by file name
    with the suffix test as residual.
    """
    paths = src_files.filter("path is not null").select("repo", F.col("path").alias("imported")).distinct()
    decls = (
        import_decls.filter("module is not null and file is not null")
        .select("repo", F.col("file").alias("importer"), F.regexp_replace("module", _QUOTED, "").alias("module"))
        .filter("module <> ''")
        .distinct()
    )
    dotted = F.regexp_replace(F.regexp_replace(_stripped(F.col("imported")), "/", "."), r"(^|\.)__init__$", "")
    dots = F.length(F.regexp_extract("module", r"^(\.*)", 1))
    package = F.split(_stripped(F.col("importer")), "/")
    up = F.slice(package, F.lit(1), F.greatest(F.size(package) - dots, F.lit(0)))
    absolute = F.when(dots == 0, F.col("module")).otherwise(F.array_join(F.filter(F.concat(up, F.array(F.regexp_replace("module", r"^\.+", ""))), lambda s: s != ""), "."))
    python = decls.filter(F.col("importer").endswith(".py")).withColumn("key", absolute).join(paths.filter(F.col("imported").endswith(".py")).withColumn("key", dotted), ["repo", "key"])
    name = F.substring_index("module", "/", -1)
    c_files = paths.filter(F.col("imported").rlike(r"\.[ch]$")).withColumn("key", F.substring_index("imported", "/", -1))
    c = decls.filter(~F.col("importer").endswith(".py")).withColumn("key", name).join(c_files, ["repo", "key"])
    c = c.filter((F.col("imported") == F.col("module")) | F.col("imported").endswith(F.concat(F.lit("/"), F.col("module"))))
    cols = ["repo", "importer", "imported", "module"]
    return python.select(cols).unionByName(c.select(cols)).distinct()


def _declared(import_decls: DataFrame) -> DataFrame:
    """(repo, importer, module), distinct, without padding and quotes."""
    decls = import_decls.filter("module is not null and file is not null").select("repo", F.col("file").alias("importer"), F.regexp_replace("module", _QUOTED, "").alias("module"))
    return decls.filter("module <> ''").distinct()


def _paths(import_decls: DataFrame, src_files: DataFrame) -> DataFrame:
    """(repo, imported), distinct: stored files and files that import."""
    stored = src_files.filter("path is not null").select("repo", F.col("path").alias("imported"))
    return stored.unionByName(import_decls.filter("file is not null").select("repo", F.col("file").alias("imported"))).distinct()


def _joined(segments: Column, first: Column, count: Column) -> Column:
    return F.array_join(F.slice(segments, first, count), ".")


def python_matches(import_decls: DataFrame, src_files: DataFrame) -> DataFrame:
    """(repo, importer, imported, module), distinct: which import may mean which Python file.

    By dotted names without leading dots an import means a file of the same name,
    one below it (if it has two segments or more), one above it, and, if it is
    relative, one whose last segments it names. Each way is an equi-join: the
    names of one side are exploded to their prefixes or suffixes, at most as many
    as they have segments.
    """
    decls = _declared(import_decls).filter(F.col("importer").endswith(".py"))
    decls = decls.withColumn("name", F.regexp_replace("module", r"^\.+", "")).filter("name <> ''").withColumn("own", F.split("name", r"\."))
    files = _paths(import_decls, src_files).filter(F.col("imported").endswith(".py")).withColumn("key", module_name(F.col("imported"))).withColumn("segments", F.split("key", r"\."))
    n, k = F.size("segments"), F.size("own")
    upto = lambda first, last: F.when(last >= first, F.sequence(F.lit(first), last))
    below = files.select("repo", "imported", F.explode(F.transform(upto(2, n - 1), lambda i: _joined(F.col("segments"), F.lit(1), i))).alias("key"))
    ends = files.select("repo", "imported", F.explode(F.transform(upto(2, n), lambda i: _joined(F.col("segments"), i, n))).alias("key"))
    same = decls.select("repo", "importer", "module", F.col("name").alias("key"))
    above = decls.select("repo", "importer", "module", F.explode(F.transform(upto(1, k - 1), lambda i: _joined(F.col("own"), F.lit(1), i))).alias("key"))
    exact = files.select("repo", "imported", "key")
    # the import's own name against names and their prefixes; its prefixes against names; relative names against suffixes
    ways = [same.join(exact.unionByName(below), ["repo", "key"]), above.join(exact, ["repo", "key"]), same.filter(F.col("module").startswith(".")).join(ends, ["repo", "key"])]
    cols = ["repo", "importer", "imported", "module"]
    return ways[0].select(cols).unionByName(ways[1].select(cols)).unionByName(ways[2].select(cols)).distinct()


def _headers_of(path: Column) -> Column:
    return F.regexp_replace(path, r"\.c$", ".h")


def c_matches(import_decls: DataFrame, src_files: DataFrame, roots: bool = False) -> DataFrame:
    """(repo, importer, imported, module), distinct: which include may mean which C file.

    A ``.c`` file stands for its header too. An include means a file if their
    workspace-relative paths are equal or one ends with the other, from a slash
    on; a target without directories is meant by every include of its name.
    ``roots``: the names under which a file is first asked for, which include its
    bare name. Joined by file name with the path test as residual.
    """
    decls = _declared(import_decls).filter(~F.col("importer").endswith(".py")).withColumn("key", basename(F.col("module")))
    files = _paths(import_decls, src_files).filter(F.col("imported").rlike(r"\.[ch]$"))
    names = [relative_path(F.col("imported")), relative_path(_headers_of(F.col("imported")))]
    if roots:
        names.append(basename(_headers_of(F.col("imported"))))
    targets = files.select("repo", "imported", F.explode(F.array_distinct(F.array(*names))).alias("target")).withColumn("key", basename(F.col("target")))
    m, t = F.col("module"), F.col("target")
    meant = (m == t) | ~t.contains("/") | m.endswith(F.concat(F.lit("/"), t)) | t.endswith(F.concat(F.lit("/"), m))
    return decls.join(targets, ["repo", "key"]).filter(meant).select("repo", "importer", "imported", "module").distinct()


#: Steps that one round of a closure takes before its result is written.
HOPS = 4


def closure(seeds: DataFrame, steps: DataFrame, max_depth: int | None = MAX_DEPTH, first: DataFrame | None = None) -> DataFrame:
    """(seed, node, depth) of all nodes reachable from each seed, depth the least number of steps.

    seeds: (seed, node); steps: (a, b); ``max_depth`` None: to the end. With
    ``first`` (a, b) the first step is one of these; then seeds are not in the
    result unless they are reached again. Breadth first, a few steps a round:
    each round starts from the last frontier only, leaves out what is known, and
    is written before the next.
    """
    steps = small_side(steps.select("a", "b").distinct())
    done = 0
    start = seeds.select("seed", "node").distinct()
    if first is not None:
        start, done = start.join(first.select(F.col("a").alias("node"), "b").distinct(), "node").select("seed", F.col("b").alias("node")).distinct(), 1
    frontier = known = cut(start.withColumn("depth", F.lit(done).cast("bigint")))
    while max_depth is None or done < max_depth:
        hops = HOPS if max_depth is None else min(HOPS, max_depth - done)
        here, reached = frontier.select("seed", "node"), None
        for i in range(1, hops + 1):
            here = here.join(steps, F.col("node") == F.col("a")).select("seed", F.col("b").alias("node")).distinct()
            part = here.withColumn("depth", F.lit(done + i).cast("bigint"))
            reached = part if reached is None else reached.unionByName(part)
        new = cut(reached.groupBy("seed", "node").agg(F.min("depth").alias("depth")).join(known.select("seed", "node"), ["seed", "node"], "left_anti"))
        done += hops
        known = known.unionByName(new)
        frontier = new.filter(F.col("depth") == done)
        if frontier.isEmpty():
            break
    return known


def dependents(changed: DataFrame, import_decls: DataFrame, src_files: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """(repo, changed, file, depth): files that import or include each changed file (repo, path), directly or not.

    Depth is the least number of steps. A changed Python file isn't its own
    dependent, a C file is if it is reached again. Files become integers first,
    so that the rounds carry three numbers a row.
    """
    python = cut(python_matches(import_decls, src_files).select("repo", "imported", "importer").distinct())
    both = lambda df: df.select("repo", F.col("imported").alias("a"), F.col("importer").alias("b")).distinct()
    steps = cut(both(python.unionByName(c_matches(import_decls, src_files).drop("module"))))
    first = cut(both(python.unionByName(c_matches(import_decls, src_files, roots=True).drop("module"))))
    seeds = changed.select("repo", F.col("path").alias("a")).distinct()
    names = first.select("repo", F.col("a").alias("path")).unionByName(first.select("repo", F.col("b").alias("path"))).unionByName(seeds.select("repo", F.col("a").alias("path")))
    codes = small_side(names.distinct().withColumn("id", F.monotonically_increasing_id()))
    coded = lambda df, name: df.join(codes.select("repo", F.col("path").alias(name), F.col("id").alias(f"{name}_id")), ["repo", name])
    numbers = lambda df: coded(coded(df, "a"), "b").select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))
    start = coded(seeds, "a").select(F.col("a_id").alias("seed"), F.col("a_id").alias("node"))
    reached = closure(start, numbers(steps), max_depth, first=numbers(first))
    named = lambda name: codes.select(F.col("id").alias(name), F.col("path").alias(f"{name}_path"))
    found = reached.join(codes.select(F.col("id").alias("seed"), "repo", F.col("path").alias("changed")), "seed").join(named("node"), "node")
    return found.filter((F.col("seed") != F.col("node")) | ~F.col("changed").endswith(".py")).select("repo", "changed", F.col("node_path").alias("file"), "depth")


def callers_by_name(changed: DataFrame, functions: DataFrame, edges: DataFrame) -> DataFrame:
    """(repo, changed, file): files with a function that calls one whose name a changed file (repo, path) defines.

    Names are looked up in the changed file's repository; the caller files of
    each name are made distinct before they meet the changed files.
    """
    named = functions.filter((F.trim("name") != "") & (F.col("name") != "<module>"))
    calls = edges.filter("edge_type = 'callsFunction'").select("src", "dst")
    callee = named.select(F.col("fn_uid").alias("dst"), F.col("repo"), "name")
    caller = functions.select(F.col("fn_uid").alias("src"), F.col("repo").alias("caller_repo"), F.col("file").alias("caller_file"))
    files = calls.join(callee, "dst").join(caller, "src").filter("repo = caller_repo").select("repo", "name", F.col("caller_file").alias("file")).distinct()
    seeds = changed.select("repo", F.col("path").alias("changed")).distinct()
    asked = named.select("repo", F.col("file").alias("changed"), "name").join(seeds, ["repo", "changed"]).distinct()
    return asked.join(files, ["repo", "name"]).filter("file <> changed").select("repo", "changed", "file").distinct()


def impact(changed: DataFrame, import_decls: DataFrame, src_files: DataFrame, functions: DataFrame, edges: DataFrame) -> DataFrame:
    """(repo, changed, affected, category) for all changed files (repo, path) at once.

    Categories: ``import`` for files that import a changed file, directly or not;
    ``caller`` for files with a function that calls one named like a function of
    a changed file.
    """
    imports = dependents(changed, import_decls, src_files).filter("file <> changed").select("repo", "changed", F.col("file").alias("affected"), F.lit("import").alias("category"))
    callers = callers_by_name(changed, functions, edges).select("repo", "changed", F.col("file").alias("affected"), F.lit("caller").alias("category"))
    return imports.unionByName(callers)
