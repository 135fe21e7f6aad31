"""The six look-ups of the interface with their arguments, over the tables of a folder.

Each gives a DataFrame that Spark evaluates when it is read; ``counted`` adds the
number of rows. Wrong arguments raise ValueError.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import embed, nodes, traverse
from graphloom.plans import fact_queries, graph_queries
from graphloom.session import cut
from graphloom.sources.tables import table

#: Kinds of symbols (fixed values of the interface).
SYMBOL_TYPES = ("function", "macro", "variable", "struct", "typedef")


def counted(found: DataFrame) -> tuple[int, DataFrame]:
    """Number of rows and the rows, computed once."""
    found = cut(found)
    return found.count(), found


def find_symbol_usages(spark: SparkSession, folder: str, symbol: str, symbol_type: str) -> DataFrame:
    """(symbol, type, file, line, context): definitions and uses of a symbol."""
    if symbol_type not in SYMBOL_TYPES:
        raise ValueError(f"symbol_type is one of {', '.join(SYMBOL_TYPES)}, not {symbol_type!r}")
    if symbol_type == "function":
        found = graph_queries.usages_function(spark, folder)
    else:
        found = getattr(fact_queries, f"usages_{symbol_type}")(spark, folder).withColumnRenamed("path", "file")
    return found.filter(F.col("symbol") == symbol)


def get_include_dependencies(spark: SparkSession, folder: str, path: str, repo: str | None = None) -> DataFrame:
    """(repo, file, depth) of all files that import or include a file, directly or not."""
    asked = _files(spark, folder, [path], repo)
    return traverse.dependents(asked, table(spark, folder, "import_decls"), table(spark, folder, "src_files")).select("repo", "file", "depth")


def find_struct_field_access(spark: SparkSession, folder: str, struct_name: str, field_name: str) -> DataFrame:
    """(struct_name, field_name, path, line, col, access_type) of all accesses to a field of a struct."""
    return fact_queries.field_access(spark, folder).filter((F.col("struct_name") == struct_name) & (F.col("field_name") == field_name))


def get_function_callers(spark: SparkSession, folder: str, function_name: str, include_indirect: bool = True) -> DataFrame:
    """(type, caller, file, line, detail): callers by edges, and functions of the same files that take function pointers."""
    f = nodes.functions(table(spark, folder, "func_defs"))
    named = f.filter(F.col("name") == function_name)
    calls = nodes.edges(table(spark, folder, "graph_edges")).filter("edge_type = 'callsFunction'")
    line = F.coalesce("line_no", F.lit(0)).cast("int").alias("line")
    callers = calls.join(named.select(F.col("fn_uid").alias("dst")), "dst", "left_semi").select(F.col("src").alias("fn_uid")).distinct().join(f, "fn_uid")
    direct = callers.select(F.lit("direct").alias("type"), F.col("name").alias("caller"), "file", line, F.coalesce("signature", F.lit("")).alias("detail"))
    if not include_indirect:
        return direct
    pointers = f.filter(F.coalesce("parameters", F.lit("")).contains("(*")).join(named.select("repo", "file").distinct(), ["repo", "file"], "left_semi")
    return direct.unionByName(pointers.select(F.lit("indirect").alias("type"), F.col("name").alias("caller"), "file", line, F.coalesce("parameters", F.lit("")).alias("detail")))


def semantic_code_search(spark: SparkSession, folder: str, text: str, file_pattern: str = "*", limit: int = 10) -> DataFrame:
    """(kind, vec_id, name, file, similarity, rank): functions and classes nearest to a text, in files that match a pattern."""
    if limit < 1:
        raise ValueError("limit is at least 1")
    asked = cut(embed.embed(spark.createDataFrame([(0, text)], "vec_id bigint, text string"), "vec_id", F.col("text")))
    functions, classes = fact_queries.searched(spark, folder)
    both = fact_queries.by_text(asked, functions, "function", file_pattern, limit).unionByName(fact_queries.by_text(asked, classes, "class", file_pattern, limit))
    return both.drop("query_id")


def check_affected_files(spark: SparkSession, folder: str, changed_files: list[str], repo: str | None = None) -> DataFrame:
    """(repo, changed, affected, category) of all files that a change of the stated files affects."""
    asked = _files(spark, folder, changed_files, repo)
    tables = (table(spark, folder, t) for t in ("import_decls", "src_files"))
    return traverse.impact(asked, *tables, nodes.functions(table(spark, folder, "func_defs")), nodes.edges(table(spark, folder, "graph_edges")))


def _files(spark: SparkSession, folder: str, paths: list[str], repo: str | None) -> DataFrame:
    """(repo, path) of the stated paths among stored files and files that import, in one repository or in all."""
    if not paths:
        raise ValueError("no file is stated")
    stored = table(spark, folder, "src_files").select("repo", "path").unionByName(table(spark, folder, "import_decls").select("repo", F.col("file").alias("path")))
    found = stored.filter(F.col("path").isin(paths)).distinct()
    return found.filter(F.col("repo") == repo) if repo is not None else found
