"""Registered queries on facts extracted from source text, from marks that are written once a query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.functions import exprs as X
from graphloom.operators import embed, extract, search
from graphloom.operators.extract import extract_facts
from graphloom.operators.nodes import first_by
from graphloom.plans.graph_queries import query, registry
from graphloom.session import cut, small_side, spread
from graphloom.sources.tables import table

QUERIES, SQL = registry(__name__)


def _facts(s: SparkSession, d: str) -> DataFrame:
    return cut(extract_facts(table(s, d, "src_files")))


def _c_facts(s: SparkSession, d: str) -> DataFrame:
    return cut(extract_facts(table(s, d, "src_files").filter(F.col("path").rlike(r"\.[ch]$"))))


@query()
def extract_python(s: SparkSession, d: str) -> DataFrame:
    """Facts of Python files."""
    return extract_facts(table(s, d, "src_files").filter(F.col("path").endswith(".py"))).withColumn("items", F.array_join("items", ","))


@query()
def extract_c(s: SparkSession, d: str) -> DataFrame:
    """Facts of C files."""
    return extract_facts(table(s, d, "src_files").filter(~F.col("path").endswith(".py"))).withColumn("items", F.array_join("items", ","))


@query()
def extract_unfiltered(s: SparkSession, d: str) -> DataFrame:
    """Functions, classes and all imports of Python files, standard library too."""
    facts = extract_facts(table(s, d, "src_files").filter(F.col("path").endswith(".py")), stdlib=frozenset())
    return facts.filter(F.col("kind").isin("function", "class", "import")).select("file_id", "path", "kind", "name", "line", "col")


#: Names at the start of a line, for the SQL: (kind, pattern, files).
_BY_PATTERN = (
    ("function", r"(?:async[ \t]+)?def[ \t]+([A-Za-z_]\w*)", "LIKE '%.py'"),
    ("class", r"class[ \t]+([A-Za-z_]\w*)[ \t]*[(:\[]", "LIKE '%.py'"),
    ("import", r'#[ \t]*include[ \t]+"([^"\n]+)"', "NOT LIKE '%.py'"),
    ("macro", r"#[ \t]*define[ \t]+([A-Za-z_]\w*)(?:[ \t\n]|$)", "NOT LIKE '%.py'"),
)


@query(
    "WITH f AS (SELECT file_id, path, regexp_replace(replace(replace(content, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '(?s)''''''.*?''''''', '', 'g') AS c FROM src_files WHERE len(string_split(content, chr(34) || chr(34) || chr(34))) % 2 = 1) SELECT file_id, kind, name, count(*) AS n FROM ("
    + " UNION ALL ".join(rf"SELECT file_id, '{kind}' AS kind, unnest(regexp_extract_all(c, '(?m)^[ \t]*{pattern}', 1)) AS name FROM f WHERE path {test}" for kind, pattern, test in _BY_PATTERN)
    + ") GROUP BY ALL"
)
def fact_names(s: SparkSession, d: str) -> DataFrame:
    """Names of Python functions and classes, C includes and object macros per file, also of files with errors whose long strings all close."""
    files = table(s, d, "src_files").filter(F.size(F.split("content", '"""')) % 2 == 1)
    marks = extract.file_marks(files, tolerant=True)
    python = F.col("path").endswith(".py")
    wanted = (python & F.col("kind").isin("function", "class")) | (~python & F.col("kind").isin("import", "macro"))
    return marks.filter(wanted).groupBy("file_id", "kind", "name").agg(F.count(F.lit(1)).alias("n"))


@query()
def fact_counts(s: SparkSession, d: str) -> DataFrame:
    """Facts per file and kind, tokens as the size of its syntax, and the stored counts; files without facts too."""
    marks = cut(extract.file_marks(table(s, d, "src_files")))
    kinds = ["function", "class", "import", "struct", "macro", "variable", "typedef", "field_access", "call", "error"]
    counted = marks.groupBy("file_id").agg(*(F.count_if(F.col("kind") == k).alias(k) for k in kinds), F.max(F.when(F.col("kind") == "size", F.col("detail").cast("bigint"))).alias("tokens"))
    stored = table(s, d, "src_files").select("file_id", "functions_count", "classes_count", "imports_count", "ast_nodes")
    return stored.join(counted, "file_id", "left").na.fill(0, [*kinds, "tokens"])


@query()
def usages_macro(s: SparkSession, d: str) -> DataFrame:
    """Definitions and uses of macros."""
    return _usages(_c_facts(s, d), "macro", "macro_usage")


@query()
def usages_struct(s: SparkSession, d: str) -> DataFrame:
    """Definitions of structs and accesses to their fields."""
    f = _c_facts(s, d)
    defs = f.filter("kind = 'struct'").select(F.col("name").alias("symbol"), F.lit("definition").alias("type"), "path", "line", F.array_join("items", ",").alias("context"))
    known = defs.select("symbol").distinct()
    uses = f.filter("kind = 'field_access'").select(F.col("owner").alias("symbol"), F.lit("field_access").alias("type"), "path", "line", F.concat(F.lit("Field access: "), "name").alias("context"))
    return defs.unionByName(uses.join(known, "symbol", "left_semi"))


@query()
def usages_variable(s: SparkSession, d: str) -> DataFrame:
    """Definitions of variables with their types, and their uses."""
    f = _c_facts(s, d)
    defs = f.filter("kind = 'variable'").select(F.col("name").alias("symbol"), F.lit("definition").alias("type"), "path", "line", F.concat(F.lit("Variable definition: "), "detail").alias("context"))
    uses = f.filter("kind = 'variable_usage'").select(F.col("name").alias("symbol"), F.lit("usage").alias("type"), "path", "line", F.concat(F.lit("Used in function "), F.coalesce("owner", F.lit("module"))).alias("context"))
    return defs.unionByName(uses)


@query()
def usages_typedef(s: SparkSession, d: str) -> DataFrame:
    """Definitions of typedefs and the files that use them."""
    f = _c_facts(s, d)
    defs = f.filter("kind = 'typedef'").select(F.col("name").alias("symbol"), F.lit("definition").alias("type"), "path", "line", F.concat(F.lit("Typedef: "), "detail").alias("context"))
    uses = f.filter("kind = 'typedef_usage'").select(F.col("name").alias("symbol"), F.lit("usage").alias("type"), "path", F.lit(0).alias("line"), F.lit("").alias("context")).distinct()
    return defs.unionByName(uses)


@query()
def field_access(s: SparkSession, d: str) -> DataFrame:
    """Struct field accesses with their kind."""
    return _c_facts(s, d).filter("kind = 'field_access'").select(F.col("owner").alias("struct_name"), F.col("name").alias("field_name"), "path", "line", "col", F.col("detail").alias("access_type"))


@query()
def field_access_of_top(s: SparkSession, d: str) -> DataFrame:
    """Accesses to one field of one struct: that which is accessed most."""
    f = cut(_c_facts(s, d).filter("kind = 'field_access'").select(F.col("owner").alias("struct_name"), F.col("name").alias("field_name"), "path", "line", "col", F.col("detail").alias("access_type")))
    top = f.groupBy("struct_name", "field_name").count().orderBy(F.desc("count"), "struct_name", "field_name").limit(1).select("struct_name", "field_name")
    return f.join(small_side(top), ["struct_name", "field_name"])


@query()
def fact_edges(s: SparkSession, d: str) -> DataFrame:
    """Uses linked to what they mean, distinct: macros and typedefs of that name in any file, the first variable, the struct (own file, else first, else behind a typedef)."""
    f = _c_facts(s, d)
    uses = lambda kind: f.filter(F.col("kind") == kind).select("repo", "path", "name", "owner").distinct()
    defs = lambda kind: f.filter(F.col("kind") == kind).select("repo", "name", F.col("path").alias("target"), "line", "detail")
    first = lambda kind: first_by(defs(kind).select("repo", "name", "target", "line"), ["repo", "name"], F.col("target"), F.col("line")).select("repo", "name", "target")

    def edges(df: DataFrame, edge: str, function: str | None = None) -> DataFrame:
        return df.select(F.lit(edge).alias("edge_type"), "repo", "path", (F.col(function) if function else F.lit("")).alias("function"), "name", "target").distinct()

    macros = edges(uses("macro_usage").join(defs("macro").select("repo", "name", "target"), ["repo", "name"]), "usesMacro")
    typedefs = edges(uses("typedef_usage").join(defs("typedef").select("repo", "name", "target"), ["repo", "name"]), "usesTypedef")
    variables = edges(uses("variable_usage").filter("owner is not null").join(first("variable"), ["repo", "name"]), "usesVariable", "owner")
    accessed = f.filter("kind = 'field_access'").select("repo", "path", F.col("owner").alias("name")).distinct()
    own = defs("struct").select("repo", F.col("target").alias("path"), "name").distinct().withColumn("own", F.col("path"))
    behind = defs("typedef").groupBy("repo", "name").agg(F.min(F.element_at(F.split("detail", " "), -1)).alias("meant"))
    named = first("struct")
    found = accessed.join(own, ["repo", "path", "name"], "left").join(named.withColumnRenamed("target", "any"), ["repo", "name"], "left").join(behind, ["repo", "name"], "left")
    found = found.join(named.select("repo", F.col("name").alias("meant"), F.col("target").alias("typedefed")), ["repo", "meant"], "left")
    structs = edges(found.withColumn("target", F.coalesce("own", "any", "typedefed")).filter("target is not null"), "accessesStruct")
    return macros.unionByName(typedefs).unionByName(variables).unionByName(structs)


@query()
def calls_resolved(s: SparkSession, d: str) -> DataFrame:
    """Extracted calls joined to a function: of the same file, else the first of that name in the repository."""
    f = _facts(s, d)
    functions = f.filter("kind = 'function'").select("repo", "path", "name", "line")
    own = first_by(functions.select("repo", "path", "name", "line"), ["repo", "path", "name"], F.col("line")).withColumnRenamed("line", "own_line")
    any_of = first_by(functions, ["repo", "name"], F.col("path"), F.col("line")).select("repo", "name", F.col("path").alias("any_path"), F.col("line").alias("any_line"))
    calls = f.filter("kind = 'call'").select("repo", "path", F.col("owner").alias("caller"), "name", F.col("line").alias("at"))
    joined = calls.join(own, ["repo", "path", "name"], "left").join(any_of, ["repo", "name"], "left")
    target = F.when(F.col("own_line").isNotNull(), F.col("path")).otherwise(F.col("any_path"))
    return joined.select("repo", "path", "caller", F.col("name").alias("callee"), "at", target.alias("target_path"), F.coalesce("own_line", "any_line").alias("target_line"))


@query()
def semantic_search(s: SparkSession, d: str) -> DataFrame:
    """Ten functions nearest to each function whose row id is divisible by 100, by the vectors of their texts."""
    f = spread(table(s, d, "func_defs").select("row_id", "name", "signature", "docstring"))
    vectors = cut(embed.embed(f, "row_id", embed.function_text(F.col("name"), F.col("signature"), F.col("docstring"))))
    near = search.nearest(vectors.filter("vec_id % 100 = 0"), vectors, 10, embed.DIMENSION)
    return near.join(f.select(F.col("row_id").alias("vec_id"), "name"), "vec_id").select("query_id", "vec_id", "name", "similarity", "rank")


def _usages(f: DataFrame, kind: str, use: str) -> DataFrame:
    defs = f.filter(F.col("kind") == kind).select(F.col("name").alias("symbol"), F.lit("definition").alias("type"), "path", "line", F.coalesce("detail", F.lit("")).alias("context"))
    uses = f.filter(F.col("kind") == use).select(F.col("name").alias("symbol"), F.lit("usage").alias("type"), "path", F.lit(0).alias("line"), F.coalesce("owner", F.lit("")).alias("context")).distinct()
    return defs.unionByName(uses)


def by_text(asked: DataFrame, rows: DataFrame, kind: str, pattern: str, limit: int) -> DataFrame:
    """The ``limit`` rows (vec_id, name, file, text) nearest to each asked vector among twice as many whose file matches a pattern."""
    vectors = cut(embed.embed(rows, "vec_id", F.col("text")))
    some = asked.filter(F.exists("embedding", lambda x: x != 0))  # a text without words is similar to nothing
    near = search.nearest(some, vectors.filter(F.exists("embedding", lambda x: x != 0)), 2 * limit, embed.DIMENSION)
    named = near.join(rows.filter(X.glob_match(F.col("file"), pattern)).select("vec_id", "name", "file"), "vec_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    return named.withColumn("place", rank).filter(F.col("place") <= limit).select(F.lit(kind).alias("kind"), "query_id", "vec_id", "name", "file", "similarity", F.col("place").cast("bigint").alias("rank"))


def searched(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(vec_id, name, file, text) of functions and of classes."""
    f = spread(table(s, d, "func_defs").select(F.col("row_id").alias("vec_id"), "name", "file", embed.function_text(F.col("name"), F.col("signature"), F.col("docstring")).alias("text")))
    c = spread(table(s, d, "class_defs").select(F.col("row_id").alias("vec_id"), "name", "file", embed.listed_text(F.col("name"), "Methods", F.col("methods")).alias("text")))
    return f, c


@query()
def semantic_code_search(s: SparkSession, d: str) -> DataFrame:
    """Functions and classes of Python files nearest to the texts of the documents with an id divisible by 100."""
    asked = table(s, d, "documents").filter("doc_id % 100 = 0").select(F.col("doc_id").alias("vec_id"), "text")
    asked = cut(embed.embed(spread(asked), "vec_id", F.col("text")))
    f, c = searched(s, d)
    return by_text(asked, f, "function", "*.py", 10).unionByName(by_text(asked, c, "class", "*.py", 10))
