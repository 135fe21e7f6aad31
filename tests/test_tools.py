import pytest

from graphloom.operators import extract
from graphloom.plans import graph_queries, tools
from graphloom.sources import files
from pyspark.sql import functions as F


def test_symbol_usages(spark, small):
    every = graph_queries.usages_function(spark, small)
    name = every.filter("type = 'call'").orderBy("symbol").first().symbol
    n, found = tools.counted(tools.find_symbol_usages(spark, small, name, "function"))
    assert n == every.filter(F.col("symbol") == name).count() > 1 and {r.type for r in found.collect()} == {"definition", "call"}
    assert tools.find_symbol_usages(spark, small, "no_such_symbol", "typedef").count() == 0
    with pytest.raises(ValueError, match="symbol_type"):
        tools.find_symbol_usages(spark, small, name, "module")


def test_dependencies_and_impact(spark, small):
    found = graph_queries.import_resolution(spark, small).filter("importer <> imported").orderBy("repo", "imported", "importer").first()
    direct = {r.file: r.depth for r in tools.get_include_dependencies(spark, small, found.imported, found.repo).collect()}
    assert direct[found.importer] == 1
    affected = {(r.affected, r.category) for r in tools.check_affected_files(spark, small, [found.imported], found.repo).collect()}
    assert {(f, "import") for f in direct if f != found.imported} <= affected
    with pytest.raises(ValueError):
        tools.check_affected_files(spark, small, [])


def test_callers_and_fields(spark, small):
    call = graph_queries.caller_two_key_join(spark, small).orderBy("callee", "caller").first()
    direct = tools.get_function_callers(spark, small, call.callee, include_indirect=False)
    assert call.caller in {r.caller for r in direct.collect()} and direct.count() <= tools.get_function_callers(spark, small, call.callee).count()
    assert tools.find_struct_field_access(spark, small, "nothing", "here").count() == 0


def test_search_by_text(spark, small):
    row = spark.read.parquet(f"{small}/func_defs.parquet").filter("signature is not null and file like '%.py'").orderBy("row_id").first()
    got = tools.semantic_code_search(spark, small, f"{row.name}\n{row.signature}", "*.py", 3).collect()
    assert row.name in {r.name for r in got if r.kind == "function"} and max(r["rank"] for r in got) <= 3
    assert tools.semantic_code_search(spark, small, "  ").count() == 0
    with pytest.raises(ValueError):
        tools.semantic_code_search(spark, small, "x", limit=0)


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([(1, "r", "a.py", "def f():\n    return g()\n")], "file_id bigint, repo string, path string, content string")
    edges = spark.createDataFrame([("callsFunction", "x", "y")], "edge_type string, src string, dst string")
    files.export_graph(extract.extract_facts(df), edges, str(tmp_path))
    assert spark.read.json(str(tmp_path / "index")).first().call == 1
    assert spark.read.json(str(tmp_path / "files")).count() == 2 and spark.read.json(str(tmp_path / "relationships")).first().edge_type == "callsFunction"
