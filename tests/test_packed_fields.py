import pytest

from graphloom.operators.packed_fields import candidates, cut_at, declared, split_packed, unwrap


def values(text):
    inner, found = unwrap(text)
    return cut_at(inner, found, "".join({c for _, c in found}))


@pytest.mark.parametrize(
    "text, want",
    [
        ('["self", "x: int = 1"]', ["self", "x: int = 1"]),
        ("self, key: dict[str, int] = {}", ["self", "key: dict[str, int] = {}"]),
        ('"[\\"a\\", \\"b=\\\\\\"x, y\\\\\\"\\"]"', ["a", 'b="x, y"']),
        ('["a; b; c=\\";\\""]', ["a", "b", 'c=";"']),
        ('"a", "d: dict[str, int] = {""k"": 1}"', ["a", 'd: dict[str, int] = {"k": 1}']),
        ("a | b=(1, 2)\n c\t'd: str'", ["a", "b=(1, 2)", "c", "d: str"]),
        ("{int x, void (*f)(int, void *)}", ["int x", "void (*f)(int, void *)"]),
        ("; a;; b ;", ["a", "b"]),
        ("a、b；c，d", ["a", "b", "c", "d"]),
        ("()", []),
        ('[""]', []),
        ("   ", []),
        ("x", ["x"]),
        ('a, b="unclosed, c', ["a", 'b="unclosed', "c"]),
        ("a: Callable[[int, str], bool], b", ["a: Callable[[int, str], bool]", "b"]),
    ],
)
def test_values(text, want):
    assert values(text) == want


def test_declared_and_candidates():
    assert declared("f(a, b) -> dict[str, int]") == 2
    assert declared("f()") == 0
    assert declared(None) is None
    assert candidates(",;") == [",;", ",", ";"]


def test_a_bar_inside_types_is_no_delimiter_of_its_source(spark):
    rows = [(i, "self, key: int | None, x", "f(self, key, x)") for i in range(20)] + [(99, "a: int | None, b", None), (100, None, None), (101, " ", "f()")]
    df = spark.createDataFrame(rows, "row_id bigint, parameters string, signature string")
    got = {(r.row_id, r.pos): r.param for r in split_packed(df, "row_id", "parameters", "signature").collect()}
    assert got[(99, 1)] == "a: int | None" and got[(99, 2)] == "b" and (99, 3) not in got
    assert not [k for k in got if k[0] >= 100]


def test_empty_table_repeated_rows_long_text_and_other_columns(spark):
    schema = "row_id bigint, parameters string, signature string, source string, packed string, profile string"
    assert split_packed(spark.createDataFrame([], schema), "row_id", "parameters", "signature", ("source",)).count() == 0
    long = ", ".join(f"a{i}" for i in range(20000))
    df = spark.createDataFrame([(1, "a, b", None, None, "p", "q"), (1, "a, b", None, None, "p", "q"), (2, long, None, "s", None, None)], schema)
    got = split_packed(df, "row_id", "parameters", "signature", ("source",)).collect()
    assert sorted((r.row_id, r.pos) for r in got if r.row_id == 1) == [(1, 1), (1, 1), (1, 2), (1, 2)]
    assert sum(r.row_id == 2 for r in got) == 20000


def test_counts_agree_with_all_signatures(spark, small):
    from graphloom.operators.packed_fields import function_parameters

    rows = spark.read.parquet(f"{small}/func_defs.parquet")
    counts = {r.row_id: r["count"] for r in function_parameters(rows).groupBy("row_id").count().collect()}
    for r in rows.filter("signature is not null").filter(r"parameters rlike '\\S'").select("row_id", "signature").collect():
        assert counts.get(r.row_id, 0) == declared(r.signature)
