import datetime as dt
import json
import time

import numpy as np

from graphloom.functions import exprs as X
from graphloom.operators import embed, extract, search, snapshots, traverse
from graphloom.sources import files
from graphloom.streaming import debounce
from pyspark.sql import functions as F


def test_closure_depths_and_cycles(spark):
    steps = [("a", "b"), ("b", "c"), ("c", "a"), ("a", "c"), ("c", "d"), ("x", "x")]
    got = {(r.seed, r.node): r.depth for r in traverse.closure(spark.createDataFrame([("a", "a"), ("x", "x")], "seed string, node string"), spark.createDataFrame(steps, "a string, b string")).collect()}
    assert got == {("a", "a"): 0, ("a", "b"): 1, ("a", "c"): 1, ("a", "d"): 2, ("x", "x"): 0}
    cut = traverse.closure(spark.createDataFrame([("a", "a")], "seed string, node string"), spark.createDataFrame(steps, "a string, b string"), max_depth=1)
    assert cut.count() == 3


def test_nearest_against_brute_force(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(200, 8))
    rows = [(i, [float(x) for x in v[i]]) for i in range(200)] + [(900, None), (901, [1.0]), (902, [float("nan")] * 8), (903, [0.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(3)
    got = {(r.query_id, r["rank"]): r.vec_id for r in search.nearest(df.filter("vec_id % 50 = 0"), df, 5, 8).collect()}
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    for q in range(0, 200, 50):
        order = np.argsort(-np.round(unit @ unit[q], 6), kind="stable")[:5]
        assert [got[(q, k + 1)] for k in range(5)] == order.tolist()


def test_nearest_in_blocks_and_by_index(spark, monkeypatch):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 16))
    v = centres[rng.integers(0, 12, 1500)] + 0.6 * rng.normal(size=(1500, 16))
    v[500:1000] = centres[0] + 0.6 * rng.normal(size=(500, 16))  # a third in one place
    df = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)] + [(None, [1.0] * 16), (9001, None), (9002, [0.0] * 16)], "vec_id bigint, embedding array<double>")
    asked = df.filter("vec_id % 20 = 0")
    want = {(r.query_id, r["rank"]): r.vec_id for r in search.nearest(asked, df, 10, 16).collect()}
    monkeypatch.setattr(search, "QUERIES_AT_ONCE", 20)
    monkeypatch.setattr(search, "NUMBERS_AT_ONCE", 16 * 200)
    exact = search.nearest(asked, df, 10, 16)
    assert {(r.query_id, r["rank"]): r.vec_id for r in exact.collect()} == want and len(want) == 750
    index = search.CellIndex(df, 16)
    assert index.rows.count() == 1501
    got = search.recall(index.nearest(asked, 10, probes=6), exact).first()
    assert got.queries == 75 and got.recall >= 0.9
    assert search.nearest(asked.limit(0), df, 10, 16).count() == 0 and search.CellIndex(df.limit(0), 16).nearest(asked, 10).count() == 0


def test_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [float("inf"), 1.0]), (5, [1.0])]
    got = {r.i: (r.valid, r.zero) for r in spark.createDataFrame(rows, "i int, v array<double>").select("i", X.valid_vector(F.col("v"), 2).alias("valid"), X.zero_vector(F.col("v")).alias("zero")).collect()}
    assert got == {1: (True, False), 2: (True, True), 3: (False, False), 4: (False, False), 5: (False, False)}


def facts_of(spark, path, code, stdlib=frozenset({"os"})):
    df = spark.createDataFrame([(1, "r", path, code)], "file_id bigint, repo string, path string, content string")
    return sorted(extract.extract_facts(df, stdlib).collect(), key=lambda f: (f.line, f.col))


def test_python_facts(spark):
    code = "import os, thing as t\nfrom .pkg import a, b as c\n\nclass K(Base, m.N, metaclass=M):\n    def go(self, x, y=1, z: int = 2, *args):\n        'Doc.'\n        return t.run(helper(x))\n\ndef top() -> int:\n    return K().go(1)\n\ntop()\n"
    facts = facts_of(spark, "a.py", code)
    by = lambda k: [(f.name, f.owner, f.detail, f["items"]) for f in facts if f.kind == k]
    assert by("import") == [(".pkg", None, "c", ["a", "b"])]
    assert by("class") == [("K", "Base,m.N", None, ["go"])]
    assert by("function") == [("go", None, "go(self, x, y)", ["self", "x", "y"]), ("top", "int", "top() -> int", [])]
    assert by("docstring") == [("go", None, "Doc.", None)]
    assert sorted((n, o, d) for n, o, d, _ in by("call")) == [("K", "top", "plain"), ("go", "top", "method"), ("helper", "go", "plain"), ("run", "go", "method"), ("top", "module", "plain")]


def test_more_python_facts(spark):
    code = '@dec(1)\nclass A:\n    class B(C[int], x()):\n        async def f(self, a=g()):\n            def inner(): return h()\n            """late"""\n    def f(self): "one"\nfrom os import (x,\n  y as z)\nimport q.r as s, t.u as v\nx[0](1); f"{k()}"\n'
    facts = facts_of(spark, "b.py", code)
    assert [(f.name, f.owner, f["items"]) for f in facts if f.kind == "class"] == [("A", None, ["f", "inner", "f"]), ("B", None, ["f", "inner"])]
    assert [(f.name, f.owner) for f in facts if f.kind == "call"] == [("dec", "module"), ("x", "module"), ("g", "f"), ("h", "inner")]
    assert [(f.name, f.detail) for f in facts if f.kind == "docstring"] == [("f", "late"), ("f", "one")]
    assert [(f.name, f.detail, f["items"]) for f in facts if f.kind == "import"] == [("q.r", "v", ["t.u"])]


def test_c_facts(spark):
    code = '#include <stdio.h>\n#include "own.h"\n#define LIMIT 10\n#define F(x) x\ntypedef struct { int a; char *b; } box;\nstruct node { struct node *next; int v[3]; };\ntypedef unsigned long word;\nstatic int count;\nint use(struct node *p, int k);\nint use(struct node *p, int k) {\n    int n;\n    p->v = go(LIMIT);\n    return k;\n}\n'
    facts = facts_of(spark, "a.c", code)
    by = lambda k: [(f.name, f.owner, f.detail, f["items"]) for f in facts if f.kind == k]
    assert [x[0] for x in by("import")] == ["own.h"]
    assert by("macro") == [("LIMIT", None, "10", None)]
    assert [(n, i) for n, _, _, i in by("struct")] == [("box", ["a", "b"]), ("node", ["next", "v"])]
    assert [x[:3] for x in by("typedef")] == [("word", None, "unsigned long")]
    assert [(n, d) for n, _, d, _ in by("function")] == [("use", "use(p, k);"), ("use", "use(p, k)")]
    assert [(n, o) for n, o, *_ in by("call")] == [("go", "use")]
    assert [(n, o, d) for n, o, d, _ in by("field_access")] == [("v", "node", "pointer")]
    assert [(n, o) for n, o, *_ in by("variable")] == [("count", None), ("n", "use")]
    assert [n for n, *_ in by("macro_usage")] == ["LIMIT"]
    more = facts_of(spark, "b.c", "typedef int word;\nint total;\nvoid f(void) {\n    int n;\n    word w;\n    n = total;\n    (*fp)(1);\n    struct far *q = 0;\n}\nvoid g(void) { n = 1; }\n")
    assert [(f.name, f.owner, f.detail) for f in more if f.kind == "variable_usage"] == [("n", "f", "local"), ("total", "f", "global"), ("n", "g", "other")]
    assert [(f.name, f.owner) for f in more if f.kind == "typedef_usage"] == [("word", "f")]
    assert [(f.name, f.owner) for f in more if f.kind == "call"] == [("fp", "f")] and [f.name for f in more if f.kind == "struct"] == ["far"]


def test_extraction_isolates_bad_files(spark):
    df = spark.createDataFrame([(1, "r", "a.py", "def f(:\n"), (2, "r", "b.py", "def g(): pass\n"), (3, "r", "c.py", None), (4, "r", "d.txt", "x"), (5, "r", "e.c", "")], "file_id bigint, repo string, path string, content string")
    assert {(r.file_id, r.kind) for r in extract.extract_facts(df).collect()} == {(1, "error"), (2, "function")}


def test_incremental_store(spark):
    old = spark.createDataFrame([(1, "a", "x", 5), (2, "b", "y", 6)], "uid int, name string, body string, line int")
    new = spark.createDataFrame([(1, "a", "x", 9), (2, "b", "z", 6), (3, "c", None, 1), (3, "c", None, 2)], "uid int, name string, body string, line int")
    h = lambda d: d.withColumn("h", snapshots.content_hash("name", "body"))
    assert sorted((r.uid, r.line) for r in snapshots.changed_rows(h(new), h(old), "uid", "h").collect()) == [(2, 6), (3, 1), (3, 2)]
    assert snapshots.changed_rows(h(old), h(old), "uid", "h").count() == 0
    assert sorted(r.line for r in snapshots.upsert(old, new.filter("uid = 2"), "uid").collect()) == [5, 6]


def test_debounce_stream_equals_batch(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    events = [(p, t + dt.timedelta(seconds=s)) for p, ss in {"a": (0, 4, 9, 30), "b": (1, 20, 29)}.items() for s in ss]
    df = spark.createDataFrame(events, "path string, ts timestamp")
    want = sorted((r.path, r.started, r.changes) for r in debounce.debounced(df, "path", "10 seconds").collect())
    assert [(p, c) for p, _, c in want] == [("a", 3), ("a", 1), ("b", 1), ("b", 2)]
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = debounce.debounced(stream, "path", "10 seconds", watermark="1 minute").writeStream.format("memory").queryName("bursts").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.path, r.started, r.changes) for r in spark.table("bursts").collect()) == want


def test_watch_folder(spark, tmp_path):
    seen = []
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text("\n".join(json.dumps({"path": p, "kind": "modify"}) for p in ("a.py", "b.txt", "c.h")))
    q = debounce.watch_folder(spark, str(tmp_path / "in"), "path string, kind string", lambda df, n: seen.extend(r.path for r in df.collect()), str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    time.sleep(0.1)
    assert sorted(seen) == ["a.py", "c.h"]


def test_source_scan_and_export(spark, tmp_path):
    for p, text in {"a/b.py": b"x = 1\n", "a/c.h": b"int x;\n", "build/z.py": b"y", "a/__pycache__/q.py": b"y", "outer/w.c": "gr\u00fc\u00df".encode(), "notes.md": b"#", "k.cpp": b"x"}.items():
        (tmp_path / "src" / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "src" / p).write_bytes(text)
    found = files.scan_sources(spark, str(tmp_path / "src"), "r")
    assert {(r.path, r.lang, r.content) for r in found.collect()} == {("a/b.py", "python", "x = 1\n"), ("a/c.h", "c", "int x;\n"), ("outer/w.c", "c", "gr\u00fc\u00df")}
    files.export_json(found.select("path", "lang"), str(tmp_path / "out"), by="lang")
    assert spark.read.json(str(tmp_path / "out")).count() == 3


def test_embedding(spark):
    rows = [(1, "load_page", "load_page(x)", "Loads a page."), (2, "load_pages", "load_pages(x)", None), (3, "zip_all", "", ""), (4, None, None, None)]
    df = spark.createDataFrame(rows, "row_id bigint, name string, signature string, docstring string")
    v = embed.embed(df, "row_id", embed.function_text(F.col("name"), F.col("signature"), F.col("docstring")))
    got = {r.vec_id: r.embedding for r in v.collect()}
    assert not any(got[4]) and abs(sum(x * x for x in got[1]) - 1) < 1e-5
    near = [(r.query_id, r.vec_id) for r in search.nearest(v.filter("vec_id = 1"), v, 2, embed.DIMENSION).orderBy("rank").collect()]
    assert near == [(1, 1), (1, 2)]
    text = df.select(embed.listed_text(F.col("name"), "Methods", F.array(F.lit("a"), F.lit("b"))).alias("t")).first().t
    assert text == "load_page\nMethods: a, b"


NODE, EDGE = "kind string, uid string, repo string, file string, label string, h string", "edge_type string, src string, dst string"


def test_store_inserts_replaces_and_cascades(spark):
    nodes = spark.createDataFrame([("File", "f1", "r", "a.py", "a.py", "1"), ("Function", "x", "r", "a.py", "go", "1"), ("Function", "y", "r", "b.py", "stop", "1"), ("Class", "c", "r", "a.py", "K", "1"), ("Function", "z", "r", "c.py", "go", "1")], NODE)
    edges = spark.createDataFrame([("callsFunction", "y", "x"), ("containsFunction", "f1", "x"), ("callsFunction", "z", "y")], EDGE)
    new = spark.createDataFrame([("Function", "x", "r", "a.py", "go", "2"), ("Function", "y", "r", "b.py", "stop", "1"), ("Function", "n", "r", "b.py", "new", "1"), ("Function", "e", "r", "b.py", " ", "1"), ("Class", "q", None, None, None, None)], NODE)
    links = spark.createDataFrame([("callsFunction", "n", "x"), ("callsFunction", "n", "x"), ("callsFunction", "n", "nowhere"), ("callsFunction", "y", "x")], EDGE)
    after, linked, done = snapshots.insert_graph(nodes, edges, new, links)
    assert {r.uid: r.status for r in done.collect()} == {"x": "updated", "y": "unchanged", "n": "inserted", "e": "rejected", "q": "rejected"}
    assert {(r.uid, r.h) for r in after.collect()} == {("f1", "1"), ("x", "2"), ("y", "1"), ("c", "1"), ("z", "1"), ("n", "1")}
    assert sorted((r.src, r.dst) for r in linked.collect()) == [("f1", "x"), ("n", "x"), ("y", "x"), ("z", "y")]
    files = spark.createDataFrame([("r", "a.py")], "repo string, file string")
    kept, left = snapshots.delete_cascade(nodes, edges, files)
    assert {r.uid for r in kept.collect()} == {"y", "z"} and [(r.src, r.dst) for r in left.collect()] == [("z", "y")]
    fresh = spark.createDataFrame([("File", "f1", "r", "a.py", "a.py", "2"), ("Function", "w", "r", "a.py", "walk", "1")], NODE)
    kept, left = snapshots.replace_files(nodes, edges, files, fresh, links.limit(0))
    assert {r.uid for r in kept.collect()} == {"f1", "w", "y", "z"} and sorted((r.src, r.dst) for r in left.collect()) == [("y", "z"), ("z", "y")]  # go is found in c.py
    assert snapshots.insert_graph(nodes.limit(0), edges.limit(0), new.limit(0), links.limit(0))[0].count() == 0


def test_change_batch(spark):
    t = dt.datetime(2024, 1, 1)
    nodes = spark.createDataFrame([("Function", "x", "r", "a.py", "go", "1"), ("Function", "y", "r", "b.py", "stop", "1")], NODE)
    edges = spark.createDataFrame([("callsFunction", "y", "x")], EDGE)
    events = spark.createDataFrame([("r", "a.py", False, t), ("r", "a.py", True, t + dt.timedelta(1)), ("r", "b.py", True, t), ("r", "b.py", False, t + dt.timedelta(1))], "repo string, file string, deleted boolean, ts timestamp")
    new = spark.createDataFrame([("Function", "y", "r", "b.py", "stop", "1"), ("Function", "v", "r", "b.py", "late", "1"), ("Function", "u", "r", "other.py", "not read", "1")], NODE)
    after, left, status = snapshots.apply_changes(nodes, edges, events, new, edges.limit(0))
    assert {(r.uid, r.status) for r in status.collect()} == {("x", "deleted"), ("y", "unchanged"), ("v", "inserted")}
    assert {r.uid for r in after.collect()} == {"y", "v"} and left.count() == 0


def test_stored_state_and_checks_before_watching(spark, tmp_path):
    known = snapshots.HashTable(spark, str(tmp_path / "hashes"))
    rows = spark.createDataFrame([("a",), ("a",), ("b",)], "h string")
    assert {r.stored for r in known.marked(rows).collect()} == {False}
    known.add(rows)
    known.add(rows)
    assert known.read().count() == 2 and {r.stored for r in known.marked(rows).collect()} == {True}
    known.clear()
    assert not known.exists()
    spaces = snapshots.Workspaces(spark, str(tmp_path / "spaces"))
    nodes = spark.createDataFrame([(1,)], "uid int")
    watch = lambda n: debounce.watch_workspace(spark, spaces, "/w", n, str(tmp_path / "in"), "path string", lambda df, b: None, str(tmp_path / "cp"))
    import pytest

    with pytest.raises(ValueError, match="registered"):
        watch(nodes)
    spaces.save(spark.createDataFrame([("/w", 7, dt.datetime(2024, 1, 1))], "path string, namespace bigint, registered_at timestamp"))
    with pytest.raises(ValueError, match="empty"):
        watch(nodes.limit(0))
    (tmp_path / "in").mkdir()
    q = watch(nodes)
    assert q.isActive
    q.stop()
    spaces.clear()
    assert not spaces.registered("/w")


def test_import_matching_in_all_ways(spark):
    imports = [("a.b", "m.py"), ("a.b.c.d", "m.py"), ("a", "m.py"), (".c", "q.py"), ("x", "m.py"), ("util/h.h", "k.c"), ("h.h", "k.c"), ("packages/util/h.h", "l.c"), (None, "m.py"), (" ", "m.py"), (".", "m.py")]
    i = spark.createDataFrame([("r", m, f) for m, f in imports], "repo string, module string, file string")
    f = spark.createDataFrame([("r", "src/a/b/c.py"), ("r", "include/util/h.h"), ("r", "util/h.c"), ("r", None)], "repo string, path string")
    got = {(r.importer, r.module) for r in traverse.python_matches(i, f).filter("imported = 'src/a/b/c.py'").collect()}
    assert got == {("m.py", "a.b"), ("m.py", "a.b.c.d"), ("q.py", ".c")}
    got = {(r.imported, r.importer, r.module) for r in traverse.c_matches(i, f).collect()}
    assert got == {("include/util/h.h", "k.c", "h.h"), ("util/h.c", "k.c", "util/h.h"), ("util/h.c", "k.c", "h.h"), ("util/h.c", "l.c", "packages/util/h.h")} | {(x, y, z) for x, y, z in got if x == "include/util/h.h"}
    roots = traverse.c_matches(i, f, roots=True)
    assert {(r.imported, r.module) for r in roots.collect()} >= {("include/util/h.h", m) for m in ("h.h", "util/h.h", "packages/util/h.h")}
    chain = [(f"m{n}", f"m{n + 1}.py") for n in range(25)]
    found = traverse.dependents(spark.createDataFrame([("r", "m0.py")], "repo string, path string"), spark.createDataFrame([("r", m, p) for m, p in chain], "repo string, module string, file string"), spark.createDataFrame([("r", "m0.py")], "repo string, path string"))
    assert {(r.file, r.depth) for r in found.collect()} == {(f"m{n}.py", n) for n in range(1, 22)}
