import ast
import warnings

import pyarrow.parquet as pq
import pytest

from graphloom.llm import c_source, doc_pairs, python_source, source_check
from graphloom.llm.peg import Grammar

GOOD = """
x: int = 1; y = *a, b
@dec(1)
async def f(a, /, b: int = 2, *args: *T, c, d=3, **kw) -> None:
    async with a as b, c as (d, e):
        await g(x for x in y if z)
    async for i, *j in k: pass
    else: yield from z
class K[T: int](B, metaclass=M):
    '''doc'''
    if (n := 10) > 5 and not n in (1, 2, *z): return
    try:
        pass
    except* (A, B) as e: raise X from None
    finally:
        del a[0], b.c
match x:
    case {"a": [1, *_], **rest} if y: pass
    case P(1, k=2) | None as q: pass
    case -1 + 2j: pass
lambda *a, b=1: (yield)
d = {**a, 'k': v, **{}}; s = {*a, 1}; l = [*a for a in b] if 0 else []
print(f"{x!r:>{w}} {{}} {a['b']}", 0x_ff, 1_0.5e-3j, b'x' b'y', r"\\d")
type A[T] = list[T]
global g; nonlocal h
from . import (a, b as c,)
from ...x.y import *
assert a, b
x @= y if a else lambda: 0
with (open(a) as f, b): pass
a[1:2, ::3, ...] = b = c
"""
CASES = [
    "", "\n\n# only\n", "x = 1", "if a:\n\tb\n\n\n#c\nelse:\n\tc", "def f():\n  '''a\nb'''\n", "x = (1,\n 2)\ny", "x = 1 \\\n + 2", "match = 1\nmatch.x(case)\nprint(type)\n", "a = b\r\nc = d\r\n", "f(a, *b, c=1, *d, **e)", "for x in *a, b: pass",
    "x = ", "if a\n  b", "if a:\nb", "  x", "x\n  y", "if a:\n    b\n  c", "f(a=1, b)", "f(**a, *b)", "def f(a=1, b): pass", "def f(*): pass", "1 = x", "f() = 1", "x + 1 = 2", "(a, b) += 1", "del f()", "for f() in x: pass", "a b", "'abc", '"""abc', "x = (1", "x = 1)", "(]", "0777", "1abc", "0x", "1__0",
    "try:\n  a\n", "else:\n  a\n", "@a\nx = 1", "class", "import a.b as", "from a import", "from a import (b", "return = 1", "None = 1", "x := 1", "print 'a'", "<<<<<<< HEAD\nx\n", "a = 5 $ 3", "lambda x: = 1", "def f(x): return x\n  y", "[x for x in]", "{a: 1, b}", "f(x for x in y, 1)", "async x", "'a' b'b'", "a = yield = 1", "case x: pass", "match x:\n  y", "x = {1: 2, **}", "\tx\n        y", "if a:\n        b\n\tc",
    "f(x for x in y)", "a if b else c", "not a", "a = not b == c", "*a, = b", "(*a)", "x[*a]", "a.b.c[d](e).f = 1", "def f(a, *, b): ...", "def f(a, /): ...", "def f(/, a): ...", "with a as b: pass", "with a as f(): pass", "while 1: pass\nelse: pass", "try: a\nexcept: b\nelse: c\nfinally: d", "if a: b\nelif c: d\nelse: e", "x: y", "x.y: z = 1", "(x): int", "a, b: int", "raise", "raise a from b", "import a, b.c as d",
]


def accepted(text):
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            ast.parse(text)
        return True
    except (SyntaxError, ValueError):
        return False


def test_peg_needs_all_input_and_tells_the_furthest_failure():
    g = Grammar('a <- "x" ("," "x")* !"y"', {"x": "x", ",": ",", "y": "y"})
    assert g.match("a", "x,x") == (True, 3)
    assert g.match("a", "x,,") == (False, 2)
    assert not g.match("a", "xy")[0]


@pytest.mark.parametrize("text", CASES)
def test_python_as_the_reference_parser(text):
    assert python_source.parse(text).ok == accepted(text)


def test_python_statements():
    assert python_source.parse(GOOD.replace("[*a for a in b] if 0 else []", "[]")).ok
    assert not python_source.parse("x\0").ok


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_python_files_as_the_reference_parser(sf):
    t = pq.read_table(f"/root/testdata/{sf}/src_files.parquet", columns=["path", "content"]).to_pylist()
    for r in t:
        if r["content"] is not None and r["path"].endswith(".py"):
            assert python_source.parse(r["content"]).ok == accepted(r["content"])


C_GOOD = r"""
#ifndef G_H
#define G_H
#include <a.h>
#define M(x) do { x; } while (0)
typedef struct { int a : 3, b; union { char c; } u; } box_t;
enum e { A = 1, B, };
static const unsigned long long int table[] = { [0] = 1, 2, };
struct p q = { .x = 1, .y = { 2, 3 } };
int (*handlers[4])(const char *, int) = { 0 };
extern foo_t *make(foo_t, bar_t *b, ...);
static inline int f(int n, char *argv[], void (*cb)(void *)) __attribute__((unused));
int f(int n, char *argv[], void (*cb)(void *))
{
    int i = 0, *p = &n; foo_t *x = (foo_t *)malloc(sizeof(foo_t) * n);
    for (int j = 0; j < n; j++) if (j % 2) continue; else break;
    do { i--; } while (i > 0);
    switch (n) { case 1: case 2 ... 4: return n ? 1 : 2; default: ; }
    if (!x) goto out; else if (n) { x->y[i]++; } else (*cb)(p), i <<= 2;
    struct p r = (struct p){ 1, 2 }; printf("a" "b%d\n", L'c', 0x1fUL, 1.5e3f, va_arg(ap, int));
out:
    return (n);
}
#if defined(X) && X > 2
broken ( here
#elif 0
#else
int z;
#endif
#endif
"""


def test_c_sources():
    assert c_source.parse(C_GOOD).ok
    for bad in ["int f( { }", "int f(void) { return 1 }", "int f(void) { if (x) { }", "int x = ;", "int f(void) { else x(); }", "struct s { int a }", "#if 1\nint x;", "#endif\n", "int a; }", "def f(x):\n    return x\n", "/* open", 'char *s = "open;\n', "int f(void) { do x(); }", "int f(void) { a b c; }", "=======\n", "int x @ y;", "foo bar baz qux;"]:
        assert not c_source.parse(bad).ok, bad
    for good in ["", "int x;", "#ifdef A\n{\n#else\nint y;\n#endif\n", "void f(void) { while (x); }", "void f(void) { if (a) if (b) c(); else d(); }", "int x; // it's\n", "int f(void)\n{\n#ifdef A\n if (x) {\n#else\n if (y) {\n#endif\n  z(); }\n return 0; }", "x_t y;", "void f(a_t *b) { a_t *c; a * b; (void)c; }"]:
        assert c_source.parse(good).ok, good


@pytest.mark.parametrize("text, value", [("1", True), ("defined(A) || !B", True), ("X > 3", False), ("(1 << 3) == 8 ? 0 : 1", False), ("", None), ("1 +", None), ("FOO(a, b)", False), ("0x10 == 16 && 'a'", True)])
def test_conditions(text, value):
    assert c_source.condition(text) is value


def test_causes_and_rates(spark):
    rows = [
        (1, "r", "a.py", "python", "x = 1"), (2, "r", "b.py", None, "x = (1"), (3, "r", "c.py", "python", "a = 1\n<<<<<<< HEAD\nb = 1\n=======\nb = 2\n>>>>>>> x\n"), (4, "r", "d.py", "c", "int main(void) { return 0; }"), (5, None, "e.c", "c", "int x"),
        (6, "r", "f.h", "c", "import os\n\ndef f():\n    pass\n"), (7, "r", "g.py", "python", None), (8, "r", "h.md", None, "x ="), (9, "r", "i.py", "python", ""), (10, "r", None, "python", "x"), (11, "r", "j.py", "python", "a b c\nx = 1\n"), (11, "r", "j.py", "python", "a b c\nx = 1\n"),
    ]
    df = spark.createDataFrame(rows, "file_id bigint, repo string, path string, lang string, content string")
    checked = source_check.check_files(df)
    got = {r.file_id: (r.valid, r.cause, r.line) for r in checked.collect()}
    assert {k: v[:2] for k, v in got.items()} == {1: (True, None), 2: (False, "truncated"), 3: (False, "merge_conflict"), 4: (False, "wrong_language"), 5: (False, "truncated"), 6: (False, "wrong_language"), 9: (True, None), 11: (False, "syntax")}
    assert got[3][2] == 2
    rates = {(r.repo, r.language): (r.files, r.invalid, r.rate) for r in source_check.invalid_rates(checked).collect()}
    assert rates[("r", "python")] == (7, 5, round(5 / 7, 6)) and rates[(None, "c")] == (1, 1, 1.0)
    assert source_check.check_files(df.limit(0)).count() == 0


def test_deep_nesting_is_reported():
    deep = "(" * 20000 + ")" * 20000
    assert source_check.parse_as("py", deep).why in ("too_deep", "") or not source_check.parse_as("py", deep).ok


INFORMATIVE = ["Fetch ledger in 29 of 657 checkouts", "Returns the sum of both sides.", "Der Pfad sperrt die Regel.", "TODO: write docs\n\nReads each page twice.", ":param log: where the pool writes", "hack around bug 123 in libc", "Fetches the ledger for cold logs."]
TRIVIAL = ["", "  ", "...", "-", "TODO(graph): explain this", "No description.", "Undocumented.", "n/a", "This is the fetch_ledger function", "fetch_ledger(log)", "Fetches the ledger.", "@param log\n@return", "Args:\n  log:\n", "Auto-generated stub.", "Fill in later", "See above.", "placeholder", "Method for fetch ledger.", "----------", "/** @param log */", "nodoc", "Helper to fetch ledger.", "Stuff.", "asdf", "Blah blah.", "Write me.", "Documented elsewhere.", "Does stuff.", "HACK: later"]


def test_informative():
    own = ["fetch_ledger", "log"]
    assert [d for d in INFORMATIVE if not doc_pairs.informative(d, own)] == []
    assert [d for d in TRIVIAL if doc_pairs.informative(d, own)] == []
    assert not doc_pairs.informative(None, own)


def test_pairs():
    py = "class K:\n    def a(self):\n        '''Walks all edges.'''\n        def inner(x):\n            (\"Counts \"\n             'pages.')\n        return inner\n    async def b(self): 'Sends mail.'\n    def c(self):\n        f'No {x}'\n    def d(self):\n        x = 1\n        'late words here'\ns = '''\ndef no():\n    \"Never seen text.\"\n'''\n"
    assert [(d.name, d.line) for d in doc_pairs.pairs_in("py", py)] == [("a", 2), ("inner", 4), ("b", 8)]
    c = "/* Walks all edges. */\nint\na(int x)\n{\n    return x;\n}\n// Counts\n// pages.\nstatic char *b(void) { return 0; }\n/* Gap below. */\n\nint c(void) { return 1; }\n/* A prototype only. */\nint d(void);\nint e; /* not about f */\nint f(void) { return 2; }\n/* Says nothing new: g */\nint g(void) { /* int h(void) { } */ return 3; }\n"
    assert [(d.name, d.line) for d in doc_pairs.pairs_in("c", c)][:2] == [("a", 3), ("b", 9)]
    assert {d.name for d in doc_pairs.pairs_in("c", c)} & {"c", "d", "f", "h"} == set()
    assert doc_pairs.pairs_in("py", "def f(:\n") == []


def test_stock_remarks_are_learned(spark, monkeypatch):
    monkeypatch.setattr(doc_pairs, "STOCK_LEAST", 5)
    remark = "Pending review by the platform group."
    body = lambda n, doc: f'def work_{n}(x):\n    """{doc}"""\n    return x\n\n'
    names = ["alpha", "beta", "gamma", "delta", "omega", "sigma"]
    files = [(i, "a.py", body(n, f"{n.title()}: {remark}" if i % 2 else remark) + body(n + "_more", f"Counts {n} pages of the {i}th ledger twice.")) for i, n in enumerate(names)]
    files += [(100 + i, "copy.py", body("same", "Walks the ledger from its end.")) for i in range(8)] + [(200, "n.py", None)]
    got = [(r.file_id, r.name) for r in doc_pairs.documented_functions(spark.createDataFrame(files, "file_id bigint, path string, content string")).collect()]
    assert sorted(got) == sorted([(i, f"work_{n}_more") for i, n in enumerate(names)] + [(100 + i, "work_same") for i in range(8)])
    assert doc_pairs.documented_functions(spark.createDataFrame([], "file_id bigint, path string, content string")).count() == 0


def test_python_definitions_as_the_reference_parser():
    for r in pq.read_table("/root/testdata/sf0.001/src_files.parquet", columns=["path", "content"]).to_pylist():
        if r["content"] is None or not r["path"].endswith(".py"):
            continue
        mine = python_source.parse(r["content"], definitions=True)
        if mine.ok:
            tree = ast.parse(r["content"])
            want = sorted((n.lineno, n.name, ast.get_docstring(n, clean=False) is not None, n.end_lineno) for n in ast.walk(tree) if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)))
            assert sorted((d.line, d.name, d.doc is not None) for d in mine.definitions) == [w[:3] for w in want]
