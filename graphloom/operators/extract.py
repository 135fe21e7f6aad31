"""Facts from source text: functions, classes, imports, calls, structs, macros, variables, typedefs, field accesses and their uses.

A task only reads tokens: each file gives flat marks in the order of its text
(definitions with what stands in their heads, calls, operands, mentioned names),
tolerant of code that doesn't parse. What a name means is found by Spark: the
methods of a class, types of operands, uses of macros, variables and typedefs
are joins and windows of marks on (file, name). Marks are written once a query.

Cases: null content or another suffix gives no row; a file with brackets or
strings that never close gives one row of kind ``error`` and doesn't disturb the
others (``tolerant`` marks also hold what can be read of it); repeated files each
give theirs; any line ends.
"""

from __future__ import annotations

import keyword
import re
import sys
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.session import cut, spread

FACT = ["file_id", "repo", "path", "kind", "name", "line", "col", "owner", "detail", "items"]
SCHEMA = "file_id bigint, repo string, path string, kind string, name string, line int, col int, owner string, detail string, items array<string>, pos int, within array<int>"


class Mark(NamedTuple):
    """One thing in a text: ``owner`` is the function around it (functions: the return type), ``within`` the places of the classes around it."""

    kind: str
    name: str | None
    line: int
    col: int
    owner: str | None = None
    detail: str | None = None
    items: list[str] | None = None
    pos: int = 0
    within: list[int] | None = None


class _Token(NamedTuple):
    kind: str
    text: str
    line: int
    col: int
    at: int


_STRING = r"""(?:'''(?:[^\\']|\\.|'(?!''))*'''|\"\"\"(?:[^\\"]|\\.|"(?!""))*\"\"\"|'(?:[^'\\\n]|\\.)*'|"(?:[^"\\\n]|\\.)*")"""
_PYTHON = re.compile(rf"(?P<skip>[ \t\f]+|\\\n|#[^\n]*)|(?P<line>\n)|(?P<text>(?i:br|rb|fr|rf|[rbuf])?{_STRING})|(?P<word>[^\W\d]\w*)|(?P<number>\.?\d[\w.]*)|(?P<op>->|\*\*|:=|[-+*/%@&|^=!<>]=|.)", re.DOTALL)
_C = re.compile(r"""(?P<skip>/\*.*?\*/|//[^\n]*|[ \t\f\v]+|\\\n)|(?P<line>\n)|(?P<directive>\#(?:\\\n|[^\n])*)|(?P<text>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')|(?P<word>[^\W\d]\w*)|(?P<number>\.?\d[\w.]*)|(?P<op>->|\.\.\.|[-+*/%&|^<>=!]=?|.)""", re.DOTALL)
_CLOSERS = {")": "(", "]": "[", "}": "{"}


def _tokens(pattern: re.Pattern[str], content: str) -> Iterator[_Token]:
    line, start = 1, 0
    for m in pattern.finditer(content):
        kind, text = m.lastgroup, m.group()
        if kind != "skip":
            yield _Token(kind, text, line, m.start() - start, m.start())
        if "\n" in text:
            line += text.count("\n")
            start = m.start() + text.rfind("\n") + 1


def _open_at_end(tokens: list[_Token]) -> str | None:
    """What never closes: a bracket or a string."""
    stack: list[str] = []
    for t in tokens:
        if t.text in ("(", "[", "{"):
            stack.append(t.text)
        elif t.text in _CLOSERS and (not stack or stack.pop() != _CLOSERS[t.text]):
            return "bracket"
        elif t.kind == "op" and t.text in "\"'":
            return "string"
    return "bracket" if stack else None


def _split(tokens: list[_Token]) -> list[list[_Token]]:
    """Pieces between commas outside brackets."""
    out, depth = [[]], 0
    for t in tokens:
        depth += (t.text in ("(", "[", "{")) - (t.text in _CLOSERS)
        if t.text == "," and not depth:
            out.append([])
        else:
            out[-1].append(t)
    return [x for x in out if x]


def _closing(tokens: list[_Token], i: int) -> int:
    """Place of the bracket that closes the one at a place; the last place without."""
    depth = 0
    for j in range(i, len(tokens)):
        depth += (tokens[j].text in ("(", "[", "{")) - (tokens[j].text in _CLOSERS)
        if not depth:
            return j
    return len(tokens) - 1


# --- Python ---------------------------------------------------------------------------


def _plain_parameters(tokens: list[_Token]) -> list[str]:
    """Names of plain, annotated or defaulted parameters; with both annotation and default, and starred ones, they are left out."""
    out = []
    for piece in _split(tokens):
        depth, marks = 0, set()
        for t in piece:
            depth += (t.text in ("(", "[", "{")) - (t.text in _CLOSERS)
            if not depth and t.text in (":", "="):
                marks.add(t.text)
        if piece[0].kind == "word" and len(marks) < 2:
            out.append(piece[0].text)
    return out


def _imports(tokens: list[_Token]) -> Mark | None:
    """``import`` and ``from`` lines: module, last alias, names."""
    first, words = tokens[0], [t.text for t in tokens]
    alias = next((words[i + 1] for i in range(len(words) - 2, 0, -1) if words[i] == "as"), None)
    if first.text == "import":
        names = [[t.text for t in p] for p in _split(tokens[1:])]
        dotted = lambda p: "".join(p[: p.index("as")] if "as" in p else p)
        return Mark("import", dotted(names[0]), first.line, first.col, None, alias, [dotted(p) for p in names[1:] if "as" in p]) if names else None
    if "import" not in words[1:]:
        return None
    at = words.index("import")
    names = [p[0].text for p in _split([t for t in tokens[at + 1 :] if t.text not in "()"])]
    return Mark("import", "".join(words[1:at]), first.line, first.col, "from", alias, [x for x in names if x != "*"])


def _statements(tokens: list[_Token]) -> Iterator[list[_Token]]:
    """Logical lines; a line that begins with a definition ends whatever was left open before it."""
    own, depth = [], 0
    for t, then in zip(tokens, [*tokens[1:], None]):
        if t.kind == "line":
            if own and (depth <= 0 or then and then.text in ("def", "class", "async")):
                yield own
                own, depth = [], 0
            continue
        depth += (t.text in ("(", "[", "{")) - (t.text in _CLOSERS)
        own.append(t)
    if own:
        yield own


def python_marks(content: str) -> Iterator[Mark]:
    """Functions, docstrings, classes, imports and calls of a Python text."""
    tokens = list(_tokens(_PYTHON, content))
    if why := _open_at_end([t for t in tokens if t.kind != "line"]):
        yield Mark("error", None, 0, 0, None, why)
    yield Mark("size", None, 0, 0, None, str(sum(t.kind != "line" for t in tokens)))
    scopes: list[dict] = []  # open functions and classes: kind, name, indentation, place, indentation of the body
    for own in _statements(tokens):
        head = own[1:] if own[0].text == "async" and len(own) > 1 else own
        indent = own[0].col
        while scopes and indent <= scopes[-1]["indent"]:
            scopes.pop()
        if scopes and scopes[-1]["body"] is None:
            scopes[-1]["body"] = indent
        within = [x["pos"] for x in scopes if x["kind"] == "class"]
        top = scopes[-1] if scopes else None
        if top and top["kind"] == "def" and not top["doc"] and indent == top["body"] and all(t.kind == "text" or t.text in "()" for t in own):
            top["doc"] = True
            yield Mark("docstring", top["name"], top["line"], top["col"], None, _inner_text(own))
        rest, kind = own, head[0].text
        if kind in ("def", "class") and len(head) > 1 and head[1].kind == "word":
            name, first = head[1], own[0]
            opener = next((i for i, t in enumerate(head) if t.text == "("), None) if kind == "def" or (len(head) > 2 and head[2].text in ("(", "[")) else None
            end = _closing(head, opener) if opener is not None else 1
            inside = head[opener + 1 : end] if opener is not None else []
            depth = 0
            for colon in range(end + 1, len(head)):
                depth += (head[colon].text in ("(", "[", "{")) - (head[colon].text in _CLOSERS)
                if head[colon].text == ":" and not depth:
                    break
            else:
                colon = len(head) - 1
            scope = {"kind": kind, "name": name.text, "indent": indent, "pos": first.at, "body": None, "doc": False, "line": first.line, "col": first.col}
            if kind == "def":
                arrow = next((i for i in range(end, colon) if head[i].text == "->"), None)
                returns = content[head[arrow].at + 2 : head[colon].at].strip() if arrow is not None else None
                names = _plain_parameters(inside)
                yield Mark("function", name.text, first.line, first.col, returns, f"{name.text}({', '.join(names)})" + (f" -> {returns}" if returns else ""), names, first.at, within)
                if head[colon + 1 :] and all(t.kind == "text" for t in head[colon + 1 :]):
                    scope["doc"] = True
                    yield Mark("docstring", name.text, first.line, first.col, None, _inner_text(head[colon + 1 :]))
            else:
                bases = ["".join(t.text for t in p) for p in _split(inside) if all(t.kind == "word" or t.text == "." for t in p)]
                yield Mark("class", name.text, first.line, first.col, ",".join(bases) or None, None, None, first.at, within)
            scopes.append(scope)
            rest = head[2:]
        elif kind in ("import", "from"):
            if found := _imports(own):
                yield found
            continue
        caller = next((x["name"] for x in reversed(scopes) if x["kind"] == "def"), "module")
        for i, t in enumerate(rest[:-1]):
            if t.kind == "word" and rest[i + 1].text == "(" and not keyword.iskeyword(t.text):
                yield Mark("call", t.text, t.line, t.col, caller, "method" if i and rest[i - 1].text == "." else "plain", None, t.at)


def _inner_text(tokens: list[_Token]) -> str:
    texts = [re.sub(r"^[A-Za-z]{0,2}", "", t.text) for t in tokens if t.kind == "text"]
    return "".join(x[3:-3] if x[:3] in ("'''", '\"\"\"') and len(x) > 5 else x[1:-1] for x in texts).strip("\"'").strip()


# --- C ------------------------------------------------------------------------------------

_TYPES = frozenset("void char short int long float double signed unsigned bool _Bool".split())
_NOT_CALLS = frozenset("if for while switch return sizeof defined do else case".split())
_STORAGE = frozenset("static extern register auto inline const volatile".split())
_RECORDS = ("struct", "union", "enum")
_NO_NAMES = _TYPES | _STORAGE | _NOT_CALLS | frozenset("break continue goto default typedef struct union enum".split())


def _declared_names(pieces: list[list[_Token]]) -> list[str]:
    """Names of parameters or fields: the last word before a bracket, or that of ``(*name)``."""
    out = []
    for part in pieces:
        text = [x.text for x in part]
        if "(" in text and "*" in text:
            out += [x for x in text[text.index("(") :] if re.fullmatch(r"[^\W\d]\w*", x)][:1]
        else:
            words = [x.text for x in part[: text.index("[") if "[" in text else len(part)] if x.kind == "word"]
            if len(words) > 1 or (words and words[0] not in _TYPES and "*" in text):
                out.append(words[-1])
    return [x for x in out if x not in _TYPES]


def _fields(tokens: list[_Token]) -> list[list[_Token]]:
    out, depth = [[]], 0
    for t in tokens:
        depth += (t.text in ("(", "{")) - (t.text in (")", "}"))
        if t.text == ";" and not depth:
            out.append([])
        else:
            out[-1].append(t)
    return [x for x in out if x]


def _typedef(tokens: list[_Token]) -> Mark | None:
    """A typedef that isn't one of a record: its name and what it stands for."""
    words = [x for x in tokens[1:] if x.kind == "word"]
    if not words:
        return None
    pointer = next((i for i in range(len(tokens) - 2) if tokens[i].text == "(" and tokens[i + 1].text == "*" and tokens[i + 2].kind == "word"), None)
    name = tokens[pointer + 2] if pointer is not None else words[-1]
    before = [x.text for x in words if x.at < name.at]
    return Mark("typedef", name.text, tokens[0].line, tokens[0].col, None, " ".join(before) or "unknown", None, tokens[0].at)


def c_marks(content: str) -> Iterator[Mark]:
    """Functions and prototypes, records, includes, typedefs, object macros, variables, calls, field accesses and mentioned names of a C text."""
    every = [t for t in _tokens(_C, content) if t.kind != "line"]
    tokens = [t for t in every if t.kind != "directive"]
    if why := _open_at_end(tokens):
        yield Mark("error", None, 0, 0, None, why)
    yield Mark("size", None, 0, 0, None, str(len(every)))
    for d in every:
        if d.kind == "directive" and not content[d.at - d.col : d.at].strip():
            if m := re.match(r'#\s*include\s+"([^"\n]+)"', d.text):
                yield Mark("import", m[1], d.line, d.col, None, None, ["local"])
            elif m := re.match(r"#\s*define\s+([^\W\d]\w*)(?!\()(?:[ \t]+(.*))?$", d.text, re.DOTALL):
                yield Mark("macro", m[1], d.line, d.col, None, (m[2] or "").strip() or None)
    function, depth, i, n = None, 0, 0, len(tokens)
    text = lambda k: tokens[k].text if 0 <= k < n else ""
    while i < n:
        t = tokens[i]
        depth += (t.text == "{") - (t.text == "}")
        if t.text == "}" and depth <= 0:
            function, depth = None, 0
        word, before, after = t.kind == "word", text(i - 1), text(i + 1)
        if t.text in _RECORDS:
            name = text(i + 1) if i + 1 < n and tokens[i + 1].kind == "word" else None
            body = i + 1 + (name is not None)
            if text(body) == "{":
                end = _closing(tokens, body)
                fields = _declared_names(_fields(tokens[body + 1 : end])) if t.text != "enum" else []
                if name is None and before == "typedef":
                    name = text(end + 1) or None
                if name:
                    yield Mark("struct", name, t.line, t.col, None, t.text, fields, t.at)
                i = end + 1
                continue
            if name:  # named without a body
                yield Mark("struct_reference", name, t.line, t.col, function, t.text, [], t.at)
            i += 1
            continue
        if t.text == "typedef" and after not in _RECORDS:
            end = next((j for j in range(i, n) if tokens[j].text == ";"), n - 1)
            if found := _typedef(tokens[i:end]):
                yield found
            i = end + 1
            continue
        if word and after == "(" and depth == 0 and t.text not in _NOT_CALLS and i and (tokens[i - 1].kind == "word" or before == "*"):
            end = _closing(tokens, i + 1)
            if text(end + 1) in ("{", ";"):
                inside = _split(tokens[i + 2 : end])
                names = _declared_names(inside)
                prototype = text(end + 1) == ";"
                returns = before + (" *" if before == "*" else "") if before in _TYPES else None
                yield Mark("function", t.text, t.line, t.col, returns, f"{t.text}({', '.join(names)})" + (";" if prototype else ""), names, t.at)
                function = None if prototype else t.text
                for piece in inside:  # types of pointer parameters
                    for a, b, c in zip(piece, piece[1:], piece[2:]):
                        if b.text == "*" and a.kind == c.kind == "word":
                            yield Mark("declared", c.text, c.line, c.col, t.text, a.text, None, c.at)
                i = end + 1
                continue
        if word and after == "(" and depth > 0 and t.text not in _NOT_CALLS | _TYPES:
            yield Mark("call", t.text, t.line, t.col, function or "module", "method" if before in (".", "->") else "plain", None, t.at)
        elif t.text == "(" and text(i + 1) == "*" and text(i + 3) == ")" and text(i + 4) == "(" and depth > 0 and tokens[i + 2].kind == "word":
            yield Mark("call", text(i + 2), t.line, t.col, function or "module", "plain", None, t.at)
        elif word and before in (".", "->"):
            if i > 1 and tokens[i - 2].kind == "word" and text(i - 3) not in (".", "->"):
                yield Mark("field_access", t.text, t.line, t.col, function, "direct" if before == "." else "pointer", [text(i - 2)], t.at)
        elif word:
            statement = i - 1
            while statement >= 0 and (tokens[statement].text == "*" or tokens[statement].kind == "word"):
                statement -= 1
            words = [x.text for x in tokens[statement + 1 : i]]
            starts = statement < 0 or tokens[statement].text in (";", "{", "}")
            if after in (";", "[") and starts and words and words[0] not in ("return", "goto", "else", "case", "*") and t.text not in _TYPES and before not in ("break", "continue"):
                plain = [w for w in words if w not in _STORAGE]
                yield Mark("variable", t.text, t.line, t.col, function, " ".join(plain), ["global" if function is None else "local", *(w for w in words if w in _STORAGE)], t.at)
                yield Mark("declared", t.text, t.line, t.col, function, next((w for w in reversed(plain) if w != "*"), ""), None, t.at)
            elif t.text not in _NO_NAMES:
                yield Mark("mention", t.text, t.line, t.col, function, None, None, t.at)
        i += 1


# --- in Spark -------------------------------------------------------------------------------


def file_marks(src_files: DataFrame, tolerant: bool = False) -> DataFrame:
    """Marks of each file with content in a known language; of files with errors only the error, unless ``tolerant``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for file_id, repo, path, content in zip(frame["file_id"], frame["repo"], frame["path"], frame["content"]):
                content = content.replace("\r\n", "\n").replace("\r", "\n")
                found = list((python_marks if path.endswith(".py") else c_marks)(content))
                if found[0].kind == "error" and not tolerant:
                    found = found[:1]
                rows += [(file_id, repo, path, *m) for m in found]
            yield pd.DataFrame(rows, columns=["file_id", "repo", "path", *Mark._fields])

    files = src_files.filter(F.col("content").isNotNull() & F.col("path").rlike(r"\.(py|c|h)$")).select(F.col("file_id").cast("bigint").alias("file_id"), "repo", "path", "content")
    return spread(files).mapInPandas(run, SCHEMA)


def with_methods(marks: DataFrame) -> DataFrame:
    """Class facts with the names of all functions inside, in order."""
    inside = marks.filter("kind = 'function'").select("file_id", "path", F.explode("within").alias("pos"), F.struct(F.col("pos").alias("p"), "name").alias("f"))
    methods = inside.groupBy("file_id", "path", "pos").agg(F.transform(F.array_sort(F.collect_set("f")), lambda f: f["name"]).alias("methods"))  # one class of one file
    classes = marks.filter("kind = 'class'").join(methods, ["file_id", "path", "pos"], "left")
    return classes.withColumn("items", F.coalesce("methods", F.array().cast("array<string>"))).select(*FACT)


def outside_stdlib(marks: DataFrame, stdlib: frozenset[str]) -> DataFrame:
    """Imports without those of the standard library (by the first segment); relative ones stay."""
    python = F.col("path").endswith(".py")
    known = F.split("name", r"\.")[0].isin(*sorted(stdlib)) | ((F.col("name") == "__future__") & F.col("owner").isNotNull())
    return marks.filter("kind = 'import'").filter(~python | ~known).withColumn("owner", F.lit(None).cast("string")).select(*FACT)


def typed_accesses(marks: DataFrame) -> DataFrame:
    """Field accesses with the operand's type: of its declarations in the file the last, else the operand itself."""
    types = marks.filter("kind = 'declared'").groupBy("file_id", F.col("name").alias("operand")).agg(F.max_by("detail", "pos").alias("type"))
    accesses = marks.filter("kind = 'field_access'").withColumn("operand", F.col("items")[0])
    typed = accesses.join(types, ["file_id", "operand"], "left").withColumn("owner", F.coalesce(F.when(F.col("type") != "", F.col("type")), F.col("operand")))
    return typed.withColumn("items", F.lit(None).cast("array<string>")).select(*FACT)


def used_names(marks: DataFrame) -> DataFrame:
    """Uses of the file's own macros, else variables, else typedefs.

    Of the variables of a name the function's own comes first, then the file's,
    then any (``detail``: local, global, other).
    """
    mentions = marks.filter("kind = 'mention'")
    macros = marks.filter("kind = 'macro'").select("file_id", "name", F.lit(True).alias("macro")).distinct()
    typedefs = marks.filter("kind = 'typedef'").select("file_id", "name", F.lit(True).alias("typedef")).distinct()
    variables = marks.filter("kind = 'variable'")
    own = variables.filter("owner is not null").select("file_id", "name", "owner", F.lit(True).alias("local")).distinct()
    scopes = variables.groupBy("file_id", "name").agg(F.max(F.col("owner").isNull()).alias("global"))
    found = mentions.join(macros, ["file_id", "name"], "left").join(scopes, ["file_id", "name"], "left").join(own, ["file_id", "name", "owner"], "left").join(typedefs, ["file_id", "name"], "left")
    kind = F.when(F.col("macro"), "macro_usage").when(F.col("global").isNotNull(), "variable_usage").when(F.col("typedef"), "typedef_usage")
    scope = F.when(F.col("local"), "local").when(F.col("global"), "global").otherwise("other")
    return found.withColumn("kind", kind).filter("kind is not null").withColumn("detail", F.when(F.col("kind") == "variable_usage", scope)).select(*FACT)


def records(marks: DataFrame) -> DataFrame:
    """Structs, unions and enums: those with a body, and names that only are referred to, once a file (without fields)."""
    with_body = marks.filter("kind = 'struct'")
    named = marks.filter("kind = 'struct_reference'").join(with_body.select("file_id", "name"), ["file_id", "name"], "left_anti")
    first = named.withColumn("rn", F.row_number().over(Window.partitionBy("file_id", "name").orderBy("pos"))).filter("rn = 1").withColumn("kind", F.lit("struct")).withColumn("owner", F.lit(None).cast("string"))
    return with_body.select(*FACT).unionByName(first.select(*FACT))


def extract_facts(src_files: DataFrame, stdlib: frozenset[str] = frozenset(sys.stdlib_module_names)) -> DataFrame:
    """All facts of each file (``stdlib``: packages whose imports are left out), from marks that are written once."""
    marks = cut(file_marks(src_files))
    plain = marks.filter(F.col("kind").isin("function", "docstring", "call", "macro", "variable", "typedef", "error")).select(*FACT)
    out = plain.unionByName(with_methods(marks)).unionByName(outside_stdlib(marks, stdlib)).unionByName(typed_accesses(marks))
    return out.unionByName(used_names(marks)).unionByName(records(marks))
