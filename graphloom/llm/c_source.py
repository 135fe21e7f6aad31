"""C source: token classes, grammar, and the parse of one file.

As for Python the grammar works on levels, and equal pieces are parsed once for
all files. Braces are reduced from the inside: the text between two braces is
cut into pieces that end with ``;`` or a brace block; each piece is parsed as a
string of token classes and reduced to symbols (open ``if``, loop, complete
statement, ...), and the symbols of a block are parsed again, which pairs ``else``
with ``if`` and ``while`` with ``do``. Braces of data (struct and enum bodies,
initializers) are parsed as one string. Unknown names may be types or values.

Conditional directives are honoured with all macros undefined; other directives
are only checked for their form. Macros aren't expanded.
"""

from __future__ import annotations

import re

from graphloom.llm.peg import Grammar, Remembered
from graphloom.llm.python_source import Definition, Parsed, never_closed

_OPS = "... <<= >>= -> ++ -- << >> <= >= == != && || += -= *= /= %= &= ^= |= ( ) [ ] { } , : ; . ? = + - * / % & | ^ ~ ! < >".split()
_KEYWORDS = "if else while do for switch case default break continue return goto sizeof typedef struct union enum static _Generic _Static_assert static_assert asm __asm__ __asm __attribute__ __declspec _Alignas alignas typeof __typeof__ _Alignof alignof __alignof__".split()
#: Type words by class.
_TYPES = {w: c for c, words in {"t": "void _Bool _Imaginary _Float128 _Decimal64", "c": "char", "h": "short", "i": "int", "l": "long", "g": "signed unsigned __signed__", "f": "float", "d": "double", "x": "_Complex", "I": "__int128"}.items() for w in words.split()}
#: Type words that go together, in any order (fixed values of the language; sorted classes).
_TYPE_SETS = frozenset("".join(sorted(x)) for x in "t c cg h gh hi ghi i g gi l gl il gil ll gll ill gill f d dl x fx dx dlx ix cx lx llx hx gx I Ig".split())
_QUALIFIERS = "const volatile restrict extern register auto inline _Noreturn _Thread_local thread_local constexpr _Atomic __inline __inline__ __restrict __restrict__ __const __volatile__ __extension__ __thread noreturn".split()
CLASSES: dict[str, str] = {w: (w if len(w) == 1 else chr(0xE000 + i)) for i, w in enumerate([*_KEYWORDS, *_OPS])}
#: Symbols of reduced braces: a block, and data by what it can be (bits: struct body, enum body, initializer).
BLOCK = "B"
DATA = {bits: chr(0xF000 + bits) for bits in range(1, 8)}
CLASSES |= {
    "NAME": "n",
    "NUMBER": "0",
    "STR": "s",
    "TYPE": "".join(dict.fromkeys(_TYPES.values())),
    "QUAL": "q" + CLASSES["static"] + CLASSES["typedef"],
    "SU": CLASSES["struct"] + CLASSES["union"],
    "ATTR": "".join(CLASSES[w] for w in "__attribute__ __declspec _Alignas alignas".split()),
    "TYPEOF": "".join(CLASSES[w] for w in "typeof __typeof__".split()),
    "ASM": "".join(CLASSES[w] for w in "asm __asm__ __asm".split()),
    "ASSERT": "".join(CLASSES[w] for w in "_Static_assert static_assert".split()),
    "ALIGNOF": "".join(CLASSES[w] for w in "_Alignof alignof __alignof__".split()),
    "ASSIGN": "".join(CLASSES[w] for w in "= += -= *= /= %= &= ^= |= <<= >>=".split()),
    "BIN": "".join(CLASSES[w] for w in "+ - * / % & | ^ << >> < > <= >= == != && ||".split()),
    "UNARY": "&*+-~!",
    "BLOCK": BLOCK,
    "STRUCTBODY": "".join(c for b, c in DATA.items() if b & 1),
    "ENUMBODY": "".join(c for b, c in DATA.items() if b & 2),
    "INITBODY": "".join(c for b, c in DATA.items() if b & 4),
}

GRAMMAR = r"""
external <- function / declaration END / ";" END / ASSERT "(" args ")" ";" END / ASM asm_rest ";" END
function <- specs declarator attr* old_decl* BLOCK END / declarator attr* old_decl* BLOCK END
old_function <- specs declarator old_decl+ END / declarator old_decl+ END
old_decl <- specs declarator ("," declarator)* ";"
declaration <- specs (init_decl ("," init_decl)*)? ";"
specs <- qual* (TYPE (TYPE / qual)* / SU attr* (NAME? STRUCTBODY / NAME) qual* / "enum" attr* (NAME? (":" specs)? ENUMBODY / NAME) qual* / TYPEOF "(" (type_name / expr) ")" qual* / NAME qual*)
qual <- QUAL / attr
attr <- ATTR "(" any_args? ")" / "[" "[" any_args? "]" "]"
any_args <- (any_item / ",")+
any_item <- NAME / NUMBER / STR / QUAL / TYPE / "(" any_args? ")" / BIN / UNARY / "." / ":" / "="
declarator <- pointer* direct
pointer <- "*" qual*
direct <- (NAME / "(" attr* declarator ")") suffix*
suffix <- "[" (qual / "static")* (expr / "*")? "]" / "(" params? ")" / attr
params <- param ("," param)* ("," "...")? / "..."
param <- specs (declarator / abstract)? attr* / declarator
abstract <- pointer+ abstract_direct? / abstract_direct
abstract_direct <- ("(" abstract ")" / abstract_suffix) abstract_suffix*
abstract_suffix <- "[" (qual / "static")* (expr / "*")? "]" / "(" params? ")"
init_decl <- declarator (ASM asm_rest)? attr* ("=" initializer)?
initializer <- INITBODY / assign
type_name <- specs abstract?
struct_body <- member* END
member <- specs (struct_decl ("," struct_decl)*)? ";" / ";" / ASSERT "(" args ")" ";"
struct_decl <- declarator? ":" cond attr* / declarator attr*
enum_body <- enumerator ("," enumerator)* ","? END
enumerator <- NAME attr* ("=" cond)?
init_body <- (init_item ("," init_item)* ","?)? END
init_item <- (("[" cond ("..." cond)? "]" / "." NAME)+ "=" / NAME ":")? initializer
expr <- assign ("," assign)*
assign <- unary ASSIGN (INITBODY / assign) / cond
cond <- binary ("?" expr? ":" cond)?
binary <- cast (BIN cast)*
cast <- "(" type_name ")" (INITBODY postfix* / cast) / unary
unary <- ("++" / "--") unary / UNARY cast / "sizeof" ("(" type_name ")" !INITBODY / unary) / ALIGNOF "(" type_name ")" / "&&" NAME / primary postfix*
postfix <- "[" expr "]" / "(" args? ")" / "." NAME / "->" NAME / "++" / "--"
primary <- STR (STR / NAME)* / NAME STR* / NUMBER / "(" BLOCK ")" / "(" expr ")" / "(" type_name ")" INITBODY / "_Generic" "(" assign ("," (type_name / "default") ":" assign)+ ")"
args <- arg ("," arg)*
arg <- assign &("," / ")") / type_name
asm_rest <- (QUAL / "goto")* "(" asm_items ")"
asm_items <- (STR / ":" / "," / "[" NAME "]" / "(" expr ")" / NAME)*
if_head <- "if" "(" expr ")"
while_head <- "while" "(" expr ")"
switch_head <- "switch" "(" expr ")"
for_head <- "for" "(" (declaration / expr? ";") expr? ";" expr? ")"
case_head <- "case" cond ("..." cond)? ":"
default_head <- "default" ":"
label_head <- NAME ":" attr*
else_head <- "else"
do_head <- "do"
core <- core_statement END
core_statement <- ";" / BLOCK / jump / expr ";" / declaration / ASM asm_rest ";" / ASSERT "(" args ")" ";" / attr+ ";"
jump <- ("break" / "continue") ";" / "return" (expr / INITBODY)? ";" / "goto" ("*" cast / NAME) ";"
"""
BLOCK_GRAMMAR = r"""
block <- stmt* END
stmt <- "f" stmt ("e" stmt)? / "w" stmt / "l" stmt / "d" stmt "W" / "s" / "W"
"""
#: Headers before a statement and their symbols.
HEADERS = {
    CLASSES["if"]: ("if_head", "f"), CLASSES["while"]: ("while_head", "w"), CLASSES["for"]: ("for_head", "w"), CLASSES["switch"]: ("switch_head", "w"),
    CLASSES["else"]: ("else_head", "e"), CLASSES["do"]: ("do_head", "d"), CLASSES["case"]: ("case_head", "l"), CLASSES["default"]: ("default_head", "l"), "n": ("label_head", "l"),
}

_PIECES = Grammar(GRAMMAR, CLASSES)
_BLOCKS = Grammar(BLOCK_GRAMMAR, {c: c for c in "fwldesW"})


_TYPE_RUN = re.compile(f"[{re.escape(CLASSES['TYPE'] + CLASSES['QUAL'])}]+")
_NO_TYPE = str.maketrans(dict.fromkeys(CLASSES["QUAL"], ""))


def _types_clash(kinds: str) -> int:
    """Place of type words that don't go together (``int int``), -1 without."""
    for m in _TYPE_RUN.finditer(kinds):
        words = m.group().translate(_NO_TYPE)
        if len(words) > 1 and "".join(sorted(words)) not in _TYPE_SETS:
            return m.end() - 1
    return -1


def _external(kinds: str) -> tuple[str, int]:
    """'F' for a function definition, 's' for another external declaration, 'o' for the head of one in the old style so far, '' for none; furthest failure."""
    if (clash := _types_clash(kinds)) >= 0:
        return "", clash
    if kinds[-1] == BLOCK and _PIECES.match("function", kinds)[0]:
        return "F", 0
    ok, far = _PIECES.match("external", kinds)
    if not ok and kinds[-1] == ";" and _PIECES.match("old_function", kinds)[0]:
        return "o", 0
    return ("s", 0) if ok else ("", far)


def _piece(kinds: str) -> tuple[str, int]:
    """Symbols of a piece of a block: its headers and the statement after them."""
    if (clash := _types_clash(kinds)) >= 0:
        return "", clash
    out, i = "", 0
    while i < len(kinds) and (head := HEADERS.get(kinds[i])):
        end = _PIECES.prefix(head[0], kinds, i)
        if end < 0:
            if kinds[i] == "n":
                break
            return "", _PIECES.match(head[0], kinds[i:])[1] + i
        out, i = out + head[1], end
    rest = kinds[i:]
    if not rest:  # labels at the end of a block
        return (out + "s", 0) if out.endswith("l") else ("", i)
    if out == "w" and rest == ";" and kinds[0] == CLASSES["while"]:
        return "W", 0
    ok, far = _PIECES.match("core", rest)
    return (out + "s", 0) if ok else ("", i + far)


def _data(kinds: str) -> tuple[str, int]:
    """Symbol of data braces by what their inner text can be."""
    results = [_PIECES.match(rule, kinds) for rule in ("struct_body", "enum_body", "init_body")]
    bits = sum(1 << n for n, (ok, _) in enumerate(results) if ok)
    return (DATA[bits], 0) if bits else ("", max(far for _, far in results))


EXTERNALS = Remembered(_external)
PIECES = Remembered(_piece)
DATA_BRACES = Remembered(_data)
BLOCKS = Remembered(lambda s: _BLOCKS.match("block", s))

_MASTER = re.compile(
    r"[ \t\f\v]*(?:(\n|//(?:\\\n|[^\n])*|/\*.*?\*/|/\*|\#(?:\\\n|/\*.*?\*/|//[^\n]*|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|[^\n])*"
    r"|(?:u8|[uUL])?\"(?:[^\"\\\n]|\\.)*\"|(?:u8|[uUL])?'(?:[^'\\\n]|\\.)+'"
    r"|[^\W\d][\w$]*|\.?\d(?:[eEpP][+-]|'?[\w.])*"
    r"|\.\.\.|<<=|>>=|->|\+\+|--|<<|>>|&&|\|\||[-+*/%&^|<>=!]=|[()\[\]{},:;.?=+\-*/%&|^~!<>]|\\\n|[^\s]|\Z)|\s)",
    re.DOTALL,
)
_NUMBER = re.compile(
    r"(?:0[xX](?:[\da-fA-F]'?)+|0[bB](?:[01]'?)+|0(?:'?[0-7])*|[1-9](?:'?\d)*)(?:[uU](?:ll|LL|[lLzZ]|wb|WB)?|(?:ll|LL|[lLzZ]|wb|WB)[uU]?)?|(?:\d(?:'?\d)*\.\d*|\.\d+|\d(?:'?\d)*\.)(?:[eE][+-]?\d+)?[fFlLdDqQiIjJ]*\d*x?|\d(?:'?\d)*[eE][+-]?\d+[fFlLdDqQiIjJ]*"
    r"|0[xX](?:[\da-fA-F]*\.?[\da-fA-F]*)[pP][+-]?\d+[fFlL]*"
)
_FIXED = {w: CLASSES[w] for w in [*_KEYWORDS, *_OPS]} | _TYPES | dict.fromkeys(_QUALIFIERS, "q") | {"": "\x03", "<:": "["}
_WORD_KINDS = frozenset("n" + CLASSES["TYPE"] + CLASSES["SU"])
_BAD_ESCAPE = re.compile(r"\\(?:x(?![\da-fA-F])|u(?![\da-fA-F]{4})|U(?![\da-fA-F]{8})|[\\\"'])")
_BAD, _SKIP, _HASH = "\x01", "\x02", "\x04"
_SPECIAL = frozenset("([{)]};\n" + _SKIP + _HASH)


def _kind(token: str) -> str:
    c = token[0]
    if c == "#":
        return _HASH
    if token[:2] in ("//", "\\\n") or (token[:2] == "/*" and len(token) > 3):
        return _SKIP
    if c.isdigit() or (c == "." and len(token) > 1):
        return "0" if _NUMBER.fullmatch(token) else _BAD
    if token[-1] in "\"'" and len(token) > 1:
        if "\\" in token and any(m.group()[1] in "xuU" for m in _BAD_ESCAPE.finditer(token)):
            return _BAD
        return "s" if token[-1] == '"' else "0"
    if c == "_" or c.isalpha():
        return "n"
    return "\n" if c == "\n" else _BAD


class _Tokens(Remembered):
    def __missing__(self, token: str) -> str:
        kind = _FIXED.get(token) or _kind(token)
        return self.keep(token, kind) if len(token) < 40 and kind not in (_SKIP, _HASH) else kind


TOKENS = _Tokens(_kind)
_DIRECTIVE = re.compile(r"#[ \t]*(\w*)[ \t]*(.*)", re.DOTALL)
_PLAIN = frozenset("include define undef line error pragma warning ident sccs import include_next embed assert unassert".split()) | {""}
_EXPR = re.compile(r"\s*(?:(defined)\b\s*(?:\(\s*\w+\s*\)|\w+)|(__has_\w+\s*\([^)]*\))|(0[xX][\da-fA-F]+|\d+)[uUlL]*|('(?:\\.|[^'\\])+')|([^\W\d]\w*)(?:\s*\([^()]*\))?|(&&|\|\||[=!<>]=|<<|>>|[-+*/%&|^~!<>?:(),]))")
_LEVELS = [["||"], ["&&"], ["|"], ["^"], ["&"], ["==", "!="], ["<", ">", "<=", ">="], ["<<", ">>"], ["+", "-"], ["*", "/", "%"]]


def condition(text: str) -> bool | None:
    """Value of an ``#if`` expression with all macros undefined; None if it isn't one."""
    text = re.sub(r"/\*.*?\*/|//[^\n]*|\\\n", " ", text, flags=re.DOTALL)
    items: list[int | str] = []
    at = 0
    text = text.rstrip()
    while at < len(text):
        m = _EXPR.match(text, at)
        if not m:
            return None
        at = m.end()
        if m[1] or m[2] or m[5]:
            items.append(0)
        elif m[3]:
            items.append(int(m[3], 16 if m[3][:2].lower() == "0x" else 8 if m[3][0] == "0" and m[3].isdigit() and set(m[3]) <= set("01234567") else 10))
        elif m[4]:
            items.append(ord(m[4][-2]))
        else:
            items.append(m[6])
    # innermost parentheses first: open ones are a list, so depth needs no stack
    levels: list[list[int | str]] = [[]]
    try:
        for item in items:
            if item == "(":
                levels.append([])
            elif item == ")":
                value = _value(levels.pop())
                levels[-1].append(value)
            else:
                levels[-1].append(item)
        return bool(_value(levels[0])) if len(levels) == 1 else None
    except (ValueError, IndexError):
        return None


def _value(items: list[int | str]) -> int:
    """Value of an expression without parentheses: signs, then binary levels, then ``? :``."""
    out: list[int | str] = []
    for at in range(len(items) - 1, -1, -1):
        x = items[at]
        if x in ("!", "~") or x in ("-", "+") and (at == 0 or isinstance(items[at - 1], str)):
            if not out or isinstance(out[-1], str):
                raise ValueError
            v = out.pop()
            x = {"!": int(not v), "-": -v, "+": v, "~": ~v}[x]
        elif isinstance(x, int) and out and isinstance(out[-1], int):
            raise ValueError
        out.append(x)
    out.reverse()
    for ops in reversed(_LEVELS):
        folded: list[int | str] = []
        at = 0
        while at < len(out):
            if out[at] in ops and isinstance(out[at], str):
                if not folded or isinstance(folded[-1], str) or at + 1 >= len(out) or isinstance(out[at + 1], str):
                    raise ValueError
                folded.append(_binary(out[at], folded.pop(), out[at + 1]))
                at += 2
            else:
                folded.append(out[at])
                at += 1
        out = folded
    # what is left is v or v ? v : v ? ..., nested in any way: reduce v ? v : v from the right
    stack: list[int | str] = []
    for x in reversed(out):
        stack.append(x)
        while len(stack) >= 5 and isinstance(stack[-1], int) and stack[-2] == "?" and isinstance(stack[-3], int) and stack[-4] == ":" and isinstance(stack[-5], int):
            test, yes, no = stack[-1], stack[-3], stack[-5]
            del stack[-5:]
            stack.append(yes if test else no)
    if len(stack) != 1 or not isinstance(stack[0], int):
        raise ValueError
    return stack[0]


def _binary(op: str, x: int, y: int) -> int:
    if op in ("/", "%"):
        return 0 if y == 0 else (x // y if op == "/" else x % y)
    if op in ("<<", ">>"):
        return (x << min(y, 64) if op == "<<" else x >> min(y, 64)) if y >= 0 else 0
    if op in ("&&", "||"):
        return int(bool(x and y)) if op == "&&" else int(bool(x or y))
    return int({"|": x | y, "^": x ^ y, "&": x & y, "==": x == y, "!=": x != y, "<": x < y, ">": x > y, "<=": x <= y, ">=": x >= y, "+": x + y, "-": x - y, "*": x * y}[op])


class _Frame:
    """Text between two braces: the current piece, the symbols so far, open parentheses."""

    __slots__ = ("block", "depth", "kinds", "opened", "symbols", "tops", "where")

    def __init__(self, block: bool, opened: int) -> None:
        self.block, self.opened = block, opened
        self.kinds: list[str] = []
        self.where: list[int] = []
        self.symbols: list[str] = []
        self.tops: list[int] = []
        self.depth = 0


_PAREN_STEP = {"(": 1, "[": 1, ")": -1, "]": -1}


def _is_block(frame: _Frame, outer: bool) -> bool:
    """Whether a brace that opens after the frame's current piece is a block."""
    kinds = frame.kinds
    last = kinds[-1] if kinds else ""
    if frame.depth:
        return last == "("
    if outer:
        return last in (")", ";") or (last == "n" and len(kinds) > 1 and kinds[-2] == ")")
    if not frame.block:
        return False
    if not kinds:
        return True
    if last in (CLASSES["else"], CLASSES["do"], ":"):
        return True
    return last == ")" and CLASSES["return"] not in kinds and not any(k in CLASSES["ASSIGN"] for k in _outer_kinds(kinds))


def _outer_kinds(kinds: list[str]) -> list[str]:
    out, depth = [], 0
    for k in kinds:
        depth += _PAREN_STEP.get(k, 0)
        if not depth:
            out.append(k)
    return out


def parse(text: str, definitions: bool = False) -> Parsed:
    """Parse one file; ``definitions`` also keeps functions with the comment that ends directly above."""
    if "\0" in text:
        at = text.index("\0")
        return Parsed(False, text.count("\n", 0, at) + 1, at - text.rfind("\n", 0, at), False, "null byte")
    if text[:1] == "﻿":
        text = text[1:]
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    tokens = _MASTER.findall(text)
    kind_of = TOKENS
    frames = [_Frame(False, 0)]
    frame = frames[0]
    conditions: list[list] = []  # [active now, was active, else seen, outer active]
    active, fresh, line = True, True, 1
    lines: dict[int, int] = {}
    comments: dict[int, tuple[int, str, bool]] = {}  # last line -> (first line, text, line comment)
    out: list[Definition] = []
    first_line = 0

    def failed(index: int, why: str) -> Parsed:
        for n, m in enumerate(_MASTER.finditer(text)):
            if n == index:
                at = m.start(1) if m.group(1) is not None else m.start()
                return Parsed(False, text.count("\n", 0, at) + 1, at - text.rfind("\n", 0, at), never_closed(text, at) or not text[m.end() :].strip(), why)
        return Parsed(False, text.count("\n") + 1, len(text) - text.rfind("\n"), True, why)

    def end_piece(f: _Frame, index: int) -> int:
        """Parse and reduce the current piece; index of the failing token or -1."""
        own = "".join(f.kinds)
        symbols, far = (PIECES if f.block else EXTERNALS)[own]
        if not symbols:
            return f.where[far] if far < len(f.where) else index
        if symbols == "o":  # parameters are declared up to the block
            return -1
        if symbols == "F" and definitions:
            name = _function_name(own)
            words = [tokens[w] for k, w in zip(own, f.where) if k in _WORD_KINDS]
            out.append(Definition(tokens[f.where[name]], lines[f.where[name]], words, _comment_above(comments, first_line), first_line, line))
        if f.block:
            f.symbols.append(symbols)
            f.tops.extend([f.where[0]] * len(symbols))
        f.kinds, f.where = [], []
        return -1

    for index, token in enumerate(tokens):
        kind = kind_of[token]
        if kind not in _SPECIAL:
            if kind == "\x03" or not active:
                continue
            fresh = False
            if kind == _BAD:
                return failed(index, "character")
            if definitions and frame is frames[0]:
                if not frame.kinds:
                    first_line = line
                lines[index] = line
            frame.kinds.append(kind)
            frame.where.append(index)
            if kind == "s" and "\n" in token:
                line += token.count("\n")
            continue
        if kind == "\n":
            line += 1
            fresh = True
            continue
        if kind == _SKIP:
            if definitions and active and token[0] == "/":
                _note_comment(comments, line, token, fresh)
            line += token.count("\n")
            continue
        if kind == _HASH:
            if not fresh:
                if active:
                    return failed(index, "character")
                line += token.count("\n")
                continue
            word, rest = _DIRECTIVE.fullmatch(token).groups()
            line += token.count("\n")
            if word in ("if", "ifdef", "ifndef"):
                if not active:
                    conditions.append([False, True, False, False])
                    continue
                value = condition(rest) if word == "if" else (word == "ifndef") if re.match(r"\w", rest) else None
                if value is None:
                    return failed(index, "directive")
                conditions.append([value, value, False, True])
                active = value
            elif word in ("elif", "elifdef", "elifndef", "else"):
                if not conditions or conditions[-1][2]:
                    return failed(index, "directive")
                top = conditions[-1]
                if word == "else":
                    value, top[2] = True, True
                elif top[1] or not top[3]:
                    value = False
                else:
                    value = condition(rest) if word == "elif" else word == "elifndef"
                    if value is None:
                        return failed(index, "directive")
                top[0] = bool(value) and not top[1] and top[3]
                top[1] = top[1] or top[0]
                active = top[0]
            elif word == "endif":
                if not conditions:
                    return failed(index, "directive")
                active = conditions.pop()[3]
            elif active and (word not in _PLAIN or (word in ("define", "undef") and not re.match(r"\w", rest)) or (word == "include" and not re.match(r'"[^"\n]+"|<[^>\n]+>|[^\W\d]', rest))):
                return failed(index, "directive")
            continue
        if not active:
            continue
        fresh = False
        if definitions and frame is frames[0]:
            if not frame.kinds:
                first_line = line
            lines[index] = line
        if kind == "{":
            block = _is_block(frame, frame is frames[0])
            frame = _Frame(block, index)
            frames.append(frame)
            continue
        if kind == "}":
            if len(frames) == 1 or frame.depth:
                return failed(index, "block")
            if frame.block:
                if frame.kinds and (bad := end_piece(frame, index)) >= 0:
                    return failed(bad, "statement")
                symbols = "".join(frame.symbols)
                ok, far = BLOCKS[symbols]
                if not ok:
                    return failed(frame.tops[far] if far < len(frame.tops) else index, "block")
                symbol = BLOCK
            else:
                symbol, far = DATA_BRACES["".join(frame.kinds)]
                if not symbol:
                    return failed(frame.where[far] if far < len(frame.where) else index, "data")
            opened, block = frame.opened, frame.block
            frames.pop()
            frame = frames[-1]
            frame.kinds.append(symbol)
            frame.where.append(opened)
            if block and not frame.depth and (frame.block or frame is frames[0]) and (bad := end_piece(frame, index)) >= 0:
                return failed(bad, "statement")
            continue
        frame.kinds.append(kind)
        frame.where.append(index)
        if kind == ";":
            if not frame.depth and (frame.block or frame is frames[0]) and (bad := end_piece(frame, index)) >= 0:
                return failed(bad, "statement")
            continue
        frame.depth += _PAREN_STEP[kind]
        if frame.depth < 0:
            return failed(index, "statement")
    if len(frames) > 1:
        return failed(len(tokens), "block")
    if frame.kinds:
        own = "".join(frame.kinds)
        far = EXTERNALS[own][1]
        return failed(frame.where[far] if far < len(frame.where) else len(tokens), "statement")
    if conditions:
        return failed(len(tokens), "directive")
    return Parsed(True, definitions=out)


def _name_at(kinds: str) -> int:
    """Place of the function's name: the name before its first parameter list."""
    for i, k in enumerate(kinds):
        if k == "n" and kinds[i + 1 : i + 2] == "(" and (i == 0 or kinds[i - 1] not in CLASSES["ATTR"] + CLASSES["TYPEOF"]):
            return i
    return max((i for i, k in enumerate(kinds) if k == "n"), default=0)


_NAMES = Remembered(_name_at)


def _function_name(kinds: str) -> int:
    return _NAMES[kinds]


def _note_comment(comments: dict[int, tuple[int, str, bool]], line: int, token: str, alone: bool) -> None:
    """Keep a comment by its last line; line comments on adjacent lines are one comment."""
    if not alone:
        return
    single = token[:2] == "//"
    first, text = line, token
    if single and (above := comments.get(line - 1)) and above[2]:
        first, text = above[0], above[1] + "\n" + token
    comments[line + token.count("\n")] = (first, text, single)


def _comment_above(comments: dict[int, tuple[int, str, bool]], line: int) -> str | None:
    found = comments.get(line - 1)
    return found[1] if found else None
