"""Python 3.13 source: token classes, grammar, and the parse of one file.

The grammar works on two levels, so that equal statements are parsed once for
all files: a logical line is parsed as a string of token classes and reduced to
one symbol (simple statement, ``if`` header, ...); the symbols of a block are
parsed as a string again, innermost blocks first, and reduced to one symbol.
Both levels need full consumption; results are remembered by string.
"""

from __future__ import annotations

import keyword
import re
import unicodedata
from dataclasses import dataclass, field
from itertools import accumulate

from graphloom.llm.peg import Grammar, Remembered

_OPS = "** // >> << != == <= >= -> := ... += -= *= /= //= %= &= |= ^= >>= <<= **= @= ( ) [ ] { } , : . ; @ = + - * / % & | ^ ~ < >".split()
_SOFT = ["match", "case", "type", "_"]
_WORDS = [*keyword.kwlist, *_SOFT, *_OPS]
#: Class characters: single-character operators stand for themselves, other words get private-use characters.
CLASSES: dict[str, str] = {w: (w if len(w) == 1 and w != "_" else chr(0xE000 + i)) for i, w in enumerate(_WORDS)}
CLASSES |= {
    "NAME": "n" + "".join(CLASSES[w] for w in _SOFT),
    "NUMBER": "0",
    "STR": "s",
    "BYTES": "b",
    "AUG": "".join(CLASSES[w] for w in "+= -= *= /= //= %= &= |= ^= >>= <<= **= @=".split()),
    "BIN": "".join(CLASSES[w] for w in "+ - * / // % @ ** & | ^ << >>".split()),
    "SIGN": "+-~",
    "CMP": "".join(CLASSES[w] for w in "< > == != <= >=".split()),
    "CONST": "".join(CLASSES[w] for w in ("None", "True", "False", "...")),
    "!": "!",
    "FSTART": "\x05",
    "FEND": "\x06",
}
#: Brackets and indentations that Python's tokenizer takes at most (fixed values).
MOST_BRACKETS, MOST_INDENTS = 200, 99

LINE_GRAMMAR = r"""
simple_line <- simple (";" simple)* ";"? END
simple <- assignment / expr_stmt / keyword_stmt
expr_stmt <- star_exprs &stop
stop <- ";" / END
keyword_stmt <- "return" star_exprs? / "pass" / "break" / "continue" / "raise" (expr ("from" expr)?)? / "del" del_targets / "assert" expr ("," expr)? / ("global" / "nonlocal") NAME ("," NAME)* / yield_expr / import_stmt / "type" NAME type_params? "=" expr
import_stmt <- "import" dotted_as ("," dotted_as)* / "from" ("." / "...")* dotted "import" import_names / "from" ("." / "...")+ "import" import_names
dotted <- NAME ("." NAME)*
dotted_as <- dotted ("as" NAME)?
import_names <- "*" / "(" name_as ("," name_as)* ","? ")" / name_as ("," name_as)*
name_as <- NAME ("as" NAME)?
assignment <- NAME ":" expr ("=" rhs)? / ("(" single_target ")" / place) ":" expr ("=" rhs)? / (star_targets "=" !"=")+ rhs !"=" !AUG / single_target AUG rhs
rhs <- yield_expr / star_exprs
single_target <- place / NAME / "(" single_target ")"
place <- atom (trailer &trailer)* ("." NAME / "[" slices "]") !trailer
star_targets <- star_target ("," star_target)* ","?
star_target <- "*" !"*" star_target / target
target <- place / target_atom !trailer
target_atom <- NAME / "(" star_targets? ")" / "[" star_targets? "]"
del_targets <- del_target ("," del_target)* ","?
del_target <- place / NAME / "(" del_targets? ")" / "[" del_targets? "]"
star_exprs <- star_expr ("," star_expr)* ","?
star_expr <- "*" bits / expr
named <- NAME ":=" expr / expr !":="
expr <- lambda / logic ("if" logic "else" expr)?
lambda <- "lambda" lparams? ":" expr
logic <- inversion (("and" / "or") inversion)*
inversion <- "not" inversion / comparison
comparison <- bits ((CMP / "not" "in" / "in" / "is" "not" / "is") bits)*
bits <- unary (BIN unary)*
unary <- SIGN* primary
primary <- "await"? atom trailer*
trailer <- "." NAME / "(" args? ")" / "[" slices "]"
args <- named for_ifs / positional ("," keywords)? ","? / keywords ","?
positional <- pos_arg ("," pos_arg)*
pos_arg <- "*" expr / named !"="
keywords <- key_or_star ("," key_or_star)* ("," key_or_double)* / key_or_double ("," key_or_double)*
key_or_star <- NAME "=" expr / "*" expr
key_or_double <- NAME "=" expr / "**" expr
slices <- slice ("," slice)* ","?
slice <- expr? ":" expr? (":" expr?)? / named / "*" bits
atom <- NAME / NUMBER / (STR / fstring)+ !BYTES / BYTES+ !STR !FSTART / CONST / group / list / braces
fstring <- FSTART field* FEND
field <- "{" (yield_expr / !"lambda" star_exprs) "="? ("!" NAME)? (":" field*)? "}"
group <- "(" ")" / "(" yield_expr ")" / "(" named for_ifs ")" / "(" named ")" / "(" star_named "," (star_named ("," star_named)* ","?)? ")"
list <- "[" "]" / "[" named for_ifs "]" / "[" star_named ("," star_named)* ","? "]"
star_named <- "*" bits / named
braces <- "{" "}" / "{" pair for_ifs "}" / "{" item ("," item)* ","? "}" / "{" named for_ifs "}" / "{" star_named ("," star_named)* ","? "}"
pair <- expr ":" expr
item <- "**" bits / pair
for_ifs <- ("async"? "for" star_targets "in" logic ("if" logic)*)+
yield_expr <- "yield" "from" expr / "yield" star_exprs?
params <- pos_params ("," star_params)? ","? / star_params ","?
pos_params <- plain ("," (plain / "/"))* ("," (default / "/"))* / default ("," (default / "/"))*
star_params <- "*" NAME star_note? ("," either)* ("," double)? / "*" ("," either)+ ("," double)? / double
plain <- NAME note? !"="
default <- NAME note? "=" expr
either <- NAME note? ("=" expr)?
double <- "**" NAME note?
note <- ":" expr
star_note <- ":" star_expr
lparams <- lpos ("," lstar)? ","? / lstar ","?
lpos <- lplain ("," (lplain / "/"))* ("," (ldefault / "/"))* / ldefault ("," (ldefault / "/"))*
lstar <- "*" NAME ("," leither)* ("," ldouble)? / "*" ("," leither)+ ("," ldouble)? / ldouble
lplain <- NAME !"="
ldefault <- NAME "=" expr
leither <- NAME ("=" expr)?
ldouble <- "**" NAME
type_params <- "[" type_param ("," type_param)* ","? "]"
type_param <- ("*" / "**")? NAME (":" expr)? ("=" star_expr)?
if_head <- "if" named ":"
elif_head <- "elif" named ":"
else_head <- "else" ":"
while_head <- "while" named ":"
for_head <- "async"? "for" star_targets "in" star_exprs ":"
try_head <- "try" ":"
except_head <- "except" (expr ("as" NAME)?)? ":"
group_head <- "except" "*" expr ("as" NAME)? ":"
finally_head <- "finally" ":"
with_head <- "async"? "with" ("(" with_item ("," with_item)* ","? ")" ":" / with_item ("," with_item)* ":")
with_item <- expr "as" star_target &("," / ")" / ":") / expr
def_head <- "async"? "def" NAME type_params? "(" params? ")" ("->" expr)? ":"
class_head <- "class" NAME type_params? ("(" args? ")")? ":"
decorator <- "@" named
match_head <- "match" subject ":"
subject <- star_named "," (star_named ("," star_named)* ","?)? / named
case_head <- "case" patterns ("if" named)? ":"
patterns <- star_pattern ("," star_pattern)* ","?
star_pattern <- "*" NAME / pattern
pattern <- closed ("|" closed)* ("as" NAME)?
closed <- literal / class_pattern / "(" patterns? ")" / "[" patterns? "]" / "{" map_items? "}"
literal <- "-"? NUMBER (SIGN NUMBER)? / STR+ / BYTES+ / CONST
class_pattern <- dotted ("(" (pattern_arg ("," pattern_arg)* ","?)? ")")?
pattern_arg <- NAME "=" pattern / pattern
map_items <- map_item ("," map_item)* ","?
map_item <- "**" NAME / (literal / dotted) ":" pattern
"""

#: Line symbols: the header rules in the order they are tried.
HEADERS = {
    "def_head": "D", "if_head": "I", "elif_head": "E", "else_head": "L", "while_head": "W", "for_head": "F", "try_head": "T", "group_head": "Y", "except_head": "X",
    "finally_head": "N", "with_head": "H", "class_head": "K", "match_head": "M", "case_head": "C",
}

BLOCK_GRAMMAR = r"""
block <- stmt+ END
module <- stmt* END
cases <- ("C" "B")+ END
stmt <- "s" / "I" "B" ("E" "B")* ("L" "B")? / "W" "B" ("L" "B")? / "F" "B" ("L" "B")? / "T" "B" (("X" "B")+ ("L" "B")? ("N" "B")? / ("Y" "B")+ ("L" "B")? ("N" "B")? / "N" "B") / "H" "B" / "@"* ("D" / "K") "B" / "M" "c"
"""

_LINES = Grammar(LINE_GRAMMAR, CLASSES)
_BLOCKS = Grammar(BLOCK_GRAMMAR, {c: c for c in "sIELWFTXYNHDKMCB@c"})


def _too_deep(kinds: str) -> int:
    """Place of the bracket that is one too many, 0 without."""
    if sum(map(kinds.count, "([{")) > MOST_BRACKETS:
        for i, depth in enumerate(accumulate((k in "([{") - (k in ")]}") for k in kinds)):
            if depth > MOST_BRACKETS:
                return i
    return 0


def _line(kinds: str) -> tuple[str, int]:
    """Symbols of a logical line, '' if it doesn't parse; the furthest failure."""
    if deep := _too_deep(kinds):
        return "", deep
    ok, far = _LINES.match("simple_line", kinds)
    if ok:
        return "s", 0
    if kinds[0] == "@":
        ok, at = _LINES.match("decorator", kinds)
        return ("@", 0) if ok else ("", max(far, at))
    for rule, symbol in HEADERS.items():
        end = _LINES.prefix(rule, kinds)
        if symbol == "D" and end > 0:
            DEF_ENDS[kinds] = end
        if end == len(kinds):
            return symbol, 0
        if end > 0:
            ok, at = _LINES.match("simple_line", kinds[end:])
            if ok:
                return symbol + "B", 0
            far = max(far, end + at)
        else:
            far = max(far, _LINES.match(rule, kinds)[1])
    return "", far


def _block(symbols: str) -> tuple[str, int]:
    ok, far = _BLOCKS.match("block", symbols)
    if ok:
        return "B", 0
    ok, at = _BLOCKS.match("cases", symbols)
    return ("c", 0) if ok else ("", max(far, at))


LINES = Remembered(_line)
BLOCKS = Remembered(_block)
MODULES = Remembered(lambda s: _BLOCKS.match("module", s))
DEF_ENDS = Remembered(lambda s: _LINES.prefix("def_head", s))

_STRING_BODY = r"""(?:'''(?:[^\\']|\\.|'(?!''))*'''|\"\"\"(?:[^\\"]|\\.|"(?!""))*\"\"\"|'(?:[^\\'\n]|\\.)*'|"(?:[^\\"\n]|\\.)*")"""
_MASTER = re.compile(
    r"[ \t\f]*(?:(\n[ \t\f]*|\#[^\n]*|\\\n|(?i:br|rb|fr|rf|[rbuf])?" + _STRING_BODY + r"|[^\W\d]\w*"
    r"|(?:0[xX][\da-fA-F_]+|0[oObB]\w+|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?[jJ]?)(?:(?=(?:and|else|for|if|in|is|not|or)\b)|\w*)"
    r"|\*\*=?|//=?|>>=?|<<=?|\.\.\.|->|:=|[!=<>+\-*/%&|^@]=|[()\[\]{},:.;@=+\-*/%&|^~<>]|[^\s]|\Z)|\s)",
    re.DOTALL,
)
_DIGITS = r"\d(?:_?\d)*"
_NUMBER = re.compile(
    rf"0[xX](?:_?[\da-fA-F])+|0[oO](?:_?[0-7])+|0[bB](?:_?[01])+|(?:0(?:_?0)*|[1-9](?:_?\d)*)[jJ]?|{_DIGITS}[jJ]|(?:{_DIGITS}\.(?:{_DIGITS})?|\.{_DIGITS})(?:[eE][+-]?{_DIGITS})?[jJ]?|{_DIGITS}[eE][+-]?{_DIGITS}[jJ]?"
)
_BAD, _SKIP, _BLANK = "\x01", "\x02", "\x03"
_FIXED = {w: CLASSES[w] for w in _WORDS} | {"": _BLANK}
_UNSEEN = frozenset(_SKIP + _BLANK + "\n")
_WORD_KINDS = frozenset(CLASSES["NAME"] + CLASSES["CONST"])


def _kind(token: str) -> str:
    c = token[0]
    if c == "\n":
        return "\n"
    if c == "#" or token == "\\\n":
        return _SKIP
    if c.isdigit() or (c == "." and token[1:2].isdigit()):
        return "0" if _NUMBER.fullmatch(token) else _BAD
    if token[-1] in "\"'" and len(token) > 1:
        head = token[: min(token.find(q) for q in "\"'" if q in token)].lower()
        if "f" in head:
            end, kinds = _lex_fstring(token, 0)
            return "s" if end == len(token) and _LINES.match("fstring", kinds)[0] else _BAD
        plain = "r" in head or "\\" not in token or _escapes_ok(token, "b" in head)
        if "b" in head:
            return "b" if plain and token.isascii() else _BAD
        return "s" if plain else _BAD
    return "n" if token.isidentifier() else _BAD


_ESCAPE = re.compile(r"\\(?:x[\da-fA-F]{2}|(?:u|U00(?:0[\da-fA-F]|10))[\da-fA-F]{4}|N\{([^{}]+)\}|(x)|([uUN])|.)", re.DOTALL)


def _escapes_ok(text: str, of_bytes: bool = False) -> bool:
    """Whether all escapes of a literal are whole and name a character."""
    for m in _ESCAPE.finditer(text):
        if m[2] or m[3] and not of_bytes:
            return False
        if m[1] and not of_bytes:
            try:
                if len(unicodedata.lookup(m[1])) > 1:
                    return False
            except KeyError:
                return False
    return True


_F_START = re.compile(r"([fF][rR]?|[rR][fF])(\"\"\"|\'\'\'|[\"\'])")
_F_TEXT = re.compile(r"[^\\{}\n\"\']+")
_CONVERSION, _BLANK_END = re.compile(r"[sra](?!\w)"), re.compile(r"\s*(?=\})")
#: Formatted strings in each other, and fields in the format of a field, that Python takes at most (fixed values).
MOST_FSTRINGS, MOST_FIELDS = 149, 3


def _lex_fstring(text: str, at: int) -> tuple[int, str]:
    """Where the formatted string at an offset ends (-1: it doesn't), and the classes of its fields' tokens.

    Fields hold any expression, with the same quotes and further formatted
    strings; what is open is a list, so nesting needs no stack.
    """
    kinds: list[str] = []
    # open parts: [quote, raw, is a format, fields around it, start of its current text] or the open brackets of a field
    modes: list[list] = []
    strings, i, n = 0, at, len(text)
    while True:
        if not modes or isinstance(modes[-1], _Field):
            m = _F_START.match(text, i)
            if m:
                strings += 1
                if strings > MOST_FSTRINGS:
                    return -1, ""
                modes.append([m[2], "r" in m[1].lower(), False, 0, m.end()])
                kinds.append("\x05")
                i = m.end()
                continue
            field = modes[-1]
            m = _MASTER.match(text, i)
            token = m.group(1)
            if token is None or not token:
                if m.end() >= n:
                    return -1, ""
                i = m.end()
                continue
            start = m.start(1)
            if token[0] in "fFrR" and start > i and _F_START.match(text, start):
                i = start
                continue
            if not field and token[0] == ":":
                kinds.append(":")
                outer = next(x for x in reversed(modes) if not isinstance(x, _Field))
                modes.append([outer[0], outer[1], True, outer[3] + 1, start + 1])
                i = start + 1
                continue
            i = m.end()
            if not field and token == "!":
                m = _CONVERSION.match(text, i)
                if not m:
                    return -1, ""
                kinds += ["!", "n"]
                i = m.end()
                continue
            kind = TOKENS[token]
            if kind == _BAD:
                return -1, ""
            if kind in _UNSEEN:
                continue
            if not field and token == "}":
                modes.pop()
                modes[-1][4] = i
            elif token in "([{":
                field.append(token)
            elif token in ")]}" and (not field or field.pop() != {")": "(", "]": "[", "}": "{"}[token]):
                return -1, ""
            kinds.append(kind)
            continue
        quote, raw, is_format, fields, begun = modes[-1]
        if m := _F_TEXT.match(text, i):
            i = m.end()
        if i >= n:
            return -1, ""
        c = text[i]
        ends = text.startswith(quote, i)
        if c == "\\":
            if text[i + 1 : i + 2] in ("{", "}"):
                i += 1
            elif not raw and text.startswith("\\N{", i):
                i = text.find("}", i) + 1
                if not i:
                    return -1, ""
            else:
                i += 2
        elif c in "{}" and not is_format and text[i + 1 : i + 2] == c:
            i += 2
        elif c in "{}" or ends or c == "\n" and len(quote) == 1:
            if not raw and not _escapes_ok(text[begun:i].replace("\\{", "").replace("\\}", "")):
                return -1, ""
            if c == "{":
                if fields >= MOST_FIELDS:
                    return -1, ""
                modes.append(_Field())
                kinds.append("{")
                i += 1
            elif c == "}":
                if not is_format:
                    return -1, ""
                modes.pop()
                modes.pop()
                modes[-1][4] = i + 1
                kinds.append("}")
                i += 1
            elif ends and not is_format:
                modes.pop()
                strings -= 1
                kinds.append("\x06")
                i += len(quote)
                if not modes:
                    return i, "".join(kinds)
            elif is_format and not ends and text[begun - 1] == ":" and (m := _BLANK_END.match(text, i)):
                i = m.end()
            else:
                return -1, ""
        else:
            i += 1


class _Field(list):
    """Open brackets of a replacement field."""


def _exact_tokens(text: str) -> tuple[list[str], list[int]]:
    """Tokens and their offsets, with formatted strings of any content as one token each."""
    tokens, starts, at = [], [], 0
    while True:
        m = _MASTER.match(text, at)
        token, start = m.group(1) or "", m.start(1) if m.group(1) is not None else m.start()
        end = _lex_fstring(text, start)[0] if _F_START.match(text, start) else -1
        tokens.append(text[start:end] if end > 0 else token)
        starts.append(start)
        at = end if end > 0 else m.end()
        if m.end() >= len(text) and not token:
            return tokens, starts


class _Tokens(Remembered):
    def __missing__(self, token: str) -> str:
        kind = _FIXED.get(token) or _kind(token)
        return self.keep(token, kind) if len(token) < 40 and kind != _SKIP else kind


TOKENS = _Tokens(_kind)


@dataclass
class Definition:
    """A function or method: line and name of its header, the header's words, its documentation, its first and last line."""

    name: str
    line: int
    header: list[str]
    doc: str | None = None
    first: int = 0
    last: int = 0


@dataclass
class Parsed:
    """Outcome of one file: where it failed furthest (line, column; 0 if it parses), at its end or not, and its definitions."""

    ok: bool
    line: int = 0
    column: int = 0
    at_end: bool = False
    why: str = ""
    definitions: list[Definition] = field(default_factory=list)


def never_closed(text: str, at: int) -> bool:
    """Whether a string or comment that opens at an offset runs to the end of the text."""
    if text[at] in "\"'" and (text[at - 2 : at + 1] == text[at] * 3 or text[at : at + 3] == text[at] * 3):
        return True
    return (text[at] in "\"'" and "\n" not in text[at:].rstrip()) or text[at : at + 2] == "/*"


def _place(text: str, index: int) -> tuple[int, int, bool]:
    """Line and column of the token with an index; whether nothing but blanks follows."""
    tokens, starts = _exact_tokens(text)
    if index >= len(starts):
        return text.count("\n") + 1, len(text) - text.rfind("\n"), True
    at = starts[index]
    return text.count("\n", 0, at) + 1, at - text.rfind("\n", 0, at), never_closed(text, at) or not text[at + len(tokens[index]) :].strip()


def _columns(indent: str) -> tuple[int, int]:
    """Width of an indentation with tabs to multiples of 8, and with tabs as one."""
    wide = 0
    for c in indent:
        wide = (wide // 8 + 1) * 8 if c == "\t" else 0 if c == "\f" else wide + 1
    return wide, len(indent)


def _documentation(tokens: list[str]) -> str | None:
    """Text of adjacent string tokens; none if one of them is formatted."""
    if any("f" in t[: min(t.find(q) for q in "\"'" if q in t)].lower() for t in tokens):
        return None
    return "".join(map(_string_text, tokens))


def _string_text(token: str) -> str:
    at = min(token.find(q) for q in "\"'" if q in token)
    body = token[at:]
    return body[3:-3] if body[:3] in ("'''", '"""') and len(body) >= 6 else body[1:-1]


def _segment(kinds: str) -> tuple[str, int]:
    """Classes of a physical line without comments and blanks; by how much it opens brackets."""
    plain = kinds.replace(_SKIP, "").replace(_BLANK, "")
    return plain, sum(map(plain.count, "([{")) - sum(map(plain.count, ")]}"))


SEGMENTS = Remembered(_segment)


def parse(text: str, definitions: bool = False) -> Parsed:
    """Parse one file; ``definitions`` also keeps functions with their documentation."""
    if "\0" in text:
        at = text.index("\0")
        return Parsed(False, text.count("\n", 0, at) + 1, at - text.rfind("\n", 0, at), False, "null byte")
    if text[:1] == "﻿":
        text = text[1:]
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    tokens = _MASTER.findall(text)
    kinds = "".join(map(TOKENS.__getitem__, tokens))  # one class a token
    if _BAD in kinds and _F_START.search(text):  # fields may hold what looks like the string's end
        tokens = _exact_tokens(text)[0]
        kinds = "".join(map(TOKENS.__getitem__, tokens))
    tokens.append("\n")
    kinds += "\n"
    levels: list[list[str]] = [[]]  # symbols of the open blocks
    starts: list[list[int]] = [[]]  # token index of each symbol
    indents = [(0, 0)]
    own, begin, depth, at = "", 0, 0, 0
    segments, line_of = SEGMENTS, LINES
    end = len(tokens)
    lines = list(accumulate((t.count("\n") for t in tokens), initial=1)) if definitions else []
    out: list[Definition] = []
    waiting: Definition | None = None
    running: list[tuple[int, Definition]] = []  # definitions whose block isn't closed, with their indentation
    last_line = 1

    def token_at(n: int) -> int:
        """Index of the logical line's n-th token; of the end of the text if it has fewer."""
        for i in range(begin, end):
            if kinds[i] not in _UNSEEN:
                if not n:
                    return i
                n -= 1
        return end

    def failed(index: int, why: str) -> Parsed:
        row, column, last = _place(text, index)
        if why == "block" and not last:  # a header with nothing but comments below
            rest = text.split("\n")[row:]
            last = all(not x.strip() or x.lstrip().startswith("#") for x in rest)
        return Parsed(False, row, column, last, why)

    def close(to: int, then: int) -> int:
        """Reduce blocks until ``to`` levels are open; index of the failing token (``then`` if the block lacks something) or -1."""
        while len(levels) > to:
            symbols, places = "".join(levels.pop()), starts.pop()
            indents.pop()
            symbol, far = BLOCKS[symbols]
            if not symbol:
                return places[far] if far < len(places) else then
            levels[-1].append(symbol)
            starts[-1].append(places[0])
        return -1

    for segment in kinds.split("\n"):
        here, at = at, at + len(segment) + 1
        if not segment:
            continue
        plain, opened = segments[segment]
        if not plain:
            continue
        if depth > 0:
            own += plain
        else:
            own, begin, depth = plain, here, 0
        depth += opened
        if depth > 0 and at < end:
            continue
        symbols, far = line_of[own]
        if not symbols:
            index = token_at(far)
            return failed(index if far < len(own) or depth > 0 or at >= end else token_at(len(own) - 1), "statement")
        indent = tokens[begin - 1][1:] if begin else text[: len(text) - len(text.lstrip(" \t\f"))]
        width = (0, 0) if not indent else _columns(indent)
        if width != indents[-1]:
            if width[0] > indents[-1][0] and width[1] > indents[-1][1]:
                if len(indents) > MOST_INDENTS:
                    return failed(token_at(0), "indentation")
                levels.append([])
                starts.append([])
                indents.append(width)
            elif width in indents:
                bad = close(indents.index(width) + 1, begin)
                if bad >= 0:
                    return failed(bad, "block")
            else:
                return failed(token_at(0), "indentation")
        levels[-1].extend(symbols)
        starts[-1].extend([begin] * len(symbols))
        if definitions:
            while running and width[0] <= running[-1][0]:
                running.pop()[1].last = last_line
            last_line = lines[at - 1]
            if waiting is not None:
                head = own.partition(";")[0]
                if symbols == "s" and "s" in head and head.strip("s()") == "":
                    waiting.doc = _documentation([tokens[token_at(n)] for n, k in enumerate(head) if k == "s"])
                waiting = None
            if symbols[0] == "D":
                colon = DEF_ENDS[own]
                seen = [i for i in range(begin, at) if kinds[i] not in _UNSEEN]
                name = seen[2 if own[0] == CLASSES["async"] else 1]
                waiting = Definition(tokens[name], lines[name], [tokens[i] for k, i in zip(own[:colon], seen) if k in _WORD_KINDS])
                waiting.first = lines[seen[0]]
                running.append((width[0], waiting))
                out.append(waiting)
                if len(symbols) == 2:
                    head = own[colon:].partition(";")[0]
                    if "s" in head and head.strip("s()") == "":
                        waiting.doc = _documentation([tokens[i] for k, i in zip(head, seen[colon:]) if k == "s"])
                    waiting = None
    if depth > 0:
        return failed(token_at(line_of[own][1]), "statement")
    for _, open_definition in running:
        open_definition.last = last_line
    bad = close(1, end)
    if bad >= 0:
        return failed(bad, "block")
    symbols = "".join(levels[0])
    ok, far = MODULES[symbols]
    if not ok:
        return failed(starts[0][far] if far < len(starts[0]) else end, "block")
    return Parsed(True, definitions=out)
