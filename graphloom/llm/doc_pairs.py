"""Functions paired with their documentation (problem 5).

The grammars of ``source_check`` keep source offsets; their semantic actions emit
each function or method definition with its documentation: in Python the
docstring, in C the comment that ends on the line directly above. Pairs whose
documentation says nothing beyond the definition's own words are dropped: by
stand-in remarks and filler words that are known beforehand, and by the corpus,
where the same remark at many functions of different names is a stock remark.

Cases: files that don't parse, have null content or another suffix give none;
definitions in strings, comments and inactive conditional branches are none;
missing, blank or purely decorative documentation gives none; repeated files
each give theirs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.python_source import Definition
from graphloom.llm.source_check import SUFFIX, parse_as
from graphloom.session import cut, small_side, spread

_WORD = re.compile(r"[A-Z]+(?![a-zäöüß])|[A-ZÄÖÜ]?[a-zäöüß]+|\d+|[^\W\d_a-zA-Z]+")
#: Remarks that stand in for documentation (fixed values).
STAND_INS = re.compile(
    r"\b(?:(?:to\s?do|fix\s?me|xxx|hack(?=\s*(?:[(:!.]|$))|tbd|tba|wip)\b(?:\([^)]*\))?[^\n]*(?:\n(?![ \t]*\n)[^\n]*)*"
    r"|no\s+(?:doc\w*|description|comment)s?(?:\s+(?:yet|available|provided|given|needed))*|un-?documented|not\s+(?:yet\s+)?documented|no-?docs?|n\s*/\s*a\b|none|nothing|place-?holder|stub"
    r"|auto-?(?:matically\s+)?generated(?:\s+(?:stub|code|docstring|doc|documentation|comment|method|function))*|generated\s+(?:stub|code|docstring)|fill\s+(?:this\s+)?in(?:\s+later)?|see\s+(?:above|below|base\s+class|parent|super\w*|header|caller\w*|source|code)"
    r"|(?:add|write|insert|missing|needs?|put)\s+(?:a\s+|the\s+|some\s+)?(?:docs?\b|docstrings?|documentation|descriptions?|comments?|summary)(?:\s+(?:here|for\s+this(?:\s+\w+)?|later))*|documentation(?:\s+(?:missing|pending|goes\s+here|to\s+come|needed))+|docstrings?(?:\s+(?:missing|pending|goes\s+here))*"
    r"|(?:write|document|describe)\s+me\b|documented\s+(?:elsewhere|later|below|above)"
    r"|description(?:\s+(?:missing|pending|goes\s+here|here|of\s+(?:the\s+)?(?:function|method)))*|explain\s+(?:this|what\s+(?:this|it)\s+does)|describe\s+(?:this|what\s+(?:this|it)\s+does)|self-?explanatory|inherit(?:ed|doc)?|same\s+as\s+above|work\s+in\s+progress|coming\s+soon|later|lorem\s+ipsum[^\n]*)",
    re.IGNORECASE,
)
#: Words that carry nothing on their own (fixed values).
FILLERS = frozenset(
    "a an the this that it its is are be does do did of to for and or with in on by from at as into function functions func fn method methods procedure routine helper helpers utility util wrapper implementation implements implement internal me stuff thing things something elsewhere"
    " member callback handler return returns returned returning param params parameter parameters arg args argument arguments kwargs keyword keywords type types rtype raise raises raised yield yields throw throws brief details note notes see summary desc description"
    " short long self cls value values result results input inputs output outputs init initialise initialize initializer constructor construct ctor destructor dunder main simple simply just basic generic default used use uses using define defines definition"
    " performs perform performing executes execute call calls called calling given here name named code void none null int char double float bool str string struct static const unsigned".split()
)
#: A remark up to so many letters is stock if what it says beyond the function's own words stands at this share of all documented
#: functions, and at least at so many, each time of another name.
STOCK_LENGTH, STOCK_SHARE, STOCK_LEAST = 200, 0.0005, 20
#: Different new words that say something; one is enough in a sentence of so many words (``asdf`` or ``Does things.`` says nothing).
LEAST_WORDS, SENTENCE = 2, 4
#: Every stand-in holds one of these (in lower case, blanks made single).
_TRIGGERS = (
    "todo", "to do", " me", "elsewhere", "above", "below", "fixme", "fix me", "xxx", "hack", "tbd", "tba", "wip", "no ", "doc", "n/a", "n /", "n/ a", "none", "nothing", "place", "stub", "generated", "fill", "see ", "add ",
    "write ", "insert", "missing", "need", "put ", "descri", "explain", "self", "inherit", "same as", "work in", "coming", "later", "lorem",
)
_TAGGED = re.compile(r"[@\\:]\w")
_TAGS = re.compile(r"[@\\:](?:param|arg|type|return|returns|rtype|brief|raises?|throws?|retval|note|see|short|details|fn|file|class|method|func|def)\b:?(?:\s*\[\w+\])?", re.IGNORECASE)
_SUFFIXES = ("ations", "ation", "izing", "ising", "ings", "ing", "ies", "ied", "ers", "er", "ors", "or", "es", "ed", "s", "e", "y")


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    """Word without the endings of its forms (``copies``, ``copys`` and ``copy`` agree)."""
    for _ in range(2):
        for s in _SUFFIXES:
            if word.endswith(s) and len(word) - len(s) >= 3:
                word = word[: -len(s)]
                if len(word) > 3 and word[-1] == word[-2] and word[-1] not in "sl":
                    word = word[:-1]
                break
    return word


def words_of(text: str) -> list[str]:
    """Lower-case words; identifiers come apart at underscores and capitals."""
    return [w.lower() for w in _WORD.findall(text)]


def _plain(doc: str) -> str:
    """Documentation without comment signs and tags."""
    text = re.sub(r"^[ \t]*(?:/\*+!?|\*+/|//+!?|\*+|#+)|\*+/[ \t]*$", " ", doc, flags=re.MULTILINE)
    return _TAGS.sub(" ", text) if _TAGGED.search(text) else text


def _own_words(own: list[str]) -> set[str]:
    return {stem(w) for o in own for w in words_of(o)} | {o.lower() for o in own}


def informative(doc: str | None, own: list[str]) -> bool:
    """Whether documentation says something beyond the definition's own words and stand-in remarks."""
    if not doc:
        return False
    text = _plain(doc)
    low = " ".join(text.lower().split())
    if any(t in low for t in _TRIGGERS):
        text = STAND_INS.sub(" ", text)
    known = _own_words(own)
    new: set[str] = set()
    tokens = re.findall(r"\w+", text)
    for token in tokens:
        if token.lower() in known or token.lower() in FILLERS:
            continue
        for w in words_of(token):
            if w not in FILLERS and stem(w) not in known and w not in known and (len(w) > 1 or not w.isascii()):
                new.add(w)
                if len(new) >= LEAST_WORDS or len(tokens) >= SENTENCE:
                    return True
    return False


def remainder(doc: str, own: list[str]) -> str:
    """What documentation says without the definition's own words, as one key: short remarks for different functions that agree in it are stock."""
    known = _own_words(own)
    return " ".join(w for w in words_of(_plain(doc)) if stem(w) not in known and w not in known)


def pairs_in(suffix: str, content: str) -> list[Definition]:
    """Definitions of a valid file whose documentation is informative."""
    found = parse_as(suffix, content, definitions=True)
    return [d for d in found.definitions if informative(d.doc, [d.name, *d.header])] if found.ok else []


def _pairs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = []
        for file_id, suffix, content in zip(frame["file_id"], frame["suffix"], frame["content"]):
            found = pairs_in(suffix, content)
            if found:
                lines = content.replace("\r\n", "\n").replace("\r", "\n").split("\n")
                for d in found:
                    rest = remainder(d.doc, [d.name, *d.header]) if len(d.doc) <= STOCK_LENGTH else None
                    rows.append((file_id, d.line, d.name, d.doc, "\n".join(lines[d.first - 1 : d.last]), rest))
        yield pd.DataFrame(rows, columns=["file_id", "def_line", "name", "doc", "code", "rest"])


def stock_remarks(pairs: DataFrame) -> DataFrame:
    """(rest) of remarks that stand at so many functions of different names that they say nothing about any of them.

    At most 1 / ``STOCK_SHARE`` of them can have the share, so they are few.
    """
    total = pairs.count()
    names = pairs.filter("rest is not null").groupBy("rest", "name").agg(F.lit(1).alias("one")).groupBy("rest").agg(F.count("one").alias("names"))
    return names.filter(F.col("names") >= max(STOCK_LEAST, STOCK_SHARE * total)).select("rest")


def documented_functions(src_files: DataFrame) -> DataFrame:
    """(file_id, def_line, name, doc, code) of each informatively documented function."""
    files = src_files.select(F.col("file_id").cast("bigint").alias("file_id"), F.regexp_extract(F.coalesce("path", F.lit("")), SUFFIX, 1).alias("suffix"), "content")
    pairs = spread(files.filter("content is not null and suffix <> ''")).mapInPandas(_pairs, "file_id bigint, def_line bigint, name string, doc string, code string, rest string")
    pairs = cut(pairs)
    return pairs.join(small_side(stock_remarks(pairs)), "rest", "left_anti").select("file_id", "def_line", "name", "doc", "code")
