"""Several values packed in one text field (problem 1).

A packed field is one text with several values between delimiters that differ
from source to source and even inside one row. The delimiters are inferred:

1. every row is unwrapped (quotes or brackets around the whole list) and its
   *profile* is taken: the delimiter characters that occur outside quotes and
   brackets;
2. a *source* is (group columns, profile); for each source every set of delimiters
   is scored over all its rows on the consistency of the number of pieces (with
   the declared names, where there are none with the pieces that are one
   parameter each) and on the regularity of the pieces' type;
3. each row is split by the candidate that agrees with its own signature, ties
   going to the better score of its source, and exploded with its position.

Every text is scanned once. The scoring pass sends one partial row per source and candidate and partition
(map-side combined), never the rows.

Cases: null or blank fields give no rows, as do lists of nothing (``()``,
``[""]``); empty slots take no position; a quote that never closes is an
ordinary character; repeated rows each give their own values; other columns,
whatever their names, don't matter.
"""

from __future__ import annotations

import itertools
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.session import cut, small_side, spread

#: Characters that may separate values.
DELIMITERS = ",;|\n\r\t；，、"
_OPEN, _CLOSE = "([{<", ")]}>"
_PAIR = dict(zip(_CLOSE, _OPEN))

#: One parameter of Python (name, type, default, star, marker) or of C (words, pointers, arrays, function pointers).
_ONE = re.compile(
    r"""\s*(?:
      \*{0,2}[^\W\d]\w*\s*(?::[^=]+)?(?:=.+)?          # name[: type][= default]
    | [*/] | \.\.\.
    | (?:[^\W\d]\w*[\s*&]+)+[^\W\d]\w*(?:\s*\[[^\]]*\])*    # C type and name
    | .+\(\s*\*\s*\w*\s*\)\s*\(.*\)                     # C function pointer
    )\s*""",
    re.VERBOSE | re.DOTALL,
)


def _scan(text: str, angle: bool = True) -> tuple[list[tuple[int, str]], bool, dict[int, int]]:
    """Delimiters at depth 0 as (offset, character); whether all brackets closed; the end of each region that opens at depth 0."""
    found: list[tuple[int, str]] = []
    stack: list[tuple[str, int]] = []
    regions: dict[int, int] = {}
    fresh, i, n = True, 0, len(text)  # fresh: a value starts here, so a quote is the packing's
    while i < n:
        c = text[i]
        if c in "\"'":
            j, packed = i + 1, fresh and not stack
            while j < n:
                if text[j] == "\\":
                    j += 2
                elif text[j] == c:
                    if packed and text[j + 1 : j + 2] == c and j > i + 1:
                        j += 2
                        continue
                    break
                else:
                    j += 1
            if j < n:
                if not stack:
                    regions[i] = j
                i, fresh = j + 1, False
                continue
        elif c in _OPEN and (c != "<" or angle):
            stack.append((c, i))
        elif c in _CLOSE and (c != ">" or angle):
            want = _PAIR[c]
            if c == ">" and (not stack or stack[-1][0] != "<"):
                pass
            else:
                while stack and stack[-1][0] == "<" and want != "<":
                    stack.pop()
                if stack and stack[-1][0] == want:
                    start = stack.pop()[1]
                    if not stack:
                        regions[start] = i
        elif not stack and c in DELIMITERS:
            found.append((i, c))
            fresh = True
            i += 1
            continue
        if not c.isspace():
            fresh = False
        i += 1
    if stack and angle and any(s[0] == "<" for s in stack):
        return _scan(text, angle=False)
    return found, not stack, regions


def _unquote(text: str) -> str:
    """Inner text of a wholly quoted value, without the escapes of its packing."""
    quote, inner = text[0], text[1:-1]
    if quote == '"' and "\\" in inner:
        try:
            return json.loads(text, strict=False)
        except ValueError:
            pass
    if "\\" + quote in inner or "\\\\" in inner:
        return re.sub(r"\\([\\\"'])", r"\1", inner)
    return inner.replace(quote * 2, quote)


def unwrap(text: str) -> tuple[str, list[tuple[int, str]]]:
    """The list's text without what encloses it as a whole, and its delimiters at depth 0."""
    text = text.strip()
    while text:
        found, _, regions = _scan(text)
        if regions.get(0) != len(text) - 1 or len(text) < 2:
            return text, found
        text = (_unquote(text) if text[0] in "\"'" else text[1:-1]).strip()
    return "", []


def cut_at(text: str, found: list[tuple[int, str]], chosen: str) -> list[str]:
    """Values between the chosen delimiters; empty slots are left out."""
    pieces, start = [], 0
    for at, c in [*((a, c) for a, c in found if c in chosen), (len(text), "")]:
        piece = text[start:at].strip()
        start = at + 1
        while len(piece) > 1 and piece[0] in "\"'([{<":
            if _scan(piece)[2].get(0) != len(piece) - 1:
                break
            piece = (_unquote(piece) if piece[0] in "\"'" else piece[1:-1]).strip()
        if piece:
            pieces.append(piece)
    return pieces


@lru_cache(maxsize=4096)
def candidates(profile: str) -> list[str]:
    """Delimiter sets to be scored for a profile: all its subsets, the larger first."""
    return ["".join(c) for n in range(len(profile), 0, -1) for c in itertools.combinations(profile, n)]


def declared(signature: str | None) -> int | None:
    """Number of names in ``name(a, b) -> type``; None without a signature."""
    if not signature or "(" not in signature:
        return None
    inner = signature.partition("(")[2].split(") ->")[0].rstrip()
    inner = inner.removesuffix(")").strip()
    return len([x for x in inner.split(",") if x.strip()])


def _profile(found: list[tuple[int, str]]) -> str:
    return "".join(sorted({c for _, c in found}))


def _scan_rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = []
        for row_id, source, packed, signature in zip(frame["row_id"], frame["source"], frame["packed"], frame["signature"]):
            text, found = unwrap(packed)
            rows.append((row_id, source, text, [at for at, _ in found], _profile(found), declared(signature)))
        out = pd.DataFrame(rows, columns=["row_id", "source", "text", "places", "profile", "names"])
        yield out.astype({"row_id": "Int64", "names": "Int32"})


def _found(text: str, places: list[int]) -> list[tuple[int, str]]:
    return [(at, text[at]) for at in places]


def _score_rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    sums: dict[tuple[str, str, str], list[int]] = {}
    for frame in frames:
        for source, text, places, profile, names in zip(frame["source"], frame["text"], frame["places"], frame["profile"], frame["names"]):
            found = _found(text, places)
            for chosen in candidates(profile):
                pieces = cut_at(text, found, chosen)
                regular = sum(_ONE.fullmatch(p) is not None for p in pieces)
                s = sums.setdefault((source, profile, chosen), [0, 0, 0, 0])
                s[0] += 1
                s[1] += regular == len(pieces) if pd.isna(names) else names == len(pieces)
                s[2] += len(pieces)
                s[3] += regular
    yield pd.DataFrame([(*k, *v) for k, v in sums.items()], columns=["source", "profile", "chosen", "rows", "agree", "pieces", "regular"])


def delimiter_scores(scanned: DataFrame) -> DataFrame:
    """Score of every candidate per source: (source, profile, chosen, score); sources with one delimiter leave no choice."""
    partial = scanned.filter(F.length("profile") > 1).select("source", "text", "places", "profile", "names").mapInPandas(
        _score_rows, "source string, profile string, chosen string, rows bigint, agree bigint, pieces bigint, regular bigint"
    )
    total = partial.groupBy("source", "profile", "chosen").agg(*(F.sum(c).alias(c) for c in ("rows", "agree", "pieces", "regular")))
    consistency = (F.col("agree") + 1) / (F.col("rows") + 2)
    regularity = (F.col("regular") + 1) / (F.col("pieces") + 2)
    return total.select("source", "profile", "chosen", (consistency * 2 + regularity).alias("score"))


def _split_rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        ids, places, values = [], [], []
        for row_id, text, at, profile, names, ranked in zip(frame["row_id"], frame["text"], frame["places"], frame["profile"], frame["names"], frame["ranked"]):
            found = _found(text, at)
            options = list(ranked) if ranked is not None else candidates(profile) or [""]
            pieces = cut_at(text, found, options[0])
            if len(options) > 1 and not pd.isna(names) and len(pieces) != names:
                for chosen in options[1:]:
                    if len(other := cut_at(text, found, chosen)) == names:
                        pieces = other
                        break
            ids += [row_id] * len(pieces)
            places += range(1, len(pieces) + 1)
            values += pieces
        yield pd.DataFrame({"row_id": pd.Series(ids, dtype="Int64"), "pos": pd.Series(places, dtype="int64"), "param": pd.Series(values, dtype="object")})


def split_packed(df: DataFrame, id_col: str, packed_col: str, signature_col: str | None = None, source_cols: tuple[str, ...] = ()) -> DataFrame:
    """(row_id, pos, param): one row per value of each non-blank packed field.

    ``source_cols`` name the columns (besides the profile) that make up a source;
    ``signature_col`` the column of a declaration that lists the bare names.
    Texts are scanned once; scoring and splitting work on the places found.
    """
    source = F.concat_ws("␟", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in source_cols)) if source_cols else F.lit("")
    rows = df.select(
        F.col(id_col).cast("bigint").alias("row_id"),
        source.alias("source"),
        F.col(packed_col).alias("packed"),
        (F.col(signature_col) if signature_col else F.lit(None).cast("string")).alias("signature"),
    ).filter(F.col("packed").rlike(r"\S"))
    scanned = cut(spread(rows).mapInPandas(_scan_rows, "row_id bigint, source string, text string, places array<int>, profile string, names int"))
    ranked = (
        delimiter_scores(scanned)
        .groupBy("source", "profile")
        .agg(F.sort_array(F.collect_list(F.struct(F.col("score"), F.length("chosen").alias("n"), "chosen")), asc=False).alias("r"))  # the candidates of one profile
        .select("source", "profile", F.transform("r", lambda x: x["chosen"]).alias("ranked"))
    )
    return scanned.join(small_side(ranked), ["source", "profile"], "left").select("row_id", "text", "places", "profile", "names", "ranked").mapInPandas(
        _split_rows, "row_id bigint, pos bigint, param string"
    )


def function_parameters(func_defs: DataFrame) -> DataFrame:
    """Parameters of each function row; a source is a repository and a language suffix."""
    suffix = F.regexp_extract(F.coalesce("file", F.lit("")), r"\.([A-Za-z]+)$", 1)
    return split_packed(func_defs.select("row_id", "parameters", "signature", "repo", suffix.alias("suffix")), "row_id", "parameters", "signature", ("repo", "suffix"))
