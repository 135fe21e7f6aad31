"""Source files that do not parse (problem 3).

Each file is parsed by the packrat grammar of its path's suffix, inside the task
that reads it: ``.py`` as Python 3.13, ``.c`` and ``.h`` as C. A file is valid if
the grammar takes all of it; otherwise the furthest failure (line, column) and
its cause are reported. Nothing is shuffled before the counts of the report.

Causes: ``merge_conflict`` (conflict markers at the failure), ``null_byte``,
``truncated`` (the failure is the end of the text), ``wrong_language`` (the other
grammar takes the text), ``syntax``.

Cases: null content or another suffix gives no row; empty content is valid; any
line ends; texts of any length and nesting (the parse is linear and needs no stack; Python
itself takes 200 open brackets and 99 indentations); repeated rows each give theirs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import c_source, python_source
from graphloom.llm.python_source import Parsed
from graphloom.session import spread

_CONFLICT = re.compile(r"^(?:<{7}|>{7}|={7}|\|{7})(?:[ \t].*)?$")
SUFFIX = r"\.(py|c|h)$"


def parse_as(suffix: str, content: str, definitions: bool = False) -> Parsed:
    """Parse content by the grammar of a suffix."""
    parser = python_source.parse if suffix == "py" else c_source.parse
    return parser(content, definitions)


def cause_of(suffix: str, content: str, failure: Parsed) -> str:
    """Why a file doesn't parse."""
    if failure.why == "null byte":
        return "null_byte"
    lines = content.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    if any(_CONFLICT.match(x) for x in lines[max(0, failure.line - 3) : failure.line + 1]):
        return "merge_conflict"
    if not failure.at_end and parse_as("c" if suffix == "py" else "py", content).ok:
        return "wrong_language"
    return "truncated" if failure.at_end else "syntax"


def _check(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = []
        for suffix, content in zip(frame["suffix"], frame["content"]):
            found = parse_as(suffix, content)
            rows.append((found.ok, found.line, found.column, None if found.ok else cause_of(suffix, content, found)))
        done = pd.DataFrame(rows, columns=["valid", "line", "col", "cause"])
        yield pd.concat([frame[["file_id", "repo", "lang", "suffix"]].reset_index(drop=True), done], axis=1)


def check_files(src_files: DataFrame) -> DataFrame:
    """(file_id, repo, lang, suffix, valid, line, col, cause) of each file with content in a known language."""
    files = src_files.select(F.col("file_id").cast("bigint").alias("file_id"), "repo", "lang", F.regexp_extract(F.coalesce("path", F.lit("")), SUFFIX, 1).alias("suffix"), "content")
    return spread(files.filter("content is not null and suffix <> ''")).mapInPandas(
        _check, "file_id bigint, repo string, lang string, suffix string, valid boolean, line int, col int, cause string"
    )


def invalid_rates(checked: DataFrame) -> DataFrame:
    """Files, invalid files and their rate and causes per repository and language of the path."""
    language = F.when(F.col("suffix") == "py", "python").otherwise("c")
    causes = ("merge_conflict", "truncated", "wrong_language", "null_byte", "syntax")
    return (
        checked.groupBy("repo", language.alias("language"))
        .agg(F.count(F.lit(1)).alias("files"), F.count_if(~F.col("valid")).alias("invalid"), *(F.count_if(F.col("cause") == c).alias(c) for c in causes))
        .withColumn("rate", F.round(F.col("invalid") / F.col("files"), 6))
    )
