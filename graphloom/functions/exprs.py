"""Column expressions of the graph model; all stay in the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def uid(*parts: Column | str) -> Column:
    """First 16 hex digits of the SHA-256 of the identity string (parts joined by ``@``)."""
    return F.substring(F.sha2(F.concat_ws("@", *parts), 256), 1, 16)


def namespace_id(path: Column) -> Column:
    """31-bit id of a workspace path."""
    return F.conv(F.substring(F.sha2(path, 256), 1, 8), 16, 10).cast("bigint") % F.lit(2**31)


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    """Directory of a path, '' at the top."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z]+)$", 1))


def language_of(path: Column) -> Column:
    """Language by lower-cased suffix, null if unknown."""
    s = suffix(path)
    return F.when(s == "py", "python").when(s.isin("c", "h"), "c").when(s.isin("cpp", "cc", "cxx", "hpp", "hh", "hxx"), "cpp")


#: Directories at which a workspace-relative path starts (fixed values); ``src`` itself is left out.
ROOT_MARKERS = ("packages", "src", "include", "lib")
COMMON_DIRS = ("comm", "validation", "sql", "encryption", "transactions", "initialization", "keystore", "signing", "utils", "tests")


def relative_path(path: Column) -> Column:
    """Path from the first marker directory on, else from the first common directory, else the file name."""
    parts = F.split(path, "/")
    out = None
    for marker in ROOT_MARKERS:
        at = F.array_position(parts, marker)
        piece = F.array_join(F.slice(parts, (at + (1 if marker == "src" else 0)).cast("int"), F.size(parts)), "/")
        out = F.when(at > 0, piece) if out is None else out.when(at > 0, piece)
    hits = F.filter(F.transform(F.array(*map(F.lit, COMMON_DIRS)), lambda d: F.array_position(parts, d)), lambda p: p > 0)
    first = F.array_min(hits)
    return out.when(F.size(hits) > 0, F.array_join(F.slice(parts, first.cast("int"), F.size(parts)), "/")).otherwise(basename(path))


def module_name(path: Column) -> Column:
    """Dotted module of a Python path without leading source directories; ``__pycache__`` is left out."""
    plain = F.regexp_replace(path, r"\.py$", "")
    parts = F.filter(F.split(F.regexp_replace(plain, r"^(?:(?:cli|src|lib|python)(?:/|$))+", ""), "/"), lambda p: (p != "") & (p != "__pycache__"))
    return F.when(F.size(parts) > 0, F.array_join(parts, ".")).otherwise(basename(plain))


def glob_match(path: Column, pattern: str) -> Column:
    """Shell pattern on the full path or the file name."""
    import fnmatch

    regex = "^" + fnmatch.translate(pattern).removeprefix("(?s:").removesuffix(")\\Z").removesuffix(")\\z") + "$"
    regex = re.sub(r"\(\?>(.*?)\)", r"(?:\1)", regex)
    return path.rlike("(?s)" + regex) | basename(path).rlike("(?s)" + regex)


def terms(text: Column) -> Column:
    """Lower-case terms of a name."""
    return F.filter(F.split(F.lower(text), r"[^a-z0-9]+"), lambda t: t != "")


def all_terms(text: Column, query: str) -> Column:
    """Whether a name holds all terms of a query."""
    wanted = [t for t in re.split(r"[^a-z0-9]+", query.lower()) if t]
    found = F.lit(bool(wanted))
    for t in wanted:
        found = found & F.array_contains(terms(text), t)
    return found


def not_blank(c: Column) -> Column:
    return F.coalesce(F.length(F.regexp_replace(c, r"\s", "")) > 0, F.lit(False))


def valid_vector(v: Column, dim: int) -> Column:
    """Of the right length, without NaN and infinity."""
    return F.coalesce((F.size(v) == dim) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))


def zero_vector(v: Column) -> Column:
    return F.coalesce(F.forall(v, lambda x: x == 0), F.lit(False))
