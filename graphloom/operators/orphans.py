"""References to records that are missing, gone or not yet there (problem 2).

References and targets become rows of (kind, key): a function's or an import's
uid without case and padding, or a file's name within its repository. Then

1. references and live intervals are aggregated by (key, month) first, map-side:
   a key that a third of all rows name is one row a month from here on. Months
   in which nothing of a key lies have no row, however far apart its dates are;
2. keys are dictionary-encoded: every key falls into a hash range, and gets its
   rank within the range as an integer;
3. per range, block of 32,768 keys and month two bitmaps are built: the keys that
   are referred to, and those with a target that is live from the first to the
   last instant of the month (an interval begun before it ends after it);
4. referred AND NOT live leaves the keys with a possible orphan in the month; the
   surviving bits are decoded to keys;
5. the references of these keys and months are held against the intervals that
   begin or end in the month: the first that goes on after it and the last that
   comes from before it decide; those within the month are sorted with the
   references by day. A key without target has none, so all its references are
   orphans.

Bitmaps are packed in containers: sorted 16-bit positions while that is
shorter, else the 4 KiB bitmap.

Cases: null or blank references are none; repeated rows each count; a target
without start is live from ever, without end for ever; a target whose end isn't
after its start is never live; a null time of a reference is never covered, so
it is reported (period null); empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from graphloom.session import cut, small_side

#: Directories that don't count at the head of a Python path (fixed values of the data's definition).
LEADING_DIRS = ("src", "lib", "cli", "python")
_BLANKS = r"^\s+|\s+$"
_QUOTED = r"""^[\s"'`]+|[\s"'`]+$"""
#: Keys per hash range, on average; a range with more just has more blocks.
KEYS_PER_RANGE = 20_000
_BLOCK = 32_768


def norm_uid(c: Column) -> Column:
    """Uid without padding, in lower case; null if blank."""
    x = F.lower(F.regexp_replace(c, _BLANKS, ""))
    return F.when(x != "", x)


def norm_module(c: Column) -> Column:
    """Module without padding and quotes; null if blank."""
    x = F.regexp_replace(c, _QUOTED, "")
    return F.when(x != "", x)


def python_segments(path: Column) -> Column:
    """Segments of a Python file's dotted name: no suffix, no leading source directories, ``__init__`` kept."""
    lead = "^(?:(?:" + "|".join(LEADING_DIRS) + ")/)+"
    dirs = F.regexp_replace(F.regexp_replace(path, r"\.py$", ""), lead, "")
    return F.filter(F.split(dirs, "/"), lambda s: (s != "") & (s != "."))


def _without_init(segments: Column) -> Column:
    last = F.try_element_at(segments, F.lit(-1))
    return F.when(last == "__init__", F.slice(segments, 1, F.greatest(F.size(segments) - 1, F.lit(0)))).otherwise(segments)


def is_python(path: Column) -> Column:
    return F.coalesce(path, F.lit("")).endswith(".py")


def resolve_python(module: Column, file: Column) -> Column:
    """Absolute dotted name of a module as imported by ``file``; null if its dots lead above the top."""
    segments = python_segments(file)
    package = F.slice(segments, 1, F.greatest(F.size(segments) - 1, F.lit(0)))
    dots = F.length(F.regexp_extract(module, r"^(\.*)", 1))
    rest = F.regexp_replace(module, r"^\.+", "")
    base = F.slice(package, F.lit(1), F.greatest(F.size(package) - (dots - 1), F.lit(0)))
    relative = F.when(
        dots - 1 < F.greatest(F.size(package), F.lit(1)),
        F.array_join(F.filter(F.concat(base, F.array(rest)), lambda s: s != ""), "."),
    )
    return F.when(dots == 0, module).otherwise(relative)


def live_targets(func_defs: DataFrame, import_decls: DataFrame, src_files: DataFrame) -> DataFrame:
    """(kind, key, since, until) of every target row."""
    span = [F.col("indexed_at").cast("timestamp").alias("since"), F.col("deleted_at").cast("timestamp").alias("until")]
    functions = func_defs.select(F.lit("callsFunction").alias("kind"), norm_uid(F.col("fn_uid")).alias("key"), *span)
    imports = import_decls.select(F.lit("containsImport").alias("kind"), norm_uid(F.col("import_uid")).alias("key"), *span)
    repo = F.coalesce(F.col("repo"), F.lit(""))
    dotted = F.array_join(_without_init(python_segments(F.col("path"))), ".")
    parts = F.split("path", "/")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat(F.lit("c:"), F.array_join(F.slice(parts, i, F.size(parts)), "/")))
    names = F.when(is_python(F.col("path")), F.array(F.concat(F.lit("py:"), dotted))).when(F.col("path").rlike(r"\.[ch]$"), suffixes)
    files = src_files.filter("path is not null").select(F.lit("module").alias("kind"), repo.alias("r"), F.explode(names).alias("name"), *span)
    files = files.select("kind", F.concat("r", F.lit("\x1f"), "name").alias("key"), "since", "until")
    return functions.unionByName(imports).unionByName(files).filter("key is not null")


def references(graph_edges: DataFrame, import_decls: DataFrame, ext_modules: DataFrame) -> DataFrame:
    """(kind, key, ref_id, at) of every reference that is one."""
    edges = (
        graph_edges.filter(F.col("edge_type").isin("callsFunction", "containsImport"))
        .select(F.col("edge_type").alias("kind"), norm_uid(F.col("dst_uid")).alias("key"), F.col("edge_id").cast("bigint").alias("ref_id"), F.col("seen_at").cast("timestamp").alias("at"))
        .filter("key is not null")
    )
    outside = small_side(ext_modules.select(F.col("root_name").alias("first")).filter("first is not null").distinct())
    modules = (
        import_decls.select("row_id", "repo", "file", norm_module(F.col("module")).alias("m"), F.col("indexed_at").cast("timestamp").alias("at"))
        .filter("m is not null")
        .withColumn("first", F.regexp_extract("m", r"^([^./]*)", 1))
        .join(outside, "first", "left_anti")
    )
    name = F.when(is_python(F.col("file")), F.concat(F.lit("py:"), F.coalesce(resolve_python(F.col("m"), F.col("file")), F.lit("\x1fabove top")))).otherwise(
        F.concat(F.lit("c:"), F.col("m"))
    )
    modules = modules.select(F.lit("module").alias("kind"), F.concat(F.coalesce("repo", F.lit("")), F.lit("\x1f"), name).alias("key"), F.col("row_id").cast("bigint").alias("ref_id"), "at")
    return edges.unionByName(modules)


# --- containers -----------------------------------------------------------------


def pack(bitmap: np.ndarray) -> bytes:
    """Container of a boolean block: b's' and sorted 16-bit positions, or b'm' and the bitmap."""
    positions = np.flatnonzero(bitmap)
    if 2 * len(positions) < _BLOCK // 8:
        return b"s" + positions.astype("<u2").tobytes()
    return b"m" + np.packbits(bitmap, bitorder="little").tobytes()


def unpack(container: bytes | None) -> np.ndarray:
    """Boolean block of a container; all false for null."""
    bits = np.zeros(_BLOCK, dtype=bool)
    if container:
        body = np.frombuffer(container, dtype=np.uint8, offset=1)
        if container[:1] == b"s":
            bits[body.view("<u2")] = True
        else:
            bits |= np.unpackbits(body, bitorder="little").astype(bool)
    return bits


@F.pandas_udf(T.BinaryType())
def _pack_bitmap(bitmaps: pd.Series) -> pd.Series:
    return bitmaps.map(lambda b: pack(np.unpackbits(np.frombuffer(b, dtype=np.uint8), bitorder="little").astype(bool)))


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _and_not(referred: pd.Series, live: pd.Series) -> pd.Series:
    return pd.Series([np.flatnonzero(unpack(r) & ~unpack(x)).astype("int32") for r, x in zip(referred, live)])


_EVER, _NEVER = "0001-01-01", "9999-12-01"


def _months_of(refs: DataFrame, live: DataFrame) -> DataFrame:
    """(kind, key, month, n, closes, from, to): one row per key and month in which a reference or an interval of it lies, aggregated map-side.

    n: references of the month; closes: last whole month of the intervals that
    begin in it; from: the first instant from which one covers the rest of the
    month; to: the last up to which one covers it from its start. Intervals that
    begin and end in the same month are left out.
    """
    begins, ends = F.coalesce(F.trunc("since", "month"), F.lit(_EVER).cast("date")), F.trunc("until", "month")
    live = live.withColumn("m1", begins).withColumn("m2", ends).filter("m2 is null or m1 < m2")
    none = lambda t, name: F.lit(None).cast(t).alias(name)
    begun = live.select("kind", "key", F.col("m1").alias("month"), F.lit(0).alias("n"), F.coalesce(F.add_months("m2", -1), F.lit(_NEVER).cast("date")).alias("closes"), F.coalesce("since", F.lit(_EVER).cast("timestamp")).alias("from"), none("timestamp", "to"))
    ended = live.filter("m2 is not null").select("kind", "key", F.col("m2").alias("month"), F.lit(0).alias("n"), none("date", "closes"), none("timestamp", "from"), F.col("until").alias("to"))
    asked = refs.select("kind", "key", F.trunc("at", "month").alias("month"), F.lit(1).alias("n"), none("date", "closes"), none("timestamp", "from"), none("timestamp", "to"))
    rows = asked.unionByName(begun).unionByName(ended).groupBy("kind", "key", "month")
    return rows.agg(F.sum("n").alias("n"), F.max("closes").alias("closes"), F.min("from").alias("from"), F.max("to").alias("to"))


def _coded(months: DataFrame) -> DataFrame:
    """``months`` with the key's hash range, its integer in it, and the last whole month that intervals begun before the row's month cover."""
    months = cut(months.withColumn("h", F.xxhash64("kind", "key")))
    ranges = max(1, -(-months.count() // KEYS_PER_RANGE))
    by_key = Window.partitionBy("range").orderBy("h", "kind", "key")
    before = Window.partitionBy("range", "h", "kind", "key").orderBy("month").rowsBetween(Window.unboundedPreceding, -1)
    months = months.withColumn("range", F.pmod("h", F.lit(ranges)).cast("int")).withColumn("reach", F.max("closes").over(before))
    return cut(months.withColumn("code", (F.dense_rank().over(by_key) - 1).cast("bigint")).drop("h", "closes"))


def _and_not_live(asked: DataFrame) -> DataFrame:
    """(range, code, month) of the bits that survive referred AND NOT live, by containers per range, block and month."""
    bit = (F.col("code") % _BLOCK).cast("bigint")
    keyed = asked.filter("month is not null").select("range", F.floor(F.col("code") / _BLOCK).cast("int").alias("block"), "month", bit.alias("bit"), (F.col("reach") >= F.col("month")).alias("live"))
    blocks = keyed.groupBy("range", "block", "month").agg(F.bitmap_construct_agg("bit").alias("referred"), F.expr("bitmap_construct_agg(bit) filter (where live)").alias("live"))
    bits = blocks.select("range", "block", "month", F.explode(_and_not(_pack_bitmap("referred"), _pack_bitmap("live"))).alias("bit"))
    return bits.select("range", (F.col("block").cast("bigint") * _BLOCK + F.col("bit")).alias("code"), "month")


def orphan_references(refs: DataFrame, targets: DataFrame) -> DataFrame:
    """(kind, key, ref_id, at): references without a target that is live at their time."""
    live = targets.filter("until is null or since is null or until > since").select("kind", "key", "since", "until")
    asked = _coded(_months_of(refs, live)).filter("n > 0")
    surviving = asked.join(_and_not_live(asked), ["range", "code", "month"], "left_semi").unionByName(asked.filter("month is null"), allowMissingColumns=True)
    suspects = surviving.select(F.col("kind").alias("k2"), F.col("key").alias("key2"), F.col("month").alias("m2"), "from", "to")
    dated = refs.select("kind", "key", "ref_id", "at", F.trunc("at", "month").alias("month"))
    left = dated.join(suspects, (F.col("kind") == F.col("k2")) & (F.col("key") == F.col("key2")) & F.col("month").eqNullSafe(F.col("m2")))
    left = left.filter(~F.coalesce(F.col("at") >= F.col("from"), F.lit(False)) & ~F.coalesce(F.col("at") < F.col("to"), F.lit(False)))
    left = cut(left.select("kind", "key", "ref_id", "at", F.to_date("at").alias("day")))
    # intervals within one month, by day: of those that have begun, the last to end ends after the reference
    short = live.filter("trunc(since, 'month') = trunc(until, 'month')").select("kind", "key", "since", "until", F.explode(F.sequence(F.to_date("since"), F.to_date("until"))).alias("day")).distinct()
    days = short.select("kind", "key", "day").distinct()
    there = left.join(days.withColumn("short", F.lit(True)), ["kind", "key", "day"], "left")
    events = there.filter("short").select("kind", "key", "day", "at", "ref_id", F.lit(None).cast("timestamp").alias("until"), F.lit(1).alias("asks")).unionByName(
        short.select("kind", "key", "day", F.col("since").alias("at"), F.lit(None).cast("bigint").alias("ref_id"), "until", F.lit(0).alias("asks"))
    )
    reach = F.max("until").over(Window.partitionBy("kind", "key", "day").orderBy("at", "asks").rowsBetween(Window.unboundedPreceding, 0))
    uncovered = events.withColumn("last", reach).filter("asks = 1 and (last is null or last <= at)")
    return there.filter("short is null").select("kind", "key", "ref_id", "at").unionByName(uncovered.select("kind", "key", "ref_id", "at"))


def find_orphans(graph_edges: DataFrame, import_decls: DataFrame, func_defs: DataFrame, src_files: DataFrame, ext_modules: DataFrame) -> DataFrame:
    """Orphan references of the code graph."""
    return orphan_references(references(graph_edges, import_decls, ext_modules), live_targets(func_defs, import_decls, src_files))


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Orphan references per kind and month."""
    return orphans.groupBy(F.col("kind").alias("ref_field"), F.date_format("at", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("orphans"), F.countDistinct("key").alias("targets"))
