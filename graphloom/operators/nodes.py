"""Current nodes and deduplicated edges of the stored graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(df: DataFrame, key: str, *order: str) -> DataFrame:
    """One row per key: the greatest by ``order`` (nulls first). One aggregation, combined before the shuffle."""
    rest = [c for c in df.columns if c != key]
    by = F.struct(*(x for c in order for x in (F.col(c).isNotNull(), F.col(c))))
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), by).alias("_r")).select(key, "_r.*")


def first_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """First row per keys in the order of the columns: deduplicated build side of a first-match join."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*")


def functions(func_defs: DataFrame) -> DataFrame:
    return latest(func_defs, "fn_uid", "indexed_at", "row_id")


def classes(class_defs: DataFrame) -> DataFrame:
    return latest(class_defs, "class_uid", "indexed_at", "row_id")


def imports(import_decls: DataFrame) -> DataFrame:
    return latest(import_decls, "import_uid", "indexed_at", "row_id")


def files(src_files: DataFrame) -> DataFrame:
    return latest(src_files, "file_uid", "indexed_at", "file_id")


def clean_uid(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))


def edges(graph_edges: DataFrame) -> DataFrame:
    """(edge_type, src, dst), distinct; inverse edges are this with src and dst exchanged."""
    return graph_edges.filter("dst_uid is not null and src_uid is not null").select("edge_type", clean_uid(F.col("src_uid")).alias("src"), clean_uid(F.col("dst_uid")).alias("dst")).distinct()
