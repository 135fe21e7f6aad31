"""Source-file trees as rows, and JSON exports of results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.exprs import language_of, uid

#: Directories whose files are left out, at any depth (fixed values).
EXCLUDED_DIRS = ("node_modules", ".git", "__pycache__", "build", "Build", "BUILD", "cmake-build-[^/]*", "out", ".vs", ".vscode")


def scan_sources(spark: SparkSession, root: str, repo: str, languages: tuple[str, ...] = ("python", "c")) -> DataFrame:
    """(file_uid, repo, path, lang, content, modified) of the source files below a folder.

    The scan lists and reads files in tasks; paths are relative to the folder.
    Text that isn't UTF-8 keeps replacement characters; unknown suffixes and
    excluded directories are left out.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/").removeprefix("file://")
    path = F.regexp_replace(F.regexp_replace("path", r"^file:/+", "/"), "^" + quoted(base) + "/", "")
    rows = files.select(path.alias("path"), "content", F.col("modificationTime").alias("modified")).withColumn("lang", language_of(F.col("path")))
    excluded = "(^|/)(" + "|".join(d if "[" in d else quoted(d) for d in EXCLUDED_DIRS) + ")/"
    rows = rows.filter(F.col("lang").isin(*languages) & ~F.col("path").rlike(excluded))
    return rows.select(uid("path").alias("file_uid"), F.lit(repo).alias("repo"), "path", "lang", F.decode("content", "UTF-8").alias("content"), "modified")


def quoted(text: str) -> str:
    """Literal text within a pattern."""
    return "".join("\\" + c if c in r"\.[]{}()*+-?^$|" else c for c in text)


def export_json(df: DataFrame, folder: str, by: str | None = None) -> None:
    """JSON lines; ``by`` makes one folder per value, so that equal file names don't overwrite each other."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).json(folder)


def export_graph(facts: DataFrame, edges: DataFrame, folder: str) -> None:
    """Exports of an index run: ``files`` (facts by kind), ``index`` (counts per file) and ``relationships`` (edges by type)."""
    export_json(facts, f"{folder}/files", by="kind")
    kinds = ("function", "class", "import", "call")
    export_json(facts.groupBy("path").agg(F.count(F.lit(1)).alias("facts"), *(F.count_if(F.col("kind") == k).alias(k) for k in kinds)), f"{folder}/index")
    export_json(edges, f"{folder}/relationships", by="edge_type")
