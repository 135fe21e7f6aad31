"""Incremental store: content hashes, validated inserts, cascading deletes, file replacement and change batches as table rewrites.

A store is two tables: nodes (kind, uid, repo, file, label, h), each uid once, and
edges (edge_type, src, dst). Nothing is changed in place: each operation gives
the rows of the next snapshot, or what happens to each row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.exprs import not_blank

#: Node kinds with the columns that hold uid, file and label, and those that make up the content (positions and times don't).
KINDS = {
    "Function": ("fn_uid", "file", "name", ("name", "file", "signature", "docstring")),
    "Class": ("class_uid", "file", "name", ("name", "file")),
    "Import": ("import_uid", "file", "module", ("module", "file", "text", "alias")),
    "File": ("file_uid", "path", "path", ("path", "lang")),
}


def content_hash(*cols: Column | str) -> Column:
    """SHA-256 over the content columns; nulls differ from empty text. Position columns are not given to it."""
    parts = [F.coalesce(F.concat(F.lit("="), (F.col(c) if isinstance(c, str) else c).cast("string")), F.lit("-")) for c in cols]
    return F.sha2(F.concat_ws("\x1f", *parts), 256)


def canonical_hash(*names: str) -> Column:
    """SHA-256 over JSON with sorted keys and without nulls."""
    return F.sha2(F.to_json(F.struct(*sorted(names))), 256)


def nodes_of(kind: str, rows: DataFrame) -> DataFrame:
    """(kind, uid, repo, file, label, h) of the rows of one kind."""
    uid, file, label, content = KINDS[kind]
    return rows.select(F.lit(kind).alias("kind"), F.col(uid).alias("uid"), "repo", F.col(file).alias("file"), F.col(label).alias("label"), content_hash(*content).alias("h"))


def relation_digest(edges: DataFrame) -> DataFrame:
    """(src, relations, digest): number and order-free digest of what each node points to; combined map-side, whatever the degree."""
    number = F.conv(F.substring("dst", 1, 12), 16, 10).cast("bigint")
    return edges.groupBy("src").agg(F.count(F.lit(1)).alias("relations"), F.bit_xor(number).alias("digest"))


def changed_rows(new: DataFrame, old: DataFrame, key: str, hash_col: str) -> DataFrame:
    """Rows whose content isn't in the previous snapshot (never deduplicated within the new one)."""
    return new.join(old.select(key, hash_col).distinct(), [key, hash_col], "left_anti")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Old rows whose key isn't among the new, and all new rows."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def insert_nodes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(kind, uid, repo, file, label, h, status) of each new node: rejected, unchanged, updated or inserted."""
    known = old.select("uid", F.col("h").alias("old_h"))
    status = F.when(~not_blank(F.col("label")) | ~not_blank(F.col("file")), "rejected").when(F.col("old_h") == F.col("h"), "unchanged").when(F.col("old_h").isNotNull(), "updated").otherwise("inserted")
    return new.join(known, "uid", "left").select("kind", "uid", "repo", "file", "label", "h", status.alias("status"))


def insert_edges(old: DataFrame, new: DataFrame, nodes: DataFrame) -> DataFrame:
    """New edges that aren't stored yet and whose ends both are nodes."""
    ends = nodes.select("uid").distinct()
    fresh = new.join(old, ["edge_type", "src", "dst"], "left_anti").distinct()
    return fresh.join(ends.withColumnRenamed("uid", "src"), "src", "left_semi").join(ends.withColumnRenamed("uid", "dst"), "dst", "left_semi").select("edge_type", "src", "dst")


def insert_graph(nodes: DataFrame, edges: DataFrame, new_nodes: DataFrame, new_edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes and edges of the next snapshot, and the status of each new node."""
    done = insert_nodes(nodes, new_nodes)
    written = done.filter("status in ('updated', 'inserted')").drop("status")
    after = upsert(nodes, written, "uid")
    return after, edges.unionByName(insert_edges(edges, new_edges, after)), done


def in_files(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """Nodes of all kinds, the files themselves too, of the stated files (repo, file)."""
    return nodes.join(files.select("repo", "file").distinct(), ["repo", "file"], "left_semi")


def delete_files(nodes: DataFrame, deleted: DataFrame, columns: list[str]) -> DataFrame:
    """Nodes without those contained in deleted files."""
    return nodes.join(deleted.select(*columns).distinct(), columns, "left_anti")


def delete_edges(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """Edges without those that touch a deleted node (column uid)."""
    uids = gone.select("uid").distinct()
    return edges.join(uids.withColumnRenamed("uid", "src"), "src", "left_anti").join(uids.withColumnRenamed("uid", "dst"), "dst", "left_anti")


def delete_cascade(nodes: DataFrame, edges: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Snapshot without the stated files (repo, file), all they contain, and all edges of these."""
    return delete_files(nodes, files, ["repo", "file"]), delete_edges(edges, in_files(nodes, files))


def relinked(nodes: DataFrame, edges: DataFrame, replaced: DataFrame, new_nodes: DataFrame) -> DataFrame:
    """(src, old_dst, dst) of the calls to functions that a replacement of files (repo, file) takes away.

    dst is the function of that name in the new rows of the same file, else the
    first by uid in the repository after the replacement, null without any.
    """
    functions = nodes.filter("kind = 'Function'")
    new = new_nodes.filter("kind = 'Function'")
    gone = in_files(functions, replaced).join(new.select("uid"), "uid", "left_anti").select(F.col("uid").alias("dst"), "repo", "file", "label")
    after = delete_files(functions, replaced, ["repo", "file"]).select("repo", "file", "label", "uid").unionByName(new.select("repo", "file", "label", "uid"))
    own = new.groupBy("repo", "file", "label").agg(F.min("uid").alias("own"))
    any_of = after.groupBy("repo", "label").agg(F.min("uid").alias("any"))
    targets = gone.join(own, ["repo", "file", "label"], "left").join(any_of, ["repo", "label"], "left").select("dst", F.coalesce("own", "any").alias("new"))
    calls = edges.filter("edge_type = 'callsFunction'").select("src", "dst")
    return calls.join(targets, "dst").select("src", F.col("dst").alias("old_dst"), F.col("new").alias("dst"))


def replace_files(nodes: DataFrame, edges: DataFrame, replaced: DataFrame, new_nodes: DataFrame, new_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Snapshot with the stated files' nodes replaced by the new ones, and calls to lost functions linked anew."""
    links = relinked(nodes, edges, replaced, new_nodes).filter("dst is not null").select(F.lit("callsFunction").alias("edge_type"), "src", "dst")
    after = delete_files(nodes, replaced, ["repo", "file"]).unionByName(new_nodes)
    lost = in_files(nodes, replaced).join(new_nodes.select("uid"), "uid", "left_anti")
    kept = delete_edges(edges, lost)
    return after, kept.unionByName(insert_edges(kept, new_edges.unionByName(links), after))


def apply_changes(nodes: DataFrame, edges: DataFrame, events: DataFrame, new_nodes: DataFrame, new_edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One batch of change events (repo, file, deleted, ts): the next snapshot, and the status of each node it touches.

    The last event of a file tells whether it exists. Deleted files go with all
    they contain; the new nodes of existing ones are inserted unless their
    content is stored already.
    """
    last = events.groupBy("repo", "file").agg(F.max_by("deleted", F.struct("ts", "deleted")).alias("deleted"))
    gone = last.filter("deleted")
    kept, left = delete_cascade(nodes, edges, gone)
    read = new_nodes.join(last.filter("not deleted").select("repo", "file"), ["repo", "file"], "left_semi")
    after, linked, done = insert_graph(kept, left, read, new_edges)
    status = done.select("kind", "uid", "repo", "file", "status").unionByName(in_files(nodes, gone).select("kind", "uid", "repo", "file", F.lit("deleted").alias("status")))
    return after, linked, status


class HashTable:
    """Stored content hashes: a Parquet table that is appended to and read as a set."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def add(self, hashes: DataFrame) -> None:
        """Append the distinct hashes (column h) that aren't stored yet."""
        fresh = hashes.select("h").distinct()
        if self.exists():
            fresh = fresh.join(self.read(), "h", "left_anti")
        fresh.write.mode("append").parquet(self.path)

    def _place(self):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return place, place.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def exists(self) -> bool:
        place, system = self._place()
        return system.exists(place)

    def read(self) -> DataFrame:
        return self.spark.read.schema("h string").parquet(self.path)

    def marked(self, rows: DataFrame) -> DataFrame:
        """``rows`` (column h) with whether the hash is stored."""
        if not self.exists():
            return rows.withColumn("stored", F.lit(False))
        return rows.join(self.read().withColumn("there", F.lit(True)), "h", "left").withColumn("stored", F.coalesce("there", F.lit(False))).drop("there")

    def clear(self) -> None:
        place, system = self._place()
        system.delete(place, True)


class Workspaces:
    """Registered workspaces: a small JSON table (path, namespace, registered_at), rewritten on each change."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.table = HashTable(spark, path)

    def save(self, rows: DataFrame) -> None:
        rows.select("path", "namespace", "registered_at").coalesce(1).write.mode("overwrite").json(self.table.path)

    def read(self) -> DataFrame:
        return self.table.spark.read.schema("path string, namespace bigint, registered_at timestamp").json(self.table.path)

    def clear(self) -> None:
        self.table.clear()

    def registered(self, path: str) -> bool:
        return self.table.exists() and not self.read().filter(F.col("path") == path).isEmpty()
