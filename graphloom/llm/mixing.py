"""Mixing sources to target weights (problem 7).

Each source gets its target share of the total tokens, small sources are
repeated at most a capped number of times. Sizes are tokens of a public
tokenizer, whose file is a parameter.

1. Tokens are counted once per document and written with the source and a hash
   of the document (not its text).
2. The total is given, or the largest with which every source that has documents
   reaches its share within its cap. Shares of sources without documents are
   spread over the others in proportion.
3. A source's budget is a number of whole passes over its documents and a rest.
   For the rest a hash threshold is sought: tokens are summed by source and hash
   bucket, the bucket in which the rest is used up is the boundary, and only its
   documents are summed again by finer buckets, until one hash is left.
4. Documents below their source's threshold get one copy more than the passes: a
   filter by hash, without any sort.

Hot sources are sums per bucket (map-side combined) and a filter against one row
per source, so they are never gathered anywhere.

Cases: documents with null, unlisted or share-less source are not used; null or
empty texts count no tokens and get the passes' copies; listed sources without
documents are reported with actual share 0; repeated targets of a source add
their shares and keep the largest cap; a total beyond the caps is filled as far
as they allow and the shortfall shows in the report; without targets or
documents the result is empty.
"""

from __future__ import annotations

import base64
import importlib.util
from collections.abc import Iterator
from functools import lru_cache
from typing import TYPE_CHECKING

import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.session import cut, small_side, spread

if TYPE_CHECKING:
    import tiktoken

#: Folder of the public tokenizer's files on the driver's machine, and the vocabulary in it; tasks get the vocabulary from Spark.
TOKENIZERS, VOCABULARY = "/opt/tokenizers", "byte_bpe_50k.tiktoken"
#: Bits of the hash that one level of buckets resolves, and levels (60 bits in all).
BITS, LEVELS = 10, 6


def word_pattern(folder: str) -> str:
    """The pattern that splits text before the vocabulary is applied, from the folder's own module."""
    spec = importlib.util.spec_from_file_location("tokenizer_files", f"{folder}/__init__.py")
    files = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(files)
    return files.PATTERN


@lru_cache(maxsize=4)
def _encoding(name: str, pattern: str) -> tiktoken.Encoding:
    import tiktoken

    with open(SparkFiles.get(name), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_sizes(documents: DataFrame, folder: str = TOKENIZERS, name: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, h, tokens): token count and 60-bit hash of each document with a source."""
    pattern = word_pattern(folder)
    documents.sparkSession.sparkContext.addFile(f"{folder}/{name}")

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoding = _encoding(name, pattern)
        for frame in frames:
            sizes = [len(encoding.encode_ordinary(t)) if t else 0 for t in frame["text"]]
            yield pd.DataFrame({"doc_id": frame["doc_id"], "source": frame["source"], "h": frame["h"], "tokens": pd.Series(sizes, dtype="int64")})

    h = F.shiftrightunsigned(F.xxhash64("doc_id", F.when(F.col("doc_id").isNull(), F.col("text"))), 4)
    docs = documents.filter("source is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), "source", h.alias("h"), "text")
    return spread(docs).mapInPandas(count, "doc_id bigint, source string, h bigint, tokens bigint")


def budgets(sizes: DataFrame, targets: DataFrame, total: int | None = None) -> DataFrame:
    """(source, share, cap, have, budget, passes, rest) of each listed source."""
    wanted = (
        targets.filter("source is not null and target_share > 0")
        .groupBy("source")
        .agg(F.sum("target_share").alias("share"), F.max(F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0))).cast("bigint").alias("cap"))
    )
    have = sizes.groupBy("source").agg(F.sum("tokens").alias("have"), F.count(F.lit(1)).alias("documents"))
    known = cut(wanted.join(have, "source", "left").fillna(0, ["have", "documents"]))
    usable = known.filter("have > 0 and cap > 0")
    spread, most = usable.agg(F.sum("share"), F.min(F.col("cap") * F.col("have") / F.col("share"))).first()
    size = float(total) if total is not None else (most or 0.0) * (spread or 0.0)
    budget = F.when((F.col("have") > 0) & (F.col("cap") > 0), F.least(F.col("share") / F.lit(spread or 1.0) * F.lit(size), (F.col("cap") * F.col("have")).cast("double"))).otherwise(0.0)
    out = known.withColumn("budget", F.floor(budget + 1e-6).cast("bigint"))
    passes = F.when(F.col("have") > 0, F.floor(F.col("budget") / F.col("have"))).otherwise(0).cast("bigint")
    return cut(out.withColumn("passes", passes).withColumn("rest", F.col("budget") - F.col("passes") * F.col("have")))


def thresholds(sizes: DataFrame, plan: DataFrame) -> DataFrame:
    """(source, passes, threshold): documents with a hash below the threshold fill the rest of the budget."""
    state = plan.filter("have > 0").select("source", "passes", F.col("rest").alias("left"), F.lit(0).cast("bigint").alias("prefix"), (F.col("rest") > 0).alias("open"))
    for level in range(LEVELS):
        shift = BITS * (LEVELS - 1 - level)
        open_now = small_side(state.filter("open").select("source", "left", "prefix"))
        inside = sizes.join(open_now, "source").filter(F.shiftright("h", shift + BITS) == F.col("prefix"))
        sums = inside.groupBy("source", "left", F.shiftright("h", shift).alias("bucket")).agg(F.sum("tokens").alias("tokens"), F.count_distinct("h").alias("hashes") if level else F.lit(2).alias("hashes"))
        # at most 2^BITS rows a source
        running = sums.withColumn("upto", F.sum("tokens").over(Window.partitionBy("source").orderBy("bucket")))
        boundary = (
            running.filter("upto >= left")
            .groupBy("source")
            .agg(F.min_by(F.struct("bucket", (F.col("left") - (F.col("upto") - F.col("tokens"))).alias("left"), "tokens", "hashes"), "bucket").alias("b"))
            .select("source", "b.*")
        )
        # one hash left: its document is taken if that comes nearer to the budget
        last = F.lit(level == LEVELS - 1) | (F.col("hashes") == 1)
        nearer = F.col("b.left") * 2 >= F.col("b.tokens")
        state = cut(
            state.alias("s")
            .join(boundary.alias("b"), "source", "left")
            .select(
                "source",
                "s.passes",
                F.coalesce(F.when(last, F.lit(0)).otherwise(F.col("b.left")), F.col("s.left")).alias("left"),
                F.when(F.col("b.bucket").isNull() | ~F.col("s.open"), F.col("s.prefix"))
                .when(last, F.shiftleft(F.col("b.bucket") + F.when(nearer, 1).otherwise(0), shift))
                .otherwise(F.col("b.bucket"))
                .alias("prefix"),
                (F.col("s.open") & F.col("b.bucket").isNotNull() & ~F.coalesce(last, F.lit(False))).alias("open"),
            )
        )
        if state.filter("open").isEmpty():
            break
    return state.select("source", "passes", F.col("prefix").alias("threshold"))


def mixture(sizes: DataFrame, plan: DataFrame) -> DataFrame:
    """(doc_id, source, tokens, copies) of every used document."""
    bounds = small_side(thresholds(sizes, plan))
    return sizes.join(bounds, "source").withColumn("copies", F.col("passes") + F.when(F.col("h") < F.col("threshold"), 1).otherwise(0)).filter("copies > 0").select("doc_id", "source", "tokens", "copies")


def mix_sources(documents: DataFrame, targets: DataFrame, total: int | None = None, folder: str = TOKENIZERS) -> tuple[DataFrame, DataFrame]:
    """The mixture (doc_id, source, tokens, copies) and the report of actual shares."""
    listed = small_side(targets.select("source").filter("source is not null").distinct())
    sizes = cut(token_sizes(documents, folder).join(listed, "source", "left_semi"))
    plan = budgets(sizes, targets, total)
    mixed = cut(mixture(sizes, plan))
    used = mixed.groupBy("source").agg(F.count(F.lit(1)).alias("used_documents"), F.sum(F.col("copies") * F.col("tokens")).alias("used_tokens"), F.max("copies").alias("most_copies"))
    whole = Window.partitionBy()  # one row a listed source
    report = plan.join(used, "source", "left").fillna(0, ["used_documents", "used_tokens", "most_copies"]).select(
        "source", F.col("share").alias("target_share"), F.col("cap").alias("max_repeats"), F.col("have").alias("available_tokens"), "budget", "used_documents", "used_tokens", "most_copies",
        F.round(F.col("used_tokens") / F.greatest(F.sum("used_tokens").over(whole), F.lit(1)), 6).alias("actual_share"),
    )
    return mixed, report
