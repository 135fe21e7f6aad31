"""Vector search: exact nearest neighbours of a stated query set against all rows, and an index of cells.

Both ways work on blocks: queries and rows meet in groups of bounded size, each
group keeps its best k per query, and only these are ranked. Nothing but the
sample that the index is fitted on reaches the driver.

Cases: null ids and vectors, vectors of another length or with NaN or infinity
are left out; zero vectors have similarity 0; ties go to the smaller id; repeated
rows each count; without queries or rows the result is empty.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.functions.exprs import valid_vector
from graphloom.session import cut, small_side

#: Queries and numbers of row vectors (rows times dimension) in a group, on average.
QUERIES_AT_ONCE, NUMBERS_AT_ONCE = 4096, 4 << 20
#: Rows that an index is fitted on at most, its cells at most, and rounds of the fit.
FIT_ROWS, MOST_CELLS, FIT_ROUNDS = 20_000, 1024, 8
_FOUND = "query_id bigint, vec_id bigint, similarity double"


def _unit(vectors: np.ndarray) -> np.ndarray:
    norms = np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
    return np.divide(vectors, norms, out=np.zeros_like(vectors), where=norms > 0)


def _matrix(column: pd.Series, dim: int) -> np.ndarray:
    return _unit(np.array(column.tolist(), dtype=np.float64).reshape(-1, dim))


def _usable(df: DataFrame, dim: int) -> DataFrame:
    rows = df.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.filter(F.col("vec_id").isNotNull() & valid_vector(F.col("embedding"), dim))


def _best(k: int, dim: int):
    """Function of a group's queries and rows: the k most similar rows of each query."""

    def best(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(rows):
            return pd.DataFrame({"query_id": [], "vec_id": [], "similarity": []})
        ids, owners = queries["vec_id"].to_numpy(), rows["vec_id"].to_numpy()
        order = np.argsort(owners, kind="stable")
        owners, vectors = owners[order], _matrix(rows["embedding"], dim)[order]
        out = []
        step = max(1, (4 << 20) // len(rows))
        asked = _matrix(queries["embedding"], dim)
        for at in range(0, len(ids), step):
            similarity = np.round(asked[at : at + step] @ vectors.T, 6)
            top = np.argsort(-similarity, axis=1, kind="stable")[:, :k]
            out.append(pd.DataFrame({"query_id": np.repeat(ids[at : at + step], top.shape[1]), "vec_id": owners[top].ravel(), "similarity": np.take_along_axis(similarity, top, axis=1).ravel()}))
        return pd.concat(out)

    return best


def _ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id"))
    return found.withColumn("rank", rank.cast("bigint")).filter(F.col("rank") <= k)


def _part(n: Column | int) -> Column:
    return F.pmod(F.xxhash64("vec_id"), F.lit(n) if isinstance(n, int) else n).cast("int")


def _upto(n: Column | int) -> Column:
    return F.explode(F.sequence(F.lit(0), (F.lit(n) if isinstance(n, int) else n).cast("int") - 1))


def nearest(queries: DataFrame, rows: DataFrame, k: int, dim: int) -> DataFrame:
    """(query_id, vec_id, similarity, rank): the k most similar rows of each query by cosine, exactly.

    queries, rows: (vec_id, embedding). Every block of queries meets every block
    of rows once; the shuffle holds each row once per block of queries.
    """
    queries, rows = _usable(queries, dim), _usable(rows, dim)
    q, r = max(1, math.ceil(queries.count() / QUERIES_AT_ONCE)), max(1, math.ceil(rows.count() * dim / NUMBERS_AT_ONCE))
    left = queries.select("vec_id", "embedding", _part(q).alias("a"), _upto(r).alias("b")).groupBy("a", "b")
    right = rows.select("vec_id", "embedding", _part(r).alias("b"), _upto(q).alias("a")).groupBy("a", "b")
    return _ranked(left.cogroup(right).applyInPandas(_best(k, dim), _FOUND), k)


class CellIndex:
    """Cells around centres that are fitted on a sample of at most ``FIT_ROWS`` rows; every row is in the cell of its nearest centre."""

    def __init__(self, rows: DataFrame, dim: int, cells: int | None = None) -> None:
        self.dim = dim
        rows = _usable(rows, dim)
        sample = _matrix(rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(FIT_ROWS).select("embedding").toPandas()["embedding"], dim)
        n = cells or max(1, min(MOST_CELLS, round(math.sqrt(max(1, len(sample))) / 2)))
        self.centres = sample[np.linspace(0, len(sample) - 1, min(n, len(sample))).astype(int)] if len(sample) else np.zeros((1, dim))
        for _ in range(FIT_ROUNDS if len(sample) else 0):
            own = (sample @ self.centres.T).argmax(axis=1)
            sums = np.zeros_like(self.centres)
            np.add.at(sums, own, sample)
            some = np.bincount(own, minlength=len(self.centres)) > 0
            self.centres[some] = _unit(sums[some])
        self.rows = cut(self._in_cells(rows, 1))

    def _in_cells(self, df: DataFrame, probes: int) -> DataFrame:
        """Each vector with its ``probes`` nearest cells."""
        centres, dim = self.centres, self.dim
        probes = min(probes, len(centres))

        def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                near = np.argsort(-(_matrix(frame["embedding"], dim) @ centres.T), axis=1, kind="stable")[:, :probes]
                out = frame.loc[frame.index.repeat(probes)].reset_index(drop=True)
                out["cell"] = near.ravel().astype("int32")
                yield out

        return df.mapInPandas(assign, "vec_id bigint, embedding array<double>, cell int")

    def nearest(self, queries: DataFrame, k: int, probes: int = 16) -> DataFrame:
        """As ``nearest``, among the rows of each query's ``probes`` nearest cells; large cells are split on both sides."""
        asked = cut(self._in_cells(_usable(queries, self.dim), probes))
        q = asked.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / QUERIES_AT_ONCE).alias("q"))
        sizes = small_side(self.rows.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) * self.dim / NUMBERS_AT_ONCE).alias("r")).join(q, "cell"))  # one row a cell
        left = asked.join(sizes, "cell").select("vec_id", "embedding", "cell", _part(F.col("q")).alias("a"), _upto(F.col("r")).alias("b")).groupBy("cell", "a", "b")
        right = self.rows.join(sizes, "cell").select("vec_id", "embedding", "cell", _part(F.col("r")).alias("b"), _upto(F.col("q")).alias("a")).groupBy("cell", "a", "b")
        return _ranked(left.cogroup(right).applyInPandas(_best(k, self.dim), _FOUND), k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(queries, recall): share of the exact neighbours that were found."""
    hits = exact.select("query_id", "vec_id").join(found.select("query_id", "vec_id", F.lit(1).alias("hit")), ["query_id", "vec_id"], "left")
    return hits.agg(F.countDistinct("query_id").alias("queries"), F.round(F.avg(F.coalesce("hit", F.lit(0))), 6).alias("recall"))
