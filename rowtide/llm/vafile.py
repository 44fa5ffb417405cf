"""Exact top-k by inner product with vector-approximation files.

Rows are dealt into blocks. A block keeps, next to its exact vectors, an approximation: each component
is a small number of bits that name an interval between quantiles of the block. For a query the cells
give a lower and an upper bound of every score; whatever has an upper bound under the k-th largest
lower bound is out. Exact vectors are then read in the order of their bounds until the k-th best exact
score is above all bounds that are left. Queries are a stated part of the rows, also in blocks, and
every block of queries meets every block of rows once.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rowtide.llm.common import keep, same, table

#: Bits of a cell in one dimension, rows of a block, queries of a block.
CELL_BITS, BLOCK_ROWS, QUERY_ROWS = 4, 16_384, 2_048
#: Exact vectors read at first; each further read is twice as large.
READ = 32


class Approximation:
    """The cells of a block of vectors."""

    def __init__(self, exact: np.ndarray, bits: int = CELL_BITS) -> None:
        self.exact = exact
        steps = np.linspace(0, 1, (1 << bits) + 1)
        self.edges = np.quantile(exact, steps, axis=0, method="nearest")  # edges are values, so bounds are exact
        inner = self.edges[1:-1]
        self.cells = np.stack([np.searchsorted(inner[:, d], exact[:, d], side="right") for d in range(exact.shape[1])], axis=1).astype(np.uint8)

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bound of each query's score with each row, from the cells alone."""
        dims = np.arange(self.cells.shape[1])
        low, high = self.edges[self.cells, dims], self.edges[self.cells + 1, dims]
        plus, minus = np.maximum(queries, 0), np.minimum(queries, 0)
        return plus @ low.T + minus @ high.T, plus @ high.T + minus @ low.T

    def search(self, queries: np.ndarray, own: np.ndarray, ids: np.ndarray, wanted: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Rows and scores of each query's k best, ties to the smaller id; a row with the query's own
        id takes no part."""
        out = []
        for start in range(0, len(queries), 256):
            lows, highs = self.bounds(queries[start : start + 256])
            for low, high, query, me in zip(lows, highs, queries[start : start + 256], wanted[start : start + 256]):
                if own[0] <= me <= own[1]:
                    mine = ids == me
                    low[mine] = high[mine] = -np.inf
                floor = np.partition(low, len(low) - k)[len(low) - k] if len(low) > k else -np.inf
                likely = np.flatnonzero((high >= floor) & (high > -np.inf))
                likely = likely[np.argsort(-high[likely], kind="stable")]
                rows, scores = likely[:0], np.array([])
                at, step = 0, READ
                while at < len(likely) and not (len(scores) >= k and high[likely[at]] < scores[k - 1]):
                    more = likely[at : at + step]
                    at, step = at + step, 2 * step
                    rows, scores = np.append(rows, more), np.append(scores, self.exact[more] @ query)
                    best = np.lexsort((ids[rows], -scores))[: max(k, 1)]
                    rows, scores = rows[best], scores[best]
                out.append((rows, scores))
        return out


def integers(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """``(vec_id, v)`` with floor(scale * x) of every component; vectors that are null or empty, or hold
    null or non-finite components, and rows without an id are left out."""
    rows = same(vectors, ["vec_id", "embedding"]).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    rows = rows.where("vec_id is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('Infinity'))")
    return rows.select("vec_id", F.transform("v", lambda x: F.floor(x * scale).cast("double")).alias("v"))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` rows of ``vectors(vec_id, v)`` of the largest inner
    product with each row of ``queries(vec_id, v)``, ties to the smaller vec_id; all, if there are fewer.

    Components are whole numbers, and scores are exact while they stay under 2**53. A row is no
    candidate for a query of its own id; rows that share an id are candidates each, and equal queries
    count once. Vectors of different lengths do not meet. Other columns are ignored; no rows or no
    queries give an empty result.
    """
    queries = queries.dropDuplicates(["vec_id", "v"])
    blocks = max(1, -(-vectors.count() // block_rows))
    groups = max(1, -(-queries.count() // query_rows))

    def dealt(rows: DataFrame, name: str, n: int, other: str, m: int) -> DataFrame:
        mine = F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
        return rows.select("vec_id", "v", F.size("v").alias("dim"), mine.alias(name), F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias(other))

    def run(key: tuple, rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(asked):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        rows, asked = rows.sort_values("vec_id", kind="stable"), asked.sort_values("vec_id", kind="stable")
        ids, wanted = rows["vec_id"].to_numpy(), asked["vec_id"].to_numpy()
        exact, points = np.stack(rows["v"].to_numpy()), np.stack(asked["v"].to_numpy())
        found = Approximation(exact).search(points, (ids[0], ids[-1]), ids, wanted, k)
        counts = [len(r) for r, _ in found]
        return pd.DataFrame({
            "query_id": np.repeat(wanted, counts), "vec_id": ids[np.concatenate([r for r, _ in found])],
            "score": np.concatenate([s for _, s in found]).astype(np.int64),
        })

    keys = ["dim", "block", "group"]
    left, right = dealt(vectors, "block", blocks, "group", groups), dealt(queries, "group", groups, "block", blocks)
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(run, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = keep(integers(table(spark, sf_dir, "embeddings")), "vectors")
    return top_k(rows, rows.where("vec_id % 20 = 0"))


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id
)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score
FROM s QUALIFY rank <= 20
"""
