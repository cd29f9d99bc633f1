"""Vector search: exact inner products, top k, lookups, checks.

Rows whose vector is null or of another length than the query take no part. Scores are doubles; ties go to the smaller
id. Repeated ids count once per row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textquarry.functions.vectors import dot, literal
from textquarry.runtime import dealt

#: Numbers in a block of the queries of a batched search: what is broadcast at once, in doubles 64 MB.
BLOCK_NUMBERS = 8 << 20


def vector_topk(vectors: DataFrame, query: list[float], k: int, key: str = "vec_id", column: str = "embedding", repeated: bool = False) -> DataFrame:
    """``key, score`` of the k largest inner products with the query, best first. Planned as a top-k without a full sort.

    Where ids may be ``repeated``, each counts once, by its best row; only ids and scores are shuffled for that.
    """
    rows = vectors.where(F.size(column) == len(query)).select(key, dot(F.col(column), literal(query)).alias("score"))
    rows = rows.groupBy(key).agg(F.max("score").alias("score")) if repeated else rows
    return rows.orderBy(F.desc("score"), key).limit(k)


def query_vector(vectors: DataFrame, vec_id: int, key: str = "vec_id", column: str = "embedding") -> list[float]:
    """The vector of an id, for use as a query."""
    row = vectors.where((F.col(key) == vec_id) & F.col(column).isNotNull()).select(column).first()
    if row is None:
        raise ValueError(f"no vector {vec_id}")
    return [float(x) for x in row[0]]


def vector_topk_batch(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", column: str = "embedding", group: str | None = None) -> DataFrame:
    """``query_id, key, score, rank``: the k best rows of each query (of its own ``group``, if given), itself excluded.

    Queries are sent out in blocks of bounded size; each task multiplies its rows with a block and keeps k per query,
    and only those are shuffled. Each block is a scan of the vectors, which costs little beside the multiplication.
    """
    spark = vectors.sparkSession
    chosen = vectors.select(F.col(key), F.col(column).alias("v"), (F.col(group) if group else F.lit("")).alias("g")).where(F.col("v").isNotNull())
    asked = queries.select(F.col(key).alias("id"), F.col(column).alias("v"), (F.col(group) if group else F.lit("")).alias("g")).where(F.col("v").isNotNull())
    numbers = asked.agg(F.sum(F.size("v"))).first()[0] or 0
    blocks = max(1, -(-numbers // BLOCK_NUMBERS))
    parts = []
    for b in range(blocks):
        mine = asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).toPandas()
        sent = spark.sparkContext.broadcast({(g, n): (r["id"].to_numpy(), np.stack(r["v"].to_numpy()).astype(np.float64)) for (g, n), r in mine.groupby([mine["g"], mine["v"].map(len)])} if len(mine) else {})

        def best(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                out = []
                for (g, n), rows in pdf.groupby([pdf["g"], pdf["v"].map(len)]):
                    if (g, n) not in sent.value:
                        continue
                    ids, q = sent.value[(g, n)]
                    have = rows[key].to_numpy()
                    x = np.stack(rows["v"].to_numpy()).astype(np.float64)
                    for start in range(0, len(ids), 512):
                        score = np.round(q[start : start + 512] @ x.T, 9)
                        score[ids[start : start + 512][:, None] == have[None, :]] = -np.inf
                        take = min(k, score.shape[1])
                        # All that reach the k-th score; of those that tie, the smaller ids stay.
                        least = np.partition(score, score.shape[1] - take, axis=1)[:, score.shape[1] - take]
                        asks, at = np.nonzero((score >= least[:, None]) & np.isfinite(score))
                        order = np.lexsort((have[at], -score[asks, at], asks))
                        asks, at = asks[order], at[order]
                        kept = np.arange(len(asks)) - np.searchsorted(asks, asks) < take
                        asks, at = asks[kept], at[kept]
                        out.append(pd.DataFrame({"query_id": ids[start : start + 512][asks], key: have[at], "score": score[asks, at]}))
                yield pd.concat(out) if out else pd.DataFrame({"query_id": [], key: [], "score": []})

        parts.append(dealt(chosen).mapInPandas(best, f"query_id long, {key} long, score double"))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), key))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def lookup(hits: DataFrame, chunks: DataFrame, key: str = "vec_id") -> DataFrame:
    """Hits with the columns of their chunks; hits without a chunk are dropped. Only the few hits are broadcast."""
    return chunks.join(F.broadcast(hits), key)


def compat_scores(hits: DataFrame, clamp: bool = True) -> DataFrame:
    """Scores read as distances: ``1 - score``, not below 0 if clamped, and the order turned round."""
    turned = F.lit(1.0) - F.col("score")
    return hits.withColumn("score", F.greatest(F.lit(0.0), turned) if clamp else turned)


def index_info(vectors: DataFrame, dimension: int, column: str = "embedding") -> DataFrame:
    """``total_vectors, dimension, memory_bytes``: 4 bytes a number and 1 MiB; nothing when empty."""
    n = F.count(F.col(column))
    return vectors.agg(n.alias("total_vectors"), F.lit(dimension).cast("long").alias("dimension"), F.when(n == 0, 0).otherwise(n * dimension * 4 + (1 << 20)).cast("long").alias("memory_bytes"))


def dimension_report(vectors: DataFrame, group: str, column: str = "embedding") -> DataFrame:
    """Per group and length: ``rows``, and whether the length is the group's usual one (most rows, then longest)."""
    sizes = vectors.where(F.col(column).isNotNull()).groupBy(group, F.size(column).cast("long").alias("dimension")).agg(F.count(F.lit(1)).alias("rows"))
    usual = sizes.groupBy(group).agg(F.max_by("dimension", F.struct("rows", "dimension")).alias("usual"))
    return sizes.join(usual, group).select(group, "dimension", "rows", (F.col("dimension") == F.col("usual")).alias("valid"))
