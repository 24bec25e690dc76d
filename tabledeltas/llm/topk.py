"""Exact top-k search by exhaustive term-at-a-time accumulation.

A vector's components are terms. Candidates stay where they are, in parts of bounded size, and a
task takes a chunk of its part at a time as postings, one list of (candidate, weight) per term.
Queries come to it by broadcast, in blocks of bounded bytes. A query takes its non-zero terms one
at a time and scatters ``query weight * posting weight`` into a dense score array over the chunk;
a partition selection keeps the best k, and the parts' best are merged in two levels.

What is shuffled are the candidates once, when they are dealt into parts, and the best of every
part. A block of queries is one job over all candidates, and is dropped after it.

* Weights are ``floor(scale * x)``. Scores are exact integers; components so large that one might
  not fit into 64 bits fail the search.
* A vector that is null or holds a null or non-finite component takes no part, as query or as
  candidate. Vectors of different lengths meet on the terms they share; an empty one scores 0.
* Ties go to the smaller id. A query never meets rows of its own id. A repeated candidate row
  counts as often as it occurs, a repeated query row is answered as often.
* Rows without an id take no part. An empty table gives an empty result; further columns are
  ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabledeltas.llm.common import saved, working_folder

#: Candidates of a part and of a chunk of it; bytes of the queries broadcast at once, about.
PART, CHUNK, QUERY_BYTES = 1 << 18, 4096, 32 << 20
MERGE = 64
#: Bound of scores, with room for what the bound itself is rounded by.
LARGEST = 2.0**62
PARTIAL = "query_row long, query_id long, part int, vec_id long, score long"


def quantised(vector: str, scale: int) -> Column:
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))


def usable(vector: str) -> Column:
    odd = F.exists(
        vector,
        lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == F.lit(float("inf"))),
    )
    return F.col(vector).isNotNull() & ~F.coalesce(odd, F.lit(True))


def _matrix(rows: list) -> np.ndarray:
    width = max((len(r) for r in rows), default=0)
    out = np.zeros((len(rows), width), dtype=np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


class Leaders:
    """The best k candidates so far of every query of a block."""

    def __init__(self, queries: tuple[np.ndarray, np.ndarray, list[np.ndarray]], k: int):
        self.rows, self.own, self.terms = queries
        self.k = k
        none = np.zeros(0, np.int64)
        self.best = [(none, none)] * len(self.rows)

    def meet(self, ids: np.ndarray, vectors: list) -> None:
        """Score every query against a chunk of candidates."""
        order = np.argsort(ids, kind="stable")
        ids, weights = ids[order], _matrix([vectors[i] for i in order])
        most = np.abs(weights.astype(float)).max(axis=0, initial=0)
        postings = [
            (at := np.flatnonzero(weights[:, t]), weights[at, t]) for t in range(weights.shape[1])
        ]
        for i, (own, terms) in enumerate(zip(self.own, self.terms)):
            asked = terms[: len(postings)]
            if np.abs(asked.astype(float)) @ most[: len(asked)] >= LARGEST:
                raise OverflowError("an inner product may not fit into 64 bits: lower the scale")
            scores = np.zeros(len(ids), dtype=np.int64)
            for t in np.flatnonzero(asked):
                at, w = postings[t]
                scores[at] += asked[t] * w
            self._keep(i, own, ids, scores)

    def _keep(self, i: int, own: int, ids: np.ndarray, scores: np.ndarray) -> None:
        first, last = np.searchsorted(ids, [own, own + 1])
        if first < last:  # a query does not meet rows of its own id
            ids, scores = np.delete(ids, np.s_[first:last]), np.delete(scores, np.s_[first:last])
        if len(scores) > self.k:
            least = np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            ids, scores = ids[scores >= least], scores[scores >= least]
        ids, scores = np.append(self.best[i][0], ids), np.append(self.best[i][1], scores)
        order = np.lexsort((ids, -scores))[: self.k]
        self.best[i] = ids[order], scores[order]

    def table(self, part: int) -> pd.DataFrame:
        n = [len(ids) for ids, _ in self.best]
        none = [np.zeros(0, np.int64)]
        return pd.DataFrame(
            {
                "query_row": np.repeat(self.rows, n),
                "query_id": np.repeat(self.own, n),
                "part": part,
                "vec_id": np.concatenate([ids for ids, _ in self.best] + none),
                "score": np.concatenate([scores for _, scores in self.best] + none),
            }
        )


def _accumulate(shared: Broadcast, k: int, size: int):
    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        leaders = Leaders(shared.value, k)
        for batch in batches:
            for at in range(0, len(batch), size):
                chunk = batch.iloc[at : at + size]
                leaders.meet(chunk["vec_id"].to_numpy(np.int64), chunk["terms"].tolist())
        yield leaders.table(TaskContext.get().partitionId())

    return best


def search(
    vectors: DataFrame,
    is_query: Column,
    k: int,
    scale: int = 256,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k best candidates of every row ``is_query`` holds
    for; all rows are candidates."""
    spark = vectors.sparkSession
    rows = (
        vectors.where(usable(vector_column) & F.col(id_column).isNotNull())
        .select(
            F.col(id_column).cast("long").alias("vec_id"),
            quantised(vector_column, scale).alias("terms"),
            F.coalesce(is_query, F.lit(False)).alias("asks"),
        )
    )
    folder = working_folder(spark)
    held_bytes = F.lit(8).cast("long") * F.size("terms") + 64
    n, asked_bytes = rows.agg(F.count(F.lit(1)), F.sum(F.when(F.col("asks"), held_bytes))).first()
    parts = max(spark.sparkContext.defaultParallelism, math.ceil(n / PART))
    rows = rows.repartition(parts).withColumn("row", F.monotonically_increasing_id())
    rows = saved(rows, f"{folder}/rows")
    blocks = max(1, math.ceil((asked_bytes or 0) / QUERY_BYTES))
    dealt = F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int")
    asked = rows.where("asks").select("row", "vec_id", "terms", dealt.alias("block"))
    asked.write.partitionBy("block").parquet(f"{folder}/queries")
    asked = spark.read.schema(asked.schema).parquet(f"{folder}/queries")

    def leaders(df: DataFrame, *within: Column | str) -> DataFrame:
        order = Window.partitionBy(*within).orderBy(F.col("score").desc(), "vec_id")
        return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    for block in range(blocks):
        queries = asked.where(F.col("block") == block).select("row", "vec_id", "terms").toPandas()
        terms = [np.array(t, dtype=np.int64) for t in queries["terms"]]
        ids = [queries[c].to_numpy(np.int64) for c in ("row", "vec_id")]
        shared = spark.sparkContext.broadcast((*ids, terms))  # QUERY_BYTES, about
        best_of_part = _accumulate(shared, k, CHUNK)
        partial = rows.select("vec_id", "terms").mapInPandas(best_of_part, PARTIAL)
        merged = leaders(partial, "query_row", (F.col("part") / MERGE).cast("int"))
        best = leaders(merged.drop("rank"), "query_row").select("query_id", "rank", "vec_id", "score")
        best.write.mode("append").parquet(f"{folder}/best")
        shared.destroy()
    return spark.read.schema(best.schema).parquet(f"{folder}/best")
