"""Approximate nearest neighbours by inner product: a forest of random-projection trees.

Every inner node of a tree has a random direction and a threshold, the median of the fitted
rows that reach it. All rows are sent down all trees; a leaf holds those that end in it. A
query goes down all trees through one shared priority queue: the node that is cheapest by the
squared distances to the thresholds on the wrong side of which it lies is taken next, whichever
tree it is in, until the leaves taken hold enough rows. Candidates are then ranked exactly.

* Fitted are at most ``fit_rows`` distinct vectors, chosen by hash, on the driver; all others
  are indexed all the same. A forest has ``TREES * 2**depth`` leaves, where depth grows until a
  leaf holds about ``LEAF * sqrt(n)`` rows or eight fitted ones: it is bounded by ``fit_rows``.
* A query looks at about ``effort * n**POWER`` rows, those of several trees counted as often. The
  constants are for vectors without any structure, the hardest case: uniformly random ones in
  64 dimensions. Recall of 20 neighbours there is 0.95 and more from 500 to 50,000 rows.
* Equal vectors are one point of the index, with the ``k + 1`` smallest ids it stands for and
  how often each occurs: more cannot be among the ``k`` best of any query. Equal queries are
  searched for once. So neither copies in the table nor among the queries meet each other.
* The rows of a leaf are split into blocks of at most ``BLOCK``; a task holds one block and
  passes the queries that ask for it in batches. A block asked for by more than ``ASKED``
  queries is copied, so that several tasks share them. Each query leaves ``k + 1`` rows a block.
* Scores are sums in double precision, in the order of the components, and do not depend on
  where a row is scored. Ties go to the smaller id. A query never meets rows of its own id.
* A vector that is null, empty, zero, or holds a null or non-finite component takes no part,
  nor does a row without an id. Shorter vectors count as filled up with zeros. Repeated rows
  are candidates as often as they occur, and repeated queries are answered as often. An empty
  table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabledeltas.llm.common import saved, working_folder
from tabledeltas.llm.topk import usable

TREES, LEAF = 8, 4
#: Leaf rows a query looks at, as a multiple of ``n ** POWER``.
EFFORT, POWER = 6.0, 0.83
#: Vectors the thresholds are fitted on.
FIT_ROWS = 16384
#: Rows of a leaf a task holds at once, and queries that one copy of them serves.
BLOCK, ASKED = 8192, 65536
PAIRS = "query long, point long, least_id long, score double"


@dataclass(frozen=True)
class Forest:
    """Complete binary trees: node ``i`` has the children ``2i + 1`` and ``2i + 2``."""

    directions: np.ndarray  # (tree, node, component)
    thresholds: np.ndarray  # (tree, node)
    depth: int
    width: int

    def leaves(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf of every vector in every tree."""
        out = np.empty((len(vectors), len(self.directions)), np.int32)
        rows = np.arange(len(vectors))
        for t, (directions, thresholds) in enumerate(zip(self.directions, self.thresholds)):
            right = vectors @ directions.T > thresholds if self.depth else None
            node = np.zeros(len(vectors), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + right[rows, node]
            out[:, t] = node - ((1 << self.depth) - 1)
        return out

    def nearest_leaves(self, vector: np.ndarray, sizes: np.ndarray, enough: float) -> list[tuple[int, int]]:
        """Leaves in the order of the shared queue, until they hold enough rows."""
        inner = (1 << self.depth) - 1
        margins = self.directions @ vector - self.thresholds
        queue = [(0.0, t, 0) for t in range(len(margins))]
        taken, held = [], 0
        while queue and held < enough:
            cost, tree, node = heapq.heappop(queue)
            while node < inner:
                margin = margins[tree, node]
                near = 2 * node + 1 + (margin > 0)
                other = 4 * node + 3 - near
                heapq.heappush(queue, (cost + margin * margin, tree, other))
                node = near
            if sizes[tree, node - inner]:
                taken.append((tree, node - inner))
                held += sizes[tree, node - inner]
        return taken


def grow(sample: np.ndarray, n: int, trees: int = TREES, seed: int = 0) -> Forest:
    """A forest for ``n`` rows, its thresholds medians of the sample."""
    wanted = math.log2(max(1.0, n / (LEAF * math.sqrt(max(1, n)))))
    depth = max(0, min(math.ceil(wanted), int(math.log2(max(8, len(sample)))) - 3))
    width, inner = sample.shape[1], (1 << depth) - 1
    directions = np.random.default_rng(seed).standard_normal((trees, inner, width))
    directions /= np.maximum(np.linalg.norm(directions, axis=2, keepdims=True), 1e-30)
    thresholds = np.zeros((trees, inner))
    for t in range(trees):
        reach = [np.arange(len(sample))]
        for node in range(inner):
            rows = reach[node]
            along = sample[rows] @ directions[t, node]
            thresholds[t, node] = np.median(along) if len(rows) else 0.0
            right = along > thresholds[t, node]
            reach += [rows[~right], rows[right]]
            reach[node] = rows[:0]
    return Forest(directions, thresholds, depth, width)


def _matrix(vectors: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


# --- points -------------------------------------------------------------------------------


def _points(rows: DataFrame, k: int, folder: str) -> DataFrame:
    """``point, vector, ids, asks``: different vectors, and the ids they stand for."""
    counted = rows.groupBy("vector", "vec_id").agg(
        F.count(F.lit(1)).alias("n"), F.max("asks").alias("asks")
    )
    smallest = Window.partitionBy("vector").orderBy("vec_id")
    first = (
        counted.withColumn("place", F.row_number().over(smallest))
        .where(F.col("place") <= k + 1)  # so a task passes k + 1 rows of a vector at most
        .groupBy("vector")
        .agg(F.sort_array(F.collect_list(F.struct("vec_id", F.least("n", F.lit(k)).alias("n")))).alias("ids"))
    )
    asked = counted.groupBy("vector").agg(F.max("asks").alias("asks"))
    points = first.join(asked, "vector").withColumn("point", F.monotonically_increasing_id())
    return saved(points, f"{folder}/points")


def _send_down(forest: Forest) -> Callable:
    def down(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            leaves = forest.leaves(_matrix(batch["vector"], forest.width))
            yield batch[["point", "least_id"]].assign(leaves=list(leaves))

    return down


def _ask(forest: Forest, sizes: np.ndarray, enough: float) -> Callable:
    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            vectors = _matrix(batch["vector"], forest.width)
            found = [forest.nearest_leaves(v, sizes, enough) for v in vectors]
            yield pd.DataFrame(
                {"point": batch["point"], "leaves": [[t * sizes.shape[1] + n for t, n in f] for f in found]}
            )

    return ask


# --- ranking ------------------------------------------------------------------------------


def _exact(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    scores = np.zeros(len(vectors))
    for q, column in zip(query, vectors.T):
        scores += q * column
    return scores


def _rank(k: int, width: int) -> Callable:
    """Best ``k`` rows of a block for each of its queries. Rows come sorted by block, the rows
    of the leaf before the queries, in batches that may begin and end anywhere."""

    def rank(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, parts, held = None, [], None
        for batch in batches:
            keys = batch[["leaf", "block", "copy"]].to_numpy()
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            for rows in np.split(np.arange(len(batch)), cuts) if len(batch) else []:
                part = batch.iloc[rows]
                if block != tuple(keys[rows[0]]):
                    block, parts, held = tuple(keys[rows[0]]), [], None
                mine = part[~part["asked"]]
                if len(mine):
                    parts.append((
                        mine["point"].to_numpy(), mine["least_id"].to_numpy(), _matrix(mine["vector"], width)
                    ))
                asked = part[part["asked"]]
                if len(asked) and parts:
                    if held is None:
                        held = tuple(np.concatenate(x) for x in zip(*parts))
                    yield best(asked["point"].to_numpy(), _matrix(asked["vector"], width), *held)

    def best(queries, asked, points, ids, vectors) -> pd.DataFrame:
        out = []
        for query, vector, rough in zip(queries, asked, asked @ vectors.T):
            at = np.arange(len(points))
            if len(points) > k:
                least = np.partition(rough, len(rough) - k)[len(rough) - k]
                near = 1e-9 * (1 + np.abs(rough).max())  # rounding of the rough scores is far less
                at = np.flatnonzero(rough >= least - near)
            scores = _exact(vector, vectors[at])
            order = np.lexsort((ids[at], -scores))[:k]
            out.append((np.repeat(query, len(order)), points[at][order], ids[at][order], scores[order]))
        columns = [np.concatenate(c) for c in zip(*out)]
        return pd.DataFrame(dict(zip(("query", "point", "least_id", "score"), columns)))

    return rank


def search(
    vectors: DataFrame,
    is_query: Column,
    k: int,
    effort: float = EFFORT,
    trees: int = TREES,
    fit_rows: int = FIT_ROWS,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
) -> DataFrame:
    """``query_id, rank, vec_id, score``: about the k nearest of every row ``is_query`` holds for."""
    spark = vectors.sparkSession
    folder = working_folder(spark)
    doubles = F.col(vector_column).cast("array<double>")
    rows = vectors.where(usable(vector_column) & F.col(id_column).isNotNull()).select(
        F.col(id_column).cast("long").alias("vec_id"),
        doubles.alias("vector"),
        F.coalesce(is_query, F.lit(False)).alias("asks"),
    )
    rows = rows.where(F.exists("vector", lambda x: x != 0))
    points = _points(rows, k, folder)
    n, width = points.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("vector")), F.lit(1))).first()

    # bounded by fit_rows, whatever the table's size
    chosen = points.orderBy(F.xxhash64("vector"), "vector").limit(fit_rows).select("vector").toPandas()
    forest = grow(_matrix(chosen["vector"], width), n, trees)
    n_leaves = 1 << forest.depth

    least_id = F.get("ids", F.lit(0))["vec_id"].alias("least_id")
    sent = points.select("point", "vector", least_id).mapInPandas(
        _send_down(forest), "point long, least_id long, leaves array<int>"
    )
    leaf = (F.col("tree") * n_leaves + F.col("of_tree")).cast("int").alias("leaf")
    sent = saved(
        sent.select("point", "least_id", F.posexplode("leaves").alias("tree", "of_tree")).select(
            "point", "least_id", leaf
        ),
        f"{folder}/leaves",
    )
    sizes = np.zeros(trees * n_leaves, np.int64)
    for number, size in sent.groupBy("leaf").count().collect():  # one row per leaf of the forest
        sizes[number] = size
    asks = points.where("asks").select("point", "vector")
    enough = effort * max(1, n) ** POWER
    asked = saved(
        asks.mapInPandas(
            _ask(forest, sizes.reshape(trees, n_leaves), enough), "point long, leaves array<int>"
        ),
        f"{folder}/asked",
    )
    asked = asked.select("point", F.explode("leaves").alias("leaf"))
    asked_for = np.zeros(trees * n_leaves, np.int64)
    for number, size in asked.groupBy("leaf").count().collect():
        asked_for[number] = size

    def number_of(counts: np.ndarray, most: int) -> Column:
        per_leaf = [int(-(-c // most)) or 1 for c in counts]
        return F.get(F.lit(per_leaf), F.col("leaf"))

    blocks, copies = number_of(sizes, BLOCK), number_of(asked_for, ASKED)

    def dealt(among: Column) -> Column:
        return F.pmod(F.xxhash64("point"), among).cast("int")

    def each(of: Column) -> Column:
        return F.explode(F.sequence(F.lit(0), of - 1))

    columns = ["leaf", "block", "copy", "asked", "point", "least_id", "vector"]
    held = (
        sent.withColumns({"asked": F.lit(False), "block": dealt(blocks)})
        .withColumn("copy", each(copies))
        .join(points.select("point", "vector"), "point")
        .select(*columns)
    )
    queries = (
        asked.withColumns({"asked": F.lit(True), "copy": dealt(copies), "least_id": F.lit(0).cast("long")})
        .withColumn("block", each(blocks))
        .join(asks, "point")
        .select(*columns)
    )
    within = ["leaf", "block", "copy"]
    ranked = held.union(queries).repartition(*within).sortWithinPartitions(*within, "asked")
    found = saved(ranked.mapInPandas(_rank(k + 1, width), PAIRS), f"{folder}/found")
    return _answers(found, rows, points, k)


def _answers(found: DataFrame, rows: DataFrame, points: DataFrame, k: int) -> DataFrame:
    """From ranked points to ranked rows: each point stands for its ids, in turn."""
    pairs = found.groupBy("query", "point").agg(F.first("least_id").alias("least_id"), F.max("score").alias("score"))
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), "least_id")
    pairs = pairs.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1)
    ids = points.select("point", "ids")
    lists = (
        pairs.join(ids, "point")
        .groupBy("query")
        .agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("minus"), "ids"))).alias("nearest"))
    )
    asking = rows.where("asks").select(F.col("vec_id").alias("query_id"), "vector")
    asking = asking.join(points.where("asks").select("vector", F.col("point").alias("query")), "vector")
    met = asking.select("query_id", "query").join(lists, "query")
    others = F.flatten(
        F.transform(
            "nearest",
            lambda x: F.flatten(
                F.transform(
                    F.filter(x["ids"], lambda i: i["vec_id"] != F.col("query_id")),
                    lambda i: F.array_repeat(
                        F.struct(x["minus"].alias("minus"), i["vec_id"].alias("vec_id")), i["n"].cast("int")
                    ),
                )
            ),
        )
    )
    best = F.slice(F.array_sort(others), 1, k)
    return met.select("query_id", F.posexplode(best).alias("place", "near")).select(
        "query_id",
        (F.col("place") + 1).cast("int").alias("rank"),
        F.col("near.vec_id").alias("vec_id"),
        (-F.col("near.minus")).alias("score"),
    )
