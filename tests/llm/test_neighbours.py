"""Nearest neighbours: exact where all rows are looked at, and recall where they are not."""

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabledeltas.llm import forest
from tabledeltas.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int"


def usable(v):
    return v is not None and None not in v and np.isfinite(np.array(v, float)).all() and any(v)


def product(a, b):
    return float(sum(float(x) * float(y) for x, y in zip(a, b)))


def brute(rows, asks, k):
    rows = [(i, v) for i, v, *_ in rows if i is not None and usable(v)]
    out = []
    for i, v in rows:
        if asks(i):
            near = sorted((-product(v, w), j) for j, w in rows if j != i)[:k]
            out += [(i, rank, j, -s) for rank, (s, j) in enumerate(near, 1)]
    return sorted(out)


def found_by(df, asks, k, **options):
    return sorted(tuple(r) for r in forest.search(df, asks, k, **options).collect())


def near(found, wanted):
    assert [r[:3] for r in found] == [r[:3] for r in wanted]
    assert np.allclose([r[3] for r in found], [r[3] for r in wanted], rtol=1e-12, atol=1e-15)


def odd_rows():
    rng = np.random.default_rng(3)
    nan, inf = float("nan"), float("inf")
    common = [0.5, -0.25, 1.0]
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 3)], 0) for i in range(40)]
    rows += [(i, common, None) for i in range(100, 160)]  # more equal vectors than k
    rows += [(20, common, 1)] * 4  # a repeated query and candidate, with an id of another row
    rows += [(200, None, 1), (201, [], 1), (202, [0.0, 0.0, -0.0], 1), (203, [1.0, None, 0.0], 1),
             (204, [nan, 1.0, 0.0], 1), (205, [1.0, -inf, 0.0], 1), (None, [1.0, 1.0, 1.0], 1),
             (210, [2.0], 1), (211, [1.0, -1.0, 0.5, 0.25], 1), (-5, [3.0, 3.0, 3.0], 1)]
    return rows


@pytest.mark.parametrize("split", [False, True])
def test_odd_vectors_equal_brute_force(spark, monkeypatch, split):
    """Every leaf is looked at: exact, also where leaves are split and copied."""
    if split:
        monkeypatch.setattr(forest, "BLOCK", 5)
        monkeypatch.setattr(forest, "ASKED", 2)
    rows = odd_rows()
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    df = df.withColumns({c: F.lit(c) for c in ("point", "vector", "ids", "asks", "leaf", "block", "score", "rank")})
    wanted = brute(rows, lambda i: i % 20 == 0, 7)
    near(found_by(df, F.col("vec_id") % 20 == 0, 7, effort=1e9), wanted)


def test_fewer_candidates_than_asked_for_and_none(spark):
    rows = [(0, [1.0, 0.0], 0), (1, [0.5, 0.0], 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    near(found_by(df, F.col("vec_id") == 0, 20), [(0, 1, 1, 0.5)])
    assert found_by(df.where("vec_id = 0"), F.lit(True), 20) == []
    assert found_by(df.where("false"), F.lit(True), 20) == []
    assert found_by(df, F.lit(None).cast("boolean"), 20) == []


def test_recall_of_the_query(spark, small):
    """Vectors without structure, the hardest case; scores are those of the vectors found."""
    rows = [r["embedding"] for r in spark.read.parquet(f"{small}/embeddings.parquet").orderBy("vec_id").collect()]
    vectors = np.array(rows, float)
    found = collections.defaultdict(list)
    for r in QUERIES["op11_neighbours"](spark, small).orderBy("query_id", "rank").collect():
        assert r["score"] == pytest.approx(float(vectors[r["query_id"]] @ vectors[r["vec_id"]]), abs=1e-12)
        found[r["query_id"]].append(r["vec_id"])
    assert sorted(found) == list(range(0, len(vectors), 20))
    hits = 0
    for i, got in found.items():
        scores = vectors @ vectors[i]
        scores[i] = -np.inf
        assert len(got) == len(set(got)) == 20
        hits += len(set(got) & set(np.argsort(-scores, kind="stable")[:20].tolist()))
    assert hits >= 0.9 * 20 * len(found)


def test_a_forest_looks_at_part_of_the_rows(spark):
    """Clustered vectors: a small share of them holds nearly all neighbours."""
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((20, 16))
    vectors = (centres[np.arange(2000) % 20] + 0.3 * rng.standard_normal((2000, 16))).astype(np.float32)
    rows = [(i, [float(x) for x in v], 0) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, SCHEMA)
    grown = forest.grow(vectors.astype(float), 2000)
    sizes = np.stack([np.bincount(c, minlength=1 << grown.depth) for c in grown.leaves(vectors.astype(float)).T])
    assert (sizes.sum(axis=1) == 2000).all() and sizes.max() <= 2 * 2000 / (1 << grown.depth)
    asked = grown.nearest_leaves(vectors[0].astype(float), sizes, 400)
    assert 400 <= sum(sizes[t, leaf] for t, leaf in asked) <= 400 + sizes.max()
    wanted = {(q, v) for q, _, v, _ in brute(rows, lambda i: i % 500 == 0, 5)}
    got = {(q, v) for q, _, v, _ in found_by(df, F.col("vec_id") % 500 == 0, 5, effort=1.5)}
    assert len(got & wanted) >= 0.8 * len(wanted)
