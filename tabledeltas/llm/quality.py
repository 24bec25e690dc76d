"""Quality and toxicity by hierarchical empirical Bayes.

1. A document classifier gives evidence: a logistic regression on the presence of the tokens
   most associated with the labels. It is fitted on at most ``LABELLED`` labelled rows (in
   expectation; chosen by a hash of the id) and ``FEATURES`` tokens, and scores all documents.
2. Scores are summed per site, a host and a path below it, by grouped aggregation over all
   documents. Between-site variances, estimated by moments from one row of sums, give the
   strength of the priors: a host's posterior rate shrinks to the global rate, a path's to its
   host's, the more the fewer documents it has.
3. A document's final odds are its evidence times the prior odds of its path, from which its own
   score is taken out.

* A null text counts as an empty one: no evidence but that of being short. A null host or path
  is a site of its own. Repeated documents count as often as they occur.
* Labels that are null are ignored; documents of several labels are learned from several times.
  With no labels, or of one kind only, there is no evidence and rates come from what is there.
* An empty table gives no rows. Texts are read whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabledeltas.llm.common import saved, working_folder

LABELLED, FEATURES = 16000, 512
#: Standard errors by which a token's log odds must differ from 0.
CLEAR = 3.0
RIDGE, STEPS = 0.3, 25
#: Strength of a prior in documents, at least and at most.
WEAKEST, STRONGEST = 1.0, 1e6
SHORT, REPEATING = 20, 0.5

TOKEN = re.compile(r"[^\W\d_]+|[^\w\s]+")


def tokens(text: str | None) -> set[str]:
    """Letter and symbol runs, and what is said of the whole text."""
    found = TOKEN.findall((text or "").lower())
    kinds = set(found)
    if len(found) < SHORT:
        kinds.add("#short")
    elif len(kinds) < REPEATING * len(found) and len(kinds) < 200:
        kinds.add("#repeating")
    return kinds


@dataclass
class Model:
    """Weights of tokens, and the rate of the labels they were fitted on."""

    weights: dict[str, float]
    bias: float
    rate: float


def _fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the last weight is the bias."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], RIDGE)
    ridge[-1] = 1e-6
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (y - p) - ridge * w
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(hessian, gradient)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, label: str, labelled: int = LABELLED, features: int = FEATURES) -> Model:
    """A model of one 0/1 column of ``labels``, which names documents by ``doc_id``."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select(
        "doc_id", F.col(label).cast("int").alias("y")
    )
    n = known.count()
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = known.where(place < F.lit(min(1.0, labelled / max(1, n))))
    # bounded by ``labelled`` rows of two numbers, so the texts of all others stay where they are
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "y")
    texts = saved(texts, f"{working_folder(docs.sparkSession)}/labelled-{label}")

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for text, y in zip(batch["text"], batch["y"]):
                yield pd.DataFrame({"token": sorted(tokens(text)), "y": y})

    n, n1 = texts.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0))).first()
    rate = (n1 + 1) / (n + 2)
    empty = Model({}, float(np.log(rate / (1 - rate))), rate)
    if not 0 < n1 < n:
        return empty
    k1, k0 = F.col("k1") + 0.5, F.col("k") - F.col("k1") + 0.5
    odds = F.log(k1 / (F.lit(n1 + 1.0) - k1)) - F.log(k0 / (F.lit(n - n1 + 1.0) - k0))
    error = F.sqrt(1 / k1 + 1 / k0)
    clear = (
        texts.mapInPandas(spread, "token string, y int")
        .groupBy("token")
        .agg(F.count(F.lit(1)).alias("k"), F.sum("y").alias("k1"))
        .where((F.col("k1") < n1) | (F.col("k") - F.col("k1") < n - n1))
        .select("token", F.abs(odds / error).alias("z"))
        .where(F.col("z") >= CLEAR)
        .orderBy(F.col("z").desc(), "token")
        .limit(features)
    )
    names = sorted(r["token"] for r in clear.collect())
    if not names:
        return empty
    number = {t: i for i, t in enumerate(names)}

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            held = [sorted(number[t] for t in tokens(x) if t in number) for x in batch["text"]]
            yield pd.DataFrame({"held": held, "y": batch["y"]})

    sample = texts.mapInPandas(rows, "held array<int>, y int").toPandas()
    x = np.zeros((len(sample), len(names)))
    for i, held in enumerate(sample["held"]):
        x[i, np.asarray(held, dtype=np.int64)] = 1
    w = _fit(x, sample["y"].to_numpy(float))
    return Model(dict(zip(names, w[:-1].tolist())), float(w[-1]), float(sample["y"].mean()))


def evidence(models: list[Model], spark, text_column: str = "text") -> Column:
    """Log likelihood ratios of a text under each model."""
    shared = spark.sparkContext.broadcast(models)  # FEATURES weights each

    @F.pandas_udf("array<double>")
    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = set().union(*(m.weights for m in shared.value))
        starts = [m.bias - np.log(m.rate / (1 - m.rate)) for m in shared.value]
        for batch in texts:
            out = []
            for text in batch:
                held = sorted(tokens(text) & known)
                out.append(
                    [s + sum(m.weights.get(t, 0.0) for t in held) for s, m in zip(starts, shared.value)]
                )
            yield pd.Series(out)

    return scored(F.col(text_column))


def _logit(p: Column) -> Column:
    safe = F.least(F.greatest(p, F.lit(1e-9)), F.lit(1 - 1e-9))
    return F.log(safe / (1 - safe))


def _strength(sites: DataFrame, mean: Column, within: float) -> float:
    """Documents that a prior around ``mean`` is worth, by moments of ``n, total`` per site."""
    off = F.col("total") / F.col("n") - mean
    h, n, squares, spread, level = sites.agg(
        F.count(F.lit(1)),
        F.sum("n"),
        F.sum(F.col("n").cast("double") * F.col("n")),
        F.sum(F.col("n") * off * off),
        F.sum(F.col("n") * mean),
    ).first()
    if not n or h < 2:
        return STRONGEST
    between = (spread - (h - 1) * within) / max(1e-12, n - squares / n)
    mean_rate = level / n
    if between <= 0:
        return STRONGEST
    return min(STRONGEST, max(WEAKEST, mean_rate * (1 - mean_rate) / between - 1))


def posteriors(scored: DataFrame, name: str, rate: float, folder: str) -> DataFrame:
    """For each row ``row, host, path, name`` (the evidence), its final probability ``p_name``."""
    prior = float(np.log(rate / (1 - rate)))
    p = 1 / (1 + F.exp(-(F.col(name) + F.lit(prior))))
    paths = saved(
        scored.select("host", "path", p.alias("p"))
        .groupBy("host", "path")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("total"), F.sum(F.col("p") * F.col("p")).alias("squares")),
        f"{folder}/{name}-paths",
    )
    hosts = saved(
        paths.groupBy("host").agg(*[F.sum(c).alias(c) for c in ("n", "total", "squares")]),
        f"{folder}/{name}-hosts",
    )

    def within(sites: DataFrame) -> float:
        inner, n, h = sites.agg(
            F.sum(F.col("squares") - F.col("total") * F.col("total") / F.col("n")),
            F.sum("n"),
            F.count(F.lit(1)),
        ).first()
        return max(0.0, inner or 0.0) / max(1, (n or 0) - h)

    n, total = hosts.agg(F.sum("n"), F.sum("total")).first()
    overall = (total or 0.0) / (n or 1)
    of_hosts = _strength(hosts, F.lit(overall), within(hosts))
    hosts = hosts.select(
        F.col("host").alias("_host"),
        ((F.col("total") + of_hosts * overall) / (F.col("n") + of_hosts)).alias("host_rate"),
    )
    paths = saved(
        paths.join(hosts, F.col("host").eqNullSafe(F.col("_host"))).drop("_host"),
        f"{folder}/{name}-rated",
    )
    of_paths = _strength(paths, F.col("host_rate"), within(paths))
    sites = paths.select(
        F.col("host").alias("_host"), F.col("path").alias("_path"), "n", "total", "host_rate"
    )
    same = F.col("host").eqNullSafe(F.col("_host")) & F.col("path").eqNullSafe(F.col("_path"))
    others = (F.col("total") - p + of_paths * F.col("host_rate")) / (F.col("n") - 1 + of_paths)
    final = 1 / (1 + F.exp(-(F.col(name) + _logit(others))))
    return scored.join(sites, same).select(scored["*"], final.alias(f"p_{name}"))


def classify(docs: DataFrame, labels: DataFrame, host: Column, path: Column) -> DataFrame:
    """``doc_id, host, path``, the evidence (``quality``, ``toxic``) and the final probabilities
    (``p_quality``, ``p_toxic``) of every document."""
    spark = docs.sparkSession
    folder = working_folder(spark)
    models = [train(docs, labels, c) for c in ("quality", "toxic")]
    scored = docs.select("doc_id", host.alias("host"), path.alias("path"), evidence(models, spark).alias("e"))
    scored = saved(
        scored.select("doc_id", "host", "path", F.col("e")[0].alias("quality"), F.col("e")[1].alias("toxic")),
        f"{folder}/scored",
    )
    for name, model in zip(("quality", "toxic"), models):
        scored = posteriors(scored, name, model.rate, folder)
    return scored
