"""Clustering of voxels: feature-weighted k-means, Gaussian mixtures, a hidden Markov random field, scans over K."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.clustering import BisectingKMeans, GaussianMixture, KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quakeframe.functions.numeric import clean, unit_hash
from quakeframe.operators.common import stored
from quakeframe.operators.similarity import label_agreement


def valid_points(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Rows with all features."""
    ok = F.lit(True)
    for f in features:
        ok = ok & clean(f).isNotNull()
    return df.filter(ok)


def standardised(df: DataFrame, features: Sequence[str], robust: bool = False) -> DataFrame:
    """Features less their mean over their population deviation (or less the median over the interquartile range); constant ones are 0."""
    if robust:
        aggs = [F.percentile(f, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(f) for f in features]
        row = df.agg(*aggs).first()
        scale = {f: (row[f][1], row[f][2] - row[f][0]) for f in features if row[f]}
    else:
        row = df.agg(*[x for f in features for x in (F.avg(f).alias(f"m_{f}"), F.stddev_pop(f).alias(f"s_{f}"))]).first()
        scale = {f: (row[f"m_{f}"], row[f"s_{f}"]) for f in features if row[f"m_{f}"] is not None}
    return df.withColumns({f: (F.col(f) - m) / s if s else F.lit(0.0) for f, (m, s) in scale.items()})


@dataclass
class WeightedKMeans:
    """Centres (clusters x features), feature weights, and the objective of a fit."""

    features: list[str]
    centres: np.ndarray
    weights: np.ndarray
    beta: float
    objective: float
    history: list[float]

    def distances(self) -> list[Column]:
        w = self.weights**self.beta
        return [sum(((F.col(f) - float(c)) * (F.col(f) - float(c)) * float(wf) for f, c, wf in zip(self.features, centre, w, strict=True)), F.lit(0.0)) for centre in self.centres]

    def label(self) -> Column:
        """Number of the nearest centre (ties: the smaller)."""
        return F.array_min(F.array(*[F.struct(d.alias("d"), F.lit(k).alias("k")) for k, d in enumerate(self.distances())]))["k"]

    def predict(self, df: DataFrame, out: str = "label") -> DataFrame:
        return df.withColumn(out, self.label())


def _initial(df: DataFrame, features: Sequence[str], key: Sequence[str], k: int, seed: int) -> np.ndarray:
    """k-means++ on a bounded sample of 64 k rows by the hash of their key."""
    rows = df.withColumn("_u", unit_hash(*key, seed=seed)).orderBy("_u", *key).limit(64 * k).select(*features).collect()
    x = np.array([list(r) for r in rows], dtype=float)
    rng = np.random.default_rng(seed)
    centres = [x[0]]
    while len(centres) < k:
        d = np.min([((x - c) ** 2).sum(axis=1) for c in centres], axis=0)
        centres.append(x[rng.choice(len(x), p=d / d.sum())] if d.sum() > 0 else x[len(centres) % len(x)])
    return np.array(centres)


def fit_weighted_kmeans(df: DataFrame, features: Sequence[str], key: Sequence[str], k: int, beta: float = 2.0, starts: int = 3, rounds: int = 20, tolerance: float = 1e-6, seed: int = 42) -> WeightedKMeans:
    """Lloyd's algorithm with feature weights w_j ~ D_j ^ (-1 / (beta - 1)), D_j a feature's dispersion in the clusters; the best of ``starts``.

    Each round is one aggregate over the rows, by cluster; centres and weights are all that reaches the driver. Empty
    clusters keep their centres; a feature without dispersion gets all weight. ``beta`` in [0, 1] has no minimum.
    """
    if 0 <= beta <= 1:
        raise ValueError("beta must be below 0 or above 1")
    features = list(features)
    rows = stored(valid_points(df, features).select(*dict.fromkeys([*key, *features])), "wkmeans")
    best: WeightedKMeans | None = None
    for start in range(starts):
        model = WeightedKMeans(features, _initial(rows, features, key, k, seed + start), np.full(len(features), 1 / len(features)), beta, math.inf, [])
        for _ in range(rounds):
            labelled = model.predict(rows)
            sums = labelled.groupBy("label").agg(F.count("*").alias("n"), *[x for f in features for x in (F.sum(f).alias(f"s_{f}"), F.sum(F.col(f) * F.col(f)).alias(f"q_{f}"))]).collect()
            centres, spread = model.centres.copy(), np.zeros(len(features))
            for r in sums:  # a row for each cluster
                s, q = (np.array([r[f"{c}_{f}"] for f in features]) for c in "sq")
                centres[r["label"]] = s / r["n"]
                spread += np.maximum(q - s * s / r["n"], 0.0)
            if (spread <= 1e-12).any():
                weights = (spread <= 1e-12) / (spread <= 1e-12).sum()
            else:
                power = spread ** (-1 / (beta - 1))
                weights = power / power.sum()
            objective = float((weights**beta * spread).sum())
            done = model.objective - objective <= tolerance * max(1.0, abs(objective))
            model = WeightedKMeans(features, centres, weights, beta, objective, [*model.history, objective])
            if done:
                break
        if best is None or model.objective < best.objective:
            best = model
    return best


def scan_k(df: DataFrame, features: Sequence[str], key: Sequence[str], ks: Sequence[int], beta: float = 2.0, seed: int = 42) -> list[tuple[int, float]]:
    """Objective for each K."""
    return [(k, fit_weighted_kmeans(df, features, key, k, beta, starts=1, seed=seed).objective) for k in ks]


def scan_beta(df: DataFrame, features: Sequence[str], key: Sequence[str], k: int, betas: Sequence[float], seed: int = 42) -> DataFrame:
    """beta, objective, the features' weights, and the silhouette of weighted k-means for each beta."""
    x = stored(valid_points(df, features), "betas")
    rows = []
    for beta in betas:
        model = fit_weighted_kmeans(x, features, key, k, beta, starts=1, seed=seed)
        rows.append((float(beta), float(model.objective), model.weights.tolist(), silhouette(model.predict(x), features)))
    return df.sparkSession.createDataFrame(rows, "beta double, objective double, weights array<double>, silhouette double")


def subsample_stability(df: DataFrame, features: Sequence[str], key: Sequence[str], k: int, fraction: float = 0.8, repeats: int = 5, seed: int = 42) -> DataFrame:
    """repeat, n, ari: how a mixture fitted to a part of the rows (by the hash of their key) labels that part, against one fitted to all."""
    x = stored(valid_points(df, features), "stability")
    whole = gaussian_mixture(x, features, k, seed, 100, starts=3)[0].select(*key, F.col("label").alias("_whole"))
    out = None
    for n in range(repeats):
        part = x.filter(unit_hash(*key, seed=seed + n + 1) <= fraction)
        labelled = gaussian_mixture(part, features, k, seed + n + 1, 100, starts=3)[0].select(*key, "label").join(whole, list(key))
        one = label_agreement(labelled, [], "label", "_whole").select(F.lit(n).alias("repeat"), "n", "ari")
        out = one if out is None else out.unionByName(one)
    return stored(out, "stability")


def k_robustness(df: DataFrame, features: Sequence[str], key: Sequence[str], ks: Sequence[int], fraction: float = 0.8, repeats: int = 3, seed: int = 42) -> DataFrame:
    """k, mean_ari, least_ari, bic of a mixture for each K: how stable it is under subsampling, next to its fit."""
    x = stored(valid_points(df, features), "robustness")
    fits = scan_mixtures(x, features, ks, seed).select("k", "bic", "silhouette")
    out = None
    for k in ks:
        one = subsample_stability(x, features, key, k, fraction, repeats, seed).agg(F.avg("ari").alias("mean_ari"), F.min("ari").alias("least_ari")).withColumn("k", F.lit(k))
        out = one if out is None else out.unionByName(one)
    return fits.join(out, "k")


def vectors(df: DataFrame, features: Sequence[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol=out).transform(valid_points(df, features))


def gaussian_mixture(df: DataFrame, features: Sequence[str], k: int, seed: int = 42, rounds: int = 50, starts: int = 1) -> tuple[DataFrame, GaussianMixture, float]:
    """Labels and probabilities of a Gaussian mixture (two components at least; the likeliest of ``starts``), the model, and its log-likelihood."""
    x = vectors(df, features)
    fits = [GaussianMixture(k=k, seed=seed + n, maxIter=rounds, tol=1e-5).fit(x) for n in range(starts)]
    model = max(fits, key=lambda m: m.summary.logLikelihood)
    out = model.transform(x).withColumn("gamma", vector_to_array("probability")).withColumnRenamed("prediction", "label").drop("probability", "features")
    return out, model, model.summary.logLikelihood


def mixture_parameters(k: int, d: int) -> int:
    """Free parameters of a full-covariance mixture."""
    return k * d + k * d * (d + 1) // 2 + k - 1


def scan_mixtures(df: DataFrame, features: Sequence[str], ks: Sequence[int], seed: int = 42) -> DataFrame:
    """k, n_points, loglik, bic, aic, silhouette of a mixture for each K (two at least)."""
    x = stored(valid_points(df, features), "mixtures")
    n = x.count()
    rows = []
    for k in ks:
        labelled, _, loglik = gaussian_mixture(x, features, k, seed, 100, starts=3)
        p = mixture_parameters(k, len(features))
        rows.append((k, n, float(loglik), p * math.log(n) - 2 * loglik, 2 * p - 2 * loglik, silhouette(labelled, features)))
    return df.sparkSession.createDataFrame(rows, "k int, n_points long, loglik double, bic double, aic double, silhouette double")


def silhouette(df: DataFrame, features: Sequence[str], label: str = "label") -> float:
    """Mean silhouette with squared distances; NaN for fewer than two clusters."""
    x = VectorAssembler(inputCols=list(features), outputCol="_f").transform(df)
    if x.select(label).distinct().count() < 2:
        return float("nan")
    return ClusteringEvaluator(featuresCol="_f", predictionCol=label).evaluate(x)


def kmeans(df: DataFrame, features: Sequence[str], k: int, seed: int = 42) -> DataFrame:
    """Plain k-means labels, for comparison."""
    return KMeans(k=k, seed=seed).fit(vectors(df, features)).transform(vectors(df, features)).withColumnRenamed("prediction", "label").drop("features")


def hierarchical(df: DataFrame, features: Sequence[str], k: int, seed: int = 42) -> DataFrame:
    """Divisive hierarchical labels. Agglomerative and density clustering need all pairs of points; this is their stand-in, not their equal."""
    return BisectingKMeans(k=k, seed=seed).fit(vectors(df, features)).transform(vectors(df, features)).withColumnRenamed("prediction", "label").drop("features")


def by_band(df: DataFrame, band: str, features: Sequence[str], k: int, least: int, seed: int = 42) -> DataFrame:
    """Mixture labels band by band, numbered on; bands of fewer than ``least`` points get -1. Bands are few."""
    counts = sorted((r[band], r["n"]) for r in valid_points(df, features).groupBy(band).agg(F.count("*").alias("n")).collect() if r[band] is not None)
    out, offset = None, 0
    for name, n in counts:
        part = valid_points(df, features).filter(F.col(band) == name)
        if n < least:
            one = part.withColumn("label", F.lit(-1))
        else:
            one = gaussian_mixture(part, features, k, seed)[0].drop("gamma").withColumn("label", F.col("label") + offset)
            offset += k
        out = one if out is None else out.unionByName(one)
    return out


def random_field(df: DataFrame, features: Sequence[str], index: tuple[str, str, str], k: int, strength: float = 0.5, rounds: int = 3, reach: tuple[float, float, float] = (1.0, 1.0, 1.0), seed: int = 42) -> DataFrame:
    """Mean-field refinement of a mixture: each voxel's probabilities are weighed with those of its six neighbours.

    A round sends every voxel's probabilities to its neighbours (an aggregate by integer keys), updates the parameters
    (one aggregate), and recomputes the probabilities with the parameters as literals.
    """
    points, model, _ = gaussian_mixture(df, features, k, seed)
    rows = stored(points.select(*index, *features, "gamma"), "field")
    d = len(features)
    mean = [list(map(float, g.mean)) for g in model.gaussians]
    cov = [np.array(g.cov.toArray()) for g in model.gaussians]
    offs = [(a, s) for a in range(3) for s in (-1, 1)]
    times = lambda factor: lambda g: g * factor  # noqa: E731  a lambda's second argument would be the index
    for _ in range(rounds):
        sent = F.array(*[F.struct(*[(F.col(n) + (s if a == m else 0)).cast("int").alias(n) for m, n in enumerate(index)], F.transform("gamma", times(reach[a])).alias("g")) for a, s in offs])
        field = rows.select(F.explode(sent).alias("e")).select("e.*").groupBy(*index).agg(*[F.sum(F.get("g", F.lit(j))).alias(f"_s{j}") for j in range(k)])
        near = rows.join(field, list(index), "left")
        logs = []
        for j in range(k):
            inv, det = np.linalg.inv(cov[j]), np.linalg.slogdet(cov[j])[1]
            diff = [F.col(f) - mean[j][a] for a, f in enumerate(features)]
            quad = sum((diff[a] * diff[b] * float(inv[a, b]) for a in range(d) for b in range(d)), F.lit(0.0))
            logs.append(quad * -0.5 - float(det) / 2 + F.coalesce(F.col(f"_s{j}"), F.lit(0.0)) * strength)
        scored = near.withColumn("_l", F.array(*logs))
        top = F.array_max("_l")
        scored = scored.withColumn("_e", F.transform("_l", lambda v: F.exp(v - top)))
        total = F.aggregate("_e", F.lit(0.0), lambda a, v: a + v)
        rows = stored(scored.withColumn("gamma", F.transform("_e", lambda v: v / total)).select(*index, *features, "gamma"), "field")
        g = [F.get("gamma", F.lit(j)) for j in range(k)]
        sums = rows.agg(*[F.sum(g[j]).alias(f"n{j}") for j in range(k)], *[F.sum(g[j] * F.col(f)).alias(f"m{j}_{a}") for j in range(k) for a, f in enumerate(features)], *[F.sum(g[j] * F.col(f) * F.col(h)).alias(f"c{j}_{a}_{b}") for j in range(k) for a, f in enumerate(features) for b, h in enumerate(features)]).first()
        for j in range(k):
            if sums[f"n{j}"] and sums[f"n{j}"] > d:
                m = np.array([sums[f"m{j}_{a}"] for a in range(d)]) / sums[f"n{j}"]
                c = np.array([[sums[f"c{j}_{a}_{b}"] for b in range(d)] for a in range(d)]) / sums[f"n{j}"] - np.outer(m, m)
                mean[j], cov[j] = m.tolist(), c + 1e-6 * np.eye(d)
    label = F.array_max(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda j: F.struct(F.get("gamma", j).alias("p"), (-j).alias("j"))))["j"]
    return rows.withColumn("label", (-label).cast("int"))
