"""Many models to one: votes, Bayesian model averaging, bootstrap intervals, consistency."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quakeframe.functions.numeric import clean, ratio, unit_hash
from quakeframe.operators.common import checked_broadcast


def vote(df: DataFrame, cell: Sequence[str], value: str, weight: Column | None = None) -> DataFrame:
    """Median, mean, weighted mean, count, deviation and spread of the models in each cell."""
    v = clean(value)
    w = F.when(v.isNotNull(), weight if weight is not None else F.lit(1.0))
    sd, mean = F.stddev_pop(v), F.avg(v)
    cv = F.when(mean != 0, sd / F.abs(mean) * 100.0)
    return df.groupBy(*cell).agg(F.median(v).alias("median"), mean.alias("mean"), ratio(F.sum(w * v), F.sum(w)).alias("weighted_mean"), F.count(v).alias("coverage"), sd.alias("std"), cv.alias("cv_pct"), (F.lit(1.0) - F.least(cv / 100.0, F.lit(1.0))).alias("agreement"))


def class_vote(df: DataFrame, cell: Sequence[str], label: str, n_models: int) -> DataFrame:
    """Sum of the classes -1, 0, 1 where all models have one (else null); counts of fast, slow and valid models."""
    v = F.col(label)
    return df.groupBy(*cell).agg(F.when(F.count(v) == n_models, F.sum(v)).alias("vote_sum"), F.count_if(v == 1).alias("n_fast"), F.count_if(v == -1).alias("n_slow"), F.count(v).alias("n_valid"))


def agreement_profile(votes: DataFrame, depth: str, n_models: int) -> DataFrame:
    """Per depth the share of complete cells in which all models agree on fast or slow, and any of them."""
    full = F.col("n_valid") == n_models
    return votes.groupBy(depth).agg((F.count_if(full & (F.col("n_fast") == n_models)) / F.nullif(F.count_if(full), F.lit(0))).alias("fast_frac"), (F.count_if(full & (F.col("n_slow") == n_models)) / F.nullif(F.count_if(full), F.lit(0))).alias("slow_frac"), F.count_if(full).alias("n_cells"))


def log_likelihood(df: DataFrame, cell: Sequence[str], model: str, value: str, floor: float = 1e-3) -> DataFrame:
    """Mean log-likelihood of each model about the median of all, the deviation across models as noise (``floor`` at least)."""
    v = clean(value)
    consensus = df.groupBy(*cell).agg(F.median(v).alias("_med"), F.greatest(F.stddev_pop(v), F.lit(floor)).alias("_sd"))
    r = (v - F.col("_med")) / F.col("_sd")
    return df.join(consensus, list(cell)).groupBy(model).agg((F.avg(r * r) * -0.5).alias("loglik"), F.count(v).alias("n"))


def posterior(loglik: DataFrame, model: str, prior: str | None = None) -> DataFrame:
    """Softmax of log-likelihood plus log prior over the models (a short table)."""
    score = F.col("loglik") + (F.log(F.col(prior)) if prior else F.lit(0.0))
    top = loglik.agg(F.max(score).alias("_top"), F.count("*").alias("_n"))
    e = F.exp(score - F.col("_top"))
    total = loglik.crossJoin(F.broadcast(top)).agg(F.sum(e).alias("_sum"), F.first("_top").alias("_top"))  # one row
    return loglik.crossJoin(F.broadcast(total)).select(model, "loglik", (e / F.col("_sum")).alias("posterior"))  # one row


def bma(df: DataFrame, cell: Sequence[str], model: str, value: str, weights: DataFrame, renormalised_variance: bool = False) -> DataFrame:
    """Posterior mean over the models that are there, between-model variance, the model of the largest share and the shares' entropy.

    The variance weighs with the posterior as it is, or renormalised over the models that are there.
    """
    v = clean(value)
    j = df.join(checked_broadcast(weights.select(model, "posterior")), model).filter(v.isNotNull())  # a row for each model
    p = F.col("posterior")
    each = j.groupBy(*cell).agg(F.sum(p).alias("_p"), F.sum(p * v).alias("_pv"), F.sum(p * v * v).alias("_pvv"), F.max_by(model, F.struct(p, F.col(model))).alias("dominant"), F.sum(p * F.log(p)).alias("_plp"), F.count("*").alias("n_models"))
    mean = F.col("_pv") / F.col("_p")
    spread = F.col("_pvv") - mean * F.col("_pv") * 2.0 + mean * mean * F.col("_p")
    var = spread / F.col("_p") if renormalised_variance else spread
    return each.select(*cell, mean.alias("bma_mean"), F.greatest(F.lit(0.0), var).alias("between_var"), "dominant", (F.log("_p") - F.col("_plp") / F.col("_p")).alias("entropy"), "n_models")


def bootstrap_median(df: DataFrame, cell: Sequence[str], model: str, value: str, replicates: int = 200, level: float = 0.95, seed: int = 42) -> DataFrame:
    """Interval of the median over resampled models: draws with replacement by a hash of cell, replicate and draw. A cell holds as many values as there are models."""
    v = clean(value)
    values = df.filter(v.isNotNull()).groupBy(*cell).agg(F.array_sort(F.collect_list(v)).alias("_x"))
    rep = values.withColumn("_rep", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    n = F.size("_x")
    # hash of (cell, replicate, draw) picks a model for each draw
    base = F.xxhash64(*cell, "_rep", F.lit(seed))
    drawn = F.array_sort(F.transform(F.sequence(F.lit(1), n), lambda k: F.get("_x", F.pmod(F.xxhash64(base, k), n).cast("int"))))
    med = (F.get(drawn, F.floor((n - 1) / 2).cast("int")) + F.get(drawn, F.floor(n / 2).cast("int"))) / 2.0
    tail = (1 - level) / 2
    return rep.select(*cell, med.alias("_m")).groupBy(*cell).agg(F.percentile("_m", F.lit(tail)).alias("ci_low"), F.percentile("_m", F.lit(1 - tail)).alias("ci_high"), F.count("*").alias("replicates"))


def weighted_sample_key(weight: Column, *keys: str, seed: int = 42) -> Column:
    """Key of weighted sampling without replacement: the largest keys are the sample."""
    return F.log(unit_hash(*keys, seed=seed)) / weight
