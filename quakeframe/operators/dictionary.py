"""Sparse dictionaries over patches: codes by orthogonal matching pursuit in tasks, updates from summed moments."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quakeframe.functions.numeric import unit_hash


def omp(atoms: np.ndarray, x: np.ndarray, sparsity: int) -> np.ndarray:
    """Code of a vector over unit atoms (columns): atoms of the largest remaining correlation, refitted after each."""
    code, residual, used = np.zeros(atoms.shape[1]), x.copy(), []
    for _ in range(min(sparsity, atoms.shape[1])):
        k = int(np.argmax(np.abs(atoms.T @ residual)))
        if k in used or abs(atoms[:, k] @ residual) < 1e-12:
            break
        used.append(k)
        fit = np.linalg.lstsq(atoms[:, used], x, rcond=None)[0]
        residual = x - atoms[:, used] @ fit
        code[:] = 0
        code[used] = fit
    return code


def _moments(df: DataFrame, atoms: np.ndarray, sparsity: int, low: str, high: str) -> tuple[np.ndarray, np.ndarray, float, int]:
    """Sums of code x code and patch x code, of squared error and of rows; a task sends its sums, and equal entries are added before the driver."""
    d_high, k = None, atoms.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cc, pc, error, n = np.zeros((k, k)), None, 0.0, 0
        for b in batches:
            for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x, y = np.asarray(x, float), np.asarray(y, float)
                code = omp(atoms, x, sparsity)
                pc = np.zeros((len(y), k)) if pc is None else pc
                cc += np.outer(code, code)
                pc += np.outer(y, code)
                error += float(((x - atoms @ code) ** 2).sum())
                n += 1
        if n:
            kind = np.concatenate([np.zeros(cc.size), np.ones(pc.size), [2, 3]]).astype(int)
            at = np.concatenate([np.arange(cc.size), np.arange(pc.size), [0, 0]])
            yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(at), pa.array(np.concatenate([cc.ravel(), pc.ravel(), [error, n]]))], ["kind", "at", "v"])

    sums = df.select(low, F.col(high).alias("_high")).mapInArrow(run, "kind long, at long, v double").groupBy("kind", "at").agg(F.sum("v").alias("v")).collect()
    of = lambda kind: np.array([r["v"] for r in sorted((r for r in sums if r["kind"] == kind), key=lambda r: r["at"])])
    cc, pc = of(0).reshape(k, k), of(1)
    d_high = len(pc) // k
    return cc, pc.reshape(d_high, k), float(of(2)[0]), int(of(3)[0])


def train(df: DataFrame, patch: str, key: str, atoms: int, sparsity: int, rounds: int = 5, seed: int = 42) -> tuple[np.ndarray, list[float]]:
    """Unit atoms (columns) by the method of optimal directions, and the mean squared error of each round. The start is a bounded sample of patches."""
    first = df.orderBy(unit_hash(key, seed=seed), key).limit(atoms).select(patch).collect()
    d = np.array([r[0] for r in first], float).T
    rng = np.random.default_rng(seed)
    if d.shape[1] < atoms:
        d = np.concatenate([d, rng.standard_normal((d.shape[0], atoms - d.shape[1]))], axis=1)
    d += 1e-6 * rng.standard_normal(d.shape)
    d /= np.linalg.norm(d, axis=0)
    errors = []
    for _ in range(rounds):
        cc, pc, error, n = _moments(df, d, sparsity, patch, patch)
        errors.append(error / n)
        new = pc @ np.linalg.pinv(cc + 1e-9 * np.eye(atoms))
        norm = np.linalg.norm(new, axis=0)
        d = np.where(norm > 1e-9, new / np.maximum(norm, 1e-9), d)
    return d, errors


def couple(df: DataFrame, low: str, high: str, atoms: np.ndarray, sparsity: int, ridge: float = 1e-6) -> np.ndarray:
    """The dictionary of the other resolution: least squares of its patches on the codes of the first."""
    cc, pc, _, _ = _moments(df, atoms, sparsity, low, high)
    return pc @ np.linalg.inv(cc + ridge * np.eye(len(cc)))


def transform(df: DataFrame, low: str, atoms: np.ndarray, other: np.ndarray, sparsity: int, out: str = "patch") -> DataFrame:
    """Patches of the other resolution from the codes of the first."""
    @F.pandas_udf("array<double>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: other @ omp(atoms, np.asarray(x, float), sparsity))

    return df.withColumn(out, run(F.col(low)))


def errors(df: DataFrame, truth: str, found: str) -> DataFrame:
    """Relative error of each patch, and over all its mean, median and 95th percentile."""
    pair = F.arrays_zip(F.col(truth).alias("t"), F.col(found).alias("f"))
    square = lambda e: F.aggregate(F.transform(pair, e), F.lit(0.0), lambda a, v: a + v * v)
    rel = F.sqrt(square(lambda p: p["t"] - p["f"]) / F.nullif(square(lambda p: p["t"]), F.lit(0.0)))
    return df.agg(F.count(rel).alias("n"), F.avg(rel).alias("mean"), F.median(rel).alias("median"), F.percentile(rel, F.lit(0.95)).alias("p95"))


def grid_search(df: DataFrame, low: str, high: str, key: str, sizes: list[int], sparsities: list[int], rounds: int = 2) -> DataFrame:
    """Mean relative error of the transform for each number of atoms and sparsity."""
    rows = []
    for k in sizes:
        for s in sparsities:
            atoms, _ = train(df, low, key, k, s, rounds)
            other = couple(df, low, high, atoms, s)
            e = errors(transform(df, low, atoms, other, s, "_found"), high, "_found").first()
            rows.append((k, s, float(e["mean"]), float(e["p95"])))
    return df.sparkSession.createDataFrame(rows, "atoms int, sparsity int, mean_error double, p95_error double")
