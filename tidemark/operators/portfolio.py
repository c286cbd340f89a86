"""Portfolio construction. Moments are aggregated by Spark; k x k algebra is small and runs on the driver.

The number of names k is bounded by the universe (hundreds), not by the rows.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def covariance(returns: DataFrame, codes: list, by: str = "code", value: str = "ret") -> tuple[np.ndarray, np.ndarray]:
    """(means, covariance) over the dates on which both names have a return; one pass per pair of names, aggregated by Spark."""
    a = returns.select("date", F.col(by).alias("a"), F.col(value).alias("x")).where(F.col("a").isin(codes) & F.col("x").isNotNull())
    b = a.toDF("date", "b", "y")
    rows = a.join(b, "date").where("a <= b").groupBy("a", "b").agg(F.covar_samp("x", "y").alias("c"), F.avg("x").alias("m")).collect()  # k (k + 1) / 2 rows
    at = {c: i for i, c in enumerate(codes)}
    cov, mean = np.full((len(codes),) * 2, np.nan), np.full(len(codes), np.nan)
    for r in rows:
        i, j = at[r["a"]], at[r["b"]]
        cov[i, j] = cov[j, i] = r["c"] if r["c"] is not None else np.nan
        if i == j:
            mean[i] = r["m"]
    return mean, cov


def vector_moments(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """(i, j, cov, n): population covariance of the components of an array column, from summed products of each partition."""
    import pyarrow as pa

    def run(batches):
        n, s, q = 0, None, None
        for b in batches:
            x = np.stack([np.asarray(v, float) for v in b.column(0).to_pylist() if v is not None]) if b.num_rows else None
            if x is not None:
                n += len(x)
                s = x.sum(axis=0) if s is None else s + x.sum(axis=0)
                q = x.T @ x if q is None else q + x.T @ x
        if n:
            i, j = np.triu_indices(len(s))
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array([n] * len(i), pa.int64()), pa.array(s[i]), pa.array(s[j]), pa.array(q[i, j])], ["i", "j", "n", "si", "sj", "q"])

    parts = vectors.select(column).mapInArrow(run, "i int, j int, n long, si double, sj double, q double")
    g = parts.groupBy("i", "j").agg(*(F.sum(c).alias(c) for c in ("n", "si", "sj", "q")))
    return g.select("i", "j", (F.col("q") / F.col("n") - F.col("si") / F.col("n") * F.col("sj") / F.col("n")).alias("cov"), "n")


def cov_to_corr(cov: np.ndarray) -> np.ndarray:
    sd = np.sqrt(np.diag(cov))
    return np.clip(cov / np.outer(sd, sd), -1, 1)


def marcenko_pastur_pdf(var: float, q: float, pts: int = 1000) -> tuple[np.ndarray, np.ndarray]:
    lo, hi = var * (1 - math.sqrt(1 / q)) ** 2, var * (1 + math.sqrt(1 / q)) ** 2
    x = np.linspace(lo, hi, pts)
    return x, q / (2 * math.pi * var * x) * np.sqrt(np.maximum(0, (hi - x) * (x - lo)))


def max_noise_eigenvalue(values: np.ndarray, q: float, bandwidth: float = 0.25) -> tuple[float, float]:
    """(lambda+, variance): the noise variance whose spectrum fits a kernel density of the eigenvalues best (golden section)."""

    def error(var: float) -> float:
        x, pdf = marcenko_pastur_pdf(var, q)
        kde = np.exp(-0.5 * ((x[:, None] - values[None, :]) / bandwidth) ** 2).sum(axis=1) / (len(values) * bandwidth * math.sqrt(2 * math.pi))
        return float(((pdf - kde) ** 2).sum())

    lo, hi, g = 1e-5, 1 - 1e-5, (math.sqrt(5) - 1) / 2
    a, b = hi - g * (hi - lo), lo + g * (hi - lo)
    fa, fb = error(a), error(b)
    for _ in range(80):
        if fa < fb:
            hi, b, fb = b, a, fa
            a = hi - g * (hi - lo)
            fa = error(a)
        else:
            lo, a, fa = a, b, fb
            b = lo + g * (hi - lo)
            fb = error(b)
    var = (lo + hi) / 2
    return var * (1 + math.sqrt(1 / q)) ** 2, var


def denoise_covariance(cov: np.ndarray, q: float, bandwidth: float = 0.25) -> np.ndarray:
    sd, corr = np.sqrt(np.diag(cov)), cov_to_corr(cov)
    values, vectors = np.linalg.eigh(corr)
    top, _ = max_noise_eigenvalue(values, q, bandwidth)
    noise = values < top
    if noise.any():
        values = np.where(noise, values[noise].mean(), values)
    c = vectors @ np.diag(values) @ vectors.T
    return cov_to_corr(c) * np.outer(sd, sd)


def min_variance_weights(cov: np.ndarray, mu: np.ndarray | None = None) -> np.ndarray:
    w = np.linalg.solve(cov, np.ones(len(cov)) if mu is None else np.asarray(mu, float))
    return w / w.sum()


def inverse_variance_weights(cov: np.ndarray) -> np.ndarray:
    w = 1 / np.diag(cov)
    return w / w.sum()


def leaf_order(corr: np.ndarray) -> list[int]:
    """Leaves of the single-linkage tree over correlation distances, children in order of merging."""
    d = np.sqrt(np.maximum(0, (1 - corr) / 2))
    # distances between the rows of the distance matrix
    d = np.sqrt(np.maximum(0, ((d[:, None, :] - d[None, :, :]) ** 2).sum(axis=2)))
    np.fill_diagonal(d, np.inf)
    groups = {i: [i] for i in range(len(d))}
    while len(groups) > 1:
        ids = sorted(groups)
        sub = d[np.ix_(ids, ids)]
        i, j = sorted(ids[k] for k in divmod(int(sub.argmin()), len(ids)))
        d[i, :] = d[:, i] = np.minimum(d[i], d[j])
        d[i, i] = np.inf
        groups[i] += groups.pop(j)
    return next(iter(groups.values()))


def hrp_weights(cov: np.ndarray) -> np.ndarray:
    """Risk parity by bisection of the leaf order."""
    w, parts = np.ones(len(cov)), [leaf_order(cov_to_corr(cov))]
    while parts:
        halves = []
        for p in parts:
            if len(p) < 2:
                continue
            a, b = p[: len(p) // 2], p[len(p) // 2 :]
            va, vb = (float((x := inverse_variance_weights(cov[np.ix_(s, s)])) @ cov[np.ix_(s, s)] @ x) for s in (a, b))
            share = 1 - va / (va + vb)
            w[a] *= share
            w[b] *= 1 - share
            halves += [a, b]
        parts = halves
    return w


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, steps: int = 50) -> np.ndarray:
    centers = x[rng.choice(len(x), k, replace=False)]
    for _ in range(steps):
        label = ((x[:, None, :] - centers[None]) ** 2).sum(axis=2).argmin(axis=1)
        after = np.stack([x[label == j].mean(axis=0) if (label == j).any() else centers[j] for j in range(k)])
        if np.allclose(after, centers):
            break
        centers = after
    return label


def _silhouettes(d: np.ndarray, label: np.ndarray) -> np.ndarray:
    kinds = np.unique(label)
    mean = np.stack([np.where((label == c).sum() > 0, d[:, label == c].sum(axis=1), np.inf) for c in kinds], axis=1)
    size = np.array([(label == c).sum() for c in kinds])
    own = np.searchsorted(kinds, label)
    a = mean[np.arange(len(d)), own] / np.maximum(1, size[own] - 1)
    other = mean / size
    other[np.arange(len(d)), own] = np.inf
    b = other.min(axis=1)
    return np.where(size[own] > 1, (b - a) / np.maximum(np.maximum(a, b), 1e-12), 0.0)


def cluster_names(corr: np.ndarray, max_k: int = 10, n_init: int = 10, seed: int = 0) -> np.ndarray:
    """Labels of the clustering with the best t-statistic of silhouettes."""
    x = np.sqrt(np.maximum(0, (1 - corr) / 2))
    d = np.sqrt(((x[:, None, :] - x[None]) ** 2).sum(axis=2))
    rng, best, chosen = np.random.default_rng(seed), -math.inf, np.zeros(len(x), int)
    for _ in range(n_init):
        for k in range(2, min(max_k, len(x) - 1) + 1):
            label = _kmeans(x, k, rng)
            s = _silhouettes(d, label)
            t = s.mean() / s.std() if s.std() > 0 else -math.inf
            if t > best:
                best, chosen = t, label
    return chosen


def nco_weights(cov: np.ndarray, mu: np.ndarray | None = None, max_k: int = 10) -> np.ndarray:
    """Optimal inside clusters, then among them."""
    label = cluster_names(cov_to_corr(cov), max_k)
    kinds = np.unique(label)
    intra = np.zeros((len(cov), len(kinds)))
    for j, c in enumerate(kinds):
        at = np.flatnonzero(label == c)
        intra[at, j] = min_variance_weights(cov[np.ix_(at, at)], None if mu is None else mu[at])
    inter = min_variance_weights(intra.T @ cov @ intra, None if mu is None else intra.T @ mu)
    return intra @ inter


def kelly(returns: DataFrame, by: list[str], fraction: float = 0.5, value: str = "ret", least: int = 8) -> DataFrame:
    """(by, full, used, growth, growth_used, ann_factor): mean over variance, and growth rates a year."""
    years = F.datediff(F.max("date"), F.min("date")) / 365.25
    g = returns.where(F.col(value).isNotNull()).groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.var_samp(value).alias("v"), years.alias("y"))
    g = g.where((F.col("n") >= least) & (F.col("v") > 0)).withColumn("ann_factor", F.try_divide("n", "y"))
    f = F.col("m") / F.col("v")
    growth = lambda x: (x * F.col("m") - x * x * F.col("v") / 2) * F.col("ann_factor")
    return g.select(*by, f.alias("full"), (fraction * f).alias("used"), growth(f).alias("growth"), growth(fraction * f).alias("growth_used"), "ann_factor")


def kelly_weights(mu: np.ndarray, cov: np.ndarray, fraction: float = 0.5) -> np.ndarray:
    return fraction * np.linalg.solve(cov, np.asarray(mu, float))


def kelly_summary(row) -> str:
    """One line about a row of ``kelly``."""
    return f"f*={row['full']:.2f}, used {row['used']:.2f}; growth a year {row['growth_used']:+.1%}, full {row['growth']:+.1%}"
