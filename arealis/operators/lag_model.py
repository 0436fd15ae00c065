"""The spatial lag model by maximum likelihood, over sparse weights."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arealis.operators.stats import _beta, _fitted, lag
from arealis.sources.shared import cut


def chebyshev_traces(rows: DataFrame, W: DataFrame, n: int, key: str, terms: int, probes: int, seed: int) -> np.ndarray:
    """Traces of the Chebyshev polynomials ``T_0 .. T_terms`` of the weights (eigenvalues within -1 and 1).

    Up to ``probes`` rows the weights are a small matrix on the driver and the traces
    exact. Beyond that each is the mean of ``u' T(W) u`` over probes ``u`` of random signs,
    which are columns of one table; ``T`` follows from the two before it by one sparse
    product. The first two powers' traces are exact then, too, by joins.
    """
    if n <= probes:
        at = {i: k for k, i in enumerate(sorted(r[0] for r in rows.select(key).collect()))}
        w = np.zeros((n, n))
        for r in W.groupBy("i", "j").agg(F.sum("w").alias("w")).collect():
            w[at[r.i], at[r.j]] = r.w
        before, now, out = np.eye(n), w, [float(n), float(np.trace(w))]
        for _ in range(2, terms + 1):
            before, now = now, 2 * w @ now - before
            out.append(float(np.trace(now)))
        return np.array(out[: terms + 1])
    names = range(probes)
    u = [F.when(F.xxhash64(F.lit(seed), F.lit(p), key) % 2 == 0, 1.0).otherwise(-1.0).alias(f"u{p}") for p in names]
    start = rows.select(F.col(key).alias("i"), *u)
    state = cut(start.select("i", *(f"u{p}" for p in names), *(F.lit(0.0).alias(f"a{p}") for p in names), *(F.col(f"u{p}").alias(f"b{p}") for p in names)))
    found = [float(n)]
    for k in range(1, terms + 1):
        product = W.join(state.select(F.col("i").alias("j"), *(f"b{p}" for p in names)), "j").groupBy("i").agg(*(F.sum(F.col("w") * F.col(f"b{p}")).alias(f"x{p}") for p in names))
        twice = 1.0 if k == 1 else 2.0
        new = [(twice * F.coalesce(f"x{p}", F.lit(0.0)) - F.col(f"a{p}")).alias(f"b{p}") for p in names]
        state = cut(state.join(product, "i", "left").select("i", *(f"u{p}" for p in names), *(F.col(f"b{p}").alias(f"a{p}") for p in names), *new))
        found.append(state.agg(F.sum(sum((F.col(f"u{p}") * F.col(f"b{p}") for p in names), F.lit(0.0)))).first()[0] / probes)
    back = W.select(F.col("j").alias("i"), F.col("i").alias("j"), F.col("w").alias("v"))
    found[1] = W.where("i = j").agg(F.sum("w")).first()[0] or 0.0
    found[2] = 2 * (W.join(back, ["i", "j"]).agg(F.sum(F.col("w") * F.col("v"))).first()[0] or 0.0) - n
    return np.array(found)


def log_determinant(rho: float, traces: np.ndarray) -> float:
    """``ln |I - rho W|`` from the traces; with ``rho = 2 r / (1 + r^2)`` it is ``-n ln(1 + r^2) - 2 sum r^k tr T_k / k``."""
    if rho == 0:
        return 0.0
    r = (1 - math.sqrt(1 - rho * rho)) / rho
    k = np.arange(1, len(traces))
    return float(-traces[0] * math.log(1 + r * r) - 2 * (r**k / k * traces[1:]).sum())


def spatial_lag_ml(df: DataFrame, W: DataFrame, y: str, xs: Sequence[str], key: str = "id", terms: int = 30, probes: int = 64, seed: int = 0) -> DataFrame:
    """``(term, coefficient, std_error, pseudo_r2, log_likelihood, aic, n)`` of ``y = rho W y + X b + e``, by maximum likelihood.

    ``W`` is row-standardised. Two least-squares fits, of ``y`` and of ``W y``, give the
    squared error of any ``rho`` from three sums; the log-determinant comes from
    ``terms`` sparse products; so the search for ``rho`` (by thirds, within -0.99 and
    0.99) runs on the driver over a few numbers. Above ``probes`` rows the determinant is
    an estimate from ``probes`` random sign vectors, and rho's error falls with the root
    of rows times probes. The error of rho is from the curvature of the likelihood,
    those of other terms hold for that rho. Rows with nulls are left out, and weights to
    them count as 0.
    """
    rows = cut(df.select(key, y, *xs).na.drop())
    n = rows.count()
    ids = rows.select(F.col(key).alias("i"))
    W = cut(W.join(ids, "i", "left_semi").join(ids.withColumnRenamed("i", "j"), "j", "left_semi"))
    full = cut(rows.join(lag(W, rows, y, key).withColumnRenamed("lag", "_wy"), key, "left").fillna(0.0, ["_wy"]))
    b0, b1 = _beta(full, y, xs), _beta(full, "_wy", xs)
    e0, e1 = F.col(y) - _fitted(b0, xs), F.col("_wy") - _fitted(b1, xs)
    s = full.agg(F.sum(e0 * e0), F.sum(e0 * e1), F.sum(e1 * e1)).first()
    traces = chebyshev_traces(rows, W, n, key, terms, probes, seed)
    sse = lambda rho: s[0] - 2 * rho * s[1] + rho * rho * s[2]
    ll = lambda rho: log_determinant(rho, traces) - n / 2 * (math.log(2 * math.pi) + math.log(sse(rho) / n) + 1)
    grid = np.linspace(-0.99, 0.99, 199)
    top = int(np.argmax([ll(r) for r in grid]))
    lo, hi = grid[max(top - 1, 0)], grid[min(top + 1, len(grid) - 1)]
    while hi - lo > 1e-9:
        a, b = lo + (hi - lo) / 3, hi - (hi - lo) / 3
        lo, hi = (a, hi) if ll(a) < ll(b) else (lo, b)
    rho = (lo + hi) / 2
    beta, h = b0 - rho * b1, 1e-4
    bend = (ll(rho + h) - 2 * ll(rho) + ll(rho - h)) / h**2
    one = full.withColumn("_one", F.lit(1.0))
    terms_ = ["_one", *xs]
    gram = one.agg(*(F.sum(F.col(a) * F.col(b)) for a in terms_ for b in terms_)).first()
    errors = np.sqrt(np.diag(np.linalg.inv(np.array(gram, dtype=float).reshape(len(terms_), -1))) * sse(rho) / n)
    fitted = F.lit(float(rho)) * F.col("_wy") + _fitted(beta, xs)
    r = full.agg(F.corr(F.col(y), fitted)).first()[0]
    fit = (float((r or 0.0) ** 2), float(ll(rho)), float(-2 * ll(rho) + 2 * (len(terms_) + 1)), n)
    out = [("intercept" if t == "_one" else t, float(b), float(e), *fit) for t, b, e in zip(terms_, beta, errors)]
    out.append(("rho", float(rho), float(1 / math.sqrt(-bend)) if bend < 0 else None, *fit))
    return df.sparkSession.createDataFrame(out, "term string, coefficient double, std_error double, pseudo_r2 double, log_likelihood double, aic double, n long")
