"""Spatial statistics over sparse weights ``(i, j, w)`` and values ``(id, y)``."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arealis.functions import geometry as g
from arealis.functions.columns import two_sided_p
from arealis.operators.rank import with_offsets
from arealis.operators.spatial import near_pairs, nearest_join
from arealis.sources.shared import cut


def weights(df: DataFrame, kind: str, key: str = "id", k: int = 8, distance: float | None = None) -> DataFrame:
    """Binary weights: ``queen`` (a common vertex), ``rook`` (a common edge), ``knn``, ``distance``."""
    r = lambda p: F.concat_ws(" ", F.format_string("%.7f", p.x + 0.0), F.format_string("%.7f", p.y + 0.0))
    if kind == "queen":
        parts = df.select(key, F.explode(F.transform(F.flatten("rings"), r)).alias("part")).distinct()
    elif kind == "rook":
        e = F.transform(F.flatten(F.transform("rings", g.edges)), lambda e: F.concat_ws("|", F.least(r(e.a), r(e.b)), F.greatest(r(e.a), r(e.b))))
        parts = df.select(key, F.explode(e).alias("part")).distinct()
    elif kind == "knn":
        n = nearest_join(df, df.withColumnRenamed(key, "j"), key, "j", distance or 1.0, k=k + 1)
        w = Window.partitionBy(key).orderBy(F.round("d", 9), "j")
        return n.where(F.col(key) != F.col("j")).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k).select(F.col(key).alias("i"), "j", F.lit(1.0).alias("w"))
    else:
        other = df.select(F.col(key).alias("j"), F.col("x").alias("x2"), F.col("y").alias("y2"))
        return near_pairs(df.select(F.col(key).alias("i"), "x", "y"), other, distance).where("i != j").select("i", "j", F.lit(1.0).alias("w"))
    # merged, as all joins of places: files are small beside their rows, so Spark would send a side to the driver
    other = parts.select(F.col(key).alias("j"), "part").hint("merge")
    return parts.select(F.col(key).alias("i"), "part").join(other, "part").where("i != j").select("i", "j").distinct().withColumn("w", F.lit(1.0))


def drop_islands(df: DataFrame, W: DataFrame, key: str = "id") -> DataFrame:
    return df.join(W.select(F.col("i").alias(key)).distinct(), key, "left_semi")


def row_standardise(W: DataFrame) -> DataFrame:
    return W.withColumn("w", F.col("w") / F.sum("w").over(Window.partitionBy("i")))


def lag(W: DataFrame, df: DataFrame, col: str, key: str = "id") -> DataFrame:
    """``(key, lag)``: the weighted sum over the neighbours."""
    return W.join(df.select(F.col(key).alias("j"), F.col(col).alias("_v")).hint("merge"), "j").groupBy(F.col("i").alias(key)).agg(F.sum(F.col("w") * F.col("_v")).alias("lag"))


def _moments(df: DataFrame, y: str) -> DataFrame:
    return F.broadcast(df.agg(F.count(y).alias("n"), F.avg(y).alias("mean"), F.var_pop(y).alias("var")))


def morans_i(df: DataFrame, W: DataFrame, y: str, key: str = "id") -> DataFrame:
    """Global Moran's I with expectation, z and p under normality, and a verdict; null under 10 rows."""
    z = df.select(key, y).join(_moments(df, y)).select(key, (F.col(y) - F.col("mean")).alias("z"), "n", "var")
    pairs = W.join(z.select(F.col(key).alias("i"), F.col("z").alias("zi"), "n", "var"), "i").join(z.select(F.col(key).alias("j"), F.col("z").alias("zj")), "j")
    s = pairs.agg(F.first("n").alias("n"), F.first("var").alias("var"), F.sum(F.col("w") * F.col("zi") * F.col("zj")).alias("cross"), F.sum("w").alias("s0"))
    back = W.select(F.col("j").alias("i"), F.col("i").alias("j"), F.col("w").alias("v"))
    s1 = W.join(back, ["i", "j"], "full_outer").agg((F.sum(F.pow(F.coalesce("w", F.lit(0.0)) + F.coalesce("v", F.lit(0.0)), F.lit(2))) / 2).alias("s1"))
    ends = W.select(F.col("i").alias("k"), "w").unionByName(W.select(F.col("j").alias("k"), "w"))
    s2 = ends.groupBy("k").agg(F.sum("w").alias("t")).agg(F.sum(F.col("t") * F.col("t")).alias("s2"))
    n, s0 = F.col("n").cast("double"), F.col("s0")
    out = s.join(s1).join(s2).select(
        "n",
        (F.col("cross") / (s0 * F.col("var"))).alias("moran_i"),
        (-1 / (n - 1)).alias("expected"),
        ((n * n * F.col("s1") - n * F.col("s2") + 3 * s0 * s0) / ((n * n - 1) * s0 * s0) - 1 / ((n - 1) * (n - 1))).alias("variance"),
    )
    zs = (F.col("moran_i") - F.col("expected")) / F.sqrt("variance")
    out = out.where("n >= 10").withColumn("z", zs).withColumn("p", two_sided_p(F.col("z")))
    verdict = F.when(F.col("p") >= 0.05, "random").when(F.col("moran_i") > 0, "clustered").otherwise("dispersed")
    return out.withColumn("verdict", verdict)


def morans_by(df: DataFrame, W: DataFrame, y: str, by: str, key: str = "id") -> DataFrame:
    """Moran's I of each group: ``(by, n, moran_i, expected, z, p, verdict)``.

    Rows without a value are left out and the weights of the others are standardised
    again; all groups are made in the same joins. Under 10 rows I, z and p are null.
    """
    rows = df.where(F.col(y).isNotNull()).select(F.col(by).alias("_g"), F.col(key).alias("_k"), F.col(y).cast("double").alias("_y"))
    m = rows.groupBy("_g").agg(F.count("*").alias("n"), F.avg("_y").alias("mean"), F.var_pop("_y").alias("var"))
    z = rows.join(m, "_g").select("_g", "_k", (F.col("_y") - F.col("mean")).alias("z"))
    pairs = W.select("i", "j").join(z.select(F.col("_k").alias("i"), "_g", F.col("z").alias("zi")), "i").join(z.select(F.col("_k").alias("j"), "_g", F.col("z").alias("zj")), ["j", "_g"])
    pairs = pairs.withColumn("w", 1.0 / F.count("*").over(Window.partitionBy("_g", "i")))
    cross = pairs.groupBy("_g").agg(F.sum(F.col("w") * F.col("zi") * F.col("zj")).alias("cross"), F.sum("w").alias("s0"))
    # (w_ij + w_ji)^2 over both orders is twice w_ij^2 + w_ij * w_ji; rows and columns of W sum to the ends below
    back = pairs.select("_g", F.col("j").alias("i"), F.col("i").alias("j"), F.col("w").alias("v"))
    s1 = pairs.join(back, ["_g", "i", "j"], "left").groupBy("_g").agg(F.sum(F.col("w") * F.col("w") + F.col("w") * F.coalesce("v", F.lit(0.0))).alias("s1"))
    ends = pairs.select("_g", F.col("i").alias("k"), "w").unionByName(pairs.select("_g", F.col("j").alias("k"), "w"))
    s2 = ends.groupBy("_g", "k").agg(F.sum("w").alias("t")).groupBy("_g").agg(F.sum(F.col("t") * F.col("t")).alias("s2"))
    n, s0, enough = F.col("n").cast("double"), F.col("s0"), F.col("n") >= 10
    variance = (n * n * F.col("s1") - n * F.col("s2") + 3 * s0 * s0) / ((n * n - 1) * s0 * s0) - 1 / ((n - 1) * (n - 1))
    out = m.join(cross, "_g", "left").join(s1, "_g", "left").join(s2, "_g", "left")
    out = out.select(F.col("_g").alias(by), "n", F.when(enough & (F.col("var") > 0), F.col("cross") / (s0 * F.col("var"))).alias("moran_i"), F.when(enough, -1 / (n - 1)).alias("expected"), variance.alias("_v"))
    out = out.withColumn("z", (F.col("moran_i") - F.col("expected")) / F.sqrt(F.nullif(F.col("_v"), F.lit(0.0)))).withColumn("p", two_sided_p(F.col("z"))).drop("_v")
    return out.withColumn("verdict", F.when(F.col("p") >= 0.05, "random").when(F.col("moran_i") > 0, "clustered").when(F.col("moran_i") <= 0, "dispersed"))


def moran_gate(moran: DataFrame) -> DataFrame:
    """Whether local statistics are worth making: I above 0 with p under 0.05; strong from 0.3."""
    ok = (F.col("moran_i") > 0) & (F.col("p") < 0.05)
    return moran.withColumns({"gate": ok, "strength": F.when(ok & (F.col("moran_i") >= 0.3), "strong").when(ok, "moderate").otherwise("none")})


def hotspots(df: DataFrame, W: DataFrame, y: str, key: str = "id", alpha: float = 0.05, fdr: bool = True) -> DataFrame:
    """Getis-Ord Gi* with the area itself, p, and tiers of 90, 95 and 99% that pass the threshold.

    The threshold is that of the false discovery rate, or ``alpha`` itself without ``fdr``.
    """
    own = df.select(F.col(key).alias("i"), F.col(key).alias("j"), F.lit(1.0).alias("w"))
    full = W.select("i", "j", "w").unionByName(own)
    v = df.select(F.col(key).alias("j"), F.col(y).alias("_y")).hint("merge")
    sums = full.join(v, "j").groupBy(F.col("i").alias(key)).agg(F.sum(F.col("w") * F.col("_y")).alias("_wy"), F.sum("w").alias("_w"), F.sum(F.col("w") * F.col("w")).alias("_w2"))
    n = F.col("n")
    z = (F.col("_wy") - F.col("mean") * F.col("_w")) / (F.sqrt("var") * F.sqrt((n * F.col("_w2") - F.col("_w") * F.col("_w")) / (n - 1)))
    out = sums.join(_moments(df, y)).select(key, z.alias("gi_z")).withColumn("gi_p", two_sided_p(F.col("gi_z")))
    out = cut(out) if fdr else out  # the threshold reads it several times
    limit = fdr_threshold(out, "gi_p", alpha) if fdr else None
    out = out.join(F.broadcast(limit)) if fdr else out.withColumn("threshold", F.lit(alpha))
    a = F.abs("gi_z")
    level = F.when(F.col("gi_p") > F.col("threshold"), None).when(a >= 2.58, "(99%)").when(a >= 1.96, "(95%)").when(a >= 1.65, "(90%)")
    label = F.when(level.isNull(), "Not Significant").otherwise(F.concat(F.when(F.col("gi_z") > 0, "Hot Spot ").otherwise("Cold Spot "), level))
    return out.withColumn("tier", label)


def fdr_threshold(df: DataFrame, p: str, alpha: float = 0.05) -> DataFrame:
    """Benjamini-Hochberg: the largest ``i * alpha / n`` that the i-th smallest p meets, else ``alpha / n``."""
    rows = with_offsets(df, p)
    i = F.col("_before") + F.row_number().over(Window.partitionBy("_p").orderBy(p))
    bound = i * alpha / F.col("_all")
    met = rows.withColumns({"_b": bound}).agg(F.max(F.when(F.col(p) <= F.col("_b"), F.col("_b"))).alias("m"), F.max("_all").alias("n"))
    return met.select(F.coalesce("m", alpha / F.col("n")).alias("threshold"))


def lisa(df: DataFrame, W: DataFrame, y: str, key: str = "id") -> DataFrame:
    """Local Moran's I and its quadrant: 1 high-high, 2 low-high, 3 low-low, 4 high-low."""
    z = df.select(key, y).join(_moments(df, y)).select(key, (F.col(y) - F.col("mean")).alias("z"), "n", "var")
    l = lag(W, z, "z", key)
    out = z.join(l, key).withColumn("local_i", (F.col("n") - 1) * F.col("z") * F.col("lag") / (F.col("n") * F.col("var")))
    q = F.when((F.col("z") > 0) & (F.col("lag") > 0), 1).when((F.col("z") <= 0) & (F.col("lag") > 0), 2).when((F.col("z") <= 0) & (F.col("lag") <= 0), 3).otherwise(4)
    return out.select(key, "local_i", q.alias("quadrant"))


def permutation_p(df: DataFrame, W: DataFrame, y: str, n: int = 999, seed: int = 0, key: str = "id") -> DataFrame:
    """Pseudo p of Moran's I: seeded permutations of the values, ``(1 + as extreme) / (1 + n)``."""
    vals = df.select(key, F.col(y).alias("v"))
    runs = F.explode(F.sequence(F.lit(0), F.lit(n))).alias("run")
    by_id = Window.partitionBy("run").orderBy(key)
    shuffle = F.when(F.col("run") > 0, F.md5(F.concat_ws(":", F.lit(seed), "run", key))).otherwise(F.lit(""))
    by_hash = Window.partitionBy("run").orderBy(shuffle, key)
    base = vals.select(key, "v", runs).withColumns({"place": F.row_number().over(by_id), "drawn": F.row_number().over(by_hash)})
    drawn = base.select("run", key, "place").join(base.select("run", F.col("drawn").alias("place"), "v"), ["run", "place"])
    z = drawn.join(F.broadcast(vals.agg(F.avg("v").alias("m")))).select("run", key, (F.col("v") - F.col("m")).alias("z"))
    cross = W.join(z.select(F.col(key).alias("i"), "run", F.col("z").alias("a")), "i").join(z.select(F.col(key).alias("j"), "run", F.col("z").alias("b")), ["j", "run"])
    sums = cross.groupBy("run").agg(F.sum(F.col("w") * F.col("a") * F.col("b")).alias("s"))
    seen = F.broadcast(sums.where("run = 0").select(F.col("s").alias("s0")))
    return sums.where("run > 0").join(seen).agg(((1 + F.count_if(F.col("s") >= F.col("s0"))) / F.lit(1.0 + n)).alias("p_sim"))


def _gram(df: DataFrame, cols: Sequence[str]) -> np.ndarray:
    """Sums of products of all pairs of columns: one row on the driver."""
    pairs = [(a, b) for a in range(len(cols)) for b in range(a, len(cols))]
    row = df.agg(*(F.sum(F.col(cols[a]) * F.col(cols[b])).alias(f"s{k}") for k, (a, b) in enumerate(pairs))).first()
    out = np.zeros((len(cols), len(cols)))
    for k, (a, b) in enumerate(pairs):
        out[a, b] = out[b, a] = row[k] or 0.0
    return out


def ols_model(df: DataFrame, y: str, xs: Sequence[str]) -> DataFrame:
    """Least squares with intercept: coefficient, error, t, p and stars of each term, and the fit.

    The rows are summed by Spark; a matrix of one column for each term is solved on the driver.
    """
    rows = df.select(y, *xs).na.drop().withColumn("_one", F.lit(1.0))
    terms = ["_one", *xs]
    s = _gram(rows.select(*terms, y), [*terms, y])
    xtx, xty, yty, n, k = s[:-1, :-1], s[:-1, -1], s[-1, -1], s[0, 0], len(terms)
    inv = np.linalg.inv(xtx)
    beta = inv @ xty
    sse, sst = yty - beta @ xty, yty - xty[0] ** 2 / n
    err = np.sqrt(np.diag(inv) * sse / (n - k))
    t = beta / err
    p = [math.erfc(abs(v) / math.sqrt(2)) for v in t]
    r2 = 1 - sse / sst
    fit = (float(r2), float(1 - (1 - r2) * (n - 1) / (n - k)), float(n * math.log(sse / n) + 2 * k), int(n))
    stars = lambda v: "***" if v < 0.001 else "**" if v < 0.01 else "*" if v < 0.05 else ""
    out = [("intercept" if c == "_one" else c, float(b), float(e), float(v), float(q), stars(q), *fit) for c, b, e, v, q in zip(terms, beta, err, t, p)]
    return df.sparkSession.createDataFrame(out, "term string, coefficient double, std_error double, t double, p double, stars string, r2 double, adj_r2 double, aic double, n long")


def _beta(df: DataFrame, y: str, xs: Sequence[str]) -> np.ndarray:
    s = _gram(df.withColumn("_one", F.lit(1.0)), ["_one", *xs, y])
    return np.linalg.solve(s[:-1, :-1], s[:-1, -1])


def _fitted(b: np.ndarray, xs: Sequence[str]):
    return sum((F.col(x) * float(v) for x, v in zip(xs, b[1:])), F.lit(float(b[0])))


def lm_diagnostics(df: DataFrame, W: DataFrame, y: str, xs: Sequence[str], key: str = "id") -> DataFrame:
    """Lagrange multiplier tests for lag and error, plain and robust, with row-standardised ``W``."""
    rows = df.select(key, y, *xs).na.drop()
    n, b = rows.count(), _beta(rows, y, xs)
    rows = rows.withColumns({"_e": F.col(y) - _fitted(b, xs), "_f": _fitted(b, xs)})
    lags = rows
    for c in ("_e", y, "_f"):
        lags = lags.join(lag(W, rows, c, key).withColumnRenamed("lag", f"_w{c}"), key, "left").fillna(0.0, [f"_w{c}"])
    m = lags.agg(F.sum(F.col("_e") * F.col("_e")), F.sum(F.col("_e") * F.col("_w_e")), F.sum(F.col("_e") * F.col(f"_w{y}"))).first()
    s2, ewe, ewy = m[0] / n, m[1], m[2]
    back = W.select(F.col("j").alias("i"), F.col("i").alias("j"), F.col("w").alias("v"))
    t = W.agg(F.sum(F.col("w") * F.col("w"))).first()[0] + (W.join(back, ["i", "j"]).agg(F.sum(F.col("w") * F.col("v"))).first()[0] or 0.0)
    g2 = _beta(lags, "_w_f", xs)
    nj = lags.agg(F.sum(F.pow(F.col("_w_f") - _fitted(g2, xs), F.lit(2)))).first()[0] / s2 + t
    tests = {
        "lm_lag": (ewy / s2) ** 2 / nj,
        "lm_error": (ewe / s2) ** 2 / t,
        "robust_lag": (ewy / s2 - ewe / s2) ** 2 / (nj - t),
        "robust_error": (ewe / s2 - t / nj * ewy / s2) ** 2 / (t * (1 - t / nj)),
    }
    return df.sparkSession.createDataFrame([(k, float(v), math.erfc(math.sqrt(v / 2))) for k, v in tests.items()], "test string, statistic double, p double")


def choose_model(lm: DataFrame, alpha: float = 0.05) -> DataFrame:
    """``ols``, ``lag``, ``error`` or, where both plain tests pass, what the robust ones say."""
    p = lm.agg(*(F.max(F.when(F.col("test") == t, F.col("p"))).alias(t) for t in ("lm_lag", "lm_error", "robust_lag", "robust_error")))
    lag_, err = F.col("lm_lag") < alpha, F.col("lm_error") < alpha
    rl, re_ = F.col("robust_lag") < alpha, F.col("robust_error") < alpha
    both = F.when(rl & ~re_, "lag").when(re_ & ~rl, "error").when(F.col("robust_lag") <= F.col("robust_error"), "lag or error: lag first").otherwise("lag or error: error first")
    return p.withColumn("model", F.when(~lag_ & ~err, "ols").when(lag_ & ~err, "lag").when(err & ~lag_, "error").otherwise(both))


def spatial_lag_2sls(df: DataFrame, W: DataFrame, y: str, xs: Sequence[str], key: str = "id") -> DataFrame:
    """The lag model by two-stage least squares with ``WX`` and ``W(WX)`` as instruments."""
    rows = df.select(key, y, *xs).na.drop()
    full = rows.join(lag(W, rows, y, key).withColumnRenamed("lag", "_wy"), key, "left").fillna(0.0, ["_wy"])
    instruments = list(xs)
    for x in xs:
        for name, source in ((f"_w_{x}", x), (f"_ww_{x}", f"_w_{x}")):
            full = full.join(lag(W, full, source, key).withColumnRenamed("lag", name), key, "left").fillna(0.0, [name])
            instruments.append(name)
    full = full.withColumn("_hat", _fitted(_beta(full, "_wy", instruments), instruments))
    b = _beta(full, y, [*xs, "_hat"])
    return df.sparkSession.createDataFrame([(t, float(v)) for t, v in zip(["intercept", *xs, "rho"], b)], "term string, coefficient double")


def kde(points: DataFrame, res: int, bandwidth: float | None = None, pad: float = 0.1) -> DataFrame:
    """Gaussian density on a ``res`` by ``res`` grid, cut at four bandwidths and scaled to 0..1.

    The bandwidth is the mean deviation of the axes times ``n ** (-1/6)``; under five
    points there is no surface.
    """
    s = points.agg(F.count("*").alias("n"), F.stddev_pop("x").alias("sx"), F.stddev_pop("y").alias("sy"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")).first()
    if s.n < 5:
        raise ValueError("a surface needs five points")
    h = bandwidth or (s.sx + s.sy) / 2 * s.n ** (-1 / 6)
    dx, dy = (s.x1 - s.x0) * pad, (s.y1 - s.y0) * pad
    step_x, step_y = (s.x1 - s.x0 + 2 * dx) / (res - 1), (s.y1 - s.y0 + 2 * dy) / (res - 1)
    spark = points.sparkSession
    grid = spark.range(res).withColumnRenamed("id", "row").select("row", F.explode(F.sequence(F.lit(0), F.lit(res - 1))).alias("col"))
    grid = grid.select("row", F.col("col").cast("long").alias("col"), (F.lit(s.x0 - dx) + F.col("col") * step_x).alias("x"), (F.lit(s.y0 - dy) + F.col("row") * step_y).alias("y"))
    pairs = near_pairs(grid, points.select(F.col("x").alias("x2"), F.col("y").alias("y2")), 4 * h)
    dens = pairs.groupBy("row", "col").agg(F.sum(F.exp(-F.col("d") * F.col("d") / (2 * h * h))).alias("v"))
    out = grid.select("row", "col").join(dens, ["row", "col"], "left").fillna(0.0, ["v"]).withColumn("density", F.col("v") / (2 * math.pi * h * h * s.n))
    ends = F.broadcast(out.agg(F.min("density").alias("lo"), F.max("density").alias("hi")))
    return out.join(ends).select("row", "col", ((F.col("density") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0))).alias("density"))
