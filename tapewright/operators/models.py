"""Grouped model fits over microstructure tables: one row a group, all groups in one job.

Observations for price impact: ``symbol, venue, start_ms, x, y, average_depth``.
Forward rows: ``symbol, venue, ts_ms, horizon_ms, y_ticks`` and feature columns.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapewright.functions.columns import count_if, labelled, ratio, reasons, sum_if, total
from tapewright.functions.ranges import joined_by_key, with_counts_under, with_least_half, with_running_sum

KEYS = ("symbol", "venue")
BLOCK = (*KEYS, "block_ms")
#: Width of the time ranges into which a key's rows are dealt.
RANGE_MS = 3_600_000


# Cody's rational approximations of the error function (1969), from the highest power down, numerator and denominator.
# Of erf(x) / x in x² up to 15/32; of erfc(x) exp(x²) in x up to 4; and of (1/sqrt(pi) - x erfc(x) exp(x²)) x² in 1/x² beyond.
ERF_NEAR = (
    (1.85777706184603153e-1, 3.16112374387056560, 1.13864154151050156e2, 3.77485237685302021e2, 3.20937758913846947e3),
    (1.0, 2.36012909523441209e1, 2.44024637934444173e2, 1.28261652607737228e3, 2.84423683343917062e3),
)
ERFC_MIDDLE = (
    (2.15311535474403846e-8, 5.64188496988670089e-1, 8.88314979438837594, 6.61191906371416295e1, 2.98635138197400131e2, 8.81952221241769090e2, 1.71204761263407058e3, 2.05107837782607147e3, 1.23033935479799725e3),
    (1.0, 1.57449261107098347e1, 1.17693950891312499e2, 5.37181101862009858e2, 1.62138957456669019e3, 3.29079923573345963e3, 4.36261909014324716e3, 3.43936767414372164e3, 1.23033935480374942e3),
)
ERFC_FAR = (
    (1.63153871373020978e-2, 3.05326634961232344e-1, 3.60344899949804439e-1, 1.25781726111229246e-1, 1.60837851487422766e-2, 6.58749161529837803e-4),
    (1.0, 2.56852019228982242, 1.87295284992346725, 5.27905102951428412e-1, 6.05183413124413191e-2, 2.33520497626869185e-3),
)


def _fraction(x: Column, parts: tuple[Sequence[float], Sequence[float]]) -> Column:
    """A numerator's polynomial in ``x`` over a denominator's."""
    over, under = (reduce(lambda sum_, c: sum_ * x + F.lit(c), part[1:], F.lit(part[0])) for part in parts)
    return over / under


def norm_cdf(z: Column | str) -> Column:
    """The standard normal distribution function, right to 1e-15; null of null and NaN.

    Spark has no error function; fractions of polynomials keep it a column expression.
    """
    z = (F.col(z) if isinstance(z, str) else z).cast("double")
    # Beyond 40 the tail is zero to the last bit, and powers stay finite.
    x = F.greatest(F.lit(-40.0), F.least(F.lit(40.0), z)) / math.sqrt(2)
    y = F.abs(x)
    inverse = 1 / F.greatest(y * y, F.lit(1.0))
    far = (1 / math.sqrt(math.pi) - inverse * _fraction(inverse, ERFC_FAR)) / F.greatest(y, F.lit(1.0))
    tail = F.exp(-y * y) * F.when(y <= 4, _fraction(y, ERFC_MIDDLE)).otherwise(far) / 2
    near = 0.5 + x * _fraction(x * x, ERF_NEAR) / 2
    return F.when(z.isNotNull() & ~F.isnan(z), F.when(y <= 15 / 32, near).when(x < 0, tail).otherwise(1 - tail))


def content_hash(columns: Sequence[str]) -> Column:
    """SHA-256 of a row's named columns as canonical JSON: sorted names, nulls kept."""
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"}).cast("binary"), 256)


def set_hash(columns: Sequence[str], places: int | None = None) -> Column:
    """Aggregate: a fingerprint of a group's rows that doesn't depend on their order; equal rows count. ``places``: numbers are rounded first."""
    h = F.xxhash64(*[F.col(c) if places is None else F.round(c, places) for c in sorted(columns)])
    return F.sha2(F.concat_ws(":", F.count("*").cast("string"), F.sum(h.cast("decimal(38,0)")).cast("string"), F.bit_xor(h).cast("string")).cast("binary"), 256)


def required_flow(change: Column, drift: Column, beta: Column) -> Column:
    """Flow that brings the change; null if the slope is zero."""
    return F.when(F.abs(beta) >= 1e-18, (change - drift) / beta)


def fit_price_impact(observations: DataFrame, block_ms: int = 1_800_000, least: int = 30) -> DataFrame:
    """Least squares of mid change on flow a block, with robust slope error, fit and status.

    ``insufficient``: under ``least`` observations or flow without variance;
    ``provisional``: under twice as many, uneven residuals or no R²; else
    ``validated``. Uneven: the mean squared residuals of the halves by distance
    of x from its mean (ties by residual) differ more than twofold.
    """
    rows = observations.withColumn("block_ms", F.col("start_ms") - F.pmod("start_ms", F.lit(block_ms)))
    n, x, y = F.count("*"), F.col("x"), F.col("y")
    fit = rows.groupBy(*BLOCK).agg(
        n.alias("n"), F.avg("x").alias("xbar"), F.avg("y").alias("ybar"), (F.var_pop("x") * n).alias("sxx"), (F.covar_pop("x", "y") * n).alias("sxy"), (F.var_pop("y") * n).alias("sst"), F.avg("average_depth").alias("mean_ad")
    )
    beta = F.coalesce(F.when(F.col("sxx") > 1e-12, F.col("sxy") / F.col("sxx")), F.lit(0.0))
    fit = fit.withColumn("beta", beta).withColumn("alpha", F.col("ybar") - F.col("beta") * F.col("xbar"))
    far, e = F.round(F.abs(x - F.col("xbar")), 9), y - F.col("alpha") - F.col("beta") * x
    scored = rows.join(fit.select(*BLOCK, "n", "alpha", "beta", "xbar"), list(BLOCK)).select(*BLOCK, "n", far.alias("far"), F.round(e, 9).alias("e"))
    near = F.row_number().over(Window.partitionBy(*BLOCK).orderBy("far", "e")) <= F.floor(F.col("n") / 2)
    e2 = F.col("e") * F.col("e")
    spread = scored.withColumn("near", near).groupBy(*BLOCK).agg(
        F.sum(e2).alias("ssr"), F.sum(e2 * F.col("far") * F.col("far")).alias("hc0"),
        (sum_if(F.col("near"), e2) / F.greatest(count_if(F.col("near")), F.lit(1))).alias("low_sq"), (sum_if(~F.col("near"), e2) / F.greatest(count_if(~F.col("near")), F.lit(1))).alias("high_sq"),
    )
    varies = (F.col("sxx") > 1e-12) & (F.col("n") > 1)
    uneven = (F.col("high_sq") > F.col("low_sq") * 2) | (F.col("low_sq") > F.col("high_sq") * 2)
    r2 = F.when(varies & (F.col("sst") > 1e-12), 1 - F.col("ssr") / F.col("sst"))
    status = labelled((~varies | (F.col("n") < least), "insufficient"), ((F.col("n") < 2 * least) | uneven | r2.isNull(), "provisional"), default="validated")
    return fit.join(spread, list(BLOCK)).select(
        *BLOCK, "n", "alpha", "beta", F.when(varies, F.sqrt("hc0") / F.col("sxx")).alias("stderr_beta"), r2.alias("r2"),
        F.when(varies & (F.col("n") > 2), F.sqrt(F.col("ssr") / (F.col("n") - 2))).alias("residual_std"), (varies & uneven).alias("hetero"), "mean_ad", status.alias("status"),
    )


def fit_depth_scaling(fits: DataFrame, least_blocks: int = 3) -> DataFrame:
    """ln(beta) = ln(c) - lambda ln(depth) over a key's usable blocks; null coefficients below ``least_blocks`` or for one depth."""
    usable = F.col("status").isin("validated", "provisional") & (F.col("mean_ad") > 0) & (F.col("beta") > 0)
    lx, ly = F.ln("mean_ad"), F.ln("beta")
    logs = fits.select(*KEYS, F.when(usable, lx).alias("lx"), F.when(usable, ly).alias("ly"))
    s = logs.groupBy(*KEYS).agg(
        F.count("lx").alias("n_blocks"), F.avg("lx").alias("xb"), F.avg("ly").alias("yb"), F.var_pop("lx").alias("vx"), F.covar_pop("lx", "ly").alias("cxy"), F.var_pop("ly").alias("vy")
    )
    ok = (F.col("n_blocks") >= least_blocks) & (F.col("vx") > 1e-15)
    slope = F.col("cxy") / F.col("vx")
    return s.select(
        *KEYS, "n_blocks", F.when(ok, F.exp(F.col("yb") - slope * F.col("xb"))).alias("c"), F.when(ok, -slope).alias("lambda"),
        F.when(ok & (F.col("vy") > 1e-15), F.col("cxy") * F.col("cxy") / (F.col("vx") * F.col("vy"))).alias("r2"),
        labelled((~ok | ok.isNull(), "insufficient"), (F.col("n_blocks") < 2 * least_blocks, "provisional"), default="validated").alias("status"),
    )


def derive_price_delta(fits: DataFrame, depth: DataFrame, latest: DataFrame) -> DataFrame:
    """Change in ticks for the latest flow (``ofi, average_depth`` a key): direct with its band, and by depth scaling, and how far they agree."""
    f = fits.where("status in ('validated', 'provisional')")
    j = f.join(latest.select(*KEYS, "ofi", F.col("average_depth").alias("ad")), list(KEYS)).join(depth.select(*KEYS, "c", F.col("lambda").alias("lam")), list(KEYS), "left")
    direct = F.col("alpha") + F.col("beta") * F.col("ofi")
    implied = F.when((F.col("c") > 0) & (F.col("ad") > 0), F.col("c") * F.exp(-F.col("lam") * F.ln("ad")))
    scaled = F.col("alpha") + implied * F.col("ofi")
    return j.select(
        *BLOCK, "ofi", direct.alias("delta_ticks"), (F.lit(1.96) * F.col("stderr_beta") * F.abs("ofi")).alias("band_95"), implied.alias("beta_implied"), scaled.alias("delta_scaled"), F.abs(direct - scaled).alias("agreement")
    )


def rolling_flow(intervals: DataFrame, n: int) -> DataFrame:
    """All sums of ``n`` consecutive intervals, by their first; ``usable`` where every interval is exact."""
    w = Window.partitionBy(*KEYS).orderBy("start_ms").rowsBetween(0, n - 1)
    return intervals.select(
        *KEYS, "start_ms", F.sum("ofi").over(w).alias("flow"), (F.count("*").over(w) == n).alias("full"), (F.min(F.when(F.col("quality") == "exact_feed", 1).otherwise(0)).over(w) == 1).alias("usable")
    ).where("full").drop("full")


def evaluate_scenario(fits: DataFrame, intervals: DataFrame, targets: DataFrame, n: int = 6, least_windows: int = 30) -> DataFrame:
    """Flow needed for each target (``symbol, venue, delta_req``) over ``n`` intervals, and how often the tape had it.

    The slope's band gives a range of both. Targets without enough usable
    windows have no exceedance.
    """
    f = fits.where("status in ('validated', 'provisional')").select(*BLOCK, "alpha", "beta", "stderr_beta")
    drift = F.col("alpha") * n
    half = F.col("stderr_beta") * 1.96
    need = targets.join(f, list(KEYS)).where("delta_req <> 0").select(
        *BLOCK, "delta_req", required_flow(F.col("delta_req"), drift, F.col("beta")).alias("required"),
        required_flow(F.col("delta_req"), drift, F.col("beta") - half).alias("edge_a"), required_flow(F.col("delta_req"), drift, F.col("beta") + half).alias("edge_b"),
    )
    need = need.withColumn("lo", F.least("edge_a", "edge_b")).withColumn("hi", F.greatest("edge_a", "edge_b"))
    windows = rolling_flow(intervals, n)
    # Every threshold is counted once against the key's flows in their order; windows and thresholds aren't paired.
    names = ("required", "lo", "hi")
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("which"), F.col(c).alias("at")) for c in names]))
    asked = need.select(*BLOCK, "delta_req", *names, each.alias("a")).select(*BLOCK, "delta_req", *names, "a.*")
    flows = windows.select(*KEYS, F.when(F.col("usable"), F.col("flow")).alias("flow"))
    counted = with_counts_under(asked, "at", F.col("delta_req") < 0, flows, "flow", KEYS, ("under", "n_usable", "n_degraded"))
    # From the threshold up, or down to it.
    hits = F.when(F.col("delta_req") > 0, F.col("n_usable") - F.col("under")).otherwise(F.col("under"))
    s = counted.groupBy(*BLOCK, "delta_req", *names, "n_usable", "n_degraded").agg(*[F.coalesce(F.max(F.when(F.col("which") == c, hits)), F.lit(0)).alias(f"hits_{c}") for c in names])
    enough = F.col("n_usable") >= least_windows
    share = lambda c: F.when(enough & F.col(c).isNotNull(), F.col(f"hits_{c}") / F.col("n_usable"))
    return s.select(
        *BLOCK, "delta_req", "required", F.col("lo").alias("required_lo"), F.col("hi").alias("required_hi"), "n_usable", "n_degraded",
        share("required").alias("exceedance"), share("lo").alias("exceedance_lo"), share("hi").alias("exceedance_hi"),
    )


HORIZON = (*KEYS, "horizon_ms")
MODEL_VERSION, SPLIT = "forward-ols-hc0-1", "time-ordered-70/30"


def labelled_vectors(vectors: DataFrame, labels: DataFrame, features: Sequence[str]) -> DataFrame:
    """Labelled vectors with every feature."""
    return labels.where("y_ticks is not null").join(vectors.select(*KEYS, "ts_ms", "update_id", *features), [*KEYS, "ts_ms", "update_id"]).dropna(subset=list(features))


def complete_cases(rows: DataFrame) -> DataFrame:
    """Labelled vectors, numbered by time; ``train`` marks the first seventy percent. Reads ``rows`` several times."""
    numbered = with_running_sum(rows, HORIZON, ("ts_ms", "update_id"), F.lit(1), "rn", RANGE_MS)
    numbered = joined_by_key(numbered, rows.groupBy(*HORIZON).agg(F.count("*").alias("n")), HORIZON)
    return numbered.withColumn("train", F.col("rn") <= F.greatest(F.lit(1), F.floor(F.col("n") * 0.7)))


def _gram(design: Sequence[Column], y: Column, keep: Column, name: str) -> list[Column]:
    """Aggregates: the products of the design with itself and with y, as two arrays."""
    pairs = [(i, j) for i in range(len(design)) for j in range(i, len(design))]
    xx = F.array(*[F.sum(F.when(keep, design[i] * design[j]).otherwise(0.0)) for i, j in pairs])
    xy = F.array(*[F.sum(F.when(keep, d * y).otherwise(0.0)) for d in design])
    return [xx.alias(f"xx_{name}"), xy.alias(f"xy_{name}")]


def _symmetric(flat: Sequence[float], k: int) -> np.ndarray:
    m = np.zeros((k, k))
    m[np.triu_indices(k)] = flat
    return m + np.triu(m, 1).T


def _solve(xx: np.ndarray, xy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients and inverse; columns that don't vary besides the intercept get zeros."""
    k = len(xy)
    n = max(xx[0, 0], 1.0)
    varies = np.array([i == 0 or xx[i, i] / n - (xx[0, i] / n) ** 2 > 1e-12 for i in range(k)])
    use = np.flatnonzero(varies)
    inverse, beta = np.zeros((k, k)), np.zeros(k)
    inverse[np.ix_(use, use)] = np.linalg.pinv(xx[np.ix_(use, use)])
    beta[use] = inverse[np.ix_(use, use)] @ xy[use]
    return beta, inverse


def _design(features: Sequence[str]) -> list[Column]:
    return [F.lit(1.0), *[F.col(f).cast("double") for f in features]]


def _dot(beta: Column, design: Sequence[Column]) -> Column:
    return total([F.element_at(beta, i + 1) * d for i, d in enumerate(design)])


def forward_coefficients(rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """Per horizon: coefficients on all rows, on the training rows and of the first feature alone, and the inverse, from distributed sums.

    ``rows`` come from ``complete_cases``. Only the k by k systems, one row a group, are solved in Python.
    """
    design, k = _design(features), len(features) + 1
    y, train = F.col("y_ticks"), F.col("train")
    sums = rows.groupBy(*HORIZON).agg(
        F.count("*").alias("n_obs"), count_if(train).alias("n_train"), F.avg(y).alias("ybar"), F.avg(F.when(train, y)).alias("train_ybar"),
        set_hash(["ts_ms", "update_id", "y_ticks", *features], 6).alias("input_hash"), *_gram(design, y, F.lit(True), "all"), *_gram(design, y, train, "train"), *_gram([F.lit(1.0), F.col(features[0]).cast("double")], y, train, "base"),
    )
    cols = "symbol string, venue string, horizon_ms int, n_obs long, n_train long, ybar double, train_ybar double, beta array<double>, train_beta array<double>, base_beta array<double>, inverse array<double>, input_hash string"

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = b[["symbol", "venue", "horizon_ms", "n_obs", "n_train", "ybar", "train_ybar", "input_hash"]].copy()
            alls = [_solve(_symmetric(x, k), np.array(v)) for x, v in zip(b["xx_all"], b["xy_all"], strict=True)]
            out["beta"] = [s[0].tolist() for s in alls]
            out["train_beta"] = [_solve(_symmetric(x, k), np.array(v))[0].tolist() for x, v in zip(b["xx_train"], b["xy_train"], strict=True)]
            out["base_beta"] = [_solve(_symmetric(x, 2), np.array(v))[0].tolist() for x, v in zip(b["xx_base"], b["xy_base"], strict=True)]
            out["inverse"] = [s[1].reshape(-1).tolist() for s in alls]
            yield out[[c.split()[0] for c in cols.split(", ")]]

    return sums.mapInPandas(solve, cols)


def fit_forward_ols(rows: DataFrame, features: Sequence[str], least: int = 30, solved: DataFrame | None = None) -> DataFrame:
    """Per horizon: coefficients on all and on the training rows, robust errors, in- and out-of-sample fit, status, and pins of model, features and input.

    ``solved`` are the rows' ``forward_coefficients``; they are read several times, so give them written where there are many rows.
    """
    solved = forward_coefficients(rows, features) if solved is None else solved
    names, design, k = ["intercept", *features], _design(features), len(features) + 1
    y, train = F.col("y_ticks"), F.col("train")
    e = y - _dot(F.col("beta"), design)
    oe = y - _dot(F.col("train_beta"), design)
    be = y - _dot(F.col("base_beta"), [F.lit(1.0), F.col(features[0]).cast("double")])
    scored = joined_by_key(rows, solved.select(*HORIZON, "beta", "train_beta", "base_beta", "ybar", "train_ybar"), HORIZON)
    sq = lambda c: c * c
    far = F.round(F.abs(_dot(F.col("beta"), design) - F.col("ybar")), 9)
    scored = with_least_half(scored.withColumn("e", e).withColumn("oe", oe).withColumn("be", be).withColumn("far", far), HORIZON, "far", "rn", "near")
    meat = F.array(*[F.sum(sq(F.col("e")) * design[i] * design[j]) for i in range(k) for j in range(i, k)])
    test = ~train
    stats = scored.groupBy(*HORIZON).agg(
        F.sum(sq(F.col("e"))).alias("ssr"), F.sum(sq(y - F.col("ybar"))).alias("sst"), meat.alias("meat"), count_if(test).alias("n_oos"), sum_if(test, sq(F.col("oe"))).alias("oos_sse"),
        sum_if(test, F.abs("oe")).alias("oos_sae"), sum_if(test, sq(y - F.col("train_ybar"))).alias("oos_sst"), sum_if(test, sq(F.col("be"))).alias("base_sse"), sum_if(train, sq(F.col("oe"))).alias("train_ssr"),
        F.avg(F.when(F.col("near"), sq(F.col("e")))).alias("low_sq"), F.avg(F.when(~F.col("near"), sq(F.col("e")))).alias("high_sq"),
    )

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def errors(inverse: pd.Series, meat: pd.Series) -> pd.Series:
        out = []
        for inv, m in zip(inverse, meat, strict=True):
            inv = np.asarray(inv).reshape(k, k)
            out.append(np.sqrt(np.maximum(np.diag(inv @ _symmetric(m, k) @ inv), 0)).tolist())
        return pd.Series(out)

    j = solved.join(stats, list(HORIZON))
    hetero = F.coalesce((F.col("high_sq") > F.col("low_sq") * 2) | (F.col("low_sq") > F.col("high_sq") * 2), F.lit(False))
    skill = F.when(F.col("oos_sst") > 1e-12, 1 - F.col("oos_sse") / F.col("oos_sst"))
    base = F.when(F.col("oos_sst") > 1e-12, 1 - F.col("base_sse") / F.col("oos_sst"))
    thin = (F.col("n_oos") < least) | skill.isNull() | (F.col("n_train") < least)
    validation = labelled((F.col("n_obs") < least, "unvalidated"), (thin, "unvalidated"), ((skill > 0) & base.isNotNull() & ~hetero, "validated"), default="provisional")
    named = F.array(*[F.lit(n) for n in names])
    return j.select(
        *HORIZON, "n_obs", "n_train", "n_oos", F.map_from_arrays(named, "beta").alias("betas"), F.map_from_arrays(named, errors("inverse", "meat")).alias("stderr"), F.map_from_arrays(named, "train_beta").alias("oos_betas"),
        F.when(F.col("sst") > 1e-12, 1 - F.col("ssr") / F.col("sst")).alias("r2"), F.when(F.col("n_obs") > k, F.sqrt(F.col("ssr") / (F.col("n_obs") - k))).alias("resid_std"),
        F.when(F.col("n_train") > k, F.sqrt(F.col("train_ssr") / (F.col("n_train") - k))).alias("oos_resid_std"), hetero.alias("hetero"), skill.alias("oos_skill"),
        ratio("oos_sae", "n_oos").alias("oos_mae"), F.sqrt(ratio("oos_sse", "n_oos")).alias("oos_rmse"), base.alias("baseline_oos_r2"),
        labelled((F.col("n_obs") < least, "insufficient"), default="fitted").alias("estimation_status"), validation.alias("validation_status"),
        labelled((F.col("n_obs") < least, "insufficient"), (validation == "validated", "validated"), default="provisional").alias("status"),
        F.lit(MODEL_VERSION).alias("model_version"), F.lit(SPLIT).alias("split_method"), F.sha2(F.lit(",".join(names)), 256).alias("feature_schema_hash"), "input_hash",
    )


def expected_ticks(betas: Column, features: Sequence[str]) -> Column:
    """Intercept plus coefficients times features; a null feature makes it null."""
    return total([F.element_at(betas, "intercept"), *[F.element_at(betas, f) * F.col(f) for f in features]])


def predict_distribution(fits: DataFrame, vectors: DataFrame, features: Sequence[str], calibration: DataFrame, theta: float = 1.0) -> DataFrame:
    """Mean, variance, interval and, where validation and calibration passed, probabilities of each vector and horizon."""
    j = vectors.dropna(subset=list(features)).join(fits.where("status <> 'insufficient'").select(*HORIZON, "betas", "resid_std", "validation_status"), list(KEYS)).join(calibration.select(*HORIZON, F.col("status").alias("calibration_status")), list(HORIZON), "left")
    mu, s = expected_ticks(F.col("betas"), features), F.col("resid_std")
    allowed = F.coalesce((F.col("calibration_status") == "passed") & (F.col("validation_status") == "validated") & (s > 0), F.lit(False))
    out = j.select(*HORIZON, "ts_ms", "update_id", mu.alias("expected_ticks"), s.alias("resid_std"), allowed.alias("allowed"))
    mu = F.col("expected_ticks")
    gate = lambda z: F.when(F.col("allowed"), norm_cdf(z))
    return out.select(
        *HORIZON, "ts_ms", "update_id", "expected_ticks", (s * s).alias("variance_ticks"), (mu - s * 1.96).alias("interval_lo_95"), (mu + s * 1.96).alias("interval_hi_95"),
        gate(mu / s).alias("p_positive"), gate((mu - theta) / s).alias("p_above_theta"), labelled((F.col("allowed"), "model_implied"), default="refused").alias("probability_status"),
    )


def calibration_report(fits: DataFrame, rows: DataFrame, features: Sequence[str], bins: int = 10, theta: float = 0.0, least: int = 30, least_bin: int = 5, most_error: float = 0.1) -> DataFrame:
    """Out-of-sample reliability: bins of predicted chances against what happened, and whether the gate is passed."""
    test = joined_by_key(rows.where("not train"), fits.select(*HORIZON, "oos_betas", "oos_resid_std"), HORIZON).where("oos_resid_std > 0")
    p = test.select(*HORIZON, norm_cdf((expected_ticks(F.col("oos_betas"), features) - theta) / F.col("oos_resid_std")).alias("p"), (F.col("y_ticks") > theta).cast("double").alias("hit"))
    binned = p.groupBy(*HORIZON, F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).alias("bin")).agg(F.count("*").alias("n"), F.avg("p").alias("predicted"), F.avg("hit").alias("realized"))
    error = F.abs(F.col("predicted") - F.col("realized"))
    s = binned.groupBy(*HORIZON).agg(F.sum("n").alias("n"), F.count("*").alias("bins_used"), F.min("n").alias("least_bin"), F.max(error).alias("max_bin_error"))
    ok = (F.col("bins_used") == bins) & (F.col("least_bin") >= least_bin) & (F.col("max_bin_error") <= most_error)
    return s.withColumn("status", labelled((F.col("n") < least, "insufficient"), (ok, "passed"), default="failed"))


def forward_scenario(fits: DataFrame, latest: DataFrame, features: Sequence[str], calibration: DataFrame, targets: Sequence[float]) -> DataFrame:
    """Chances of reaching targets (ticks from now) from each key's latest vector, with bands from the coefficients' errors.

    Strictly gated: null unless validation and calibration passed.
    """
    j = latest.dropna(subset=list(features)).join(fits.where("status <> 'insufficient'"), list(KEYS)).join(calibration.select(*HORIZON, F.col("status").alias("calibration_status")), list(HORIZON), "left")
    sq = lambda c: c * c
    se = F.sqrt(total([sq(F.element_at("stderr", "intercept")), *[sq(F.element_at("stderr", f) * F.abs(f)) for f in features]]))
    allowed = F.coalesce((F.col("calibration_status") == "passed") & (F.col("validation_status") == "validated") & (F.col("resid_std") > 0), F.lit(False))
    rows = j.select(*HORIZON, expected_ticks(F.col("betas"), features).alias("mu"), F.col("resid_std").alias("s"), se.alias("se"), allowed.alias("allowed"), F.explode(F.array(*[F.lit(float(t)) for t in targets])).alias("target_ticks"))
    up = F.col("target_ticks") > 0
    # The chance of ending at or beyond the target, on its side.
    side = F.when(up, 1.0).otherwise(-1.0)
    chance = lambda mu: F.when(F.col("allowed"), norm_cdf(side * (mu - F.col("target_ticks")) / F.col("s")))
    mu, band = F.col("mu"), F.col("se") * 1.96
    lo, hi = chance(mu - band), chance(mu + band)
    return rows.select(*HORIZON, "target_ticks", mu.alias("expected_ticks"), "se", chance(mu).alias("p"), F.least(lo, hi).alias("p_lo"), F.greatest(lo, hi).alias("p_hi"), labelled((F.col("allowed"), "validated"), default="refused").alias("probability_status"))


def skill_decay(fits: DataFrame) -> DataFrame:
    """Out-of-sample skill by horizon; horizons without validated skill say so."""
    ok = (F.col("status") != "insufficient") & (F.col("validation_status") == "validated") & F.col("oos_skill").isNotNull()
    return fits.select(*HORIZON, "oos_skill", "n_oos", "status", "validation_status", ok.alias("finalized"), F.when(~ok, "no validated skill").alias("null_result"))


def bridge_horizon(fits: DataFrame, horizons_ms: Sequence[int] = (900_000, 3_600_000, 14_400_000)) -> DataFrame:
    """Native fits carried to long horizons: deviation times the root of the ratio, skill divided by it; never more than provisional."""
    scale = F.sqrt(F.col("long_ms") / F.col("horizon_ms"))
    return fits.withColumn("long_ms", F.explode(F.array(*[F.lit(h) for h in horizons_ms]))).select(
        *KEYS, F.col("horizon_ms").alias("source_horizon_ms"), F.col("long_ms").alias("horizon_ms"), scale.alias("sigma_scale"), (F.col("resid_std") * scale).alias("resid_std"), (F.col("oos_skill") / scale).alias("oos_skill"),
        labelled((F.col("status") == "insufficient", "insufficient"), default="provisional").alias("status"), F.lit("extrapolated").alias("validation_status"),
    )


def hypothesis_test(fits: DataFrame, rows: DataFrame, features: Sequence[str], tests: int = 1, method: str = "bonferroni") -> DataFrame:
    """One-sided test that the expected change at the mean features is positive, adjusted for the number of tests (``method``: none for a single one, bonferroni or holm)."""
    means = rows.groupBy(*HORIZON).agg(F.count("*").alias("n"), *[F.avg(f).alias(f) for f in features])
    j = fits.where("status <> 'insufficient'").join(means, list(HORIZON))
    sq = lambda c: c * c
    se = F.sqrt(total([sq(F.element_at("stderr", "intercept")), *[sq(F.element_at("stderr", f) * F.abs(f)) for f in features]]))
    e = j.select(*HORIZON, "n", "oos_skill", "status", expected_ticks(F.col("betas"), features).alias("effect"), F.when(se > 0, se).alias("se"))
    label = "none-prereg-single" if method == "none" and tests == 1 else f"{'holm' if method == 'holm' else 'bonferroni'}-m={tests}"
    p = F.least(F.lit(1.0), (1 - norm_cdf(F.col("effect") / F.col("se"))) * tests)
    return e.select(
        *HORIZON, "n", "effect", "se", (F.col("effect") - F.col("se") * 1.96).alias("ci_lo"), (F.col("effect") + F.col("se") * 1.96).alias("ci_hi"), p.alias("p_value"),
        F.lit(label).alias("multiplicity_adj"), F.lit(tests).alias("m_tests"), labelled((F.col("n") < 30, "insufficient"), default=None).alias("thin"), "status",
    )


PINS = ("model_version", "input_hash", "feature_schema_hash")


def discipline_audit(
    fits: DataFrame, calibration: DataFrame | None = None, cost_statement: str | None = None, labels: DataFrame | None = None, regime_qualified: bool = False, hypotheses: DataFrame | None = None
) -> DataFrame:
    """Per key: the ten quality checks of its fits, the open ones, and go or no-go.

    ``labels``: the forward rows with their exclusions (every row without a
    value must say why); ``regime_qualified``: fits are of one regime or pooled
    on purpose; ``hypotheses``: claims with ``m_tests`` and ``multiplicity_adj``
    (none claimed: nothing to adjust).
    """
    rows = fits if calibration is None else fits.join(calibration.select(*HORIZON, F.col("status").alias("calibration_status")), list(HORIZON), "left")
    every = lambda c: F.bool_and(F.coalesce(c, F.lit(False)))
    pinned = F.size("betas") > 1
    for pin in PINS:
        pinned = pinned & F.col(pin).isNotNull() & (F.col(pin) != "")
    timed = (F.col("n_oos") >= 30) & F.col("oos_skill").isNotNull() & (F.col("split_method") == SPLIT) & (F.col("validation_status") == "validated")
    s = rows.groupBy(*KEYS).agg(
        F.count("*").alias("horizons"), every(F.col("estimation_status") == "fitted").alias("estimation"), every(timed).alias("time_order"),
        every(F.col("baseline_oos_r2").isNotNull()).alias("baseline_comparison"), (F.count_distinct("horizon_ms") == F.count("*")).alias("horizon_separation"), every(pinned).alias("version_pins"),
        (every(F.col("calibration_status") == "passed") if calibration is not None else F.bool_and(F.lit(True))).alias("calibration"), F.bool_and(F.lit(bool(cost_statement))).alias("cost_statement"), F.bool_and(F.lit(regime_qualified)).alias("regime_separation"),
    )

    def with_check(s: DataFrame, table: DataFrame | None, ok: Column, name: str, missing: bool) -> DataFrame:
        if table is None:
            return s.withColumn(name, F.lit(missing))
        found = table.groupBy(*KEYS).agg(every(ok).alias(name))
        return s.join(found, list(KEYS), "left").withColumn(name, F.coalesce(name, F.lit(missing)))

    s = with_check(s, labels, F.col("y_ticks").isNotNull() | F.col("excluded").isNotNull(), "leakage", False)
    s = with_check(s, hypotheses, (F.col("m_tests") >= 1) & (F.col("multiplicity_adj") != ""), "multiplicity", True)
    checks = [c for c in s.columns if c not in (*KEYS, "horizons")]
    return s.withColumn("open_violations", reasons(*[(~F.col(c), c) for c in checks])).withColumn("verdict", labelled((F.size("open_violations") == 0, "go"), default="no-go"))


def prior_block_fits(fits: DataFrame, keep: int = 8) -> DataFrame:
    """The newest distinct fits of each key, at most ``keep``."""
    newest = Window.partitionBy(*KEYS).orderBy(F.col("block_ms").desc())
    return fits.dropDuplicates([*BLOCK]).withColumn("rank", F.row_number().over(newest)).where(F.col("rank") <= keep)


def assemble_evidence(primary: DataFrame, queue_only: DataFrame, depth: DataFrame) -> DataFrame:
    """One row a key: its newest fit on all flow and on queue flow, and its depth scaling."""
    newest = lambda fits, tag: fits.groupBy(*KEYS).agg(F.max("block_ms").alias("block_ms")).join(fits, list(BLOCK)).select(*KEYS, F.col("block_ms").alias(f"{tag}_block_ms"), *[F.col(c).alias(f"{tag}_{c}") for c in ("n", "beta", "r2", "status")])
    d = depth.select(*KEYS, "n_blocks", "c", F.col("lambda").alias("depth_lambda"), F.col("status").alias("depth_status"))
    return newest(primary, "primary").join(newest(queue_only, "queue"), list(KEYS), "left").join(d, list(KEYS), "left")


def append_hypotheses(stored: DataFrame, new: DataFrame, columns: Sequence[str], key: str = "hypothesis_id") -> tuple[DataFrame, DataFrame]:
    """The ledger with new ids added, and the conflicts: known ids whose content differs. Equal content again changes nothing."""
    fresh = new.join(stored.select(key), key, "left_anti")
    known = stored.select(key, content_hash(columns).alias("stored_hash"))
    conflicts = new.withColumn("new_hash", content_hash(columns)).join(known, key).where("stored_hash <> new_hash")
    return stored.unionByName(fresh), conflicts.select(key, "stored_hash", "new_hash")
