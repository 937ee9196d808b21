"""Forward fits and what is derived from them, against numpy on the same cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapewright.operators import models
from tapewright.plans import micro as pm
from tapewright.plans import models as plans
from tapewright.sources.views import Market

FEATURES = plans.FEATURES
KEY = ["symbol", "venue", "horizon_ms"]


def phi(z):
    return 0.5 * (1 + math.erf(z / math.sqrt(2)))


@pytest.fixture(scope="module")
def market(spark, sf_dir):
    return Market(spark, sf_dir)


@pytest.fixture(scope="module")
def parts(market):
    rows, fits, calibration = plans.calibrated(market)
    return rows, fits, calibration


def solved(x, y):
    """Least squares without the columns that don't vary."""
    use = [0] + [j for j in range(1, x.shape[1]) if x[:, j].var() > 1e-12]
    beta, inverse = np.zeros(x.shape[1]), np.zeros((x.shape[1], x.shape[1]))
    inverse[np.ix_(use, use)] = np.linalg.pinv(x[:, use].T @ x[:, use])
    beta[use] = inverse[np.ix_(use, use)] @ x[:, use].T @ y
    return beta, inverse


@pytest.fixture(scope="module")
def want(parts):
    """By key and horizon, what the fit must say."""
    out = {}
    for key, g in parts[0].toPandas().groupby(KEY):
        g = g.sort_values(["ts_ms", "update_id"])
        x, y = np.c_[np.ones(len(g)), g[FEATURES].to_numpy(float)], g["y_ticks"].to_numpy(float)
        cut = max(1, math.floor(len(g) * 0.7))
        beta, inverse = solved(x, y)
        train, _ = solved(x[:cut], y[:cut])
        base, _ = solved(x[:cut, :2], y[:cut])
        e, oe = y - x @ beta, y[cut:] - x[cut:] @ train
        sst, total = ((y[cut:] - y[:cut].mean()) ** 2).sum(), ((y - y.mean()) ** 2).sum()
        out[key] = {
            "g": g, "cut": cut, "beta": beta, "train": train, "n": len(g), "r2": 1 - (e @ e) / total if total > 1e-12 else None, "skill": 1 - (oe @ oe) / sst if sst > 1e-12 else None,
            "base": 1 - ((y[cut:] - x[cut:, :2] @ base) ** 2).sum() / sst if sst > 1e-12 else None, "sd": math.sqrt(e @ e / (len(g) - x.shape[1])) if len(g) > x.shape[1] else None,
            "train_sd": math.sqrt(((y[:cut] - x[:cut] @ train) ** 2).sum() / (cut - x.shape[1])) if cut > x.shape[1] else None,
            "stderr": np.sqrt(np.maximum(np.diag(inverse @ (x.T * e**2) @ x @ inverse), 0)),
        }
    return out


def near(a, b):
    return (a is None) == (b is None) and (a is None or a == pytest.approx(b, rel=1e-5, abs=1e-6))


def test_fits(parts, want):
    rows = parts[1].collect()
    assert len(rows) == len(want) > 0
    for r in rows:
        w = want[tuple(r[k] for k in KEY)]
        assert (r["n_obs"], r["n_train"], r["n_oos"]) == (w["n"], w["cut"], w["n"] - w["cut"])
        names = ["intercept", *FEATURES]
        for mapped, values in (("betas", w["beta"]), ("oos_betas", w["train"]), ("stderr", w["stderr"])):
            assert np.allclose([r[mapped][n] for n in names], values, rtol=1e-4, atol=1e-6), (mapped, r)
        for name, key in (("r2", "r2"), ("oos_skill", "skill"), ("baseline_oos_r2", "base"), ("resid_std", "sd"), ("oos_resid_std", "train_sd")):
            assert near(r[name], w[key]), (name, r[name], w[key])
        assert all(r[pin] for pin in models.PINS)


def test_calibration(parts, want):
    got = {tuple(r[k] for k in KEY): r for r in parts[2].collect()}
    for key, w in want.items():
        test = w["g"].iloc[w["cut"] :]
        if not w["train_sd"] or not len(test):
            assert key not in got
            continue
        p = [phi(v / w["train_sd"]) for v in np.c_[np.ones(len(test)), test[FEATURES].to_numpy(float)] @ w["train"]]
        bins = {}
        for chance, y in zip(p, test["y_ticks"], strict=True):
            bins.setdefault(min(int(chance * 10), 9), []).append((chance, y > 0))
        r = got[key]
        assert (r["n"], r["bins_used"], r["least_bin"]) == (len(test), len(bins), min(map(len, bins.values())))
        error = max(abs(np.mean([c for c, _ in b]) - np.mean([h for _, h in b])) for b in bins.values())
        assert near(r["max_bin_error"], error)
        ok = len(bins) == 10 and min(map(len, bins.values())) >= 5 and error <= 0.1
        assert r["status"] == ("insufficient" if len(test) < 30 else "passed" if ok else "failed")


def test_predictions_and_scenarios(market, parts, want):
    rows, fits, calibration = parts
    # As if everything had passed, so that the chances are there.
    open_fits = fits.withColumn("validation_status", F.lit("validated")).withColumn("status", F.lit("validated"))
    passed = calibration.withColumn("status", F.lit("passed"))
    vectors = rows.where("horizon_ms = 5000").select("symbol", "venue", "ts_ms", "update_id", *FEATURES).orderBy("ts_ms", "update_id").limit(200)
    data = {(r["symbol"], r["venue"], r["update_id"]): r for r in vectors.collect()}
    got = models.predict_distribution(open_fits, vectors, FEATURES, passed).collect()
    assert got
    for r in got:
        w, v = want[tuple(r[k] for k in KEY)], data[r["symbol"], r["venue"], r["update_id"]]
        mu = w["beta"][0] + sum(b * v[f] for b, f in zip(w["beta"][1:], FEATURES, strict=True))
        assert near(r["expected_ticks"], mu) and near(r["variance_ticks"], w["sd"] and w["sd"] ** 2) and near(r["interval_lo_95"], w["sd"] and mu - 1.96 * w["sd"])
        if r["probability_status"] == "model_implied":
            assert near(r["p_positive"], phi(mu / w["sd"])) and near(r["p_above_theta"], phi((mu - 1) / w["sd"]))
    assert all(r["p_positive"] is None for r in models.predict_distribution(open_fits, vectors, FEATURES, calibration.withColumn("status", F.lit("failed"))).collect())
    latest = vectors.groupBy("symbol", "venue").agg(F.max(F.struct("ts_ms", "update_id", *FEATURES)).alias("v")).select("symbol", "venue", "v.*")
    newest = {(r["symbol"], r["venue"]): r for r in latest.collect()}
    for r in models.forward_scenario(open_fits, latest, FEATURES, passed, [-2, 2]).collect():
        w, v = want[tuple(r[k] for k in KEY)], newest[r["symbol"], r["venue"]]
        mu = w["beta"][0] + sum(b * v[f] for b, f in zip(w["beta"][1:], FEATURES, strict=True))
        se = math.sqrt(w["stderr"][0] ** 2 + sum((s * v[f]) ** 2 for s, f in zip(w["stderr"][1:], FEATURES, strict=True)))
        assert near(r["expected_ticks"], mu) and near(r["se"], se)
        if r["p"] is not None:
            chances = [phi((1 if r["target_ticks"] > 0 else -1) * (m - r["target_ticks"]) / w["sd"]) for m in (mu, mu - 1.96 * se, mu + 1.96 * se)]
            assert near(r["p"], chances[0]) and near(r["p_lo"], min(chances[1:])) and near(r["p_hi"], max(chances[1:]))


def test_derived_reports(market, parts, want):
    rows, fits, calibration = parts
    by = {tuple(r[k] for k in KEY): r for r in fits.collect()}
    for r in models.skill_decay(fits).collect():
        f = by[tuple(r[k] for k in KEY)]
        ok = f["status"] != "insufficient" and f["validation_status"] == "validated" and f["oos_skill"] is not None
        assert (r["finalized"], r["null_result"] is None, r["oos_skill"]) == (ok, ok, f["oos_skill"])
    for r in models.bridge_horizon(fits).collect():
        f, scale = by[r["symbol"], r["venue"], r["source_horizon_ms"]], math.sqrt(r["horizon_ms"] / r["source_horizon_ms"])
        assert near(r["resid_std"], f["resid_std"] and f["resid_std"] * scale) and near(r["oos_skill"], f["oos_skill"] and f["oos_skill"] / scale)
        assert r["validation_status"] == "extrapolated" and r["status"] in ("insufficient", "provisional")
    claims = models.hypothesis_test(fits, rows, FEATURES, tests=4)
    for r in claims.collect():
        w = want[tuple(r[k] for k in KEY)]
        mean = w["g"][FEATURES].mean()
        effect = w["beta"][0] + sum(b * mean[f] for b, f in zip(w["beta"][1:], FEATURES, strict=True))
        se = math.sqrt(w["stderr"][0] ** 2 + sum((s * mean[f]) ** 2 for s, f in zip(w["stderr"][1:], FEATURES, strict=True)))
        assert near(r["effect"], effect) and near(r["se"], se) and near(r["p_value"], min(1, 4 * (1 - phi(effect / se)))) and (r["m_tests"], r["multiplicity_adj"]) == (4, "bonferroni-m=4")
    assert {r["multiplicity_adj"] for r in models.hypothesis_test(fits, rows, FEATURES, tests=1, method="none").collect()} <= {"none-prereg-single"}
    audit = models.discipline_audit(fits, calibration, "costs", pm.usable_labels(market), True, claims)
    checks = {"estimation", "time_order", "baseline_comparison", "horizon_separation", "version_pins", "calibration", "cost_statement", "regime_separation", "leakage", "multiplicity"}
    assert checks <= set(audit.columns)
    for r in audit.collect():
        own = [f for f in by.values() if (f["symbol"], f["venue"]) == (r["symbol"], r["venue"])]
        assert r["estimation"] == all(f["estimation_status"] == "fitted" for f in own) and r["version_pins"] and r["leakage"] and r["multiplicity"] and r["regime_separation"]
        assert set(r["open_violations"]) == {c for c in checks if not r[c]} and (r["verdict"] == "go") == (not r["open_violations"])
    bare = models.discipline_audit(fits.withColumn("input_hash", F.lit(None).cast("string"))).collect()
    assert all(not r["version_pins"] and not r["leakage"] and not r["regime_separation"] and r["multiplicity"] for r in bare)


def test_norm_cdf_and_hashes(spark, market):
    zs = [-3.0, -0.5, 0.0, 1.96, None]
    got = [r[0] for r in spark.createDataFrame([(z,) for z in zs], "z double").select(models.norm_cdf(F.col("z"))).collect()]
    assert all(near(g, None if z is None else phi(z)) for g, z in zip(got, zs, strict=True))
    df = spark.createDataFrame([(1, 2.0, None), (2, 3.0, "x"), (2, 3.0, "x")], "a long, b double, c string")
    one = df.agg(models.set_hash(["a", "b", "c"])).first()[0]
    assert one == df.orderBy(F.desc("a")).agg(models.set_hash(["c", "b", "a"])).first()[0] != df.distinct().agg(models.set_hash(["a", "b", "c"])).first()[0]


def test_hypothesis_ledger(spark):
    stored = spark.createDataFrame([("h1", "a"), ("h2", "b")], "hypothesis_id string, h0 string")
    new = spark.createDataFrame([("h2", "b"), ("h1", "other"), ("h3", "c")], "hypothesis_id string, h0 string")
    ledger, conflicts = models.append_hypotheses(stored, new, ["h0"])
    assert sorted(tuple(r) for r in ledger.collect()) == [("h1", "a"), ("h2", "b"), ("h3", "c")]
    assert [r["hypothesis_id"] for r in conflicts.collect()] == ["h1"]
