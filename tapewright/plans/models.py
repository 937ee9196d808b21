"""Registered model queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapewright.operators import micro, models, rules
from tapewright.plans import micro as pm
from tapewright.plans.registry import query, shared
from tapewright.sources.views import Market

BLOCK_MS, LEAST = 300_000, 10
FEATURES = ["ofi_10s", "ad_10s", "dmu", "spread_bps", "obi_top"]


def fits(m: Market, flow: str = "ofi"):
    return models.fit_price_impact(micro.price_impact_observations(pm.intervals(m), flow), BLOCK_MS, LEAST)


def fit_sql(flow: str = "ofi") -> str:
    observed = pm.OBSERVED.replace("ofi AS x", f"{flow} AS x")
    return f"""(WITH r AS (SELECT *, start_ms - start_ms % {BLOCK_MS} AS block_ms FROM {observed} o),
      f AS (SELECT symbol, venue, block_ms, count(*) AS n, avg(x) AS xbar, avg(y) AS ybar, var_pop(x) * count(*) AS sxx, covar_pop(x, y) * count(*) AS sxy, var_pop(y) * count(*) AS sst, avg(average_depth) AS mean_ad FROM r GROUP BY ALL),
      g AS (SELECT *, CASE WHEN sxx > 1e-12 THEN sxy / sxx ELSE 0E0 END AS beta, ybar - CASE WHEN sxx > 1e-12 THEN sxy / sxx ELSE 0E0 END * xbar AS alpha FROM f),
      e AS (SELECT r.symbol, r.venue, r.block_ms, g.n, round(abs(x - xbar), 9) AS far, round(y - alpha - beta * x, 9) AS e FROM r JOIN g ON r.symbol = g.symbol AND r.venue = g.venue AND r.block_ms = g.block_ms),
      h AS (SELECT *, row_number() OVER (PARTITION BY symbol, venue, block_ms ORDER BY far, e) <= n // 2 AS near FROM e),
      s AS (SELECT symbol, venue, block_ms, sum(e * e) AS ssr, sum(e * e * far * far) AS hc0, coalesce(avg(e * e) FILTER (near), 0) AS low_sq, coalesce(avg(e * e) FILTER (NOT near), 0) AS high_sq FROM h GROUP BY ALL),
      j AS (SELECT g.*, ssr, hc0, sxx > 1e-12 AND n > 1 AS varies, high_sq > low_sq * 2 OR low_sq > high_sq * 2 AS uneven, CASE WHEN sxx > 1e-12 AND n > 1 AND sst > 1e-12 THEN 1 - ssr / sst END AS r2 FROM g JOIN s ON g.symbol = s.symbol AND g.venue = s.venue AND g.block_ms = s.block_ms)
      SELECT symbol, venue, block_ms, n, alpha, beta, CASE WHEN varies THEN sqrt(hc0) / sxx END AS stderr_beta, r2, CASE WHEN varies AND n > 2 THEN sqrt(ssr / (n - 2)) END AS residual_std, varies AND uneven AS hetero, mean_ad,
        CASE WHEN NOT varies OR n < {LEAST} THEN 'insufficient' WHEN n < {2 * LEAST} OR uneven OR r2 IS NULL THEN 'provisional' ELSE 'validated' END AS status FROM j)"""


DOUBLES = "alpha beta stderr_beta r2 residual_std mean_ad"


@query("m1_fit_price_impact", f"SELECT * FROM {fit_sql()} f", DOUBLES)
def _(m: Market):
    return fits(m)


@query("m1_fit_queue_only", f"SELECT * FROM {fit_sql('queue_ofi')} f", DOUBLES)
def _(m: Market):
    return fits(m, "queue_ofi")


DEPTH = f"""(WITH l AS (SELECT symbol, venue, CASE WHEN status <> 'insufficient' AND mean_ad > 0 AND beta > 0 THEN ln(mean_ad) END AS lx, CASE WHEN status <> 'insufficient' AND mean_ad > 0 AND beta > 0 THEN ln(beta) END AS ly FROM {fit_sql()} f),
  s AS (SELECT symbol, venue, count(lx) AS n_blocks, avg(lx) AS xb, avg(ly) AS yb, var_pop(lx) AS vx, covar_pop(lx, ly) AS cxy, var_pop(ly) AS vy FROM l GROUP BY ALL), t AS (SELECT *, coalesce(n_blocks >= 3 AND vx > 1e-15, false) AS ok FROM s)
  SELECT symbol, venue, n_blocks, CASE WHEN ok THEN exp(yb - cxy / vx * xb) END AS c, CASE WHEN ok THEN -cxy / vx END AS "lambda", CASE WHEN ok AND vy > 1e-15 THEN cxy * cxy / (vx * vy) END AS r2,
    CASE WHEN NOT ok THEN 'insufficient' WHEN n_blocks < 6 THEN 'provisional' ELSE 'validated' END AS status FROM t)"""


@query("m2_fit_depth_scaling", f'SELECT symbol, venue, n_blocks, round(c, 6) + 0E0 AS c, round("lambda", 6) + 0E0 AS "lambda", round(r2, 6) + 0E0 AS r2, status FROM {DEPTH} d')
def _(m: Market):
    return models.fit_depth_scaling(fits(m))


@query("m3_derive_price_delta", f"""WITH n AS (SELECT symbol, venue, arg_max(ofi, start_ms) AS ofi, arg_max(average_depth, start_ms) AS ad FROM {pm.INTERVALS} i WHERE quality = 'exact_feed' GROUP BY ALL),
  j AS (SELECT f.symbol, f.venue, f.block_ms, n.ofi, alpha, beta, stderr_beta, CASE WHEN c > 0 AND ad > 0 THEN c * exp(-"lambda" * ln(ad)) END AS beta_implied FROM {fit_sql()} f JOIN n ON f.symbol = n.symbol AND f.venue = n.venue LEFT JOIN {DEPTH} d ON f.symbol = d.symbol AND f.venue = d.venue WHERE f.status <> 'insufficient')
  SELECT symbol, venue, block_ms, ofi, alpha + beta * ofi AS delta_ticks, 1.96 * stderr_beta * abs(ofi) AS band_95, beta_implied, alpha + beta_implied * ofi AS delta_scaled, abs(alpha + beta * ofi - (alpha + beta_implied * ofi)) AS agreement FROM j""",
       "ofi delta_ticks band_95 beta_implied delta_scaled agreement")
def _(m: Market):
    i = pm.intervals(m).where("quality = 'exact_feed'")
    latest = i.groupBy("symbol", "venue").agg(F.max_by("ofi", "start_ms").alias("ofi"), F.max_by("average_depth", "start_ms").alias("average_depth"))
    f = fits(m)
    return models.derive_price_delta(f, models.fit_depth_scaling(f), latest)


ROLLING = f"""(SELECT symbol, venue, start_ms, flow, usable FROM (SELECT symbol, venue, start_ms, sum(ofi) OVER w AS flow, count(*) OVER w AS c, min((quality = 'exact_feed')::INT) OVER w = 1 AS usable FROM {pm.INTERVALS} i
  WINDOW w AS (PARTITION BY symbol, venue ORDER BY start_ms ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING)) x WHERE c = 6)"""


@query("w23_rolling_scenario_sums", f"SELECT * FROM {ROLLING} r", "flow")
def _(m: Market):
    return models.rolling_flow(pm.intervals(m), 6)


@query("m4_evaluate_scenario", f"""WITH n AS (SELECT symbol, venue, block_ms, d AS delta_req, CASE WHEN abs(beta) >= 1e-18 THEN (d - 6 * alpha) / beta END AS required, CASE WHEN abs(beta - 1.96 * stderr_beta) >= 1e-18 THEN (d - 6 * alpha) / (beta - 1.96 * stderr_beta) END AS ea,
    CASE WHEN abs(beta + 1.96 * stderr_beta) >= 1e-18 THEN (d - 6 * alpha) / (beta + 1.96 * stderr_beta) END AS eb FROM {fit_sql()} f, (SELECT unnest([-3E0, 2E0, 5E0]) AS d) t WHERE status <> 'insufficient'),
  w AS (SELECT n.*, least(ea, eb) AS lo, greatest(ea, eb) AS hi, flow, usable FROM {ROLLING} r JOIN n ON r.symbol = n.symbol AND r.venue = n.venue),
  s AS (SELECT symbol, venue, block_ms, delta_req, required, lo AS required_lo, hi AS required_hi, count(*) FILTER (usable) AS n_usable, count(*) FILTER (NOT usable) AS n_degraded, count(*) FILTER (usable AND CASE WHEN delta_req > 0 THEN flow >= required ELSE flow <= required END) AS h,
    count(*) FILTER (usable AND CASE WHEN delta_req > 0 THEN flow >= lo ELSE flow <= lo END) AS hl, count(*) FILTER (usable AND CASE WHEN delta_req > 0 THEN flow >= hi ELSE flow <= hi END) AS hh FROM w GROUP BY ALL)
  SELECT symbol, venue, block_ms, delta_req, required, required_lo, required_hi, n_usable, n_degraded, CASE WHEN n_usable >= 5 AND required IS NOT NULL THEN h / n_usable END AS exceedance, CASE WHEN n_usable >= 5 AND required_lo IS NOT NULL THEN hl / n_usable END AS exceedance_lo, CASE WHEN n_usable >= 5 AND required_hi IS NOT NULL THEN hh / n_usable END AS exceedance_hi FROM s""",
       "delta_req required required_lo required_hi exceedance exceedance_lo exceedance_hi")
def _(m: Market):
    f = models.fit_price_impact(micro.price_impact_observations(intervals(m), "ofi"), BLOCK_MS, LEAST)
    targets = f.select("symbol", "venue").distinct().withColumn("delta_req", F.explode(F.array(F.lit(-3.0), F.lit(2.0), F.lit(5.0))))
    return models.evaluate_scenario(f, intervals(m), targets, 6, 5)


def events(m: Market):
    return shared(m, "events", ("events",), lambda: pm.events(m))


def intervals(m: Market):
    return shared(m, "intervals", ("events",), lambda: micro.ofi_intervals(events(m)))


def labels(m: Market):
    """Labels outside degraded spans."""
    every = shared(m, "labels", ("events",), lambda: micro.forward_labels(events(m), events(m)))
    return micro.exclude_degraded(every, rules.status_spans(m.capture_status))


def cases(m: Market):
    """Labelled vectors, numbered; what they are made of is read several times, so it is written once for all forward queries."""
    vectors = lambda: models.labelled_vectors(micro.feature_vectors(events(m), intervals(m)), labels(m), FEATURES)
    return shared(m, "cases", ("events",), lambda: models.complete_cases(shared(m, "vectors", ("events",), vectors)))


def forward_fits(m: Market):
    solved = lambda: shared(m, "coefficients", ("events",), lambda: models.forward_coefficients(cases(m), FEATURES))
    return shared(m, "forward-fits", ("events",), lambda: models.fit_forward_ols(cases(m), FEATURES, solved=solved()))


def flat(df, *maps: str):
    """Map columns as one column a coefficient."""
    names = ["intercept", *FEATURES]
    return df.select(*[c for c in df.columns if c not in ("betas", "stderr", "oos_betas")], *[F.element_at(mp, n).alias(f"{mp}_{n}") for mp in maps for n in names])


@query("m5_fit_forward_ols")
def _(m: Market):
    return flat(forward_fits(m), "betas", "stderr")


def calibrated(m: Market):
    """Cases, their fits, and the fits' calibration."""
    rows, f = cases(m), forward_fits(m)
    return rows, f, models.calibration_report(f, rows, FEATURES)


@query("m7_calibration_report")
def _(m: Market):
    return calibrated(m)[2]


@query("m6_predict_distribution")
def _(m: Market):
    _, f, c = calibrated(m)
    return models.predict_distribution(f, micro.feature_vectors(events(m), intervals(m)), FEATURES, c)


@query("m8_forward_scenario")
def _(m: Market):
    _, f, c = calibrated(m)
    v = micro.feature_vectors(events(m), intervals(m)).dropna(subset=FEATURES)
    latest = v.groupBy("symbol", "venue").agg(F.max(F.struct("ts_ms", "update_id", *FEATURES)).alias("v")).select("symbol", "venue", "v.*")
    return models.forward_scenario(f, latest, FEATURES, c, [-5, -2, 2, 5])


@query("m9_skill_decay")
def _(m: Market):
    return models.skill_decay(forward_fits(m))


@query("m10_bridge_horizon")
def _(m: Market):
    return models.bridge_horizon(forward_fits(m))


@query("m11_hypothesis_test")
def _(m: Market):
    rows = cases(m)
    return models.hypothesis_test(forward_fits(m), rows, FEATURES, tests=4)


@query("m12_discipline_audit")
def _(m: Market):
    rows, f, c = calibrated(m)
    claims = models.hypothesis_test(f, rows, FEATURES, tests=4)
    audit = models.discipline_audit(f, c, "costs are not modelled", labels(m), True, claims)
    return audit.withColumn("open_violations", F.array_join("open_violations", ","))


NEWEST = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol, venue ORDER BY block_ms DESC) AS rank FROM {} f) x WHERE rank <= {})"


@query("j13_prior_block_fits", f"SELECT * FROM {NEWEST.format(fit_sql(), 8)} n", DOUBLES)
def _(m: Market):
    return models.prior_block_fits(fits(m))


@query("m13_assemble_evidence", f"""SELECT p.symbol, p.venue, p.block_ms AS primary_block_ms, p.n AS primary_n, p.beta AS primary_beta, p.r2 AS primary_r2, p.status AS primary_status, q.block_ms AS queue_block_ms, q.n AS queue_n, q.beta AS queue_beta, q.r2 AS queue_r2, q.status AS queue_status,
  n_blocks, c, d."lambda" AS depth_lambda, d.status AS depth_status FROM {NEWEST.format(fit_sql(), 1)} p LEFT JOIN {NEWEST.format(fit_sql("queue_ofi"), 1)} q ON p.symbol = q.symbol AND p.venue = q.venue LEFT JOIN {DEPTH} d ON p.symbol = d.symbol AND p.venue = d.venue""",
       "primary_beta primary_r2 queue_beta queue_r2 c depth_lambda")
def _(m: Market):
    f = fits(m)
    return models.assemble_evidence(f, fits(m, "queue_ofi"), models.fit_depth_scaling(f))


#: Of each hypothesis its first and last content by order, and whether the ledger holds it: SQL twin of ``hypotheses``.
LEDGER = """(SELECT 'h' || (o_orderkey % 500) AS hypothesis_id, o_orderkey % 500 % 3 <> 0 AS is_stored, arg_min(o_orderstatus, o_orderkey) AS a0, arg_min(o_orderpriority, o_orderkey) AS a1,
  arg_max(o_orderstatus, o_orderkey) AS b0, arg_max(o_orderpriority, o_orderkey) AS b1 FROM {orders} GROUP BY ALL)"""


def json_hash_sql(h0: str, h1: str) -> str:
    return f"""sha256('{{"h0":"' || {h0} || '","h1":"' || {h1} || '"}}')"""


def hypotheses(m: Market):
    rows = m.orders.select(F.concat(F.lit("h"), (F.col("o_orderkey") % 500).cast("string")).alias("hypothesis_id"), F.col("o_orderstatus").alias("h0"), F.col("o_orderpriority").alias("h1"), "o_orderkey")
    first = rows.groupBy("hypothesis_id").agg(F.min_by(F.struct("h0", "h1"), "o_orderkey").alias("a"), F.max_by(F.struct("h0", "h1"), "o_orderkey").alias("b"))
    stored = first.where("cast(substring(hypothesis_id, 2) as int) % 3 <> 0").select("hypothesis_id", "a.*")
    return stored, first.select("hypothesis_id", "b.*")


@query("m14_append_hypotheses", f"SELECT hypothesis_id, CASE WHEN is_stored THEN a0 ELSE b0 END AS h0, CASE WHEN is_stored THEN a1 ELSE b1 END AS h1 FROM {LEDGER} l")
def _(m: Market):
    return models.append_hypotheses(*hypotheses(m), ["h0", "h1"])[0]


@query("m14_hypothesis_conflicts", f"SELECT hypothesis_id, {json_hash_sql('a0', 'a1')} AS stored_hash, {json_hash_sql('b0', 'b1')} AS new_hash FROM {LEDGER} l WHERE is_stored AND (a0 <> b0 OR a1 <> b1)")
def _(m: Market):
    return models.append_hypotheses(*hypotheses(m), ["h0", "h1"])[1]


@query("c20_content_hash")
def _(m: Market):
    return pm.intervals(m).groupBy("symbol", "venue").agg(F.count("*").alias("intervals"), models.set_hash(["start_ms", "event_count", "ofi", "quality"]).alias("input_hash"))


@query("c21_required_flow", f"SELECT symbol, venue, block_ms, CASE WHEN abs(beta) >= 1e-18 THEN (4 - alpha) / beta END AS required FROM {fit_sql()} f", "required")
def _(m: Market):
    return fits(m).select("symbol", "venue", "block_ms", models.required_flow(F.lit(4.0), F.col("alpha"), F.col("beta")).alias("required"))


# The error function as a series of positive terms, exp(-x²) Σ x^(2n+1) / Γ(n + 3/2); 80 terms suffice for |x| under 4.
@query("c18_norm_cdf", """SELECT symbol, venue, trade_id, ts_ms, 0.5E0 * (1 + exp(-x * x) * list_sum(list_transform(range(0, 80), lambda n: pow(x, 2 * n + 1) / gamma(n + 1.5E0)))) AS p
  FROM (SELECT *, (qty - 25.5E0) / 14.4E0 / sqrt(2E0) AS x FROM {trades}) t""", "p")  # fmt: skip
def _(m: Market):
    return m.trades.select("symbol", "venue", "trade_id", "ts_ms", models.norm_cdf((F.col("qty") - 25.5) / 14.4).alias("p"))
