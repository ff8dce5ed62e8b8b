"""Queries: cell statistics, split-conformal fits, lookups, band shapes."""

from pyspark.sql import functions as F

from pairmeter.functions.exprs import at_or_above, inside, r6
from pairmeter.operators import conformal as C
from pairmeter.operators.order_stats import conformal_quantile, finite, finite_or_null, histogram
from pairmeter.plans import sql as S
from pairmeter.plans.registry import query
from pairmeter.plans.views import IS_CAL_SQL, OBS_SQL, is_calibration, obs

R = S.r6
STATS = ["mean", "half_width", "worst", "best", "p05", "p95"]


def _stats(df):
    return df.select("level", "scheme", "band", "n", "n_checkpoints", "n_families",
                     *[r6(finite_or_null(c)).alias(c) for c in STATS])


_STATS_SQL = "level, scheme, band, n, n_checkpoints, n_families, " + ", ".join(f"{R(c)} AS {c}" for c in STATS)


@query("a1_cell_statistics", f"WITH {OBS_SQL}, {S.fit_in_sample('a', 'obs')} SELECT {_STATS_SQL} FROM a_fit")
def cell_statistics(spark, sf):
    return _stats(C.cell_statistics(*C.reduce_rows(obs(spark, sf))))


@query("a3_support_gate", f"""WITH {OBS_SQL}, {S.fit_in_sample('a', 'obs')}
SELECT scheme, band, n, n_checkpoints, {R('half_width')} AS half_width,
  CASE WHEN kept THEN 'kept' ELSE 'rejected' END AS gate FROM a_fit WHERE level = 'stratum'""")
def support_gate(spark, sf):
    d = C.fit_in_sample(*C.reduce_rows(obs(spark, sf))).where("level = 'stratum'")
    return d.select("scheme", "band", "n", "n_checkpoints", r6(finite_or_null("half_width")).alias("half_width"),
                    F.when(F.col("kept"), "kept").otherwise("rejected").alias("gate"))


@query("c2_fit_in_sample", f"""WITH {OBS_SQL}, {S.fit_in_sample('a', 'obs')}
SELECT level, scheme, band, {R('mean')} AS mean, {R('half_width')} AS half_width,
  half_width IS NULL AS is_infinite, kept FROM a_fit""")
def fit_in_sample(spark, sf):
    return C.fit_in_sample(*C.reduce_rows(obs(spark, sf))).select(
        "level", "scheme", "band", r6("mean").alias("mean"), r6(finite_or_null("half_width")).alias("half_width"),
        (~finite("half_width")).alias("is_infinite"), "kept")


_A2 = f"""WITH {OBS_SQL}, r AS (SELECT scheme, abs(delta) AS score,
  row_number() OVER (PARTITION BY scheme ORDER BY abs(delta)) AS rn,
  count(*) OVER (PARTITION BY scheme) AS n FROM obs)
SELECT scheme, max(n) AS n, {R(f"min(score) FILTER (WHERE rn >= {S.rank_of('n')})")} AS q FROM r GROUP BY scheme"""


@query("a2_conformal_quantile", _A2)
def conformal_quantiles(spark, sf):
    h = histogram(obs(spark, sf).withColumn("score", F.abs("delta")), "scheme", value="score")
    return conformal_quantile(h, ["scheme"], "score").select("scheme", "n", r6(finite_or_null("q")).alias("q"))


def _sources(p):
    return f"{p}_f AS (SELECT * FROM obs WHERE NOT {IS_CAL_SQL}), {p}_k AS (SELECT * FROM obs WHERE {IS_CAL_SQL})"


def _split_sql(variant):
    return f"""WITH {OBS_SQL}, {_sources('x')}, {S.fit_split('x', 'x_f', 'x_k', variant)}
SELECT level, scheme, band, {R('mean')} AS mean, {R('half_width')} AS half_width, n_cal, kept FROM x_model"""


def _split(spark, sf, variant):
    return C.fit_split(*C.reduce_rows(obs(spark, sf), is_cal=is_calibration()), variant).select(
        "level", "scheme", "band", r6("mean").alias("mean"), r6(finite_or_null("half_width")).alias("half_width"),
        F.coalesce("n_cal", F.lit(0)).alias("n_cal"), "kept")


@query("c3_fit_split_conformal", _split_sql("widen"))
def fit_split(spark, sf):
    return _split(spark, sf, "widen")


@query("c5_fit_scheme_only", _split_sql("scheme"))
def fit_scheme_only(spark, sf):
    return _split(spark, sf, "scheme")


@query("c6_fit_full_strata", _split_sql("full"))
def fit_full(spark, sf):
    return _split(spark, sf, "full")


_SHIPPED = f"""WITH {OBS_SQL}, {_sources('x')}, {S.fit_split('x', 'x_f', 'x_k')}, {S.fit_in_sample('a', 'obs')}"""


@query("c4_shipped_band", f"""{_SHIPPED}
SELECT level, scheme, band, n, n_checkpoints, n_families, {R('worst')} AS worst, {R('best')} AS best,
  {R('a_fit.p05')} AS p05, {R('a_fit.p95')} AS p95,
  CASE WHEN m.kept THEN {R('m.mean')} END AS mean, CASE WHEN m.kept THEN {R('m.half_width')} END AS half_width,
  CASE WHEN coalesce(m.kept, false) THEN 'kept' WHEN a_fit.kept THEN 'uncalibratable' ELSE 'rejected' END AS status
FROM a_fit LEFT JOIN (SELECT level, scheme, band, mean, half_width, kept FROM x_model) m USING (level, scheme, band)""")
def shipped_band(spark, sf):
    return _stats_with_status(C.fit_shipped(*C.reduce_rows(obs(spark, sf), is_cal=is_calibration())))


def _stats_with_status(m):
    return m.select("level", "scheme", "band", "n", "n_checkpoints", "n_families", "status",
                    *[r6(finite_or_null(c)).alias(c) for c in STATS])


@query("c1_cluster_partition", f"WITH {OBS_SQL} {S.sampled_calibration()}")
def cluster_partition(spark, sf):
    return C.cluster_partition(obs(spark, sf))


def _predict_sql(variant, rule):
    return f"""WITH {OBS_SQL}, {_sources('x')}, {S.fit_split('x', 'x_f', 'x_k', variant)},
{S.predict('y', 'x_model', 'obs', rule)}"""


def _scored(spark, sf, variant, rule):
    d = obs(spark, sf)
    return C.predict(d, C.fit_rows(d, is_calibration(), variant), rule)


_ROWS_SQL = f"""SELECT obs_id, scheme, band, level, {R('yhat')} AS yhat, {R('half_width')} AS half_width,
  {R('lo')} AS lo, {R('hi')} AS hi FROM y_pred"""


def _rows(d):
    return d.select("obs_id", "scheme", "band", "level",
                    *[r6(finite_or_null(c)).alias(c) for c in ("yhat", "half_width", "lo", "hi")])


@query("j3_fallback_lookup", f"{_predict_sql('full', 'fallback')} {_ROWS_SQL}")
def fallback_lookup(spark, sf):
    return _rows(_scored(spark, sf, "full", "fallback"))


@query("j4_widen_only_lookup", f"{_predict_sql('widen', 'widen')} {_ROWS_SQL}")
def widen_lookup(spark, sf):
    return _rows(_scored(spark, sf, "widen", "widen"))


_COV = f"""count(*) AS n, {R('avg(ok::int)')} AS coverage, {R('avg(ok_one::int)')} AS coverage_one_sided,
  {R('avg(half_width)')} AS mean_half_width, {R('avg(abs(delta - yhat))')} AS mae"""


def _coverage(d, *keys):
    ok, one = inside("delta", "lo", "hi").cast("int"), at_or_above("delta", "lo").cast("int")
    return d.groupBy(*keys).agg(
        F.count("*").alias("n"), r6(F.avg(ok)).alias("coverage"), r6(F.avg(one)).alias("coverage_one_sided"),
        r6(F.avg(finite_or_null("half_width"))).alias("mean_half_width"),
        r6(F.avg(F.abs(F.col("delta") - F.col("yhat")))).alias("mae"))


@query("c7_widen_only_coverage", f"""{_predict_sql('widen', 'widen')}
SELECT scheme, {_COV} FROM y_pred GROUP BY scheme""")
def widen_coverage(spark, sf):
    """Fit on two thirds of the clusters, score everything, coverage by treatment."""
    return _coverage(_scored(spark, sf, "widen", "widen"), "scheme")


@query("pr7_coverage_indicators", f"""{_predict_sql('widen', 'widen')}
SELECT obs_id, ok, ok_one FROM y_pred""")
def coverage_indicators(spark, sf):
    d = _scored(spark, sf, "widen", "widen")
    return d.select("obs_id", inside("delta", "lo", "hi").alias("ok"), at_or_above("delta", "lo").alias("ok_one"))
