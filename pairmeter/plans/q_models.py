"""Queries: selection bias, low-rank structure, point predictors, row-split protocol, strata comparison."""

from pyspark.sql import functions as F

from pairmeter.functions.exprs import feature_columns, inside, r6
from pairmeter.operators import bias as B
from pairmeter.operators import conformal as C
from pairmeter.operators import folds as E
from pairmeter.operators import joins as J
from pairmeter.operators import lowrank as M
from pairmeter.operators import models as P
from pairmeter.operators.order_stats import finite_or_null, histogram
from pairmeter.plans import sql as S
from pairmeter.plans.q_folds import EVAL
from pairmeter.plans.q_intervals import _sources
from pairmeter.plans.q_stats import _METHODS, _TASKS
from pairmeter.plans.registry import query
from pairmeter.plans.staging import stage
from pairmeter.plans.views import OBS_RAW_SQL, OBS_SQL, SCORES_SQL, families, is_calibration, obs, obs_raw, runs

R = S.r6


def hist(spark, sf):
    return stage(histogram(obs(spark, sf), "scheme"))


def tail_sql(p, src):
    """CTEs ending in {p}_fit(scheme, u, xi, sigma, n_exceed, n_total, x_min)."""
    return f"""{p}_u AS (SELECT scheme, quantile_cont(delta, 0.25) AS u, count(*) AS n_total, min(delta) AS x_min FROM {src} GROUP BY scheme),
{p}_e AS (SELECT scheme, count(*) AS n_exceed, avg(u - delta) AS m, var_samp(u - delta) AS v FROM {src} JOIN {p}_u USING (scheme) WHERE delta < u GROUP BY scheme),
{p}_fit AS (SELECT scheme, u, n_total, x_min, coalesce(n_exceed, 0) AS n_exceed, CASE WHEN n_exceed >= 8 AND v > 0 AND m > 0 THEN least(greatest(0.5 * (1 - m * m / v), -0.5), 0.45) END AS xi,
  CASE WHEN n_exceed >= 8 AND v > 0 AND m > 0 THEN greatest(0.5 * m * (m * m / v + 1), 1e-6) END AS sigma FROM {p}_u LEFT JOIN {p}_e USING (scheme))"""


def bounds_sql(p, src, pis=B.PIS):
    """CTEs ending in {p}_b(scheme, pi, lower, method)."""
    parts = []
    for pi in pis:
        if pi <= 0:
            parts.append(f"SELECT scheme, {pi}::double AS pi, quantile_cont(delta, 0.05) AS lower, 'empirical' AS method FROM {src} GROUP BY scheme")
        elif pi < 0.05:
            parts.append(f"SELECT scheme, {pi}::double, quantile_cont(delta, {(0.05 - pi) / (1 - pi)!r}), 'reweighted' FROM {src} GROUP BY scheme")
        else:
            r = 0.05 / (pi + (1 - pi) * 0.25)
            y = f"CASE WHEN abs(xi) < 1e-8 THEN -sigma * ln({r!r}) ELSE sigma / xi * (pow({r!r}, -xi) - 1) END"
            parts.append(f"SELECT scheme, {pi}::double, coalesce(u - {y}, x_min), CASE WHEN xi IS NULL THEN 'unidentified_floor' ELSE 'gpd_extrapolated' END FROM {p}_fit")
    return f"{tail_sql(p, src)}, {p}_b AS ({' UNION ALL '.join(parts)})"


@query("b1_tail_fit", f"""WITH {OBS_SQL}, {tail_sql('g', 'obs')} SELECT scheme, {R('u')} AS u, {R('xi')} AS xi, {R('sigma')} AS sigma, n_exceed, n_total FROM g_fit""")
def tail_fit(spark, sf):
    return B.tail_fit(hist(spark, sf)).select("scheme", *[r6(c).alias(c) for c in ("u", "xi", "sigma")], "n_exceed", "n_total")


_B2 = "0.01 / 0.25"


@query("b2_tail_quantile", f"""WITH {OBS_SQL}, {tail_sql('g', 'obs')} SELECT scheme, {R(f'u - CASE WHEN abs(xi) < 1e-8 THEN -sigma * ln({_B2}) ELSE sigma / xi * (pow({_B2}, -xi) - 1) END')} AS q01 FROM g_fit""")
def tail_quantile(spark, sf):
    return B.tail_fit(hist(spark, sf)).select("scheme", r6(B.tail_quantile(F.lit(0.01), F.lit(0.25))).alias("q01"))


_PIS = (0.0, 0.02, 0.05, 0.10, 0.15, 0.20, 0.30)


@query("b3_corrected_lower_bound", f"""WITH {OBS_SQL}, {bounds_sql('g', 'obs', _PIS)} SELECT scheme, pi, {R('lower')} AS lower, method FROM g_b""")
def corrected(spark, sf):
    return B.corrected_bounds(hist(spark, sf), pis=_PIS).withColumn("lower", r6("lower"))


@query("b4_sensitivity_table", f"""WITH {OBS_SQL}, {bounds_sql('g', 'obs')}, o AS (SELECT scheme, count(*) AS n, min(delta) AS mn, quantile_cont(delta, 0.05) AS q05 FROM obs GROUP BY scheme)
SELECT scheme, n, {R('mn')} AS observed_min, {R('q05')} AS observed_q05, pi, {R('lower')} AS lower, method FROM g_b JOIN o USING (scheme)""")
def sensitivity(spark, sf):
    h = hist(spark, sf)
    o = h.groupBy("scheme").agg(F.sum("n").alias("n"), r6(F.min("delta")).alias("observed_min"),
                                r6(F.percentile("delta", F.lit(0.05), F.col("n"))).alias("observed_q05"))
    return B.corrected_bounds(h).withColumn("lower", r6("lower")).join(o, "scheme")


@query("b5_exact_degradation", f"""WITH {OBS_RAW_SQL}, s AS (SELECT scheme, avg((acc_before < 20)::int) AS pi FROM obs_raw GROUP BY scheme)
SELECT scheme, {R('pi')} AS pi, {R('pi + (1 - pi) * 0.05')} AS lower_miss_rate, {R('1 - (pi + (1 - pi) * 0.05 + 0.05)')} AS effective_two_sided FROM s""")
def degradation(spark, sf):
    """Censoring rate per treatment (rows the baseline filter hides) and what it does to a bound."""
    t = obs_raw(spark, sf).groupBy("scheme").agg(F.avg((F.col("acc_before") < 20).cast("int")).alias("pi"))
    miss, eff = B.degradation(F.col("pi"))
    return t.select("scheme", r6("pi").alias("pi"), r6(miss).alias("lower_miss_rate"), r6(eff).alias("effective_two_sided"))


@query("b6_censoring_backtest", f"""WITH {OBS_SQL}, cut AS (SELECT scheme, quantile_cont(delta, 0.15) AS c FROM obs GROUP BY scheme), sv AS (SELECT obs.* FROM obs JOIN cut USING (scheme) WHERE delta > c),
{bounds_sql('g', 'sv')}, nv AS (SELECT scheme, quantile_cont(delta, 0.05) AS naive FROM sv GROUP BY scheme)
SELECT scheme, pi, {R('lower')} AS lower, method, {R('naive')} AS naive_lower, {R('(SELECT avg((delta < lower)::int) FROM obs o WHERE o.scheme = g_b.scheme)')} AS mass_below,
  {R('(SELECT avg((delta < naive)::int) FROM obs o WHERE o.scheme = g_b.scheme)')} AS mass_below_naive FROM g_b JOIN nv USING (scheme)""")
def backtest(spark, sf):
    t = B.censoring_backtest(hist(spark, sf))
    return t.select("scheme", "pi", "method", *[r6(c).alias(c) for c in ("lower", "naive_lower", "mass_below", "mass_below_naive")])


@query("b7_mixture_quantile")
def mixture(spark, sf):
    r = stage(runs(spark, sf))
    x = J.excess_over_control(r).where("scheme = 'no'").select("model", "benchmark", "excess")
    return B.mixture_quantile(r.where("scheme = 'af'").select("model", "benchmark", "delta"), x)


@query("b8_catch_count", f"""WITH {OBS_SQL}, tr AS (SELECT * FROM obs WHERE family <> 'EUROPE'), {bounds_sql('g', 'tr')}
SELECT scheme, pi, count(*) FILTER (WHERE delta >= lower) AS inside, count(*) AS n FROM obs JOIN g_b USING (scheme) WHERE family = 'EUROPE' GROUP BY ALL""")
def catch(spark, sf):
    h = stage(histogram(obs(spark, sf).withColumn("new", F.col("family") == "EUROPE"), "scheme", "new"))
    return B.catch_count(h.where("new"), B.corrected_bounds(h.where("not new")))


# ------------------------------------------------------------------ low rank


def scores(spark, sf):
    return stage(M.score_matrix(obs(spark, sf)))


@query("m6_score_matrix", f"WITH {SCORES_SQL} SELECT row_key, benchmark, round(score, 9) + 0.0 AS score FROM scores")
def score_matrix(spark, sf):
    return scores(spark, sf).select("row_key", "benchmark", F.round("score", 9).alias("score"))


@query("m9_complete_subsets", f"""WITH {SCORES_SQL}, o AS (SELECT DISTINCT row_key, benchmark FROM scores)
SELECT a.benchmark || '+' || b.benchmark || '+' || c.benchmark AS tasks, count(*) AS n_rows FROM o a JOIN o b ON a.row_key = b.row_key AND a.benchmark < b.benchmark
JOIN o c ON a.row_key = c.row_key AND b.benchmark < c.benchmark GROUP BY 1""")
def subsets(spark, sf):
    return M.complete_subsets(scores(spark, sf), _TASKS, 3)


@query("m9_fair_variance_explained")
def fair_variance(spark, sf):
    s = scores(spark, sf)
    best = M.complete_subsets(s, _TASKS, 3).orderBy(F.desc("n_rows"), "tasks").first()
    tasks = best["tasks"].split("+")
    return M.variance_explained(s.where(F.col("benchmark").isin(*tasks)), tasks, 3, complete_only=True)


@query("m8_variance_explained")
def variance(spark, sf):
    return M.variance_explained(scores(spark, sf), _TASKS)


@query("m10_best_neighbour", f"""WITH {SCORES_SQL}, p AS (SELECT a.benchmark AS a, b.benchmark AS b, corr(a.score, b.score) AS r, count(*) AS overlap FROM scores a JOIN scores b ON a.row_key = b.row_key AND a.benchmark <> b.benchmark GROUP BY ALL HAVING count(*) >= 8)
SELECT a AS task, arg_max(b, (round(r, 9), b)) AS neighbour, {R('max(r)')} AS r, {R('avg(abs(r))')} AS mean_abs_r FROM p GROUP BY a""")
def neighbour(spark, sf):
    c = M.pairwise_correlations(scores(spark, sf), _TASKS).withColumn("r", F.round("r", 9))
    return M.best_neighbour(c).select("task", "neighbour", r6("r").alias("r"), r6("mean_abs_r").alias("mean_abs_r"))


_REVEAL = """pe AS (SELECT q.row_key, q.base_model, q.scheme, q.benchmark, q.score, b.score AS base_score FROM scores q JOIN scores b ON b.row_key = 'BASE::' || q.base_model AND b.benchmark = q.benchmark WHERE q.row_key LIKE 'QUANT::%'),
rv AS (SELECT *, row_number() OVER (PARTITION BY row_key ORDER BY (CAST(substr(benchmark, 5) AS INT) * 7 + CAST(substr(base_model, 2) AS INT)) % 11, benchmark) <= 3 AS revealed, count(*) OVER (PARTITION BY row_key) AS n FROM pe)"""


def revealed(spark, sf):
    order = (F.substring("benchmark", 5, 3).cast("int") * 7 + F.substring("base_model", 2, 12).cast("int")) % 11
    s = scores(spark, sf)
    return s, M.reveal(M.paired_entries(s), order)


@query("m11_reveal_hide", f"WITH {SCORES_SQL}, {_REVEAL} SELECT row_key, benchmark, revealed FROM rv WHERE n >= 5")
def reveal(spark, sf):
    return revealed(spark, sf)[1].select("row_key", "benchmark", "revealed")


@query("m12_severe_scorecard", f"""WITH {SCORES_SQL}, {_REVEAL}, u AS (SELECT row_key, avg(score - base_score) AS p FROM rv WHERE n >= 5 AND revealed GROUP BY 1), sm AS (SELECT scheme, avg(delta) AS s FROM obs GROUP BY 1),
h AS (SELECT scheme, score - base_score AS t, p, s FROM rv JOIN u USING (row_key) JOIN sm USING (scheme) WHERE n >= 5 AND NOT revealed), g AS (SELECT scheme, avg(p) AS pm, avg(t) AS tm FROM h GROUP BY 1)
SELECT count(*) AS n, {R('avg(abs(t - p))')} AS mae, {R('avg(abs(t - s))')} AS mae_scheme_mean, {R('avg(abs(t))')} AS mae_zero, {R('avg(abs(p))')} AS mean_abs_pred, count(*) FILTER (WHERE t <= -3) AS n_severe,
  count(*) FILTER (WHERE t <= -3 AND p <= -1.5) AS severe_caught, count(*) FILTER (WHERE t > -3 AND p <= -1.5) AS false_alarms, {R('corr(p, t)')} AS corr_pred_true,
  {R('(SELECT max(pm) - min(pm) FROM g)')} AS pred_spread, {R('(SELECT max(tm) - min(tm) FROM g)')} AS true_spread FROM h""")
def severe_scorecard(spark, sf):
    """Scored on the unit's mean revealed delta as the prediction of its hidden ones."""
    s, r = revealed(spark, sf)
    r = stage(r.withColumn("true_delta", F.col("score") - F.col("base_score")))
    u = r.where("revealed").groupBy("row_key").agg(F.avg("true_delta").alias("pred_delta"))
    sm = obs(spark, sf).groupBy("scheme").agg(F.avg("delta").alias("scheme_mean"))
    return _scorecard(r.where("not revealed").join(u, "row_key").join(sm, "scheme"))


def _scorecard(p):
    t = M.scorecard(stage(p.select("scheme", "true_delta", "pred_delta", "scheme_mean")))
    return t.select(*[r6(c).alias(c) if d == "double" else c for c, d in t.dtypes])


@query("m7_low_rank_completion")
def low_rank(spark, sf):
    """One unit hidden at a time; the figures are means over five orders of revealing."""
    p = M.complete_low_rank(scores(spark, sf), _TASKS)
    sm = obs(spark, sf).groupBy("scheme").agg(F.avg("delta").alias("scheme_mean"))
    p = p.select("seed", "scheme", (F.col("score") - F.col("base_score")).alias("true_delta"),
                 (F.col("pred_score") - F.col("base_score")).alias("pred_delta")).join(sm, "scheme")
    t = M.scorecard(stage(p), "seed")
    return t.agg(F.count("*").alias("n_seeds"), *[r6(F.avg(c)).alias(c) for c in t.columns if c != "seed"])


# ------------------------------------------------------------------ predictors


def _features():
    return feature_columns(_TASKS, _METHODS)


@query("m1_ridge_lofo")
def ridge_lofo(spark, sf):
    return P.lofo_ridge(obs(spark, sf), _features())


@query("m1_ridge_coefficients")
def ridge_coefficients(spark, sf):
    """Spark ML ridge; coefficients by magnitude on the standardised scale."""
    from pairmeter.plans.local import constant_table
    m, _ = P.ridge_pipeline(obs(spark, sf), _features())
    t = constant_table(spark, {"feature": list(_features()), "coefficient": [float(x) for x in m.coefficients]})
    return t.orderBy(F.desc(F.abs("coefficient")), "feature")


@query("m2_boosting_lofo")
def boosting(spark, sf):
    return P.lofo_boosting(stage(obs(spark, sf)), _features(), families(spark, sf), iters=20)


@query("m3_grouped_cv")
def grouped_cv(spark, sf):
    return P.grouped_cv_ridge(obs(spark, sf), _features())


@query("m3_penalty_selection")
def penalty_selection(spark, sf):
    return P.select_penalties(obs(spark, sf), _features())


@query("m4_nested_tuning")
def nested(spark, sf):
    return P.nested_ridge(obs(spark, sf), _features())


# ------------------------------------------------------------------ row split and variants

_SEEDS = 5
_BUCKET_SQL = "(split_part(obs_id, '-', 1)::bigint + 3 * split_part(obs_id, '-', 3)::bigint + 5 * split_part(obs_id, '-', 4)::bigint + 7 * seed) % 10"


@query("e2_regime_row_split", f"""WITH {OBS_SQL}, sd AS (SELECT *, {_BUCKET_SQL} AS bk FROM obs, range({_SEEDS}) r(seed)), tr AS (SELECT * FROM sd WHERE bk < 5), ca AS (SELECT * FROM sd WHERE bk BETWEEN 5 AND 7), te AS (SELECT * FROM sd WHERE bk > 7),
{S.mondrian('w', 'tr', 'ca', 'te', 'seed', eps='0')}, v AS (SELECT *, 'row_split' AS config FROM w_pred) {S.evaluate('v', 'config', 'seed::varchar')}""")
def row_split(spark, sf):
    """Rows, not clusters, are split 50/30/20 per seed: the leaky protocol kept for contrast."""
    part = lambda i: F.split("obs_id", "-")[i].cast("long")
    d = obs(spark, sf).withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(_SEEDS - 1))))
    bucket = (part(0) + 3 * part(2) + 5 * part(3) + 7 * F.col("seed")) % 10
    role = F.when(bucket < 5, "train").when(bucket < 8, "cal").otherwise("test")
    h, bands = E.row_split_bands(d.select(F.col("seed").cast("string").alias("fold"), role.alias("role"), "scheme", "delta"))
    s = E.score_histogram(h.where("role = 'test'"), bands, ("fold", "scheme"), eps=0.0).withColumn("config", F.lit("row_split"))
    t = E.evaluate(s, "config")
    return t.select("config", "n_rows", "n_folds", "worst_fold", *[r6(c).alias(c) for c in EVAL])


_VARIANTS = (("scheme_only", "scheme", "fallback"), ("widen_only", "widen", "widen"), ("full", "full", "fallback"))


def _c18_sql():
    ctes, parts = [_sources("z")], []
    for name, variant, rule in _VARIANTS:
        ctes += [S.fit_split("x" + name, "z_f", "z_k", variant), S.predict("y" + name, f"x{name}_model", "obs", rule)]
        parts.append(f"""SELECT '{name}' AS variant, count(*) AS n, count(*) FILTER (WHERE v.ok) AS inside, {R('avg(v.half_width)')} AS mean_half_width,
          count(*) FILTER (WHERE v.ok AND NOT b.ok) AS gained, count(*) FILTER (WHERE b.ok AND NOT v.ok) AS lost, count(*) FILTER (WHERE b.ok AND NOT v.ok) = 0 AS is_superset
          FROM y{name}_pred v JOIN yscheme_only_pred b USING (obs_id)""")
    return f"WITH {OBS_SQL}, {', '.join(ctes)} {' UNION ALL '.join(parts)}"


@query("c18_stratification_comparison", _c18_sql())
def stratification(spark, sf):
    d = obs(spark, sf)
    reduced = C.reduce_rows(d, is_cal=is_calibration())
    s = d
    for name, variant, rule in _VARIANTS:
        model = stage(C.fit_split(*reduced, variant).select(*C.CELL, "mean", "half_width", "kept"))
        s = C.predict(s, model, rule).withColumns({f"{name}_ok": inside("delta", "lo", "hi"), f"{name}_hw": finite_or_null("half_width")})
        s = s.drop("yhat", "half_width", "level", "lo", "hi")
    v = F.array(*[F.struct(F.lit(n).alias("variant"), F.col(f"{n}_ok").alias("ok"), F.col(f"{n}_hw").alias("hw")) for n, _, _ in _VARIANTS])
    t = s.select(F.col("scheme_only_ok").alias("base"), F.explode(v).alias("v")).select("base", "v.*")
    n = lambda c: F.sum(c.cast("long"))
    t = t.groupBy("variant").agg(F.count("*").alias("n"), n(F.col("ok")).alias("inside"), r6(F.avg("hw")).alias("mean_half_width"),
                                 n(F.col("ok") & ~F.col("base")).alias("gained"), n(F.col("base") & ~F.col("ok")).alias("lost"))
    return t.withColumn("is_superset", F.col("lost") == 0)
