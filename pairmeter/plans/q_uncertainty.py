"""Queries: cluster bootstrap, robust intervals, correlation."""

from pyspark.sql import functions as F

from pairmeter.functions.exprs import inside, r6
from pairmeter.operators import conformal as C
from pairmeter.operators import folds as E
from pairmeter.operators import resample as U
from pairmeter.operators.stats import lofo_errors
from pairmeter.plans import sql as S
from pairmeter.plans.q_folds import PAIRS_SQL, scores
from pairmeter.plans.registry import query
from pairmeter.plans.staging import stage
from pairmeter.plans.views import OBS_SQL, families, obs, runs, RUNS_SQL

R = S.r6
_CL = """cl AS (SELECT scheme, band, base_model, sum(ok_one::int) AS ok, count(*) AS n FROM y_pred GROUP BY ALL)"""


def _cells(spark, sf, col="ok_one"):
    return stage(scores(spark, sf).groupBy("scheme", "band", "base_model")
                 .agg(F.sum(col).alias("ok"), F.sum("pairs").alias("n")))


@query("u1_exact_cluster_bootstrap", f"""{PAIRS_SQL}, {_CL}, {S.exact_bootstrap('b', 'cl', 'scheme, band')}
SELECT scheme, band, k, {R('boot_lo')} AS boot_lo, {R('boot_hi')} AS boot_hi FROM b_exact""")
def exact_bootstrap(spark, sf):
    t = U.exact_bounds(_cells(spark, sf), ["scheme", "band"])
    return t.select("scheme", "band", F.col("k").cast("long").alias("k"), r6("boot_lo").alias("boot_lo"), r6("boot_hi").alias("boot_hi"))


def _bounds(t, *keys):
    return t.select(*keys, r6("boot_lo").alias("boot_lo"), r6("boot_hi").alias("boot_hi"))


_B = f"{R('boot_lo')} AS boot_lo, {R('boot_hi')} AS boot_hi"


@query("u2_monte_carlo_cluster_bootstrap", f"""{PAIRS_SQL}, {_CL}, big AS (SELECT * FROM cl QUALIFY count(*) OVER (PARTITION BY scheme, band) > 8),
{S.draws('d', 'big', 'scheme, band', ['ok', 'n'], 20_000)}, {S.draw_bounds('x', 'd_d', 'scheme, band', '100.0::DOUBLE * ok / n', 0.05, 0.95)} SELECT scheme, band, {_B} FROM x_b""")
def monte_carlo(spark, sf):
    c = _cells(spark, sf)
    large = U.with_cluster_count(c, ["scheme", "band"]).where(F.col("k") > U.EXACT_MAX).drop("k")
    return _bounds(U.monte_carlo_bounds(large, ["scheme", "band"], draws=20_000), "scheme", "band")


# ------------------------------------------------------------------ a new cohort under a frozen model

_COHORT = f"""trainset AS (SELECT * FROM obs WHERE family <> 'EUROPE'), cohort AS (SELECT * FROM obs WHERE family = 'EUROPE'),
x_f AS (SELECT * FROM trainset WHERE CAST(substr(base_model, 2) AS INT) % 3 <> 0),
x_k AS (SELECT * FROM trainset WHERE CAST(substr(base_model, 2) AS INT) % 3 = 0),
{S.fit_split('x', 'x_f', 'x_k')}, {S.predict('y', 'x_model', 'cohort')}"""
COHORT_SQL = f"WITH {OBS_SQL}, {_COHORT}"


def cohort(spark, sf):
    """The EUROPE rows scored by the band fitted on the other families."""
    from pairmeter.plans.views import is_calibration
    d = obs(spark, sf)
    model = C.fit_rows(d.where("family <> 'EUROPE'"), is_calibration())
    s = C.predict(d.where("family = 'EUROPE'"), model)
    return s.withColumn("ok", inside("delta", "lo", "hi")), d, model


def _cohort_clusters(spark, sf):
    s, _, _ = cohort(spark, sf)
    return stage(s.groupBy("scheme", F.col("model").alias("base_model"))
                 .agg(F.sum(F.col("ok").cast("int")).alias("ok"), F.count("*").alias("n")))


_CCL = "cl AS (SELECT scheme, model AS base_model, sum(ok::int) AS ok, count(*) AS n FROM y_pred GROUP BY ALL)"


@query("u5_cluster_robust_interval", f"""{COHORT_SQL}, {_CCL}, {S.sandwich('r', 'cl', 'scheme')}
SELECT scheme, k, {R('p')} AS p, {R('se')} AS se, {R('se_naive')} AS se_naive, {R('p - 1.96 * se')} AS lo, {R('p + 1.96 * se')} AS hi,
  {R('CASE WHEN se_naive > 0 THEN se / se_naive END')} AS se_ratio, {R('3.92 * se_naive')} AS width_naive, {R('3.92 * se')} AS width_robust FROM r_rob""")
def cluster_robust(spark, sf):
    t = U.sandwich(_cohort_clusters(spark, sf), ["scheme"])
    return t.select("scheme", "k", *[r6(c).alias(c) for c in ("p", "se", "se_naive", "lo", "hi", "se_ratio", "width_naive", "width_robust")])


@query("u6_intraclass_correlation", f"""{COHORT_SQL}, t AS (SELECT scheme, model, ok::int AS y FROM y_pred),
c AS (SELECT scheme, model, avg(y) AS m, count(*) AS n FROM t GROUP BY ALL),
g AS (SELECT scheme, avg(y) AS p, count(*) AS nn FROM t GROUP BY ALL),
b AS (SELECT scheme, count(*) AS k, any_value(nn) AS nn, sum(n * (m - p) ** 2) / nullif(count(*) - 1, 0) AS msb, sum(n ** 2) AS mm, max(n) AS max_rows
  FROM c JOIN g USING (scheme) GROUP BY scheme),
w AS (SELECT scheme, sum((y - m) ** 2) AS ssw FROM t JOIN c USING (scheme, model) GROUP BY scheme),
i AS (SELECT scheme, k, nn, max_rows, msb, ssw / nullif(nn - k, 0) AS msw, (nn - mm / nn) / nullif(k - 1, 0) AS m0 FROM b JOIN w USING (scheme)),
j AS (SELECT *, (msb - msw) / nullif(msb + (m0 - 1) * msw, 0) AS icc FROM i)
SELECT scheme, k, nn AS n, {R('icc')} AS icc, CASE WHEN icc IS NOT NULL THEN {R('1 + (nn / k - 1) * greatest(0, icc)')} END AS design_effect, max_rows FROM j""")
def intraclass(spark, sf):
    t = U.intraclass(_cohort_clusters(spark, sf), ["scheme"])
    return t.select("scheme", "k", F.col("n").cast("long").alias("n"), r6("icc").alias("icc"),
                    r6("design_effect").alias("design_effect"), F.col("max_rows").cast("long").alias("max_rows"))


@query("u3_ratio_bootstrap", f"""{COHORT_SQL}, {_CCL}, {S.free_draws('d', 'cl', 'scheme', ['ok', 'n'], 10_000)},
{S.draw_bounds('x', 'd_d', 'scheme', '100.0::DOUBLE * ok / n', 0.025, 0.975)} SELECT scheme, {_B} FROM x_b""")
def ratio_bootstrap(spark, sf):
    return _bounds(U.monte_carlo_bounds(_cohort_clusters(spark, sf), ["scheme"], draws=10_000, lo=0.025, hi=0.975, free=True), "scheme")


@query("u4_coverage_with_exact_interval")
def exact_interval(spark, sf):
    t = _cohort_clusters(spark, sf).groupBy("scheme").agg(F.sum("ok").alias("k"), F.sum("n").alias("n"))
    return t.withColumn("ci", U.clopper_pearson("k", "n")).select(
        "scheme", "k", "n", (F.col("k") / F.col("n")).alias("coverage"), r6("ci.lo").alias("lo"), r6("ci.hi").alias("hi"))


_SIDES = f"""{_COHORT.replace('cohort AS (SELECT * FROM obs WHERE family', 'cohort AS (SELECT * FROM obs), late AS (SELECT * FROM obs WHERE family')},
sd AS (SELECT CASE WHEN family = 'EUROPE' THEN 'out' ELSE 'in' END AS side, base_model, sum(ok::int) AS ok, count(*) AS n FROM y_pred GROUP BY ALL)"""


@query("u7_coverage_difference_bootstrap", f"""WITH {OBS_SQL}, {_SIDES}, {S.draws('d', 'sd', 'side', ['ok', 'n'], 20_000)},
f AS (SELECT 'in-out' AS contrast, a.draw, 100 * (a.ok::DOUBLE / a.n - b.ok::DOUBLE / b.n) AS v FROM d_d a JOIN d_d b ON a.draw = b.draw AND a.side = 'in' AND b.side = 'out'),
{S.draw_bounds('x', 'f', 'contrast', 'v', 0.025, 0.975)} SELECT contrast, {_B} FROM x_b""")
def difference_bootstrap(spark, sf):
    """Coverage inside the fitted families minus coverage in the new one; the two cluster pools are drawn separately."""
    _, d, model = cohort(spark, sf)
    s = C.predict(d, model).withColumn("ok", inside("delta", "lo", "hi"))
    side = F.when(F.col("family") == "EUROPE", "out").otherwise("in")
    c = stage(s.groupBy(side.alias("side"), "base_model").agg(F.sum(F.col("ok").cast("int")).alias("ok"), F.count("*").alias("n")))
    dr = stage(U.draws_table(c, ["side"], ["ok", "n"], 20_000))
    a, b = (dr.where(F.col("side") == x).select("draw", (F.col("ok") / F.col("n")).alias(x)) for x in ("in", "out"))
    diff = a.join(b, "draw").select(F.lit("in-out").alias("contrast"), "draw", (100 * (F.col("in") - F.col("out"))).alias("v"))
    return _bounds(U.percentile_bounds(diff, ["contrast"], "v", 0.025, 0.975), "contrast")


@query("u8_paired_gain", f"""WITH {OBS_SQL}, fams AS (SELECT DISTINCT family AS f FROM obs),
g AS (SELECT f, avg(delta) AS gm FROM fams JOIN obs ON family <> f GROUP BY f),
s AS (SELECT f, scheme, avg(delta) AS sm FROM fams JOIN obs ON family <> f GROUP BY ALL),
e AS (SELECT family, abs(delta - gm) - abs(delta - coalesce(sm, gm)) AS gain FROM obs JOIN g ON g.f = family
  LEFT JOIN s ON s.f = family AND s.scheme = obs.scheme)
SELECT family, count(*) AS n, {R('avg(gain)')} AS mean_gain, avg(gain) > 0 AS positive FROM e GROUP BY family""")
def paired_gain(spark, sf):
    t = lofo_errors(obs(spark, sf)).groupBy("family").agg(
        F.sum("n").alias("n"), (F.sum("gain") / F.sum("n")).alias("g"))
    return t.select("family", "n", r6("g").alias("mean_gain"), (F.col("g") > 0).alias("positive"))


_LOFO_CL = f"""WITH {OBS_SQL}, {S.LOFO}, cl AS (SELECT 'all' AS metric, family, base_model, count(*) AS n, sum(e_global) AS eg, sum(e_scheme) AS es, sum(e_task) AS et,
  sum(e_scheme_task) AS est, sum(e_global - e_scheme) AS gain FROM e GROUP BY ALL)"""


@query("u8_paired_gain_bootstrap", f"""{_LOFO_CL}, {S.draws('d', 'cl', 'metric', ['gain', 'n'], 20_000)},
{S.draw_bounds('x', 'd_d', 'metric', 'gain / n', 0.025, 0.975)} SELECT 'gain' AS metric, {_B} FROM x_b""")
def paired_gain_bootstrap(spark, sf):
    c = stage(lofo_errors(obs(spark, sf)).groupBy(F.lit("gain").alias("metric"), "base_model")
              .agg(F.sum("gain").alias("ok"), F.sum("n").alias("n")))
    return _bounds(U.monte_carlo_bounds(c, ["metric"], draws=20_000, lo=0.025, hi=0.975, scale=1.0), "metric")


@query("u9_skill_bootstrap_by_family", f"""{_LOFO_CL}, fam AS (SELECT 'skill' AS metric, family, sum(eg) AS eg, sum(es) AS es, sum(n) AS n FROM cl GROUP BY family),
{S.draws('d', 'fam', 'metric', ['eg', 'es', 'n'], 5_000, cluster='family')}, {S.draw_bounds('x', 'd_d', 'metric', '(eg - es) / n', 0.025, 0.975)}
SELECT metric, {_B}, (SELECT {R('avg(((eg - es) / n > 0)::INT)')} FROM d_d) AS p_positive FROM x_b""")
def skill_bootstrap(spark, sf):
    """5000 family draws of MAE(global mean) - MAE(scheme mean), with P(skill > 0)."""
    c = stage(lofo_errors(obs(spark, sf)).groupBy(F.lit("skill").alias("metric"), "family")
              .agg(F.sum("err_global").alias("eg"), F.sum("err_scheme").alias("es"), F.sum("n").alias("n")))
    d = U.draws_table(c, ["metric"], ["eg", "es", "n"], 5000, cluster="family").withColumn(
        "v", (F.col("eg") - F.col("es")) / F.col("n"))
    d = stage(d)
    p = d.groupBy("metric").agg(r6(F.avg((F.col("v") > 0).cast("int"))).alias("p_positive"))
    return _bounds(U.percentile_bounds(d, ["metric"], "v", 0.025, 0.975), "metric").join(p, "metric")


@query("u10_error_difference_cis", f"""{_LOFO_CL}, {S.draws('d', 'cl', 'metric', ['n', 'eg', 'es', 'et', 'est'], 20_000)},
f AS (SELECT unnest(['scheme', 'task', 'scheme_task']) AS predictor, unnest([(es - eg) / n, (et - eg) / n, (est - eg) / n]) AS v FROM d_d),
{S.draw_bounds('x', 'f', 'predictor', 'v', 0.025, 0.975)} SELECT predictor, {_B} FROM x_b""")
def error_differences(spark, sf):
    """Cluster bootstrap of several error columns at once: each predictor against the global mean."""
    c = stage(lofo_errors(obs(spark, sf)).groupBy(F.lit("all").alias("metric"), "base_model").agg(
        F.sum("n").alias("n"), *[F.sum("err_" + p).alias(p) for p in ("global", "scheme", "task", "scheme_task")]))
    d = U.draws_table(c, ["metric"], ["n", "global", "scheme", "task", "scheme_task"], 20_000)
    diffs = F.array(*[F.struct(F.lit(p).alias("predictor"), ((F.col(p) - F.col("global")) / F.col("n")).alias("v"))
                      for p in ("scheme", "task", "scheme_task")])
    d = d.select("draw", F.explode(diffs).alias("x")).select("draw", "x.*")
    return _bounds(U.percentile_bounds(stage(d), ["predictor"], "v", 0.025, 0.975), "predictor")


@query("u11_rejected_row_bound", f"""WITH {OBS_SQL}, {_COHORT}
SELECT scheme, count(*) AS n, sum(ok::int)::bigint AS k, count(*) FILTER (WHERE orient_src = 'header_only') AS r,
  {R("sum(ok::int) / (count(*) + count(*) FILTER (WHERE orient_src = 'header_only'))")} AS worst_case,
  {R("(sum(ok::int) + count(*) FILTER (WHERE orient_src = 'header_only')) / (count(*) + count(*) FILTER (WHERE orient_src = 'header_only'))")} AS best_case
FROM y_pred GROUP BY scheme""")
def rejected_bound(spark, sf):
    """Range of the coverage had r rejected rows all missed, or all been inside (here the rows
    whose orientation rests on the header alone stand for the rejected ones)."""
    s, _, _ = cohort(spark, sf)
    t = s.groupBy("scheme").agg(F.count("*").alias("n"), F.sum(F.col("ok").cast("int")).alias("k"),
                                F.sum((F.col("orient_src") == "header_only").cast("int")).alias("r"))
    full = F.col("n") + F.col("r")
    return t.withColumns({"worst_case": r6(F.col("k") / full), "best_case": r6((F.col("k") + F.col("r")) / full)})


@query("u12_fold_coverage", f"""{PAIRS_SQL}, f AS (SELECT family, count(*) AS pairs, count(DISTINCT base_model) AS clusters, avg(ok::int) AS c FROM y_pred GROUP BY family)
SELECT family, pairs, clusters, {R('100 * c')} AS coverage_pct, c < 0.9 AS below_nominal,
  CASE WHEN clusters <= 10 THEN (factorial((2 * clusters - 1)::INT) / factorial(clusters::INT) / factorial((clusters - 1)::INT))::bigint END AS n_resamples FROM f""")
def fold_coverage(spark, sf):
    t = scores(spark, sf).groupBy("family").agg(
        F.sum("pairs").alias("pairs"), F.countDistinct("base_model").alias("clusters"), (F.sum("ok") / F.sum("pairs")).alias("c"))
    k = F.col("clusters").cast("int")
    comb = F.when(k <= 10, F.round(F.factorial(2 * k - 1) / F.factorial(k) / F.factorial(k - 1)).cast("long"))
    return t.select("family", "pairs", "clusters", r6(100 * F.col("c")).alias("coverage_pct"),
                    (F.col("c") < 0.9).alias("below_nominal"), comb.alias("n_resamples"))


@query("u12_fold_coverage_bootstrap", f"""{PAIRS_SQL}, cl AS (SELECT family, base_model, sum(ok::int) AS ok, count(*) AS n FROM y_pred GROUP BY ALL),
{S.draws('d', 'cl', 'family', ['ok', 'n'], 2_000)}, {S.draw_bounds('x', 'd_d', 'family', '100.0::DOUBLE * ok / n', 0.025, 0.975)} SELECT family, {_B} FROM x_b""")
def fold_coverage_bootstrap(spark, sf):
    c = stage(scores(spark, sf).groupBy("family", "base_model").agg(F.sum("ok").alias("ok"), F.sum("pairs").alias("n")))
    return _bounds(U.monte_carlo_bounds(c, ["family"], draws=2_000, lo=0.025, hi=0.975), "family")


@query("u13_correlations", f"""WITH {RUNS_SQL}, r AS (SELECT acc_before, delta,
  avg(rb) OVER (PARTITION BY acc_before) AS rx, avg(rd) OVER (PARTITION BY delta) AS ry FROM
  (SELECT acc_before, delta, row_number() OVER (ORDER BY acc_before) AS rb, row_number() OVER (ORDER BY delta) AS rd
   FROM (SELECT round(acc_before, 6) AS acc_before, round(delta, 6) AS delta FROM runs)))
SELECT count(*) AS n, {R('corr(acc_before, delta)')} AS pearson, {R('corr(rx, ry)')} AS spearman FROM r""")
def correlations(spark, sf):
    d = runs(spark, sf).select(F.round("acc_before", 6).alias("acc_before"), F.round("delta", 6).alias("delta"))
    t = U.correlations(d, "acc_before", "delta")
    return t.select("n", r6("pearson").alias("pearson"), r6("spearman").alias("spearman"))
