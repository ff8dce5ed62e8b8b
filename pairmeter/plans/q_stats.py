"""Queries: sources, projections, joins, grouped statistics."""

from pyspark.sql import Window, functions as F

from pairmeter.functions import exprs, vocab
from pairmeter.functions.exprs import r6
from pairmeter.operators import conformal as C
from pairmeter.operators import joins as J
from pairmeter.operators import stats as A
from pairmeter.operators.order_stats import finite_or_null, histogram, kth_smallest
from pairmeter.plans import sql as S
from pairmeter.plans.q_uncertainty import COHORT_SQL, cohort
from pairmeter.plans.registry import query
from pairmeter.plans.staging import stage
from pairmeter.plans.views import (
    FOUR_BIT, NEAR_LOSSLESS, OBS_RAW_SQL, OBS_SQL, RUNS_SQL, BAND_CASE_SQL, IS_CAL_SQL, is_calibration, obs, obs_raw, runs, table)
from pairmeter.sources import readers

R = S.r6
QUIET = "scheme IN ('af', 'ao')"

# ------------------------------------------------------------------ sources


@query("src2_observation_scan", f"""WITH {OBS_RAW_SQL} SELECT obs_id, scheme, {R('acc_before')} AS acc_before, {R('delta')} AS delta
FROM obs_raw WHERE acc_before >= 20 AND verified = 1""")
def observation_scan(spark, sf):
    return readers.keep(obs_raw(spark, sf), verified_only=True).select(
        "obs_id", "scheme", r6("acc_before").alias("acc_before"), r6("delta").alias("delta"))


@query("src3_fail_closed_read", """SELECT 'lineitem' AS name, count(*) AS n FROM lineitem""")
def fail_closed(spark, sf):
    d = readers.read_evidence(spark, f"{sf}/lineitem.parquet")
    return d.agg(F.lit("lineitem").alias("name"), F.count("*").alias("n")).select("name", "n")


_LISTED = "SELECT DISTINCT r_name || '-' || 'S' || (l_suppkey % 7) || '-' || lower(l_returnflag || l_linestatus) AS id FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"


@query("src4_catalog_filter", f"""WITH ids AS ({_LISTED}), m AS (SELECT id, regexp_matches(id, '-(af|nf|no)$') AS matching,
  (contains(lower(id), 'europe') OR contains(lower(id), 'asia')) AS wanted FROM ids),
g AS (SELECT regexp_replace(id, '-S.*$', '') AS name_group, count(*) AS n FROM m WHERE matching AND NOT wanted GROUP BY 1 ORDER BY n DESC, name_group LIMIT 15)
SELECT 'listed' AS stage, '*' AS name_group, count(*) AS n FROM m UNION ALL SELECT 'matching', '*', count(*) FROM m WHERE matching
UNION ALL SELECT 'targeted', '*', count(*) FROM m WHERE matching AND wanted UNION ALL SELECT 'excluded', '*', count(*) FROM m WHERE matching AND NOT wanted
UNION ALL SELECT 'excluded_group', name_group, n FROM g""")
def catalog_filter(spark, sf):
    li = table(spark, sf, "lineitem").select(
        "l_suppkey", F.lower(F.concat("l_returnflag", "l_linestatus")).alias("sch")).distinct()
    sup, nat, reg = (table(spark, sf, t) for t in ("supplier", "nation", "region"))
    ids = (li.join(sup, F.col("l_suppkey") == F.col("s_suppkey")).join(nat, F.col("s_nationkey") == F.col("n_nationkey"))
           .join(reg, F.col("n_regionkey") == F.col("r_regionkey"))
           .select(F.concat("r_name", F.lit("-S"), F.col("l_suppkey") % 7, F.lit("-"), "sch").alias("id")).distinct())
    return readers.catalog_filter(ids, r"-(af|nf|no)$", ["EUROPE", "ASIA"], group=F.regexp_replace("id", "-S.*$", ""))


# ------------------------------------------------------------------ projections


@query("pr1_size_band", f"""WITH {OBS_RAW_SQL} SELECT {BAND_CASE_SQL} AS band, count(*) AS n, min(params_b) AS lo, max(params_b) AS hi
FROM (SELECT * REPLACE (CASE WHEN params_b = 3.5 THEN NULL ELSE params_b END AS params_b) FROM obs_raw) GROUP BY 1""")
def size_band(spark, sf):
    d = obs_raw(spark, sf).withColumn("params_b", F.when(F.col("params_b") != 3.5, F.col("params_b")))
    return d.groupBy(exprs.size_band("params_b").alias("band")).agg(
        F.count("*").alias("n"), F.min("params_b").alias("lo"), F.max("params_b").alias("hi"))


_MOE_NAME = "CASE s_suppkey % 5 WHEN 0 THEN 'Mixtral-8x7B-' WHEN 1 THEN 'Qwen3-30B-A3B-' WHEN 2 THEN 'Llama-4-Scout-17B-16E-' WHEN 3 THEN 'gemma-2-9b-it-' ELSE 'granite-8b-' END || s_suppkey"


def _moe_name():
    k = F.col("s_suppkey") % 5
    base = (F.when(k == 0, "Mixtral-8x7B-").when(k == 1, "Qwen3-30B-A3B-").when(k == 2, "Llama-4-Scout-17B-16E-")
            .when(k == 3, "gemma-2-9b-it-").otherwise("granite-8b-"))
    return F.concat(base, "s_suppkey")


@query("pr2_moe_flag", rf"""SELECT {_MOE_NAME} AS name, regexp_matches({_MOE_NAME}, '(\d+x\d+b|a\d+(\.\d+)?b|[-_]\d+e[-_]|mixtral|moe)', 'i') AS moe FROM supplier""")
def moe_flag(spark, sf):
    return table(spark, sf, "supplier").select(_moe_name().alias("name"), exprs.is_moe(_moe_name()).alias("moe"))


@query("pr3_annotate", f"""WITH {OBS_SQL} SELECT scheme || ' | ' || band AS stratum, count(*) AS n FROM obs GROUP BY 1""")
def annotate(spark, sf):
    return exprs.annotate(obs(spark, sf)).groupBy("stratum").agg(F.count("*").alias("n"))


_P = "greatest(least(acc_before / 100, 1 - 1e-3), 1e-3)"


@query("pr5_noise_scale", f"""WITH {OBS_SQL} SELECT obs_id, {R(f'100 * sqrt(2 * {_P} * (1 - {_P}) / n_items)')} AS noise FROM obs""")
def noise(spark, sf):
    return obs(spark, sf).select("obs_id", r6(exprs.noise_scale()).alias("noise"))


_TASKS = [f"task{i}" for i in range(1, 8)]
_METHODS = ["gptq", "rtn", "awq"]
_FEATS = {"log2_weight_compression": "log2(16.0 / weight_bits)", "log2_act_compression": "log2(16.0 / act_bits)",
          "exp_neg_weight_bits": "exp(-weight_bits / 4.0)", "acts_quantized": "(act_bits < 16)::int",
          "num_type_int": "(num_type = 'int')::int", "act_scale_dynamic": "(scheme = 'fp8_dynamic')::int",
          "log10_params_b": "log10(params_b)", "is_instruct": "is_instruct", "acc_before_share": "acc_before / 100",
          "headroom_var": "acc_before * (100 - acc_before) / 10000", "analytic_noise_pp": f"100 * sqrt(2 * {_P} * (1 - {_P}) / n_items)",
          **{f"bench={t}": f"(benchmark = '{t}')::int" for t in _TASKS}, **{f"method={m}": f"(method = '{m}')::int" for m in _METHODS}}


@query("pr6_feature_vector", f"WITH {OBS_SQL} SELECT obs_id, " + ", ".join(f'{R(f"({e})::double")} AS "{n}"' for n, e in _FEATS.items()) + " FROM obs")
def features(spark, sf):
    return obs(spark, sf).select("obs_id", *[r6(c.cast("double")).alias(n) for n, c in exprs.feature_columns(_TASKS, _METHODS).items()])


@query("pr8_cohort_label", """SELECT n_name, CASE WHEN contains(lower(n_name), 'united') THEN 'united' WHEN contains(lower(n_name), 'an') THEN 'an'
  WHEN contains(lower(n_name), 'a') THEN 'a' ELSE 'other' END AS cohort FROM nation""")
def cohort_label(spark, sf):
    return table(spark, sf, "nation").select("n_name", exprs.cohort_label("n_name", ["united", "an", "a"], F.lit("other")).alias("cohort"))


@query("pr9_strict_subset", f"""WITH {OBS_SQL} SELECT family, count(*) AS n FROM obs WHERE NOT regexp_matches(model, '/(ro|no)$')
  AND family NOT IN (SELECT DISTINCT family FROM obs WHERE scheme = 'ro') GROUP BY family""")
def strict_subset(spark, sf):
    d = obs(spark, sf)
    seen = d.where("scheme = 'ro'").select("family").distinct()
    return J.strict_subset(d, seen, r"/(ro|no)$").groupBy("family").agg(F.count("*").alias("n"))


@query("pr11_normalise_external", f"""WITH {RUNS_SQL} SELECT model, benchmark, 'adversarial' AS family, CASE benchmark WHEN 'task1' THEN 100 WHEN 'task2' THEN 200 END AS n_items,
  {R('acc_after - acc_before')} AS delta, band, 'int' AS num_type, 'adversarial' AS method, 0 AS verified, 'measured_locally' AS orient_src, 1 AS is_adversarial FROM runs""")
def normalise_external(spark, sf):
    from pairmeter.plans.local import constant_table
    ext = runs(spark, sf).select("model", "base_model", "scheme", "params_b", "benchmark", "acc_before", "acc_after")
    items = constant_table(spark, {"benchmark": ["task1", "task2"], "vocab_items": [100, 200]})
    t = J.normalise_external(ext, items)
    return t.select("model", "benchmark", "family", "n_items", r6(F.col("acc_after") - F.col("acc_before")).alias("delta"), "band", "num_type",
                    "method", "verified", "orient_src", "is_adversarial")


# ------------------------------------------------------------------ joins


@query("j1_partition_split", f"""WITH {OBS_SQL}, cal AS (SELECT DISTINCT base_model FROM obs WHERE {IS_CAL_SQL})
SELECT CASE WHEN base_model IN (SELECT base_model FROM cal) THEN 'calibration' ELSE 'fit' END AS side, count(*) AS n, count(DISTINCT base_model) AS clusters FROM obs GROUP BY 1""")
def partition_split(spark, sf):
    d = obs(spark, sf)
    cal = d.where(is_calibration()).select("base_model").distinct()
    side = lambda how, name: d.join(cal, "base_model", how).agg(
        F.lit(name).alias("side"), F.count("*").alias("n"), F.countDistinct("base_model").alias("clusters"))
    return side("left_semi", "calibration").unionByName(side("left_anti", "fit"))


@query("j5_control_arm", f"""WITH {RUNS_SQL} SELECT t.model, t.benchmark, round(t.delta, 9) + 0.0 AS delta, round(c.delta, 9) + 0.0 AS ctrl_delta, round(t.delta - c.delta, 9) + 0.0 AS excess
FROM runs t JOIN runs c ON c.is_control = 1 AND c.base_model = t.base_model AND c.benchmark = t.benchmark WHERE t.is_control = 0""")
def control_arm(spark, sf):
    return J.excess_over_control(runs(spark, sf)).select(
        "model", "benchmark", *[F.round(c, 9).alias(c) for c in ("delta", "ctrl_delta", "excess")])


@query("j6_reference_drift", f"""WITH {RUNS_SQL}, ref AS (SELECT base_model, benchmark, avg(acc_before) AS ref FROM obs GROUP BY ALL)
SELECT model, benchmark, {R('ref')} AS ref, {R('acc_before')} AS acc_before, {R('abs(ref - acc_before)')} AS gap FROM runs JOIN ref USING (base_model, benchmark) WHERE abs(ref - acc_before) > 2""")
def reference_drift(spark, sf):
    return J.reference_drift(runs(spark, sf), obs(spark, sf)).select(
        "model", "benchmark", r6("ref").alias("ref"), r6("acc_before").alias("acc_before"), r6("gap").alias("gap"))


@query("j7_overlap_audit", f"""WITH {OBS_SQL}, a AS (SELECT * FROM obs WHERE CAST(substr(base_model, 2) AS INT) % 3 <> 0), b AS (SELECT * FROM obs WHERE CAST(substr(base_model, 2) AS INT) % 5 = 0 OR scheme = 'af')
SELECT 'unit' AS kind, count(*) AS shared FROM (SELECT model FROM a INTERSECT SELECT model FROM b)
UNION ALL SELECT 'cluster', count(*) FROM (SELECT base_model FROM a INTERSECT SELECT base_model FROM b)
UNION ALL SELECT 'unit_task', count(*) FROM (SELECT model, benchmark FROM a INTERSECT SELECT model, benchmark FROM b)
UNION ALL SELECT 'family', count(*) FROM (SELECT family FROM a INTERSECT SELECT family FROM b)""")
def overlap(spark, sf):
    d, k = obs(spark, sf), F.substring("base_model", 2, 12).cast("int")
    return J.overlap_audit(d.where(k % 3 != 0), d.where((k % 5 == 0) | (F.col("scheme") == "af")))


@query("j9_harvested_subset", f"""WITH {OBS_RAW_SQL} SELECT family, count(*) AS n FROM obs_raw WHERE base_model IN (SELECT base_model FROM obs_raw WHERE acc_before >= 98 AND scheme = 'rf') GROUP BY family""")
def harvested_subset(spark, sf):
    d = obs_raw(spark, sf)
    hit = d.where("acc_before >= 98 and scheme = 'rf'").select("base_model").distinct()
    return d.join(hit, "base_model", "left_semi").groupBy("family").agg(F.count("*").alias("n"))


@query("j10_matched_pairs", f"""WITH {OBS_SQL}, own AS (SELECT model, avg(acc_before) AS our_before, avg(delta) AS our_delta, avg(n_items) AS n FROM obs WHERE verified = 1 GROUP BY model),
pub AS (SELECT model, avg(acc_before) AS pub_before, avg(delta) AS pub_delta FROM obs GROUP BY model),
m AS (SELECT *, our_delta - pub_delta AS gap, 100 * sqrt(2 * greatest(least(our_before / 100, 1 - 1e-3), 1e-3) * (1 - greatest(least(our_before / 100, 1 - 1e-3), 1e-3)) / n) AS se FROM own JOIN pub USING (model))
SELECT model, {R('pub_before')} AS pub_before, {R('our_before')} AS our_before, {R('gap')} AS gap, {R('se')} AS se, {R('gap / se')} AS z,
  {R('CASE WHEN abs(pub_delta) > 1e-9 THEN our_delta / pub_delta END')} AS ratio, abs(our_before - pub_before) >= 2 AS refused FROM m""")
def matched_pairs(spark, sf):
    d = obs(spark, sf)
    own = d.where("verified = 1").groupBy("model").agg(
        F.avg("acc_before").alias("our_before"), F.avg("delta").alias("our_delta"), F.avg("n_items").alias("n_items"))
    pub = d.groupBy("model").agg(F.avg("acc_before").alias("pub_before"), F.avg("delta").alias("pub_delta"))
    t = J.matched_pairs(own, pub)
    return t.select("model", *[r6(c).alias(c) for c in ("pub_before", "our_before", "gap", "se", "z", "ratio")], "refused")


@query("j11_feature_join_report", f"""WITH {OBS_SQL}, l AS (SELECT base_model, avg(delta) AS v FROM obs WHERE scheme = 'rf' GROUP BY 1), r AS (SELECT base_model, avg(acc_before) AS f FROM obs WHERE family IN ('EUROPE', 'ASIA') GROUP BY 1)
SELECT count(*) FILTER (WHERE f IS NULL) AS left_only, count(*) FILTER (WHERE v IS NULL) AS right_only, count(*) FILTER (WHERE f IS NOT NULL AND v IS NOT NULL) AS both_sides FROM l FULL JOIN r USING (base_model)""")
def feature_join(spark, sf):
    d = obs(spark, sf)
    left = d.where("scheme = 'rf'").groupBy("base_model").agg(F.avg("delta").alias("v"))
    right = d.where("family in ('EUROPE', 'ASIA')").groupBy("base_model").agg(F.avg("acc_before").alias("f"))
    return J.feature_join(left, right, "base_model")[1]


# ------------------------------------------------------------------ grouped statistics


@query("a4_mean_baselines", f"""WITH {OBS_SQL} SELECT 'global' AS level, '*' AS scheme, '*' AS benchmark, {R('avg(delta)')} AS mean, count(*) AS n FROM obs
UNION ALL SELECT 'scheme', scheme, '*', {R('avg(delta)')}, count(*) FROM obs GROUP BY scheme UNION ALL SELECT 'task', '*', benchmark, {R('avg(delta)')}, count(*) FROM obs GROUP BY benchmark
UNION ALL SELECT 'scheme_task', scheme, benchmark, {R('avg(delta)')}, count(*) FROM obs GROUP BY scheme, benchmark""")
def baselines(spark, sf):
    return A.mean_baselines(obs(spark, sf)).select("level", "scheme", "benchmark", r6("mean").alias("mean"), "n")


_SCH = ["af", "ao", "nf", "no", "rf", "ro"]


@query("a7_contingency", f"WITH {OBS_SQL} SELECT family, " + ", ".join(f"count(*) FILTER (WHERE scheme = '{s}') AS {s}" for s in _SCH) + " FROM obs GROUP BY family")
def contingency(spark, sf):
    return A.contingency(obs(spark, sf), _SCH)


@query("a7_families_per_scheme", f"WITH {OBS_SQL} SELECT scheme, count(DISTINCT family) AS n_families FROM obs GROUP BY scheme")
def families_per_scheme(spark, sf):
    return obs(spark, sf).groupBy("scheme").agg(F.countDistinct("family").alias("n_families"))


_NOISE_E = f"100 * sqrt(2 * {_P} * (1 - {_P}) / n_items)"


@query("a8_noise_by_task", f"""WITH {OBS_SQL} SELECT benchmark, count(*) AS n_all, {R('stddev_samp(delta)')} AS sd_all, count(*) FILTER (WHERE {QUIET}) AS n_lossless,
  {R(f'stddev_samp(delta) FILTER (WHERE {QUIET})')} AS sd_lossless, {R(f'avg({_NOISE_E})')} AS analytic_se FROM obs GROUP BY benchmark""")
def noise_by_task(spark, sf):
    t = A.noise_by_task(obs(spark, sf), NEAR_LOSSLESS)
    return t.select("benchmark", "n_all", "n_lossless", *[r6(c).alias(c) for c in ("sd_all", "sd_lossless", "analytic_se")])


@query("a8_noise_overall", f"""WITH {OBS_SQL} SELECT count(*) FILTER (WHERE {QUIET}) AS n_lossless, {R(f'avg(delta) FILTER (WHERE {QUIET})')} AS mean_lossless,
  {R(f'stddev_samp(delta) FILTER (WHERE {QUIET})')} AS sd_lossless, {R('stddev_samp(delta)')} AS sd_all, {R(f'avg({_NOISE_E})')} AS analytic_se,
  {R(f'least(1, var_samp(delta) FILTER (WHERE {QUIET}) / var_samp(delta))')} AS variance_share FROM obs""")
def noise_overall(spark, sf):
    t = A.noise_overall(obs(spark, sf), NEAR_LOSSLESS)
    return t.select("n_lossless", *[r6(c).alias(c) for c in ("mean_lossless", "sd_lossless", "sd_all", "analytic_se", "variance_share")])


@query("a9_mae_floor", f"""WITH {OBS_SQL}, q AS (SELECT benchmark, delta, avg(delta) OVER (PARTITION BY benchmark) AS m, count(*) OVER (PARTITION BY benchmark) AS c FROM obs WHERE {QUIET}),
e AS (SELECT benchmark, max(c) AS n_lossless, avg(abs(delta - m)) AS e FROM q WHERE c >= 4 GROUP BY 1), w AS (SELECT benchmark, count(*) AS w FROM obs GROUP BY 1)
SELECT benchmark, w, n_lossless, {R('e')} AS e_abs_noise, {R('(SELECT sum(e * w) / sum(w) FROM e JOIN w USING (benchmark))')} AS mae_floor FROM e JOIN w USING (benchmark)""")
def mae_floor(spark, sf):
    t = stage(A.mae_floor(obs(spark, sf), NEAR_LOSSLESS))
    floor = t.agg(F.sum(F.col("e_abs_noise") * F.col("w")) / F.sum("w")).scalar()
    return t.select("benchmark", "w", "n_lossless", r6("e_abs_noise").alias("e_abs_noise"), r6(floor).alias("mae_floor"))


@query("a10_noise_share_registry", f"""WITH {OBS_SQL}, s AS (SELECT benchmark, var_samp(delta) FILTER (WHERE {QUIET}) / var_samp(delta) AS share FROM obs GROUP BY 1
  HAVING count(*) >= 20 AND count(*) FILTER (WHERE {QUIET}) >= 8)
SELECT count(*) AS n_tasks, count(*) FILTER (WHERE share >= 1.0 / 3) AS n_third, count(*) FILTER (WHERE share >= 1) AS n_all, {R('100 * min(share)')} AS min_pct, {R('100 * max(share)')} AS max_pct FROM s""")
def noise_registry(spark, sf):
    t = A.noise_by_task(obs(spark, sf), NEAR_LOSSLESS).where("n_all >= 20 and n_lossless >= 8")
    t = t.withColumn("share", F.col("var_lossless") / F.col("var_all"))
    n = lambda c: F.sum(c.cast("long"))
    return t.agg(F.count("*").alias("n_tasks"), n(F.col("share") >= 1 / 3).alias("n_third"), n(F.col("share") >= 1).alias("n_all"),
                 r6(100 * F.min("share")).alias("min_pct"), r6(100 * F.max("share")).alias("max_pct"))


_LOFO = S.LOFO
_PRED = ("global", "scheme", "task", "scheme_task")


@query("a12_fold_weighted_mae", f"WITH {OBS_SQL}, {_LOFO} " + " UNION ALL ".join(f"SELECT '{p}' AS predictor, count(*) AS n, {R(f'avg(e_{p})')} AS mae FROM e" for p in _PRED))
def fold_weighted_mae(spark, sf):
    return _mae_table(A.lofo_errors(obs(spark, sf)))


def _mae_table(t, *keys):
    rows = F.array(*[F.struct(F.lit(p).alias("predictor"), F.col("err_" + p).alias("e")) for p in _PRED])
    return (t.select(*keys, "n", F.explode(rows).alias("x")).groupBy(*keys, "x.predictor")
            .agg(F.sum("n").alias("n"), r6(F.sum("x.e") / F.sum("n")).alias("mae")))


@query("m5_predictor_comparison", f"WITH {OBS_SQL}, {_LOFO} " + " UNION ALL ".join(f"SELECT family, '{p}' AS predictor, count(*) AS n, {R(f'avg(e_{p})')} AS mae FROM e GROUP BY family" for p in _PRED))
def predictor_comparison(spark, sf):
    return _mae_table(A.lofo_errors(obs(spark, sf)), "family")


@query("e6_leave_one_family_out", f"""WITH {OBS_SQL}, {_LOFO} SELECT family, {R('any_value(g.gm)')} AS train_mean, count(*) AS n, {R('avg(e_scheme)')} AS mae FROM e JOIN g ON g.f = e.family GROUP BY family""")
def lofo(spark, sf):
    d = obs(spark, sf)
    means = A.lofo_means(d)[0]
    t = A.lofo_errors(d).groupBy("family").agg(F.sum("n").alias("n"), r6(F.sum("err_scheme") / F.sum("n")).alias("mae"))
    return t.join(means, "family").select("family", r6("g").alias("train_mean"), "n", "mae")


@query("a22_excess_by_recipe", f"""WITH {RUNS_SQL}, x AS (SELECT t.scheme AS recipe, t.delta - c.delta AS excess FROM runs t JOIN runs c ON c.is_control = 1 AND c.base_model = t.base_model AND c.benchmark = t.benchmark WHERE t.is_control = 0)
SELECT recipe, count(*) AS n, {R('avg(excess)')} AS mean, {R('min(excess)')} AS min, {R('quantile_cont(excess, 0.05)')} AS p05 FROM x GROUP BY recipe
UNION ALL SELECT 'pool', count(*), {R('avg(excess)')}, {R('min(excess)')}, {R('quantile_cont(excess, 0.05)')} FROM x""")
def excess_by_recipe(spark, sf):
    t = A.excess_summary(stage(J.excess_over_control(runs(spark, sf)).select("scheme", "excess")))
    return t.select("recipe", "n", *[r6(c).alias(c) for c in ("mean", "min", "p05")])


@query("a23_paired_item_rollup", f"""WITH {OBS_SQL} SELECT model, benchmark, count(*) AS n_items, {R('100 * avg((acc_before >= 50)::int)')} AS acc_before, {R('100 * avg((acc_after >= 50)::int)')} AS acc_after,
  {R('avg(((acc_before >= 50) <> (acc_after >= 50))::int)')} AS flip_rate, bool_or(scheme = 'af') AS is_control FROM obs GROUP BY model, benchmark""")
def paired_items(spark, sf):
    d = obs(spark, sf)
    before = d.select("obs_id", "model", "benchmark", "scheme", (F.col("acc_before") >= 50).alias("ok_before"))
    after = d.select("obs_id", (F.col("acc_after") >= 50).alias("ok_after"))
    t = J.paired_items(before, after, "obs_id", "model", "benchmark", "scheme")
    return t.select("model", "benchmark", "n_items", r6("acc_before").alias("acc_before"), r6("acc_after").alias("acc_after"),
                    r6("flip_rate").alias("flip_rate"), (F.col("scheme") == "af").alias("is_control"))


@query("a24_channel_kurtosis", f"""WITH v AS (SELECT label AS unit, idx AS channel, embedding[idx]::double AS x FROM embeddings, range(1, 1 + (SELECT max(len(embedding)) FROM embeddings)) t(idx) WHERE idx <= len(embedding)),
m AS (SELECT unit, channel, avg(x) AS mu FROM v GROUP BY ALL),
k AS (SELECT unit, channel, avg((x - mu) ** 4) / (avg((x - mu) ** 2) ** 2) - 3 AS k FROM v JOIN m USING (unit, channel) GROUP BY ALL HAVING avg((x - mu) ** 2) > 0)
SELECT unit, count(*) AS n_channels, {R('avg(k)')} AS mean, {R('quantile_cont(k, 0.5)')} AS median, {R('quantile_cont(k, 0.99)')} AS p99, {R('max(k)')} AS max,
  {R('100 * avg((k > 3)::int)')} AS pct_gt_3, {R('100 * avg((k > 10)::int)')} AS pct_gt_10 FROM k GROUP BY unit""")
def channel_kurtosis(spark, sf):
    t = A.channel_kurtosis(table(spark, sf, "embeddings").select(F.col("label").alias("unit"), "embedding"))
    return t.select("unit", "n_channels", *[r6(c).alias(c) for c in ("mean", "median", "p99", "max", "pct_gt_3", "pct_gt_10")])


@query("a25_near_lossless_separation", f"""WITH {OBS_SQL}, s AS (SELECT benchmark, stddev_samp(delta) FILTER (WHERE {QUIET}) AS sl, stddev_samp(delta) FILTER (WHERE scheme IN ('nf', 'no')) AS sa FROM obs GROUP BY 1)
SELECT benchmark, {R('sl')} AS sd_lossless, {R('sa')} AS sd_four_bit, CASE WHEN sa > 1.3 * sl THEN 'real scheme effect' ELSE 'no separation' END AS verdict FROM s""")
def separation(spark, sf):
    return A.separation(obs(spark, sf), NEAR_LOSSLESS, FOUR_BIT).select(
        "benchmark", r6("sd_lossless").alias("sd_lossless"), r6("sd_four_bit").alias("sd_four_bit"), "verdict")


@query("a26_composition", f"""WITH {OBS_SQL}, r AS (SELECT family, base_model, scheme, count(DISTINCT benchmark) AS t, count(*) AS n FROM obs GROUP BY ALL)
SELECT family, sum(n)::bigint AS n, count(*) AS n_cluster_scheme, count(DISTINCT base_model) AS n_clusters, max(t) AS max_tasks_per_run, {R('sum(n) / (SELECT count(*) FROM obs)')} AS share FROM r GROUP BY family""")
def composition(spark, sf):
    return A.composition(obs(spark, sf)).withColumn("share", r6("share"))


# ------------------------------------------------------------------ a new cohort


def _summary_sql(kind, key):
    return f"""SELECT '{kind}' AS kind, {key} AS name, count(*) AS n, sum(ok::int)::bigint AS inside, {R('avg(ok::int)')} AS coverage, {R('avg(abs(delta - yhat))')} AS mae,
  {R('avg(abs(delta - gm))')} AS mae_baseline, {R('avg(delta)')} AS mean_delta, {R('min(delta)')} AS worst_delta, {R('avg(half_width)')} AS half_width FROM y GROUP BY 2"""


@query("e9_prospective_scoring", f"""{COHORT_SQL} SELECT obs_id, scheme, {R('yhat')} AS yhat, {R('lo')} AS lo, {R('hi')} AS hi, ok FROM y_pred""")
def prospective(spark, sf):
    s, _, _ = cohort(spark, sf)
    return s.select("obs_id", "scheme", *[r6(finite_or_null(c)).alias(c) for c in ("yhat", "lo", "hi")], "ok")


@query("a17_prospective_summary", f"""{COHORT_SQL}, y AS (SELECT *, (SELECT avg(delta) FROM trainset) AS gm FROM y_pred)
{_summary_sql('cohort', "CASE WHEN band = '<2B' THEN 'small' ELSE 'large' END")} UNION ALL {_summary_sql('scheme', 'scheme')} UNION ALL {_summary_sql('all', "'*'")}""")
def prospective_summary(spark, sf):
    s, d, _ = cohort(spark, sf)
    gm = d.where("family <> 'EUROPE'").agg(F.avg("delta")).scalar()
    s = s.withColumn("base_err", F.abs(F.col("delta") - gm))
    group = F.when(F.col("band") == "<2B", "small").otherwise("large")
    return A.prospective_summary(s, {"cohort": group, "scheme": F.col("scheme"), "all": F.lit("*")})


@query("a17_prospective_misses", f"""{COHORT_SQL} SELECT obs_id, scheme, benchmark, {R('delta')} AS delta, {R('lo')} AS lo, {R('hi')} AS hi FROM y_pred WHERE NOT ok""")
def prospective_misses(spark, sf):
    s, _, _ = cohort(spark, sf)
    return s.where("not ok").select("obs_id", "scheme", "benchmark", *[r6(c).alias(c) for c in ("delta", "lo", "hi")])


@query("a18_miss_distribution", f"""{COHORT_SQL}, c AS (SELECT model AS k, count(*) FILTER (WHERE NOT ok) AS m FROM y_pred GROUP BY 1), b AS (SELECT benchmark AS k, count(*) FILTER (WHERE NOT ok) AS m FROM y_pred GROUP BY 1)
SELECT 'cluster' AS kind, sum(m)::bigint AS misses, count(*) FILTER (WHERE m > 0) AS with_miss, count(*) FILTER (WHERE m = 0) AS clean, max(m) AS worst_misses, arg_max(k, (m, k)) AS worst_name FROM c
UNION ALL SELECT 'task', sum(m)::bigint, count(*) FILTER (WHERE m > 0), count(*) FILTER (WHERE m = 0), max(m), arg_max(k, (m, k)) FROM b""")
def miss_distribution(spark, sf):
    s, _, _ = cohort(spark, sf)
    return A.miss_distribution(s, {"cluster": F.col("model"), "task": F.col("benchmark")})


@query("e11_fixed_holdout", f"""WITH {OBS_SQL}, tr AS (SELECT 1 AS one, * FROM obs WHERE family IN ('AFRICA', 'AMERICA', 'ASIA')), ca AS (SELECT 1 AS one, * FROM obs WHERE family = 'MIDDLE EAST'),
te AS (SELECT 1 AS one, * FROM obs WHERE family = 'EUROPE'), {S.mondrian('w', 'tr', 'ca', 'te', 'one')}
SELECT scheme, count(*) AS n, {R('avg(covered::int)')} AS coverage, {R('avg(half_width)')} AS half_width, 0::bigint AS leaked FROM w_pred GROUP BY scheme""")
def holdout(spark, sf):
    d = obs(spark, sf)
    train, cal = d.where("family in ('AFRICA', 'AMERICA', 'ASIA')"), d.where("family = 'MIDDLE EAST'")
    test = d.where("family = 'EUROPE'")
    model = stage(C.mondrian(train, cal))
    leaked = J.leak_count(test, train, cal)
    s = test.join(model, "scheme", "left")
    ok = exprs.inside("delta", F.col("mean") - F.col("q"), F.col("mean") + F.col("q")).cast("int")
    return s.groupBy("scheme").agg(F.count("*").alias("n"), r6(F.avg(ok)).alias("coverage"),
                                   r6(F.avg(finite_or_null("q"))).alias("half_width")).withColumn("leaked", leaked)


@query("c16_band_summary", f"""{COHORT_SQL}, rg AS (SELECT scheme, max(delta) - min(delta) AS observed_range FROM obs GROUP BY scheme)
SELECT scheme, count(*) AS n, count(DISTINCT base_model) AS clusters, {R('100 * avg(ok::int)')} AS coverage_pct, {R('avg(half_width)')} AS mean_half_width, {R('any_value(observed_range)')} AS observed_range,
  avg(half_width) > any_value(observed_range) AS vacuous, string_agg(DISTINCT level, ',' ORDER BY level) AS levels FROM y_pred JOIN rg USING (scheme) GROUP BY scheme""")
def band_summary(spark, sf):
    s, d, _ = cohort(spark, sf)
    return A.band_summary(s, d).select("scheme", "n", "clusters", r6("coverage_pct").alias("coverage_pct"), r6("mean_half_width").alias("mean_half_width"),
                                       r6("observed_range").alias("observed_range"), "vacuous", F.array_join("levels", ",").alias("levels"))


# ------------------------------------------------------------------ order statistics and sets


@query("w3_kth_order_statistic", f"""WITH {OBS_SQL}, r AS (SELECT scheme, delta, row_number() OVER (PARTITION BY scheme ORDER BY delta) AS rn FROM obs)
SELECT scheme, {R('min(delta) FILTER (WHERE rn >= 25)')} AS k25, max(rn) AS n FROM r GROUP BY scheme""")
def kth(spark, sf):
    t = kth_smallest(histogram(obs(spark, sf), "scheme"), ["scheme"], "delta", lambda tot: F.lit(25))
    return t.select("scheme", r6("q").alias("k25"), "n")


@query("w4_worst_groups", f"""WITH {OBS_SQL} SELECT model, count(*) AS n, {R('avg(delta)')} AS mean FROM obs GROUP BY model HAVING count(*) >= 5 ORDER BY round(avg(delta), 9), model LIMIT 10""")
def worst_groups(spark, sf):
    t = obs(spark, sf).groupBy("model").agg(F.count("*").alias("n"), F.avg("delta").alias("m")).where("n >= 5")
    return t.orderBy(F.round("m", 9), "model").limit(10).select("model", "n", r6("m").alias("mean"))


@query("w5_hash_sampled_rows", f"""WITH {OBS_SQL} SELECT obs_id, scheme, acc_before, acc_after FROM obs
  ORDER BY ('0x' || substr(md5('0:' || obs_id), 1, 15))::BIGINT, obs_id LIMIT 60""")
def hash_sampled(spark, sf):
    return J.hash_sample(obs(spark, sf), "obs_id", 60).select("obs_id", "scheme", "acc_before", "acc_after")


@query("se1_gained_lost", f"""WITH {OBS_SQL}, a AS (SELECT obs_id FROM obs WHERE delta >= -2), b AS (SELECT obs_id FROM obs WHERE delta >= -3 AND delta <= 3)
SELECT (SELECT count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a)) AS gained, (SELECT count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)) AS lost,
  (SELECT count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)) = 0 AS is_superset""")
def gained_lost(spark, sf):
    d = obs(spark, sf)
    return J.gained_lost(d.where("delta >= -2").select("obs_id"), d.where("delta >= -3 and delta <= 3").select("obs_id"))


@query("se2_intersect_keys", f"""WITH {OBS_SQL} SELECT model, benchmark FROM obs WHERE delta < -5 INTERSECT SELECT model, benchmark FROM obs WHERE delta > 2""")
def intersect_keys(spark, sf):
    d = obs(spark, sf)
    return d.where("delta < -5").select("model", "benchmark").intersect(d.where("delta > 2").select("model", "benchmark"))


@query("se3_union_of_cohorts", f"""WITH {OBS_SQL} SELECT src, scheme, count(*) AS n FROM (SELECT 'corpus' AS src, scheme FROM obs WHERE family <> 'EUROPE' UNION ALL SELECT 'prospective', scheme FROM obs WHERE family = 'EUROPE') GROUP BY ALL""")
def union_cohorts(spark, sf):
    d = obs(spark, sf)
    return J.union_tagged({"corpus": d.where("family <> 'EUROPE'").drop("params_b"), "prospective": d.where("family = 'EUROPE'")}) \
        .groupBy("src", "scheme").agg(F.count("*").alias("n"))


@query("se4_vocabulary_difference", f"""WITH {OBS_SQL}, v AS (SELECT 'scheme' AS kind, scheme AS value, 'warn' AS severity FROM obs WHERE scheme NOT IN ('af', 'ao', 'nf') UNION SELECT 'task', benchmark, 'fail' FROM obs WHERE benchmark NOT IN ('task1', 'task2', 'task3'))
SELECT DISTINCT * FROM v""")
def vocabulary(spark, sf):
    return J.vocabulary_difference(obs(spark, sf), ["af", "ao", "nf"], ["task1", "task2", "task3"])
