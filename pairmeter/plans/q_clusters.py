"""Queries: protocols that leave out one cluster at a time."""

from pyspark.sql import functions as F

from pairmeter.functions.exprs import inside, r6
from pairmeter.operators import folds as E, leave_out as L
from pairmeter.operators.order_stats import finite, finite_or_null
from pairmeter.plans import sql as S
from pairmeter.plans.q_folds import EVAL
from pairmeter.plans.registry import query
from pairmeter.plans.staging import stage
from pairmeter.plans.views import OBS_SQL, is_calibration, obs

R = S.r6
_K = "CAST(substr(base_model, 2) AS INT)"
SEEDS = 20


def number():
    return F.substring("base_model", 2, 12).cast("int")


def clusters(d):
    return stage(d.select("base_model").distinct())


_C14 = f"""WITH {OBS_SQL}, fo AS (SELECT DISTINCT base_model AS f FROM obs),
tr AS (SELECT f, obs.* FROM fo JOIN obs ON base_model <> f WHERE {_K} % 3 <> 0), ca AS (SELECT f, obs.* FROM fo JOIN obs ON base_model <> f WHERE {_K} % 3 = 0),
te AS (SELECT f, obs.* FROM fo JOIN obs ON base_model = f), {S.fit_split('x', 'tr', 'ca', 'widen', keys='f')}, {S.predict('y', 'x_model', 'te', 'widen', keys='f')}"""


@query("c14_cluster_out_split_conformal", f"""{_C14} SELECT scheme, count(*) AS n, {R('avg(ok::int)')} AS coverage, {R('avg(half_width)')} AS mean_half_width,
  {R("avg((level = 'stratum-widened')::int)")} AS share_widened FROM y_pred GROUP BY scheme""")
def cluster_out(spark, sf):
    d = obs(spark, sf)
    bands = L.LeaveOut(d, L.partitions(clusters(d), [is_calibration()])).split_bands()
    s = d.join(bands.drop("part"), ["base_model", "scheme", "band"]).withColumn("ok", inside("delta", "lo", "hi"))
    return s.groupBy("scheme").agg(F.count("*").alias("n"), r6(F.avg(F.col("ok").cast("int"))).alias("coverage"),
                                   r6(F.avg(finite_or_null("half_width"))).alias("mean_half_width"), r6(F.avg(F.col("widened").cast("int"))).alias("share_widened"))


_RANK = "ceil((count(*) + 1) * 0.9::DOUBLE)"
_TH = "CASE WHEN count(*) >= 9 AND {rank} <= count(*) THEN list_sort(list(r))[{rank}::BIGINT] END".replace("{rank}", _RANK)


@query("c17_partition_sensitivity", f"""WITH {OBS_SQL}, o AS (SELECT obs_id, base_model AS c, scheme, band, delta, {_K} AS k FROM obs),
sd AS (SELECT c, seed, (any_value(k) + 5 * seed) % (3 + seed % 2) = 0 AS is_cal FROM o, range({SEEDS}) r(seed) GROUP BY c, seed),
cl AS (SELECT seed, o.c, scheme, band, sum(delta) AS s, count(*) AS n FROM o JOIN sd ON sd.c = o.c WHERE NOT is_cal GROUP BY ALL),
m AS (SELECT a.seed, a.c AS f, scheme, sum(s) / sum(n) AS m FROM sd a JOIN cl ON cl.seed = a.seed AND cl.c <> a.c GROUP BY ALL),
g AS (SELECT a.seed, a.c AS f, sum(s) / sum(n) AS gm FROM sd a JOIN cl ON cl.seed = a.seed AND cl.c <> a.c GROUP BY ALL),
sup AS (SELECT a.seed, a.c AS f, scheme, band FROM sd a JOIN cl ON cl.seed = a.seed AND cl.c <> a.c GROUP BY ALL HAVING sum(n) >= 20 AND count(DISTINCT cl.c) >= 3),
te AS (SELECT a.seed, a.c AS f, o.scheme, o.band, o.delta, m.m FROM sd a JOIN o ON o.c = a.c LEFT JOIN m ON m.seed = a.seed AND m.f = a.c AND m.scheme = o.scheme),
need AS (SELECT DISTINCT seed, f, scheme, m FROM te WHERE m IS NOT NULL),
ca AS (SELECT need.seed, need.f, need.scheme, band, abs(delta - m) AS r FROM need JOIN o ON o.scheme = need.scheme AND o.c <> need.f JOIN sd ON sd.c = o.c AND sd.seed = need.seed AND sd.is_cal),
qs AS (SELECT seed, f, scheme, count(*) AS n, {_TH} AS q FROM ca GROUP BY ALL),
qt AS (SELECT seed, f, scheme, band, {_TH} AS q FROM ca SEMI JOIN sup USING (seed, f, scheme, band) GROUP BY ALL),
sh AS (SELECT need.* FROM need LEFT JOIN qs USING (seed, f, scheme) WHERE coalesce(n, 0) < 9),
qf AS (SELECT seed, f, scheme, CASE WHEN {_RANK} <= count(*) THEN list_sort(list(r))[{_RANK}::BIGINT] END AS q FROM
  (SELECT sh.seed, sh.f, sh.scheme, abs(delta - m) AS r FROM sh JOIN o ON o.scheme = sh.scheme AND o.c <> sh.f JOIN sd ON sd.c = o.c AND sd.seed = sh.seed AND NOT sd.is_cal) GROUP BY ALL),
qg AS (SELECT seed, f, CASE WHEN {_RANK} <= count(*) THEN list_sort(list(r))[{_RANK}::BIGINT] END AS q FROM
  (SELECT u.seed, u.f, abs(delta - coalesce(m.m, gm)) AS r FROM (SELECT DISTINCT seed, f FROM te WHERE m IS NULL) u JOIN g ON g.seed = u.seed AND g.f = u.f JOIN o ON o.c <> u.f
   JOIN sd ON sd.c = o.c AND sd.seed = u.seed AND sd.is_cal LEFT JOIN m ON m.seed = u.seed AND m.f = u.f AND m.scheme = o.scheme) GROUP BY ALL),
b AS (SELECT te.*, coalesce(te.m, gm) AS y, CASE WHEN te.m IS NULL THEN coalesce(qg.q, 'inf') WHEN coalesce(qs.n, 0) < 9 THEN coalesce(qf.q, 'inf') ELSE coalesce(qs.q, 'inf') END AS base, qt.q AS wide
  FROM te JOIN g USING (seed, f) LEFT JOIN qs USING (seed, f, scheme) LEFT JOIN qf USING (seed, f, scheme) LEFT JOIN qt USING (seed, f, scheme, band) LEFT JOIN qg USING (seed, f)),
h AS (SELECT seed, delta, y, greatest(base, coalesce(wide, base)) AS hw FROM b)
SELECT seed, count(*) AS n, {R('100 * avg((delta >= y - hw - 1e-9 AND delta <= y + hw + 1e-9)::int)')} AS coverage_pct, {R('avg(hw) FILTER (WHERE isfinite(hw))')} AS mean_half_width FROM h GROUP BY seed""")
def sensitivity(spark, sf):
    """Twenty calibration partitions in one job; a row is scored under all of them where it lies."""
    d = obs(spark, sf)
    sides = [(number() + 5 * s) % (3 + s % 2) == 0 for s in range(SEEDS)]
    bands = stage(L.packed_bands(L.LeaveOut(d, L.partitions(clusters(d), sides)).split_bands()))
    rows = d.join(bands, ["base_model", "scheme", "band"])
    at = lambda i: F.element_at("bands", i)
    one = lambda i: F.struct(F.lit(i).cast("long").alias("seed"), F.count(at(i)).alias("n"), F.sum(inside("delta", at(i)["lo"], at(i)["hi"]).cast("long")).alias("ok"),
                             F.sum(F.when(finite(at(i)["half_width"]), at(i)["half_width"])).alias("hw"), F.count(F.when(finite(at(i)["half_width"]), 1)).alias("hn"))
    s = rows.agg(F.array(*[one(i) for i in range(SEEDS)]).alias("s")).select(F.explode("s").alias("s")).select("s.*").where("n > 0")
    return s.select("seed", "n", r6(100 * F.col("ok") / F.col("n")).alias("coverage_pct"), r6(F.try_divide("hw", "hn")).alias("mean_half_width"))


_E3 = f"""h AS (SELECT *, {S._md5("seed || ':' || base_model")} AS h FROM (SELECT DISTINCT base_model FROM obs), range(5) r(seed)),
rk AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY h, base_model) AS rk, greatest(1, round_even((count(*) OVER (PARTITION BY seed) - 1) * 0.3::DOUBLE, 0)) AS m FROM h),
side AS (SELECT a.seed, a.base_model AS f, b.base_model AS c, b.rk - (b.rk > a.rk)::INT <= a.m AS is_cal FROM rk a JOIN rk b ON a.seed = b.seed AND a.base_model <> b.base_model),
cn AS (SELECT base_model AS c, count(*) AS n FROM obs GROUP BY ALL),
ok AS (SELECT seed, f FROM side JOIN cn USING (c) GROUP BY ALL HAVING sum(n) FILTER (WHERE is_cal) >= 19 AND sum(n) FILTER (WHERE NOT is_cal) >= 30),
tr AS (SELECT seed, f, obs.* FROM side JOIN obs ON base_model = c SEMI JOIN ok USING (seed, f) WHERE NOT is_cal), ca AS (SELECT seed, f, obs.* FROM side JOIN obs ON base_model = c SEMI JOIN ok USING (seed, f) WHERE is_cal),
te AS (SELECT seed, f, obs.* FROM ok JOIN obs ON base_model = f)"""


@query("e3_regime_cluster_out", f"""WITH {OBS_SQL}, {_E3}, {S.mondrian('w', 'tr', 'ca', 'te', 'seed, f', eps='0')}, v AS (SELECT *, 'cluster_out' AS config FROM w_pred)
{S.evaluate('v', 'config', "f || '|s' || seed")}""")
def regime_b(spark, sf):
    """Every cluster left out under five seeds, calibrated on 30 % of the others."""
    d = obs(spark, sf)
    left = L.LeaveOut(d, L.sampled_partitions(clusters(d), 5, 0.3), E.MIN_FOLD_CAL, 30)
    fold = F.concat("base_model", F.lit("|s"), F.floor(F.col("part") / 2))
    hist = left.rows.groupBy("base_model", "scheme", "delta").agg(F.sum("n").alias("n"))
    s = E.score_histogram(hist, left.mondrian_bands(), ("base_model", "scheme"), eps=0.0).withColumns({"fold": fold, "config": F.lit("cluster_out")})
    t = E.evaluate(stage(s.select("config", "fold", "delta", "n", "yhat", "half_width", "lo", "hi", "covered", "backed_off")), "config")
    return t.select("config", "n_rows", "n_folds", "worst_fold", *[r6(c).alias(c) for c in EVAL])


@query("c15_jackknife_plus", f"""WITH {OBS_SQL}, d AS (SELECT *, base_model AS g FROM obs), gr AS (SELECT DISTINCT g AS f FROM d),
a AS (SELECT g AS i, scheme, sum(delta) AS s, count(*) AS n FROM d GROUP BY ALL), pr AS (SELECT x.f, y.f AS i FROM gr x JOIN gr y ON x.f <> y.f),
cs AS (SELECT p.f, p.i, a.scheme, sum(s) / sum(n) AS c FROM pr p JOIN a ON a.i <> p.f AND a.i <> p.i GROUP BY ALL), cg AS (SELECT p.f, p.i, sum(s) / sum(n) AS c FROM pr p JOIN a ON a.i <> p.f AND a.i <> p.i GROUP BY ALL),
k AS (SELECT f, scheme, count(DISTINCT g) AS k FROM gr JOIN d ON g <> f GROUP BY ALL),
n AS (SELECT DISTINCT d.g AS f, d.scheme, CASE WHEN coalesce(k.k, 0) >= 9 THEN 'scheme' ELSE 'pooled' END AS unit FROM d LEFT JOIN k ON k.f = d.g AND k.scheme = d.scheme),
t AS (SELECT pr.f, d.scheme, d.base_model, coalesce(cs.c, cg.c) AS c, abs(d.delta - coalesce(cs.c, cg.c)) AS r FROM pr JOIN d ON d.g = pr.i JOIN cg ON cg.f = pr.f AND cg.i = pr.i LEFT JOIN cs ON cs.f = pr.f AND cs.i = pr.i AND cs.scheme = d.scheme),
u AS (SELECT f, scheme AS unit, c - r AS lo, c + r AS hi FROM t SEMI JOIN (SELECT f, scheme FROM n WHERE unit = 'scheme') USING (f, scheme) UNION ALL
  SELECT f, '*', c - r, c + r FROM t SEMI JOIN (SELECT f FROM n WHERE unit = 'pooled') USING (f)),
q AS (SELECT f, unit, list_sort(list(lo))[greatest(floor(0.1::DOUBLE * (count(*) + 1)), 1)::BIGINT] AS lo, list_sort(list(hi))[least(ceil(0.9::DOUBLE * (count(*) + 1)), count(*))::BIGINT] AS hi FROM u GROUP BY ALL),
b AS (SELECT d.*, n.unit, q.lo, q.hi FROM d JOIN n ON n.f = d.g AND n.scheme = d.scheme JOIN q ON q.f = d.g AND q.unit = CASE n.unit WHEN 'scheme' THEN d.scheme ELSE '*' END)
SELECT scheme, unit, count(*) AS n, {R('avg((delta >= lo - 1e-9 AND delta <= hi + 1e-9)::int)')} AS coverage, {R('avg((hi - lo) / 2)')} AS mean_half_width FROM b GROUP BY ALL""")
def jackknife(spark, sf):
    d = obs(spark, sf)
    s = d.join(L.jackknife_plus(d), ["base_model", "scheme"])
    return s.groupBy("scheme", "unit").agg(F.count("*").alias("n"), r6(F.avg(inside("delta", "lo", "hi").cast("int"))).alias("coverage"),
                                           r6(F.avg((F.col("hi") - F.col("lo")) / 2)).alias("mean_half_width"))
