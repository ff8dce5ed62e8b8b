"""Queries: evidence states, flags, tiers, ranking, envelope."""

import uuid

from pyspark.sql import Window, functions as F

from pairmeter.functions import vocab
from pairmeter.functions.exprs import EPS, r6
from pairmeter.operators import conformal as C
from pairmeter.operators import folds as E
from pairmeter.operators import verdicts as V
from pairmeter.operators.order_stats import finite_or_null, histogram
from pairmeter.plans import sql as S
from pairmeter.plans.q_folds import PAIRS_SQL, scores
from pairmeter.plans.registry import query
from pairmeter.plans.staging import session_dir, stage
from pairmeter.plans.views import (
    OBS_SQL, families, is_calibration, obs, table, FOUR_BIT)
from pairmeter.plans.q_intervals import _SHIPPED
from pairmeter.sources import sinks
from pairmeter.sources.schemas import REQUEST_LOG

R = S.r6
RECORDS_SQL = f"{PAIRS_SQL}, {S.evidence()}"
ALIASES = {"a": "af", "af": "af", "mild": "af", "ao": "ao", "r_f": "rf", "rf": "rf", "nf": "nf", "four": "nf",
           "ro": "ro", "no": "no", "harsh": "no"}


def records(spark, sf):
    return V.evidence(scores(spark, sf))


@query("v1_evidence_classifier", f"""{RECORDS_SQL} SELECT scheme, band, distinct_checkpoints, distinct_rows,
  {R('coverage_one_sided')} AS coverage_one_sided, {R('boot90_lo')} AS boot90_lo, {R('boot90_hi')} AS boot90_hi, state FROM rec""")
def classifier(spark, sf):
    return records(spark, sf).select("scheme", "band", "distinct_checkpoints", "distinct_rows",
                                     *[r6(c).alias(c) for c in ("coverage_one_sided", "boot90_lo", "boot90_hi")], "state")


@query("v2_degenerate_bootstrap", f"""{RECORDS_SQL} SELECT scheme, band, coalesce(boot90_lo = boot90_hi, false) AS degenerate,
  CASE WHEN coalesce(boot90_lo = boot90_hi, false) THEN NULL ELSE {R('coverage_one_sided')} END AS shown FROM rec""")
def degenerate(spark, sf):
    return records(spark, sf).select("scheme", "band", "degenerate",
                                     F.when(~F.col("degenerate"), r6("coverage_one_sided")).alias("shown"))


@query("v5_band_verdicts", f"""{RECORDS_SQL}, g AS (SELECT r.scheme, b.band FROM (SELECT scheme FROM rec WHERE band = '*') r,
  (VALUES ('<2B'), ('2-10B'), ('>10B')) b(band))
SELECT g.scheme, g.band, coalesce(state, 'not_measured') AS state, distinct_checkpoints, distinct_rows,
  {R('coverage_one_sided')} AS coverage_one_sided FROM g LEFT JOIN rec USING (scheme, band)""")
def band_verdicts(spark, sf):
    return V.band_verdicts(stage(records(spark, sf)), vocab.BANDS).select(
        "scheme", "band", "state", "distinct_checkpoints", "distinct_rows", r6("coverage_one_sided").alias("coverage_one_sided"))


GRID = [x / 2 for x in range(2, 11)]
_SEV = " UNION ALL ".join(f"SELECT scheme, {t}::double AS threshold, {R(f'avg((delta < {-t})::int)')} AS rate, count(*) FILTER (WHERE delta < -3) AS n_severe_3pp FROM obs GROUP BY scheme" for t in GRID)


@query("a5_severe_rate_grid", f"WITH {OBS_SQL} {_SEV}")
def severe(spark, sf):
    t = V.severe_rates(histogram(obs(spark, sf), "scheme"))
    return t.select("scheme", "n_severe_3pp", F.explode("severe_rate").alias("k", "v")).select(
        "scheme", F.col("k").cast("double").alias("threshold"), r6("v").alias("rate"), "n_severe_3pp")


@query("a6_size_gradient", f"""WITH {OBS_SQL} SELECT scheme, band, count(*) AS n, {R('avg(delta)')} AS mean, {R('min(delta)')} AS worst,
  count(DISTINCT base_model) AS checkpoints FROM obs WHERE band <> 'unknown' GROUP BY ALL HAVING count(*) >= 5""")
def gradient(spark, sf):
    return V.size_gradient(*C.reduce_rows(obs(spark, sf))).select(
        "scheme", "band", "n", r6("mean").alias("mean"), r6("worst").alias("worst"), "checkpoints")


def _model_sql():
    return f"""{_SHIPPED}, gl AS (SELECT mean, half_width FROM x_model WHERE level = 'global'),
  sm AS (SELECT f.scheme, CASE WHEN m.mean IS NULL THEN gl.mean ELSE m.mean END AS mean, CASE WHEN m.mean IS NULL THEN gl.half_width ELSE m.half_width END AS half_width
    FROM (SELECT scheme FROM a_fit WHERE level = 'scheme') f CROSS JOIN gl LEFT JOIN (SELECT * FROM x_model WHERE level = 'scheme') m USING (scheme)),
  fullfit AS (SELECT * FROM a_fit WHERE level = 'scheme')"""


def entries_sql(band=None, risk=3.0, floor=True):
    """CTEs ending in ent(scheme, flags text, tier, ...)."""
    cell = f"""LEFT JOIN (SELECT scheme, state AS cell_state FROM rec WHERE band = '{band}') c USING (scheme)
   LEFT JOIN (SELECT scheme, count(DISTINCT base_model) AS ck, count(*) AS cr FROM obs WHERE band = '{band}' GROUP BY scheme) t USING (scheme)""" if band else ""
    cs = "coalesce(cell_state, 'insufficient_evidence')" if band else "NULL"
    size = f"scheme IN ('nf', 'no') AND coalesce(cr, 0) >= 5 AND {str(band == '<2B').lower()}" if band else "false"
    thin = "ck < 3" if band and floor else "false"
    flags = ", ".join(f"CASE WHEN coalesce({c}, false) THEN '{n}' END" for c, n in (
        (f"{cs} = 'insufficient_evidence' OR ws = 'insufficient_evidence'", "INSUFFICIENT_EVIDENCE"),
        (f"{cs} = 'refused'", "INSUFFICIENT_CALIBRATION"), ("rate > 0.02", "TAIL_RISK"),
        ("n < 80 OR n_families < 4", "THIN_DATA"), ("ws = 'refused'", "UNDERCOVERED"), (size, "SIZE_RISK"),
        (thin, "THIN_CELL_SUPPORT")))
    return f"""ent0 AS (SELECT f.scheme, sm.mean, sm.half_width, f.worst, f.n, f.n_families, concat_ws(',', {flags}) AS flags, rate
   FROM fullfit f JOIN sm USING (scheme)
   JOIN (SELECT scheme, avg((delta < -{risk})::int) AS rate FROM obs GROUP BY scheme) USING (scheme)
   LEFT JOIN (SELECT scheme, state AS ws FROM rec WHERE band = '*') w USING (scheme) {cell}),
ent AS (SELECT *, CASE WHEN flags LIKE '%INSUFFICIENT%' OR flags LIKE '%TAIL_RISK%' OR flags LIKE '%UNDERCOVERED%' THEN 'C'
   WHEN flags <> '' THEN 'B' ELSE 'A' END AS tier FROM ent0)"""


def _all_sql(**kw):
    body = _model_sql()
    pairs = PAIRS_SQL.split(OBS_SQL, 1)[1].lstrip(", ")
    pairs = pairs.replace("x_", "q_")
    return f"{body}, {pairs}, {S.evidence()}, {entries_sql(**kw)}"


def inputs(spark, sf):
    return V.ranking_inputs(obs(spark, sf), families(spark, sf), is_calibration())


def _entries(spark, sf, **kw):
    return V.assemble(*inputs(spark, sf), aggressive=FOUR_BIT, **kw)


@query("v3_flags", f"{_all_sql(band='<2B')} SELECT scheme, flags, {R('rate')} AS severe_rate FROM ent")
def flags(spark, sf):
    return _entries(spark, sf, band="<2B").select("scheme", F.array_join("flags", ",").alias("flags"),
                                                   r6("severe_rate_used").alias("severe_rate"))


@query("v4_tier", f"{_all_sql()} SELECT scheme, tier FROM ent")
def tiers(spark, sf):
    return _entries(spark, sf).select("scheme", "tier")


@query("w1_rank", f"""{_all_sql()} SELECT scheme, tier, {R('half_width')} AS half_width, {R('worst')} AS worst,
  row_number() OVER (ORDER BY tier, half_width, worst DESC, scheme) AS rank FROM ent""")
def rank(spark, sf):
    return V.ranked(_entries(spark, sf)).select("scheme", "tier", r6("half_width").alias("half_width"),
                                                r6("worst").alias("worst"), F.col("rank").cast("long").alias("rank"))


@query("v6_ranking_query", f"""{_all_sql(band='2-10B', risk=2.5)}, ask(requested_as, scheme) AS (VALUES ('Mild', 'af'), ('r-f', 'rf'), ('FOUR', 'nf'), ('no', 'no'))
SELECT requested_as, ent.scheme, tier, flags, row_number() OVER (ORDER BY tier, half_width, worst DESC, ent.scheme) AS rank
FROM ask JOIN ent USING (scheme)""")
def ranking_query(spark, sf):
    hit, _ = V.answer(_entries(spark, sf, band="2-10B", risk=2.5), ["Mild", "r-f", "FOUR", "no", "nonsense"], ALIASES)
    return hit.select("requested_as", "scheme", "tier", F.array_join("flags", ",").alias("flags"),
                      F.col("rank").cast("long").alias("rank"))


@query("v6_ranking_query_bootstrap", f"""{_all_sql()} SELECT scheme, tier, flags, {R('half_width')} AS half_width, {R('worst')} AS worst,
  row_number() OVER (ORDER BY tier, half_width, worst DESC, scheme) AS rank FROM ent""")
def ranking_query_bootstrap(spark, sf):
    """The question without a size band, over every scheme."""
    return V.ranked(_entries(spark, sf)).select("scheme", "tier", F.array_join("flags", ",").alias("flags"),
        r6("half_width").alias("half_width"), r6("worst").alias("worst"), F.col("rank").cast("long").alias("rank"))


@query("v6_widened_bands", f"""{_SHIPPED}, gl AS (SELECT mean, half_width FROM x_model WHERE level = 'global'),
 sc AS (SELECT f.scheme, CASE WHEN m.mean IS NULL THEN gl.half_width ELSE m.half_width END AS shown
   FROM (SELECT scheme FROM a_fit WHERE level = 'scheme') f CROSS JOIN gl LEFT JOIN (SELECT * FROM x_model WHERE level = 'scheme') m USING (scheme))
SELECT sc.scheme, coalesce(string_agg(t.band, ',' ORDER BY t.band), '') AS widened_bands
FROM sc LEFT JOIN (SELECT * FROM x_model WHERE level = 'stratum' AND kept) t ON t.scheme = sc.scheme AND t.half_width > sc.shown GROUP BY 1""")
def widened(spark, sf):
    hist, sup = C.reduce_rows(obs(spark, sf), is_cal=is_calibration())
    t = V.widened_bands(stage(C.fit_shipped(hist, sup)))
    return t.select("scheme", F.array_join("widened_bands", ",").alias("widened_bands"))


@query("v7_facts_footer", f"""{_all_sql()},
 st AS (SELECT t.scheme, t.band FROM x_model t JOIN sm USING (scheme) WHERE t.level = 'stratum' AND t.kept AND t.half_width > sm.half_width),
 big AS (SELECT obs.delta, sm.mean - sm.half_width AS lo FROM obs JOIN sm USING (scheme) WHERE delta < -3)
SELECT (SELECT count(*) FROM obs) AS n_rows, (SELECT count(DISTINCT base_model) FROM obs) AS n_checkpoints,
  (SELECT count(DISTINCT family) FROM obs) AS n_families, (SELECT count(*) FROM sm) AS n_schemes,
  (SELECT count(*) FROM sm WHERE NOT (mean - half_width <= 0 AND 0 <= mean + half_width)) AS intervals_excluding_zero,
  (SELECT count(*) FROM big) AS n_big_losses, (SELECT count(*) FROM big WHERE delta < lo - 1e-9) AS n_big_losses_below_floor,
  (SELECT count(*) FROM st) AS n_size_dependent_widths, (SELECT 2 * count(*) FROM sm) + (SELECT count(*) FROM st) AS n_numbers_in_predictor,
  (SELECT count(*) FROM rec WHERE band <> '*' AND state = 'trusted') AS cells_trusted,
  (SELECT count(*) FROM rec WHERE band <> '*' AND state = 'refused') AS cells_refused,
  (SELECT count(*) FROM rec WHERE band <> '*' AND state = 'insufficient_evidence') AS cells_insufficient""")
def facts(spark, sf):
    hist, sup, rec, model = inputs(spark, sf)
    return V.facts(hist, sup, rec, model)


@query("v8_envelope", f"""{_all_sql()}, e AS (SELECT *, row_number() OVER (PARTITION BY scheme ORDER BY delta) AS rn, count(*) OVER (PARTITION BY scheme) AS cnt FROM obs),
emp AS (SELECT scheme, min(delta) FILTER (WHERE rn >= greatest(1, floor((cnt + 1) * 0.05::double))) AS elo,
   min(delta) FILTER (WHERE rn >= least(cnt, ceil((cnt + 1) * 0.95::double))) AS ehi, quantile_cont(delta, 0.5) AS med FROM e GROUP BY scheme),
wf AS (SELECT scheme, arg_min(family, (c, family)) AS worst_family, min(c) AS worst_cov FROM
   (SELECT scheme, family, avg(ok_one::int) AS c FROM y_pred GROUP BY ALL) GROUP BY scheme)
SELECT ent.scheme, ent.n AS n_observations, ent.n_families, {R('ent.mean')} AS mean_delta, {R('med')} AS median_delta,
  {R('half_width')} AS half_width, {R('ent.mean - half_width')} AS lo, {R('ent.mean + half_width')} AS hi, {R('elo')} AS empirical_lo,
  {R('ehi')} AS empirical_hi, {R('worst')} AS worst_observed, state AS coverage_state, {R('coverage_one_sided')} AS one_sided,
  {R('coverage')} AS two_sided, worst_family, {R('worst_cov')} AS worst_family_one_sided, worst_cov < 0.85 AS warned
FROM ent JOIN emp USING (scheme) JOIN wf USING (scheme) JOIN (SELECT * FROM rec WHERE band = '*') r USING (scheme)""")
def envelope(spark, sf):
    d = obs(spark, sf)
    hist, sup = C.reduce_rows(d, is_cal=is_calibration())
    model = stage(C.fit_shipped(hist, sup))
    sc = E.pair_cluster_scores(d, families(spark, sf))
    e = V.envelope(hist, model, V.evidence(sc), E.family_spread(sc))
    flat = e.select("scheme", "n_observations", "n_families", "mean_delta", "median_delta", "half_width",
                    F.col("interval.lo").alias("lo"), F.col("interval.hi").alias("hi"),
                    F.col("empirical.lo").alias("empirical_lo"), F.col("empirical.hi").alias("empirical_hi"), "worst_observed",
                    F.col("coverage.state").alias("coverage_state"), F.col("coverage.one_sided").alias("one_sided"),
                    F.col("coverage.two_sided").alias("two_sided"), F.col("coverage.worst_family").alias("worst_family"),
                    F.col("coverage.worst_family_one_sided").alias("worst_family_one_sided"), F.col("warning").isNotNull().alias("warned"))
    num = {"mean_delta", "median_delta", "half_width", "lo", "hi", "empirical_lo", "empirical_hi", "worst_observed",
           "one_sided", "two_sided", "worst_family_one_sided"}
    return flat.select(*[r6(finite_or_null(c)).alias(c) if c in num else c for c in flat.columns])


def _ablation_sql():
    a = _all_sql(band="<2B")
    b = entries_sql(band="<2B", floor=False).replace("ent0", "nf0").replace("ent AS", "nofloor AS")
    return f"""{a}, {b} SELECT scheme, ent.tier AS tier_with_floor, nofloor.tier AS tier_without_floor, ent.tier <> nofloor.tier AS changed
FROM ent JOIN nofloor USING (scheme)"""


@query("v9_support_floor_ablation", _ablation_sql())
def ablation(spark, sf):
    got = inputs(spark, sf)
    side = lambda floor, name: V.assemble(*got, band="<2B", aggressive=FOUR_BIT, support_floor=floor).select(
        "scheme", F.col("tier").alias(name))
    t = side(True, "tier_with_floor").join(side(False, "tier_without_floor"), "scheme")
    return t.withColumn("changed", F.col("tier_with_floor") != F.col("tier_without_floor"))


@query("b9_big_loss_floor_misses", f"""{_SHIPPED}, {S.predict('y', 'x_model', 'obs')}
SELECT scheme, count(*) FILTER (WHERE delta < -3) AS n_big, count(*) FILTER (WHERE delta < -3 AND delta < lo - 1e-9) AS n_below_floor,
  {R('count(*) FILTER (WHERE delta < -3 AND delta < lo - 1e-9) / nullif(count(*) FILTER (WHERE delta < -3), 0)')} AS share_below,
  bool_or(lo > 0 OR hi < 0) AS any_excludes_zero FROM y_pred GROUP BY scheme""")
def big_losses(spark, sf):
    d = obs(spark, sf)
    s = C.predict(d, C.fit_rows(d, is_calibration()))
    big, below = F.col("delta") < -3.0, F.col("delta") < F.col("lo") - EPS
    t = s.groupBy("scheme").agg(F.sum(big.cast("long")).alias("n_big"), F.sum((big & below).cast("long")).alias("n_below_floor"),
                                F.bool_or((F.col("lo") > 0) | (F.col("hi") < 0)).alias("any_excludes_zero"))
    return t.withColumn("share_below", r6(F.try_divide("n_below_floor", "n_big")))


@query("w2_worst_observations", f"""{_SHIPPED}, {S.predict('y', 'x_model', 'obs')}
SELECT obs_id, scheme, benchmark, {R('delta')} AS delta, {R('lo')} AS lo, {R('hi')} AS hi, NOT (lo <= 0 AND 0 <= hi) AS flagged, ok AS covered
FROM y_pred ORDER BY y_pred.delta, obs_id LIMIT 10""")
def worst(spark, sf):
    from pairmeter.functions.exprs import inside
    d = obs(spark, sf)
    s = C.predict(d, C.fit_rows(d, is_calibration()))
    return s.orderBy("delta", "obs_id").limit(10).select(
        "obs_id", "scheme", "benchmark", r6("delta").alias("delta"), r6("lo").alias("lo"), r6("hi").alias("hi"),
        (~((F.col("lo") <= 0) & (F.col("hi") >= 0))).alias("flagged"), inside("delta", "lo", "hi").alias("covered"))


@query("v10_demand_rollup", """WITH asked AS (SELECT event_type AS scheme, user_id % 3 AS g FROM events)
SELECT scheme, count(*) AS n_requests, count(*) FILTER (WHERE g = 0) AS n_refused FROM asked GROUP BY scheme""")
def demand(spark, sf):
    """Events logged as requests, a third of them with a refused cell, and the log rolled up."""
    refused = F.when(F.col("user_id") % 3 == 0, F.array(F.concat("event_type", F.lit("|<2B")))).otherwise(F.array().cast("array<string>"))
    requests = table(spark, sf, "events").select(
        F.array("event_type").alias("schemes"), F.lit("").alias("size_band"), F.lit(False).alias("moe"), refused.alias("refused_cells"))
    path = f"{session_dir(spark)}/requests-{uuid.uuid4().hex}"
    if not sinks.log_requests(requests, path):
        raise RuntimeError(f"the request log at {path} was not written")
    return V.demand(spark.read.schema(REQUEST_LOG).parquet(path))


_PR4 = ", ".join(f"('{k}', '{v}')" for k, v in ALIASES.items())


@query("pr4_alias_resolution", f"""WITH m(k, v) AS (VALUES {_PR4}),
a AS (SELECT DISTINCT ' ' || upper(l_returnflag) || '-' || l_linestatus AS name FROM lineitem UNION SELECT DISTINCT l_returnflag || l_linestatus FROM lineitem)
SELECT name, v AS scheme, v IS NULL AS unknown FROM a LEFT JOIN m ON m.k = replace(lower(trim(name)), '-', '_')""")
def aliases(spark, sf):
    from pairmeter.functions.exprs import resolve_alias
    li = table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus").distinct()
    names = li.select(F.explode(F.array(F.concat(F.lit(" "), F.upper("l_returnflag"), F.lit("-"), "l_linestatus"),
                                        F.concat("l_returnflag", "l_linestatus"))).alias("name")).distinct()
    return names.withColumn("scheme", resolve_alias("name", ALIASES)).withColumn("unknown", F.col("scheme").isNull())
