"""Queries: family-fold protocols and the coverage reports built on them."""

from pyspark.sql import functions as F

from pairmeter.functions.exprs import noise_scale, r6
from pairmeter.operators import conformal as C
from pairmeter.operators import folds as E
from pairmeter.operators.order_stats import finite_or_null, histogram
from pairmeter.plans import sql as S
from pairmeter.plans.registry import query
from pairmeter.plans.views import OBS_RAW_SQL, BAND_CASE_SQL, OBS_SQL, families, obs, obs_raw
from pairmeter.functions.exprs import size_band

R = S.r6
PAIRS_SQL = f"WITH {OBS_SQL}, {S.scored_pairs()}"


def scores(spark, sf):
    return E.pair_cluster_scores(obs(spark, sf), families(spark, sf))


@query("e1_scored_pairs", f"""{PAIRS_SQL} SELECT obs_id, cal_family, {R('lo')} AS lo, {R('hi')} AS hi,
  level = 'stratum-widened' AS widened, ok, ok_one FROM y_pred""")
def scored_pairs(spark, sf):
    d = obs(spark, sf)
    s = E.score_rows(d, E.pair_bands(d, families(spark, sf)))
    return s.select("obs_id", "cal_family", r6(finite_or_null("lo")).alias("lo"),
                    r6(finite_or_null("hi")).alias("hi"), "widened", "ok", "ok_one")


_ROWS = "count(DISTINCT obs_id)"
_COVER = f"""count(*) AS scored_pairs, {_ROWS} AS distinct_rows,
  count(DISTINCT base_model) AS distinct_checkpoints, count(DISTINCT family) AS distinct_families,
  {R('avg(ok::int)')} AS coverage, {R('avg(ok_one::int)')} AS coverage_one_sided,
  {R('avg(coalesce(delta < lo, false)::int)')} AS below_lo, {R('avg(coalesce(delta > hi, false)::int)')} AS above_hi,
  {R("avg((lv = 'stratum-widened')::int)")} AS pct_widened, {R(f'count(*) / {_ROWS}')} AS pairs_per_row"""
_A13 = " UNION ALL ".join(
    f"SELECT '{n}' AS level, {s} AS scheme, {b} AS band, {_COVER} FROM z GROUP BY 1, 2, 3"
    for n, s, b in (("pooled", "'*'", "'*'"), ("scheme", "scheme", "'*'"),
                    ("band", "'*'", "band"), ("cell", "scheme", "band")))


@query("a13_coverage_table", f"""{PAIRS_SQL}, z AS (SELECT * EXCLUDE (level), level AS lv FROM y_pred)
{_A13}""")
def coverage_table(spark, sf):
    t = E.coverage_table(scores(spark, sf))
    return t.select("level", "scheme", "band", "scored_pairs", "distinct_rows", "distinct_checkpoints",
                    "distinct_families", *[r6(c).alias(c) for c in (
                        "coverage", "coverage_one_sided", "below_lo", "above_hi", "pct_widened", "pairs_per_row")])


@query("a14_family_spread", f"""{PAIRS_SQL}, p AS (SELECT scheme, family, avg(ok_one::int) AS c FROM y_pred GROUP BY ALL)
SELECT scheme, string_agg(family || '=' || printf('%.4f', c), ',' ORDER BY family) AS by_family,
  {R('min(c)')} AS worst_family_one_sided, arg_min(family, (c, family)) AS worst_family_name,
  {R('max(c) - min(c)')} AS spread_one_sided, count(*) AS n_families_tested FROM p GROUP BY scheme""")
def family_spread(spark, sf):
    t = E.family_spread(scores(spark, sf))
    pairs = F.transform(F.map_entries("by_family_one_sided"),
                        lambda e: F.concat(e["key"], F.lit("="), F.format_string("%.4f", e["value"])))
    return t.select("scheme", F.array_join(pairs, ",").alias("by_family"),
                    r6("worst_family_one_sided").alias("worst_family_one_sided"), "worst_family_name",
                    r6("spread_one_sided").alias("spread_one_sided"), "n_families_tested")


@query("a15_training_support", f"""{PAIRS_SQL}
SELECT 'cell' AS kind, scheme, band, count(*) AS train_rows, count(DISTINCT base_model) AS train_checkpoints,
  count(DISTINCT family) AS train_families, NULL::double AS share, NULL::double AS coverage FROM obs GROUP BY scheme, band
UNION ALL SELECT 'moe', '*', '*', count(*), count(DISTINCT base_model), count(DISTINCT family), NULL, NULL
  FROM obs WHERE CAST(substr(base_model, 2) AS INT) % 7 = 0
UNION ALL SELECT 'widening', '*', '*', count(*) FILTER (WHERE level = 'stratum-widened'), NULL, NULL,
  {R("avg((level = 'stratum-widened')::int)")}, {R("avg(ok::int) FILTER (WHERE level = 'stratum-widened')")} FROM y_pred""")
def training_support(spark, sf):
    d = obs(spark, sf)
    sup = d.groupBy("scheme", "band", "family", "base_model").agg(F.count("*").alias("n"))
    moe = F.substring("base_model", 2, 12).cast("int") % 7 == 0
    agg = [F.sum("n").alias("train_rows"), F.countDistinct("base_model").alias("train_checkpoints"),
           F.countDistinct("family").alias("train_families")]
    none = F.lit(None).cast("double")
    cells = sup.groupBy("scheme", "band").agg(*agg).select(
        F.lit("cell").alias("kind"), "scheme", "band", "train_rows", "train_checkpoints", "train_families",
        none.alias("share"), none.alias("coverage"))
    m = sup.where(moe).agg(*agg).select(
        F.lit("moe").alias("kind"), F.lit("*").alias("scheme"), F.lit("*").alias("band"), "train_rows",
        "train_checkpoints", "train_families", none.alias("share"), none.alias("coverage"))
    w = scores(spark, sf).agg(F.sum("widened").alias("w"), F.sum("pairs").alias("p"), F.sum("ok_widened").alias("o"))
    w = w.select(F.lit("widening").alias("kind"), F.lit("*").alias("scheme"), F.lit("*").alias("band"),
                 F.col("w").alias("train_rows"), F.lit(None).cast("long").alias("train_checkpoints"),
                 F.lit(None).cast("long").alias("train_families"), r6(F.col("w") / F.col("p")).alias("share"),
                 r6(F.when(F.col("w") > 0, F.col("o") / F.col("w"))).alias("coverage"))
    return cells.unionByName(m).unionByName(w)


def _a16_part(base, group):
    return f"""SELECT scheme, band, {base} AS base_model, {R('100 * avg(ok::int)')} AS two_sided_pct,
    {R('100 * avg(ok_one::int)')} AS one_sided_pct,
    {R('100 * avg(coalesce(delta < lo - 1e-9, false)::int)')} AS below_lo_pct,
    {R('100 * avg(coalesce(delta > hi + 1e-9, false)::int)')} AS above_hi_pct, count(*) AS scored_pairs,
    {R('round(sum(delta) FILTER (WHERE NOT ok), 4) / count(*) FILTER (WHERE NOT ok)')} AS mean_delta_of_misses,
    count(DISTINCT model || benchmark) AS distinct_model_benchmark FROM y_pred GROUP BY {group}"""


@query("a16_one_sided_cell_audit", f"""{PAIRS_SQL} {_a16_part("'*'", '1, 2, 3')} UNION ALL
{_a16_part('y_pred.base_model', '1, 2, 3')}""")
def one_sided_audit(spark, sf):
    """One row per cell and one per (cell, cluster): the per-cluster figures stay rows, so a cell
    may hold any number of clusters."""
    d = obs(spark, sf)
    s = scores(spark, sf)
    # every row of a valid test family is scored, so distinct (unit, task) pairs come from the rows
    tasks = (d.join(s.select("family").distinct(), "family", "left_semi")
             .select("scheme", "band", "base_model", "model", "benchmark").distinct()
             .groupBy("scheme", "band", "base_model").agg(F.count("*").alias("distinct_model_benchmark")))
    per = s.join(tasks, ["scheme", "band", "base_model"])
    per = per.select(F.explode(F.array(F.lit("*"), F.col("base_model"))).alias("base_model"), "scheme", "band",
                     "distinct_model_benchmark", *E.SUMS)
    misses = F.sum("pairs") - F.sum("ok")
    pct = lambda c: r6(100 * F.sum(c) / F.sum("pairs"))
    return per.groupBy("scheme", "band", "base_model").agg(
        pct("ok").alias("two_sided_pct"), pct("ok_one").alias("one_sided_pct"),
        pct("below_eps").alias("below_lo_pct"), pct("above_eps").alias("above_hi_pct"),
        F.sum("pairs").alias("scored_pairs"),
        r6(F.when(misses > 0, F.round(F.sum("miss_delta"), 4) / misses)).alias("mean_delta_of_misses"),
        F.sum("distinct_model_benchmark").alias("distinct_model_benchmark"))


# ------------------------------------------------------------------ Mondrian protocols

_PAIR_LABEL = "'test=' || test_family || '|cal=' || cal_family"


def _mondrian_pairs(alpha=0.10, src="obs", min_train=50, **kw):
    folds = S.PAIR_FOLDS.format(min_train=min_train).replace("obs", src)
    return f"{folds}, {S.pair_rows('p', src=src)}, {S.mondrian('w', 'p_f', 'p_k', 'p_t', 'test_family, cal_family', alpha, **kw)}"


EVAL = ["coverage", "mean_half_width", "median_half_width", "mae", "rmse", "r2", "share_excluding_zero",
        "share_infinite", "share_backoff", "mean_per_fold_coverage", "worst_fold_coverage"]


def _evaluated(scored, key):
    t = E.evaluate(scored.withColumn("config", key), "config")
    return t.select("config", "n_rows", "n_folds", "worst_fold", *[r6(c).alias(c) for c in EVAL])


_NOISE = "100 * sqrt(2 * greatest(least(acc_before / 100, 1 - 1e-3), 1e-3) * (1 - greatest(least(acc_before / 100, 1 - 1e-3), 1e-3)) / n_items)"
_FOLD = "test_family || '|' || cal_family"


@query("c8_mondrian_conformal", f"""WITH {OBS_SQL}, {_mondrian_pairs()}
SELECT test_family, cal_family, scheme, count(*) AS n, {R('avg(yhat)')} AS yhat, {R('max(half_width)')} AS q,
  bool_or(backed_off) AS backed_off FROM w_pred GROUP BY ALL""")
def mondrian(spark, sf):
    hist, bands = E.family_mondrian(obs(spark, sf), families(spark, sf))
    n = hist.groupBy("family", "scheme").agg(F.sum("n").alias("n"))
    return bands.join(n, ["family", "scheme"]).select(
        F.col("family").alias("test_family"), "cal_family", "scheme", "n", r6("yhat").alias("yhat"),
        r6(finite_or_null("q")).alias("q"), "backed_off")


@query("c9_noise_normalised", f"""WITH {OBS_SQL}, {_mondrian_pairs(noise=_NOISE)}, v AS (SELECT *, 'normalized' AS config FROM w_pred)
{S.evaluate('v', 'config', _FOLD)}""")
def normalised(spark, sf):
    d = obs(spark, sf).withColumn("noise", noise_scale())
    hist, bands = E.family_mondrian(d, families(spark, sf), noise="noise")
    return _evaluated(E.score_histogram(hist, bands, noise="noise"), F.lit("normalized"))


@query("a11_interval_evaluation", f"""WITH {OBS_SQL}, {_mondrian_pairs()}, v AS (SELECT *, 'mondrian' AS config FROM w_pred)
{S.evaluate('v', 'config', _FOLD)}""")
def evaluation(spark, sf):
    hist, bands = E.family_mondrian(obs(spark, sf), families(spark, sf))
    return _evaluated(E.score_histogram(hist, bands), F.lit("mondrian"))


@query("e13_fold_collapse", f"""WITH {OBS_SQL}, {_mondrian_pairs()}, u AS (
  SELECT 'fold' AS kind, {_FOLD} AS name, count(*) AS n, avg(covered::int) AS c FROM w_pred GROUP BY ALL
  UNION ALL SELECT 'family', family, count(*), avg(covered::int) FROM w_pred GROUP BY ALL
  UNION ALL SELECT 'scheme', scheme, count(*), avg(covered::int) FROM w_pred GROUP BY ALL),
  r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY round(c, 9), name) AS place FROM u)
SELECT kind, name, n, {R('c')} AS coverage, place FROM r WHERE kind <> 'fold' OR place <= 6""")
def fold_collapse(spark, sf):
    from pyspark.sql import Window
    hist, bands = E.family_mondrian(obs(spark, sf), families(spark, sf))
    s = E.score_histogram(hist, bands)
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("name"))
                      for k, c in (("fold", "fold"), ("family", "family"), ("scheme", "scheme"))])
    u = (s.select(F.explode(kinds).alias("k"), "n", "covered").groupBy("k.kind", "k.name")
         .agg(F.sum("n").alias("n"), (F.sum(F.col("covered").cast("int") * F.col("n")) / F.sum("n")).alias("c")))
    place = F.row_number().over(Window.partitionBy("kind").orderBy(F.round("c", 9), "name"))
    return (u.withColumn("place", place.cast("long")).where("kind <> 'fold' or place <= 6")
            .select("kind", "name", "n", r6("c").alias("coverage"), "place"))


def _alpha_sql():
    parts, ctes = [], [S.PAIR_FOLDS.format(min_train=1), S.pair_rows("p")]
    for i, a in enumerate((0.20, 0.10, 0.05)):
        ctes.append(S.mondrian(f"w{i}", "p_f", "p_k", "p_t", "test_family, cal_family", a))
        parts.append(f"""SELECT {a}::double AS alpha, count(*) AS n, {R('avg(covered::int)')} AS coverage,
          {R(f'avg(covered::int) - {1 - a!r}')} AS gap, {R('avg(half_width)')} AS mean_half_width FROM w{i}_pred""")
    return f"WITH {OBS_SQL}, {', '.join(ctes)} {' UNION ALL '.join(parts)}"


@query("e7_alpha_sweep", _alpha_sql())
def alpha_sweep(spark, sf):
    hist, bands = E.family_mondrian(obs(spark, sf), families(spark, sf), alphas=(0.20, 0.10, 0.05), min_train=1)
    s, n = E.score_histogram(hist, bands), F.col("n")
    cov = F.sum(F.col("covered").cast("int") * n) / F.sum("n")
    return s.groupBy("alpha").agg(
        F.sum("n").alias("n"), r6(cov).alias("coverage"), r6(cov - (1 - F.col("alpha"))).alias("gap"),
        r6(F.sum(finite_or_null("half_width") * n)
           / F.sum(F.when(F.col("half_width") < float("inf"), n))).alias("mean_half_width"))


def _prep_sql():
    parts, ctes = [], []
    for name, src in (("as_reported", "SELECT * FROM obs_raw WHERE acc_before >= 20"),
                      ("no_baseline_filter", "SELECT * FROM obs_raw"),
                      ("verified_only", "SELECT * FROM obs_raw WHERE acc_before >= 20 AND verified = 1")):
        q = "v_" + name
        ctes += [f"{q} AS ({src})", S.PAIR_FOLDS.format(min_train=30).replace("obs", q).replace("fams", q + "f")
                 .replace("pf", q + "p").replace("fold_ok", q + "o"),
                 S.pair_rows(q + "z", q + "o", q),
                 S.mondrian(q + "w", q + "z_f", q + "z_k", q + "z_t", "test_family, cal_family")]
        parts.append(f"""SELECT '{name}' AS variant, count(*) AS n, {R('avg(covered::int)')} AS coverage,
          {R('avg(half_width)')} AS mean_half_width, {R('avg(abs(delta - yhat))')} AS mae FROM {q}w_pred""")
    return f"WITH {OBS_RAW_SQL}, {', '.join(ctes)} {' UNION ALL '.join(parts)}"


@query("e8_preprocessing_sensitivity", _prep_sql())
def preprocessing(spark, sf):
    d = obs_raw(spark, sf)
    floor = F.col("acc_before") >= 20
    variants = F.array_compact(F.array(
        F.when(floor, "as_reported"), F.lit("no_baseline_filter"),
        F.when(floor & (F.col("verified") == 1), "verified_only")))
    d = d.select(F.explode(variants).alias("variant"), "family", "scheme", "delta")
    hist, bands = E.family_mondrian(d, families(spark, sf), min_train=30, extra=("variant",))
    s, n = E.score_histogram(hist, bands, ("variant", "family", "scheme")), F.col("n")
    return s.groupBy("variant").agg(
        F.sum("n").alias("n"), r6(F.sum(F.col("covered").cast("int") * n) / F.sum("n")).alias("coverage"),
        r6(F.sum(finite_or_null("half_width") * n)
           / F.sum(F.when(F.col("half_width") < float("inf"), n))).alias("mean_half_width"),
        r6(F.sum(F.abs(F.col("delta") - F.col("yhat")) * n) / F.sum("n")).alias("mae"))


_CPAIR = f"""fams AS (SELECT DISTINCT family AS f FROM obs),
cf AS (SELECT t.f AS test_family, a.f AS c1, b.f AS c2, a.f || '+' || b.f AS cal_family FROM fams t
  JOIN fams a ON a.f <> t.f JOIN fams b ON b.f <> t.f AND a.f < b.f),
ok AS (SELECT test_family, c1, c2, cal_family FROM cf JOIN obs ON family <> test_family GROUP BY ALL
  HAVING count(*) FILTER (WHERE family IN (c1, c2)) >= 19 AND count(*) FILTER (WHERE family NOT IN (c1, c2)) >= 30),
p_f AS (SELECT test_family, cal_family, o.* FROM ok JOIN obs o ON o.family NOT IN (test_family, c1, c2)),
p_k AS (SELECT test_family, cal_family, o.* FROM ok JOIN obs o ON o.family IN (c1, c2)),
p_t AS (SELECT test_family, cal_family, o.* FROM ok JOIN obs o ON o.family = test_family)"""


@query("e4_regime_unseen_family", f"""WITH {OBS_SQL}, {_CPAIR},
{S.mondrian('w', 'p_f', 'p_k', 'p_t', 'test_family, cal_family', eps='0')},
{S.mondrian('m', 'p_f', 'p_k', 'p_t', 'test_family, cal_family', eps='0', grouped=False)},
v AS (SELECT *, 'mondrian_scheme' AS config FROM w_pred UNION ALL SELECT *, 'marginal' FROM m_pred)
{S.evaluate('v', 'config', _FOLD)}""")
def regime_c(spark, sf):
    hist, bands = E.family_mondrian(obs(spark, sf), families(spark, sf), n_cal=2, min_train=30)
    one = lambda name, q, back: F.struct(F.lit(name).alias("config"), F.col(q).alias("q"), back.alias("backed_off"))
    both = F.explode(F.array(one("mondrian_scheme", "q", F.col("backed_off")), one("marginal", "q_marginal", F.lit(False)))).alias("c")
    bands = bands.select(*[c for c in bands.columns if c not in ("q", "q_marginal", "backed_off")], both).select("*", "c.*").drop("c")
    return _evaluated(E.score_histogram(hist, bands, eps=0.0), F.col("config"))


@query("e5_regime_single_calibration_family", f"""WITH {OBS_SQL}, {_mondrian_pairs(min_train=30)},
v AS (SELECT *, 'single_family' AS config FROM w_pred) {S.evaluate('v', 'config', _FOLD)}""")
def regime_c_prime(spark, sf):
    """The single-calibration-family regime with the treatment-mean centre; the ridge centre is M1's."""
    hist, bands = E.family_mondrian(obs(spark, sf), families(spark, sf), min_train=30)
    return _evaluated(E.score_histogram(hist, bands), F.lit("single_family"))


_SUB = "CASE WHEN family = 'ASIA' THEN 'ASIA.' || (CAST(substr(base_model, 2) AS INT) % 3) ELSE family END"


def split_family(family="family", base="base_model"):
    """One family split by a token of the cluster name (here the residue of the cluster number)."""
    return F.when(F.col(family) == "ASIA", F.concat(F.lit("ASIA."), F.substring(base, 2, 12).cast("int") % 3)) \
        .otherwise(F.col(family))


@query("pr10_fold_key_redefinition", f"""WITH {OBS_SQL}
SELECT {_SUB} AS family_a, family AS family_b, count(*) AS n, count(DISTINCT base_model) AS n_checkpoints FROM obs GROUP BY ALL""")
def redefine_fold_key(spark, sf):
    d = obs(spark, sf).withColumn("family_a", split_family())
    return d.groupBy("family_a", F.col("family").alias("family_b")).agg(
        F.count("*").alias("n"), F.countDistinct("base_model").alias("n_checkpoints"))


@query("e10_subfamily_coverage", f"""WITH {OBS_SQL}, suba AS (SELECT * REPLACE ({_SUB} AS family) FROM obs),
{_mondrian_pairs(src='suba')}, c AS (SELECT test_family, cal_family, count(*) AS n, avg(covered::int) AS cov FROM w_pred GROUP BY ALL),
f AS (SELECT test_family, sum(n * cov) / sum(n) AS fc, min(cov) AS lo, max(cov) AS hi FROM c GROUP BY ALL)
SELECT test_family, cal_family, n, {R('cov')} AS coverage, {R('fc')} AS fold_coverage, {R('hi - lo')} AS fold_gap,
  {R('(SELECT avg(fc) FROM f)')} AS aggregate_coverage FROM c JOIN f USING (test_family)""")
def subfamily_coverage(spark, sf):
    d = obs(spark, sf).withColumn("family", split_family())
    hist, bands = E.family_mondrian(d, d.select("family").distinct())
    c = (E.score_histogram(hist, bands).groupBy(F.col("family").alias("test_family"), "cal_family")
         .agg(F.sum("n").alias("n"), F.sum(F.col("covered").cast("int") * F.col("n")).alias("k")))
    c = c.withColumn("cov", F.col("k") / F.col("n"))
    f = c.groupBy("test_family").agg((F.sum("k") / F.sum("n")).alias("fc"), (F.max("cov") - F.min("cov")).alias("gap"))
    return c.join(f, "test_family").select(
        "test_family", "cal_family", "n", r6("cov").alias("coverage"), r6("fc").alias("fold_coverage"),
        r6("gap").alias("fold_gap"), r6(f.agg(F.avg("fc")).scalar()).alias("aggregate_coverage"))


# ------------------------------------------------------------------ band shapes

@query("j2_fold_expansion", f"""WITH {OBS_SQL}, {S.PAIR_FOLDS.format(min_train=50)} SELECT * FROM fold_ok""")
def fold_expansion(spark, sf):
    cells = obs(spark, sf).groupBy("family").agg(F.count("*").alias("n"))
    return E.valid_folds(cells, E.held_out(spark, families(spark, sf))).select("test_family", "cal_family")


_SHAPE = f"""{S.PAIR_FOLDS.format(min_train=50)}, {S.pair_rows('p')},
tm AS (SELECT test_family, cal_family, scheme, avg(delta) AS centre FROM p_f GROUP BY ALL HAVING count(*) >= 5),
cr AS (SELECT k.test_family, k.cal_family, scheme, delta, centre,
  row_number() OVER (PARTITION BY k.test_family, k.cal_family, scheme ORDER BY abs(delta - centre)) AS ra,
  row_number() OVER (PARTITION BY k.test_family, k.cal_family, scheme ORDER BY delta) AS rd,
  count(*) OVER (PARTITION BY k.test_family, k.cal_family, scheme) AS n
  FROM p_k k JOIN tm USING (test_family, cal_family, scheme)),
b0 AS (SELECT test_family, cal_family, scheme, any_value(centre) AS centre, max(n) AS n,
  min(abs(delta - centre)) FILTER (WHERE ra >= {S.rank_of('n')}) AS q,
  min(delta) FILTER (WHERE rd >= floor((n + 1) * 0.05::double) AND floor((n + 1) * 0.05::double) >= 1) AS elo,
  min(delta) FILTER (WHERE rd >= ceil((n + 1) * 0.95::double) AND ceil((n + 1) * 0.95::double) <= n) AS ehi
  FROM cr GROUP BY ALL HAVING max(n) >= 9),
b AS (SELECT test_family, cal_family, scheme, centre - q AS clo, centre + q AS chi,
  CASE WHEN ehi IS NOT NULL THEN elo END AS elo, CASE WHEN elo IS NOT NULL THEN ehi END AS ehi FROM b0),
s AS (SELECT p_t.*, clo, chi, elo, ehi, coalesce(elo, clo) AS hlo, coalesce(ehi, chi) AS hhi
  FROM p_t JOIN b USING (test_family, cal_family, scheme))"""


def _shape_part(name, lo, hi):
    return f"""SELECT scheme, '{name}' AS shape, count(*) AS n,
  {R(f'avg(coalesce(delta >= {lo} - 1e-9 AND delta <= {hi} + 1e-9, true)::int)')} AS coverage,
  {R(f'avg({hi} - {lo})')} AS mean_width, {R(f'avg(coalesce(delta < {lo}, false)::int)')} AS lower_miss,
  {R('avg((elo IS NULL)::int)')} AS share_no_empirical FROM s GROUP BY ALL"""


SHAPE_SQL = (f"WITH {OBS_SQL}, {_SHAPE} {_shape_part('conformal', 'clo', 'chi')} UNION ALL "
             f"{_shape_part('empirical', 'elo', 'ehi')} UNION ALL {_shape_part('hybrid', 'hlo', 'hhi')}")


def shape_bands(df, fams):
    """Symmetric, empirical and hybrid bands of every (fold, scheme) with enough rows."""
    hist = E.stage(histogram(df, "family", "scheme"))
    folds = E.held_out(df.sparkSession, fams)
    cells = E.stage(E.of_families(E.family_cells(hist, "scheme"), folds))
    ok = E.valid_folds(cells, folds).select("fold")
    centre = (E.train_sums(cells, folds, ("scheme",)).where("n >= 5")
              .select("fold", "scheme", (F.col("s").cast("double") / F.col("n")).alias("centre")))
    cal = (hist.join(E._role(folds, "cal", "test_family", "cal_family"), "family").join(ok, "fold", "left_semi")
           .select("fold", "test_family", "cal_family", "scheme", "delta", "n").join(centre, ["fold", "scheme"]))
    keys = ["fold", "test_family", "cal_family", "scheme"]
    sym = C.symmetric_band(cal, keys).where("n >= 9").drop("n")
    return hist, E.stage(C.hybrid_band(sym.join(C.empirical_band(cal, keys), keys)))


@query("c10_symmetric_band", f"""WITH {OBS_SQL}, {_SHAPE}
SELECT test_family, cal_family, scheme, {R('clo')} AS lo, {R('chi')} AS hi FROM b""")
def symmetric(spark, sf):
    _, b = shape_bands(obs(spark, sf), families(spark, sf))
    return b.select("test_family", "cal_family", "scheme", r6(finite_or_null("conf_lo")).alias("lo"),
                    r6(finite_or_null("conf_hi")).alias("hi"))


@query("c11_empirical_band", f"""WITH {OBS_SQL}, {_SHAPE}
SELECT test_family, cal_family, scheme, {R('elo')} AS lo, {R('ehi')} AS hi, elo IS NULL AS is_infinite FROM b""")
def empirical(spark, sf):
    _, b = shape_bands(obs(spark, sf), families(spark, sf))
    return b.select("test_family", "cal_family", "scheme", r6(finite_or_null("emp_lo")).alias("lo"),
                    r6(finite_or_null("emp_hi")).alias("hi"), finite_or_null("emp_lo").isNull().alias("is_infinite"))


@query("c12_hybrid_band", f"""WITH {OBS_SQL}, {_SHAPE}
SELECT test_family, cal_family, scheme, {R('coalesce(elo, clo)')} AS lo, {R('coalesce(ehi, chi)')} AS hi,
  CASE WHEN elo IS NULL THEN 'conformal_fallback' ELSE 'empirical' END AS source FROM b""")
def hybrid(spark, sf):
    _, b = shape_bands(obs(spark, sf), families(spark, sf))
    return b.select("test_family", "cal_family", "scheme", r6(finite_or_null("hyb_lo")).alias("lo"),
                    r6(finite_or_null("hyb_hi")).alias("hi"), F.col("hyb_src").alias("source"))


@query("c13_band_shape_comparison", SHAPE_SQL)
def shape_comparison(spark, sf):
    hist, b = shape_bands(obs(spark, sf), families(spark, sf))
    s = hist.join(b.drop("n").withColumnRenamed("test_family", "family"), ["family", "scheme"])
    shapes = F.array(*[F.struct(F.lit(n).alias("shape"), F.col(p + "_lo").alias("lo"), F.col(p + "_hi").alias("hi"))
                       for n, p in (("conformal", "conf"), ("empirical", "emp"), ("hybrid", "hyb"))])
    s = s.select("scheme", "delta", "n", (F.col("emp_lo") == -float("inf")).cast("int").alias("noemp"),
                 F.explode(shapes).alias("b")).select("scheme", "delta", "n", "noemp", "b.*")
    w = lambda c: F.sum(c.cast("int") * F.col("n")) / F.sum("n")
    width = finite_or_null(F.col("hi") - F.col("lo"))
    return s.groupBy("scheme", "shape").agg(
        F.sum("n").alias("n"),
        r6(w((F.col("delta") >= F.col("lo") - 1e-9) & (F.col("delta") <= F.col("hi") + 1e-9))).alias("coverage"),
        r6(F.sum(width * F.col("n")) / F.sum(F.when(width.isNotNull(), F.col("n")))).alias("mean_width"),
        r6(w(F.col("delta") < F.col("lo"))).alias("lower_miss"), r6(w(F.col("noemp"))).alias("share_no_empirical"))
