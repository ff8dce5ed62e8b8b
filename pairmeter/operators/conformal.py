"""Interval construction: cluster partitions, in-sample and split-conformal fits, lookups.

A fitted model is one small table ``(level, scheme, band, mean, half_width, ...)`` with levels
``global``, ``scheme`` and ``stratum``; absent keys are ``*``. Fits read two reductions of the rows:
a delta histogram per (scheme, band, side) and a cluster support table.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from pairmeter.functions.exprs import md5_int
from pairmeter.operators.order_stats import (
    INF, conformal_quantile, conformal_rank, finite, histogram, kth_refined, weighted_mean, with_ranks)
from pairmeter.plans.staging import stage

ALPHA = 0.10
MIN_ROWS = 20
MIN_CLUSTERS = 3
MIN_CAL_ROWS = 9
CELL = ["level", "scheme", "band"]


def cluster_partition(df: DataFrame, seed=0, fraction=1.0 / 3.0, key="base_model") -> DataFrame:
    """(cluster, is_cal): the round(n * fraction) clusters with the smallest seeded hash.

    The hash threshold comes from the cluster list itself: the list is reduced to counts per
    leading hash bits first, so no task ever orders the whole list.
    """
    clusters = df.select(key).distinct().withColumn("_h", md5_int(seed, F.col(key))).withColumn("_b", F.shiftright("_h", 44))
    per = clusters.groupBy("_b").agg(F.count("*").alias("_n"))
    upto = Window.partitionBy(F.lit(0)).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    per = per.withColumns({"_end": F.sum("_n").over(upto),
                           "_take": F.bround(F.sum("_n").over(Window.partitionBy(F.lit(0))) * fraction)})
    per = per.withColumn("_left", F.col("_take") - (F.col("_end") - F.col("_n")))
    within = Window.partitionBy("_b").orderBy("_h", key)
    return (clusters.join(per.select("_b", "_left"), "_b")
            .withColumn("is_cal", F.row_number().over(within) <= F.col("_left"))
            .select(key, "is_cal"))


def stack_levels(df: DataFrame) -> DataFrame:
    """Each (scheme, band) row once per level."""
    star = F.lit("*")
    cell = lambda name, s, b: F.struct(F.lit(name).alias("level"), s.alias("scheme"), b.alias("band"))
    levels = F.array(cell("global", star, star), cell("scheme", F.col("scheme"), star),
                     cell("stratum", F.col("scheme"), F.col("band")))
    rest = [c for c in df.columns if c not in ("scheme", "band")]
    return df.select(F.explode(levels).alias("_l"), *rest).select("_l.*", *rest)


def reduce_rows(df: DataFrame, *extra, is_cal: Column | None = None):
    """(histogram, support): the two written reductions every fit reads.

    The histogram counts deltas per (scheme, band, side); the support table counts rows per
    (scheme, band, family, cluster, side), which is what distinct clusters are taken from.
    """
    d = df.withColumn("is_cal", F.lit(False) if is_cal is None else is_cal)
    keys = [*extra, "scheme", "band", "is_cal"]
    sup = d.groupBy(*dict.fromkeys([*keys, "family", "base_model"])).agg(F.count("*").alias("n"))
    return stage(histogram(d, *keys)), stage(sup)


def support_counts(sup: DataFrame, *extra) -> DataFrame:
    return (stack_levels(sup.select(*extra, "scheme", "band", "family", "base_model"))
            .groupBy(*extra, *CELL)
            .agg(F.countDistinct("base_model").alias("n_checkpoints"),
                 F.countDistinct("family").alias("n_families")))


def cell_statistics(hist: DataFrame, sup: DataFrame, *extra, alpha=ALPHA) -> DataFrame:
    """Mean, conformal half-width about it, and descriptive figures per cell at every level."""
    keys = [*extra, *CELL]
    h = (stack_levels(hist.select(*extra, "scheme", "band", "delta", "n"))
         .groupBy(*keys, "delta").agg(F.sum("n").alias("n")))
    w = Window.partitionBy(*keys)
    mean = F.sum(F.col("delta") * F.col("n")).over(w) / F.sum("n").over(w)
    ranked = with_ranks(h.withColumn("mean", mean).withColumn("resid", F.abs(F.col("delta") - F.col("mean"))),
                        keys, "resid")
    k = conformal_rank(F.col("tot"), alpha)
    stats = ranked.groupBy(*keys).agg(
        F.max("mean").alias("mean"),
        F.coalesce(F.min(F.when(F.col("cum") >= k, F.col("resid"))), F.lit(INF)).alias("half_width"),
        F.max("tot").alias("n"), F.min("delta").alias("worst"), F.max("delta").alias("best"),
        F.percentile("delta", F.array(F.lit(0.05), F.lit(0.95)), F.col("n")).alias("_p"))
    stats = stats.withColumns({"p05": F.col("_p")[0], "p95": F.col("_p")[1]}).drop("_p")
    return stats.join(support_counts(sup, *extra), keys)


def supported(n="n", k="n_checkpoints", width="half_width") -> Column:
    """Enough rows, enough distinct clusters, and a finite width."""
    return (F.col(n) >= MIN_ROWS) & (F.col(k) >= MIN_CLUSTERS) & finite(width)


def fit_in_sample(hist: DataFrame, sup: DataFrame, *extra, alpha=ALPHA) -> DataFrame:
    """Centres and widths from the same rows; ``kept`` marks strata above the support floor."""
    return cell_statistics(hist, sup, *extra, alpha=alpha).withColumn(
        "kept", F.when(F.col("level") == "stratum", supported()).otherwise(True))


def fit_split(hist: DataFrame, sup: DataFrame, variant="widen", alpha=ALPHA) -> DataFrame:
    """Split conformal: centres from fit rows, widths from calibration residuals.

    variant: ``widen`` and ``scheme`` centre every residual on the scheme mean, ``full`` on the
    stratum mean where the stratum is supported. A scheme or the global level with fewer than nine
    calibration rows keeps its fit-side width; such a stratum is dropped.
    """
    fit = fit_in_sample(hist.where("not is_cal"), sup.where("not is_cal"), alpha=alpha)
    sums = hist.where("not is_cal").groupBy("scheme", "band").agg(
        F.sum(F.col("delta") * F.col("n")).alias("_s"), F.sum("n").alias("_n"))
    g_mean = sums.agg(F.sum("_s") / F.sum("_n")).scalar()
    s = sums.groupBy("scheme").agg((F.sum("_s") / F.sum("_n")).alias("s_mean"))
    cal = hist.where("is_cal").join(s, "scheme", "left")
    centre = F.coalesce("s_mean", g_mean)
    if variant == "full":
        t = fit.where("level = 'stratum' and kept").select("scheme", "band", F.col("mean").alias("t_mean"))
        cal = cal.join(t, ["scheme", "band"], "left")
        centre = F.coalesce("t_mean", centre)
    resid = cal.withColumn("resid", F.abs(F.col("delta") - centre)).select("scheme", "band", "resid", "n")
    q = kth_refined(stack_levels(resid), CELL, "resid", lambda tot: conformal_rank(tot, alpha))
    q = q.withColumn("q", F.coalesce("q", F.lit(INF))).withColumnRenamed("n", "n_cal")
    enough = F.coalesce(F.col("n_cal") >= MIN_CAL_ROWS, F.lit(False))
    out = (fit.withColumnRenamed("half_width", "fit_half_width").join(q, CELL, "left")
           .withColumn("half_width", F.when(enough, F.col("q")).otherwise(F.col("fit_half_width"))))
    is_stratum = F.col("level") == "stratum"
    kept = F.when(is_stratum, F.col("kept") & enough & finite("half_width")).otherwise(True)
    out = out.withColumn("kept", kept).drop("q")
    if variant == "scheme":
        out = out.withColumn("kept", F.col("kept") & ~is_stratum)
    return out


DESCRIPTIVE = ["n", "n_checkpoints", "n_families", "worst", "best", "p05", "p95"]


def fit_shipped(hist: DataFrame, sup: DataFrame, variant="widen", alpha=ALPHA) -> DataFrame:
    """Split fit with the descriptive columns of the whole corpus.

    ``status``: kept, rejected (below the support floor) or uncalibratable (supported, but without
    enough held-out rows for a width of its own).
    """
    split = fit_split(hist, sup, variant, alpha).select(*CELL, "mean", "half_width", "kept", "n_cal")
    full = fit_in_sample(hist, sup, alpha=alpha).select(*CELL, *DESCRIPTIVE, F.col("kept").alias("full_kept"))
    out = full.join(split, CELL, "left")
    kept = F.coalesce("kept", F.lit(False))
    return out.withColumn(
        "status", F.when(kept, "kept").when(F.col("full_kept"), "uncalibratable").otherwise("rejected")
    ).withColumns({
        "mean": F.when(kept, F.col("mean")), "half_width": F.when(kept, F.col("half_width")),
        "n_cal": F.coalesce("n_cal", F.lit(0)),
    }).drop("kept", "full_kept")


def fit_rows(df: DataFrame, is_cal: Column, variant="widen", alpha=ALPHA) -> DataFrame:
    """The written model of ``fit_split`` for a row table."""
    return stage(fit_split(*reduce_rows(df, is_cal=is_cal), variant, alpha)
                 .select(*CELL, "mean", "half_width", "kept"))


def _levels(model: DataFrame):
    m = model.where(F.col("mean").isNotNull())
    if "kept" in m.columns:
        m = m.where("kept")
    pick = lambda level, keys, p: m.where(F.col("level") == level).select(
        *keys, F.col("mean").alias(p + "_mean"), F.col("half_width").alias(p + "_hw"))
    return pick("global", [], "g"), pick("scheme", ["scheme"], "s"), pick("stratum", ["scheme", "band"], "t")


def predict(rows: DataFrame, model: DataFrame, rule="widen") -> DataFrame:
    """Adds yhat, half_width, lo, hi, level. ``model`` should be a staged table.

    rule ``fallback``: stratum, else scheme, else global. rule ``widen``: centre of the scheme, the
    stratum width only where strictly wider.
    """
    g, s, t = _levels(model)
    joined = rows.join(s, "scheme", "left").join(t, ["scheme", "band"], "left")
    g_mean, g_hw = g.select("g_mean").scalar(), g.select("g_hw").scalar()
    base_mean, base_hw = F.coalesce("s_mean", g_mean), F.coalesce("s_hw", g_hw)
    if rule == "fallback":
        yhat = F.coalesce("t_mean", base_mean)
        width = F.coalesce("t_hw", base_hw)
        level = F.when(F.col("t_mean").isNotNull(), "stratum").when(
            F.col("s_mean").isNotNull(), "scheme").otherwise("global")
    else:
        wider = F.coalesce(F.col("t_hw") > base_hw, F.lit(False))
        yhat, width = base_mean, F.when(wider, F.col("t_hw")).otherwise(base_hw)
        level = F.when(wider, "stratum-widened").otherwise("scheme")
    return (joined.withColumns({"yhat": yhat, "half_width": width, "level": level})
            .withColumns({"lo": F.col("yhat") - F.col("half_width"),
                          "hi": F.col("yhat") + F.col("half_width")})
            .drop("s_mean", "s_hw", "t_mean", "t_hw"))


# ------------------------------------------------------------------ Mondrian conformal


def mondrian(train: DataFrame, cal: DataFrame, by="scheme", alpha=ALPHA, normalized=False,
             backoff=True, noise=None) -> DataFrame:
    """Per-group conformal model around treatment means: (scheme, mean, q, q_marginal, backed_off).

    ``noise`` is the noise-scale expression used when ``normalized``; those scores are not on the
    delta grid, so the histogram there is on the score itself.
    """
    sums = train.groupBy(by).agg(F.sum("delta").alias("_s"), F.count("*").alias("_n"))
    means = sums.select(by, (F.col("_s") / F.col("_n")).alias("mean"))
    overall = sums.agg((F.sum("_s") / F.sum("_n")).alias("g_mean"))
    g_mean = overall.scalar()
    score_rows = cal.join(means, by, "left").withColumn("mean", F.coalesce("mean", g_mean))
    score = F.abs(F.col("delta") - F.col("mean"))
    if normalized:
        score = score / noise
    h = score_rows.select(by, score.alias("score")).groupBy(by, "score").agg(F.count("*").alias("n"))
    rank = lambda tot: conformal_rank(tot, alpha)
    per = kth_refined(h, [by], "score", rank, name="q_group").withColumnRenamed("n", "n_cal")
    pooled = kth_refined(h.withColumn("_all", F.lit(1)), ["_all"], "score", rank, name="q_marginal")
    marginal = pooled.select(F.coalesce("q_marginal", F.lit(INF)).alias("q_marginal"))
    keys = means.join(per, by, "full_outer").withColumn("mean", F.coalesce("mean", g_mean))
    q_group = F.coalesce("q_group", F.lit(INF))
    out = keys.withColumn("q_marginal", marginal.scalar())
    back = ~finite(q_group) & F.lit(backoff)
    return out.withColumns({
        "q": F.when(back, F.col("q_marginal")).otherwise(q_group), "backed_off": back,
        "n_cal": F.coalesce("n_cal", F.lit(0))}).drop("q_group")


def empirical_ranks(alpha=ALPHA):
    """Rank functions of the asymmetric band: floor((n+1)a/2) and ceil((n+1)(1-a/2))."""
    lo = lambda n: F.floor((n + 1) * F.lit(alpha / 2))
    hi = lambda n: F.ceil((n + 1) * F.lit(1 - alpha / 2))
    return lo, hi


def empirical_band(hist: DataFrame, keys, value="delta", alpha=ALPHA, clamp=False) -> DataFrame:
    """Asymmetric order-statistic band; -inf/+inf where the ranks do not exist, or clamped to the
    extremes."""
    lo_k, hi_k = empirical_ranks(alpha)
    r = with_ranks(hist, keys, value)
    tot = F.col("tot")
    lo, hi = lo_k(tot), hi_k(tot)
    if clamp:
        lo, hi = F.greatest(lo, F.lit(1)), F.least(hi, tot)
    out = r.groupBy(*keys).agg(
        F.max("tot").alias("n"),
        F.min(F.when((F.col("cum") >= lo) & (lo >= 1), F.col(value))).alias("emp_lo"),
        F.min(F.when((F.col("cum") >= hi) & (hi <= tot), F.col(value))).alias("emp_hi"))
    undefined = F.col("emp_lo").isNull() | F.col("emp_hi").isNull()
    return out.withColumns({"emp_lo": F.when(undefined, F.lit(-INF)).otherwise(F.col("emp_lo")),
                            "emp_hi": F.when(undefined, F.lit(INF)).otherwise(F.col("emp_hi"))})


def symmetric_band(hist: DataFrame, keys, centre="centre", value="delta", alpha=ALPHA) -> DataFrame:
    """centre -/+ the conformal quantile of |value - centre|; ``centre`` is constant per key."""
    resid = hist.withColumn("resid", F.abs(F.col(value) - F.col(centre)))
    q = conformal_quantile(resid.select(*keys, centre, "resid", "n"), [*keys, centre], "resid", alpha)
    return q.withColumns({"conf_lo": F.col(centre) - F.col("q"), "conf_hi": F.col(centre) + F.col("q")})


def hybrid_band(bands: DataFrame) -> DataFrame:
    """The empirical band where it is finite, else the symmetric one, with its source."""
    ok = finite("emp_lo") & finite("emp_hi")
    return bands.withColumns({
        "hyb_lo": F.when(ok, F.col("emp_lo")).otherwise(F.col("conf_lo")),
        "hyb_hi": F.when(ok, F.col("emp_hi")).otherwise(F.col("conf_hi")),
        "hyb_src": F.when(ok, "empirical").otherwise("conformal_fallback")})
