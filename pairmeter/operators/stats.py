"""Grouped effect statistics, baselines and noise diagnostics."""

from pyspark.sql import Column, DataFrame, functions as F

from pairmeter.functions.exprs import noise_scale
from pairmeter.operators.order_stats import percentile_refined

NEAR_LOSSLESS = ("w8a16", "fp8_dynamic")
FOUR_BIT = ("w4a16", "nvfp4")


def lofo_means(df: DataFrame):
    """Leave-one-family-out means by subtraction: (global, scheme, task, scheme x task) tables
    keyed by the held-out family."""
    cells = df.groupBy("family", "scheme", "benchmark").agg(F.sum("delta").alias("s"), F.count("*").alias("n"))

    def without(keys):
        per = cells.groupBy("family", *keys).agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
        if keys:
            total = per.groupBy(*keys).agg(F.sum("s").alias("ts"), F.sum("n").alias("tn"))
            t = per.join(total, list(keys))
        else:
            total = per.agg(F.sum("s").alias("ts"), F.sum("n").alias("tn"))
            t = per.withColumns({"ts": total.select("ts").scalar(), "tn": total.select("tn").scalar()})
        n = F.col("tn") - F.col("n")
        return t.select("family", *keys, F.when(n > 0, (F.col("ts") - F.col("s")) / n).alias("m"))

    named = lambda keys, name: without(keys).withColumnRenamed("m", name)
    return (named((), "g"), named(("scheme",), "s_m"), named(("benchmark",), "b_m"),
            named(("scheme", "benchmark"), "sb_m"))


def lofo_errors(df: DataFrame) -> DataFrame:
    """Absolute error sums per (family, cluster) of the four mean predictors, each fitted without
    the row's family, with back-off scheme x task -> scheme -> global."""
    g, s, b, sb = lofo_means(df)
    hist = df.groupBy("family", "base_model", "scheme", "benchmark", "delta").agg(F.count("*").alias("n"))
    t = (hist.join(g, "family").join(s, ["family", "scheme"]).join(b, ["family", "benchmark"])
         .join(sb, ["family", "scheme", "benchmark"]))
    err = lambda p: F.abs(F.col("delta") - p) * F.col("n")
    e = {"err_global": err(F.col("g")), "err_scheme": err(F.coalesce("s_m", "g")),
         "err_task": err(F.coalesce("b_m", "g")), "err_scheme_task": err(F.coalesce("sb_m", "s_m", "g"))}
    out = t.groupBy("family", "base_model").agg(F.sum("n").alias("n"), *[F.sum(c).alias(k) for k, c in e.items()])
    return out.withColumn("gain", F.col("err_global") - F.col("err_scheme"))


def mean_baselines(df: DataFrame) -> DataFrame:
    """Means at every level of the back-off: (level, scheme, benchmark, mean, n)."""
    cells = df.groupBy("scheme", "benchmark").agg(F.sum("delta").alias("s"), F.count("*").alias("n"))
    star = F.lit("*")
    sets = F.array(*[F.struct(F.lit(name).alias("level"), s.alias("scheme"), b.alias("benchmark")) for name, s, b in (
        ("global", star, star), ("scheme", F.col("scheme"), star), ("task", star, F.col("benchmark")),
        ("scheme_task", F.col("scheme"), F.col("benchmark")))])
    return (cells.select(F.explode(sets).alias("k"), "s", "n").groupBy("k.level", "k.scheme", "k.benchmark")
            .agg((F.sum("s") / F.sum("n")).alias("mean"), F.sum("n").alias("n")))


def contingency(df: DataFrame, schemes) -> DataFrame:
    """family x scheme counts; the treatments are named, so the pivot needs no extra pass."""
    return df.groupBy("family").pivot("scheme", list(schemes)).count().na.fill(0)


def noise_by_task(df: DataFrame, lossless=NEAR_LOSSLESS) -> DataFrame:
    """Spread among near-lossless treatments against all rows, per task."""
    quiet = F.col("scheme").isin(*lossless)
    q = lambda c: F.when(quiet, c)
    return df.groupBy("benchmark").agg(
        F.count("*").alias("n_all"), F.stddev_samp("delta").alias("sd_all"), F.var_samp("delta").alias("var_all"),
        F.count(q(F.col("delta"))).alias("n_lossless"), F.stddev_samp(q(F.col("delta"))).alias("sd_lossless"),
        F.var_samp(q(F.col("delta"))).alias("var_lossless"), F.avg(noise_scale()).alias("analytic_se"))


def noise_overall(df: DataFrame, lossless=NEAR_LOSSLESS) -> DataFrame:
    quiet = F.when(F.col("scheme").isin(*lossless), F.col("delta"))
    t = df.agg(F.count(quiet).alias("n_lossless"), F.avg(quiet).alias("mean_lossless"),
               F.stddev_samp(quiet).alias("sd_lossless"), F.stddev_samp("delta").alias("sd_all"),
               F.var_samp(quiet).alias("_vq"), F.var_samp("delta").alias("_va"), F.avg(noise_scale()).alias("analytic_se"))
    return t.withColumn("variance_share", F.least(F.lit(1.0), F.col("_vq") / F.col("_va"))).drop("_vq", "_va")


def mae_floor(df: DataFrame, lossless=NEAR_LOSSLESS, min_rows=4) -> DataFrame:
    """Mean absolute deviation about the task mean among near-lossless rows, weighted by all rows.

    Two aggregates: task means first, deviations second; no window over a task's rows.
    """
    quiet = df.where(F.col("scheme").isin(*lossless)).groupBy("benchmark", "delta").agg(F.count("*").alias("n"))
    means = quiet.groupBy("benchmark").agg((F.sum(F.col("delta") * F.col("n")) / F.sum("n")).alias("m"),
                                           F.sum("n").alias("n_lossless")).where(F.col("n_lossless") >= min_rows)
    dev = quiet.join(means, "benchmark").groupBy("benchmark", "n_lossless").agg(
        (F.sum(F.abs(F.col("delta") - F.col("m")) * F.col("n")) / F.sum("n")).alias("e_abs_noise"))
    size = df.groupBy("benchmark").agg(F.count("*").alias("w"))
    return dev.join(size, "benchmark")


def composition(df: DataFrame) -> DataFrame:
    """Fold sizes and shares, distinct (cluster, scheme), most tasks in one run."""
    per = df.groupBy("family", "base_model", "scheme", "benchmark").agg(F.count("*").alias("n"))
    run = per.groupBy("family", "base_model", "scheme").agg(F.count("*").alias("tasks"), F.sum("n").alias("n"))
    t = run.groupBy("family").agg(
        F.sum("n").alias("n"), F.count("*").alias("n_cluster_scheme"), F.countDistinct("base_model").alias("n_clusters"),
        F.max("tasks").alias("max_tasks_per_run"))
    return t.withColumn("share", F.col("n") / t.agg(F.sum("n")).scalar())


def excess_summary(excess: DataFrame, recipe="scheme") -> DataFrame:
    """Count, mean, minimum and 5th percentile of excess damage per recipe and pooled."""
    x = excess.select(F.explode(F.array(F.col(recipe), F.lit("pool"))).alias("recipe"), "excess").withColumn("n", F.lit(1))
    t = x.groupBy("recipe").agg(F.count("*").alias("n"), F.avg("excess").alias("mean"), F.min("excess").alias("min"))
    return t.join(percentile_refined(x, ["recipe"], "excess", 0.05, name="p05"), "recipe")


def channel_kurtosis(vectors: DataFrame) -> DataFrame:
    """Population excess kurtosis per (unit, channel), rolled up per unit."""
    ch = vectors.select("unit", F.posexplode("embedding").alias("channel", "x"))
    k = ch.groupBy("unit", "channel").agg(F.kurtosis(F.col("x").cast("double")).alias("k")).where(F.col("k").isNotNull())
    pct = lambda t: 100 * F.avg((F.col("k") > t).cast("int"))
    return k.groupBy("unit").agg(
        F.count("*").alias("n_channels"), F.avg("k").alias("mean"), F.percentile("k", 0.5).alias("median"),
        F.percentile("k", 0.99).alias("p99"), F.max("k").alias("max"), pct(3).alias("pct_gt_3"), pct(10).alias("pct_gt_10"))


def separation(df: DataFrame, lossless=NEAR_LOSSLESS, harsh=FOUR_BIT, factor=1.3) -> DataFrame:
    sd = lambda s: F.stddev_samp(F.when(F.col("scheme").isin(*s), F.col("delta")))
    t = df.groupBy("benchmark").agg(sd(lossless).alias("sd_lossless"), sd(harsh).alias("sd_four_bit"))
    return t.withColumn("verdict", F.when(F.col("sd_four_bit") > factor * F.col("sd_lossless"), "real scheme effect")
                        .otherwise("no separation"))


def _by_kinds(df: DataFrame, kinds: dict, *cols) -> DataFrame:
    """Rows once per kind, so several groupings share one aggregate."""
    k = F.array(*[F.struct(F.lit(n).alias("kind"), c.alias("name")) for n, c in kinds.items()])
    return df.select(F.explode(k).alias("_k"), *cols).select("_k.*", *cols)


def prospective_summary(scored: DataFrame, kinds: dict) -> DataFrame:
    """Coverage, error against the baseline and tails of a scored cohort, per grouping."""
    d = _by_kinds(scored, kinds, "ok", "delta", "yhat", "base_err", "half_width")
    r = lambda c: F.round(c, 6)
    fin = F.when(F.abs("half_width") < float("inf"), F.col("half_width"))
    return d.groupBy("kind", "name").agg(
        F.count("*").alias("n"), F.sum(F.col("ok").cast("int")).alias("inside"), r(F.avg(F.col("ok").cast("int"))).alias("coverage"),
        r(F.avg(F.abs(F.col("delta") - F.col("yhat")))).alias("mae"), r(F.avg("base_err")).alias("mae_baseline"),
        r(F.avg("delta")).alias("mean_delta"), r(F.min("delta")).alias("worst_delta"), r(F.avg(fin)).alias("half_width"))


def miss_distribution(scored: DataFrame, kinds: dict) -> DataFrame:
    per = _by_kinds(scored, kinds, "ok").groupBy("kind", "name").agg(F.sum((~F.col("ok")).cast("long")).alias("m"))
    n = lambda c: F.sum(c.cast("long"))
    return per.groupBy("kind").agg(
        F.sum("m").alias("misses"), n(F.col("m") > 0).alias("with_miss"), n(F.col("m") == 0).alias("clean"),
        F.max("m").alias("worst_misses"), F.max_by("name", F.struct("m", "name")).alias("worst_name"))


def band_summary(scored: DataFrame, corpus: DataFrame) -> DataFrame:
    """Coverage and width per scheme; ``vacuous`` when the band is wider than anything observed."""
    rng = corpus.groupBy("scheme").agg((F.max("delta") - F.min("delta")).alias("observed_range"))
    t = scored.groupBy("scheme").agg(
        F.count("*").alias("n"), F.countDistinct("base_model").alias("clusters"), (100 * F.avg(F.col("ok").cast("int"))).alias("coverage_pct"),
        F.avg("half_width").alias("mean_half_width"), F.sort_array(F.collect_set("level")).alias("levels"))
    return t.join(rng, "scheme").withColumn("vacuous", F.col("mean_half_width") > F.col("observed_range"))
