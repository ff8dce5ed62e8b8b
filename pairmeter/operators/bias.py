"""Selection bias in the left tail: what unpublished bad outcomes do to a lower bound."""

from pyspark.sql import Column, DataFrame, functions as F

from pairmeter.functions.exprs import md5_int
from pairmeter.operators.resample import dense_index

ALPHA = 0.10
TAIL_SHARE = 0.25
MIN_EXCEED = 8
PIS = (0.0, 0.05, 0.10, 0.15, 0.20, 0.30)


def tail_fit(hist: DataFrame, keys=("scheme",), share=TAIL_SHARE) -> DataFrame:
    """Generalised-Pareto fit by moments to the exceedances below the ``share`` quantile, per key.

    u, xi, sigma are null where fewer than eight rows exceed or the moments do not exist.
    """
    k, n = list(keys), F.col("n")
    head = hist.groupBy(*k).agg(F.percentile("delta", F.lit(share), n).alias("u"), F.sum("n").alias("n_total"),
                                F.min("delta").alias("x_min"))
    y = F.col("u") - F.col("delta")
    ex = (hist.join(head.select(*k, "u"), k).where(F.col("delta") < F.col("u")).groupBy(*k)
          .agg(F.sum("n").alias("n_exceed"), F.sum(y * n).alias("_s"), F.sum(y * y * n).alias("_ss")))
    m = F.col("_s") / F.col("n_exceed")
    v = (F.col("_ss") - F.col("_s") * m) / F.nullif(F.col("n_exceed") - 1, F.lit(0))
    t = head.join(ex, k, "left").withColumns({"_m": m, "_v": v})
    ok = (F.col("n_exceed") >= MIN_EXCEED) & (F.col("_v") > 0) & (F.col("_m") > 0)
    ratio = F.col("_m") * F.col("_m") / F.col("_v")
    return t.withColumns({
        "xi": F.when(ok, F.least(F.greatest(0.5 * (1 - ratio), F.lit(-0.5)), F.lit(0.45))),
        "sigma": F.when(ok, F.greatest(0.5 * F.col("_m") * (ratio + 1), F.lit(1e-6))),
        "n_exceed": F.coalesce("n_exceed", F.lit(0))}).drop("_s", "_ss", "_m", "_v")


def tail_quantile(p_tail: Column, mass_below_u: Column) -> Column:
    """x with F(x) = p_tail below the fitted threshold; null outside the tail."""
    r, xi, sigma = p_tail / mass_below_u, F.col("xi"), F.col("sigma")
    y = F.when(F.abs(xi) < 1e-8, -sigma * F.log(r)).otherwise(sigma / xi * (F.pow(r, -xi) - 1.0))
    return F.when(xi.isNotNull() & (p_tail > 0) & (mass_below_u > 0) & (p_tail < mass_below_u), F.col("u") - y)


def corrected_bounds(hist: DataFrame, keys=("scheme",), pis=PIS, alpha=ALPHA) -> DataFrame:
    """(keys, pi, lower, method): lower bound under an assumed censoring rate.

    The quantile levels depend on pi only, so all of them come from one percentile aggregate.
    """
    k, q = list(keys), alpha / 2
    level = [q if p <= 0 else (q - p) / (1 - p) if q > p else None for p in pis]
    quant = hist.groupBy(*k).agg(F.percentile("delta", F.array(*[F.lit(x if x is not None else 0.0) for x in level]), F.col("n")).alias("_q"))
    t = tail_fit(hist, k).join(quant, k)
    rows = []
    for i, p in enumerate(pis):
        if level[i] is not None:
            lower, how = F.col("_q")[i], F.lit("empirical" if p <= 0 else "reweighted")
        else:
            val = tail_quantile(F.lit(q), F.lit(p + (1 - p) * TAIL_SHARE))
            lower, how = F.coalesce(val, F.col("x_min")), F.when(val.isNotNull(), "gpd_extrapolated").otherwise("unidentified_floor")
        rows.append(F.struct(F.lit(float(p)).alias("pi"), lower.alias("lower"), how.alias("method")))
    return t.select(*k, F.explode(F.array(*rows)).alias("x")).select(*k, "x.*")


def degradation(pi: Column, alpha=ALPHA):
    """(true lower-miss rate, effective two-sided level) of a bound taken on survivors only."""
    miss = pi + (1 - pi) * alpha / 2
    return miss, 1 - (miss + alpha / 2)


def censoring_backtest(hist: DataFrame, pi_true=0.15, pis=PIS, alpha=ALPHA) -> DataFrame:
    """Drop every group's own lowest ``pi_true`` share, bound the survivors, and measure the whole
    group's mass below the naive and the corrected bound."""
    cut = hist.groupBy("scheme").agg(F.percentile("delta", F.lit(pi_true), F.col("n")).alias("_cut"))
    survivors = hist.join(cut, "scheme").where(F.col("delta") > F.col("_cut")).select("scheme", "delta", "n")
    b = corrected_bounds(survivors, pis=pis, alpha=alpha)
    naive = survivors.groupBy("scheme").agg(F.percentile("delta", F.lit(alpha / 2), F.col("n")).alias("naive_lower"))
    b = b.join(naive, "scheme")
    per = b.groupBy("scheme").agg(F.collect_list(F.struct("pi", "lower", "method", "naive_lower")).alias("_b"))
    # one row per histogram row and assumed rate: a handful of rates, never a pair of rows
    t = hist.join(per, "scheme").select("scheme", "delta", "n", F.explode("_b").alias("b")).select("scheme", "delta", "n", "b.*")
    mass = lambda c: F.sum(F.when(F.col("delta") < F.col(c), F.col("n")).otherwise(0)) / F.sum("n")
    return t.groupBy("scheme", "pi", "lower", "method", "naive_lower").agg(
        mass("lower").alias("mass_below"), mass("naive_lower").alias("mass_below_naive"))


def mixture_quantile(published: DataFrame, excess: DataFrame, pis=PIS, alpha=ALPHA, draws=200_000, seed=0) -> DataFrame:
    """(pi, lower): alpha/2 quantile of a published draw plus, with probability pi, an excess draw.

    Seeded draws of fixed number, so the product of the two sets is never formed.
    """
    spark = published.sparkSession
    index = lambda d, c, out: dense_index(d.select(F.lit(0).alias("_g"), F.col(c).alias(out), F.concat_ws(":", *d.columns).alias("_k")), ["_g"], "_k")
    pub, exc = index(published, "delta", "p"), index(excess, "excess", "e")
    size = lambda d: d.agg(F.count("*")).scalar()
    h = lambda salt: md5_int(seed, salt, F.col("id"))
    d = spark.range(draws).select(
        "id", F.pmod(h("p"), size(pub)).alias("_ip"), F.pmod(h("e"), size(exc)).alias("_ie"),
        (F.pmod(h("u"), F.lit(1_000_000)) / 1_000_000).alias("u"))
    d = (d.join(pub.select(F.col("idx").alias("_ip"), "p"), "_ip").join(exc.select(F.col("idx").alias("_ie"), "e"), "_ie"))
    rows = F.array(*[F.struct(F.lit(float(pi)).alias("pi"), (F.col("p") + F.when(F.col("u") < pi, F.col("e")).otherwise(0.0)).alias("x")) for pi in pis])
    return d.select(F.explode(rows).alias("r")).groupBy("r.pi").agg(F.percentile("r.x", F.lit(alpha / 2)).alias("lower"))


def catch_count(hist: DataFrame, bounds: DataFrame) -> DataFrame:
    """(scheme, pi, inside, n): how many given observations stay at or above each bound."""
    per = bounds.groupBy("scheme").agg(F.collect_list(F.struct("pi", "lower")).alias("_b"))
    t = hist.join(per, "scheme").select("scheme", "delta", "n", F.explode("_b").alias("b"))
    return t.groupBy("scheme", F.col("b.pi").alias("pi")).agg(
        F.sum(F.when(F.col("delta") >= F.col("b.lower"), F.col("n")).otherwise(0)).alias("inside"), F.sum("n").alias("n"))
