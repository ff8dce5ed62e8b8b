"""Exact order statistics on weighted histograms.

Deltas are stored on a 1e-4 grid inside [-100, 100], so a group of any row count has at most about
two million distinct values. Every quantile in this package is therefore taken on
``(group, value) -> n``: the row table is reduced by a map-side-combined ``groupBy`` that no hot
group can skew, and only the histogram is ordered inside a window.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from pairmeter.plans.staging import stage

INF = float("inf")


def histogram(df: DataFrame, *keys, value="delta", n="n") -> DataFrame:
    return df.groupBy(*keys, value).agg(F.count("*").alias(n))


def conformal_rank(n: Column, alpha: float | Column) -> Column:
    """ceil((n + 1)(1 - alpha)); the quantile does not exist when this exceeds n."""
    level = (1 - alpha) if isinstance(alpha, Column) else F.lit(1 - alpha)
    return F.ceil((n + 1) * level)


def with_ranks(hist: DataFrame, keys, value, n="n") -> DataFrame:
    """Adds ``cum`` (rows at or below the value) and ``tot`` (rows in the group)."""
    w = Window.partitionBy(*keys)
    up_to = w.orderBy(value).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return hist.withColumns({"cum": F.sum(n).over(up_to), "tot": F.sum(n).over(w)})


def kth_smallest(hist: DataFrame, keys, value, rank, n="n", name="q") -> DataFrame:
    """The rank(tot)-th smallest value per group; null when the rank is outside 1..tot."""
    r = with_ranks(hist, keys, value, n)
    k = rank(F.col("tot"))
    return r.groupBy(*keys).agg(
        F.max("tot").alias("n"), F.min(F.when((F.col("cum") >= k) & (k >= 1), F.col(value))).alias(name))


def conformal_quantile(hist: DataFrame, keys, score, alpha=0.10, n="n", name="q") -> DataFrame:
    """Split-conformal quantile per group; +inf when the group is too small for the level."""
    out = kth_smallest(hist, keys, score, lambda tot: conformal_rank(tot, alpha), n, name)
    return out.withColumn(name, F.coalesce(name, F.lit(INF)))


BUCKET = 0.05  # points; at most 4,000 buckets for residuals up to 200


def kth_refined(rows: DataFrame, keys, value, rank, n="n", name="q", width=BUCKET) -> DataFrame:
    """``kth_smallest`` for rows too many to shuffle, such as residuals expanded over folds.

    First pass: counts per bucket of the value, combined before the shuffle, name the bucket that
    holds the wanted rank. Second pass: only the rows of that bucket are ordered. Exact, and neither
    pass moves the rows themselves.
    """
    keys = list(keys)
    rows = rows.withColumn("_b", F.floor(F.col(value) / width))
    coarse = rows.groupBy(*keys, "_b").agg(F.sum(n).alias("_c"))
    w = Window.partitionBy(*keys)
    upto = w.orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    coarse = coarse.withColumns({"_cum": F.sum("_c").over(upto), "_tot": F.sum("_c").over(w)})
    k = rank(F.col("_tot"))
    hit = F.struct(F.col("_b").alias("b"), (k - (F.col("_cum") - F.col("_c"))).alias("need"))
    target = stage(coarse.groupBy(*keys).agg(F.max("_tot").alias("_n"), F.min(F.when((F.col("_cum") >= k) & (k >= 1), hit)).alias("_t"))
                   .select(*keys, "_n", F.col("_t.b").alias("_b"), F.col("_t.need").alias("_need")))
    near = (rows.join(target.drop("_n").where("_b is not null"), [*keys, "_b"])
            .groupBy(*keys, "_need", value).agg(F.sum(n).alias(n)))
    fine = with_ranks(near, keys, value, n).groupBy(*keys).agg(F.min(F.when(F.col("cum") >= F.col("_need"), F.col(value))).alias(name))
    return target.select(*keys, F.col("_n").alias("n")).join(fine, keys, "left")


def percentile_refined(rows: DataFrame, keys, value, p, n="n", name="p") -> DataFrame:
    """Linear-interpolated percentile per key of values that need not lie on a grid: the two
    neighbouring order statistics, each by ``kth_refined``, so no group is held in memory."""
    keys, pos = list(keys), lambda tot: F.lit(float(p)) * (tot - 1)
    lo = kth_refined(rows, keys, value, lambda t: (F.floor(pos(t)) + 1).cast("long"), n, "_lo")
    hi = kth_refined(rows, keys, value, lambda t: (F.ceil(pos(t)) + 1).cast("long"), n, "_hi").drop("n")
    frac = pos(F.col("n")) - F.floor(pos(F.col("n")))
    return lo.join(hi, keys).select(*keys, (F.col("_lo") + frac * (F.col("_hi") - F.col("_lo"))).alias(name))


def finite(col) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.abs(c) < INF


def finite_or_null(col) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.when(finite(c), c)


def weighted_percentile(value, probs, n="n") -> Column:
    """Linear-interpolated percentile(s) of a histogram column."""
    v = F.col(value) if isinstance(value, str) else value
    p = F.array(*[F.lit(float(x)) for x in probs]) if isinstance(probs, (list, tuple)) else F.lit(float(probs))
    return F.percentile(v, p, F.col(n))


def weighted_mean(value, n="n") -> Column:
    v = F.col(value) if isinstance(value, str) else value
    return F.sum(v * F.col(n)) / F.sum(n)
