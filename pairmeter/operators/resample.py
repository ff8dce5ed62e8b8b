"""Uncertainty of a ratio under cluster sampling.

Every operator starts from per-cluster sums ``(keys, cluster, ok, n)``, so its input is one row per
cluster whatever the number of rows behind it.
"""

import hashlib
from math import factorial, prod

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from pairmeter.plans.local import constant_table
from pairmeter.plans.staging import stage

EXACT_MAX = 8
SLACK = 1e-12
PRIME = 2**31 - 1
DRAW_BLOCK = 2000  # draws of one row dealt to a task
PICKS = 1 << 14    # picks made at a time


def compositions(spark, largest=EXACT_MAX) -> DataFrame:
    """(k, counts, prob): every multiset of k draws from k clusters with its multinomial mass."""
    def split(total, parts):
        if parts == 1:
            yield (total,)
            return
        for first in range(total + 1):
            for rest in split(total - first, parts - 1):
                yield (first, *rest)

    rows = [(k, list(c), factorial(k) / prod(factorial(x) for x in c) / k ** k)
            for k in range(1, largest + 1) for c in split(k, k)]
    return constant_table(spark, {"k": [r[0] for r in rows], "counts": [r[1] for r in rows],
                                  "prob": [r[2] for r in rows]})


def with_cluster_count(clusters: DataFrame, keys) -> DataFrame:
    return clusters.join(clusters.groupBy(*keys).agg(F.count("*").cast("int").alias("k")), list(keys))


def exact_bounds(clusters: DataFrame, keys, ok="ok", n="n", cluster="base_model", lo=0.05, hi=0.95) -> DataFrame:
    """Exact bootstrap bounds in percent for groups of at most eight clusters.

    The bound at level a is the smallest ratio whose cumulative probability reaches a.
    """
    small = with_cluster_count(clusters, keys).where(F.col("k") <= EXACT_MAX)
    arr = small.groupBy(*keys, "k").agg(
        F.sort_array(F.collect_list(F.struct(F.col(cluster), F.col(ok).cast("double").alias("s"),
                                             F.col(n).cast("double").alias("m")))).alias("c"))
    comp = compositions(clusters.sparkSession)
    total = lambda f: F.aggregate(F.zip_with("counts", "c", lambda w, x: w * x[f]), F.lit(0.0), lambda a, b: a + b)
    v = arr.join(comp.withColumn("k", F.col("k").cast("int")), "k").withColumn("v", total("s") / total("m"))
    w = Window.partitionBy(*keys).orderBy("v").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    v = v.withColumn("cum", F.sum("prob").over(w))
    at = lambda a: F.coalesce(F.min(F.when(F.col("cum") >= a - SLACK, F.col("v"))), F.max("v"))
    return v.groupBy(*keys).agg(F.max("k").alias("k"), (100 * at(lo)).alias("boot_lo"), (100 * at(hi)).alias("boot_hi"))


def dense_index(df: DataFrame, keys, order) -> DataFrame:
    """0-based index per group, in the order of (five hash digits, value), without ordering a whole
    group in one task: hash buckets are numbered separately and shifted by the running bucket counts.
    There are as many buckets as distinct digits occur, so they follow the number of rows."""
    d = df.withColumn("_b", F.substring(F.md5(F.col(order).cast("string")), 1, 5))
    per = d.groupBy(*keys, "_b").agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("_off", F.coalesce(F.sum("_n").over(w), F.lit(0))).drop("_n")
    inner = Window.partitionBy(*keys, "_b").orderBy(order)
    return (d.join(per, [*keys, "_b"]).withColumn("idx", F.row_number().over(inner) - 1 + F.col("_off"))
            .drop("_b", "_off"))


def _cubics(draws, seed):
    digests = b"".join(hashlib.md5(f"{seed}:{d}".encode()).digest() for d in draws)
    return np.frombuffer(digests, ">u4").reshape(-1, 4).astype(np.int64).T[:, :, None] % PRIME


def _cubic_at(cubics, j):
    a, b, c, d = cubics
    out = (a * j + b) % PRIME
    for term in (c, d):
        out *= j
        out += term
        out %= PRIME
    return out


def draw_picks(draws, start, stop, k, seed=0):
    """(len(draws), stop - start) picks: entry (i, j) is the index of the cluster taken by pick j of draw i.

    A draw is a cubic over the integers modulo ``PRIME`` whose four coefficients are the MD5 of (seed, draw);
    pick j is its value at j, so any four picks of a draw are independent and other engines repeat them.
    """
    return _cubic_at(_cubics(draws, seed), np.arange(start, stop, dtype=np.int64)) % k


def _packed(columns):
    """Pairs of whole-number columns as one, a half each, where no sum of k entries can leave its half."""
    fits = lambda c: c.dtype.kind == "i" and c.min() >= 0 and len(c) * int(c.max()) < 1 << 31
    names, out = list(columns), []
    while names:
        pair = names[:2]
        if len(pair) == 2 and all(fits(columns[x]) for x in pair):
            out.append((pair, (columns[pair[0]].astype(np.int64) << 32) + columns[pair[1]]))
            names = names[2:]
        else:
            out.append((names[:1], columns[names.pop(0)]))
    return out


def drawn_sums(first, last, columns, seed=0):
    """{column: sums over the k picks of each draw from ``first`` to before ``last``}; k is the columns' length.

    The picks are those of ``draw_picks``. Some lanes of consecutive picks step on together, and a cubic's step is
    three additions of its differences modulo ``PRIME``: a pick costs no multiplication modulo the prime.
    """
    k = len(next(iter(columns.values())))
    lanes = min(k, max(16, min(256, k // 64)))
    packed, out = _packed(columns), {x: np.zeros(last - first, c.dtype) for x, c in columns.items()}
    prime, size = np.uint32(PRIME), np.uint32(k)
    at_once = max(1, PICKS // lanes)
    for lo in range(first, last, at_once):
        hi = min(lo + at_once, last)
        cubics, j = _cubics(range(lo, hi), seed), np.arange(lanes, dtype=np.int64)
        values = [_cubic_at(cubics, j + i * lanes) for i in range(4 if k > lanes else 1)]
        steps = []
        while values:
            steps.append(values[0].astype(np.uint32))
            values = [(b - a) % PRIME for a, b in zip(values, values[1:])]
        spare, picks = np.empty_like(steps[0]), np.empty(steps[0].shape, np.int64)
        added = [(names, c, np.zeros(picks.shape, c.dtype), np.empty(picks.shape, c.dtype)) for names, c in packed]
        for start in range(0, k, lanes):
            if start:
                for a, b in zip(steps, steps[1:]):  # a sum below 2 * PRIME less PRIME wraps above it if it is below PRIME
                    a += b
                    np.subtract(a, prime, out=spare)
                    np.minimum(a, spare, out=a)
            np.floor_divide(steps[0], size, out=spare)
            spare *= size
            np.subtract(steps[0], spare, out=spare)
            picks[...] = spare
            for _, c, total, got in added:
                if k - start >= lanes:
                    np.take(c, picks, out=got, mode="clip")
                    total += got
                else:
                    total[:, :k - start] += c[picks[:, :k - start]]
        for names, _, total, _ in added:
            t = total.sum(axis=1)
            for x, part in zip(names, (t >> 32, t & 0xffffffff) if len(names) == 2 else (t,)):
                out[x][lo - first:hi - first] = part
    return out


def free_sums(first, last, columns, seed=0):
    """As ``drawn_sums``, pick j of a draw being the first fifteen digits of the MD5 of (seed, draw, j) modulo k:
    all picks of a draw are independent, and dear."""
    k = len(next(iter(columns.values())))
    out = {x: np.zeros(last - first, c.dtype) for x, c in columns.items()}
    for draw in range(first, last):
        for start in range(0, k, PICKS):
            digests = b"".join([hashlib.md5(b"%d:%d:%d" % (seed, draw, j)).digest() for j in range(start, min(start + PICKS, k))])
            picks = (np.frombuffer(digests, ">u8")[::2].astype(np.uint64) >> 4) % k
            for x, c in columns.items():
                out[x][draw - first] += c[picks].sum()
    return out


def draws_table(clusters: DataFrame, keys, sums, draws, seed=0, cluster="base_model", free=False) -> DataFrame:
    """One row per (group, draw): ``sums`` added over k clusters drawn with replacement (``drawn_sums``, or
    ``free_sums`` if ``free``).

    ``draws`` is a number or a column of the keys. A group's sums are arrays in one row, dealt out once per
    block of draws; the picks are made and added in a task a bounded number at a time, so groups x draws rows
    are shuffled, never picks. A pick costs a few vector operations in the processor's cache.
    """
    spark = clusters.sparkSession
    c = dense_index(with_cluster_count(clusters, keys), keys, cluster)
    c = c.groupBy(*keys, "k").agg(F.array_sort(F.collect_list(F.struct("idx", *sums))).alias("_c"))
    field = lambda name: F.transform("_c", lambda x: x[name]).alias(name)
    n = draws if isinstance(draws, Column) else F.lit(draws)
    c = stage(c.select(*keys, "k", n.alias("_n"), *[field(s) for s in sums]))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    block = DRAW_BLOCK // 10 if free else DRAW_BLOCK
    blocks = F.sequence(F.lit(0), F.col("_n") - 1, F.lit(block))
    runs = c.select(*keys, F.explode(blocks).alias("_first"))
    runs = runs.repartition(max(parts, 4 * spark.sparkContext.defaultParallelism), *keys, "_first")
    key_types = [c.schema[x] for x in keys]
    sum_types = [T.StructField(s, c.schema[s].dataType.elementType) for s in sums]

    def add(batches):
        for pdf in batches:
            for row in pdf.to_dict("records"):
                first = row["_first"]
                last = min(first + block, row["_n"])
                out = (free_sums if free else drawn_sums)(first, last, {s: row[s] for s in sums}, seed)
                yield pd.DataFrame({**{x: row[x] for x in keys}, "draw": np.arange(first, last), **out})

    return runs.join(c, list(keys)).mapInPandas(
        add, T.StructType([*key_types, T.StructField("draw", T.LongType()), *sum_types]))


def percentile_bounds(values: DataFrame, keys, value, lo=0.05, hi=0.95) -> DataFrame:
    """``lower`` order statistic for lo and ``higher`` for hi over the draws of each group."""
    w = Window.partitionBy(*keys)
    r = values.withColumns({"_i": F.row_number().over(w.orderBy(value, "draw")) - 1, "_m": F.count("*").over(w)})
    at = lambda k: F.max(F.when(F.col("_i") == k, F.col(value)))
    return r.groupBy(*keys).agg(at(F.floor(F.lit(lo) * (F.col("_m") - 1))).alias("boot_lo"),
                                at(F.ceil(F.lit(hi) * (F.col("_m") - 1))).alias("boot_hi"))


def monte_carlo_bounds(clusters: DataFrame, keys, ok="ok", n="n", draws=2000, seed=0, lo=0.05, hi=0.95,
                       scale=100.0, cluster="base_model", free=False) -> DataFrame:
    d = draws_table(clusters, keys, [ok, n], draws, seed, cluster, free).withColumn("v", scale * F.col(ok) / F.col(n))
    return percentile_bounds(d, keys, "v", lo, hi)


def bounds(clusters: DataFrame, keys, ok="ok", n="n", draws=2000, seed=0) -> DataFrame:
    """Exact bounds up to eight clusters, seeded Monte Carlo above."""
    k = with_cluster_count(clusters, keys)
    exact = exact_bounds(clusters, keys, ok, n).drop("k")
    large = k.where(F.col("k") > EXACT_MAX).drop("k")
    return exact.unionByName(monte_carlo_bounds(large, keys, ok, n, draws, seed))


def sandwich(clusters: DataFrame, keys, ok="ok", n="n") -> DataFrame:
    """Cluster-robust interval of sum(ok)/sum(n), with the naive standard error beside it.

    sum((S - pN)^2) is expanded into sums of S^2, SN and N^2, so one aggregate suffices.
    """
    s, m = F.col(ok).cast("double"), F.col(n).cast("double")
    t = clusters.groupBy(*keys).agg(F.count("*").alias("k"), F.sum(s).alias("S"), F.sum(m).alias("N"),
                                    F.sum(s * s).alias("ss"), F.sum(s * m).alias("sm"), F.sum(m * m).alias("mm"))
    p = F.col("S") / F.col("N")
    dev = F.greatest(F.col("ss") - 2 * p * F.col("sm") + p * p * F.col("mm"), F.lit(0.0))
    t = t.withColumns({"p": p, "se": F.when(F.col("k") > 1, F.sqrt(F.col("k") / (F.col("k") - 1) * dev) / F.col("N")),
                       "se_naive": F.sqrt(p * (1 - p) / F.col("N"))})
    return t.withColumns({
        "lo": F.col("p") - 1.96 * F.col("se"), "hi": F.col("p") + 1.96 * F.col("se"),
        "se_ratio": F.when(F.col("se_naive") > 0, F.col("se") / F.col("se_naive")),
        "width_naive": 2 * 1.96 * F.col("se_naive"), "width_robust": 2 * 1.96 * F.col("se"),
    }).drop("ss", "sm", "mm")


def intraclass(clusters: DataFrame, keys, ok="ok", n="n") -> DataFrame:
    """One-way ANOVA intraclass correlation of a 0/1 indicator and its design effect."""
    s, m = F.col(ok).cast("double"), F.col(n).cast("double")
    t = clusters.groupBy(*keys).agg(F.count("*").alias("k"), F.sum(s).alias("S"), F.sum(m).alias("N"),
                                    F.sum(s * s / m).alias("q"), F.sum(m * m).alias("mm"), F.max(m).alias("max_rows"))
    k, N, S = F.col("k"), F.col("N"), F.col("S")
    msb = F.try_divide(F.col("q") - S * S / N, k - 1)  # sum n(ybar - p)^2
    msw = F.try_divide(S - F.col("q"), N - k)          # sum over 0/1 rows of (y - ybar)^2
    m0 = F.try_divide(N - F.col("mm") / N, k - 1)
    icc = F.try_divide(msb - msw, msb + (m0 - 1) * msw)
    return t.select(*keys, "k", N.alias("n"), icc.alias("icc"),
                    F.when(icc.isNotNull(), 1 + (N / k - 1) * F.greatest(icc, F.lit(0.0))).alias("design_effect"), "max_rows")


# ------------------------------------------------------------------ Clopper-Pearson


def _beta_cdf(x, a, b):
    """Regularised incomplete beta by its continued fraction."""
    from math import exp, lgamma, log
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_cdf(1 - x, b, a)
    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log(1 - x)) / a
    tiny, c, d = 1e-300, 1.0, 1 / max(1 - (a + b) * x / (a + 1), 1e-300)
    h = d
    for i in range(1, 500):
        for num in (i * (b - i) * x / ((a + 2 * i - 1) * (a + 2 * i)),
                    -(a + i) * (a + b + i) * x / ((a + 2 * i) * (a + 2 * i + 1))):
            d = 1 / (1 + num * d or tiny)
            c = 1 + num / c or tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def _beta_quantile(p, a, b):
    lo, hi = 0.0, 1.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if _beta_cdf(mid, a, b) < p else (lo, mid)
    return (lo + hi) / 2


@F.pandas_udf(T.StructType([T.StructField("lo", T.DoubleType()), T.StructField("hi", T.DoubleType())]))
def _clopper_pearson(k: pd.Series, n: pd.Series, conf: pd.Series) -> pd.DataFrame:
    out = [(0.0 if x == 0 else _beta_quantile((1 - c) / 2, x, m - x + 1),
            1.0 if x == m else _beta_quantile(1 - (1 - c) / 2, x + 1, m - x)) for x, m, c in zip(k, n, conf)]
    return pd.DataFrame(out, columns=["lo", "hi"])


def clopper_pearson(k, n, conf=0.95) -> Column:
    """Exact binomial interval struct(lo, hi); for aggregated rows only."""
    c = lambda x: F.col(x).cast("double") if isinstance(x, str) else x.cast("double")
    return _clopper_pearson(c(k), c(n), F.lit(float(conf)))


# ------------------------------------------------------------------ correlation


def average_rank(df: DataFrame, value, out) -> DataFrame:
    """Average rank with ties of a weighted table (weight ``n``): rows below plus half the ties.

    The distinct values are range-partitioned by what is there, so a peaked column spreads like any
    other; partitions are offset by their totals, one number each.
    """
    per = df.groupBy(value).agg(F.sum("n").alias("_t"))
    per = stage(per.repartitionByRange(value).withColumn("_part", F.spark_partition_id()))
    sums = sorted(per.groupBy("_part").agg(F.sum("_t")).collect())
    before = constant_table(df.sparkSession, {"_part": [int(p) for p, _ in sums], "_off": [int(sum(t for _, t in sums[:i])) for i in range(len(sums))]})
    inner = Window.partitionBy("_part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    ranks = per.join(before, "_part").select(
        value, (F.col("_off") + F.coalesce(F.sum("_t").over(inner), F.lit(0)) + (F.col("_t") + 1) / 2).alias(out))
    return df.join(ranks, value)


def _weighted_corr(x, y) -> Column:
    n = F.col("n")
    mean = lambda c: F.sum(c * n) / F.sum(n)
    x, y = F.col(x).cast("double"), F.col(y).cast("double")
    spread = lambda c: mean(c * c) - mean(c) * mean(c)
    return (mean(x * y) - mean(x) * mean(y)) / F.sqrt(spread(x) * spread(y))


def correlations(df: DataFrame, x, y) -> DataFrame:
    """Pearson and Spearman of two columns, on the counts of their distinct pairs."""
    pairs = stage(df.select(x, y).dropna().groupBy(x, y).agg(F.count("*").alias("n")))
    r = average_rank(average_rank(pairs, x, "_rx"), y, "_ry")
    return r.agg(F.sum("n").alias("n"), _weighted_corr(x, y).alias("pearson"), _weighted_corr("_rx", "_ry").alias("spearman"))
