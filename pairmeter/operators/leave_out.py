"""Protocols that leave out one cluster at a time, the cluster itself being the fold.

Nothing is refitted and no row is copied per fold. A left-out cluster changes a fit by its own sums, which
are subtracted, and a calibration set by its own rows, which are taken off the counts: the k-th smallest
distance from a fold's centre is found by bisection on the cumulative histogram of a cell, less the
cluster's own histogram. A histogram has at most about two million values (deltas lie on a grid), so a task
holds one cell and a chunk of folds; the work grows with the clusters, times a logarithm.

Several partitions of the clusters (seeds) are one job: each cluster has a bit mask of the partitions that
calibrate on it, and the histogram is kept per mask, so rows are read once whatever the number of seeds.
"""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from pairmeter.functions.exprs import md5_int
from pairmeter.operators.conformal import ALPHA, MIN_CAL_ROWS, MIN_CLUSTERS, MIN_ROWS
from pairmeter.operators.order_stats import INF, conformal_rank, finite, kth_refined
from pairmeter.plans.staging import stage

#: Folds whose order statistics one task finds on the histogram of a cell.
CHUNK = 50_000
#: Distances this close count as equal.
NEAR = 1e-11


# ------------------------------------------------------------------ order statistics under deletion


def _cumulative(counts) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)


def _within(values, start, stop, x, right):
    """Per x the number of ``values[start:stop]``, a sorted stretch, below x (``right``: or equal), from ``start``."""
    lo, hi = start.copy(), stop.copy()
    while len(values) and (lo < hi).any():
        mid = (lo + hi) // 2
        v = values[np.minimum(mid, len(values) - 1)]
        up = (v <= x if right else v < x) & (lo < hi)
        lo, hi = np.where(up, mid + 1, lo), np.where(~up & (lo < hi), mid, hi)
    return lo


def kth_about(values, counts, centre, rank, own_values, own_counts, own_sizes):
    """(n, q) per fold: the rows of the histogram without the fold's own ones, and the rank(n)-th smallest
    distance of their values from ``centre``; infinite where there is none.

    The centres of a cell lie close together: the distances about their mean, sorted once, bound each fold's
    own one by how far its centre lies from the mean and by how many rows it leaves out, and the bisection
    starts between those bounds. ``own_values`` and ``own_counts`` hold the folds' own histograms one after the other, each sorted.
    """
    cum, own = _cumulative(counts), _cumulative(own_counts)
    stop = np.cumsum(own_sizes)
    start = stop - own_sizes
    n = cum[-1] - (own[stop] - own[start])
    k, m = rank(n), len(values)

    def inside(lo, hi):
        lo, hi = lo - NEAR, hi + NEAR
        all_ = cum[np.searchsorted(values, hi, "right")] - cum[np.searchsorted(values, lo, "left")]
        return all_ - (own[_within(own_values, start, stop, hi, True)] - own[_within(own_values, start, stop, lo, False)])

    def first(at, size, start, stop):
        """The first of ``size`` steps away from the centre at which k rows are inside; ``at``: step to index.
        It is one from ``start`` to ``stop``, or one that lies further out than the first on the other side."""
        a = np.clip(start, 0, size)
        b = np.clip(stop, a, size)
        while (a < b).any():
            mid = (a + b) // 2
            v = values[np.clip(at(mid), 0, m - 1)]
            enough = inside(np.minimum(v, 2 * centre - v), np.maximum(v, 2 * centre - v)) >= k
            a, b = np.where(~enough & (a < b), mid + 1, a), np.where(enough & (a < b), mid, b)
        return np.where(a < size, np.abs(values[np.clip(at(a), 0, m - 1)] - centre), np.inf) if m else np.full(len(centre), np.inf)

    mean = centre.mean() if len(centre) else 0.0
    order = np.argsort(np.abs(values - mean))
    upto, far = np.cumsum(counts[order]), np.append(np.abs(values - mean)[order], np.inf)
    move = np.abs(centre - mean) + 4 * NEAR
    low, high = far[np.searchsorted(upto, k)] - move, far[np.searchsorted(upto, k + cum[-1] - n)] + move
    low = np.where(np.isfinite(low), low, 0.0)
    middle = np.searchsorted(values, centre)
    at = lambda x, side: np.searchsorted(values, x, side)
    q = np.minimum(first(lambda j: middle + j, m - middle, at(centre + low, "left") - middle, at(centre + high, "right") - middle),
                   first(lambda j: middle - 1 - j, middle, middle - at(centre - low, "right"), middle - at(centre - high, "left")))
    return n, np.where((k >= 1) & (k <= n), q, np.inf)


def _none(*names):
    return pd.DataFrame({c: pd.Series(dtype=object) for c in names})


def _flat(arrays, kind):
    arrays = [np.asarray(a, kind) for a in arrays]
    return np.concatenate([np.zeros(0, kind), *arrays]), np.array([len(a) for a in arrays], np.int64)


def about_centres(hist: DataFrame, requests: DataFrame, by, chunks: int, alpha=ALPHA, name="q") -> DataFrame:
    """(by, base_model, ``name``_n, ``name``): conformal quantile of ``hist(by, delta, n)`` about the centre of
    every request ``(by, base_model, centre, own_delta, own_n)``, without the request's own rows."""
    def select(key, h, r):
        if not len(r):
            return _none(*by, "base_model", name + "_n", name)
        h = h.sort_values("delta")
        own_n, _ = _flat(r["own_n"], np.int64)
        own, sizes = _flat(r["own_delta"], np.float64)
        n, q = kth_about(h["delta"].to_numpy(np.float64), h["n"].to_numpy(np.int64), r["centre"].to_numpy(np.float64),
                         lambda n: np.ceil((n + 1) * (1 - alpha)), own, own_n, sizes)
        return r[[*by, "base_model"]].assign(**{name + "_n": n, name: q})

    fields = [f"{f.name} {f.dataType.simpleString()}" for f in requests.select(*by, "base_model").schema.fields]
    hist = hist.select(*by, "delta", "n", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"))
    requests = requests.withColumn("chunk", F.pmod(F.hash("base_model"), F.lit(chunks)))
    return (hist.groupBy(*by, "chunk").cogroup(requests.groupBy(*by, "chunk"))
                .applyInPandas(select, ", ".join([*fields, f"{name}_n long", f"{name} double"])))


def _arrays(df: DataFrame, *keys) -> DataFrame:
    pairs = F.array_sort(F.collect_list(F.struct("delta", "n")))
    return df.groupBy(*keys).agg(pairs.alias("_p")).select(*keys, F.transform("_p", lambda x: x["delta"]).alias("own_delta"),
                                                          F.transform("_p", lambda x: x["n"]).alias("own_n"))


# ------------------------------------------------------------------ partitions of the clusters


def partitions(clusters: DataFrame, sides) -> DataFrame:
    """(part, base_model, is_cal, tested) from boolean expressions of ``base_model``, one per partition."""
    each = [F.struct(F.lit(i).alias("part"), c.alias("is_cal"), F.lit(True).alias("tested")) for i, c in enumerate(sides)]
    return clusters.select("base_model", F.explode(F.array(*each)).alias("x")).select("x.part", "base_model", "x.is_cal", "x.tested")


def sampled_partitions(clusters: DataFrame, seeds: int, fraction: float) -> DataFrame:
    """Per seed, a calibration set of ``fraction`` of the *other* clusters for every left-out one.

    The other clusters are taken in the order of their seeded hash, so only two sets occur: the first m + 1
    without the left-out cluster if that is one of them (partition 2 x seed), the first m for all others
    (partition 2 x seed + 1).
    """
    h = clusters.select("base_model", F.explode(F.sequence(F.lit(0), F.lit(seeds - 1))).alias("seed"))
    h = stage(h.select("seed", "base_model", md5_int(F.col("seed"), F.col("base_model")).alias("h"), F.lit(1).alias("n")))
    m = lambda total: F.greatest(F.lit(1), F.bround((total - 1) * F.lit(fraction))).cast("long")
    at = lambda rank, name: kth_refined(h, ["seed"], "h", rank, name=name, width=1 << 44).select("seed", name)
    h = h.join(at(m, "last"), "seed").join(at(lambda t: m(t) + 1, "next"), "seed", "left").drop("n")
    among = F.col("h") <= F.coalesce("next", F.lit((1 << 62)))
    each = F.array(F.struct((2 * F.col("seed")).alias("part"), among.alias("is_cal"), among.alias("tested")),
                   F.struct((2 * F.col("seed") + 1).alias("part"), (F.col("h") <= F.col("last")).alias("is_cal"), (~among).alias("tested")))
    return h.select("base_model", F.explode(each).alias("x")).select("x.part", "base_model", "x.is_cal", "x.tested")


class LeaveOut:
    """The written reductions that every protocol of this module reads.

    ``sides``: (part, base_model, is_cal, tested); each tested cluster of a partition is a fold.
    """

    def __init__(self, df: DataFrame, sides: DataFrame, min_cal=1, min_train=1, alpha=ALPHA):
        self.alpha = alpha
        self.rows = stage(df.groupBy("base_model", "scheme", "band", "delta").agg(F.count("*").alias("n")))
        self.sides = stage(sides)
        self.chunks = max(1, -(-self.sides.select("base_model").distinct().count() // CHUNK))
        total = F.sum(F.col("delta") * F.col("n")).alias("s")
        self.cells = stage(self.rows.groupBy("base_model", "scheme", "band").agg(total, F.sum("n").alias("n")))
        self.cal, self.fit = self._side(F.col("is_cal")), self._side(~F.col("is_cal"))
        placed = self.cells.join(self.sides, "base_model")
        cell = placed.where("not is_cal").groupBy("part", "scheme", "band").agg(F.sum("s").alias("all_s"), F.sum("n").alias("all_n"), F.count("*").alias("all_k"))
        self.fit_cells = stage(cell)
        self.fit_schemes = self.fit_cells.groupBy("part", "scheme").agg(F.sum("all_s").alias("all_s"), F.sum("all_n").alias("all_n"))
        whole = self.fit_cells.groupBy("part").agg(F.sum("all_s").alias("whole_s"), F.sum("all_n").alias("whole_n"))
        cal = placed.where("is_cal").groupBy("part").agg(F.sum("n").alias("cal_n"))

        mine = lambda c: F.when(F.col("is_cal"), 0).otherwise(F.col(c))
        own = placed.where("tested").groupBy("part", "base_model", "is_cal", "scheme").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
        w = Window.partitionBy("part", "base_model")
        own = own.withColumns({"t_s": F.sum("s").over(w), "t_n": F.sum("n").over(w)})
        d = own.join(whole, "part").join(cal, "part").join(self.fit_schemes, ["part", "scheme"], "left")
        left_cal = F.col("cal_n") - F.when(F.col("is_cal"), F.col("t_n")).otherwise(0)
        left_fit = F.col("whole_n") - mine("t_n")
        left_scheme = F.coalesce("all_n", F.lit(0)) - mine("n")
        d = d.where((left_cal >= min_cal) & (left_fit >= min_train))
        #: (part, base_model, is_cal, scheme, s_mean, g_mean): the centres of every fold that has enough rows.
        self.centres = stage(d.select("part", "base_model", "is_cal", "scheme",
            F.when(left_scheme > 0, (F.col("all_s") - mine("s")) / F.nullif(left_scheme, F.lit(0))).alias("s_mean"),
            ((F.col("whole_s") - mine("t_s")) / left_fit).alias("g_mean")))

    def _side(self, which: Column) -> DataFrame:
        """(part, scheme, band, delta, n) of one side of every partition, by way of the bit masks."""
        bit = F.when(which, F.expr("shiftleft(1L, part)")).otherwise(0)
        masks = self.sides.groupBy("base_model").agg(F.sum(bit).alias("mask"))
        packed = stage(self.rows.join(masks, "base_model").groupBy("mask", "scheme", "band", "delta").agg(F.sum("n").alias("n")))
        parts = F.filter(F.sequence(F.lit(0), F.lit(62)), lambda p: F.getbit("mask", p) == 1)
        spread = packed.select(F.explode(parts).alias("part"), "scheme", "band", "delta", "n")
        return stage(spread.groupBy("part", "scheme", "band", "delta").agg(F.sum("n").alias("n")))

    def quantiles(self, requests: DataFrame, by, name: str, side="cal") -> DataFrame:
        """Quantile about ``centre`` of requests (part, base_model, is_cal, ..., centre) on a side's histogram."""
        hist = getattr(self, side).groupBy("part", *by, "delta").agg(F.sum("n").alias("n"))
        own = _arrays(self.rows.groupBy("base_model", *by, "delta").agg(F.sum("n").alias("n")), "base_model", *by)
        inside = F.col("is_cal") if side == "cal" else ~F.col("is_cal")
        empty = lambda c: F.when(inside, F.col(c)).otherwise(F.array().cast("array<double>" if c == "own_delta" else "array<long>"))
        r = requests.join(own, ["base_model", *by]).select("part", *by, "base_model", "centre", empty("own_delta").alias("own_delta"), empty("own_n").alias("own_n"))
        return about_centres(hist, r, ["part", *by], self.chunks, self.alpha, name)

    def pooled(self, folds: DataFrame, name: str) -> DataFrame:
        """(part, base_model, ``name``): the quantile over all treatments, each about its own centre, for the
        few ``folds(part, base_model, is_cal, g_mean)`` that need it."""
        mean = self.centres.select("part", "base_model", "scheme", F.col("s_mean").alias("own_mean"), F.lit(True).alias("mine"))
        cal = self.cal.groupBy("part", "scheme", "delta").agg(F.sum("n").alias("n"))
        d = (folds.join(cal, "part").join(mean, ["part", "base_model", "scheme"], "left").join(self.fit_schemes, ["part", "scheme"], "left"))
        centre = F.coalesce(F.when(F.col("mine"), F.col("own_mean")).otherwise(F.col("all_s") / F.col("all_n")), F.col("g_mean"))
        rows = d.select("part", "base_model", F.abs(F.col("delta") - centre).alias("resid"), "n")
        off = self.rows.groupBy("base_model", "scheme", "delta").agg((-F.sum("n")).alias("n"))
        off = folds.where("is_cal").join(off, "base_model").join(mean, ["part", "base_model", "scheme"])
        off = off.select("part", "base_model", F.abs(F.col("delta") - F.coalesce("own_mean", "g_mean")).alias("resid"), "n")
        q = kth_refined(rows.unionByName(off), ["part", "base_model"], "resid", lambda tot: conformal_rank(tot, self.alpha), name=name)
        return q.select("part", "base_model", F.coalesce(name, F.lit(INF)).alias(name))

    def split_bands(self) -> DataFrame:
        """(part, base_model, scheme, band, yhat, half_width, lo, hi, widened): the widen-only band of every fold."""
        seen = stage(self.centres.where("s_mean is not null").withColumn("centre", F.col("s_mean")))
        fold = ["part", "base_model", "scheme"]
        scheme = seen.select(*fold, "is_cal", "centre", "s_mean").join(self.quantiles(seen, ["scheme"], "q_s"), fold, "left")
        scheme = stage(scheme.withColumns({"q_s_n": F.coalesce("q_s_n", F.lit(0).cast("long"))}))
        short = scheme.where(F.col("q_s_n") < MIN_CAL_ROWS)
        scheme = scheme.join(self.quantiles(short, ["scheme"], "q_fit", "fit"), fold, "left")
        scheme = scheme.select(*fold, F.when(F.col("q_s_n") < MIN_CAL_ROWS, F.col("q_fit")).otherwise(F.col("q_s")).alias("s_hw"))

        cells = self.cells.join(seen, ["base_model", "scheme"]).withColumn("cell_n", F.col("n"))
        less = lambda c: F.when(F.col("is_cal"), 0).otherwise(c)
        strata = cells.join(self.fit_cells, ["part", "scheme", "band"]).where(
            (F.col("all_n") - less(F.col("cell_n")) >= MIN_ROWS) & (F.col("all_k") - less(F.lit(1)) >= MIN_CLUSTERS))
        strata = self.quantiles(strata.select("part", "base_model", "is_cal", "scheme", "band", "centre"), ["scheme", "band"], "t_hw")
        strata = strata.where((F.col("t_hw_n") >= MIN_CAL_ROWS) & finite("t_hw"))

        unseen = self.centres.where("s_mean is null").select("part", "base_model", "is_cal", "g_mean").distinct()
        b = (self.cells.select("base_model", "scheme", "band").join(self.centres, ["base_model", "scheme"])
                 .join(scheme, fold, "left").join(strata, [*fold, "band"], "left").join(self.pooled(stage(unseen), "g_hw"), ["part", "base_model"], "left"))
        base = F.when(F.col("s_mean").isNotNull(), F.col("s_hw")).otherwise(F.col("g_hw"))
        wide = F.coalesce(F.col("t_hw") > base, F.lit(False))
        b = b.select("part", "base_model", "scheme", "band", F.coalesce("s_mean", "g_mean").alias("yhat"),
                     F.when(wide, F.col("t_hw")).otherwise(base).alias("half_width"), wide.alias("widened"))
        return stage(b.withColumns({"lo": F.col("yhat") - F.col("half_width"), "hi": F.col("yhat") + F.col("half_width")}))

    def mondrian_bands(self) -> DataFrame:
        """(part, base_model, scheme, yhat, q, backed_off): treatment means and per-treatment quantiles."""
        asked = stage(self.centres.withColumn("centre", F.coalesce("s_mean", "g_mean")))
        fold = ["part", "base_model", "scheme"]
        own = stage(asked.join(self.quantiles(asked, ["scheme"], "q_g"), fold, "left").withColumn("q_g", F.coalesce("q_g", F.lit(INF))))
        back = ~finite("q_g")
        few = stage(own.where(back).select("part", "base_model", "is_cal", "g_mean").distinct())
        b = own.join(self.pooled(few, "q_m"), ["part", "base_model"], "left")
        return stage(b.select(*fold, F.col("centre").alias("yhat"), F.when(back, F.col("q_m")).otherwise(F.col("q_g")).alias("q"), back.alias("backed_off")))


def packed_bands(bands: DataFrame) -> DataFrame:
    """(base_model, scheme, band, bands): the bands of all partitions in one map, so that a row meets them in
    one join and is scored under every partition without being copied."""
    entry = F.struct("part", F.struct("lo", "hi", "half_width", "widened").alias("band_"))
    return bands.groupBy("base_model", "scheme", "band").agg(F.map_from_entries(F.collect_list(entry)).alias("bands"))


# ------------------------------------------------------------------ jackknife+


def jackknife_plus(df: DataFrame, alpha=ALPHA, min_clusters=MIN_CAL_ROWS) -> DataFrame:
    """(base_model, scheme, lo, hi, unit): jackknife+ bounds for every left-out cluster.

    For a left-out cluster t every other cluster i adds its rows as centre -/+ distance, the centre being the
    treatment mean without t and i: lists shifted by a little, different for each pair. Their k-th smallest
    is bracketed by the same order statistic with all centres moved to the lowest and to the highest they can
    have, which needs only the treatment's histogram; just the rows whose terms can fall between the two are
    then compared with the pair's own centre. A treatment with fewer than nine other clusters uses the terms
    of all treatments. The rows between the brackets are few unless one cluster holds a large share of its
    treatment, which widens them.
    """
    rows = stage(df.groupBy("base_model", "scheme", "delta").agg(F.count("*").alias("n")))
    sums = stage(rows.groupBy("base_model", "scheme").agg(F.sum(F.col("delta") * F.col("n")).alias("s"), F.sum("n").alias("n")))
    per = sums.groupBy("scheme").agg(F.sum("s").alias("all_s"), F.sum("n").alias("all_n"), F.count("*").alias("all_k"))
    whole = sums.groupBy("base_model").agg(F.sum("s").alias("t_s"), F.sum("n").alias("t_n"))
    total = whole.agg(F.sum("t_s").alias("whole_s"), F.sum("t_n").alias("whole_n")).first()
    # how far leaving out any one more cluster can move a treatment's mean
    mean = F.col("all_s") / F.col("all_n")
    reach = (sums.join(per, "scheme").groupBy("scheme").agg(F.max("n").alias("most"), F.max(F.abs(F.col("s") - mean * F.col("n"))).alias("pull")))
    per = stage(per.join(reach, "scheme"))
    chunks = max(1, -(-whole.count() // CHUNK))

    kinds = sums.join(per.select("scheme", "all_k"), "scheme").select("base_model", "scheme", (F.col("all_k") - 1 >= min_clusters).alias("alone"))
    kinds = stage(kinds.withColumn("unit", F.when(F.col("alone"), F.col("scheme")).otherwise("*")))
    folds = kinds.select("base_model", "unit").distinct()
    lists = stage(per.select("scheme", F.explode(F.array("scheme", F.lit("*"))).alias("unit")).join(kinds.select("unit").distinct(), "unit", "left_semi"))

    # one request per fold and list: the sums without the fold, and its own histogram
    own = _arrays(rows, "base_model", "scheme")
    asked = (folds.join(lists, "unit").join(per, "scheme").join(whole, "base_model")
                  .join(sums.select("base_model", "scheme", F.col("s").alias("own_s"), F.col("n").alias("own_c")), ["base_model", "scheme"], "left")
                  .join(own, ["base_model", "scheme"], "left"))
    zero = lambda c, kind: F.coalesce(c, F.lit(0).cast(kind))
    a, b = F.col("all_s") - zero("own_s", "double"), F.col("all_n") - zero("own_c", "long")
    asked = asked.select("unit", "base_model", "scheme", a.alias("a"), b.alias("b"), "most", "pull", "all_s", "all_n",
                         (F.lit(total["whole_s"]) - F.col("t_s")).alias("g_a"), (F.lit(total["whole_n"]) - F.col("t_n")).alias("g_b"),
                         F.coalesce("own_delta", F.array().cast("array<double>")).alias("own_delta"), F.coalesce("own_n", F.array().cast("array<long>")).alias("own_n"))
    asked = stage(asked.withColumn("chunk", F.pmod(F.hash("base_model"), F.lit(chunks))))
    hist = rows.groupBy("scheme", "delta").agg(F.sum("n").alias("n")).join(lists, "scheme")
    hist = hist.select("*", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"))
    out = "unit string, base_model string, scheme string, side string, below long, rank long, x0 double, x1 double, c0 double, c1 double"
    marks = stage(hist.groupBy("unit", "chunk").cogroup(asked.groupBy("unit", "chunk")).applyInPandas(_brackets(alpha), out))

    # rows whose term may lie between a treatment's outermost brackets, seen from either side
    span = marks.groupBy("unit", "scheme", "side").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("c0").alias("c0"), F.max("c1").alias("c1"))
    d = F.col("delta")
    direct, mirrored = d.between(F.col("x0") - NEAR, F.col("x1") + NEAR), d.between(2 * F.col("c0") - F.col("x1") - NEAR, 2 * F.col("c1") - F.col("x0") + NEAR)
    near = rows.join(span, "scheme").where(direct | mirrored).select("unit", "side", "scheme", "base_model", "delta", "n")
    near = near.join(sums.select("base_model", "scheme", "s", F.col("n").alias("c")), ["base_model", "scheme"]).join(whole, "base_model")
    near = near.select("*", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"))
    last = stage(marks.join(asked.select("unit", "base_model", "scheme", "a", "b", "g_a", "g_b", "chunk"), ["unit", "base_model", "scheme"]))
    found = near.groupBy("unit", "side", "chunk").cogroup(last.groupBy("unit", "side", "chunk")).applyInPandas(_between, "unit string, base_model string, side string, value double")
    found = stage(found.groupBy("unit", "base_model").agg(F.max(F.when(F.col("side") == "lo", F.col("value"))).alias("lo"), F.max(F.when(F.col("side") == "hi", F.col("value"))).alias("hi")))
    return kinds.join(found, ["unit", "base_model"]).select("base_model", "scheme", "lo", "hi", F.when(F.col("alone"), "scheme").otherwise("pooled").alias("unit"))


def _ranks(alpha, n):
    return {"lo": max(int(np.floor(alpha * (n + 1))), 1), "hi": min(int(np.ceil((1 - alpha) * (n + 1))), n)}


def _brackets(alpha):
    """Per fold and side: the bracket of the wanted order statistic, and per treatment the range of centres and
    the rows that are surely below the bracket."""
    def one(lists, centres, side):
        """A function that counts the terms up to x of all lists, the centres given."""
        sign = 1 if side == "lo" else -1  # the upper terms are the lower ones of the mirrored values

        def count(x, strict=False):
            total = 0
            for (values, cum, own, own_cum), c in zip(lists, centres):
                for v, k, way in ((values, cum, 1), (own, own_cum, -1)):
                    n = k[-1]
                    edge = "left" if strict else "right"
                    if sign > 0:  # min(d, 2c - d) <= x
                        part = n if (c < x if strict else c <= x) else k[np.searchsorted(v, x, edge)] + n - k[np.searchsorted(v, 2 * c - x, "right" if strict else "left")]
                    else:  # max(d, 2c - d) <= x: both d and its mirror image are
                        part = 0 if (c >= x if strict else c > x) else k[np.searchsorted(v, x, edge)] - k[np.searchsorted(v, 2 * c - x, "right" if strict else "left")]
                    total += way * max(int(part), 0)
            return total
        return count

    def bracket(key, hist, asked):
        unit = key[0]
        tables = {s: (g["delta"].to_numpy(np.float64), _cumulative(g["n"].to_numpy(np.int64))) for s, g in hist.sort_values("delta").groupby("scheme")}
        out = []
        for base_model, g in asked.groupby("base_model"):
            lists, low, high, names, n = [], [], [], [], 0
            for r in g.itertuples():
                values, cum = tables[r.scheme]
                own_cum = _cumulative(r.own_n)
                if cum[-1] == own_cum[-1]:
                    continue
                mean = r.a / r.b
                spare = r.b - r.most
                if spare > 0:
                    e = (r.pull + r.most * abs(mean - r.all_s / r.all_n)) / spare
                    c0, c1 = mean - e, mean + e
                else:  # one more cluster may be all there is: its centre is then the mean of everything
                    c0, c1 = -400.0, 400.0
                lists.append((values, cum, np.asarray(r.own_delta, np.float64), own_cum))
                low.append(c0), high.append(c1), names.append(r.scheme)
                n += int(cum[-1] - own_cum[-1])
            if not n:
                continue
            for side, k in _ranks(alpha, n).items():
                ends = []
                for centres in (low, high):
                    count, a, b = one(lists, centres, side), -1000.0, 1000.0
                    for _ in range(60):
                        mid = (a + b) / 2
                        a, b = (a, mid) if count(mid) >= k else (mid, b)
                    ends.append((a, b))
                x0, x1 = ends[0][0] - NEAR, ends[1][1] + NEAR
                for piece, c0, c1, name in zip(lists, low, high, names):
                    # surely below: still below with the centre at its highest
                    out.append((unit, base_model, name, side, one([piece], [c1], side)(x0, True), k, x0, x1, c0, c1))
        return pd.DataFrame(out, columns=["unit", "base_model", "scheme", "side", "below", "rank", "x0", "x1", "c0", "c1"]).astype({c: object for c in ("unit", "base_model", "scheme", "side")})

    return bracket


def _between(key, near, marks):
    """The order statistic of every fold, from the rows that may lie in its bracket."""
    unit, side, _ = key
    tables = {s: g.sort_values("delta") for s, g in near.groupby("scheme")}
    out = []
    for base_model, g in marks.groupby("base_model"):
        terms, counts, below = [], [], 0
        for r in g.itertuples():
            table = tables.get(r.scheme)
            below += r.below
            if table is None:
                continue
            values = table["delta"].to_numpy(np.float64)
            a, b = np.searchsorted(values, [r.x0 - NEAR, 2 * r.c0 - r.x1 - NEAR]), np.searchsorted(values, [r.x1 + NEAR, 2 * r.c1 - r.x0 + NEAR], "right")
            at = np.union1d(np.arange(a[0], b[0]), np.arange(a[1], b[1]))
            t = table.iloc[at]
            t = t[t["base_model"] != base_model]
            rest = r.b - t["c"].to_numpy()
            centre = np.where(rest > 0, (r.a - t["s"].to_numpy()) / np.where(rest > 0, rest, 1), (r.g_a - t["t_s"].to_numpy()) / np.maximum(r.g_b - t["t_n"].to_numpy(), 1))
            d = t["delta"].to_numpy()
            term = np.minimum(d, 2 * centre - d) if side == "lo" else np.maximum(d, 2 * centre - d)
            # the same rows as those counted below the bracket are left out here
            high = np.minimum(d, 2 * r.c1 - d) if side == "lo" else np.maximum(d, 2 * r.c1 - d)
            kept = high >= r.x0
            terms.append(term[kept]), counts.append(t["n"].to_numpy()[kept])
        if not terms:
            continue
        terms, counts = np.concatenate(terms), np.concatenate(counts)
        order = np.argsort(terms)
        k = int(g["rank"].iloc[0]) - below
        at = min(int(np.searchsorted(np.cumsum(counts[order]), max(k, 1))), len(order) - 1)
        out.append((unit, base_model, side, float(terms[order][at])))
    return pd.DataFrame(out, columns=["unit", "base_model", "side", "value"]).astype({c: object for c in ("unit", "base_model", "side")})
