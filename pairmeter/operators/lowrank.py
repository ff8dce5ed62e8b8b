"""Low-rank structure of the (row, task) score matrix, kept in long form until a fixed task
vocabulary makes it wide."""

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from pairmeter.functions.exprs import md5_int
from pairmeter.plans.staging import stage


def score_matrix(df: DataFrame) -> DataFrame:
    """Long matrix: base rows hold mean before-scores, treated rows mean after-scores."""
    base = df.groupBy("base_model", "benchmark").agg(F.avg("acc_before").alias("score")).select(
        F.concat(F.lit("BASE::"), "base_model").alias("row_key"), "base_model", F.lit(None).cast("string").alias("scheme"), "benchmark", "score")
    treated = df.groupBy("model", "base_model", "scheme", "benchmark").agg(F.avg("acc_after").alias("score")).select(
        F.concat(F.lit("QUANT::"), "model").alias("row_key"), "base_model", "scheme", "benchmark", "score")
    return base.unionByName(treated)


def wide(scores: DataFrame, tasks) -> DataFrame:
    return scores.groupBy("row_key").pivot("benchmark", list(tasks)).agg(F.first("score"))


def complete_subsets(scores: DataFrame, tasks, k) -> DataFrame:
    """Rows observing every task of each k-subset.

    Rows are first reduced to the pattern of tasks they observe; subsets are tested on patterns.
    """
    bit = {t: 1 << i for i, t in enumerate(tasks)}
    flag = F.create_map(*[F.lit(x) for kv in bit.items() for x in kv])
    mask = scores.groupBy("row_key").agg(F.bit_or(F.try_element_at(flag, F.col("benchmark"))).alias("mask"))
    patterns = mask.groupBy("mask").agg(F.count("*").alias("n"))
    subsets = F.array(*[F.struct(F.lit("+".join(c)).alias("tasks"), F.lit(sum(bit[t] for t in c)).alias("need")) for c in combinations(tasks, k)])
    t = patterns.select("mask", "n", F.explode(subsets).alias("c"))
    return t.where(F.col("mask").bitwiseAND(F.col("c.need")) == F.col("c.need")).groupBy("c.tasks").agg(F.sum("n").alias("n_rows"))


def pairwise_correlations(scores: DataFrame, tasks, min_overlap=8) -> DataFrame:
    """(a, b, r, overlap) over pairwise-complete rows. One aggregate on the wide matrix: corr
    ignores a row where either side is null, so no pair of rows or cells is emitted."""
    w = wide(scores, tasks)
    col = lambda t: F.col(f"`{t}`")
    aggs = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(col(a), col(b)).alias("r"),
                     F.count(F.when(col(a).isNotNull() & col(b).isNotNull(), 1)).alias("overlap")) for a, b in combinations(tasks, 2)]
    p = w.agg(F.array(*aggs).alias("p")).select(F.explode("p").alias("p")).select("p.*").where(F.col("overlap") >= min_overlap)
    return p.unionByName(p.select(F.col("b").alias("a"), F.col("a").alias("b"), "r", "overlap"))


def best_neighbour(correlations: DataFrame) -> DataFrame:
    return correlations.groupBy("a").agg(F.max_by(F.struct("b", "r", "overlap"), F.struct("r", "b")).alias("x"),
                                         F.avg(F.abs("r")).alias("mean_abs_r")).select(
        F.col("a").alias("task"), F.col("x.b").alias("neighbour"), "x.r", "x.overlap", "mean_abs_r")


def paired_entries(scores: DataFrame) -> DataFrame:
    """Treated entries whose base entry is also observed: (row_key, base_model, scheme, benchmark,
    score, base_score)."""
    base = scores.where("row_key like 'BASE::%'").select("base_model", "benchmark", F.col("score").alias("base_score"))
    return scores.where("row_key like 'QUANT::%'").join(base, ["base_model", "benchmark"])


def reveal(entries: DataFrame, order, k=3) -> DataFrame:
    """Marks k entries per treated row as revealed, in the given order; rows with fewer than k + 2
    entries are left out. A row holds at most one entry per task."""
    w = Window.partitionBy("row_key")
    t = entries.withColumns({"_n": F.count("*").over(w), "_i": F.row_number().over(w.orderBy(order, "benchmark"))})
    return t.where(F.col("_n") >= k + 2).withColumn("revealed", F.col("_i") <= k).drop("_n", "_i")


def scorecard(pred: DataFrame, *keys) -> DataFrame:
    """Quality of predicted deltas (true_delta, pred_delta, scheme_mean, scheme), over all rows or per ``keys``."""
    t, p = F.col("true_delta"), F.col("pred_delta")
    n = lambda c: F.sum(c.cast("long"))
    per = pred.groupBy(*keys, "scheme").agg(F.avg(p).alias("pm"), F.avg(t).alias("tm"))
    spread = per.groupBy(*keys).agg((F.max("pm") - F.min("pm")).alias("pred_spread"), (F.max("tm") - F.min("tm")).alias("true_spread"))
    out = pred.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(F.abs(t - p)).alias("mae"), F.avg(F.abs(t - F.col("scheme_mean"))).alias("mae_scheme_mean"),
        F.avg(F.abs(t)).alias("mae_zero"), F.avg(F.abs(p)).alias("mean_abs_pred"), n(t <= -3).alias("n_severe"),
        n((t <= -3) & (p <= -1.5)).alias("severe_caught"), n((t > -3) & (p <= -1.5)).alias("false_alarms"), F.corr(p, t).alias("corr_pred_true"))
    if keys:
        return out.join(spread, list(keys))
    return out.withColumns({"pred_spread": spread.select("pred_spread").scalar(), "true_spread": spread.select("true_spread").scalar()})


def _moments(y: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """(rows, 3, T, T): pair counts, first and second moments of each row over its seen entries."""
    m = seen.astype(float)
    v = np.where(seen, y, 0.0)
    return np.stack([m[:, :, None] * m[:, None, :], v[:, :, None] * m[:, None, :], v[:, :, None] * v[:, None, :]], axis=1)


def _hidden_scores(total: np.ndarray, y: np.ndarray, seen: np.ndarray, hide: np.ndarray, rank: int) -> np.ndarray:
    """(rows, T): every row predicted from its entries that are not hidden, by the task factors of the
    matrix without that row's hidden entries."""
    left = seen & ~hide
    n, s1, s2 = np.moveaxis(total[None] - _moments(y, seen) + _moments(y, left), 1, 0)
    n_safe = np.maximum(n, 1.0)
    mean = s1 / n_safe
    cov = np.where(n > 1, s2 / n_safe - mean * np.swapaxes(mean, 1, 2), 0.0)
    centre = np.diagonal(mean, axis1=1, axis2=2)
    val, vec = np.linalg.eigh(cov)  # rising
    tasks = y.shape[1]
    rank = min(rank, tasks)
    noise = np.maximum(val[:, :tasks - rank], 0).mean(axis=1) if rank < tasks else np.zeros(len(y))
    noise = noise + 1e-9 * np.maximum(np.trace(cov, axis1=1, axis2=2), 0) + 1e-12
    load = vec[:, :, tasks - rank:] * np.sqrt(np.maximum(val[:, tasks - rank:] - noise[:, None], 0))[:, None, :]
    own = load * left[:, :, None]
    gap = np.where(left, y - centre, 0.0)
    factor = np.linalg.solve(np.swapaxes(own, 1, 2) @ own + noise[:, None, None] * np.eye(rank), np.swapaxes(own, 1, 2) @ gap[:, :, None])
    return centre + (load @ factor)[:, :, 0]


def reveal_order(h: np.ndarray, seed: int) -> np.ndarray:
    """Order keys of entries with 60-bit hashes ``h`` under a seed: (h1 + seed h2) mod p of its halves."""
    return ((h >> 30) + seed * (h & ((1 << 30) - 1))) % 1_000_000_007


def complete_low_rank(scores: DataFrame, tasks, rank=2, k=3, seeds=5) -> DataFrame:
    """(seed, row_key, scheme, benchmark, score, base_score, pred_score) of hidden entries, one unit hidden at a time.

    Of the entries of a treated row whose base entry is also seen, k are revealed in a hashed order per seed and
    the others hidden; rows with fewer than k + 2 are left out. Rows of the (row, task) matrix are draws of a
    Gaussian factor model whose moments, T x T for T tasks, add up over rows. Those of all rows are summed
    once; the moments without a unit's hidden entries are that sum less the unit's own plus those of its
    seen entries, so every unit has the task factors of exactly the matrix that hides it alone, and its
    factor is solved from what it reveals. Everything per unit happens in a map over rows.

    Tasks outside ``tasks`` are ignored; a missing or null entry is not seen; a pair of tasks that fewer than two
    rows share counts as uncorrelated. An empty matrix gives no rows.
    """
    tasks = list(tasks)
    rows = scores.groupBy("row_key", "base_model", "scheme").pivot("benchmark", tasks).agg(F.first("score"))
    names = [f"t{i}" for i in range(len(tasks))]
    w = stage(rows.select("row_key", "base_model", "scheme", *[F.col(f"`{t}`").cast("double").alias(c) for t, c in zip(tasks, names)]))
    mid = w.agg(*[F.avg(c).alias(c) for c in names]).first()
    shift = np.array([mid[c] or 0.0 for c in names])
    size = len(tasks)
    block = max(1, 400_000 // (size * size))

    def add(frames):
        total = np.zeros((3, size, size))
        for f in frames:
            y = f[names].to_numpy(float) - shift
            for at in range(0, len(y), block):
                total += _moments(y[at:at + block], ~np.isnan(y[at:at + block])).sum(axis=0)
        yield pd.DataFrame({"i": np.arange(total.size), "v": total.ravel()})

    sums = w.select(*names).mapInPandas(add, "i int, v double").groupBy("i").agg(F.sum("v").alias("v"))
    total = np.zeros(3 * size * size)
    for i, v in sums.collect():  # 3 T^2 values
        total[i] = v
    total = total.reshape(3, size, size)

    bases = w.where("row_key like 'BASE::%'").select("base_model", *[F.col(c).alias("b" + c) for c in names])
    marks = F.array(*[md5_int(F.col("row_key"), t) for t in tasks])
    units = w.where("row_key like 'QUANT::%'").join(bases, "base_model").withColumn("_h", marks)

    def fold_in(frames):
        for f in frames:
            for at in range(0, len(f), block):
                part = f.iloc[at:at + block]
                y = part[names].to_numpy(float)
                base = part[["b" + c for c in names]].to_numpy(float)
                seen = ~np.isnan(y)
                paired = seen & ~np.isnan(base)
                h = np.stack(part["_h"].to_numpy()).astype(np.int64)
                for seed in range(seeds):
                    order = np.where(paired, reveal_order(h, seed), np.iinfo(np.int64).max)
                    place = np.argsort(np.argsort(order, axis=1, kind="stable"), axis=1, kind="stable")
                    hide = paired & (place >= k) & (paired.sum(axis=1) >= k + 2)[:, None]
                    pred = _hidden_scores(total, y - shift, seen, hide, rank) + shift
                    r, t = np.nonzero(hide)
                    yield pd.DataFrame({"seed": seed, "row_key": part["row_key"].to_numpy()[r], "scheme": part["scheme"].to_numpy()[r],
                                        "benchmark": np.array(tasks, object)[t], "score": y[r, t], "base_score": base[r, t], "pred_score": pred[r, t]})

    return units.mapInPandas(fold_in, "seed int, row_key string, scheme string, benchmark string, score double, base_score double, pred_score double")


def variance_explained(scores: DataFrame, tasks, k=4, complete_only=False) -> DataFrame:
    """Share of variance in the first components: of the mean-filled standardised matrix, or of the
    fully observed, centred rows only."""
    from pyspark.ml.feature import PCA, VectorAssembler
    w = wide(scores, tasks)
    names = [f"`{t}`" for t in tasks]
    if complete_only:
        w = w.dropna(subset=list(tasks))
    else:
        overall = scores.agg(F.avg("score")).scalar()
        w = w.select("row_key", *[F.coalesce(n, overall).alias(t) for n, t in zip(names, tasks)])
        st = w.agg(*[F.struct(F.avg(n).alias("m"), F.stddev_pop(n).alias("s")).alias(t) for n, t in zip(names, tasks)]).first()
        w = w.select("row_key", *[((F.col(n) - st[t]["m"]) / (st[t]["s"] + 1e-9)).alias(t) for n, t in zip(names, tasks)])
    v = VectorAssembler(inputCols=list(tasks), outputCol="v").transform(w)
    share = PCA(k=min(k, len(tasks)), inputCol="v", outputCol="pc").fit(v).explainedVariance
    from pairmeter.plans.local import constant_table
    total, rows = 0.0, []
    for x in share.toArray():
        total += float(x)
        rows.append(total)
    return constant_table(scores.sparkSession, {"rank": list(range(1, len(rows) + 1)), "cumulative_share": rows})
