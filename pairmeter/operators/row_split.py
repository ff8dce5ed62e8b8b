"""The row-split protocol under many seeds at once.

A row is dealt to train, calibration or test by its own hash, anew for every seed. Rows are not copied per
seed: a batch makes the matrix of its roles (rows x seeds) from two halves of one hash and adds up what a
pass needs per (seed, treatment), so that only sums, bucket counts and the rows of one bucket leave a task.
Four passes: train means; calibration distances counted per bucket, which names the bucket of the wanted
rank; the distances inside it; the test rows scored.
"""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from pairmeter.functions.exprs import md5_int
from pairmeter.operators.conformal import ALPHA
from pairmeter.operators.order_stats import INF, conformal_rank, percentile_refined, with_ranks
from pairmeter.plans.staging import stage

TRAIN, CAL, TEST = 0, 1, 2
#: Prime and share of buckets of the role of (row, seed): below 5 of 10 train, below 8 calibration.
PRIME = 1_000_003
WIDTH, BUCKETS = 0.05, 8_000


def role_hash(row_id: Column) -> Column:
    """60 bits of the MD5 of a row's key; its halves h1, h2 give the bucket (h1 + seed h2) mod p mod 10."""
    return md5_int(row_id)


def roles(h: np.ndarray, seeds: int) -> np.ndarray:
    """(rows, seeds) roles."""
    bucket = ((h >> 30)[:, None] + np.arange(seeds)[None, :] * (h & ((1 << 30) - 1))[:, None]) % PRIME % 10
    return np.where(bucket < 5, TRAIN, np.where(bucket < 8, CAL, TEST)).astype(np.int8)


class RowSplit:
    """``rows(scheme, delta, h)`` split 50/30/20 under every seed; ``bands`` holds the treatment means and
    Mondrian quantiles of each, ``evaluate`` the quality of the intervals."""

    def __init__(self, rows: DataFrame, seeds: int, alpha=ALPHA):
        self.rows, self.seeds, self.alpha = stage(rows), seeds, alpha
        # the treatments are named by the grouping itself; there are as many as result rows
        self.schemes = [r[0] for r in self.rows.select("scheme").distinct().orderBy("scheme").collect()]
        means = self._sums()
        self.mean = {(r["seed"], r["scheme"]): r["mean"] for r in means}
        self.centre = np.array([[self.mean.get((s, t), self.mean.get((s, "*"), np.nan)) for t in self.schemes] for s in range(seeds)])
        self.bands = stage(self._bands())

    def _pass(self, work, schema):
        schemes = {t: i for i, t in enumerate(self.schemes)}
        seeds = self.seeds

        def run(frames):
            state = None
            for f in frames:
                for at in range(0, len(f), 2_000):
                    part = f.iloc[at:at + 2_000]
                    which = part["scheme"].map(schemes).to_numpy(np.int64)
                    state = work(state, which, part["delta"].to_numpy(np.float64), roles(part["h"].to_numpy(np.int64), seeds))
                    if isinstance(state, pd.DataFrame):
                        yield state
                        state = None
            if state is not None:
                yield from state[0](state[1])

        return self.rows.mapInPandas(run, schema)

    def _sums(self):
        n_schemes, seeds = len(self.schemes), self.seeds

        def out(total):
            i, s = np.nonzero(total[1])
            yield pd.DataFrame({"i": i, "seed": s, "s": total[0][i, s], "n": total[1][i, s].astype(np.int64)})

        def add(state, which, delta, role):
            total = state[1] if state else np.zeros((2, n_schemes, seeds))
            hot = np.zeros((n_schemes, len(which)))
            hot[which, np.arange(len(which))] = 1
            train = (role == TRAIN).astype(np.float64)
            total[0] += (hot * delta) @ train
            total[1] += hot @ train
            return out, total

        sums = self._pass(add, "i long, seed long, s double, n long").groupBy("i", "seed").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
        names = F.element_at(F.array(*[F.lit(t) for t in self.schemes]), (F.col("i") + 1).cast("int")) if self.schemes else F.lit("*")
        each = F.explode(F.array(names, F.lit("*")))
        t = sums.select("seed", "s", "n", each.alias("scheme")).groupBy("seed", "scheme").agg((F.sum("s") / F.sum("n")).alias("mean"))
        return t.collect()  # seeds x treatments

    def _bands(self) -> DataFrame:
        n_schemes, seeds, centre = len(self.schemes), self.seeds, self.centre
        n_all = n_schemes + 1  # the last one pools all treatments

        def out(counts):
            at = np.flatnonzero(counts)
            yield pd.DataFrame({"seed": at // (n_all * BUCKETS), "i": at // BUCKETS % n_all, "b": at % BUCKETS, "c": counts[at]})

        def flat(which, delta, role):
            row, seed = np.nonzero(role == CAL)
            i = which[row]
            return seed, i, np.abs(delta[row] - centre[seed, i])

        def count(state, which, delta, role):
            total = state[1] if state else np.zeros(seeds * n_all * BUCKETS, np.int64)
            seed, i, resid = flat(which, delta, role)
            b = np.minimum(np.floor(resid / WIDTH).astype(np.int64), BUCKETS - 1)
            for kind in (i, np.full(len(i), n_schemes)):
                key, n = np.unique((seed * n_all + kind) * BUCKETS + b, return_counts=True)
                total[key] += n
            return out, total

        coarse = self._pass(count, "seed long, i long, b long, c long").groupBy("seed", "i", "b").agg(F.sum("c").alias("c"))
        w = Window.partitionBy("seed", "i")
        coarse = coarse.withColumns({"cum": F.sum("c").over(w.orderBy("b").rowsBetween(Window.unboundedPreceding, 0)), "tot": F.sum("c").over(w)})
        k = conformal_rank(F.col("tot"), self.alpha)
        hit = F.min(F.when(F.col("cum") >= k, F.struct("b", (k - F.col("cum") + F.col("c")).alias("need"))))
        target = stage(coarse.groupBy("seed", "i").agg(F.max("tot").alias("n_cal"), hit.alias("t")).select("seed", "i", "n_cal", "t.b", "t.need"))
        wanted = np.full((seeds, n_all), -1, np.int64)
        for r in target.where("b is not null").collect():  # seeds x treatments
            wanted[r["seed"], r["i"]] = r["b"]

        def pick(state, which, delta, role):
            seed, i, resid = flat(which, delta, role)
            b = np.minimum(np.floor(resid / WIDTH).astype(np.int64), BUCKETS - 1)
            own, pooled = wanted[seed, i] == b, wanted[seed, n_schemes] == b
            f = pd.DataFrame({"seed": np.concatenate([seed[own], seed[pooled]]), "i": np.concatenate([i[own], np.full(int(pooled.sum()), n_schemes)]),
                              "resid": np.concatenate([resid[own], resid[pooled]])})
            return f if len(f) else None

        near = self._pass(pick, "seed long, i long, resid double").groupBy("seed", "i", "resid").agg(F.count("*").alias("n"))
        fine = with_ranks(near, ["seed", "i"], "resid").join(target, ["seed", "i"])
        q = fine.groupBy("seed", "i").agg(F.min(F.when(F.col("cum") >= F.col("need"), F.col("resid"))).alias("q"))
        return target.select("seed", "i").join(q, ["seed", "i"], "left").withColumn("q", F.coalesce("q", F.lit(INF)))

    def evaluate(self) -> DataFrame:
        """One row: the columns of ``folds.evaluate`` over all seeds."""
        n_schemes, seeds, centre = len(self.schemes), self.seeds, self.centre
        q = np.full((seeds, n_schemes + 1), np.inf)
        for r in self.bands.collect():  # seeds x treatments
            q[r["seed"], r["i"]] = r["q"]
        back = ~np.isfinite(q[:, :n_schemes])
        half = np.where(back, q[:, n_schemes:], q[:, :n_schemes])
        names = ["covered", "abs_err", "sq_err", "d", "dd", "out"]

        def out(total):
            s, i = np.nonzero(total[0])
            yield pd.DataFrame({"seed": s, "i": i, "n": total[0][s, i].astype(np.int64), **{c: total[j + 1][s, i] for j, c in enumerate(names)},
                                "half_width": half[s, i], "backed_off": back[s, i]})

        def score(state, which, delta, role):
            total = state[1] if state else np.zeros((7, seeds, n_schemes))
            row, seed = np.nonzero(role == TEST)
            i, d = which[row], delta[row]
            c, h = centre[seed, i], half[seed, i]
            lo, hi = c - h, c + h
            e = d - c
            key = seed * n_schemes + i
            for j, v in enumerate((None, (d >= lo) & (d <= hi), np.abs(e), e * e, d, d * d, (lo > 0) | (hi < 0))):
                total[j] += np.bincount(key, None if v is None else v.astype(np.float64), seeds * n_schemes).reshape(seeds, n_schemes)
            return out, total

        schema = "seed long, i long, n long, " + ", ".join(f"{c} double" for c in names) + ", half_width double, backed_off boolean"
        t = stage(self._pass(score, schema).groupBy("seed", "i", "half_width", "backed_off").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in names]))
        n, fin = F.sum("n"), F.abs("half_width") < INF
        whole = t.agg(n.alias("n_rows"), (F.sum("covered") / n).alias("coverage"),
                      (F.sum(F.when(fin, F.col("half_width") * F.col("n"))) / F.sum(F.when(fin, F.col("n")))).alias("mean_half_width"),
                      (F.sum("abs_err") / n).alias("mae"), F.sqrt(F.sum("sq_err") / n).alias("rmse"),
                      (1 - F.sum("sq_err") / (F.sum("dd") - F.pow(F.sum("d"), 2) / n)).alias("r2"), (F.sum("out") / n).alias("share_excluding_zero"),
                      (F.sum(F.when(~fin, F.col("n")).otherwise(0)) / n).alias("share_infinite"),
                      (F.sum(F.when(F.col("backed_off"), F.col("n")).otherwise(0)) / n).alias("share_backoff"))
        fold = t.groupBy(F.col("seed").cast("string").alias("fold")).agg((F.sum("covered") / n).alias("c"))
        folds = fold.agg(F.count("*").alias("n_folds"), F.avg("c").alias("mean_per_fold_coverage"), F.min("c").alias("worst_fold_coverage"),
                         F.min_by("fold", F.struct("c", "fold")).alias("worst_fold"))
        one = F.lit(1).alias("_one")
        median = percentile_refined(t.where(fin).select(one, "half_width", "n"), ["_one"], "half_width", 0.5, name="median_half_width")
        return whole.select("*", one).join(folds.select("*", one), "_one").join(median, "_one", "left").drop("_one")
