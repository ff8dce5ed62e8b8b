"""Point predictors: ridge in closed form from additive Gram matrices, boosted trees by Spark ML.

A Gram matrix is p x p whatever the number of rows, and those of the families add up. One pass over
the rows therefore serves every leave-out fit and every penalty of a grid; only p x p tables, one
per family, reach the driver.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from pairmeter.functions.exprs import md5_int
from pairmeter.plans.staging import stage

# Penalty grid of the nested tuning.
RIDGE_ALPHAS = [0.01, 0.03, 0.1, 0.3, 1, 3, 10, 30, 100, 300, 1000]
# Penalty grid of the grouped selection, and the penalty where nothing can be selected.
SELECT_ALPHAS = [0.3, 1.0, 3.0, 10.0, 30.0, 100.0]
UNSELECTED = 3.0


def gram_by_group(df: DataFrame, features: dict, group="family", target="delta") -> dict:
    """{group: Z'Z} with Z = [1, features, target]."""
    names = list(features)
    p = len(names) + 2

    def partial(batches):
        acc = {}
        for pdf in batches:
            for g, part in pdf.groupby("_g"):
                z = np.column_stack([np.ones(len(part)), part[names + ["_y"]].to_numpy(float)])
                acc[g] = acc.get(g, 0) + z.T @ z
        for g, m in acc.items():
            yield pd.DataFrame({"g": g, "i": np.arange(p * p), "v": m.ravel()})

    d = df.select(F.col(group).alias("_g"), F.col(target).alias("_y"), *[c.cast("double").alias(n) for n, c in features.items()])
    cells = d.mapInPandas(partial, "g string, i int, v double").groupBy("g", "i").agg(F.sum("v").alias("v"))
    out = {}
    for g, i, v in cells.collect():
        out.setdefault(g, np.zeros(p * p))[i] = v
    return {g: m.reshape(p, p) for g, m in out.items()}


def ridge(gram: np.ndarray, alpha: float) -> np.ndarray:
    """[intercept, coefficients] on the original scale of ridge on population-standardised
    features; the intercept is not penalised."""
    n, mean = gram[0, 0], gram[0, 1:] / gram[0, 0]
    cov = gram[1:, 1:] - n * np.outer(mean, mean)
    x, xy = cov[:-1, :-1], cov[:-1, -1]
    sd = np.sqrt(np.maximum(np.diag(x) / n, 0))
    sd[sd < 1e-12] = 1.0
    beta = np.linalg.solve(x / np.outer(sd, sd) + alpha * np.eye(len(sd)), xy / sd) / sd
    return np.concatenate([[mean[-1] - mean[:-1] @ beta], beta])


def fold_errors(df: DataFrame, features: dict, coefs: dict, group="family", target="delta") -> DataFrame:
    """(family, label, n, abs_err): absolute error sums of the coefficient vectors that apply to a
    row's family. ``coefs`` is {family: {label: vector}}."""
    names = list(features)

    def score(batches):
        acc = {}
        for pdf in batches:
            for g, part in pdf.groupby("_g"):
                if g not in coefs:
                    continue
                z = np.column_stack([np.ones(len(part)), part[names].to_numpy(float)])
                y = part["_y"].to_numpy(float)
                for label, b in coefs[g].items():
                    n, e = acc.get((g, label), (0, 0.0))
                    acc[g, label] = (n + len(y), e + float(np.abs(y - z @ b).sum()))
        if acc:
            yield pd.DataFrame([(g, lab, n, e) for (g, lab), (n, e) in acc.items()], columns=["family", "label", "n", "abs_err"])

    d = df.select(F.col(group).alias("_g"), F.col(target).alias("_y"), *[c.cast("double").alias(n) for n, c in features.items()])
    t = d.mapInPandas(score, "family string, label string, n long, abs_err double")
    return t.groupBy("family", "label").agg(F.sum("n").alias("n"), F.sum("abs_err").alias("abs_err"))


def lofo_ridge(df: DataFrame, features: dict, alpha=3.0) -> DataFrame:
    """Leave-one-family-out ridge: MAE per held-out family."""
    grams = gram_by_group(df, features)
    total = sum(grams.values())
    coefs = {f: {"ridge": ridge(total - g, alpha)} for f, g in grams.items()}
    return fold_errors(df, features, coefs).select("family", "n", (F.col("abs_err") / F.col("n")).alias("mae"))


def nested_ridge(df: DataFrame, features: dict, alphas=RIDGE_ALPHAS) -> DataFrame:
    """Nested leave-one-family-out tuning: the penalty of each outer fold is chosen on inner folds
    that never see it (ties to the first of the grid), then scored on the held-out family."""
    grams = gram_by_group(df, features)
    total = sum(grams.values())
    inner = {g: {f"{f}|{i}": ridge(total - grams[f] - grams[g], a) for f in grams if f != g for i, a in enumerate(alphas)} for g in grams}
    err = fold_errors(df, features, inner).withColumns({"outer": F.split("label", r"\|")[0], "i": F.split("label", r"\|")[1].cast("int")})
    # a row per (outer fold, grid point): folds x penalties
    table = err.groupBy("outer", "i").agg((F.sum("abs_err") / F.sum("n")).alias("m")).collect()
    best = {}
    for f, i, m in sorted(table, key=lambda r: (r[0], r[1])):
        if f not in best or m < best[f][0]:
            best[f] = (m, i)
    chosen = {f: {str(i): ridge(total - grams[f], alphas[i])} for f, (_, i) in best.items()}
    t = fold_errors(df, features, chosen)
    pick = F.element_at(F.array(*[F.lit(float(a)) for a in alphas]), F.col("label").cast("int") + 1)
    edge = F.col("label").cast("int").isin(0, len(alphas) - 1)
    return t.select("family", "n", pick.alias("alpha"), edge.alias("at_grid_edge"), (F.col("abs_err") / F.col("n")).alias("mae"))


def grouped_cv_ridge(df: DataFrame, features: dict, alphas=RIDGE_ALPHAS, folds=5, key="base_model", seed=0) -> DataFrame:
    """MAE of every penalty under cross-validation whose folds never split a cluster."""
    d = df.withColumn("_fold", F.pmod(md5_int(seed, F.col(key)), F.lit(folds)).cast("string"))
    grams = gram_by_group(d, features, "_fold")
    total = sum(grams.values())
    coefs = {f: {str(i): ridge(total - g, a) for i, a in enumerate(alphas)} for f, g in grams.items()}
    t = fold_errors(d, features, coefs, "_fold").groupBy(F.col("label").cast("int").alias("i")).agg((F.sum("abs_err") / F.sum("n")).alias("mae"))
    return t.select(F.element_at(F.array(*[F.lit(float(a)) for a in alphas]), F.col("i") + 1).alias("alpha"), "mae")


def select_penalties(df: DataFrame, features: dict, alphas=SELECT_ALPHAS, folds=5, key="base_model", seed=0) -> DataFrame:
    """(family, n, alpha, cv_mae, at_grid_edge, mae): leave-one-family-out ridge, each fit with the penalty
    that grouped cross-validation inside its own training rows selects (ties to the first of the grid).

    Clusters are dealt to the inner folds by hash. Gram sums per (family, inner fold) are a cube, so the rows of
    an inner fit are the total less the left-out family and the left-out fold plus what the two share, and one
    pass scores every inner fit. A family with fewer than two inner folds beside it gets ``UNSELECTED``, with a
    null cv_mae. Rows with a null family belong to no side.
    """
    names, alphas = list(features), [float(a) for a in alphas]
    d = df.where("family is not null").withColumn("_fold", F.pmod(md5_int(seed, F.col(key)), F.lit(folds)).cast("int"))
    d = d.withColumn("_cell", F.concat_ws("|", F.col("_fold").cast("string"), "family"))
    cube = {(int(c.split("|", 1)[0]), c.split("|", 1)[1]): m for c, m in gram_by_group(d, features, "_cell").items()}
    fams = sorted({f for _, f in cube})
    if not fams:
        return df.sparkSession.createDataFrame([], "family string, n long, alpha double, cv_mae double, at_grid_edge boolean, mae double")
    add = lambda want: sum(m for c, m in cube.items() if want(*c))
    total = add(lambda k, f: True)
    by_family = {f: add(lambda _, g, f=f: g == f) for f in fams}
    by_fold = {k: add(lambda j, _, k=k: j == k) for k in sorted({k for k, _ in cube})}
    # (families, penalties, coefficients) of every inner fold; none where no training row is left
    inner = {}
    for k, m in by_fold.items():
        inner[k] = np.full((len(fams), len(alphas), len(names) + 1), np.nan)
        for i, f in enumerate(fams):
            left = total - by_family[f] - m + cube.get((k, f), 0)
            if left[0, 0] > 0.5:
                inner[k][i] = [ridge(left, a) for a in alphas]

    def score(batches):
        err, n = np.zeros((len(fams), len(alphas))), np.zeros(len(fams), np.int64)
        at = {f: i for i, f in enumerate(fams)}
        for pdf in batches:
            for (k, g), part in pdf.groupby(["_k", "_g"]):
                z = np.column_stack([np.ones(len(part)), part[names].to_numpy(float)])
                ok = ~np.isnan(inner[k][:, 0, 0])
                ok[at[g]] = False
                for i in np.flatnonzero(ok):
                    err[i] += np.abs(part["_y"].to_numpy(float)[:, None] - z @ inner[k][i].T).sum(axis=0)
                    n[i] += len(part)
        i, j = np.nonzero(np.broadcast_to(n[:, None] > 0, err.shape))
        yield pd.DataFrame({"i": i, "j": j, "err": err[i, j], "n": n[i]})

    rows = d.select(F.col("family").alias("_g"), F.col("_fold").alias("_k"), F.col("delta").alias("_y"), *[c.cast("double").alias(n) for n, c in features.items()])
    cv = rows.mapInPandas(score, "i int, j int, err double, n long").groupBy("i", "j").agg((F.sum("err") / F.sum("n")).alias("m"))
    best = {}
    for i, j, m in sorted(cv.collect()):  # families x penalties
        if i not in best or m < best[i][0]:
            best[i] = (m, j)
    chosen, coefs = [], {}
    for i, f in enumerate(fams):
        m, j = best.get(i, (None, None))
        alpha = UNSELECTED if j is None else alphas[j]
        chosen.append((f, alpha, m, j in (0, len(alphas) - 1)))
        if (total - by_family[f])[0, 0] > 0.5:
            coefs[f] = {"chosen": ridge(total - by_family[f], alpha)}
    t = df.sparkSession.createDataFrame(chosen, "family string, alpha double, cv_mae double, at_grid_edge boolean")
    return fold_errors(d, features, coefs).join(t, "family").select("family", "n", "alpha", "cv_mae", "at_grid_edge", (F.col("abs_err") / F.col("n")).alias("mae"))


def ridge_pipeline(df: DataFrame, features: dict, alpha=3.0, target="delta"):
    """The same ridge by Spark ML: (fitted model, scaled frame). Spark divides the penalty by the
    label's population deviation, hence regParam = alpha * stddev_pop(y) / n."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression
    raw = df.select(F.col(target).alias("label"), *[c.cast("double").alias(f"f{i}") for i, c in enumerate(features.values())])
    names = raw.columns[1:]
    st = raw.agg(F.count("*").alias("n"), F.stddev_pop("label").alias("sy"),
                 *[F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")).alias(c) for c in names]).first()
    z = raw.select("label", *[((F.col(c) - st[c]["m"]) / (st[c]["s"] or 1.0)).alias(c) for c in names])
    v = VectorAssembler(inputCols=names, outputCol="features").transform(z)
    lr = LinearRegression(elasticNetParam=0.0, standardization=False, solver="normal", regParam=alpha * st["sy"] / st["n"])
    return lr.fit(v), v


def lofo_boosting(df: DataFrame, features: dict, families, depth=3, iters=300, rate=0.05, target="delta") -> DataFrame:
    """Leave-one-family-out gradient boosting; one distributed fit per held-out family.

    Rows with equal features are one row of their mean label and their number: a tree's squared loss depends on
    the sums only, so the rounds work on the distinct feature vectors. All rows are scored.
    """
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor
    raw = df.select("family", F.col(target).alias("label"), *[c.cast("double").alias(f"f{i}") for i, c in enumerate(features.values())])
    assembled = VectorAssembler(inputCols=raw.columns[2:], outputCol="features")
    v = assembled.transform(raw).select("family", "label", "features")
    mean = raw.groupBy("family", *raw.columns[2:]).agg(F.avg("label").alias("label"), F.count("label").cast("double").alias("n"))
    train = stage(assembled.transform(mean).select("family", "label", "features", "n"))
    out = None
    # one fit per key is the protocol: the keys name the fits and are all the driver holds
    for f in sorted(r[0] for r in families.select("family").distinct().collect()):
        m = GBTRegressor(maxDepth=depth, maxIter=iters, stepSize=rate, seed=0, weightCol="n").fit(train.where(F.col("family") != f))
        t = m.transform(v.where(F.col("family") == f)).select("family", F.abs(F.col("label") - F.col("prediction")).alias("e"))
        out = t if out is None else out.unionByName(t)
    return out.groupBy("family").agg(F.count("*").alias("n"), F.avg("e").alias("mae"))
