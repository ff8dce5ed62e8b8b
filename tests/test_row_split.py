import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pairmeter.operators import row_split as RS


def plain(d, seeds, alpha=0.1):
    """Every split carried out on its own rows."""
    role, out = RS.roles(d.h.to_numpy(), seeds), []
    for s in range(seeds):
        train, cal, test = (d[role[:, s] == k] for k in (RS.TRAIN, RS.CAL, RS.TEST))
        means = train.groupby("scheme").delta.mean()
        centre = lambda x: x.scheme.map(means).fillna(train.delta.mean())
        resid = (cal.delta - centre(cal)).abs()
        kth = lambda r: math.inf if (k := math.ceil((len(r) + 1) * (1 - alpha))) > len(r) else np.sort(r)[k - 1]
        pooled = kth(resid)
        q = {t: kth(resid[cal.scheme == t]) for t in d.scheme.unique()}
        half = test.scheme.map(lambda t: q[t] if math.isfinite(q[t]) else pooled)
        out.append(test.assign(seed=s, y=centre(test), half=half, back=[not math.isfinite(q[t]) for t in test.scheme]))
    return pd.concat(out)


def test_all_seeds_at_once_equal_one_by_one(spark):
    rng = np.random.default_rng(1)
    d = pd.DataFrame({"scheme": rng.choice(["a", "b", "rare"], 900, p=[0.6, 0.39, 0.01]), "delta": np.round(rng.normal(0, 2, 900), 4)})
    df = spark.createDataFrame(d.assign(row=np.arange(900))).withColumn("h", RS.role_hash(F.col("row"))).select("scheme", "delta", "h").repartition(3)
    got = RS.RowSplit(df, 12).evaluate().first()
    want = plain(df.toPandas(), 12)
    inside = (want.delta >= want.y - want.half) & (want.delta <= want.y + want.half)
    err = want.delta - want.y
    assert got.n_rows == len(want) and got.n_folds == 12
    assert got.coverage == pytest.approx(inside.mean()) and got.mae == pytest.approx(err.abs().mean()) and got.rmse == pytest.approx(math.sqrt((err**2).mean()))
    assert got.mean_half_width == pytest.approx(want.half.mean()) and got.median_half_width == pytest.approx(want.half.median())
    assert want.back.any() and got.share_backoff == pytest.approx(want.back.mean()) and got.share_infinite == 0
    assert got.r2 == pytest.approx(1 - (err**2).sum() / (want.delta.var(ddof=0) * len(want)))
    per = inside.groupby(want.seed).mean()
    assert got.worst_fold_coverage == pytest.approx(per.min()) and got.mean_per_fold_coverage == pytest.approx(per.mean())


def test_roles_have_their_shares_and_differ_between_seeds():
    h = np.random.default_rng(0).integers(0, 1 << 60, 20_000)
    r = RS.roles(h, 30)
    for kind, share in ((RS.TRAIN, 0.5), (RS.CAL, 0.3), (RS.TEST, 0.2)):
        assert np.abs((r == kind).mean(axis=0) - share).max() < 0.02
    assert np.abs(np.corrcoef((r == RS.TRAIN).T) - np.eye(30)).max() < 0.05
