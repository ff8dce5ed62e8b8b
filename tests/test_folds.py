"""Family folds by what they hold out: brute force, exact differences, many families."""

import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pairmeter.operators import folds as E


def _rows(spark, n_fam=7, n=1500, seed=5):
    rng = np.random.default_rng(seed)
    fam = np.array([f"f{i}" for i in range(n_fam)])[np.minimum(rng.geometric(0.25, n) - 1, n_fam - 1)]
    d = pd.DataFrame({"family": fam, "base_model": [f"{f}-{k}" for f, k in zip(fam, rng.integers(0, 9, n))],
                      "scheme": rng.choice(["a", "b", "c"], n, p=[0.6, 0.35, 0.05]), "band": rng.choice(["s", "l"], n),
                      "delta": np.round(rng.normal(size=n) * 3, 4)})
    return d, spark.createDataFrame(d)


def test_train_sums_are_those_of_the_families_not_named(spark):
    d, t = _rows(spark)
    t = t.unionByName(t.limit(1).withColumn("family", F.lit(None).cast("string"))).unionByName(t.limit(1).withColumn("family", F.lit("stranger")))
    fams = sorted(d.family.unique())
    for n_cal in (1, 2):
        folds = E.held_out(spark, fams, n_cal)
        cells = E.of_families(E.family_cells(t.withColumn("n", F.lit(1)), "scheme"), folds)
        got = {(r.fold, r.scheme): (float(r.s), r.n) for r in E.train_sums(cells, folds, ("scheme",)).collect()}
        want = {}
        for f in fams:
            for cal in itertools.combinations([x for x in fams if x != f], n_cal):
                named = {f, *cal}
                part = d[~d.family.isin(named)]
                for s in d[d.family.isin(named)].scheme.unique():
                    x = part[part.scheme == s].delta
                    if len(x):
                        want[f"{f}|{'+'.join(cal)}", s] = (pytest.approx(x.sum(), abs=1e-9), len(x))
        assert got == want
        every = {r.fold: r.n for r in E.train_sums(cells, folds, measures=("n",)).collect()}
        assert every == {f.fold: len(d) - d.family.isin({f.test_family, *f.cal_family.split("+")}).sum()
                         for f in folds.where("role = 'test'").collect()}


def test_held_out_rows_are_the_named_rows_of_the_whole_folds(spark):
    rows = lambda t: sorted(tuple(r) for r in t.collect())
    for fams, n_cal in ((["b", "a", "c", "d"], 1), (["b", "a", "c", "d"], 2), (["a"], 1), (["a", "b"], 2), ([None, "x", "y", "x"], 1)):
        fams = spark.createDataFrame([(f,) for f in fams], "family string")
        assert rows(E.held_out(spark, fams, n_cal)) == rows(E.family_folds(spark, fams, n_cal).where("role <> 'train'"))


def test_no_fold_pairs_families_by_a_nested_loop(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(E, "stage", lambda t: plans.append(t._jdf.queryExecution().toString()) or t)
    keys = spark.range(1000).select(F.format_string("f%04d", "id").alias("family"))
    folds = E.held_out(spark, keys)
    n = folds.groupBy("role").agg(F.count("*").alias("n"), F.countDistinct("fold").alias("f")).collect()
    assert {(r.role, r.n, r.f) for r in n} == {(role, 999_000, 999_000) for role in ("test", "cal")}
    assert not any(j in p for p in plans for j in ("NestedLoop", "CartesianProduct", "CrossJoin"))


def test_widen_bands_match_a_fold_by_fold_fit(spark):
    """Centres, the in-sample fallback of treatments with few calibration rows, and the widened bands."""
    from pairmeter.operators.conformal import MIN_CAL_ROWS, MIN_CLUSTERS, MIN_ROWS
    d, t = _rows(spark, n=2500, seed=8)
    q = lambda r: np.sort(r)[k - 1] if (k := int(np.ceil((len(r) + 1) * 0.9 - 1e-12))) <= len(r) else np.inf
    want = {}
    for f, c in itertools.permutations(sorted(d.family.unique()), 2):
        tr, cal, te = d[~d.family.isin([f, c])], d[d.family == c], d[d.family == f]
        if len(cal) < 19 or len(tr) < 50:
            continue
        mean = tr.groupby("scheme").delta.mean()
        resid = (cal.delta - cal.scheme.map(mean).fillna(tr.delta.mean())).abs()
        for s, b in set(zip(te.scheme, te.band)):
            own = resid[cal.scheme == s]
            hw = q(own) if len(own) >= MIN_CAL_ROWS else q((tr[tr.scheme == s].delta - mean[s]).abs())
            cell, cc = tr[(tr.scheme == s) & (tr.band == b)], resid[(cal.scheme == s) & (cal.band == b)]
            if len(cell) >= MIN_ROWS and cell.base_model.nunique() >= MIN_CLUSTERS and len(cc) >= MIN_CAL_ROWS and np.isfinite(q(cc)):
                hw = max(hw, q(cc))
            want[f, c, s, b] = (mean[s], hw)
    got = {(r.test_family, r.cal_family, r.scheme, r.band): (r.yhat, r.half_width) for r in E.pair_bands(t, sorted(d.family.unique())).collect()}
    assert got.keys() == want.keys() and len(got) > 50
    for k, v in want.items():
        assert got[k] == pytest.approx(v, abs=1e-9), k
