import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from test_statistics import brute_band, synthetic

from pairmeter.operators import leave_out as L

GRID = st.integers(-60, 60).map(lambda x: x / 10)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(GRID, st.booleans()), min_size=1, max_size=60), GRID, st.integers(1, 70))
def test_kth_distance_without_own_rows(rows, centre, k):
    centre += 0.013
    values, counts = np.unique([v for v, _ in rows], return_counts=True)
    own, own_n = np.unique([v for v, mine in rows if mine], return_counts=True)
    n, q = L.kth_about(values, counts, np.array([centre]), lambda n: np.array([k]), own, own_n, np.array([len(own)]))
    left = sorted(abs(v - centre) for v, mine in rows if not mine)
    assert n[0] == len(left)
    assert q[0] == pytest.approx(left[k - 1]) if k <= len(left) else math.isinf(q[0])


def test_kth_distance_starts_near_its_end(monkeypatch):
    """Many folds of one cell, each as if alone, in fewer looks at the histogram than a bisection of all of it takes."""
    rng = np.random.default_rng(3)
    values = np.unique(rng.normal(0, 5, 40_000).round(4))
    counts = rng.integers(1, 4, len(values))
    own = [np.sort(rng.choice(len(values), rng.integers(0, 40), replace=False)) for _ in range(300)]
    centre, rank = rng.normal(0.2, 0.01, 300), lambda n: np.ceil((n + 1) * 0.9)
    looks, plain = [], L._within
    monkeypatch.setattr(L, "_within", lambda *a: looks.append(1) or plain(*a))
    n, q = L.kth_about(values, counts, centre, rank, values[np.concatenate(own)], np.ones(sum(map(len, own)), np.int64), np.array([len(o) for o in own]))
    assert len(looks) < 2 * 2 * 12
    for i in range(0, 300, 17):
        left = counts.copy()
        left[own[i]] -= 1
        d = np.sort(np.repeat(np.abs(values - centre[i]), left))
        assert n[i] == len(d) and q[i] == pytest.approx(d[int(rank(n[i])) - 1], abs=1e-9)


def number():
    return F.substring("base_model", 2, 5).cast("int")


def test_split_bands_under_two_partitions(spark):
    d = synthetic(2, clusters=12)
    d = pd.concat([d, d[d.base_model == "S4"].assign(scheme="only_here")])  # a treatment of one cluster
    df = spark.createDataFrame(d)
    sides = [number() % 3 == 0, number() % 4 == 1]
    got = L.LeaveOut(df, L.partitions(df.select("base_model").distinct(), sides)).split_bands().collect()
    cells = d[["base_model", "scheme", "band"]].drop_duplicates()
    assert len(got) == 2 * len(cells)
    for r in got:
        rest = d[d.base_model != r.base_model]
        k = rest.base_model.str[1:].astype(int)
        cal = k % 3 == 0 if r.part == 0 else k % 4 == 1
        if r.scheme == "only_here":  # nothing left to fit: the mean and the width of everything
            fit, c = rest[~cal], rest[cal]
            centre = c.scheme.map(fit.groupby("scheme").delta.mean()).fillna(fit.delta.mean())
            resid = np.sort((c.delta - centre).abs())
            assert r.yhat == pytest.approx(fit.delta.mean()) and r.half_width == pytest.approx(resid[math.ceil((len(c) + 1) * 0.9) - 1])
            continue
        mean, hw = brute_band(rest[~cal], rest[cal], r.scheme, r.band)
        assert r.yhat == pytest.approx(mean) and r.half_width == pytest.approx(hw)
    packed = L.packed_bands(spark.createDataFrame(got)).collect()
    assert sum(len(r.bands) for r in packed) == len(got)


def test_sampled_partitions_take_the_same_share_of_the_others(spark):
    ids = [f"S{i}" for i in range(23)]
    p = L.sampled_partitions(spark.createDataFrame([(i,) for i in ids], "base_model string"), 3, 0.3).toPandas()
    for seed in range(3):
        a, b = p[p.part == 2 * seed].set_index("base_model"), p[p.part == 2 * seed + 1].set_index("base_model")
        assert (a.tested ^ b.tested).all()
        for i in ids:
            own = a if a.tested[i] else b
            assert own.is_cal.drop(i).sum() == round(0.3 * 22)


def plain_jackknife(d, alpha=0.1, least=9):
    out = {}
    for t in d.base_model.unique():
        rest = d[d.base_model != t]
        terms = []
        for i in rest.base_model.unique():
            inner, held = rest[rest.base_model != i], rest[rest.base_model == i]
            centre = held.scheme.map(inner.groupby("scheme").delta.mean()).fillna(inner.delta.mean())
            terms.append(held.assign(lo=centre - (held.delta - centre).abs(), hi=centre + (held.delta - centre).abs()))
        terms = pd.concat(terms)
        for s in d[d.base_model == t].scheme.unique():
            own = terms[terms.scheme == s]
            unit = "scheme" if own.base_model.nunique() >= least else "pooled"
            own = own if unit == "scheme" else terms
            n = len(own)
            lo, hi = np.sort(own.lo), np.sort(own.hi)
            out[t, s] = (lo[max(math.floor(alpha * (n + 1)) - 1, 0)], hi[min(math.ceil((1 - alpha) * (n + 1)) - 1, n - 1)], unit)
    return out


@pytest.mark.parametrize("case", ["even", "one large cluster", "few clusters"])
def test_jackknife_plus_against_refits(spark, case, monkeypatch):
    monkeypatch.setattr(L, "CHUNK", 5)
    d = synthetic(4, clusters=4 if case == "few clusters" else 20)
    if case == "one large cluster":  # half of all rows, with another mean
        big = d.sample(len(d), replace=True, random_state=1).assign(base_model="S3")
        d = pd.concat([d, big.assign(delta=(big.delta - 2).round(4)), d[d.base_model == "S5"].head(3).assign(scheme="only_here")])
    want = plain_jackknife(d)
    got = L.jackknife_plus(spark.createDataFrame(d)).collect()
    assert len(got) == len(want)
    for r in got:
        lo, hi, unit = want[r.base_model, r.scheme]
        assert r.unit == unit and (r.lo, r.hi) == (pytest.approx(lo), pytest.approx(hi)), r
