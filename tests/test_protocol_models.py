"""One unit hidden at a time, and penalties selected inside each training split, against plain refits."""

import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pairmeter.operators import lowrank as M, models as P

TASKS = [f"T{i}" for i in range(6)]
SCHEMA = "row_key string, base_model string, scheme string, benchmark string, score double"


def _matrix(n_base=40, noise=0.0, missing=0.15, seed=3):
    """(base, (base, scheme)) x task matrix of rank two plus noise, with holes."""
    rng = np.random.default_rng(seed)
    load, rows = rng.normal(size=(2, 6)) * 5, []
    for b in range(n_base):
        z = rng.normal(size=2)
        for key, scheme in ((f"BASE::B{b}", None), (f"QUANT::B{b}/x", "x"), (f"QUANT::B{b}/y", "y")):
            y = 50 + (z + rng.normal(size=2) * 0.3) @ load + rng.normal(size=6) * noise
            rows += [(key, f"B{b}", scheme, t, float(v)) for t, v in zip(TASKS, y) if rng.random() >= missing]
    return rows


def _md5(*parts):
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:15], 16)


def _plain(rows, rank=2, k=3, seeds=2):
    keys = sorted({r[0] for r in rows})
    full = pd.DataFrame(np.nan, index=keys, columns=TASKS)
    base_of = {}
    for key, base, _, t, v in rows:
        full.loc[key, t] = v
        base_of[key] = "BASE::" + base
    out = {}
    for key in keys:
        if key.startswith("BASE") or base_of[key] not in full.index:
            continue
        paired = [t for t in TASKS if pd.notna(full.loc[key, t]) and pd.notna(full.loc[base_of[key], t])]
        if len(paired) < k + 2:
            continue
        for s in range(seeds):
            order = sorted(paired, key=lambda t: ((h := _md5(key, t)) // 2 ** 30 + s * (h % 2 ** 30)) % 1_000_000_007)
            x = full.copy()
            x.loc[key, order[k:]] = np.nan
            cov = np.zeros((6, 6))
            for i, a in enumerate(TASKS):
                for j, b in enumerate(TASKS):
                    both = x[[a, b]].dropna().to_numpy() if a != b else x[[a, a]].dropna().to_numpy()
                    cov[i, j] = np.mean((both[:, 0] - both[:, 0].mean()) * (both[:, 1] - both[:, 1].mean()))
            mu = x.mean().to_numpy()
            val, vec = np.linalg.eigh(cov)
            noise = np.maximum(val[:-rank], 0).mean() + 1e-9 * np.trace(cov) + 1e-12
            w = vec[:, -rank:] * np.sqrt(np.maximum(val[-rank:] - noise, 0))
            see = x.loc[key].notna().to_numpy()
            sigma = w @ w.T + noise * np.eye(6)
            pred = mu + (w @ w.T)[:, see] @ np.linalg.solve(sigma[np.ix_(see, see)], (x.loc[key].to_numpy() - mu)[see])
            for t in order[k:]:
                out[s, key, t] = pred[TASKS.index(t)]
    return out


@pytest.mark.parametrize("noise", [0.0, 1.0])
def test_hidden_units_match_a_refit_for_each(spark, noise):
    rows = _matrix(noise=noise) + [("QUANT::lost/x", "lost", "x", "T0", 40.0)]  # a row of the matrix without a base row
    d = spark.createDataFrame(rows + [(rows[0][0], rows[0][1], rows[0][2], "other task", 1.0)], SCHEMA)
    got = M.complete_low_rank(d.repartition(5), TASKS, seeds=2).collect()
    want = _plain(rows)
    assert len(got) == len(want) > 80
    score = {(k, t): v for k, _, _, t, v in rows}
    err, spread = [], []
    for r in got:
        assert r.pred_score == pytest.approx(want[r.seed, r.row_key, r.benchmark], abs=1e-4)
        assert r.score == score[r.row_key, r.benchmark] and r.scheme == r.row_key[-1]
        err.append(abs(r.pred_score - r.score))
        spread.append(abs(r.score - 50))
    assert np.mean(err) < (0.35 if noise == 0 else 0.7) * np.mean(spread)


def test_hidden_units_of_odd_matrices(spark):
    none = M.complete_low_rank(spark.createDataFrame([], SCHEMA), TASKS)
    assert none.count() == 0
    flat = [(k, "B", s, t, 50.0) for k, s in (("BASE::B", None), ("QUANT::B/x", "x")) for t in TASKS]
    got = M.complete_low_rank(spark.createDataFrame(flat + [("BASE::C", "C", None, "T0", None)], SCHEMA), TASKS).collect()
    assert len(got) == 15 and all(r.pred_score == pytest.approx(50) for r in got)


def test_scorecard_by_seed_is_the_scorecard_of_each(spark):
    rng = np.random.default_rng(1)
    d = pd.DataFrame({"seed": rng.integers(0, 3, 300), "scheme": rng.choice(["x", "y"], 300), "true_delta": rng.normal(size=300) * 3,
                      "pred_delta": rng.normal(size=300) * 2, "scheme_mean": 0.1})
    t = spark.createDataFrame(d)
    for r in M.scorecard(t, "seed").collect():
        one = M.scorecard(t.where(F.col("seed") == r.seed)).first().asDict()
        assert {k: pytest.approx(v) for k, v in one.items()} == {k: v for k, v in r.asDict().items() if k != "seed"}


def _ridge(x, y, a):
    m, s = x.mean(0), x.std(0)
    s = np.where(s < 1e-6, 1.0, s)
    z = (x - m) / s
    beta = np.linalg.solve(z.T @ z + a * np.eye(x.shape[1]), z.T @ (y - y.mean()))
    return lambda v: y.mean() + ((v - m) / s) @ beta


def test_penalty_is_selected_inside_each_training_split(spark):
    rng = np.random.default_rng(9)
    n = 240
    d = pd.DataFrame({"family": rng.choice(["f|1", "g", "h", "i"], n, p=[0.4, 0.3, 0.2, 0.1]), "a": rng.normal(size=n), "b": rng.normal(size=n)})
    d["base_model"] = [f"{f}{k}" for f, k in zip(d.family, rng.integers(0, 6, n))]
    d["delta"] = d.a * 0.3 + rng.normal(size=n) * 2 + d.family.map({"f|1": 0.0, "g": 1.0, "h": -1.0, "i": 0.5})
    d["fold"] = [_md5(0, b) % 5 for b in d.base_model]
    t = spark.createDataFrame(d)
    t = t.unionByName(t.limit(3).withColumn("family", F.lit(None).cast("string")))
    got = {r.family: r for r in P.select_penalties(t, {"a": F.col("a"), "b": F.col("b")}).collect()}
    assert set(got) == set(d.family)
    for f, r in got.items():
        tr, te = d[d.family != f], d[d.family == f]
        cv = []
        for a in P.SELECT_ALPHAS:
            e = []
            for k in sorted(tr.fold.unique()):
                fit, val = tr[tr.fold != k], tr[tr.fold == k]
                e += list(np.abs(val.delta - _ridge(fit[["a", "b"]].to_numpy(), fit.delta.to_numpy(), a)(val[["a", "b"]].to_numpy())))
            cv.append(np.mean(e))
        a = P.SELECT_ALPHAS[int(np.argmin(cv))]
        assert (r.n, r.alpha, r.at_grid_edge) == (len(te), a, a in (0.3, 100.0)) and r.cv_mae == pytest.approx(min(cv), abs=1e-9)
        pred = _ridge(tr[["a", "b"]].to_numpy(), tr.delta.to_numpy(), a)(te[["a", "b"]].to_numpy())
        assert r.mae == pytest.approx(np.abs(te.delta - pred).mean(), abs=1e-9)


def test_nothing_to_select_from(spark):
    f = {"a": F.col("a")}
    schema = "family string, base_model string, a double, delta double"
    assert P.select_penalties(spark.createDataFrame([], schema), f).count() == 0
    one = spark.createDataFrame([("x", "m", 1.0, 2.0), ("y", "m2", 0.0, 4.0), ("y", "m2", 1.0, 6.0)], schema)
    got = {r.family: (r.n, r.alpha, r.cv_mae) for r in P.select_penalties(one, f).collect()}
    assert got == {"x": (1, 3.0, None), "y": (2, 3.0, None)}
