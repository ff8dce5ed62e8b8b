import hashlib
import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pairmeter.functions.exprs import feature_columns
from pairmeter.operators import audits as Q, bias as B, conformal as C, folds as E, models as P, resample as U, verdicts as V
from pairmeter.operators.order_stats import conformal_quantile, histogram, kth_refined, kth_smallest
from pairmeter.plans.local import constant_table


def frame(spark, **cols):
    return constant_table(spark, {k: list(v) for k, v in cols.items()})


@pytest.mark.parametrize("n,alpha,q", [(20, 0.1, 19.0), (8, 0.1, math.inf), (9, 0.1, 9.0), (18, 0.05, math.inf)])
def test_conformal_rank(spark, n, alpha, q):
    h = frame(spark, k=["a"] * n, score=[float(i) for i in range(1, n + 1)], n=[1] * n)
    assert conformal_quantile(h, ["k"], "score", alpha).first()["q"] == q


def test_order_statistic_on_skewed_histogram(spark):
    rng = np.random.default_rng(0)
    x = np.round(np.where(rng.random(3000) < 0.4, 0.0, rng.normal(size=3000)), 2)
    h = histogram(frame(spark, k=["a"] * 3000, delta=x.tolist()), "k")
    for k in (1, 700, 1500, 3000):
        for fn in (kth_smallest, kth_refined):
            assert fn(h, ["k"], "delta", lambda t, k=k: F.lit(k)).first()["q"] == np.sort(x)[k - 1]
    assert kth_refined(h, ["k"], "delta", lambda t: t + 1).first()["q"] is None


def synthetic(seed=0, clusters=24, fams=3):
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(clusters):
        for s, sd in (("a", 1.0), ("b", 2.0), ("c", 3.0)):
            if s == "c" and c % 6:
                continue
            for _ in range(rng.integers(6, 14)):
                rows.append((f"F{c % fams}", f"C{c}", s, "<2B" if c % 4 == 0 else ">10B", round(rng.normal(0, sd), 4)))
    return pd.DataFrame(rows, columns=["family", "base_model", "scheme", "band", "delta"])


def quantile(v, alpha=0.1):
    v, k = np.sort(v), math.ceil((len(v) + 1) * (1 - alpha))
    return v[k - 1] if k <= len(v) else math.inf


def brute_band(train, cal, scheme, band):
    """The widen-only band of one cell, written out on rows."""
    means = train.groupby("scheme").delta.mean().to_dict()
    g = train.delta.mean()
    centre = lambda s: means.get(s, g)
    resid = (cal.delta - cal.scheme.map(centre)).abs()
    if scheme in means:
        own = resid[cal.scheme == scheme]
        t = train[train.scheme == scheme].delta
        hw = quantile(own) if len(own) >= 9 else quantile((t - t.mean()).abs())
    else:
        hw = quantile(resid)
    t = train[(train.scheme == scheme) & (train.band == band)]
    own = resid[(cal.scheme == scheme) & (cal.band == band)]
    if len(t) >= 20 and t.base_model.nunique() >= 3 and len(own) >= 9 and quantile(own) > hw:
        hw = quantile(own)
    return centre(scheme), hw


def test_family_bands_match_brute_force(spark):
    d = synthetic()
    got = E.pair_bands(spark.createDataFrame(d), sorted(d.family.unique())).collect()
    assert len(got) > 10
    for r in got:
        train = d[~d.family.isin([r.test_family, r.cal_family])]
        mean, hw = brute_band(train, d[d.family == r.cal_family], r.scheme, r.band)
        assert r.yhat == pytest.approx(mean) and r.half_width == pytest.approx(hw)


def test_pairs_per_row_and_never_narrower(spark):
    d = spark.createDataFrame(synthetic(1))
    s = E.cluster_scores(d, E.pair_bands(d, ["F0", "F1", "F2"])).agg(F.sum("pairs"), F.sum("n_rows")).first()
    assert s[0] == 2 * d.count() and s[1] == d.count()
    m = C.fit_split(*C.reduce_rows(d, is_cal=F.col("family") == "F0")).collect()
    width = {r.scheme: r.half_width for r in m if r.level == "scheme"}
    means = {r.scheme: r["mean"] for r in m if r.level == "scheme"}
    scored = C.predict(d, C.fit_rows(d, F.col("family") == "F0")).collect()
    top = next(r for r in m if r.level == "global")
    assert any(r.scheme not in width for r in scored)
    assert all(r.half_width >= width.get(r.scheme, top.half_width) - 1e-12
               and r.yhat == pytest.approx(means.get(r.scheme, top["mean"])) for r in scored)


def test_coverage_on_exchangeable_data(spark):
    rng = np.random.default_rng(3)
    d = spark.createDataFrame(pd.DataFrame({"scheme": "a", "delta": np.round(rng.normal(size=6000), 4), "side": np.arange(6000) % 3}))
    m = C.mondrian(d.where("side = 0"), d.where("side = 1")).first()
    cov = d.where("side = 2").agg(F.avg((F.abs(F.col("delta") - m["mean"]) <= m["q"]).cast("int"))).first()[0]
    assert 0.88 <= cov <= 0.92


def test_mondrian_back_off(spark):
    t = frame(spark, scheme=["a"] * 30 + ["b"] * 30, delta=[0.0] * 60)
    cal = frame(spark, scheme=["a"] * 30, delta=[float(i) for i in range(30)])
    for backoff, expect in ((True, 27.0), (False, math.inf)):
        r = {x.scheme: x for x in C.mondrian(t, cal, backoff=backoff).collect()}
        assert r["b"].q == expect and r["b"].backed_off is backoff and r["a"].q == 27.0


def test_cluster_partition_is_a_third_and_repeats(spark):
    d = spark.range(500).select(F.concat(F.lit("c"), F.col("id") % 100).alias("base_model"))
    a, b = (sorted(r.base_model for r in C.cluster_partition(x).where("is_cal").collect()) for x in (d, d.repartition(5)))
    assert a == b and len(a) == 33


def test_exact_bootstrap(spark):
    c = frame(spark, g=["x", "x"], base_model=["a", "b"], ok=[0, 10], n=[10, 10])
    r = U.exact_bounds(c, ["g"]).first()
    assert (r.boot_lo, r.boot_hi) == (0.0, 100.0)


def test_exact_bootstrap_against_all_tuples(spark):
    ok, n = [3, 9, 5, 7], [10, 11, 5, 9]
    vals = sorted(sum(ok[i] for i in t) / sum(n[i] for i in t) for t in itertools.product(range(4), repeat=4))
    at = lambda a: 100 * vals[math.ceil(a * len(vals) - 1e-9) - 1]
    r = U.exact_bounds(frame(spark, g=["x"] * 4, base_model=list("abcd"), ok=ok, n=n), ["g"]).first()
    assert r.boot_lo == pytest.approx(at(0.05)) and r.boot_hi == pytest.approx(at(0.95))


def test_monte_carlo_repeats_and_brackets(spark):
    c = frame(spark, g=["x"] * 12, base_model=[f"c{i}" for i in range(12)], ok=list(range(12)), n=[12] * 12)
    a, b = (U.monte_carlo_bounds(x, ["g"], draws=400).first() for x in (c, c.repartition(3)))
    assert a == b and a.boot_lo < 100 * 5.5 / 12 < a.boot_hi


def test_clopper_pearson(spark):
    r = frame(spark, k=[0.0, 176.0, 5.0], n=[10.0, 188.0, 5.0]).select(U.clopper_pearson("k", "n").alias("c")).collect()
    assert r[0].c.lo == 0 and r[0].c.hi == pytest.approx(1 - 0.025 ** 0.1)
    assert (round(100 * r[1].c.lo, 1), round(100 * r[1].c.hi, 1)) == (89.1, 96.7)
    assert r[2].c.lo == pytest.approx(0.025 ** 0.2) and r[2].c.hi == 1


def test_seventy_families_are_all_scored(spark):
    d = spark.range(70 * 24).select(
        F.format_string("F%02d", F.col("id") % 70).alias("family"), F.concat_ws("-", F.lit("m"), F.col("id") % 70, F.col("id") % 3).alias("base_model"),
        F.lit("s").alias("scheme"), F.lit("2-10B").alias("band"), F.round(F.rand(3) * 4 - 2, 4).alias("delta"))
    s = E.pair_cluster_scores(d, d.select("family").distinct())
    t = s.groupBy("family").agg(F.sum("pairs").alias("p")).collect()
    assert len(t) == 70 and {r.p for r in t} == {24 * 69}


def test_folds_of_two_calibration_families(spark):
    got = E.family_folds(spark, ["b", "a", "c", "d"], 2).collect()
    want = {(f"{t}|{x}+{y}", t, f"{x}+{y}", f, "test" if f == t else "cal" if f in (x, y) else "train")
            for t in "abcd" for x, y in itertools.combinations([f for f in "abcd" if f != t], 2) for f in "abcd"}
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_order_statistics_of_off_grid_values_in_one_hot_treatment(spark):
    rng = np.random.default_rng(4)
    d = pd.DataFrame({"scheme": np.where(rng.random(4000) < 0.9, "hot", "cold"), "delta": rng.normal(size=4000) / 3, "noise": rng.random(4000) + 0.5})
    cal, train = (spark.createDataFrame(d.iloc[i::2]) for i in (0, 1))
    m = {r.scheme: r for r in C.mondrian(train, cal, normalized=True, noise=F.col("noise")).collect()}
    mean = d.iloc[1::2].groupby("scheme").delta.mean()
    c = d.iloc[0::2]
    score = ((c.delta - c.scheme.map(mean)).abs() / c.noise)
    kth = lambda v: np.sort(v)[math.ceil((len(v) + 1) * (1 - 0.1)) - 1]
    for s in ("hot", "cold"):
        assert m[s].q == pytest.approx(kth(score[c.scheme == s])) and m[s].q_marginal == pytest.approx(kth(score))


def test_monte_carlo_against_plain_draws(spark):
    p = 2 ** 31 - 1

    def pick(draw, j):
        x = hashlib.md5(f"0:{draw}".encode()).hexdigest()
        a, b, c, d = (int(x[i:i + 8], 16) for i in (0, 8, 16, 24))
        return (a * j ** 3 + b * j ** 2 + c * j + d) % p % 11

    rows = [("g", f"c{i}", i % 4, 4 + i) for i in range(11)]
    order = sorted(rows, key=lambda r: (hashlib.md5(r[1].encode()).hexdigest()[:5], r[1]))
    v = sorted(100 * sum(x[2] for x in picks) / sum(x[3] for x in picks) for picks in ([order[pick(d, j)] for j in range(11)] for d in range(300)))
    got = U.monte_carlo_bounds(frame(spark, g=[r[0] for r in rows], base_model=[r[1] for r in rows], ok=[r[2] for r in rows], n=[r[3] for r in rows]), ["g"], draws=300).first()
    assert got.boot_lo == pytest.approx(v[math.floor(0.05 * 299)]) and got.boot_hi == pytest.approx(v[math.ceil(0.95 * 299)])


@pytest.mark.parametrize("k", [9, 64, 1000])
def test_picks_resample_like_independent_ones(k):
    """Every cluster is picked alike, and sums over draws have the quantiles of independent draws."""
    picks = U.draw_picks(range(20_000), 0, k, k)
    assert np.array_equal(picks[:, 5:], U.draw_picks(range(20_000), 5, k, k))
    counts = np.bincount(picks.ravel(), minlength=k)
    assert abs((counts - 20_000).astype(float)).max() < 5.5 * math.sqrt(20_000)
    rng = np.random.default_rng(1)
    n = rng.integers(1, 200, k)
    ok = rng.binomial(n, rng.beta(9, 1, k))
    free = rng.integers(0, k, (20_000, k))
    a, b = (ok[x].sum(axis=1) / n[x].sum(axis=1) for x in (picks, free))
    for q in (0.01, 0.05, 0.5, 0.95, 0.99):
        assert abs(np.quantile(a, q) - np.quantile(b, q)) < 0.12 * b.std()


@pytest.mark.parametrize("k", [1, 9, 200, 1000, 1100, 20_000])
def test_stepped_draws_add_the_same_picks(k):
    rng = np.random.default_rng(k)
    c = {"ok": rng.integers(0, 150, k), "n": rng.integers(1, 200, k), "gain": rng.random(k), "wide": rng.integers(0, 1 << 40, k)}
    got, picks = U.drawn_sums(3, 40, c), U.draw_picks(range(3, 40), 0, k, k)
    for x, v in c.items():
        np.testing.assert_allclose(got[x], v[picks].sum(axis=1), rtol=1e-12 if x == "gain" else 0)


def test_free_draws_hash_every_pick(spark):
    k, n = 30, 250
    c = frame(spark, g=["x"] * k, base_model=[f"c{i}" for i in range(k)], ok=list(range(k)), n=[40] * k)
    order = sorted(range(k), key=lambda i: (hashlib.md5(f"c{i}".encode()).hexdigest()[:5], f"c{i}"))
    pick = lambda d, j: order[int(hashlib.md5(f"0:{d}:{j}".encode()).hexdigest()[:15], 16) % k]
    want = {(d, sum(pick(d, j) for j in range(k))) for d in range(n)}
    assert {(r.draw, r.ok) for r in U.draws_table(c, ["g"], ["ok", "n"], n, free=True).collect()} == want


def test_draws_by_group_and_blocks(spark, monkeypatch):
    """A number of draws per group, over several blocks of draws and pieces of picks, is the same as in one."""
    g, m = ["x"] * 10 + ["y"] * 9, [f"c{i}" for i in range(19)]
    c = frame(spark, g=g, base_model=m, ok=list(range(19)), n=[20] * 19)
    n = F.when(F.col("g") == "x", 70).otherwise(40)
    want = {tuple(r) for r in U.draws_table(c, ["g"], ["ok", "n"], n).collect()}
    assert sum(r[0] == "x" for r in want) == 70 and len(want) == 110
    monkeypatch.setattr(U, "DRAW_BLOCK", 16)
    monkeypatch.setattr(U, "PICKS", 4)
    picks = {(r[0], r[1]): r[2] for r in want}
    whole = U.draw_picks(range(40), 0, 9, 9)
    order = sorted(range(10, 19), key=lambda i: (hashlib.md5(m[i].encode()).hexdigest()[:5], m[i]))
    assert [picks["y", d] for d in range(40)] == np.array(order)[whole].sum(axis=1).tolist()
    assert {tuple(r) for r in U.draws_table(c, ["g"], ["ok", "n"], n).collect()} == want


def test_verdict_bounds_are_the_bootstraps(spark):
    """Above eight clusters a cell's bounds are the Monte Carlo's, up to eight the exact ones; bands are judged by both."""
    cell = ["big"] * 12 + ["few"] * 5
    base = {c: [0] * 17 for c in E.SUMS}
    ok = [17 + i % 3 for i in range(17)]
    s = frame(spark, scheme=cell, band=["<2B"] * 17, family=["f"] * 17, base_model=[f"m{i}" for i in range(17)],
              **(base | {"pairs": [20] * 17, "n_rows": [20] * 17, "ok": ok, "ok_one": ok, "miss_delta": [0.0] * 17}))
    got = {(r.scheme, r.band): (r.boot90_lo, r.boot90_hi, r.state) for r in V.evidence(s, 500, 900).collect()}
    c = s.select("scheme", "base_model", F.col("ok_one").alias("ok"), F.col("pairs").alias("n"))
    few = U.exact_bounds(c.where("scheme = 'few'"), ["scheme"]).first()
    assert got["few", "*"][:2] == got["few", "<2B"][:2] == (few.boot_lo, few.boot_hi)
    for band, draws in (("*", 900), ("<2B", 500)):
        big = U.monte_carlo_bounds(c.where("scheme = 'big'"), ["scheme"], draws=draws).first()
        assert got["big", band][:2] == (big.boot_lo, big.boot_hi)
        assert got["big", band][2] == (V.INSUFFICIENT if big.boot_lo < 85 < big.boot_hi else V.TRUSTED)


def test_addresses_and_home_folders(spark):
    text = "at 93.184.216.34 and 10.1.2.3, 172.20.0.1 192.168.1.1 8.8.8.8 1.2.3.4.5 300.1.1.1\n(51.15.0.9) v1.2.3.4 /home/ubuntu/x /home/ann/x x/home/no/ /Users/bob.c/ C:\\Users\\eve\\"
    d = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id int, text string")
    assert {(r.line_no, r.match) for r in Q.public_addresses(d).collect()} == {(1, "93.184.216.34"), (2, "51.15.0.9")}
    assert {r.match for r in Q.personal_paths(d).collect()} == {"/home/ann/", "/Users/bob.c/", "C:\\Users\\eve\\"}


def test_average_ranks(spark):
    d = pd.DataFrame({"x": [3, 1, 2, 2, 9, 9, 9, 0.5], "y": [1, 1, 4, 2, 8, 8, 7, 0]})
    r = U.correlations(spark.createDataFrame(d.astype(float)), "x", "y").first()
    assert r.spearman == pytest.approx(d.rank().corr().iloc[0, 1]) and r.pearson == pytest.approx(d.corr().iloc[0, 1])


@pytest.mark.parametrize("k,one,two,lo,hi,state", [
    (2, 1.0, 1.0, 99.0, 100.0, V.INSUFFICIENT), (None, 1.0, 1.0, 99.0, 100.0, V.INSUFFICIENT), (5, None, None, 99.0, 100.0, V.INSUFFICIENT),
    (5, 0.9, 0.9, None, 95.0, V.INSUFFICIENT), (5, 0.9, 0.9, 84.95, 95.0, V.INSUFFICIENT), (5, 0.8, 0.9, 70.0, 84.9, V.REFUSED),
    (5, None, 0.8, 70.0, 84.9, V.REFUSED), (5, 0.95, 0.9, 90.0, 99.0, V.TRUSTED)])
def test_classifier(spark, k, one, two, lo, hi, state):
    row = spark.createDataFrame([(k, one, two, lo, hi)], "distinct_checkpoints int, coverage_one_sided double, coverage double, boot90_lo double, boot90_hi double")
    assert row.select(V.classify().alias("s")).first()["s"] == state


def test_bound_moves_down_with_censoring(spark):
    x = np.round(np.random.default_rng(4).normal(size=4000) ** 3, 4)
    h = histogram(spark.createDataFrame(pd.DataFrame({"scheme": "a", "delta": x})), "scheme")
    lows = [r.lower for r in B.corrected_bounds(h).orderBy("pi").collect()]
    assert all(b < a for a, b in zip(lows[1:], lows[2:])) and lows[1] < lows[0]


def test_ridge_equals_spark_ml(spark):
    rng = np.random.default_rng(5)
    d = pd.DataFrame(rng.normal(size=(200, 3)), columns=["a", "b", "c"])
    d["delta"] = d.a * 2 - d.b + rng.normal(size=200)
    d["family"] = "f"
    df = spark.createDataFrame(d)
    feats = {c: F.col(c) for c in "abc"}
    mine = P.ridge(P.gram_by_group(df, feats)["f"], 3.0)[1:]
    model, _ = P.ridge_pipeline(df, feats, 3.0)
    assert np.allclose(mine * d[list("abc")].std(ddof=0), model.coefficients.toArray(), atol=1e-9)


def test_features_do_not_see_the_target():
    text = str(list(feature_columns().values()))
    assert "acc_after" not in text and "delta" not in text


def test_contract_catches_planted_errors(spark):
    good = dict(model="m", base_model="b", scheme="w4a16", benchmark="mmlu", params_b=7.0, acc_before=60.0, acc_after=50.0)
    check = lambda **kw: {r.check: r.status for r in Q.validate_contract(spark.createDataFrame(pd.DataFrame([{**good, **kw}])), ["mmlu"], ["w4a16"]).collect()}
    assert set(check().values()) == {"ok"}
    assert check(acc_before=0.6, acc_after=0.5)["scale_0_1"] == "fail"
    assert check(model=" ")["blank_model"] == "fail" and check(benchmark="x")["unknown_task"] == "fail"
    assert check(scheme="new")["new_scheme"] == "warn" and check(acc_after=59.0)["not_damaging"] == "warn"
    assert check(acc_after=120.0)["outside_0_100"] == "fail"


def test_empty_input_is_unchecked(spark):
    schema = "model string, base_model string, scheme string, benchmark string, params_b double, acc_before double, acc_after double"
    assert {r.status for r in Q.validate_contract(spark.createDataFrame([], schema), ["mmlu"], ["w4a16"]).collect()} == {"unchecked"}
    none = spark.createDataFrame([], "doc_id string, key string, stated double")
    reg = spark.createDataFrame([], "key string, value double, tol double")
    assert [r.status for r in Q.check_claims(none, reg).collect()] == ["unchecked"]


def test_planted_prose_defects(spark):
    texts = ["we saw the the effect", "and the width and the width come from", "coverage of. The interval", "one,, two", "widths come from the \\emph{} partition",
             "that is the whole point \\paragraph{What it cannot do.}"]
    clean = ["see e.g. the discussion in", "stated in notes.md and in code.py", "a width of 0.5 against 0.3 before",
             "\\paragraph{What it is for.} The question"]
    d = spark.createDataFrame(list(enumerate(texts + clean)), "doc_id int, text string")
    assert {r.doc_id for r in Q.prose_defects(d).collect()} == set(range(len(texts)))


def test_margins_are_those_of_one_pattern(spark):
    texts = ["it ends with the. The end of. And a long stretch of words; or so. Then to. Z", "the. A", "a. Bof. C the. D", "", None, "no match",
             "x\u2028ab the. Then of\u0085the. T the. T", "\x01 cut by the. Mark and of. Two", "é😀é😀é😀é😀é😀é😀é😀é😀 of. The", "the. The. The. Aof. B"]
    d = spark.createDataFrame([(t,) for t in texts], "t string")
    for pattern in (r"\b(?:the|a|an|of|to|and|or|in|with|by|for)\s*\.\s+[A-Z]", r";\s*(?:and|or|but)\s+[^.;:]{0,60}\."):
        plain = F.regexp_extract_all("t", F.lit(f"(?:.{{0,14}}?)(?:{pattern})"), 0)
        got = d.where("t is not null").select(Q._with_margin(F.col("t"), pattern, 14).alias("got"), plain.alias("want")).collect()
        assert [r.got for r in got] == [r.want for r in got] and any(r.want for r in got)


def test_boosting_works_on_distinct_feature_vectors(spark, monkeypatch):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor
    rows = [(f, float(i % 4), float(i % 3), (i * 7 % 11) / 4 + i % 4) for f in ("a", "b") for i in range(120)]
    d = spark.createDataFrame(rows, "family string, x double, y double, delta double").coalesce(1)
    seen, fit = [], GBTRegressor.fit
    monkeypatch.setattr(GBTRegressor, "fit", lambda self, t, *more: seen.append(t.count()) or fit(self, t, *more))
    got = {r.family: (r.n, r.mae) for r in P.lofo_boosting(d, {"x": F.col("x"), "y": F.col("y")}, d, depth=2, iters=2).collect()}
    assert seen == [12, 12]
    v = VectorAssembler(inputCols=["x", "y"], outputCol="features").transform(d)
    for f in ("a", "b"):
        m = fit(GBTRegressor(labelCol="delta", maxDepth=2, maxIter=2, stepSize=0.05, seed=0), v.where(F.col("family") != f))
        want = m.transform(v.where(F.col("family") == f)).agg(F.count("*").alias("n"), F.avg(F.abs(F.col("delta") - F.col("prediction"))).alias("e")).first()
        assert got[f][0] == want.n and abs(got[f][1] - want.e) < 1e-9
