"""Leave-out evaluation protocols.

A fold names the family it tests and those it calibrates on; every other family trains. Train sums
are the sums of all families less those of the named ones, added up as decimals so that the
difference is exact; calibration residuals come from the per-family delta histogram; test rows meet
the finished bands in one equi-join. Nothing loops over folds, and no fold lists its train families.
"""

from pyspark.sql import DataFrame, functions as F

from pairmeter.functions.exprs import EPS, inside
from pairmeter.operators.conformal import (
    ALPHA, CELL, MIN_CAL_ROWS, MIN_CLUSTERS, MIN_ROWS, reduce_rows, stack_levels)
from pairmeter.operators.order_stats import (
    INF, conformal_quantile, conformal_rank, finite, kth_refined, percentile_refined)
from pairmeter.plans.local import constant_table
from pairmeter.plans.staging import stage

MIN_FOLD_CAL = 19
MIN_FOLD_TRAIN = 50


FOLD_BLOCKS = 16


def _meet(left: DataFrame, right: DataFrame, key: str, cond) -> DataFrame:
    """Rows of ``left`` beside those of ``right`` that satisfy ``cond``: ``right`` is cut into blocks by
    the hash of ``key`` and every left row visits each block, so the join is on the block."""
    left = left.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(FOLD_BLOCKS - 1))))
    right = right.withColumn("_b", F.pmod(F.hash(key), F.lit(FOLD_BLOCKS)))
    return left.join(right, "_b").where(cond).drop("_b")


def _fold_sets(spark, families, n_cal):
    """(written distinct keys, (test_family, cal) for every test family and set of ``n_cal`` others)."""
    if not isinstance(families, DataFrame):
        families = constant_table(spark, {"family": list(families)})
    keys = stage(families.select("family").where("family is not null").distinct())
    cal = keys.select(F.array("family").alias("cal"))
    for _ in range(n_cal - 1):  # sets in rising order
        cal = _meet(cal, keys, "family", F.element_at("cal", -1) < F.col("family")).select(F.array_append("cal", F.col("family")).alias("cal"))
    test = keys.withColumnRenamed("family", "test_family")
    return keys, _meet(cal, test, "test_family", ~F.array_contains("cal", F.col("test_family")))


def _fold_rows(sets, family, role):
    label = F.array_join("cal", "+")
    return sets.select(F.concat("test_family", F.lit("|"), label).alias("fold"), "test_family", label.alias("cal_family"), family, role)


def held_out(spark, families, n_cal=1) -> DataFrame:
    """(fold, test_family, cal_family, family, role): the test and calibration families of every fold,
    one fold for every test family and every set of ``n_cal`` other families as calibration.

    ``families`` is a table of distinct keys (column ``family``) or a list of them; null is no family.
    Families not named in a fold are its train side: F families make F * (F - 1) folds of two rows.
    """
    _, sets = _fold_sets(spark, families, n_cal)
    test = F.struct(F.col("test_family").alias("family"), F.lit("test").alias("role"))
    named = F.concat(F.array(test), F.transform("cal", lambda c: F.struct(c.alias("family"), F.lit("cal").alias("role"))))
    return stage(_fold_rows(sets.withColumn("_r", F.explode(named)), F.col("_r.family").alias("family"), F.col("_r.role").alias("role")))


def family_folds(spark, families, n_cal=1) -> DataFrame:
    """``held_out`` with the train families listed too, for audits of the folds themselves; the
    protocols never need the list, which is as long as the number of families for every fold."""
    keys, sets = _fold_sets(spark, families, n_cal)
    role = F.when(F.col("family") == F.col("test_family"), "test").when(F.array_contains("cal", F.col("family")), "cal").otherwise("train")
    return stage(_fold_rows(_meet(sets, keys, "family", F.lit(True)), F.col("family"), role.alias("role")))


def _role(folds, role, *cols):
    return folds.where(F.col("role") == role).select("fold", "family", *cols)


def family_cells(hist: DataFrame, *keys) -> DataFrame:
    """(family, keys, s, n): sum and count of the deltas. The sum is a decimal with twelve places, the same in
    whatever order it is added; a delta that is not finite fails the cast."""
    return hist.groupBy("family", *keys).agg(
        F.sum((F.col("delta") * F.col("n")).cast("decimal(28,12)")).alias("s"), F.sum("n").alias("n"))


def of_families(t: DataFrame, folds: DataFrame) -> DataFrame:
    """Rows of the families a whole fold table names; others are on no side of any fold."""
    return t.join(folds.select("family").distinct(), "family", "left_semi")


def train_sums(cells: DataFrame, folds: DataFrame, keys=(), measures=("s", "n"), split=()) -> DataFrame:
    """(fold, split, keys, measures): the measures of ``cells`` over the families a fold does not name.

    ``cells`` holds decimal or whole measures per (family, split, keys), of the protocol's families alone
    (``of_families``). A row is given for the keys that a named family of the fold has, which are those its
    bands are asked for; keys left without train rows are absent. ``split`` keys run the protocol once for
    each of their values.
    """
    by = [*split, *keys]
    total = cells.groupBy(*by).agg(*[F.sum(m).alias("_" + m) for m in measures])
    named = (cells.join(folds.select("fold", "family"), "family").groupBy("fold", *by)
             .agg(*[F.sum(m).alias(m) for m in measures]))
    if by:
        named = named.join(total, by)
    else:
        named = named.withColumns({"_" + m: total.select("_" + m).scalar() for m in measures})
    left = named.select("fold", *by, *[(F.col("_" + m) - F.col(m)).alias(m) for m in measures])
    return left.where(F.col("n") > 0)


def _mean(s="s"):
    return F.col(s).cast("double") / F.col("n")


def valid_folds(cells: DataFrame, folds: DataFrame, min_cal=MIN_FOLD_CAL, min_train=MIN_FOLD_TRAIN) -> DataFrame:
    """Folds of ``held_out`` with enough calibration and training rows."""
    per_family = stage(of_families(cells, folds).groupBy("family").agg(F.sum("n").alias("n")))
    size = lambda role: F.sum(F.when(F.col("role") == role, F.col("n")).otherwise(0))
    train = train_sums(per_family, folds, measures=("n",)).select("fold", F.col("n").alias("n_train"))
    return (folds.join(per_family, "family").groupBy("fold", "test_family", "cal_family")
            .agg(size("cal").alias("n_cal"), size("test").alias("n_test")).join(train, "fold")
            .where((F.col("n_cal") >= min_cal) & (F.col("n_train") >= min_train) & (F.col("n_test") > 0))
            .select("fold", "test_family", "cal_family"))


def widen_bands(hist: DataFrame, sup: DataFrame, folds: DataFrame, alpha=ALPHA, min_cal=MIN_FOLD_CAL,
                min_train=MIN_FOLD_TRAIN) -> DataFrame:
    """The widen-only split-conformal band of every fold, for every cell the fold tests.

    Distinct training clusters are sums over families because clusters nest in families.
    """
    cells = family_cells(hist, "scheme", "band")
    clusters = sup.groupBy("family", "scheme", "band").agg(F.countDistinct("base_model").alias("k"))
    cells = stage(cells.join(clusters, ["family", "scheme", "band"]))
    ok = stage(valid_folds(cells, folds, min_cal, min_train))
    cells, hist = stage(of_families(cells, folds)), of_families(hist, folds)
    folds = folds.join(ok.select("fold"), "fold", "left_semi")
    tr_cell = train_sums(cells, folds, ("scheme", "band"), ("n", "k"))
    tr_scheme = stage(train_sums(cells, folds, ("scheme",)).select("fold", "scheme", _mean().alias("s_mean")))
    tr_all = stage(train_sums(cells, folds).select("fold", _mean().alias("g_mean")))

    cal = (hist.join(_role(folds, "cal"), "family")
           .join(tr_scheme, ["fold", "scheme"], "left").join(tr_all, "fold")
           .withColumn("resid", F.abs(F.col("delta") - F.coalesce("s_mean", "g_mean")))
           .select("fold", "scheme", "band", "resid", "n"))
    q = kth_refined(stack_levels(cal), ["fold", *CELL], "resid", lambda tot: conformal_rank(tot, alpha))
    q = stage(q.withColumn("q", F.coalesce("q", F.lit(INF))).withColumnRenamed("n", "n_cal"))
    level = lambda name, cols, out: q.where(F.col("level") == name).select(
        "fold", *cols, F.col("q").alias(out), F.col("n_cal").alias(out + "_n"))

    scheme = tr_scheme.join(level("scheme", ["scheme"], "q_s"), ["fold", "scheme"], "left")
    short = F.coalesce("q_s_n", F.lit(0)) < MIN_CAL_ROWS
    # residuals of the train side: those of all families less those of the fold's named ones
    tested = cells.join(_role(folds, "test"), "family").select("fold", "scheme").distinct()
    few = stage(scheme.where(short).select("fold", "scheme", "s_mean").join(tested, ["fold", "scheme"], "left_semi"))
    every = hist.groupBy("scheme", "delta").agg(F.sum("n").alias("n")).join(few, "scheme")
    named = (hist.join(folds.select("fold", "family"), "family").join(few, ["fold", "scheme"])
             .select("scheme", "delta", (-F.col("n")).alias("n"), "fold", "s_mean"))
    kept_train = (every.unionByName(named).withColumn("resid", F.abs(F.col("delta") - F.col("s_mean")))
                  .groupBy("fold", "scheme", "resid").agg(F.sum("n").alias("n")).where(F.col("n") > 0))
    in_sample = conformal_quantile(kept_train, ["fold", "scheme"], "resid", alpha, name="q_tr").drop("n")
    scheme = (scheme.join(in_sample, ["fold", "scheme"], "left")
              .select("fold", "scheme", "s_mean", F.when(short, F.col("q_tr")).otherwise(F.col("q_s")).alias("s_hw")))
    stratum = (tr_cell.where((F.col("n") >= MIN_ROWS) & (F.col("k") >= MIN_CLUSTERS)).select("fold", "scheme", "band")
               .join(level("stratum", ["scheme", "band"], "t_hw"), ["fold", "scheme", "band"])
               .where((F.col("t_hw_n") >= MIN_CAL_ROWS) & finite("t_hw")))

    test = cells.join(folds.where("role = 'test'").select("fold", "test_family", "cal_family", "family"), "family")
    b = (test.select("fold", "test_family", "cal_family", "scheme", "band").distinct()
         .join(scheme, ["fold", "scheme"], "left").join(tr_all, "fold")
         .join(level("global", [], "g_hw"), "fold").join(stratum, ["fold", "scheme", "band"], "left"))
    yhat = F.coalesce("s_mean", "g_mean")
    base = F.when(F.col("s_mean").isNotNull(), F.col("s_hw")).otherwise(F.col("g_hw"))
    wide = F.coalesce(F.col("t_hw") > base, F.lit(False))
    b = b.select("fold", "test_family", "cal_family", "scheme", "band", yhat.alias("yhat"),
                 F.when(wide, F.col("t_hw")).otherwise(base).alias("half_width"), wide.alias("widened"))
    first = F.col("fold") == F.min("fold").over(_by_test())
    return b.withColumns({"lo": F.col("yhat") - F.col("half_width"), "hi": F.col("yhat") + F.col("half_width"),
                          "first_fold": first})


def _by_test():
    from pyspark.sql import Window
    return Window.partitionBy("test_family", "scheme", "band")


def pair_bands(df: DataFrame, families, alpha=ALPHA) -> DataFrame:
    """Written bands of the (test family, calibration family) protocol."""
    hist, sup = reduce_rows(df, "family")
    return stage(widen_bands(hist, sup, held_out(df.sparkSession, families), alpha))


def score_rows(df: DataFrame, bands: DataFrame) -> DataFrame:
    """One row per (test row, fold): the test row, its band and the coverage indicators."""
    b = bands.withColumnRenamed("test_family", "family")
    out = df.join(b, ["family", "scheme", "band"])
    return out.withColumns({"ok": inside("delta", "lo", "hi"), "ok_one": F.col("delta") >= F.col("lo") - EPS})


SUMS = ["pairs", "n_rows", "ok", "ok_one", "below", "above", "below_eps", "above_eps", "widened", "ok_widened",
        "miss_delta"]


def cluster_scores(df: DataFrame, bands: DataFrame, *extra) -> DataFrame:
    """Everything later reports need, summed per (family, cluster, scheme, band): a partial
    aggregate straight off the join, so scored pairs are never shuffled."""
    s = score_rows(df, bands)
    i = lambda c: F.sum(c.cast("long"))
    return s.groupBy("family", "base_model", "scheme", "band", *extra).agg(
        F.count("*").alias("pairs"), i(F.col("first_fold")).alias("n_rows"), i(F.col("ok")).alias("ok"),
        i(F.col("ok_one")).alias("ok_one"), i(F.col("delta") < F.col("lo")).alias("below"),
        i(F.col("delta") > F.col("hi")).alias("above"),
        i(F.col("delta") < F.col("lo") - EPS).alias("below_eps"),
        i(F.col("delta") > F.col("hi") + EPS).alias("above_eps"),
        i(F.col("widened")).alias("widened"), i(F.col("widened") & F.col("ok")).alias("ok_widened"),
        F.sum(F.when(~F.col("ok"), F.col("delta")).otherwise(0.0)).alias("miss_delta"))


def pair_cluster_scores(df: DataFrame, families) -> DataFrame:
    return stage(cluster_scores(df, pair_bands(df, families)))


def coverage_table(scores: DataFrame) -> DataFrame:
    """Coverage per cell, scheme, band and pooled."""
    sets = [(F.lit("pooled"), F.lit("*"), F.lit("*")), (F.lit("scheme"), F.col("scheme"), F.lit("*")),
            (F.lit("band"), F.lit("*"), F.col("band")), (F.lit("cell"), F.col("scheme"), F.col("band"))]
    stacked = scores.select(
        F.explode(F.array(*[F.struct(a.alias("level"), s.alias("scheme"), b.alias("band")) for a, s, b in sets]))
        .alias("_l"), "family", "base_model", *SUMS).select("_l.*", "family", "base_model", *SUMS)
    share = lambda c: (F.sum(c) / F.sum("pairs"))
    return stacked.groupBy("level", "scheme", "band").agg(
        F.sum("pairs").alias("scored_pairs"), F.sum("n_rows").alias("distinct_rows"),
        F.countDistinct("base_model").alias("distinct_checkpoints"),
        F.countDistinct("family").alias("distinct_families"),
        share("ok").alias("coverage"), share("ok_one").alias("coverage_one_sided"),
        share("below").alias("below_lo"), share("above").alias("above_hi"),
        share("widened").alias("pct_widened"), (F.sum("pairs") / F.sum("n_rows")).alias("pairs_per_row"))


def family_spread(scores: DataFrame) -> DataFrame:
    """One-sided coverage per scheme and family: map, worst family, spread."""
    per = scores.groupBy("scheme", "family").agg((F.sum("ok_one") / F.sum("pairs")).alias("cov"))
    return per.groupBy("scheme").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("family", "cov")))).alias("by_family_one_sided"),
        F.min("cov").alias("worst_family_one_sided"),
        F.min_by("family", F.struct("cov", "family")).alias("worst_family_name"),
        (F.max("cov") - F.min("cov")).alias("spread_one_sided"), F.count("*").alias("n_families_tested"))


# ------------------------------------------------------------------ Mondrian fold engine


def mondrian_bands(train_sums: DataFrame, cal_hist: DataFrame, test_cells: DataFrame, alphas=(ALPHA,),
                   grouped=True, noise=None, backoff=True, overall=None) -> DataFrame:
    """Treatment-mean centre and per-treatment conformal quantile for every fold.

    train_sums (fold, scheme, s, n); cal_hist (fold, scheme, delta[, noise], n); test_cells (fold,
    scheme, ...); overall (fold, g_mean), taken from train_sums if those hold every treatment. One row per
    (test cell, alpha) with yhat, q, backed_off, and q_marginal, the quantile without groups.
    """
    mean = F.sum("s").cast("double") / F.sum("n")
    means = train_sums.groupBy("fold", "scheme").agg(mean.alias("s_mean"))
    if overall is None:
        overall = train_sums.groupBy("fold").agg(mean.alias("g_mean"))
    score = F.abs(F.col("delta") - F.coalesce("s_mean", "g_mean"))
    if noise:
        score = score / F.col(noise)
    h = (cal_hist.join(means, ["fold", "scheme"], "left").join(overall, "fold")
         .select("fold", "scheme", score.alias("score"), "n"))
    # the marginal quantile is that of a treatment called *; ungrouped folds need no other
    level = F.explode(F.array("scheme", F.lit("*"))) if grouped else F.lit("*")
    h = h.select("fold", level.alias("scheme"), "score", "n")
    q = None
    for i, a in enumerate(alphas):
        one = kth_refined(h, ["fold", "scheme"], "score", lambda tot, a=a: conformal_rank(tot, a), name=f"_q{i}")
        q = one if q is None else q.join(one.drop("n"), ["fold", "scheme"])
    q = stage(q.select("fold", "scheme", F.array(*[F.coalesce(f"_q{i}", F.lit(INF)) for i in range(len(alphas))]).alias("q")))
    marginal = q.where("scheme = '*'").select("fold", F.col("q").alias("q_m"))
    out = test_cells.join(means, ["fold", "scheme"], "left").join(overall, "fold").join(marginal, "fold")
    if grouped:
        out = out.join(q.where("scheme <> '*'").withColumnRenamed("q", "q_g"), ["fold", "scheme"], "left")
    else:
        out = out.withColumn("q_g", F.col("q_m"))
    out = out.select(*test_cells.columns, F.coalesce("s_mean", "g_mean").alias("yhat"), "q_m", "q_g",
                     F.posexplode(F.array(*[F.lit(float(a)) for a in alphas])).alias("_i", "alpha"))
    q_g, q_m = F.coalesce(F.get("q_g", F.col("_i")), F.lit(INF)), F.get("q_m", F.col("_i"))
    back = ~finite(q_g) & F.lit(backoff and grouped)
    out = out.withColumns({"backed_off": back, "q": F.when(back, q_m).otherwise(q_g), "q_marginal": q_m})
    return out.drop("q_m", "q_g", "_i")


def family_mondrian(df: DataFrame, families, n_cal=1, alphas=(ALPHA,), grouped=True, noise=None,
                    min_cal=MIN_FOLD_CAL, min_train=MIN_FOLD_TRAIN, extra=()):
    """(hist, bands): Mondrian bands of every family fold and the histogram they are scored on.

    ``extra`` keys split the whole protocol (for example a preprocessing variant).
    """
    values = ["delta"] + ([noise] if noise else [])
    hist = stage(df.groupBy(*extra, "family", "scheme", *values).agg(F.count("*").alias("n")))
    folds = held_out(df.sparkSession, families, n_cal)
    tag = F.concat_ws("|", *extra, "fold")
    cells = stage(of_families(family_cells(hist, *extra, "scheme"), folds))
    join = lambda t, role, *cols: t.join(_role(folds, role, *cols), "family").withColumn("fold", tag)
    rest = lambda keys: train_sums(cells, folds, keys, split=extra).select(tag.alias("fold"), *keys, "s", "n")
    overall = stage(rest(()).select("fold", _mean().alias("g_mean"), F.col("n").alias("n_train")))
    n_cal = join(cells, "cal").groupBy("fold").agg(F.sum("n").alias("n_cal"))
    ok = (n_cal.join(overall, "fold")
          .where((F.col("n_cal") >= min_cal) & (F.col("n_train") >= min_train)).select("fold"))
    test = (join(cells, "test", "cal_family").join(ok, "fold", "left_semi")
            .select("fold", *extra, "family", "cal_family", "scheme"))
    bands = mondrian_bands(rest(("scheme",)), join(hist, "cal"), test, alphas, grouped, noise, overall=overall.drop("n_train"))
    return hist, stage(bands)


def score_histogram(hist: DataFrame, bands: DataFrame, keys=("family", "scheme"), noise=None, eps=EPS) -> DataFrame:
    """Bands applied to a test histogram; every row carries its weight ``n``."""
    s = hist.join(bands, list(keys))
    half = F.col("q") * F.col(noise) if noise else F.col("q")
    s = s.withColumn("half_width", half).withColumns(
        {"lo": F.col("yhat") - F.col("half_width"), "hi": F.col("yhat") + F.col("half_width")})
    return s.withColumn("covered", inside("delta", "lo", "hi", eps))


def evaluate(scored: DataFrame, *keys) -> DataFrame:
    """Interval quality of weighted scored rows per configuration key, overall and per fold."""
    n = F.col("n")
    err = F.col("delta") - F.col("yhat")
    fin = finite("half_width")
    w = lambda c: F.sum(c.cast("double") * n) / F.sum(n)
    rows = scored.groupBy(*keys).agg(
        F.sum("n").alias("n_rows"), w(F.col("covered")).alias("coverage"),
        (F.sum(F.when(fin, F.col("half_width") * n)) / F.sum(F.when(fin, n))).alias("mean_half_width"),
        w(F.abs(err)).alias("mae"), F.sqrt(w(err * err)).alias("rmse"),
        (1 - F.sum(err * err * n) / (F.sum(F.col("delta") * F.col("delta") * n)
                                     - F.pow(F.sum(F.col("delta") * n), 2) / F.sum(n))).alias("r2"),
        w((F.col("lo") > 0) | (F.col("hi") < 0)).alias("share_excluding_zero"),
        w(~fin).alias("share_infinite"), w(F.col("backed_off")).alias("share_backoff"))
    median = percentile_refined(scored.where(fin), keys, "half_width", 0.5, name="median_half_width")
    rows = rows.join(median, list(keys), "left")
    per_fold = scored.groupBy(*keys, "fold").agg(w(F.col("covered")).alias("c"))
    folds = per_fold.groupBy(*keys).agg(
        F.count("*").alias("n_folds"), F.avg("c").alias("mean_per_fold_coverage"),
        F.min("c").alias("worst_fold_coverage"), F.min_by("fold", F.struct("c", "fold")).alias("worst_fold"))
    return rows.join(folds, list(keys))


def row_split_bands(rows: DataFrame, alphas=(ALPHA,)):
    """(hist, bands) for rows already assigned a (fold, role): one histogram serves all roles."""
    hist = stage(rows.groupBy("fold", "role", "scheme", "delta").agg(F.count("*").alias("n")))
    part = lambda r: hist.where(F.col("role") == r)
    sums = part("train").groupBy("fold", "scheme").agg(F.sum(F.col("delta") * F.col("n")).alias("s"), F.sum("n").alias("n"))
    bands = mondrian_bands(sums, part("cal").drop("role"), part("test").select("fold", "scheme").distinct(), alphas)
    return hist, stage(bands)
