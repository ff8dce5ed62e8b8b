"""From coverage evidence to verdicts, flags, tiers and a ranking."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from pairmeter.functions.exprs import EPS, resolve_alias
from pairmeter.operators import conformal as C
from pairmeter.operators import folds as E
from pairmeter.operators import resample as U
from pairmeter.plans.staging import stage

# Thresholds of the protocol.
SEVERE_RATE = 0.02
THIN_ROWS = 80
THIN_FAMILIES = 4
REFUSE_BELOW = 0.85
MIN_CLUSTERS = 3
DEFAULT_RISK = 3.0
CELL_DRAWS = 20_000
SCHEME_DRAWS = 200_000
RISK_GRID = [1.0, 1.5, 2.0, 2.5, 3.0, 3.5, 4.0, 4.5, 5.0]
TRUSTED, INSUFFICIENT, REFUSED = "trusted", "insufficient_evidence", "refused"


def classify(clusters="distinct_checkpoints", one_sided="coverage_one_sided", two_sided="coverage",
             lo="boot90_lo", hi="boot90_hi") -> Column:
    """The shared evidence classifier. The cluster floor comes first; a missing field is never
    trusted; bounds are compared unrounded."""
    judged = F.coalesce(F.col(one_sided), F.col(two_sided))
    line = REFUSE_BELOW * 100
    return (F.when(F.col(clusters).isNull() | (F.col(clusters) < MIN_CLUSTERS), INSUFFICIENT)
            .when(judged.isNull(), INSUFFICIENT)
            .when(F.col(lo).isNull() | F.col(hi).isNull(), INSUFFICIENT)
            .when((F.col(lo) < line) & (F.lit(line) < F.col(hi)), INSUFFICIENT)
            .when(judged < REFUSE_BELOW, REFUSED).otherwise(TRUSTED))


def degenerate(lo="boot90_lo", hi="boot90_hi") -> Column:
    """Bounds that collapsed onto one value say nothing; the figure is suppressed."""
    return F.coalesce(F.col(lo) == F.col(hi), F.lit(False))


def evidence(scores: DataFrame, cell_draws=CELL_DRAWS, scheme_draws=SCHEME_DRAWS) -> DataFrame:
    """Coverage record per scheme (band ``*``) and per cell, with 90% bounds and state.

    Bounds are the cluster bootstrap's: exact up to eight clusters, above that the seeded Monte Carlo's at
    the protocol's draws, more of them for a scheme.
    """
    t = E.coverage_table(scores).where("level in ('scheme', 'cell')")
    per = (scores.select(F.explode(F.array(F.lit("*"), F.col("band"))).alias("band"), "scheme", "base_model", "ok_one", "pairs")
           .groupBy("scheme", "band", "base_model").agg(F.sum("ok_one").alias("ok"), F.sum("pairs").alias("n")))
    keys = ["scheme", "band"]
    b = U.bounds(stage(per), keys, draws=F.when(F.col("band") == "*", scheme_draws).otherwise(cell_draws))
    t = t.join(b, keys, "left").withColumnsRenamed({"boot_lo": "boot90_lo", "boot_hi": "boot90_hi"})
    return t.withColumns({"state": classify(), "degenerate": degenerate()})


def severe_rates(hist: DataFrame, grid=RISK_GRID) -> DataFrame:
    """Share of rows with delta < -t for every t of the grid, as a map, per scheme."""
    n = F.sum("n")
    below = lambda t: F.sum(F.when(F.col("delta") < -t, F.col("n")).otherwise(0))
    pairs = [x for t in grid for x in (F.lit(str(float(t))), below(t) / n)]
    return hist.groupBy("scheme").agg(n.alias("n_rows"), F.create_map(*pairs).alias("severe_rate"),
                                      below(3.0).alias("n_severe_3pp"))


def size_gradient(hist: DataFrame, sup: DataFrame, min_rows=5) -> DataFrame:
    h = hist.groupBy("scheme", "band").agg(
        F.sum("n").alias("n"), (F.sum(F.col("delta") * F.col("n")) / F.sum("n")).alias("mean"), F.min("delta").alias("worst"))
    k = sup.groupBy("scheme", "band").agg(F.countDistinct("base_model").alias("checkpoints"))
    return h.where(F.col("n") >= min_rows).where("band <> 'unknown'").join(k, ["scheme", "band"])


def scheme_bands(model: DataFrame, *cols) -> DataFrame:
    """Scheme rows of a shipped model; a scheme without a band of its own shows the global one."""
    g = model.where("level = 'global'")
    return model.where("level = 'scheme'").select(
        "scheme", F.coalesce("mean", g.select("mean").scalar()).alias("mean"),
        F.coalesce("half_width", g.select("half_width").scalar()).alias("half_width"), *cols)


def assemble(hist: DataFrame, sup: DataFrame, records: DataFrame, model: DataFrame, risk=DEFAULT_RISK,
             band=None, moe=False, aggressive=("w4a16", "nvfp4"), support_floor=True) -> DataFrame:
    """One row per scheme with flags and tier for a question (risk threshold, size band, moe).

    A scheme without a coverage record is insufficient evidence: what is missing is never trusted.
    """
    if risk not in RISK_GRID:
        raise ValueError(f"risk {risk} is not on the grid {RISK_GRID}")
    base = scheme_bands(model, "worst", "p05", "n", "n_checkpoints", "n_families")
    base = base.join(severe_rates(hist).drop("n_rows"), "scheme")
    whole = records.where("band = '*'").select(
        "scheme", F.col("state").alias("scheme_state"), F.col("coverage_one_sided").alias("scheme_one_sided"))
    t = base.join(whole, "scheme", "left").withColumn("scheme_state", F.coalesce("scheme_state", F.lit(INSUFFICIENT)))
    no = F.lit(False)
    cell_state, size_risk, thin_cell = F.lit(None).cast("string"), no, no
    if band is not None:
        cell = records.where(F.col("band") == band).select("scheme", F.col("state").alias("cell_state"))
        train = (sup.where(F.col("band") == band).groupBy("scheme")
                 .agg(F.countDistinct("base_model").alias("cell_clusters"), F.sum("n").alias("cell_rows")))
        t = t.join(cell, "scheme", "left").join(train, "scheme", "left")
        cell_state = F.coalesce("cell_state", F.lit(INSUFFICIENT))
        size_risk = (F.lit(band == "<2B") & F.col("scheme").isin(*aggressive) & (F.coalesce("cell_rows", F.lit(0)) >= 5))
        thin_cell = F.col("cell_clusters") < MIN_CLUSTERS
        if not support_floor:
            thin_cell = no
    rate = F.element_at("severe_rate", F.lit(str(float(risk))))
    flag = lambda cond, name: F.when(cond, F.lit(name))
    whole_bad = F.col("scheme_state") == INSUFFICIENT
    flags = F.array_compact(F.array(
        flag((cell_state == INSUFFICIENT) | whole_bad, "INSUFFICIENT_EVIDENCE"),
        flag(cell_state == REFUSED, "INSUFFICIENT_CALIBRATION"),
        flag(rate > SEVERE_RATE, "TAIL_RISK"),
        flag((F.col("n") < THIN_ROWS) | (F.col("n_families") < THIN_FAMILIES), "THIN_DATA"),
        flag(F.col("scheme_state") == REFUSED, "UNDERCOVERED"),
        flag(size_risk, "SIZE_RISK"), flag(thin_cell, "THIN_CELL_SUPPORT"),
        flag(F.lit(moe), "MOE_UNVALIDATED")))
    t = t.withColumns({"severe_rate_used": rate, "flags": flags})
    return t.withColumn("tier", tier("flags"))


def tier(flags) -> Column:
    severe = F.array(*[F.lit(x) for x in ("INSUFFICIENT_CALIBRATION", "INSUFFICIENT_EVIDENCE", "TAIL_RISK", "UNDERCOVERED")])
    return F.when(F.arrays_overlap(flags, severe), "C").when(F.size(flags) > 0, "B").otherwise("A")


def ranked(entries: DataFrame) -> DataFrame:
    """Tier, then narrower interval, then milder worst case. One row per scheme, so one task."""
    order = Window.partitionBy(F.lit(0)).orderBy("tier", "half_width", F.desc("worst"), "scheme")
    return entries.withColumn("rank", F.row_number().over(order))


def answer(entries: DataFrame, requested, aliases=None):
    """(ranked entries for the requested names, names that resolve to nothing)."""
    spark = entries.sparkSession
    from pairmeter.plans.local import constant_table
    ask = constant_table(spark, {"requested_as": list(requested)})
    ask = ask.withColumn("scheme", resolve_alias("requested_as") if aliases is None
                         else resolve_alias("requested_as", aliases))
    hit = ask.join(entries, "scheme")
    unknown = ask.join(entries.select("scheme"), "scheme", "left_anti").select("requested_as")
    return ranked(hit), unknown


def band_verdicts(records: DataFrame, bands) -> DataFrame:
    """State per scheme and size band; ``not_measured`` where no cell exists."""
    schemes = records.where("band = '*'").select("scheme")
    grid = schemes.select("scheme", F.explode(F.array(*[F.lit(b) for b in bands])).alias("band"))
    cells = records.where("band <> '*'").select("scheme", "band", "state", "distinct_checkpoints", "distinct_rows",
                                                "coverage_one_sided", "boot90_lo", "boot90_hi", "degenerate")
    return grid.join(cells, ["scheme", "band"], "left").withColumn("state", F.coalesce("state", F.lit("not_measured")))


def widened_bands(model: DataFrame) -> DataFrame:
    """(scheme, widened_bands): the size bands, sorted, whose own interval is wider than the scheme's shown one;
    an empty array where no band is."""
    wide = widened_cells(model).groupBy("scheme").agg(F.sort_array(F.collect_set("band")).alias("_w"))  # a scheme's bands are few
    t = scheme_bands(model).select("scheme").join(wide, "scheme", "left")
    return t.select("scheme", F.coalesce("_w", F.array().cast("array<string>")).alias("widened_bands"))


def ranking_inputs(df: DataFrame, families, is_cal, cell_draws=CELL_DRAWS, scheme_draws=SCHEME_DRAWS):
    """Everything a ranking question needs, written once: (hist, sup, records, model)."""
    hist, sup = C.reduce_rows(df, is_cal=is_cal)
    model = stage(C.fit_shipped(hist, sup))
    records = stage(evidence(E.pair_cluster_scores(df, families), cell_draws, scheme_draws))
    return hist, sup, records, model


def widened_cells(model: DataFrame) -> DataFrame:
    """Kept strata wider than the interval their scheme shows, its own or the global one."""
    s = scheme_bands(model).select("scheme", F.col("half_width").alias("s_hw"))
    t = model.where("level = 'stratum' and half_width is not null").select("scheme", "band", "half_width")
    return t.join(s, "scheme").where(F.col("half_width") > F.col("s_hw")).select("scheme", "band")


def facts(hist: DataFrame, sup: DataFrame, records: DataFrame, model: DataFrame, risk=DEFAULT_RISK) -> DataFrame:
    """Counts quoted beside every ranking, recomputed from the inputs."""
    s = scheme_bands(model).select("scheme", (F.col("mean") - F.col("half_width")).alias("lo"),
                                   (F.col("mean") + F.col("half_width")).alias("hi"))
    big = hist.where(F.col("delta") < -risk).join(s, "scheme")
    state = lambda x: F.coalesce(F.sum((F.col("state") == x).cast("long")), F.lit(0))
    one = lambda df, expr: df.agg(expr.alias("v")).scalar()
    t = sup.agg(F.sum("n").alias("n_rows"), F.countDistinct("base_model").alias("n_checkpoints"),
                F.countDistinct("family").alias("n_families"))
    cells = records.where("band <> '*'")
    n_schemes, n_wide = one(s, F.count("*")), one(widened_cells(model), F.count("*"))
    return t.withColumns({
        "n_schemes": n_schemes,
        "intervals_excluding_zero": one(s.where("not (lo <= 0 and 0 <= hi)"), F.count("*")),
        "n_big_losses": one(big, F.coalesce(F.sum("n"), F.lit(0))),
        "n_big_losses_below_floor": one(big.where(F.col("delta") < F.col("lo") - EPS), F.coalesce(F.sum("n"), F.lit(0))),
        "n_size_dependent_widths": n_wide, "n_numbers_in_predictor": 2 * n_schemes + n_wide,
        "cells_trusted": one(cells, state(TRUSTED)), "cells_refused": one(cells, state(REFUSED)),
        "cells_insufficient": one(cells, state(INSUFFICIENT))})


def envelope(hist: DataFrame, model: DataFrame, records: DataFrame, spread: DataFrame) -> DataFrame:
    """The published artifact: one nested row per scheme."""
    h = hist.groupBy("scheme", "delta").agg(F.sum("n").alias("n"))
    emp = C.empirical_band(h, ["scheme"], clamp=True).drop("n")
    med = h.groupBy("scheme").agg(F.percentile("delta", F.lit(0.5), F.col("n")).alias("median_delta"))
    base = scheme_bands(model, F.col("n").alias("n_observations"), "n_checkpoints", "n_families",
                        F.col("worst").alias("worst_observed")).withColumnRenamed("mean", "mean_delta")
    rec = records.where("band = '*'").select("scheme", "state", "coverage_one_sided", "coverage", "boot90_lo", "boot90_hi",
                                             "distinct_rows", "distinct_checkpoints", "scored_pairs")
    t = base.join(emp, "scheme").join(med, "scheme").join(rec, "scheme", "left").join(spread, "scheme", "left")
    lo, hi = F.col("mean_delta") - F.col("half_width"), F.col("mean_delta") + F.col("half_width")
    worst = F.col("worst_family_one_sided")
    warning = F.when(worst < REFUSE_BELOW, F.concat(
        F.lit("measured coverage falls to "), F.round(100 * worst).cast("int"), F.lit("% on held-out family '"),
        F.col("worst_family_name"), F.lit("', over "), F.col("n_families"), F.lit(" families of evidence")))
    return t.select(
        "scheme", "n_observations", "n_checkpoints", "n_families", "mean_delta", "median_delta", "half_width",
        F.struct(lo.alias("lo"), hi.alias("hi")).alias("interval"),
        F.struct(F.col("emp_lo").alias("lo"), F.col("emp_hi").alias("hi")).alias("empirical"), "worst_observed",
        F.struct(F.col("state"), F.col("coverage_one_sided").alias("one_sided"), F.col("coverage").alias("two_sided"),
                 F.array("boot90_lo", "boot90_hi").alias("bootstrap_90"), F.col("distinct_rows").alias("rows"),
                 F.col("distinct_checkpoints").alias("checkpoints"), "scored_pairs",
                 F.col("worst_family_name").alias("worst_family"), "worst_family_one_sided",
                 F.col("by_family_one_sided")).alias("coverage"),
        (~((lo <= 0) & (hi >= 0))).alias("excludes_zero"), warning.alias("warning"))


def demand(log: DataFrame) -> DataFrame:
    """Requests and refusals per scheme, from the pipe-joined lists of the request log."""
    asked = log.select(F.explode(F.split("schemes", r"\|")).alias("scheme"),
                       (F.coalesce("refused_cells", F.lit("")) != "").alias("refused"))
    return asked.groupBy("scheme").agg(F.count("*").alias("n_requests"), F.sum(F.col("refused").cast("long")).alias("n_refused"))
