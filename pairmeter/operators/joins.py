"""Joins and set operations between row sets."""

from pyspark.sql import Column, DataFrame, functions as F

from pairmeter.functions.exprs import md5_int, noise_scale, size_band
from pairmeter.plans.local import constant_table


def strict_subset(df: DataFrame, seen_families: DataFrame, adapted_pattern: str) -> DataFrame:
    """Rows of unseen families, without the groups the reader was adapted to."""
    return df.where(~F.col("model").rlike(adapted_pattern)).join(seen_families, "family", "left_anti")


def normalise_external(ext: DataFrame, items: DataFrame) -> DataFrame:
    """External runs in the corpus layout: defaults for missing columns, item counts by task."""
    have = set(ext.columns)
    t = ext.join(items, "benchmark", "left")
    n_items = F.coalesce(F.col("n_items"), F.col("vocab_items")) if "n_items" in have else F.col("vocab_items")
    t = t.withColumns({"n_items": n_items, "delta": F.round(F.col("acc_after") - F.col("acc_before"), 4)}).drop("vocab_items")
    defaults = {"family": F.lit("adversarial"), "weight_bits": F.lit(None).cast("int"), "act_bits": F.lit(None).cast("int"),
                "num_type": F.lit("int"), "method": F.lit("adversarial"), "is_instruct": F.lit(0)}
    t = t.withColumns({k: v for k, v in defaults.items() if k not in have})
    return t.withColumns({"band": size_band("params_b"), "is_adversarial": F.lit(1), "verified": F.lit(0),
                          "orient_src": F.lit("measured_locally")})


def excess_over_control(runs: DataFrame) -> DataFrame:
    """Treated delta minus the control delta of the same (cluster, task)."""
    ctrl = runs.where("is_control = 1").select("base_model", "benchmark", F.col("delta").alias("ctrl_delta"))
    return runs.where("is_control = 0").join(ctrl, ["base_model", "benchmark"]).withColumn(
        "excess", F.col("delta") - F.col("ctrl_delta"))


def reference_drift(rows: DataFrame, corpus: DataFrame, limit=2.0) -> DataFrame:
    ref = corpus.groupBy("base_model", "benchmark").agg(F.avg("acc_before").alias("ref"))
    gap = F.abs(F.col("ref") - F.col("acc_before"))
    return rows.join(ref, ["base_model", "benchmark"]).withColumn("gap", gap).where(F.col("gap") > limit)


def overlap_audit(a: DataFrame, b: DataFrame) -> DataFrame:
    """Shared units, clusters, (unit, task) keys and families of two row sets."""
    out = None
    for kind, keys in (("unit", ["model"]), ("cluster", ["base_model"]), ("unit_task", ["model", "benchmark"]), ("family", ["family"])):
        n = a.select(*keys).intersect(b.select(*keys)).agg(F.lit(kind).alias("kind"), F.count("*").alias("shared"))
        out = n if out is None else out.unionByName(n)
    return out


def matched_pairs(own: DataFrame, published: DataFrame, key="model", max_gap=2.0) -> DataFrame:
    """Own against published delta on the same unit; refused where the baselines disagree."""
    t = own.join(published, key)
    t = t.withColumns({"gap": F.col("our_delta") - F.col("pub_delta"), "se": noise_scale("our_before", "n_items")})
    return t.withColumns({"z": F.col("gap") / F.col("se"),
                          "ratio": F.when(F.abs("pub_delta") > 1e-9, F.col("our_delta") / F.col("pub_delta")),
                          "refused": F.abs(F.col("our_before") - F.col("pub_before")) >= max_gap})


def feature_join(left: DataFrame, right: DataFrame, key):
    """(rows present on both sides, one-row coverage report)."""
    j = left.withColumn("_l", F.lit(1)).join(right.withColumn("_r", F.lit(1)), key, "full_outer")
    n = lambda c: F.sum(c.cast("long"))
    both = F.col("_l").isNotNull() & F.col("_r").isNotNull()
    report = j.agg(n(F.col("_r").isNull()).alias("left_only"), n(F.col("_l").isNull()).alias("right_only"), n(both).alias("both_sides"))
    return left.join(right, key), report


def paired_items(before: DataFrame, after: DataFrame, item, *keys) -> DataFrame:
    """Per-item correctness of two runs -> accuracies and flip rate."""
    t = before.join(after, item)
    share = lambda c: F.avg(c.cast("int"))
    return t.groupBy(*keys).agg(
        F.count("*").alias("n_items"), (100 * share(F.col("ok_before"))).alias("acc_before"),
        (100 * share(F.col("ok_after"))).alias("acc_after"), share(F.col("ok_before") != F.col("ok_after")).alias("flip_rate"))


def leak_count(test: DataFrame, *others: DataFrame) -> Column:
    """Families of the test side that also occur on another side; must be zero."""
    fams = test.select("family").distinct()
    seen = others[0].select("family")
    for o in others[1:]:
        seen = seen.unionByName(o.select("family"))
    return fams.join(seen, "family", "left_semi").agg(F.count("*")).scalar()


def hash_sample(df: DataFrame, key, n, seed=0) -> DataFrame:
    """The n rows with the smallest seeded key hash: a repeatable audit sample."""
    return df.withColumn("_h", md5_int(seed, F.col(key))).orderBy("_h", key).limit(n).drop("_h")


def gained_lost(base: DataFrame, other: DataFrame) -> DataFrame:
    """Rows of ``other`` not in ``base``, and the reverse; one pass over both sets."""
    tag = lambda d, name: d.distinct().withColumn("_side", F.lit(name))
    per = tag(base, "b").unionByName(tag(other, "o")).groupBy(*base.columns).agg(
        F.max((F.col("_side") == "b").cast("int")).alias("b"), F.max((F.col("_side") == "o").cast("int")).alias("o"))
    t = per.agg(F.sum((1 - F.col("b")) * F.col("o")).alias("gained"), F.sum((1 - F.col("o")) * F.col("b")).alias("lost"))
    t = t.na.fill(0)
    return t.withColumn("is_superset", F.col("lost") == 0)


def union_tagged(parts: dict) -> DataFrame:
    out = None
    for name, d in parts.items():
        t = d.withColumn("src", F.lit(name))
        out = t if out is None else out.unionByName(t, allowMissingColumns=True)
    return out


def vocabulary_difference(df: DataFrame, schemes, tasks) -> DataFrame:
    """Values outside the known sets; a new scheme warns, an unknown task fails."""
    spark = df.sparkSession
    known = constant_table(spark, {"kind": ["scheme"] * len(schemes) + ["task"] * len(tasks), "value": [*schemes, *tasks]})
    seen = df.select(F.explode(F.array(F.struct(F.lit("scheme").alias("kind"), F.col("scheme").alias("value")),
                                       F.struct(F.lit("task").alias("kind"), F.col("benchmark").alias("value")))).alias("v")).select("v.*").distinct()
    return seen.join(known, ["kind", "value"], "left_anti").withColumn(
        "severity", F.when(F.col("kind") == "scheme", "warn").otherwise("fail"))
