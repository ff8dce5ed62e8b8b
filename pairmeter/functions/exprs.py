"""Column expressions: bands, flags, noise scale, coverage indicators, features."""

from pyspark.sql import Column, DataFrame, functions as F

from pairmeter.functions import vocab

EPS = 1e-9  # a boundary point counts as inside


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def md5_int(*parts) -> Column:
    """60 bits of the MD5 of the parts joined by colons: a seeded hash that any SQL engine repeats."""
    key = F.concat_ws(":", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long")


def r6(col) -> Column:
    """Six-place rounding for reported aggregates."""
    return F.round(_c(col), 6)


def size_band(params_b) -> Column:
    p = _c(params_b)
    return (F.when(p.isNull() | F.isnan(p), "unknown").when(p < 2, "<2B")
            .when(p <= 10, "2-10B").otherwise(">10B"))


def is_moe(name) -> Column:
    return F.coalesce(_c(name).rlike(vocab.MOE_PATTERN), F.lit(False))


def annotate(df: DataFrame) -> DataFrame:
    return df.withColumns({"band": size_band("params_b"), "moe": is_moe("base_model")}).withColumn(
        "stratum", F.concat("scheme", F.lit(" | "), "band"))


def noise_scale(acc_before="acc_before", n_items="n_items") -> Column:
    """Standard error of a delta if both runs were independent binomial samples, in points."""
    p = F.least(F.greatest(_c(acc_before) / 100.0, F.lit(1e-3)), F.lit(1 - 1e-3))
    return 100.0 * F.sqrt(2.0 * p * (1 - p) / _c(n_items))


def inside(value, lo, hi, eps=EPS) -> Column:
    return (_c(value) >= _c(lo) - eps) & (_c(value) <= _c(hi) + eps)


def at_or_above(value, lo, eps=EPS) -> Column:
    return _c(value) >= _c(lo) - eps


def feature_columns(tasks=vocab.TASK_LEVELS, methods=vocab.METHOD_LEVELS) -> dict:
    """Named features. One-hots come from the fixed vocabulary, so train and test agree."""
    wb, ab, before = F.col("weight_bits"), F.col("act_bits"), F.col("acc_before")
    out = {
        "log2_weight_compression": F.log2(16.0 / wb),
        "log2_act_compression": F.log2(16.0 / ab),
        "exp_neg_weight_bits": F.exp(-wb / 4.0),
        "acts_quantized": (ab < 16).cast("double"),
        "num_type_int": (F.col("num_type") == "int").cast("double"),
        "act_scale_dynamic": (F.col("scheme") == "fp8_dynamic").cast("double"),
        "log10_params_b": F.log10("params_b"),
        "is_instruct": F.col("is_instruct").cast("double"),
        "acc_before_share": before / 100.0,
        "headroom_var": before * (100.0 - before) / 10000.0,
        "analytic_noise_pp": noise_scale(),
    }
    for t in tasks:
        out[f"bench={t}"] = (F.col("benchmark") == t).cast("double")
    for m in methods:
        out[f"method={m}"] = (F.col("method") == m).cast("double")
    return out


def cohort_label(name, ordered_tokens, fallback) -> Column:
    """First listed token contained in the last path part of the name, else the fallback."""
    leaf = F.lower(F.element_at(F.split(_c(name), "/"), -1))
    return F.coalesce(*[F.when(leaf.contains(t), F.lit(t)) for t in ordered_tokens], _c(fallback))


def resolve_alias(name, aliases=vocab.ALIASES) -> Column:
    key = F.translate(F.lower(F.trim(_c(name))), "-", "_")
    table = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
    return F.try_element_at(table, key)
