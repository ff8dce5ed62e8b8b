"""Writers. Every table goes out partitioned and in parallel; nothing passes through the driver."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from pairmeter.plans.local import constant_table


def write_corpus(rows: DataFrame, rejects: DataFrame, path: str) -> None:
    """Observations (partitioned by family) and the reject log of one extraction, side by side."""
    rows.write.mode("overwrite").partitionBy("family").parquet(f"{path}/observations")
    rejects.write.mode("overwrite").parquet(f"{path}/rejects")


def write_artifact(df: DataFrame, path: str, fmt="json") -> None:
    """A result table; json and parquet keep nested structs."""
    df.write.mode("overwrite").format(fmt).save(path)


def write_census(fates: DataFrame, dropped: DataFrame, path: str, name="training") -> None:
    """Per-document fates and per-row drops, tagged with the set they describe."""
    fates.withColumn("set", F.lit(name)).write.mode("append").parquet(f"{path}/census_models")
    dropped.withColumn("set", F.lit(name)).write.mode("append").parquet(f"{path}/census_rows")


def log_requests(requests: DataFrame, path: str) -> bool:
    """Append (timestamp_utc, schemes, size_band, moe, refused_cells); list columns become sorted
    pipe-joined strings. A logging failure never fails the query it records."""
    join = lambda c: F.array_join(F.sort_array(c), "|")
    try:
        requests.select(
            F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("timestamp_utc"),
            join("schemes").alias("schemes"), F.coalesce("size_band", F.lit("")).alias("size_band"), "moe",
            join("refused_cells").alias("refused_cells")).write.mode("append").parquet(path)
        return True
    except Exception:  # noqa: BLE001
        return False


def log_request(spark: SparkSession, path, schemes, band=None, moe=False, refused=()) -> bool:
    one = constant_table(spark, {"schemes": [list(schemes)], "size_band": [band or ""], "moe": [moe],
                                 "refused_cells": [[str(x) for x in refused] or [""]]})
    return log_requests(one, path)
