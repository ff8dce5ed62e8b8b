"""Views that give the TPC-H-like test tables the shape of the observation corpus.

Each Spark view has a DuckDB twin (a common table expression) beside it, so the oracle reads the
same tables through the same definition.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F

from pairmeter.functions import exprs

BASELINE_FLOOR = 20.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fold keys, from the dimension table that defines them."""
    return table(spark, sf_dir, "region").select(F.col("r_name").alias("family")).distinct()


def _by_scheme(values):
    out = None
    for name, value in values.items():
        cond = F.col("scheme") == name
        out = F.when(cond, F.lit(value)) if out is None else out.when(cond, F.lit(value))
    return out


EFFECT = {"af": 0.25, "ao": 0.5, "rf": 0.75, "nf": 1.0, "ro": 1.5, "no": 2.0}
WEIGHT_BITS = {"af": 8, "ao": 8, "rf": 4, "nf": 4, "ro": 8, "no": 4}
ACT_BITS = {"af": 16, "ao": 8, "rf": 16, "nf": 4, "ro": 8, "no": 16}
NEAR_LOSSLESS = ("af", "ao")
FOUR_BIT = ("nf", "no")


#: Two treatments are kept thin by relabelling most of their rows as the next harsher one; no row is left out.
SCHEME_SQL = """CASE WHEN l_returnflag || l_linestatus = 'RF' AND l_suppkey % 10 <> 0 THEN 'nf'
  WHEN l_returnflag || l_linestatus = 'RO' AND r_name NOT IN ('EUROPE', 'AFRICA') THEN 'no' ELSE lower(l_returnflag || l_linestatus) END"""


def obs_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    sup = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nat = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    reg = table(spark, sf_dir, "region")
    d = (li.join(sup, F.col("l_suppkey") == F.col("s_suppkey"))
           .join(nat, F.col("s_nationkey") == F.col("n_nationkey"))
           .join(reg, F.col("n_regionkey") == F.col("r_regionkey"))
           .withColumn("scheme", F.expr(SCHEME_SQL)))
    before = 2 * F.col("l_quantity") - 1
    shift = (100 * (F.col("l_tax") - F.col("l_discount")) * _by_scheme(EFFECT)
             + (F.col("l_extendedprice") % 100) / 50 - 1)
    after = F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), before + shift)), 4)
    return d.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                    F.date_format("l_shipdate", "yyyyMMdd")).alias("obs_id"),
        F.concat(F.lit("S"), "l_suppkey", F.lit("/"), "scheme").alias("model"),
        F.concat(F.lit("S"), "l_suppkey").alias("base_model"),
        F.col("r_name").alias("family"),
        (F.col("l_suppkey") % 20 + 0.5).cast("double").alias("params_b"),
        (F.col("l_suppkey") % 2).cast("int").alias("is_instruct"),
        "scheme",
        _by_scheme(WEIGHT_BITS).cast("int").alias("weight_bits"),
        _by_scheme(ACT_BITS).cast("int").alias("act_bits"),
        F.when(F.col("scheme") == "nf", "fp").otherwise("int").alias("num_type"),
        F.when(F.col("l_suppkey") % 3 == 0, "gptq").when(F.col("l_suppkey") % 3 == 1, "rtn")
         .otherwise("awq").alias("method"),
        F.concat(F.lit("task"), "l_linenumber").alias("benchmark"),
        (F.col("l_quantity") * 20).cast("int").alias("n_items"),
        before.alias("acc_before"),
        after.alias("acc_after"),
        F.round(after - before, 4).alias("delta"),
        F.when(F.col("l_partkey") % 20 == 0, "header_only")
         .when(F.col("l_partkey") % 20 == 1, "header").otherwise("arith").alias("orient_src"),
        F.when(F.col("l_partkey") % 20 == 0, 0).otherwise(1).alias("verified"),
    )


def _case(values):
    return "CASE scheme " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in values.items()) + " END"


_BEFORE = "(2 * l_quantity - 1)"
_AFTER = (f"round(greatest(0::double, least(100::double, {_BEFORE} + (100 * (l_tax - l_discount) * "
          f"({_case(EFFECT)})::double + (l_extendedprice % 100) / 50 - 1))), 4)")

OBS_RAW_SQL = f"""
obs_src AS (
  SELECT l.*, r_name, {SCHEME_SQL} AS scheme
  FROM lineitem l JOIN supplier ON l_suppkey = s_suppkey
       JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
), obs_raw AS (
  SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-'
           || strftime(l_shipdate, '%Y%m%d') AS obs_id,
         'S' || l_suppkey || '/' || scheme AS model, 'S' || l_suppkey AS base_model,
         r_name AS family, (l_suppkey % 20)::double + 0.5::double AS params_b,
         (l_suppkey % 2)::int AS is_instruct, scheme,
         ({_case(WEIGHT_BITS)})::int AS weight_bits, ({_case(ACT_BITS)})::int AS act_bits,
         CASE WHEN scheme = 'nf' THEN 'fp' ELSE 'int' END AS num_type,
         CASE l_suppkey % 3 WHEN 0 THEN 'gptq' WHEN 1 THEN 'rtn' ELSE 'awq' END AS method,
         'task' || l_linenumber AS benchmark, (l_quantity * 20)::int AS n_items,
         {_BEFORE} AS acc_before, {_AFTER} AS acc_after,
         round({_AFTER} - {_BEFORE}, 4) AS delta,
         CASE l_partkey % 20 WHEN 0 THEN 'header_only' WHEN 1 THEN 'header' ELSE 'arith' END AS orient_src,
         CASE WHEN l_partkey % 20 = 0 THEN 0 ELSE 1 END AS verified
  FROM obs_src
)"""

BAND_CASE_SQL = ("CASE WHEN params_b IS NULL THEN 'unknown' WHEN params_b < 2 THEN '<2B' "
                 "WHEN params_b <= 10 THEN '2-10B' ELSE '>10B' END")

OBS_SQL = OBS_RAW_SQL + f""", obs AS (
  SELECT *, {BAND_CASE_SQL} AS band FROM obs_raw WHERE acc_before >= 20
)"""


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modelled observations: baseline floor applied, size band attached."""
    return (obs_raw(spark, sf_dir).where(F.col("acc_before") >= BASELINE_FLOOR)
            .withColumn("band", exprs.size_band("params_b")))


IS_CAL_SQL = "(CAST(substr(base_model, 2) AS INT) % 3 = 0)"


def is_calibration(col="base_model"):
    """Arithmetic stand-in for the hash-ordered cluster partition, so SQL can repeat it."""
    return F.substring(col, 2, 12).cast("int") % 3 == 0


RUNS_SQL = OBS_SQL + """, runs AS (
  SELECT model, base_model, family, scheme, params_b, band, benchmark,
         avg(acc_before) AS acc_before, avg(acc_after) AS acc_after, avg(delta) AS delta,
         count(*) AS n_rows, CASE WHEN scheme = 'af' THEN 1 ELSE 0 END AS is_control
  FROM obs GROUP BY ALL
)"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (unit, task); the mildest treatment is the control arm."""
    return (obs(spark, sf_dir)
            .groupBy("model", "base_model", "family", "scheme", "params_b", "band", "benchmark")
            .agg(F.avg("acc_before").alias("acc_before"), F.avg("acc_after").alias("acc_after"),
                 F.avg("delta").alias("delta"), F.count("*").alias("n_rows"))
            .withColumn("is_control", F.when(F.col("scheme") == "af", 1).otherwise(0)))


SCORES_SQL = OBS_SQL + """, scores AS (
    SELECT 'BASE::' || base_model AS row_key, base_model, NULL AS scheme, benchmark, avg(acc_before) AS score
    FROM obs GROUP BY base_model, benchmark
    UNION ALL
    SELECT 'QUANT::' || model, base_model, scheme, benchmark, avg(acc_after)
    FROM obs GROUP BY model, base_model, scheme, benchmark
)"""
