"""Small constant tables (fold definitions, grids) whose exact size the planner can see."""

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def constant_table(spark: SparkSession, columns: dict) -> DataFrame:
    return spark.createDataFrame(pa.table(columns))
