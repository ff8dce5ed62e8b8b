"""The append-only request log followed as a stream.

The log is the one input that grows while being read, so its rollup is also available
incrementally; the batch form is ``operators.verdicts.demand``.
"""

from pyspark.sql import DataFrame, SparkSession

from pairmeter.operators.verdicts import demand
from pairmeter.sources.schemas import REQUEST_LOG


def follow_demand(spark: SparkSession, log_path: str) -> DataFrame:
    """Running request and refusal counts per scheme (use output mode ``complete``)."""
    return demand(spark.readStream.schema(REQUEST_LOG).parquet(log_path))
