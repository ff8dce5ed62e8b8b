"""Written intermediate tables.

A fitted model is joined back to the rows it was fitted on. Writing it first cuts the lineage in a
way that survives lost executors, and gives Catalyst the true size of the table: it then broadcasts
the table only when that size is under ``spark.sql.autoBroadcastJoinThreshold`` and shuffles
otherwise. No broadcast hint is given anywhere in the package.
"""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
_OWN = set()


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by the session; a local one only if the session names none."""
    path = spark.conf.get(_SETTING, None)
    if not path:
        path = spark.sparkContext.getConf().get(_SETTING, None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {_SETTING} to a folder every executor can reach")
        path = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set(_SETTING, path)
    return path.rstrip("/")


def session_dir(spark: SparkSession) -> str:
    """This application's own folder below the shared one; it goes when the application ends."""
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}"
    if path not in _OWN:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(where)
        fs.deleteOnExit(where)
        _OWN.add(path)
    return path


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the application's folder and return the written table."""
    spark = df.sparkSession
    path = f"{session_dir(spark)}/staged-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
