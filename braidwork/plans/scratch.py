"""Tables that cut lineage, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where none is named and all tasks run in the driver's process, as in tests, a local one."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="braidwork-"))
    return sc._jsc.sc().getCheckpointDir().get()


def materialize(df: DataFrame, name: str) -> DataFrame:
    """df written once to a table in the shared folder and read from there: lineage ends here, and any executor can read it again."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/braidwork/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    read = spark.read.schema(df.schema).parquet(path)
    read.scratch_path = path
    return read


def discard(*tables: DataFrame) -> None:
    """Deletes the tables that materialize has made; nothing may read them later. Other frames are left as they are."""
    for df in tables:
        path = getattr(df, "scratch_path", None)
        if path:
            sc = df.sparkSession.sparkContext
            place = sc._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(sc._jsc.hadoopConfiguration()).delete(place, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
