"""Tables in the folder that driver and executors share: lineage ends there, and what is written outlives executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where the session names none, a folder of the warehouse, or on a local master a temporary one. The session's
    settings are only read."""
    if found := spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir():
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/folioflow-cuts"
    return tempfile.mkdtemp(prefix="folioflow-")


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a table or folder, if there is one."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


class Cuts:
    """Tables of one piece of work, in a folder of their own under the application's id. They live until close(), as lazy results read
    them; what an application leaves behind can be deleted once it has ended."""

    def __init__(self, spark: SparkSession, kind: str):
        self.spark, self.folder = spark, f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{kind}-{uuid.uuid4().hex}"

    def write(self, name: str, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            remove(self.spark, f"{self.folder}/{name}")

    def close(self) -> None:
        remove(self.spark, self.folder)
