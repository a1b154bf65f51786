"""Tables of typed rows: reading stored words into types, looking up a key, appending, and writing a part anew."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def typed(rows: DataFrame, flags: list[str] = (), documents: dict[str, str] | None = None) -> DataFrame:
    """[SRC1] rows with 0/1 columns as booleans and JSON columns as the given types; JSON that can't be read is empty, never an error."""
    empty = {"m": "map()", "a": "array()"}
    parsed = {c: F.coalesce(F.from_json(c, t), F.expr(f"cast({empty[t[0]]} as {t})")) for c, t in (documents or {}).items()}
    return rows.withColumns({c: F.col(c).cast("boolean") for c in flags} | parsed)


def row_of(rows: DataFrame, key: str, value) -> DataFrame:
    """[SRC2] The row with this key, or none; the filter reaches the scan."""
    return rows.where(F.col(key) == F.lit(value)).limit(1)


def natural_id(*parts: str | Column) -> Column:
    """[SRC3] An id that the same natural key gives again, so that a repeated append can be told."""
    return F.xxhash64(*parts)


def append_new(rows: DataFrame, path: str, key: str) -> DataFrame:
    """[SRC3] Appends the rows whose key the table doesn't hold yet, and returns the table."""
    spark = rows.sparkSession
    stored = stored_rows(spark, path, rows)
    fresh = rows.dropDuplicates([key]).join(stored.select(key), key, "left_anti").select(rows.columns)
    fresh.write.mode("append").parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def stored_rows(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """The table at a path, empty where there is none yet."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
    return spark.read.schema(like.schema).parquet(path) if there else like.where("false")


def write_again(rows: DataFrame, path: str, part: str) -> DataFrame:
    """[SM9] Writes the parts (values of `part`) that rows hold anew, and leaves the table's other parts: reading a source twice gives it once."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(part).parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path).select(rows.columns)
