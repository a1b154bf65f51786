"""Running totals inside groups of any size, by sums of ranges: no group is one task's work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.sources.cuts import Cuts


def running_total(rows: DataFrame, group: list[str], order: list[str], amount: Column, name: str = "total", cuts: Cuts | None = None) -> DataFrame:
    """[DT19] rows with a column of this name: the amounts of the group's rows up to this one, by order (which should tell rows apart).

    Two levels: rows are dealt by ranges of (group, order), so a large group lies in many tasks; the ranges' sums are added up over
    the group, a number for each range; inside a range the rows are added up and what came before is put on top. A null amount counts as none."""
    spark = rows.sparkSession
    cuts = cuts or Cuts(spark, "running-total")
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.withColumn("_amount", F.coalesce(amount, F.lit(0))).repartitionByRange(n, *group, *order).withColumn("_range", F.spark_partition_id())
    dealt = cuts.write("ranges", dealt)
    key = F.struct(*group)
    sums = dealt.groupBy(key.alias("_group"), "_range").agg(F.sum("_amount").alias("_sum"))
    before = Window.partitionBy("_group").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as ranges
    heads = sums.select("_group", F.col("_range").alias("_of"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy(*group, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    own = dealt.withColumn("_within", F.sum("_amount").over(within))
    joined = own.join(heads, (F.col("_range") == F.col("_of")) & key.eqNullSafe(F.col("_group")))
    return joined.select(*rows.columns, (F.col("_before") + F.col("_within")).alias(name))
