"""Running totals over groups of any size, without a window over a whole group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import cut, small


def running_total(rows: DataFrame, group: str, order: list[str], value: str, out: str = "total") -> DataFrame:
    """``rows`` (narrow ones: all their columns are shuffled) with ``out``: the sum of ``value`` over rows of the group up to this one.

    Parallel prefix sums: rows are dealt by ranges of (group, order), so a large group lies in many neighbouring partitions and a partition holds
    a stretch of one group or several. Each stretch is summed by itself, and the stretches' sums, one row for each group and partition, give every
    stretch its offset. ``order`` tells the rows of a group apart; rows that it does not tell apart are taken in any order. A null value counts as 0.
    """
    spark = rows.sparkSession
    dealt = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), group, *order)
    dealt = cut(dealt.withColumn("__part", F.spark_partition_id()))
    stretch = [group, "__part"]
    sums = dealt.groupBy(*stretch).agg(F.coalesce(F.sum(value), F.lit(0)).alias("__sum"))
    before = F.sum("__sum").over(W.partitionBy(group).orderBy("__part").rowsBetween(W.unboundedPreceding, -1))
    offsets = cut(sums.select(*stretch, F.coalesce(before, F.lit(0)).alias("__offset")))
    own = F.sum(F.coalesce(value, F.lit(0))).over(W.partitionBy(*stretch).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return dealt.withColumn(out, own).join(small(offsets, 64), stretch).withColumn(out, F.col(out) + F.col("__offset")).drop("__part", "__offset")
