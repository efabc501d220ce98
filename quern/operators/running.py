"""Running totals of keys with any number of rows: no task sorts a whole key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def running_total(rows: DataFrame, key: str, block: Column, order: list[Column], value: Column, to: str, descending: bool = False) -> DataFrame:
    """Adds the total of the value over the rows of the key up to each row, itself included.

    ``block`` cuts the order into stretches (such as an hour of a time): it must not fall (or rise, if ``descending``)
    along the order. Totals of blocks are summed in parts before they are exchanged; only the rows of one key and block
    are sorted together. Null blocks come first in either direction, so that the order must put their rows first too.
    """
    cut = rows.withColumns({"_block": block, "_value": value})
    sums = cut.groupBy(key, "_block").agg(F.sum("_value").alias("_sum"))
    along = F.desc_nulls_first("_block") if descending else F.asc_nulls_first("_block")
    before = F.sum("_sum").over(Window.partitionBy(key).orderBy(along).rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select(F.col(key).alias("_key"), F.col("_block").alias("_cut"), F.coalesce(before, F.lit(0)).alias("_before"))
    own = F.sum("_value").over(Window.partitionBy(key, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    both = cut.withColumn("_own", own).join(sums, F.col(key).eqNullSafe(F.col("_key")) & F.col("_block").eqNullSafe(F.col("_cut")))
    return both.withColumn(to, F.coalesce("_own", F.lit(0)) + F.col("_before")).drop("_block", "_value", "_own", "_key", "_cut", "_before")
