"""Dense numbers without one task that sorts everything."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.plans.stages import stage


def numbered(df: DataFrame, *order: str, column: str = "id", within: tuple[str, ...] = ()) -> DataFrame:
    """df with a number from 0 in the order of the columns, which should tell its rows apart; within: from 0 for each of these keys.

    The rows are sorted in ranges, so that a large key lies in several; what the ranges before hold is added to the
    place within a range.
    """
    part = stage(df.repartitionByRange(*within, *order).withColumn("_part", F.spark_partition_id()), "numbered")
    running = Window.partitionBy(*within).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    before = part.groupBy(*within, "_part").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(running), F.lit(0))).drop("_n")
    rank = F.row_number().over(Window.partitionBy(*within, "_part").orderBy(*order)) - 1
    key = ["_part", *within]
    if within:  # a null key is a key
        right = before.select(*(F.col(c).alias(f"_of{c}") for c in key), "_before")
        both = part.withColumn("_rank", rank).join(right, [F.col(c).eqNullSafe(F.col(f"_of{c}")) for c in key])
        both = both.drop(*(f"_of{c}" for c in key))
    else:
        both = part.withColumn("_rank", rank).join(F.broadcast(before), "_part")
    return both.withColumn(column, F.col("_rank") + F.col("_before")).drop("_part", "_rank", "_before")
