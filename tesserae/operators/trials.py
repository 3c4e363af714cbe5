"""Trials: grids, what is left to run, and ranks."""

import itertools

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def cross_grid(spark: SparkSession, axes: dict[str, list], prefix: str) -> DataFrame:
    """trial_id and a column for each axis: every combination of a few given values, the first axis slowest; ids count from 0."""
    return spark.createDataFrame([(f"{prefix}_{k:04d}", *row) for k, row in enumerate(itertools.product(*axes.values()))], ["trial_id", *axes])


def sweep(spark: SparkSession, base: dict, axes: dict[str, list], probes: list[dict], prefix: str) -> DataFrame:
    """The base, then the base with one value changed at a time, then the probes (changes of several); each setting once, where it comes first."""
    rows = [base, *({**base, name: v} for name, values in axes.items() for v in values), *({**base, **p} for p in probes)]
    table = spark.createDataFrame([(k, *(r[c] for c in base)) for k, r in enumerate(rows)], ["_seq", *base])
    first = table.groupBy(*base).agg(F.min("_seq").alias("_seq"))
    number = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("_seq")) - 1
    return first.select(F.format_string(f"{prefix}_%04d", number).alias("trial_id"), *base)


def left_to_run(grid: DataFrame, records: DataFrame) -> DataFrame:
    """The trials of grid that no record names; a failed run counts as a run."""
    return grid.join(records.select("trial_id").distinct(), "trial_id", "left_anti")


def leaderboard(records: DataFrame, top: int) -> DataFrame:
    """place, trial_id and score of the best runs: by score, a missing one as -999, then by time and id; runs with an error are left out."""
    good = records.where("trial_id IS NOT NULL AND (error IS NULL OR trim(error) = '')").withColumn("score", F.coalesce("score", F.lit(-999.0)))
    best = good.orderBy(F.col("score").desc(), F.col("logged_at").asc_nulls_last(), "trial_id").limit(top)
    w = Window.partitionBy(F.lit(0)).orderBy(F.col("score").desc(), F.col("logged_at").asc_nulls_last(), "trial_id")  # top rows only
    return best.select(F.row_number().over(w).alias("place"), "trial_id", "score")


def passing(records: DataFrame, qualities: DataFrame, min_score: float, min_unique: int, min_entropy: float) -> DataFrame:
    """trial_id of the trials whose last good record and neighbours reach all three bounds; what is missing counts as -999 or 0."""
    both = qualities.join(records.select("trial_id", "score"), "trial_id", "left")
    ok = (F.coalesce("score", F.lit(-999.0)) >= min_score) & (F.coalesce("unique_top1_count", F.lit(0)) >= min_unique) & (F.coalesce("top1_entropy_bits", F.lit(0.0)) >= min_entropy)
    return both.where(ok).select("trial_id")
