"""A query against a dictionary, with answers of an external scorer."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.plans.index import numbered


def with_scorer(pairs: DataFrame, scorer: Callable[[DataFrame], Column] | None, raw: str = "raw") -> DataFrame:
    """pairs with a column raw: the scorer's answer. The scorer is given the DataFrame and returns a column, such as an iterator pandas UDF that loads a model once."""
    return pairs if scorer is None else pairs.withColumn(raw, scorer(pairs))


def short_circuit(answers: DataFrame, key: str, order: str, matched: str) -> DataFrame:
    """key, checked and label_at: how far each query would have looked until its first match, and the place of it (null: none, all were looked at)."""
    first = F.min(F.when(F.col(matched), F.col(order)))
    return answers.groupBy(key).agg(F.coalesce(first, F.max(order)).alias("checked"), first.alias("label_at"))


def best_score(answers: DataFrame, key: str, order: str, score: str, label: str) -> DataFrame:
    """key, label and score of the highest score; of equal ones the first in order."""
    return answers.where(F.col(score).isNotNull()).groupBy(key).agg(F.max_by(F.struct(F.col(label).alias("label"), F.col(score).alias("score")), F.struct(F.col(score), -F.col(order))).alias("b")).select(key, "b.label", "b.score")


def chunks(items: DataFrame, size: int, key: str, *order: str) -> DataFrame:
    """items with batch and place: so many in succession within key, from 0. Order should tell the items of a key apart."""
    at = numbered(items, *order, column="_at", within=(key,))
    return at.withColumn("batch", F.floor(F.col("_at") / size).cast("int")).withColumn("place", (F.col("_at") % size).cast("int")).drop("_at")


def cells(labels: DataFrame, images: DataFrame, per_sheet: int = 100, columns: int = 10) -> DataFrame:
    """label, sheet, row, col and missing for each label of the dictionary, whether or not an image has it."""
    there = images.select("label").distinct().withColumn("_there", F.lit(True))
    n = F.col("label").cast("int")
    return labels.join(there, "label", "left").select("label", F.floor(n / per_sheet).cast("int").alias("sheet"), F.floor((n % per_sheet) / columns).cast("int").alias("row"), (n % columns).alias("col"), F.col("_there").isNull().alias("missing"))


def two_stages(pairs: DataFrame, kind: Callable[[DataFrame], Column], label: Callable[[DataFrame], Column], bad: str = "bad_crop") -> DataFrame:
    """pairs with kind and label: the second scorer is asked only where the first doesn't find a bad crop; there the label is null."""
    first = with_scorer(pairs, kind, "kind")
    good = with_scorer(first.where(F.col("kind") != bad), label, "label")
    return good.unionByName(first.where((F.col("kind") == bad) | F.col("kind").isNull()).withColumn("label", F.lit(None).cast("string")))


def leftovers(images: DataFrame) -> DataFrame:
    """Images to remove after a split: names 000 and 114, and files of at most 54 bytes."""
    stem = F.regexp_replace("name", "\\.[^.]*$", "")
    return images.where(stem.isin("000", "114") | (F.col("length") <= 54))
