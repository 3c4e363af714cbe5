"""Words that several trials agree on for a token."""

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.plans.stages import broadcast_below, stage

#: Bounds for taking part and for agreeing, by name.
PRESETS = {
    "strict": {"min_score": 4.0, "min_unique": 100, "min_entropy": 4.0, "min_trials": 2, "min_fraction": 0.5, "min_margin": 0.05, "banned_share": 0.05},
    "default": {"min_score": 3.0, "min_unique": 50, "min_entropy": 3.0, "min_trials": 2, "min_fraction": 0.35, "min_margin": 0.03, "banned_share": 0.08},
    "relaxed": {"min_score": 2.0, "min_unique": 25, "min_entropy": 2.0, "min_trials": 2, "min_fraction": 0.25, "min_margin": 0.02, "banned_share": 0.12},
}


def bounds(preset: str = "default", **own: float) -> dict[str, float]:
    """The bounds of a preset; own values count with the preset default only."""
    return PRESETS[preset] | (own if preset == "default" else {})


def known_trials(neighbors: DataFrame, records: DataFrame) -> DataFrame:
    """The neighbours of trials that the log names; all of them where the log is empty."""
    return neighbors if records.isEmpty() else neighbors.join(records.select("trial_id").distinct(), "trial_id", "left_semi")


def banned_words(tops: DataFrame, share: float, *keys: str) -> DataFrame:
    """keys (trial_id if none are named) and word (in lower case) of first neighbours that a trial gives to more than max(1, ceil(share * tokens)) of its tokens."""
    by = keys or ("trial_id",)
    count = tops.where("word IS NOT NULL").groupBy(*by, F.lower("word").alias("word")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(*by))
    return count.withColumn("most", F.greatest(F.lit(1), F.ceil(F.lit(share) * total))).where("n > most").select(*by, "word")


def votes(tops: DataFrame, anchors: DataFrame, leaks: DataFrame, min_margin: float, banned_share: float, *keys: str) -> DataFrame:
    """keys (trial_id if none are named), token, word (in lower case), margin and cosine: the first neighbours that count as votes.

    tops: the first neighbours with their margins, as margins() gives them by keys and token. Tokens that are anchors, words that leak from anchors, words banned in their trial and margins below the least are
    left out; a token with one neighbour only has the margin 0.
    """
    by = keys or ("trial_id",)
    tops = tops.where("word IS NOT NULL").withColumn("word", F.lower("word")).join(anchors.select("token").distinct(), "token", "left_anti")
    near = tops.withColumn("margin", F.coalesce("margin", F.lit(0.0))).where(F.round("margin", 9) >= min_margin)
    banned = broadcast_below(stage(banned_words(tops, banned_share, *by), "banned", release=True), 100_000)
    return near.join(leaks.select(F.lower("word").alias("word")).distinct(), "word", "left_anti").join(banned, [*by, "word"], "left_anti").select(*by, "token", "word", "margin", "cosine")


def ranked_votes(cast: DataFrame) -> DataFrame:
    """token, word, trials, mean_margin, mean_cosine and place: a token's words by votes, then by the first trial that gave one, then by word.

    A vote with a column times stands for so many trials that voted alike, of which trial_id is the first. One shuffle, by token, serves both steps.
    """
    n = F.col("times") if "times" in cast.columns else F.lit(1)
    mean = lambda c: (F.sum(n * F.col(c)) / F.sum(F.when(F.col(c).isNotNull(), n))).alias(f"mean_{c}")
    each = cast.repartition("token").groupBy("token", "word").agg(F.sum(n).cast("long").alias("trials"), mean("margin"), mean("cosine"), F.min("trial_id").alias("first_seen"))
    w = Window.partitionBy("token").orderBy(F.col("trials").desc(), "first_seen", "word")
    return each.withColumn("place", F.row_number().over(w))


def consensus(cast: DataFrame, used: DataFrame, min_trials: int, min_fraction: float, top: int | None = None) -> DataFrame:
    """token, word, trials, required, fraction, mean_margin, mean_cosine and alternates of the tokens that enough trials agree on.

    used: the trials that took part, one row each. Enough is max(min_trials, ceil(min_fraction * number of used)).
    alternates are the words in the places 2 to 5. With top, only so many rows, by trials, margin and cosine.
    """
    ranked = ranked_votes(cast)
    n = used.count()
    others = F.transform(F.sort_array(F.collect_list(F.when((F.col("place") >= 2) & (F.col("place") <= 5), F.struct("place", "word")))), lambda x: x["word"])
    rest = ranked.groupBy("token").agg(F.array_join(others, " ").alias("alternates"))
    out = ranked.where("place = 1").withColumn("required", F.lit(max(min_trials, math.ceil(min_fraction * n))).cast("long"))
    out = out.where("trials >= required").join(rest, "token")
    out = out.select("token", "word", "trials", "required", F.round(F.col("trials") / F.lit(n), 4).alias("fraction"), F.round("mean_margin", 4).alias("mean_margin"), F.round("mean_cosine", 4).alias("mean_cosine"), "alternates")
    return out.orderBy(F.col("trials").desc(), F.col("mean_margin").desc(), F.col("mean_cosine").desc(), "token").limit(top) if top else out
