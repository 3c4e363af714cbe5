"""Vocabulary and co-occurrence within a window of a line."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.functions.text import is_separator
from tesserae.plans.index import numbered


def vocabulary(tokenized: DataFrame) -> DataFrame:
    """token and idx: the different tokens, numbered from 0 in their order."""
    return numbered(tokenized.select(F.explode("tokens").alias("token")).distinct(), "token", column="idx").select("token", F.col("idx").cast("int").alias("idx"))


def near_pairs(tokenized: DataFrame, window: int | Column, mask: bool = True, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, a, b and d for each two places of a line at most window apart, once: d places after a stands b.

    Separators take a place; with mask, pairs with one are dropped afterwards. It is local to a row: nothing is shuffled, and for each
    distance the line is zipped with itself, so that the work grows with the tokens times the window.
    """
    n = F.size("tokens")
    reach = F.least(F.lit(window) if isinstance(window, int) else window, n - 1)
    zipped = lambda k: F.arrays_zip(F.slice("tokens", F.lit(1), n - k).alias("a"), F.slice("tokens", k + 1, n - k).alias("b"))
    by_distance = tokenized.select(*keys, F.explode(F.when(reach >= 1, F.transform(F.sequence(F.lit(1), reach), lambda k: F.struct(k.alias("d"), zipped(k).alias("p"))))).alias("x"))
    pairs = by_distance.select(*keys, F.col("x.d").alias("d"), F.inline("x.p"))
    return pairs.where(~is_separator(F.col("a")) & ~is_separator(F.col("b"))) if mask else pairs


def context_pairs(tokenized: DataFrame, window: int | Column, mask: bool = True, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys and (center, context) for each two places of a line at most window apart, in both orders; see near_pairs()."""
    way = lambda x, y: F.struct(F.col(x).alias("center"), F.col(y).alias("context"))
    return near_pairs(tokenized, window, mask, keys).select(*keys, F.inline(F.array(way("a", "b"), way("b", "a"))))


def both_ways(half: DataFrame, *keys: str) -> DataFrame:
    """keys, center, context and n from counts of unordered pairs (a, b, n); a pair of equals counts twice."""
    way = lambda x, y, n: F.struct(F.col(x).alias("center"), F.col(y).alias("context"), n.alias("n"))
    n = F.col("n")
    return half.select(*keys, F.inline(F.when(F.col("a") == F.col("b"), F.array(way("a", "b", n * 2))).otherwise(F.array(way("a", "b", n), way("b", "a", n)))))


def pair_counts(tokenized: DataFrame, window: int | Column, mask: bool = True, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, center, context and n. Counted once for both orders, and within each task before the shuffle."""
    near = near_pairs(tokenized, window, mask, keys)
    return both_ways(near.groupBy(*keys, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.count("*").alias("n")), *keys)


def pair_counts_by_window(tokenized: DataFrame, windows: list[int], mask: bool = True, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, window, a <= b and n: the counts of unordered pairs for several windows, from one pass over the pairs of the widest."""
    near = near_pairs(tokenized, max(windows), mask, keys)
    counts = near.groupBy(*keys, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(*(F.count_if(F.col("d") <= w).alias(f"n{w}") for w in windows))
    each = F.array(*(F.struct(F.lit(w).alias("window"), F.col(f"n{w}").alias("n")) for w in windows))
    return counts.select(*keys, "a", "b", F.inline(each)).where("n > 0")


def indexed_pairs(counts: DataFrame, vocab: DataFrame) -> DataFrame:
    """The same by idx; a token that the vocabulary lacks drops its pairs."""
    side = lambda c: vocab.select(F.col("token").alias(c), F.col("idx").alias(f"{c}_idx"))
    return counts.join(side("center"), "center").join(side("context"), "context").select("center_idx", "context_idx", "n")


def resolve_tokens(wanted: DataFrame, vocab: DataFrame) -> DataFrame:
    """token and idx: the token itself in the vocabulary, else its form with three digits; null if there is neither."""
    exact = wanted.join(vocab.select("token", F.col("idx").alias("exact")), "token", "left")
    padded = F.when(F.length("token") < 3, F.lpad("token", 3, "0")).otherwise(F.col("token"))
    other = vocab.select(F.col("token").alias("_padded"), F.col("idx").alias("filled"))
    return exact.withColumn("_padded", padded).join(other, "_padded", "left").select("token", F.coalesce("exact", "filled").alias("idx"))


def resolve_variants(wanted: DataFrame, vocab: DataFrame) -> DataFrame:
    """token and key: the glyph's plain key, else the first of its keys with a variant; null without one."""
    keys = vocab.select(F.substring_index("token", ":", 1).alias("_glyph"), F.col("token").alias("key")).groupBy("_glyph").agg(F.min("key").alias("key"))
    padded = F.when(F.length("token") < 3, F.lpad("token", 3, "0")).otherwise(F.col("token"))
    return wanted.withColumn("_glyph", padded).join(keys, "_glyph", "left").select("token", "key")


def variant_index(wanted: DataFrame, vocab: DataFrame) -> DataFrame:
    """token, key and idx: the number of the key of resolve_variants() in the vocabulary."""
    return resolve_variants(wanted, vocab).join(vocab.select(F.col("token").alias("key"), "idx"), "key", "left").select("token", "key", "idx")


def missing_tokens(wanted: DataFrame, vocab: DataFrame) -> DataFrame:
    """The wanted tokens that resolve_tokens() finds no number for."""
    return resolve_tokens(wanted, vocab).where("idx IS NULL").select("token")
