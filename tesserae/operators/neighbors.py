"""Exact nearest neighbours by cosine, and what they say about a vector space."""

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions.vectors import dot, normalize
from tesserae.operators.cooccurrence import both_ways
from tesserae.plans.index import numbered
from tesserae.plans.stages import broadcast_below, stage

#: Vectors of the pool, and queries, that a task compares at a time; queries that are broadcast at a time (32 MB at 64 dimensions).
POOL_BLOCK, QUERY_BLOCK, QUERY_SHARE = 4096, 1024, 65_536
#: Sums of tokens that are broadcast at most (about 100 MB); beyond, they are joined by a shuffle.
TOTALS = 500_000


def best_of(cos: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of each row's k greatest values, and of all that equal the least of them; -inf never."""
    least = np.partition(cos, -k, axis=1)[:, -k] if k < cos.shape[1] else np.full(len(cos), -np.inf)
    return np.nonzero((cos >= least[:, None]) & np.isfinite(cos))


def keep_best(row: np.ndarray, key: np.ndarray, cos: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each row, by cosine and then by key."""
    order = np.lexsort((key, -cos, row))
    row, key, cos = row[order], key[order], cos[order]
    first = np.flatnonzero(np.diff(row, prepend=-1))
    keep = np.arange(len(row)) - np.repeat(first, np.diff(np.append(first, len(row)))) < k
    return row[keep], key[keep], cos[keep]


def nearest(queries: DataFrame, pool: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", itself: bool = False) -> DataFrame:
    """query, rank (from 1), neighbor and cosine: the k rows of pool nearest to each row of queries.

    Queries are broadcast, at most QUERY_SHARE at a time; each task compares them with its part of the pool, block by
    block as a product of matrices, and keeps the k best of each query. Only these are shuffled, to be ranked together:
    the pool never is. Cosines are rounded to nine digits before they are ranked; of equal ones the lower key comes first. Without itself, a
    query's own key is no neighbour of it. Null keys and vectors take no part; a vector of length 0 has the cosine 0 with all others.
    """
    spark = pool.sparkSession
    clean = lambda x: x.where(f"{key} IS NOT NULL AND {vector} IS NOT NULL").select(F.col(key).cast("long").alias("key"), normalize(F.col(vector)).alias("v"))
    asked = stage(numbered(clean(queries), "key", column="at"), "queries")
    shares, pool = max(1, math.ceil(asked.count() / QUERY_SHARE)), clean(pool)

    def search(share: int) -> DataFrame:
        part = asked.where((F.col("at") >= share * QUERY_SHARE) & (F.col("at") < (share + 1) * QUERY_SHARE)).select("key", "v").toPandas()
        held = spark.sparkContext.broadcast((part["key"].to_numpy(np.int64), np.stack(part["v"].to_numpy()) if len(part) else np.zeros((0, 1))))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, q = held.value
            at = range(0, len(own), QUERY_BLOCK)
            best = {i: (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)) for i in at}
            for b in batches:
                for low in range(0, b.num_rows, POOL_BLOCK):
                    keys, flat = b["key"][low : low + POOL_BLOCK].to_numpy(), b["v"][low : low + POOL_BLOCK].flatten().to_numpy()
                    p = flat.reshape(len(keys), -1).T
                    for i in at:
                        cos = np.nan_to_num(np.round(q[i : i + QUERY_BLOCK] @ p, 9), nan=-np.inf)
                        if not itself:
                            cos[own[i : i + QUERY_BLOCK, None] == keys[None, :]] = -np.inf
                        row, column = best_of(cos, k)
                        best[i] = keep_best(*(np.append(x, y) for x, y in zip(best[i], (row, keys[column], cos[row, column]))), k)
            for i in at:
                row, neighbor, cosine = best[i]
                yield pa.RecordBatch.from_arrays([pa.array(own[i + row]), pa.array(neighbor), pa.array(cosine)], ["query", "neighbor", "cosine"])

        return pool.mapInArrow(run, "query long, neighbor long, cosine double")

    parts = reduce(DataFrame.unionByName, map(search, range(shares)))
    w = Window.partitionBy("query").orderBy(F.col("cosine").desc(), "neighbor")
    return parts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query", "rank", "neighbor", "cosine")


def glyph_neighbors(half: DataFrame, k: int, *keys: str) -> DataFrame:
    """keys (trial_id if none are named), token, rank, word and cosine from counts of unordered pairs (a, b, n) by keys: n_ab / sqrt(n_a * n_b), the k best of each token.

    Cosines are the same both ways, so they are made before a pair is turned round; the sums of tokens are broadcast up to
    TOTALS rows. Ranking sorts by a hash of the group, not by its strings, and drops what can't be among the k best before the shuffle.
    """
    by = keys or ("trial_id",)
    total = stage(both_ways(half, *by).groupBy(*by, "center").agg(F.sum("n").alias("t")), "totals")
    total = broadcast_below(total, TOTALS)
    side = lambda c: total.select(*by, F.col("center").alias(c), F.col("t").alias(f"t{c}"))
    cosine = F.round(F.col("n") / F.sqrt(F.col("ta").cast("double") * F.col("tb")), 9)
    near = half.where("a <> b").join(side("a"), [*by, "a"]).join(side("b"), [*by, "b"]).select(*by, "a", "b", cosine.alias("cosine"))
    way = lambda x, y: F.struct(F.col(x).alias("token"), F.col(y).alias("word"))
    turned = near.select(*by, "cosine", F.inline(F.array(way("a", "b"), way("b", "a")))).withColumn("_group", F.xxhash64(*by, "token"))
    w = Window.partitionBy("_group", *by, "token").orderBy(F.col("cosine").desc(), "word")
    return turned.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(*by, "token", "rank", "word", "cosine")


def margins(neighbors: DataFrame, *keys: str) -> DataFrame:
    """keys, word, cosine and margin (to the second; null without one) of each first neighbour."""
    return neighbors.where("rank <= 2").groupBy(*keys).agg(F.max(F.when(F.col("rank") == 1, F.col("word"))).alias("word"), F.max(F.when(F.col("rank") == 1, F.col("cosine"))).alias("cosine"), F.max(F.when(F.col("rank") == 2, F.col("cosine"))).alias("second")).withColumn("margin", F.col("cosine") - F.col("second"))


def quality(tops: DataFrame, *keys: str) -> DataFrame:
    """Per keys: token_count, unique_top1_count, top1_entropy_bits, mean, population deviation, least and greatest first cosine, and mean and deviation of margins.

    tops is what margins() gives; tokens without a neighbour have a null word and count as tokens only.
    """
    words = tops.where("word IS NOT NULL").groupBy(*keys, "word").agg(F.count("*").alias("c"))
    share = F.col("c") / F.sum("c").over(Window.partitionBy(*keys))
    entropy = words.withColumn("p", share).groupBy(*keys).agg(F.count("*").alias("unique_top1_count"), (-F.sum(F.col("p") * F.log2("p"))).alias("top1_entropy_bits"))
    stats = tops.groupBy(*keys).agg(
        F.count("*").alias("token_count"), F.avg("cosine").alias("top1_mean_cosine"), F.stddev_pop("cosine").alias("top1_std_cosine"), F.min("cosine").alias("top1_min_cosine"), F.max("cosine").alias("top1_max_cosine"),
        F.avg("margin").alias("top1_top2_margin_mean"), F.stddev_pop("margin").alias("top1_top2_margin_std"),
    )
    return stats.join(entropy, list(keys), "left").na.fill(0)


def anchor_rates(tops: DataFrame, expected: DataFrame, *keys: str) -> DataFrame:
    """anchor_hit_rate per keys: of the anchors with a first neighbour, how many have one of their expected words."""
    hits = tops.where("word IS NOT NULL").join(expected.groupBy("token").agg(F.collect_set("word").alias("expected")), "token")
    return hits.groupBy(*keys).agg(F.avg(F.array_contains("expected", F.col("word")).cast("int")).alias("anchor_hit_rate"))


def trial_score(mean_cosine, hit_rate, unique, entropy, margin):
    """The score of a trial from its qualities, as a column; a trial without anchors has a null mean cosine, which counts as -1."""
    c = F.coalesce(mean_cosine, F.lit(-1.0))
    kinds = F.least(unique / 80.0, F.lit(1.5))
    fee = F.when(c < 0, 2.5).otherwise(0.0) + F.when(unique <= 5, 1.5).otherwise(0.0) + F.when(hit_rate < 0.5, 1.0).otherwise(0.0)
    return 3.0 * c + 2.0 * hit_rate + 1.2 * kinds + 0.6 * F.least(entropy / 4.0, F.lit(1.0)) + 0.4 * margin - fee


def mean_vectors(vectors: DataFrame, key: str, vector: str = "embedding") -> DataFrame:
    """key and mean: the mean of each key's vectors, dimension by dimension. Summed within each task before the shuffle."""
    each = vectors.where(f"{vector} IS NOT NULL").select(key, F.posexplode(vector).alias("i", "x"))
    mean = each.groupBy(key, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return mean.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("mean"))


def text_vectors(pieces: DataFrame, vectors: DataFrame, *keys: str, piece: str = "piece", key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """keys and vector: the mean of the vectors of each text's pieces, repeated ones too; zeros where a text has no piece with a vector.

    pieces has a row for each piece of a text; a text without pieces has one with a null piece.
    """
    known = vectors.where(f"{vector} IS NOT NULL").select(F.col(key).alias(piece), F.posexplode(vector).alias("i", "x"))
    counts = pieces.where(F.col(piece).isNotNull()).groupBy(*keys, piece).agg(F.count("*").alias("n"))
    sums = counts.join(known, piece).groupBy(*keys, "i").agg((F.sum(F.col("n") * F.col("x").cast("double")) / F.sum("n")).alias("x"))
    means = sums.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("vector"))
    dims = vectors.where(f"{vector} IS NOT NULL").agg(F.max(F.size(vector))).first()[0] or 0
    every = pieces.select(*keys).distinct().join(means, list(keys), "left")
    return every.select(*keys, F.coalesce("vector", F.array_repeat(F.lit(0.0), dims)).alias("vector"))


def gloss_vectors(texts: DataFrame, key: str) -> DataFrame:
    """key and vector: the mean of a key's text vectors (not of their pieces), brought to length 1. texts is what text_vectors() gives, with key among its keys."""
    return mean_vectors(texts, key, "vector").select(key, normalize(F.col("mean")).alias("vector"))


def anchor_cosines(projected: DataFrame, glosses: DataFrame, *keys: str) -> DataFrame:
    """keys, token and cosine of each anchor's projected vector with the vector of its glosses; anchors that either side lacks give no row."""
    return projected.join(glosses.withColumnRenamed("vector", "_gloss"), "token").select(*keys, "token", dot(normalize(F.col("vector")), F.col("_gloss")).alias("cosine"))


def gram(vectors: DataFrame, first: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """row, col and cosine of the first so many vectors by key: a corner of the table of all cosines, as a plot shows it."""
    top = vectors.where(f"{vector} IS NOT NULL").orderBy(key).limit(first)
    return nearest(top, top, first, key, vector, itself=True).select(F.col("query").alias("row"), F.col("neighbor").alias("col"), "cosine")


def word_pool(words: DataFrame, limit: int, lower: bool) -> DataFrame:
    """idx and word of the first so many (one at least) usable words in the order of idx: letters a to z only, three at least, without ##.

    With lower, words are put in lower case and a word counts where it comes first.
    """
    w = F.regexp_replace("word", "##", "")
    one = words.withColumn("word", F.lower(w) if lower else w).where("word RLIKE '^[a-z]+$' AND length(word) >= 3")
    if lower:
        one = one.groupBy("word").agg(F.min("idx").alias("idx"))
    return one.orderBy("idx").limit(max(limit, 1)).select("idx", "word")


def with_extras(pool: DataFrame, extras: DataFrame) -> DataFrame:
    """The pool and after it the different extra words, of letters a to z in lower case, that it lacks (idx null)."""
    more = extras.select(F.lower("word").alias("word")).where("word RLIKE '^[a-z]+$'").distinct().join(pool, "word", "left_anti")
    return pool.unionByName(more.select(F.lit(None).cast(pool.schema["idx"].dataType).alias("idx"), "word"))


def pool_vectors(pool: DataFrame, vectors: DataFrame, pieces: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """word, idx and vector of a pool with extras: a word of the pool has the vector of its number, an extra one the mean of its pieces' vectors.

    pieces has word and piece, the numbers of the vectors that a word is made of.
    """
    own = pool.where("idx IS NOT NULL").join(vectors.select(F.col(key).alias("idx"), F.transform(vector, lambda x: x.cast("double")).alias("vector")), "idx")
    extra = pool.where("idx IS NULL").join(pieces, "word", "left")
    return own.select("word", "idx", "vector").unionByName(text_vectors(extra, vectors, "word", key=key, vector=vector).select("word", F.lit(None).cast(pool.schema["idx"].dataType).alias("idx"), "vector"))
