"""Problem 7: mixing sources to target weights."""

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.llm.encoding import encode
from tesserae.plans.stages import stage

#: Sources in the table of targets at most; their weights are held on the driver.
SOURCES = 100_000
#: Documents of a source that are numbered in one group, and shards whose counts are added up in one.
BUCKET_DOCS, BUCKET_SHARDS = 50_000, 4096


def scatter(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A pseudorandom permutation of 0 .. size-1 for each key: a Feistel network of four rounds.

    It permutes the least square of a power of two that holds size; what falls outside is sent through again.
    """
    half = np.array([max(1, math.ceil((int(s) - 1).bit_length() / 2)) for s in np.unique(size)], np.uint64)[np.searchsorted(np.unique(size), size)]
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, size = index.astype(np.uint64), size.astype(np.uint64)
    open_ = np.arange(len(out))
    while len(open_):
        h, m, k = half[open_], mask[open_], key[open_].astype(np.uint64)
        left, right = out[open_] >> h, out[open_] & m
        for r in range(4):
            x = (right + k + np.uint64(r * 0x9E3779B97F4A7C15 % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((x ^ (x >> np.uint64(32))) & m)
        out[open_] = (left << h) | right
        open_ = open_[out[open_] >= size[open_]]
    return out.astype(np.int64)


def goals(targets: DataFrame) -> DataFrame:
    """source, weight, max_repeats of the usable targets; of a source named twice the greater weight and lower cap."""
    usable = targets.where("source IS NOT NULL AND target_weight > 0 AND NOT isnan(target_weight) AND max_repeats > 0")
    return usable.groupBy("source").agg(F.max("target_weight").alias("weight"), F.min("max_repeats").alias("max_repeats"))


def running(df: DataFrame, key: str, bucket: str, order: list, size: str, column: str) -> DataFrame:
    """df with a column: the sum of size over the rows of the same key before this one, in the order of bucket and order.

    Each bucket is added up by itself; the sums of a key's buckets, one row each, are added up after. So no key, however
    large, is one group.
    """
    sums = df.groupBy(key, bucket).agg(F.sum(size).alias("_in"))
    before = sums.withColumn("_before", F.sum("_in").over(Window.partitionBy(key).orderBy(bucket)) - F.col("_in")).drop("_in")
    inside = F.sum(size).over(Window.partitionBy(key, bucket).orderBy(*order)) - F.col(size)
    return df.withColumn("_inside", inside).join(before, [key, bucket]).withColumn(column, F.col("_inside") + F.col("_before")).drop("_inside", "_before")


def packed(sized: DataFrame, block_tokens: int, seed: int) -> DataFrame:
    """The documents of each source in a pseudorandom order, cut into blocks: source, block, doc_id, first_token, n_tokens, at.

    first_token counts within the document, at within the block. A source is numbered in buckets of bounded size, so
    that the largest one is no group of its own.
    """
    buckets = sized.groupBy("source").agg(F.ceil(F.count("*") / BUCKET_DOCS).alias("buckets"))
    placed = sized.join(F.broadcast(buckets), "source").withColumn("bucket", F.pmod(F.xxhash64("doc_id", F.lit(seed)), "buckets"))
    run = running(placed, "source", "bucket", [F.xxhash64("doc_id", F.lit(seed + 1)), "doc_id"], "n_tokens", "start").withColumn("end", F.col("start") + F.col("n_tokens"))
    block = F.sequence(F.floor(F.col("start") / block_tokens), F.floor((F.col("end") - 1) / block_tokens))
    low = F.greatest("start", F.col("block") * block_tokens)
    return run.withColumn("block", F.explode(block)).select(
        "source", "block", "doc_id", (low - F.col("start")).cast("int").alias("first_token"), (F.least("end", (F.col("block") + 1) * block_tokens) - low).cast("int").alias("n_tokens"), (low - F.col("block") * block_tokens).cast("int").alias("at")
    )


def draw(sources: list, slots: int, shard_slots: int, seed: int, spark) -> DataFrame:
    """The slots of all shards: shard, slot, source, repeat (from 1) and block.

    Each shard draws how many of its slots every source fills, from one multinomial distribution; a source's slots are
    counted through all shards, and the count, through a permutation for each pass over the source, gives the block.
    A slot that comes after a source's last allowed pass is empty: repeat and block are null.
    """
    names, weights = [s["source"] for s in sources], np.array([s["weight"] for s in sources])
    weights = weights / weights.sum()

    def counts(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for shard in part["id"]:
                n = min(shard_slots, slots - shard * shard_slots)
                drawn = np.random.default_rng([seed, int(shard)]).multinomial(n, weights)
                yield pd.DataFrame({"shard": shard, "source": names, "here": np.cumsum(drawn) - drawn, "drawn": drawn, "of": n})

    per = spark.range(math.ceil(slots / shard_slots)).mapInPandas(counts, "shard long, source string, here long, drawn long, of long").where("drawn > 0")
    per = running(stage(per.withColumn("bucket", F.floor(F.col("shard") / BUCKET_SHARDS)), "draws"), "source", "bucket", ["shard"], "drawn", "start")
    known = spark.createDataFrame([(s["source"], k, int(s["blocks"]), int(s["max_repeats"])) for k, s in enumerate(sources)], "source string, number long, blocks long, max_repeats long")
    each = per.join(F.broadcast(known), "source").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("drawn") - 1)).alias("k"))
    each = each.select("shard", "source", "number", "blocks", "max_repeats", "of", (F.col("here") + F.col("k")).alias("place"), (F.col("start") + F.col("k")).alias("turn"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = {c: b[c].to_numpy() for c in ("shard", "number", "blocks", "max_repeats", "of", "place", "turn")}
            again, index = np.divmod(x["turn"], x["blocks"])
            block = scatter(index, x["blocks"], seed + x["number"] * 1_000_003 + again * 7919)
            slot = scatter(x["place"], x["of"], seed + 31 * x["shard"])
            empty = again >= x["max_repeats"]
            yield pa.RecordBatch.from_arrays([b["shard"], pa.array(slot), b["source"], pa.array(again + 1, mask=empty), pa.array(block, mask=empty)], ["shard", "slot", "source", "repeat", "block"])

    return each.repartition("shard").mapInArrow(place, "shard long, slot long, source string, repeat long, block long")


def mix(sized: DataFrame, targets: DataFrame, block_tokens: int = 64, shard_slots: int = 1024, slots: int | None = None, seed: int = 7) -> DataFrame:
    """A mixture as the pieces of documents it is made of: shard, slot, source, repeat, block, doc_id, first_token, n_tokens, at.

    sized has doc_id, source and n_tokens. The documents of each source with a target are packed into blocks of so
    many tokens (the last of a source may be shorter), and slots are drawn in shards of shard_slots by the sources' weights. slots: how many
    blocks the mixture has; by default as many as the sources with a target have together, so that it is as large as
    what it is taken from, whatever the size. A block, and so every token and document, is used at most max_repeats times. A source
    that a mixture of this size needs more often falls short: the slots that it can't fill are rows without a block (repeat, block, doc_id,
    first_token and at null, n_tokens 0), the other sources keep their draw, and shares() reports both. With fewer slots
    a source falls less short.

    Documents without tokens, source or id, and those whose source has no usable target, take no part; sources without
    documents leave their weight to the others. Repeated doc_ids count once (the least source and size). Without
    documents or targets there are no rows.
    """
    spark = sized.sparkSession
    once = sized.where("doc_id IS NOT NULL AND source IS NOT NULL AND n_tokens > 0").groupBy("doc_id").agg(F.min(F.struct("source", F.col("n_tokens").cast("long").alias("n_tokens"))).alias("s")).select("doc_id", "s.*")
    goal = stage(goals(targets), "targets")
    if goal.limit(SOURCES + 1).count() > SOURCES:
        raise ValueError(f"more than {SOURCES} sources in the targets")
    once = stage(once.join(F.broadcast(goal), "source", "left_semi"), "sized")
    sources = once.groupBy("source").agg(F.sum("n_tokens").alias("tokens")).join(F.broadcast(goal), "source").withColumn("blocks", F.ceil(F.col("tokens") / block_tokens)).orderBy("source").collect()
    if not sources:
        return spark.createDataFrame([], "shard long, slot long, source string, repeat long, block long, doc_id long, first_token int, n_tokens int, at int")
    drawn = draw(sources, slots or sum(s["blocks"] for s in sources), shard_slots, seed, spark)
    pieces = packed(once, block_tokens, seed)
    return drawn.join(pieces, ["source", "block"], "left").select("shard", "slot", "source", "repeat", "block", "doc_id", "first_token", F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"), "at")


def shares(mixture: DataFrame, targets: DataFrame) -> DataFrame:
    """source, target_share, max_repeats, n_slots (drawn), n_empty (of them, past the cap), n_tokens, share and most_repeats for each source with a target.

    target_share is taken of the sources that the mixture has; the others have 0 tokens.
    """
    empty = F.col("block").isNull()
    per = mixture.groupBy("source").agg(F.count_if(empty | (F.col("at") == 0)).alias("n_slots"), F.count_if(empty).alias("n_empty"), F.sum("n_tokens").alias("n_tokens"), F.max("repeat").alias("most_repeats"))
    goal = goals(targets).join(per, "source", "left")
    everything = Window.partitionBy(F.lit(0))  # one row for each source
    there = F.when(F.col("n_slots").isNotNull(), F.col("weight"))
    none = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return goal.select(
        "source", (F.coalesce(there, F.lit(0.0)) / F.sum(there).over(everything)).alias("target_share"), "max_repeats", none("n_slots"), none("n_empty"), none("n_tokens"),
        (F.coalesce("n_tokens", F.lit(0)) / F.sum("n_tokens").over(everything)).alias("share"), none("most_repeats"),
    )


def sized(documents: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, source and n_tokens of every document, by the public tokenizer."""
    ids = encode(documents.select(F.struct("doc_id", "source").alias("key"), "text"), key="key", path=path)
    return ids.select("key.doc_id", "key.source", F.size("ids").alias("n_tokens"))


def mixed_blocks(documents: DataFrame, mixture: DataFrame, path: str | None = None) -> DataFrame:
    """The mixture as it is trained on: shard, slot, source, block, repeat and ids, the tokens of the block in order; empty slots give no row."""
    ids = encode(documents, path=path)
    mixture = mixture.where("block IS NOT NULL")
    pieces = mixture.select("source", "block", "doc_id", "first_token", "n_tokens", "at").distinct()
    texts = pieces.join(ids, "doc_id").select("source", "block", "at", F.slice("ids", F.col("first_token") + 1, F.col("n_tokens")).alias("part"))
    blocks = texts.groupBy("source", "block").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("at", "part"))), lambda x: x["part"])).alias("ids"))
    slots = mixture.select("shard", "slot", "source", "block", "repeat").distinct()
    return slots.join(blocks, ["source", "block"]).select("shard", "slot", "source", "block", "repeat", "ids")
