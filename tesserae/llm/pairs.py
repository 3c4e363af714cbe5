"""Problem 2: items that appear together."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.readings import BLOCK, blocks, line_count_and, long_lines, map_blocks, readings
from tesserae.plans.index import numbered
from tesserae.plans.stages import broadcast_below, stage

#: More kinds of eligible items than this are joined by a shuffle, not broadcast.
BROADCAST_ROWS = 200_000


def baskets(windows: list[int]):
    """For each block and item: the items with a higher id near it, each with the least window that holds it.

    A pair belongs to the block in which its first position lies.
    """

    def of(x: dict, size: int) -> pa.RecordBatch:
        group, pos, item = x["_group"], x["pos"], x["id"].astype(np.int64)
        own = pos // size == x["block"][group]
        kinds, classes = int(item.max(initial=0)) + 1, len(windows)
        found = []
        for k in range(1, min(windows[-1], len(pos) - 1) + 1):
            d = pos[k:] - pos[:-k]
            at = np.flatnonzero((group[k:] == group[:-k]) & (d <= windows[-1]) & (item[k:] != item[:-k]) & own[:-k])
            a, b = item[at], item[at + k]
            found.append(((group[at] * kinds + np.minimum(a, b)) * kinds + np.maximum(a, b)) * classes + np.searchsorted(windows, d[at]))
        key = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        pair, near = np.divmod(key, classes)
        first = np.ones(len(pair), bool)
        first[1:] = np.diff(pair) != 0  # the least window comes first
        pair, near = pair[first], near[first]
        basket, other = np.divmod(pair, kinds)
        start = np.flatnonzero(np.diff(basket, prepend=-1))
        offsets = np.append(start, len(basket)).astype(np.int32)
        g, a = np.divmod(basket[start], kinds)
        items = pa.ListArray.from_arrays(pa.array(offsets), pa.array((other * classes + near).astype(np.int64)))
        return pa.RecordBatch.from_arrays([pa.array(x["line_id"][g]), pa.array(a.astype(np.int32)), items], ["line_id", "a", "items"])

    return of


def pairs_together(tokens: DataFrame, windows: list[int], least_lines: int = 1, share: int | None = None, lift: int | None = None) -> DataFrame:
    """For each window w and pair of different glyphs: in how many lines they stand within w positions, and the lift.

    Returns context_window, glyph_a < glyph_b, n_ab, n_a, n_b, n_lines, lift (n_ab * n_lines / (n_a * n_b)) and
    conviction (of a -> b; null where every line with a holds the pair). Only pairs with n_ab >= least_lines, share * n_ab >=
    n_lines and n_ab * n_lines >= lift * n_a * n_b are returned, as far as these are given.

    Items too rare for share or too common for lift can be in no such pair and are dropped first; the rest are at most
    share times the mean number of glyphs in a line. For each line and item, the basket is the deduplicated array of
    its higher neighbours, each with the least window that reaches it. Equal baskets of all lines are collapsed into a
    weight, each distinct basket is unfolded once, and weights are summed. A line longer than a block counts each
    pair once, too.

    Null line_id or null or negative pos: left out. Unreadable tokens keep their position and pair with nothing.
    Repeated rows of a position count once. Windows that are null or not positive are ignored; without windows or
    tokens there are no rows.
    """
    windows = sorted({int(w) for w in windows if w is not None and w > 0})
    spark = tokens.sparkSession
    empty = spark.createDataFrame([], "context_window int, glyph_a string, glyph_b string, n_ab long, n_a long, n_b long, n_lines long, lift double, conviction double")
    if not windows:
        return empty
    size = max(BLOCK, 4 * windows[-1])
    read = readings(tokens).select("line_id", "pos", "glyph")
    counts = stage(line_count_and(read, "glyph"), "glyph-lines")
    total = counts.where("glyph IS NULL").select("n").first()
    if not total:
        return empty
    lines = total[0]
    items = counts.where(F.col("glyph").isNotNull() & (F.col("n") >= least_lines))
    if share:
        items = items.where(F.col("n") * share >= lines)
    if lift:
        items = items.where(F.col("n") * lift <= lines)
    # the ids are in the order of the glyphs: a < b is glyph_a < glyph_b
    known = stage(numbered(items, "glyph"), "pair-items")
    known = broadcast_below(known, BROADCAST_ROWS)
    coded = read.join(known.select("glyph", "id"), "glyph").select("line_id", "pos", "id")
    of = baskets(windows)
    made = map_blocks(blocks(coded, windows[-1], size), lambda x: of(x, size), "line_id long, a int, items array<long>")
    made = collapse_long(made, long_lines(tokens, size), len(windows))
    weights = made.groupBy("a", "items").agg(F.count("*").alias("weight"))
    classes = len(windows)
    near = weights.select("a", F.explode("items").alias("item"), "weight").groupBy("a", "item").agg(F.sum("weight").alias("n"))
    by_pair = near.groupBy("a", F.floor(F.col("item") / classes).cast("int").alias("b")).agg(*(F.sum(F.when(F.col("item") % classes <= k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in range(classes)))
    each = by_pair.select("a", "b", F.inline(F.array(*(F.struct(F.lit(w).cast("int").alias("context_window"), F.col(f"n{k}").alias("n_ab")) for k, w in enumerate(windows)))))
    each = each.where(F.col("n_ab") >= least_lines)
    if share:
        each = each.where(F.col("n_ab") * share >= lines)
    side = lambda x: known.select(F.col("id").alias(x), F.col("glyph").alias(f"glyph_{x}"), F.col("n").alias(f"n_{x}"))
    out = each.join(side("a"), "a").join(side("b"), "b").withColumn("n_lines", F.lit(lines).cast("long"))
    if lift:
        out = out.where(F.col("n_ab") * F.col("n_lines") >= F.lit(lift) * F.col("n_a") * F.col("n_b"))
    return out.select(
        "context_window", "glyph_a", "glyph_b", "n_ab", "n_a", "n_b", "n_lines",
        (F.col("n_ab") * F.col("n_lines") / (F.col("n_a") * F.col("n_b"))).alias("lift"),
        F.when(F.col("n_ab") < F.col("n_a"), (1 - F.col("n_b") / F.col("n_lines")) / (1 - F.col("n_ab") / F.col("n_a"))).alias("conviction"),
    )


def collapse_long(made: DataFrame, long: DataFrame, classes: int) -> DataFrame:
    """The baskets of a line's blocks as one basket: only for the lines with several blocks, usually none."""
    long = stage(long, "long-lines")
    if long.isEmpty():
        return made.select("a", "items")
    long = broadcast_below(long, BROADCAST_ROWS)
    made = made.withColumn("_made", F.lit(1))
    merged = (
        made.join(long, "line_id", "left_semi")
        .select("line_id", "a", F.explode("items").alias("item"))
        .groupBy("line_id", "a", F.floor(F.col("item") / classes).alias("b"))
        .agg(F.min("item").alias("item"))
        .groupBy("line_id", "a")
        .agg(F.array_sort(F.collect_list("item")).alias("items"))
    )
    return made.join(long, "line_id", "left_anti").select("a", "items").unionByName(merged.select("a", "items"))
