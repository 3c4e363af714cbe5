"""Problem 5: frequency of every distinct term and n-gram, from a suffix array with common-prefix intervals."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.llm.readings import BLOCK, block_arrays, blocks, first_readings, readings, term
from tesserae.plans.stages import stage


def suffixes(tokens: DataFrame, depth: int) -> DataFrame:
    """line_id, t0 .. t(depth-1), repeat: each position's suffix, cut at depth terms or at a hole (null from there).

    repeat: how many first terms it has in common with the suffix before it in the order of the same line's suffixes.
    So a suffix stands for an n-gram that its line held before, in this order, if repeat >= n.
    """
    read = readings(tokens).select("line_id", "pos", term().alias("term"))
    size = max(BLOCK, 4 * depth)
    arrays = block_arrays(blocks(read, depth - 1, size)).withColumn("toks", first_readings(F.col("toks")))
    at = arrays.select("line_id", "block", "toks", F.posexplode("toks").alias("i", "tok")).where(F.floor(F.col("tok.pos") / size) == F.col("block"))
    one = at.select("line_id", F.col("tok.pos").alias("pos"), F.col("tok.term").alias("t0"), *(F.get("toks", F.col("i") + k).alias(f"n{k}") for k in range(1, depth)))
    for k in range(1, depth):  # positions without a hole
        one = one.withColumn(f"t{k}", F.when(F.col(f"n{k}.pos") == F.col("pos") + k, F.col(f"n{k}.term"))).drop(f"n{k}")
    terms = [f"t{k}" for k in range(depth)]
    w = Window.partitionBy("line_id", "t0").orderBy(*terms[1:], "pos")
    common = F.when(F.lag("pos").over(w).isNull(), 0)
    for k in range(1, depth):
        common = common.when(F.coalesce(F.lag(f"t{k}").over(w) != F.col(f"t{k}"), F.lit(True)), k)
    return one.select("line_id", *terms, common.otherwise(depth).alias("repeat"))


def intervals(batches: Iterator[pa.RecordBatch], depth: int) -> Iterator[pa.RecordBatch]:
    """(n, gram, occurrences, repeats) of each interval of suffixes with n terms in common, as far as a batch holds it."""
    for b in batches:
        if not b.num_rows:
            continue
        repeat = b["repeat"].to_numpy()
        new, valid, gram = np.zeros(b.num_rows, bool), np.ones(b.num_rows, bool), None
        new[0] = True
        for n in range(1, depth + 1):
            t = b[f"t{n - 1}"]
            valid &= ~t.is_null().to_numpy(zero_copy_only=False)
            new[1:] |= ~pc.fill_null(pc.equal(t[1:], t[:-1]), False).to_numpy(zero_copy_only=False)
            first = np.flatnonzero(new)
            here = first[valid[first]]
            ends = np.append(first, b.num_rows)
            size = np.diff(ends)[valid[first]]
            again = np.add.reduceat((repeat >= n).astype(np.int64), first)[valid[first]]
            text = pc.binary_join_element_wise(*(b[f"t{k}"].take(pa.array(here)) for k in range(n)), " ")
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(here), n, np.int32)), text.cast(pa.string()), pa.array(size.astype(np.int64)), pa.array(again)], ["n", "gram", "occurrences", "repeats"])


def gram_frequencies(tokens: DataFrame, depth: int = 1, rare: int = 2, common: int = 5) -> DataFrame:
    """Every n-gram of up to depth terms: n, gram, occurrences, records, n_lines and mark.

    mark is rare if records <= rare, common if common * records > n_lines, else null. An n-gram takes positions
    without a hole. The suffixes of all lines are sorted over the cluster, by terms and then line, so that a very
    frequent term is spread over several partitions. Suffixes with n terms in common lie side by side: their number is the
    n-gram's occurrences, and without those that repeat one of their own line, the lines that hold it. Parts of an
    interval on both sides of a cut are added up.

    Null line_id or null or negative pos: left out. Unreadable tokens end an n-gram and aren't counted. Repeated rows
    of a position count once. Without tokens there are no rows.
    """
    sorted_by = [f"t{k}" for k in range(depth)]
    held = stage(suffixes(tokens, depth), "suffixes")
    lines = held.select("line_id").distinct().count()
    array = held.repartitionByRange(*sorted_by, "line_id").sortWithinPartitions(*sorted_by, "line_id")
    parts = array.select(*sorted_by, "repeat").mapInArrow(lambda b: intervals(b, depth), "n int, gram string, occurrences long, repeats long")
    total = parts.groupBy("n", "gram").agg(F.sum("occurrences").alias("occurrences"), (F.sum("occurrences") - F.sum("repeats")).alias("records"))
    mark = F.when(F.col("records") <= rare, "rare").when(F.col("records") * common > lines, "common")
    return total.select("n", "gram", "occurrences", "records", F.lit(lines).cast("long").alias("n_lines"), mark.alias("mark"))
