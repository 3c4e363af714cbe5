"""Problem 1: repeated consecutive events."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.llm.readings import block_arrays, blocks, first_readings, let, readings


def collapse_runs(tokens: DataFrame, least: int = 2, letters: int = 1) -> DataFrame:
    """Each run of like tokens at positions without a hole as one event.

    A token continues the run of the token one position before if both have the same glyph and their variants differ
    by at most so many letters added, dropped or changed. Only runs of at least so many tokens are returned:
    line_id, glyph, variant (of the first token), variants (how many different), start_pos, end_pos, n_tokens,
    first_read_at, last_read_at and seconds between them.

    Within a line, tokens of a glyph are canonicalised: a glyph's tokens get a new number wherever the variant
    differs by more than allowed from that of the glyph's token before. Position less row number within line and
    canonical event is then constant in a run and differs between runs.

    Null or negative pos and null line_id: left out. Unreadable tokens break a run. Rows of one position count once;
    where their readings differ, the least one counts, with its earliest known time. read_at may be null or out of order: the earliest and latest
    that are known count, and seconds is null where none is. An empty table gives no rows; other columns don't matter.
    """
    rows = blocks(readings(tokens, "read_at"))
    toks = first_readings(F.col("toks"))
    if least > 1:  # most tokens have no like neighbour; at a block's ends the neighbour isn't seen here
        like = lambda u, x, i, by: F.get(u, i + by).isNull() | ((F.get(u, i + by)["pos"] == x["pos"] + by) & (F.get(u, i + by)["glyph"] == x["glyph"]))
        toks = let(toks, lambda u: F.filter(u, lambda x, i: like(u, x, i, -1) | like(u, x, i, 1)))
    place = block_arrays(rows.select("line_id", "block", "pos", "glyph", "variant", F.col("read_at").isNull().alias("unknown"), "read_at")).withColumn("toks", toks)
    one = place.select("line_id", F.inline("toks"))
    by_glyph = Window.partitionBy("line_id", "glyph").orderBy("pos")
    by_event = Window.partitionBy("line_id", "glyph", "kind").orderBy("pos")
    return (
        one.withColumn("unlike", (F.levenshtein("variant", F.lag("variant").over(by_glyph)) > letters).cast("int"))
        .withColumn("kind", F.sum(F.coalesce("unlike", F.lit(0))).over(by_glyph))
        .withColumn("run", F.col("pos") - F.row_number().over(by_event))
        .groupBy("line_id", "glyph", "kind", "run")
        .agg(
            F.min_by("variant", "pos").alias("variant"),
            F.count_distinct("variant").alias("variants"),
            F.min("pos").alias("start_pos"),
            F.max("pos").alias("end_pos"),
            F.count("*").alias("n_tokens"),
            F.min("read_at").alias("first_read_at"),
            F.max("read_at").alias("last_read_at"),
        )
        .where(F.col("n_tokens") >= least)
        .withColumn("seconds", (F.unix_micros(F.col("last_read_at").cast("timestamp")) - F.unix_micros(F.col("first_read_at").cast("timestamp"))) / 1e6)
        .drop("kind", "run")
    )
