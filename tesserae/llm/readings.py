"""How a token is read, and the lines cut into blocks of positions."""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Positions of a line that one group holds at most; a longer line is cut, so no line grows into one large group.
BLOCK = 512


def variant_letters(variant: Column) -> Column:
    """The letters a to g in lower case; '' for none."""
    return F.coalesce(F.regexp_replace(F.lower(variant), "[^a-g]", ""), F.lit(""))


def modifier_letters(modifiers: Column) -> Column:
    """All letters in lower case with commas between; '' for none."""
    letters = F.regexp_replace(F.lower(F.array_join(modifiers, "")), r"[^\p{L}]", "")
    return F.when(F.size(modifiers) > 0, F.regexp_replace(letters, "(.)(?!$)", "$1,")).otherwise("")


def readings(tokens: DataFrame, *more: str) -> DataFrame:
    """line_id, pos, glyph, variant, modifiers of every readable row, and the columns in more as they are.

    Rows without line_id or with a null or negative pos have no place and are left out, like rows without a digit in glyph.
    The digits are taken in a projection of their own, so that they are looked for once and not for each use.
    """
    placed = tokens.where("line_id IS NOT NULL AND pos >= 0 AND glyph RLIKE '[0-9]'")
    taken = placed.select("line_id", "pos", F.regexp_extract("glyph", "[0-9]+", 0).alias("_digits"), F.col("variant").alias("_variant"), F.col("modifiers").alias("_modifiers"), *more)
    glyph = F.when(F.length("_digits") < 3, F.lpad("_digits", 3, "0")).otherwise(F.col("_digits"))
    return taken.select("line_id", "pos", glyph.alias("glyph"), variant_letters(F.col("_variant")).alias("variant"), modifier_letters(F.col("_modifiers")).alias("modifiers"), *more)


def event(glyph: str = "glyph", modifiers: str = "modifiers") -> Column:
    """076 or 076+h,x."""
    return F.concat(F.col(glyph), F.when(F.col(modifiers) != "", F.concat(F.lit("+"), F.col(modifiers))).otherwise(""))


def term(glyph: str = "glyph", variant: str = "variant") -> Column:
    """076 or 076:a."""
    return F.concat(F.col(glyph), F.when(F.col(variant) != "", F.concat(F.lit(":"), F.col(variant))).otherwise(""))


def blocks(rows: DataFrame, halo: int = 0, block: int = BLOCK) -> DataFrame:
    """rows with a column block: pos // block.

    The first halo positions of a block come a second time under the block before, so that whatever starts in a
    block and reaches at most halo positions further lies whole within it.
    """
    own = F.floor(F.col("pos") / block).cast("int")
    if not halo:
        return rows.withColumn("block", own)
    both = F.when((F.col("pos") >= block) & (F.col("pos") % block < halo), F.array(own, own - 1)).otherwise(F.array(own))
    return rows.withColumn("block", F.explode(both))


def block_arrays(rows: DataFrame) -> DataFrame:
    """line_id, block and toks: an array of structs of the other columns, pos first, each reading once.

    Repeated rows vanish before the shuffle; a group holds the different readings of one block, never a whole long
    line.
    """
    rest = [c for c in rows.columns if c not in ("line_id", "block", "pos")]
    return rows.groupBy("line_id", "block").agg(F.collect_set(F.struct("pos", *rest)).alias("toks"))


def let(value: Column, of: Callable[[Column], Column]) -> Column:
    """of(value), with value evaluated once, not again for each use inside a lambda."""
    return F.transform(F.array(value), of)[0]


def first_readings(toks: Column) -> Column:
    """toks in the order of pos, one struct for each pos: the least of several."""
    return let(F.sort_array(toks), lambda up: F.filter(up, lambda x, i: (i == 0) | (up[i - 1]["pos"] != x["pos"])))


def long_lines(tokens: DataFrame, block: int = BLOCK) -> DataFrame:
    """line_id of the lines with more than one block, usually none: the filter on pos reaches the scan."""
    return tokens.where(F.col("pos") >= block).where("line_id IS NOT NULL").select("line_id").distinct()


def map_blocks(rows: DataFrame, fn: Callable[[dict[str, np.ndarray]], pa.RecordBatch], schema: str, tokens: int = 400_000) -> DataFrame:
    """map_arrays() over rows as block_arrays() takes them."""
    return map_arrays(block_arrays(rows), fn, schema, tokens)


def map_arrays(arrays: DataFrame, fn: Callable[[dict[str, np.ndarray]], pa.RecordBatch], schema: str, tokens: int = 400_000) -> DataFrame:
    """fn over many whole blocks at a time, in the order of pos; arrays as block_arrays() gives them, without nulls.

    fn gets numpy arrays: line_id and block for each block, and for each position _group (the number of its block),
    pos and the other columns; strings come as a pair of codes and the values they stand for. A position with several
    readings keeps the least. About so many tokens are given at once.
    """

    def give(b: pa.RecordBatch) -> pa.RecordBatch:
        toks = b["toks"]
        size = np.diff(toks.offsets.to_numpy())
        flat = toks.flatten()
        x: dict = {"_group": np.repeat(np.arange(b.num_rows), size)}
        for k in range(flat.type.num_fields):
            col = flat.field(k)
            if pa.types.is_string(col.type):
                d = col.dictionary_encode()
                x[flat.type.field(k).name] = (d.indices.to_numpy(), d.dictionary.to_pylist())
            else:
                x[flat.type.field(k).name] = col.to_numpy()
        keys = []
        for v in list(x.values())[2:]:
            keys.append(np.argsort(np.argsort(v[1], kind="stable"), kind="stable")[v[0]] if isinstance(v, tuple) and len(v[1]) else v[0] if isinstance(v, tuple) else v)
        order = np.lexsort([*keys[::-1], x["pos"], x["_group"]])
        pick = lambda v, at: (v[0][at], v[1]) if isinstance(v, tuple) else v[at]
        x = {c: pick(v, order) for c, v in x.items()}
        keep = np.ones(len(order), bool)
        keep[1:] = (np.diff(x["_group"]) != 0) | (np.diff(x["pos"]) != 0)
        x = {c: pick(v, keep) for c, v in x.items()}
        return fn(x | {"line_id": b["line_id"].to_numpy(), "block": b["block"].to_numpy()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ends, at = b["toks"].offsets.to_numpy(), 0
            while at < b.num_rows:
                upto = max(at + 1, int(np.searchsorted(ends, ends[at] + tokens, "right")) - 1)
                yield give(b.slice(at, min(upto, b.num_rows) - at))
                at = upto

    return arrays.mapInArrow(run, schema)


def line_count_and(keys: DataFrame, key: str) -> DataFrame:
    """(key, n): in how many lines each key stands; under the key null, the number of lines.

    keys has line_id and key. Repeated keys of a line are dropped before anything is shuffled, and once more after.
    """
    both = keys.select("line_id", F.explode(F.array(F.col(key), F.lit(None).cast("string"))).alias(key))
    return both.groupBy("line_id", key).agg(F.lit(1).alias("_one")).groupBy(key).agg(F.count("*").alias("n"))
