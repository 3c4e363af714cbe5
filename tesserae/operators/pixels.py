"""Pixel tables (img, x, y, v): profiles, islands, boxes and overlaps."""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ink_profile(pixels: DataFrame, axis: str, threshold: int = 190) -> DataFrame:
    """img, axis and n: in how many places of each row (axis y) or column (axis x) there is ink; places without ink give no row."""
    return pixels.where(F.col("v") < threshold).groupBy("img", axis).agg(F.count("*").alias("n"))


def islands(profile: DataFrame, at: str, least: int, max_gap: int, *keys: str) -> DataFrame:
    """keys, run, low and high (exclusive): stretches of places with n >= least, joined over at most max_gap places without."""
    w = Window.partitionBy(*keys).orderBy(at)
    new = F.when(F.col(at) - F.lag(at).over(w) <= max_gap + 1, 0).otherwise(1)
    runs = profile.where(F.col("n") >= least).withColumn("new", new).withColumn("run", F.sum("new").over(w))
    return runs.groupBy(*keys, "run").agg(F.min(at).alias("low"), (F.max(at) + 1).alias("high")).withColumn("run", F.col("run").cast("int"))


def placed_ink(pixels: DataFrame, threshold: int, row_ink: int, column_ink: int, row_gap: int, column_gap: int) -> DataFrame:
    """img, line, run, x and y of the ink within coarse regions: rows with enough ink make lines, columns with enough ink within a line make runs; both close over small gaps."""
    ink = pixels.where(F.col("v") < threshold).select("img", "x", "y").distinct()
    lines = islands(ink.groupBy("img", "y").agg(F.count("*").alias("n")), "y", row_ink, row_gap, "img")
    rows = lines.select("img", F.col("run").alias("line"), F.explode(F.sequence("low", F.col("high") - 1)).alias("y"))
    placed = ink.join(rows, ["img", "y"])
    signs = islands(placed.groupBy("img", "line", "x").agg(F.count("*").alias("n")), "x", column_ink, column_gap, "img", "line")
    columns = signs.select("img", "line", "run", F.explode(F.sequence("low", F.col("high") - 1)).alias("x"))
    return placed.join(columns, ["img", "line", "x"]).select("img", "line", "run", "x", "y")


def segments(pixels: DataFrame, threshold: int = 190, row_ink: int = 6, column_ink: int = 2, row_gap: int = 5, column_gap: int = 1, padding: int = 2) -> DataFrame:
    """img, number, left, top, right and bottom (exclusive) of the signs of each image, with padding within its pixels.

    Signs are the regions of placed_ink(), numbered from 1, line by line and from the left.
    """
    size = pixels.groupBy("img").agg(F.max("x").alias("w"), F.max("y").alias("h"))
    placed = placed_ink(pixels, threshold, row_ink, column_ink, row_gap, column_gap)
    box = placed.groupBy("img", "line", "run").agg(F.min("x").alias("l"), F.min("y").alias("t"), F.max("x").alias("r"), F.max("y").alias("b"))
    number = F.row_number().over(Window.partitionBy("img").orderBy("line", "run"))
    return padded(box.withColumn("number", number), size, padding, "number")


def padded(box: DataFrame, size: DataFrame, padding: int, *more: str) -> DataFrame:
    """img, more, left, top, right and bottom of boxes (l, t, r, b, all within) with padding as far as the image goes."""
    edge = lambda low, high: F.least(F.col(low) + 1 + padding, F.col(high) + 1)
    return box.join(size, "img").select("img", *more, F.greatest(F.col("l") - padding, F.lit(0)).alias("left"), F.greatest(F.col("t") - padding, F.lit(0)).alias("top"), edge("r", "w").alias("right"), edge("b", "h").alias("bottom"))


def bounding_boxes(pixels: DataFrame, threshold: int = 190, padding: int = 0) -> DataFrame:
    """img, left, top, right and bottom (exclusive) of the ink, with padding but not below 0."""
    box = pixels.where(F.col("v") < threshold).groupBy("img").agg(F.min("x").alias("l"), F.min("y").alias("t"), F.max("x").alias("r"), F.max("y").alias("b"))
    return box.select("img", F.greatest(F.col("l") - padding, F.lit(0)).alias("left"), F.greatest(F.col("t") - padding, F.lit(0)).alias("top"), (F.col("r") + 1 + padding).alias("right"), (F.col("b") + 1 + padding).alias("bottom"))


def binarize(pixels: DataFrame, threshold: int = 128) -> DataFrame:
    return pixels.withColumn("v", F.when(F.col("v") < threshold, 0).otherwise(255))


def mask_scores(masks: DataFrame, candidates: DataFrame) -> DataFrame:
    """img, label, overlap, union_, score of masks packed in arrays of bits: overlap / union - 0.0001 * difference.

    masks has img, key and mask, candidates has key, label and mask; masks are compared within a key.
    """
    bits = lambda a, b, f: F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(f(x, y)).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)
    both = masks.join(candidates.withColumnRenamed("mask", "other"), "key")
    m, o = F.col("mask"), F.col("other")
    counted = both.select("img", "label", bits(m, o, lambda x, y: x.bitwiseAND(y)).alias("overlap"), bits(m, o, lambda x, y: x.bitwiseOR(y)).alias("union_"), bits(m, o, lambda x, y: x.bitwiseXOR(y)).alias("differ"))
    return counted.select("img", "label", "overlap", "union_", (F.col("overlap") / F.greatest("union_", F.lit(1)) - 0.0001 * F.col("differ")).alias("score"))


def ranked_masks(scores: DataFrame, top: int) -> DataFrame:
    """scores with rank (from 1): the top labels of each image by score; of equal ones the lower label first."""
    w = Window.partitionBy("img").orderBy(F.col("score").desc(), "label")
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


#: Widths of strips, as shares of the image, that differ from an even cut; a share cut off on the right; a border
#: cut off all around, and then a white band at the lower left (width and height), all by the strip's number.
STRIP_SHARES, RIGHT_TRIM, BORDERED, BORDER, BAND = {93: 0.18, 94: 0.22, 468: 0.18, 469: 0.22}, {639: 0.05}, (535, 539), 0.01, (32, 16)


def by_number(values: dict[int, float], other: float) -> Column:
    number = F.col("number")
    return F.coalesce(*(F.when(number == k, F.lit(v)) for k, v in values.items()), F.lit(other)) if values else F.lit(other)


def strip_boxes(images: DataFrame, strips: int = 5, shares: dict[int, float] = STRIP_SHARES) -> DataFrame:
    """img, strip, number, left, top, right and bottom (exclusive) of vertical strips of an image's full height.

    images has img, width, height and number, that of its first strip. A strip lies around the middle of its even
    part of the width and is as wide as its share says (1 / strips unless shares has its number); one that reaches over an edge is
    moved inwards. Halves are rounded to even.
    """
    whole = lambda x: F.rint(x).cast("int")
    each = images.select("img", "width", "height", F.col("number").alias("first"), F.explode(F.sequence(F.lit(0), F.lit(strips - 1))).alias("strip")).withColumn("number", F.col("first") + F.col("strip"))
    wide = each.withColumn("wide", whole(by_number(shares, 1 / strips) * F.col("width")))
    even = whole((F.col("strip") + 0.5) * F.col("width") / strips - F.col("wide") / 2)
    placed = wide.withColumn("left", F.greatest(F.least(even, F.col("width") - F.col("wide")), F.lit(0)))
    return placed.select("img", "strip", "number", "left", F.lit(0).alias("top"), F.least(F.col("left") + F.col("wide"), F.col("width")).alias("right"), F.col("height").alias("bottom"))


def mended_boxes(strips: DataFrame) -> DataFrame:
    """strips without the parts that their numbers call for (see RIGHT_TRIM and BORDERED), and band_right and band_top: where the white band ends and begins, null without one."""
    whole = lambda x: F.rint(x).cast("int")
    bordered = F.col("number").between(*BORDERED)
    inset = lambda side: F.when(bordered, whole(F.col(side) * BORDER)).otherwise(0)
    sized = strips.select("img", "strip", "number", "left", "top", F.greatest(whole((F.col("right") - F.col("left")) * (1 - by_number(RIGHT_TRIM, 0.0))), F.lit(1)).alias("_w"), (F.col("bottom") - F.col("top")).alias("_h"))
    cut = sized.select("img", "strip", "number", "left", "top", "_w", "_h", inset("_w").alias("_dx"), inset("_h").alias("_dy"))
    inner = cut.select("img", "strip", "number", (F.col("left") + F.col("_dx")).alias("left"), (F.col("top") + F.col("_dy")).alias("top"), (F.col("left") + F.col("_w") - F.col("_dx")).alias("right"), (F.col("top") + F.col("_h") - F.col("_dy")).alias("bottom"))
    return inner.select("*", F.when(bordered, F.least(F.col("right"), F.col("left") + BAND[0])).alias("band_right"), F.when(bordered, F.greatest(F.col("top"), F.col("bottom") - BAND[1])).alias("band_top"))


def strip_pixels(pixels: DataFrame, boxes: DataFrame) -> DataFrame:
    """img, strip, x, y (within the strip) and v of the pixels in each of boxes, as mended_boxes() gives them; white in the band."""
    x, y = F.col("x"), F.col("y")
    inside = (x >= F.col("left")) & (x < F.col("right")) & (y >= F.col("top")) & (y < F.col("bottom"))
    white = (x < F.col("band_right")) & (y >= F.col("band_top"))
    return pixels.join(boxes, "img").where(inside).select("img", "strip", (x - F.col("left")).alias("x"), (y - F.col("top")).alias("y"), F.when(white, 255).otherwise(F.col("v")).alias("v"))


def grid_areas(sheets: DataFrame, labels: list[str], rows: int = 4, columns: int = 13, margin: tuple[int, int] = (8, 6), share: float = 0.56) -> DataFrame:
    """img, label, left, top, right and bottom (exclusive) of the signs on sheets (img, width, height) of labelled cells, row by row.

    A sign takes the upper share of its cell, without a margin at the left, top and right.
    """
    whole = lambda x: F.rint(x).cast("int")
    each = sheets.select("img", "width", "height", F.posexplode(F.array(*map(F.lit, labels[: rows * columns]))).alias("_k", "label"))
    row, column = F.floor(F.col("_k") / columns), F.col("_k") % columns
    cell = each.select(
        "img", "label", whole(column * F.col("width") / columns).alias("left"), whole((column + 1) * F.col("width") / columns).alias("right"),
        whole(row * F.col("height") / rows).alias("top"), whole((row + 1) * F.col("height") / rows).alias("bottom"),
    )
    return cell.select("img", "label", (F.col("left") + margin[0]).alias("left"), (F.col("top") + margin[1]).alias("top"), (F.col("right") - margin[0]).alias("right"), (F.col("top") + whole((F.col("bottom") - F.col("top")) * share)).alias("bottom"))


def crops(pixels: DataFrame, boxes: DataFrame, *keys: str) -> DataFrame:
    """img, keys, x, y (within the box) and v of the pixels in each of boxes."""
    x, y = F.col("x"), F.col("y")
    inside = (x >= F.col("left")) & (x < F.col("right")) & (y >= F.col("top")) & (y < F.col("bottom"))
    return pixels.join(boxes, "img").where(inside).select("img", *keys, (x - F.col("left")).alias("x"), (y - F.col("top")).alias("y"), "v")


def glyph_masks(pixels: DataFrame, *keys: str, size: int = 72, border: int = 4, threshold: int = 180) -> DataFrame:
    """img, keys and mask: the ink of each image, cropped, brought to a square of size with a border, and packed in 64-bit words row by row.

    The crop is scaled by one factor so that it fits, and placed in the middle; a place of the mask has ink if ink falls on
    it. An image without ink gives no row.
    """
    by, inner = ["img", *keys], size - 2 * border
    ink = pixels.where(F.col("v") < threshold).select(*by, "x", "y")
    box = ink.groupBy(*by).agg(F.min("x").alias("l"), F.min("y").alias("t"), (F.max("x") - F.min("x") + 1).alias("w"), (F.max("y") - F.min("y") + 1).alias("h"))
    longer = F.greatest("w", "h")
    fit = lambda side: F.greatest(F.rint(F.col(side) * inner / longer).cast("int"), F.lit(1))
    placed = box.select(*by, "l", "t", "w", "h", fit("w").alias("fw"), fit("h").alias("fh"))
    at = lambda c, low, side, f: F.floor((F.col(c) - F.col(low)) * F.col(f) / F.col(side)) + F.floor((size - F.col(f)) / 2)
    place = at("y", "t", "h", "fh") * size + at("x", "l", "w", "fw")
    words = ink.join(placed, by).select(*by, place.alias("at")).groupBy(*by, F.floor(F.col("at") / 64).cast("int").alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("at") % 64).cast("int"))).alias("bits"))
    every = F.sequence(F.lit(0), F.lit((size * size + 63) // 64 - 1))
    held = words.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("_m"))
    return held.select(*by, F.transform(every, lambda k: F.coalesce(F.try_element_at("_m", k), F.lit(0).cast("long"))).alias("mask"))


def best_seam(ink: np.ndarray, max_step: int = 1, low: int = 0, high: int | None = None, most: int | None = None) -> tuple[int, list[int]]:
    """Cost (ink pixels on it) and columns of the cheapest seam from top to bottom; the leftmost of several.

    With most, it stops in the row where every seam has crossed more, with that cost and no columns.
    """
    far, columns = 1 << 40, np.arange(ink.shape[1])
    high = ink.shape[1] if high is None else high
    outside = (columns < low) | (columns >= high)
    padded = np.full(ink.shape[1] + 2 * max_step, far, np.int64)
    cost = padded[max_step : max_step + ink.shape[1]]
    options = np.lib.stride_tricks.sliding_window_view(padded, ink.shape[1])  # by step, of the row before
    cost[:] = np.where(outside, far, ink[0])
    back = []
    for row in ink[1:]:
        if most is not None and cost.min() > most:
            return int(cost.min()), []
        step = options.argmin(0)
        back.append(np.clip(columns + step - max_step, 0, len(columns) - 1))
        cost[:] = np.where(outside, far, options.min(0) + row)
    at = int(cost.argmin())
    path, total = [at], int(cost[at])
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return total, path[::-1]


def split_by_seams(pixels: DataFrame, threshold: int = 190, min_split: int = 35, min_part: int = 10, max_ink: int = 0, max_step: int = 1, regions: tuple[str, ...] = ()) -> DataFrame:
    """img, regions, part, left, right, top, bottom and n_ink: regions cut at seams that cross at most max_ink pixels of ink.

    A region (an image, or of each image what has the same values in the columns named) at least min_split wide is cut so that both parts keep
    min_part columns, as often as it goes; parts are numbered from the left. The pixels of one region are one group: images are of bounded size,
    their number isn't.
    """
    keys = ["img", *regions]

    def cut(image: pd.DataFrame) -> pd.DataFrame:
        x, y = image["x"].to_numpy(), image["y"].to_numpy()
        done, todo = [], [np.ones(len(x), bool)]
        while todo:
            own = todo.pop()
            left, width, top = x[own].min(), int(np.ptp(x[own])) + 1, y[own].min()
            if width >= max(min_split, 2 * min_part + 1):
                grid = np.zeros((int(np.ptp(y[own])) + 1, width), bool)
                grid[y[own] - top, x[own] - left] = True
                cost, path = best_seam(grid, max_step, min_part, width - min_part, max_ink)
                if cost <= max_ink:
                    is_left = own & (x - left < np.array(path)[np.clip(y - top, 0, len(path) - 1)])
                    if is_left.any() and (own & ~is_left).any():
                        todo += [is_left, own & ~is_left]
                        continue
            done.append(own)
        done.sort(key=lambda o: (x[o].min(), y[o].min()))
        found = [(k, int(x[o].min()), int(x[o].max()) + 1, int(y[o].min()), int(y[o].max()) + 1, int(o.sum())) for k, o in enumerate(done)]
        out = pd.DataFrame(found, columns=["part", "left", "right", "top", "bottom", "n_ink"])
        for i, c in enumerate(keys):
            out.insert(i, c, image[c].iloc[0])
        return out

    whole = lambda c: F.col(c).cast("int").alias(c)
    ink = (pixels.where(F.col("v") < threshold) if "v" in pixels.columns else pixels).select("img", *map(whole, regions), whole("x"), whole("y")).distinct()
    schema = ", ".join(["img long", *(f"{c} int" for c in regions), "part int, left int, right int, top int, bottom int, n_ink long"])
    return ink.groupBy(*keys).applyInPandas(cut, schema)


def seam_segments(pixels: DataFrame, threshold: int = 190, row_ink: int = 6, column_ink: int = 2, row_gap: int = 5, column_gap: int = 1, min_split: int = 35, min_part: int = 10, max_ink: int = 0, max_step: int = 1, padding: int = 2) -> DataFrame:
    """img, number, left, top, right, bottom and n_ink: the coarse regions of placed_ink(), each cut by seams, numbered from 1 by line, run and part, with padding."""
    size = pixels.groupBy("img").agg(F.max("x").alias("w"), F.max("y").alias("h"))
    placed = placed_ink(pixels, threshold, row_ink, column_ink, row_gap, column_gap)
    parts = split_by_seams(placed, threshold, min_split, min_part, max_ink, max_step, ("line", "run"))
    number = F.row_number().over(Window.partitionBy("img").orderBy("line", "run", "part"))
    box = parts.withColumn("number", number).select("img", "number", "n_ink", F.col("left").alias("l"), F.col("top").alias("t"), (F.col("right") - 1).alias("r"), (F.col("bottom") - 1).alias("b"))
    return padded(box, size, padding, "number", "n_ink")
