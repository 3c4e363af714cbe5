"""Problem 4: long exact spans shared between records, found by recompression."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.llm.pairs import BROADCAST_ROWS
from tesserae.llm.readings import BLOCK, blocks, map_blocks, readings
from tesserae.plans.stages import broadcast_below, stage

M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)  # the constants of splitmix64
NONE = np.int64(-(2**62))  # no neighbour


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


def text_names(texts: list[str]) -> np.ndarray:
    """A 64-bit name for each string, the same everywhere."""
    import xxhash

    return np.array([xxhash.xxh64_intdigest(t) for t in texts], np.uint64)


def neighbours(v: np.ndarray, part: np.ndarray, by: int, none) -> np.ndarray:
    """v of the symbol before (by=-1) or after (by=1) in the same stretch, none at its ends."""
    out = np.full(len(v), none, v.dtype)
    if by > 0:
        same = part[1:] == part[:-1]
        out[:-1][same] = v[1:][same]
    else:
        same = part[1:] == part[:-1]
        out[1:][same] = v[:-1][same]
    return out


class Symbols:
    """Symbols of many stretches one after the other.

    name, part (its stretch), start and end (its tokens), left and right: the positions that decide that this symbol
    stands here. A stretch that holds the same tokens from left to right has the same symbol there, whatever surrounds
    them; beyond a stretch's ends nothing is known, so a symbol at an end may depend on one position outside.
    """

    def __init__(self, name, part, start, end, left, right):
        self.name, self.part, self.start, self.end, self.left, self.right = name, part, start, end, left, right

    def merged(self, first: np.ndarray, name: np.ndarray, left: np.ndarray, right: np.ndarray) -> "Symbols":
        """The symbols from each index in first up to the next in one."""
        last = np.append(first[1:], len(self.name)) - 1
        return Symbols(name, self.part[first], self.start[first], self.end[last], np.minimum.reduceat(left, first) if len(first) else left, np.maximum.reduceat(right, first) if len(first) else right)

    def runs(self, seed: int) -> "Symbols":
        """Each longest run of one token becomes one symbol named by token and length; the tokens beside it decide where it ends."""
        name, part = self.name, self.part
        if not len(name):
            return self
        new = np.ones(len(name), bool)
        new[1:] = (name[1:] != name[:-1]) | (part[1:] != part[:-1])
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(name)))
        out = self.merged(first, name[first].copy(), self.left, self.right)
        many = size > 1
        out.name[many] = mix(out.name[many] + mix(size[many].astype(np.uint64) + np.uint64(seed << 32)))
        out.left, out.right = out.start - 1, out.end + 1
        return out

    def pairs(self, seed: int) -> "Symbols":
        """A symbol of the left half of the alphabet and one of the right half after it become one; the halves change with seed."""
        name, part = self.name, self.part
        if not len(name):
            return self
        is_left = (mix(name + np.uint64(seed * 0x9E3779B97F4A7C15 % 2**64)) & np.uint64(1)).astype(bool)
        joins = np.zeros(len(name), bool)  # with the one after
        joins[:-1] = is_left[:-1] & ~is_left[1:] & (part[1:] == part[:-1])
        joined = np.zeros(len(name), bool)
        joined[1:] = joins[:-1]
        # one that stays alone does so because of the one after, or before
        left, right = self.left.copy(), self.right.copy()
        before, after = neighbours(self.left, part, -1, NONE), neighbours(self.right, part, 1, NONE)
        alone_l, alone_r = is_left & ~joins, ~is_left & ~joined
        right[alone_l] = np.maximum(right, np.where(after == NONE, self.end + 1, after))[alone_l]
        left[alone_r] = np.minimum(left, np.where(before == NONE, self.start - 1, before))[alone_r]
        first = np.flatnonzero(~joined)
        two = joins[first]
        out = self.merged(first, name[first].copy(), left, right)
        second = first[two] + 1
        out.name[two] = mix(mix(name[first[two]] + np.uint64(seed)) ^ (name[second] * M2))
        return out


def anchors(window: int, phases: int, size: int):
    """For the windows of each block: stretches of windows that share an anchor, with the anchor's name and the tokens.

    A window's anchor is the symbol of the most tokens, of any phase, that is decided within the window; of several
    the one with the greatest name. It depends on nothing but the window's tokens, so equal windows have equal anchors.
    """

    def of(x: dict) -> pa.RecordBatch:
        group, pos = x["_group"], x["pos"].astype(np.int64)
        codes, texts = x["glyph"]
        n = len(pos)
        new = np.ones(n, bool)
        new[1:] = (np.diff(group) != 0) | (np.diff(pos) != 1)
        part = np.cumsum(new) - 1
        at = np.arange(n)  # places in this array; within a stretch they run like pos
        s = Symbols(text_names(texts)[codes] if n else np.zeros(0, np.uint64), part, at, at, at, at)
        last = np.append(np.flatnonzero(new)[1:], n)[part] - 1 if n else at  # the stretch's end
        best = np.zeros(n, np.uint64)
        for k in range(phases + 1):
            if k:
                s = s.runs(k) if k == 1 else s.pairs(k)
            width = s.right - s.left + 1
            ok = np.flatnonzero(width <= window)
            score = (np.minimum(s.end - s.start + 1, 63)[ok].astype(np.uint64) << np.uint64(58)) | (mix(s.name[ok]) >> np.uint64(6))
            low, high = np.maximum(s.right[ok] - window + 1, 0), s.left[ok]  # the windows that hold it start here
            for d in range(window):
                w = low + d
                fit = (w <= high) & (part[np.minimum(w, n - 1)] == s.part[ok])
                np.maximum.at(best, w[fit], score[fit])
        own = (pos // size == x["block"][group]) & (at + window - 1 <= last)
        starts = np.flatnonzero(own)
        fresh = np.ones(len(starts), bool)
        fresh[1:] = (np.diff(starts) != 1) | (part[starts[1:]] != part[starts[:-1]]) | (best[starts[1:]] != best[starts[:-1]])
        first = starts[fresh]
        count = np.diff(np.append(np.flatnonzero(fresh), len(starts)))
        length = count + window - 1
        offsets = np.append(0, np.cumsum(length)).astype(np.int32)
        tokens = codes[np.repeat(first - offsets[:-1], length) + np.arange(offsets[-1])]
        glyphs = pa.DictionaryArray.from_arrays(pa.array(tokens.astype(np.int32)), pa.array(texts, pa.string())).cast(pa.string())
        return pa.RecordBatch.from_arrays(
            [pa.array(best[first].astype(np.int64)), pa.array(x["line_id"][group[first]]), pa.array(pos[first].astype(np.int32)), pa.ListArray.from_arrays(pa.array(offsets), glyphs)],
            ["anchor", "line_id", "pos", "glyphs"],
        )

    return of


def shared_windows(tokens: DataFrame, window: int = 16, phases: int = 9) -> DataFrame:
    """(line_id, pos) of every window of so many readable tokens without a hole that another line holds too.

    Recompression: longest runs of a glyph get a name, then, phase by phase, pairs of neighbouring names; a name depends
    on its tokens only, so that it is the same in all lines. A window that another line holds shares the anchor with
    it (see anchors), so only windows whose anchor stands in several lines are compared, token by token.
    """
    read = readings(tokens).select("line_id", "pos", "glyph")
    size = max(BLOCK, 4 * window)
    of = anchors(window, phases, size)
    held = stage(map_blocks(blocks(read, window - 1, size), of, "anchor long, line_id long, pos int, glyphs array<string>"), "anchors")
    several = F.min("line_id") != F.max("line_id")
    names = stage(held.groupBy("anchor").agg(several.alias("several")).where("several").select("anchor"), "shared-anchors")
    near = held.join(broadcast_below(names, BROADCAST_ROWS), "anchor", "left_semi")
    one = stage(near.select("line_id", "pos", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("glyphs") - (window - 1)), lambda k: F.array_join(F.slice("glyphs", k, window), " "))).alias("k", "text")).select("line_id", (F.col("pos") + F.col("k")).alias("pos"), "text"), "windows")
    both = one.groupBy("text").agg(several.alias("several")).where("several").select("text")
    return one.join(both, "text", "left_semi").select("line_id", "pos")


def shared_spans(tokens: DataFrame, window: int = 16, phases: int = 9) -> DataFrame:
    """Longest stretches of positions that lie in shared windows: line_id, start_pos, end_pos.

    Null line_id or null or negative pos: left out. Unreadable tokens and lost positions end a window. Repeated rows
    of a position count once. Shared means that a line with another line_id holds the window. Without tokens, or where
    all lines are shorter than a window, there are no rows.
    """
    w = Window.partitionBy("line_id").orderBy("pos")
    new = F.when(F.col("pos") - F.lag("pos").over(w) <= window, 0).otherwise(1)
    return (
        shared_windows(tokens, window, phases)
        .withColumn("new", new)
        .withColumn("span", F.sum("new").over(w))
        .groupBy("line_id", "span")
        .agg(F.min("pos").alias("start_pos"), (F.max("pos") + (window - 1)).alias("end_pos"))
        .select("line_id", "start_pos", "end_pos")
    )


def shared_shares(tokens: DataFrame, window: int = 16, phases: int = 9) -> DataFrame:
    """For every line with a readable token: n_tokens, n_shared (tokens in shared spans) and shared_share."""
    spans = shared_spans(tokens, window, phases).groupBy("line_id").agg(F.sum(F.col("end_pos") - F.col("start_pos") + 1).alias("n_shared"))
    sizes = readings(tokens).select("line_id", "pos").distinct().groupBy("line_id").agg(F.count("*").alias("n_tokens"))
    shared = F.coalesce("n_shared", F.lit(0))
    return sizes.join(spans, "line_id", "left").select("line_id", "n_tokens", shared.alias("n_shared"), (shared / F.col("n_tokens")).alias("shared_share"))
