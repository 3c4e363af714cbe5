"""First neighbours by co-occurrence, counted on arrays of numbers within tasks: no table of pairs is made.

Lines become blocks of numbers once. What passes between tasks are a block's pairs by groups of centers, sorted, as differences
and packed, about two bytes each; a group is counted and its first neighbours are found within one task.
"""

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.functions.text import SEPARATORS
from tesserae.plans.stages import drop, stage

#: Tokens of a block, pairs of a group of centers, pairs that a round passes between tasks, and rounds at most; blocks that are numbered at a time.
BLOCK, GROUP, ROUND, ROUNDS, LOT = 300_000, 1_500_000, 100_000_000, 4, 8
#: Different tokens that are broadcast at most (about 30 bytes each), and of these, those that are looked up at a time.
WORDS, SHELF = 4_000_000, 500_000


def pack(x: np.ndarray) -> bytes:
    """Whole numbers, byte by byte, so that the high ones take nearly no room."""
    planes = np.ascontiguousarray(x.astype(np.int64).view(np.uint8).reshape(-1, 8).T)
    return len(x).to_bytes(8, "little") + (pa.compress(planes, codec="zstd", asbytes=True) if len(x) else b"")


def unpack(b: bytes) -> np.ndarray:
    n = int.from_bytes(b[:8], "little")
    planes = np.frombuffer(pa.decompress(b[8:], n * 8, codec="zstd", asbytes=True) if n else b"", np.uint8)
    return np.ascontiguousarray(planes.reshape(8, n).T).view(np.int64).ravel()


def places(names: pa.Array, words: pa.Array) -> np.ndarray:
    """Where each name stands in words, -1 where it doesn't; by parts of words, so that only one's hash table is held."""
    found = np.full(len(names), -1, np.int64)
    for low in range(0, len(words), SHELF):
        at = pc.index_in(names, value_set=words.slice(low, SHELF)).fill_null(-1).to_numpy(zero_copy_only=False)
        found[at >= 0] = at[at >= 0] + low
    return found


def half_up(x: np.ndarray) -> np.ndarray:
    """Rounded to nine digits as SQL does it, halves upwards."""
    low = np.floor(x * 1e9)
    return (low + (x * 1e9 - low >= 0.5)) / 1e9


def pairs_apart(ids: np.ndarray, ends: np.ndarray, farthest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """d, a and b for each distance: b stands d places after a in a line; places with a number below 0 are in no pair."""
    sizes = np.diff(ends, prepend=0)
    line = np.repeat(np.arange(len(ends), dtype=np.int32), sizes)
    for d in range(1, min(farthest, int(sizes.max(initial=0)) - 1) + 1):
        ok = (line[:-d] == line[d:]) & (ids[:-d] >= 0) & (ids[d:] >= 0)
        yield d, ids[:-d][ok], ids[d:][ok]


def encode(tokenized: DataFrame, windows: list[int]) -> DataFrame:
    """A row for each block of lines: counts (each different token, with the number of its neighbours in each window), ids (their places there; separators and nulls -1) and ends (of the lines)."""
    n = len(windows)

    def block(held: list[pa.Array]) -> pa.RecordBatch:
        lists = pa.concat_arrays(held)
        coded = lists.flatten().dictionary_encode()
        words, ids = coded.dictionary, coded.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        apart = pc.is_in(words, value_set=pa.array(SEPARATORS)).to_numpy(zero_copy_only=False)
        if len(words):
            ids[(ids >= 0) & apart[ids]] = -1
        ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        sums = np.zeros((len(words), n), np.int64)
        for d, a, b in pairs_apart(ids, ends, windows[-1]):
            both = np.bincount(a, minlength=len(words)) + np.bincount(b, minlength=len(words))
            sums[:, np.searchsorted(windows, d) :] += both[:, None]
        each = pa.ListArray.from_arrays(pa.array(np.arange(len(words) + 1, dtype=np.int32) * n), pa.array(sums.ravel()))
        counts = pa.StructArray.from_arrays([words, each], ["word", "t"])
        whole = pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), counts)
        return pa.RecordBatch.from_arrays([whole, pa.array([pack(ids)]), pa.array([pack(ends)])], ["counts", "ids", "ends"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            for low in range(0, b.num_rows, 1000):
                held.append(b["tokens"].slice(low, 1000))
                size += len(held[-1].flatten())
                if size >= BLOCK:
                    yield block(held)
                    held, size = [], 0
        if held:
            yield block(held)

    return tokenized.select("tokens").mapInArrow(run, "counts array<struct<word string, t array<bigint>>>, ids binary, ends binary")


class Space:
    """The neighbours of tokens in lines by several windows, ascending and each once.

    words: every token with a neighbour, ascending, and sums: the number of its neighbours in each window; blocks: ids and ends of
    the lines by the numbers of words. Built at once; whether words fit is asked with fits, and without it nothing else is there.
    """

    def __init__(self, tokenized: DataFrame, windows: list[int]):
        self.windows, spark = windows, tokenized.sparkSession
        coded = stage(encode(tokenized, windows), "blocks", release=True)
        sums = [F.sum(F.col("t")[i]).alias(f"t{i}") for i in range(len(windows))]
        total = stage(coded.select(F.inline("counts")).groupBy("word").agg(*sums).where(F.col(f"t{len(windows) - 1}") > 0), "words", release=True)
        self.size = total.count()
        self.fits = self.size <= WORDS
        if not self.fits:
            drop(spark, coded, total)
            return
        found = total.toArrow()
        found = found.take(pc.sort_indices(found["word"])).combine_chunks()
        # one block of memory each, since what is sent should not be in chunks
        self.words = pa.concat_arrays(found["word"].chunks) if self.size else pa.array([], pa.string())
        self.sums = np.stack([found[f"t{i}"].to_numpy() for i in range(len(windows))], axis=1) if self.size else np.zeros((0, len(windows)), np.int64)
        self.pairs = int(self.sums[:, -1].sum())
        self.held = held = spark.sparkContext.broadcast(self.words)
        self.held_sums = spark.sparkContext.broadcast(self.sums.astype(np.int32 if self.sums.max(initial=0) < 2**31 else np.int64))

        def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lot = []

            def done() -> pa.RecordBatch:
                known = places(pa.concat_arrays([r.flatten() for r, _, _ in lot]), held.value)
                at, out = 0, []
                for names, ids, ends in lot:
                    own = np.append(known[at : (at := at + len(names.flatten()))], -1)
                    out.append((pack(own[unpack(ids)]), ends))
                lot.clear()
                return pa.RecordBatch.from_arrays([pa.array([x for x, _ in out]), pa.array([y for _, y in out])], ["ids", "ends"])

            for b in batches:
                for k in range(b.num_rows):
                    lot.append((b["names"].slice(k, 1), b["ids"][k].as_py(), b["ends"][k].as_py()))
                    if len(lot) == LOT:
                        yield done()
            if lot:
                yield done()

        self.blocks = stage(coded.select(F.col("counts.word").alias("names"), "ids", "ends").mapInArrow(number, "ids binary, ends binary"), "numbers", release=True)
        drop(spark, coded, total)

    def drop(self) -> None:
        drop(self.blocks.sparkSession, self.blocks)
        self.held.destroy()
        self.held_sums.destroy()

    def counts_of(self, centers: list[str]) -> DataFrame:
        """context_window, center, context and n of the pairs with one of a few centers, in each window."""
        windows, held = self.windows, self.held

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            words = held.value
            wanted = places(pa.array(centers), words)
            wanted = wanted[wanted >= 0]
            for b in batches:
                for ids, ends in zip(b["ids"], b["ends"]):
                    found = []
                    for d, x, y in pairs_apart(unpack(ids.as_py()), unpack(ends.as_py()), windows[-1]):
                        for center, context in ((x, y), (y, x)):
                            ok = np.isin(center, wanted)
                            found.append((center[ok] * len(words) + context[ok]) * len(windows) + np.searchsorted(windows, d))
                    key, n = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))
                    pair = key // len(windows)
                    yield pa.RecordBatch.from_arrays([pa.array(key % len(windows)), words.take(pa.array(pair // max(1, len(words)))), words.take(pa.array(pair % max(1, len(words)))), pa.array(n)], ["k", "center", "context", "n"])

        first = self.blocks.mapInArrow(run, "k bigint, center string, context string, n bigint").groupBy("center", "context").agg(*(F.sum(F.when(F.col("k") <= i, F.col("n"))).alias(f"n{i}") for i in range(len(windows))))
        each = F.array(*(F.struct(F.lit(w).alias("context_window"), F.col(f"n{i}").alias("n")) for i, w in enumerate(windows)))
        return first.select("center", "context", F.inline(each)).where("n > 0")

    def firsts(self, **more: Column) -> list[DataFrame]:
        """context_window, token, word, cosine and margin (to the second; null without one) of each token's first neighbour in each window, and more columns; staged, a part for each round.

        Cosines are n_ab / sqrt(n_a * n_b) to nine digits; of equal ones the lower word comes first.
        """
        windows, held, held_sums, n_words, n_windows = self.windows, self.held, self.held_sums, max(1, self.size), len(self.windows)
        most = min(self.pairs, self.size**2 * n_windows)
        rounds = min(ROUNDS, math.ceil(most / ROUND)) or 1
        groups = rounds * math.ceil(max(8, most / GROUP) / rounds)
        room = math.ceil(n_words / groups) * n_words * n_windows  # keys of a group

        def pairs(turn: int):
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    for ids, ends in zip(b["ids"], b["ends"]):
                        found = []
                        for d, x, y in pairs_apart(unpack(ids.as_py()), unpack(ends.as_py()), windows[-1]):
                            for center, context in ((x, y), (y, x)):
                                ok = (center % rounds == turn) & (x != y)
                                center, context = center[ok], context[ok]
                                found.append(center % groups * room + (center // groups * n_words + context) * n_windows + np.searchsorted(windows, d))
                        if not found:
                            continue
                        key = np.sort(np.concatenate(found))
                        first = np.flatnonzero(np.diff(key, prepend=-1))
                        key, n = key[first], np.diff(first, append=len(key))
                        cuts = np.searchsorted(key, np.arange(groups + 1) * room)
                        some = [g for g in range(groups) if cuts[g] < cuts[g + 1]]
                        part = lambda x, g: x[cuts[g] : cuts[g + 1]]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(some, pa.int32()), pa.array([pack(np.diff(part(key, g) - g * room, prepend=0)) for g in some], pa.binary()), pa.array([pack(part(n, g)) for g in some], pa.binary())], ["group", "steps", "n"]
                        )

            return run

        def count(group: tuple, table: pa.Table) -> pa.Table:
            words, sums = held.value, held_sums.value
            key = np.concatenate([np.cumsum(unpack(x)) for x in table["steps"].to_pylist()])
            n = np.concatenate([unpack(x) for x in table["n"].to_pylist()])
            order = np.argsort(key)
            key, n = key[order], n[order]
            pair = key // n_windows
            start = np.flatnonzero(np.diff(pair, prepend=-1))
            kind, pair = key % n_windows, pair[start]
            center, context = pair // n_words * groups + int(group[0].as_py()), pair % n_words
            del key, order
            out = []
            for k, w in enumerate(windows):
                near = np.add.reduceat(np.where(kind <= k, n, 0), start)
                some = np.flatnonzero(near)
                if not len(some):
                    continue
                own, other = center[some], context[some]
                cosine = half_up(near[some] / np.sqrt(sums[own, k].astype(np.float64) * sums[other, k]))
                low = np.flatnonzero(np.diff(own, prepend=-1))
                of = np.repeat(np.arange(len(low)), np.diff(low, append=len(own)))
                best = np.maximum.reduceat(cosine, low)
                hits = np.flatnonzero(cosine == best[of])
                first = hits[np.flatnonzero(np.diff(of[hits], prepend=-1))]
                cosine[first] = -np.inf
                second = np.maximum.reduceat(cosine, low)
                alone = np.isneginf(second)
                out.append(pa.table([pa.array(np.full(len(low), w, np.int32)), words.take(pa.array(own[low])), words.take(pa.array(other[first])), pa.array(best), pa.array(best - np.where(alone, 0, second), mask=alone)], names=["context_window", "token", "word", "cosine", "margin"]))
            return pa.concat_tables(out)

        kept = "context_window int, token string, word string, cosine double, margin double"
        return [stage(self.blocks.mapInArrow(pairs(turn), "group int, steps binary, n binary").groupBy("group").applyInArrow(count, kept).withColumns(more), "tops", release=True) for turn in range(rounds)]
