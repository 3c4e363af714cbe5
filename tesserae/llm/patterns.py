"""Problem 3: frequent subsequences, mined on a sequence decision diagram."""

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.pairs import BROADCAST_ROWS
from tesserae.llm.readings import BLOCK, block_arrays, blocks, event, map_arrays, readings
from tesserae.plans.stages import broadcast_below, stage


def keep_sequences(x: dict, ids: dict[str, int]) -> pa.RecordBatch:
    """The blocks as arrays of positions and ids, in the order of the positions, without the events that have no id."""
    codes, events = x["event"]
    id_ = np.array([ids.get(e, -1) for e in events], np.int32)[codes] if len(codes) else np.zeros(0, np.int32)
    keep = id_ >= 0
    offsets = np.searchsorted(x["_group"][keep], np.arange(len(x["block"]) + 1)).astype(np.int32)
    lists = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(v.astype(np.int32))) for v in (x["pos"][keep], id_[keep])]
    return pa.RecordBatch.from_arrays([pa.array(x["line_id"]), pa.array(x["block"]), *lists], ["line_id", "block", "pos", "ids"])


def arrays_of(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size = np.diff(b["ids"].offsets.to_numpy())
    return np.repeat(np.arange(b.num_rows), size), b["pos"].flatten().to_numpy(), b["ids"].flatten().to_numpy().astype(np.int64)


def count_steps(batches: Iterator[pa.RecordBatch], gap: int, kinds: int) -> Iterator[pa.RecordBatch]:
    """(step, n): in how many blocks of the batch an event follows another within gap positions."""
    for b in batches:
        group, pos, ids = arrays_of(b)
        found = [np.zeros(0, np.int64)]
        for k in range(1, min(gap, len(ids) - 1) + 1):
            at = np.flatnonzero((group[k:] == group[:-k]) & (pos[k:] - pos[:-k] <= gap))
            found.append((group[at] * kinds + ids[at]) * kinds + ids[at + k])
        step, n = np.unique(np.unique(np.concatenate(found)) % (kinds * kinds), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(step), pa.array(n.astype(np.int64))], ["step", "n"])


def steps_of_lines(batches: Iterator[pa.RecordBatch], gap: int, kinds: int) -> Iterator[pa.RecordBatch]:
    """(line_id, step), once a block."""
    for b in batches:
        group, pos, ids = arrays_of(b)
        found = [np.zeros(0, np.int64)]
        for k in range(1, min(gap, len(ids) - 1) + 1):
            at = np.flatnonzero((group[k:] == group[:-k]) & (pos[k:] - pos[:-k] <= gap))
            found.append((group[at] * kinds + ids[at]) * kinds + ids[at + k])
        g, step = np.divmod(np.unique(np.concatenate(found)), kinds * kinds)
        yield pa.RecordBatch.from_arrays([pa.array(b["line_id"].to_numpy()[g]), pa.array(step)], ["line_id", "step"])


def reduce_records(batches: Iterator[pa.RecordBatch], steps: np.ndarray, gap: int, kinds: int, shortest: int) -> Iterator[pa.RecordBatch]:
    """Each block without the events that lie on no chain of frequent steps with as many events as a pattern has.

    record: position relative to the first and id by turns. Chains of the block that lie further apart than gap are
    moved together as far as they stay unconnected, so that equal records are equal arrays more often.
    """
    for b in batches:
        group, pos, ids = arrays_of(b)
        n = len(ids)
        edges = []
        for k in range(1, min(gap, n - 1) + 1):
            at = np.flatnonzero((group[k:] == group[:-k]) & (pos[k:] - pos[:-k] <= gap))
            at = at[np.isin(ids[at] * kinds + ids[at + k], steps)]
            edges.append((at, at + k))
        a, z = (np.concatenate([e[i] for e in edges]) if edges else np.zeros(0, np.int64) for i in (0, 1))
        before, after = np.ones(n, np.int64), np.ones(n, np.int64)  # events of the longest chain that ends or starts here
        for _ in range(shortest - 1):
            old, new = before.copy(), after.copy()
            np.maximum.at(before, z, old[a] + 1)
            np.maximum.at(after, a, new[z] + 1)
        at = np.flatnonzero(before + after - 1 >= shortest)
        group, pos, ids = group[at], pos[at], ids[at]
        first = np.flatnonzero(np.diff(group, prepend=-1))
        apart = np.minimum(np.diff(pos, prepend=0), gap + 1)
        apart[first] = 0
        total = np.cumsum(apart)
        rel = total - np.repeat(total[first], np.diff(np.append(first, len(at)))) if len(at) else total
        flat = np.stack([rel, ids], 1).reshape(-1).astype(np.int32)
        offsets = np.append(first, len(at)).astype(np.int32) * 2
        yield pa.RecordBatch.from_arrays([pa.array(b["line_id"].to_numpy()[group[first]]), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["line_id", "record"])


def encode(rests: set[tuple]) -> list[int]:
    """A node: the set of its rests, each as its length, then distance from the event before and id by turns."""
    return [x for rest in sorted(rests) for x in (len(rest), *rest)]


def decode(node: list[int]) -> list[tuple]:
    out, at = [], 0
    while at < len(node):
        out.append(tuple(node[at + 1 : at + 1 + node[at]]))
        at += 1 + node[at]
    return out


def cut(rest: tuple, k: int, reach: int, gap: int) -> tuple:
    """What a pattern that stands at entry k of rest can still use: at most reach positions on, without a hole wider than gap."""
    at, out, last = rest[k], [], 0
    for j in range(k + 2, len(rest), 2):
        d = rest[j] - at
        if d > reach or d - last > gap:
            break
        out += (d, rest[j + 1])
        last = d
    return tuple(out)


def roots(record: list[int], longest: int, gap: int) -> dict[int, set[tuple]]:
    """For each event of a record, all that follows its occurrences."""
    out: dict[int, set[tuple]] = {}
    record = tuple(record)
    for k in range(0, len(record), 2):
        out.setdefault(record[k + 1], set()).add(cut(record, k, gap * (longest - 1), gap))
    return out


def children(node: list[int], left: int, gap: int) -> dict[int, set[tuple]]:
    """For each event that may come next, all that follows it; left: how many events a pattern may still take."""
    out: dict[int, set[tuple]] = {}
    for rest in decode(node):
        for k in range(0, len(rest), 2):
            if rest[k] > gap:
                break
            out.setdefault(rest[k + 1], set()).add(cut(rest, k, gap * (left - 1), gap))
    return out


def unfold(batches: Iterator[pa.RecordBatch], column: str, of) -> Iterator[pa.RecordBatch]:
    """The edges of each node: column, event, child."""
    for b in batches:
        at, events, nodes = [], [], []
        for i, node in enumerate(b[column].to_pylist()):
            for e, rests in of(node).items():
                at.append(i)
                events.append(e)
                nodes.append(encode(rests - {()}))
        keep = [b[c].take(pa.array(at, pa.int64())) for c in b.schema.names]
        yield pa.RecordBatch.from_arrays([*keep, pa.array(events, pa.int32()), pa.array(nodes, pa.list_(pa.int32()))], [*b.schema.names, "event", "child"])


def frequent_patterns(tokens: DataFrame, share: int = 25, shortest: int = 3, longest: int = 5, gap: int = 3) -> DataFrame:
    """Patterns of shortest to longest events, each 1 to gap positions after the one before, held by n lines with share * n >= n_lines.

    Returns event_pattern (events joined by a blank), n_events, n, n_lines.

    Events and steps (an event within gap positions of another) that too few lines hold are in no such pattern; what
    lies on no chain of frequent steps is dropped, and equal remainders of lines are collapsed into weighted records.
    The records become a sequence decision diagram: a node stands for a set of remainders, has one edge for each
    event that can come next, and is kept once however many records and prefixes lead to it. Weights by prefix are
    pushed down one event at a time; each distinct node is unfolded once for all prefixes that reach it, and prefixes
    held by too few lines end. Blocks of a line longer than one block keep the line's id, so that it counts once.

    Null line_id or null or negative pos: left out. Unreadable tokens keep their position. Repeated rows of a
    position count once. Without tokens there are no rows.
    """
    spark = tokens.sparkSession
    empty = spark.createDataFrame([], "event_pattern string, n_events int, n long, n_lines long")
    read = readings(tokens).select("line_id", "pos", event().alias("event"))
    reach = gap * (longest - 1)
    size = max(BLOCK, 4 * reach)
    held = stage(block_arrays(blocks(read, reach, size)), "event-blocks")
    long = stage(held.where("block > 0").select("line_id").distinct(), "long-lines")  # usually none
    any_long = not long.isEmpty()
    long = broadcast_below(long, BROADCAST_ROWS)
    one_block = lambda df: df.join(long, "line_id", "left_anti") if any_long else df
    more_blocks = lambda df: df.join(long, "line_id", "left_semi")
    # each line counts once for each event, and once for null: a line of one block is one row, those of several are made single
    of_line = lambda df: df.select("line_id", F.explode(F.concat(F.array_distinct(F.transform("toks", lambda t: t["event"])), F.array(F.lit(None).cast("string")))).alias("event"))
    each = of_line(one_block(held)).select("event")
    if any_long:
        each = each.unionByName(of_line(more_blocks(held)).distinct().select("event"))
    counts = stage(each.groupBy("event").agg(F.count("*").alias("n")), "event-lines")
    total = counts.where("event IS NULL").select("n").first()
    if not total:
        return empty
    lines = total[0]
    often = F.col("n") * share >= lines
    # at most share times the mean number of events in a line
    ids = {r.event: k for k, r in enumerate(counts.where(F.col("event").isNotNull() & often).select("event").orderBy("event").toLocalIterator())}
    kinds = len(ids)
    if not kinds:
        return empty
    names = spark.createDataFrame(list(ids.items()), "event string, id int")
    sequences = stage(map_arrays(held, partial(keep_sequences, ids=ids), "line_id long, block int, pos array<int>, ids array<int>"), "sequences")
    whole, parts = one_block(sequences), more_blocks(sequences)
    step = whole.mapInArrow(partial(count_steps, gap=gap, kinds=kinds), "step long, n long").groupBy("step").agg(F.sum("n").alias("n"))
    if any_long:
        more = parts.mapInArrow(partial(steps_of_lines, gap=gap, kinds=kinds), "line_id long, step long").distinct().groupBy("step").agg(F.count("*").alias("n"))
        step = step.unionByName(more).groupBy("step").agg(F.sum("n").alias("n"))
    # at most share * gap times the mean length of a line: every token starts gap steps at most
    steps = np.array(sorted(r[0] for r in step.where(often).select("step").toLocalIterator()), np.int64)
    slim = partial(reduce_records, steps=steps, gap=gap, kinds=kinds, shortest=shortest)
    records = whole.mapInArrow(slim, "line_id long, record array<int>").groupBy("record").agg(F.count("*").alias("weight")).withColumn("owner", F.lit(None).cast("long"))
    if any_long:
        one = parts.mapInArrow(slim, "line_id long, record array<int>").groupBy("record", F.col("line_id").alias("owner")).agg(F.lit(1).cast("long").alias("weight"))
        records = records.unionByName(one.select("record", "weight", "owner"))

    def weighed(level: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The level's rows (prefix, node and its two hashes, owner, weight), and its frequent prefixes with n, one row for each."""
        hashed = level.withColumn("h1", F.xxhash64("child")).withColumn("h2", F.xxhash64(F.lit(1), "child"))
        level = stage(hashed.groupBy("prefix", "h1", "h2", "owner").agg(F.sum("weight").alias("weight"), F.any_value("child").alias("node")), "level")
        support = level.groupBy("prefix", "owner").agg(F.when(F.col("owner").isNull(), F.sum("weight")).otherwise(1).alias("n")).groupBy("prefix").agg(F.sum("n").alias("n")).where(often)
        return level, support

    tops = records.mapInArrow(partial(unfold, column="record", of=partial(roots, longest=longest, gap=gap)), "record array<int>, weight long, owner long, event int, child array<int>")
    level, support = weighed(tops.select(F.array("event").alias("prefix"), "child", "owner", "weight"))
    found = support if shortest <= 1 else None
    for taken in range(1, longest):
        # a prefix that ends here or has no support isn't joined; joins are by hash, so that no node is shuffled as a key
        open_ = level.where(F.size("node") > 0).join(support.select("prefix"), "prefix", "left_semi")
        nodes = open_.groupBy("h1", "h2").agg(F.any_value("node").alias("node"))
        edges = nodes.mapInArrow(partial(unfold, column="node", of=partial(children, left=longest - taken, gap=gap)), "h1 long, h2 long, node array<int>, event int, child array<int>").drop("node")
        # a shuffled join: nodes compress well, so that a file's size says little about theirs
        rows = open_.select("prefix", "h1", "h2", "owner", "weight").join(edges.hint("merge"), ["h1", "h2"]).select(F.concat("prefix", F.array("event")).alias("prefix"), "child", "owner", "weight")
        level, support = weighed(rows)
        if taken + 1 >= shortest:
            found = support if found is None else found.unionByName(support)
    told = found.withColumn("of", F.monotonically_increasing_id()).select("of", "n", F.size("prefix").alias("n_events"), F.posexplode("prefix").alias("at", "id"))
    named = told.join(F.broadcast(names), "id").groupBy("of", "n", "n_events").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "event"))), lambda x: x["event"]), " ").alias("event_pattern"))
    return named.select("event_pattern", "n_events", "n", F.lit(lines).cast("long").alias("n_lines"))
