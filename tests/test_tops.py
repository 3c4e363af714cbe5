"""First neighbours counted on arrays of numbers, and what the trial queries leave on disk."""

import gc
import os
import random
import tempfile
import time

import pytest
from pyspark.sql import functions as F

from tesserae import queries as core
from tesserae.operators import cooccurrence, neighbors, tops
from tesserae.plans import stages


def made(df):
    return sorted((r.context_window, r.token, r.word, r.cosine, r.margin is None, round(r.margin or 0, 9)) for r in df.collect())


def lines_of(spark, n, words, most, seed=1):
    chance = random.Random(seed)
    return [None, []] + [[chance.choice(words) for _ in range(chance.randrange(most))] for _ in range(n)]


@pytest.mark.parametrize("windows", [[2], [1, 3, 50]])
def test_first_neighbours_in_blocks_and_rounds(spark, monkeypatch, windows):
    for name, value in {"BLOCK": 40, "GROUP": 100, "ROUND": 150, "LOT": 2, "SHELF": 5}.items():
        monkeypatch.setattr(tops, name, value)
    words = [f"{k:03d}" for k in range(15)] + ["a", "é", "Z"]
    rows = lines_of(spark, 60, [*words, "-", ":", None], 9) + [["only"], ["q", "r"], ["q", "q"]]
    df = spark.createDataFrame([(x,) for x in rows], "tokens array<string>").repartition(3)
    space = tops.Space(df, windows)
    half = cooccurrence.pair_counts_by_window(df, windows).withColumnRenamed("window", "context_window")
    first = space.firsts()
    assert len(first) > 1
    found = [r for part in first for r in made(part)]
    assert sorted(found) == made(neighbors.margins(neighbors.glyph_neighbors(half, 2, "context_window"), "context_window", "token"))
    both = cooccurrence.both_ways(half, "context_window").where(F.col("center").isin("001", "q"))
    key = lambda x: sorted((r.context_window, r.center, r.context, r.n) for r in x.collect())
    assert key(space.counts_of(["001", "q", "none"])) == key(both)


def test_no_neighbours_at_all(spark):
    for rows in ([], [(None,), (["a"],), (["-", "b"],)]):
        space = tops.Space(spark.createDataFrame(rows, "tokens array<string>"), [2])
        assert space.size == 0 and sum(x.count() for x in space.firsts()) == 0 and space.counts_of(["a"]).count() == 0


def test_halves_are_rounded_upwards():
    import numpy as np

    assert tops.half_up(np.array([0.5, 1 / 3, 0.0009765625])).tolist() == [0.5, 0.333333333, 0.000976563]


def test_released_shuffle_files_go_at_once(spark):
    folder = spark.conf.get("spark.local.dir")
    shuffles = lambda: {f for _, _, files in os.walk(folder) for f in files if f.startswith("shuffle_")}
    before, cleanup = shuffles(), spark.conf.get(stages.CLEANUP)
    staged = stages.stage(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "x", release=True)
    assert shuffles() <= before and spark.conf.get(stages.CLEANUP) == cleanup
    assert staged.count() == 7


@pytest.fixture(scope="module")
def tablets(spark):
    """Tables of 2,000 lines with many different tokens, and six trials of three windows."""
    folder, chance = tempfile.mkdtemp(prefix="spark-"), random.Random(2)
    texts = ["-".join(f"{chance.randrange(700):03d}" + "".join(chance.choices("abcdefgh", k=chance.randrange(3))) for _ in range(30)) for _ in range(2000)]
    lines = [(k, "complete", "T", k, f"T{k}", t) for k, t in enumerate(texts)]
    spark.createDataFrame(lines, "line_id long, corpus string, tablet string, ord int, title string, text string").withColumn("loaded_at", F.timestamp_seconds(F.lit(0))).coalesce(1).write.parquet(f"{folder}/tablet_lines.parquet")
    settings = [(f"t{k}", "barthel", 2 + 2 * (k % 3)) for k in range(6)]
    spark.createDataFrame(settings, "trial_id string, strategy string, context_window int").coalesce(1).write.parquet(f"{folder}/trial_configs.parquet")
    records = spark.createDataFrame([(t, 5.0, None) for t, _, _ in settings], "trial_id string, score double, error string").withColumn("logged_at", F.timestamp_seconds(F.lit(0)))
    records.coalesce(1).write.parquet(f"{folder}/trial_records.parquet")
    spark.createDataFrame([(0, "peru"), (1, "chad")], "n_regionkey int, n_name string").coalesce(1).write.parquet(f"{folder}/nation.parquet")
    spark.createDataFrame([(k, [float(k), 1.0]) for k in range(9)], "vec_id long, embedding array<float>").coalesce(1).write.parquet(f"{folder}/embeddings.parquet")
    return folder


def held(*folders):
    return sum(os.path.getsize(f"{d}/{f}") for x in folders for d, _, files in os.walk(x) for f in files)


@pytest.mark.parametrize("name", ["quality_filter", "trial_score", "anchor_hit_rate", "consensus_alternates"])
def test_trial_queries_leave_little_on_disk(spark, tablets, tmp_path, name):
    folders = stages.shared_folder(spark).removeprefix("file:"), spark.conf.get("spark.local.dir")
    stages.drop_staged(spark)
    for _ in range(2):  # what earlier tests have left goes first
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(1)
    before = held(*folders)
    core.queries()[name](spark, tablets).write.parquet(f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out").count() > 0
    assert held(*folders) - before < 4 * held(f"{tablets}/tablet_lines.parquet") + 1_000_000
