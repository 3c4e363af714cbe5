"""Sources and sinks by round trips, streams, and the learner."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.operators import learning
from tesserae.operators.lines import last_records
from tesserae.sources import records
from tesserae.streaming import logs


def test_line_maps(spark, tmp_path):
    (tmp_path / "complete/json").mkdir(parents=True)
    (tmp_path / "complete/json/A.json").write_text('{"Aa1": "1-2", "Aa2": "3", "Aa1": "4"}')
    got = sorted(tuple(r) for r in records.read_line_maps(spark, f"{tmp_path}/*/json/*.json").collect())
    assert got == [("complete", "A", 0, "Aa1", "4"), ("complete", "A", 1, "Aa2", "3")]


def test_tokens_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "c", "A", 0, "t", ["1", "2"]), (2, "b", None, 1, "u", [])], "line_id long, corpus string, tablet string, ord int, title string, tokens array<string>")
    records.write_tokens(df, f"{tmp_path}/t", "simple")
    records.write_tokens(df.limit(1), f"{tmp_path}/t", "other", mode="append")
    assert sorted((r.line_id, r.corpus, list(r.tokens)) for r in records.read_tokens(spark, f"{tmp_path}/t", "simple").collect()) == [(1, "c", ["1", "2"]), (2, "b", [])]


def test_line_maps_and_structs_round_trip(spark, tmp_path):
    schema = "line_id long, corpus string, tablet string, ord int, title string, text string"
    lines = spark.createDataFrame([(1, "c", "A", 1, "t2", "b"), (2, "c", "A", 0, "t1", None), (3, "b", "B", 0, "t1", "x"), (4, "c", "A", 2, None, "y")], schema)
    records.write_line_maps(lines, f"{tmp_path}/m")
    assert {r.tablet: r.value for r in spark.read.text(f"{tmp_path}/m").collect()} == {"A": '{"t1":null,"t2":"b"}', "B": '{"t1":"x"}'}
    token = "array<struct<glyph string, variant string, modifiers array<string>>>"
    df = spark.createDataFrame([(1, "c", "A", 0, "t", [("076", "a", ["x"]), ("001", "", [])]), (2, "c", "A", 1, "u", [])], f"line_id long, corpus string, tablet string, ord int, title string, tokens {token}")
    records.write_tokens(df, f"{tmp_path}/v", "glyph_variants")
    assert [(r.line_id, list(r.tokens)) for r in records.read_variant_tokens(spark, f"{tmp_path}/v").collect()] == [(1, ["076:a+x", "001"])]
    records.write_tokens(df.select("line_id", "corpus", F.lit("abc").alias("tablet")), f"{tmp_path}/w", "characters")
    assert (tmp_path / "w/corpus=c/kind=text/strategy=characters").is_dir()
    sizes = spark.createDataFrame([("a", 3), ("a", 4), ("b", None)], "kind string, length long")
    assert {r.kind: (r.n_files, r.n_bytes) for r in records.file_totals(sizes, "kind").collect()} == {"a": (2, 7), "b": (1, 0)}


def test_trial_log(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    (log / "a.json").write_text('{"trial_id": "a", "score": 1.0}\n\nnot json\n{"trial_id": "b", "error": "boom", "score": -999.0}\n')
    assert sorted(r.trial_id for r in records.completed_trials(spark, str(log)).collect()) == ["a", "b"]
    with pytest.raises(Exception):
        records.read_trials(spark, str(log)).collect()
    more = spark.createDataFrame([("a", 2.0)], "trial_id string, score double")
    records.append_trials(more, f"{tmp_path}/new", resume=False)
    records.append_trials(more, f"{tmp_path}/new", resume=True)
    assert records.read_trials(spark, f"{tmp_path}/new").count() == 2
    rows = [("a", 1.0, None, 1), ("a", 2.0, None, 2), ("a", None, "boom", 3), ("b", None, "x", 1)]
    df = spark.createDataFrame(rows, "trial_id string, score double, error string, s int").withColumn("logged_at", F.timestamp_seconds("s"))
    assert [(r.trial_id, r.score) for r in last_records(df).collect()] == [("a", 2.0)]


def test_neighbor_files_and_anchors(spark, tmp_path):
    for trial, folder, word in (("t1", "graphs/", "first"), ("t1", "", "second"), ("t2", "", "only")):
        (tmp_path / trial / folder).mkdir(parents=True, exist_ok=True)
        (tmp_path / trial / folder / "x_neighbors.json").write_text(json.dumps({"076": [[word, 0.5], ["b", 0.25]], "001": []}))
    got = sorted((r.trial_id, r.token, r["rank"], r.word, r.cosine) for r in records.read_neighbors(spark, str(tmp_path)).collect())
    assert got == [("t1", "076", 1, "first", 0.5), ("t1", "076", 2, "b", 0.25), ("t2", "076", 1, "only", 0.5), ("t2", "076", 2, "b", 0.25)]
    (tmp_path / "anchors.json").write_text('{"076": ["one", "two"]}')
    assert sorted(r.gloss for r in records.read_anchors(spark, f"{tmp_path}/anchors.json").collect()) == ["one", "two"]


def test_images(spark, tmp_path):
    for name, data in (("2.png", b"xx"), ("10.GIF", b"x"), ("a.png", b"y"), ("b.txt", b"x")):
        (tmp_path / name).write_bytes(data)
    got = [(r.name, r.number, r.length) for r in records.read_images(spark, str(tmp_path)).orderBy("number").collect()]
    assert got == [("2.png", 2, 2), ("10.GIF", 10, 1), ("a.png", 10**9, 1)]
    sizes = spark.createDataFrame([("k", "png", 9, 0), ("k", "gif", 5, 2), ("k", "webp", 5, 1)], "key string, suffix string, length long, place int")
    assert tuple(records.smallest_encoding(sizes).first()) == ("k", "webp", 5)


def test_streams(spark, tmp_path):
    (tmp_path / "log").mkdir()
    (tmp_path / "log/a.json").write_text('{"trial_id": "a", "score": 1.0}\n{"trial_id": "b", "error": "boom"}\n')
    logs.write_by_batch(logs.follow_trials(spark, f"{tmp_path}/log").select("trial_id", "score"), f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination(60)
    assert [r.trial_id for r in spark.read.parquet(f"{tmp_path}/out").collect()] == ["a"]
    schema = "line_id long, corpus string, tablet string, title string, text string, loaded_at timestamp"
    lines = spark.createDataFrame([(1, "c", "A", "t", "1-2", None), (1, "c", "A", "t", "1-2", None)], schema).withColumn("loaded_at", F.timestamp_seconds(F.lit(100)))
    lines.write.parquet(f"{tmp_path}/lines")
    stream = logs.follow_tokens(spark.readStream.schema(schema).parquet(f"{tmp_path}/lines"), "simple")
    logs.write_by_batch(stream, f"{tmp_path}/tokens", f"{tmp_path}/check2").awaitTermination(60)
    assert sorted((r.pos, r.token) for r in spark.read.parquet(f"{tmp_path}/tokens").collect()) == [(0, "001"), (1, "002")]


SETTINGS = learning.Settings(input_dim=8, hidden_dim=16, output_dim=8, epochs=12, batch_size=64, negatives=4, learning_rate=0.1, anchor_passes=8)


def test_slope_of_the_contrast():
    r = np.random.default_rng(0)
    v, near, far = learning.unit(r.normal(size=(3, 4))), learning.unit(r.normal(size=(3, 4))), learning.unit(r.normal(size=(3, 2, 4)))
    _, slope = learning.contrast(v, near, far)
    for i, j in ((0, 0), (2, 3)):
        step = np.zeros_like(v)
        step[i, j] = 1e-6
        assert abs((learning.contrast(v + step, near, far)[0] - learning.contrast(v - step, near, far)[0]) / 2e-6 - slope[i, j]) < 1e-5


def test_learning_lowers_the_loss_and_draws_anchors(spark):
    rows = [(a, b, 20) for k in range(4) for a in range(4 * k, 4 * k + 4) for b in range(4 * k, 4 * k + 4) if a != b]
    counts = spark.createDataFrame(rows, "center_idx int, context_idx int, n long")
    target = learning.unit(np.eye(8)[:1])
    model, losses = learning.fit_projection(counts, 16, SETTINGS, (np.array([3]), target), shards=2)
    assert np.isfinite(losses).all() and losses[-1] < losses[0]
    assert float(learning.unit(model.forward(np.array([3]))[1])[0] @ target[0]) > 0.5
    vocab = spark.createDataFrame([("x", 3)], "token string, idx int")
    assert np.allclose(learning.project(vocab, model).first().projected, model.forward(np.array([3]))[1][0])
    assert learning.fit_projection(counts.limit(0), 4, SETTINGS)[1] == [0.0] * 12


def test_learning_from_a_pool_of_negatives(spark, monkeypatch):
    monkeypatch.setattr(learning, "POOL", 5)
    rows = [(a, (a + 1) % 40, 3) for a in range(40)] + [(0, b, 50) for b in range(1, 40)]
    counts = spark.createDataFrame(rows, "center_idx int, context_idx int, n long")
    s = learning.Settings(input_dim=8, hidden_dim=16, output_dim=8, epochs=2, batch_size=16, negatives=4, collapse_sample=6)
    pairs = counts.withColumn("shard", F.col("center_idx") % 3)
    known = learning.shard_vectors(pairs, learning.first_vectors(spark, 40, s), 40, 4, 0).toPandas()
    assert not known.duplicated(["shard", "idx"]).any() and (known[known.far].groupby("shard").size() <= 5).all() and set(known.shard) == {0, 1, 2, 3}
    named = pairs.toPandas()
    assert all(set(part.center_idx) | set(part.context_idx) <= set(known[known.shard == k].idx) for k, part in named.groupby("shard"))
    model, losses = learning.fit_projection(counts, 40, s, shards=3)
    again = learning.fit_projection(counts.repartition(5), 40, s, shards=3)[0]
    assert len(losses) == 2 and np.isfinite(losses).all() and model.vectors.count() == 40
    assert np.allclose(model.some(np.arange(40)).tokens, again.some(np.arange(40)).tokens, atol=1e-9)
    vocab = spark.createDataFrame([("x", 1), ("y", 99)], "token string, idx int")
    assert {r.token: r.projected is None for r in learning.project(vocab, model).collect()} == {"x": False, "y": True}
    assert learning.fit_projection(counts.limit(0), 0, s)[1] == [0.0, 0.0]


def test_principal_plane(spark):
    v = np.random.default_rng(1).normal(size=(50, 4)) * [9, 3, 1, 0.1]
    got = learning.principal_plane(spark.createDataFrame([(k, [float(x) for x in row]) for k, row in enumerate(v)], "vec_id long, embedding array<float>")).orderBy("vec_id").collect()
    axes = np.linalg.svd(v - v.mean(0))[2][:2].T
    want = (v - v.mean(0)) @ axes * np.sign(axes[np.abs(axes).argmax(0), [0, 1]])
    assert np.allclose([[r.x, r.y] for r in got], want, atol=1e-4)


def test_sinks_of_projections_and_answers(spark, tmp_path):
    projected = spark.createDataFrame([("t1", "076", [1.0])], "trial_id string, token string, projected array<double>")
    records.write_projection(projected, spark.createDataFrame([("t1", [0.5])], "trial_id string, losses array<double>"), f"{tmp_path}/p")
    assert spark.read.parquet(f"{tmp_path}/p/projection").first().trial_id == "t1" and list(spark.read.json(f"{tmp_path}/p/metadata").first().losses) == [0.5]
    answers = spark.createDataFrame([("/x/dict/12.png", "a/b:1", "0.734")], "path string, model string, score string")
    records.write_answers(answers, f"{tmp_path}/a")
    assert spark.read.json(f"{tmp_path}/a").first().run == "dict_12_a-b-1"
    images = spark.createDataFrame([("7.png",), ("x.png",), ("1234.gif",)], "name string")
    assert sorted(r.label for r in records.images_by_label(images).collect()) == ["007", "1234"]
