"""Co-occurrence, neighbours, trials, consensus, pixels and matching on worked examples."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.operators import consensus, cooccurrence, matching, neighbors, pixels, trials
from tesserae.plans import stages
from tesserae.plans.index import numbered


def lines(spark, *texts):
    return spark.createDataFrame([(k, t.split()) for k, t in enumerate(texts)], "line_id long, tokens array<string>")


def test_vocabulary_is_dense_and_sorted(spark):
    words = [f"{k:03d}" for k in range(300)]
    random.Random(1).shuffle(words)
    got = cooccurrence.vocabulary(lines(spark, " ".join(words), "001 002")).collect()
    assert sorted((r.token, r.idx) for r in got) == [(f"{k:03d}", k) for k in range(300)]
    assert numbered(spark.createDataFrame([], "x string"), "x").count() == 0


def test_separators_take_a_place(spark):
    got = sorted((r.center, r.context) for r in cooccurrence.context_pairs(lines(spark, "A . B C"), 1).collect())
    assert got == [("B", "C"), ("C", "B")]
    assert cooccurrence.context_pairs(lines(spark, "A . B C"), 1, mask=False).count() == 6
    assert cooccurrence.context_pairs(lines(spark, "", "A"), 4).count() == 0


def test_pairs_are_symmetric_and_equal_brute_force(spark):
    r = random.Random(2)
    texts = [[str(r.randrange(6)) for _ in range(r.randint(0, 20))] for _ in range(30)]
    got = {(x.center, x.context): x.n for x in cooccurrence.pair_counts(lines(spark, *(" ".join(t) for t in texts)), 3).collect()}
    want: dict = {}
    for t in texts:
        for i, a in enumerate(t):
            for j, b in enumerate(t):
                if i != j and abs(i - j) <= 3:
                    want[a, b] = want.get((a, b), 0) + 1
    assert got == want and all(got[b, a] == n for (a, b), n in got.items())
    vocab = cooccurrence.vocabulary(lines(spark, *(" ".join(t) for t in texts)))
    assert cooccurrence.indexed_pairs(cooccurrence.pair_counts(lines(spark, "0 1 x"), 1), vocab).count() == 2


def test_anchors_resolve(spark):
    vocab = spark.createDataFrame([("076", 0), ("8", 1), ("008", 2), ("040:b", 3), ("040:a", 4)], "token string, idx int")
    wanted = spark.createDataFrame([("76",), ("8",), ("40",), ("9",)], "token string")
    assert {r.token: r.idx for r in cooccurrence.resolve_tokens(wanted, vocab).collect()} == {"76": 0, "8": 1, "40": None, "9": None}
    assert {r.token: r.key for r in cooccurrence.resolve_variants(wanted, vocab).collect()} == {"76": "076", "8": "008", "40": "040:a", "9": None}


def test_nearest_equals_brute_force_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(neighbors, "POOL_BLOCK", 30)
    monkeypatch.setattr(neighbors, "QUERY_BLOCK", 4)
    monkeypatch.setattr(neighbors, "QUERY_SHARE", 9)
    v = np.random.default_rng(3).normal(size=(120, 5))
    v[7] = v[3] = 0
    v[11] = v[12]
    df = spark.createDataFrame([(k, [float(x) for x in row]) for k, row in enumerate(v)] + [(None, [1.0] * 5), (500, None)], "vec_id long, embedding array<double>")
    got: dict = {}
    for r in neighbors.nearest(df.where("vec_id < 15"), df, 6).collect():
        got.setdefault(r.query, {})[r.rank] = r.neighbor
    unit = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-8)
    for q in range(15):
        order = sorted((k for k in range(120) if k != q), key=lambda k: (-round(float(unit[q] @ unit[k]), 9), k))
        assert [got[q][k + 1] for k in range(6)] == order[:6]
    assert neighbors.nearest(df.limit(0), df, 3).count() == 0


NEAR = [("t1", 1, "sun", 0.9), ("t1", 2, "day", 0.5), ("t2", 1, "sun", 0.7), ("t3", 1, "moon", 0.8), ("t3", 2, "day", 0.7)]


def test_quality(spark):
    df = spark.createDataFrame([("x", *r) for r in NEAR], "trial_id string, token string, rank int, word string, cosine double")
    tops = neighbors.margins(df, "trial_id", "token").unionByName(spark.createDataFrame([("x", "t4", None, None, None, None)], "trial_id string, token string, word string, cosine double, second double, margin double"))
    q = neighbors.quality(tops, "trial_id").first()
    assert (q.token_count, q.unique_top1_count) == (4, 2)
    for got, want in [(q.top1_entropy_bits, 0.9182958), (q.top1_mean_cosine, 0.8), (q.top1_std_cosine, 0.0816497), (q.top1_min_cosine, 0.7), (q.top1_top2_margin_mean, 0.25), (q.top1_top2_margin_std, 0.15)]:
        assert math.isclose(got, want, abs_tol=1e-6)


@pytest.mark.parametrize(("values", "score"), [((0.7, 0.5, 80, 4.0, 0.1), 4.94), ((None, 0.0, 80, 4.0, 0.1), -4.66)])
def test_trial_score(spark, values, score):
    df = spark.createDataFrame([values], "c double, h double, u int, e double, m double")
    assert math.isclose(df.select(neighbors.trial_score(*(F.col(c) for c in "chuem"))).first()[0], score, abs_tol=1e-9)


def test_pools(spark):
    words = spark.createDataFrame([(0, "##abc"), (1, "Abc"), (2, "ab"), (3, "xyz"), (4, "a1b")], "idx int, word string")
    assert [r.word for r in neighbors.word_pool(words, 9, lower=False).collect()] == ["abc", "xyz"]
    pool = neighbors.word_pool(words, 0, lower=True)
    assert [(r.idx, r.word) for r in pool.collect()] == [(0, "abc")]
    extra = spark.createDataFrame([("abc",), ("no",), ("no",)], "word string")
    assert sorted(r.word for r in neighbors.with_extras(pool, extra).collect()) == ["abc", "no"]


def test_grids(spark):
    grid = trials.cross_grid(spark, {"epochs": [8, 12], "rate": [0.1, 0.2, 0.3]}, "g")
    rows = sorted(grid.collect())
    assert len(rows) == 6 and rows[0].trial_id == "g_0000" and (rows[1].epochs, rows[1].rate) == (8, 0.2)
    swept = sorted(trials.sweep(spark, {"a": 1, "b": 1}, {"a": [1, 2], "b": [3]}, [{"a": 2, "b": 3}, {"a": 2}], "s").collect())
    assert [(r.trial_id, r.a, r.b) for r in swept] == [("s_0000", 1, 1), ("s_0001", 2, 1), ("s_0002", 1, 3), ("s_0003", 2, 3)]
    done = spark.createDataFrame([("s_0001",), (None,)], "trial_id string")
    assert trials.left_to_run(trials.sweep(spark, {"a": 1}, {"a": [2]}, [], "s"), done).count() == 1


def test_leaderboard(spark):
    rows = [("a", 1.0, None), ("b", None, None), ("c", 2.0, "boom"), ("d", 1.0, " "), (None, 9.0, None)]
    df = spark.createDataFrame(rows, "trial_id string, score double, error string").withColumn("logged_at", F.lit(None).cast("timestamp"))
    assert [(r.place, r.trial_id, r.score) for r in trials.leaderboard(df, 5).collect()] == [(1, "a", 1.0), (2, "d", 1.0), (3, "b", -999.0)]


def test_consensus(spark):
    schema = "trial_id string, token string, rank int, word string, cosine double"
    near = [(t, "g", k + 1, w, c) for t, ws in {"1": ["fish", "sun"], "2": ["sun", "fish"], "3": ["fish", "day"]}.items() for k, (w, c) in enumerate(zip(ws, (0.9, 0.5)))]
    near[4] = ("3", "g", 1, "Fish", 0.9)
    near += [("1", "076", 1, "hand", 0.9), ("1", "h", 1, "Leak", 0.9), ("2", "i", 1, "low", 0.9), ("2", "i", 2, "x", 0.895)]
    anchors, leaks = spark.createDataFrame([("076",)], "token string"), spark.createDataFrame([("leak",)], "word string")
    tops = lambda rows: neighbors.margins(spark.createDataFrame(rows, schema), "trial_id", "token")
    cast = consensus.votes(tops(near), anchors, leaks, 0.01, 0.08)
    used = spark.createDataFrame([(str(k),) for k in range(7)], "trial_id string")
    assert consensus.consensus(cast, used, 2, 0.35).count() == 0  # needs 3 of 7
    got = consensus.consensus(cast, used.limit(3), 2, 0.35).collect()
    assert [(r.token, r.word, r.trials, r.required, r.alternates) for r in got] == [("g", "fish", 2, 2, "sun")]
    many = spark.createDataFrame([("1", f"t{k}", 1, "w" if k < 3 else "u" if k < 5 else f"v{k}", 0.5) for k in range(20)], schema)
    many = many.withColumn("word", F.when(F.col("token") == "t1", "W").otherwise(F.col("word")))
    banned = consensus.banned_words(neighbors.margins(many, "trial_id", "token"), 0.08)
    assert [r.word for r in banned.collect()] == ["w"]
    top = consensus.consensus(cast, used.limit(3), 1, 0.0, top=1).collect()
    assert [(r.token, r.word) for r in top] == [("g", "fish")]


@pytest.mark.parametrize(("gap", "want"), [(1, [(1, 5), (7, 8)]), (0, [(1, 3), (4, 5), (7, 8)])])
def test_islands(spark, gap, want):
    profile = spark.createDataFrame([(1, x, n) for x, n in enumerate([0, 3, 3, 0, 3, 0, 0, 3])], "img long, x int, n int")
    assert sorted((r.low, r.high) for r in pixels.islands(profile, "x", 2, gap, "img").collect()) == want


def test_segments(spark):
    rows = [(1, x, y, 0) for y in (2, 3, 10) for x in (1, 2, 3, 8, 9)] + [(1, 20, 20, 255)]
    df = spark.createDataFrame(rows, "img long, x int, y int, v int")
    got = pixels.segments(df, row_ink=2, column_ink=1, row_gap=1, padding=1).orderBy("number").collect()
    assert [tuple(r) for r in got] == [(1, 1, 0, 1, 5, 5), (1, 2, 7, 1, 11, 5), (1, 3, 0, 9, 5, 12), (1, 4, 7, 9, 11, 12)]
    assert pixels.segments(df.limit(0)).count() == 0


def test_presets_and_known_trials(spark):
    assert consensus.bounds(min_margin=0.5)["min_margin"] == 0.5 and consensus.bounds("strict", min_margin=0.5)["min_margin"] == 0.05
    near, log = spark.createDataFrame([("a",), ("b",)], "trial_id string"), spark.createDataFrame([("a",)], "trial_id string")
    assert consensus.known_trials(near, log).count() == 1 and consensus.known_trials(near, log.limit(0)).count() == 2


def test_two_stages_and_leftovers(spark):
    df = spark.createDataFrame([("1", "000.gif", 99), ("2", "1.gif", 54), ("3", "2.gif", 99)], "crop string, name string, length int")
    got = matching.two_stages(df, lambda p: F.when(F.col("crop") == "1", "bad_crop").otherwise("single"), lambda p: F.concat(F.lit("x"), "crop"))
    assert {r.crop: r.label for r in got.collect()} == {"1": None, "2": "x2", "3": "x3"}
    assert {r.crop for r in matching.leftovers(df).collect()} == {"1", "2"}


def test_boxes_masks_and_strips(spark):
    dots = spark.createDataFrame([(1, 3, 4, 0), (1, 9, 5, 100), (1, 50, 50, 255)], "img long, x int, y int, v int")
    b = pixels.bounding_boxes(dots, padding=4).first()
    assert (b.left, b.top, b.right, b.bottom) == (0, 0, 14, 10)
    assert {r.v for r in pixels.binarize(dots).collect()} == {0, 255}
    masks = spark.createDataFrame([(1, 1, [0b1111, 0])], "img long, key long, mask array<bigint>")
    other = spark.createDataFrame([(1, "x", [0b0111, 1])], "key long, label string, mask array<bigint>")
    m = pixels.mask_scores(masks, other).first()
    assert (m.overlap, m.union_) == (3, 5) and math.isclose(m.score, 0.6 - 0.0002)


def test_strips_by_hand(spark):
    images = spark.createDataFrame([(1, 100, 30, 0), (2, 101, 30, 92), (3, 200, 30, 635), (4, 400, 200, 535), (5, 3, 9, 10)], "img long, width int, height int, number int")
    boxes = pixels.strip_boxes(images)
    got = {(r.img, r.strip): (r.left, r.top, r.right, r.bottom) for r in boxes.collect()}
    assert [got[1, k] for k in range(5)] == [(0, 0, 20, 30), (20, 0, 40, 30), (40, 0, 60, 30), (60, 0, 80, 30), (80, 0, 100, 30)]
    # number 93 is 0.18 x 101 = 18.18 wide around 30.3, number 94 is 22.22 wide around 50.5, the last is moved inwards
    assert got[2, 1] == (21, 0, 39, 30) and got[2, 2] == (40, 0, 62, 30) and got[2, 4] == (81, 0, 101, 30)
    assert [got[5, k][:1] + got[5, k][2:3] for k in range(5)] == [(0, 1), (0, 1), (1, 2), (2, 3), (2, 3)]
    mended = {(r.img, r.strip): r for r in pixels.mended_boxes(boxes).collect()}
    m = mended[3, 4]  # number 639: 40 wide, a twentieth off
    assert (m.left, m.right, m.band_right) == (160, 198, None)
    m = mended[4, 0]  # number 535: 80 x 200, a hundredth off all around, a white band at the lower left
    assert (m.left, m.top, m.right, m.bottom, m.band_right, m.band_top) == (1, 2, 79, 198, 33, 182)
    dots = spark.createDataFrame([(4, 1, 197, 7), (4, 33, 197, 7), (4, 0, 5, 7), (4, 20, 2, 7)], "img long, x int, y int, v int")
    cut = sorted((r.strip, r.x, r.y, r.v) for r in pixels.strip_pixels(dots, pixels.mended_boxes(boxes)).where("strip = 0").collect())
    assert cut == [(0, 0, 195, 255), (0, 19, 0, 7), (0, 32, 195, 7)]


def test_masks_of_cells(spark):
    areas = {r.label: (r.left, r.top, r.right, r.bottom) for r in pixels.grid_areas(spark.createDataFrame([(1, 1300, 400)], "img long, width int, height int"), [f"c{k}" for k in range(60)]).collect()}
    assert len(areas) == 52 and areas["c0"] == (8, 6, 92, 56) and areas["c14"] == (108, 106, 192, 156)
    dots = [(k, x + 5 * k, y, 0) for k in (1, 2) for x in range(4) for y in range(8) if x == 0 or y == 7] + [(3, 0, 0, 0), (4, 0, 0, 255)]
    masks = {r.img: r.mask for r in pixels.glyph_masks(spark.createDataFrame(dots, "img long, x int, y int, v int"), size=16, border=4).collect()}
    assert masks[1] == masks[2] and 4 not in masks and len(masks[1]) == 4
    places = lambda m: {64 * w + b for w, bits in enumerate(m) for b in range(64) if bits >> b & 1}
    assert places(masks[1]) == {(4 + y) * 16 + 6 + x for x in range(4) for y in range(8) if x == 0 or y == 7}
    assert len(places(masks[3])) == 1
    scores = spark.createDataFrame([(1, "b", 0.5), (1, "a", 0.5), (1, "c", 0.9)], "img long, label string, score double")
    assert [(r.label, r["rank"]) for r in pixels.ranked_masks(scores, 2).orderBy("rank").collect()] == [("c", 1), ("a", 2)]


def test_text_and_gloss_vectors(spark):
    vectors = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, None)], "vec_id long, embedding array<float>")
    pieces = spark.createDataFrame([("g", "ab", 0), ("g", "ab", 0), ("g", "ab", 1), ("g", "b", 1), ("h", "", None), ("h", "?", 9)], "token string, text string, piece long")
    texts = neighbors.text_vectors(pieces, vectors, "token", "text")
    got = {r.text: [round(x, 6) for x in r.vector] for r in texts.collect()}
    assert got == {"ab": [0.666667, 0.333333], "b": [0.0, 1.0], "": [0.0, 0.0], "?": [0.0, 0.0]}
    glosses = {r.token: r.vector for r in neighbors.gloss_vectors(texts, "token").collect()}
    assert np.allclose(glosses["g"], np.array([1 / 3, 2 / 3]) / math.hypot(1 / 3, 2 / 3)) and glosses["h"] == [0.0, 0.0]  # the mean of means
    projected = spark.createDataFrame([("t", "g", [0.0, 2.0]), ("t", "x", [1.0, 0.0])], "trial_id string, token string, vector array<double>")
    found = neighbors.anchor_cosines(projected, neighbors.gloss_vectors(texts, "token"), "trial_id").collect()
    assert [(r.token, round(r.cosine, 6)) for r in found] == [("g", round(2 / math.sqrt(5), 6))]
    pool = spark.createDataFrame([(1, "one"), (None, "ab")], "idx int, word string")
    letters = spark.createDataFrame([("ab", 0), ("ab", 1)], "word string, piece long")
    assert {r.word: list(r.vector) for r in neighbors.pool_vectors(pool, vectors, letters).collect()} == {"one": [0.0, 1.0], "ab": [0.5, 0.5]}


def test_counts_by_window_and_misses(spark):
    r = random.Random(8)
    texts = [" ".join(r.choice("abc.") for _ in range(r.randint(0, 12))) for _ in range(20)]
    df = lines(spark, *texts)
    both = cooccurrence.both_ways(cooccurrence.pair_counts_by_window(df, [1, 3]), "window")
    got: dict = {}
    for x in both.collect():
        got.setdefault(x.window, {})[x.center, x.context] = x.n
    for w in (1, 3):
        want: dict = {}
        for x in cooccurrence.context_pairs(df, w).collect():
            want[x.center, x.context] = want.get((x.center, x.context), 0) + 1
        assert got[w] == want == {(x.center, x.context): x.n for x in cooccurrence.pair_counts(df, w).collect()}
    vocab = spark.createDataFrame([("076", 0), ("040:b", 1)], "token string, idx int")
    wanted = spark.createDataFrame([("76",), ("40",), ("9",)], "token string")
    assert sorted(x.token for x in cooccurrence.missing_tokens(wanted, vocab).collect()) == ["40", "9"]
    assert {x.token: (x.key, x.idx) for x in cooccurrence.variant_index(wanted, vocab).collect()} == {"76": ("076", 0), "40": ("040:b", 1), "9": (None, None)}


def test_numbers_within_keys(spark):
    rows = [(k % 3 if k % 7 else None, k) for k in range(100)]
    got = numbered(spark.createDataFrame(rows, "key int, at int"), "at", within=("key",)).collect()
    want: dict = {}
    for key, at in rows:
        want.setdefault(key, []).append(at)
    assert sorted((str(r.key), r.at, r.id) for r in got) == sorted((str(k), at, i) for k, v in want.items() for i, at in enumerate(v))


def test_staged_tables_are_dropped(spark):
    import os

    before = stages.drop_staged(spark)
    path = stages.stage(spark.range(3), "x").inputFiles()[0].removeprefix("file://")
    assert before >= 0 and os.path.exists(path)
    assert stages.drop_staged(spark) == 1 and not os.path.exists(path) and stages.drop_staged(spark) == 0


def test_seams(spark):
    ink = np.zeros((4, 9), bool)
    ink[:, :4] = ink[:, 5:] = True
    assert pixels.best_seam(ink) == (0, [4, 4, 4, 4])
    rows = [(1, int(x), int(y), 0) for y, x in zip(*np.nonzero(ink))] + [(2, k, 0, 0) for k in range(9)]
    got = pixels.split_by_seams(spark.createDataFrame(rows, "img long, x int, y int, v int"), min_split=5, min_part=2).collect()
    assert sorted((r.img, r.part, r.left, r.right, r.n_ink) for r in got) == [(1, 0, 0, 4, 16), (1, 1, 5, 9, 16), (2, 0, 0, 9, 9)]
    two = rows + [(1, int(x), int(y) + 20, 0) for y, x in zip(*np.nonzero(ink))] + [(1, 30, 40, 255)]
    df = spark.createDataFrame(two, "img long, x int, y int, v int")
    boxes = pixels.seam_segments(df, row_ink=1, column_ink=1, row_gap=0, column_gap=1, min_split=5, min_part=2, padding=1).where("img = 1").orderBy("number").collect()
    assert [(r.number, r.left, r.right, r.top, r.bottom, r.n_ink) for r in boxes] == [(1, 0, 5, 0, 5, 16), (2, 4, 10, 0, 5, 16), (3, 0, 5, 19, 25, 16), (4, 4, 10, 19, 25, 16)]


def brute_cuts(points, min_split, min_part):
    """The regions of a set of points (y, x), cut at the leftmost of all seams without ink, tried one by one from the bottom row up."""
    left, right, top, bottom = min(x for _, x in points), max(x for _, x in points), min(y for y, _ in points), max(y for y, _ in points)
    if right - left + 1 < max(min_split, 2 * min_part + 1):
        return [points]

    def seam(y, x):
        if not left + min_part <= x <= right - min_part or (y, x) in points:
            return None
        if y == top:
            return {y: x}
        above = next((s for d in (-1, 0, 1) if (s := seam(y - 1, x + d))), None)
        return above and above | {y: x}

    path = next((s for x in range(left, right + 1) if (s := seam(bottom, x))), None)
    if path is None:
        return [points]
    a = {(y, x) for y, x in points if x < path[y]}
    return brute_cuts(a, min_split, min_part) + brute_cuts(points - a, min_split, min_part) if a and points - a else [points]


def test_seams_equal_brute_force(spark):
    r = random.Random(5)
    images = {k: {(y, x) for y in range(6) for x in range(14) if r.random() < 0.3} for k in range(40)}
    df = spark.createDataFrame([(k, x, y, 0) for k, ink in images.items() for y, x in ink], "img long, x int, y int, v int")
    got = sorted((g.img, g.left, g.right, g.n_ink) for g in pixels.split_by_seams(df, min_split=5, min_part=2).collect())
    due = sorted((k, min(x for _, x in p), max(x for _, x in p) + 1, len(p)) for k, ink in images.items() for p in brute_cuts(ink, 5, 2))
    assert got == due and len(due) > 50


def test_matching(spark):
    rows = [("q", 1, "a", False, 0.5), ("q", 2, "b", True, 0.9), ("q", 3, "c", True, 0.9), ("r", 1, "a", False, None)]
    df = spark.createDataFrame(rows, "query string, place int, label string, matched boolean, score double")
    assert {r.query: (r.checked, r.label_at) for r in matching.short_circuit(df, "query", "place", "matched").collect()} == {"q": (2, 2), "r": (1, None)}
    assert [(r.query, r.label, r.score) for r in matching.best_score(df, "query", "place", "score", "label").collect()] == [("q", "b", 0.9)]
    assert sorted((r.query, r.place, r.batch) for r in matching.chunks(df.select("query", F.col("place").alias("p")), 2, "query", "p").collect()) == [("q", 0, 0), ("q", 0, 1), ("q", 1, 0), ("r", 0, 0)]
    cells = matching.cells(spark.createDataFrame([("123",), ("001",)], "label string"), spark.createDataFrame([("001",)], "label string")).collect()
    assert {r.label: (r.sheet, r.row, r.col, r.missing) for r in cells} == {"123": (1, 2, 3, True), "001": (0, 0, 1, False)}
    scored = matching.with_scorer(df, lambda pairs: F.concat(F.lit("score: 0."), F.lpad((F.col("place") * 100).cast("string"), 3, "0")))
    assert scored.where("raw = 'score: 0.200'").count() == 1
