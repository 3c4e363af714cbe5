"""Problems 1 to 5 against brute force on small and random lines."""

import itertools
import random
import re
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import pytest

from tesserae.llm import patterns, spans
from tesserae.llm.frequencies import gram_frequencies
from tesserae.llm.pairs import pairs_together
from tesserae.llm.patterns import frequent_patterns
from tesserae.llm.readings import readings
from tesserae.llm.runs import collapse_runs
from tesserae.llm.spans import shared_shares, shared_spans

SCHEMA = "token_id long, line_id long, pos int, glyph string, variant string, modifiers array<string>, read_at timestamp, id string, block int, n long, weight long"


def table(spark, rows):
    """rows of (line_id, pos, glyph, variant, modifiers, read_at); with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(k, *r, "x", 7, 1, 2) for k, r in enumerate(rows)], SCHEMA)


def lines(texts, variants=None):
    """Rows of lines given as lists of glyphs; None is a lost position."""
    return [(k, p, g, (variants or {}).get((k, p)), None, None) for k, t in enumerate(texts) for p, g in enumerate(t) if g is not None]


def random_rows(seed, n_lines=40, glyphs=12, length=30):
    """Lines with copies of passages, holes, unreadable and repeated tokens, and other spellings of the repeated ones."""
    r = random.Random(seed)
    out = []
    passages = [[r.randrange(glyphs) for _ in range(22)] for _ in range(3)]
    for k in range(n_lines):
        text = []
        while len(text) < r.randint(0, length):
            text += r.choice(passages)[r.randint(0, 4) :] if r.random() < 0.3 else [r.randrange(glyphs)] * r.choice([1, 1, 1, 2, 3])
        for p, g in enumerate(text):
            x = r.random()
            if x < 0.03:
                continue
            glyph = r.choice(["?", "", None]) if x < 0.06 else f"{g:03d}"
            variant, mods = r.choice(["", "a", "b", "ab", "abc", "C", None]), r.choice([None, [], ["h"], ["H", "x"]])
            row = (k, p, glyph, variant, mods, datetime(2024, 1, 1) + timedelta(seconds=p) if r.random() < 0.9 else None)
            out.append(row)
            if x > 0.9:
                spelled = glyph if glyph in (None, "", "?") else r.choice([f" {g}?", f"({g:02d})", f"{g:03d}!"])
                out.append((k, p, spelled, None if not variant else variant.upper() + "v", mods, row[5]))
    r.shuffle(out)
    return out


def read(rows):
    """line -> pos -> (glyph, variant, modifiers), readable ones only, by the statement."""
    out = defaultdict(dict)
    for line, pos, glyph, variant, mods, _ in rows:
        d = re.search("[0-9]+", glyph or "")
        if d:
            out[line][pos] = (d[0].zfill(3), "".join(c for c in (variant or "").lower() if c in "abcdefg"), ",".join(c for m in mods or [] for c in m.lower()))
    return out


def near(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute_runs(rows):
    out = set()
    for line, toks in read(rows).items():
        start = None
        for p in [*sorted(toks), 10**9]:
            linked = p in toks and p - 1 in toks and toks[p][0] == toks[p - 1][0] and near(toks[p][1], toks[p - 1][1])
            if not linked:
                if start is not None and last > start:
                    out.add((line, start, last))
                start = p
            last = p
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_runs(spark, seed):
    rows = random_rows(seed)
    found = {(r.line_id, r.start_pos, r.end_pos) for r in collapse_runs(table(spark, rows)).collect()}
    assert found == brute_runs(rows)


def test_runs_time_single_events_and_dirt(spark):
    t = datetime(2024, 1, 1)
    rows = [(1, 0, "7", "a", None, t), (1, 1, "007", "ab", None, None), (1, 2, " 07?", None, None, t + timedelta(seconds=5)), (1, 3, "8", None, None, None), (None, 0, "7", "a", None, t), (2, None, "7", "a", None, t), (2, -1, "7", "a", None, t), (1, 0, "7!", "A", None, None)]
    out = {(r.start_pos, r.end_pos): r for r in collapse_runs(table(spark, rows), least=1).collect()}
    assert set(out) == {(0, 1), (2, 2), (3, 3)}  # ab and '' differ by two letters
    assert out[0, 1].n_tokens == 2 and out[0, 1].seconds == 0.0 and out[3, 3].seconds is None
    assert collapse_runs(table(spark, [])).count() == 0


def test_long_line_is_cut_without_loss(spark):
    """Longer than several blocks: runs, spans, pairs, patterns and terms across the blocks' ends stay whole."""
    text = [f"{k % 97:03d}" for k in range(1300)]
    for at in (510, 511, 512, 513):
        text[at] = "500"
    rows = lines([text, text[480:560], ["001", "002"]])
    assert {(r.line_id, r.start_pos, r.end_pos) for r in collapse_runs(table(spark, rows)).collect()} == brute_runs(rows) == {(0, 510, 513), (1, 30, 33)}
    assert {(r.line_id, r.start_pos, r.end_pos) for r in shared_spans(table(spark, rows)).collect()} == brute_spans(rows, 16)
    assert {(r.glyph_a, r.glyph_b): r.n_ab for r in pairs_together(table(spark, rows), [2]).collect()} == brute_pairs(rows, 2)[0]
    assert {r.event_pattern: r.n for r in frequent_patterns(table(spark, rows), share=1).collect()} == brute_patterns(rows, 1)
    assert {r.event_pattern: r.n for r in frequent_patterns(table(spark, rows), share=2).collect()} == brute_patterns(rows, 2)
    assert {r.gram: r.records for r in gram_frequencies(table(spark, rows), 2).collect()}["500 500"] == 2


def brute_pairs(rows, w):
    toks, n_ab, n_a = read(rows), Counter(), Counter()
    for line in toks.values():
        n_a.update({g for g, _, _ in line.values()})
        n_ab.update({tuple(sorted((line[p][0], line[q][0]))) for p in line for q in line if abs(p - q) <= w and line[p][0] != line[q][0]})
    return n_ab, n_a, len(toks)


@pytest.mark.parametrize("seed", [3, 4])
def test_pairs(spark, seed):
    rows = random_rows(seed)
    found = pairs_together(table(spark, rows), [4, None, 2, -1, 0, 2]).collect()
    for w in (2, 4):
        n_ab, n_a, n = brute_pairs(rows, w)
        got = {(r.glyph_a, r.glyph_b): (r.n_ab, r.n_a, r.n_b, r.n_lines) for r in found if r.context_window == w}
        assert got == {p: (c, n_a[p[0]], n_a[p[1]], n) for p, c in n_ab.items()}
    n_ab, n_a, n = brute_pairs(rows, 2)
    strict = {(r.glyph_a, r.glyph_b) for r in pairs_together(table(spark, rows), [2], least_lines=5, share=3, lift=1).collect()}
    assert strict == {(a, b) for (a, b), c in n_ab.items() if c >= 5 and 3 * c >= n and c * n >= n_a[a] * n_a[b]}


def test_pairs_empty(spark):
    assert pairs_together(table(spark, []), [2]).count() == 0
    assert pairs_together(table(spark, lines([["1", "2"]])), []).count() == 0


def brute_patterns(rows, share, shortest=3, longest=5, gap=3):
    toks, count = read(rows), Counter()
    for line in toks.values():
        ev = {p: g + ("+" + m if m else "") for p, (g, _, m) in line.items()}
        held, level = set(), {((e,), p) for p, e in ev.items()}
        for k in range(2, longest + 1):
            level = {(pat + (ev[q],), q) for pat, p in level for q in range(p + 1, p + gap + 1) if q in ev}
            if k >= shortest:
                held |= {pat for pat, _ in level}
        count.update(held)
    return {" ".join(p): n for p, n in count.items() if n * share >= len(toks)}


@pytest.mark.parametrize("seed", [5, 6])
def test_patterns(spark, seed):
    rows = random_rows(seed, n_lines=25, glyphs=6, length=18)
    found = {r.event_pattern: r.n for r in frequent_patterns(table(spark, rows), share=4).collect()}
    assert found == brute_patterns(rows, 4)


def test_patterns_empty(spark):
    assert frequent_patterns(table(spark, [])).count() == 0
    assert frequent_patterns(table(spark, lines([["1"], ["?"], ["2", "3"]])), share=1).count() == 0


def test_diagram_nodes_round_trip():
    rests = {(1, 4, 2, 5), (3, 4), ()}
    assert set(patterns.decode(patterns.encode(rests - {()}))) == rests - {()}


def brute_spans(rows, window):
    where = defaultdict(set)
    for line, toks in read(rows).items():
        for p in toks:
            if all(p + k in toks for k in range(window)):
                where[tuple(toks[p + k][0] for k in range(window))].add((line, p))
    cover = defaultdict(set)
    for places in where.values():
        if len({line for line, _ in places}) > 1:
            for line, p in places:
                cover[line].update(range(p, p + window))
    out = set()
    for line, held in cover.items():
        for p in held:
            if p - 1 not in held:
                out.add((line, p, next(q for q in itertools.count(p) if q + 1 not in held)))
    return out


@pytest.mark.parametrize(("seed", "window"), [(7, 16), (8, 5), (9, 8)])
def test_spans(spark, seed, window):
    rows = random_rows(seed, n_lines=30, glyphs=4 if window < 16 else 8, length=60)
    found = {(r.line_id, r.start_pos, r.end_pos) for r in shared_spans(table(spark, rows), window).collect()}
    assert found == brute_spans(rows, window)
    assert found


def test_spans_of_one_glyph_and_shares(spark):
    rows = lines([["1"] * 40, ["1"] * 20 + ["2"], ["1"] * 15, ["3"] * 40])
    assert {(r.line_id, r.start_pos, r.end_pos) for r in shared_spans(table(spark, rows)).collect()} == {(0, 0, 39), (1, 0, 19)}
    assert {r.line_id: r.n_shared for r in shared_shares(table(spark, rows)).collect()} == {0: 40, 1: 20, 2: 0, 3: 0}
    assert shared_spans(table(spark, [])).count() == 0


def test_equal_windows_have_equal_anchors():
    """The name of a window depends on nothing around it."""
    import numpy as np

    r = random.Random(0)
    window = [r.randrange(5) for _ in range(16)]
    seen = set()
    for _ in range(50):
        text = [r.randrange(5) for _ in range(r.randint(0, 9))] + window + [r.randrange(5) for _ in range(r.randint(0, 9))]
        at = next(i for i in range(len(text)) if text[i : i + 16] == window)
        x = {"_group": np.zeros(len(text), int), "pos": np.arange(len(text)), "glyph": (np.array(text), [str(k) for k in range(5)]), "line_id": np.array([1]), "block": np.array([0])}
        b = spans.anchors(16, 9, 512)(x)
        for a, p, g in zip(b["anchor"].to_pylist(), b["pos"].to_pylist(), b["glyphs"].to_pylist()):
            if p <= at < p + len(g) - 15:
                seen.add(a)
    assert len(seen) == 1


@pytest.mark.parametrize("depth", [1, 3])
def test_frequencies(spark, depth):
    rows = random_rows(10)
    toks, occurrences, records = read(rows), Counter(), Counter()
    for line in toks.values():
        t = {p: g + (":" + v if v else "") for p, (g, v, _) in line.items()}
        grams = [" ".join(t[p + k] for k in range(n)) for n in range(1, depth + 1) for p in t if all(p + k in t for k in range(n))]
        occurrences.update(grams)
        records.update(set(grams))
    found = {r.gram: (r.occurrences, r.records, r.n_lines, r.mark) for r in gram_frequencies(table(spark, rows), depth).collect()}
    mark = lambda n: "rare" if n <= 2 else "common" if 5 * n > len(toks) else None
    assert found == {g: (n, records[g], len(toks), mark(records[g])) for g, n in occurrences.items()}
    assert gram_frequencies(table(spark, []), depth).count() == 0


def test_readings(spark):
    rows = [(1, 0, "(1053)?", " Ab V", ["H", None, "x "], None), (1, 1, "9-12", None, None, None), (1, 2, "x", "zz", [], None)]
    got = [tuple(r)[2:5] for r in readings(table(spark, rows)).orderBy("pos").collect()]
    assert got == [("1053", "ab", "h,x"), ("009", "", "")]  # the third is unreadable
