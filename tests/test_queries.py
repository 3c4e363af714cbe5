"""Every registered query against its SQL on the smallest tables, where these are there."""

import glob
import math
import os
from decimal import Decimal

import pytest

import __spark_entry__
from tesserae import queries as core

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return con


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return "null"
    return f"{value:.5g}" if isinstance(value, float | Decimal) else str(value)


def rows(columns, found):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple(plain(r[k]) for k in order) for r in found)


@pytest.mark.parametrize("name", sorted(core.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    own, other = core.queries()[name](spark, SF), duck.execute(core.oracle_sql()[name])
    columns = [d[0] for d in other.description]
    assert sorted(own.columns) == sorted(columns)
    assert rows(own.columns, own.collect()) == rows(columns, other.fetchall())


def test_entry_and_names(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", sorted(set(core.queries()) - set(core.oracle_sql())))
def test_queries_without_sql_run(spark, name):
    assert core.queries()[name](spark, SF).count() > 0


def test_every_trial_takes_part_over_all_lines(spark, duck):
    good = "SELECT DISTINCT trial_id FROM trial_records JOIN trial_configs USING (trial_id) WHERE context_window >= 1 AND (error IS NULL OR trim(error) = '')"
    trials = {t for (t,) in duck.execute(good).fetchall()}
    qualities = core.queries()["neighbor_quality"](spark, SF).collect()
    assert {r.trial_id for r in qualities} == trials and len(trials) > 50
    simple = duck.execute("SELECT trial_id FROM trial_configs WHERE strategy = 'simple' AND context_window >= 1").fetchall()
    paired = f"WITH {core.sql_tokens('simple')}, long_ AS (SELECT line_id FROM toks GROUP BY line_id HAVING count(DISTINCT token) > 1) SELECT count(DISTINCT token) FROM toks WHERE line_id IN (SELECT line_id FROM long_)"
    most = duck.execute(paired).fetchone()[0]
    counts = {r.trial_id: r.token_count for r in qualities}
    assert {counts[t] for (t,) in simple if t in trials} == {most}


def test_seam_split_takes_every_pixel_of_ink(spark, duck):
    ink = dict(duck.execute(f"WITH {core.DOTS} SELECT img, count(*) FROM dots WHERE v < 190 GROUP BY img").fetchall())
    found: dict = {}
    for r in core.queries()["seam_split"](spark, SF).collect():
        found[r.img] = found.get(r.img, 0) + r.n_ink
    assert found == ink


def test_projection_runs_on_the_whole_settings(spark, monkeypatch):
    seen = {}

    def fit(counts, n_tokens, settings, anchors=None, shards=None):
        seen.update(pairs=counts.agg({"n": "sum"}).first()[0], settings=settings, anchors=anchors)
        return core.learning.Model.create(n_tokens, settings), []

    monkeypatch.setattr(core.learning, "fit_projection", fit)
    assert len(core.queries()["train_projection"](spark, SF).first().projected) == 64
    assert seen["settings"] == core.learning.Settings()
    assert seen["pairs"] == core.cooc.context_pairs(core.tokens(spark, SF, "simple"), 4).count()
    ids, targets = seen["anchors"]
    there = {r.token: r.idx for r in core.cooc.vocabulary(core.tokens(spark, SF, "simple")).collect()}
    assert ids.tolist() == [there[a] for a in core.ANCHORS if a in there] != [] and abs((targets**2).sum(1) - 1).max() < 1e-9
