"""Text functions, tokenizers, parsers and lines on literal strings."""

import pytest
from pyspark.sql import functions as F

from tesserae.functions import parsers, text
from tesserae.operators import lines as ln
from tesserae.operators.tokenize import STRATEGIES, sequences, tokenize, tokens_of

LINE = "9-4.120a-004. 064V:22by-(1-2)!*"
EXPECTED = {
    "barthel": "009 004 120a 004 064V 022by 001 002",
    "barthel_separators": "009 - 004 . 120a - 004 . 064V : 022by - 001 - 002",
    "barthel_ligatures": "009 004.120a 004 064V:022by 001 002",
    "barthel_noag": "009 004 120 004 064 022y 001 002",
    "barthel_separators_noag": "009 - 004 . 120 - 004 . 064 : 022y - 001 - 002",
    "barthel_ligatures_noag": "009 004.120 004 064:022y 001 002",
    "suffix": "009 004 120 a 004 064 V 022 b y 001 002",
    "suffix_separators": "009 - 004 . 120 a - 004 . 064 V : 022 b y - 001 - 002",
    "suffix_ligatures": "009 004.120 a 004 064:022 V b y 001 002",
    "suffix_noag": "009 004 120 004 064 022 y 001 002",
    "simple": "009 004 120 004 064 022 001 002",
    "simple_separators": "009 004 . 120 004 . 064 : 022 001 002",
    "simple_ligatures": "009 004.120 004 064:022 001 002",
    "glyph_variants": "009 004 120:a 004 064 022:b+y 001 002",
}


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column.alias("y")).first().y


@pytest.mark.parametrize("strategy", EXPECTED)
def test_strategies(spark, strategy):
    assert " ".join(one(spark, LINE, tokens_of(strategy, F.col("x")))) == EXPECTED[strategy]


@pytest.mark.parametrize("strategy", STRATEGIES)
def test_strategies_of_null_and_empty(spark, strategy):
    assert one(spark, None, tokens_of(strategy, F.col("x"))) == []
    assert one(spark, "", tokens_of(strategy, F.col("x"))) in ([], [""])


def test_unknown_strategy():
    with pytest.raises(ValueError):
        tokens_of("nothing", None)


def test_long_codes_and_sequences(spark):
    assert one(spark, "1234-5", tokens_of("simple", F.col("x"))) == ["1234", "005"]
    t = tokenize(spark.createDataFrame([(1, "a b"), (2, " "), (3, None)], "line_id long, text string"), "characters")
    assert {r.line_id: list(r.tokens) for r in sequences(t).collect()} == {1: ["a", "b"]}


@pytest.mark.parametrize(("key", "parts"), [("076", ("076", "", [])), ("076:a", ("076", "a", [])), ("076:a+x,y", ("076", "a", ["x", "y"])), ("076:+h,x", ("076", "", ["h", "x"]))])
def test_keys_both_ways(spark, key, parts):
    t = one(spark, key, text.parse_variant_key(F.col("x")))
    assert (t.glyph, t.variant, list(t.modifiers)) == parts
    assert one(spark, key, text.variant_key(text.parse_variant_key(F.col("x")))) == key


def test_small_functions(spark):
    assert one(spark, "\x1c a\xa0 \tb\n", text.normalize_text(F.col("x"))) == "a b"
    assert one(spark, "64V!?", text.code(F.col("x"))) == "064" and one(spark, "V", text.code(F.col("x"))) is None
    assert one(spark, "5.22b.1234", text.pad_numbers(F.col("x"))) == "005.022b.1234"
    assert one(spark, "org/model", text.safe_model_name(F.col("x"))) == "org_model"
    assert one(spark, "-a b/c-", text.safe_file_part(F.col("x"))) == "a-b-c"
    assert one(spark, "12.gif", text.leading_number(F.col("x"))) == 12 and one(spark, "x.gif", text.leading_number(F.col("x"))) == 10**9
    assert tuple(one(spark, "140x120", text.cell_size(F.col("x")))) == (140, 120)
    assert one(spark, "<R076>", text.wrap_token(F.lit("076"))) == "<R076>"
    assert one(spark, "a" * 200, text.data_uri(F.lit("image/png"), F.col("x"))).count("\n") == 0


@pytest.mark.parametrize(("raw", "score"), [("score: 0.734", "0.734"), ("x 0.999\nScore: 0.5\n", "0.999"), ("12: 0.5", None), ("10.123", None), (None, None), ("0.1234 0.321", "0.321")])
def test_scores(spark, raw, score):
    assert one(spark, raw, parsers.score(F.col("x"))) == score


def test_strict_scores_raise(spark):
    with pytest.raises(Exception, match="three decimals"):
        one(spark, "0.5", parsers.score(F.col("x"), strict=True))


def test_batch_scores(spark):
    raw = "045: overall=7, structure=3, shape=4\nnothing\n001: 0.100\n001 = 0.200"
    assert one(spark, raw, parsers.batch_scores(F.col("x"))) == {"045": "0.734", "001": "0.200"}
    wanted = lambda *labels: F.array(*map(F.lit, labels))
    assert one(spark, raw, parsers.batch_scores(F.col("x"), wanted("001"), strict=True)) == {"001": "0.200"}
    assert one(spark, raw, parsers.missing_labels(parsers.batch_scores(F.col("x")), wanted("001", "007"))) == ["007"]
    with pytest.raises(Exception, match="no score for 007"):
        one(spark, raw, parsers.batch_scores(F.col("x"), wanted("001", "007"), strict=True))


def test_labels_and_fields(spark):
    label = lambda raw: one(spark, raw, parsers.label(F.col("x")))
    assert label("id 1234") is None and label("812") is None and label("is 045, 046") == "045"
    assert one(spark, " Yes ", parsers.boolean(F.col("x"))) is True and one(spark, "maybe", parsers.boolean(F.col("x"))) is None
    assert one(spark, "match: no\nMatch: yes: sure", parsers.field(F.col("x"), "match")) == "yes: sure"
    other = lambda raw: one(spark, raw, parsers.alternates(F.col("x"), ["001", "002", "B3"]))
    assert other("alternates: 001, 002 , 001, 9, b3+001\nalternates: 002") == ["001", "002", "B3.001"]
    assert other("Alternates: N/A") == other("alternates:") == other("x") == [] and other("alternates: 001; 002") == []
    kind = lambda raw: one(spark, raw, parsers.crop_kind(F.col("x")))
    assert kind("kind: Ligature") == "ligature" and kind("x") == kind("kind: round") == "single" and kind("kind: round\n kind : BAD_CROP ") == "bad_crop"
    with pytest.raises(Exception, match="no digits"):
        one(spark, "V", text.strict_code(F.col("x")))
    known = lambda raw: one(spark, raw, parsers.known_label(F.col("x"), ["A1", "b2"]))
    assert known("a1+B2") == "A1.b2" and known("a1.c3") is None
    assert one(spark, "try again in 250ms", parsers.retry_seconds(F.col("x"), 0.1)) == 0.25 and one(spark, "x", parsers.retry_seconds(F.col("x"), 1.0)) == 1.0


def test_best_label_and_reasoning(spark):
    best = lambda raw: one(spark, raw, parsers.best_label(F.col("x"), ["A1", "A1b", "?x"]))
    assert best("Label: a1.A1B ") == "A1.A1b" and best("I see a1b, or A1") == "A1b" and best("it is ?X") == "?x" and best("nothing") == best("A12") == "A1"
    why = lambda raw: one(spark, raw, parsers.reasoning(F.col("x")))
    assert why("Reasoning: round\nand small\nlabel: A1") == "round\nand small" and why(" just so ") == "just so"
    assert why("my reasoning is short. reasoning : a label: x\n raw : y") == "a label: x" and why("reasoning:\nlabel: A1") == "label: A1" and why("reasoning:") == "reasoning:"
    m = one(spark, "kind: ligature\nlabel: a1\nalternates: A1b\nreasoning: tall", parsers.match(F.col("x"), ["A1", "A1b"]))
    assert (m.kind, m.label, list(m.alternates), m.reasoning) == ("ligature", "A1", ["A1b"], "tall")


PAGE = '<ul>x<li class="a"><a href="#">Aa1</a> 1-2.<br>3 &amp; 4<li><a>Aa2</a>5</li><li>none</li><li><a>Aa1</a>6</li></ul>'


def test_html_lines(spark):
    pages = spark.createDataFrame([("A", PAGE), ("B", None)], "tablet string, html string")
    assert sorted((r.ord, r.title, r.text) for r in ln.extract_lines(pages).collect()) == [(0, "Aa2", "5"), (2, "Aa1", "6")]
    odd = spark.createDataFrame([("A", "<li>\n <a>T\n 1<br></a>  a \n b&nbsp;&amp;lt;</li><li><a>T2</a>open")], "tablet string, html string")
    for general in (True, False):
        assert [(r.title, r.text) for r in ln.extract_lines(odd, general=general).collect()] == [("T 1", "a b &lt;")]
    plain = spark.createDataFrame([("A", "<li><a>Ta1</a> 1-<br>2*</li>\n<li><a>Ta2</a>\n3</li>")], "tablet string, html string")
    both = [sorted((r.title, r.text) for r in ln.extract_lines(plain, general=g).collect()) for g in (True, False)]
    assert both[0] == both[1] == [("Ta1", "1- 2*"), ("Ta2", "3")]


def test_read_pages(spark, tmp_path):
    (tmp_path / "complete/raw").mkdir(parents=True)
    (tmp_path / "complete/raw/A.html").write_text(PAGE)
    row = ln.read_pages(spark, f"{tmp_path}/*/raw/*.html").first()
    assert (row.corpus, row.tablet, row.html) == ("complete", "A", PAGE)


def test_latest_lines_and_counts(spark):
    schema = "line_id long, corpus string, tablet string, ord int, title string, text string, loaded_at timestamp"
    from datetime import datetime

    rows = [(1, "c", "A", 5, "Aa1", "old", datetime(2024, 1, 1)), (1, "c", "A", 3, "Aa1", "new", datetime(2024, 1, 2)), (2, "c", None, 1, "Aa1", None, None), (3, "c", "A", 1, None, "x", None)]
    df = spark.createDataFrame(rows, schema)
    assert sorted((r.line_id, r.ord, r.text) for r in ln.latest_lines(df).collect()) == [(1, 3, "new"), (2, 1, None)]
    assert {r.level: r.n_lines for r in ln.line_counts(df).where("level > 0").collect()} == {1: 4, 2: 4}
    assert ln.latest_lines(df.limit(0)).count() == 0
