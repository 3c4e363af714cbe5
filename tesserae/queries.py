"""The registered queries of the core, over whole tables, and the SQL that gives the same rows."""

from collections.abc import Callable
from functools import partial, reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesserae.functions import parsers, text
from tesserae.functions.vectors import dot, norm, normalize
from tesserae.operators import consensus as votes
from tesserae.operators import cooccurrence as cooc
from tesserae.operators import lines as ln
from tesserae.operators import learning, matching, neighbors, pixels, tops, trials
from tesserae.operators.tokenize import STRATEGIES, exploded, sequences, tokenize
from tesserae.plans.index import numbered
from tesserae.plans.stages import broadcast_below, drop, stage, together
from tesserae.sources import table

Query = Callable[[SparkSession, str], DataFrame]
Neighbors = Callable[[SparkSession, str], tuple[DataFrame, DataFrame, DataFrame]]
FOUND: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: The signs with a gloss.
ANCHORS = ("008", "200", "076", "040")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function by its name, with its SQL if it has one."""

    def add(f: Query) -> Query:
        FOUND[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- lines -----------------------------------------------------------------------------------------------------------

LINES = """
lines AS (SELECT line_id, corpus, tablet, title, text, loaded_at, first_ord AS ord FROM (
  SELECT *, min(ord) OVER (PARTITION BY corpus, tablet, title) AS first_ord,
         row_number() OVER (PARTITION BY corpus, tablet, title ORDER BY loaded_at DESC NULLS LAST, line_id DESC NULLS LAST, text DESC NULLS LAST) AS k
  FROM tablet_lines WHERE title IS NOT NULL) WHERE k = 1)"""


def lines(spark: SparkSession, sf: str) -> DataFrame:
    return ln.latest_lines(table(spark, sf, "tablet_lines"))


@query(f"WITH {LINES} SELECT line_id, corpus, tablet, title, ord, text FROM lines")
def lines_latest(spark, sf):
    return lines(spark, sf).select("line_id", "corpus", "tablet", "title", "ord", "text")


def pages(spark: SparkSession, sf: str) -> DataFrame:
    """The lines as pages of at most 20 items of a list, as they are published."""
    plain = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("\n"), F.lit("<br>"))
    item = F.concat(F.lit("<li><a>"), F.replace(F.replace(F.col("title"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("</a> "), plain(F.coalesce("text", F.lit(""))), F.lit("</li>"))
    return lines(spark, sf).withColumn("page", F.floor(F.col("ord") / 20).cast("int")).groupBy("corpus", "tablet", "page").agg(F.concat(F.lit("<ul>"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "title", item.alias("item")))), lambda x: x["item"]), "\n"), F.lit("</ul>")).alias("html"))


SPACE = r"[\s\x{1c}-\x{1f}\x{0b}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
PAGE_LINES = f"""WITH {LINES}, tidy AS (SELECT corpus, tablet, CAST(floor(ord / 20) AS INTEGER) AS page, ord, title AS raw, trim(regexp_replace(title, '{SPACE}', ' ', 'g')) AS title, trim(regexp_replace(coalesce(text, ''), '{SPACE}', ' ', 'g')) AS text FROM lines)
SELECT corpus, tablet, page, title, text FROM (SELECT *, row_number() OVER (PARTITION BY corpus, tablet, page, title ORDER BY ord DESC, raw DESC) AS k FROM tidy) WHERE k = 1 AND title <> ''"""


@query(PAGE_LINES)
def extract_list_lines(spark, sf):
    return ln.extract_lines(pages(spark, sf)).select("corpus", "tablet", "page", "title", "text")


@query(PAGE_LINES)
def extract_list_lines_plain(spark, sf):
    return ln.extract_lines(pages(spark, sf), general=False).select("corpus", "tablet", "page", "title", "text")


@query(f"""WITH {LINES} SELECT corpus, tablet, CASE grouping(corpus, tablet) WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS level, count(*) AS n_lines
FROM lines GROUP BY ROLLUP (corpus, tablet)""")
def extract_line_counts(spark, sf):
    return ln.line_counts(lines(spark, sf))


@query("SELECT corpus, count(*) AS n, count(text) AS n_text FROM (SELECT * FROM tablet_lines WHERE corpus = 'complete' UNION ALL SELECT * FROM tablet_lines WHERE corpus = 'broken') GROUP BY corpus")
def union_corpora(spark, sf):
    t = table(spark, sf, "tablet_lines")
    return t.where("corpus = 'complete'").unionByName(t.where("corpus = 'broken'")).groupBy("corpus").agg(F.count("*").alias("n"), F.count("text").alias("n_text"))


# --- text functions --------------------------------------------------------------------------------------------------


@query(f"SELECT doc_id, trim(regexp_replace(text, '{SPACE}', ' ', 'g')) AS text FROM documents")
def normalize_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.normalize_text(F.col("text")).alias("text"))


@query("SELECT line_id, translate(text, '!*?()', '') AS text FROM tablet_lines")
def clean_text(spark, sf):
    return table(spark, sf, "tablet_lines").select("line_id", text.clean_text(F.col("text")).alias("text"))


@query("SELECT line_id, translate(text, 'abcdefgV', '') AS text FROM tablet_lines")
def strip_noag(spark, sf):
    return table(spark, sf, "tablet_lines").select("line_id", text.strip_allographs(F.col("text")).alias("text"))


# --- tokens ----------------------------------------------------------------------------------------------------------

SIGN, MARK, LIG = "[0-9]+[A-Za-z]*", "[0-9]+[A-Za-z]*|[-.:]", "[0-9]+[A-Za-z]*(?:[.:][0-9]+[A-Za-z]*)*"


def sql_pad(x: str) -> str:
    return f"CASE WHEN length({x}) < 3 THEN lpad({x}, 3, '0') ELSE {x} END"


def sql_pad_numbers(x: str) -> str:
    return f"array_to_string(list_transform(regexp_extract_all({x}, '[0-9]+|[^0-9]+'), lambda r: CASE WHEN regexp_full_match(r, '[0-9]{{1,2}}') THEN lpad(r, 3, '0') ELSE r END), '')"


def sql_suffix(x: str) -> str:
    base = f"regexp_replace({x}, '[A-Za-z]', '', 'g')"
    return f"list_concat(CASE WHEN {base} <> '' THEN [{sql_pad_numbers(base)}] ELSE [] END, regexp_extract_all({x}, '[A-Za-z]'))"


def sql_each(pattern: str, of: str, source: str = "c") -> str:
    return f"list_transform(regexp_extract_all({source}, '{pattern}'), lambda t: {of})"


PLAIN = "translate(c, 'abcdefgV', '')"
MODIFIERS = "array_to_string(regexp_extract_all(lower(t), '[h-uw-z]'), ',')"
VARIANT = "regexp_replace(lower(t), '[^a-g]', '', 'g')"
KEY = f"{sql_pad(chr(40) + 'regexp_extract(t, ' + repr('[0-9]+') + ')' + chr(41))} || CASE WHEN {VARIANT} = '' AND {MODIFIERS} = '' THEN '' ELSE ':' || {VARIANT} || CASE WHEN {MODIFIERS} = '' THEN '' ELSE '+' || {MODIFIERS} END END"
SQL_TOKENS = {
    "barthel": sql_each(SIGN, sql_pad_numbers("t")),
    "barthel_separators": sql_each(MARK, sql_pad_numbers("t")),
    "barthel_ligatures": sql_each(LIG, sql_pad_numbers("t")),
    "barthel_noag": sql_each(SIGN, sql_pad_numbers("t"), PLAIN),
    "barthel_separators_noag": sql_each(MARK, sql_pad_numbers("t"), PLAIN),
    "barthel_ligatures_noag": sql_each(LIG, sql_pad_numbers("t"), PLAIN),
    "suffix": f"flatten({sql_each(SIGN, sql_suffix('t'))})",
    "suffix_separators": f"flatten({sql_each(MARK, sql_suffix('t'))})",
    "suffix_ligatures": f"flatten({sql_each(LIG, sql_suffix('t'))})",
    "suffix_noag": f"flatten({sql_each(SIGN, sql_suffix('t'), PLAIN)})",
    "simple": sql_each("[0-9]+", sql_pad("t")),
    "simple_separators": f"list_filter({sql_each(MARK, 'CASE WHEN t IN (' + repr('-')[0:] + ', ' + repr('.') + ', ' + repr(':') + ') THEN t ELSE ' + sql_pad_numbers('regexp_extract(t, ' + repr('[0-9]+') + ')') + ' END')}, lambda t: t <> '-')",
    "simple_ligatures": sql_each(LIG, sql_pad_numbers("regexp_replace(t, '[A-Za-z]+', '', 'g')")),
    "glyph_variants": f"list_transform(flatten({sql_each(LIG, 'list_filter(regexp_split_to_array(t, ' + repr('[.:]') + '), lambda p: p <> ' + repr('') + ')')}), lambda t: {KEY})",
    "normalized_text": r"CASE WHEN c IS NULL THEN [] ELSE [trim(regexp_replace(c, '\s+', ' ', 'g'))] END",
    "characters": r"list_filter(regexp_extract_all(trim(regexp_replace(c, '\s+', ' ', 'g')), '.'), lambda t: t <> '')",
}


def sql_tokens(strategy: str, name: str = "toks") -> str:
    """One row for each token: line_id, pos, token."""
    return f"""{LINES},
listed_{name} AS (SELECT line_id, coalesce({SQL_TOKENS[strategy]}, []) AS tokens FROM (SELECT line_id, translate(text, '!*?()', '') AS c FROM lines)),
{name} AS (SELECT line_id, CAST(unnest(range(len(tokens))) AS INTEGER) AS pos, unnest(tokens) AS token FROM listed_{name})"""


def tokens(spark: SparkSession, sf: str, strategy: str) -> DataFrame:
    return tokenize(lines(spark, sf), strategy)


def add_strategy(strategy: str) -> None:
    FOUND[f"tok_{strategy}"] = lambda spark, sf: exploded(tokens(spark, sf, strategy), "line_id")
    SQL[f"tok_{strategy}"] = f"WITH {sql_tokens(strategy)} SELECT line_id, pos, token FROM toks"


for _strategy in STRATEGIES:
    add_strategy(_strategy)


@query(f"WITH {sql_tokens('glyph_variants')} SELECT token AS key, count(*) AS n FROM toks GROUP BY token")
def glyph_variant_keys(spark, sf):
    return exploded(tokens(spark, sf, "glyph_variants")).groupBy(F.col("token").alias("key")).agg(F.count("*").alias("n"))


STRUCT_KEY = "g || CASE WHEN v = '' AND m = '' THEN '' ELSE ':' || v || CASE WHEN m = '' THEN '' ELSE '+' || m END END"


@query(f"WITH k AS (SELECT glyph AS g, coalesce(variant, '') AS v, coalesce(array_to_string(modifiers, ','), '') AS m FROM glyph_tokens WHERE glyph IS NOT NULL) SELECT {STRUCT_KEY} AS key, count(*) AS n FROM k GROUP BY 1")
def struct_keys(spark, sf):
    """The keys of the structs as they were delivered."""
    t = table(spark, sf, "glyph_tokens").where("glyph IS NOT NULL")
    return t.select(text.variant_key(F.struct("glyph", "variant", "modifiers")).alias("key")).groupBy("key").agg(F.count("*").alias("n"))


@query(f"WITH {sql_tokens('glyph_variants')} SELECT token AS key, split_part(token, ':', 1) AS glyph, split_part(split_part(token, ':', 2), '+', 1) AS variant, split_part(split_part(token, ':', 2), '+', 2) AS modifiers, token AS again FROM toks GROUP BY token")
def glyph_variant_roundtrip(spark, sf):
    keys = exploded(tokens(spark, sf, "glyph_variants")).select(F.col("token").alias("key")).distinct().withColumn("t", text.parse_variant_key(F.col("key")))
    return keys.select("key", "t.glyph", "t.variant", F.array_join("t.modifiers", ",").alias("modifiers"), text.variant_key(F.col("t")).alias("again"))


@query(f"WITH {sql_tokens('barthel')} SELECT token, CAST(row_number() OVER (ORDER BY token) - 1 AS INTEGER) AS idx FROM (SELECT DISTINCT token FROM toks)")
def vocab_index(spark, sf):
    return cooc.vocabulary(tokens(spark, sf, "barthel"))


@query(f"WITH {sql_tokens('characters')} SELECT line_id, count(*) FILTER (WHERE trim(token) <> '') AS n_tokens FROM toks GROUP BY line_id")
def load_sequences_filter(spark, sf):
    return sequences(tokens(spark, sf, "characters")).select("line_id", F.size("tokens").cast("long").alias("n_tokens"))


# --- co-occurrence ---------------------------------------------------------------------------------------------------


def sql_pairs(strategy: str, window: int, masked: bool) -> str:
    mask = "AND a.token NOT IN ('-', '.', ':') AND b.token NOT IN ('-', '.', ':')" if masked else ""
    return f"""WITH {sql_tokens(strategy)},
pairs AS (SELECT a.line_id, a.token AS center, b.token AS context FROM toks a JOIN toks b ON a.line_id = b.line_id AND a.pos <> b.pos AND abs(a.pos - b.pos) <= {window} {mask})"""


@query(sql_pairs("simple", 4, False) + " SELECT center, context, count(*) AS n FROM pairs GROUP BY ALL")
def context_pairs(spark, sf):
    return cooc.pair_counts(tokens(spark, sf, "simple"), 4, mask=False)


@query(sql_pairs("barthel_separators", 4, True) + " SELECT center, context, count(*) AS n FROM pairs GROUP BY ALL")
def context_pairs_masked(spark, sf):
    return cooc.pair_counts(tokens(spark, sf, "barthel_separators"), 4)


@query("""WITH toks AS (SELECT user_id, event_type AS token, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM events)
SELECT a.token AS center, b.token AS context, count(*) AS n FROM toks a JOIN toks b ON a.user_id = b.user_id AND a.pos <> b.pos AND abs(a.pos - b.pos) <= 2 GROUP BY ALL""")
def context_pairs_events(spark, sf):
    """Kinds of events within two places of each other in a user's order. Windows over sorted rows, so that no user's events are collected."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    ahead = table(spark, sf, "events").select(F.col("event_type").alias("a"), *(F.lead("event_type", k).over(w).alias(f"b{k}") for k in (1, 2)))
    near = ahead.select("a", F.explode(F.array("b1", "b2")).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    counts = near.groupBy("a", "b").agg(F.count("*").alias("n"))
    both = counts.select(F.explode(F.array(F.struct(F.col("a").alias("center"), F.col("b").alias("context")), F.struct(F.col("b").alias("center"), F.col("a").alias("context")))).alias("p"), "n")
    return both.groupBy("p.center", "p.context").agg(F.sum("n").alias("n"))


@query(sql_pairs("simple", 4, False) + " SELECT center, context, count(*) AS n FROM pairs GROUP BY ALL ORDER BY n DESC, center, context LIMIT 50")
def cooc_top_pairs(spark, sf):
    return context_pairs(spark, sf).orderBy(F.col("n").desc(), "center", "context").limit(50)


@query(f"""WITH {sql_tokens('simple')}, vocab AS (SELECT token, CAST(row_number() OVER (ORDER BY token) - 1 AS INTEGER) AS idx FROM (SELECT DISTINCT token FROM toks)),
wanted AS (SELECT DISTINCT regexp_extract(glyph, '[0-9]+') AS token FROM glyph_tokens WHERE glyph IS NOT NULL)
SELECT w.token, coalesce(x.idx, p.idx, -1) AS idx FROM wanted w LEFT JOIN vocab x ON x.token = w.token LEFT JOIN vocab p ON p.token = {sql_pad('w.token')}""")
def anchor_resolve(spark, sf):
    wanted = table(spark, sf, "glyph_tokens").where("glyph IS NOT NULL").select(F.regexp_extract("glyph", "[0-9]+", 0).alias("token")).distinct()
    return cooc.resolve_tokens(wanted, stage(cooc.vocabulary(tokens(spark, sf, "simple")), "vocab")).withColumn("idx", F.coalesce("idx", F.lit(-1)))


@query(f"""WITH {sql_tokens('glyph_variants')}, wanted AS (SELECT DISTINCT regexp_extract(glyph, '[0-9]+') AS token FROM glyph_tokens WHERE glyph IS NOT NULL),
keys AS (SELECT split_part(token, ':', 1) AS g, min(token) AS key FROM toks GROUP BY 1)
SELECT token, key FROM wanted LEFT JOIN keys ON g = {sql_pad('token')}""")
def anchor_resolve_variants(spark, sf):
    wanted = table(spark, sf, "glyph_tokens").where("glyph IS NOT NULL").select(F.regexp_extract("glyph", "[0-9]+", 0).alias("token")).distinct()
    return cooc.resolve_variants(wanted, exploded(tokens(spark, sf, "glyph_variants")).select("token").distinct())


@query(f"""WITH {sql_tokens('simple')}, wanted AS (SELECT DISTINCT regexp_extract(glyph, '[0-9]+') AS token FROM glyph_tokens WHERE glyph IS NOT NULL)
SELECT token FROM wanted WHERE token NOT IN (SELECT token FROM toks) AND {sql_pad('token')} NOT IN (SELECT token FROM toks)""")
def anchor_misses(spark, sf):
    """The signs of the token records that the lines don't have."""
    wanted = table(spark, sf, "glyph_tokens").where("glyph IS NOT NULL").select(F.regexp_extract("glyph", "[0-9]+", 0).alias("token")).distinct()
    return cooc.missing_tokens(wanted, stage(cooc.vocabulary(tokens(spark, sf, "simple")), "vocab"))


@query(f"""WITH {sql_tokens('glyph_variants')}, vocab AS (SELECT token AS key, CAST(row_number() OVER (ORDER BY token) - 1 AS INTEGER) AS idx FROM (SELECT DISTINCT token FROM toks)),
wanted AS (SELECT DISTINCT regexp_extract(glyph, '[0-9]+') AS token FROM glyph_tokens WHERE glyph IS NOT NULL), keys AS (SELECT split_part(key, ':', 1) AS g, min(key) AS key FROM vocab GROUP BY 1)
SELECT w.token, k.key, v.idx FROM wanted w LEFT JOIN keys k ON g = {sql_pad('w.token')} LEFT JOIN vocab v ON v.key = k.key""")
def anchor_variant_index(spark, sf):
    wanted = table(spark, sf, "glyph_tokens").where("glyph IS NOT NULL").select(F.regexp_extract("glyph", "[0-9]+", 0).alias("token")).distinct()
    return cooc.variant_index(wanted, stage(cooc.vocabulary(tokens(spark, sf, "glyph_variants")), "vocab"))


# --- vectors ---------------------------------------------------------------------------------------------------------

UNIT = """unit AS (SELECT vec_id, label, list_transform(d, lambda x: x / greatest(sqrt(list_sum(list_transform(d, lambda y: y * y))), 1e-8)) AS v
FROM (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS d FROM embeddings WHERE embedding IS NOT NULL))"""


@query(f"WITH {UNIT} SELECT vec_id, round(v[1], 6) AS first, round(v[64], 6) AS last, round(list_sum(list_transform(v, lambda x: x * x)), 6) AS length FROM unit")
def vec_normalize(spark, sf):
    v = table(spark, sf, "embeddings").where("embedding IS NOT NULL").select("vec_id", normalize(F.col("embedding")).alias("v"))
    return v.select("vec_id", F.round(F.get("v", F.lit(0)), 6).alias("first"), F.round(F.get("v", F.lit(63)), 6).alias("last"), F.round(norm(F.col("v")), 6).alias("length"))


@query(f"WITH {UNIT} SELECT a.vec_id, b.vec_id AS other, round(list_dot_product(a.v, b.v), 6) AS cosine FROM unit a JOIN unit b ON b.vec_id = a.vec_id + 1")
def vec_cosine_pairs(spark, sf):
    """Each vector with the next one by id."""
    v = table(spark, sf, "embeddings").where("embedding IS NOT NULL").select("vec_id", normalize(F.col("embedding")).alias("v"))
    return v.join(v.select(F.col("vec_id").alias("other"), (F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w")), "vec_id").select("vec_id", "other", F.round(dot(F.col("v"), F.col("w")), 6).alias("cosine"))


@query(f"WITH {UNIT}, top AS (SELECT * FROM unit ORDER BY vec_id LIMIT 120) SELECT a.vec_id AS row, b.vec_id AS col, round(round(list_dot_product(a.v, b.v), 9), 6) AS cosine FROM top a, top b")
def gram_topleft(spark, sf):
    """The corner that a heat map labels: the limit is the feature."""
    return neighbors.gram(table(spark, sf, "embeddings"), 120).withColumn("cosine", F.round("cosine", 6))


MEANS = """means AS (SELECT label, list(m ORDER BY i) AS mean FROM (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(range(len(embedding))) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings WHERE embedding IS NOT NULL) GROUP BY label, i) GROUP BY label)"""


@query(f"WITH {MEANS} SELECT label, len(mean) AS dims, round(mean[1], 6) AS first, round(list_sum(mean), 6) AS total FROM means")
def mean_embedding(spark, sf):
    m = neighbors.mean_vectors(table(spark, sf, "embeddings"), "label")
    return m.select("label", F.size("mean").cast("long").alias("dims"), F.round(F.get("mean", F.lit(0)), 6).alias("first"), F.round(F.aggregate("mean", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@query(f"WITH {MEANS}, {UNIT} SELECT vec_id, e.label, round(list_dot_product(v, mean) / greatest(sqrt(list_dot_product(mean, mean)), 1e-8), 6) AS cosine FROM unit e JOIN means m ON m.label = e.label")
def gloss_embedding(spark, sf):
    """Each vector against the normalized mean of its label."""
    e = table(spark, sf, "embeddings").where("embedding IS NOT NULL")
    m = neighbors.mean_vectors(e, "label").select("label", normalize(F.col("mean")).alias("m"))
    return e.join(broadcast_below(stage(m, "means"), 10_000), "label").select("vec_id", "label", F.round(dot(normalize(F.col("embedding")), F.col("m")), 6).alias("cosine"))


NEAREST = f"""{UNIT},
near AS (SELECT q.vec_id AS query, p.vec_id AS neighbor, p.label, round(list_dot_product(q.v, p.v), 9) AS cosine FROM unit q JOIN unit p ON p.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY cosine DESC, neighbor) AS INTEGER) AS rank FROM near)"""


def nearest(spark: SparkSession, sf: str, k: int) -> DataFrame:
    e = table(spark, sf, "embeddings")
    return neighbors.nearest(e.where("vec_id % 100 = 0"), e, k)


@query(f"WITH {NEAREST} SELECT query, rank, neighbor, round(cosine, 6) AS cosine FROM ranked WHERE rank <= 12")
def knn_topk(spark, sf):
    return nearest(spark, sf, 12).withColumn("cosine", F.round("cosine", 6))


@query(f"WITH {NEAREST} SELECT a.query, a.neighbor AS word, round(a.cosine, 6) AS cosine, round(a.cosine - b.cosine, 6) AS margin FROM ranked a LEFT JOIN ranked b ON b.query = a.query AND b.rank = 2 WHERE a.rank = 1")
def knn_margin(spark, sf):
    m = neighbors.margins(nearest(spark, sf, 2).withColumnRenamed("neighbor", "word"), "query")
    return m.select("query", "word", F.round("cosine", 6).alias("cosine"), F.round("margin", 6).alias("margin"))


WORDS = r"words AS (SELECT word, CAST(row_number() OVER (ORDER BY word) - 1 AS INTEGER) AS idx FROM (SELECT DISTINCT unnest(regexp_extract_all(text, '[\p{L}\p{M}]+')) AS word FROM documents))"


def words(spark: SparkSession, sf: str) -> DataFrame:
    """The different words of all documents, of letters of any script, numbered in their order."""
    found = table(spark, sf, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{M}]+"), 0)).alias("word")).distinct()
    return numbered(found, "word", column="idx").withColumn("idx", F.col("idx").cast("int"))


@query(f"WITH {WORDS} SELECT idx, word FROM words WHERE regexp_full_match(word, '[a-z]+') AND length(word) >= 3 ORDER BY idx LIMIT 5000")
def word_pool_v1(spark, sf):
    """The pool of a search: its size is a parameter of the search."""
    return neighbors.word_pool(words(spark, sf), 5000, lower=False)


POOL = f"""WITH {WORDS}, pool AS (SELECT lower(word) AS word, min(idx) AS idx FROM words WHERE length(word) >= 3 AND regexp_full_match(lower(word), '[a-z]+') GROUP BY 1 ORDER BY idx LIMIT 5000),
extras AS (SELECT DISTINCT word FROM (SELECT lower(trim(subject)) AS word FROM subject_examples WHERE subject IS NOT NULL UNION ALL SELECT lower(n_name) FROM nation) WHERE regexp_full_match(word, '[a-z]+') AND word NOT IN (SELECT word FROM pool))"""


def pool_and_extras(spark: SparkSession, sf: str) -> DataFrame:
    named = table(spark, sf, "nation").select(F.lower("n_name").alias("word"))
    extras = table(spark, sf, "subject_examples").where("subject IS NOT NULL").select(F.lower(F.trim("subject")).alias("word")).unionByName(named)
    return stage(neighbors.with_extras(stage(neighbors.word_pool(words(spark, sf), 5000, lower=True), "pool"), extras), "pool")


@query(f"{POOL} SELECT idx, word FROM pool UNION ALL SELECT -1, word FROM extras")
def word_pool_v2(spark, sf):
    return pool_and_extras(spark, sf).withColumn("idx", F.coalesce("idx", F.lit(-1)))


VECTORS = "vecs AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE embedding IS NOT NULL), size AS (SELECT count(*) AS n_vec FROM vecs), parts AS (SELECT vec_id, unnest(range(len(v))) AS i, unnest(v) AS x FROM vecs)"


def letters(text: str, n_vec: int):
    """The numbers of the vectors that stand for the letters of a text, as a column to explode."""
    return F.explode(F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c) % n_vec))


@query(f"""{POOL}, {VECTORS},
summed AS (SELECT word, i, avg(x) AS x FROM (SELECT word, ascii(unnest(string_split(word, ''))) % n_vec AS piece FROM extras, size) JOIN parts ON vec_id = piece GROUP BY word, i),
every AS (SELECT word, list(x ORDER BY i) AS v FROM summed GROUP BY word UNION ALL SELECT word, v FROM pool JOIN vecs ON vec_id = idx)
SELECT word, round(v[1], 6) AS first, round(list_sum(v), 6) AS total FROM every""")
def pool_vectors(spark, sf):
    """The vectors of a pool's words that have one, and those of the extra words, as means of their letters' vectors."""
    pool, e = pool_and_extras(spark, sf), table(spark, sf, "embeddings")
    pieces = pool.where("idx IS NULL").select("word", letters("word", e.where("embedding IS NOT NULL").count()).alias("piece"))
    v = neighbors.pool_vectors(pool, e, pieces)
    return v.select("word", F.round(F.get("vector", F.lit(0)), 6).alias("first"), F.round(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


# --- trials, quality and consensus -----------------------------------------------------------------------------------

RECORDS = """
records AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY trial_id ORDER BY logged_at DESC NULLS LAST, score DESC NULLS LAST) AS k FROM trial_records
            WHERE trial_id IS NOT NULL AND (error IS NULL OR trim(error) = '')) WHERE k = 1),
named AS (SELECT trial_id, score, row_number() OVER (ORDER BY trial_id) - 1 AS idx FROM records)"""


def sql_listed(strategy: str) -> str:
    return f"SELECT '{strategy}' AS strategy, rid, coalesce({SQL_TOKENS[strategy]}, []) AS tokens FROM cleaned WHERE '{strategy}' IN (SELECT strategy FROM own)"


#: Every trial with a good record over all lines, by its own strategy and window.
NEIGHBORS = f"""WITH {LINES}, {RECORDS}, {VECTORS},
own AS (SELECT trial_id, strategy, context_window FROM (SELECT *, row_number() OVER (PARTITION BY trial_id ORDER BY strategy, context_window) AS k FROM trial_configs WHERE context_window >= 1 AND strategy IN {tuple(STRATEGIES)}) WHERE k = 1 AND trial_id IN (SELECT trial_id FROM records)),
cleaned AS (SELECT row_number() OVER () AS rid, translate(text, '!*?()', '') AS c FROM lines),
listed AS ({" UNION ALL ".join(map(sql_listed, STRATEGIES))}),
toks AS (SELECT strategy, rid, unnest(range(len(tokens))) AS pos, unnest(tokens) AS token FROM listed),
signs AS (SELECT * FROM toks WHERE token NOT IN ('-', '.', ':')),
near_by AS (SELECT a.strategy, abs(a.pos - b.pos) AS far, a.token AS center, b.token AS context, count(*) AS n FROM signs a JOIN signs b ON a.strategy = b.strategy AND a.rid = b.rid AND a.pos <> b.pos AND abs(a.pos - b.pos) <= (SELECT max(context_window) FROM own) GROUP BY ALL),
counts AS (SELECT trial_id, center, context, sum(n) AS n FROM near_by p JOIN own o ON o.strategy = p.strategy AND far <= context_window GROUP BY ALL),
sums AS (SELECT trial_id, center AS token, sum(n) AS t FROM counts GROUP BY ALL),
near AS (SELECT c.trial_id, center AS token, context AS word, round(n / sqrt(CAST(a.t AS DOUBLE) * b.t), 9) AS cosine FROM counts c JOIN sums a ON a.trial_id = c.trial_id AND a.token = center JOIN sums b ON b.trial_id = c.trial_id AND b.token = context WHERE center <> context),
neighbors AS (SELECT *, row_number() OVER (PARTITION BY trial_id, token ORDER BY cosine DESC, word) AS rank FROM near),
tops AS (SELECT trial_id, token, max(word) FILTER (WHERE rank = 1) AS word, max(cosine) FILTER (WHERE rank = 1) AS cosine, max(cosine) FILTER (WHERE rank = 1) - max(cosine) FILTER (WHERE rank = 2) AS margin FROM neighbors WHERE rank <= 2 GROUP BY ALL),
kinds AS (SELECT trial_id, count(*) AS unique_top1_count, -sum(p * log2(p)) AS top1_entropy_bits FROM (SELECT trial_id, word, n / sum(n) OVER (PARTITION BY trial_id) AS p FROM (SELECT trial_id, word, count(*) AS n FROM tops GROUP BY trial_id, word)) GROUP BY trial_id),
quality AS (SELECT trial_id, count(*) AS token_count, any_value(unique_top1_count) AS unique_top1_count, any_value(top1_entropy_bits) AS top1_entropy_bits, avg(cosine) AS top1_mean_cosine, stddev_pop(cosine) AS top1_std_cosine, min(cosine) AS top1_min_cosine, max(cosine) AS top1_max_cosine, avg(margin) AS top1_top2_margin_mean, coalesce(stddev_pop(margin), 0) AS top1_top2_margin_std FROM tops JOIN kinds USING (trial_id) GROUP BY trial_id),
anchors AS (SELECT unnest({list(ANCHORS)}) AS token, unnest(range({len(ANCHORS)})) AS k),
expected AS (SELECT token, word FROM (SELECT token, word, row_number() OVER (PARTITION BY token ORDER BY s DESC, word) AS k FROM (SELECT center AS token, context AS word, sum(n) AS s FROM counts WHERE center IN (SELECT token FROM anchors) AND center <> context GROUP BY center, context)) WHERE k <= 5),
rates AS (SELECT trial_id, avg(CASE WHEN e.word IS NULL THEN 0 ELSE 1 END) AS anchor_hit_rate FROM tops t LEFT JOIN expected e ON e.token = t.token AND e.word = t.word WHERE t.token IN (SELECT token FROM expected) GROUP BY trial_id),
gloss_texts AS (SELECT token, text, i, avg(x) AS x FROM (SELECT a.token, lower(n_name) AS text, ascii(unnest(string_split(lower(n_name), ''))) % n_vec AS piece FROM nation JOIN anchors a ON a.k = n_regionkey, size) JOIN parts ON vec_id = piece GROUP BY ALL),
glosses AS (SELECT token, list(x ORDER BY i) AS g FROM (SELECT token, i, avg(x) AS x FROM gloss_texts GROUP BY ALL) GROUP BY token),
placed_at AS (SELECT trial_id, center AS token, n, CAST(nullif(regexp_extract(context, '[0-9]+'), '') AS DECIMAL(38, 0)) % n_vec AS piece FROM counts, size WHERE center IN (SELECT token FROM anchors)),
projected AS (SELECT trial_id, token, list(x ORDER BY i) AS p FROM (SELECT trial_id, token, i, sum(n * x) AS x FROM placed_at JOIN parts ON vec_id = piece GROUP BY ALL) GROUP BY ALL),
tests AS (SELECT trial_id, token, list_dot_product(p, g) / greatest(sqrt(list_dot_product(p, p)), 1e-8) / greatest(sqrt(list_dot_product(g, g)), 1e-8) AS cosine FROM projected JOIN glosses USING (token))"""


class Trials:
    """What the trial queries share, over all lines: each trial with a good record by its own strategy and window.

    Neighbours are found once for each different strategy and window, and a join gives them to every trial with these;
    strategies take their turns, and what one has staged goes before the next begins. A null window, one below 1 or an unknown strategy leaves a trial without pairs.
    """

    def __init__(self, spark: SparkSession, sf: str):
        self.spark, self.sf = spark, sf
        self.records = ln.last_records(table(spark, sf, "trial_records")).select("trial_id", "score")
        setting = F.min(F.struct("strategy", "context_window")).alias("s")
        configs = table(spark, sf, "trial_configs").where("context_window >= 1").where(F.col("strategy").isin(*STRATEGIES)).groupBy("trial_id").agg(setting).select("trial_id", "s.strategy", "s.context_window")
        self.own = stage(configs.join(self.records, "trial_id", "left_semi"), "settings")
        settings = self.own.select("strategy", "context_window").distinct().limit(1001).collect()
        if len(settings) > 1000:
            raise ValueError("more than 1000 different settings")
        found = stage(lines(spark, sf).select("text"), "lines", release=True)
        firsts, anchored = [], []
        for strategy in sorted({r.strategy for r in settings}):
            first, some = self.neighbors(tokenize(found, strategy), strategy, sorted({r.context_window for r in settings if r.strategy == strategy}))
            firsts += first
            anchored.append(some)
        drop(spark, found)
        none = lambda schema: spark.createDataFrame([], schema)
        #: strategy, context_window, token, word, cosine and margin of each token's first neighbour: once for all trials with a setting.
        self.ranked = together(*firsts) if firsts else none("context_window int, token string, word string, cosine double, margin double, strategy string")
        #: strategy, context_window, center, context and n of the pairs whose center is an anchor.
        self.anchored = together(*anchored) if anchored else none("center string, context string, context_window int, n long, strategy string")

    def neighbors(self, tokenized: DataFrame, strategy: str, windows: list[int]) -> tuple[list[DataFrame], DataFrame]:
        """The first neighbours, and the counts of the anchors' pairs, in each window; a vocabulary that is too large to be sent to the tasks is joined instead."""
        named = F.lit(strategy)
        space = tops.Space(tokenized, windows)
        if space.fits:
            some = stage(space.counts_of(list(ANCHORS)).withColumn("strategy", named), "anchor-pairs", release=True)
            first = space.firsts(strategy=named)
            space.drop()
            return first, some
        half = stage(cooc.pair_counts_by_window(tokenized, windows).withColumnRenamed("window", "context_window"), "setting-pairs", release=True)
        near = neighbors.glyph_neighbors(half, 2, "context_window")
        first = stage(neighbors.margins(near, "context_window", "token").drop("second").select("context_window", "token", "word", "cosine", "margin", named.alias("strategy")), "tops", release=True)
        some = half.where(F.col("a").isin(*ANCHORS) | F.col("b").isin(*ANCHORS))
        some = stage(cooc.both_ways(some, "context_window").where(F.col("center").isin(*ANCHORS)).select("center", "context", "context_window", "n", named.alias("strategy")), "anchor-pairs", release=True)
        drop(self.spark, half)
        return [first], some

    def by_trial(self, df: DataFrame) -> DataFrame:
        return df.join(broadcast_below(self.own, 10_000), ["strategy", "context_window"]).drop("strategy", "context_window")

    def tops(self) -> DataFrame:
        """trial_id, token, word, cosine and margin of each token's first neighbour in each trial."""
        return self.by_trial(self.ranked)

    def qualities(self) -> DataFrame:
        """What neighbors.quality() says of each trial, worked out once for each setting."""
        return self.by_trial(neighbors.quality(self.ranked, "strategy", "context_window"))

    def anchor_rates(self) -> DataFrame:
        """trial_id and anchor_hit_rate, from the anchors' first neighbours alone."""
        return neighbors.anchor_rates(self.tops().where(F.col("token").isin(*ANCHORS)), self.expected(), "trial_id")

    def expected(self) -> DataFrame:
        """token and word: the five most frequent neighbours of each anchor in all trials together; a setting's counts are taken as often as trials have it."""
        times = self.own.groupBy("strategy", "context_window").agg(F.count("*").alias("times"))
        sums = self.anchored.where("center <> context").join(F.broadcast(times), ["strategy", "context_window"]).groupBy("center", "context").agg(F.sum(F.col("n") * F.col("times")).alias("n"))
        w = Window.partitionBy("center").orderBy(F.col("n").desc(), "context")
        return sums.withColumn("k", F.row_number().over(w)).where("k <= 5").select(F.col("center").alias("token"), F.col("context").alias("word"))

    def anchor_cosines(self) -> DataFrame:
        """trial_id, token and cosine: each anchor's projection into the space of the vectors, by the counts of its neighbours, with its glosses.

        No table has glosses or a trial's projection: the k-th anchor's glosses are the names of the nations of region k, made of their
        letters' vectors, and a neighbour stands where the vector with its number does. Worked out once for each setting; counts are added up by
        vector before they meet its dimensions.
        """
        e = table(self.spark, self.sf, "embeddings").where("embedding IS NOT NULL")
        n_vec = e.count()
        named = self.spark.createDataFrame([(a, k) for k, a in enumerate(ANCHORS)], "token string, n_regionkey int")
        texts = table(self.spark, self.sf, "nation").join(F.broadcast(named), "n_regionkey").select("token", F.lower("n_name").alias("text"))
        glosses = neighbors.gloss_vectors(neighbors.text_vectors(texts.select("token", "text", letters("text", n_vec).alias("piece")), e, "token", "text"), "token")
        at = F.nullif(F.regexp_extract("context", "[0-9]+", 0), F.lit("")).cast("decimal(38,0)") % n_vec
        vectors = e.select(F.col("vec_id").alias("at"), F.posexplode("embedding").alias("i", "x"))
        setting = ["strategy", "context_window"]
        placed = self.anchored.select(*setting, F.col("center").alias("token"), "n", at.cast("long").alias("at")).where("at IS NOT NULL").groupBy(*setting, "token", "at").agg(F.sum("n").alias("n"))
        sums = placed.join(vectors, "at").groupBy(*setting, "token", "i").agg(F.sum(F.col("n") * F.col("x").cast("double")).alias("x"))
        projected = sums.groupBy(*setting, "token").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("vector"))
        return self.by_trial(neighbors.anchor_cosines(projected, glosses, *setting))



def rounded(df: DataFrame, *but: str) -> DataFrame:
    return df.select(*(F.round(c, 6).alias(c) if t == "double" and c not in but else F.col(c) for c, t in df.dtypes))


@query(NEIGHBORS + " SELECT trial_id, token_count, unique_top1_count, round(top1_entropy_bits, 6) AS top1_entropy_bits, round(top1_mean_cosine, 6) AS top1_mean_cosine, round(top1_std_cosine, 6) AS top1_std_cosine, round(top1_min_cosine, 6) AS top1_min_cosine, round(top1_max_cosine, 6) AS top1_max_cosine, round(top1_top2_margin_mean, 6) AS top1_top2_margin_mean, round(top1_top2_margin_std, 6) AS top1_top2_margin_std FROM quality")
def neighbor_quality(spark, sf):
    return rounded(Trials(spark, sf).qualities())


def anchors(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(a,) for a in ANCHORS], "token string")


@query(NEIGHBORS + " SELECT trial_id, round(anchor_hit_rate, 6) AS anchor_hit_rate FROM rates")
def anchor_hit_rate(spark, sf):
    return rounded(Trials(spark, sf).anchor_rates())


@query(NEIGHBORS + " SELECT trial_id, token, round(cosine, 6) AS cosine FROM tests")
def anchor_gloss_cosine(spark, sf):
    return rounded(Trials(spark, sf).anchor_cosines())


@query(NEIGHBORS + """ SELECT trial_id, round(3 * c + 2 * h + 1.2 * least(u / 80, 1.5) + 0.6 * least(b / 4, 1) + 0.4 * m - CASE WHEN c < 0 THEN 2.5 ELSE 0 END - CASE WHEN u <= 5 THEN 1.5 ELSE 0 END - CASE WHEN h < 0.5 THEN 1 ELSE 0 END, 6) AS score
FROM (SELECT q.trial_id, coalesce(anchor_cosine, -1) AS c, coalesce(anchor_hit_rate, 0) AS h, unique_top1_count AS u, top1_entropy_bits AS b, top1_top2_margin_mean AS m FROM quality q LEFT JOIN rates USING (trial_id) LEFT JOIN (SELECT trial_id, avg(cosine) AS anchor_cosine FROM tests GROUP BY trial_id) USING (trial_id))""")
def trial_score(spark, sf):
    t = Trials(spark, sf)
    rates = t.anchor_rates()
    cosines = t.anchor_cosines().groupBy("trial_id").agg(F.avg("cosine").alias("c"))
    q = t.qualities().join(rates, "trial_id", "left").join(cosines, "trial_id", "left")
    score = neighbors.trial_score(F.col("c"), F.coalesce("anchor_hit_rate", F.lit(0.0)), F.col("unique_top1_count"), F.col("top1_entropy_bits"), F.col("top1_top2_margin_mean"))
    return q.select("trial_id", F.round(score, 6).alias("score"))


PASSING = "used AS (SELECT q.trial_id FROM quality q LEFT JOIN named n USING (trial_id) WHERE coalesce(score, -999) >= 0 AND unique_top1_count >= 50 AND top1_entropy_bits >= 3)"
VOTES = NEIGHBORS + f""", {PASSING},
open_ AS (SELECT trial_id, token, lower(word) AS word, cosine, margin FROM tops WHERE token NOT IN (SELECT token FROM anchors) AND trial_id IN (SELECT trial_id FROM used)),
leaks AS (SELECT DISTINCT lower(word) AS word FROM expected),
banned AS (SELECT trial_id, word FROM (SELECT *, sum(n) OVER (PARTITION BY trial_id) AS total FROM (SELECT trial_id, word, count(*) AS n FROM open_ GROUP BY trial_id, word)) WHERE n > greatest(1, ceil(0.002 * total))),
votes AS (SELECT trial_id, token, word, coalesce(margin, 0) AS margin, cosine FROM open_ o WHERE round(coalesce(margin, 0), 9) >= 0.01 AND word NOT IN (SELECT word FROM leaks) AND NOT EXISTS (FROM banned b WHERE b.trial_id = o.trial_id AND b.word = o.word)),
placed AS (SELECT *, row_number() OVER (PARTITION BY token ORDER BY trials DESC, first_seen, word) AS place FROM (SELECT token, word, count(*) AS trials, avg(margin) AS mean_margin, avg(cosine) AS mean_cosine, min(trial_id) AS first_seen FROM votes GROUP BY ALL))"""


SETTING = ("strategy", "context_window")


def cast_votes(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The votes and the words banned by setting, and the trials that take part with their settings. Trials of one setting have the same neighbours, so they vote alike."""
    t = Trials(spark, sf)
    used = stage(trials.passing(t.records, t.qualities(), 0.0, 50, 3.0).join(t.own, "trial_id"), "used", release=True)
    ranked = t.ranked.join(F.broadcast(used.select(*SETTING).distinct()), [*SETTING], "left_semi")
    cast = votes.votes(ranked, anchors(spark), stage(t.expected().select("word"), "leaks", release=True), 0.01, 0.002, *SETTING)
    return cast, votes.banned_words(ranked.join(F.broadcast(anchors(spark)), "token", "left_anti"), 0.002, *SETTING), used


def by_setting(cast: DataFrame, used: DataFrame) -> DataFrame:
    """The votes with times, the number of trials that a setting's vote stands for, and trial_id, the first of them."""
    of = used.groupBy(*SETTING).agg(F.count("*").alias("times"), F.min("trial_id").alias("trial_id"))
    return cast.join(F.broadcast(of), [*SETTING])


@query(NEIGHBORS + f", {PASSING} SELECT trial_id FROM used")
def quality_filter(spark, sf):
    t = Trials(spark, sf)
    return trials.passing(t.records, t.qualities(), 0.0, 50, 3.0)


@query(VOTES + " SELECT trial_id, word FROM banned")
def banned_words(spark, sf):
    _, banned, used = cast_votes(spark, sf)
    return banned.join(F.broadcast(used), [*SETTING]).select("trial_id", "word")


@query(VOTES + " SELECT trial_id, token, word, round(margin, 6) AS margin, round(cosine, 6) AS cosine FROM votes")
def consensus_votes(spark, sf):
    cast, _, used = cast_votes(spark, sf)
    return rounded(cast.join(F.broadcast(used), [*SETTING]).select("trial_id", "token", "word", "margin", "cosine"))


CONSENSUS = VOTES + """, need AS (SELECT greatest(2, ceil(0.35 * count(*))) AS required, count(*) AS n FROM used)
SELECT p.token, p.word, trials, CAST(required AS BIGINT) AS required, round(trials / n, 4) AS fraction, round(mean_margin, 4) AS mean_margin, round(mean_cosine, 4) AS mean_cosine, coalesce(alternates, '') AS alternates
FROM placed p LEFT JOIN (SELECT token, string_agg(word, ' ' ORDER BY place) AS alternates FROM placed WHERE place BETWEEN 2 AND 5 GROUP BY token) a ON a.token = p.token, need WHERE place = 1 AND trials >= required"""


@query(CONSENSUS)
def consensus_rank(spark, sf):
    cast, _, used = cast_votes(spark, sf)
    return votes.consensus(stage(by_setting(cast, used), "votes", release=True), used, 2, 0.35)


@query(f"SELECT * FROM ({CONSENSUS}) ORDER BY trials DESC, mean_margin DESC, mean_cosine DESC, token LIMIT 80")
def consensus_top(spark, sf):
    """The report: the 80 tokens that most trials agree on."""
    cast, _, used = cast_votes(spark, sf)
    return votes.consensus(stage(by_setting(cast, used), "votes", release=True), used, 2, 0.35, top=80)


@query(VOTES + " SELECT token, word, trials, CAST(place AS INTEGER) AS place FROM placed WHERE place <= 5")
def consensus_alternates(spark, sf):
    cast, _, used = cast_votes(spark, sf)
    return votes.ranked_votes(by_setting(cast, used)).where("place <= 5").select("token", "word", "trials", "place")


@query("SELECT trial_id, strategy, context_window FROM trial_configs WHERE trial_id NOT IN (SELECT trial_id FROM trial_records WHERE trial_id IS NOT NULL AND (error IS NULL OR trim(error) = ''))")
def resume_antijoin(spark, sf):
    """What a log of the good runs alone leaves to run: the trials that only failed."""
    good = table(spark, sf, "trial_records").where("error IS NULL OR trim(error) = ''")
    return trials.left_to_run(table(spark, sf, "trial_configs"), good).select("trial_id", "strategy", "context_window")


@query("""SELECT CAST(row_number() OVER (ORDER BY s DESC, logged_at NULLS LAST, trial_id) AS INTEGER) AS place, trial_id, s AS score
FROM (SELECT *, coalesce(score, -999) AS s FROM trial_records WHERE trial_id IS NOT NULL AND (error IS NULL OR trim(error) = '')) ORDER BY place LIMIT 5""")
def leaderboard_top5(spark, sf):
    return trials.leaderboard(table(spark, sf, "trial_records"), 5)


# --- answers of a scorer ---------------------------------------------------------------------------------------------

#: Answers in the shapes that a scorer gives, made of line items.
ANSWERS = """answers AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
CASE l_partkey % 3 WHEN 0 THEN 'score: 0.' || lpad(CAST(l_suppkey % 1000 AS VARCHAR), 3, '0') WHEN 1 THEN 'about 0.' || lpad(CAST(l_partkey % 1000 AS VARCHAR), 3, '0') || ' I think' ELSE 'no idea, 0.12' END AS raw,
'sign ' || lpad(CAST(l_partkey % 1000 AS VARCHAR), 3, '0') || ', 1234 of ' || CAST(l_linenumber AS VARCHAR) AS named FROM lineitem)"""


def answers(spark: SparkSession, sf: str) -> DataFrame:
    three = lambda c: F.lpad((F.col(c) % 1000).cast("string"), 3, "0")
    raw = F.when(F.col("l_partkey") % 3 == 0, F.concat(F.lit("score: 0."), three("l_suppkey"))).when(F.col("l_partkey") % 3 == 1, F.concat(F.lit("about 0."), three("l_partkey"), F.lit(" I think"))).otherwise("no idea, 0.12")
    named = F.concat(F.lit("sign "), three("l_partkey"), F.lit(", 1234 of "), F.col("l_linenumber").cast("string"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", raw.alias("raw"), named.alias("named"))


@query(f"WITH {ANSWERS} SELECT raw, nullif(regexp_extract(raw, '(^|[^0-9])(0\\.[0-9]{{3}})([^0-9]|$)', 2), '') AS score, count(*) AS n FROM answers GROUP BY ALL")
def parse_scores(spark, sf):
    return answers(spark, sf).select("raw", parsers.score(F.col("raw")).alias("score")).groupBy("raw", "score").agg(F.count("*").alias("n"))


@query("""SELECT l_orderkey, lpad(CAST(l_partkey % 1000 AS VARCHAR), 3, '0') AS label, '0.' || CAST(l_linenumber % 10 AS VARCHAR) || CAST(l_suppkey % 10 AS VARCHAR) || '5' AS score, count(*) AS n FROM lineitem GROUP BY ALL""")
def parse_batch_scores(spark, sf):
    """Each item as a line of a batch's answer, read again."""
    raw = F.concat(F.lit("some words\n"), F.lpad((F.col("l_partkey") % 1000).cast("string"), 3, "0"), F.lit(": overall="), (F.col("l_linenumber") % 10).cast("string"), F.lit(", structure="), (F.col("l_suppkey") % 10).cast("string"), F.lit(", shape=5"))
    read = table(spark, sf, "lineitem").select("l_orderkey", F.explode(parsers.batch_scores(raw)).alias("label", "score"))
    return read.groupBy("l_orderkey", "label", "score").agg(F.count("*").alias("n"))


@query("""SELECT l_orderkey, l_linenumber, lpad(CAST(l_partkey % 1000 AS VARCHAR), 3, '0') AS label, CASE WHEN l_suppkey % 3 = 0 THEN '0.' || lpad(CAST(l_partkey % 7 AS VARCHAR), 3, '0') ELSE '0.' || lpad(CAST(l_suppkey % 1000 AS VARCHAR), 3, '0') END AS score,
CASE WHEN l_partkey % 1000 = 999 THEN '' ELSE '999' END AS missing FROM lineitem""")
def parse_batch_wanted(spark, sf):
    """Answers with one or two lines for the wanted label (the last counts) and one for another, and which of two wanted ones have none."""
    three = lambda x: F.lpad(x.cast("string"), 3, "0")
    line = lambda label, score: F.concat(label, F.lit(": 0."), three(score), F.lit("\n"))
    label = three(F.col("l_partkey") % 1000)
    raw = F.concat(line(three(F.col("l_partkey") % 1000 + 1000), F.lit(1)), line(label, F.col("l_suppkey") % 1000), F.when(F.col("l_suppkey") % 3 == 0, line(label, F.col("l_partkey") % 7)).otherwise(""))
    wanted = F.array_distinct(F.array(label, F.lit("999")))
    read = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", label.alias("label"), wanted.alias("wanted"), parsers.batch_scores(raw, wanted).alias("scores"))
    return read.select("l_orderkey", "l_linenumber", "label", F.try_element_at("scores", F.col("label")).alias("score"), F.array_join(parsers.missing_labels(F.col("scores"), F.col("wanted")), ",").alias("missing"))


@query("""SELECT kind, label, alternates, reasoning, count(*) AS n FROM (SELECT CASE l_returnflag WHEN 'A' THEN 'ligature' WHEN 'R' THEN 'bad_crop' ELSE 'single' END AS kind,
CASE WHEN l_linenumber <= 3 THEN 'A' || l_linenumber WHEN l_linenumber = 4 THEN 'B1.A2' WHEN l_linestatus = 'F' THEN 'A2' WHEN l_linenumber = 5 THEN 'B2' ELSE 'A1' END AS label,
CASE WHEN l_linestatus = 'F' THEN 'A2.B1 B2' ELSE '' END AS alternates, 'It is ' || l_returnflag || chr(10) || 'and tall.' AS reasoning FROM lineitem) GROUP BY ALL""")
def parse_matches(spark, sf):
    """Answers that name a sign: by one label, two joined ones, one in the text only, or none that is known."""
    n = F.col("l_linenumber")
    kind = F.when(F.col("l_returnflag") == "A", "kind: Ligature").when(F.col("l_returnflag") == "R", " KIND : bad_crop ").otherwise("kind: round")
    other = F.when(F.col("l_linestatus") == "F", "alternates: a2+b1, x, B2, b2\nalternates: A3").otherwise("alternates: none")
    label = F.when(n <= 3, F.concat(F.lit("label: a"), n.cast("string"))).when(n == 4, "label: b1+A2").when(n == 5, "raw: B2, not B").otherwise("Label: C7")
    answer = F.concat_ws("\n", kind, other, F.concat(F.lit("reasoning: It is "), "l_returnflag"), F.lit("and tall."), label)
    m = table(spark, sf, "lineitem").select(answer.alias("answer")).select(parsers.match(F.col("answer"), ["A1", "A2", "A3", "B1", "B2"]).alias("m")).select("m.kind", "m.label", F.array_join("m.alternates", " ").alias("alternates"), "m.reasoning")
    return m.groupBy("kind", "label", "alternates", "reasoning").agg(F.count("*").alias("n"))


@query(f"WITH {ANSWERS} SELECT CASE WHEN l_partkey % 1000 <= 799 THEN lpad(CAST(l_partkey % 1000 AS VARCHAR), 3, '0') END AS label, count(*) AS n FROM answers GROUP BY 1")
def parse_labels(spark, sf):
    return answers(spark, sf).select(parsers.label(F.col("named")).alias("label")).groupBy("label").agg(F.count("*").alias("n"))


@query("SELECT o_orderpriority AS raw, CASE WHEN lower(split_part(o_orderpriority, '-', 2)) IN ('urgent', 'high', 'low') THEN upper(split_part(o_orderpriority, '-', 2)) END AS label, count(*) AS n FROM orders GROUP BY ALL")
def normalize_labels(spark, sf):
    found = parsers.known_label(F.regexp_replace("o_orderpriority", "^[0-9]+-", ""), ["URGENT", "HIGH", "LOW"])
    return table(spark, sf, "orders").select(F.col("o_orderpriority").alias("raw"), found.alias("label")).groupBy("raw", "label").agg(F.count("*").alias("n"))


@query(f"WITH {ANSWERS} SELECT l_orderkey, coalesce(min(l_linenumber) FILTER (WHERE l_suppkey % 4 = 0), max(l_linenumber)) AS checked, coalesce(min(l_linenumber) FILTER (WHERE l_suppkey % 4 = 0), -1) AS label_at FROM answers GROUP BY l_orderkey")
def short_circuit_match(spark, sf):
    return matching.short_circuit(answers(spark, sf).withColumn("matched", F.col("l_suppkey") % 4 == 0), "l_orderkey", "l_linenumber", "matched").withColumn("label_at", F.coalesce("label_at", F.lit(-1)))


@query(f"WITH {ANSWERS} SELECT l_orderkey, label, score FROM (SELECT *, l_partkey AS label, l_extendedprice AS score, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_partkey DESC) AS k FROM answers) WHERE k = 1")
def best_score(spark, sf):
    return matching.best_score(answers(spark, sf), "l_orderkey", "l_linenumber", "l_extendedprice", "l_partkey")


@query("SELECT c_custkey, c_nationkey, CAST(floor(k / 10) AS INTEGER) AS batch, CAST(k % 10 AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS k FROM customer)")
def batch_chunks(spark, sf):
    return matching.chunks(table(spark, sf, "customer").select("c_custkey", "c_nationkey"), 10, "c_nationkey", "c_custkey")


@query("""WITH labels AS (SELECT DISTINCT lpad(CAST(p_partkey % 800 AS VARCHAR), 3, '0') AS label FROM part), seen AS (SELECT DISTINCT CASE WHEN length(d) < 3 THEN lpad(d, 3, '0') ELSE d END AS label FROM (SELECT regexp_extract(glyph, '[0-9]+') AS d FROM glyph_tokens WHERE glyph IS NOT NULL) WHERE d <> '')
SELECT label, CAST(floor(CAST(label AS INTEGER) / 100) AS INTEGER) AS sheet, CAST(floor(CAST(label AS INTEGER) % 100 / 10) AS INTEGER) AS row, CAST(label AS INTEGER) % 10 AS col, label NOT IN (SELECT label FROM seen) AS missing FROM labels""")
def sheet_cells(spark, sf):
    labels = table(spark, sf, "part").select(F.lpad((F.col("p_partkey") % 800).cast("string"), 3, "0").alias("label")).distinct()
    seen = table(spark, sf, "glyph_tokens").select(text.code(F.col("glyph")).alias("label")).where("label IS NOT NULL")
    return matching.cells(labels, seen)


# --- pixels ----------------------------------------------------------------------------------------------------------

#: Line items as dots of images: one image for each supplier.
DOTS = "dots AS (SELECT l_suppkey AS img, CAST(l_partkey % 97 AS INTEGER) AS x, CAST(l_orderkey % 61 AS INTEGER) AS y, CAST(min(l_quantity * 5) AS INTEGER) AS v FROM lineitem GROUP BY 1, 2, 3)"


def dots(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "lineitem")
    return t.groupBy(F.col("l_suppkey").alias("img"), (F.col("l_partkey") % 97).cast("int").alias("x"), (F.col("l_orderkey") % 61).cast("int").alias("y")).agg(F.min(F.col("l_quantity") * 5).cast("int").alias("v"))


@query(f"WITH {DOTS} SELECT img, x, count(*) AS n FROM dots WHERE v < 190 GROUP BY img, x")
def ink_profile(spark, sf):
    return pixels.ink_profile(dots(spark, sf), "x")


@query(f"""WITH {DOTS}, p AS (SELECT img, x FROM dots WHERE v < 190 GROUP BY img, x HAVING count(*) >= 2), f AS (SELECT *, CASE WHEN x - lag(x) OVER (PARTITION BY img ORDER BY x) <= 2 THEN 0 ELSE 1 END AS new FROM p),
r AS (SELECT *, sum(new) OVER (PARTITION BY img ORDER BY x) AS run FROM f) SELECT img, CAST(run AS INTEGER) AS run, min(x) AS low, max(x) + 1 AS high FROM r GROUP BY img, run""")
def runs_islands(spark, sf):
    return pixels.islands(pixels.ink_profile(dots(spark, sf), "x"), "x", 2, 1, "img")


@query(f'WITH {DOTS} SELECT img, greatest(min(x) - 2, 0) AS "left", greatest(min(y) - 2, 0) AS top, max(x) + 3 AS "right", max(y) + 3 AS bottom FROM dots WHERE v < 190 GROUP BY img')
def bounding_boxes(spark, sf):
    return pixels.bounding_boxes(dots(spark, sf), padding=2)


SEGMENTS = f"""WITH {DOTS}, ink AS (SELECT img, x, y FROM dots WHERE v < 190), size AS (SELECT img, max(x) AS w, max(y) AS h FROM dots GROUP BY img),
rn AS (SELECT img, y FROM ink GROUP BY img, y HAVING count(*) >= 2), rf AS (SELECT *, CASE WHEN y - lag(y) OVER (PARTITION BY img ORDER BY y) <= 1 THEN 0 ELSE 1 END AS f FROM rn),
rr AS (SELECT *, sum(f) OVER (PARTITION BY img ORDER BY y) AS line FROM rf), r AS (SELECT img, line, min(y) AS lo, max(y) AS hi FROM rr GROUP BY img, line),
placed AS (SELECT i.img, line, x, y FROM ink i JOIN r ON r.img = i.img AND y BETWEEN lo AND hi),
cn AS (SELECT img, line, x FROM placed GROUP BY img, line, x), cf AS (SELECT *, CASE WHEN x - lag(x) OVER (PARTITION BY img, line ORDER BY x) <= 2 THEN 0 ELSE 1 END AS f FROM cn),
cc AS (SELECT *, sum(f) OVER (PARTITION BY img, line ORDER BY x) AS run FROM cf), c AS (SELECT img, line, run, min(x) AS lo, max(x) AS hi FROM cc GROUP BY img, line, run),
box AS (SELECT p.img, p.line, run, min(x) AS l, min(y) AS t, max(x) AS r, max(y) AS b FROM placed p JOIN c ON c.img = p.img AND c.line = p.line AND x BETWEEN lo AND hi GROUP BY p.img, p.line, run)
SELECT b.img, CAST(row_number() OVER (PARTITION BY b.img ORDER BY line, run) AS INTEGER) AS number, greatest(l - 2, 0) AS "left", greatest(t - 2, 0) AS top, least(r + 3, w + 1) AS "right", least(b + 3, h + 1) AS bottom FROM box b JOIN size s ON s.img = b.img"""


@query(SEGMENTS)
def glyph_boxes(spark, sf):
    return pixels.segments(dots(spark, sf), row_ink=2, column_ink=1, row_gap=0, column_gap=1)


@query("""SELECT o_orderkey AS img, c_custkey AS label, CAST(bit_count(a & b) AS BIGINT) AS overlap, CAST(bit_count(a | b) AS BIGINT) AS union_, round(bit_count(a & b) / greatest(bit_count(a | b), 1) - 0.0001 * bit_count(xor(a, b)), 6) AS score
FROM (SELECT o_orderkey, c_custkey, CAST(o_orderkey * 2654435761 % 1099511627776 AS BIGINT) AS a, CAST(c_custkey * 40503001 % 1099511627776 AS BIGINT) AS b FROM orders JOIN customer ON c_custkey = o_custkey)""")
def mask_iou(spark, sf):
    """Each order's mask against that of its customer; the masks are bits of the keys."""
    bits = lambda key, by: F.array(F.col(key) * F.lit(by) % 1099511627776)
    masks = table(spark, sf, "orders").select(F.col("o_orderkey").alias("img"), F.col("o_custkey").alias("key"), bits("o_orderkey", 2654435761).alias("mask"))
    known = table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.col("c_custkey").alias("label"), bits("c_custkey", 40503001).alias("mask"))
    return pixels.mask_scores(masks, known).withColumn("score", F.round("score", 6))


STRIPS = """sheets AS (SELECT p_partkey AS img, CAST(p_size * 13 + 40 AS INTEGER) AS w, CAST(p_size * 7 + 31 AS INTEGER) AS h, CAST(p_partkey * 5 % 800 AS INTEGER) AS first FROM part),
each AS (SELECT *, first + strip AS number FROM (SELECT *, CAST(unnest(range(5)) AS INTEGER) AS strip FROM sheets)),
wide AS (SELECT *, CAST(round_even(CASE WHEN number IN (93, 468) THEN 0.18::DOUBLE WHEN number IN (94, 469) THEN 0.22::DOUBLE ELSE 0.2::DOUBLE END * w, 0) AS INTEGER) AS c FROM each),
l0 AS (SELECT *, CAST(round_even((strip + 0.5::DOUBLE) * w / 5 - c / 2, 0) AS INTEGER) AS l FROM wide),
l1 AS (SELECT *, CASE WHEN l + c > w THEN greatest(0, w - c) ELSE l END AS l2 FROM l0),
cut AS (SELECT img, strip, number, greatest(l2, 0) AS "left", CASE WHEN l2 < 0 THEN least(w, c) ELSE least(l2 + c, w) END AS "right", h FROM l1)"""


def sheets(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as images of sheets, five numbers each."""
    return table(spark, sf, "part").select(F.col("p_partkey").alias("img"), (F.col("p_size") * 13 + 40).cast("int").alias("width"), (F.col("p_size") * 7 + 31).cast("int").alias("height"), (F.col("p_partkey") * 5 % 800).cast("int").alias("number"))


@query(f"""WITH {STRIPS} SELECT img, strip, number, "left", 0 AS top, "right", h AS bottom FROM cut""")
def strip_geometry(spark, sf):
    return pixels.strip_boxes(sheets(spark, sf))


@query(f"""WITH {STRIPS}, s AS (SELECT *, "right" - "left" AS sw, number BETWEEN 535 AND 539 AS bordered FROM cut),
t AS (SELECT *, CASE WHEN number = 639 THEN greatest(1, CAST(round_even(sw * 0.95::DOUBLE, 0) AS INTEGER)) ELSE sw END AS kept, CASE WHEN bordered THEN CAST(round_even(sw * 0.01::DOUBLE, 0) AS INTEGER) ELSE 0 END AS dx, CASE WHEN bordered THEN CAST(round_even(h * 0.01::DOUBLE, 0) AS INTEGER) ELSE 0 END AS dy FROM s)
SELECT img, strip, number, "left" + dx AS "left", dy AS top, "left" + kept - dx AS "right", h - dy AS bottom, CASE WHEN bordered THEN least("left" + kept - dx, "left" + dx + 32) END AS band_right, CASE WHEN bordered THEN greatest(dy, h - dy - 16) END AS band_top FROM t""")
def strip_mending(spark, sf):
    return pixels.mended_boxes(pixels.strip_boxes(sheets(spark, sf)))


@query(f"""WITH {DOTS}, boxes AS (SELECT s_suppkey AS img, CAST(unnest(range(5)) AS INTEGER) AS strip, CAST(s_suppkey * 5 % 800 AS INTEGER) AS first FROM supplier),
numbered AS (SELECT *, first + strip AS number FROM boxes),
wide AS (SELECT *, CAST(round_even(CASE WHEN number IN (93, 468) THEN 0.18::DOUBLE WHEN number IN (94, 469) THEN 0.22::DOUBLE ELSE 0.2::DOUBLE END * 97, 0) AS INTEGER) AS c FROM numbered),
l0 AS (SELECT *, CAST(round_even((strip + 0.5::DOUBLE) * 97 / 5 - c / 2, 0) AS INTEGER) AS l FROM wide),
box AS (SELECT img, strip, number, CASE WHEN l + c > 97 THEN 97 - c ELSE greatest(l, 0) END AS l, c FROM l0),
inside AS (SELECT d.img, strip, number, x - l AS x, y, v, c FROM dots d JOIN box b ON b.img = d.img AND x >= l AND x < l + c WHERE NOT (number = 639 AND x - l >= CAST(round_even(c * 0.95::DOUBLE, 0) AS INTEGER)))
SELECT img, strip, count(*) AS n_pixels, sum(CASE WHEN number BETWEEN 535 AND 539 AND x - 0 < 32 AND y >= 60 - 16 AND y >= 1 THEN 255 ELSE v END) AS total FROM (SELECT * FROM inside WHERE NOT (number BETWEEN 535 AND 539 AND (y < 1 OR y >= 60))) GROUP BY img, strip""")
def strip_ink(spark, sf):
    """The pixels of each strip of each image, mended, added up."""
    size = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("img"), F.lit(97).alias("width"), F.lit(61).alias("height"), (F.col("s_suppkey") * 5 % 800).cast("int").alias("number"))
    cut = pixels.strip_pixels(dots(spark, sf), pixels.mended_boxes(pixels.strip_boxes(size)))
    return cut.groupBy("img", "strip").agg(F.count("*").alias("n_pixels"), F.sum("v").alias("total"))


#: Line items as sheets of 4 x 13 cells, one for each pair of flags, and the dots of suppliers as what is looked up on them.
CANDIDATES = f"""WITH {DOTS},
sheet AS (SELECT l_returnflag || l_linestatus AS sheet, CAST(l_partkey % 1300 AS INTEGER) AS x, CAST(l_orderkey % 400 AS INTEGER) AS y, CAST(min(l_quantity * 5) AS INTEGER) AS v FROM lineitem GROUP BY 1, 2, 3),
cells AS (SELECT sheet, 'c' || lpad(CAST(floor(y / 100) * 13 + floor(x / 100) AS INTEGER)::VARCHAR, 2, '0') AS label, x % 100 - 8 AS x, y % 100 - 6 AS y FROM sheet WHERE v < 180 AND x % 100 BETWEEN 8 AND 91 AND y % 100 BETWEEN 6 AND 55),
marked AS (SELECT sheet AS img, label, x, y FROM cells UNION ALL SELECT CAST(img AS VARCHAR), NULL, x, y FROM dots WHERE v < 180),
box AS (SELECT img, label, min(x) AS l, min(y) AS t, max(x) - min(x) + 1 AS w, max(y) - min(y) + 1 AS h FROM marked GROUP BY ALL),
fit AS (SELECT *, greatest(1, CAST(round_even(w * 64 / greatest(w, h), 0) AS INTEGER)) AS fw, greatest(1, CAST(round_even(h * 64 / greatest(w, h), 0) AS INTEGER)) AS fh FROM box),
places AS (SELECT DISTINCT m.img, m.label, CAST(floor((y - t) * fh / h) + floor((72 - fh) / 2) AS BIGINT) * 72 + CAST(floor((x - l) * fw / w) + floor((72 - fw) / 2) AS BIGINT) AS at FROM marked m JOIN fit f ON f.img = m.img AND f.label IS NOT DISTINCT FROM m.label),
sizes AS (SELECT img, label, count(*) AS n FROM places GROUP BY ALL),
modes AS (SELECT sheet, row_number() OVER (ORDER BY sheet) - 1 AS k FROM (SELECT DISTINCT sheet FROM sheet)),
asked AS (SELECT s.img, m.sheet, s.n FROM sizes s JOIN modes m ON m.k = CAST(s.img AS BIGINT) % (SELECT count(*) FROM modes) WHERE s.label IS NULL),
shared AS (SELECT a.img, c.label, count(*) AS overlap FROM asked a JOIN places p ON p.img = a.img AND p.label IS NULL JOIN places c ON c.img = a.sheet AND c.label IS NOT NULL AND c.at = p.at GROUP BY ALL),
scored AS (SELECT a.img, s.label, coalesce(overlap, 0) AS overlap, a.n + s.n - coalesce(overlap, 0) AS union_ FROM asked a JOIN sizes s ON s.img = a.sheet AND s.label IS NOT NULL LEFT JOIN shared h ON h.img = a.img AND h.label = s.label),
ranked AS (SELECT *, overlap / greatest(union_, 1) - 0.0001 * (union_ - overlap) AS score FROM scored)
SELECT CAST(img AS BIGINT) AS img, label, CAST(k AS INTEGER) AS rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY img ORDER BY score DESC, label) AS k FROM ranked) WHERE k <= 8"""


@query(CANDIDATES)
def key_candidates(spark, sf):
    """For each image, the eight labels of a sheet's cells whose signs cover it best."""
    t = table(spark, sf, "lineitem")
    img = F.concat("l_returnflag", "l_linestatus").alias("img")
    sheet = t.groupBy(img, (F.col("l_partkey") % 1300).cast("int").alias("x"), (F.col("l_orderkey") % 400).cast("int").alias("y")).agg(F.min(F.col("l_quantity") * 5).cast("int").alias("v"))
    modes = numbered(t.select(img).distinct(), "img", column="k")
    areas = pixels.grid_areas(modes.select("img", F.lit(1300).alias("width"), F.lit(400).alias("height")), [f"c{k:02d}" for k in range(52)])
    known = pixels.glyph_masks(pixels.crops(sheet, F.broadcast(areas), "label"), "label").join(F.broadcast(modes), "img").select(F.col("k").alias("key"), "label", "mask")
    masks = pixels.glyph_masks(dots(spark, sf)).select("img", (F.col("img") % modes.count()).alias("key"), "mask")
    return pixels.ranked_masks(pixels.mask_scores(masks, known), 8).select("img", "label", "rank", F.round("score", 6).alias("score"))


@query()
def seam_split(spark, sf):
    return pixels.split_by_seams(dots(spark, sf), min_split=20, min_part=5, max_ink=0)


@query()
def seam_segments(spark, sf):
    """Coarse regions by rows and columns first, then seams within each."""
    return pixels.seam_segments(dots(spark, sf), row_ink=2, column_ink=1, row_gap=0, column_gap=1, min_split=20, min_part=5)


# --- learning --------------------------------------------------------------------------------------------------------

#: The operator's defaults, which are the reference's; the projections are as wide as the given vectors.
FULL, FULL_WINDOW = learning.Settings(), 4


def anchor_targets(spark: SparkSession, sf: str, vocab: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of the anchors that the vocabulary has, and their unit targets: the k-th anchor is drawn to the mean vector of the k-th label."""
    means = neighbors.mean_vectors(table(spark, sf, "embeddings"), "label").where("label IS NOT NULL").orderBy("label").limit(len(ANCHORS)).collect()
    ids = {r.token: r.idx for r in cooc.resolve_tokens(anchors(spark), vocab).where("idx IS NOT NULL").collect()}
    known = [(ids[a], r["mean"]) for a, r in zip(ANCHORS, means) if a in ids]
    return np.array([k for k, _ in known], np.int64), learning.unit(np.array([m for _, m in known]).reshape(len(known), FULL.output_dim))


@query()
def pca_2d(spark, sf):
    return rounded(learning.principal_plane(table(spark, sf, "embeddings")))


@query(f"""WITH {sql_tokens('simple')}, vocab AS (SELECT token, row_number() OVER (ORDER BY token) - 1 AS idx FROM (SELECT DISTINCT token FROM toks)),
w1 AS (SELECT j, list(sin(3.0 * i + 2.0 * j) / 10 ORDER BY i) AS w FROM range(128) a(i), range(256) b(j) GROUP BY j), w2 AS (SELECT j, list(sin(3.0 * i + 2.0 * j) / 10 ORDER BY i) AS w FROM range(256) a(i), range(64) b(j) GROUP BY j),
own AS (SELECT token, idx, list_transform(range(128), lambda j: sin(3.0 * idx + 2.0 * j) / 10) AS v FROM vocab),
hidden AS (SELECT token, idx, list(greatest(list_dot_product(v, w), 0) ORDER BY j) AS h FROM own, w1 GROUP BY ALL),
out AS (SELECT token, idx, list(list_dot_product(h, w) ORDER BY j) AS o FROM hidden, w2 GROUP BY ALL)
SELECT token, CAST(idx AS INTEGER) AS idx, round(o[1], 6) + 0 AS first, round(o[64], 6) + 0 AS last, round(list_sum(o), 5) + 0 AS total FROM out""")
def projection_forward(spark, sf):
    """The tokens' vectors through a layer of the whole size with fixed weights."""
    vocab = stage(cooc.vocabulary(tokens(spark, sf, "simple")), "vocab")
    out = learning.project(vocab, learning.Learned.waves(vocab, FULL))
    return out.select("token", "idx", (F.round(F.get("projected", F.lit(0)), 6) + 0).alias("first"), (F.round(F.get("projected", F.lit(63)), 6) + 0).alias("last"), (F.round(F.aggregate("projected", F.lit(0.0), lambda s, x: s + x), 5) + 0).alias("total"))


@query()
def train_projection(spark, sf):
    """Six epochs over the pairs of all lines, with the anchors."""
    lines_ = tokens(spark, sf, "simple")
    vocab = stage(cooc.vocabulary(lines_), "vocab")
    model, _ = learning.fit_projection(cooc.indexed_pairs(cooc.pair_counts(lines_, FULL_WINDOW), vocab), vocab.count(), FULL, anchor_targets(spark, sf, vocab))
    return learning.project(vocab, model)


def queries() -> dict[str, Query]:
    return dict(FOUND)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
