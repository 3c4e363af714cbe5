"""The pN_ queries with their production parameters, and the SQL that gives the same rows."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm import mixing, subjects
from tesserae.llm.encoding import encode
from tesserae.llm.frequencies import gram_frequencies
from tesserae.llm.pairs import pairs_together
from tesserae.llm.patterns import frequent_patterns
from tesserae.llm.runs import collapse_runs
from tesserae.llm.spans import shared_shares, shared_spans
from tesserae.plans.stages import stage
from tesserae.sources import table


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return collapse_runs(table(spark, sf, "glyph_tokens")).select("line_id", "start_pos", "end_pos")


def p1_events(spark: SparkSession, sf: str) -> DataFrame:
    """Every line as events, single tokens too."""
    return collapse_runs(table(spark, sf, "glyph_tokens"), least=1).select("line_id", "glyph", "start_pos", "end_pos", "n_tokens", "variants", F.round("seconds", 3).alias("seconds"))


def windows(spark: SparkSession, sf: str) -> list[int]:
    """The different positive windows of the trials: a handful, and at most a thousand are taken for such."""
    found = [r[0] for r in table(spark, sf, "trial_configs").where("context_window > 0").select("context_window").distinct().limit(1001).collect()]
    if len(found) > 1000:
        raise ValueError("more than 1000 different windows")
    return found


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return pairs_together(table(spark, sf, "glyph_tokens"), windows(spark, sf), least_lines=5, share=50, lift=3).select("context_window", "glyph_a", "glyph_b")


def p2_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Every pair that two lines in a hundred hold, with its counts and scores."""
    found = pairs_together(table(spark, sf, "glyph_tokens"), windows(spark, sf), least_lines=5, share=50)
    return found.select("context_window", "glyph_a", "glyph_b", "n_ab", "n_a", "n_b", "n_lines", F.round("lift", 6).alias("lift"), F.round("conviction", 6).alias("conviction"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return frequent_patterns(table(spark, sf, "glyph_tokens")).select("event_pattern")


def p3_patterns(spark: SparkSession, sf: str) -> DataFrame:
    return frequent_patterns(table(spark, sf, "glyph_tokens"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return shared_spans(table(spark, sf, "glyph_tokens"))


def p4_shares(spark: SparkSession, sf: str) -> DataFrame:
    """How much of each line other lines hold too."""
    return shared_shares(table(spark, sf, "glyph_tokens")).withColumn("shared_share", F.round("shared_share", 6))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """The marked terms: the n-grams of one term, of the intervals of the whole array."""
    return gram_frequencies(table(spark, sf, "glyph_tokens"), depth=3).where("n = 1 AND mark IS NOT NULL").select(F.col("gram").alias("term"), "mark")


def p5_terms(spark: SparkSession, sf: str) -> DataFrame:
    """Every n-gram of one to three terms with its occurrences and lines."""
    return gram_frequencies(table(spark, sf, "glyph_tokens"), depth=3)


def p6_ids(spark: SparkSession, sf: str) -> DataFrame:
    return encode(table(spark, sf, "documents"))


def p7_mixture(spark: SparkSession, sf: str) -> DataFrame:
    """The pieces of documents in each slot of the mixture."""
    return mixing.mix(mixing.sized(table(spark, sf, "documents")), table(spark, sf, "mix_targets"))


def p7_shares(spark: SparkSession, sf: str) -> DataFrame:
    """The shares that the mixture reaches."""
    return mixing.shares(p7_mixture(spark, sf), table(spark, sf, "mix_targets"))


def p7_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """The mixture as blocks of token ids."""
    return mixing.mixed_blocks(table(spark, sf, "documents"), stage(p7_mixture(spark, sf), "mixture"))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return subjects.subjects(table(spark, sf, "documents"), table(spark, sf, "subject_examples")).select("doc_id", "subject")


def p8_composition(spark: SparkSession, sf: str) -> DataFrame:
    """How many documents and sentences each subject has."""
    documents = table(spark, sf, "documents")
    return subjects.composition(subjects.subjects(documents, table(spark, sf, "subject_examples")), documents)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_events, p2_found, p2_pairs, p3_found, p3_patterns, p4_found, p4_shares, p5_found, p5_terms, p6_ids, p7_mixture, p7_shares, p7_blocks, p8_found, p8_composition)}


#: One row for each position with its reading, straight from the statement.
READ = """
read AS (
  SELECT line_id, pos, min(CASE WHEN d = '' THEN NULL WHEN length(d) < 3 THEN lpad(d, 3, '0') ELSE d END) AS glyph,
         min(v) AS variant, min(m) AS modifiers, min(read_at) AS read_at, max(read_at) AS read_last
  FROM (SELECT line_id, pos, regexp_extract(coalesce(glyph, ''), '[0-9]+') AS d,
               regexp_replace(lower(coalesce(variant, '')), '[^a-g]', '', 'g') AS v,
               array_to_string(regexp_extract_all(lower(coalesce(array_to_string(modifiers, ''), '')), '[a-z]'), ',') AS m, read_at
        FROM glyph_tokens WHERE line_id IS NOT NULL AND pos >= 0)
  GROUP BY line_id, pos),
toks AS (SELECT *, glyph || CASE WHEN modifiers = '' THEN '' ELSE '+' || modifiers END AS event,
                glyph || CASE WHEN variant = '' THEN '' ELSE ':' || variant END AS term
         FROM read WHERE glyph IS NOT NULL),
total AS (SELECT count(DISTINCT line_id) AS n_lines FROM toks)"""

RUNS = f"""
WITH {READ},
step AS (SELECT *, CASE WHEN pos = lag(pos) OVER w + 1 AND glyph = lag(glyph) OVER w AND levenshtein(variant, lag(variant) OVER w) <= 1
                        THEN 0 ELSE 1 END AS fresh FROM toks WINDOW w AS (PARTITION BY line_id ORDER BY pos)),
run AS (SELECT *, sum(fresh) OVER (PARTITION BY line_id ORDER BY pos) AS k FROM step),
events AS (SELECT line_id, glyph, CAST(min(pos) AS INTEGER) AS start_pos, CAST(max(pos) AS INTEGER) AS end_pos, count(*) AS n_tokens,
                  count(DISTINCT variant) AS variants, round((epoch_us(max(read_at)) - epoch_us(min(read_at))) / 1e6, 3) AS seconds
           FROM run GROUP BY line_id, glyph, k)"""

PAIRS = f"""
WITH {READ},
w AS (SELECT DISTINCT CAST(context_window AS INTEGER) AS context_window FROM trial_configs WHERE context_window > 0),
na AS (SELECT glyph, count(DISTINCT line_id) AS n FROM toks GROUP BY glyph),
near AS (SELECT a.line_id, a.glyph AS glyph_a, b.glyph AS glyph_b, min(abs(a.pos - b.pos)) AS d
         FROM toks a JOIN toks b ON a.line_id = b.line_id AND a.glyph < b.glyph
         AND abs(a.pos - b.pos) <= (SELECT max(context_window) FROM w) GROUP BY ALL),
nab AS (SELECT context_window, glyph_a, glyph_b, count(*) AS n_ab FROM near JOIN w ON d <= context_window GROUP BY ALL),
pairs AS (SELECT context_window, glyph_a, glyph_b, n_ab, x.n AS n_a, y.n AS n_b, n_lines FROM nab
          JOIN na x ON x.glyph = glyph_a JOIN na y ON y.glyph = glyph_b, total
          WHERE n_ab >= 5 AND 50 * n_ab >= n_lines)"""


def chains() -> str:
    """Patterns of three to five events; steps that too few lines hold begin none."""
    parts = [f"""
WITH {READ},
often AS (SELECT event FROM toks, total GROUP BY event, n_lines HAVING 25 * count(DISTINCT line_id) >= n_lines),
t AS (SELECT line_id, pos, event FROM toks SEMI JOIN often USING (event)),
s2 AS (SELECT a.line_id, a.pos AS p1, b.pos AS pos, a.event || ' ' || b.event AS pattern FROM t a JOIN t b ON a.line_id = b.line_id AND b.pos BETWEEN a.pos + 1 AND a.pos + 3),
f2 AS (SELECT pattern, count(DISTINCT line_id) AS n FROM s2, total GROUP BY pattern, n_lines HAVING 25 * count(DISTINCT line_id) >= n_lines)"""]
    for k in range(3, 6):
        parts.append(f"""
s{k} AS (SELECT DISTINCT a.line_id, b.pos, a.pattern || ' ' || b.event AS pattern FROM s{k - 1} a SEMI JOIN f{k - 1} f ON a.pattern = f.pattern
         JOIN t b ON a.line_id = b.line_id AND b.pos BETWEEN a.pos + 1 AND a.pos + 3),
f{k} AS (SELECT pattern, count(DISTINCT line_id) AS n FROM s{k}, total GROUP BY pattern, n_lines HAVING 25 * count(DISTINCT line_id) >= n_lines)""".replace("SEMI JOIN f2 f ON a.pattern = f.pattern", "SEMI JOIN f2 f ON a.pattern = f.pattern"))
    parts.append("""
found AS (""" + " UNION ALL ".join(f"SELECT pattern AS event_pattern, {k} AS n_events, n FROM f{k}" for k in range(3, 6)) + ")")
    return ",".join(parts)


SPANS = f"""
WITH {READ},
part AS (SELECT *, pos - row_number() OVER (PARTITION BY line_id ORDER BY pos) AS k FROM toks),
win AS (SELECT line_id, pos, string_agg(glyph, ' ') OVER f AS text, count(*) OVER f AS n FROM part
        WINDOW f AS (PARTITION BY line_id, k ORDER BY pos ROWS BETWEEN CURRENT ROW AND 15 FOLLOWING)),
both_ AS (SELECT text FROM win WHERE n = 16 GROUP BY text HAVING min(line_id) <> max(line_id)),
hit AS (SELECT line_id, pos FROM win SEMI JOIN both_ USING (text) WHERE n = 16),
fresh AS (SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY line_id ORDER BY pos) <= 16 THEN 0 ELSE 1 END AS f FROM hit),
isle AS (SELECT *, sum(f) OVER (PARTITION BY line_id ORDER BY pos) AS k FROM fresh),
spans AS (SELECT line_id, CAST(min(pos) AS INTEGER) AS start_pos, CAST(max(pos) + 15 AS INTEGER) AS end_pos FROM isle GROUP BY line_id, k)"""

GRAMS = f"""
WITH {READ},
grams AS (SELECT 1 AS n, line_id, term AS gram FROM toks
          UNION ALL SELECT 2, a.line_id, a.term || ' ' || b.term FROM toks a JOIN toks b ON a.line_id = b.line_id AND b.pos = a.pos + 1
          UNION ALL SELECT 3, a.line_id, a.term || ' ' || b.term || ' ' || c.term FROM toks a JOIN toks b ON a.line_id = b.line_id AND b.pos = a.pos + 1
                    JOIN toks c ON a.line_id = c.line_id AND c.pos = a.pos + 2),
counted AS (SELECT n, gram, count(*) AS occurrences, count(DISTINCT line_id) AS records FROM grams GROUP BY n, gram),
marked AS (SELECT CAST(n AS INTEGER) AS n, gram, occurrences, records, n_lines, CASE WHEN records <= 2 THEN 'rare' WHEN 5 * records > n_lines THEN 'common' END AS mark FROM counted, total)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": RUNS + " SELECT line_id, start_pos, end_pos FROM events WHERE n_tokens >= 2",
        "p1_events": RUNS + " SELECT line_id, glyph, start_pos, end_pos, n_tokens, variants, seconds FROM events",
        "p2_found": PAIRS + " SELECT context_window, glyph_a, glyph_b FROM pairs WHERE n_ab * n_lines >= 3 * n_a * n_b",
        "p2_pairs": PAIRS + " SELECT *, round(n_ab * n_lines / (n_a * n_b), 6) AS lift, CASE WHEN n_ab < n_a THEN round((1 - n_b / n_lines) / (1 - n_ab / n_a), 6) END AS conviction FROM pairs",
        "p3_found": chains() + " SELECT event_pattern FROM found",
        "p3_patterns": chains() + " SELECT event_pattern, CAST(n_events AS INTEGER) AS n_events, n, n_lines FROM found, total",
        "p4_found": SPANS + " SELECT line_id, start_pos, end_pos FROM spans",
        "p4_shares": SPANS + " SELECT t.line_id, n_tokens, coalesce(n_shared, 0) AS n_shared, round(coalesce(n_shared, 0) / n_tokens, 6) AS shared_share FROM (SELECT line_id, count(*) AS n_tokens FROM toks GROUP BY line_id) t LEFT JOIN (SELECT line_id, CAST(sum(end_pos - start_pos + 1) AS BIGINT) AS n_shared FROM spans GROUP BY line_id) s USING (line_id)",
        "p5_found": GRAMS + " SELECT gram AS term, mark FROM marked WHERE mark IS NOT NULL AND n = 1",
        "p5_terms": GRAMS + " SELECT n, gram, occurrences, records, n_lines, mark FROM marked",
    }
