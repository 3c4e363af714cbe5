"""Line maps, trial logs, neighbour lists, anchors and images as files."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesserae.functions.text import leading_number, pad, safe_file_part, variant_key

RECORD = "trial_id string, strategy string, model_preset string, pair_count int, vocab_size int, final_loss double, elapsed_sec double, score double, error string, logged_at timestamp, metrics map<string,string>"


def read_line_maps(spark: SparkSession, path: str) -> DataFrame:
    """corpus, tablet, ord, title and text of files <corpus>/<any folder>/<tablet>.json with one object of titles and texts.

    A title that comes again keeps its first place and its last text.
    """
    name = F.col("_metadata.file_path")
    files = spark.read.text(path, wholetext=True).select(F.regexp_extract(name, "([^/]+)/[^/]+/[^/]+$", 1).alias("corpus"), F.regexp_extract(name, "([^/]+)\\.json$", 1).alias("tablet"), F.from_json("value", "map<string,string>").alias("m"))
    each = files.select("corpus", "tablet", F.posexplode(F.map_entries("m")).alias("ord", "e")).select("corpus", "tablet", "ord", F.col("e.key").alias("title"), F.col("e.value").alias("text"))
    return each.groupBy("corpus", "tablet", "title").agg(F.min("ord").alias("ord"), F.max_by("text", "ord").alias("text")).select("corpus", "tablet", "ord", "title", "text")


def write_line_maps(lines: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Lines (corpus, tablet, ord, title, text) as one object of titles and texts for each tablet, in their order, under corpus= and tablet=."""
    entries = F.transform(F.sort_array(F.collect_list(F.struct("ord", "title", "text"))), lambda x: F.struct(x["title"].alias("key"), x["text"].alias("value")))
    each = lines.where("title IS NOT NULL").groupBy("corpus", "tablet", "title").agg(F.min("ord").alias("ord"), F.max_by("text", "ord").alias("text"))
    each.groupBy("corpus", "tablet").agg(F.to_json(F.map_from_entries(entries), {"ignoreNullFields": "false"}).alias("value")).write.mode(mode).partitionBy("corpus", "tablet").text(path)


#: Strategies whose tokens lie with the texts.
TEXT_STRATEGIES = ("normalized_text", "characters")


def write_tokens(tokenized: DataFrame, path: str, strategy: str, mode: str = "overwrite") -> None:
    """Tokens as JSON lines under corpus=, kind= (text or tokenized, by the strategy) and strategy=."""
    kind = "text" if strategy in TEXT_STRATEGIES else "tokenized"
    tokenized.withColumn("kind", F.lit(kind)).withColumn("strategy", F.lit(strategy)).write.mode(mode).partitionBy("corpus", "kind", "strategy").json(path)


LINE = "line_id long, tablet string, ord int, title string"


def read_tokens(spark: SparkSession, path: str, strategy: str) -> DataFrame:
    """What write_tokens() wrote; only the strategy's folders are read, and those whose name begins with _ never are."""
    return spark.read.schema(f"{LINE}, tokens array<string>, corpus string, kind string, strategy string").json(path).where(F.col("strategy") == strategy).drop("kind")


def read_variant_tokens(spark: SparkSession, path: str, strategy: str = "glyph_variants") -> DataFrame:
    """Lines whose tokens were written as structs of glyph, variant and modifiers: their keys in place of the structs. Lines without tokens are left out."""
    read = spark.read.schema(f"{LINE}, tokens array<struct<glyph string, variant string, modifiers array<string>>>, corpus string, kind string, strategy string").json(path)
    own = read.where((F.col("strategy") == strategy) & (F.size("tokens") > 0)).drop("kind")
    return own.withColumn("tokens", F.transform("tokens", lambda t: variant_key(t)))


def file_totals(files: DataFrame, *keys: str) -> DataFrame:
    """keys, n_files and n_bytes of files with a length: what was written, or removed."""
    return files.groupBy(*keys).agg(F.count("*").alias("n_files"), F.coalesce(F.sum("length"), F.lit(0)).alias("n_bytes"))


def append_trials(records: DataFrame, path: str, resume: bool) -> None:
    """Adds to the log; without resume the log begins anew."""
    records.write.mode("append" if resume else "overwrite").json(path)


def read_trials(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """The records of a log; a malformed line raises, or is dropped if not strict."""
    if strict:
        return spark.read.schema(RECORD).option("mode", "FAILFAST").json(path)
    return spark.read.schema(RECORD + ", _bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path).where("_bad IS NULL AND trial_id IS NOT NULL").drop("_bad")


def completed_trials(spark: SparkSession, path: str) -> DataFrame:
    """trial_id of every run in the log, failed ones too; malformed lines are passed over."""
    return read_trials(spark, path, strict=False).select("trial_id").distinct()


def read_neighbors(spark: SparkSession, path: str) -> DataFrame:
    """trial_id, token, rank, word and cosine of files <trial>/.../*neighbors.json with lists of [word, cosine] by token.

    Of a trial's files one below a folder graphs comes first, then the one with the least path.
    """
    name = F.col("_metadata.file_path")
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*neighbors.json").text(path, wholetext=True).select(
        F.regexp_extract(name, "/([^/]+)(?:/graphs)?/[^/]+$", 1).alias("trial_id"), (~name.contains("/graphs/")).cast("int").alias("place"), name.alias("file"), F.from_json("value", "map<string,array<array<string>>>").alias("m")
    )
    first = files.withColumn("_n", F.row_number().over(Window.partitionBy("trial_id").orderBy("place", "file"))).where("_n = 1")
    each = first.select("trial_id", F.explode("m").alias("token", "hits")).select("trial_id", "token", F.posexplode("hits").alias("p", "hit"))
    return each.select("trial_id", "token", (F.col("p") + 1).alias("rank"), F.get("hit", F.lit(0)).alias("word"), F.get("hit", F.lit(1)).cast("double").alias("cosine"))


def read_anchors(spark: SparkSession, path: str) -> DataFrame:
    """token and gloss of a file with lists of glosses by token."""
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("token", "glosses")).select("token", F.explode("glosses").alias("gloss"))


def read_images(spark: SparkSession, path: str, suffixes: tuple[str, ...] = ("png", "gif", "jpg", "jpeg", "webp")) -> DataFrame:
    """path, name, number (of the stem, 10^9 without one), length and content of image files under path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + ",".join(x for s in suffixes for x in (s, s.upper())) + "}").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select("path", name.alias("name"), leading_number(name).alias("number"), "length", "content")


def smallest_encoding(encodings: DataFrame, key: str = "key", suffix: str = "suffix", size: str = "length", order: str = "place") -> DataFrame:
    """key, suffix and size of each image's smallest encoding; of equal ones the first."""
    return encodings.groupBy(key).agg(F.min_by(F.struct(F.col(suffix).alias("suffix"), F.col(size).alias("length")), F.struct(size, order)).alias("b")).select(key, "b.suffix", "b.length")


def write_projection(projected: DataFrame, metadata: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A trial's projected tokens as parquet and its metadata as JSON, under trial_id=."""
    projected.write.mode(mode).partitionBy("trial_id").parquet(f"{path}/projection")
    metadata.write.mode(mode).partitionBy("trial_id").json(f"{path}/metadata")


def write_answers(answers: DataFrame, path: str, mode: str = "append") -> None:
    """A scorer's answers as JSON, in a folder for each query named <parent>_<stem>_<model>, made safe."""
    part = lambda k: F.element_at(F.split("path", "/"), k)
    name = F.concat_ws("_", part(-2), F.regexp_replace(part(-1), "\\.[^.]*$", ""), F.col("model"))
    answers.withColumn("run", safe_file_part(name)).write.mode(mode).partitionBy("run").json(path)


def images_by_label(images: DataFrame) -> DataFrame:
    """Images whose stem is a number, with a column label: that number with three digits."""
    stem = F.regexp_replace("name", "\\.[^.]*$", "")
    return images.where(stem.rlike("^[0-9]+$")).withColumn("label", pad(stem))
