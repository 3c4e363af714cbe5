"""Following logs that grow, with Structured Streaming."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tesserae.operators.tokenize import tokenize
from tesserae.sources.records import RECORD


def follow_trials(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the good records of a trial log, by files as they come."""
    return spark.readStream.schema(RECORD).json(path).where("trial_id IS NOT NULL AND (error IS NULL OR trim(error) = '')")


def follow_tokens(lines: DataFrame, strategy: str, delay: str = "7 days") -> DataFrame:
    """line_id, pos and token of a stream of lines; a line delivered again within the delay is passed over."""
    once = lines.withWatermark("loaded_at", delay).dropDuplicatesWithinWatermark(["corpus", "tablet", "title"])
    return tokenize(once, strategy).select("line_id", F.posexplode("tokens").alias("pos", "token"))


def write_by_batch(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends each batch to a table of files, once even after a restart, and stops when what is there has been read."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start()
