"""Lines out of pages, delivered lines made single, and counts of lines."""

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesserae.functions.text import normalize_text


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """corpus, tablet and html of the files under path: <corpus>/raw/<tablet>.html."""
    name = F.col("_metadata.file_path")
    return spark.read.text(path, wholetext=True).select(F.regexp_extract(name, "([^/]+)/raw/[^/]+$", 1).alias("corpus"), F.regexp_extract(name, "([^/]+)\\.html$", 1).alias("tablet"), F.col("value").alias("html"))


class ListLines(HTMLParser):
    """Items of lists as title (in <a>) and text (around it), with a blank for each stretch of white space and for <br>."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines, self.item, self.in_title = [], None, False

    def handle_starttag(self, tag, attrs):
        if tag == "li":  # an item that is still open is given up
            self.item = ([], [])
        elif tag == "a" and self.item is not None:
            self.in_title = True
        elif tag == "br" and self.item is not None:
            self.item[1].append("\n")

    def handle_endtag(self, tag):
        if self.item is None:
            return
        if tag == "a":
            self.in_title = False
        elif tag == "li":
            self.lines.append(tuple(" ".join("".join(part).split()) for part in self.item))
            self.item, self.in_title = None, False

    def handle_data(self, data):
        if self.item is not None:
            self.item[0 if self.in_title else 1].append(data)


#: The entities that plain pages use, &amp; last.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def plain_text(markup: Column) -> Column:
    """The text between tags, with the ENTITIES decoded and white space made single."""
    bare = F.regexp_replace(F.regexp_replace(markup, "(?i)<br */?>", "\n"), "<[^>]*>", "")
    for entity, character in ENTITIES:
        bare = F.replace(bare, F.lit(entity), F.lit(character))
    return normalize_text(bare)


def extract_lines(pages: DataFrame, html: str = "html", general: bool = True) -> DataFrame:
    """The columns of pages but html, and ord, title and text of each closed list item with a title.

    general reads any HTML (attributes, entities, items that aren't closed) in batches of Arrow; otherwise plain items
    <li>..<a>title</a>..</li> are taken with regular expressions, without Python. An item that isn't closed before the
    next begins, or before the end, is left out. A title that comes again in a page keeps its first place and its last text. A null page has no
    lines.
    """
    keys = [c for c in pages.columns if c != html]
    if general:

        @F.pandas_udf("array<struct<title string, text string>>")
        def items(values: pd.Series) -> pd.Series:
            def read(value):
                parser = ListLines()
                parser.feed(value or "")
                parser.close()
                return [{"title": t, "text": x} for t, x in parser.lines]

            return values.map(read)

        each = pages.select(*keys, F.posexplode(items(html)).alias("ord", "item")).select(*keys, "ord", "item.title", "item.text")
    else:
        item = F.posexplode(F.regexp_extract_all(html, F.lit("(?s)<li>((?:(?!<li>).)*?)</li>"), 1)).alias("ord", "item")
        text = F.regexp_replace("item", "(?s)<a[^>]*>.*?</a>", "")
        each = pages.select(*keys, item).select(*keys, "ord", plain_text(F.regexp_extract("item", "(?s)<a[^>]*>(.*?)</a>", 1)).alias("title"), plain_text(text).alias("text"))
    each = each.where("title <> ''")
    return each.groupBy(*keys, "title").agg(F.min("ord").alias("ord"), F.max_by("text", "ord").alias("text")).select(*keys, "ord", "title", "text")


def latest_lines(lines: DataFrame) -> DataFrame:
    """One row for each corpus, tablet and title: the latest delivery, in the first place.

    Of deliveries at one time the one with the greatest line_id counts, then the greatest text. Rows without a title
    are left out; a null corpus or tablet is a value of its own.
    """
    key = ["corpus", "tablet", "title"]
    last = F.max_by(F.struct("line_id", "text", "loaded_at"), F.struct("loaded_at", "line_id", "text"))
    return lines.where("title IS NOT NULL").groupBy(*key).agg(F.min("ord").alias("ord"), last.alias("last")).select("last.line_id", *key, "ord", "last.text", "last.loaded_at")


def line_counts(lines: DataFrame) -> DataFrame:
    """n_lines by corpus and tablet, by corpus, and in all (level 0, 1, 2)."""
    return lines.rollup("corpus", "tablet").agg(F.count("*").alias("n_lines"), F.grouping_id().alias("g")).select("corpus", "tablet", F.when(F.col("g") == 0, 0).when(F.col("g") == 1, 1).otherwise(2).alias("level"), "n_lines")


def last_records(records: DataFrame, key: str = "trial_id", order: str = "logged_at") -> DataFrame:
    """The last record of each key that has no error; a later error doesn't hide an earlier success."""
    w = Window.partitionBy(key).orderBy(F.col(order).desc_nulls_last(), F.col("score").desc_nulls_last())
    good = records.where(f"{key} IS NOT NULL AND (error IS NULL OR trim(error) = '')")
    return good.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
