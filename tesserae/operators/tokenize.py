"""Sixteen strategies that turn a line into tokens, as column expressions by name."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.functions.text import clean_text, code, glyph_variant, is_separator, ligature_parts, normalize_text, pad_numbers, strip_allographs, suffix_parts, variant_key

#: A sign, a sign or separator, and signs joined by . or :.
SIGN, SIGN_OR_SEPARATOR, LIGATURE = "[0-9]+[A-Za-z]*", "[0-9]+[A-Za-z]*|[-.:]", "[0-9]+[A-Za-z]*(?:[.:][0-9]+[A-Za-z]*)*"


def matches(pattern: str) -> Callable[[Column], Column]:
    return lambda text: F.regexp_extract_all(text, F.lit(pattern), 0)


def each(pattern: str, of: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda text: F.transform(matches(pattern)(text), of)


def flat(pattern: str, of: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda text: F.flatten(F.transform(matches(pattern)(text), of))


def plain(of: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """of the text without the letters of variants."""
    return lambda text: of(strip_allographs(text))


def unless_separator(of: Callable[[Column], Column], kept: Callable[[Column], Column] = lambda t: t) -> Callable[[Column], Column]:
    return lambda t: F.when(is_separator(t), kept(t)).otherwise(of(t))


barthel, barthel_separators, barthel_ligatures = each(SIGN, pad_numbers), each(SIGN_OR_SEPARATOR, unless_separator(pad_numbers)), each(LIGATURE, pad_numbers)
suffix = flat(SIGN, suffix_parts)

#: Name to tokens of a line; the text is cleaned before.
STRATEGIES: dict[str, Callable[[Column], Column]] = {
    "barthel": barthel,
    "barthel_separators": barthel_separators,
    "barthel_ligatures": barthel_ligatures,
    "barthel_noag": plain(barthel),
    "barthel_separators_noag": plain(barthel_separators),
    "barthel_ligatures_noag": plain(barthel_ligatures),
    "suffix": suffix,
    "suffix_separators": flat(SIGN_OR_SEPARATOR, unless_separator(suffix_parts, F.array)),
    "suffix_ligatures": flat(LIGATURE, suffix_parts),
    "suffix_noag": plain(suffix),
    "simple": each("[0-9]+", code),
    "simple_separators": lambda text: F.filter(each(SIGN_OR_SEPARATOR, unless_separator(code))(text), lambda t: t != "-"),
    "simple_ligatures": each(LIGATURE, lambda t: pad_numbers(F.regexp_replace(t, "[A-Za-z]+", ""))),
    "glyph_variants": lambda text: F.transform(flat(LIGATURE, ligature_parts)(text), lambda part: variant_key(glyph_variant(part))),
    "normalized_text": lambda text: F.when(text.isNotNull(), F.array(normalize_text(text))),
    "characters": lambda text: F.filter(F.split(normalize_text(text), ""), lambda c: c != ""),
}


def tokens_of(strategy: str, text: Column) -> Column:
    """The tokens of a line; an array, empty for a null or empty text (normalized_text: one token for any but a null one)."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}; there are {', '.join(STRATEGIES)}")
    return F.coalesce(STRATEGIES[strategy](clean_text(text)), F.array().cast("array<string>"))


def tokenize(lines: DataFrame, strategy: str, text: str = "text") -> DataFrame:
    """lines with a column tokens."""
    return lines.withColumn("tokens", tokens_of(strategy, F.col(text)))


def sequences(tokenized: DataFrame) -> DataFrame:
    """Lines with tokens, without the blank ones; a line of blank tokens only stays, empty."""
    return tokenized.where(F.size("tokens") > 0).withColumn("tokens", F.filter("tokens", lambda t: F.trim(t) != ""))


def exploded(tokenized: DataFrame, *keys: str) -> DataFrame:
    return tokenized.select(*keys, F.posexplode("tokens").alias("pos", "token"))
