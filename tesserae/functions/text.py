"""Column expressions over transliterated lines and codes.

Null in gives null out, unless a function says otherwise.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters of uncertainty and damage, of variants, and of separation.
MARKS, ALLOGRAPHS, SEPARATORS = "!*?()", "abcdefgV", ("-", ".", ":")
LETTERS = "[A-Za-z]"


def normalize_text(text: Column) -> Column:
    """White space of any kind, information separators too, becomes one blank; none at the ends."""
    return F.trim(F.regexp_replace(text, "(?U)[\\s\\x1c-\\x1f]+", " "))


def clean_text(text: Column) -> Column:
    return F.translate(text, MARKS, "")


def strip_allographs(text: Column) -> Column:
    return F.translate(text, ALLOGRAPHS, "")


def pad(digits: Column) -> Column:
    """Zeros up to three characters; longer codes keep all of theirs."""
    return F.when(F.length(digits) < 3, F.lpad(digits, 3, "0")).otherwise(digits)


def code(text: Column) -> Column:
    """The first run of digits, padded; null without digits."""
    digits = F.regexp_extract(text, "[0-9]+", 0)
    return F.when(digits != "", pad(digits))


def strict_code(text: Column) -> Column:
    """code(), but a text without digits raises."""
    return F.when(text.isNotNull() & code(text).isNull(), F.raise_error(F.concat(F.lit("no digits in "), text)).cast("string")).otherwise(code(text))


def pad_numbers(token: Column) -> Column:
    """Every run of digits padded where it stands."""
    one = F.regexp_replace(token, "(?<![0-9])([0-9])(?![0-9])", "00$1")
    return F.regexp_replace(one, "(?<![0-9])([0-9]{2})(?![0-9])", "0$1")


def is_separator(token: Column) -> Column:
    return token.isin(*SEPARATORS)


def suffix_parts(token: Column) -> Column:
    """The token without its letters, padded, then each letter by itself; no empty first part."""
    base = pad_numbers(F.regexp_replace(token, LETTERS, ""))
    return F.concat(F.when(base != "", F.array(base)).otherwise(F.array().cast("array<string>")), F.regexp_extract_all(token, F.lit(LETTERS), 0))


def ligature_parts(token: Column) -> Column:
    return F.filter(F.split(token, "[.:]"), lambda x: x != "")


def glyph_variant(part: Column) -> Column:
    """struct<glyph, variant, modifiers>: letters a to g are the variant, v is dropped, all others are modifiers."""
    low = F.lower(part)
    return F.struct(code(part).alias("glyph"), F.regexp_replace(low, "[^a-g]", "").alias("variant"), F.regexp_extract_all(low, F.lit("[h-uw-z]"), 0).alias("modifiers"))


def variant_key(token: Column) -> Column:
    """076, 076:a, 076:a+x,y or 076:+h,x of a struct<glyph, variant, modifiers>; missing parts count as empty."""
    variant, modifiers = F.coalesce(token["variant"], F.lit("")), F.array_join(F.coalesce(token["modifiers"], F.array().cast("array<string>")), ",")
    more = F.when(modifiers != "", F.concat(F.lit("+"), modifiers)).otherwise("")
    return F.when((variant == "") & (modifiers == ""), token["glyph"]).otherwise(F.concat(token["glyph"], F.lit(":"), variant, more))


def parse_variant_key(key: Column) -> Column:
    """The struct that variant_key() was given."""
    rest = F.when(F.instr(key, ":") > 0, F.regexp_replace(key, "^[^:]*:", "")).otherwise("")
    variant = F.regexp_replace(rest, "\\+.*$", "")
    modifiers = F.when(F.instr(rest, "+") > 0, F.regexp_replace(rest, "^[^+]*\\+", "")).otherwise("")
    return F.struct(F.regexp_replace(key, ":.*$", "").alias("glyph"), variant.alias("variant"), F.filter(F.split(modifiers, ","), lambda x: x != "").alias("modifiers"))


def wrap_token(token: Column) -> Column:
    return F.concat(F.lit("<R"), token, F.lit(">"))


def safe_model_name(name: Column) -> Column:
    return F.replace(name, F.lit("/"), F.lit("_"))


def safe_file_part(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(name, "[^A-Za-z0-9_.-]+", "-"), "^-+|-+$", "")


def leading_number(name: Column) -> Column:
    """The number that a file's stem is, else 10^9, so that such files come last."""
    stem = F.regexp_replace(name, "\\.[^.]*$", "")
    return F.coalesce(stem.try_cast("int"), F.lit(1_000_000_000))


def cell_size(text: Column) -> Column:
    """struct<width, height> of 140x120."""
    return F.struct(F.regexp_extract(F.lower(text), "^([0-9]+)x([0-9]+)$", 1).try_cast("int").alias("width"), F.regexp_extract(F.lower(text), "^([0-9]+)x([0-9]+)$", 2).try_cast("int").alias("height"))


def data_uri(mime: Column, content: Column) -> Column:
    return F.concat(F.lit("data:"), mime, F.lit(";base64,"), F.translate(F.base64(content), "\r\n", ""))
