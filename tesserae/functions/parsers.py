"""Column expressions that read the answers of an external scorer.

What can't be read is null; strict=True raises instead.
"""

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SCORE = r"(?<![0-9])(0\.[0-9]{3})(?![0-9])"


def or_raise(value: Column, message: str, strict: bool) -> Column:
    return F.when(value.isNull(), F.raise_error(F.lit(message)).cast("string")).otherwise(value) if strict else value


def found(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def score(text: Column, strict: bool = False) -> Column:
    """A score with three decimals, from the line that says score: if there is one, else from anywhere."""
    line = found(text, r"(?im)^[ \t]*score[ \t]*:(.*)$")
    return or_raise(F.coalesce(found(line, SCORE), found(text, SCORE)), "no score with three decimals", strict)


def batch_scores(text: Column, wanted: Column | None = None, strict: bool = False) -> Column:
    """map<label, score> of lines with a label of three digits and a score, or with overall=, structure= and shape=.

    Of a label's lines the last one counts. With wanted, an array of labels, others are passed over; strict raises where
    one of these is missing, and names them.
    """
    def one(line: Column) -> Column:
        digits = [found(F.lower(line), rf"{part}\s*=\s*([0-9])") for part in ("overall", "structure", "shape")]
        joined = F.concat(F.lit("0."), *digits)
        return F.struct(found(line, r"(?<![0-9.])([0-9]{3})(?![0-9])").alias("label"), F.coalesce(joined, found(line, SCORE)).alias("score"))

    read = F.filter(F.transform(F.split(text, r"\R"), one), lambda x: x["label"].isNotNull() & x["score"].isNotNull())
    if wanted is not None:
        read = F.filter(read, lambda x: F.array_contains(wanted, x["label"]))
    last = F.filter(read, lambda x, i: ~F.exists(F.slice(read, i + 2, F.size(read)), lambda y: y["label"] == x["label"]))
    scores = F.map_from_entries(last)
    if not strict or wanted is None:
        return scores
    missing = missing_labels(scores, wanted)
    return F.when(F.size(missing) == 0, scores).otherwise(F.raise_error(F.concat(F.lit("no score for "), F.array_join(missing, ", "))).cast("map<string,string>"))


def missing_labels(scores: Column, wanted: Column) -> Column:
    """The wanted labels that a map of batch_scores() has no score for."""
    return F.array_except(wanted, F.coalesce(F.map_keys(scores), F.array().cast("array<string>")))


def boolean(text: Column, strict: bool = False) -> Column:
    low = F.lower(F.trim(text))
    value = F.when(low.isin("true", "yes"), "true").when(low.isin("false", "no"), "false")
    return or_raise(value, "neither true nor false", strict).cast("boolean")


def let(value: Column, of: Callable[[Column], Column]) -> Column:
    """of(value), with value evaluated once, not again for each use."""
    return F.transform(F.array(value), of)[0]


def entries(text: Column) -> Column:
    """array<struct<name, value>> of the lines with a colon and something after it, the name in lower case."""
    one = lambda line: F.struct(F.lower(F.trim(F.substring_index(line, ":", 1))).alias("name"), F.trim(F.regexp_replace(line, "^[^:]*:", "")).alias("value"))
    return F.filter(F.transform(F.filter(F.split(text, r"\R"), lambda x: F.instr(x, ":") > 0), one), lambda e: e["value"] != "")


def first_of(entries_: Column, name: str, *values: str) -> Column:
    """The value of the first entry of this name; with values, of the first that has one of these, in lower case."""
    wanted = lambda e: (e["name"] == name) & (F.lower(e["value"]).isin(*values) if values else F.lit(True))
    value = F.get(F.filter(entries_, wanted), F.lit(0))["value"]
    return F.lower(value) if values else value


def field(text: Column, name: str) -> Column:
    """What stands after the last name: at the beginning of a line."""
    return F.try_element_at(F.filter(entries(text), lambda e: e["name"] == name), F.lit(-1))["value"]


def label(text: Column, strict: bool = False) -> Column:
    """The first number of exactly three digits, if it lies between 000 and 799."""
    first = found(text, r"(?<![0-9])([0-9]{3})(?![0-9])")
    return or_raise(F.when(first.cast("int") <= 799, first), "no label between 000 and 799", strict)


#: The kinds of a crop, and words for no alternates.
KINDS, NO_ALTERNATES = ("single", "ligature", "bad_crop"), ("none", "n/a", "na")


def kind_in(entries_: Column) -> Column:
    return F.coalesce(first_of(entries_, "kind", *KINDS), F.lit(KINDS[0]))


def crop_kind(text: Column) -> Column:
    """The first line kind: that names one of the KINDS; single without one."""
    return kind_in(entries(text))


def alternates_in(entries_: Column, known: list[str]) -> Column:
    given = lambda first: F.when(first.isNull() | F.lower(first).isin(*NO_ALTERNATES), F.array().cast("array<string>")).otherwise(F.split(first, ","))
    return F.array_distinct(F.array_compact(F.transform(let(first_of(entries_, "alternates"), given), lambda x: known_label(F.trim(x), known))))


def alternates(text: Column, known: list[str]) -> Column:
    """The different known labels, in order, between the commas of the first line alternates:; others are dropped."""
    return alternates_in(entries(text), known)


def known_label(text: Column, known: list[str]) -> Column:
    """Parts between + and . that are all known labels, whatever their case, joined by a point; else null."""
    found_ = lambda part: F.coalesce(*(F.when(part == k.lower(), F.lit(k)) for k in known))
    parts = F.transform(F.split(F.lower(text), "[+.]"), lambda x: let(F.trim(x), found_))
    return let(parts, lambda p: F.when(~F.exists(p, lambda x: x.isNull()), F.array_join(p, ".")))


def retry_seconds(text: Column, least: float) -> Column:
    """The wait that a message asks for (try again in 250ms, or 2.5s), at least so many seconds."""
    ms, s = found(text, r"(?i)try again in ([0-9.]+)ms"), found(text, r"(?i)try again in ([0-9.]+)s")
    return F.greatest(F.coalesce(ms.cast("double") / 1000, s.cast("double"), F.lit(0.0)), F.lit(least))


def label_in(entries_: Column, text: Column, known: list[str]) -> Column:
    said = known_label(first_of(entries_, "label"), known)
    seen = lambda low: F.coalesce(*(F.when(alone(low, k.lower()), F.lit(k)) for k in sorted(known, key=len, reverse=True)), F.lit(known[0]))
    return F.coalesce(said, let(F.lower(text), seen))


def best_label(text: Column, known: list[str]) -> Column:
    """A known label: what the first line label: says, else the longest that stands in the text by itself, else the first of all."""
    return label_in(entries(text), text, known)


def alone(text: Column, word: str) -> Column:
    """Whether word stands in text, both in lower case, with no letter or digit beside it."""
    free = lambda x: ~x.rlike("[a-z0-9]")
    between = lambda pieces: F.exists(F.sequence(F.lit(1), F.size(pieces) - 1), lambda i: free(F.right(F.get(pieces, i - 1), F.lit(1))) & free(F.left(F.get(pieces, i), F.lit(1))))
    return F.when(F.contains(text, F.lit(word)), let(F.split(text, f"\\Q{word}\\E"), between)).otherwise(False)


def reasoning(text: Column) -> Column:
    """What follows the field reasoning:, up to a line of the field label: or raw:; the whole text where the field is missing or empty."""
    rest = let(F.regexp_instr(F.lower(text), F.lit(r"reasoning\s*:")), lambda start: F.when(start > 0, F.trim(F.regexp_replace(F.substring(text, start, F.length(text)), r"^[^:]*:\s*", ""))))

    def until(lines: Column) -> Column:
        ends = F.transform(lines, lambda x, i: (i > 0) & (F.instr(x, ":") > 0) & F.lower(F.trim(F.substring_index(x, ":", 1))).isin("label", "raw"))
        told = let(F.array_position(ends, F.lit(True)).cast("int"), lambda stop: F.when(stop > 0, F.slice(lines, F.lit(1), stop - 1)).otherwise(lines))
        return F.nullif(F.trim(F.array_join(told, "\n")), F.lit(""))

    return F.coalesce(let(F.split(rest, r"\R"), until), F.trim(text))


def match(text: Column, known: list[str]) -> Column:
    """struct<kind, label, alternates, reasoning> of an answer that names the sign of a crop."""
    parts = lambda e: F.struct(kind_in(e).alias("kind"), label_in(e, text, known).alias("label"), alternates_in(e, known).alias("alternates"), reasoning(text).alias("reasoning"))
    return let(entries(text), parts)
