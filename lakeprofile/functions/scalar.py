"""Scalar expressions over paths, content, text and numbers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lakeprofile.functions import patterns as P


# ---- paths -------------------------------------------------------------------------------------------

def directory(path: Column) -> Column:
    """Everything up to and including the last slash."""
    return F.regexp_extract(path, r"^(.*/)([^/]*)$", 1)


def file_name(path: Column) -> Column:
    """Everything after the last slash."""
    return F.regexp_extract(path, r"^(?:.*/)?([^/]*)$", 1)


def extension(file: Column) -> Column:
    """Text after the last dot with its case kept, or the literal ``no extension``."""
    return F.when(file.contains("."), F.substring_index(file, ".", -1)).otherwise(F.lit("no extension"))


def is_hidden(file: Column) -> Column:
    return file.startswith(".")


# ---- content -----------------------------------------------------------------------------------------

def decoded_text(content: Column) -> Column:
    """Content as text: UTF-8 where valid, otherwise one character per byte."""
    return F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(
        F.decode(content, "ISO-8859-1")
    )


def media_type(content: Column) -> Column:
    """Media type from leading signatures, then from what the text starts with."""
    head = F.hex(F.substring(content, 1, 8))
    text = decoded_text(content)
    start = F.lower(F.ltrim(F.substring(text, 1, 256)))
    result = F.when(F.octet_length(content) == 0, F.lit("inode/x-empty"))
    for signature, name in P.SIGNATURES:
        result = result.when(head.startswith(signature), F.lit(name))
    return (
        result.when(text.rlike(P.NON_TEXT), F.lit("application/octet-stream"))
        .when(start.startswith("<?xml"), F.lit("text/xml"))
        .when(start.startswith("<html") | start.startswith("<!doctype html"), F.lit("text/html"))
        .otherwise(F.lit("text/plain"))
    )


def route(extension_: Column, mime: Column) -> Column:
    """Which reader a file goes to: array file, text, or system facts only."""
    return (
        F.when(F.lower(extension_).contains("nc"), F.lit("array"))
        .when(mime.contains("text") | mime.contains("csv") | mime.contains("xml"), F.lit("text"))
        .otherwise(F.lit("other"))
    )


# ---- text --------------------------------------------------------------------------------------------

def strip(text: Column) -> Column:
    """Remove white space of every kind at both ends (plain ``trim`` only removes spaces)."""
    return F.trim(text, F.lit(P.WHITE_SPACE))


def is_blank(text: Column) -> Column:
    """Whether a text holds nothing but white space."""
    return F.ltrim(text, F.lit(P.WHITE_SPACE)) == ""


def split_lines(text: Column) -> Column:
    """The lines of a text, as split by `P.EOL`; splitting by one plain character needs no pattern."""
    return F.split(F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n")), "\n", -1)


def strip_tags(text: Column) -> Column:
    """Remove from the first ``<`` to the last ``>`` of each line."""
    return F.regexp_replace(text, P.TAG, "")


def words(text: Column) -> Column:
    """Runs of at least three ASCII letters, case kept."""
    return F.regexp_extract_all(text, F.lit(P.WORD), F.lit(0))


def has_words(text: Column) -> Column:
    """Whether a text has a word outside of its tags. What stands before the first ``<`` is in no tag and decides most texts."""
    return F.substring_index(text, "<", 1).rlike(P.WORD) | (text.contains("<") & strip_tags(text).rlike(P.WORD))


def digit_share(text: Column, sample_chars: int | None = P.DIGIT_SAMPLE_CHARS) -> Column:
    """Share of digits in the head sample of a text (whole text with ``sample_chars=None``); NULL if empty."""
    sample = text if sample_chars is None else F.substring(text, 1, sample_chars)
    digits = F.length(sample) - F.length(F.regexp_replace(sample, "[0-9]+", ""))
    return digits / F.nullif(F.length(sample), F.lit(0))


def is_prose(text: Column) -> Column:
    return F.coalesce(digit_share(text) < P.PROSE_DIGIT_SHARE, F.lit(False))


# ---- fields and numbers ------------------------------------------------------------------------------

def is_number(field: Column) -> Column:
    """Whether a stripped field reads as a floating-point literal, ``nan`` and ``inf`` included."""
    return field.rlike(P.NUMBER)


def is_number_or_missing(field: Column) -> Column:
    return field.isNull() | is_number(field)


def to_number(field: Column) -> Column:
    """Finite value of a field or NULL; negative zero becomes zero so that equal values compare equal."""
    value = literal_value(field)
    return F.when(is_finite(value), value)


def literal_value(field: Column) -> Column:
    """`to_number` without its last step: a literal too large for a double is infinite here."""
    return F.when(field.rlike(P.FINITE_NUMBER), field.try_cast("double")) + F.lit(0.0)


def is_finite(value: Column) -> Column:
    return F.abs(value) < F.lit(float("inf"))


def split_fields_by(line: Column, delimiter: str) -> Column:
    """Stripped fields of a line; blank ones are dropped unless the delimiter is a comma."""
    parts = F.transform(F.split(line, dict(P.DIALECTS)[delimiter], -1), strip)
    return parts if delimiter == "," else F.filter(parts, lambda x: x != "")


def is_header_row(fields: Column) -> Column:
    """A row without a single numeric field."""
    return ~F.exists(fields, is_number)


def header_names(fields: Column) -> Column:
    """Lower-cased fields of a header row without blanks."""
    return F.transform(F.filter(fields, lambda x: x != ""), F.lower)


def decimal_places(value: Column) -> Column:
    """Number of decimals of a value as it is written: the digits behind the point of its text, less its exponent."""
    text = value.cast("string")
    digits = F.length(F.regexp_extract(text, r"\.(\d*?)0*(?:E.*)?$", 1))
    exponent = F.coalesce(F.nullif(F.regexp_extract(text, "E(.*)$", 1), F.lit("")).cast("int"), F.lit(0))
    return F.greatest(digits - exponent, F.lit(0))


def max_precision(values: Column) -> Column:
    """Decimals of the most precise value of an array."""
    return F.array_max(F.transform(values, decimal_places))


def round_half_away(value: Column, places: Column) -> Column:
    """Round to a number of places that may differ from row to row, halves away from zero."""
    scale = F.pow(F.lit(10.0), places)
    scaled = F.abs(value) * scale + 0.5
    # From 2**53 on every double is an integer already.
    return F.when(scaled < float(2**53), F.signum(value) * F.floor(scaled) / scale).otherwise(value)


def without_sentinel(value: Column, sentinel: Column) -> Column:
    """NULL where a value lies within one unit of a non-zero sentinel."""
    hit = sentinel.isNotNull() & (sentinel != 0) & (F.abs(value - sentinel) < P.SENTINEL_EPSILON)
    return F.when(hit, F.lit(None).cast("double")).otherwise(value)


# ---- arrays of numbers -------------------------------------------------------------------------------

def item(values: Column, position: int) -> Column:
    """Zero-based array element, NULL past the end."""
    return F.get(values, F.lit(position))


# The names and the order of the features in training files.
FEATURE_NAMES = (
    "min_1", "min_diff_1", "min_2", "min_diff_2", "min_3",
    "max_1", "max_diff_1", "max_2", "max_diff_2", "max_3",
)


def extreme_features(smallest: Column, largest: Column) -> dict[str, Column]:
    """The ten column features by name: three extremes a side and the gaps between them."""
    lo = [item(smallest, i) for i in range(3)]
    hi = [item(largest, i) for i in range(3)]
    values = (
        lo[0], lo[1] - lo[0], lo[1], lo[2] - lo[1], lo[2],
        hi[0], hi[0] - hi[1], hi[1], hi[1] - hi[2], hi[2],
    )
    return dict(zip(FEATURE_NAMES, values))


def feature_array(smallest: Column, largest: Column) -> Column:
    """The ten features as one array with zero for what is missing."""
    values = extreme_features(smallest, largest).values()
    return F.array(*[F.coalesce(v, F.lit(0.0)) for v in values])


def fill_missing_with_zero(values: Column) -> Column:
    """NULL, NaN and positive infinity become zero; negative infinity stays."""
    return F.transform(
        values,
        lambda x: F.when(x.isNull() | F.isnan(x) | (x == F.lit(float("inf"))), F.lit(0.0)).otherwise(x),
    )


def normalise(weights: Column) -> Column:
    """Scale an array of topic structs so that the weights sum to one."""
    total = F.aggregate(weights, F.lit(0.0), lambda acc, x: acc + x["weight"])
    return F.transform(
        weights, lambda x: F.struct(x["topic"].alias("topic"), F.try_divide(x["weight"], total).alias("weight"))
    )


def strongest_topic(topics: Column) -> Column:
    """Topic of the largest weight, the smaller topic on equal weights."""
    keyed = F.transform(topics, lambda x: F.struct(x["weight"].alias("w"), (-x["topic"]).alias("t")))
    return (-F.array_max(keyed)["t"]).cast("int")


# ---- composition -------------------------------------------------------------------------------------

def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often the body uses it.

    A plain intermediate column may be inlined by the optimizer into each use, even into a lambda that runs
    per array element; a lambda variable is not.
    """
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))
