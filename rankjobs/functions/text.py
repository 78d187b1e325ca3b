"""Text expressions. Everything here is a native column expression, but for the
HTML entity table, which Spark lacks and which runs as an Arrow UDF."""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Unicode classes, spelt out because Java's short classes are ASCII-only and
# lack the four separator control characters.
SPACE = r"[\s\x0B\x1C-\x1F\x85\p{Z}]"
WORD = r"[\p{L}\p{N}_]"
DIGIT = r"\p{Nd}"

# The labels of the text representations, in output order.
PLAIN_LABELS = ("Title", "Tags", "Severity", "Description")
ENRICHED_LABELS = ("Normalized Title", "Original Title", "Tags", "Severity", "Description")
QUERY_PREFIX = "query: "


def as_col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def strip(value: Column | str) -> Column:
    """Trim Unicode whitespace on both ends; NULL stays NULL."""
    return F.regexp_replace(as_col(value), rf"^{SPACE}+|{SPACE}+$", "")


def text_or_empty(value: Column | str, null_word: str = "") -> Column:
    """Stripped text, with NULL as ``null_word``."""
    return F.coalesce(strip(value), F.lit(null_word))


def is_blank(value: Column | str) -> Column:
    """True for NULL, empty and whitespace-only text."""
    return F.coalesce(strip(value), F.lit("")) == ""


@F.arrow_udf(StringType())
def _unescape(values: pa.Array) -> pa.Array:
    # a few texts at a time, so that a batch is not held as Python strings as well
    parts = [
        pa.array([None if v is None else html.unescape(v) for v in values.slice(start, 256).to_pylist()], pa.string())
        for start in range(0, max(1, len(values)), 256)
    ]
    return pa.concat_arrays(parts)


def unescape_entities(value: Column | str) -> Column:
    """Only texts with an ampersand cross to Python; the others are sent as NULL and taken as they are."""
    value = as_col(value)
    return F.coalesce(_unescape(F.when(F.contains(value, F.lit("&")), value)), value)


def collapse_markup(value: Column | str) -> Column:
    """Tags to a space, whitespace runs to one space, strip, empty to NULL."""
    no_tags = F.regexp_replace(as_col(value), "<[^>]+>", " ")
    return F.nullif(strip(F.regexp_replace(no_tags, rf"{SPACE}+", " ")), F.lit(""))


def clean_html(value: Column | str) -> Column:
    """Entities are resolved first, so that escaped tags are dropped as well."""
    return collapse_markup(unescape_entities(value))


def normalize_tag_list(cleaned: Column | str, separator: str = ";") -> Column:
    """Split cleaned tag text, drop empty tags, join with ``"; "``; no tag gives NULL."""
    parts = F.filter(F.transform(F.split(as_col(cleaned), separator), strip), lambda t: t != "")
    return F.when(F.size(parts) > 0, F.array_join(parts, "; "))


def normalize_tags(value: Column | str) -> Column:
    return normalize_tag_list(clean_html(value))


def normalize_title(title: Column | str, mode: str = "a") -> Column:
    """Lower-cased title without numbers and without the digits of mixed tokens.

    Mode ``a`` looks at whitespace tokens only; mode ``b`` first blanks out every
    free-standing number, also inside punctuation.
    """
    if mode not in ("a", "b"):
        raise ValueError(f"unknown title mode: {mode!r}")
    text = F.lower(text_or_empty(title))
    if mode == "b":
        text = F.regexp_replace(text, rf"(?<!{WORD}){DIGIT}+(?!{WORD})", " ")

    def reduce_token(token: Column) -> Column:
        return (
            F.when(token.rlike(rf"^{DIGIT}+$"), F.lit(""))
            .when(token.rlike(DIGIT) & token.rlike("[a-z]"), F.regexp_replace(token, rf"{DIGIT}+", ""))
            .otherwise(token)
        )

    tokens = F.transform(F.split(text, rf"{SPACE}+"), reduce_token)
    return F.array_join(F.filter(tokens, lambda t: t != ""), " ")


def metadata_tokens(tags: Column | str, severity: Column | str, tag_separator: str = ",", null_word: str = "") -> Column:
    """``[SEV_X] [TAG_Y] ...``, or the empty string when there is neither."""

    def token(kind: str, value: Column) -> Column:
        return F.concat(F.lit(f"[{kind}_"), F.replace(F.upper(value), F.lit(" "), F.lit("_")), F.lit("]"))

    sev = text_or_empty(severity, null_word)
    names = F.filter(
        F.transform(F.split(text_or_empty(tags, null_word), f"[{tag_separator}]"), strip),
        lambda t: t != "",
    )
    head = F.when(sev != "", F.array(token("SEV", sev))).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(head, F.transform(names, lambda t: token("TAG", t))), " ")


def plain_text(title, tags, severity, description) -> Column:
    """The four-line representation."""
    parts = (title, tags, severity, description)
    return F.concat_ws(
        "\n", *(F.concat(F.lit(f"{label}: "), text_or_empty(part)) for label, part in zip(PLAIN_LABELS, parts))
    )


def enriched_text(
    title,
    tags,
    severity,
    description,
    *,
    title_mode: str = "a",
    normalized_title: bool = True,
    with_tokens: bool = True,
    tag_separator: str = ",",
    null_word: str = "",
) -> Column:
    """The five-line representation, with a line of metadata tokens when there are any.

    ``normalized_title=False`` puts the lower-cased original into the first line.
    ``null_word`` is the text a missing value turns into.
    """
    original = text_or_empty(title, null_word)
    first = normalize_title(original, title_mode) if normalized_title else F.lower(original)
    values = (
        first,
        original,
        text_or_empty(tags, null_word),
        text_or_empty(severity, null_word),
        text_or_empty(description, null_word),
    )
    lines = [F.concat(F.lit(f"{label}: "), value) for label, value in zip(ENRICHED_LABELS, values)]
    if with_tokens:
        # concat_ws skips NULL, so a row without tokens has no sixth line
        lines.append(F.nullif(metadata_tokens(tags, severity, tag_separator, null_word), F.lit("")))
    return F.concat_ws("\n", *lines)


def query_text(text: Column | str) -> Column:
    """Queries carry a prefix, corpus rows do not."""
    return F.concat(F.lit(QUERY_PREFIX), text_or_empty(text))


def tokenize(text: Column | str, longer_than: int = 0) -> Column:
    """Lower-cased word tokens in text order, repeats kept."""
    tokens = F.transform(
        F.regexp_extract_all(F.coalesce(as_col(text), F.lit("")), F.lit(f"{WORD}+"), F.lit(0)), F.lower
    )
    return F.filter(tokens, lambda t: F.length(t) > longer_than) if longer_than else tokens


def parse_id_list(value: Column | str) -> Column:
    """``[1,2]``, ``(1,2)``, ``1, 2`` and ``7`` to ids; blank to an empty list."""
    inner = F.regexp_replace(strip(value), r"^[\[(]|[\])]$", "")
    ids = F.transform(
        F.split(inner, ","),
        lambda t: F.coalesce(strip(t).try_cast("bigint"), strip(t).try_cast("double").try_cast("bigint")),
    )
    found = F.filter(ids, lambda i: i.isNotNull())
    return F.when(is_blank(value), F.array().cast("array<bigint>")).otherwise(found)


def format_id_list(ids: Column | str) -> Column:
    """Ids as JSON text, written ``[1, 2]``."""
    return F.concat(F.lit("["), F.array_join(F.transform(as_col(ids), lambda i: i.cast("string")), ", "), F.lit("]"))


def path_parts(path: Column | str, separator: str = "\\") -> Column:
    """The steps of an area path, stripped, without empty ones; none for NULL."""
    parts = F.split(F.coalesce(as_col(path), F.lit("")), re.escape(separator))
    return F.filter(F.transform(parts, strip), lambda part: part != "")


def path_prefixes(path: Column | str, separator: str = "\\") -> Column:
    """``(level, area)`` of an area path and all that it lies in, from the root (level 0, empty) on."""
    parts = path_parts(path, separator)
    return F.transform(
        F.sequence(F.lit(0), F.size(parts)),
        lambda level: F.struct(level.alias("level"), F.array_join(F.slice(parts, F.lit(1), level), separator).alias("area")),
    )


def common_depth(a: Column, b: Column) -> Column:
    """How many leading elements two arrays share."""
    steps = F.sequence(F.lit(0), F.least(F.size(a), F.size(b)))
    return F.size(F.filter(steps, lambda n: F.slice(a, F.lit(1), n) == F.slice(b, F.lit(1), n))) - 1
