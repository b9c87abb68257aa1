"""Caption patterns and text clean-up as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a caption's first line looks like, and how a figure is numbered inside a caption.
# (?iuU): case and character classes of Unicode, as the captions of a corpus need.
ANCHOR = r"(?iuU)^\s*(?:fig(?:ure)?\.?)\s*(\d{1,%d}(?:\.\d{1,2})?[a-z]?)\s*([:.\-–—|])\s*\S"
NUMBER = r"(?iuU)\bfig(?:ure)?\.?\s*(\d{1,%d}(?:\.\d{1,2})?[a-z]?)"
#: Digits that a figure's number may have before a dot, unless the settings allow more.
DIGITS = 3
#: White space, with the four separators that Java's class lacks.
_SPACE = r"(?U)[\s\x1c-\x1f]+"
#: Texts up to this length are not tried for lost word spacing; a variant with more blanks per character than this is broken.
SPACING_LENGTH, SPACING_RATIO = 40, 0.25


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def collapsed(text: Column) -> Column:
    """White space inside turned into single blanks, none at the ends."""
    return F.trim(F.regexp_replace(text, _SPACE, " "))


def anchor_number(line: Column, digits: int = DIGITS) -> Column:
    """The number of a caption's first line, empty for other lines."""
    return F.regexp_extract(stripped(line), ANCHOR % digits, 1)


def anchor_separator(line: Column, digits: int = DIGITS) -> Column:
    return F.regexp_extract(stripped(line), ANCHOR % digits, 2)


def is_anchor(line: Column, digits: int = DIGITS) -> Column:
    return stripped(line).rlike(ANCHOR % digits)


def caption_number(caption: Column, digits: int = DIGITS) -> Column:
    """The first figure number anywhere in a caption, null if there is none."""
    return F.nullif(F.regexp_extract(caption, NUMBER % digits, 1), F.lit(""))


def figure_id(number: Column) -> Column:
    return F.concat(F.lit("figure-"), F.lower(number))


def figure_label(number: Column) -> Column:
    return F.concat(F.lit("Figure "), number)


def missing_caption(label: Column) -> Column:
    return F.concat(F.lit("("), label, F.lit(" — no caption text detected)"))


def blanks(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def space_ratio(text: Column) -> Column:
    return blanks(text) / F.greatest(F.length(text), F.lit(1))


def best_spacing(default: Column, variants: Column) -> Column:
    """Of a long text and its variants the one with most blanks whose ratio is not too high (all, if none is); the first of equals. Short texts stay."""
    given = F.filter(F.concat(F.array(default), F.coalesce(variants, F.array().cast("array<string>"))), lambda t: t.isNotNull() & (t != ""))
    sane = F.filter(given, lambda t: space_ratio(t) <= SPACING_RATIO)
    pool = F.when(F.size(sane) > 0, sane).otherwise(given)
    ranked = F.transform(pool, lambda t, k: F.struct(blanks(t).alias("n"), (-k).alias("k"), t.alias("t")))
    return F.when((F.length(default) <= SPACING_LENGTH) | (F.size(pool) == 0), default).otherwise(F.array_max(ranked)["t"])


def path_stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]+)?$", 1)


def safe_name(name: Column) -> Column:
    """A directory name: other characters than letters, digits, dot, underscore and dash become underscores; ``paper`` if nothing is left."""
    plain = F.regexp_replace(name, r"[^A-Za-z0-9._-]+", "_")
    return F.coalesce(F.nullif(F.regexp_replace(plain, r"^[._]+|[._]+$", ""), F.lit("")), F.lit("paper"))


def full_text(pages: Column) -> Column:
    """Aggregate: the texts of structs (page_number, text) in page order, with an empty line between."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(pages)), lambda p: p["text"]), "\n\n")
