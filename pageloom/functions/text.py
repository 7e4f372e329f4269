"""Text primitives shared by every rule.

The rules are defined with ECMAScript regular expressions; Java's differ in ways that matter here. White space: long
texts go through ``plain_space`` once, after which Java's ``\\s`` means the same (a class with all the Unicode blanks
is several times slower). End of input is ``\\z``. Word boundaries are ASCII look-arounds, because Java 17 counts
accented letters as word characters in ``\\b``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space in ECMAScript beyond ASCII; the two line separators end lines there, as \\r does here.
_BLANKS = "\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u202f\u205f\u3000\ufeff"
_LINES = "\u2028\u2029"
ALL_SPACE = "\t\n\x0b\x0c\r " + _BLANKS + _LINES


def plain_space(c: Column) -> Column:
    """Unicode blanks become spaces, line separators carriage returns; texts without any pass untouched."""
    exotic = r"[\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
    has = (F.octet_length(c) > F.length(c)) & F.regexp_like(c, F.lit(exotic))
    return F.when(has, F.translate(c, _BLANKS + _LINES, " " * len(_BLANKS) + "\r\r")).otherwise(c)


def matches(c: Column, pattern: str) -> Column:
    return F.regexp_like(c, F.lit(pattern))


def found(c: Column, pattern: str, group: int = 0) -> Column:
    """First match, NULL when there is none (or when the group is empty)."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def found_all(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def occurrences(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


def replaced(c: Column, pattern: str, by: str) -> Column:
    return F.regexp_replace(c, pattern, by)


def trimmed(c: Column) -> Column:
    return F.btrim(c, F.lit(ALL_SPACE))


def collapsed(c: Column) -> Column:
    """Every run of white space becomes one blank; no blanks at the ends. For text with plain space.

    The pattern skips the single blanks that make up most text, so there is something to replace only elsewhere.
    """
    return trimmed(replaced(c, r"[\t\n\x0b\f\r]\s*| \s+", " "))


def without_tags(c: Column) -> Column:
    return replaced(c, r"<[^>]+>", " ")


def word_count_of_collapsed(c: Column) -> Column:
    """Words in already collapsed text: blanks + 1, without building an array of words."""
    return F.when(c == "", F.lit(0)).otherwise(F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit(""))) + 1)


def word_count(c: Column) -> Column:
    return word_count_of_collapsed(collapsed(c))


def scrubbed(c: Column) -> Column:
    """Text taken from pages without its control characters."""
    return F.regexp_replace(c, r"[\x00-\x1f\x7f]", "")


def clamp01(c: Column) -> Column:
    c = c.cast("double")
    return F.when(F.isnan(c), F.lit(0.0)).when(c.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)))


def round_half_up(c: Column, digits: int = 0) -> Column:
    """Rounding that sends .5 towards plus infinity (floor(x + 0.5)), unlike SQL ROUND on negatives."""
    scale = float(10**digits)
    return F.floor(c * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def any_of(c: Column, needles: list[str]) -> Column:
    """True if the lower-cased text holds one of the literals; byte search, no regular expression."""
    hit = F.lit(False)
    for needle in needles:
        hit = hit | F.contains(c, F.lit(needle))
    return hit
