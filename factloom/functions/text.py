"""Column expressions that parse literal text: estimates, counts, table numbers, identifiers, display forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns of literal estimates, "9,079*** (1,864)", and of observation counts, "N = 500".
EFFECT_SE = r"(-?[\d,]+\.?\d*)\*{0,3}\s*\((-?[\d,]+\.?\d*|--)\)"
OBSERVATIONS = r"[Nn]\s*[=:]\s*(\d+)"
# Texts that stand for a missing value, by operator.
MISSING_FILL = ["N/A"]
MISSING_SHOWN = ["", "None", "null"]
TABLE_PATTERNS = {"label": r"table:\s*(\d+)", "strict": r"Table\s+(\d+)", "loose": r"[Tt]able\s+(\d+)"}


def found(c: Column, pattern: str, group: int = 1) -> Column:
    """A group of the pattern's first match, null without one."""
    return F.when(F.regexp_like(c, F.lit(pattern)), F.regexp_extract(c, pattern, group))


def number(c: Column) -> Column:
    """A number written with thousands separators; null if it isn't one."""
    value = F.replace(c, F.lit(","), F.lit("")).try_cast("double")
    return F.when(~F.isnan(value), value)


def parsed_effect(c: Column) -> Column:
    return number(found(c, EFFECT_SE, 1))


def parsed_se(c: Column) -> Column:
    """Standard error in the parentheses; ``--`` there is none."""
    return number(found(c, EFFECT_SE, 2))


def parsed_observations(c: Column) -> Column:
    return found(c, OBSERVATIONS).try_cast("bigint")


def is_missing(c: Column, marks: list[str] = MISSING_FILL) -> Column:
    return c.isNull() | F.coalesce(c.cast("string").isin(marks), F.lit(False))


def should_parse(literal: Column, effect: Column, se: Column) -> Column:
    """Literal text with digits in it, and an effect or standard error to fill."""
    return F.coalesce(F.regexp_like(literal, F.lit(r"\d")), F.lit(False)) & (is_missing(effect) | is_missing(se))


def fill(value: Column, parsed: Column) -> Column:
    return F.when(is_missing(value), parsed).otherwise(value)


def filled(value: Column, parsed: Column) -> Column:
    """Whether fill() used the parsed value."""
    return is_missing(value) & parsed.isNotNull()


def squeeze(c: Column) -> Column:
    """Lower-cased text with runs of white space collapsed."""
    return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))


def p_display(c: Column) -> Column:
    shown = c.cast("string")
    return F.when(shown.isNull() | shown.isin(MISSING_SHOWN), F.lit("Non sig.")).otherwise(shown)


def p_from_stars(c: Column) -> Column:
    """*** is 0.01, ** 0.05, * 0.10, none null."""
    return F.when(c.contains("***"), 0.01).when(c.contains("**"), 0.05).when(c.contains("*"), 0.10)


def table_number(c: Column, form: str = "loose") -> Column:
    return found(c, TABLE_PATTERNS[form]).try_cast("int")


def table_titles(c: Column) -> Column:
    """All (number, title) pairs of lines that name a table."""
    pattern = r"Table\s+(\d+)[.:]?\s*([^\n]*)"
    return F.arrays_zip(F.regexp_extract_all(c, F.lit(pattern), F.lit(1)).alias("number"), F.regexp_extract_all(c, F.lit(pattern), F.lit(2)).alias("title"))


def id_base(c: Column) -> Column:
    return F.substring_index(c, "_", 1)


def eppi_id(c: Column) -> Column:
    """The first run of eight or more digits in free text."""
    return found(c, r"(\d{8,})").try_cast("bigint")


def file_key(path: Column) -> Column:
    """KEY of .../KEY.tei.xml, and the plain stem of any other file."""
    return F.coalesce(found(path, r"([^/]+?)\.tei\.xml$"), found(path, r"([^/]+?)(?:\.[^./]*)?$"))


def token_estimate(c: Column) -> Column:
    return F.floor(F.length(c) / 4).cast("long")


def window_share(c: Column, window: int = 200_000) -> Column:
    return token_estimate(c) / F.lit(window) * 100


def truncated(c: Column, n: int) -> Column:
    return F.left(c, F.lit(n))


def ellipsis(c: Column, n: int = 80) -> Column:
    """At most n characters, with dots where text was cut; N/A for none."""
    return F.when(F.coalesce(F.length(c), F.lit(0)) == 0, F.lit("N/A")).when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def label(c: Column, names: dict[str, str], default: str) -> Column:
    """Display label of a coded value."""
    table = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))
    return F.coalesce(F.element_at(table, c), F.lit(default))


def citation(date: Column, title: Column, authors: Column) -> Column:
    """Year prefix, title prefix and first two authors of a library item."""
    return F.struct(F.substring(date, 1, 4).alias("year"), F.substring(title, 1, 100).alias("title"), F.array_join(F.slice(authors, 1, 2), ", ").alias("authors"))


def stamp(c: Column) -> Column:
    return F.date_format(c, "yyyyMMdd_HHmmss")


def kilobytes(length: Column) -> Column:
    return length / 1024


def guidance(outcomes: Column) -> Column:
    """Numbered list of outcomes (category, group, location, literal text) for a second extraction pass."""
    one = lambda o, i: F.concat((i + 1).cast("string"), F.lit(". "), F.coalesce(o["outcome_category"], F.lit("Unknown")), F.lit(" ("), F.coalesce(o["outcome_group"], F.lit("Other")), F.lit(") at "), F.coalesce(o["location"], F.lit("unknown location")))
    return F.array_join(F.transform(outcomes, one), "\n")


def prompt(template: str, **columns: Column) -> Column:
    """A template with {name} placeholders replaced by columns; structures are written as JSON."""
    out = F.lit(template)
    for name, c in columns.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(c, F.lit("")))
    return out
