"""Typed comparators: each gives a struct (is_match, reason) for a machine value and a human one."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions.text import squeeze

# Codes for "can't tell", families of component answers, words that carry no content.
UNCLEAR = ["unclear", "not reported", "nr", "n/a", "na", "?", "unknown"]
YES, NO = ["1", "1.0", "yes", "y", "true"], ["0", "0.0", "no", "n", "false"]
NOT_MENTIONED = ["not mentioned", "not_mentioned", "nan", "none", ""]
STOPWORDS = ["the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "from", "as", "is", "was", "are", "were", "be"]


def _result(is_match: Column, reason: Column) -> Column:
    return F.struct(is_match.alias("is_match"), reason.alias("reason"))


def _with_nulls(a: Column, b: Column, is_match: Column, reason: Column) -> Column:
    """Both null match; a single null is named."""
    none = F.when(a.isNull() & b.isNull(), "both_null").when(a.isNull(), "llm_missing").when(b.isNull(), "human_missing")
    return _result(F.when(none == "both_null", True).when(none.isNotNull(), False).otherwise(F.coalesce(is_match, F.lit(False))), F.coalesce(none, reason))


def numeric(a: Column, b: Column, tolerance: float = 0.01) -> Column:
    """Relative difference to the human value within the tolerance; a human 0 is matched by 0 only."""
    x, y = a.try_cast("double"), b.try_cast("double")
    bad = x.isNull() | y.isNull() | F.isnan(x) | F.isnan(y)
    gap = F.when(y != 0, F.abs(x - y) / F.abs(y))
    ok = F.when(bad, False).when(y == 0, x == 0).otherwise(gap <= tolerance)
    reason = F.when(bad, "numeric_parse_error").when(ok, "numeric_match").when(y == 0, "numeric_diff_zero_base").otherwise(F.format_string("numeric_diff_%.3f", gap))
    return _with_nulls(a, b, ok, reason)


def _inside(x: Column, y: Column, compat: bool) -> Column:
    either = x.contains(y) | y.contains(x)
    return either if compat else either & (x != "") & (y != "")


def categorical(a: Column, b: Column, compat: bool = False) -> Column:
    x, y = squeeze(a.cast("string")), squeeze(b.cast("string"))
    unclear = (lambda c: F.exists(F.array(*map(F.lit, UNCLEAR)), lambda w: c.contains(w))) if compat else (lambda c: c.isin(UNCLEAR))
    reason = F.when(unclear(x) & unclear(y), "both_unclear").when(x == y, "exact_match").when(_inside(x, y, compat), "substring_match").otherwise("categorical_mismatch")
    return _with_nulls(a, b, reason != "categorical_mismatch", reason)


def component_family(c: Column) -> Column:
    x = F.lower(F.trim(c.cast("string")))
    return F.when(x.isin(YES), "yes").when(x.isin(NO), "no").when(x.isin(UNCLEAR), "unclear").when(x.isin(NOT_MENTIONED), "not_mentioned").otherwise(x)


def component(a: Column, b: Column) -> Column:
    x, y = component_family(a), component_family(b)
    return _with_nulls(a, b, x == y, F.when(x == y, "content_match").otherwise(F.format_string("component_diff_%s_vs_%s", x, y)))


def words_of(c: Column) -> Column:
    return F.array_except(F.array_distinct(F.split(squeeze(c), " ")), F.array(*map(F.lit, [*STOPWORDS, ""])))


def word_overlap(a: Column, b: Column) -> Column:
    """Jaccard similarity of the content words; null if either side has none."""
    x, y = words_of(a), words_of(b)
    return F.when((F.size(x) > 0) & (F.size(y) > 0), F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))


def text(a: Column, b: Column, compat: bool = False) -> Column:
    x, y = squeeze(a.cast("string")), squeeze(b.cast("string"))
    overlap = F.coalesce(word_overlap(a.cast("string"), b.cast("string")), F.lit(0.0))
    reason = F.when(x == y, "exact_match").when(_inside(x, y, compat), "substring_match").when(overlap > 0.5, F.format_string("word_overlap_%.2f", overlap)).otherwise("text_content_mismatch")
    return _with_nulls(a, b, reason != "text_content_mismatch", reason)


COMPARATORS = {"numeric": numeric, "categorical": categorical, "component": component, "text": text}
