"""Scores that tell tables of results from other tables, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The vocabularies of the scores.
RESULT_KEYWORDS = [
    "impact", "effect", "estimate", "result", "outcome", "coefficient", "treatment", "intervention", "program",
    "regression", "ols", "fixed effect", "difference-in-difference", "did", "iv", "instrumental variable", "rct", "randomized",
    "rdd", "regression discontinuity", "propensity score", "psm", "matching", "synthetic control", "interrupted time series", "its",
    "difference in differences", "difindif", "panel data", "model", "models", "specification", "estimation",
    "logit", "probit", "tobit", "poisson", "negative binomial", "fixed effects", "random effects", "gls", "gmm",
    "2sls", "two stage", "control function", "randomized controlled trial", "randomized control trial", "randomised", "experimental", "trial",
    "income", "consumption", "expenditure", "employment", "education", "health", "nutrition", "poverty", "asset", "saving", "productivity",
]
DESCRIPTIVE_KEYWORDS = ["summary statistics", "descriptive statistics", "sample characteristics", "baseline characteristics", "balance", "attrition", "sample size", "demographic", "respondent characteristics"]
STATISTICAL_HEADERS = [
    "coef", "coefficient", "estimate", "beta", "b", "se", "std. err", "standard error", "std err",
    "p-value", "p value", "t-stat", "t-statistic", "z-stat", "sig", "significance", "*", "**", "***",
    "ci", "95% ci", "confidence interval", "(1)", "(2)", "(3)", "(4)", "(5)", "(6)", "(7)", "(8)",
]
FIGURE_KEYWORDS = ["figure", "fig.", "fig ", "chart", "graph", "diagram", "plot"]
FIGURE_SCORE, THRESHOLD, CONTEXT_CHARS = -999.0, 0.55, 500


def _has(text: Column, word: str, compat: bool) -> Column:
    """Whether the word occurs: anywhere in compat mode, else between word boundaries."""
    if compat or not re.search(r"\w", word):
        return text.contains(word)
    word = word.strip()
    return F.regexp_like(text, F.lit((r"\b" if word[0].isalnum() else "") + re.escape(word) + (r"s?\b" if word[-1].isalnum() else "")))


def hits(text: Column, words: list[str], compat: bool = False) -> Column:
    """Number of the words that occur."""
    total = F.lit(0)
    for word in words:
        total = total + _has(text, word, compat).cast("int")
    return total


def _any(text: Column, words: list[str], compat: bool) -> Column:
    out = F.lit(False)
    for word in words:
        out = out | _has(text, word, compat)
    return out


def caption_score(caption: Column, result=RESULT_KEYWORDS, descriptive=DESCRIPTIVE_KEYWORDS, figure=FIGURE_KEYWORDS, compat: bool = False) -> Column:
    low = F.lower(caption)
    n = hits(low, result, compat)
    return F.when(F.coalesce(F.length(caption), F.lit(0)) == 0, 0.5).when(_any(low, figure, compat), FIGURE_SCORE).when(_any(low, descriptive, compat), 0.1).when(n >= 2, 0.9).when(n == 1, 0.7).otherwise(0.5)


def header_text(rows: Column) -> Column:
    """Text of the cells of a table's first three rows."""
    cells = F.flatten(F.transform(F.slice(rows, 1, 3), lambda row: F.transform(row["cells"], lambda cell: F.lower(F.coalesce(cell["text"], F.lit(""))))))
    return F.concat(F.lit(" "), F.array_join(cells, " "))


def header_score(text: Column, n_rows: Column | None = None, words=STATISTICAL_HEADERS, compat: bool = False) -> Column:
    stats, columns = hits(text, words, compat), F.regexp_count(text, F.lit(r"\(\d+\)"))
    score = F.when((stats >= 3) | (columns >= 3), 0.9).when((stats >= 1) | (columns >= 1), 0.7).otherwise(0.3)
    return score if n_rows is None else F.when(F.coalesce(n_rows, F.lit(0)) < 2, 0.5).otherwise(score)


def contexts(text: Column, marker: str, size: int = CONTEXT_CHARS) -> Column:
    """Text around each occurrence of the (literal) marker: up to size characters on either side, windows may overlap."""
    pieces = F.split(text, re.escape(marker), -1)
    around = lambda i: F.concat(F.right(F.array_join(F.slice(pieces, 1, i), marker), F.lit(size)), F.lit(marker), F.left(F.array_join(F.slice(pieces, i + 1, F.size(pieces)), marker), F.lit(size)))
    return F.when(F.size(pieces) > 1, F.transform(F.sequence(F.lit(1), F.size(pieces) - 1), around)).otherwise(F.array().cast("array<string>"))


def context_score(text: Column, markers: list[str], words=RESULT_KEYWORDS, compat: bool = False) -> Column:
    """Share of the markers' contexts with a result word, as a score; no text or no reference is 0.5."""
    found = F.flatten(F.array(*(contexts(F.lower(text), m) for m in markers)))
    share = F.size(F.filter(found, lambda c: _any(c, words, compat))) / F.size(found)
    return F.when((F.coalesce(F.length(text), F.lit(0)) == 0), 0.5).when(F.size(found) == 0, 0.5).when(share >= 0.5, 0.8).when(share > 0, 0.6).otherwise(0.4)


def table_markers(n: int | str) -> list[str]:
    return [f"table {n}", f"table{n}", f"tab. {n}", f"tab {n}"]


def combined_score(caption: Column, header: Column, context: Column | None = None) -> Column:
    score = caption * 0.5 + header * 0.5 if context is None else caption * 0.4 + header * 0.4 + context * 0.2
    return F.when(caption == FIGURE_SCORE, FIGURE_SCORE).otherwise(score)


def is_result(score: Column, threshold: float = THRESHOLD) -> Column:
    return score >= threshold


def default_class() -> Column:
    """What a table counts as if nothing has classified it."""
    return F.struct(F.lit("RESULTS").alias("classification"), F.lit(0.8).alias("confidence"), F.lit("default").alias("reasoning"))
