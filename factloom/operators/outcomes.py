"""Outcome statistics: grouping, validation, quality, flattening, completeness and repair of missing values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import text as T

#: Columns of a flat record, in export order.
RECORD = ["study_id", "key", "outcome_name", "outcome_description", "treatment_arm", "subgroup", "table_number", "effect_size", "standard_error", "p_value", "confidence_interval", "sample_size", "literal_text", "text_position"]
MAX_EFFECT, MAX_P = 1000, 1


def present(c: Column, is_text: bool) -> Column:
    """Not null and, for texts, not empty; a zero is present."""
    return c.isNotNull() & (c != "") if is_text else c.isNotNull()


def group_outcomes(stats: DataFrame, key: list[str], name: str, description: str, order: str, table: str, arm: str, subgroup: str, members: list[str] | None = None) -> DataFrame:
    """One row for each outcome name of a key: first description in arrival order, number of statistics, the distinct tables, arms
    and subgroups (sorted, empty ones skipped), and with ``members`` the statistics themselves in arrival order."""
    some = lambda c: F.array_sort(F.collect_set(F.when(F.col(c).cast("string") != "", F.col(c).cast("string"))))
    aggs = [F.min_by(description, order).alias("outcome_description"), F.count("*").alias("num_variations"), some(table).alias("tables"), some(arm).alias("treatment_arms"), some(subgroup).alias("subgroups")]
    if members:
        aggs.append(F.array_sort(F.collect_list(F.struct(order, *members))).alias("statistics"))
    return stats.groupBy(*key, F.coalesce(F.col(name), F.lit("Unknown")).alias("outcome_name")).agg(*aggs)


def mapping_summary(groups: DataFrame) -> DataFrame:
    """Total statistics, distinct outcomes, outcomes with several variations, distinct tables."""
    tables = groups.select(F.explode("tables").alias("t")).agg(F.countDistinct("t").alias("n_tables"))
    return groups.agg(F.sum("num_variations").alias("total_statistics"), F.count("*").alias("unique_outcomes"), F.count_if(F.col("num_variations") > 1).alias("multi_arm")).crossJoin(tables)


def validation(stats: DataFrame, checks: dict[str, Column], complete: list[str], by: list[str] | None = None) -> DataFrame:
    """Totals, complete rows (all of the ``complete`` checks), rows that fail each check, and the rate of complete rows."""
    ok = F.lit(True)
    for name in complete:
        ok = ok & F.coalesce(checks[name], F.lit(False))
    out = stats.groupBy(*(by or [])).agg(F.count("*").alias("total"), F.count_if(ok).alias("complete"), *(F.count_if(~F.coalesce(c, F.lit(False))).alias(f"missing_{name}") for name, c in checks.items()))
    return out.withColumn("completeness_rate", F.coalesce(F.try_divide("complete", "total"), F.lit(0.0)))


def issue_codes(checks: dict[str, Column]) -> Column:
    """Names of the failed checks, in the order of the checks."""
    return F.filter(F.array(*(F.when(~F.coalesce(c, F.lit(False)), F.lit(f"missing_{name}")) for name, c in checks.items())), lambda x: x.isNotNull())


def quality(records: DataFrame, missing: dict[str, Column], rules: dict[str, Column]) -> DataFrame:
    """One row: records, aggregate issues (a kind with any missing row is one), row issues, quality score (may be negative), clean rows."""
    out = records.agg(F.count("*").alias("records"), *(F.count_if(c).alias(f"n_{k}") for k, c in (missing | rules).items()), F.count_if(~_any(rules.values())).alias("clean_rows"))
    issues = F.lit(0).cast("long")
    for k in missing:
        issues = issues + (F.col(f"n_{k}") > 0).cast("long")
    for k in rules:
        issues = issues + F.col(f"n_{k}")
    out = out.withColumn("issues", issues)
    return out.withColumn("quality_score", F.when(F.col("records") == 0, 0.0).otherwise(1 - F.col("issues") / F.col("records"))).withColumn("clean_row_rate", F.coalesce(F.try_divide("clean_rows", "records"), F.lit(0.0)))


def _any(columns) -> Column:
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(c, F.lit(False))
    return out


def flatten_groups(groups: DataFrame, study_id: str = "study_id", key: str = "key") -> DataFrame:
    """Flat records of nested groups, with the group's name and description on each; group order, then statistic order."""
    s = groups.select(study_id, key, "outcome_name", "outcome_description", F.posexplode("statistics").alias("pos", "s"))
    inner = [c for c in RECORD if c not in ("study_id", "key", "outcome_name", "outcome_description")]
    names = set(groups.schema["statistics"].dataType.elementType.names)
    return s.select(F.col(study_id).alias("study_id"), F.col(key).alias("key"), "outcome_name", "outcome_description", *((F.col(f"s.{c}") if c in names else F.lit(None).cast("string")).alias(c) for c in inner), "pos")


def explode_outcomes(papers: DataFrame, keep: list[str], outer: bool = False) -> DataFrame:
    """One row for each outcome; with ``outer`` a paper without outcomes gives one row of nulls."""
    e = F.explode_outer("outcomes") if outer else F.explode("outcomes")
    return papers.select(*keep, e.alias("o")).select(*keep, "o.*")


def component_columns(df: DataFrame, components: str, names: list[str]) -> DataFrame:
    return df.select("*", *(F.col(components).getItem(n).alias(f"component_{n}") for n in names)).drop(components)


def repair(stats: DataFrame, literal: str = "literal_text", effect: str = "effect_size", se: str = "standard_error", n: str = "n_observations") -> DataFrame:
    """Fill missing effect, standard error and observations from literal text, with flags for what was filled."""
    due = T.should_parse(F.col(literal), F.col(effect), F.col(se))
    parts = {effect: T.parsed_effect(F.col(literal)), se: T.parsed_se(F.col(literal)), n: T.parsed_observations(F.col(literal))}
    flags = {effect: "_parsed_effect", se: "_parsed_se", n: "_parsed_obs"}
    new = {c: F.when(due, T.fill(F.col(c), p)).otherwise(F.col(c)) for c, p in parts.items()}
    marks = {flags[c]: due & T.filled(F.col(c), p) for c, p in parts.items()}
    return stats.withColumns(marks | {"_eligible": due} | new)


def completeness(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """field, non_null, total, pct for each column that isn't internal; 0 for an empty input."""
    columns = columns or [c for c in df.columns if not c.startswith("_")]
    wide = df.agg(F.count("*").alias("total"), *(F.count(c).alias(c) for c in columns))
    pairs = ", ".join(f"'{c}', `{c}`" for c in columns)
    return wide.selectExpr("total", f"stack({len(columns)}, {pairs}) AS (field, non_null)").select("field", "non_null", "total", F.when(F.col("total") == 0, 0.0).otherwise(F.col("non_null") * 100.0 / F.col("total")).alias("pct"))


def table_results(requested: DataFrame, extracted: DataFrame, by: list[str]) -> DataFrame:
    """Outcomes for each requested table and whether it gave any."""
    counts = extracted.groupBy(*by).agg(F.count("*").alias("outcomes_found"))
    return requested.select(*by).distinct().join(counts, by, "left").select(*by, F.coalesce("outcomes_found", F.lit(0)).alias("outcomes_found"), F.col("outcomes_found").isNotNull().alias("extraction_success"))


def merge_sources(tei: DataFrame, pdf: DataFrame) -> DataFrame:
    """All statistics of both sources under one schema; the fallback's own field names are brought to the common ones first."""
    names = {"_table_number": "table_number", "n_observations": "sample_size"}
    for old, new in names.items():
        if old in pdf.columns:
            pdf = pdf.withColumn(new, F.coalesce(F.col(new), F.col(old)) if new in pdf.columns else F.col(old)).drop(old)
    if {"ci_lower", "ci_upper"} <= set(pdf.columns):
        pdf = pdf.withColumn("confidence_interval", F.when(F.col("ci_lower").isNotNull(), F.format_string("[%s, %s]", "ci_lower", "ci_upper"))).drop("ci_lower", "ci_upper")
    return tei.withColumn("_supplemented", F.lit(False)).unionByName(pdf.withColumn("_supplemented", F.lit(True)), allowMissingColumns=True)


def conversion(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Totals of two extraction stages over all keys of the first, and how many rows of the second come from one of the first."""
    a, b = (df.groupBy(key).agg(F.count("*").alias(n)) for df, n in ((first, "first_rows"), (second, "second_rows")))
    both = a.join(b, key, "left").agg(F.count("*").alias("papers"), F.sum("first_rows").alias("first_rows"), F.coalesce(F.sum("second_rows"), F.lit(0)).alias("second_rows"))
    return both.withColumn("ratio", F.coalesce(F.try_divide("second_rows", "first_rows"), F.lit(0.0)))


def category_completeness(df: DataFrame, categories: dict[str, list[str]]) -> DataFrame:
    """category, filled, cells, pct: filled cells (not null, not blank) over all columns of each category; 0 for an empty input."""
    filled = lambda c: (F.trim(F.col(c).cast("string")) != "").cast("long")
    wide = df.agg(F.count("*").alias("rows"), *(F.coalesce(F.sum(sum((F.coalesce(filled(c), F.lit(0)) for c in columns), F.lit(0))), F.lit(0)).alias(name) for name, columns in categories.items()))
    cells = ", ".join(f"'{name}', `{name}`, rows * {len(columns)}" for name, columns in categories.items())
    long = wide.selectExpr(f"stack({len(categories)}, {cells}) AS (category, filled, cells)")
    return long.withColumn("pct", F.coalesce(F.try_divide(F.col("filled") * 100.0, "cells"), F.lit(0.0)))


def source_counts(df: DataFrame, source: str, *tables: str) -> DataFrame:
    """Rows and distinct tables of each source; a row's table is the first of the given columns that isn't null."""
    return df.groupBy(source).agg(F.count("*").alias("outcomes"), F.countDistinct(F.coalesce(*tables)).alias("n_tables"))


def completeness_scores(df: DataFrame, columns: list[str], high: float = 0.7) -> DataFrame:
    """Rows whose share of filled columns is at least ``high``, and the mean share (0 for an empty input)."""
    share = sum((F.col(c).isNotNull().cast("int") for c in columns), F.lit(0)) / len(columns)
    return df.agg(F.count("*").alias("rows"), F.count_if(share >= high).alias("high_rows"), F.round(F.coalesce(F.avg(share), F.lit(0.0)), 9).alias("mean_share"))
