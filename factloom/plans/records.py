"""The nested estimate record: its schema, empty records, flattening to one level, and contexts and totals of its tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# The sections of an estimate record with their fields, in order.
SECTIONS = {
    "general_info": "coder_name STRING, notes STRING",
    "publication_info": "study_id STRING, estimate_id STRING, author_name STRING, year_of_publication INT, publication_type STRING",
    "intervention_info": "intervention_abbreviation STRING, intervention_name STRING, intervention_description STRING, country STRING, first_year_of_intervention INT, length_of_follow_up STRING, exposure_to_intervention STRING, "
    "consumption_support STRING, healthcare STRING, assets STRING, skills_training STRING, savings STRING, coaching STRING, social_empowerment STRING",
    "method_info": "evaluation_design STRING, evaluation_method STRING",
    "outcome_info": "outcome_name STRING, outcome_description STRING, reverse_sign STRING, outcome_dataset STRING",
    "treatment_variable_info": "treatment STRING, comparison STRING, subgroup STRING, subgroup_information STRING",
    "estimate_info": "analysis_type STRING, unit_of_analysis STRING, covariate_adjustment STRING, source STRING",
    "estimate_data": "mean_pre_t DOUBLE, sd_pre_t DOUBLE, n_pre_t BIGINT, mean_pre_c DOUBLE, sd_pre_c DOUBLE, n_pre_c BIGINT, mean_post_t DOUBLE, sd_post_t DOUBLE, n_post_t BIGINT, mean_post_c DOUBLE, sd_post_c DOUBLE, n_post_c BIGINT, "
    "effect_size DOUBLE, effect_size_type STRING, regression_coefficient DOUBLE, standard_error DOUBLE, ci_lower DOUBLE, ci_upper DOUBLE, ci_level DOUBLE, p_value DOUBLE, t_statistic DOUBLE, "
    "number_of_clusters_t BIGINT, number_of_clusters_c BIGINT, correlation_pre_post DOUBLE, icc DOUBLE, estimate_notes STRING",
}
CODER, VERSION = "LLM Extraction", "1.0"


def fields(section: str) -> list[tuple[str, str]]:
    """Names and types of a section's fields."""
    return [(f.name, f.dataType.simpleString()) for f in StructType.fromDDL(SECTIONS[section]).fields]


def empty_records(studies: DataFrame, given: dict[str, Column], at: Column | None = None) -> DataFrame:
    """A nested record for each row: the given fields, the default coder and version, and null for all else."""
    given = {"coder_name": F.lit(CODER)} | given
    sections = [F.struct(*(given.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in fields(s))).alias(s) for s in SECTIONS]
    return studies.select((at if at is not None else F.current_timestamp()).alias("extraction_timestamp"), F.lit(VERSION).alias("extraction_version"), *sections)


def flat_records(records: DataFrame) -> DataFrame:
    """Nested records on one level, sections in order, then the ISO time and the version."""
    inner = [F.col(f"{s}.{name}").alias(name) for s in SECTIONS for name, _ in fields(s)]
    return records.select(*inner, F.date_format("extraction_timestamp", "yyyy-MM-dd'T'HH:mm:ss").alias("extraction_timestamp"), "extraction_version")


def table_contexts(tables: DataFrame, key: str = "key") -> DataFrame:
    """For each paper a map from table number to the title, place and (blank) surroundings that a classifier is shown."""
    shown = F.struct(F.coalesce("title", F.lit("")).alias("title"), F.coalesce("location", F.lit("")).alias("location"), F.lit("").alias("before"), F.lit("").alias("after"))
    last = tables.groupBy(key, "table_number").agg(F.max(F.struct("pos", shown.alias("c"))).alias("m"))
    return last.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("table_number", "m.c")))).alias("contexts"))


def merge_summary(merged: DataFrame, key: str = "key") -> DataFrame:
    """Tables and outcomes of each source in merged statistics (table_number, _supplemented), for each paper."""
    pdf = F.col("_supplemented")
    out = merged.groupBy(key).agg(F.countDistinct(F.when(~pdf, F.col("table_number"))).alias("tei_tables"), F.countDistinct(F.when(pdf, F.col("table_number"))).alias("pdf_tables"), F.count("*").alias("outcomes"))
    return out.withColumn("total_tables", F.col("tei_tables") + F.col("pdf_tables"))
