"""The phased extraction pipeline over DataFrames: discover, classify, extract, fall back, group, validate, export.

Calls of a model are behind a client function; every phase's result is a table, so that a later run resumes from it and
never calls the model again for keys that are done.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.functions import classify, jsonrepair
from factloom.operators import outcomes as O
from factloom.operators import reconcile as R
from factloom.sources.external import call_model

TABLES = "tables_found ARRAY<STRUCT<table_number STRING, title STRING, location STRING, xml_id STRING, has_structure BOOLEAN, confidence DOUBLE>>"
CLASSES = "tables_classified ARRAY<STRUCT<table_number STRING, classification STRING, confidence DOUBLE, reasoning STRING>>"
STAT = "table_number STRING, outcome_name STRING, outcome_description STRING, treatment_arm STRING, subgroup STRING, effect_size DOUBLE, p_value DOUBLE, standard_error DOUBLE, confidence_interval STRING, sample_size BIGINT, literal_text STRING, text_position STRING"
LOW_CONFIDENCE, KEEP_CONFIDENCE = 0.5, 0.55
TEXT_LIMITS = {1: 100_000, 3: 150_000}
TABLE_BATCH, PAGE_BATCH = 5, 20


def parse(responses: DataFrame, schema: str) -> DataFrame:
    """Responses with their recovered, typed content; what can't be recovered is an empty record with a warning."""
    clean = jsonrepair.recovered(F.col("response"))
    return responses.withColumn("parsed", F.from_json(clean, schema)).withColumn("warning", F.when(clean.isNull(), "no JSON in response"))


def discovered(parsed: DataFrame, key: str = "key") -> DataFrame:
    return parsed.select(key, F.posexplode("parsed.tables_found").alias("pos", "t")).select(key, "pos", "t.*")


def discovery_warnings(tables: DataFrame, key: str = "key") -> DataFrame:
    """key, warnings: low confidence, numbers found twice, and gaps in the numbering."""
    low = tables.where(F.col("confidence") < LOW_CONFIDENCE).groupBy(key).agg(F.count("*").alias("n")).select(key, F.format_string("%d low-confidence tables", "n").alias("w"))
    twice = R.duplicates(tables, [key, "table_number"]).groupBy(key).agg(F.array_join(F.array_sort(F.collect_set("table_number")), ", ").alias("n")).select(key, F.format_string("duplicate table numbers: %s", "n").alias("w"))
    holes = R.gaps(tables.select(key, F.col("table_number").try_cast("bigint").alias("n")), key, "n").groupBy(key).agg(F.array_join(F.array_sort(F.flatten(F.collect_list("missing"))), ", ").alias("n")).select(key, F.format_string("missing table numbers: %s", "n").alias("w"))
    return low.unionByName(twice).unionByName(holes).groupBy(key).agg(F.array_sort(F.collect_list("w")).alias("warnings"))


def split_classes(classes: DataFrame, tables: DataFrame, key: str = "key") -> tuple[DataFrame, DataFrame]:
    """RESULTS tables of enough confidence (missing counts as certain), with title and location from discovery, and DESCRIPTIVE ones."""
    joined = classes.join(tables.select(key, "table_number", "title", "location"), [key, "table_number"], "left")
    sure = F.coalesce("confidence", F.lit(1.0)) >= KEEP_CONFIDENCE
    return joined.where((F.col("classification") == "RESULTS") & sure), joined.where(F.col("classification") == "DESCRIPTIVE")


def class_totals(classes: DataFrame, key: str = "key") -> DataFrame:
    return classes.groupBy(key).agg(F.count("*").alias("total_tables"), F.count_if(F.col("classification") == "RESULTS").alias("results_tables"), F.count_if(F.col("classification") == "DESCRIPTIVE").alias("descriptive_tables"))


def score_tables(tables: DataFrame, compat: bool = False) -> DataFrame:
    """Heuristic class of tables (caption, rows): what counts where no model has classified them."""
    caption = classify.caption_score(F.col("caption"), compat=compat)
    header = classify.header_score(classify.header_text(F.col("rows")), F.size("rows"), compat=compat)
    out = tables.withColumn("caption_score", caption).withColumn("header_score", header)
    return out.withColumn("score", classify.combined_score(F.col("caption_score"), F.col("header_score"))).withColumn("is_result", classify.is_result(F.col("score")))


def batches(tables: DataFrame, size: int = TABLE_BATCH, key: str = "key", order: list[Column] | None = None) -> DataFrame:
    """Tables of a key in numbered batches of a fixed size."""
    pos = F.row_number().over(Window.partitionBy(key).orderBy(*(order or R.natural_order(F.col("table_number")))))
    return tables.withColumn("batch", F.floor((pos - 1) / size).cast("int"))


def wanted_fallback(results: DataFrame, extracted: DataFrame, mode: str = "intelligent", key: str = "key") -> DataFrame:
    """Tables that the fallback must read: none (never), all (always), or those that extraction gave nothing for."""
    if mode == "never":
        return results.select(key, "table_number").limit(0)
    if mode == "always":
        return results.select(key, "table_number").distinct()
    return R.missing(results.select(key, "table_number").distinct(), extracted, [key, "table_number"])


def grouped(stats: DataFrame, key: str = "key") -> DataFrame:
    members = ["table_number", "treatment_arm", "subgroup", "effect_size", "p_value", "standard_error", "confidence_interval", "sample_size", "literal_text", "text_position"]
    return O.group_outcomes(stats, [key], "outcome_name", "outcome_description", "pos", "table_number", "treatment_arm", "subgroup", members)


def checks(prefix: str = "") -> dict[str, Column]:
    c = lambda n: F.col(prefix + n)
    return {"effect_size": O.present(c("effect_size"), False), "se": O.present(c("standard_error"), False), "p_value": O.present(c("p_value"), False), "literal": O.present(c("literal_text"), True), "position": O.present(c("text_position"), True)}


def resume(spark: SparkSession, path: str, todo: DataFrame, run: Callable[[DataFrame], DataFrame], key: str = "key") -> DataFrame:
    """Run a phase for the keys its table doesn't have yet, append them, and return the whole table."""
    try:
        done = spark.read.parquet(path).select(key).distinct()
        todo = todo.join(done, key, "left_anti")
    except Exception as e:  # no table yet
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
    run(todo).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def ask(spark: SparkSession, path: str, prompts: DataFrame, client: Callable[[str], str], schema: str, key: str = "key") -> DataFrame:
    """Call the model for new keys only, keep its responses as a table, and parse them."""
    return parse(resume(spark, path, prompts, lambda p: call_model(p, client, [key]), key), schema)
