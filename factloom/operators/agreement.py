"""Agreement of machine and human records: long comparison, metrics, and outcome-mapping recall."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.compare import COMPARATORS

# Compared fields with their comparator and the human form's column.
FIELDS = {
    "study_id": ("text", "StudyID"), "author_name": ("text", "Author name"), "year_of_publication": ("numeric", "Year of publication"),
    "program_name": ("text", "Intervention abbreviation and name"), "country": ("categorical", "Country"), "year_intervention_started": ("numeric", "First year of intervention"),
    "outcome_name": ("text", "Outcome name"), "outcome_description": ("text", "Outcome description"), "evaluation_design": ("categorical", "Evaluation Design"),
    "sample_size_treatment": ("numeric", "N treatment"), "sample_size_control": ("numeric", "N control"), "effect_size": ("numeric", "Coeff reg"), "p_value": ("numeric", "P value exact"),
    "consumption_support": ("component", "consumption_support"), "healthcare": ("component", "healthcare"), "assets": ("component", "assets"), "skills_training": ("component", "skills_training"),
    "savings": ("component", "savings"), "coaching": ("component", "coaching"), "social_empowerment": ("component", "social_empowerment"),
}
#: Columns of the human form by position.
HUMAN_COLUMNS = {2: "StudyID", 4: "Author name", 5: "Year of publication", 7: "Intervention abbreviation and name", 9: "Country", 10: "First year of intervention", 13: "consumption_support", 14: "healthcare", 15: "assets", 16: "skills_training", 17: "savings", 18: "coaching", 19: "social_empowerment", 20: "Evaluation Design", 22: "Outcome name", 23: "Outcome description", 48: "Coeff reg", 53: "P value exact", 58: "N treatment", 59: "N control"}


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in an explicit order."""
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__rn = 1").drop("__rn")


def compare_records(pairs: DataFrame, key: str, fields: dict[str, tuple[str, str, str]]) -> DataFrame:
    """Long form (key, field, is_match, llm, human, reason) of joined records; fields: name -> (type, machine column, human column)."""
    cells = [F.struct(F.lit(name).alias("field"), COMPARATORS[kind](F.col(a), F.col(b)).alias("r"), F.col(a).cast("string").alias("llm"), F.col(b).cast("string").alias("human")) for name, (kind, a, b) in fields.items()]
    return pairs.select(key, F.explode(F.array(*cells)).alias("c")).select(key, "c.field", "c.r.is_match", "c.llm", "c.human", "c.r.reason")


def match_records(llm: DataFrame, human: DataFrame, key: str, order: list[Column]) -> tuple[DataFrame, DataFrame]:
    """Machine records with the first human record of their study, and those without one."""
    first = first_by(human, [key], order)
    return llm.join(first, key), llm.join(first, key, "left_anti")


def wide(comparison: DataFrame, key: str) -> DataFrame:
    """One row for each study, with <field>_match, _llm, _human and _reason columns."""
    return comparison.groupBy(key).pivot("field").agg(F.first("is_match").alias("match"), F.first("llm").alias("llm"), F.first("human").alias("human"), F.first("reason").alias("reason"))


def agreement(comparison: DataFrame) -> DataFrame:
    """field, agreements, comparisons, rate, both_null; fields never compared are left out."""
    out = comparison.groupBy("field").agg(F.sum(F.col("is_match").cast("long")).alias("agreements"), F.count("is_match").alias("comparisons"), F.count_if(F.col("reason") == "both_null").alias("both_null"))
    return out.where("comparisons > 0").withColumn("rate", F.col("agreements") / F.col("comparisons"))


def overall(metrics: DataFrame) -> DataFrame:
    return metrics.agg(F.sum("agreements").alias("agreements"), F.sum("comparisons").alias("comparisons")).withColumn("rate", F.coalesce(F.try_divide("agreements", "comparisons"), F.lit(0.0)))


def ranked(metrics: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """The n fields of highest and of lowest agreement."""
    return metrics.orderBy(F.desc("rate"), "field").limit(n), metrics.orderBy("rate", "field").limit(n)


def study_status(human: DataFrame, llm: DataFrame, key: str, has_key: Column | None = None) -> DataFrame:
    """For each study of the human side: counts of both sides, recall, recall_capped and status."""
    h = human.groupBy(key).agg(F.count("*").alias("human_count"))
    m = llm.groupBy(key).agg(F.count("*").alias("llm_count"))
    out = h.join(m, key, "left").withColumn("llm_count", F.coalesce("llm_count", F.lit(0)))
    a, b = F.col("llm_count"), F.col("human_count")
    status = F.when(a == 0, "llm_missing").when(a == b, "exact_match").when(a > b, "llm_over_extracted").otherwise("llm_under_extracted")
    if has_key is not None:
        status = F.when(~has_key, "no_key_mapping").otherwise(status)
    recall = F.when(status != "no_key_mapping", a / b)
    return out.select(key, "human_count", "llm_count", recall.alias("recall"), F.least(recall, F.lit(1.0)).alias("recall_capped"), status.alias("status"))


def recall_totals(status: DataFrame) -> DataFrame:
    """Studies, outcomes of both sides, macro recall (studies without a key left out) and micro recall."""
    out = status.agg(F.count("*").alias("studies"), F.sum("human_count").alias("human_total"), F.sum("llm_count").alias("llm_total"), F.avg("recall").alias("macro_recall"))
    return out.withColumn("micro_recall", F.coalesce(F.try_divide("llm_total", "human_total"), F.lit(0.0)))


def worst_first(status: DataFrame, key: str) -> DataFrame:
    return status.orderBy(F.col("status") != "llm_missing", F.col("recall").asc_nulls_last(), key)


def disagreements(comparison: DataFrame, most: int = 3) -> DataFrame:
    """Mismatches of the fields that have one to ``most`` of them."""
    no = comparison.where("is_match = false")
    return no.withColumn("n", F.count("*").over(Window.partitionBy("field"))).where(F.col("n") <= most)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
