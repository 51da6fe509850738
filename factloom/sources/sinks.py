"""Sinks: phase tables, JSON by key, CSV exports, reports, id lists and file copies."""

from __future__ import annotations

import os
import shutil

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators.outcomes import RECORD


def json_by_key(df: DataFrame, path: str, key: str = "key") -> None:
    """One folder of JSON for each key."""
    df.withColumn("__part", F.col(key)).write.mode("overwrite").partitionBy("__part").json(path)


def one_csv(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").csv(path, header=True, escape='"')


def phase_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def raw_responses(df: DataFrame, path: str, key: str, response: str = "raw_response") -> DataFrame:
    """Write responses beside the phase and return the rest."""
    df.select(key, response).write.mode("overwrite").parquet(path)
    return df.drop(response)


def final_export(records: DataFrame, folder: str) -> bool:
    """JSON of all records and a CSV of the fixed columns; the CSV is skipped if there are none. Says whether it was written."""
    records.write.mode("overwrite").json(f"{folder}/json")
    some = bool(records.head(1))
    if some:
        one_csv(records.select(*(F.col(c).cast("string").alias(c) for c in RECORD)), f"{folder}/csv")
    return some


def rewrite_if_changed(old: DataFrame, new: DataFrame, target: str, changed) -> bool:
    """Write a new version beside the one read if any row of it says it changed."""
    if not new.where(changed).head(1):
        return False
    new.write.mode("errorifexists").parquet(target)
    return True


def id_list(df: DataFrame, column: str, path: str) -> None:
    """One value on each line."""
    df.select(F.col(column).cast("string")).write.mode("overwrite").text(path)


def stamped(path: str, now: str) -> str:
    base, ext = os.path.splitext(path)
    return f"{base}_{now}{ext}"


def copy_by_key(spark: SparkSession, wanted: DataFrame, files: DataFrame, folder: str, key: str = "key") -> DataFrame:
    """Copy the wanted keys' files into a folder of the driver; returns the keys without a file."""
    os.makedirs(folder, exist_ok=True)
    for row in wanted.select(key).distinct().join(files, key).select("path").toLocalIterator():
        source = row["path"].removeprefix("file:").replace("///", "/")
        shutil.copy(source, folder)
    return wanted.select(key).distinct().join(files.select(key), key, "left_anti")


def report(title: str, rows: list[tuple[str, object]]) -> str:
    """A small text report."""
    width = max((len(k) for k, _ in rows), default=0)
    return "\n".join([title, "=" * len(title), *(f"{k.ljust(width)}  {v:.3f}" if isinstance(v, float) else f"{k.ljust(width)}  {v}" for k, v in rows)])


def agreement_report(metrics: DataFrame, overall: DataFrame, low: float = 0.7) -> str:
    """Overall and per-field agreement (best first) with the fields below ``low``; reads one row for each field."""
    total = overall.first()
    fields = metrics.orderBy(F.desc("rate"), "field").collect()
    rows = [("overall", float(total["rate"])), *((r["field"], float(r["rate"])) for r in fields), *(("low", r["field"]) for r in fields if r["rate"] < low)]
    return report("Agreement", rows)


def completeness_report(fields: DataFrame, papers: int, outcomes: int) -> str:
    rows = [("papers", papers), ("outcomes", outcomes), ("outcomes per paper", outcomes / papers if papers else 0.0)]
    return report("Completeness", rows + [(r["field"], f"{r['non_null']}/{r['total']} ({r['pct']:.1f}%)") for r in fields.collect()])


def mapping_report(totals: DataFrame, status: DataFrame) -> str:
    """Recall of outcome mapping: totals, how many studies have each status (most first), and the studies, worst first."""
    from factloom.operators.agreement import worst_first

    t = totals.first()
    counts = status.groupBy("status").count().orderBy(F.desc("count"), "status").collect()
    key = status.columns[0]
    studies = [(f"study {r[key]}", f"{r['llm_count']}/{r['human_count']} {r['status']}") for r in worst_first(status, key).collect()]
    return report("Outcome mapping", [(k, t[k] if t[k] is not None else 0) for k in totals.columns] + [(r["status"], r["count"]) for r in counts] + studies)


def comparison_export(comparison: DataFrame, metrics: DataFrame, overall: DataFrame, folder: str) -> str:
    """The comparison as CSV, its metrics as JSON, and the text report, which is also returned."""
    one_csv(comparison, f"{folder}/comparison")
    metrics.write.mode("overwrite").json(f"{folder}/metrics")
    text = agreement_report(metrics, overall)
    spark = comparison.sparkSession
    spark.createDataFrame([(text,)], "value string").write.mode("overwrite").text(f"{folder}/report")
    return text


def upsert_annotations(old: DataFrame, new: DataFrame, key: list[str], at: str) -> DataFrame:
    """The latest annotation of each key among both."""
    from factloom.operators.reconcile import dedup

    return dedup(old.unionByName(new, allowMissingColumns=True), key, [F.col(at)], "last")
