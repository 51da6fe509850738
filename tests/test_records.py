"""Nested estimate records, table contexts and totals, reports and exports."""

import datetime
import json

from pyspark.sql import functions as F

from factloom.operators import agreement as A
from factloom.plans import records
from factloom.sources import sinks


def test_sections_have_all_fields():
    assert sum(len(records.fields(s)) for s in records.SECTIONS) == 61 and len(records.SECTIONS) == 8


def test_empty_and_flat_records(spark):
    at = datetime.datetime(2024, 3, 1, 4, 5, 6)
    studies = spark.createDataFrame([("121", "Ann", "2019", at), (None, None, None, None)], "id string, who string, year string, at timestamp")
    nested = records.empty_records(studies, {"study_id": F.col("id"), "author_name": F.col("who"), "year_of_publication": F.col("year")}, F.col("at"))
    assert nested.columns == ["extraction_timestamp", "extraction_version", *records.SECTIONS]
    flat = records.flat_records(nested)
    assert len(flat.columns) == 63 and flat.columns[0] == "coder_name" and flat.columns[-1] == "extraction_version"
    first = flat.where("study_id = '121'").first().asDict()
    assert first["year_of_publication"] == 2019 and first["coder_name"] == "LLM Extraction" and first["extraction_timestamp"] == "2024-03-01T04:05:06"
    assert {k for k, v in first.items() if v is not None} == {"coder_name", "study_id", "author_name", "year_of_publication", "extraction_timestamp", "extraction_version"}
    assert records.flat_records(records.empty_records(studies.limit(0), {})).count() == 0


def test_table_contexts_and_merge_summary(spark):
    t = spark.createDataFrame([("a", "2", 1, "old", "p. 1"), ("a", "2", 2, "new", None), ("a", "A1", 3, None, "p. 3")], "key string, table_number string, pos int, title string, location string")
    found = records.table_contexts(t).first()["contexts"]
    assert {k: (c["title"], c["location"], c["before"]) for k, c in found.items()} == {"2": ("new", "", ""), "A1": ("", "p. 3", "")}
    merged = spark.createDataFrame([("a", "1", False), ("a", "1", False), ("a", "2", True), ("b", None, True)], "key string, table_number string, _supplemented boolean")
    assert {r["key"]: (r["tei_tables"], r["pdf_tables"], r["outcomes"], r["total_tables"]) for r in records.merge_summary(merged).collect()} == {"a": (1, 1, 3, 2), "b": (0, 0, 1, 0)}


def test_reports_and_export(spark, tmp_path):
    pairs = spark.createDataFrame([(1, "5", "5", "yes", "1"), (2, "5", "6", "no", "1")], "id int, a string, b string, c string, d string")
    comparison = A.compare_records(pairs, "id", {"n": ("numeric", "a", "b"), "x": ("component", "c", "d")})
    metrics = A.agreement(comparison)
    text = sinks.comparison_export(comparison, metrics, A.overall(metrics), str(tmp_path))
    assert "overall" in text and "0.500" in text
    assert "\n".join(r["value"] for r in spark.read.text(str(tmp_path / "report")).collect()) == text
    assert spark.read.csv(str(tmp_path / "comparison"), header=True).count() == 4
    assert {json.loads(r["value"])["field"] for r in spark.read.text(str(tmp_path / "metrics")).collect()} == {"n", "x"}
    human = spark.createDataFrame([("s", 1), ("s", 2), ("t", 1)], "study string, n int")
    status = A.study_status(human, spark.createDataFrame([("s", 1)], "study string, n int"), "study")
    report = sinks.mapping_report(A.recall_totals(status), status)
    assert report.index("study t") < report.index("study s") and "0/1 llm_missing" in report and "1/2 llm_under_extracted" in report
