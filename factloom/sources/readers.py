"""Readers: whole texts, JSON documents, CSV with preambles or several header rows, listings, and path fallbacks."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.functions.text import file_key


def whole_texts(spark: SparkSession, path: str, as_name: str = "text") -> DataFrame:
    """key, path and the whole text of each file."""
    df = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias(as_name))
    return df.withColumn("key", file_key(F.col("path")))


def json_documents(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """One record for each JSON file, with its key; a file that can't be parsed gives a record with ``_corrupt``."""
    reader = spark.read.option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt")
    df = (reader.schema(schema) if schema else reader).json(path)
    return df.select("*", file_key(F.col("_metadata.file_path")).alias("_file_key"))


def outcome_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Outcomes of each file, numbered; study_id from the body or else from the file name."""
    df = json_documents(spark, path, schema)
    return df.select(F.coalesce("study_id", "_file_key").alias("study_id"), F.posexplode("outcomes").alias("pos", "o")).select("study_id", (F.col("pos") + 1).alias("outcome_number"), "o.*")


def csv_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, multiLine=True, escape='"', mode="PERMISSIVE")


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    """Raw rows of one file in file order: a multi-line file is read by a single task, so its row ids follow the file."""
    return spark.read.csv(path, header=False, multiLine=True, escape='"').withColumn("__row", F.row_number().over(Window.orderBy(F.monotonically_increasing_id())))


def csv_after_preamble(spark: SparkSession, path: str, skip: int, names: dict[int, str]) -> DataFrame:
    """Rows after ``skip`` lines and a header row, with columns picked by position."""
    rows = _numbered(spark, path).where(F.col("__row") > skip + 1)
    return rows.select(*(F.col(f"_c{i}").alias(n) for i, n in sorted(names.items()) if f"_c{i}" in rows.columns), (F.col("__row") - skip - 1).alias("source_row"))


def csv_multi_header(spark: SparkSession, path: str, levels: int) -> DataFrame:
    """Names made of several header rows; a blank upper cell carries on the one to its left."""
    rows = _numbered(spark, path)
    head = rows.where(F.col("__row") <= levels).orderBy("__row").drop("__row").collect()
    carried = []
    for i, level in enumerate(head):
        out, last = [], None
        for cell in level:
            last = cell if cell not in (None, "") else (last if i < levels - 1 else None)
            out.append(last or "")
        carried.append(out)
    names, seen = [], {}
    for parts in zip(*carried):
        name = " / ".join(p for p in parts if p) or "column"
        seen[name] = seen.get(name, 0) + 1
        names.append(name if seen[name] == 1 else f"{name} ({seen[name]})")
    return rows.where(F.col("__row") > levels).drop("__row").toDF(*names)


def listing(spark: SparkSession, path: str) -> DataFrame:
    """key, path, bytes of the files of a folder, without reading them."""
    df = spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("bytes"))
    return df.withColumn("key", file_key(F.col("path"))).withColumn("kilobytes", F.col("bytes") / 1024)


def first_existing(spark: SparkSession, *paths: str) -> str:
    """The first path that exists, by whatever file system it names."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        h = jvm.org.apache.hadoop.fs.Path(p)
        if h.getFileSystem(conf).exists(h):
            return p
    raise FileNotFoundError(", ".join(paths))


def machine_records(spark: SparkSession, csv_path: str, json_path: str, schema: str | None = None) -> DataFrame:
    """The CSV of machine records if it is there, else the JSON documents; neither is an error."""
    found = first_existing(spark, csv_path, json_path)
    return csv_table(spark, found) if found == csv_path else json_documents(spark, found, schema)


def with_text(tables: DataFrame, texts: DataFrame, key: str = "key") -> DataFrame:
    """Tables with their document's text where there is one."""
    return tables.join(texts.select(key, "text"), key, "left")


def config(path: str) -> dict:
    """A YAML (or JSON) configuration as a dictionary; $NAME values are taken from the environment."""
    with open(path) as f:
        body = f.read()
    try:
        import yaml

        data = yaml.safe_load(body) or {}
    except ImportError:
        import json

        data = json.loads(body)
    return {k: os.environ.get(v[1:], "") if isinstance(v, str) and v.startswith("$") else v for k, v in data.items()}


def template(folder: str, mode: str) -> str:
    """A prompt template of a mode or phase, from a folder of text files."""
    with open(os.path.join(folder, f"{mode}.txt")) as f:
        return f.read()


def columns_named(df: DataFrame, *words: str) -> list[str]:
    """Columns whose name contains one of the words."""
    return [c for c in df.columns if any(w.lower() in c.lower() for w in words)]


def metadata_rows(df: DataFrame, key: str, id_col: str, year: str) -> DataFrame:
    """Rows with a key; the id as text and the year as a number or null."""
    return df.where(F.col(key).isNotNull()).withColumns({id_col: F.col(id_col).cast("string"), year: F.col(year).cast("string").try_cast("double").cast("int")})


def not_blank(c: Column, placeholders: list[str]) -> Column:
    return c.isNotNull() & ~c.cast("string").isin(placeholders)
