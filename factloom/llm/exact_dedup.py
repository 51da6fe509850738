"""Exact deduplication by deterministic block naming.

A normalised text is cut into blocks of BLOCK bytes. The distinct blocks are sorted and named by integers; then adjacent
names of each document are paired, the distinct pairs sorted and named again, until every document has a single name.
Documents of one name, reached at one level, are equal, and no two different texts share one: names are given to the
blocks and pairs themselves, never to their hashes. (Hashes only carry level-0 names back to the occurrences, after a
check that no two distinct blocks share one.)

Defined results: null text counts as empty; rows that agree in doc_id and text are one document, returned once,
unless every row is asked for (as the query does): then each is returned and counted; a row with null doc_id is kept only if
no equal text has an id; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import WS, cut

BLOCK = 1024
#: Stands for a null doc_id as a key.
NO_ID = -(2**63)


def normal(text: Column) -> Column:
    """The text with each run of white space replaced by one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WS, " ")


def _key(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("long"), F.lit(NO_ID)).alias("k")


def _named(rows: DataFrame, *by: str) -> DataFrame:
    """The distinct values of ``by``, sorted within their partition, with a unique integer as name."""
    return rows.select(*by).distinct().sortWithinPartitions(*by).withColumn("name", F.monotonically_increasing_id())


def _first_names(docs: DataFrame) -> DataFrame:
    """k, v, i, n, name: the name of the i-th of n blocks of the document with id k and text hash v."""
    t = docs.select(_key(F.col("doc_id")), normal(F.col("text")).alias("t")).select("k", F.xxhash64("t").alias("v"), F.col("t").cast("binary").alias("b"))
    t = t.withColumn("n", F.greatest(F.lit(1), F.ceil(F.length("b") / BLOCK).cast("int")))
    blocks = t.select("k", "v", "n", F.posexplode(F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.substring(F.col("b"), i * BLOCK + 1, F.lit(BLOCK)))).alias("i", "block"))
    for seed in range(8):
        h1, h2 = F.xxhash64(F.lit(2 * seed), "block"), F.xxhash64(F.lit(2 * seed + 1), "block")
        names = cut(_named(blocks, "block").select(h1.alias("h1"), h2.alias("h2"), "name"))
        if not names.groupBy("h1", "h2").count().where("count > 1").head(1):
            break
    return cut(blocks.select("k", "v", "i", "n", h1.alias("h1"), h2.alias("h2")).join(names, ["h1", "h2"]).select("k", "v", "i", "n", "name"))


def _paired(rows: DataFrame) -> DataFrame:
    """The next level: names of adjacent pairs of those documents that still have several names."""
    left = F.max(F.when(F.col("i") % 2 == 0, F.col("name")))
    right = F.coalesce(F.max(F.when(F.col("i") % 2 == 1, F.col("name"))), F.lit(-1))
    pairs = rows.where("n > 1").groupBy("k", "v", F.expr("i div 2").cast("int").alias("i"), F.ceil(F.col("n") / 2).cast("int").alias("n")).agg(left.alias("a"), right.alias("b"))
    names = cut(_named(pairs, "a", "b"))
    return cut(pairs.join(names, ["a", "b"]).select("k", "v", "i", "n", "name"))


def identities(docs: DataFrame) -> DataFrame:
    """k, v, level, name: one row for each document; (level, name) is the same for equal texts only."""
    rows, done, level = _first_names(docs), [], 0
    most = rows.agg(F.max("n")).first()[0] or 1
    while True:
        done.append(rows.where("n = 1").select("k", "v", F.lit(level).alias("level"), "name"))
        if most <= 1:
            break
        rows, most, level = _paired(rows), (most + 1) // 2, level + 1
    return reduce(DataFrame.unionByName, done).dropDuplicates(["k", "v"])


def groups(docs: DataFrame, every_row: bool = False) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row for each document, or for each row of docs."""
    t = docs.select("doc_id", _key(F.col("doc_id")), normal(F.col("text")).alias("t"))
    t = t.select(F.col("doc_id").cast("long").alias("doc_id"), "k", F.xxhash64("t").alias("v"), F.sha2("t", 256).alias("text_sha256"))
    if not every_row:
        t = t.dropDuplicates(["k", "v"])
    rows = cut(t.join(identities(docs), ["k", "v"]))
    sizes = cut(rows.groupBy("level", "name").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size")))
    return rows.join(sizes, ["level", "name"]).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def query(spark, sf_dir: str) -> DataFrame:
    return groups(spark.read.parquet(f"{sf_dir}/documents.parquet"), every_row=True)


ORACLE = r"""
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = min(doc_id) OVER same AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
WINDOW same AS (PARTITION BY t)
"""
