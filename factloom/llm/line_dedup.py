"""Line deduplication over levelled sorted runs of line hashes.

The corpus is taken in batches of descending doc_id. A batch's line hashes become a sorted run; an anti-join with the
runs so far tells which lines are new (their holder is the batch's largest doc_id) and which only add to a count. When a
level has FANOUT runs they are merged into one of the next level. A line's key is named by 128 bits of hash.

Defined results: null or empty text is one empty line; a null doc_id ranks below every id; rows with equal doc_id count
as a document each, and all of the holding doc_id keep their lines; other columns are ignored by ``digest`` and kept by
``clean``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import WS_CHARS, ascii_lower, cut

#: Keys of at least so many code points, in at least so many documents, lose their lines.
MIN_CHARS, MIN_DOCS = 40, 5
#: Batches that the corpus is taken in, and runs of a level that are merged.
BATCHES, FANOUT = 4, 2
NO_ID = -(2**63)


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(WS_CHARS)))


def _hash(line: Column) -> Column:
    """128 bits of a line's key, null for a key below MIN_CHARS."""
    return F.transform(F.array(line_key(line)), lambda key: F.when(F.length(key) >= MIN_CHARS, F.struct(F.xxhash64(F.lit(0), key).alias("a"), F.xxhash64(F.lit(1), key).alias("b"))))[0]


def occurrences(docs: DataFrame) -> DataFrame:
    """k, a, b: each long line's hash once for each row of docs."""
    hashes = F.array_distinct(F.filter(F.transform(lines_of(F.col("text")), lambda line: _hash(line)), lambda h: h.isNotNull()))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("k"), F.explode(hashes).alias("h")).select("k", "h.a", "h.b")


class Runs:
    """Sorted runs (a, b, holder, n) in levels; holder is null in rows that only add to the count of an older row."""

    def __init__(self, fanout: int = FANOUT):
        self.fanout, self.levels = fanout, []

    def all(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    @staticmethod
    def _merge(runs: list[DataFrame]) -> DataFrame:
        return reduce(DataFrame.unionByName, runs).groupBy("a", "b").agg(F.max("holder").alias("holder"), F.sum("n").alias("n"))

    def add(self, rows: DataFrame) -> None:
        """Add a batch (k, a, b) whose ids are all below those of the batches before."""
        batch = rows.groupBy("a", "b").agg(F.max("k").alias("holder"), F.count("*").alias("n"))
        seen = self.all()
        if seen:
            batch = cut(batch)
            known = reduce(DataFrame.unionByName, [r.where(F.col("holder").isNotNull()).select("a", "b") for r in seen])
            fresh = batch.join(known, ["a", "b"], "left_anti")
            more = batch.join(known, ["a", "b"], "left_semi").withColumn("holder", F.lit(None).cast("long"))
            batch = fresh.unionByName(more)
        self._push(batch, 0)

    def _push(self, run: DataFrame, level: int) -> None:
        run = cut(run.repartition("a", "b").sortWithinPartitions("a", "b"))
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            runs, self.levels[level] = self.levels[level], []
            self._push(self._merge(runs), level + 1)

    def table(self) -> DataFrame:
        return self._merge(self.all())


def _drops(docs: DataFrame) -> DataFrame:
    """k, gone: the hashes whose lines the documents of id k lose."""
    found = cut(occurrences(docs))
    ends = found.approxQuantile("k", [i / BATCHES for i in range(1, BATCHES)], 0.05)
    runs, high = Runs(), None
    for low in [*sorted(set(ends), reverse=True), None]:
        batch = found if high is None else found.where(F.col("k") < high)
        runs.add(batch if low is None else batch.where(F.col("k") >= low))
        high = low
    common = cut(runs.table().where(F.col("n") >= MIN_DOCS).select("a", "b", "holder"))
    lost = found.join(common, ["a", "b"]).where(F.col("k") != F.col("holder"))
    return cut(lost.groupBy("k").agg(F.collect_set(F.struct("a", "b")).alias("gone")))


def _with_kept(docs: DataFrame) -> DataFrame:
    """docs with ``__lines`` and ``__kept``, arrays of lines."""
    k = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    out = docs.withColumn("__k", k).join(_drops(docs).select(F.col("k").alias("__k"), F.col("gone").alias("__gone")), "__k", "left")
    out = out.withColumn("__lines", lines_of(F.col("text")))
    kept = F.when(F.col("__gone").isNull(), F.col("__lines")).otherwise(F.filter("__lines", lambda line: ~F.coalesce(F.array_contains("__gone", _hash(line)), F.lit(False))))
    return out.withColumn("__kept", kept)


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 for every row of docs."""
    rows = _with_kept(docs.select("doc_id", "text"))
    n = F.size("__lines").cast("long")
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), n.alias("n_lines"), (n - F.size("__kept")).alias("n_dropped"), F.sha2(F.array_join("__kept", "\n"), 256).alias("kept_sha256"))


def clean(docs: DataFrame) -> DataFrame:
    """docs, all columns, with the text that is left; a null text stays null."""
    return _with_kept(docs).withColumn("text", F.when(F.col("text").isNotNull(), F.array_join("__kept", "\n"))).select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    return digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM split),
keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
common AS (SELECT key, max(doc_id) AS holder FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
marked AS (SELECT k.*, c.holder IS NOT NULL AND c.holder <> k.doc_id AS gone FROM keyed k LEFT JOIN common c ON c.key = k.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
