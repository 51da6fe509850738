"""Mixing sources to target weights by pivotal dependent rounding, with DataFrame operations only.

A source's documents all want target / size copies of themselves. Whole copies are certain; the fractions left are paired
and, by a hash of the documents, words move from one to the other until one fraction is 0 or 1, so that a source's
expected words never change. Buckets of about FAN documents are rounded side by side, each leaving at most one fraction;
those meet in the next level of a reduction tree. The last fraction of a source goes to the nearer whole
number, so that the source misses its target by half of that document at most.

Defined results: null text has size 0; documents of size 0 are taken 0 times; null is a source, ordered last; rows that
agree in doc_id and text are taken each on its own; no words at all give targets of 0; other columns are ignored by
``plan`` and kept by ``mix``. Reruns agree: nothing depends on partitions or order of rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import cut, word_count

FAN, CAP, SEED = 32, 3, 20
#: Sources up to this number are broadcast to their documents, more are joined by a shuffle.
BROADCAST_SOURCES = 100_000

#: Pairs the fraction carried so far (s.c) with the next (x); the integral one goes to s.done, the other is carried on.
_ROUND = """
aggregate(items, named_struct('done', cast(array() AS array<struct<doc_id: bigint, v: bigint, rn: int, size: bigint, bit: int>>),
                              'c', cast(NULL AS struct<s: bigint, h: bigint, doc_id: bigint, v: bigint, rn: int, size: bigint, p: double, u: double>)),
  (s, x) -> CASE WHEN s.c IS NULL THEN named_struct('done', s.done, 'c', x) ELSE
    transform(array(named_struct('give', least(s.c.size * s.c.p, x.size * (1 - x.p)), 'take', least(s.c.size * (1 - s.c.p), x.size * x.p))), m ->
      CASE WHEN x.u * (m.give + m.take) < m.take THEN
        CASE WHEN s.c.size * s.c.p <= x.size * (1 - x.p)
          THEN named_struct('done', array_append(s.done, named_struct('doc_id', s.c.doc_id, 'v', s.c.v, 'rn', s.c.rn, 'size', s.c.size, 'bit', 0)),
                            'c', named_struct('s', x.s, 'h', x.h, 'doc_id', x.doc_id, 'v', x.v, 'rn', x.rn, 'size', x.size, 'p', x.p + m.give / x.size, 'u', x.u))
          ELSE named_struct('done', array_append(s.done, named_struct('doc_id', x.doc_id, 'v', x.v, 'rn', x.rn, 'size', x.size, 'bit', 1)),
                            'c', named_struct('s', s.c.s, 'h', s.c.h, 'doc_id', s.c.doc_id, 'v', s.c.v, 'rn', s.c.rn, 'size', s.c.size, 'p', s.c.p - m.give / s.c.size, 'u', s.c.u)) END
      ELSE
        CASE WHEN s.c.size * (1 - s.c.p) <= x.size * x.p
          THEN named_struct('done', array_append(s.done, named_struct('doc_id', s.c.doc_id, 'v', s.c.v, 'rn', s.c.rn, 'size', s.c.size, 'bit', 1)),
                            'c', named_struct('s', x.s, 'h', x.h, 'doc_id', x.doc_id, 'v', x.v, 'rn', x.rn, 'size', x.size, 'p', x.p - m.take / x.size, 'u', x.u))
          ELSE named_struct('done', array_append(s.done, named_struct('doc_id', x.doc_id, 'v', x.v, 'rn', x.rn, 'size', x.size, 'bit', 0)),
                            'c', named_struct('s', s.c.s, 'h', s.c.h, 'doc_id', s.c.doc_id, 'v', s.c.v, 'rn', s.c.rn, 'size', s.c.size, 'p', s.c.p + m.take / s.c.size, 'u', s.c.u)) END
      END)[0] END)
"""


def _running(rows: DataFrame, order: list, sums: dict[str, str]) -> DataFrame:
    """rows with running sums (of the rows before, in the given order) without gathering them in one task."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(rows.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()))
    inside = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # over one row for each partition
    offsets = dealt.groupBy("__part").agg(*(F.sum(c).alias(f"__{o}") for o, c in sums.items())).select("__part", *(F.coalesce(F.sum(f"__{o}").over(before), F.lit(0)).alias(f"__{o}") for o in sums))
    out = dealt.withColumns({o: F.coalesce(F.sum(c).over(inside), F.lit(0)) for o, c in sums.items()}).join(F.broadcast(offsets), "__part")
    return out.withColumns({o: F.col(o) + F.col(f"__{o}") for o in sums}).drop("__part", *(f"__{o}" for o in sums))


def targets(sizes: DataFrame) -> DataFrame:
    """g, source, n, source_size, target for each source of sizes (source, size); g is its rank by code point."""
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")).withColumn("one", F.lit(1))
    ranked = _running(sources, [F.col("source").asc_nulls_last()], {"g": "one"}).drop("one")
    ranked = ranked.withColumn("weight", F.col("g") % 3 + 1).withColumn("full", F.col("source_size") * CAP).withColumn("ratio", F.col("full") / F.col("weight"))
    filled = cut(_running(ranked, ["ratio", "g"], {"full_before": "full", "weight_before": "weight"}))
    total = filled.agg(F.sum("source_size").alias("words"), F.sum("weight").alias("weights"))
    # In order of the ratio the full sources come first; the level is what the others share for each unit of weight.
    share = (F.col("words") - F.col("full_before")) / (F.col("weights") - F.col("weight_before"))
    shared = filled.crossJoin(F.broadcast(total)).withColumn("share", share)  # total is one row
    level = shared.agg(F.min_by("share", F.struct("ratio", "g")).alias("none"), F.min(F.when(F.col("ratio") >= F.col("share"), F.struct("ratio", "g", "share"))).alias("first"))
    return cut(shared.crossJoin(F.broadcast(level)).select("g", "source", "n", "source_size", F.when(F.col("source_size") == 0, F.lit(0.0)).when(F.col("ratio") < F.coalesce(F.col("first.share"), F.col("ratio")), F.col("full").cast("double")).otherwise(F.least(F.col("weight") * F.coalesce(F.col("first.share"), F.col("none")), F.col("full").cast("double"))).alias("target")))


def _chance(*salt) -> F.Column:
    """A number in [0, 1) that is a function of a document and the salt."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(SEED), *salt, "doc_id", "v", "rn"), 11) / F.lit(float(1 << 53))


def plan(docs: DataFrame) -> DataFrame:
    """doc_id, v, rn, source, size, source_size, target, taken; v is the text's hash and rn counts rows equal in both."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("v"))
    rows = cut(rows.withColumn("rn", F.row_number().over(Window.partitionBy("doc_id", "v").orderBy(F.col("source").asc_nulls_last()))))
    sources = targets(rows)
    few = sources.count() <= BROADCAST_SOURCES
    joined = rows.withColumnRenamed("source", "own").join(F.broadcast(sources) if few else sources, F.col("own").eqNullSafe(F.col("source"))).drop("own")
    want = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    joined = joined.withColumn("want", want).withColumn("whole", F.floor(F.col("want") + 1e-12)).withColumn("p", F.greatest(F.col("want") - F.col("whole"), F.lit(0.0)))
    open_ = (F.col("p") > 1e-12) & (F.col("size") > 0)
    item = lambda level: F.struct((-F.col("size")).alias("s"), F.xxhash64(F.lit(SEED + 1), F.lit(level), "doc_id", "v", "rn").alias("h"), "doc_id", "v", "rn", "size", "p", _chance(F.lit(level)).alias("u"))
    buckets = F.greatest(F.lit(1), F.ceil(F.col("n") / FAN))
    left = joined.where(open_).select("g", F.pmod(F.xxhash64(F.lit(SEED + 2), "doc_id", "v", "rn"), buckets).alias("bucket"), item(0).alias("item"))
    most = (sources.agg(F.max("n")).first()[0] or 1) // FAN + 1
    bits, level = [], 0
    while True:
        folded = cut(left.groupBy("g", "bucket").agg(F.array_sort(F.collect_list("item")).alias("items")).select("g", "bucket", F.expr(_ROUND).alias("s")))
        bits.append(folded.select("g", F.explode("s.done").alias("d")).select("g", "d.doc_id", "d.v", "d.rn", "d.bit"))
        rest = folded.select("g", "bucket", "s.c.*").where(F.col("rn").isNotNull()).drop("s", "h", "u")
        if most <= 1:
            break
        most, level = (most - 1) // FAN + 1, level + 1
        left = rest.select("g", F.expr(f"bucket div {FAN}").alias("bucket"), item(level).alias("item"))
    bits.append(rest.select("g", "doc_id", "v", "rn", (F.col("p") >= 0.5).cast("int").alias("bit")))
    bit = reduce(DataFrame.unionByName, bits).select(F.col("doc_id").alias("d"), F.col("v").alias("w"), F.col("rn").alias("r"), "bit")
    out = joined.join(bit, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("v") == F.col("w")) & (F.col("rn") == F.col("r")), "left")
    return out.select("doc_id", "v", "rn", "source", "size", "source_size", "target", (F.col("size") * (F.col("whole") + F.coalesce(F.col("bit"), F.lit(0)))).cast("long").alias("taken"), (F.col("whole") + F.coalesce(F.col("bit"), F.lit(0))).cast("int").alias("copies"))


def mix(docs: DataFrame) -> DataFrame:
    """docs, each row as often as the mix takes it; rows without words are left out."""
    taken = cut(plan(docs).groupBy("doc_id", "v").agg(F.sum(F.when(F.col("size") > 0, F.col("copies")).otherwise(0)).alias("__copies"), F.count("*").alias("__rows")))
    taken = taken.select(F.col("doc_id").alias("__d"), F.col("v").alias("__w"), "__copies", "__rows")
    rows = docs.withColumn("__v", F.xxhash64("text")).join(taken, F.col("doc_id").cast("long").eqNullSafe(F.col("__d")) & (F.col("__v") == F.col("__w")))
    rn = F.row_number().over(Window.partitionBy("__d", "__w").orderBy(F.lit(0)))
    times = F.expr("cast(__copies div __rows AS int)") + (F.col("__rn") <= F.col("__copies") % F.col("__rows")).cast("int")
    return rows.withColumn("__rn", rn).withColumn("__times", times).where("__times > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times")))).select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    return plan(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")
