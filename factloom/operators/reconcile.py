"""Reconciliation of data sets: coverage, missing ids, duplicates, gaps, containment and overlap joins, profiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A pattern side up to this number of rows is broadcast to the texts, a larger one is taken in parts of this size.
PATTERNS = 10_000


def dedup(df: DataFrame, keys: list[str], order: list[Column], keep: str = "first") -> DataFrame:
    """One row for each key: the first or the last in an explicit order."""
    if keep == "last":
        ranked = df.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*(o.desc() for o in order))))
    else:
        ranked = df.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where("__rn = 1").drop("__rn")


def lookup(left: DataFrame, right: DataFrame, key: str, order: list[Column], keep: str = "last", how: str = "left") -> DataFrame:
    """Join with the right side made unique first, as a dictionary is."""
    return left.join(dedup(right, [key], order, keep), key, how)


def override(base: DataFrame, dim: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Columns of dim replace those of base wherever the key is known, nulls included."""
    other = dim.select(key, F.lit(True).alias("__hit"), *(F.col(c).alias(f"__{c}") for c in columns))
    joined = base.join(other, key, "left")
    return joined.withColumns({c: F.when(F.col("__hit"), F.col(f"__{c}")).otherwise(F.col(c)) for c in columns}).drop("__hit", *(f"__{c}" for c in columns))


def coverage(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """keys, in_a, in_b, side (both / a_only / b_only) over the distinct keys of both sides."""
    both = a.select(*keys, F.lit(1).alias("x"), F.lit(0).alias("y")).unionByName(b.select(*keys, F.lit(0).alias("x"), F.lit(1).alias("y")))
    out = both.groupBy(*keys).agg((F.max("x") == 1).alias("in_a"), (F.max("y") == 1).alias("in_b"))
    return out.withColumn("side", F.when(F.col("in_a") & F.col("in_b"), "both").when(F.col("in_a"), "a_only").otherwise("b_only"))


def coverage_counts(flags: DataFrame) -> DataFrame:
    """both, a_only, b_only and recall (both over all of a)."""
    out = flags.agg(F.count_if(F.col("side") == "both").alias("both"), F.count_if(F.col("side") == "a_only").alias("a_only"), F.count_if(F.col("side") == "b_only").alias("b_only"))
    return out.withColumn("recall", F.coalesce(F.try_divide(F.col("both"), F.col("both") + F.col("a_only")), F.lit(0.0)))


def reconcile(sets: dict[str, DataFrame], key: str) -> DataFrame:
    """Number of ids by their pattern of membership in several sets."""
    rows = reduce(DataFrame.unionByName, [df.select(F.col(key), *((F.lit(int(m == n))).alias(m) for m in sets)) for n, df in sets.items()])
    flags = rows.groupBy(key).agg(*(F.max(n).alias(n) for n in sets))
    return flags.groupBy(*sets).agg(F.count("*").alias("ids"))


def missing(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of a whose key isn't in b; a null key is missing."""
    return a.join(b.select(*keys).distinct(), keys, "left_anti")


def known(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return a.join(b.select(*keys), keys, "left_semi")


def classify_files(master: DataFrame, dim: DataFrame, files: DataFrame, id_col: str, key: str) -> DataFrame:
    """Each id as no_key, key_without_file or ok."""
    out = master.join(dim.select(id_col, key), id_col, "left").join(files.select(key).distinct().withColumn("__file", F.lit(True)), key, "left")
    return out.withColumn("state", F.when(F.col(key).isNull(), "no_key").when(F.col("__file").isNull(), "key_without_file").otherwise("ok")).drop("__file")


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, most frequent first."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def mark_duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.withColumn("is_duplicate", F.count("*").over(Window.partitionBy(*keys)) > 1)


def gaps(df: DataFrame, key: str, n: str) -> DataFrame:
    """key, after, before and the missing numbers between consecutive ones of a key."""
    step = df.select(key, F.col(n).cast("long").alias("after")).where("after IS NOT NULL").distinct().withColumn("before", F.lead("after").over(Window.partitionBy(key).orderBy("after")))
    return step.where("before - after > 1").withColumn("missing", F.sequence(F.col("after") + 1, F.col("before") - 1))


def natural_order(c: Column) -> list[Column]:
    """Sort keys for table ids: those that aren't numbers first, by text, then numbers by value."""
    n = c.try_cast("double")
    return [n.isNotNull(), n, c]


def contains_join(texts: DataFrame, text_id: str, fields: list[str], patterns: DataFrame, pattern_id: str, pattern: str, outer: bool = True) -> DataFrame:
    """pattern_id, text_id, match_type: one row for each field of a text that contains the pattern; with ``outer`` unmatched
    patterns give NOT FOUND. The patterns, of a checked number, are broadcast; more are taken in several passes."""
    p = patterns.select(F.col(pattern_id), F.col(pattern).cast("string").alias("__p")).where(F.length("__p") > 0)
    passes = max(1, -(-p.count() // PATTERNS))
    found = []
    for i in range(passes):
        part = p.where(F.pmod(F.xxhash64("__p", pattern_id), F.lit(passes)) == i) if passes > 1 else p
        for f in fields:
            found.append(texts.join(F.broadcast(part), F.col(f).cast("string").contains(F.col("__p"))).select(pattern_id, text_id, F.lit(f).alias("match_type")))
    hits = reduce(DataFrame.unionByName, found)
    if not outer:
        return hits
    rest = patterns.select(pattern_id).join(hits.select(pattern_id).distinct(), pattern_id, "left_anti")
    return hits.unionByName(rest.select(pattern_id, F.lit(None).cast(dict(texts.dtypes)[text_id]).alias(text_id), F.lit("NOT FOUND").alias("match_type")))


def token_overlap_join(a: DataFrame, a_id: str, b: DataFrame, b_id: str, tokens: str, least: int = 2) -> DataFrame:
    """Pairs of rows that share at least ``least`` distinct tokens: an equi-join on tokens, not all pairs."""
    x = a.select(a_id, F.explode(F.array_distinct(tokens)).alias("t"))
    y = b.select(b_id, F.explode(F.array_distinct(tokens)).alias("t"))
    return x.join(y, "t").groupBy(a_id, b_id).agg(F.count("*").alias("shared")).where(F.col("shared") >= least)


def profile(df: DataFrame, columns: list[str], blank: list[str]) -> DataFrame:
    """column, total, non_empty, distinct_values, blanks for each column."""
    wide = df.agg(F.count("*").alias("total"), *(a for c in columns for a in (F.count(F.when(F.col(c).cast("string") != "", 1)).alias(f"{c}|a"), F.countDistinct(c).alias(f"{c}|b"), F.count_if(F.coalesce(F.col(c).cast("string").isin(blank), F.lit(False))).alias(f"{c}|c"))))
    cells = ", ".join(f"'{c}', `{c}|a`, `{c}|b`, `{c}|c`" for c in columns)
    return wide.selectExpr("total", f"stack({len(columns)}, {cells}) AS (column, non_empty, distinct_values, blanks)")


def value_counts(df: DataFrame, column: str, n: int | None = None) -> DataFrame:
    out = df.groupBy(column).agg(F.count("*").alias("n"))
    return out if n is None else out.orderBy(F.desc("n"), column).limit(n)


def latest(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The last row written for each key."""
    return dedup(df, [key], order, "last")


def status_pivot(df: DataFrame, by: list[str], status: str, values: list[str]) -> DataFrame:
    """Counts of the known states as columns."""
    return df.groupBy(*by).agg(*(F.count_if(F.col(status) == v).alias(v) for v in values))
