"""How many sets link with each set of a similarity graph's components, without a row for each link.

Each component has a centre, the set with the most links found so far, and every set is named by how it differs from the
centre: |A ^ B| = |a| + |b| - 2 |a & b| for the differences a, b of A, B. So with excess(A) = (den + num) |a| - (den - num) |A|,

    A and B link  <=>  excess(A) + excess(B) <= 2 (den + num) |a & b|.

Sets are dealt into blocks by their excess. Two blocks whose excesses add up to 0 at most link as a whole, and two whose least
excess is too large for any intersection don't at all: of such blocks only the sums of copies are taken. Sets of the other
pairs of blocks are compared by their differences, a pair of blocks at a time, and each gives one sum. A block holds about
BLOCK sets (fewer if they differ much from the centre), so no task holds a whole component, and no pair of sets is a row.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import cut, spread

#: Sets of a block; differences that count as one more set; sets of components of a single block that are one task.
BLOCK, HEAVY, BIN = 512, 1024, 2048
#: Steps of the excess that blocks are dealt by, on either side of 0.
STEPS = 32


def _one_component(e: np.ndarray, copies: np.ndarray, diff: list, side: np.ndarray, home: bool, m: int) -> np.ndarray:
    """For each set, the copies of the sets that it links with: those of the other side, or of its own block (home)."""
    left, right = (np.arange(len(e)),) * 2 if home else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
    out, size = np.zeros(len(e), np.int64), np.array([len(x) for x in diff], np.int64)
    names, ids = np.unique(np.concatenate(diff), return_inverse=True)
    ids = np.split(ids, np.cumsum(size)[:-1])
    none = np.array([len(names)])  # a name that no set has ends each set, so that none is empty
    there = np.concatenate([x for i in right for x in (ids[i], none)])
    start = np.cumsum(size[right] + 1) - (size[right] + 1)
    has = np.zeros(len(names) + 1, np.int32)
    for i in left:
        both = e[i] + e[right]
        linked = both <= 0
        if (~linked & (both <= 2 * m * np.minimum(size[i], size[right]))).any():
            has[ids[i]] = 1
            linked |= both <= 2 * m * np.add.reduceat(has[there], start)
            has[ids[i]] = 0
        out[i] += copies[right[linked]].sum()
        if home:
            out[i] -= copies[i] * linked[i]
        else:
            out[right[linked]] += copies[i]
    return out


def _compare(m: int):
    """k1, k2, others for the sets of a pair of blocks of one component, or of whole small components."""

    def work(pdf):
        import pandas as pd

        pdf = pdf.sort_values("comp", kind="stable")
        home = pdf["i"].iloc[0] == pdf["j"].iloc[0]
        e, copies, side, diff = pdf["e"].to_numpy(), pdf["copies"].to_numpy(), pdf["side"].to_numpy(), pdf["diff"].to_numpy()
        edge = np.append(np.flatnonzero(np.diff(pdf["comp"].to_numpy(), prepend=pdf["comp"].iloc[0] - 1)), len(pdf))
        others = np.concatenate([_one_component(e[a:b], copies[a:b], list(diff[a:b]), side[a:b], home, m) for a, b in zip(edge[:-1], edge[1:])])
        return pd.DataFrame({"k1": pdf["k1"].to_numpy(), "k2": pdf["k2"].to_numpy(), "others": others})

    return work


def linked_copies(members: DataFrame, num: int, den: int) -> DataFrame:
    """k1, k2, others: for each set the copies of all sets that it links with.

    members: comp, k1, k2 (the set's name), n (its size), copies, degree, s (its elements), once for each set, components whole;
    sets link if den * intersection >= num * union, and only within a component. Repeated rows of a set count once.
    """
    m = den + num
    centre = members.groupBy("comp").agg(F.max(F.struct("degree", "k1", "k2")).alias("c"))
    centre = members.join(centre, "comp").where("k1 = c.k1 AND k2 = c.k2").select("comp", F.col("s").alias("c")).dropDuplicates(["comp"])
    diff = F.concat(F.array_except("s", "c"), F.array_except("c", "s"))
    sets = members.join(centre, "comp").select("comp", "k1", "k2", F.col("n").cast("long").alias("n"), "copies", diff.alias("diff")).withColumn("nd", F.size("diff").cast("long"))
    sets = sets.withColumns({"e": F.col("nd") * m - F.col("n") * (den - num), "weight": F.lit(1) + F.expr(f"nd div {HEAVY}")})
    sets = cut(sets.dropDuplicates(["k1", "k2"]))
    whole = cut(sets.groupBy("comp").agg(F.sum("weight").alias("all"), F.avg("n").alias("mean")))
    sets = sets.join(whole, "comp")

    one = sets.where(F.col("all") <= BLOCK)
    bins = max(1, (whole.where(F.col("all") <= BLOCK).agg(F.sum("all")).first()[0] or 0) // BIN)
    one = one.select(F.pmod(F.xxhash64("comp"), F.lit(bins)).alias("bin"), F.lit(-1).alias("i"), F.lit(-1).alias("j"), F.lit(0).alias("side"), "comp", "k1", "k2", "e", "copies", "diff")

    many = sets.where(F.col("all") > BLOCK)
    unit = F.greatest(F.lit(1.0), F.col("mean") * (den - num) / STEPS * 2)
    many = many.withColumn("q", F.greatest(F.lit(-STEPS), F.least(F.lit(STEPS), F.ceil(F.col("e") / unit))).cast("int"))
    cells = many.groupBy("comp", "q").agg(F.sum("weight").alias("w"))
    cells = cells.withColumn("before", F.sum("w").over(Window.partitionBy("comp").orderBy("q")) - F.col("w"))  # 65 cells a component at most
    many = cut(many.join(cells, ["comp", "q"]).withColumn("block", F.expr(f"(before + pmod(xxhash64(k1, k2), w)) div {BLOCK}").cast("int")).select("comp", "block", "k1", "k2", "n", "nd", "e", "copies", "diff"))
    blocks = many.groupBy("comp", "block").agg(F.max("e").alias("e1"), F.min("e").alias("e0"), F.max("nd").alias("d1"), F.max("n").alias("n1"), F.min("n").alias("n0"), F.sum("copies").alias("copies"))
    left, right = (blocks.select("comp", *(F.col(c).alias(f"{side}_{c}") for c in blocks.columns[1:])) for side in "ij")
    fit = f"i_n1 * {den} >= j_n0 * {num} AND j_n1 * {den} >= i_n0 * {num} AND i_e0 + j_e0 <= 2 * {m} * least(i_d1, j_d1)"
    meet = cut(left.join(right, "comp").where(f"i_block <= j_block AND {fit}").withColumn("sure", F.expr("i_e1 + j_e1 <= 0")))
    sure, other = meet.where("sure"), F.col("i_block") < F.col("j_block")
    sure = sure.select("comp", F.col("i_block").alias("block"), F.col("j_copies").alias("add"), (~other).cast("int").alias("own")).unionByName(sure.where(other).select("comp", F.col("j_block").alias("block"), F.col("i_copies").alias("add"), F.lit(0).alias("own")))
    sure = many.join(sure.groupBy("comp", "block").agg(F.sum("add").alias("add"), F.sum("own").alias("own")), ["comp", "block"]).select("k1", "k2", F.expr("add - own * copies").alias("others"))
    pair = [F.col("i_block").alias("i"), F.col("j_block").alias("j")]
    open_ = meet.where("NOT sure")
    open_ = open_.select("comp", F.col("i_block").alias("block"), *pair, F.lit(0).alias("side")).unionByName(open_.where(other).select("comp", F.col("j_block").alias("block"), *pair, F.lit(1).alias("side")))
    many = many.join(open_, ["comp", "block"]).select(F.col("comp").alias("bin"), "i", "j", "side", "comp", "k1", "k2", "e", "copies", "diff")

    compared = spread(one.unionByName(many), "bin", "i", "j").groupBy("bin", "i", "j").applyInPandas(_compare(m), "k1 long, k2 long, others long")
    return compared.unionByName(sure).groupBy("k1", "k2").agg(F.sum("others").alias("others"))
