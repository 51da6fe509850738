"""Jaccard join on word n-grams, size-aware: small sets enumerate fixed-size subsets, large sets scan inverted lists.

A document's set holds its distinct shingles of k words as 64-bit hashes. Two small sets that link share a subset of the
size that their sizes force, so each small set emits the hashes of those subsets; any other pair that links shares one of
the rarest shingles of both (prefix filter), so those sets emit postings of an inverted list. The boundary between small
and large is where the subsets' cost passes that of the postings. Sets that are equal are one node from the start.

No list is expanded into its pairs. First every member meets one leader of the list; the links found give components.
Then only lists that still hold several components are looked at again, in blocks of bounded size, where pairs of one
component, of unfit sizes, or that a 512-bit parity sketch proves too different are left out. Whatever remains is
compared exactly. So no link between different components is lost, and copies are never multiplied out. Where every link
counts (graph, and the query), pairs of one component are compared as well: each pair of different sets that link is found
once, and equal sets are counted by their number.

Defined results: null text, or text without words, has an empty set, linked with nothing; a text of fewer than k words
is one shingle; rows with null doc_id are returned with null component; rows with equal doc_id are one node of the graph;
other columns are ignored. n_links is the number of other rows that a row's set links with: null for a null doc_id, and rows
with null doc_id aren't counted; rows of one doc_id link by their own sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import cut, hash_words, mix64, ship, slices, spread, tidy
from factloom.llm.components import components
from factloom.llm.link_counts import linked_copies

#: Counters of word frequencies, 2**SKETCH; only their order matters, so collisions cost time and never a link.
SKETCH = 18
#: Sets up to this size may be small; postings that a hash of a subset is worth.
MOST_SMALL, SCAN_COST = 40, 4
#: Lists up to SHORT members are compared by a join, longer ones in blocks of BLOCK members.
SHORT, BLOCK = 48, 512
#: Ids up to this number are broadcast to fetch their texts, more are joined by a shuffle.
BROADCAST_IDS = 500_000
#: A parity sketch has 512 bits for sets up to SKETCHED shingles, twice as many for each doubling beyond.
SKETCHED, WORDS64 = 1024, 8

_M1, _M2, _SUBSET = np.uint64(0x9FB21C651E98DF25), np.uint64(0xA24BAED4963EE407), np.uint64(0xD1B54A32D192ED03)


@dataclass(frozen=True)
class Rule:
    """Shingles of k words; sets link if den * intersection >= num * union."""

    k: int
    num: int
    den: int

    def need(self, a: int, b: int) -> int:
        """Least intersection of linked sets of these sizes."""
        return -(-self.num * (a + b) // (self.num + self.den))

    def partners(self, s: int) -> range:
        return range(-(-self.num * s // self.den), self.den * s // self.num + 1)

    def prefix(self, s: int) -> int:
        return s - -(-self.num * s // self.den) + 1

    def subset_sizes(self, s: int, most: int) -> set[int]:
        return {self.need(s, r) for r in self.partners(s) if r <= most and self.need(s, r) <= s}

    def boundary(self, histogram: dict[int, int]) -> int:
        """The largest size that counts as small: where the total of subsets and postings is least."""
        def cost(most: int) -> int:
            subsets = sum(n * sum(comb(s, c) for c in self.subset_sizes(s, most)) for s, n in histogram.items() if s <= most)
            return subsets + SCAN_COST * sum(n * self.prefix(s) for s, n in histogram.items() if s > most or s >= self.partners(most + 1)[0])
        return min(range(MOST_SMALL + 1), key=lambda most: (cost(most), most))


def shingles(texts: list, k: int, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of the texts one after another, the sizes of the sets, and each shingle's weight."""
    words, n = hash_words(texts)
    first = np.cumsum(n) - n
    full = np.maximum(n - k + 1, 0)
    at = np.repeat(first - (np.cumsum(full) - full), full) + np.arange(int(full.sum()))
    doc = np.repeat(np.arange(len(texts)), full)
    load = weight[(words >> np.uint64(64 - SKETCH)).astype(np.int64)] if weight is not None else np.zeros(len(words), np.int64)
    h, w = np.full(len(at), k, np.uint64), np.zeros(len(at), np.int64)
    for j in range(k):
        h = mix64(h * _M1 + words[at + j])
        w += load[at + j]
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        extra = []
        for i in short:
            own = np.array([n[i]], np.uint64)
            for x in words[first[i] : first[i] + n[i]]:
                own = mix64(own * _M1 + x)
            extra.append((own[0], load[first[i] : first[i] + n[i]].sum()))
        h = np.concatenate([h, np.array([x for x, _ in extra], np.uint64)])
        w, doc = np.concatenate([w, [x for _, x in extra]]), np.concatenate([doc, short])
    order = np.lexsort((h, doc))
    h, w, doc = h[order], w[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], np.bincount(doc[new], minlength=len(texts)), w[new].astype(np.int64)


def _names(h: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    """The two halves of each set's 128-bit name."""
    start = np.cumsum(n) - n
    run = lambda x: np.concatenate([[np.uint64(0)], np.cumsum(x)])
    return [np.subtract(t[start + n], t[start]) for t in (run(mix64(h ^ _M1)), run(mix64(h ^ _M2)))]


def _census(docs: DataFrame, rule: Rule) -> tuple[np.ndarray, dict[int, int]]:
    """Logarithms of the word-frequency counters over all documents, and the number of sets of each size up to MOST_SMALL."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, sizes = np.zeros(1 << SKETCH, np.int64), np.zeros(2 * MOST_SMALL, np.int64)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a, b in slices(texts):
                words, n = hash_words(texts[a:b])
                total += np.bincount((words >> np.uint64(64 - SKETCH)).astype(np.int64), minlength=1 << SKETCH)
                few = [texts[a + i] for i in np.flatnonzero((n > 0) & (n < 2 * MOST_SMALL))]
                sizes += np.bincount(shingles(few, rule.k)[1], minlength=2 * MOST_SMALL)[: 2 * MOST_SMALL]
        both = np.concatenate([total, sizes])
        some = np.flatnonzero(both)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(both[some])], ["i", "n"])
        tidy()

    rows = docs.select("text").mapInArrow(work, "i int, n long").groupBy("i").agg(F.sum("n").alias("n")).toArrow()  # at most 2**SKETCH + 80 rows
    both = np.zeros((1 << SKETCH) + 2 * MOST_SMALL, np.int64)
    both[rows.column("i").to_numpy()] = rows.column("n").to_numpy()
    return np.floor(4 * np.log2(1 + both[: 1 << SKETCH])).astype(np.int16), {s: int(x) for s, x in enumerate(both[1 << SKETCH :]) if s}


def _signatures(docs: DataFrame, rule: Rule, weight: np.ndarray, small: int) -> DataFrame:
    """d, n, k1, k2, lists, bits for each row: set size, 128-bit name of the set, its lists' keys, its parity sketch."""
    held = docs.sparkSession.sparkContext.broadcast(weight)
    sizes_by = {s: sorted(rule.subset_sizes(s, small)) for s in range(1, small + 1)}
    least_scan = rule.partners(small + 1)[0]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for a, b in slices(texts):
                h, n, w = shingles(texts[a:b], rule.k, held.value)
                start, doc = np.cumsum(n) - n, np.repeat(np.arange(b - a), n)
                m1, names = mix64(h ^ _M1), _names(h, n)
                bits = (np.bincount(doc * 512 + (h & np.uint64(511)).astype(np.int64), minlength=512 * (b - a)) & 1).astype(np.uint8).reshape(-1, 512)
                bits = list(np.packbits(bits, axis=1, bitorder="little").view(np.int64))
                for i in np.flatnonzero(n > SKETCHED):
                    width = 512 << int(np.ceil(np.log2(n[i] / SKETCHED)))
                    odd = np.bincount((h[start[i] : start[i] + n[i]] & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
                    bits[i] = np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)
                order = np.lexsort((h, w, doc))
                rank = np.arange(len(h)) - np.repeat(start, n)
                take = np.array([0 if s == 0 or s < least_scan else rule.prefix(int(s)) for s in n], np.int64)
                chosen = rank < np.repeat(take, n)
                lists = np.split(h[order][chosen].view(np.int64), np.cumsum(take)[:-1])
                for i in np.flatnonzero((n > 0) & (n <= small)):
                    own, keys = m1[start[i] : start[i] + n[i]], []
                    for c in sizes_by[int(n[i])]:
                        gone = np.array([sum(int(own[j]) for j in drop) & (2**64 - 1) for drop in combinations(range(n[i]), int(n[i]) - c)], np.uint64)
                        keys.append(mix64((names[0][i] - gone) * _SUBSET + np.uint64(c)))
                    lists[i] = np.concatenate([lists[i], *(x.view(np.int64) for x in keys)])
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(n.astype(np.int32)), pa.array(names[0].view(np.int64)), pa.array(names[1].view(np.int64)), pa.array(lists, pa.list_(pa.int64())), pa.array(bits, pa.list_(pa.int64()))], ["d", "n", "k1", "k2", "lists", "bits"])
        tidy()

    return docs.select(F.col("doc_id").cast("long").alias("d"), "text").mapInArrow(work, "d long, n int, k1 long, k2 long, lists array<long>, bits array<long>")


def _sets(docs: DataFrame, ids: DataFrame, rule: Rule) -> DataFrame:
    """d, k1, k2, s: the sets of the documents with the given ids, and their names."""
    rows = docs.select(F.col("doc_id").cast("long").alias("d"), "text")
    rows = rows.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "d", "left_semi")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in slices(texts):
                h, n, _ = shingles(texts[a:b], rule.k)
                names = [pa.array(x.view(np.int64)) for x in _names(h, n)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *names, pa.array(np.split(h.view(np.int64), np.cumsum(n)[:-1]), pa.list_(pa.int64()))], ["d", "k1", "k2", "s"])
        tidy()

    return rows.mapInArrow(work, "d long, k1 long, k2 long, s array<long>")


def _sizes_fit(rule: Rule, a: str, b: str) -> Column:
    return (F.least(a, b).cast("long") * rule.den >= F.greatest(a, b).cast("long") * rule.num) if rule.num else F.lit(True)


def _halved(v: str, other: str) -> Column:
    """A sketch, folded once if the other one is half as long (sizes that fit differ by one doubling at most)."""
    half = F.size(other)
    return F.when(F.size(v) > half, F.zip_with(F.slice(v, 1, half), F.slice(v, half + 1, half), lambda a, b: a.bitwiseXOR(b))).otherwise(F.col(v))


def _close(rule: Rule) -> Column:
    """Whether the parity sketches x, y allow a link: they differ in at most as many bits as the sets do in shingles."""
    differ = F.aggregate(F.zip_with(_halved("x", "y"), _halved("y", "x"), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, c: s + c)
    total = F.col("m").cast("long") + F.col("n")
    return differ <= total - 2 * F.ceil(total * rule.num / F.lit(rule.num + rule.den) - 1e-9)


def _short(v: str) -> Column:
    """A sketch folded to its shortest form."""
    return F.transform(F.sequence(F.lit(0), F.lit(WORDS64 - 1)), lambda i: F.aggregate(F.sequence(F.lit(0), F.expr(f"size({v}) div {WORDS64} - 1")), F.lit(0).cast("long"), lambda s, k: s.bitwiseXOR(F.get(F.col(v), i + k * WORDS64))))


def _sketched(pairs: DataFrame, bits: DataFrame, rule: Rule) -> DataFrame:
    """Those of pairs (a, b) whose whole sketches allow a link."""
    out = pairs.join(bits.select(F.col("d").alias("a"), F.col("n").alias("m"), F.col("bits").alias("x")), "a").join(bits.select(F.col("d").alias("b"), "n", F.col("bits").alias("y")), "b")
    return out.where(_sizes_fit(rule, "n", "m") & _close(rule)).select("a", "b")


def _links(docs: DataFrame, pairs: DataFrame, rule: Rule) -> DataFrame:
    """a, b, p, q: those of pairs (a, b) that link, by their whole sets, and the names of the sets, p before q."""
    sets = cut(_sets(docs, cut(pairs.select(F.explode(F.array("a", "b")).alias("d")).distinct()), rule))
    name = F.struct("k1", "k2")
    both = pairs.join(sets.select(F.col("d").alias("a"), name.alias("u"), F.col("s").alias("x")), "a").join(sets.select(F.col("d").alias("b"), name.alias("v"), F.col("s").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    linked = both.where((common > 0) & (common.cast("long") * rule.den >= (F.size("x") + F.size("y") - common).cast("long") * rule.num))
    return cut(linked.select("a", "b", F.least("u", "v").alias("p"), F.greatest("u", "v").alias("q")).distinct())


def _block_pairs(rule: Rule):
    """Pairs of one block pair of a long list that may link: other components, fit sizes, close sketches."""

    def work(rows):
        import pandas as pd

        home, side = rows["home"].to_numpy(), rows["side"].to_numpy()
        left, right = np.flatnonzero(side == 0), np.flatnonzero((side == 1) | home)
        d, n, comp = rows["d"].to_numpy(), rows["n"].to_numpy().astype(np.int64), rows["comp"].to_numpy()
        bits = np.array(rows["bits"].tolist(), np.int64).view(np.uint64).reshape(len(rows), WORDS64)
        a, b = [], []
        for i in left:
            total = n[i] + n[right]
            ok = (comp[right] != comp[i]) & (np.minimum(n[i], n[right]) * rule.den >= np.maximum(n[i], n[right]) * rule.num)
            ok &= np.bitwise_count(bits[right] ^ bits[i]).sum(1) <= total - 2 * (-(-rule.num * total // (rule.num + rule.den)))
            a.append(np.full(int(ok.sum()), d[i]))
            b.append(d[right[ok]])
        a, b = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (a, b))
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)}).drop_duplicates()

    return work


def _search(docs: DataFrame, rule: Rule, whole: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows with their set sizes and names, rows with their components, and links: all if whole, or enough to connect."""
    ship(docs.sparkSession)
    weight, histogram = _census(docs, rule)
    rows = cut(_signatures(docs, rule, weight, rule.boundary(histogram)))
    known = rows.where("d IS NOT NULL AND n > 0")
    nodes = cut(known.groupBy("k1", "k2").agg(F.min("d").alias("rep")))
    member = cut(known.select("d", "k1", "k2").join(nodes, ["k1", "k2"]).select("d", "rep").distinct())
    reps = cut(known.join(nodes, (F.col("d") == F.col("rep")) & (known.k1 == nodes.k1) & (known.k2 == nodes.k2), "left_semi").select("d", "n", "lists", "bits"))

    posting = reps.select("d", "n", F.explode("lists").alias("t"))
    lists = cut(posting.join(posting.groupBy("t").agg(F.count("*").alias("c")).where("c > 1"), "t"))
    leader = F.min(F.struct(F.xxhash64("t", "d").alias("h"), F.col("d"), F.col("n")))
    lists = cut(lists.join(lists.groupBy("t").agg(leader.alias("lead")).select("t", F.col("lead.d").alias("first"), F.col("lead.n").alias("m")), "t"))
    bits = reps.select("d", "n", "bits")

    # Each member of a list meets its leader.
    pairs = lists.where((F.col("d") != F.col("first")) & _sizes_fit(rule, "n", "m")).select(F.least("d", "first").alias("a"), F.greatest("d", "first").alias("b")).distinct()
    met = cut(_sketched(pairs, bits, rule))
    links = _links(docs, met, rule)
    # Rows of one doc_id are one node even if their sets differ.
    several = known.groupBy("d").agg(F.min(F.struct("k1", "k2")).alias("lo"), F.max(F.struct("k1", "k2")).alias("hi")).where("lo < hi")
    twice = member.groupBy("d").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a < z").select("d", "a")
    same = member.join(twice, "d").select("a", F.col("rep").alias("b"))

    # All pairs that haven't met yet: of every list if whole, else of those that hold several components.
    open_ = lists.where("c > 2")
    if whole:
        open_ = open_.withColumn("comp", F.col("d"))
    else:
        open_ = open_.join(components(links.select("a", "b").unionByName(same)), "d", "left").withColumn("comp", F.coalesce("comp", "d"))
    mixed = cut(open_.groupBy("t").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("t"))
    open_ = cut(open_.join(mixed, "t").join(bits.select("d", _short("bits").alias("bits")), "d").select("t", "c", "d", "n", "comp", "bits"))
    few, right = open_.where(F.col("c") <= SHORT), open_.where(F.col("c") <= SHORT)
    right = right.select("t", F.col("d").alias("e"), F.col("n").alias("m"), F.col("comp").alias("comp2"), F.col("bits").alias("y"))
    near = few.withColumnRenamed("bits", "x").join(right, (few.t == right.t) & (F.col("d") < F.col("e")) & (F.col("comp") != F.col("comp2")) & _sizes_fit(rule, "n", "m") & _close(rule)).select(F.col("d").alias("a"), F.col("e").alias("b"))
    blocks = F.ceil(F.col("c") / BLOCK).cast("int")
    long = open_.where(F.col("c") > SHORT).withColumn("own", F.pmod(F.xxhash64("d"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    long = long.select("t", "d", "n", "comp", "bits", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"), (F.col("own") == F.col("other")).alias("home"))
    near = near.unionByName(spread(long, "t", "i", "j").groupBy("t", "i", "j").applyInPandas(_block_pairs(rule), "a long, b long")).distinct().join(met, ["a", "b"], "left_anti")
    more = cut(_sketched(near, bits, rule))
    if whole:  # sets of one doc_id may link with each other
        more = more.unionByName(several.select(F.col("d").alias("a"), F.col("d").alias("b")))
    links = links.unionByName(_links(docs, more, rule))

    final = components(links.select("a", "b").unionByName(same)).withColumnRenamed("d", "rep")
    of = member.groupBy("d").agg(F.min("rep").alias("rep")).join(final, "rep", "left").select("d", F.coalesce("comp", "rep").alias("comp"))
    return rows, of, links


def join(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs (doc_id, text)."""
    rows, of, _ = _search(docs, Rule(k, num, den), False)
    return rows.select("d", "n").join(of, "d", "left").select(F.col("d").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), F.coalesce("comp", "d").alias("component_id"))


def graph(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> tuple[DataFrame, DataFrame]:
    """Membership and links: doc_id, n_shingles, component_id, set (the name of the row's set) and n_links for each row of
    docs; and p, q, the names of each pair of different sets that link, once."""
    rows, of, links = _search(docs, Rule(k, num, den), True)
    pairs = cut(links.where("p < q").select("p", "q").distinct())
    rows = rows.select("d", "n", F.struct("k1", "k2").alias("set"))
    copies = cut(rows.where("d IS NOT NULL AND n > 0").groupBy("set").agg(F.count("*").alias("copies")))
    ends = pairs.select(F.col("p").alias("set"), F.col("q").alias("other")).unionByName(pairs.select(F.col("q").alias("set"), F.col("p").alias("other")))
    others = ends.join(copies.withColumnRenamed("set", "other"), "other").groupBy("set").agg(F.sum("copies").alias("others"))
    counts = copies.join(others, "set", "left").select("set", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    n_links = F.when(F.col("d").isNotNull(), F.when(F.col("n") > 0, F.col("n_links")).otherwise(0))
    out = rows.join(counts, "set", "left").join(of, "d", "left")
    return out.select(F.col("d").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), F.coalesce("comp", "d").alias("component_id"), "set", n_links.alias("n_links")), pairs


def counts(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links for each row of docs: the links of graph, counted within components."""
    rule = Rule(k, num, den)
    rows, of, links = _search(docs, rule, False)
    rows = rows.select("d", "n", "k1", "k2")
    sets = rows.where("d IS NOT NULL AND n > 0").groupBy("k1", "k2").agg(F.min("d").alias("rep"), F.count("*").alias("copies"), F.first("n").alias("n"))
    sets = cut(sets.join(of.withColumnRenamed("d", "rep"), "rep"))
    several = sets.groupBy("comp").agg(F.count("*").alias("size")).where("size > 1").select("comp")
    degree = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("degree"))
    members = cut(sets.join(several, "comp").join(degree, "rep", "left").withColumn("degree", F.coalesce("degree", F.lit(0))))
    elements = _sets(docs, members.select(F.col("rep").alias("d")).distinct(), rule).withColumnRenamed("d", "rep")
    others = linked_copies(cut(members.join(elements, ["rep", "k1", "k2"])), num, den)
    found = sets.select("k1", "k2", "copies").join(others, ["k1", "k2"], "left").select("k1", "k2", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    found = cut(found)  # a join of two plain shuffles can be split where many copies share a set
    n_links = F.when(F.col("d").isNotNull(), F.when(F.col("n") > 0, F.col("n_links")).otherwise(0))
    out = rows.join(found, ["k1", "k2"], "left").join(of, "d", "left")
    return out.select(F.col("d").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), F.coalesce("comp", "d").alias("component_id"), n_links.alias("n_links"))


def keep_one(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs, all columns, with one document of each component: that of the smallest doc_id (rows without id all stay).

    Where doc_ids repeat, rows are the documents: a row goes only if its own text is linked with one that stays.
    """
    named = docs.where("doc_id IS NOT NULL")
    if not named.groupBy(F.col("doc_id").cast("long")).count().where("count > 1").head(1):
        stay = cut(join(docs, k, num, den)).where("doc_id = component_id").select(F.col("doc_id").alias("__d"))
        return docs.join(stay, F.col("doc_id").cast("long") == F.col("__d"), "left_semi").unionByName(docs.where("doc_id IS NULL"))
    named = cut(named).withColumn("__row", F.monotonically_increasing_id())  # stable: the rows are read from the checkpoint
    found = join(named.select(F.col("__row").alias("doc_id"), "text"), k, num, den).select(F.col("doc_id").alias("__row"), "component_id")
    ids = named.select("__row", F.col("doc_id").cast("long").alias("__d"))
    stay = cut(found.join(ids, "__row").groupBy("component_id").agg(F.min(F.struct("__d", "__row")).alias("best")).select(F.col("best.__row").alias("__row")))
    return named.join(stay, "__row", "left_semi").drop("__row").unionByName(docs.where("doc_id IS NULL"))


def query(spark, sf_dir: str) -> DataFrame:
    """Whole documents table: three-word shingles, similarity of 0.9 or more; with the number of each document's links."""
    return counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), 3, 90, 100)
