"""Language-model scores from a hashed maximum-entropy model with a class-factored softmax.

The whole vocabulary is factored into classes. The most frequent types (up to HEAD) are parted into classes by the company
they keep: every type sums a random projection of the documents that it occurs in, and the types are bisected along the
first principal direction of those sums, again and again; the number of classes follows the size of the vocabulary. All
further types form classes by their hash, about TAIL types each, as many as the vocabulary needs. Classes are factored on:
each is halved by mass until single types (or hash classes) are left, so a token's probability is a product of two-way
softmaxes from the classes down to the type, one more halving for twice the vocabulary. Within a hash class a type has its
smoothed unigram share.

Each softmax adds its bias (the unigram log odds) and one weight for each feature of the history: the previous word and the
two previous words and, where classes are told apart, the words two and three back (skips). Feature and place in the factoring are hashed together into
a table whose size follows the number of training tokens. Each feature has an area of the table for the halvings between
classes, and one for each quarter (by mass) of those within classes: tokens are taken by the slice and area by area, so
what is read and added to stays in the processor's cache. Weights are trained by distributed gradient updates: training
documents are dealt into ROUNDS disjoint parts, and in each round every partition sums gradient and curvature over all
tokens of its part, partial sums meet in a reduction tree, and the driver takes one step on the table. So every token of
every training document counts once, in the counts and in the updates. Texts are scored in sparse numpy batches.

Words are named by 64-bit hashes. What is broadcast has fixed bounds: HEAD types with counts, classes and ways (about 90 bytes each),
2**MOST_BUCKETS hash classes and 2**MOST_WEIGHTS weights. Counts of other types meet their words in a shuffle join, so every
count is exact.

Defined results: null text counts as empty (one token, the end); rows with null doc_id are scored and never teach; rows
with equal doc_id are rows of their own; without training documents N and V are 0 and the score equals the base score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import bucket_of, cut, hash_words, mix64, ship, slices, tidy

#: Types with counts and classes of their own, at most.
HEAD = 1 << 18
#: Types of a hash class, about; the most hash classes, as a power of two.
TAIL, MOST_BUCKETS = 16, 16
#: Dimensions of the random projection that classes are found by, and the count at which it is half trusted.
DIMS, TRUST = 16, 30
#: Training tokens for each weight, at least; the fewest and most weights, as powers of two.
TOKENS_A_WEIGHT, LEAST_WEIGHTS, MOST_WEIGHTS = 8, 10, 22
ROUNDS, DAMP = 4, 2.0
#: Bytes of a stored training token, about: the partial sums of a pass take no more bytes than the tokens that it reads.
TOKEN_BYTES = 3
#: Tasks of a pass for each core, at most; slices of text between two flushes of a task's sums.
WAVES, FLUSH = 4, 8
#: Partial sums that one task of the reduction tree adds up; pieces that they are cut into; tokens of a numpy step.
FAN, PARTS, CHUNK = 16, 16, 1 << 14
#: Characters of a slice of training texts; tokens, and legs of their ways, that are taken area by area together, at most.
SLICE, STRETCH = 1 << 21, 1 << 18

#: The first features, n-grams; the others, skips, tell classes apart but not the types of a class.
NGRAMS = 2
#: Halvings of a leg; a group of legs with one top has 15 halvings, and the weights that a feature has for them are neighbours.
LEG = 4
#: Parts, by mass, of the halvings within classes; each has an area for each n-gram.
QUARTERS = 4

_END, _START = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
_SALT = np.array([0x8CB92BA72F3D8DD7, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)
_WITHIN = np.int32(1 << 30)
_PLACE, _SPREAD = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B)


def tokens(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of the texts one after another, each text closed by the end token, and tokens per text."""
    words, n = hash_words(texts)
    out = np.full(len(words) + len(texts), _END)
    is_word = np.ones(len(out), bool)
    is_word[np.cumsum(n + 1) - 1] = False
    out[is_word] = words
    return out, n + 1


def starts(table: np.ndarray) -> np.ndarray:
    """Where the hashes with each first bits begin in a sorted table; about one to each start."""
    bits = max(1, len(table).bit_length())
    return np.searchsorted(table, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)).astype(np.int32)


def places(table: np.ndarray, first: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Index of each hash in a sorted table with its starts, -1 if absent."""
    if not len(table):
        return np.full(len(h), -1, np.int32)
    at = first.take(h >> np.uint64(64 - (len(first).bit_length() - 1)), mode="clip")
    seen = table.take(at, mode="clip")
    todo = np.flatnonzero(seen < h)
    while len(todo):  # few rounds: hashes are even
        at[todo] += 1
        seen[todo] = table.take(at[todo], mode="clip")
        todo = todo[(seen[todo] < h[todo]) & (at[todo] < len(table))]
    at[seen != h] = -1
    return at


def contexts(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """32-bit feature hashes of each token's history: previous word, two previous words, skips of one and of two."""
    at = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
    back = []
    for j in (1, 2, 3):
        prev = np.empty_like(h)
        prev[j:] = h[: len(h) - j]
        back.append(np.where(at >= j, prev, _START))
    return np.stack([(x >> np.uint64(32)).astype(np.uint32) for x in (mix64(back[0] ^ _SALT[0]), mix64(mix64(back[0] ^ _SALT[1]) + back[1]), mix64(back[1] ^ _SALT[2]), mix64(back[2] ^ _SALT[3]))])


def buckets_of(h: np.ndarray, bits: int) -> np.ndarray:
    """The hash class of each word: the first bits of its hash."""
    return ((h >> np.uint64(1)) >> np.uint64(63 - bits)).astype(np.int64)


def _turns() -> tuple[np.ndarray, np.ndarray]:
    """By the end of a leg (places in its group are numbered like a heap): the halvings passed, 15 for none; 1 for right, -1 for left, 0 for none."""
    step, side = np.full((LEG, 31), 15), np.zeros((LEG, 31), np.float32)
    for end in range(1, 31):
        way = [end]
        while way[-1]:
            way.append((way[-1] - 1) // 2)
        for j, (at, to) in enumerate(zip(way[:0:-1], way[-2::-1])):
            step[j, end], side[j, end] = at, 1 if to == 2 * at + 2 else -1
    return step, side


_STEP, _SIDE = _turns()


@dataclass
class Ways:
    """The ways to the leaves in legs of LEG halvings: those between classes, then those within one."""

    first: list[np.ndarray]  # of each leaf, where its legs begin, and where the last one's end
    legs: list[np.ndarray]  # 32 * group + end
    place: np.ndarray  # of each group: what its top adds to the hash of a feature
    quarter: np.ndarray
    bias: np.ndarray  # 16 for each group


@dataclass
class Factoring:
    """Types, hash classes, and the halvings that lead to them; a halving is named by the first leaf of its right half."""

    types: np.ndarray  # sorted hashes
    first: np.ndarray  # their starts
    counts: np.ndarray
    leaf: np.ndarray  # of each type
    bits: int
    bucket_leaf: np.ndarray
    bucket_mass: np.ndarray
    after: np.ndarray  # the halvings that follow on the left and on the right of each: -1 for a leaf, _WITHIN added within one class
    root: int
    ways: Ways

    def leaves(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place among the types (-1 for others) and leaf of each token."""
        at = places(self.types, self.first, h)
        out = np.append(self.leaf, 0)[at]
        other = np.flatnonzero(at < 0)
        out[other] = self.bucket_leaf[buckets_of(h[other], self.bits)]
        return at, out

    def walk(self, weights: np.ndarray, ctx: np.ndarray, leaf: np.ndarray, sums: np.ndarray | None = None) -> np.ndarray:
        """log10 of each leaf's probability given its history; with sums, adds gradient + i * curvature of each weight to them instead."""
        out = np.zeros(len(leaf))
        for a in range(0, len(leaf), STRETCH):
            to, c, part = leaf[a : a + STRETCH], ctx[:, a : a + STRETCH], out[a : a + STRETCH]
            for within in (False, True):
                start, legs = self.ways.first[within], self.ways.legs[within]
                first = start.take(to)
                many = start.take(to + 1) - first
                end = np.cumsum(many, dtype=np.int32)
                if not end[-1]:
                    continue
                token = np.repeat(np.arange(len(to), dtype=np.int32), many)
                leg = legs.take(np.arange(end[-1], dtype=np.int32) + np.repeat(first - (end - many), many))
                parts = [(token, leg)]
                if within:
                    quarter = self.ways.quarter.take(leg >> 5)
                    parts = [(token.take(on), leg.take(on)) for on in (np.flatnonzero(quarter == q) for q in range(QUARTERS))]
                for q, (token, leg) in enumerate(parts):
                    for b in range(0, len(leg), STRETCH):
                        self._legs(weights, c, token[b : b + STRETCH], leg[b : b + STRETCH], within, q, part, sums)
        return out / -np.log(10)

    def _legs(self, weights: np.ndarray, ctx: np.ndarray, token: np.ndarray, leg: np.ndarray, within: bool, quarter: int, out: np.ndarray, sums: np.ndarray | None) -> None:
        """Adds -log of the probability of each leg to out, or what it teaches to sums."""
        half, end, group = len(weights) // 2, leg & 31, leg >> 5
        many, size = (NGRAMS, half // (NGRAMS * QUARTERS)) if within else (len(_SALT), half // len(_SALT))
        shift, place = np.uint32(33 - size.bit_length()), self.ways.place.take(group)
        step = [x.take(end) for x in _STEP]
        z, group = np.empty((LEG, len(leg)), np.float32), group.astype(np.int64) << 4
        for x, at in zip(z, step):
            self.ways.bias.take(group + at, mode="clip", out=x)
        areas, near = [], []
        for f in range(many):
            begin = half + (f * QUARTERS + quarter) * size if within else f * size
            areas.append(slice(begin, begin + size))
            near.append((((ctx[f].take(token) ^ place) * _SPREAD) >> shift).astype(np.int64))
            for x, at in zip(z, step):
                x += weights[areas[f]].take(near[f] ^ at, mode="clip")
        lost, each = np.zeros(len(leg), np.float32), []
        for x, sides in zip(z, _SIDE):
            side = sides.take(end)
            x *= -side
            np.exp(np.minimum(x, np.float32(60), out=x), out=x)
            x *= np.abs(side)  # nothing where the leg has ended
            if sums is None:
                lost += np.log1p(x)
                continue
            taken = 1 / (1 + x)
            x *= taken
            each.append(np.empty(len(x), np.complex64))
            each[-1].real, each[-1].imag = side * x, x * taken
        if sums is None:
            out += np.bincount(token, lost, len(out))
            return
        for area, hashed in zip(areas, near):
            for at, values in zip(step, each):
                np.add.at(sums[area], hashed ^ at, values)


def halvings(mass: np.ndarray, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """after, bias and root of the halvings of the leaves in order: between classes while there are several, then anywhere."""
    n, cum = len(mass), np.concatenate([[0.0], np.cumsum(mass)])
    after, bias, root = np.full(2 * n + 2, -1, np.int32), np.zeros(n + 1, np.float32), -1
    edges = np.flatnonzero(np.diff(cls, prepend=-1))  # the first leaf of each class
    lo, hi, parent = np.array([0]), np.array([n]), np.array([-1])
    while True:
        some = hi - lo > 1
        lo, hi, parent = lo[some], hi[some], parent[some]
        if not len(lo):
            return after, bias, root
        half = (cum[lo] + cum[hi]) / 2
        mid = np.searchsorted(cum, half)
        mid -= np.abs(cum[np.maximum(mid - 1, 0)] - half) < np.abs(cum[np.minimum(mid, n)] - half)
        mid = mid.clip(lo + 1, hi - 1)
        several = cls[lo] != cls[hi - 1]
        if len(edges) > 1:
            k = np.searchsorted(edges, mid).clip(1, len(edges) - 1)
            before = (edges[k - 1] > lo) & ((edges[k] >= hi) | (half - cum[edges[k - 1]] < cum[edges[k]] - half))
            mid = np.where(several, np.where(before, edges[k - 1], edges[k]), mid)
        bias[mid] = np.log((cum[hi] - cum[mid]) / (cum[mid] - cum[lo]))
        name = np.where(several, mid, mid + _WITHIN).astype(np.int32)
        if root < 0:
            root = int(name[0])
        else:
            after[parent] = name
        lo, hi, parent = np.concatenate([lo, mid]), np.concatenate([mid, hi]), np.concatenate([2 * mid, 2 * mid + 1])


def ways(after: np.ndarray, bias: np.ndarray, root: int, mass: np.ndarray) -> Ways:
    """The halvings that lead to each of the leaves in order, as legs."""
    at, share = np.full(len(mass), root, np.int32), np.cumsum(mass) / mass.sum()
    first, legs, tops, biases, groups = [], [], [], [], 0
    for within in (False, True):

        def goes_on(node: np.ndarray) -> np.ndarray:
            return np.flatnonzero((node >= _WITHIN) if within else (node >= 0) & (node < _WITHIN))

        rounds, many = [], np.zeros(len(mass) + 1, np.int32)
        leaves = goes_on(at)
        while len(leaves):
            top, group = np.unique(at[leaves] & ~_WITHIN, return_inverse=True)
            table, end, live = np.zeros((len(top), 16), np.float32), np.zeros(len(leaves), np.int32), np.arange(len(leaves))
            for _ in range(LEG):
                who = leaves[live]
                node = at[who] & ~_WITHIN
                table[group[live], end[live]] = bias[node]
                right = who >= node
                end[live] += end[live] + 1 + right
                at[who] = after[2 * node + right]
                live = live[goes_on(at[who])]
            rounds.append((leaves.astype(np.int32), ((groups + group) * 32 + end).astype(np.int32)))
            many[leaves + 1] += 1
            tops.append(top)
            biases.append(table)
            groups += len(top)
            leaves = leaves[goes_on(at[leaves])]
        first.append(np.cumsum(many, dtype=np.int32))
        legs.append(np.empty(first[-1][-1], np.int32))
        for k, (leaves, codes) in enumerate(rounds):
            legs[-1][first[-1][leaves] + k] = codes
    top = np.concatenate(tops) if tops else np.empty(0, np.int32)
    quarter = np.minimum(share[top - 1] * QUARTERS, QUARTERS - 1).astype(np.uint8)
    return Ways(first, legs, top.astype(np.uint32) * _PLACE, quarter, np.concatenate(biases).ravel() if tops else np.empty(0, np.float32))


def bisect(vectors: np.ndarray, counts: np.ndarray, levels: int) -> np.ndarray:
    """Classes of the types, 2**levels at most: each is parted along the first principal direction of its vectors."""
    cls = np.zeros(len(vectors), np.int64)
    for _ in range(levels):
        cls *= 2
        for k in np.unique(cls):
            i = np.flatnonzero(cls == k)
            x, c = vectors[i], counts[i]
            x -= (c @ x) / c.sum()
            w = c * c / (c + TRUST)
            x = x @ np.linalg.eigh((x * w[:, None]).T @ x)[1][:, -1]
            t = 0.0
            for _ in range(20):  # two means on a line
                up = x > t
                if up.all() or not up.any():
                    break
                t = (np.average(x[up], weights=w[up]) + np.average(x[~up], weights=w[~up])) / 2
            cls[i] += x > t
    return cls


def count_words(docs: DataFrame, training: Column) -> DataFrame:
    """h, c: the count of each word hash in training documents, without the end token."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, found = batch.column(0).to_pylist(), []
            for a, b in slices(texts):
                found.append(np.unique(hash_words(texts[a:b])[0], return_counts=True))
            h, c = (np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, np.uint64), np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c.astype(np.int64))], ["h", "c"])

    return docs.where(training).select("text").mapInArrow(work, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def _packed(x: np.ndarray) -> bytes:
    """float32 numbers rounded to their upper two bytes."""
    return ((x.view(np.uint32) + np.uint32(1 << 15)) >> np.uint32(16)).astype(np.uint16).tobytes()


def _unpacked(x: bytes) -> np.ndarray:
    return (np.frombuffer(x, np.uint16).astype(np.uint32) << np.uint32(16)).view(np.float32)


def _tree_sum(parts: DataFrame, n: int, size: int) -> np.ndarray:
    """The sum of the partial tables (part, piece, values) of n partitions, FAN at a time."""

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(map(_unpacked, pdf["values"]))
        return pd.DataFrame({"part": [int(pdf["part"].iloc[0]) // FAN], "piece": [int(pdf["piece"].iloc[0])], "values": [_packed(total)]})

    while n > 1:
        parts, n = parts.groupBy(F.expr(f"part div {FAN}"), "piece").applyInPandas(add, "part int, piece int, values binary"), -(-n // FAN)
    total, at = np.zeros(size, np.float32), 0
    for r in sorted(parts.collect(), key=lambda r: r["piece"]):
        piece = _unpacked(r["values"])
        total[at : at + len(piece)] = piece
        at += len(piece)
    return total


def _summed(rows: DataFrame, n_tokens: int, size: int, add) -> np.ndarray:
    """Sum over all texts of rows (about n_tokens tokens): add(texts, total) adds those of a slice to a float32 table.

    Texts are read by so many tasks that their tables take no more bytes than the texts, and by WAVES a core at most.
    """
    tasks = min(n_tokens * TOKEN_BYTES // (2 * size), WAVES * rows.sparkSession.sparkContext.defaultParallelism)
    rows = rows.coalesce(max(1, tasks))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total, part, done = np.zeros(size, np.float32), np.zeros(size, np.float32), 0
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a, b in slices(texts, SLICE):
                add(texts[a:b], part)
                done += 1
                if done % FLUSH == 0:  # many small numbers added to a large one would be lost
                    total += part
                    part[:] = 0
        total += part
        pieces = [_packed(x) for x in np.array_split(total, PARTS)]
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()] * PARTS, pa.int32()), pa.array(range(PARTS), pa.int32()), pa.array(pieces, pa.binary())], ["part", "piece", "values"])
        tidy()

    return _tree_sum(rows.mapInArrow(work, "part int, piece int, values binary"), rows.rdd.getNumPartitions(), size)


def _signs(h: np.ndarray) -> np.ndarray:
    """DIMS bits of each hash."""
    return np.unpackbits(mix64(h).view(np.uint8).reshape(-1, 8)[:, : DIMS // 8], axis=1)


def _vectors(rows: DataFrame, types: np.ndarray, n_tokens: int) -> np.ndarray:
    """For each type, the sum over its occurrences of the mean projected word of their document."""
    held = rows.sparkSession.sparkContext.broadcast((types, starts(types)))

    def add(texts: list, total: np.ndarray) -> None:
        h, n = tokens(texts)
        start = np.cumsum(n) - n
        mean = np.add.reduceat(_signs(h), start, axis=0, dtype=np.float32) * (2 / n[:, None]) - 1
        at, doc = places(*held.value, h), np.repeat(np.arange(len(n)), n)
        for a in range(0, len(h), CHUNK):
            known = np.flatnonzero(at[a : a + CHUNK] >= 0) + a
            rows = (at[known] * DIMS)[:, None] + np.arange(DIMS)
            np.add.at(total, rows.ravel(), mean[doc[known]].astype(np.float32).ravel())

    return _summed(rows, n_tokens, len(types) * DIMS, add).reshape(-1, DIMS)


def factor(types: np.ndarray, counts: np.ndarray, cls: np.ndarray, bits: int, bucket_mass: np.ndarray) -> Factoring:
    """The factoring of sorted types with their counts and classes, and of hash classes with their masses (a class by themselves)."""
    mass = np.concatenate([counts + 1.0, bucket_mass])
    cls = np.concatenate([cls, np.full(len(bucket_mass), cls.max(initial=0) + 1)])
    order = np.lexsort((-mass, cls))
    place = np.empty(len(order), np.int32)
    place[order] = np.arange(len(order))
    after, bias, root = halvings(mass[order], cls[order])
    return Factoring(types, starts(types), counts, place[: len(types)], bits, place[len(types) :], np.log10(bucket_mass), after, root, ways(after, bias, root, mass[order]))


def _train(rows: DataFrame, lm: Factoring, n_tokens: int) -> np.ndarray:
    """The weights after one pass over all of rows (doc_id, text), a part in each round."""
    sc = rows.sparkSession.sparkContext
    size = 1 << min(MOST_WEIGHTS, max(LEAST_WEIGHTS, (n_tokens // TOKENS_A_WEIGHT).bit_length() - 1))
    known, weights = sc.broadcast(lm), np.zeros(size, np.float32)
    for k in range(ROUNDS):
        held = sc.broadcast(weights)

        def add(texts: list, total: np.ndarray) -> None:
            h, n = tokens(texts)
            known.value.walk(held.value, contexts(h, n), known.value.leaves(h)[1], total.view(np.complex64))

        part = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(ROUNDS)) == k).select("text")
        sums = _summed(part, n_tokens // ROUNDS, 2 * size, add).view(np.complex64)
        weights = weights + sums.real / (len(_SALT) * sums.imag + np.float32(DAMP))
        held.unpersist()
        del sums, held, add
        tidy()
    known.unpersist()
    return weights


def score(docs: DataFrame, training: Column, held_out: Column) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of docs (doc_id, text)."""
    spark = docs.sparkSession
    ship(spark)
    training = F.coalesce(training, F.lit(False))
    counts = cut(count_words(docs, training))
    ends = docs.where(training).count()
    seen = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    n, v = (seen["n"] or 0) + ends, seen["v"] + (ends > 0)
    level = F.floor(F.log2("c") * 8).cast("int")
    least, held = 1 << 10, 0
    for r in sorted(counts.groupBy(level.alias("level")).count().collect(), key=lambda r: -r["level"]):  # at most 512 rows
        if held + r["count"] > HEAD:
            break
        least, held = r["level"], held + r["count"]
    head = counts.where(level >= least).toArrow()
    h, c = (np.append(head.column(name).to_numpy(), last) for name, last in (("h", _END.view(np.int64)), ("c", ends)))
    order = np.argsort(h.view(np.uint64))
    h, c = h.view(np.uint64)[order], c.astype(np.int64)[order]
    rest = v - len(h)
    bits = min(MOST_BUCKETS, max(0, rest // TAIL).bit_length())
    bucket_mass = np.ones(1 << bits)  # an unknown word's, and for each of its types one more than the count
    if rest > 0:
        bucket = F.shiftrightunsigned(F.shiftrightunsigned("h", 1), 63 - bits)
        for r in counts.where(level < least).groupBy(bucket.alias("b")).agg(F.sum(F.col("c") + 1).alias("m")).collect():  # at most 2**MOST_BUCKETS rows
            bucket_mass[r["b"]] += r["m"]
    rows = docs.where(training).select("doc_id", "text")
    cls = np.zeros(len(h), np.int64)
    if n:
        many = np.maximum(c, 1).astype(np.float32)
        cls = bisect(_vectors(rows.select("text"), h, n) / many[:, None], many, v.bit_length() // 3)
        tidy()
    lm = factor(h, c, cls, bits, bucket_mass)
    tidy()
    model = spark.sparkContext.broadcast((lm, _train(rows, lm, n) if n else np.zeros(1 << LEAST_WEIGHTS, np.float32)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lm, weights = model.value
        log_counts, known = np.append(np.log10(lm.counts + 1.0), 0.0), np.append(lm.counts > 0, False)
        for batch in batches:
            ids, out, texts = batch.column(0), batch.column(1), batch.column(2).to_pylist()
            for a, b in slices(texts):
                t, size = tokens(texts[a:b])
                doc = np.repeat(np.arange(b - a), size)
                at, leaf = lm.leaves(t)
                logp = lm.walk(weights, contexts(t, size), leaf)
                log_c = log_counts[at]
                tail = np.flatnonzero(at < 0)
                logp[tail] -= lm.bucket_mass[buckets_of(t[tail], lm.bits)]
                add = lambda x: np.bincount(doc, x, b - a)
                pair = np.lexsort((t[tail], doc[tail]))
                td, th = doc[tail][pair], t[tail][pair]
                new = np.flatnonzero((np.diff(th, prepend=np.uint64(0)) != 0) | (np.diff(td, prepend=-1) != 0))
                tf = np.diff(np.append(new, len(th)))
                bounds = np.searchsorted(td[new], np.arange(b - a + 1)).astype(np.int32)
                tails = pa.ListArray.from_arrays(pa.array(bounds), pa.StructArray.from_arrays([pa.array(th[new].view(np.int64)), pa.array(tf.astype(np.int64))], ["h", "tf"]))
                known_n = add(known[at].astype(np.float64)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), out.slice(a, b - a), pa.array(size.astype(np.int64)), pa.array(known_n), pa.array(add(log_c)), pa.array(add(logp)), tails], ["doc_id", "held_out", "n_tokens", "known", "log_c", "logp", "tails"])
        tidy()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), "text")
    part = rows.mapInArrow(work, "doc_id long, held_out boolean, n_tokens long, known long, log_c double, logp double, tails array<struct<h: long, tf: long>>")
    part = cut(part.withColumn("row", F.monotonically_increasing_id()))
    tail = part.select("row", F.explode("tails").alias("t")).select("row", "t.h", "t.tf").join(counts, "h")
    tail = tail.groupBy("row").agg(F.sum("tf").alias("more"), F.sum(F.col("tf") * F.log10(F.col("c") + 1.0)).alias("tail_c"))
    both = part.drop("tails").join(tail, "row", "left")
    log_c = F.col("log_c") + F.coalesce("tail_c", F.lit(0.0))
    base = log_c - F.col("n_tokens") * F.lit(float(np.log10(n + v + 1)))
    full = F.col("logp") + F.coalesce("tail_c", F.lit(0.0)) if n else base
    return both.select("doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), full.alias("score"))


def query(spark, sf_dir: str) -> DataFrame:
    """Whole documents table; rows whose crc32(doc_id) mod 7 is 2 (or whose doc_id is null) don't teach."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    fold = bucket_of(F.col("doc_id"), 7)
    return score(docs, fold != 2, fold == 2)
