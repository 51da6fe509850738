"""Toxicity scores: gradient-boosted trees over dense features of a text, calibrated by isotonic regression.

Features are densities of a lexicon learned from labelled rows, proximity of its words to second-person words, and
rates of capitals, punctuation and obfuscation. The model is fitted on at most ``max_rows`` labelled rows (a documented
bound); every row of the input is scored, over its whole text.

Defined results: null or empty text is scored as a text without words; labels that are null are left out, several labels
of one doc_id count as toxic if one is, and the trees learn from one row (of the least features) of a repeated doc_id; without both classes among the labels every score is their share of toxic rows
(0 without labels); rows with equal doc_id are separate rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import bucket_of, hash_words, lower_fold, separators, ship, slices, tidy

#: Labelled rows that the model is fitted on, at most; chosen by a hash of the id.
MAX_ROWS = 20_000
#: Words of the learned lexicon, at most, and what a word needs to enter: toxic documents and a z score of log odds.
LEXICON, MIN_TOXIC_DOCS, MIN_Z = 512, 4, 3.5
#: Words on either side in which a second-person word counts as near.
NEAR = 6
#: Share of fitted rows kept back for calibration, as one in CALIBRATE.
CALIBRATE = 4
CUT = 0.3

#: Second-person words of the corpus languages.
SECOND_PERSON = "you your yours yourself u ur du dich dir dein deine deiner ihr euch euer tu te toi ton ta tes vous votre vos ti tuyo usted ustedes vosotros su".split()
#: Characters that stand for letters in obfuscated words.
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}

_PUNCT = b"\"#%&'()+,-./:;<=>?[\\]^_`{|}~"
_WORD_END = separators(_PUNCT + b"!@$*")
_LEET_END = separators(_PUNCT)
_PLAIN, _LEET = lower_fold(), lower_fold()
for _a, _b in LEET.items():
    _LEET[ord(_a)] = ord(_b)


def _bytes(*ranges: tuple[int, int]) -> np.ndarray:
    table = np.zeros(256, np.uint8)
    for a, b in ranges:
        table[a : b + 1] = 1
    return table


_UPPER, _LETTER = _bytes((65, 90)), _bytes((65, 90), (97, 122), (128, 255))
_BANG, _ASK, _DIGIT = _bytes((33, 33)), _bytes((63, 63)), _bytes((48, 57))
_MARKS = _bytes((33, 47), (58, 64), (91, 96), (123, 126))
_SIGN = np.zeros(256, np.uint8)
_SIGN[[ord(c) for c in LEET] + [ord("*")]] = 1

FEATURES = ("hits", "hit_rate", "distinct_weight", "near_second", "near_rate", "leet_hits", "capitals", "capital_pairs", "bangs", "questions", "marks", "digits", "obfuscated", "repeats", "log_words")


def _hashes(words: list[str]) -> np.ndarray:
    return np.sort(np.unique(hash_words([" ".join(words)], _WORD_END, _PLAIN)[0]))


_SECOND = _hashes(SECOND_PERSON)


def _places(sorted_table: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Index of each hash in a sorted table, -1 where it isn't there."""
    if not len(sorted_table):
        return np.full(len(h), -1)
    at = np.minimum(np.searchsorted(sorted_table, h), len(sorted_table) - 1)
    return np.where(sorted_table[at] == h, at, -1)


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of values over runs of the given lengths."""
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    end = np.cumsum(counts)
    return total[end] - total[end - counts]


def features(texts: list, lexicon: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """One row of FEATURES for each text."""
    out = np.zeros((len(texts), len(FEATURES)))
    for a, b in slices(texts, 1 << 19):
        h, n = hash_words(texts[a:b], _WORD_END, _PLAIN)
        hit = _places(lexicon, h)
        is_hit = hit >= 0
        place = np.arange(len(h))
        first = np.repeat(np.cumsum(n) - n, n)
        last = np.repeat(np.cumsum(n), n) - 1
        second = _places(_SECOND, h) >= 0
        before = np.maximum.accumulate(np.where(second, place, -(NEAR + 1))) if len(h) else place
        after = np.minimum.accumulate(np.where(second, place, len(h) + NEAR + 1)[::-1])[::-1] if len(h) else place
        near = is_hit & (((before >= first) & (place - before <= NEAR)) | ((after <= last) & (after - place <= NEAR)))
        leet_h, leet_n = hash_words(texts[a:b], _LEET_END, _LEET)
        leet = _sums(_places(lexicon, leet_h) >= 0, leet_n)
        blobs = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts[a:b]]
        buf = np.frombuffer(b"\n".join(blobs) + b"\n", np.uint8)
        start = np.cumsum([0, *(len(x) + 1 for x in blobs[:-1])])
        size = np.array([max(1, len(x)) for x in blobs], np.float64)
        add = lambda mask: np.add.reduceat(mask, start, dtype=np.int64)
        letter = _LETTER[buf]
        upper, same = _UPPER[buf], buf[1:] == buf[:-1]
        pairs, hidden, repeats = np.zeros_like(buf), np.zeros_like(buf), np.zeros_like(buf)
        pairs[1:] = upper[1:] & upper[:-1]
        hidden[1:-1] = letter[:-2] & _SIGN[buf[1:-1]] & letter[2:]
        repeats[2:] = (same[1:] & same[:-1]) & letter[2:].astype(bool)
        words = np.maximum(n, 1)
        hits = _sums(is_hit, n)
        weight = np.concatenate([weights, [0.0]])[hit]
        out[a:b] = np.stack([
            hits, hits / words, _sums(weight, n) / words, _sums(near, n), _sums(near, n) / words, np.maximum(leet - hits, 0),
            add(upper) / size, add(pairs) / size, add(_BANG[buf]) / size, add(_ASK[buf]) / size, add(_MARKS[buf]) / size, add(_DIGIT[buf]) / size, add(hidden) / size, add(repeats) / size, np.log1p(n),
        ], 1)
    return out


@dataclass
class Trees:
    """Boosted trees of a fixed depth; a node is a (feature, threshold) pair, rows above the threshold go right."""

    base: float
    depth: int
    nodes: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for feature, threshold, leaf in self.nodes:
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[np.arange(len(x)), feature[at]] > threshold[at])
            out += leaf[at - (2**self.depth - 1)]
        return out


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 48, ridge: float = 2.0) -> Trees:
    """Fit trees to 0/1 labels by second-order steps on the logistic loss, over quantile histograms."""
    p0 = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
    model = Trees(float(np.log(p0 / (1 - p0))), depth)
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins)[1:-1])) for c in x.T]
    code = np.stack([np.searchsorted(c, v) for c, v in zip(cuts, x.T)], 1)
    margin = np.full(len(y), model.base)
    inner = 2**depth - 1
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        feature, threshold, at = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(len(y), np.int64)
        for level in range(depth):
            low = 2**level - 1
            for node in range(low, 2 * low + 1):
                rows = np.flatnonzero(at == node)
                if len(rows) < 2:
                    continue
                best, total_g, total_h = 1e-6, g[rows].sum(), h[rows].sum()
                for f in range(x.shape[1]):
                    if not len(cuts[f]):
                        continue
                    left_g = np.cumsum(np.bincount(code[rows, f], g[rows], len(cuts[f]) + 1))[:-1]
                    left_h = np.cumsum(np.bincount(code[rows, f], h[rows], len(cuts[f]) + 1))[:-1]
                    gain = left_g**2 / (left_h + ridge) + (total_g - left_g) ** 2 / (total_h - left_h + ridge) - total_g**2 / (total_h + ridge)
                    k = int(gain.argmax())
                    if gain[k] > best:
                        best, feature[node], threshold[node] = gain[k], f, cuts[f][k]
            at = 2 * at + 1 + (x[np.arange(len(x)), feature[at]] > threshold[at])
        own = at - inner
        leaf = -rate * np.bincount(own, g, inner + 1) / (np.bincount(own, h, inner + 1) + ridge)
        model.nodes.append((feature, threshold, leaf))
        margin += leaf[own]
    return model


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots of a non-decreasing map from x to the share of y, to be interpolated between."""
    blocks: list[list[float]] = []
    for a, b in zip(x[order := np.argsort(x, kind="stable")], y[order]):
        blocks.append([float(a), float(a), float(b), 1.0])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][3] >= blocks[-1][2] * blocks[-2][3]:
            low, high = blocks[-2], blocks.pop()
            low[1], low[2], low[3] = high[1], low[2] + high[2], low[3] + high[3]
    knots = [(k, s / n) for lo, hi, s, n in blocks for k in dict.fromkeys((lo, hi))]
    return np.array([k for k, _ in knots]), np.array([v for _, v in knots])


@dataclass
class Model:
    lexicon: np.ndarray
    weights: np.ndarray
    trees: Trees | None
    knots: tuple[np.ndarray, np.ndarray] | None
    share: float

    def score(self, texts: list) -> np.ndarray:
        if self.trees is None:
            return np.full(len(texts), self.share)
        return np.clip(np.interp(self.trees.margin(features(texts, self.lexicon, self.weights)), *self.knots), 0, 1)


def _sample(labels: DataFrame, teach: Column, max_rows: int) -> DataFrame:
    rows = labels.where(teach & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    return rows.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)


def fit(docs: DataFrame, labels: DataFrame, teach: Column, max_rows: int = MAX_ROWS) -> Model:
    """Learn from labelled rows that satisfy teach, a condition on doc_id; max_rows bounds what is broadcast and collected."""
    ship(docs.sparkSession)
    sample = F.broadcast(_sample(labels, teach, max_rows))
    rows = docs.select("doc_id", "text").join(sample, "doc_id").select("doc_id", "text", "toxic")

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = batch.column(1).to_numpy(zero_copy_only=False)
            texts = batch.column(0).to_pylist()
            for a, b in slices(texts, 1 << 19):
                h, n = hash_words(texts[a:b], _WORD_END, _PLAIN)
                doc = np.repeat(np.arange(b - a), n)
                order = np.lexsort((doc, h))
                h, doc = h[order], doc[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(h[new].view(np.int64)), pa.array(toxic[a:b][doc[new]].astype(np.int64))], ["h", "toxic"])
        tidy()

    counts = rows.select("text", "toxic").mapInArrow(words, "h long, toxic long").groupBy("h").agg(F.sum("toxic").alias("t"), F.count("*").alias("n"))
    totals = rows.agg(F.sum("toxic").alias("t"), F.count("*").alias("n")).first()
    toxic, clean = totals["t"] or 0, totals["n"] - (totals["t"] or 0)
    if not toxic or not clean:
        return Model(np.empty(0, np.uint64), np.empty(0), None, None, 1.0 if toxic else 0.0)
    odds = F.log((F.col("t") + 0.5) / (toxic - F.col("t") + 0.5)) - F.log((F.col("n") - F.col("t") + 0.5) / (clean - F.col("n") + F.col("t") + 0.5))
    spread = F.sqrt(1 / (F.col("t") + 0.5) + 1 / (F.col("n") - F.col("t") + 0.5))
    top = counts.where(F.col("t") >= MIN_TOXIC_DOCS).select("h", odds.alias("w"), (odds / spread).alias("z")).where(F.col("z") >= MIN_Z).orderBy(F.desc("z"), "h").limit(LEXICON).toArrow()
    lexicon, weights = top.column("h").to_numpy().view(np.uint64), top.column("w").to_numpy()
    order = np.argsort(lexicon)
    lexicon, weights = lexicon[order], weights[order]

    def dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features(batch.column(1).to_pylist(), lexicon, weights)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(x), pa.list_(pa.float64())), batch.column(2)], ["doc_id", "x", "toxic"])
        tidy()

    got = rows.mapInArrow(dense, "doc_id long, x array<double>, toxic int").groupBy("doc_id").agg(F.min(F.struct("x", "toxic")).alias("r"))
    got = got.select("doc_id", "r.x", "r.toxic").orderBy("doc_id").toArrow()
    x, y = np.array(got.column("x").to_pylist()), got.column("toxic").to_numpy().astype(np.float64)
    kept = np.arange(len(y)) % CALIBRATE == CALIBRATE - 1
    if len({*y[kept]}) < 2 or len({*y[~kept]}) < 2:
        kept = np.zeros(len(y), bool)
    trees = boost(x[~kept], y[~kept])
    calibration = kept if kept.any() else ~kept
    return Model(lexicon, weights, trees, isotonic(trees.margin(x[calibration]), y[calibration]), float(y.mean()))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score and predicted for every row of docs."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = held.value.score(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= CUT).astype(np.int32))], ["doc_id", "score", "predicted"])
        tidy()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, "doc_id long, score double, predicted int")


def keep_clean(docs: DataFrame, labels: DataFrame, teach: Column) -> DataFrame:
    """The rows of docs, with all their columns, that aren't predicted toxic (filter mode of the same model)."""
    held = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, teach))

    @F.pandas_udf("int")
    def toxic(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for text in batches:
            yield pd.Series((held.value.score(text.to_list()) >= CUT).astype(np.int32))  # null is None
        tidy()

    return docs.where(toxic(F.col("text")) == 0)


def query(spark, sf_dir: str) -> DataFrame:
    """Whole documents table; labels of rows whose crc32(doc_id) mod 4 is 2 don't teach."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    fold = bucket_of(F.col("doc_id"), 4)
    return score(docs, fit(docs, labels, fold != 2)).withColumn("held_out", F.coalesce(fold == 2, F.lit(False)))
