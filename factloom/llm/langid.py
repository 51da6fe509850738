"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counting is one pass that adds up (lang, bucket) counts of all training texts; the log-probability matrix, of
2**BITS rows by at most MAX_LANGS columns, is broadcast, and texts are scored in batches: a text is a sparse row whose
column indices are its n-grams' buckets, multiplied by the matrix.

Defined results: null text, or text without a letter, gives ``und`` with score 0; rows with null lang never train;
no training rows at all give ``und`` with score 0; rows with equal doc_id are separate rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import bucket_of, ship, slices

#: Buckets of n-grams, 2**BITS.
BITS = 16
#: Lengths of n-grams, in code points of the lower-cased text.
ORDERS = (2, 3)
#: The matrix's bound: more languages than this are refused.
MAX_LANGS = 1024
#: Added to every count.
ALPHA = 0.5
#: Languages whose counts a task holds before it hands them on, and numbers of a step of the sparse product: bounds of memory.
HELD, STEP = 64, 1 << 22

_MUL = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)


def gram_buckets(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of all texts one after another (rows), and where each text's buckets begin and end."""
    parts = [("\n" + t.lower() + "\n") for t in texts]
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    code = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
    edge = np.concatenate([[0], np.cumsum(sizes)])
    rows = []
    for n in ORDERS:
        h = np.full(len(code), n, np.uint32)
        for i in range(n):
            h[: len(code) - i] ^= code[i:] * _MUL[i]
            h *= np.uint32(0x27D4EB2F)
            h ^= h >> np.uint32(15)
        rows.append((h >> np.uint32(32 - BITS)).astype(np.int32))
    # An n-gram that starts in a text's last place would reach into the next text: it counts for no text.
    return np.stack(rows), edge


def _inner(edge: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    return edge[:-1], np.maximum(edge[1:] - (n - 1), edge[:-1])


def count_grams(docs: DataFrame, training: Column) -> DataFrame:
    """lang, bucket, n over all training rows."""

    def hand_on(total: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for x, counts in total.items():
            some = np.flatnonzero(counts)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([x] * len(some), pa.string()), "bucket": some.astype(np.int32), "n": counts[some].astype(np.int64)})
        total.clear()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in slices(texts, 1 << 20):
                rows, edge = gram_buckets(texts[a:b])
                codes = {x: i for i, x in enumerate(dict.fromkeys(langs[a:b]))}
                of = np.fromiter((codes[x] for x in langs[a:b]), np.int64, b - a)
                for n, row in zip(ORDERS, rows):
                    place = np.zeros(len(row) + 1, np.int8)
                    start, end = _inner(edge, n)
                    np.add.at(place, start, 1)
                    np.add.at(place, end, -1)
                    kept = np.cumsum(place[:-1]).astype(bool)
                    lang = np.repeat(of, np.diff(edge))
                    lang, row = lang[kept], row[kept]
                    for low in range(0, len(codes), HELD):
                        names = list(codes)[low : low + HELD]
                        some = slice(None) if len(codes) <= HELD else (lang >= low) & (lang < low + HELD)
                        both = np.bincount((lang[some] - low) << BITS | row[some], minlength=len(names) << BITS).reshape(len(names), -1)
                        for x, own in zip(names, both):
                            total[x] = total[x] + own if x in total else own.copy()
                        if len(total) > HELD:
                            yield from hand_on(total)
        yield from hand_on(total)

    rows = docs.where(training & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang")
    return rows.mapInArrow(work, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, training: Column) -> tuple[list[str], np.ndarray]:
    """Languages in code-point order, and the log-probability matrix (languages are equally likely before the text is seen)."""
    ship(docs.sparkSession)
    counts = count_grams(docs, training)
    table = counts.where(F.col("lang").isNotNull()).toArrow()  # at most MAX_LANGS x 2**BITS rows
    langs = sorted(set(table.column("lang").to_pylist()))
    if len(langs) > MAX_LANGS:
        raise ValueError(f"{len(langs)} languages; the matrix holds {MAX_LANGS}")
    matrix = np.full((1 << BITS, len(langs)), ALPHA)
    if langs:
        at = {x: i for i, x in enumerate(langs)}
        matrix[table.column("bucket").to_numpy(), [at[x] for x in table.column("lang").to_pylist()]] += table.column("n").to_numpy()
        matrix = np.log(matrix / matrix.sum(0))
    return langs, matrix.astype(np.float32)


def _sums(matrix: np.ndarray, row: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """For each text the sum of the matrix's rows at row[start:end], some rows at a time."""
    out, step = np.zeros((len(start), matrix.shape[1])), max(1, STEP // matrix.shape[1])
    for a in range(0, len(row), step):
        part = row[a : a + step]
        lo, hi = (x.clip(a, a + len(part)) - a for x in (start, end))
        on = np.flatnonzero(hi > lo)
        if len(on):
            rows = np.concatenate([matrix[part].astype(np.float64), np.zeros((1, matrix.shape[1]))])
            out[on] += np.add.reduceat(rows, np.stack([lo[on], hi[on]], 1).ravel(), axis=0)[::2]
    return out


def score_batch(texts: list, langs: list[str], matrix: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Predicted language and its posterior for each text; ties go to the language first in code-point order."""
    names, scores = ["und"] * len(texts), np.zeros(len(texts))
    if not langs:
        return names, scores
    for a, b in slices(texts, 1 << 19):
        live = [i for i in range(a, b) if texts[i] is not None and any(map(str.isalpha, texts[i]))]
        if not live:
            continue
        rows, edge = gram_buckets([texts[i] for i in live])
        logp = np.zeros((len(live), len(langs)))
        for n, row in zip(ORDERS, rows):
            logp += _sums(matrix, row, *_inner(edge, n))
        logp -= logp.max(1, keepdims=True)
        p = np.exp(logp)
        p /= p.sum(1, keepdims=True)
        best = p.argmax(1)
        for i, k in zip(live, best.tolist()):
            names[i] = langs[k]
        scores[live] = p[np.arange(len(live)), best]
    return names, scores


def identify(docs: DataFrame, training: Column, held_out: Column) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of docs (doc_id, text, lang); training says which rows teach."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(fit(docs, training))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = score_batch(batch.column(2).to_pylist(), *model.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), "text")
    return rows.mapInArrow(work, "doc_id long, held_out boolean, lang_pred string, score double")


def query(spark, sf_dir: str) -> DataFrame:
    """Whole documents table; rows whose crc32(doc_id) mod 5 is 0 (or whose doc_id is null) don't teach."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    fold = bucket_of(F.col("doc_id"), 5)
    return identify(docs, fold != 0, fold == 0)
