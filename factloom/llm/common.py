"""What the operators of this subpackage share: lineage cuts, code shipping and vectorised word hashes."""

from __future__ import annotations

import contextlib
import ctypes
import os
import tempfile
import zipfile
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts: a character class for Java, Python and RE2 regular expressions.
WS = r"[\x20\x09-\x0D]+"
WS_CHARS = " \t\n\x0b\f\r"
#: Bytes of text that one vectorised step handles; bounds a worker's temporary arrays.
WINDOW = 1 << 18

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give executors this package, once per application; they may not share the driver's folders."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    target = os.path.join(tempfile.mkdtemp(), "factloom_code.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    spark.sparkContext.addPyFile(target)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))  # long texts: a batch ends by bytes as well as by rows
    _shipped.add(app)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the folder that the cluster names (or one of our own if it names none)."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(sc.getConf().get("spark.checkpoint.dir") or tempfile.mkdtemp(prefix="factloom-"))
    return df.checkpoint(eager=True)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by keys to a fixed number of tasks: for small rows with much work, which would be gathered in few tasks by size."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def bucket_of(doc_id: Column, n: int) -> Column:
    """crc32 of the id written as text, mod n; null for a null id."""
    return F.when(doc_id.isNotNull(), F.crc32(doc_id.cast("string").cast("binary")) % n)


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only; text that is pure ASCII takes the built-in's fast path."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def word_count(text: Column) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+``; 0 for null."""
    t = F.btrim(text, F.lit(WS_CHARS))
    return F.when(F.coalesce(F.length(t), F.lit(0)) == 0, F.lit(0)).otherwise(F.size(F.split(t, WS))).cast("long")


# --- word hashes -----------------------------------------------------------------------------------------------

_P = 0x9E3779B97F4A7C15
_P_INV = pow(_P, -1, 1 << 64)
_BYTE = np.random.Generator(np.random.PCG64(7)).integers(0, 1 << 64, 256, dtype=np.uint64, endpoint=False)
_tables: dict[str, np.ndarray] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit over a 64-bit word."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_tables.get("p", ())) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        for key, base in (("p", _P), ("q", _P_INV)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _tables[key] = np.cumprod(steps)
    return _tables["p"][:n], _tables["q"][:n]


def separators(extra: bytes = b"") -> np.ndarray:
    """Table of the bytes that end a word: the contracts' white space, and extra ones."""
    table = np.zeros(256, bool)
    table[list(WS_CHARS.encode() + extra)] = True
    return table


def lower_fold() -> np.ndarray:
    """Byte table that lower-cases A-Z."""
    fold = np.arange(256, dtype=np.uint8)
    fold[65:91] += 32
    return fold


SEPARATOR, FOLD = separators(), lower_fold()


def _window_words(buf: np.ndarray, sep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words of a folded byte window."""
    is_sep = np.ones(len(buf) + 2, bool)
    is_sep[1:-1] = sep[buf]
    turn = np.flatnonzero(is_sep[1:] != is_sep[:-1])
    starts, ends = turn[::2], turn[1::2]
    if not len(starts):
        return starts, ends, np.empty(0, np.uint64)
    p, q = _powers(len(buf) + 1)
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTE[buf] * p[: len(buf)], out=total[1:])
    h = (total[ends] - total[starts]) * q[starts]
    return starts, ends, mix64(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def hash_words(texts: list, sep: np.ndarray = SEPARATOR, fold: np.ndarray = FOLD) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the texts in order, and each text's number of words (null: 0).

    The hash of a word depends on its folded UTF-8 bytes alone. Work goes in windows that end at a separator,
    so memory follows WINDOW and the longest single word, not the longest text.
    """
    blobs = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
    ends = np.cumsum(np.fromiter((len(b) + 1 for b in blobs), np.int64, len(blobs))) if blobs else np.empty(0, np.int64)
    buf = np.frombuffer(b"\n".join(blobs) + b"\n", np.uint8) if blobs else np.empty(0, np.uint8)
    hashes, places, at = [], [], 0
    while at < len(buf):
        to = min(len(buf), at + WINDOW)
        while to < len(buf):
            last = np.flatnonzero(sep[buf[at:to]])
            if len(last):
                to = at + int(last[-1]) + 1
                break
            to = min(len(buf), to + WINDOW)
        s, _, h = _window_words(fold[buf[at:to]], sep)
        hashes.append(h)
        places.append(s + at)
        at = to
    if not hashes:
        return np.empty(0, np.uint64), np.zeros(len(texts), np.int64)
    place = np.concatenate(places)
    upto = np.searchsorted(place, ends)
    return np.concatenate(hashes), np.diff(upto, prepend=0)


def tidy() -> None:
    """At a partition's end: give freed memory back, since a Python worker outlives its task (where the C library can)."""
    import pyarrow as pa

    _tables.clear()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def slices(texts: list, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Runs of neighbouring texts of about ``most`` characters (a longer text is a run of its own)."""
    start = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t is not None else 0
        if i > start and size + n > most:
            yield start, i
            start, size = i, 0
        size += n + 1
    if start < len(texts):
        yield start, len(texts)
