"""Byte-level BPE encoding and decoding by DuckDB recursive queries, one engine per Python worker.

A partition's texts are split by the tokenizer's pattern; each distinct match ("word") becomes token-position rows
that a recursive query joins with the merge table, contracting the leftmost pair of minimum rank of every word until
no pair is left. Ordered aggregation turns the rows back into bytes. Documents are gathered from their words' ids.

Defined results: null text counts as empty; empty text has no ids; rows with equal doc_id are separate rows; columns
other than doc_id and text are ignored; text may be of any length (memory follows ``Room.slice`` and the longest text).
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from factloom.llm.common import ship, slices, tidy


@dataclass(frozen=True)
class Room:
    """What a worker's engine may hold: more room, fewer words encoded anew; results are the same."""

    #: Characters of text between two looks at the bound of the word cache.
    slice: int = 1 << 19
    #: Words whose ids a worker remembers, and how many of them (met at least twice) stay when there are more or a partition ends.
    cache: int = 100_000
    keep: int = 50_000
    #: Sum of squared word lengths that one recursive query takes: its rows over all steps are about half of that.
    rows: int = 700_000


#: For an encoder that has its executors to itself: some 300 MB a worker.
WIDE = Room(4 << 20, 1_000_000, 600_000, 4_000_000)
#: Longer words contract all places of their minimum pair in one step where that gives the same result.
LONG_WORD = 96

#: Live rows with their right neighbour's merge: key holds rank and place, so its minimum is the leftmost best pair.
_PAIRS = """
    SELECT s.w, s.pos, s.tok, s.prev, m.safe, m.r, (m.r << 32) + s.pos AS key
    FROM (SELECT w, pos, tok, lead(tok) OVER place AS nxt, lag(pos) OVER place AS prev FROM {table} WHERE live
          WINDOW place AS (PARTITION BY w ORDER BY pos)) s
    LEFT JOIN merges m ON m.a = s.tok AND m.b = s.nxt
"""

#: Rows of a word stay live while it has a pair to merge; its last rows are kept with live = false.
ENCODE = f"""
WITH RECURSIVE step(w, pos, tok, live) AS (
    SELECT w, pos, tok, true FROM seed
    UNION ALL
    SELECT w, pos, CASE WHEN key = best THEN (best >> 32)::INTEGER ELSE tok END, best IS NOT NULL
    FROM (SELECT w, pos, tok, prev, key, min(key) OVER (PARTITION BY w) AS best FROM ({_PAIRS.format(table="step")}))
    WHERE best IS NULL OR prev IS NULL OR prev <> (best & 4294967295)
)
SELECT w, pos, tok FROM step WHERE NOT live ORDER BY w, pos
"""

#: As ENCODE; a safe pair is contracted at all its places in one step, every other one from the left where they overlap.
#: The table holds the last state of each row (by key), so that its size stays that of the words.
ENCODE_LONG = f"""
WITH RECURSIVE step(w, pos, tok, live) USING KEY (w, pos) AS (
    SELECT w, pos, tok, true FROM seed
    UNION
    SELECT w, pos, CASE WHEN dead THEN NULL WHEN hit THEN (best >> 32)::INTEGER ELSE tok END, best IS NOT NULL AND NOT dead
    FROM (SELECT *, coalesce(lag(hit) OVER (PARTITION BY w ORDER BY pos), false) AS dead
          FROM (SELECT w, pos, tok, best, mine AND CASE WHEN safe THEN row_number() OVER (PARTITION BY w, mine, island ORDER BY pos) % 2 = 1 ELSE key = best END AS hit
                FROM (SELECT *, i - row_number() OVER (PARTITION BY w, mine ORDER BY pos) AS island
                      FROM (SELECT *, coalesce(r = best >> 32, false) AS mine, row_number() OVER (PARTITION BY w ORDER BY pos) AS i
                            FROM (SELECT *, min(key) OVER (PARTITION BY w) AS best FROM ({_PAIRS.format(table="recurring.step")}))))))
)
SELECT w, pos, tok FROM step WHERE tok IS NOT NULL ORDER BY w, pos
"""

DECODE = "SELECT w, string_agg(v.piece, '' ORDER BY e.pos) AS piece FROM encoded e JOIN vocab v ON v.id = e.tok GROUP BY w ORDER BY w"


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a file with a base64 token and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Engine:
    """Encoder and decoder over a fixed table of ranks; rank and id are the same number."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, room: Room = Room()):
        import regex

        self.room = room
        self.split = regex.compile(pattern).findall
        pairs = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        a, b, r = (np.array(c, np.int32) for c in zip(*pairs)) if pairs else (np.empty(0, np.int32),) * 3
        # A token that takes part in a pair of lower rank than its own could overtake: such merges go one at a time.
        overtaking = np.unique(np.concatenate([a[r < a], b[r < b]]))
        self.merges = pa.table({"a": a, "b": b, "r": r.astype(np.int64), "safe": ~np.isin(r, overtaking)})
        self.vocab = pa.table({"id": np.fromiter(ranks.values(), np.int32, len(ranks)), "piece": [t.decode("latin-1") for t in ranks]})
        self.byte_id = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        self.db = None
        self.forget()

    def _open(self) -> None:
        import duckdb

        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "300MB"})
        for name in ("merges", "vocab"):
            self.db.register("arriving", getattr(self, name))
            self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM arriving")
            self.db.unregister("arriving")

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.start, self.length, self.uses = (np.empty(0, np.int64) for _ in range(3))
        self.ids = np.empty(0, np.uint32)
        self.pieces: list[bytes] = []

    def rest(self) -> None:
        """Between partitions: close the database, keep only frequent words and give memory back where the C library can."""
        if self.db is not None:
            self.db.close()
            self.db = None
        self.compact()
        tidy()

    def compact(self) -> None:
        """Keep only the words met most often, twice at least."""
        kept = np.flatnonzero(self.uses >= 2)
        if len(kept) > self.room.keep:
            kept = np.sort(kept[np.argsort(-self.uses[kept], kind="stable")[: self.room.keep]])
        new = np.full(len(self.index), -1)
        new[kept] = np.arange(len(kept))
        self.index = {x: j for (x, _), j in zip(self.index.items(), new.tolist()) if j >= 0}
        n = self.length[kept]
        self.ids = self.ids[np.repeat(self.start[kept] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
        self.start, self.length, self.uses = np.cumsum(n) - n, n, self.uses[kept]
        self.pieces = [self.pieces[i] for i in kept.tolist()]

    def _contract(self, words: list[bytes], sql: str) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """Ids of all words one after another, their counts, and the bytes that the ids decode to."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        begin = np.cumsum(lengths) - lengths
        flat = np.frombuffer(b"".join(words), np.uint8)
        w = np.repeat(np.arange(len(words), dtype=np.int32), lengths)
        seed = pa.table({"w": w, "pos": (np.arange(len(flat)) - begin[w]).astype(np.int32), "tok": self.byte_id[flat]})
        self.db.register("seed", seed)
        got = self.db.sql(sql).to_arrow_table()
        self.db.unregister("seed")
        self.db.register("encoded", got)
        pieces = [p.encode("latin-1") for p in self.db.sql(DECODE).to_arrow_table().column("piece").to_pylist()]
        self.db.unregister("encoded")
        return got.column("tok").to_numpy().astype(np.uint32), np.bincount(got.column("w").to_numpy(), minlength=len(words)), pieces

    def learn(self, fresh: list[str]) -> None:
        """Encode and decode words not met before and remember the results."""
        if self.db is None:
            self._open()
        coded = sorted(((x.encode("utf-8", "surrogatepass"), x) for x in fresh), key=lambda p: len(p[0]))
        at = 0
        while at < len(coded):
            size, to = len(coded[at][0]) ** 2, at + 1
            long = len(coded[at][0]) > LONG_WORD
            while to < len(coded) and size + len(coded[to][0]) ** 2 <= self.room.rows and (len(coded[to][0]) > LONG_WORD) == long:
                size += len(coded[to][0]) ** 2
                to += 1
            ids, counts, pieces = self._contract([b for b, _ in coded[at:to]], ENCODE_LONG if long else ENCODE)
            for i, (_, x) in enumerate(coded[at:to], len(self.index)):
                self.index[x] = i
            self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(counts) - counts])
            self.length = np.concatenate([self.length, counts])
            self.uses = np.concatenate([self.uses, np.zeros(len(counts), np.int64)])
            self.ids = np.concatenate([self.ids, ids])
            self.pieces += pieces
            at = to

    def run(self, texts: list) -> Iterator[tuple[np.ndarray, bytes]]:
        """Each text's ids and the bytes they decode to."""
        for a, b in slices(texts, self.room.slice):
            if len(self.index) > self.room.cache:
                self.compact()
            words = [self.split(t) if t else [] for t in texts[a:b]]
            fresh = set().union(*words).difference(self.index)
            if fresh:
                self.learn(sorted(fresh))
            for own in words:
                at = np.fromiter(map(self.index.__getitem__, own), np.int64, len(own))
                np.add.at(self.uses, at, 1)
                n = self.length[at]
                place = np.repeat(self.start[at] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                yield self.ids[place], b"".join([self.pieces[i] for i in at.tolist()])


_engines: dict[str, Engine] = {}


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str, keep_ids: bool = True, room: Room = Room()) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, with keep_ids, ids array<int>, for every row of docs.

    ranks_path names a local file of the driver; its table, of fixed size, is broadcast.
    """
    spark = docs.sparkSession
    ship(spark)
    ranks = spark.sparkContext.broadcast(read_ranks(ranks_path))
    name = f"{ranks_path}|{pattern}|{room}"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from factloom.llm import bpe

        if name not in bpe._engines:
            bpe._engines[name] = bpe.Engine(ranks.value, pattern, room)
        engine = bpe._engines[name]
        for batch in batches:
            rows, held = [], 0
            for doc_id, (ids, decoded) in zip(batch.column(0).to_pylist(), engine.run(batch.column(1).to_pylist())):
                row = (doc_id, len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(decoded).hexdigest())
                rows.append((*row, ids.astype(np.int32)) if keep_ids else row)
                held += len(ids)
                if held > room.slice:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
        engine.rest()

    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    ddl = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    if keep_ids:
        fields.append(("ids", pa.list_(pa.int32())))
        ddl += ", ids array<int>"
    schema = pa.schema(fields)
    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(work, ddl)
