"""Approximate nearest neighbours with a hash-prefix forest.

Vectors are dealt over shards of up to SHARD_MB; each shard holds up to TREES sorted arrays of hash strings (signs of random
projections, BITS at most). A batch of queries descends, each in those trees where its bits are farthest from their planes, to
the prefix of the fitted depth; queries under one prefix meet the rows under it in one matrix product, whose best are kept. A query that found fewer than k candidates ascends, half of
its depth each time, to the root if need be. Those kept are ranked by their exact distance in double precision on the
original vectors, and the shards' best are merged. Equal vectors of a shard are compared once.

Trees, visits and depth are fitted on a sample: for about QUERIES queries the k nearest of all rows are found by brute force, and the
cheapest forest is taken in which a share RECALL of them meets its query. Projections are centred on the mean of a sample of
about SAMPLE rows, which one task takes, so the driver gets one vector whatever the input; every valid row is indexed.

Defined results: vectors that are null, empty, zero, hold a null or non-finite component, or aren't of the most frequent
length take no part, nor do rows with null vec_id; rows with equal vec_id are candidates each on its own and one query
(its smallest vector); a query never meets rows of its own vec_id; ties go to the smaller vec_id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import ship, spread, tidy

#: Rows of a shard, while there are at most SHARDS; beyond, shards grow to SHARD_MB of vectors.
SHARD, SHARDS, SHARD_MB = 8192, 64, 48
SAMPLE, QUERIES = 4096, 256
TREES, BITS, RECALL = 128, 16, 0.98
#: Queries of a row that is shuffled, queries that a shard takes at once, and scores of one matrix product.
QUERY_BLOCK, BATCH, PRODUCT = 4096, 1 << 16, 1 << 18
#: Candidates beyond k that single precision keeps for the exact distances.
SPARE = 4
#: Seconds that a score, a product and a row of a tree take, to weigh forests against each other.
SCORE_S, PRODUCT_S, ROW_S = 4e-9, 3e-5, 1.2e-7


def valid(v: Column) -> Column:
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return v.isNotNull() & F.coalesce(fine, F.lit(False)) & F.exists(v, lambda x: x != 0)


def planes(width: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(9)).standard_normal((TREES, width, BITS)).astype(np.float32)


def labels(x: np.ndarray, trees: int, depth: int) -> np.ndarray:
    """A depth-bit string for each tree and centred vector, first bit highest."""
    powers = (1 << np.arange(depth)[::-1]).astype(np.float32)
    return np.array([((x @ p[:, :depth] > 0).astype(np.float32) @ powers).astype(np.uint16) for p in planes(x.shape[1])[:trees]])


def chances(x: np.ndarray, trees: int, depth: int) -> np.ndarray:
    """For each tree and vector how likely a near one shares its string: its bits' distances from their planes, about as logarithms of chances."""
    unit = x / np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x)), 1e-30)[:, None]
    return np.array([-np.log1p(np.exp(-1.2 * np.abs(unit @ p[:, :depth]))).sum(1) for p in planes(x.shape[1])[:trees]])


def shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of BITS-bit strings."""
    return BITS - np.frexp((a ^ b).astype(np.float64))[1]


def centred(x: np.ndarray, centre: np.ndarray, kind: type = np.float32) -> np.ndarray:
    """x - centre, in steps that bound the doubles."""
    out = np.empty(x.shape, kind)
    with np.errstate(over="ignore"):
        for i in range(0, len(x), 8192):
            out[i : i + 8192] = x[i : i + 8192] - centre
    return out


def precision(x: np.ndarray, base: np.ndarray) -> type:
    """Single, unless a few of the vectors are far larger than most."""
    most = np.array([np.abs(x[i : i + 8192] - base).max(1).max() for i in range(0, len(x), 8192)]).max()
    return np.float32 if 1e-6 < np.median(np.abs(x[:: len(x) // 4096 + 1] - base).max(1)) and most < 1e6 else np.float64


def halves(x: np.ndarray) -> np.ndarray:
    """Rows with one more column, so that a product with (query, 1) is greater, the nearer the row is."""
    with np.errstate(over="ignore"):
        return np.column_stack([x, -0.5 * np.einsum("ij,ij->i", x, x)])


def ones(x: np.ndarray) -> np.ndarray:
    return np.column_stack([x, np.ones(len(x), x.dtype)])


def ranks(groups: np.ndarray) -> np.ndarray:
    """Place of each element within its run of equal ones, from 0."""
    start = np.flatnonzero(np.diff(groups, prepend=groups[:1] - 1))
    return np.arange(len(groups)) - np.repeat(start, np.diff(start, append=len(groups)))


class Forest:
    def __init__(self, ids: np.ndarray, vectors: np.ndarray, centre: np.ndarray, trees: int, visits: int, depth: int):
        h = np.zeros(len(ids), np.uint64)
        for column in vectors.T:
            h = (h ^ (column + 0.0).astype(vectors.dtype).view(f"u{vectors.itemsize}")) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        by = np.lexsort((ids, h))
        h, self.ids = h[by], ids[by]
        new = np.ones(len(ids), bool)
        for i in range(0, len(ids), 8192):  # equal hashes of different vectors part here
            a, b = by[max(0, i - 1) : i + 8191], by[max(1, i) : i + 8192]
            new[max(1, i) : i + 8192] = (vectors[a[: len(b)]] != vectors[b]).any(1)
        #: Rows start[u] to end[u] have the vector u, with growing ids.
        self.start = np.flatnonzero(new)
        self.end = np.append(self.start[1:], len(ids))
        self.vectors = vectors[by[self.start]]
        self.by_id = np.sort(ids)
        self.centre, self.trees, self.visits, self.depth = centre, trees, visits, depth
        x = centred(self.vectors, centre)
        #: For each tree, the vectors in order of their strings, and where each string begins.
        self.rows = np.empty((trees, len(x)), np.int32)
        self.first = np.empty((trees, 2**depth + 1), np.int32)
        for t, label in enumerate(labels(x, trees, depth)):
            self.rows[t] = np.argsort(label, kind="stable")
            self.first[t] = np.searchsorted(label[self.rows[t]].astype(np.int32), np.arange(2**depth + 1))
        #: Scores are of differences to a median, which a few huge vectors don't move.
        self.base = np.median(self.vectors[:: len(self.vectors) // 4096 + 1], axis=0).astype(np.float64)
        del x
        self.x = halves(centred(self.vectors, self.base, precision(self.vectors, self.base)))

    def merge(self, hits: list, ids: np.ndarray, keep: int, limit: np.ndarray) -> list:
        """The best keep different vectors of each query; limit gets the score that a better one must reach."""
        q, u, s = (np.concatenate(a) for a in zip(*hits))
        pair = (q.astype(np.int64) << 32) | u
        by = np.argsort(pair)
        by = by[np.diff(pair[by], prepend=-1) != 0]
        q, u, s = q[by], u[by], s[by]
        fine = (self.ids[self.start[u]] != ids[q]) | (self.ids[self.end[u] - 1] != ids[q])
        q, u, s = q[fine], u[fine], s[fine]
        bits = s.view(np.int32).astype(np.int64)
        by = np.argsort((q.astype(np.int64) << 32) - np.where(bits < 0, -(bits & 0x7FFFFFFF), bits))  # by query, greatest score first
        q, u, s = q[by], u[by], s[by]
        rank = ranks(q)
        last = rank == keep - 1
        limit[q[last]] = np.maximum(limit[q[last]], s[last])
        stays = rank < keep
        return [(q[stays], u[stays], s[stays])]

    def meet(self, asked: np.ndarray, x: np.ndarray, label: np.ndarray, visited: np.ndarray, shift: int, ids: np.ndarray, own: np.ndarray, keep: int, limit: np.ndarray, hits: list) -> list:
        """hits, and those of the asked queries under their prefixes without the last shift bits, in the trees that each visits."""
        waiting, wanting = 0, asked
        for t in range(self.trees if shift < self.depth else 1):
            asked = wanting[visited[t, wanting]] if shift < self.depth else wanting
            prefix = label[t, asked].astype(np.int64) >> shift
            by = np.argsort(prefix, kind="stable")
            prefix, first = np.unique(prefix[by], return_index=True)
            low, high = (self.first[t, p << shift] for p in (prefix, prefix + 1))
            for a, b, lo, hi in zip(first, [*first[1:], len(by)], low, high):
                for at in range(lo, hi, 2048):
                    rows = self.rows[t, at : min(hi, at + 2048)]
                    right = self.x[rows].T
                    step = max(1, PRODUCT // len(rows))
                    for i in range(a, b, step):
                        some = asked[by[i : min(b, i + step)]]
                        score = x[some] @ right
                        if score.dtype == np.float64:  # same order, within the range of single precision
                            score = np.sign(score) * np.abs(score) ** 0.125
                        bar, most = limit[some], keep + int(own[some].max())
                        if len(rows) > most and np.isneginf(bar).any():
                            bar = limit[some] = np.maximum(bar, np.partition(score, -most, axis=1)[:, -most])
                        found = np.flatnonzero(score >= bar[:, None])
                        if len(found):
                            q, r = np.divmod(found, len(rows))
                            hits.append((some[q].astype(np.int32), rows[r], score.ravel()[found].astype(np.float32)))
                            waiting += len(found)
                        if waiting > max(8 * len(wanting), PRODUCT):
                            hits, waiting = self.merge(hits, ids, keep, limit), 0
        return self.merge(hits, ids, keep, limit) if hits else hits

    def search(self, ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """For each query the ids and distances of up to k candidates, nearest first; a distance of nan where there is none."""
        x = centred(queries, self.centre)
        label, visited = labels(x, self.trees, self.depth), np.ones((self.trees, len(x)), bool)
        if self.visits < self.trees:
            visited[:] = False
            for i in range(0, len(x), 8192):
                most = np.argpartition(-chances(x[i : i + 8192], self.trees, self.depth), self.visits - 1, axis=0)[: self.visits]
                np.put_along_axis(visited[:, i : i + 8192], most, True, 0)
        x = ones(centred(queries, self.base, precision(queries, self.base)))
        own = np.searchsorted(self.by_id, ids, "right") - np.searchsorted(self.by_id, ids)
        limit, hits = np.full(len(ids), -np.inf, np.float32), []
        asked, depth = np.arange(len(ids)), self.depth
        while len(asked):
            hits = self.meet(asked, x, label, visited, self.depth - depth, ids, own, k + SPARE, limit, hits)
            if not depth:
                break
            enough = np.zeros(len(ids), np.int64)
            for q, u, _ in hits:
                np.add.at(enough, q, np.maximum(1, self.end[u] - self.start[u] - own[q]))
            asked, depth = asked[enough[asked] < k], depth // 2
            limit[asked] = -np.inf
        out, far = np.zeros((len(ids), k), np.int64), np.full((len(ids), k), np.nan)
        for q, u, _ in hits:
            distance = np.concatenate([np.sqrt(((self.vectors[u[i : i + 8192]].astype(np.float64) - queries[q[i : i + 8192]]) ** 2).sum(1)) for i in range(0, len(q), 8192)]) if len(q) else np.empty(0)
            many = np.minimum(self.end[u] - self.start[u], k + own[q])
            q, distance, at = np.repeat(q, many), np.repeat(distance, many), np.repeat(self.start[u], many)
            found = self.ids[at + (np.arange(len(q)) - np.repeat(np.cumsum(many) - many, many))]
            fine = found != ids[q]
            q, distance, found = q[fine], distance[fine], found[fine]
            by = np.lexsort((found, distance, q))
            q, distance, found = q[by], distance[by], found[by]
            rank = ranks(q)
            best = rank < k
            out[q[best], rank[best]], far[q[best], rank[best]] = found[best], distance[best]
        return out, far


def middle(rows: DataFrame, count: int) -> np.ndarray:
    """Mean of the different rows (vec_id, v) whose hash falls in a share of SAMPLE out of count."""

    def mean(pdf):
        import pandas as pd

        return pd.DataFrame({"v": [np.sort(np.array(pdf["v"].tolist()), axis=0).mean(0)]})  # sorted, so that reruns agree

    place, most = F.pmod(F.xxhash64("vec_id", "v"), F.lit(count)), SAMPLE
    while not (found := rows.where(place < most).select("vec_id", "v").distinct().groupBy().applyInPandas(mean, "v array<double>").collect()):
        most *= 16  # few different rows, many times each
    return np.array(found[0]["v"])


def matrix(column, kind: str) -> np.ndarray:
    """Rows of an Arrow list column whose lists have one length."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(kind, copy=False)


def cheapest(pairs: np.ndarray, of: np.ndarray, x: np.ndarray, among: np.ndarray, rows: float, queries: int) -> tuple[int, int, int]:
    """Trees, visits of a query and depth of least cost in a shard of so many rows that find a share RECALL of the pairs.

    pairs: for each tree (across), the prefix that the sample query x[of] and one of its nearest share; among: two of the sample.
    """
    best, batches = (np.inf, TREES, TREES, 1), -(-queries // BATCH)
    for depth in range(1, BITS + 1):
        share = (among >= depth).mean() if among.size else 0.5**depth
        chance = chances(x, TREES, depth).T
        for trees in (TREES >> i for i in range(5)):
            order = np.argsort(-chance[:, :trees], axis=1, kind="stable")
            met = np.take_along_axis(pairs[:, :trees] >= depth, order[of], 1)
            recall = np.maximum.accumulate(met, 1).mean(0) if len(met) else np.ones(trees)
            visits = int(np.argmax(recall >= RECALL)) + 1 if recall[-1] >= RECALL else trees
            if recall[-1] >= RECALL or (trees, depth) == (TREES, 1):
                cost = visits * (share * rows * queries * SCORE_S + batches * min(2**depth, queries) * PRODUCT_S) + trees * rows * ROW_S
                best = min(best, (cost if recall[-1] >= RECALL else 1e18, trees, visits, depth))
    return best[1:]


def fit(rows: DataFrame, asked: DataFrame, n: int, centre: np.ndarray, shard: float, k: int, kind: str) -> tuple[int, int, int]:
    """Trees, visits and depth, by the nearest of all rows to about QUERIES of the n queries."""
    most = QUERIES
    while not (some := asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(n)) < most).collect()):
        most *= 4
    ids, raw = np.array([r["vec_id"] for r in some]), np.array([r["v"] for r in some], np.float64)
    bare, base = centred(raw, centre), np.median(raw, axis=0)
    label, exact = labels(bare, TREES, BITS), precision(raw, base)
    x = ones(centred(raw, base, exact))

    def nearest(batches):
        import pyarrow as pa

        far, near = np.full((len(ids), k), -np.inf, x.dtype), np.zeros((len(ids), k, x.shape[1] - 1), exact)
        for batch in batches:
            if not len(batch["vec_id"]):
                continue
            own, v = batch["vec_id"].to_numpy(), centred(matrix(batch["v"], kind), base, exact)
            for i in range(0, len(own), 4096):
                score = x @ halves(v[i : i + 4096]).T
                score[ids[:, None] == own[None, i : i + 4096]] = -np.inf
                top = np.argpartition(score, -min(k, score.shape[1]), axis=1)[:, -min(k, score.shape[1]) :]
                far, near = np.concatenate([far, np.take_along_axis(score, top, 1)], 1), np.concatenate([near, v[i + top]], 1)
                by = np.argsort(-far, axis=1, kind="stable")[:, :k]
                far, near = np.take_along_axis(far, by, 1), np.take_along_axis(near, by[:, :, None], 1)
        lcp = shared(np.repeat(label, k, axis=1), labels(centred(near.reshape(len(ids) * k, -1), centre - base), TREES, BITS)).T.reshape(len(ids), -1).astype(np.uint8)
        yield pa.RecordBatch.from_pydict({"s": pa.array(np.arange(len(ids)), pa.int32()), "far": [a.tobytes() for a in (np.sign(far) * np.abs(far) ** 0.125).astype(np.float32)], "lcp": [a.tobytes() for a in lcp]})
        tidy()

    def best(pdf):
        import pandas as pd

        far = np.concatenate([np.frombuffer(a, np.float32) for a in pdf["far"]])
        by = np.argsort(-far, kind="stable")[:k]
        by = by[~np.isneginf(far[by])]
        return pd.DataFrame({"s": pdf["s"].iloc[:1], "lcp": [np.concatenate([np.frombuffer(a, np.uint8).reshape(-1, TREES) for a in pdf["lcp"]])[by].tobytes()]})

    found = rows.select("vec_id", "v").mapInArrow(nearest, "s int, far binary, lcp binary").groupBy("s").applyInPandas(best, "s int, lcp binary").collect()
    pairs = [np.frombuffer(r["lcp"], np.uint8).reshape(-1, TREES) for r in found]
    of = np.repeat([r["s"] for r in found], [len(p) for p in pairs])
    i, j = np.triu_indices(len(ids), 1)
    return cheapest(np.concatenate(pairs), of, bare, shared(label[:, i], label[:, j]), shard, n)


def search(vectors: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for each row of vectors (vec_id, embedding) that is_query marks."""
    spark = vectors.sparkSession
    ship(spark)
    single = dict(vectors.dtypes)["embedding"] == "array<float>"
    kind = "f4" if single else "f8"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>" if single else "array<double>").alias("v"), is_query.alias("q")).where(F.col("vec_id").isNotNull() & valid(F.col("v")))
    lengths = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if lengths is None:
        return spark.createDataFrame([], schema)
    width, count = lengths["n"], lengths["count"]
    rows = rows.where(F.size("v") == width)
    asked = rows.where("q").groupBy("vec_id").agg(F.min("v").alias("v"))
    n = asked.count()
    if not n:
        return spark.createDataFrame([], schema)
    shards = min(-(-count // SHARD), max(SHARDS, -(-count * width * (4 if single else 8) // (SHARD_MB << 20))))
    centre = middle(rows.select("vec_id", F.col("v").cast("array<double>").alias("v")), count)
    trees, visits, depth = fit(rows, asked, n, centre, count / shards, k, kind)
    packed = "shard int, block int, ids binary, vs binary"

    def pack(batches):
        """Rows of a shard in chunks: block -1."""
        import pyarrow as pa

        def chunks(held: list) -> pa.RecordBatch:
            shard, ids, vs = (np.concatenate(a) for a in zip(*held))
            by = np.argsort(shard, kind="stable")
            at = np.flatnonzero(np.diff(shard[by], prepend=-1))
            parts = np.split(by, at[1:])
            return pa.RecordBatch.from_pydict({"shard": pa.array(shard[by[at]], pa.int32()), "block": pa.array(np.full(len(at), -1), pa.int32()), "ids": [ids[p].tobytes() for p in parts], "vs": [vs[p].tobytes() for p in parts]})

        held, size = [], 0
        for batch in batches:
            if len(batch["vec_id"]):
                held.append((batch["shard"].to_numpy(), batch["vec_id"].to_numpy().copy(), matrix(batch["v"], kind).copy()))
                size += held[-1][2].nbytes
            if size > 32 << 20:
                yield chunks(held)
                held, size = [], 0
        if held:
            yield chunks(held)
        held = []
        tidy()

    def block(pdf):
        import pandas as pd

        return pd.DataFrame({"block": [int(pdf["block"].iloc[0])], "ids": [pdf["vec_id"].to_numpy().tobytes()], "vs": [np.concatenate(pdf["v"].tolist()).astype(kind).tobytes()]})

    def look(batches):
        """A shard's rows, then the blocks of queries: each block's ids, and the ids and distances of its best in this shard."""
        import pyarrow as pa

        def answers(forest: Forest, blocks: list) -> Iterator[pa.RecordBatch]:
            found, far = forest.search(np.concatenate([b for _, b, _ in blocks]), np.concatenate([v for _, _, v in blocks]), k)
            at = 0
            for name, ids, _ in blocks:
                to = at + len(ids)
                yield pa.RecordBatch.from_pydict({"block": pa.array([name], pa.int32()), "ids": [ids.tobytes()], "found": [found[at:to].tobytes()], "far": [far[at:to].tobytes()]})
                at = to

        shard, held, forest, blocks = -1, [], None, []
        for batch in batches:
            for s, b, ids, vs in zip(batch["shard"].to_pylist(), batch["block"].to_pylist(), batch["ids"], batch["vs"]):
                ids, vs = np.frombuffer(ids.as_buffer(), np.int64).copy(), np.frombuffer(vs.as_buffer(), kind).reshape(-1, width).copy()
                if s != shard and blocks:
                    yield from answers(forest, blocks)
                    blocks = []
                if s != shard:
                    shard, held, forest = s, [], None
                if b < 0:
                    held.append((ids, vs))
                    continue
                if held:
                    own, vectors = (np.concatenate(a) for a in zip(*held))
                    held = []
                    forest = Forest(own, vectors, centre, trees, visits, depth)
                    del own, vectors
                if forest is not None:  # else no row fell into this shard
                    blocks.append((b, ids, vs))
                    if sum(len(i) for _, i, _ in blocks) >= BATCH:
                        yield from answers(forest, blocks)
                        blocks = []
        if blocks:
            yield from answers(forest, blocks)
        forest = None
        tidy()

    def best(batches):
        """The best of all shards, block by block."""
        import pyarrow as pa

        def told(ids: np.ndarray, found: np.ndarray, far: np.ndarray) -> pa.RecordBatch:
            fine = ~np.isnan(far)
            q, r = np.nonzero(fine)
            return pa.RecordBatch.from_pydict({"query_id": pa.array(ids[q]), "rank": pa.array(r + 1, pa.int32()), "vec_id": pa.array(found[fine]), "score": pa.array(far[fine])})

        last, ids, found, far = None, None, None, None
        for batch in batches:
            for b, i, f, d in zip(batch["block"].to_pylist(), batch["ids"], batch["found"], batch["far"]):
                f, d = np.frombuffer(f.as_buffer(), np.int64).reshape(-1, k), np.frombuffer(d.as_buffer(), np.float64).reshape(-1, k)
                if b != last:
                    if last is not None:
                        yield told(ids, found, far)
                    last, ids, found, far = b, np.frombuffer(i.as_buffer(), np.int64).copy(), f.copy(), d.copy()
                    continue
                found, far = np.concatenate([found, f], 1), np.concatenate([far, d], 1)
                by = np.lexsort((found, far), axis=1)[:, :k]  # nan comes last
                found, far = np.take_along_axis(found, by, 1), np.take_along_axis(far, by, 1)
        if last is not None:
            yield told(ids, found, far)

    dealt = F.pmod(F.xxhash64("vec_id", "v"), F.lit(shards)).cast("int")
    chunks = rows.select(dealt.alias("shard"), "vec_id", "v").mapInArrow(pack, packed)
    blocks = asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(-(-n // QUERY_BLOCK))).cast("int")).groupBy("block").applyInPandas(block, "block int, ids binary, vs binary")
    # The stated query set, in blocks, against every shard.
    meet = chunks.unionByName(blocks.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))))
    found = spread(meet, "shard").sortWithinPartitions("shard", "block").mapInArrow(look, "block int, ids binary, found binary, far binary")
    return spread(found, "block").sortWithinPartitions("block").mapInArrow(best, schema)


def query(spark, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)
