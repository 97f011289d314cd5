"""Approximate nearest neighbours by a forest of random projections (operator 3).

*Index.*  Each tree splits a bounded sample at the median along the difference
of two random members, until about ``leaf_rows`` rows of the table fall to a
leaf or ``max_depth`` is reached; every row then gets its leaf in every tree.
Equal vectors are one entry with their smallest ids: the nearest k rows never
need more than k + 1 of them, so a vector that a third of the rows share costs
no more than another.

*Search.*  All trees of a query share one priority queue of nodes, by how far
the query is from them: the root of the summed squares of the margins of the
splits that were crossed on the way.  It stops when the next leaf is farther
than ``reach`` times the distance of the k-th neighbour found so far in the
sample.  So the work follows the data, not a share of the table: where vectors
have close neighbours few leaves are opened, and in noise without structure,
where all distances are alike, many are.  At least k + 1 sample members are seen.

Leaf blocks then meet query blocks by (tree, leaf); candidates are ranked
exactly, in double precision, on the original vectors, and only the best of a
block leave it.  Leaves are cut into blocks of bounded size, so a crowded leaf
spreads over tasks.  Vectors travel in their own precision.

Fitting takes at most ``sample_rows`` different vectors, of which a group of
copies is one; all rows are indexed.  The same rule holds at every size.  Vectors
that are null, zero, of another length than most, or hold null or non-finite
components take no part, as queries or as candidates.  Rows may repeat: each is
a candidate of its own, but a row's own id is never its neighbour.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import save

TREES, REACH, SAMPLE_ROWS = 4, 0.14, 8000
LEAF_ROWS, MAX_DEPTH = 512, 12
BLOCK, QUERY_BLOCK = 4096, 512


class Forest:
    """Trees as arrays: hyperplanes and thresholds by node, and the sample's leaves."""

    def __init__(self, sample: np.ndarray, trees: int, depth: int, seed: int = 42):
        rng = np.random.default_rng(seed)
        self.depth, self.trees = depth, trees
        nodes = 2**depth - 1
        self.planes = np.zeros((trees, nodes, sample.shape[1]), np.float32)
        self.cuts = np.zeros((trees, nodes), np.float32)
        for t in range(trees):
            at = np.zeros(len(sample), np.int64)
            for level in range(depth):
                order = np.argsort(at, kind="stable")
                for own in np.split(order, np.flatnonzero(np.diff(at[order])) + 1):
                    if len(own) < 2:
                        continue
                    k = at[own[0]]
                    a, b = sample[rng.choice(own, 2, replace=False)]
                    plane = (a - b) / (np.linalg.norm(a - b) or 1)
                    self.planes[t, k] = plane
                    self.cuts[t, k] = np.median(sample[own] @ self.planes[t, k])
                at = self._down(sample, t, at)
        leaves = self.leaves(sample)
        self.members = [[np.flatnonzero(leaves[:, t] == k).astype(np.int32) for k in range(2**depth)] for t in range(trees)]
        self.sample = sample

    def _down(self, x: np.ndarray, t: int, at: np.ndarray) -> np.ndarray:
        return 2 * at + 1 + (np.einsum("ij,ij->i", x, self.planes[t, at]) > self.cuts[t, at])

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """(rows, trees): the leaf of each unit vector."""
        out = np.empty((len(x), self.trees), np.int32)
        for t in range(self.trees):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = self._down(x, t, at)
            out[:, t] = at - (2**self.depth - 1)
        return out

    def search(self, q: np.ndarray, reach: float, k: int) -> list[tuple[int, int]]:
        """(tree, leaf) in the order of the shared queue until the next is too far."""
        margins = (self.planes @ q - self.cuts).tolist()
        queue = [(0.0, t, 0) for t in range(self.trees)]
        heapq.heapify(queue)
        apart = np.sqrt(np.maximum(0, 2 - 2 * (self.sample @ q)))
        first = 2**self.depth - 1
        seen, best = np.zeros(len(apart), bool), np.full(k + 1, np.inf)  # the query itself may be in the sample
        out = []
        while queue:
            far, t, node = heapq.heappop(queue)
            if node >= first:
                if far > reach * best[-1]:
                    break
                out.append((t, node - first))
                own = self.members[t][node - first]
                own = own[~seen[own]]
                if len(own):
                    seen[own] = True
                    best = np.sort(np.concatenate([best, apart[own]]))[: k + 1]
                continue
            m = margins[t][node]
            heapq.heappush(queue, (math.hypot(far, max(m, 0.0)), t, 2 * node + 1))
            heapq.heappush(queue, (math.hypot(far, max(-m, 0.0)), t, 2 * node + 2))
        return out


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def index_rows(batches: Iterator[pa.RecordBatch], forest: Forest) -> Iterator[pa.RecordBatch]:
    """(ids, vector) -> a row for each tree."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 1000):
            part = batch.slice(lo, 1000)
            leaves = forest.leaves(unit(matrix(part.column(1))).astype(np.float32))
            for t in range(forest.trees):
                yield pa.record_batch([pa.array(np.full(len(part), t, np.int32)), pa.array(leaves[:, t]), *part.columns], ["tree", "leaf", "ids", "v"])


def probe_rows(batches: Iterator[pa.RecordBatch], forest: Forest, reach: float, k: int) -> Iterator[pa.RecordBatch]:
    """(id, vector) -> a row for each leaf to look into."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 100):
            part = batch.slice(lo, 100)
            found = [forest.search(q, reach, k) for q in unit(matrix(part.column(1))).astype(np.float32)]
            row = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
            both = np.array([x for f in found for x in f], np.int32).reshape(-1, 2)
            yield pa.record_batch([pa.array(both[:, 0]), pa.array(both[:, 1]), *(c.take(row) for c in part.columns)], ["tree", "leaf", "id", "v"])


def cosines(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Row by row, so that a pair's value doesn't depend on what else is in the block."""
    a, b = q * q, x * x
    return (q * x).sum(axis=1) / (np.sqrt(a.sum(axis=1)) * np.sqrt(b.sum(axis=1)))


def rank_block(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """(queries, entries) of a block of one leaf -> the best k + 1 entries of each query."""
    for batch in batches:
        for queries, entries in zip(batch.column(0), batch.column(1), strict=True):
            qs, es = queries.values, entries.values
            qid, ids = qs.field("id").to_numpy(zero_copy_only=False), es.field("ids")
            q, x = matrix(qs.field("v")).astype(np.float64), matrix(es.field("v")).astype(np.float64)
            first = np.array([i[0] for i in ids.to_pylist()])
            near = unit(q) @ unit(x).T
            take = min(k + 1, near.shape[1])
            bound = np.partition(near, near.shape[1] - take, axis=1)[:, near.shape[1] - take] - 1e-9
            r, c = np.nonzero(near >= bound[:, None])  # ties and rounding included
            score = cosines(q[r], x[c])
            order = np.lexsort((first[c], -score, r))
            r, c, score = r[order], c[order], score[order]
            begin = np.searchsorted(r, r, side="left")
            ok = np.arange(len(r)) - begin < take
            r, c, score = r[ok], c[ok], score[ok]
            yield pa.record_batch([pa.array(qid[r]), pa.array(score), ids.take(pa.array(c))], ["query_id", "score", "ids"])


def usable(v: Column) -> Column:
    """Non-null, non-zero, all components finite."""
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & fine & F.exists(v, lambda x: x != 0)


def nearest(rows: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector: str = "embedding", trees: int = TREES, reach: float = REACH, sample_rows: int = SAMPLE_ROWS, leaf_rows: int = LEAF_ROWS, max_depth: int = MAX_DEPTH) -> DataFrame:
    """query_id, rank, id_col, score: the k nearest rows found for each query row."""
    own = rows.schema[vector].dataType.simpleString()
    kind = own if own in ("array<float>", "array<double>") else "array<double>"
    base = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast(kind).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    base = base.where(F.col("id").isNotNull() & F.coalesce(usable(F.col("v")), F.lit(False)))
    width = base.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    out_schema = f"query_id long, rank int, {id_col} long, score double"
    if width is None:
        return rows.sparkSession.createDataFrame([], out_schema)
    base = base.where(F.size("v") == width["n"])
    same = Window.partitionBy("h1", "h2").orderBy("id")
    hashed = base.select("id", "v", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit("second"), "v").alias("h2"))
    few = hashed.withColumn("n", F.row_number().over(same)).where(F.col("n") <= k + 1)
    entries = save(few.groupBy("h1", "h2").agg(F.sort_array(F.collect_list("id")).alias("ids"), F.first("v").alias("v")).select("ids", "v"), "entries")
    depth = max(1, min(max_depth, round(math.log2(max(2, entries.count() / leaf_rows)))))
    first = F.col("ids")[0]
    sample = entries.select("v").orderBy(F.xxhash64(first), first).limit(sample_rows).toArrow().column("v").combine_chunks()  # a bounded sample of different vectors
    forest = Forest(unit(matrix(sample)).astype(np.float32), trees, depth)
    index = save(entries.mapInArrow(lambda b: index_rows(b, forest), f"tree int, leaf int, ids array<long>, v {kind}"), "index")
    sizes = index.groupBy("tree", "leaf").count().select("tree", "leaf", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))  # trees * 2**max_depth rows at most
    cut = index.join(F.broadcast(sizes), ["tree", "leaf"])
    blocks = cut.groupBy("tree", "leaf", F.pmod(F.xxhash64("v"), F.col("blocks")).alias("b")).agg(F.collect_list(F.struct("ids", "v")).alias("entries"))
    probes = save(base.where("asks").select("id", "v").dropDuplicates().mapInArrow(lambda b: probe_rows(b, forest, reach, k), f"tree int, leaf int, id long, v {kind}"), "probes")
    asked = probes.groupBy("tree", "leaf").count().select("tree", "leaf", F.ceil(F.col("count") / QUERY_BLOCK).cast("int").alias("parts"))
    queries = probes.join(F.broadcast(asked), ["tree", "leaf"]).groupBy("tree", "leaf", F.pmod(F.xxhash64("id"), F.col("parts")).alias("p")).agg(F.collect_list(F.struct("id", "v")).alias("queries"))
    found = queries.join(blocks, ["tree", "leaf"]).select("queries", "entries").mapInArrow(lambda b: rank_block(b, k), "query_id long, score double, ids array<long>")
    pairs = found.select("query_id", "score", F.explode("ids").alias("id")).where("id != query_id").groupBy("query_id", "id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    ranked = pairs.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias(id_col), "score")


def query(spark, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)
