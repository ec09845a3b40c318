"""Exact top-k inner products by the three-phase uniform threshold method.

Vectors are cut into column blocks, the nodes; a row's score is the sum of its scores at the nodes.

1. Every node hands on its best rows for each query, ``LISTS`` times k of them. The exact scores of
   these rows give a lower bound of the k-th best score, and that bound over the number of nodes is a safe
   cutoff: a row that is below it at every node is below the bound.
2. The cutoffs are broadcast and every node hands on all scores that reach them. A row's known scores and
   the cutoff for the others bound its score from above; rows whose bound is too low go.
3. The exact scores of the rows left decide.

Queries are taken in blocks of bounded size, each a broadcast against one pass over all rows; tasks
keep one score matrix of a few megabytes. No pair is written unless a phase needs it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repovigil.session import written

NODES = 2
LISTS = 10
QUERY_BLOCK = 4096
_ROWS = 2048
_QUERIES = 256
_EXACT = 2**53
_LARGEST = 2**31


def _quantized(scale: int):
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, vectors = [], []
            for vec_id, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if vec_id is None or v is None or any(x is None for x in v):
                    continue
                x = np.floor(scale * np.array(v, np.float64))
                if np.isfinite(x).all():
                    if len(x) and np.abs(x).max() > _LARGEST:
                        raise ValueError(f"vector {vec_id}: a component is too large for integer scores")
                    ids.append(vec_id)
                    vectors.append(x.astype(np.int64).tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(vectors, pa.binary())], ["vec_id", "vector"]
            )

    return step


def _matrix(vectors: list[bytes], width: int) -> np.ndarray:
    """Rows of equal width; shorter vectors are filled with zeros."""
    if all(len(v) == 8 * width for v in vectors):
        return np.frombuffer(b"".join(vectors), np.int64).reshape(len(vectors), width)
    out = np.zeros((len(vectors), width), np.int64)
    for k, v in enumerate(vectors):
        own = np.frombuffer(v, np.int64)[:width]
        out[k, : len(own)] = own
    return out


class Queries:
    """A block of queries: row numbers, and the matrix in the narrowest type that is exact."""

    def __init__(self, rows: list, nodes: int):
        self.uids = np.array([r[0] for r in rows], np.int64)
        self.width = max((len(r[1]) // 8 for r in rows), default=0)
        self.matrix = _matrix([bytes(r[1]) for r in rows], self.width)
        cuts = np.linspace(0, self.width, nodes + 1).astype(int)
        self.nodes = [(a, b) for a, b in zip(cuts, cuts[1:])]

    def scores(self, rows: np.ndarray, lo: int, hi: int, a: int, b: int) -> np.ndarray:
        """Integer scores of the queries lo to hi at the columns a to b, queries down."""
        q, x = self.matrix[lo:hi, a:b], rows[:, a:b]
        bound = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, b - a)
        if bound < _EXACT:
            return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
        return q @ x.T


_ENTRY = "query int, node int, uid long, score long"


def _entries(query, node, uid, score) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(query, pa.int32()), pa.array(node, pa.int32()), pa.array(uid, pa.int64()), pa.array(score, pa.int64())],
        ["query", "node", "uid", "score"],
    )


def _blocks(batches, width: int):
    for batch in batches:
        for start in range(0, batch.num_rows, _ROWS):
            part = batch.slice(start, _ROWS)
            yield part.column(0).to_numpy(zero_copy_only=False), _matrix(part.column(1).to_pylist(), width)


def _local_best(shared, length: int):
    """Phase 1: the task's best rows for each query and node."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q: Queries = shared.value
        n, m, none = len(q.uids), len(q.nodes), np.iinfo(np.int64).min
        best = np.full((m, n, length), none)
        who = np.full((m, n, length), -1, np.int64)
        for uids, rows in _blocks(batches, q.width):
            for lo in range(0, n, _QUERIES):
                hi = min(n, lo + _QUERIES)
                own = q.uids[lo:hi, None] == uids[None, :]
                for j, (a, b) in enumerate(q.nodes):
                    s = q.scores(rows, lo, hi, a, b)
                    s[own] = none
                    # rows that beat the worst of some list so far
                    some = np.flatnonzero((s > best[j, lo:hi].min(1)[:, None]).any(0))
                    both = np.concatenate([best[j, lo:hi], s[:, some]], 1)
                    ids = np.concatenate([who[j, lo:hi], np.broadcast_to(uids[some], (hi - lo, len(some)))], 1)
                    top = np.argpartition(both, -length, 1)[:, -length:]
                    best[j, lo:hi] = np.take_along_axis(both, top, 1)
                    who[j, lo:hi] = np.take_along_axis(ids, top, 1)
        j, i, t = np.nonzero(best > none)
        if len(j):
            yield _entries(i, j, who[j, i, t], best[j, i, t])

    return step


def _sufficient(shared, shared_cuts):
    """Phase 2: every score that reaches its query's cutoff."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q: Queries = shared.value
        cut = shared_cuts.value
        for uids, rows in _blocks(batches, q.width):
            for lo in range(0, len(q.uids), _QUERIES):
                hi = min(len(q.uids), lo + _QUERIES)
                own = q.uids[lo:hi, None] == uids[None, :]
                for j, (a, b) in enumerate(q.nodes):
                    s = q.scores(rows, lo, hi, a, b)
                    i, r = np.nonzero((s >= cut[lo:hi, None]) & ~own)
                    if len(i):
                        yield _entries(i + lo, np.full(len(i), j), uids[r], s[i, r])

    return step


def _resolve(shared):
    """Phase 3: exact scores of rows (query, uid, vec_id, vector)."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q: Queries = shared.value
        for batch in batches:
            for start in range(0, batch.num_rows, _ROWS):
                part = batch.slice(start, _ROWS)
                at = part.column(0).to_numpy(zero_copy_only=False)
                rows = _matrix(part.column(3).to_pylist(), q.width)
                score = (q.matrix[at] * rows).sum(1)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), part.column(2), pa.array(score, pa.int64())],
                    ["query", "uid", "vec_id", "score"],
                )

    return step


def _exact(pairs: DataFrame, vectors: DataFrame, shared) -> DataFrame:
    """Exact scores of pairs (query, uid)."""
    return pairs.join(vectors, "uid").select("query", "uid", "vec_id", "vector").mapInArrow(
        _resolve(shared), "query int, uid long, vec_id long, score long"
    )


def _search(vectors: DataFrame, queries: Queries, k: int) -> DataFrame:
    spark = vectors.sparkSession
    shared = spark.sparkContext.broadcast(queries)
    n, m = len(queries.uids), len(queries.nodes)
    narrow = vectors.select("uid", "vector")

    local = narrow.mapInArrow(_local_best(shared, LISTS * k), _ENTRY)
    rank = F.row_number().over(Window.partitionBy("query", "node").orderBy(F.desc("score"), "uid"))
    lists = local.withColumn("nth", rank).where(F.col("nth") <= LISTS * k).select("query", "uid").distinct()
    known = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score")))
    bounds = _exact(lists, vectors, shared).withColumn("nth", known).where(F.col("nth") == k)
    # a query with fewer than k rows has no bound: everything is sent
    bound = np.full(n, np.iinfo(np.int64).min // 4)
    for r in bounds.select("query", "score").collect():  # a number for each query of the block
        bound[r[0]] = r[1]
    cut = -(-bound // m)

    sent = narrow.mapInArrow(_sufficient(shared, spark.sparkContext.broadcast(cut)), _ENTRY)
    limits = spark.createDataFrame([(i, int(b), int(c)) for i, (b, c) in enumerate(zip(bound, cut))], "query int, bound long, cut long")
    # a score that was not sent is below the cutoff
    upper = F.col("known") + (m - F.col("nodes")) * (F.col("cut") - 1)
    left = (
        sent.groupBy("query", "uid").agg(F.sum("score").alias("known"), F.count("*").alias("nodes"))
        .join(F.broadcast(limits), "query").where(upper >= F.col("bound")).select("query", "uid")
    )
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "uid")
    return _exact(left, vectors, shared).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = 10,
    scale: int = 1024,
    nodes: int = NODES,
    query_block: int = QUERY_BLOCK,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best rows for each row that ``is_query`` (over ``vec_id``).

    Components count as floor(scale * x); vectors that are null or hold null or non-finite components,
    and rows without an id, take no part. A row is not compared with itself, but with other rows of its
    id. Ties go to the smaller id, among equal ids to either row. Shorter vectors count as filled with
    zeros. With fewer other rows than ``k`` all are returned.
    """
    spark = vectors.sparkSession
    rows = vectors.select(
        F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector")
    )
    own = written(rows.mapInArrow(_quantized(scale), "vec_id long, vector binary").withColumn(
        "uid", F.monotonically_increasing_id()), "topk-vectors")
    asked = own.where(is_query).select("uid", "vector", F.xxhash64("uid").alias("h"), "vec_id")
    count = asked.count()
    blocks = max(1, -(-count // query_block))
    out = None
    for block in range(blocks):
        mine = asked.where(F.pmod("h", F.lit(blocks)) == block)
        queries = Queries(mine.orderBy("vec_id", "uid").select("uid", "vector").collect(), nodes)  # about query_block rows
        names = spark.createDataFrame(
            [(k_, int(u)) for k_, u in enumerate(queries.uids)], "query int, query_uid long"
        ).join(asked.select(F.col("uid").alias("query_uid"), F.col("vec_id").alias("query_id")), "query_uid")
        if count:
            found = _search(own, queries, k).join(names, "query")
        else:
            found = names.withColumns({"rank": F.lit(0), "vec_id": F.lit(0), "score": F.lit(0)}).limit(0)
        found = found.select(
            "query_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").cast("bigint").alias("vec_id"),
            F.col("score").cast("bigint").alias("score"),
        )
        found = written(found, "topk-found") if blocks > 1 else found
        out = found if out is None else out.unionByName(found)
    return out
