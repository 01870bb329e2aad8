"""Exact top-k inner products by vector-approximation files.

Vectors are packed into blocks. A block stores, beside its exact vectors, a cell number of each
component (16 cells a dimension, cut at the block's quantiles) and each cell's least and largest
value. For a query, the cells bound every vector's score from both sides; the kth largest lower bound
(or the kth exact score so far) rules out the vectors whose upper bound lies below it, and the rest
are read exactly in the order of their upper bounds until the next bound is below the kth score.

Blocks are gathered in stripes and queries in chunks of bounded size; a task takes one stripe and
one chunk, and a query's k best of each stripe are merged by rank.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed

K, SCALE, CELLS = 20, 64, 16
BLOCK = 4096
#: Vectors of a stripe and queries of a chunk, at most; small tables get smaller stripes.
STRIPE, CHUNK = 1 << 18, 1 << 14
#: Components are cut off at this size, so that sums stay within a long.
LIMIT = 2.0**28
PACKED = "part long, n int, dim int, uids binary, ids binary, cells binary, low binary, high binary, exact binary"


def integers(vectors) -> np.ndarray:
    """floor(64 x) of every component as float64 (exact whole numbers); shorter vectors end in zeros."""
    dim = max(map(len, vectors), default=0)
    out = np.zeros((len(vectors), dim))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = np.clip(np.floor(SCALE * np.asarray(v, dtype=np.float64)), -LIMIT, LIMIT)
    return out


def approximate(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cell numbers (n, dim) and each cell's least and largest value (CELLS, dim)."""
    n, dim = x.shape
    cells = np.zeros((n, dim), np.uint8)
    low, high = np.zeros((CELLS, dim)), np.zeros((CELLS, dim))
    for d in range(dim):
        cuts = np.quantile(x[:, d], np.arange(1, CELLS) / CELLS)
        cells[:, d] = np.searchsorted(cuts, x[:, d], side="right")
        for c in np.unique(cells[:, d]):
            held = x[cells[:, d] == c, d]
            low[c, d], high[c, d] = held.min(), held.max()
    return cells, low, high


def packed(part: int, rows: pd.DataFrame) -> pd.DataFrame:
    x = integers(rows["embedding"].tolist())
    cells, low, high = approximate(x)
    return pd.DataFrame({"part": [part], "n": [len(x)], "dim": [x.shape[1]], "uids": [rows["uid"].to_numpy("int64").tobytes()], "ids": [rows["vec_id"].to_numpy("int64").tobytes()], "cells": [cells.tobytes()], "low": [low.tobytes()], "high": [high.tobytes()], "exact": [x.tobytes()]})


class Block:
    def __init__(self, row):
        n, dim = int(row.n), int(row.dim)
        self.uids, self.ids = np.frombuffer(row.uids, np.int64), np.frombuffer(row.ids, np.int64)
        self.exact = np.frombuffer(row.exact, np.float64).reshape(n, dim)
        cells = np.frombuffer(row.cells, np.uint8).reshape(n, dim)
        self.low = np.frombuffer(row.low, np.float64).reshape(CELLS, dim)[cells, np.arange(dim)]
        self.high = np.frombuffer(row.high, np.float64).reshape(CELLS, dim)[cells, np.arange(dim)]


def best(scores: np.ndarray, ids: np.ndarray, uids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    return np.lexsort((uids, ids, -scores))[:k]


def scan(block: Block, q: np.ndarray, uids: np.ndarray, found: list, k: int) -> int:
    """Improves ``found`` (scores, ids, uids of each query's best) by the block's vectors; vectors read."""
    dim = min(q.shape[1], block.exact.shape[1])
    q = q[:, :dim]
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    low, high, read = block.low[:, :dim], block.high[:, :dim], 0
    upper = up @ high.T + down @ low.T
    lower = up @ low.T + down @ high.T
    for i in range(len(q)):
        scores, ids, held = found[i]
        own = block.uids == uids[i]
        ub = np.where(own, -np.inf, upper[i])
        lb = np.where(own, -np.inf, lower[i])
        floor = scores[-1] if len(scores) == k else -np.inf
        if len(lb) >= k:
            floor = max(floor, np.partition(lb, len(lb) - k)[len(lb) - k])
        likely = np.flatnonzero((ub >= floor) & ~own)
        likely = likely[np.argsort(-ub[likely], kind="stable")]
        for at in range(0, len(likely), 64):
            some = likely[at : at + 64]
            if len(scores) == k and ub[some[0]] < scores[-1]:
                break
            read += len(some)
            scores, ids, held = np.append(scores, block.exact[some, :dim] @ q[i]), np.append(ids, block.ids[some]), np.append(held, block.uids[some])
            top = best(scores, ids, held, k)
            scores, ids, held = scores[top], ids[top], held[top]
        found[i] = (scores, ids, held)
    return read


def top_k(vectors: DataFrame, k: int = K, every: int = 20, spread: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best other rows (all, if fewer).

    Queries are the rows whose vec_id is divisible by ``every``. Rows whose vector is null or holds
    a null or non-finite component, or whose vec_id is null, take no part. Vectors of unlike length
    are compared as if the shorter one ended in zeros; components beyond 2**28 after scaling count
    as that. Rows that repeat a vec_id are rows of their own: each is a query and a candidate for
    the other. Ties go to the smaller vec_id; an empty table gives no rows; other columns are
    ignored. ``spread`` is the number of stripes to aim for on small tables.
    """
    spark = vectors.sparkSession
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = checkpointed(vectors.where(F.col("embedding").isNotNull() & F.col("vec_id").isNotNull()).where(F.coalesce(finite, F.lit(False))).select(F.monotonically_increasing_id().alias("uid"), F.col("vec_id").cast("long").alias("vec_id"), "embedding"))
    total = rows.count()
    asked = rows.where(F.pmod("vec_id", F.lit(every)) == 0)
    queries = asked.count()
    parts, chunks = max(1, math.ceil(total / BLOCK)), max(1, math.ceil(queries / min(CHUNK, 1024 if queries < 1 << 16 else CHUNK)))
    spread = spread or 2 * spark.sparkContext.defaultParallelism
    per_stripe = max(1, min(STRIPE // BLOCK, math.ceil(parts / spread)))
    deal = lambda n: F.pmod(F.xxhash64("uid"), F.lit(n))

    blocks = rows.withColumn("part", deal(parts)).groupBy("part").applyInPandas(lambda key, g: packed(key[0], g), PACKED)
    blocks = checkpointed(blocks.withColumn("stripe", F.floor(F.col("part") / per_stripe)))
    grid = blocks.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))).groupBy("stripe", "chunk")
    stripes = math.ceil(parts / per_stripe)
    sent = asked.withColumn("chunk", deal(chunks).cast("int")).withColumn("stripe", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(stripes - 1).cast("long")))).groupBy("stripe", "chunk")

    def search(held: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        out = {"query_uid": [], "query_id": [], "vec_id": [], "uid": [], "score": []}
        blocks_ = [Block(row) for row in held.itertuples()]
        for at in range(0, len(asks), 256):
            some = asks.iloc[at : at + 256]
            q, uids = integers(some["embedding"].tolist()), some["uid"].to_numpy()
            found = [(np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(some)
            for block in blocks_:
                scan(block, q, uids, found, k)
            for uid, vec_id, (scores, ids, mine) in zip(uids, some["vec_id"], found):
                out["query_uid"] += [uid] * len(ids)
                out["query_id"] += [vec_id] * len(ids)
                out["vec_id"] += ids.tolist()
                out["uid"] += mine.tolist()
                out["score"] += [int(s) for s in scores]
        return pd.DataFrame(out).astype({"query_uid": "int64", "query_id": "int64", "vec_id": "int64", "uid": "int64", "score": "int64"})

    parts_best = grid.cogroup(sent).applyInPandas(search, "query_uid long, query_id long, vec_id long, uid long, score long")
    order = Window.partitionBy("query_uid").orderBy(F.desc("score"), "vec_id", "uid")
    return parts_best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
