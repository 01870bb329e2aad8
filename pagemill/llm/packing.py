"""Packing token sequences by cutting-stock column generation.

Documents are cut into pieces of at most ``width`` tokens (only documents longer than a sequence are
cut). The pieces' lengths, rounded up to a multiple of ``unit``, make a histogram of at most
``width / unit`` classes, which is all the driver ever sees. A linear program over patterns (how many
pieces of each class one sequence holds) is solved by column generation: the restricted master's
dual prices go to a knapsack dynamic program, whose best pattern enters the basis until none pays.
Rounded-down patterns take their share of each class; the few pieces that rounding leaves (fewer
than one sequence for each pattern of the basis) are placed first-fit by decreasing class. Pieces
are ranked within their class, and a rank alone says which sequence a piece goes to.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tokens
from .common import checkpointed, grouped_rank, small_batches

WIDTH, UNIT, END = 4096, 16, 2
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def knapsack(prices: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The dearest multiset of sizes that fits the capacity: its price and the count of each size."""
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    order = np.argsort(sizes, kind="stable")
    s, p = sizes[order], prices[order]
    for room in range(1, capacity + 1):
        best[room] = best[room - 1]
        n = np.searchsorted(s, room, side="right")
        if n:
            value = best[room - s[:n]] + p[:n]
            k = int(value.argmax())
            if value[k] > best[room] + 1e-12:
                best[room], last[room] = value[k], k
    counts, room = np.zeros(len(sizes), dtype=np.int64), capacity
    while room > 0:
        if last[room] < 0:
            room -= 1
        else:
            counts[order[last[room]]] += 1
            room -= int(s[last[room]])
    return float(best[capacity]), counts


def column_generation(sizes: np.ndarray, demand: np.ndarray, capacity: int, gap: float = 0.002, rounds: int = 4000) -> list[tuple[np.ndarray, float]]:
    """(pattern, times) of a basis of the cutting-stock relaxation, optimal but for ``gap``; times are fractions.

    Prices are smoothed towards the point with the best bound so far (at first each class's share of a
    sequence), which keeps them from swinging; the plain prices are used where those find no column.
    """
    m = len(sizes)
    columns = np.diag(capacity // sizes).astype(float)
    costs = np.ones(m)  # a pattern costs a sequence, a surplus column (more than the demand) nothing
    inverse = np.diag(1.0 / np.diag(columns))
    wanted = demand * (1 + 1e-6 * np.arange(1, m + 1) / m)  # all but equal steps would stall
    x = inverse @ wanted
    centre = sizes / capacity
    bound = float(centre @ demand)
    for step in range(rounds):
        prices = costs @ inverse
        pattern, cost = None, 1.0
        if prices.min() < -1e-9:
            pattern, cost = -(np.arange(m) == prices.argmin()).astype(float), 0.0
        for share in () if pattern is not None else (0.9, 0.6, 0.0):
            mixed = np.maximum(share * centre + (1 - share) * prices, 0)
            value, found = knapsack(mixed, sizes, capacity)
            below = float(mixed @ demand) / max(1.0, value)
            if below > bound:
                bound, centre = below, mixed / max(1.0, value)
            if prices @ found > 1 + 1e-7:
                pattern = found
                break
        if pattern is None or costs @ x <= bound * (1 + gap):
            break
        direction = inverse @ pattern
        up = direction > 1e-9
        ratio = np.full(m, np.inf)
        ratio[up] = np.maximum(x[up], 0) / direction[up]
        leave = int(ratio.argmin())
        row = inverse[leave] / direction[leave]
        inverse -= np.outer(direction, row)
        inverse[leave] = row
        columns[:, leave], costs[leave] = pattern, cost
        if step % 200 == 199:
            inverse = np.linalg.inv(columns)
        x = inverse @ wanted
    return [(columns[:, k].astype(np.int64), max(0.0, float(x[k]))) for k in range(m) if costs[k]]


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Patterns (class -> pieces) and how many sequences use each; together they hold every piece."""
    if not histogram:
        return []
    sizes = np.array(sorted(histogram))
    left = np.array([histogram[int(s)] for s in sizes], dtype=np.int64)
    out = []
    for pattern, times in column_generation(sizes, left, capacity):
        n = int(times + 1e-9)
        while n > 0 and (pattern := np.minimum(pattern, left)).any():  # a pattern may hold more of a class than there is
            used = np.flatnonzero(pattern)
            some = min(n, int((left[used] // pattern[used]).min()))
            left -= some * pattern
            n -= some
            out.append(({int(sizes[k]): int(pattern[k]) for k in used}, some))
    while left.any():  # what rounding left: fewer pieces than the patterns hold
        room, pattern = capacity, {}
        for k in range(len(sizes) - 1, -1, -1):
            n = min(int(left[k]), room // int(sizes[k]))
            if n:
                pattern[int(sizes[k])] = n
                left[k] -= n
                room -= n * int(sizes[k])
        out.append((pattern, 1))
    return out


def slots(patterns: list[tuple[dict[int, int], int]]) -> list[tuple[int, list[tuple[int, int, int, int]]]]:
    """For each class the runs of ranks (from, to, pieces a sequence, first sequence) that patterns take."""
    first, taken, runs = 0, {}, {}
    for pattern, n in patterns:
        for size, count in pattern.items():
            at = taken.get(size, 0)
            runs.setdefault(size, []).append((at, at + n * count, count, first))
            taken[size] = at + n * count
        first += n
    return sorted(runs.items())


def pieces(docs: DataFrame, vocabulary: str, width: int = WIDTH, end: int = END) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens of every piece, in one pass over the texts."""
    small_batches(docs.sparkSession)

    def cut(batches):
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = tokens.encode(text, vocabulary, end)
                n = len(ids) // 4
                view = memoryview(ids)
                rows += [(doc_id, at, min(width, n - at), zlib.crc32(view[4 * at : 4 * (at + width)]), n) for at in range(0, n, width)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)] or [pa.array([], pa.int64())] * 5, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, PIECES)


def pack(docs: DataFrame, vocabulary: str, width: int = WIDTH, unit: int = UNIT, end: int = END) -> DataFrame:
    """Sequences of at most ``width`` tokens that hold every token of ``docs`` once.

    Needs doc_id and text, ignores other columns. Null and empty texts are one token (``end``); a
    repeated row is packed as often as it occurs; an empty table gives no rows; a document longer
    than ``width`` is cut every ``width`` tokens. Ties of length are ranked by their place in the
    checkpointed table. Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.
    """
    spark = docs.sparkSession
    cut = checkpointed(
        pieces(docs, vocabulary, width, end)
        .withColumn("size", F.ceil(F.col("length") / unit).cast("int"))
        .withColumn("uid", F.monotonically_increasing_id())
    )
    histogram = {r["size"]: r["n"] for r in cut.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()}  # width / unit rows at most
    runs = slots(plan(histogram, width // unit))
    places = spark.createDataFrame(runs, "size int, runs array<struct<lo: long, hi: long, each: long, first: long>>")
    ranked = grouped_rank(cut, "size", "uid", histogram).join(F.broadcast(places), "size")
    run = F.filter("runs", lambda r: (r["lo"] <= F.col("rank")) & (F.col("rank") < r["hi"]))[0]
    placed = ranked.withColumn("run", run).withColumn("sequence_id", F.expr("run.first + (rank - run.lo) div run.each"))
    order = Window.partitionBy("sequence_id").orderBy(F.desc("size"), "uid").rowsBetween(Window.unboundedPreceding, -1)
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", F.coalesce(F.sum("length").over(order), F.lit(0)).alias("offset"))
