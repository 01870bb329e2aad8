"""Token ids in files of directly addressable codes.

An id is split into chunks of 8 bits. Level 0 holds the lowest chunk of every id, level k the next
chunk of the ids that have one; a bitmap beside each level marks the ids that go on, and a directory
with the set bits before each block of 512 makes rank(i), the place in the next level, one lookup and
a few popcounts. Any token is read by walking its levels; no block is decoded.

A file is a Parquet file of segments (one row each), so that any store Spark reads can hold it and a
lost task's file is never half visible. A segment covers consecutive documents in doc_id order:

    part, segment   place: parts follow doc_id order, segments are numbered within a part
    first           ids of the part before the segment
    doc_ids, ends   documents, and the ids of the segment up to and including each one's end
    levels, bitmaps, ranks   binary, one entry a level (ranks: little-endian unsigned 32-bit)
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tokens
from .common import shared_path, small_batches

END, BLOCK = 2, 512
#: Ids after which a segment is closed; a longer document is a segment of its own.
SEGMENT_IDS = 1 << 20
SEGMENTS = "part int, segment int, first long, doc_ids array<long>, ends array<long>, levels array<binary>, bitmaps array<binary>, ranks array<binary>"


def dac_encode(ids: np.ndarray) -> tuple[list[bytes], list[bytes], list[bytes]]:
    """Levels, continuation bitmaps and rank directories of unsigned 32-bit ids."""
    levels, bitmaps, ranks = [], [], []
    rest = np.asarray(ids, dtype=np.uint32)
    while True:
        more = rest > 0xFF
        levels.append((rest & 0xFF).astype(np.uint8).tobytes())
        bits = np.packbits(more, bitorder="little")
        counts = np.add.reduceat(more, np.arange(0, len(more), BLOCK), dtype=np.uint32) if len(more) else np.zeros(0, np.uint32)
        bitmaps.append(bits.tobytes())
        ranks.append(np.concatenate([[0], np.cumsum(counts)]).astype("<u4").tobytes())
        if not more.any():
            return levels, bitmaps, ranks
        rest = rest[more] >> 8


def dac_access(levels, bitmaps, ranks, at: np.ndarray) -> np.ndarray:
    """The ids at the given places, each found by rank alone."""
    at = np.asarray(at, dtype=np.int64)
    out = np.zeros(len(at), dtype=np.uint32)
    live, place = np.arange(len(at)), at.copy()
    for k in range(len(levels)):
        level, bits = np.frombuffer(levels[k], np.uint8), np.frombuffer(bitmaps[k], np.uint8)
        out[live] |= level[place].astype(np.uint32) << np.uint32(8 * k)
        goes = (bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1
        live, place = live[goes], place[goes]
        if not len(live):
            break
        directory = np.frombuffer(ranks[k], "<u4").astype(np.int64)
        block = place // BLOCK
        padded = np.concatenate([bits, np.zeros(BLOCK // 8, np.uint8)])
        window = np.unpackbits(padded[(block * (BLOCK // 8))[:, None] + np.arange(BLOCK // 8)], axis=1, bitorder="little")
        place = directory[block] + (window * (np.arange(BLOCK) < (place % BLOCK)[:, None])).sum(axis=1).astype(np.int64)
    return out


def dac_decode(levels, bitmaps) -> np.ndarray:
    """All ids of a segment, level by level from the last."""
    values = np.frombuffer(levels[-1], np.uint8).astype(np.uint32)
    for k in range(len(levels) - 2, -1, -1):
        low = np.frombuffer(levels[k], np.uint8).astype(np.uint32)
        more = np.unpackbits(np.frombuffer(bitmaps[k], np.uint8), count=len(low), bitorder="little").astype(bool)
        low[more] |= values << np.uint32(8)
        values = low
    return values


def _bounds(docs: DataFrame, parts: int) -> list[int]:
    """doc_ids that split the rows into about equal parts."""
    cuts = docs.select(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 20 * parts).alias("q")).first()["q"] if parts > 1 else None
    return sorted(set(cuts or []))


def write(docs: DataFrame, vocabulary: str, path: str, parts: int | None = None, end: int = END) -> str:
    """Writes the ids of all documents in ascending doc_id order to ``path`` (null doc_ids first).

    Null and empty texts are the id ``end`` alone; repeated doc_ids follow each other, ordered by
    their ids' checksum; an empty table writes no segment. Other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    parts = parts or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    cuts = _bounds(docs, parts)
    width = "<u2"

    def to_ids(batches):
        for batch in batches:
            texts = batch["text"].tolist()
            encoded = [np.frombuffer(tokens.encode(t, vocabulary, end), "<u4") for t in texts]
            yield pd.DataFrame({
                "doc_id": batch["doc_id"].astype("Int64"),
                "small": [bool(len(x) == 0 or x.max() < 65536) for x in encoded],
                "ids": [x.astype(width).tobytes() if len(x) == 0 or x.max() < 65536 else x.tobytes() for x in encoded],
                "crc": [zlib.crc32(x) for x in encoded],
            })

    part = F.lit(0)
    if cuts:  # the number of parts is a setting, not a size of the data
        part = F.coalesce(F.expr(f"aggregate(array({','.join(f'{c}L' for c in cuts)}), 0, (n, c) -> n + if(doc_id > c, 1, 0))"), F.lit(0))
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(to_ids, "doc_id long, small boolean, ids binary, crc long")
    dealt = ids.withColumn("part", part.cast("int")).repartitionById(len(cuts) + 1, F.col("part")).sortWithinPartitions("part", "doc_id", "crc")

    def to_segments(batches):
        state = {"part": None, "segment": 0, "first": 0}
        held, doc_ids, size = [], [], 0

        def close():
            levels, bitmaps, ranks = dac_encode(np.concatenate(held))
            row = pd.DataFrame({"part": [state["part"]], "segment": [state["segment"]], "first": [state["first"]], "doc_ids": [doc_ids[:]], "ends": [np.cumsum([len(x) for x in held])], "levels": [levels], "bitmaps": [bitmaps], "ranks": [ranks]})
            state["segment"] += 1
            state["first"] += size
            return row

        for batch in batches:
            for doc_id, small, data, part in zip(batch["doc_id"], batch["small"], batch["ids"], batch["part"]):
                x = np.frombuffer(data, width if small else "<u4").astype(np.uint32)
                if held and (part != state["part"] or size + len(x) > SEGMENT_IDS):
                    yield close()
                    held, doc_ids, size = [], [], 0
                if part != state["part"]:
                    state.update(part=int(part), segment=0, first=0)
                held.append(x)
                doc_ids.append(None if pd.isna(doc_id) else int(doc_id))
                size += len(x)
        if held:
            yield close()

    dealt.mapInPandas(to_segments, SEGMENTS).write.option("compression", "none").parquet(path)
    return path


def read(spark, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, decoded from the files at ``path``."""
    small_batches(spark)
    segments = spark.read.schema(SEGMENTS).parquet(path)
    totals = segments.groupBy("part").agg(F.sum(F.element_at("ends", -1)).alias("n"))  # a row for each part
    before = totals.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))

    def documents(batches):
        for batch in batches:
            for _, s in batch.iterrows():
                ids, ends = dac_decode(s["levels"], s["bitmaps"]).astype("<u4"), np.asarray(s["ends"])
                starts = np.concatenate([[0], ends[:-1]])
                yield pd.DataFrame({"part": s["part"], "doc_id": pd.array([None if pd.isna(d) else int(d) for d in s["doc_ids"]], dtype="Int64"), "at": s["first"] + starts, "n_tokens": ends - starts, "ids_crc32": [zlib.crc32(ids[a:b]) for a, b in zip(starts, ends)]})

    out = segments.select("part", "first", "doc_ids", "ends", "levels", "bitmaps").mapInPandas(documents, "part int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return out.join(F.broadcast(before), "part").select("doc_id", (F.col("at") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def tokens_at(spark, path: str, part: int, places: list[int]) -> dict[int, int]:
    """Random access: the ids at places (counted from the part's first id) without decoding blocks."""
    found = {}
    segments = spark.read.schema(SEGMENTS).parquet(path).where(F.col("part") == part)
    heads = segments.select("segment", "first", F.element_at("ends", -1).alias("n")).orderBy("segment").collect()
    for h in heads:
        mine = [p for p in places if h["first"] <= p < h["first"] + h["n"]]
        if mine:
            s = segments.where(F.col("segment") == h["segment"]).select("levels", "bitmaps", "ranks").first()
            got = dac_access(s["levels"], s["bitmaps"], s["ranks"], np.array(mine) - h["first"])
            found.update({p: int(v) for p, v in zip(mine, got)})
    return found


def round_trip(docs: DataFrame, vocabulary: str, end: int = END) -> DataFrame:
    """Writes the ids of ``docs`` to new files in the shared folder and reads them back."""
    return read(docs.sparkSession, write(docs, vocabulary, shared_path(docs.sparkSession, "token-codes"), end=end))
