"""Phrase collocations by weighted acyclic automata.

Documents are read once into shards (a few megabytes of one language): word numbers, and the shard's words
with their counts. Words that are frequent enough get ids in the order of (language, word). Each shard
builds a count transducer of its bigrams of frequent words from their sorted rows, cut into cells: a
cell holds the phrases whose first and second words lie in given ranges of ids. Cells are united and summed, a
bounded number of shards at a time, and phrases below the least count go. A shard is cut into a few wide cells; what
is united is cut into finer ones, in the end of about ``CELL`` words of the documents each, so that a cell is no
larger where there are more documents. Each shard is told which of its
bigrams stayed, and the same is done with its phrases of three to five words all of whose
bigrams did (a phrase is never more frequent than its parts). The parts of a candidate are then looked
up in the transducers of the parts' cells, cell by cell.

No task holds more than one shard or about twice the phrases of one cell; nothing is broadcast. The driver holds the cells' bounds.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions.steps import step

from .common import bounded_batches, checkpointed, shared_path, short_lived_shuffles
from .transducer import Transducer, summed
from .wordarrays import byte_classes, column, segments, split

LEAST, TOP, LONGEST = 100, 2000, 5
PIECES = byte_classes(breaks=".,;:!?\n\x0b\x0c\r", blanks=" \t")
SHARD_BYTES, FAN = 8 << 20, 32
#: Bytes of an Arrow batch (a larger row comes alone).
BATCH = 4 << 20
#: Words of the documents to a cell, and candidates whose parts are looked up or written at once.
CELL, CANDIDATES = 1 << 20, 1 << 14
SHARDS = pa.schema([("shard", pa.int64()), ("lang", pa.string()), ("tokens", pa.binary()), ("words", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])


def _small(numbers: np.ndarray) -> bytes:
    """Numbers in two or four bytes each, after one byte that says which."""
    size = 2 if numbers.max(initial=0) < 1 << 16 else 4
    return bytes([size]) + numbers.astype(f"u{size}").tobytes()


def _large(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"u{data[0]}", offset=1).astype(np.int32)


def _shards(table: pa.Table) -> Iterator[dict]:
    """A shard for each language of the table: its words in order, 0 where a piece begins, else the word's number from 1 on."""
    found = split(column(table, "text"), PIECES)
    coded = found.words.dictionary_encode()
    ids = coded.indices.to_numpy(zero_copy_only=False)
    langs = column(table, "lang").dictionary_encode()
    lang_of = langs.indices.to_numpy(zero_copy_only=False)[found.text] if len(ids) else ids
    for k, lang in enumerate(langs.dictionary.to_pylist()):
        mine = np.flatnonzero(lang_of == k)
        if not len(mine):
            continue
        counts = np.bincount(ids[mine], minlength=len(coded.dictionary))
        used = np.flatnonzero(counts)
        local = np.cumsum(counts > 0, dtype=np.int32)
        begins = found.begins[mine]
        tokens = np.zeros(len(mine) + int(begins.sum()), np.int32)
        tokens[np.arange(len(mine)) + np.cumsum(begins)] = local[ids[mine]]
        yield {"lang": lang, "tokens": _small(tokens), "words": coded.dictionary.take(pa.array(used)).cast(pa.large_string()).to_pylist(), "counts": counts[used].tolist()}


def read_shards(docs: DataFrame) -> DataFrame:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for table in segments(batches, "text", SHARD_BYTES):
            for row in _shards(table):
                yield pa.RecordBatch.from_pylist([{"shard": number, **row}], SHARDS)
                number += 1

    path = shared_path(docs.sparkSession, "phrase-shards")
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text")
    rows.mapInArrow(cut, "shard long, lang string, tokens binary, words array<string>, counts array<long>").write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.parquet(path)


def _cells(grams: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Cell of each row: the range of its first word and of its second (0 if it has none)."""
    side = len(bounds) + 1
    second = np.searchsorted(bounds, grams[:, 1], side="right") if grams.shape[1] > 1 else 0
    return np.searchsorted(bounds, grams[:, 0], side="right") * side + second


def _cut(grams: np.ndarray, counts: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """The cells of the rows (in order) and the packed transducer of each."""
    cells = _cells(grams, bounds)
    order = np.argsort(cells, kind="stable")
    ends = np.flatnonzero(np.diff(cells[order])) + 1
    for mine in np.split(order, ends) if len(order) else ():
        yield int(cells[mine[0]]), Transducer.build(grams[mine], counts[mine]).pack()


def _pairs(ranks: np.ndarray, base: int) -> np.ndarray:
    """The code of each word and its successor, -1 where either is none."""
    a, b = ranks[:-1].astype(np.int64), ranks[1:].astype(np.int64)
    return np.where((a > 0) & (b > 0), a * base + b, -1)


def _decoded(code: np.ndarray, base: int, alphabet: np.ndarray) -> np.ndarray:
    return np.column_stack([alphabet[code // base - 1], alphabet[code % base - 1]])


def _bigrams(ranks: np.ndarray, alphabet: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    base = len(alphabet) + 1
    code = _pairs(ranks, base)
    code, counts = np.unique(code[code >= 0], return_counts=True)
    return _decoded(code, base, alphabet), counts.astype(np.int64)


def _longer(ranks: np.ndarray, alphabet: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Phrases of three and more words all of whose bigrams are among ``pairs``, with their counts."""
    base = len(alphabet) + 1
    good = np.sort((np.searchsorted(alphabet, pairs[:, 0]) + 1) * base + np.searchsorted(alphabet, pairs[:, 1]) + 1)
    code = _pairs(ranks, base)
    fits = np.isin(code, good)
    start, rows, sums = np.flatnonzero(fits), [], []
    kind = code[start]  # of the phrase that starts here; numbers of distinct phrases from three words on
    for size in range(3, LONGEST + 1):
        on = (start + size - 2 < len(fits)) & fits[np.minimum(start + size - 2, len(fits) - 1)]
        start, kind = start[on], kind[on]
        if not len(start):
            break
        _, kind = np.unique(kind, return_inverse=True)
        _, at, kind, n = np.unique(kind.astype(np.int64) * base + ranks[start + size - 1], return_index=True, return_inverse=True, return_counts=True)
        grams = alphabet[ranks[start[at][:, None] + np.arange(size)] - 1]
        rows.append(np.pad(grams, ((0, 0), (0, LONGEST - size)), constant_values=-1))
        sums.append(n.astype(np.int64))
    if not rows:
        return np.zeros((0, LONGEST), np.int64), np.zeros(0, np.int64)
    return summed(np.concatenate(rows), np.concatenate(sums))


def unite(pieces: DataFrame, shards: int, least: int, levels: list[np.ndarray]) -> DataFrame:
    """cell, packed: the pieces (cell, shard, packed) of each cell united, at most about FAN at a time; phrases of
    at least ``least``. The pieces are in cells of the first of ``levels`` (bounds), after each union in those of the next."""
    def united(frames: Iterator[pd.DataFrame], least: int = 0) -> tuple[np.ndarray, np.ndarray]:
        return Transducer.united((Transducer.unpack(p) for frame in frames for p in frame["packed"]), least)

    def into(bounds: np.ndarray) -> Callable:
        def some(key: tuple[Any, ...], frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for cell, packed in _cut(*united(frames), bounds):
                yield pd.DataFrame({"cell": [cell], "shard": [key[1]], "packed": [packed]})

        return some

    def last(key: tuple[Any, ...], frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"cell": [key[0]], "packed": [Transducer.build(*united(frames, least)).pack()]})

    for bounds in levels[1:]:
        shards = math.ceil(shards / FAN)
        pieces = pieces.withColumn("shard", F.pmod(F.xxhash64("shard"), F.lit(shards))).groupBy("cell", "shard").applyInPandas(into(bounds), "cell long, shard long, packed binary")
    return pieces.groupBy("cell").applyInPandas(last, "cell long, packed binary")


def levels_of(words: DataFrame, least: int, shards: int) -> list[np.ndarray]:
    """The bounds of the shards' cells, a few for each core, and of the cells after each union of FAN pieces until FAN
    are left: of about CELL words of those shards that the next union brings together. Bounds part the ids into
    ranges of about equal numbers of words, frequent words counting a few times."""
    wide = math.ceil(math.sqrt(max(16, 2 * words.sparkSession.sparkContext.defaultParallelism)))
    by_lang = words.groupBy("lang").agg(F.sum("count").cast("double").alias("n"))
    total, squares = by_lang.agg(F.sum("n"), F.sum(F.col("n") * F.col("n"))).first()
    sides, together = [wide], FAN
    while together < shards:
        together *= FAN
        need = (total or 0) / CELL * min(1, together / shards)
        # words of two languages make no phrase, so only the cells of one language's words hold any
        sides.append(max(wide, math.ceil(min(need, math.sqrt(need * total * total / squares)))) if need else wide)
    weight = (F.floor(F.log2(F.col("count") / least)) + 1).cast("int")
    cuts = [F.percentile_approx("id", [k / side for k in range(1, side)], max(1000, 20 * side)).alias(str(side)) for side in sorted(set(sides))]
    found = words.select(F.explode(F.array_repeat("id", weight)).alias("id")).agg(*cuts).first()
    return [np.unique(np.array(found[str(side)] or [], np.int64)) for side in sides]


def phrases(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame, DataFrame, np.ndarray]:
    """(words: id, lang, word, count of the frequent ones; cells: cell, packed: all frequent phrases of one to
    five words; totals: lang, n; the bounds of the cells)."""
    spark = docs.sparkSession
    bounded_batches(spark, BATCH)
    shards = read_shards(docs)
    each = shards.select("shard", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("i", "w")).select("shard", "lang", "i", F.col("w.words").alias("word"), F.col("w.counts").alias("count"))
    totals = each.groupBy("lang").agg(F.sum("count").alias("n"))
    words = each.groupBy("lang", "word").agg(F.sum("count").alias("count")).where(F.col("count") >= least)
    words = checkpointed(words.orderBy("lang", "word").withColumn("id", F.monotonically_increasing_id()))
    # every word of a shard gets its answer; the frequent ones go back to the shard
    known = step(each.join(words.select("lang", "word", "id"), ["lang", "word"], "left"), rank=F.coalesce("id", F.lit(-1))).where("rank >= 0")
    held = checkpointed(known.groupBy("shard").agg(F.sort_array(F.collect_list(F.struct("id", "i"))).alias("m")).select("shard", F.col("m.id").alias("ids"), F.col("m.i").alias("at")))
    total = held.count()
    levels = levels_of(words, least, total)
    wide, bounds = levels[0], levels[-1]

    def recode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                tokens, at = _large(row.tokens), np.asarray(row.at, np.int64)
                rank = np.zeros(int(tokens.max(initial=0)) + 1, np.int32)
                rank[at + 1] = np.arange(1, len(at) + 1)
                ranks, alphabet = rank[tokens], np.asarray(row.ids, np.int64)
                pieces = list(_cut(*_bigrams(ranks, alphabet), wide))
                yield pd.DataFrame({"shard": [row.shard], "ranks": [_small(ranks)], "alphabet": [alphabet.tobytes()], "cells": [[c for c, _ in pieces]], "packed": [[p for _, p in pieces]]})

    path = shared_path(spark, "phrase-bigrams")
    shards.select("shard", "tokens").join(held, "shard").mapInPandas(recode, "shard long, ranks binary, alphabet binary, cells array<long>, packed array<binary>").write.option("compression", "zstd").parquet(path)
    coded = spark.read.parquet(path)
    pieces = coded.select("shard", F.explode(F.arrays_zip("cells", "packed")).alias("p")).select("shard", F.col("p.cells").alias("cell"), F.col("p.packed").alias("packed"))
    bigrams = checkpointed(unite(pieces, total, least, levels))

    def widened(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                for cell, packed in _cut(*Transducer.unpack(row.packed).paths(), wide):
                    yield pd.DataFrame({"cell": [cell], "shard": [row.cell], "packed": [packed]})

    def stayed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        data, kept = None, None
        for frame in frames:
            for row in frame.itertuples():
                if data != row.kept:
                    data, kept = row.kept, Transducer.unpack(row.kept)
                grams, _ = Transducer.unpack(row.packed).rows()
                grams = grams[kept.weigh(grams) > 0] if grams.shape[1] == 2 else grams[:0]
                if len(grams):
                    yield pd.DataFrame({"shard": [row.shard], "pairs": [grams.tobytes()]})

    again = bigrams if np.array_equal(bounds, wide) else checkpointed(unite(bigrams.mapInPandas(widened, "cell long, shard long, packed binary"), 1, least, [wide]))
    told = pieces.join(again.select("cell", F.col("packed").alias("kept")), "cell").mapInPandas(stayed, "shard long, pairs binary").groupBy("shard").agg(F.collect_list("pairs").alias("pairs"))

    def lengthen(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                pairs = np.frombuffer(b"".join(row.pairs), np.int64).reshape(-1, 2)
                for cell, packed in _cut(*_longer(_large(row.ranks), np.frombuffer(row.alphabet, np.int64), pairs), wide):
                    yield pd.DataFrame({"cell": [cell], "shard": [row.shard], "packed": [packed]})

    longer = unite(coded.select("shard", "ranks", "alphabet").join(told, "shard").mapInPandas(lengthen, "cell long, shard long, packed binary"), total, least, levels)

    def single(key, g):
        grams, counts = summed(g[["id"]].to_numpy("int64"), g["count"].to_numpy("int64"))
        return pd.DataFrame({"cell": [key[0] * (len(bounds) + 1)], "packed": [Transducer.build(grams, counts).pack()]})

    place = F.size(F.filter(F.lit(bounds.tolist()).cast("array<long>"), lambda b: b <= F.col("id"))).cast("long")
    ones = words.groupBy(place.alias("cell")).applyInPandas(single, "cell long, packed binary")
    every = ones.unionByName(bigrams).unionByName(longer)
    return words, checkpointed(unite(every.withColumn("shard", F.lit(0).cast("long")), 1, least, [bounds])), totals, bounds


def _parts(grams: np.ndarray) -> list[np.ndarray]:
    """First parts and rests of all cuts, from the cut after the first word on (rows of -1 where a phrase is too short)."""
    out = []
    for k in range(1, LONGEST):
        cut = (grams >= 0).sum(axis=1) > k
        first = np.where(np.arange(LONGEST) < k, grams, -1)
        rest = np.pad(grams[:, k:], ((0, 0), (0, k)), constant_values=-1)
        out += [np.where(cut[:, None], first, -1), np.where(cut[:, None], rest, -1)]
    return out


def _candidates(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Phrases of two and more words, LONGEST columns wide, and their counts."""
    grams, counts = Transducer.unpack(packed).paths()
    grams = np.pad(grams, ((0, 0), (0, LONGEST - grams.shape[1])), constant_values=-1)
    return grams[grams[:, 1] >= 0], counts[grams[:, 1] >= 0]


def compose(cells: DataFrame, bounds: np.ndarray) -> DataFrame:
    """ids, a, cuts (k, l, r of each cut), hides (the part without the last and without the first word, where
    it occurs nowhere else)."""
    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                grams = _candidates(row.packed)[0]
                for at in range(0, len(grams), CANDIDATES):
                    some = grams[at : at + CANDIDATES]
                    parts = np.concatenate(_parts(some))
                    held = np.flatnonzero(parts[:, 0] >= 0)
                    parts = parts[held]
                    slots = held // len(some) * len(grams) + at + held % len(some)
                    to = np.where(parts[:, 1] >= 0, _cells(parts, bounds), _cells(parts[:, :1], bounds))
                    order = np.argsort(to, kind="stable")
                    for mine in np.split(order, np.flatnonzero(np.diff(to[order])) + 1):
                        yield pd.DataFrame({"asks": [row.cell], "cell": [int(to[mine[0]])], "slots": [slots[mine].tobytes()], "parts": [parts[mine].tobytes()]})

    def answer(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        data, held = None, None
        for frame in frames:
            for row in frame.itertuples():
                if data != row.packed:
                    data, held = row.packed, Transducer.unpack(row.packed)
                weights = held.weigh(np.frombuffer(row.parts, np.int64).reshape(-1, LONGEST))
                yield pd.DataFrame({"cell": [row.asks], "slots": [row.slots], "weights": [weights.tobytes()]})

    def gather(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                grams, counts = _candidates(row.packed)
                found = np.zeros(len(grams) * 2 * (LONGEST - 1), np.int64)
                for slots, weights in zip(row.slots, row.weights):
                    found[np.frombuffer(slots, np.int64)] = np.frombuffer(weights, np.int64)
                found = found.reshape(LONGEST - 1, 2, len(grams))
                for at in range(0, len(grams), CANDIDATES):
                    ids, cuts, hides, some = [], [], [], counts[at : at + CANDIDATES]
                    for i, (gram, a) in enumerate(zip(grams[at : at + CANDIDATES].tolist(), some.tolist()), at):
                        words = [w for w in gram if w >= 0]
                        size = len(words)
                        ids.append(words)
                        cuts.append([{"k": k, "l": int(found[k - 1, 0, i]), "r": int(found[k - 1, 1, i])} for k in range(1, size)])
                        hides.append([p for p, f in ((words[:-1], found[size - 2, 0, i]), (words[1:], found[0, 1, i])) if size > 2 and a >= f])
                    yield pd.DataFrame({"ids": ids, "a": some, "cuts": cuts, "hides": hides})

    asked = cells.mapInPandas(ask, "asks long, cell long, slots binary, parts binary").join(cells, "cell")
    answers = asked.mapInPandas(answer, "cell long, slots binary, weights binary").groupBy("cell").agg(F.collect_list(F.struct("slots", "weights")).alias("x"))
    joined = cells.join(answers, "cell").select("packed", F.col("x.slots").alias("slots"), F.col("x.weights").alias("weights"))
    return joined.mapInPandas(gather, "ids array<long>, a long, cuts array<struct<k: int, l: long, r: long>>, hides array<array<long>>")


def mine(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's ``top`` phrases of two to five words.

    Null and empty texts have no words; a null lang is ``und``. Rows that repeat a text or a doc_id count as often as
    they occur. Ties go by count, then by the phrase's bytes. An empty table, or one without phrases of ``least``
    occurrences, gives no rows. Only ``text`` and ``lang`` are read; other columns are ignored. A
    text is cut by one task, at about thirty bytes of memory per byte.
    """
    with short_lived_shuffles(docs.sparkSession):
        words, cells, totals, bounds = phrases(docs, least)
        found = checkpointed(compose(cells, bounds))
    hidden = found.select(F.explode("hides").alias("ids")).distinct()
    kept = found.join(hidden, "ids", "left_anti")  # a phrase's ids name it: numbers of rows may differ where this is read twice
    spelled = kept.select("ids", F.posexplode("ids").alias("at", "id")).join(words.select("id", "lang", "word"), "id")
    spelled = spelled.groupBy("ids").agg(F.first("lang").alias("lang"), F.array_join(F.sort_array(F.collect_list(F.struct("at", "word"))).getField("word"), " ").alias("phrase"))
    scored = kept.join(spelled, "ids").join(totals, "lang").withColumn("best", F.expr(
        "array_min(transform(cuts, c -> struct(cast((cast(1000 as decimal(38, 0)) * a * n) div (cast(c.l as decimal(20, 0)) * c.r) as long) as score, c.k as k, c.l as l, c.r as r)))"))
    order = Window.partitionBy("lang").orderBy(F.desc("best.score"), F.desc("a"), "phrase")
    ranked = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "best.l", "best.r", "n", "best.score")
