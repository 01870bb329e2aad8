"""Passages of a benchmark found in documents, by a distributed positional inverted index.

The index has a segment for every two megabytes of documents: the segment's terms, and for each term
the ascending list of its positions in the segment (every token is a posting; a term's postings lie
spread over the segments, so no term makes a large group). It is written once to the shared folder
and answers any number of benchmarks.

A query is a window: ``n`` consecutive words of an item (all words of a shorter one). In each segment,
windows with an absent term are ruled out; for the others the list of the term that is rarest there,
shifted back by its offset in the window, gives the candidate starts, and the lists of the other terms,
from the next rarest on, are intersected with them at their own offsets. With ``slop`` s a term may
stand up to s places from its own (proximity matches); 0 gives exact phrases.

Windows are answered in rounds of at most ``ROUND`` windows, which every segment reads; more windows
take more rounds over the index, so a benchmark of any size is answered whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, checkpointed, shared_path
from .wordarrays import byte_classes, column, segments, split

N = 10
#: Windows that go to all segments at once (about 100 bytes each), and words of a piece of an item.
ROUND, PIECE = 1 << 17, 1 << 12
#: Candidates of a segment that are held at once (unless one window has more: at most a segment's words).
CANDIDATES = 1 << 21
#: Bytes of text of a segment, and of an Arrow batch and a row group of the index (a larger segment has one of its own).
SEGMENT, ROW_GROUP = 2 << 20, 4 << 20
LETTERS = byte_classes(word="0123456789abcdefghijklmnopqrstuvwxyz")
INDEX = "uids array<long>, doc_ids array<long>, n_words array<long>, terms binary, term_ends binary, ends binary, positions binary"
SCHEMA = pa.schema([(c.split()[0], pa.binary() if c.endswith("binary") else pa.list_(pa.int64())) for c in INDEX.split(", ")])


def _segment(table: pa.Table) -> dict:
    """A segment: the texts' uids and first positions, its terms and each term's ascending positions."""
    found = split(column(table, "text"), LETTERS)
    coded = found.words.dictionary_encode()
    ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int32)
    n_words = np.bincount(found.text, minlength=found.texts).astype(np.int64)
    position = np.arange(len(ids), dtype=np.int32)
    terms = coded.dictionary
    ends = np.frombuffer(terms.buffers()[1], np.int64)[terms.offset : terms.offset + len(terms) + 1]
    return {
        "uids": column(table, "uid").to_pylist(), "doc_ids": column(table, "doc_id").to_pylist(), "n_words": n_words.tolist(),
        "terms": terms.buffers()[2].to_pybytes()[ends[0] : ends[-1]] if len(terms) else b"", "term_ends": (ends - ends[0]).tobytes(),
        "ends": np.concatenate([[0], np.cumsum(np.bincount(ids, minlength=len(terms)))]).astype(np.int64).tobytes(),
        "positions": position[np.argsort(ids, kind="stable")].tobytes(),
    }


def build_index(docs: DataFrame) -> DataFrame:
    """The index of the documents, written to the shared folder; they are read once."""
    spark = docs.sparkSession
    bounded_batches(spark, ROW_GROUP)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in segments(batches, "text", SEGMENT):
            yield pa.RecordBatch.from_pylist([_segment(table)], SCHEMA)

    path = shared_path(spark, "positional-index")
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    written = rows.mapInArrow(index, INDEX).write.option("compression", "zstd")
    # readers decode a row group at once: a segment or two each
    for name, value in (("parquet.block.size", ROW_GROUP), ("parquet.page.size.row.check.min", 1), ("parquet.page.size.row.check.max", 1)):
        written = written.option(name, str(value))
    written.parquet(path)
    return spark.read.parquet(path)


class _Queries:
    """The distinct windows of one round: term codes (W, n), -1 behind the end of short ones, and the items
    that hold them (those of window w at ``items[ends[w]:ends[w + 1]]``)."""

    def __init__(self, rows: pd.DataFrame, n: int):
        terms, held = {}, {}
        for item, words, short in zip(rows["item"], rows["words"], rows["short"]):
            code = [terms.setdefault(w.encode(), len(terms)) for w in words]
            for at in range(1 if short else len(code) - n + 1):
                window = code[at : at + n]
                held.setdefault((*window, *[-1] * (n - len(window))), set()).add(item)
        self.terms = pa.array(list(terms), pa.large_binary())
        self.codes = np.array(list(held), np.int64).reshape(-1, n)
        self.ends = np.cumsum([0, *map(len, held.values())])
        self.items = np.array([i for items in held.values() for i in items], np.int64)

    def expand(self, window: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``window``, item) for every item of every window given."""
        count = self.ends[window + 1] - self.ends[window]
        place = np.repeat(np.arange(len(window)), count)
        return place, self.items[np.repeat(self.ends[window], count) + np.arange(len(place)) - np.repeat(np.cumsum(count) - count, count)]


def _lists(row) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    ends = np.frombuffer(row.term_ends, np.int64)
    terms = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(row.terms)])
    return terms, np.frombuffer(row.ends, np.int64), np.frombuffer(row.positions, np.int32)


def intersect(row, queries: _Queries, slop: int = 0) -> Iterator[tuple[np.ndarray, ...]]:
    """Every match in the segment: its window, its text's number, its first and last word in that text
    (of a proximity match: the words that its terms may stand at). Candidates are taken in portions."""
    terms, ends, positions = _lists(row)
    n_words = np.asarray(row.n_words, np.int64)
    begins = np.cumsum(n_words) - n_words
    if not len(terms) or not len(queries.codes):
        return
    place = pc.fill_null(pc.index_in(queries.terms, value_set=terms), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    local = np.where(queries.codes >= 0, place[queries.codes], -2)  # -1: absent here, -2: behind the end
    live = np.flatnonzero((local != -1).all(axis=1))
    local = local[live]
    sizes = np.where(local >= 0, ends[np.maximum(local, 0) + 1] - ends[np.maximum(local, 0)], np.iinfo(np.int64).max)
    order = np.argsort(sizes, axis=1, kind="stable")  # from the rarest term on
    count = sizes.min(axis=1, initial=np.iinfo(np.int64).max)
    # one ascending key over all lists: the term's number, then the position
    span = len(positions) + 1
    keys = np.repeat(np.arange(len(terms), dtype=np.int64), np.diff(ends)) * span + positions
    length = (local >= 0).sum(axis=1)
    portion = np.cumsum(count) // CANDIDATES
    for which in np.split(np.arange(len(local)), np.flatnonzero(np.diff(portion)) + 1):
        rarest = order[which, 0]
        window = np.repeat(which, count[which])
        step = np.arange(len(window)) - np.repeat(np.cumsum(count[which]) - count[which], count[which])
        seen = positions[np.repeat(ends[local[which, rarest]], count[which]) + step].astype(np.int64)
        text = np.searchsorted(begins, seen, side="right") - 1  # empty texts begin where the next one does
        start = seen - order[window, 0]
        for j in range(1, local.shape[1]):
            offset = order[window, j]
            term = local[window, offset]
            low = np.maximum(start + offset - slop, begins[text])
            high = np.minimum(start + offset + slop, begins[text] + n_words[text] - 1)
            at = np.minimum(np.searchsorted(keys, term * span + low), len(keys) - 1)
            hit = (term == -2) | ((low <= high) & (keys[at] >= term * span + low) & (keys[at] <= term * span + high))
            window, start, text = window[hit], start[hit], text[hit]
        first = np.maximum(start - slop - begins[text], 0)
        yield live[window], text, first, np.minimum(start + length[window] - 1 + slop - begins[text], n_words[text] - 1)


def search(index: DataFrame, items: DataFrame, n: int = N, slop: int = 0) -> DataFrame:
    """uid, item, first, last: the places (word numbers in the document) that an item's windows match, joined
    where they overlap or touch. ``items`` has ``item`` (long) and ``words`` (array of strings)."""
    pieces = checkpointed(_pieces(items, n))
    total = pieces.agg(F.sum("windows")).first()[0] or 0
    rounds = -(-total // ROUND) * 2 if total > ROUND else 1  # dealt by hash: half full on average
    out = None
    for k in range(rounds):
        some = pieces.where(F.pmod(F.xxhash64("item", "piece"), F.lit(rounds)) == k) if rounds > 1 else pieces
        queries = _Queries(some.select("item", "words", "short").toPandas(), n)

        def match(frames: Iterator[pd.DataFrame], queries=queries) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for row in frame.itertuples():
                    uids = np.asarray(row.uids, np.int64)
                    for window, text, first, last in intersect(row, queries, slop):
                        place, item = queries.expand(window)
                        yield _joined(uids[text[place]], item, first[place], last[place])

        hits = index.mapInPandas(match, "uid long, item long, first long, last long")
        out = hits if out is None else out.unionByName(hits)
    return out


def _joined(uid, item, first, last) -> pd.DataFrame:
    """Spans of one document and item that overlap or touch become one."""
    order = np.lexsort((first, item, uid))
    uid, item, first, last = uid[order], item[order], first[order], last[order]
    if not len(uid):
        return pd.DataFrame({"uid": uid, "item": item, "first": first, "last": last})
    group = np.cumsum(np.concatenate([[True], (uid[1:] != uid[:-1]) | (item[1:] != item[:-1])]))
    wide = last.max() + 2
    reach = np.maximum.accumulate(group * wide + last)  # the furthest end so far, in each group
    fresh = np.concatenate([[True], (group[1:] != group[:-1]) | (first[1:] + group[1:] * wide > reach[:-1] + 1)])
    at = np.flatnonzero(fresh)
    return pd.DataFrame({"uid": uid[at], "item": item[at], "first": first[at], "last": reach[np.append(at[1:], len(uid)) - 1] - group[at] * wide})


def _pieces(items: DataFrame, n: int) -> DataFrame:
    """Items in pieces of at most PIECE windows; neighbouring pieces share n - 1 words."""
    words = F.col("words")
    windows = F.greatest(F.size(words) - n + 1, F.lit(1))
    return (
        items.where(F.size(words) > 0)
        .select("item", "words", F.explode(F.sequence(F.lit(0), ((windows - 1) / PIECE).cast("int"))).alias("piece"))
        .select("item", "piece", F.slice("words", F.col("piece") * PIECE + 1, F.lit(PIECE + n - 1)).alias("words"), (F.size("words") < n).alias("short"))
        .withColumn("windows", F.when(F.col("short"), 1).otherwise(F.size("words") - n + 1))
    )


def item_words(benchmark: DataFrame) -> DataFrame:
    """The benchmark's rows with a number of their own and their words."""
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return checkpointed(benchmark.select(
        F.monotonically_increasing_id().alias("item"), F.col("item_id").cast("string").alias("item_id"),
        F.coalesce(F.regexp_extract_all(lower, F.lit("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"), 0), F.array().cast("array<string>")).alias("words")))


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = N, slop: int = 0) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items.

    A word is hit if it lies inside a match of some window. Null and empty texts have no words and no
    hits, and an item without words (null, empty) matches nothing. Rows that repeat a doc_id are documents of their
    own, a null doc_id stays null; rows that repeat an item_id are one item in ``items`` (sorted as
    strings), and matches of items without an item_id count as hits but not as items. An empty
    benchmark hits nothing, no documents give no rows; further columns are ignored. A text is indexed
    whole by one task, at about thirty bytes of memory per byte.
    """
    index = build_index(docs)
    items = item_words(benchmark)
    hits = checkpointed(search(index, items, n, slop))
    before = Window.partitionBy("uid").orderBy("first", "last").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.greatest(F.lit(0), F.col("last") - F.greatest(F.col("first") - 1, F.coalesce(F.max("last").over(before), F.lit(-1))))
    words = hits.select("uid", "first", "last").withColumn("fresh", fresh).groupBy("uid").agg(F.sum("fresh").alias("n_hit"))
    named = hits.select("uid", "item").distinct().join(items.select("item", "item_id"), "item").groupBy("uid").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    every = index.select(F.explode(F.arrays_zip("uids", "doc_ids", "n_words")).alias("d")).select(F.col("d.uids").alias("uid"), F.col("d.doc_ids").alias("doc_id"), F.col("d.n_words").alias("n_words"))
    n_hit, names = F.coalesce("n_hit", F.lit(0)).cast("long"), F.coalesce("items", F.array().cast("array<string>"))
    return every.join(words, "uid", "left").join(named, "uid", "left").select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size(names).cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), names.alias("items"))
