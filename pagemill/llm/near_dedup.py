"""Near-duplicate documents by HyperMinHash registers, banding and exact confirmation.

A document is the set of its distinct word shingles, hashed to 64 bits. The top bits of a hash name
one of 256 buckets; a bucket's register keeps, of its smallest hash, the count of leading zeros
(6 bits) and the next 10 bits (mantissa). Empty buckets copy another bucket in a fixed order of
their own. 42 bands of 6 registers propose pairs of like size (similar sets can't differ more): a
pair of similarity 0.8 shares no band with probability 0.74 ** 42 = 3e-6. Before texts are read, the share of equal registers, less the
collisions that the sets' sizes make by chance, drops pairs that lie more than five standard errors
below the threshold; what is left is confirmed on the full sets.

Equal sets are one class and are never paired. Within a band's bucket, members are linked to one
centre, not to each other; only pairs that the found components leave apart are tried besides, so
every link that could join two components is confirmed or refuted. In large buckets those are many, so
there the full sets travel to the blocks of members and are compared in them: only links come out, not pairs.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, checkpointed, short_lived_shuffles, small_batches
from .components import components

BUCKETS, MANTISSA, BAND = 256, 10, 6
PERCENT = 80
#: Words kept with their hash in a worker; a full cache is emptied.
CACHE = 400_000
#: Members of a bucket that are held against each other at once.
BLOCK = 1024
#: Buckets of at least this many members in several components are compared by full sets.
LARGE = 256
#: Shingles of the sets that are compared at once, about (8 bytes each).
SET_BLOCK = 1 << 21
#: Sets of fewer shingles are always read: their registers repeat too few hashes for an estimate.
TINY = 8
#: Keys of texts up to this many are broadcast (24 bytes each); more are joined by shuffle.
BROADCAST_KEYS = 500_000
SIGNATURES = "uid long, doc_id long, text_key binary, n_shingles long, set_key binary, registers binary"


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_hashes = _Hashes()


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every bit depends on all bits (the murmur3 finaliser)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingles(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles of k words; of all words if fewer."""
    words = (text or "").encode().lower().split()  # of bytes: A-Z only, and blanks \\x20 \\x09-\\x0D only
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    k = min(k, len(words))
    with np.errstate(over="ignore"):
        total = np.full(len(words) - k + 1, k, np.uint64)
        for j in range(k):
            total = total * np.uint64(0x9E3779B97F4A7C15) + h[j : j + len(total)]
            total = total ^ (total >> np.uint64(29))
        return np.unique(mixed(total))


def _orders() -> np.ndarray:
    """For each bucket, the order in which it looks at the others when it is empty."""
    rng = np.random.default_rng(0)
    return np.array([rng.permutation(BUCKETS) for _ in range(BUCKETS)])


ORDERS = _orders()
EDGES = np.arange(BUCKETS, dtype=np.uint64) << np.uint64(56)


def registers(hashes: np.ndarray) -> np.ndarray:
    """The 256 registers (leading zeros << 10 | mantissa) of a set that isn't empty."""
    at = np.searchsorted(hashes, EDGES)
    first = hashes[np.minimum(at, len(hashes) - 1)]
    full = (at < len(hashes)) & ((first >> np.uint64(56)) == np.arange(BUCKETS, dtype=np.uint64))
    value = first << np.uint64(8)
    zeros = np.where(value == 0, 56, 64 - np.frexp(value.astype(np.float64))[1]).clip(0, 56).astype(np.uint64)
    mantissa = (value << (zeros + np.uint64(1))) >> np.uint64(64 - MANTISSA)
    out = ((zeros << np.uint64(MANTISSA)) | mantissa).astype("<u2")
    empty = np.flatnonzero(~full)
    for step in range(BUCKETS):
        if not len(empty):
            break
        other = ORDERS[empty, step]
        found = full[other]
        out[empty[found]] = out[other[found]]
        empty = empty[~found]
    return out


def chance(n1: float, n2: float) -> float:
    """Probability that a register of unrelated sets of n1 and n2 shingles is equal."""
    edges = 2.0 ** -np.arange(0, 57)
    share = lambda n: (1 - edges[1:]) ** (n / BUCKETS) - (1 - edges[:-1]) ** (n / BUCKETS)
    return float((share(n1) * share(n2)).sum() / 2**MANTISSA)


def estimate(r1: np.ndarray, r2: np.ndarray, n1: int, n2: int) -> float:
    """Similarity by the share of equal registers, corrected for chance collisions."""
    by_chance = BUCKETS * chance(n1, n2)
    return max(0.0, (int((r1 == r2).sum()) - by_chance) / (BUCKETS - by_chance))


def least_estimate(percent: int) -> float:
    """The estimate below which a pair isn't read: five standard errors under the threshold."""
    share = percent / 100
    return share - 5 * (share * (1 - share) / BUCKETS) ** 0.5


def signatures(docs: DataFrame, k: int) -> DataFrame:
    small_batches(docs.sparkSession)

    def sign(batches):
        for batch in batches:
            sets = [shingles(t, k) for t in batch["text"].tolist()]
            yield pd.DataFrame({
                "uid": batch["uid"], "doc_id": batch["doc_id"].astype("Int64"), "text_key": batch["text_key"], "n_shingles": [len(s) for s in sets],
                "set_key": [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets],
                "registers": [registers(s).tobytes() if len(s) else b"" for s in sets],
            })

    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_key"), "text")
    return rows.mapInPandas(sign, SIGNATURES)


def text_key():
    return F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))


def confirm(pairs: DataFrame, classes: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """a, b, linked of each pair of class ids: by estimate where that is far below, else on the full sets."""
    spark = docs.sparkSession
    small_batches(spark)
    floor = least_estimate(percent)

    def near(batches):
        for batch in batches:
            keep = []
            for r1, r2, n1, n2 in zip(batch["ra"], batch["rb"], batch["na"], batch["nb"]):
                small, large = min(n1, n2), max(n1, n2)
                keep.append(100 * small >= percent * large and (small < TINY or estimate(np.frombuffer(r1, "<u2"), np.frombuffer(r2, "<u2"), n1, n2) >= floor))
            yield batch.loc[keep, ["a", "b", "ka", "kb"]]

    side = lambda c: classes.select(F.col("id").alias(c), F.col("text_key").alias(f"k{c}"), F.col("registers").alias(f"r{c}"), F.col("n").alias(f"n{c}"))
    likely = checkpointed(pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").mapInPandas(near, "a long, b long, ka binary, kb binary"))
    keys = likely.select(F.col("ka").alias("text_key")).union(likely.select("kb")).distinct()
    keys = checkpointed(keys)
    texts = docs.select(text_key().alias("text_key"), "text")
    texts = texts.join(F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys, "text_key", "left_semi")
    texts = texts.groupBy("text_key").agg(F.first("text").alias("text"))

    def sure(batches):
        last, held = None, None
        for batch in batches:
            linked = []
            for key, one, two in zip(batch["kb"], batch["tb"], batch["ta"]):
                if key != last:
                    last, held = key, shingles(one, k)
                other = shingles(two, k)
                both = len(np.intersect1d(held, other, assume_unique=True))
                linked.append(100 * both >= percent * (len(held) + len(other) - both))
            yield batch[["a", "b"]].assign(linked=linked)

    with_texts = likely.join(texts.select(F.col("text_key").alias("ka"), F.col("text").alias("ta")), "ka").join(texts.select(F.col("text_key").alias("kb"), F.col("text").alias("tb")), "kb")
    return checkpointed(with_texts.select("a", "b", "kb", "ta", "tb").mapInPandas(sure, "a long, b long, linked boolean"))


BANDS = BUCKETS // BAND


def sketch(registers_: bytes) -> bytes:
    """The low 4 bits of each mantissa, two a byte, and a 16-bit hash of each band."""
    low = (np.frombuffer(registers_, "<u2") & 15).astype(np.uint8).reshape(-1, 2)
    size = 2 * BAND
    return (low[:, 0] | low[:, 1] << 4).tobytes() + b"".join(xxhash.xxh32_digest(registers_[i * size : (i + 1) * size])[:2] for i in range(BANDS))


def unpacked(sketches: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """4 bits of each register (n, 256) and the hash of each band (n, 42)."""
    flat = np.frombuffer(b"".join(sketches), np.uint8).reshape(len(sketches), BUCKETS // 2 + 2 * BANDS)
    low = flat[:, : BUCKETS // 2]
    return np.stack([low & 15, low >> 4], axis=2).reshape(len(sketches), BUCKETS), np.ascontiguousarray(flat[:, BUCKETS // 2 :]).view("<u2")


def full_sets(ids: DataFrame, classes: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """id, hashes (8 bytes each, in order) of the classes with these ids."""
    def hashed(batches):
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "hashes": [shingles(t, k).tobytes() for t in batch["text"]]})

    keys = checkpointed(classes.join(ids, "id", "left_semi").select("id", "text_key"))
    texts = docs.select(text_key().alias("text_key"), "text")
    texts = texts.join(F.broadcast(keys.select("text_key")) if keys.count() <= BROADCAST_KEYS else keys.select("text_key"), "text_key", "left_semi")
    texts = texts.groupBy("text_key").agg(F.first("text").alias("text"))
    return checkpointed(keys.join(texts, "text_key").select("id", "text").mapInPandas(hashed, "id long, hashes binary"))


class Sets:
    """Sets of hashes, one behind the other."""

    def __init__(self, sets: list[bytes]):
        self.sizes = np.array([len(x) // 8 for x in sets])
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.values, self.codes = np.unique(np.frombuffer(b"".join(sets), np.uint64), return_inverse=True)

    def linked(self, other: bytes, percent: int) -> np.ndarray:
        """Whether each set is linked with another."""
        theirs = np.frombuffer(other, np.uint64)
        at = np.minimum(np.searchsorted(self.values, theirs), len(self.values) - 1)
        held = np.zeros(len(self.values), np.int64)
        held[at[self.values[at] == theirs]] = 1
        both = np.add.reduceat(held[self.codes], self.starts)
        return 100 * both >= percent * (self.sizes + len(theirs) - both)


def apart_pairs(members: DataFrame, classes: DataFrame, roots: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """a, b, sure: pairs that share a band but no component, likely ones and links (sure).

    Of a bucket whose members lie in several components, the members outside the most frequent one
    are held against all members, in blocks of at most BLOCK by BLOCK, by 4 bits of each register.
    Pairs well below the threshold are not returned, others at the first band they share. In buckets of
    LARGE members and more the full sets are compared, and of an outer member's links one with each
    component is returned.
    """
    bounded_batches(members.sparkSession)
    placed = checkpointed(labelled(members.select("band", "at", "id"), "id", roots, "root"))
    several = (
        placed.groupBy("band", "root").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("some")).groupBy("band")
        .agg(F.count(F.lit(1)).alias("roots"), F.sum("n").alias("all"), F.max(F.struct("n", "root")).alias("main"), F.min("some").alias("some")).where("roots > 1")
        .withColumn("out", F.col("all") - F.col("main.n")).withColumn("large", F.col("all") >= LARGE)
    )
    # sizes of a bucket's sets lie in two adjacent cells, so one member's bounds the others'
    one = classes.select(F.col("id").alias("some"), (F.col("n") * (100.01 / percent) ** 2 / SET_BLOCK).alias("load"))
    blocks = lambda n: F.ceil(F.greatest(F.col(n) / BLOCK, F.when(F.col("large"), F.col(n) * F.col("load")).otherwise(0.0)))
    several = checkpointed(several.join(one, "some").select("band", F.col("main.root").alias("main"), "large", blocks("all").alias("nx"), blocks("out").alias("ny")))
    inside = placed.join(several, "band")
    make = F.pandas_udf(lambda r: pd.Series([sketch(x) for x in r]), "binary")
    ids = inside.select("id").distinct()
    sketches = checkpointed(classes.join(ids, "id", "left_semi").select("id", "n", make("registers").alias("sketch")))
    hashes = F.lit(None).cast("binary")
    if not several.where("large").isEmpty():
        sketches = sketches.join(full_sets(inside.where("large").select("id").distinct(), classes, docs, k), "id", "left")
        hashes = F.when(F.col("large"), F.col("hashes"))
    inside = inside.join(sketches, "id").withColumn("hashes", hashes)
    deal = lambda n: F.pmod(F.xxhash64("id", "band"), n)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    one = inside.withColumn("x", deal(F.col("nx"))).withColumn("y", every("ny")).withColumn("outer", F.lit(False))
    two = inside.where("root != main").withColumn("y", deal(F.col("ny"))).withColumn("x", every("nx")).withColumn("outer", F.lit(True))
    both = one.unionByName(two).repartition("band", "x", "y").sortWithinPartitions("band", "x", "y")
    floor, chance_ = least_estimate(percent), 1 / 16

    def compare(held: pd.DataFrame) -> pd.DataFrame | None:
        outer = held["outer"].to_numpy()
        if not outer.any() or outer.all():
            return None
        xs, ys = held[~outer], held[outer]
        (x, xband), (y, yband) = unpacked(xs["sketch"].tolist()), unpacked(ys["sketch"].tolist())
        at, main = int(held["at"].iloc[0]), int(held["main"].iloc[0])
        xid, xroot, xn = (xs[c].to_numpy() for c in ("id", "root", "n"))
        a, b = [], []
        sure = bool(held["large"].iloc[0])
        sets = Sets(xs["hashes"].tolist()) if sure else None
        for row, row_bands, yid, yroot, yn, ysets in zip(y, yband, ys["id"], ys["root"], ys["n"], ys["hashes"]):
            maybe = np.flatnonzero((xroot != yroot) & ((xroot == main) | (xid < yid)) & (100 * np.minimum(xn, yn) >= percent * np.maximum(xn, yn)))
            if not len(maybe):
                continue
            if sure:
                maybe = maybe[sets.linked(ysets, percent)[maybe]]
                maybe = maybe[np.unique(xroot[maybe], return_index=True)[1]]
                a += [yid] * len(maybe)
                b += xid[maybe].tolist()
                continue
            same = x[maybe] == row
            near = ((same.mean(axis=1) - chance_) / (1 - chance_) >= floor) | (np.minimum(xn[maybe], yn) < TINY)
            shared = (xband[maybe, :at] == row_bands[:at]) & same[:, : at * BAND].reshape(len(maybe), at, BAND).all(axis=2)
            near &= ~shared.any(axis=1)  # else an earlier band's bucket returns it
            a += [yid] * int(near.sum())
            b += xid[maybe[near]].tolist()
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b), "sure": sure}) if a else None

    def groups(batches):
        rest = None
        for batch in batches:
            rest = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            keys = rest[["band", "x", "y"]].to_numpy()
            ends = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            if not len(ends):
                continue
            for lo, hi in zip([0, *ends[:-1]], ends):
                if hi - lo > 1 and (out := compare(rest.iloc[lo:hi])) is not None:
                    yield out
            rest = rest.iloc[ends[-1] :]
        if rest is not None and len(rest) > 1 and (out := compare(rest)) is not None:
            yield out

    return both.select("band", "x", "y", "outer", "at", "main", "id", "root", "n", "sketch", "large", "hashes").mapInPandas(groups, "a long, b long, sure boolean").distinct()


def labelled(rows: DataFrame, node: str, roots: DataFrame, label: str) -> DataFrame:
    """Adds the component of the id in column ``node`` (its own id where it has no link)."""
    return rows.join(roots.select(F.col("node").alias(node), F.col("root").alias("_root")), node, "left").withColumn(label, F.coalesce("_root", node)).drop("_root")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id reachable by links), kept.

    Needs doc_id and text, ignores other columns. Null, empty and blank texts have no shingles and no
    links; texts of fewer than k words are one shingle; rows that repeat a text are linked; null
    doc_ids rank after all others, and a component without any other has a null component_id; kept
    is doc_id = component_id (null-safe). An empty table gives no rows.
    """
    with short_lived_shuffles(docs.sparkSession):
        signs = checkpointed(signatures(docs, k))
        of_set = checkpointed(set_components(signs, docs, k, percent))
    out = attach(signs.select("uid", "doc_id", "n_shingles", "set_key"), of_set)
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def set_components(signs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """set_key, component_id, known (true) of every set that isn't empty."""
    classes = checkpointed(
        signs.where("n_shingles > 0").groupBy("set_key")
        .agg(F.min(F.struct("uid", "text_key", "registers", F.col("n_shingles").alias("n"))).alias("one"), F.min("doc_id").alias("low"))
        .select(F.col("one.uid").alias("id"), "one.text_key", "one.registers", "one.n", "low", "set_key")
    )
    # Sets of similarity s differ in size by a factor 1 / s at most: their size cells are equal or adjacent.
    cell = F.floor(F.log(F.col("n").cast("double")) / F.lit(math.log(100.01 / percent)))
    band = lambda i, c: F.xxhash64(i, c, F.substring(F.col("registers"), i * 2 * BAND + 1, F.lit(2 * BAND)))
    bands = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.array(band(i, cell), band(i, cell + 1))))
    keyed = classes.select("id", F.posexplode(bands).alias("at", "band")).withColumn("at", F.floor(F.col("at") / 2).cast("int"))
    centres = keyed.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(F.xxhash64("id", "band"), "id"))["id"].alias("centre")).where("n > 1").drop("n")
    members = checkpointed(keyed.join(centres, "band"))
    stars = checkpointed(members.where("id != centre").groupBy(F.least("id", "centre").alias("a"), F.greatest("id", "centre").alias("b")).agg(F.count(F.lit(1)).alias("shared")))

    # First the best pair of each class, then the star pairs that still lie apart.
    best = stars.select(F.explode(F.array("a", "b")).alias("id"), "a", "b", "shared").groupBy("id").agg(F.max(F.struct("shared", "a", "b")).alias("best")).select("best.a", "best.b").distinct()
    tried = confirm(best, classes, docs, k, percent)
    roots = components(tried.where("linked"))
    apart = labelled(labelled(stars.join(best, ["a", "b"], "left_anti"), "a", roots, "ca"), "b", roots, "cb").where("ca != cb")
    more = confirm(checkpointed(apart.select("a", "b")), classes, docs, k, percent)
    links = tried.unionByName(more).where("linked").select("a", "b")
    roots = components(links)

    # Then every pair of a bucket that the components leave apart and no star has tried.
    cross = checkpointed(apart_pairs(members, classes, roots, docs, k, percent).join(stars.select("a", "b"), ["a", "b"], "left_anti"))
    last = confirm(cross.where("NOT sure").select("a", "b"), classes, docs, k, percent)
    roots = components(links.unionByName(last.where("linked").select("a", "b")).unionByName(cross.where("sure").select("a", "b")))

    found = labelled(classes.select("id", "low", "set_key"), "id", roots, "root")
    lows = found.groupBy("root").agg(F.min("low").alias("component_id"))
    return found.join(lows, "root").select("set_key", "component_id", F.lit(True).alias("known"))


def attach(rows: DataFrame, of_set: DataFrame, share: int = 1000) -> DataFrame:
    """Adds component_id by set_key. Sets of more than a ``share``-th of the rows are joined by broadcast."""
    counts = rows.where("n_shingles > 0").groupBy("set_key").agg(F.count(F.lit(1)).alias("n"))
    total = rows.count()
    hot = counts.where(F.col("n") * share > total).join(of_set, "set_key").select("set_key", F.col("component_id").alias("hot_id"), F.col("known").alias("hot"))
    marked = rows.join(F.broadcast(hot), "set_key", "left")
    # A hot row's key, and an empty text's, is a hash of its place: it spreads and finds nothing.
    own = F.unhex(F.md5(F.col("uid").cast("string").cast("binary")))
    marked = marked.withColumn("key", F.when((F.col("n_shingles") > 0) & F.col("hot").isNull(), F.col("set_key")).otherwise(own))
    joined = marked.join(of_set.select(F.col("set_key").alias("key"), F.col("component_id").alias("cold_id"), F.col("known").alias("cold")), "key", "left")
    return joined.withColumn("component_id", F.when(F.col("hot"), F.col("hot_id")).when(F.col("cold"), F.col("cold_id")).otherwise(F.col("doc_id")))


def keep_one_of_each(docs: DataFrame, k: int = 5, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that stay when one document of each component does, with all columns."""
    kept = near_duplicates(docs, k, percent).where("kept").select(F.col("doc_id").alias("_id")).distinct()
    whole = docs.select(F.struct("*").alias("_row"), F.col("doc_id").cast("long").alias("_doc"))
    return whole.join(kept, F.col("_doc").eqNullSafe(F.col("_id")), "left_semi").select("_row.*")
