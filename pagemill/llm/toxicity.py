"""Toxic spans by a linear-chain conditional random field.

Documents are labelled, tokens are not: a token of a toxic training document counts as toxic if its
word, or a beginning of it, is found in toxic documents and all but never in others. On windows
around such tokens, and windows of clean documents, a chain with two states is fitted: a token's
emission is the sum of the weights of its word, its beginnings and its ending; transitions are free.
Forward-backward marginals give each token's probability; a document's score is a logistic function
of the largest marginal, their sum and the length, and tokens above one half are its toxic spans.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, small_batches
from .sampling import per_class

#: Bounds of the training sample: documents of each label, bytes of one of them.
PER_LABEL, SAMPLE_BYTES = 1500, 20_000
SLOTS = 1 << 16
CONTEXT, LENGTH, STEPS, RATE = 12, 25, 60, 0.3
#: Words kept with their emission in a worker; a full cache is emptied.
CACHE = 400_000
CHUNK = 256
TOKEN = re.compile(r"[^\W\d_]+")


def features(word: str) -> list[str]:
    return [f"w:{word}", *(f"p:{word[:n]}" for n in (4, 5, 6) if len(word) > n), f"s:{word[-3:]}"]


def slots(word: str) -> list[int]:
    return [zlib.crc32(f.encode()) % SLOTS for f in features(word)]


def telling(texts: list[list[str]], toxic: list[int]) -> set[str]:
    """Features (words and beginnings) that toxic documents have and others all but never."""
    seen = {0: Counter(), 1: Counter()}
    for words, y in zip(texts, toxic):
        seen[y].update({f for w in set(words) for f in features(w) if f[0] != "s"})
    n = [max(1, toxic.count(0)), max(1, toxic.count(1))]
    # so many toxic documents that chance would pick them alone for one feature in ten million
    least = max(3.0, np.log(1e-7) / np.log(n[1] / (n[0] + n[1])))
    return {f for f, c in seen[1].items() if c >= least and c / n[1] >= 30 * (seen[0][f] + 0.2) / n[0]}


def marginals(emission: np.ndarray, starts: np.ndarray, chain: np.ndarray) -> np.ndarray:
    """P(toxic) of each token of texts laid end to end; ``starts`` marks first tokens.

    Chunks of 256 tokens run side by side: each multiplies its transfer matrices up to every token,
    then the messages that enter the chunks are carried from chunk to chunk. At a text's first token
    both rows of the matrix are the start weights, which cuts the chain.
    """
    n = len(emission)
    if n == 0:
        return np.zeros(0)
    c = -(-n // CHUNK)
    e = np.ones((c, CHUNK))
    e.reshape(-1)[:n] = np.exp(np.clip(emission, -30, 30))
    cut = np.ones((c, CHUNK), bool)
    cut.reshape(-1)[:n] = starts
    a, start = chain[:2], chain[2]
    m = np.empty((CHUNK, 2, 2, c))
    for i in (0, 1):
        for j in (0, 1):
            m[:, i, j] = np.where(cut, start[j], a[i, j]).T * (e.T if j else 1.0)

    def carried(step, order, rows):
        out, now = np.empty((CHUNK, 2, 2, c)), None
        for t in order:
            now = step(now, t)
            now = now / now.sum(axis=(0, 1))
            out[t] = now
        return out

    product = lambda x, y: np.stack([np.stack([x[i, 0] * y[0, j] + x[i, 1] * y[1, j] for j in (0, 1)]) for i in (0, 1)])
    ahead = carried(lambda now, t: m[t] if now is None else product(now, m[t]), range(CHUNK), 0)
    enter, v = np.empty((c, 2)), np.array([0.5, 0.5])
    for k in range(c):
        enter[k] = v
        v = v @ ahead[CHUNK - 1, :, :, k]
        v = v / v.sum()
    alpha = np.einsum("ki,tijk->tjk", enter, ahead)
    # behind[t]: the product of the matrices after t within the chunk
    behind = carried(lambda now, t: np.repeat(np.eye(2)[:, :, None], c, axis=2) if now is None else product(m[t + 1], now), range(CHUNK - 1, -1, -1), 0)
    whole = product(m[0], behind[0])
    leave, v = np.empty((c, 2)), np.array([0.5, 0.5])
    for k in range(c - 1, -1, -1):
        leave[k] = v
        v = whole[:, :, k] @ v
        v = v / v.sum()
    beta = np.einsum("tijk,kj->tik", behind, leave)
    joint = alpha * beta
    return (joint[:, 1] / joint.sum(axis=1)).T.reshape(-1)[:n]


def train_chain(x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(feature weights, chain) from windows: x (n, T, slots; -1 pads), mask and labels y (n, T)."""
    n, length, _ = x.shape
    w = np.zeros(SLOTS + 1)
    a, start = np.zeros((2, 2)), np.array([0.0, -3.0])
    gw, ga, gs = np.full(SLOTS + 1, 1e-8), np.full((2, 2), 1e-8), np.full(2, 1e-8)
    yy = y.astype(int)
    for _ in range(STEPS):
        w[SLOTS] = 0.0
        e = w[x].sum(axis=2)  # -1 is the last slot, which stays 0
        em = np.stack([np.zeros_like(e), e], axis=2)
        ta, ts = np.exp(a), np.exp(start)
        em = np.exp(np.clip(em, -30, 30))
        alpha, beta = np.empty((length, n, 2)), np.ones((length, n, 2))
        for t in range(length):
            now = (ts if t == 0 else alpha[t - 1] @ ta) * em[:, t]
            now = np.where(mask[:, t, None], now, alpha[t - 1] if t else 1.0)
            alpha[t] = now / now.sum(axis=1, keepdims=True)
        for t in range(length - 2, -1, -1):
            now = (em[:, t + 1] * beta[t + 1]) @ ta.T
            now = np.where(mask[:, t + 1, None], now, beta[t + 1])
            beta[t] = now / now.sum(axis=1, keepdims=True)
        p = alpha * beta
        p = (p / p.sum(axis=2, keepdims=True)).transpose(1, 0, 2)
        d = np.where(mask, yy - p[:, :, 1], 0.0)
        g = np.bincount(np.where(x < 0, SLOTS, x).reshape(-1), weights=np.repeat(d.reshape(-1), x.shape[2]), minlength=SLOTS + 1) - 0.02 * w
        da = np.zeros((2, 2))
        for t in range(1, length):
            pair = alpha[t - 1][:, :, None] * ta[None] * (em[:, t] * beta[t])[:, None, :]
            pair = pair / pair.sum(axis=(1, 2), keepdims=True)
            live = mask[:, t]
            da -= pair[live].sum(axis=0)
            np.add.at(da, (yy[live, t - 1], yy[live, t]), 1.0)
        ds = np.bincount(yy[:, 0], minlength=2) - p[:, 0].sum(axis=0)
        gw += g**2
        ga += da**2
        gs += ds**2
        w += RATE * g / np.sqrt(gw)
        a += RATE * da / np.sqrt(ga)
        start += RATE * ds / np.sqrt(gs)
    return w[:SLOTS], np.exp(np.vstack([a, start]))


def logistic(x: np.ndarray, y: np.ndarray, steps: int = 400) -> np.ndarray:
    """Weights (with a constant) of a logistic regression, by Newton steps on a ridge."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(min(steps, 30)):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w))
        w += np.linalg.solve(h, x.T @ (y - p) - 0.1 * w)
    return w


def summary(p: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Of each text: log-odds of its largest marginal, log of their sum, log of its length."""
    out = np.zeros((len(sizes), 3))
    out[:, 0], out[:, 2] = -9.0, np.log1p(sizes)
    full = sizes > 0
    if full.any():
        top = np.clip(np.maximum.reduceat(p, starts[full]), 1e-4, 1 - 1e-4)
        out[full, 0] = np.log(top / (1 - top))
        out[full, 1] = np.log1p(np.add.reduceat(p, starts[full]))
    return out


class Tagger:
    """Emissions, chain and document weights of a fitted model."""

    def __init__(self, weights: np.ndarray, chain: np.ndarray, final: np.ndarray | None = None):
        self.weights, self.chain, self.final, self.known = weights, chain, final, {}

    def emission(self, word: str) -> float:
        if len(self.known) >= CACHE:
            self.known.clear()
        value = self.known[word] = float(self.weights[slots(word)].sum())
        return value

    def tag(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Marginals of all tokens, and each text's first token and number of tokens."""
        known, values, sizes = self.known, [], []
        for t in texts:
            words = TOKEN.findall(t.lower())
            values += [known[w] if w in known else self.emission(w) for w in words]
            sizes.append(len(words))
        sizes = np.array(sizes, dtype=int)
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(int)
        first = np.zeros(len(values), bool)
        first[starts[sizes > 0]] = True
        return marginals(np.array(values), first, self.chain), starts, sizes

    def score(self, p: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        x = np.hstack([summary(p, starts, sizes), np.ones((len(sizes), 1))])
        return 1 / (1 + np.exp(-np.clip(x @ self.final, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame) -> tuple | None:
    """The model of a bounded sample of labelled documents outside the held-out fold."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(F.col("toxic").isin(0, 1) & (crc_mod(F.col("doc_id"), 5) != 0)).dropDuplicates(["doc_id"])
    drawn = per_class(known, "toxic", "doc_id", PER_LABEL, "toxicity")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.octet_length("text") <= SAMPLE_BYTES).join(F.broadcast(drawn), "doc_id").orderBy("doc_id", "text").collect()
    toxic = [r["toxic"] for r in rows]
    if len(set(toxic)) < 2:
        return None
    texts = [TOKEN.findall(r["text"].lower()) for r in rows]
    marks = telling(texts, toxic)
    told = {w: any(f in marks for f in features(w)) for words in texts for w in words}
    rng = np.random.default_rng(0)
    spans = []
    for words, y in zip(texts, toxic):
        places = [i for i, w in enumerate(words) if y and told[w]]
        if y and places:
            places = [places[i] for i in rng.permutation(len(places))[:4]]
        elif not y and words:
            places = rng.integers(0, len(words), 4).tolist()
        for i in places:
            lo = max(0, i - int(rng.integers(0, CONTEXT + 1)))
            part = words[lo : lo + LENGTH]
            spans.append((part, [int(bool(y) and told[w]) for w in part]))
    if not any(any(s[1]) for s in spans):
        return None
    x = np.full((len(spans), LENGTH, 5), -1, dtype=int)
    mask, y = np.zeros((len(spans), LENGTH), bool), np.zeros((len(spans), LENGTH), int)
    for k, (part, labels_) in enumerate(spans):
        mask[k, : len(part)], y[k, : len(part)] = True, labels_
        for i, word in enumerate(part):
            s = slots(word)
            x[k, i, : len(s)] = s
    weights, chain = train_chain(x, mask, y)
    tagger = Tagger(weights, chain)
    tagged = tagger.tag([r["text"] for r in rows])
    final = logistic(summary(*tagged), np.array(toxic, float))
    return weights.astype(np.float32), chain, final


_taggers: dict[int, Tagger] = {}


def score(docs: DataFrame, model: tuple | None) -> DataFrame:
    """``docs`` (doc_id, text; other columns are ignored) -> doc_id, score, predicted, n_toxic, spans.

    spans: start:end of the toxic tokens' runs in code points, comma-joined. Whole texts count.
    Null and empty texts score as a text without tokens; without a model (no labels of both kinds)
    every score is 0; repeated rows score alike; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    key = hash((model[0].tobytes(), model[2].tobytes())) if model else 0

    def tag(batches):
        tagger = None
        if model:
            tagger = _taggers.get(key)
            if tagger is None:
                _taggers.clear()
                tagger = _taggers[key] = Tagger(*model)
        for batch in batches:
            texts = [t or "" for t in batch["text"].tolist()]
            scores, spans, counts = np.zeros(len(texts)), [""] * len(texts), [0] * len(texts)
            if tagger and texts:
                p, starts, sizes = tagger.tag(texts)
                scores = tagger.score(p, starts, sizes)
                high = p >= 0.5
                for i in np.flatnonzero([high[a : a + n].any() for a, n in zip(starts, sizes)]):
                    at = [m.span() for m in TOKEN.finditer(texts[i])]
                    runs, last = [], None
                    if len(at) == sizes[i]:  # lower-casing changed no token border
                        for k in np.flatnonzero(high[starts[i] : starts[i] + sizes[i]]):
                            if last is not None and k == last + 1:
                                runs[-1][1] = at[k][1]
                            else:
                                runs.append(list(at[k]))
                            last = k
                    counts[i] = int(high[starts[i] : starts[i] + sizes[i]].sum())
                    spans[i] = ",".join(f"{a}:{b}" for a, b in runs)
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "score": scores, "predicted": (scores >= 0.5).astype("int32"), "n_toxic": np.array(counts, dtype="int64"), "spans": spans})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(tag, "doc_id long, score double, predicted int, n_toxic long, spans string")


def detect(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, n_toxic, spans; null doc_ids are not held out."""
    out = score(docs, fit(docs, labels))
    return out.select("doc_id", F.coalesce(crc_mod(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted", "n_toxic", "spans")
