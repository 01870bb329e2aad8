"""Language identification by a byte convolutional network trained in numpy.

Bytes are embedded, filters of widths 2, 3 and 4 slide over windows of 256 bytes, each filter keeps
its largest response, and a softmax names the language. A document's windows cover its whole text;
their probabilities are averaged by their bytes. For prediction the embedding and the filters are
folded into tables by byte pair, so that a response is a sum of two looked-up rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, small_batches
from .sampling import per_class, uniform

WINDOW, WIDTHS, FILTERS, EMBED = 256, (2, 3, 4), 16, 8
#: Bounds of the training sample: documents of a language, languages.
PER_LANGUAGE, LANGUAGES = 600, 200
EPOCHS, BATCH, RATE = 14, 64, 4e-3
#: Steps at least: a sample of few batches is gone through more often.
STEPS = 250
#: Windows that are scored at once.
CHUNK = 96
NONE = "und"


def windows(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(windows, bytes in each): the text cut every 256 bytes, the last one padded with blanks."""
    n = max(1, -(-len(data) // WINDOW))
    flat = np.full(n * WINDOW, 32, np.uint8)
    flat[: len(data)] = np.frombuffer(data, np.uint8)
    sizes = np.full(n, WINDOW)
    sizes[-1] = len(data) - (n - 1) * WINDOW
    return flat.reshape(n, WINDOW), sizes


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(x: np.ndarray, y: np.ndarray, classes: int, seed: int = 0) -> dict[str, np.ndarray]:
    """Weights fitted to windows x (n, 256) with classes y, by Adam on the cross-entropy."""
    rng = np.random.default_rng(seed)
    p = {"embed": rng.normal(0, 0.5, (256, EMBED)).astype(np.float32)}
    for w in WIDTHS:
        p[f"f{w}"] = rng.normal(0, (2 / (w * EMBED)) ** 0.5, (w * EMBED, FILTERS)).astype(np.float32)
        p[f"b{w}"] = np.zeros(FILTERS, np.float32)
    p["out"] = rng.normal(0, 0.1, (FILTERS * len(WIDTHS), classes)).astype(np.float32)
    p["bias"] = np.zeros(classes, np.float32)
    m, v, step = {k: np.zeros_like(a) for k, a in p.items()}, {k: np.zeros_like(a) for k, a in p.items()}, 0
    weight = len(y) / (classes * np.maximum(1, np.bincount(y, minlength=classes)))
    batches = max(1, len(y) // BATCH)
    for _ in range(max(EPOCHS, -(-STEPS // batches))):
        for at in np.array_split(rng.permutation(len(y)), batches):
            bytes_, target = x[at], y[at]
            e = p["embed"][bytes_]
            pooled, kept = [], []
            for w in WIDTHS:
                spans = np.lib.stride_tricks.sliding_window_view(e, w, axis=1).transpose(0, 1, 3, 2).reshape(len(at), -1, w * EMBED)
                r = spans @ p[f"f{w}"]
                best = r.argmax(axis=1)
                top = np.take_along_axis(r, best[:, None, :], axis=1)[:, 0, :] + p[f"b{w}"]
                pooled.append(np.maximum(top, 0))
                kept.append((spans, best, top > 0))
            h = np.concatenate(pooled, axis=1)
            q = softmax(h @ p["out"] + p["bias"])
            q[np.arange(len(at)), target] -= 1
            d = (q * (weight[target] / len(at))[:, None]).astype(np.float32)
            g = {k: np.zeros_like(a) for k, a in p.items()}
            g["out"], g["bias"] = h.T @ d, d.sum(axis=0)
            dh = d @ p["out"].T
            rows = np.arange(len(at))[:, None]
            for k, w in enumerate(WIDTHS):
                spans, best, live = kept[k]
                dr = dh[:, k * FILTERS : (k + 1) * FILTERS] * live
                g[f"b{w}"] = dr.sum(axis=0)
                chosen = spans[rows, best]  # (batch, filters, w * embed)
                g[f"f{w}"] = np.einsum("bfe,bf->ef", chosen, dr)
                de = dr[:, :, None] * p[f"f{w}"].T[None]
                for j in range(w):
                    np.add.at(g["embed"], bytes_[rows, best + j], de[:, :, j * EMBED : (j + 1) * EMBED])
            step += 1
            for k in p:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                p[k] = p[k] - RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return {k: a.astype(np.float32) for k, a in p.items()}


class Scorer:
    """The network with its filters folded into tables by byte pair."""

    def __init__(self, p: dict[str, np.ndarray]):
        part = {(w, j): p["embed"] @ p[f"f{w}"][j * EMBED : (j + 1) * EMBED] for w in WIDTHS for j in range(w)}
        pair = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(65536, -1)
        self.first = np.ascontiguousarray(np.concatenate([pair(part[w, 0], part[w, 1]) for w in WIDTHS], axis=1))
        self.second = np.ascontiguousarray(np.concatenate([pair(part[3, 2], np.zeros_like(part[3, 2])), pair(part[4, 2], part[4, 3])], axis=1))
        self.bias = np.concatenate([p[f"b{w}"] for w in WIDTHS])
        self.out, self.out_bias = p["out"], p["bias"]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """Class probabilities of windows (n, 256)."""
        probabilities = []
        for i in range(0, len(x), CHUNK):
            b = x[i : i + CHUNK].astype(np.int32)
            pairs = b[:, :-1] * 256 + b[:, 1:]  # the pair that starts at each place
            r = self.first[pairs]
            two = r[:, :, :FILTERS].max(axis=1)
            late = self.second[pairs[:, 2:]]
            four = (r[:, :-2, 2 * FILTERS :] + late[:, :, FILTERS:]).max(axis=1)
            three = r[:, :-2, FILTERS : 2 * FILTERS] + late[:, :, :FILTERS]
            last = r[:, -2, FILTERS : 2 * FILTERS] + self.second[b[:, -1] * 256][:, :FILTERS]
            three = np.maximum(three.max(axis=1), last)
            h = np.maximum(np.concatenate([two, three, four], axis=1) + self.bias, 0)
            probabilities.append(softmax(h @ self.out + self.out_bias))
        return np.concatenate(probabilities)


def sample(docs: DataFrame, labelled) -> tuple[np.ndarray, list[str]]:
    """One window of each sampled document whose lang is known and where ``labelled`` holds, and its lang."""
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & labelled)
    drawn = per_class(known.select("doc_id", "lang"), "lang", "doc_id", PER_LANGUAGE, "language", LANGUAGES).distinct()
    at = (uniform("window", "doc_id") * F.greatest(F.length("text") - WINDOW, F.lit(0))).cast("int")
    rows = known.join(F.broadcast(drawn), ["doc_id", "lang"]).select("lang", F.substring(F.col("text"), at + 1, F.lit(WINDOW)).alias("cut"), "doc_id").orderBy("doc_id", "cut").collect()
    x = [windows(r["cut"].encode()[:WINDOW])[0][0] for r in rows]
    return np.array(x, np.uint8).reshape(-1, WINDOW), [r["lang"] for r in rows]


def fit(docs: DataFrame, labelled) -> tuple[list[str], dict[str, np.ndarray] | None]:
    """(languages, weights) learned from at most PER_LANGUAGE windows of each language."""
    x, langs = sample(docs, labelled)
    names = sorted(set(langs))
    if not names:
        return [], None
    y = np.array([names.index(n) for n in langs])
    return names, train(x, y, len(names))


_scorers: dict[int, Scorer] = {}


def predict(docs: DataFrame, model: tuple[list[str], dict | None]) -> DataFrame:
    """``docs`` (doc_id, text; other columns are ignored) -> doc_id, lang_pred, score.

    Whole texts count, however long. Null texts and texts without a letter are 'und' with score 0, as
    are all if the model saw no language; a repeated row has the same result each time; an empty
    table gives no rows.
    """
    return scored(docs, model).select("doc_id", "lang_pred", "score")


def scored(docs: DataFrame, model: tuple[list[str], dict | None]) -> DataFrame:
    """predict() with ``lettered`` and ``surest``, the largest probability of a language in any window."""
    small_batches(docs.sparkSession)
    names, weights = model
    key = hash(tuple(a.tobytes() for a in weights.values())) if weights else 0

    def score(batches):
        scorer = None
        if weights:
            scorer = _scorers.get(key)
            if scorer is None:
                _scorers.clear()
                scorer = _scorers[key] = Scorer(weights)
        for batch in batches:
            texts = batch["text"].tolist()
            lang, sure, surest = [NONE] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
            lettered = [bool(t) and any(map(str.isalpha, t)) for t in texts]
            some = [i for i, has in enumerate(lettered) if has] if scorer else []
            at = 0
            while at < len(some):  # a bounded number of windows at once
                group, cuts, total = [], [], 0
                while at < len(some) and total < 4096:
                    cut = windows(texts[some[at]].encode())
                    group.append(some[at])
                    cuts.append(cut)
                    total += len(cut[1])
                    at += 1
                p = scorer(np.concatenate([c[0] for c in cuts]))
                sizes = np.concatenate([c[1] for c in cuts]).astype(float)
                starts = np.cumsum([0, *(len(c[1]) for c in cuts[:-1])])
                mean = np.add.reduceat(p * sizes[:, None], starts) / np.add.reduceat(sizes, starts)[:, None]
                tops = np.maximum.reduceat(p.max(axis=1), starts)
                for i, row, top in zip(group, mean, tops):
                    lang[i], sure[i], surest[i] = names[int(row.argmax())], float(min(1.0, row.max())), float(min(1.0, top))
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "lang_pred": lang, "score": sure, "lettered": lettered, "surest": surest})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(score, "doc_id long, lang_pred string, score double, lettered boolean, surest double")


def labelled_fold():
    return F.coalesce(crc_mod(F.col("doc_id"), 3) != 1, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learns from the documents outside the held-out fold (null
    doc_ids are neither learned from nor held out)."""
    out = predict(docs, fit(docs, labelled_fold()))
    return out.select("doc_id", F.coalesce(crc_mod(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of ``docs``, with all columns, that have letters and a window whose language is known
    with at least that probability; all with letters, if no language could be learned."""
    names, weights = model = fit(docs, labelled_fold())
    found = scored(docs, model)
    kept = found.where(F.col("lettered") & (F.col("surest") >= least) if weights else F.col("lettered"))
    return _with_rows(docs, kept)


def _with_rows(docs: DataFrame, kept: DataFrame) -> DataFrame:
    whole = docs.select(F.struct("*").alias("_row"), F.col("doc_id").cast("long").alias("_doc"))
    return whole.join(kept.select(F.col("doc_id").alias("_id")).distinct(), F.col("_doc").eqNullSafe(F.col("_id")), "left_semi").select("_row.*")
