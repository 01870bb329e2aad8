"""Personal data by weak supervision.

Four patterns with fixed meaning give the base spans (emails, IPv4 addresses, payment cards, phone
numbers), which always stay. Looser patterns propose further candidates: spelled-out emails, numbers
in national phone formats, unchecked card and dotted numbers. Labelers of three sorts vote on every
candidate, base or not: regular expressions (shape and checksum), gazetteers (mail domains' endings,
card issuers' leading digits) and context (words before the span). Expectation-maximisation finds
each labeler's reliability and each candidate's probability; these train a logistic span classifier
on the votes and the span's shape, which decides on the candidates. Both learn from the counts of
(kind, length, votes) over every candidate of all texts.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

KINDS = ("email", "ip", "card", "phone")
#: Longer spans are counted together by powers of two, so that the counts collected are bounded.
LENGTHS = 64
ROUNDS = 30

LOCAL_CHARS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
ANY = re.compile(r"[0-9@]|(?:at|AT)[)\]}]")
HOST = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

# Candidates beyond the base patterns.
SPELLED = re.compile(r"[A-Za-z0-9._%+-]{1,64} ?(?:\(at\)|\[at\]|\{at\}) ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|\(dot\)|\[dot\]|\{dot\}) ?[A-Za-z0-9-]{1,63})+")
GROUPED = re.compile(r"(?<![0-9.])[0-9]{4}([./_])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9])")
NATIONAL = re.compile(r"(?<![0-9A-Za-z.+-])(?:\([0-9]{2,4}\) ?|0[0-9]{1,3}[ /-]|[0-9]{3}[.-])[0-9]{2,4}(?:[ .-][0-9]{2,4}){1,3}(?![0-9A-Za-z])")

# Gazetteers and context words (fixed values).
ENDINGS = frozenset("com org net edu gov info biz io de fr es uk it nl eu us ca au ch at be jp".split())
ISSUERS = re.compile(r"4|5[1-5]|2[2-7]|3[47]|6011|65|35|30|36|38")
WORDS = {
    "email": re.compile(r"(?i)mail|contact|write|schreib|écri|correo"),
    "ip": re.compile(r"(?i)\bip\b|address|host|server|adresse|dirección"),
    "card": re.compile(r"(?i)card|visa|credit|karte|carte|tarjeta|payment"),
    "phone": re.compile(r"(?i)phone|\btel|call|fax|mobile|ruf|appel|llam|móvil"),
}
CODE = re.compile(r"(?i)version|\bno\.|page|order|isbn|token|\$|€|%")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str):
    """Leftmost matches of the email pattern: each '@host', and the local characters that lie before
    it after the last match."""
    end = 0
    for m in HOST.finditer(text):
        start = m.start()
        while start > end and text[start - 1] in LOCAL_CHARS:
            start -= 1
        if start < m.start():
            yield start, m.end()
            end = m.end()


def addresses(text: str):
    """Four numbers at a time of each dotted run; those with a part over 255 are dropped."""
    for m in DOTTED.finditer(text):
        if m.group().count(".") < 3:
            continue
        parts, at = m.group().split("."), m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            size = sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                yield at, at + size
            at += size + 1


def digits_of(text: str) -> str:
    return "".join(c for c in text if c in "0123456789")


def cards(text: str):
    for m in DIGITS.finditer(text):
        d = digits_of(m.group())
        if 12 <= len(d) <= 19 and luhn(d):
            yield m.span()


def phones(text: str):
    for m in PHONE.finditer(text):
        if 9 <= len(digits_of(m.group())) <= 15:
            yield m.span()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end), sorted by start and then by kind."""
    out = []
    if "@" in text:
        out += [(a, 0, b) for a, b in emails(text)]
    if "." in text:
        out += [(a, 1, b) for a, b in addresses(text)]
    out += [(a, 2, b) for a, b in cards(text)]
    if "+" in text:
        out += [(a, 3, b) for a, b in phones(text)]
    return sorted(out)


def candidates(text: str) -> list[tuple[int, int, int]]:
    """Further spans that may be personal data: (start, kind, end)."""
    out = []
    if "at)" in text or "at]" in text or "at}" in text:
        out += [(m.start(), 0, m.end()) for m in SPELLED.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in DIGITS.finditer(text) if 12 <= len(digits_of(m.group())) <= 19]
    out += [(m.start(), 2, m.end()) for m in GROUPED.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in DOTTED.finditer(text) if m.group().count(".") == 3]
    out += [(m.start(), 3, m.end()) for m in NATIONAL.finditer(text) if 9 <= len(digits_of(m.group())) <= 12]
    return out


def votes(text: str, start: int, kind: int, end: int) -> list[int]:
    """Each labeler's vote: 1 for personal data, -1 against, 0 for none."""
    span, before = text[start:end], text[max(0, start - 40) : start]
    d = digits_of(span)
    after = text[end : end + 1]
    shape = {
        0: lambda: 1 if "." in span or "dot" in span else -1,
        1: lambda: 1 if all(len(p) <= 3 and int(p) <= 255 for p in span.split(".")) and span.count(".") == 3 else -1,
        2: lambda: 1 if len(d) in (13, 14, 15, 16) else -1,
        3: lambda: 1 if span[:1] in "+(0" else 0,
    }[kind]()
    check = {0: lambda: 0, 1: lambda: -1 if d.startswith("0") else 0, 2: lambda: 1 if luhn(d) else -1, 3: lambda: 1 if len(d) in (10, 11, 12) else -1}[kind]()
    gazetteer = {
        0: lambda: 1 if re.split(r"[^A-Za-z0-9-]+", span.rstrip(")]}"))[-1].lower() in ENDINGS else -1,
        1: lambda: 0,
        2: lambda: 1 if ISSUERS.match(d) else -1,
        3: lambda: 1 if d[:1] in "1234" and span[:1] == "+" else 0,
    }[kind]()
    context = 1 if WORDS[KINDS[kind]].search(before) else -1 if CODE.search(before[-12:]) else 0
    edge = -1 if after.isalnum() or before[-1:].isalnum() else 0
    return [shape, check, gazetteer, context, edge]


LABELERS = 5


def em(v: np.ndarray, kinds: np.ndarray, n: np.ndarray | None = None) -> np.ndarray:
    """P(personal data) of each candidate: expectation-maximisation of one prior for each kind and
    each labeler's rates of its three votes under either truth, starting from the majority. Row i
    stands for n[i] candidates (one by default)."""
    n = np.ones(len(v)) if n is None else n
    p = 1 / (1 + np.exp(-v.sum(axis=1) - 0.25))
    for _ in range(ROUNDS):
        log_odds = np.zeros(len(v))
        for kind in np.unique(kinds):
            own = kinds == kind
            q, m = p[own] * n[own], n[own]
            prior = np.clip((q.sum() + 1) / (m.sum() + 2), 0.02, 0.98)
            odds = np.full(own.sum(), np.log(prior / (1 - prior)))
            for k in range(v.shape[1]):
                for vote in (-1, 0, 1):
                    cast = v[own, k] == vote
                    yes = (q[cast].sum() + 1 + vote) / (q.sum() + 3)
                    no = ((m - q)[cast].sum() + 1 - vote) / ((m - q).sum() + 3)
                    odds[cast] += np.clip(np.log(max(yes, 1e-3) / max(no, 1e-3)), -3, 3)
            log_odds[own] = odds
        p = 1 / (1 + np.exp(-np.clip(log_odds, -30, 30)))
    return p


def shape_of(v: np.ndarray, kinds: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The classifier's inputs: votes for and against by kind, the kind, the length, a constant."""
    kind = np.eye(len(KINDS))[kinds]
    by_kind = (kind[:, :, None] * v[:, None, :]).reshape(len(v), -1)
    return np.hstack([v, by_kind, kind, (lengths[:, None] - 15) / 10, np.ones((len(v), 1))]).astype(float)


def train(v: np.ndarray, kinds: np.ndarray, lengths: np.ndarray, n: np.ndarray | None = None) -> np.ndarray:
    """Weights of the span classifier, by Newton steps on a ridge towards the labelers' posterior; a
    step is halved until the loss falls. Row i stands for n[i] candidates."""
    n = np.ones(len(v)) if n is None else n
    p, x = em(v, kinds, n), shape_of(v, kinds, lengths)
    w, ridge = np.zeros(x.shape[1]), max(0.5, 1e-9 * n.sum())  # large counts: solvable in floats
    loss = lambda w: (n * (np.logaddexp(0, x @ w) - p * (x @ w))).sum() + ridge / 2 * w @ w
    now = loss(w)
    for _ in range(100):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        h = (x * (n * q * (1 - q))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (n * (p - q)) - ridge * w)
        while (then := loss(w + step)) > now and np.abs(step).max() > 1e-10:
            step /= 2
        if then > now or np.abs(step).max() <= 1e-10:
            break
        w, now = w + step, then
    return w


def all_spans(text: str, weights: np.ndarray | None) -> tuple[list, list]:
    """(base spans, all spans): a candidate counts if the classifier accepts it and it touches no other."""
    if not ANY.search(text):
        return [], []
    base = base_spans(text)
    if weights is None:
        return base, base
    more = candidates(text)
    if not more:
        return base, base
    taken, out, last = sorted((a, b) for a, _, b in base), list(base), -1
    at = 0
    free = []
    for a, kind, b in sorted(more):  # both lists run by start; base spans of other kinds may overlap
        while at < len(taken) and taken[at][1] <= a:
            at += 1
        if not any(x < b and y > a for x, y in taken[at : at + 4]):
            free.append((a, kind, b))
    if free:
        v = np.array([votes(text, *s) for s in free])
        good = shape_of(v, np.array([s[1] for s in free]), np.array([s[2] - s[0] for s in free])) @ weights >= 0
        for s, ok in zip(free, good):
            if ok and s[0] >= last and (s[1] != 2 or luhn(digits_of(text[s[0] : s[2]]))):  # no card fails its checksum
                out.append(s)
                last = s[2]
    return base, sorted(out)


def length_class(length: int) -> int:
    return length if length <= LENGTHS else 1 << length.bit_length()


def histogram(docs: DataFrame) -> DataFrame:
    """kind, class (of lengths), votes, n, length (mean): counts of every candidate of all documents.

    At most 4 kinds, 64 lengths and 31 classes of longer spans, and 3 ** 5 votes, however many documents.
    """
    small_batches(docs.sparkSession)

    def vote(batches):
        for batch in batches:
            n, total = Counter(), Counter()
            for t in batch["text"].tolist():
                for a, kind, b in set(base_spans(t)) | set(candidates(t)):
                    key = (kind, length_class(b - a), tuple(votes(t, a, kind, b)))
                    n[key] += 1
                    total[key] += b - a
            yield pd.DataFrame([(*k, n[k], total[k]) for k in n], columns=["kind", "class", "votes", "n", "total"])

    texts = docs.where(F.col("text").rlike("[0-9@]|at[)\\]}]")).select("text")
    counted = texts.mapInPandas(vote, "kind int, class long, votes array<int>, n long, total long")
    return counted.groupBy("kind", "class", "votes").agg(F.sum("n").alias("n"), (F.sum("total") / F.sum("n")).alias("length"))


def fit(docs: DataFrame) -> np.ndarray | None:
    """Weights learned from every candidate of all documents, by their counts."""
    rows = histogram(docs).orderBy("kind", "class", "votes").collect()
    if not rows:
        return None
    column = lambda c: np.array([r[c] for r in rows])
    return train(column("votes"), column("kind"), column("length"), column("n").astype(float))


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find(docs: DataFrame, weights: np.ndarray | None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (of all spans' base part), base_sha256, spans.

    Whole texts count, however long. Null and empty texts have no spans; repeated rows have equal
    results; an empty table gives no rows; other columns are ignored.
    """
    small_batches(docs.sparkSession)

    def spans(batches):
        for batch in batches:
            found = [all_spans(t or "", weights) for t in batch["text"].tolist()]
            out = {"doc_id": batch["doc_id"].astype("Int64")}
            for k, kind in enumerate(KINDS):
                out[f"n_{kind}"] = [sum(s[1] == k for s in base) for base, _ in found]
            out["base_sha256"] = [hashlib.sha256(written(base).encode()).hexdigest() for base, _ in found]
            out["spans"] = [written(every) for _, every in found]
            yield pd.DataFrame(out)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(spans, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def detect(docs: DataFrame) -> DataFrame:
    return find(docs, fit(docs))
