"""Weighted acyclic automata that map phrases (rows of word ids) to counts."""

from __future__ import annotations

import zlib
from collections.abc import Iterable
from functools import cached_property

import numpy as np

#: Rows that are added at once, or half as many as those that they are added to, if that is more.
PORTION = 1 << 18


def _runs(changed: np.ndarray) -> np.ndarray:
    return np.cumsum(changed) - 1


def summed(grams: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows in order, with the sums of their counts."""
    order = np.lexsort(grams.T[::-1])
    first = np.zeros(len(grams), bool)
    first[:1] = True
    for column in grams.T:
        column = column[order]
        first[1:] |= column[1:] != column[:-1]
    return grams[order[first]], np.add.reduceat(counts[order], np.flatnonzero(first)) if len(grams) else counts


def _added(rows: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The sum of several tables of rows, which need not be equally wide; the list is emptied."""
    width, size = max(g.shape[1] for g, _ in rows), sum(len(c) for _, c in rows)
    grams, counts, at = np.full((size, width), -1, np.int64), np.empty(size, np.int64), 0
    while rows:
        some, n = rows.pop()
        grams[at : at + len(n), : some.shape[1]], counts[at : at + len(n)] = some, n
        at += len(n)
    return summed(grams, counts)


class Transducer:
    """States with arcs (label, target, weight) in order of their labels, and the weight at which a phrase
    may end in them (-1: none does). A phrase's count is the sum of the weights on its path and of
    the last state's. Weights stand as close to the root as they can, so that equal endings share states."""

    def __init__(self, first: np.ndarray, label: np.ndarray, target: np.ndarray, weight: np.ndarray, final: np.ndarray):
        self.first, self.label, self.target, self.weight, self.final = first, label, target, weight, final  # the root is the last state

    @cached_property
    def alphabet(self) -> np.ndarray:
        return np.unique(self.label)

    @cached_property
    def keys(self) -> np.ndarray:
        """State and label of each arc as one number, in order."""
        return np.repeat(np.arange(len(self.final), dtype=np.int64), np.diff(self.first)) * max(1, len(self.alphabet)) + np.searchsorted(self.alphabet, self.label)

    @staticmethod
    def build(grams: np.ndarray, counts: np.ndarray) -> "Transducer":
        """From distinct rows in order; -1 stands behind the end of shorter phrases. States are made from the
        longest prefixes up, one for each distinct set of endings."""
        m, width = grams.shape
        length = (grams >= 0).sum(axis=1)
        changed = np.ones((m, width + 1), bool)
        changed[1:, 0] = False
        changed[1:, 1:] = np.logical_or.accumulate(grams[1:] != grams[:-1], axis=1)
        firsts, labels, targets, weights, finals, states, arcs = [], [], [], [], [], 0, 0
        below = None  # of the prefixes one word longer: row, state, weight
        for depth in range(width, -1, -1):
            held = np.flatnonzero(length >= depth)
            fresh = changed[held, depth]
            rows = held[fresh]  # one for each prefix
            node = np.full(m, -1)
            node[held] = _runs(fresh)
            final = np.full(len(rows), -1, np.int64)
            ends = np.flatnonzero(length == depth)
            final[node[ends]] = counts[ends]
            if below is None or not len(below[0]):
                child, label, target, weight = (np.zeros(0, np.int64),) * 4
            else:
                child, label, target, weight = node[below[0]], grams[below[0], depth], below[1], below[2]
            push = np.where(final >= 0, final, np.iinfo(np.int64).max)
            np.minimum.at(push, child, weight)
            if depth == 0:
                push[:] = 0
            final = np.where(final >= 0, final - push, -1)
            weight = weight - push[child]
            sizes = np.bincount(child, minlength=len(rows))
            starts = np.cumsum(sizes) - sizes
            # states with the same end and the same arcs are one
            with np.errstate(over="ignore"):
                mixed = (label.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ target.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) + weight.astype(np.uint64) * np.uint64(0x165667B19E3779F9)
                mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                total = np.zeros(len(rows), np.uint64)
                np.add.at(total, child, mixed ^ (mixed >> np.uint64(32)))
                total += (final + 2).astype(np.uint64) * np.uint64(0x94D049BB133111EB)
            _, one, kind = np.unique(total, return_index=True, return_inverse=True)
            like = one[kind]  # the first state with the same digest; the same only if all is equal
            same = (final == final[like]) & (sizes == sizes[like])
            arc = np.flatnonzero(same[child])
            other = starts[like[child[arc]]] + arc - starts[child[arc]]
            differs = (label[arc] != label[other]) | (target[arc] != target[other]) | (weight[arc] != weight[other])
            same[child[arc[differs]]] = False
            like = np.where(same, like, np.arange(len(rows)))
            kept = np.flatnonzero(like == np.arange(len(rows)))
            number = np.zeros(len(rows), np.int64)
            number[kept] = np.arange(len(kept)) + states
            number = number[like]
            mine = np.isin(child, kept)
            firsts.append(np.cumsum(sizes[kept]) - sizes[kept] + arcs)
            labels.append(label[mine]), targets.append(target[mine]), weights.append(weight[mine]), finals.append(final[kept])
            states, arcs = states + len(kept), arcs + int(mine.sum())
            below = rows, number, push
        if not finals[-1].size:  # no phrases: a root alone
            firsts.append(np.zeros(1, np.int64)), finals.append(np.full(1, -1, np.int64))
        return Transducer(np.append(np.concatenate(firsts), arcs), *map(np.concatenate, (labels, targets, weights, finals)))

    def paths(self) -> tuple[np.ndarray, np.ndarray]:
        """All phrases in order, and their counts."""
        return summed(*self.rows())

    def rows(self) -> tuple[np.ndarray, np.ndarray]:
        """All phrases, shorter ones first, and their counts."""
        state, sums, grams, out = np.array([len(self.final) - 1]), np.zeros(1, np.int64), np.zeros((1, 0), np.int64), []
        while len(state):
            ends = self.final[state] >= 0
            out.append((grams[ends], sums[ends] + self.final[state[ends]]))
            size = self.first[state + 1] - self.first[state]
            arc = np.repeat(self.first[state] - np.cumsum(size) + size, size) + np.arange(size.sum())
            grams = np.column_stack([np.repeat(grams, size, axis=0), self.label[arc]])
            state, sums = self.target[arc], np.repeat(sums, size) + self.weight[arc]
        width = max(1, max(g.shape[1] for g, _ in out))
        grams = np.concatenate([np.pad(g, ((0, 0), (0, width - g.shape[1])), constant_values=-1) for g, _ in out])
        return grams, np.concatenate([c for _, c in out])

    def weigh(self, grams: np.ndarray) -> np.ndarray:
        """Counts of the rows (-1 behind the end), 0 for phrases that it lacks: one step for each word."""
        state, sums = np.full(len(grams), len(self.final) - 1), np.zeros(len(grams), np.int64)
        alive = np.full(len(grams), bool(len(self.alphabet)))
        for label in grams.T:
            go = np.flatnonzero(alive & (label >= 0))
            rank = np.minimum(np.searchsorted(self.alphabet, label[go]), len(self.alphabet) - 1)
            key = state[go] * len(self.alphabet) + rank
            arc = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            found = (self.alphabet[rank] == label[go]) & (self.keys[arc] == key)
            alive[go[~found]] = False
            go, arc = go[found], arc[found]
            state[go], sums[go] = self.target[arc], sums[go] + self.weight[arc]
        return np.where(alive & (self.final[state] >= 0), sums + self.final[state], 0)

    def pack(self) -> bytes:
        """Its arrays, each in the smallest type that holds it (the alphabet as steps), compressed."""
        arrays = [self.first, np.searchsorted(self.alphabet, self.label), self.target, self.weight, self.final + 1, np.diff(self.alphabet, prepend=0)]
        arrays = [a.astype(np.min_scalar_type(int(a.max(initial=0)))) for a in arrays]
        return zlib.compress(b"".join([np.array([[len(a), a.itemsize] for a in arrays], np.int64).tobytes(), *(a.tobytes() for a in arrays)]), 1)

    @staticmethod
    def unpack(data: bytes) -> "Transducer":
        data, at, out = zlib.decompress(data), 96, []
        for n, size in np.frombuffer(data, np.int64, 12).reshape(6, 2).tolist():
            out.append(np.frombuffer(data, f"u{size}", n, at).astype(np.int64))
            at += n * size
        first, rank, target, weight, final, steps = out
        return Transducer(first, np.cumsum(steps)[rank], target, weight, final - 1)

    @staticmethod
    def united(parts: Iterable["Transducer"], least: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """The phrases of all parts in order, with their summed counts, of at least ``least``. One part is taken
        after another and summed up by portions, so beside the sum only a portion or half as many phrases are held."""
        held, size, most = [], 0, PORTION
        for part in parts:
            held.append(part.rows())
            size += len(held[-1][1])
            if size >= most and len(held) > 1:
                held = [_added(held)]
                size = len(held[0][1])
                most = size + max(PORTION, size // 2)
        if not held:
            return np.zeros((0, 1), np.int64), np.zeros(0, np.int64)
        grams, counts = _added(held)
        return (grams, counts) if least <= 0 else (grams[counts >= least], counts[counts >= least])

    @staticmethod
    def union(parts: Iterable["Transducer"], least: int = 0) -> "Transducer":
        return Transducer.build(*Transducer.united(parts, least))
