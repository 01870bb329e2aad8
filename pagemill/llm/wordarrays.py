"""Words of many texts at once, as Arrow arrays (shared by phrase mining and decontamination)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled together; a longer text is handled alone.
SEGMENT_BYTES = 8 << 20
#: Bytes of text that are cut into words at once; a longer text is cut alone.
SPLIT_BYTES = 1 << 20
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_classes(word: str | None = None, breaks: str = "", blanks: str = "") -> np.ndarray:
    """Class of each byte after lower-casing: 0 a word's, 1 between words, 2 the end of a piece.

    ``word`` lists the ASCII characters of words (bytes from 128 always are); without it all bytes
    are, except ``breaks`` and ``blanks``.
    """
    out = np.zeros(256, np.uint8)
    if word is not None:
        out[:128] = 1
        out[list(word.encode())] = 0
    out[list(blanks.encode())] = 1
    out[list(breaks.encode())] = 2
    return out


@dataclass
class Words:
    """Words in order: their bytes, the text each lies in, and whether a new piece begins with it."""
    words: pa.Array
    text: np.ndarray
    begins: np.ndarray
    texts: int


def split(texts: pa.Array, classes: np.ndarray) -> Words:
    """The words of the texts (null: none), A-Z in lower case. Texts are cut a few at a time, so the work takes
    little memory beside the words."""
    texts = pc.fill_null(texts, "").cast(pa.large_binary())
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at, held = 0, []
    while at < len(texts) or not held:
        n = max(1, int(np.searchsorted(bounds, bounds[at] + SPLIT_BYTES, side="right")) - 1 - at) if len(texts) else 0
        held.append(_cut(raw[bounds[at] : bounds[at + n]], bounds[at : at + n + 1] - bounds[at], at, classes))
        at += n
    letters, lengths, text, begins = (held[0][k] if len(held) == 1 else np.concatenate([h[k] for h in held]) for k in range(4))
    offsets = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    return Words(pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(letters)]), text, begins, len(texts))


def _cut(raw: np.ndarray, bounds: np.ndarray, number: int, classes: np.ndarray) -> tuple[np.ndarray, ...]:
    """The words of texts that lie one behind the other, the first of which is text ``number``: the bytes of all, the
    length of each, its text and whether a piece begins with it."""
    raw = LOWER[raw]
    kind = classes[raw]
    inside = kind == 0
    first = np.zeros(len(raw) + 1, bool)  # a text's first byte begins a word of its own
    first[bounds[:-1]] = True
    at = np.flatnonzero(inside & (first[:-1] | np.concatenate([[True], ~inside[:-1]])))
    stop = np.flatnonzero(inside & (np.concatenate([first[1:-1], [True]]) | np.concatenate([~inside[1:], [True]]))) if len(raw) else at
    text = np.searchsorted(bounds, at, side="right") - 1
    ends = np.searchsorted(np.flatnonzero(kind == 2), at)  # piece ends before each word
    begins = np.ones(len(at), bool)
    begins[1:] = (text[1:] != text[:-1]) | (ends[1:] != ends[:-1])
    return raw[inside], (stop - at + 1).astype(np.int32), (text + number).astype(np.int32), begins


def segments(batches: Iterator[pa.RecordBatch], column: str, limit: int = SEGMENT_BYTES) -> Iterator[pa.Table]:
    """The batches' rows in tables whose texts take ``limit`` bytes at most, unless one text takes more."""
    held, size = [], 0
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        at = 0
        while at < batch.num_rows:
            room = np.searchsorted(np.cumsum(sizes[at:]), limit - size, side="right")
            if not room and held:
                yield pa.Table.from_batches(held)
                held, size = [], 0
                continue
            n = max(1, int(room))
            held.append(batch.slice(at, n))
            size += int(sizes[at : at + n].sum())
            at += n
    if held:
        yield pa.Table.from_batches(held)


def column(table: pa.Table, name: str) -> pa.Array:
    held = table.column(name)
    return held.chunk(0) if held.num_chunks == 1 else pa.concat_arrays(held.chunks)
