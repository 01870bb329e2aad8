"""Token ids of a public vocabulary file, with caches of words kept in each Python worker.

Ids are those of ``tokenizers.Tokenizer.encode(text, add_special_tokens=False)`` for the vocabulary
``word_bpe_49k.json``, whose normaliser and splitter treat blank-separated chunks apart from one
another. A chunk of ASCII and Latin letters, digits and marks is split into its words here and each
word goes to the library's merges once; any other chunk goes to the library whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

#: Entries of a worker's two caches; a full cache is emptied, so memory stays bounded.
CHUNKS, WORDS = 500_000, 500_000

# The splitter of the vocabulary file after lower-casing, for the characters of PLAIN.
SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")
PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")


def byte_letters() -> dict[int, str]:
    """The printable character that byte-level vocabularies write for each byte: printable Latin-1
    stands for itself, the other bytes follow from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


class _Words(dict):
    def __init__(self, tokenizer):
        super().__init__()
        self.model, self.letters = tokenizer.model, byte_letters()
        self.written = [i.to_bytes(4, "little") for i in range(tokenizer.get_vocab_size())]

    def __missing__(self, word: str) -> bytes:
        written = word if word.isascii() else "".join(map(self.letters.__getitem__, word.encode()))
        ids = b"".join([self.written[t.id] for t in self.model.tokenize(written)])
        if len(self) >= WORDS:
            self.clear()
        self[word] = ids
        return ids


class _Chunks(dict):
    def __init__(self, tokenizer):
        super().__init__()
        self.tokenizer, self.words = tokenizer, _Words(tokenizer)

    def __missing__(self, chunk: str) -> bytes:
        if chunk.isascii() and chunk.isalpha():  # one word
            ids = self.words[chunk.lower()]
        elif chunk.isascii() and chunk[:-1].isalpha() and chunk[-1] in ".,":  # and a mark
            ids = self.words[chunk[:-1].lower()] + self.words[chunk[-1]]
        elif PLAIN.fullmatch(chunk) and "<|" not in chunk:
            ids = b"".join(map(self.words.__getitem__, SPLIT.findall(chunk.lower())))
        else:
            ids = b"".join(i.to_bytes(4, "little") for i in self.tokenizer.encode(chunk, add_special_tokens=False).ids)
        if len(chunk) <= 64:
            if len(self) >= CHUNKS:
                self.clear()
            self[chunk] = ids
        return ids


_loaded: dict[str, _Chunks] = {}


def encode(text: str | None, vocabulary: str, end: int | None = None) -> bytes:
    """Ids of the whole text as little-endian unsigned 32-bit integers, then the id ``end``."""
    chunks = _loaded.get(vocabulary)
    if chunks is None:
        from tokenizers import Tokenizer

        chunks = _loaded[vocabulary] = _Chunks(Tokenizer.from_file(vocabulary))
    ids = b"".join(map(chunks.__getitem__, (text or "").replace("\n", " ").split(" "))) if text else b""
    return ids if end is None else ids + end.to_bytes(4, "little")


def encode_all(texts: Iterable[str | None], vocabulary: str, end: int | None = None):
    return (encode(t, vocabulary, end) for t in texts)
