import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pagemill.llm import packing, token_codes, tokens
from tests.llm.cases import LONG, ROWS, clashing, docs, key

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)


def expected_ids(text):
    return [*LIBRARY.encode(text or "", add_special_tokens=False).ids, 2]


def as_list(data):
    return np.frombuffer(data, "<u4").tolist()


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from("aA'stÉß <|endofx> \n\t\r.,!0é9ÿ×÷µªİǅ́ͅ")), max_size=60))
def test_ids_are_the_librarys(text):
    assert as_list(tokens.encode(text, PATH, 2)) == expected_ids(text)


def test_ids_of_whole_tables(spark, sf001):
    for (text,) in spark.read.parquet(f"{sf001}/documents.parquet").select("text").collect():
        assert as_list(tokens.encode(text, PATH, 2)) == expected_ids(text)


def test_plain_words_need_no_splitter(monkeypatch):
    """A new word, with or without a mark behind it, goes to the merges at once."""
    tokens._loaded.clear()
    text = "Plainly spoken, newwords Qzxv. ABC"
    want = expected_ids(text)
    monkeypatch.setattr(tokens, "SPLIT", None)
    assert as_list(tokens.encode(text, PATH, 2)) == want
    tokens._loaded.clear()


def test_full_caches_are_emptied(monkeypatch):
    monkeypatch.setattr(tokens, "CHUNKS", 5)
    monkeypatch.setattr(tokens, "WORDS", 5)
    tokens._loaded.clear()
    text = " ".join(f"ab{c}de, Fg{c}" for c in "abcdefghijklmnopqrstuvwxyz") * 2
    assert as_list(tokens.encode(text, PATH)) == expected_ids(text)[:-1]
    assert len(tokens._loaded[PATH]) <= 5
    tokens._loaded.clear()


def test_knapsack_against_all_multisets():
    rng = random.Random(1)
    for _ in range(30):
        sizes = np.array(sorted(rng.sample(range(1, 12), 4)))
        prices = np.array([rng.random() for _ in sizes])
        value, counts = packing.knapsack(prices, sizes, 12)
        best = max((a * prices[0] + b * prices[1] + c * prices[2] + d * prices[3] for a in range(13) for b in range(13) for c in range(13) for d in range(13) if a * sizes[0] + b * sizes[1] + c * sizes[2] + d * sizes[3] <= 12), default=0)
        assert value == pytest.approx(best) and counts @ prices == pytest.approx(best) and counts @ sizes <= 12


def test_plan_holds_every_piece_and_is_near_the_bound():
    rng = random.Random(2)
    for top, n in ((1, 3), (20, 5000), (200, 20000)):
        histogram = dict(Counter(rng.randint(1, top) for _ in range(n)))
        patterns = packing.plan(histogram, 256)
        held = Counter()
        for pattern, times in patterns:
            assert sum(k * c for k, c in pattern.items()) <= 256
            for k, c in pattern.items():
                held[k] += c * times
        assert held == Counter(histogram)
        bound = -(-sum(k * c for k, c in histogram.items()) // 256)
        if top < 200:
            assert sum(t for _, t in patterns) <= bound * 1.01 + 2
    assert packing.plan({}, 256) == []


def check_packed(rows, source):
    texts = defaultdict(list)
    for doc_id, text, *_ in source:
        texts[doc_id].append(expected_ids(text))
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    assert set(by_doc) == set(texts)
    for doc_id, all_ids in texts.items():
        ids, found = all_ids[0], Counter((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in by_doc[doc_id])
        data = np.array(ids, "<u4").tobytes()
        at = 0
        for (start, length, crc, total), n in sorted(found.items()):
            assert (start, total, n) == (at, len(ids), len(all_ids)) and crc == zlib.crc32(data[4 * start : 4 * (start + length)])
            at += length
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 4096
    return by_sequence


def test_pack_small_cases(spark):
    check_packed(packing.pack(docs(spark), PATH).collect(), ROWS)
    check_packed(packing.pack(clashing(spark), PATH).collect(), ROWS)
    assert packing.pack(docs(spark, []), PATH).collect() == []


def test_pack_whole_table_with_little_padding(spark):
    source = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = packing.pack(source, PATH).collect()
    sequences = check_packed(rows, [tuple(r) for r in source.collect()])
    used = sum(r["length"] for r in rows)
    assert used / (4096 * len(sequences)) > 0.985


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 255), st.integers(0, 70_000), st.integers(0, 2**32 - 1)), max_size=600))
def test_codes_round_trip_and_random_access(ids):
    levels, bitmaps, ranks = token_codes.dac_encode(np.array(ids, np.uint32))
    assert token_codes.dac_decode(levels, bitmaps).tolist() == ids
    assert token_codes.dac_access(levels, bitmaps, ranks, np.arange(len(ids))).tolist() == ids


def check_codes(rows, source):
    ordered = sorted(((d, expected_ids(t)) for d, t, *_ in source), key=lambda x: (x[0] is not None, x[0] or 0, zlib.crc32(np.array(x[1], "<u4").tobytes())))
    want, at = [], 0
    for doc_id, ids in ordered:
        want.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert key(rows) == key(want)


def test_codes_small_cases(spark):
    check_codes(token_codes.round_trip(docs(spark), PATH).collect(), ROWS)
    check_codes(token_codes.round_trip(clashing(spark), PATH).collect(), ROWS)
    assert token_codes.round_trip(docs(spark, []), PATH).collect() == []


def test_codes_random_access_in_files(spark, tmp_path, monkeypatch):
    source = docs(spark, [(i, LONG[: 400 * i], "en", "a", 0) for i in range(40)])
    path = token_codes.write(source, PATH, str(tmp_path / "codes"), parts=1)
    ids = [x for i in range(40) for x in expected_ids(LONG[: 400 * i])]
    places = [0, 1, 777, len(ids) // 2, len(ids) - 1]
    assert token_codes.tokens_at(spark, path, 0, places) == {p: ids[p] for p in places}


def test_codes_whole_table(spark):
    source = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    check_codes(token_codes.round_trip(source, PATH).collect(), [tuple(r) for r in source.collect()])
