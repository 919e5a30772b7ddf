"""Words that every polynomial modulo a power of two takes for equal, and plans of many pieces."""

from __future__ import annotations

import time

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from fleetlens.llm.bpe import encode_texts
from fleetlens.llm.minhash import near_duplicates
from fleetlens.llm.packing import packed_documents, places, plan
from fleetlens.llm.textbytes import Rolling


def twin_words(length):
    """The letters a and b by the parity of the bits of the place, and the other way round."""
    one = "".join("ab"[i.bit_count() % 2] for i in range(length))
    return one, one.translate(str.maketrans("ab", "ba"))


@pytest.fixture(scope="module")
def twins(spark):
    rows = [word for length in (64, 1024, 2048, 4096) for word in twin_words(length)]
    return rows, spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").coalesce(1)


def test_hashes_of_twin_words_differ():
    rolling = Rolling()
    for length in (32, 64, 65, 128, 512, 1024, 4096):
        a, b = (np.frombuffer(w.encode(), dtype=np.uint8) for w in twin_words(length))
        data = np.concatenate([a, b, a])
        starts = np.array([0, length, 2 * length])
        hashes = rolling.words(rolling.bytes[data], starts, starts + length)
        assert hashes[0] != hashes[1] and hashes[0] == hashes[2]


def test_twin_words_have_ids_of_their_own(twins):
    rows, frame = twins
    for name in ("byte_bpe_50k.json",):
        path = public_tokenizers.path(name)
        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        for r in encode_texts(frame, path).collect():
            ids = np.frombuffer(r.ids, dtype="<u4").tolist()
            assert ids == tokenizer.encode(rows[r.doc_id], add_special_tokens=False).ids


def test_twin_words_are_packed_by_their_own_ids(twins):
    import zlib

    rows, frame = twins
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    for r in packed_documents(frame, path).collect():
        ids = tokenizer.encode(rows[r.doc_id], add_special_tokens=False).ids + [0]
        part = np.array(ids[r.start : r.start + r.length], dtype="<u4")
        assert zlib.crc32(part.tobytes()) == r.ids_crc32


def test_twin_words_are_not_near_duplicates(twins):
    _, frame = twins
    assert all(r.kept for r in near_duplicates(frame).collect())


def test_plans_follow_lengths_not_pieces():
    start = time.perf_counter()
    patterns = plan({1000: 10**8, 900: 10**8, 700: 10**7, 3: 10**9}, 2048)
    assert time.perf_counter() - start < 1 and len(patterns) < 50
    assert all(len(rows) < 50 for rows in places(patterns).values())
