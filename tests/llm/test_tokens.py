from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tests.llm.conftest import corpus
from tillgrain.llm import bytebpe, wavelet
from tillgrain.llm.bytebpe import decode_documents, encode_documents, encoding
from tillgrain.llm.wavelet import Shard, read_shards, write_shard, write_shards

PATTERN = public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(wavelet.VOCABULARY)


@given(st.text(alphabet=st.sampled_from("aZé ÉßſİΣς'sdt019½²\t\n\x1c\x85\xa0 ́ﬁµªÀ漢😀#<|endoftext|>.,"), max_size=60))
@example("don't STOP <|endoftext|> ΑΣ Σ éx'LL")
@settings(max_examples=300, deadline=None)
def test_words_have_the_ids_of_the_whole_text(tokenizer, text):
    assert wavelet.encode(text.encode(), wavelet.VOCABULARY).tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_a_full_cache_starts_anew(tokenizer, monkeypatch):
    monkeypatch.setattr(wavelet, "CACHED_WORDS", 3)
    words = wavelet.WordIds(wavelet.VOCABULARY)
    for word in [b"one", b"two", b"three", b"four", b"one", b"five"]:
        assert np.frombuffer(words[word], "<u2").tolist() == tokenizer.encode(word.decode(), add_special_tokens=False).ids
    assert len(words) <= 3


@given(st.lists(st.integers(0, 70), max_size=300), st.integers(1, 5))
@settings(max_examples=60, deadline=None)
def test_shard_access_count_and_occurrences(ids, bits):
    ids = np.array(ids, np.int64)
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(wavelet, "BLOCK_BITS", 8 << bits)
        shard = Shard(write_shard(ids, np.array([4, 9]), np.array([len(ids), 0]), 1, 2))
    assert shard.ids().tolist() == ids.tolist()
    assert (shard.part, shard.number, shard.doc_ids.tolist(), shard.ends.tolist()) == (1, 2, [4, 9], [len(ids)] * 2)
    for i in range(0, len(ids), 7):
        assert shard.access(i) == ids[i]
    for token in (0, 1, 35, 70, 200):
        places = np.flatnonzero(ids == token)
        assert shard.count(token) == len(places)
        assert shard.count(token, 10, 50) == ((places >= 10) & (places < 50)).sum()
        assert [shard.occurrence(token, k) for k in range(len(places))] == places.tolist()
        with pytest.raises(IndexError):
            shard.occurrence(token, len(places))


@pytest.mark.parametrize("size", [1 << 20, 500])
def test_shards_hold_all_documents_in_order(make_docs, scratch, tokenizer, size):
    rows = [*corpus(7), (None, "without a number", None, None)]
    shards = write_shards(make_docs(rows), scratch, shard_tokens=size)
    found = sorted(read_shards(shards).collect(), key=lambda r: r.start)
    assert shards.count() > 3 or size > 500
    ids = [r.doc_id for r in found]
    assert ids[0] is None and ids[1:] == sorted(i for i, *_ in rows if i is not None)
    texts = {i: t for i, t, *_ in rows}
    start = 0
    for r in found:
        want = np.array([*tokenizer.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 1], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(want), zlib.crc32(want.tobytes()))
        start += len(want)


def test_shards_of_an_empty_table(make_docs, scratch):
    assert read_shards(write_shards(make_docs([]), scratch)).isEmpty()
    assert encode_documents(make_docs([]), scratch).isEmpty()


@pytest.mark.parametrize(("chunk", "overlap"), [(16_384, 512), (64, 24), (16, 8)])
def test_chunked_encoding_equals_the_whole(make_docs, scratch, chunk, overlap):
    odd = ["don't " * 40, "it'll we've 's" * 30, "a" * 500, " " * 300 + "x", "end   \n\n  " * 30, "é漢字😀 12345 ½" * 20, "!?#'re" * 50]
    rows = [*corpus(8), *((2000 + i, t, None, None) for i, t in enumerate(odd)), (2000, odd[0], None, None)]
    encoded = encode_documents(make_docs(rows), scratch, chunk=chunk, overlap=overlap)
    found = decode_documents(encoded).collect()
    assert sorted(r.doc_id for r in found) == sorted(i for i, *_ in rows)
    texts = {i: t or "" for i, t, *_ in rows}
    whole = encoding(bytebpe.RANKS, PATTERN)
    for r in found:
        want = whole.encode_ordinary(texts[r.doc_id])
        assert np.frombuffer(r.ids, "<u4").tolist() == want, r.doc_id
        assert bytes(r.decoded) == texts[r.doc_id].encode() and r.n_tokens == len(want)


@given(st.text(alphabet=st.sampled_from("ab'sltrevd 1½\n\t!é漢"), max_size=120), st.integers(1, 100))
@settings(max_examples=300, deadline=None)
def test_boundaries_within_a_chunk_are_those_of_the_text(text, cut):
    part = text[:cut]
    true = set(bytebpe.boundaries(text, PATTERN, 0, len(text), True))
    found = bytebpe.boundaries(part, PATTERN, 0, len(part), len(part) == len(text))
    assert set(found) <= true
