"""Token files and byte-level BPE against the public libraries."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from textprep.llm import byte_bpe, token_store
from textprep.llm.labelled import flat

WORDS = public_tokenizers.path("word_bpe_49k.json")
RANKS = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
TOKENIZER = Tokenizer.from_file(WORDS)
TEXTS = st.text(alphabet=st.sampled_from(list("aeinrstEN 09.,!'\n\t\x0b\x1c\x85\xa0é́漢🙂ß 　|<>-")), max_size=40)


def word_ids(text):
    return [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, token_store.END_ID]


@settings(max_examples=150, deadline=None)
@given(st.lists(TEXTS, min_size=1, max_size=5))
def test_both_encoders(texts):
    data, offsets = flat([t.encode() for t in texts])
    tokens = byte_bpe._Tokens(RANKS, public_tokenizers.PATTERN)
    ids, ends = tokens.encode(data, offsets)
    assert [x.tolist() for x in np.split(ids, ends[:-1])] == [LIBRARY.encode_ordinary(t) for t in texts]
    assert tokens.decode(ids)[0].tobytes() == data.tobytes()
    with open(WORDS, encoding="utf-8") as file:
        ids, ends = token_store.WordTokens(file.read()).encode(data, offsets)
    assert [x.tolist() for x in np.split(ids, ends[:-1])] == [word_ids(t) for t in texts]


def test_special_strings():
    """Strings of added tokens in a text are what the library makes of them."""
    texts = ["a<|endoftext|> b", "<|startoftext|>", "x <| y", "<|ENDOFTEXT|> The The"]
    with open(WORDS, encoding="utf-8") as file:
        ids, ends = token_store.WordTokens(file.read()).encode(*flat([t.encode() for t in texts]))
    assert [x.tolist() for x in np.split(ids, ends[:-1])] == [word_ids(t) for t in texts]


def test_tree_on_every_token_and_long_matches():
    tree = byte_bpe.TreeEncoder(RANKS)
    assert all(tree.tokens(t) == (t,) for t in RANKS)
    draw = random.Random(3)
    for size in (2, 7, 33, 400, 5000):
        for letters in ("a", "ab", "tion", " ", "é漢🙂a"):
            text = "".join(draw.choice(letters) for _ in range(size))
            assert tree.ids(text.encode()) == LIBRARY._encode_single_piece(text)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=30), min_size=1, max_size=5))
def test_segment(docs):
    ids = np.array([x for own in docs for x in own], np.uint32)
    ends = np.cumsum([len(own) for own in docs])
    names = [None if i == 1 else i - 2 for i in range(len(docs))]
    segment = token_store.Segment(token_store.encode_segment(names, ends, ids))
    assert segment.ids().tolist() == ids.tolist() and segment.doc_ids == names and segment.ends.tolist() == ends.tolist()
    assert [segment.token(i) for i in range(len(ids))] == ids.tolist()


def test_damaged_segment_and_long_rank_directory():
    ids = np.random.default_rng(0).integers(0, 1 << 20, 5000).astype(np.uint32)
    code = token_store.encode_segment([1], np.array([5000]), ids)
    segment = token_store.Segment(code)
    assert [segment.token(i) for i in range(0, 5000, 7)] == ids[::7].tolist()
    with pytest.raises(ValueError):
        token_store.Segment(code[:100] + bytes([code[100] ^ 1]) + code[101:])


def test_token_files(spark, documents, tmp_path, monkeypatch):
    monkeypatch.setattr(token_store, "SEGMENT_BYTES", 1 << 16)
    path = str(tmp_path / "tokens")
    token_store.write_tokens(spark, documents, WORDS, path)
    found = {r.doc_id: tuple(r)[1:] for r in token_store.read_documents(spark, path).collect()}
    start, every = 0, []
    for row in documents.orderBy("doc_id").collect():
        ids = word_ids(row.text)
        assert found.pop(row.doc_id) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start, every = start + len(ids), every + ids
    assert not found
    for first, count in ((0, 5), (1000, 20), (len(every) - 3, 10)):
        assert token_store.read_tokens(spark, path, first, count) == every[first : first + count]


def test_tokens_of_odd_rows(spark, odd_docs, no_docs):
    found = token_store.stored_documents(spark, odd_docs, WORDS).collect()
    assert len(found) == odd_docs.count()
    ordered = sorted(found, key=lambda r: r.start)
    assert [r.doc_id for r in ordered] == [None, None, 1, 1, 2, 3, 4, 5, 6, 7, 8]
    assert all(a.start + a.n_tokens == b.start for a, b in zip(ordered, ordered[1:]))
    assert {r.doc_id: r.n_tokens for r in found if r.doc_id in (2, 3, 4)} == {2: 1, 3: 1, 4: 1}
    assert token_store.stored_documents(spark, no_docs, WORDS).count() == 0


def test_byte_bpe(spark, odd_docs, no_docs, documents):
    vocabulary = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    for table in (documents, odd_docs, no_docs):
        found = byte_bpe.token_digests(spark, table, vocabulary, public_tokenizers.PATTERN).collect()
        expected = []
        for row in table.select("doc_id", "text").collect():
            ids = LIBRARY.encode_ordinary(row.text or "")
            digest = hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
            expected.append((row.doc_id, len(ids), digest, hashlib.sha256((row.text or "").encode()).hexdigest()))
        assert sorted(map(tuple, found), key=str) == sorted(expected, key=str)
    coded, name = byte_bpe.encoded(spark, odd_docs, vocabulary, public_tokenizers.PATTERN)
    assert coded.columns == [*odd_docs.columns, name] and name != "tokens"
