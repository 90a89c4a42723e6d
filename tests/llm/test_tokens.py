"""Token ids piece by piece equal those of whole texts; files and packing keep every id."""

import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from corpusloom.llm import token_files
from corpusloom.llm.packing import pack
from corpusloom.llm.token_files import (decode_block, encode_block, read_token_files,
                                        write_token_files)
from corpusloom.llm.tokens import encoder, public_path
from corpusloom.session import new_path

NAMES = ("word_bpe_49k.json", "byte_bpe_50k.json")
PARTS = st.sampled_from([
    "a", "The", " ", "  ", "\n", "\t", "\r\n", "'s", "don't", "\xe9", "e\u0301", "\u03a3",
    "\u0391\u03a3", "\u0301", "12", "...", "<|endoftext|>", "\xa0", "\u2003", "\x1c",
    "\u6df7\u5408", "\U0001f600", "_", "\u0130", "\u200d", "\x85"])
TEXTS = st.lists(st.one_of(PARTS, st.text(max_size=4)), max_size=14).map("".join)


def direct(name, text):
    return Tokenizer.from_file(public_path(name)()).encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("name", NAMES)
def test_pieces_give_the_ids_of_the_whole(name):
    codec, whole = encoder(public_path(name)()), Tokenizer.from_file(public_path(name)())

    @settings(max_examples=400, deadline=None)
    @given(st.lists(TEXTS, max_size=3))
    def check(texts):
        got = [np.frombuffer(x, codec.dtype).tolist() for x in codec.encode(texts)]
        assert got == [whole.encode(t, add_special_tokens=False).ids for t in texts]

    check()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 1 << 31)), max_size=600))
def test_block_round_trip(ids):
    ids = np.array(ids, np.uint32)
    assert np.array_equal(decode_block(len(ids), *encode_block(ids)), ids)


def test_block_with_ranks_of_three_bytes():
    ids = np.arange(70_000, dtype=np.uint32)
    assert np.array_equal(decode_block(len(ids), *encode_block(ids)), ids)


ROWS = [(5, "b b\n c", 1), (2, None, 2), (9, "", 3), (None, "x", 4), (7, "word " * 3000, 5),
        (7, "word " * 3000, 5), (3, "\xe9t\xe9 " * 40, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, sequence_id int").repartition(3)


def ids_of(name, text):
    return np.array(direct(name, text or "") + [1], "<u4")


def test_files_hold_every_document_in_order(spark, docs):
    path = new_path(spark, "token-files")
    write_token_files(docs, path)
    got = sorted(read_token_files(spark, path).collect(), key=lambda r: r.start)
    want = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0))
    at = 0
    assert len(got) == len(want)
    for row, (doc_id, text, _) in zip(got, want):
        ids = ids_of(NAMES[0], text)
        assert tuple(row) == (doc_id, at, len(ids), zlib.crc32(ids))
        at += len(ids)


def test_files_of_an_empty_table(spark, docs):
    path = new_path(spark, "token-files")
    write_token_files(docs.limit(0), path)
    assert read_token_files(spark, path).count() == 0


def test_packing_covers_every_id_once(docs):
    rows = pack(docs, window=64).collect()
    seen = {}
    for r in rows:
        seen.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for n, parts in enumerate(seen[k] for k in sorted(seen)):
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == 64 or n == len(seen) - 1
    assert sorted(seen) == list(range(len(seen)))
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    for doc_id, text, _ in ROWS:
        ids, copies = ids_of(NAMES[1], text), sum(r[0] == doc_id for r in ROWS)
        own = by_doc[doc_id]
        assert sum(r.length for r in own) == copies * len(ids)
        for r in own:
            assert r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[r.start:r.start + r.length])


def test_packing_an_empty_table(docs):
    assert pack(docs.limit(0)).count() == 0


def test_blocks_of_small_and_of_large_ids_are_coded_alike(monkeypatch):
    rng = np.random.default_rng(3)
    small = (rng.zipf(1.3, 5000) % 40_000).astype("<u2")
    coded = token_files.encode_block(small)
    monkeypatch.setattr(np, "unique", None)
    assert token_files.encode_block(small) == coded  # ids are counted, not sorted
    monkeypatch.undo()
    monkeypatch.setattr(token_files, "COUNTED_IDS", 0)
    assert token_files.encode_block(small) == coded
    monkeypatch.undo()
    for ids in (small, small[:0], small.astype("<u4") + np.uint32(token_files.COUNTED_IDS)):
        assert token_files.decode_block(len(ids), *token_files.encode_block(ids)).tolist() == ids.tolist()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="aZé̸́가İ中'st<|1 ,.\t\xa0​🙂", min_size=1, max_size=8).map(
    lambda x: x.replace(" ", "_")), min_size=1, max_size=8, unique=True))
def test_pieces_learnt_together_are_those_learnt_apart(pieces):
    codec = encoder(public_path("word_bpe_49k.json")())
    pieces += ["<|endoftext|>", "a" * 300, "\xa0"]
    joined = codec._joined(pieces)
    assert joined is None or joined == codec._apart(pieces)
    assert codec._joined(["one", "two,", "don't"]) == codec._apart(["one", "two,", "don't"])
    other = encoder(public_path("byte_bpe_50k.json")())
    assert other._joined(["one"]) is None
