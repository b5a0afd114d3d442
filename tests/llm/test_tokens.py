"""Encoding, decoding and packing against the tokenizers library."""

import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tracemill.llm import bpe, packing
from tracemill.llm.queries import op1_packing, op7_bpe, tokenizer_path

MODEL = bpe.load(tokenizer_path())
LIBRARY = Tokenizer.from_file(tokenizer_path())


def encode(texts):
    raw = [t.encode() for t in texts]
    bounds = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    ids, ends = bpe.Encoder(MODEL).encode(np.frombuffer(b"".join(raw), np.uint8), bounds)
    return [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)]


def library(texts):
    return [e.ids for e in LIBRARY.encode_batch(texts, add_special_tokens=False)]


PIECES = st.sampled_from(["'s", "'re", "'ll", " '", "\n'", "  ", "\t", "<|endoftext|>", "the", " and", "123", "é", "一", "😀", "!!", "aaaa", "͸", "\U000105c0", "\x00"])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=12), st.lists(PIECES, max_size=12).map("".join)), max_size=8))
def test_encoding_equals_the_library(texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    assert encode(texts) == library(texts)


def test_long_words_and_every_character():
    rng = random.Random(5)
    texts = ["a" * 5000, "".join(rng.choice("abcdefgh12") for _ in range(4000)), "x" + " " * 900, "!?" * 700]
    points = [chr(c) for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    texts += ["".join(p + x for x in points[k : k + 4000]) for k in range(0, len(points), 4000) for p in ("a", "1", "!", " ")]
    assert encode(texts) == library(texts)


def test_decoding_any_ids():
    rng, encoder = random.Random(7), bpe.Encoder(MODEL)
    for _ in range(500):
        ids = [rng.randrange(50257) for _ in range(rng.randrange(12))]
        assert encoder.decode(np.array(ids, np.int64)) == LIBRARY.decode(ids, skip_special_tokens=False).encode()


def test_border_checks_agree_with_exact_merging():
    rng, encoder = random.Random(9), bpe.Encoder(MODEL)
    words = ["".join(rng.choice(["th", "er", "on", "in", "a", "lo", "wei", "ß", "q"]) for _ in range(rng.randrange(1, 9))).encode() for _ in range(3000)]
    tokens, count = encoder.encode_words(words)
    owner, exact = encoder._merge(words, np.arange(len(words)))
    assert tokens.tolist() == exact.tolist() and count.tolist() == np.bincount(owner).tolist()


def test_odd_rows(odd, odd_rows, empty):
    rows = bpe.encoded(odd, tokenizer_path()).collect()
    got = sorted((r["doc_id"] or -1, np.frombuffer(r["ids"], "<u4").tolist()) for r in rows)
    assert got == sorted((i or -1, ids) for (i, _), ids in zip(odd_rows, library([t or "" for _, t in odd_rows]), strict=True))
    texts = bpe.decoded(bpe.encoded(odd, tokenizer_path()), tokenizer_path()).collect()
    assert sorted(bytes(r["decoded"]) for r in texts) == sorted((t or "").encode() for _, t in odd_rows)
    assert bpe.encoded(empty, tokenizer_path()).count() == 0 and packing.pack(empty, tokenizer_path()).count() == 0
    assert packing.sequences(empty, tokenizer_path()).count() == 0


@pytest.mark.parametrize("window", [1024, 7])
def test_packing_covers_every_id_once(spark, odd, odd_rows, window):
    pieces = packing.pack(odd.where("doc_id in (1, 2, 5, 7, 8, 11)"), tokenizer_path(), window=window, with_ids=True).collect()
    wanted = sorted(ids + [0] for ids in library([t or "" for i, t in odd_rows if i in (1, 2, 5, 7, 8, 11)]))
    stream = []
    for p in sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"])):
        assert p["sequence_id"] * window + p["offset"] == len(stream) and p["offset"] + p["length"] <= window
        ids = np.frombuffer(p["ids"], "<u4").tolist()
        assert len(ids) == p["length"] and zlib.crc32(p["ids"]) == p["ids_crc32"]
        stream += ids
    ends = [k + 1 for k, t in enumerate(stream) if t == 0]
    assert sorted(stream[a:b] for a, b in zip([0, *ends], ends, strict=False)) == wanted


def test_sequences_are_the_stream_cut_evenly(spark, odd):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = {r["sequence_id"]: bytes(r["ids"]) for r in packing.sequences(odd, tokenizer_path(), window=64).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(rows) == list(range(len(rows)))
    assert {len(rows[i]) for i in range(len(rows) - 1)} == {256}
    total = sum(p["length"] for p in packing.pack(odd, tokenizer_path()).collect())
    assert sum(map(len, rows.values())) == 4 * total


def test_queries(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    ids = dict(zip(texts, library(list(texts.values())), strict=True))
    assert {r["doc_id"]: r["n_tokens"] for r in op7_bpe(spark, sf_dir).collect()} == {i: len(x) for i, x in ids.items()}
    for p in op1_packing(spark, sf_dir).collect():
        whole = [*ids[p["doc_id"]], 0]
        assert p["doc_tokens"] == len(whole)
        assert p["ids_crc32"] == zlib.crc32(np.array(whole[p["start"] : p["start"] + p["length"]], "<u4").tobytes())
