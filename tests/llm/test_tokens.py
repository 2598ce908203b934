"""Token files and byte-level BPE against the libraries themselves."""

import base64
import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, strategies as st
from tokenizers import Tokenizer

from cutline.llm import bpe, token_files

WORDS = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
ODD = ["", None, " ", "\n\n  \t", "It's he'll WE'VE 'twas", "İstanbul ΣΑΣ ﬁ Å é  x y", "日本語 🙂 à", "x" * 5000, "<|endoftext|> a<|startoftext|>",
       "Ünïcode straße ÀÉ×÷ 12345 $$$ a&b", "tab\tsep\x85next\x1cz", "ª º µ ² ½"]


def plain_ids(texts):
    library = Tokenizer.from_file(WORDS)
    return [library.encode(t or "", add_special_tokens=False).ids + [2] for t in texts]


def test_ids_are_those_of_the_library(texts):
    encoder = token_files.Encoder(open(WORDS, "rb").read())
    assert encoder.plain
    for text, ids in zip([*texts.values(), *ODD], plain_ids([*texts.values(), *ODD]), strict=True):
        assert np.frombuffer(encoder.encode(text or ""), np.uint32).tolist() == ids[:-1]


@given(st.lists(st.integers(0, 2**32 - 1)), st.lists(st.integers(0, 300)))
def test_packed_numbers_come_back(a, b):
    ranks = np.array(a + b, np.uint32)
    control, data = token_files.pack(ranks)
    assert len(control) == -(-len(ranks) // 4)
    assert token_files.unpack(control, data, len(ranks)).tolist() == ranks.tolist() if len(ranks) else control == b""


@pytest.mark.parametrize("block", [1, 700, 1 << 20])
def test_token_files_hold_every_document_in_order(spark, texts, tmp_path, block):
    rows = sorted([*texts.items(), *((1000 + i, t) for i, t in enumerate(ODD)), (1000, ""), (None, "no id")], key=lambda r: (r[0] is not None, r[0] or 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    token_files.write(docs, str(tmp_path / "files"), WORDS, 2, block=block)
    got = sorted(token_files.crc32(token_files.read(spark, str(tmp_path / "files"))).collect(), key=lambda r: r["start"])
    start = 0
    for (id_, _), ids, row in zip(rows, plain_ids([t for _, t in rows]), got, strict=True):
        crc = zlib.crc32(np.array(ids, "<u4").tobytes())
        assert tuple(row) == (id_, start, len(ids), crc)
        start += len(ids)


def test_token_files_of_no_rows(spark, tmp_path):
    token_files.write(spark.createDataFrame([], "doc_id long, text string, n long"), str(tmp_path / "files"), WORDS, 2)
    assert token_files.read(spark, str(tmp_path / "files")).count() == 0


def bpe_digest(text, encoding):
    ids = encoding.encode_ordinary(text or "")
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


@pytest.fixture(scope="module")
def encoding():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize(("chunk", "overlap"), [(1 << 15, 1 << 10), (300, 60), (64, 20)])
def test_byte_bpe_equals_the_library_wherever_chunks_are_cut(spark, texts, encoding, chunk, overlap):
    """Repeated rows, null ids, unbroken runs and runs of white space included."""
    rows = [*texts.items(), *((1000 + i, t) for i, t in enumerate(ODD)), (3000, "a" * 700 + " b" * 400), (3001, " " * 500 + "x" + "\n " * 200 + "'ll" * 90),
            (3002, "word " * 300), (3002, "word " * 300), (3002, "other " * 300), (None, "null id " * 80), (None, None)]
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, key string, part int").repartition(5)
    vocabulary = bpe.Vocabulary(spark, RANKS, public_tokenizers.PATTERN)
    encoded = bpe.encode(docs, vocabulary, chunk=chunk, overlap=overlap)
    got = bpe.digests(*encoded, vocabulary).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr((i, *bpe_digest(t, encoding))) for i, t in rows)
    for frame in encoded:
        for row in bpe.decode(frame, vocabulary).collect():
            assert bytes(row["bytes"]) == encoding.decode_bytes(row["ids"])
