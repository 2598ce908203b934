"""SentencePiece encoding against the library, and spans against the text."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

import __spark_entry__ as entry
from cutline.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
SMALL = "/root/testdata/sf0.001"
ODD = ["", " ", "  ", "a b", "▁▁x", "<s></s><unk><0x41>", "日本 𝄞\0‍", "a" * 3000, " " * 300, "tab\tline\n", "😀" * 50]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def own_model(rule: str | None = None, **switches) -> bytes:
    """The public model with another rule of normalisation or other switches."""
    with open(PATH, "rb") as file:
        model = sentencepiece_model_pb2.ModelProto.FromString(file.read())
    if rule:
        made = sentencepiece_model_pb2.ModelProto.FromString(sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto())
        model.normalizer_spec.precompiled_charsmap = made.normalizer_spec.precompiled_charsmap
    for name, value in switches.items():
        setattr(model.trainer_spec if name == "byte_fallback" else model.normalizer_spec, name, value)
    if not model.trainer_spec.byte_fallback:
        for piece in model.pieces:
            piece.type = 1 if piece.type == 6 else piece.type  # a plain piece
    return model.SerializeToString()


def random_texts(letters: str, n: int, seed: int = 0) -> list[str]:
    draw = random.Random(seed)
    return ["".join(draw.choice(letters) for _ in range(draw.randrange(30))) for _ in range(n)]


def differences(content: bytes, texts: list[str]) -> list[str]:
    codec, model = pieces.Codec(content), sentencepiece.SentencePieceProcessor(model_proto=content)
    out = []
    for text, (ids, edges) in zip(texts, codec.encode([t.encode() for t in texts]), strict=True):
        want = model.encode(text.encode(), return_type="proto").pieces
        if ids.tolist() != [p.id for p in want] or list(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)) != [(p.begin, p.end) for p in want]:
            out.append(text)
        elif codec.decode(np.append(ids, 2)) != model.decode([*ids.tolist(), 2]):
            out.append(text)
    return out


def test_whole_tables_and_odd_texts_equal_the_library(texts):
    with open(PATH, "rb") as file:
        assert differences(file.read(), [t or "" for t in texts.values()] + ODD + random_texts(" ▁ab é\n\t日𝄞<s>012", 400)) == []


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf"])
@pytest.mark.parametrize("prefix, trim", [(True, True), (False, False), (True, False), (False, True)])
def test_compiled_maps_equal_the_library(rule, prefix, trim):
    content = own_model(rule, add_dummy_prefix=prefix, remove_extra_whitespaces=trim)
    assert differences(content, ODD + random_texts(" ▁ab é\n\tﬁ½Ⅷ㍿ｶﾞＡ　①\0", 600)) == []


@pytest.mark.parametrize("switches", [{"byte_fallback": False}, {"escape_whitespaces": False}])
def test_other_switches_equal_the_library(switches):
    assert differences(own_model(**switches), ODD + random_texts(" ab日𝄞ЖЯ①☃", 400)) == []


def test_longest_entry_wins():
    codec = pieces.Codec(own_model("nfkc"))
    assert codec.map.longest("ｶﾞx".encode()) == ("ガ", len("ｶﾞ".encode()))
    assert codec.map.longest("ｶx".encode()) == ("カ", len("ｶ".encode()))
    assert codec.map.longest(b"x") is None


def test_any_ids_are_decoded_as_by_the_library(library):
    codec, draw = pieces.Codec(open(PATH, "rb").read()), random.Random(3)
    for _ in range(500):
        ids = [draw.choice([0, 1, 2, 259, 28705, draw.randrange(3, 259), draw.randrange(259, 32000)]) for _ in range(draw.randrange(12))]
        assert codec.decode(np.array(ids, int)) == library.decode(ids)


def test_bytes_that_are_no_text(library):
    codec = pieces.Codec(open(PATH, "rb").read())
    for data in (b"\xff\xfeab c\xc3", b"\xe2\x82 x"):
        want = library.encode(data, return_type="proto").pieces
        ids, edges = codec.encode([data])[0]
        assert [(p.id, p.begin, p.end) for p in want] == list(zip(ids.tolist(), edges[:-1].tolist(), edges[1:].tolist(), strict=True))


def test_frames_with_nulls_repeats_ties_and_clashing_columns(spark, library):
    long = "word après " * 40_000
    given = [(1, "a b"), (1, "a b"), (None, "x"), (2, None), (3, ""), (4, long)]
    docs = spark.createDataFrame([(i, t, "?", 1, 2) for i, t in given], "doc_id long, text string, id string, ids int, edges int")
    model = pieces.Model(spark, PATH)
    got = pieces.encode(docs, model, end=True).collect()
    want = sorted(((i, [*library.encode(t or ""), 2]) for i, t in given), key=repr)
    assert sorted(((r.id, r.ids) for r in got), key=repr) == want
    for r in got:
        data = (dict(given)[r.id] or "").encode()
        assert len(r.edges) == len(r.ids) + 1 and r.edges[0] == 0 and r.edges == sorted(r.edges) and r.edges[-1] == r.edges[-2] == len(data)
    back = pieces.decode(pieces.encode(docs, model, end=True), model).collect()
    assert sorted(((r.id, r.text) for r in back), key=repr) == sorted(((i, t or "") for i, t in given), key=repr)


def test_no_rows(spark):
    model = pieces.Model(spark, PATH)
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert pieces.digests(pieces.encode(docs, model), model).collect() == []


def test_query_equals_the_library(spark, texts, library):
    def digest(text):
        return hashlib.sha256(text.encode()).hexdigest()

    want = {}
    for i, text in texts.items():
        ids = [*library.encode(text or ""), 2]
        want[i] = (len(ids), digest(" ".join(map(str, ids))), digest(library.decode(ids)))
    got = entry.queries()["op12_sentence_pieces"](spark, SMALL).select("doc_id", F.struct("n_tokens", "ids_sha256", "decoded_sha256")).collect()
    assert {r[0]: tuple(r[1]) for r in got} == want and len(got) == len(want)
