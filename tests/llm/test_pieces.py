"""SentencePiece encoding: ids, texts and spans against the library, normalisation against its normaliser."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2 as pb

from voxmill.llm import pieces
from voxmill.llm.queries import QUERIES

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "   ", "▁", "a▁ b", " lead", "trail ", "two  spaces\tand\nlines", "\x00", "wörld 😀 \U0001f9ff 漢字 ｶﾞ ﬁ Á", "á è́", "　  x",
       "x" * 3000, "<s> </s> <0x41> <unk>", "   many     runs      of spaces  ", "क्षि‍ཀ "]


def altered(charsmap="identity", squeeze=False, suffix=False, prefix=True, user=(), fallback=True):
    proto = pb.ModelProto()
    with open(PATH, "rb") as f:
        proto.ParseFromString(f.read())
    spec = sentencepiece.SentencePieceNormalizer(rule_name=charsmap).serialized_normalizer_spec()
    proto.normalizer_spec.ParseFromString(spec)
    proto.normalizer_spec.add_dummy_prefix, proto.normalizer_spec.remove_extra_whitespaces = prefix, squeeze
    proto.normalizer_spec.escape_whitespaces = True
    proto.trainer_spec.treat_whitespace_as_suffix = suffix
    for k, name in enumerate(user):
        proto.pieces[-1 - k].piece, proto.pieces[-1 - k].type = name, 4
    if not fallback:
        proto.trainer_spec.byte_fallback = False
        for p in proto.pieces:
            if p.type == 6:
                p.type = 5
    return proto.SerializeToString()


def against_library(model, texts):
    codec = pieces.Codec(model)
    ids, ends, first = codec.encode(texts)
    for i, t in enumerate(texts):
        want = codec.library.encode(t, return_type="proto").pieces
        own = slice(first[i], first[i + 1])
        assert [p.id for p in want] == ids[own].tolist(), t
        assert [p.end for p in want] == ends[own].tolist(), (t, [(p.piece, p.begin, p.end) for p in want], ends[own].tolist())
        begins = [0, *ends[own].tolist()][:len(want)]
        # white space that is squeezed out belongs to no piece of the library; here it goes to the next one
        assert all(a <= b.begin for a, b in zip(begins, want))
        if codec.plain:
            assert begins == [p.begin for p in want]
    assert codec.decode(ids, first) == [codec.library.decode(codec.library.encode(t)) for t in texts]


@pytest.mark.parametrize("kind", [{}, {"charsmap": "nmt_nfkc"}, {"charsmap": "nfkc_cf", "squeeze": True}, {"charsmap": "nmt_nfkc", "squeeze": True},
                                  {"squeeze": True}, {"prefix": False}, {"suffix": True, "charsmap": "nmt_nfkc"}, {"user": ("<sep>", "ab c")}, {"fallback": False}])
def test_ids_and_spans_are_those_of_the_library(kind):
    rng = random.Random(3)
    letters = "abc  ▁\t\néﬁ漢😀ｶﾞ́Ａ½ ​"
    more = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 40))) for _ in range(200)]
    against_library(altered(**kind), [*ODD, *more, "x ab c<sep>d <sep"])


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc", "nmt_nfkc_cf", "nfkc_cf", "identity"])
def test_normalised_texts_are_those_of_the_library(rule):
    for squeeze in (False, True):
        codec = pieces.Codec(altered(rule, squeeze))
        want = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=True, escape_whitespaces=True, remove_extra_whitespaces=squeeze)
        for t in ODD:
            assert codec.normalise(t.encode())[0].decode() == want.normalize(t), (rule, squeeze, t)


def test_stretches_encode_to_the_ids_of_the_whole(monkeypatch):
    monkeypatch.setattr(pieces, "STRETCH", 7)
    rng = random.Random(1)
    texts = [" ".join("".join(rng.choice("abcdeé▁ ") for _ in range(rng.randrange(0, 9))) for _ in range(rng.randrange(1, 30))) for _ in range(300)]
    with open(PATH, "rb") as f:
        against_library(f.read(), [*ODD, *texts, "word " * 20, "words  " * 9])


def test_rows(spark, odd_rows):
    docs, rows = odd_rows
    got = [(r["doc_id"], r["ids"], r["ends"], r["decoded"]) for r in pieces.encode(docs, PATH).collect()]
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    want = [(d, library.encode(t or ""), [p.end for p in library.encode(t or "", return_type="proto").pieces], library.decode(library.encode(t or ""))) for d, t in rows]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert pieces.encode(docs.limit(0), PATH).isEmpty()


@pytest.fixture
def odd_rows(spark):
    rows = [*enumerate(ODD), (3, "again"), (3, "again"), (None, "no id"), (None, None), (9, None), (50, "long word " * 150_000)]
    return spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, ids string"), rows


def test_registered_query(spark, sf):
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = QUERIES["op13_sentencepiece"](spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids) and r["n_bytes"] == len(texts[r["doc_id"]].encode())
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    assert np.isfinite([r["n_tokens"] for r in got]).all()
