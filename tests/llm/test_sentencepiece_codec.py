"""The rebuilt tokenizer against the sentencepiece library."""

import hashlib
import random

import numpy as np
import pytest
import sentencepiece

from scanloom.llm import sentencepiece_codec as codec
from tests.conftest import DATA

SCHEMA = "doc_id long, text string, ids int"
TEXTS = ["", " ", "  ", "a", " a", "a ", "a  b   c", "the quick brown fox", "Ünïcödé ß 日本語 🙂", "tab\tline\nfeed\r\n", "<s> </s> <unk> <0x0A>", "▁marker ▁▁x", "\x00nul", "é" * 2000, "aaaa" * 500, "x" * 50000, " \n \n", "12,345.67%%% $$$"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=codec.MODEL)


def test_whole_texts_have_the_ids_of_the_library(library):
    rng = random.Random(0)
    texts = TEXTS + ["".join(rng.choice("ab ▁é\n<0x>") for _ in range(rng.randint(0, 60))) for _ in range(400)]
    for text, (ids, _, same) in zip(texts, codec.Codec(codec.load()).encode(texts)):
        assert ids.tolist() == library.encode(text), text
        assert same


def test_forgetting_units_changes_nothing(library):
    small = codec.Codec(codec.load(), remember=3)
    for _ in range(2):
        for text, (ids, _, _) in zip(TEXTS, small.encode(TEXTS)):
            assert ids.tolist() == library.encode(text)


def test_documents(spark, library):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = codec.load()
    encoded = codec.encode(docs, model)
    assert encoded.filter("not parity or not round_trip").count() == 0
    back = codec.decode(encoded, model).join(docs.select("doc_id", docs["text"].alias("own")), "doc_id")
    assert back.filter("text <> own").count() == 0
    for r in encoded.join(docs.select("doc_id", "text"), "doc_id").limit(50).collect():
        assert r.ids == library.encode(r.text)


def test_rows(spark):
    rows = [(i, t, 1) for i, t in enumerate(TEXTS)] + [(None, None, None), (0, None, 1), (3, "a", 1)]
    got = codec.encode(spark.createDataFrame(rows, SCHEMA), codec.load()).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.n_tokens == len(r.ids) and r.ids_sha256 == hashlib.sha256(np.array(r.ids, np.int32).tobytes()).hexdigest()
    assert [r.n_tokens for r in got if r.doc_id is None] == [0]
    assert codec.encode(spark.createDataFrame([], SCHEMA), codec.load()).collect() == []
    ids = spark.createDataFrame([(1, None, "x"), (2, [], "x")], "doc_id long, ids array<int>, text string")
    assert sorted((r.doc_id, r.text) for r in codec.decode(ids, codec.load()).collect()) == [(1, None), (2, "")]


def unigram_model():
    """A small unigram model with byte fallback, written by hand."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    for piece, score, kind in [("<unk>", 0, 2), ("<s>", 0, 3), ("</s>", 0, 3), *((f"<0x{b:02X}>", 0, 6) for b in range(256)),
                               ("▁", -2, 1), ("a", -3, 1), ("b", -3.5, 1), ("ab", -4, 1), ("▁a", -3.2, 1), ("▁ab", -5.5, 1), ("ba", -4.4, 1), ("▁▁", -3, 1), ("aba", -5, 1)]:
        model.pieces.add(piece=piece, score=score, type=kind)
    model.trainer_spec.model_type, model.trainer_spec.byte_fallback = 1, True
    model.normalizer_spec.name, model.normalizer_spec.remove_extra_whitespaces = "identity", False
    return model.SerializeToString()


def test_unigram_models():
    data = unigram_model()
    parsed = codec.parse(data)
    assert parsed.kind == codec.UNIGRAM and parsed.byte_fallback and not parsed.squeeze and parsed.dummy_prefix
    library, own, rng = sentencepiece.SentencePieceProcessor(model_proto=data), codec.Codec(data), random.Random(1)
    texts = ["".join(rng.choice("abb  é") for _ in range(rng.randint(0, 30))) for _ in range(300)]
    for text, (ids, back, same) in zip(texts, own.encode(texts)):
        assert ids.tolist() == library.encode(text) and back, text
        assert same, text


def test_models_that_cannot_be_rebuilt():
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto.FromString(unigram_model())
    model.pieces.add(piece="a▁b", score=-1, type=1)
    with pytest.raises(ValueError):
        codec.parse(model.SerializeToString())


def test_rows_come_from_the_rebuilt_tokenizer():
    """With a library that answers wrongly, ids and round trip stay and only parity goes."""
    own, truth = codec.Codec(codec.load()), sentencepiece.SentencePieceProcessor(model_file=codec.MODEL)
    own.reference = type("Wrong", (), {"encode": lambda _, x, **__: [5] if isinstance(x, str) else [[5]] * len(x)})()
    ids, back, same = own.encode(["the quick brown fox"])[0]
    assert ids.tolist() == truth.encode("the quick brown fox") and back and not same


def test_a_wrong_rebuild_shows_in_the_row():
    own = codec.Codec(codec.load())
    own.tokenizer = codec.rebuild(codec.PieceModel([p if p[0] != "▁the" else ("zqzqzq", p[1], p[2]) for p in own.model.pieces], own.model.kind, own.model.byte_fallback))
    ids, _, same = own.encode(["the"])[0]
    assert ids.tolist() != own.reference.encode("the") and not same


def test_written_names_of_pieces_in_unigram_models():
    data = unigram_model()
    library, own = sentencepiece.SentencePieceProcessor(model_proto=data), codec.Codec(data)
    texts = ["<s>", "a</s>b", "ab <unk> ba", "<0x41>", "aba<0x0A>é", "<0x41"]
    for text, (ids, back, same) in zip(texts, own.encode(texts)):
        assert ids.tolist() == library.encode(text) and back and same, text


def test_parity_of_models_that_squeeze_spaces():
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto.FromString(unigram_model())
    model.normalizer_spec.remove_extra_whitespaces = True
    data = model.SerializeToString()
    own, library = codec.Codec(data), sentencepiece.SentencePieceProcessor(model_proto=data)
    texts = ["a  b", " ab ", "", "  ", None, "ba   aba a"]
    for text, (ids, _, same) in zip(texts, own.encode(texts)):
        assert same and ids.tolist() == library.encode(text or ""), text
    own.reference = sentencepiece.SentencePieceProcessor(model_file=codec.MODEL)
    assert not own.encode(["a  b"])[0][2]


def test_new_units_are_encoded_together():
    import random

    from scanloom.llm import sentencepiece_codec as sc

    rng = random.Random(8)
    words = ["".join(rng.choice("abcdeéß漢😀<x0") for _ in range(rng.randint(1, 9))) for _ in range(700)] + ["<0x41>", "</s>", "\u0000"]
    units = [sc.MARKER + w for w in words]
    together, alone = sc.Codec(sc.load()), sc.Codec(sc.load())
    asked = []
    encode, tokenizer = together.tokenizer.encode_batch_fast, together.tokenizer

    class Counting:
        def encode_batch_fast(self, texts, **how):
            asked.append(len(texts))
            return encode(texts, **how)

        def __getattr__(self, name):
            return getattr(tokenizer, name)

    together.tokenizer = Counting()
    got, want = together._joined(units), alone._single(units)
    assert all(a.tolist() == b.tolist() for a, b in zip(got, want, strict=True)) and got[2].all()
    assert sum(asked) <= -(-len(units) // sc.JOIN)
