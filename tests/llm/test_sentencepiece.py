import hashlib
import random

import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2 as proto

from vqloom.llm import sentencepiece_codec as S
from vqloom.llm.queries import piece_model

from .rows import TEXTS, documents, empty

ODD = [t or "" for t in TEXTS] + ["▁x ▁", "á", "​﻿", "   lead", "trail   ", "a  b   c", "<s></s><unk><0x41>", "\r\n\t", "가각 日本語", "x" * 500, "\n\n\n a", "ab\nab", "a\n b"]


def test_ids_and_text_equal_the_library(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=piece_model())
    docs = documents(spark, ODD)
    want = []
    for r in docs.collect():
        ids = sp.encode(r["text"] or "")
        want.append((r["doc_id"], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()))
    assert sorted(map(tuple, S.op5_sentencepiece(docs, piece_model()).collect()), key=str) == sorted(want, key=str)
    assert S.op5_sentencepiece(empty(spark), piece_model()).count() == 0


def test_random_texts(spark):
    sp, own, r = sentencepiece.SentencePieceProcessor(model_file=piece_model()), S.codec(piece_model()), random.Random(6)
    for _ in range(1500):
        t = "".join(r.choice("ab eeetthinr  \n▁é日́😀\x00\t.,'") for _ in range(r.randint(0, 40)))
        assert own.ids(t).tolist() == own.encode(t)[0] == sp.encode(t)
        assert own.decode(sp.encode(t)) == sp.decode(sp.encode(t))


def test_spans_cover_the_source_bytes():
    own = S.codec(piece_model())
    for t in ODD:
        ids, begins, ends = own.encode(t[:3000])
        data = t[:3000].encode()
        joined = b"".join(data[a:b] for a, b in zip(begins, ends, strict=True))
        assert joined == data
        assert begins == sorted(begins)


def test_compiled_character_map(tmp_path):
    """With a map that rewrites text, normalisation and offsets equal the library's."""
    model = proto.ModelProto()
    with open(piece_model(), "rb") as f:
        model.ParseFromString(f.read())
    rules = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc", add_dummy_prefix=True, escape_whitespaces=True, remove_extra_whitespaces=True)
    spec = proto.ModelProto()
    spec.ParseFromString(rules.serialized_model_proto())
    model.normalizer_spec.precompiled_charsmap = spec.normalizer_spec.precompiled_charsmap
    model.normalizer_spec.remove_extra_whitespaces = True
    path = str(tmp_path / "m.model")
    with open(path, "wb") as f:
        f.write(model.SerializeToString())
    own, sp = S.Codec(path), sentencepiece.SentencePieceProcessor(model_file=path)
    for t in ["ﬁ　Ⅻ  x", "  ＡＢＣ  ", "á é", "​", "½ cup", "カﾞ", "plain text", "\n\nx\t y ", "™😀", ""]:
        norm, source = own.normalise(t)
        assert norm.decode() == rules.normalize(t)
        assert len(source) == len(norm) + 1 and source[-1] <= len(t.encode())
        assert own.encode(t)[0] == sp.encode(t)


def test_long_chunks_take_the_heap():
    sp, own = sentencepiece.SentencePieceProcessor(model_file=piece_model()), S.codec(piece_model())
    for t in ("thequickbrownfox" * 40, "ab" * 200, "\u2581" * 90 + "x", "x" * 65):
        assert own.encode(t)[0] == own.ids(t).tolist() == sp.encode(t)


def test_last_stage(spark):
    docs = documents(spark)
    sp = sentencepiece.SentencePieceProcessor(model_file=piece_model())
    got = sorted(((r["doc_id"], r["source"], tuple(r["ids"]), r["n_tokens"]) for r in S.encoded(docs, piece_model()).collect()), key=str)
    assert got == sorted(((r["doc_id"], r["source"], tuple(ids := sp.encode(r["text"] or "")), len(ids)) for r in docs.collect()), key=str)
    assert S.encoded(empty(spark), piece_model()).count() == 0


def test_query_and_stage_carry_source_spans(spark):
    own, docs = S.codec(piece_model()), documents(spark, ODD)
    want = []
    for r in docs.collect():
        ids, begins, ends = own.encode(r["text"] or "")
        packed = b"".join(x.to_bytes(4, "little") for x in [*begins[:1], *ends])
        want.append((r["doc_id"], ids, begins, ends, hashlib.sha256(packed).hexdigest()))
    stage = [(r["doc_id"], r["ids"], r["begins"], r["ends"]) for r in S.encoded(docs, piece_model()).collect()]
    assert sorted(stage, key=str) == sorted((w[:4] for w in want), key=str)
    rows = S.op5_sentencepiece(docs, piece_model(), spans=True).collect()
    assert sorted(((r["doc_id"], r["spans_sha256"]) for r in rows), key=str) == sorted(((w[0], w[4]) for w in want), key=str)


@pytest.mark.parametrize("kind", [4, 5])
def test_models_that_need_more_are_refused(tmp_path, kind):
    model = proto.ModelProto()
    with open(piece_model(), "rb") as f:
        model.ParseFromString(f.read())
    model.pieces[500].type = kind
    (tmp_path / "m.model").write_bytes(model.SerializeToString())
    with pytest.raises(ValueError):
        S.Codec(str(tmp_path / "m.model"))


def test_a_workers_table_stays_within_its_bound():
    """Distinct words beyond the bound, words that come back and very long ones; ids and spans stay those of the whole encoding."""
    own, r = S.Codec(piece_model(), 500), random.Random(5)
    for i in range(300):
        text = " ".join(["the", "common"] + ["".join(r.choices("abcdefghij", k=r.randint(1, 9))) for _ in range(20)] + ["x" * 5000 + str(i)] * (i % 50 == 0))
        if i % 10 == 0:
            assert [list(x) for x in own.spans(text)] == [list(x) for x in own.encode(text)]
        own.spans(text)
        assert len(own.kept) + len(own.old) <= 500 and max(map(len, own.kept)) <= S.LONG
    assert {S.MARK + "the", S.MARK + "common"} <= own.kept.keys() | own.old.keys()
