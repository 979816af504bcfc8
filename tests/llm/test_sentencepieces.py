import hashlib

import numpy as np
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2

from provenant.llm import sentencepieces
from provenant.llm.common import tokenizer_file

MODEL = tokenizer_file("piece_bpe_32k.model")
TEXTS = [
    "", " ", "two  spaces  ", "▁mark ▁", "\n\n\tx", "日本語 テスト　x", "é́\x00\x01", "<s> </s> <unk> <0x41>",
    "z" * 20_000, "😀 ok 🏳️‍🌈", "ﬁ ①② ㌔ Ａ　Ｂ ſ", "word " * 4_000,
]


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf"])
@pytest.mark.parametrize("squeeze", [True, False])
@pytest.mark.parametrize("prefix", [True, False])
def test_character_map_gives_the_library_text(rule, squeeze, prefix):
    model = sentencepiece_model_pb2.ModelProto()
    model.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto())
    spec = model.normalizer_spec
    spec.remove_extra_whitespaces, spec.add_dummy_prefix = squeeze, prefix
    theirs = sentencepiece.SentencePieceNormalizer(
        model_proto=model.SerializeToString(), escape_whitespaces=True,
        add_dummy_prefix=prefix, remove_extra_whitespaces=squeeze)
    ours = sentencepieces.Normaliser(spec)
    for text in TEXTS:
        made, origin = ours(text)
        assert made == theirs.normalize(text)
        assert len(origin) == len(made.encode()) + 1
        assert (np.diff(origin) >= 0).all()


def test_ids_spans_and_round_trip():
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    sp = sentencepieces.encoder(MODEL)
    for text in TEXTS:
        ids, starts, ends = sp.encode(text)
        assert ids == library.encode(text)
        assert sp.decode(ids) == library.decode(ids)
        source = text.encode()
        assert b"".join(source[s:e] for s, e in zip(starts, ends)) == source


def test_rows_with_nulls_repeats_and_clashing_names(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(0, "", "x"), (None, "a b", "x"), (99, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = sentencepieces.digests(docs, MODEL).collect()
    assert len(got) == len(rows)
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    want = sorted((str(i), hashlib.sha256(",".join(map(str, library.encode(t or ""))).encode()).hexdigest())
                  for i, t, _ in rows)
    assert sorted((str(r.doc_id), r.ids_sha256) for r in got) == want
    assert all(r.covered_bytes == len((dict((i, t) for i, t, _ in rows)[r.doc_id] or "").encode()) for r in got)
    pieces = {r.doc_id: r.pieces for r in sentencepieces.encode(docs, MODEL).collect()}
    assert [p.id for p in pieces[2]] == library.encode(TEXTS[2]) and pieces[99] == []
    assert sentencepieces.digests(docs.limit(0), MODEL).count() == 0
