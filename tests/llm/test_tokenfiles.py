import zlib

import numpy as np
import pytest
import zstandard
from tokenizers import Tokenizer

from provenant.llm import bytepieces, tokenfiles
from provenant.llm.common import tokenizer_file
from provenant.session import new_run_dir

MODEL = tokenizer_file("byte_bpe_50k.json")
TEXTS = [
    None, "", " ", "it's  we'll\n\n x", "trailing   ", "a\t\tb \x1c\x1d c", "日本語 x", "<|endoftext|> y",
    "ünï cödé 123 ½ ²", "z" * 30_000, "\xa0 x 's", "x y" * 3, "ﬁ ʼn ω", "same", "same",
]


def _want(text, end=2):
    return Tokenizer.from_file(MODEL).encode(text or "", add_special_tokens=False).ids + [end]


def test_words_encoded_alone_give_the_library_ids():
    ours = bytepieces.encoder(MODEL)
    for text in TEXTS + TEXTS:
        assert ours.encode(text).tolist() == _want(text)[:-1]


def test_files_round_trip(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(3, "again", "x"), (None, "no id", "x")]
    folder = new_run_dir(spark, "test-tokens")
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string")
    tokenfiles.write(docs, folder, MODEL, 2)
    got = sorted(tokenfiles.scan(spark, folder).collect(), key=lambda r: r.start)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    at = 0
    for row, (doc_id, text, _) in zip(got, order, strict=True):
        want = _want(text)
        assert (row.doc_id, row.start, row.n_tokens) == (doc_id, at, len(want))
        assert np.frombuffer(row.ids, "<u4").tolist() == want
        at += len(want)
    crcs = {r.start: r.ids_crc32 for r in tokenfiles.checks(tokenfiles.scan(spark, folder)).collect()}
    assert crcs == {r.start: zlib.crc32(r.ids) for r in got}
    some = tokenfiles.scan(spark, folder, wanted=[5, 3]).collect()
    assert sorted(r.doc_id for r in some) == [3, 3, 5]


def test_a_file_is_plain_zstandard_and_damage_is_noticed(spark, tmp_path):
    path = str(tmp_path / "one.zst")
    with open(path, "wb") as sink:
        writer = tokenfiles.FrameWriter(sink)
        writer.put(7, b"abcd")
        writer.put(None, b"efgh" * 1000)
        writer.close()
    raw = open(path, "rb").read()
    assert zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True).read() == b"abcd" + b"efgh" * 1000
    files, _ = tokenfiles._filesystem(str(tmp_path))
    with files.open_input_file(path) as source:
        reader = tokenfiles.FrameReader(source)
        assert reader.doc_ids == [7, None] and reader.content(1) == b"efgh" * 1000
        reader.checksums = reader.checksums + 1
        with pytest.raises(ValueError):
            reader.content(0)


def test_an_empty_table_gives_no_files(spark):
    folder = new_run_dir(spark, "test-tokens")
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert tokenfiles.write(docs, folder, MODEL, 2).count() == 0
    assert tokenfiles.scan(spark, folder).count() == 0
