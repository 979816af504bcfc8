import hashlib

import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from provenant.llm import toxicity
from provenant.llm.common import table, tokenizer_file
from tests.llm.test_decontamination import _brute as overlaps
from tests.llm.test_jaccard import _components
from tests.llm.test_linededup import _brute as lines_left

DIR = "/root/testdata/sf0.001"


def test_every_stage_equals_plain_code(spark):
    docs = table(spark, DIR, "documents")
    columns = docs.columns
    before = {r.doc_id: r for r in docs.collect()}
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DIR).cache()
        out[name] = {r.doc_id: r for r in docs.collect()}
        assert docs.columns == columns or name == corpus_pipeline.STAGES[-1][0]
    tables = table(spark, DIR, "documents")
    scorer = toxicity.fit(toxicity.training_rows(tables, table(spark, DIR, "labels")))
    model, centre, scale, weights = scorer.value
    def score(text):
        z = sum((f - c) / s * w for f, c, s, w in zip(model.features(text), centre, scale, weights)) + weights[-1]
        return z
    assert set(out["toxicity"]) == {i for i, r in before.items() if score(r.text) < 0}
    rows = sorted((i, r.text) for i, r in out["toxicity"].items())
    assert [out["line dedup"][i].text for i, _ in rows] == lines_left(rows)
    assert all(r.n_chars == len(r.text) for r in out["line dedup"].values() if r.text != before[r.doc_id].text)
    found = _components([(i, r.text) for i, r in out["line dedup"].items()])
    assert set(out["n-gram Jaccard join"]) == set(found.values())
    items = [r.text for r in table(spark, DIR, "benchmark").collect()]
    clean = out["benchmark decontamination"]
    for i, r in out["n-gram Jaccard join"].items():
        if len(r.text) < 3_000:
            assert (i in clean) != any(overlaps(r.text, x) for x in items)
    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file("piece_bpe_32k.model"))
    last = out["SentencePiece encoding and decoding"]
    assert set(last) == set(clean)
    assert all(last[i].ids_sha256 == hashlib.sha256(",".join(map(str, sp.encode(r.text))).encode()).hexdigest()
               for i, r in clean.items())


def test_stages_keep_columns_with_odd_names(spark):
    docs = table(spark, DIR, "documents").limit(60)
    odd = ["_toxicity", "_numbers", "_text", "a.b", "id", "component_id", "gone", "sig"]
    wide = docs.select("*", *[F.lit(k).alias(name) for k, name in enumerate(odd)])
    want = {r.doc_id for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, wide, DIR)
        assert out.columns == wide.columns, name
        rows = out.collect()
        assert rows and {r.doc_id for r in rows} <= want
        assert all([r[c] for c in odd] == list(range(len(odd))) for r in rows), name
