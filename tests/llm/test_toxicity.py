import math
import random
import zlib
from pathlib import Path

import numpy as np
import pytest

from provenant.llm import toxicity
from provenant.llm.queries import op8_toxicity
from provenant.session import shared_dir

DIR = "/root/testdata/sf0.01"


def _texts(n, seed):
    rng = random.Random(seed)
    syllables = ["an", "the", "ti", "or", "en", "re", "sh"]
    rows = []
    for i in range(n):
        words = ["".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(rng.randint(5, 300))]
        toxic = int(rng.random() < 0.25)
        if toxic:
            for _ in range(rng.randint(1, 3)):
                words[rng.randrange(len(words))] = "vulgo" + rng.choice(["", "s", "ix", "ano", "eur"])
        rows.append((i, " ".join(words), toxic))
    return rows


@pytest.fixture(scope="module")
def scored(spark):
    rows = _texts(1500, 5)
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (3, None), (-5, 1)],
                                   "doc_id long, toxic int")
    scorer = toxicity.fit(toxicity.training_rows(docs, labels))
    return scorer, rows, docs


def test_held_out_texts_are_told_apart(scored):
    scorer, rows, docs = scored
    score = {r.doc_id: r.score for r in toxicity.score(docs, scorer).select("doc_id", "score").collect()}
    held = [(score[i] >= 0.5, y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(p == bool(y) for p, y in held) >= 0.97 * len(held)


def test_odd_texts(spark, scored):
    scorer, _, _ = scored
    texts = [None, "", " !? ", "the an ti " * 5000, "vulgo", "vulgo", "ti" * 30_000, "日本語"]
    got = toxicity.score(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string"), scorer)
    score = [r.score for r in sorted(got.collect(), key=lambda r: r.doc_id)]
    assert all(0 <= s <= 1 for s in score)
    assert score[0] == score[1] == score[2] < 0.5 < score[4] == score[5]
    assert score[3] < 0.5


def test_the_model_is_a_distribution():
    grams = {g: (n, 2 * n) for n, w in enumerate(["anti", "then", "tiran"], 1) for g in toxicity._grams(w)}
    model = toxicity.Model(list(grams), [t for t, _ in grams.values()], [o for _, o in grams.values()])
    letters = {g[-1] for g in grams}
    for context in list(model.below):
        total = sum(model._shared(context + c) for c in letters)
        assert 0.5 < total <= 1 + 1e-9


def test_no_sequence_is_cut(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "MOST_ENTRIES", 50, raising=False)
    monkeypatch.setattr(toxicity, "CHUNK_CHARS", 5_000, raising=False)
    rows = _texts(200, 6)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(-1, None), (-1, ""), (-2, "été 日本 qqq")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    scorer = toxicity.fit(toxicity.training_rows(docs, labels))
    counts = {}
    for i, text, toxic in rows:
        if zlib.crc32(str(i).encode()) % 5:
            for gram in (g for w in toxicity._words(text) for g in toxicity._grams(w)):
                counts.setdefault(gram, [0, 0])[toxic] += 1
    model = toxicity.Model(list(counts), [c[1] for c in counts.values()], [c[0] for c in counts.values()])
    assert len(scorer.value[0].own) == len(counts) > 50
    _, centre, scale, weights = scorer.value
    for row in toxicity.score(docs, scorer).collect():
        z = sum((f - c) / s * w for f, c, s, w in zip(model.features(row.text), centre, scale, weights)) + weights[-1]
        assert row.score == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-9)


@pytest.mark.parametrize("folds", [(1, 2, 3), (2,)])
def test_toxic_labels_outside_the_usual_fold(spark, folds):
    rows = _texts(1000, 7)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    fold = {i: zlib.crc32(str(i).encode()) % 5 for i, _, _ in rows}
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if not y or fold[i] in folds], "doc_id long, toxic int")
    scorer = toxicity.fit(toxicity.training_rows(docs, labels))
    score = {r.doc_id: r.score for r in toxicity.score(docs, scorer).collect()}
    held = [(score[i] >= 0.5, y) for i, _, y in rows if fold[i] == 0]
    right = sum(p and y for p, y in held)
    assert right >= 0.8 * sum(y for _, y in held) and right >= 0.8 * sum(p for p, _ in held)


def test_no_labels_and_no_documents(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    scorer = toxicity.fit(toxicity.training_rows(docs, none))
    assert [r.score for r in toxicity.score(docs, scorer).collect()] == [0.0]
    assert toxicity.score(docs.limit(0), scorer).count() == 0


def test_query_over_the_given_tables(spark):
    got = op8_toxicity(spark, DIR).toPandas()
    labels = spark.read.parquet(f"{DIR}/labels.parquet").toPandas()
    assert len(got) == 1000 and got["held_out"].sum() == sum(zlib.crc32(str(i).encode()) % 5 == 0 for i in got["doc_id"])
    both = got[got["held_out"]].merge(labels, on="doc_id")
    assert (both["predicted"] == both["toxic"]).mean() > 0.85


def test_toxic_rows_of_the_given_tables_are_found(spark):
    """Predicting no toxic row at all would be right for nine rows in ten, so both kinds of error are counted."""
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet").toPandas()
    got = op8_toxicity(spark, folder).where("held_out").toPandas().merge(labels, on="doc_id")
    toxic, called = got["toxic"] == 1, got["predicted"] == 1
    assert toxic.sum() > 50
    assert (toxic & called).sum() / toxic.sum() > 0.6 and (toxic & called).sum() / called.sum() > 0.8


def test_what_is_staged_goes_and_chunks_move_once(spark, scored):
    scorer, rows, docs = scored
    folder = Path(shared_dir(spark).removeprefix("file:"))
    before = set(folder.iterdir())
    toxicity.fit(docs.join(spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"), "doc_id").select(
        "doc_id", "text", "toxic", (docs.doc_id % 4).cast("int").alias("fold")))
    assert [p.name.rsplit("-", 1)[0] for p in set(folder.iterdir()) - before] == ["provenant-toxicity-counts"]
    plan = toxicity.score(docs, scorer)._jdf.queryExecution().executedPlan().toString()
    cogroup = plan[plan.index("FlatMapCoGroupsInArrow"):].splitlines()
    first = next(line for line in cogroup[1:] if "Exchange" in line or "Scan" in line)
    assert "FileScan parquet" in first and "Bucketed: true" in first


def test_numbers_of_words_come_back():
    for numbers in ([], [0], [3, 70_000, 2**31 - 1, 5]):
        x = np.array(numbers, np.int32)
        assert toxicity._unsqueezed(toxicity._squeezed(x), len(x)).tolist() == numbers
