import itertools
import math
import unicodedata
import zlib

import numpy as np
import pytest

from provenant.llm import language
from provenant.llm.queries import op6_language

DIR = "/root/testdata/sf0.01"


def test_viterbi_finds_the_best_of_all_paths():
    rng = np.random.default_rng(1)
    for n in (1, 2, 5, 7):
        for _ in range(40):
            scores, switch = rng.normal(0, 3, (n, 3)), rng.uniform(0, 6)
            def value(path):
                return scores[range(n), path].sum() - switch * sum(a != b for a, b in zip(path, path[1:]))
            best = max(value(list(p)) for p in itertools.product(range(3), repeat=n))
            assert value(list(language.viterbi(scores, switch))) == pytest.approx(best)


@pytest.fixture(scope="module")
def model(spark):
    english = ["the quick brown fox and the lazy dog went there with another thing"] * 5
    german = ["der schnelle braune fuchs und der faule hund gingen dorthin mit einem ding"] * 5
    russian = ["быстрая коричневая лиса и ленивая собака пошли туда"] * 5
    rows = [(t, "en") for t in english] + [(t, "de") for t in german] + [(t, "ru") for t in russian] + [(None, "en"), ("x", None)]
    return language.fit(spark.createDataFrame(rows, "text string, lang string"))


def test_spans_of_mixed_texts(model):
    text = "The quick brown fox, and der faule hund mit dem schnelle fuchs; быстрая лиса и собака"
    spans = model.value.spans(text)
    assert [s[2] for s in spans] == ["en", "de", "ru"]
    assert text[spans[2][0] : spans[2][1]] == "быстрая лиса и собака"


def test_odd_texts(spark, model):
    texts = [None, "", "123 !?", "the dog", "the dog", "der hund " * 20_000, "日本", "лиса"]
    docs = spark.createDataFrame([(i, t, 1.0) for i, t in enumerate(texts)], "doc_id long, text string, score double")
    got = {r.doc_id: r for r in language.predict(docs, model).collect()}
    assert [got[i].lang_pred for i in range(8)][:6] == ["und"] * 3 + ["en", "en", "de"] and got[7].lang_pred == "ru"
    assert got[6].lang_pred in ("de", "en", "ru") and all(0 <= r.score <= 1 for r in got.values())
    assert language.predict(docs.limit(0), model).count() == 0
    none = language.fit(docs.limit(0).selectExpr("text", "'x' lang"))
    assert {r.lang_pred for r in language.predict(docs, none).collect()} == {"und"}
    assert {r.doc_id: len(r.spans) for r in language.label_spans(docs, model).collect()}[3] == 1


def test_held_out_documents(spark):
    got = op6_language(spark, DIR).toPandas()
    docs = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "lang").toPandas()
    both = got[got["held_out"]].merge(docs, on="doc_id")
    assert len(got) == len(docs) and all(zlib.crc32(str(i).encode()) % 5 == 0 for i in both["doc_id"])
    assert (both["lang_pred"] == both["lang"]).mean() > 0.97


def _hash(data):
    """The number of a sequence, mixed as the fixed 64-bit function of words.py does, in plain integers."""
    x, mask = int.from_bytes(data, "little") | len(data) << 48, 2**64 - 1
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        x ^= x >> 33
        x = x * factor & mask
    return (x ^ x >> 33) % language.BUCKETS


def _sequences(word):
    w = f" {word} ".encode()
    return [_hash(w[i : i + n]) for n in range(2, language.ORDER + 2) for i in range(len(w) - n + 1)]


def test_sequences_of_many_words_at_once_are_those_of_each():
    words = ["a", "straße", "лиса", "x" * 70, "日本", "of", "é"]
    found, many = language.sequences(words)
    assert many.tolist() == [len(_sequences(w)) for w in words]
    for part, word in zip(np.split(found, np.cumsum(many)[:-1]), words, strict=True):
        assert sorted(part.tolist()) == sorted(_sequences(word))
    assert [len(x) for x in language.sequences([])] == [0, 0]


def test_words_are_the_runs_of_letters_and_marks_that_hold_a_letter():
    texts = ["Don't stop, ÜBER²-Straße!", "é a\u0301b \u0301 x\u0301\u0301 12a", "лиса и собака", "", None, "ÀÇ×÷ÿ ªº"]
    for text in texts:
        plain = "".join(c if unicodedata.category(c)[0] in "LM" else " " for c in (text or "").lower()).split()
        want = [w for w in plain if any(unicodedata.category(c)[0] == "L" for c in w)]
        assert [w for w in language._words(text)] == want


def test_counts_and_predictions_equal_a_plain_recount(spark):
    """Counts by dictionary, scores word by word, and the best path over all words without the shortcut."""
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang").collect()
    taught = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5 and r.lang and r.text]
    counts, letters = {}, {}
    for r in taught:
        for word in language._words(r.text):
            for b in _sequences(word):
                counts[r.lang, b] = counts.get((r.lang, b), 0) + 1
            key = r.lang, int(language.scripts([word])[0])
            letters[key] = letters.get(key, 0) + len(word)
    langs = sorted({r.lang for r in taught})
    totals = {g: sum(n for (x, _), n in counts.items() if x == g) for g in langs}
    sizes = {g: sum(n for (x, _), n in letters.items() if x == g) for g in langs}
    logs = lambda g, b: math.log(counts.get((g, b), 0) + 0.5) - math.log(totals[g] + 0.5 * language.BUCKETS)
    got = {r.doc_id: r for r in op6_language(spark, "/root/testdata/sf0.001").collect()}
    for r in rows[::4]:
        words = language._words(r.text)[:400]
        if not words or len(language._words(r.text)) > 400:
            continue
        value, back, table = None, [], []
        for word in words:
            kind = int(language.scripts([word])[0])
            used = [letters.get((g, kind), 0) >= language.USED * max(1, sizes[g]) for g in langs]
            score = [sum(logs(g, b) for b in _sequences(word)) / language.ORDER - (0 if u or not any(used) else 1e6)
                     for g, u in zip(langs, used, strict=True)]
            table.append(score)
            if value is None:
                value = score
                continue
            top = max(range(len(langs)), key=value.__getitem__)
            stay = [v >= value[top] - language.SWITCH for v in value]
            back.append([k if s else top for k, s in enumerate(stay)])
            value = [(v if s else value[top] - language.SWITCH) + x for v, s, x in zip(value, stay, score, strict=True)]
        labels = [max(range(len(langs)), key=value.__getitem__)]
        for step in reversed(back):
            labels.append(step[labels[-1]])
        labels.reverse()
        share = [sum(len(w) for w, k in zip(words, labels, strict=True) if k == g) for g in range(len(langs))]
        best = max(range(len(langs)), key=share.__getitem__)
        sure = [math.exp(s[best] - max(s)) / sum(math.exp(x - max(s)) for x in s) for s, k in zip(table, labels, strict=True) if k == best]
        assert got[r.doc_id].lang_pred == langs[best]
        assert got[r.doc_id].score == pytest.approx(share[best] / sum(share) * sum(sure) / len(sure), abs=1e-9)


def test_a_full_memory_starts_anew(model, monkeypatch):
    texts = ["the dog", "der hund", "быстрая лиса", "a thing"]
    want = model.value.predict(texts)
    monkeypatch.setattr(language, "REMEMBERED", 2)
    assert [model.value.predict([t])[0] for t in texts] == want
