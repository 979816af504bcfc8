"""Language of texts with mixed languages: spans found by Viterbi over per-word scores.

Words are runs of letters. The script of a word narrows the candidates to the languages that use this
script in the training texts. A word's score in a language is the log-probability of its sequences of two to ``ORDER + 1``
bytes, hashed into ``BUCKETS`` buckets, with additive smoothing; the sequences of all new words of a batch are hashed and
scored together, as arrays. A switch of language between two words costs ``SWITCH``; Viterbi finds the labelling of all words with the highest
total. The language of most letters in it is the prediction, and the score is its share of the letters times
the mean confidence of the words.

The model is a table of languages times buckets, summed by Spark over all training rows; its size
is fixed but for the number of languages, of which more than ``MOST_LANGUAGES`` are refused.

Defined results: a null text, or one without a letter, is ``und`` with score 0. Ties go to the language that sorts first.
Rows with a null language teach nothing. With no training rows every text is ``und``; an empty table of rows to predict
gives an empty result. Repeated rows each get a row; other columns are ignored. Very long texts and words are read whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenant.llm.bytepieces import LETTERS, PLAIN
from provenant.llm.words import mix

ORDER = 4
BUCKETS = 1 << 15
SWITCH = 12.0
SMOOTHING = 0.5
MOST_LANGUAGES = 500
#: Share of a language's letters from which on a script counts as used in it.
USED = 0.001
#: Words in a worker's memory, and scores of words in it.
REMEMBERED, REMEMBERED_CELLS = 300_000, 20_000_000
UNDETERMINED = "und"
#: Runs of letters and marks that hold a letter. In texts without marks and other scripts, a plain class does.
WORD = regex.compile(r"\p{M}*\p{L}[\p{L}\p{M}]*")
PLAIN_WORD = re.compile(f"[{LETTERS}]+")
#: Cells of the table of sequence scores that are gathered at once.
GATHERED = 1 << 22
#: First code points of blocks of scripts, from the Unicode standard.
SCRIPTS = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0900, "indic"), (0x0E00, "thai"), (0x0E80, "other"), (0x10A0, "georgian"),
    (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"),
    (0x2C60, "latin"), (0x2C80, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"), (0xA000, "other"),
    (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB50, "arabic"), (0xFE00, "other"), (0x20000, "han"),
    (0x30000, "other"),
]
STARTS = np.array([s for s, _ in SCRIPTS])
NAMES = sorted({n for _, n in SCRIPTS})
SCRIPT_OF = [NAMES.index(n) for _, n in SCRIPTS]


def scripts(words: list[str]) -> np.ndarray:
    """The script of the first letter of every word."""
    firsts = np.fromiter((ord(w[0]) for w in words), np.int64, len(words))
    return np.array(SCRIPT_OF)[np.searchsorted(STARTS, firsts, "right") - 1]


def sequences(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all sequences of the words, word by word, and how many each word has.

    A sequence of n bytes, a space before and after the word included, is a number of 8 n bits with n above them.
    """
    data = np.frombuffer((" " + "  ".join(words) + " ").encode() if words else b"", np.uint8).astype(np.uint64)
    lengths = np.fromiter((len(w.encode()) + 2 for w in words), np.int64, len(words))
    ends = np.repeat(np.cumsum(lengths), lengths)
    owner, at = np.repeat(np.arange(len(words)), lengths), np.arange(len(data))
    buckets, owners, packed = [], [], data.copy()
    for n in range(2, ORDER + 2):
        packed = packed[: len(data) - n + 1] | (data[n - 1 :] << np.uint64(8 * (n - 1)))
        whole = (at + n)[: len(packed)] <= ends[: len(packed)]
        buckets.append(mix(packed[whole] | np.uint64(n << 48)) % np.uint64(BUCKETS))
        owners.append(owner[: len(packed)][whole])
    owners = np.concatenate(owners) if words else np.zeros(0, np.int64)
    order = np.argsort(owners, kind="stable")
    return np.concatenate(buckets)[order].astype(np.int64), np.bincount(owners, minlength=len(words))


def _words(text: str | None) -> list[str]:
    lower = text.lower() if text else ""
    return PLAIN_WORD.findall(lower) if lower.isascii() or PLAIN.fullmatch(lower) else WORD.findall(lower)


def count(texts: DataFrame) -> DataFrame:
    """Rows (lang, kind, bucket, n): sequences (kind 0) and letters by script (kind 1) of each language.

    A task holds one table per language that it meets, at most MOST_LANGUAGES.
    """
    def task(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for frame in frames:
            seen: dict[str, Counter[str]] = {}
            for text, lang in zip(frame.column(0).to_pylist(), frame.column(1).to_pylist(), strict=True):
                seen.setdefault(lang, Counter()).update(_words(text))
            for lang, words in seen.items():
                buckets, letters = sums.setdefault(lang, (np.zeros(BUCKETS, np.int64), np.zeros(len(NAMES), np.int64)))
                known, n = list(words), np.fromiter(words.values(), np.int64, len(words))
                found, many = sequences(known)
                buckets += np.bincount(found, np.repeat(n, many), BUCKETS).astype(np.int64)
                size = np.fromiter(map(len, known), np.int64, len(known))
                letters += np.bincount(scripts(known), n * size, len(NAMES)).astype(np.int64)
        for lang, tables in sums.items():
            for kind, counts in enumerate(tables):
                at = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(at), pa.string()), pa.array(np.full(len(at), kind, np.int32)),
                     pa.array(at.astype(np.int32)), pa.array(counts[at])], ["lang", "kind", "bucket", "n"])

    rows = texts.select("text", "lang").mapInArrow(task, "lang string, kind int, bucket int, n long")
    return rows.groupBy("lang", "kind", "bucket").agg(F.sum("n").alias("n"))


class Model:
    def __init__(self, languages: list[str], buckets: np.ndarray, letters: np.ndarray):
        self.languages = languages
        total = buckets.sum(1, keepdims=True)
        self.logs = (np.log(buckets + SMOOTHING) - np.log(total + SMOOTHING * BUCKETS)).T.copy()
        used = letters >= USED * np.maximum(letters.sum(1, keepdims=True), 1)
        # A script that no language uses leaves all of them.
        self.barred = np.where(used | ~used.any(0), 0.0, -1e6).T.copy()
        #: Rows of ``scores`` by word; emptied when full.
        self.rows: dict[str, int] = {}
        self.scores, self.sizes = np.zeros((0, len(languages))), np.zeros(0)

    def learn(self, words: set[str]) -> None:
        """Have a row of scores for every one of the words."""
        if len(self.rows) > min(REMEMBERED, REMEMBERED_CELLS // max(1, len(self.languages))):
            self.rows, self.scores, self.sizes = {}, self.scores[:0], self.sizes[:0]
        new = list(words.difference(self.rows))
        if not new:
            return
        found, many = sequences(new)
        parts, width = [], max(1, GATHERED // max(1, len(self.languages)))
        ends = np.cumsum(many)
        at = 0
        while at < len(new):
            # A part is as many words as fit, or one longer than that.
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + width, "right")))
            first = ends[at - 1] if at else 0
            gathered = self.logs[found[first : ends[stop - 1]]]
            parts.append(np.add.reduceat(gathered, ends[at:stop] - many[at:stop] - first, 0))
            at = stop
        self.rows.update(zip(new, range(len(self.rows), len(self.rows) + len(new))))
        self.scores = np.concatenate([self.scores, np.concatenate(parts) / ORDER + self.barred[scripts(new)]])
        self.sizes = np.concatenate([self.sizes, np.fromiter(map(len, new), np.float64, len(new))])

    def label(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The language number of every word, the scores, and the words' lengths."""
        at = np.fromiter(map(self.rows.__getitem__, words), np.int64, len(words))
        scores = self.scores[at]
        return viterbi(scores, SWITCH), scores, self.sizes[at]

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        found = [_words(text) for text in texts]
        if self.languages:
            self.learn({word for words in found for word in words})
        return [self._best(words) for words in found]

    def _best(self, words: list[str]) -> tuple[str, float]:
        if not words or not self.languages:
            return UNDETERMINED, 0.0
        labels, scores, sizes = self.label(words)
        letters = np.bincount(labels, sizes, len(self.languages))
        best = int(letters.argmax())
        mine = scores[labels == best]
        shares = np.exp(np.minimum(mine - mine.max(1, keepdims=True), 0))
        sure = (shares[:, best] / shares.sum(1)).mean()
        return self.languages[best], float(letters[best] / letters.sum() * sure)

    def spans(self, text: str | None) -> list[tuple[int, int, str]]:
        """(first character, end, language) of the stretches of one language; between words nothing is labelled."""
        found = list(WORD.finditer(text or ""))
        if not found or not self.languages:
            return []
        words = [m[0].lower() for m in found]
        self.learn(set(words))
        labels, _, _ = self.label(words)
        cuts = [0, *(np.flatnonzero(np.diff(labels)) + 1).tolist(), len(found)]
        return [(found[a].start(), found[b - 1].end(), self.languages[labels[a]]) for a, b in zip(cuts, cuts[1:])]


def viterbi(scores: np.ndarray, switch: float) -> np.ndarray:
    """The labels of the path with the highest sum of scores less ``switch`` for every change of label.

    When no other language gains more than one switch over any stretch, compared with the best language of the
    whole text, that language alone is the best path, which running sums tell at once.
    """
    best = int(scores.sum(0).argmax())
    sums = np.cumsum(np.vstack([np.zeros(scores.shape[1]), scores - scores[:, [best]]]), 0)
    if (sums - np.minimum.accumulate(sums, 0)).max() <= switch:
        return np.full(len(scores), best)
    value, back = scores[0].copy(), np.zeros(scores.shape, np.int32)
    same = np.arange(scores.shape[1])
    for k in range(1, len(scores)):
        top = int(value.argmax())
        stay = value >= value[top] - switch
        back[k] = np.where(stay, same, top)
        value = np.where(stay, value, value[top] - switch) + scores[k]
    labels = np.empty(len(scores), np.int64)
    labels[-1] = value.argmax()
    for k in range(len(scores) - 1, 0, -1):
        labels[k - 1] = back[k, labels[k]]
    return labels


def fit(texts: DataFrame):
    """The model from rows (text, lang), as a broadcast variable."""
    taught = texts.where("lang is not null and text is not null")
    found = taught.select("lang").distinct().limit(MOST_LANGUAGES + 1).collect()
    if len(found) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    languages = sorted(row["lang"] for row in found)
    tables = [np.zeros((len(languages), BUCKETS)), np.zeros((len(languages), len(NAMES)))]
    # A row per language and table, of at most BUCKETS counts.
    packed = count(taught).groupBy("lang", "kind").agg(F.collect_list("bucket").alias("buckets"), F.collect_list("n").alias("n"))
    for row in packed.toLocalIterator():
        tables[row["kind"]][languages.index(row["lang"]), row["buckets"]] = row["n"]
    return texts.sparkSession.sparkContext.broadcast(Model(languages, *tables))


def predict(docs: DataFrame, model, text_col: str = "text") -> DataFrame:
    """The documents with columns lang_pred and score, in place of any of these names."""
    @F.pandas_udf("lang string, score double")
    def predicted(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(model.value.predict(list(texts)), columns=["lang", "score"])

    rows = docs.withColumn("lang_pred", predicted(F.col(text_col)))
    return rows.withColumn("score", F.col("lang_pred.score")).withColumn("lang_pred", F.col("lang_pred.lang"))


def label_spans(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, spans): the stretches of one language of every document."""
    @F.pandas_udf("array<struct<start:int,end:int,lang:string>>")
    def labelled(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"start": a, "end": b, "lang": x} for a, b, x in model.value.spans(t)] for t in texts])

    return docs.select(id_col, labelled(F.col(text_col)).alias("spans"))
