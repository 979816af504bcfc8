"""Toxicity from class-conditional Kneser-Ney models.

A text is read as words, a word as characters between two edges. For each class an interpolated
Kneser-Ney model of order ``ORDER`` predicts every character from those before it in its word. Both
classes discount their own highest-order counts and share the backoff: below the class's own counts stands one
model of continuation counts from all training texts, so an expression that is rare in a class
gets the same mass from both, and only what one class shows more often than the other counts.

The score compares length-normalised log-likelihoods of the two classes over the whole text and over the
spans of ``SPANS`` words where toxic leads most, and a logistic function fitted on training texts which had
not given counts yet turns these into 0 to 1.

Counts are gathered by Spark over all training rows and stay one of its tables, with every sequence: contexts,
continuation counts and the leads of the sequences that occur in the texts are joined in Spark. Texts are scored in
chunks, each with the leads of its own sequences only, so what a task holds does not grow with the table and the
driver holds no counts. The logistic function is fitted on about ``CALIBRATION_ROWS`` rows at most, chosen by a
hash of id and text in each class and weighted so that the classes keep their shares.

Defined results: null, empty and wordless texts get the score of a text without evidence. Repeated rows
each get a row. Rows of the labels that are null or name no document teach nothing; a document labelled
twice counts twice. With labels of one class only, or none, every score is 0. Other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from provenant.llm.common import dealt, fold_of, scratch, staged

ORDER = 5
SPANS = (1, 3, 12)
#: Characters of text after which a chunk is closed.
CHUNK_CHARS = 32_000_000
CALIBRATION_ROWS = 20_000
REMEMBERED = 200_000
FLOOR = 1.0 / 2**16
DISCOUNT = 0.75
EDGE = "\x02"
WORD = regex.compile(r"[\p{L}\p{M}\p{N}]+")


def _words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def _grams(word: str) -> list[str]:
    """The sequences that end at each character of a word, the longest one first seen at its start."""
    w = EDGE + word + EDGE
    return [w[max(0, i - ORDER + 1) : i + 1] for i in range(1, len(w))]


def count_sequences(texts: DataFrame) -> DataFrame:
    """Rows (gram, toxic, ordinary): how often each sequence occurs in either class."""
    def task(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            words: dict[str, list[int]] = {}
            for text, toxic in zip(frame.column(0).to_pylist(), frame.column(1).to_pylist(), strict=True):
                for word in _words(text):
                    if (seen := words.get(word)) is None:
                        words[word] = seen = [0, 0]
                    seen[toxic] += 1
            counts: dict[str, list[int]] = {}
            for word, (ordinary, toxic) in words.items():
                for gram in _grams(word):
                    if (seen := counts.get(gram)) is None:
                        counts[gram] = seen = [0, 0]
                    seen[0] += ordinary
                    seen[1] += toxic
            yield pa.RecordBatch.from_arrays(
                [pa.array(counts.keys(), pa.string()), pa.array([c[1] for c in counts.values()], pa.int64()),
                 pa.array([c[0] for c in counts.values()], pa.int64())], ["gram", "toxic", "ordinary"])

    rows = texts.select("text", F.col("toxic").cast("int")).mapInArrow(
        task, "gram string, toxic long, ordinary long")
    return rows.groupBy("gram").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))


def _features(leads: np.ndarray) -> list[float]:
    n = len(leads)
    if not n:
        return [0.0] * (1 + len(SPANS))
    sums = np.concatenate([[0.0], np.cumsum(leads)])
    best = [float((sums[k:] - sums[:-k]).max() / k) for k in (min(s, n) for s in SPANS)]
    return [float(sums[-1] / n), *best]


class Model:
    """Two Kneser-Ney models over one table of counts, with a memory of words already scored.

    The plain form of the model, for tables that one process can hold; the jobs use ``leads_of``.
    """

    def __init__(self, grams: list[str], toxic: np.ndarray, ordinary: np.ndarray):
        own = {g: (int(t), int(o)) for g, t, o in zip(grams, toxic, ordinary, strict=True)}
        self.own = own
        # Contexts of the highest order: mass and number of different continuations, by class.
        self.contexts: dict[str, list[int]] = {}
        for gram, counts in own.items():
            seen = self.contexts.setdefault(gram[:-1], [0, 0, 0, 0])
            for c in (0, 1):
                seen[c] += counts[c]
                seen[2 + c] += counts[c] > 0
        # Shared lower orders: in how many different ways a sequence was continued to the left.
        self.lower: dict[str, int] = {}
        by_length: list[set[str]] = [set() for _ in range(ORDER + 1)]
        for gram in own:
            by_length[len(gram)].add(gram)
        for length in range(ORDER, 1, -1):
            for gram in by_length[length]:
                self.lower[gram[1:]] = self.lower.get(gram[1:], 0) + 1
                by_length[length - 1].add(gram[1:])
        self.below: dict[str, list[int]] = {}
        for gram, n in self.lower.items():
            seen = self.below.setdefault(gram[:-1], [0, 0])
            seen[0] += n
            seen[1] += 1
        self.own_leads: dict[str, float] = {}
        self.floor = FLOOR
        self.young: dict[str, float] = {}
        self.old: dict[str, float] = {}

    def _shared(self, gram: str) -> float:
        """Probability of the last character by continuation counts, the same for both classes."""
        p = self.floor
        for start in range(len(gram) - 1, -1, -1):
            tail = gram[start:]
            if below := self.below.get(tail[:-1]):
                total, kinds = below
                p = (max(self.lower.get(tail, 0) - DISCOUNT, 0.0) + DISCOUNT * kinds * p) / total
        return p

    def _lead(self, gram: str) -> float:
        """Log-probability of the last character in toxic texts less that in ordinary ones."""
        if (context := self.contexts.get(gram[:-1])) is None:
            return 0.0
        shared, counts, logs = self._shared(gram[1:]), self.own.get(gram, (0, 0)), [0.0, 0.0]
        for c in (0, 1):
            total, kinds = context[c], context[2 + c]
            p = (max(counts[c] - DISCOUNT, 0.0) + DISCOUNT * kinds * shared) / total if total else shared
            logs[c] = math.log(max(p, 1e-12))
        return logs[0] - logs[1]

    def _word(self, word: str) -> float:
        total, known = 0.0, self.own_leads
        for gram in _grams(word):
            if (lead := known.get(gram)) is None:
                lead = self._lead(gram)
                if gram in self.own:
                    known[gram] = lead
            total += lead
        return total

    def leads(self, text: str | None) -> np.ndarray:
        words = _words(text)
        get = self.young.get
        got = [get(w) for w in words]
        if None in got:
            if len(self.young) > REMEMBERED:
                self.old, self.young = self.young, {}
            for w in {w for w, x in zip(words, got, strict=True) if x is None}:
                known = self.old.get(w)
                self.young[w] = self._word(w) if known is None else known
            get, old = self.young.get, self.old.get
            got = [x if (x := get(w)) is not None else old(w) for w in words]
        return np.array(got, np.float64)

    def features(self, text: str | None) -> list[float]:
        """Length-normalised leads: of the whole text, then of the best span of each length."""
        return _features(self.leads(text))


def _logistic(features: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centre, scale and weights (constant last) of a ridge-penalised logistic regression; every row stands for ``weight`` rows."""
    centre = np.average(features, axis=0, weights=weight)
    scale = np.sqrt(np.average((features - centre) ** 2, axis=0, weights=weight)) + 1e-9
    x = np.hstack([(features - centre) / scale, np.ones((len(features), 1))])
    weights, ridge = np.zeros(x.shape[1]), np.diag([1e-2] * (x.shape[1] - 1) + [1e-9])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge + 1e-9 * np.eye(len(weights)),
                               x.T @ (weight * (toxic - p)) - ridge @ weights)
        weights = weights + np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-6:
            break
    return centre, scale, weights


def _shared_of(counts: DataFrame, grams: DataFrame) -> DataFrame:
    """Rows (tail, p): ``Model._shared`` of every sequence without its first character."""
    def tails(text: str) -> Column:
        return F.expr(f"explode(transform(sequence(1, length({text})), i -> substring({text}, i))) as tail")

    # A sequence and each of its tails count once as a way in which what follows their first character went on.
    kinds = counts.select(tails("gram")).where("length(tail) > 1").distinct()
    asked = grams.select(F.expr("substring(gram, 2)").alias("tail")).distinct().select(tails("tail")).distinct()
    lower = kinds.select(F.expr("substring(tail, 2)").alias("tail"), F.lit(1).alias("n"), F.lit(0).alias("asked")).unionByName(
        asked.select("tail", F.lit(0).alias("n"), F.lit(1).alias("asked"))).groupBy("tail").agg(
        F.sum("n").alias("n"), F.max("asked").alias("asked"))
    context = Window.partitionBy(F.expr("substring(tail, 1, length(tail) - 1)"))
    terms = lower.withColumns({"total": F.sum("n").over(context), "kinds": F.sum(F.expr("int(n > 0)")).over(context)})
    terms = staged(terms.where("asked = 1").select(
        "tail", F.expr(f"if(total > 0, greatest(n - {DISCOUNT}d, 0d) / total, 0d)").alias("own"),
        F.expr(f"if(total > 0, {DISCOUNT}d * kinds / total, 1d)").alias("passed")), "toxicity-shared")
    level = terms.where("length(tail) = 1").select("tail", (F.col("own") + F.col("passed") * F.lit(FLOOR)).alias("p"))
    levels = [level]
    for length in range(2, ORDER):
        shorter = level.select(F.col("tail").alias("rest"), F.col("p").alias("below"))
        level = terms.where(F.length("tail") == length).join(shorter, F.expr("substring(tail, 2)") == F.col("rest")).select(
            "tail", (F.col("own") + F.col("passed") * F.col("below")).alias("p"))
        levels.append(level)
    return reduce(DataFrame.unionByName, levels)


def leads_of(counts: DataFrame, grams: DataFrame) -> DataFrame:
    """Rows (gram, lead): ``Model._lead`` over all counts, of every sequence of the column ``gram``, which has no repeats.

    Every key joined or gathered by has at most as many rows as there are characters.
    """
    rows = counts.select("gram", "toxic", "ordinary", F.lit(0).alias("asked")).unionByName(
        grams.selectExpr("gram", "0l as toxic", "0l as ordinary", "1 as asked")).groupBy("gram").agg(
        *(F.sum(c).alias(c) for c in ("toxic", "ordinary")), F.max("asked").alias("asked"))
    context = Window.partitionBy(F.expr("substring(gram, 1, length(gram) - 1)"))
    rows = rows.withColumns({f"{c}_{k}": F.sum(F.expr(e)).over(context) for c in ("toxic", "ordinary")
                             for k, e in (("total", c), ("kinds", f"int({c} > 0)"))}).where("asked = 1")
    rows = rows.join(_shared_of(counts, grams), F.expr("substring(gram, 2)") == F.col("tail"))
    toxic, ordinary = (F.expr(
        f"ln(greatest(if({c}_total > 0, (greatest({c} - {DISCOUNT}d, 0d) + {DISCOUNT}d * {c}_kinds * p) / {c}_total, p), 1e-12d))")
        for c in ("toxic", "ordinary"))
    return rows.select("gram", F.when(F.expr("toxic_total + ordinary_total > 0"), toxic - ordinary).otherwise(0.0).alias("lead"))


PACKED = "chunk long, rows binary, numbers binary, words binary, grams array<string>"


def _squeezed(numbers: np.ndarray) -> bytes:
    """Numbers of words by planes, first all lowest bytes: high planes are almost constant and take next to no room."""
    planes = np.ascontiguousarray(numbers.astype("<i4").view(np.uint8).reshape(-1, 4).T)
    return b"" if not len(numbers) else pa.Codec("zstd", 6).compress(planes.tobytes(), asbytes=True)


def _unsqueezed(packed: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.int32)
    planes = np.frombuffer(pa.Codec("zstd").decompress(packed, 4 * n, asbytes=True), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<i4").ravel()


def _pack(docs: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    """Chunks of documents: batches of rows with their texts as numbers of words, then the chunk's words and sequences."""
    def task(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("chunk", pa.int64()), ("rows", pa.binary()), ("numbers", pa.binary()), ("words", pa.binary()), ("grams", pa.list_(pa.string()))])
        chunk, size, numbers = TaskContext.get().partitionId() << 32, 0, {}

        def closed() -> pa.RecordBatch:
            grams = {g for word in numbers for g in _grams(word)}
            words = zlib.compress("\n".join(numbers).encode(), 1)
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((chunk, None, None, words, list(grams)), schema)], schema=schema)

        for frame in frames:
            texts = frame.column(0).to_pylist()
            found = [[numbers.setdefault(w, len(numbers)) for w in _words(t)] for t in texts]
            rows = pa.RecordBatch.from_arrays([*frame.columns[1:], pa.array(map(len, found), pa.int32())], [*keep, "_words"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_batch(rows)
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(
                (chunk, sink.getvalue().to_pybytes(), _squeezed(np.fromiter(chain.from_iterable(found), np.int32)), None, None), schema)],
                schema=schema)
            size += sum(len(t) for t in texts if t)
            if size >= CHUNK_CHARS:
                yield closed()
                chunk, size, numbers = chunk + 1, 0, {}
        if size or numbers:
            yield closed()

    # The text stands first; it may be among the kept columns too.
    return docs.select(F.col(text_col).alias("_text"), *keep).mapInArrow(task, PACKED)


def featured(docs: DataFrame, counts: DataFrame, text_col: str, keep: list[str], out_col: str, out_type: T.DataType, finish) -> DataFrame:
    """The kept columns of every document and ``finish`` of its features by the model of all counts."""
    packed = dealt(_pack(docs, text_col, keep), "toxicity-chunks", "chunk")
    uses = packed.where("grams is not null").select("chunk", F.explode("grams").alias("gram"))
    leads = leads_of(counts, staged(uses.select("gram").distinct(), "toxicity-sequences"))
    leads = uses.join(leads, "gram").select(F.col("chunk").alias("of"), "gram", "lead")
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField(out_col, out_type)])

    def scored(chunk: pa.Table, known: pa.Table) -> pa.Table:
        lead = dict(zip(known.column("gram").to_pylist(), known.column("lead").to_pylist(), strict=True))
        del known
        words = "".join(zlib.decompress(w).decode() for w in chunk.column("words").to_pylist() if w).split()
        of = np.array([sum([lead[g] for g in _grams(w)]) for w in words], np.float64)
        parts = []
        batches = chunk.select(["rows", "numbers"]).filter(pc.is_valid(chunk.column("rows")))
        for packed_rows, numbers in zip(*batches.columns, strict=True):
            rows = pa.ipc.open_stream(packed_rows.as_buffer()).read_all().combine_chunks()
            ends = np.concatenate([[0], np.cumsum(rows.column("_words").to_numpy())]).astype(np.int64)
            flat = _unsqueezed(numbers.as_py(), int(ends[-1]))
            out = finish([_features(of[flat[a:b]]) for a, b in zip(ends[:-1], ends[1:], strict=True)])
            parts.append(rows.drop_columns(["_words"]).append_column(out_col, out))
        return pa.concat_tables(parts)

    return packed.select("chunk", "rows", "numbers", "words").groupBy("chunk").cogroup(leads.groupBy("of")).applyInArrow(scored, schema)


@dataclass
class Scorer:
    """All counts as a table of Spark, and the logistic function; without counts, every score is 0."""

    counts: DataFrame | None
    logistic: tuple[np.ndarray, np.ndarray, np.ndarray] | None

    @property
    def value(self):
        """The model in one process and the logistic function, for small tables."""
        if self.counts is None:
            return None
        rows = self.counts.toPandas()
        return (Model(rows["gram"].tolist(), rows["toxic"].to_numpy(), rows["ordinary"].to_numpy()), *self.logistic)


def _calibrating(sizes: dict[tuple[int, int], int]) -> int | None:
    """The last fold with both classes inside and outside it, by (fold, class) sizes; None if there is none."""
    def both(inside) -> bool:
        return {c for f, c in sizes if inside(f)} == {0, 1}

    return next((k for k in (3, 2, 1, 0) if both(lambda f: f == k) and both(lambda f: f != k)), None)  # noqa: B023


def fit(labelled: DataFrame) -> Scorer:
    """A scorer from rows (doc_id, text, toxic, fold), with folds 0 to 3.

    Fold 3 calibrates, or the next lower one with both classes in it and in the others. Labels too rare for that
    calibrate on the rows which also gave the counts.
    """
    with scratch(labelled.sparkSession):
        return _fit(labelled)


def _fit(labelled: DataFrame) -> Scorer:
    labelled = staged(labelled, "toxicity-rows")
    sizes = {(r["fold"], r["toxic"]): r["count"] for r in labelled.groupBy("fold", F.col("toxic").cast("int").alias("toxic")).count().collect()}
    if {c for _, c in sizes} != {0, 1}:
        return Scorer(None, None)
    fold = _calibrating(sizes)
    rest = labelled if fold is None else labelled.where(F.col("fold") == fold)
    counts = staged(count_sequences(labelled if fold is None else labelled.where(F.col("fold") != fold)), "toxicity-counts")
    n = [sum(x for (f, c), x in sizes.items() if c == k and fold in (None, f)) for k in (0, 1)]
    # Half of the rows for each class, and what one class leaves for the other.
    bound = [max(CALIBRATION_ROWS // 2, CALIBRATION_ROWS - n[1 - k]) for k in (0, 1)]
    kept = [int(min(1.0, bound[k] / n[k]) * (1 << 20)) for k in (0, 1)]
    chosen = rest.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) < F.when(F.col("toxic") == 1, kept[1]).otherwise(kept[0]))
    rows = featured(chosen, counts, "text", ["toxic"], "f", T.ArrayType(T.DoubleType()),
                    lambda f: pa.array(f, pa.list_(pa.float64()))).toPandas()
    toxic = rows["toxic"].to_numpy(np.int64)
    # A row stands for as many of its class as there are for each one chosen.
    weight = np.array(n, np.float64)[toxic] / np.bincount(toxic, minlength=2)[toxic]
    logistic = _logistic(np.array(rows["f"].tolist()), toxic.astype(np.float64), weight)
    if fold is None:
        return Scorer(staged(counts, "toxicity-counts", keep=True), logistic)
    # The final model has the counts of the calibration rows too.
    more = counts.unionByName(count_sequences(rest)).groupBy("gram").agg(
        F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))
    return Scorer(staged(more, "toxicity-counts", keep=True), logistic)


def score(docs: DataFrame, scorer: Scorer, text_col: str = "text", out_col: str = "score", keep: list[str] | None = None) -> DataFrame:
    """The documents, or their columns ``keep``, with a column ``out_col``, in place of one of that name."""
    columns = docs.columns if keep is None else keep
    kept = [c for c in columns if c != out_col]
    wanted = [F.col(f"`{c}`") for c in (columns if out_col in columns else [*kept, out_col])]
    if scorer.counts is None:
        return docs.select(*[F.col(f"`{c}`") for c in kept], F.lit(0.0).alias(out_col)).select(wanted)
    centre, scale, weights = scorer.logistic

    def finish(features: list[list[float]]) -> pa.Array:
        x = np.array(features, np.float64).reshape(len(features), -1)
        return pa.array(1 / (1 + np.exp(-np.clip(((x - centre) / scale) @ weights[:-1] + weights[-1], -30, 30))), pa.float64())

    # Kept columns travel under numbers, so that no name can clash with those of the job.
    numbered = docs.select(F.col(f"`{text_col}`").alias("text"), *[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(kept)])
    scored = featured(numbered, scorer.counts, "text", [f"c{k}" for k in range(len(kept))], "out", T.DoubleType(), finish)
    return scored.toDF(*kept, out_col).select(wanted)


def training_rows(docs: DataFrame, labels: DataFrame, held_out: int = 0) -> DataFrame:
    """Labelled documents outside the held-out fold: id, text, toxic and fold, where folds 0 to 3 remain.

    The labels grow with the documents, so the join is a shuffle at every size.
    """
    remainder = fold_of("doc_id")
    marked = labels.where("doc_id is not null and toxic in (0, 1)").select("doc_id", "toxic")
    return (
        docs.select("doc_id", "text").where(remainder != held_out).join(marked.hint("merge"), "doc_id")
        .select("doc_id", "text", "toxic", F.pmod(remainder + (4 - held_out), F.lit(5)).cast("int").alias("fold"))
    )
