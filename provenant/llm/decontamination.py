"""Benchmark passages in documents, found by spaced-seed hashing and verified with substitutions.

A document and a benchmark item overlap where ``WINDOW`` words in a row of each stand on one diagonal
and at least ``MATCHES`` of them are equal. An item of fewer words must occur whole and unchanged.

Each of the fixed ``MASKS`` hashes some of the words of a window and ignores the others. The three together
find every overlap: whichever two of thirteen words differ, some mask at some shift avoids both (a test
goes through all of them). Short items are looked up by the hash of all their words.

A bit table of the benchmark's hashes, of fixed size however large the benchmark is, clears almost all
positions of the documents while they are scanned. What is left is joined with the hashes themselves,
and only the words around hits travel to be verified, once for each stretch of hits.

Defined results: words are runs of characters other than white space, A to Z in lower case. Null and
empty texts overlap nothing. Repeated rows give one result row; rows without id are found too, with
a null id. Repeated items each give their rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenant.llm.common import BITS, bit_table, staged
from provenant.llm.words import mix, run_hashes, word_hashes

WINDOW, MATCHES = 13, 11
MASKS = ((0, 1, 2, 4, 6, 8, 9), (0, 3, 5, 6, 8, 9, 10), (0, 1, 2, 3, 6, 7, 8))
#: Hits closer than this are verified as one stretch.
JOINED = 64


def seeds(words: np.ndarray, lengths: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(positions, hashes) of every mask, and of the whole runs of the given lengths."""
    out = []
    for k, offsets in enumerate([*MASKS, *(range(n) for n in lengths)]):
        hashes = run_hashes(words, list(offsets))
        out.append((np.arange(len(hashes)), mix(hashes + np.uint64(1 + (k if k < len(MASKS) else 100 + len(offsets))))))
    return out


def _bytes(words: np.ndarray) -> bytes:
    return words.astype("<u8").tobytes()


def index(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """One row per item: its id, its words as bytes, its number of words and its seeds."""
    def task(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            rows = []
            for item, text in zip(frame.column(0).to_pylist(), frame.column(1).to_pylist(), strict=True):
                words = word_hashes(text)
                n = len(words)
                if not n:
                    continue
                found = seeds(words, [])[: len(MASKS)] if n >= WINDOW else [seeds(words, [n])[-1]]
                rows.append({"item": item, "item_words": _bytes(words), "n_words": n, "seeds": [
                    {"at": int(p), "seed": int(h)} for at, hashes in found
                    for p, h in zip(at, hashes.view(np.int64), strict=True)]})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([
                ("item", pa.int64()), ("item_words", pa.binary()), ("n_words", pa.int32()),
                ("seeds", pa.list_(pa.struct([("at", pa.int32()), ("seed", pa.int64())])))]))

    return items.select(F.col(id_col).cast("long"), text_col).mapInArrow(
        task, "item long, item_words binary, n_words int, seeds array<struct<at:int,seed:long>>")


def _stretches(positions: np.ndarray, n: int) -> Iterator[tuple[int, int, np.ndarray]]:
    cuts = np.flatnonzero(np.diff(positions) > JOINED) + 1
    for part in np.split(np.arange(len(positions)), cuts):
        first, last = int(positions[part[0]]), int(positions[part[-1]])
        yield max(0, first - WINDOW), min(n, last + 2 * WINDOW), part


def _suspects(docs: DataFrame, table, lengths: list[int], id_col: str, text_col: str) -> DataFrame:
    """Stretches of words around seeds that may belong to the benchmark, with those seeds."""
    def task(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = table.value
        for frame in frames:
            rows = []
            for doc_id, text in zip(frame.column(0).to_pylist(), frame.column(1).to_pylist(), strict=True):
                words = word_hashes(text)
                at, got = [], []
                for positions, hashes in seeds(words, lengths):
                    maybe = bits[hashes & np.uint64(BITS - 1)]
                    at.append(positions[maybe]), got.append(hashes[maybe].view(np.int64))
                at, got = np.concatenate(at), np.concatenate(got)
                if not len(at):
                    continue
                order = np.argsort(at, kind="stable")
                at, got = at[order], got[order]
                for start, end, part in _stretches(at, len(words)):
                    rows.append({"doc_id": doc_id, "start": start, "words": _bytes(words[start:end]), "hits": [
                        {"at": a - start, "seed": s}
                        for a, s in zip(at[part].tolist(), got[part].tolist(), strict=True)]})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([
                ("doc_id", pa.int64()), ("start", pa.int32()), ("words", pa.binary()),
                ("hits", pa.list_(pa.struct([("at", pa.int32()), ("seed", pa.int64())])))]))

    rows = docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(
        task, "doc_id long, start int, words binary, hits array<struct<at:int,seed:long>>")
    return rows.withColumn("stretch", F.xxhash64("doc_id", "start", "words"))


def overlap(words: np.ndarray, item: np.ndarray, diagonals: list[int]) -> tuple[int, int, int] | None:
    """First and end position in ``words`` and equal words of the longest overlap, if there is one."""
    best = None
    need = WINDOW if len(item) >= WINDOW else len(item)
    least = MATCHES if len(item) >= WINDOW else need
    for diagonal in diagonals:
        first, end = max(0, diagonal), min(len(words), diagonal + len(item))
        if end - first < need:
            continue
        same = words[first:end] == item[first - diagonal : end - diagonal]
        sums = np.concatenate([[0], np.cumsum(same)])
        good = np.flatnonzero(sums[need:] - sums[:-need] >= least)
        if not len(good):
            continue
        # The longest run of good windows that touch each other.
        runs = np.split(good, np.flatnonzero(np.diff(good) > need) + 1)
        run = max(runs, key=lambda r: r[-1] - r[0])
        a, b = int(run[0]), int(run[-1]) + need
        found = (first + a, first + b, int(sums[b] - sums[a]))
        if best is None or (found[2], -found[0]) > (best[2], -best[0]):
            best = found
    return best


def overlaps(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, item_id, first_word, n_words, n_equal): the longest overlap of each such pair."""
    spark = docs.sparkSession
    indexed = staged(index(items), "benchmark-index")
    lengths = sorted(r[0] for r in indexed.where(F.col("n_words") < WINDOW).select("n_words").distinct().collect())
    table = spark.sparkContext.broadcast(bit_table(indexed.select(F.explode("seeds.seed"))))
    suspects = staged(_suspects(docs, table, lengths, id_col, text_col).dropDuplicates(["stretch"]), "suspects")

    hits = suspects.select("stretch", F.explode("hits").alias("h")).select("stretch", "h.at", "h.seed")
    known = indexed.select("item", F.explode("seeds").alias("s")).select(
        "item", F.col("s.at").alias("item_at"), F.col("s.seed").alias("seed"))
    pairs = hits.join(known, "seed").select("stretch", "item", (F.col("at") - F.col("item_at")).alias("d"))
    # At most as many diagonals as the stretch and the item have words together.
    diagonals = pairs.groupBy("stretch", "item").agg(F.collect_set("d").alias("diagonals"))
    whole = diagonals.join(suspects.select("stretch", "doc_id", "start", "words"), "stretch").join(
        indexed.select(F.col("item").alias("i"), "item_words").dropDuplicates(), F.col("item").eqNullSafe(F.col("i")))

    def verify(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            rows = []
            for r in frame.to_pylist():
                words, item = np.frombuffer(r["words"], "<u8"), np.frombuffer(r["item_words"], "<u8")
                if found := overlap(words, item, sorted(r["diagonals"])):
                    rows.append({"doc_id": r["doc_id"], "item_id": r["item"], "first_word": r["start"] + found[0],
                                 "n_words": found[1] - found[0], "n_equal": found[2]})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([
                ("doc_id", pa.int64()), ("item_id", pa.int64()), ("first_word", pa.int32()),
                ("n_words", pa.int32()), ("n_equal", pa.int32())]))

    verified = whole.select("doc_id", "start", "words", "item", "item_words", "diagonals").mapInArrow(
        verify, "doc_id long, item_id long, first_word int, n_words int, n_equal int")
    longest = F.max(F.struct("n_equal", -F.col("first_word"), "n_words"))
    return verified.groupBy("doc_id", "item_id").agg(longest.alias("m")).select(
        "doc_id", "item_id", (-F.col("m.col2")).alias("first_word"), "m.n_words", "m.n_equal")


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents without any overlap, with all their columns; rows without an id stay."""
    found = staged(overlaps(docs, items).where("doc_id is not null").select("doc_id").distinct(), "contaminated")
    return docs.join(found, "doc_id", "left_anti").select([F.col(f"`{c}`") for c in docs.columns])
