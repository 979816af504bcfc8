"""Exact n-gram Jaccard join of documents: size-aware, with small sets and large sets found differently.

A document's set holds its distinct shingles of ``SHINGLE`` words (the whole sequence where it has fewer). Two
documents link when ``PERCENT`` of a hundred or more of their union is common.

Small sets. Two sets of a and b elements link when they share ceil(3 (a + b) / 7) of them (for 75 %), so
each small set lists all its subsets of every size that some partner may need, and sets that list the
same subset are candidates.

Large sets. The elements are ordered by rarity; two sets that link share one of the first
n - ceil(0.75 n) + 1, so only these go to inverted lists, and sets on one list are candidates. Small
sets that may link with a large one stand on the lists too. The rarity order comes from document counts
of all shingles in ``BUCKETS`` hash buckets, a table of fixed size; any order gives right results.

The boundary is the size at which the total of subset and list rows, by the histogram of the sizes, is
least.

Only links between different texts matter: exact copies of a set are one node. To lose no link and yet
not compare all pairs of a large group, each set is first compared with one of the smallest members of its lists,
then with one of the largest, and only members that are not connected by then are compared with each other. Every
candidate passes size and position filters and a bound by bit maps of the sets, and is then verified on the whole sets.

Defined results: null, empty and wordless texts have an empty set and link with nothing. A null id gets a
null component and no links. Rows with one id and different texts each stand for that id. Other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenant.llm.common import scratch, staged
from provenant.llm.components import components
from provenant.llm.words import BASE, mix, run_hashes, word_hashes

SHINGLE, PERCENT = 5, 75
BUCKETS = 1 << 18
SLICES = 16
#: The map of a set, whose differences bound the difference of two sets from below, has at least so
#: many bits for each element, a power of two in all. A larger map folds onto a smaller one.
MAP_BITS = 4
#: Words of 64 bits in the parities of a set, which travel with the members of lists that are compared in full.
PARITY_WORDS = 8
#: Largest set for which subsets are considered at all; their number grows fast.
MOST_SMALL = 12
#: Rows that a list entry costs beside itself: it is counted, then joined with its list.
LIST_COST = 3


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """The set, as sorted hashes."""
    words = word_hashes(text)
    if not len(words):
        return words
    n = min(size, len(words))
    return np.unique(run_hashes(words, list(range(n))) + np.uint64(n))


def bit_map(found: np.ndarray) -> bytes:
    bits = 1 << max(8, (MAP_BITS * len(found) - 1).bit_length())
    taken = np.zeros(bits, np.uint8)
    taken[((found >> np.uint64(20)) % np.uint64(bits)).astype(np.int64)] = 1
    return np.packbits(taken).tobytes()


def parities(found: np.ndarray) -> list[int]:
    """By bit, whether an odd number of elements fall on it: the parities of a difference are the difference of the parities."""
    odd = np.bincount(((found >> np.uint64(40)) % np.uint64(64 * PARITY_WORDS)).astype(np.int64), minlength=64 * PARITY_WORDS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


def differing(x: bytes, y: bytes) -> int:
    """Bits in which two maps differ, the larger one folded onto the smaller."""
    a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    n = min(len(a), len(b))
    a, b = (np.bitwise_or.reduce(m.reshape(-1, n)) for m in (a, b))
    return int(np.bitwise_count(a ^ b).sum())


def needed(a: int, b: int) -> int:
    """Common elements with which sets of a and b elements link."""
    return -(-PERCENT * (a + b) // (100 + PERCENT))


def partners(n: int) -> range:
    """Sizes that can link with size n."""
    return range(-(-PERCENT * n // 100), 100 * n // PERCENT + 1)


def prefix_length(n: int) -> int:
    return n - -(-PERCENT * n // 100) + 1


def subset_sizes(n: int) -> list[int]:
    return sorted({needed(n, b) for b in partners(n) if needed(n, b) <= min(n, b)})


def boundary(sizes: dict[int, int]) -> int:
    """The largest size treated as small, at which the number of rows is least."""
    def cost(limit: int) -> int:
        subsets = sum(m * sum(comb(n, k) for k in subset_sizes(n)) for n, m in sizes.items() if n <= limit)
        lists = sum(m * prefix_length(n) for n, m in sizes.items() if 100 * n >= PERCENT * (limit + 1))
        return subsets + LIST_COST * lists

    return min(range(MOST_SMALL + 1), key=cost)


def keys(found: np.ndarray, counts: np.ndarray, small: int) -> tuple[np.ndarray, np.ndarray]:
    """Subsets or list entries of one set, and their places in the order (0 for subsets)."""
    n = len(found)
    out, places = [], []
    if n <= small:
        for k in subset_sizes(n):
            chosen = np.array(list(combinations(found.tolist(), k)), np.uint64)
            out.append(mix(mix(chosen).sum(1, dtype=np.uint64) + np.uint64(k) * BASE))
            places.append(np.zeros(len(chosen), np.int32))
    if 100 * n >= PERCENT * (small + 1):
        rarity = counts[(found & np.uint64(BUCKETS - 1)).astype(np.int64)]
        order = np.lexsort((found, rarity))[: prefix_length(n)]
        out.append(found[order])
        places.append(np.arange(len(order), dtype=np.int32))
    return np.concatenate(out), np.concatenate(places)


def _summaries(docs: DataFrame) -> DataFrame:
    """A row (id, n, sig_a, sig_b, bits, odd) for each document, and rows (slice, counts) of each task."""
    def task(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS, np.int64)
        names = ["id", "n", "sig_a", "sig_b", "bits", "odd", "slice", "counts"]
        for frame in frames:
            sizes, first, second, seen, maps, odd = [], [], [], [], [], []
            for text in frame.column(1).to_pylist():
                found = shingles(text)
                mixed = mix(found + BASE)
                sizes.append(len(found))
                first.append(mixed.sum(dtype=np.uint64))
                second.append(mix(mixed).sum(dtype=np.uint64))
                seen.append((found & np.uint64(BUCKETS - 1)).astype(np.int64))
                maps.append(bit_map(found))
                odd.append(parities(found))
            if seen:
                counts += np.bincount(np.concatenate(seen), minlength=BUCKETS)
            n = len(sizes)
            yield pa.RecordBatch.from_arrays([
                frame.column(0), pa.array(sizes, pa.int32()),
                pa.array(np.array(first, np.uint64).view(np.int64)), pa.array(np.array(second, np.uint64).view(np.int64)),
                pa.array(maps, pa.binary()), pa.array(odd, pa.list_(pa.int64())), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names)
        part = BUCKETS // SLICES
        yield pa.RecordBatch.from_arrays([
            pa.nulls(SLICES, pa.int64()), pa.nulls(SLICES, pa.int32()), pa.nulls(SLICES, pa.int64()),
            pa.nulls(SLICES, pa.int64()), pa.nulls(SLICES, pa.binary()), pa.nulls(SLICES, pa.list_(pa.int64())), pa.array(range(SLICES), pa.int32()),
            pa.array([counts[k * part : (k + 1) * part].tobytes() for k in range(SLICES)], pa.binary())], names)

    return docs.mapInArrow(task, "id long, n int, sig_a long, sig_b long, bits binary, odd array<long>, slice int, counts binary")


def _counts(summaries: DataFrame) -> np.ndarray:
    """Document counts by bucket: a table of fixed size, summed slice by slice."""
    def total(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, np.ndarray] = {}
        for frame in frames:
            for k, raw in zip(frame.column(0).to_pylist(), frame.column(1).to_pylist(), strict=True):
                kept[k] = kept.get(k, 0) + np.frombuffer(raw, np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(kept.keys(), pa.int32()), pa.array([c.tobytes() for c in kept.values()], pa.binary())],
            ["slice", "counts"])

    parts = summaries.where("slice is not null").select("slice", "counts")
    sums = parts.repartition("slice").mapInArrow(total, "slice int, counts binary").collect()
    counts = np.zeros((SLICES, BUCKETS // SLICES), np.int64)
    for row in sums:
        counts[row["slice"]] += np.frombuffer(row["counts"], np.int64)
    return np.minimum(counts.ravel(), 2**31 - 1).astype(np.int32)


def _entries(docs: DataFrame, counts, small: int) -> DataFrame:
    """Rows (key, id, size) of all subsets and list entries; ``size`` holds n and the place in the order.

    Keys have 48 bits: two that fall together make candidates that are not verified.
    """
    def task(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = counts.value
        for frame in frames:
            ids, sizes, found = [], [], []
            for doc_id, text in zip(frame.column(0).to_pylist(), frame.column(1).to_pylist(), strict=True):
                members = shingles(text)
                if len(members):
                    k, p = keys(members, table, small)
                    found.append(k >> np.uint64(16))
                    ids.append(np.full(len(k), doc_id, np.int64))
                    sizes.append((np.int64(len(members)) << 32) + p)
            if found:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(found).view(np.int64)), pa.array(np.concatenate(ids)),
                     pa.array(np.concatenate(sizes))], ["key", "id", "size"])

    return docs.mapInArrow(task, "key long, id long, size long")


def _close(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """The pairs that may link by the maps of their sets, which are a tenth of the size of the texts."""
    def task(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            n, m = frame.column(2).to_numpy(), frame.column(3).to_numpy()
            apart = np.array([differing(x, y) for x, y in zip(frame.column(4).to_pylist(), frame.column(5).to_pylist(), strict=True)],
                             np.int64)
            most = n + m - 2 * -(-PERCENT * (n + m) // (100 + PERCENT))
            yield pa.RecordBatch.from_arrays([frame.column(0), frame.column(1)], ["a", "b"]).filter(pa.array(apart <= most))

    # Rows of one id with different texts are each other's stand-ins here; any of them may link.
    maps = rows.where("id is not null").select("id", F.col("n").cast("long").alias("n"), "bits").distinct()
    left = maps.select(F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("bits").alias("bits_a"))
    right = maps.select(F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("bits").alias("bits_b"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "n_a", "n_b", "bits_a", "bits_b").mapInArrow(
        task, "a long, b long").distinct()


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole sets link. Texts travel, as they are half the size of their hashes."""
    def task(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            keep, made = [], {}
            for left, right in zip(frame.column(2).to_pylist(), frame.column(3).to_pylist(), strict=True):
                if len(made) > 64:
                    made = {}
                for text in (left, right):
                    if text not in made:
                        made[text] = shingles(text)
                x, y = made[left], made[right]
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                common = int((y[at] == x).sum())
                keep.append(100 * common >= PERCENT * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([frame.column(0), frame.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = texts.select(F.col("id").alias("a"), F.col("text").alias("left"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("right"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right").mapInArrow(task, "a long, b long")


def _possible(a: str, b: str):
    """Whether the sizes fit, and the places of the first common element: all before it is not common."""
    n, m, i, j = (F.col(c) for c in (f"{a}.n", f"{b}.n", f"{a}.place", f"{b}.place"))
    return (F.least(n, m) * 100 >= F.greatest(n, m) * PERCENT) & (
        i + j <= n + m - 2 * F.ceil((n + m) * PERCENT / (100 + PERCENT)))


def _near(a: str, b: str):
    """Whether the parities of two sets leave it possible that they link; unlike places, they tell most others apart."""
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    apart = sum(F.bit_count(F.col(f"{a}.odd")[k].bitwiseXOR(F.col(f"{b}.odd")[k])) for k in range(PARITY_WORDS))
    return apart <= n + m - 2 * F.ceil((n + m) * PERCENT / (100 + PERCENT))


def _candidates(entries: DataFrame, parities: DataFrame, labels: DataFrame | None, step: str) -> DataFrame:
    """Pairs on one list whose components differ: all of them, or for each set the one with the first pivot of its lists.

    The pivot of a list is its smallest or largest member, and the first is the smallest or largest again.
    """
    if labels is not None:
        entries = entries.join(labels, "id", "left").withColumn("label", F.coalesce("component", "id")).drop("component")
    else:
        entries = entries.withColumn("label", F.col("id"))
    member = F.struct("id", "n", "place", "label")
    lists = entries.groupBy("key").agg(
        F.min("label").alias("low"), F.max("label").alias("high"),
        (F.max if step == "largest" else F.min)(member).alias("pivot")).where("low < high")
    rows = entries.select("key", member.alias("m")).join(lists.select("key", "pivot"), "key")
    if step != "all":
        pairs = rows.where(_possible("m", "pivot") & (F.col("m.label") != F.col("pivot.label"))).groupBy(F.col("m.id").alias("x")).agg(
            (F.max if step == "largest" else F.min)("pivot.id").alias("y"))
    else:
        rows = rows.join(parities, F.col("m.id") == F.col("of")).select("key", F.col("m").withField("odd", F.col("odd")).alias("m"))
        pairs = rows.alias("p").join(rows.select("key", F.col("m").alias("o")), "key").where(
            (F.col("m.label") < F.col("o.label")) & _possible("m", "o") & _near("m", "o")).select(
            F.col("m.id").alias("x"), F.col("o.id").alias("y"))
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def linked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, n_shingles, component_id): one for each row of ``docs``."""
    with scratch(docs.sparkSession):
        return staged(_linked(docs, id_col, text_col), "linked", keep=True)


def _linked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    summaries = staged(_summaries(docs), "sets")
    counts = spark.sparkContext.broadcast(_counts(summaries))
    rows = summaries.where("slice is null").select("id", "n", "sig_a", "sig_b", "bits", "odd")
    small = boundary({r["n"]: r["count"] for r in rows.where(f"n between 1 and {2 * MOST_SMALL}").groupBy("n").count().collect()})

    # One node for all exact copies of a set: its smallest id. An id on rows with different sets is a node of its own.
    known = rows.where("n > 0 and id is not null").drop("bits", "odd")
    nodes = known.groupBy("sig_a", "sig_b", "n").agg(F.min("id").alias("node"), F.count("*").alias("m"))
    copies = staged(known.join(nodes.where("m > 1"), ["sig_a", "sig_b", "n"]).where("id != node").select("id", "node").distinct(), "copies")
    repeated = rows.where("id is not null").groupBy("id").count().where("count > 1").select("id")
    merged = copies.join(repeated, "id", "left_anti").withColumnRenamed("id", "copy")

    named = docs.where("id is not null")
    shared = staged(_entries(named, counts, small).groupBy("key").count().where("count > 1").select("key"), "shared-keys")
    lists = _entries(named, counts, small).join(shared, "key")
    lists = staged(lists.join(merged, F.col("id") == F.col("copy"), "left").select(
        "key", F.coalesce("node", "id").alias("id"), F.shiftright("size", 32).cast("int").alias("n"),
        F.col("size").bitwiseAND(F.lit(0x7FFFFFFF)).cast("int").alias("place")).distinct(), "lists")
    links = copies.select(F.col("id").alias("a"), F.col("node").alias("b"))
    # Rows of one id with different texts are each other's stand-ins, as in ``_close``.
    odd = rows.where("n > 0 and id is not null").select(F.col("id").alias("of"), "odd").distinct()
    labels = None
    for step in ("smallest", "largest", "all"):
        with scratch(spark):
            pairs = staged(_close(_candidates(lists, odd, labels, step), rows), "pairs")
            members = staged(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "members")
            texts = staged(named.join(members, "id", "left_semi"), "member-texts")
            links = links.unionByName(staged(_verified(pairs, texts), "verified", keep=True))
            labels = staged(components(links), "components", keep=True)
    return rows.select("id", "n").join(labels.withColumnRenamed("component", "reached"), "id", "left").select(
        F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"),
        F.coalesce("reached", "id").alias("component_id"))


def representatives(docs: DataFrame) -> DataFrame:
    """One document of each component, the one of the smallest id, with all columns; null ids stay."""
    with scratch(docs.sparkSession):
        dropped = staged(linked(docs).where("component_id < doc_id").select("doc_id").distinct(), "dropped", keep=True)
    return docs.join(dropped.hint("merge"), "doc_id", "left_anti").select([F.col(f"`{c}`") for c in docs.columns])
