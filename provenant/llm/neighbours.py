"""Approximate nearest neighbours by a forest of random-projection trees, reranked exactly.

Trees are built on a bounded sample: every inner node projects on the difference of two random sample
vectors and splits at the median. Every vector of the table is then routed to one leaf of each tree. A query walks
all trees at once through one priority queue, always following the branch whose nearest boundary is
furthest on its side, until it has ``PROBED`` of all leaves. The vectors of these leaves are candidates, and
their exact distances decide: a matrix product first passes over those clearly farther than the k nearest so far.

Of vectors that are equal only the k + 1 smallest ids can be in a result, so no more of them go on: a
vector that a third of all rows share costs as much as any other, and nothing is lost.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do
those of another length than most of the sample, or without an id. Repeated rows count once; an id with several vectors counts with
the nearest. Ties go to the smaller id. Other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


TREES = 10
#: Rows of the sample that the trees are built on, in expectation. Ids are drawn with all of their rows, so the driver
#: takes twice as many at most.
SAMPLE = 20_000
#: Sample vectors in a leaf, at most.
LEAF = 24
#: Share of the leaves of all trees that a query looks into.
PROBED = 0.09
#: Vectors, and queries, of one leaf that are compared as one block, in expectation.
BLOCK = 256
#: Queries that one task walks through the trees, in expectation: each comes out once for every leaf it looks into.
WALKED = 128
#: Queries whose k nearest so far a task keeps in hand, but for those of one batch; then it passes them on.
KEPT = 20_000
#: Far above the rounding of a squared distance taken from a matrix product, as a share of the squared lengths.
SLACK = 1e-9
SEED = 7


class Tree:
    """Arrays of nodes: normal and threshold, children as numbers of nodes; a leaf has no children."""

    def __init__(self, sample: np.ndarray, rng: np.random.Generator):
        self.normals, self.cuts, self.children = [], [], []
        self._grow(sample, np.arange(len(sample)), rng)
        self.normals, self.cuts = np.array(self.normals), np.array(self.cuts)
        self.leaves = [k for k, c in enumerate(self.children) if c is None]

    def _grow(self, sample: np.ndarray, rows: np.ndarray, rng: np.random.Generator) -> int:
        me = len(self.children)
        normal, side = np.zeros(sample.shape[1]), None
        if len(rows) > LEAF:
            for _ in range(4):
                a, b = sample[rng.choice(rows, 2, replace=False)]
                normal = a - b
                at = sample[rows] @ normal
                cut = float(np.median(at))
                side = at > cut
                if 0 < side.sum() < len(rows):
                    break
                side = None
        self.normals.append(normal), self.cuts.append(cut if side is not None else 0.0), self.children.append(None)
        if side is not None:
            left = self._grow(sample, rows[~side], rng)
            self.children[me] = left, self._grow(sample, rows[side], rng)
        return me

    def route(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf of each vector."""
        out, todo = np.zeros(len(vectors), np.int32), [(0, np.arange(len(vectors)))]
        while todo:
            node, rows = todo.pop()
            if not len(rows):
                continue
            if self.children[node] is None:
                out[rows] = node
                continue
            side = vectors[rows] @ self.normals[node] > self.cuts[node]
            todo += [(self.children[node][0], rows[~side]), (self.children[node][1], rows[side])]
        return out


class Forest:
    def __init__(self, sample: np.ndarray):
        rng = np.random.default_rng(SEED)
        self.trees = [Tree(sample, rng) for _ in range(TREES)] if len(sample) else []
        self.looked_into = max(2 * TREES, int(PROBED * sum(len(t.leaves) for t in self.trees)))

    def probes(self, query: np.ndarray) -> list[tuple[int, int]]:
        """The leaves to look into, best first, over all trees together."""
        margins = [t.normals @ query - t.cuts for t in self.trees]
        queue = [(-np.inf, t, 0) for t in range(len(self.trees))]
        found = []
        while queue and len(found) < self.looked_into:
            worst, t, node = heapq.heappop(queue)
            if (children := self.trees[t].children[node]) is None:
                found.append((t, node))
                continue
            margin = margins[t][node]
            heapq.heappush(queue, (max(worst, margin), t, children[0]))
            heapq.heappush(queue, (max(worst, -margin), t, children[1]))
        return found


def _usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.col("id").isNotNull() & (F.size("v") > 0) & fine & F.exists("v", lambda x: x != 0))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.values.slice(column.offsets[0].as_py(), len(column) * width).to_numpy(zero_copy_only=False).reshape(-1, width)


def _within(points: np.ndarray, matrix: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Which rows of the matrix may be no farther from each point than its bound: all that are, and few others."""
    with np.errstate(over="ignore", invalid="ignore"):
        rows, asked = (matrix ** 2).sum(1) * (1 - SLACK) / 2, (points ** 2).sum(1) * (1 - SLACK) / 2
        # Squares beyond double precision decide nothing, nor do those below it.
        rows = np.where(np.isfinite(rows), rows - 1e-300, -np.inf)
        most = np.where(np.isfinite(asked), bounds ** 2 / 2 - asked, np.inf)
        return ~(rows - points @ matrix.T > most[:, None])


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id",
            vector_col: str = "embedding") -> DataFrame:
    """Rows (query_id, rank, vec_id, score): for every row of ``queries`` its k nearest of ``vectors``, itself excepted."""
    spark = vectors.sparkSession
    usable, asked = _usable(vectors, id_col, vector_col), _usable(queries, id_col, vector_col)
    total = usable.count()
    share = min(1.0, SAMPLE / max(1, total))
    lots = usable.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < max(1, int(share * (1 << 20))))
    drawn = lots.select("v").limit(2 * SAMPLE).toPandas()["v"]
    if drawn.empty:  # few ids, each with many rows
        drawn = usable.select("v").limit(SAMPLE).toPandas()["v"]
    widths = drawn.map(len)
    width = int(widths.mode()[0]) if len(widths) else 1
    sample = np.array([*drawn[widths == width]], np.float64).reshape(-1, width)
    forest = spark.sparkContext.broadcast(Forest(sample))

    same = Window.partitionBy("v").orderBy("id")
    few = usable.where(F.size("v") == width).distinct().withColumn("n", F.row_number().over(same)).where(F.col("n") <= k + 1)

    def route(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            if not len(frame):
                continue
            ids, vs = frame.column(0), frame.column(1)
            matrix = _matrix(vs, width)
            for t, tree in enumerate(forest.value.trees):
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(ids), t, np.int32)), pa.array(tree.route(matrix)), ids, vs],
                    ["tree", "leaf", "id", "v"])

    def probe(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            for query, v in zip(frame.column(0).to_pylist(), frame.column(1), strict=True):
                point = v.values.to_numpy()
                found = forest.value.probes(point)
                trees, leaves = zip(*found, strict=True) if found else ((), ())
                yield pa.RecordBatch.from_arrays([
                    pa.array(trees, pa.int32()), pa.array(leaves, pa.int32()), pa.array([query] * len(found), pa.int64()),
                    pa.ListArray.from_arrays(np.arange(len(found) + 1, dtype=np.int32) * width, np.tile(point, len(found)))],
                    ["tree", "leaf", "id", "v"])

    def measure(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Exact distances between blocks; each task keeps the k nearest of every query it has in hand."""
        found: dict[int, tuple[np.ndarray, np.ndarray]] = {}

        def handed_on() -> pa.RecordBatch:
            sizes = [len(i) for i, _ in found.values()]
            return pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(np.array([*found], np.int64), sizes)),
                 pa.array(np.concatenate([i for i, _ in found.values()])),
                 pa.array(np.concatenate([s for _, s in found.values()]))], ["query_id", "vec_id", "score"])

        for frame in frames:
            for asked_block, block in zip(frame.column(0), frame.column(1), strict=True):
                queries, rows = asked_block.values, block.values
                ids, matrix = rows.field("id").to_numpy(), _matrix(rows.field("v"), width)
                names, points = queries.field("id").to_numpy(), _matrix(queries.field("v"), width)
                bounds = np.array([found[q][1][-1] if q in found and len(found[q][1]) == k else np.inf for q in names])
                near = _within(points, matrix, bounds) & (ids != names[:, None])
                for spot in np.flatnonzero(near.any(1)):
                    query, close = names[spot], near[spot]
                    mine, far = ids[close], np.sqrt(((matrix[close] - points[spot]) ** 2).sum(1))
                    if query in found:
                        mine, far = np.concatenate([found[query][0], mine]), np.concatenate([found[query][1], far])
                    order = np.lexsort((mine, far))
                    mine, far = mine[order], far[order]
                    # Trees find the same vector, and an id may have several: each counts where it stands first.
                    fresh = np.sort(np.unique(mine, return_index=True)[1])[:k]
                    found[query] = mine[fresh], far[fresh]
            if len(found) >= KEPT:
                yield handed_on()
                found.clear()
        if found:
            yield handed_on()

    def blocks(rows: DataFrame, per_leaf: float, name: str) -> DataFrame:
        """The rows of each leaf, dealt out to as many blocks as keep these small; they move once, by leaf, and are joined there."""
        parts = max(1, round(per_leaf / BLOCK))
        return rows.repartition("tree", "leaf").groupBy("tree", "leaf", F.pmod(F.xxhash64("id"), F.lit(parts)).alias(f"{name}_part")).agg(
            F.collect_list(F.struct("id", "v")).alias(name))

    leaves = max(1, sum(len(t.leaves) for t in forest.value.trees))
    shelved = few.select("id", "v").mapInArrow(route, "tree int, leaf int, id long, v array<double>")
    n_asked = asked.count()
    walked = asked.where(F.size("v") == width).distinct().repartition(max(1, round(n_asked / WALKED)), "id", "v")
    probes = walked.mapInArrow(probe, "tree int, leaf int, id long, v array<double>")
    # Spark sizes the probes by the queries they come from, hundreds of times too low: left to itself it broadcasts them.
    met = blocks(probes, n_asked * forest.value.looked_into / leaves, "asked").hint("merge").join(
        blocks(shelved, total * TREES / leaves, "rows"), ["tree", "leaf"]).select("asked", "rows")
    close = met.mapInArrow(measure, "query_id long, vec_id long, score double")
    best = close.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
