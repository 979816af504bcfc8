import numpy as np
import pytest
from pyspark.sql import functions as F

from provenant.llm import neighbours
from provenant.llm.queries import op9_neighbours

DIR = "/root/testdata/sf0.1"


def _exact(rows, queries, k=10):
    out = {}
    for q, v in queries:
        near = {}
        for i, w in rows:
            if i != q:
                d = float(np.sqrt(((np.array(v) - np.array(w)) ** 2).sum()))
                near[i] = min(d, near.get(i, d))
        out[q] = sorted((d, i) for i, d in near.items())[:k]
    return out


def test_few_vectors_with_ties_and_unusable_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(60)]
    rows += [(100 + i, rows[5][1]) for i in range(40)] + [rows[7], rows[7]]
    bad = [(200, None), (201, []), (202, [0.0] * 4), (203, [float("nan"), 1.0, 1.0, 1.0]), (204, [None, 1.0, 1.0, 1.0]),
           (205, [float("inf"), 1.0, 1.0, 1.0]), (206, [1.0, 2.0]), (None, [1.0] * 4)]
    table = spark.createDataFrame([(i, v, 0) for i, v in rows + bad], "vec_id long, embedding array<double>, rank int")
    got = {}
    for r in neighbours.nearest(table, table.where("vec_id % 5 = 0")).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
        assert r.rank == len(got[r.query_id])
    want = _exact(rows, [(i, v) for i, v in rows if i % 5 == 0])
    assert {q: [i for _, i in x] for q, x in got.items()} == {q: [i for _, i in x] for q, x in want.items()}
    assert all(abs(a - b) < 1e-12 for q in want for (a, _), (b, _) in zip(got[q], want[q]))


def test_recall_against_brute_force(spark):
    got = op9_neighbours(spark, DIR).toPandas()
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{DIR}/embeddings.parquet").collect()]
    matrix = np.array([v for _, v in rows], np.float64)
    ids = np.array([i for i, _ in rows])
    hits = 0
    for q, part in got.groupby("query_id"):
        d = np.sqrt(((matrix - matrix[ids == q][0]) ** 2).sum(1))
        d[ids == q] = np.inf
        last = np.sort(d)[9]
        hits += (part["score"] <= last + 1e-12).sum()
        assert len(part) == 10 and part["vec_id"].is_unique
    assert hits / (10 * got["query_id"].nunique()) >= 0.93


def test_empty_tables(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert neighbours.nearest(none, none).count() == 0
    one = spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<float>")
    assert neighbours.nearest(one, one).count() == 0


def test_probes_are_not_broadcast(spark):
    """Spark sizes them by the few queries, but each stands there once for every leaf it looks into."""
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=16)]) for i in range(3000)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = neighbours.nearest(table, table.where("vec_id % 100 = 0"))
    assert len(found.collect()) == 300
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_sample_is_bounded_though_ids_repeat(spark, monkeypatch):
    """The driver takes a bounded sample, also of a table whose only id has many vectors, drawn or not."""
    taken, grow = [], neighbours.Forest.__init__

    def counted(self, sample):
        taken.append(len(sample))
        grow(self, sample)

    monkeypatch.setattr(neighbours, "SAMPLE", 100)
    monkeypatch.setattr(neighbours.Forest, "__init__", counted)
    lots = [r.id for r in spark.range(100_000).orderBy(F.pmod(F.xxhash64("id"), F.lit(1 << 20))).collect()]
    for only, most in (lots[0], 200), (lots[-1], 100):
        table = spark.range(5000).select(F.lit(only).alias("vec_id"), F.array(F.randn(1), F.randn(2)).alias("embedding"))
        found = neighbours.nearest(table, table.limit(1).withColumn("vec_id", F.lit(-1)))
        assert taken.pop() == most and [(r.query_id, r.vec_id) for r in found.collect()] == [(-1, only)]


@pytest.mark.parametrize("kept", [20_000, 1])
def test_distances_are_exact_whatever_is_passed_over(spark, monkeypatch, kept):
    """Ids with several vectors, copies, and squares beyond double precision; in one tree of one leaf all are compared."""
    monkeypatch.setattr(neighbours, "KEPT", kept, raising=False)
    monkeypatch.setattr(neighbours, "PROBED", 1.0)
    monkeypatch.setattr(neighbours, "BLOCK", 16)
    rng = np.random.default_rng(6)
    rows = [(i % 120, [float(x) for x in rng.normal(size=3)]) for i in range(300)]
    rows += [(500 + i, [float(x) for x in rng.normal(size=3) * 10.0 ** e]) for i, e in enumerate([150, 153, 154, 155, -150, -160, -170] * 3)]
    rows += [(600 + i, rows[3][1]) for i in range(20)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in neighbours.nearest(table, table.where("vec_id % 3 = 0")).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
    want = {}
    for q in {i for i, _ in rows if i % 3 == 0}:
        near = {}
        for v in (v for i, v in rows if i == q):
            for i, d in zip([i for i, _ in rows], np.sqrt(((np.array([w for _, w in rows]) - v) ** 2).sum(1))):
                if i != q:
                    near[i] = min(float(d), near.get(i, np.inf))
        want[q] = sorted((d, i) for i, d in near.items())[:10]
    assert got == want
