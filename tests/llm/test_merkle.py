"""The manifest and its climb against a tree folded level by level in plain Python."""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from provenant.llm import merkle, queries
from provenant.session import configure, new_run_dir

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _hash(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _leaf(row, **changed):
    values = [changed.get(name, row[name]) for name in merkle.FIELDS]
    return _hash(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def _tree(level):
    """The root of the nodes, and for each of them its siblings, level by level: (its side, digest) or None."""
    where, paths = list(range(len(level))), [[] for _ in level]
    while len(level) > 1:
        for path, at in zip(paths, where, strict=True):
            other = at ^ 1
            path.append((other < at, level[other]) if other < len(level) else None)
        level = [_hash(*level[i : i + 2]) for i in range(0, len(level), 2)]
        where = [at // 2 for at in where]
    return level[0], paths


def _expected(rows):
    groups = defaultdict(list)
    for row in rows:
        ident = row["doc_id"]
        tampered = ident is not None and zlib.crc32(str(ident).encode()) % 7 == 0 and row["n_chars"] is not None
        offered = _leaf(row, n_chars=row["n_chars"] + 1) if tampered else _leaf(row)
        groups[row["lang"]].append((ident is not None, ident or 0, _leaf(row), offered, ident))
    langs = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: _tree([m[2] for m in sorted(groups[g])]) for g in langs}
    root, above = _tree([trees[g][0] for g in langs])
    out = []
    for lang, upper in zip(langs, above, strict=True):
        subroot, paths = trees[lang]
        for (_, _, leaf, offered, ident), lower in zip(sorted(groups[lang]), paths, strict=True):
            folded, path = offered, lower + upper
            for step in path:
                folded = _hash(folded) if step is None else _hash(step[1], folded) if step[0] else _hash(folded, step[1])
            proof = _hash(*[step[1] for step in path if step])
            out.append((ident, leaf, subroot, root, proof, folded, folded == root))
    return sorted(out, key=str)


def _rows(spark, tmp_path, data, name="docs", schema=SCHEMA):
    folder = f"{tmp_path}/{name}"
    spark.createDataFrame(data, schema).write.parquet(f"{folder}/documents.parquet")
    return folder


def _check(spark, folder):
    got = sorted((tuple(r) for r in queries.op13_merkle_manifest(spark, folder).collect()), key=str)
    assert got == _expected([r.asDict() for r in spark.read.parquet(f"{folder}/documents.parquet").collect()])
    return got


def test_query_over_the_given_tables(spark):
    got = _check(spark, "/root/testdata/sf0.01")
    assert 0 < sum(not r[-1] for r in got) < len(got) / 4


def test_nulls_repeats_ties_empty_and_long_texts_and_clashing_names(spark, tmp_path):
    data = [(i, f"text {i}", ("en", "de", None, "é", "")[i % 5], "s", i) for i in range(40)]
    data += [(None, None, None, None, None), (None, "", "en", "", 0), (7, "text 7", None, "s", 7), (7, "text 7", None, "s", 7),
             (7, "other", None, "s", 1), (50, "x" * 300_000, "en", "s", 2**63 - 1), (51, "a", "one", "s", 1)]
    plain = _rows(spark, tmp_path, data)
    _check(spark, plain)
    docs = spark.read.parquet(f"{plain}/documents.parquet")
    names = ("tree", "stage", "offered", "fold", "a.b", "up_pos", "digest")
    more = docs.select("*", *[F.lit(1).alias(n) for n in names])
    build = lambda d: merkle.build(d, new_run_dir(spark, "m"))
    assert build(more).root == build(docs).root


@pytest.mark.parametrize("n", [1, 2, 3, 63, 64, 65, 129, 4097])
def test_sizes_around_the_span_of_a_link(spark, tmp_path, n):
    _check(spark, _rows(spark, tmp_path, [(i, "t", "en", "s", 1) for i in range(n)]))


def test_many_groups_and_one_that_holds_nearly_all(spark, tmp_path):
    data = [(i, "t", f"l{i}" if i < 70 else "hot", "s", 1) for i in range(400)]
    _check(spark, _rows(spark, tmp_path, data))


def test_no_leaves(spark, tmp_path):
    folder = _rows(spark, tmp_path, [])
    assert queries.op13_merkle_manifest(spark, folder).count() == 0
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert merkle.build(docs, new_run_dir(spark, "m")).root is None


def test_every_node_row_names_a_stored_parent(spark):
    docs = configure(spark).read.parquet("/root/testdata/sf0.01/documents.parquet")
    manifest = merkle.build(docs, new_run_dir(spark, "m"))
    rows = manifest.leaves().drop("doc_id", "offered").unionByName(manifest.nodes)
    key = ["tree", "stage", "pos"]
    assert rows.select(*key).distinct().count() == rows.count()
    lost = rows.where("up_tree is not null").select(
        F.col("up_tree").alias("tree"), F.col("up_stage").alias("stage"), F.col("up_pos").alias("pos"), F.col("up_digest").alias("digest")
    ).join(rows.select(*key, "digest"), [*key, "digest"], "left_anti")
    assert lost.count() == 0
    assert merkle.verified(manifest).where("not verified").count() == 0
