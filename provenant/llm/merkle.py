"""A Merkle manifest of a dataset: built levels stored as parent-linked node rows, climbed by a recursive query.

Every row is a leaf. The leaves of a group (a language) form a binary tree in the order of their ids, and the
roots of the groups, in the order of the groups, form the tree above. A stored node row names the
node ``SPAN`` levels up, or fewer where its tree ends below that, and holds the sibling digests on the way, so that a
climb takes one step for every ``SPAN`` levels. :func:`verified` ascends from every leaf by ``WITH RECURSIVE``: each step
appends the siblings to the proof and folds them into the digest offered for the leaf. The leaves of a run have the same
way up, so they climb in one row, each with its own digest, and share what is appended.

Levels are built by Spark aggregation over runs of ``2 ** SPAN`` consecutive nodes, which bounds every group; positions
come from range-sorted partitions, so no group, however large, is sorted or held in one task. A node row meets the
climbing rows in an equi-join that Spark may broadcast by its own size check or split by skew. The driver learns three
numbers (groups, longest group, longest run of stages) and the root.

Defined results: a null field is written ``-``, an empty one ``0:``. Rows without an id come first in their group, those
without a group form a group of their own, the first one. Rows with equal ids follow each other by their digest;
repeated rows are leaves of their own, with equal digests. A very long text is hashed whole, inside its task. An
empty table has no root (None) and an empty proof table. Other columns of the table, whatever their names, play no part.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from provenant.operators.ordering import with_ordinal

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Levels between a node row and the node it names as its parent.
SPAN = 6
RUN = 1 << SPAN
#: The number of the tree over the groups; groups are numbered from one.
TOP = 0
_LINKS = "array<struct<before:binary,after:binary>>"
_UP = "up_tree int, up_stage int, up_pos long, up_digest binary"
NODE = f"tree int, stage int, n_nodes long, {_UP}, pos long, digest binary, links {_LINKS}"
#: Leaves are stored a run a row: what they share, their parent, stands there once.
LEAVES = (f"tree int, stage int, n_nodes long, {_UP}, "
          f"members array<struct<pos:long,digest:binary,doc_id:{{kind}},offered:binary,links:{_LINKS}>>")
_CLIMB = """
WITH RECURSIVE climb (tree, up_tree, up_stage, up_pos, proof, leaves) AS (
    SELECT tree, up_tree, up_stage, up_pos, x'', transform(members, m -> named_struct(
        'doc_id', m.doc_id, 'leaf', m.digest, 'own', {siblings_of_leaf}, 'fold', {fold_of_leaf})) FROM {leaves}
    UNION ALL
    SELECT c.tree, n.up_tree, n.up_stage, n.up_pos, concat(c.proof, {siblings_of_node}), transform(c.leaves, m -> named_struct(
        'doc_id', m.doc_id, 'leaf', m.leaf, 'own', m.own, 'fold', {fold_of_node}))
    FROM climb c JOIN {nodes} n ON c.up_tree = n.tree AND c.up_stage = n.stage AND c.up_pos = n.pos
)
SELECT tree, proof, inline(leaves) FROM climb WHERE up_tree IS NULL
"""


@dataclass(frozen=True)
class Manifest:
    """The tables of one manifest and the root digest (lowercase hex; None without leaves)."""

    runs: DataFrame
    nodes: DataFrame
    groups: DataFrame
    root: str | None

    def leaves(self) -> DataFrame:
        """One node row per leaf, with the leaf's id."""
        return _rows(self.runs)


def written(value: Column) -> Column:
    """A field as it enters a leaf's digest: its length in UTF-8 bytes and itself, or ``-`` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(values: list[Column]) -> Column:
    return F.sha2(F.concat(*[written(v) for v in values]), 256)


def _levels(n: Column) -> Column:
    """How many levels a run of a tree with ``n`` nodes climbs: to its root, or SPAN at most."""
    return F.when(n > RUN, SPAN).otherwise(F.length(F.bin(n - 1)) - (n == 1).cast("int"))


def _linked(nodes: DataFrame, stage: int, tops: Column, keep: list[str]) -> DataFrame:
    """Runs of one stage, from (tree, n_nodes, pos, digest, *keep): their parent, its digest, and the linked members.

    ``tops``: a struct (tree, pos) of the node that a finished tree's root is in the tree above, null if none.
    """
    member = F.struct("pos", "digest", *keep)
    runs = nodes.groupBy("tree", "n_nodes", F.expr(f"pos div {RUN}").alias("run")).agg(
        F.array_sort(F.collect_list(member)).alias("members")
    ).withColumn("n_levels", _levels(F.col("n_nodes")))
    built = F.expr("""
        aggregate(slice(sequence(1, 64), 1, n_levels), array(transform(members, m -> lower(hex(m.digest)))),
            (levels, k) -> concat(levels, array(transform(
                sequence(0, (size(element_at(levels, -1)) - 1) div 2),
                i -> sha2(concat(element_at(levels, -1)[2 * i], coalesce(get(element_at(levels, -1), 2 * i + 1), '')), 256)
            ))))
    """)
    kept = "".join(f"'{name}', m.{name}, " for name in ("pos", "digest", *keep))
    members = F.expr(f"""
        transform(members, (m, i) -> named_struct({kept} 'links', transform(slice(sequence(0, 63), 1, n_levels), k ->
            named_struct(
                'before', if(shiftright(i, k) % 2 = 1, unhex(built[k][shiftright(i, k) - 1]), x''),
                'after', if(shiftright(i, k) % 2 = 0, coalesce(unhex(get(built[k], shiftright(i, k) + 1)), x''), x'')
            ))))
    """)
    done = F.col("n_nodes") <= RUN
    return runs.withColumn("built", built).withColumn("top", tops).select(
        "tree", F.lit(stage).alias("stage"), "n_nodes",
        F.when(done, F.col("top.tree")).otherwise(F.col("tree")).cast("int").alias("up_tree"),
        F.when(done & F.col("top").isNotNull(), F.lit(0)).when(~done, F.lit(stage + 1)).cast("int").alias("up_stage"),
        F.when(done, F.col("top.pos")).otherwise(F.col("run")).cast("long").alias("up_pos"),
        F.unhex(F.expr("element_at(built, -1)[0]")).alias("up_digest"), members.alias("members"),
    )


def _rows(runs: DataFrame) -> DataFrame:
    return runs.selectExpr("* except (members)", "inline(members)")


def _parents(rows: DataFrame) -> DataFrame:
    """The nodes of the next stage: one for each run of a tree that goes on. Runs come as such or as node rows."""
    first = rows.where(f"n_nodes > {RUN}")
    if "pos" in rows.columns:
        first = first.where(f"pos % {RUN} = 0")
    return first.select("tree", F.expr(f"(n_nodes + {RUN - 1}) div {RUN}").alias("n_nodes"), F.col("up_pos").alias("pos"),
                        F.col("up_digest").alias("digest"))


def _stages(longest: int) -> int:
    stages = 1
    while longest > RUN:
        longest, stages = -(-longest // RUN), stages + 1
    return stages


def build(docs: DataFrame, folder: str, offered: Column | None = None, fields: tuple[str, ...] = FIELDS,
          group: str = "lang", order: str = "doc_id") -> Manifest:
    """Write the manifest of ``docs`` to ``folder``, a folder that all executors share.

    ``offered`` is the digest (hex) that a reader holds for the row and wants verified; by default the leaf's own.
    """
    spark = docs.sparkSession
    digest = leaf_digest([F.col(f"`{name}`") for name in fields])
    docs.select(
        F.col(f"`{order}`").alias("doc_id"), F.col(f"`{group}`").cast("string").alias("lang"), F.unhex(digest).alias("digest"),
        F.unhex(digest if offered is None else offered).alias("offered"),
    ).write.parquet(f"{folder}/rows")
    rows = spark.read.parquet(f"{folder}/rows")

    counts = with_ordinal(rows.groupBy("lang").agg(F.count("*").alias("n_nodes")), ["lang"], "tree")
    counts.select("lang", F.col("tree").cast("int").alias("tree"), "n_nodes").write.parquet(f"{folder}/trees")
    trees = spark.read.parquet(f"{folder}/trees")
    n_trees, longest = trees.agg(F.count("*"), F.max("n_nodes")).first()

    placed = with_ordinal(rows, ["doc_id", "digest", "offered"], "at", within=["lang"])
    leaves = placed.alias("p").join(trees.alias("t"), F.col("p.lang").eqNullSafe(F.col("t.lang"))).select(
        "doc_id", "offered", "digest", "tree", "n_nodes", (F.col("at") - 1).alias("pos"))
    above = F.struct(F.lit(TOP).alias("tree"), (F.col("tree") - 1).cast("long").alias("pos"))
    none = F.lit(None).cast("struct<tree:int,pos:bigint>")
    kind = docs.schema[order].dataType.simpleString()
    above = above if n_trees > 1 else none
    levels = [_write(_linked(leaves, 0, above, ["doc_id", "offered"]), f"{folder}/leaves", LEAVES.format(kind=kind))]
    for stage in range(1, _stages(longest or 1)):
        levels.append(_write(_rows(_linked(_parents(levels[-1]), stage, above, [])), f"{folder}/nodes/part={len(levels)}", NODE))
    subroots = levels[0].where(f"n_nodes <= {RUN}").select("tree", "up_digest")
    for level in levels[1:]:
        subroots = subroots.union(level.where(f"pos = 0 and n_nodes <= {RUN}").select("tree", "up_digest"))
    groups = _write(trees.join(subroots.withColumnRenamed("up_digest", "subroot"), "tree"), f"{folder}/groups",
                    "lang string, tree int, n_nodes long, subroot binary")

    root = None
    if n_trees:
        nodes = groups.select(F.lit(TOP).alias("tree"), F.lit(n_trees).cast("long").alias("n_nodes"),
                              (F.col("tree") - 1).cast("long").alias("pos"), F.col("subroot").alias("digest"))
        for stage in range(_stages(n_trees)):
            last = _write(_rows(_linked(nodes, stage, none, [])), f"{folder}/nodes/part={len(levels) + stage}", NODE)
            nodes = _parents(last)
        root = last.where("pos = 0 and up_tree is null").select(F.lower(F.hex("up_digest"))).first()[0]
    return Manifest(levels[0], _nodes(spark, folder, n_trees), groups, root)


def _write(rows: DataFrame, path: str, schema: str) -> DataFrame:
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(schema).parquet(path)


def _nodes(spark: SparkSession, folder: str, n_trees: int) -> DataFrame:
    """All nodes that are no leaves."""
    if not n_trees:
        return spark.createDataFrame([], NODE)
    return spark.read.schema(NODE).parquet(f"{folder}/nodes/part=*")


def verified(manifest: Manifest) -> DataFrame:
    """One row per leaf: its digest, the digests of its group and of all, the digest of its proof, and the check."""
    spark = manifest.runs.sparkSession
    # The climb returns every leaf once a step, and the number of steps is small; the default stops at a million rows.
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
    siblings = "aggregate({links}, x'', (all, s) -> concat(all, s.before, s.after))"
    fold = ("unhex(aggregate({links}, lower(hex({start})), "
            "(digest, s) -> sha2(concat(lower(hex(s.before)), digest, lower(hex(s.after))), 256)))")
    query = _CLIMB.replace("{siblings_of_leaf}", siblings.format(links="m.links")).replace(
        "{fold_of_leaf}", fold.format(links="m.links", start="m.offered")).replace(
        "{siblings_of_node}", siblings.format(links="n.links")).replace(
        "{fold_of_node}", fold.format(links="n.links", start="m.fold"))
    climbed = spark.sql(query, leaves=manifest.runs, nodes=manifest.nodes)
    groups = manifest.groups.select(F.col("tree"), F.lower(F.hex("subroot")).alias("subroot"))
    folded = F.lower(F.hex("fold"))
    return climbed.join(groups, "tree").select(
        "doc_id", F.lower(F.hex("leaf")).alias("leaf"), "subroot", F.lit(manifest.root).alias("root"),
        F.sha2(F.lower(F.hex(F.concat("own", "proof"))), 256).alias("proof_sha256"), folded.alias("folded_root"),
        (folded == F.lit(manifest.root)).alias("verified"),
    )
