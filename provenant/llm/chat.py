"""Conversations as prefix trees of token ids: turns that conversations share at their start stand there once.

Each turn becomes head, body and tail, tokenised apart, in a template that marks turns; control strings in a
text are escaped reversibly. A node of a tree is a turn with all turns before it, known by a digest of these; the
digest is a running exclusive-or of position-bound hashes, so no conversation is gathered to make it. Nodes lie
in depth-first order in one stream of tokens. Each has the interval of the stream that it fills, the position id of its
first token (the tokens of its ancestors come before it) and the intervals of its ancestors, the only others that
its tokens may attend to. Along a branch that does not change its representative (the smallest conversation
through a node) nodes lie side by side, so ancestors make one interval for each change, not for each turn.

Written as two tables: ``nodes``, and ``conversations`` with the stretches of nodes that each one takes.

Defined results: turns follow their number, nulls first, ties by role and text; repeated rows are turns of their own. Null
text and role count as empty. Rows without a conversation id are one conversation, with a null id. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from provenant.llm.bytepieces import encoder
from provenant.llm.common import staged

START, END = "<|im_start|>", "<|im_end|>\n"
LEARNED = "assistant"
#: Stands for a missing conversation id while tables are joined.
UNNAMED = -(2**63)
TURN = re.compile(re.escape(START) + r"([^\n]*)\n(.*?)" + re.escape(END), re.S)


def escape(text: str) -> str:
    """No control string is left: a backslash goes before every backslash and into every ``<|``."""
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role)


def _turns(conversations: DataFrame) -> DataFrame:
    """Rows (conv, depth, role, text, a, b, pa, pb): each turn with the digests of its prefix and of its parent's."""
    rows = conversations.select(
        F.coalesce(F.col("conv_id").cast("long"), F.lit(UNNAMED)).alias("conv"), F.col("turn").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = Window.partitionBy("conv").orderBy(F.asc_nulls_first("turn"), "role", "text")
    rows = rows.withColumn("depth", (F.row_number().over(order) - 1).cast("int"))
    rows = rows.withColumn("x", F.xxhash64("depth", "role", "text")).withColumn("y", F.xxhash64("text", "role", "depth", F.lit(1)))
    running = Window.partitionBy("conv").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("a", F.bit_xor("x").over(running)).withColumn("b", F.bit_xor("y").over(running))
    return rows.select("conv", "depth", "role", "text", "a", "b")


def _tokens(tokenizer: str):
    @F.pandas_udf("ids array<int>, body int, tail int")
    def tokens(roles: pd.Series, texts: pd.Series) -> pd.DataFrame:
        made, rows = encoder(tokenizer), []
        for role, text in zip(roles, texts, strict=True):
            head, body, tail = made.encode(f"{START}{escape_role(role)}\n"), made.encode(escape(text)), made.encode(END)
            rows.append((np.concatenate([head, body, tail]).astype(np.int32), len(head), len(head) + len(body)))
        return pd.DataFrame(rows, columns=["ids", "body", "tail"])

    return tokens


def _in_order(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """The nodes with their start in the stream: running sums in ranges, then the sums of whole ranges."""
    def running(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = 0
        for frame in frames:
            sizes = frame.column("size").to_numpy()
            local = at + np.cumsum(sizes) - sizes
            at += int(sizes.sum())
            yield frame.set_column(frame.schema.get_field_index("start"), "start", pa.array(local, pa.int64()))

    ranged = nodes.withColumn("start", F.lit(0).cast("long")).repartitionByRange(*keys).sortWithinPartitions(*keys)
    local = staged(ranged.mapInArrow(running, ranged.schema).withColumn("part", F.spark_partition_id()), "chat-nodes")
    # One row for each range.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = local.groupBy("part").agg(F.sum("size").alias("total")).select(
        "part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("before"))
    return local.join(sums, "part").withColumn("start", F.col("start") + F.col("before")).drop("part", "before")


def write(conversations: DataFrame, folder: str, tokenizer: str) -> None:
    """Write ``nodes`` and ``conversations`` below ``folder``."""
    turns = staged(_turns(conversations), "chat-turns")
    nodes = turns.groupBy("a", "b").agg(
        F.min("conv").alias("rep"), F.first("depth").alias("depth"), F.first("role").alias("role"), F.first("text").alias("text"))
    nodes = staged(nodes, "chat-distinct")
    # The runs of one representative on the way of each conversation: as many as other conversations branch off it.
    runs = turns.select("conv", "depth", "a", "b").join(nodes.select("a", "b", "rep"), ["a", "b"]).groupBy("conv", "rep").agg(
        F.min("depth").alias("first"), F.max("depth").alias("last"))
    runs = staged(runs, "chat-runs")
    ways = runs.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("first", "rep", "last"))).alias("runs"))
    key = F.transform("runs", lambda r: F.struct((-r["first"]).alias("from"), r["rep"].alias("rep")))
    made = nodes.join(ways.select(F.col("conv").alias("rep"), key.alias("way"), F.col("runs")[0]["rep"].alias("tree")), "rep")
    made = made.withColumn("t", _tokens(tokenizer)("role", "text")).select(
        "tree", "way", "depth", "rep", "t.ids", "t.body", "t.tail", (F.col("role") == LEARNED).alias("learned"),
        F.size("t.ids").cast("long").alias("size"))
    # Ranges come from a sample of the rows: stored first, they are tokenised once.
    made = staged(made, "chat-tokens")
    placed = staged(_in_order(made, ["tree", "way", "depth"]), "chat-placed")

    # Each run lies side by side, from its first node to its last.
    ends = placed.select("rep", "depth", "start", (F.col("start") + F.col("size")).alias("end"))
    spans = runs.join(ends.select("rep", F.col("depth").alias("first"), "start"), ["rep", "first"]).join(
        ends.select("rep", F.col("depth").alias("last"), "end"), ["rep", "last"])
    by_conv = spans.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("first", "last", "rep", "start", "end"))).alias("runs"))
    by_conv = staged(by_conv, "chat-ways")
    above = by_conv.select(F.col("conv").alias("rep"), "runs")
    attends = F.transform("runs", lambda r: F.struct(r["start"].alias("start"), F.least(r["end"], F.col("start")).alias("end")))
    attends = F.filter(attends, lambda i: i["start"] < i["end"])
    placed.join(above, "rep").withColumn("attends", attends).select(
        "tree", "rep", "depth", "start", (F.col("start") + F.col("size")).alias("end"),
        F.aggregate("attends", F.lit(0).cast("long"), lambda n, i: n + i["end"] - i["start"]).alias("position"),
        "attends", "ids", "body", "tail", "learned").write.parquet(f"{folder}/nodes")
    by_conv.select("conv", "runs").write.parquet(f"{folder}/conversations")


def read(spark: SparkSession, folder: str, tokenizer: str) -> DataFrame:
    """A row for each conversation, from the files alone: its size and the digests of its turns and learned texts."""
    nodes = spark.read.parquet(f"{folder}/nodes").select("rep", "depth", "ids", "body", "tail", "learned")
    ways = spark.read.parquet(f"{folder}/conversations").select("conv", F.explode("runs").alias("r"))
    wanted = ways.select("conv", F.col("r.rep").alias("rep"), F.explode(F.sequence("r.first", "r.last")).alias("depth"))
    rows = wanted.join(nodes, ["rep", "depth"]).select("conv", "depth", "ids", "body", "tail", "learned")

    def task(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, open_, out = encoder(tokenizer), None, []
        names = ["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

        def closed(c) -> tuple:
            return c[0], c[1], c[2].hexdigest(), c[3], c[4].hexdigest(), c[5]

        def batch(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds, strict=True)], names)

        # Turns of one conversation come one after the other; only digests of it are held.
        for frame in frames:
            for row in frame.to_pylist():
                if open_ is None or open_[0] != row["conv"]:
                    if open_ is not None:
                        out.append(closed(open_))
                    open_ = [row["conv"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                formatted = made.decode(row["ids"])
                role, body = TURN.fullmatch(formatted).groups()
                open_[1] += 1
                open_[2].update(f"{unescape_role(role)}\n{unescape(body)}\n".encode())
                if row["learned"]:
                    learned = unescape(made.decode(row["ids"][row["body"] : row["tail"]]))
                    open_[3] += len(learned)
                    open_[4].update(learned.encode())
                open_[5] += len(formatted)
            if out:
                yield batch(out)
                out = []
        if open_ is not None:
            yield batch([closed(open_)])

    return rows.repartition("conv").sortWithinPartitions("conv", "depth").mapInArrow(task, (
        "conv long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")).select(
        F.when(F.col("conv") != UNNAMED, F.col("conv")).alias("conv_id"), "n_turns", "turns_sha256", "loss_chars", "loss_sha256",
        "formatted_chars")
