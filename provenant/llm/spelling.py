"""Spelling variants: words one edit apart, found by dynamic programming over sorted lists.

Words are counted over all documents. The vocabulary is sorted twice, as it is and with every word
written backwards, and cut into blocks of BLOCK consecutive words. Two words one edit apart share their first STEM code
points or, the edit being among those, their last ones; so one of the two lists holds both under one stem. A word
visits the blocks of its stem, but not those whose shared prefix is already more than one edit away from it. Within a
block, the rows of the edit matrix, three cells wide, are computed once for every prefix that adjacent words
share, for all visiting words together; a range whose prefix exceeds one edit is left there and then.

Bounds: a block holds BLOCK words, and the words that visit it come in parts of at most BLOCK, one for each block they
stand in. So one stem may hold any share of the vocabulary: it spans many blocks. The driver learns the largest count.

Defined results: null and empty texts have no words; a document without an id counts as one whose id is written as
nothing. Repeated rows count as often as they occur. Of near words with equal counts the first in code-point order
is the form. An empty table has no words. A very long text or word is handled whole; beyond LONG code points a range of
one word is compared directly. Other columns play no part.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenant.llm.common import staged
from provenant.operators.ordering import with_ordinal

#: A word has at least six code points: runs of A-Z, a-z and U+00C0 to U+00FF, in UTF-8 and lower case.
RUNS = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf]){6,}")
SHORTEST, RAREST = 6, 5
#: One in so many (document, run) pairs loses a code point.
LOSES_ONE_IN = 199
#: A form occurs at least so many times as often as its variant.
RATIO = 5
STEM, BLOCK, LONG = 3, 8192, 40
#: Distinct words a task counts before it hands the counts on.
HELD = 200_000
#: Code points of a block's shared prefix that decide about a visit; fewer only skip less.
ROUTED = 12
FAR = 9


def counted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word`` and ``n``: how often each word occurs in all texts, the rare ones left out."""
    def tally(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()
        for frame in frames:
            for ident, text in zip(frame.column(0).to_pylist(), frame.column(1)):
                runs = RUNS.findall(text.as_buffer().to_pybytes().lower()) if text.is_valid else []
                lead = zlib.crc32(f"{'' if ident is None else ident}:".encode())
                for run, n in Counter(runs).items():
                    digest = zlib.crc32(run, lead)
                    if digest % LOSES_ONE_IN:
                        counts[run] += n
                        continue
                    letters = run.decode()
                    at = digest % len(letters)
                    if len(letters) > SHORTEST:
                        counts[(letters[:at] + letters[at + 1 :]).encode()] += n
            if len(counts) > HELD:
                yield _as_batch(counts)
                counts.clear()
        yield _as_batch(counts)

    partial = docs.select(id_col, text_col).mapInArrow(tally, "word string, n long")
    return partial.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= RAREST)


def _as_batch(counts: Counter[bytes]) -> pa.RecordBatch:
    words = pa.array(list(counts), pa.binary()).cast(pa.string())
    return pa.RecordBatch.from_arrays([words, pa.array(list(counts.values()), pa.int64())], ["word", "n"])


class _Codes:
    """Code points of many words in one array; 0 stands beyond a word's end."""

    def __init__(self, words: list[str]):
        self.lengths = np.fromiter(map(len, words), np.int64, len(words))
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])[:-1]
        self.flat = np.frombuffer("".join(words).encode("utf-32-le") + b"\0\0\0\0", "<u4").astype(np.int64) + 1
        self.flat[-1] = 0

    def at(self, which: np.ndarray, place: int) -> np.ndarray:
        inside = self.lengths[which] > place
        return np.where(inside, self.flat[np.where(inside, self.starts[which] + place, len(self.flat) - 1)], 0)


def _one_edit(a: str, b: str) -> bool:
    """Exactly one inserted, deleted or replaced code point."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[:middle] == b[:middle] else (low, middle - 1)
    return a[low + (len(a) >= len(b)) :] == b[low + (len(b) >= len(a)) :]


def near_in(words: list[str], queries: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (query, word) one edit apart with the same stem; ``words`` are distinct and in code-point order.

    Words with the same first d code points are one range. Every range carries, for each query that still reaches
    it, the cells of its row of the edit matrix at the query's prefixes of d - 1, d and d + 1 code points.
    """
    listed, asked = _Codes(words), _Codes(queries)
    stems = [w[:STEM] for w in words]
    first_of: dict[str, int] = {}
    ranges = np.fromiter((first_of.setdefault(s, len(first_of)) for s in stems), np.int64, len(words))
    reached = np.fromiter((first_of.get(q[:STEM], -1) for q in queries), np.int64, len(queries))
    item, place = np.flatnonzero(reached >= 0), reached[reached >= 0]
    less, same, more = (np.full(len(item), v, np.int8) for v in (1, 0, 1))
    alive, depth = np.arange(len(words)), STEM
    found_q, found_w = [], []
    while len(item):
        # Leave the ranges that no query reaches any more.
        wanted = np.zeros(ranges[-1] + 1, bool)
        wanted[place] = True
        number = np.cumsum(wanted) - 1
        alive, ranges, place = alive[wanted[ranges]], number[ranges[wanted[ranges]]], number[place]
        if depth >= LONG:
            sizes = np.bincount(ranges)
            alone = sizes[place] == 1
            last = np.cumsum(sizes) - 1
            for q, w in zip(item[alone].tolist(), alive[last[place[alone]]].tolist()):
                if _one_edit(queries[q], words[w]):
                    found_q.append([q]), found_w.append([w])
            item, place, less, same, more = (x[~alone] for x in (item, place, less, same, more))
            if not len(item):
                break
        code = listed.at(alive, depth)
        starts = np.flatnonzero(np.concatenate([[True], (ranges[1:] != ranges[:-1]) | (code[1:] != code[:-1])]))
        child_code, child_range = code[starts], ranges[starts]
        first = np.searchsorted(child_range, np.arange(ranges[-1] + 2))
        many = np.diff(first)[place]
        back = np.repeat(np.arange(len(item)), many)
        child = np.arange(len(back)) - np.repeat(np.cumsum(many) - many, many) + first[place][back]
        c = child_code[child]
        q, a, b, e = item[back], less[back], same[back], more[back]
        ended = np.flatnonzero(c == 0)
        beyond = asked.lengths[q[ended]] - depth
        cells = np.where(beyond == -1, a[ended], np.where(beyond == 0, b[ended], np.where(beyond == 1, e[ended], FAR)))
        hit = ended[cells == 1]
        found_q.append(q[hit]), found_w.append(alive[starts[child[hit]]])
        go_on = np.flatnonzero(c)
        q, a, b, e, c, child = q[go_on], a[go_on], b[go_on], e[go_on], c[go_on], child[go_on]
        length = asked.lengths[q]
        new_less = np.where(length >= depth, np.minimum(a + (asked.at(q, depth - 1) != c), b + 1), FAR)
        new_same = np.where(length >= depth + 1, np.minimum(np.minimum(b + (asked.at(q, depth) != c), e + 1), new_less + 1), FAR)
        new_more = np.where(length >= depth + 2, np.minimum(e + (asked.at(q, depth + 1) != c), new_same + 1), FAR)
        kept = np.minimum(np.minimum(new_less, new_same), new_more) <= 1
        item, place = q[kept], child[kept]
        less, same, more = (x[kept].astype(np.int8) for x in (new_less, new_same, new_more))
        inside = code != 0
        in_child = np.cumsum(np.bincount(starts, minlength=len(code))) - 1
        alive, ranges = alive[inside], in_child[inside]
        depth += 1
    join = lambda parts: np.concatenate([np.zeros(0, np.int64), *parts]).astype(np.int64)
    return join(found_q), join(found_w)


def _best(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per visiting word: how many near words the block holds, and the one of largest count."""
    for frame in frames:
        out: dict[str, list] = {}
        for row in range(frame.num_rows):
            backward = frame.column(0)[row].as_py()
            entries, queries = frame.column(1)[row].values, frame.column(2)[row].values.to_pylist()
            words, counts = entries.field(0).to_pylist(), entries.field(1).to_pylist()
            order = sorted(range(len(words)), key=words.__getitem__)
            for q, w in zip(*(x.tolist() for x in near_in([words[i] for i in order], queries))):
                word, other, n = queries[q], words[order[w]], counts[order[w]]
                if backward:
                    word, other = word[::-1], other[::-1]
                    if word[:STEM] == other[:STEM]:
                        continue  # the list in reading order has this pair
                best = out.setdefault(word, [0, -n, other])
                best[0] += 1
                if (-n, other) < (best[1], best[2]):
                    best[1:] = -n, other
        yield pa.RecordBatch.from_arrays([
            pa.array(list(out), pa.string()), pa.array([b[0] for b in out.values()], pa.int64()),
            pa.array([b[1] for b in out.values()], pa.int64()), pa.array([b[2] for b in out.values()], pa.string()),
        ], ["word", "n_near", "minus_n", "other"])


def near_words(vocabulary: DataFrame) -> DataFrame:
    """``word``, ``n_near``, and its near word of largest count with that count; only words that have a near word."""
    spark = vocabulary.sparkSession
    # A row holds a block and its visitors.
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(32 << 20))
    both = vocabulary.select(F.lit(False).alias("backward"), F.col("word").alias("w"), "n").union(
        vocabulary.select(F.lit(True), F.reverse("word"), "n"))
    placed = with_ordinal(both, ["w"], "at", within=["backward"])
    lists = staged(placed.select("backward", F.expr(f"(at - 1) div {BLOCK}").alias("block"), F.left("w", F.lit(STEM)).alias("stem"), "w", "n"), "lists")
    shared = F.expr(f"""
        left(low, array_max(filter(sequence(1, {ROUTED}), i -> i <= length(low) and left(low, i) = left(high, i))))""")
    segments = lists.groupBy("backward", "stem", "block").agg(F.min("w").alias("low"), F.max("w").alias("high")).select(
        "backward", "stem", "block", shared.alias("shared"))
    within_one = F.lit(False)
    for step in (-1, 0, 1):
        prefix = F.left("w", F.length("shared") + step)
        within_one = within_one | (F.levenshtein(prefix, F.col("shared"), 1) >= 0)
    visits = lists.select("backward", "stem", "w", F.col("block").alias("source")).join(
        segments, ["backward", "stem"]
    ).where((F.col("source") == F.col("block")) | within_one)
    visitors = visits.groupBy("backward", "block", "source").agg(F.collect_list("w").alias("queries"))
    blocks = lists.groupBy("backward", "block").agg(F.collect_list(F.struct("w", "n")).alias("entries"))
    partial = visitors.join(blocks, ["backward", "block"]).select("backward", "entries", "queries").mapInArrow(
        _best, "word string, n_near long, minus_n long, other string")
    return partial.groupBy("word").agg(
        F.sum("n_near").alias("n_near"), F.min(F.struct("minus_n", "other")).alias("best")
    ).select("word", "n_near", F.col("best.other").alias("near"), (-F.col("best.minus_n")).alias("near_n"))


def variants(vocabulary: DataFrame) -> DataFrame:
    """``word``, ``n``, ``n_near``, ``form``, ``form_n`` and ``root`` for every word of (word, n)."""
    vocabulary = staged(vocabulary.select("word", "n"), "vocabulary")
    is_form = F.col("near_n") >= RATIO * F.col("n")
    forms = staged(vocabulary.join(near_words(vocabulary), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(is_form, F.col("near")).alias("form"), F.when(is_form, F.col("near_n")).alias("form_n"),
    ), "forms")
    # Counts grow by RATIO with every step, which bounds a chain; every round doubles what a word has followed.
    steps, largest = 1, forms.agg(F.max("n")).first()[0] or 1
    while largest >= RATIO:
        steps, largest = steps + 1, largest // RATIO
    ends = forms.where("form is not null").select("word", F.col("form").alias("root"))
    for _ in range((steps - 1).bit_length()):
        further = ends.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        ends = staged(ends.join(further, "root", "left").select("word", F.coalesce("beyond", "root").alias("root")), "roots")
    return forms.join(ends, "word", "left").select(
        "word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
