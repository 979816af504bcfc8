"""Near-duplicate lines, found by an exact set-similarity join and removed after their first occurrence.

A line is a set of words. Two lines are alike when ``PERCENT`` of a hundred or more of the union of their sets is
common. The join is exact. Words are ordered by rarity, so two alike lines share one of the first
n - ceil(0.8 n) + 1 words of either (prefix filter). If the first word that they share stands at places i and
j, then i + j words are not shared (positional filter), and sizes must be within the ratio (length
filter). A 64-bit map with the parities of the words' hashes bounds the
difference from below, and the words that two prefixes have in common bound what is shared from above. What
passes is verified on the whole sets.

The rarity order comes from word counts in ``BUCKETS`` hash buckets, a table of fixed size on the
driver: any order gives right results, a rare-first one gives few candidates. Lines of one set are
one entry of the join, so thousands of copies of a line cost no more than one. On a list with few lines of like
size all of these are compared. On a longer one each line is first compared with the earliest, and only lines without a match go
on to be compared with all earlier ones, so that a large family of alike lines does not make all its pairs.

A line is removed when an earlier line, by document id and line number, is alike to it, whether or not that one
stays. So the first of all alike lines is kept.

Everything is DataFrame operations. Defined results: null and empty texts stay as they are; lines
without a word are kept. A document that loses lines keeps the others in order, joined by \\n, an empty text if
none is left. A null id comes after all others. Rows with the same id are told apart by their text; equal
rows keep equal lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provenant.llm.common import scratch, staged

PERCENT = 80
BUCKETS = 1 << 18
#: Buckets whose counts travel to the driver in one row.
ROW = 1 << 10
#: Positions in the table that keeps most documents out of the verification: bounded, exact whatever collides.
BITS = 1 << 21
#: Sets that a set is compared with on one list, where more may make the list a long one.
SHORT = 32
SPACE = " \t\n\x0b\f\r"
WORD_SPLIT = f"[{SPACE}]+"


def _place(line: Column) -> Column:
    """Where a line stands: comparable, and different for different lines."""
    return F.struct(F.col("id").isNull().alias("unnamed"), F.col("id").alias("id"), F.col("version").alias("version"), line.alias("line"))


def _lines(docs: DataFrame) -> DataFrame:
    """Rows (id, version, line, content): every line that has a word."""
    rows = docs.select("id", "version", F.posexplode(F.split("text", "\n", -1)).alias("line", "content"))
    return rows.where(F.length(F.btrim("content", F.lit(SPACE))) > 0)


def _split(content: Column) -> Column:
    return F.split(F.btrim(F.lower(content), F.lit(SPACE)), WORD_SPLIT, -1)


def _hashes(content: Column) -> Column:
    """The hashes of the different words of a line."""
    return F.transform(F.array_distinct(_split(content)), lambda w: F.xxhash64(w))


def _bucket(word: Column) -> Column:
    return word.bitwiseAND(F.lit(BUCKETS - 1)).cast("int")


def _rarity(docs: DataFrame) -> Column:
    """An array literal: by bucket, the logarithm of the number of words in the bucket."""
    words = docs.select(F.explode(_split(F.col("text"))).alias("w"))
    counts = words.groupBy(_bucket(F.xxhash64("w")).alias("b")).count()
    classes = counts.groupBy(F.floor(F.col("b") / ROW).cast("int").alias("k")).agg(F.collect_list(F.struct(
        (F.col("b") % ROW).alias("b"), F.floor(2 * F.log2("count")).cast("int").alias("c"))).alias("found"))
    known = ["0"] * BUCKETS
    for row in classes.collect():
        for b, c in row["found"]:
            known[row["k"] * ROW + b] = str(c)
    return F.split(F.lit(",".join(known)), ",").cast("array<tinyint>")


def _sets(docs: DataFrame) -> DataFrame:
    """Rows (hash, at, n, bits, prefix): the set of every line, with its rarest words in their order.

    A word's place in the order is its rarity and then its hash; 32 bits of it tell words apart well enough for
    candidates. Every line is split into words here, once.
    """
    rarity = _rarity(docs)
    lines = _lines(docs).select(_place(F.col("line")).alias("at"), _hashes(F.col("content")).alias("words"))
    # Parities do not fill up: the map of a difference is the difference of the maps, however long the lines are.
    bits = F.aggregate("words", F.lit(0).cast("long"), lambda seen, w: seen.bitwiseXOR(F.call_function(
        "shiftleft", F.lit(1).cast("long"), w.bitwiseAND(F.lit(63)).cast("int"))))
    ranks = F.sort_array(F.transform("words", lambda w: F.call_function(
        "shiftleft", F.get(rarity, _bucket(w)).cast("long"), F.lit(56)).bitwiseOR(F.shiftrightunsigned(w, 8))))
    rows = lines.select("at", F.size("words").alias("n"), bits.alias("bits"), ranks.alias("ranks"))
    prefix = F.transform(F.slice("ranks", 1, _prefix_length(F.col("n"))), lambda r: F.call_function(
        "shiftright", F.call_function("shiftleft", r, F.lit(32)), F.lit(32)).cast("int"))
    return rows.select(F.xxhash64("ranks", "n").alias("hash"), "at", "n", "bits", prefix.alias("prefix"))


def _prefix_length(n: Column) -> Column:
    return (n - F.ceil(n * PERCENT / 100) + 1).cast("int")


def _bits(values: DataFrame) -> Column:
    """An array literal of 64-bit words: which of BITS positions some value of the column "v" takes."""
    at = F.pmod("v", F.lit(BITS))
    rows = values.groupBy(F.floor(at / 64).cast("int").alias("k")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (at % 64).cast("int"))).alias("bits")).collect()
    taken = ["0"] * (BITS // 64)
    for row in rows:
        taken[row["k"]] = str(row["bits"])
    return F.split(F.lit(",".join(taken)), ",").cast("array<bigint>")


def _bit(value: Column, bits: Column) -> Column:
    at = F.pmod(value, F.lit(BITS))
    word = F.element_at(bits, F.floor(at / 64).cast("int") + 1)
    return word.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), (at % 64).cast("int"))) != 0


def _entries(nodes: DataFrame) -> DataFrame:
    """Rows (word, sig, spot, bits): the prefix of every set. ``spot`` holds n and the word's place in the order."""
    rows = nodes.select("sig", "n", "bits", F.posexplode("prefix").alias("place", "word"))
    return rows.select("word", "sig", (F.col("n").cast("long") * 2**32 + F.col("place")).alias("spot"), "bits")


def _size(spot: str) -> Column:
    return F.shiftright(spot, 32)


def _most(sizes: Column) -> Column:
    """Words that two alike sets of these sizes together may not share, both sides together."""
    return sizes - 2 * F.ceil(sizes * PERCENT / (100 + PERCENT))


def _possible(a: str, b: str) -> Column:
    """Whether two entries of one word may belong to alike lines."""
    n, m = _size(f"{a}.spot"), _size(f"{b}.spot")
    i, j = (F.col(f"{x}.spot").bitwiseAND(F.lit(2**32 - 1)) for x in (a, b))
    most = _most(n + m)
    return ((F.col(f"{a}.sig") != F.col(f"{b}.sig")) & (F.least(n, m) * 100 >= F.greatest(n, m) * PERCENT) & (i + j <= most)
            & (F.bit_count(F.col(f"{a}.bits").bitwiseXOR(F.col(f"{b}.bits"))) <= most))


def _verified(candidates: DataFrame, docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (x, y) of numbers of sets whose whole sets are alike."""
    with scratch(docs.sparkSession):
        return staged(_checked(candidates, docs, nodes), "alike-lines", keep=True)


def _checked(candidates: DataFrame, docs: DataFrame, nodes: DataFrame) -> DataFrame:
    candidates = staged(candidates.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct(), "line-candidates")
    # What two sets share lies in both prefixes or behind the one that ends first. This tells long lines apart.
    ends = nodes.select("sig", "n", "prefix")
    met = candidates.join(ends.select(F.col("sig").alias("x"), F.col("n").alias("n_x"), F.col("prefix").alias("p_x")), "x").join(
        ends.select(F.col("sig").alias("y"), F.col("n").alias("n_y"), F.col("prefix").alias("p_y")), "y")
    in_both = F.size("p_x") - F.size(F.array_except("p_x", "p_y"))
    behind = F.greatest(F.col("n_x") - F.size("p_x"), F.col("n_y") - F.size("p_y"))
    needed = F.ceil((F.col("n_x") + F.col("n_y")) * PERCENT / (100 + PERCENT))
    candidates = staged(met.where(in_both + behind >= needed).select("x", "y"), "line-candidates")
    members = staged(candidates.select(F.col("x").alias("sig")).union(candidates.select("y")).distinct().join(
        nodes.select("sig", "first"), "sig"), "line-members")
    # Only lines that some candidate may stand for are split into words again.
    bits = _bits(members.select(F.xxhash64("first.version", "first.line").alias("v")))
    asked = _lines(docs).where(_bit(F.xxhash64("version", "line"), bits)).select(_place(F.col("line")).alias("at"), "content")
    sets = asked.join(members, F.col("at") == F.col("first")).dropDuplicates(["sig"]).select(
        "sig", _hashes(F.col("content")).alias("words"))
    sets = staged(sets, "line-words")
    both = candidates.join(sets.select(F.col("sig").alias("x"), F.col("words").alias("left")), "x").join(
        sets.select(F.col("sig").alias("y"), F.col("words").alias("right")), "y").withColumn(
        "common", F.size(F.array_intersect("left", "right")))
    alike = F.col("common") * 100 >= (F.size("left") + F.size("right") - F.col("common")) * PERCENT
    return both.where(alike).select("x", "y")


def _later(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Of each pair the set that comes first later."""
    first = nodes.select(F.col("sig").alias("s"), "first")
    return pairs.join(first.select(F.col("s").alias("x"), F.col("first").alias("p")), "x").join(
        first.select(F.col("s").alias("y"), F.col("first").alias("q")), "y").select(
        F.when(F.col("p") < F.col("q"), F.col("y")).otherwise(F.col("x")).alias("sig")).distinct()


def later_sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Numbers of the sets of words to which an earlier one is alike.

    ``docs`` has the columns id, version (a hash of the text) and text; ``nodes`` has a row (sig, hash, first, n,
    bits, prefix) for each set; sig is its number.
    """
    # The entries are dealt out by word once, and stand by size. A set that meets the SHORT sets before it has met all
    # that may be alike to it, if the next one is too small. A list on which this holds for all is done.
    on_list = Window.partitionBy("word")
    in_order = on_list.orderBy("spot", "sig")
    dealt = _entries(nodes).withColumns({
        "next": F.lag("spot", SHORT + 1).over(in_order),
        "before": F.collect_list(F.struct("sig", "spot", "bits")).over(in_order.rowsBetween(-SHORT, -1))})
    long = F.max(F.coalesce(_size("next") * 100 >= _size("spot") * PERCENT, F.lit(False))).over(on_list)
    nobody = F.array(F.struct(*(F.lit(None).cast("long").alias(c) for c in ("sig", "spot", "bits"))))
    met = dealt.withColumn("long", long).select(
        F.struct("word", "sig", "spot", "bits").alias("m"), F.explode(F.when(F.col("long"), nobody).otherwise(F.col("before"))).alias("o"))
    met = staged(met.where(F.col("o.sig").isNull() | _possible("m", "o")).select(
        F.when(F.col("o.sig").isNull(), F.col("m")).alias("entry"), F.col("m.sig").alias("x"), F.col("o.sig").alias("y")), "line-meetings")
    pairs = _verified(met.where("y is not null").select("x", "y"), docs, nodes)
    found = staged(_later(pairs, nodes), "later-lines")

    # Families of alike lines on long lists shrink to one: every line of a word is compared with the earliest.
    named = nodes.select("sig", F.coalesce("first.id", F.lit(2**63 - 1)).alias("id"))
    entries = staged(met.where("y is null").select("entry.*").join(named, "sig"), "line-entries")
    if entries.isEmpty():
        return found
    earliest = entries.groupBy("word").agg(F.min(F.struct("id", "sig", "spot", "bits")).alias("o"))
    met = entries.alias("m").join(earliest, "word").where(_possible("m", "o"))
    first_pairs = _verified(met.select(F.col("m.sig").alias("x"), F.col("o.sig").alias("y")), docs, nodes)
    found = staged(found.union(_later(first_pairs, nodes)).distinct(), "later-lines")

    # What is left over is compared with all that is earlier.
    late = entries.join(found, "sig", "left_anti")
    met = late.alias("m").join(entries.alias("o"), (F.col("m.word") == F.col("o.word")) & (F.col("o.id") <= F.col("m.id")) & _possible("m", "o"))
    more = _verified(met.select(F.col("m.sig").alias("x"), F.col("o.sig").alias("y")), docs, nodes)
    return found.union(_later(more, nodes)).distinct()


def _gone(docs: DataFrame) -> DataFrame:
    """Rows (i, v, gone): the numbers of the lines that a document, by id and version, loses."""
    with scratch(docs.sparkSession):
        return staged(_removed(docs), "gone", keep=True)


def _removed(docs: DataFrame) -> DataFrame:
    lines = staged(_sets(docs), "lines")
    nodes = staged(lines.groupBy("hash").agg(
        F.min("at").alias("first"), F.min("n").alias("n"), F.min("bits").alias("bits"), F.min("prefix").alias("prefix")).withColumn(
        "sig", F.monotonically_increasing_id()), "line-sets")
    with scratch(docs.sparkSession):
        later = staged(later_sets(docs, nodes), "later-lines", keep=True)
    kept = nodes.join(later, "sig", "left_anti").select(F.col("hash").alias("h"), "first")
    removed = lines.select("hash", "at").distinct().join(
        kept.hint("merge"), (F.col("hash") == F.col("h")) & (F.col("at") == F.col("first")), "left_anti")
    # At most as many lines as the text of the document has.
    return removed.groupBy(F.col("at.id").alias("i"), F.col("at.version").alias("v")).agg(
        F.collect_list("at.line").alias("gone"))


def _joined(docs: DataFrame, gone: DataFrame, id_col: str, text_col: str) -> DataFrame:
    here = F.col(f"d.{id_col}").eqNullSafe(F.col("g.i")) & (F.xxhash64(f"d.{text_col}") == F.col("g.v"))
    return docs.alias("d").join(gone.hint("merge").alias("g"), here, "left")


def _kept(text_col: str) -> Column:
    lines = F.filter(F.split(f"d.{text_col}", "\n", -1), lambda x, k: ~F.array_contains("g.gone", k))
    return F.when(F.col("g.gone").isNull(), F.col(f"d.{text_col}")).otherwise(F.array_join(lines, "\n"))


def _versions(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("version"), F.col(text_col).alias("text"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, text, n_lines, n_removed): the texts without later matches."""
    joined = _joined(docs.select(id_col, text_col), _gone(_versions(docs, id_col, text_col)), id_col, text_col)
    return joined.select(
        F.col(f"d.{id_col}").alias("id"), _kept(text_col).alias("text"),
        F.size(F.split(f"d.{text_col}", "\n", -1)).alias("n_lines"),
        F.when(F.col("g.gone").isNull(), 0).otherwise(F.size("g.gone")).alias("n_removed"))


def cleaned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size_col: str = "n_chars") -> DataFrame:
    """The documents with all their columns, texts without later matches and the size column brought up to date."""
    joined = _joined(docs, _gone(_versions(docs, id_col, text_col)), id_col, text_col)
    text = _kept(text_col)
    new = {text_col: text, size_col: F.when(F.col("g.gone").isNull(), F.col(f"d.{size_col}")).otherwise(
        F.char_length(text).cast("long"))}
    return joined.select([new.get(c, F.col(f"d.`{c}`")).alias(c) for c in docs.columns])
