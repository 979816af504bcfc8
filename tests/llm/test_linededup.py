import random
import re
from pathlib import Path

from pyspark.sql import functions as F

from provenant.llm import linededup as d
from provenant.session import shared_dir

SPACE = re.compile("[ \t\n\x0b\f\r]+")


def _brute(rows):
    """Texts without later matches, comparing every line with every earlier one."""
    lines = []
    for row, (doc_id, text) in enumerate(rows):
        for k, line in enumerate((text or "").split("\n")):
            words = frozenset(w for w in SPACE.split(line.lower()) if w)
            if words:
                lines.append(((doc_id is None, doc_id or 0, row, k), words))
    lines.sort(key=lambda x: x[0])
    gone = set()
    for k, (at, words) in enumerate(lines):
        if any(100 * len(words & w) >= d.PERCENT * len(words | w) for _, w in lines[:k]):
            gone.add((at[2], at[3]))
    return [None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (r, k) not in gone)
            for r, (_, t) in enumerate(rows)]


def _rows(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(120)]
    pool = [rng.choices(vocabulary, k=rng.choice([1, 2, 5, 9, 20, 60])) for _ in range(60)]
    rows = []
    for i in range(120):
        lines = []
        for _ in range(rng.randint(0, 8)):
            line = list(rng.choice(pool))
            for _ in range(rng.randint(0, 3)):
                line[rng.randrange(len(line))] = rng.choice(vocabulary)
            lines.append(rng.choice(["  ", "", "\t"]) + rng.choice([" ", "  "]).join(line).upper())
            if rng.random() < 0.1:
                lines.append("")
        rows.append((i, "\n".join(lines)))
    return rows + [(200, None), (201, ""), (202, "\n \n"), (203, "x " * 20_000), (204, "long " + "x y z " * 9_000)]


def test_texts_equal_brute_force(spark):
    for seed in (1, 2, 3):
        rows = _rows(seed)
        docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, id string")
        got = {r.id: r for r in d.deduplicated(docs).collect()}
        assert [got[i].text for i, _ in rows] == _brute(rows)
        assert all(r.n_lines - r.n_removed == len(r.text.split("\n")) for r in got.values()
                   if r.text is not None and r.n_removed < r.n_lines)


def test_short_and_long_lists(spark, monkeypatch):
    rows = _rows(4)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for few in (1, 4, 10_000):
        monkeypatch.setattr(d, "SHORT", few)
        got = {r.id: r.text for r in d.deduplicated(docs).collect()}
        assert [got[i] for i, _ in rows] == _brute(rows)


def test_rare_words_come_first_in_a_large_vocabulary(spark):
    # Every line has a word of its own beside words that many share: prefixes stay off the lists of those.
    rows = [(i, " ".join([f"own{i}", f"few{i // 2}", *(f"w{(i * k) % 40_000}" for k in range(3, 9)), "often"])) for i in range(20_000)]
    docs = d._versions(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text")
    sets = d._sets(docs).select(F.explode("prefix").alias("word")).groupBy("word").count()
    assert sets.agg(F.max("count")).first()[0] < 40


def test_common_lines_null_ids_and_repeated_rows(spark):
    rows = [(i, f"the common line of all\nown words number {i} here {i * 7}") for i in range(1500)]
    rows += [(None, "the common line of all\nno id here"), (3, "another text of id three"), (3, "another text of id three")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = d.deduplicated(docs).collect()
    assert len(got) == len(rows)
    assert sum("common line" in r.text for r in got) == 1
    assert [r.text for r in got if r.id is None] == ["no id here"]
    assert [r.text for r in got if r.id == 3].count("another text of id three") == 2
    assert d.deduplicated(docs.limit(0)).count() == 0


def test_no_python_in_the_plan(spark):
    docs = spark.createDataFrame(_rows(5), "doc_id long, text string")
    plan = d.deduplicated(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_bit_table(spark):
    values = spark.createDataFrame([(5,), (-7,), (d.BITS + 64,)], "v long")
    bits = d._bits(values)
    probe = spark.createDataFrame([(x,) for x in (5, -7, 64, 6, 70)], "v long")
    assert [r[0] for r in probe.select(d._bit(F.col("v"), bits)).collect()] == [True, True, True, False, False]


def test_what_is_staged_goes(spark):
    folder = Path(shared_dir(spark).removeprefix("file:"))
    before = set(folder.iterdir())
    docs = spark.createDataFrame([(i, "one two three four five six\n" + t) for i, t in enumerate("abc")], "doc_id long, text string")
    assert sorted(r.n_removed for r in d.deduplicated(docs).collect()) == [0, 1, 1]
    assert [p.name.rsplit("-", 1)[0] for p in set(folder.iterdir()) - before] == ["provenant-gone"]
