"""Spelling variants against a comparison of all words with all words."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest

from provenant.llm import queries, spelling
from provenant.llm.common import prepared


def _near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def _count(rows):
    counts = Counter()
    for ident, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            digest = zlib.crc32(f"{'' if ident is None else ident}:{run}".encode())
            if digest % 199 == 0:
                run = run[: digest % len(run)] + run[digest % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def _expected(counts):
    out = {}
    # Words one edit apart have a letter sequence of one of them, less one letter, in common.
    holes = {}
    for word in counts:
        for form in {word, *(word[:i] + word[i + 1 :] for i in range(len(word)))}:
            holes.setdefault(form, set()).add(word)
    for word, n in counts.items():
        seen = set().union(*(holes[f] for f in {word, *(word[:i] + word[i + 1 :] for i in range(len(word)))}))
        near = [w for w in seen if _near(word, w)]
        best = min(near, key=lambda w: (-counts[w], w), default=None)
        out[word] = (n, len(near), best if best and counts[best] >= 5 * n else None)
    rows = []
    for word, (n, n_near, form) in out.items():
        root = word
        while out[root][2]:
            root = out[root][2]
        rows.append((word, n, n_near, form, counts[form] if form else None, root))
    return sorted(rows)


def _got(df):
    return sorted((r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in df.collect())


def test_query_over_the_given_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    want = _expected(_count(docs))
    assert _got(queries.op11_spelling_variants(spark, "/root/testdata/sf0.01")) == want
    assert any(r[3] for r in want)


@pytest.mark.parametrize(("letters", "low", "high"), [("ab", 6, 9), ("abcdeé", 6, 8), ("a", 6, 70), ("ab", 30, 90)])
def test_a_block_finds_every_near_word(letters, low, high):
    drawn = random.Random(high)
    words = set()
    for _ in range(250):
        word = "".join(drawn.choices(letters, k=drawn.randint(low, high)))
        at = drawn.randrange(len(word))
        words |= {word, word[:at] + word[at + 1 :], word[:at] + drawn.choice(letters) + word[at:], word[:at] + drawn.choice(letters) + word[at + 1 :]}
    words = {w for w in words if len(w) >= 6}
    found = []
    for backward in (False, True):
        listed = sorted(w[::-1] if backward else w for w in words)
        for q, w in zip(*spelling.near_in(listed, listed), strict=True):
            a, b = (x[::-1] if backward else x for x in (listed[q], listed[w]))
            if not backward or a[:3] != b[:3]:
                found.append((a, b))
    assert len(found) == len(set(found))
    assert set(found) == {(a, b) for a in words for b in words if _near(a, b)}


def test_hot_stems_spread_over_small_blocks(spark, monkeypatch):
    """All words share their beginning and their end, and a stem spans many blocks."""
    monkeypatch.setattr(spelling, "BLOCK", 16)
    drawn = random.Random(4)
    middles = {"".join(drawn.choices("abc", k=drawn.randint(1, 5))) for _ in range(300)}
    counts = {f"pre{m}post": drawn.choice([5, 30, 200, 2000]) for m in middles}
    rows = prepared(spark).createDataFrame(list(counts.items()), "word string, n long")
    assert _got(spelling.variants(rows)) == _expected(counts)


def test_long_chains_and_ties(spark):
    counts = {"aaaaaa": 5, "aaaaab": 25, "aaaabb": 125, "aaabbb": 625, "aabbbb": 3125, "abbbbb": 15625, "zzzzzz": 5, "zzzzzy": 25, "zzzzzx": 25}
    rows = prepared(spark).createDataFrame(list(counts.items()), "word string, n long")
    got = _got(spelling.variants(rows))
    assert got == _expected(counts)
    assert [r for r in got if r[0] == "aaaaaa"][0][5] == "abbbbb" and [r for r in got if r[0] == "zzzzzz"][0][3] == "zzzzzx"


def test_nulls_repeats_empty_long_texts_and_clashing_names(spark):
    rows = [(1, None), (2, ""), (None, "Éclair éclair ÉCLAIR " * 9), (3, "short words only here"), (4, "x" * 100_000 + " "), (5, "Ünlü×÷straße " * 6)]
    rows += [(6, "straße straße strasse")] * 4 + [(i, "kitten mitten KITTEN") for i in range(400)] + [(i, "x" * 100_000) for i in range(100, 106)]
    docs = prepared(spark).createDataFrame([(i, t, 1, "w") for i, t in rows], "doc_id long, text string, n long, `w.x` string")
    assert _got(spelling.variants(spelling.counted(docs))) == _expected(_count(rows))
    assert _got(spelling.variants(spelling.counted(docs.limit(0)))) == []
