import itertools
import random
import re

import numpy as np

from provenant.llm import decontamination as d
from provenant.llm.words import word_hashes

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def _brute(doc, item):
    """Whether some window of the two texts overlaps, word by word."""
    a, b = (WORD.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode())) for t in (doc, item))
    if not b:
        return False
    need, least = (d.WINDOW, d.MATCHES) if len(b) >= d.WINDOW else (len(b), len(b))
    return any(sum(x == y for x, y in zip(a[i : i + need], b[j : j + need])) >= least
               for i in range(len(a) - need + 1) for j in range(len(b) - need + 1))


def test_masks_find_whichever_two_words_differ():
    for wrong in itertools.combinations(range(d.WINDOW), 2):
        assert any(not {s + m for m in mask} & set(wrong)
                   for mask in d.MASKS for s in range(d.WINDOW - max(mask)))


def test_word_hashes_follow_the_words():
    rng, seen = random.Random(3), {}
    for _ in range(300):
        text = "".join(rng.choices("aAbÉé \t\n\x0b\x1f,", k=rng.randint(0, 60)))
        words = WORD.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), text.encode()))
        hashes = word_hashes(text)
        assert len(hashes) == len(words)
        for word, h in zip(words, hashes.tolist()):
            assert seen.setdefault(word, h) == h
    assert len(set(seen.values())) == len(seen)


def test_overlaps_equal_brute_force(spark):
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(40)]
    items = [" ".join(rng.choices(vocabulary, k=n)) for n in (3, 7, 12, 13, 14, 20, 35, 35)] + ["", None, "W1 w2 w3"]
    items.append(items[4])
    docs = []
    for i in range(160):
        words = rng.choices(vocabulary, k=rng.randint(0, 90))
        if i % 2:
            piece = (rng.choice(items[:8]) or "").split()
            a = rng.randrange(max(1, len(piece) - 12))
            piece = piece[a : a + rng.randint(11, 40)]
            for _ in range(rng.randint(0, 4)):
                piece[rng.randrange(len(piece))] = "x"
            at = rng.randint(0, len(words))
            words[at:at] = piece
        docs.append(" ".join(words))
    docs += [None, "", "W1\tw2\nW3", "w1 w2 " * 5000 + "w3"]
    left = spark.createDataFrame([(i, t, "x") for i, t in enumerate(docs)] + [(1, docs[1], "y"), (None, docs[1], "z")],
                                 "doc_id long, text string, item_id string")
    right = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = d.overlaps(left, right).collect()
    want = {(i, j) for i, t in enumerate(docs[:-1]) for j, u in enumerate(items) if _brute(t, u)}
    assert {(r.doc_id, r.item_id) for r in got if r.doc_id is not None and r.doc_id < len(docs) - 1} == want
    assert {r.item_id for r in got if r.doc_id is None} == {j for i, j in want if i == 1}
    assert len(got) == len({(r.doc_id, r.item_id) for r in got})
    kept = d.clean(left, right)
    assert kept.columns == left.columns
    assert {r.doc_id for r in kept.collect()} >= {i for i in range(len(docs) - 1)} - {i for i, _ in want}
    assert d.overlaps(left.limit(0), right).count() == 0 == d.overlaps(left, right.limit(0)).count()


def test_the_longest_overlap_is_reported():
    item = np.arange(1, 31, dtype=np.uint64)
    doc = np.concatenate([np.full(5, 99, np.uint64), item, np.full(5, 99, np.uint64)])
    doc[12] = 77
    assert d.overlap(doc, item, [5, 9]) == (5 - 0, 35, 29)
