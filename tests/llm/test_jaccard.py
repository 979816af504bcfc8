import random
import re

import numpy as np

from provenant.llm import jaccard
from provenant.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _set(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    n = min(5, len(words))
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1))


def _components(items):
    """Brute force over all pairs."""
    root = {i: i for i, _ in items}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    sets = [(i, _set(t)) for i, t in items]
    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: find(i) for i in root}


def _texts(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    passage = " ".join(rng.choices(vocabulary, k=60))
    texts = []
    for _ in range(40):
        base = rng.choices(vocabulary, k=rng.choice([1, 3, 5, 7, 9, 11, 14, 18, 25, 60, 200]))
        texts.append(" ".join(base))
        for _ in range(rng.choice([0, 0, 1, 3, 8])):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(copy) // 12))):
                how, at = rng.random(), rng.randrange(len(copy))
                if how < 0.4:
                    copy[at] = rng.choice(vocabulary)
                elif how < 0.7:
                    copy.insert(at, rng.choice(vocabulary))
                elif len(copy) > 1:
                    del copy[at]
            texts.append(" ".join(copy))
    texts += [passage + " " + " ".join(rng.choices(vocabulary, k=40)) for _ in range(10)]
    return texts + [None, "", " \n\t", "One", "oNE", "two words", "TWO\x0bwords", "a b c d e", "a b c d e", "a b c d e f",
                    "x y " * 9000]


def test_components_equal_brute_force(spark):
    for seed in (1, 2):
        items = list(enumerate(_texts(seed)))
        random.Random(seed).shuffle(items)
        docs = spark.createDataFrame([(i, t, 7) for i, t in items], "doc_id long, text string, n_shingles int")
        got = jaccard.linked(docs).collect()
        assert {r.doc_id: r.n_shingles for r in got} == {i: len(_set(t)) for i, t in items}
        assert {r.doc_id: r.component_id for r in got} == _components(items)
        kept = jaccard.representatives(docs)
        assert kept.columns == docs.columns
        assert sorted(r.doc_id for r in kept.collect()) == sorted({*_components(items).values()})


def test_small_sets_share_a_listed_subset_whenever_they_link():
    for a in range(1, jaccard.MOST_SMALL + 1):
        for b in range(1, jaccard.MOST_SMALL + 1):
            for common in range(min(a, b) + 1):
                if 100 * common >= 75 * (a + b - common):
                    need = jaccard.needed(a, b)
                    assert common >= need and need in jaccard.subset_sizes(a) and need in jaccard.subset_sizes(b)
    assert jaccard.boundary({1: 10, 2: 10, 100: 5}) >= 2


def test_maps_never_differ_more_than_their_sets():
    rng = np.random.default_rng(6)
    for _ in range(300):
        pool = rng.integers(0, 2**63, 700, dtype=np.uint64)
        x, y = (np.unique(rng.choice(pool, rng.integers(1, 600))) for _ in range(2))
        apart = len(np.setxor1d(x, y))
        assert jaccard.differing(jaccard.bit_map(x), jaccard.bit_map(y)) <= apart


def test_null_and_repeated_ids(spark):
    rows = [(None, "a b c d e f g"), (5, "a b c d e f g"), (5, "q r s t u v w"), (9, "q r s t u v w"), (3, "a b c d e f g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.doc_id), r.component_id) for r in jaccard.linked(docs).collect())
    assert got == [("3", 3), ("5", 3), ("5", 3), ("9", 3), ("None", None)]
    assert jaccard.linked(docs.limit(0)).count() == 0


def test_components_of_paths_and_stars(spark):
    rng = random.Random(4)
    links = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)] + [(7, 7), (201, 200), (200, 201)]
    rng.shuffle(links)
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "x long, y long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 160)}, 200: 200, 201: 200}


def test_far_sets_on_one_list_make_no_pairs(spark):
    rng = np.random.default_rng(3)
    sets = [rng.integers(0, 2**63, 100, np.uint64) for _ in range(40)]
    sets.append(np.concatenate([sets[0][:90], rng.integers(0, 2**63, 10, np.uint64)]))
    entries = spark.createDataFrame([(1, i, 100, 0) for i in range(len(sets))], "key long, id long, n int, place int")
    odd = spark.createDataFrame([(i, jaccard.parities(x)) for i, x in enumerate(sets)], "of long, odd array<long>")
    assert [tuple(r) for r in jaccard._candidates(entries, odd, None, "all").collect()] == [(0, 40)]
    assert jaccard._candidates(entries, odd, None, "smallest").count() == 40
