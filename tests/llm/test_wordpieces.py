"""The word encoder against the tokenizers library."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from provenant.llm import wordpieces
from provenant.llm.common import tokenizer_file

MODEL = tokenizer_file("word_bpe_49k.json")
TEXTS = [
    "", " ", "\n\t ", "Two  words", "DON'T we'll I'd 's's'", "Straße ẞ İstanbul ﬁ ſ Σίσυφος ΟΔΟΣ", "日本語 テスト　x", "é é \x00\x01\x1c\x85",
    "12³½Ⅷ٣", "😀 ok 🏳️‍🌈", "<|startoftext|>a<|endoftext|><|endoftext|> b <|END", "</w> w</w>x", "z" * 3_000, "ab" * 2_000, "word " * 4_000,
]


@pytest.fixture(scope="module")
def library():
    loaded = Tokenizer.from_file(MODEL)
    loaded.no_truncation()
    loaded.no_padding()
    return loaded


def _same(texts, library):
    bpe = wordpieces.encoder(MODEL)
    for text, ids in zip(texts, bpe.encode(texts), strict=True):
        want = library.encode(text, add_special_tokens=False).ids
        assert ids.tolist() == want, text[:80]
        assert bpe.decode(ids) == library.decode(want, skip_special_tokens=False)


def test_odd_texts_equal_the_library(library):
    _same(TEXTS, library)


@pytest.mark.parametrize("letters", ["aab", "etaoinshrdlu", "abcdefghijklmnopqrstuvwxyz", "aÉß'ǅſé ́İ中9²_-‍\x85<|>"])
def test_random_texts_equal_the_library(letters, library):
    drawn = random.Random(len(letters))
    _same(["".join(drawn.choices(letters, k=drawn.randint(0, 40))) for _ in range(3_000)], library)


def test_pairs_stay_apart_exactly_when_merging_keeps_them():
    merges = wordpieces.encoder(MODEL).merges
    drawn = np.random.default_rng(5)
    inner = np.array([i for t, i in merges.vocab.items() if not t.endswith("</w>")])
    left, right = drawn.choice(inner, 20_000), drawn.integers(0, merges.size, 20_000)
    # Halves of existing tokens too: pairs that chance would hardly draw.
    whole = drawn.choice(np.flatnonzero(merges.born >= 0), 5_000)
    left, right = np.concatenate([left, merges.left[whole]]), np.concatenate([right, merges.right[whole]])
    names = {i: t for t, i in merges.vocab.items()}
    kept = merges.apart(left, right)
    assert 0 < kept.sum() < len(kept)
    for a, b, ok in zip(left.tolist(), right.tolist(), kept.tolist(), strict=True):
        last = names[b]
        letters = merges.letters(names[a], False) + merges.letters(last.removesuffix("</w>"), last.endswith("</w>"))
        assert (merges.merge(letters) == [a, b]) == ok


def test_most_words_need_no_merging_of_their_own_and_both_ways_to_merge_agree():
    bpe = wordpieces.Encoder(MODEL)
    bpe.encode(["the quick brown fox jumps over the lazy dog and then some more words of every day follow it"])
    assert 0 <= bpe.merged < bpe.learnt / 2
    drawn = random.Random(1)
    for _ in range(300):
        letters = bpe.merges.letters("".join(drawn.choices("abcderst", k=drawn.randint(1, 60))))
        assert bpe.merges.merge(letters) == bpe.merges._merge_long(letters)


def test_memory_turns_over(library, monkeypatch):
    monkeypatch.setattr(wordpieces, "REMEMBERED", 50)
    bpe = wordpieces.Encoder(MODEL)
    drawn = random.Random(2)
    for _ in range(20):
        texts = [" ".join("".join(drawn.choices("abcde", k=3)) for _ in range(30)) for _ in range(4)]
        for text, ids in zip(texts, bpe.encode(texts), strict=True):
            assert ids.tolist() == library.encode(text, add_special_tokens=False).ids


def test_a_batch_without_new_words():
    bpe = wordpieces.Encoder(MODEL)
    first, again, none = bpe.encode(["known words"]), bpe.encode(["known words", None]), bpe.encode([None, ""])
    assert first[0].tolist() == again[0].tolist() and [len(x) for x in (again[1], *none)] == [0, 0, 0]
    assert bpe.encode([]) == [] and bpe.merges.encode([]) == ([], 0)


def test_rows_with_nulls_repeats_clashing_names_and_no_rows(spark, library):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "x"), (None, "a b", "x"), (99, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `n_tokens.x` string")
    want = []
    for i, text, _ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        want.append((str(i), len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                     hashlib.sha256(decoded.encode()).hexdigest()))
    got = wordpieces.digests(docs, MODEL).collect()
    assert sorted((str(r.doc_id), *tuple(r)[1:]) for r in got) == sorted(want)
    back = wordpieces.decode(wordpieces.encode(docs, MODEL), MODEL).collect()
    assert sorted((str(r.doc_id), hashlib.sha256(r.text.encode()).hexdigest()) for r in back) == sorted((w[0], w[3]) for w in want)
    assert wordpieces.digests(docs.limit(0), MODEL).count() == 0
