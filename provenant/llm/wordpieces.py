"""BPE with word ends: speculate, verify, and merge only what fails; and decoding.

The words of a text are proposed as their greedy longest tokens. A proposal is what exact merging would make if and
only if every token comes out of its own letters and every two adjacent tokens, merged alone, stay apart:
the first merge across a boundary would also be the first one when only the two tokens beside it are merged. The
pairs of all new words of a batch are tested at once over arrays, and only words with a failing pair are merged
exactly. Each worker remembers the ids of words it has seen, in two bounded generations.

Defined results: null text counts as empty; an empty text, or one of white space only, has no tokens and decodes to
an empty text. Rows are independent, so ties and repeated rows keep one result per row, an empty table gives an
empty result, and columns other than the id and the text are ignored. A very long text is one row of a batch and is
encoded whole; a very long word is merged with a heap, in n log n steps. The path of the tokenizer file is a
parameter; each Python worker reads it from its own disk.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from provenant.llm.bytepieces import LETTERS, NUMBERS, PLAIN, SPACE, WRITTEN

#: Distinct words in one generation of a worker's memory.
REMEMBERED = 300_000
#: Splits texts of plain characters, in lower case, as the file's pattern does.
WORDS = re.compile(rf"'(?:[stmd]|re|ve|ll)|[{LETTERS}]+|[{NUMBERS}]|[^{SPACE}{LETTERS}{NUMBERS}]+")
_LETTER_OF = dict(enumerate(WRITTEN))
_BYTE_OF = {ord(c): i for i, c in enumerate(WRITTEN)}
LAST = 2**31 - 1
NEVER = np.int32(LAST)
#: Letters up to which a word is merged without a heap.
SHORT = 64


class Merges:
    """The merge rules of one file as arrays over token ids."""

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str):
        self.vocab, self.suffix = vocab, suffix
        pairs = [tuple(m) if isinstance(m, (list, tuple)) else tuple(m.split(" ")) for m in merges]
        self.rank = {(vocab[a], vocab[b]): r for r, (a, b) in enumerate(pairs)}
        self.made = [vocab[a + b] for a, b in pairs]
        size = max(vocab.values()) + 1
        #: Rank of the rule that makes a token (-1: a letter), and the two tokens it joins.
        self.born = np.full(size, -1, np.int32)
        self.left, self.right = np.arange(size), np.arange(size)
        for (a, b), made, r in zip(self.rank, self.made, range(len(pairs)), strict=True):
            self.born[made], self.left[made], self.right[made] = r, a, b
        keys = np.array([a * size + b for a, b in self.rank], np.int64)
        order = np.argsort(keys)
        self.keys, self.key_rank, self.size = keys[order], order.astype(np.int32), size
        #: Every string that some token starts with, and the token it is (-1: none).
        self.starts = {t[:n]: -1 for t in vocab for n in range(1, len(t))}
        self.starts.update(vocab)
        # What the test of pairs relies on: one rule for each token, later than the rules of its parts.
        self.sound = len(set(self.made)) == len(pairs) and all(
            self.born[a] < r and self.born[b] < r for (a, b), r in self.rank.items())
        self.whole = np.zeros(size, bool)
        for token, i in vocab.items():
            self.whole[i] = self._whole(token, i)

    def _whole(self, token: str, i: int) -> bool:
        """Whether exact merging makes this token of its own letters."""
        letters = self.letters(token.removesuffix(self.suffix), token.endswith(self.suffix))
        return None not in letters and self.merge(letters) == [i]

    def letters(self, word: str, ends: bool = True) -> list[int | None]:
        found = [self.vocab.get(c) for c in word]
        if ends and word:
            found[-1] = self.vocab.get(word[-1] + self.suffix)
        return found

    def merge(self, ids: list[int]) -> list[int]:
        """Exact merging: always the rule of lowest rank, the leftmost place first."""
        if len(ids) > SHORT:
            return self._merge_long(ids)
        ids, rank, made = list(ids), self.rank.get, self.made
        ranks = [rank(pair, LAST) for pair in zip(ids, ids[1:])]
        while ranks and (r := min(ranks)) < LAST:
            i = ranks.index(r)
            ids[i : i + 2] = [made[r]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank((ids[i - 1], ids[i]), LAST)
            if i < len(ranks):
                ranks[i] = rank((ids[i], ids[i + 1]), LAST)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap of places, for words whose length squared would hurt."""
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        ids, rank = list(ids), self.rank
        heap = [(r, i, *pair) for i, pair in enumerate(zip(ids, ids[1:])) if (r := rank.get(pair)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= len(ids) or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = self.made[r], -1, after[j]
            if after[j] < len(ids):
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < len(ids) and (s := rank.get((ids[x], ids[y]))) is not None:
                    heapq.heappush(heap, (s, x, ids[x], ids[y]))
        return [i for i in ids if i >= 0]

    def greedy(self, word: str) -> list[int] | None:
        """The longest token from each place on; None where no token fits."""
        whole, out, at, starts = word + self.suffix, [], 0, self.starts.get
        end, size = len(word), len(whole)
        while at < end:
            stop, best = at + 1, None
            while stop <= size and (token := starts(whole[at:stop])) is not None:
                # The last letter bears the word's end: a token without it can't reach there.
                if token >= 0 and stop != end:
                    best, reached = token, stop
                stop += 1
            if best is None:
                return None
            out.append(best)
            at = reached
        return out

    def apart(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Which pairs of adjacent tokens exact merging, run on the two alone, leaves as they are.

        Merging is run backwards over all pairs at once: the tokens at the boundary are the two given, and the
        one made last is undone first. A rule for the two at the boundary breaks the pair if its turn comes
        before both are taken up into the next larger tokens; at equal rank the leftmost place is first.
        """
        ok = np.ones(len(left), bool)
        at = np.arange(len(left))
        left, right = left.astype(np.int64), right.astype(np.int64)
        left_end, right_end = np.full(len(at), NEVER), np.full(len(at), NEVER)
        while len(at):
            key = left * self.size + right
            place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rule = np.where(self.keys[place] == key, self.key_rank[place], NEVER)
            broken = (rule != NEVER) & (rule < left_end) & (rule <= right_end)
            ok[at[broken]] = False
            born_left, born_right = self.born[left], self.born[right]
            go_on = ~broken & ((born_left >= 0) | (born_right >= 0))
            undo_left = born_left > born_right
            left_end = np.where(undo_left, born_left, left_end)[go_on]
            right_end = np.where(undo_left, right_end, born_right)[go_on]
            left = np.where(undo_left, self.right[left], left)[go_on]
            right = np.where(undo_left, right, self.left[right])[go_on]
            at = at[go_on]
        return ok

    def encode(self, words: list[str]) -> tuple[list[list[int]], int]:
        """The ids of every word, and how many words needed exact merging."""
        if not len(self.keys) or not self.sound:
            return [self._exact(w) for w in words], len(words)
        proposed = [self.greedy(w) for w in words]
        sizes = np.array([len(p) if p else 0 for p in proposed], np.int64)
        flat = np.fromiter((i for p in proposed if p for i in p), np.int64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(words)), sizes)
        fails = np.array([p is None for p in proposed], bool)
        fails[owner[~self.whole[flat]]] = True
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        both, back = np.unique(flat[inner] * self.size + flat[inner + 1], return_inverse=True)
        fails[owner[inner[~self.apart(both // self.size, both % self.size)[back]]]] = True
        failing = np.flatnonzero(fails).tolist()
        for i in failing:
            proposed[i] = self._exact(words[i])
        return proposed, len(failing)

    def _exact(self, word: str) -> list[int]:
        return self.merge([i for i in self.letters(word) if i is not None])


class Encoder:
    """One tokenizer file in one Python worker."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model.get("continuing_subword_prefix") or model.get("unk_token") or model.get("ignore_merges"):
            raise ValueError("only files without unknown tokens, prefixes and shortcuts past the merges are read")
        self.merges = Merges(model["vocab"], model["merges"], model.get("end_of_word_suffix") or "")
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        longest_first = sorted(self.added, key=len, reverse=True)
        self.added_pattern = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if self.added else None
        names = {i: t for t, i in model["vocab"].items()} | {i: t for t, i in self.added.items()}
        self.names = np.array([names.get(i, "") for i in range(max(names) + 1)], object)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.learnt = self.merged = 0

    def words(self, text: str) -> list[str]:
        """The words of a text without added tokens, normalised."""
        lower = text.lower()
        if text.isascii() or (PLAIN.fullmatch(text) and PLAIN.fullmatch(lower)):
            return WORDS.findall(lower)
        normal = self.library.normalizer.normalize_str(text)
        # The library writes every byte of a word as one character.
        return [bytes(map(_BYTE_OF.get, map(ord, w))).decode() for w, _ in self.library.pre_tokenizer.pre_tokenize_str(normal)]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of every text as unsigned 32-bit little-endian integers."""
        parts: list[list[int | list[str]]] = []
        distinct: set[str] = set()
        for text in texts:
            pieces = self.added_pattern.split(text or "") if self.added_pattern else [text or ""]
            row = [self.added[p] if i % 2 else self.words(p) for i, p in enumerate(pieces)]
            parts.append(row)
            for part in row:
                if isinstance(part, list):
                    distinct.update(part)
        self._learn(distinct)
        known = self.young
        return [
            np.frombuffer(b"".join([
                p.to_bytes(4, "little") if isinstance(p, int) else b"".join([known[w] for w in p]) for p in row
            ]), "<u4")
            for row in parts
        ]

    def _learn(self, words: set[str]) -> None:
        # Two generations: what is asked for again moves on, the rest of the old one goes.
        if len(self.young) > REMEMBERED:
            self.old, self.young = self.young, {}
        new = []
        for word in words.difference(self.young):
            if (ids := self.old.get(word)) is None:
                new.append(word)
            else:
                self.young[word] = ids
        if not new:
            return
        written = [w.encode().decode("latin-1").translate(_LETTER_OF) for w in new]
        encoded, merged = self.merges.encode(written)
        self.learnt, self.merged = self.learnt + len(new), self.merged + merged
        for word, ids in zip(new, encoded, strict=True):
            self.young[word] = np.array(ids, "<u4").tobytes()

    def decode(self, ids: np.ndarray) -> str:
        """The names of the tokens with a space between: the file has no decoder of its own."""
        return " ".join(self.names[ids].tolist())


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id and ``ids``, all token ids of the whole text."""
    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for frame in frames:
            ids = bpe.encode(frame.column(1).to_pylist())
            sizes = np.cumsum([0, *map(len, ids)])
            flat = pa.array(np.concatenate([np.zeros(0, "<u4"), *ids]).astype("int32"))
            yield pa.RecordBatch.from_arrays(
                [frame.column(0), pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), flat)], [id_col, "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(batches, f"`{id_col}` {kind}, ids array<int>")


def decode(rows: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per row: its id and ``text``, the decoded ids (null counts as none)."""
    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for frame in frames:
            texts = [bpe.decode(np.array(ids or [], np.int64)) for ids in frame.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([frame.column(0), pa.array(texts, pa.string())], [id_col, "text"])

    kind = rows.schema[id_col].dataType.simpleString()
    return rows.select(id_col, ids_col).mapInArrow(batches, f"`{id_col}` {kind}, text string")


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode every text in one pass, keeping counts and digests instead of ids and texts."""
    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for frame in frames:
            encoded = bpe.encode(frame.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([
                frame.column(0),
                pa.array([len(ids) for ids in encoded], pa.int64()),
                pa.array([hashlib.sha256(ids.tobytes()).hexdigest() for ids in encoded], pa.string()),
                pa.array([hashlib.sha256(bpe.decode(ids).encode()).hexdigest() for ids in encoded], pa.string()),
            ], [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(
        batches, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
