"""Encoding to byte-level BPE tokens and decoding, by segment trees over the ranks of adjacent pairs.

A text is cut at the vocabulary's special strings and between them into pre-tokens; merges never cross a cut. Over the
symbols of a pre-token stands a segment tree whose leaves are the ranks of the pairs that begin there, each with its
place as the lower part of the key. The root is then the leftmost pair of lowest rank: it is merged, the pairs before,
at and behind it are looked up again, and three leaves are updated, each in logarithmic time, until the root says that no
pair can be merged. Long pre-tokens have a tree of their own; the trees of many short ones of one width are rows of one array,
merged side by side.

Pre-tokens that a Python worker has seen are looked up in its cache (:data:`CACHE_SIZE` entries, then emptied); no
pre-token is shuffled and nothing is broadcast.

Defined cases: null texts are empty, empty ones have no tokens; special strings inside texts are their tokens, as by
the library's default; repeated rows are encoded one by one; an empty table gives an empty one; texts are encoded whole;
ids outside the vocabulary decode to nothing, bytes that are no UTF-8 to U+FFFD; columns other than those named are not read.
"""

from __future__ import annotations

import functools
import hashlib
import json
import unicodedata
from itertools import chain

import numpy as np
import regex
from pyspark.sql import DataFrame

from memspan.llm.durable import map_columns

CACHE_SIZE = 400_000
#: Longer pre-tokens are not cached, and have trees of their own.
LONGEST_SHARED = 64
#: The rank of a pair that cannot be merged.
NEVER = 1 << 30
#: Fixed value: how byte-level vocabularies of this kind cut texts.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_codecs: dict[str, Codec] = {}


@functools.cache
def unsettled() -> frozenset[str]:
    """Characters that are letters or numbers in one of two versions of Unicode (the expression library's and Python's):
    texts with any of them are cut by the tokenizers library, whatever version it knows."""
    every = "".join(map(chr, chain(range(0xD800), range(0xE000, 0x110000))))
    out: set[str] = set()
    for kind in "LN":
        out |= set(regex.findall(rf"\p{{{kind}}}", every)) ^ {c for c in every if unicodedata.category(c)[0] == kind}
    return frozenset(out)


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves, the others in
    order from U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class Codec:
    """A vocabulary with its merges, and what this worker has encoded with it."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        model, step = told["model"], told["pre_tokenizer"]
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix") if model.get(k)]
        odd += [k for k in ("byte_fallback", "ignore_merges") if model.get(k)]
        if model["type"] != "BPE" or odd or told["normalizer"] or step["type"] != "ByteLevel" or step["add_prefix_space"] or not step["use_regex"]:
            raise ValueError(f"not a plain byte-level BPE vocabulary: {path}")
        letters = {c: b for b, c in enumerate(_byte_letters())}
        vocabulary = model["vocab"]
        self.of_byte = np.zeros(256, np.int64)
        for c, b in letters.items():
            self.of_byte[b] = vocabulary[c]
        self.special = {a["content"]: a["id"] for a in told["added_tokens"]}
        if any(a["lstrip"] or a["rstrip"] or a["single_word"] or a["normalized"] for a in told["added_tokens"]):
            raise ValueError(f"special strings with conditions: {path}")
        self.size = 1 + max(*vocabulary.values(), *self.special.values())
        self.bytes_of = [b""] * self.size
        for word, i in vocabulary.items():
            self.bytes_of[i] = bytes(letters[c] for c in word)
        for word, i in self.special.items():
            self.bytes_of[i] = word.encode()
        pairs = [p if isinstance(p, list) else p.split(" ") for p in model["merges"]]
        left, right = ([vocabulary[p[k]] for p in pairs] for k in (0, 1))
        made = [vocabulary[a + b] for a, b in pairs]
        self.merges = {a * self.size + b: (rank, c) for rank, (a, b, c) in reversed(list(enumerate(zip(left, right, made, strict=True))))}
        self.keys = np.array(sorted(self.merges), np.int64)
        self.ranks = np.array([*(self.merges[k][0] for k in self.keys.tolist()), NEVER], np.int64)
        self.made = np.array([*(self.merges[k][1] for k in self.keys.tolist()), 0], np.int64)
        self.cuts = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.words = regex.compile(PATTERN)
        self.path, self.library = path, None
        self.names = [str(i) for i in range(self.size)]
        self.cache: dict[str, list[int]] = {}

    def pieces(self, text: str) -> list[str]:
        """A text's pre-tokens and special strings, in order."""
        if not self.cuts or not self.cuts.search(text):
            return self.pre_tokens(text)
        return list(chain.from_iterable([part] if part in self.special else self.pre_tokens(part) for part in self.cuts.split(text)))

    def pre_tokens(self, text: str) -> list[str]:
        """The pre-tokens of a text without special strings."""
        if text.isascii() or unsettled().isdisjoint(text):
            return self.words.findall(text)
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path).pre_tokenizer
        return [text[a:b] for _, (a, b) in self.library.pre_tokenize_str(text)]

    def merged(self, word: str) -> list[int]:
        """The ids of one pre-token, by a segment tree of its own."""
        ids = self.of_byte[np.frombuffer(word.encode(), np.uint8)].tolist()
        n, size, find = len(ids), self.size, self.merges.get
        width = 1 << max(n - 1, 1).bit_length()
        none = NEVER * width
        tree = [none] * (2 * width)
        for i in range(n - 1):
            pair = find(ids[i] * size + ids[i + 1])
            if pair:
                tree[width + i] = pair[0] * width + i
        for k in range(width - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def put(i: int, j: int) -> None:
            """Looks up the pair of symbols at ``i`` and ``j`` (nothing if there is no ``j``) and updates its leaf."""
            pair = find(ids[i] * size + ids[j]) if j < n else None
            k, value = width + i, pair[0] * width + i if pair else none
            while k and tree[k] != value:
                tree[k] = value
                k >>= 1
                value = min(tree[2 * k], tree[2 * k + 1]) if k else none

        while tree[1] < none:
            i = tree[1] % width
            j = after[i]
            ids[i] = find(ids[i] * size + ids[j])[1]
            after[i] = k = after[j]
            if k < n:
                before[k] = i
            put(j, n)
            put(i, k)
            if before[i] >= 0:
                put(before[i], i)
        out, i = [], 0
        while i < n:
            out.append(ids[i])
            i = after[i]
        return out

    def _found(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Places of pairs among the merges; the last one for pairs that are none."""
        wanted = left * self.size + right
        at = np.searchsorted(self.keys, wanted)
        at[at == len(self.keys)] = 0
        return np.where((left >= 0) & (right >= 0) & (self.keys[at] == wanted), at, len(self.keys))

    def merged_together(self, words: list[bytes], width: int) -> list[list[int]]:
        """The ids of pre-tokens of 1 to ``width`` bytes (a power of two), their trees side by side."""
        n = len(words)
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(n, width)
        sizes = np.array([len(w) for w in words])
        ids = np.where(np.arange(width) < sizes[:, None], self.of_byte[raw], -1)
        ids = np.concatenate([ids, np.full((n, 1), -1)], axis=1)
        after = np.tile(np.minimum(np.arange(1, width + 2), width), (n, 1))
        before = np.tile(np.arange(-1, width), (n, 1))
        none = NEVER * width
        tree = np.full((n, 2 * width), none, np.int64)
        places = np.arange(width)

        def leaves(at: np.ndarray, place: np.ndarray) -> np.ndarray:
            rank = self.ranks[at]
            return np.where(rank < NEVER, rank * width + place, none)

        tree[:, width:] = leaves(self._found(ids[:, :width], ids[:, 1:]), places)
        for k in range(width - 1, 0, -1):
            tree[:, k] = np.minimum(tree[:, 2 * k], tree[:, 2 * k + 1])
        rows = np.flatnonzero(tree[:, 1] < none)
        while len(rows):
            i = tree[rows, 1] % width
            j = after[rows, i]
            k = after[rows, j]
            ids[rows, i] = self.made[self._found(ids[rows, i], ids[rows, j])]
            after[rows, i] = k
            before[rows, k] = i
            ids[rows, j] = -1
            h = before[rows, i]
            changed = [(rows, j, np.full(len(rows), none)), (rows, i, leaves(self._found(ids[rows, i], ids[rows, k]), i))]
            inner = np.flatnonzero(h >= 0)
            r, b = rows[inner], h[inner]
            changed.append((r, b, leaves(self._found(ids[r, b], ids[r, i[inner]]), b)))
            for row, place, value in changed:
                node = place + width
                tree[row, node] = value
                while node.size and node[0] > 1:
                    node = node >> 1
                    tree[row, node] = np.minimum(tree[row, 2 * node], tree[row, 2 * node + 1])
            rows = rows[tree[rows, 1] < none]
        kept = ids[:, :width] >= 0
        flat, ends = ids[:, :width][kept].tolist(), np.cumsum(kept.sum(axis=1)).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends)]

    def learn(self, words: set[str]) -> dict[str, list[int]]:
        """The ids of new pre-tokens: short ones together by width, long ones one by one."""
        found: dict[str, list[int]] = {}
        by_width: dict[int, list[tuple[str, bytes]]] = {}
        for w in words:
            coded = w.encode()
            if w in self.special:
                found[w] = [self.special[w]]
            elif len(coded) <= LONGEST_SHARED:
                by_width.setdefault(1 << max(len(coded) - 1, 1).bit_length(), []).append((w, coded))
            else:
                found[w] = self.merged(w)
        for width, some in by_width.items():
            step = 1 << 18
            for a in range(0, len(some), step // width):
                part = some[a : a + step // width]
                found.update(zip((w for w, _ in part), self.merged_together([c for _, c in part], width), strict=True))
        return found

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        """The ids of each text."""
        return list(self.encoded(texts))

    def encoded(self, texts: list[str | None]):
        """The ids of the texts, one after the other."""
        parts = [self.pieces(t) if t else [] for t in texts]
        missing = set().union(*parts).difference(self.cache)
        if len(self.cache) + len(missing) > CACHE_SIZE:
            self.cache.clear()
            missing = set().union(*parts)
        self.cache.update(self.learn(missing))
        for part in parts:
            yield list(chain.from_iterable(map(self.cache.__getitem__, part)))
        for w in missing:
            if len(w) > LONGEST_SHARED:
                del self.cache[w]

    def decode(self, ids: list[int]) -> str:
        """The text of ids."""
        try:
            coded = b"".join(map(self.bytes_of.__getitem__, ids)) if min(ids, default=0) >= 0 else None
        except IndexError:
            coded = None
        if coded is None:
            coded = b"".join(self.bytes_of[i] for i in ids if 0 <= i < self.size)
        return coded.decode(errors="replace")


def codec(path: str) -> Codec:
    """The codec of a vocabulary, once in each worker."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode_texts(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and ids (an array) of each row."""
    id_type = df.schema[id_col].dataType.simpleString()

    def make():
        own = codec(path)
        return lambda keys, texts: {"id": keys, "ids": own.encode(texts)}

    return map_columns(df.select(id_col, text_col), make, f"id {id_type}, ids array<int>").withColumnRenamed("id", id_col)


def decode_ids(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id and text of each row of ids (null: empty; nulls among ids are left out)."""
    id_type = df.schema[id_col].dataType.simpleString()

    def make():
        own = codec(path)
        return lambda keys, rows: {"id": keys, "text": [own.decode([i for i in ids or [] if i is not None]) for ids in rows]}

    return map_columns(df.select(id_col, ids_col), make, f"id {id_type}, text string").withColumnRenamed("id", id_col)


def token_digests(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids_sha256 (of the decimal ids, comma-joined) and decoded_sha256 (of the text that the ids decode
    to) of each row, encoded and decoded in one pass."""
    id_type = df.schema[id_col].dataType.simpleString()

    def make():
        own = codec(path)

        def step(keys, texts):
            out = {"id": keys, "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
            for ids in own.encoded(texts):
                out["n_tokens"].append(len(ids))
                out["ids_sha256"].append(hashlib.sha256(",".join(map(own.names.__getitem__, ids)).encode()).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(own.decode(ids).encode()).hexdigest())
            return out

        return step

    return map_columns(df.select(id_col, text_col), make, f"id {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)
