"""Best-fit packing by hierarchical residual packing.

Documents are tokenised in one map-side pass: the tokenizer drops white space, so a text's
tokens are those of its blank-separated words. The distinct words of many texts are looked up at once, and
each Python worker keeps the ids of words it has met (``cache_size`` of them, and as many pre-tokens, then it starts anew). Pieces of the full sequence length are
sequences by themselves. All other pieces go through rounds:

1. items are dealt to tasks of about ``items_per_task``, whatever their number;
2. each task packs its items best-fit, largest first;
3. bins filled to ``full`` or more are final and leave; the others become the items of the
   next round, with an eighth of the tasks (a tree), until one task has held them all or a round at
   the least number of tasks saves no bin.

A task never holds more than its share, since the number of tasks follows the number of items.
A bin carries its pieces (at most as many as it has tokens). Each round is written to the
shared checkpoint folder, so a lost executor repeats no packing decision.

Defined cases: a null text is the empty string, which is one piece holding just the separator;
repeated rows are packed as documents of their own (their ids are then repeated too); ties in
length go by id, piece and checksum, so the result does not depend on the order of rows; an
empty table packs into nothing; very long texts are cut into pieces, never shortened; extra columns, whatever
their names, are not read. A tokenizer that does not lower-case, split and mark words like the one this was written for is
found out by probes when it is loaded, and each text then goes to it whole.
"""

from __future__ import annotations

import gc
import re
import zlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memspan.llm.durable import map_columns, stored

CAPACITY = 2048
ITEMS_PER_TASK = 50_000
CACHE_SIZE = 500_000
#: Characters of the texts that are encoded together (a longer text goes alone): each distinct word of
#: them is looked up once.
TOGETHER = 5_000_000
#: What the tokenizer's pattern regards as white space, where Python's split differs from it.
_ODD_SPACE = re.compile("[\x1c-\x1f]")
_BLANKS = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
#: Characters whose lower case is one character and that no normalisation changes.
_PLAIN = re.compile("[ -~\xa1-\xac\xae-\u0129\u0131-\u024f\u2010-\u2027\u2030-\u205e\u20ac]*")
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Fixed value: the tokenizer's own pattern.
_PRE_TOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
_state: dict = {}


class WordTokens:
    """Little-endian ids of texts, by two caches: of blank-separated words, and of the tokenizer's own
    pre-tokens (runs of letters, digits and other characters), from which new words are put
    together. New pre-tokens go to the library many at once, with blanks between them; the
    end-of-word mark of the tokens tells them apart again."""

    def __init__(self, path: str, cache_size: int | None = None):
        import os

        self.limit = cache_size or CACHE_SIZE

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        self.merges = Tokenizer(self.library.model)  # for text that is normalised and split already
        self.merges.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        vocabulary = self.library.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.cache: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {"": b""}
        self.fast = True
        self.fast = self._as_expected()

    def _as_expected(self) -> bool:
        """Whether the fast path gives the library's own ids for texts of all sorts."""
        probes = ["", " a", "Hello, World's 123rd \"x-y_z\" I'll we've DON'T", "na\u00efve \u00c9COLE \u6f22\u5b57 \U0001f600 e\u0301", "a\u00a0b\u3000c\x1cd \u0130 \ufb01 \u00df", "x" * 300 + " 12.50%...", "<|endoftext|> </w> a</w>b", "tab\tnew\nline  two "]
        try:
            found = self._encode(probes * 2)
        except (KeyError, IndexError, ValueError):
            return False
        self.cache, self.pieces = {}, {"": b""}
        return found == [self.whole(p) for p in probes * 2]

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text; a text that contains a special token goes to the library whole."""
        gc.disable()  # nothing here is cyclic, and the caches are large to walk through
        try:
            return self._encode(texts)
        finally:
            gc.enable()

    def _encode(self, texts: list[str]) -> list[bytes]:
        if not self.fast:
            return [self.whole(t) for t in texts]
        words, counts, alone = [], [], {}
        for i, t in enumerate(texts):
            before = len(words)
            if "<|" in t and any(s in t for s in self.special):
                alone[i] = self.whole(t)
            elif _ODD_SPACE.search(t):
                words += [w for w in _BLANKS.split(t) if w]
            else:
                words += (t.lower() if t.isascii() else t).split()
            counts.append(len(words) - before)
        found = pa.array(words, pa.large_string()).dictionary_encode()
        which, distinct = found.indices.to_numpy(), found.dictionary.to_numpy(zero_copy_only=False).tolist()
        del words, found
        if len(self.cache) > self.limit:
            self.cache.clear()
        known = list(map(self.cache.get, distinct))
        holes = [i for i, k in enumerate(known) if k is None]
        if holes:
            missing = [distinct[i] for i in holes]
            self._learn(missing)
            for i, w in zip(holes, missing, strict=True):
                known[i] = self.cache[w] if len(w) <= 256 else self.cache.pop(w)
        # the ids of all words, one after the other
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // 4
        each = sizes[which]
        ids = np.frombuffer(b"".join(known), "<u4")
        ends = np.cumsum(each)
        raw = ids[np.arange(each.sum()) + np.repeat((np.cumsum(sizes) - sizes)[which] - ends + each, each)].tobytes()
        edges = (4 * np.concatenate(([0], ends))[np.cumsum([0, *counts])]).tolist()
        return [alone.get(i, raw[lo:hi]) for i, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False))]

    def _learn(self, words: list[str]) -> None:
        """Puts ``words`` into the cache. Most are a run of letters with marks behind it."""
        plain = words if _PLAIN.fullmatch(" ".join(words)) else [w for w in words if _PLAIN.fullmatch(w)]
        cores = [w.rstrip(_MARKS) for w in plain]
        simple = [c.isalpha() for c in cores]
        mixed = [w for w, s in zip(plain, simple, strict=True) if not s]
        regular = plain if not mixed else [w for w, s in zip(plain, simple, strict=True) if s]
        if mixed:
            cores = [c for c, s in zip(cores, simple, strict=True) if s]
        tails = [w[len(c) :] for w, c in zip(regular, cores, strict=True)]
        cores = [c.lower() for c in cores]
        split = [_PRE_TOKEN.findall(w.lower()) for w in mixed]
        if len(self.pieces) > self.limit:
            self.pieces = {"": b""}
        pieces, cache = self.pieces, self.cache
        missing = list(set(cores).union(tails, *split).difference(pieces))
        for at in range(0, len(missing), 1000):
            part = missing[at : at + 1000]
            ids = np.array(self.merges.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(part):
                raw, ends = ids.tobytes(), (ends * 4).tolist()
                pieces.update(zip(part, [raw[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)], strict=True))
            else:  # never met; the library decides one by one
                pieces.update((p, self.whole(p)) for p in part)
        cache.update(zip(regular, [pieces[c] + pieces[t] for c, t in zip(cores, tails, strict=True)], strict=True))
        cache.update((w, b"".join([pieces[x] for x in p])) for w, p in zip(mixed, split, strict=True))
        if plain is not words:
            cache.update((w, self.whole(w)) for w in words if w not in cache)


def _together(texts: list) -> list[tuple[int, int]]:
    """Ranges of ``texts`` of about ``TOGETHER`` characters at most, or of one longer text."""
    out, lo, held = [], 0, 0
    for i, t in enumerate(texts):
        held += len(t or "")
        if held > TOGETHER and i > lo:
            out.append((lo, i))
            lo, held = i, len(t or "")
    return [*out, (lo, len(texts))] if texts else out


def token_pieces(df: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", separator: int = 0, cache_size: int = CACHE_SIZE) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every piece of every row; the separator id
    ends each document."""
    kind = df.schema[id_col].dataType.simpleString()

    def make():
        key = tokenizer_path, cache_size
        tokens = _state.get(key) or _state.setdefault(key, WordTokens(*key))
        end = separator.to_bytes(4, "little")

        def step(ids, texts):
            out: dict[str, list] = {c: [] for c in ("doc_id", "piece", "start", "length", "ids_crc32")}
            for lo, hi in _together(texts):
                for doc, raw in zip(ids[lo:hi], tokens.encode([t or "" for t in texts[lo:hi]]), strict=True):
                    raw += end
                    for piece, start in enumerate(range(0, len(raw), 4 * capacity)):
                        part = raw[start : start + 4 * capacity]
                        for name, value in zip(out, (doc, piece, start // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                            out[name].append(value)
            return out

        return step

    return map_columns(df.select(id_col, text_col), make, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long").withColumnRenamed("doc_id", id_col)


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins (lists of positions in ``sizes``, which descend): each item goes where it leaves the
    least room, into the bin opened first among equals. A bit set of the rooms in use finds it."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0
    for i, size in enumerate(sizes):
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
            bins[b].append(i)
            room -= size
        else:
            b = len(bins)
            bins.append([i])
            room = capacity - size
        if room:
            by_room[room].append(b)
            rooms |= 1 << room
    return bins


_MEMBER = "struct<doc_id:{0},piece:int,start:long,length:long,ids_crc32:long,offset:long>"


def pack(pieces: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", items_per_task: int = ITEMS_PER_TASK, full: float = 0.995, fan_in: int = 8) -> DataFrame:
    """``pieces`` with sequence_id and offset: every piece in one sequence of at most
    ``capacity`` tokens, side by side from 0."""
    kind = pieces.schema[id_col].dataType.simpleString()
    members = _MEMBER.format(kind)
    pieces = pieces.withColumnRenamed(id_col, "doc_id")
    order = ("doc_id", "piece", "start", "length", "ids_crc32", "offset")
    pieces = pieces.select(*order[:-1], F.lit(0).cast("long").alias("offset"))
    complete = pieces.where(F.col("length") >= capacity).select(F.array(F.struct(*order)).alias("members"))
    items = pieces.where(F.col("length") < capacity).select(F.col("length").alias("size"), F.array(F.struct(*order)).alias("members"))
    done = [complete]
    enough = int(full * capacity)
    count, tasks = items.count(), None
    while count:
        least = -(-count // items_per_task)
        tasks = least if tasks is None else max(least, -(-tasks // fan_in))
        packed = stored(_packed(items, tasks, capacity, members), "bins")
        left = packed.where(F.col("size") < enough)
        after = left.count()
        done.append(packed.where(F.col("size") >= enough).select("members"))
        bins = packed.count()
        if tasks == 1 or (tasks == least and bins == count):
            done.append(left.select("members"))
            break
        items, count = left, after
    bins = done[0]
    for more in done[1:]:
        bins = bins.unionByName(more)
    bins = bins.select(F.monotonically_increasing_id().alias("sequence_id"), "members")
    placed = bins.select("sequence_id", F.explode("members").alias("m"))
    return placed.select(*(F.col(f"m.{c}").alias(id_col if c == "doc_id" else c) for c in order[:-1]), "sequence_id", "m.offset")


def _packed(items: DataFrame, tasks: int, capacity: int, members: str) -> DataFrame:
    """Bins (size, members) of the items dealt to each of ``tasks`` tasks."""

    def run(batches):
        import pyarrow as pa

        sizes: list[int] = []
        held: list[list] = []
        schema = None
        for batch in batches:
            schema = batch.schema
            sizes += batch.column(0).to_pylist()
            held += batch.column(1).to_pylist()
        if not sizes:
            return
        by = sorted(range(len(sizes)), key=lambda i: (-sizes[i], [(m["doc_id"] is None, m["doc_id"] or 0, m["piece"], m["ids_crc32"]) for m in held[i]]))
        bins = best_fit([sizes[i] for i in by], capacity)
        for at in range(0, len(bins), 10_000):
            filled, contents = [], []
            for b in bins[at : at + 10_000]:
                size, inside = 0, []
                for i in b:
                    inside += [m | {"offset": m["offset"] + size} for m in held[by[i]]]
                    size += sizes[by[i]]
                filled.append(size)
                contents.append(inside)
            yield pa.RecordBatch.from_arrays([pa.array(filled, schema.field(0).type), pa.array(contents, schema.field(1).type)], schema=schema)

    seed = F.xxhash64(F.col("members")[0]["doc_id"], F.col("members")[0]["piece"], F.col("members")[0]["ids_crc32"])
    dealt = items.select("size", "members").repartition(tasks, seed) if tasks > 1 else items.select("size", "members").repartition(1)
    return dealt.mapInArrow(run, f"size long, members array<{members}>")


def pack_documents(df: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", cache_size: int = CACHE_SIZE) -> DataFrame:
    """Tokenises and packs ``df``: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(stored(token_pieces(df, tokenizer_path, capacity, id_col, text_col, cache_size=cache_size), "pieces"), capacity, id_col)
