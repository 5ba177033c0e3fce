"""Threshold-scaled document fingerprints.

A document's fingerprint keeps every hash of its five-word shingles that lies below a fixed
fraction ``1 / SCALE`` of the hash space. The same shingle is kept or dropped everywhere, so
sketches merge by union and estimate containment between documents of very unequal length.
Words are runs of characters other than white space, with A-Z lower-cased; a text of fewer
than five words, but not none, is one shingle.

The fingerprint string is ``<number of distinct shingles>:<digest of all of them>:<kept hashes>``
in hexadecimal and base64; equal texts have equal strings.

Defined cases
* null text: the empty string; without words there are no shingles;
* likeness of two equal fingerprints is 1; otherwise it is 0 if one of the two sketches kept no hash, as happens
  to texts of few shingles;
* repeated rows are fingerprinted one by one; for edits, documents with the same id are ordered
  by a hash of their text, then by text, and a null id comes last;
* an empty table gives an empty one; very long texts are read whole; extra columns, whatever their names, are
  not read.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memspan.llm.durable import ROWS, map_columns, rows_of

SCALE = 8
SHINGLE = 5
#: Bytes kept of a hash in the string.
KEPT_BYTES = 6
_B = np.uint64(0x9E3779B97F4A7C15)
_LIMIT = np.uint64((1 << 64) // SCALE)
_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2^64, and of its inverse."""
    global _powers
    if len(_powers[0]) < n:
        size = max(n, 2 * len(_powers[0]), 4096)
        made = []
        for base in (int(_B), pow(int(_B), -1, 1 << 64)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            made.append(np.multiply.accumulate(steps))
        _powers = made[0], made[1]
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that scatters them."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


#: Spaces beyond ASCII.
_WIDE_SPACES = np.array([0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000], np.uint32)
_tables: list[np.ndarray] = []


def _scattered(codes: np.ndarray) -> np.ndarray:
    """A hash of each character, A-Z as a-z."""
    return mix((codes + np.where((codes >= 65) & (codes <= 90), np.uint32(32), np.uint32(0))).astype(np.uint64) + np.uint64(1))


def _char_tables() -> list[np.ndarray]:
    """For the first 65,536 code points: their hashes, and whether they are spaces (ASCII only, all)."""
    if not _tables:
        codes = np.arange(1 << 16, dtype=np.uint32)
        narrow = (codes == 32) | ((codes >= 9) & (codes <= 13))
        _tables.extend((_scattered(codes), narrow, narrow | np.isin(codes, _WIDE_SPACES)))
    return _tables


def words_at(text: str, wide: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word and where it starts; ``wide`` counts spaces beyond ASCII as
    separators too."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    hashes, *spaces = _char_tables()
    high = len(codes) > 0 and int(codes.max()) >= len(hashes)  # no such character is a space
    low = np.minimum(codes, np.uint32(len(hashes) - 1)) if high else codes
    space = spaces[wide][low]
    edges = np.flatnonzero(np.diff(space, prepend=True, append=True))
    if not len(edges):
        return np.empty(0, np.uint64), edges
    starts, ends = edges[::2], edges[1::2]
    up, down = _power_tables(len(codes) + 1)
    total = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum((_scattered(codes) if high else hashes[low]) * up[: len(codes)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64)), starts


def word_hashes(text: str, wide: bool = True) -> np.ndarray:
    """A 64-bit hash of each word."""
    return words_at(text, wide)[0]


def shingle_hashes(words: np.ndarray, width: int = SHINGLE) -> np.ndarray:
    """A hash of each run of ``width`` words, in order; a shorter text is one run."""
    n = len(words) - width + 1
    if n < 1:
        return np.array([_fold(words)], np.uint64) if len(words) else words
    h = np.zeros(n, np.uint64)
    for i in range(width):
        h = mix(h + words[i : i + n])
    return h


def _fold(words: np.ndarray) -> np.uint64:
    h = np.zeros(1, np.uint64)
    for w in words:
        h = mix(h + w)
    return h[0]


class Sketch:
    """Kept hashes (sorted, distinct), the number of distinct shingles and their digest."""

    def __init__(self, text: str):
        every = np.unique(shingle_hashes(word_hashes(text)))
        self.size = len(every)
        self.digest = hashlib.blake2b(every.tobytes(), digest_size=8).hexdigest()
        self.kept = every[every < _LIMIT] >> np.uint64(64 - 8 * KEPT_BYTES)

    def __str__(self) -> str:
        raw = np.ascontiguousarray(self.kept.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - KEPT_BYTES :]).tobytes()
        return f"{self.size:x}:{self.digest}:{base64.b64encode(raw).decode()}"


def parse(fingerprint: str) -> tuple[int, str, np.ndarray]:
    """Size, digest and kept hashes of a fingerprint string."""
    size, digest, kept = fingerprint.split(":")
    raw = np.frombuffer(base64.b64decode(kept), np.uint8).reshape(-1, KEPT_BYTES)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, 8 - KEPT_BYTES :] = raw
    return int(size, 16), digest, wide.view(">u8").ravel().astype(np.uint64)


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The kept hashes of two documents taken together."""
    return np.union1d(a, b)


def likeness(a: Sketch, b: Sketch) -> tuple[float, float]:
    """Estimated resemblance, and containment in the document with fewer kept hashes."""
    if a.size == b.size and a.digest == b.digest:
        return 1.0, 1.0
    small, large = sorted((a.kept, b.kept), key=len)
    if not len(small):
        return 0.0, 0.0
    at = np.searchsorted(large, small)
    common = int((large[np.minimum(at, len(large) - 1)] == small).sum())
    return common / (len(small) + len(large) - common), common / len(small)


def fingerprint_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and fingerprint of each row; no shuffle."""
    id_type = df.schema[id_col].dataType.simpleString()

    def make():
        return lambda ids, texts: {"id": ids, "fingerprint": [str(Sketch(t or "")) for t in texts]}

    return map_columns(df.select(id_col, text_col), make, f"id {id_type}, fingerprint string").withColumnRenamed("id", id_col)


def edited_text(text: str, following: str) -> str:
    """``text`` with its last third replaced by as much of the start of ``following``."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def _descending(keys: np.ndarray, hashes: np.ndarray, cuts: np.ndarray, parts: np.ndarray) -> np.ndarray:
    """The bucket of each (key, hash) in descending order: a bucket reaches down to its cut, and rows of a cut
    that quantiles met several times go to as many buckets by their hash."""
    if not len(cuts):
        return np.zeros(len(keys), np.int64)
    offsets = np.concatenate((np.cumsum(parts[::-1])[::-1], [0]))  # buckets from each cut on, largest cut first
    at = np.searchsorted(cuts, keys, side="right")  # 0: below all cuts
    equal = (at > 0) & (keys == cuts[at - 1])
    depth = (~hashes.view(np.uint64) ^ np.uint64(1 << 63)) >> np.uint64(32)  # 0 for the largest hash
    return offsets[at] + np.where(equal, (depth.astype(np.int64) * parts[at - 1]) >> 32, 0)


def with_next(df: DataFrame, buckets_per_partition: int = 4) -> DataFrame:
    """Rows (bucket, look, key, hash, n, text) ordered within partitions so that every document of a
    bucket is followed by the next one in descending id; ``look`` marks the copy of the first
    document of the next bucket (of all, after the last) that ends a bucket, and ``n`` counts rows alike.

    Bucket bounds are quantiles of the ids over all rows, so buckets hold about equally many
    documents at any size; an id that fills several buckets is split by the hash of the text, and rows alike in
    both are counted in each task. The text moves once; only one copy a bucket is added to it.
    """
    spark = df.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    lowest = -(2**63)
    text = F.coalesce("text", F.lit(""))
    keyed = df.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(lowest)).alias("key"), F.xxhash64(text).alias("hash"), text.alias("text"))
    count = n * buckets_per_partition
    found = keyed.agg(F.percentile_approx("key", [i / count for i in range(1, count)] or [0.5], 10 * count).alias("q")).first().q or []
    cuts, parts = np.unique(np.array(found, np.int64), return_counts=True)

    def place(ids: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        return _descending(ids, hashes, cuts, parts)

    def firsts(batches):
        import pyarrow as pa

        top: dict[int, tuple[int, int]] = {}
        for batch in batches:
            ids, hashes = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            where = place(ids, hashes)
            order = np.lexsort((hashes, ids, where))
            last = order[np.flatnonzero(np.concatenate((where[order][1:] != where[order][:-1], [True])))] if len(order) else order
            for b, k, h in zip(where[last].tolist(), ids[last].tolist(), hashes[last].tolist(), strict=True):
                top[b] = max(top.get(b, (k, h)), (k, h))
        yield pa.RecordBatch.from_arrays([pa.array(list(top), pa.int32()), pa.array([k for k, _ in top.values()], pa.int64()), pa.array([h for _, h in top.values()], pa.int64())], names=["bucket", "key", "hash"])

    heads = keyed.select("key", "hash").mapInArrow(firsts, "bucket int, key long, hash long").groupBy("bucket").agg(F.max(F.struct("key", "hash")).alias("first"))
    order = sorted((r.bucket, (r.first["key"], r.first["hash"])) for r in heads.collect())  # one row a bucket
    looks = {first: order[i - 1][0] for i, (_, first) in enumerate(order)}
    look_hashes = np.array(sorted({h for _, h in looks}), np.int64)

    def deal(batches):
        import pyarrow as pa

        for batch in batches:
            ids, hashes = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            group = np.lexsort((hashes, ids))  # rows alike in id and hash of the text are one
            new = np.concatenate((ids[group][1:] != ids[group][:-1], [True])) | np.concatenate((hashes[group][1:] != hashes[group][:-1], [True])) if len(group) else np.empty(0, bool)
            last = np.flatnonzero(new)
            one, times = group[last], np.diff(np.concatenate(([-1], last)))
            extra = np.array([i for i in np.flatnonzero(np.isin(hashes[one], look_hashes)).tolist() if (int(ids[one[i]]), int(hashes[one[i]])) in looks], np.int64)
            rows = pa.array(np.concatenate([one, one[extra]]))
            bucket = np.concatenate([place(ids[one], hashes[one]), [looks[int(ids[one[i]]), int(hashes[one[i]])] for i in extra]]).astype(np.int32)
            look = np.concatenate([np.zeros(len(one), bool), np.ones(len(extra), bool)])
            many = np.concatenate([times, np.ones(len(extra), np.int64)])
            yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(look), *(batch.column(i).take(rows) for i in (0, 1)), pa.array(many), batch.column(2).take(rows)], names=["bucket", "look", "key", "hash", "n", "text"])

    dealt = keyed.mapInArrow(deal, "bucket int, look boolean, key long, hash long, n long, text string")
    return dealt.repartition(n, "bucket").sortWithinPartitions("bucket", "look", F.desc("key"), F.desc("hash"), F.desc("text"))


def fingerprint_edits(df: DataFrame) -> DataFrame:
    """For each row with ``doc_id`` and ``text``: doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next (resemblance), contained_edited and
    contained_next (containment in the smaller sketch)."""
    names = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "contained_edited", "contained_next")
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, contained_edited double, contained_next double"

    def run(batches):
        import pyarrow as pa

        types = dict(zip(names, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.float64(), pa.float64()), strict=True))
        waiting = None  # the document whose next one has not come yet
        out: dict[str, list] = {n: [] for n in names}

        def told():
            return pa.RecordBatch.from_arrays([pa.array(out[n], types[n]) for n in names], names=list(names))

        def pair(key, old, sketch, text, following):
            edited = edited_text(old, text)
            other = Sketch(edited)
            near, part = likeness(sketch, other)
            near_next, part_next = likeness(sketch, following)
            return None if key == -(2**63) else key, len(old), hashlib.sha256(edited.encode(errors="surrogatepass")).hexdigest(), str(sketch), str(other), near, near_next, part, part_next

        for bucket, look, key, _, many, text in rows_of(batches):
            if waiting is None and look:
                continue  # a further copy of an id that ends the bucket
            now = bucket, key, text, Sketch(text)
            rows = []
            if waiting is not None:
                rows.append(pair(waiting[1], waiting[2], waiting[3], text, now[3]))
            if many > 1 and not look:  # rows alike follow each other
                rows += [pair(key, text, now[3], text, now[3])] * (many - 1)
            for made in rows:
                for name, value in zip(names, made, strict=True):
                    out[name].append(value)
            if len(out["doc_id"]) >= ROWS:
                yield told()
                out = {n: [] for n in names}
            waiting = None if look else now
        yield told()

    return with_next(df).mapInArrow(run, schema)
