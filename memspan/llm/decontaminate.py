"""Benchmark decontamination by a prefix-filtered containment join.

Words are runs of characters outside ASCII punctuation, with A-Z lower-cased. A *window* is a
run of ``width`` consecutive words of a benchmark item (the whole item if it has fewer). A
window must be contained in a document completely, so in any total order of words its
necessary prefix is its first word: the join looks up just that one. Words are ordered by
rarity over all documents, hence the probe is each window's rarest word. A probe at position
``i`` for a word at place ``p`` of a window of ``m`` words fixes the alignment: positional
bound ``i >= p``, length bound ``i - p + m <= number of words``; then the ``m`` words are
compared one by one.

While the windows take at most ``block_bytes`` (with what Python adds to them) they are broadcast and documents are never
shuffled. A larger benchmark is never gathered: its words are counted by a join with all documents' counts, and windows and documents meet
in a shuffled join. The necessary prefix is then the rarest word with one of its neighbours (the next one, or the one
before at the window's end), which splits what frequent words would gather. A Bloom filter of at most 8 MB holds those
prefixes, so only places of the documents that may have a partner are shuffled, each with the words around it, which decide.
However large the benchmark, documents are read twice: to count words, and to look for prefixes.

Defined cases
* null or wordless document: no words, no hits, clean; null or wordless item: no windows;
* the same window in several items counts for each of them; repeated items count once by id; an item without an id hits
  words, but is not among the items;
* repeated documents are judged one by one; an empty table gives an empty one, an empty benchmark no hits; very long
  texts are judged whole; extra columns, whatever their names, are not read (``drop_contaminated`` returns them
  as they are).
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memspan.llm.durable import free_names, map_columns, rows_of, stored
from memspan.llm.fingerprints import mix
from memspan.llm.membership import bloom_filter, may_hold

WIDTH = 13
BLOCK_BYTES = 32_000_000
#: What a window takes besides its words' bytes: a tuple, a list, a set of items, their entries.
WINDOW_BYTES = 700
#: Every byte that separates words becomes a space; A-Z become a-z.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode(errors="surrogatepass").translate(_TABLE).split() if text else []


def item_windows(words: list[bytes], width: int = WIDTH) -> list[tuple[bytes, ...]]:
    if not words:
        return []
    return [tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]


def benchmark_blocks(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int):
    """Blocks of {window: set of item ids}, each of at most about ``block_bytes``; items are
    streamed to the driver, one partition at a time, and only one block is held."""
    block: dict[tuple[bytes, ...], set[str]] = defaultdict(set)
    size = 0
    for row in benchmark.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t")).toLocalIterator():
        windows = item_windows(words_of(row.t))
        cost = sum(WINDOW_BYTES + sum(map(len, w)) for w in windows)
        if size and size + cost > block_bytes:
            yield dict(block)
            block, size = defaultdict(set), 0
        for w in windows:
            block[w].update(() if row.i is None else (row.i,))
        size += cost
    if block:
        yield dict(block)


def word_frequencies(documents: DataFrame, text_col: str, words: set[bytes]) -> Counter:
    """How often each of ``words`` occurs in all documents: each task adds up its own rows and
    at most one row a word leaves it."""
    wanted = documents.sparkSession.sparkContext.broadcast(frozenset(words))

    def run(batches):
        import pyarrow as pa

        vocabulary, counts = wanted.value, Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts.update(filter(vocabulary.__contains__, words_of(text)))
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    summed = documents.select(text_col).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return Counter({bytes(r.word): r.n for r in summed.collect()})


def all_frequencies(documents: DataFrame, text_col: str) -> DataFrame:
    """(word, n) of all words of all documents, stored."""

    def run(batches):
        import pyarrow as pa

        def told():
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

        counts: Counter = Counter()
        for (text,) in rows_of(batches):
            counts.update(words_of(text))
            if len(counts) >= 500_000:
                yield told()
                counts = Counter()
        yield told()

    return stored(documents.select(text_col).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")


def _index(block: dict[tuple[bytes, ...], set[str]], rarity: Counter) -> dict[bytes, list]:
    """{rarest word: [(its place, window, item ids)]}; ties go to the smaller word."""
    index: dict[bytes, list] = defaultdict(list)
    for window, items in block.items():
        place = min(range(len(window)), key=lambda p: (rarity[window[p]], window[p]))
        index[window[place]].append((place, list(window), sorted(items)))
    return dict(index)


def occurrences(words: list[bytes], index: dict[bytes, list]) -> tuple[list[tuple[int, int]], set[str]]:
    """Covered (start, end) word spans, and the items with a window in ``words``."""
    spans, items = [], set()
    for i, word in enumerate(words):
        if word in index:
            for place, window, ids in index[word]:
                start = i - place
                if start >= 0 and words[start : start + len(window)] == window:
                    spans.append((start, start + len(window)))
                    items.update(ids)
    return spans, items


def united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


def _judge(words: list[bytes], index: dict[bytes, list]) -> tuple:
    """n_words, n_hit, n_items, items, spans, contaminated of one document."""
    spans, items = occurrences(words, index)
    spans = united(spans)
    hit = sum(b - a for a, b in spans)
    return len(words), hit, len(items), sorted(items), [{"start": a, "end": b} for a, b in spans], hit > 0 and 20 * hit >= len(words)


RESULTS = ("n_words", "n_hit", "n_items", "items", "spans", "contaminated")


def _sent_index(documents: DataFrame, block: dict | None, text_col: str):
    index = _index(block, word_frequencies(documents, text_col, {w for window in block for w in window})) if block else {}
    return documents.sparkSession.sparkContext.broadcast(index)


def _first_block(benchmark: DataFrame, item_col: str, item_text_col: str, block_bytes: int) -> tuple[dict | None, bool]:
    """The first block (None without windows), and whether there are others."""
    blocks = benchmark_blocks(benchmark, item_col, item_text_col, block_bytes)
    first, more = next(blocks, None), next(blocks, None) is not None
    blocks.close()
    return first, more


def _prefix_keys(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A key for each word with the next one, and for each word alone."""
    codes = np.fromiter(map(zlib.crc32, words), np.uint64, len(words))
    return mix((codes[:-1] << np.uint64(32)) | codes[1:]).view(np.int64), mix(codes + np.uint64(1 << 40)).view(np.int64)


def _item_windows(benchmark: DataFrame, counts: DataFrame) -> DataFrame:
    """(text_key, key, ahead, m, window) of each window of ``benchmark`` (text_key, text): its prefix's key, the words in
    front of the prefix, all words."""

    def make_places():
        def step(keys, texts):
            for key, text in zip(keys, texts, strict=True):
                words = words_of(text)
                yield {"text_key": [key] * len(words), "place": range(len(words)), "word": words}

        return step

    def make_windows():
        def step(keys, texts, counted):
            for key, text, n in zip(keys, texts, counted, strict=True):
                words = words_of(text)
                pairs, singles = _prefix_keys(words)
                starts = range(max(1, len(words) - WIDTH + 1))
                for at in range(0, len(starts), 10_000):
                    out: dict[str, list] = {"text_key": [], "key": [], "ahead": [], "m": [], "window": []}
                    for i in starts[at : at + 10_000]:
                        window = words[i : i + WIDTH]
                        place = min(range(len(window)), key=lambda p: (n[i + p], window[p]))
                        ahead = max(0, min(place, len(window) - 2))
                        row = (key, pairs[i + ahead] if len(window) > 1 else singles[i], ahead, len(window), b" ".join(window).decode())
                        for name, value in zip(out, row, strict=True):
                            out[name].append(value)
                    yield out

        return step

    places = map_columns(benchmark, make_places, "text_key string, place long, word binary")
    counted = places.join(counts, "word", "left").select("text_key", "place", F.coalesce("n", F.lit(0)).alias("n"))
    lists = counted.groupBy("text_key").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "n"))), lambda x: x["n"]).alias("counts"))
    return map_columns(benchmark.join(lists, "text_key"), make_windows, "text_key string, key long, ahead int, m int, window string")


def _joined(documents: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str) -> DataFrame:
    """The results for a benchmark of any size, by a shuffled join on prefixes."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).alias("text")).where("text IS NOT NULL").withColumn("text_key", F.md5("text"))
    texts = stored(items.select("text_key", "text").dropDuplicates(["text_key"]), "items")
    windows = stored(_item_windows(texts, all_frequencies(documents, text_col)), "windows")
    bits = documents.sparkSession.sparkContext.broadcast(bloom_filter(windows.select("key")))

    def make_probes():
        def step(ids, all_texts, hashes):
            for one, text, hashed in zip(ids, all_texts, hashes, strict=True):
                words = words_of(text)
                yield {"_id": [one], "_text": [hashed], "n_words": [len(words)], "key": [None], "place": [None], "lead": [None], "around": [None]}
                for keys in _prefix_keys(words):
                    near = np.flatnonzero(may_hold(bits.value, keys)) if len(keys) else keys
                    for at in range(0, len(near), 10_000):
                        some = near[at : at + 10_000].tolist()
                        firsts = [max(0, i - WIDTH + 2) for i in some]
                        around = [b" ".join(words[a : i + WIDTH]).decode() for a, i in zip(firsts, some, strict=True)]
                        leads = [i - a for a, i in zip(firsts, some, strict=True)]
                        yield {"_id": [one] * len(some), "_text": [hashed] * len(some), "n_words": [None] * len(some), "key": keys[some], "place": some, "lead": leads, "around": around}

        return step

    kind = documents.schema[id_col].dataType.simpleString()
    schema = f"_id {kind}, _text long, n_words long, key long, place long, lead int, around string"
    probes = stored(map_columns(documents.select(id_col, text_col, F.xxhash64(text_col)), make_probes, schema), "probes")
    met = probes.where("key IS NOT NULL").join(windows.select("key", "ahead", "m", "window").distinct(), "key")
    first = F.col("lead") - F.col("ahead")
    same = F.array_join(F.slice(F.split("around", " "), F.greatest(first, F.lit(0)) + 1, F.col("m")), " ") == F.col("window")
    start = F.col("place") - F.col("ahead")
    hits = stored(met.where((first >= 0) & same).select("_id", "_text", start.alias("start"), (start + F.col("m")).alias("end"), "window"), "hits")
    spans = hits.select("_id", "_text", "start", "end").distinct()
    named = windows.select("window", "text_key").distinct().join(items.select("text_key", "item").where("item IS NOT NULL"), "text_key").select("window", "item").distinct()
    met_items = hits.select("_id", "_text", "window").distinct().join(named, "window").select("_id", "_text", "item").distinct()
    no_items, no_spans = F.array().cast("array<string>"), F.array().cast("array<struct<start:long,end:long>>")
    found = spans.select("_id", "_text", no_items.alias("items"), F.array(F.struct("start", "end")).alias("spans"))
    found = found.unionByName(met_items.select("_id", "_text", F.array("item").alias("items"), no_spans.alias("spans")))
    return _gathered(probes.where("key IS NULL").select("_id", "_text", "n_words"), found)


def contamination(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """id, n_words, n_hit, n_items, items (sorted as strings), spans (hit word intervals),
    contaminated for each row of ``documents``."""
    first, more = _first_block(benchmark, item_col, item_text_col, block_bytes)
    found = _joined(documents, benchmark, id_col, text_col, item_col, item_text_col) if more else _judged(documents, first, id_col, text_col)
    return found.drop("_text").withColumnRenamed("_id", id_col)


def _judged(documents: DataFrame, block: dict | None, id_col: str, text_col: str) -> DataFrame:
    """The same as _id, and _text, a hash of the text, with all windows in one block."""
    kind = documents.schema[id_col].dataType.simpleString()
    schema = f"_id {kind}, _text long, n_words long, n_hit long, n_items long, items array<string>, spans array<struct<start:long,end:long>>, contaminated boolean"
    sent = _sent_index(documents, block, text_col)

    def make():
        look = sent.value

        def step(ids, texts, hashes):
            found = [_judge(words_of(t), look) for t in texts]
            return {"_id": ids, "_text": hashes} | {name: [f[k] for f in found] for k, name in enumerate(RESULTS)}

        return step

    return map_columns(documents.select(id_col, text_col, F.xxhash64(text_col)), make, schema)


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``documents`` that are not contaminated, all columns untouched."""
    first, more = _first_block(benchmark, item_col, item_text_col, block_bytes)
    if not more:
        from pyspark.sql.types import BooleanType

        sent = _sent_index(documents, first, text_col)

        @F.pandas_udf(BooleanType())
        def clean(texts):
            return texts.map(lambda t: not _judge(words_of(t), sent.value)[-1]).astype(bool)

        return documents.where(clean(F.col(text_col)))
    found = _joined(documents, benchmark, id_col, text_col, item_col, item_text_col)
    name, text = free_names(documents, "gone", "text_hash")
    gone = found.where("contaminated").select(F.col("_id").alias(name), F.col("_text").alias(text)).distinct()
    return documents.join(gone, documents[id_col].eqNullSafe(gone[name]) & (F.xxhash64(documents[text_col]) == gone[text]), "left_anti")


def _gathered(documents: DataFrame, found: DataFrame) -> DataFrame:
    """Items and spans, added up for each document (rows alike in id and text share them)."""

    def make():
        def step(ids, texts, items, spans):
            merged = [united([(x["start"], x["end"]) for x in s]) for s in spans]
            return {
                "_id": ids,
                "_text": texts,
                "_items": [sorted(set(i)) for i in items],
                "_spans": [[{"start": a, "end": b} for a, b in m] for m in merged],
                "_hit": [sum(b - a for a, b in m) for m in merged],
            }

        return step

    gathered = found.groupBy("_id", "_text").agg(F.flatten(F.collect_list("items")).alias("items"), F.flatten(F.collect_list("spans")).alias("spans"))
    kind = found.schema["_id"].dataType.simpleString()
    merged = map_columns(gathered, make, f"_id {kind}, _text long, _items array<string>, _spans array<struct<start:long,end:long>>, _hit long")
    merged = merged.withColumnsRenamed({"_id": "_key", "_text": "_hash"})
    rows = documents.join(merged, documents["_id"].eqNullSafe(merged["_key"]) & (documents["_text"] == merged["_hash"]), "left")
    hit = F.coalesce("_hit", F.lit(0)).cast("long")
    return rows.select(
        "_id",
        "_text",
        "n_words",
        hit.alias("n_hit"),
        F.coalesce(F.size("_items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("_items", F.array().cast("array<string>")).alias("items"),
        F.coalesce("_spans", F.array().cast("array<struct<start:long,end:long>>")).alias("spans"),
        ((hit > 0) & (20 * hit >= F.col("n_words"))).alias("contaminated"),
    )
