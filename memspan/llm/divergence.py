"""How the sources of a language differ from each other and from the language: exact counts of kept terms.

Two passes over the documents, which are dealt out once into *slots*: the documents of a source in a language, in as many
parts as a bound on a slot's bytes needs (one shuffle of the texts, which both passes read). The first counts in how many documents of a language each term stands; terms in at
least ``min_docs`` of them are kept. Each slot then gets those kept terms that occur in it, and no others, so
that no vocabulary is ever broadcast; the second pass builds an automaton of them, every term with a
delimiter on either side, and counts their occurrences again in one run over each text.

Only counts above zero are kept (postings). A group's smoothed share of a term it lacks is the same for all such terms,
so a sum over all kept terms is a base, plus what postings change against the other group's constant (from the
histogram of a group's shares), plus a correction for terms that both groups have. All arithmetic is in whole numbers.

Defined cases: null text, lang and source are empty strings; documents without terms still make their group; a language
without kept terms has V = 0 and its pairs the value 0; repeated rows count one by one; an empty table gives an
empty one; texts are read whole; only the named columns are read, whatever others there are. Rows alike in id and text
share a slot. Sources of one language are compared in all ordered pairs, because each is a row of the result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memspan.llm.durable import rows_of, stored, trim_memory

#: Bytes of text in a slot, and pairs of a term's groups that are worked on at a time.
SLOT_BYTES, CHUNK_PAIRS = 32_000_000, 1_000_000
#: Terms a task counts before it hands its counts on.
COUNTER_SIZE = 300_000
SCALE = 1_000_000_000

_DELIMITERS = bytes([*range(0x00, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
#: Letters and bytes above ASCII stay, A-Z become small, all else becomes a blank.
_TO_TERMS = bytes(0x20 if b in _DELIMITERS else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """The terms of a text in UTF-8, in order."""
    return text.translate(_TO_TERMS).split()


def _slots(docs: DataFrame, id_col: str, text_col: str, slot_bytes: int) -> DataFrame:
    """lang, source, part and text (as bytes), dealt out by the first three."""
    names = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]
    rows = docs.select(*names, F.xxhash64(id_col, text_col).alias("_hash"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    parts = stored(rows.groupBy("lang", "source").agg(F.ceil((F.sum(F.length("text")) + 1) / slot_bytes).alias("_parts")), "parts")
    rows = rows.join(parts, ["lang", "source"]).select("lang", "source", F.pmod("_hash", "_parts").alias("part"), "text")
    return rows.repartition("lang", "source", "part")


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, source, part, term and in how many of the documents read so far it stands; in parts."""
    trim_memory()
    counts: dict[tuple[str, str, int], Counter] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for (lang, source, part), found in counts.items():
            k = len(found)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * k, pa.string()), pa.array([source] * k, pa.string()), pa.array([part] * k, pa.int64()), pa.array(list(found), pa.binary()).cast(pa.string()), pa.array(list(found.values()), pa.int64())], names=["lang", "source", "part", "term", "n"])
        counts.clear()

    size = 0
    for lang, source, part, text in rows_of(batches):
        counter = counts.setdefault((lang, source, part), Counter())
        size -= len(counter)
        counter.update(set(terms_of(text)))
        size += len(counter)
        if size > COUNTER_SIZE:
            yield from out()
            size = 0
    yield from out()


def _recount(docs: pa.Table, kept: pa.Table) -> pa.Table:
    """lang, source, term, n and new: occurrences of a slot's kept terms, by an automaton of them; ``new`` is passed on."""
    import ahocorasick

    new: dict[str, bool] = {}
    for term, first in zip(kept.column("term").to_pylist(), kept.column("new").to_pylist(), strict=True):
        new[term] = first or new.get(term, False)  # a task may hand its counts on in parts
    terms = list(new)
    counts = [0] * len(terms)
    if terms:
        automaton = ahocorasick.Automaton()
        for i, term in enumerate(terms):
            automaton.add_word(f" {term} ", i)
        automaton.make_automaton()
        for text in docs.column("text"):
            padded = b"".join((b" ", text.as_py().translate(_TO_TERMS), b" ")).decode()
            for _, i in automaton.iter(padded):
                counts[i] += 1
    n = len(terms)
    lang, source = (kept.column(c)[0].as_py() if n else "" for c in ("lang", "source"))
    return pa.table([pa.array([lang] * n, pa.string()), pa.array([source] * n, pa.string()), pa.array(terms, pa.string()), pa.array(counts, pa.int64()), pa.array(list(new.values()), pa.bool_())], names=["lang", "source", "term", "n", "new"])


def _slot_counts(docs: DataFrame, min_docs: int, id_col: str, text_col: str, slot_bytes: int) -> DataFrame:
    """lang, source, term, n, new: occurrences of kept terms in each slot; each kept term is new in one of its language's rows."""
    slots = _slots(docs, id_col, text_col, slot_bytes)
    seen = slots.mapInArrow(_document_counts, "lang string, source string, part long, term string, n long")
    by_term = Window.partitionBy("lang", "term")
    kept = seen.withColumn("_docs", F.sum("n").over(by_term)).withColumn("_place", F.row_number().over(by_term.orderBy("source", "part")))
    kept = kept.where(F.col("_docs") >= min_docs).select("lang", "source", "part", "term", (F.col("_place") == 1).alias("new"))
    slot = ("lang", "source", "part")
    return slots.groupBy(*slot).cogroup(kept.groupBy(*slot)).applyInArrow(_recount, "lang string, source string, term string, n long, new boolean")


def term_counts(docs: DataFrame, min_docs: int = 3, id_col: str = "doc_id", text_col: str = "text", slot_bytes: int = SLOT_BYTES) -> DataFrame:
    """lang, source, term, n: occurrences above zero of every term that at least ``min_docs`` documents of its
    language have."""
    return _slot_counts(docs, min_docs, id_col, text_col, slot_bytes).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"))


def _share(n: Column, total: Column) -> Column:
    """1 + floor(SCALE * (n + 1) / total), exactly; 1 if there is no total."""
    return (F.lit(1) + F.call_function("div", (n.cast("decimal(19,0)") + 1) * F.lit(SCALE), F.greatest(total, F.lit(1)).cast("decimal(19,0)"))).cast("long")


def _term_of_sum(p: Column, q: Column) -> Column:
    """floor((p - q) ** 2 / q)."""
    return F.call_function("div", (p - q) * (p - q), q)


def _common_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, a, b, high, low: for ordered pairs of a language's groups (by their numbers), summed over the terms that
    both have, what the sums by constants get wrong. A sum is high * 2**32 + low, so it is exact whatever its size."""
    sums: dict[tuple[str, int, int], int] = {}

    def add(lang: str, sizes: np.ndarray, group: np.ndarray, p: np.ndarray, p0: np.ndarray) -> None:
        repeats = np.repeat(sizes, sizes)
        left = np.repeat(np.arange(len(group)), repeats)
        begin = np.repeat(np.cumsum(sizes) - sizes, sizes)
        right = np.arange(len(left)) + np.repeat(begin - np.cumsum(repeats) + repeats, repeats)
        keys, place = np.unique(group[left] << 32 | group[right], return_inverse=True)
        high, low = np.zeros(len(left), np.int64), np.zeros(len(left), np.int64)
        for sign, x, y in ((1, p[left], p[right]), (-1, p[left], p0[right]), (-1, p0[left], p[right]), (1, p0[left], p0[right])):
            f = (x - y) ** 2 // y
            high += sign * (f >> 32)
            low += sign * (f & 0xFFFFFFFF)
        total = np.zeros((2, len(keys)), np.int64)
        np.add.at(total[0], place, high)
        np.add.at(total[1], place, low)
        for k, h, w in zip(keys.tolist(), *total.tolist(), strict=True):
            key = lang, k >> 32, k & 0xFFFFFFFF
            sums[key] = sums.get(key, 0) + (h << 32) + w

    for batch in batches:
        langs, lists = batch.column(0).dictionary_encode(), batch.column(1)
        codes = langs.indices.to_numpy()
        sizes = np.diff(lists.offsets.to_numpy()).astype(np.int64)
        values = lists.flatten()
        columns = [values.field(k).to_numpy().astype(np.int64) for k in range(3)]
        ends = np.cumsum(sizes)
        for code, lang in enumerate(langs.dictionary.to_pylist()):
            rows = np.flatnonzero(codes == code)
            cut = np.cumsum(sizes[rows] ** 2) // CHUNK_PAIRS
            for some in np.split(rows, np.flatnonzero(np.diff(cut)) + 1):
                picked = np.concatenate([np.arange(ends[i] - sizes[i], ends[i]) for i in some]) if len(some) else np.zeros(0, np.int64)
                add(lang, sizes[some], *(c[picked] for c in columns))
    rows = [(*k, v >> 32, v & 0xFFFFFFFF) for k, v in sums.items() if k[1] != k[2]]
    columns = list(zip(*rows, strict=True)) or [()] * 5
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), *[pa.int64()] * 4), strict=True)], names=["lang", "a", "b", "high", "low"])


def audit_sources(docs: DataFrame, min_docs: int = 3, ranks: int = 200, id_col: str = "doc_id", text_col: str = "text", slot_bytes: int = SLOT_BYTES) -> DataFrame:
    """lang, source, part, item, value, rank: part ``pair`` tells how far each other source of the language is from
    a source, part ``term`` which terms a source has more of than its language, at most ``ranks`` of them."""
    counts = stored(_slot_counts(docs, min_docs, id_col, text_col, slot_bytes), "counts")
    groups = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    of_group = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count_if("new").alias("_new"))
    sizes = of_group.groupBy("lang").agg(F.sum("_new").alias("V"), F.sum("total").alias("_total"))
    known = groups.join(of_group.drop("_new"), ["lang", "source"], "left").join(sizes, "lang", "left")
    known = known.select("lang", "source", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "V", "_total")))
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("long")  # a row a group
    known = stored(known.withColumn("p0", _share(F.lit(0), F.col("total") + F.col("V"))).withColumn("g", number), "groups")
    # one shuffle, by language and term: a slot's counts are added up by group, then a term's groups are put together
    summed = counts.join(known, ["lang", "source"]).repartition("lang", "term").groupBy("lang", "term", "g").agg(F.sum("n").alias("n"), *(F.first(c).alias(c) for c in ("total", "V", "_total", "p0")))
    summed = summed.withColumn("p", _share(F.col("n"), F.col("total") + F.col("V")))
    postings = summed.groupBy("lang", "term").agg(F.collect_list(F.struct("g", "p", "p0")).alias("groups"), F.sum("n").alias("n"), F.first(F.col("_total") + F.col("V")).alias("_all"))  # at most a language's sources
    postings = stored(postings.select("lang", "term", "groups", _share(F.col("n"), F.col("_all")).alias("q")), "postings")
    names = known.select("lang", "g", "source")
    parts = _pairs(postings, known).withColumn("part", F.lit("pair")).unionByName(_terms(postings, names).withColumn("part", F.lit("term")))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    pairs = parts.where("part = 'pair'").withColumn("rank", rank)
    terms = parts.where("part = 'term'").withColumn("rank", rank).where(F.col("rank") <= ranks)
    return pairs.unionByName(terms).select("lang", "source", "part", "item", "value", "rank")


def _pairs(postings: DataFrame, known: DataFrame) -> DataFrame:
    """lang, source, item, value of every ordered pair of a language's sources."""
    big = "decimal(38,0)"
    other = known.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    both = known.join(other, "lang").where("source <> item")
    base = both.select("lang", "source", "item", (F.col("V").cast(big) * _term_of_sum(F.col("p0"), F.col("q0"))).cast(big).alias("value"))
    shares = postings.select("lang", F.explode("groups").alias("x")).groupBy("lang", "x.g", "x.p", "x.p0").agg(F.count("*").alias("m"))
    shares = shares.join(known.select("lang", "g", "source"), ["lang", "g"]).join(other, "lang").where("source <> item")

    def change(with_share: Column, without: Column) -> Column:
        return (F.col("m").cast("decimal(18,0)") * (with_share - without)).cast(big).alias("value")

    p, p0, q0 = F.col("p"), F.col("p0"), F.col("q0")
    mine = shares.select("lang", "source", "item", change(_term_of_sum(p, q0), _term_of_sum(p0, q0)))
    theirs = shares.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), change(_term_of_sum(q0, p), _term_of_sum(q0, p0)))
    common = postings.where(F.size("groups") > 1).select("lang", "groups").mapInArrow(_common_terms, "lang string, a long, b long, high long, low long")
    named = [known.select("lang", F.col("g").alias(g), F.col("source").alias(name)) for g, name in (("a", "source"), ("b", "item"))]
    common = common.groupBy("lang", "a", "b").agg(F.sum("high").alias("high"), F.sum("low").alias("low")).join(named[0], ["lang", "a"]).join(named[1], ["lang", "b"])
    common = common.select("lang", "source", "item", (F.col("high").cast("decimal(19,0)") * F.lit(1 << 32).cast("decimal(10,0)") + F.col("low")).cast(big).alias("value"))
    summed = base.unionByName(mine).unionByName(theirs).unionByName(common).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    return summed.select("lang", "source", "item", F.col("value").cast("long").alias("value"))


def _terms(postings: DataFrame, names: DataFrame) -> DataFrame:
    """lang, source, item, value of the terms that a source has a larger share of than its language."""
    met = postings.select("lang", "term", "q", F.explode("groups").alias("x")).where("x.p > q").select("lang", "x.g", F.col("term").alias("item"), _term_of_sum(F.col("x.p"), F.col("q")).alias("value"))
    return met.join(names, ["lang", "g"]).select("lang", "source", "item", "value")
