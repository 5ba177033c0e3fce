"""Frequent words and their counts.

``frequent_words`` counts the words of all rows in each task. By default it keeps each task's most
frequent ones in a summary of bounded size and adds the summaries up; only summaries move, and
counts are approximate: words of middling frequency may count too low, depending on the partitions.
The most
frequent words of the whole corpus then come to the driver, at most ``top`` of them and none
longer than ``MAX_WORD_BYTES``, which bounds every table broadcast from here.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memspan.llm.durable import stored

MAX_WORD_BYTES = 64
#: A task's counter is pruned to its more frequent half beyond this size.
COUNTER_SIZE = 200_000


def frequent_words(df: DataFrame, text_col: str, words_of: Callable[[str], list[str]], top: int = 32_768, per_task: int = 8_192) -> list[tuple[str, int]]:
    """The ``top`` most frequent words over all rows, most frequent first (ties by word)."""

    def run(batches):
        import pyarrow as pa

        counts: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    counts.update(words_of(text))
            if len(counts) > COUNTER_SIZE:
                counts = Counter(dict(counts.most_common(COUNTER_SIZE // 2)))
        kept = [(w, n) for w, n in counts.most_common(2 * per_task) if len(w.encode(errors="replace")) <= MAX_WORD_BYTES][:per_task]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], names=["word", "n"])

    found = df.select(text_col).mapInArrow(run, "word string, n long")
    return most_frequent(stored(found.groupBy("word").agg(F.sum("n").alias("n")), "words"), "word", top)


def most_frequent(counted: DataFrame, key: str, top: int) -> list[tuple]:
    """The ``top`` rows of a stored table of keys and their counts ``n`` by falling count (ties by key). Counts of
    counts, by eighths of powers of two, tell where to cut first, so that no task sends more than its part."""
    level = F.floor(F.log2("n") * 8)
    sizes = sorted(((r.level, r.rows) for r in counted.groupBy(level.alias("level")).agg(F.count("*").alias("rows")).collect()), reverse=True)
    total, least = 0, 0
    for least, rows in sizes:
        total += rows
        if total >= top:
            break
    return [tuple(r) for r in counted.where(level >= least).orderBy(F.desc("n"), key).limit(top).select(key, "n").collect()]
