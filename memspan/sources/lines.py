"""Lines of text files in the order of the files, which Spark otherwise reads as a bag."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_SUMMARY = "split long, file long, at long, lines long, marks long, head string, head_line long, opening string"
_LINES = "source int, line long, mark boolean, marks long, head string, head_line long, opening string, last boolean, value string"


def ordered_lines(spark: SparkSession, paths: str | list[str], mark: Column, then: Callable[[pa.RecordBatch], pa.RecordBatch] | None = None, schema: str = _LINES) -> DataFrame:
    """source, line (1-based, blank lines left out), mark (of the line), marks (marked lines up to and with this one), head and
    head_line (the last marked line before this one, and its number), opening (the first line of the source that is not marked), last
    (whether it is the source's last line) and value (without blanks at its end) of every line; ``mark`` is a condition on
    column value. With ``then``, what that makes of Arrow batches of these columns, in ``schema``.

    A source is one of the paths, a file or a folder whose files are read on from one to the next (those that Spark has
    written by their numbers, others by name). Files split like any text file. A first pass, made at once, sums up each split in a row;
    added up over the splits of its source, these rows tell a second pass what stands before a split, so what a mark begins may go
    on over splits and files, and no line is shuffled."""
    raw, files = None, []
    for k, path in enumerate([paths] if isinstance(paths, str) else paths):
        text = spark.read.text(path)
        files += [(k, name) for name in text.inputFiles()]
        file, at = F.xxhash64(F.lit(k), F.input_file_name()), F.input_file_block_start()  # a number is much less to hand over than a path
        part = text.select(F.xxhash64(file, at).alias("split"), file.alias("file"), at.alias("at"), F.rtrim("value").alias("value"))
        raw = part if raw is None else raw.unionByName(part)
    raw = raw.where(F.length("value") > 0).withColumn("mark", mark)
    splits = raw.mapInArrow(_summed, _SUMMARY).collect()
    named = spark.createDataFrame(files, "source int, file string").select(F.xxhash64("source", "file"), "source", "file").collect()
    return raw.drop("file", "at").mapInArrow(_Numbered(_before(splits, {r[0]: (r.source, r.file) for r in named}), then), schema)


def _before(splits: list, files: dict[int, tuple[int, str]]) -> dict[int, tuple]:
    """Of each split its source, the lines, the marks and the last mark before it, and the opening and all lines of its source."""
    known, out = {}, {}
    for r in splits:
        source, file = files[r.file]
        number = re.search(r"/part-(\d+)[^/]*$", file)
        known.setdefault(source, []).append((int(number[1]) if number else -1, file, r.at, r))
    for source, rows in known.items():
        rows.sort(key=lambda row: row[:3])
        opening = next((r.opening for *_, r in rows if r.opening is not None), None)
        total, lines, marks, head, head_line = sum(r.lines for *_, r in rows), 0, 0, None, None
        for *_, r in rows:
            out[r.split] = (source, lines, marks, head, head_line, opening, total)
            if r.head is not None:
                head, head_line = r.head, lines + r.head_line
            lines, marks = lines + r.lines, marks + r.marks
    if len(out) != len(splits):
        raise RuntimeError("two splits have one hash")
    return out


def _segments(batch: pa.RecordBatch) -> Iterator[tuple[int, int, int]]:
    """Split, begin and end of the rows of each split; those of one split come together."""
    split = batch.column("split").to_numpy()
    edges = [0, *(np.flatnonzero(split[1:] != split[:-1]) + 1).tolist(), len(split)]
    yield from ((int(split[a]), a, b) for a, b in zip(edges[:-1], edges[1:], strict=True) if a < b)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each split."""
    found: dict = {}

    def out():
        types = (*[pa.int64()] * 5, pa.string(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(found.values(), types, strict=True)], names=list(found))

    for batch in batches:
        for split, a, b in _segments(batch):
            if split != found.get("split"):
                if found:
                    yield out()
                found = {"split": split, "file": batch.column("file")[a].as_py(), "at": batch.column("at")[a].as_py(), "lines": 0, "marks": 0, "head": None, "head_line": None, "opening": None}
            values = batch.column("value").slice(a, b - a)
            mark = batch.column("mark").slice(a, b - a).to_numpy(zero_copy_only=False)
            marked = np.flatnonzero(mark)
            if len(marked):
                found["head"], found["head_line"] = values[int(marked[-1])].as_py(), found["lines"] + int(marked[-1]) + 1
            if found["opening"] is None and len(marked) < b - a:
                found["opening"] = values[int(np.argmin(mark))].as_py()
            found["lines"] += b - a
            found["marks"] += len(marked)
    if found:
        yield out()


class _Numbered:
    """Lines of splits, numbered as they pass; ``known`` tells what stands before a split. ``then`` is handed head and opening as
    dictionaries."""

    def __init__(self, known: dict[int, tuple], then: Callable[[pa.RecordBatch], pa.RecordBatch] | None):
        self.known, self.then = known, then

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current = None
        for batch in batches:
            for split, a, b in _segments(batch):
                if split != current:
                    current = split
                    source, lines, marks, head, head_line, opening, total = self.known[split]
                values, n = batch.column("value").slice(a, b - a), b - a
                flags = batch.column("mark").slice(a, n)
                mark = flags.to_numpy(zero_copy_only=False)
                line = lines + 1 + np.arange(n)
                seen = np.cumsum(mark)
                heads = pa.concat_arrays([pa.array([head], pa.string()), values.filter(flags)])
                at = np.concatenate(([head_line or 0], line[mark]))
                before = seen - mark  # the last marked line before each line, among ``heads``
                columns = {
                    "source": pa.array(np.full(n, source, np.int32)),
                    "line": pa.array(line),
                    "mark": flags,
                    "marks": pa.array(marks + seen),
                    "head": pa.DictionaryArray.from_arrays(pa.array(before.astype(np.int32)), heads),
                    "head_line": pa.array(at[before], mask=(before == 0) & (head is None)),
                    "opening": pa.DictionaryArray.from_arrays(pa.array(np.zeros(n, np.int32)), pa.array([opening], pa.string())),
                    "last": pa.array(line == total),
                    "value": values,
                }
                if not self.then:
                    columns |= {name: columns[name].dictionary.take(columns[name].indices) for name in ("head", "opening")}
                made = pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))
                yield self.then(made) if self.then else made
                lines, marks, head = lines + n, marks + int(seen[-1]), heads[len(heads) - 1].as_py()
                head_line = int(at[-1]) if head is not None else None
