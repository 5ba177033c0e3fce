"""Match files: blocks of ``>query`` or ``>query Reverse`` followed by tab-separated matches.

With one reference a row is ``ref_pos query_pos len``; with several the reference's name stands in
front, after a blank. A block without matches is its header alone.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memspan.sources.lines import ordered_lines

REVERSE = " Reverse"


def output_name(reference_path: str, extra: str = "-mems.txt") -> str:
    """The default target beside a reference file: its name without extension, then ``extra``."""
    return os.path.splitext(reference_path)[0] + extra


def output_names(paths: Column, extra: str = "-mems.txt") -> Column:
    """The same for a column of paths: what is behind the last dot goes, if a name stands in front of it."""
    return F.concat(F.regexp_replace(paths, r"(?<=[^/.])\.[^/.]*$", ""), F.lit(extra))


#: The order of a match file's lines: blocks, in each its header, then from the query's end to its start, longer ones first.
def _file_order() -> list[Column]:
    return [F.col("query_ord"), F.col("strand"), F.col("body"), F.desc("query_pos"), F.desc("len"), F.col("ref_ord"), F.col("ref_pos")]


#: Bytes of the references' names up to which they are broadcast, and of a name besides its letters.
NAME_BYTES, ROW_BYTES = 128_000_000, 64


def match_lines(matches: DataFrame, queries: DataFrame, refs: DataFrame, both_strands: bool = False) -> DataFrame:
    """query_ord, strand, body (0 for headers), query_pos, len, ref_ord, ref_pos, label (a header, or the reference's name, null
    with one reference): every line of a match file and what it is ordered by.

    ``queries`` and ``refs`` have id, name and, if their order is not that of their ids, ord. Nothing is numbered, so a block of any size is
    spread over tasks when the lines are sorted. Matches meet the queries only for an order of their own, and names
    that fit are sent to them.
    """
    own = "ord" in queries.columns
    blocks = queries.select(F.col("id").alias("query_id"), F.col("ord" if own else "id").alias("query_ord"), "name", F.explode(F.array(*(F.lit(s) for s in ("+-" if both_strands else "+")))).alias("strand"))
    title = F.concat(F.lit(">"), "name", F.when(F.col("strand") == "-", REVERSE).otherwise(""))
    none = [F.lit(None).cast("long").alias(n) for n in ("query_pos", "len", "ref_ord", "ref_pos")]
    heads = blocks.select("query_ord", "strand", F.lit(0).alias("body"), *none, title.alias("label"))
    known = refs.select(F.col("id").alias("ref_id"), F.col("name").alias("ref_name"), F.col("ord" if "ord" in refs.columns else "id").cast("long").alias("ref_ord"))
    told = known.agg(F.count("*").alias("n"), F.sum(F.octet_length("ref_name") + ROW_BYTES).alias("bytes")).first()
    named = matches.join(F.broadcast(known) if (told.bytes or 0) <= NAME_BYTES else known, "ref_id")
    named = named.join(queries.select(F.col("id").alias("query_id"), F.col("ord").alias("query_ord")), "query_id") if own else named.withColumn("query_ord", F.col("query_id"))
    label = F.col("ref_name") if told.n > 1 else F.lit(None).cast("string")
    return heads.unionByName(named.select("query_ord", "strand", F.lit(1).alias("body"), F.col("query_pos").cast("long"), F.col("len").cast("long"), "ref_ord", F.col("ref_pos").cast("long"), label.alias("label")))


def _numbers() -> Column:
    return F.concat_ws("\t", F.col("ref_pos").cast("string"), F.col("query_pos").cast("string"), F.col("len").cast("string"))


def _write_ordered(lines: DataFrame, order: list[Column], path: str) -> None:
    """A folder of text files whose lines, file by file, are in order; a block may go on in the next file. Lines are made of body, label
    and numbers when they are in order, so that they are not shuffled besides these."""
    match = F.concat(F.coalesce(F.concat(F.lit(" "), "label", F.lit("\t")), F.lit("")), _numbers())
    value = F.when(F.col("body") == 0, F.col("label")).otherwise(match)
    lines.repartitionByRange(*order).sortWithinPartitions(*order).select(value.alias("value")).write.mode("overwrite").text(path)


def write_matches(lines: DataFrame, path: str) -> None:
    """Writes the lines of :func:`match_lines` in their order."""
    _write_ordered(lines, _file_order(), path)


#: What lines are: headers, matches, and in the place of a block without matches, one of it.
HEAD, MATCH, EMPTY = 0, 1, 2
_TYPES = {"source": "int", "kind": "byte", "block": "long", "line": "long", "label": "string", "query_name": "string", "strand": "string", "ref_name": "string", "place": "long", "ref_pos": "long", "query_pos": "long", "len": "long", "wrong": "string"}
_MATCH = re.compile(r"\s*(?:(.*\S)\s+)?(\d+)\s+(\d+)\s+(\d+)\s*", re.ASCII)


def _fields(values: pa.Array) -> tuple[pa.Array, list[pa.Array]]:
    """ref_name and three numbers of each line, all null where it is no match: at once if all are written with tabs, else one by one."""
    parts = pc.split_pattern(values, "\t", max_splits=3, reverse=True)
    width = parts.value_lengths()[0].as_py() if len(values) else 0
    if width in (3, 4) and pc.all(pc.equal(parts.value_lengths(), width)).as_py():
        flat, rows = parts.flatten(), np.arange(len(values)) * width
        numbers = [flat.take(pa.array(rows + width - 3 + k)) for k in range(3)]
        if all(pc.all(pc.ascii_is_decimal(x)).as_py() for x in numbers):
            names = pc.ascii_trim_whitespace(flat.take(pa.array(rows))) if width == 4 else pa.nulls(len(values), pa.string())
            return pc.if_else(pc.equal(names, ""), None, names), [x.cast(pa.int64()) for x in numbers]
    found = [m.groups() if (m := _MATCH.fullmatch(v)) else (None,) * 4 for v in values.to_pylist()]
    columns = list(zip(*found, strict=True)) or [()] * 4
    return pa.array(columns[0], pa.string()), [pa.array([None if x is None else int(x) for x in c], pa.int64()) for c in columns[1:]]


class _Parser:
    """The wanted ones of the columns of ``_TYPES`` of numbered lines (:func:`memspan.sources.lines.ordered_lines`) of one split, for the wanted
    kinds. A header tells of the one before it, or of itself at the source's end, if that has no matches; label is the header or the
    match's reference."""

    def __init__(self, kinds: tuple[int, ...], wanted: list[str]):
        self.kinds, self.wanted = kinds, wanted

    def __call__(self, rows: pa.RecordBatch) -> pa.RecordBatch:
        mark, line, marks = (rows.column(n).to_numpy(zero_copy_only=False) for n in ("mark", "line", "marks"))
        before = pc.fill_null(rows.column("head_line"), -1).to_numpy(zero_copy_only=False)
        values, head = rows.column("value"), rows.column("head")
        # headers: all those of these lines, behind the last one before them
        heads, at = np.flatnonzero(mark), np.flatnonzero(~mark)
        known = head.dictionary
        of = head.indices.to_numpy()
        backward = pc.ends_with(known, REVERSE)
        title = pc.utf8_slice_codeunits(known, 1)
        names = pc.if_else(backward, pc.utf8_slice_codeunits(title, 0, -len(REVERSE)), title)
        strands = pc.if_else(pc.fill_null(backward, False), "-", "+")
        none = pa.nulls

        def part(kind, rows_at, block, of, place, more):
            n = len(rows_at)
            of = pa.array(of)
            made = {"source": lambda: rows.column("source").take(pa.array(rows_at)), "kind": lambda: pa.array(np.full(n, kind, np.int8)), "block": lambda: pa.array(block), "line": lambda: pa.array(line[rows_at])}
            made |= {"query_name": lambda: names.take(of), "strand": lambda: strands.take(of), "place": lambda: pa.array(place), "label": lambda: known.take(of)}
            made |= {n_: lambda: none(n, pa.string()) for n_ in ("ref_name", "wrong")} | {n_: lambda: none(n, pa.int64()) for n_ in ("ref_pos", "query_pos", "len")}
            return [(made | more)[name]() for name in self.wanted]

        parts = []
        if HEAD in self.kinds:
            parts.append(part(HEAD, heads, marks[heads], of[heads] + 1, np.zeros(len(heads), np.int64), {}))
        if MATCH in self.kinds:
            ref_name, numbers = _fields(values.take(pa.array(at)))
            named = pc.is_valid(_fields(rows.column("opening").dictionary)[0])[0].as_py() if len(at) else False
            bad = pc.is_null(numbers[0]).to_numpy(zero_copy_only=False) | (marks[at] < 1) | (pc.is_valid(ref_name).to_numpy(zero_copy_only=False) != named)
            wrong = pc.if_else(pa.array(bad), values.take(pa.array(at)), None) if bad.any() else none(len(at), pa.string())
            more = {"ref_name": lambda: ref_name, "label": lambda: ref_name, "wrong": lambda: wrong} | {n: (lambda x=x: x) for n, x in zip(("ref_pos", "query_pos", "len"), numbers, strict=True)}
            parts.append(part(MATCH, at, marks[at], of[at], line[at] - before[at], more))
        if EMPTY in self.kinds:
            bare = heads[before[heads] == line[heads] - 1]
            bare = bare[before[bare] > 0]
            parts.append(part(EMPTY, bare, marks[bare] - 1, of[bare], np.ones(len(bare), np.int64), {}))
            end = heads[rows.column("last").to_numpy(zero_copy_only=False)[heads]]
            parts.append(part(EMPTY, end, marks[end], of[end] + 1, np.ones(len(end), np.int64), {}))
        return pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in zip(*parts, strict=True)], names=self.wanted)


def _parsed(spark: SparkSession, paths: str | list[str], kinds: tuple[int, ...], *wanted: str) -> DataFrame:
    """The ``wanted`` columns of ``_TYPES`` for headers, matches and blocks without any. A line that is no match,
    stands before its source's first header or has a name where the source's first match has none (or none where it
    has one) is an error when it is read."""
    columns = [*wanted, *(n for n in ("line", "wrong") if n not in wanted)]
    rows = ordered_lines(spark, paths, F.col("value").startswith(">"), _Parser(kinds, columns), ", ".join(f"{n} {_TYPES[n]}" for n in columns))
    said = F.raise_error(F.concat(F.lit("not a match line: "), F.col("wrong"), F.lit(" (line "), F.col("line").cast("string"), F.lit(")")))
    return rows.withColumn("ref_pos", F.when(F.col("wrong").isNotNull(), said.cast("long")).otherwise(F.col("ref_pos"))).select(*wanted)


def read_matches(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """source, block (1-based), query_name, strand, ref_name (null with one reference), place, ref_pos,
    query_pos, len; a block without matches is a row with null positions.

    A line that begins with ``>`` is a header; reference names may hold blanks. Files are read line by line in
    splits, a block of any size is never held whole, and it may span files of a folder. Malformed lines are errors.
    """
    return _parsed(spark, paths, (MATCH, EMPTY), "source", "block", "query_name", "strand", "ref_name", "place", "ref_pos", "query_pos", "len")


def sort_match_file(spark: SparkSession, path: str, target: str | None = None) -> str:
    """Writes each block's matches in descending order of reference name, reference position and
    query position; returns where. ``path`` is a file or a folder of files; one without any match is an error."""
    target = target or output_name(path, "-sorted.txt")
    bodies = spark.read.text(path).where(~F.col("value").startswith(">") & (F.length(F.rtrim("value")) > 0))
    if bodies.limit(1).count() == 0:
        raise ValueError(f"no matches in {path}")
    lines = _parsed(spark, path, (HEAD, MATCH), "block", "kind", "label", "ref_pos", "query_pos", "len", "line").withColumnRenamed("kind", "body")
    _write_ordered(lines, [F.col("block"), F.col("body"), F.desc("label"), F.desc("ref_pos"), F.desc("query_pos"), F.col("line")], target)
    return target
