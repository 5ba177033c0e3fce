"""Sequence files: records that begin with ``>``, a header line and a body.

Files are read with ``>`` as the record separator, so they split like any text file and no file is
held whole. A record's ordinal in its file comes from the number of records in each split,
counted without shuffling any body.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memspan.functions.sequences import normalize, normalize_name
from memspan.operators.pieces import merged_pieces
from memspan.plans.tables import stored

#: Letters of a line, and lines that are wrapped together.
LINE, LINES = 100, 64


def _records(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """file, ord, name and body of every record, as they stand in the files."""
    raw = spark.read.option("lineSep", ">").text(paths)
    raw = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_at"), F.monotonically_increasing_id().alias("_id"), "value")
    splits = raw.groupBy("file", "_at").agg(F.min("_id").alias("_from"), F.count("*").alias("_n"), F.min_by(F.length("value"), "_id").alias("_lead"))
    order = Window.partitionBy("file").orderBy("_at")
    before = F.coalesce(F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    splits = splits.select("file", "_at", "_from", before.alias("_before"), F.first("_lead").over(order).alias("_lead")).where("_lead = 0")  # nothing may stand before the first '>'
    rows = raw.join(F.broadcast(splits), ["file", "_at"]).withColumn("ord", F.col("_before") + F.col("_id") - F.col("_from")).where("ord > 0")
    header = F.regexp_extract("value", r"^([^\n\r]*)", 1)
    return rows.select("file", "ord", header.alias("name"), F.substr("value", F.length(header) + 1).alias("body"))


def read_fasta(spark: SparkSession, paths: str | list[str], acgt_only: bool = False, min_size: int = 0, name_contains: str | None = None) -> DataFrame:
    """file, ord (1-based in its file), name, chars, size.

    ``>`` begins a record even inside a line; the header ends at the first line feed or carriage
    return; bodies are normalised (see :func:`memspan.functions.sequences.normalize`). A file whose
    first byte is not ``>`` has no records. Filters apply in this order: name, empty, size.
    """
    rows = _records(spark, paths)
    if name_contains is not None:
        rows = rows.where(F.col("name").contains(name_contains))
    rows = rows.select("file", "ord", "name", normalize(F.col("body"), acgt_only).alias("chars")).withColumn("size", F.length("chars").cast("long"))
    return rows.where((F.col("size") > 0) & (F.col("size") >= min_size))


def _own_order(files: DataFrame) -> DataFrame:
    """file and _from: where a file's records begin among those of all files, in the order of their names."""
    sizes = files.groupBy("file").agg(F.max("ord").alias("_n"))  # a row a file
    order = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select("file", F.coalesce(F.sum("_n").over(order), F.lit(0)).alias("_from"))


def cleaned_records(spark: SparkSession, path: str) -> DataFrame:
    """id (over all files of ``path``, by name and place), chars (A, C, G and T only) and printable (how many printable characters
    there were) of every record."""
    rows = _records(spark, path)
    rows = rows.join(F.broadcast(_own_order(rows.select("file", "ord"))), "file")
    return rows.select((F.col("_from") + F.col("ord")).alias("id"), normalize(F.col("body"), acgt_only=True).alias("chars"), F.length(normalize_name(F.col("body"), 2)).alias("printable"))


def clean_counts(records: DataFrame, name: str) -> DataFrame:
    """name, kept, removed, records of cleaned records: one row."""
    kept = F.coalesce(F.sum(F.length("chars")), F.lit(0))
    return records.agg(kept.alias("kept"), (F.coalesce(F.sum("printable"), F.lit(0)) - kept).alias("removed"), F.count("*").alias("records")).select(F.lit(name).alias("name"), "kept", "removed", "records")


def wrapped_lines(records: DataFrame, name: str, width: int = LINE) -> DataFrame:
    """place and value: the header ``>name`` and the lines of ``width`` letters of all records joined in the order of their
    ids, several lines to a value. The joined text is wrapped by pieces that are made of whole lines, so no row holds all of it."""
    size = width * LINES
    pieces = merged_pieces(records.select("id", "chars"), "", size=size)
    body = pieces.select((F.col("piece") + 1).alias("place"), F.array_join(F.regexp_extract_all("s", F.lit(f"(?s).{{1,{width}}}"), F.lit(0)), "\n").alias("value"))
    head = records.sparkSession.range(1).select(F.lit(0).cast("long").alias("place"), F.lit(f">{name}").alias("value"))
    return head.unionByName(body)


def fasta_lines(sequences: DataFrame, width: int = LINE) -> DataFrame:
    """value: one record (header, then lines of ``width`` characters) for each row of name, chars."""
    lines = F.array_join(F.regexp_extract_all("chars", F.lit(f".{{1,{width}}}"), F.lit(0)), "\n")
    return sequences.select(F.concat(F.lit(">"), "name", F.when(F.length("chars") > 0, F.concat(F.lit("\n"), lines)).otherwise("")).alias("value"))


def write_fasta(sequences: DataFrame, path: str, width: int = LINE) -> None:
    """A folder of text files with the records of name and chars."""
    fasta_lines(sequences, width).write.mode("overwrite").text(path)


def clean_fasta(spark: SparkSession, path: str, target: str) -> DataFrame:
    """Writes the cleaned file, a folder of text files whose lines, file by file, are in order, and returns its counts."""
    name = os.path.basename(path.rstrip("/"))
    records = stored(cleaned_records(spark, path), "cleaned")
    wrapped_lines(records, name).repartitionByRange("place").sortWithinPartitions("place").select("value").write.mode("overwrite").text(target)
    return clean_counts(records, name)
