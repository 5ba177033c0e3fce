"""Look-ups by name, order by size, and the counts of a cleaned sequence file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memspan.functions.sequences import normalize, normalize_name
from memspan.operators.scans import numbered


def closest_names(wanted: DataFrame, wanted_key: str, known: DataFrame, known_key: str) -> DataFrame:
    """For each wanted name the known one with the longest common alphanumeric prefix (the smaller
    key among equals): wanted_key, known_key, score.

    Every prefix of a known name is a row, so this is an equi-join on prefixes and never a product;
    names without a common first character meet in the empty prefix's single best row."""
    def prefixes(df, key):
        plain = normalize_name(F.col("name"), 0)
        return df.select(key, F.explode(F.sequence(F.lit(0), F.length(plain))).alias("_n"), plain.alias("_p")).select(key, F.left("_p", F.col("_n")).alias("_prefix"), F.col("_n").alias("score"))

    best = prefixes(known, known_key).groupBy("_prefix").agg(F.min(known_key).alias(known_key))
    met = prefixes(wanted, wanted_key).join(best, "_prefix")
    return met.groupBy(wanted_key).agg(F.max_by(known_key, "score").alias(known_key), F.max("score").alias("score"))


def by_exact_name(blocks: DataFrame, sequences: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Match blocks joined to sequences of the same name, and the blocks whose name is unknown. Names stand for one
    sequence each here; see :func:`by_name_in_order` for names that stand for several."""
    return blocks.join(sequences, "name"), blocks.join(sequences.select("name").distinct(), "name", "left_anti")


def by_name_in_order(blocks: DataFrame, sequences: DataFrame, block_ord: str, sequence_ord: str) -> DataFrame:
    """Blocks with the sequences they are about, where several may have one name: the k-th block of a name, by
    ``block_ord``, is about the k-th sequence of it, by ``sequence_ord``. Blocks for which there is none have nulls.

    Match files have a block for each sequence in the order of the sequences, so this is what reading both side by side gives.
    Occurrences are numbered in parts of the order (see :func:`memspan.operators.scans.numbered`), so a name that very many
    share is not numbered by one task; the join is on name and number."""
    mine = numbered(blocks, ("name",), ((block_ord, False),), block_ord, "_k")
    theirs = numbered(sequences, ("name",), ((sequence_ord, False),), sequence_ord, "_k")
    return mine.join(theirs, ["name", "_k"], "left").drop("_k")


def ordered_by_size(df: DataFrame, size: str, key: str) -> DataFrame:
    """Adds place (1-based) in ascending order of size, then key.

    Sizes are few compared with rows: each size's first place is a running sum over the distinct
    sizes, and rows are numbered within their size only."""
    from pyspark.sql import Window

    counts = df.groupBy(size).agg(F.count("*").alias("_n"))
    first = counts.withColumn("_first", F.coalesce(F.sum("_n").over(Window.orderBy(size).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    inside = F.row_number().over(Window.partitionBy(size).orderBy(key))
    return df.join(first, size).withColumn("place", (F.col("_first") + inside).cast("long")).drop("_first")


def clean_counts(sequences: DataFrame) -> DataFrame:
    """kept letters, removed printable characters and records of a cleaned file."""
    kept = F.length(normalize(F.col("chars"), acgt_only=True))
    printable = F.length(normalize_name(F.col("chars"), 2))
    return sequences.agg(F.sum(kept).alias("kept"), F.sum(printable - kept).alias("removed"), F.count("*").alias("records"))
