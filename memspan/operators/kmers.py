"""k-mers of a text column as rows, in time linear in the text.

A text is cut into pieces of a fixed size by one regular-expression pass (``substring`` counts
from the start of a string, so slicing every position of a long text would be quadratic); each
piece is padded with what its k-mers and their context need from its neighbours.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PIECE = 256
#: The same for k-mers that with their context take no more than a quarter of it: a letter is found by counting from a piece's start.
SHORT_PIECE = 64


def spread(df: DataFrame) -> DataFrame:
    """``df`` over at least as many partitions as there are cores; a no-op for inputs of many splits."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def _tail(text: Column, n: int) -> Column:
    return F.when(F.length(text) <= n, text).otherwise(F.right(text, F.lit(n)))


def kmers(df: DataFrame, text: str, k: int, stride: int = 1, context: int = 0, keep: tuple[str, ...] = ()) -> DataFrame:
    """Columns ``keep``, pos (0-based), kmer, and with ``context`` left (reversed) and right: up to
    that many characters before and behind.

    Only k-mers at multiples of ``stride`` are made. Null or too short texts have none. Columns
    of ``keep`` travel with each k-mer, the text itself does not.
    """
    before, behind = context, k - 1 + context
    size = max(1, (SHORT_PIECE if 4 * (before + behind) <= SHORT_PIECE else PIECE) // stride) * stride
    chunks = F.regexp_extract_all(F.col(text), F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    rows = df.select(*keep, chunks.alias("_chunks"))  # the text is used once: where it is an expression, Spark makes it again for each use
    reach = -(-behind // size)  # chunks ahead that a k-mer may need

    def piece(chunk: Column, i: Column) -> Column:
        ahead = F.array_join(F.slice("_chunks", i + 2, F.lit(reach)), "")
        back = F.array_join(F.slice("_chunks", F.greatest(i + 1 - -(-max(before, 1) // size), F.lit(1)), F.least(i, F.lit(-(-max(before, 1) // size)))), "")
        lead = _tail(back, before) if before else F.lit("")
        return F.struct(i.alias("i"), F.length(lead).alias("lead"), F.concat(lead, chunk, F.left(ahead, F.lit(behind))).alias("s"))

    pieces = rows.select(*keep, F.explode(F.transform("_chunks", piece)).alias("_p"))
    return kmers_of_pieces(pieces.select(*keep, F.col("_p.i").alias("piece"), F.col("_p.lead").alias("lead"), F.col("_p.s").alias("s")), size, k, stride, context, keep)


def kmers_of_pieces(pieces: DataFrame, size: int, k: int, stride: int = 1, context: int = 0, keep: tuple[str, ...] = ()) -> DataFrame:
    """The same from a text in pieces of ``size`` characters (a multiple of ``stride``): ``piece`` is the number of one, ``s`` its
    characters with ``lead`` of those before it and as many behind it as its k-mers and their context need."""
    pieces = pieces.select(*keep, F.col("piece").alias("_i"), F.col("lead").alias("_lead"), F.col("s").alias("_s"))
    last = F.least(F.lit(size - stride), F.length("_s") - F.col("_lead") - k)
    rows = pieces.where(last >= 0).select(*keep, "_i", "_lead", "_s", F.explode(F.sequence(F.lit(0), last, F.lit(stride))).alias("_o"))
    at = F.col("_lead") + F.col("_o")
    out = [*keep, (F.col("_i").cast("long") * size + F.col("_o")).alias("pos"), F.substr("_s", at + 1, F.lit(k)).alias("kmer")]
    if context:
        start = F.greatest(at - context, F.lit(0))
        out.append(F.reverse(F.substr("_s", start + 1, at - start)).alias("left"))
        out.append(F.substr("_s", at + 1 + k, F.lit(context)).alias("right"))
    return rows.select(*out)
