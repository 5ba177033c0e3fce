"""Several records as one text that no row ever holds: a table of pieces.

Each record's place in the text follows from the lengths of the records before it. A record is cut at the multiples of the
piece's size in the whole text, so a piece is made of the parts of all records that reach into it; parts are also sent
to the pieces before and behind theirs, as far as those need them for context. That is one shuffle of the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memspan.operators.kmers import PIECE


def _order(refs: DataFrame) -> list[str]:
    return [*(["ord"] if "ord" in refs.columns else []), "id"]


def merged_offsets(refs: DataFrame, separator: int = 1) -> DataFrame:
    """id, start, size and last (whether none follows) of each record in the merged text, where ``separator`` characters
    stand between two; records are ordered by ord, if there is such a column, and id. A null text takes no room.

    A running sum over all records is one sorted task; headers only, bodies stay behind.
    """
    order = Window.orderBy(*_order(refs))
    sizes = refs.select(*_order(refs), F.length("chars").cast("long").alias("size"))
    before = F.sum(F.col("size") + separator).over(order.rowsBetween(Window.unboundedPreceding, -1))
    return sizes.select("id", F.coalesce(before, F.lit(0)).alias("start"), "size", F.lead("size").over(order).isNull().alias("last"))


def merged_pieces(refs: DataFrame, between: str = "N", end: str = "", size: int = PIECE, before: int = 0, ahead: int = 0) -> DataFrame:
    """piece, lead, s: the merged text in pieces of ``size`` characters, each with up to ``before`` characters of
    what stands before it (``lead`` is how many) and ``ahead`` of what stands behind. ``refs`` have id and chars, and ord if their
    order is another; ``between`` (a character or nothing) stands between two records, ``end`` behind the last."""
    refs = refs.where(F.col("chars").isNotNull())
    places = merged_offsets(refs, len(between)).select("id", "start", "last")
    rows = refs.select("id", "chars").join(places, "id")
    text = F.concat("chars", F.when(F.col("last"), F.lit(end)).otherwise(F.lit(between)))
    room = F.lit(size) - F.col("start") % size  # what the piece has left in which the record begins
    rows = rows.select("start", text.alias("t"), room.cast("int").alias("room"))
    rest = F.regexp_extract_all(F.substr("t", F.col("room") + 1), F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    parts = rows.select("start", F.posexplode(F.concat(F.array(F.left("t", F.col("room"))), rest)).alias("k", "part")).where(F.length("part") > 0)
    own = F.floor(F.col("start") / size) + F.col("k")
    at = F.when(F.col("k") == 0, F.col("start")).otherwise(own * size)
    parts = parts.select(own.alias("own"), at.alias("at"), "part")
    near = F.sequence(F.greatest(F.col("own") - -(-ahead // size), F.lit(0)), F.col("own") + -(-before // size))
    sent = parts.select("own", "at", "part", F.explode(near).alias("piece"))

    def clipped(first: Column, behind: Column) -> list[Column]:
        """The part between two places of the text."""
        skip = F.greatest(first - F.col("at"), F.lit(0)).cast("int")
        return [(F.col("at") + skip).alias("at"), F.substr("part", skip + 1, F.greatest(F.least(F.length("part").cast("long"), behind - F.col("at")) - skip, F.lit(0)).cast("int")).alias("part")]

    begin = F.col("piece") * size
    sent = sent.select("piece", *clipped(begin - before, begin + size + ahead)).where(F.length("part") > 0)
    lists = sent.groupBy("piece").agg(F.sort_array(F.collect_list(F.struct("at", "part"))).alias("parts"))  # at most size + before + ahead characters
    lead = F.greatest(F.col("piece") * size - F.col("parts")[0]["at"], F.lit(0)).cast("int")
    joined = lists.select("piece", lead.alias("lead"), F.array_join(F.transform("parts", lambda p: p["part"]), "").alias("s"))
    return joined.where(F.length("s") > F.col("lead"))
