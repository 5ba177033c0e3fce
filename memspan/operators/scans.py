"""Running sums and maxima over the positions of one group, however long it is.

A window partitioned by a query alone puts all of a long query into one task. Here positions are cut into blocks, windows are
partitioned by group and block, and what crosses a border travels as rows or as one summary a block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memspan.plans.tables import stored

#: Positions of a block.
BLOCK = 1 << 16


def covered_blocks(df: DataFrame, pos: str, end: str, block_size: int = BLOCK) -> DataFrame:
    """A row for each block of positions that the interval from ``pos`` up to ``end`` (exclusive) reaches into: adds _block and
    _home, whether the interval begins there."""
    first = F.floor(F.col(pos) / block_size)
    rows = df.withColumn("_block", F.explode(F.sequence(first, F.greatest(F.floor((F.col(end) - 1) / block_size), first))))
    return rows.withColumn("_home", F.col("_block") == first)


def numbered(df: DataFrame, group: tuple[str, ...], order: tuple[tuple[str, bool], ...], pos: str, out: str, block_size: int = BLOCK) -> DataFrame:
    """Adds ``out``: the place (1-based) of each row in its group, in the order of (column, whether descending) pairs, one of
    which is the position column ``pos``.

    Rows are numbered within cells, which are the values of the columns in front of ``pos`` and its block; the sizes of cells, a row
    each, are summed up in the same order. The rows are stored first, as both are made of them."""
    def by(name: str, falling: bool) -> Column:
        return F.desc(name) if falling else F.asc(name)

    k = [name for name, _ in order].index(pos)
    rows = stored(df, "rows").withColumn("_block", F.floor(F.col(pos) / block_size))
    cell = (*group, *(name for name, _ in order[:k]), "_block")
    sizes = rows.groupBy(*cell).agg(F.count("*").alias("_n"))
    cells = Window.partitionBy(*group).orderBy(*(by(*o) for o in order[:k]), by("_block", order[k][1])).rowsBetween(Window.unboundedPreceding, -1)
    ahead = sizes.select(*(F.col(c).alias(f"_c{i}") for i, c in enumerate(cell)), F.coalesce(F.sum("_n").over(cells), F.lit(0)).alias("_ahead"))
    inside = F.row_number().over(Window.partitionBy(*cell).orderBy(*(by(*o) for o in order)))
    same = [F.col(c).eqNullSafe(F.col(f"_c{i}")) for i, c in enumerate(cell)]
    met = rows.withColumn("_inside", inside).join(ahead, same)
    return met.select(*df.columns, (F.col("_ahead") + F.col("_inside")).cast("int").alias(out))
