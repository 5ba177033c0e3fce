"""Arrow helpers shared by the operators, and tables that outlive executors.

Every operator that cuts lineage writes a Parquet table below ``spark.checkpoint.dir``, which all
executors share, so a lost executor costs a re-read and never a recomputation of the whole plan.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from memspan.plans.tables import shared_folder, stored

__all__ = ["free_names", "map_columns", "rows_of", "shared_folder", "stored", "trim_memory"]
#: Rows that are Python objects at a time.
ROWS = 1000


def map_columns(df: DataFrame, make: Callable[[], Callable[..., Iterator[dict] | dict]], schema: str) -> DataFrame:
    """``mapInArrow`` over Python lists.

    ``make`` runs once per task and returns a function of the input columns (one list per
    column, at most ``ROWS`` rows), which returns or yields dictionaries of output columns.
    """
    target = schema if isinstance(schema, StructType) else _parse_datatype_string(schema)
    arrow = to_arrow_schema(target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim_memory()
        step = make()
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                made = step(*(column.to_pylist() for column in batch.slice(at, ROWS).columns))
                for out in [made] if isinstance(made, dict) else made:
                    yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, target)


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The rows of Arrow batches, at most ``ROWS`` of them as Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield from zip(*(column.to_pylist() for column in batch.slice(at, ROWS).columns), strict=True)


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Names for helper columns that no column of ``df`` has, whatever their case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def trim_memory() -> None:
    """Gives memory that earlier tasks of this Python worker have freed back to the system, where the C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)
