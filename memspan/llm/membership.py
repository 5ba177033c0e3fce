"""A Bloom filter over ids, to keep rows without a partner out of a shuffle.

The filter has about ``PER_ID`` bits an id, ``2 ** LEAST_BITS`` at least and ``2 ** MOST_BITS`` (8 MB) at
most: that bounds the broadcast. Beyond some ten million ids it lets more rows through, and never loses
one; the join behind it decides. Tasks send only the blocks of the filter that they have touched,
which are united by block.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from memspan.llm.fingerprints import mix

PER_ID, LEAST_BITS, MOST_BITS = 12, 20, 26
BLOCK_BYTES = 4096
HASHES = 4


def _places(ids: np.ndarray, bits: int) -> np.ndarray:
    h = mix(ids.astype(np.int64).view(np.uint64) + np.uint64(0x5851F42D4C957F2D))
    step = (h >> np.uint64(32)) | np.uint64(1)
    return np.stack([(h + np.uint64(i) * step) & np.uint64((1 << bits) - 1) for i in range(HASHES)])


def _united(batches):
    """(block, bits) in order of block, united by block."""
    import pyarrow as pa

    key, bits = None, None

    def out():
        return pa.RecordBatch.from_arrays([pa.array([key], pa.int32()), pa.array([bits.tobytes()], pa.binary())], names=["block", "bits"])

    for batch in batches:
        for block, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if block != key:
                if key is not None:
                    yield out()
                key, bits = block, np.zeros(BLOCK_BYTES, np.uint8)
            bits |= np.frombuffer(raw, np.uint8)
    if key is not None:
        yield out()


def bloom_filter(ids: DataFrame) -> np.ndarray:
    """The bits of a filter over the only column of ``ids`` (long)."""
    known = ids.agg(F.approx_count_distinct(ids.columns[0])).first()[0]
    size = min(MOST_BITS, max(LEAST_BITS, (PER_ID * known).bit_length()))

    def fill(batches):
        import pyarrow as pa

        flags = np.zeros(1 << size, bool)
        for batch in batches:
            flags[_places(batch.column(0).drop_null().to_numpy(zero_copy_only=False), size).ravel()] = True
        bits = np.packbits(flags).reshape(-1, BLOCK_BYTES)
        used = np.flatnonzero(bits.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array([bits[i].tobytes() for i in used], pa.binary())], names=["block", "bits"])

    schema = "block int, bits binary"
    rows = ids.mapInArrow(fill, schema).repartition("block").sortWithinPartitions("block").mapInArrow(_united, schema).collect()
    bits = np.zeros((1 << size) // 8, np.uint8)
    for r in rows:
        bits[r.block * BLOCK_BYTES : (r.block + 1) * BLOCK_BYTES] = np.frombuffer(r.bits, np.uint8)
    return bits


def may_hold(bits: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Which of ``ids`` may be in the filter."""
    at = _places(ids, (8 * len(bits)).bit_length() - 1)
    byte, bit = (at >> np.uint64(3)).astype(np.int64), (np.uint64(7) - (at & np.uint64(7))).astype(np.uint8)
    return ((bits[byte] >> bit) & 1).astype(bool).all(0)


def possible_members(df: DataFrame, id_col: str, bits: np.ndarray, absent: bool = False) -> DataFrame:
    """The rows whose id may be in the filter, or with ``absent`` all others; a null id is in none."""
    sent = df.sparkSession.sparkContext.broadcast(bits)

    @F.pandas_udf(BooleanType())
    def there(ids):
        import pandas as pd

        known = ids.notna().to_numpy()
        return pd.Series(known & may_hold(sent.value, ids.fillna(0).to_numpy(np.int64)))

    return df.where(~there(F.col(id_col)) if absent else there(F.col(id_col)))


def members_of(df: DataFrame, id_col: str, ids: DataFrame) -> DataFrame:
    """The rows of ``df`` whose id may be in the only column of ``ids``, a stored table."""
    return possible_members(df, id_col, bloom_filter(ids))
