"""Joins that broadcast only what has been measured."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.columns import col

#: Bytes up to which a measured table is broadcast; as a hash table it may take some times that.
BROADCAST_BYTES = 32 << 20
#: Bytes of a row and of each of its columns besides what texts and blocks of bytes hold.
ROW_BYTES, COLUMN_BYTES = 32, 8


def measured_bytes(rows: DataFrame) -> int:
    """What a table takes as rows in memory; one narrow aggregation. Columns but texts and bytes count as numbers."""
    held = [F.coalesce(F.octet_length(col(f.name)), F.lit(0)) for f in rows.schema.fields if isinstance(f.dataType, (T.StringType, T.BinaryType))]
    each = sum(held, F.lit(ROW_BYTES + COLUMN_BYTES * len(rows.columns)).cast("long"))
    return rows.agg(F.sum(each)).first()[0] or 0


def join_measured(big: DataFrame, small: DataFrame, on: list[str], how: str) -> DataFrame:
    """Join with ``small``, broadcast if it takes at most ``BROADCAST_BYTES``, else by sort-merge.

    ``small`` must be cheap to measure: a table read from storage or a kept one. Beyond the bound both sides
    are shuffled by the key, and adaptive execution splits keys that hold too many rows of ``big``.
    """
    return big.join(F.broadcast(small) if measured_bytes(small) <= BROADCAST_BYTES else small.hint("merge"), on, how)
