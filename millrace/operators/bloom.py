"""Bloom filters per file, in the store's format: built from keys, and asked.

Bit ``b`` is in byte ``b div 8`` with weight ``2 ** (b mod 8)``; a key sets the bits ``(h1 + i * h2) mod n_bits`` for ``i`` below
``HASHES``, with ``h1`` and ``h2`` the first and the second eight hex digits of its MD5.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.columns import col
from millrace.sources.workers import ship

HASHES = 7
#: Bits a key, and the least bits of a filter; seven hashes then let about 1 % of other keys pass.
BITS_A_KEY, LEAST_BITS = 10, 64


def hashes(key: Column) -> tuple[Column, Column]:
    """Both hashes of a key, from which all its bits follow."""
    digest = F.md5(key)
    h1, h2 = (F.conv(F.substring(digest, a, 8), 16, 10).cast("long") for a in (1, 9))
    return h1, h2


def _positions(h1: Column, h2: Column, n_bits: Column) -> list[Column]:
    return [F.pmod(h1 + F.lit(i) * h2, n_bits) for i in range(HASHES)]


def holds(h1: Column, h2: Column, bloom: Column, n_bits: Column) -> Column:
    """Whether a filter may hold the key of these hashes; null if there are none, or if the filter is missing, has no bits or is
    shorter than it says. The hashes are best computed before the keys meet their filters."""
    usable = (n_bits > 0) & (F.octet_length(bloom) * 8 >= n_bits)

    def bit(b: Column) -> Column:
        byte = F.conv(F.hex(F.substring(bloom, (F.floor(b / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
        return F.call_function("getbit", byte, F.pmod(b, F.lit(8)).cast("int")) == 1

    first, *rest = map(bit, _positions(h1, h2, n_bits))
    for b in rest:
        first = first & b
    return F.when(usable, first)


def _bytes(n_bits: pd.Series, places: pd.Series, values: pd.Series) -> pd.Series:
    out = []
    for n, p, v in zip(n_bits, places, values, strict=True):
        filled = np.zeros((int(n) + 7) // 8, np.uint8)
        filled[np.asarray(p, np.int64)] = np.asarray(v, np.uint8)
        out.append(filled.tobytes())
    return pd.Series(out, dtype=object)


def build(rows: DataFrame, file: str, key: str) -> DataFrame:
    """One filter per file over its different keys: ``file, n_keys, n_bits, bloom``.

    Null keys are in no filter, and rows without a file in no file. Bits are combined to bytes before anything of a file comes
    together, so a file with a third of all keys brings no more together than its filter.
    """
    ship(rows.sparkSession)
    h1, h2 = hashes(F.col("k"))
    keys = rows.select(col(file).alias("f"), col(key).alias("k")).dropna().distinct().select("f", h1.alias("h1"), h2.alias("h2"))
    sizes = keys.groupBy("f").agg(F.count("*").alias("n_keys")).withColumn("n_bits", F.greatest(F.col("n_keys") * BITS_A_KEY, F.lit(LEAST_BITS)))
    bits = keys.join(sizes, "f").select("f", "n_keys", "n_bits", F.explode(F.array(*_positions(F.col("h1"), F.col("h2"), F.col("n_bits")))).alias("b"))
    byte = F.floor(F.col("b") / 8).alias("place")
    value = F.bit_or(F.pow(F.lit(2), F.pmod("b", F.lit(8))).cast("int")).alias("value")
    parts = bits.groupBy("f", "n_keys", "n_bits", byte).agg(value)
    assemble = F.pandas_udf(_bytes, "binary")
    lists = parts.groupBy("f", "n_keys", "n_bits").agg(F.sort_array(F.collect_list(F.struct("place", "value"))).alias("p"))
    return lists.select(F.col("f").alias(file), "n_keys", "n_bits", assemble("n_bits", "p.place", "p.value").alias("bloom"))
