"""Rows and index entries that a key-value store keeps as text.

A row is ``name=i:5|other=t:x``: columns in order of name, ``i`` for integers and ``t`` for texts, under the key ``table:pk``. An
index entry is the key ``__index__:table:column:value:pk``, in which an integer is padded to twenty digits so that
keys sort like values.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.columns import col
from millrace.plans import nodes as n
from millrace.plans.compiler import OPS

MARK = {n.INT: "i", n.TEXT: "t"}
ENTRY = "__index__:"


def field(row: Column, name: str, kind: str) -> Column:
    """One column of a row's text; null if the row lacks it, has another type there, or no number where one must be."""
    start = f"{name}={MARK[kind]}:"
    text = F.get(F.filter(F.split(row, r"\|"), lambda part: part.startswith(start)), F.lit(0))
    value = F.substring(text, len(start) + 1, 1 << 30)
    return value.try_cast("long") if kind == n.INT else value


def encode(kinds: Mapping[str, str]) -> Column:
    """The text of a row from columns of these names; columns that are null are left out."""
    return F.concat_ws("|", *[F.concat(F.lit(f"{c}={MARK[kinds[c]]}:"), col(c).cast("string")) for c in sorted(kinds)])


def table_rows(live: DataFrame, table: str, kinds: Mapping[str, str], key: str = "rec_key", value: str = "rec_value") -> DataFrame:
    """A table of the store as typed columns, from its live records; the prefix of the key reaches the scan."""
    rows = live.filter(col(key).startswith(f"{table}:"))
    return rows.select(*[field(col(value), c, kind).alias(c) for c, kind in kinds.items()])


def index_prefix(table: str, column: str) -> str:
    return f"{ENTRY}{table}:{column}:"


def index_rows(live: DataFrame, table: str, column: str, kind: str, op: str, value: int | str, key: str = "rec_key") -> DataFrame:
    """Records of a table whose index entries compare so with a value; each once, however many entries name it.

    Values are compared as what they are, not as parts of keys, so texts that hold colons and negative numbers come out right.
    """
    prefix = index_prefix(table, column)
    entries = live.filter(col(key).startswith(prefix))
    pk = F.substring_index(col(key), ":", -1)
    text = F.substring(col(key), F.lit(len(prefix) + 1), F.length(col(key)) - len(prefix) - 1 - F.length(pk))
    held = text.try_cast("long") if kind == n.INT else text
    hits = entries.filter(OPS[op](held, F.lit(value))).select(F.concat(F.lit(f"{table}:"), pk).alias(key)).distinct()
    return live.filter(col(key).startswith(f"{table}:")).join(hits, key, "left_semi")
