"""Statements to DataFrame plans; Catalyst does the rest."""

from __future__ import annotations

import operator
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.columns import col, fresh, orderable
from millrace.plans import nodes as n
from millrace.plans.analyzer import check_select, check_where

OPS: dict[str, Callable[[Column, Column], Column]] = {"=": operator.eq, "!=": operator.ne, ">": operator.gt, ">=": operator.ge, "<": operator.lt, "<=": operator.le}


def kinds_of(rows: DataFrame) -> dict[str, str]:
    """The dialect's types of a DataFrame's columns; other types keep their Spark name."""
    return {f.name: n.INT if isinstance(f.dataType, T.IntegralType) else n.TEXT if isinstance(f.dataType, T.StringType) else f.dataType.simpleString() for f in rows.schema.fields}


def condition(c: n.Condition, value: Callable[[n.Operand], Column]) -> Column:
    """A Column for a checked condition; ``value`` gives the Column of an operand."""
    if isinstance(c, n.Logical):
        left, right = condition(c.left, value), condition(c.right, value)
        return left & right if c.op == "AND" else left | right
    return OPS[c.op](value(c.left), value(c.right))


def _row_value(side: n.Operand) -> Column:
    return F.lit(side.value) if isinstance(side, n.Literal) else col(side.name)


def where(rows: DataFrame, c: n.Condition) -> Column:
    """The Column of a WHERE condition on these rows, after its check."""
    check_where(c, kinds_of(rows))
    return condition(c, _row_value)


def _aggregate(a: n.Aggregate) -> Column:
    if a.function == "COUNT":
        return F.count(F.lit(1))
    c = col(a.column)
    if a.function == "MIN":
        return F.min(c)
    if a.function == "MAX":
        return F.max(c)
    total = F.coalesce(F.sum(c), F.lit(0))
    if a.function == "SUM":
        return total
    # a quotient of integers, cut toward zero; 0 for no rows
    return F.call_function("div", total, F.greatest(F.count(F.lit(1)), F.lit(1)))


def select(rows: DataFrame, s: n.Select, pk: str | None = None) -> DataFrame:
    """The plan of a SELECT over a table's rows. ``pk`` names the table's key, whose text decides between rows that tie.

    Columns of the result are named as they were selected: ``name``, ``COUNT(*)``, ``MIN(name)``. Without ORDER BY
    and LIMIT the order is open.
    """
    check_select(s, kinds_of(rows))
    if s.where is not None:
        rows = rows.filter(condition(s.where, _row_value))
    if s.group_by or any(isinstance(i, n.Aggregate) for i in s.items):
        return _grouped(rows, s)
    return _plain(rows, s, pk)


def _order(by: Column, descending: bool) -> Column:
    return by.desc() if descending else by.asc()


def _plain(rows: DataFrame, s: n.Select, pk: str | None) -> DataFrame:
    """Projection, DISTINCT, ORDER BY and LIMIT without groups.

    Sorting comes before projection, so the key need not be selected. Rows that tie are ordered by the text of the table's
    key, or without one by all columns. Of equal rows DISTINCT keeps the first in that order; it does so by
    aggregation with map-side combining, so that a row that occurs a billion times stays cheap.
    """
    names = [name for i in s.items for name in (rows.columns if isinstance(i, n.Star) else [i.name])]
    places = [f"c{k}" for k in range(len(names))]
    shown = [col(c).alias(p) for c, p in zip(names, places, strict=True)]
    if s.order is None and s.limit is None:
        out = rows.select(*shown)
        out = out.distinct() if s.distinct else out
    else:
        ties = [col(pk).cast("string")] if pk is not None else [col(f.name) for f in rows.schema.fields if orderable(f.dataType)]
        key = col(s.order.column) if s.order is not None else F.lit(0)
        descending = s.order is not None and s.order.descending
        out = rows.select(*shown, key.alias("k"), F.struct(*ties).alias("t"))
        if s.distinct:
            out = out.groupBy(*places, "k").agg(F.min("t").alias("t"))
            if s.order is None or s.order.column not in names:
                best = F.max_by if descending else F.min_by
                out = out.groupBy(*places).agg(best(F.struct("k", "t"), "k").alias("first")).select(*places, "first.k", "first.t")
        out = out.orderBy(_order(F.col("k"), descending), F.col("t").asc())
        if s.limit is not None:
            out = out.limit(s.limit)
    return out.select(*[F.col(p).alias(c) for c, p in zip(names, places, strict=True)])


def _grouped(rows: DataFrame, s: n.Select) -> DataFrame:
    """Grouped or global aggregation, one hash aggregate with partial results; HAVING may use aggregates that aren't selected."""
    wanted: list[n.Aggregate] = []

    def collect(c) -> None:
        if isinstance(c, n.Aggregate) and c not in wanted:
            wanted.append(c)
        elif isinstance(c, (n.Comparison, n.Logical)):
            collect(c.left)
            collect(c.right)

    for i in s.items:
        collect(i)
    collect(s.having)
    names = fresh(rows, *[f"a{k}" for k in range(len(wanted))], "n_rows")
    place = dict(zip(wanted, names, strict=False))
    group = list(dict.fromkeys(s.group_by))
    out = rows.groupBy(*[col(g) for g in group]).agg(*[_aggregate(a).alias(place[a]) for a in wanted], F.count(F.lit(1)).alias(names[-1]))
    if not group and any(a.function in ("MIN", "MAX") for a in wanted):
        # no rows have no least and no greatest value, and the dialect no NULL
        out = out.filter(F.col(names[-1]) > 0)
    if s.having is not None:
        out = out.filter(condition(s.having, lambda v: F.col(place[v]) if isinstance(v, n.Aggregate) else _row_value(v)))
    shown = [(i.title, F.col(place[i])) if isinstance(i, n.Aggregate) else (i.name, col(i.name)) for i in s.items]
    ties = [col(g) for g in group]
    if s.distinct:
        places = [f"d{k}" for k in range(len(shown))]
        out = out.select(*[c.alias(p) for (_, c), p in zip(shown, places, strict=True)], *[t.alias(f"g{j}") for j, t in enumerate(ties)])
        best = [F.min(f"g{j}").alias(f"g{j}") if s.order is None or not s.order.descending else F.max(f"g{j}").alias(f"g{j}") for j in range(len(ties))]
        out = out.groupBy(*places).agg(*best) if ties else out.distinct()
        shown = [(title, F.col(p)) for (title, _), p in zip(shown, places, strict=True)]
        ties = [F.col(f"g{j}") for j in range(len(ties))]
    if group and (s.order is not None or s.limit is not None):
        by = [_order(ties[group.index(s.order.column)], s.order.descending)] if s.order is not None else []
        out = out.orderBy(*by, *ties)
    if s.limit is not None:
        out = out.limit(s.limit)
    return out.select(*[c.alias(title) for title, c in shown])
