"""References to records that do not exist.

``timeline`` reduces a change feed to one row per key: whether it is live and over which interval it was valid.
``resolve`` then merges references with their targets: both sides are partitioned and sorted by the
target's key and run past each other once (a sort-merge join; adaptive execution splits a target that too
many references name). The interval tells missing, deleted and late targets apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.sources import workspace

ENTRY = "__index__:"


def timeline(changes: DataFrame) -> DataFrame:
    """Per ``rec_key``: ``live`` (its newest change is no tombstone), ``valid_from`` (the first arrival of any of its
    changes) and ``valid_to`` (the first arrival of the newest change if that is a tombstone, else null).

    Rows with a null in the key or in (``iter_index``, ``seq``) are left out; a null time is no arrival; a null
    tombstone mark means none. If deliveries of one change differ, a tombstone wins.
    """
    dead = F.coalesce("deleted", F.lit(False))
    early = -F.unix_micros(F.col("arrived_at").cast("timestamp"))
    last = F.max(F.struct("iter_index", "seq", dead.alias("dead"), early.alias("early"), "arrived_at")).alias("last")
    named = changes.dropna(subset=["rec_key", "iter_index", "seq"])
    return named.groupBy("rec_key").agg(last, F.min("arrived_at").alias("valid_from")).select("rec_key", (~F.col("last.dead")).alias("live"), "valid_from", F.when(F.col("last.dead"), F.col("last.arrived_at")).alias("valid_to"))


def parsed(key: Column) -> dict[str, Column]:
    """Table, column, value and row key of an index entry; the value may hold colons, the row key never does.

    A key with fewer than four fields after the mark is malformed: its row key is null.
    """
    rest = F.substring(key, len(ENTRY) + 1, 1 << 30)
    n = F.size(F.split(rest, ":", -1))
    table = F.substring_index(rest, ":", 1)
    column = F.substring_index(F.substring(rest, F.length(table) + 2, F.lit(1 << 30)), ":", 1)
    pk = F.when(n >= 4, F.substring_index(rest, ":", -1))
    start = F.length(table) + F.length(column) + 3
    value = F.when(n >= 4, F.substring(rest, start, F.length(rest) - start - F.length(pk)))
    return {"table_name": table, "column_name": column, "value": value, "pk": pk}


def resolve(changes: DataFrame, schemas: DataFrame) -> DataFrame:
    """Every live index entry of the feed with its target's fate, by the interval in which the target was valid.

    ``rec_key, table_name, column_name, target_key, valid_from, missing, deleted, late, stillborn, undeclared``: the target has no
    interval; its interval has ended; it is open but began on a later calendar day than the entry's; it had ended before
    the entry's began; no row of ``schemas`` has the entry's table and column. A malformed entry's target is missing; what has no
    time of arrival is neither late nor stillborn.
    """
    keys = workspace.keep(timeline(changes), "orphans-timeline")
    f = parsed(F.col("rec_key"))
    entries = keys.filter(F.col("live") & F.col("rec_key").startswith(ENTRY)).select(
        "rec_key", "valid_from", f["table_name"].alias("table_name"), f["column_name"].alias("column_name"),
        F.concat(f["table_name"], F.lit(":"), f["pk"]).alias("target_key"),
    )
    targets = keys.select(F.col("rec_key").alias("target_key"), F.col("live").alias("t_live"), F.col("valid_from").alias("t_from"), F.col("valid_to").alias("t_to"))
    declared = schemas.select("table_name", "column_name").distinct().withColumn("declared", F.lit(True))
    late = F.coalesce(F.col("t_live") & (F.to_date("t_from") > F.to_date("valid_from")), F.lit(False))
    return (
        entries.join(targets.hint("merge"), "target_key", "left")
        .join(declared, ["table_name", "column_name"], "left")
        .select(
            "rec_key", "table_name", "column_name", "target_key", "valid_from",
            F.col("t_live").isNull().alias("missing"),
            F.coalesce(~F.col("t_live"), F.lit(False)).alias("deleted"),
            late.alias("late"),
            F.coalesce(F.col("t_to") < F.col("valid_from"), F.lit(False)).alias("stillborn"),
            F.col("declared").isNull().alias("undeclared"),
        )
    )


BROKEN = "missing or deleted or late or undeclared"


def undeclared_schemas(schemas: DataFrame, columns: DataFrame) -> DataFrame:
    """The rows of ``schemas`` whose table and column the catalog lacks; names compare exactly, nulls match nothing."""
    return schemas.join(columns.select("table_name", "column_name").distinct(), ["table_name", "column_name"], "left_anti")


def orphans(changes: DataFrame, schemas: DataFrame, columns: DataFrame) -> DataFrame:
    """All broken references, ``ref_source, ref_key``: of the feed's entries to rows and schemas, and of the schemas
    to the catalog."""
    of_entries = resolve(changes, schemas).filter(BROKEN).select(F.lit("block_records").alias("ref_source"), F.col("rec_key").alias("ref_key"))
    of_schemas = undeclared_schemas(schemas, columns).select(F.lit("index_schemas").alias("ref_source"), F.col("index_name").alias("ref_key"))
    return of_entries.unionByName(of_schemas)


def report(changes: DataFrame, schemas: DataFrame) -> DataFrame:
    """Broken entries counted per table and day of the entry's first arrival, by reason; an entry may have several."""
    broken = resolve(changes, schemas).filter(BROKEN)
    count = lambda what: F.count_if(what).alias(f"n_{what}")
    return broken.groupBy("table_name", F.to_date("valid_from").alias("day")).agg(F.count("*").alias("n_orphans"), *map(count, ("missing", "deleted", "late", "stillborn", "undeclared")))
