"""Applying a feed of inserts, updates and deletes: a log-structured merge over bucketed Parquet.

A ``ChangeLog`` holds sorted runs. ``append`` reduces a batch of changes to the newest one per key and
writes it as one more run, hashed into buckets by key and sorted by key within them; ``append_batches`` writes the runs of many
batches in one pass. ``read`` merges all live runs: every bucket is one task, in which a k-way merge goes through the sorted files
of all runs side by side, so nothing is sorted or shuffled again. Compaction is tiered: when ``fanout``
runs have gathered on a level they are merged into one run of the next, so a change is rewritten once per level
and not once per ``fanout`` appends; ``compact`` merges all there is. A log that outgrows its buckets gets more when it is
compacted. Runs above the first level carry Bloom filters of their keys, by which a scan for one key passes over row groups.

What counts is the order columns alone, never the order of arrival, so repeated and late deliveries
change nothing. Tombstones outlive compaction, or a late older change would bring a deleted key back; with a
``horizon`` on the first order column, below which no change can arrive any more, they are purged.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.columns import col, fresh, orderable, quoted
from millrace.sources import bucketed
from millrace.sources.files import Files


def newest(changes: DataFrame, key: Sequence[str], order: Sequence[str], tombstone: str) -> DataFrame:
    """The newest change of each key, tombstones included, with the columns as they came.

    Rows with a null in ``key`` or ``order`` name no change and are left out. Changes of a key that tie in
    ``order`` (repeated deliveries) count once; should they differ, a tombstone wins, then the greatest
    of the other columns in order of name, so that the result never depends on the order of the rows.
    Aggregation starts before the shuffle: a key with a third of all rows costs each task one row.
    """
    (top,) = fresh(changes, "__top")
    out = _named(changes, key, order).groupBy(*[col(c) for c in key]).agg(_best(changes, key, order, tombstone)(None).alias(top))
    return out.select(*[col(c) if c in key else F.col(top)[c].alias(c) for c in changes.columns])


def newest_of_batches(changes: DataFrame, key: Sequence[str], order: Sequence[str], tombstone: str, batch: Column, batches: int, name: str) -> DataFrame:
    """``newest`` within each batch, with the batch's number as column ``name``; ``batch`` numbers them from 0 to ``batches - 1``.

    One aggregation by key alone: a key's row has a place for the newest change of every batch, so one shuffle, combined
    before, serves all batches. ``batches`` bounds the row's width.
    """
    best = _best(changes, key, order, tombstone)
    (number, top) = fresh(changes, "__batch", "__top")
    rows = _named(changes, key, order).withColumn(number, batch)
    places = rows.groupBy(*[col(c) for c in key]).agg(*[best(F.col(number) == k).alias(f"{top}{k}") for k in range(batches)])
    rows = places.select(*[col(c) for c in key], F.posexplode(F.array(*[F.col(f"{top}{k}") for k in range(batches)])).alias(number, top)).filter(F.col(top).isNotNull())
    return rows.select(*[col(c) if c in key else F.col(top)[c].alias(c) for c in changes.columns], F.col(number).cast("int").alias(name))


def _named(changes: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    return changes.dropna(subset=[quoted(c) for c in [*key, *order]])


def _ranked(schema: T.StructType, key: Sequence[str], order: Sequence[str], tombstone: str) -> list[str]:
    """The columns besides ``order`` and ``tombstone`` that decide between changes, in their order."""
    return [f.name for f in sorted(schema.fields, key=lambda f: f.name) if f.name not in (*key, *order, tombstone) and orderable(f.dataType)]


def _best(changes: DataFrame, key: Sequence[str], order: Sequence[str], tombstone: str):
    """An aggregate for the newest change of a group as a struct, of the rows that meet a condition if one is given."""
    rest = [c for c in changes.columns if c not in key and c not in order and c != tombstone]
    last = _ranked(changes.schema, key, order, tombstone)
    dead = F.coalesce(col(tombstone), F.lit(False)).alias(tombstone)
    rank = F.struct(*[col(c) for c in order], dead, *[col(c) for c in last])

    def best(condition: Column | None) -> Column:
        only = rank if condition is None else F.when(condition, rank)
        return F.max(only) if len(last) == len(rest) else F.max_by(F.struct(*[col(c) for c in order], dead, *[col(c) for c in rest]), only)

    return best


#: Bytes of a feed, as its source stores them, for which a log that isn't told otherwise has one bucket.
BUCKET_BYTES, MOST_BUCKETS = 32 << 20, 100_000


def buckets_for(changes: DataFrame) -> int:
    """Buckets for a log that begins with these changes: one for each core, but no more than shuffle partitions; more than either
    if the files behind the changes ask for it. Sources that can't tell their size report one of some exabytes."""
    spark = changes.sparkSession
    stored = int(str(changes._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    stored = stored if stored < 1 << 60 else 0
    least = min(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return max(1, least, min(MOST_BUCKETS, stored // BUCKET_BYTES))


class ChangeLog:
    """The runs of one table below ``root``; every state is a version file that lists the live runs.

    ``key`` is a column or several; the first decides the bucket. A run is kept as ``[number, level, rows, buckets]``.
    """

    def __init__(self, spark: SparkSession, root: str, key: str | Sequence[str], order: Sequence[str], tombstone: str, *, buckets: int | None = None, fanout: int = 4):
        self.spark, self.root, self.keys, self.order, self.tombstone = spark, root.rstrip("/"), [key] if isinstance(key, str) else list(key), list(order), tombstone
        self.key, self.buckets, self.fanout, self.files = self.keys[0], buckets, fanout, Files(spark)
        self.run = "run_no"
        if state := self._state():
            self.buckets, self.run = state["buckets"], state["run"]

    # -- versions ---------------------------------------------------------------------------------------

    def _state(self) -> dict | None:
        names = [n for n in self.files.names(f"{self.root}/versions") if n.endswith(".json")]
        return json.loads(self.files.read(f"{self.root}/versions/{names[-1]}")) if names else None

    def _commit(self, state: dict) -> None:
        if not self.files.create(f"{self.root}/versions/{state['version']:012d}.json", json.dumps(state)):
            raise RuntimeError(f"version {state['version']} of {self.root} was committed by another writer; append again")
        self.buckets = state["buckets"]

    def _folder(self, run: int) -> str:
        return f"{self.root}/data/{self.run}={run}"

    # -- writing ----------------------------------------------------------------------------------------

    def append(self, changes: DataFrame) -> int:
        """Add a batch of changes as one sorted run; the number of the new version.

        Appending a batch again after a failure is harmless. A batch without usable rows adds no run.
        """
        return self.append_batches(changes, None, 1)

    def append_batches(self, changes: DataFrame, batch: Column | None, batches: int) -> int:
        """Add a run for each batch in one pass over the changes and one commit; ``batch`` numbers them from 0, older ones first."""
        state = self._begin(changes)
        if state["horizon"] is not None:
            changes = changes.filter(col(self.order[0]) >= state["horizon"])
        rows = bucketed.moved(changes, bucketed.session_with(self.spark, state["buckets"]))
        if batches == 1:
            rows = newest(rows, self.keys, self.order, self.tombstone).withColumn(self.run, F.lit(0))
        else:
            rows = newest_of_batches(rows, self.keys, self.order, self.tombstone, batch, batches, self.run)
        runs = self._write(rows, state, 0, batches)
        state |= {"version": state["version"] + 1, "runs": [*state["runs"], *runs]}
        self._commit(state)
        level = 0
        while len(full := [r for r in state["runs"] if r[1] == level]) >= self.fanout:
            # of the runs of many batches only the oldest are merged
            state = self._merge(state, full[: self.fanout], level + 1)
            level += len([r for r in state["runs"] if r[1] == level]) < self.fanout
        return state["version"]

    def _begin(self, changes: DataFrame) -> dict:
        """The state to append to: a new one, or the last with more buckets if the changes ask for that and outweigh what is there."""
        state = self._state()
        if state is None:
            columns = ", ".join(f"{quoted(f.name)} {f.dataType.simpleString()}" for f in changes.schema.fields)
            (self.run,) = fresh(changes, self.run)
            return {"version": 0, "runs": [], "next": 1, "buckets": self.buckets or buckets_for(changes), "run": self.run, "columns": columns, "horizon": None}
        if (wanted := buckets_for(changes)) >= 2 * state["buckets"] and self._bytes(state["runs"]) < BUCKET_BYTES * wanted:
            state = state | {"buckets": wanted}
            if state["runs"]:
                state = self._merge(state, state["runs"], max(level for _, level, *_ in state["runs"]))
        return state

    def _bytes(self, runs: list[list[int]]) -> int:
        return sum(self.files.size(self._folder(r[0])) for r in runs)

    def _merge(self, state: dict, runs: list[list[int]], level: int) -> dict:
        """Merge some runs into one. What counts is the order columns, so any set of runs may be merged, and without a
        horizon tombstones stay. Buckets that have outgrown their size are split."""
        per_bucket = self._bytes(runs) // BUCKET_BYTES // state["buckets"]
        if per_bucket >= 2:
            state = state | {"buckets": min(MOST_BUCKETS, state["buckets"] << per_bucket.bit_length() - 1)}
        rows = bucketed.moved(self._newest(state, runs), bucketed.session_with(self.spark, state["buckets"]))
        if state["horizon"] is not None and len(runs) == len(state["runs"]):
            rows = rows.filter(~col(self.tombstone) | (col(self.order[0]) >= state["horizon"]))
        if any(r[3] != state["buckets"] for r in runs):
            rows = rows.repartition(state["buckets"], col(self.key))
        merged = self._write(rows.withColumn(self.run, F.lit(0)), state, level, 1, sum(r[2] for r in runs))
        state = state | {"version": state["version"] + 1, "runs": [*[r for r in state["runs"] if r not in runs], *merged]}
        self._commit(state)
        return state

    def _write(self, rows: DataFrame, state: dict, level: int, batches: int, most: int = 0) -> list[list[int]]:
        """Write the rows of batches 0, 1, ... as runs that follow each other; the runs that have rows."""
        # a failed write may have left files under its number: each attempt takes one that nobody used
        used = [int(n.partition("=")[2]) for n in self.files.names(f"{self.root}/data") if n.startswith(f"{self.run}=")]
        first = max([state["next"] - 1, *used]) + 1
        state["next"] = first + batches
        options = {"compression": "zstd"}
        if level:
            ndv = max(1, most // state["buckets"])
            options |= {f"parquet.bloom.filter.enabled#{self.key}": "true", f"parquet.bloom.filter.expected.ndv#{self.key}": str(ndv)}
        seen = Observation()
        # the aggregation before shuffles into as many partitions as there are buckets, so writing needs no second shuffle
        rows = rows.withColumn(self.run, F.col(self.run) + first).observe(seen, *[F.count_if(F.col(self.run) == first + k).alias(f"n{k}") for k in range(batches)])
        bucketed.write(rows, f"{self.root}/data", self.run, state["buckets"], self.keys, options)
        n = seen.get
        return [[first + k, level, n[f"n{k}"], state["buckets"]] for k in range(batches) if n[f"n{k}"]]

    def compact(self, horizon: int | None = None) -> int:
        """Merge all runs into one; the number of the new version.

        With ``horizon``, tombstones whose first order column lies below it go, and so do older changes
        that are appended later. Files of the old runs stay for readers until ``vacuum``.
        """
        state = self._state()
        if state is None:
            return 0
        if horizon is not None:
            state["horizon"] = max(horizon, state["horizon"] if state["horizon"] is not None else horizon)
        if not state["runs"]:
            self._commit(state | {"version": state["version"] + 1})
            return state["version"] + 1
        return self._merge(state, state["runs"], max([1, *[level for _, level, *_ in state["runs"]]]))["version"]

    def vacuum(self) -> None:
        """Delete the files of runs that are no longer live, and all version files but the last."""
        for name in [n for n in self.files.names(f"{self.root}/versions") if n.endswith(".json")][:-1]:
            self.files.delete(f"{self.root}/versions/{name}")
        live = {f"{self.run}={r[0]}" for r in (self._state() or {"runs": []})["runs"]}
        for name in self.files.names(f"{self.root}/data"):
            if name.startswith(f"{self.run}=") and name not in live:
                self.files.delete(f"{self.root}/data/{name}")

    # -- reading ----------------------------------------------------------------------------------------

    def _scan(self, state: dict, runs: list[list[int]]) -> DataFrame:
        """All rows of these runs; one scan, but for runs of a time when the log had fewer buckets."""
        alike: dict[int, list[int]] = {}
        for number, _, _, buckets in runs:
            alike.setdefault(buckets, []).append(number)
        parts = [bucketed.read(self.spark, f"{self.root}/data", state["columns"], self.run, numbers, buckets, self.keys) for buckets, numbers in alike.items()]
        rows = parts[0] if parts else self.spark.createDataFrame([], T.StructType.fromDDL(state["columns"]))
        for p in parts[1:]:
            rows = rows.unionByName(p)
        return rows

    def _newest(self, state: dict, runs: list[list[int]], where: Column | None = None, columns: Sequence[str] | None = None) -> DataFrame:
        """The newest change of each key in these runs, by scans that predicates and bucket pruning reach."""
        rows = self._scan(state, runs)
        if columns is not None:
            rows = rows.select(*[col(c) for c in columns])
        if where is not None:
            rows = rows.filter(where)
        # a run has each key once
        return rows if len(runs) <= 1 else newest(rows, self.keys, self.order, self.tombstone)

    def _merged(self, where: Column | None = None, columns: Sequence[str] | None = None) -> DataFrame:
        """The newest change of each key in all live runs: a k-way merge of the sorted files, or where only some keys are wanted, or
        values have no order in Arrow, an aggregation of the scans."""
        state = self._state()
        if state is None:
            raise ValueError(f"nothing has been appended to {self.root}")
        runs, schema = state["runs"], T.StructType.fromDDL(state["columns"])
        schema = T.StructType([f for f in schema if columns is None or f.name in columns])
        folders = [self._folder(r[0]) for r in runs]
        alike = len(runs) > 1 and len({r[3] for r in runs}) == 1 and len(self.keys) == 1
        if where is not None or not alike or not bucketed.can_merge(schema, folders):
            return self._newest(state, runs, where, columns)
        ranks = [(c, "descending") for c in [*self.order, self.tombstone, *_ranked(schema, self.keys, self.order, self.tombstone)]]
        rows = bucketed.merge(self.spark, folders, runs[0][3], schema, self.key, ranks)
        return rows if columns is None else rows.select(*[col(c) for c in columns])

    def merged(self, where: Column | None = None) -> DataFrame:
        """The newest change of each key, tombstones included; ``where`` may restrict the keys."""
        return self._merged(where)

    def read(self, where: Column | None = None, columns: Sequence[str] | None = None) -> DataFrame:
        """The current state: one row per live key. ``columns``, if given, are all that is read."""
        wanted = None if columns is None else list(dict.fromkeys([*self.keys, *self.order, self.tombstone, *columns]))
        live = self._merged(where, wanted).filter(~col(self.tombstone))
        return live if columns is None else live.select(*[col(c) for c in columns])

    def greatest(self, column: str):
        """The greatest value of a column over all live runs, or None."""
        state = self._state()
        if state is None or not state["runs"]:
            return None
        return self._scan(state, state["runs"]).agg(F.max(col(column))).first()[0]

    def get(self, key) -> DataFrame:
        """The live row of one key, or none."""
        return self.read(col(self.key) == F.lit(key))

    def scan(self, start=None, end=None) -> DataFrame:
        """Live rows with ``start <= key < end`` in order of key."""
        where = F.lit(True)
        if start is not None:
            where &= col(self.key) >= F.lit(start)
        if end is not None:
            where &= col(self.key) < F.lit(end)
        return self.read(where).orderBy(col(self.key))


def apply_feed(log: ChangeLog, feed: DataFrame, arrived: str, batches: int, period: int = 86_400) -> None:
    """Append a whole feed in one pass as up to ``batches`` runs.

    Deliveries are dealt to the runs by the period of their arrival (a number, or a timestamp's seconds, over ``period``), in turn;
    those without a time go to the first. What order they come in makes no difference, so no pass is spent on finding cuts.
    """
    time = col(arrived)
    if isinstance(feed.schema[arrived].dataType, (T.TimestampType, T.TimestampNTZType)):
        time = F.unix_seconds(time.cast("timestamp"))
    batch = F.coalesce(F.pmod(F.floor(time / period).cast("long"), F.lit(batches)), F.lit(0))
    log.append_batches(feed, batch, batches)
