"""Bucketed, sorted Parquet folders, written and read without leaving a table in the catalog.

Spark knows buckets only for tables. A table is therefore registered for the moment in which a plan is made and dropped at once: the
plan holds all it needs, the folder stays, and a shared catalog never fills up with tables of runs.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from millrace.functions.columns import col, quoted
from millrace.sources.files import Files
from millrace.sources.workers import ship

_sessions: dict[tuple, SparkSession] = {}
#: Rows of a sorted file that a merge holds at once.
BATCH = 1 << 16


def session_with(spark: SparkSession, partitions: int) -> SparkSession:
    """A session beside ``spark`` with its settings but its own number of shuffle partitions, so that nobody else's plans change."""
    key = spark.sparkContext.applicationId, partitions
    if key not in _sessions:
        own = spark.newSession()
        for name, value in spark.conf.getAll.items():
            if spark.conf.isModifiable(name):
                own.conf.set(name, value)
        own.conf.set("spark.sql.shuffle.partitions", str(partitions))
        # folders say which partitions there are, no catalog, so that a plan outlives its table
        own.conf.set("spark.sql.hive.manageFilesourcePartitions", "false")
        _sessions[key] = own
    return _sessions[key]


def moved(rows: DataFrame, session: SparkSession) -> DataFrame:
    """The same plan in another session of the application."""
    name = f"moved_{uuid.uuid4().hex}"
    rows.createGlobalTempView(name)
    try:
        return session.table(f"global_temp.{name}")
    finally:
        session.catalog.dropGlobalTempView(name)


def write(rows: DataFrame, path: str, parts: str, buckets: int, by: Sequence[str], options: dict[str, str]) -> None:
    """Add folders ``parts=N`` below ``path``, hashed into buckets by the first column of ``by`` and sorted by all."""
    # a table that is there already is appended to; one made by the write would first empty the folder
    name, session = f"written_{uuid.uuid4().hex}", rows.sparkSession
    columns = ", ".join(f"{quoted(f.name)} {f.dataType.simpleString()}" for f in rows.schema.fields)
    keys, given = ", ".join(map(quoted, by)), ", ".join(f"'{k}' '{v}'" for k, v in options.items())
    session.sql(f"CREATE TABLE {name} ({columns}) USING parquet OPTIONS ({given}) PARTITIONED BY ({quoted(parts)}) CLUSTERED BY ({quoted(by[0])}) SORTED BY ({keys}) INTO {buckets} BUCKETS LOCATION '{path}'")
    try:
        rows.write.mode("append").format("parquet").partitionBy(parts).bucketBy(buckets, by[0]).sortBy(*by).saveAsTable(name)
    finally:
        session.sql(f"DROP TABLE {name}")


def read(spark: SparkSession, path: str, columns: str, parts: str, numbers: Sequence[int], buckets: int, by: Sequence[str]) -> DataFrame:
    """A scan of the folders ``parts=N`` of these numbers that knows their buckets."""
    name = f"read_{uuid.uuid4().hex}"
    keys = ", ".join(map(quoted, by))
    session_with(spark, buckets).sql(
        f"CREATE TABLE {name} ({columns}, {quoted(parts)} INT) USING parquet PARTITIONED BY ({quoted(parts)}) CLUSTERED BY ({quoted(by[0])}) SORTED BY ({keys}) INTO {buckets} BUCKETS LOCATION '{path}'"
    )
    try:
        return spark.table(name).filter(col(parts).isin(list(numbers))).drop(parts)
    finally:
        spark.sql(f"DROP TABLE {name}")


# -- merging sorted files -----------------------------------------------------------------------------------

_PLAIN = (T.StringType, T.IntegralType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BinaryType, T.DecimalType)


def _file_system(path: str):
    from pyarrow import fs

    scheme, colon, rest = path.partition(":")
    if not colon or scheme == "file":
        return fs.LocalFileSystem(), "/" + (rest if colon else path).lstrip("/")
    return fs.FileSystem.from_uri(path)


def can_merge(schema: T.StructType, paths: list[str]) -> bool:
    """Whether the values have an order in Arrow and the files a file system there."""
    if not all(isinstance(f.dataType, _PLAIN) for f in schema):
        return False
    try:
        return all(_file_system(p) for p in paths)
    except (pa.ArrowException, OSError, ValueError):
        return False


class _Head:
    """The part of a sorted file that has been read but not merged yet."""

    def __init__(self, path: str, schema: pa.Schema, key: str):
        import pyarrow.parquet as pq

        fs, place = _file_system(path)
        self.file = pq.ParquetFile(fs.open_input_file(place))
        self.batches = self.file.iter_batches(BATCH, columns=schema.names)
        self.schema, self.key, self.rows, self.more = schema, key, None, True
        self.fill()

    def fill(self) -> None:
        """Have rows, or none for good."""
        while self.more and not self.rows:
            batch = next(self.batches, None)
            self.more = batch is not None
            if self.more:
                self.rows = pa.Table.from_batches([batch]).select(self.schema.names).cast(self.schema, safe=False)
        if not self.more and not self.rows:
            self.file.close()

    def last(self) -> pa.Scalar:
        return self.rows[self.key][-1]

    def upto(self, bound: pa.Scalar | None) -> pa.Table:
        n = len(self.rows) if bound is None else pc.sum(pc.less_equal(self.rows[self.key], bound)).as_py() or 0
        out, self.rows = self.rows.slice(0, n), self.rows.slice(n)
        return out


def _least(values: list[pa.Scalar]) -> pa.Scalar:
    return pc.min(pa.array([v.as_py() for v in values], values[0].type)) if values else None


def merged_rows(paths: list[str], schema: pa.Schema, key: str, ranks: list[tuple[str, str]]) -> Iterator[pa.RecordBatch]:
    """Merge files that are sorted by ``key``, in which no key is null: of each key the row that ranks first.

    All files advance together: what lies at or before the least of their last keys read so far is complete and goes out. At most a
    batch of each file is held.
    """
    heads = [h for h in (_Head(p, schema, key) for p in paths) if h.rows]
    while heads:
        bound = _least([h.last() for h in heads if h.more])
        parts = [p for h in heads if len(p := h.upto(bound))]
        rows = pa.concat_tables(parts).combine_chunks()
        if len(parts) > 1:
            rows = rows.take(pc.sort_indices(rows, sort_keys=[(key, "ascending"), *ranks], null_placement="at_end"))
            keys = rows[key].combine_chunks()
            rows = rows.filter(pa.concat_arrays([pa.array([True]), pc.not_equal(keys[1:], keys[:-1])]))
        yield from rows.combine_chunks().to_batches()
        for h in heads:
            h.fill()
        heads = [h for h in heads if h.rows]


def merge(spark: SparkSession, folders: list[str], buckets: int, schema: T.StructType, key: str, ranks: list[tuple[str, str]]) -> DataFrame:
    """Sorted folders of equal buckets as one: a merging reader per bucket, no sort and no shuffle.

    ``ranks`` order the rows of one key, as ``(column, "ascending" or "descending")``, nulls last.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    ship(spark)
    files = Files(spark)
    of_bucket: dict[int, list[str]] = {}
    for folder in folders:
        for name in files.names(folder):
            if (m := re.search(r"_(\d{5,})(?:\.c\d+)?\.", name)) and not name.startswith((".", "_")):
                of_bucket.setdefault(int(m.group(1)), []).append(f"{folder}/{name}")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket in batch["id"].to_pylist():
                yield from merged_rows(of_bucket.get(bucket, []), arrow, key, ranks)

    return spark.range(0, buckets, 1, buckets).mapInArrow(run, schema)
