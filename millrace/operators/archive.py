"""Many tiny files: indexed archive containers.

``files_in_force`` reads a manifest log and says which files count now. ``pack`` then lays the changes of
those files, byte by byte, into containers of about ``target`` bytes per level. Each container is one
binary block; an index, sorted by path, holds for each member its container's file, part, offset, length and
CRC-32, so one file is read back by opening one container, and all of them in parallel.

Which delivery of a change is packed is settled on narrow rows: files get numbers in the order in which they win, and each change
takes its greatest. Whole records cross one shuffle, by the bucket of their file, in which they meet the verdict, are
sorted by file and packed. A task gets some containers' worth of buckets; a file that is greater is spread over buckets, so
no task takes more than its share, whatever one file holds.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.columns import col, plain_path
from millrace.functions.joins import join_measured
from millrace.sources import workspace
from millrace.sources.workers import ship

TINY = 4096
#: Place of changes that lie in no file in force: still in memory, or their file was removed.
LOOSE_LEVEL = "L0"
#: Bytes around the key and the value of one record; only the plan uses it.
RECORD_BYTES = 190
#: Containers that a task fills on average, buckets that it gets on average, and files that are spread over buckets at most.
TASK_CONTAINERS, TASK_BUCKETS, SPREAD = 4, 16, 1 << 16
#: Containers that a task has open at most, one per level.
OPEN = 16

MEMBER = "path:string,part:long,in_force:boolean,tiny:boolean,offset:long,length:long,n_records:long,crc32:long,min_key:string,max_key:string"
CONTAINER = f"level string, container_id long, n_bytes long, n_records long, crc32 long, data binary, members array<struct<{MEMBER}>>"


@dataclass
class Archive:
    """Containers, and the index of their members, below one folder."""

    spark: SparkSession
    root: str

    @property
    def containers(self) -> DataFrame:
        return self.spark.read.schema(T.StructType.fromDDL(CONTAINER)).parquet(f"{self.root}/containers")

    @property
    def index(self) -> DataFrame:
        """One row per member, with the file that holds its container; sorted by path, so that a lookup passes over the rest."""
        return self.spark.read.schema(_index_schema()).parquet(f"{self.root}/index")


def _index_schema() -> T.StructType:
    return T.StructType([*T.StructType.fromDDL(MEMBER.replace(":", " ")).fields, *T.StructType.fromDDL("level string, container_id long, file string").fields])


def files_in_force(manifest: DataFrame, tiny: int = TINY) -> DataFrame:
    """One row per file of the manifest log, under its plain path.

    ``sst_path, sst_level, file_size, in_force, tiny``. The newest entry by ``logged_at`` decides (on a tie the
    greater ``entry_id``): a file is in force if that is an ADD, and has its level. The size is the newest
    positive one logged; a file with none has a null size and isn't tiny. Entries without a path
    name no file and are left out; one without a time is older than any with one.
    """
    when = F.struct("logged_at", "entry_id")
    sized = F.when(F.col("file_size") > 0, F.struct("logged_at", "entry_id", "file_size"))
    return (
        manifest.withColumn("sst_path", plain_path(F.col("sst_path")))
        .filter(F.col("sst_path").isNotNull())
        .groupBy("sst_path")
        .agg(F.max_by(F.struct("log_action", "sst_level"), when).alias("last"), F.max(sized)["file_size"].alias("file_size"))
        .select("sst_path", F.col("last.sst_level").alias("sst_level"), "file_size", F.coalesce(F.col("last.log_action") == "ADD", F.lit(False)).alias("in_force"))
        .withColumn("tiny", F.coalesce(F.col("in_force") & (F.col("file_size") < tiny), F.lit(False)))
    )


def _line(columns: list[T.StructField]) -> Column:
    """The bytes of one record: a JSON line. Times become text or microseconds, binary base64, so the line keeps all."""
    fields = []
    for f in columns:
        c = F.col("rec")[f.name]
        if isinstance(f.dataType, T.TimestampNTZType):
            c = c.cast("string")
        elif isinstance(f.dataType, T.TimestampType):
            c = F.unix_micros(c)
        elif isinstance(f.dataType, T.BinaryType):
            c = F.base64(c)
        fields.append(c.alias(f.name))
    return F.when(F.col("rec").isNotNull(), F.to_json(F.struct(*fields)))


class _Packer:
    """The containers of one task's buckets, written file by file; one is open per level."""

    def __init__(self, n_buckets: int, target: int):
        self.bucket, self.stride, self.target, self.made = 0, n_buckets + 1, target, 0
        self.open: dict[str | None, tuple[bytearray, list[dict]]] = {}
        self.out: list[dict] = []
        self.head, self.member, self.pieces = None, None, 0

    def close(self, level: str | None) -> None:
        data, members = self.open.pop(level)
        for m in members:
            m["crc32"] = zlib.crc32(data[m["offset"] : m["offset"] + m["length"]])
        row = {"level": level, "container_id": (self.bucket << 24) + self.made, "n_bytes": len(data), "n_records": sum(m["n_records"] for m in members), "crc32": zlib.crc32(data), "data": bytes(data), "members": members}
        self.out.append(row)
        self.made += 1

    def begin(self, bucket: int, head: dict) -> None:
        """The next file; in its home bucket one in force has a member even without records."""
        self.bucket, self.head, self.member, self.pieces = bucket, head, None, 0
        if head["home"] and head["in_force"]:
            self.piece()

    def piece(self) -> None:
        """A new member, in the open container of the file's level or in a new one."""
        level = self.head["level"]
        if level in self.open and len(self.open[level][0]) >= self.target:
            self.close(level)
        if level not in self.open and len(self.open) >= OPEN:
            self.close(max(self.open, key=lambda k: len(self.open[k][0])))
        data, members = self.open.setdefault(level, (bytearray(), []))
        part = self.pieces * self.stride + (0 if self.head["home"] else self.bucket + 1)
        self.member = {"path": self.head["path"], "part": part, "in_force": self.head["in_force"], "tiny": self.head["tiny"], "offset": len(data), "length": 0, "n_records": 0, "crc32": 0, "min_key": None, "max_key": None}
        members.append(self.member)
        self.pieces += 1

    def add(self, lines: list[str], keys: list[str | None]) -> None:
        """Records of the file. A container that is full is closed, and the file goes on in the next; one that the file shares with
        others may get half as great again, so that hardly any small file is split."""
        while lines:
            if self.member is None:
                self.piece()
            data, m = self.open[self.head["level"]][0], self.member
            size, n, room = 0, 0, (self.target * 3 // 2 if m["offset"] else self.target) - len(data)
            own = [x.encode() for x in lines]
            for line in own:
                size, n = size + len(line) + 1, n + 1
                if size >= room:
                    break
            data += b"\n".join(own[:n]) + b"\n"
            m["length"], m["n_records"] = len(data) - m["offset"], m["n_records"] + n
            if there := [x for x in (m["min_key"], m["max_key"], *keys[:n]) if x is not None]:
                m["min_key"], m["max_key"] = min(there), max(there)
            lines, keys = lines[n:], keys[n:]
            if size >= room:
                self.close(self.head["level"])
                self.member = None

    def take(self) -> list[dict]:
        out, self.out = self.out, []
        return out

    def end(self) -> list[dict]:
        for level in list(self.open):
            self.close(level)
        return self.take()


def _packed(batches: Iterator[pd.DataFrame], n_buckets: int, target: int) -> Iterator[pd.DataFrame]:
    """Containers from rows sorted by bucket and file, the file's own row before its records."""
    packer = _Packer(n_buckets, target)
    for pdf in batches:
        buckets, files = pdf["bucket"].to_numpy(), pdf["file_no"].to_numpy()
        change = (buckets[1:] != buckets[:-1]) | (files[1:] != files[:-1])
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), len(pdf)] if len(pdf) else []
        heads, keys, lines = pdf["head"].tolist(), pdf["rec_key"].tolist(), pdf["line"].tolist()
        for a, b in zip(cuts, cuts[1:], strict=False):
            if heads[a] is not None:
                packer.begin(int(buckets[a]), heads[a])
                a += 1
            packer.add(lines[a:b], keys[a:b])
            if done := packer.take():
                yield pd.DataFrame(done)
    if done := packer.end():
        yield pd.DataFrame(done)


def numbered_files(changes: DataFrame, files: DataFrame) -> DataFrame:
    """The files that records come from or that are in force: ``file_no, path, level, in_force, tiny, bytes, n_nameless``.

    A change that lies in several files goes to the one with the greatest number: those in force come after the others, and
    both in order of path. Loose records (path null in the feed) count as one file of the empty path.
    """
    bytes_of = F.coalesce(F.octet_length("rec_key"), F.lit(0)) + F.coalesce(F.octet_length("rec_value"), F.lit(0)) + RECORD_BYTES
    held = changes.groupBy(F.coalesce(plain_path(F.col("sst_path")), F.lit("")).alias("path")).agg(F.sum(bytes_of).alias("bytes"), F.count_if(F.col("record_id").isNull()).alias("n_nameless"))
    known = files.select(F.col("sst_path").alias("path"), "sst_level", "in_force", "tiny")
    in_force = F.coalesce("in_force", F.lit(False))
    sized = held.join(known, "path", "full_outer").filter(F.col("bytes").isNotNull() | F.col("in_force"))
    sized = sized.select("path", F.coalesce(F.when(F.col("in_force"), F.col("sst_level")), F.lit(LOOSE_LEVEL)).alias("level"), in_force.alias("in_force"), F.coalesce("tiny", F.lit(False)).alias("tiny"), F.coalesce("bytes", F.lit(0)).alias("bytes"), F.coalesce("n_nameless", F.lit(0)).alias("n_nameless"))
    return sized.orderBy("in_force", "path").select(F.monotonically_increasing_id().alias("file_no"), "*")


def pack(changes: DataFrame, manifest: DataFrame, root: str, *, target: int = 8 << 20, tiny: int = TINY) -> Archive:
    """Write the archive below ``root``.

    Every change, named by (``iter_index``, ``seq``), is packed once however often it was delivered: in its file in
    force if it has one (with several, the greatest path), else with its other file or the loose
    records at level L0; of its deliveries there the greatest ``record_id``, which must be unique. Rows that miss part of the name
    are told apart by ``record_id``, or without one by all their columns. Every file
    in force has a member, one of length 0 if no record was delivered for it. Columns that the
    feed has besides stay in the record; its columns must be scalars.
    """
    spark = changes.sparkSession
    ship(spark)
    files = workspace.keep(numbered_files(changes, files_in_force(manifest, tiny)), "archive-files")
    total, n_nameless = files.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.coalesce(F.sum("n_nameless"), F.lit(0))).first()
    n_tasks = total // (TASK_CONTAINERS * target) + 1
    # tasks get as many buckets each, give or take chance, so there are several to each
    n, share = n_tasks * TASK_BUCKETS, max(TASK_CONTAINERS * target // 2, total // SPREAD)
    # fewer than SPREAD files can hold more than a share each
    spread = workspace.keep(files.filter(F.col("bytes") > share).select("path", F.ceil(F.col("bytes") / share).alias("n_parts")), "archive-spread")
    columns = list(changes.schema.fields)
    # only a feed without ids must be read in full to tell its rows apart
    rid = F.col("record_id") if not n_nameless else F.coalesce("record_id", F.xxhash64(*[col(f.name) for f in columns]))
    nameless = F.col("iter_index").isNull() | F.col("seq").isNull()
    name = {"i": F.col("iter_index"), "s": F.col("seq"), "r": F.when(nameless, rid)}
    path = F.coalesce(plain_path(F.col("sst_path")), F.lit(""))

    def bucket(part: Column) -> Column:
        return F.pmod(F.when(F.col("n_parts").isNull(), F.xxhash64("path")).otherwise(F.xxhash64("path", part)), F.lit(n))

    def located(rows: DataFrame) -> DataFrame:
        rows = join_measured(rows, spread, ["path"], "left")
        return rows.withColumn("bucket", bucket(F.pmod(F.xxhash64(*name), F.col("n_parts"))))

    narrow = located(changes.select(path.alias("path"), rid.alias("rid"), *[c.alias(k) for k, c in name.items()]))
    narrow = join_measured(narrow.drop("n_parts"), files.select("path", "file_no"), ["path"], "inner")
    chosen = narrow.groupBy(*name).agg(F.max(F.struct("file_no", "rid", "bucket")).alias("b")).select("b.bucket", F.lit(1).alias("kind"), "b.rid", "b.file_no")
    records = located(changes.select(F.struct(*[col(f.name) for f in columns]).alias("rec"), path.alias("path"), rid.alias("rid"), *[c.alias(k) for k, c in name.items()]))
    records = records.select("bucket", F.lit(1).alias("kind"), "rid", "rec")
    parts = join_measured(files, spread, ["path"], "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("n_parts", F.lit(1)) - 1)))
    heads = parts.select(bucket(F.col("part")).alias("bucket"), F.lit(0).alias("kind"), F.col("file_no").alias("rid"), "file_no", F.struct((F.col("part") == 0).alias("home"), "path", "level", "in_force", "tiny").alias("head"))
    rows = records.unionByName(chosen, allowMissingColumns=True).unionByName(heads, allowMissingColumns=True).repartition(n_tasks, "bucket")
    # grouped within buckets, rows stay where that shuffle has brought them
    rows = rows.groupBy("bucket", "kind", "rid").agg(F.max("file_no").alias("file_no"), F.first("rec", ignorenulls=True).alias("rec"), F.max("head").alias("head"))
    rows = rows.filter("file_no is not null and (kind = 0 or rec is not null)").sortWithinPartitions("bucket", "file_no", "kind", "rec.iter_index", "rec.seq", "rid")
    packed = rows.select("bucket", "file_no", "head", "rec.rec_key", _line(columns).alias("line")).mapInPandas(lambda b: _packed(b, n, target), CONTAINER)
    # a row group ends after some containers, so that one is read without its neighbours
    packed.write.option("compression", "zstd").option("parquet.block.size", str(max(1 << 20, target))).parquet(f"{root}/containers")
    out = Archive(spark, root)
    members = out.containers.select("level", "container_id", F.col("_metadata.file_path").alias("file"), F.explode("members").alias("m")).select("m.*", "level", "container_id", "file")
    members.orderBy("path", "part").write.option("compression", "zstd").parquet(f"{root}/index")
    return out


def replaced(archive: Archive) -> DataFrame:
    """The tiny files in force that the containers replace."""
    return archive.index.filter("tiny and in_force and part = 0").select(F.col("path").alias("sst_path"), F.col("level").alias("sst_level"))


def restore(archive: Archive, schema: T.StructType, path: str | None = None) -> DataFrame:
    """The packed records, of all files or of one; a member whose checksum fails raises.

    For one file the index says which containers to open, in which files; a file that isn't spread has few.
    """
    ship(archive.spark)
    rows = archive.containers
    if path is not None:
        places = archive.index.filter(F.col("path") == path).select("file", "container_id").distinct().collect()
        if places:
            rows = archive.spark.read.schema(T.StructType.fromDDL(CONTAINER)).parquet(*sorted({p.file for p in places})).filter(F.col("container_id").isin([p.container_id for p in places]))
        else:
            rows = rows.limit(0)

    def unpacked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for data, members in zip(pdf["data"], pdf["members"], strict=True):
                for m in members:
                    if not m["length"] or path is not None and m["path"] != path:
                        continue
                    piece = data[m["offset"] : m["offset"] + m["length"]]
                    if zlib.crc32(piece) != m["crc32"]:
                        raise ValueError(f"bad checksum of {m['path']}, part {m['part']}")
                    yield pd.DataFrame({"path": m["path"], "line": piece.decode().split("\n")[:-1]})

    lines = rows.select("data", "members").mapInPandas(unpacked, "path string, line string")
    as_written = {T.TimestampType: T.LongType(), T.TimestampNTZType: T.StringType(), T.BinaryType: T.StringType()}
    raw = T.StructType([T.StructField(f.name, as_written.get(type(f.dataType), f.dataType)) for f in schema])
    rec = lines.select("path", F.from_json("line", raw).alias("r"))
    back = []
    for f in schema:
        c = F.col("r")[f.name]
        if isinstance(f.dataType, T.TimestampNTZType):
            c = c.cast("timestamp_ntz")
        elif isinstance(f.dataType, T.TimestampType):
            c = F.timestamp_micros(c)
        elif isinstance(f.dataType, T.BinaryType):
            c = F.unbase64(c)
        back.append(c.alias(f.name))
    return rec.select(F.col("path").alias("member_path"), *back)
