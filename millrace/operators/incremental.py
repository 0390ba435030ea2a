"""Processing only new or changed records.

A table's version is a manifest: its immutable files and, for each, a deletion vector that masks row positions. Both
are tables themselves, vectors as words of ``WORD`` positions of which each bit masks one. ``Consumer`` diffs the manifest that it processed last
with a newer one: added files give inserts, removed files deletes, and of a file that both list the positions that one vector
masks and the other doesn't. Its job's output and the processed version are saved by one commit, so that a failed run leaves
nothing behind and a repeated one repeats nothing.

A log of runs over numbered segments is such a consumer's history. ``processed`` folds it into one manifest, in which the
deliveries that no successful run took are masked; ``delta`` takes over that version, and the next run's
diff are exactly the deliveries that are left.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.columns import col, fresh
from millrace.functions.joins import join_measured
from millrace.sources import workspace
from millrace.sources.files import Files

#: Row positions in one word of a deletion vector.
WORD = 64
MANIFEST = "file string, word long, mask long"


def successful(runs: DataFrame) -> DataFrame:
    """The runs that count: status ``done`` when trimmed and in lower case, with an end, a start and a range.

    A run logged twice counts once; a range that is empty or reversed takes nothing.
    """
    return runs.filter((F.lower(F.trim("run_status")) == "done") & F.col("finished_at").isNotNull() & F.col("started_at").isNotNull()).select(
        F.greatest("last_checkpointed_segment", F.lit(0)).alias("low"), F.col("current_segment").alias("high"), "started_at",
        "last_checkpointed_segment", "current_segment",
    ).dropna().filter("low < high").select("low", "high", "started_at").distinct()


def manifest(runs: DataFrame, segments: DataFrame) -> DataFrame:
    """The processed state: ``wal_segment, taken_until`` for each given segment that a successful run took.

    Ranges may overlap, leave gaps and be of any length. Each is cut into at most two dyadic blocks per level of a binary
    tree over segment numbers, and each segment looks up the blocks above it; so the work is
    (runs + segments) x levels, whatever the ranges are, and no run is expanded into its segments. ``segments`` must
    not be negative.
    """
    # no block above the last segment's highest bit can matter; a range that ends beyond it is cut there
    last = segments.agg(F.max("wal_segment")).first()[0]
    levels = int(last or 0).bit_length()
    # an aligned block of 2**k segments belongs to a range if the range holds it but not all of its parent
    k = F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("k")
    first = F.expr("shiftright(low - 1, k) + 1")
    end = F.expr("shiftright(high, k)")
    odd_first = F.when((first % 2 == 1) & (first < end), first)
    odd_last = F.when((end % 2 == 1) & (first < end), end - 1)
    ranges = successful(runs)
    if levels < 63:
        ranges = ranges.withColumn("high", F.least("high", F.lit(1 << levels)))
    blocks = ranges.select("*", k).select("k", "started_at", F.explode(F.array_distinct(F.array(odd_first, odd_last))).alias("block")).dropna()
    blocks = blocks.groupBy("k", "block").agg(F.max("started_at").alias("started_at"))
    above = segments.select("wal_segment", k).withColumn("block", F.expr("shiftright(wal_segment, k)"))
    # both sides grow with the log, so neither is broadcast
    return above.join(blocks.hint("merge"), ["k", "block"]).groupBy("wal_segment").agg(F.max("started_at").alias("taken_until"))


def mark(deliveries: DataFrame, runs: DataFrame) -> DataFrame:
    """The deliveries with ``added`` (their segment is new to the manifest) and ``masked`` (a run has taken them).

    Both names get an underscore for each column of that name that the deliveries have already.
    """
    facts = deliveries.select("wal_segment").distinct().filter("wal_segment >= 0")
    until, added, masked = fresh(deliveries, "taken_until", "added", "masked")
    processed = workspace.keep(manifest(runs, workspace.keep(facts, "log-segments")).withColumnRenamed("taken_until", until), "processed-manifest")
    rows = join_measured(deliveries, processed, ["wal_segment"], "left")
    taken = F.coalesce(F.col("arrived_at") <= F.col(until), F.lit(False))
    return rows.select(*[col(c) for c in deliveries.columns], F.col(until).isNull().alias(added), taken.alias(masked))


def _plain(file: Column) -> Column:
    """A file's name; Spark and Hadoop write one, two or three slashes behind a scheme."""
    return F.regexp_replace(file, "^([^:/]+):/+", "$1:/")


def manifest_table(files: DataFrame, masked: DataFrame | None = None) -> DataFrame:
    """A version's manifest from its files (``file``, written as in ``_metadata.file_path``) and the positions deleted in them (``file, place``).

    One row per file, and one per word of positions of which some are masked. Names may repeat.
    """
    out = files.select(_plain(F.col("file")).alias("file")).distinct().select("file", F.lit(None).cast("long").alias("word"), F.lit(None).cast("long").alias("mask"))
    if masked is None:
        return out
    word = F.floor(F.col("place") / WORD)
    words = masked.groupBy("file", word.alias("word")).agg(F.bit_or(_bit(F.col("place"))).alias("mask"))
    return out.unionByName(words.withColumn("file", _plain(F.col("file"))))


def _bit(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), (place % WORD).cast("int"))


def _masks(mask: Column, place: Column) -> Column:
    """Whether a word masks a position; null masks nothing."""
    return F.coalesce(mask.bitwiseAND(_bit(place)) != 0, F.lit(False))


class Consumer:
    """Exactly-once runs of a job over versioned Parquet input.

    ``root`` holds a folder per output, one per manifest, and one commit file per processed version. The commit names both the
    output and the manifest of the input, so there is one atomic step: what has no commit never happened. The driver holds
    the paths of files that it opens, as for any scan; vectors and records stay in tables.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark)

    def _commits(self) -> list[str]:
        return [n for n in self.files.names(f"{self.root}/commits") if n.endswith(".json")]

    def last(self) -> dict:
        """The last commit, or an empty state."""
        names = self._commits()
        return json.loads(self.files.read(f"{self.root}/commits/{names[-1]}")) if names else {"version": 0, "manifest": None, "output": None}

    def outputs(self) -> list[str]:
        return [p for n in self._commits() if (p := json.loads(self.files.read(f"{self.root}/commits/{n}"))["output"])]

    def manifest(self) -> DataFrame:
        """The input version that was processed last."""
        path = self.last()["manifest"]
        return self.spark.read.schema(MANIFEST).parquet(path) if path else self.spark.createDataFrame([], MANIFEST)

    def changes(self, now: DataFrame, whole: bool = False) -> DataFrame | None:
        """The records that differ between the last processed version and the manifest ``now``, with ``change`` (insert or delete).

        Files that both list with equal vectors aren't opened; None if there are no others. All others are read in one scan and
        meet their vectors by file and word. ``whole`` opens all files and adds the records that stay as they were, with
        ``change`` same. The name gets an underscore for each column of that name.
        """
        digest = F.bit_xor(F.xxhash64("word", "mask"))
        old = self.manifest()
        before, after = (m.groupBy("file").agg(digest.alias(name)) for m, name in ((old, "d1"), (now, "d2")))
        status = before.join(after, "file", "full_outer").select("file", F.col("d1").isNotNull().alias("was"), F.col("d2").isNotNull().alias("stays"), (~F.col("d1").eqNullSafe(F.col("d2"))).alias("differs"))
        status = workspace.keep(status, "manifest-diff")
        if status.filter("differs").isEmpty():
            return None
        touched = status if whole else status.filter("differs")
        rows = self.spark.read.option("mergeSchema", "true").parquet(*sorted(unquote(r.file) for r in touched.select("file").toLocalIterator()))
        names = fresh(rows, "file", "nth", "place", "word", "was", "stays", "m1", "m2", "change")
        file, nth, place, word, was, stays, m1, m2, change = names
        columns = rows.columns
        rows = rows.select(*[col(c) for c in columns], _plain(F.col("_metadata.file_path")).alias(file), F.col("_metadata.row_index").alias(place))
        rows = rows.withColumn(word, F.floor(F.col(place) / WORD))
        # within this diff a file goes by its number, which is far shorter than its path
        touched = workspace.keep(touched.select("file", F.monotonically_increasing_id().alias(nth), F.col("was").alias(was), F.col("stays").alias(stays)), "manifest-files")
        masks = old.filter("word is not null").join(now.filter("word is not null").withColumnRenamed("mask", "other"), ["file", "word"], "full_outer")
        masks = join_measured(masks, touched.select("file", nth), ["file"], "inner")
        masks = workspace.keep(masks.select(nth, F.col("word").alias(word), F.col("mask").alias(m1), F.col("other").alias(m2)), "manifest-masks")
        rows = join_measured(rows, touched.withColumnRenamed("file", file), [file], "left")
        rows = join_measured(rows, masks, [nth, word], "left")
        then, there = F.col(was) & ~_masks(F.col(m1), F.col(place)), F.col(stays) & ~_masks(F.col(m2), F.col(place))
        lost = F.raise_error(F.concat(F.lit("a file was read under a name that the manifest lacks: "), F.col(file))).cast("string")
        kind = F.when(F.col(was).isNull(), lost).when(there & ~then, "insert").when(then & ~there, "delete")
        if whole:
            kind = kind.when(then & there, "same")
        return rows.select(*[col(c) for c in columns], kind.alias(change)).filter(F.col(change).isNotNull())

    def _commit(self, version: int, now: DataFrame, output: str | None) -> int:
        path = f"{self.root}/manifests/{version:012d}-{uuid.uuid4().hex[:12]}"
        now.write.parquet(path)
        if not self.files.create(f"{self.root}/commits/{version:012d}.json", json.dumps({"version": version, "manifest": path, "output": output})):
            for p in (path, output):
                if p:
                    self.files.delete(p)
            raise RuntimeError(f"version {version} was committed by another run")
        return version

    def adopt(self, processed: DataFrame) -> int:
        """Commit a manifest as processed, without an output: how a consumer takes over what others have processed."""
        return self._commit(self.last()["version"] + 1, processed, None)

    def run(self, now: DataFrame, job: Callable[[DataFrame], DataFrame], whole: bool = False) -> int:
        """Process what changed up to the manifest ``now``; the version then in force. Without changes nothing is committed."""
        version = self.last()["version"]
        rows = self.changes(now, whole)
        if rows is None:
            return version
        # a folder name of its own for each attempt: a failed one is never mixed with its successor
        target = f"{self.root}/out/{version + 1:012d}-{uuid.uuid4().hex[:12]}"
        job(rows).write.parquet(target)
        return self._commit(version + 1, now, target)


NAME = ["rec_key", "iter_index", "seq"]


def processed(log: DataFrame, runs: DataFrame) -> DataFrame:
    """The manifest that a log's successful runs amount to: all files of ``log``, a plain scan of Parquet files, with the deliveries
    masked that no run took."""
    placed = log.select("wal_segment", "arrived_at", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("place"))
    return manifest_table(placed.select("file"), mark(placed, runs).filter(f"not {fresh(placed, 'masked')[0]}").select("file", "place"))


def unprocessed(rows: DataFrame) -> DataFrame:
    """The consumer's job: changes of which no delivery had been processed, each once.

    A change that was delivered again in a new segment isn't taken again, so the deliveries that stay have a say.
    """
    return rows.groupBy(*NAME).agg(F.max(F.col(rows.columns[-1]) != "insert").alias("done")).filter("not done").select(*NAME)


def delta(log: DataFrame, runs: DataFrame, root: str) -> DataFrame:
    """The changes that no successful run has processed, ``rec_key, iter_index, seq``, each once.

    ``log`` is a plain scan of Parquet files. A consumer below ``root`` takes over the version that the runs had processed, runs up to
    the log as it is now, and its committed output is the result. A delivery without a
    segment, or with a negative one, or without a time of arrival, has not been taken. Nulls in the name of a change are
    compared as equal. If nothing is left, or the log has no file, the result is empty.
    """
    spark, consumer = log.sparkSession, Consumer(log.sparkSession, root)
    before = consumer.adopt(processed(log, runs))
    now = spark.createDataFrame([(p,) for p in log.inputFiles()], "file string")
    if consumer.run(manifest_table(now), unprocessed, whole=True) == before:
        return log.select(*NAME).limit(0)
    return spark.read.schema(log.select(*NAME).schema).parquet(consumer.last()["output"])
