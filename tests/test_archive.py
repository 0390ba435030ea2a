import zlib
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from millrace.functions import joins
from millrace.functions.columns import plain_path
from millrace.operators import archive

T0 = datetime(2025, 1, 1)
FEED = "record_id long, rec_key string, rec_value string, deleted boolean, iter_index long, seq long, sst_path string, arrived_at timestamp_ntz, path string, level int"
LOG = "entry_id long, log_action string, sst_path string, sst_level string, file_size long, logged_at timestamp_ntz"


def at(m):
    return datetime(2025, 1, 1, 0, m)


def test_plain_path(spark):
    cases = {" data//a/./b.bin": "data/a/b.bin", "./data/a": "data/a", "data/x/../a": "data/a", "a/b": "a/b", "././a": "a", "../a": "../a", "": "", "a/.": "a", None: None}
    cases |= {"a/b/c/d/e/f/../../../../../../g": "g", "a/b/..": "a", "a/..": "", "a/../../b": "../b", "../../a/..": "../..", "/../a/": "/a", "/": "/", "a/b/": "a/b", ".": "", "..": "..", "a/...": "a/..."}
    df = spark.createDataFrame([(k,) for k in cases], "p string")
    assert {r.p: r.q for r in df.select("p", plain_path(F.col("p")).alias("q")).collect()} == cases


def test_files_in_force(spark):
    rows = [
        (1, "ADD", "a", "L0", 10, at(1)), (2, "ADD", "./a", "L1", None, at(5)), (3, "REMOVE", "a", None, None, at(3)),
        (4, "ADD", "b", "L0", 5000, at(1)), (5, "ADD", "b ", "L0", 100, at(0)),
        (6, "ADD", "c", "L2", 7, at(1)), (7, "REMOVE", "c", None, None, at(2)),
        (8, "ADD", "d", "L0", -1, at(1)), (9, "ADD", "d", "L0", 0, at(2)),
        (10, "ADD", None, "L0", 1, at(1)), (11, "ADD", "e", None, 4095, None),
    ]
    got = {r.sst_path: (r.sst_level, r.in_force, r.tiny, r.file_size) for r in archive.files_in_force(spark.createDataFrame(rows, LOG)).collect()}
    assert got == {"a": ("L1", True, True, 10), "b": ("L0", True, False, 5000), "c": (None, False, False, 7), "d": ("L0", True, False, None), "e": (None, True, True, 4095)}


@pytest.fixture
def small(spark):
    feed = [
        (1, "k1", "v", False, 1, 1, "a", T0, "x", 1), (2, "k1", "v", False, 1, 1, "b", T0, None, None), (3, "k2", "é\n\"\\", False, 1, 2, " ./a", T0, None, 2),
        (4, "k3", None, True, 1, 3, None, None, None, None), (5, "k4", "", False, 2, 1, "gone", T0, None, None), (6, None, "n", None, 2, 2, "", T0, None, None),
        (7, "k5", "z" * 50_000, False, 2, 3, "big", T0, None, None), (8, "k6", "p", False, None, 5, "a", T0, None, None), (9, "k6", "q", False, None, 5, "a", T0, None, None),
    ]
    log = [(1, "ADD", "a", "L0", 10, at(1)), (2, "ADD", "b", "L1", 10, at(1)), (3, "ADD", "empty", "L1", 10, at(1)), (4, "ADD", "big", "L2", 90000, at(1)), (5, "ADD", "gone", "L0", 3, at(1)), (6, "REMOVE", "gone", None, None, at(2))]
    return spark.createDataFrame(feed, FEED), spark.createDataFrame(log, LOG)


def test_every_change_is_packed_once_and_restored(spark, folder, small):
    feed, log = small
    arc = archive.pack(feed, log, folder + "/arc", target=20_000)
    back = archive.restore(arc, feed.schema)
    assert back.count() == 8
    assert back.drop("member_path").exceptAll(feed).count() == 0
    # the repeated change lies in the greatest of its files in force
    assert [r.member_path for r in back.filter("rec_key = 'k1'").collect()] == ["b"]
    assert [r.rec_value for r in archive.restore(arc, feed.schema, "big").collect()] == ["z" * 50_000]


def test_index_points_at_the_bytes(spark, folder, small):
    arc = archive.pack(*small, folder + "/arc")
    data = {r.container_id: r for r in arc.containers.collect()}
    members = arc.index.collect()
    for m in members:
        piece = data[m.container_id].data[m.offset : m.offset + m.length]
        assert zlib.crc32(piece) == m.crc32 and piece.count(b"\n") == m.n_records
    assert {m.path: (m.level, m.length > 0) for m in members} == {"a": ("L0", True), "b": ("L1", True), "empty": ("L1", False), "big": ("L2", True), "gone": ("L0", True), "": ("L0", True)}
    assert {(r.sst_path, r.sst_level) for r in archive.replaced(arc).collect()} == {("a", "L0"), ("b", "L1"), ("empty", "L1")}
    damaged = arc.containers.withColumn("members", F.transform("members", lambda m: m.withField("crc32", m["crc32"] + 1)))
    damaged.write.parquet(folder + "/bad/containers")
    with pytest.raises(Exception, match="bad checksum"):
        archive.restore(archive.Archive(spark, folder + "/bad"), small[0].schema).collect()


def test_a_huge_file_is_split_and_containers_are_well_sized(spark, folder):
    feed = spark.range(3000).select(F.col("id").alias("record_id"), F.concat(F.lit("key"), "id").alias("rec_key"), F.lit("v" * 20).alias("rec_value"), F.lit(False).alias("deleted"), F.lit(1).cast("long").alias("iter_index"), F.col("id").alias("seq"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("f"), F.col("id") % 200)).alias("sst_path"), F.lit(T0).alias("arrived_at"))
    log = feed.select("sst_path").distinct().select(F.lit(1).cast("long").alias("entry_id"), F.lit("ADD").alias("log_action"), "sst_path", F.lit("L0").alias("sst_level"), F.lit(9).cast("long").alias("file_size"), F.lit(T0).alias("logged_at"))
    arc = archive.pack(feed, log, folder + "/arc", target=60_000)
    assert arc.index.filter("path = 'hot'").count() >= 4
    assert arc.index.count() == arc.index.select("path", "part").distinct().count()
    sizes = sorted(r.n_bytes for r in arc.containers.collect())
    assert sum(r.n_records for r in arc.containers.collect()) == 3000 and sizes[-1] < 120_000 and len(sizes) < 20


def test_empty_tables(spark, folder):
    arc = archive.pack(spark.createDataFrame([], FEED), spark.createDataFrame([], LOG), folder + "/arc")
    assert arc.containers.count() == 0 and archive.replaced(arc).count() == 0


def many(spark, n=4000):
    feed = spark.range(n).select(F.col("id").alias("record_id"), F.concat(F.lit("key"), F.col("id") % (n // 2)).alias("rec_key"), F.lit("v" * 20).alias("rec_value"), F.lit(False).alias("deleted"), F.lit(1).cast("long").alias("iter_index"), (F.col("id") % (n // 2)).alias("seq"), F.concat(F.lit("f"), F.col("id") % 300).alias("sst_path"), F.lit(T0).alias("arrived_at"))
    log = feed.select("sst_path").distinct().select(F.lit(1).cast("long").alias("entry_id"), F.lit("ADD").alias("log_action"), "sst_path", F.concat(F.lit("L"), F.substring("sst_path", -1, 1).cast("int") % 3).alias("sst_level"), F.lit(9).cast("long").alias("file_size"), F.lit(T0).alias("logged_at"))
    return feed, log


def test_files_are_joined_alike_whether_broadcast_or_merged(spark, folder, monkeypatch):
    feed, log = many(spark)
    one = archive.pack(feed, log, folder + "/one", target=50_000)
    monkeypatch.setattr(joins, "BROADCAST_BYTES", 0)
    two = archive.pack(feed, log, folder + "/two", target=50_000)
    rows = [sorted(archive.restore(a, feed.schema).collect()) for a in (one, two)]
    assert rows[0] == rows[1] and len(rows[0]) == 2000


def test_whole_records_cross_one_shuffle(spark, folder, monkeypatch):
    monkeypatch.setattr(archive, "TASK_CONTAINERS", 1)
    plans, feed_log = [], many(spark)
    frames = type(spark.range(1))
    real = frames.mapInPandas
    monkeypatch.setattr(frames, "mapInPandas", lambda df, *a: (plans.append(df._jdf.queryExecution().executedPlan().toString()), real(df, *a))[1])
    arc = archive.pack(*feed_log, folder + "/arc", target=50_000)
    (wide,) = [p for p in plans if "Union" in p]
    above = wide[: wide.index("Union")]
    assert above.count("Exchange") == 1 and "REPARTITION_BY_NUM" in above
    assert archive.restore(arc, feed_log[0].schema).count() == 2000
    assert arc.containers.select("container_id").distinct().count() == arc.containers.count() > 8


def test_one_file_is_read_from_one_container(spark, folder):
    feed, log = many(spark)
    arc = archive.pack(feed, log, folder + "/arc", target=50_000)
    assert arc.containers.count() > 8
    one = archive.restore(arc, feed.schema, "f217")
    assert {r.sst_path for r in one.collect()} == {"f217"} and len(one.inputFiles()) == 1
    assert archive.restore(arc, feed.schema, "no such file").count() == 0


def test_rows_without_ids_are_told_apart_by_all_columns(spark, folder):
    rows = [(None, "k", v, False, None, 1, "a", T0, None, None) for v in ("x", "y", "x")]
    arc = archive.pack(spark.createDataFrame(rows, FEED), spark.createDataFrame([(1, "ADD", "a", "L0", 10, at(1))], LOG), folder + "/arc")
    assert sorted(r.rec_value for r in archive.restore(arc, spark.createDataFrame(rows, FEED).schema).collect()) == ["x", "y"]
