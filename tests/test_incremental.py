import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from millrace.operators import incremental
from millrace.operators.incremental import Consumer
from millrace.sources.files import Files

T0 = datetime(2025, 1, 1)
FEED = "rec_key string, iter_index long, seq long, wal_segment long, arrived_at timestamp_ntz, masked int, taken_until int"
RUNS = "run_id long, last_checkpointed_segment long, current_segment long, run_status string, started_at timestamp_ntz, finished_at timestamp_ntz, added int"


def t(s):
    return T0 + timedelta(seconds=s)


def brute(feed, runs):
    good = [r for r in runs if r[3] is not None and r[3].strip(" ").lower() == "done" and r[4] is not None and r[5] is not None and r[1] is not None and r[2] is not None]
    done, names = set(), set()
    for k, i, s, seg, at, *_ in feed:
        names.add((k, i, s))
        if seg is not None and at is not None and any(r[1] <= seg < r[2] and at <= r[4] for r in good):
            done.add((k, i, s))
    return names - done


def delta(spark, folder, feed, runs):
    spark.createDataFrame(feed, FEED).repartition(3).write.mode("append").parquet(f"{folder}/a log")
    return incremental.delta(spark.read.parquet(f"{folder}/a log"), spark.createDataFrame(runs, RUNS), f"{folder}/consumer")


@pytest.mark.parametrize("seed", range(4))
def test_against_brute_force(spark, folder, seed):
    rng = random.Random(seed)
    feed = [(f"k{rng.randrange(50)}", 1, rng.randrange(300), rng.choice([None, *range(40)]) if rng.random() < 0.2 else rng.randrange(40), None if rng.random() < 0.05 else t(rng.randrange(1000)), 1, 2) for _ in range(600)]
    status = ["done", " DONE ", "Done", "failed", "done?", None, ""]
    runs = []
    for i in range(25):
        low = rng.randrange(-3, 38)
        runs.append((i, low, rng.choice([low + rng.randrange(0, 9), low - 1, 2**50]) if rng.random() < 0.9 else None, rng.choice(status), t(rng.randrange(1000)), None if rng.random() < 0.2 else t(2000), 0))
    runs += runs[:5]
    out = delta(spark, folder, feed, runs)
    assert sorted(map(tuple, out.collect()), key=str) == sorted(brute(feed, runs), key=str)


def test_whole_log_taken_by_one_run(spark, folder):
    feed, runs = [("a", 1, i, i, t(0), 0, 0) for i in range(70)], [(1, 0, 64, "done", t(0), t(1), 0)]
    assert {r.seq for r in delta(spark, folder, feed, runs).collect()} == set(range(64, 70))
    marked = incremental.mark(spark.createDataFrame(feed, FEED), spark.createDataFrame(runs, RUNS))
    assert marked.columns[-2:] == ["added", "masked_"] and marked.filter("added").count() == 6


def test_nothing_left(spark, folder):
    assert delta(spark, folder, [("a", 1, 1, 3, t(0), 0, 0)], [(1, 0, 64, "done", t(0), t(1), 0)]).count() == 0


def test_segments_of_any_number_are_taken(spark, folder):
    feed = [("a", 1, 1, 2**40, t(0), 0, 0), ("b", 1, 2, 2**62 + 5, t(0), 0, 0), ("c", 1, 3, 2**63 - 1, t(0), 0, 0), ("d", 1, 4, 3, t(0), 0, 0)]
    runs = [(1, 2**40 - 1, 2**40 + 1, "done", t(0), t(1), 0), (2, 2**62, 2**63 - 1, "done", t(0), t(1), 0)]
    assert {r.rec_key for r in delta(spark, folder, feed, runs).collect()} == {"c", "d"}


def test_a_redelivery_in_a_new_segment_is_not_taken_again(spark, folder):
    feed = [("a", 1, 1, 1, t(0), 0, 0), ("a", 1, 1, 9, t(50), 0, 0), ("b", 1, 2, 1, t(20), 0, 0)]
    runs = [(1, 1, 2, "done", t(10), t(11), 0)]
    assert [tuple(r) for r in delta(spark, folder, feed, runs).collect()] == [("b", 1, 2)]


def test_nulls_and_empty(spark, folder):
    assert delta(spark, f"{folder}/none", [], []).count() == 0
    feed = [(None, None, 1, None, None, 0, 0), (None, None, 1, -5, t(0), 0, 0)]
    assert [tuple(r) for r in delta(spark, folder, feed, []).collect()] == [(None, None, 1)]


def test_large_vectors(spark, folder):
    n = 100_003
    rows = spark.range(0, n, 1, 1).select(F.format_string("k%d", "id").alias("rec_key"), F.lit(1).cast("long").alias("iter_index"), F.col("id").alias("seq"), (F.col("id") % 7).alias("wal_segment"), F.lit(t(0)).cast("timestamp_ntz").alias("arrived_at"))
    rows.write.parquet(f"{folder}/log")
    runs = spark.createDataFrame([(1, 2, 5, "done", t(0), t(1), 0)], RUNS)
    out = incremental.delta(spark.read.parquet(f"{folder}/log"), runs, f"{folder}/c")
    assert {r.seq for r in out.collect()} == {i for i in range(n) if not 2 <= i % 7 < 5}
    assert Consumer(spark, f"{folder}/c").manifest().filter("word is null").count() == 1


def rows(spark, path, values):
    spark.createDataFrame([(v, "x") for v in values], "v long, file string").coalesce(1).write.parquet(path)
    (name,) = [n for n in Files(spark).names(path) if n.endswith(".parquet")]
    return f"{path}/{name}"


def version(spark, files):
    """A manifest from paths with their deleted positions."""
    masked = [(f, p) for f, places in files.items() for p in places]
    return incremental.manifest_table(spark.createDataFrame([(f,) for f in files], "file string"), spark.createDataFrame(masked, "file string, place long"))


def test_consumer_takes_each_record_once_and_survives_failure(spark, folder):
    a, b = rows(spark, folder + "/a", [1, 2, 3]), rows(spark, folder + "/b", [4])
    c, seen = Consumer(spark, folder + "/job"), []

    def job(df):
        seen.append(sorted((r.v, r.change) for r in df.collect()))
        return df

    def broken(df):
        return df.select(F.raise_error(F.lit("lost executor")).alias("x"))

    assert c.run(version(spark, {a: []}), job) == 1
    with pytest.raises(Exception, match="lost executor"):
        c.run(version(spark, {a: [], b: []}), broken)
    assert c.last()["version"] == 1
    assert c.run(version(spark, {a: [1], b: []}), job) == 2
    assert Consumer(spark, folder + "/job").run(version(spark, {a: [1], b: []}), job) == 2
    assert c.run(version(spark, {b: [0]}), job) == 3
    assert seen == [[(1, "insert"), (2, "insert"), (3, "insert")], [(2, "delete"), (4, "insert")], [(1, "delete"), (3, "delete"), (4, "delete")]]
    assert sorted(r.v for p in c.outputs() for r in spark.read.parquet(p).collect()) == [1, 1, 2, 2, 3, 3, 4, 4]


def test_a_run_killed_between_write_and_commit_is_done_again(spark, folder, monkeypatch):
    a = rows(spark, folder + "/a", [1, 2])
    c = Consumer(spark, folder + "/job")

    def killed(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(c, "_commit", killed)
        with pytest.raises(KeyboardInterrupt):
            c.run(version(spark, {a: []}), lambda df: df)
    assert Files(spark).names(folder + "/job/out") and c.outputs() == []
    again = Consumer(spark, folder + "/job")
    assert again.run(version(spark, {a: []}), lambda df: df) == 1
    assert sorted(r.v for p in again.outputs() for r in spark.read.parquet(p).collect()) == [1, 2]


def test_unchanged_files_are_opened_only_if_asked_for(spark, folder):
    a, b = rows(spark, folder + "/a", [1, 2]), rows(spark, folder + "/b", [3])
    c = Consumer(spark, folder + "/job")
    c.adopt(version(spark, {a: [0], b: []}))
    now = version(spark, {a: [], b: []})
    assert [(r.v, r.change) for r in c.changes(now).collect()] == [(1, "insert")]
    assert [f for f in c.changes(now).inputFiles() if f.startswith(folder)] == [a]
    assert sorted((r.v, r.change) for r in c.changes(now, whole=True).collect()) == [(1, "insert"), (2, "same"), (3, "same")]
    assert c.changes(version(spark, {a: [0], b: []})) is None


def test_two_runs_of_one_version(spark, folder):
    a = rows(spark, folder + "/a", [1])
    c = Consumer(spark, folder + "/job")

    def overtaken(df):
        Consumer(spark, folder + "/job").run(version(spark, {a: []}), lambda x: x)
        return df

    with pytest.raises(RuntimeError):
        c.run(version(spark, {a: []}), overtaken)
    assert len(c.outputs()) == 1
