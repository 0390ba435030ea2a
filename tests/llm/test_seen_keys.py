import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.llm import seen
from millrace.llm.seen import QuotientFilter, SeenKeys
from millrace.sources import workspace
from millrace.sources.files import Files

T0 = datetime(2025, 1, 1)


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 2**10 - 1)), st.sets(st.integers(0, 2**10 - 1)), st.integers(1, 9))
def test_quotient_filter_is_lossless_and_merges(a, b, q):
    make = lambda s: QuotientFilter(np.array(sorted(s), np.int64), q, 10 - q)
    fa, fb, every = make(a), make(b), np.arange(2**10)
    assert set(fa.fingerprints().tolist()) == a
    again = QuotientFilter.unpack(fa.pack(), fa.n, fa.slots, q, 10 - q)
    assert len(fa.pack()) == fa.n_bytes and set(again.fingerprints().tolist()) == a
    assert q == 9 or set(fa.resized(q + 1).fingerprints().tolist()) == a
    assert set(every[fa.contains(every)].tolist()) == a
    both = fa.merge(fb)
    assert set(both.fingerprints().tolist()) == a | b and set(every[both.contains(every)].tolist()) == a | b


def test_filters_of_two_shapes_do_not_merge():
    with pytest.raises(ValueError):
        QuotientFilter(np.array([1]), 4, 4).merge(QuotientFilter(np.array([1]), 5, 3))


def brute(rows, known):
    out, had = set(), set(known)
    for r in sorted((r for r in rows if r[1] is not None), key=lambda r: (r[2] is not None, r[2] or T0, r[0])):
        if r[1] in had:
            out.add(r[0])
        had.add(r[1])
    return out


def screened(spark, folder, feed, earlier, key="k", time="at", id="id", **kw):
    store = SeenKeys(spark, folder, **kw)
    store.learn(earlier, key)
    return store.screen(feed, key, time, id)


@pytest.mark.parametrize("r_bits", [1, 4, 10])
def test_exact_answer_whatever_the_error(spark, folder, r_bits):
    rng = random.Random(r_bits)
    rows = [(2**60 + i, None if rng.random() < 0.01 else "hot" if rng.random() < 0.3 else f"k{rng.randrange(900)}", None if rng.random() < 0.05 else T0 + timedelta(seconds=rng.randrange(500))) for i in range(2000)]
    known = [f"k{i}" for i in range(0, 2000, 9)]
    feed, earlier = spark.createDataFrame(rows, "id long, k string, at timestamp_ntz"), spark.createDataFrame([(k, "x") for k in [*known, None]], "k string, id string")
    s = screened(spark, folder, feed, earlier, expected=1200, r_bits=r_bits)
    want = brute(rows, known)
    assert {r.id for r in seen.exact(s, earlier).collect()} == want
    flagged = {r.id for r in seen.flagged(s).collect()}
    assert flagged >= want
    report = seen.error_report(s, earlier).first()
    assert report.n_wrong == len(flagged - want) and report.n_flagged == len(flagged)
    if r_bits == 1:
        assert report.n_wrong > 10
    if r_bits == 10:
        assert report.bits_per_key < 40


def test_a_second_feed_needs_only_the_filters_of_the_first(spark, folder):
    def feed(name, ids):
        spark.createDataFrame([(i, f"k{i % 500}", T0 + timedelta(seconds=i)) for i in ids], "id long, k string, at timestamp").write.parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    SeenKeys(spark, f"{folder}/store", 1000, 12).screen(feed("first", range(300)), "k", "at", "id")
    Files(spark).delete(f"{folder}/first")
    workspace.clear(spark)
    again = SeenKeys(spark, f"{folder}/store")
    s = again.screen(feed("second", range(200, 700)), "k", "at", "id")
    flagged = {r.id for r in seen.flagged(s).collect()}
    want = {*range(200, 300), *range(500, 700)}
    assert flagged >= want and len(flagged - want) < 5
    # and a third finds all of both
    assert again.screen(feed("third", range(500)), "k", "at", "id").news.count() == 0


def test_filters_grow_beyond_what_was_expected(spark, folder):
    store = SeenKeys(spark, folder, expected=100, r_bits=16)
    for k in range(3):
        keys = spark.range(k * 2000, (k + 1) * 2000).select(F.concat(F.lit("key"), "id").alias("k"))
        store.learn(keys, "k")
    probe = spark.range(6000).select("id", F.concat(F.lit("key"), "id").alias("k"), F.lit(T0).alias("at"))
    s = store.screen(probe, "k", "at", "id")
    assert s.news.count() == 0 and s.filters.agg(F.sum("n")).first()[0] > 5950
    with pytest.raises(Exception, match="is full"):
        SeenKeys(spark, f"{folder}/tiny", expected=1, r_bits=1).learn(probe, "k")


def test_error_is_near_the_derived_one(spark, folder):
    feed = spark.range(40_000).select(F.col("id"), F.concat(F.lit("key-"), "id").alias("k"), (F.lit(T0) + F.make_dt_interval(secs=F.col("id"))).alias("at"))
    none = spark.createDataFrame([], "k string")
    s = screened(spark, folder, feed, none, expected=40_000, r_bits=4)
    r = seen.error_report(s, none).first()
    assert seen.exact(s, none).count() == 0
    assert 0.5 < r.wrong_rate / r.derived_rate < 2 and r.bits_per_key < 20


def test_empty_and_clashing_names(spark, folder):
    schema = "i long, fp string, t timestamp, seen string, kind int, k int"
    known = spark.createDataFrame([("a", 1)], "fp string, k int")
    assert seen.exact(screened(spark, f"{folder}/1", spark.createDataFrame([], schema), known, "fp", "t", "i"), known).count() == 0
    feed = spark.createDataFrame([(1, "a", T0, "s", 1, 2), (2, "b", T0, None, None, None), (3, "b", T0, None, None, None), (4, "", None, None, None, None)], schema)
    out = seen.exact(screened(spark, f"{folder}/2", feed, known, "fp", "t", "i"), known)
    assert {r.i for r in out.collect()} == {1, 3} and out.columns[0] == "i" and set(out.columns) == set(feed.columns)
