import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.llm import packing

PATH = f"{packing.TOKENIZERS}/{packing.VOCABULARY}"


def expand(places):
    """Items per sequence, as (start, length), from the plan's ranges."""
    out = {}
    for length, a, b, first, start in places:
        for r in range(a, b + 1):
            out.setdefault(first + r - a, []).append((start, length))
    return out


def best_fit(lengths, capacity):
    """Brute force: one item at a time, into the fullest sequence that has room."""
    room = []
    for x in sorted(lengths, reverse=True):
        fits = [(f, k) for k, f in enumerate(room) if f >= x]
        if fits:
            room[min(fits)[1]] -= x
        else:
            room.append(capacity - x)
    return len(room)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=120), st.integers(40, 64))
def test_plan_places_each_item_once_without_overlap(lengths, capacity):
    places, n = packing.plan(dict(Counter(lengths)), capacity)
    sequences = expand(places)
    assert sorted(x for s in sequences.values() for _, x in s) == sorted(lengths)
    assert set(sequences) == set(range(n))
    for items in sequences.values():
        items.sort()
        assert all(a + x <= b for (a, x), (b, _) in zip(items, items[1:], strict=False)) and items[-1][0] + items[-1][1] <= capacity
    for length, count in Counter(lengths).items():
        assert sorted(r for x, a, b, _, _ in places if x == length for r in range(a, b + 1)) == list(range(count))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=80))
def test_plan_is_as_tight_as_best_fit_of_single_items(lengths):
    assert packing.plan(dict(Counter(lengths)), 50)[1] <= best_fit(lengths, 50) + 1


def test_plan_does_not_grow_with_the_number_of_items():
    rng = random.Random(1)
    one = {x: rng.randrange(1, 50) for x in range(1, 513)}
    many = {x: c * 1_000_003 for x, c in one.items()}
    assert len(packing.plan(many, 512)[0]) < 3 * len(packing.plan(one, 512)[0]) + 1000


@pytest.mark.parametrize("capacity", [7, 64])
def test_every_document_is_there_once(spark, capacity):
    rng = random.Random(capacity)
    texts = [" ".join(rng.choice(["alpha", "β", "\\frac{1}{2}", "\n\n", "end."]) for _ in range(rng.randrange(0, 60))) for _ in range(200)] + [None, "", "same words"] * 30
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("length", F.lit("x")).withColumn("id", F.lit(1))
    out = packing.pack(docs, capacity).collect()
    size = dict(enumerate(packing.count_tokens([t or "" for t in texts], PATH)))
    held, filled = Counter(), {}
    for r in out:
        held[r.doc_id] += r.n_tokens
        if r.sequence_id is not None:
            filled.setdefault(r.sequence_id, []).append((r.start, r.n_tokens))
    assert held == Counter(size) and {r.doc_id for r in out} == set(size)
    for s in filled.values():
        s.sort()
        assert all(a + x <= b for (a, x), (b, _) in zip(s, s[1:], strict=False)) and s[-1][0] + s[-1][1] <= capacity
    pieces = {}
    for r in out:
        pieces.setdefault(r.doc_id, []).append(r)
    for d, ps in pieces.items():
        assert sorted(p.piece for p in ps) == list(range(len(ps)))
        assert len(ps) == 1 if size[d] <= capacity else len(ps) == -(-size[d] // capacity)
        assert all(p.n_tokens == capacity for p in ps if p.piece < len(ps) - 1)
    assert all((r.sequence_id is None) == (size[r.doc_id] == 0) for r in out)
    usage = packing.usage(packing.pack(docs, capacity), capacity).first()
    assert usage.n_tokens == sum(size.values()) and usage.n_sequences == len(filled) and usage.unused < 0.1


def test_counts_of_very_long_blanks_and_special_strings():
    e = packing._encoder(PATH)
    odd = ["a" + " " * 5000 + "b", "\n" * 3000, "\t " * 2000 + "x\n", "<|endoftext|>", "x" * 100_000]
    assert packing.count_tokens(odd, PATH) == [len(e.encode_ordinary(t)) for t in odd]
    assert packing.count_tokens(["x" + " " * 2_000_000 + "y"], PATH)[0] > 0


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(docs).count() == 0
    assert packing.usage(packing.pack(docs)).first().n_sequences == 0


def test_a_length_of_a_third_of_all_documents(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "one two three").otherwise(F.repeat(F.lit("w "), (F.col("id") % 97).cast("int"))).alias("text"))
    out = packing.pack(docs, 100)
    assert out.select("doc_id").distinct().count() == 3000
    assert out.filter("sequence_id is not null").groupBy("sequence_id").agg(F.sum("n_tokens").alias("n")).filter("n > 100").count() == 0
