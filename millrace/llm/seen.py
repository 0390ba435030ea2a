"""Has this key been seen before? Quotient filters over fingerprints, kept from feed to feed.

A key's fingerprint of ``q + r`` bits is split into a quotient, which is a slot number, and a remainder of
``r`` bits, which is what the slot stores. Three bits a slot (occupied, continuation, shifted) tell
which run a displaced remainder belongs to, so a filter needs about ``(r + 3) / load`` bits a key. Filters whose entries
are sorted merge by one linear pass, and a filter grows by moving a bit from its remainders to its quotients.

``SeenKeys`` keeps one filter per shard of fingerprint space, cut by the leading bits, and a version per feed. A feed is reduced to
one row per fingerprint before it is shuffled, so a key with a third of all rows costs each task one row. The rows go past their
shard's kept filter in order and are then merged into it; a task holds one shard's filter, its new
fingerprints and one batch, and nothing of earlier feeds is read but their filters. A filter never misses a seen key; how often it
flags a new one is derived and counted, and ``exact`` takes those wrong answers out again, looking only
at fingerprints that two keys may share.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.columns import col
from millrace.functions.joins import join_measured
from millrace.sources import workspace
from millrace.sources.files import Files
from millrace.sources.workers import ship

#: Largest share of slots in use, remainder bits by default, log2 of the slots of one shard.
LOAD, REMAINDER_BITS, SHARD_BITS = 0.75, 10, 15
#: What a pass over the shards writes: fingerprints that are new or flagged, with the delivery that came first, and the filters.
NEW, FLAGGED, FILTER = 0, 1, 2


class QuotientFilter:
    """A static quotient filter over ``q_bits + r_bits`` fingerprints, built from sorted ones, merged with others."""

    def __init__(self, prints: np.ndarray, q_bits: int, r_bits: int):
        """``prints``: distinct fingerprints below ``2 ** (q_bits + r_bits)``, ascending (int64)."""
        self.q_bits, self.r_bits, self.n = q_bits, r_bits, len(prints)
        quotient = prints >> r_bits
        # an entry takes its own slot or the first one after the entry before it
        order = np.arange(self.n)
        slot = np.maximum.accumulate(quotient - order) + order if self.n else order
        self.slots = max(1 << q_bits, int(slot[-1]) + 1 if self.n else 0)
        kind = np.uint16 if r_bits <= 16 else np.uint32
        self.remainders = np.zeros(self.slots, kind)
        self.remainders[slot] = prints & ((1 << r_bits) - 1)
        occupied, continuation, shifted = (np.zeros(self.slots, bool) for _ in range(3))
        occupied[quotient] = True
        continuation[slot[1:]] = quotient[1:] == quotient[:-1]
        shifted[slot] = slot != quotient
        self.occupied, self.continuation, self.shifted = map(np.packbits, (occupied, continuation, shifted))

    def _bits(self, packed: np.ndarray) -> np.ndarray:
        return np.unpackbits(packed, count=self.slots).view(bool)

    @property
    def n_bytes(self) -> int:
        """What the filter takes where it is kept."""
        return 3 * len(self.occupied) + (self.slots * self.r_bits + 7) // 8

    def pack(self) -> bytes:
        """The filter in ``n_bytes``: three bits a slot, then the remainders in ``r_bits`` each."""
        bits = (self.remainders[:, None] >> np.arange(self.r_bits, dtype=self.remainders.dtype)) & 1
        return b"".join(a.tobytes() for a in (self.occupied, self.continuation, self.shifted, np.packbits(bits.astype(np.uint8))))

    @classmethod
    def unpack(cls, data: bytes, n: int, slots: int, q_bits: int, r_bits: int) -> QuotientFilter:
        out = object.__new__(cls)
        out.q_bits, out.r_bits, out.n, out.slots = q_bits, r_bits, n, slots
        flags = -(-slots // 8)
        raw = np.frombuffer(data, np.uint8)
        out.occupied, out.continuation, out.shifted = (raw[k * flags : (k + 1) * flags] for k in range(3))
        bits = np.unpackbits(raw[3 * flags :], count=slots * r_bits).reshape(slots, r_bits)
        kind = np.uint16 if r_bits <= 16 else np.uint32
        out.remainders = bits.astype(kind) @ (1 << np.arange(r_bits)).astype(kind)
        return out

    def resized(self, q_bits: int) -> QuotientFilter:
        """The same fingerprints with another split: what a quotient gains the remainder loses."""
        return self if q_bits == self.q_bits else QuotientFilter(self.fingerprints(), q_bits, self.q_bits + self.r_bits - q_bits)

    def fingerprints(self) -> np.ndarray:
        """All fingerprints, ascending: the filter is lossless, which is why filters can be merged and resized."""
        occupied, continuation, shifted = map(self._bits, (self.occupied, self.continuation, self.shifted))
        used = occupied | continuation | shifted
        starts = used & ~continuation
        run = np.cumsum(starts[used]) - 1
        return (np.flatnonzero(occupied)[run].astype(np.int64) << self.r_bits) | self.remainders[used].astype(np.int64)

    def contains(self, prints: np.ndarray) -> np.ndarray:
        """For each fingerprint whether the filter holds it; finds the run of its quotient and searches the remainder."""
        if not self.n or not len(prints):
            return np.zeros(len(prints), bool)
        occupied, continuation, shifted = map(self._bits, (self.occupied, self.continuation, self.shifted))
        quotient, remainder = prints >> self.r_bits, prints & ((1 << self.r_bits) - 1)
        used = occupied | continuation | shifted
        starts = np.append(np.flatnonzero(used & ~continuation), self.slots)
        nth = np.cumsum(occupied)[quotient] - 1
        found = np.zeros(len(prints), bool)
        todo = np.flatnonzero(occupied[quotient])
        at = starts[nth[todo]]
        while len(todo):
            hit = self.remainders[at] == remainder[todo]
            found[todo[hit]] = True
            at = at + 1
            go = ~hit & (at < self.slots)
            go[go] = continuation[at[go]]
            todo, at = todo[go], at[go]
        return found

    def merge(self, other: QuotientFilter) -> QuotientFilter:
        """The union, by a linear merge of both sorted sequences of fingerprints."""
        if (self.q_bits, self.r_bits) != (other.q_bits, other.r_bits):
            raise ValueError("only filters of one shape can be merged")
        a, b = self.fingerprints(), other.fingerprints()
        both = np.empty(len(a) + len(b), np.int64)
        place = np.searchsorted(a, b) + np.arange(len(b))
        rest = np.ones(len(both), bool)
        rest[place] = False
        both[place], both[rest] = b, a
        return QuotientFilter(both[np.append(True, both[1:] != both[:-1])] if len(both) else both, self.q_bits, self.r_bits)


@dataclass
class Screen:
    """What ``SeenKeys.screen`` found. ``news`` holds the deliveries that the filters call new; all others are flagged."""

    feed: DataFrame
    key: str
    time: str
    id: str
    prints: DataFrame
    answers: DataFrame
    bits: int
    n_before: int

    @property
    def news(self) -> DataFrame:
        return self.answers.filter(F.col("kind") == NEW).select(F.col("first_id").alias(self.id))

    @property
    def filters(self) -> DataFrame:
        return self.answers.filter(F.col("kind") == FILTER)


def fingerprint(key: Column, bits: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(key), 64 - bits)


_ANSWERS = "shard long, kind int, fp long, first_id {}, n long, slots long, q_bits int, data binary, peak long"


def _pass(batches: Iterator[pa.RecordBatch], bits: int, q_bits: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by shard, kept filters before fingerprints and these ascending, past the filters of their shards.

    ``bits`` is the length of a fingerprint within a shard and ``q_bits`` that of its quotient in a filter that is new.
    """
    shard, held, fresh, largest, id_type = None, None, [], 0, pa.int64()

    def answer(n_rows: int, **columns) -> pa.RecordBatch:
        kinds = {"shard": pa.int64(), "kind": pa.int32(), "fp": pa.int64(), "first_id": id_type, "n": pa.int64(), "slots": pa.int64(), "q_bits": pa.int32(), "data": pa.binary(), "peak": pa.int64()}
        arrays = [columns[c] if isinstance(columns.get(c), pa.Array) else pa.array(columns[c], t) if c in columns else pa.nulls(n_rows, t) for c, t in kinds.items()]
        return pa.RecordBatch.from_arrays(arrays, list(kinds))

    def closed() -> pa.RecordBatch:
        own = np.concatenate(fresh) if fresh else np.empty(0, np.int64)
        q, n = held.q_bits, held.n + len(own)
        while n > LOAD * (1 << q):
            q += 1
        if q >= bits:
            raise ValueError(f"a filter of {n} keys is full: begin a new one for more keys")
        merged = held.resized(q).merge(QuotientFilter(own, q, bits - q))
        # what lies in memory while both are merged: remainders in words, flags unpacked, fingerprints in full
        peak = sum(f.slots * (f.remainders.itemsize + 4) + f.n * 8 for f in (held, merged)) + own.nbytes * 2 + largest
        return answer(1, shard=[shard], kind=[FILTER], n=[merged.n], slots=[merged.slots], q_bits=[q], data=[merged.pack()], peak=[peak])

    for batch in batches:
        id_type = batch.schema.field("first_id").type
        shards, kept = batch["shard"].to_numpy(), batch["data"].is_valid().to_numpy(zero_copy_only=False)
        change = (shards[1:] != shards[:-1]) | (kept[1:] != kept[:-1])
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), len(shards)] if len(shards) else []
        for a, b in zip(cuts, cuts[1:], strict=False):
            if shards[a] != shard:
                if shard is not None:
                    yield closed()
                shard, fresh, largest = int(shards[a]), [], 0
                held = QuotientFilter(np.empty(0, np.int64), q_bits, bits - q_bits)
            part = batch.slice(a, b - a)
            if kept[a]:
                (r,) = part.select(["data", "n", "slots", "q_bits"]).to_pylist()
                held = QuotientFilter.unpack(r["data"], r["n"], r["slots"], r["q_bits"], bits - r["q_bits"])
                continue
            own = part["fp"].to_numpy() & ((1 << bits) - 1)
            seen = held.contains(own)
            fresh.append(own[~seen])
            largest = max(largest, own.nbytes * 4)
            yield answer(len(own), shard=part["shard"], kind=np.where(seen, FLAGGED, NEW).astype(np.int32), fp=part["fp"], first_id=part["first_id"])
    if shard is not None:
        yield closed()


class SeenKeys:
    """The keys of all feeds so far, as filters below ``root``; each feed is one version.

    ``expected`` keys and ``r_bits`` remainder bits set the error at the start: a new key is called seen with a chance of
    about ``keys / expected * load * 2 ** -r_bits``. Beyond ``expected`` keys the filters grow and the chance with them. A store that
    is there already goes by what it was begun with.
    """

    def __init__(self, spark: SparkSession, root: str, expected: int = 1 << 20, r_bits: int = REMAINDER_BITS):
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark)
        if (state := self._state()) is not None:
            self.bits, self.shard_bits, self.q_bits = state["bits"], state["shard_bits"], state["q_bits"]
        else:
            q = max(6, math.ceil(math.log2(max(1, expected) / LOAD)))
            self.bits, self.shard_bits = q + r_bits, max(3, q - SHARD_BITS)
            self.q_bits = q - self.shard_bits

    def _state(self) -> dict | None:
        names = [n for n in self.files.names(f"{self.root}/versions") if n.endswith(".json")]
        return json.loads(self.files.read(f"{self.root}/versions/{names[-1]}")) if names else None

    def filters(self) -> DataFrame:
        """The kept filters, one row per shard that has keys."""
        state, schema = self._state(), _ANSWERS.format("string")
        if state is None:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.root}/{state['answers']}").filter(F.col("kind") == FILTER)

    def learn(self, keys: DataFrame, key: str) -> None:
        """Take in keys without asking about them; null is no key."""
        self.screen(keys.select(col(key).alias("k"), F.lit(None).cast("timestamp").alias("t"), F.lit(None).cast("long").alias("i")), "k", "t", "i")

    def screen(self, feed: DataFrame, key: str, time: str, id: str) -> Screen:
        """Answer, for every delivery in the order of (``time``, ``id``), whether its key occurred before, and keep the feed's keys.

        ``id`` must be unique. A delivery with a null key is never called seen, nor does it make one so. One without a time counts as
        earlier than all with one. The new version is committed before this returns.
        """
        ship(self.spark)
        state = self._state() or {"version": 0, "n": 0}
        named = feed.select(col(key).alias("k"), col(time).alias("t"), col(id).alias("i")).filter("k is not null")
        # a second hash tells two keys of one fingerprint apart, with 64 bits more
        other = F.xxhash64(F.lit(1), "k")
        prints = named.groupBy(fingerprint(F.col("k"), self.bits).alias("fp")).agg(F.min(F.struct("t", "i"))["i"].alias("first_id"), F.min(other).alias("low"), F.max(other).alias("high"))
        prints = workspace.keep(prints.select("fp", "first_id", (F.col("low") != F.col("high")).alias("shared")), "seen-prints")
        id_type = prints.schema["first_id"].dataType.simpleString()
        own, q = self.bits - self.shard_bits, self.q_bits
        rows = prints.select(F.shiftrightunsigned("fp", own).alias("shard"), "fp", "first_id").unionByName(self.filters().select("shard", "n", "slots", "q_bits", "data"), allowMissingColumns=True)
        answers = rows.repartition("shard").sortWithinPartitions("shard", F.col("data").isNull(), "fp").mapInArrow(lambda b: _pass(b, own, q), _ANSWERS.format(id_type))
        name = f"answers-{uuid.uuid4().hex[:12]}"
        answers.write.option("compression", "zstd").partitionBy("kind").parquet(f"{self.root}/{name}")
        answers = self.spark.read.schema(_ANSWERS.format(id_type)).parquet(f"{self.root}/{name}")
        n = answers.filter(F.col("kind") == FILTER).agg(F.sum("n")).first()[0] or 0
        after = {"version": state["version"] + 1, "answers": name, "n": n, "bits": self.bits, "shard_bits": self.shard_bits, "q_bits": self.q_bits}
        if not self.files.create(f"{self.root}/versions/{after['version']:012d}.json", json.dumps(after)):
            self.files.delete(f"{self.root}/{name}")
            raise RuntimeError("another feed was screened at the same time; screen again")
        return Screen(feed, key, time, id, prints, answers, self.bits, state["n"])


def flagged(s: Screen) -> DataFrame:
    """The deliveries that the filters call seen, whole rows."""
    return s.feed.filter(col(s.key).isNotNull()).join(s.news, s.id, "left_anti")


def wrong(s: Screen, earlier: DataFrame) -> DataFrame:
    """The deliveries that the filters call seen although their key is new, by ``id``; ``earlier`` holds the keys of all feeds before.

    A wrong answer takes two keys with one fingerprint. So only fingerprints that two keys of the feed share, or that the kept filters
    held already, are looked at key by key.
    """
    doubtful = s.prints.filter("shared").select("fp").unionByName(s.answers.filter(F.col("kind") == FLAGGED).select("fp")).distinct()
    doubtful = workspace.keep(doubtful, "seen-doubtful")
    print_of = fingerprint(col(s.key), s.bits).alias("fp")
    rows = s.feed.select(col(s.key).alias("k"), print_of, col(s.time).alias("t"), col(s.id).alias("i")).filter("k is not null")
    firsts = join_measured(rows, doubtful, ["fp"], "left_semi").groupBy("k").agg(F.min(F.struct("t", "i"))["i"].alias("i"))
    known = join_measured(earlier.select(col(s.key).alias("k"), print_of).filter("k is not null"), doubtful, ["fp"], "left_semi").select("k")
    new = firsts.join(known, "k", "left_anti").select(F.col("i").alias(s.id))
    return new.join(s.news, s.id, "left_anti")


def exact(s: Screen, earlier: DataFrame) -> DataFrame:
    """The deliveries whose key was seen before: what is flagged, less the filters' wrong answers."""
    new = s.news.unionByName(wrong(s, earlier))
    return s.feed.filter(col(s.key).isNotNull()).join(new, s.id, "left_anti")


def error_report(s: Screen, earlier: DataFrame) -> DataFrame:
    """One row: deliveries, flagged and wrong ones, the rate of wrong answers for new keys as counted and as derived,
    the bits per key of all kept filters, and the bytes per key of what tasks hold while they merge."""
    news, bad = s.news.agg(F.count("*").alias("called_new")), wrong(s, earlier).agg(F.count("*").alias("n_wrong"))
    held = s.filters.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sum(F.octet_length("data")).alias("held"), F.sum("peak").alias("peak"))
    total = s.feed.filter(col(s.key).isNotNull()).agg(F.count("*").alias("n_deliveries"))
    row = total.crossJoin(news).crossJoin(bad).crossJoin(held)  # one row each
    new, some = F.col("called_new") + F.col("n_wrong"), F.col("n") > 0
    return row.select(
        "n_deliveries",
        (F.col("n_deliveries") - F.col("called_new")).alias("n_flagged"),
        "n_wrong",
        F.when(new > 0, F.col("n_wrong") / new).alias("wrong_rate"),
        # over the feed's growth a new key meets on average as many fingerprints as lie halfway between start and end
        ((F.col("n") + s.n_before) / 2.0 / F.lit(float(1 << s.bits))).alias("derived_rate"),
        F.when(some, F.col("held") * 8.0 / F.col("n")).alias("bits_per_key"),
        F.when(some, F.col("peak") / F.col("n")).alias("peak_bytes_per_key"),
    )
