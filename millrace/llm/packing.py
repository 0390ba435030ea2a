"""Filling training sequences of fixed capacity with documents.

Documents are measured in tokens of a public tokenizer. The plan is made on the histogram of lengths alone: it has at most
one entry per length up to the capacity, however many documents there are. Best fit goes through the lengths from the greatest
down and keeps sequences that are filled alike as one range of numbers, so each step places many documents
at once. The plan says which ranks within a length go to which sequences; documents take their places by
joining on their rank. A document above the capacity gives full sequences of its own and one rest, which is packed
like any other item; no other is split.
"""

from __future__ import annotations

import base64
import re
from bisect import bisect_left, insort
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.columns import col
from millrace.functions.joins import join_measured
from millrace.sources import workspace
from millrace.sources.workers import ship

#: Tokens of a sequence, by default.
CAPACITY = 4096
#: Where the public tokenizers lie; any folder with files of these names will do.
TOKENIZERS, VOCABULARY = "/opt/tokenizers", "byte_bpe_50k.tiktoken"
# Fixed value: how the tokenizer of that vocabulary splits text before it merges bytes.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Buckets that ranks within one length are counted in, so that copies of one length never meet in one task.
BUCKETS = 256
#: Documents above the capacity that one task numbers, on average.
LONG_BUCKET = 50_000


@lru_cache(maxsize=2)
def _encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


#: White space in a row that the tokenizer's own pattern matching can't be trusted with: it recurses over it.
LONG_BLANK = re.compile(r"\s{2000,}")


def count_tokens(texts: list[str], path: str) -> list[int]:
    """Tokens of each whole text; the strings of special tokens are ordinary text."""
    encoder, out = _encoder(path), []
    for text in texts:
        n = at = 0
        for m in LONG_BLANK.finditer(text):
            # the pattern takes such a run as one piece, but leaves its last character to a word behind it
            end = m.end() - (m.end() < len(text))
            n += len(encoder.encode_ordinary(text[at : m.start()])) + len(encoder._encode_single_piece(text[m.start() : end]))
            at = end
        out.append(n + len(encoder.encode_ordinary(text[at:])))
    return out


def token_counts(documents: DataFrame, id: str = "doc_id", text: str = "text", path: str = f"{TOKENIZERS}/{VOCABULARY}") -> DataFrame:
    """``id, n_tokens``; a null or empty text has none."""
    ship(documents.sparkSession)
    udf = F.pandas_udf(lambda s: pd.Series(count_tokens([t or "" for t in s], path), dtype="int64"), "long")
    udf.func.__annotations__ = {}
    return documents.select(col(id).alias("id"), udf(col(text)).alias("n_tokens"))


def plan(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Places for items by best fit in order of falling length.

    ``histogram`` maps a length from 1 to ``capacity`` to the number of items. The result has ``(length, first_rank, last_rank,
    first_sequence, start)``: items of these ranks within the length (from 0, the last included) go to consecutive
    sequences, each beginning at ``start``. Second comes the number of sequences.
    """
    places: list[tuple[int, int, int, int, int]] = []
    room: list[tuple[int, int, int]] = []  # (free space, first sequence, how many), ascending
    n = 0
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            k = bisect_left(room, (length, -1, -1))
            if k < len(room):
                free, first, many = room.pop(k)
            else:
                # as many new sequences as the rest needs when each takes all it can hold
                free, first, many = capacity, n, -(-left // (capacity // length))
                n += many
            take = min(left, many)
            places.append((length, rank, rank + take - 1, first, capacity - free))
            if take < many:
                insort(room, (free, first + take, many - take))
            if free - length > 0:
                insort(room, (free - length, first, take))
            rank, left = rank + take, left - take
    return places, n


def pack(documents: DataFrame, capacity: int = CAPACITY, id: str = "doc_id", text: str = "text", path: str = f"{TOKENIZERS}/{VOCABULARY}") -> DataFrame:
    """The assignment of documents to sequences: ``id, piece, n_tokens, sequence_id, start``.

    Every document is there once, or as pieces 0, 1, ... if it alone exceeds the capacity: all but the last fill a sequence each.
    ``start`` is the token of the sequence where it begins. Documents without tokens need no room: they have a
    null sequence. ``id`` must be unique and not null. Equal input gives equal output.
    """
    spark = documents.sparkSession
    counted = workspace.keep(token_counts(documents, id, text, path).withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(BUCKETS)).cast("int")), "token-counts")
    full = F.expr(f"case when n_tokens > {capacity} then cast((n_tokens - 1) div {capacity} as int) else 0 end")
    items = counted.withColumn("full", full).withColumn("length", (F.col("n_tokens") - F.col("full") * capacity).cast("int"))
    # at most capacity x BUCKETS rows, whatever the input
    sizes = workspace.keep(items.filter("length > 0").groupBy("length", "bucket").agg(F.count("*").alias("n")), "length-buckets")
    histogram = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places, n_packed = plan(histogram, capacity)
    slots = spark.createDataFrame(pd.DataFrame(places, columns=["length", "first_rank", "last_rank", "first_sequence", "start"]), "length int, first_rank long, last_rank long, first_sequence long, start int")
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    # each rank range of a bucket is matched with the places it overlaps, so that no document meets all places of its length
    spans = sizes.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("end", F.col("offset") + F.col("n"))
    spans = spans.join(slots, "length").filter("first_rank < end and last_rank >= offset").groupBy("length", "bucket", "offset").agg(F.sort_array(F.collect_list(F.struct("first_rank", "last_rank", "first_sequence", "start"))).alias("slots"))
    in_bucket = Window.partitionBy("length", "bucket").orderBy("id")
    ranked = items.filter("length > 0").withColumn("nth", F.row_number().over(in_bucket) - 1)
    # both sides lie by length and bucket already, so merging them moves only the spans
    placed = ranked.join(spans.hint("merge"), ["length", "bucket"]).withColumn("rank", F.col("offset") + F.col("nth"))
    slot = F.filter("slots", lambda s: (s["first_rank"] <= F.col("rank")) & (s["last_rank"] >= F.col("rank")))[0]
    placed = placed.withColumn("slot", slot)
    rest = placed.select("id", F.col("full").alias("piece"), F.col("length").alias("n_tokens"), (F.col("slot.first_sequence") + F.col("rank") - F.col("slot.first_rank")).alias("sequence_id"), F.col("slot.start").alias("start"))
    # the full pieces get sequences behind the packed ones, numbered by bucket; there are as many buckets as the documents need
    long = items.filter("full > 0").select("id", "full")
    n_long = long.count()
    long = long.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(max(BUCKETS, n_long // LONG_BUCKET))))
    behind = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = long.groupBy("part").agg(F.sum("full").alias("n")).select("part", (F.coalesce(F.sum("n").over(behind), F.lit(0)) + n_packed).alias("base"))
    starts = workspace.keep(starts, "long-buckets")
    in_part = Window.partitionBy("part").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    first = F.col("base") + F.coalesce(F.sum("full").over(in_part), F.lit(0))
    long = join_measured(long, starts, ["part"], "inner")
    whole = long.withColumn("first", first).select("id", F.posexplode(F.sequence(F.col("first"), F.col("first") + F.col("full") - 1)).alias("piece", "sequence_id"))
    whole = whole.select("id", "piece", F.lit(capacity).alias("n_tokens"), "sequence_id", F.lit(0).alias("start"))
    none = items.filter("length = 0").select("id", F.lit(0).alias("piece"), F.lit(0).alias("n_tokens"), F.lit(None).cast("long").alias("sequence_id"), F.lit(None).cast("int").alias("start"))
    out = rest.unionByName(whole).unionByName(none)
    return out.select(F.col("id").alias(id), "piece", "n_tokens", "sequence_id", "start")


def usage(assignment: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: documents, sequences, tokens and the share of unused room."""
    filled = assignment.filter("sequence_id is not null")
    return filled.agg(F.count("*").alias("n_pieces"), (F.coalesce(F.max("sequence_id"), F.lit(-1)) + 1).alias("n_sequences"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n_tokens")).withColumn(
        "unused", F.when(F.col("n_sequences") > 0, 1 - F.col("n_tokens") / (F.col("n_sequences") * capacity)).otherwise(0.0)
    )
