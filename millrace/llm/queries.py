"""Queries p3 over keys and p6 to p8 over documents and test items. SQL can express none of the latter; their tests use brute force."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.columns import plain_path
from millrace.llm import leakage, packing, seen, truncation
from millrace.operators import bloom
from millrace.sources import workspace


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _screen(spark: SparkSession, d: str) -> seen.Screen:
    """The feed past the filters of the known keys, both kept in a store of its own."""
    feed, known = _table(spark, d, "block_records"), _table(spark, d, "known_keys")
    expected = int(feed.agg(F.approx_count_distinct("rec_key", 0.02)).first()[0] * 1.03) + known.count()
    store = seen.SeenKeys(spark, workspace.place(spark, "seen-keys"), expected)
    store.learn(known, "rec_key")
    return store.screen(feed, "rec_key", "arrived_at", "record_id")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return seen.exact(_screen(spark, d), _table(spark, d, "known_keys")).select("record_id")


def p3_error(spark: SparkSession, d: str) -> DataFrame:
    return seen.error_report(_screen(spark, d), _table(spark, d, "known_keys"))


def p3_counts(spark: SparkSession, d: str) -> DataFrame:
    """The report's exact part: deliveries, and those whose key was new or seen before."""
    row = p3_error(spark, d)
    n_new = F.col("n_deliveries") - F.col("n_flagged") + F.col("n_wrong")
    return row.select("n_deliveries", n_new.alias("n_new"), (F.col("n_deliveries") - n_new).alias("n_seen"))


def p3_file_blooms(spark: SparkSession, d: str) -> DataFrame:
    """How far the logged Bloom filters can be trusted, per entry of the manifest: the delivered records of its file, those
    that the filter wrongly denies, and those of which it says nothing."""
    entries = _table(spark, d, "sstables").filter("log_action = 'ADD'")
    entries = entries.select("entry_id", plain_path(F.col("sst_path")).alias("path"), "bloom", "bloom_num_bits")
    h1, h2 = bloom.hashes(F.col("rec_key"))
    rows = _table(spark, d, "block_records").select(h1.alias("h1"), h2.alias("h2"), plain_path(F.col("sst_path")).alias("path"))
    held = bloom.holds(F.col("h1"), F.col("h2"), F.col("bloom"), F.col("bloom_num_bits"))
    return (
        rows.join(entries, "path")
        .select("entry_id", held.alias("held"))
        .groupBy("entry_id")
        .agg(F.count("*").alias("n_records"), F.count_if(~F.col("held")).alias("n_denied"), F.count_if(F.col("held").isNull()).alias("n_unknown"))
    )


def p6_sequences(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(_table(spark, d, "documents"))


def p6_usage(spark: SparkSession, d: str) -> DataFrame:
    return packing.usage(p6_sequences(spark, d))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked(_table(spark, d, "documents"), _table(spark, d, "eval_items")).select("doc_id", "item_id")


def p7_matches(spark: SparkSession, d: str) -> DataFrame:
    """Where the leaked passages lie, how long their longest phrase is, and whether they are exact or in proximity."""
    return leakage.leaked(_table(spark, d, "documents"), _table(spark, d, "eval_items"))


def p7_items(spark: SparkSession, d: str) -> DataFrame:
    """The items that leaked, with their suite, the documents they leaked into and the largest share found in one."""
    items = _table(spark, d, "eval_items")
    found = leakage.leaked(_table(spark, d, "documents"), items).groupBy("item_id").agg(F.count("*").alias("n_docs"), F.max(F.col("n_matched") / F.col("n_words")).alias("largest_share"))
    return found.join(items.select("item_id", "suite"), "item_id")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncated(_table(spark, d, "documents")).filter("is_cut").select("doc_id")


def p8_sources(spark: SparkSession, d: str) -> DataFrame:
    return truncation.by_source(_table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p3_found, p3_error, p3_counts, p3_file_blooms, p6_sequences, p6_usage, p7_found, p7_matches, p7_items, p8_found, p8_sources)}
SQL: dict[str, str] = {
    "p3_found": """SELECT record_id FROM (
  SELECT record_id, rec_key, row_number() OVER (PARTITION BY rec_key ORDER BY arrived_at, record_id) AS nth FROM block_records
) WHERE nth > 1 OR rec_key IN (SELECT rec_key FROM known_keys)""",
    "p3_file_blooms": r"""
WITH entries AS (
  SELECT entry_id, bloom, bloom_num_bits AS m, regexp_replace(regexp_replace(regexp_replace(trim(sst_path), '/+', '/', 'g'), '/(\./)+', '/', 'g'), '^(\./)+', '') AS sst_path
  FROM sstables WHERE log_action = 'ADD'
), probes AS (
  SELECT entry_id, bloom, m, CAST('0x' || substr(md5(rec_key), 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(md5(rec_key), 9, 8) AS BIGINT) AS h2
  FROM block_records JOIN entries USING (sst_path)
), answers AS (
  SELECT entry_id, CASE WHEN m > 0 AND octet_length(bloom) * 8 >= m THEN
    list_bool_and([get_bit(CAST(bloom AS BIT), CAST((b // 8) * 8 + 7 - b % 8 AS INTEGER)) = 1 FOR b IN [(h1 + i * h2) % m FOR i IN range(7)]]) END AS held
  FROM probes
)
SELECT entry_id, count(*) AS n_records, count(*) FILTER (WHERE NOT held) AS n_denied, count(*) FILTER (WHERE held IS NULL) AS n_unknown FROM answers GROUP BY entry_id""",
    "p3_counts": """SELECT count(*) AS n_deliveries, count(*) FILTER (WHERE new) AS n_new, count(*) FILTER (WHERE NOT new) AS n_seen FROM (
  SELECT row_number() OVER (PARTITION BY rec_key ORDER BY arrived_at, record_id) = 1 AND rec_key NOT IN (SELECT rec_key FROM known_keys) AS new FROM block_records
)""",
}
