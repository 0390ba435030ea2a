"""Queries p1, p2, p4 and p5: the change feed, its files, its references and its consumer; and Bloom filters of its files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import archive, bloom, changes, incremental, orphans
from millrace.queries.tables import table
from millrace.sources import workspace

#: Runs that a feed is appended in, and runs of a level at which the log merges them: two of the first level stay beside one of the next.
BATCHES, FANOUT = 5, 3


def _log(spark: SparkSession, d: str) -> changes.ChangeLog:
    feed = table(spark, d, "block_records").select("rec_key", "rec_value", "deleted", "iter_index", "seq", "arrived_at")
    log = changes.ChangeLog(spark, workspace.place(spark, "changelog"), "rec_key", ["iter_index", "seq"], "deleted", fanout=FANOUT)
    changes.apply_feed(log, feed, "arrived_at", BATCHES)
    return log


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _log(spark, d).read(columns=["rec_key", "iter_index", "seq"])


def p1_state(spark: SparkSession, d: str) -> DataFrame:
    return _log(spark, d).read(columns=["rec_key", "rec_value"])


def _pack(spark: SparkSession, d: str) -> archive.Archive:
    return archive.pack(table(spark, d, "block_records"), table(spark, d, "sstables"), workspace.place(spark, "archive"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return archive.replaced(_pack(spark, d))


def p2_levels(spark: SparkSession, d: str) -> DataFrame:
    """Per level, the changes packed and the files in force that they came from."""
    members = _pack(spark, d).index
    files = F.count_if((F.col("part") == 0) & F.col("in_force")).alias("n_files")
    return members.groupBy("level").agg(F.sum("n_records").alias("n_changes"), files)


def bloom_build(spark: SparkSession, d: str) -> DataFrame:
    """Filters built from the delivered records of each file, byte for byte."""
    built = bloom.build(table(spark, d, "block_records"), "sst_path", "rec_key")
    return built.select("sst_path", "n_keys", "n_bits", F.md5("bloom").alias("bloom_md5"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphans(*(table(spark, d, t) for t in ("block_records", "index_schemas", "table_columns")))


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    return orphans.report(table(spark, d, "block_records"), table(spark, d, "index_schemas"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return incremental.delta(table(spark, d, "block_records"), table(spark, d, "checkpoint_runs"), workspace.place(spark, "consumer"))


def p5_segments(spark: SparkSession, d: str) -> DataFrame:
    """Per segment of the log, its deliveries and those that no successful run has taken."""
    rows = table(spark, d, "block_records").select("wal_segment", "arrived_at")
    marked = incremental.mark(rows, table(spark, d, "checkpoint_runs"))
    return marked.groupBy("wal_segment").agg(F.count("*").alias("n_deliveries"), F.count_if(~F.col("masked")).alias("n_new"))


QUERIES = {f.__name__: f for f in (p1_found, p1_state, p2_found, p2_levels, bloom_build, p4_found, p4_report, p5_found, p5_segments)}

_NEWEST = """SELECT *, row_number() OVER (PARTITION BY rec_key ORDER BY iter_index DESC, seq DESC) AS nth FROM block_records"""

_FILES = r"""
WITH entries AS (
  SELECT *, regexp_replace(regexp_replace(regexp_replace(trim(sst_path), '/+', '/', 'g'), '/(\./)+', '/', 'g'), '^(\./)+', '') AS path FROM sstables
), newest AS (
  SELECT path, log_action, sst_level FROM entries QUALIFY row_number() OVER (PARTITION BY path ORDER BY logged_at DESC) = 1
), sized AS (
  SELECT path, file_size FROM entries WHERE file_size > 0 QUALIFY row_number() OVER (PARTITION BY path ORDER BY logged_at DESC) = 1
), files AS (
  SELECT newest.*, file_size FROM newest LEFT JOIN sized USING (path) WHERE log_action = 'ADD'
)"""

_ENTRIES = """
WITH states AS (
  SELECT rec_key, arg_max(deleted, (iter_index, seq)) AS dead, min(arrived_at) AS born,
    CASE WHEN arg_max(deleted, (iter_index, seq)) THEN arg_max(arrived_at, (iter_index, seq, -epoch_us(arrived_at))) END AS died FROM block_records GROUP BY rec_key
), entries AS (
  SELECT rec_key, born, split_part(rec_key, ':', 2) AS tab, split_part(rec_key, ':', 3) AS col,
         split_part(rec_key, ':', 2) || ':' || split_part(rec_key, ':', -1) AS target
  FROM states WHERE NOT dead AND starts_with(rec_key, '__index__:')
), judged AS (
  SELECT e.*, t.rec_key IS NULL AS missing, coalesce(t.dead, false) AS deleted,
         coalesce(NOT t.dead AND CAST(t.born AS DATE) > CAST(e.born AS DATE), false) AS late,
         coalesce(t.died < e.born, false) AS stillborn,
         NOT EXISTS (SELECT 1 FROM index_schemas s WHERE s.table_name = e.tab AND s.column_name = e.col) AS undeclared
  FROM entries e LEFT JOIN states t ON t.rec_key = e.target
)"""

_TAKEN = """
WITH runs AS (
  SELECT DISTINCT last_checkpointed_segment AS low, current_segment AS high, started_at
  FROM checkpoint_runs WHERE lower(trim(run_status)) = 'done' AND finished_at IS NOT NULL
), segments AS (
  SELECT wal_segment, max(started_at) AS taken_until
  FROM (SELECT DISTINCT wal_segment FROM block_records) JOIN runs ON wal_segment >= low AND wal_segment < high GROUP BY wal_segment
), marked AS (
  SELECT b.*, coalesce(arrived_at <= taken_until, false) AS masked FROM block_records b LEFT JOIN segments USING (wal_segment)
)"""

SQL = {
    "p1_found": f"SELECT rec_key, iter_index, seq FROM ({_NEWEST}) WHERE nth = 1 AND NOT deleted",
    "p1_state": f"SELECT rec_key, rec_value FROM ({_NEWEST}) WHERE nth = 1 AND NOT deleted",
    "p2_found": f"{_FILES} SELECT path AS sst_path, sst_level FROM files WHERE file_size < 4096",
    "p2_levels": f"""{_FILES}, placed AS (
  SELECT iter_index, seq, f.sst_level FROM
    (SELECT *, regexp_replace(regexp_replace(regexp_replace(trim(sst_path), '/+', '/', 'g'), '/(\\./)+', '/', 'g'), '^(\\./)+', '') AS path FROM block_records) b
    LEFT JOIN files f USING (path)
  QUALIFY row_number() OVER (PARTITION BY iter_index, seq ORDER BY (f.path IS NOT NULL) DESC, coalesce(b.path, '') DESC) = 1
), n_changes AS (SELECT coalesce(sst_level, 'L0') AS level, count(*) AS n FROM placed GROUP BY 1
), n_files AS (SELECT sst_level AS level, count(*) AS n FROM files GROUP BY 1)
SELECT level, CAST(coalesce(c.n, 0) AS BIGINT) AS n_changes, CAST(coalesce(f.n, 0) AS BIGINT) AS n_files FROM n_changes c FULL JOIN n_files f USING (level)""",
    "bloom_build": """
WITH keys AS (SELECT DISTINCT sst_path, rec_key FROM block_records WHERE sst_path IS NOT NULL),
sizes AS (SELECT sst_path, count(*) AS n_keys, greatest(count(*) * 10, 64) AS n_bits FROM keys GROUP BY sst_path),
bits AS (
  SELECT DISTINCT sst_path, n_keys, n_bits, (CAST('0x' || substr(md5(rec_key), 1, 8) AS BIGINT) + i * CAST('0x' || substr(md5(rec_key), 9, 8) AS BIGINT)) % n_bits AS b
  FROM keys JOIN sizes USING (sst_path), range(7) AS hashes(i)
)
SELECT sst_path, n_keys, n_bits, md5(unhex(string_agg(printf('%02x', coalesce(v, 0)), '' ORDER BY place))) AS bloom_md5
FROM (SELECT sst_path, n_keys, n_bits, unnest(range((n_bits + 7) // 8)) AS place FROM sizes)
LEFT JOIN (SELECT sst_path, b // 8 AS place, CAST(sum(1 << (b % 8)) AS BIGINT) AS v FROM bits GROUP BY 1, 2) USING (sst_path, place) GROUP BY ALL""",
    "p4_found": f"""{_ENTRIES}
SELECT 'block_records' AS ref_source, rec_key AS ref_key FROM judged WHERE missing OR deleted OR late OR undeclared
UNION ALL
SELECT 'index_schemas', index_name FROM index_schemas s
WHERE NOT EXISTS (SELECT 1 FROM table_columns c WHERE c.table_name = s.table_name AND c.column_name = s.column_name)""",
    "p4_report": f"""{_ENTRIES}
SELECT tab AS table_name, CAST(born AS DATE) AS day, count(*) AS n_orphans, CAST(count_if(missing) AS BIGINT) AS n_missing, CAST(count_if(deleted) AS BIGINT) AS n_deleted,
       CAST(count_if(late) AS BIGINT) AS n_late, CAST(count_if(stillborn) AS BIGINT) AS n_stillborn, CAST(count_if(undeclared) AS BIGINT) AS n_undeclared
FROM judged WHERE missing OR deleted OR late OR undeclared GROUP BY ALL""",
    "p5_found": f"{_TAKEN} SELECT rec_key, iter_index, seq FROM marked GROUP BY ALL HAVING NOT bool_or(masked)",
    "p5_segments": f"{_TAKEN} SELECT wal_segment, count(*) AS n_deliveries, CAST(count_if(NOT masked) AS BIGINT) AS n_new FROM marked GROUP BY wal_segment",
}
