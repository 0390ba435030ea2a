from pathlib import Path

import pytest

import __spark_entry__ as entry

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test data here")


@pytest.mark.parametrize(
    ("name", "columns"),
    [("p3_error", ["n_deliveries", "n_flagged", "n_wrong", "wrong_rate", "derived_rate", "bits_per_key", "peak_bytes_per_key"]), ("p6_sequences", ["doc_id", "piece", "n_tokens", "sequence_id", "start"]), ("p6_usage", ["n_pieces", "n_sequences", "n_tokens", "unused"]), ("p7_found", ["doc_id", "item_id"]), ("p7_matches", ["doc_id", "item_id", "n_matched", "n_own", "n_words", "first_word", "phrase_words", "kind"]), ("p7_items", ["item_id", "n_docs", "largest_share", "suite"]), ("p8_found", ["doc_id"]), ("p8_sources", ["source", "n_docs", "n_cut", "share"])],
)
def test_columns_and_unique_rows(spark, name, columns):
    df = entry.queries()[name](spark, str(DATA))
    assert df.columns == columns
    rows = df.collect()
    assert rows and len(set(rows)) == len(rows)


def test_every_document_is_in_the_plan_once(spark):
    plan = entry.queries()["p6_sequences"](spark, str(DATA))
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert plan.filter("piece = 0").count() == docs.count() == plan.select("doc_id").distinct().count()
