import hashlib

from pyspark.sql import functions as F

from millrace.operators import bloom


def bits_of(keys, n):
    bits = bytearray((n + 7) // 8)
    for k in keys:
        d = hashlib.md5(k.encode()).hexdigest()
        for i in range(7):
            b = (int(d[:8], 16) + i * int(d[8:16], 16)) % n
            bits[b // 8] |= 1 << b % 8
    return bytes(bits)


def test_format(spark):
    n, keys = 130, ["users:1", "a", ""]
    bits = bits_of(keys, n)
    rows = [(k, bits, n) for k in [*keys, *[f"other{i}" for i in range(40)]]] + [("x", None, n), ("x", b"", n), ("x", bits, None), ("x", bits, 0)]
    df = spark.createDataFrame(rows, "k string, b binary, n long").withColumn("h", bloom.holds(*bloom.hashes(F.col("k")), F.col("b"), F.col("n")))
    got = [r.h for r in df.collect()]
    assert got[:3] == [True] * 3 and sum(map(bool, got[3:43])) < 10 and got[43:] == [None] * 4


def test_build(spark):
    rows = [("a", f"k{i % 50}", 1) for i in range(200)] + [("b", "x", 1), ("b", None, 1), (None, "y", 1), ("c", "é", 1), ("c", "", 1)]
    df = spark.createDataFrame(rows, "path string, key string, n_bits int")
    got = {r.path: r for r in bloom.build(df, "path", "key").collect()}
    assert set(got) == {"a", "b", "c"} and got["a"].n_keys == 50 and got["a"].n_bits == 500 and got["b"].n_bits == 64
    assert got["a"].bloom == bits_of([f"k{i}" for i in range(50)], 500) and got["b"].bloom == bits_of(["x"], 64) and got["c"].bloom == bits_of(["é", ""], 64)
    assert bloom.build(df.limit(0), "path", "key").count() == 0


def test_one_in_a_hundred_other_keys_passes(spark):
    df = spark.range(3000).select(F.lit("f").alias("p"), F.concat(F.lit("key"), "id").alias("k"))
    built = bloom.build(df, "p", "k")
    asked = spark.range(20_000).select(F.concat(F.lit("other"), "id").alias("k")).crossJoin(F.broadcast(built))
    passed = asked.filter(bloom.holds(*bloom.hashes(F.col("k")), F.col("bloom"), F.col("n_bits"))).count()
    assert passed < 400
    assert df.crossJoin(F.broadcast(built)).filter(~bloom.holds(*bloom.hashes(F.col("k")), F.col("bloom"), F.col("n_bits"))).count() == 0
