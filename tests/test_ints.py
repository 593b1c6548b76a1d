"""Packed integer vectors."""

import random

import pytest
from pyspark.sql import functions as F

from bitloom.operators import intvec


def make(spark, values):
    return spark.createDataFrame([("v", i, v) for i, v in enumerate(values)], "vec_id string, idx bigint, value bigint")


def listed(df, by="idx", value="value"):
    return [r[value] for r in df.orderBy(by).collect()]


def test_golden_words(spark):
    assert listed(intvec.raw(make(spark, [1, 2, 3, 4]), 4), "word_idx", "word") == [0x4321]
    assert listed(intvec.raw(make(spark, [1, 2, 3, 4]), 23), "word_idx", "word") == [211106249310209, 128]
    assert listed(intvec.raw(make(spark, [1] * 16), 4), "word_idx", "word") == [0x1111111111111111, 0]


@pytest.mark.parametrize("width", [1, 5, 7, 8, 12, 23, 32, 33, 63])
def test_roundtrip(spark, width):
    random.seed(width)
    values = [random.getrandbits(width) for _ in range(300)] + [(1 << width) - 1]
    df = make(spark, values)
    words = intvec.raw(df, width)
    assert words.count() == len(values) * width // 64 + 1
    assert listed(intvec.get_many(words, df.groupBy("vec_id").agg(F.count("*").alias("n")), df.select("vec_id", "idx"), width)) == values
    header = df.groupBy("vec_id").agg(F.count("*").alias("n"))
    assert listed(intvec.unpack(words, header, width)) == values


def test_chunk_borders(spark, monkeypatch):
    monkeypatch.setattr(intvec, "CHUNK", 2)
    df = make(spark, list(range(100)))
    assert listed(intvec.unpack(intvec.raw(df, 23), df.groupBy("vec_id").agg(F.count("*").alias("n")), 23)) == list(range(100))


def test_set_push(spark):
    df = make(spark, [1] * 50)
    u = spark.range(50).select(F.lit("v").alias("vec_id"), F.col("id").alias("idx"), F.lit(0).alias("seq"), F.col("id").alias("value"))
    assert listed(intvec.set_many(df, u, 7)) == list(range(50))
    assert listed(intvec.set_many(df, u.withColumn("value", F.col("value") + 1024), 7, truncate=True)) == list(range(50))
    new = spark.createDataFrame([("v", 0, 9), ("v", 1, 8)], "vec_id string, seq bigint, value bigint")
    assert listed(intvec.push_many(df, new, 7))[-2:] == [9, 8]
    assert listed(intvec.push_many(df.where("false"), new, 7)) == [9, 8]


def test_errors(spark):
    df = make(spark, [1, 2])
    big = spark.createDataFrame([("v", 0, 0, 100000000)], "vec_id string, idx bigint, seq int, value bigint")
    for f in (lambda: intvec.pack(make(spark, [100000000]), 7), lambda: intvec.set_many(df, big, 7), lambda: intvec.push_many(df, big.select("vec_id", "seq", "value"), 7)):
        with pytest.raises(Exception, match="value is"):
            f().collect()
    with pytest.raises(Exception, match="beyond the vector"):
        intvec.set_many(df, big.withColumn("idx", F.lit(10).cast("bigint")).withColumn("value", F.lit(1).cast("bigint")), 7).collect()
    for w in (0, 64):
        with pytest.raises(ValueError):
            intvec.pack(df, w)


def test_get_beyond(spark):
    df = make(spark, [1, 2, 3, 4])
    h = df.groupBy("vec_id").agg(F.count("*").alias("n"))
    q = spark.createDataFrame([("v", i) for i in (0, 3, 5, 100, -1)], "vec_id string, idx bigint")
    assert {r.idx: r.value for r in intvec.get_many(intvec.pack(df, 4), h, q, 4, strict=False).collect()} == {0: 1, 3: 4, 5: None, 100: None, -1: None}
    with pytest.raises(Exception, match="no position"):
        intvec.get_many(intvec.pack(df, 4), h, q, 4).collect()


def test_int_vec_value(spark):
    v = intvec.IntVec.with_capacity(spark, 7, 100)
    assert v.is_empty() and v.words() == 11 and v.mask() == 127 and v.offset(10) == (1, 6)
    v = v.push(*range(60)).set(5, 127).set_unchecked(6, 128 + 9).set_unchecked(99, 1)
    assert len(v) == 60 and [r.value for r in v.iter().collect()] == [*range(5), 127, 9, *range(7, 60)]
    assert v.get(5).first().value == 127 and v.get_unchecked(60).collect() == []
    assert listed(intvec.unpack(v.raw(), spark.createDataFrame([("", 60)], "vec_id string, n bigint"), 7)) == [*range(5), 127, 9, *range(7, 60)]
    rows, c = v.cursor().take(58)
    assert rows.count() == 58 and len(c) == 2
    for call in (lambda: v.get(60), lambda: v.set(-1, 1), lambda: v.set(0, 128), lambda: v.push(128), lambda: intvec.IntVec.new(spark, 64)):
        with pytest.raises((IndexError, ValueError)):
            call()
