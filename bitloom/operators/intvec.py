"""Packed vectors of unsigned integers of 1 to 63 bits. ints: (vec_id, idx, value); iwords: (vec_id, word_idx, word)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bitloom.functions import bits as B
from bitloom.operators.bitvec import Cursor, beyond

#: Words of a chunk in which a word meets the next one.
CHUNK = 1024


def check_width(width: int) -> int:
    if not 1 <= width <= 63:
        raise ValueError(f"width is {width}, not in 1..63")
    return width


def fits(value: Column, width: int) -> Column:
    """The value, or an error if it has more than `width` bits."""
    ok = (value >= 0) & (value.bitwiseAND(F.bitwise_not(B.low_mask(F.lit(width)))) == 0)
    return F.when(ok, value).otherwise(F.raise_error(F.concat(F.lit("value is "), value.cast("string"), F.lit(f" but width is {width}"))))


def truncated(value: Column, width: int) -> Column:
    return value.bitwiseAND(B.low_mask(F.lit(width)))


def pack(ints: DataFrame, width: int) -> DataFrame:
    """iwords: an element's bits go to one word or to two. Words without any one are kept; see raw() for the last."""
    at = F.col("idx") * check_width(width)
    w = ints.select("vec_id", F.shiftright(at, 6).alias("word_idx"), at.bitwiseAND(63).alias("off"), fits(F.col("value"), width).alias("value"))
    low = F.struct(F.col("word_idx").alias("word_idx"), B.shl(F.col("value"), F.col("off")).alias("part"))
    high = F.struct((F.col("word_idx") + 1).alias("word_idx"), B.shr(F.col("value"), F.lit(64) - F.col("off")).alias("part"))
    parts = w.select("vec_id", F.explode(F.when(F.col("off") + width > 64, F.array(low, high)).otherwise(F.array(low))).alias("x"))
    return parts.groupBy("vec_id", F.col("x.word_idx").alias("word_idx")).agg(F.bit_or("x.part").alias("word"))


def raw(ints: DataFrame, width: int) -> DataFrame:
    """iwords with the empty word that follows when the last one is full: floor(n * width / 64) + 1 words."""
    n = ints.groupBy("vec_id").agg(F.count("*").alias("n"))
    last = n.where((F.col("n") * width) % 64 == 0).select("vec_id", F.shiftright(F.col("n") * width, 6).alias("word_idx"), F.lit(0).cast("bigint").alias("word"))
    return pack(ints, width).unionByName(last)


def _element(word: Column, next_word: Column, off: Column, width: int) -> Column:
    low, high = B.shr(word, off), F.when(off + width > 64, B.shl(next_word, F.lit(64) - off)).otherwise(F.lit(0).cast("bigint"))
    return low.bitwiseOR(high).bitwiseAND(B.low_mask(F.lit(width)))


def get_many(iwords: DataFrame, header: DataFrame, queries: DataFrame, width: int, *, strict: bool = True) -> DataFrame:
    """queries (vec_id, idx, ...) with `value`; header: (vec_id, n). An index outside of [0, n) is an error, or has a null value if not strict."""
    q = queries.join(header.select("vec_id", F.col("n").alias("length_")), "vec_id", "left")
    ok = (F.col("idx") >= 0) & (F.col("idx") < F.coalesce("length_", F.lit(0).cast("bigint")))
    other = beyond(F.col("idx")) if strict else F.lit(None).cast("bigint")
    return get_unchecked(iwords, q, width).withColumn("value", F.when(ok, F.col("value")).otherwise(other)).drop("length_")


def get_unchecked(iwords: DataFrame, queries: DataFrame, width: int) -> DataFrame:
    """queries (vec_id, idx, ...) with `value`: joins with the word and, where the element reaches into it, the next one."""
    at = F.col("idx") * check_width(width)
    q = queries.withColumn("w0", F.shiftright(at, 6)).withColumn("off", at.bitwiseAND(63))
    q = q.withColumn("w1", F.when(F.col("off") + width > 64, F.col("w0") + 1))
    a, b = (iwords.select("vec_id", F.col("word_idx").alias(k), F.col("word").alias(f"v{k}")) for k in ("w0", "w1"))
    return q.join(a, ["vec_id", "w0"], "left").join(b, ["vec_id", "w1"], "left").withColumn("value", _element(F.col("vw0"), F.coalesce("vw1", F.lit(0).cast("bigint")), F.col("off"), width)).drop("w0", "w1", "off", "vw0", "vw1")


def unpack(iwords: DataFrame, header: DataFrame, width: int) -> DataFrame:
    """ints of iwords; header: (vec_id, n). A word meets the next one within its chunk; a chunk's first word is in the one before too."""
    check_width(width)
    chunk = F.floor(F.col("word_idx") / CHUNK)
    own = F.array(F.struct(chunk.alias("chunk"), F.lit(True).alias("own")))
    both = F.array(F.struct(chunk.alias("chunk"), F.lit(True).alias("own")), F.struct((chunk - 1).alias("chunk"), F.lit(False).alias("own")))
    rows = iwords.select("vec_id", "word_idx", "word", F.explode(F.when((F.col("word_idx") % CHUNK == 0) & (F.col("word_idx") > 0), both).otherwise(own)).alias("x")).select("vec_id", "word_idx", "word", "x.*")
    w = Window.partitionBy("vec_id", "chunk").orderBy("word_idx")
    rows = rows.withColumn("next_word", F.coalesce(F.lead("word").over(w), F.lit(0).cast("bigint"))).where("own")
    first = F.floor((F.col("word_idx") * 64 + (width - 1)) / width).cast("bigint")
    last = F.floor((F.col("word_idx") * 64 + 63) / width).cast("bigint")
    each = rows.withColumn("first", first).withColumn("last", last).where("first <= last").select("vec_id", "word_idx", "word", "next_word", F.explode(F.sequence("first", "last")).alias("idx"))
    off = (F.col("idx") * width).bitwiseAND(63)
    return each.join(header, "vec_id").where("idx < n").select("vec_id", "idx", _element(F.col("word"), F.col("next_word"), off, width).alias("value"))


def push_many(ints: DataFrame, new: DataFrame, width: int) -> DataFrame:
    """ints with the values of new (vec_id, seq, value) behind, in the order of seq (0, 1, ...). Values must fit."""
    n = ints.groupBy("vec_id").agg((F.max("idx") + 1).alias("n"))
    more = new.join(n, "vec_id", "left").select("vec_id", (F.coalesce("n", F.lit(0).cast("bigint")) + F.col("seq")).alias("idx"), fits(F.col("value"), width).alias("value"))
    return ints.select("vec_id", "idx", "value").unionByName(more)


def set_many(ints: DataFrame, updates: DataFrame, width: int, *, truncate: bool = False) -> DataFrame:
    """ints after updates (vec_id, idx, seq, value); the largest seq holds. An index beyond the vector or a value that does not fit is an error; with
    truncate, values lose their high bits and such indexes are ignored."""
    new = truncated(F.col("new"), width) if truncate else fits(F.col("new"), width)
    last = updates.groupBy("vec_id", "idx").agg(F.max_by("value", "seq").alias("new"))
    if truncate:
        return ints.join(last, ["vec_id", "idx"], "left").select("vec_id", "idx", F.when(F.col("new").isNull(), F.col("value")).otherwise(new).alias("value"))
    both = ints.withColumn("here", F.lit(True)).join(last, ["vec_id", "idx"], "full_outer")
    idx = F.when(F.col("here"), F.col("idx")).otherwise(F.raise_error(F.concat(F.lit("index is "), F.col("idx").cast("string"), F.lit(", beyond the vector"))))
    return both.select("vec_id", idx.alias("idx"), F.when(F.col("new").isNull(), F.col("value")).otherwise(new).alias("value"))


@dataclass(frozen=True)
class IntVec:
    """One vector of n values of `width` bits, as rows (vec_id, idx, value). Updates return a new vector."""

    rows: DataFrame
    n: int
    width: int
    capacity: int = 0

    def __post_init__(self) -> None:
        check_width(self.width)

    @classmethod
    def new(cls, spark: SparkSession, width: int) -> IntVec:
        return cls.with_capacity(spark, width, 0)

    @classmethod
    def with_capacity(cls, spark: SparkSession, width: int, capacity: int) -> IntVec:
        """Empty; room for `capacity` values is words() words, which rows do not need."""
        return cls(spark.createDataFrame([], "vec_id string, idx bigint, value bigint"), 0, width, capacity)

    def __len__(self) -> int:
        return self.n

    def is_empty(self) -> bool:
        return self.n == 0

    def words(self) -> int:
        return max(self.n, self.capacity) * self.width // 64 + 1

    def mask(self) -> int:
        return (1 << self.width) - 1

    def offset(self, index: int) -> tuple[int, int]:
        """Word and first bit of an element."""
        return index * self.width // 64, index * self.width % 64

    def _checked(self, index: int) -> int:
        if not 0 <= index < self.n:
            raise IndexError(f"no element {index} among {self.n}")
        return index

    def get(self, index: int) -> DataFrame:
        return self.get_unchecked(self._checked(index))

    def get_unchecked(self, index: int) -> DataFrame:
        """(idx, value); no row beyond the vector."""
        return self.rows.where(F.col("idx") == index).select("idx", "value")

    def set(self, index: int, value: int) -> IntVec:
        if not 0 <= value <= self.mask():
            raise ValueError(f"{value} has more than {self.width} bits")
        return self.set_unchecked(self._checked(index), value)

    def set_unchecked(self, index: int, value: int) -> IntVec:
        """The value's low bits are stored."""
        new = F.when(F.col("idx") == index, F.lit(value & self.mask()).cast("bigint")).otherwise(F.col("value"))
        return IntVec(self.rows.withColumn("value", new), self.n, self.width, self.capacity)

    def push(self, *values: int) -> IntVec:
        for v in values:
            if not 0 <= v <= self.mask():
                raise ValueError(f"{v} has more than {self.width} bits")
        more = self.rows.sparkSession.createDataFrame([("", self.n + k, v) for k, v in enumerate(values)], "vec_id string, idx bigint, value bigint")
        return IntVec(self.rows.unionByName(more), self.n + len(values), self.width, self.capacity)

    def between(self, start: int, end: int) -> DataFrame:
        return self.rows.where((F.col("idx") >= start) & (F.col("idx") < end)).select("idx", "value").orderBy("idx")

    def iter(self) -> DataFrame:
        return self.between(0, self.n)

    def cursor(self) -> Cursor:
        return Cursor(self)

    def raw(self) -> DataFrame:
        return raw(self.rows, self.width)
