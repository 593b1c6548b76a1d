"""Bit vectors: a value class over DataFrames, and the packed layout.

bits: (vec_id, pos, bit). words: (vec_id, l1_idx, word_idx, word), dense, padding bits zero. header: (vec_id, n_bits).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitloom.functions import bits as B


def zeros(spark: SparkSession, n: int, vec_id: str = "") -> DataFrame:
    """n zero bits."""
    if n < 0:
        raise ValueError("a length is not negative")
    return spark.range(n).select(F.lit(vec_id).alias("vec_id"), F.col("id").alias("pos"), F.lit(False).alias("bit"))


def header(bits: DataFrame) -> DataFrame:
    return bits.groupBy("vec_id").agg((F.max("pos") + 1).alias("n_bits"))


def pack(bits: DataFrame) -> DataFrame:
    """words of bits that have a row for each position."""
    word = F.bit_or(F.when(F.col("bit"), B.bit_mask(F.col("pos"))).otherwise(F.lit(0).cast("bigint")))
    words = bits.groupBy("vec_id", B.word_of(F.col("pos")).alias("word_idx")).agg(word.alias("word"))
    return words.select("vec_id", B.l1_of_word(F.col("word_idx")).alias("l1_idx"), "word_idx", "word")


def densify(words: DataFrame, header: DataFrame, step: int = 1 << 16) -> DataFrame:
    """words with zero words where sparse bits left none. Missing words are made range by range, so no array is long."""
    n = F.ceil(F.col("n_bits") / 64)
    ranges = header.where("n_bits > 0").select("vec_id", n.alias("n"), F.explode(F.sequence(F.lit(0).cast("bigint"), (n - 1).cast("bigint"), F.lit(step).cast("bigint"))).alias("a"))
    all_ = ranges.select("vec_id", F.explode(F.sequence("a", F.least(F.col("a") + (step - 1), F.col("n") - 1))).alias("word_idx"))
    return all_.join(words.select("vec_id", "word_idx", "word"), ["vec_id", "word_idx"], "left").select("vec_id", B.l1_of_word(F.col("word_idx")).alias("l1_idx"), "word_idx", F.coalesce("word", F.lit(0).cast("bigint")).alias("word"))


def unpack(words: DataFrame, header: DataFrame) -> DataFrame:
    """bits of words: each word gives its 64, those at n_bits and beyond go."""
    each = words.select("vec_id", "word_idx", "word", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("k"))
    bits = each.select("vec_id", (F.col("word_idx") * 64 + F.col("k")).alias("pos"), (B.shr(F.col("word"), F.col("k")).bitwiseAND(1) == 1).alias("bit"))
    return bits.join(header, "vec_id").where("pos < n_bits").select("vec_id", "pos", "bit")


def within(rows: DataFrame, header: DataFrame, column: str, strict: bool, length: str = "n_bits") -> DataFrame:
    """rows (vec_id, column, ...) inside their vectors: others are an error, or go if not strict."""
    q = rows.join(header.select("vec_id", F.col(length).alias("length_")), "vec_id", "left")
    ok = (F.col(column) >= 0) & (F.col(column) < F.coalesce("length_", F.lit(0).cast("bigint")))
    if not strict:
        return q.where(ok).drop("length_")
    return q.withColumn(column, F.when(ok, F.col(column)).otherwise(beyond(F.col(column)))).drop("length_")


def beyond(index):
    return F.raise_error(F.concat(F.lit("no position "), index.cast("string"), F.lit(" in this vector"))).cast("bigint")


def get_many(words: DataFrame, header: DataFrame, queries: DataFrame, *, strict: bool = True) -> DataFrame:
    """queries (vec_id, idx, ...) with `bit`. An index outside of [0, n_bits) is an error, or has a null bit if not strict."""
    q = queries.join(header.select("vec_id", F.col("n_bits").alias("length_")), "vec_id", "left")
    ok = (F.col("idx") >= 0) & (F.col("idx") < F.coalesce("length_", F.lit(0).cast("bigint")))
    found = get_unchecked(words, q)
    return found.withColumn("bit", F.when(ok, F.col("bit")).otherwise((beyond(F.col("idx")) if strict else F.lit(None)).cast("boolean"))).drop("length_")


def get_unchecked(words: DataFrame, queries: DataFrame) -> DataFrame:
    """queries (vec_id, idx, ...) with `bit`: padding is false, and null is where there is no word."""
    q = queries.withColumn("word_idx", B.word_of(F.col("idx")))
    return q.join(words.select("vec_id", "word_idx", "word"), ["vec_id", "word_idx"], "left").withColumn("bit", B.bit_at(F.col("word"), F.col("idx"))).drop("word_idx", "word")


def apply_sets(bits: DataFrame, updates: DataFrame) -> DataFrame:
    """bits after updates (vec_id, pos, seq, bit): of several for a position, that of the largest seq holds. Others than those of bits are ignored; see within()."""
    last = updates.groupBy("vec_id", "pos").agg(F.max_by("bit", "seq").alias("new"))
    return bits.join(last, ["vec_id", "pos"], "left").select("vec_id", "pos", F.coalesce("new", "bit").alias("bit"))


def apply_flips(bits: DataFrame, flips: DataFrame) -> DataFrame:
    """bits after flips (vec_id, pos); two of a position cancel."""
    odd = flips.groupBy("vec_id", "pos").agg((F.count("*") % 2 == 1).alias("odd"))
    return bits.join(odd, ["vec_id", "pos"], "left").select("vec_id", "pos", (F.col("bit") != F.coalesce("odd", F.lit(False))).alias("bit"))


def set_words(words: DataFrame, header: DataFrame, updates: DataFrame, *, strict: bool = True) -> DataFrame:
    """apply_sets() on the packed layout: the updates of a word are folded to two masks first. Padding is never set: positions beyond the
    vector are an error, or are left out if not strict."""
    last = within(updates, header, "pos", strict).groupBy("vec_id", "pos").agg(F.max_by("bit", "seq").alias("new"))
    m, zero = B.bit_mask(F.col("pos")), F.lit(0).cast("bigint")
    masks = last.groupBy("vec_id", B.word_of(F.col("pos")).alias("word_idx")).agg(F.bit_or(F.when(F.col("new"), m).otherwise(zero)).alias("on"), F.bit_or(F.when(F.col("new"), zero).otherwise(m)).alias("off"))
    word = F.col("word").bitwiseOR(F.coalesce("on", zero)).bitwiseAND(F.bitwise_not(F.coalesce("off", zero)))
    return words.join(masks, ["vec_id", "word_idx"], "left").select("vec_id", "l1_idx", "word_idx", word.alias("word"))


def flip_words(words: DataFrame, header: DataFrame, flips: DataFrame, *, strict: bool = True) -> DataFrame:
    """apply_flips() on the packed layout: one exclusive or per word. Positions beyond the vector as in set_words()."""
    masks = within(flips, header, "pos", strict).groupBy("vec_id", B.word_of(F.col("pos")).alias("word_idx")).agg(F.bit_xor(B.bit_mask(F.col("pos"))).alias("m"))
    return words.join(masks, ["vec_id", "word_idx"], "left").select("vec_id", "l1_idx", "word_idx", F.col("word").bitwiseXOR(F.coalesce("m", F.lit(0).cast("bigint"))).alias("word"))


def equal(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row (equal): same positions with same bits."""
    x, y = a.select("pos", F.col("bit").alias("a")), b.select("pos", F.col("bit").alias("b"))
    differ = x.join(y, "pos", "full_outer").where(~F.col("a").eqNullSafe(F.col("b")))
    return differ.agg((F.count("*") == 0).alias("equal"))


def equal_words(a: DataFrame, b: DataFrame) -> DataFrame:
    """equal() of two packed vectors of equal length."""
    x, y = a.select("word_idx", F.col("word").alias("a")), b.select("word_idx", F.col("word").alias("b"))
    return x.join(y, "word_idx", "full_outer").where(~F.col("a").eqNullSafe(F.col("b"))).agg((F.count("*") == 0).alias("equal"))


def debug(bits: DataFrame) -> DataFrame:
    """(vec_id, text) like {1, 0, 1}. For vectors that are read by people: it gathers a vector's bits."""
    ordered = F.sort_array(F.collect_list(F.struct("pos", F.col("bit").cast("int").cast("string").alias("b"))))
    return bits.groupBy("vec_id").agg(F.concat(F.lit("{"), F.array_join(F.transform(ordered, lambda x: x["b"]), ", "), F.lit("}")).alias("text"))


@dataclass(frozen=True)
class BitVec:
    """One vector or a view of one: rows start <= pos < start + n of `parent`.

    Slices of slices add their offsets, so a view is always one range filter on the parent's own position, which reaches
    the Parquet scan. Updates go to the parent and return a new vector.
    """

    parent: DataFrame
    n: int
    start: int = 0

    def __post_init__(self) -> None:
        if self.n < 0 or self.start < 0:
            raise ValueError(f"a view from {self.start} of length {self.n}")

    @classmethod
    def new(cls, spark: SparkSession, n: int) -> BitVec:
        return cls(zeros(spark, n), n)

    def __len__(self) -> int:
        return self.n

    def is_empty(self) -> bool:
        return self.n == 0

    def bits(self) -> DataFrame:
        """Rows (vec_id, pos, bit) with positions from 0."""
        inside = (F.col("pos") >= self.start) & (F.col("pos") < self.start + self.n)
        return self.parent.where(inside).select("vec_id", (F.col("pos") - self.start).alias("pos"), "bit")

    def iter(self) -> DataFrame:
        return self.bits().orderBy("pos")

    def between(self, start: int, end: int) -> DataFrame:
        return self.bits().where((F.col("pos") >= start) & (F.col("pos") < end)).orderBy("pos")

    def raw(self) -> DataFrame:
        return pack(self.bits())

    def _checked(self, index: int) -> int:
        if not 0 <= index < self.n:
            raise IndexError(f"index is {index} but length is {self.n}")
        return index

    def get(self, index: int) -> DataFrame:
        self._checked(index)
        return self.get_unchecked(index)

    def get_unchecked(self, index: int) -> DataFrame:
        """(pos, bit); no row beyond the parent."""
        return self.parent.where(F.col("pos") == self.start + index).select((F.col("pos") - self.start).alias("pos"), "bit")

    def set(self, index: int, bit: bool) -> BitVec:
        return self.set_unchecked(self._checked(index), bit)

    def set_unchecked(self, index: int, bit: bool) -> BitVec:
        new = F.when(F.col("pos") == self.start + index, F.lit(bit)).otherwise(F.col("bit"))
        return BitVec(self.parent.withColumn("bit", new), self.n, self.start)

    def flip(self, index: int) -> BitVec:
        return self.flip_unchecked(self._checked(index))

    def flip_unchecked(self, index: int) -> BitVec:
        return BitVec(self.parent.withColumn("bit", F.col("bit") != (F.col("pos") == self.start + index)), self.n, self.start)

    def _inside(self, rows: DataFrame, strict: bool) -> DataFrame:
        """rows (vec_id, pos, ...) of this view as rows of the parent; those outside of the view are an error, or go if not strict."""
        ok = (F.col("pos") >= 0) & (F.col("pos") < self.n)
        rows = rows.withColumn("pos", F.when(ok, F.col("pos")).otherwise(beyond(F.col("pos")))) if strict else rows.where(ok)
        return rows.withColumn("pos", F.col("pos") + self.start)

    def get_many(self, queries: DataFrame, *, strict: bool = True) -> DataFrame:
        """queries (vec_id, idx, ...) with `bit`; an index outside of the view is an error, or has a null bit if not strict."""
        found = queries.join(self.bits().withColumnRenamed("pos", "idx"), ["vec_id", "idx"], "left")
        ok = (F.col("idx") >= 0) & (F.col("idx") < self.n)
        return found.withColumn("bit", F.when(ok, F.col("bit")).otherwise(beyond(F.col("idx")).cast("boolean"))) if strict else found

    def set_many(self, updates: DataFrame, *, strict: bool = True) -> BitVec:
        """updates (vec_id, pos, seq, bit), positions of this view."""
        return BitVec(apply_sets(self.parent, self._inside(updates, strict)), self.n, self.start)

    def flip_many(self, flips: DataFrame, *, strict: bool = True) -> BitVec:
        return BitVec(apply_flips(self.parent, self._inside(flips, strict)), self.n, self.start)

    def cursor(self) -> Cursor:
        return Cursor(self)

    def slice(self, start: int | None = None, end: int | None = None, *, exclusive_start: bool = False, inclusive_end: bool = False) -> BitVec:
        """A view: any form of range. start <= end <= length holds or it is an error; an empty range is fine."""
        a = 0 if start is None else start + exclusive_start
        b = self.n if end is None else end + inclusive_end
        if a > self.n or b > self.n or a > b or a < 0:
            raise IndexError(f"range is {a}..{b} but length is {self.n}")
        return self.slice_unchecked(a, b)

    def slice_unchecked(self, start: int, end: int) -> BitVec:
        return BitVec(self.parent, end - start, self.start + start)

    def split_at(self, index: int) -> tuple[BitVec, BitVec]:
        """[0, index) and [index, n); an error unless index < n."""
        self._checked(index)
        return self.slice_unchecked(0, index), self.slice_unchecked(index, self.n)

    def equals(self, other: BitVec) -> DataFrame:
        if self.n != other.n:
            return self.parent.sparkSession.range(1).select(F.lit(False).alias("equal"))
        return equal(self.bits(), other.bits())

    def debug(self) -> str:
        found = debug(self.bits()).collect()
        return found[0]["text"] if found else "{}"


@dataclass(frozen=True)
class Cursor:
    """A place in a vector (BitVec or IntVec) and what remains behind it: len(cursor) elements."""

    of: object
    at: int = 0

    def __len__(self) -> int:
        return len(self.of) - self.at

    def take(self, k: int) -> tuple[DataFrame, Cursor]:
        """The next k elements in order (fewer at the end), with their positions in the vector, and the cursor behind them."""
        if k < 0:
            raise ValueError("a cursor only goes on")
        end = min(len(self.of), self.at + k)
        return self.of.between(self.at, end), Cursor(self.of, end)
