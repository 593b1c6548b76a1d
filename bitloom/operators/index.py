"""The two-level population-count index as tables.

l1l2: (vec_id, l1_idx, l1, l2), l1 the ones before the block of 4096 bits, l2 seven running counts of its first blocks of
512; unused slots hold 4095, and a vector whose length fills its last block has one more row. samples: (vec_id, sample_no, value), the
place of each 8192nd one in units of 8192 bits. totals: (vec_id, n_bits, ones).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bitloom.functions import bits as B
from bitloom.operators.bitvec import header as header_of
from bitloom.operators.bitvec import pack
from bitloom.plans.prefix import prefix_sums


def l1_sums(words: DataFrame) -> DataFrame:
    """(vec_id, l1_idx, ones, before): ones of each L1 block and before it."""
    return prefix_sums(words.groupBy("vec_id", "l1_idx").agg(F.sum(B.ones(F.col("word"))).alias("ones")), "l1_idx", "ones", "before", levels=1)


def word_sums(words: DataFrame) -> DataFrame:
    """words with `before`: ones in all earlier words. One window of at most 64 rows per L1 block, and the blocks' sums."""
    w = Window.partitionBy("vec_id", "l1_idx").orderBy("word_idx").rowsBetween(Window.unboundedPreceding, -1)
    own = words.withColumn("own", F.coalesce(F.sum(B.ones(F.col("word"))).over(w), F.lit(0).cast("bigint")))
    return own.join(l1_sums(words).select("vec_id", "l1_idx", F.col("before").alias("base")), ["vec_id", "l1_idx"]).select("vec_id", "l1_idx", "word_idx", "word", (F.col("base") + F.col("own")).alias("before"))


def l1l2(words: DataFrame, header: DataFrame) -> DataFrame:
    block = F.shiftright(F.col("word_idx"), 3).bitwiseAND(7)
    parts = [F.sum(F.when(block <= j, B.ones(F.col("word"))).otherwise(F.lit(0).cast("bigint"))).alias(f"c{j}") for j in range(7)]
    sums = words.groupBy("vec_id", "l1_idx").agg(F.sum(B.ones(F.col("word"))).alias("ones"), *parts)
    sums = prefix_sums(sums, "l1_idx", "ones", "l1", levels=1).join(header, "vec_id")
    blocks = F.ceil(F.col("n_bits") / B.L2_BITS).cast("bigint")
    slots = [F.when(F.col("l1_idx") * 8 + j < blocks, F.col(f"c{j}")).otherwise(F.lit(B.UNUSED)).cast("int") for j in range(7)]
    entries = sums.select("vec_id", "l1_idx", "l1", F.array(*slots).alias("l2"))
    full = header.where((F.col("n_bits") > 0) & (F.ceil(F.col("n_bits") / B.L2_BITS) % 8 == 0)).select("vec_id", F.floor(F.ceil(F.col("n_bits") / B.L2_BITS) / 8).cast("bigint").alias("l1_idx"))
    ones = words.groupBy("vec_id").agg(F.sum(B.ones(F.col("word"))).alias("l1"))
    last = full.join(ones, "vec_id").select("vec_id", "l1_idx", "l1", F.array(*[F.lit(B.UNUSED)] * 7).alias("l2"))
    return entries.unionByName(last)


def samples(words: DataFrame) -> DataFrame:
    """A word has at most one of the sampled ones; only those words are looked into."""
    k = F.floor((F.col("before") + (B.BUCKET - 1)) / B.BUCKET)
    hit = word_sums(words).withColumn("sample_no", k.cast("bigint")).where(F.col("sample_no") * B.BUCKET < F.col("before") + B.ones(F.col("word")))
    pos = F.col("word_idx") * 64 + B.select_in_word(F.col("word"), F.col("sample_no") * B.BUCKET - F.col("before"))
    return hit.select("vec_id", "sample_no", F.shiftright(pos, 13).alias("value"))


def totals(words: DataFrame, header: DataFrame) -> DataFrame:
    ones = words.groupBy("vec_id").agg(F.sum(B.ones(F.col("word"))).alias("ones"))
    return header.join(ones, "vec_id", "left").select("vec_id", "n_bits", F.coalesce("ones", F.lit(0).cast("bigint")).alias("ones"))


def rough_rank(l1, l2, j) -> Column:
    """Ones before L2 block j of an index row."""
    l1, l2 = (F.col(x) if isinstance(x, str) else x for x in (l1, l2))
    return l1 + F.when(j == 0, 0).otherwise(F.get(l2, j - 1)).cast("bigint")


@dataclass(frozen=True)
class Index:
    """Words of vectors with their tables, for rank and select. Written once (to()), it is read by parts: an entry and at most eight words a query."""

    words: DataFrame
    header: DataFrame
    l1l2: DataFrame
    samples: DataFrame
    totals: DataFrame

    @classmethod
    def build(cls, bits: DataFrame) -> Index:
        """bits: a row for each position."""
        return cls.of(pack(bits), header_of(bits))

    @classmethod
    def of(cls, words: DataFrame, header: DataFrame) -> Index:
        return cls(words, header, l1l2(words, header), samples(words), totals(words, header))

    def to(self, path: str) -> Index:
        """The index written as five tables below path, and read back."""
        spark, tables = self.words.sparkSession, {}
        for name in ("words", "header", "l1l2", "samples", "totals"):
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")
            tables[name] = spark.read.parquet(f"{path}/{name}")
            if name == "header":  # what follows is made from the written words
                self = Index.of(tables["words"], tables["header"])
        return Index(**tables)
