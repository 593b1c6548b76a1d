"""Rank (ones before a position) and select (position of a one by its number, from 0)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bitloom.functions import bits as B
from bitloom.operators.index import Index, rough_rank, word_sums


def rank_window(bits: DataFrame) -> DataFrame:
    """bits with rank1 of each position: running counts within L1 blocks, and the blocks' prefix sums."""
    from bitloom.plans.prefix import prefix_sums

    one = bits.select("vec_id", "pos", "bit", F.col("bit").cast("bigint").alias("one"), F.floor(F.col("pos") / B.L1_BITS).alias("block"))
    base = prefix_sums(one.groupBy("vec_id", "block").agg(F.sum("one").alias("s")), "block", "s", "base", levels=1).select("vec_id", "block", "base")
    w = Window.partitionBy("vec_id", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    own = one.withColumn("own", F.coalesce(F.sum("one").over(w), F.lit(0).cast("bigint")))
    return own.join(base, ["vec_id", "block"]).select("vec_id", "pos", "bit", (F.col("own") + F.col("base")).alias("rank1"))


def rank(words: DataFrame, header: DataFrame, queries: DataFrame, *, strict: bool = True) -> DataFrame:
    """queries (vec_id, idx, ...) with rank1 and rank0, for 0 <= idx <= n_bits. Beyond: an error, or null if not strict.

    Position idx > 0 is looked up in the word of idx - 1, so idx = n_bits needs no word that is not there.
    """
    n = header.select("vec_id", "n_bits")
    q = queries.join(n, "vec_id", "left").withColumn("ok", (F.col("idx") >= 0) & (F.col("idx") <= F.coalesce("n_bits", F.lit(0).cast("bigint"))))
    q = q.withColumn("word_idx", F.when(F.col("ok") & (F.col("idx") > 0), B.word_of(F.col("idx") - 1)))
    found = q.join(word_sums(words).select("vec_id", "word_idx", "word", "before"), ["vec_id", "word_idx"], "left")
    part = B.ones(F.col("word").bitwiseAND(B.shr(F.lit(-1).cast("bigint"), F.lit(63) - (F.col("idx") - 1).bitwiseAND(63))))
    inside = F.when(F.col("idx") == 0, F.lit(0).cast("bigint")).otherwise(F.col("before") + part)
    beyond = F.raise_error(F.concat(F.lit("index is "), F.col("idx").cast("string"), F.lit(", beyond the vector"))).cast("bigint") if strict else F.lit(None).cast("bigint")
    return found.withColumn("rank1", F.when(F.col("ok"), inside).otherwise(beyond)).withColumn("rank0", F.col("idx") - F.col("rank1")).drop("word_idx", "word", "before", "n_bits", "ok")


def rank_dyn(words: DataFrame, header: DataFrame, queries: DataFrame) -> DataFrame:
    """queries (vec_id, idx, value) with `rank`: of ones where value is true, else of zeros."""
    return rank(words, header, queries).withColumn("rank", F.when(F.col("value"), F.col("rank1")).otherwise(F.col("rank0"))).drop("rank1", "rank0")


def select_window(bits: DataFrame, queries: DataFrame) -> DataFrame:
    """queries (vec_id, r) with `pos`, or null: an equi-join with the numbered ones."""
    numbered = rank_window(bits).where("bit").select("vec_id", F.col("rank1").alias("r"), "pos")
    return queries.join(numbered, ["vec_id", "r"], "left")


def select(words: DataFrame, queries: DataFrame, *, ones: bool = True, header: DataFrame | None = None) -> DataFrame:
    """queries (vec_id, r) with `pos`: null where there is no such one.

    Words with ones cover ranges of one-numbers. Words and queries meet by buckets of 8192 ones (a word that reaches
    into a bucket enters it at its start), sorted by number; each query takes the last word before it. Linear in rows, and a
    window never holds more than one bucket. ones=False looks for zeros; it needs the header, for the last word's padding.
    """
    if not ones:
        left = F.col("n_bits") - F.col("word_idx") * 64
        words = words.join(header, "vec_id").withColumn("word", F.bitwise_not("word").bitwiseAND(F.when(left >= 64, F.lit(-1).cast("bigint")).otherwise(B.low_mask(F.greatest(left, F.lit(1).cast("bigint")))))).drop("n_bits")
    s = word_sums(words).withColumn("after", F.col("before") + B.ones(F.col("word"))).where("after > before")
    a, b = F.floor(F.col("before") / B.BUCKET), F.floor((F.col("after") - 1) / B.BUCKET)
    s = s.withColumn("bucket", F.explode(F.sequence(a, b)))
    kind = "struct<word_idx:bigint,word:bigint,before:bigint,after:bigint>"
    left = s.select("vec_id", "bucket", F.greatest("before", F.col("bucket") * B.BUCKET).alias("at"), F.struct("word_idx", "word", "before", "after").alias("w"), F.lit(None).cast("bigint").alias("n"))
    q = queries.groupBy("vec_id", "r").agg(F.count("*").alias("n"))
    right = q.where("r >= 0").select("vec_id", F.floor(F.col("r") / B.BUCKET).alias("bucket"), F.col("r").alias("at"), F.lit(None).cast(kind).alias("w"), "n")
    w = Window.partitionBy("vec_id", "bucket").orderBy("at", F.col("n").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    met = left.unionByName(right).withColumn("w", F.last("w", ignorenulls=True).over(w)).where("n is not null")
    hit = met.where(F.col("at") < F.col("w.after")).select("vec_id", F.col("at").alias("r"), (F.col("w.word_idx") * 64 + B.select_in_word(F.col("w.word"), F.col("at") - F.col("w.before"))).alias("pos"))
    return queries.join(hit, ["vec_id", "r"], "left")


def _block_words(index: Index, asked: DataFrame, last) -> DataFrame:
    """asked (vec_id, block, ...) with w: the words of its L2 block up to word `last`, in order, as (word_idx, word)."""
    first = F.col("block") * 8
    each = asked.select("*", F.explode(F.sequence(first, F.least(first + 7, last))).alias("word_idx"))
    words = index.words.select("vec_id", "word_idx", "word")
    met = each.join(words, ["vec_id", "word_idx"])
    return met.groupBy(asked.columns).agg(F.sort_array(F.collect_list(F.struct("word_idx", "word"))).alias("w"))


def rank_indexed(index: Index, queries: DataFrame, *, strict: bool = True) -> DataFrame:
    """As rank(), from the index: an entry of l1l2 and at most eight words for each distinct query."""
    asked = queries.select("vec_id", "idx").distinct().join(index.header.select("vec_id", "n_bits"), "vec_id").where("idx between 0 and n_bits").select("vec_id", "idx")
    at = asked.withColumn("l1_idx", F.floor(F.col("idx") / B.L1_BITS)).withColumn("j", F.floor(F.col("idx") % B.L1_BITS / B.L2_BITS).cast("int"))
    rough = at.join(index.l1l2, ["vec_id", "l1_idx"]).select("vec_id", "idx", F.floor(F.col("idx") / B.L2_BITS).alias("block"), rough_rank("l1", "l2", F.col("j")).alias("rough"))
    block = _block_words(index, rough.where(F.col("idx") % B.L2_BITS != 0), F.floor((F.col("idx") - 1) / 64))
    # Bits of a word below idx.
    part = F.aggregate("w", F.lit(0).cast("bigint"), lambda s, x: s + B.ones(x["word"].bitwiseAND(F.when(x["word_idx"] * 64 + 64 <= F.col("idx"), F.lit(-1).cast("bigint")).otherwise(B.low_mask(F.col("idx") - x["word_idx"] * 64)))).cast("bigint"))
    inside = block.select("vec_id", "idx", part.alias("part"))
    found = rough.join(inside, ["vec_id", "idx"], "left").select("vec_id", "idx", (F.col("rough") + F.coalesce("part", F.lit(0).cast("bigint"))).alias("rank1"))
    out = queries.join(found, ["vec_id", "idx"], "left")
    # The rank of 0 needs no word, nor a vector that has any.
    known = F.when(F.col("rank1").isNotNull(), F.col("rank1")).when(F.col("idx") == 0, F.lit(0).cast("bigint"))
    beyond = F.raise_error(F.concat(F.lit("index is "), F.col("idx").cast("string"), F.lit(", beyond the vector"))).cast("bigint") if strict else F.lit(None).cast("bigint")
    return out.withColumn("rank1", F.coalesce(known, beyond)).withColumn("rank0", F.col("idx") - F.col("rank1"))


def select_indexed(index: Index, queries: DataFrame) -> DataFrame:
    """As select() of ones, from the index: queries meet the entries of l1l2 by buckets of 8192 ones, then their block's words."""
    ones = index.totals.select("vec_id", "ones")
    q = queries.select("vec_id", "r").distinct().join(ones, "vec_id").where("r >= 0 and r < ones").select("vec_id", "r")
    w = Window.partitionBy("vec_id", "bucket").orderBy("at", F.col("r").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    # An entry's ones end at most 4096 behind its start, so it reaches into the next bucket at most.
    entry = index.l1l2.join(ones, "vec_id").where("l1 < ones").select("vec_id", "l1", F.struct("l1_idx", "l1", "l2").alias("e"))
    entry = entry.select("vec_id", "l1", "e", F.explode(F.array(F.floor(F.col("l1") / B.BUCKET), F.floor(F.col("l1") / B.BUCKET) + 1)).alias("bucket"))
    entry = entry.where(F.col("bucket") * B.BUCKET < F.col("l1") + B.L1_BITS).select("vec_id", "bucket", F.greatest("l1", F.col("bucket") * B.BUCKET).alias("at"), F.col("e.l1_idx").alias("l1_idx"), "e", F.lit(None).cast("bigint").alias("r"))
    asked = q.select("vec_id", F.floor(F.col("r") / B.BUCKET).alias("bucket"), F.col("r").alias("at"), F.lit(None).cast("bigint").alias("l1_idx"), F.lit(None).cast(entry.schema["e"].dataType).alias("e"), "r")
    # Of entries that start at one place, those before the last have no ones; the struct's maximum is the last.
    met = entry.unionByName(asked).withColumn("e", F.max(F.struct(F.col("e.l1"), F.col("e.l1_idx"), F.col("e.l2"))).over(w)).where("r is not null")
    rest = F.col("r") - F.col("e.l1")
    j, before = B.find_l2_binary(F.col("e.l2"), rest)
    rough = met.select("vec_id", "r", (F.col("e.l1_idx") * 8 + j).alias("block"), (rest - before).alias("rest"))
    block = _block_words(index, rough, F.col("block") * 8 + 7)
    start = F.struct(F.col("rest").alias("rest"), F.lit(-1).cast("bigint").alias("word_idx"), F.lit(0).cast("bigint").alias("word"))
    step = lambda s, x: F.when((s["word_idx"] >= 0) | (B.ones(x["word"]) <= s["rest"]), F.struct(F.when(s["word_idx"] >= 0, s["rest"]).otherwise(s["rest"] - B.ones(x["word"])).alias("rest"), s["word_idx"].alias("word_idx"), s["word"].alias("word"))).otherwise(F.struct(s["rest"].alias("rest"), x["word_idx"].alias("word_idx"), x["word"].alias("word")))
    hit = block.select("vec_id", "r", F.aggregate("w", start, step).alias("x"))
    found = hit.select("vec_id", "r", (F.col("x.word_idx") * 64 + B.select_in_word(F.col("x.word"), F.col("x.rest"))).alias("pos"))
    return queries.join(found, ["vec_id", "r"], "left")
