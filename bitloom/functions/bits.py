"""Column expressions on 64-bit words (signed longs read as raw bits, lowest bit first)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the two-level index: bits of an L1 and an L2 block, and of a select bucket (ones).
L1_BITS, L2_BITS, BUCKET = 4096, 512, 8192
#: What an unused L2 slot holds.
UNUSED = 4095


def shl(x: Column, n) -> Column:
    return F.call_function("shiftleft", x, (n if isinstance(n, Column) else F.lit(n)).cast("int"))


def shr(x: Column, n) -> Column:
    return F.call_function("shiftrightunsigned", x, (n if isinstance(n, Column) else F.lit(n)).cast("int"))


def low_mask(k) -> Column:
    """The k lowest bits, for k in 1..64: shifting ones down never overflows."""
    return shr(F.lit(-1).cast("bigint"), F.lit(64) - k)


def word_of(pos: Column) -> Column:
    return F.shiftright(pos, 6)


def l1_of_word(word_idx: Column) -> Column:
    return F.shiftright(word_idx, 6)


def bit_at(word: Column, pos: Column) -> Column:
    """The bit of position pos (of the vector) in its word."""
    return shr(word, pos.bitwiseAND(63)).bitwiseAND(1) == 1


def bit_mask(pos: Column) -> Column:
    return shl(F.lit(1).cast("bigint"), pos.bitwiseAND(63))


def ones(word: Column) -> Column:
    return F.bit_count(word).cast("bigint")


def select_in_word(word: Column, k: Column) -> Column:
    """Place of the one number k (from 0) of a word, or null. For query-sized data: it makes an array."""
    places = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda b: shr(word, b).bitwiseAND(1) == 1)
    return F.get(places, k.cast("int")).cast("bigint")


def find_l2_linear(l2: Column, rank: Column) -> tuple[Column, Column]:
    """(L2 block, ones before it) of a rank in an index entry: the first slot above the rank, by a scan."""
    j = F.size(F.filter(l2, lambda x: x <= rank))
    return j.cast("bigint"), F.when(j == 0, 0).otherwise(F.get(l2, j - 1)).cast("bigint")


def find_l2_binary(l2: Column, rank: Column) -> tuple[Column, Column]:
    """As find_l2_linear, by three comparisons; stays inside generated code."""

    def below(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(F.get(l2, F.lit(mid)) <= rank, below(mid + 1, hi)).otherwise(below(lo, mid))

    j = below(0, 7)
    return j.cast("bigint"), F.when(j == 0, 0).otherwise(F.get(l2, j - 1)).cast("bigint")


def prim_get(value: Column, index: Column, n_bits: Column) -> Column:
    """Bit of a primitive of n_bits bits; an error beyond them."""
    checked = F.when((index >= 0) & (index < n_bits), index).otherwise(F.raise_error(F.concat(F.lit("index is "), index.cast("string"), F.lit(" but length is "), n_bits.cast("string"))))
    return bit_at(value, checked)


def prim_set(value: Column, index: Column, bit: Column, n_bits: Column) -> Column:
    checked = F.when((index >= 0) & (index < n_bits), index).otherwise(F.raise_error(F.lit("index out of range")))
    m = bit_mask(checked)
    return F.when(bit, value.bitwiseOR(m)).otherwise(value.bitwiseAND(F.bitwise_not(m)))


def prim_flip(value: Column, index: Column, n_bits: Column) -> Column:
    checked = F.when((index >= 0) & (index < n_bits), index).otherwise(F.raise_error(F.lit("index out of range")))
    return value.bitwiseXOR(bit_mask(checked))


def array_get(words: Column, index: Column) -> Column:
    """Bit of an array of words, or null beyond 64 times its length."""
    return bit_at(F.get(words, word_of(index).cast("int")), index)


def array_set(words: Column, index: Column, bit: Column) -> Column:
    m = bit_mask(index)
    return F.transform(words, lambda w, k: F.when(k == word_of(index), F.when(bit, w.bitwiseOR(m)).otherwise(w.bitwiseAND(F.bitwise_not(m)))).otherwise(w))


def array_flip(words: Column, index: Column) -> Column:
    m = bit_mask(index)
    return F.transform(words, lambda w, k: F.when(k == word_of(index), w.bitwiseXOR(m)).otherwise(w))
