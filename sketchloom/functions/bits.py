"""Bit-code functions: a code is an `array<bigint>` of words, least significant bit first.

`word_bits` is 8, 16, 32, 64 or 128 (or 1: a bit per element). Words below 64 bits are kept non-negative; 64-bit words
are two's complement; a word of 128 bits is two elements, the low half first, so only capacities differ from 64. Every function returns a Column built from Spark's own expressions. Positions may be ints or Columns.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Bit = Column | int


def _long(x: Bit) -> Column:
    return (x if isinstance(x, Column) else F.lit(x)).cast("long")


def _int(x: Bit) -> Column:
    return (x if isinstance(x, Column) else F.lit(x)).cast("int")


def stored_bits(word_bits: int) -> int:
    """Bits of an array element: a 128-bit word is two elements."""
    return min(word_bits, 64)


def n_elements(n_bits: int, word_bits: int) -> int:
    """Array elements of a code of at least n_bits, in whole words."""
    return -(-n_bits // word_bits) * (word_bits // stored_bits(word_bits))


def _mask(word_bits: int) -> int:
    word_bits = stored_bits(word_bits)
    return -1 if word_bits == 64 else (1 << word_bits) - 1


def _shl(value: Column, by: Column) -> Column:
    return F.call_function("shiftleft", value, by.cast("int"))


def _shr(value: Column, by: Column) -> Column:
    return F.call_function("shiftrightunsigned", value, by.cast("int"))


def size_bits(code: Column, word_bits: int = 64) -> Column:
    """Capacity of a code, padding included."""
    return (F.size(code) * stored_bits(word_bits)).cast("long")


def get_bit_unchecked(code: Column, i: Bit, word_bits: int = 64) -> Column:
    i, word_bits = _int(i), stored_bits(word_bits)
    word = F.get(code, F.floor(i / word_bits).cast("int"))
    return _shr(word, i % word_bits).bitwiseAND(F.lit(1).cast("long")) == 1


def get_bit(code: Column, i: Bit, word_bits: int = 64) -> Column:
    """Null outside the code."""
    i = _int(i)
    return F.when((i >= 0) & (i < size_bits(code, word_bits)), get_bit_unchecked(code, i, word_bits))


def set_bit(code: Column, i: Bit, value: Column | bool, word_bits: int = 64) -> Column:
    """Unchanged if i is outside the code."""
    i, v, word_bits = _int(i), value if isinstance(value, Column) else F.lit(value), stored_bits(word_bits)
    bit = _shl(F.lit(1).cast("long"), i % word_bits)
    at = F.floor(i / word_bits).cast("int")
    return F.transform(code, lambda w, p: F.when((p == at) & (i >= 0), F.when(v, w.bitwiseOR(bit)).otherwise(w.bitwiseAND(F.bitwise_not(bit)))).otherwise(w))


def set_true(code: Column, i: Bit, word_bits: int = 64) -> Column:
    return set_bit(code, i, True, word_bits)


def set_false(code: Column, i: Bit, word_bits: int = 64) -> Column:
    return set_bit(code, i, False, word_bits)


def flip_bit(code: Column, i: Bit, word_bits: int = 64) -> Column:
    i, word_bits = _int(i), stored_bits(word_bits)
    bit = _shl(F.lit(1).cast("long"), i % word_bits)
    at = F.floor(i / word_bits).cast("int")
    return F.transform(code, lambda w, p: F.when((p == at) & (i >= 0), w.bitwiseXOR(bit)).otherwise(w))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda s, x: s + x)


def count_bits(code: Column) -> Column:
    return _total(F.transform(code, F.bit_count))


def count_bits_range_unchecked(code: Column, lo: Bit, hi: Bit, word_bits: int = 64) -> Column:
    """Ones in [lo, hi): each word is shifted down to its overlap with the range and up past what follows it."""
    lo, hi, word_bits = _int(lo), _int(hi), stored_bits(word_bits)

    def in_word(w: Column, p: Column) -> Column:
        a = F.greatest(F.lit(0), lo - p * word_bits)
        b = F.least(F.lit(word_bits), hi - p * word_bits)
        return F.when(a < b, F.bit_count(_shl(_shr(w, a), F.lit(64) - (b - a)))).otherwise(0)

    return _total(F.transform(code, in_word))


def count_bits_range(code: Column, lo: Bit, hi: Bit, word_bits: int = 64) -> Column:
    """Null if the range is empty or reaches beyond the code."""
    lo, hi = _int(lo), _int(hi)
    return F.when((lo >= 0) & (lo < hi) & (hi <= size_bits(code, word_bits)), count_bits_range_unchecked(code, lo, hi, word_bits))


def zeros(n_bits: int, word_bits: int = 64) -> Column:
    """A code of at least n_bits zeros, in whole words."""
    return F.array_repeat(F.lit(0).cast("long"), n_elements(n_bits, word_bits))


def ones(n_bits: int, word_bits: int = 64) -> Column:
    """Whole words of ones; padding bits are set too."""
    return F.array_repeat(F.lit(_mask(word_bits)).cast("long"), n_elements(n_bits, word_bits))


def _zip(a: Column, b: Column, f) -> Column:
    """Word by word, cut to the shorter code."""
    n = F.least(F.size(a), F.size(b))
    return F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), f)


def hamming(a: Column, b: Column) -> Column:
    """Hamming distance of codes of one word width."""
    return _total(_zip(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))))


def hamming_words(a: str, b: str, n_words: int) -> Column:
    """Hamming distance of codes of a known length (names of columns): a flat sum that stays in generated code."""
    parts = [F.bit_count(F.get(F.col(a), F.lit(i)).bitwiseXOR(F.get(F.col(b), F.lit(i)))) for i in range(n_words)]
    return reduce(lambda x, y: x + y, parts)


def bit_dot(a: Column, b: Column) -> Column:
    """Number of ones that both codes have."""
    return _total(_zip(a, b, lambda x, y: F.bit_count(x.bitwiseAND(y))))


def to_bools(code: Column, word_bits: int = 64) -> Column:
    """Every bit of a code, padding included."""
    one, word_bits = F.lit(1).cast("long"), stored_bits(word_bits)
    return F.flatten(F.transform(code, lambda w: F.transform(F.sequence(F.lit(0), F.lit(word_bits - 1)), lambda i: _shr(w, i).bitwiseAND(one) == 1)))


def pack(bools: Column, word_bits: int = 64) -> Column:
    """Booleans (null counts as false) to words; the last word is padded with zeros."""
    n = F.ceil(F.size(bools) / word_bits).cast("int") * (word_bits // stored_bits(word_bits))
    word_bits = stored_bits(word_bits)
    word = lambda p: F.aggregate(
        F.transform(F.slice(bools, p * word_bits + 1, F.lit(word_bits)), lambda b, i: F.when(b, _shl(F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))),
        F.lit(0).cast("long"),
        lambda s, x: s.bitwiseOR(x),
    )
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), word)).otherwise(F.array().cast("array<bigint>"))


def repack(code: Column, from_bits: int, to_bits: int) -> Column:
    """The same bits in words of another width."""
    return code if from_bits == to_bits else pack(to_bools(code, from_bits), to_bits)


def hamming_mixed(a: Column, a_bits: int, b: Column, b_bits: int) -> Column:
    """Hamming distance across word widths, over the bits that both codes have."""
    return _total(_zip_bools(a, a_bits, b, b_bits, lambda x, y: (x != y).cast("int")))


def bit_dot_mixed(a: Column, a_bits: int, b: Column, b_bits: int) -> Column:
    return _total(_zip_bools(a, a_bits, b, b_bits, lambda x, y: (x & y).cast("int")))


def _zip_bools(a: Column, a_bits: int, b: Column, b_bits: int, f) -> Column:
    return _zip(to_bools(a, a_bits), to_bools(b, b_bits), f)


def _logic(name: str, a: Column, b: Column, a_bits: int, b_bits: int, to_bits: int) -> Column:
    """Sized by `a`, in words of `to_bits`; bits that `b` does not have are 0."""
    op = {"or": lambda x, y: x | y, "and": lambda x, y: x & y, "xor": lambda x, y: x != y}[name]
    both = _zip_bools(a, a_bits, b, b_bits, op)
    missing = F.greatest(F.lit(0), F.size(a) * a_bits - F.size(b) * b_bits)
    return pack(F.concat(both, F.array_repeat(F.lit(False), missing)), to_bits)


def or_mixed(a: Column, b: Column, a_bits: int, b_bits: int, to_bits: int) -> Column:
    return _logic("or", a, b, a_bits, b_bits, to_bits)


def and_mixed(a: Column, b: Column, a_bits: int, b_bits: int, to_bits: int) -> Column:
    return _logic("and", a, b, a_bits, b_bits, to_bits)


def xor_mixed(a: Column, b: Column, a_bits: int, b_bits: int, to_bits: int) -> Column:
    return _logic("xor", a, b, a_bits, b_bits, to_bits)


def not_mixed(a: Column, a_bits: int, to_bits: int) -> Column:
    return pack(F.transform(to_bools(a, a_bits), lambda x: ~x), to_bits)


def or_code(a: Column, b: Column) -> Column:
    return _zip(a, b, lambda x, y: x.bitwiseOR(y))


def and_code(a: Column, b: Column) -> Column:
    return _zip(a, b, lambda x, y: x.bitwiseAND(y))


def xor_code(a: Column, b: Column) -> Column:
    return _zip(a, b, lambda x, y: x.bitwiseXOR(y))


def not_code(a: Column, word_bits: int = 64) -> Column:
    """Padding bits are flipped too."""
    return F.transform(a, lambda w: F.bitwise_not(w).bitwiseAND(F.lit(_mask(word_bits)).cast("long")))
