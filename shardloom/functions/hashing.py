"""Slots of keys and ids that embed their slots, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

SLOTS = 1024
_2_32 = 1 << 32


def _digits(text: Column, n: int) -> Column:
    """The hash of the last ``n`` (12 at most) ASCII characters of a text; it stays in generated code."""
    back = F.reverse(text)
    return reduce(lambda a, b: a + b, [F.ascii(F.substring(back, i + 1, 1)).cast("long") * F.lit(31**i) for i in range(n)])


def slot(key: Column) -> Column:
    """The slot of a key's text: 31 * h + unit over UTF-16 units in wrapping 64 bits, absolute, modulo 1024; null gives -1.

    Works for any text under ANSI arithmetic: the 64 bits are two halves of 32 in longs, which never overflow; texts of
    at most 12 ASCII characters don't reach 63 bits and are summed up at once. For integers see ``slot_of_integer``.
    """
    text = key.cast("string")
    units = F.encode(text, "UTF-16BE")
    n = (F.octet_length(units) / 2).cast("int")
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    unit = lambda i: F.conv(F.hex(F.substring(units, i * 2 + 1, F.lit(2))), 16, 10).cast("long")

    def step(h: Column, i: Column) -> Column:
        low = h["lo"] * 31 + unit(i)
        return F.struct(F.pmod(h["hi"] * 31 + F.floor(low / _2_32), F.lit(_2_32)).alias("hi"), F.pmod(low, F.lit(_2_32)).alias("lo"))

    start = F.struct(F.lit(0).cast("long").alias("hi"), F.lit(0).cast("long").alias("lo"))
    # only the sign needs the high half: 1024 divides 2**32
    found = F.aggregate(places, start, step, lambda h: F.when(h["hi"] >= 1 << 31, F.pmod(-h["lo"], F.lit(SLOTS))).otherwise(F.pmod(h["lo"], F.lit(SLOTS))))
    # as many bytes as characters: ASCII
    short = (F.length(text) <= 12) & (F.octet_length(text) == F.length(text))
    return F.when(key.isNull(), -1).when(short, _digits(text, 12) % SLOTS).otherwise(found).cast("int")


def wrapped(number: Column) -> Column:
    """A decimal of at most 38 digits as the 64-bit number that it wraps to."""
    full, half = (F.lit(str(1 << n)).cast("decimal(20,0)") for n in (64, 63))
    return (F.pmod(number + half, full) - half).cast("bigint")


def slot_of_integer(key: Column) -> Column:
    """The slot of an integer of 64 bits or less, which has 20 characters at most: the same as ``slot``, in generated code."""
    text = key.cast("string")
    n = F.length(text)
    head = _digits(F.substring(text, F.lit(1), n - 10), 10).cast("decimal(19,0)") * F.lit(31**10).cast("decimal(19,0)")
    long = wrapped((head + _digits(text, 10)).cast("decimal(38,0)"))
    # the sign of the remainder goes, that of the number may not: there is no absolute value of the least one
    return F.when(key.isNull(), -1).when(n <= 12, _digits(text, 12) % SLOTS).otherwise(F.abs(long % SLOTS)).cast("int")


def is_numeric_id(text: Column) -> Column:
    """Whether the text is a signed 64-bit number without blanks."""
    return F.coalesce(text.rlike("^[+-]?[0-9]+$") & text.try_cast("bigint").isNotNull(), F.lit(False))


def slot_of_keys(*keys: Column) -> Column:
    """The slot of several keys: of the absolute product of the numbers that they are, or of their slots if they aren't.

    Products wrap in 64 bits, as the hash does; the absolute value of the least number is itself.
    """
    if len(keys) == 1:
        return slot(keys[0])
    number = lambda k: F.when(is_numeric_id(k.cast("string")), k.cast("string").try_cast("bigint")).otherwise(slot(k).cast("long"))
    product = reduce(lambda a, b: wrapped((a.cast("decimal(19,0)") * b.cast("decimal(19,0)")).cast("decimal(38,0)")), [number(k) for k in keys])
    least = F.lit(-(1 << 63))
    return slot_of_integer(F.when(product > least, F.abs(F.greatest(product, least + 1))).otherwise(product))


def encode_composed(seed: Column, key_slot: Column) -> Column:
    """An id that ends in its key's slot: 10 low bits."""
    return F.shiftleft(seed.cast("long"), 10) + key_slot


def decode_composed(composed: Column) -> Column:
    """The slot in an id; -1 if the id isn't a number."""
    number = composed.cast("string").try_cast("bigint")
    return F.coalesce(number.bitwiseAND(F.lit(SLOTS - 1).cast("long")), F.lit(-1)).cast("int")


def encode_two_dim(prefix: Column, slot1: Column, slot2: Column) -> Column:
    """An id of two dimensions: 27 characters of the prefix at most and five hexadecimal digits with both slots."""
    both = F.shiftleft(slot1.cast("long"), 10).bitwiseOR(slot2.cast("long"))
    return F.lower(F.concat(F.substring(prefix.cast("string"), 1, 27), F.lpad(F.hex(both), 5, "0")))


def decode_two_dim(composed: Column, dim: int) -> Column:
    """The slot of dimension 0 or 1 in such an id; -1 if its last five characters aren't hexadecimal digits."""
    tail = F.right(composed, F.lit(5))
    both = F.conv(tail, 16, 10).try_cast("bigint")
    found = F.shiftright(both, 10) if dim == 0 else both.bitwiseAND(F.lit(SLOTS - 1).cast("long"))
    return F.coalesce(F.when(tail.rlike("^[0-9a-fA-F]{5}$"), found), F.lit(-1)).cast("int")
