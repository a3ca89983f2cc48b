"""Which rows may hold one of many keys, decided where the rows are read.

A Bloom filter in table form: the hash of a key names one 64-bit word and three bits in it. There
are at most ``WORDS`` rows however many keys there are, so the table can be broadcast; a row is
tested by a join on its word. A row that holds a key always passes. Up to some ten million keys few
others do, beyond that more of them pass, which costs time but no result.
"""

from pyspark.sql import functions as F

#: Words of a filter at most; a row of two numbers each.
WORDS = 1 << 20


def _word(hashed, words):
    return F.pmod(hashed, F.lit(words))


def _bits(hashed):
    # the leading 18 bits choose the three bits, the remainder the word
    return F.expr(
        " | ".join(f"shiftleft(1L, int(shiftrightunsigned({hashed}, {at}) & 63))" for at in (58, 52, 46))
    )


def key_filter(keys, hashed, words=WORDS):
    """The filter of the keys in ``keys``: rows ``word, bits``. ``hashed`` is the SQL of a key's 64-bit hash."""
    return keys.select(
        _word(F.expr(hashed), words).alias("_word"), _bits(hashed).alias("_bits")
    ).groupBy("_word").agg(F.bit_or("_bits").alias("_bits"))


def mark_members(rows, known, hashed, name, words=WORDS):
    """Add the column ``name``: false where the row's key is certainly not in the filter ``known``."""
    asked = _bits(hashed)
    joined = rows.join(F.broadcast(known), _word(F.expr(hashed), words) == F.col("_word"), "left")
    found = F.coalesce(F.col("_bits").bitwiseAND(asked) == asked, F.lit(False))
    return joined.withColumn(name, found).drop("_word", "_bits")


def members(rows, known, hashed, words=WORDS):
    """The rows whose key may be in the filter: an inner join, so the test is part of their scan."""
    asked = _bits(hashed)
    joined = rows.join(
        F.broadcast(known),
        (_word(F.expr(hashed), words) == F.col("_word")) & (F.col("_bits").bitwiseAND(asked) == asked),
    )
    return joined.drop("_word", "_bits")
