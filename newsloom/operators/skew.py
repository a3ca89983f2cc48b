"""Looking up per-key values when a few keys may hold a large share of the rows."""

from pyspark.sql import functions as F

# A key is hot when it holds more than 1/200 of all rows, so there are fewer than 200.
HOT_SHARE = 200


def attach(rows, lookup, key, weight, total, spread_by, hint=None):
    """Left join ``lookup`` (unique on the string ``key``) onto ``rows`` without a hot partition.

    ``weight`` is the column of ``lookup`` that counts the rows of a key and ``total`` the sum
    over all keys, so at most ``HOT_SHARE`` rows of ``lookup`` are hot; those are broadcast.
    The rows they serve are spread over all partitions of the join that handles every other
    key, where they find no partner. ``hint`` is the join strategy for the other keys, if not Spark's choice.
    """
    values = [c for c in lookup.columns if c != key]
    is_hot = F.col(weight) * HOT_SHARE > F.lit(total)
    hot = lookup.where(is_hot).select(
        F.col(key).alias("_hot_key"), F.xxhash64(key).alias("_hot_hash"), F.struct(*values).alias("_hot")
    )
    cold = lookup.where(~is_hot).select(
        F.col(key).alias("_cold_key"), F.struct(*values).alias("_cold")
    )
    if hint:
        cold = cold.hint(hint)
    # found by a number: a broadcast table of texts takes a whole page of memory, however few they are
    is_same = (F.xxhash64(key) == F.col("_hot_hash")) & F.array_contains(F.array("_hot_key"), F.col(key))
    # part of the key itself: a constant on the other side would be folded out of the join
    spread = F.concat(F.col(key), F.lit("\x00"), F.xxhash64(spread_by).cast("string"))
    joined = (
        rows.join(F.broadcast(hot), is_same, "left")
        .withColumn("_spread_key", F.when(F.col("_hot").isNull(), F.col(key)).otherwise(spread))
        .join(cold, F.col("_spread_key") == F.col("_cold_key"), "left")
    )
    found = F.coalesce("_hot", "_cold")
    return joined.withColumns({v: found[v] for v in values}).select(*rows.columns, *values)
