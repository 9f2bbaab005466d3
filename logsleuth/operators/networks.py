"""Addresses looked up in tables of address ranges: the narrowest range decides.

Ranges are cut into aligned blocks (at most two of each size), so that containment becomes
equality of a prefix: an address has one prefix of each length that occurs, and meets the blocks
with that prefix in an equi-join. No address is compared with a range it does not lie in.
Prefixes of up to ``SHORT`` bits, which very many addresses share, have at most
2 ** (SHORT + 1) - 1 blocks and are broadcast; a longer one is shared by at most 2 ** (31 - SHORT)
addresses.
"""

from pyspark.sql import Column, DataFrame, functions as F

from logsleuth.operators.distribute import store

BITS, SHORT = 32, 12


def ip_number(ip: Column) -> Column:
    """Value of a dotted IPv4 address; null for anything else."""
    parts = F.split(ip, r"\.")
    value = F.lit(0).cast("long")
    valid = ip.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$")
    for i in range(4):
        part = F.try_element_at(parts, F.lit(i + 1)).try_cast("long")
        valid = valid & (part <= 255)
        value = value * 256 + part
    return F.when(valid, value)


def aligned_blocks(ranges: DataFrame) -> DataFrame:
    """Blocks (length, prefix) that make up each range, with its columns as ``range``.

    ``ranges`` has first_ip and last_ip, both included. Ranges that are not addresses, or end
    before they begin, have no blocks. Of ranges that share a block the narrowest counts, of
    equally wide ones the first, then the one with the smallest other columns.
    """
    others = [c for c in ranges.columns if c not in ("first_ip", "last_ip")]
    first, last = F.col("_first"), F.col("_last")
    bounded = ranges.select(
        ip_number(F.col("first_ip")).alias("_first"), ip_number(F.col("last_ip")).alias("_last"), "*"
    ).filter(first <= last)
    # Blocks of 2 ** k addresses inside the range whose parent is not inside: the outermost two.
    k = F.col("_k")
    low = F.expr("shiftright(_first + shiftleft(1L, _k) - 1, _k)")
    high = F.expr("shiftright(_last + 1, _k) - 1")
    low_parent = F.expr("2 * shiftright(_first + shiftleft(1L, _k + 1) - 1, _k + 1)")
    high_parent = F.expr("2 * shiftright(_last + 1, _k + 1) - 1")
    uncovered = (k == BITS) | (F.col("_low_parent") > F.col("_high_parent"))
    own = F.filter(
        F.array_distinct(F.array("_low", "_high")),
        lambda p: (F.col("_low") <= F.col("_high")) & (uncovered | (p < F.col("_low_parent")) | (p > F.col("_high_parent"))),
    )
    choice = F.struct((last - first).alias("width"), first.alias("at"), *others, "first_ip", "last_ip")
    return (
        bounded.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(BITS))))
        .withColumns({"_low": low, "_high": high, "_low_parent": low_parent, "_high_parent": high_parent})
        .select((F.lit(BITS) - k).alias("length"), F.explode(own).alias("prefix"), choice.alias("range"))
        .groupBy("length", "prefix")
        .agg(F.min("range").alias("range"))
    )


def lookup_ranges(addresses: DataFrame, ranges: DataFrame, address: str = "ip_address") -> DataFrame:
    """``addresses`` with the columns of the narrowest range that holds each, null without one.

    ``addresses`` has one row per address: look up distinct addresses and join events to the
    result. Columns of ``ranges`` replace those of the same name.
    """
    blocks = store(aligned_blocks(ranges))
    taken = [c for c in ranges.columns if c != address]
    lengths = [r["length"] for r in blocks.select("length").distinct().collect()]  # 33 at most
    number = ip_number(F.col(address))
    known = addresses.select(F.col(address).alias("_address"), number.alias("_number")).filter("_number IS NOT NULL").distinct()

    def matches(some: list[int], table: DataFrame) -> DataFrame:
        prefixes = F.explode(F.lit(some).cast("array<int>")) if some else F.explode(F.array().cast("array<int>"))
        return (
            known.select("_address", "_number", prefixes.alias("length"))
            .withColumn("prefix", F.expr(f"shiftright(_number, {BITS} - length)"))
            .join(table, ["length", "prefix"])
            .select("_address", "range")
        )

    short = matches([n for n in lengths if n <= SHORT], F.broadcast(blocks.filter(F.col("length") <= SHORT)))
    long = matches([n for n in lengths if n > SHORT], blocks.filter(F.col("length") > SHORT))
    best = short.unionByName(long).groupBy("_address").agg(F.min("range").alias("_range"))
    kept = [c for c in addresses.columns if c not in taken]
    return (
        addresses.select(*kept)
        .join(best, F.col(address) == F.col("_address"), "left")
        .select(*kept, *[F.col(f"_range.{c}").alias(c) for c in taken])
    )
