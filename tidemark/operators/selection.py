"""Exact order statistics of groups of any size: counts over leading bits of the values, pass by pass, without a buffer of a group's values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.staging import staged

#: Bits that a pass counts by: at most 2 ** BITS counts of a group.
BITS = 16
#: Bits of a double's fraction, and the exponent of the least normal one.
FRACTION, LEAST = 52, -1022
ONE = 1 << FRACTION


def ordered_bits(x: Column) -> Column:
    """A double as a long that orders alike and is different for different numbers; zeros are 0, infinities beyond the rest, NaN above them.

    The number's own exponent and fraction, worked out by exact products with powers of two.
    """
    size = F.abs(x)
    guess = F.floor(F.log2(size))
    power = lambda e: F.pow(F.lit(2.0), e)
    # The logarithm can round to a neighbouring whole number.
    e = F.when(size < power(guess), guess - 1).when(size / 2 >= power(guess), guess + 1).otherwise(guess)
    normal = (e - LEAST + 1).cast("long") * ONE + ((size * power(-e) - 1) * float(ONE)).cast("long")
    small = (size * power(F.lit(537)) * power(F.lit(537))).cast("long")  # below the least normal number: multiples of 2 ** -1074
    huge = F.lit(2047 * ONE)
    bits = F.when(F.isnan(x), huge + 1).when(size == float("inf"), huge).when(size < 2.0**LEAST, small).otherwise(normal)
    return F.when(x < 0, -bits).otherwise(bits)


def from_bits(bits: Column) -> Column:
    """The double of ordered_bits."""
    size = F.abs(bits)
    e, fraction = F.shiftright(size, FRACTION), size % ONE
    power = lambda k: F.pow(F.lit(2.0), k)
    normal = (1 + fraction.cast("double") / float(ONE)) * power((e + LEAST - 1).cast("double"))
    small = size.cast("double") * power(F.lit(-537)) * power(F.lit(-537))
    value = F.when(size > 2047 * ONE, float("nan")).when(size == 2047 * ONE, float("inf")).when(e == 0, small).otherwise(normal)
    return F.when(bits < 0, -value).otherwise(value)


def at_ranks(df: DataFrame, keys: list[str], column: str, ranks: DataFrame) -> DataFrame:
    """The values that stand at places of the order of each group: keys, rank (from 0, as in ranks: keys and rank), value.

    Four passes over a slim table of the groups' values.  Each counts by group, the bits known so far and the next BITS, map-side first, and keeps the
    range that holds the rank; from then on only rows in kept ranges count.  Nulls have no place; null keys are groups.
    """
    own = [f"k{i}" for i in range(len(keys))]
    named = {k: F.col(c) for k, c in zip(own, keys, strict=True)}
    slim = df.where(F.col(column).isNotNull()).select(*[v.alias(k) for k, v in named.items()], ordered_bits(F.col(column).cast("double")).alias("bits"))
    slim = staged(slim.groupBy(*own, "bits").agg(F.count(F.lit(1)).alias("n")), "values")
    known = ranks.select(*[v.alias(k) for k, v in named.items()], F.col("rank").alias("rank")).distinct()
    known = known.withColumns({"left": F.col("rank"), "prefix": F.lit(0).cast("long")})
    pairs = lambda a, b, names: reduce(lambda x, y: x & y, [a[c].eqNullSafe(b[c]) for c in names])
    for step in range(64 // BITS):
        low = 64 - BITS * (step + 1)
        # shiftright keeps the sign, so the first pass orders by signed leading bits; prefixes are those bits.
        digit, prefix = F.shiftright("bits", low), F.shiftright("bits", low + BITS) if step else F.lit(0).cast("long")
        rows = slim.select(*own, prefix.alias("prefix"), digit.alias("digit"), "n")
        wanted = known.select(*own, "prefix").distinct()
        if step:
            rows = rows.join(wanted, pairs(rows, wanted, [*own, "prefix"]), "left_semi")
        counts = rows.groupBy(*own, "prefix", "digit").agg(F.sum("n").alias("n"))
        w = Window.partitionBy(*own, "prefix").orderBy("digit").rowsBetween(Window.unboundedPreceding, 0)
        counts = counts.withColumn("upto", F.sum("n").over(w))
        inside = pairs(known, counts, [*own, "prefix"]) & (known["left"] < counts["upto"]) & (known["left"] >= counts["upto"] - counts["n"])
        known = known.join(counts, inside).select(*[known[c] for c in own], known["rank"], (known["left"] - (counts["upto"] - counts["n"])).alias("left"), counts["digit"].alias("prefix"))
        known = staged(known, "ranks")
    return known.select(*[F.col(k).alias(c) for k, c in zip(own, keys, strict=True)], "rank", from_bits(F.col("prefix")).alias("value"))


def exact_quantiles(df: DataFrame, keys: list[str], column: str, shares: list[float]) -> DataFrame:
    """Quantiles of each group, interpolated between neighbours as percentile does: keys, share, n, value.

    A group of nulls alone, and no group, has no row; NaN stands above infinity.
    """
    n = df.where(F.col(column).isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    asked = n.withColumn("share", F.explode(F.array(*map(F.lit, shares)))).withColumn("place", F.col("share") * (F.col("n") - 1))
    asked = staged(asked.withColumns({"below": F.floor("place"), "above": F.ceil("place")}), "asked")
    found = at_ranks(df, keys, column, asked.select(*keys, F.explode(F.array("below", "above")).alias("rank")))
    names = [f"q{i}" for i in range(len(keys))]
    side = lambda name: found.select(*[F.col(c).alias(f"{k}_{name}") for c, k in zip(keys, names, strict=True)], F.col("rank").alias(f"r_{name}"), F.col("value").alias(name))
    out = asked
    for name, rank in (("low", "below"), ("high", "above")):
        other = side(name)
        same = reduce(lambda a, b: a & b, [out[c].eqNullSafe(other[f"{k}_{name}"]) for c, k in zip(keys, names, strict=True)], out[rank] == other[f"r_{name}"])
        out = out.join(other, same)
    value = F.when(F.col("below") == F.col("above"), F.col("low")).otherwise((F.col("above") - F.col("place")) * F.col("low") + (F.col("place") - F.col("below")) * F.col("high"))
    return out.select(*keys, "share", "n", value.alias("value"))


def conformal_places(df: DataFrame, keys: list[str], column: str, level: float) -> DataFrame:
    """The order statistic number ceil((n + 1) * level), n at most, of each group: keys, n, value."""
    n = df.where(F.col(column).isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    asked = staged(n.withColumn("rank", F.least(F.ceil((F.col("n") + 1) * F.lit(level)), F.col("n")) - 1), "asked")
    found = at_ranks(df, keys, column, asked).withColumnsRenamed({c: f"{c}_" for c in [*keys, "rank"]})
    same = reduce(lambda a, b: a & b, [asked[c].eqNullSafe(found[f"{c}_"]) for c in [*keys, "rank"]])
    return asked.join(found, same).select(*keys, "n", "value")
