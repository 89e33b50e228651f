"""Searches over enrichment levels: windows whose centre and width differ by level, and joins by intervals of any width."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from massloom.functions.chemistry import NEUTRON
from massloom.operators.joins import merged_windows, range_join

# Centre and half-width, in neutrons, of the windows searched at each percent of carbon-13 from 0 to 100.
CARBON_CENTRES = (
    0, 0, 1, 1, 2, 2, 3, 4, 4, 5, 5, 6, 6, 7, 7, 8, 9, -2, -1, -1, 0, 0, 1, 1, 2, 3, 3, 4, 4, 5, 5, 6, 7, 7, -3, -3, -2, -2, -1, -1, 0, 1, 1, 2, 2, 3, 3, 4, 4, 5,
    -5, -5, -4, -4, -3, -3, -2, -1, -1, 0, 0, 1, 1, 2, 2, 3, 4, -7, -6, -6, -5, -5, -4, -4, -3, -2, -2, -1, -1, 0, 0, 1, 2, 2, -8, -8, -7, -7, -6, -6, -5, -4, -4, -3, -3, -2, -2, -1, -1, 0, 0,
)
CARBON_WIDTHS = (
    2, 2, 2, 3, 4, 4, 4, 5, 4, 5, 6, 6, 6, 6, 6, 6, 6, 6, 6, 6, 7, 7, 7, 8, 7, 8, 7, 8, 8, 8, 8, 8, 8, 8, 8, 8, 8, 8, 8, 8, 8, 8, 8, 8, 8, 8, 8, 8, 8, 8,
    8, 8, 8, 8, 8, 8, 8, 8, 8, 8, 8, 8, 8, 8, 8, 8, 8, 8, 8, 8, 8, 8, 8, 8, 7, 8, 7, 7, 7, 7, 6, 7, 6, 6, 6, 6, 6, 6, 6, 6, 6, 5, 5, 4, 4, 4, 4, 4, 3, 3, 2,
)

#: Factor from one bin width to the next: a range is a bin wide at most, so that it touches two.
LEVEL_FACTOR = 4


def level_windows(centres: Sequence[int] = CARBON_CENTRES, widths: Sequence[int] = CARBON_WIDTHS, tolerance: float = 0.01, neutron: float = NEUTRON) -> list[tuple[int, float, float]]:
    """Windows of mass offsets at each level: (level, low, high); those that touch are one.

    A level's windows lie at all whole neutrons from centre - width to centre + width, each
    with the tolerance on either side. Tables of other elements are given as centres and
    widths, or taken from the configurations of a sweep (windows_of_configs).
    """
    return [(level, low, high) for level, (c, w) in enumerate(zip(centres, widths, strict=True)) for low, high in merged_windows([k * neutron for k in range(c - w, c + w + 1)], tolerance)]


def at_each_level(peptides: DataFrame, windows: Sequence[tuple[int, float, float]]) -> DataFrame:
    """Each row once for each window: columns level, low and high added. The windows are constants of the plan, so nothing is joined."""
    level, low, high = (list(c) for c in zip(*windows, strict=True))
    each = F.arrays_zip(F.lit(level).alias("level"), F.lit(low).alias("low"), F.lit(high).alias("high"))
    return peptides.withColumn("_w", F.explode(each)).select(*peptides.columns, F.col("_w.level").cast("int").alias("level"), "_w.low", "_w.high")


def windows_of_configs(configs: DataFrame, neutron: float = NEUTRON) -> DataFrame:
    """Windows of configurations (search_name, windows array<int> in neutrons, tolerance): search_name, low, high; those that touch are one.

    Null windows and tolerances give no rows.
    """
    each = configs.where("tolerance is not null").select("search_name", "tolerance", F.array_sort(F.array_distinct("windows")).alias("w"))
    start = F.expr("cast(array() as array<struct<low:double,high:double>>)")

    def add(out: Column, k: Column, tolerance: Column) -> Column:
        low, high = k * neutron - tolerance, k * neutron + tolerance
        last = F.try_element_at(out, F.lit(-1))
        alone = F.array_append(out, F.struct(low.alias("low"), high.alias("high")))
        joined = F.array_append(F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0))), F.struct(last["low"].alias("low"), high.alias("high")))
        return F.when((F.size(out) > 0) & (low <= last["high"]), joined).otherwise(alone)

    merged = F.aggregate("w", start, lambda out, k: add(out, k, F.col("tolerance")))
    return each.select("search_name", F.explode(merged).alias("m")).select("search_name", "m.low", "m.high")


def bin_widths(ranges: DataFrame, low: Column, high: Column, factor: int = LEVEL_FACTOR, least: float = 1e-6) -> list[float]:
    """Bin widths for ranges: powers of factor that hold the widest in one bin, down to those that some range needs."""
    level = F.ceil(F.log(F.greatest(high - low, F.lit(least))) / math.log(factor) - 1e-9)
    return sorted(float(factor) ** r[0] for r in ranges.select(level.alias("level")).where("level is not null").distinct().collect())  # at most some dozens, as widths span few powers


def interval_join(points: DataFrame, ranges: DataFrame, point: str, low: Column, high: Column, widths: Sequence[float] | None = None, salt: int = 1) -> DataFrame:
    """Join points to ranges of any widths with low <= point <= high, each pair once.

    Every range is dealt to bins of the smallest of the widths that is not below its own, so it touches
    two bins at most, however wide. A point is copied once for each width that ranges use.
    Ranges wider than all widths touch as many bins of the last as they must. With salt > 1
    each bin's points are dealt over that many tasks, for hot bins.

    Null points and bounds, NaN, and ranges with high < low match nothing; equal rows of
    either side give a pair each. Columns of both sides are kept and should not clash. Both sides are shuffled,
    as neither's size before rows are copied to bins tells what a broadcast would hold.
    """
    ranges = ranges.withColumn("_low", low.cast("double")).withColumn("_high", high.cast("double")).where("_low <= _high and not isnan(_low) and not isnan(_high)")
    if widths is None:
        widths = bin_widths(ranges, F.col("_low"), F.col("_high"))
    if not widths:
        widths = [1.0]
    widths = sorted(widths)
    at = lambda x, w: F.floor(x / w).cast("long")
    own = F.lit(widths[-1])
    for w in reversed(widths[:-1]):
        own = F.when(F.col("_high") - F.col("_low") <= w, w).otherwise(own)
    right = ranges.withColumn("_width", own).withColumn("_bin", F.explode(F.sequence(at(F.col("_low"), F.col("_width")), at(F.col("_high"), F.col("_width")))))
    left = points.where(F.col(point).isNotNull() & ~F.isnan(F.col(point).cast("double"))).withColumn("_w", F.explode(F.array(*(F.struct(F.lit(w).alias("width"), at(F.col(point), w).alias("bin")) for w in widths))))
    left = left.withColumn("_width", F.col("_w.width")).withColumn("_bin", F.col("_w.bin")).drop("_w")
    keys = ["_width", "_bin"]
    if salt > 1:
        left = left.withColumn("_salt", F.pmod(F.xxhash64(*points.columns), F.lit(salt)))
        right = right.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salt - 1).cast("long"))))
        keys.append("_salt")
    return left.join(right.hint("merge"), keys).where(F.col(point).between(F.col("_low"), F.col("_high"))).drop(*keys, "_low", "_high")


def level_join(points: DataFrame, peptides: DataFrame, point: str, mass: str, windows: Sequence[tuple[int, float, float]]) -> DataFrame:
    """Join points to peptides by the windows around their mass at each level: a row for each point, peptide and window (column level) that holds it.

    The same as interval_join of points and at_each_level, but a peptide moves once, whatever the levels: it meets the points between its
    lowest and highest window, and only a pair that is found is copied to the windows. Null and NaN points and masses match nothing.
    """
    least, most = min(w[1] for w in windows), max(w[2] for w in windows)
    known = peptides.where(F.col(mass).isNotNull() & ~F.isnan(mass))
    pairs = range_join(points.where(F.col(point).isNotNull() & ~F.isnan(F.col(point).cast("double"))), known, point, F.col(mass) + least, F.col(mass) + most, max(most - least, 1e-6))
    each = at_each_level(pairs, windows)
    return each.where(F.col(point).between(F.col(mass) + F.col("low"), F.col(mass) + F.col("high"))).drop("low", "high")
