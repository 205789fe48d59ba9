"""Exact interpolated percentiles that hold at any group size, by selection over several rounds."""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelens.session import bounded, cut_lineage

#: Ranges that a round counts.
SLOTS = 1024
_KEY = "_key_of_row"


def exact_percentile(
    df: DataFrame, keys: Sequence[str], value: str, share: float, name: str, *, accuracy: int = 10_000
) -> DataFrame:
    """One row per key: linearly interpolated percentile, exact, nulls ignored; NaN is the largest value.

    The built-in ``percentile`` keeps all distinct values of a group in one buffer. Here a mergeable sketch guesses a
    bracket around the wanted order statistics, and ``select_between`` counts until they are certain, whether the guess was
    right or not. Values are never sorted: a key orders at most ``SLOTS`` counts and a few.
    """
    key = F.struct(*keys) if keys else F.struct(F.lit(0).alias("all"))
    rows = df.select(key.alias(_KEY), F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    margin = 4.0 / accuracy
    low, high = max(0.0, share - margin), min(1.0, share + margin)
    guess = rows.groupBy(_KEY).agg(F.count(F.lit(1)).alias("_n"), F.percentile_approx("_v", [low, high], accuracy).alias("_q"))
    position = (F.col("_n") - 1) * F.lit(share)
    wanted = guess.select(
        _KEY, F.floor(position).alias("_r0"), F.ceil(position).alias("_r1"), (position - F.floor(position)).alias("_fraction"),
        F.col("_q")[0].alias("_lo"), F.col("_q")[1].alias("_hi"),
    )
    found = select_between(rows, wanted)
    between = F.when(F.col("_a") == F.col("_b"), F.col("_a")).otherwise(F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_fraction"))
    return found.select(*(F.col(f"{_KEY}.{k}").alias(k) for k in keys), between.alias(name))


def select_between(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The values ``_a, _b`` of two neighbouring ranks ``_r0, _r1`` (from 0) of every key, given a guess ``_lo, _hi``.

    A round counts the rows of each of ``SLOTS`` ranges between the bounds, those below and those above, with the least and
    the largest value of each. Ranks in two ranges are neighbours across a border, so both are known; ranks in one range
    narrow the bounds to its values, also where it lies outside the guess. The bounds themselves fall into different
    ranges, so every round leaves fewer distinct values; rounds alternate between equal and logarithmic ranges, which
    settles any doubles in some ten rounds, and as a rule in one or two.
    """
    none = F.lit(None).cast("double")
    state = cut_lineage(wanted.select("*", none.alias("_a"), none.alias("_b"), F.lit(False).alias("_done")))
    for step in itertools.count():
        open_ = state.filter(~F.col("_done"))
        if open_.isEmpty():
            return state
        # few bounds are broadcast, so rows are counted in place and only counts move
        tagged = rows.join(bounded(open_.select(_KEY, "_lo", "_hi")), _KEY)
        counted = tagged.groupBy(_KEY, _slot(step).alias("_slot")).agg(
            F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_least"), F.max("_v").alias("_most")
        )
        upto = F.sum("_c").over(Window.partitionBy(_KEY).orderBy("_slot").rowsBetween(Window.unboundedPreceding, 0))
        ranked = counted.withColumn("_upto", upto).join(open_.select(_KEY, "_r0", "_r1"), _KEY)
        holds = lambda rank: F.min(F.when(F.col("_upto") > F.col(rank), F.struct("_slot", "_least", "_most")))
        picked = ranked.groupBy(_KEY).agg(holds("_r0").alias("_s0"), holds("_r1").alias("_s1"))
        apart, one = F.col("_s0._slot") != F.col("_s1._slot"), F.col("_s0._least") == F.col("_s0._most")
        moved = open_.select(_KEY, "_r0", "_r1", "_fraction").join(picked, _KEY).select(
            _KEY, "_r0", "_r1", "_fraction", F.col("_s0._least").alias("_lo"), F.col("_s0._most").alias("_hi"),
            F.when(apart | one, F.col("_s0._most")).alias("_a"), F.when(apart | one, F.col("_s1._least")).alias("_b"), (apart | one).alias("_done"),
        )
        state = cut_lineage(state.filter("_done").unionByName(moved))


def _slot(step: int) -> Column:
    """The range of ``_v``, monotone in it: 0 to SLOTS - 1 from ``_lo`` to ``_hi``, others below, above and for what is not finite."""
    v, lo, hi = F.col("_v"), F.col("_lo"), F.col("_hi")
    if step % 2:
        # by sign and magnitude; 750 keeps the logarithm of the least double positive
        level = lambda x: F.signum(x) * F.when(x == 0, 0.0).otherwise(F.ln(F.abs(x)) + 750)
        v, lo, hi = level(v), level(lo), level(hi)
    part = F.when(hi > lo, (v / 2 - lo / 2) / (hi / 2 - lo / 2)).otherwise(0.0)
    inside = F.least(F.lit(SLOTS - 1), F.greatest(F.lit(0), F.floor(F.coalesce(part, F.lit(0.0)) * SLOTS)))
    v, lo, hi = F.col("_v"), F.col("_lo"), F.col("_hi")
    return (
        F.when(F.isnan(v), SLOTS + 2).when(v == float("inf"), SLOTS + 1).when(v == float("-inf"), -2)
        .when(v < lo, -1).when(v > hi, SLOTS).otherwise(inside).cast("int")
    )
