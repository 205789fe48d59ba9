"""Mixing sources to target weights by entropy balancing.

Each source gets a share of all words; documents get rates, and rates become whole copies. The rates of a source stay
as close to one copy each, in relative entropy on [0, 3], as the source's word target allows. The dual of that problem
is convex with one unknown per source: rate = 3 / (1 + 2 exp(-lambda x)), an exponential tilt in the document's size
x (over the source's mean size) that the cap bends. Newton iterations on Spark, kept inside a bracket, solve it: one
aggregate over (source, size) counts each. Rates are then rounded within (source, bucket) groups of about
``BUCKET_ROWS`` documents, largest first, each passing its rounding error on to the next.

Scale: sizes are counted before the iterations, so an iteration reads distinct (source, size) pairs, not documents; the
table of sources is the only one ordered as a whole. A source with a third of all rows is many buckets.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelens.llm.common import forget, save

WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3
BUCKET_ROWS = 128
#: Rounds of Newton steps; later ones halve the bracket, which ends at the last bit.
ROUNDS, TOLERANCE = 60, 1e-7


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``source, documents, source_size, target`` from ``source, size``.

    Sources by code point, null last, take ``weights`` in turn and share all words in proportion. No target is above
    ``most`` times its source's size; what is over goes to the others by weight until none is above. That level is
    found at once: with sources ordered by size over weight, the first k are full where the rest fits.
    """
    totals = save(sized.groupBy("source").agg(F.count("*").alias("documents"), F.sum("size").alias("source_size")), "mix-sources")
    # one row per source from here on
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = totals.withColumn("w", weight).withColumn("top", F.col("source_size") * float(most))
    by_fill = Window.orderBy((F.col("top") / F.col("w")), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    upto = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("top").over(upto), F.lit(0.0))) / (
        F.sum("w").over(everything) - F.coalesce(F.sum("w").over(upto), F.lit(0.0))
    )
    levelled = ranked.withColumns({"level": level, "place": F.row_number().over(by_fill)}).withColumn("open", F.col("w") * F.col("level") <= F.col("top"))
    # the level of the first open source: later ones, also those that fill at the same level, count it as full
    water = F.min(F.when(F.col("open"), F.struct("place", "level"))).over(everything)["level"]
    return levelled.select("source", "documents", "source_size", F.least("top", F.col("w") * F.coalesce(water, F.lit(0.0))).alias("target"))


def _rate(tilt: Column, x: Column, most: int) -> Column:
    """1 at no tilt, ``most`` and 0 at the ends; infinite tilts are the ends themselves."""
    return F.when(tilt == math.inf, F.lit(float(most))).when(tilt == -math.inf, F.lit(0.0)).otherwise(most / (1 + (most - 1) * F.exp(F.greatest(F.lit(-700.0), F.least(F.lit(700.0), -tilt * x)))))


def solve_tilts(sized: DataFrame, targets: DataFrame, most: int = MOST) -> DataFrame:
    """``source, tilt``: Newton steps for all sources at once until every target is met, bisection where a step leaves its bracket."""
    counts = save(sized.where("size > 0").groupBy("source", "size").agg(F.count("*").alias("n")), "mix-sizes")
    mean = F.greatest(F.col("source_size") / F.col("documents"), F.lit(1e-9))
    full = F.col("target") >= most * F.col("source_size") * (1 - 1e-12)
    state = save(targets.select(
        "source", "target", mean.alias("mean"),
        F.when(F.col("source_size") == 0, 0.0).when(full, math.inf).when(F.col("target") <= 0, -math.inf).otherwise(0.0).alias("tilt"),
        F.lit(-math.inf).alias("low"), F.lit(math.inf).alias("high"), ((F.col("source_size") == 0) | full | (F.col("target") <= 0)).alias("done"),
    ), "mix-state")
    for step in itertools.count():
        open_ = state.where("not done")
        if open_.isEmpty():
            break
        x = F.col("size") / F.col("mean")
        rate = _rate(F.col("tilt"), x, most)
        sums = (
            counts.withColumnRenamed("source", "of").join(open_, F.col("of").eqNullSafe(F.col("source")))
            .groupBy("source").agg(
                F.sum(F.col("n") * F.col("size") * rate).alias("words"),
                F.sum(F.col("n") * F.col("size") * x * rate * (1 - rate / most)).alias("slope"),
            ).withColumnRenamed("source", "of")
        )
        gap = F.col("words") - F.col("target")
        low, high = F.when(gap < 0, F.col("tilt")).otherwise(F.col("low")), F.when(gap >= 0, F.col("tilt")).otherwise(F.col("high"))
        moved = open_.join(sums, F.col("of").eqNullSafe(F.col("source"))).withColumns({"low": low, "high": high, "gap": gap})
        newton = F.col("tilt") - F.col("gap") / F.col("slope")
        inside = F.coalesce((F.col("slope") > 0) & (newton > F.col("low")) & (newton < F.col("high")) & (F.abs(newton - F.col("tilt")) <= 8) & F.lit(step < ROUNDS), F.lit(False))
        middle = (
            F.when(F.col("low") == -math.inf, F.least(F.col("high") * 2, F.col("high") - 1))
            .when(F.col("high") == math.inf, F.greatest(F.col("low") * 2, F.col("low") + 1))
            .otherwise((F.col("low") + F.col("high")) / 2)
        )
        near = F.abs(F.col("gap")) <= TOLERANCE * F.col("target")
        to = F.when(near, F.col("tilt")).when(inside, newton).otherwise(middle)
        narrow = (step >= ROUNDS) & ((to == F.col("low")) | (to == F.col("high")))
        moved = moved.select("source", "target", "mean", to.alias("tilt"), "low", "high", (near | F.coalesce(narrow, F.lit(False))).alias("done"))
        following = save(state.where("done").unionByName(moved), "mix-state")
        forget(state)
        state = following
    forget(counts)
    return state.select("source", "tilt", "mean")


def _round(group: pd.DataFrame) -> pd.DataFrame:
    """Whole copies, largest documents first; each error in words goes on to the next document."""
    group = group.sort_values(["size", "doc_id"], ascending=[False, True], kind="stable", na_position="last")
    carried, copies = 0.0, np.zeros(len(group), np.int64)
    for i, (size, rate) in enumerate(zip(group["size"].to_numpy(), group["rate"].to_numpy())):
        if size:
            copies[i] = min(MOST, max(0, math.floor(rate + carried / size + 0.5)))
            carried += (rate - copies[i]) * size
    return group.assign(copies=copies)


def mix(documents: DataFrame, *, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """``doc_id, source, size, source_size, target, rate, copies`` of every row of ``documents``.

    Size: words of the text; null is 0. An empty document gets rate 1 and no copies, since none of its words can count.
    Null ids and repeated rows are rows like others, a null source is a source of its own; among rows equal in source,
    size and id it does not matter which is copied. Rows are equal on every run: buckets and order depend on ids only.
    Other columns are not read; an empty table gives no rows.
    """
    sized = save(documents.select("doc_id", "source", word_count(F.col("text")).alias("size")), "mix-rows")
    targets = save(source_targets(sized, weights), "mix-targets")
    tilts = solve_tilts(sized, targets)
    plan = targets.join(tilts.withColumnRenamed("source", "of"), F.col("of").eqNullSafe(F.col("source"))).drop("of").withColumnRenamed("source", "named")
    rated = sized.join(plan, F.col("named").eqNullSafe(F.col("source"))).withColumns({
        "rate": F.when(F.col("size") == 0, 1.0).otherwise(_rate(F.col("tilt"), F.col("size") / F.col("mean"), MOST)),
        "bucket": F.pmod(F.xxhash64("doc_id", "size"), F.ceil(F.col("documents") / BUCKET_ROWS).cast("long")),
    }).select("doc_id", "source", "size", "source_size", "target", "rate", "bucket")
    return rated.groupBy("source", "bucket").applyInPandas(
        lambda g: _round(g.astype({"doc_id": "Int64"})),
        "doc_id long, source string, size long, source_size long, target double, rate double, bucket long, copies long",
    ).drop("bucket")


def repeat(documents: DataFrame, *, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """The rows of ``documents``, each as often as the mix copies it (0 to 3 times).

    Rows equal in id, source and size share their copies; which of them gets the odd one is decided by text.
    """
    keys = ["doc_id", "source", "size"]
    copies = save(mix(documents, weights=weights).groupBy(*keys).agg(F.sum("copies").alias("_copies"), F.count("*").alias("_rows")), "mix-copies")
    sized = documents.withColumn("_words", word_count(F.col("text")))
    named = copies.withColumnsRenamed({k: f"_{k}" for k in keys})
    same = [F.col(k if k != "size" else "_words").eqNullSafe(F.col(f"_{k}")) for k in keys]
    # hashing the short side leaves the texts unsorted
    joined = sized.join(named.hint("shuffle_hash"), same).drop(*(f"_{k}" for k in keys))
    share = F.col("_copies")
    if not copies.where("_rows > 1").limit(1).isEmpty():
        rank = F.row_number().over(Window.partitionBy("doc_id", "source", "_words").orderBy("text")) - 1
        joined = joined.withColumn("_rank", rank)
        share = F.floor(F.col("_copies") / F.col("_rows")) + F.when(F.col("_rank") < F.col("_copies") % F.col("_rows"), 1).otherwise(0)
    often = joined.withColumn("_share", share).where("_share > 0")
    return often.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_share").cast("long")))).select(*documents.columns)


def report(documents: DataFrame) -> DataFrame:
    return mix(documents).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
