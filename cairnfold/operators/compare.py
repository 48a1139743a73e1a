"""Pristine against faulted: whether two views may be compared, and whether they agree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import eligible
from .faults import FAULTED, PRISTINE

KEY = ["trace", "schedule_idx", "stream_idx"]


def verdicts(summaries: DataFrame) -> DataFrame:
    """One row per schedule and stream: converged, diverged or ineligible, with the bits 1, 2 (a side is inexact) and 4 (frontiers differ).

    A schedule with a hard error on either side has no verdicts; errors() names it.
    """
    failed = summaries.where("error_code is not null").select("trace", "schedule_idx").distinct() if "error_code" in summaries.columns else None
    rows = summaries.withColumn("ok", eligible(F.col("certainty"), F.col("authoritative"), F.col("reasons"), F.col("pending"), F.col("pending_bytes")))
    side = lambda mode, p: rows.where(F.col("mode") == mode).select(*KEY, F.col("ok").alias(f"{p}_ok"), F.col("frontier").alias(f"{p}_frontier"), F.col("view").alias(f"{p}_view"))
    both = side(PRISTINE, "p").join(side(FAULTED, "f"), KEY)
    if failed is not None:
        both = both.join(failed, ["trace", "schedule_idx"], "left_anti")
    mismatch = ~F.col("p_frontier").eqNullSafe(F.col("f_frontier"))
    out = both.select(*KEY, (~F.col("p_ok")).alias("pristine_inexact"), (~F.col("f_ok")).alias("faulted_inexact"), mismatch.alias("frontier_mismatch"), (F.col("p_view") == F.col("f_view")).alias("_same"))
    bits = F.col("pristine_inexact").cast("int") + 2 * F.col("faulted_inexact").cast("int") + 4 * F.col("frontier_mismatch").cast("int")
    out = out.withColumn("ineligibility", bits)
    return out.withColumn("verdict", F.when(F.col("ineligibility") > 0, "ineligible").when(F.col("_same"), "converged").otherwise("diverged")).drop("_same")


def errors(summaries: DataFrame) -> DataFrame:
    """Of each schedule the hard error that ends its comparison: the pristine side's before the faulted one's, and on a side the one that comes first in delivery order."""
    order = F.struct(F.when(F.col("mode") == PRISTINE, 0).otherwise(1), "error_pos")
    return summaries.where("error_code is not null").groupBy("trace", "schedule_idx").agg(F.min_by(F.struct("mode", "stream_idx", "error_pos", "error_code"), order).alias("e")).select("trace", "schedule_idx", "e.*")


def key_differences(views: DataFrame) -> DataFrame:
    """Keys that only one side's view has: (trace, schedule_idx, stream_idx, key, only_in). For views too large for arrays."""
    cols = [*KEY, "key"]
    p, f = views.where(F.col("mode") == PRISTINE).select(cols), views.where(F.col("mode") == FAULTED).select(cols)
    return p.exceptAll(f).withColumn("only_in", F.lit(PRISTINE)).unionByName(f.exceptAll(p).withColumn("only_in", F.lit(FAULTED)))


def sizes(schedules: DataFrame, deliveries: DataFrame) -> DataFrame:
    """Of each schedule what the sides see and deliver."""
    counts = deliveries.groupBy("trace", "schedule_idx").agg(F.sum((F.col("mode") == PRISTINE).cast("int")).cast("long").alias("pristine_deliveries"), F.sum((F.col("mode") == FAULTED).cast("int")).cast("long").alias("faulted_deliveries"))
    out = schedules.select("trace", "schedule_idx", "schedule_id", "stream_prefix", "source_prefix").join(counts, ["trace", "schedule_idx"], "left")
    return out.fillna(0, ["pristine_deliveries", "faulted_deliveries"])
