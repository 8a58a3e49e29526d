"""The diagnostic router and its ladders, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from crossgauge.plans.derived import PRECEDENCE, label_group, precedence_pick


def route(rows: DataFrame, tau: float, sim: str = "labse_sim", fired: str = "modules_fired") -> DataFrame:
    """Gate, statuses, assigned label and group. A similarity under tau is final: nothing else is evaluated."""
    shut = F.col(sim) < tau
    kept = F.when(shut, F.array(F.lit("gate"))).otherwise(F.filter(fired, lambda m: m != "gate"))
    out = rows.withColumn(fired, kept).withColumn("gate_status", F.when(shut, "fired").otherwise("passed"))
    statuses = {f"{m}_status": F.when(shut, "not_evaluated").when(F.array_contains(fired, m), "fired").otherwise("not_fired") for m, _ in PRECEDENCE[1:]}
    return out.withColumns(statuses).withColumn("assigned", precedence_pick(F.col(fired))).withColumn("assigned_group", label_group(F.col("assigned")))


def collapsed(rows: DataFrame, keys: list[str], pred: str, cutoff: float) -> DataFrame:
    """Rows whose prediction is their key's dominant class, if its share is at least the cutoff; ties go to the smaller class."""
    counts = rows.groupBy(*keys, pred).agg(F.count("*").alias("_n"))
    top = counts.groupBy(*keys).agg(F.min_by(pred, F.struct(-F.col("_n"), F.col(pred))).alias("_top"), (F.max("_n") / F.sum("_n")).alias("_share"))
    return rows.join(top, keys).withColumn("collapsed", (F.col("_share") >= cutoff) & (F.col(pred) == F.col("_top"))).drop("_top", "_share")


def saliency_status(applicable: Column, converged: Column, divergence: Column, threshold: float) -> Column:
    return F.when(~applicable, "not_applicable").when(~F.coalesce(converged, F.lit(False)), "not_converged").when(divergence >= threshold, "fired").otherwise("not_fired")


def gate_status(ours: Column, published: Column, diagnosed: Column, tolerance: float) -> Column:
    return (
        F.when(ours.isNull(), "missing").when(ours > published + tolerance, "above").when(F.abs(ours - published) <= tolerance, "within")
        .when(diagnosed, "below, diagnosed").otherwise("below, NO diagnosis")
    )


def caveats(question: Column, comparison: Column, measure: Column, targets: Column) -> Column:
    """Names of the caveats that could explain a difference; targets: those of both sides."""
    linguistic = lambda first: measure.isin(first, "linguistic")
    return F.array_compact(F.array(
        F.when(linguistic("morphological_masking") & F.array_contains(targets, "hin"), "hindi_morphology"),
        F.when((question == "provenance") & linguistic("translation_drift"), "native_drift"),
        F.when((question == "provenance") & F.array_contains(targets, "ben"), "bengali_digits"),
        F.when(F.startswith(comparison, F.lit("Task 3")), "task3_ceiling"),
    ))


def seeds_right_elsewhere(ok: Column, item: str, seed: str) -> Column:
    """Whether another seed of the item satisfies ok."""
    return F.size(F.array_remove(F.collect_set(F.when(ok, F.col(seed))).over(W.partitionBy(item)), F.col(seed))) > 0
