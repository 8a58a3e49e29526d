"""The flagship query: derived logs -> source-target join -> macro-F1 on both sides -> gap over seeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crossgauge.operators import relational as R
from crossgauge.plans import derived as D
from crossgauge.plans.registry import query

_F1 = "(" + " + ".join(f"coalesce(2.0 * sum((gold = {c} AND {{p}} = {c})::INT) / nullif(sum((gold = {c})::INT) + sum(({{p}} = {c})::INT), 0), 0)" for c in (0, 1)) + ") / 2"


@query("transfer_gap", sql=f"""WITH {D.SQL_PREDS}, g AS (SELECT lang, seed, {_F1.format(p='pred_src')} - {_F1.format(p='pred_tgt')} AS gap FROM preds GROUP BY 1, 2)
SELECT lang, round(avg(gap), 6) AS gap, round(coalesce(stddev_samp(gap), 0), 6) AS std, count(*) AS n_seeds FROM g GROUP BY 1""")
def transfer_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both arms are counted in one pass over the joined log: a cell for each gold label and pair of predictions."""
    keys = ["lang", "seed"]
    cells = D.predictions(spark, sf_dir).groupBy(*keys, "gold", "pred_src", "pred_tgt").agg(F.count("*").alias("n"))
    f1 = cells.groupBy(*keys).agg(R.weighted_macro_f1("pred_src", "n", 2).alias("s"), R.weighted_macro_f1("pred_tgt", "n", 2).alias("t"))
    gap = R.mean_std(f1.withColumn("gap", F.col("s") - F.col("t")), ["lang"], "gap")
    return gap.select("lang", F.round("mean", 6).alias("gap"), F.round("std", 6).alias("std"), F.col("n").alias("n_seeds")).orderBy("gap")
