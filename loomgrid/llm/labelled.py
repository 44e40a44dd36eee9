"""Bounded samples of labelled rows, and scoring with a model fitted on one."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrid.llm.common import fold


def training_labels(labels: DataFrame, label_col: str, id_col: str, folds: int, held_fold: int, limit: int) -> DataFrame:
    """(label_id, label, weight): at most about `limit` labelled rows outside the held-out fold, as many of either label as there are.

    Each label gets half of `limit`; rows are taken by a hash of the id, with a share that comes from the label's count. Null
    labels, null ids and labels other than 0 and 1 are left out; an id with both labels is left out too. A row's weight is the number
    of labelled rows that it stands for (its label's count over the count taken), so weighted sums have the labels' natural rates.
    """
    own = labels.select(F.col(id_col).alias("label_id"), F.col(label_col).cast("int").alias("label"))
    own = own.filter(F.col("label").isin(0, 1) & F.col("label_id").isNotNull() & (fold("label_id", folds) != held_fold))
    own = own.groupBy("label_id").agg(F.min("label").alias("label"), F.max("label").alias("top")).filter("label = top").drop("top")
    counts = {r.label: r["count"] for r in own.groupBy("label").count().collect()}
    share = lambda label: min(1.0, limit / 2 / max(1, counts.get(label, 0)))
    draw = F.pmod(F.xxhash64(F.lit("sample"), "label_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    taken = own.filter(draw < F.when(F.col("label") == 1, share(1)).otherwise(share(0)))
    if all(share(label) == 1.0 for label in (0, 1)):
        return taken.withColumn("weight", F.lit(1.0))
    sampled = {r.label: r["count"] for r in taken.groupBy("label").count().collect()}
    weight = lambda label: counts.get(label, 0) / max(1, sampled.get(label, 0))
    return taken.withColumn("weight", F.when(F.col("label") == 1, F.lit(weight(1))).otherwise(F.lit(weight(0))))


def even_weights(weights: list[float]) -> np.ndarray:
    """Weights with a mean of 1, so that ridge and least sums of a fit mean as much on a sample as on all rows."""
    own = np.array(weights, float)
    return own / own.mean() if len(own) else own
