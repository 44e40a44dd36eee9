"""Quality classifier: histogram gradient-boosted trees over document statistics, scored by vectorised traversal."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrid.llm.boost import Trees, fit_trees
from loomgrid.llm.common import fold, materialize, text_batches
from loomgrid.llm.labelled import even_weights, training_labels
from loomgrid.llm.text_stats import NAMES, text_stats

FOLDS, HELD_FOLD = 5, 0
#: Labelled rows that the trees are fitted on, at most about; their statistics (25 numbers each) come to the driver.
TRAIN_ROWS = 16_000
THRESHOLD = 0.3


def document_stats(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_key, stats) for every row, from its whole text."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.array([text_stats((x.as_py() or "").encode()) for x in batch["x"]], np.float32).reshape(batch.num_rows, len(NAMES))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * len(NAMES), pa.int32()), pa.array(rows.ravel()))
            yield pa.RecordBatch.from_arrays([batch["doc_key"], lists], names=["doc_key", "stats"])

    narrow = text_batches(docs).select(F.col(id_col).alias("doc_key"), F.col(text_col).alias("x"))
    return narrow.mapInArrow(measure, f"doc_key {narrow.schema['doc_key'].dataType.simpleString()}, stats array<float>")


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float32).reshape(len(column), width)


def fit(stats: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", folds: int = FOLDS, held_fold: int = HELD_FOLD, limit: int = TRAIN_ROWS) -> Trees:
    """Trees fitted on the statistics of a bounded sample of labelled documents outside the held-out fold.

    The sample holds either label as often as `limit` allows; its rows are weighted back, so scores are at the labels' natural rates whatever their number.
    An id that stands in several rows counts once, by its least statistics.
    """
    sample = training_labels(labels, label_col, id_col, folds, held_fold, limit)
    found = stats.join(F.broadcast(sample), F.col("doc_key") == F.col("label_id")).groupBy("label_id").agg(F.min(F.struct("stats", "label", "weight")).alias("one"))
    rows = found.select("label_id", "one.*").collect()
    rows.sort(key=lambda r: r.label_id)
    x = np.array([r.stats for r in rows], np.float32).reshape(len(rows), len(NAMES))
    return fit_trees(x, np.array([r.label for r in rows], float), even_weights([r.weight for r in rows]))


def score(stats: DataFrame, model: Trees, folds: int = FOLDS, held_fold: int = HELD_FOLD, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_key, held_out, score, predicted) for every row of `stats`."""
    held = stats.sparkSession.sparkContext.broadcast(model)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = held.value.probability(matrix(batch["stats"], len(NAMES)))
            yield pa.RecordBatch.from_arrays([batch["doc_key"], batch["held_out"], pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=["doc_key", "held_out", "score", "predicted"])

    keyed = stats.select("doc_key", F.coalesce(fold("doc_key", folds) == held_fold, F.lit(False)).alias("held_out"), "stats")
    return keyed.mapInArrow(apply, f"doc_key {keyed.schema['doc_key'].dataType.simpleString()}, held_out boolean, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """One row per row of `docs`: id, held_out, score, predicted.

    Statistics are taken once from the whole texts into a scratch table; fitting and scoring read that. A null text counts as
    empty and is scored by its all-zero statistics; a null id is never held out and never trained on; repeated rows score alike; an
    empty table gives an empty result; without labels every score is one half. Other columns are not read.
    """
    stats = materialize(document_stats(docs, id_col, text_col))
    model = fit(stats, labels, label_col, id_col)
    return score(stats, model).withColumnRenamed("doc_key", id_col)
