"""What the trained models share: a sample of labelled rows that is bounded in rows and bytes, and Adam."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from .common import settle

#: Rows of all labels together that a model learns from at most, but for one of each label.
MOST_ROWS, SPARE = 20_000, 32


def drawn(labelled: DataFrame, per_label: int, most: int = MOST_ROWS) -> list[Row]:
    """(label, h, value) of per_label rows of each label, or fewer where there are many labels: those of the least hashes.

    labelled has h, a hash of all that makes a row different, and value, which the caller bounds in bytes. Rows are
    counted by distinct hashes and thinned by them to about twice as many as are wanted and SPARE before any are shuffled, so that
    neither a frequent label nor a row that repeats often gathers; then equal rows become one and the rest is cut off.
    """
    labelled = labelled.where("label is not null")
    counts = settle(labelled.groupBy("label").agg(F.approx_count_distinct("h").alias("n"), F.min("h").alias("least")))
    labels = counts.count()
    wanted = max(1, min(per_label, most // max(1, labels)))
    counts = F.broadcast(counts) if labels <= MOST_ROWS else counts  # a row a label
    share = F.pmod(F.col("h"), F.lit(1 << 30)) < (1 << 30) * (2.0 * wanted + SPARE) / F.col("n")
    thinned = labelled.join(counts, "label").where(share | (F.col("h") == F.col("least")))  # one at least of each label
    each = thinned.groupBy("label", "h").agg(F.first("value").alias("value"))
    place = F.row_number().over(Window.partitionBy("label").orderBy("h"))
    return each.withColumn("place", place).where(F.col("place") <= wanted).drop("place").orderBy("label", "h").collect()


class Adam:
    def __init__(self, weights: dict[str, np.ndarray], rate: float) -> None:
        self.weights, self.rate, self.steps = weights, rate, 0
        self.mean = {k: np.zeros_like(w) for k, w in weights.items()}
        self.square = {k: np.zeros_like(w) for k, w in weights.items()}

    def step(self, gradients: dict[str, np.ndarray], scale: float = 1.0) -> None:
        self.steps += 1
        for k, g in gradients.items():
            g = np.clip(g, -1, 1)
            self.mean[k] += 0.1 * (g - self.mean[k])
            self.square[k] += 0.001 * (g * g - self.square[k])
            m, s = self.mean[k] / (1 - 0.9**self.steps), self.square[k] / (1 - 0.999**self.steps)
            self.weights[k] -= (scale * self.rate * m / (np.sqrt(s) + 1e-8)).astype(self.weights[k].dtype)
