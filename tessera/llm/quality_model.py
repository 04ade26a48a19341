"""Quality classifier of supervised subword embeddings: learned vectors of hashed
words, word pairs and character n-grams, averaged over the document, a softmax
output, trained by stochastic gradient descent in numpy.

Trained on at most max_rows labelled rows (a parameter) of the learning folds.
The output layer is linear in the average, so for scoring it is folded into the
vectors once: a document costs one table look-up a feature, in Arrow batches.

A null text is an empty one; a text without features gets the score of the bias
alone. Without labels of both kinds every score is the share of ones (0.5 without
any). Repeated rows get equal scores; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buffers, id_text, pieces, small_batches
from .features import TABLE, Rows, labelled, learn, mean_of


def fold(doc_id: F.Column, n: int = 5) -> F.Column:
    """crc32 of the id as text, modulo n; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % n


def fit(rows: Rows, dim: int = 12, epochs: int = 12, rate: float = 1.0, seed: int = 6) -> tuple[np.ndarray, float]:
    """The folded table and bias: log-odds of label 1."""
    y = rows.y
    if len(set(y.tolist())) < 2:
        p = float(y.mean()) if len(y) else 0.5
        p = min(max(p, 1e-3), 1 - 1e-3)
        return np.zeros(TABLE), float(np.log(p / (1 - p)))
    rng = np.random.default_rng(seed)
    vectors = rng.normal(0, 1 / dim, (TABLE, dim)).astype(np.float32)
    out, bias = np.zeros((2, dim), np.float32), np.log(np.bincount(y, minlength=2) / len(y)).astype(np.float32)
    steps, done = epochs * len(rows), 0
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            lr = np.float32(rate * (1 - done / steps) + 0.01)
            done += 1
            to, label = slice(rows.size[i], rows.size[i + 1]), y[i]
            at, weight = rows.col[to], rows.val[to]
            if not len(at):
                continue
            own = vectors[at]
            hidden = weight @ own
            z = out @ hidden + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[label] -= 1
            back = p @ out
            out -= lr * p[:, None] * hidden / max(np.float32(1), hidden @ hidden)
            bias -= lr * 0.1 * p
            # Averages spread a step over all features of a text, so it is scaled up, but never beyond a
            # normalised step: a text of few features would else move its own average too far.
            vectors[at] = own - lr * min(np.float32(20), 1 / (weight @ weight)) * weight[:, None] * back
    return (vectors @ (out[1] - out[0])).astype(np.float64), float(bias[1] - bias[0])


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, max_rows: int = 1500, test_fold: int = 0) -> DataFrame:
    """Columns doc_id, held_out, score, predicted."""
    usable = labels.where(fold(F.col("doc_id")) != test_fold)
    fitted = learn(docs, labelled(docs, usable, "quality", max_rows, 6), fit)
    model = docs.sparkSession.sparkContext.broadcast(fitted)  # one table of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, bias = model.value
        for big in batches:
            for batch in pieces(big):
                z = mean_of(table, *buffers(batch.column(1))) + bias
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], ["doc_id", "score"])

    small_batches(docs.sparkSession)
    scored = id_text(docs).mapInArrow(run, "doc_id long, score double")
    return scored.select(
        "doc_id", (fold(F.col("doc_id")) == test_fold).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
