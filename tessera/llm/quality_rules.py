"""Quality rules: base rules counted on the whole text, then a hashed word and
character n-gram logistic regression, learnt from labelled rows, its probability
calibrated (Platt) on rows held out of the fit, against a fixed threshold. Texts
are scored in Arrow batches.

The regression is fitted on at most max_rows labelled rows (a parameter); counts,
base rules and scores cover all rows and whole texts. A null text is an empty
one, fails the base rules and is not kept. Without labels of both kinds there is
no regression and the base rules alone decide. Repeated rows and ties get equal
results; further columns are ignored, or kept by `filter_quality`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import Rolling, buffers, byte_codes, id_text, mix, owner, pieces, small_batches, word_spans
from .features import TABLE, Rows, labelled, learn, mean_of

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def count_rules(data: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """The five counts of every text."""
    n = len(off) - 1
    start, end = word_spans(data, off)
    doc = owner(off, start)
    code = Rolling(byte_codes(data))
    h = code.of(start, end)
    out = {"n_words": np.bincount(doc, minlength=n)}
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    out["word_chars"] = np.rint(np.bincount(doc, points[end] - points[start], n)).astype(np.int64)
    out["n_symbols"] = np.diff(np.concatenate([[0], np.cumsum(_SYMBOL[data])])[off])

    # Lines end at \n or at the text's end; one with a word counts if it is equal to an earlier one.
    breaks = np.flatnonzero(data == 10)
    begins = np.unique(np.concatenate([breaks + 1, off[:-1]]))
    begins = begins[begins < len(data)]
    stop = np.minimum(np.append(breaks, len(data))[np.searchsorted(breaks, begins)], off[owner(off, begins) + 1])
    words = np.searchsorted(start, stop) - np.searchsorted(start, begins)
    real = (words > 0) & (stop > begins)
    line_doc = owner(off, begins[real])
    key = mix(code.of(begins[real], stop[real]) + line_doc.astype(np.uint64))
    first = np.zeros(len(key), bool)
    first[np.unique(key, return_index=True)[1]] = True
    out["n_dup_lines"] = np.bincount(line_doc[~first], minlength=n)

    # Words in 8-word windows that the text holds twice or more.
    m = len(h) - 7
    covered = np.zeros(len(h) + 1, np.int64)
    if m > 0:
        at = np.flatnonzero(doc[:m] == doc[7:])
        key = mix(Rolling(h).of(at, at + 8) + doc[at].astype(np.uint64))
        _, back, count = np.unique(key, return_inverse=True, return_counts=True)
        twice = at[count[back] > 1]
        covered[twice] += 1
        np.subtract.at(covered, twice + 8, 1)
    out["n_repeat_words"] = np.bincount(doc[np.cumsum(covered[:-1]) > 0], minlength=n)
    return out


def base_failed(c: dict[str, np.ndarray]) -> np.ndarray:
    return (c["n_words"] < 20) | (100 * c["n_repeat_words"] > 30 * c["n_words"])


def _fit(rows: Rows, epochs: int = 250, scale: float = 30.0, l2: float = 2e-6) -> tuple[np.ndarray, float]:
    """Full-batch logistic regression by Adam on sparse rows; returns the table and the
    intercept. Features lie in two orders, by row for the scores and by bucket for the
    gradients, so that both are sums of slices."""
    order = np.argsort(rows.col, kind="stable")
    by_col = rows.col[order]
    first = np.flatnonzero(np.concatenate([[True], by_col[1:] != by_col[:-1]])) if len(by_col) else np.zeros(0, np.int64)
    used, n = by_col[first], len(first)
    place = np.zeros(TABLE, np.int32)
    place[used] = np.arange(n)
    col = place[rows.col]
    row_of = np.repeat(np.arange(len(rows), dtype=np.int32), np.diff(rows.size))[order]
    val_of = rows.val[order]
    del order, by_col
    full = np.flatnonzero(np.diff(rows.size))
    begin, held = rows.size[full], np.empty(len(col), np.float32)
    w, b, m, v = np.zeros(n + 1), 0.0, np.zeros(n + 1), np.zeros(n + 1)
    for t in range(1, epochs + 1):
        z, g = np.zeros(len(rows)), np.zeros(n + 1)
        if n:
            np.take((w[:-1] * scale).astype(np.float32), col, out=held, mode="clip")
            np.multiply(held, rows.val, out=held)
            z[full] = np.add.reduceat(held, begin)
        miss = 1 / (1 + np.exp(-np.clip(z + b, -30, 30))) - rows.y
        if n:
            np.take((miss * scale).astype(np.float32), row_of, out=held, mode="clip")
            np.multiply(held, val_of, out=held)
            g[:-1] = np.add.reduceat(held, first)
        g[-1] = miss.sum()
        g /= len(rows)
        g[:-1] += l2 * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        w[:-1] -= step[:-1]
        b -= step[-1]
    table = np.zeros(TABLE, np.float64)
    table[used] = w[:-1] * scale
    return table, float(b)


def _platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Calibration a, b of sigmoid(a z + b), by Newton's steps on smoothed targets."""
    pos, neg = y.sum(), (1 - y).sum()
    t = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x = np.stack([z, np.ones_like(z)], 1)
    ab = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ ab, -30, 30)))
        hess = (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        ab = ab - np.linalg.solve(hess, x.T @ (p - t) + 1e-6 * (ab - [1, 0]))
    return float(ab[0]), float(ab[1])


def fit_calibrated(rows: Rows) -> tuple[np.ndarray, float] | None:
    """Table and intercept of the calibrated log-odds that a row's label is 1."""
    both = lambda y: len(set(y.tolist())) == 2
    if not both(rows.y):
        return None
    fold = np.arange(len(rows)) % 5 == 0
    if not both(rows.y[fold]) or not both(rows.y[~fold]):
        return _fit(rows)
    table, b = _fit(rows.take(~fold))
    cut = rows.size
    z = np.array([table[rows.col[cut[i] : cut[i + 1]]] @ rows.val[cut[i] : cut[i + 1]] + b for i in np.flatnonzero(fold)])
    a, c = _platt(z, rows.y[fold])
    return table * a, b * a + c


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 1500, seed: int = 9) -> tuple[np.ndarray, float] | None:
    """The calibrated model of at most max_rows labelled rows; None without both labels."""
    return learn(docs, labelled(docs, labels, "quality", max_rows, seed), fit_calibrated)


def judge(data: np.ndarray, off: np.ndarray, model, threshold: float) -> dict[str, np.ndarray]:
    out = count_rules(data, off)
    failed = base_failed(out)
    good = np.ones(len(off) - 1)
    if model is not None:
        good = 1 / (1 + np.exp(-np.clip(mean_of(model[0], data, off) + model[1], -30, 30)))
    return out | {"base_failed": failed, "p_good": good, "kept": ~failed & (good >= threshold)}


def apply_rules(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, max_rows: int = 1500) -> DataFrame:
    """doc_id, the five counts, base_failed, p_good (calibrated), kept."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, max_rows))  # one table of fixed size
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in pieces(big):
                x = judge(*buffers(batch.column(1)), model.value, threshold)
                cols = [pa.array(x[k], pa.int64()) for k in COUNTS] + [pa.array(x["base_failed"]), pa.array(x["p_good"]), pa.array(x["kept"])]
                yield pa.RecordBatch.from_arrays([batch.column(0), *cols], ["doc_id", *COUNTS, "base_failed", "p_good", "kept"])

    schema = "doc_id long, " + ", ".join(f"{k} long" for k in COUNTS) + ", base_failed boolean, p_good double, kept boolean"
    return id_text(docs).mapInArrow(run, schema)


def filter_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, max_rows: int = 1500) -> DataFrame:
    """The rows that the rules keep, every column as it was."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, max_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in pieces(big):
                text = batch.column(batch.schema.get_field_index("text"))
                yield batch.filter(pa.array(judge(*buffers(text), model.value, threshold)["kept"]))

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)
