"""Document quality by regularised quadratic discriminant analysis.

Statistics of a text are transformed to rough normality and standardised; each class has a mean and a
covariance shrunk towards the pooled one and its diagonal. A text's score is the difference of its two
log densities, from Mahalanobis distances by Cholesky factors that are computed once, calibrated to a
probability of label 1.

labels, lang, source and doc_id are no inputs of a score. Null, empty or wordless text: the statistics of no words.
Very long texts: their statistics cover the whole text. Ties: equal statistics give equal scores; of several labels of a
document the largest counts. Repeated rows: each is scored. Null and repeated doc_ids: see by_key. Fewer than two labelled rows of a class: every score is the
share of label 1. Empty table: empty result. Other columns of the input are not touched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociq.llm.labelled import fold_of, labelled_sample, logistic, probability
from lociq.llm.session import by_key
from lociq.llm.text import lower, pieces, span_hash, table, word_spans

_KINDS = np.zeros((8, 256), bool)
_KINDS[0, 65:91] = True  # upper case
_KINDS[1, 97:123] = True  # lower case
_KINDS[2, 48:58] = True  # digits
_KINDS[3, [33, 63]] = True  # ! ?
_KINDS[4, [35, 42, 36, 37, 38, 124, 60, 62, 64, 95, 123, 125, 91, 93, 61, 92, 126, 94]] = True  # symbols
_KINDS[5, [46, 44, 59, 58]] = True  # . , ; :
_KINDS[6, 10] = True  # line ends
_KINDS[7, 128:] = True  # bytes beyond ASCII


def _rate(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Logit of a smoothed share."""
    share = np.clip((part + 0.5) / (whole + 1.0), 1e-6, 1 - 1e-6)
    return np.log(share / (1 - share))


def _repeated(values: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """How many of each row's values stood in that row before."""
    order = np.lexsort((values, row))
    v, r = values[order], row[order]
    return np.bincount(r[1:][(v[1:] == v[:-1]) & (r[1:] == r[:-1])], minlength=rows)


def statistics(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Transformed statistics of every row, one line a row."""
    rows = len(offs) - 1
    small = lower(data)
    starts, ends, row = word_spans(small, offs)
    n = np.bincount(row, minlength=rows)
    chars = np.bincount(row, ends - starts, rows)
    squares = np.bincount(row, (ends - starts).astype(float) ** 2, rows)
    word = span_hash(small, starts, ends - starts)
    of_byte = np.repeat(np.arange(rows), np.diff(offs))
    count = [np.bincount(of_byte[kind[data]], minlength=rows) for kind in _KINDS]
    size = np.diff(offs)
    same = np.flatnonzero((word[1:] == word[:-1]) & (row[1:] == row[:-1])) if len(word) else np.zeros(0, np.int64)
    adjacent = np.bincount(row[same], minlength=rows)
    triple = word[:-2] * np.uint64(3) + word[1:-1] * np.uint64(0x9E3779B97F4A7C15) + word[2:] * np.uint64(0xC2B2AE3D27D4EB4F) if len(word) > 2 else word[:0]
    inside = row[: len(triple)] == row[2 : 2 + len(triple)]
    breaks = np.flatnonzero(data == 10)
    line_start = np.union1d(offs[:-1][size > 0], breaks + 1)
    line_start = line_start[line_start < len(data)]
    line_row = np.searchsorted(offs, line_start, "right") - 1
    line_end = np.concatenate([line_start[1:], [len(data)]]) if len(line_start) else line_start
    lines = np.bincount(line_row, minlength=rows)
    # A line's last byte is its line end, except for the last line of a text.
    closed = (line_end - line_start) - ((data[line_end - 1] == 10) if len(line_end) else 0)
    dup_lines = _repeated(span_hash(data, line_start, closed)[closed > 0], line_row[closed > 0], rows)
    letters = count[0] + count[1]
    mean = chars / np.maximum(n, 1)
    return np.column_stack([
        np.log1p(n), np.log1p(mean), np.log1p(np.sqrt(np.maximum(squares / np.maximum(n, 1) - mean**2, 0))), _rate(count[0], letters), _rate(count[2], size), _rate(count[3], size),
        _rate(count[4], size), _rate(count[5], size), _rate(count[7], size), _rate(_repeated(word, row, rows), n), _rate(adjacent, n), _rate(_repeated(triple[inside], row[: len(triple)][inside], rows), n),
        np.log1p(size / np.maximum(lines, 1)), _rate(dup_lines, lines),
    ])


@dataclass
class Discriminant:
    centre: np.ndarray
    spread: np.ndarray
    mean: list[np.ndarray]
    factor: list[np.ndarray]  # inverse Cholesky factors
    log_det: list[float]
    prior: float
    weights: np.ndarray | None = None

    def difference(self, x: np.ndarray) -> np.ndarray:
        """log density of class 1 less that of class 0."""
        z = np.clip((x - self.centre) / self.spread, -8, 8)
        far = [(((z - m) @ f.T) ** 2).sum(1) for m, f in zip(self.mean, self.factor)]
        return 0.5 * (far[0] + self.log_det[0] - far[1] - self.log_det[1])

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), self.prior)
        d = self.difference(x)
        return probability((np.sign(d) * np.log1p(np.abs(d)))[:, None], self.weights)


def fit(x: np.ndarray, y: np.ndarray, shrink: float = 0.2, diagonal: float = 0.1) -> Discriminant:
    prior = float(y.mean()) if len(y) else 0.0
    if min((y == 0).sum(), (y == 1).sum()) < 2:
        return Discriminant(np.zeros(0), np.ones(0), [], [], [], prior)
    centre, spread = x.mean(0), np.maximum(x.std(0), 1e-3)
    z = np.clip((x - centre) / spread, -8, 8)
    each = [np.cov(z[y == k].T, bias=True) for k in (0, 1)]
    mean = [z[y == k].mean(0) for k in (0, 1)]
    pooled = each[0] * (1 - prior) + each[1] * prior
    factor, log_det = [], []
    for c in each:
        c = (1 - shrink) * c + shrink * pooled
        c = (1 - diagonal) * c + diagonal * np.diag(np.diag(c)) + 1e-3 * np.eye(len(c))
        lower_factor = np.linalg.cholesky(c)
        factor.append(np.linalg.inv(lower_factor))
        log_det.append(2 * float(np.log(np.diag(lower_factor)).sum()))
    found = Discriminant(centre, spread, mean, factor, log_det, prior)
    d = found.difference(x)
    found.weights = logistic((np.sign(d) * np.log1p(np.abs(d)))[:, None], y.astype(float))
    return found


def quality(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 5, held: int = 0, threshold: float = 0.3, limit: int = 40_000) -> DataFrame:
    """One row a document: doc_id, held_out, score, predicted. Fits on at most `limit` labelled rows."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offs in pieces(batches):
            x = statistics(data, offs)
            yield table(y=batch.column("y"), x=pa.array(list(x), pa.list_(pa.float64())))

    def work(keyed: DataFrame) -> DataFrame:
        sample = labelled_sample(keyed, labels, label, folds, held, limit)
        rows = sample.select("text", "y").mapInArrow(measure, "y int, x array<double>").toArrow()  # bounded by `limit`
        x = np.array(rows.column("x").to_pylist(), float).reshape(rows.num_rows, -1 if rows.num_rows else 1)
        model = fit(x, rows.column("y").to_numpy())

        def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, data, offs in pieces(batches):
                yield table(key=batch.column("key"), held_out=batch.column("held_out"), score=model.score(statistics(data, offs)))

        marked = keyed.select("key", (fold_of(F.col("id_text"), folds) == held).alias("held_out"), "text")
        return marked.mapInArrow(apply, "key long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))

    return by_key(docs, work)
