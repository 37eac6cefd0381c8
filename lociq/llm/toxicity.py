"""Toxic passages by maximum-scoring segment search over token log-odds.

Token log-odds of toxic against clean documents come from a labelled sample with Dirichlet priors in two
levels: a word's prior is its prefix (first four bytes), and the prefix's prior the whole sample, so rare and unseen words
lean on their stem. Less a drift, scores are negative on clean text, and a linear scan finds all maximal
scoring segments. Segment scores of clean text follow an extreme-value law; its decay is the root of
E[exp(decay * score)] = 1 over clean tokens and its scale is fitted to clean documents' best segments.
A document's best and summed normalised scores are calibrated to a probability.

labels, lang, source and doc_id are no inputs of a score. Null, empty or wordless text: no segment, score of none.
Very long texts: scanned whole, in one row. Ties: of segments with equal scores the earlier one; of several labels of
a document the largest. Repeated rows: each is scored.
Null and repeated doc_ids: see by_key. No labelled rows: every score is 0. Empty table: empty result.
Other columns of the input are not touched.
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
from lociq.llm.text import KeyCounter, lower, pieces, span_hash, table, word_spans

PREFIX = 4


def _tokens(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hash, prefix hash, row, start and end of all words, lower-cased; 62-bit hashes."""
    data = lower(data)
    starts, ends, row = word_spans(data, offs)
    size = ends - starts
    return (span_hash(data, starts, size) >> np.uint64(2)).astype(np.int64), (span_hash(data, starts, np.minimum(size, PREFIX)) >> np.uint64(2)).astype(np.int64), row, starts, ends


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, last + 1, score), in linear time (Ruzzo and Tompa)."""
    total = np.concatenate([[0.0], np.cumsum(scores)])
    found: list[tuple[int, int, float, float, int]] = []  # first, end, sum before, sum at end, nearest earlier segment with a smaller sum before
    for i in np.flatnonzero(scores > 0).tolist():
        first, end, low, high = i, i + 1, total[i], total[i + 1]
        j = len(found) - 1
        while True:
            while j >= 0 and found[j][2] >= low:
                j = found[j][4]
            if j < 0 or found[j][3] >= high:
                found.append((first, end, low, high, j))
                break
            first, low, before = found[j][0], found[j][2], found[j][4]
            del found[j:]
            j = before
    return [(f, e, h - lo) for f, e, lo, h, _ in found]


@dataclass
class Model:
    words: np.ndarray
    word_score: np.ndarray
    prefixes: np.ndarray
    prefix_score: np.ndarray
    other: float
    decay: float = 1.0
    scale: float = 1.0
    weights: np.ndarray | None = None

    def scores(self, word: np.ndarray, prefix: np.ndarray) -> np.ndarray:
        out = np.full(len(word), self.other)
        for keys, values, of in ((self.prefixes, self.prefix_score, prefix), (self.words, self.word_score, word)):
            if len(keys):
                place = np.minimum(np.searchsorted(keys, of), len(keys) - 1)
                hit = keys[place] == of
                out[hit] = values[place[hit]]
        return out

    def figures(self, scores: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, list[list[tuple[int, int, float, float]]]]:
        """Best raw segment score and token count of each row, and its segments with their normalised scores."""
        at = np.searchsorted(row, np.arange(rows + 1))
        best, size, all_found = np.zeros(rows), np.diff(at), []
        for r in np.unique(row[scores > 0]).tolist():
            found = segments(scores[at[r] : at[r + 1]])
            best[r] = max(x[2] for x in found)
            log_kn = np.log(max(self.scale * size[r], 1e-300))
            all_found.append((r, [(f, e, s, self.decay * s - log_kn) for f, e, s in found]))
        table_ = [[] for _ in range(rows)]
        for r, found in all_found:
            table_[r] = found
        return best, size, table_


def _features(best: np.ndarray, size: np.ndarray, found: list[list[tuple[int, int, float, float]]], model: Model) -> np.ndarray:
    top = np.array([max((x[3] for x in f), default=-10.0) for f in found]) if found else np.zeros(0)
    total = np.array([sum(x[3] for x in f if x[3] > 0) for f in found]) if found else np.zeros(0)
    return np.column_stack([np.clip(top, -10, 40), np.log1p(total)])


def log_odds(toxic: np.ndarray, clean: np.ndarray, prior_toxic: np.ndarray, strength: float, odds: float) -> np.ndarray:
    return np.log((toxic + strength * prior_toxic) / (clean + strength * (1 - prior_toxic))) - odds


def learn(sample: DataFrame, drift: float = 1.0, strength: float = 10.0, prefix_strength: float = 50.0, least: int = 3) -> Model | None:
    """Fit the model on the sample (key, text, y); words met fewer than `least` times keep their prefix's score."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [[KeyCounter(), KeyCounter()] for _ in range(2)]
        for batch, data, offs in pieces(batches):
            word, prefix, row, _, _ = _tokens(data, offs)
            y = batch.column("y").to_numpy()[row]
            for kind, keys in enumerate((word, prefix)):
                for label in (0, 1):
                    held[kind][label].add(keys[y == label])
                    if held[kind][label].full():
                        held[kind][label].merge()
        for kind in (0, 1):
            for label in (0, 1):
                for k, n in held[kind][label].take():
                    yield table(kind=np.full(len(k), kind, np.int32), key=k, toxic=n if label else np.zeros_like(n), clean=np.zeros_like(n) if label else n)

    counts = sample.select("text", "y").mapInArrow(count, "kind int, key long, toxic long, clean long").groupBy("kind", "key").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))

    def prefixes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for _, data, offs in pieces(batches):
            word, prefix, *_ = _tokens(data, offs)
            keys, first = np.unique(word, return_index=True)
            yield table(key=keys, prefix=prefix[first])

    often = counts.filter(f"kind = 1 OR toxic + clean >= {least}")
    links = sample.select("text").mapInArrow(prefixes_of, "key long, prefix long").groupBy("key").agg(F.first("prefix").alias("prefix"))
    got = often.join(links, "key", "left").select("kind", "key", "toxic", "clean", F.coalesce("prefix", F.lit(0)).alias("prefix")).toArrow()  # bounded by the sample
    kind, key, toxic, clean, prefix = (got.column(c).to_numpy() for c in ("kind", "key", "toxic", "clean", "prefix"))
    p, w = kind == 1, kind == 0
    n_toxic, n_clean = toxic[p].sum(), clean[p].sum()
    if not n_toxic or not n_clean:
        return None
    share, odds = n_toxic / (n_toxic + n_clean), np.log(n_toxic / n_clean)
    order = np.argsort(key[p])
    prefixes, pt, pc = key[p][order], toxic[p][order], clean[p][order]
    prefix_score = log_odds(pt, pc, np.full(len(pt), share), prefix_strength, odds)
    prefix_share = (pt + prefix_strength * share) / (pt + pc + prefix_strength)
    order = np.argsort(key[w])
    words, wt, wc, wp = (x[w][order] for x in (key, toxic, clean, prefix))
    word_score = log_odds(wt, wc, prefix_share[np.searchsorted(prefixes, wp)], strength, odds) if len(words) else np.zeros(0)
    model = Model(words, word_score - drift, prefixes, prefix_score - drift, -drift)

    # Decay of the extreme-value law: the positive root of E[exp(decay * score)] = 1 over clean tokens.
    values, weights = np.concatenate([model.word_score, model.prefix_score]), np.concatenate([wc, np.maximum(pc - np.bincount(np.searchsorted(prefixes, wp), wc, len(prefixes)), 0)]) / n_clean
    low, high = 1e-3, 50.0
    for _ in range(200):
        model.decay = (low + high) / 2
        low, high = (low, model.decay) if np.log(np.maximum((weights * np.exp(np.minimum(model.decay * values, 700))).sum(), 1e-300)) > 0 else (model.decay, high)

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offs in pieces(batches):
            word, prefix, row, _, _ = _tokens(data, offs)
            best, size, found = model.figures(model.scores(word, prefix), row, len(offs) - 1)
            yield table(y=batch.column("y"), best=best, size=size, all=pa.array([[x[2] for x in f] for f in found], pa.list_(pa.float64())))

    rows = sample.select("text", "y").mapInArrow(summarise, "y int, best double, size long, all array<double>").toArrow()  # bounded by the sample
    y, best, size = (rows.column(c).to_numpy() for c in ("y", "best", "size"))
    use = (y == 0) & (size > 0)
    model.scale = float(use.sum() / max((size[use] * np.exp(-model.decay * best[use])).sum(), 1e-300)) if use.any() else 1.0
    found = [[(0, 0, s, model.decay * s - np.log(max(model.scale * n, 1e-300))) for s in x] for x, n in zip(rows.column("all").to_pylist(), size.tolist())]
    model.weights = logistic(_features(best, size, found, model), y.astype(float))
    return model


def passages(docs: DataFrame, model: Model) -> DataFrame:
    """(key, held_out, score, passages) of docs (key, held_out, text): the calibrated probability and the significant passages (first word, words, score, expected number in clean text)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("first_word", pa.int64()), ("words", pa.int64()), ("score", pa.float64()), ("expected", pa.float64())]))
        for batch, data, offs in pieces(batches):
            word, prefix, row, _, _ = _tokens(data, offs)
            best, size, found = model.figures(model.scores(word, prefix), row, len(offs) - 1)
            shown = [[{"first_word": f, "words": e - f, "score": s, "expected": float(np.exp(-min(z, 700)))} for f, e, s, z in x if z > 0] for x in found]
            yield table(key=batch.column("key"), held_out=batch.column("held_out"), score=probability(_features(best, size, found, model), model.weights), passages=pa.array(shown, kind))

    return docs.select("key", "held_out", "text").mapInArrow(work, "key long, held_out boolean, score double, passages array<struct<first_word:long,words:long,score:double,expected:double>>")


def toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 3, held: int = 1, threshold: float = 0.7, limit: int = 40_000) -> DataFrame:
    """One row a document: doc_id, held_out, score, predicted, passages. Fits on at most `limit` labelled rows."""

    def work(keyed: DataFrame) -> DataFrame:
        model = learn(labelled_sample(keyed, labels, label, folds, held, limit))
        marked = keyed.select("key", (fold_of(F.col("id_text"), folds) == held).alias("held_out"), "text")
        if model is None:
            empty = F.array().cast("array<struct<first_word:bigint,words:bigint,score:double,expected:double>>")
            return marked.select("key", "held_out", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"), empty.alias("passages"))
        return passages(marked, model).select("key", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "passages")

    return by_key(docs, work)
