"""Quality scores: random Fourier features over document statistics, ridge regression, isotonic calibration.

A pass over the texts gives each document a short vector of statistics. Random cosines of the
standardised vector approximate a Gaussian kernel; ridge weights come from normal equations that every
partition sums for its own rows. Raw scores are then calibrated by a non-decreasing step function,
fitted on a histogram of training scores, to the probability of label 1.

Training uses every labelled row outside the held-out fold. What reaches the driver is bounded by the
number of features and histogram bins, whatever the input.

Defined results: a null text counts as empty and is scored as such; a repeated row gets a row each and
counts as often in training; several labels of one document count as their mean; a null doc_id is scored
but never trained on; without any label every score is 0.5; an empty table gives no rows; extra columns
are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeframe.llm import arrays
from tapeframe.session import staged

#: Statistics of a document, in the order of the vector.
STATISTICS = (
    "log_chars", "mean_word", "letters", "digits", "upper", "marks", "symbols", "spaces", "mixed_words",
    "mark_heavy_words", "distinct_words", "top_word", "top_byte", "repeated_pairs", "repeated_lines", "line_words",
)


@dataclass(frozen=True)
class QualityConfig:
    features: int = 192  #: random cosines
    width: float = 4.0  #: of the Gaussian kernel, in standard deviations
    ridge: float = 1e-3  #: per training row
    bins: int = 2000  #: of the calibration histogram over raw scores in [-0.5, 1.5]
    seed: int = 7


_KIND = np.zeros(256, np.int64)
for _b in range(256):
    _c = chr(_b)
    _KIND[_b] = (1 if _b >= 128 or _c.islower() else 2 if _c.isupper() else 3 if _c.isdigit() else 4 if _b == 32 or 9 <= _b <= 13
                 else 5 if _c in ".,;:'\"?-()" else 6)


def _shares(values: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per row: number of values, of distinct values, and the count of the most frequent one."""
    order = np.lexsort((values, rows))
    v, r = values[order], rows[order]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (r[1:] != r[:-1])
    at = np.flatnonzero(new)
    times = np.diff(np.append(at, len(v)))
    top = np.zeros(n, np.int64)
    np.maximum.at(top, r[at], times)
    return np.bincount(rows, minlength=n), np.bincount(r[at], minlength=n), top


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of ``STATISTICS`` per text."""
    raw, at = arrays.buffers(texts)
    n = len(texts)
    size = np.diff(at)
    row = np.repeat(np.arange(n), size)
    kinds = _KIND[raw]
    by_kind = np.bincount(row * 8 + kinds, minlength=8 * n).reshape(n, 8).astype(float)
    chars = np.maximum(1, size)[:, None]
    share = by_kind / chars
    top_byte = np.bincount(row * 256 + raw, minlength=256 * n).reshape(n, 256)[:, 33:].max(1) if n else np.zeros(0)
    owner, start, end = arrays.spans(raw, at, arrays.NOT_SPACE)
    marks = np.concatenate([[0], np.cumsum(kinds >= 5)])
    letters = np.concatenate([[0], np.cumsum(kinds <= 2)])
    inside, word_letters = marks[end] - marks[start], letters[end] - letters[start]
    words = np.bincount(owner, minlength=n)
    some = np.maximum(1, words)
    key = arrays.span_hashes(raw, start, end)
    _, distinct, top_word = _shares(key, owner, n)
    same = owner[1:] == owner[:-1]
    with np.errstate(over="ignore"):
        pair = arrays.mix(key[:-1] * np.uint64(3) + key[1:])[same]
    pairs, distinct_pairs, _ = _shares(pair, owner[:-1][same], n)
    line_of, line_start, line_end = arrays.spans(raw, at, np.arange(256) != 10)
    lines, distinct_lines, _ = _shares(arrays.span_hashes(raw, line_start, line_end), line_of, n)
    mean_word = (by_kind[:, 1:4].sum(1) + by_kind[:, 5:7].sum(1)) / some
    return np.column_stack([
        np.log1p(size), np.log1p(mean_word), share[:, 1] + share[:, 2], share[:, 3], share[:, 2], share[:, 5], share[:, 6],
        share[:, 4], np.bincount(owner, (inside > 1) & (word_letters > 0), minlength=n) / some,
        np.bincount(owner, inside > word_letters, minlength=n) / some, distinct / some, top_word / some, top_byte / chars[:, 0],
        1 - distinct_pairs / np.maximum(1, pairs), 1 - distinct_lines / np.maximum(1, lines),
        np.log1p(words / np.maximum(1, lines)),
    ]) if n else np.zeros((0, len(STATISTICS)))


def document_statistics(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and its vector of statistics (binary float64)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrays.parts(batches, 1):
            texts = arrays.plain_texts(batch.column(1))
            for i, j in arrays.slices(texts):
                found = statistics(texts[i:j])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[i:j], pa.array([v.tobytes() for v in found], pa.binary())], names=["doc_id", "v"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(
        run, "doc_id long, v binary")


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_py() for x in column), np.float64).reshape(-1, width)


def _summed(df: DataFrame, values, width: int) -> np.ndarray | None:
    """Add up ``values(batch)`` (float64 of one shape) over all rows of ``df``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = None
        for batch in batches:
            if len(batch):
                v = values(batch)
                total = v if total is None else total + v
        if total is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["shard", "v"])

    out = arrays.merge_sums(df.mapInArrow(run, "shard int, v binary"), []).collect()
    return np.frombuffer(bytes(out[0].v), np.float64).reshape(-1, width) if out else None


@dataclass
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    frequencies: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    edges: np.ndarray  #: raw scores at which the calibrated value is given
    levels: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        wave = np.sqrt(2 / len(self.phases)) * np.cos(z @ self.frequencies + self.phases)
        return np.column_stack([np.ones(len(x)), wave])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), self.edges, self.levels)


def isotonic(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The non-decreasing sequence nearest to ``values`` in weighted squares (pool adjacent violators)."""
    level, weight, count = [], [], []
    for v, w in zip(values.tolist(), weights.tolist(), strict=True):
        level.append(v)
        weight.append(w)
        count.append(1)
        while len(level) > 1 and level[-2] >= level[-1]:
            w2 = weight[-2] + weight[-1]
            level[-2:] = [(level[-2] * weight[-2] + level[-1] * weight[-1]) / w2]
            weight[-2:] = [w2]
            count[-2:] = [count[-2] + count[-1]]
    return np.repeat(level, count)


def fit(labelled: DataFrame, config: QualityConfig = QualityConfig()) -> QualityModel | None:
    """A model from rows (v binary, y double); None if there are none."""
    d, k = len(STATISTICS), config.features
    moments = _summed(labelled, lambda b: np.stack([(x := _matrix(b.column(0), d)).sum(0), (x * x).sum(0), np.full(d, float(len(x)))]), d)
    if moments is None:
        return None
    total, square, n = moments
    mean = total / n
    deviation = np.sqrt(np.maximum(square / n - mean * mean, 0))
    random = np.random.default_rng(config.seed)
    model = QualityModel(mean, np.where(deviation > 1e-9, deviation, 1.0), random.normal(size=(d, k)) / config.width,
                         random.uniform(0, 2 * np.pi, k), np.zeros(k + 1), np.array([0.0, 1.0]), np.array([0.0, 1.0]))

    def normal(batch: pa.RecordBatch) -> np.ndarray:
        z = model.features(_matrix(batch.column(0), d))
        y = batch.column(1).to_numpy()
        return np.vstack([z.T @ z, y @ z])

    equations = _summed(labelled, normal, k + 1)
    penalty = np.eye(k + 1) * config.ridge * n[0]
    penalty[0, 0] = 0
    model.weights = np.linalg.solve(equations[:-1] + penalty + 1e-9 * np.eye(k + 1), equations[-1])
    grid = np.linspace(-0.5, 1.5, config.bins + 1)

    def histogram(batch: pa.RecordBatch) -> np.ndarray:
        s, y = model.raw(_matrix(batch.column(0), d)), batch.column(1).to_numpy()
        at = np.clip(np.searchsorted(grid, s, "right") - 1, 0, config.bins - 1)
        return np.stack([np.bincount(at, minlength=config.bins), np.bincount(at, y, config.bins), np.bincount(at, s, config.bins)])

    count, ones, scores = _summed(labelled, histogram, config.bins)
    full = count > 0
    model.edges = scores[full] / count[full]
    model.levels = np.clip(isotonic(ones[full] / count[full], count[full]), 0, 1)
    return model


def held_out(doc_id: str, folds: int = 5) -> F.Column:
    """Whether crc32 of the id as text falls into the fold that is never trained on."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % folds == 0, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, config: QualityConfig = QualityConfig(), doc_id: str = "doc_id", text: str = "text",
          label: str = "quality") -> tuple[DataFrame, QualityModel | None]:
    """(statistics of every row, stored; the model of the labelled rows outside the held-out fold)."""
    stats = staged(document_statistics(docs, doc_id, text), "quality")
    marks = (labels.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(label).cast("double").alias("y"))
             .where(F.col("doc_id").isNotNull() & F.col("y").isNotNull()).groupBy("doc_id").agg(F.avg("y").alias("y")))
    labelled = staged(stats.where(~held_out("doc_id")).join(marks, "doc_id").select("v", "y"), "quality-labelled")
    return stats, fit(labelled, config)


def _scores(model: QualityModel | None, x: np.ndarray) -> np.ndarray:
    return np.full(len(x), 0.5) if model is None else model.score(x)


def score(docs: DataFrame, labels: DataFrame, config: QualityConfig = QualityConfig(), doc_id: str = "doc_id", text: str = "text",
          label: str = "quality", threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``docs``."""
    stats, model = learn(docs, labels, config, doc_id, text, label)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = _scores(model, _matrix(batch.column(2), len(STATISTICS)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(s), pa.array((s >= threshold).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"])

    return stats.select("doc_id", held_out("doc_id").alias("held_out"), "v").mapInArrow(
        run, "doc_id long, held_out boolean, score double, predicted int")


def clean(docs: DataFrame, labels: DataFrame, config: QualityConfig = QualityConfig(), doc_id: str = "doc_id", text: str = "text",
          label: str = "quality", threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, with all their columns.

    Scores are computed beside the text, so no text is shuffled.
    """
    _, model = learn(docs, labels, config, doc_id, text, label)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrays.parts(batches, at):
            texts = arrays.plain_texts(batch.column(at))
            parts = [_scores(model, statistics(texts[i:j])) for i, j in arrays.slices(texts)]
            yield batch.filter(pa.array(np.concatenate(parts) >= threshold)) if parts else batch

    return docs.mapInArrow(run, docs.schema)
