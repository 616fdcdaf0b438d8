"""Quality classifier: random Fourier features, ridge by summed normal equations, isotonic scores."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adledger.session import durable

FOURIER_DIM = 256
RIDGE = 1e-2
CALIBRATION_BINS = 1000
MERGE_GROUPS = 16
THRESHOLD = 0.3
CLIP = 5.0
STATISTICS = (
    "log_chars", "log_words", "mean_word", "long_words", "upper", "digits", "marks", "exclaim", "bars",
    "hash_like", "line_rate", "distinct_words", "top_word", "repeated_next", "distinct_lines", "top_line",
    "marked_words", "upper_words",
)


def statistics(text: str) -> list[float]:
    """Numbers that describe the form of a whole text; all zero for an empty one."""
    raw = text.encode("utf-8", "replace")
    n = len(raw)
    if not n:
        return [0.0] * len(STATISTICS)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    upper, lower = counts[65:91].sum(), counts[97:123].sum()
    space = counts[[9, 10, 11, 12, 13, 32]].sum()
    digits = counts[48:58].sum()
    marks = counts[33:127].sum() - upper - lower - digits
    words = raw.split()
    w = len(words)
    tally = Counter(words)
    lines = raw.split(b"\n")
    line_tally = Counter(lines)
    again = sum(map(bytes.__eq__, words, words[1:]))
    long_words = sum(c for x, c in tally.items() if len(x) > 20)
    alnum_end = sum(c for x, c in tally.items() if x[-1] in b"#&%$*!|")
    shouted = sum(c for x, c in tally.items() if len(x) > 1 and x.isupper())
    per = 1.0 / max(1, w)
    return [
        float(np.log1p(n)), float(np.log1p(w)), (n - space) * per, long_words * per,
        upper / max(1, upper + lower), digits / n, marks / n, counts[33] / n, counts[124] / n,
        counts[[35, 36, 37, 38, 42]].sum() / n, len(lines) * per, len(tally) * per,
        max(tally.values(), default=0) * per, again * per, len(line_tally) / len(lines),
        max(line_tally.values()) / len(lines), alnum_end * per, shouted * per,
    ]


def statistics_table(docs: DataFrame) -> DataFrame:
    """(doc_id, x array<double>) for every row, null text as empty; one pass over the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [statistics(t.as_py() or "") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, x array<double>")


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the decimal id, modulo; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


@dataclass
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    frequencies: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -CLIP, CLIP)
        return np.sqrt(2.0 / len(self.phases)) * np.cos(z @ self.frequencies + self.phases)

    def raw(self, x: np.ndarray) -> np.ndarray:
        z = self.features(x)
        return z @ self.weights[:-1] + self.weights[-1]

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), self.knots, self.values)


def _summed(parts: DataFrame) -> np.ndarray | None:
    """Sum of equally long double vectors, merged in two steps; the driver gets one."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for cell in batch.column(0):
                v = np.frombuffer(cell.as_py())
                total = v.copy() if total is None else total + v
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["v"])

    for groups in (MERGE_GROUPS, 1):
        parts = parts.repartition(groups).mapInArrow(add, "v binary")
    row = parts.first()
    return None if row is None else np.frombuffer(row.v)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=float).reshape(len(column), len(STATISTICS))


def isotonic(knots: np.ndarray, n: np.ndarray, ones: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over sorted bins: (mean knot, mean label) of the pooled blocks."""
    blocks: list[list[float]] = []
    for k, c, y in zip(knots, n, ones, strict=True):
        blocks.append([k * c, float(c), float(y)])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][1] >= blocks[-1][2] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    return np.array([b[0] / b[1] for b in blocks]), np.array([b[2] / b[1] for b in blocks])


def fit(stats: DataFrame, labels: DataFrame, modulus: int = 5, held_out: int = 0, calibration: int = 1,
        dim: int = FOURIER_DIM, ridge: float = RIDGE, seed: int = 11) -> QualityModel:
    """Model from labelled statistics rows whose id remainder is not ``held_out``.

    The ridge is fitted on the remainders other than ``calibration``, the isotonic map on
    that one. What reaches the driver: means, a (dim+1)^2 matrix and at most
    ``CALIBRATION_BINS`` bins, at any input size. Labels repeated for an id count as their
    largest; null ids or labels are left out. Without labels every score is 0.5.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1))
    known = known.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max("quality").cast("int").alias("y"))
    fold = remainder(F.col("doc_id"), modulus)
    rows = durable(stats.join(known.where(fold != held_out), "doc_id").select("doc_id", "x", "y", fold.alias("fold")))
    size = len(STATISTICS)
    rng = np.random.default_rng(seed)
    first = rows.select(*[F.avg(F.col("x")[i]) for i in range(size)], *[F.stddev_pop(F.col("x")[i]) for i in range(size)]).first()
    blank = first[0] is None
    mean = np.zeros(size) if blank else np.array(first[:size], dtype=float)
    scale = np.ones(size) if blank else np.array([s if s and s > 1e-9 else 1.0 for s in first[size:]], dtype=float)
    model = QualityModel(
        mean, scale, rng.normal(size=(size, dim)) / np.sqrt(size / 2), rng.uniform(0, 2 * np.pi, dim), np.zeros(dim + 1),
        np.array([0.0]), np.array([0.5]),
    )
    if blank:
        return model

    def normal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                z = np.hstack([model.features(_matrix(part.column(0))), np.ones((part.num_rows, 1))])
                y = np.asarray(part.column(1), dtype=float)
                v = np.concatenate([(z.T @ z).ravel(), z.T @ y])
                total = v if total is None else total + v
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["v"])

    fitting = rows.where(F.col("fold") != calibration)
    sums = _summed(fitting.select("x", "y").mapInArrow(normal, "v binary"))
    if sums is None:
        return model
    d = dim + 1
    gram, right = sums[: d * d].reshape(d, d), sums[d * d:]
    penalty = ridge * np.eye(d) * max(1.0, gram[-1, -1]) / dim
    penalty[-1, -1] = 0.0
    model.weights = np.linalg.solve(gram + penalty + 1e-9 * np.eye(d), right)

    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(model.raw(_matrix(batch.column(0)))), batch.column(1)], ["r", "y"])

    scored = rows.where(F.col("fold") == calibration).select("x", "y").mapInArrow(raw, "r double, y int")
    width = 2.0 / CALIBRATION_BINS
    bins = (
        scored.groupBy(F.floor(F.greatest(F.lit(-0.5), F.least(F.lit(1.5), F.col("r"))) / width).alias("b"))
        .agg(F.avg("r").alias("r"), F.count("*").alias("n"), F.sum("y").alias("ones")).orderBy("b").collect()
    )
    if bins:
        model.knots, model.values = isotonic(*[np.array([float(b[c]) for b in bins]) for c in ("r", "n", "ones")])
    return model


def score_statistics(stats: DataFrame, model: QualityModel) -> DataFrame:
    """(doc_id, score) from a statistics table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = model.score(_matrix(batch.column(1))) if batch.num_rows else np.array([])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64())], ["doc_id", "score"])

    return stats.select("doc_id", "x").mapInArrow(run, "doc_id bigint, score double")


def score_documents(docs: DataFrame, labels: DataFrame, modulus: int = 5, held_out: int = 0,
                    threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``.

    Inputs of a score are the text's statistics alone. Null and empty texts score as the
    all-zero statistics; a null doc_id is never labelled and not held out. Other columns
    are ignored; an empty table gives an empty result.
    """
    stats = durable(statistics_table(docs))
    model = fit(stats, labels, modulus, held_out)
    scored = score_statistics(stats, model)
    out = F.coalesce(remainder(F.col("doc_id"), modulus) == held_out, F.lit(False))
    return scored.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``, columns unchanged.

    The decision is made where the row is, so no text is shuffled."""
    model = fit(durable(statistics_table(docs)), labels)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.array([statistics(t.as_py() or "") for t in batch.column(at)])
                yield batch.filter(pa.array(model.score(x) >= threshold))

    return docs.mapInArrow(run, docs.schema)
