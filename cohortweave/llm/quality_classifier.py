"""Quality scores: random Fourier features, ridge by partition-summed normal equations, isotonic calibration.

Statistics of the labelled documents are cut to a table. A Gaussian kernel over
the standardised statistics is approximated by cosines of random projections; each partition sums
its part of the normal equations, and the driver adds and solves those fixed-size sums. Ridge
scores are mapped to probabilities by isotonic regression on rows that the fit has not seen.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F

from cohortweave.llm.quality_rules import MEASURES, measure
from cohortweave.llm.rows import map_texts, slices
from cohortweave.llm.storage import Scope, cut, small_side
from cohortweave.llm.words import _WS

STATS = ("words", "chars_per_word", "symbols", "duplicate_lines", "repeated", "line_words", "upper", "bangs", "stutter", "digits", "marks", "non_ascii", "entropy", "spaces")
_MARK = np.zeros(256, bool)
_MARK[list(b".,;:?'\"()-")] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True


@dataclass(frozen=True)
class QualityConfig:
    features: int = 256
    width: float = 2.0
    ridge: float = 1e-3
    seed: int = 20
    #: At most about so many labelled rows are fitted on; they are taken by a hash of doc_id.
    max_fit: int = 60_000
    held_out_of: int = 5
    threshold: float = 0.3


def statistics(text: str | None) -> list[float]:
    """STATS of one whole text; zeros for a null or empty one."""
    if not text:
        return [0.0] * len(STATS)
    m = dict(zip(MEASURES, measure(text)))
    counts = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
    total = float(counts.sum())
    p = counts[counts > 0] / total
    words, lines = max(1, m["n_words"]), max(1, m["n_lines"])
    return [
        float(np.log1p(m["n_words"])),
        m["word_chars"] / words,
        min(5.0, m["n_symbols"] / words),
        m["n_dup_lines"] / lines,
        m["n_repeat_words"] / words,
        float(np.log1p(words / lines)),
        m["n_upper"] / max(1, m["n_upper"] + m["n_lower"]),
        min(5.0, m["n_bangs"] / words),
        m["n_stutter"] / words,
        counts[_DIGIT].sum() / total,
        counts[_MARK].sum() / total,
        counts[128:].sum() / total,
        float(-(p * np.log2(p)).sum()),
        counts[_WS].sum() / total,
    ]


_NAMES = tuple(f"f{i}" for i in range(len(STATS)))


def _rows(texts: list[str | None]) -> np.ndarray:
    return np.array([statistics(t) for t in texts], np.float64).reshape(len(texts), len(STATS))


def _stats():
    return lambda texts: tuple(_rows(texts).T)


def pava(y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Weighted isotonic (non-decreasing) regression of y, by pooling adjacent violators."""
    value, weight, size = [], [], []
    for a, b in zip(y.tolist(), w.tolist()):
        value.append(a)
        weight.append(b)
        size.append(1)
        while len(value) > 1 and value[-2] >= value[-1]:
            total = weight[-2] + weight[-1]
            value[-2] = (value[-2] * weight[-2] + value[-1] * weight[-1]) / total
            weight[-2] = total
            size[-2] += size[-1]
            value.pop(), weight.pop(), size.pop()
    return np.repeat(value, size)


@dataclass
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray
    b: np.ndarray
    coef: np.ndarray
    knots: np.ndarray
    levels: np.ndarray

    def lift(self, x: np.ndarray) -> np.ndarray:
        """Random Fourier features of rows of statistics, with a constant."""
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        phi = np.sqrt(2.0 / self.w.shape[1]) * np.cos(z @ self.w + self.b)
        return np.hstack([phi, np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.lift(x) @ self.coef

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), self.knots, self.levels), 0.0, 1.0)


def _matrix(batch) -> np.ndarray:
    return np.column_stack([batch.column(c).to_numpy() for c in _NAMES])


def fit(docs: DataFrame, labels: DataFrame, config: QualityConfig) -> QualityModel | None:
    """Fit on the labelled rows whose crc32(doc_id) mod held_out_of is not 0; None when there are none.

    Remainder 1 calibrates, the others fit. Several labels of one doc_id are averaged. Statistics are taken of the
    documents that are fitted on, and of no others.
    """
    crc = F.crc32(F.col("doc_id").cast("string")) % config.held_out_of
    y = labels.where("doc_id is not null and quality is not null").where(crc != 0)
    y = y.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.avg("quality").cast("double").alias("y"))
    n = y.count()
    if not n:
        return None
    if n > config.max_fit:
        share = int(config.max_fit / n * (1 << 32))
        y = y.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 32)) < share)
    y = cut(y, "quality-labels")
    some = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(y if (held := small_side(y)) is None else held, "doc_id")
    rows = map_texts(some.withColumn("calibrates", crc == 1), _stats, ", ".join(f"{c} double" for c in _NAMES), ("y", "calibrates"))
    rows = cut(rows, "quality-fit").coalesce(16)
    names = _NAMES
    moments = rows.agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m_{c}") for c in names], *[F.stddev_pop(c).alias(f"s_{c}") for c in names]).first()
    if not moments["n"]:
        return None
    rng = np.random.default_rng(config.seed)
    scale = np.array([max(moments[f"s_{c}"], 1e-6) for c in names])
    model = QualityModel(
        np.array([moments[f"m_{c}"] for c in names]), scale,
        rng.normal(0, 1 / config.width, (len(names), config.features)), rng.uniform(0, 2 * np.pi, config.features),
        np.zeros(config.features + 1), np.zeros(1), np.zeros(1),
    )
    size = config.features + 1

    def sums(batches):
        import pyarrow as pa

        a, b = np.zeros((size, size)), np.zeros(size)
        for batch in batches:
            phi = model.lift(_matrix(batch))
            a += phi.T @ phi
            b += phi.T @ batch.column("y").to_numpy()
        yield pa.RecordBatch.from_pydict({"a": [a.tobytes()], "b": [b.tobytes()]})

    some = rows.where("not calibrates")
    parts = (some if not some.isEmpty() else rows).mapInArrow(sums, "a binary, b binary").collect()
    a = sum(np.frombuffer(p["a"]).reshape(size, size) for p in parts)
    b = sum(np.frombuffer(p["b"]) for p in parts)
    model.coef = np.linalg.solve(a + config.ridge * moments["n"] * np.eye(size), b)

    def raw(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_pydict({"raw": model.raw(_matrix(batch)), "y": batch.column("y")})

    held = rows.where("calibrates")
    held = (held if not held.isEmpty() else rows).mapInArrow(raw, "raw double, y double").groupBy("raw").agg(F.avg("y").alias("y"), F.count(F.lit(1)).alias("w")).toPandas()
    held = held.sort_values("raw")
    model.knots, model.levels = held["raw"].to_numpy(), pava(held["y"].to_numpy(), held["w"].to_numpy(np.float64))
    return model


def fitted(docs: DataFrame, labels: DataFrame, config: QualityConfig) -> QualityModel | None:
    """fit, without the tables that it leaves."""
    with Scope():
        return fit(docs, labels, config)


def quality_scores(docs: DataFrame, labels: DataFrame, config: QualityConfig = QualityConfig()) -> DataFrame:
    """Score every whole text: doc_id, held_out, score (0 to 1) and predicted; one pass over the texts after the fit.

    Only text enters a score. Null and empty texts are scored from zero statistics; a null doc_id is never
    held out and never a training row; repeated rows get equal scores; an empty table gives
    an empty result. Without any usable label all scores are 0.5. A text may have any length. Further columns of docs are ignored.
    """
    model = fitted(docs, labels, config)

    def scorer():
        return lambda texts: (np.full(len(texts), 0.5) if model is None else model.score(_rows(texts)),)

    return map_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), scorer, "score double").select(
        "doc_id",
        F.coalesce(F.crc32(F.col("doc_id").cast("string")) % config.held_out_of == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= config.threshold).cast("int").alias("predicted"),
    )


def keep_quality(docs: DataFrame, labels: DataFrame, config: QualityConfig = QualityConfig()) -> DataFrame:
    """The rows of docs that score at least the threshold, with all their columns; without any usable label, all rows.

    Decisions are made row by row on the whole text, in one pass after the fit and without a join: null and empty texts by
    their zero statistics, rows with a null doc_id and repeated rows like others. Columns of any other name stay as they are.
    """
    model = fitted(docs, labels, config)
    if model is None:
        return docs
    at = docs.columns.index("text")

    def keep(batches):
        import pyarrow as pa

        for batch in batches:
            for a, b in slices(batch.column(at)):
                part = batch.slice(a, b - a)
                yield part.filter(pa.array(model.score(_rows(part.column(at).to_pylist())) >= config.threshold))

    return docs.mapInArrow(keep, docs.schema)
