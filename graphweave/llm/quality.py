"""Quality classifier: random Fourier features, ridge by normal equations, isotonic calibration.

Statistics of each whole text are standardised and mapped to random Fourier features, which
approximate a Gaussian kernel; the normal equations of ridge regression are summed by partition
(their size depends on the number of features alone) and solved once; a step function fitted by
pooling adjacent violators over a histogram of scores turns them into probabilities. Two additions
to the plain method: the statistics themselves and a constant stand beside the Fourier features,
so that the kernel need only fit what a straight line leaves; and a logistic curve of the raw score
makes up ``CURVE`` of the result, so that scores still rise within a step of the isotonic fit.

Defined results: null and empty texts have the statistics of an empty text and are scored like
any other; equal texts get equal scores; an empty table gives no rows; with nothing to learn from
every score is 0.5.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphweave.llm import common

FEATURES, RIDGE, SEED = 256, 1e-3, 11
THRESHOLD = 0.3
CURVE = 0.02
#: Bound on the labelled rows that are learned from; above it, a hash of the id picks about so many.
TRAIN_ROWS = 20_000
BINS = 400
BYTE_CLASSES = (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"!?", b"#$%&*@^~<>{}[]\\/_=+", b"|", b".,;:", b"\n", b" \t")


def statistics(text: str) -> list[float]:
    data = text.encode("utf-8", "surrogatepass")
    words = text.split()
    size, n = max(1, len(data)), max(1, len(words))
    counts = [(len(data) - len(data.translate(None, members))) for members in BYTE_CLASSES]
    shares = [c / size for c in counts]
    lines = [line for line in text.split("\n") if line]
    return [
        *[s**0.5 for s in shares],
        np.log1p(len(data)),
        np.log1p(len(words)),
        len(data) / n / 10 if words else 0.0,
        len(set(words)) / n,
        len(set(words)) / n**0.75,
        sum(map(operator.eq, words, words[1:])) / n,
        len(set(lines)) / max(1, len(lines)),
        len(lines) / n,
        (counts[2] + counts[3] + counts[4]) / n,
        counts[0] / n,
    ]


WIDTH = len(statistics(""))


@dataclass
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phase: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    levels: np.ndarray

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return fourier(standard(stats, self.mean, self.scale), self.directions, self.phase) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        """Calibrated, and still rising with the raw score within a level."""
        raw = self.raw(stats)
        steps = np.interp(raw, self.knots, self.levels)
        return np.clip((1 - CURVE) * steps + CURVE / (1 + np.exp(-4 * (raw - 0.5))), 0.0, 1.0)


def standard(stats: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Within a few deviations, so that no text is far from all that were learned from."""
    return np.clip((stats - mean) / scale, -5.0, 5.0)


def fourier(x: np.ndarray, directions: np.ndarray, phase: np.ndarray) -> np.ndarray:
    waves = np.cos(x @ directions + phase) * np.sqrt(2 / directions.shape[1])
    return np.hstack([waves, x, np.ones((len(x), 1))])


def pooled(scores: np.ndarray, weight: np.ndarray, positive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression over ascending ``scores``: pool adjacent violators."""
    blocks: list[list[float]] = []
    for s, w, p in zip(scores, weight, positive):
        blocks.append([s, s, w, p])
        while len(blocks) > 1 and blocks[-2][3] * blocks[-1][2] >= blocks[-1][3] * blocks[-2][2]:
            first, last, w1, p1 = blocks.pop()
            blocks[-1][1:] = [last, blocks[-1][2] + w1, blocks[-1][3] + p1]
    knots = np.array([x for b in blocks for x in b[:2]])
    return knots, np.repeat([(b[3] + 0.5) / (b[2] + 1) for b in blocks], 2)


def _stats_of(texts: list[str]) -> np.ndarray:
    return np.array([statistics(t) for t in texts], float).reshape(-1, WIDTH)


def train(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality", rows: int = TRAIN_ROWS) -> QualityModel | None:
    """Learns ``label`` (0 or 1) of ``labels`` from the texts of ``docs``; None if there is nothing to learn.

    The labelled ids are bounded by ``rows``, so they are broadcast. Where a document has several labels its least counts.
    """
    spark = docs.sparkSession
    common.bounded_batches(spark)
    known = labels.select(F.col(key).alias("key"), F.col(label).cast("double").alias("y")).where("key is not null and y is not null")
    share = min(1.0, rows / max(1, known.count()))
    known = known.where(F.pmod(F.xxhash64("key"), F.lit(1_000_003)) < int(share * 1_000_003)).groupBy("key").agg(F.min("y").alias("y"))
    joined = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(known), "key")

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"key": batch["key"], "y": batch["y"], "stats": pd.Series(list(_stats_of(common.texts_of(batch["text"]))), dtype=object)})

    seen = common.materialize(joined.mapInPandas(common.tidied(measure), "key bigint, y double, stats array<double>"), "quality-train")

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(2 * WIDTH + 1)
        for batch in batches:
            x = np.vstack(batch["stats"]) if len(batch) else np.zeros((0, WIDTH))
            total += np.concatenate([x.sum(axis=0), (x * x).sum(axis=0), [len(x)]])
        yield pd.DataFrame({"part": [0], "sums": [total.tobytes()]})

    def add(group: pd.DataFrame) -> pd.DataFrame:
        return group.iloc[:1].assign(sums=[sum(np.frombuffer(x) for x in group["sums"]).tobytes()])

    def summed(frame: DataFrame, function, width: int) -> np.ndarray:
        parts = frame.mapInPandas(common.tidied(function), "part int, sums binary").groupBy("part").applyInPandas(add, "part int, sums binary").orderBy("part").collect()
        return np.concatenate([np.frombuffer(bytes(r["sums"])) for r in parts]) if parts else np.zeros(width)

    sums = summed(seen, moments, 2 * WIDTH + 1)
    if not sums[-1]:
        return None
    mean = sums[:WIDTH] / sums[-1]
    scale = np.sqrt(np.maximum(sums[WIDTH:-1] / sums[-1] - mean**2, 1e-6))
    rng = np.random.default_rng(SEED)
    directions = rng.normal(size=(WIDTH, FEATURES)) * np.sqrt(1 / WIDTH)
    phase = rng.uniform(0, 2 * np.pi, FEATURES)
    dim = FEATURES + WIDTH + 1
    fitting = F.crc32(F.concat(F.col("key").cast("string"), F.lit("c"))) % 4 != 0

    def normal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((dim, dim + 1))
        for batch in batches:
            if len(batch):
                z = fourier(standard(np.vstack(batch["stats"]), mean, scale), directions, phase)
                total += z.T @ np.column_stack([z, batch["y"].to_numpy()])
        for k in range(0, dim, 64):
            yield pd.DataFrame({"part": [k], "sums": [total[k : k + 64].tobytes()]})

    both = summed(seen.where(fitting), normal, dim * (dim + 1)).reshape(dim, dim + 1)
    gram, target = both[:, :-1], both[:, -1]
    weights = np.linalg.solve(gram + RIDGE * max(1.0, np.trace(gram) / dim) * np.eye(dim), target)
    model = QualityModel(mean, scale, directions, phase, weights, np.array([0.0, 1.0]), np.array([0.0, 1.0]))

    def binned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            raw = model.raw(np.vstack(batch["stats"])) if len(batch) else np.zeros(0)
            yield pd.DataFrame({"bin": np.clip(np.round(raw * BINS / 2), -BINS, 2 * BINS).astype(int), "y": batch["y"]})

    rest = seen.where(~fitting).mapInPandas(common.tidied(binned), "bin int, y double").groupBy("bin").agg(F.count("*").alias("n"), F.sum("y").alias("p")).orderBy("bin").collect()
    if rest:
        model.knots, model.levels = pooled(np.array([r["bin"] * 2 / BINS for r in rest]), np.array([r["n"] for r in rest], float), np.array([r["p"] for r in rest]))
    return model


def score(docs: DataFrame, model: QualityModel | None, text: str = "text", keep: tuple[str, ...] = ("doc_id",), threshold: float = THRESHOLD) -> DataFrame:
    """The columns ``keep`` with ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` on)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def results(texts: list[str | None]) -> list[pa.Array]:
        stats = _stats_of(common.texts_of(texts))
        return [pa.array(shared.value.score(stats) if shared.value else np.full(len(texts), 0.5))]

    scored = common.with_results(docs, text, [c for c in keep if c != "predicted"], {"score": "double"}, lambda: results)
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = common.table(spark, sf_dir, "labels").select("doc_id", "quality")
    model = train(docs.where(common.learns()), labels.where(common.learns()))
    return score(docs.withColumn("held_out", common.held_out()), model, keep=("doc_id", "held_out"))
