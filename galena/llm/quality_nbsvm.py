"""Quality classifier: a linear hinge-loss model on n-gram indicators scaled by naive Bayes log-count ratios.

The n-grams are those of 1 to 4 bytes of a text as it is, case and marks included, hashed to a fixed number of places,
and the word pairs of one word twice, all under one name: a place for each share of the text's pairs that they reach.
A document's vector has the log-count ratio at each place that it has, divided by the root of how many it has; the model
is fitted by dual coordinate descent, and its margin is turned into a probability by a logistic curve fitted on rows of
the sample that the model has not seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galena.llm.samples import MAX_TRAIN, fit_in_one_task, held_out, labelled_sample
from galena.llm.shared import batches, small_batches

BITS, GRAMS = 18, 4
SEED = 7
#: Shares of a text's word pairs that are one word twice; each share that is reached is an indicator.
PAIR_SHARES = (0.02, 0.05, 0.1, 0.2, 0.4)
#: Bytes of a text that are hashed at once; longer texts go through in overlapping parts.
PART = 1 << 20


def hash_place(code):
    """The place of a code (or of each code of an array) by multiplicative hashing."""
    return (np.asarray(code, np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)


class Indicators:
    """Turns texts into the sorted places of their n-grams."""

    def __init__(self):
        self.seen = np.zeros(1 << BITS, dtype=bool)

    def places(self, text: bytes) -> np.ndarray:
        for at in range(0, len(text), PART):
            code = np.frombuffer(text[at : at + PART + GRAMS - 1], dtype=np.uint8).astype(np.uint64)
            gram = code
            for n in range(1, GRAMS + 1):
                if n > 1:
                    gram = (gram[:-1] << np.uint64(8)) | code[n - 1 :]
                if len(gram):
                    self.seen[hash_place(gram + np.uint64(n << 40))] = True
        words = text.split()
        same = sum(map(eq, words, islice(words, 1, None)))
        for i, share in enumerate(PAIR_SHARES):
            if same and same >= share * (len(words) - 1):
                self.seen[hash_place((GRAMS + 1 << 40) + i)] = True
        out = np.flatnonzero(self.seen)
        self.seen[out] = False
        return out.astype(np.int32)


def log_count_ratio(rows: list[np.ndarray], y: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    """log of the share of each place in the positive rows' indicators over that in the negative ones'."""
    counts = [np.bincount(np.concatenate([*(r for r, c in zip(rows, y, strict=True) if c == sign), np.empty(0, np.int32)]), minlength=1 << BITS) + smooth for sign in (1, -1)]
    return np.log(counts[0] / counts[0].sum()) - np.log(counts[1] / counts[1].sum())


def dual_coordinate_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, cost: float = 1.0, epochs: int = 8) -> np.ndarray:
    """Weights (the last is the bias) that minimise w²/2 + cost * sum of hinge losses, one dual variable at a time."""
    w, alpha, draw = np.zeros((1 << BITS) + 1), np.zeros(len(rows)), np.random.default_rng(SEED)
    norm = np.array([v @ v + 1.0 for v in values])
    for _ in range(epochs):
        most = 0.0
        for i in draw.permutation(len(rows)):
            slope = y[i] * (w[rows[i]] @ values[i] + w[-1]) - 1
            new = min(max(alpha[i] - slope / norm[i], 0.0), cost)
            step = (new - alpha[i]) * y[i]
            if step:
                w[rows[i]] += step * values[i]
                w[-1] += step
                alpha[i] = new
                most = max(most, abs(step))
        if most < 1e-3 * cost:
            break
    return w


def logistic_curve(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of P(1 | margin), by Newton's method with slightly softened targets."""
    pos, neg = (y > 0).sum(), (y < 0).sum()
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, float(np.log((pos + 1) / (neg + 1)))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        g = np.array([((p - target) * margin).sum() + 1e-3 * (a - 1), (p - target).sum()])
        v = p * (1 - p)
        h = np.array([[(v * margin * margin).sum() + 1e-3, (v * margin).sum()], [(v * margin).sum(), v.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-8:
            break
    return float(a), float(b)


def fit(rows: list[dict]) -> dict:
    """The model of labelled rows: weights by place, bias, and the curve. Without both labels every score is 0.5 or the
    one label's smoothed share."""
    found = Indicators()
    y = np.array([1 if r["label"] else -1 for r in rows])
    if len(set(y.tolist())) < 2:
        share = ((y > 0).sum() + 1) / (len(y) + 2)
        return {"weights": np.zeros(1 << BITS, np.float32).tobytes(), "bias": 0.0, "slope": 1.0, "offset": float(np.log(share / (1 - share)))}
    places = [found.places((r["text"] or "").encode()) for r in rows]
    order = np.random.default_rng(SEED).permutation(len(rows))
    check, learn = order[: len(rows) // 5], order[len(rows) // 5 :]
    if len(set(y[learn].tolist())) < 2 or len(set(y[check].tolist())) < 2:
        check = learn = order
    ratio = log_count_ratio([places[i] for i in learn], y[learn])
    values = [ratio[p] / np.sqrt(max(1, len(p))) for p in places]
    w = dual_coordinate_descent([places[i] for i in learn], [values[i] for i in learn], y[learn])
    margin = np.array([w[places[i]] @ values[i] + w[-1] for i in check])
    slope, offset = logistic_curve(margin, y[check])
    return {"weights": (w[:-1] * ratio).astype(np.float32).tobytes(), "bias": float(w[-1]), "slope": slope, "offset": offset}


def train(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAIN) -> dict:
    """docs: key, text. labels: key, label (0 or 1; null says nothing). At most `most` labelled rows are looked at."""
    sample = labelled_sample(docs, labels.where(F.col("label").isNotNull()), most).select("key", "text", (F.col("label") == 1).alias("label"))
    return fit_in_one_task(sample, fit, "weights binary, bias double, slope double, offset double")


def score_quality(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", threshold: float = 0.3, most: int = MAX_TRAIN) -> DataFrame:
    """One row per row of df: key, held_out, score (0 to 1; higher: label 1 is likelier), predicted.

    Whole texts are scored; a null text scores as an empty one, which has the bias alone. Only the text makes a score.
    Keys may be null or repeated; empty labels give every text the same score. Other columns are not looked at.
    """
    small_batches(df.sparkSession)
    own = df.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text"))
    model = train(own, labels.select(F.col(key).cast("bigint").alias("key"), F.col(label).alias("label")), most)
    shared = df.sparkSession.sparkContext.broadcast(model)  # 4 << BITS bytes, whatever the data

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, found = shared.value, Indicators()
        w = np.frombuffer(bytes(m["weights"]), np.float32)
        for b in batches(frames):
            margin = []
            for t in b.column("text").cast(pa.binary()).to_pylist():
                p = found.places(t or b"")
                margin.append(w[p].sum(dtype=np.float64) / np.sqrt(max(1, len(p))) + m["bias"])
            score = 1 / (1 + np.exp(-np.clip(m["slope"] * np.array(margin) + m["offset"], -30, 30)))
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(score)], names=["key", "score"])

    scored = own.mapInArrow(run, "key bigint, score double")
    return scored.select(F.col("key").alias(key), held_out(F.col("key")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
