"""Quality classifier: ordinal (cumulative-link) logistic regression on graded ratings.

Grades run from 0 (worst) to GRADES - 1. One set of weights over hashed tokens gives a text its score s, and ordered
thresholds t1 < t2 < ... cut the scale: P(grade >= k) = sigmoid(s - t_k). The expected grade is the sum of these
probabilities; a text is kept if the last of them, the tail probability, reaches KEEP.

Ratings: a toxic text has grade 0, one of poor quality 1, a good one 2. A token is a run of letters (of either case
alike) or of other signs; a text's features are which hashed tokens it has, how much of it is capitals, signs and digits, and how often it repeats itself.

Learning: at most MAX_ROWS rated rows, as many of each grade (those whose ids hash lowest); their features are made
in tasks, and the driver fits BUCKETS + a few weights. All rows are scored by their whole texts.

Defined results: a text without tokens (null, empty, white space only) has no features: its expected grade and tail probability are 0, its toxic probability is
null (nothing speaks for it), and it is not kept; with no ratings that holds for every text; rows without a rating are scored like
others; rated more than once, the worst grade counts; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm.common import in_arrow, label_sample, staged, sub_batches
from cadenza.llm.textbytes import FOLDED_CODES, IS_SPACE, column_bytes, run_hashes

GRADES = 3
BUCKETS = 1 << 18
MAX_ROWS = 6000
KEEP = 0.5
#: A token gets a weight if its share on the two sides of some threshold differs by this many standard errors.
TELLING = 4.0
_EXTRA = 5

#: 0 white space, 1 letters (and all bytes beyond ASCII), 2 digits, 3 other signs
_CLASS = np.full(256, 3, dtype=np.uint8)
_CLASS[IS_SPACE] = 0
_CLASS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_CLASS[48:58] = 2


def features(data: np.ndarray, at: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """For each row its distinct token buckets, and its shares of capitals, signs, digits and the log of its length."""
    kind = _CLASS[data]
    turn = np.ones(len(data), dtype=bool)
    turn[1:] = kind[1:] != kind[:-1]
    turn[at[(at > 0) & (at < len(data))]] = True
    starts = np.flatnonzero(turn)
    ends = np.append(starts[1:], len(data))
    token = kind[starts] != 0
    starts, ends = starts[token], ends[token]
    buckets = (run_hashes(data, starts, ends, FOLDED_CODES) >> np.uint64(46)).astype(np.int64)
    first = np.searchsorted(starts, at)
    tokens = [np.unique(buckets[first[i] : first[i + 1]]) for i in range(len(at) - 1)]
    sums = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[at])
    size = np.maximum(np.diff(at), 1)
    extra = np.stack([sums((data >= 65) & (data <= 90)) / size, sums(kind == 3) / size, sums(kind == 2) / size, np.log1p(np.diff(at)) / 10, [len(t) / max(1, b - a) for t, a, b in zip(tokens, first[:-1], first[1:], strict=True)]], axis=1)
    return tokens, extra


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    extra: np.ndarray
    thresholds: np.ndarray

    def score(self, tokens: list[np.ndarray], extra: np.ndarray) -> np.ndarray:
        return np.array([self.weights[t].sum() for t in tokens]) + extra @ self.extra

    def at_least(self, score: np.ndarray) -> np.ndarray:
        """rows x (GRADES - 1): the probabilities of grade k or better, k = 1, 2, ..."""
        return _sigmoid(score[:, None] - self.thresholds)


def telling(tokens: list[np.ndarray], grades: np.ndarray) -> np.ndarray:
    """Which buckets are much more common on one side of a threshold: rare words that a fit could learn by heart are not."""
    out = np.zeros(BUCKETS, dtype=bool)
    for k in range(1, GRADES):
        n = [max(1, int((grades < k).sum())), max(1, int((grades >= k).sum()))]
        held = [np.bincount(np.concatenate([np.zeros(0, np.int64), *(t for t, g in zip(tokens, grades, strict=True) if (g >= k) == side)]), minlength=BUCKETS) for side in (False, True)]
        share = (held[0] + held[1]) / sum(n)
        error = np.sqrt(share * (1 - share) * (1 / n[0] + 1 / n[1]))
        out |= np.abs(held[0] / n[0] - held[1] / n[1]) > TELLING * np.maximum(error, 1e-9)
    return out


def fit(tokens: list[np.ndarray], extra: np.ndarray, grades: np.ndarray, rounds: int = 300, rate: float = 0.05, ridge: float = 1e-4) -> Model:
    """Adam on the mean over grades of the negative log-likelihood; the thresholds' gaps are exponentials, so they stay ordered."""
    some = telling(tokens, grades)
    tokens = [t[some[t]] for t in tokens]
    rows, flat = np.repeat(np.arange(len(tokens)), [len(t) for t in tokens]), np.concatenate(tokens)
    share = 1.0 / np.bincount(grades, minlength=GRADES).clip(1)[grades] / len(set(grades.tolist()))
    w = {"w": np.zeros(BUCKETS), "x": np.zeros(_EXTRA), "t": np.zeros(GRADES - 1)}
    first, second = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}
    seen = np.bincount(flat, minlength=BUCKETS)
    for step in range(1, rounds + 1):
        s = np.bincount(rows, weights=w["w"][flat], minlength=len(tokens)) + extra @ w["x"]
        t = np.concatenate([w["t"][:1], w["t"][:1] + np.cumsum(np.exp(w["t"][1:]))])
        above = np.concatenate([np.ones((len(s), 1)), _sigmoid(s[:, None] - t), np.zeros((len(s), 1))], axis=1)
        p = np.maximum(above[np.arange(len(s)), grades] - above[np.arange(len(s)), grades + 1], 1e-9)
        slope = above * (1 - above)
        ds = -share * (slope[np.arange(len(s)), grades] - slope[np.arange(len(s)), grades + 1]) / p
        dt = np.zeros(GRADES + 1)
        np.add.at(dt, grades, share * slope[np.arange(len(s)), grades] / p)
        np.add.at(dt, grades + 1, -share * slope[np.arange(len(s)), grades + 1] / p)
        dt = dt[1:GRADES]
        gaps = np.exp(w["t"][1:])
        g = {"w": np.bincount(flat, weights=ds[rows], minlength=BUCKETS) + ridge * w["w"] * (seen > 0), "x": extra.T @ ds, "t": np.concatenate([[dt.sum()], np.cumsum(dt[::-1])[::-1][1:] * gaps])}
        for k in w:
            first[k] = 0.9 * first[k] + 0.1 * g[k]
            second[k] = 0.999 * second[k] + 0.001 * g[k] ** 2
            w[k] = w[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-5)
    t = np.concatenate([w["t"][:1], w["t"][:1] + np.cumsum(np.exp(w["t"][1:]))])
    return Model(w["w"].astype(np.float32), w["x"], t)


def grade(quality: str = "quality", toxic: str = "toxic") -> Column:
    return F.when(F.col(toxic) == 1, 0).when(F.col(quality) == 0, 1).when(F.col(quality) == 1, 2)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sub_batches(batches, "text"):
        tokens, extra = features(*column_bytes(batch.column(1)))
        yield pa.record_batch({"grade": batch.column(0), "tokens": pa.array([t.astype(np.uint32).tobytes() for t in tokens], pa.binary()), "extra": pa.array([e.tobytes() for e in extra], pa.binary())})


def learn(docs: DataFrame, ratings: DataFrame, id_column: str = "doc_id", text_column: str = "text", max_rows: int = MAX_ROWS) -> Model | None:
    """ratings has the columns of id_column and grade."""
    rated = ratings.where(F.col(id_column).isNotNull() & F.col("grade").isNotNull()).groupBy(F.col(id_column).alias("__cz_id")).agg(F.min("grade").cast("int").alias("grade"))
    there = docs.select(F.col(id_column).alias("__cz_id")).distinct()
    chosen = label_sample(rated.join(there, "__cz_id"), "grade", "__cz_id", max_rows // GRADES)
    ids = F.broadcast(staged(chosen.select("__cz_id", "grade"), "rated-sample"))  # max_rows at most
    texts = docs.join(ids, F.col(id_column) == F.col("__cz_id")).groupBy("__cz_id", "grade").agg(F.min(F.coalesce(F.col(text_column), F.lit(""))).alias("text")).select("grade", "text")
    rows = in_arrow(texts, _features, "grade int, tokens binary, extra binary").collect()
    rows.sort(key=lambda r: (r.grade, bytes(r.extra), bytes(r.tokens)))
    if not rows:
        return None
    tokens = [np.frombuffer(r.tokens, dtype=np.uint32).astype(np.int64) for r in rows]
    return fit(tokens, np.array([np.frombuffer(r.extra) for r in rows]), np.array([r.grade for r in rows]))


def rate(docs: DataFrame, model: Model | None, id_column: str = "doc_id", text_column: str = "text", keep: float = KEEP) -> DataFrame:
    """A row for each row of docs: doc_id, expected_grade, tail_probability, toxic_probability and kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sub_batches(batches, "text"):
            data, at = column_bytes(batch.column(1))
            tokens, extra = features(data, at)
            p = model.at_least(model.score(tokens, extra)) if model else np.zeros((len(tokens), GRADES - 1))
            unknown = np.array([not len(t) for t in tokens]) | (model is None)
            p[unknown] = 0
            yield pa.record_batch({"doc_id": batch.column(0), "expected_grade": pa.array(p.sum(axis=1)), "tail_probability": pa.array(p[:, -1].copy()), "toxic_probability": pa.array(1 - p[:, 0], mask=unknown)})

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    return in_arrow(rows, run, "doc_id long, expected_grade double, tail_probability double, toxic_probability double").withColumn("kept", F.col("tail_probability") >= keep)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ratings = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", grade().alias("grade"))
    return rate(docs, learn(docs, ratings))
