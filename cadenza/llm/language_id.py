"""Language ID with error-correcting output codes.

Each language gets a codeword of +1 and -1. For every bit of the code a logistic classifier over hashed
character trigrams says which half of the languages a text belongs to. Decoding adds up, for each
codeword, the logistic losses of the bits, weighted by how well each bit is known, and takes the nearest codeword;
a text whose two nearest codewords are about as near is flagged as ambiguous.

Learning: Spark counts the languages' rows; the MAX_LANGUAGES most common ones (of equally common ones the first in order) are
learned. It draws at most MAX_ROWS rows, the same number of each language (those whose ids hash lowest), and computes their features
in tasks; the driver fits DIMENSIONS x bits weights. Everything else reads all rows and whole texts.

Defined results: a null text, or one without a letter, is 'und' with score 0; rows without a language or
id are never learned from, and a language beyond the MAX_LANGUAGES most common ones is never predicted; with one language only, every text with a letter gets it with score 1; with none to
learn from, every text is 'und'; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm.common import in_arrow, label_sample, staged, sub_batches
from cadenza.llm.textbytes import column_bytes

DIMENSIONS = 4096
CODE_BITS = 15
#: Rows that the classifiers are fitted on, of all languages together.
MAX_ROWS = 2000
#: Languages that are learned at most: each gets MAX_ROWS / MAX_LANGUAGES rows at least.
MAX_LANGUAGES = 200
#: Below this score a text is ambiguous.
SURE = 0.5
UNDETERMINED = "und"

_LETTERS = np.full(256, 0x20, dtype=np.uint32)
_LETTERS[65:91] = np.arange(97, 123)
_LETTERS[97:123] = np.arange(97, 123)
_LETTERS[128:] = np.arange(128, 256)
_STEP = 1 << 20


def trigram_counts(data: np.ndarray) -> np.ndarray:
    """Counts of hashed byte trigrams with a letter in the middle; all that is not a letter counts as a space."""
    out = np.zeros(DIMENSIONS, dtype=np.int64)
    for a in range(0, len(data), _STEP):
        part = np.full(min(_STEP, len(data) - a) + 2, 0x20, dtype=np.uint32)
        lo, hi = max(0, a - 1), min(len(data), a + _STEP + 1)
        part[lo - a + 1 : hi - a + 1] = _LETTERS[data[lo:hi]]
        middle = part[1:-1]
        h = (part[:-2] * np.uint32(0x9E3779B1) + middle * np.uint32(0x85EBCA77) + part[2:] * np.uint32(0xC2B2AE3D)) * np.uint32(0x27D4EB2F)
        out += np.bincount((h >> np.uint32(20))[middle != 0x20], minlength=DIMENSIONS)
    return out


def features(counts: np.ndarray) -> np.ndarray:
    """Square roots of the shares: vectors of length 1."""
    return np.sqrt(counts / np.maximum(counts.sum(axis=-1, keepdims=True), 1)).astype(np.float32)


def codewords(languages: int, bits: int = CODE_BITS, seed: int = 3) -> np.ndarray:
    """languages x bits of +1 and -1: of some seeded draws the one whose words lie farthest apart."""
    best, at = None, -1
    rng = np.random.default_rng(seed)
    bits = max(bits, 2 * int(np.ceil(np.log2(max(2, languages)))) + 7)
    for _ in range(200):
        code = rng.choice([-1.0, 1.0], size=(languages, bits))
        for j in np.flatnonzero(np.abs(code.sum(axis=0)) == languages):
            code[rng.integers(languages), j] *= -1
        same = (code @ code.T + bits) / 2  # how many bits two words share
        apart = bits - (same - 2 * bits * np.eye(languages)).max() if languages > 1 else bits
        if apart > at:
            best, at = code, apart
    return best


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each row of features: the nearest language's number, its share of the evidence, the runner-up's share."""
        margins = x @ self.weights + self.bias
        loss = np.stack([np.logaddexp(0, -margins * word) @ self.trust for word in self.code], axis=1)
        share = np.exp(loss.min(axis=1, keepdims=True) - loss)
        share /= share.sum(axis=1, keepdims=True)
        order = np.sort(share, axis=1)
        return loss.argmin(axis=1), order[:, -1], order[:, -2] if share.shape[1] > 1 else np.zeros(len(x))


def fit(x: np.ndarray, labels: list[str], rounds: int = 150) -> Model:
    """Logistic regressions of all bits at once, by gradient steps with momentum on the mean loss."""
    languages = tuple(sorted(set(labels)))
    y = np.array([languages.index(v) for v in labels], dtype=int)
    code = codewords(len(languages)) if languages else np.zeros((0, CODE_BITS))
    bits = code.shape[1]
    weights, bias = np.zeros((DIMENSIONS, bits), dtype=np.float32), np.zeros(bits, dtype=np.float32)
    if len(languages) < 2:
        return Model(languages, code, weights, bias, np.ones(bits))
    want = code[y].astype(np.float32)
    even = (1 / np.bincount(y)[y] / len(languages)).astype(np.float32)[:, None]
    speed, drift = np.zeros_like(weights), np.zeros_like(bias)
    for _ in range(rounds):
        slope = -want * even / (1 + np.exp(want * (x @ weights + bias)))
        speed = 0.9 * speed - 20.0 * (x.T @ slope + 1e-5 * weights)
        drift = 0.9 * drift - 5.0 * slope.sum(axis=0)
        weights, bias = weights + speed, bias + drift
    wrong = (even * (want * (x @ weights + bias) <= 0)).sum(axis=0)
    trust = np.log((1 - wrong + 1e-3) / (wrong + 1e-3)).clip(0.05)
    return Model(languages, code, weights, bias, trust / trust.mean())


def held_out(id_column: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_column).cast("string")) % 4 == 2, F.lit(False))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sub_batches(batches, "text"):
        data, at = column_bytes(batch.column(1))
        codes = [features(trigram_counts(data[at[i] : at[i + 1]])).astype(np.float16).tobytes() for i in range(batch.num_rows)]
        yield pa.record_batch({"lang": batch.column(0), "x": pa.array(codes, pa.binary())})


def learn(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", max_rows: int = MAX_ROWS) -> Model:
    known = docs.where(F.col(id_column).isNotNull() & F.col(lang_column).isNotNull() & ~held_out(id_column)).select(F.col(id_column).alias("doc_id"), F.col(lang_column).alias("lang")).distinct()
    common = staged(known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(min(MAX_LANGUAGES, max_rows)).select("lang"), "languages")
    each = max(1, max_rows // max(1, common.count()))
    chosen = label_sample(known.join(F.broadcast(common), "lang"), "lang", "doc_id", each)  # MAX_LANGUAGES rows
    ids = F.broadcast(staged(chosen.select(F.col("doc_id").alias("__cz_id"), F.col("lang").alias("__cz_lang")).distinct(), "language-sample"))  # max_rows at most
    texts = docs.join(ids, (F.col(id_column) == F.col("__cz_id")) & (F.col(lang_column) == F.col("__cz_lang"))).groupBy("__cz_id", F.col("__cz_lang").alias("lang")).agg(F.min(text_column).alias("text"))
    rows = in_arrow(texts.select("lang", "text").where("text RLIKE '\\\\p{L}'"), _count, "lang string, x binary").collect()
    rows.sort(key=lambda r: (r.lang, bytes(r.x)))
    x = np.array([np.frombuffer(r.x, dtype=np.float16) for r in rows], dtype=np.float32).reshape(len(rows), DIMENSIONS)
    return fit(x, [r.lang for r in rows])


def _predict(model: Model, extra: int):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sub_batches(batches, "__cz_text"):
            data, at = column_bytes(batch.column(extra))
            n = batch.num_rows
            counts = np.stack([trigram_counts(data[at[i] : at[i + 1]]) for i in range(n)])
            lettered = np.array([bool(c.any()) for c in counts])
            for i in np.flatnonzero(lettered):
                part = data[at[i] : at[i + 1]]
                if not (((part | 0x20) >= 97) & ((part | 0x20) <= 122)).any():  # no letter of ASCII: is there another?
                    lettered[i] = any(ch.isalpha() for ch in part.tobytes().decode("utf-8", "ignore"))
            if model.languages:
                best, score, second = model.decode(features(counts))
            else:
                lettered[:] = False
                best, score, second = np.zeros(n, int), np.zeros(n), np.zeros(n)
            names = [model.languages[b] if ok else UNDETERMINED for b, ok in zip(best, lettered, strict=True)]
            columns = {batch.schema.names[i]: batch.column(i) for i in range(extra)}
            columns |= {"lang_pred": pa.array(names, pa.string()), "score": pa.array(np.where(lettered, score, 0.0)), "runner_up": pa.array(np.where(lettered, second, 0.0))}
            yield pa.record_batch(columns)

    return predict


def predict(docs: DataFrame, model: Model, keep: list[str], text_column: str = "text") -> DataFrame:
    """The columns keep of docs, with lang_pred, score, runner_up (its score) and ambiguous."""
    asked = docs.select(*keep, F.col(text_column).alias("__cz_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in asked.select(*keep).schema) + ", lang_pred string, score double, runner_up double"
    return in_arrow(asked, _predict(model, len(keep)), schema).withColumn("ambiguous", (F.col("lang_pred") != UNDETERMINED) & (F.col("score") < SURE))


def keep_identified(docs: DataFrame, model: Model, text_column: str = "text") -> DataFrame:
    """docs without the texts whose language is undetermined or ambiguous."""
    columns = docs.columns
    own = docs.select(*[F.col(c).alias(f"__cz_{i}") for i, c in enumerate(columns)])
    kept = predict(own, model, own.columns, f"__cz_{columns.index(text_column)}").where(~F.col("ambiguous") & (F.col("lang_pred") != UNDETERMINED))
    return kept.select(*[F.col(f"__cz_{i}").alias(c) for i, c in enumerate(columns)])


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = predict(docs, learn(docs), ["doc_id"])
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score", "ambiguous")
