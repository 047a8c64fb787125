"""Quality rules: fixed limits on a text's words, and a logistic regression over hashed n-grams.

Base counts of a text: words, code points in words, symbols, repeated lines and words in repeated
three-word windows. A text fails the base rules with fewer than LEAST_WORDS words or with more than
MOST_REPEATED percent of its words in repeated windows. What passes is judged by a model that is
learned from labelled rows: square roots of the relative frequencies of words and word pairs, and of
runs of three characters (case kept, punctuation too), each hashed to its own fixed number of buckets,
in a logistic regression with L2 penalty. Its gradients are summed over partitions each round
(accelerated descent) until they are small. Four fifths
of the labelled rows train it; the others turn its margin into a probability (a logistic curve of it,
fitted to them). A text is kept from probability KEEP on.

The model is fitted on at most `max_labelled` labelled rows of distinct texts (chosen by hash; all of
them if there are fewer); every text of the corpus is counted and scored whole, in Arrow batches.

Null and empty texts have no words and fail the base rules. Repeated rows are judged each. A label of a
doc_id that occurs twice is 0 if any says so; null labels are ignored. Without labelled rows of both
kinds in both parts, the base rules alone decide. Lines, windows and words are compared by 64-bit hashes within
one text. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

LEAST_WORDS, MOST_REPEATED = 50, 50
KEEP = 0.5
#: Buckets of words and pairs, and of runs of three characters.
WORD_BITS, CHAR_BITS = 17, 16
BUCKETS = (1 << WORD_BITS) + (1 << CHAR_BITS)
MAX_LABELLED = 10_000
#: Penalty, most rounds, and the length of the gradient that ends them. A text's features have length 1 twice and
#: the constant is 1, so the second derivative is at most 3 / 4 and the step 4 / 3.
RIDGE, ROUNDS, STILL = 1e-5, 30, 5e-3
STEP = 4 / 3

_LINES = np.ones(256, bool)
_LINES[10] = False
_SYMBOL = np.zeros(256, bool)
_SYMBOL[np.frombuffer(b"#*$%&|<>", np.uint8)] = True
_C = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93], np.uint64)


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The sum of `values` between consecutive offsets."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[offsets[1:]] - total[offsets[:-1]]


def _again(owner: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For entries of documents: whether an equal one of the document came before, and whether any equals it."""
    order = np.lexsort((code, owner))  # stable
    same = np.zeros(len(code) + 1, bool)
    same[1:-1] = (owner[order][1:] == owner[order][:-1]) & (code[order][1:] == code[order][:-1])
    before, any_other = np.empty(len(code), bool), np.empty(len(code), bool)
    before[order], any_other[order] = same[:-1], same[:-1] | same[1:]
    return before, any_other


@dataclass
class Counts:
    n_words: np.ndarray
    word_chars: np.ndarray
    n_symbols: np.ndarray
    n_dup_lines: np.ndarray
    n_repeat_words: np.ndarray

    @property
    def failed(self) -> np.ndarray:
        return (self.n_words < LEAST_WORDS) | (100 * self.n_repeat_words > MOST_REPEATED * self.n_words)


def counts(data: np.ndarray, offsets: np.ndarray, code: np.ndarray, owner: np.ndarray) -> Counts:
    """The base counts of a run of texts; code, owner: their words."""
    n = len(offsets) - 1
    spaced = common.SPACED[data]
    line, of_line, start, end = common.words(data, offsets, _LINES, fold=False)
    inside = np.concatenate([[0], np.cumsum(spaced)])
    worded = inside[end] > inside[start]
    line, of_line = line[worded], of_line[worded]
    repeated = np.zeros(len(code), bool)
    window = common.grams(code, 3)
    at = np.flatnonzero(owner[: len(window)] == owner[len(owner) - len(window) :])
    at = at[_again(owner[at], window[at])[1]]
    for j in range(3):
        repeated[at + j] = True
    return Counts(
        np.bincount(owner, minlength=n),
        _sums(spaced & ((data & 0xC0) != 0x80), offsets),
        _sums(_SYMBOL[data], offsets),
        np.bincount(of_line[_again(of_line, line)[0]], minlength=n),
        np.bincount(owner[repeated], minlength=n),
    )


def features(data: np.ndarray, offsets: np.ndarray, code: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, bucket, value) of every bucket that a document has, by document and bucket."""
    pair = common.grams(code, 2)
    near = owner[1:] == owner[:-1] if len(owner) else np.empty(0, bool)
    word, of_word = np.concatenate([common.mix(code), pair[near]]), np.concatenate([owner, owner[1:][near]])
    point = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), "<u4").astype(np.uint64)
    first = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    with np.errstate(over="ignore"):
        run = point[:-2] * _C[0] + point[1:-1] * _C[1] + point[2:] * _C[2]
        run = (run ^ (run >> np.uint64(29))) * _C[1]
    within = doc[:-2] == doc[2:]
    parts = (of_word, word >> np.uint64(64 - WORD_BITS), 0), (doc[:-2][within], run[within] >> np.uint64(64 - CHAR_BITS), 1 << WORD_BITS)
    found = []
    for of, bucket, zero in parts:
        both, count = np.unique(of * BUCKETS + bucket.astype(np.int64) + zero, return_counts=True)
        found.append((both, np.sqrt(count / np.bincount(of, minlength=1)[both // BUCKETS])))
    both, value = (np.concatenate([f[i] for f in found]) for i in (0, 1))
    order = np.argsort(both, kind="stable")
    return both[order] // BUCKETS, both[order] % BUCKETS, value[order].astype(np.float32)


@dataclass
class Model:
    weight: np.ndarray | None  # of each bucket; None: the base rules alone decide
    curve: tuple[float, float]  # probability: logistic of curve[0] + curve[1] * margin

    def probabilities(self, data: np.ndarray, offsets: np.ndarray, code: np.ndarray, owner: np.ndarray) -> np.ndarray:
        n = len(offsets) - 1
        if self.weight is None:
            return np.ones(n)
        doc, bucket, value = features(data, offsets, code, owner)
        margin = np.bincount(doc, self.weight[bucket] * value, n)
        return 1 / (1 + np.exp(-np.clip(self.curve[0] + self.curve[1] * margin, -500, 500)))


def _runs(batch: pa.RecordBatch, column: int = 0) -> Iterator[tuple]:
    """(first row, last row + 1, bytes, offsets, word hashes, their owners)."""
    for lo, hi, data, offsets in common.text_steps(batch, batch.schema.names[column]):
        code, owner, *_ = common.words(data, offsets, common.SPACED, fold=False)
        yield lo, hi, data, offsets, code, owner


def _labelled(docs: DataFrame, labels: DataFrame, max_labelled: int) -> DataFrame:
    """(text, y, fold) of labelled rows of distinct texts, bounded."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.min(F.col("quality").cast("int")) > 0).cast("int").alias("y"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"))
    rows = common.stored(known.join(texts, "doc_id").groupBy("h").agg(F.min("y").alias("y")), "labelled")
    n, order = rows.count(), F.pmod(F.xxhash64("h", F.lit(3)), F.lit(1_000_000))
    if n > max_labelled:
        rows = rows.where(order < int(1_000_000 * max_labelled / n))
    chosen = F.broadcast(rows.withColumn("fold", (order % 5 == 0).cast("int")))  # at most about max_labelled rows of three numbers
    found = docs.select(F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("h")).join(chosen, "h")
    return found.groupBy("h", "y", "fold").agg(F.first("text").alias("text"))


def _sparse(rows: DataFrame) -> DataFrame:
    """(y, fold, at, x): the features of each labelled text, as packed numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets, code, owner in _runs(batch):
                n, (doc, bucket, value) = hi - lo, features(data, offsets, code, owner)
                bounds = np.searchsorted(doc, np.arange(n + 1))
                at, x = ([v[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] for v in (bucket.astype("<i4"), value.astype("<f4")))
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(lo, n), batch.column(2).slice(lo, n), pa.array(at, pa.binary()), pa.array(x, pa.binary())], ["y", "fold", "at", "x"])

    return rows.select("text", "y", "fold").mapInArrow(run, "y int, fold int, at binary, x binary")


def _unpacked(batch: pa.RecordBatch, fold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
    """Labels of the rows of a fold; bucket, value and row of each of their features."""
    own = np.flatnonzero(batch.column(1).to_numpy() == fold)
    if not len(own):
        return None
    at, x = ([np.frombuffer(batch.column(k)[int(i)].as_py(), kind) for i in own] for k, kind in ((2, "<i4"), (3, "<f4")))
    return batch.column(0).to_numpy()[own].astype(np.float64), np.concatenate(at), np.concatenate(x), np.repeat(np.arange(len(own)), [len(v) for v in at])


def _summed(sparse: DataFrame, part, size: int) -> np.ndarray:
    """The sum over partitions of `part`(labels, buckets, values, rows): `size` numbers each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if found := _unpacked(batch, 0):
                total += part(*found)
        yield pa.RecordBatch.from_arrays([pa.array([total.astype("<f4").tobytes()])], ["v"])

    out = np.zeros(size)
    for row in sparse.mapInArrow(run, "v binary").collect():  # 8 partitions
        out += np.frombuffer(row["v"], "<f4")
    return out


def _curve(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic curve of the margin by Newton's method, towards smoothed labels."""
    goal = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((y == 0).sum() + 2))
    x, c = np.stack([np.ones(len(y)), margin], 1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ c, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + np.eye(2) * 1e-6, x.T @ (goal - p) - 1e-6 * c)
        c += step
        if abs(step).max() < 1e-9:
            break
    return float(c[0]), max(0.0, float(c[1]))


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Model:
    """A model of `labels` (doc_id, quality 0 or 1) on `docs` (doc_id, text)."""
    spark = docs.sparkSession
    with common.small_batches(spark, 256):
        sparse = common.stored(_sparse(_labelled(docs, labels, max_labelled).repartition(8)), "quality-features")
        seen = {(r["fold"], r["y"]): r["count"] for r in sparse.groupBy("fold", "y").count().collect()}
        if len(seen) < 4:
            return Model(None, (0.0, 0.0))
        n = seen[0, 0] + seen[0, 1]
        # both kinds weigh the same; the curve puts the rates back
        rate = np.array([0.5 * n / seen[0, y] for y in (0, 1)])
        w = ahead = np.zeros(BUCKETS + 1)  # the last one is the constant
        speed = 1.0
        for _ in range(ROUNDS):
            shared = spark.sparkContext.broadcast(ahead.astype(np.float32))

            def gradient(y, at, x, row, shared=shared):
                p = 1 / (1 + np.exp(-np.clip(np.bincount(row, shared.value[at] * x, len(y)) + shared.value[-1], -30, 30)))
                off = (p - y) * rate[y.astype(int)]
                return np.append(np.bincount(at, off[row] * x, BUCKETS), off.sum())

            g = _summed(sparse, gradient, BUCKETS + 1) / n + RIDGE * ahead
            shared.destroy()
            if np.linalg.norm(g) < STILL:
                break
            before, w = w, ahead - STEP * g
            faster = (1 + np.sqrt(1 + 4 * speed**2)) / 2
            ahead, speed = w + (speed - 1) / faster * (w - before), faster
        weight = w[:-1].astype(np.float32)

        def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if found := _unpacked(batch, 1):
                    y, at, x, row = found
                    yield pa.RecordBatch.from_arrays([pa.array(np.bincount(row, weight[at] * x, len(y))), pa.array(y)], ["m", "y"])

        rest = sparse.mapInArrow(held, "m double, y double").toArrow()  # of some max_labelled / 5 rows
        return Model(weight, _curve(rest.column(0).to_numpy(), rest.column(1).to_numpy()))


SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, probability double, kept boolean"


def judged(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), threshold: float = KEEP) -> DataFrame:
    """`keep` columns of every row with its base counts, probability and verdict."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets, code, owner in _runs(batch):
                base, p = counts(data, offsets, code, owner), shared.value.probabilities(data, offsets, code, owner)
                own = [batch.column(i + 1).slice(lo, hi - lo) for i in range(len(keep))]
                made = [base.n_words, base.word_chars, base.n_symbols, base.n_dup_lines, base.n_repeat_words]
                yield pa.RecordBatch.from_arrays([*own, *(pa.array(v.astype(np.int64)) for v in made), pa.array(base.failed), pa.array(p), pa.array(~base.failed & (p >= threshold))], names)

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    names = [*keep, *(x.split()[0] for x in SCHEMA.split(", "))]
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), SCHEMA])
    return docs.select(F.col("text").cast("string").alias("text"), *(F.col(c).alias(f"k{i}") for i, c in enumerate(keep))).mapInArrow(run, schema)


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text")
    found = judged(docs, fit(docs, common.read(spark, sf_dir, "labels")))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "probability", "kept")
