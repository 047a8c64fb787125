"""Toxic passages by maximum-scoring segments.

Words (lower-cased runs of ASCII letters and digits and of characters beyond ASCII) score the
log-odds of standing in toxic rather than clean labelled texts, under an informative Dirichlet prior
that draws rare words to the pooled rate; odds within their error count as none, and every word costs
a little, so clean text drifts down. A linear-time scan finds all maximal segments of a text. Their
significance comes from the extreme-value law of the best segment in clean text: its scale solves
sum p(s) exp(lambda s) = 1 over the scores of clean words, its constant is the likelihood estimate
from the best segments of clean texts; both from labelled texts that the scores were not learned on.

With E(s) = constant * n * exp(-lambda s), n the words outside of all segments (at least as many as make
E(0) = 1), a text's evidence is -log E of its best segment, and the sum of the positive -log E of all.
The score is a logistic curve of both with weights that are never negative: a further toxic passage
adds to the evidence and no words to n, so it can't lower a score.

Words are hashed to BUCKETS counters, so the model has one size whatever the corpus. It is fitted on
at most `max_labelled` labelled rows of distinct texts (chosen by hash; all of them if there are
fewer): the rest is calibrated on odds from seven tenths, then the odds are taken from all.

Null and empty texts have no words and get the curve's value for no segment. A label of a doc_id that
occurs twice counts once, toxic if any says so; null labels are ignored. Repeated rows are scored
each. Without both kinds of labels every score is 0. Labels, lang and source are never inputs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

BUCKETS = 1 << 20
MAX_LABELLED = 200_000
#: Weight of the prior in texts (half of all texts at most), least deviation of odds that count, how fast
#: odds gain weight beyond it, cost of a word.
PRIOR, LEAST_Z, SHRINK, DRIFT = 300.0, 2.0, 4.0, 0.3
THRESHOLD = 0.7
RIDGE = 0.01
SIGNIFICANT = 0.05


@dataclass
class Model:
    weight: np.ndarray  # float32 score of a word by its bucket, the drift included
    scale: float
    constant: float
    curve: np.ndarray


def segments(gain: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, last + 1, score) of a row of scores, in linear time."""
    level = np.concatenate([[0.0], np.cumsum(gain, dtype=np.float64)])
    found: list[tuple[int, int, float, float]] = []
    for at in np.flatnonzero(gain > 0).tolist():
        first, last, low, high = at, at + 1, level[at], level[at + 1]
        while True:
            k = len(found) - 1
            while k >= 0 and found[k][2] >= low:
                k -= 1
            if k < 0 or found[k][3] >= high:
                break
            first, low = found[k][0], found[k][2]
            del found[k:]
        found.append((first, last, low, high))
    return [(a, b, float(hi - lo)) for a, b, lo, hi in found]


def _buckets(batch: pa.RecordBatch, column: int | str = "text") -> Iterator[tuple]:
    """(first row, last row + 1, bucket and owner of each word, its start and end byte, bytes, offsets)."""
    for lo, hi, data, offsets in common.text_steps(batch, batch.schema.names[column] if isinstance(column, int) else column):
        code, owner, start, end = common.words(data, offsets, common.ALNUM)
        yield lo, hi, (code & np.uint64(BUCKETS - 1)).astype(np.int64), owner, start, end, data, offsets


def _train_rows(docs: DataFrame, labels: DataFrame, learn, max_labelled: int) -> DataFrame:
    """(doc_id, toxic, fold) for labelled rows that `learn` admits, one of each text, bounded."""
    known = labels.where(F.col("toxic").isNotNull() & learn(F.col("doc_id"))).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    texts = docs.where(learn(F.col("doc_id"))).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"))
    rows = known.join(texts, "doc_id").groupBy("h").agg(F.min(F.struct("doc_id", "toxic")).alias("r")).select("r.*")
    rows = rows.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = common.stored(rows, "labelled")
    n = rows.count()
    order = F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(1_000_000))
    if n > max_labelled:
        rows = rows.where(order < int(1_000_000 * max_labelled / n))
    return rows.withColumn("fold", (order % 10 >= 7).cast("int"))


def _counts(train: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Per bucket: toxic texts, clean texts and words of clean texts with it; and texts of each kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((3, BUCKETS), np.int64)
        texts = np.zeros(2, np.int64)
        for batch in batches:
            toxic = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for lo, hi, bucket, owner, *_ in _buckets(batch):
                own = toxic[lo:hi]
                both = np.unique(owner * BUCKETS + bucket)
                of, b = both // BUCKETS, both % BUCKETS
                total[0] += np.bincount(b[own[of]], minlength=BUCKETS)
                total[1] += np.bincount(b[~own[of]], minlength=BUCKETS)
                total[2] += np.bincount(bucket[~own[owner]], minlength=BUCKETS)
                texts += [own.sum(), (~own).sum()]
        at = np.flatnonzero(total.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array([at.astype("<u4").tobytes()]), pa.array([total[:, at].astype("<u4").tobytes()]), pa.array([int(texts[0])]), pa.array([int(texts[1])])], ["at", "n", "toxic", "clean"])

    total, texts = np.zeros((3, BUCKETS), np.int64), np.zeros(2, np.int64)
    for row in train.select("text", "toxic").mapInArrow(run, "at binary, n binary, toxic long, clean long").toLocalIterator():
        at = np.frombuffer(row["at"], "<u4")
        total[:, at] += np.frombuffer(row["n"], "<u4").reshape(3, -1)
        texts += [row["toxic"], row["clean"]]
    return total, texts


def _weights(total: np.ndarray, texts: np.ndarray) -> np.ndarray:
    prior = min(PRIOR, texts.sum() / 2)
    pooled = prior * (total[0] + total[1]) / max(1, texts.sum())
    toxic, clean = total[0] + pooled, total[1] + pooled
    some = pooled > 0
    odds, error = np.zeros(BUCKETS), np.ones(BUCKETS)
    odds[some] = np.log(toxic[some] / (texts[0] + prior)) - np.log(clean[some] / (texts[1] + prior))
    error[some] = 1 / toxic[some] + 1 / clean[some]
    z2 = odds**2 / error
    return (np.where(z2 >= LEAST_Z**2, odds * z2 / (z2 + SHRINK), 0.0) - DRIFT).astype(np.float32)


def _scale(weight: np.ndarray, clean_words: np.ndarray) -> float:
    """The positive root of sum p(s) exp(x s) = 1 over clean words; the worst word counts once more,
    so that there is a root even if clean texts hold no word of positive score."""
    clean_words = clean_words.copy()
    clean_words[weight.argmax()] += 1
    p = clean_words / max(1, clean_words.sum())
    used = p > 0
    p, s = p[used], weight[used].astype(np.float64)
    if not (s > 0).any() or (p * s).sum() >= 0:
        return 1.0
    lo, hi = 1e-6, 1.0
    while (p * np.exp(np.minimum(hi * s, 500))).sum() < 1 and hi < 64:
        hi *= 2
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if (p * np.exp(np.minimum(mid * s, 500))).sum() < 1 else (lo, mid)
    return lo


def _found(weight: np.ndarray, bucket: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, list]:
    """Words of each text, and all segments as (text, first word, last word + 1, score)."""
    first, count = common.by_doc(bucket, owner, n)
    gain = weight[bucket]
    out = []
    for row in np.unique(owner[gain > 0]).tolist():
        a = int(first[row])
        out += [(row, a + i, a + j, s) for i, j, s in segments(gain[a : a + int(count[row])])]
    return count, out


def _best(count: np.ndarray, found: list) -> tuple[np.ndarray, np.ndarray]:
    """Score of the best segment of each text, and its words outside of all segments."""
    best, outside = np.zeros(len(count)), count.astype(np.float64)
    if found:
        row, first, last, s = (np.array(x) for x in zip(*found, strict=True))
        np.maximum.at(best, row, s)
        np.subtract.at(outside, row, last - first)
    return best, outside


#: -log E beyond which a best segment adds nothing: a wrong label can't bend the curve.
CERTAIN = 30.0


def _evidence(scale: float, constant: float, outside: np.ndarray, row: np.ndarray, s: np.ndarray) -> np.ndarray:
    """What the curve is over: 1, the best -log E up to CERTAIN, the log of 1 + the sum of all positive ones."""
    over = np.maximum(0, scale * s - np.log(np.maximum(constant * outside, 1))[row])
    best, total = np.zeros(len(outside)), np.zeros(len(outside))
    np.maximum.at(best, row, over)
    np.add.at(total, row, over)
    return np.stack([np.ones(len(outside)), np.minimum(best, CERTAIN), np.log1p(total)], 1)


def _curve(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic weights by Newton's method; but for the first, those that would be negative are 0."""
    used = np.ones(x.shape[1], bool)
    while True:
        own, curve = x[:, used], np.zeros(used.sum())
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(own @ curve, -30, 30)))
            step = np.linalg.solve(own.T @ (own * (p * (1 - p))[:, None]) + np.eye(len(curve)) * RIDGE, own.T @ (y - p) - RIDGE * curve)
            curve += step
            if abs(step).max() < 1e-8:
                break
        out = np.zeros(x.shape[1])
        out[used] = curve
        if (out[1:] >= 0).all():
            return out
        used[1 + out[1:].argmin()] = False


def fit(docs: DataFrame, labels: DataFrame, learn=lambda doc_id: F.lit(True), max_labelled: int = MAX_LABELLED) -> Model:
    """A model of `labels` (doc_id, toxic) on `docs` (doc_id, text); `learn` says which ids may be used."""
    rows = _train_rows(docs, labels, learn, max_labelled)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(rows), "doc_id")  # rows: at most about max_labelled
    most, of = _counts(texts.where("fold = 0"))
    rest, of_rest = _counts(texts.where("fold = 1"))
    total, full = most, _weights(most + rest, of + of_rest)
    weight = _weights(total, of)
    scale = _scale(weight, rest[2])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, bucket, owner, *_ in _buckets(batch):
                count, found = _found(weight, bucket, owner, hi - lo)
                best, outside = _best(count, found)
                own: list[list[float]] = [[] for _ in range(hi - lo)]
                for row, _, _, s in found:
                    own[row].append(s)
                yield pa.RecordBatch.from_arrays([pa.array(outside), pa.array(best), pa.array([np.array(x, np.float32).tobytes() for x in own], pa.binary()), batch.column(1).slice(lo, hi - lo)], ["outside", "best", "scores", "toxic"])

    held = texts.where("fold = 1").select("text", "toxic").mapInArrow(run, "outside double, best double, scores binary, toxic int").toArrow()  # of some 0.3 max_labelled texts
    outside, best, y = (held.column(i).to_numpy().astype(np.float64) for i in (0, 1, 3))
    scores = [np.frombuffer(x, np.float32) for x in held.column(2).to_pylist()]
    clean = y == 0
    if not of.all() or not clean.any() or clean.all():
        return Model(full, scale, 1.0, np.array([-np.inf, 0, 0]))
    constant = float(clean.sum() / max(1e-9, (np.maximum(outside[clean], 1) * np.exp(-scale * best[clean])).sum()))
    row = np.repeat(np.arange(len(scores)), [len(x) for x in scores])
    return Model(full, scale, constant, _curve(_evidence(scale, constant, outside, row, np.concatenate(scores).astype(np.float64)), y))


SCHEMA = "score double, n_words long, passages array<struct<start: int, stop: int, score: double, e_value: double>>"


def _scores(m: Model, count: np.ndarray, found: list) -> np.ndarray:
    """The score of each text."""
    if np.isinf(m.curve[0]):
        return np.zeros(len(count))
    _, outside = _best(count, found)
    row, s = (np.array([f[i] for f in found], kind) for i, kind in ((0, np.int64), (3, np.float64)))
    return 1 / (1 + np.exp(-np.clip(_evidence(m.scale, m.constant, outside, row, s) @ m.curve, -700, 700)))


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` columns of every row, score, n_words, and the significant passages (code points)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = shared.value
        for batch in batches:
            for lo, hi, bucket, owner, start, end, data, offsets in _buckets(batch):
                count, found = _found(m.weight, bucket, owner, hi - lo)
                p, (_, outside) = _scores(m, count, found), _best(count, found)
                passages: list[list] = [[] for _ in range(hi - lo)]
                point = None
                for row, a, b, s in found:
                    e = max(1.0, m.constant * float(outside[row])) * math.exp(-m.scale * s)
                    if e <= SIGNIFICANT:
                        if point is None:
                            point = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                        zero = point[offsets[row]]
                        passages[row].append({"start": int(point[start[a]] - zero), "stop": int(point[end[b - 1]] - zero), "score": s, "e_value": e})
                kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("score", pa.float64()), ("e_value", pa.float64())]))
                own = [batch.column(batch.schema.get_field_index(f"k{i}")).slice(lo, hi - lo) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*own, pa.array(p), pa.array(count), pa.array(passages, kind)], [*keep, "score", "n_words", "passages"])

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), SCHEMA])
    return docs.select(F.col("text").cast("string").alias("text"), *(F.col(c).alias(f"k{i}") for i, c in enumerate(keep))).mapInArrow(run, schema)


def below(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs`, all columns, that score less than `threshold`."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at, names = docs.columns.index("text"), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, bucket, owner, *_ in _buckets(batch, at):
                count, found = _found(shared.value.weight, bucket, owner, hi - lo)
                yield batch.slice(lo, hi - lo).filter(pa.array(_scores(shared.value, count, found) < threshold))

    plain = docs.toDF(*(f"c{i}" for i in range(len(names)))).withColumn(f"c{at}", F.col(f"c{at}").cast("string"))
    return plain.mapInArrow(run, plain.schema).toDF(*names)


def remainder(doc_id):
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3


def learns(doc_id):
    """Rows whose labels the query may use."""
    return remainder(doc_id) != 1


def op9_maximum_scoring_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    found = score(docs, fit(docs, common.read(spark, sf_dir, "labels"), learns))
    return found.select("doc_id", (remainder(F.col("doc_id")) == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
