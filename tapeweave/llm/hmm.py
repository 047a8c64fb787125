"""Hidden Markov language model over word symbols.

The HEAD most frequent training words are symbols of their own; every other word emits the symbol of
its ending (one of ENDINGS) and then, whatever the state, is drawn from the words of that ending by
its count. So a text's likelihood is exactly the forward probability of its symbols times, for each
rarer word, P(word | ending). The states' tables have one size whatever the corpus, while counts
cover every training word.

Training: counts of all words; a start where each state's emissions are the corpus's, each changed at
random; then Baum-Welch over all training texts, twice. First by SLICES of them, dealt by the hash of
the text: after each slice the expected counts move RATE of the way to what the slice says of the whole,
and the model with them (the states part after a few slices, which rounds over everything take long
for). Then one round over all texts gives the counts that the model is made of. Expected counts are
added up block by block across partitions. Scoring: scaled forward recursion over whole texts. Counts
of rarer words reach their texts through buckets of the word's hash, in blocks: no table of the
vocabulary is ever broadcast.

A text is its lower-cased (A-Z) words `[^ \\t-\\r]+` and one end symbol. Null text: the end alone.
Repeated rows count each in training and are scored each. No training rows: every probability is the
base's, 0.1 / 0.1 to the token.
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

STATES = 12
HEAD = 1 << 16
ENDINGS = 4096
#: Parts of the texts that the model learns from one by one, and the weight of one against those before.
SLICES, RATE = 16, 0.7
SMOOTH = 0.1
#: Weight, in words, of the corpus-wide distribution in each state's; and, in occurrences, of the states'
#: shares in each word's own, which rare words fall back to.
PULL, OWN = 200.0, 0.5
#: Least number of buckets of rarer words, and words in one, about; bytes of text in one vectorised step.
BUCKETS, BUCKET_WORDS = 64, 200_000
STEP = 4 << 20
#: Symbols in one stored row (a longer text is a row of its own) and in one vectorised step of a round.
ROW_SYMBOLS = 1 << 16
STEP_SYMBOLS = 1_500_000
#: Symbols whose expected counts are added up together, and places between two scalings of a recursion.
_BLOCK = 256
_EVERY = 8


@dataclass
class Vocabulary:
    """Head words by hash, counts of the corpus, and of rarer words by ending."""

    head: np.ndarray
    head_counts: np.ndarray
    total: int
    distinct: int
    texts: int
    ending_total: np.ndarray
    ending_distinct: np.ndarray

    @property
    def size(self) -> int:
        return len(self.head) + ENDINGS + 1

    def unigram(self) -> np.ndarray:
        n = np.concatenate([self.head_counts, self.ending_total, [self.texts]]) + SMOOTH
        return n / n.sum()


@dataclass
class Model:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # symbols x states


def _words(batch: pa.RecordBatch, step: int = STEP):
    for lo, hi, data, offsets in common.text_steps(batch, "text", step, 4096):
        code, owner, start, end = common.words(data, offsets, common.SPACED)
        low = common._FOLD[data]
        tail = np.zeros(len(end), np.uint64)
        for j in range(1, 4):
            at = end - j
            tail = tail * np.uint64(257) + np.where(at >= start, low[np.maximum(at, 0)].astype(np.uint64) + np.uint64(1), np.uint64(0))
        ending = (common.mix(tail) % np.uint64(ENDINGS)).astype(np.int64)
        yield lo, hi, code, owner, ending


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, ending, n) over all words of `docs` (text); word: a 64-bit hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush():
            code, ending = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            word, at, n = np.unique(code, return_index=True, return_counts=True)
            for i in range(0, len(word), 100_000):
                cut = slice(i, i + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(word[cut].view(np.int64)), pa.array(ending[at[cut]].astype(np.int32)), pa.array(n[cut])], ["word", "ending", "n"])

        for batch in batches:
            for _, _, code, _, ending in _words(batch):
                held.append((code, ending))
                size += len(code)
                if size >= 4_000_000:
                    yield from flush()
                    size = 0
        if held:
            yield from flush()

    rows = docs.select("text").mapInArrow(run, "word long, ending int, n long")
    return rows.groupBy("word").agg(F.first("ending").alias("ending"), F.sum("n").alias("n"))


def vocabulary(counts: DataFrame, texts: int) -> Vocabulary:
    """`counts`: a stored table. Collects at most HEAD words and ENDINGS totals."""
    level = F.floor(8 * F.log2("n")).cast("int")
    room, least = HEAD, 0
    for value, n in sorted(counts.groupBy(level.alias("l")).count().collect(), reverse=True):
        if n > room:
            least = value + 1
            break
        room -= n
    is_head = level >= least
    rows = counts.where(is_head).select("word", "n").toArrow()
    head, n = rows.column(0).to_numpy().view(np.uint64), rows.column(1).to_numpy()
    order = np.argsort(head)
    total, distinct = np.zeros(ENDINGS, np.int64), np.zeros(ENDINGS, np.int64)
    for ending, s, d in counts.where(~is_head).groupBy("ending").agg(F.sum("n"), F.count("*")).collect():
        total[ending], distinct[ending] = s, d
    return Vocabulary(head[order], n[order], int(n.sum() + total.sum()) + texts, len(n) + int(distinct.sum()) + (texts > 0), texts, total, distinct)


def symbols(v: Vocabulary, code: np.ndarray, owner: np.ndarray, ending: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of n texts with their ends, the first index and the length of each text."""
    at = np.minimum(np.searchsorted(v.head, code), max(0, len(v.head) - 1))
    known = v.head[at] == code if len(v.head) else np.zeros(len(code), bool)
    own = np.where(known, at, len(v.head) + ending)
    _, count = common.by_doc(code, owner, n)
    first = np.cumsum(count + 1) - (count + 1)
    out = np.full(len(code) + n, v.size - 1, np.int64)
    out[np.arange(len(code)) + owner] = own
    return out, first, count + 1


def against(m: Model, unigram: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, moves, and emissions against the corpus's distribution: what the recursions take, so that
    products stay near 1 for _EVERY places."""
    return m.start, m.move, (m.emit / unigram[:, None]).astype(np.float32)


def _turn(sym: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, list[int], list[int], np.ndarray]:
    """Symbols with all first ones in front, then all second ones; where each place begins, how many texts
    have it, and the texts by descending length, which is their order there."""
    order = np.argsort(-length, kind="stable")
    alive = _alive(length[order])
    begin = np.cumsum(alive) - alive
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    turned = np.empty(len(sym), np.int64)
    turned[begin[np.arange(len(sym)) - np.repeat(np.cumsum(length) - length, length)] + np.repeat(rank, length)] = sym
    return turned, begin.tolist(), alive.tolist(), order


def forward(start: np.ndarray, move: np.ndarray, ratio: np.ndarray, sym: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Natural log of each text's probability against that of independent symbols."""
    turned, at, many, order = _turn(sym, length)
    logs, a = np.zeros(len(order)), None
    for t, (lo, n) in enumerate(zip(at, many, strict=True)):
        own = ratio[turned[lo : lo + n]]
        own *= start if t == 0 else a[:n] @ move
        a = own
        if t % _EVERY == _EVERY - 1:
            c = np.maximum(a.sum(1), 1e-30)
            a /= c[:, None]
            logs[:n] += np.log(c)
        stay = many[t + 1] if t + 1 < len(many) else 0
        if stay < n:
            logs[stay:n] += np.log(np.maximum(a[stay:n].sum(1), 1e-30))
    out = np.empty(len(order))
    out[order] = logs
    return out


def _alive(size: np.ndarray) -> np.ndarray:
    """How many texts are longer than t, for each t; `size` descends."""
    return np.searchsorted(-size, -np.arange(int(size[0]) if len(size) else 0), "left")


def expected(start: np.ndarray, move: np.ndarray, ratio: np.ndarray, sym: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected starts, moves and emissions (symbols x states) of texts that lie one behind the other in
    `sym`, and their log probability against that of independent symbols."""
    turned, at, many, order = _turn(sym, length)
    states = ratio.shape[1]
    ahead, log, scale = ratio[turned], 0.0, {}
    rows = np.empty_like(ahead)
    np.multiply(ahead[: len(order)], start, out=rows[: len(order)])
    for t in range(1, len(at)):
        lo, n = at[t], many[t]
        a = rows[lo : lo + n]
        np.matmul(rows[at[t - 1] : at[t - 1] + n], move, out=a)
        a *= ahead[lo : lo + n]
        if t % _EVERY == 0:
            scale[t] = np.maximum(a.sum(1, keepdims=True), 1e-30)
            a /= scale[t]
            log += float(np.log(scale[t]).sum())
    ends = np.array(at, np.int64)[length[order] - 1] + np.arange(len(order))
    last = np.maximum(rows[ends].sum(1, keepdims=True), 1e-30)
    log += float(np.log(last).sum())
    beta = np.repeat(1 / last, states, 1)
    moves, back = np.zeros((states, states)), np.ascontiguousarray(move.T)
    for t in range(len(at) - 1, 0, -1):
        lo, n = at[t], many[t]
        b, w = beta[:n], ahead[lo : lo + n]
        w *= b
        if t in scale:
            w /= scale[t]
        rows[lo : lo + n] *= b
        moves += rows[at[t - 1] : at[t - 1] + n].T @ w
        np.matmul(w, back, out=b)
    rows[: len(order)] *= beta
    emissions = np.stack([np.bincount(turned, rows[:, s], len(ratio)) for s in range(states)], 1)
    return rows[: len(order)].sum(0).astype(np.float64), moves * move, emissions, log


def _estimate(starts: np.ndarray, moves: np.ndarray, emissions: np.ndarray, unigram: np.ndarray) -> Model:
    states = len(starts)
    start = (starts + 1) / (starts.sum() + states)
    move = (moves + 1) / (moves.sum(1, keepdims=True) + states)
    # symbols that were never seen keep their share of the corpus's distribution in every state
    seen, share = emissions.sum(1) > 0, emissions.sum(0) / max(emissions.sum(), 1e-30)
    emit = np.repeat(unigram[:, None], states, 1)
    own = emissions[seen] + PULL * unigram[seen, None] + OWN * share
    emit[seen] = own / np.maximum(own.sum(0), 1e-30) * unigram[seen].sum()
    return Model(start.astype(np.float32), move.astype(np.float32), emit.astype(np.float32))


def _first_model(v: Vocabulary, states: int) -> Model:
    """The corpus's distribution in every state, each entry times a random number."""
    unigram = v.unigram()
    noise = np.random.default_rng(11).exponential(size=(v.size, states))
    return _estimate(np.ones(states), np.eye(states) * 20.0 * states, v.total * unigram[:, None] * noise, unigram)


def train(docs: DataFrame, states: int = STATES) -> tuple[Vocabulary, Model, DataFrame]:
    """The vocabulary, the model and the stored counts (word, ending, n) of `docs` (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counts = common.stored(word_counts(docs), "word-counts")
    v = vocabulary(counts, docs.count())
    with common.scratch(docs.sparkSession) as keep:
        return v, _learned(stored_symbols(docs, v, keep), v, _first_model(v, states)), counts


def _learned(texts: DataFrame, v: Vocabulary, model: Model) -> Model:
    """`model` after all slices of `texts` one by one, then after all of them at once."""
    unigram, sums = v.unigram(), None
    for k in range(SLICES):
        found, size = _sums(texts.where(F.col("slice") == k), v, model)
        if size:
            whole = [x * (v.total / size) for x in found]
            sums = whole if sums is None else [(1 - RATE) * a + RATE * b for a, b in zip(sums, whole, strict=True)]
            model = _estimate(*sums, unigram)
    return _estimate(*_sums(texts, v, model)[0], unigram)


def stored_symbols(docs: DataFrame, v: Vocabulary, keep) -> DataFrame:
    """(sym, lengths, slice) of all texts of `docs`, some texts a row: what Baum-Welch reads."""
    shared = docs.sparkSession.sparkContext.broadcast(v)
    kind = "sym binary, lengths binary, slice int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slices = batch.column(1).to_numpy(zero_copy_only=False)
            for lo, hi, code, owner, ending in _words(batch):
                sym, _, length = symbols(shared.value, code, owner, ending, hi - lo)
                of = np.repeat(slices[lo:hi], length)
                for k in np.unique(slices[lo:hi]).tolist():
                    own, size = sym[of == k], length[slices[lo:hi] == k]
                    stop = np.cumsum(size)
                    first, a = stop - size, 0
                    while a < len(size):
                        b = max(a + 1, int(np.searchsorted(stop, first[a] + ROW_SYMBOLS, "right")))
                        cols = [pa.array([x.astype("<u4").tobytes()], pa.binary()) for x in (own[first[a] : stop[b - 1]], size[a:b])]
                        yield pa.RecordBatch.from_arrays([*cols, pa.array([k], pa.int32())], ["sym", "lengths", "slice"])
                        a = b

    rows = docs.select("text", F.pmod(F.xxhash64("text", F.lit(3)), F.lit(SLICES)).cast("int").alias("slice")).mapInArrow(run, kind)
    return keep(rows, "symbols", "slice")


def _sums(texts: DataFrame, v: Vocabulary, model: Model) -> tuple[list[np.ndarray], int]:
    """Expected starts, moves and emissions of `texts` under `model`, and how many symbols they have:
    each task adds up its own, blocks meet by number."""
    states, v_size = model.emit.shape[1], v.size
    now = texts.sparkSession.sparkContext.broadcast(against(model, v.unigram()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, moves, emissions, size = np.zeros(states), np.zeros((states, states)), np.zeros((v_size, states)), 0
        for sym, length in _symbol_steps(batches):
            s, m, e, _ = expected(*now.value, sym, length)
            starts += s
            moves += m
            emissions += e
            size += len(sym)
        if not size:
            return
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([np.concatenate([starts, moves.ravel(), [size]]).tobytes()])], ["block", "sums"])
        used = [b for b in range(0, v_size, _BLOCK) if emissions[b : b + _BLOCK].any()]
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([emissions[b : b + _BLOCK].astype(np.float32).tobytes() for b in used], pa.binary())], ["block", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, sums in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                part = np.frombuffer(sums, np.float64 if b < 0 else np.float32).astype(np.float64)
                total[b] = total[b] + part if b in total else part
        for b, sums in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([sums.tobytes()])], ["block", "sums"])

    heads, emissions = np.zeros(states + states * states + 1), np.zeros((v_size, states))
    with common.small_batches(texts.sparkSession, 256):
        parts = texts.select("sym", "lengths").mapInArrow(run, "block int, sums binary")
        blocks = parts.repartition(common.shuffle_partitions(texts.sparkSession), "block").mapInArrow(add, "block int, sums binary")
        found = blocks.toArrow()  # at most a row a block: of one size whatever the texts
    for b, sums in zip(found.column(0).to_pylist(), found.column(1).to_pylist(), strict=True):
        if b < 0:
            heads = np.frombuffer(sums)
        else:
            emissions[b : b + _BLOCK] = np.frombuffer(sums).reshape(-1, states)
    now.destroy()
    return [heads[:states], heads[states:-1].reshape(states, states), emissions], int(heads[-1])


def _symbol_steps(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Symbols and lengths of the stored rows, about STEP_SYMBOLS at once."""
    held, size = [], 0
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            held.append([np.frombuffer(x, "<u4") for x in row])
            size += len(held[-1][0])
            if size >= STEP_SYMBOLS:
                yield tuple(np.concatenate(x).astype(np.int64) for x in zip(*held, strict=True))
                held, size = [], 0
    if held:
        yield tuple(np.concatenate(x).astype(np.int64) for x in zip(*held, strict=True))


def score(docs: DataFrame, v: Vocabulary, model: Model, counts: DataFrame) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score (log10) of every row."""
    spark = docs.sparkSession
    shared, trained = spark.sparkContext.broadcast(v), spark.sparkContext.broadcast(against(model, v.unigram()))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), F.col("text").cast("string").alias("text"))
    nat = math.log(10)

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, m = shared.value, trained.value
        heads, alone = len(v.head), np.log(v.unigram())
        # log10 of the count of a head word or the end; for an ending, minus log10 of its words' mass
        gain = np.log10(np.concatenate([v.head_counts, np.zeros(ENDINGS), [v.texts]]) + SMOOTH)
        gain[heads : heads + ENDINGS] = 0
        mass = np.zeros(v.size)
        mass[heads : heads + ENDINGS] = -np.log10(v.ending_total + SMOOTH * (v.ending_distinct + 1))
        known = np.ones(v.size)
        known[heads : heads + ENDINGS] = 0
        known[-1] = v.texts > 0
        for batch in batches:
            for lo, hi, code, owner, ending in _words(batch):
                sym, first, length = symbols(v, code, owner, ending, hi - lo)
                log = (forward(*m, sym, length) + np.add.reduceat(alone[sym], first)) / nat
                sums = [np.add.reduceat(x[sym], first) for x in (gain, mass, known)]
                cols = [pa.array(length), pa.array(sums[2].astype(np.int64)), pa.array(sums[0]), pa.array(log + sums[1])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), *cols], ["doc_id", "h", "n_tokens", "known", "gain", "log"])

    rows = docs.mapInArrow(own, "doc_id long, h long, n_tokens long, known long, gain double, log double")
    alike = rows.groupBy("doc_id", "h").agg(*(F.first(c).alias(c) for c in ("n_tokens", "known", "gain", "log")), F.count("*").alias("rows"))
    sums = _rare_sums(docs, v, shared, counts).withColumnsRenamed({"doc_id": "of", "h": "of_h"})
    both = alike.join(sums, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("h") == F.col("of_h")), "left")
    rare, met = (F.coalesce(F.col(c), F.lit(0)) / F.col("rows") for c in ("rare_gain", "rare_known"))
    base = F.col("gain") + rare - F.col("n_tokens") * math.log10(v.total + SMOOTH * (v.distinct + 1))
    return both.select(
        "doc_id", "n_tokens", (F.col("known") + met).cast("long").alias("n_known"), base.alias("base_score"), (F.col("log") + rare).alias("score"), F.explode(F.array_repeat(F.lit(1), F.col("rows").cast("int"))).alias("_one")
    ).drop("_one")


def _rare_sums(docs: DataFrame, v: Vocabulary, shared, counts: DataFrame) -> DataFrame:
    """(doc_id, h, rare_gain, rare_known): over words beyond the head, log10(count + SMOOTH) and how many are known."""
    buckets = max(BUCKETS, math.ceil((v.distinct - len(v.head)) / BUCKET_WORDS))
    kind = "bucket int, side int, words binary, numbers binary, doc_ids binary, hashes binary"
    names = ["bucket", "side", "words", "numbers", "doc_ids", "hashes"]

    def split(code, *rest):
        bucket = (common.mix(code) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        edge = np.searchsorted(bucket[order], np.arange(buckets + 1))
        for b in np.flatnonzero(np.diff(edge)).tolist():
            at = order[edge[b] : edge[b + 1]]
            yield b, code[at], *(x[at] for x in rest)

    def table(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            code = code.view(np.uint64)
            rare = ~np.isin(code, shared.value.head)
            for b, words, number in split(code[rare], n[rare]):
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([0], pa.int32()), pa.array([words.tobytes()]), pa.array([number.tobytes()]), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary())], names)

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).is_null(), batch.column(0).fill_null(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            null = ids[0].to_numpy(zero_copy_only=False)
            for lo, hi, code, owner, _ in _words(batch):
                head = shared.value.head
                at = np.minimum(np.searchsorted(head, code), max(0, len(head) - 1))
                rare = head[at] != code if len(head) else np.ones(len(code), bool)
                for b, words, of in split(code[rare], owner[rare]):
                    rows, n = np.unique(of, return_counts=True)
                    doc = np.stack([ids[1][lo:hi][rows], null[lo:hi][rows].astype(np.int64)])
                    cols = [[words.tobytes()], [n.astype("<u4").tobytes()], [doc.tobytes()], [ids[2][lo:hi][rows].tobytes()]]
                    yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([1], pa.int32()), *(pa.array(c, pa.binary()) for c in cols)], names)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, words, log = None, [], None, None
        for batch in batches:
            for b, side, w, n, ids, hashes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if b != now:
                    now, parts, words = b, [], None
                if side == 0:
                    parts.append((np.frombuffer(w, np.uint64), np.frombuffer(n, np.int64)))
                    continue
                if words is None:
                    words, n_all = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.empty(0, np.uint64), np.empty(0, np.int64))
                    order = np.argsort(words)
                    words, log, parts = words[order], np.log10(n_all[order] + SMOOTH), []
                own = np.frombuffer(w, np.uint64)
                at = np.minimum(np.searchsorted(words, own), max(0, len(words) - 1))
                known = words[at] == own if len(words) else np.zeros(len(own), bool)
                gain = np.where(known, log[at], math.log10(SMOOTH)) if len(words) else np.full(len(own), math.log10(SMOOTH))
                first = np.cumsum(n := np.frombuffer(n, "<u4").astype(np.int64)) - n
                doc, null = np.frombuffer(ids, np.int64).reshape(2, -1)
                cols = [pa.array(doc, mask=null.astype(bool)), pa.array(np.frombuffer(hashes, np.int64)), pa.array(np.add.reduceat(gain, first)), pa.array(np.add.reduceat(known.astype(np.int64), first))]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "h", "gain", "known"])

    rows = counts.select("word", "n").mapInArrow(table, kind).union(docs.mapInArrow(texts, kind))
    met = rows.repartition(common.shuffle_partitions(docs.sparkSession), "bucket").sortWithinPartitions("bucket", "side").mapInArrow(meet, "doc_id long, h long, gain double, known long")
    return met.groupBy("doc_id", "h").agg(F.sum("gain").alias("rare_gain"), F.sum("known").alias("rare_known"))


def op6_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10 == 0
    v, model, counts = train(docs.where(~held))
    found = score(docs, v, model, counts)
    return found.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(v.total).cast("long").alias("train_tokens"), "base_score", "score")
