"""Vector best-fit packing of token pieces into sequences.

A piece takes three things from a sequence: its tokens, one document, and its attention cost (the
square of its length). A piece goes to the open sequence that fits best under every capacity, by
weighted dot-product (largest) or by residual norm (smallest); if none fits, a new one is opened.

All three demands follow from a piece's length, so pieces of one length are alike. The plan is made
from the histogram of lengths, at most `capacity` rows however large the corpus: longest first,
whole runs of equal pieces at once. The plan says which ranks of each length share a sequence;
pieces then find their places by their rank, spread over salted groups of each length.

A document is cut only if it is longer than the capacity: its first piece takes the remainder, all
others are full. Null text: the end id alone. Repeated rows are packed again. No rows: no pieces.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, tokens

#: Pieces of one length that are ranked together, about.
RANK_GROUP = 20_000


@dataclass(frozen=True)
class Capacity:
    """What a sequence holds. Defaults leave the tokens as the only bound that ever binds."""

    tokens: int = 1024
    documents: int = 1024
    attention: int = 1024 * 1024
    weights: tuple[float, float, float] = (1.0, 1e-3, 1e-6)
    select: str = "norm"  # or "dot"


def plan(histogram: dict[int, int], cap: Capacity = Capacity()) -> list[tuple[int, int, int, int, int, int]]:
    """Slots (length, first rank, sequences, pieces in each, first sequence, offset in each).

    The r-th piece of a length within a slot goes to sequence first + r // pieces, at
    offset + r % pieces * length.
    """
    size = np.array([cap.tokens, cap.documents, cap.attention], np.float64)
    weights = np.array(cap.weights)
    residual = np.empty((0, 3), np.int64)
    count = np.empty(0, np.int64)
    content: list[tuple] = []
    closed: list[tuple[int, tuple]] = []
    for length in sorted(histogram, reverse=True):
        left, item = histogram[length], np.array([length, 1, length * length], np.int64)
        if (item > size).any():
            raise ValueError(f"a piece of {length} tokens exceeds the capacity of an empty sequence")
        while left:
            fits = np.flatnonzero((residual >= item).all(axis=1) & (count > 0))
            if len(fits):
                after = (residual[fits] - item) / size
                score = -(weights * after**2).sum(axis=1) if cap.select == "norm" else (weights * (item / size) * (residual[fits] / size)).sum(axis=1)
                k = int(fits[score.argmax()])
                base, bins, made = residual[k], int(count[k]), content[k]
            else:
                k, base, bins, made = -1, size.astype(np.int64), left, ()
            # one more of the same only fits the same sequence better under the norm
            each = int((base // item).min()) if cap.select == "norm" else 1
            each = min(each, left)
            use = min(bins, left // each)
            if k >= 0:
                count[k] -= use
            residual = np.vstack([residual, base - each * item])
            count = np.append(count, use)
            content.append((*made, (length, each)))
            left -= use * each
            if len(count) > 2048:  # only sequences that can still take a piece stay in the search
                live = (count > 0) & (residual.min(axis=1) > 0)
                closed += [(int(c), m) for c, m, a in zip(count, content, live, strict=True) if c and not a]
                content = [m for m, a in zip(content, live, strict=True) if a]
                residual, count = residual[live], count[live]
    return _slots(closed + [(int(c), m) for c, m in zip(count, content, strict=True) if c])


def _slots(bins: list[tuple[int, tuple]]) -> list[tuple[int, int, int, int, int, int]]:
    slots, ranks, sequence = [], {}, 0
    for number, made in bins:
        offset = 0
        for length, each in made:
            slots.append((length, ranks.get(length, 0), number, each, sequence, offset))
            ranks[length] = ranks.get(length, 0) + number * each
            offset += length * each
        sequence += number
    return slots


def cut(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, with_ids: bool) -> DataFrame:
    """The pieces of every text: doc_id, piece, start, length, ids_crc32[, ids]."""
    path = tokens.tokenizer_path(tokenizer) if "/" not in tokenizer else tokenizer

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokens.encoder(path)
        end = np.array([end_id], enc.dtype).tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = []
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    ids = np.frombuffer(enc.encode(text or "") + end, enc.dtype).astype("<u4")
                    edges = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
                    for k, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False)):
                        own = ids[lo:hi].tobytes()
                        rows.append((doc_id, k, lo, hi - lo, zlib.crc32(own), *[own] * with_ids))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                cols = [pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=False)]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(cols)])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def pack(pieces: DataFrame, cap: Capacity = Capacity()) -> DataFrame:
    """`pieces` (with doc_id, piece, length; a stored table) with sequence_id and offset."""
    histogram = {int(n): int(c) for n, c in pieces.groupBy("length").count().collect()}  # at most cap.tokens rows
    slots = np.array(sorted(plan(histogram, cap)), np.int64).reshape(-1, 6)
    first = np.searchsorted(slots[:, 0], np.arange(cap.tokens + 2))
    groups = max(64, math.ceil(sum(histogram.values()) / RANK_GROUP))

    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(groups)).cast("int"))
    sizes = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    inside = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "start")
    ranked = salted.withColumn("_rank", F.row_number().over(inside) - 1).join(starts, ["length", "_salt"])
    ranked = ranked.withColumn("_rank", F.col("_rank") + F.col("_first")).drop("_salt", "_first")
    names = [f.name for f in pieces.schema]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            length, rank = (of[n].to_numpy(zero_copy_only=False) for n in ("length", "_rank"))
            at = np.empty(len(length), np.int64)
            for n in np.unique(length).tolist():
                own = np.flatnonzero(length == n)
                at[own] = first[n] + np.searchsorted(slots[first[n] : first[n + 1], 1], rank[own], "right") - 1
            _, begin, _, each, sequence, offset = slots[at].T
            inner = rank - begin
            yield pa.RecordBatch.from_arrays([*(of[n] for n in names), pa.array(sequence + inner // each), pa.array(offset + inner % each * length)], [*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return ranked.mapInArrow(place, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", end_id: int = 2, cap: Capacity = Capacity(), with_ids: bool = False) -> DataFrame:
    """Every piece of `docs` (doc_id, text) with its sequence and place there."""
    longest = min(cap.tokens, math.isqrt(cap.attention))
    return pack(common.stored(cut(docs, tokenizer, end_id, longest, with_ids), "pieces"), cap)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, doc_ids, ids) of `packed` pieces with ids: what a training run reads. A group is one
    sequence, so at most its capacity in ids (little-endian unsigned 32-bit integers)."""
    parts = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("parts"))
    ids = F.aggregate("parts", F.lit(b"").cast("binary"), lambda out, x: F.concat(out, x["ids"]))
    return parts.select("sequence_id", F.col("parts.doc_id").alias("doc_ids"), ids.alias("ids"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(common.read(spark, sf_dir, "documents"))
