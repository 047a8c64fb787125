"""Benchmark decontamination by winnowing.

Of every run of `span` words the smallest of its k-gram hashes is kept (the last on ties), with
k + w - 1 = span. A text that holds a benchmark window keeps the same k-gram at the same place in it,
so every shared span of at least `span` words meets in the fingerprints. Items of fewer words are one
window and fingerprint themselves (k = their length, w = 1).

Fingerprints of the benchmark fill a bitmap of fixed size that tasks look into; document windows
whose fingerprint may occur are joined with the benchmark's windows on 128 bits of hash, which
extends each hit over every window that it stands for. The bitmap only thins the join: were it full,
the join would carry more and find the same.

Null text: no words. Repeated rows come back repeated. Items without words match nothing; a null
item_id counts as the empty string; repeated items count once. Empty tables give no rows, or rows
without hits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SPAN, K = 10, 5
FILTER_BITS = 1 << 24

_WINDOWS = "n_words long, start int, size int, h1 long, h2 long"
_SALT = np.uint64(0xA0761D6478BD642F)


def _windows(code: np.ndarray, size: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each window of `size` words: its fingerprint and two hashes of all its words."""
    finger = common.grams(code, k)
    chosen = finger[common.sliding_min_last(finger, size - k + 1)] if size > k else finger
    return chosen ^ np.uint64(size), common.grams(code, size), common.grams(common.mix(code ^ _SALT), size)


def _rows(batch: pa.RecordBatch, carried: list[str], pick) -> Iterator[pa.RecordBatch]:
    """A row without a window for each text, and one for each window that `pick` chooses."""
    for lo, hi, data, offsets in common.text_steps(batch, "text"):
        code, owner, _, _ = common.words(data, offsets, common.ALNUM)
        first, count = common.by_doc(code, owner, hi - lo)
        found = [(np.arange(hi - lo), np.full(hi - lo, -1), np.zeros(hi - lo, np.int64), np.zeros(hi - lo, np.uint64), np.zeros(hi - lo, np.uint64))]
        for size, at, h1, h2 in pick(code, owner, count):
            found.append((owner[at], at - first[owner[at]], np.full(len(at), size), h1, h2))
        row, start, size, h1, h2 = (np.concatenate(x) for x in zip(*found, strict=True))
        own = [batch.column(batch.schema.get_field_index(c)).slice(lo, hi - lo).take(pa.array(row)) for c in carried]
        cols = [pa.array(count[row]), pa.array(start.astype(np.int32), mask=start < 0), pa.array(size.astype(np.int32)), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64))]
        yield pa.RecordBatch.from_arrays([*own, *cols], [*carried, "n_words", "start", "size", "h1", "h2"])


def item_windows(items: DataFrame, span: int = SPAN, k: int = K) -> DataFrame:
    """Distinct windows of (item_id, text): size, h1, h2, finger, item_ids (sorted array)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pick(code, owner, count):
            for size in range(1, span + 1):
                finger, h1, h2 = _windows(code, size, k if size == span else size)
                at = np.arange(len(h1))
                at = at[(owner[at] == owner[at + size - 1]) & ((count[owner[at]] == size) if size < span else True)]
                fingers[size] = finger[at]
                yield size, at, h1[at], h2[at]

        for batch in batches:
            fingers: dict[int, np.ndarray] = {}
            for out in _rows(batch, ["item_id"], pick):
                texts = out.num_rows - sum(map(len, fingers.values()))
                finger = np.concatenate([np.zeros(texts, np.uint64), *fingers.values()])
                yield out.append_column("finger", pa.array(finger.view(np.int64)))
                fingers.clear()

    source = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.col("text").cast("string").alias("text"))
    rows = source.mapInArrow(run, f"item_id string, {_WINDOWS}, finger long").where("start is not null")
    return rows.groupBy("size", "h1", "h2").agg(F.first("finger").alias("finger"), F.array_sort(F.collect_set("item_id")).alias("item_ids"))


def fingerprint_bitmap(windows: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """Which of `bits` values the fingerprints take; of that size whatever the benchmark's."""
    bit = F.pmod("finger", F.lit(bits))
    words = windows.select((bit / 64).cast("int").alias("w"), F.expr("shiftleft(1L, cast(pmod(finger, 64) as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).collect()
    out = np.zeros(bits // 64, np.int64)
    for w, b in words:
        out[w] = b
    return out.view(np.uint8)


def contamination(docs: DataFrame, items: DataFrame, span: int = SPAN, k: int = K, filter_bits: int = FILTER_BITS) -> DataFrame:
    """One row a document: doc_id, n_words, n_hit, windows (start, size of each hit), item_ids, and
    text_hash, the xxhash64 of the text."""
    windows = common.stored(item_windows(items, span, k), "windows")
    sizes = [r[0] for r in windows.select("size").distinct().collect()]  # at most `span`
    bitmap = fingerprint_bitmap(windows, filter_bits)
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value

        def pick(code, owner, count):
            for size in sizes:
                finger, h1, h2 = _windows(code, size, k if size == span else size)
                place = finger & np.uint64(filter_bits - 1)
                may = table[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8) & 1
                at = np.flatnonzero(may)
                at = at[owner[at] == owner[at + size - 1]]
                yield size, at, h1[at], h2[at]

        for batch in batches:
            yield from _rows(batch, ["doc_id", "_text"], pick)

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("_text"), F.col("text").cast("string").alias("text"))
    rows = source.mapInArrow(run, f"doc_id long, _text long, {_WINDOWS}")
    # rows without a window join too, each by a key of its own, so that one pass gives all
    rows = rows.withColumn("h1", F.expr("if(start is null, xxhash64(doc_id, _text), h1)"))
    hits = rows.join(windows.drop("finger"), ["size", "h1", "h2"], "left")
    found = hits.groupBy("doc_id", "_text").agg(
        F.max("n_words").alias("n_words"),
        F.expr("count_if(start is null)").alias("_rows"),
        F.expr("array_sort(collect_set(case when item_ids is not null then struct(start, size) end))").alias("windows"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("item_ids")))).alias("item_ids"),
    )
    covered = F.expr("aggregate(windows, struct(0L as n, 0 as upto), (a, w) -> struct(a.n + greatest(0, w.start + w.size - greatest(w.start, a.upto)) as n, greatest(a.upto, w.start + w.size) as upto), a -> a.n)")
    return found.select("doc_id", "n_words", covered.alias("n_hit"), "windows", "item_ids", F.col("_text").alias("text_hash"), F.explode(F.array_repeat(F.lit(1), F.col("_rows").cast("int"))).alias("_one")).drop("_one")


def op4_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )
