"""Document fingerprints: Merkle trees over paragraphs and sections.

Paragraphs are the lines of a text; a long line is cut at its sentences, and a long sentence behind
words whose hash says so, else an edit in a text of one line would change its only leaf.
Sections are runs of paragraphs, cut where a paragraph's hash says so, so that borders move with the
content and an edit changes only the branches above it. A leaf is a hash of a paragraph and its end, a
branch one of its children's hashes in order, the root one of all sections' hashes.

A fingerprint is `root|section:leaf.leaf|section:leaf...`, the root in hex, the others in base64 (about a
fifth of the text's bytes): equal roots mean equal texts, sections that differ say where, and their leaves
say which paragraphs. Likeness is the share of
leaves that two fingerprints share, as multisets, weighted alike: 2 shared / (leaves of both), 1 for
equal roots.

Null text: empty, with one empty leaf. Repeated rows are fingerprinted each; among rows of one doc_id
the next document follows by the hash of its text. Null doc_ids come first. Empty table: no rows.
"""

from __future__ import annotations

import math
import re
from base64 import urlsafe_b64encode
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

_PARAGRAPH = re.compile(r"[^\n]*\n|[^\n]+\Z")
_SENTENCE = re.compile(r".*?[.!?…。！？]+(?:\s+|\Z)|.+", re.DOTALL)
#: Characters of a line from which it is cut at sentences, and of a sentence from which at words.
LONG_LINE, LONG_SENTENCE = 40, 60
#: One word in so many ends a piece of a long sentence; a word is looked at in stretches of WORD characters.
CUT, WORD = 8, 200
SECTION = 8
#: Characters of a leaf (30 bits) and of a branch (60 bits) in a fingerprint.
LEAF, BRANCH = 5, 10
ROWS_A_BUCKET, MOST_BUCKETS = 500, 100_000


def _hash(data: bytes, size: int) -> bytes:
    return blake2b(data, digest_size=size).digest()


def paragraphs(text: str) -> list[str]:
    """The leaves' texts; joined they are the text."""
    out = []
    for line in _PARAGRAPH.findall(text):
        if len(line) < LONG_LINE:
            out.append(line)
            continue
        for sentence in _SENTENCE.findall(line):
            out += [sentence] if len(sentence) < LONG_SENTENCE else pieces(sentence)
    return out or [""]


def pieces(sentence: str) -> list[str]:
    out, start, at = [], 0, 0
    for word in sentence.split(" "):
        at += len(word) + 1
        if len(word) > WORD:
            out += [sentence[i : min(i + WORD, at)] for i in range(start, at, WORD)]
            start = at
        elif crc32(word.encode("utf-8", "surrogatepass")) % CUT == 0:
            out.append(sentence[start:at])
            start = at
    return [p for p in [*out, sentence[start:]] if p]


def fingerprint(text: str) -> str:
    leaves = [_hash(p.encode("utf-8", "surrogatepass"), 16) for p in paragraphs(text)]
    sections, start = [], 0
    for i, leaf in enumerate(leaves):
        if leaf[-1] % SECTION == 0 or i + 1 == len(leaves):
            own = leaves[start : i + 1]
            sections.append((_hash(b"".join(own), 16), own))
            start = i + 1
    root = _hash(b"".join(s for s, _ in sections), 16)
    return "|".join([root.hex(), *(f"{_short(s, BRANCH)}:{'.'.join([_short(x, LEAF) for x in own])}" for s, own in sections)])


def _short(digest: bytes, size: int) -> str:
    return urlsafe_b64encode(digest[:9])[:size].decode()


def likeness(a: str, b: str) -> float:
    """From two fingerprints alone, 0 to 1."""
    if a[:32] == b[:32]:
        return 1.0
    x, y = (Counter(leaf for s in f.split("|")[1:] for leaf in s.split(":")[1].split(".")) for f in (a, b))
    # branches with equal hashes need no look at their leaves, but their leaves count all the same
    return 2 * (x & y).total() / (x.total() + y.total())


def edits(a: str, b: str) -> list[tuple[int, int, int, int]]:
    """(first leaf, last + 1) in a and in b of what differs, going down only where branches differ."""
    from difflib import SequenceMatcher

    if a[:32] == b[:32]:
        return []
    parts = [[(s.split(":")[0], s.split(":")[1].split(".")) for s in f.split("|")[1:]] for f in (a, b)]
    starts = [np.cumsum([0, *(len(leaves) for _, leaves in p)]) for p in parts]
    found = []
    for op, i, j, k, l in SequenceMatcher(None, *([s for s, _ in p] for p in parts), autojunk=False).get_opcodes():  # noqa: E741
        if op != "equal":
            left, right = ([leaf for _, own in p[m:n] for leaf in own] for p, m, n in ((parts[0], i, j), (parts[1], k, l)))
            for op2, p, q, r, s in SequenceMatcher(None, left, right, autojunk=False).get_opcodes():
                if op2 != "equal":
                    found.append((int(starts[0][i]) + p, int(starts[0][i]) + q, int(starts[1][k]) + r, int(starts[1][k]) + s))
    return found


def fingerprints(docs: DataFrame) -> DataFrame:
    """`docs` (doc_id, text) -> doc_id, fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([fingerprint(t or "") for t in part.column(1).to_pylist()], pa.string())], ["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fingerprint string")


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text and the text of the next row by ascending (doc_id, hash of the text, text); after the
    last, the first.

    Rows are dealt to ranges of doc_id, and of the hash where one doc_id (or null) fills several. The
    first row of each range also goes to the range before, as the next of its last row.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.select("doc_id", F.shiftrightunsigned(F.xxhash64("text"), 32).alias("part"), "text")
    buckets = max(1, min(MOST_BUCKETS, math.ceil(docs.count() / ROWS_A_BUCKET)))
    cuts = common.range_cuts(rows, "doc_id", buckets)

    def lowest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, part = batch.column(0).fill_null(common.LOWEST).to_numpy(zero_copy_only=False), batch.column(1).to_numpy()
            bucket = common.range_of(cuts, batch.column(0), part)
            order = np.lexsort((part, key, bucket))
            order = order[np.unique(bucket[order], return_index=True)[1]]
            yield pa.RecordBatch.from_arrays([pa.array(bucket[order], pa.int32()), pa.array(key[order]), pa.array(part[order])], ["bucket", "key", "part"])

    # one row a range, at most MOST_BUCKETS
    firsts = rows.select("doc_id", "part").mapInArrow(lowest, "bucket int, key long, part long").groupBy("bucket").agg(F.min(F.struct("key", "part")).alias("f"))
    filled, first_key, first_part = np.array(sorted((b, f["key"], f["part"]) for b, f in firsts.collect()), np.int64).reshape(-1, 3).T

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, part = batch.column(0).fill_null(common.LOWEST).to_numpy(zero_copy_only=False), batch.column(1).to_numpy()
            bucket = common.range_of(cuts, batch.column(0), part)
            at = np.searchsorted(filled, bucket)
            extra = np.flatnonzero((key == first_key[at]) & (part == first_part[at]))
            # the range before; the first of all goes round to the last
            host = filled[at[extra] - 1]
            guest = np.where(at[extra] > 0, 1, 2)
            take = pa.array(np.concatenate([np.arange(len(key)), extra]))
            kinds = pa.array(np.concatenate([bucket, host]), pa.int32()), pa.array(np.concatenate([np.zeros(len(key), np.int64), guest]), pa.int32())
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(take) for i in range(3)), *kinds], ["doc_id", "part", "text", "bucket", "guest"])

    dealt = rows.mapInArrow(deal, "doc_id long, part long, text string, bucket int, guest int")
    order = Window.partitionBy("bucket").orderBy(F.col("guest") == 2, F.col("doc_id").asc_nulls_first(), "part", "text")
    return dealt.withColumn("next_text", F.lead("text").over(order)).where("guest = 0").select("doc_id", "text", F.coalesce("next_text", F.lit("")).alias("next_text"))


def op5_merkle_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_next(common.read(spark, sf_dir, "documents"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                own, edited, nxt = ([fingerprint(t) for t in part.column(i).to_pylist()] for i in (2, 3, 4))
                cols = [pa.array(x) for x in (own, edited, [likeness(a, b) for a, b in zip(own, edited, strict=True)], [likeness(a, b) for a, b in zip(own, nxt, strict=True)])]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(5), *cols], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    n = F.length("text")
    # the last floor(n / 4) characters go; as many, or all, of the next text's come
    edited = F.concat(F.expr("left(text, length(text) - cast(floor(length(text) / 4) as int))"), F.expr("left(next_text, cast(floor(length(text) / 4) as int))"))
    texts = rows.select("doc_id", n.cast("long").alias("n_chars"), "text", edited.alias("edited"), "next_text").withColumn("sha", F.sha2("edited", 256))
    return texts.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
