"""Token files of directly addressable codes.

Each id is cut into chunks of a fixed number of bits, the lowest first. Level 0 holds one chunk for
every id of a shard and a bitmap of the ids that go on; level 1 holds the next chunk of those, and
so on. A directory of counts before each block of a bitmap gives rank in constant time, so any id is
read from one chunk a level, without decoding its neighbours.

File format: a Parquet dataset with one row a shard. Rows of one `bucket` (a range of doc_id and hash) are
shards of ascending doc_id; `bucket_start` counts the ids of its bucket before it. `codes` is

    uint32 levels, then per level: uint32 n, n chunks (uint8 or uint16),
    ceil(n / 8) bytes of bitmap (lowest bit first), uint32 ranks for every RANK_BLOCK bits.

Null text: no ids but the end id. Repeated rows are kept. Null doc_ids come first; rows of one doc_id
follow by the hash of their ids, and a doc_id (or null) with many rows fills several ranges. An empty
table makes an empty dataset.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, tokens

RANK_BLOCK = 512
#: Ids after which a shard ends with its document, and rows of documents in a range of doc_id.
SHARD_IDS = 1 << 20
BUCKET_ROWS = 2_000
MOST_BUCKETS = 50_000

SHARD_SCHEMA = "bucket int, shard int, bucket_start long, n_tokens long, doc_ids array<long>, doc_starts array<long>, codes binary"


# --- the code ------------------------------------------------------------------------------------


def pack_codes(ids: np.ndarray, bits: int = 8) -> bytes:
    """The chunk levels of `ids`; bits: 8 or 16."""
    kind = {8: np.uint8, 16: np.uint16}[bits]
    rest, out, levels = ids.astype(np.uint32), [], 0
    while levels == 0 or len(rest):
        chunk = (rest & np.uint32((1 << bits) - 1)).astype(kind)
        more = (rest >> np.uint32(bits)) > 0
        bitmap = np.packbits(more, bitorder="little")
        blocks = np.add.reduceat(more, np.arange(0, len(more), RANK_BLOCK), dtype=np.uint32) if len(more) else np.empty(0, np.uint32)
        ranks = (np.cumsum(blocks, dtype=np.uint32) - blocks).astype("<u4")
        out += [np.uint32(len(rest)).tobytes(), chunk.astype(f"<u{bits // 8}").tobytes(), bitmap.tobytes(), ranks.tobytes()]
        rest, levels = rest[more] >> np.uint32(bits), levels + 1
    return np.uint32(levels).tobytes() + b"".join(out)


class Codes:
    """A reader of `pack_codes`: `[i]` for one id, `decode(lo, hi)` for a stretch."""

    def __init__(self, packed: bytes, bits: int = 8):
        self.bits, at = bits, 4
        self.levels = []
        for _ in range(int(np.frombuffer(packed, "<u4", 1)[0])):
            n = int(np.frombuffer(packed, "<u4", 1, at)[0])
            chunks = np.frombuffer(packed, f"<u{bits // 8}", n, at + 4)
            at += 4 + n * bits // 8
            bitmap = np.frombuffer(packed, np.uint8, -(-n // 8), at)
            at += -(-n // 8)
            ranks = np.frombuffer(packed, "<u4", -(-n // RANK_BLOCK), at)
            at += 4 * len(ranks)
            self.levels.append((chunks, bitmap, ranks))

    def __len__(self) -> int:
        return len(self.levels[0][0])

    def _rank(self, level: int, i: int) -> int:
        """Ids of a level before place i that go on."""
        _, bitmap, ranks = self.levels[level]
        if i >= len(self.levels[level][0]):
            return len(self.levels[level + 1][0]) if level + 1 < len(self.levels) else 0
        block = i // RANK_BLOCK
        bits = np.unpackbits(bitmap[block * RANK_BLOCK // 8 : i // 8 + 1], bitorder="little")
        return int(ranks[block]) + int(bits[: i - block * RANK_BLOCK].sum())

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < len(self):
            raise IndexError(i)
        value = 0
        for level, (chunks, bitmap, _) in enumerate(self.levels):
            value |= int(chunks[i]) << self.bits * level
            if not bitmap[i // 8] >> (i % 8) & 1:
                break
            i = self._rank(level, i)
        return value

    def decode(self, lo: int = 0, hi: int | None = None) -> np.ndarray:
        hi = len(self) if hi is None else hi
        spans = []
        for level, (chunks, bitmap, _) in enumerate(self.levels):
            more = np.unpackbits(bitmap[lo // 8 : -(-hi // 8)], bitorder="little")[lo - lo // 8 * 8 :][: hi - lo].astype(bool)
            spans.append((chunks[lo:hi], more))
            if level + 1 < len(self.levels):
                lo, hi = self._rank(level, lo), self._rank(level, hi)
        value = np.empty(0, np.uint32)
        for chunks, more in reversed(spans):
            own = chunks.astype(np.uint32)
            own[more] |= value << np.uint32(self.bits)
            value = own
        return value


# --- Spark jobs ----------------------------------------------------------------------------------


def hash_ids(ids: list[bytes]) -> np.ndarray:
    """32 evenly spread bits each: the order of documents that share a doc_id."""
    return (common.mix(np.fromiter(map(zlib.crc32, ids), np.uint64, len(ids))) >> np.uint64(32)).astype(np.int64)


def encode_texts(docs: DataFrame, tokenizer: str, end_id: int | None, cuts: np.ndarray) -> DataFrame:
    """bucket, doc_id, part (hash of the ids), n, ids (packed little-endian in as few of 2 or 4 bytes as the vocabulary takes)."""
    path = tokens.tokenizer_path(tokenizer) if "/" not in tokenizer else tokenizer

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokens.encoder(path)
        end = b"" if end_id is None else np.array([end_id], enc.dtype).tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                keys = part.column(0)
                ids = [enc.encode(t or "") + end for t in part.column(1).to_pylist()]
                hashes = hash_ids(ids)
                bucket = common.range_of(cuts, keys, hashes)
                n = np.fromiter(map(len, ids), np.int64, len(ids)) // enc.dtype.itemsize
                yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), keys, pa.array(hashes), pa.array(n), pa.array(ids, pa.binary())], ["bucket", "doc_id", "part", "n", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "bucket int, doc_id long, part long, n long, ids binary")


def write_token_files(docs: DataFrame, path: str, tokenizer: str = "byte_bpe_50k.json", end_id: int = 0, bits: int = 8, shard_ids: int = SHARD_IDS) -> None:
    """Encodes `docs` (doc_id, text) and writes the shards, ascending doc_id, as the dataset `path`."""
    rows = docs.count()
    buckets = max(1, min(MOST_BUCKETS, math.ceil(rows / BUCKET_ROWS)))
    cuts = common.range_cuts(docs, "doc_id", buckets)
    wide = np.dtype("<u2") if tokens.encoder(tokens.tokenizer_path(tokenizer) if "/" not in tokenizer else tokenizer).vocabulary <= 1 << 16 else np.dtype("<u4")

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, number, before = None, 0, 0
        doc_ids: list = []
        sizes: list[int] = []
        parts: list[bytes] = []

        def flush() -> pa.RecordBatch:
            ends = np.cumsum(sizes)
            codes = pack_codes(np.frombuffer(b"".join(parts), wide), bits)
            row = {"bucket": bucket, "shard": number, "bucket_start": before, "n_tokens": int(ends[-1]), "doc_ids": list(doc_ids), "doc_starts": (ends - sizes).tolist(), "codes": codes}
            kinds = pa.schema([("bucket", pa.int32()), ("shard", pa.int32()), ("bucket_start", pa.int64()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_starts", pa.list_(pa.int64())), ("codes", pa.binary())])
            return pa.RecordBatch.from_pylist([row], kinds)

        held = 0
        for batch in batches:
            for b, doc_id, n, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if doc_ids and (b != bucket or held >= shard_ids):
                    yield flush()
                    number, before = number + 1, before + held
                    doc_ids.clear(), sizes.clear(), parts.clear()
                    held = 0
                if b != bucket:
                    bucket, number, before = b, 0, 0
                doc_ids.append(doc_id)
                sizes.append(n)
                parts.append(ids)
                held += n
        if doc_ids:
            yield flush()

    encoded = encode_texts(docs, tokenizer, end_id, cuts)
    sorted_docs = encoded.repartition(common.shuffle_partitions(docs.sparkSession), "bucket").sortWithinPartitions("bucket", "doc_id", "part", "ids").drop("part")
    sorted_docs.mapInArrow(shards, SHARD_SCHEMA).write.parquet(path)


def open_token_files(spark: SparkSession, path: str) -> tuple[DataFrame, dict[int, int]]:
    """The shards and, for each bucket (at most MOST_BUCKETS), the number of ids before it."""
    files = spark.read.schema(SHARD_SCHEMA).parquet(path)
    total, starts = 0, {}
    for b, n in sorted(files.groupBy("bucket").agg(F.sum("n_tokens")).collect()):
        starts[b], total = total, total + n
    return files, starts


def read_documents(spark: SparkSession, path: str, bits: int = 8, with_ids: bool = True) -> DataFrame:
    """Every document out of the files: doc_id, start, n_tokens, ids_crc32, ids (array of int)."""
    files, starts = open_token_files(spark, path)
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                codes = Codes(row["codes"], bits)
                at = np.array([*row["doc_starts"], row["n_tokens"]], np.int64)
                ids = codes.decode().astype("<u4")
                own = [ids[lo:hi] for lo, hi in zip(at[:-1], at[1:], strict=True)]
                cols = [pa.array(row["doc_ids"], pa.int64()), pa.array(at[:-1] + starts[row["bucket"]] + row["bucket_start"]), pa.array(np.diff(at)), pa.array([zlib.crc32(x.tobytes()) for x in own], pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    cols, names = [*cols, pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int32)))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(cols, names)

    return files.drop("shard").mapInArrow(run, schema)


def read_tokens(spark: SparkSession, path: str, wanted: DataFrame, bits: int = 8) -> DataFrame:
    """Random access: `wanted` (position long, counted over all files) -> position, token int.

    Only the shard of a position is opened, and in it one chunk a level. Positions past the end
    give no row.
    """
    files, starts = open_token_files(spark, path)
    edges = np.array([*starts.values()], np.int64)
    names = np.array([*starts], np.int64)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = batch.column(0).drop_null().to_numpy(zero_copy_only=False)
            k = np.searchsorted(edges, p, "right") - 1
            ok = k >= 0
            yield pa.RecordBatch.from_arrays([pa.array(p[ok]), pa.array(names[k[ok]].astype(np.int32)), pa.array(p[ok] - edges[k[ok]])], ["position", "bucket", "inside"])

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for packed, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                codes = Codes(packed, bits)
                yield pa.RecordBatch.from_arrays([pa.array([w["position"] for w in own], pa.int64()), pa.array([codes[w["i"]] for w in own], pa.int32())], ["position", "token"])

    where = wanted.select(F.col("position").cast("long")).mapInArrow(place, "position long, bucket int, inside long")
    index = files.select("bucket", "shard", "bucket_start", "n_tokens")
    hit = where.join(index, "bucket").where("inside >= bucket_start and inside < bucket_start + n_tokens")
    per_shard = hit.groupBy("bucket", "shard").agg(F.collect_list(F.struct("position", (F.col("inside") - F.col("bucket_start")).cast("int").alias("i"))).alias("wanted"))
    return files.join(per_shard, ["bucket", "shard"]).select("codes", "wanted").mapInArrow(pick, "position long, token int")


def op8_directly_addressable_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.shared_path(spark, "token-files")
    write_token_files(common.read(spark, sf_dir, "documents"), path)
    return read_documents(spark, path, with_ids=False)
