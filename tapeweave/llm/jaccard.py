"""Exact Jaccard self-join of shingle sets by universe partition and pigeonhole.

Two sets of x and y members with similarity of at least t differ in at most
H = (x + y)(1 - t)/(1 + t) members. The universe of shingles is dealt by hash into the segments of a
size band (sizes that differ by a factor of 2 at most; some 1.2 to 2.4 members a segment). Sets that
differ in H members differ in H segments at most; so of any H + 1 non-empty segments of one, one is the
same, member by member, in the other. A set that has partners in the next band is indexed there too.

Allocation by cost: a fixed-size count of shingles over the whole corpus prices each segment by its
rarest shingle, and a set indexes only its H + 1 cheapest segments in the order (price, hash), which
all sets share; two such prefixes always meet (the smallest common segment lies in both). Widely
shared passages are thus left out wherever a set has enough else. A set with too few non-empty
segments is indexed in a finer partition too, until it has enough. Where H is 1, the whole set and its
one-deletion neighbours are indexed instead.

Sets that share an entry are connected by a forest, first within a task, so that a group of any size
sends one entry a task; what hangs together is a cluster, and links only lie within clusters. Clusters
of more than GIANT sets are indexed once more with prices counted among themselves. Clusters of more
than a part are then cut by sketches: bits that each member of a set flips, so that two sets differ in
as many members as bits at least; what may still be alike stays together. Then whole sets are compared
within clusters: a cluster of up to PART sets in one task, exactly and finally; a larger
one in parts of that size, each with the same few heads, which tie together the parts of a group of
copies of any size. Sets that the largest such component of their cluster doesn't hold yet are then
compared with all sets of the cluster, block by block. Only forests of links leave a task, never pairs.
Equal sets are one class from the start.

A text's words are `[^ \\t-\\r]+` with A-Z lower-cased; fewer than `words` words: the sequence is one
shingle; none: an empty set, linked with nothing. Null text: empty. Repeated rows come back repeated
and share a component if they have words. Null doc_id: kept, and linked by its text alone.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WORDS = 5
PERCENT = 75
#: Counters of the corpus-wide count of shingles; index entries that a bucket holds, about, and that a
#: task groups before it sends them.
COUNTERS, BLOCKS = 1 << 22, 16
ENTRIES = 1_000_000
HELD = 400_000
#: Buckets of the connections that tasks have found among their own sets.
STARS = 64
#: Bytes of an entry's hash that are sent beside its bucket. With 4, sets of 1,500 members each met some other by chance.
SIG_BYTES = 5
#: Members of a segment, on average, in the largest sets of a band.
FILL = 2.4
#: Sets, and members of sets, that are compared with one another in one task, about; heads in each part.
PART, PART_MEMBERS, HEADS = 512, 1 << 20, 8
#: Links that one task connects at the end.
FEW = 100_000
#: Clusters of more sets are indexed again with their own prices.
GIANT = 4096
#: Sets, and bytes of sketches, in a block that is compared with another one by sketches; bits of a sketch, as powers of 2.
SKETCHED, SKETCH_BYTES, SKETCH_BITS = 1024, 1 << 22, (6, 17)
#: Loose sets in a block of the last comparison, and sets that meet them there.
LOOSE, OTHERS = 256, 1024

_TAG = np.uint64(0xE7037ED1A0B428DB)
_U = np.uint64


# --- sets ----------------------------------------------------------------------------------------


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingle, owner) of every distinct shingle of each text, ascending by owner and shingle."""
    code, owner, _, _ = common.words(data, offsets, common.SPACED)
    n = len(offsets) - 1
    first, count = common.by_doc(code, owner, n)
    gram = common.grams(code, k)
    keep = owner[: len(gram)] == owner[k - 1 :] if len(gram) else np.empty(0, bool)
    sh, of = gram[keep], owner[: len(gram)][keep]
    for size in range(1, k):  # shorter texts
        rows = np.flatnonzero(count == size)
        if len(rows):
            short = common.mix(common.grams(code, size)[first[rows]] + _U(size))
            sh, of = np.concatenate([sh, short]), np.concatenate([of, rows])
    order = np.lexsort((sh, of))
    sh, of = sh[order], of[order]
    fresh = np.ones(len(sh), bool)
    fresh[1:] = (sh[1:] != sh[:-1]) | (of[1:] != of[:-1])
    return sh[fresh], of[fresh]


def set_hashes(sh: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """One hash of each whole set, 0 for an empty one."""
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(common.mix(sh ^ _TAG), dtype=np.uint64)])
        return np.where(count > 0, common.mix(total[first + count] - total[first] + count.astype(np.uint64)), 0)


def most_apart(n: np.ndarray, percent: int) -> np.ndarray:
    """H for a set of n members and the largest partner it can have."""
    return (n + n * 100 // percent) * (100 - percent) // (100 + percent)


def index_entries(sh, of, n, price, percent: int, counters: int) -> tuple[np.ndarray, np.ndarray]:
    """(entry hash, owner) that each set is found by; `n`: members of each set."""
    first = np.cumsum(n) - n
    out, whose = [], []
    apart = most_apart(n, percent)
    # one deletion: partners of which H is 1
    least = n + -(-n * percent // 100)
    small = np.flatnonzero((apart >= 1) & (least * (100 - percent) // (100 + percent) <= 1))
    if len(small):
        rows = np.isin(of, small)
        part = common.mix(sh[rows] ^ _TAG)
        with np.errstate(over="ignore"):
            total = np.zeros(len(n), np.uint64)
            np.add.at(total, of[rows], part)
            out += [common.mix(total[small] + _U(1)), common.mix(total[of[rows]] - part + _U(1))]
        whose += [small, of[rows]]
    # segments, in each band that holds the set or its larger partners
    band = lambda x: np.frexp(np.maximum(x, 1))[1].astype(np.int64) - 1  # noqa: E731  of the power of 2 below
    own, upper = band(n), band(n * 100 // percent)
    for space, rows in ((own, apart >= 2), (upper, (apart >= 2) & (upper != own))):
        rows, level = np.flatnonzero(rows), 0
        while len(rows):
            segments = np.maximum(4, 2 ** (space + 1) / FILL).astype(np.int64) << (2 * level)
            member = np.zeros(len(n), bool)
            member[rows] = True
            at = np.flatnonzero(member[of])
            salt = (space * 64 + level).astype(np.uint64)
            m_of = segments[of[at]].astype(np.uint64)
            seg = ((common.mix(sh[at] + salt[of[at]]) >> _U(32)) * m_of) >> _U(32)
            order = np.lexsort((seg, of[at]))
            at, seg = at[order], seg[order]
            begins = np.ones(len(at), bool)
            begins[1:] = (seg[1:] != seg[:-1]) | (of[at][1:] != of[at][:-1])
            start = np.flatnonzero(begins)
            with np.errstate(over="ignore"):
                content = np.add.reduceat(common.mix(sh[at] ^ _TAG), start)
                owner = of[at][start]
                sig = common.mix(content + seg[start] * _U(0x9E3779B97F4A7C15) + salt[owner] * _U(0xC2B2AE3D27D4EB4F))
            cost = np.minimum.reduceat(price[(sh[at] & _U(counters - 1)).astype(np.int64)], start)
            key = (cost.astype(np.uint64) << _U(56)) | (sig >> _U(8))
            order = np.lexsort((key, owner))
            sig, owner = sig[order], owner[order]
            head, filled = common.by_doc(sig, owner, len(n))
            rank = np.arange(len(sig)) - np.repeat(head[filled > 0], filled[filled > 0])
            take = rank <= apart[owner]
            out.append(sig[take])
            whose.append(owner[take])
            rows = rows[filled[rows] <= apart[rows]]
            level += 1
    if not out:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.concatenate(out), np.concatenate(whose)


# --- jobs over the documents ---------------------------------------------------------------------


def _steps(batch: pa.RecordBatch, words: int):
    for lo, hi, data, offsets in common.text_steps(batch, "text"):
        sh, of = shingle_sets(data, offsets, words)
        first, count = common.by_doc(sh, of, hi - lo)
        yield lo, hi, sh, of, count, set_hashes(sh, first, count)


class _Counts:
    """Counts of shingles by their low bits, of fixed size; sent in blocks that are added up side by side."""

    kind = "block int, seen binary"

    def __init__(self):
        self.seen = np.zeros(COUNTERS, np.uint8)

    def add(self, sh: np.ndarray) -> None:
        at, n = np.unique((sh & _U(COUNTERS - 1)).astype(np.int64), return_counts=True)
        self.seen[at] = np.minimum(self.seen[at] + n, 255)  # a task's count ends there, which is frequent enough

    def blocks(self) -> Iterator[tuple[int, bytes]]:
        for b in range(0, COUNTERS, COUNTERS // BLOCKS):
            part = self.seen[b : b + COUNTERS // BLOCKS]
            if part.any():
                yield b, zlib.compress(part.tobytes(), 1)


def _prices(blocks: DataFrame) -> np.ndarray:
    """A price by the low bits of a shingle, from (block, seen) of all tasks.

    Counters are shared by all shingles of some bits, so what counts is how far one lies above the
    others, in standard deviations; in steps of a sixteenth of a power of two.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, seen in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                total.setdefault(b, np.zeros(COUNTERS // BLOCKS, np.int64))
                total[b] += np.frombuffer(zlib.decompress(seen.as_buffer()), np.uint8)
        for b, n in total.items():
            mid = float(np.median(n))
            z = (n - mid) / math.sqrt(mid + 1) + 4
            level = np.minimum(255, 16 * np.log2(1 + np.maximum(z, 0))).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([level.tobytes()])], ["block", "seen"])

    price = np.zeros(COUNTERS, np.uint8)
    for row in blocks.repartition(BLOCKS, "block").mapInArrow(add, _Counts.kind).toLocalIterator():
        price[row["block"] : row["block"] + COUNTERS // BLOCKS] = np.frombuffer(row["seen"], np.uint8)
    return price


def classes(docs: DataFrame, words: int, keep) -> tuple[DataFrame, np.ndarray]:
    """(doc_id, text_hash, n, class) of every row, and the prices of shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, names = _Counts(), ["doc_id", "text_hash", "n", "class", "block", "seen"]
        for batch in batches:
            for lo, hi, sh, _, count, whole in _steps(batch, words):
                counts.add(sh)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), pa.array(count), pa.array(whole.view(np.int64)), pa.nulls(hi - lo, pa.int32()), pa.nulls(hi - lo, pa.binary())], names)
        for b, seen in counts.blocks():
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([-1]), pa.nulls(1, pa.int64()), pa.array([b], pa.int32()), pa.array([seen])], names)

    rows = keep(docs.mapInArrow(run, f"doc_id long, text_hash long, n long, class long, {_Counts.kind}"), "classes")
    return rows.where("n >= 0").select("doc_id", "text_hash", "n", "class"), _prices(rows.where("seen is not null").select("block", "seen"))


def own_prices(texts: DataFrame, words: int) -> np.ndarray:
    """Prices of shingles counted in `texts` alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _Counts()
        for batch in batches:
            for _, _, sh, *_ in _steps(batch, words):
                counts.add(sh)
        for b, seen in counts.blocks():
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([seen])], ["block", "seen"])

    return _prices(texts.mapInArrow(run, _Counts.kind))


def _distinct(sig: np.ndarray, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries by hash and class without repeats."""
    order = np.lexsort((cls, sig))
    sig, cls = sig[order], cls[order]
    fresh = np.ones(len(sig), bool)
    fresh[1:] = (sig[1:] != sig[:-1]) | (cls[1:] != cls[:-1])
    return sig[fresh], cls[fresh]


def _forest(pairs: np.ndarray, head: dict[int, int]) -> np.ndarray:
    """Which rows of `pairs` (a, b) connect what neither they nor `head`, which they join, connect yet."""

    def find(x: int) -> int:
        while (up := head.get(x, x)) != x:
            head[x] = x = head.get(up, up)
        return x

    keep = np.zeros(len(pairs), bool)
    for k, (a, b) in enumerate(pairs.tolist()):
        if (x := find(a)) != (y := find(b)):
            head[max(x, y)] = min(x, y)
            keep[k] = True
    return pairs[keep]


def _stars(sig: np.ndarray, cls: np.ndarray) -> np.ndarray:
    """Distinct pairs (smallest of a group, other) of the groups of equal entries."""
    if not len(sig):
        return np.empty((0, 2), np.int64)
    start = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
    rep = np.repeat(cls[start], np.diff(np.append(start, len(sig))))
    pair = rep != cls
    return np.unique(np.stack([rep[pair], cls[pair]], 1), axis=0)


#: `names`: the distinct classes of a blob; `at`: the place there of each entry's.
_BLOB = "bucket int, sig binary, names binary, at binary"


def _place_type(n: int):
    return np.dtype("<u2" if n <= 1 << 16 else "<u4")


def _blobs(bucket: np.ndarray, sig, cls) -> Iterator[pa.RecordBatch]:
    if not len(bucket):
        return
    order = np.argsort(bucket, kind="stable")
    bucket, sig, cls = bucket[order], sig[order], cls[order]
    start = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    stop = np.append(start[1:], len(bucket))
    cuts = [(int(a), int(b)) for a, b in zip(start, stop, strict=True)]
    for at in range(0, len(cuts), 64):
        own = cuts[at : at + 64]
        rows = []
        for a, b in own:
            names, at_ = np.unique(cls[a:b], return_inverse=True)
            rows.append((int(bucket[a]), sig[a:b].tobytes(), names.tobytes(), at_.astype(_place_type(len(names))).tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int32(), *[pa.binary()] * 3), strict=True)], ["bucket", "sig", "names", "at"])


def _packed(sig: np.ndarray) -> np.ndarray:
    """The top SIG_BYTES of each hash, a row of bytes each."""
    return (sig >> _U(64 - 8 * SIG_BYTES)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :SIG_BYTES]


def _unblob(blob: tuple, packed: bool) -> tuple[np.ndarray, np.ndarray]:
    sig, names, at = blob
    names = np.frombuffer(names, "<i8")
    if packed:
        wide = np.zeros((len(sig) // SIG_BYTES, 8), np.uint8)
        wide[:, :SIG_BYTES] = np.frombuffer(sig, np.uint8).reshape(-1, SIG_BYTES)
        sig = wide
    return np.frombuffer(sig, "<u8" if packed else "<i8"), names[np.frombuffer(at, _place_type(len(names)))]


def index(docs: DataFrame, price: np.ndarray, buckets: int, words: int, percent: int) -> DataFrame:
    """Index entries in blobs by bucket, one a hash and stretch of a task; the stars of its others in STARS
    buckets below 0."""
    shared = docs.sparkSession.sparkContext.broadcast(price)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        met: set[int] = set()

        def flush():
            if not parts:
                return
            sig, cls = (np.concatenate(x) for x in zip(*parts, strict=True))
            parts.clear()
            if not len(sig):
                return
            sig, cls = _distinct(sig, cls)
            pairs = _forest(_stars(sig, cls), {})
            yield from _blobs(-1 - pairs[:, 0] % STARS, pairs[:, 0], pairs[:, 1])
            lone = np.concatenate([[True], sig[1:] != sig[:-1]])
            sig, cls = sig[lone], cls[lone]
            yield from _blobs((sig % _U(buckets)).astype(np.int64), _packed(sig), cls)

        held = 0
        for batch in batches:
            for _, _, sh, of, count, whole in _steps(batch, words):
                new = np.array([h not in met for h in whole.tolist()], bool)
                _, at = np.unique(whole, return_index=True)
                once = np.zeros(len(whole), bool)
                once[at] = True
                new &= once & (count > 0)
                met.update(whole[new].tolist())
                rows = np.flatnonzero(new)
                if not len(rows):
                    continue
                number = np.full(len(whole), -1)
                number[rows] = np.arange(len(rows))
                own = new[of]
                sig, who = index_entries(sh[own], number[of[own]], count[rows], table, percent, len(table))
                parts.append((sig, whole[rows].view(np.int64)[who]))
                held += len(sig)
                if held >= HELD:
                    yield from flush()
                    held = 0
                    met.clear()
        yield from flush()

    return docs.mapInArrow(run, _BLOB)


def _pair_batch(pairs: np.ndarray, names: tuple[str, str] = ("a", "b")) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], list(names))


#: Classes that a task remembers the connections of.
REMEMBERED = 1_000_000


def candidates(blobs: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) that connect all sets that share an entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, head = None, [], {}

        def flush():
            if held:
                left, right = (np.concatenate(x) for x in zip(*held, strict=True))
                held.clear()
                pairs = np.unique(np.stack([left, right], 1), axis=0) if now < 0 else _stars(*_distinct(left, right))
                yield _pair_batch(_forest(pairs, head))
                if len(head) > REMEMBERED:
                    head.clear()

        for batch in batches:
            for bucket, *blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bucket != now:
                    yield from flush()
                    now = bucket
                held.append(_unblob(blob, bucket >= 0))
        yield from flush()

    n = common.shuffle_partitions(blobs.sparkSession)
    return blobs.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(run, "a long, b long").distinct()


def components(links: DataFrame, keep) -> DataFrame:
    """(class, component) of every class in `links` (a, b) that another one is linked with; the component
    is its smallest class.

    Each round points every class to its smallest neighbour, if that is smaller, and on to where that
    points; then the links are taken between what is pointed to, so the graph shrinks by a factor a round.
    At most FEW links, of some megabytes, are left to one task.
    """
    tidy = lambda a, b: (F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    edges = keep(links.where("a <> b").select(*tidy("a", "b")).distinct(), "edges")
    labels, rounds = edges.select(F.col("a").alias("class"), F.col("a").alias("component")).limit(0), 0
    while edges.take(1):
        if few := edges.count() <= FEW:
            to = keep(edges.coalesce(1).mapInArrow(_ends, "v long, l long"), "pointers")
        else:
            to = _pointers(edges, keep)
        fresh = to.select(F.col("v").alias("class"), F.col("l").alias("component"))
        old = labels.join(to, F.col("component") == F.col("v"), "left").select("class", F.coalesce("l", "component").alias("component"))
        labels = keep(old.union(fresh.join(labels.select("class"), "class", "left_anti")), "labels") if rounds else fresh
        if few:
            break
        a, b = (to.select(F.col("v").alias(x), F.col("l").alias(f"l{x}")) for x in "ab")
        edges = keep(edges.join(a, "a").join(b, "b").where("la <> lb").select(*tidy("la", "lb")).distinct(), "edges")
        rounds += 1
    return labels


def _pointers(edges: DataFrame, keep) -> DataFrame:
    """(v, l) of every class in `edges`: where it points after three steps to smallest neighbours."""
    both = edges.select(F.col("a").alias("v"), F.col("b").alias("w")).union(edges.select("b", "a"))
    to = keep(both.groupBy("v").agg(F.least(F.min("w"), F.first("v")).alias("l")), "pointers")
    for _ in range(2):
        on = to.select(F.col("v").alias("l"), F.col("l").alias("on"))
        to = to.join(on, "l").select("v", F.col("on").alias("l"))
    return keep(to, "pointers")


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(v, l) of every class in all links of a task: the smallest class that it is connected with."""
    parts = [np.stack([c.to_numpy() for c in batch.columns], 1) for batch in batches]
    if parts:
        head: dict[int, int] = {}
        pairs = np.concatenate(parts)
        _forest(pairs, head)
        names = np.unique(pairs).tolist()
        ends = []
        for x in names:
            while x in head:
                x = head[x]
            ends.append(x)
        yield _pair_batch(np.array([names, ends]).T, ("v", "l"))


#: Remainders of a text's hash that say which documents may be wanted: at most so many small rows are broadcast.
REMAINDERS = 1 << 20


def _of_classes(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """`text` and all columns of `rows` (doc_id, text_hash, ...), for every row of `docs` that they name."""
    of = rows.withColumnsRenamed({"doc_id": "of", "text_hash": "of_hash"})
    rest = lambda c: F.pmod(c, F.lit(REMAINDERS)).cast("int").alias("rest")
    some = F.broadcast(rows.select(rest("text_hash")).distinct())  # at most REMAINDERS rows; the others' texts stay where they are
    docs = docs.join(some, rest(F.col("text_hash")) == F.col("rest"), "left_semi")
    return docs.join(of, (F.col("text_hash") == F.col("of_hash")) & F.col("doc_id").eqNullSafe(F.col("of"))).select("text", *(c for c in rows.columns if c not in ("doc_id", "text_hash")))


def with_sets(docs: DataFrame, rows: DataFrame, words: int) -> DataFrame:
    """The columns of `rows` (doc_id, text_hash, class, ...) but the first two, and `members`: the sorted
    set. Once a task, however often the row repeats in `docs`."""
    texts = _of_classes(docs, rows)
    at = texts.columns.index("class")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in texts.schema if f.name != "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        for batch in batches:
            new = []
            for c in batch.column(at).to_pylist():
                new.append(c not in met)
                met.add(c)
            batch = batch.filter(pa.array(new, pa.bool_()))
            for lo, hi, sh, _, count, _ in _steps(batch, words):
                ends, sh = np.concatenate([[0], np.cumsum(count)]), np.ascontiguousarray(sh)
                members = pa.array([sh[a:b].tobytes() for a, b in zip(ends, ends[1:], strict=False)], pa.binary())
                yield pa.RecordBatch.from_arrays([*(c.slice(lo, hi - lo) for c in batch.columns[1:]), members], [*batch.schema.names[1:], "members"])

    return texts.mapInArrow(run, f"{kinds}, members binary")


def _common(left: list[np.ndarray], right: list[np.ndarray] | None = None) -> np.ndarray:
    """How many members each set of `left` has in common with each of `right` (or of `left`)."""
    sets = left + (right or [])
    _, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    met = times[at] > 1
    owner, number = owner[met], (np.cumsum(times > 1) - 1)[at[met]]
    order = np.argsort(number, kind="stable")
    owner, number = owner[order], number[order]
    k = len(left)
    out = np.zeros((k, len(right) if right else k), np.float32)
    width, last = 4096, int(number[-1]) + 1 if len(number) else 0
    for lo in range(0, last, width):
        a, b = np.searchsorted(number, [lo, lo + width])
        has = np.zeros((len(sets), min(width, last - lo)), np.float32)
        has[owner[a:b], number[a:b] - lo] = 1
        out += has[:k] @ (has[k:] if right else has).T
    return out.astype(np.int64)


def _similar(n: np.ndarray, m: np.ndarray, both: np.ndarray, percent: int) -> np.ndarray:
    return 100 * both >= percent * (n[:, None] + m[None, :] - both)


def _labels(linked: np.ndarray) -> np.ndarray:
    """The smallest index of each one's component in a symmetric matrix of links."""
    label = np.arange(len(linked))
    while True:
        low = np.minimum(label, np.where(linked, label[None, :], len(label)).min(1))
        low = low[low]
        if (low == label).all():
            return label
        label = low


def _by_cell(sets: DataFrame, work, kinds: str) -> DataFrame:
    """`work(rows)` on all rows, as tuples, of each (cluster, place)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:2] != now:
                    if held:
                        yield from work(held)
                    now, held = row[:2], []
                held.append(row)
        if held:
            yield from work(held)

    n = common.shuffle_partitions(sets.sparkSession)
    return sets.repartition(n, "cluster", "place").sortWithinPartitions("cluster", "place").mapInArrow(run, kinds)


def _parts(sets: str, members: str, most: int):
    """In how many parts of `most` sets and PART_MEMBERS members all fit, about."""
    return F.ceil(F.greatest(F.col(sets) / most, F.col(members) / PART_MEMBERS)).cast("int")


def _place(parts: str):
    return F.pmod(F.xxhash64("class"), F.col(parts)).cast("int")


def in_parts(docs: DataFrame, clusters: DataFrame, words: int, percent: int) -> DataFrame:
    """(cluster, class, component, whole): links within the parts of each of `clusters` (class, cluster,
    doc_id, text_hash, n); `whole`: the cluster is one part. A head stands in each part of its cluster."""
    sizes = clusters.groupBy("cluster").agg(F.count("*").alias("sets"), F.sum("n").alias("members")).select("cluster", "sets", _parts("sets", "members", PART).alias("parts"))
    is_head = (F.col("class") == F.col("cluster")) | (F.pmod(F.xxhash64("class", F.lit(5)), F.ceil(F.col("sets") / HEADS)) == 0)
    places = F.when((F.col("parts") > 1) & is_head, F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(_place("parts")))
    rows = clusters.join(sizes, "cluster").select("doc_id", "text_hash", "cluster", "class", (F.col("parts") == 1).alias("whole"), places.alias("places"))
    sets = with_sets(docs, rows, words).select("cluster", F.explode("places").alias("place"), "class", "whole", "members")

    def work(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        own = sorted({r[2]: r for r in rows}.values(), key=lambda r: r[2])
        sets = [np.frombuffer(r[4], np.uint64) for r in own]
        n = np.array([len(x) for x in sets])
        label = _labels(_similar(n, n, _common(sets), percent))
        cls = np.array([r[2] for r in own])
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), own[0][0])), pa.array(cls), pa.array(cls[label]), pa.array([r[3] for r in own])], ["cluster", "class", "component", "whole"])

    return _by_cell(sets, work, "cluster long, class long, component long, whole boolean")


def _band_step(percent: int) -> float:
    """Sets that can be linked have sizes within one such factor, so they lie in one band or in two that follow."""
    return 100.1 / percent


def _sketch_bits(band: int, percent: int) -> int:
    """Bits of the sketches that are compared in a band: two to four for each member of its smallest sets, within SKETCH_BITS."""
    low, high = SKETCH_BITS
    return 1 << min(high, max(low, math.ceil(band * math.log2(_band_step(percent))) + 1))


def sketch(members: np.ndarray, bits: int) -> bytes:
    """Each member flips one of `bits` bits, so the sketches of two sets differ in no more bits than the sets in members."""
    at = np.bincount((common.mix(members ^ _TAG) & _U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(at.astype(np.uint8)).tobytes()


def _bits_apart(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """In how many bits each sketch (row of bytes) of `left` differs from each of `right`."""
    ones = [np.bitwise_count(x).sum(1, dtype=np.int64) for x in (left, right)]
    both = np.zeros((len(left), len(right)), np.float32)
    for at in range(0, left.shape[1], 128):
        both += np.unpackbits(left[:, at : at + 128], axis=1).astype(np.float32) @ np.unpackbits(right[:, at : at + 128], axis=1).astype(np.float32).T
    return ones[0][:, None] + ones[1][None, :] - 2 * both.astype(np.int64)


def _joined(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index of each one's component, of n that are linked a to b."""
    label = np.arange(n)
    while True:
        low = label.copy()
        np.minimum.at(low, a, label[b])
        np.minimum.at(low, b, label[a])
        low = low[low]
        if (low == label).all():
            return label
        label = low


def alike(docs: DataFrame, rows: DataFrame, words: int, percent: int) -> DataFrame:
    """Pairs (a, b) that connect all sets of one cluster which sizes and sketches don't tell apart; every link is
    among them. `rows`: class, cluster, doc_id, text_hash, n. Sets of a band meet those of their band and the
    next, block by block; only sketches are sent, some bits a member."""
    rows = rows.withColumn("band", F.floor(F.log("n") / math.log(_band_step(percent))).cast("int"))
    meets = rows.select("cluster", F.explode(F.array("band", F.col("band") - 1)).alias("space"), "band")
    bits = F.pow(F.lit(_band_step(percent)), F.col("space")) * 4  # or less
    most = F.least(F.lit(SKETCHED), F.ceil(F.lit(8 * SKETCH_BYTES) / bits))
    blocks = meets.groupBy("cluster", "space").agg(F.count("*").alias("sets"), F.max(F.col("band") == F.col("space")).alias("own")).where("own and sets > 1")
    blocks = F.broadcast(blocks.select("cluster", "space", F.ceil(F.col("sets") / most).cast("int").alias("blocks")))
    for name, space in (("own", F.col("band")), ("low", F.col("band") - 1)):
        its = blocks.select(F.col("cluster").alias("_c"), F.col("space").alias("_s"), F.col("blocks").alias(name))
        rows = rows.join(its, (F.col("cluster") == F.col("_c")) & (space == F.col("_s")), "left").drop("_c", "_s")
    texts = _of_classes(docs, rows.select("doc_id", "text_hash", "cluster", "class", "n", "band", "own", "low"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        for batch in batches:
            new = []
            for c in batch.column(2).to_pylist():
                new.append(c not in met)
                met.add(c)
            batch = batch.filter(pa.array(new, pa.bool_()))
            for lo, hi, sh, _, count, _ in _steps(batch, words):
                ends, of = np.concatenate([[0], np.cumsum(count)]), batch.column(4).slice(lo, hi - lo).to_pylist()
                made = []
                for own in (0, 1):
                    asked = batch.column(5 + own).slice(lo, hi - lo).is_valid().to_pylist()
                    made.append(pa.array([sketch(sh[a:b], _sketch_bits(g - own, percent)) if ask else None for a, b, g, ask in zip(ends, ends[1:], of, asked, strict=False)], pa.binary()))
                yield pa.RecordBatch.from_arrays([*(c.slice(lo, hi - lo) for c in batch.columns[1:]), *made], [*batch.schema.names[1:], "own_sketch", "low_sketch"])

    made = texts.select("text", "cluster", "class", "n", "band", "own", "low").mapInArrow(run, "cluster long, class long, n long, band int, own int, low int, own_sketch binary, low_sketch binary")

    def cells(of: str, space):
        """The cells of block pairs i <= j that a set's block lies in; side 0: it is i, 1: it is j, 2: both."""
        p, n = _place(of), F.col(of)
        cell = lambda j: space.cast("long") * (1 << 40) + F.least(p, j).cast("long") * n + F.greatest(p, j)
        side = lambda j: F.when(p == j, 2).otherwise((p > j).cast("int"))
        found = F.transform(F.sequence(F.lit(0), n - 1), lambda j: F.struct(cell(j).alias("place"), side(j).alias("side"), F.lit(of == "low").alias("low")))
        return F.when(n.isNotNull(), found).otherwise(F.array().cast("array<struct<place:bigint,side:int,low:boolean>>"))

    sets = made.select("*", F.explode(F.concat(cells("own", F.col("band")), cells("low", F.col("band") - 1))).alias("at"))
    sets = sets.select("cluster", "at.place", "at.side", "class", "n", F.when(F.col("at.low"), F.col("low_sketch")).otherwise(F.col("own_sketch")).alias("sketch"))

    def work(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        rows = list({r[3]: r for r in rows}.values())
        side = np.array([r[2] for r in rows])
        left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
        if not len(left) or not len(right):
            return
        cls, n = np.array([r[3] for r in rows]), np.array([r[4] for r in rows])
        bits = np.frombuffer(b"".join(r[5] for r in rows), np.uint8).reshape(len(rows), -1)
        x, y = n[left][:, None], n[right][None, :]
        may = (_bits_apart(bits[left], bits[right]) <= (x + y) * (100 - percent) // (100 + percent)) & (100 * np.minimum(x, y) >= percent * np.maximum(x, y))
        a, b = np.nonzero(may)
        label = _joined(len(rows), left[a], right[b])
        moved = np.flatnonzero(label != np.arange(len(rows)))
        if len(moved):
            yield _pair_batch(np.stack([cls[label[moved]], cls[moved]], 1))

    return _by_cell(sets, work, "a long, b long")


def across_parts(docs: DataFrame, open_: DataFrame, words: int, percent: int) -> DataFrame:
    """Pairs (a, b) of components that links of whole sets connect: in each cluster, all sets that its
    largest component doesn't hold against all sets. `open_`: class, cluster, component, doc_id, text_hash, n."""
    each = open_.groupBy("cluster", "component").agg(F.count("*").alias("k"))
    main = each.groupBy("cluster").agg(F.max_by("component", F.struct("k", "component")).alias("main"), F.count("*").alias("components")).where("components > 1")
    rows = open_.join(main, "cluster").withColumn("loose", F.col("component") != F.col("main"))
    alone = F.when(F.col("loose"), F.col("n"))
    sizes = rows.groupBy("cluster").agg(F.count("*").alias("sets"), F.sum("n").alias("members"), F.count(alone).alias("loose_sets"), F.sum(alone).alias("loose_members"))
    sizes = sizes.select("cluster", _parts("loose_sets", "loose_members", LOOSE).alias("lefts"), _parts("sets", "members", OTHERS).alias("rights"))
    cell = lambda left, right: left * F.col("rights") + right
    met_by = F.transform(F.sequence(F.lit(0), F.col("lefts") - 1), lambda i: F.struct(cell(i, _place("rights")).cast("int").alias("place"), F.lit(False).alias("left")))
    meets = F.transform(F.sequence(F.lit(0), F.col("rights") - 1), lambda j: F.struct(cell(_place("lefts"), j).cast("int").alias("place"), F.lit(True).alias("left")))
    rows = rows.join(sizes, "cluster").select("doc_id", "text_hash", "cluster", "class", "component", F.when(F.col("loose"), F.concat(met_by, meets)).otherwise(met_by).alias("places"))
    sets = with_sets(docs, rows, words).select("cluster", F.explode("places").alias("at"), "class", "component", "members").select("cluster", "at.place", "class", "component", "at.left", "members")

    def work(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        sides = [list({r[2]: r for r in rows if r[4] == side}.values()) for side in (True, False)]
        if not all(sides):
            return
        left, right = ([np.frombuffer(r[5], np.uint64) for r in side] for side in sides)
        of, to = (np.array([r[3] for r in side]) for side in sides)
        linked = _similar(*(np.array([len(x) for x in s]) for s in (left, right)), _common(left, right), percent)
        i, j = np.nonzero(linked & (of[:, None] != to[None, :]))
        if len(i):
            yield _pair_batch(_forest(np.unique(np.stack([of[i], to[j]], 1), axis=0), {}))

    return _by_cell(sets, work, "a long, b long")


def clusters_of(docs: DataFrame, price: np.ndarray, members: float, words: int, percent: int, keep) -> DataFrame:
    """(class, cluster) of the sets that share an entry with another one of `docs`, which have so many members."""
    buckets = max(1, math.ceil(members / 2 / ENTRIES))
    met = keep(candidates(index(docs, price, buckets, words, percent)), "met")
    return components(met, keep).withColumnRenamed("component", "cluster")


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of `docs` (doc_id, text)."""
    return grouped(docs, words, percent).select("doc_id", "n_shingles", "component_id")


def grouped(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """near_duplicates with text_hash, the xxhash64 of the row's text, and component, which names its
    group whatever the ids."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("text_hash"))
    with common.small_batches(docs.sparkSession), common.scratch(docs.sparkSession) as keep:
        return common.stored(_grouped(docs, words, percent, keep), "near-duplicates")


def _grouped(docs: DataFrame, words: int, percent: int, keep) -> DataFrame:
    rows, price = classes(docs, words, keep)
    heads = rows.groupBy("class").agg(F.min(F.struct("doc_id", "text_hash")).alias("head"), F.max("n").alias("n"))
    heads = keep(heads.select("class", "head.*", "n"), "heads")
    clusters = clusters_of(docs, price, heads.agg(F.sum("n")).first()[0] or 0, words, percent, keep)
    giant = keep(clusters.groupBy("cluster").count().where(F.col("count") > GIANT).select("cluster"), "giant")
    if giant.take(1):
        inside = keep(clusters.join(giant, "cluster").join(heads, "class"), "inside")
        texts = _of_classes(docs, inside.select("doc_id", "text_hash"))
        again = clusters_of(texts, own_prices(texts, words), inside.agg(F.sum("n")).first()[0], words, percent, keep)
        clusters = clusters.join(giant, "cluster", "left_anti").select("class", "cluster").union(again)
    clusters = keep(clusters.join(heads, "class"), "clusters")
    large = clusters.groupBy("cluster").agg(F.count("*").alias("sets"), F.sum("n").alias("members")).where(_parts("sets", "members", PART) > 1)
    large = keep(large.select("cluster"), "large")
    if large.take(1):
        may = keep(alike(docs, clusters.join(F.broadcast(large), "cluster"), words, percent), "alike")
        near = components(may, keep).withColumnRenamed("component", "cluster")
        clusters = clusters.join(F.broadcast(large), "cluster", "left_anti").select("class", "cluster").union(near)
        clusters = keep(clusters.join(heads, "class"), "clusters")

    found = keep(in_parts(docs, clusters, words, percent), "in-parts")
    labels, several = found.where("whole").select("class", "component"), found.where("not whole")
    if several.take(1):
        links = keep(several.select(F.col("class").alias("a"), F.col("component").alias("b")).distinct(), "links")
        first = components(links, keep)
        open_ = clusters.join(links.select(F.col("a").alias("class")), "class", "left_semi").join(first, "class", "left")
        more = keep(across_parts(docs, open_.withColumn("component", F.coalesce("component", "class")), words, percent), "across")
        labels = labels.union(components(links.union(more), keep) if more.take(1) else first)

    of = rows.join(labels, "class", "left").withColumn("component", F.coalesce("component", "class"))
    ids = of.where("n > 0").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    linked = of.join(ids, "component", "left")
    return linked.select("doc_id", "text_hash", "component", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))


def op10_universe_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.read(spark, sf_dir, "documents"))
