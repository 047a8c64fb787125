"""Hard negatives by an inverted multi-index with certified windows.

Vectors are split in two halves; a codebook for each half (k-means on a bounded sample) gives every row
a cell, the pair of its nearest codewords. By Cauchy and Schwarz a row's inner product with an anchor is
at most the sum over both halves of <anchor, codeword> + |anchor| * radius, the radius being the largest
distance of any row to that codeword. A multi-sequence heap walks the cells by falling sums of these two
bounds. So a search has two passes: the first visits cells until they hold FIRST rows, and gives a floor
that a result must reach; the second takes up the walk and stops at the first cell whose bound lies
below the floor. What it hasn't seen can't be among the results, so they are exact.

A search takes windows (anchor, least and most score, same label or another, how many). Positives have
one window an anchor, without limits; negatives one for each positive: from half of its score to 95 %.
Cells whose scores must all lie above every window of the anchor are left out, too.

Rows of a cell lie in shards: runs of small cells, and pieces of large ones, of about SHARD_ROWS rows. A
visit sends the anchor's vector and its cells to a shard once; each task holds one shard and streams
anchors past it. Nothing but codebooks and the counts of cells (at most CODES * CODES) is on the driver.

Vectors of different lengths are filled up with zeros. Rows of the anchor's own vec_id are no candidates
for it; rows that repeat an anchor are anchors each, and a null id, never an anchor, is last among ties.
Scores are exact 64-bit integers. Without anchors or candidates there are no rows. Extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Codewords of a half, most rows in the sample they are fitted on, its rounds.
CODES, SAMPLE, ROUNDS = 32, 20_000, 10
#: Rows that the first pass visits for each anchor, rows of a shard, anchors that one copy of a shard meets.
FIRST, SHARD_ROWS, ANCHORS = 1_000, 2_048, 1 << 18
POSITIVES, NEGATIVES = 5, 3
LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1


def prepared(rows: DataFrame) -> DataFrame:
    """(key, vec_id, label, q): the rows that take part, their components as integers."""
    x = F.transform(F.col("embedding"), lambda v: v.cast("double"))
    fine = F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.forall(x, lambda v: v.isNotNull() & (F.abs(v) < float("inf")))
    label = F.when(F.coalesce(F.col("vec_id") % 7 == 0, F.lit(False)), (F.col("label") + 1) % 10).otherwise(F.col("label")).cast("long")
    found = rows.where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), F.transform(x, lambda v: F.floor(v * 256).cast("long")).alias("q"))
    return found.withColumn("key", F.monotonically_increasing_id())


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists of integers as rows of `width`, zeros behind shorter ones."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (size == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(size), width), np.int64)
    out[np.arange(width) < size[:, None]] = flat
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows of a and b, in the narrowest type that holds them."""
    most = int(abs(a).max(initial=0)) * int(abs(b).max(initial=0)) * max(1, a.shape[1])
    if most < 1 << 24:
        return (a.astype(np.float32) @ b.astype(np.float32).T).astype(np.int64)
    if most < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def _means(x: np.ndarray, codes: int) -> np.ndarray:
    """Codewords by k-means, from evenly spread rows."""
    distinct = np.unique(x, axis=0)
    at = distinct[np.linspace(0, len(distinct) - 1, min(codes, len(distinct))).astype(int)]
    for _ in range(ROUNDS):
        near = _nearest(x, at)[0]
        count = np.bincount(near, minlength=len(at))
        total = np.stack([np.bincount(near, x[:, j], len(at)) for j in range(x.shape[1])], 1) if x.shape[1] else np.zeros((len(at), 0))
        at = np.where(count[:, None] > 0, total / np.maximum(1, count)[:, None], at)
    return at


def _nearest(x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest codeword of each row and the distance to it."""
    d = (at**2).sum(1) - 2 * (x @ at.T)
    near = d.argmin(1)
    return near, np.sqrt(((x - at[near]) ** 2).sum(1))


@dataclass
class Index:
    books: tuple[np.ndarray, np.ndarray]  # codewords of the halves
    radius: tuple[np.ndarray, np.ndarray]  # largest distance of a row to each
    count: np.ndarray  # rows of each cell
    shard: np.ndarray  # first shard of each cell
    pieces: np.ndarray  # shards of each cell
    width: int

    def half(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return x[:, : self.width // 2].astype(np.float64), x[:, self.width // 2 :].astype(np.float64)

    def cells(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
        near, far = zip(*(_nearest(h, at) for h, at in zip(self.half(x), self.books, strict=True)), strict=True)
        return near[0] * len(self.books[1]) + near[1], near, far

    def bounds(self, x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each half, the least and the largest part that rows of each codeword can add to a score."""
        out = []
        for h, at, r in zip(self.half(x), self.books, self.radius, strict=True):
            middle, reach = h @ at.T, np.sqrt((h**2).sum(1))[:, None] * r
            slack = 1e-9 * (abs(middle) + reach) + 1e-6  # for rounding
            out.append((middle - reach - slack, middle + reach + slack))
        return out


def walk(first: np.ndarray, second: np.ndarray) -> Iterator[tuple[float, int, int]]:
    """All pairs (sum, i, j) of two rows of numbers, the largest sums first, from a heap."""
    a, b = np.argsort(-first, kind="stable"), np.argsort(-second, kind="stable")
    heap, seen = [(-(first[a[0]] + second[b[0]]), 0, 0)], {(0, 0)}
    while heap:
        total, i, j = heapq.heappop(heap)
        yield -total, int(a[i]), int(b[j])
        for x, y in ((i + 1, j), (i, j + 1)):
            if x < len(a) and y < len(b) and (x, y) not in seen:
                seen.add((x, y))
                heapq.heappush(heap, (-(first[a[x]] + second[b[y]]), x, y))


def build(rows: DataFrame) -> tuple[Index, DataFrame]:
    """The index of `rows` (see `prepared`), and the rows with cell and shard; every row is indexed."""
    spark = rows.sparkSession
    n, width = rows.agg(F.count("*"), F.max(F.size("q"))).first()
    width = max(2, width or 0)
    order = F.pmod(F.xxhash64("q"), F.lit(1 << 20))
    sample = _matrix(rows.where(order < int((1 << 20) * min(1.0, SAMPLE / max(1, n)))).select("q").limit(2 * SAMPLE).toArrow()["q"], width) if n else np.zeros((0, width), np.int64)
    if not len(sample):
        sample = np.zeros((1, width), np.int64)
    books = tuple(_means(h.astype(np.float64), CODES) for h in (sample[:, : width // 2], sample[:, width // 2 :]))
    index = Index(books, (None, None), None, None, None, width)
    shared = spark.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, _, far = shared.value.cells(_matrix(batch.column(3), shared.value.width))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(far[0]), pa.array(far[1])], ["key", "vec_id", "label", "q", "cell", "far0", "far1"])

    placed = common.stored(rows.select("key", "vec_id", "label", "q").mapInArrow(run, "key long, vec_id long, label long, q array<long>, cell int, far0 double, far1 double"), "placed")
    cells = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("far0").alias("far0"), F.max("far1").alias("far1")).toArrow()  # at most CODES * CODES rows
    at = cells["cell"].to_numpy()
    size = tuple(len(b) for b in books)
    count, radius = np.zeros(size[0] * size[1], np.int64), (np.zeros(size[0]), np.zeros(size[1]))
    count[at] = cells["n"].to_numpy()
    for k, code in ((0, at // size[1]), (1, at % size[1])):
        np.maximum.at(radius[k], code, cells[f"far{k}"].to_numpy())
    # small cells share a shard, large ones have several; there are shards for all tasks
    room = max(1, min(SHARD_ROWS, -(-n // (2 * common.shuffle_partitions(spark)))))
    pieces = np.maximum(1, -(-count // room))
    level = np.cumsum(np.where(count >= room, pieces * room, count)) - 1
    first = np.where(count >= room, level // room - pieces + 1, level // room)
    index = Index(books, radius, count, np.maximum(0, first), pieces, width)
    piece = F.pmod(F.xxhash64("key"), F.element_at(_literal(pieces), F.col("cell") + 1))
    return index, placed.select("key", "vec_id", "label", "q", "cell", (F.element_at(_literal(index.shard), F.col("cell") + 1) + piece).alias("shard"))


def _literal(values: np.ndarray):
    return F.lit([int(v) for v in values]).cast("array<long>")


def _visits(index: Index, asks: DataFrame, after: bool) -> DataFrame:
    """(shard, and the columns of `asks` with cells): each anchor once for each shard it has to see. Columns of
    `asks`: key, vec_id, label, q, low and high (arrays: the windows' limits). Until FIRST rows are covered, or
    `after` them, until the bound is below all windows."""
    shared = asks.sparkSession.sparkContext.broadcast(index)

    def chosen(up: tuple, down: tuple, low: int, high: int, ix: Index) -> Iterator[int]:
        covered = 0
        for bound, i, j in walk(*up):
            if bound < low:
                return
            cell, before = i * len(up[1]) + j, covered
            covered += int(ix.count[cell])
            if not after and before >= FIRST:
                return
            if ix.count[cell] and after == (before >= FIRST) and down[0][i] + down[1][j] <= high:
                yield cell

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix: Index = shared.value
        for batch in batches:
            x = _matrix(batch.column(3), ix.width)
            (low0, up0), (low1, up1) = ix.bounds(x)
            least, most = ([f(v) if v else None for v in batch.column(k).to_pylist()] for k, f in ((4, min), (5, max)))
            row, shard, cells = [], [], []
            for r in range(len(x)):
                if least[r] is None:
                    continue
                own: dict[int, list[int]] = {}
                for cell in chosen((up0[r], up1[r]), (low0[r], low1[r]), least[r], most[r], ix):
                    for s in range(ix.shard[cell], ix.shard[cell] + ix.pieces[cell]):
                        own.setdefault(int(s), []).append(cell)
                for s, c in own.items():
                    row.append(r), shard.append(s), cells.append(c)
            for at in range(0, len(row), 1000):
                own = batch.take(pa.array(row[at : at + 1000], pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(shard[at : at + 1000], pa.int64()), *own.columns, pa.array(cells[at : at + 1000], pa.list_(pa.int32()))], ["shard", *own.schema.names, "cells"])

    with_cells = "shard long, key long, vec_id long, label long, q array<long>, low array<long>, high array<long>, cells array<int>"
    return asks.select("key", "vec_id", "label", "q", "low", "high").mapInArrow(run, with_cells)


def _best(score: np.ndarray, fits: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k largest scores that fit in each row; columns ascend by id, the first wins ties."""
    n, m = score.shape
    k = min(k, m)
    if not k or not fits.any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    low = np.where(fits, score, LOWEST)
    # whatever reaches the k-th largest score, then by score and column
    kth = np.partition(low, m - k, axis=1)[:, m - k]
    row, col = np.nonzero(fits & (low >= kth[:, None]))
    order = np.lexsort((col, -score[row, col], row))
    row, col = row[order], col[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k], col[place < k]


def _met(index: Index, placed: DataFrame, visits: DataFrame, same: bool, k: int) -> DataFrame:
    """(anchor, window, vec_id, score): the best k of each shard for each window of each visit."""
    width, spark = index.width, placed.sparkSession
    anchors = visits.select("key").distinct().count()
    copies = -(-anchors // ANCHORS)
    none, nothing = F.lit(None).cast("array<long>"), F.lit(None).cast("array<int>")
    rows = placed.select("shard", F.lit(0).alias("kind"), "key", "vec_id", "label", "q", none.alias("low"), none.alias("high"), F.array(F.col("cell")).alias("cells"))
    if copies > 1:
        rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
        visits = visits.withColumn("copy", F.pmod(F.xxhash64("key"), F.lit(copies)).cast("int"))
    else:
        rows, visits = rows.withColumn("copy", F.lit(0)), visits.withColumn("copy", F.lit(0))
    both = rows.unionByName(visits.withColumn("kind", F.lit(1)).select(*rows.columns))
    dealt = both.repartition(common.shuffle_partitions(spark), "shard", "copy").sortWithinPartitions("shard", "copy", "kind")

    def met(shard: list[pa.RecordBatch], held: dict, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if "x" not in held:
            table = pa.Table.from_batches(shard)
            ids = table["vec_id"].to_numpy(zero_copy_only=False).astype(np.float64) if table["vec_id"].null_count else table["vec_id"].to_numpy()
            order = np.argsort(ids, kind="stable")  # nulls are NaN: last
            held |= {"x": _matrix(table["q"], width)[order], "id": table["vec_id"].take(pa.array(order)), "label": table["label"].to_numpy()[order], "cell": table["cells"].combine_chunks().flatten().to_numpy()[order]}
            held["ids"] = held["id"].fill_null(0).to_numpy() if held["id"].null_count else held["id"].to_numpy()
            held["known"] = ~held["id"].is_null().to_numpy() if held["id"].null_count else np.ones(len(order), bool)
        for at in range(0, len(batch), 256):
            part = batch.slice(at, 256)
            score = products(_matrix(part.column(5), width), held["x"])
            cells = part.column(8)
            seen = np.zeros((len(part), len(index.count)), bool)
            seen[np.repeat(np.arange(len(part)), cells.value_lengths().to_numpy()), cells.flatten().to_numpy()] = True
            allowed = seen[:, held["cell"]]
            own = part.column(4).to_numpy()[:, None] == held["label"]
            allowed &= own if same else ~own
            allowed &= ~((part.column(3).to_numpy()[:, None] == held["ids"]) & held["known"])
            low, high = part.column(6).to_pylist(), part.column(7).to_pylist()
            for w in range(max(map(len, low))):
                least, most = (np.array([v[w] if w < len(v) else other for v in limits], np.int64)[:, None] for limits, other in ((low, HIGHEST), (high, LOWEST)))
                row, col = _best(score, allowed & (score >= least) & (score <= most), k)
                if len(row):
                    yield pa.RecordBatch.from_arrays([part.column(2).take(pa.array(row)), pa.array(np.full(len(row), w, np.int32)), held["id"].take(pa.array(col)).combine_chunks(), pa.array(score[row, col])], ["anchor", "window", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, shard, held = None, [], {}
        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy() for i in (0, 9)], 1)
            kind = batch.column(1).to_numpy()
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(1) | (kind[1:] != kind[:-1])) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(batch)], strict=True):
                if tuple(keys[a]) != now:
                    now, shard, held = tuple(keys[a]), [], {}
                if kind[a] == 0:
                    shard.append(batch.slice(a, b - a))
                elif shard:
                    yield from met(shard, held, batch.slice(a, b - a))

    order = "shard", "kind", "key", "vec_id", "label", "q", "low", "high", "cells", "copy"
    return dealt.select(*order).mapInArrow(run, "anchor long, window int, vec_id long, score long")


def _first(found: DataFrame, k: int) -> DataFrame:
    """The best k of each window, with rank from 1."""
    by = Window.partitionBy("anchor", "window").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def search(index: Index, placed: DataFrame, asks: DataFrame, same: bool, k: int) -> DataFrame:
    """(anchor, window, rank, vec_id, score): the best k rows in each window of `asks` (key, vec_id, label, q, low,
    high); `same`: with the anchor's label, else with another. Exact."""
    begun = common.stored(_first(_met(index, placed, common.stored(_visits(index, asks, False), "visits"), same, k), k), "begun")
    # the k-th best so far is the least that another row of the window must reach
    floor = begun.where(F.col("rank") == k).groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("window", "score"))).alias("_floor"))  # a few windows an anchor
    risen = asks.join(floor, asks["key"] == floor["anchor"], "left")
    low = F.transform("low", lambda x, i: F.greatest(x, F.coalesce(F.element_at("_floor", i), F.lit(LOWEST))))
    risen = risen.select("key", "vec_id", "label", "q", low.alias("low"), "high")
    rest = _met(index, placed, common.stored(_visits(index, risen, True), "visits"), same, k)
    return _first(begun.drop("rank").unionByName(rest), k)


def mined(rows: DataFrame, anchors=lambda vec_id: vec_id % 50 == 0, positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each row that `anchors` picks
    and each of its first `positives` rows of the same label, the first `negatives` rows of other labels whose
    score is at least half and at most 95 % of the positive's."""
    with common.small_batches(rows.sparkSession, 4096):
        rows = common.stored(prepared(rows), "vectors")
        index, placed = build(rows)
        placed = common.stored(placed, "index")
        asked = common.stored(rows.where(F.coalesce(anchors(F.col("vec_id")), F.lit(False))), "anchors")
        any_score = F.array(F.lit(LOWEST)).alias("low"), F.array(F.lit(HIGHEST)).alias("high")
        near = common.stored(search(index, placed, asked.select("*", *any_score), True, positives), "positives")
        # one window a positive, by rank: 50 p <= 100 n <= 95 p
        p = F.array_sort(F.collect_list(F.struct("rank", "score")))  # at most `positives` an anchor
        own = near.groupBy("anchor").agg(p.alias("p"))
        least = F.transform("p", lambda s: F.ceil(s["score"] * F.lit(50).cast("decimal(2,0)") / 100).cast("long")).alias("low")
        most = F.transform("p", lambda s: F.floor(s["score"] * F.lit(95).cast("decimal(2,0)") / 100).cast("long")).alias("high")
        asks = asked.join(own, asked["key"] == own["anchor"]).select("key", "vec_id", "label", "q", least, most)
        far = common.stored(search(index, placed, common.stored(asks, "windows"), False, negatives), "negatives")
    pairs = near.join(asked.select("key", F.col("vec_id").alias("anchor_id")), F.col("anchor") == F.col("key")).select("anchor", "anchor_id", (F.col("rank") - 1).alias("window"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    found = far.select("anchor", "window", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return pairs.join(found, ["anchor", "window"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op11_inverted_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mined(common.read(spark, sf_dir, "embeddings"))
