"""A Merkle manifest of a dataset, with versions that copy paths.

Every row is a leaf (SHA-256 of its fields); the leaves of a language, by ascending doc_id, are joined
eight at a time until one node remains (its subroot), and the subroots likewise make the root. A tree
is worked on in aligned blocks of BLOCK leaves, as many tasks as there are blocks: each block gives its
top node, the tops are the leaves of the next stage, and so on. Then the way back: every top learns its
siblings up to the root, one row a block, so the stage below has the whole path at hand.

A changed leaf makes a version of the tree: it shares all nodes but its ancestors and copies those, first
in its block, then along the path that the block was handed. Versions never meet in one task.

Null language: a language of its own, the first. Null ids come first; rows of equal ids are ordered by
their leaves, so results don't depend on the order of the input; equal rows are leaves each. Null ids
are never tampered with. Null fields are `-`. Empty table: no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Children of a node, levels of a block, leaves of a block.
FAN, LEVELS = 8, 3
BLOCK = FAN**LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: What a node knows of the way above it: the hex digests left and right of the path, a level each.
PATH = "left array<string>, right array<string>, subroot string, root string"
NODE = "tree string, n long, idx long, digest binary"


def leaf(**changed: Column) -> Column:
    """The digest of a row, with some fields replaced."""

    def field(name: str) -> Column:
        value = changed.get(name, F.col(name)).cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.unhex(F.sha2(F.concat(*(field(f) for f in FIELDS)).cast("binary"), 256))


def height(n: int) -> int:
    """Levels above n leaves."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FAN), levels + 1
    return levels


def joined(digests: list[str]) -> list[str]:
    return [sha256("".join(digests[i : i + FAN]).encode()).hexdigest() for i in range(0, len(digests), FAN)]


def _levels(table: pa.Table, base: int) -> tuple[pa.Table, list[list[str]]]:
    """The nodes of a block by idx, and its levels up to what the block or the tree has."""
    table = table.sort_by("idx")
    rows = [[d.hex() for d in table["digest"].to_pylist()]]
    for _ in range(min(LEVELS, height(table["n"][0].as_py()) - base)):
        rows.append(joined(rows[-1]))
    return table, rows


def _siblings(rows: list[list[str]], i: int) -> Iterator[tuple[str, str]]:
    """What lies left and right of the path from the i-th node of a block, level by level."""
    for nodes in rows[:-1]:
        first = i // FAN * FAN
        yield "".join(nodes[first:i]), "".join(nodes[i + 1 : first + FAN])
        i //= FAN


def numbered(rows: DataFrame, tree: str, *order: str) -> DataFrame:
    """`rows` with idx: their place, from 0, in their tree by `order`, and n: the rows of the tree."""
    spark = rows.sparkSession
    rows = rows.repartitionByRange(common.shuffle_partitions(spark), tree, *order).sortWithinPartitions(tree, *order)
    rows = common.stored(rows.withColumn("_at", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("_at", 33).alias("_part")
    # a row for each tree and each further partition that it reaches into
    runs = rows.groupBy(F.col(tree).alias("_tree"), part).agg(F.min("_at").alias("_from"), F.count("*").alias("_rows"))
    whole = Window.partitionBy("_tree")
    runs = runs.select("_tree", "_part", (F.sum("_rows").over(whole.orderBy("_part")) - F.col("_rows") - F.col("_from")).alias("_shift"), F.sum("_rows").over(whole).alias("n"))
    found = rows.withColumn("_own", part).join(runs, F.col(tree).eqNullSafe(F.col("_tree")) & (F.col("_own") == F.col("_part")))
    return found.withColumn("idx", F.col("_at") + F.col("_shift")).drop("_at", "_tree", "_part", "_own", "_shift")


def _tops(nodes: DataFrame, base: int) -> DataFrame:
    """The top node of each block."""

    def run(table: pa.Table) -> pa.Table:
        table, rows = _levels(table, base)
        first = table.slice(0, 1)
        idx = first["idx"][0].as_py() // BLOCK
        return pa.table({"tree": first["tree"], "n": first["n"], "idx": pa.array([idx], pa.int64()), "digest": pa.array([bytes.fromhex(rows[-1][0])])})

    return nodes.select("tree", "n", "idx", "digest").groupBy("tree", F.floor(F.col("idx") / BLOCK)).applyInArrow(run, NODE)


def climb(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The nodes (tree, n, idx, digest) of each stage, the given ones first, and the single node of each tree."""
    stages, base = [nodes], 0
    most = height(nodes.agg(F.max("n")).first()[0] or 0)
    while base < most:
        nodes = common.stored(_tops(nodes, base), "nodes")
        base += LEVELS
        if base < most:
            stages.append(nodes)
    return stages, nodes


def descend(nodes: DataFrame, paths: DataFrame, base: int, made: Callable, schema: str) -> DataFrame:
    """`made`(key, block, levels, path) for each block of a stage; paths: (tree, idx, PATH) of the tops."""

    def run(key: tuple, block: pa.Table, path: pa.Table) -> pa.Table:
        block, rows = _levels(block, base)
        return made(block, rows, path.to_pylist()[0])

    left = nodes.groupBy("tree", F.floor(F.col("idx") / BLOCK))
    return left.cogroup(paths.groupBy("tree", F.col("idx"))).applyInArrow(run, schema)


def _paths(block: pa.Table, rows: list[list[str]], path: dict) -> pa.Table:
    """The path above each node of a block."""
    own = [list(zip(*_siblings(rows, i), strict=True)) or [(), ()] for i in range(len(rows[0]))]
    left, right = ([[*x[k], *path[side]] for x in own] for k, side in ((0, "left"), (1, "right")))
    text = pa.list_(pa.string())
    return pa.table({"tree": block["tree"], "idx": block["idx"], "left": pa.array(left, text), "right": pa.array(right, text), **{c: pa.array([path[c]] * len(own), pa.string()) for c in ("subroot", "root")}})


def paths_of(stages: list[DataFrame], tops: DataFrame) -> list[DataFrame]:
    """For each stage, the paths (tree, idx, PATH) of the tops of its blocks; `tops`: those of the trees' single nodes."""
    found = [tops]
    for k in range(len(stages) - 1, 0, -1):
        found.append(common.stored(descend(stages[k], found[-1], k * LEVELS, _paths, f"tree string, idx long, {PATH}"), "paths"))
    return found[::-1]


class Manifest:
    """The tree over `leaves` (tree, digest and what else a leaf carries), ordered by `order` in each tree."""

    def __init__(self, leaves: DataFrame, *order: str) -> None:
        self.leaves = common.stored(numbered(leaves, "tree", *order), "leaves")
        self.stages, single = climb(self.leaves)
        # the trees' subroots are the leaves of one more tree, null first, then by the names' bytes
        trees = single.select(F.lit("").alias("_all"), "tree", "digest")
        upper = common.stored(numbered(trees, "_all", "tree", "digest"), "subroots").withColumnRenamed("tree", "name").withColumnRenamed("_all", "tree")
        stages, top = climb(upper)
        start = top.select("tree", F.lit(0).cast("long").alias("idx"), *(F.array().cast("array<string>").alias(side) for side in ("left", "right")), F.lit(None).cast("string").alias("subroot"), F.lower(F.hex("digest")).alias("root"))
        ways = paths_of(stages, start)

        def named(block: pa.Table, rows: list[list[str]], path: dict) -> pa.Table:
            found, zero = _paths(block, rows, path), pa.array([0] * len(block), pa.int64())
            return pa.table({"tree": block["name"], "idx": zero, "left": found["left"], "right": found["right"], "subroot": pa.array(rows[0]), "root": found["root"]})

        tops = common.stored(descend(upper, ways[0], 0, named, f"tree string, idx long, {PATH}"), "tops")
        self.paths = paths_of(self.stages, tops)[0]

    def proved(self, changed: str, *keep: str) -> DataFrame:
        """Each leaf with `keep`, subroot, root, proof_sha256 and folded_root: the root of the version with
        the digest `changed` in its place (null: its own)."""
        kinds = {f.name: f.dataType.simpleString() for f in self.leaves.schema}
        schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "leaf string, subroot string, root string, proof_sha256 string, folded_root string"])

        def made(block: pa.Table, rows: list[list[str]], path: dict) -> pa.Table:
            above = list(zip(path["left"], path["right"], strict=True))
            tail, proofs, folded = "".join(a + b for a, b in above), [], []
            for i, (own, other) in enumerate(zip(rows[0], block[changed].to_pylist(), strict=True)):
                inside = list(_siblings(rows, i))
                proofs.append(sha256(("".join(a + b for a, b in inside) + tail).encode()).hexdigest())
                folded.append(_ancestors(own if other is None else other.hex(), inside + above)[-1])
            same = {c: pa.array([path[c]] * len(block)) for c in ("subroot", "root")}
            return pa.table({**{c: block[c] for c in keep}, "leaf": pa.array(rows[0]), **same, "proof_sha256": pa.array(proofs), "folded_root": pa.array(folded)})

        return descend(self.leaves, self.paths, 0, made, schema)

    def versions(self, changed: str, *keep: str) -> DataFrame:
        """The nodes that each version copies, for leaves with a digest in `changed`: `keep`, tree, level (0: the
        leaf; those above the subroot belong to the tree of subroots), digest. All other nodes are shared."""
        kinds = {f.name: f.dataType.simpleString() for f in self.leaves.schema}
        schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "tree string, level int, digest string"])

        def made(block: pa.Table, rows: list[list[str]], path: dict) -> pa.Table:
            above, at, level, digest = list(zip(path["left"], path["right"], strict=True)), [], [], []
            for i, other in enumerate(block[changed].to_pylist()):
                if other is not None:
                    copied = _ancestors(other.hex(), [*_siblings(rows, i), *above])
                    at, level, digest = at + [i] * len(copied), level + list(range(len(copied))), digest + copied
            own = block.take(pa.array(at, pa.int64()))
            return pa.table({**{c: own[c] for c in keep}, "tree": own["tree"], "level": pa.array(level, pa.int32()), "digest": pa.array(digest, pa.string())})

        return descend(self.leaves, self.paths, 0, made, schema)


def _ancestors(digest: str, path: list[tuple[str, str]]) -> list[str]:
    """A leaf's digest and the digests above it along a path."""
    out = [digest]
    for left, right in path:
        out.append(sha256((left + out[-1] + right).encode()).hexdigest())
    return out


def folds(doc_id: Column) -> Column:
    """Which rows the query tampers with."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 0, F.lit(False))


def of_documents(docs: DataFrame) -> Manifest:
    """The manifest of `docs`, a tree a language; `tampered`: the digest with the text's A-Z lower-cased, of
    rows that `folds` picks."""
    lower = F.translate(F.col("text").cast("string"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = docs.select("doc_id", F.col("lang").cast("string").alias("tree"), leaf().alias("digest"), F.when(folds(F.col("doc_id")), leaf(text=lower)).alias("tampered"))
    return Manifest(common.stored(rows, "digests"), "doc_id", "digest")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = of_documents(common.read(spark, sf_dir, "documents")).proved("tampered", "doc_id")
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))
