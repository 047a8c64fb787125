"""Choices that depend on each other, cut in chunks: what a chunk makes of each state it may be entered in is
worked out on its own, the few results are put together in order, and each chunk is then done from its state.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import kept

#: Width of a chunk, in units of the order (bars).
CHUNK = 1 << 16
LOWEST, HIGHEST = -(1 << 62), 1 << 62


def ahead(rows: DataFrame, marks: dict[str, Column], keys=("symbol",), chunk: int = CHUNK) -> DataFrame:
    """`rows` (keys, bar_idx) with, for each name, the first bar at or after the row's own where its condition
    holds; null if none does.

    Within chunks of bars it is a running minimum from behind; what comes after a chunk is one row a chunk.
    """
    rows = rows.withColumns({"_chunk": F.floor(F.col("bar_idx") / chunk), **{name: F.when(on, F.col("bar_idx")) for name, on in marks.items()}})
    first = rows.groupBy(*keys, "_chunk").agg(*(F.min(name).alias(f"_{name}") for name in marks))
    later = Window.partitionBy(*keys).orderBy(F.col("_chunk").desc()).rowsBetween(Window.unboundedPreceding, -1)
    first = first.select(*keys, "_chunk", *(F.min(f"_{name}").over(later).alias(f"_{name}") for name in marks))
    own = Window.partitionBy(*keys, "_chunk").orderBy(F.col("bar_idx").desc()).rowsBetween(Window.unboundedPreceding, 0)
    found = rows.withColumns({name: F.min(name).over(own) for name in marks}).join(first, [*keys, "_chunk"])
    return found.withColumns({name: F.coalesce(name, f"_{name}") for name in marks}).drop("_chunk", *(f"_{name}" for name in marks))


def running(rows: DataFrame, totals: dict[str, tuple[Column, str]], keys=("symbol",), order: str = "bar_idx", chunk: int = CHUNK) -> DataFrame:
    """`rows` with running sums, greatest, least or last values {name: (column, "sum", "max", "min" or "last")} up to each
    row by the whole numbers `order`; nulls don't count. Within chunks of `order`, and over one row a chunk."""
    last = lambda x: F.last(x, True)
    fold = {"sum": (F.sum, lambda a, b: F.coalesce(a + b, a, b)), "max": (F.max, F.greatest), "min": (F.min, F.least), "last": (last, F.coalesce)}
    rows = rows.withColumns({"_chunk": F.floor(F.col(order) / chunk), **{f"_v_{n}": x for n, (x, _) in totals.items()}})
    parts = rows.groupBy(*keys, "_chunk").agg(*((F.max_by(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), F.col(order))) if how == "last" else fold[how][0](f"_v_{n}")).alias(f"_b_{n}") for n, (_, how) in totals.items()))
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*keys, "_chunk", *(fold[how][0](f"_b_{n}").over(before).alias(f"_b_{n}") for n, (_, how) in totals.items()))
    own = Window.partitionBy(*keys, "_chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    found = rows.withColumns({n: fold[how][0](f"_v_{n}").over(own) for n, (_, how) in totals.items()}).join(parts, [*keys, "_chunk"])
    return found.withColumns({n: fold[how][1](F.col(n), F.col(f"_b_{n}")) for n, (_, how) in totals.items()}).drop("_chunk", *(f"_{x}_{n}" for x in "vb" for n in totals))


class _Steps:
    """The candidates of a chunk in order: where each leads, if it is taken."""

    def __init__(self, part: pd.DataFrame):
        self.at, self.free, self.side = (part[c].to_numpy(np.int64) for c in ("_at", "_free", "_side"))
        n = len(self.at)
        # for each last side, the first candidate from a place on that it admits
        self.admits = {}
        for side in (0, 1, 2):
            fits = np.where((self.side != side) | (side == 0), np.arange(n), n)
            self.admits[side] = np.append(np.minimum.accumulate(fits[::-1])[::-1], n)
        place = np.searchsorted(self.at, self.free, "right")
        self.next = np.array([self.admits[s][p] for s, p in zip(self.side.tolist(), place.tolist(), strict=True)], np.int64)
        self.last = np.arange(n)  # the last one taken in this chunk, if this one is
        for i in range(n - 1, -1, -1):
            if self.next[i] < n:
                self.last[i] = self.last[self.next[i]]

    def first(self, free: int, side: int) -> int:
        return int(self.admits[side][np.searchsorted(self.at, free, "right")])

    def taken(self, free: int, side: int) -> list[int]:
        out, i = [], self.first(free, side)
        while i < len(self.at):
            out.append(i)
            i = int(self.next[i])
        return out


def chained(candidates: DataFrame, at: Column, free: Column, keys=("symbol",), side: Column | None = None, order=("signal_id",), chunk: int = CHUNK) -> DataFrame:
    """The candidates taken one after another: the first one, then always the first whose `at` lies beyond the
    `free` of the one before (null: there is none after it); equal `at` by `order`. With `side`: the first of a side
    other than the last one's.

    A chunk of `chunk` units of `at` tells, for all places where it may be entered, where it is left: runs of
    places with the same end, as ways that start apart soon meet. One row a chunk is then walked for each key.
    """
    names, sides = candidates.columns, (0,) if side is None else (0, 1, 2)
    code = F.lit(0) if side is None else F.when(side == "LONG", 1).otherwise(2)
    rows = candidates.withColumns({"_at": at.cast("long"), "_free": F.coalesce(free.cast("long"), F.lit(HIGHEST)), "_side": code.cast("long")}).withColumn("_chunk", F.floor(F.col("_at") / chunk))
    first, last = rows.agg(F.min("_chunk"), F.max("_chunk")).first()
    if first == last:
        rows = rows.withColumns({"_from": F.lit(LOWEST), "_was": F.lit(0).cast("long")})
    else:
        kinds = ", ".join(f"`{k}` {dict(candidates.dtypes)[k]}" for k in keys)

        def ends(part: pd.DataFrame) -> pd.DataFrame:
            part = part.sort_values(["_at", *order])
            steps, out = _Steps(part), []
            for was in sides:
                starts = steps.admits[was][:-1]
                end = np.append(steps.last, -1)[starts]  # -1: nothing is taken
                run = np.flatnonzero(np.append(end[1:] != end[:-1], True))
                out += [(was, int(steps.at[i]), int(steps.free[e]) if e >= 0 else LOWEST, int(steps.side[e]) if e >= 0 else was) for i, e in zip(run.tolist(), end[run].tolist(), strict=True)]
            found = pd.DataFrame(out, columns=["_was", "_upto", "_free", "_side"])
            for k in (*keys, "_chunk"):
                found.insert(0, k, part[k].iloc[0])
            return found

        runs = rows.select(*keys, "_chunk", "_at", "_free", "_side", *(o for o in order if o not in keys)).groupBy(*keys, "_chunk").applyInPandas(ends, f"_chunk long, {', '.join(reversed(kinds.split(', ')))}, _was long, _upto long, _free long, _side long")

        def walk(part: pd.DataFrame) -> pd.DataFrame:
            free, was, out = LOWEST, 0, []
            for number, own in part.sort_values(["_chunk", "_was", "_upto"]).groupby("_chunk"):
                out.append((number, free, was))
                fits = own[(own["_was"] == was) & (own["_upto"] > free)]  # the run of the first place beyond
                if len(fits) and fits["_free"].iloc[0] != LOWEST:
                    free, was = int(fits["_free"].iloc[0]), int(fits["_side"].iloc[0])
            found = pd.DataFrame(out, columns=["_chunk", "_from", "_was"])
            for k in reversed(keys):
                found.insert(0, k, part[k].iloc[0])
            return found

        states = runs.groupBy(*keys).applyInPandas(walk, f"{kinds}, _chunk long, _from long, _was long")
        rows = rows.join(states, [*keys, "_chunk"])

    def take(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["_at", *order])
        return part.iloc[_Steps(part).taken(int(part["_from"].iloc[0]), int(part["_was"].iloc[0]))][names]

    return rows.groupBy(*keys, "_chunk").applyInPandas(take, candidates.schema)


class _Matching:
    """The candidates of whole islands, in order: a chain in which each unit is taken once."""

    def __init__(self, part: pd.DataFrame):
        self.at, self.free, island = (part[c].to_numpy(np.int64) for c in ("_at", "_free", "_island"))
        self.unit = part["_unit"].tolist()
        self.stop = np.searchsorted(island, island, "right")  # the end of each candidate's island

    def taken(self, i: int, upto: int, used: set) -> tuple[list[int], int]:
        """What is taken of candidates i to `upto` (of one island), and the place where the trader is free again."""
        out = []
        while i < upto:
            if self.unit[i] in used:
                i += 1
                continue
            out.append(i)
            used.add(self.unit[i])
            i = int(np.searchsorted(self.at, self.free[i], "right"))
        return out, i

    def walk(self, free: int) -> list[int]:
        out, i = [], int(np.searchsorted(self.at, free, "right"))
        while i < len(self.at):
            own, i = self.taken(i, int(self.stop[i]), set())
            out += own
        return out

    def ends(self) -> list[tuple[int, int]]:
        """(place, free) for runs of places with the same end: the last `free` of what is taken from there on."""
        n, end = len(self.at), {}
        for i in range(n - 1, -1, -1):
            if i and self.at[i - 1] == self.at[i]:
                continue  # a place is entered at its first candidate
            own, then = self.taken(i, int(self.stop[i]), set())
            after = end.get(int(np.searchsorted(self.at, self.at[then], "left"))) if then < n else None
            end[i] = after if after is not None else int(self.free[own[-1]]) if own else LOWEST
        places = sorted(end)
        return [(int(self.at[i]), end[i]) for i, j in zip(places, [*places[1:], None], strict=True) if j is None or end[j] != end[i]]


def matched(candidates: DataFrame, at: Column, free: Column, unit: Column, keys=("symbol",), order=("signal_id",), chunk: int = CHUNK) -> DataFrame:
    """`chained` where each `unit` is taken at most once: at each place, the first candidate by `order` whose unit is new.

    Units live for a while; where the lives of none overlap, nothing is remembered but when the trader is free. So a
    key's candidates fall into islands of overlapping units, and chunks of whole islands are composed as in `chained`.
    """
    names = candidates.columns
    rows = candidates.withColumns({"_at": at.cast("long"), "_free": F.coalesce(free.cast("long"), F.lit(HIGHEST)), "_unit": unit.cast("string")})
    lives = rows.groupBy(*keys, "_unit").agg(F.min("_at").alias("_a"), F.max("_at").alias("_z"))
    by = Window.partitionBy(*keys).orderBy("_a", "_unit")
    apart = F.coalesce(F.max("_z").over(by.rowsBetween(Window.unboundedPreceding, -1)) < F.col("_a"), F.lit(True))
    lives = lives.withColumn("_island", F.max(F.when(apart, F.col("_a"))).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    rows = kept(rows.join(lives.select(*keys, "_unit", "_island"), [*keys, "_unit"]).withColumn("_chunk", F.floor(F.col("_island") / chunk)), "islands")
    first, last = rows.agg(F.min("_chunk"), F.max("_chunk")).first()
    if first == last:
        rows = rows.withColumn("_from", F.lit(LOWEST))
    else:
        kinds = ", ".join(f"`{k}` {dict(candidates.dtypes)[k]}" for k in keys)

        def ends(part: pd.DataFrame) -> pd.DataFrame:
            found = pd.DataFrame(_Matching(part.sort_values(["_at", *order])).ends(), columns=["_upto", "_free"])
            for k in ("_chunk", *reversed(keys)):
                found.insert(0, k, part[k].iloc[0])
            return found

        def walk(part: pd.DataFrame) -> pd.DataFrame:
            free, out = LOWEST, []
            for number, own in part.sort_values(["_chunk", "_upto"]).groupby("_chunk"):
                out.append((number, free))
                fits = own[own["_upto"] > free]
                if len(fits) and fits["_free"].iloc[0] != LOWEST:
                    free = int(fits["_free"].iloc[0])
            found = pd.DataFrame(out, columns=["_chunk", "_from"])
            for k in reversed(keys):
                found.insert(0, k, part[k].iloc[0])
            return found

        runs = rows.groupBy(*keys, "_chunk").applyInPandas(ends, f"{kinds}, _chunk long, _upto long, _free long")
        rows = rows.join(runs.groupBy(*keys).applyInPandas(walk, f"{kinds}, _chunk long, _from long"), [*keys, "_chunk"])

    def take(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["_at", *order])
        return part.iloc[_Matching(part).walk(int(part["_from"].iloc[0]))][names]

    return rows.groupBy(*keys, "_chunk").applyInPandas(take, candidates.schema)
