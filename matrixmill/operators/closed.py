"""Closed patterns by depth-first growth: itemsets and order sequences, only closed ones ever kept.

Rows stay where they are, in blocks (a bit for each row and item; or a rank for each row and column). The search keeps a
stack of open candidates and takes CHUNK of them at a time: every block weighs them against its rows, the counts of all
blocks are added up in tasks, and what comes back tells for each candidate its support, whether it is closed, and the
counts of its children. A candidate is looked at once; one whose count is below the present bound waits, so a search that
lowers its bound goes on from where it was.

Itemsets: a candidate is a closed set and one more item; its closure is every item with the same count, and it counts only
if the closure adds no item before that one, so each closed set is made once. Sequences: a column that can be put in at
one place in all supporting rows makes a pattern not closed; if that place is before what later growth can touch, no
longer pattern of that beginning is closed either.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import keep, tidy

#: rows of a block; candidates weighed in one pass over the blocks; of them, those added up in one task; patterns that the driver holds
BLOCK_ROWS, CHUNK, PART, HELD = 1 << 16, 2048, 64, 20_000


def _added(blocks: DataFrame, weigh: Callable[[pd.DataFrame], np.ndarray], how: list[str], n: int, width: int) -> np.ndarray:
    """(candidates, kinds, width): what weigh() says of each block, combined over all; how: 'sum', 'min' or 'max' for each kind."""
    kinds = len(how)

    def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.stack([getattr(np, {"sum": "add", "min": "minimum", "max": "maximum"}[h])(a[:, k], b[:, k]) for k, h in enumerate(how)], axis=1)

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for f in frames:
            for _, block in f.iterrows():
                found = weigh(block)
                total = found if total is None else combine(total, found)
        if total is not None:
            yield pd.DataFrame([(p // PART, total[p : p + PART].tobytes()) for p in range(0, n, PART)], columns=["part", "counts"])

    def add(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        total = None
        for c in f["counts"]:
            x = np.frombuffer(c, np.int64).reshape(-1, kinds, width)
            total = x if total is None else combine(total, x)
        return pd.DataFrame([(key[0], total.tobytes())], columns=["part", "counts"])

    parts = blocks.mapInPandas(task, "part long, counts binary").groupBy("part").applyInPandas(add, "part long, counts binary")
    rows = sorted(parts.collect())  # at most CHUNK x kinds x width numbers
    return np.concatenate([np.frombuffer(r.counts, np.int64).reshape(-1, kinds, width) for r in rows]) if rows else np.zeros((0, kinds, width), np.int64)


class Itemsets:
    """Rows of (row, items) as bits."""

    def __init__(self, transactions: DataFrame, floor: int) -> None:
        # items in so many rows: no more of them than entries / floor
        counts = transactions.select(F.explode(F.array_distinct("items")).alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= floor)
        self.names = [r["item"] for r in counts.orderBy("item").collect()]
        place = {x: i for i, x in enumerate(self.names)}
        self.types = dict(transactions.dtypes)

        def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            rows: list = []
            hits: list[list[int]] = []

            def block() -> pd.DataFrame:
                bits = np.zeros((len(place) + 1, -(-len(rows) // 64) * 64), np.uint8)
                bits[-1, : len(rows)] = 1
                for i, items in enumerate(hits):
                    bits[items, i] = 1
                out = pd.DataFrame({"ids": [list(rows)], "bits": [np.packbits(bits, axis=1, bitorder="little").tobytes()]})
                rows.clear()
                hits.clear()
                return out

            for f in frames:
                for row, items in zip(f["row"], f["items"], strict=True):
                    rows.append(row)
                    hits.append([place[x] for x in items if x in place])
                    if len(rows) == BLOCK_ROWS:
                        yield block()
            if rows:
                yield block()

        self.blocks = keep(transactions.select("row", "items").mapInPandas(pack, f"ids array<{self.types['row']}>, bits binary"))
        self.width = len(self.names)

    def roots(self) -> list[tuple]:
        return [((), -1, 1 << 62)]

    def weigh(self, candidates: list[tuple]) -> tuple[list[tuple], list[tuple]]:
        """(pattern, support) of the closed ones, and their children as (closed set, item, count)."""
        sets = [np.array([*base, item] if item >= 0 else base, np.int64) for base, item, _ in candidates]
        width = self.width

        def each(block) -> np.ndarray:
            bits = np.frombuffer(block["bits"], "<u8").reshape(width + 1, -1)
            out = np.empty((len(sets), 1, width + 1), np.int64)
            for k, s in enumerate(sets):
                out[k, 0] = np.bitwise_count(bits & np.bitwise_and.reduce(bits[np.append(s, width)], axis=0)).sum(axis=1)
            return out

        counts = _added(self.blocks, each, ["sum"], len(sets), width + 1)[:, 0]
        found, children = [], []
        for (base, item, _), n in zip(candidates, counts, strict=False):
            support, n = int(n[-1]), n[:-1]
            whole = np.flatnonzero(n == support)
            if not support or np.any(~np.isin(whole[whole < item], base)):
                continue
            found.append((tuple(whole.tolist()), support))
            more = np.flatnonzero((n > 0) & (n < support))
            children += [(found[-1][0], j, int(n[j])) for j in more[more > item].tolist()]
        return found, children

    @staticmethod
    def size(pattern: tuple) -> int:
        return len(pattern)

    @staticmethod
    def holders(block, pattern: tuple, width: int) -> np.ndarray:
        bits = np.frombuffer(block["bits"], np.uint8).reshape(width + 1, -1)
        return np.flatnonzero(np.unpackbits(np.bitwise_and.reduce(bits[[*pattern, -1]], axis=0), bitorder="little"))

    def shown(self, pattern: tuple) -> list:
        return [self.names[i] for i in pattern]

    column = "items"


class Sequences:
    """Rows of (row, sequence) as the rank of each column's group."""

    def __init__(self, sequences: DataFrame, floor: int) -> None:
        counts = sequences.select(F.explode(F.flatten("sequence")).alias("c")).groupBy("c").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= floor)
        rows = counts.orderBy("c").collect()  # as many as columns
        self.names, self.counts = [r.c for r in rows], [r.n for r in rows]
        place = {x: i for i, x in enumerate(self.names)}
        self.types = dict(sequences.dtypes)

        def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                for a in range(0, len(f), BLOCK_ROWS):
                    part = f.iloc[a : a + BLOCK_ROWS]
                    ranks = np.full((len(part), len(place)), -1, np.int32)
                    for i, groups in enumerate(part["sequence"]):
                        for g, columns in enumerate(groups):
                            for c in columns:
                                if c in place:
                                    ranks[i, place[c]] = g
                    yield pd.DataFrame({"ids": [part["row"].tolist()], "ranks": [ranks.tobytes()]})

        self.blocks = keep(sequences.select("row", "sequence").mapInPandas(pack, f"ids array<{self.types['row']}>, ranks binary"))
        self.width = len(self.names)

    def roots(self) -> list[tuple]:
        return [(((c,),), c, n) for c, n in enumerate(self.counts)]

    @staticmethod
    def held(ranks: np.ndarray, pattern: tuple) -> np.ndarray:
        last = ranks[:, pattern[0][0]]
        out = last >= 0
        for i, group in enumerate(pattern):
            for j, c in enumerate(group):
                if i or j:
                    out &= (ranks[:, c] > last) if j == 0 else (ranks[:, c] == last)
                    last = ranks[:, c]
        return np.flatnonzero(out)

    def weigh(self, candidates: list[tuple]) -> tuple[list[tuple], list[tuple]]:
        """(pattern, support) of the closed ones, and children as (pattern, column, count)."""
        width, patterns, holding = self.width, [p for p, *_ in candidates], Sequences.held

        def each(block) -> np.ndarray:
            ranks = np.frombuffer(block["ranks"], np.int32).reshape(-1, width)
            out = np.zeros((len(patterns), 5, width), np.int64)
            out[:, 1] = 1 << 40
            for k, p in enumerate(patterns):
                own = ranks[holding(ranks, p)]
                if len(own):
                    there = own >= 0
                    place = np.zeros(own.shape, np.int64)
                    for group in p:
                        at = own[:, group[0], None]
                        place += 2 * (own > at) + (own == at)
                    last = own[:, p[-1][0], None]
                    out[k] = there.sum(axis=0), np.where(there, place, 1 << 40).min(axis=0), np.where(there, place, -1).max(axis=0), (own == last).sum(axis=0), (own > last).sum(axis=0)
            return out

        found, children = [], []
        for p, (n, low, high, same, after) in zip(patterns, _added(self.blocks, each, ["sum", "min", "max", "sum", "sum"], len(patterns), width), strict=False):
            support, mine, last = int(n[p[0][0]]), {c for g in p for c in g}, p[-1][-1]
            if not support:
                continue
            fits = [c for c in range(width) if c not in mine and n[c] == support and low[c] == high[c]]
            end = 2 * len(p) - 1  # the place of the last group
            if any(low[c] < end or (low[c] == end and c < last) for c in fits):
                continue
            if not fits:
                found.append((p, support))
            children += [((*p[:-1], (*p[-1], c)), c, int(same[c])) for c in range(last + 1, width) if c not in mine and same[c]]
            children += [((*p, (c,)), c, int(after[c])) for c in range(width) if after[c]]
        return found, children

    @staticmethod
    def size(pattern: tuple) -> int:
        return sum(map(len, pattern))

    @staticmethod
    def holders(block, pattern: tuple, width: int) -> np.ndarray:
        return Sequences.held(np.frombuffer(block["ranks"], np.int32).reshape(-1, width), pattern)

    def shown(self, pattern: tuple) -> list:
        return [[self.names[c] for c in g] for g in pattern]

    column = "sequence"


class Search:
    """Closed patterns of min_size or more of a kind of rows, at a bound that may be lowered step by step."""

    def __init__(self, rows: Itemsets | Sequences, min_size: int, floor: int) -> None:
        self.rows, self.min_size, self.floor = rows, max(1, min_size), floor
        self.open, self.waiting = [], rows.roots() if rows.width else []
        self.found: list[tuple] = []
        self.tables: list[DataFrame] = []
        self.n, self.area = 0, 0

    def lower(self, least: int) -> None:
        """All closed patterns with a support of `least` or more are found after this."""
        self.open += [c for c in self.waiting if c[2] >= least]
        self.waiting = [c for c in self.waiting if c[2] < least]
        while self.open:
            now, self.open = self.open[-CHUNK:], self.open[:-CHUNK]
            found, children = self.rows.weigh(now)
            for p, support in found:
                if self.rows.size(p) >= self.min_size:
                    self.found.append((self.rows.shown(p), list(map(list, p)) if isinstance(p[0], tuple) else [list(p)], support))
                    self.n, self.area = self.n + 1, self.area + support * self.rows.size(p)
            for c in children:
                if c[2] >= self.floor:
                    (self.open if c[2] >= least else self.waiting).append(c)
            if len(self.found) >= HELD:
                self._flush()

    def _flush(self) -> None:
        if self.found or not self.tables:
            spark = self.rows.blocks.sparkSession
            self.tables.append(keep(spark.createDataFrame(self.found, f"{self.rows.column} {self.rows.types[self.rows.column]}, places array<array<int>>, support long")))
            self.found = []

    def patterns(self) -> DataFrame:
        """(id, items or sequence, support, rows)"""
        self._flush()
        out, rows, column = None, self.rows, self.rows.column
        kind, holders, width = rows.types["row"], type(rows).holders, rows.width
        for table in self.tables:
            # HELD patterns or so: what each block's task holds beside its rows
            wanted = [(r.id, tuple(map(tuple, r.places)) if column == "sequence" else tuple(r.places[0])) for r in table.select(F.xxhash64(F.to_json(column)).alias("id"), "places").collect()]

            def members(frames: Iterator[pd.DataFrame], wanted=wanted) -> Iterator[pd.DataFrame]:
                for f in frames:
                    for _, block in f.iterrows():
                        ids = np.asarray(block["ids"])
                        for a in range(0, len(wanted), 1000):
                            held = [(i, ids[at].tolist()) for i, p in wanted[a : a + 1000] if len(at := holders(block, p, width))]
                            yield pd.DataFrame(held, columns=["id", "part"])

            parts = rows.blocks.mapInPandas(members, f"id long, part array<{kind}>")
            held = parts.groupBy("id").agg(F.sort_array(F.flatten(F.collect_list("part"))).alias("rows"))
            mine = table.withColumn("id", F.xxhash64(F.to_json(column))).join(held, "id").select("id", column, "support", "rows")
            out = mine if out is None else out.unionByName(mine)
        return out


def least_count(share: float, n: int) -> int:
    return max(1, math.ceil(share * n))


@tidy
def closed(rows: DataFrame, kind: type, share: float, min_size: int) -> DataFrame:
    """The closed patterns that a share of the rows supports."""
    rows = keep(rows)
    least = least_count(share, rows.count())
    search = Search(kind(rows, least), min_size, least)
    search.lower(least)
    return search.patterns()


@tidy
def first_enough(rows: DataFrame, kind: type, shares: list[float], min_size: int, enough: Callable[[int, int], bool]) -> DataFrame:
    """The closed patterns at the first of falling shares where enough(patterns, rows x width in all) holds, else at the last: one search, whose bound falls."""
    rows = keep(rows)
    n = rows.count()
    floor = least_count(shares[-1], n)
    search = Search(kind(rows, floor), min_size, floor)
    for share in shares:
        search.lower(least_count(share, n))
        if enough(search.n, search.area):
            break
    return search.patterns()
