"""Approximate nearest neighbours: a robust-pruned directed graph in each shard, queried by beam search.

Vectors are dealt by hash of id and components into shards of about SHARD rows. In a shard, vectors join the graph in batches of growing
size: a greedy search from the medoid proposes neighbours, and relaxed pruning keeps one only if no neighbour kept
before is closer to it by the factor ALPHA than the vector itself, so kept edges point different ways. Reverse edges
are added and pruned alike; a second pass over all vectors refines the graph. The index is one row a shard. Every
query comes to each shard once, and a beam search there returns the k nearest found, with exact distances in double
precision; a query's answers of all shards are merged by rank.

Repeated rows are counted before they are dealt, and equal vectors of a shard are one node with the list of their ids,
so groups of copies, however large, neither fill a shard, cut the graph into pieces nor lose ties. Vectors of different length never compare: shards and searches go by length.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components take no part, as queries or
candidates; repeated rows are candidates each, and a query's own rows are left out by its id; a query that is repeated
is asked once, and different vectors under one query id are queries each, with ranks 1 to k of their own under that id;
fewer candidates than k give fewer rows; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .base import cut, read

K, SHARD, BLOCK = 10, 8192, 512
DEGREE, BEAM, SEARCH_BEAM, ALPHA = 24, 40, 100, 1.2


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding) of the vectors that take part, as doubles without negative zeros."""
    v = F.col("embedding")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.select(F.col("vec_id").cast("long"), F.transform(v.cast("array<double>"), lambda x: x + F.lit(0.0)).alias("embedding")).filter(F.col("vec_id").isNotNull() & v.isNotNull()).filter(finite & F.exists(v, lambda x: x != 0))


def distances(x: np.ndarray, norms: np.ndarray, q: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Squared distances, less the query's own square, of rows q to the nodes at (one list a row); -1 marks no node."""
    d = norms[at] - 2 * np.einsum("bkd,bd->bk", x[at], q, optimize=False)
    d[at < 0] = np.inf
    return d


def search(x: np.ndarray, norms: np.ndarray, edges: np.ndarray, entry: int, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Beam search for many queries at once: the beam's nodes and their distances, nearest first; -1 where there is none."""
    n = len(q)
    nodes = np.full((n, beam), -1, np.int64)
    dist = np.full((n, beam), np.inf, np.float32)
    nodes[:, 0] = entry
    dist[:, 0] = distances(x, norms, q, np.full((n, 1), entry))[:, 0]
    opened = np.zeros((n, beam), bool)
    live = np.arange(n)
    while len(live):
        wait = np.where(opened[live] | (nodes[live] < 0), np.inf, dist[live])
        pick = wait.argmin(axis=1)
        live, pick = live[(go := np.isfinite(wait[np.arange(len(live)), pick]))], pick[go]
        if not len(live):
            break
        opened[live, pick] = True
        near = edges[nodes[live, pick]]
        near = np.where((near[:, :, None] == nodes[live][:, None, :]).any(axis=2), -1, near)
        both = np.concatenate([nodes[live], near], axis=1)
        d = np.concatenate([dist[live], distances(x, norms, q[live], near)], axis=1)
        done = np.concatenate([opened[live], np.zeros(near.shape, bool)], axis=1)
        keep = np.argsort(d, axis=1, kind="stable")[:, :beam]
        nodes[live] = np.where(np.isfinite(np.take_along_axis(d, keep, 1)), np.take_along_axis(both, keep, 1), -1)
        dist[live], opened[live] = np.take_along_axis(d, keep, 1), np.take_along_axis(done, keep, 1)
    return nodes, dist


def prune(x: np.ndarray, p: int, candidates: np.ndarray, alpha: float, degree: int) -> np.ndarray:
    """Robust pruning: nearest first, each kept candidate rules out those it is alpha times closer to than p is."""
    candidates = np.unique(candidates[(candidates >= 0) & (candidates != p)])
    c = x[candidates]
    d = ((c - x[p]) ** 2).sum(axis=1)
    order = np.argsort(d, kind="stable")
    candidates, c, d = candidates[order], c[order], d[order]
    sq = (c**2).sum(axis=1)
    among = sq[:, None] + sq[None, :] - 2 * c @ c.T
    alive, out = np.ones(len(candidates), bool), []
    for i in range(len(candidates)):
        if alive[i]:
            out.append(candidates[i])
            if len(out) == degree:
                break
            alive &= alpha * alpha * among[i] > d
    return np.array(out, np.int64)


def build(x: np.ndarray, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA, seed: int = 3) -> tuple[np.ndarray, int]:
    """Edges (n, degree), -1 filled, and the entry node of distinct vectors x (float32)."""
    n = len(x)
    norms = (x**2).sum(axis=1)
    entry = int(((x - x.mean(axis=0)) ** 2).sum(axis=1).argmin())
    edges = np.full((n, degree), -1, np.int64)
    order = np.random.default_rng(seed).permutation(n)
    order = np.concatenate([[entry], order[order != entry]])

    def link(p: int, candidates: np.ndarray, a: float) -> None:
        kept = prune(x, p, candidates, a, degree)
        edges[p] = -1
        edges[p, : len(kept)] = kept

    def insert(batch: np.ndarray, a: float) -> None:
        found, _ = search(x, norms, edges, entry, x[batch], beam)
        back: dict[int, list[int]] = {}
        for p, f in zip(batch.tolist(), found, strict=True):
            link(p, np.concatenate([f, edges[p]]), a)
            for t in edges[p][edges[p] >= 0].tolist():
                back.setdefault(t, []).append(p)
        for t, more in back.items():
            own = edges[t][edges[t] >= 0]
            new = np.setdiff1d(more, own)
            if len(own) + len(new) <= degree:
                edges[t, len(own) : len(own) + len(new)] = new
            else:
                link(t, np.concatenate([own, new]), a)

    start, size = 1, 1
    while start < n:  # each batch no larger than what the graph holds, so that it finds its neighbours there
        insert(order[start : start + size], 1.0)
        start, size = start + size, min(512, start + size)
    for start in range(0, n, 512):
        insert(order[start : start + 512], alpha)
    return edges, entry


INDEX = "shard int, dim int, n int, entry int, nodes binary, edges binary, firsts binary, ids binary, copies binary"


def key_runs(frames: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[tuple, pd.DataFrame]]:
    """The runs of rows of one key in batches that come sorted by key; a run may go on in the next batch."""
    for f in frames:
        changed = np.flatnonzero((f[keys] != f[keys].shift()).any(axis=1).to_numpy())
        for a, b in zip(changed, [*changed[1:], len(f)], strict=True):
            yield tuple(int(v) for v in f[keys].iloc[a]), f.iloc[a:b]


def build_index(vectors: DataFrame, shard_rows: int = SHARD) -> DataFrame:
    """One row a shard: distinct vectors (float64), edges, and the ids of each node, ascending, with how many rows each id has there. A task builds one shard after another."""
    rows = usable(vectors)
    key = F.xxhash64("vec_id", "embedding")
    shards = max(1, -(-rows.select(key).distinct().count() // shard_rows))

    def graph(key: tuple, parts: list[pd.DataFrame]) -> pd.DataFrame:
        f = pd.concat(parts)
        x = np.stack(f["embedding"].to_numpy()).astype(np.float64)
        ids, copies = f["vec_id"].to_numpy(), f["copies"].to_numpy()
        nodes, of = np.unique(x, axis=0, return_inverse=True)
        order = np.lexsort((ids, of.ravel()))
        firsts = np.searchsorted(of.ravel()[order], np.arange(len(nodes) + 1))
        edges, entry = build(nodes.astype(np.float32))
        return pd.DataFrame([(key[0], key[1], len(nodes), entry, nodes.tobytes(), edges.astype("<i4").tobytes(), firsts.astype("<i8").tobytes(), ids[order].astype("<i8").tobytes(), copies[order].astype("<i8").tobytes())], columns=[c.split()[0] for c in INDEX.split(", ")])

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, parts = None, []
        for key, f in key_runs(frames, ["shard", "dim"]):
            if key != now and parts:
                yield graph(now, parts)
                parts = []
            now = key
            parts.append(f)
        if parts:
            yield graph(now, parts)

    distinct = rows.groupBy("vec_id", "embedding").agg(F.count(F.lit(1)).alias("copies"))
    dealt = distinct.select("vec_id", "embedding", "copies", F.pmod(key, F.lit(shards)).cast("int").alias("shard"), F.size("embedding").alias("dim"))
    # a shard is a partition: neither chance nor coalescing puts two large ones in one task
    return dealt.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "dim").mapInPandas(each, INDEX)


ANSWER = "query long, query_id long, vec_id long, score double"


def search_index(index: DataFrame, queries: DataFrame, k: int = K, beam: int = SEARCH_BEAM, block_rows: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found in all shards, ties to the smaller id, for each distinct (vec_id, embedding) of the queries.

    Each shard stays where it is and every query comes to it once, in blocks; a task holds one shard and one block.
    """
    index = cut(index)
    # numbered, then kept: the number tells different vectors of one id apart
    queries = cut(usable(queries).distinct().withColumn("query", F.monotonically_increasing_id())).withColumn("dim", F.size("embedding"))
    # every query goes to every shard of its vectors' length: the shards are few and their names bounded
    names = index.groupBy("dim").agg(F.collect_list("shard").alias("shards"))
    sent = queries.join(names, "dim").select("dim", "query", "vec_id", "embedding", F.explode("shards").alias("shard"))
    # ids are never null here, or pandas would hold them as floats
    zero = F.lit(0).cast("long")
    both = index.select("*", F.lit(0).alias("kind"), zero.alias("query"), zero.cast(dict(queries.dtypes)["vec_id"]).alias("vec_id")).unionByName(sent.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    shards = (index.agg(F.max("shard").alias("s")).first().s or 0) + 1

    def answers(s: dict, asked: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, int, float]] = []
        nodes, x, edges, firsts, ids, copies = (s[c] for c in ("nodes", "x", "edges", "firsts", "ids", "copies"))
        q = np.stack(asked["embedding"].to_numpy())
        found, _ = search(x, s["norms"], edges, s["entry"], q.astype(np.float32), max(beam, k + 1))
        for query, qid, v, near in zip(asked["query"].tolist(), asked["vec_id"].tolist(), q, found, strict=True):
            near = near[near >= 0]
            exact = np.sqrt(((nodes[near] - v) ** 2).sum(axis=1))
            # of equal vectors the k + 1 smallest ids are all that can rank
            rows = [(d, int(ids[p])) for d, at in zip(exact.tolist(), near.tolist(), strict=True) for p in range(firsts[at], min(firsts[at + 1], firsts[at] + k + 1)) if ids[p] != qid for _ in range(min(k, copies[p]))]
            out += [(query, qid, i, d) for d, i in sorted(rows)[:k]]
        return pd.DataFrame(out, columns=["query", "query_id", "vec_id", "score"])

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for key, f in key_runs(frames, ["shard", "dim", "kind"]):
            if key[2] == 0:  # the shard comes ahead of its queries
                s = f.iloc[0]
                nodes = np.frombuffer(s["nodes"]).reshape(int(s["n"]), -1)
                x = nodes.astype(np.float32)
                held = {"nodes": nodes, "x": x, "norms": (x**2).sum(axis=1), "edges": np.frombuffer(s["edges"], "<i4").reshape(len(x), -1).astype(np.int64), "entry": int(s["entry"])}
                held |= {c: np.frombuffer(s[c], "<i8") for c in ("firsts", "ids", "copies")}
            else:
                for a in range(0, len(f), block_rows):
                    yield answers(held, f.iloc[a : a + block_rows])

    found = both.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "dim", "kind", "query").mapInPandas(each, ANSWER)
    rank = F.row_number().over(Window.partitionBy("query").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def is_query(vec_id: Column) -> Column:
    return vec_id % 100 == 0


def op3_robust_pruned_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return search_index(build_index(vectors), vectors.filter(is_query(F.col("vec_id"))))
