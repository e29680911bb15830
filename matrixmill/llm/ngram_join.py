"""N-gram Jaccard join on token-combination prefixes.

A document is the set of its five-word shingles, hashed to 64 bits. Two sets link when 100 * intersection is at
least 80 * union. A set of n shingles may miss at most e = n // 5 of them in a partner. In one order for all documents
(rare first) a prefix of each is indexed: rare shingles singly, frequent ones by combinations of k within small groups
of their class, k = 2, 3, 4 as the class grows more frequent. A group without a shared combination can hide at most
k - 1 shared shingles, so the prefix is extended until the shingles it proves missing exceed e. So no link is missed,
and frequent shingles make no long lists unless the documents share many of them. Groups depend on the power of two
below n; a set near such a bound is indexed on both sides of it.

Two bounds rule pairs out without their sets, and never a link. By position: of the first signature two sets share,
each knows how many of its shingles before it the other lacks, which leaves room for partners up to a size. By a
256-bit parity sketch: the bits in which two sketches differ are at most the shingles in which the sets differ.

Documents with equal sets are one class, found by a 128-bit digest, and only classes are compared. First, lists of up
to SMALL members are compared whole, and each member of a longer one with the heads of its lists, of which it takes two
that it may link with; exact verification makes links, links make components. Last, in each longer list that then holds several
components, what is outside its largest component is compared with all that is in another component and not ruled out;
a pair that stands in an earlier list too, as the signatures before tell, is left to that one. So a group of near copies
costs about as many comparisons as it has members, and no link between two components is lost.

The order is by a table of CELLS counters over all documents, then by hash. What a counter holds above the mean and its
noise tells the class. The table, and the filters of documents to verify, have a fixed size, so they can be sent to every task.

Defined cases: null and empty texts, and texts without a word, have no shingles and are components of their own;
a row without an id gets the component of the documents with the very same set, if any, else none;
with fewer than five words the whole sequence is one shingle; repeated rows form one class; texts are read whole;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import Tables, cut, map_texts, read, release_memos

WIDTH = 5
CELL_BITS, FILTER_BITS, BLOCK = 20, 24, 1 << 14
CELLS = 1 << CELL_BITS
#: counts above the noise from which shingles are combined by 2, 3 and 4
CLASSES = (32, 4096, 1 << 19)
#: lists of up to so many members are compared whole by their first and last one
SMALL = 3
#: signatures before each that tell whether a pair met in an earlier list
BEFORE = 16
SKETCH = ("s0", "s1", "s2", "s3")
#: bytes that are hashed at once, about; longer words than LONG are hashed one by one
PIECE, LONG = 1 << 19, 1 << 16
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]
_ODD, _ALL = int(_MIX[0]), (1 << 64) - 1
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_IS_SPACE = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))
_BYTE = np.random.default_rng(2024).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_POWER = np.cumprod(np.full(LONG, _MIX[0]))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: bytes) -> np.ndarray:
    """A hash of each word of lower-cased bytes, in order: the sum of its bytes' numbers times powers of an odd number, mixed."""
    out, start = [], 0
    while start < len(data):
        stop = start + PIECE
        if stop < len(data):
            found = _SPACE.search(data, stop)
            stop = found.start() if found else len(data)
        piece, start = data[start:stop], stop
        if len(piece) > PIECE + LONG and max(map(len, piece.split()), default=0) > LONG:
            words = piece.split()
            out.append(np.array([xxhash.xxh64_intdigest(w) if len(w) > LONG else word_hashes(w)[0] for w in words], np.uint64))
            continue
        b = np.frombuffer(piece, np.uint8)
        body = np.flatnonzero(~_IS_SPACE[b])
        if len(body):
            first = np.flatnonzero(np.diff(body, prepend=-2) > 1)
            length = np.diff(first, append=len(body))
            if length.max() > LONG:
                out.append(np.array([xxhash.xxh64_intdigest(w) if len(w) > LONG else word_hashes(w)[0] for w in piece.split()], np.uint64))
                continue
            within = np.arange(len(body)) - np.repeat(first, length)
            out.append(mix(np.add.reduceat(_BYTE[b[body]] * _POWER[within], first)))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingles(h: np.ndarray) -> np.ndarray:
    """Distinct shingle hashes of a sequence of word hashes, ascending."""
    if not len(h):
        return h
    width = min(WIDTH, len(h))
    total = np.full(len(h) - width + 1, width, np.uint64)
    for i in range(width):
        total += h[i : len(h) - width + 1 + i] * _MIX[i]
    return np.unique(mix(total))


def sets(texts: list[str | None]) -> list[np.ndarray]:
    """The shingle sets of a slice of texts."""
    docs = [(t or "").encode().lower() for t in texts]  # bytes: only A-Z change
    out: list[np.ndarray] = []
    group: list[bytes] = []

    def together() -> None:
        # short texts are hashed end to end, and their words told apart by count
        h = word_hashes(b" ".join(group))
        at = np.cumsum([0, *(len(d.split()) for d in group)]).tolist()
        out.extend(shingles(h[x:y]) for x, y in zip(at, at[1:]))
        group.clear()

    for d in docs:
        group.append(d)
        if sum(map(len, group)) > PIECE // 2:
            together()
    together()
    return out


def digest(s: np.ndarray) -> tuple[int, int]:
    x = xxhash.xxh3_128_intdigest(s.tobytes())
    return (x >> 64) - (1 << 63), (x & (1 << 64) - 1) - (1 << 63)


def cell(x: np.ndarray, bits: int = CELL_BITS) -> np.ndarray:
    return (x >> np.uint64(64 - bits)).astype(np.int64)


def blocks(table: np.ndarray) -> list[tuple[int, bytes]]:
    """A table of counters or flags in parts, so that it is added up in many tasks; packed, as most of one task's cells are empty. Parts of zeros are left out."""
    parts = table.reshape(-1, BLOCK)
    return [(i, zlib.compress(parts[i].astype("<i4").tobytes(), 1)) for i in np.flatnonzero(parts.any(axis=1)).tolist()]


def added(parts: DataFrame, cells: int, kind: type = np.int32) -> np.ndarray:
    """The sum of many tables given as (block, task, counts). Two steps, so that no task reads the parts of all tasks. What arrives here has a fixed size."""

    def add(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(BLOCK, np.int64)
        for c in f["counts"]:
            total += np.frombuffer(zlib.decompress(c), "<i4")
        packed = zlib.compress(np.minimum(total, (1 << 31) - 1).astype("<i4").tobytes(), 1)
        return pd.DataFrame({"block": [key[0]], "task": [0], "counts": [packed]})

    some = parts.groupBy("block", F.pmod("task", F.lit(64))).applyInPandas(lambda k, f: add(k, f), "block int, task long, counts binary")
    out = np.zeros(cells, kind)
    for r in some.groupBy("block").applyInPandas(add, "block int, task long, counts binary").collect():
        out[r.block * BLOCK : (r.block + 1) * BLOCK] = np.frombuffer(zlib.decompress(r.counts), "<i4")
    return out


def described(docs: DataFrame, tables: Tables) -> tuple[DataFrame, np.ndarray]:
    """A table with (doc_id, n, d1, d2) of each document where block is null, and the counters over all shingles of all documents. The texts are read once for both."""

    def make():
        from pyspark import TaskContext

        release_memos()
        counts = np.zeros(CELLS, np.int64)

        def each(rows: dict | None) -> dict:
            if rows is None:
                held = blocks(counts)
                nothing = [None] * len(held)
                return {"doc_id": nothing, "n": nothing, "d1": nothing, "d2": nothing, "block": [b for b, _ in held], "task": [TaskContext.get().partitionId()] * len(held), "counts": [c for _, c in held]}
            found = sets(rows["text"])
            for s in found:
                np.add.at(counts, cell(s), 1)
            ids, nothing = [digest(s) for s in found], [None] * len(found)
            return {"doc_id": rows["doc_id"], "n": [len(s) for s in found], "d1": [d for d, _ in ids], "d2": [d for _, d in ids], "block": nothing, "task": nothing, "counts": nothing}

        return each

    both = tables.keep(map_texts(docs, make, "doc_id long, n long, d1 long, d2 long, block int, task long, counts binary", flush=True))
    return both, added(both.filter("block is not null").select("block", "task", "counts"), CELLS)


def bounds(counts: np.ndarray) -> tuple[int, ...]:
    """The least count that tells shingles apart, and the counts above which they are combined: CLASSES above the mean of a cell and its noise."""
    mean = float(counts.mean())
    return int(max(0, mean - 5 * mean**0.5)), *(int(mean + 3 * mean**0.5) + c for c in CLASSES)


def mix_int(x: int) -> int:
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & _ALL
    x = (x ^ x >> 27) * 0x94D049BB133111EB & _ALL
    return x ^ x >> 31


def combined(tokens: list[int], kinds: list[int], missing: int, e: int, level: int) -> list[tuple[int, int, int]]:
    """Of frequent shingles in order: place of a combination's first shingle, signature, and how many shingles before it a partner is known to lack.

    kinds: the k of each shingle's class. missing: the rare shingles before them. Small sets have fewer classes, so that
    what their groups can hide never uses up the set.
    """
    largest = min(len(CLASSES) + 1, level)
    held: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
    found: list[tuple[int, int, int]] = []
    for at, (t, kind) in enumerate(zip(tokens, kinds, strict=True)):
        k = min(kind, largest)
        group = held.setdefault((k, mix_int(t ^ 0xA5A5A5A5A5A5A5A5) % -(-(1 << level) // (5 * k))), [])
        for others in combinations(group, k - 1):
            x = level + 1
            for o, _, _ in others:
                x = mix_int(x * _ODD + o & _ALL)
            found.append((others[0][2], mix_int(x * _ODD + t & _ALL), others[0][1]))
        group.append((t, missing, at))
        if len(group) >= k:
            missing += 1
            if missing > e:
                break
    return found


def prefix_of(s: np.ndarray, counts: np.ndarray, most: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of one set (int64), and for each the room it leaves: 4 times a partner's size is at most that. counts: the counters; most: bounds().

    They come in an order that is the same for all sets: by their first shingle, then by value. What two sets lack
    before a signature holds for the first one they share.
    """
    n = len(s)
    e = n // 5
    if n < 4:  # only an equal set can link; 4 shingles can lie in a set of 5
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    count = counts[cell(s)].astype(np.int64)
    # the order for all: by counter, then by hash. A signature of one shingle is its place in that order.
    place = (np.clip(count - most[0], 0, (1 << 19) - 1) << 44) | (s >> np.uint64(20)).astype(np.int64)
    rare = place[count <= most[1]]
    if len(rare) > e:
        first = np.sort(rare[rare <= np.partition(rare, e)[e]])
        return first, 5 * n - 9 * np.arange(len(first))
    first = np.sort(rare)
    often = count > most[1]
    order = np.lexsort((s[often], place[often]))
    tokens, kinds = s[often][order].tolist(), (np.searchsorted(most[1:], count[often][order], "left") + 1).tolist()
    level, more = n.bit_length() - 1, []
    for lv in (level, level - 1) if level > 2 and 4 * n < 5 << level else (level,):
        more += combined(tokens, kinds, len(first), e, lv)
    more.sort()
    lacks = np.concatenate([np.arange(len(first)), np.array([x[2] for x in more], np.int64)])
    return np.concatenate([first, np.array([x[1] for x in more], np.uint64).view(np.int64)]), 5 * n - 9 * lacks


def sketch(s: np.ndarray) -> list[int]:
    """256 parities, by the lowest byte of the shingles: two sketches differ in at most as many bits as the sets in shingles."""
    return np.packbits((np.bincount((s & np.uint64(255)).astype(np.int64), minlength=256) & 1).astype(bool)).view(np.int64).tolist()


def signatures(docs: DataFrame, counts: np.ndarray) -> DataFrame:
    """(d1, n, sketch, sigs, rooms): once for the equal sets that one task meets."""
    most = bounds(counts)

    def make():
        met: set[int] = set()
        names = ("d1", "n", *SKETCH, "sigs", "rooms")

        def each(rows: dict) -> dict:
            out: dict[str, list] = {k: [] for k in names}
            for s in sets(rows["text"]):
                d1 = digest(s)[0]
                if d1 not in met:
                    met.add(d1)
                    sigs, rooms = prefix_of(s, counts, most)
                    if len(sigs):
                        for k, v in zip(names, (d1, len(s), *sketch(s), sigs, rooms), strict=True):
                            out[k].append(v)
            return out

        return each

    return map_texts(docs, make, f"d1 long, n long, {', '.join(f'{s} long' for s in SKETCH)}, sigs array<long>, rooms array<long>")


def flag_words(ids: DataFrame, column: str) -> DataFrame:
    """(word, bits): a filter of fixed size, at most 2^18 words: the bits given by the last FILTER_BITS bits of a column."""
    return ids.groupBy(word_of(F.col(column)).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col(column).bitwiseAND(F.lit(63)).cast("int"))).alias("bits"))


def word_of(c: Column) -> Column:
    return F.shiftright(c.bitwiseAND(F.lit((1 << FILTER_BITS) - 1)), 6).cast("int")


def flags(ids: DataFrame, column: str) -> np.ndarray:
    """The words of a filter, here."""
    words = flag_words(ids, column).toArrow()
    out = np.zeros(1 << FILTER_BITS - 6, np.int64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy()
    return out


def flagged(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    x = x.view(np.int64)
    return (words[(x & ((1 << FILTER_BITS) - 1)) >> 6] >> (x & 63)) & 1 == 1


def differ_little(x: str, y: str) -> Column:
    """Whether the sketches of two sides leave a link possible; columns n_x, s0_x, ..."""
    bits = sum((F.bit_count(F.col(f"{k}_{x}").bitwiseXOR(F.col(f"{k}_{y}"))) for k in SKETCH), F.lit(0))
    return 9 * bits <= F.col(f"n_{x}") + F.col(f"n_{y}")


def room_enough() -> Column:
    return (4 * F.col("n_x") <= F.col("room_y")) & (4 * F.col("n_y") <= F.col("room_x"))


def side(info: DataFrame, x: str) -> DataFrame:
    return info.select(F.col("d1").alias(x), *(F.col(k).alias(f"{k}_{x}") for k in ("n", *SKETCH)))


def shingle_arrays(docs: DataFrame, wanted: np.ndarray) -> DataFrame:
    """(d1, d2, n, shingles) of the documents whose ids the filter lets through, once for each class. Only their texts are hashed."""

    def make():
        release_memos()
        met: set[tuple[int, int]] = set()

        def each(rows: dict) -> dict:
            out: dict[str, list] = {"d1": [], "d2": [], "n": [], "shingles": []}
            hit = flagged(np.array(rows["h"], np.int64), wanted)
            for s in sets([t for t, x in zip(rows["text"], hit, strict=True) if x]):
                d = digest(s)
                if len(s) and d not in met:
                    met.add(d)
                    for k, v in zip(out, (*d, len(s), s.view(np.int64)), strict=True):
                        out[k].append(v)
            return out

        return each

    return map_texts(docs.select(F.xxhash64("doc_id").alias("h"), "text"), make, "d1 long, d2 long, n long, shingles array<long>", ("h", "text"))


def verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, tables: Tables) -> DataFrame:
    """Of pairs (a, b) of d1 values the links, as (u, v) of the classes' representatives."""
    reps = pairs.select(F.explode(F.array("a", "b")).alias("d1")).distinct().join(classes, "d1").select(F.xxhash64("rep").alias("h"))
    arrays = tables.keep(shingle_arrays(docs, flags(reps, "h")))
    left = arrays.select(F.col("d1").alias("a"), F.col("d2").alias("a2"), F.col("n").alias("a_n"), F.col("shingles").alias("a_set"))
    right = arrays.select(F.col("d1").alias("b"), F.col("d2").alias("b2"), F.col("n").alias("b_n"), F.col("shingles").alias("b_set"))
    sized = pairs.join(left, "a").join(right, "b")
    common = F.size(F.array_intersect("a_set", "b_set")).cast("long")
    linked = sized.select("a", "a2", "b", "b2", (F.col("a_n") + F.col("b_n")).alias("n"), common.alias("common")).filter(180 * F.col("common") >= 80 * F.col("n")).select("a", "a2", "b", "b2").distinct()
    ends = [classes.select(F.col("d1").alias(x), F.col("d2").alias(f"{x}2"), F.col("rep").alias(name)) for x, name in (("a", "u"), ("b", "v"))]
    links = tables.keep(linked.join(ends[0], ["a", "a2"]).join(ends[1], ["b", "b2"]).select("u", "v"))
    tables.drop(arrays)
    return links


def components(links: DataFrame, tables: Tables) -> DataFrame:
    """(u, component) for every end of a link (u, v): the smallest end reachable. Rounds of neighbour minima and pointer jumps, each kept in the shared folder."""
    both = tables.keep(links.select("u", "v").union(links.select("v", "u")).filter("u <> v").distinct())
    labels = tables.keep(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("c")))
    while True:
        near = both.join(labels.withColumnRenamed("u", "v").withColumnRenamed("c", "m"), "v").groupBy("u").agg(F.min("m").alias("m"))
        lower = labels.join(near, "u").select("u", F.col("c").alias("old"), F.least("c", "m").alias("c"))
        up = labels.select(F.col("u").alias("c"), F.col("c").alias("top"))
        after = tables.keep(lower.join(up, "c", "left").select("u", "old", F.least("c", F.coalesce("top", "c")).alias("c")))
        done = after.filter("c <> old").isEmpty()
        tables.drop(labels)
        labels = after
        if done:
            tables.drop(both)
            return labels.select("u", F.col("c").alias("component"))


def listed(sigs: DataFrame) -> DataFrame:
    """(sig, d1, pos, room, size, lo, hi) of the signatures that several classes hold: the list's length, and its first and last class, each with the room it has there."""
    each = sigs.select("d1", F.posexplode(F.arrays_zip("sigs", "rooms")).alias("pos", "x")).select("d1", "pos", F.col("x.sigs").alias("sig"), F.col("x.rooms").alias("room"))
    # of a class that several tasks met, the most room
    lo, hi = F.min(F.struct("d1", (-F.col("room")).alias("less"))), F.max(F.struct("d1", "room"))
    tops = each.groupBy("sig").agg(F.count(F.lit(1)).alias("size"), lo.alias("lo"), hi.alias("hi")).filter("lo.d1 <> hi.d1")
    tops = tops.select("sig", "size", F.struct(F.col("lo.d1").alias("d1"), (-F.col("lo.less")).alias("room")).alias("lo"), "hi")
    return each.join(tops, "sig")


def first_pairs(members: DataFrame, info: DataFrame) -> DataFrame:
    """Pairs (a, b) of d1 values that may link: all of the short lists; of longer ones each class with the first and the last of the heads it may link with."""
    met = members.select(F.col("d1").alias("x"), F.col("room").alias("room_x"), "size", F.explode(F.array("lo", "hi")).alias("y")).select("x", "room_x", "size", F.col("y.d1").alias("y"), F.col("y.room").alias("room_y")).filter("x <> y")
    # the most room of a pair is that of the first signature it shares
    met = met.groupBy("x", "y").agg(F.max("room_x").alias("room_x"), F.max("room_y").alias("room_y"), F.min("size").alias("size"))
    met = met.join(side(info, "x"), "x").join(side(info, "y"), "y").filter(room_enough() & differ_little("x", "y")).select("x", "y", "size")
    long = met.filter(F.col("size") > SMALL).groupBy("x").agg(F.array_distinct(F.array(F.min("y"), F.max("y"))).alias("y")).select("x", F.explode("y").alias("y"))
    return met.filter(F.col("size") <= SMALL).select("x", "y").unionByName(long).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def still_mixed(members: DataFrame, of: DataFrame, info: DataFrame) -> DataFrame:
    """(sig, d1, n, room, sketch, c, before) of the longer lists that hold several components; before: the set's signatures ahead of this one there, up to BEFORE."""
    longer = members.filter(F.col("size") > SMALL).select("sig", "d1", "pos", "room")
    mixed = longer.join(of, "d1").groupBy("sig").agg(F.min("c").alias("x"), F.max("c").alias("y")).filter("x <> y").select("sig")
    # by class; equal sets that several tasks met fall together. A class has no more entries than signatures.
    own = longer.join(mixed, "sig").groupBy("d1").agg(F.sort_array(F.collect_set(F.struct("pos", "sig", "room"))).alias("own"))
    at = lambda i: F.greatest(F.lit(0), i - BEFORE)
    ahead = F.transform("own", lambda e, i: F.struct(e["sig"].alias("sig"), e["room"].alias("room"), F.transform(F.slice("own", at(i) + 1, i - at(i)), lambda b: b["sig"]).alias("before")))
    return own.join(info, "d1").join(of, "d1").select("d1", "n", *SKETCH, "c", F.explode(ahead).alias("e")).select("e.sig", "d1", "n", "e.room", *SKETCH, "c", "e.before")


def across(rest: DataFrame) -> DataFrame:
    """Pairs (a, b) of every list: what is outside its largest component with all of other components that it may link with, where no earlier list has the pair."""
    largest = rest.groupBy("sig", "c").agg(F.count(F.lit(1)).alias("k")).groupBy("sig").agg(F.max(F.struct("k", "c")).alias("top")).select("sig", F.col("top.c").alias("largest"))
    names = ("d1", "n", "room", *SKETCH, "c", "before")
    x = rest.join(largest, "sig").filter("c <> largest").select("sig", *(F.col(k).alias(f"{k}_x") for k in names))
    y = rest.select("sig", *(F.col(k).alias(f"{k}_y") for k in names))
    met = x.join(y, "sig").filter((F.col("c_x") != F.col("c_y")) & room_enough() & differ_little("x", "y") & ~F.arrays_overlap("before_x", "before_y"))
    return met.select(F.least("d1_x", "d1_y").alias("a"), F.greatest("d1_x", "d1_y").alias("b")).distinct()


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and n_class (documents with the very same set) of each document.

    Two small tables (a row a document, a row a class) stay in the shared folder for the result to read; all others are deleted.
    """
    tables = Tables(docs.sparkSession)
    both, counts = described(docs, tables)
    rows = both.filter("block is null").select("doc_id", "n", "d1", "d2")
    docs = docs.filter("doc_id is not null")
    classes = tables.keep(rows.filter("n > 0 and doc_id is not null").groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n_class")))
    sigs = tables.keep(signatures(docs, counts))
    info = tables.keep(sigs.select("d1", "n", *SKETCH).dropDuplicates(["d1"]))
    members = tables.keep(listed(sigs))
    tables.drop(sigs)
    pairs = tables.keep(first_pairs(members, info))
    links = verified(pairs, classes, docs, tables)
    found = components(links, tables)
    # longer lists that still hold several components
    of = tables.keep(classes.join(found, classes.rep == found.u, "left").select("d1", F.coalesce("component", "rep").alias("c")).groupBy("d1").agg(F.min("c").alias("c")))
    rest = tables.keep(still_mixed(members, of, info))
    tables.drop(members)
    more = tables.keep(across(rest).join(pairs, ["a", "b"], "left_anti"))
    tables.drop(rest)
    if not more.isEmpty():
        found = components(links.union(verified(more, classes, docs, tables)), tables)
    ids = tables.keep(classes.join(found, classes.rep == found.u, "left").select("d1", "d2", F.coalesce("component", "rep").alias("component_id"), "n_class"))
    tables.drop_all_but(both, ids)
    out = rows.join(ids, ["d1", "d2"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("n_class", F.lit(1)).alias("n_class"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The document with the smallest doc_id of each component, all its columns. Of repeated rows one stays; rows without an id all stay.

    A filter of fixed size tells most rows that surely stay, so their texts do not move; the others meet the exact list.
    """
    found = cut(jaccard_components(docs).filter("doc_id is not null").select("doc_id", (F.col("doc_id") == F.col("component_id")).alias("first")))
    kept = cut(found.filter("first").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")))
    doubtful = found.filter("not first").select("doc_id").unionByName(kept.filter("n > 1").select("doc_id"))
    word, bits = ("_" * (1 + max(map(len, docs.columns))) + c for c in "wb")  # longer than any name there
    # at most 2^18 rows, whatever the input
    words = F.broadcast(flag_words(doubtful.select(F.xxhash64("doc_id").alias("h")), "h").toDF(word, bits))
    h = F.xxhash64("doc_id")
    met = docs.withColumn(word, word_of(h)).join(words, word, "left")
    hit = F.coalesce(F.call_function("shiftright", F.col(bits), h.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1, F.lit(False)) & F.col("doc_id").isNotNull()
    columns = [F.col(f"`{c}`") for c in docs.columns]
    out = met.filter(~hit).select(columns)
    suspects = met.filter(hit).select(columns)
    out = out.unionByName(suspects.join(kept.filter("n = 1"), "doc_id", "left_semi"))
    repeated = kept.filter("n > 1")
    if not repeated.isEmpty():
        out = out.unionByName(suspects.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id"]))
    return out


def op8_token_combination_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read(spark, sf_dir, "documents")).drop("n_class")
