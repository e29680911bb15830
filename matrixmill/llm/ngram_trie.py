"""LM scoring: an Elias-Fano trie of word trigrams with quantised smoothed probabilities, in shards.

Model. p(token | two before) is interpolated absolute discounting down to the unigrams, over all training words: each has
its own unigram, bigrams and trigrams, however rare. An unseen word is one outcome beside the known ones, as in the base
score: it gets what the known words' counts are discounted by, plus one. Probabilities sum to one over the known words, the
end and the unseen. Only who asks for n_words gets a class model: the n_words most frequent words are told apart, the
others share one id, RARE, and are then known by their own share within it.

Ids. The WORDS most frequent words have short ids, the same everywhere. Any other word goes by its hash; rows that hold such
words bring a list of their hashes and number them from RARE + 1 on, and so does each shard. No table of all words is needed
anywhere.

Shards. A trigram (u, v, w) belongs to the shard of its middle word v; a middle word with more than a shard's share
of the tokens is dealt by u over as many shards as its share asks. A shard holds, each level monotone and in Elias-Fano
form: the words that follow each v; the words u before each v; and for each (v, u) the words that follow, each as its
place among the followers of v alone, which is a small number. A query finds w among v's followers, u among v's
predecessors, then that place within (v, u): three successor searches. Probabilities and back-off weights are 16-bit
steps of log10. A task lays its shard's levels into one file, maps it into memory, and answers all n-grams that texts ask there:
each distinct one once, in ascending order.

Spark's part: (1) words are counted, (2) bigrams of the training texts are counted, those that end in a word without a short
id where that word is counted, so that they take its count along; each list of followers is sent to the shards of its first
word, (3) every text's trigrams, sorted and packed in blocks of the texts' tasks, go to their shards once: those of training
texts are counted into the trie there, and all are answered from it, (4) what came down to the unigram of a word without a
short id asks where that word is counted. What comes back are sums per document of each block. Nothing but the WORDS ids
and counts, of fixed size, reaches the driver or is sent to all tasks.

Words are known by 64-bit hashes. Counts are over all training texts, without cut-off.

Defined cases: null and empty texts are one end token; a row without an id is scored but not learned from; repeated rows
count and are scored each; texts are read whole; without any training text every token has probability one (the unseen
word is the only outcome); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import tempfile
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import Tables, held_out, id_mod, read, release_memos, slices
from .elias_fano import EliasFano
from .ngram_join import _IS_SPACE, PIECE, mix, word_hashes

ID_BITS = 16
START, END, RARE = (1 << ID_BITS) - 3, (1 << ID_BITS) - 2, (1 << ID_BITS) - 1
#: words with short ids; all others go by hash
WORDS = START
DISCOUNT, STEP = 0.75, 4096
#: bytes of text behind one shard, and tokens that a task gathers before it sends them
SHARD_BYTES, FLUSH = 16 << 20, 1 << 21
#: leading bits by which a word's short id is looked up
SLOT_BITS = 20
#: trigrams in one row of wide keys: they and their names fit 21 bits a word
WIDE_ROW = 1 << 19

# kinds of rows on the way to a shard
TRAIN, ASKED, RARE_ASKED, FOLLOWERS, COUNTS, DOCS, TRAIN_WIDE, ASKED_WIDE, FOLLOWERS_WIDE, BACKED_OFF = range(10)
ROW = "shard int, kind int, flush long, a binary, b binary, c binary"
_ROW = pa.schema([("shard", pa.int32()), ("kind", pa.int32()), ("flush", pa.int64()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())])
_64 = np.uint64


def pack(x: np.ndarray) -> bytes:
    """Whole numbers from 0 as compressed byte planes."""
    planes = np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    used = 8
    while used > 1 and not planes[used - 1].any():
        used -= 1
    return bytes([used]) + zstandard.ZstdCompressor(level=1).compress(planes[:used].tobytes())


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), np.uint8).reshape(data[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : data[0]] = planes.T
    return out.view("<u8").ravel().astype(np.uint64, copy=False)


def pack_sorted(x: np.ndarray) -> bytes:
    return pack(np.diff(x.astype(np.uint64), prepend=_64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data), dtype=np.uint64)


def pack_floats(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(x.astype("<f8").tobytes())


def unpack_floats(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), "<f8")


def hashed(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words of the texts, in order, and how many words each text has."""
    out, sizes, group, held = [np.zeros(0, np.uint64)], [], [], 0

    def together() -> None:
        data = b" ".join(group)
        out.append(word_hashes(data))
        space = _IS_SPACE[np.frombuffer(data, np.uint8)]
        first = np.flatnonzero(~space & np.concatenate([[True], space[:-1]])) if len(data) else np.zeros(0, np.int64)
        ends = np.cumsum([len(g) + 1 for g in group])
        sizes.append(np.diff(np.searchsorted(first, ends), prepend=0))
        group.clear()

    for text in texts:
        group.append((text or "").encode().lower())  # bytes: only A-Z change
        held += len(group[-1])
        if held > PIECE // 2:
            together()
            held = 0
    if group:
        together()
    h = np.concatenate(out)
    h[h <= RARE] ^= ~_64(0)  # a hash is no short id
    return h, np.concatenate(sizes).astype(np.int64) if sizes else np.zeros(0, np.int64)


def firsts(x: np.ndarray) -> np.ndarray:
    """Where x, in which equal values stand together, comes to another value."""
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)


def distinct(x: np.ndarray) -> np.ndarray:
    """Its values, ascending. np.unique alone goes by a hash table, which takes some twenty times as long."""
    x = np.sort(x)
    return x[firsts(x)]


def numbered(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes among short ids and hashes, ascending, and x with each as RARE + 1 and its place there."""
    far, out = np.flatnonzero(x > RARE), x.copy()
    names = distinct(x[far])
    out[far] = np.searchsorted(names, x[far]) + RARE + 1
    return names, out


def by_name(names: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The hashes again."""
    far, out = np.flatnonzero(x > RARE), x.copy()
    out[far] = names[x[far].astype(np.int64) - RARE - 1]
    return out


def bits_of(names: int) -> int:
    """Bits for the short ids and so many names."""
    return (RARE + names).bit_length()


def joint(bits: int, *ids: np.ndarray) -> np.ndarray:
    out = ids[0].astype(np.uint64)
    for x in ids[1:]:
        out = out << _64(bits) | x.astype(np.uint64)
    return out


def apart(keys: np.ndarray, bits: int, fields: int) -> list[np.ndarray]:
    return [keys >> _64(bits * k) & _64((1 << bits) - 1) for k in range(fields - 1, -1, -1)]


def pack_wide(names: np.ndarray, *ids: np.ndarray) -> bytes:
    """Sorted keys of several ids, numbered by names, with those names that they use."""
    used, own = numbered(np.concatenate(ids))
    head = pack_sorted(names[used.astype(np.int64) - RARE - 1])
    return len(head).to_bytes(4, "little") + head + pack_sorted(joint(bits_of(len(used)), *own.reshape(len(ids), -1)))


def names_in(data: bytes) -> np.ndarray:
    return unpack_sorted(data[4 : 4 + int.from_bytes(data[:4], "little")])


def unpack_wide(data: bytes, fields: int) -> tuple[np.ndarray, list[np.ndarray]]:
    names = names_in(data)
    return names, apart(unpack_sorted(data[4 + int.from_bytes(data[:4], "little") :]), bits_of(len(names)), fields)


def renumbered(given: np.ndarray, x: np.ndarray, names: np.ndarray) -> np.ndarray:
    """Ids by the given names as ids by other names; RARE for what those lack."""
    at = np.minimum(np.searchsorted(names, given), max(len(names) - 1, 0))
    new = np.where(names[at] == given, at + RARE + 1, RARE) if len(names) else np.full(len(given), RARE)
    far, out = np.flatnonzero(x > RARE), x.copy()
    out[far] = new[x[far].astype(np.int64) - RARE - 1]
    return out


def all_names(rows: list[tuple]) -> np.ndarray:
    return distinct(np.concatenate([np.zeros(0, np.uint64), *(names_in(a) for _, a, *_ in rows)]))


def wide_ids(rows: list[tuple], fields: int, names: np.ndarray) -> list[np.ndarray]:
    """The keys of all rows end to end, by these names."""
    found = [[renumbered(given, x, names) for x in ids] for given, ids in (unpack_wide(a, fields) for _, a, *_ in rows)]
    return [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.zeros(0, np.uint64)] * fields


def numbers(data: list[bytes]) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.int64), *(unpack(x).astype(np.int64) for x in data)])


def merged(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, with their counts added up."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = firsts(keys)
    return keys[first], np.add.reduceat(counts, first)


def ascending(x: np.ndarray, bits: int) -> np.ndarray:
    """The order of numbers below 1 << bits. Numbers that carry their places are sorted in a fraction of the time in which places are."""
    place = len(x).bit_length()
    if bits + place > 64:
        return np.argsort(x)
    return (np.sort(x << _64(place) | np.arange(len(x), dtype=np.uint64)) & _64((1 << place) - 1)).astype(np.int64)


def by_shard(shard: np.ndarray) -> tuple[np.ndarray, list[tuple[int, slice]]]:
    """The order by shard, as they come within one, and each shard's part of it."""
    small = len(shard) and int(shard.max()) < 1 << 16  # sorted by digits
    order = np.argsort(shard.astype(np.uint16) if small else shard, kind="stable")
    s = shard[order]
    cuts = firsts(s)
    return order, [(int(s[a]), slice(a, b)) for a, b in zip(cuts, np.append(cuts[1:], len(s)), strict=bool(len(s)))]


def row_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({f.name: [r[i] for r in rows] for i, f in enumerate(_ROW)}, schema=_ROW)


def map_blocks(docs: DataFrame, send) -> DataFrame:
    """Rows that send(flush, hashes, sizes, learned, held, ids) makes of each block of about FLUSH words of a task's texts. docs: (doc_id, learned, held, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        release_memos()
        parts: list[tuple] = []
        words, flush = 0, TaskContext.get().partitionId() << 32

        def block() -> Iterator[pa.RecordBatch]:
            columns = [np.concatenate(c) for c in list(zip(*parts, strict=True))[:4]]
            for rows in send(flush, *columns, [i for p in parts for i in p[4]]):
                yield row_batch([rows])

        for batch in batches:
            for part in slices(batch):
                h, sizes = hashed(part.column(3).to_pylist())
                parts.append((h, sizes, *(part.column(i).to_numpy(zero_copy_only=False).astype(bool) for i in (1, 2)), part.column(0).to_pylist()))
                words += len(h) + len(sizes)
                if words >= FLUSH:
                    yield from block()
                    words, flush = 0, flush + 1
                    parts.clear()
        if parts:
            yield from block()

    return docs.mapInArrow(run, ROW)


def gathered(batches: Iterator[pa.RecordBatch]) -> dict[int, list[tuple]]:
    """The rows of one shard by kind. A shard is a partition."""
    held: dict[int, list[tuple]] = {k: [] for k in range(10)}
    for batch in batches:
        for shard, kind, flush, a, b, c in zip(*(col.to_pylist() for col in batch.columns), strict=True):
            held[kind].append((flush, a, b, c, shard))
    return held


def counted(blocks: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    keys = [unpack_sorted(a) for _, a, *_ in blocks]
    counts = [unpack(b).astype(np.int64) for _, _, b, *_ in blocks]
    return merged(np.concatenate(keys), np.concatenate(counts)) if keys else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def to_shards(rows: DataFrame, shards: int) -> DataFrame:
    return rows.repartitionById(shards, F.col("shard"))


def word_counts(docs: DataFrame, shards: int) -> DataFrame:
    """A row of COUNTS a shard: sorted hashes and counts of the training words; flush: their sum; c: [words told apart, training texts of the shard's blocks]."""

    def send(flush, h, sizes, learned, held, ids):
        keys, counts = np.unique(h[np.repeat(learned, sizes)], return_counts=True)
        order, parts = by_shard((keys % _64(shards)).astype(np.int64))
        for s, at in parts:
            yield s, COUNTS, 0, pack_sorted(keys[order[at]]), pack(counts[order[at]]), None
        yield int(flush & 0xFFFF) % shards, DOCS, int(learned.sum()), None, None, None

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = gathered(batches)
        if held[COUNTS] or held[DOCS]:
            keys, counts = counted(held[COUNTS])
            shard = (held[COUNTS] or held[DOCS])[0][4]
            yield row_batch([(shard, COUNTS, int(counts.sum()), pack_sorted(keys), pack(counts), json.dumps([len(keys), sum(x[0] for x in held[DOCS])]).encode())])

    return to_shards(map_blocks(docs, send), shards).mapInArrow(add, ROW)


def most_frequent(counts: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and counts of the n most frequent words, ties by hash: what reaches the driver has this size."""

    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                keys, k = unpack_sorted(a), unpack(b).astype(np.int64)
                best = np.lexsort((keys.view(np.int64), -k))[:n]
                yield pa.RecordBatch.from_arrays([pa.array(keys[best].view(np.int64)), pa.array(k[best])], names=["h", "n"])

    found = counts.select("a", "b").mapInArrow(top, "h long, n long").orderBy(F.desc("n"), "h").limit(n).toArrow()
    return found.column("h").to_numpy().astype(np.int64).view(np.uint64), found.column("n").to_numpy().astype(np.int64)


class Words:
    """The model's words: ids, counts and unigram probabilities, and over how many shards each middle word is dealt.

    apart: words without a short id are told apart, too; otherwise they are one class.
    """

    def __init__(self, top: np.ndarray, counts: np.ndarray, total: int, distinct: int, texts: int, shards: int, apart: bool = False) -> None:
        order = np.argsort(top)
        self.sorted, self.ids, self.n = top[order], order.astype(np.int64), counts
        self.total, self.known = total + texts, distinct + (texts > 0)
        self.rare, self.rare_kinds, self.texts, self.shards = total - int(counts.sum()), distinct - len(top), texts, shards
        self.apart = apart
        p = np.zeros(1 << ID_BITS)
        p[: len(counts)], p[END], p[RARE] = counts, texts, self.rare + 1
        with np.errstate(divide="ignore"):
            self.p = p / (self.total + 1) if self.total else np.ones(1 << ID_BITS)
            if apart and self.total:  # nothing goes by RARE; a hash's unigram is asked elsewhere
                self.p = np.where(p > 0, self.unigram(p), 0)
                self.p[RARE] = 1
            self.code = code(self.p)
        seen = np.zeros(1 << ID_BITS, np.int64)
        # the counts of words by hash are below the last short id's, so one shard holds each up to 2^16 shards
        seen[: len(counts)], seen[START], seen[RARE] = counts, texts, 0 if apart else self.rare
        self.dealt = np.maximum(1, -(-seen * shards // max(self.total, 1)))

    def of(self, h: np.ndarray) -> np.ndarray:
        """Short ids; RARE for all other words."""
        found, ids, first, crowded = self.slots
        slot = (h >> _64(64 - SLOT_BITS)).astype(np.int64)
        at = first[slot]
        out = np.where(found[at] == h, ids[at], RARE)
        more = np.flatnonzero(crowded[slot])
        if len(more):
            at = np.minimum(np.searchsorted(self.sorted, h[more]), len(self.sorted) - 1)
            out[more] = np.where(self.sorted[at] == h[more], self.ids[at], RARE)
        return out

    @cached_property
    def slots(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Words and ids, none at the end; the place there of the first word that begins with each SLOT_BITS bits, and whether others do. Each task makes it anew."""
        slot = (self.sorted >> _64(64 - SLOT_BITS)).astype(np.int64)
        at = firsts(slot)
        first, crowded = np.full(1 << SLOT_BITS, len(slot), np.int32), np.zeros(1 << SLOT_BITS, bool)
        first[slot[at]] = at
        crowded[slot[at]] = np.diff(at, append=len(slot)) > 1
        return np.append(self.sorted, _64(0)), np.append(self.ids, RARE), first, crowded

    def shard(self, v: np.ndarray, part: np.ndarray) -> np.ndarray:
        return (mix(v.astype(np.uint64) << _64(32) | part.astype(np.uint64)) % _64(self.shards)).astype(np.int64)

    def part(self, v: np.ndarray, other: np.ndarray) -> np.ndarray:
        return (mix(other.astype(np.uint64) + _64(1)) % self.dealt_over(v).astype(np.uint64)).astype(np.int64)

    def dealt_over(self, v: np.ndarray) -> np.ndarray:
        return self.dealt[np.minimum(v, RARE).astype(np.int64)]

    def unigram(self, c: np.ndarray) -> np.ndarray:
        """The probability of a word or end by its count; of the unseen word for c = 0."""
        return np.where(c > 0, c - DISCOUNT, DISCOUNT * self.known + 1) / (self.total + 1)

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.1) / (self.total + 0.1 * (self.known + 1)))

    def within_rare(self, c: np.ndarray) -> np.ndarray:
        """log10 of a rare word's share of all rare ones; of the unseen word's for c = 0."""
        return np.log10(np.where(c > 0, c - DISCOUNT, DISCOUNT * self.rare_kinds + 1) / (self.rare + 1))


def code(p: np.ndarray) -> np.ndarray:
    """log10 in STEPs below 0; 16 decades fit."""
    with np.errstate(divide="ignore"):
        return np.minimum(np.rint(-np.log10(p) * STEP), 65535).astype(np.uint16)


def sequences(words: Words, h: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts end to end, hashes where there is no short one, START twice before and END after each, and the places of what is predicted."""
    first = np.cumsum(sizes + 3) - sizes - 3
    out = np.full(int((sizes + 3).sum()), START, np.uint64)
    body = np.arange(len(h)) + np.repeat(first + 2 - np.cumsum(sizes) + sizes, sizes)
    ids = words.of(h)
    out[body] = np.where(ids == RARE, h, ids.astype(np.uint64)) if words.apart else ids
    out[first + sizes + 2] = END
    told = np.ones(len(out), bool)
    told[first] = told[first + 1] = False
    return out, np.flatnonzero(told)


def followers(docs: DataFrame, words: Words, counts: DataFrame) -> DataFrame:
    """Rows of FOLLOWERS to each shard that a word is dealt over: sorted (v, w) and how often w follows v in the training texts.

    FOLLOWERS_WIDE: those with words by hash; they also bring how often w comes at all, if it has no short id.
    """

    def send(flush, h, sizes, learned, held, ids):
        x, at = sequences(words, h[np.repeat(learned, sizes)], sizes[learned])
        names, i = numbered(x)
        keys, n = np.unique(joint(32, i[at - 1], i[at]), return_counts=True)
        v, w = apart(keys, 32, 2)
        gv, gw = by_name(names, v), by_name(names, w)
        # the word's own shard, where it is counted
        shard = np.where(w > RARE, (gw % _64(words.shards)).astype(np.int64), words.shard(gv, words.part(gv, gw)))
        wide = (v > RARE) | (w > RARE)
        for kind, rows in ((FOLLOWERS, np.flatnonzero(~wide)), (FOLLOWERS_WIDE, np.flatnonzero(wide))):
            order, parts = by_shard(shard[rows])
            for s, p in parts:
                o = rows[order[p]]
                yield s, kind, 0, pack_sorted(joint(ID_BITS, v[o], w[o])) if kind == FOLLOWERS else pack_wide(names, v[o], w[o]), pack(n[o]), None

    def targets(v: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(shard, rows) for each shard of each word; word by word, as a word dealt over many shards has its list sent to each."""
        alone = words.dealt_over(v) == 1
        groups = [(np.flatnonzero(alone), words.shard(v[alone], np.zeros(alone.sum())))]
        for word in np.unique(v[~alone]).tolist():
            mine = np.flatnonzero(v == word)
            many = int(words.dealt[word])
            groups += [(mine, np.full(len(mine), s)) for s in np.unique(words.shard(np.full(many, word), np.arange(many))).tolist()]
        for rows, target in groups:
            order, parts = by_shard(target)
            for s, p in parts:
                yield s, rows[order[p]]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = gathered(batches)
        keys, n = counted(held[FOLLOWERS])
        for s, o in targets(keys >> _64(ID_BITS)):
            yield row_batch([(s, FOLLOWERS, 0, pack_sorted(keys[o]), pack(n[o]), None)])
        if not held[FOLLOWERS_WIDE]:
            return
        names = all_names(held[FOLLOWERS_WIDE])
        keys, n = merged(joint(32, *wide_ids(held[FOLLOWERS_WIDE], 2, names)), numbers([b for _, _, b, *_ in held[FOLLOWERS_WIDE]]))
        v, w = apart(keys, 32, 2)
        times, far = np.zeros(len(w), np.int64), np.flatnonzero(w > RARE)  # 0 for short ids
        times[far] = looked_up(held)(names)[w[far].astype(np.int64) - RARE - 1]
        for s, o in targets(by_name(names, v)):
            yield row_batch([(s, FOLLOWERS_WIDE, 0, pack_wide(names, v[o], w[o]), pack(n[o]), pack(times[o]))])

    rows = map_blocks(docs, send)
    return to_shards(rows.unionByName(counts) if words.apart else rows, words.shards).mapInArrow(add, ROW)


def asked(docs: DataFrame, words: Words) -> DataFrame:
    """Every text's trigrams with its place in the block (TRAIN or ASKED; WIDE: with words by hash), its words without a short id (RARE_ASKED), and what is known of the block's texts (DOCS)."""

    def send(flush, h, sizes, learned, held, ids):
        x, at = sequences(words, h, sizes)
        doc = np.repeat(np.arange(len(sizes)), sizes + 1)
        group = words.shard(x[at - 1], words.part(x[at - 1], x[at - 2])) << 2
        names, i = numbered(x)
        u, v, w = i[at - 2], i[at - 1], i[at]
        bits = bits_of(len(names))
        group |= (np.maximum(np.maximum(u, v), w) > RARE).astype(np.int64) << 1 | learned[doc]
        key = joint(bits, v, u, w) if 3 * bits <= 64 else None
        order, parts = by_shard(group)
        del x, i, group
        for g, p in parts:
            s, kind = g >> 2, ((ASKED, TRAIN), (ASKED_WIDE, TRAIN_WIDE))[g >> 1 & 1][g & 1]
            o = order[p]
            o = o[np.argsort(key[o]) if key is not None else np.lexsort((w[o], u[o], v[o]))]
            other = key[o[1:]] != key[o[:-1]] if key is not None else np.any([k[o[1:]] != k[o[:-1]] for k in (v, u, w)], axis=0)
            run = np.cumsum(np.concatenate([[False], other]))
            # a text that repeats a trigram asks it once, with its count
            by_text = np.sort(run << 32 | doc[o])
            new = firsts(by_text)
            texts, times = by_text[new] & 0xFFFFFFFF, np.diff(new, append=len(o))
            k = [y[o[new]] for y in (v, u, w)]
            for start in range(0, len(new), WIDE_ROW):
                c = slice(start, start + WIDE_ROW)
                part = [y[c] for y in k]
                yield s, kind, flush, pack_wide(names, *part) if kind in (TRAIN_WIDE, ASKED_WIDE) else pack_sorted(joint(ID_BITS, *part)), pack(texts[c]), pack(times[c])
        del u, v, key, order
        word = w != END
        rare = np.flatnonzero(w[word] >= RARE)
        rare = rare[np.argsort(h[rare])]
        hr, dr = h[rare], doc[word][rare]
        order, parts = by_shard((hr % _64(words.shards)).astype(np.int64))
        for s, p in parts:
            yield s, RARE_ASKED, flush, pack_sorted(hr[order[p]]), pack(dr[order[p]]), None
        n = np.append(words.n, words.texts)
        own = np.flatnonzero(w < RARE)
        mine = w[own].astype(np.int64)
        mine[mine == END] = len(n) - 1
        base = np.bincount(doc[own], words.base(n)[mine], len(sizes))
        seen = np.bincount(doc[own], (n > 0)[mine], len(sizes)).astype(np.int64)
        about = json.dumps([ids, held.astype(int).tolist()]).encode()
        yield int(flush >> 32) % words.shards, DOCS, flush, zstandard.compress(about, 1), pack(np.concatenate([sizes + 1, seen])), pack_floats(base)

    return map_blocks(docs, send)


def trigram_keys(trigrams: list[np.ndarray], bits: int) -> tuple[np.ndarray, np.ndarray | None]:
    """Each (v, u, w) as one number, in their order; if they are too wide for that, (v, u) goes by its place in a list, which comes along."""
    v, u, w = trigrams
    if 3 * bits <= 64:
        return joint(bits, v, u, w), None
    pair = joint(bits, v, u)
    pairs = distinct(pair)
    return joint(bits, np.searchsorted(pairs, pair), w), pairs


def parents(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """What ascending keys hold above their last id, each once, and the place there of every key's."""
    node = keys >> _64(bits)
    first = firsts(node)
    return node[first], np.repeat(np.arange(len(first)), np.diff(first, append=len(node)))


class Trie:
    """The levels of one shard."""

    LISTS = ("after", "after_at", "before", "third", "third_at")

    def __init__(self, levels: dict[str, np.ndarray], unigrams: np.ndarray) -> None:
        self.q1 = unigrams.astype(np.int64)
        self.lists = {n: EliasFano(*(levels[f"{n}.{p}"] for p in ("size", "low", "high", "ones"))) for n in self.LISTS}
        self.heads, self.names, self.q2, self.g2, self.q3, self.g3 = (levels[n] for n in ("heads", "names", "q2", "g2", "q3", "g3"))
        self.bits = bits_of(len(self.names))
        self.of = np.full(RARE + 1 + len(self.names), -1, np.int64)
        self.of[self.heads] = np.arange(len(self.heads))

    @staticmethod
    def levels(trigrams: np.ndarray, counts: np.ndarray, bigrams: np.ndarray, n2: np.ndarray, p1: np.ndarray) -> dict[str, np.ndarray]:
        """Levels of sorted distinct (v, u, w) and (v, w) of short ids with their counts. p1: unigram probabilities by id."""
        return Trie.laid(*Trie.nodes(apart(trigrams, ID_BITS, 3), counts, ID_BITS), bigrams, n2, p1[(bigrams & _64(RARE)).astype(np.int64)], np.zeros(0, np.uint64))

    @staticmethod
    def nodes(trigrams: list[np.ndarray], counts: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of (v, u, w) in any order: the distinct (v, u), the place there and the w of each distinct trigram, and its count."""
        keys, pairs = trigram_keys(trigrams, bits)
        return Trie.split(*merged(keys, counts), pairs, bits)

    @staticmethod
    def split(keys: np.ndarray, counts: np.ndarray, pairs: np.ndarray | None, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """nodes() of ascending distinct trigram_keys()."""
        node, mine = parents(keys, bits)
        return node if pairs is None else pairs[node.astype(np.int64)], mine, keys & _64((1 << bits) - 1), counts

    @staticmethod
    def laid(node: np.ndarray, mine: np.ndarray, third: np.ndarray, counts: np.ndarray, bigrams: np.ndarray, n2: np.ndarray, p1: np.ndarray, names: np.ndarray) -> dict[str, np.ndarray]:
        """Levels of nodes() and of sorted distinct (v, w) with their counts and w's unigram probability, all numbered by names."""
        bits = bits_of(len(names))
        b, low = _64(bits), _64((1 << bits) - 1)
        v2 = (bigrams >> b).astype(np.int64)
        heads, start, size = np.unique(v2, return_index=True, return_counts=True)
        k = np.repeat(np.arange(len(heads)), size)
        total = np.add.reduceat(n2, start) if len(heads) else n2
        g2 = DISCOUNT * size / np.maximum(total, 1)
        p2 = np.maximum(n2 - DISCOUNT, 0) / total[k] + g2[k] * p1 if len(heads) else np.zeros(0)
        after = k.astype(np.uint64) << b | bigrams & low
        place = np.full(RARE + 1 + len(names), -1, np.int64)
        place[heads] = np.arange(len(heads))

        kn = place[(node >> b).astype(np.int64)]
        first = np.searchsorted(mine, np.arange(len(node)))
        kinds = np.diff(first, append=len(mine))
        total3 = np.add.reduceat(counts, first) if len(node) else counts
        g3 = DISCOUNT * kinds / np.maximum(total3, 1)
        i2 = np.searchsorted(after, kn[mine].astype(np.uint64) << b | third)
        p3 = np.maximum(counts - DISCOUNT, 0) / total3[mine] + g3[mine] * p2[i2] if len(node) else np.zeros(0)
        at = np.concatenate([[0], np.cumsum(size[kn])]).astype(np.int64)
        m = len(heads) << bits
        lists = {
            "after": EliasFano.of(after, m), "after_at": EliasFano.of(start, len(after)),
            "before": EliasFano.of(kn.astype(np.uint64) << b | node & low, m),
            "third": EliasFano.of(at[mine] + i2 - start[kn[mine]], int(at[-1])), "third_at": EliasFano.of(at[:-1], int(at[-1])),
        }
        out = {f"{n}.{p}": x for n, ef in lists.items() for p, x in ef.parts().items()}
        return out | {"heads": heads, "names": names, "q2": code(p2), "g2": code(g2), "q3": code(p3), "g3": code(g3)}

    def codes(self, keys: np.ndarray) -> np.ndarray:
        """-log10 in STEPs of each (v, u, w) of short ids."""
        kinds, place = np.unique(keys, return_inverse=True)
        return self.found(*trigram_keys(apart(kinds, ID_BITS, 3), self.bits))[0][place]

    def found(self, keys: np.ndarray, pairs: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """-log10 in STEPs of ascending distinct trigram_keys(), and whether w follows v at all; if not, the unigram of a w without a short id is left out.

        Each (v, u) and each (v, w) is searched once, in ascending order.
        """
        b, low = _64(self.bits), _64((1 << self.bits) - 1)
        node, mine = parents(keys, self.bits)
        node = node if pairs is None else pairs[node.astype(np.int64)]
        w = keys & low
        out, after = self.q1[np.minimum(w, RARE).astype(np.int64)], np.zeros(len(w), bool)
        head = self.of[(node >> b).astype(np.int64)]
        k = head[mine]
        rows = np.flatnonzero(k >= 0)
        k = k[rows].astype(np.uint64)
        pair = k << b | w[rows]
        order = ascending(pair, self.bits + len(self.heads).bit_length())
        pair = pair[order]
        first = firsts(pair)
        i, there = self.lists["after"].find(pair[first])
        times = np.diff(first, append=len(pair))
        i2, seen2 = np.empty(len(rows), np.int64), np.empty(len(rows), bool)
        i2[order], seen2[order] = np.repeat(i, times), np.repeat(there, times)
        del pair, order
        out[rows] += self.g2[k]
        out[rows[seen2]] = self.q2[i2[seen2]]
        after[rows[seen2]] = True
        # each (v, u): its place among the predecessors, back-off and first place of its list less that of v's list
        known = np.flatnonzero(head >= 0)
        i, there = self.lists["before"].find(head[known].astype(np.uint64) << b | node[known] & low)
        known, i = known[there], i[there]
        back, begin, here = np.zeros(len(node), np.int64), np.zeros(len(node), np.int64), np.zeros(len(node), bool)
        here[known], back[known] = True, self.g3[i]
        begin[known] = self.lists["third_at"][i].astype(np.int64) - self.lists["after_at"][head[known]].astype(np.int64)
        out += back[mine]
        # the word's place among the followers of v is its name below (v, u)
        both = np.flatnonzero(seen2 & here[mine[rows]])
        i3, seen3 = self.lists["third"].find(begin[mine[rows[both]]] + i2[both])
        out[rows[both[seen3]]] = self.q3[i3[seen3]]
        return out, after


def lay_out(levels: dict[str, np.ndarray]) -> tuple[bytes, list[bytes]]:
    """A head that names each level's type and place, and the levels, each at a multiple of 8 bytes."""
    head, parts, at = {}, [], 0
    for name, x in levels.items():
        data = x.tobytes()
        head[name] = (x.dtype.str, len(x), at)
        parts.append(data + bytes(-len(data) % 8))
        at += len(parts[-1])
    return json.dumps(head).encode(), parts


def mapped(levels: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The levels as views of a file mapped into memory; it has no name and goes with its last view."""
    head, parts = lay_out(levels)
    with tempfile.TemporaryFile() as f:
        f.writelines(parts)
        f.write(bytes(8))
        f.flush()
        whole = np.memmap(f, np.uint8, "r")
    return {n: np.frombuffer(whole, kind, size, at) for n, (kind, size, at) in json.loads(head).items()}


ANSWER = "flush long, kind int, doc binary, a binary, b binary, c binary"
_ANSWER = pa.schema([("flush", pa.int64()), ("kind", pa.int32()), ("doc", pa.binary()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())])


def shard_names(held: dict[int, list[tuple]]) -> np.ndarray:
    return all_names(held[FOLLOWERS_WIDE] + held[TRAIN_WIDE])


def trigrams_in(rows: list[tuple[int, tuple]], names: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
    """trigram_keys() of rows of (kind, row), end to end."""
    bits = bits_of(len(names))

    def ids(kind: int, data: bytes) -> list[np.ndarray]:
        if kind in (TRAIN, ASKED):
            return apart(unpack_sorted(data), ID_BITS, 3)
        given, found = unpack_wide(data, 3)
        return [renumbered(given, x, names) for x in found]

    if 3 * bits <= 64:
        return np.concatenate([np.zeros(0, np.uint64), *(joint(bits, *ids(k, a)) for k, (_, a, *_) in rows)]), None
    return trigram_keys([np.concatenate(x) for x in zip(*(ids(k, a) for k, (_, a, *_) in rows), strict=True)], bits)


def shard_levels(held: dict[int, list[tuple]], words: Words, names: np.ndarray, trigrams: np.ndarray, counts: np.ndarray, pairs: np.ndarray | None) -> dict[str, np.ndarray]:
    """Levels of distinct trigrams_in() of training texts with their counts, and of the bigrams held."""
    wide2 = held[FOLLOWERS_WIDE]
    bits = bits_of(len(names))
    keys, n2 = counted(held[FOLLOWERS])
    v, w = (np.concatenate(x) for x in zip(apart(keys, ID_BITS, 2), wide_ids(wide2, 2, names), strict=True))
    n2 = np.concatenate([n2, numbers([b for _, _, b, *_ in wide2])])
    p1 = np.concatenate([np.zeros(len(keys)), words.unigram(numbers([c for _, _, _, c, _ in wide2]))])
    p1 = np.where(w > RARE, p1, words.p[np.minimum(w, RARE).astype(np.int64)])
    bigrams = joint(bits, v, w)
    order = ascending(bigrams, 2 * bits)
    bigrams, n2, p1 = bigrams[order], n2[order], p1[order]
    del v, w, order
    return Trie.laid(*Trie.split(trigrams, counts, pairs, bits), bigrams, n2, p1, names)


def added_by(doc: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct texts and the sums of their whole numbers."""
    if len(doc) and int(doc.max()) < 4 * len(doc):
        docs = np.flatnonzero(np.bincount(doc))
        return docs, np.bincount(doc, x)[docs].astype(np.int64)
    docs, place = np.unique(doc, return_inverse=True)
    return docs, np.bincount(place, x).astype(np.int64)


def answer_row(*row) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({f.name: [x] for f, x in zip(_ANSWER, row, strict=True)}, schema=_ANSWER)


def looked_up(held: dict[int, list[tuple]]):
    """A function from hashes to how often the word comes in the training texts; of the words that this shard counts."""
    keys, counts = counted(held[COUNTS])

    def times(h: np.ndarray) -> np.ndarray:
        if not len(keys):
            return np.zeros(len(h), np.int64)
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        return np.where(keys[at] == h, counts[at], 0)

    return times


def answered(rows: DataFrame, words: Words) -> DataFrame:
    """Sums per text of each block that asked: codes of its trigrams (TRAIN); known words, base and share within the class of rare ones (RARE_ASKED). DOCS pass.

    BACKED_OFF: hashes whose unigram is still to be asked, a row for each shard that counts them (flush); a: hashes, b: blocks, c: texts and times.
    """

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = gathered(batches)
        for flush, a, b, c, _ in held[DOCS]:
            yield answer_row(flush, DOCS, None, a, b, c)
        times = looked_up(held)
        for flush, a, b, _, _ in held[RARE_ASKED]:
            h, doc = unpack_sorted(a), unpack(b).astype(np.int64)
            n = times(h)
            docs, place = np.unique(doc, return_inverse=True)
            share = np.zeros(len(docs)) if words.apart else np.bincount(place, words.within_rare(n))
            yield answer_row(flush, RARE_ASKED, pack_sorted(docs), pack(np.bincount(place, n > 0).astype(np.int64)), pack_floats(np.bincount(place, words.base(n))), pack_floats(share))
        held[COUNTS], held[RARE_ASKED] = [], []
        del times
        learned = [(k, x) for k in (TRAIN, TRAIN_WIDE) for x in held[k]]
        asking = learned + [(k, x) for k in (ASKED, ASKED_WIDE) for x in held[k]]
        if not asking:
            return
        # all blocks' trigrams at once: each distinct one is counted and looked up once
        names = shard_names(held)
        keys, pairs = trigrams_in(asking, names)
        order = np.argsort(keys)
        keys = keys[order]
        first = firsts(keys)
        place = np.empty(len(order), np.int64)
        place[order] = np.repeat(np.arange(len(first)), np.diff(first, append=len(order)))
        keys = keys[first]
        del order, first
        n = numbers([c for _, (_, _, _, c, _) in learned])
        counts = np.bincount(place[: len(n)], n, len(keys)).astype(np.int64)
        taught = np.flatnonzero(counts)
        trie, left = Trie(mapped(shard_levels(held, words, names, keys[taught], counts[taught], pairs)), words.code), []
        held.clear()
        del n, counts, taught
        codes, seen = trie.found(keys, pairs)
        del keys, pairs, trie
        start = 0
        for kind, (flush, a, b, c, _) in asking:
            doc, n = unpack(b).astype(np.int64), unpack(c).astype(np.int64)
            mine, start = place[start : start + len(doc)], start + len(doc)
            if kind == ASKED_WIDE:  # what training texts hold follows
                given, (_, _, w) = unpack_wide(a, 3)
                off = np.flatnonzero((w > RARE) & ~seen[mine])
                left.append((by_name(given, w[off]), np.full(len(off), flush), doc[off], n[off]))
            docs, sums = added_by(doc, codes[mine] * n)
            yield answer_row(flush, TRAIN, pack_sorted(docs), pack(sums), None, None)
        if left:
            h, flush, doc, n = (np.concatenate(x) for x in zip(*left, strict=True))
            order = np.argsort(h)
            h, flush, doc, n = h[order], flush[order], doc[order], n[order]
            order, parts = by_shard((h % _64(words.shards)).astype(np.int64))
            for s, p in parts:
                o = order[p]
                yield answer_row(s, BACKED_OFF, None, pack_sorted(h[o]), pack(flush[o]), pack(np.concatenate([doc[o], n[o]])))

    return to_shards(rows, words.shards).mapInArrow(answer, ANSWER)


def unigrams(answers: DataFrame, counts: DataFrame, words: Words) -> DataFrame:
    """The codes that BACKED_OFF asks for, as sums per text (TRAIN)."""

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = gathered(batches)
        times = looked_up(held)
        if not held[BACKED_OFF]:
            return
        h = np.concatenate([unpack_sorted(a) for _, a, *_ in held[BACKED_OFF]])
        flush = numbers([b for _, _, b, *_ in held[BACKED_OFF]])
        doc, n = (np.concatenate(x) for x in zip(*(unpack(c).astype(np.int64).reshape(2, -1) for _, _, _, c, _ in held[BACKED_OFF]), strict=True))
        sums = code(words.unigram(times(h))).astype(np.int64) * n
        order, parts = by_shard(flush)
        for block, p in parts:
            docs, total = added_by(doc[order[p]], sums[order[p]])
            yield answer_row(block, TRAIN, pack_sorted(docs), pack(total), None, None)

    asking = answers.filter(F.col("kind") == BACKED_OFF).select(F.col("flush").cast("int").alias("shard"), "kind", F.lit(0).cast("long").alias("flush"), "a", "b", "c")
    return to_shards(asking.unionByName(counts), words.shards).mapInArrow(answer, ANSWER)


SCORE = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
_SCORE = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def added_up(answers: DataFrame, words: Words) -> DataFrame:
    """One row a text, from all answers to its block."""

    def texts(block: pa.Table) -> pa.Table:
        rows = sorted(block.to_pylist(), key=lambda r: (r["kind"] != DOCS, r["kind"], r["doc"] or b"", r["a"]))
        ids, held = json.loads(zstandard.decompress(rows[0]["a"]))
        n, known = unpack(rows[0]["b"]).astype(np.int64).reshape(2, -1)
        base, codes, share = unpack_floats(rows[0]["c"]).copy(), np.zeros(len(n), np.int64), np.zeros(len(n))
        for r in rows[1:]:
            doc = unpack_sorted(r["doc"]).astype(np.int64)
            if r["kind"] == TRAIN:
                codes[doc] += unpack(r["a"]).astype(np.int64)
            else:
                known[doc] += unpack(r["a"]).astype(np.int64)
                base[doc] += unpack_floats(r["b"])
                share[doc] += unpack_floats(r["c"])
        return pa.Table.from_pydict({"doc_id": ids, "held_out": [bool(x) for x in held], "n_tokens": n, "n_known": known, "train_tokens": np.full(len(n), words.total), "base_score": base, "score": share - codes / STEP}, schema=_SCORE)

    return answers.groupBy("flush").applyInArrow(texts, SCORE)


def prepared(docs: DataFrame, learned: Column, held: Column) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(learned, F.lit(False)).alias("learned"), F.coalesce(held, F.lit(False)).alias("held"), F.col("text"))


def model(docs: DataFrame, tables: Tables, n_words: int | None = None, shard_bytes: int = SHARD_BYTES, short: int = WORDS) -> tuple[Words, DataFrame, DataFrame]:
    """The model's words, and its rows of COUNTS and FOLLOWERS. docs: as prepared.

    n_words: None, or how many words a class model tells apart (at most WORDS). short: how many words have short ids (at most WORDS); no result depends on it.
    """
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first().n
    shards = max(1, -(-size // shard_bytes))
    counts = tables.keep(word_counts(docs, shards))
    total = counts.select(F.col("flush").alias("n"), F.from_json(F.col("c").cast("string"), "array<long>").alias("c")).agg(*(F.coalesce(F.sum(x), F.lit(0)) for x in ("n", F.col("c")[0], F.col("c")[1]))).first()
    words = Words(*most_frequent(counts, min(short if n_words is None else n_words, WORDS)), *total, shards, n_words is None)
    return words, counts, tables.keep(followers(docs, words, counts))


def levels(docs: DataFrame, learned: Column, n_words: int | None = None, shard_bytes: int = SHARD_BYTES, short: int = WORDS) -> DataFrame:
    """(shard, head, levels): the trie itself, as a scoring task maps it into memory; head tells each level's type, length and place."""
    docs = prepared(docs, learned, F.lit(False))
    words, _, lists = model(docs, Tables(docs.sparkSession), n_words, shard_bytes, short)

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = gathered(batches)
        if some := [(k, x) for k in (TRAIN, TRAIN_WIDE) for x in held[k]]:
            names = shard_names(held)
            keys, pairs = trigrams_in(some, names)
            head, parts = lay_out(shard_levels(held, words, names, *merged(keys, numbers([c for _, (_, _, _, c, _) in some])), pairs))
            yield pa.RecordBatch.from_pydict({"shard": pa.array([some[0][1][4]], pa.int32()), "head": [head], "levels": [b"".join(parts)]})

    rows = asked(docs, words).filter(F.col("kind").isin(TRAIN, TRAIN_WIDE)).unionByName(lists)
    return to_shards(rows, words.shards).mapInArrow(lay, "shard int, head binary, levels binary")


def scored(docs: DataFrame, learned: Column, held: Column, n_words: int | None = None, shard_bytes: int = SHARD_BYTES, short: int = WORDS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every text, by the model of the learned ones."""
    tables = Tables(docs.sparkSession)
    docs = prepared(docs, learned, held)
    words, counts, lists = model(docs, tables, n_words, shard_bytes, short)
    rows = asked(docs, words).unionByName(lists).unionByName(counts)
    answers = tables.keep(answered(rows, words))
    tables.drop(lists)
    out = answers.filter(F.col("kind") != BACKED_OFF)
    if words.apart:
        out = out.unionByName(tables.keep(unigrams(answers, counts, words)))
    tables.drop(counts)
    return added_up(out, words)


def op13_elias_fano_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    id_ = F.col("doc_id")
    return scored(read(spark, sf_dir, "documents"), id_mod(id_, 10) != 0, held_out(id_, 10, 0))
