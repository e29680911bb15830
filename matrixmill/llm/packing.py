"""Best-two-fit packing of tokenized documents into sequences of a fixed length.

Documents become token pieces on the executors, once. Packing only needs how many pieces of each length there are,
a table of at most `capacity` counts whatever the input's size. On it bins are filled greedily, longest piece
first; then a bin's smallest piece is replaced by the two unpacked pieces that fit its widened gap most tightly,
where they fill it better. A bin shape is repeated while its lengths last, so the plan has a few thousand lines
for any number of documents. Pieces find their place by rank within their length.

Defined cases: a null or empty text is the end token alone; the literal text of an added token becomes that token, as
the tokenizer has it by default; repeated rows are packed each; texts of any length are
cut into pieces of `capacity`; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from itertools import chain

import numpy as np
import pandas as pd
import tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .base import cut, map_texts, read, worker_memo

CAPACITY = 4096
END_ID = 1
#: rows that one task ranks, about
RANKED_TOGETHER = 200_000
#: No token of the vocabulary spans ASCII white space, nor the place between a letter or digit and one of these marks,
#: and its text is lower-cased first; so the chunks between such places can be looked up whole. Only the literal texts of
#: added tokens come first: they are found in the text as it stands, and part it.
_LETTER = np.isin(np.arange(256), list(b"abcdefghijklmnopqrstuvwxyz0123456789"))
_MARK = np.isin(np.arange(256), list(b".,;:!?"))
#: no UTF-8 text holds this byte
_BETWEEN = b"\xff"
SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


_TOKENIZERS: dict[str, tokenizers.Tokenizer] = {}


def worker_tokenizer(path: str, spec: str) -> tokenizers.Tokenizer:
    """One for all tasks of a Python worker."""
    if path not in _TOKENIZERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core a task; its threads would also keep memory
        _TOKENIZERS.clear()
        _TOKENIZERS[path] = tokenizers.Tokenizer.from_str(spec)
        _TOKENIZERS[path].encode_special_tokens = True  # a chunk that only looks like an added token after lower-casing is none
    return _TOKENIZERS[path]


def cut_words(texts: list[bytes]) -> list[list[bytes]]:
    """The chunks of each text, lower-cased: between white space, and between a letter or digit and a mark. All texts are cut in one go."""
    whole = _BETWEEN.join(texts).lower()
    b = np.frombuffer(whole, np.uint8)
    at = np.flatnonzero(_MARK[b[1:]] & _LETTER[b[:-1]]) + 1
    return [t.split() for t in np.insert(b, at, 32).tobytes().split(_BETWEEN)] if texts else []


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Pieces of at most `capacity` ids of each document; with_ids adds the ids (little-endian 32 bits) themselves."""
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = f.read()
    end = np.array([end_id], "<u4").tobytes()

    def make():
        tokenizer = worker_tokenizer(tokenizer_path, spec)
        added = {t.content.encode(): i for i, t in tokenizer.get_added_tokens_decoder().items()}
        part = re.compile(b"(" + b"|".join(map(re.escape, sorted(added, key=len, reverse=True))) + b")").split if added else lambda b: [b]
        memo = worker_memo(f"bpe:{tokenizer_path}", 400_000)
        # under keys that no chunk can have
        memo.update({b" " + t: np.array([i], "<u4").tobytes() for t, i in added.items()})

        def cut_texts(texts: list[bytes]) -> list[list[bytes]]:
            if not any(a in t for t in texts for a in added):
                return cut_words(texts)
            parts = [part(t) for t in texts]
            # what stands between added tokens is cut like a text of its own
            cut_parts = iter(cut_words([p for ps in parts for p in ps[::2]]))
            return [[c for k, p in enumerate(ps) for c in ([b" " + p] if k % 2 else next(cut_parts))] for ps in parts]

        def encoded(chunks: list[bytes]) -> list[bytes]:
            found = tokenizer.encode_batch_fast([c.decode() for c in chunks], add_special_tokens=False)
            return [array("I", e.ids).tobytes() for e in found]

        def each(rows: dict) -> dict:
            out: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids)}
            chunks = cut_texts([(t or "").encode() for t in rows["text"]])
            new = memo.missing(chain.from_iterable(chunks))
            for i in range(0, len(new), 5000):
                memo.update(zip(new[i : i + 5000], encoded(new[i : i + 5000]), strict=True))
            for doc_id, doc in zip(rows["doc_id"], chunks, strict=True):
                ids = b"".join([*map(memo.__getitem__, doc), end])
                for n, at in enumerate(range(0, len(ids), 4 * capacity)):
                    piece = ids[at : at + 4 * capacity]
                    for k, v in zip(out, (doc_id, n, at // 4, len(piece) // 4, zlib.crc32(piece), piece), strict=False):
                        out[k].append(v)
            return out

        return each

    return map_texts(docs, make, SCHEMA + ", ids binary" * with_ids)


def fill(counts: np.ndarray, capacity: int) -> list[tuple[int, int]]:
    """One bin, greedily: the longest piece that still fits, again and again; (length, how many)."""
    bin_, gap, length = [], capacity, capacity
    while gap:
        length = min(length, gap)
        left = np.flatnonzero(counts[1 : length + 1])
        if not len(left):
            break
        length = int(left[-1]) + 1
        n = min(int(counts[length]), gap // length)
        bin_.append((length, n))
        gap -= n * length
        length -= 1
    return bin_


def improve(bin_: list[tuple[int, int]], counts: np.ndarray, capacity: int) -> list[tuple[int, int]]:
    """Replace the smallest piece by the two unpacked ones that fit the widened gap most tightly, if they fit it better."""
    used = np.zeros_like(counts)
    for length, n in bin_:
        used[length] += n
    gap = capacity - int((used * np.arange(len(counts))).sum())
    small = min((length for length, _ in bin_), default=0)
    if not gap or not small:
        return bin_
    room, left = gap + small, counts - used
    a = np.flatnonzero(left[: room // 2 + 1])  # the shorter of the two
    if not len(a):
        return bin_
    have = np.flatnonzero(left[: room + 1])
    spot = np.searchsorted(have, room - a, side="right") - 1
    b = have[spot]
    # a length that is needed twice must be there twice; otherwise take the next shorter partner
    twice = (a == b) & (left[a] < 2)
    b = np.where(twice, have[np.maximum(spot - 1, 0)], b)
    good = (b >= a) & ~((a == b) & (left[a] < 2))
    if not good.any():
        return bin_
    best = int(np.argmax(np.where(good, a + b, 0)))
    if a[best] + b[best] <= small:
        return bin_
    used[small] -= 1
    used[a[best]] += 1
    used[b[best]] += 1
    return [(int(x), int(used[x])) for x in np.flatnonzero(used)[::-1]]


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> pd.DataFrame:
    """Lines (length, rank_from, rank_to, per_bin, first_bin, offset): where the pieces of a length go, by rank."""
    counts = counts.astype(np.int64).copy()
    done = np.zeros_like(counts)
    lines, first_bin = [], 0
    while counts.any():
        shape = improve(fill(counts, capacity), counts, capacity)
        times = min(int(counts[length]) // n for length, n in shape)
        offset = 0
        for length, n in shape:
            lines.append((length, done[length], done[length] + times * n, n, first_bin, offset))
            offset += length * n
            counts[length] -= times * n
            done[length] += times * n
        first_bin += times
    return pd.DataFrame(lines, columns=["length", "rank_from", "rank_to", "per_bin", "first_bin", "offset"])


def ranked(pieces: DataFrame) -> DataFrame:
    """A rank from 0 within each length. A frequent length is dealt over many tasks: ranks within (length, part), plus the sizes of the parts before."""
    parts = max(8, -(-pieces.count() // RANKED_TOGETHER))
    dealt = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(parts)))
    sizes = dealt.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("length", "part", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    within = F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "piece", "start", "ids_crc32")) - 1
    return dealt.withColumn("within", within).join(before, ["length", "part"]).select(*pieces.columns, (F.col("before") + F.col("within")).alias("rank"))


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces."""
    spark = pieces.sparkSession
    # at most `capacity` rows, whatever the input
    histogram = pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()
    counts = np.zeros(capacity + 1, np.int64)
    for r in histogram:
        counts[r.length] = r.n
    lines = plan(counts, capacity)
    schema = "length long, rank_from long, rank_to long, per_bin long, first_bin long, first_offset long"
    placed = spark.createDataFrame([tuple(map(int, x)) for x in lines.itertuples(index=False)], schema)
    nth = F.col("rank") - F.col("rank_from")
    # the plan's size is bounded by the number of lengths, not by the input
    found = ranked(pieces).join(F.broadcast(placed), "length").filter((nth >= 0) & (F.col("rank") < F.col("rank_to")))
    return found.select(
        *pieces.columns,
        (F.col("first_bin") + F.floor(nth / F.col("per_bin"))).cast("long").alias("sequence_id"),
        (F.col("first_offset") + nth % F.col("per_bin") * F.col("length")).cast("long").alias("offset"),
    )


def best_two_fit(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Tokenize once (kept as a table in the shared folder), then pack."""
    return pack(cut(token_pieces(docs, tokenizer_path, capacity, end_id, with_ids)), capacity)


def op7_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return best_two_fit(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
