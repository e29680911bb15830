"""Token counts by a linear longest-match automaton.

The vocabulary is a trie of pieces. Each node also has a failure link, and the number of pieces that following the
link pops off; a word's greedy longest-match-first piece count is then the sum of popped counts along one left to
right walk, in time linear in the word, and no piece is ever built.

Defined cases: null or empty texts have no words and no tokens; a word that the vocabulary cannot cover counts as
one unknown token, and an end mark that no piece took with it adds none; repeated rows are counted each alone; other columns are ignored.
"""

from __future__ import annotations

import json

import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession

from .base import map_texts, read, worker_memo

#: what the published word-level pattern of the vocabulary takes as one word
WORD = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
END = 256
#: chunks of more bytes are counted where they stand, not remembered
HUGE = 1 << 18
#: where a remembered chunk's three counts stand in one integer
FIELDS = np.array([0, 20, 40])
SCHEMA = "doc_id long, n_words long, n_tokens long, n_unknown long"


def byte_symbols() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies write for bytes: printable Latin-1 stays, the rest moves to 256 and on."""
    keep = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    moved = [b for b in range(256) if b not in set(keep)]
    return {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(moved)}


def vocabulary(path: str) -> list[tuple[int, ...]]:
    """Pieces as byte values; the mark of a word's end is the value END."""
    model = json.loads(open(path, encoding="utf-8").read())["model"]
    mark, symbols = model["end_of_word_suffix"], byte_symbols()
    out = []
    for piece in model["vocab"]:
        body, end = (piece[: -len(mark)], (END,)) if mark and piece.endswith(mark) and piece != mark else (piece, ())
        if body and all(c in symbols for c in body):
            out.append(tuple(symbols[c] for c in body) + end)
    return out


class Automaton:
    """Trie with failure links; arrays only, so that it can be sent to executors and walked for many words at once."""

    BITS = 9

    def __init__(self, pieces: list[tuple[int, ...]]) -> None:
        child: list[dict[int, int]] = [{}]
        ends = [False]
        for piece in [*pieces, (END,)]:
            node = 0
            for c in piece:
                if c not in child[node]:
                    child[node][c] = len(child)
                    child.append({})
                    ends.append(False)
                node = child[node][c]
            ends[node] = piece != (END,)
        n = len(child)
        self.fail = np.full(n, -1, np.int32)  # -1: none, the word can't be cut here
        self.pops = np.zeros(n, np.int32)
        queue = [0]
        for u in queue:  # breadth first: shallower nodes are done
            for c, v in child[u].items():
                queue.append(v)
                if ends[v]:  # the node is a piece: pop it and start over
                    self.fail[v], self.pops[v] = 0, 1
                    continue
                if u == 0 and c == END:  # an end mark that no piece took adds no token
                    self.fail[v] = 0
                    continue
                f, k = int(self.fail[u]), int(self.pops[u])
                while f >= 0 and c not in child[f]:
                    k += int(self.pops[f])
                    f = int(self.fail[f])
                if f >= 0:
                    self.fail[v], self.pops[v] = child[f][c], k
        keys = np.array([u << self.BITS | c for u in range(n) for c in child[u]], np.int64)
        to = np.array([v for u in range(n) for v in child[u].values()], np.int32)
        self._hash(keys, to)

    def _hash(self, keys: np.ndarray, to: np.ndarray) -> None:
        """Open addressing, four slots a key on average, so that a step is one or two gathers."""
        bits = max(4, int(np.ceil(np.log2(4 * max(1, len(keys))))))
        self.shift = np.uint64(64 - bits)
        self.keys, self.to = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)
        at, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = self.keys[at[left]] < 0
            self.keys[at[left][free]] = keys[left][free]  # of several in one slot the last stays
            placed = self.keys[at[left]] == keys[left]
            self.to[at[left][placed]] = to[left][placed]
            left = left[~placed]
            at[left] = (at[left] + 1) % len(self.keys)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def step(self, node: np.ndarray, c: np.ndarray) -> np.ndarray:
        """The child by c, or -1."""
        want = node.astype(np.int64) << self.BITS | c
        at, out = self._slot(want), np.full(len(want), -1, np.int32)
        left = np.arange(len(want))
        while len(left):
            key = self.keys[at[left]]
            hit = key == want[left]
            out[left[hit]] = self.to[at[left[hit]]]
            left = left[~hit & (key >= 0)]
            at[left] = (at[left] + 1) % len(self.keys)
        return out

    def lengths(self, words: list[bytes]) -> np.ndarray:
        """Number of pieces of each word followed by END; -1 if it can't be cut."""
        size = np.array([len(w) + 1 for w in words], np.int64)
        start = np.cumsum(size) - size
        flat = np.full(int(size.sum()), END, np.int64)
        body = np.ones(len(flat), bool)
        body[start + size - 1] = False
        flat[body] = np.frombuffer(b"".join(words), np.uint8)
        order = np.argsort(-size, kind="stable")  # the words still running are a prefix
        total, node = np.zeros(len(words), np.int32), np.zeros(len(words), np.int32)
        longest_first = size[order]
        for i in range(int(size.max(initial=0))):
            live = order[: np.searchsorted(-longest_first, -i, side="left")]
            self._advance(live[node[live] >= 0], flat, start + i, node, total)
        live = np.flatnonzero(node > 0)  # what is left of a word must fall back to the root
        while len(live):
            total[live] += self.pops[node[live]]
            node[live] = self.fail[node[live]]
            live = live[node[live] > 0]
        return np.where(node < 0, -1, total)

    def _advance(self, live: np.ndarray, flat: np.ndarray, at: np.ndarray, node: np.ndarray, total: np.ndarray) -> None:
        while len(live):
            to = self.step(node[live], flat[at[live]])
            node[live[to >= 0]] = to[to >= 0]
            live = live[to < 0]
            total[live] += self.pops[node[live]]
            node[live] = self.fail[node[live]]
            live = live[node[live] >= 0]


def token_counts(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """Words, word-piece tokens and unknown words of each whole text; words are lower-cased."""
    automaton = Automaton(vocabulary(vocabulary_path))

    def make():
        # the pattern never joins across white space, so chunks between blanks can be looked up whole
        find, memo = regex.compile(WORD + r"|\n").findall, worker_memo(f"wordpiece:{vocabulary_path}")

        def counted(chunks: list[bytes]) -> np.ndarray:
            """Words, tokens and unknown words of each chunk."""
            words = find(b"\n".join(chunks).decode().lower())
            breaks = np.array([w == "\n" for w in words], bool)
            owner = np.cumsum(breaks)[~breaks]
            sizes = automaton.lengths([w.encode() for w in words if w != "\n"])
            return np.stack([np.bincount(owner, x, len(chunks)) for x in (np.ones(len(owner)), np.abs(sizes), sizes < 0)]).astype(np.int64)

        def each(rows: dict) -> dict:
            docs = [(t or "").encode().split() for t in rows["text"]]
            huge = [[c for c in d if len(c) > HUGE] if len(t or "") > HUGE // 4 else [] for d, t in zip(docs, rows["text"], strict=True)]
            docs = [[c for c in d if len(c) <= HUGE] if h else d for d, h in zip(docs, huge, strict=True)]
            if new := memo.missing(set().union(*docs)):
                memo.update(zip(new, (counted(new) << FIELDS[:, None]).sum(axis=0).tolist(), strict=True))
            sums = np.zeros((3, len(docs)), np.int64)
            for i, (d, h) in enumerate(zip(docs, huge, strict=True)):
                found = np.array(list(map(memo.__getitem__, d)), np.int64)
                sums[:, i] = (found >> FIELDS[:, None] & (1 << 20) - 1).sum(axis=1)
                if h:
                    sums[:, i] += counted(h).sum(axis=1)
            return {"doc_id": rows["doc_id"], "n_words": sums[0], "n_tokens": sums[1], "n_unknown": sums[2]}

        return each

    return map_texts(docs, make, SCHEMA)


def op1_wordpiece_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
