"""N-best segmentation over the piece lattice, and decoding.

The lattice of a text has an edge for every vocabulary piece that stands in it. A forward Viterbi pass gives each node
the best score from the start; these are exact heuristics for a backward A-star search from the end, which therefore
completes segmentations in order of score and opens little else.

No edge crosses a place whose two neighbouring characters stand together in no piece, so a text falls apart there into
segments. Viterbi scores from both ends give each distinct one's best and the cost of its second choice. The n best
of the text use, besides every segment's best, only segments whose second choice is among the n - 1 cheapest: the
search runs in those, and then over the lattice of their choices.

Scores are integers, millionths of log-probability: the vocabulary ranks its pieces, and a piece of rank r counts
1 / (r + 2). A character that is no piece falls back to its bytes, each at the lowest score less FALLBACK.

Defined cases: a null or empty text has one segmentation, without pieces, of score 0; equal scores come in a fixed
order; repeated rows are segmented each; texts are read whole; U+2581 in a text decodes to a blank and then the round
trip is not exact; other columns are ignored.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import sentencepiece
from pyspark.sql import DataFrame, SparkSession

from .base import map_texts, read, worker_memo
from .wordpiece import Automaton

N = 4
SCALE, FALLBACK = 1_000_000, 10_000_000
BLANK = "▁"
#: no edge; no second choice; parts scored at once, and the longest of them
NEVER, FAR, TOGETHER, LONGEST = -(1 << 58), 1 << 60, 1024, 64
MARKS = ".,;:!?"
SCHEMA = "doc_id long, n_segmentations int, n_pieces array<int>, scores array<double>, ids_crc32 long, round_trip boolean"


def n_best(edges: list[list[tuple[int, int, object]]], n: int) -> list[tuple[int, list]]:
    """The n best paths of a lattice with nodes 0 to len(edges): edges[j - 1] holds (from, score, payload) of the edges into j."""
    ahead = [0]
    for into in edges:
        best = None
        for i, s, _ in into:
            v = ahead[i] + s
            if best is None or v > best:
                best = v
        ahead.append(best)
    heap: list[tuple[int, int, int, int, tuple | None]] = [(-ahead[-1], 0, len(edges), 0, None)]
    push, pop = heapq.heappush, heapq.heappop
    out, order = [], 0
    while heap:
        _, _, node, score, rest = pop(heap)
        if node:
            for i, s, payload in edges[node - 1]:
                order -= 1  # of equal scores the path opened last goes on
                s += score
                push(heap, (-s - ahead[i], order, i, s, (payload, rest)))
            continue
        path = []
        while rest:
            path.append(rest[0])
            rest = rest[1]
        out.append((score, path))
        if len(out) == n:
            break
    return out


class Trie(Automaton):
    """The pieces as a trie over code points, for walks from many places at once."""

    BITS = 21

    def __init__(self, pieces: list[str]) -> None:
        child: list[dict[int, int]] = [{}]
        ends = [-1]
        for k, piece in enumerate(pieces):
            node = 0
            for c in map(ord, piece):
                if c not in child[node]:
                    child[node][c] = len(child)
                    child.append({})
                    ends.append(-1)
                node = child[node][c]
            ends[node] = k
        self.ends = np.array(ends, np.int32)
        self._hash(np.array([u << self.BITS | c for u in range(len(child)) for c in child[u]], np.int64), np.array([v for u in range(len(child)) for v in child[u].values()], np.int32))


class Pieces:
    """Vocabulary of a model file: pieces, scores, and the places no piece crosses."""

    def __init__(self, model: bytes) -> None:
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = sp.get_piece_size()
        plain = [i for i in range(size) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.score = {sp.id_to_piece(i): (-int(np.log(2.0 - sp.get_score(i)) * SCALE), np.array([i], "<u4").tobytes()) for i in plain}
        self.byte_id = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(size) if sp.is_byte(i)}
        self.raw = {i: sp.id_to_piece(i).replace(BLANK, " ").encode() for i in plain} | {i: bytes([b]) for b, i in self.byte_id.items()}
        self.longest = max(map(len, self.score))
        self.lowest = min(s for s, _ in self.score.values()) - FALLBACK
        pairs = {p[i : i + 2] for p in self.score for i in range(len(p) - 1)}
        letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
        cuts = [f"(?<=[{''.join(c for c in letters if c + m not in pairs)}])(?={re.escape(m)})" for m in MARKS]
        if not any(p[1] == BLANK != p[0] for p in pairs):
            cuts.append(f"(?<=[^{BLANK}])(?={BLANK})")
        if not any("\n" in p for p in pairs):
            cuts.append("(?<=\n)|(?=\n)")
        self.parts: Callable[[str], list[str]] = re.compile("|".join(cuts)).split
        self.apart = len(cuts) == len(MARKS) + 2
        # every beginning of a piece, with the piece's score and ids or None: a look-up from one place ends early
        self.walk = {p[:i]: None for p in self.score for i in range(1, len(p))} | self.score

        self.trie = Trie(list(self.score))
        self.scores = np.array([x for x, _ in self.score.values()], np.int64)
        self.ids = np.frombuffer(b"".join(i for _, i in self.score.values()), "<u4")

    def best_and_second(self, parts: list[str]) -> list[tuple[int, int, int, bool, bytes]]:
        """(score, pieces, cost of the second choice, exactness, ids) of many short parts: Viterbi scores from both ends.

        The second best path is the best one over any edge that the best path leaves out.
        """
        out: list = [None] * len(parts)
        order = sorted((i for i, p in enumerate(parts) if 0 < len(p) <= LONGEST), key=lambda i: len(parts[i]))
        for a in range(0, len(order), TOGETHER):
            some = order[a : a + TOGETHER]
            for i, found in zip(some, self._batch([parts[i] for i in some]), strict=True):
                out[i] = found
        for i, p in enumerate(parts):
            if out[i] is None:
                found = self.choices(p, 2)
                score, ids = found[0]
                out[i] = score, len(ids) // 4, score - found[1][0] if len(found) > 1 else FAR, self.exact(p, ids), ids
        return out

    def _batch(self, parts: list[str]) -> list:
        codes = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        length = np.array([len(p) for p in parts])
        start = np.cumsum(length) - length
        n, width = len(codes), self.longest
        room = np.repeat(start + length, length) - np.arange(n)
        score, piece = np.full((n, width), NEVER, np.int64), np.full((n, width), -1, np.int32)
        live, node = np.arange(n), np.zeros(n, np.int32)
        for k in range(width):
            inside = room[live] > k
            live, node = live[inside], node[inside]
            node = self.trie.step(node, codes[live + k])
            live, node = live[node >= 0], node[node >= 0]
            ends = self.trie.ends[node]
            hit = ends >= 0
            score[live[hit], k], piece[live[hit], k] = self.scores[ends[hit]], ends[hit]
        alone = piece[:, 0] < 0
        score[alone, 0] = self.lowest * (1 + (codes[alone] > 0x7F) + (codes[alone] > 0x7FF) + (codes[alone] > 0xFFFF))
        longest, rows = int(length.max()), len(parts)
        ahead, took = np.full((rows, longest + 1), NEVER, np.int64), np.zeros((rows, longest + 1), np.int8)
        ahead[:, 0] = 0
        for j in range(1, longest + 1):  # parts come by length: the first ones drop out
            r = np.arange(np.searchsorted(length, j), rows)
            ks = np.arange(1, min(width, j) + 1)
            through = ahead[r][:, j - ks] + score[start[r, None] + j - ks, ks - 1]
            best = through.argmax(axis=1)
            ahead[r, j], took[r, j] = through[np.arange(len(r)), best], ks[best]
        path, at, r = np.zeros((rows, longest), np.int8), length.copy(), np.arange(rows)
        while len(r):
            k = took[r, at[r]]
            at[r] -= k
            path[r, at[r]] = k
            r = r[at[r] > 0]
        behind = np.full((rows, longest + width + 1), NEVER, np.int64)
        behind[np.arange(rows), length] = 0
        second, ks = np.full(rows, 2 * NEVER), np.arange(1, width + 1)
        for i in range(longest - 1, -1, -1):
            r = np.arange(np.searchsorted(length, i, side="right"), rows)
            on = score[start[r] + i] + behind[r][:, i + ks]
            behind[r, i] = on.max(axis=1)
            other = np.where(ks == path[r, i][:, None], 2 * NEVER, on + ahead[r, i][:, None])
            second[r] = np.maximum(second[r], other.max(axis=1))
        total = ahead[np.arange(rows), length]
        r, i = np.nonzero(path)
        found = piece[start[r] + i, path[r, i] - 1]
        bytes_needed = np.zeros(rows, bool)
        bytes_needed[r[found < 0]] = True
        ids, count = self.ids[np.maximum(found, 0)].astype("<u4").tobytes(), np.bincount(r, minlength=rows)
        stop = (4 * np.cumsum(count)).tolist()
        cost = np.where(second > NEVER, total - second, FAR).tolist()
        return [None if b else (t, c, d, True, ids[e - 4 * c : e]) for b, t, c, d, e in zip(bytes_needed.tolist(), total.tolist(), count.tolist(), cost, stop, strict=True)]

    def segments(self, text: str) -> list[str]:
        """The text cut at blanks and line ends, where no piece crosses those."""
        marked = self.marked(text)
        if not self.apart or text[:1] == " " or "  " in text or BLANK in text or "\0" in text:
            return self.parts(marked)
        return marked.replace(BLANK, "\0" + BLANK).replace("\n", "\0\n\0").split("\0")

    def lattice(self, s: str) -> list[list[tuple[int, int, bytes]]]:
        edges: list[list[tuple[int, int, bytes]]] = [[] for _ in s]
        get, n = self.walk.get, len(s)
        for i in range(n):
            j, found = i + 1, get(s[i], False)
            if not found:
                ids = [self.byte_id[b] for b in s[i].encode()]
                edges[i].append((i, self.lowest * len(ids), np.array(ids, "<u4").tobytes()))
            while found is not False:
                if found:
                    edges[j - 1].append((i, *found))
                j += 1
                if j > n:
                    break
                found = get(s[i:j], False)
        return edges

    def choices(self, segment: str, n: int) -> list[tuple[int, bytes]]:
        """(score, ids) of a segment's n best."""
        return [(s, b"".join(path)) for s, path in n_best(self.lattice(segment), n)]

    def marked(self, text: str) -> str:
        """The text as the lattice sees it: a blank in front, blanks as U+2581."""
        return BLANK + text.replace(" ", BLANK) if text else ""

    def decode(self, ids: bytes) -> str:
        """Text of ids (little-endian 32 bits): pieces and bytes joined, without the blank in front."""
        text = b"".join(map(self.raw.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode(errors="replace")
        return text[1:] if text[:1] == " " else text

    def exact(self, segment: str, ids: bytes) -> bool:
        return b"".join(map(self.raw.__getitem__, np.frombuffer(ids, "<u4").tolist())) == segment.replace(BLANK, " ").encode()


def best_of_text(chosen: list[list[tuple[int, bytes]]], n: int) -> list[tuple[int, list[int]]]:
    """The n best (score lost, choice of each segment) over segments given by their choices."""
    edges = [[(i, s - options[0][0], k) for k, (s, _) in enumerate(options)] for i, options in enumerate(chosen)]
    return n_best(edges, n)


def segmentations(docs: DataFrame, model_path: str, n: int = N, with_ids: bool = False) -> DataFrame:
    """The n best segmentations of each document: pieces and score of each, checksum of the best one's ids; with_ids adds the ids of all."""
    with open(model_path, "rb") as f:
        model = f.read()
    def make():
        pieces = Pieces(model)
        choices = lru_cache(20_000)(pieces.choices)  # the cheapest second choices are often the same
        memo, parts = worker_memo("pieces:", 300_000, ("piece parts",)), worker_memo("piece parts:", 200_000, ("pieces",))
        if not hasattr(memo, "ids"):
            memo.ids, memo.figures = [], np.zeros((0, 4), np.int64)  # best ids; score, pieces, cost of the second choice, exactness

        def learn(new: list[str]) -> None:
            split = list(map(pieces.parts, new))
            unknown = parts.missing(set().union(*split))
            parts.update(zip(unknown, pieces.best_and_second(unknown), strict=True))
            passing = len(memo.passing)
            held = len(memo)
            at = [*range(held, held + len(new) - passing), *range(memo.most, memo.most + passing)]
            short = max(at, default=-1) + 1 - len(memo.ids)
            if short > 0:
                memo.ids += [b""] * short
                memo.figures = np.concatenate([memo.figures, np.zeros((short, 4), np.int64)])
            figures = []
            for i, ps in zip(at, split, strict=True):
                if len(ps) == 1:
                    *numbers, memo.ids[i] = parts[ps[0]]
                else:
                    scores, counts, seconds, exact, ids = zip(*map(parts.__getitem__, ps), strict=True)
                    memo.ids[i] = b"".join(ids)
                    numbers = sum(scores), sum(counts), min(seconds), all(exact)
                figures.append(numbers)
            if at:
                memo.figures[at] = figures
            memo.update(zip(new, at, strict=True))

        def each(rows: dict) -> dict:
            out: dict[str, list] = {k.split()[0]: [] for k in SCHEMA.split(", ")} | ({"ids": []} if with_ids else {})
            texts = [pieces.segments(t) if t else [] for t in rows["text"]]
            learn(memo.missing(set().union(*texts)))
            for doc_id, text, segments in zip(rows["doc_id"], rows["text"], texts, strict=True):
                at = np.fromiter(map(memo.__getitem__, segments), np.int64, len(segments))
                figures = memo.figures[at]
                score, count = int(figures[:, 0].sum()), int(figures[:, 1].sum())
                second = figures[:, 2]
                open_ = np.flatnonzero(second < FAR)
                if len(open_) > n - 1:  # the n - 1 cheapest, of equal ones the first
                    limit = np.partition(second[open_], n - 2)[n - 2] if n > 1 else -1
                    under, level = open_[second[open_] < limit], open_[second[open_] == limit]
                    open_ = np.sort(np.concatenate([under, level[: n - 1 - len(under)]]))
                best = list(map(memo.ids.__getitem__, at.tolist()))
                chosen = [choices(segments[i], n) if len(segments[i]) <= LONGEST else pieces.choices(segments[i], n) for i in open_.tolist()]
                found = best_of_text(chosen, n)
                more = [sum(len(o[k][1]) - len(o[0][1]) for o, k in zip(chosen, ks, strict=True)) // 4 for _, ks in found]
                out["doc_id"].append(doc_id)
                out["n_segmentations"].append(len(found))
                out["n_pieces"].append([count + m for m in more])
                out["scores"].append([(score + lost) / SCALE for lost, _ in found])
                out["ids_crc32"].append(zlib.crc32(b"".join(best)))
                out["round_trip"].append(bool(figures[:, 3].all()) and BLANK not in (text or ""))
                if with_ids:
                    out["ids"].append([])
                    for _, ks in found:
                        own = list(best)
                        for i, o, k in zip(open_.tolist(), chosen, ks, strict=True):
                            own[i] = o[k][1]
                        out["ids"][-1].append(b"".join(own))
            return out

        return each

    return map_texts(docs, make, SCHEMA + ", ids array<binary>" * with_ids)


def decoded(segmented: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, text) of the best segmentation of each document that carries ids."""
    from pyspark.sql import functions as F

    with open(model_path, "rb") as f:
        model = f.read()

    def make():
        pieces = Pieces(model)

        def each(rows: dict) -> dict:
            return {"doc_id": rows["doc_id"], "text": [None if i is None else pieces.decode(i) for i in rows["best"]]}

        return each

    return map_texts(segmented.select("doc_id", F.col("ids")[0].alias("best")), make, "doc_id long, text string", ("doc_id", "best"))


def op10_nbest_segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return segmentations(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
