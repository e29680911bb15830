"""Language identification by a bidirectional gated recurrent network over bytes.

The network is trained in numpy by backpropagation through time. It reads the running text, bytes with A-Z lower-cased,
across word bounds: spans of SPAN bytes with CONTEXT more on either side, which only bring the states up to date, so that
every position is labelled once with its neighbours in view. Two gated recurrent layers read each span, one from either
end; every byte position gets a label distribution from both states; the document's probabilities are the softmax of
the mean of its positions' log-probabilities, scaled by the square root of their number up to FOCUS. All positions of
the whole text count.

Defined cases: a null text or one without a letter is 'und' with score 0; repeated rows are judged each alone, ties of
probability go to the first language by name; with nothing to learn from, as in an empty table, every text is 'und';
other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .base import held_out, id_mod, map_texts, read, release_memos

HIDDEN, EMBED, SPAN, CONTEXT, FOCUS = 8, 8, 224, 16, 64
#: spans that are scored at once
TOGETHER = 1024
#: bound of the training sample: documents of each language, characters of a document
PER_LANG, MAX_CHARS = 150, 20_000
#: what is learned from them: pieces of each language, bytes of a piece
PIECES, PIECE = 1500, 64
EPOCHS, BATCH, RATE = 5, 128, 0.015
SCHEMA = "doc_id long, lang_pred string, score double"
LETTER = regex.compile(r"\p{L}")


def text_bytes(text: str | None) -> bytes:
    return (text or "").encode().lower()  # bytes: only A-Z change


def spans(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """Pieces of at most SPAN bytes with their context; of each the text it is from, and the first and the end of the positions to label."""
    pieces, owner, first, end = [], [], [], []
    for i, t in enumerate(texts):
        for k in range(0, len(t), SPAN):
            start = max(0, k - CONTEXT)
            pieces.append(t[start : k + SPAN + CONTEXT])
            owner.append(i)
            first.append(k - start)
            end.append(min(k + SPAN, len(t)) - start)
    return pieces, np.array(owner, np.int64), np.array(first, np.int64), np.array(end, np.int64)


def table(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes (positions, pieces), zeros behind the end of a piece, and lengths."""
    length = np.array([len(p) for p in pieces], np.int64)
    x = np.zeros((len(pieces), int(length.max(initial=1))), np.uint8)
    x[np.arange(x.shape[1]) < length[:, None]] = np.frombuffer(b"".join(pieces), np.uint8)
    return x.T.copy(), length


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


class Layer:
    """One gated recurrent layer. Gates: update z, reset r, candidate n; h' = n + z * (h - n). States are (HIDDEN, sequences)."""

    def __init__(self, rng: np.random.Generator) -> None:
        self.wx = (rng.normal(0, 1, (3 * HIDDEN, EMBED)) / np.sqrt(EMBED)).astype(np.float32)
        self.wh = (rng.normal(0, 1, (3 * HIDDEN, HIDDEN)) / np.sqrt(HIDDEN)).astype(np.float32)
        self.b = np.zeros((3 * HIDDEN, 1), np.float32)

    def run(self, gates: np.ndarray, steps: list[np.ndarray], keep: bool) -> list:
        """gates: (3 * HIDDEN, 256), the input's share for each byte; steps: the bytes at each time, in reading order."""
        h = np.zeros((HIDDEN, len(steps[0])), np.float32)
        out = []
        for x in steps:
            g, u = gates[:, x], self.wh @ h
            zr = sigmoid(g[: 2 * HIDDEN] + u[: 2 * HIDDEN])
            z, r = zr[:HIDDEN], zr[HIDDEN:]
            n = np.tanh(g[2 * HIDDEN :] + r * u[2 * HIDDEN :])
            before, h = h, n + z * (h - n)
            out.append((h, before, z, r, n, u[2 * HIDDEN :]) if keep else h)
        return out

    def states(self, gates: np.ndarray, steps: list[np.ndarray]) -> list[np.ndarray]:
        """As run, in place, for scoring."""
        h, out = np.zeros((HIDDEN, len(steps[0])), np.float32), []
        for x in steps:
            g, u = gates.take(x, axis=1), self.wh @ h
            zr, n = g[: 2 * HIDDEN], u[2 * HIDDEN :]
            zr += u[: 2 * HIDDEN]
            np.negative(zr, zr)
            np.exp(zr, zr)
            zr += np.float32(1)
            np.reciprocal(zr, zr)
            n *= zr[HIDDEN:]
            n += g[2 * HIDDEN :]
            np.tanh(n, n)
            h = h - n
            h *= zr[:HIDDEN]
            h += n
            out.append(h)
        return out

    def back(self, kept: list, dh_out: list[np.ndarray], steps: list[np.ndarray], masks: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Gradients of wh and of the gates' table, through time."""
        dwh, dgates = np.zeros_like(self.wh), np.zeros((256, 3 * HIDDEN), np.float32)
        carry = np.zeros_like(kept[0][0])
        for (_, before, z, r, n, un), dh, x, m in zip(reversed(kept), reversed(dh_out), reversed(steps), reversed(masks), strict=True):
            dh = (dh + carry) * m
            dz, dn = dh * (before - n) * z * (1 - z), dh * (1 - z) * (1 - n * n)
            dr = dn * un * r * (1 - r)
            du = np.concatenate([dz, dr, dn * r])
            dwh += du @ before.T
            np.add.at(dgates, x, np.concatenate([dz, dr, dn]).T)
            carry = dh * z + self.wh.T @ du
        return dwh, dgates.T


class Network:
    def __init__(self, langs: list[str], seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        self.langs = langs
        self.embed = rng.normal(0, 0.5, (EMBED, 256)).astype(np.float32)
        self.layers = [Layer(rng), Layer(rng)]
        self.out = (rng.normal(0, 1, (len(langs), 2 * HIDDEN)) / np.sqrt(2 * HIDDEN)).astype(np.float32)
        self.bias = np.zeros((len(langs), 1), np.float32)

    def gates(self) -> list[np.ndarray]:
        return [layer.wx @ self.embed + layer.b for layer in self.layers]

    @staticmethod
    def reading(x: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes reversed within each sequence's length, and for each position where it lies there."""
        at = length[None, :] - 1 - np.arange(len(x))[:, None]
        at = np.where(at >= 0, at, np.arange(len(x))[:, None])
        return np.take_along_axis(x, at, 0), at

    def forward(self, x: np.ndarray, length: np.ndarray, keep: bool = False) -> tuple:
        back, at = self.reading(x, length)
        kept = [layer.run(g, list(s), keep) for layer, g, s in zip(self.layers, self.gates(), (x, back), strict=True)]
        fwd, bwd = (np.stack([k[0] if keep else k for k in ks]) for ks in kept)
        bwd = np.take_along_axis(bwd, at[:, None, :], 0)
        states = np.concatenate([fwd, bwd], axis=1)
        logits = np.einsum("lh,thb->tlb", self.out, states, optimize=True) + self.bias
        logits -= logits.max(axis=1, keepdims=True)
        logp = logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))
        return logp, states, kept, back, at

    def fit(self, pieces: list[bytes], y: np.ndarray, epochs: int = EPOCHS, seed: int = 5) -> None:
        """Adam on the mean negative log-probability of the piece's language over all positions."""
        rng = np.random.default_rng(seed)
        params = [self.embed, self.out, self.bias, *(p for la in self.layers for p in (la.wx, la.wh, la.b))]
        moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
        x, length = table(pieces)
        t = 0
        for epoch in range(epochs):
            order = rng.permutation(len(length))
            for k in range(0, len(order), BATCH):
                some = order[k : k + BATCH]
                t += 1
                rate = RATE * (1 - epoch / epochs)
                for p, g, (m, v) in zip(params, self.gradients(x[: length[some].max(), some], length[some], y[some]), moments, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.01 * (g * g - v)
                    p -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)

    def gradients(self, x: np.ndarray, length: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        logp, states, kept, back, at = self.forward(x, length, keep=True)
        live = (np.arange(len(x))[:, None] < length[None, :]).astype(np.float32)
        d = np.exp(logp)
        d[:, y, np.arange(len(y))] -= 1
        d *= live[:, None, :] / live.sum()
        dout, dbias = np.einsum("tlb,thb->lh", d, states, optimize=True), d.sum(axis=(0, 2))[:, None]
        dstates = np.einsum("lh,tlb->thb", self.out, d, optimize=True)
        # the reversing map is its own inverse within each length
        sides = dstates[:, :HIDDEN], np.take_along_axis(dstates[:, HIDDEN:], at[:, None, :], 0)
        masks = [m[None, :] for m in live]
        dembed, grads = np.zeros_like(self.embed), []
        for layer, ks, dh, steps in zip(self.layers, kept, sides, (x, back), strict=True):
            dwh, dgates = layer.back(ks, list(dh), list(steps), masks)
            dembed += layer.wx.T @ dgates
            grads += [dgates @ self.embed.T, dwh, dgates.sum(axis=1, keepdims=True)]
        return [dembed, dout, dbias, *grads]

    def text_scores(self, texts: list[bytes]) -> np.ndarray:
        """(texts, languages): summed log-probabilities of all positions."""
        out = np.zeros((len(texts), len(self.langs)))
        pieces, owner, first, end = spans(texts)
        size = np.array([len(p) for p in pieces], np.int64)
        by_size = np.argsort(size, kind="stable")
        gates, halves = self.gates(), (self.out[:, :HIDDEN], self.out[:, HIDDEN:])
        for k in range(0, len(pieces), TOGETHER):  # small arrays stay in the cache and off the heap's slow path
            some = by_size[k : k + TOGETHER]
            x, length = table([pieces[i] for i in some])
            fwd = self.layers[0].states(gates[0], list(x))
            # from the other end: pieces of one length or nearly so stand together, each set flush with the end
            shift = len(x) - length
            back = np.zeros_like(x)
            live = np.arange(len(x))[:, None] < length
            back[(np.arange(len(x))[:, None] + shift)[live], np.nonzero(live)[1]] = x[live]
            ends = shift.any()
            bwd = self.layers[1].states(gates[1], list((back if ends else x)[::-1]))[::-1]
            if ends:  # back from flush with the end to flush with the start
                stacked = np.stack(bwd)
                at = np.minimum(np.arange(len(x))[:, None] + shift, len(x) - 1)
                bwd = list(np.take_along_axis(stacked, at[:, None, :], 0))
            total = np.zeros((len(self.langs), len(some)), np.float32)
            a, b = first[some], end[some]
            for t, (f, g) in enumerate(zip(fwd, bwd, strict=True)):
                z = halves[0] @ f
                z += halves[1] @ g
                z += self.bias
                z -= z.max(axis=0)
                z -= np.log(np.exp(z).sum(axis=0))
                total += z * ((a <= t) & (t < b))
            np.add.at(out, owner[some], total.T)
        return out


def training_pieces(docs: DataFrame, trainable: Column) -> tuple[list[str], list[bytes], np.ndarray]:
    """Languages, and pieces of text with the language of their document. PER_LANG documents of each language are read at most, by hash of doc_id."""
    known = docs.filter(trainable & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    counts = {r.lang: r.n for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a language
    langs = sorted(counts)
    if not langs:
        return [], [], np.zeros(0, int)
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, 2 * PER_LANG / n))])
    h = F.xxhash64(F.col("doc_id").cast("string"))
    near = known.filter((F.pmod(h, F.lit(1 << 20)) / (1 << 20) < share[F.col("lang")]) & (F.length("text") <= MAX_CHARS))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy(h, "doc_id", F.xxhash64("text")))
    rows = near.withColumn("nth", nth).filter(F.col("nth") <= PER_LANG).collect()
    rng, pieces, y = np.random.default_rng(1), [], []
    for i, lang in enumerate(langs):
        texts = [text_bytes(r.text) for r in sorted((r for r in rows if r.lang == lang), key=lambda r: r.nth)]
        found = sorted({t[k : k + PIECE] for t in texts for k in range(0, len(t), PIECE)} - {b""})
        some = rng.permutation(len(found))[:PIECES]
        pieces += [found[j] for j in some]
        y += [i] * len(some)
    return langs, pieces, np.array(y, int)


def fit(docs: DataFrame, trainable: Column | None = None) -> Network:
    langs, pieces, y = training_pieces(docs, id_mod(F.col("doc_id"), 3) != 1 if trainable is None else trainable)
    network = Network(langs or ["und"])
    if pieces:
        network.fit(pieces, y)
    return network


def identify(docs: DataFrame, network: Network) -> DataFrame:
    """Predicted language and its probability for each document."""

    def make():
        release_memos()

        def each(rows: dict) -> dict:
            lettered = [bool(t and LETTER.search(t)) and network.langs != ["und"] for t in rows["text"]]
            texts = [text_bytes(t) for t, x in zip(rows["text"], lettered, strict=True) if x]
            n = np.array([len(t) for t in texts], float)[:, None]
            pooled = network.text_scores(texts) / n * np.sqrt(np.minimum(n, FOCUS))
            p = np.exp(pooled - pooled.max(axis=1, keepdims=True))
            found = iter(zip(p.argmax(axis=1).tolist(), (p.max(axis=1) / p.sum(axis=1)).tolist(), strict=True))
            got = [next(found) if x else (-1, 0.0) for x in lettered]
            return {"doc_id": rows["doc_id"], "lang_pred": [network.langs[i] if i >= 0 else "und" for i, _ in got], "score": [q for _, q in got]}

        return each

    return map_texts(docs, make, SCHEMA)


def op5_bidirectional_gru(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return identify(docs, fit(docs)).select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "lang_pred", "score")
