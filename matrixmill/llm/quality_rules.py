"""Quality rules: word and line counts, and bands of zstandard compression ratios.

A text is judged twice by compressed size over size: whole, and in fixed chunks. Each length has its own band;
below the band a text repeats itself, above it is noise. All of a text is read.

Defined cases: a null or empty text has no words and fails the base rule; repeated rows are judged each alone;
texts of any length are compressed whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import zstandard
from pyspark.sql import DataFrame, SparkSession

from .base import map_texts, read

SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
SYMBOLS = b"#*$%&|<>"
#: (from this many bytes on, lowest ratio, highest ratio)
BANDS = ((0, 0.0, 2.0), (64, 0.40, 1.30), (256, 0.45, 0.85), (1024, 0.42, 0.70), (4096, 0.38, 0.62), (16384, 0.35, 0.58), (65536, 0.30, 0.56))
CHUNK_BYTES = 4096
LEVEL = 3
#: share of a text's chunks that may lie outside their band
BAD_CHUNKS = 0.2
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ratio double, n_chunks long, n_bad_chunks long, verdict string"


def base_counts(text: str, data: bytes) -> tuple[int, int, int, int, int]:
    words = data.split()
    n = len(words)
    word_chars = len(text) - (len(data) - len(data.translate(None, SPACE)))
    n_symbols = len(data) - len(data.translate(None, SYMBOLS))
    seen: set[bytes] = set()
    dup_lines = 0
    for line in data.split(b"\n"):
        if line in seen:
            dup_lines += 1
        elif line.strip(SPACE):
            seen.add(line)
    # a window's words are covered if the window is found twice or more
    windows = list(zip(words, words[1:], words[2:], strict=False))
    repeat, upto = 0, 0
    if windows:
        counts = Counter(windows)
        if len(counts) < len(windows):
            for i, w in enumerate(windows):
                if counts[w] > 1:
                    repeat += i + 3 - max(i, upto)
                    upto = i + 3
    return n, word_chars, n_symbols, dup_lines, repeat


def band(n_bytes: int, bands: tuple = BANDS) -> tuple[float, float]:
    return next((lo, hi) for least, lo, hi in reversed(bands) if n_bytes >= least)


def compression(data: bytes, z: zstandard.ZstdCompressor, chunk_bytes: int = CHUNK_BYTES, bands: tuple = BANDS) -> tuple[float, int, int, str]:
    """Ratio of the whole, number of chunks, chunks outside their band, verdict."""
    if not data:
        return 0.0, 0, 0, "empty"
    ratio = len(z.compress(data)) / len(data)
    lo, hi = band(len(data), bands)
    n = bad = 0
    full = len(data) // chunk_bytes if len(data) > chunk_bytes else 0
    short = len(data) - full * chunk_bytes
    for i in range(full + (2 * short >= chunk_bytes)) if full else ():
        last = i == full - 1 and 0 < 2 * short < chunk_bytes  # a short rest belongs to the chunk before it
        piece = data[i * chunk_bytes : len(data) if last else (i + 1) * chunk_bytes]
        low, high = band(len(piece), bands)
        n += 1
        bad += not low <= len(z.compress(piece)) / len(piece) <= high
    verdict = "repetitive" if ratio < lo else "incompressible" if ratio > hi else "chunks" if bad > BAD_CHUNKS * n else "ok"
    return ratio, n, bad, verdict


def compression_bands(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES, bands: tuple = BANDS, level: int = LEVEL) -> DataFrame:
    """Base counts, compression figures and verdict of each document."""

    def make():
        z = zstandard.ZstdCompressor(level=level)

        def each(rows: dict) -> dict:
            out: dict[str, list] = {k.split()[0]: [] for k in SCHEMA.split(", ")}
            for doc_id, text in zip(rows["doc_id"], rows["text"], strict=True):
                text = text or ""
                data = text.encode()
                counts = base_counts(text, data)
                failed = counts[0] < 50 or 100 * counts[4] > 50 * counts[0]
                figures = compression(data, z, chunk_bytes, bands)
                for k, v in zip(out, (doc_id, *counts, failed, not failed and figures[3] == "ok", *figures), strict=True):
                    out[k].append(v)
            return out

        return each

    return map_texts(docs, make, SCHEMA)


def op2_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression_bands(read(spark, sf_dir, "documents"))
