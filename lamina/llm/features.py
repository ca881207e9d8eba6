"""Byte n-gram counts of texts as fixed-width vectors, computed with numpy inside tasks."""

from __future__ import annotations

import numpy as np

#: Bytes of text whose n-grams are counted at once.
CHUNK = 1 << 20


def ngram_codes(data: np.ndarray, width: int) -> np.ndarray:
    """Hashed codes below ``width`` (a power of two) of the byte pairs and triples of a text."""
    x = data.astype(np.uint32)
    pairs = x[:-1] << np.uint32(8) | x[1:]
    triples = pairs[:-1] << np.uint32(8) | x[2:]
    shift = np.uint32(32 - int(width).bit_length() + 1)
    return np.concatenate((pairs * np.uint32(2_654_435_761) >> shift, (triples | np.uint32(1 << 24)) * np.uint32(2_246_822_519) >> shift))


def ngram_counts(text: str, width: int) -> np.ndarray:
    """Counts of the hashed byte pairs and triples of a whole text; zeros for fewer than two bytes."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    out = np.zeros(width, np.int64)
    for at in range(0, max(1, len(data)), CHUNK):
        piece = data[at : at + CHUNK + 2]  # n-grams across the cut belong to the earlier chunk
        if len(piece) < 2:
            continue
        codes = ngram_codes(piece, width)
        if at + CHUNK < len(data) and len(piece) > CHUNK:
            # keep the n-grams that start within this chunk: CHUNK pairs and CHUNK triples
            n = len(piece)
            codes = np.concatenate((codes[: min(CHUNK, n - 1)], codes[n - 1 : n - 1 + min(CHUNK, max(0, n - 2))]))
        out += np.bincount(codes, minlength=width)
    return out


#: ASCII letters to lower case, other ASCII characters but digits to spaces.
_plain = bytes(c | 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c >= 128 else 32 for c in range(256))


def plain_words(text: str) -> list[bytes]:
    """Words of letters, digits and non-ASCII bytes, ASCII letters in lower case."""
    return text.encode("utf-8", "surrogatepass").translate(_plain).split()
