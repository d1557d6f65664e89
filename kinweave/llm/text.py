"""Words and rolling hashes of texts, shared by the operators of this package."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

# The white space of `[^\x20\x09-\x0D]+`; it is also exactly what bytes.split() splits at.
SPACE = "\\x20\\x09-\\x0D"
_LOWER = bytes(
    c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32
    for c in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    """The UTF-8 words between ASCII white space; null has none."""
    return text.encode("utf-8", "replace").split() if text else []


def plain_words(text: str | None) -> list[bytes]:
    """Words with A-Z in lower case, cut at every ASCII character but letters and digits."""
    return text.encode("utf-8", "replace").translate(_LOWER).split() if text else []


def hashes(words: list[bytes], seed: int = 0) -> np.ndarray:
    """One 64-bit hash per word."""
    digest = xxhash.xxh3_64_intdigest
    if seed:
        return np.fromiter((digest(w, seed) for w in words), np.uint64, len(words))
    return np.fromiter(map(digest, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that every bit depends on every bit (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` words, from the hashes of the words; none if too short."""
    count = len(h) - n + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(count, np.uint64)
    for k in range(n):
        total *= np.uint64(0x9E3779B97F4A7C15)
        total += h[k : k + count]
    return mixed(total)


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as a Spark BIGINT."""
    return x.view(np.int64)


def crc_remainder(doc_id: str, by: int) -> Column:
    """crc32 of an id as text, modulo ``by``; null where the id is null."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(by))
