"""Words of UTF-8 texts as bytes, and their hashes.

All word classes of the operators are ASCII rules, so bytes give the same words as code points.
"""

from __future__ import annotations

import numpy as np
import xxhash

_UPPER, _LOWER = bytes(range(65, 91)), bytes(range(97, 123))
LOWER = bytes.maketrans(_UPPER, _LOWER)
# Letters and digits stay, lower-cased; every other ASCII byte becomes a space.
LOWER_ALNUM = bytes(
    b + 32 if 65 <= b <= 90 else b if b > 127 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)
BASE = np.uint64(0x9E3779B97F4A7C15)
SECOND_BASE = np.uint64(0xC2B2AE3D27D4EB4F)


def split(text: bytes | None) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+`; a null text has none."""
    return text.split() if text else []


def split_lower(text: bytes | None) -> list[bytes]:
    return text.translate(LOWER).split() if text else []


def split_alnum(text: bytes | None) -> list[bytes]:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text with A-Z in lower case."""
    return text.translate(LOWER_ALNUM).split() if text else []


def hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


def windows(values: np.ndarray, length: int, base: np.uint64 = BASE) -> np.ndarray:
    """A hash of each run of ``length`` values; empty where there are fewer."""
    count = len(values) - length + 1
    if count <= 0:
        return np.empty(0, dtype=np.uint64)
    out = values[:count].copy()
    for at in range(1, length):
        out *= base
        out += values[at : at + count]
    return mix(out)


def mix(values: np.ndarray) -> np.ndarray:
    """Spread the bits, so that an order of these values is as good as random."""
    values = values ^ (values >> np.uint64(33))
    values = values * np.uint64(0xFF51AFD7ED558CCD)
    values ^= values >> np.uint64(33)
    values *= np.uint64(0xC4CEB9FE1A85EC53)
    return values ^ (values >> np.uint64(33))


def minimizers(values: np.ndarray, width: int) -> np.ndarray:
    """For each run of ``width`` values the place of its smallest, the first of equal ones."""
    count = len(values) - width + 1
    if count <= 0:
        return np.empty(0, dtype=np.int64)
    low = values[:count].copy()
    place = np.zeros(count, dtype=np.int64)
    for at in range(1, width):
        other = values[at : at + count]
        less = other < low
        place[less] = at
        np.minimum(low, other, out=low)
    return place + np.arange(count)
