"""Word shingles as 64-bit values, for use inside Spark tasks."""

from __future__ import annotations

import numpy as np
import xxhash

#: Odd multipliers that tell the places of a shingle's words apart.
_PLACES = np.array(
    [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F],
    dtype=np.uint64,
)


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    values = values ^ (values >> np.uint64(33))
    values *= np.uint64(0xFF51AFD7ED558CCD)
    values ^= values >> np.uint64(29)
    values *= np.uint64(0xC4CEB9FE1A85EC53)
    values ^= values >> np.uint64(32)
    return values


def words(text: str | None) -> list[bytes]:
    """A-Z lower-cased; the runs of anything but the six ASCII white-space characters."""
    return text.encode().lower().split() if text else []


def shingle_set(text: str | None, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the ``width``-word shingles; of the whole sequence where it is shorter."""
    found = words(text)
    if not found:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found))
    used = min(width, len(found))
    n = len(found) - used + 1
    # a short sequence must not equal a longer one that begins alike: its length goes in
    total = np.full(n, used, np.uint64)
    for k in range(used):
        total *= _PLACES[k % len(_PLACES)]
        total += hashes[k : k + n]
    total = mixed(total)
    total.sort()
    return total if n == 1 else total[np.concatenate(([True], total[1:] != total[:-1]))]
