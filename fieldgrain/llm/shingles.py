"""Word shingles of a text as 64-bit hashes, and the SimHash over them."""

from __future__ import annotations

from itertools import accumulate

import numpy as np


def digests(text: str | None, words: int = 4, seed: int = 42) -> np.ndarray:
    """The XXH64 of each word shingle, repeats included: a row of eight bytes, most significant first."""
    import xxhash

    found = (text or "").encode().lower().split()  # bytes: A-Z only, and the six ASCII white-space characters
    digest = xxhash.xxh64_digest
    if not found:
        return np.zeros((0, 8), np.uint8)
    joined = b" ".join(found)
    if len(found) <= words:
        return np.frombuffer(digest(joined, seed), np.uint8).reshape(1, 8)
    ends = list(accumulate((len(w) + 1 for w in found)))
    starts = [0, *ends[: len(found) - words]]
    raw = b"".join([digest(joined[s : e - 1], seed) for s, e in zip(starts, ends[words - 1 :], strict=True)])
    return np.frombuffer(raw, np.uint8).reshape(-1, 8)


def print_of(hashes: np.ndarray) -> int:
    """Signed 64-bit SimHash of digests; zero for none."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        ones += np.unpackbits(hashes[at : at + 4096], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big", signed=True)


def fingerprint_of(text: str | None, words: int = 4, seed: int = 42) -> int:
    """Signed 64-bit SimHash of the text's word shingles, repeats included."""
    return print_of(digests(text, words, seed))
