"""Words and shingles of texts, a slice at a time, so that a very long text is never held as a list of words."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import xxhash

#: Bytes of a text whose words are held at once (a longer word is held whole).
SLICE_BYTES = 1 << 20
_SPACE = re.compile(rb"[ \t\n\x0b\x0c\r]")


def word_slices(data: bytes, size: int | None = None) -> Iterator[list[bytes]]:
    """The words of ``data`` (runs without ASCII white space) in lists; slices end at white space."""
    size = size or SLICE_BYTES
    at = 0
    while at < len(data):
        cut = _SPACE.search(data, at + size) if len(data) - at > size else None
        end = cut.start() if cut else len(data)
        yield (data if end - at == len(data) else data[at:end]).split()
        at = end


def windows(slices: Iterator[list[bytes]], width: int) -> Iterator[list[bytes]]:
    """The runs of ``width`` words, space-joined, slice by slice; those that cross slices are in the later one. Fewer
    words give no run."""
    carry: list[bytes] = []
    for words in slices:
        words = carry + words if carry else words
        carry = words[max(0, len(words) - width + 1) :]
        if len(words) < width:
            continue
        joined = b" ".join(words)
        gaps = np.flatnonzero(np.frombuffer(joined, dtype=np.uint8) == 32)
        starts = [0, *(gaps[: len(words) - width] + 1).tolist()]
        ends = [*gaps[width - 1 :].tolist(), len(joined)]
        yield [joined[a:b] for a, b in zip(starts, ends)]


def shingle_hashes(text: str | None, width: int, seed: int, size: int | None = None) -> Iterator[np.ndarray]:
    """XXH64 of each shingle of ``text``, A-Z lower-cased, repeats included, slice by slice. Fewer words than ``width``
    are one shingle; a text without words has none."""
    data = (text or "").encode("utf-8", "surrogatepass").lower()
    some = False
    for parts in windows(word_slices(data, size), width):
        some = True
        yield np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(seed)), dtype=np.uint64, count=len(parts))
    if not some:
        words = [w for part in word_slices(data, size) for w in part]  # fewer than ``width``
        if words:
            yield np.array([xxhash.xxh64_intdigest(b" ".join(words), seed)], dtype=np.uint64)


def digests(parts: list[bytes]) -> np.ndarray:
    """128-bit digests, a row of two numbers for each part."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, parts)), dtype="<u8").reshape(-1, 2)


def repeats(rows: np.ndarray) -> np.ndarray:
    """Which of the digests ``rows`` occur more than once. Only those whose first number repeats are sorted whole."""
    first = np.sort(rows[:, 0])
    twice = np.unique(first[1:][first[1:] == first[:-1]])
    at = np.flatnonzero(np.isin(rows[:, 0], twice))
    order = at[np.lexsort((rows[at, 1], rows[at, 0]))]
    same = (rows[order[1:]] == rows[order[:-1]]).all(axis=1)
    out = np.zeros(len(rows), dtype=bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out
