"""64-bit hashes of all words of a text at once, over its bytes."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

#: Odd factors of polynomial hashes over word hashes, and of the mixing; others would do.
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
MIXERS = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xFF51AFD7ED558CCD)
#: Words above so many 8-byte pieces are hashed one by one.
LANES = 8

_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
#: Masks that keep the first 0 to 8 bytes of a little-endian integer.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def mixed(h: np.ndarray, k: int = 0) -> np.ndarray:
    h = (h ^ h >> np.uint64(32)) * np.uint64(MIXERS[k])
    return h ^ h >> np.uint64(29)


def _strong(h: np.ndarray) -> np.ndarray:
    """A permutation of the 64-bit integers in which every bit depends on all bits."""
    h = (h ^ h >> np.uint64(30)) * np.uint64(MIXERS[0])
    h = (h ^ h >> np.uint64(27)) * np.uint64(MIXERS[1])
    return h ^ h >> np.uint64(31)


def words_of(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of a byte array start and end; they are what ``bytes.split()`` gives."""
    word = ~_BLANK[raw]
    edge = np.flatnonzero(word[1:] != word[:-1]) + 1
    if len(raw) and word[0]:
        edge = np.concatenate([[0], edge])
    if len(raw) and word[-1]:
        edge = np.concatenate([edge, [len(raw)]])
    return edge[::2], edge[1::2]


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hash of each word under a seed.

    A word's pieces of 8 bytes are each mixed under a key of their place, added up with the length and mixed again: unlike a polynomial over
    the bytes this is not linear in them, so that no pattern of bytes makes different words alike under every key. Longer words get XXH64.
    """
    from xxhash import xxh64_intdigest

    keys = _strong(np.arange(1, LANES + 2, dtype=np.uint64) * np.uint64(BASES[0]) + np.uint64(seed))
    eights = np.ndarray(len(raw) + 1, "<u8", np.concatenate([raw, np.zeros(8, np.uint8)]), strides=(1,))  # the 8 bytes from each place on
    size = ends - starts
    total = size.astype(np.uint64) * np.uint64(MIXERS[2]) + keys[LANES]
    long = np.flatnonzero(size > 8 * LANES)
    at = slice(None)
    for lane in range(LANES):
        total[at] += _strong(eights[starts[at] + 8 * lane] & _FIRST[np.minimum(size[at] - 8 * lane, 8)] ^ keys[lane])
        at = np.flatnonzero(size > 8 * lane + 8)
        if not len(at):
            break
    for i in long.tolist():
        total[i] = xxh64_intdigest(raw[starts[i] : ends[i]].tobytes(), seed)
    return _strong(total)


def text_hashes(texts: Iterable[bytes], most: int = 1 << 20) -> Iterator[np.ndarray]:
    """The word hashes of each text; texts of about so many bytes are hashed together."""

    def hashed(held: list[bytes]) -> list[np.ndarray]:
        raw = np.frombuffer(b"\n".join(held), np.uint8)
        starts, ends = words_of(raw)
        cuts = np.searchsorted(starts, np.cumsum([len(t) + 1 for t in held]))[:-1]
        return np.split(word_hashes(raw, starts, ends), cuts)

    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size >= most:
            yield from hashed(held)
            held, size = [], 0
    if held:
        yield from hashed(held)
