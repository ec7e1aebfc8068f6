"""64-bit hashes of words and word sequences, over whole buffers of text at once."""

from __future__ import annotations

import numpy as np

SLICE = 1 << 17  # bytes of text hashed at once (a longer text is a slice of its own)


def mixed(h: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit bijection per seed (the splitmix finaliser)."""
    h = h + np.uint64(seed * 0x9E3779B97F4A7C15 % 2 ** 64)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(n: int, seed: int) -> np.ndarray:
    """1, m, m*m, ... for an odd multiplier of the seed."""
    m = mixed(np.array([seed], dtype=np.uint64), 3)[0] | np.uint64(1)
    out = np.full(max(n, 1), m, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


#: A value per byte, and powers for words of usual length.
VALUES = mixed(np.arange(256, dtype=np.uint64), 4)
SHORT = powers(64, 5)


def _sums(values: np.ndarray, size: np.ndarray, seed: int, known: np.ndarray | None = None) -> np.ndarray:
    """Polynomial hash of consecutive groups of values, `size` each (at least one)."""
    begin = np.cumsum(size) - size
    place = np.arange(len(values)) - np.repeat(begin, size)
    most = int(size.max())
    table = known if known is not None and most <= len(known) else powers(most, seed)
    return mixed(np.add.reduceat(values * table[place], begin) + size.astype(np.uint64), seed)


def word_hashes(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of every word of a normalised text (words are runs of bytes above 32)."""
    return _long(text) if len(text) > 2 * SLICE else _whole(text)


def _whole(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(text, dtype=np.uint8)
    inside = data > 32
    turn = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0, append=0))
    starts, ends = turn[::2], turn[1::2]
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), starts
    return _sums(VALUES[data[inside]], ends - starts, 5, SHORT), starts


def _long(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The same in parts of about SLICE bytes, cut where no word is."""
    parts, at = [], 0
    while at < len(text):
        cut = at + SLICE
        while cut < len(text) and text[cut] > 32:
            cut += 1
        part = text[at:cut]
        # a part that is one long word has no better cut
        h, starts = word_hashes(part) if len(part) <= 2 * SLICE else _whole(part)
        parts.append((h, starts + at))
        at = cut
    return tuple(np.concatenate(x) for x in zip(*parts))


def sequence_hashes(words: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes of consecutive word sequences, `size` words each (at least one)."""
    return _sums(mixed(words, 6), size, 7), _sums(mixed(words, 8), size, 9)


def slices(texts: list) -> list[list]:
    """The texts in groups of about SLICE bytes, at least one group."""
    out, held = [[]], 0
    for t in texts:
        if held > SLICE:
            out.append([])
            held = 0
        out[-1].append(t)
        held += len(t or b"")
    return out
