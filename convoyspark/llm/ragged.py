"""Many texts as one byte array: token bounds, 64-bit token hashes and ragged gathers, all in numpy."""

from __future__ import annotations

import numpy as np

_STEP = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_STEP_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER_AZ = np.arange(256, dtype=np.uint8)
LOWER_AZ[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))


_kept = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the step and of its inverse, at least so many; only the longest tables asked for are kept."""
    global _kept
    if len(_kept[0]) < size:
        steps = [np.full(size, s, np.uint64) for s in (_STEP, _STEP_BACK)]
        for s in steps:
            s[0] = 1
            np.multiply.accumulate(s, out=s)
        _kept = (steps[0], steps[1])
    return _kept


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each slice ``data[start:end]`` (bytes or code points); it depends on these alone, never on their place."""
    size = 1 << max(16, int(len(data)).bit_length())
    up, down = _powers(size)
    sums = np.zeros(len(data) + 1, np.uint64)
    values = _BYTE[data] if data.dtype == np.uint8 else mix((data.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD1B54A32D192ED03))
    np.cumsum(values * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The slices ``flat[start:start + length]``, one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(starts - (ends - lengths), lengths) + np.arange(total)]


def words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words between ASCII white space in texts ``data[bounds[i]:bounds[i + 1]]``: starts, ends, and words per text."""
    inside = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)  # where a word may not go on from the byte before
    edge[bounds] = True
    before = np.concatenate(([False], inside))
    after = np.concatenate((inside, [False]))
    starts = np.flatnonzero(after & (~before | edge))
    ends = np.flatnonzero(before & (~after | edge))
    return starts, ends, np.diff(np.searchsorted(starts, bounds))


def joined(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in one array and the bounds between them; null counts as empty."""
    parts = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
    bounds = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) for p in parts], out=bounds[1:])
    return np.frombuffer(b"".join(parts), np.uint8), bounds


def blocks(texts: list[str | None], size: int):
    """Runs of texts of about ``size`` characters (one text at least), to bound what is held at once."""
    start = held = 0
    for i, t in enumerate(texts):
        held += len(t or "")
        if held >= size:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)
