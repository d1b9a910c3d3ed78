"""Content-defined anchors: where two texts share enough bytes, both have an anchor at the same place of the shared part.

The anchor of a window of LENGTH bytes is its leftmost seed (a run of SEED
bytes) of smallest hash.  Runs of windows with one anchor form a block: the
bytes that these windows cover.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

LENGTH, SEED = 100, 24
SEEDS = LENGTH - SEED + 1  # in a window
PLACE_BITS = 28
#: Bytes handled at once, at some 100 bytes of memory each; a longer text is cut, so that places in a chunk fit PLACE_BITS.
CHUNK = 512 << 10

# Odd 64-bit multipliers.
M1, M2, M3, M4, BASE = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0x2545F4914F6CDD1D))


@dataclass
class Blocks:
    """Parallel arrays, one entry a block; ``first``/``anchor`` are byte places in the chunk."""

    seed: np.ndarray  # hash of the anchor's seed
    body: np.ndarray  # hash of the block's bytes and of the anchor's place in it
    first: np.ndarray  # the first window's start
    windows: np.ndarray  # how many windows
    anchor: np.ndarray
    text: np.ndarray  # which text


def seed_hashes(raw: np.ndarray) -> np.ndarray:
    """Hash of the SEED bytes at each place (the last SEED - 1 places have none)."""
    n = len(raw) - SEED + 1
    word = lambda at: np.ndarray((n,), "<u8", raw, at, (1,))
    h = word(0) * M1
    h ^= h >> np.uint64(31)
    h += word(8)
    h *= M2
    h ^= h >> np.uint64(29)
    h += word(16)
    h *= M3
    h ^= h >> np.uint64(32)
    h *= M4
    h ^= h >> np.uint64(30)
    return h


def _sliding_min(key: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while 2 * span <= width:
        key = np.minimum(key[:-span], key[span:])
        span *= 2
    rest = width - span
    return np.minimum(key[: len(key) - rest], key[rest:]) if rest else key


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** k and its inverse, modulo 2 ** 64, for k below n."""
    size = 1 << max(n, 1).bit_length()
    if size not in _powers:
        _powers.clear()
        inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
        up, down = np.full(size, BASE, "u8"), np.full(size, inverse, "u8")
        up[0] = down[0] = 1
        _powers[size] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers[size]


def blocks_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, Blocks | None]:
    """The joined bytes, each text's start, and the blocks of all windows within texts."""
    raw = np.frombuffer(b"".join(texts), "u1")
    sizes = np.array([len(t) for t in texts], "i8")
    stops = np.cumsum(sizes)
    starts = stops - sizes
    long = sizes >= LENGTH
    if not long.any():
        return raw, starts, None
    h = seed_hashes(raw)
    key = h >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS)
    key |= np.arange(len(h), dtype="u8")
    at = (_sliding_min(key, SEEDS) & np.uint64((1 << PLACE_BITS) - 1)).astype("i8")
    del key
    # Windows within one text, and where their anchor or their text changes.
    valid = np.zeros(len(at) + 1, "i4")
    np.add.at(valid, starts[long], 1)
    np.add.at(valid, (stops - LENGTH + 1)[long], -1)
    inside = np.cumsum(valid[:-1]) > 0
    change = np.empty(len(at), bool)
    change[0] = True
    np.not_equal(at[1:], at[:-1], out=change[1:])
    change[1:] |= inside[1:] != inside[:-1]
    change[starts[long]] = True
    run = np.flatnonzero(change)
    last = np.append(run[1:], len(at))
    keep = inside[run]
    first, windows = run[keep], (last - run)[keep]
    anchor = at[first]
    up, down = powers(len(h) + 1)
    total = np.concatenate([np.zeros(1, "u8"), np.cumsum(h * up[: len(h)], dtype="u8")])
    end = first + windows + LENGTH - SEED  # one past the last seed of the block
    body = (total[end] - total[first]) * down[first]
    body ^= (anchor - first).astype("u8") * M2 + windows.astype("u8") * M3
    body ^= body >> np.uint64(29)
    body *= M1
    text = np.searchsorted(starts, first, "right") - 1
    # Empty texts share a start with the next one; the last of equal starts is the one with bytes.
    return raw, starts, Blocks(h[anchor].view("i8"), body.view("i8"), first, windows, anchor, text)


def pieces(text: bytes) -> list[tuple[int, bytes]]:
    """Parts of a text with their starts: each window of LENGTH bytes lies in just one, and CHUNK windows in each but the last."""
    return [(a, text[a : a + CHUNK + LENGTH - 1]) for a in range(0, max(1, len(text) - LENGTH + 1), CHUNK)]


def chunks(texts: list[bytes]):
    """Ranges of texts of about CHUNK bytes."""
    a = size = 0
    for k, t in enumerate(texts):
        if size and size + len(t) > CHUNK:
            yield a, k
            a, size = k, 0
        size += len(t)
    if a < len(texts):
        yield a, len(texts)
