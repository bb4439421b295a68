"""Entropy coding of symbol streams with context models: interleaved range asymmetric numeral systems.

A stream is cut into lanes that are coded side by side, one symbol of each lane a step. The chance of a
symbol depends on the symbols before it in its value; the number of them that pays is found by counting.
"""

from __future__ import annotations

import numpy as np
import zstandard

#: Bits of the probabilities' scale; states stay between 2^16 and 2^32 and spill 16 bits at a time.
SCALE, LOW = 14, 1 << 16
#: At most so many lanes, each of so many symbols at least, and so many contexts of a model.
LANES, LANE, CONTEXTS = 512, 1024, 4096


def _frequencies(counts: np.ndarray) -> np.ndarray:
    """By context, counts scaled to sum to 2^SCALE, with one at least for each symbol that occurs; contexts without symbols have none."""
    whole = 1 << SCALE
    sums = counts.sum(axis=1, keepdims=True)
    out = np.where(counts > 0, np.maximum(1, counts * whole // np.maximum(sums, 1)), 0)
    some, rows = sums[:, 0] > 0, np.arange(len(out))
    while True:
        over = np.where(some, out.sum(axis=1) - whole, 0)
        if not over.any():
            return out.astype(np.int64)
        top = out.argmax(axis=1)
        out[rows, top] -= np.minimum(over, out[rows, top] - 1)


def _lanes(n: int) -> tuple[int, int]:
    """Number of lanes, and symbols in each but the last ones."""
    lanes = max(1, min(LANES, n // LANE))
    return lanes, -(-n // lanes)


def _places(starts: np.ndarray, n: int) -> np.ndarray:
    """How many symbols stand before each one in its value and its lane."""
    begin = np.zeros(n, np.int64)
    begin[starts[starts < n]] = starts[starts < n]
    begin[:: _lanes(n)[1]] = np.arange(0, n, _lanes(n)[1])
    return np.arange(n) - np.maximum.accumulate(begin)


def _contexts(flat: np.ndarray, places: np.ndarray, order: int, kinds: int) -> np.ndarray:
    out = np.zeros(len(flat), np.int64)
    for k in range(1, order + 1):
        before = np.zeros(len(flat), np.int64)
        before[k:] = flat[:-k]
        out += np.where(places >= k, before, 0) * kinds ** (k - 1)
    return out


def encode(flat: np.ndarray, starts: np.ndarray, kinds: int) -> bytes:
    """flat: numbers under kinds (256 at most); starts: where values begin, which end contexts."""
    n, flat = len(flat), flat.astype(np.int64)
    if not n:
        return b""
    places, best = _places(starts, n), None
    for order in range(9):
        if kinds**order > CONTEXTS or kinds == 1 and order:
            break
        ctx = _contexts(flat, places, order, kinds)
        counts = np.bincount(ctx * kinds + flat, minlength=kinds ** (order + 1)).reshape(-1, kinds)
        with np.errstate(divide="ignore", invalid="ignore"):
            bits = -np.nansum(counts * np.log2(counts / counts.sum(axis=1, keepdims=True))) + 10 * np.count_nonzero(counts)
        if best is None or bits < best[0]:
            best = (bits, order, ctx, counts)
    _, order, ctx, counts = best
    freq = _frequencies(counts)
    start = np.cumsum(freq, axis=1) - freq
    lanes, length = _lanes(n)
    state, words = np.full(lanes, LOW, np.int64), []
    for t in range(length - 1, -1, -1):
        at = np.arange(lanes) * length + t
        at = at[at < n]
        c, s = ctx[at], flat[at]
        f, x = freq[c, s], state[: len(at)]
        spill = x >= f << (32 - SCALE)
        words.append(x[spill].astype("<u2"))
        x = np.where(spill, x >> 16, x)
        state[: len(at)] = ((x // f) << SCALE) + x % f + start[c, s]
    some = np.flatnonzero(freq)
    table = zstandard.compress(np.diff(some, prepend=0).astype("<u4").tobytes() + freq.ravel()[some].astype("<u2").tobytes(), 9)
    head = np.array([n, kinds, order, len(some), len(table)], "<i8").tobytes()
    return head + table + state.astype("<u4").tobytes() + b"".join(w.tobytes() for w in reversed(words))


def decode(data: bytes, starts: np.ndarray) -> np.ndarray:
    """The numbers that encode() had, given the same starts."""
    if not data:
        return np.zeros(0, np.int64)
    n, kinds, order, some, size = np.frombuffer(data, "<i8", 5).tolist()
    table = zstandard.decompress(data[40 : 40 + size])
    freq = np.zeros(kinds ** (order + 1), np.int64)
    freq[np.cumsum(np.frombuffer(table, "<u4", some))] = np.frombuffer(table, "<u2", some, 4 * some)
    freq = freq.reshape(-1, kinds)
    start = np.cumsum(freq, axis=1) - freq
    lanes, length = _lanes(n)
    state = np.frombuffer(data, "<u4", lanes, 40 + size).astype(np.int64)
    words, at_word = np.frombuffer(data, "<u2", -1, 40 + size + 4 * lanes).astype(np.int64), 0
    places, flat = _places(starts, n), np.zeros(n, np.int64)
    for t in range(length):
        at = np.arange(lanes) * length + t
        at = at[at < n]
        c = np.zeros(len(at), np.int64)
        for k in range(1, min(order, t) + 1):
            c += np.where(places[at] >= k, flat[at - k], 0) * kinds ** (k - 1)
        x = state[: len(at)]
        slot = x & ((1 << SCALE) - 1)
        s = (start[c] + freq[c] <= slot[:, None]).sum(axis=1)
        flat[at] = s
        x = freq[c, s] * (x >> SCALE) + slot - start[c, s]
        low = np.flatnonzero(x < LOW)
        x[low] = (x[low] << 16) | words[at_word : at_word + len(low)]
        at_word += len(low)
        state[: len(at)] = x
    return flat
