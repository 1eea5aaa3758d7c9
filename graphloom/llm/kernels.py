"""Vectorised text kernels over Arrow batches: tokens, hashes and windows.

Every kernel works on a *block*: the UTF-8 bytes of some whole texts laid end
to end plus their offsets.  A block holds at most ``BLOCK_BYTES`` unless one
text alone is longer, so a worker's memory follows the longest text and not
the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 20
U64 = np.uint64
_MULT = 0xD6E8FEB86659FD95  # odd, 5 modulo 8: its powers have full order
_MASK = (1 << 64) - 1
_INV = pow(_MULT, -1, 1 << 64)
BYTE_CODES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)


def _lut(member) -> np.ndarray:
    return np.fromiter((bool(member(b)) for b in range(256)), bool, 256)


#: Bytes inside a white-space separated word, ``[^\x20\x09-\x0D]+``.
SPACE_WORD = _lut(lambda b: not (b == 0x20 or 0x09 <= b <= 0x0D))
#: Bytes inside ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of a lower-cased text.
ALNUM_WORD = _lut(lambda b: b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A)
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)

_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse, grown on demand."""
    global _powers, _inverses
    if len(_powers) < n:
        size = max(n, BLOCK_BYTES + 1)
        with np.errstate(over="ignore"):
            up = np.full(size, U64(_MULT))
            up[0] = 1
            down = np.full(size, U64(_INV))
            down[0] = 1
            _powers, _inverses = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
    return _powers, _inverses


def power(n: int) -> np.uint64:
    return U64(pow(_MULT, n, 1 << 64))


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise so that every bit depends on every bit; a bijection."""
    h = h ^ (h >> U64(32))
    h *= U64(0x9FB21C651E98DF25)
    h ^= h >> U64(29)
    h *= U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(32)
    return h


def text_array(column) -> pa.LargeStringArray:
    """The column as large strings, null as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    return pc.fill_null(column, "") if column.null_count else column


def raw_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a text column without copying the text."""
    arr = text_array(column)
    _, offs, data = arr.buffers()
    off = np.frombuffer(offs, np.int64)[arr.offset : arr.offset + len(arr) + 1] if len(arr) else np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf, off


def blocks(column, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) for consecutive runs of whole texts."""
    buf, off = raw_bytes(column)
    n, lo = len(off) - 1, 0
    while lo < n:
        hi = min(n, max(lo + 1, int(np.searchsorted(off, off[lo] + limit, side="right")) - 1))
        yield lo, hi, buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def tokens(buf: np.ndarray, off: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, offsets by text) of the maximal runs of ``inside`` bytes."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    word = inside[buf]
    edge = np.zeros(n + 1, bool)  # a text begins here
    edge[off] = True
    opens = word.copy()
    opens[1:] &= ~word[:-1] | edge[1:n]
    closes = word.copy()
    closes[:-1] &= ~word[1:] | edge[1:n]
    starts = np.flatnonzero(opens)
    return starts, np.flatnonzero(closes) + 1, np.searchsorted(starts, off)


def prefix_sums(buf: np.ndarray) -> np.ndarray:
    """Running sums from which ``span_hashes`` reads the hash of any byte span."""
    _, down = _power_tables(len(buf) + 1)
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(BYTE_CODES[buf] * down[: len(buf)], out=out[1:])
    return out


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span; the length takes part."""
    up, _ = _power_tables(len(sums))
    return mix((sums[ends] - sums[starts]) * up[starts] + (ends - starts).astype(np.uint64) * U64(0x9E3779B97F4A7C15))


def window_hashes(codes: np.ndarray, width: int) -> np.ndarray:
    """Hash of every ``width`` consecutive codes (length n - width + 1), unmixed."""
    if len(codes) < width:
        return np.zeros(0, np.uint64)
    out, done, step, size = None, 0, codes, 1
    while size <= width:
        if width & size:
            if out is None:
                out = step
            else:
                m = min(len(out), len(step) - done)
                out = out[:m] * power(size) + step[done : done + m]
            done += size
        if size * 2 <= width:
            step = step[:-size] * power(size) + step[size:]
        size *= 2
    return out[: len(codes) - width + 1]


def inside_windows(token_off: np.ndarray, width: int) -> np.ndarray:
    """Starts of the windows of ``width`` tokens that lie within one text."""
    count = np.maximum(np.diff(token_off) - width + 1, 0)
    total = int(count.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.repeat(token_off[:-1] - (np.cumsum(count) - count), count)
    return np.arange(total, dtype=np.int64) + shift


def covered(n: int, starts: np.ndarray, widths) -> np.ndarray:
    """Mask of the positions below ``n`` inside any [start, start + width)."""
    delta = np.zeros(n + 1, np.int64)
    np.add.at(delta, starts, 1)
    np.add.at(delta, starts + widths, -1)
    return np.cumsum(delta[:n]) > 0


def sums_by_text(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sum of ``values`` within each text."""
    run = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=run[1:])
    return run[off[1:]] - run[off[:-1]]


def minimum_over(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values."""
    step, size = values, 1
    while size * 2 <= width:
        step = np.minimum(step[:-size], step[size:])
        size *= 2
    if size < width:
        rest = width - size
        step = np.minimum(step[: len(step) - rest], step[rest:])
    return step


def repeated(keys: np.ndarray) -> np.ndarray:
    """Mask of the keys that occur at least twice."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    same = np.zeros(len(keys) + 1, bool)
    same[1:-1] = ranked[1:] == ranked[:-1]
    out = np.empty(len(keys), bool)
    out[order] = same[1:] | same[:-1]
    return out
