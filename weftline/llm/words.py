"""Words of a text as 64-bit hashes, and hashes of runs of words.

A word is a maximal run of bytes other than space and x09-x0D, which is what bytes.split() gives. A word of at most 15 bytes is two
numbers, its bytes and its length, which are compared where words must be the same; its hash mixes both. A longer word's hash is
its XXH3. The hash of a run of words (or of bytes) is the polynomial sum of its members' hashes modulo 2**64, mixed; prefix sums
give those of all runs of a text in a few numpy passes, whatever their length. Hashes choose what is compared, not what is equal.
"""

from __future__ import annotations

import numpy as np
import xxhash

#: Bytes of a text that are hashed at once; bytes of a word that two numbers hold; zeros that short() needs behind the words.
AT_ONCE, SHORT, PAD = 1 << 20, 15, bytes(16)
_BASE = 0x9E3779B97F4A7C15  # odd and 5 modulo 8, so that its powers have the longest period
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, np.int8)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 1
_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)


def hashed(text: bytes) -> np.ndarray:
    """A hash for each word of the text."""
    out, at = [], 0
    while at < len(text):
        end = len(text)
        if end - at > AT_ONCE:
            near = [x for x in (text.find(c, at + AT_ONCE) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c")) if x >= 0]
            end = min(near, default=end)
        out.append(_hashed(text[at:end])[0])
        at = end
    return out[0] if len(out) == 1 else np.concatenate([np.zeros(0, np.uint64), *out])


def together(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, one text after another, and how many words each has: one pass for many short texts."""
    out, counts, k = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    while k < len(texts):
        some, size = k, 0
        while k < len(texts) and (k == some or size + len(texts[k]) <= AT_ONCE):
            size += len(texts[k])
            k += 1
        if size > AT_ONCE:
            out.append(hashed(texts[some]))
            counts.append(np.array([len(out[-1])]))
        else:
            h, starts = _hashed(b" ".join(texts[some:k]))
            begins = np.cumsum([0, *(len(t) + 1 for t in texts[some:k])])
            out.append(h)
            counts.append(np.diff(np.searchsorted(starts, begins)))
    return np.concatenate(out), np.concatenate(counts)


def _hashed(part: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a part's words, and where they start."""
    part += PAD
    data = np.frombuffer(part, np.uint8)
    edges = np.flatnonzero(np.diff(_SPACE[data[: -len(PAD)]], prepend=np.int8(1), append=np.int8(1)))
    starts, ends = edges[::2], edges[1::2]
    h = spread(*short(data, starts, ends - starts))
    for k in np.flatnonzero(ends - starts > SHORT).tolist():
        h[k] = xxhash.xxh3_64_intdigest(part[starts[k] : ends[k]])
    return h, starts


def short(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two numbers for each word, different for different words of at most SHORT bytes: the first eight bytes, and the others and the length. PAD ends the data."""
    eight = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    low = eight[starts] & _LOW[np.minimum(sizes, 8)]
    return low, (eight[starts + 8] & _LOW[np.clip(sizes - 8, 0, 7)]) | (sizes.astype(np.uint64) << np.uint64(56))


def spread(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """A hash of both."""
    return mixed(mixed(low) + high * np.uint64(_BASE))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n - 1 at least of the base and of its inverse."""
    global _powers
    if len(_powers[0]) < n:
        size = 1 << max(12, n.bit_length())
        with np.errstate(over="ignore"):
            _powers = tuple(np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, x, np.uint64))]) for x in (_BASE, _INVERSE))
    return _powers


def sums(values: np.ndarray) -> np.ndarray:
    """Prefix sums, one longer than the values."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(len(values))[0][: len(values)], out=out[1:])
    return out


def runs(prefix: np.ndarray, length: int, at: np.ndarray | None = None) -> np.ndarray:
    """Hashes of the runs of this length that start at the given places, or at each place."""
    n = len(prefix) - length
    if n <= 0:
        return np.zeros(0, np.uint64)
    if at is None:
        return mixed((prefix[length:] - prefix[:n]) * powers(n)[1][:n])
    return mixed((prefix[at + length] - prefix[at]) * powers(len(prefix))[1][at])


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread every input bit over the word."""
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


#: Bits of a place in lowest(), whose other bits are the hash's upper ones; places looked at together.
_PLACE, _TOGETHER = 24, 1 << 22


def lowest(h: np.ndarray, width: int, live: np.ndarray | None = None) -> np.ndarray:
    """For each `width` successive hashes the place of the smallest by its upper 40 bits, the leftmost of equals: of the live ones, -1 where there are none."""
    out = []
    for k in range(0, max(0, len(h) - width + 1), _TOGETHER):
        some = h[k : k + _TOGETHER + width - 1]
        low = key = (some >> np.uint64(_PLACE) << np.uint64(_PLACE)) | np.arange(len(some), dtype=np.uint64)
        if live is not None:
            low = np.where(live[k : k + len(some)], low, ~np.uint64(0))
        span, n = 1, len(key) - width + 1
        while span * 2 <= width:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        if span < width:
            low = np.minimum(low[:n], low[width - span : width - span + n])
        at = (low & np.uint64((1 << _PLACE) - 1)).astype(np.int64) + k
        out.append(at if live is None else np.where(low == ~np.uint64(0), -1, at))
    return np.concatenate([np.zeros(0, np.int64), *out])


def stretches(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of each run of windows with one anchor; windows without an anchor (-1) are in none."""
    if not len(at):
        return at, at
    new = np.flatnonzero(at[1:] != at[:-1]) + 1
    first, last = np.append(0, new), np.append(new - 1, len(at) - 1)
    return first[at[first] >= 0], last[at[first] >= 0]
