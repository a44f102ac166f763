"""Bloom filters over 64-bit hashes, filled on the executors, and the two passes that find hashes which may repeat.

A filter sent to the executors has at most MAX_BITS bits, whatever the input; it is loaded only with what was found to repeat, or
with what lies in regions that do. A denser one lets more through; callers settle those exactly. The two passes deal all hashes
to as many parts as their number asks for, each with filters of its own, so they never fill up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from weftline.llm.base import cut, trimmed

#: 32 MB: what a filter takes at most.
MAX_BITS = 1 << 28
#: Bits for each expected hash, and bits set by each.
BITS_EACH, PROBES = 16, 4
#: Segments of a filter; hashes of a part of the two passes, about.
BUCKETS, PART = 256, 1 << 20
_TOP = 8
_SHIFT = np.uint64(64 - _TOP)


class Filter:
    """bits: of all segments, one after another. Segment: the top 8 bits of the hash."""

    def __init__(self, bits: np.ndarray) -> None:
        self.bits = bits

    def __contains__(self, h: int) -> bool:
        return bool(self.test(np.array([h], np.uint64))[0])

    def test(self, h: np.ndarray) -> np.ndarray:
        size = len(self.bits) * 8 // BUCKETS
        return _test(self.bits, (h >> _SHIFT) * np.uint64(size), h, size)


def _test(bits: np.ndarray, base: np.ndarray, h: np.ndarray, size: int) -> np.ndarray:
    a, b = _steps(h)
    alive = np.arange(len(h))
    for k in range(PROBES):
        at = base[alive] + ((a[alive] + np.uint64(k) * b[alive]) & np.uint64(size - 1))
        alive = alive[(bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1]
    out = np.zeros(len(h), bool)
    out[alive] = True
    return out


def _set(bits: np.ndarray, h: np.ndarray, size: int) -> None:
    a, b = _steps(h)
    for k in range(PROBES):
        at = (a + np.uint64(k) * b) & np.uint64(size - 1)
        np.bitwise_or.at(bits, at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))


def _steps(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return h & np.uint64((1 << 56) - 1), (h >> np.uint64(28)) | np.uint64(1)


def _room(rows: int) -> int:
    """Bits for so many hashes, a power of two."""
    return 1 << (max(1, rows) * BITS_EACH - 1).bit_length()


def _packed(bits: int):
    """The different hashes of a task by their top bits, a row for each, and those of them that were there before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[np.ndarray] = []
        for batch in batches:
            seen.append(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
            if sum(map(len, seen)) >= 1_000_000:
                yield pack(np.concatenate(seen))
                seen = []
        if seen:
            yield pack(np.concatenate(seen))

    def pack(h: np.ndarray) -> pa.RecordBatch:
        once, counts = np.unique(h, return_counts=True)
        part = (once >> np.uint64(64 - bits)).astype(np.int64)
        starts = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.zeros(0, np.int64)
        ends = np.append(starts[1:], len(part))
        rows = [(once[a:b], counts[a:b] > 1) for a, b in zip(starts.tolist(), ends.tolist())]
        return pa.RecordBatch.from_arrays([pa.array(part[starts].astype(np.int32)), pa.array([x.tobytes() for x, _ in rows], pa.binary()), pa.array([x[r].tobytes() for x, r in rows], pa.binary())], names=["part", "once", "again"])

    return trimmed(run)


def build(hashes: DataFrame, rows: int) -> Filter:
    """A filter of these hashes (one column of longs), of which there are about so many. The segments are filled by as many tasks and come in one job."""
    bits = min(MAX_BITS, max(BUCKETS * 64, _room(rows)))
    size = bits // BUCKETS

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, once in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if part not in own:
                    own[part] = np.zeros(size // 8, np.uint8)
                _set(own[part], np.frombuffer(once, np.uint64), size)
        yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.int32()), pa.array([x.tobytes() for x in own.values()], pa.binary())], names=["part", "bits"])

    out = np.zeros(bits // 8, np.uint8)
    packed = hashes.mapInArrow(_packed(_TOP), "part int, once binary, again binary").select("part", "once")
    # At most BUCKETS rows, together MAX_BITS bits.
    for part, filled in packed.repartition("part").mapInArrow(trimmed(fill), "part int, bits binary").collect():
        out[part * size // 8 : (part + 1) * size // 8] = np.frombuffer(filled, np.uint8)
    return Filter(out)


def suspects(hashes: DataFrame, rows: int) -> DataFrame:
    """The hashes (one column of longs, about so many) that may be there more than once, each once, as h.

    Each part of the hashes, by their top bits, passes twice: the first pass sets each hash in a filter and, where it was there
    already, in a second one; the second pass gives those that the second filter has.
    """
    parts = 1 << min(16, max(6, (max(1, rows) // PART).bit_length()))

    def passes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, []
        for batch in batches:
            for now, once, again in zip(*(x.to_pylist() for x in batch.columns)):
                if now != part and held:
                    yield both(held)
                    held = []
                part = now
                held.append((np.frombuffer(once, np.uint64), np.frombuffer(again, np.uint64)))
        if held:
            yield both(held)

    def both(held: list) -> pa.RecordBatch:
        size = max(64, _room(sum(len(x) for x, _ in held)))
        first, second = np.zeros(size // 8, np.uint8), np.zeros(size // 8, np.uint8)
        none = lambda h: np.zeros(len(h), np.uint64)
        for once, again in held:
            _set(second, once[_test(first, none(once), once, size)], size)
            _set(second, again, size)
            _set(first, once, size)
        found = np.unique(np.concatenate([once[_test(second, none(once), once, size)] for once, _ in held]))
        return pa.RecordBatch.from_arrays([pa.array(found.view(np.int64))], names=["h"])

    packed = hashes.mapInArrow(_packed(parts.bit_length() - 1), "part int, once binary, again binary")
    return packed.repartition("part").sortWithinPartitions("part").mapInArrow(trimmed(passes), "h long")


def repeating(hashes: DataFrame) -> Filter:
    """A filter of the hashes that two passes find."""
    hashes = cut(hashes)
    again = cut(suspects(hashes, hashes.count()))
    return build(again, again.count())
