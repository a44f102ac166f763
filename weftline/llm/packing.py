"""Vector bin packing of examples into training sequences.

A sequence holds at most `tokens` tokens, `segments` pieces and `loss` loss-bearing tokens. Each piece is a vector of what
it takes of the three, as shares of the limits; it goes to the open sequence whose remaining room has the largest dot
product with it, among those where it fits. Where none has room and `open` sequences are, the piece is cut so that the
fullest one closes without padding. Each task packs its own rows, in order, and holds only the open sequences: nothing moves.

Of a document, all tokens bear loss but the first, which nothing in it precedes. With a limit of one less than the tokens, a
full sequence has room for a document's beginning, and the three limits weigh against each other.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm import tokens as tok
from weftline.llm.base import arrow_types, to_batch, trimmed


@dataclass(frozen=True)
class Limits:
    tokens: int = 1024
    segments: int = 64
    loss: int = 1023
    open: int = 32


@dataclass
class Piece:
    key: object
    start: int
    length: int
    bears: int
    offset: int = 0
    before: np.ndarray | None = field(default=None, repr=False, compare=False)


@dataclass
class Sequence:
    pieces: list[Piece] = field(default_factory=list)
    used: int = 0
    bears: int = 0


class Packer:
    """add() and close() give the sequences that are complete."""

    def __init__(self, limits: Limits = Limits()) -> None:
        self.limits, self.open = limits, []
        self.room = np.zeros((limits.open, 3), np.float64)

    def add(self, key: object, length: int, mask: np.ndarray | None = None) -> Iterator[Sequence]:
        """An example of so many tokens; mask: which bear loss, all if there is none."""
        before = None if mask is None else np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        at = 0
        while at < length:
            n, b = self._cut(before, at, length - at, self.limits.tokens, self.limits.loss)
            if n == self.limits.tokens:
                yield Sequence([Piece(key, at, n, b)], n, b)
            else:
                n, b, done = self._place(key, before, at, n, b)
                if done:
                    yield done
            at += n

    def _cut(self, before: np.ndarray | None, at: int, left: int, most: int, most_loss: int) -> tuple[int, int]:
        """The longest piece from here within so many tokens and loss-bearing ones."""
        n = min(left, most)
        if before is None:
            n = min(n, most_loss)
            return n, n
        n = min(n, int(np.searchsorted(before, before[at] + most_loss, "right")) - 1 - at)
        return n, int(before[at + n] - before[at])

    def _place(self, key: object, before: np.ndarray | None, at: int, n: int, b: int) -> tuple[int, int, Sequence | None]:
        limits = self.limits
        k = len(self.open)
        if k:
            room, need = self.room[:k], np.array([n, 1, b], np.float64)
            fits = (room >= need).all(1)
            if fits.any():
                scale = np.array([limits.tokens, limits.segments, limits.loss], np.float64)
                return n, b, self._put(int(np.argmax(np.where(fits, (room / scale) @ (need / scale), -1))), Piece(key, at, n, b, before=before))
        if k < limits.open:
            self.open.append(Sequence())
            self.room[k] = limits.tokens, limits.segments, limits.loss
            return n, b, self._put(k, Piece(key, at, n, b, before=before))
        # All are open and none has room: fill the fullest one to the end.
        full = int(np.argmin(self.room[:, 0]))
        n, b = self._cut(before, at, n, int(self.room[full, 0]), int(self.room[full, 2]))
        if n:
            return n, b, self._put(full, Piece(key, at, n, b, before=before)) or (self._take(full) if self.room[full].min() <= 0 else None)
        return 0, 0, self._take(full)

    def _put(self, k: int, piece: Piece) -> Sequence | None:
        s = self.open[k]
        piece.offset = s.used
        s.pieces.append(piece)
        s.used += piece.length
        s.bears += piece.bears
        self.room[k] -= piece.length, 1, piece.bears
        return self._take(k) if self.room[k, 0] <= 0 or self.room[k, 1] <= 0 else None

    def _take(self, k: int) -> Sequence:
        out, last = self.open[k], len(self.open) - 1
        self.open[k], self.room[k] = self.open[last], self.room[last]
        self.open.pop()
        return out

    def close(self) -> Iterator[Sequence]:
        """What is open, packed anew: full sequences, then ones whose lengths are powers of two, which take no padding."""
        limits = self.limits
        rest = sorted((p for s in self.open for p in s.pieces), key=lambda p: -p.length)
        self.open = []
        left = sum(p.length for p in rest)
        now, aim = Sequence(), 0
        for p in rest:
            at = 0
            while at < p.length:
                if not now.pieces:
                    aim = min(limits.tokens, 1 << (left.bit_length() - 1))
                n, b = self._cut(p.before, p.start + at, p.length - at, aim - now.used, limits.loss - now.bears)
                if n:
                    now.pieces.append(Piece(p.key, p.start + at, n, b, now.used))
                    now.used += n
                    now.bears += b
                    at += n
                    left -= n
                if not n or now.used == aim or len(now.pieces) == limits.segments:
                    yield now
                    now = Sequence()
        if now.pieces:
            yield now


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
NAMES = [x.split()[0] for x in SCHEMA.split(", ")]


class _Rows:
    """Columns of the pieces of closed sequences. An example's ids are held while one of its pieces is open."""

    def __init__(self, limits: Limits) -> None:
        self.packer, self.limits = Packer(limits), limits
        self.base, self.n = TaskContext.get().partitionId() << 33, 0
        self.ids: dict[int, tuple] = {}
        self.seen = 0

    def add(self, out: dict, doc_id: int | None, ids: np.ndarray, mask: np.ndarray | None = None) -> None:
        self.seen += 1
        self.ids[self.seen] = doc_id, ids
        for s in self.packer.add(self.seen, len(ids), mask):
            self._emit(out, s)
        if self.seen % 64 == 0:
            alive = {p.key for x in self.packer.open for p in x.pieces}
            self.ids = {k: v for k, v in self.ids.items() if k in alive}

    def close(self, out: dict) -> None:
        for s in self.packer.close():
            self._emit(out, s)

    def _emit(self, out: dict, s: Sequence) -> None:
        for p in s.pieces:
            doc_id, ids = self.ids[p.key]
            row = (doc_id, p.start, p.length, zlib.crc32(ids[p.start : p.start + p.length].tobytes()), len(ids), self.base + self.n, p.offset)
            for name, x in zip(NAMES, row):
                out[name].append(x)
        self.n += 1


def _new() -> dict[str, list]:
    return {n: [] for n in NAMES}


def pack(docs: DataFrame, path: str | None = None, end: int = 0, limits: Limits = Limits()) -> DataFrame:
    """All documents as pieces of sequences, one row a piece.

    A document is its ids by the tokenizer and the id `end`; all but the first bear loss. start: its ids before the piece; ids_crc32:
    of the piece's ids as little-endian 32-bit integers; doc_tokens: its ids in all; sequence_id and offset: where the piece
    stands. A null text is an empty one, which is its end alone. Rows that repeat a doc_id, or have none, are each packed; an
    empty table gives no pieces; other columns are ignored.
    """
    path = path or tok.default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, types, last = _Rows(limits), arrow_types(SCHEMA), np.array([end], "<u4")
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                out = _new()
                some = batch.slice(k, 500)
                for doc_id, ids in zip(some.column(0).to_pylist(), tok.encoder(path).ids(some.column(1).to_pylist())):
                    rows.add(out, doc_id, np.concatenate([ids, last]), np.arange(len(ids) + 1) > 0)
                yield to_batch(out, NAMES, types)
        out = _new()
        rows.close(out)
        yield to_batch(out, NAMES, types)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).mapInArrow(trimmed(run), SCHEMA)


def pack_conversations(turns: DataFrame, path: str | None = None, end: int = 0, limits: Limits = Limits(segments=16, loss=768)) -> DataFrame:
    """Conversations (conv_id, turn, role, text) as examples whose loss-bearing tokens are those of role assistant.

    Columns as pack(), doc_id being the conv_id. A turn's end bears loss as its text does. Null roles bear none, null texts are
    empty, turns with equal or null numbers stand in the order of role and text; those of a null conv_id are one conversation. A
    conversation is one row in one task. An empty table gives no pieces; other columns are ignored.
    """
    path = path or tok.default_path()
    told = F.to_json(F.transform(F.array_sort(F.collect_list(F.struct(F.coalesce("turn", F.lit(-1)).alias("t"), F.coalesce("role", F.lit("")).alias("r"), F.coalesce("text", F.lit("")).alias("x")))), lambda x: F.array(x["r"], x["x"])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, types, last = _Rows(limits), arrow_types(SCHEMA), np.array([end], "<u4")
        for batch in batches:
            out = _new()
            for conv_id, said in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                roles, texts = zip(*json.loads(said))
                parts = [np.concatenate([x, last]) for x in tok.encoder(path).ids(list(texts))]
                mask = np.concatenate([np.full(len(x), r == "assistant") for r, x in zip(roles, parts)])
                rows.add(out, conv_id, np.concatenate(parts), mask)
            yield to_batch(out, NAMES, types)
        out = _new()
        rows.close(out)
        yield to_batch(out, NAMES, types)

    return turns.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(told.alias("said")).mapInArrow(run, SCHEMA)
