"""Token ids of whole texts by the tokenizers library, with a table of known words.

Byte-level BPE cuts a text before it merges, and never between a space and the word behind it. A text whose white space is
single spaces and single line ends between words is therefore the concatenation of its words' ids, each word with the space or
line end in front of it. Words are looked up many texts at once in numpy; only words not met before go to the library: letters,
with signs behind them, to its model, any others as text. Texts with other white space go to the library as they are.

Two words are one if all their bytes are: those of at most 15 bytes are found by a hash and compared as two numbers that hold
them, longer ones, and any that share a hash with another, are looked up by their bytes.
"""

from __future__ import annotations

import os
from array import array

import numpy as np
from tokenizers import Tokenizer

from weftline.llm.base import claim
from weftline.llm.words import PAD, SHORT, short, spread

# A Spark task has one core; the library's own threads would only contend for it.
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
#: Words in the table of one Python worker, some 30 MB, stems kept beside it, and ids and bytes of long words from which it is made anew.
KNOWN, STEMS, POOL, LONG = 600_000, 50_000, 8_000_000, 4_000_000
#: Words that wait to be merged into the table; bytes of texts at once; unknown words in one text for the library.
WAITING, AT_ONCE, TOGETHER = 100_000, 1 << 18, 100
#: Signs that may end a word and are a cut of their own there.
_SIGNS = ".,;:!?)]}|*#%&$"
#: What a byte is: a space or line end (1), perhaps other white space or the start of it (2), neither (0).
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x0A]] = 1
_KIND[[0x09, 0x0B, 0x0C, 0x0D, 0x1C, 0x1D, 0x1E, 0x1F, 0xC2, 0xE1, 0xE2, 0xE3]] = 2
_known: dict[str, "Encoder"] = {}


class _Letters(dict):
    """A sign's bytes as the model has them, by the sign's number; each is found when first met."""

    def __init__(self, by_byte: dict[int, int]) -> None:
        self.by_byte = by_byte

    def __missing__(self, sign: int) -> str:
        out = self[sign] = "".join(chr(self.by_byte.get(b, b)) for b in chr(sign).encode())
        return out


class Encoder:
    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.line = self._plain("\n")
        self.forget()
        self.stems: dict[str, bytes] = {}
        # Bytes as the model has them: the printable ones of Latin-1 as they are, the others from 256 on.
        kept = [b for b in range(256) if chr(b).isprintable() and b not in (32, 160, 173)]
        others = [b for b in range(256) if b not in kept]
        self.letters = _Letters({b: 256 + k for k, b in enumerate(others)})
        self.model = self.tokenizer.model
        # The short cut holds for byte-level BPE only; any other tokenizer encodes whole texts.
        self.by_words = "ByteLevel" in str(type(self.tokenizer.pre_tokenizer)) and self.tokenizer.normalizer is None and len(self.line) == 4

    def _plain(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def forget(self) -> None:
        """Words by hash, sorted, with their two numbers; where their ids begin in the pool, and how many there are. The same of those that wait."""
        self.table = [np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32)]
        self.waiting = [x[:0] for x in self.table]
        self.long: dict[bytes, tuple[int, int]] = {}
        self.long_bytes = 0
        self.pool = np.zeros(1 << 16, np.uint32)
        self.filled = 0

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """Little-endian 32-bit ids of each text."""
        out: list[list[np.ndarray] | None] = [[] for _ in texts]
        held: list[tuple[int, bool, bytes]] = []
        size = 0
        for k, text in enumerate(texts):
            if not self.by_words or any(s in text for s in self.specials):
                out[k] = None
                continue
            for first, part in _parts(text.encode()):
                held.append((k, first, part))
                size += len(part)
            if size >= AT_ONCE:
                self._words(held, out)
                held, size = [], 0
        if held:
            self._words(held, out)
        return [np.frombuffer(self._plain(t), "<u4") if x is None else x[0] if len(x) == 1 else np.concatenate([np.zeros(0, np.uint32), *x]) for t, x in zip(texts, out)]

    def _words(self, parts: list[tuple[int, bool, bytes]], out: list) -> None:
        """Ids of parts of texts, into out; None for a text that isn't just words between single spaces and line ends."""
        if len(self.table[0]) + len(self.waiting[0]) > KNOWN or self.filled > POOL or self.long_bytes > LONG:
            self.forget()
        # A text's first word gets a line end in front, whose id is left out again.
        whole = b"".join([*(b"\n" + p if first else p for _, first, p in parts), PAD])
        padded = np.frombuffer(whole, np.uint8)
        kind = _KIND[padded[: -len(PAD)]]
        starts = np.flatnonzero(kind == 1)
        ends = np.append(starts[1:], len(kind))
        sizes = ends - starts
        begins = np.cumsum([0, *(len(p) + first for _, first, p in parts)])
        at = np.searchsorted(starts, begins)  # each part's words
        bad = np.zeros(len(parts), bool)
        bad[np.searchsorted(begins, starts[sizes < 2], "right") - 1] = True
        odd = [i for i in np.flatnonzero(kind == 2).tolist() if whole[i : i + 3].decode("utf-8", "ignore")[:1].isspace()]
        bad[np.searchsorted(begins, odd, "right") - 1] = True
        for j in np.flatnonzero(bad).tolist():
            out[parts[j][0]] = None
        fine = np.repeat(~bad, np.diff(at))
        low, high = short(padded, starts, sizes)
        h = spread(low, high)
        begin, count = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int32)
        plain = np.flatnonzero(fine & (sizes <= SHORT))
        some, index, inverse = np.unique(h[plain], return_index=True, return_inverse=True)
        one = plain[index]
        found, n = self._found(some, low[one], high[one], lambda new: [whole[a:b].decode() for a, b in zip(starts[one[new]].tolist(), ends[one[new]].tolist())])
        begin[plain], count[plain] = found[inverse], n[inverse]
        # Words that share their hash with another, here or in the table, are looked up by their bytes, as long ones are.
        other = (low[plain] != low[one][inverse]) | (high[plain] != high[one][inverse]) | (count[plain] < 0)
        for k, where in zip(*self._by_bytes(whole, starts, ends, np.concatenate([np.flatnonzero(fine & (sizes > SHORT)), plain[other]]))):
            begin[k], count[k] = where
        upto = np.concatenate([[0], np.cumsum(count, dtype=np.int64)])
        ids = self.pool[np.repeat(begin - upto[:-1], count) + np.arange(upto[-1])]
        for j, (k, first, _) in enumerate(parts):
            if out[k] is not None and not bad[j]:
                out[k].append(ids[upto[at[j]] + first : upto[at[j + 1]]])

    def _found(self, hashes: np.ndarray, low: np.ndarray, high: np.ndarray, words) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of these words are in the pool, and how many, -2 where another word has the hash; words(new) gives those that aren't known."""
        begin, count = np.zeros(len(hashes), np.int64), np.full(len(hashes), -1, np.int32)
        for known, lows, highs, b, c in (self.table, self.waiting):
            if len(known):
                at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                there = known[at] == hashes
                same = there & (lows[at] == low) & (highs[at] == high)
                begin[same], count[same] = b[at[same]], c[at[same]]
                count[there & ~same] = -2
        new = np.flatnonzero(count == -1)
        if len(new):
            begin[new], count[new] = self._pooled(self._learn(words(new)))
            self.waiting = self._merged(self.waiting, [hashes[new], low[new], high[new], begin[new], count[new]])
            if len(self.waiting[0]) > WAITING:
                self.table, self.waiting = self._merged(self.table, self.waiting), [x[:0] for x in self.table]
        return begin, count

    def _by_bytes(self, whole: bytes, starts: np.ndarray, ends: np.ndarray, some: np.ndarray) -> tuple[list[int], list[tuple[int, int]]]:
        """The words of these numbers, and where the ids of each are in the pool and how many."""
        words = [whole[a:b] for a, b in zip(starts[some].tolist(), ends[some].tolist())]
        new = [w for w in dict.fromkeys(words) if w not in self.long]
        if new:
            self.long.update(zip(new, zip(*(x.tolist() for x in self._pooled(self._learn([w.decode() for w in new]))))))
            self.long_bytes += sum(map(len, new))
        return some.tolist(), [self.long[w] for w in words]

    def _pooled(self, learnt: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words put into the pool: where each word's begin, and how many there are."""
        sizes = np.array([len(x) // 4 for x in learnt], np.int32)
        ids = np.frombuffer(b"".join(learnt), np.uint32)
        while self.filled + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.filled : self.filled + len(ids)] = ids
        begin = self.filled + np.cumsum(sizes, dtype=np.int64) - sizes
        self.filled += len(ids)
        return begin, sizes

    @staticmethod
    def _merged(a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
        at = np.searchsorted(a[0], b[0])
        return [np.insert(x, at, y) for x, y in zip(a, b)]

    def _learn(self, words: list[str]) -> list[bytes]:
        """Ids of words with the space or line end in front."""
        if len(self.stems) > STEMS:
            self.stems.clear()
        out: list[bytes | None] = []
        for w in words:
            stem = w.rstrip(_SIGNS)
            if stem[1:].isalpha():
                ids = self._stem(stem) if w[0] == " " else self.line + self._stem(stem[1:])
                out.append(ids + self._stem(w[len(stem) :]) if len(stem) < len(w) else ids)
            else:
                out.append(None)
        rest = [k for k, x in enumerate(out) if x is None]
        for k, x in zip(rest, self._learn_whole([words[k] for k in rest])):
            out[k] = x
        return out

    def _stem(self, cut: str) -> bytes:
        """Ids of what byte-level BPE doesn't cut."""
        found = self.stems.get(cut)
        if found is None:
            found = self.stems[cut] = array("I", [t.id for t in self.model.tokenize(cut.translate(self.letters))]).tobytes()
        return found

    def _learn_whole(self, words: list[str]) -> list[bytes]:
        line = np.frombuffer(self.line, "<u4")[0]
        groups = [words[k : k + TOGETHER] for k in range(0, len(words), TOGETHER)]
        texts = ["".join(w if w[0] == "\n" else "\n" + w for w in some) for some in groups]
        out: list[bytes] = []
        for some, got in zip(groups, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
            ids = np.array(got.ids, "<u4")
            starts = np.flatnonzero(ids == line)
            if len(starts) == len(some):
                whole, at = ids.tobytes(), [*(starts * 4).tolist(), len(ids) * 4]
                out += [whole[a + 4 * (w[0] != "\n") : b] for w, a, b in zip(some, at, at[1:])]
            else:
                out += map(self._plain, some)
        return out


def _parts(text: bytes):
    """A long text in parts that begin with a space or line end; whether a part is the first."""
    at, first = 0, True
    while at < len(text):
        end = len(text)
        if end - at > AT_ONCE:
            near = [x for x in (text.find(b" ", at + AT_ONCE), text.find(b"\n", at + AT_ONCE)) if x >= 0]
            end = min(near, default=end)
        yield first, text[at:end]
        at, first = end, False


def encoder(path: str) -> Encoder:
    """One for each file and Python worker, kept from task to task."""
    claim("tokens", _known.clear)
    if path not in _known:
        _known[path] = Encoder(path)
    return _known[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
