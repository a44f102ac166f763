"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Labels are of documents; a token's label is induced from them. A feature (a word, or its first 4, 5 or 6 letters) marks toxic
tokens if the labelled documents that hold it are toxic far more often than others, beyond chance, and are enough of these.
A chain of two states is trained on segments of tokens with these labels; emissions are of the marking features, all other
tokens share one. Forward-backward marginals of a document's tokens aggregate to its score, through a logistic of how likely
any token is toxic and of how many, and how many in a hundred, are expected to be. Labels, language, source and ids are never inputs of a score.

Between marking tokens the chain passes a power of one 2 x 2 matrix, which is closed, so the marginals of a text cost as many
steps as it has marking tokens.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf

from weftline.llm.base import claim, raw, sliced, trimmed

#: Labelled documents that a model is fitted on at most, those of the smallest hashes of their ids.
SAMPLE = 3000
#: Toxic documents that hold a marking feature at least; how much more often its documents are toxic; chance features allowed.
SUPPORT, LIFT, CHANCE = 3, 3.0, 0.01
#: Segments with a marking token that the chain is trained on, those of the smallest hashes, and some of each feature beyond them.
SEGMENTS, EACH = 8000, 5
PREFIXES, SEGMENT = (4, 5, 6), 48
_STRIP = b".,;:!?\"'()[]{}<>|/\\-_*#$%&+=~`"
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def features(word: bytes) -> list[str]:
    w = word.strip(_STRIP).decode("utf-8", "replace").lower()
    return ["=" + w, *(w[:k] for k in PREFIXES if len(w) >= k)] if w else []


@dataclass
class Model:
    """emit: weight of each marking feature; other: of any other token; trans[a, b]: from state a to b; doc: weights of the aggregates."""

    emit: dict[str, float]
    other: float
    trans: np.ndarray
    doc: np.ndarray

    def prepare(self) -> "Scorer":
        return Scorer(self)


class Scorer:
    def __init__(self, model: Model) -> None:
        self.model = model
        self.step = np.exp(model.trans)
        # One neutral token: from a to b, then its emission in b.
        neutral = self.step * np.exp([0.0, model.other])
        values, vectors = np.linalg.eig(neutral)
        order = np.argsort(-values.real)
        self.ratio = float(values.real[order[1]] / values.real[order[0]])
        vectors = vectors.real[:, order]
        inverse = np.linalg.inv(vectors)
        self.top, self.rest = np.outer(vectors[:, 0], inverse[0]), np.outer(vectors[:, 1], inverse[1])
        self.powers: dict[int, tuple] = {}
        self.known: dict[bytes, float] = _Weights(self)

    def power(self, n: int) -> tuple[float, float, float, float]:
        """n neutral tokens, up to a factor."""
        n = min(n, 200)  # beyond, the ratio's power is nil
        if n not in self.powers:
            m = self.top + self.rest * self.ratio**n
            self.powers[n] = tuple((m / m.sum()).ravel().tolist())
        return self.powers[n]

    def marginals(self, text: bytes) -> tuple[list[int], list[float], int]:
        """Places of the marking tokens, the probability that each is toxic, and the number of tokens."""
        words = text.split()
        w = np.fromiter(map(self.known.__getitem__, words), np.float64, len(words))
        at = np.flatnonzero(~np.isnan(w))
        if not len(at):
            return [], [], len(words)
        emit = np.exp(np.clip(w[at], -30, 30)).tolist()
        places = at.tolist()
        step = tuple(self.step.ravel().tolist())
        a = (1.0, 1.0)
        forward, gaps = [], []
        last = -1
        for p, e in zip(places, emit):
            m = self.power(p - last - 1)
            gaps.append(m)
            a = a[0] * m[0] + a[1] * m[2], a[0] * m[1] + a[1] * m[3]
            a = a[0] * step[0] + a[1] * step[2], (a[0] * step[1] + a[1] * step[3]) * e
            total = a[0] + a[1]
            a = a[0] / total, a[1] / total
            forward.append(a)
            last = p
        m = self.power(len(words) - 1 - last)
        b = m[0] + m[1], m[2] + m[3]
        out = [0.0] * len(places)
        for k in range(len(places) - 1, -1, -1):
            f = forward[k]
            x, y = f[0] * b[0], f[1] * b[1]
            out[k] = y / (x + y)
            b = b[0], b[1] * emit[k]
            b = step[0] * b[0] + step[1] * b[1], step[2] * b[0] + step[3] * b[1]
            m = gaps[k]
            b = m[0] * b[0] + m[1] * b[1], m[2] * b[0] + m[3] * b[1]
            total = b[0] + b[1]
            b = b[0] / total, b[1] / total
        return places, out, len(words)

    def score(self, text: bytes) -> tuple[float, list[int], list[float]]:
        places, p, n = self.marginals(text)
        z = float(np.clip(self.model.doc @ aggregates(p, n), -50, 50))
        return 1 / (1 + float(np.exp(-z))), places, p


class _Weights(dict):
    """A word's emission weight, NaN for one without a marking feature."""

    def __init__(self, scorer: Scorer) -> None:
        self.emit = scorer.model.emit

    def __missing__(self, word: bytes) -> float:
        found = [self.emit[f] for f in features(word) if f in self.emit]
        if len(self) > 200_000:
            self.clear()
        value = self[word] = sum(found) if found else float("nan")
        return value


def aggregates(p: list[float], n: int) -> np.ndarray:
    """1, the probability that any token is toxic, and the logarithms of 1 and the expected number, and of 1 and that in a hundred tokens."""
    some = np.array(p)
    return np.array([1.0, 1 - np.exp(np.log1p(-np.minimum(some, 1 - 1e-12)).sum()) if p else 0.0, np.log1p(some.sum()), np.log1p(100 * some.sum() / max(1, n))])


def marking(texts: list[bytes], toxic: np.ndarray) -> set[str]:
    """Features that mark toxic tokens. Only features with support among the toxic documents are counted in the others."""
    share = float(toxic.mean()) if len(toxic) else 0.0
    held = lambda t: {f for w in set(t.split()) for f in features(w)}
    pos = Counter(f for t, y in zip(texts, toxic) if y for f in held(t))
    pos = {f: k for f, k in pos.items() if k >= SUPPORT}
    neg = Counter(f for t, y in zip(texts, toxic) if not y for f in held(t) if f in pos)
    total = (1 + len(PREFIXES)) * len({w for t in texts for w in set(t.split())})  # features at most

    def beyond(k: int, m: int) -> bool:
        """Whether k toxic documents of m are too many for chance: Chernoff's bound, for all features together."""
        q = k / m
        told = q * np.log(q / share) + ((1 - q) * np.log((1 - q) / (1 - share)) if q < 1 else 0.0)
        return total * np.exp(-m * told) < CHANCE

    return {f for f, k in pos.items() if share < 1 and k >= min(0.9, LIFT * share) * (k + neg[f]) and beyond(k, k + neg[f])}


def train(texts: list[bytes], toxic: list[int], rounds: int = 60) -> Model:
    y = np.array(toxic, bool)
    marks = marking(texts, y)
    names = sorted(marks)
    index = {f: k for k, f in enumerate(names)}
    # Segments with a marking token, and as many without; a token of a toxic document that has a mark is toxic.
    found: list[tuple[int, list[list[int]], list[int]]] = []
    spare: list[tuple[int, list[list[int]], list[int]]] = []
    own: dict[bytes, list[int]] = {}
    for d, (text, t) in enumerate(zip(texts, y)):
        ws = text.split()
        for w in set(ws):
            if w not in own:
                own[w] = [index[f] for f in features(w) if f in index]
        own = {w: fs for w, fs in own.items() if fs} if len(own) > 100_000 else own
        for k in range(0, len(ws), SEGMENT):
            fs = [own.get(w, []) for w in ws[k : k + SEGMENT]]
            (found if any(fs) else spare).append((zlib.crc32(f"{d} {k}".encode()), fs, [int(bool(x) and bool(t)) for x in fs]))
    held: Counter[int] = Counter()
    segments = []
    for k, (_, fs, truth) in enumerate(sorted(found, key=lambda x: x[0])):
        some = {f for x in fs for f in x}
        if k < SEGMENTS or any(held[f] < EACH for f in some):
            held.update(some)
            segments.append((fs, truth))
    segments += [(fs, truth) for _, fs, truth in sorted(spare, key=lambda x: x[0])[: max(50, len(segments))]]
    emit, other, trans = _fit(segments, len(names), rounds)
    model = Model(dict(zip(names, emit.tolist())), other, trans, np.zeros(4))
    scorer = model.prepare()
    x = np.array([aggregates(*scorer.marginals(t)[1:]) for t in texts]).reshape(-1, 4)
    model.doc = _logistic(x, y.astype(float))
    return model


def _fit(segments: list, n: int, rounds: int) -> tuple[np.ndarray, float, np.ndarray]:
    """Gradient ascent with momentum scaled by coordinate on the log-likelihood, with a quadratic penalty."""
    emit, other, trans = np.zeros(n), 0.0, np.zeros((2, 2))
    if not segments:
        return emit, -3.0, trans
    length, size = max(len(y) for _, y in segments), len(segments)
    live, gold = np.zeros((size, length), bool), np.zeros((size, length), int)
    rows, cols, fs = [], [], []
    for i, (tokens, y) in enumerate(segments):
        live[i, : len(y)] = True
        gold[i, : len(y)] = y
        for j, own in enumerate(tokens):
            rows += [i] * len(own)
            cols += [j] * len(own)
            fs += own
    rows, cols, fs = np.array(rows, int), np.array(cols, int), np.array(fs, int)
    marked = np.zeros((size, length), bool)
    marked[rows, cols] = True
    theta, m, v = np.zeros(n + 1 + 4), np.zeros(n + 5), np.zeros(n + 5)
    pairs = live[:, 1:]
    want_trans = np.array([[(pairs & (gold[:, :-1] == a) & (gold[:, 1:] == b)).sum() for b in (0, 1)] for a in (0, 1)], float)
    for r in range(1, rounds + 1):
        emit, other, trans = theta[:n], theta[n], theta[n + 1 :].reshape(2, 2)
        e = np.where(marked, 0.0, other)
        np.add.at(e, (rows, cols), emit[fs])
        e = np.stack([np.zeros_like(e), np.clip(e, -30, 30)], 2)
        step = np.exp(trans)
        a = np.zeros((length, size, 2))
        a[0] = np.exp(e[:, 0])
        a[0] /= a[0].sum(1, keepdims=True)
        for t in range(1, length):
            x = (a[t - 1] @ step) * np.exp(e[:, t])
            a[t] = np.where(live[:, t, None], x / x.sum(1, keepdims=True), a[t - 1])
        b = np.ones((length, size, 2))
        have_trans = np.zeros((2, 2))
        for t in range(length - 2, -1, -1):
            x = np.exp(e[:, t + 1]) * b[t + 1]
            back = x @ step.T
            on = live[:, t + 1]
            joint = a[t][:, :, None] * step[None] * x[:, None, :]
            joint /= joint.sum((1, 2), keepdims=True)
            have_trans += joint[on].sum(0)
            b[t] = np.where(on[:, None], back / back.sum(1, keepdims=True), b[t + 1])
        p = a * b
        p = (p[:, :, 1] / p.sum(2)).T
        miss = np.where(live, gold - p, 0.0)
        grad = np.zeros(n + 5)
        np.add.at(grad, fs, miss[rows, cols])
        grad[n] = miss[~marked].sum()
        grad[n + 1 :] = (want_trans - have_trans).ravel()
        grad = grad / size - 1e-3 * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta = theta + 0.3 * (m / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.99**r)) + 1e-9)
    return theta[:n], float(theta[n]), theta[n + 1 :].reshape(2, 2)


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Newton's steps with a quadratic penalty; without both labels, the log odds of their share."""
    w = np.zeros(x.shape[1])
    if len(y) == 0 or y.min() == y.max():
        w[0] = -5.0 if not len(y) or y.max() == 0 else 5.0
        return w
    penalty = np.diag([1e-3, 0.02, 0.02, 0.02])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w = w + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
    return w


def held_out(key: str = "doc_id") -> Column:
    """Whether crc32(doc_id as text) mod 5 is 0; a null id counts as empty text, whose crc32 is 0."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model of at most `sample` labelled rows that are not held out. Rows without id or label are left out; of an id's labels the largest counts, of its texts that of the smallest hash."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).dropna().filter(~held_out())
    some = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), raw(F.col("text")).alias("text"))
    one = texts.join(F.broadcast(some), "doc_id").groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("one"), F.max("toxic").alias("toxic"))
    rows = one.select("doc_id", "one.text", "toxic").collect()  # at most `sample`
    rows.sort(key=lambda r: r.doc_id)
    return train([bytes(r.text) for r in rows], [r.toxic for r in rows])


_scorers: dict[bytes, Scorer] = {}


def scorer(sent) -> Scorer:
    """One for each Python worker and model, so that its cache of words lasts."""
    claim("toxicity", _scorers.clear)
    key = repr(sorted(sent.value.emit.items())).encode() + sent.value.doc.tobytes()
    if key not in _scorers:
        _scorers.clear()
        _scorers[key] = sent.value.prepare()
    return _scorers[key]


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (0 to 1), predicted (1 from 0.5), and spans: flat byte offsets of toxic tokens (probability from 0.5).

    Null and empty texts have no tokens and the score of that. Rows that repeat a doc_id, or have none, are each scored; an
    empty table gives an empty one; other columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = scorer(sent)
        for batch in sliced(batches):
            scores, spans = [], []
            for text in batch.column(1).to_pylist():
                value, places, p = s.score(text)
                scores.append(value)
                bad = {a for a, q in zip(places, p) if q >= 0.5}
                spans.append([x for k, m in enumerate(_WORD.finditer(text)) if k in bad for x in m.span()] if bad else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array([int(x >= 0.5) for x in scores], pa.int32()), pa.array(spans, pa.list_(pa.int32()))], names=["doc_id", "score", "predicted", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), raw(F.col("text")).alias("text")).mapInArrow(trimmed(run), "doc_id long, score double, predicted int, spans array<int>")


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows that are not predicted toxic, with all their columns."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @arrow_udf("boolean")
    def clean(text: pa.Array) -> pa.Array:
        s = scorer(sent)
        return pa.array((s.score(t.as_py())[0] < 0.5 for t in text), pa.bool_())

    return docs.filter(clean(raw(F.col("text"))))
